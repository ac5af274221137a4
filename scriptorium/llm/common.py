"""What several text-preparation operators share."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.session import durable

#: Rows of a key up to which they stay together; larger keys are split into cells of about so many.
CELL = 2048
#: Rows of one key from which on they are joined by broadcast. There are never more than
#: ``SPLIT`` such keys, so their list can be broadcast.
HUB, SPLIT = 1 << 16, 1_000_000


def bounded_sample(df: DataFrame, key: str, size: int, chars: int | None = None) -> DataFrame:
    """At most ``size`` rows, and at most ``chars`` characters of column text in all, chosen by a
    hash of ``key``. Texts are taken whole; those above a sixteenth of ``chars`` are left out.

    The row count (for a whole table it comes from the files' footers) sets how small a hash
    must be, so that only some more rows than wanted are carried to the final choice, whatever
    the input's size.
    """
    rows = df.count()
    if rows > size * 4:
        part = 1.5 * size / rows
        df = df.filter(F.xxhash64(key) < F.lit(int(-(2**63) + part * 2**64)))
    if chars is None:
        return df.orderBy(F.xxhash64(key), key).limit(size)
    some = df.filter(F.coalesce(F.length("text"), F.lit(0)) <= chars // 16).orderBy(F.xxhash64(key), key).limit(size)
    # a running sum over the few rows that are left
    upto = F.sum(F.coalesce(F.length("text"), F.lit(0))).over(W.orderBy(F.xxhash64(key), key).rowsBetween(W.unboundedPreceding, 0))
    return some.withColumn("upto", upto).filter(F.col("upto") <= chars).drop("upto")


def with_one(left: DataFrame, right: DataFrame, keys: list[str], rows: int, how: str = "left", hub: int = HUB) -> DataFrame:
    """``left`` (of ``rows`` rows) joined to ``right``, which has one row per key and, in column
    ``n``, how often the key stands in ``left``.

    Keys that stand very often, of which there are at most rows / hub, are joined by
    broadcast, so that their rows stay where they are; the others meet in a shuffle.
    """
    if rows < hub:
        return left.join(right.drop("n"), keys, how)
    hub = max(hub, rows // SPLIT)
    hubs = right.filter(F.col("n") >= hub).drop("n").withColumn("is_hub", F.lit(True))
    tagged = left.join(F.broadcast(hubs), keys, "left")
    few = tagged.filter("is_hub is null").select(left.columns).join(right.filter(F.col("n") < hub).drop("n"), keys, how)
    return tagged.filter("is_hub").drop("is_hub").unionByName(few)


def hot_keys(counted: DataFrame, keys: list[str], rows: int, cell: int = CELL) -> DataFrame | None:
    """(keys, cells) of the keys (keys, n) that hold more than a cell's rows, None if there are
    none. Of ``rows`` rows at most ``SPLIT`` keys can be so large."""
    cell = max(cell, rows // SPLIT)
    hot = durable(counted.filter(F.col("n") > cell).select(*keys, F.ceil(F.col("n") / cell).cast("int").alias("cells")), "hot")
    return None if hot.isEmpty() else hot


def in_cell(df: DataFrame, hot: DataFrame | None, keys: list[str], own: str | None, name: str = "cell") -> DataFrame:
    """``df`` with a cell of its key: by column ``own`` one of them, without it every one."""
    if hot is None:
        return df.withColumn(name, F.lit(0))
    cells = F.coalesce("cells", F.lit(1))
    cell = F.pmod(F.xxhash64(own), cells).cast("int") if own else F.explode(F.sequence(F.lit(0), cells - 1))
    return df.join(F.broadcast(hot), keys, "left").withColumn(name, cell).drop("cells")
