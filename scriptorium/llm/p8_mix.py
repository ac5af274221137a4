"""Problem 8: mix sources to target weights, in tokens of a public tokenizer.

The texts of a source, in a fixed order, are one long run of tokens, packed into blocks of a
fixed length. A mix is a number of slots; each output shard draws from a multinomial how
many of its slots each source fills. So that shares come out exactly and no cap is passed,
the few slots that a source was drawn too often, at pseudorandom places, go to the sources
drawn too rarely. The slots of a source, numbered through all shards, go through a
pseudorandom permutation of its block numbers, a new one for each repeat, and are joined to
the blocks by number. ``mixed`` gives blocks as spans of records, ``packed`` their tokens.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from scriptorium.llm.p7_encode import FOLDER, NAME, encode
from scriptorium.session import durable

BLOCK = 512  # tokens of a block
SLOTS = 256  # slots of a shard, at least; a shard has fewer than twice as many
GROUP = 128  # shards that are drawn together by one task


def permuted(j: np.ndarray, n: int, key: int) -> np.ndarray:
    """A pseudorandom permutation of 0..n-1, at places ``j``: a Feistel network, walked until
    it falls below ``n``."""
    half = max(1, (max(n - 1, 1).bit_length() + 1) // 2)
    mask = np.uint64((1 << half) - 1)
    x = j.astype(np.uint64)
    todo = np.ones(len(x), bool)
    while todo.any():
        left, right = x[todo] >> np.uint64(half), x[todo] & mask
        for r in range(4):
            h = (right + np.uint64((key + r * 0x9E3779B9) & 0xFFFFFFFF)) * np.uint64(0xBF58476D1CE4E5B9)
            h ^= h >> np.uint64(31)
            left, right = right, (left ^ h * np.uint64(0x94D049BB133111EB) >> np.uint64(20)) & mask
        x[todo] = (left << np.uint64(half)) | right
        todo = x >= n
    return x.astype(np.int64)


def tokens(documents: DataFrame, sources: list, name: str = NAME, folder: str = FOLDER) -> DataFrame:
    """(row, doc_id, source, tie, n, ids): each record of ``sources`` that has text, with its tokens."""
    own = documents.filter(F.col("source").isin(sources) & (F.length("text") > 0)).select("doc_id", "source", F.xxhash64("text").alias("tie"), "text")
    coded = encode(own, name, folder, keys=("doc_id", "source", "tie"))
    return coded.select(F.monotonically_increasing_id().alias("row"), "doc_id", "source", "tie", F.size("ids").cast("long").alias("n"), "ids")


def placed(sized: DataFrame) -> DataFrame:
    """Each record with ``at``, where it starts in the run of its source's tokens.

    The order is that of a hash. Sums are taken in ranges of it first, and then within a
    range, so that a source of any size is spread over many tasks.
    """
    ranges = max(1, sized.count() // 20_000)
    own = sized.withColumn("h", F.xxhash64("doc_id", "tie")).withColumn("range", F.pmod("h", F.lit(ranges)))
    total = own.groupBy("source", "range").agg(F.sum("n").alias("of"))
    before = W.partitionBy("source").orderBy("range").rowsBetween(W.unboundedPreceding, -1)
    total = total.select("source", "range", F.coalesce(F.sum("of").over(before), F.lit(0)).alias("base"))
    within = W.partitionBy("source", "range").orderBy("h", "doc_id", "tie", "row").rowsBetween(W.unboundedPreceding, -1)
    own = own.withColumn("own", F.coalesce(F.sum("n").over(within), F.lit(0)))
    return own.join(total, ["source", "range"]).select("row", "doc_id", "source", "n", (F.col("base") + F.col("own")).alias("at"))


def _parts(at: DataFrame, size: int, *kept) -> DataFrame:
    """(source, block, x): what of each record lies in each block."""
    first, last = F.floor(F.col("at") / size), F.floor((F.col("at") + F.col("n") - 1) / size)
    part = at.select("*", F.explode(F.sequence(first, last)).alias("block"))
    begin = F.greatest(F.lit(0), F.col("block") * size - F.col("at"))
    end = F.least(F.col("n"), (F.col("block") + 1) * size - F.col("at"))
    return part.select("source", "block", F.struct(F.greatest("at", F.col("block") * size).alias("at"), "doc_id", begin.alias("from"), end.alias("to"), *kept).alias("x"))


def blocks(at: DataFrame, size: int = BLOCK) -> DataFrame:
    """(source, block, tokens, spans): spans are (doc_id, from, to) in the records' tokens.
    A block holds at most ``size`` records; a source's last block may be short."""
    spans = F.transform(F.sort_array(F.collect_list("x")), lambda x: F.struct(x["doc_id"].alias("doc_id"), x["from"].alias("from"), x["to"].alias("to")))
    return _parts(at, size).groupBy("source", "block").agg(F.sum(F.col("x.to") - F.col("x.from")).alias("tokens"), spans.alias("spans"))


def plan(targets: list, held: dict[str, int], size: int = BLOCK) -> list[dict]:
    """Per mix and source: slots, blocks and share among the sources that hold text.

    The mix is the largest that gives every such source its share without repeating a
    block more than its ``max_repeats`` times.
    """
    out = []
    for mix in sorted({t.mix_name for t in targets}):
        own = [t for t in targets if t.mix_name == mix]
        some = [t for t in own if held.get(t.source, 0) > 0 and (t.target_share or 0) > 0 and (t.max_repeats or 0) > 0]
        whole = sum(t.target_share for t in some)
        count = {t.source: -(-held[t.source] // size) for t in some}
        slots = min((math.floor(t.max_repeats * count[t.source] * whole / t.target_share + 1e-9) for t in some), default=0)
        exact = {t.source: slots * t.target_share / whole for t in some}
        given = {s: min(int(x), max(t.max_repeats for t in some if t.source == s) * count[s]) for s, x in exact.items()}
        for s in sorted(exact, key=lambda s: (given[s] - exact[s], s)):  # the largest remainders first
            if sum(given.values()) < slots and given[s] < max(t.max_repeats for t in some if t.source == s) * count[s]:
                given[s] += 1
        out += [{"mix_name": mix, "source": t.source, "target_share": t.target_share, "max_repeats": t.max_repeats, "slots": given.get(t.source, 0), "blocks": count.get(t.source, 0)} for t in own]
    return out


def _mixes(rows: list[dict]) -> list[dict]:
    """What a task must know of each mix with slots: its sources, slots, blocks and shards."""
    out = []
    for mix in dict.fromkeys(r["mix_name"] for r in rows):
        own = [r for r in rows if r["mix_name"] == mix and r["slots"]]
        total = sum(r["slots"] for r in own)
        if total:
            slots = np.array([r["slots"] for r in own], np.int64)
            out.append({"mix": mix, "sources": [r["source"] for r in own], "slots": slots, "blocks": np.array([r["blocks"] for r in own], np.int64), "total": total, "shards": max(1, total // SLOTS)})
    return out


def _groups(spark, mixes: list[dict]) -> DataFrame:
    """(mix, group): every group of shards, numbered within its mix."""
    sizes = [-(-m["shards"] // GROUP) for m in mixes]
    ends = np.cumsum(sizes).tolist()
    number = spark.range(0, sum(sizes), 1, max(1, min(sum(sizes), spark.sparkContext.defaultParallelism * 4)))
    mix = F.lit(0)
    for e in ends[:-1]:
        mix = mix + (F.col("id") >= e).cast("int")
    first = F.element_at(F.array(*map(F.lit, [0, *ends[:-1]])), mix + 1)
    return number.select(mix.alias("mix"), (F.col("id") - first).cast("long").alias("group"))


def draws(m: dict, group: int, seed: int = 11) -> np.ndarray:
    """Slots of each source (columns) in each shard (rows) of a group: multinomial draws."""
    p = m["slots"] / m["total"]
    out = []
    for shard in range(group * GROUP, min(m["shards"], (group + 1) * GROUP)):
        n = m["total"] // m["shards"] + (shard < m["total"] % m["shards"])
        out.append(np.random.default_rng([seed, zlib.crc32(m["mix"].encode()), shard]).multinomial(n, p))
    return np.array(out)


def _key(*parts) -> int:
    return zlib.crc32("|".join(map(str, parts)).encode())


def settled(m: dict, drawn: np.ndarray, source: np.ndarray, number: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(source, number) of slots after the repair: ``drawn`` is how often each source was drawn
    in all shards, ``number`` the place of a slot among those drawn for its source.

    The numbers of a source are permuted; those beyond what it should have are handed, in
    order, to the sources that have too few, as the numbers these lack.
    """
    want = m["slots"]
    over, lack = np.maximum(drawn - want, 0), np.maximum(want - drawn, 0)
    first_over, end_lack = np.cumsum(over) - over, np.cumsum(lack)
    source, out = source.copy(), np.zeros(len(number), np.int64)
    given = source.copy()
    for k in range(len(want)):
        places = np.flatnonzero(given == k)
        q = permuted(number[places], max(int(drawn[k]), 1), _key(m["mix"], m["sources"][k], "repair"))
        spare = q >= want[k]
        r = first_over[k] + q[spare] - want[k]
        to = np.searchsorted(end_lack, r, side="right")
        source[places[spare]] = to
        q[spare] = drawn[to] + r - (end_lack[to] - lack[to])
        out[places] = q
    return source, out


def _slots(spark, rows: list[dict]) -> DataFrame:
    """(mix_name, shard, slot, source, repeat, block): every slot of every mix.

    Groups of shards are drawn once for the counts and, by the same seeds, again for the
    slots, so that nothing but one count per group and source passes between tasks.
    """
    mixes = _mixes(rows)
    schema = "mix_name string, shard long, slot int, source string, repeat int, block long"
    if not mixes:
        return spark.createDataFrame([], schema)

    def count(batches):
        for batch in batches:
            out = [[], [], [], []]
            for i, g in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                for k, n in enumerate(draws(mixes[i], g).sum(axis=0).tolist()):
                    for column, value in zip(out, (i, g, k, n)):
                        column.append(value)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, (pa.int32(), pa.int64(), pa.int32(), pa.int64()))], names=["mix", "group", "k", "n"])

    counted = durable(_groups(spark, mixes).mapInArrow(count, "mix int, group long, k int, n long"), "p8-draws")
    # one row for each source of each mix
    drawn = [np.zeros(len(m["slots"]), np.int64) for m in mixes]
    for r in counted.groupBy("mix", "k").agg(F.sum("n").alias("n")).collect():
        drawn[r.mix][r.k] = r.n
    before = W.partitionBy("mix", "k").orderBy("group").rowsBetween(W.unboundedPreceding, -1)
    base = counted.withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0)))
    # few bytes stand for many slots: as many tasks as for the draws, not what the bytes suggest
    tasks = max(1, min(sum(-(-m["shards"] // GROUP) for m in mixes), spark.sparkContext.defaultParallelism * 4))
    groups = base.groupBy("mix", "group").agg(F.transform(F.sort_array(F.collect_list(F.struct("k", "base"))), lambda x: x["base"]).alias("base")).repartition(tasks, "mix", "group")

    def fill(batches):
        for batch in batches:
            for i, g, first in zip(*(batch.column(c).to_pylist() for c in range(3))):
                m, each = mixes[i], draws(mixes[i], g)
                shard = np.concatenate([np.repeat(np.arange(len(each)), each[:, k]) for k in range(each.shape[1])]) + g * GROUP
                source = np.repeat(np.arange(each.shape[1]), each.sum(axis=0))
                number = np.concatenate([first[k] + np.arange(n) for k, n in enumerate(each.sum(axis=0).tolist())])
                source, number = settled(m, drawn[i], source, number)
                repeat, at = number // m["blocks"][source], number % m["blocks"][source]
                block = np.zeros(len(at), np.int64)
                for k, r in np.unique(np.stack((source, repeat)), axis=1).T.tolist():
                    places = np.flatnonzero((source == k) & (repeat == r))
                    block[places] = permuted(at[places], int(m["blocks"][k]), _key(m["mix"], m["sources"][k], r))
                # a shard's slots in pseudorandom order
                mixed_up = np.random.default_rng([5, _key(m["mix"]), g]).permutation(len(shard))
                order = mixed_up[np.argsort(shard[mixed_up], kind="stable")]
                shard, source, repeat, block = shard[order], source[order], repeat[order], block[order]
                slot = np.arange(len(shard)) - np.searchsorted(shard, shard) + 1
                names = np.array(m["sources"], object)
                for a in range(0, len(shard), 1 << 16):
                    b = a + (1 << 16)
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([m["mix"]] * len(shard[a:b]), pa.string()), pa.array(shard[a:b]), pa.array(slot[a:b].astype(np.int32)), pa.array(names[source[a:b]], pa.string()), pa.array((repeat[a:b] + 1).astype(np.int32)), pa.array(block[a:b])],
                        names=["mix_name", "shard", "slot", "source", "repeat", "block"],
                    )

    return groups.mapInArrow(fill, schema)


def _wanted(targets: DataFrame) -> list:
    """The targets: small by nature, one row for each mix and source."""
    return targets.select("mix_name", "source", "target_share", "max_repeats").filter("mix_name is not null and source is not null").dropDuplicates(["mix_name", "source"]).orderBy("mix_name", "source").collect()


def mixed(documents: DataFrame, targets: DataFrame, size: int = BLOCK) -> tuple[DataFrame, list[dict]]:
    """(rows, plan): a row (mix_name, shard, slot, source, repeat, block, tokens, spans) for
    each block of each mix.

    No block, and so no record, stands in a mix more than its source's max_repeats times.
    Sources without a target, records without text or source, and targets of sources that
    hold no text are left out; the shares of the others stay in proportion. Further columns
    are ignored. ``targets`` is small by nature (one row for each mix and source) and read on
    the driver, as are the token totals of its sources.
    """
    wanted = _wanted(targets)
    sized = durable(tokens(documents, sorted({t.source for t in wanted})).drop("ids"), "p8-sizes")
    held = {r.source: r.n for r in sized.groupBy("source").agg(F.sum("n").alias("n")).collect()}
    rows = plan(wanted, held, size)
    # the plan can't tell how many slots a group makes: without the hint they would be broadcast
    out = _slots(documents.sparkSession, rows).join(blocks(placed(sized), size).hint("merge"), ["source", "block"])
    return out.select("mix_name", "shard", "slot", "source", "repeat", "block", F.col("tokens").cast("long").alias("tokens"), "spans"), rows


def packed(documents: DataFrame, targets: DataFrame, size: int = BLOCK) -> DataFrame:
    """(source, block, tokens, ids): the tokens of every block that a mix can draw, once; the
    blocks of ``mixed`` by their numbers. All sources with a target are packed."""
    coded = durable(tokens(documents, sorted({t.source for t in _wanted(targets)})), "p8-tokens")
    at = placed(coded.drop("ids")).join(coded.select("row", "ids"), "row")
    parts = _parts(at, size, "ids").select("source", "block", F.struct("x.at", "x.doc_id", F.expr("slice(x.ids, cast(x.from as int) + 1, cast(x.to - x.from as int))").alias("ids")).alias("x"))
    ids = F.flatten(F.transform(F.sort_array(F.collect_list("x")), lambda x: x["ids"]))
    return parts.groupBy("source", "block").agg(ids.alias("ids")).select("source", "block", F.size("ids").alias("tokens"), "ids")


def shares(documents: DataFrame, targets: DataFrame, size: int = BLOCK) -> DataFrame:
    """(mix_name, source, target_share, actual_share, tokens, blocks, max_repeats, most_repeats)
    for each target; a source that holds no text has share 0."""
    rows, planned = mixed(documents, targets, size)
    got = rows.groupBy("mix_name", "source").agg(F.sum("tokens").alias("tokens"), F.count("*").alias("blocks"), F.max("repeat").alias("most_repeats"))
    schema = T.StructType([T.StructField("mix_name", T.StringType()), T.StructField("source", T.StringType()), T.StructField("target_share", T.DoubleType()), T.StructField("max_repeats", T.IntegerType())])
    wanted = documents.sparkSession.createDataFrame([(r["mix_name"], r["source"], r["target_share"], r["max_repeats"]) for r in planned], schema)
    out = wanted.join(got, ["mix_name", "source"], "left").fillna(0, ["tokens", "blocks", "most_repeats"])
    whole = F.sum("tokens").over(W.partitionBy("mix_name"))
    return out.select("mix_name", "source", "target_share", F.when(whole > 0, F.col("tokens") / whole).otherwise(F.lit(0.0)).alias("actual_share"), "tokens", "blocks", "max_repeats", "most_repeats")


def with_ids(rows: DataFrame, blocks: DataFrame) -> DataFrame:
    """Rows of ``mixed`` with ``ids``: joined to the packed blocks by their numbers."""
    return rows.drop("spans").join(blocks.select("source", "block", "ids"), ["source", "block"])
