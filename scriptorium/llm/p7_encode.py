"""Problem 7: encode a corpus with a public byte-level BPE tokenizer.

Every text is cut into overlapping chunks. Each chunk is pre-tokenised by itself, and the
stitch to the next chunk is the first pre-token boundary in the overlap on which both
agree: the pattern looks only ahead, so from a common boundary on all boundaries are
common. Where an overlap holds none, the piece ends at the next place that is a boundary in
every reading. What lies between two stitches is encoded as one piece, and the pieces' ids
are put together. Very long texts are cut the same way into parts that go to different tasks.
"""

from __future__ import annotations

import base64
import os
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from scriptorium.session import spread

FOLDER = "/opt/tokenizers"
NAME = "byte_bpe_50k"
CHUNK = 2048  # characters of a chunk
REACH = 256  # characters of the overlap with the next chunk
SPREAD = 1 << 20  # characters of a part that is encoded by one task

#: Fixed value: the pre-token pattern that belongs to the vocabulary.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""

_made: dict = {}


def _file(name: str, folder: str) -> bytes:
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as f:
        return f.read()


def _made_of(name: str, data: bytes):
    """The tokenizer of the contents of a ``.tiktoken`` file, once per Python process."""
    import tiktoken

    key = (name, len(data), zlib.crc32(data))
    if key not in _made:
        ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, data.splitlines())}
        _made[key] = tiktoken.Encoding(name, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _made[key]


def tokenizer(name: str = NAME, folder: str = FOLDER):
    """The tokenizer of a vocabulary file; it has no special tokens."""
    return _made_of(name, _file(name, folder))


def decode(ids, name: str = NAME, folder: str = FOLDER) -> str:
    """The text of ``ids``: the tokens' raw bytes, joined, read as UTF-8."""
    return tokenizer(name, folder).decode_bytes(list(ids)).decode("utf-8")


def boundaries(text: str, pattern) -> np.ndarray:
    """Ends of the pre-tokens of ``text``."""
    return np.array([m.end() for m in pattern.finditer(text)], np.int64)


def stitch(ahead: str, size: int, pattern) -> int | None:
    """Where the next chunk's pre-tokens begin to hold: the first boundary in the overlap
    that the chunk and a start at ``size`` have in common, or None.

    ``ahead`` is a chunk of ``size`` characters with its overlap. The last two boundaries
    of either reading don't count: they may be there because the overlap ends.
    """
    own = boundaries(ahead, pattern)[:-2]
    theirs = np.append(0, boundaries(ahead[size:], pattern)[:-2]) + size
    common = np.intersect1d(own, theirs)
    return int(common[0]) if len(common) else None


def sure(text: str) -> int | None:
    """The first place of ``text`` that is a boundary in every reading, or None: no pre-token
    goes on after a letter but with a letter, nor after a digit but with a digit."""
    m = _sure().search(text)
    return m.start() if m else None


def begins(text: str, chunk: int, reach: int, pattern) -> list[int]:
    """Where the pieces of ``text`` begin, one for each chunk whose stitch is found."""
    out, held = [0], True
    for b in range(chunk, len(text), chunk):
        cut = stitch(text[b - chunk : b + reach], chunk, pattern) if held else None
        at = b - chunk + cut if cut is not None else None
        if at is None:
            found = sure(text[b : b + chunk])
            at = None if found is None else b + found
        # a chunk without a boundary of its own has no reading that could be trusted
        held = at is not None
        if held and at < len(text):
            out.append(at)
    return out


def _ids(texts: list, core, chunk: int, reach: int, pattern) -> pa.Array:
    """One list of ids for each text; null counts as empty."""
    pieces, sizes = [], []
    for t in texts:
        if not t:
            sizes.append(0)
            continue
        at = begins(t, chunk, reach, pattern)
        pieces += [t[a:b] for a, b in zip(at, [*at[1:], len(t)])] if len(at) > 1 else [t]
        sizes.append(len(at))
    parts = [core.encode_ordinary(p) for p in pieces]
    ends = np.cumsum([0, *map(len, parts)])
    flat = np.empty(ends[-1], np.int32)
    for a, b, ids in zip(ends, ends[1:], parts):
        flat[a:b] = ids
    return pa.ListArray.from_arrays(pa.array(ends[np.cumsum([0, *sizes])], pa.int32()), pa.array(flat))


def _encoded(df: DataFrame, name: str, folder: str, chunk: int, reach: int) -> DataFrame:
    """Column ``text`` of ``df`` as ``ids``; the columns before it stay. A few hundred rows at a time."""
    kept = df.columns[:-1]
    width = len(kept)
    # the vocabulary (a file of fixed size) is read here, so executors need no copy of it
    data = df.sparkSession.sparkContext.broadcast(_file(name, folder))

    def run(batches):
        core, pattern = _made_of(name, data.value)._core_bpe, _pattern()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                yield pa.RecordBatch.from_arrays([*some.columns[:width], _ids(some.column(width).to_pylist(), core, chunk, reach, pattern)], names=[*kept, "ids"])

    return df.mapInArrow(run, T.StructType([*df.schema.fields[:-1], T.StructField("ids", T.ArrayType(T.IntegerType()))]))


def encode(documents: DataFrame, name: str = NAME, folder: str = FOLDER, chunk: int = CHUNK, reach: int = REACH, spread_over: int = SPREAD, keys: tuple = ("doc_id",)) -> DataFrame:
    """(doc_id, ids): the token ids of each text, without special tokens; ``keys`` names the
    columns to keep in place of doc_id.

    One row for each row of ``documents``, repeated rows included. Null and empty texts
    give an empty list; strings that look like special tokens are ordinary text. Chunks of a
    text are stitched where it is read; of one above ``spread_over`` characters, parts of
    that size are stitched to one another, so that several tasks share it. A piece is longer
    than two chunks only where one pre-token is. Further columns are ignored.
    """
    own = documents.select(*keys, "text")
    usual = _encoded(spread(own.filter(F.coalesce(F.length("text"), F.lit(0)) <= spread_over)), name, folder, chunk, reach)
    # a row's own number keeps repeated doc_ids apart
    rows = own.filter(F.length("text") > spread_over).withColumn("row", F.monotonically_increasing_id())
    start = F.sequence(F.lit(0), F.length("text") - 1, F.lit(spread_over))
    parts = rows.select(*keys, "row", F.length("text").alias("n"), F.posexplode(F.transform(start, lambda a: F.substring("text", a + 1, F.lit(spread_over + reach)))).alias("k", "text"))
    parts = parts.repartition("row", "k")

    def find(batches):
        pattern = _pattern()
        for batch in batches:
            texts, ks, ns = (batch.column(c).to_pylist() for c in ("text", "k", "n"))
            cut = [stitch(t, spread_over, pattern) if (k + 1) * spread_over < n else None for t, k, n in zip(texts, ks, ns)]
            own = [sure(t[:spread_over]) for t in texts]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(cut, pa.int32()), pa.array(own, pa.int32())], names=[*batch.schema.names, "cut", "sure"])

    cut = parts.mapInArrow(find, T.StructType([*parts.schema.fields, T.StructField("cut", T.IntegerType()), T.StructField("sure", T.IntegerType())]))
    before = W.partitionBy("row").orderBy("k")
    held = (F.col("k") == 0) | F.col("sure").isNotNull()
    at = F.when(F.col("k") == 0, 0).otherwise(F.coalesce(F.when(F.lag(held).over(before), F.lag("cut").over(before) - spread_over), F.col("sure")))
    cut = cut.withColumn("at", at).withColumn("piece", F.count("at").over(before.rowsBetween(W.unboundedPreceding, 0)))
    cut = cut.withColumn("text", F.substring("text", 1, spread_over))
    # what stands before a part's first piece ends the piece before it
    head = F.struct((F.col("piece") - F.col("at").isNotNull().cast("int")).alias("piece"), F.lit(0).alias("half"), F.expr("substring(text, 1, coalesce(at, length(text)))").alias("part"))
    tail = F.struct("piece", F.lit(1).alias("half"), F.expr("substring(text, at + 1, length(text))").alias("part"))
    halves = cut.select(*keys, "row", "k", F.explode(F.array(head, tail)).alias("x")).filter("length(x.part) > 0")
    pieces = halves.groupBy(*keys, "row", "x.piece").agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("k", "x.half", "x.part"))), lambda x: x["part"]), "").alias("text"))
    long = _encoded(pieces, name, folder, chunk, reach)
    long = long.groupBy(*keys, "row").agg(F.flatten(F.transform(F.sort_array(F.collect_list(F.struct("piece", "ids"))), lambda x: x["ids"])).alias("ids"))
    return usual.unionByName(long.select(*keys, "ids"))


def token_counts(documents: DataFrame, name: str = NAME, folder: str = FOLDER) -> DataFrame:
    """(doc_id, n_tokens) for each row of ``documents``."""
    return encode(documents, name, folder).select("doc_id", F.size("ids").alias("n_tokens"))


@lru_cache(maxsize=1)
def _pattern():
    import regex

    # white space is Unicode's, as for the encoder; control characters 1C to 1F are none
    return regex.compile(PATTERN.replace(r"[^\s", r"[^\p{White_Space}").replace(r"\s", r"\p{White_Space}").replace(r"\S", r"\P{White_Space}"))


@lru_cache(maxsize=1)
def _sure():
    import regex

    return regex.compile(r"(?<=\p{L})\P{L}|(?<=\p{N})\P{N}")
