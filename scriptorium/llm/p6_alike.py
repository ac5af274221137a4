"""Problem 6: group texts that share most of their runs of three words.

Each text becomes a fingerprint of one-bit minwise hashes in segments of 23 bits, the
length of the perfect Golay code. A segment is decoded to the codewords within distance
four of it, which gives one or six keys; two segments that differ in two bits or fewer
always share a key, and often with more. By the pigeonhole principle some segment of two
alike texts has few errors. A key also holds two whole minwise values, so that frequent
phrases don't fill a bucket. Texts that share a key are joined, and those whose fingerprints
are close are verified on all their runs, taken from the texts again. Equal texts are one
class from the start. Keys and classes that hold very many rows are split into cells, so
that no task has a whole one.
"""

from __future__ import annotations

import itertools
import re

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.llm.common import CELL, HUB, hot_keys, in_cell, with_one
from scriptorium.session import durable, spread

LIMIT = 0.70
RUN = 3
#: Segments of the fingerprint. A segment and its two minwise values meet with probability
#: 0.30 at similarity 0.70 and 0.40 at 0.75; of 22 none does with 0.0004 and 0.00001.
SEGMENTS = 22
BITS = 23
KEYS_A_TASK = 250_000

_WORDS = re.compile(r"[^\W_]+")


def _hashes(seed: int = 20) -> np.ndarray:
    return np.random.default_rng(seed).integers(1, 1 << 31, (SEGMENTS, BITS + 2), dtype=np.uint32) * 2 + 1


def _golay() -> tuple[np.ndarray, np.ndarray]:
    """Syndromes of the single bits, and the coset leader of each syndrome, of the Golay
    code with generator x^11 + x^9 + x^7 + x^6 + x^5 + x + 1."""
    generator = 0b101011100011
    bit = []
    for i in range(BITS):
        v = 1 << i
        for k in range(BITS - 1, 10, -1):
            if v >> k & 1:
                v ^= generator << (k - 11)
        bit.append(v)
    leader = np.zeros(2048, np.int64)
    for weight in (1, 2, 3):
        for places in itertools.combinations(range(BITS), weight):
            s = 0
            for i in places:
                s ^= bit[i]
            leader[s] = sum(1 << i for i in places)
    return np.array(bit, np.int64), leader


_BIT, _LEADER = _golay()


def codewords(x: np.ndarray) -> np.ndarray:
    """For each 23-bit word the numbers (12 bits) of the codewords it and its neighbours
    decode to, one column per neighbour."""
    s = np.zeros_like(x)
    for i in range(BITS):
        s ^= ((x >> i) & 1) * _BIT[i]
    out = np.empty((len(x), BITS + 1), np.int64)
    out[:, 0] = (x ^ _LEADER[s]) >> 11
    for i in range(BITS):
        out[:, i + 1] = (x ^ (1 << i) ^ _LEADER[s ^ _BIT[i]]) >> 11
    return out


class Shingler:
    """Sets of hashed runs of ``run`` words; keeps hashes of words it has seen."""

    def __init__(self, run: int = RUN):
        self.run, self.seen = run, {}

    def _word(self, w: str) -> int:
        import xxhash

        if len(self.seen) > 400_000:
            self.seen.clear()
        h = self.seen[w] = xxhash.xxh64_intdigest(w)
        return h

    def sets(self, texts: list) -> list[np.ndarray]:
        """The distinct runs of each text, as sorted hashes of 64 bits."""
        seen, words, counts = self.seen, [], []
        for t in texts:
            own = _WORDS.findall(t.lower()) if t else []
            counts.append(len(own))
            try:
                words += [seen[w] for w in own]
            except KeyError:
                words += [seen[w] if w in seen else self._word(w) for w in own]
        h = np.array(words, np.uint64)
        n = max(len(h) - self.run + 1, 0)
        mixed = np.zeros(n, np.uint64)
        for k in range(self.run):
            mixed = (mixed ^ h[k : k + n]) * np.uint64(0x9E3779B97F4A7C15)
            mixed ^= mixed >> np.uint64(29)
        # runs that reach into the next text are left out
        ends = np.cumsum(counts)
        return [np.unique(mixed[e - c : max(e - c, e - self.run + 1)]) for e, c in zip(ends.tolist(), counts)]


def fingerprints(runs: np.ndarray, begins: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(segments, anchors) of non-empty sets: 23 one-bit minwise hashes a segment, and two
    whole minwise values folded into one number."""
    table = _hashes()
    segments = np.zeros((len(begins), SEGMENTS), np.uint32)
    anchors = np.zeros((len(begins), SEGMENTS), np.uint32)
    for s in range(SEGMENTS):
        for k in range(BITS + 2):
            least = np.minimum.reduceat(runs * table[s, k], begins)
            if k < BITS:
                segments[:, s] |= ((least * np.uint32(0x9E3779B1)) >> np.uint32(31)) << np.uint32(k)
            else:
                anchors[:, s] = (anchors[:, s] ^ least) * np.uint32(0x85EBCA6B)
    return segments, anchors


def prepare(documents: DataFrame) -> DataFrame:
    """(entry_id, same, n, mark): per text a hash of 128 bits of its set of runs, their number and
    the fingerprint. Texts with no run of three words have no row."""
    own = spread(documents.select("entry_id", "text"))

    def run(batches):
        import xxhash

        shingler = Shingler()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                sets = shingler.sets(some.column(1).to_pylist())
                has = [k for k, s in enumerate(sets) if len(s)]
                if not has:
                    continue
                sets = [sets[k] for k in has]
                n = [len(s) for s in sets]
                segments, anchors = fingerprints((np.concatenate(sets) >> np.uint64(32)).astype(np.uint32), np.cumsum([0, *n[:-1]]))
                mark = np.concatenate((segments, anchors), axis=1)
                yield pa.RecordBatch.from_arrays(
                    [some.column(0).take(pa.array(has)), pa.array([xxhash.xxh3_128_digest(s.tobytes()) for s in sets], pa.binary()), pa.array(n, pa.int32()), pa.array([m.tobytes() for m in mark], pa.binary())],
                    names=["entry_id", "same", "n", "mark"],
                )

    return own.mapInArrow(run, "entry_id long, same binary, n int, mark binary")


def _allowed(bits: int, limit: float) -> int:
    """Most bits in which fingerprints of sets alike to ``limit`` differ, but for a chance of
    some millionths: one bit differs with probability (1 - limit) / 2."""
    p = (1 - limit) / 2
    return int(np.ceil(bits * p + 4.6 * np.sqrt(bits * p * (1 - p))))


def _keys(classes: DataFrame) -> DataFrame:
    """(key, id, sketch): each class under each key of each segment, once; the sketch is 64
    bits taken evenly from all segments."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 2048):
                some = batch.slice(at, 2048)
                marks = np.frombuffer(b"".join(some.column(1).to_pylist()), np.uint32).reshape(-1, 2 * SEGMENTS).astype(np.int64)
                ids, keys = [], []
                sketch = np.zeros(len(marks), np.uint64)
                for k in range(64):
                    sketch |= ((marks[:, k % SEGMENTS] >> (k // SEGMENTS * 7)) & 1).astype(np.uint64) << np.uint64(k)
                sketch = sketch.view(np.int64)
                for s in range(SEGMENTS):
                    code = np.sort(codewords(marks[:, s]), axis=1)
                    first = np.ones(code.shape, bool)
                    first[:, 1:] = code[:, 1:] != code[:, :-1]
                    row, _ = np.nonzero(first)
                    ids.append(row)
                    keys.append((s << 44) | (marks[row, SEGMENTS + s] << 12) | code[first])
                rows = np.concatenate(ids)
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(keys)), some.column(0).take(pa.array(rows)), pa.array(sketch[rows])], names=["key", "id", "sketch"])

    return classes.mapInArrow(run, "key long, id long, sketch long")


def _near(pairs: DataFrame, limit: float) -> DataFrame:
    """Pairs (a, b, sa, sb) whose whole fingerprints differ in no more bits, and whose sizes differ no
    more, than sets alike to ``limit`` can."""
    most = _allowed(SEGMENTS * BITS, limit)

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                some = batch.slice(at, 8192)
                x, y = (np.frombuffer(b"".join(some.column(c).to_pylist()), np.uint32).reshape(-1, 2 * SEGMENTS)[:, :SEGMENTS] for c in ("ma", "mb"))
                apart = np.bitwise_count(x ^ y).sum(axis=1, dtype=np.int64)
                na, nb = some.column("na").to_numpy(), some.column("nb").to_numpy()
                keep = pa.array(np.flatnonzero((apart <= most) & (np.minimum(na, nb) >= limit * np.maximum(na, nb) - 1e-9)))
                yield some.select(["a", "b", "sa", "sb"]).take(keep)

    return pairs.mapInArrow(run, "a long, b long, sa binary, sb binary")


def _verified(pairs: DataFrame, limit: float) -> DataFrame:
    """(a, b, likeness) of the pairs (a, b, sa, sb, ta, tb) that are alike by all their runs; sa
    and sb tell which of several texts of an entry is meant."""

    def run(batches):
        import xxhash

        shingler = Shingler()
        for batch in batches:
            for at in range(0, batch.num_rows, 512):
                some = batch.slice(at, 512)
                sets = shingler.sets([*some.column("ta").to_pylist(), *some.column("tb").to_pylist()])
                ok, likeness = [], []
                for k, (a, b, sa, sb) in enumerate(zip(sets, sets[some.num_rows :], some.column("sa").to_pylist(), some.column("sb").to_pylist())):
                    both = len(np.intersect1d(a, b, assume_unique=True))
                    either = len(a) + len(b) - both
                    if either and both >= limit * either - 1e-9 and xxhash.xxh3_128_digest(a.tobytes()) == sa and xxhash.xxh3_128_digest(b.tobytes()) == sb:
                        ok.append(k)
                        likeness.append(both / either)
                yield pa.RecordBatch.from_arrays([some.column("a").take(pa.array(ok, pa.int32())), some.column("b").take(pa.array(ok, pa.int32())), pa.array(likeness, pa.float64())], names=["a", "b", "likeness"])

    return pairs.mapInArrow(run, "a long, b long, likeness double")


def _met(classes: DataFrame, limit: float, cell: int) -> DataFrame:
    """Pairs (a, b), a < b, of classes that share a key and whose sketches are close."""
    part = 16
    some = _keys(classes.filter(F.pmod(F.xxhash64("entry_id"), F.lit(part)) == 0).select("entry_id", "mark"))
    # a part of the rows tells which keys are large enough to be split
    rows = classes.count() * SEGMENTS * 6
    hot = hot_keys(some.groupBy("key").agg((F.count("*") * part).alias("n")), ["key"], rows, max(cell, 4 * part))
    keys = _keys(classes.select("entry_id", "mark"))
    x = in_cell(in_cell(keys, hot, ["key"], "id", "i"), hot, ["key"], None, "j").alias("x")
    y = in_cell(in_cell(keys, hot, ["key"], "id", "j"), hot, ["key"], None, "i").alias("y")
    # as many tasks as the keys need, whatever the session says: a few megabytes each
    tasks = max(int(classes.sparkSession.conf.get("spark.sql.shuffle.partitions")), rows // KEYS_A_TASK)
    on = ["key"] if hot is None else ["key", "i", "j"]
    x, y = x.repartition(tasks, *[F.col(f"x.{c}") for c in on]).alias("x"), y.repartition(tasks, *[F.col(f"y.{c}") for c in on]).alias("y")
    same = (F.col("x.key") == F.col("y.key")) if hot is None else (F.col("x.key") == F.col("y.key")) & (F.col("x.i") == F.col("y.i")) & (F.col("x.j") == F.col("y.j"))
    close = F.bit_count(F.col("x.sketch").bitwiseXOR(F.col("y.sketch"))) <= _allowed(64, limit)
    return x.join(y.hint("merge"), same & (F.col("x.id") < F.col("y.id")) & close).select(F.col("x.id").alias("a"), F.col("y.id").alias("b")).distinct()


def alike(documents: DataFrame, limit: float = LIMIT, cell: int = CELL) -> tuple[DataFrame, DataFrame]:
    """(links, members): links (a, b, likeness) between classes of equal sets of runs, a < b,
    and members (entry_id, class) of all texts with a run; a class is named by its least
    entry_id. An entry that stands with several texts counts with the one of most runs. Every
    stage is written to the shared folder, so it is computed once."""
    one = prepare(documents).groupBy("entry_id").agg(F.max(F.struct("n", "same", "mark")).alias("x"))
    rows = durable(one.select("entry_id", "x.*"), "p6-rows")
    equal = rows.groupBy("same").agg(F.min("entry_id").alias("class"), F.count("*").alias("n")).filter("n > 1")
    joined = with_one(rows.select("entry_id", "same"), equal, ["same"], rows.count())
    members = durable(joined.select("entry_id", F.coalesce("class", "entry_id").alias("class")), "p6-members")
    copies = members.filter("entry_id <> class").select("entry_id")
    classes = rows.join(copies, "entry_id", "left_anti")
    met = _met(classes, limit, cell)
    own = lambda side, *columns: classes.select(F.col("entry_id").alias(side), *[F.col(c).alias(c[0] + side) for c in columns])
    marked = met.join(own("a", "n", "mark", "same"), "a").join(own("b", "n", "mark", "same"), "b")
    near = durable(_near(marked.select("a", "b", "na", "nb", "ma", "mb", "sa", "sb"), limit), "p6-near")
    text = lambda side: documents.select(F.col("entry_id").alias(side), F.col("text").alias("t" + side))
    both = near.join(text("a"), "a").join(text("b"), "b").select("a", "b", "sa", "sb", "ta", "tb")
    return durable(_verified(both, limit).dropDuplicates(["a", "b"]), "p6-links"), members


def found(documents: DataFrame, limit: float = LIMIT, cell: int = CELL) -> DataFrame:
    """(entry_a, entry_b), entry_a < entry_b: each pair of entries alike to at least ``limit``.

    Texts in lower case are taken as words (runs of letters and digits) and compared by
    their sets of runs of three words; null, empty and shorter texts are in no pair.
    Pairs within a class of equal texts are part of the result, as the result is asked
    for by entries; ``groups`` gives the same links without expanding copies.
    """
    links, members = alike(documents, limit, cell)
    hot = hot_keys(members.groupBy("class").agg(F.count("*").alias("n")), ["class"], members.count(), cell)
    one = in_cell(members, hot, ["class"], "entry_id")
    a, b = one.select(F.col("class").alias("a"), "cell", F.col("entry_id").alias("ea")), one.select(F.col("class").alias("b"), "cell", F.col("entry_id").alias("eb"))
    left = in_cell(links.select("a", "b").withColumnRenamed("a", "class"), hot, ["class"], None).withColumnRenamed("class", "a").join(a, ["a", "cell"]).drop("cell")
    across = in_cell(left.withColumnRenamed("b", "class"), hot, ["class"], None).withColumnRenamed("class", "b").join(b, ["b", "cell"])
    across = across.select(F.least("ea", "eb").alias("entry_a"), F.greatest("ea", "eb").alias("entry_b"))
    # pairs of copies: each member meets those of every cell of its class
    every = in_cell(members, hot, ["class"], None).select("class", "cell", F.col("entry_id").alias("eb"))
    within = one.join(every, ["class", "cell"]).filter("entry_id < eb").select(F.col("entry_id").alias("entry_a"), F.col("eb").alias("entry_b"))
    return across.unionByName(within)


def components(links: DataFrame, a: str = "a", b: str = "b", rounds: int = 40, hub: int = HUB) -> DataFrame:
    """(id, group): connected components of undirected links, named by their least id.

    Alternates the large and the small star: each step links every id to the least id near
    it, so that a component becomes one star after a number of rounds that grows with the
    logarithm of its size. Neither a component nor the links of one id are gathered in one task.
    """
    edges = durable(links.select(F.col(a).cast("long").alias("u"), F.col(b).cast("long").alias("v")).filter("u <> v"), "star")
    before, rows = None, 2 * edges.count()
    for _ in range(rounds):
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"), F.count("*").alias("n"))
        large = with_one(both, least, ["u"], rows, "inner", hub).filter("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).filter("u <> v").distinct()
        down = large.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v"))
        least = down.groupBy("u").agg(F.min("v").alias("m"), F.count("*").alias("n"))
        small = with_one(down, least, ["u"], rows, "inner", hub).select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.select("u", F.col("m").alias("v"))).filter("u <> v").distinct()
        edges = durable(small, "star")
        state = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        rows = 2 * state[0]
        if state == before:
            break
        before = state
    else:
        raise RuntimeError("components did not settle")
    return edges.select(F.col("u").alias("id"), F.col("v").alias("group")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("group"))).distinct()


def groups(documents: DataFrame, limit: float = LIMIT) -> DataFrame:
    """(entry_id, class, links, group): one row for each entry whose text has a run of three
    words: its class of equal texts, the number of other classes alike to it, and the
    group of all entries it is linked with, over any number of links."""
    links, members = alike(documents, limit)
    ends = links.select(F.explode(F.array("a", "b")).alias("class")).groupBy("class").agg(F.count("*").alias("links"))
    of = components(links).select(F.col("id").alias("class"), "group")
    out = members.join(ends, "class", "left").join(of, "class", "left")
    return out.select("entry_id", "class", F.coalesce("links", F.lit(0)).alias("links"), F.coalesce("group", "class").alias("group"))
