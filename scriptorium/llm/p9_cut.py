"""Problem 9: find texts that were cut off, and how often each source cuts.

Intact texts are cut on purpose, at limits and anywhere, to give positives; intact texts as
they are, and cut at a sentence end, give negatives. A hashed logistic regression over the
closing characters, words, lines and punctuation and the length against the limits of the
source then scores every record. The limits are lengths that stand out among all records
of a source.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from scriptorium.llm.common import bounded_sample, with_one
from scriptorium.session import durable, spread

#: Texts the regression is trained on, and their characters, at most; limits and scores cover
#: all records.
SAMPLE, CHARS = 8000, 32_000_000
BITS = 18
#: A length is a limit if so large a part, and so many, of a source's records have it.
SHARE, LEAST = 0.012, 6
SOURCES = 10_000  # sources up to which their limits (at most 250 each) are broadcast

#: What may stand after a cut: white space, marks of omission with a few words, a broken character.
_AFTER = re.compile(r"(?:\s|�|…|\[…\]|\[\.\.\.\]|\.\.\.)+(?:[^\W\d_]+(?: [^\W\d_]+){0,2}\s*)?$")
_MARK = re.compile(r"…|\.\.\.|\[\.\.\.\]")
_MARKS = ("[…]", "[...]", "…", "...")
_END = re.compile(r"[.!?…](?=[\s»”\"')\]]|$)")
_PAIRS = {"«": "»", "“": "”", "„": "“", "(": ")", "[": "]"}


def _solid(text: str, n: int) -> int:
    """Where text[:n] ends without white space and broken characters, however many."""
    while n and (text[n - 1] == "�" or text[n - 1].isspace()):
        n -= 1
    return n


def stripped(text: str) -> tuple[str, str]:
    """``text`` without what may stand after a cut, and the kind of what stood there."""
    n = _solid(text, len(text))
    broken = "�" in text[n:]
    m = _AFTER.search(text, max(0, n - 64), n)
    # a broken character stands at the cut, not after words of an omission
    if m and _MARK.search(m.group()) and not (broken and m.group()[-1].isalpha()):
        n = m.start()
        while (k := _solid(text, n)) < n or text.endswith(_MARKS, 0, n):
            n = k if k < n else n - next(len(x) for x in _MARKS if text.endswith(x, 0, n))
        return text[:n], "mark"
    return text[:n], "broken" if broken else "space" if n < len(text) else "none"


def _shape(s: str) -> str:
    """Digits as 0, letters by case, runs shortened."""
    out = []
    for c in s:
        k = "0" if c.isdigit() else "A" if c.isupper() else "a" if c.isalpha() else " " if c.isspace() else c
        if not out or out[-1] != k:
            out.append(k)
    return "".join(out)


_DIGITS = re.compile(r"\d+")
_mask = (1 << BITS) - 1


def features(text: str, limits: frozenset) -> list[int]:
    """Hashed features of the end of ``text``; ``limits`` are those of its source, as (kind, length)."""
    base, after = stripped(text)
    n, m, b = len(text), len(base), len(base.rstrip("�").encode("utf-8", "replace"))
    at_limit = ("c", n) in limits or ("c", m) in limits or ("b", b) in limits or ("b", b + 1) in limits or ("b", len(text.encode("utf-8", "replace"))) in limits
    tail, line = base[-16:], base[base.rfind("\n") + 1 :].strip("\r")
    words = line.split(" ")
    last = words[-1]
    before = words[-2] if len(words) > 1 else ""
    shape = _shape(last)[-6:]
    final = tail[-1:]
    kind = unicodedata.category(final) if final else "none"
    plain = _DIGITS.sub("0", line)
    ends = [x.end() for x in _END.finditer(line)]
    rest = line[ends[-1] :] if ends and ends[-1] < len(line) else line if not ends else ""
    open_pair = any(line.rfind(o) > line.rfind(c) for o, c in _PAIRS.items())
    stop = final in ".!?;:" and final != ""
    f = [
        "bias", f"k{kind}", f"c{final}", f"a{after}", f"ka{kind}{after}", f"s{shape}", f"l{at_limit}", f"lk{at_limit}{kind}", f"lc{at_limit}{stop}",
        f"w{last[-12:].lower()}", f"b{before[-10:].lower()}|{shape}", f"p{open_pair}{stop}", f"n{min(len(words), 12)}{kind}", f"r{min(len(rest.split()), 12)}{stop}", f"t{tail[-2:]}", f"tt{_DIGITS.sub('0', tail[-4:])}",
        f"u{line[:1].isupper()}{kind}", f"tab{line.count(chr(9)) > 0}{kind}", f"len{min(m.bit_length(), 14)}", f"sl{len(last) if len(last) < 12 else 12}{kind}",
    ]
    if len(plain) <= 80:
        f += [f"L{plain}", f"L{plain[:12]}|{plain[-6:]}", f"LS{_shape(plain)[:20]}", f"LSE{_shape(plain)[:10]}{kind}{stop}"]
    else:
        f += ["Llong", f"Llong{kind}{stop}"]
    return [zlib.crc32(x.encode("utf-8", "replace")) & _mask for x in f]


class Regression:
    """Logistic regression over lists of hashed feature numbers, by full-batch Adagrad steps."""

    def __init__(self, rows: list[list[int]], y: np.ndarray, weight: np.ndarray, steps: int = 220, rate: float = 0.35, decay: float = 2e-5):
        flat = np.concatenate([np.asarray(r, np.int64) for r in rows])
        of = np.repeat(np.arange(len(rows)), [len(r) for r in rows])
        begins = np.concatenate(([0], np.cumsum([len(r) for r in rows])[:-1]))
        w, g2 = np.zeros(1 << BITS), np.full(1 << BITS, 1e-8)
        for _ in range(steps):
            p = 1 / (1 + np.exp(-np.add.reduceat(w[flat], begins)))
            g = np.bincount(flat, ((p - y) * weight)[of], 1 << BITS) / weight.sum() + decay * w
            g2 += g * g
            w -= rate * g / np.sqrt(g2)
        self.w = w.astype(np.float32)

    def score(self, rows: list[list[int]]) -> np.ndarray:
        if not rows:
            return np.zeros(0)
        begins = np.concatenate(([0], np.cumsum([len(r) for r in rows])[:-1]))
        return 1 / (1 + np.exp(-np.add.reduceat(self.w[np.concatenate([np.asarray(r) for r in rows])], begins).astype(np.float64)))


def fit(rows: list, y: np.ndarray, weight: np.ndarray, suspect: float = 0.3, folds: int = 3) -> Regression:
    """A regression without doubtful negatives: what was taken for intact in the sample also
    holds cut texts, so those that a fit on the other rows suspects are left out."""
    fold = np.random.default_rng(3).integers(0, folds, len(y))
    keep = np.ones(len(y), bool)
    for _ in range(2):
        doubt = np.zeros(len(y))
        for k in range(folds):
            some, rest = (fold != k) & keep, np.flatnonzero(fold == k)
            if some.any() and len(rest) and 0 < y[some].mean() < 1:
                doubt[rest] = Regression([rows[i] for i in np.flatnonzero(some)], y[some], weight[some], steps=60).score([rows[i] for i in rest])
        keep = (y > 0.5) | (doubt < suspect)
    return Regression([r for r, k in zip(rows, keep) if k], y[keep], weight[keep])


def _cut(text: str, at: int, by_bytes: bool) -> str:
    if by_bytes:
        data = text.encode("utf-8", "replace")[:at]
        return data.decode("utf-8", "replace")
    return text[:at]


def examples(texts: list[tuple[str, frozenset]], seed: int = 7) -> tuple[list, np.ndarray, np.ndarray]:
    """(feature rows, 1 for cut, weight) of sample texts with their sources' limits."""
    rnd = np.random.default_rng(seed)
    rows, y, weight = [], [], []

    def add(text, limits, cut, w=1.0):
        rows.append(features(text, limits))
        y.append(cut)
        weight.append(w)

    marks = ("...", "…", " ...", "[...]", "... more here", " ", "\n", "  \n", "\n\n\t ")
    for text, limits in texts:
        base, after = stripped(text)
        at_limit = ("c", len(text)) in limits or ("c", len(base)) in limits or ("b", len(base.encode("utf-8", "replace"))) in limits
        if after in ("mark", "broken") or at_limit:
            continue  # not sure to be intact
        add(text, limits, 0.0)
        if len(base) < 40:
            continue
        ends = [m.end() for m in _END.finditer(base)]
        fitting = [(k, v) for k, v in limits if 20 < v < len(base)]
        if fitting and rnd.random() < 0.6:
            k, v = fitting[rnd.integers(len(fitting))]
            piece, lim = _cut(base, v, k == "b"), limits
        else:
            v = int(rnd.integers(20, len(base)))
            by_bytes = rnd.random() < 0.15
            piece = _cut(base, v, by_bytes)
            lim = limits if rnd.random() < 0.7 else limits | {("c", len(piece))}
        solid = piece.rstrip("� \n\t\r")
        last = base.find("\n", len(solid))
        closed = any(e == len(solid) for e in ends) or (last == len(solid) and solid[-1:] in ".!?»”")
        if rnd.random() < 0.3:
            piece += marks[rnd.integers(len(marks))]
        line_end = len(solid) == len(base) or base[len(solid)] in "\r\n"
        if closed or line_end:
            if closed and not _MARK.search(piece[-16:]):
                add(piece, lim, 0.0, 0.5)
        else:
            add(piece, lim, 1.0)
        # a limit reached just at the end of a sentence cuts nothing
        if ends and rnd.random() < 0.3:
            e = ends[rnd.integers(len(ends))]
            if e > 20 and (e == len(base) or base[e].isspace()):
                tail = base[max(0, e - 12) : e].split()
                if tail and len(tail[-1].strip(".")) > 3 and not tail[-1][-2:-1].isdigit():
                    add(base[:e], limits | {("c", e)}, 0.0, 0.7)
    return rows, np.array(y), np.array(weight)


def limits(documents: DataFrame) -> DataFrame:
    """(source, kind, length, records, of): lengths at which a source cuts, over all records.

    kind is 'c' for characters and 'b' for bytes of UTF-8. Null sources count as one source.
    """
    text = F.col("text")
    base = F.regexp_replace(text, r"[\s�…]+$|(\.\.\.|\[\.\.\.\]|…)[^.…]{0,24}$", "")
    own = documents.filter(F.length(text) > 0).select(
        "source",
        F.explode(F.array_distinct(F.array(
            F.struct(F.lit("c").alias("kind"), F.length(text).alias("length")),
            F.struct(F.lit("c").alias("kind"), F.length(base).alias("length")),
            F.struct(F.lit("b").alias("kind"), F.octet_length(base).alias("length")),
        ))).alias("v"),
    )
    counted = own.groupBy("source", "v.kind", "v.length").agg(F.count("*").alias("records"))
    totals = documents.filter(F.length(text) > 0).groupBy("source").agg(F.count("*").alias("of"))
    return counted.filter(F.col("records") >= LEAST).join(totals.hint("merge"), F.equal_null(counted["source"], totals["source"])).filter(F.col("records") >= SHARE * F.col("of")).select(counted["source"], "kind", "length", "records", "of")


def _with_limits(documents: DataFrame) -> DataFrame:
    """Rows of ``documents`` with the limits of their source, written 'c120 b400', as ``limits``.

    A source has at most 3 / SHARE limits, so those of a checked number of sources are
    broadcast. Where there are more, each source's limits stand once for every part that the
    records of a source are split into.
    """
    written = F.array_join(F.sort_array(F.collect_set(F.concat("kind", F.col("length").cast("string")))), " ")
    sets = durable(limits(documents).groupBy("source").agg(written.alias("limits")), "p9-limits")
    if sets.count() <= SOURCES:
        return documents.join(F.broadcast(sets.withColumnRenamed("source", "of")), F.equal_null("source", "of"), "left").drop("of")
    parts = 64
    sets = sets.withColumnRenamed("source", "of").withColumn("of_part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))
    own = documents.withColumn("part", F.pmod(F.xxhash64("doc_id"), F.lit(parts)).cast("int"))
    return own.join(sets, F.equal_null("source", "of") & (F.col("part") == F.col("of_part")), "left").drop("of", "of_part", "part")


@lru_cache(maxsize=1 << 16)
def _limit_set(written: str | None) -> frozenset:
    return frozenset((x[0], int(x[1:])) for x in (written or "").split())


def train(documents: DataFrame, sample: int = SAMPLE) -> Regression:
    """The regression, from at most ``sample`` texts (and ``CHARS`` characters) chosen by a hash
    of doc_id; ``documents`` has their limits."""
    some = bounded_sample(documents.select("doc_id", "limits", "text"), "doc_id", sample, CHARS).filter(F.length("text") > 0).collect()
    seen = dict.fromkeys((r.text, r.limits) for r in some)
    rows, y, weight = examples([(t, _limit_set(s)) for t, s in seen])
    if not rows or y.min() == y.max():
        rows, y, weight = [features("Whole.", frozenset()), features("Cut of", frozenset())], np.array([0.0, 1.0]), np.ones(2)
    return fit(rows, y, weight)


def scores(documents: DataFrame) -> DataFrame:
    """(doc_id, source, same, size, own): each record's own score, and what marks equal texts."""
    spark = documents.sparkSession
    known = _with_limits(spread(documents.select("doc_id", "source", "text")))
    model = spark.sparkContext.broadcast(train(known).w)
    own = known.select("doc_id", "source", "text", F.xxhash64("text").alias("same"), "limits")

    def run(batches):
        scorer = Regression.__new__(Regression)
        scorer.w = model.value
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                texts, written = some.column(2).to_pylist(), some.column(4).to_pylist()
                rows = [features(t, _limit_set(s)) if t and not t.isspace() else None for t, s in zip(texts, written)]
                got = iter(scorer.score([r for r in rows if r]).tolist())
                score = [next(got) if r else 0.0 for r in rows]
                yield pa.RecordBatch.from_arrays([some.column(0), some.column(1), some.column(3), pa.array([len(t or "") for t in texts], pa.int32()), pa.array(score, pa.float64())], names=["doc_id", "source", "same", "size", "own"])

    schema = T.StructType([*documents.select("doc_id", "source").schema.fields, T.StructField("same", T.LongType()), T.StructField("size", T.IntegerType()), T.StructField("own", T.DoubleType())])
    return own.mapInArrow(run, schema)


def found(documents: DataFrame) -> DataFrame:
    """doc_id of each document whose text was cut, once."""
    return cut_records(documents).filter("cut").select("doc_id").distinct()


def cut_records(documents: DataFrame) -> DataFrame:
    """(doc_id, source, score, cut) for each row of ``documents``.

    ``score`` is the probability that the text was cut; copies of one text share the
    greatest score of any of them, since a copy may stand in a source without the limit
    that cut it. Null and blank texts have score 0. Further columns are ignored.
    """
    scored = durable(scores(documents), "p9")
    best = scored.groupBy("same", "size").agg(F.max("own").alias("best"), F.count("*").alias("n")).filter("best > 0.5")
    out = with_one(scored, best, ["same", "size"], scored.count())
    return out.select("doc_id", "source", F.coalesce("best", "own").alias("score"), F.col("best").isNotNull().alias("cut"))


def rates(documents: DataFrame) -> DataFrame:
    """(source, records, cut, rate): how often each source cuts; null is a source of its own."""
    out = cut_records(documents).groupBy("source").agg(F.count("*").alias("records"), F.sum(F.col("cut").cast("long")).alias("cut"))
    return out.withColumn("rate", F.col("cut") / F.col("records"))
