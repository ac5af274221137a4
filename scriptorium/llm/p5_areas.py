"""Problem 5: the subject areas of each entry.

Terms, sources and structure. Term weights come from a sentence model: each sentence is
about one area or none, fitted to hand labels and to what the labels say about a direction.
The shares of an entry's sentences, and what its direction speaks for, are the features of
a classifier chain, in which an area's probability also depends on the areas decided
before it. Probabilities are calibrated on held-out labels; combinations of areas are
decoded by beam search.
"""

from __future__ import annotations

import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import p2_encoding
from scriptorium.session import durable, spread

#: A term is known if it makes up so large a part of all terms of sentences and stands twice or
#: more; so there are never more than 2.5 million of them.
FREQUENT = 4e-7
#: Shares are summed in parts of so many.
UNIT = 1 << 20
#: Texts are split together up to so many characters.
CHARS = 1 << 20
#: Labelled entries of a task.
TASK = 20_000
BEAM = 8

_SENTENCE = re.compile(r"[.!?]\s+(?=[«“„\"(]?[^\W\d_a-zа-яёіўґєї])")
_HYPHEN = re.compile(r"[-‐¬\xad](?<=[^\W\d_].)[ \t\r]*\n[ \t]*(?=[^\W\d_])")
_AT_LINE_END = re.compile(r"[-‐¬\xad][ \t\r]*\n")
#: Letters of a word that is a term, at least, and letters of it that count.
LEAST, MOST = 4, 6


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point what it says of a text's writing: 1 a letter of the Latin ranges, 2 one
    outside the basic one, 3 another letter, 4 one outside the Russian alphabet."""
    kinds = np.zeros(0x30000, np.uint8)
    for k in range(0x30000):
        if chr(k).isalpha():
            kinds[k] = 3 if k >= 0x370 else 2 if k > 0xBF else 1
    kinds[[k for k in range(0x450, 0x530) if k != 0x451]] = 4
    return kinds


def writing(text: str) -> str:
    """What a text is written in, as far as its letters tell: the script most of its letters
    have, and whether letters outside that script's basic range are usual in it."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = np.bincount(_letters()[np.minimum(codes, 0x2FFFF)], minlength=5)
    latin, marked, more = n[1] + n[2], n[2], n[4]
    other = n[3] + n[4]
    if latin > other:
        return "m" if marked * 200 > latin else "l"
    return "d" if more * 100 > other else "c"


@lru_cache(maxsize=1)
def _in_terms() -> np.ndarray:
    """For each code point whether it can stand in a term: letters and numbers that aren't digits."""
    return np.array([chr(k).isalnum() and not chr(k).isdecimal() for k in range(0x32400)] + [False])


def said(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(words, spots, terms, sizes, per): the distinct terms of each sentence that has any, how many
    those are, and each text's number of such sentences.

    Terms are beginnings of words in lower case, marked with what the text is written in, so that
    common words of one language stay common. They are given as 64-bit hashes; ``spots`` has, for
    each distinct one, (hash, writing, where it begins and ends in ``words``).
    """
    parts, counts, kinds = [], [], []
    for text in texts:
        kinds.append("clmd".index(writing(text)))
        if _AT_LINE_END.search(text):
            text = _HYPHEN.sub("", text)
        own = _SENTENCE.split(text)
        parts += own
        counts.append(len(own))
    parts = [s.lower() for s in parts]
    words = " ".join(parts) + " "
    codes = np.frombuffer(words.encode("utf-32-le", "surrogatepass"), np.uint32)
    letter = np.zeros(len(codes) + 2, np.int8)
    letter[1:-1] = _in_terms()[np.minimum(codes, 0x32400)]
    edge = np.diff(letter)
    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    keep = end - begin >= LEAST
    begin, end = begin[keep], np.minimum(end[keep], begin[keep] + MOST)
    sizes = np.fromiter(map(len, parts), np.int64, len(parts)) + 1
    sentence = np.searchsorted(np.cumsum(sizes), begin, side="right")
    text_of = np.repeat(np.arange(len(texts)), counts)
    kind = np.array(kinds, np.int64)[text_of[sentence]]
    term = kind.astype(np.uint64) << np.uint64(32)
    padded = np.append(codes, np.zeros(MOST, np.uint32)).astype(np.uint64)
    for k in range(MOST):
        term ^= np.where(begin + k < end, padded[begin + k], np.uint64(0))
        term *= np.uint64(0x9E3779B97F4A7C15)
        term ^= term >> np.uint64(32)
    order = np.argsort(term)
    new = np.append(True, np.diff(term[order]) != 0)[: len(term)]
    first = order[new]
    distinct, at = term[first].view(np.int64), np.empty(len(term), np.int64)
    at[order] = np.cumsum(new) - 1
    both = np.unique(sentence * max(len(distinct), 1) + at)
    sentence, at = np.divmod(both, max(len(distinct), 1))
    sizes = np.bincount(sentence, minlength=len(parts))
    spots = np.column_stack((distinct, kind[first], begin[first], end[first]))
    return words, spots, distinct[at], sizes[sizes > 0], np.bincount(text_of[sizes > 0], minlength=len(texts))


class Terms:
    """How much more often each term stands in sentences about each area than one would expect
    of what its text is written in. The last columns are 'other', a theme that is none of the
    areas, and 'none', what stands in texts of any theme."""

    #: How much a single term may say.
    TRUST = 0.92
    #: Part of an unlabelled text that may be about another theme, before anything is known.
    OTHER = 0.12

    #: Rounds in which a text's shares and those of its sentences settle.
    INNER = 2

    def __init__(self, of: dict[str, int], areas: int):
        self.of, self.none = of, 0.35
        self.kind = np.array(["clmd".index(w[0]) for w in of] or [0])
        self.log = np.zeros((max(len(of), 1), areas + 2))

    def learn(self, table: np.ndarray, usual: np.ndarray) -> None:
        """Weights from the shares summed over each term's sentences, and over those of each writing."""
        usual = usual + 0.5
        usual = (usual / usual.sum(axis=1, keepdims=True))[self.kind]
        ratio = (table + 2.0 * usual) / (table.sum(axis=1, keepdims=True) + 2.0) / usual
        self.log = np.log(1 - self.TRUST + self.TRUST * ratio)

    def evidence(self, flat) -> np.ndarray:
        """What the terms of each sentence say for each area: a row for each area."""
        ids, begins, _ = flat
        columns = self.log.shape[1]
        # two columns are fetched and summed at once, as parts of a complex number
        pairs = np.zeros((len(self.log), columns + columns % 2))
        pairs[:, :columns] = self.log
        own = np.array([np.add.reduceat(c.take(ids, mode="clip"), begins) for c in np.ascontiguousarray(pairs.view(np.complex128).T)])
        return np.stack((own.real, own.imag), axis=1).reshape(-1, len(begins))[:columns]

    def settled(self, flat, held: np.ndarray, sure: np.ndarray, some: int = 512) -> np.ndarray:
        """What part of each sentence is about each area, given what is known of its text: a row for
        each area. Goes by ``some`` texts, whose numbers stay in a core's memory."""
        ids, begins, doc = flat
        out, ends = np.empty((held.shape[1], len(begins))), np.append(begins, len(ids))
        for at in range(0, len(held), some):
            a, b = np.searchsorted(doc, (at, at + some))
            if a < b:
                own = ids[ends[a] : ends[b]], begins[a:b] - ends[a], doc[a:b] - at
                out[:, a:b] = self._settled(own, held[at : at + some], sure[at : at + some])
        return out

    def _settled(self, flat, held, sure):
        doc, own, held = flat[2], self.evidence(flat), np.ascontiguousarray(held.T)
        mix = held
        for _ in range(self.INNER):
            share = own + np.log(mix + 1e-4).take(doc, axis=1)
            share -= share.max(axis=0)
            np.exp(share, out=share)
            share /= share.sum(axis=0)
            mix = np.array([np.bincount(doc, row, held.shape[1]) for row in share]) + held * sure + 0.05 * (held > 0)
            mix /= mix.sum(axis=0)
        return share

    def shares(self, flat, total: np.ndarray) -> np.ndarray:
        """The part of each text's sentences that is about each area."""
        areas = self.log.shape[1] - 2
        ids, _, doc = flat
        out = np.zeros((len(total), areas))
        if not len(ids):
            return out
        score = self.evidence(flat)
        score[:-1] += np.log((1 - self.none) / (areas + 1))
        score[-1] += np.log(self.none)
        best = score.argmax(axis=0)
        about = best < areas
        np.add.at(out, (doc[about], best[about]), 1.0)
        return out / np.maximum(total, 1)[:, None]


def _numbers(column: pa.Array, kind: type) -> tuple[np.ndarray, np.ndarray]:
    """(the numbers of all rows, how many each row has) of bytes that hold numbers."""
    _, offsets, data = column.buffers()
    offsets = np.frombuffer(offsets, np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    own = np.frombuffer(data or b"", np.uint8)[offsets[0] : offsets[-1]].view(kind) if len(column) else np.zeros(0, kind)
    return own, np.diff(offsets) // np.dtype(kind).itemsize


def _bytes(numbers: np.ndarray, per: np.ndarray) -> pa.Array:
    """A row of bytes for each of ``per``, which tells how many of the numbers it has."""
    offsets = np.append(0, np.cumsum(per * numbers.itemsize)).astype(np.int32)
    return pa.Array.from_buffers(pa.binary(), len(per), [None, pa.py_buffer(offsets), pa.py_buffer(np.ascontiguousarray(numbers))])


def _flat(sizes: pa.Array, ids: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(terms, where each sentence's begin, each sentence's text) of entries' sentences."""
    sizes, per = _numbers(sizes, np.int32)
    return _numbers(ids, np.int32)[0].astype(np.intp), np.cumsum(sizes, dtype=np.intp) - sizes, np.repeat(np.arange(len(per)), per)


def _newton(sums, fits: int, size: int, decay: float, rounds: int = 25) -> np.ndarray:
    """Weights of ridge logistic regressions, by Newton steps; ``sums`` gives for the weights of
    each the slope and curvature over all rows."""
    w = np.zeros((fits, size))
    for _ in range(rounds):
        g, h = sums(w)
        step = np.array([np.linalg.solve(h[k] + decay * np.eye(size), g[k] + decay * w[k]) for k in range(fits)])
        w -= step
        if np.abs(step).max() < 1e-6:
            break
    return w


def _slope(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> np.ndarray:
    """All rows' part in slope, in the first row, and curvature, in the others."""
    p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
    return np.vstack((x.T @ (p - y), (x * (p * (1 - p))[:, None]).T @ x))


class Chain:
    """A chain of logistic classifiers with common weights for the features of an area and
    one weight for each pair of areas, calibrated on held-out entries."""

    #: Features with common weights.
    COMMON = 14

    def __init__(self, areas: int):
        self.areas = areas
        self.size = self.COMMON + areas * areas
        self.w, self.calibration = np.zeros(self.size), np.array([1.0, 0.0])

    def _features(self, k, shares, sizes, source):
        s = shares[:, k]
        rank = (shares > s[:, None]).sum(axis=1)
        n = s * sizes  # sentences about the area: one or two may be in passing
        bends = [10 * np.maximum(s - b, 0) for b in (0.0, 0.1, 0.15, 0.2, 0.25, 0.3, 0.35)]
        counts = [np.minimum(n, 1), np.clip(n - 1, 0, 1), np.clip(n - 2, 0, 2)]
        return np.column_stack((np.ones(len(s)), *bends, *counts, source[:, k], (rank == 0) & (s > 0), (rank == 1) & (s > 0)))

    def rows(self, k, shares, sizes, source, before):
        """(features of area ``k``, which of all weights are theirs)."""
        first = self.COMMON + k * self.areas
        return np.column_stack((self._features(k, shares, sizes, source), before[:, :k])), np.r_[: self.COMMON, first : first + k]

    def decode(self, shares, sizes, source, beam: int = BEAM) -> np.ndarray:
        """The most probable combination of areas of each text."""
        n = len(shares)
        labels, score = np.zeros((n, 1, self.areas)), np.zeros((n, 1))
        pair = self.w[-self.areas * self.areas :].reshape(self.areas, self.areas)
        for k in range(self.areas):
            own = self._features(k, shares, sizes, source) @ self.w[: -self.areas * self.areas]
            z = own[:, None] + labels[:, :, :k] @ pair[k, :k]
            z = z * self.calibration[0] + self.calibration[1]
            yes, no = -np.logaddexp(0, -z), -np.logaddexp(0, z)
            with_ = labels.copy()
            with_[:, :, k] = 1
            labels, score = np.concatenate((labels, with_), axis=1), np.concatenate((score + no, score + yes), axis=1)
            if score.shape[1] > beam:
                best = np.argpartition(-score, beam - 1, axis=1)[:, :beam]
                score, labels = np.take_along_axis(score, best, 1), np.take_along_axis(labels, best[:, :, None], 1)
        return labels[np.arange(n), score.argmax(axis=1)] > 0.5


class Model:
    """Everything an executor needs to assign areas."""

    def __init__(self, areas, titles, names, by_slug, of, entries):
        """``names`` holds the directions' titles, ``by_slug`` (slug, subjects, entries) of the
        labelled ones of all ``entries``. Labelled entries together weigh as much as the others."""
        self.areas, self.names = areas, names
        self.labelled = labelled = sum(n for _, _, n in by_slug)
        self.mixed, self.weight = labelled < entries, max(1.0, entries / labelled - 1)
        total, counts = np.zeros(len(areas)), {}
        for slug, subjects, n in by_slug:
            row = np.array([a in subjects for a in areas], np.float64)
            total += n * row
            counts[slug] = counts.get(slug, 0) + n * row / max(row.sum(), 1)
        base = (total + 1.0) / (total + 1.0).sum()
        # a direction's title that is an area's is worth some labels
        titled = {t.strip().lower(): k for k, t in enumerate(titles) if t}
        self.source: dict = {}
        for s in set(counts) | set(names):
            own = counts.get(s, np.zeros(len(areas))) + base
            k = titled.get((names.get(s) or "").strip().lower())
            if k is not None:
                own[k] += 3.0
            self.source[s] = own / own.sum()
        self.base = base
        # an area without a label and without a direction of its name was never shown
        named = {(t or "").strip().lower() for t in names.values()}
        self.taught = (total > 0) | np.array([(t or "").strip().lower() in named - {""} for t in titles], bool)
        self.terms, self.chain = Terms(of, len(areas)), Chain(len(areas))

    def hints(self, slugs):
        return np.array([self.source.get(s, self.base) for s in slugs]).reshape(len(slugs), len(self.areas))

    def labels(self, subjects: list) -> np.ndarray:
        return np.array([[a in (own or ()) for a in self.areas] for own in subjects], np.float64).reshape(len(subjects), len(self.areas))

    def beforehand(self, slugs: pa.Array, subjects: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(held, sure): what is known of each text's areas beforehand, and how firmly."""
        slugs = slugs.dictionary_encode(null_encoding="encode")
        prior, known = self.hints(slugs.dictionary.to_pylist())[slugs.indices.to_numpy()], subjects.is_valid()
        y, known = self.labels(subjects.filter(known).to_pylist()), known.to_numpy(zero_copy_only=False)
        prior[known] = 0.1 * prior[known] + 0.9 * y / np.maximum(y.sum(axis=1, keepdims=True), 1)
        other = np.where(known & self.mixed, 0.0, Terms.OTHER)
        none = self.terms.none
        return np.column_stack((prior * (1 - none - other)[:, None], other, np.full(len(prior), none))), np.where(known, 6.0, 1.5)

    def __call__(self, flat, total, slugs: list) -> np.ndarray:
        shares = self.terms.shares(flat, total)
        # an area none of the sentences is about can't be a fifth of them
        return self.chain.decode(shares, total, self.hints(slugs)) & (shares > 0) & self.taught


def _split(documents: DataFrame, garbled) -> DataFrame:
    """(entry_id, slug, word, sizes, terms): for each entry what ``said`` gives of its restored
    text, as bytes; and for each term a row of its hash, as entry_id, and its word."""

    def run(batches):
        repairer, heard = p2_encoding.Repairer.of(garbled.value), set()
        for batch in batches:
            texts = batch.column(2).to_pylist()
            upto = np.cumsum([len(t) for t in texts]) // CHARS
            cuts = [0, *(np.flatnonzero(np.diff(upto)) + 1).tolist(), len(texts)]
            for at, to in zip(cuts, cuts[1:]):
                words, spots, terms, sizes, per = said(repairer.restored(texts[at:to]))
                held = np.bincount(np.repeat(np.arange(to - at), per), sizes, to - at).astype(np.int64)
                some = batch.slice(at, to - at)
                yield rows(some.column(0), some.column(1), pa.nulls(to - at, pa.string()), _bytes(sizes.astype(np.int32), per), _bytes(terms, held))
                new = {h: "clmd"[k] + words[a:b] for h, k, a, b in spots.tolist() if h not in heard}
                heard.update(new)
                none = pa.nulls(len(new), pa.binary())
                yield rows(pa.array(list(new), pa.int64()), pa.nulls(len(new), pa.string()), pa.array(list(new.values()), pa.string()), none, none)

    def rows(*columns):
        return pa.RecordBatch.from_arrays(list(columns), names=["entry_id", "slug", "word", "sizes", "terms"])

    own = spread(documents.select("entry_id", "slug", "text").filter(F.length("text") > 0))
    return durable(own.mapInArrow(run, "entry_id long, slug string, word string, sizes binary, terms binary").dropDuplicates(["entry_id", "word"]), "p5-said")


def _vocabulary(told: DataFrame) -> tuple[dict[str, int], np.ndarray]:
    """(words, hashes) of the known terms, in the order of their numbers."""

    def run(batches):
        for batch in batches:
            term, n = np.unique(_numbers(batch.column(0), np.int64)[0], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(term), pa.array(n.astype(np.int64))], names=["term", "n"])

    counts = durable(told.filter("word is null").select("terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n")), "p5-terms")
    least = max(2, int((counts.agg(F.sum("n")).first()[0] or 0) * FREQUENT))
    words = told.filter("word is not null").groupBy(F.col("entry_id").alias("term")).agg(F.min("word").alias("w"))
    got = counts.filter(F.col("n") >= least).join(words, "term").orderBy(F.desc("n"), "w").collect()
    return {r.w: k for k, r in enumerate(got)}, np.array([r.term for r in got], np.int64)


def _numbered(told: DataFrame, known: DataFrame, terms: np.ndarray) -> DataFrame:
    """(entry_id, slug, subjects, total, sizes, ids): known terms as numbers; sentences without one only count."""
    order = np.argsort(terms)
    shared = told.sparkSession.sparkContext.broadcast((np.append(terms[order], 0), np.append(order, 0).astype(np.int32)))

    def run(batches):
        terms, numbers = shared.value
        for batch in batches:
            sizes, total = _numbers(batch.column(3), np.int32)
            own, _ = _numbers(batch.column(4), np.int64)
            at = np.searchsorted(terms[:-1], own)
            keep = (terms[at] == own) & (at < len(terms) - 1)
            left = np.diff(np.append(0, np.append(0, np.cumsum(keep))[np.cumsum(sizes)]))
            doc = np.repeat(np.arange(len(total)), total)
            per, held = np.bincount(doc[left > 0], minlength=len(total)), np.bincount(doc, left, len(total)).astype(np.int64)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(total.astype(np.int32)), _bytes(left[left > 0].astype(np.int32), per), _bytes(numbers[at[keep]], held)], names=["entry_id", "slug", "subjects", "total", "sizes", "ids"])

    own = told.filter("word is null").join(known, "entry_id", "left").select("entry_id", "slug", "subjects", "sizes", "terms")
    return durable(own.mapInArrow(run, "entry_id long, slug string, subjects array<string>, total int, sizes binary, ids binary"), "p5-ids")


def _learn_terms(rows: DataFrame, model: Model, rounds: int = 10) -> None:
    """Fits the sentence model to all entries by EM. Executors sum shares, as whole numbers; a row
    for each term comes to the driver."""
    context, terms = rows.sparkSession.sparkContext, model.terms
    size, columns = terms.log.shape
    names = [f"y{k}" for k in range(columns)]
    # few texts at a time, whose numbers stay in a core's memory, but not fewer terms than are known
    some = max(512, size // 128)
    for step in range(rounds + 1):
        shared = context.broadcast((model, step))

        def run(batches, shared=shared):
            model, step = shared.value
            out = np.zeros((columns, size + 4))
            for part in (batch.slice(at, some) for batch in batches for at in range(0, batch.num_rows, some)):
                flat = ids, begins, doc = _flat(part.column(2), part.column(3))
                if not len(ids):
                    continue
                held, sure = model.beforehand(part.column(0), part.column(1))
                weight = np.where(sure > 2, model.weight, 1.0)[doc] * UNIT
                share = np.rint((model.terms.settled(flat, held, sure) if step else held.T.take(doc, axis=1)) * weight)
                sizes, kind = np.diff(np.append(begins, len(ids))), model.terms.kind[ids[begins]]
                for k in range(columns):
                    if step < rounds:
                        out[k, :size] += np.bincount(ids, np.repeat(share[k], sizes), size)
                    out[k, size:] += np.bincount(kind, share[k], 4)
            at = np.flatnonzero(out.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array(at, pa.int32()), *(pa.array(row[at].astype(np.int64)) for row in out)], names=["at", *names])

        got = rows.select("slug", "subjects", "sizes", "ids").mapInArrow(run, ", ".join(["at int", *(f"{c} long" for c in names)])).groupBy("at").agg(*(F.sum(c).alias(c) for c in names)).toArrow()
        sums = np.zeros((size + 4, columns))
        sums[got.column("at").to_numpy()] = np.column_stack([got.column(c).to_numpy() for c in names]) / UNIT
        if step < rounds:
            terms.learn(sums[:size], sums[size:])
        elif sums[size:].sum():
            terms.none = float(np.clip(sums[size:, -1].sum() / sums[size:].sum(), 0.05, 0.9))
        shared.unpersist()


def _learn_chain(rows: DataFrame, model: Model) -> None:
    """Fits the chain to all labelled entries, and its calibration to halves it was not fitted to."""
    context, chain = rows.sparkSession.sparkContext, model.chain
    shared = context.broadcast(model)

    areas = chain.areas

    def features(batches):
        own = shared.value
        for batch in batches:
            total, slugs, subjects = batch.column(3).to_numpy(), batch.column(1).to_pylist(), batch.column(2).to_pylist()
            told = np.column_stack((own.terms.shares(_flat(batch.column(4), batch.column(5)), total), own.hints(slugs), own.labels(subjects), total))
            yield pa.RecordBatch.from_arrays([batch.column(0), _bytes(told.ravel(), np.full(len(told), told.shape[1]))], names=["entry_id", "told"])

    labelled = rows.filter("subjects is not null")
    half = F.pmod(F.xxhash64("entry_id"), F.lit(2)).alias("half")
    labelled = durable(labelled.mapInArrow(features, "entry_id long, told binary").select("told", half), "p5-labelled")
    # a step is a job of its own: not more tasks than there is work for
    labelled = labelled.coalesce(1 + model.labelled // TASK)

    def summed(fits, size, parts, w):
        """Sums over all rows and areas of what ``parts`` adds for (features, labels, halves)."""
        held = context.broadcast(w)

        def run(batches):
            own, out = shared.value, np.zeros((fits, size + 1, size))
            for batch in batches:
                told = _numbers(batch.column(0), np.float64)[0].reshape(-1, 3 * areas + 1)
                shares, source, y, total = *np.hsplit(told[:, :-1], 3), told[:, -1]
                for k in range(areas):
                    parts(out, *own.chain.rows(k, shares, total, source, y), y[:, k], batch.column(1).to_numpy(), held.value)
            yield pa.RecordBatch.from_arrays([pa.array([TaskContext.get().partitionId()], pa.int32()), pa.array([out.tobytes()], pa.binary())], names=["part", "v"])

        got = labelled.mapInArrow(run, "part int, v binary").orderBy("part").collect()
        out = sum(np.frombuffer(r.v).reshape(fits, size + 1, size) for r in got)
        return out[:, 0], out[:, 1:]

    def fitted(out, x, at, y, half, w):
        for k in (0, 1, 2):
            out[k][np.ix_(np.append(0, at + 1), at)] += _slope(x[half != k], y[half != k], w[k][at])

    w = _newton(lambda w: summed(3, chain.size, fitted, w), 3, chain.size, 0.3)

    def calibrated(out, x, at, y, half, c):
        z = np.where(half == 0, x @ w[0][at], x @ w[1][at])
        out[0] += _slope(np.column_stack((z, np.ones(len(z)))), y, c[0])

    chain.w = w[2]
    chain.calibration = _newton(lambda c: summed(1, 2, calibrated, c), 1, 2, 0.05)[0]


def train(documents: DataFrame, labels: DataFrame, subjects: DataFrame, directions: DataFrame, garbled) -> tuple[Model, DataFrame] | None:
    """A model from all entries and all their labels, and the entries' terms as numbers. Subjects
    and directions are small fixed tables. None without labels."""
    rows = subjects.select("subject", "title").filter("subject is not null").dropDuplicates(["subject"]).orderBy("subject").collect()
    areas, titles = [r.subject for r in rows], [r.title for r in rows]
    names = {r.slug: r.title for r in directions.select("slug", "title").collect()}
    known = labels.filter(F.col("subject").isin(areas)).groupBy("entry_id").agg(F.sort_array(F.collect_set("subject")).alias("subjects"))
    told = _split(documents, garbled)
    of, terms = _vocabulary(told)
    entries = _numbered(told, known, terms)
    by_slug = entries.groupBy("slug", "subjects").agg(F.count("*").alias("n")).orderBy("slug", "subjects").collect()
    labelled = [(r.slug, r.subjects, r.n) for r in by_slug if r.subjects is not None]
    if not areas or not labelled:
        return None
    model = Model(areas, titles, names, labelled, of, sum(r.n for r in by_slug))
    _learn_terms(entries, model)
    _learn_chain(entries, model)
    return model, entries


def assigned(documents: DataFrame, labels: DataFrame, subjects: DataFrame, directions: DataFrame) -> DataFrame:
    """(entry_id, subject): a row for each area that at least a fifth of an entry's sentences
    are about.

    Wrongly decoded stretches count with their original text. Null and empty texts and
    texts about no area have no row, nor have areas with neither a label nor a direction of
    their name; repeated rows of ``documents`` count once; without
    labels there are no rows. Further columns are ignored.
    """
    spark: SparkSession = documents.sparkSession
    got = train(documents, labels, subjects, directions, p2_encoding.shared(spark, p2_encoding.train(documents)))
    if got is None:
        return spark.createDataFrame([], "entry_id long, subject string")
    shared, entries = spark.sparkContext.broadcast(got[0]), got[1]

    def run(batches):
        model = shared.value
        for batch in batches:
            hit = model(_flat(batch.column(4), batch.column(5)), batch.column(3).to_numpy(), batch.column(1).to_pylist())
            row, k = np.nonzero(hit)
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(row)), pa.array([model.areas[i] for i in k], pa.string())], names=["entry_id", "subject"])

    return entries.mapInArrow(run, "entry_id long, subject string")


def composition(documents: DataFrame, labels: DataFrame, subjects: DataFrame, directions: DataFrame) -> DataFrame:
    """(subject, title, entries, share): how many entries each area has, and what part of all
    entries that is; areas no entry has stand with 0."""
    got = assigned(documents, labels, subjects, directions).groupBy("subject").agg(F.count("*").alias("entries"))
    total = documents.select("entry_id").distinct().count()
    out = subjects.select("subject", "title").dropDuplicates(["subject"]).join(got, "subject", "left").fillna(0, ["entries"])
    return out.withColumn("share", F.col("entries") / F.lit(max(total, 1)))
