"""Problem 2: find text that was decoded with a wrong encoding, and restore it.

A multinomial classifier over hashed byte bigrams is trained on all words of the corpus and
on the same words garbled on purpose through every encoding chain. Each word then has a
log-likelihood per chain; the stretch of a text whose words together speak most for a
chain is inverted by it, strictly: its characters must be bytes of the chain's last
encoding, those bytes must decode, and the outcome must read better than before.
"""

from __future__ import annotations

import re
from codecs import charmap_decode, charmap_encode
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import bounded_sample
from scriptorium.session import durable, spread

#: Characters of texts the table is made of, at most, if a number of texts is named.
CHARS = 24_000_000
#: A word is known if it makes up so large a part of all words that aren't ASCII and stands
#: three times or more; so there are never more than 2.5 million of them.
FREQUENT = 4e-7
#: How many times more frequent than its garbled form a word is.
RATIO = 10
BINS = 1 << 16
#: Weights of bigrams are in parts of so many, readings of words in parts of so many.
UNIT, GRAIN = 1 << 28, 10_000
#: Counts of words weigh as in a corpus of so many words that aren't ASCII, if there are more.
WORDS = 600_000
#: A character is usual if words of so large a part of all hold it (and five do), or a known word does.
USUAL = 8e-6
#: Least evidence, in nats, that a stretch is garbled.
EVIDENCE = 14.0
LOST = "�"

_SINGLE = ("cp1251", "cp1252", "latin-1", "cp866", "koi8-r", "iso8859-5", "mac_cyrillic", "cp437", "cp850")
_WRITTEN = ("cp1251", "cp866", "koi8-r", "cp1252", "iso8859-5", "mac_cyrillic")
_READ = ("cp1251", "cp1252", "cp866", "koi8-r")


def chains() -> list[tuple]:
    """Each chain as its hops (encoding written, encoding read), first hop first."""
    utf = [("utf-8", r) for r in (*_SINGLE[:5], *_SINGLE[6:])]
    out = [(hop,) for hop in utf]
    out += [(hop, again) for hop in utf[:5] for again in utf[:3] if hop[1] == again[1]]
    out += [((w, r),) for w in _WRITTEN for r in _READ if w != r] + [(("cp1251", "mac_cyrillic"),)]
    return [*out, (("cp1251", "utf-8"),)]


def _tables() -> tuple[dict, dict]:
    """For each single-byte encoding its 256 characters, and the bytes of its characters' code points.

    A byte that an encoding leaves open stands for the control character of its number,
    as readers commonly do.
    """
    there, back = {}, {}
    for name in _SINGLE:
        chars = [bytes([b]).decode(name, "replace") for b in range(256)]
        chars = [chr(b) if c == LOST else c for b, c in enumerate(chars)]
        there[name] = "".join(chars)
        back[name] = {ord(c): b for b, c in reversed(list(enumerate(chars)))}
    return there, back


_THERE, _BACK = _tables()


def garble(text: str, chain: tuple) -> str:
    """``text`` as it looks after ``chain``; characters an encoding lacks become '?'."""
    for written, read in chain:
        if written == "utf-8":
            data = text.encode("utf-8", "replace")
        else:
            data = charmap_encode(text, "replace", _BACK[written])[0]
        text = data.decode("utf-8", "replace") if read == "utf-8" else charmap_decode(data, "strict", _THERE[read])[0]
    return text


def invert(word: str, chain: tuple) -> str | None:
    """What ``word`` was before ``chain``, or None where the chain can't have made it.

    A lost byte inside stays a replacement character in the outcome.
    """
    for written, read in reversed(chain):
        if read == "utf-8":
            return None
        table = _BACK[read]
        lost = LOST in word
        try:
            data = charmap_encode(word, "strict", table | {ord(LOST): 0xFF} if lost else table)[0]
        except UnicodeEncodeError:
            return None
        if written == "utf-8":
            try:
                word = data.decode("utf-8")
            except UnicodeDecodeError:
                # the middle of a sequence may be lost, nothing else may be wrong
                if not lost:
                    return None
                word = re.sub(LOST + "+", LOST, data.decode("utf-8", "replace"))
                if word.count(LOST) * 2 > len(word):
                    return None
        else:
            there = _THERE[written]
            word = charmap_decode(data, "strict", there[:0xFF] + LOST if lost else there)[0]
    return word


def _bigrams(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Bins of all byte bigrams of " word ", and where each word's begin."""
    data = [w.encode("utf-8", "surrogatepass") for w in words]
    flat = np.frombuffer(b" %s " % b"  ".join(data), np.uint8).astype(np.uint32)
    ends = np.cumsum(np.fromiter(map(len, data), np.int64, len(data)) + 2)
    pairs = flat[:-1] * 256 + flat[1:]
    keep = np.ones(len(pairs), bool)
    keep[ends[:-1] - 1] = False
    begins = np.concatenate(([0], ends[:-1] - np.arange(1, len(ends))))
    return (pairs[keep] * np.uint32(2654435761)) >> np.uint32(16), begins


#: Bigrams of two ASCII bytes are the same after every chain: they say nothing.
_ASCII = ((np.arange(128)[:, None] * 256 + np.arange(128)).ravel().astype(np.uint32) * np.uint32(2654435761)) >> np.uint32(16)
_CYRILLIC = re.compile("[\u0400-\u052f]")


_UTF = [c for c in chains() if c[0][0] == "utf-8"]
#: Per encoding the characters of the bytes that begin a sequence of UTF-8, and that continue one.
_SEQUENCE = {name: (set(there[0xC2:0xF5]), set(there[0x80:0xC0])) for name, there in _THERE.items()}


@lru_cache(maxsize=1 << 16)
def decodable(word: str) -> tuple | None:
    """The chain from UTF-8 by which all of ``word`` decodes strictly into fewer characters.
    Rightly decoded words are no valid UTF-8 in another encoding, but by rare chance."""
    if LOST in word:
        return None
    at = next((k for k, c in enumerate(word) if c >= "\x80"), len(word))
    pair = word[at : at + 2]
    if len(pair) < 2:
        return None
    for chain in _UTF:
        # a sequence of UTF-8 begins with a leading byte and goes on with a continuing one
        leads, goes_on = _SEQUENCE[chain[-1][1]]
        back = invert(word, chain) if pair[0] in leads and pair[1] in goes_on else None
        if back is not None and len(back) < len(word) and not any("\x80" <= c <= "\x9f" for c in back):
            return chain
    return None


_MARKS = ".,;:!?()[]«»\"'"


def usable(word: str) -> bool:
    """Whether the classifier may learn from ``word``."""
    return not word.isascii() and LOST not in word and not decodable(word)


def weighed(words: list[str], counts: list[int], share: float = 1.0) -> np.ndarray:
    """Weights of byte bigrams in bins, a row for each column of ``Model.table``. They are whole
    numbers, so that sums over parts of the corpus are the same in any order.

    Counts are multiplied by ``share`` first. A frequent word weighs the root of that; a rare one
    weighs no more than that, since the more texts there are, the more of the distinct words are
    garbled ones that stand once.
    """
    out = np.zeros((len(chains()) + 2, BINS))

    def add(k, some, weight):
        if some:
            bins, begins = _bigrams(some)
            out[k] += np.bincount(bins, np.repeat(weight, np.diff(np.append(begins, len(bins)))), BINS)

    own = np.array(counts, np.float64) * share
    weight = np.rint(own / np.sqrt(own + 1) * UNIT)
    for k, has in enumerate((True, False)):
        of = [i for i, w in enumerate(words) if bool(_CYRILLIC.search(w)) == has]
        # headings in capitals are right too, but rarer than their words
        right = [words[i] for i in of]
        cased = [w.upper() for w in right] + [w.capitalize() for w in right]
        rarer = np.rint(weight[of] * 0.3)
        add(k, right + cased, np.concatenate((weight[of], rarer, rarer)))
    # no chain makes or loses a line break, and no word has one
    lines, weight = "\n".join(words), weight.tolist()
    for k, chain in enumerate(chains(), 2):
        made = [(g, n) for g, w, n in zip(garble(lines, chain).split("\n"), words, weight) if g != w and "?" not in g]
        add(k, [g for g, _ in made], np.array([n for _, n in made]))
    return out


class Model:
    """Log-likelihoods of hashed byte bigrams. Columns 0 and 1 are rightly decoded words, with
    and without Cyrillic letters; then comes one column for each chain."""

    def __init__(self, weights: np.ndarray, smooth: float = 0.05):
        self.chains = chains()
        self.least = 0.0
        self.known: set[str] = set()
        self.often: Counter = Counter()
        self.usual = set(map(chr, range(32, 127)))
        weights = weights / UNIT
        weights[:, _ASCII] = 0.0
        weights += smooth
        self.table = np.ascontiguousarray(np.log(weights / weights.sum(axis=1, keepdims=True)).astype(np.float32).T)
        self.table[_ASCII] = 0.0

    def believes(self, words: list[str]) -> list[bool]:
        """Whether each word is taken for rightly decoded."""
        return [not (s > 2 and self._better(w)) for w, s in zip(words, self.scores(words).tolist())]

    def learn(self, counts: dict[str, int]) -> None:
        """Take words, counted over all texts, for known, but those that are garbled or look
        like a much more frequent word that was."""
        folded: Counter = Counter()
        for w, n in counts.items():
            folded[w.lower()] += n

        def garbled(w):
            if decodable(w + "»") or decodable("«" + w):
                return True  # the mark taken off was part of a letter
            backs = [*(invert(w, c) for c in self.chains), "".join(c for c in w if c in self.usual)]
            return any(b and b != w and folded[b.strip(_MARKS).lower()] >= RATIO * counts[w] for b in backs)

        new = [w for w in counts if usable(w)]
        kept = []
        for at in range(0, len(new), 4096):
            some = new[at : at + 4096]
            kept += [w for w, ok in zip(some, self.believes(some)) if ok and not garbled(w)]
        self.known.update(v for w in kept for v in (w, w.lower(), w.upper(), w.capitalize()))
        self.usual |= {c for w in kept for c in w if self.often[c] >= 5}

    def likelihoods(self, words: list[str]) -> np.ndarray:
        """For each word: rightly decoded, then by each chain."""
        bins, begins = _bigrams(words)
        ll = np.add.reduceat(self.table[bins], begins, axis=0)
        return np.column_stack((ll[:, :2].max(axis=1), ll[:, 2:]))

    def right(self, words: list[str]) -> np.ndarray:
        bins, begins = _bigrams(words)
        return np.add.reduceat(self.table[bins, :2], begins, axis=0).max(axis=1)

    def scores(self, words: list[str]) -> np.ndarray:
        """Evidence of the best chain over a right decoding, for each word."""
        if not words:
            return np.zeros(0)
        ll = self.likelihoods(words)
        return ll[:, 1:].max(axis=1) - ll[:, 0]

    def _better(self, word: str) -> bool:
        if len(word) == 1:
            return False  # a sign alone is no evidence
        ll = self.likelihoods([word])[0]
        back = invert(word, self.chains[int(ll[1:].argmax())])
        return back is not None and float(self.right([back])[0]) > ll[0]


class Repairer:
    """Finds and restores garbled stretches of texts; keeps scores of words it has seen."""

    KEPT = 200_000

    def __init__(self, model: Model):
        self.model = model
        self.seen: dict[str, float] = {}
        self.clear: set[str] = {""}

    @classmethod
    def of(cls, model: Model) -> Repairer:
        """The model's own, which a worker keeps from one task to the next."""
        if "repairer" not in vars(model):
            model.repairer = cls(model)
        return model.repairer

    def evidence(self, words: list[str]) -> list[float]:
        seen = self.seen
        try:
            return [seen[w] for w in words]
        except KeyError:
            pass
        if len(seen) > self.KEPT:
            seen.clear()
            self.clear = {""}
        new = [w for w in dict.fromkeys(words) if w not in seen]
        speaking = [w for w in new if not w.isascii()]
        seen.update(dict.fromkeys(new, 0.0))
        if speaking:
            # a word alone says little: no word is worth more than a few stretches
            known = self.model.known
            score = np.clip(self.model.scores(speaking), -12.0, 40.0).tolist()
            usual = self.model.usual
            for w, s in zip(speaking, score):
                if w in known or w.strip(_MARKS) in known:
                    s = -12.0
                elif s < EVIDENCE + 1 and (chain := decodable(w)) and usual.issuperset(invert(w, chain)):
                    s = EVIDENCE + 1
                seen[w] = s
        self.clear.update(w for w in new if seen[w] <= 0 and LOST not in w)
        return [seen[w] for w in words]

    def speaking(self, texts: list[str]) -> list[bool]:
        """Whether all words of each text that speak for a chain together are evidence enough."""
        clear = self.clear
        rest = [[w for w in _pieces(t) if w not in clear] for t in texts]
        score = iter(self.evidence([w for words in rest for w in words]))
        return [sum(s for w in words if (s := max(next(score), 6.0 * w.count(LOST))) > 0) >= EVIDENCE for words in rest]

    def restored(self, texts: list[str]) -> list[str]:
        """Each of ``texts`` as ``restore`` gives it."""
        return [self.restore(t)[0] if speaks else t for t, speaks in zip(texts, self.speaking(texts))]

    def find(self, text: str) -> list[tuple[int, int, tuple, bool]]:
        """Garbled stretches as (first word, last word + 1, chain, restorable); words are
        what stands between spaces and line breaks."""
        words = _words(text)
        score = self.evidence(words)
        if LOST in text:
            score = [max(s, 6.0 * w.count(LOST)) if LOST in w else s for s, w in zip(score, words)]
        if sum(s for s in score if s > 0) < EVIDENCE:
            return []
        out, todo = [], [(0, len(words))]
        while todo:
            a, b = todo.pop()
            best, x, y = _stretch(score, a, b)
            if best < EVIDENCE:
                continue
            todo += [(a, x), (y, b)]
            kind = self._judge(words[x:y])
            if kind:
                out.append((x, y, *kind))
            elif y - x > 1:  # a long stretch may hold a shorter one that is garbled
                middle = max(range(x, y), key=score.__getitem__)
                kind = self._judge(words[middle : middle + 1]) if score[middle] >= EVIDENCE else None
                if kind:
                    out.append((middle, middle + 1, *kind))
        return sorted(out)

    def _judge(self, words: list[str]) -> tuple[tuple, bool] | None:
        """The chain that made ``words``, and whether they can be restored; None if none did."""
        model = self.model
        speaking = [w for w in words if not w.isascii()]
        lost = sum(w.count(LOST) for w in speaking)
        if lost and lost * 2 >= sum(sum(not c.isascii() for c in w) for w in speaking):
            return model.chains[-1], False
        ll = model.likelihoods(speaking)
        total = ll.sum(axis=0)
        strict = Counter(c for w in speaking if (c := decodable(w)))
        likely = [model.chains[k] for k in np.argsort(-total[1:])[:4].tolist()]
        for chain in dict.fromkeys([likely[0], *(c for c, n in strict.most_common(2) if n * 2 > len(speaking)), *likely]):
            at, right = [], []
            for k, w in enumerate(speaking):
                r = invert(w, chain)
                if r is not None and r != w:
                    at.append(k)
                    right.append((w, r))
                elif (k + 1 - len(at)) * 2 >= len(speaking):
                    break  # half of the words weren't made by it
            if len(right) * 2 <= len(speaking):
                continue
            before = float(ll[at, 0].sum())
            after = float(model.right([r for _, r in right]).sum())
            size = sum(len(r) + 1 for _, r in right)
            if after > before + EVIDENCE / 2 and (after / size > model.least * 1.35 or LOST in "".join(speaking)):
                # a single letter is a word by chance, unless several characters became one
                sure = sum(
                    (r in model.known or r.strip(_MARKS) in model.known) and (sum(map(str.isalpha, r)) > 1 or len(r) < len(w)) or chain[0][0] == "utf-8" and len(r) < len(w) and model.usual.issuperset(r)
                    for w, r in right
                    if LOST not in r
                )
                if sure * (2 if len(speaking) < 4 else 6) >= len(speaking):
                    return chain, True
        return None

    def _known(self, word: str) -> bool:
        return word in self.model.known or word.strip(_MARKS) in self.model.known

    def restore(self, text: str) -> tuple[str, list[str], bool]:
        """(restored text, chains found, whether every stretch was restored); goes on until
        nothing is left that could be restored, or a text comes back."""
        found, whole, before = [], True, set()
        while text not in before:
            before.add(text)
            stretches = self.find(text)
            found += [name(c) for _, _, c, _ in stretches]
            whole = whole and all(ok for _, _, _, ok in stretches)
            if not any(ok for _, _, _, ok in stretches):
                break
            spots = [(m.start(), m.end()) for m in _WORD.finditer(text)]
            parts, at = [], 0
            for x, y, chain, ok in stretches:
                if not ok:
                    continue
                for a, b in spots[x:y]:
                    back = invert(text[a:b], chain)
                    # a right word at the edge of a stretch stays
                    if back is not None and (not self._known(text[a:b]) or self._known(back)):
                        parts += [text[at:a], back]
                        at = b
            text = "".join([*parts, text[at:]])
        return text, list(dict.fromkeys(found)), whole


_WORD = re.compile(r"[^ \n\t\r]+")


def _words(text: str) -> list[str]:
    return _WORD.findall(text)


def _pieces(text: str) -> list[str]:
    """The words of a text, with empty ones where several spaces stand together."""
    return text.replace("\n", " ").replace("\t", " ").replace("\r", " ").split(" ")


def _stretch(score: list[float], a: int, b: int) -> tuple[float, int, int]:
    """The run of greatest sum within score[a:b]."""
    best, x, y, total, begin = 0.0, a, a, 0.0, a
    for i in range(a, b):
        if total <= 0.0:
            total, begin = 0.0, i
        total += score[i]
        if total > best:
            best, x, y = total, begin, i + 1
    return best, x, y


def name(chain: tuple) -> str:
    return " ".join(f"{w}>{r}" for w, r in chain)


def _counted(texts: DataFrame, column: str) -> DataFrame:
    """(w, n): how often each word that isn't ASCII stands in all texts."""

    def run(batches):
        for batch in batches:
            counts: Counter = Counter()
            for at in range(0, batch.num_rows, 1024):
                for text in batch.column(0).slice(at, 1024).to_pylist():
                    if text:
                        counts.update(_pieces(text))
            w = [x for x in counts if not x.isascii()]
            yield pa.RecordBatch.from_arrays([pa.array(w, pa.string()), pa.array([counts[x] for x in w], pa.int64())], names=["w", "n"])

    return texts.select(column).mapInArrow(run, "w string, n long").groupBy("w").agg(F.sum("n").alias("n"))


def _of_words(words: DataFrame, run, schema: str) -> DataFrame:
    """What ``run`` makes of up to 8192 words and their counts at a time, as columns."""

    def each(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                some = batch.slice(at, 8192)
                yield pa.RecordBatch.from_arrays(run(some.column(0).to_pylist(), some.column(1).to_pylist()), names=names)

    names = [x.split()[0] for x in schema.split(", ")]
    return spread(words).mapInArrow(each, schema)


def _weights(words: DataFrame, share: float) -> np.ndarray:
    """``weighed`` of all words. Executors add up; what comes to the driver is as large as the table."""

    def run(batches):
        out = None
        for batch in batches:
            for at in range(0, batch.num_rows, 8192):
                some = batch.slice(at, 8192)
                own = weighed(some.column(0).to_pylist(), some.column(1).to_pylist(), share)
                out = own if out is None else out + own
        if out is not None:
            k, at = np.nonzero(out)
            yield pa.RecordBatch.from_arrays([pa.array(k * BINS + at, pa.int32()), pa.array(out[k, at].astype(np.int64))], names=["at", "v"])

    got = spread(words).mapInArrow(run, "at int, v long").groupBy("at").agg(F.sum("v").alias("v")).toArrow()
    if not got.num_rows:
        return weighed(["ё"], [1])
    out = np.zeros((len(chains()) + 2) * BINS)
    out[got.column("at").to_numpy()] = got.column("v").to_numpy()
    return out.reshape(-1, BINS)


def train(texts: DataFrame, column: str = "text", key: str = "entry_id", sample: int | None = None) -> Model:
    """A model of all words of all texts.

    Words are counted, weighed and judged on the executors. To the driver come the table, a
    row for each character, and the words above a share of all words, which bounds their
    number. With ``sample`` the table is that of so many texts' words, chosen by a hash of
    their key.
    """
    words = durable(_counted(spread(texts.select(column)), column), "p2-words")
    taught = words
    if sample is not None:
        some = bounded_sample(texts.select(key, F.col(column).alias("text")), key, sample, CHARS)
        taught = durable(_counted(some, "text"), "p2-sample")

    def usable_words(w, n):
        ok = [k for k, x in enumerate(w) if usable(x)]
        return [pa.array([w[k] for k in ok], pa.string()), pa.array([n[k] for k in ok], pa.int64())]

    def believed(model):
        def run(w, n):
            ok = [k for k, x in enumerate(model.value.believes(w)) if x]
            return [pa.array([w[k] for k in ok], pa.string()), pa.array([n[k] for k in ok], pa.int64())]

        return run

    spark, schema = texts.sparkSession, "w string, n long"
    totals = words.agg(F.sum("n")).first()[0] or 0
    share = 1.0 if sample is not None else min(1.0, WORDS / max(totals, 1))
    own = durable(_of_words(words, usable_words, schema), "p2-usable")
    taught = own if sample is None else durable(_of_words(taught, usable_words, schema), "p2-taught")
    # the texts hold garbled words too: leave out what the first round finds
    first = spark.sparkContext.broadcast(Model(_weights(taught, share)))
    kept = durable(_of_words(own, believed(first), schema), "p2-kept")
    model = Model(_weights(kept if sample is None else _of_words(taught, believed(first), schema), share))
    second = spark.sparkContext.broadcast(model)

    def reading(w, n):
        x = second.value.right(w) / np.array([len(x) + 1 for x in w]) if w else np.zeros(0)
        own = np.array(n, np.float64) * share
        return [pa.array(np.rint(x * GRAIN).astype(np.int64)), pa.array(np.rint(own / (own + 1) * UNIT).astype(np.int64))]

    model.least = _quantile(_of_words(kept, reading, "x long, n long").groupBy("x").agg(F.sum("n").alias("n")).orderBy("x").collect(), 0.02, float(model.right(["ё"])[0]) / 2)
    letters = kept.select(F.explode(F.array_distinct(F.split("w", ""))).alias("c"), "n").groupBy("c").agg(F.sum("n").alias("n"))
    model.often = Counter({r.c: r.n for r in letters.collect() if r.c})
    model.usual |= {c for c, n in model.often.items() if n >= max(5, totals * USUAL)}
    least = max(3, int(totals * FREQUENT))
    bare = words.groupBy(F.btrim("w", F.lit(_MARKS)).alias("w")).agg(F.sum("n").alias("n"))
    model.learn({r.w: r.n for r in bare.filter(F.col("n") >= least).orderBy(F.desc("n"), "w").collect()})
    return model


def _quantile(rows: list, part: float, none: float) -> float:
    """The value below which ``part`` of the counted values lies."""
    upto = np.cumsum([r.n for r in rows])
    if not rows or not upto[-1]:
        return none
    return rows[int(np.searchsorted(upto, part * upto[-1]))].x / GRAIN


def shared(spark: SparkSession, model: Model):
    """The model for all executors; its size is that of its table (65 536 bins) and known words."""
    return spark.sparkContext.broadcast(model)


def garbled(documents: DataFrame, model=None, texts: bool = True) -> DataFrame:
    """Affected rows as (entry_id, chains, restored, text): what was done to the text, and the
    original as far as it survives.

    ``restored`` is false where a stretch can't be restored; the text then keeps it. A row
    stands once for each affected row of ``documents``. Null and empty texts and texts
    without a garbled stretch have no row. With ``texts=False`` only entry_id is given, and
    nothing is restored. Further columns are ignored.
    """
    spark = documents.sparkSession
    model = model or shared(spark, train(documents))
    own = spread(documents.select("entry_id", "text"))

    def run(batches):
        repairer = Repairer(model.value)
        for batch in batches:
            out = []
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                for key, text in zip(some.column(0).to_pylist(), some.column(1).to_pylist()):
                    if text and not text.isascii():
                        if not texts:
                            if repairer.find(text):
                                out.append((key, None, None, None))
                        else:
                            fixed, found, whole = repairer.restore(text)
                            if found:
                                out.append((key, found, whole, fixed))
            columns = list(zip(*out)) if out else [[]] * 4
            if texts:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.list_(pa.string()), pa.bool_(), pa.string()))], ["entry_id", "chains", "restored", "text"])
            else:
                yield pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int64())], ["entry_id"])

    return own.mapInArrow(run, "entry_id long, chains array<string>, restored boolean, text string" if texts else "entry_id long")


def found(documents: DataFrame, model=None) -> DataFrame:
    """entry_id of each entry with a garbled stretch, once."""
    return garbled(documents, model, texts=False).distinct()


def rates(documents: DataFrame, meta: DataFrame) -> DataFrame:
    """(extractor, entries, garbled, rate): how often each extractor's texts are affected,
    by the latest extraction of each entry; entries without meta count under null."""
    hits = found(documents).withColumn("hit", F.lit(1))
    extractor = meta.groupBy("entry_id").agg(F.max(F.struct("extracted_at", "extractor")).getField("extractor").alias("extractor"))
    joined = documents.select("entry_id").distinct().join(extractor, "entry_id", "left").join(hits, "entry_id", "left")
    out = joined.groupBy("extractor").agg(F.count("*").alias("entries"), F.count("hit").alias("garbled"))
    return out.withColumn("rate", F.col("garbled") / F.col("entries"))
