"""Problem 3: repair the noise that scanning leaves in pages.

Skip-gram vectors and word counts are learned from the whole corpus. A
word that is rare beside a frequent word it could be a misreading of (by edits of glyphs
that look alike) is linked to that word. Whether it is a misreading, and of which word, is
decided in context: the vector of each candidate is compared with those of the words around,
and that weighs in with how much more frequent the candidate is. Words hyphenated at a line
end are joined; lines that repeat at the top or bottom of an entry's pages, also misread, and
lines with the page's number are removed; what is left is set into paragraphs.
"""

from __future__ import annotations

import difflib
import itertools
import re
import unicodedata
from collections import Counter
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm.common import hot_keys, in_cell
from scriptorium.llm.p4_forms import Forms, Rewriter, invisible, plain_form
from scriptorium.session import durable, spread

#: How far apart words stand that are pairs, numbers in a vector, and parts of one that sums are exact to.
WINDOW, SIZE, UNIT = 4, 24, 1 << 24
#: A word is frequent if it makes up so large a part of all words and stands three times or
#: more; so there are never more than 2.5 million of them.
FREQUENT = 4e-7
#: How many times more frequent than its misreading a word must be.
RATIO = 10.0
#: By how much context can raise or lower that.
CONTEXT = 10.0
COMMON = 1e-3  # part of all words that a word of two letters has, to be linked to one letter and a digit or sign

# What scanning reads, and what stood there (misread, true letters by script).
GLYPHS = """
0 о o О O
1 л l i п т
3 з З э
4 ч Ч
5 s S б
6 б b
7 т Т
8 в В B
9 g
|/ и й
||| ш
/1 л
|1 п
|! й
|- н
ь| ы
ьг ы
ги м
гн м
[ г
¢ e с
c e
e c
с е
е с
п н ц
н и п
и н
ц п
щ ш
ш щ
! i l
+ t
$ s
ri n
ii u
rn m
li h
cl d
vv w
l i
"""

_EDITS = [(row.split()[0], true) for row in GLYPHS.strip().split("\n") for true in row.split()[1:]]
_TRIM = " \t\r«»\"“”„‘’().,;:?…—– "
_HYPHEN = re.compile(r"(?<=[^\W\d_])([-‐¬\xad])[ \t\r]*\n[ \t]*(?=[^\W\d_])")
_SPLIT = re.compile(r"([^\W\d_]+)([-‐¬\xad])[ \t\r]*\n[ \t]*([^\W\d_]+)")
_LETTER = re.compile(r"[^\W\d_]")
_DIGIT = re.compile(r"\d")
_NUMBER = re.compile(r"^[\[(\-–—•|\s]*(?:([^\W\d_]{1,8})\.?\s*)?(\d{1,4})\s*(?:[\])\-–—•|][\])\-–—•|\s]*(?:[^\W\d_]{1,4}-\d{1,4})?)?$")
_ENDS = (0, 1, -2, -1)


@lru_cache(maxsize=1)
def plain_forms() -> tuple[dict, dict]:
    """Rewriting rules for every compatibility form, invisible character and composed letter
    of Unicode: what problem 4 repairs is no noise of scanning."""
    counts: Counter = Counter()
    for code in range(0xA0, 0x20000):
        c = chr(code)
        if c in "№™" or 0xD800 <= code < 0xE000:
            continue
        if plain_form(c) != c or invisible(c) or unicodedata.category(c)[0] == "Z":
            counts[c] = 1
        elif unicodedata.category(c)[0] == "L" and len(d := unicodedata.normalize("NFD", c)) == 2 and code < 0x600:
            counts[d] = 1
    for code in itertools.chain(range(32, 127), range(0x400, 0x530)):
        counts[chr(code)] = 1000
    counts.pop("\xad")  # at a line end it is a hyphen
    forms = Forms(counts)
    return forms.rewrite, forms.twin


_AT_LINE_END = re.compile(r"[-‐¬\xad][ \t\r]*\n")


def _raw(text: str) -> list[str]:
    """What stands between white space, hyphens at line ends joined."""
    return (_HYPHEN.sub("", text) if _AT_LINE_END.search(text) else text).split()


def _plain(raw: str) -> str:
    """A word without the marks around it, '' for what holds no letter."""
    w = raw.strip(_TRIM)
    return w if w and not w.isdigit() and _LETTER.search(w) else ""


def words_of(text: str) -> list[str]:
    """Words with a letter, hyphens at line ends joined, marks around them off."""
    return [w for t in _raw(text) if (w := _plain(t))]


def _mended(word: str, depth: int = 3):
    """What a word with digits or signs in it may have been: its first such character is part
    of a misread glyph, then the next."""
    at = next((k for k, c in enumerate(word) if not (c.isalpha() or c == "-")), None)
    if at is None:
        yield word
    elif depth:
        for read, true in _EDITS:
            for begin in range(max(0, at - len(read) + 1), at + 1):
                if word.startswith(read, begin):
                    yield from _mended(word[:begin] + true + word[begin + len(read) :], depth - 1)


def _edited(word: str):
    """What a word may have been, by one edit."""
    for read, true in _EDITS:
        at = word.find(read)
        while at >= 0:
            yield word[:at] + true + word[at + len(read) :]
            at = word.find(read, at + 1)


def candidates(word: str, known) -> list[str]:
    """Words of ``known`` that ``word`` could be a misreading of: by one edit if it is all
    letters (two if it is longer and one gives none), else by one for each digit or sign in
    it and, where that gives none, one more."""

    def has(w):
        return w in known or (w[:1].isupper() and w[:1].lower() + w[1:] in known) or (w.isupper() and w.lower() in known)

    if all(c.isalpha() or c == "-" for c in word):
        once = list(_edited(word))
        out = [w for w in once if w != word and has(w)]
        if not out and len(word) > 5:
            out = [w for m in once for w in _edited(m) if w != word and has(w)]
    else:
        mended = list(dict.fromkeys(_mended(word)))
        out = [w for w in mended if has(w)] or [w for m in mended for w in _edited(m) if has(w)]
    return list(dict.fromkeys(out))


def pairs_within(ids: list[int], words: int, window: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """(pair, how often) of word numbers at most ``window`` apart; a negative one is in no pair.
    A pair of numbers a <= b is a * words + b."""
    own, keys = np.array(ids, np.int64), []
    for d in range(1, window + 1):
        x, y = own[:-d], own[d:]
        ok = (x >= 0) & (y >= 0)
        x, y = x[ok], y[ok]
        keys.append(np.minimum(x, y) * words + np.maximum(x, y))
    return np.unique(np.concatenate(keys), return_counts=True)


def added(parts: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    """Counts of pairs, those of one pair added up."""
    keys, n = (np.concatenate(x) for x in zip(*parts))
    order = np.argsort(keys, kind="stable")
    keys, n = keys[order], n[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n, first)


def times(i, j, n, often: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(rows, sums): what these pairs, in the order of ``i``, add to the product of the matrix of
    pairs with ``q``. An entry of the matrix tells how many times more often than by chance two
    words stand together, as a logarithm, 0 where they don't. Sums are whole numbers, so that the
    order of adding doesn't matter."""
    first = np.flatnonzero(np.concatenate(([True], i[1:] != i[:-1])))
    weight = np.maximum(np.log(n * (often.sum() / often[i] / often[j])), 0)
    return i[first], np.add.reduceat(np.rint(weight[:, None] * q[j] * UNIT).astype(np.int64), first)


def factors(product, words: int, size: int, rounds: int = 4, seed: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """(own, as context): the vectors whose products come nearest to the matrix of pairs, which
    are what skip-grams with negative sampling come to where every pair is seen (Levy and
    Goldberg 2014). ``product`` multiplies the matrix by a narrow one."""
    q = np.linalg.qr(np.random.default_rng(seed).standard_normal((words, min(size, words))))[0]
    for _ in range(rounds - 1):
        q = np.linalg.qr(product(q))[0]
    values, turn = np.linalg.eigh(q.T @ product(q))
    own = q @ turn * np.sqrt(np.abs(values))
    return own.astype(np.float32), (own * np.sign(values)).astype(np.float32)


def skip_gram(texts: list[list[str]], size: int = SIZE, window: int = WINDOW) -> dict[str, tuple]:
    """Skip-gram vectors of the words that stand twice in a few texts: word -> (own, as context)."""
    vocabulary = [w for w, n in Counter(w for t in texts for w in t).most_common() if n > 1]
    if len(vocabulary) < 2:
        return {}
    of = {w: k for k, w in enumerate(vocabulary)}
    keys, n = pairs_within([k for t in texts for k in (*(of[w] for w in t if w in of), *[-1] * window)], len(of), window)
    i, j = np.divmod(keys, len(of))
    i, j, n = np.concatenate((i, j)), np.concatenate((j, i)), np.concatenate((n, n))
    order = np.lexsort((j, i))
    i, j, n = i[order], j[order], n[order]
    often = np.maximum(np.bincount(i, n, len(of)), 1)

    def product(q):
        out = np.zeros((len(of), q.shape[1]))
        at, v = times(i, j, n, often, q)
        out[at] = v / UNIT
        return out

    own, around = factors(product, len(of), size)
    return {w: (own[k], around[k]) for w, k in of.items()}


class Reader:
    """Finds and corrects misread words; made from counts of frequent words and vectors."""

    def __init__(self, counts: dict[str, int], least: int, vectors: dict):
        self.counts, self.least = counts, least
        self.place = {w: k for k, w in enumerate(vectors)}
        self.own, self.context = (np.array(x) for x in zip(*vectors.values())) if vectors else (None, None)
        self.common = sum(counts.values()) * COMMON
        self.longest = max(map(len, counts), default=0)
        # what surrounds words on the whole, against which a word's surroundings are held
        weight = np.array([counts.get(w, 1) for w in vectors], np.float64)
        self.middle = np.average(self.context, axis=0, weights=weight) if vectors else None
        self.links: dict[str, list[tuple[float, str]]] = {}
        # frequent words may be misreadings of still more frequent ones
        for w in counts:
            self.link(w)
        self.fine = {w for w in counts if not self.links[w]}
        self.sound: set[str] = set()

    def _count(self, w: str) -> int:
        c = self.counts
        return max(c.get(w, 0), c.get(w[:1].lower() + w[1:], 0) if w[:1].isupper() else 0, c.get(w.lower(), 0) if w.isupper() else 0)

    def link(self, w: str) -> list[tuple[float, str]]:
        """Frequent words that ``w`` may be a misreading of, each with the evidence of the counts:
        the logarithm of how many times more frequent it is than it must be. Those that no
        context could make misreadings are left out; the most frequent stands first."""
        out = self.links.get(w)
        if out is None:
            own = max(self._count(w), self.least - 1, 1)
            noisy = any(not (c.isalpha() or c == "-") for c in w)
            need = own * (RATIO if not noisy else RATIO / 4)
            core = sum(map(str.isalpha, w))
            out = []
            if not noisy and len(w) < 4:
                need *= 100  # two or three letters are soon a word of their own
            # of two letters, one of them misread, it can only be a very frequent word
            short = noisy and len(w) == 2 and core == 1 and w.islower()
            if short:
                need = max(own * RATIO * 100, self.common)
            # with as many digits and signs as letters it is a designation; three edits add three
            # letters at most, and none can make a much longer one a known word
            if len(w) <= self.longest + 6 and (short or core * 2 > len(w) and (core >= 2 or len(w) > 2)):
                need = max(need, 3)
                fit = sorted(((self._count(v), v) for v in candidates(w, self.counts) if len(v) > 1), key=lambda x: -x[0])
                out = [(float(np.log(n / need)), v) for n, v in fit if n * (1 if short else CONTEXT) >= need]
            if len(self.links) > 600_000:
                self.links.clear()
            self.links[w] = out
        return out

    def best(self, w: str, around: list[str]) -> str | None:
        """The word that stood for ``w`` among ``around``, or None if ``w`` is no misreading: the
        candidate of the most evidence by counts and context, where that is enough."""
        some = self.link(w)
        if not some:
            return None
        near = [self.place[x] for x in around if x in self.place]
        mean = np.mean(self.context[near], axis=0) - self.middle if near else None

        def evidence(candidate):
            by_count, v = candidate
            k = self.place.get(v, self.place.get(v.lower())) if mean is not None else None
            return by_count + (float(np.clip(self.own[k] @ mean, -1, 1)) * np.log(CONTEXT) if k is not None else 0.0)

        most, v = max(((evidence(c), c[1]) for c in some), key=lambda x: x[0])
        return v if most >= 0 else None

    def misread(self, text: str) -> bool:
        """Whether a word of the text is misread where it stands; words that have no candidate are
        kept in mind."""
        sound = self.sound
        if len(sound) > 400_000:
            sound.clear()
        doubtful = set()
        for t in set(_raw(text)) - sound:
            w = _plain(t)
            if w and w not in self.fine and (some := self.link(w)):
                if some[0][0] >= np.log(CONTEXT):
                    return True  # no context could speak against it
                doubtful.add(w)
            else:
                sound.add(t)
        if not doubtful:
            return False
        plain = [t.strip(_TRIM) for t in _raw(text)]
        return any(w in doubtful and self.best(w, self._around(plain, k)) for k, w in enumerate(plain))

    @staticmethod
    def _around(words: list[str], k: int) -> list[str]:
        return words[max(0, k - 4) : k] + words[k + 1 : k + 5]

    def correct(self, text: str) -> str:
        parts = re.split(r"(\s+)", text)
        plain = [p.strip(_TRIM) for p in parts]
        for k in range(0, len(parts), 2):
            w = plain[k]
            if w and w not in self.fine and _LETTER.search(w):
                right = self.best(w, self._around(plain[::2], k // 2))
                if right:
                    parts[k] = parts[k].replace(w, right, 1)
        return "".join(parts)

    def joined(self, m: re.Match) -> str:
        """A word split at a line end: with its hyphen if it has one anyway, else without."""
        return m[1] + ("-" if m[2] in "-‐" and self._hyphenated(m) else "") + m[3]

    def _hyphenated(self, m: re.Match) -> bool:
        return self._count(f"{m[1]}-{m[3]}") > self._count(m[1] + m[3])

    def splits(self, text: str) -> bool:
        """Whether a word is split by a hyphen at a line end. A line that ends at the hyphen of
        a compound is only a line break."""
        return bool(_AT_LINE_END.search(text)) and any(not (m[2] in "-‐" and self._compound(text, m)) for m in _SPLIT.finditer(text))

    def _compound(self, text: str, m: re.Match) -> bool:
        # the compound may go on beyond the two parts
        a, b = m.start(), m.end()
        while a and (text[a - 1].isalpha() or text[a - 1] == "-"):
            a -= 1
        while b < len(text) and (text[b].isalpha() or text[b] == "-"):
            b += 1
        left, right = text[a : m.end(1)], text[m.start(3) : b]
        return self._count(f"{left}-{right}") > self._count(left + right)


# The glyphs above, joined to one form each for comparing lines.
_CANON_MANY = [("|/", "и"), ("/1", "л"), ("|1", "п"), ("|!", "й"), ("ь|", "ы"), ("ьг", "ы"), ("ги", "м"), ("гн", "м"), ("ri", "n"), ("ii", "u"), ("rn", "m"), ("li", "h"), ("cl", "d")]
_CANON = str.maketrans({"0": "o", "о": "o", "1": "l", "i": "l", "|": "l", "!": "l", "3": "з", "4": "ч", "5": "s", "6": "б", "b": "б", "7": "т", "t": "т", "+": "т", "8": "в", "9": "g", "[": "г", "¢": "e", "c": "e", "с": "e", "е": "e", "н": "п", "и": "п", "ц": "п", "щ": "ш"})


def canon(line: str) -> str:
    """A line without its page number, glyphs that are misread for one another made one."""
    line = re.sub(r"^\s*\d{1,4}(?:\s{2,}|\t|\s*\|\s*)|(?:\s{2,}|\t|\s*\|\s*)\d{1,4}\s*$", "", line).lower()
    for a, b in _CANON_MANY:
        line = line.replace(a, b)
    line = line.translate(_CANON)
    return "".join(c for c in line if c.isalnum())


def page_number(line: str, page: int | None) -> bool:
    """Whether a line at the top or bottom is one with the page's number."""
    m = _NUMBER.match(line)
    if not m:
        return False
    if m[1] and line.strip() == m[0].strip() and int(m[2]) > 999:
        return False
    return page is None or int(m[2]) >= page or abs(int(m[2]) - page) <= 3


def lines_at_ends(text: str) -> list[tuple[int, int, str]]:
    """(place among all lines, which end, line) of the first and last two lines with text."""
    lines = text.split("\n")
    filled = [k for k, x in enumerate(lines) if x.strip()]
    picked: dict[int, int] = {}
    for end in _ENDS:
        if len(filled) > (abs(end) if end < 0 else end + 1) or (end in (0, -1) and len(filled) > 1):
            picked.setdefault(filled[end], end)
    return [(k, end, lines[k].strip()) for k, end in sorted(picked.items())]


def _counts(pages: DataFrame) -> DataFrame:
    forms = plain_forms()

    def run(batches):
        rewriter = Rewriter(*forms)
        for batch in batches:
            raw: Counter = Counter()
            total: Counter = Counter()
            for at in range(0, batch.num_rows, 1024):
                texts = [t for t in batch.column(0).slice(at, 1024).to_pylist() if t]
                for k in rewriter.suspects(texts):
                    texts[k] = rewriter(texts[k])
                for t in texts:
                    raw.update(_raw(t))
            for t, n in raw.items():
                if w := _plain(t):
                    total[w] += n
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["word", "n"])

    return pages.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def _pairs(pages: DataFrame, words: list[str]) -> DataFrame:
    """(i, j, n): how often words i and j stand near each other in all pages, both ways, in the order of i."""
    of = pages.sparkSession.sparkContext.broadcast({w: k for k, w in enumerate(words)})
    forms, size = plain_forms(), len(words)

    def run(batches):
        rewriter, known = Rewriter(*forms), of.value

        class Numbers(dict):
            def __missing__(self, raw):
                k = self[raw] = known.get(_plain(raw), -1)
                return k

        def out(part):
            i, j = np.divmod(part[0], size)
            return pa.RecordBatch.from_arrays([pa.array(i, pa.int32()), pa.array(j, pa.int32()), pa.array(part[1], pa.int64())], names=["i", "j", "n"])

        numbers, held = Numbers(), []
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                texts = [t for t in batch.column(0).slice(at, 1024).to_pylist() if t]
                for k in rewriter.suspects(texts):
                    texts[k] = rewriter(texts[k])
                ids: list[int] = []
                for t in texts:
                    ids += [k for k in map(numbers.__getitem__, _raw(t)) if k >= 0]
                    ids += [-1] * WINDOW
                held.append(pairs_within(ids, size))
                if len(numbers) > 400_000:
                    numbers.clear()
                if sum(len(k) for k, _ in held) > 4_000_000:
                    held = [added(held)]
                    if len(held[0][0]) > 2_000_000:
                        yield out(held.pop())
        if held:
            yield out(added(held))

    once = spread(pages.select("text")).mapInArrow(run, "i int, j int, n long").groupBy("i", "j").agg(F.sum("n").alias("n"))
    ways = F.when(F.col("i") == F.col("j"), F.array(F.struct("i", "j", (F.col("n") * 2).alias("n")))).otherwise(F.array(F.struct("i", "j", "n"), F.struct(F.col("j").alias("i"), F.col("i").alias("j"), "n")))
    return durable(once.select(F.explode(ways).alias("x")).select("x.*").repartition("i").sortWithinPartitions("i", "j"), "p3-pairs")


def vectors_of(pages: DataFrame, words: list[str]) -> dict[str, tuple]:
    """Skip-gram vectors of ``words`` from all pages: pairs are counted, and the matrix of pairs
    multiplied, on the executors; to the driver come a vector for each word."""
    if len(words) < 2:
        return {}
    pairs, context = _pairs(pages, words), pages.sparkSession.sparkContext
    sums = pairs.groupBy("i").agg(F.sum("n").alias("n")).toArrow()
    often = np.ones(len(words))
    often[sums.column("i").to_numpy()] = sums.column("n").to_numpy()

    def product(q):
        shared, columns = context.broadcast((often, q)), [f"y{k}" for k in range(q.shape[1])]

        def run(batches):
            for batch in batches:
                if batch.num_rows:
                    at, v = times(*(batch.column(k).to_numpy() for k in range(3)), *shared.value)
                    yield pa.RecordBatch.from_arrays([pa.array(at), *(pa.array(np.ascontiguousarray(x)) for x in v.T)], names=["i", *columns])

        got = pairs.mapInArrow(run, ", ".join(["i int", *(f"{c} long" for c in columns)])).groupBy("i").agg(*(F.sum(c).alias(c) for c in columns)).toArrow()
        out = np.zeros(q.shape)
        out[got.column("i").to_numpy()] = np.column_stack([got.column(c).to_numpy() for c in columns]) / UNIT
        shared.unpersist()
        return out

    own, around = factors(product, len(words), SIZE)
    return {w: (own[k], around[k]) for k, w in enumerate(words)}


def learn(pages: DataFrame) -> Reader:
    """Counts of all pages' frequent words, and their skip-gram vectors from all pages.

    Only words above a share of all words, which bounds their number, come to the driver; a
    rarer word can't be what a misread word is linked to.
    """
    counts = durable(_counts(spread(pages)), "p3-words")
    total = counts.agg(F.sum("n")).first()[0] or 0
    least = max(3, int(total * FREQUENT))
    kept = {r.word: r.n for r in counts.filter(F.col("n") >= least).orderBy(F.desc("n"), "word").collect()}
    return Reader(kept, least, vectors_of(pages, list(kept)))


_LOCAL = "page_id long, entry_id long, page int, split boolean, misread boolean, numbered array<int>, ends array<struct<place:int,end:int,canon:string,title:boolean>>"


def _examined(pages: DataFrame, reader) -> DataFrame:
    """Per page what can be told from itself, and its lines that may be furniture."""
    forms = plain_forms()

    def run(batches):
        own, rewriter = reader.value, Rewriter(*forms)
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                texts, pages_ = [t or "" for t in some.column(3).to_pylist()], some.column(2).to_pylist()
                for k in rewriter.suspects(texts):
                    texts[k] = rewriter(texts[k])
                split, misread, numbered, ends = [], [], [], []
                for text, page in zip(texts, pages_):
                    split.append(own.splits(text))
                    misread.append(own.misread(text))
                    at_ends = lines_at_ends(text)
                    # a number line may be misread too
                    numbers = [k for k, end, x in at_ends if end in (0, -1) and (page_number(x, page) or (len(x) <= 24 and _DIGIT.search(x) and page_number(own.correct(x), page)))]
                    numbered.append(numbers)
                    ends.append([{"place": k, "end": end, "canon": c, "title": page == 1 and end == 0 and _title(at_ends)} for k, end, x in at_ends if k not in numbers and _may_run(x) and len(c := canon(x)) >= 4])
                kinds = (pa.bool_(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.struct([("place", pa.int32()), ("end", pa.int32()), ("canon", pa.string()), ("title", pa.bool_())])))
                yield pa.RecordBatch.from_arrays([*some.columns[:3], *(pa.array(c, k) for c, k in zip((split, misread, numbered, ends), kinds))], names=["page_id", "entry_id", "page", "split", "misread", "numbered", "ends"])

    return spread(pages.select("page_id", "entry_id", F.col("page").cast("int").alias("page"), "text")).mapInArrow(run, _LOCAL)


def _title(at_ends: list[tuple[int, int, str]]) -> bool:
    """Whether the first line of an entry's first page is its title rather than a header: it
    has no page number, and no title follows it."""
    first = at_ends[0][2]
    second = next((x for _, end, x in at_ends if end == 1), "")
    if re.search(r"(?:\s{2,}|\t)\d{1,4}$|^\d{1,4}(?:\s{2,}|\t)", first) or canon(first) == canon(second):
        return False
    return not (re.search(r"\d", first) and len(second) <= 100 and _may_run(second))


def _may_run(line: str) -> bool:
    """Whether a line looks like a heading rather than the end or the middle of a sentence."""
    solid = line.rstrip()
    first = next((c for c in solid if c.isalpha()), "")
    if solid[-1:] in ".,;:)»”":
        return False
    return not first.islower() or bool(re.search(r"№|\d{2,}", solid)) or "_" in solid or len(solid) <= 60


def _running(examined: DataFrame) -> DataFrame:
    """(page_id, places): the lines of each page that repeat over pages of its entry.

    A line repeats if another page of the entry has the same line (in canonical glyphs) at
    its top or bottom, or one that it is much like. Counts are taken per line, and each
    distinct line is compared with all that are like it in length. Entries with very many
    distinct lines are split into cells, so that no task compares all lines of one.
    """

    def side(x):
        return F.when(x["end"] >= 0, "top").otherwise("bottom").alias("side")

    keys = ["entry_id", "side", "canon"]
    line = examined.select("page_id", "entry_id", F.explode("ends").alias("x")).select("page_id", "entry_id", side(F.col("x")), F.col("x.place").alias("place"), F.col("x.canon").alias("canon"), F.col("x.title").alias("title"))
    once = F.array_distinct(F.transform("ends", lambda x: F.struct(side(x), x["canon"].alias("canon"))))
    per = examined.select("entry_id", F.explode(once).alias("x")).select("entry_id", "x.*").groupBy(keys).agg(F.count("*").alias("pages"))
    per = durable(per, "p3-lines")
    group = ["entry_id", "side"]
    hot = hot_keys(per.groupBy(group).agg(F.count("*").alias("n")), group, per.count())
    same = per.filter("pages > 1").select(keys)
    # beginnings of sentences are alike too: without a line that repeats as it is, only short ones count
    others = per.filter("pages > 1 or length(canon) <= 56").select("entry_id", "side", F.col("canon").alias("other"), (F.col("pages") > 1).alias("repeats"))
    # lines alike in 2 m / (a + b) are at most (1 - ratio) (a + b) edits apart, and so are their lengths
    edits = F.expr("int((length(canon) + length(other)) * if(length(canon) <= 36, 0.22D, 0.1D) + 1e-6D)")
    alone = in_cell(per.filter("pages = 1"), hot, group, "canon")
    near = alone.join(in_cell(others, hot, group, None), [*group, "cell"]).filter("canon <> other and (repeats or length(canon) <= 36)").withColumn("edits", edits)
    near = near.filter("if(abs(length(canon) - length(other)) <= edits, levenshtein(canon, other, edits), -1) >= 0").select(*keys, "other")

    def run(batches):
        for batch in batches:
            keep = [difflib.SequenceMatcher(None, a, b, False).ratio() >= (0.78 if len(a) <= 36 else 0.9) for a, b in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist())]
            yield batch.filter(pa.array(keep, pa.bool_())).select(keys)

    met = same.unionByName(near.mapInArrow(run, "entry_id long, side string, canon string")).distinct()
    # a title counts where headers repeat it, but is none itself
    return line.filter(~F.col("title")).join(met, keys).groupBy("page_id").agg(F.collect_set("place").alias("places"))


def _noise(pages: DataFrame, reader) -> DataFrame:
    examined = durable(_examined(pages, reader).dropDuplicates(["page_id"]), "p3-pages")
    return examined.drop("ends").join(_running(examined), "page_id", "left")


def _reader(spark: SparkSession, pages: DataFrame):
    return spark.sparkContext.broadcast(learn(pages))


def noise(pages: DataFrame) -> DataFrame:
    """(page_id, split, misread, running, numbered): the kinds of noise of each page, once.

    split: a word is split by a hyphen at a line end; misread: a word is misread; running:
    a line repeats at the top or bottom of the entry's pages; numbered: the top or bottom
    line holds the page's number. Null and empty texts have none of them; redelivered pages
    count once; further columns are ignored.
    """
    found = _noise(pages, _reader(pages.sparkSession, pages))
    return found.select("page_id", "split", "misread", F.col("places").isNotNull().alias("running"), (F.size("numbered") > 0).alias("numbered"))


def found(pages: DataFrame) -> DataFrame:
    """page_id of each page with noise of any kind, once."""
    return noise(pages).filter("split or misread or running or numbered").select("page_id")


def reflow(lines: list[str]) -> str:
    """Lines set into paragraphs: a paragraph ends at an empty line, before a list item or a
    table row, and after a line that ends a sentence well before the line width."""
    width = sorted(len(x) for x in lines if x.strip())[-max(1, len(lines) // 4) :][:1]
    width = width[0] if width else 0
    out, own = [], []
    for x in lines:
        solid = x.strip()
        row = "\t" in x or re.match(r"\s*(?:[-•*–—]\s|\d{1,3}[.)]\s)", x) or not _LETTER.search(solid)
        if own and (not solid or row):
            out.append(" ".join(own))
            own = []
        if row and solid:
            out.append(x.rstrip())
        elif solid:
            own.append(solid)
            if solid[-1] in ".!?:" and len(solid) < 0.8 * width:
                out.append(" ".join(own))
                own = []
            elif len(own) == 1 and not out and solid[-1] not in ".!?,;:-" and len(solid) < 0.6 * width:
                out.append(solid)  # a heading
                own = []
    if own:
        out.append(" ".join(own))
    return "\n".join(out)


def paragraphs(pages: DataFrame) -> DataFrame:
    """(page_id, entry_id, page, text): each page's text as continuous paragraphs.

    Furniture lines are gone, split words joined, misread words corrected by their
    neighbours, other characters brought to their plain form. Null stays null, an empty
    text empty; redelivered pages count once.
    """
    reader = _reader(pages.sparkSession, pages)
    away = _noise(pages, reader).select("page_id", F.array_union(F.coalesce("numbered", F.array().cast("array<int>")), F.coalesce("places", F.array().cast("array<int>"))).alias("away"))
    own = pages.select("page_id", "entry_id", F.col("page").cast("int").alias("page"), "text").dropDuplicates(["page_id"]).join(away, "page_id", "left")
    forms = plain_forms()

    def run(batches):
        read, rewriter = reader.value, Rewriter(*forms)
        for batch in batches:
            out = []
            for text, away in zip(batch.column(3).to_pylist(), batch.column(4).to_pylist()):
                if text:
                    gone = set(away or ())
                    lines = [x for k, x in enumerate(rewriter(text).split("\n")) if k not in gone]
                    whole = _SPLIT.sub(read.joined, "\n".join(lines))
                    text = reflow(read.correct(whole).split("\n"))
                out.append(text)
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(out, pa.string())], names=["page_id", "entry_id", "page", "text"])

    return own.mapInArrow(run, "page_id long, entry_id long, page int, text string")
