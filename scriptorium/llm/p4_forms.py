"""Problem 4: bring text that looks the same to one consistent form.

Strings and code points that look alike are joined into classes by union-find:
compatibility forms with what they stand for, combining sequences with composed letters,
all spaces with the space, invisible characters with nothing, and letters of different
scripts with their twins. Transitivity puts a full-width Latin letter, its plain form and
its Cyrillic twin into one class. The form that stands for a class (in a script) is its most
frequent one over the whole corpus, where a plain letter or sign has some occurrences in
advance, and a multi-pattern automaton rewrites the others, longest first. Twins are exchanged
only inside words of more than one script.
"""

from __future__ import annotations

import re
import unicodedata
from collections import Counter
from functools import lru_cache
from itertools import takewhile

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.llm import p2_encoding
from scriptorium.session import spread

# Letters of different scripts that look the same (Latin, Cyrillic, Greek; '-' where there is none).
TWINS = """
A А Α
B В Β
C С -
E Е Ε
H Н Η
I І Ι
J Ј -
K К Κ
M М Μ
N - Ν
O О Ο
P Р Ρ
S Ѕ -
T Т Τ
X Х Χ
Y У Υ
Z - Ζ
a а α
c с -
e е -
i і ι
j ј -
k к κ
o о ο
p р ρ
s ѕ -
x х χ
y у γ
v - ν
h һ -
u - υ
ë ё -
Ë Ё -
ï ї ϊ
Ï Ї Ϊ
"""

#: Occurrences that a plain letter or sign has in advance, for small collections.
ADVANCE = 1000

_FILLERS = {0x034F, 0x115F, 0x1160, 0x17B4, 0x17B5, 0x3164, 0xFFA0, *range(0xFE00, 0xFE10)}


def invisible(c: str) -> bool:
    return unicodedata.category(c) == "Cf" or ord(c) in _FILLERS


@lru_cache(maxsize=1 << 16)
def script(c: str) -> str:
    """LATIN, CYRILLIC, GREEK or '' for anything else."""
    if not c.isalpha():
        return ""
    name = unicodedata.name(c, "").partition(" ")[0]
    return name if name in ("LATIN", "CYRILLIC", "GREEK") else ""


class Classes:
    """Union-find over strings; each string is its own class at first."""

    def __init__(self):
        self.parent: dict[str, str] = {}

    def find(self, s: str) -> str:
        root = s
        while (up := self.parent.setdefault(root, root)) != root:
            root = up
        while self.parent[s] != root:
            self.parent[s], s = root, self.parent[s]
        return root

    def join(self, a: str, b: str) -> None:
        a, b = self.find(a), self.find(b)
        if a != b:
            self.parent[max(a, b)] = min(a, b)

    def members(self) -> dict[str, list[str]]:
        out: dict[str, list[str]] = {}
        for s in sorted(self.parent):
            out.setdefault(self.find(s), []).append(s)
        return out


def plain_form(c: str) -> str:
    """What a compatibility form stands for, itself if it is none; spaces and invisible
    characters are treated elsewhere."""
    kind = unicodedata.category(c)
    if kind[0] in "ZC" or unicodedata.combining(c):
        return c
    form = unicodedata.normalize("NFKC", c)
    return form if form != c and unicodedata.decomposition(c).startswith("<") else c


class Forms:
    """The forms to rewrite, and the twins of each script, from the corpus's characters.

    ``counts`` holds how often each code point, and each letter with combining marks after it
    that make one letter with it, stands in the corpus. Nothing, which invisible characters
    look like, stands beside every character.
    """

    def __init__(self, counts: Counter):
        classes = Classes()
        for row in TWINS.split("\n"):
            twins = [c for c in row.split() if c != "-"]
            for c in twins[1:]:
                classes.join(twins[0], c)
        for s in sorted(counts):
            if len(s) > 1:
                if not s[0].isalpha():
                    continue
                composed = unicodedata.normalize("NFC", s)
                if len(composed) == 1:
                    classes.join(s, composed)
            elif s.isascii():
                continue
            elif unicodedata.category(s)[0] == "Z":
                classes.join(s, " ")
            elif invisible(s):
                classes.join(s, "")
            elif (form := plain_form(s)) != s:
                classes.join(s, form)
        self.rewrite: dict[str, str] = {}
        self.twin: dict[tuple[str, str], str] = {}
        everywhere = sum(n for s, n in counts.items() if len(s) == 1)

        def size(s: str) -> int:
            if not s:
                return everywhere + ADVANCE
            plain = len(s) == 1 and plain_form(s) == s and (s.isascii() or s.isalpha())
            return (counts[s] if len(s) == 1 or s in counts else min(counts[c] for c in s)) + ADVANCE * plain

        for group in classes.members().values():
            by_script: dict[str, list[str]] = {}
            for s in group:
                kinds = {script(c) for c in (plain_form(s) if len(s) == 1 else s) if script(c)}
                by_script.setdefault("".join(sorted(kinds)), []).append(s)
            for kind, same in by_script.items():
                best = max(same, key=lambda s: (size(s), -len(s), s))
                for s in same:
                    # letters that stand for themselves in their script stay; so does plain ASCII
                    if s != best and s in counts and not s.isascii() and (len(s) > 1 or plain_form(s) != s or unicodedata.category(s)[0] in "ZC" or invisible(s)):
                        self.rewrite[s] = best
                if kind in ("LATIN", "CYRILLIC", "GREEK") and len(best) == 1:
                    for s in group:
                        if len(s) == 1 and script(s) not in ("", kind):
                            self.twin[s, kind] = best

    def rewriter(self) -> Rewriter:
        return Rewriter(self.rewrite, self.twin)


_LETTERS = re.compile(r"[^\W\d_]+")


@lru_cache(maxsize=1 << 16)
def _mixed(word: str) -> bool:
    """Whether a word has letters of more than one script."""
    return len({script(c) for c in word} - {""}) > 1


class Rewriter:
    """Rewrites texts; made once per task from plain dictionaries."""

    def __init__(self, rewrite: dict, twin: dict):
        import ahocorasick

        self.rewrite, self.twin = rewrite, twin
        self.automaton = ahocorasick.Automaton()
        for s in rewrite:
            self.automaton.add_word(s, s)
        self.automaton.make_automaton()
        self.longest = max(map(len, rewrite), default=0)
        # what a glance at a text's code points tells: 1-3 a letter's script, 4 and up the end of a form
        self.kinds = np.zeros(0x110000, np.uint8)
        for low, high in ((0x41, 0x530), (0x1E00, 0x2000)):
            for c in range(low, high):
                self.kinds[c] = ("", "LATIN", "CYRILLIC", "GREEK").index(script(chr(c)))
        for s in rewrite:
            self.kinds[ord(s[-1])] = 4

    def suspects(self, texts: list[str]) -> list[int]:
        """Places of the texts that hold the end of a form, or letters of two scripts side by side."""
        ends = np.cumsum([len(t) + 1 for t in texts])
        k = self.kinds[np.frombuffer("\n".join([*texts, ""]).encode("utf-32-le", "surrogatepass"), np.uint32)]
        hit = k == 4
        hit[1:] |= (k[1:] != k[:-1]) & (k[1:] > 0) & (k[:-1] > 0)
        return np.unique(np.searchsorted(ends, np.flatnonzero(hit), side="right")).tolist()

    def forms(self, text: str) -> str:
        """``text`` with every form replaced by the one that stands for its class."""
        if not self.rewrite:
            return text
        # a form lies within the characters before its end, so only these go through the automaton
        near: list[list[int]] = []
        for k in np.flatnonzero(self.kinds[np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)] == 4).tolist():
            begin = max(0, k + 1 - self.longest)
            if near and begin <= near[-1][1]:
                near[-1][1] = k + 1
            else:
                near.append([begin, k + 1])
        parts, at = [], 0
        for a, b in near:
            for end, s in self.automaton.iter_long(text[a:b]):
                parts += [text[at : a + end - len(s) + 1], self.rewrite[s]]
                at = a + end + 1
        return "".join([*parts, text[at:]])

    def words(self, text: str) -> str:
        """``text`` with twins exchanged in words of more than one script."""
        if not any(map(_mixed, _LETTERS.findall(text))):
            return text
        scripts = Counter(map(script, text))
        return _LETTERS.sub(lambda m: self._word(m.group(), scripts) if _mixed(m.group()) else m.group(), text)

    def foreign(self, text: str) -> bool:
        """Whether letters of two scripts stand side by side."""
        kinds = [script(c) for c in text]
        return any(a and b and a != b for a, b in zip(kinds, kinds[1:]))

    def _word(self, word: str, around: Counter) -> str:
        kinds = Counter(k for k in map(script, word) if k)
        if len(kinds) < 2:
            return word
        # letters without a twin in another script of the word tell which one is meant
        telling = Counter(script(c) for c in word if script(c) and not any((c, k) in self.twin for k in kinds))
        target = max(kinds, key=lambda k: (telling[k], kinds[k], around[k], k))
        return "".join(self.twin.get((c, target), c) if script(c) not in ("", target) else c for c in word)

    def __call__(self, text: str) -> str:
        return self.words(self.forms(text))

    def affected(self, text: str) -> bool:
        """Whether the text isn't in its consistent form, or a word keeps a foreign letter there."""
        own = self(text)
        return own != text or self.foreign(own)


def _composing(s: str) -> str:
    """The longest beginning of a letter with marks that makes one letter, '' if none does."""
    return next((s[:k] for k in range(len(s), 1, -1) if len(unicodedata.normalize("NFC", s[:k])) == 1), "")


def _counted(texts: DataFrame) -> DataFrame:
    def run(batches):
        marks = np.array([unicodedata.combining(chr(c)) > 0 for c in range(0x11000)])
        for batch in batches:
            total: Counter = Counter()
            for at in range(0, batch.num_rows, 1024):
                c = np.frombuffer("\x00".join(t for t in batch.column(0).slice(at, 1024).to_pylist() if t).encode("utf-32-le", "surrogatepass"), np.uint32)
                if not len(c):
                    continue
                few = np.bincount(c[c < 0x11000])
                total.update({chr(k): int(few[k]) for k in np.flatnonzero(few) if not 0xD800 <= k < 0xE000})
                rare, n = np.unique(c[c >= 0x11000], return_counts=True)
                total.update({chr(k): int(m) for k, m in zip(rare, n)})
                small = np.minimum(c, 0x10FFF)
                mark = marks[small]
                first = np.flatnonzero(mark[1:] & ~mark[:-1]) + 1
                # a letter and up to three marks are the most that make one letter
                padded = np.append(np.where(mark, c, 0), [0, 0])
                sequences, n = np.unique(np.column_stack((c[first - 1], padded[first], padded[first + 1], padded[first + 2])), axis=0, return_counts=True)
                for row, m in zip(sequences.tolist(), n.tolist()):
                    if composed := _composing("".join(map(chr, takewhile(bool, row)))):
                        total[composed] += m
            total.pop("\x00", None)
            yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.string()), pa.array(list(total.values()), pa.int64())], names=["s", "n"])

    return texts.mapInArrow(run, "s string, n long")


def learn(*texts: DataFrame) -> Forms:
    """Forms from all texts of the given one-column frames. What comes to the driver is one
    row per distinct code point or letter with marks, however many texts there are."""
    both = texts[0]
    for more in texts[1:]:
        both = both.unionAll(more)
    counts = _counted(both).groupBy("s").agg(F.sum("n").alias("n")).orderBy("s")
    return Forms(Counter({r.s: r.n for r in counts.collect()}))


def _mapped(df: DataFrame, forms, model, texts: bool) -> DataFrame:
    """(item_id, text) in consistent form, or the item_ids of affected texts."""

    def run(batches):
        rewriter = Rewriter(*forms.value)
        repairer = p2_encoding.Repairer(model.value) if model else None
        for batch in batches:
            for at in range(0, batch.num_rows, 1024):
                some = batch.slice(at, 1024)
                keys, whole = some.column(0).to_pylist(), [t or "" for t in some.column(1).to_pylist()]
                if texts:
                    if repairer:
                        whole = [t if t.isascii() else repairer.restore(t)[0] for t in whole]
                    for k in rewriter.suspects(whole):
                        whole[k] = rewriter(whole[k])
                    ids, out = keys, [t if t or some.column(1)[k].is_valid else None for k, t in enumerate(whole)]
                else:
                    hits = (k for k in rewriter.suspects(whole) if rewriter.affected(whole[k]))
                    ids = [keys[k] for k in hits if not (repairer and repairer.find(whole[k]))]
                columns = [pa.array(ids, pa.int64())] + ([pa.array(out, pa.string())] if texts else [])
                yield pa.RecordBatch.from_arrays(columns, names=["item_id", "text"][: len(columns)])

    return df.mapInArrow(run, "item_id long, text string" if texts else "item_id long")


def _prepared(spark: SparkSession, pages: DataFrame, documents: DataFrame):
    forms = learn(pages.select("text"), documents.select("text"))
    shared = spark.sparkContext.broadcast((forms.rewrite, forms.twin))
    return shared, p2_encoding.shared(spark, p2_encoding.train(documents))


def found(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """(origin, item_id) of each text that isn't in its consistent form, once.

    origin is 'page' or 'entry'. Wrongly decoded entries (problem 2) are left out. Null and
    empty texts, '№', '°' and words joined from two scripts by a hyphen are no case.
    """
    spark = documents.sparkSession
    forms, model = _prepared(spark, pages, documents)
    own = _mapped(spread(pages.select("page_id", "text")), forms, None, False).distinct()
    joined = _mapped(spread(documents.select("entry_id", "text")), forms, model, False).distinct()
    return own.select(F.lit("page").alias("origin"), "item_id").unionByName(joined.select(F.lit("entry").alias("origin"), "item_id"))


def consistent(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """(origin, item_id, text): every text in consistent form, null and empty ones as they are.

    Redelivered pages count once. Wrongly decoded stretches of entries are restored first,
    since their characters look like others by accident.
    """
    spark = documents.sparkSession
    forms, model = _prepared(spark, pages, documents)
    own = _mapped(spread(pages.select("page_id", "text").dropDuplicates(["page_id"])), forms, None, True)
    joined = _mapped(spread(documents.select("entry_id", "text")), forms, model, True)
    return own.select(F.lit("page").alias("origin"), "item_id", "text").unionByName(joined.select(F.lit("entry").alias("origin"), "item_id", "text"))


def classes(pages: DataFrame, documents: DataFrame) -> DataFrame:
    """(form, stands_for): each form of the corpus that is rewritten, as code points."""
    forms = learn(pages.select("text"), documents.select("text"))
    show = lambda s: " ".join(f"U+{ord(c):04X}" for c in s)
    return documents.sparkSession.createDataFrame([(show(a), show(b)) for a, b in sorted(forms.rewrite.items())], "form string, stands_for string")
