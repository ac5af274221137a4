"""Text functions as column expressions; everything stays on the JVM."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as the library's readers understand it, non-breaking and zero-width no-break space included.
SPACE = r"[\t\n\x0B\f\r    -     　﻿]"

#: The same as single characters.
SPACES = "\t\n\x0b\x0c\r \xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000\ufeff"

# Words that don't count in a query.
STOP_WORDS = [
    "какие", "какой", "какая", "какое", "сколько", "данной", "этой", "установке", "установка", "установки", "посмотри",
    "напиши", "найди", "весь", "паспорт", "необходимо", "необходим", "произвести", "производ",
]

# What a query word (its first eight letters) also asks for.
EXPANSIONS = {
    "запуск": ["пуск", "пусконалад", "монтаж", "ввод", "эксплуата", "commission"],
    "первый": ["первичн", "начальн"],
    "монтаж": ["монтаж", "пусконалад", "установк"],
    "извлечен": ["извлеч", "элемент", "мембран", "картридж"],
    "элемент": ["элемент", "мембран", "картридж", "фильтр"],
    "инструк": ["инструк", "руковод", "регламент", "раздел"],
}

#: Fixed value: characters that survive in recognised and extracted text.
KEPT = r"A-Za-zА-Яа-яЁё0-9.,:;!?\-–—«»\"'()/\\%+№§°\n\r\t "

MAX_TERMS, MAX_BOOSTED, STEM = 16, 24, 8


def let(c: Column, f) -> Column:
    """``f(c)`` with ``c`` computed once, however often ``f`` uses it."""
    return F.element_at(F.transform(F.array(c), f), 1)


def trim(c: Column) -> Column:
    """Without white space of any kind at either end."""
    return F.btrim(c, F.lit(SPACES))


def squeeze(c: Column) -> Column:
    """Runs of white space as one space, none at the ends."""
    return F.trim(F.regexp_replace(c, f"{SPACE}+", " "))


def normalized(c: Column) -> Column:
    """The form in which texts and terms are compared."""
    return F.replace(F.lower(c), F.lit("ё"), F.lit("е"))


def sanitized(c: Column) -> Column:
    """Without characters outside the kept ones."""
    return F.regexp_replace(c, f"[^{KEPT}]", "")


def page_text(c: Column) -> Column:
    """A page's text on one line: unwanted characters go first, then runs of white space."""
    return F.trim(F.regexp_replace(sanitized(c), r"[\t\n\r ]+", " "))


def extracted_text(c: Column, limit: int = 120_000) -> Column:
    """A document's text on one line, at most ``limit`` characters, null if nothing is left."""
    return F.nullif(F.substring(page_text(c), 1, limit), F.lit(""))


def photo_text(c: Column, limit: int = 12_000) -> Column:
    """Recognised text of a photo: lines squeezed, lines of one character dropped."""
    lines = F.split(F.replace(sanitized(c), F.lit("\r\n"), F.lit("\n")), "\n")
    lines = F.transform(lines, lambda x: trim(F.regexp_replace(x, r"[ \t|]+", " ")))
    kept = F.array_join(F.filter(lines, lambda x: F.length(x) > 1), "\n")
    return F.nullif(F.substring(trim(kept), 1, limit), F.lit(""))


def count_matches(c: Column, pattern: str) -> Column:
    return F.coalesce(F.regexp_count(c, F.lit(pattern)), F.lit(0))


def cyrillic_letters(c: Column) -> Column:
    return count_matches(c, "[А-Яа-яЁё]")


def cyrillic_words(c: Column, least: int = 4) -> Column:
    return count_matches(c, "[А-Яа-яЁё]{%d,}" % least)


def terms(c: Column, limit: int = MAX_TERMS) -> Column:
    """The terms a query column asks for, in order, each once."""
    words = F.regexp_extract_all(normalized(c), F.lit("[a-zа-я0-9]{3,}"), F.lit(0))
    words = F.filter(words, lambda w: ~w.isin(STOP_WORDS))
    known = F.create_map(*[F.lit(x) if isinstance(x, str) else F.array(*map(F.lit, x)) for k, v in EXPANSIONS.items() for x in (k, v)])
    of = lambda w: F.concat(F.array(F.substring(w, 1, STEM)), F.coalesce(F.try_element_at(known, F.substring(w, 1, STEM)), F.array().cast("array<string>")))
    return F.slice(F.array_distinct(F.flatten(F.transform(words, of))), 1, limit)


def query_terms(query: str) -> list[str]:
    """``terms`` of a query that is known beforehand, so that plans hold plain literals."""
    words = re.findall("[a-zа-я0-9]{3,}", query.lower().replace("ё", "е"))
    asked = [t for w in words if w not in STOP_WORDS for t in (w[:STEM], *EXPANSIONS.get(w[:STEM], ()))]
    return list(dict.fromkeys(asked))[:MAX_TERMS]


# How a query names a section (ASCII word characters only; what each adds).
_SECTIONS = (
    (r"раздел[A-Za-z0-9_]*[^0-9]{0,24}([0-9]+(?:\.[0-9]+)*)", ("{0}", "{0}.", "{0} ", "раздел {0}", "§ {0}")),
    (r"(?:глав[A-Za-z0-9_]*|пункт|§|п\.?\s*)\s*([0-9]+(?:\.[0-9]+)*)", ("{0}", "{0}.", "{0} ")),
    (r"(?<![A-Za-z0-9_])([0-9]{1,2})\s*(?:раздел|глав)", ("{0}", "{0}.")),
)


def section_terms(query: str) -> list[str]:
    """Ways to write the section numbers that a query names."""
    out = [form.format(n) for pattern, forms in _SECTIONS for n in re.findall(pattern, query, re.I) for form in forms]
    return list(dict.fromkeys(out))


def _written(forms: tuple):
    parts = [form.split("{0}") for form in forms]
    return lambda n: F.array(*[F.concat(F.lit(a), n, F.lit(b)) for a, b in parts])


def section_terms_column(c: Column) -> Column:
    """``section_terms`` of a column."""
    found = []
    for pattern, forms in _SECTIONS:
        numbers = F.regexp_extract_all(c, F.lit("(?iu)" + pattern), F.lit(1))
        found.append(F.flatten(F.transform(numbers, _written(forms))))
    return F.array_distinct(F.concat(*found))


def boosted_terms(query: str, boost: list[str]) -> list[str]:
    """A query's terms with those of boost phrases; a phrase is cut to terms like a query."""
    base = query_terms(query)
    if not boost:
        return base
    return list(dict.fromkeys([*base, *(t for b in boost for t in query_terms(b))]))[:MAX_BOOSTED]


def occurrences(normal: Column, asked: list[str]) -> Column:
    """How often the terms stand in a normalised text, each without overlapping itself."""
    n = F.lit(0)
    for t in asked:
        n = n + ((F.length(normal) - F.length(F.replace(normal, F.lit(t), F.lit("")))) / len(t)).cast("int")
    return n


def first_hit(normal: Column, asked: list[str]) -> Column:
    """Offset (from 0) of the first term in a normalised text, 0 if there is none."""
    at = [F.nullif(F.instr(normal, t), F.lit(0)) for t in asked]
    if not at:
        return F.lit(0)
    return F.coalesce(F.least(*at) if len(at) > 1 else at[0], F.lit(1)) - 1


def snippet(text: Column, at: Column, name: Column, size: int = 220) -> Column:
    """The text around a hit on one line, or a note with the file's name."""
    cut = squeeze(F.substring(text, at + 1, F.lit(size)))
    return F.coalesce(F.nullif(cut, F.lit("")), F.concat(F.lit("Файл: "), name))


def matches(text: Column, name: Column, asked: list[str]) -> Column:
    """Whether any term stands in the name or text; with no terms everything matches."""
    if not asked:
        return F.lit(True)
    whole = normalized(F.concat_ws(" ", F.coalesce(name, F.lit("")), F.coalesce(text, F.lit(""))))
    out = F.lit(False)
    for t in asked:
        out = out | whole.contains(t)
    return out


def latin_runs(c: Column, least: int = 12) -> Column:
    """Readable runs of a legacy document's bytes, read as Latin-1, joined by spaces."""
    text = F.decode(c, "ISO-8859-1")
    return F.nullif(F.array_join(F.regexp_extract_all(text, F.lit("[ -~А-Яа-яЁё]{%d,}" % least), F.lit(0)), " "), F.lit(""))


def escape_html(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;"))


def truncated(c: Column, limit: int = 4000) -> Column:
    """Trimmed, with an ellipsis where it is longer than ``limit``."""
    t = trim(c)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit - 1), F.lit("…")))


def clipped(c: Column, limit: int = 280) -> Column:
    """On one line, with an ellipsis where it is longer than ``limit``."""
    t = squeeze(c)
    return F.when(F.length(t) <= limit, t).otherwise(F.concat(F.substring(t, 1, limit - 1), F.lit("…")))


def highlighted(text: Column, query: Column) -> Column:
    """(before, hit, after) around the first place of a query of two letters or more."""
    q = trim(query)
    at = F.when(F.length(q) >= 2, F.call_function("instr", F.lower(text), F.lower(q))).otherwise(F.lit(0))
    hit = at > 0
    return F.struct(
        F.when(hit, F.substring(text, F.lit(1), at - 1)).otherwise(text).alias("before"),
        F.when(hit, F.substring(text, at, F.length(q))).alias("hit"),
        F.when(hit, F.substring(text, at + F.length(q), F.length(text))).alias("after"),
    )
