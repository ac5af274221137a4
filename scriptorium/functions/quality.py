"""How good extracted and recognised text is, and how complete its index, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.text import SPACE, count_matches, cyrillic_letters, cyrillic_words, let, sanitized, trim

LEAST_CHARS, LEAST_CYRILLIC, PER_PAGE, SEVERAL_PAGES = 120, 20, 300, 3

_IN = SPACE[1:-1]

#: An entry of a table of contents, and a numbered heading on its own line.
CONTENTS_ENTRY = rf"""\d+(?:\.\d+)?\.{SPACE}+[A-ZА-ЯЁ][A-ZА-ЯЁa-zа-яё0-9{_IN}\-–—,/()«»"'\.]{{4,120}}?{SPACE}+\d{{1,3}}(?={SPACE}|$|\d+\.)"""
HEADING = rf"(?m)^{SPACE}*\d+(?:\.\d+)*\.?{SPACE}+[А-ЯЁA-Z][^\n]{{6,120}}$"
HEADING_START = rf"^\d+(?:\.\d+)*\.?{SPACE}+[А-ЯЁA-Z]"

# Notes of an incomplete index.
NOTE_SPARSE = "Текстовый слой PDF (часто только оглавление). Нужен полный OCR — переиндексируйте (↻)."
NOTE_LAYER = "Текстовый слой PDF — для ИИ может быть неполным. Запустите переиндексацию."
NOTE_NO_PAGES = "Нет постраничного индекса. Запустите переиндексацию."
NOTE_RERUN = " стр. Запустите переиндексацию."
NOTE_MORE = " стр. Запустите переиндексацию с большим лимитом."


def _all(c: Column, pattern: str) -> Column:
    return F.regexp_extract_all(c, F.lit(pattern), F.lit(0))


def _chars(found: Column) -> Column:
    return F.aggregate(found, F.lit(0), lambda n, x: n + F.length(x))


def facts(text: Column) -> Column:
    """What the rules below go by, each counted once: ``n`` characters, ``cyr`` Cyrillic letters,
    entries of a table of contents, numbered headings (and the characters of both), and long
    lines that are no headings. Null texts have null facts."""
    lines = F.transform(F.split(text, r"\n+"), trim)
    counted = lambda found, n, chars: (F.size(found).alias(n), _chars(found).alias(chars))
    found = F.struct(
        F.length(text).alias("n"), cyrillic_letters(text).alias("cyr"), F.instr(text, "\n").alias("breaks"), _all(text, CONTENTS_ENTRY).alias("entries"), _all(text, HEADING).alias("headings"),
        F.size(F.filter(lines, lambda x: (F.length(x) > 55) & ~x.rlike(HEADING_START))).alias("bodies"),
    )
    return F.when(text.isNotNull(), let(found, lambda f: F.struct(f["n"].alias("n"), f["cyr"].alias("cyr"), f["breaks"].alias("breaks"), f["bodies"].alias("bodies"), *counted(f["entries"], "entries", "entry_chars"), *counted(f["headings"], "headings", "heading_chars"))))


def _per_page(f: Column, pages: Column) -> Column:
    return f["n"] / F.when(pages > 0, pages).otherwise(F.lit(1))


def _heavy(f: Column, pages: Column) -> Column:
    by_entries = (f["entries"] >= 4) & (f["entry_chars"] >= 0.45 * f["n"])
    by_headings = (f["headings"] >= 5) & (f["heading_chars"] >= 0.2 * f["n"]) & (f["bodies"] < f["headings"] / 3)
    thin = (pages >= SEVERAL_PAGES) & (f["n"] < PER_PAGE * pages)
    return F.when(f["n"] < LEAST_CHARS, False).when(by_entries, True).when(f["breaks"] > 0, by_headings | thin).otherwise(thin)


# The thresholds of the three rules.


def _usable(f: Column, pages: Column) -> Column:
    n, cyr = f["n"], f["cyr"]
    return (
        F.when(n.isNull() | (n < LEAST_CHARS), False)
        .when(cyr < LEAST_CYRILLIC, False)
        .when((n >= 12_000) & (cyr >= 400), True)
        .when((n >= 6_000) & (cyr >= 200), True)
        .when((pages >= 40) & (n >= 3_000) & (cyr >= 150), True)
        .when(_per_page(f, pages) >= 250, True)
        .when((pages >= SEVERAL_PAGES) & (_per_page(f, pages) < PER_PAGE), (n >= 8_000) & (cyr >= 250))
        .when(_heavy(f, pages), n >= 10_000)
        .otherwise(True)
    )


def _wanting(f: Column, pages: Column) -> Column:
    return (
        F.when(_usable(f, pages), False)
        .when(f["n"].isNull() | (f["n"] < 800), True)
        .when(f["cyr"] < 15, True)
        .when((pages >= 5) & (_per_page(f, pages) < 80), True)
        .otherwise(_heavy(f, pages) & (f["n"] < 5_000))
    )


def _poor(f: Column, pages: Column) -> Column:
    return (
        F.when(f["n"].isNull() | (f["n"] < LEAST_CHARS), True)
        .when(f["cyr"] < LEAST_CYRILLIC, True)
        .when((pages >= SEVERAL_PAGES) & (f["n"] < PER_PAGE * pages), True)
        .otherwise(_heavy(f, pages))
    )


def contents_heavy(text: Column, pages: Column | int) -> Column:
    """Whether a text is mostly a table of contents or headings, or thin for its pages."""
    pages = F.lit(pages) if isinstance(pages, int) else pages
    return let(facts(text), lambda f: _heavy(f, pages))


def usable_layer(text: Column, pages: Column) -> Column:
    """Whether a PDF's own text can stand without recognition; the first rule that fits decides."""
    return let(facts(text), lambda f: _usable(f, pages))


def wants_recognition(text: Column, pages: Column) -> Column:
    """Whether a PDF has to be recognised as a whole."""
    return let(facts(text), lambda f: _wanting(f, pages))


def wants_fallback(text: Column, pages: Column) -> Column:
    """Whether a text is too poor to be relied on."""
    return let(facts(text), lambda f: _poor(f, pages))


def judged(text: Column, pages: Column) -> Column:
    """(usable, recognise, poor, contents): the rules above, by facts that are counted once."""
    return let(facts(text), lambda f: F.struct(_usable(f, pages).alias("usable"), _wanting(f, pages).alias("recognise"), _poor(f, pages).alias("poor"), F.coalesce(_heavy(f, pages), F.lit(False)).alias("contents")))


def extraction_score(text: Column, pages: Column) -> Column:
    """How full and useful an extracted text is; 0 for a short or missing one."""
    words = F.filter(F.split(F.replace(F.lower(text), F.lit("ё"), F.lit("е")), f"{SPACE}+"), lambda w: F.length(w) > 3)
    ratio = _chars(_all(text, CONTENTS_ENTRY)) / F.length(text)
    score = F.least(F.length(text) / F.greatest(pages, F.lit(1)), F.lit(2500)) * 0.35 + F.size(F.array_distinct(words)) * 1.8 + cyrillic_letters(text) * 0.04 - ratio * 8000
    return F.when(text.isNull() | (F.length(text) < LEAST_CHARS), F.lit(0.0)).otherwise(score)


def layer_score(text: Column, pages: Column) -> Column:
    """What a text layer is ranked by: size, Cyrillic letters, and whether it is usable."""
    return let(facts(text), lambda f: f["n"] + 3 * f["cyr"] + F.when(_usable(f, pages), 10_000).otherwise(0))


def confidence(extractor: Column, text: Column, pages: Column, failed: Column) -> Column:
    """How far an extraction is trusted: recognition .65, a usable layer .85, another .75, a layer
    kept after failed recognition .5, Word .8, legacy Word .35, plain text 1, nothing 0."""
    return (
        F.when(text.isNull(), 0.0)
        .when(extractor == "tesseract-ocr", 0.65)
        .when(extractor == "mammoth", 0.8)
        .when(extractor == "legacy-doc-fallback", 0.35)
        .when(extractor == "plain-text", 1.0)
        .when(failed, 0.5)
        .when(usable_layer(text, pages), 0.85)
        .otherwise(0.75)
    )


def photo_score(text: Column) -> Column:
    """How well a photo's text reads as Russian."""
    return let(sanitized(text), _photo_score)


def _photo_score(clean: Column) -> Column:
    letters = F.length(F.regexp_replace(clean, r"[\s\d\p{P}]", ""))
    cyr, lower = cyrillic_letters(clean), F.lower(clean)
    bonus = lambda pattern, n, of=lower: F.when(of.rlike(pattern), n).otherwise(0)
    score = (
        cyr * 3
        + count_matches(clean, "[A-Za-z]") * 0.4
        + count_matches(clean, "[0-9]") * 0.3
        + cyr / F.greatest(letters, F.lit(1)) * 120
        + bonus("вопрос", 30)
        + bonus("вариант", 30)
        + bonus("разрешается|запрещается", 25)
        + bonus("тепло|ремн|установ", 15)
        + bonus(r"№\s*[0-9]+", 15, clean)
        + F.least(cyrillic_words(clean), F.lit(12)) * 4
    )
    return F.when(F.coalesce(letters, F.lit(0)) == 0, F.lit(0.0)).otherwise(score)


def photo_judged(text: Column) -> Column:
    """(score, usable): how well a photo's text reads, and whether it can be used as a question; the
    text is cleaned and its letters are counted once."""

    def judged(clean):
        facts = F.struct(cyrillic_letters(clean).alias("cyr"), cyrillic_words(clean).alias("words"), clean.rlike("(?iu)вопрос|вариант|разрешается|запрещается").alias("quiz"), _photo_score(clean).alias("score"))
        usable = lambda f: (f["words"] >= 3) & (f["cyr"] >= 30) & (f["score"] >= 45) & (f["quiz"] | ((f["score"] >= 55) & (f["cyr"] >= 40)))
        return let(facts, lambda f: F.struct(f["score"].alias("score"), F.coalesce(usable(f), F.lit(False)).alias("usable")))

    return let(sanitized(text), judged)


def photo_usable(text: Column) -> Column:
    """Whether a photo's text can be used as a question."""
    return photo_judged(text)["usable"]


def attachment_usable(text: Column, image: Column) -> Column:
    """Whether an attachment's text says enough to be asked about."""
    t = trim(text)
    return F.when(F.coalesce(t, F.lit("")) == "", False).when(image, photo_usable(text)).otherwise((F.length(t) >= 25) & ((cyrillic_letters(t) >= 15) | (F.length(t) >= 80)))


def _info(source, indexed, status, note) -> Column:
    return F.struct(source.cast("int").alias("source_pages"), indexed.cast("int").alias("indexed_pages"), F.lit(status).alias("index_status"), note.cast("string").alias("index_note"))


def index_status(text: Column, extractor: Column, pages: Column, source_pages: Column, most: int = 150) -> Column:
    """(source_pages, indexed_pages, index_status, index_note) of a PDF just extracted.

    ``pages`` is the number of pages with text, null where there are none by page.
    """
    source, indexed = F.greatest(source_pages, F.lit(0)), F.coalesce(pages, F.lit(0))
    none = F.lit(None)
    of = F.concat(F.lit("OCR: "), indexed.cast("string"), F.lit(" из "), source.cast("string"))
    limited = F.concat(of, F.lit(f" стр. (лимит {most}). Увеличьте LIBRARY_OCR_MAX_PAGES и переиндексируйте."))
    rerun = F.concat(of, F.lit(NOTE_RERUN))
    sparse = wants_fallback(text, source) | (F.length(text) / F.greatest(source, F.lit(1)) < PER_PAGE)
    return (
        F.when(source < SEVERAL_PAGES, _info(source, F.when(indexed > 0, indexed).otherwise(F.when(F.coalesce(F.length(text), F.lit(0)) > 0, 1).otherwise(0)), "ready", none))
        .when((extractor == "tesseract-ocr") & (source > indexed), _info(source, indexed, "partial", F.when((indexed < most) & (source > most), limited).otherwise(rerun)))
        .when(extractor == "tesseract-ocr", _info(source, indexed, "ready", none))
        .when(F.coalesce(sparse, F.lit(True)), _info(source, F.lit(0), "partial", F.lit(NOTE_SPARSE)))
        .otherwise(_info(source, F.lit(0), "ready", none))
    )


def index_display(has_meta: Column, status: Column, note: Column, is_pdf: Column, extractor: Column, chars: Column, source_pages: Column, indexed_pages: Column, page_count: Column) -> Column:
    """(text_index_status, text_index_note) to show for a stored extraction, of any age.

    A stored status holds; older records without one are judged by their sizes.
    """
    show = lambda s, n: F.struct(F.lit(s).alias("text_index_status") if isinstance(s, str) else s.alias("text_index_status"), n.cast("string").alias("text_index_note"))
    none = F.lit(None)
    source, size = F.coalesce(source_pages, F.lit(0)), F.coalesce(chars, F.lit(0))
    dense = (size >= LEAST_CHARS) & ((source <= 1) | (size / F.greatest(source, F.lit(1)) >= PER_PAGE))
    indexed = F.coalesce(page_count, indexed_pages, F.lit(0))
    part = F.concat(F.lit("OCR: "), indexed.cast("string"), F.lit(" из "), source.cast("string"), F.lit(NOTE_MORE))
    return (
        F.when(~has_meta, show("none", none))
        .when(status.isin("ready", "partial"), show(status, note))
        .when(~is_pdf, show("ready", none))
        .when((F.coalesce(extractor, F.lit("")) != "tesseract-ocr") & status.isNull() & dense, show("ready", none))
        .when(F.coalesce(extractor, F.lit("")) != "tesseract-ocr", show("partial", F.lit(NOTE_LAYER)))
        .when((source > 0) & (indexed > 0) & (indexed < source), show("partial", part))
        .when(page_count.isNull() & indexed_pages.isNull(), show("partial", F.lit(NOTE_NO_PAGES)))
        .otherwise(show("ready", none))
    )
