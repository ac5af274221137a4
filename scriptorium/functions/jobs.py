"""Progress of indexing jobs, and how it is shown, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from scriptorium.functions.paths import is_image

PAGE_MS, FILE_MS, LEAST_MS = 6_000, 30_000, 30_000
MOST_PAGES, MOST_MS = 150, 900_000


def rounded(c: Column) -> Column:
    """Halves go up, also below zero."""
    return F.floor(c + 0.5)


def typical_ms(file: Column, page_total: Column, most_pages: int = MOST_PAGES, most_ms: int = MOST_MS) -> Column:
    """How long a file usually takes."""
    return F.when(page_total > 0, page_total * PAGE_MS).when(F.lower(file).endswith(".pdf"), min(most_pages * PAGE_MS, most_ms)).otherwise(FILE_MS)


def weight(file: Column, file_started: Column, estimate: Column, now: Column, page: Column, page_total: Column) -> Column:
    """How much of the current file is done, between 0 and .99."""
    elapsed = F.greatest(F.lit(0), now - file_started)
    est = F.greatest(estimate, F.lit(LEAST_MS))
    ratio = F.least(F.lit(1.0), elapsed / est)
    over = F.least(F.lit(1.0), (elapsed - est) / (est * 4))
    return (
        F.when((page_total > 0) & (page >= 0), F.least(F.lit(0.99), F.greatest(F.lit(0.01), page / page_total)))
        .when(file.isNull() | (file == "") | file_started.isNull() | (file_started == 0), 0.0)
        .when(elapsed <= 0, 0.03)
        .when(ratio < 1, 0.03 + ratio * 0.89)
        .otherwise(F.least(F.lit(0.99), 0.92 + over * 0.07))
    )


def percent(processed: Column, total: Column, phase: Column, file: Column, own: Column) -> Column:
    """Percent of a job that is done, given the weight of its current file."""
    raw = rounded(100.0 * (processed + own) / F.nullif(total, F.lit(0)))
    busy = file.isNotNull() & (file != "") & (processed < total)
    return (
        F.when(phase == "scanning", 0)
        .when(total <= 0, F.when(processed > 0, 100).otherwise(0))
        .when(busy, F.least(F.lit(99), F.greatest(F.lit(1), raw)))
        .otherwise(F.least(F.lit(100), raw))
        .cast("int")
    )


def eta_seconds(started: Column, processed: Column, total: Column, own: Column, estimate: Column, now: Column) -> Column:
    """Seconds a job still needs, null while its size is unknown."""
    done = processed + own
    by_pace = F.greatest(F.lit(0), rounded((now - started) / F.nullif(done, F.lit(0.0)) * (total - done) / 1000))
    return F.when(total <= 0, None).when(processed >= total, 0).when(done > 0, by_pace).otherwise(rounded(total * estimate / 1000)).cast("long")


def matches_scope(scope: Column, path: Column) -> Column:
    """Whether a job's scope concerns a folder, batches included."""
    top = ~scope.contains("/") | scope.contains("@batch")
    deeper = (scope == path) | scope.startswith(F.concat(path, F.lit("@batch"))) | scope.startswith(F.concat(path, F.lit("/")))
    above = ~scope.contains("@batch") & path.startswith(F.concat(scope, F.lit("/")))
    return F.when(path == "", top).otherwise(deeper | above)


def matches_view(scope: Column, file: Column, path: Column) -> Column:
    """Whether a job is of interest in a folder: by its current file if it has one."""
    by_file = (path == "") | (file == path) | file.startswith(F.concat(path, F.lit("/")))
    return F.when(file.isNotNull() & (file != ""), by_file).otherwise(matches_scope(scope, path))


def affects(status: Column, scope: Column, current: Column, file: Column) -> Column:
    """Whether an active job works on a file: as its scope or its current file, or, waiting, as
    one of a batch in the file's folder."""
    base = F.regexp_replace(scope, "@batch.*$", "")
    waiting = (status == "queued") & scope.contains("@batch") & ((file == base) | file.startswith(F.concat(base, F.lit("/"))))
    return F.coalesce(status.isin("running", "queued") & ((scope == file) | F.coalesce(current == file, F.lit(False)) | waiting), F.lit(False))


def batch_scope(folder: Column, files: Column, number: Column) -> Column:
    """The scope of a job for some files: the file itself, or a numbered batch of the folder."""
    return F.when(F.size(files) == 1, F.element_at(files, 1)).otherwise(F.concat(folder, F.lit("@batch-"), F.substring(F.lower(F.hex(F.xxhash64(number))), -8, 8)))


def action_label(file: Column) -> Column:
    f = F.lower(file)
    return (
        F.when(f.endswith(".pdf"), "PDF").when(f.endswith(".docx") | f.endswith(".doc"), "Word").when(f.endswith(".txt") | f.endswith(".md"), "Текст").when(is_image(file), "OCR фото").otherwise("Индексация")
    )


def action_hint(file: Column) -> Column:
    f = F.lower(file)
    return F.when(f.endswith(".pdf"), "Текстовый PDF индексируется за секунды. Полный OCR (↻ с force) — только для сканов без текста.").when(
        f.rlike(r"\.(docx?|txt|md)$"), "Word и текстовые файлы индексируются за секунды — OCR не нужен."
    )


def attachment_label(name: Column) -> Column:
    f = F.lower(name)
    return F.when(is_image(f), "фото").when(f.endswith(".pdf"), "PDF").when(f.endswith(".docx") | f.endswith(".doc"), "Word").when(f.endswith(".txt") | f.endswith(".md"), "текст").otherwise("файл")


def duration(seconds: Column) -> Column:
    rest = seconds % 60
    minutes = F.concat(F.floor(seconds / 60).cast("string"), F.lit(" мин"))
    return (
        F.when(seconds.isNull(), "оценка…")
        .when(seconds <= 0, "скоро")
        .when(seconds < 60, F.concat(seconds.cast("string"), F.lit(" сек")))
        .when(rest > 0, F.concat(minutes, F.lit(" "), rest.cast("string"), F.lit(" сек")))
        .otherwise(minutes)
    )


def byte_size(size: Column) -> Column:
    return F.when(size.isNull(), None).when(size < 1024, F.concat(size.cast("string"), F.lit(" B"))).when(size < 1024 * 1024, F.concat(F.format_string("%.1f", size / 1024.0), F.lit(" KB"))).otherwise(F.concat(F.format_string("%.1f", size / 1048576.0), F.lit(" MB")))


def date(at: Column) -> Column:
    return F.coalesce(F.date_format(at, "dd.MM.yyyy"), F.lit("—"))


# Hues of directions, in order.
HUES = [32, 168, 210, 278, 12, 145, 95, 48, 320, 185, 220, 55]


def hue_of_rank(rank: Column) -> Column:
    """Hue of the direction at a rank (from 0) among all slugs."""
    return F.when(rank < len(HUES), F.element_at(F.array(*map(F.lit, HUES)), rank + 1)).otherwise((rank * 137) % 360)


def hue_of_slug(slug: Column) -> Column:
    """Hue of a direction shown alone: by the sum of its characters."""
    total = F.aggregate(F.transform(F.split(slug, ""), lambda c: F.ascii(c)), F.lit(0), lambda a, x: a + x)
    return F.element_at(F.array(*map(F.lit, HUES)), total % len(HUES) + 1)


def route(slug: Column, path: Column) -> Column:
    """The address of a folder in the user interface."""
    parts = F.concat(F.array(slug), F.filter(F.split(path, "/"), lambda p: p != ""))

    def escaped(p):
        out = F.replace(F.url_encode(p), F.lit("+"), F.lit("%20"))
        # fixed values: what may stand in a part of an address as it is, besides letters and digits
        for code, c in {"%21": "!", "%27": "'", "%28": "(", "%29": ")", "%7E": "~"}.items():
            out = F.replace(out, F.lit(code), F.lit(c))
        return out

    return F.concat(F.lit("#/"), F.array_join(F.transform(parts, escaped), "/"))


def parsed_route(address: Column) -> Column:
    """(view, slug, path) of an address."""
    raw = F.regexp_replace(F.regexp_replace(address, "^#", ""), "^/", "")
    parts = F.transform(F.filter(F.split(raw, "/"), lambda p: p != ""), lambda p: F.coalesce(F.try_url_decode(F.replace(p, F.lit("+"), F.lit("%2B"))), p))
    home = F.size(parts) == 0
    return F.struct(F.when(home, "home").otherwise("direction").alias("view"), F.when(~home, F.element_at(parts, 1)).alias("slug"), F.when(~home, F.array_join(F.slice(parts, 2, 1000), "/")).alias("path"))
