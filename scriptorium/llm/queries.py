"""Queries of the text-preparation operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from scriptorium.llm import p1_split, p2_encoding, p3_scan, p4_forms, p5_areas, p6_alike, p7_encode, p8_mix, p9_cut
from scriptorium.sources.tables import table


def p1_found(spark: SparkSession, folder: str) -> DataFrame:
    return p1_split.oversized(table(spark, folder, "document_pages"))


def p1_pieces(spark: SparkSession, folder: str) -> DataFrame:
    return p1_split.split_pages(table(spark, folder, "document_pages"))


def p1_rejoined(spark: SparkSession, folder: str) -> DataFrame:
    """Every split page put together from its pieces; the SQL reads the pages themselves."""
    return p1_split.rejoined(p1_split.split_pages(table(spark, folder, "document_pages"))).select("page_id", "entry_id", "page", "text")


def p1_entry_sizes(spark: SparkSession, folder: str) -> DataFrame:
    return p1_split.piece_sizes(table(spark, folder, "document_pages"), table(spark, folder, "extraction_meta"))


def p2_found(spark: SparkSession, folder: str) -> DataFrame:
    return p2_encoding.found(table(spark, folder, "extracted_documents"))


def p2_restored(spark: SparkSession, folder: str) -> DataFrame:
    return p2_encoding.garbled(table(spark, folder, "extracted_documents"))


def p2_rates(spark: SparkSession, folder: str) -> DataFrame:
    return p2_encoding.rates(table(spark, folder, "extracted_documents"), table(spark, folder, "extraction_meta"))


def p3_found(spark: SparkSession, folder: str) -> DataFrame:
    return p3_scan.found(table(spark, folder, "document_pages"))


def p3_noise(spark: SparkSession, folder: str) -> DataFrame:
    return p3_scan.noise(table(spark, folder, "document_pages"))


def p3_paragraphs(spark: SparkSession, folder: str) -> DataFrame:
    return p3_scan.paragraphs(table(spark, folder, "document_pages"))


def p4_found(spark: SparkSession, folder: str) -> DataFrame:
    return p4_forms.found(table(spark, folder, "document_pages"), table(spark, folder, "extracted_documents"))


def p4_texts(spark: SparkSession, folder: str) -> DataFrame:
    return p4_forms.consistent(table(spark, folder, "document_pages"), table(spark, folder, "extracted_documents"))


def p4_classes(spark: SparkSession, folder: str) -> DataFrame:
    return p4_forms.classes(table(spark, folder, "document_pages"), table(spark, folder, "extracted_documents"))


def _p5_tables(spark: SparkSession, folder: str) -> list[DataFrame]:
    return [table(spark, folder, t) for t in ("extracted_documents", "subject_labels", "subject_areas", "directions")]


def p5_found(spark: SparkSession, folder: str) -> DataFrame:
    return p5_areas.assigned(*_p5_tables(spark, folder))


def p5_composition(spark: SparkSession, folder: str) -> DataFrame:
    return p5_areas.composition(*_p5_tables(spark, folder))


def p6_found(spark: SparkSession, folder: str) -> DataFrame:
    return p6_alike.found(table(spark, folder, "extracted_documents"))


def p6_groups(spark: SparkSession, folder: str) -> DataFrame:
    return p6_alike.groups(table(spark, folder, "extracted_documents"))


def p7_ids(spark: SparkSession, folder: str) -> DataFrame:
    return p7_encode.encode(table(spark, folder, "documents"))


def p8_mix_rows(spark: SparkSession, folder: str) -> DataFrame:
    return p8_mix.mixed(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))[0]


def p8_blocks(spark: SparkSession, folder: str) -> DataFrame:
    return p8_mix.packed(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p8_shares(spark: SparkSession, folder: str) -> DataFrame:
    return p8_mix.shares(table(spark, folder, "documents"), table(spark, folder, "mix_targets"))


def p9_found(spark: SparkSession, folder: str) -> DataFrame:
    return p9_cut.found(table(spark, folder, "documents"))


def p9_rates(spark: SparkSession, folder: str) -> DataFrame:
    return p9_cut.rates(table(spark, folder, "documents"))


def p9_limits(spark: SparkSession, folder: str) -> DataFrame:
    return p9_cut.limits(table(spark, folder, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__.replace("_rows", ""): f for f in (p1_found, p1_pieces, p1_rejoined, p1_entry_sizes, p2_found, p2_restored, p2_rates, p3_found, p3_noise, p3_paragraphs, p4_found, p4_texts, p4_classes, p5_found, p5_composition, p6_found, p6_groups, p7_ids, p8_mix_rows, p8_blocks, p8_shares, p9_found, p9_rates, p9_limits)
}

ORACLE_SQL: dict[str, str] = {
    "p1_found": "SELECT DISTINCT page_id FROM document_pages WHERE length(text) > 2000",
    "p6_found": r"""WITH w AS (SELECT entry_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM extracted_documents WHERE text IS NOT NULL),
        s AS (SELECT DISTINCT entry_id, g FROM (SELECT entry_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w)),
        n AS (SELECT entry_id, count(*) AS n FROM s GROUP BY entry_id),
        j AS (SELECT a.entry_id AS entry_a, b.entry_id AS entry_b, count(*) AS c FROM s a JOIN s b USING (g) WHERE a.entry_id < b.entry_id GROUP BY ALL)
        SELECT entry_a, entry_b FROM j JOIN n a ON a.entry_id = entry_a JOIN n b ON b.entry_id = entry_b WHERE c >= 0.7 * (a.n + b.n - c)""",
    "p1_rejoined": "SELECT DISTINCT page_id, entry_id, CAST(page AS INTEGER) AS page, text FROM document_pages WHERE length(text) > 2000",
    "p6_groups": r"""WITH RECURSIVE w AS (SELECT entry_id, regexp_extract_all(lower(text), '[\p{L}\p{N}]+') AS w FROM extracted_documents WHERE text IS NOT NULL),
        s AS (SELECT DISTINCT entry_id, g FROM (SELECT entry_id, unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2])) AS g FROM w)),
        same AS (SELECT entry_id, min(entry_id) OVER (PARTITION BY gs) AS class, n FROM (SELECT entry_id, list(g ORDER BY g) AS gs, count(*) AS n FROM s GROUP BY entry_id)),
        one AS (SELECT s.entry_id, g FROM s JOIN same ON s.entry_id = same.class AND same.entry_id = same.class),
        j AS (SELECT a.entry_id AS a, b.entry_id AS b, count(*) AS c FROM one a JOIN one b USING (g) WHERE a.entry_id < b.entry_id GROUP BY ALL),
        l AS (SELECT a, b FROM j JOIN same x ON x.entry_id = a JOIN same y ON y.entry_id = b WHERE c >= 0.7 * (x.n + y.n - c)),
        e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
        r AS (SELECT DISTINCT a AS id, a AS other FROM e UNION SELECT r.id, e.b FROM r JOIN e ON e.a = r.other)
        SELECT entry_id, class, coalesce(links, 0) AS links, coalesce(g, class) AS "group" FROM same LEFT JOIN (SELECT a AS class, count(*) AS links FROM e GROUP BY a) USING (class)
        LEFT JOIN (SELECT id AS class, min(other) AS g FROM r GROUP BY id) USING (class)""",
    "p9_limits": r"""WITH own AS (SELECT doc_id, source, text, regexp_replace(text, '[ \t\n\x0B\f\r\x{FFFD}…]+$|(\.\.\.|\[\.\.\.\]|…)[^.…]{0,24}$', '') AS base FROM documents WHERE length(text) > 0),
        v AS (SELECT source, unnest(list_distinct([('c', length(text)), ('c', length(base)), ('b', strlen(base))])) AS v FROM own), n AS (SELECT source, count(*) AS total FROM own GROUP BY source),
        c AS (SELECT source, v[1] AS kind, v[2] AS length, count(*) AS records FROM v GROUP BY ALL)
        SELECT c.source, kind, length, records, total AS "of" FROM c JOIN n ON c.source IS NOT DISTINCT FROM n.source WHERE records >= 6 AND records >= 0.012 * total""",
}
