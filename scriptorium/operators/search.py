"""Lexical search: scoring, ranking, filters after the limit, and enrichment of hits."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import catalog as C
from scriptorium.functions import paths as P
from scriptorium.functions import text as T
from scriptorium.session import spread

HITS = "slug string, path string, name string, snippet string, score double"
PENALTY = 0.85


def _ranked(hits: DataFrame, limit: int | None) -> DataFrame:
    # ties of equal names are broken by path, so that a limit is the same every time
    return hits if limit is None else hits.orderBy(F.desc("score"), F.collate("name", "ru"), "path", "slug").limit(limit)


def text_hits(documents: DataFrame, query: str) -> DataFrame:
    """Hits among texts. The file name can make a document match, but only its text scores."""
    asked = T.query_terms(query)
    own = spread(documents.filter(F.col("text").isNotNull()).select("slug", "path", "text")).withColumn("name", P.base_name(F.col("path")))
    # each text is normalised once; the generator keeps the filter from being computed a second time below it
    facts = T.let(T.normalized(F.col("text")), lambda t: F.struct(T.occurrences(t, asked).alias("n"), T.first_hit(t, asked).alias("at")))
    own = own.withColumn("facts", F.explode(F.array(facts)))
    # no term holds a space, so a match lies in the text or in the name
    hit = (F.col("facts.n") > 0) | T.matches(F.lit(""), F.col("name"), asked)
    return own.filter(hit).select("slug", "path", "name", T.snippet(F.col("text"), F.col("facts.at"), F.col("name")).alias("snippet"), (2 + F.col("facts.n")).cast("double").alias("score"))


def name_hits(files: DataFrame, query: str) -> DataFrame:
    """Hits among file names that hold the whole query."""
    name = P.base_name(F.col("path"))
    own = files.filter(P.allowed(name) & F.contains(F.lower(name), F.lit(query.strip().lower())))
    return own.select("slug", "path", name.alias("name"), F.concat(F.lit("Файл: "), name).alias("snippet"), F.lit(1.0).alias("score"))


def search(documents: DataFrame, files: DataFrame, query: str, limit: int | None = 12, slug: str | None = None) -> DataFrame:
    """(slug, path, name, snippet, score): the best hits for a query, texts and names.

    A file can be hit twice, by its text and by its name. A blank query has no hits; a query
    without a term (all words short or usual) matches every text with score 2. Empty texts
    match by their name only; null texts don't match. ``slug`` keeps to one direction, which
    prunes a table partitioned by it; extra columns are ignored.
    """
    if not query.strip():
        return documents.sparkSession.createDataFrame([], HITS)
    if slug is not None:
        documents, files = documents.filter(F.col("slug") == P.check_slug(slug)), files.filter(F.col("slug") == slug)
    return _ranked(text_hits(documents, query).unionByName(name_hits(files, query)), limit)


def routed_search(documents: DataFrame, routes: DataFrame, meta: DataFrame, query: str, limit: int | None = 12) -> DataFrame:
    """Hits among named documents only: texts trimmed and capped, partial indexes marked down.

    ``routes`` has (slug, path), ``meta`` (slug, path, index_status).
    """
    if not query.strip():
        return documents.sparkSession.createDataFrame([], HITS)
    own = documents.join(routes.select("slug", "path").distinct(), ["slug", "path"], "left_semi")
    own = own.withColumn("text", T.let(F.substring(T.trim(F.col("text")), 1, 120_000), lambda t: F.when(t != "", t)))
    hits = text_hits(own, query).join(meta.select("slug", "path", "index_status"), ["slug", "path"], "left")
    score = F.when(F.col("index_status") == "partial", F.col("score") * PENALTY).otherwise(F.col("score"))
    return _ranked(hits.select("slug", "path", "name", "snippet", score.alias("score")), limit)


def in_scope(hits: DataFrame, scope: str) -> DataFrame:
    """Hits of a folder; applied to hits that are already limited, so there may be fewer."""
    return hits.filter(P.within(F.col("path"), scope))


def in_folders(hits: DataFrame, folders: list[str]) -> DataFrame:
    return hits.filter(P.in_folders(F.col("path"), folders))


def of_types(hits: DataFrame, catalog: DataFrame, types: list[str]) -> DataFrame:
    """Hits whose catalog entry has one of the types; hits without an entry drop out."""
    if not types:
        return hits
    return hits.join(catalog.filter(F.col("doc_type").isin(types)).select("slug", "path"), ["slug", "path"], "left_semi")


def named(hits: DataFrame, wanted: list[str]) -> DataFrame:
    """Hits that any of the names or paths names."""
    out = F.lit(not wanted)
    for w in wanted:
        out = out | C.matches_path(F.col("path"), F.lit(w))
    return hits.filter(out)


def enriched(hits: DataFrame, documents: DataFrame, meta: DataFrame, chars: int = 2000) -> DataFrame:
    """Hits with the beginning of their text (the snippet where there is none) and extraction."""
    text = documents.select("slug", "path", T.let(F.substring(T.trim(F.col("text")), 1, chars), lambda t: F.when(t != "", t)).alias("text"))
    return hits.join(text, ["slug", "path"], "left").withColumn("text", F.coalesce("text", "snippet")).join(meta, ["slug", "path"], "left")


def with_fallback(hits: DataFrame, scope_files: DataFrame) -> DataFrame:
    """The hits, or all files of a scope with score 1 where there are no hits.

    Whether there are any is one row that is joined to the files; nothing is collected.
    """
    any_hit = hits.limit(1).select(F.lit(1).alias("one"))
    name = P.base_name(F.col("path"))
    rest = scope_files.select("slug", "path", name.alias("name"), F.lit("").alias("snippet"), F.lit(1.0).alias("score"), F.lit(1).alias("one"))
    return hits.unionByName(rest.join(any_hit, "one", "left_anti").drop("one"))


def many(documents: DataFrame, queries: DataFrame) -> DataFrame:
    """(query, matched, occurrences): how many texts each query of a column matches, and how
    often its terms stand in them; for many queries at once.

    Queries become distinct terms; each text is looked at once for all terms of the small
    set of queries, whose size is checked, and counts are summed per term before queries
    are joined to them.
    """
    few = queries.select("query").filter("query is not null").distinct()
    rows = few.select("query", T.terms(F.col("query")).alias("terms")).limit(1001).collect()
    if len(rows) > 1000:
        raise ValueError("at most 1000 queries at once")
    own = documents.filter(F.col("text").isNotNull()).select(T.normalized(F.concat_ws(" ", F.col("name"), F.col("text"))).alias("whole"), T.normalized(F.col("text")).alias("normal"))
    spark = documents.sparkSession
    sums = []
    for r in rows:
        hit = F.lit(not r.terms)
        for t in r.terms:
            hit = hit | F.col("whole").contains(t)
        sums.append(F.struct(F.lit(r.query).alias("query"), F.count_if(hit).alias("matched"), F.coalesce(F.sum(F.when(hit, T.occurrences(F.col("normal"), list(r.terms)))), F.lit(0)).cast("long").alias("occurrences")))
    if not sums:
        return spark.createDataFrame([], "query string, matched long, occurrences long")
    return own.agg(F.array(*sums).alias("x")).select(F.explode("x").alias("x")).select("x.*")
