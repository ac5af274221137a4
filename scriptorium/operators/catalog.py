"""The catalog of documents: inferred from names, merged with stored entries, routed by filters."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import catalog as C
from scriptorium.functions import paths as P
from scriptorium.operators.library import indexable_files

def infer(files: DataFrame, scope: str = "") -> DataFrame:
    """The catalog that the names of indexable files suggest."""
    # the type is told first, so that what follows from it doesn't try its patterns again
    typed = indexable_files(files, scope).select("slug", "path", C.doc_type(F.replace(F.col("path"), F.lit("\\"), F.lit("/"))).alias("kind"))
    own = C.inferred(F.col("path"), F.col("kind"))
    return typed.select("slug", *[own[f].alias(f) for f in C.FIELDS])


def merge(catalog: DataFrame, stored: DataFrame) -> DataFrame:
    """Catalog entries with stored ones of the same (slug, path) over them.

    Nulls, blank texts and empty lists of a stored entry count as missing.
    """
    kept = stored.select("slug", "path", F.struct(*[f for f in C.FIELDS if f != "path"]).alias("s"))
    joined = catalog.join(kept, ["slug", "path"], "left")
    own = {f: F.col(f) for f in C.FIELDS}
    out = C.merged(own, {f: F.col("path") if f == "path" else F.col(f"s.{f}") for f in C.FIELDS})
    return joined.select("slug", *[out[f].alias(f) for f in C.FIELDS])


def in_order(catalog: DataFrame) -> DataFrame:
    """By priority, then title in Russian order, then path."""
    return catalog.orderBy(F.desc("priority"), F.collate("title", "ru"), "path", "slug")


def routed(catalog: DataFrame, wanted: DataFrame) -> DataFrame:
    """(slug, path) of documents that any filter of ``wanted`` (column ``wanted``) names, once.

    A filter names a document by its path or by its name in any case. Both are joined by
    equality, so that neither side has to fit in one place.
    """
    own = catalog.select("slug", "path", F.explode(F.array_distinct(F.array(F.concat(F.lit("p:"), "path"), F.concat(F.lit("n:"), F.lower(P.base_name(F.col("path"))))))).alias("key"))
    asked = F.replace(F.col("wanted"), F.lit("\\"), F.lit("/"))
    keys = wanted.filter("wanted is not null").select(F.explode(F.array(F.concat(F.lit("p:"), asked), F.concat(F.lit("n:"), F.lower(asked)))).alias("key")).distinct()
    return own.join(keys, "key", "left_semi").select("slug", "path").distinct()


def set_type(catalog: DataFrame, slug: str, path: str, doc_type: str | None = None, title: str | None = None) -> DataFrame:
    """Catalog with type or title of one entry set; what was inferred from the old type stays."""
    if doc_type is not None and doc_type not in C.TYPES:
        raise ValueError("invalid_doc_type")
    one = (F.col("slug") == slug) & (F.col("path") == path)
    put = lambda c, v: F.when(one, F.lit(v)).otherwise(F.col(c)) if v is not None else F.col(c)
    return catalog.withColumns({"doc_type": put("doc_type", doc_type), "title": put("title", title)})


def by_alias(catalog: DataFrame, alias: str) -> DataFrame:
    return catalog.filter(C.matches_alias(F.col("aliases"), F.lit(alias)))


def ensured(stored: DataFrame, files: DataFrame) -> DataFrame:
    """Stored entries with inferred ones for the indexable files that have none."""
    own = infer(files)
    return stored.select(own.columns).unionByName(own.join(stored.select("slug", "path"), ["slug", "path"], "left_anti"))


def by_path(entries: DataFrame, order: str) -> DataFrame:
    """One entry for each path, the last one by ``order``; equal ones by their content."""
    rest = [c for c in entries.columns if c not in ("path", order)]
    return entries.groupBy("path").agg(F.max(F.struct(order, *rest)).alias("e")).select("path", *[f"e.{c}" for c in rest])
