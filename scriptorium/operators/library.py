"""Directions, files and folders: listing, trees, and changes as DataFrame transformations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from scriptorium.functions import paths as P
from scriptorium.functions.text import trim
from scriptorium.session import durable


def ru(column: str):
    """Sort key of Russian titles and names."""
    return F.collate(F.col(column), "ru")


def current_files(files: DataFrame) -> DataFrame:
    """The state of each file that holds: the latest ``modified_at`` of its (slug, path).

    Redeliveries collapse and older states drop out, in any order of arrival; a null time
    is the oldest, and of equal times the greatest remaining columns hold. Rows without
    slug or path are kept as a key of their own.
    """
    rest = [c for c in ("name", "kind", "size", "content_type", "has_text", "text_index_status", "text_index_note") if c in files.columns]
    newest = files.groupBy("slug", "path").agg(F.max(F.struct("modified_at", *rest)).alias("f"))
    return newest.select("slug", "path", "f.*")


def with_place(rows: DataFrame, *order, keys: tuple = ()) -> DataFrame:
    """Rows with their ``place`` (from 1) in an order, within each key if there are any.

    Rows are split into ranges of the order, which are numbered by themselves; how many stand
    in the ranges before is a sum over one row for each range and key. So neither all rows nor
    those of one key are in one task.
    """
    spark = rows.sparkSession
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = durable(rows.repartitionByRange(parts, *keys, *order).withColumn("part", F.spark_partition_id()), "places")
    # no row is lost where a key is null: nulls are one key
    own = [F.coalesce(F.col(k).cast("string"), F.lit("\x00")).alias(f"_{k}") for k in keys]
    ranged = ranged.select("*", *own)
    marks = [f"_{k}" for k in keys]
    before = F.sum("n").over(W.partitionBy(*marks).orderBy("part").rowsBetween(W.unboundedPreceding, -1))
    base = ranged.groupBy("part", *marks).agg(F.count("*").alias("n")).select("part", *marks, F.coalesce(before, F.lit(0)).alias("base"))
    place = F.row_number().over(W.partitionBy("part", *marks).orderBy(*order))
    return ranged.withColumn("place", place).join(base, ["part", *marks]).withColumn("place", F.col("place") + F.col("base")).drop("part", "base", *marks)


def directions(table: DataFrame) -> DataFrame:
    """(slug, title, created_at) of valid directions: a blank title is the slug, a missing time
    the epoch."""
    title = F.coalesce(F.nullif(trim(F.col("title")), F.lit("")), F.col("slug"))
    return table.filter(P.valid_slug(F.col("slug"))).select("slug", title.alias("title"), F.coalesce("created_at", F.lit("1970-01-01").cast("timestamp").cast(table.schema["created_at"].dataType)).alias("created_at"))


def folders(files: DataFrame, made: DataFrame | None = None) -> DataFrame:
    """(slug, path, parent, depth, name, files) of every folder that holds a file at any depth,
    and of those of ``made`` (slug, path), which may be empty, with the folders above them."""
    above = files.select("slug", F.explode(P.ancestors(F.col("path"))).alias("path"), F.lit(1).alias("n"))
    if made is not None:
        own = made.select("slug", F.explode(F.concat(P.ancestors(F.col("path")), F.array("path"))).alias("path"), F.lit(0).alias("n"))
        above = above.unionByName(own)
    out = above.groupBy("slug", "path").agg(F.sum("n").alias("files"))
    return out.select("slug", "path", P.parent(F.col("path")).alias("parent"), F.size(F.split("path", "/")).alias("depth"), P.base_name(F.col("path")).alias("name"), "files")


def listing(files: DataFrame, folder: str = "") -> DataFrame:
    """(slug, kind, path, name): what a folder shows, its folders and its visible files."""
    own = files.filter(P.visible(P.base_name(F.col("path"))) & ~F.col("path").rlike(r"(^|/)\."))
    here = own.filter(P.parent(F.col("path")) == folder).select("slug", F.lit("file").alias("kind"), "path", P.base_name(F.col("path")).alias("name"))
    below = folders(own).filter(F.col("parent") == folder).select("slug", F.lit("folder").alias("kind"), "path", "name")
    return below.unionByName(here)


def indexable_files(files: DataFrame, scope: str = "") -> DataFrame:
    """Files that can be indexed within a scope."""
    return files.filter(P.within(F.col("path"), scope) & P.indexable(P.base_name(F.col("path"))) & ~F.col("path").rlike(r"(^|/)\."))


def folder_view(table: DataFrame, files: DataFrame, folder: str = "") -> DataFrame:
    """One row per direction: (slug, title, path, folders, files) of a folder, each list in
    Russian order of names."""
    shown = listing(files, folder)
    rows = lambda kind: F.transform(F.sort_array(F.collect_list(F.when(F.col("kind") == kind, F.struct(ru("name").alias("k"), "name", "path")))), lambda x: F.struct(x["name"].alias("name"), x["path"].alias("path")))
    grouped = shown.groupBy("slug").agg(rows("folder").alias("folders"), rows("file").alias("files"))
    return directions(table).join(grouped, "slug", "left").select("slug", "title", F.lit(folder).alias("path"), "folders", "files")


def with_status(files: DataFrame, meta: DataFrame) -> DataFrame:
    """Files with has_text and what their latest extraction says of the index.

    ``meta`` has (slug, path, index_status, index_note); a file without it has no text.
    """
    own = meta.select("slug", "path", F.lit(True).alias("has"), "index_status", "index_note")
    joined = files.drop("has_text", "text_index_status", "text_index_note").join(own, ["slug", "path"], "left")
    return joined.select("slug", "path", F.coalesce("has", F.lit(False)).alias("has_text"), F.when(F.col("has"), F.coalesce("index_status", F.lit("ready"))).otherwise("none").alias("text_index_status"), "index_note")


def rename_folder(files: DataFrame, slug: str, old: str, name: str) -> DataFrame:
    """Files with a folder renamed. Fails where it doesn't exist or the new one does."""
    P.check_slug(slug), P.check_path(old), P.check_path(name)
    new = "/".join([*old.split("/")[:-1], name])
    own = files.filter((F.col("slug") == slug))
    if own.filter(F.col("path").startswith(old + "/")).isEmpty():
        raise LookupError("not_found")
    if not own.filter(P.within(F.col("path"), new)).isEmpty():
        raise FileExistsError("path_exists")
    return files.withColumn("path", F.when(F.col("slug") == slug, P.renamed(F.col("path"), old, new)).otherwise(F.col("path")))


def delete_folder(files: DataFrame, slug: str, folder: str, recursive: bool = False) -> DataFrame:
    """Files without a folder; it must show nothing unless ``recursive``."""
    gone = (F.col("slug") == slug) & P.within(F.col("path"), P.check_path(folder))
    if not recursive and not files.filter(gone & P.visible(P.base_name(F.col("path")))).isEmpty():
        raise ValueError("folder_not_empty")
    return files.filter(~gone)


def delete_file(files: DataFrame, slug: str, path: str) -> DataFrame:
    """Files without one and without what is kept beside it."""
    beside = F.col("path").isin(path, *(path + s for s in P.SIDECARS))
    return files.filter(~((F.col("slug") == slug) & beside))


def upsert(table: DataFrame, changes: DataFrame, keys: list[str]) -> DataFrame:
    """Rows of ``changes`` in place of those of ``table`` with the same keys, and the others."""
    return table.join(changes.select(*keys).distinct(), keys, "left_anti").unionByName(changes)


def retitle(table: DataFrame, slug: str, title: str) -> DataFrame:
    """Directions with one title changed."""
    if not title.strip():
        raise ValueError("title_required")
    if table.filter(F.col("slug") == slug).isEmpty():
        raise LookupError("not_found")
    return table.withColumn("title", F.when(F.col("slug") == slug, F.lit(title.strip())).otherwise(F.col("title")))


def create_direction(table: DataFrame, slug: str, title: str, at) -> DataFrame:
    """Directions with one made, or made anew; a blank title is the slug."""
    own = table.sparkSession.createDataFrame([(P.check_slug(slug), title.strip() or slug, at)], table.select("slug", "title", "created_at").schema)
    return upsert(table.select("slug", "title", "created_at"), own, ["slug"])


def ensure_direction(table: DataFrame, slug: str, title: str, at) -> DataFrame:
    """Directions with one made unless it is there; what is there stays as it is."""
    if not table.filter(F.col("slug") == P.check_slug(slug)).isEmpty():
        return table.select("slug", "title", "created_at")
    return create_direction(table, slug, title, at)


def delete_direction(table: DataFrame, slug: str) -> DataFrame:
    """Rows of any table (directions, files, texts) without those of a direction; there may be none."""
    return table.filter(F.col("slug").isNull() | (F.col("slug") != P.check_slug(slug)))


def direction_named(directions: DataFrame, wanted: DataFrame) -> DataFrame:
    """(wanted, slug, title) for each distinct ``wanted`` that names a direction: by its slug, else by
    its title in any case, the first of equal titles by slug. Both are joined by key."""
    asked = wanted.select(F.col("wanted")).filter("wanted is not null").distinct()
    by_slug = directions.select(F.col("slug").alias("key"), F.lit(0).alias("o"), "slug", "title")
    by_title = directions.select(F.lower("title").alias("key"), F.lit(1).alias("o"), "slug", "title")
    hit = asked.join(by_slug, asked["wanted"] == by_slug["key"]).drop("key").unionByName(asked.join(by_title, F.lower(asked["wanted"]) == by_title["key"]).drop("key"))
    return hit.groupBy("wanted").agg(F.min(F.struct("o", "slug", "title")).alias("m")).select("wanted", "m.slug", "m.title")


def make_folder(made: DataFrame, slug: str, path: str) -> DataFrame:
    """Explicit folders (slug, path) with one more; one that is there stays."""
    own = made.sparkSession.createDataFrame([(P.check_slug(slug), P.check_path(path))], "slug string, path string")
    return made.select("slug", "path").unionByName(own).distinct()


def without_sidecars(stored: DataFrame, gone: DataFrame, catalog: bool = True) -> DataFrame:
    """Stored files without what is kept beside the files of ``gone`` (slug, path); the catalog's
    records stay unless ``catalog``. Files that aren't there change nothing."""
    kinds = P.SIDECARS if catalog else P.SIDECARS[:3]
    names = gone.select("slug", F.explode(F.array(*[F.concat("path", F.lit(k)) for k in kinds])).alias("path"))
    return stored.join(names.distinct(), ["slug", "path"], "left_anti")


def uploaded(sent: DataFrame) -> DataFrame:
    """(slug, path, name, size, modified_at, kind, content_type, has_text, text_index_status,
    text_index_note) of files sent (slug, folder, filename, size, modified_at).

    Names are made safe; the content type is that of the name as it was sent. Files whose name
    isn't allowed or whose folder isn't valid are left out, see ``refused``. Of files that come
    out under one path the last holds.
    """
    folder = F.replace(trim(F.col("folder")), F.lit("\\"), F.lit("/"))
    own = sent.withColumn("folder", folder).withColumn("name", P.safe_name(F.col("filename"))).filter(P.valid_slug(F.col("slug")) & P.valid_path(F.col("folder")) & F.col("name").isNotNull())
    path = F.when(F.col("folder") == "", F.col("name")).otherwise(F.concat("folder", F.lit("/"), "name"))
    newest = own.withColumn("path", path).groupBy("slug", "path").agg(F.max(F.struct("modified_at", "size", "filename", "name")).alias("f"))
    return newest.select("slug", "path", "f.name", F.col("f.size").alias("size"), "f.modified_at", F.lit("file").alias("kind"), P.content_type(F.col("f.filename")).alias("content_type"), F.lit(False).alias("has_text"), F.lit("none").alias("text_index_status"), F.lit(None).cast("string").alias("text_index_note"))


def refused(sent: DataFrame, max_mb: int = 200, max_files: int = 20) -> DataFrame:
    """(request, error) of the requests of files sent (request, slug, filename, size, field) that
    can't be taken: an image and a document at once, too many or too large files, or a name
    that isn't allowed. ``field`` is 'image' or 'document', or null."""
    size, name = F.col("size"), P.safe_name(F.col("filename"))
    facts = sent.groupBy("request").agg(
        F.count("*").alias("n"), F.max(size).alias("most"), F.count_if(name.isNull()).alias("odd"), (F.max(F.coalesce(F.col("field") == "image", F.lit(False))) & F.max(F.coalesce(F.col("field") == "document", F.lit(False)))).alias("both")
    )
    error = F.when(F.col("both"), "image_and_document").when(F.col("n") > max_files, "too_many_files").when(F.col("most") > max_mb << 20, "file_too_large").when(F.col("odd") > 0, "invalid_filename")
    return facts.select("request", error.alias("error")).filter("error is not null")


def reindexed(texts: DataFrame, results: DataFrame) -> DataFrame:
    """Stored texts (slug, path, ...) after reindexing: rows of all files that were read are
    replaced, those that gave no text are gone. Both have the same columns."""
    kept = texts.join(results.select("slug", "path").distinct(), ["slug", "path"], "left_anti")
    return kept.unionByName(results.select(texts.columns).filter(F.length("text") > 0))


def reindex_results(results: DataFrame) -> DataFrame:
    """(slug, path, ok, extractor, chars, error) of files that were read again; a file is fine if
    it gave a text, and an error of its own is told before ``extract_no_text``."""
    chars = F.coalesce(F.length("text"), F.lit(0))
    return results.select("slug", "path", (chars > 0).alias("ok"), "extractor", chars.cast("long").alias("chars"), F.when(chars == 0, F.coalesce("error", F.lit("extract_no_text"))).alias("error"))


def reindex_counts(results: DataFrame, *keys: str) -> DataFrame:
    """(processed, updated, failed) of reindexing results (ok, chars), per key if any."""
    return results.groupBy(*keys).agg(F.count("*").alias("processed"), F.count_if(F.col("ok") & (F.col("chars") > 0)).alias("updated"), F.count_if(~F.col("ok")).alias("failed"))


def corpus(documents: DataFrame, meta: DataFrame, limit: int = 120_000) -> DataFrame:
    """Documents with text, at most ``limit`` characters of each, and their extraction."""
    own = documents.select("entry_id", "slug", "path", "name", F.substring(trim(F.col("text")), 1, limit).alias("text")).filter(F.length("text") > 0)
    return own.join(meta, "entry_id", "left")
