"""A document library as one object: its tables, and what can be asked of it or changed in it.

Every question is answered by a DataFrame; every change gives a new ``Library`` whose tables
hold it, so that nothing is written before its owner stores the tables.
"""

from __future__ import annotations

from dataclasses import dataclass, field, replace
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from scriptorium.functions import paths as P
from scriptorium.functions.requests import CONTEXT_CHARS, EXTRACTED_CHARS, Settings
from scriptorium.operators import ask as A
from scriptorium.operators import catalog as K
from scriptorium.operators import context as X
from scriptorium.operators import jobs as Jobs
from scriptorium.operators import library as L
from scriptorium.operators import search as S
from scriptorium.sources import extract as E
from scriptorium.sources.tables import distinct_pages, latest_meta, table

SYSTEM = "Отвечай по документам."
_META = ("extractor", "confidence", "chars", "source_pages", "indexed_pages", "index_status", "index_note")


def _within(given: int | None, bounds: tuple[int, int, int]) -> int:
    least, most, usual = bounds
    return usual if given is None else max(least, min(most, given))


@dataclass(frozen=True)
class Library:
    """``directions`` (slug, title, created_at), ``files`` (slug, path, name, size, modified_at),
    ``texts`` (entry_id, slug, path, name, text), ``pages`` (entry_id, slug, page, text) and ``meta``
    (slug, path and what is known of each extraction). ``stored`` are catalog entries that were
    set, ``made`` folders that may be empty, ``log`` the events of indexing jobs."""

    directions_: DataFrame
    files: DataFrame
    texts: DataFrame
    pages: DataFrame
    meta: DataFrame
    stored: DataFrame | None = None
    made: DataFrame | None = None
    log: DataFrame | None = None
    settings: Settings = field(default_factory=Settings)
    tools: E.Tools = field(default_factory=E.Tools)

    @classmethod
    def of_tables(cls, spark: SparkSession, folder: str, **more) -> Library:
        """The library of a folder of parquet tables: files and extractions in their latest state."""
        texts = table(spark, folder, "extracted_documents")
        meta = latest_meta(table(spark, folder, "extraction_meta"), *_META)
        meta = texts.select("entry_id", "slug", "path").join(meta, "entry_id")
        return cls(table(spark, folder, "directions"), L.current_files(table(spark, folder, "library_files")), texts, distinct_pages(table(spark, folder, "document_pages")), meta, **more)

    @property
    def spark(self) -> SparkSession:
        return self.files.sparkSession

    def _of(self, df: DataFrame, slug: str) -> DataFrame:
        return df.filter(F.col("slug") == P.check_slug(slug))

    # --- directions and folders

    def directions(self) -> DataFrame:
        """(slug, title, created_at) in the Russian order of titles."""
        return L.directions(self.directions_).orderBy(F.collate("title", "ru"), "slug")

    def create_direction(self, title: str, slug: str | None = None) -> Library:
        """With one more direction; without a slug it gets a free one made of its title."""
        if not title.strip():
            raise ValueError("title_required")
        if slug is None:
            taken = self.directions_.agg(F.collect_set("slug").alias("t"))
            slug = taken.select(P.unique_slug(F.lit(title), F.col("t")).alias("s")).first().s
        at = datetime.now(timezone.utc).replace(tzinfo=None)
        return replace(self, directions_=L.create_direction(self.directions_, slug, title, at))

    def retitle(self, slug: str, title: str) -> Library:
        return replace(self, directions_=L.retitle(self.directions_, P.check_slug(slug), title))

    def drop(self, slug: str) -> Library:
        """Without a direction and all it holds."""
        gone = {n: L.delete_direction(getattr(self, n), slug) for n in ("directions_", "files", "texts", "pages", "meta", "stored", "made") if getattr(self, n) is not None}
        return replace(self, **gone)

    def tree(self, slug: str, path: str = "") -> DataFrame:
        """(slug, kind, path, name) of what a folder shows."""
        return L.listing(self._of(self.files, slug), P.check_path(path) if path else "")

    def folder_tree(self, slug: str) -> DataFrame:
        """Every folder of a direction, empty ones included, in the Russian order of paths."""
        made = None if self.made is None else self._of(self.made, slug)
        return L.folders(self._of(self.files, slug), made).orderBy(F.collate("path", "ru"))

    def create_folder(self, slug: str, path: str) -> Library:
        made = self.spark.createDataFrame([], "slug string, path string") if self.made is None else self.made
        return replace(self, made=L.make_folder(made, slug, path))

    def rename_folder(self, slug: str, path: str, name: str) -> Library:
        """With a folder renamed, in all tables that name files."""
        new = "/".join([*path.split("/")[:-1], P.check_path(name)])
        files = L.rename_folder(self.files, slug, path, name)
        moved = lambda df: df if df is None else df.withColumn("path", F.when(F.col("slug") == slug, P.renamed(F.col("path"), path, new)).otherwise(F.col("path")))
        return replace(self, files=files, texts=moved(self.texts), meta=moved(self.meta), stored=moved(self.stored), made=moved(self.made))

    def delete_folder(self, slug: str, path: str, recursive: bool = False) -> Library:
        files = L.delete_folder(self.files, slug, path, recursive)
        gone = (F.col("slug") == slug) & P.within(F.col("path"), path)
        rest = lambda df: df if df is None else df.filter(~gone)
        return replace(self, files=files, texts=rest(self.texts), meta=rest(self.meta), stored=rest(self.stored), made=rest(self.made))

    # --- files

    def ingest(self, sent: DataFrame) -> Library:
        """With files sent (slug, folder, filename, size, modified_at); one of the same path is replaced."""
        new = L.uploaded(sent).select([c for c in self.files.columns if c in L.uploaded(sent).columns])
        kept = self.files.join(new.select("slug", "path"), ["slug", "path"], "left_anti")
        return replace(self, files=kept.unionByName(new, allowMissingColumns=True))

    def delete_file(self, slug: str, path: str) -> Library:
        one = (F.col("slug") == P.check_slug(slug)) & (F.col("path") == path)
        rest = lambda df: df if df is None else df.filter(~one)
        return replace(self, files=L.delete_file(self.files, slug, path), texts=rest(self.texts), meta=rest(self.meta), stored=rest(self.stored))

    def catalog(self, slug: str, scope: str = "") -> DataFrame:
        """Catalog entries of a scope, by priority and title; stored ones over what names suggest."""
        own = K.infer(self._of(self.files, slug), scope)
        return K.in_order(own if self.stored is None else K.merge(own, self.stored))

    def set_catalog(self, slug: str, path: str, doc_type: str | None = None, title: str | None = None) -> Library:
        """With type or title of one entry set; what followed from its old type stays."""
        one = K.set_type(self.catalog(slug).filter(F.col("path") == path), slug, path, doc_type, title)
        if one.isEmpty():
            raise LookupError("not_found")
        return replace(self, stored=one if self.stored is None else L.upsert(self.stored, one, ["slug", "path"]))

    # --- questions

    def search(self, slug: str, query: str, scope: str = "", limit: int = 12) -> DataFrame:
        """The best hits of a direction; a scope filters them after the limit."""
        return S.in_scope(S.search(self.texts, self.files, query, limit, slug), scope)

    def context(self, slug: str, query: str, scope: str = "", folders: list[str] = (), documents: list[str] = (), doc_types: list[str] = (), boost_terms: list[str] = (), max_chars: int | None = None, limit: int = 4, prefer_wide: bool | None = None) -> DataFrame:
        """Contexts of the documents that answer a query; document types that aren't known are ignored."""
        known = [t for t in doc_types if t in K.C.TYPES]
        return X.for_query(
            self._of(self.texts, slug), self._of(self.files, slug), self._of(self.pages, slug), self._of(self.meta, slug), query, scope=scope, folders=folders, wanted=documents, types=known, boost=boost_terms,
            most=_within(max_chars, CONTEXT_CHARS), limit=limit, prefer_wide=prefer_wide,
        )

    def ask_messages(self, slug: str, question: str, past: DataFrame | None = None, mode: str = "preview", scope: str = "", attachment: str = "", system: str = SYSTEM) -> DataFrame:
        """(messages): what a model is given to answer a question, in a mode of ``BUDGETS``."""
        most, limit, wide = A.BUDGETS[mode]
        items = X.for_query(self._of(self.texts, slug), self._of(self.files, slug), self._of(self.pages, slug), self._of(self.meta, slug), question, scope=scope, most=most, limit=limit, prefer_wide=wide)
        return A.messages(A.context_text(items), system, question, past, attachment)

    def documents(self, slug: str, max_chars: int | None = None) -> DataFrame:
        """Documents with text, and their extraction."""
        return L.corpus(self._of(self.texts, slug), self.meta.select("entry_id", *_META), _within(max_chars, EXTRACTED_CHARS))

    # --- indexing

    def jobs(self, now_ms: int | None = None) -> DataFrame:
        """The state of every job of the log; with a time, those to be shown then."""
        if self.log is None:
            raise LookupError("no_log")
        jobs = Jobs.fold(self.log)
        return jobs if now_ms is None else Jobs.still_shown(jobs, F.lit(now_ms))

    def reindex(self, contents: DataFrame, force: bool = False) -> tuple[Library, DataFrame]:
        """(library, results): with files (slug, path, content) read again. Texts, pages and
        extractions of all of them are replaced; files that gave no text lose theirs. An entry
        keeps its number, a new one gets one from its path."""
        from scriptorium.session import durable

        done = durable(E.extract(contents, tools=self.tools, force=force, at_once=self.settings.ocr_max_concurrent), "reindex")
        number = F.coalesce("entry_id", F.xxhash64("slug", "path"))
        own = done.join(self.texts.select("slug", "path", "entry_id"), ["slug", "path"], "left").withColumn("entry_id", number).withColumn("name", P.base_name(F.col("path")))
        again = own.select("slug", "path", "entry_id").distinct()
        read = own.filter("ok")
        texts = self.texts.select("entry_id", "slug", "path", "name", "text").join(again.select("slug", "path"), ["slug", "path"], "left_anti").unionByName(read.select("entry_id", "slug", "path", "name", "text"))
        pages = self.pages.select("entry_id", "slug", "page", "text").join(again.select("entry_id"), "entry_id", "left_anti").unionByName(read.select("entry_id", "slug", F.inline("pages")).select("entry_id", "slug", "page", "text"))
        meta = self.meta.select("entry_id", "slug", "path", *_META).join(again.select("slug", "path"), ["slug", "path"], "left_anti").unionByName(read.select("entry_id", "slug", "path", *_META))
        return replace(self, texts=texts, pages=pages, meta=meta), L.reindex_results(done)

    def ocr(self, picture: bytes) -> str | None:
        """The text of one photo."""
        one = self.spark.createDataFrame([("photo", "photo.png", bytearray(picture))], "slug string, path string, content binary")
        got = E.photos(one, self.tools).collect()
        return got[0].text if got else None


