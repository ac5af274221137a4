"""A library kept as folders of files with sidecars: a Spark source, for batches and streams, and
a sink for sidecars.

Spark's own file sources hide names that start with '_' or '.', which the library uses for
its records, so the tree is listed by a source of its own: one partition for each folder at
the top of a direction, and one for the direction's own files.
"""

from __future__ import annotations

import json
import os
import re
from collections.abc import Iterator
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, DataSourceStreamReader, InputPartition

from scriptorium.functions import paths as P
from scriptorium.functions.text import trim

SCHEMA = "slug string, path string, name string, size bigint, modified_at timestamp, content binary"
_SLUG = re.compile(r"[a-z0-9][a-z0-9-]*")


class _Part(InputPartition):
    """A folder at the top of a direction with all below it, or ('' ) the files beside them; files
    that changed after ``since`` and not after ``upto`` (nanoseconds)."""

    def __init__(self, slug: str, folder: str, since: int | None = None, upto: int | None = None):
        self.slug, self.folder, self.since, self.upto = slug, folder, since, upto


class _Lister:
    """What both readers share: which parts there are, and the rows of one."""

    def __init__(self, options):
        self.root = options["path"]
        contents = [e for e in options.get("contents", "").split(",") if e]
        self.endings = ("",) if "*" in contents else tuple(contents)
        self.hidden = options.get("records", "false") == "true"
        self.what = options.get("what", "files")
        self.only = options.get("only", "")

    def parts(self, **bounds) -> list[_Part]:
        if self.only:
            slug, _, path = self.only.partition("/")
            return [_Part(slug, os.path.dirname(path))]
        out = []
        for top in sorted(os.scandir(self.root), key=lambda e: e.name):
            if top.is_dir() and _SLUG.fullmatch(top.name):
                out.append(_Part(top.name, "", **bounds))
                out += [_Part(top.name, e.name, **bounds) for e in sorted(os.scandir(top.path), key=lambda e: e.name) if e.is_dir() and not e.name.startswith(".")]
        return out

    def rows(self, part: _Part) -> Iterator[tuple]:
        top = os.path.join(self.root, part.slug)
        deep = bool(part.folder) and not self.only
        for folder, below, names in os.walk(os.path.join(top, part.folder) if part.folder else top):
            below[:] = sorted(d for d in below if deep and not d.startswith("."))
            found = [""] if self.what == "folders" else sorted(names)
            for name in found:
                if name.startswith(".") or (name == "_meta.json" and not self.hidden) or (self.what == "folders" and folder == top):
                    continue
                full = os.path.join(folder, name) if name else folder
                path = os.path.relpath(full, top).replace(os.sep, "/")
                if self.only and f"{part.slug}/{path}" != self.only:
                    continue
                try:
                    state = os.stat(full)
                    if part.upto is not None and not part.since < state.st_mtime_ns <= part.upto:
                        continue
                    content = open(full, "rb").read() if name and self.endings and name.endswith(self.endings) else None
                except OSError:
                    continue
                yield (part.slug, path, os.path.basename(path), state.st_size if name else None, datetime.fromtimestamp(state.st_mtime, timezone.utc), content)


class _Reader(_Lister, DataSourceReader):
    def partitions(self):
        return self.parts()

    def read(self, partition) -> Iterator[tuple]:
        return self.rows(partition)


class _Arrivals(_Lister, DataSourceStreamReader):
    """Files by the time they changed last. A file must come into its folder as a whole, as by
    renaming; with the option ``latest`` only those after the start of the stream count."""

    def __init__(self, options):
        super().__init__(options)
        self.latest = options.get("latest", "false") == "true"

    def _newest(self) -> int:
        newest = 0
        for folder, below, names in os.walk(self.root):
            below[:] = [d for d in below if not d.startswith(".")]
            for name in names:
                try:
                    newest = max(newest, os.stat(os.path.join(folder, name)).st_mtime_ns)
                except OSError:
                    continue
        return newest

    def initialOffset(self):
        return {"upto": self._newest() if self.latest else 0}

    def latestOffset(self):
        return {"upto": self._newest()}

    def partitions(self, start, end):
        return self.parts(since=start["upto"], upto=end["upto"])

    def read(self, partition) -> Iterator[tuple]:
        return self.rows(partition)


class LibraryTree(DataSource):
    """``spark.read.format("library_tree").option("contents", ".txt,.json").load(root)``"""

    @classmethod
    def name(cls):
        return "library_tree"

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return _Reader(self.options)

    def streamReader(self, schema):
        return _Arrivals(self.options)


def tree(spark: SparkSession, root: str, contents: str = "", records: bool = False) -> DataFrame:
    """Files of a library; the contents of those whose names end as given (comma-separated)."""
    spark.dataSource.register(LibraryTree)
    return spark.read.format("library_tree").option("contents", contents).option("records", str(records).lower()).load(root)


def folders(spark: SparkSession, root: str) -> DataFrame:
    """(slug, path) of every folder, empty ones included."""
    spark.dataSource.register(LibraryTree)
    return spark.read.format("library_tree").option("what", "folders").load(root).select("slug", "path")


def file(spark: SparkSession, root: str, slug: str, path: str) -> DataFrame:
    """(content, content_type) of one file; no row where it isn't there. Only it is read."""
    spark.dataSource.register(LibraryTree)
    own = spark.read.format("library_tree").option("only", f"{P.check_slug(slug)}/{P.check_path(path)}").option("contents", "*").load(root)
    return own.select("content", P.content_type(F.col("name")).alias("content_type"))


def arrivals(spark: SparkSession, root: str, latest: bool = False) -> DataFrame:
    """A stream of files with their contents as they come, whatever their names begin with; with
    ``latest`` those that are there at the start are dropped."""
    spark.dataSource.register(LibraryTree)
    return spark.readStream.format("library_tree").option("contents", "*").option("latest", str(latest).lower()).load(root)


def _sidecar(spark, root, ending) -> DataFrame:
    own = tree(spark, root, ending, records=True).filter(F.col("name").endswith(ending))
    return own.select("slug", F.col("path").substr(F.lit(1), F.length("path") - len(ending)).alias("path"), F.col("content").cast("string").alias("body"))


def directions(spark: SparkSession, root: str) -> DataFrame:
    """(slug, title, created_at) from the records; a missing or broken record has the slug as
    its title and the epoch as its time."""
    own = tree(spark, root, "_meta.json", records=True).filter("path = '_meta.json'")
    kept = own.select("slug", F.from_json(F.col("content").cast("string"), "title string, created_at string").alias("m"))
    slugs = spark.createDataFrame([(e.name,) for e in os.scandir(root) if e.is_dir() and _SLUG.fullmatch(e.name)], "slug string")
    title = F.coalesce(F.nullif(trim(F.col("m.title")), F.lit("")), F.col("slug"))
    return slugs.join(kept, "slug", "left").select("slug", title.alias("title"), F.coalesce(F.try_to_timestamp("m.created_at"), F.lit("1970-01-01").cast("timestamp")).alias("created_at"))


def texts(spark: SparkSession, root: str, limit: int = 120_000) -> DataFrame:
    """(slug, path, name, text) of all extracted texts that aren't blank, those whose source
    file is gone included."""
    own = _sidecar(spark, root, ".extracted.txt").select("slug", "path", F.substring_index("path", "/", -1).alias("name"), F.substring(trim(F.col("body")), 1, limit).alias("text"))
    return own.filter(F.length("text") > 0)


def metas(spark: SparkSession, root: str) -> DataFrame:
    """(slug, path, extractor, confidence, ...) of all stored extractions; broken ones are missing."""
    fields = "source_document string, extracted_at string, extractor string, confidence double, chars bigint, source_pages int, indexed_pages int, index_status string, index_note string"
    own = _sidecar(spark, root, ".extracted.meta.json").select("slug", "path", F.from_json("body", fields).alias("m"))
    return own.filter("m.extractor is not null").select("slug", "path", "m.*")


def pages(spark: SparkSession, root: str) -> DataFrame:
    """(slug, path, page, text) of all stored pages."""
    own = _sidecar(spark, root, ".extracted.pages.json").select("slug", "path", F.from_json("body", "pages array<struct<page:int,text:string>>").alias("m"))
    return own.select("slug", "path", F.inline("m.pages"))


def stored_catalog(spark: SparkSession, root: str) -> DataFrame:
    """(slug, path, ...) of all stored catalog entries."""
    fields = "doc_id string, title string, doc_type string, topics array<string>, aliases array<string>, references array<string>, sections_hint map<string,string>, priority int"
    return _sidecar(spark, root, ".library.json").select("slug", "path", F.from_json("body", fields).alias("m")).select("slug", "path", "m.*")


def write_sidecars(extracted: DataFrame, root: str) -> None:
    """Write text, extraction and pages beside their files, from the executors.

    ``extracted`` has (slug, path, text, pages, extractor, confidence, chars, source_pages,
    indexed_pages, index_status, index_note, extracted_at). Rows without text are left out;
    pages that are gone are removed. ``root`` must be a folder all executors share.
    """

    def run(rows):
        for r in rows:
            if not r.text:
                continue
            base = os.path.join(root, r.slug, r.path)
            os.makedirs(os.path.dirname(base), exist_ok=True)
            meta = {k: getattr(r, k) for k in ("extractor", "confidence", "chars", "source_pages", "indexed_pages", "index_status", "index_note")}
            meta |= {"source_document": r.path, "extracted_at": str(r.extracted_at)}
            files = {".extracted.txt": r.text, ".extracted.meta.json": json.dumps({k: v for k, v in meta.items() if v is not None}, ensure_ascii=False)}
            if r.pages:
                files[".extracted.pages.json"] = json.dumps({"pages": [{"page": p.page, "text": p.text} for p in r.pages]}, ensure_ascii=False)
            elif os.path.exists(base + ".extracted.pages.json"):
                os.remove(base + ".extracted.pages.json")
            for ending, body in files.items():
                part = f"{base}{ending}.part"
                with open(part, "w", encoding="utf-8") as f:
                    f.write(body)
                os.replace(part, base + ending)  # a repeated task leaves whole files

    extracted.foreachPartition(run)
