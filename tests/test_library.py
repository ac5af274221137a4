"""The library as one object."""

from datetime import datetime

import pytest
from pyspark.sql import functions as F

from scriptorium.library import Library
from scriptorium.sources.extract import Tools

WORDS = "Проверка заземляющего устройства проводится раз в год. "


@pytest.fixture(scope="module")
def library(spark):
    at = datetime(2024, 1, 1)
    directions = spark.createDataFrame([("electro", "Электро", at), ("gas", None, None)], "slug string, title string, created_at timestamp")
    files = spark.createDataFrame([("electro", p, p.rsplit("/", 1)[-1], 5, at) for p in ("gost/a.pdf", "gost/b.txt", "c.docx")] + [("gas", "x.txt", "x.txt", 1, at)], "slug string, path string, name string, size long, modified_at timestamp")
    texts = spark.createDataFrame([(1, "electro", "gost/a.pdf", "a.pdf", WORDS * 3), (2, "electro", "c.docx", "c.docx", "Иной текст"), (3, "gas", "x.txt", "x.txt", WORDS)], "entry_id long, slug string, path string, name string, text string")
    pages = spark.createDataFrame([(1, "electro", 1, WORDS), (1, "electro", 2, "дальше")], "entry_id long, slug string, page int, text string")
    meta = spark.createDataFrame([(1, "electro", "gost/a.pdf", "pdftotext", 0.85, 9, 2, 2, "ready", None)], "entry_id long, slug string, path string, extractor string, confidence double, chars long, source_pages int, indexed_pages int, index_status string, index_note string")
    log = spark.createDataFrame([("j", at, 1, "queued"), ("j", at, 2, "started")], "job_id string, at timestamp, event_id long, kind string")
    tools = Tools(prepare=lambda picture, recipe, seconds: picture, recognise=lambda picture, seconds, mode, spaces: picture.decode())
    return Library(directions, files, texts, pages, meta, log=log, tools=tools)


def paths(df):
    return sorted(r.path for r in df.collect())


def test_questions(library):
    assert {r.title for r in library.directions().collect()} == {"gas", "Электро"}
    assert paths(library.tree("electro")) == ["c.docx", "gost"] and paths(library.folder_tree("electro")) == ["gost"]
    assert paths(library.search("electro", "заземляющего")) == ["gost/a.pdf"] and library.search("electro", "заземляющего", "other").count() == 0
    (item,) = library.context("electro", "заземляющего", doc_types=["nonsense"], prefer_wide=False).collect()
    assert item.path == "gost/a.pdf" and item.text.startswith("[стр. 1]") and item.confidence == 0.85
    (row,) = library.ask_messages("electro", "заземляющего", attachment="ещё").collect()
    assert [m.role for m in row.messages] == ["system", "user"] and row.messages[1].content.startswith("заземляющего\n\nещё")
    assert paths(library.documents("electro")) == ["c.docx", "gost/a.pdf"] and library.documents("electro", 5).count() == 2
    assert [r.status for r in library.jobs().collect()] == ["running"] and library.jobs(0).count() == 1
    assert library.ocr(("Вопрос: какой вариант разрешается установить? " * 2).encode()).startswith("Вопрос") and library.ocr(b"x") is None
    with pytest.raises(ValueError):
        library.tree("Bad slug")


def test_changes(library):
    assert {r.slug for r in library.create_direction("Газ").directions().collect()} == {"electro", "gas", "gaz"}
    assert library.drop("gas").texts.filter("slug = 'gas'").count() == 0 and library.drop("none").directions().count() == 2
    assert library.retitle("gas", "Г").directions().filter("title = 'Г'").count() == 1
    made = library.create_folder("electro", "new/one")
    assert paths(made.folder_tree("electro")) == ["gost", "new", "new/one"]
    moved = library.rename_folder("electro", "gost", "std")
    assert paths(moved.search("electro", "заземляющего")) == ["std/a.pdf"] and paths(moved.meta) == ["std/a.pdf"]
    with pytest.raises(ValueError):
        library.delete_folder("electro", "gost")
    assert paths(library.delete_folder("electro", "gost", recursive=True).tree("electro")) == ["c.docx"]
    assert library.delete_file("electro", "c.docx").documents("electro").count() == 1
    put = library.set_catalog("electro", "gost/b.txt", doc_type="law")
    assert {r.path: r.doc_type for r in put.catalog("electro").collect()}["gost/b.txt"] == "law"
    with pytest.raises(LookupError):
        library.set_catalog("electro", "none.txt", title="x")
    sent = library.spark.createDataFrame([("electro", "gost", "a.pdf", 77, datetime(2024, 2, 2)), ("electro", "", "n.md", 1, None)], "slug string, folder string, filename string, size long, modified_at timestamp")
    assert {(r.path, r.size) for r in library.ingest(sent).files.filter("slug = 'electro'").collect()} == {("gost/a.pdf", 77), ("gost/b.txt", 5), ("c.docx", 5), ("n.md", 1)}


def test_reindexing(library):
    rows = [("electro", "gost/b.txt", "Новый текст".encode()), ("gas", "x.txt", b" ")]
    new, results = library.reindex(library.spark.createDataFrame(rows, "slug string, path string, content binary"))
    assert {(r.path, r.ok, r.error) for r in results.collect()} == {("gost/b.txt", True, None), ("x.txt", False, "extract_no_text")}
    assert paths(new.texts) == ["c.docx", "gost/a.pdf", "gost/b.txt"] and new.meta.filter(F.col("path") == "gost/b.txt").first().extractor == "plain-text"
    assert new.pages.count() == 2


def test_library_of_tables(spark):
    own = Library.of_tables(spark, "/root/testdata/sf0.001")
    assert own.directions().count() == 24 and own.search("electro", "проверка").count() <= 12
