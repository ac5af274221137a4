"""The tree of sidecars, extraction, streams and the driver's contract."""

import io
import json
import os
import subprocess
import sys
import zipfile
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from scriptorium.sources import extract as E
from scriptorium.sources import tree as Tr
from scriptorium.streaming import jobs as Str

HERE = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))


@pytest.fixture
def root(tmp_path):
    def put(path, body):
        p = tmp_path / "lib" / path
        p.parent.mkdir(parents=True, exist_ok=True)
        p.write_text(body if isinstance(body, str) else json.dumps(body, ensure_ascii=False), encoding="utf-8")

    put("gas/_meta.json", {"title": " Газ ", "created_at": "2024-01-02T03:04:05.000Z"})
    put("electro/_meta.json", "{broken")
    put("gas/a/one.pdf", "x")
    put("gas/a/one.pdf.extracted.txt", " Текст один ")
    put("gas/a/one.pdf.extracted.meta.json", {"extractor": "pdf-parse", "confidence": 0.85, "chars": 10})
    put("gas/a/one.pdf.extracted.pages.json", {"pages": [{"page": 1, "text": "стр"}, {"page": 3, "text": "три"}]})
    put("gas/a/one.pdf.library.json", {"title": "Один", "aliases": ["a"]})
    put("gas/gone.doc.extracted.txt", "сирота")
    put("gas/blank.txt.extracted.txt", "  ")
    put("gas/_a.txt", "видно")
    put("gas/.hidden/x.txt", "нет")
    put("Bad_slug/x.txt", "нет")
    return str(tmp_path / "lib")


def test_tree(spark, root):
    seen = {(r.slug, r.path) for r in Tr.tree(spark, root).collect()}
    assert ("gas", "_a.txt") in seen and ("gas", "a/one.pdf") in seen and not any(".hidden" in p or s == "Bad_slug" or p == "_meta.json" for s, p in seen)
    got = {r.slug: r for r in Tr.directions(spark, root).collect()}
    assert got["gas"].title == "Газ" and got["gas"].created_at.year == 2024 and got["electro"].title == "electro" and got["electro"].created_at.year == 1970
    assert {(r.path, r.text) for r in Tr.texts(spark, root).collect()} == {("a/one.pdf", "Текст один"), ("gone.doc", "сирота")}
    assert [(r.path, r.extractor, r.index_status) for r in Tr.metas(spark, root).collect()] == [("a/one.pdf", "pdf-parse", None)]
    assert sorted((r.page, r.text) for r in Tr.pages(spark, root).collect()) == [(1, "стр"), (3, "три")]
    assert [(r.title, r.aliases, r.doc_type) for r in Tr.stored_catalog(spark, root).collect()] == [("Один", ["a"], None)]


def word(text):
    data = io.BytesIO()
    with zipfile.ZipFile(data, "w") as z:
        ns = 'xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"'
        z.writestr("word/document.xml", f"<w:document {ns}><w:body><w:p><w:r><w:t>{text}</w:t><w:tab/><w:t>дальше</w:t></w:r></w:p><w:p/></w:body></w:document>")
    return data.getvalue()


FILES = "slug string, path string, content binary"


def test_extraction_and_round_trip(spark, tmp_path):
    rows = [
        ("gas", "a.txt", "Привет,\nмир ä".encode()), ("gas", "b.docx", word("Абзац")), ("gas", "c.docx", b"broken"), ("gas", "d.doc", b"\x00\x01A readable run of text\x00"),
        ("gas", "e.jpg", b"\xff"), ("gas", "f.exe", b"x"), ("gas", "g.txt", b""), ("gas", "h.pdf", b"page one\fpage two"),
    ]
    readers = dict(E.READERS) | {"pdf": ("pdftotext", lambda data: data.decode().split("\f"))}
    done = E.extract(spark.createDataFrame(rows, FILES), readers)
    got = {r.path: r for r in done.collect()}
    assert got["a.txt"].text == "Привет, мир" and got["a.txt"].confidence == 1.0 and got["a.txt"].extractor == "plain-text"
    assert got["b.docx"].text == "Абзац дальше" and got["b.docx"].confidence == 0.8
    assert not got["c.docx"].ok and got["c.docx"].error.startswith("BadZipFile")
    assert got["d.doc"].text == "A readable run of text" and got["d.doc"].confidence == 0.35
    assert {got[p].error for p in ("e.jpg", "f.exe", "g.txt")} == {"extract_no_text"}
    assert [(p.page, p.text) for p in got["h.pdf"].pages] == [(1, "page one"), (2, "page two")] and got["h.pdf"].source_pages == 2
    out = str(tmp_path / "out")
    os.makedirs(out + "/gas")
    for _ in range(2):  # a repeated task leaves the same files
        Tr.write_sidecars(done.withColumn("extracted_at", F.lit("2024-01-01")), out)
    assert {(r.path, r.text) for r in Tr.texts(spark, out).collect()} == {(p, r.text) for p, r in got.items() if r.text}
    assert Tr.pages(spark, out).count() == 2 and Tr.metas(spark, out).count() == 4
    assert E.extract(spark.createDataFrame([], FILES)).count() == 0


def test_job_stream(spark, tmp_path):
    schema = "job_id string, at timestamp, event_id long, kind string"
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    batches = [[("a", at(0), 0, "queued"), ("a", at(1), 1, "started"), ("b", at(1), 2, "started")], [("a", at(2), 3, "file_done"), ("a", at(2), 3, "file_done"), ("b", at(3), 4, "queued")], [("a", at(4), 5, "file_failed"), ("a", at(5), 6, "finished"), ("a", at(6), 7, "file_done")]]
    src = str(tmp_path / "events")
    query = Str.job_states(spark.readStream.schema(schema).parquet(src) if os.path.isdir(src) else _stream(spark, src, schema)).writeStream.outputMode("update").format("memory").queryName("states").option("checkpointLocation", str(tmp_path / "cp")).start()
    for rows in batches:
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        query.processAllAvailable()
    query.stop()
    last = {r.job_id: r for r in spark.sql("select * from states order by updated_at, processed, failed").collect()}
    assert (last["a"].status, last["a"].processed, last["a"].failed) == ("done", 1, 1) and last["b"].status == "queued"


def _stream(spark, folder, schema):
    os.makedirs(folder)
    return spark.readStream.schema(schema).parquet(folder)


def test_ingest(spark, tmp_path):
    root = tmp_path / "landing"
    (root / "gas" / "a b").mkdir(parents=True)
    (root / "gas" / "a b" / "п.txt").write_text("Привет", encoding="utf-8")
    (root / "gas" / "x.docx").write_bytes(b"broken")
    seen = {}
    query = Str.ingest(Str.new_files(spark, str(root)), str(root), lambda df, n: seen.update({(r.slug, r.path): r.text for r in df.collect()}), str(tmp_path / "cp"))
    query.awaitTermination()
    assert seen == {("gas", "a b/п.txt"): "Привет", ("gas", "x.docx"): None}


def test_folders_single_files_and_parts(spark, root):
    os.makedirs(os.path.join(root, "gas", "b", "leer"))
    os.makedirs(os.path.join(root, "gas", ".x", "y"))
    assert {tuple(r) for r in Tr.folders(spark, root).collect()} == {("gas", "a"), ("gas", "b"), ("gas", "b/leer")}
    assert [(bytes(r.content), r.content_type) for r in Tr.file(spark, root, "gas", "a/one.pdf").collect()] == [(b"x", "application/pdf")]
    assert Tr.file(spark, root, "gas", "a/none.pdf").count() == 0 and Tr.file(spark, root, "gas", "_a.txt").first().content_type.startswith("text/plain")
    with pytest.raises(ValueError):
        Tr.file(spark, root, "gas", "../x")
    assert Tr.tree(spark, root).rdd.getNumPartitions() >= 4


def test_arrivals_see_every_name(spark, tmp_path):
    root = tmp_path / "landing"
    (root / "gas" / "a").mkdir(parents=True)
    (root / "gas" / "_x.txt").write_text("Раз", encoding="utf-8")
    (root / "gas" / "a" / "y.txt").write_text("Два", encoding="utf-8")
    seen = {}
    store = lambda df, n: seen.update({(r.slug, r.path): r.text for r in df.collect()})
    Str.ingest(Tr.arrivals(spark, str(root)), str(root), store, str(tmp_path / "cp")).awaitTermination()
    assert seen == {("gas", "_x.txt"): "Раз", ("gas", "a/y.txt"): "Два"}
    seen.clear()
    (root / "gas" / "a" / "z.txt").write_text("Три", encoding="utf-8")
    Str.ingest(Tr.arrivals(spark, str(root)), str(root), store, str(tmp_path / "cp")).awaitTermination()
    assert seen == {("gas", "a/z.txt"): "Три"}


def made_pdf(*texts):
    import zlib

    out = b"%PDF-1.4\n"
    for k, t in enumerate(texts):
        body = zlib.compress(b"BT /F1 12 Tf (" + t.replace("(", "\\(").encode("cp1252") + b") Tj ET")
        out += f"{k + 1} 0 obj << /Type /Page /Contents {k + 50} 0 R >> endobj\n{k + 50} 0 obj << /Length {len(body)} /Filter /FlateDecode >> stream\n".encode() + body + b"\nendstream endobj\n"
    return out + b"9 0 obj << /Type /Pages >> endobj %%EOF"


def test_text_layer_by_parsing():
    assert E.layer_by_parsing(made_pdf("First (page", "Second")) == ("First (page\nSecond", 2)
    assert E.layer_by_parsing(b"no pdf") == (None, 0) and E.layer_by_parsing(b"%PDF-1.4 stream\nxx\nendstream") == (None, 0)
    assert E.layer_by_program(b"no pdf") is None and E.page_count(made_pdf("a", "b", "c")) == 3


DENSE = "Проверка заземляющего устройства проводится не реже одного раза в год. " * 30


def fake_tools(**more):
    """Files are JSON: two layers, pages, what recognition reads of each."""
    of = lambda name: lambda data: json.loads(data).get(name)

    def draw(data, page, dpi, seconds):
        assert seconds >= 15 and dpi == 150
        got = json.loads(data)["pages"][page - 1]
        return None if got is None else got.encode()

    def read(picture, seconds, mode, spaces):
        if picture == b"fail":
            raise RuntimeError
        return picture.decode()

    return E.Tools(layers=(("pdftotext", of("a")), ("pdf-parse", of("b"))), count=lambda d: json.loads(d).get("n", 0), raster=draw, recognise=read, **more)


def test_pdf_in_tiers(spark):
    files = {
        "layer": {"a": DENSE, "b": None, "n": 2}, "second": {"a": "x", "b": DENSE, "n": 1}, "scan": {"a": "", "n": 5, "pages": ["Один", None, "fail", " ", "Пять"]}, "poor": {"a": "мало букв", "n": 1, "pages": ["fail"]},
        "none": {"n": 1, "pages": [None]}, "between": {"a": "Текст документа без полной страницы букв. " * 125, "n": 25, "pages": []}, "long": {"n": 9, "pages": ["слово"] * 9},
    }
    rows = [("gas", k + ".pdf", json.dumps(v).encode()) for k, v in files.items()] + [("gas", "broken.pdf", b"{")]
    tools = fake_tools(most_pages=7)
    got = {r.path[:-4]: r for r in E.extract(spark.createDataFrame(rows, FILES), tools=tools).collect()}
    seen = {k: (r.extractor, r.confidence) for k, r in got.items()}
    assert seen == {"layer": ("pdftotext", 0.85), "second": ("pdf-parse", 0.85), "scan": ("tesseract-ocr", 0.65), "poor": ("pdftotext", 0.5), "none": ("tesseract-ocr", 0.0), "between": ("pdftotext", 0.75), "long": ("tesseract-ocr", 0.65), "broken": ("tesseract-ocr", 0.0)}
    assert [(p.page, p.text) for p in got["scan"].pages] == [(1, "Один"), (5, "Пять")] and got["scan"].text == "Один Пять" and got["scan"].index_status == "partial"
    assert len(got["long"].pages) == 7 and got["none"].error == "extract_no_text" and got["layer"].pages is None
    forced = {r.path[:-4]: r.extractor for r in E.pdf_tiers(spark.createDataFrame([("gas", "layer.pdf", json.dumps({"a": DENSE, "n": 1, "pages": ["слово"]}).encode())], FILES), tools, force=True, at_once=1).collect()}
    assert forced == {"layer": "tesseract-ocr"}


QUIZ = "Вопрос: какой вариант разрешается при установке теплообменника № 5 в котельной?"


def test_photos_and_attachments(spark):
    said = {("screen_inverted", "4"): "шум", ("screen_binary", "6"): QUIZ, ("document", "3"): QUIZ, ("document", "4"): "слово"}

    def prepare(picture, recipe, seconds):
        return None if picture == b"bad" and recipe != "document" else picture + b"|" + recipe.encode()

    def read(picture, seconds, mode, spaces):
        name, _, recipe = picture.decode().partition("|")
        if name == "raw":
            return "" if recipe else QUIZ
        if (recipe, mode) not in said:
            raise RuntimeError
        return said[recipe, mode]

    tools = E.Tools(prepare=prepare, recognise=read)
    rows = [("s", "good.png", b"good"), ("s", "bad.jpg", b"bad"), ("s", "raw.jpeg", b"raw"), ("s", "a.txt", " Привет, проверка устройства номер пять ".encode()), ("s", "b.doc", b"\x00short runs\x01"), ("s", "c.exe", b"x"), ("s", "d.docx", word("Абзац"))]
    files = spark.createDataFrame(rows, FILES)
    got = {r.path: r.text for r in E.photos(files.filter(F.col("path").rlike("png|jp")), tools).collect()}
    assert got == {"good.png": QUIZ, "bad.jpg": QUIZ, "raw.jpeg": QUIZ}
    sent = {r.path: (r.text, r.usable) for r in E.attachment_texts(files, tools).collect()}
    assert sent["good.png"] == (QUIZ, True) and sent["a.txt"] == ("Привет, проверка устройства номер пять", True) and sent["b.doc"] == ("short runs", False) and sent["c.exe"] == (None, False) and sent["d.docx"][0].startswith("Абзац")


def test_chat_stream(spark, tmp_path):
    schema = "chat string, at timestamp, event_id long, kind string, value string"
    at = lambda s: datetime(2024, 1, 1, 0, 0, s)
    src = str(tmp_path / "chat")
    query = Str.chat_states(_stream(spark, src, schema)).writeStream.outputMode("update").format("memory").queryName("chats").option("checkpointLocation", str(tmp_path / "cp")).start()
    for rows in ([("1", at(0), 1, "direction", "gas"), ("1", at(1), 2, "question", "что?")], [("1", at(2), 3, "folder", "a/b"), ("2", at(2), 4, "mode", "search")]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
        query.processAllAvailable()
    query.stop()
    got = [tuple(r) for r in spark.sql("select * from chats").collect()]
    assert ("1", "gas", "", "none", "что?") in got and ("1", "gas", "a/b", "none", None) in got and ("2", "", "", "search", None) in got


def test_stages_can_be_dropped(spark):
    from scriptorium import session

    df = session.durable(spark.range(5), "drop-me")
    path = session._staged[-1].removeprefix("file://")
    assert df.count() == 5 and os.path.isdir(path)
    assert session.drop_stages(spark) >= 1 and not os.path.exists(path) and session.drop_stages(spark) == 0


def test_progress_stream_plan(spark, tmp_path):
    own = Str.progress(_stream(spark, str(tmp_path / "e"), "at timestamp, kind string"))
    assert own.isStreaming and own.columns == ["window_start", "kind", "events"]


def test_entry_without_the_text_part(tmp_path):
    """The package, its queries and their SQL work where the text-preparation part is gone."""
    import shutil

    shutil.copytree(HERE, tmp_path / "repo", ignore=shutil.ignore_patterns(".git", "__pycache__", "llm"))
    code = "import __spark_entry__ as e; q = e.queries(); assert 'search_topk' in q and not any(n.startswith('p1_') for n in q); assert set(e.oracle_sql()) <= set(q); print('fine')"
    done = subprocess.run([sys.executable, "-c", code], cwd=tmp_path / "repo", capture_output=True, text=True, env=os.environ | {"PYTHONPATH": str(tmp_path / "repo")})
    assert done.stdout.strip() == "fine", done.stderr


def test_sql_belongs_to_queries():
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
