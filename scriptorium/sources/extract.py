"""Text extraction from files: plain text and legacy Word on the JVM, the rest by readers.

A reader is a function from bytes to pages of text. PDF files go through tiers: two readers
of the text layer, of which the better one is taken; only files whose layer is not usable
are split off and sent to recognition, page by page. ``Tools`` holds the functions that do
the outside work, so that others can be put in their place; ``register`` adds readers of
other kinds of files.
"""

from __future__ import annotations

import io
import re
import shutil
import subprocess
import tempfile
import zipfile
import zlib
from collections.abc import Callable
from dataclasses import dataclass
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from scriptorium.functions import paths as P
from scriptorium.functions import quality as Q
from scriptorium.functions import text as T
from scriptorium.session import durable

Reader = Callable[[bytes], list[str]]
READERS: dict[str, tuple[str, Reader]] = {}
_WORD = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def register(extension: str, extractor: str, reader: Reader) -> None:
    """Use ``reader`` for files with an extension; ``extractor`` names it in the results."""
    READERS[extension.lower().lstrip(".")] = (extractor, reader)


def docx(data: bytes) -> list[str]:
    """Raw text of a Word document, one line a paragraph."""
    with zipfile.ZipFile(io.BytesIO(data)) as z:
        root = ElementTree.fromstring(z.read("word/document.xml"))
    lines = []
    for p in root.iter(_WORD + "p"):
        parts = [("\t" if e.tag == _WORD + "tab" else "\n" if e.tag == _WORD + "br" else e.text or "") for e in p.iter() if e.tag in (_WORD + "t", _WORD + "tab", _WORD + "br")]
        lines.append("".join(parts))
    return ["\n\n".join(lines)]


def _run(*command: str, data: bytes, suffix: str, seconds: float = 180, most: int | None = None) -> bytes:
    """What an outside program writes for a file; more than ``most`` bytes are a failure."""
    if not shutil.which(command[0]):
        raise RuntimeError(f"{command[0]} is not installed")
    with tempfile.NamedTemporaryFile(suffix=suffix) as f:
        f.write(data)
        f.flush()
        out = subprocess.run([c.format(file=f.name) if "{file}" in c else c for c in command], capture_output=True, timeout=seconds, check=True).stdout
    if most is not None and len(out) > most:
        raise OverflowError("output_too_large")
    return out


def layer_by_program(data: bytes) -> str | None:
    """The text layer of a PDF by ``pdftotext``; None where that fails."""
    try:
        return _run("pdftotext", "-layout", "-enc", "UTF-8", "{file}", "-", data=data, suffix=".pdf", seconds=180, most=48 << 20).decode("utf-8", "replace")
    except Exception:
        return None


_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_SHOWN = re.compile(rb"\[((?:[^\[\]\\]|\\.)*)\]\s*TJ|(\((?:[^()\\]|\\.)*\)|<[0-9A-Fa-f\s]*>)\s*(?:Tj|'|\")|(T\*|T[dD]|ET)", re.S)
_STRING = re.compile(rb"\(((?:[^()\\]|\\.)*)\)|<([0-9A-Fa-f\s]*)>", re.S)
_ESCAPED = re.compile(rb"\\([0-7]{1,3}|.)", re.S)


def layer_by_parsing(data: bytes) -> tuple[str | None, int]:
    """(text, pages) of a PDF by reading its strings: a second text layer for files that the
    program can't read. Fonts of codes need a map to Unicode; (None, 0) for anything else."""
    try:
        if not data.startswith(b"%PDF"):
            return None, 0
        bodies = []
        for m in _STREAM.finditer(data):
            try:
                bodies.append(zlib.decompress(m[1]))
            except zlib.error:
                bodies.append(m[1])
        letters = {}
        for body in bodies:
            for code, to in re.findall(rb"<([0-9A-Fa-f]{2,8})>\s*<([0-9A-Fa-f]{4,})>\s*(?=\n|\r|<|endbfchar)", body) if b"beginbfchar" in body else ():
                letters[bytes.fromhex(code.decode())] = bytes.fromhex(to.decode()).decode("utf-16-be", "replace")
        width = max(map(len, letters), default=1)

        def read(m) -> str:
            if m[2] is not None:
                raw = bytes.fromhex(re.sub(rb"\s", b"", m[2]).decode().ljust(2, "0"))
            else:
                raw = _ESCAPED.sub(lambda e: bytes([int(e[1], 8) & 255]) if e[1][:1].isdigit() else {b"n": b"\n", b"r": b"\r", b"t": b"\t"}.get(e[1], e[1]), m[1])
            if raw.startswith(b"\xfe\xff"):
                return raw[2:].decode("utf-16-be", "replace")
            if letters and m[2] is not None:
                return "".join(letters.get(raw[k : k + width], "") for k in range(0, len(raw), width))
            return raw.decode("cp1252", "replace")

        lines = []
        for body in bodies:
            if b"Tj" in body or b"TJ" in body:
                for m in _SHOWN.finditer(body):
                    lines.append("\n" if m[3] else "".join(read(x) for x in _STRING.finditer(m[1] if m[1] is not None else m[2])))
        return "".join(lines).strip() or None, len(re.findall(rb"/Type\s*/Page(?![a-zA-Z])", data))
    except Exception:
        return None, 0


def page_count(data: bytes) -> int:
    """Pages of a PDF by ``pdfinfo``, else as parsed; 0 where neither can tell."""
    try:
        m = re.search(rb"(?i)Pages:\s+(\d+)", _run("pdfinfo", "{file}", data=data, suffix=".pdf", seconds=30, most=1 << 20))
        if m:
            return int(m[1])
    except Exception:
        pass
    return layer_by_parsing(data)[1]


def raster(data: bytes, page: int, dpi: int, seconds: float) -> bytes | None:
    """A page of a PDF as an image, by ``pdftoppm``."""
    return _run("pdftoppm", "-png", "-r", str(dpi), "-f", str(page), "-l", str(page), "{file}", data=data, suffix=".pdf", seconds=seconds, most=64 << 20) or None


#: Fixed value: what recognition may read.
WHITELIST = "АБВГДЕЁЖЗИЙКЛМНОПРСТУФХЦЧШЩЪЫЬЭЮЯабвгдеёжзийклмнопрстуфхцчшщъыьэюяABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789.,:;!?-–—«»\"'()/\\%+№§° "
_OUTSIDE = re.compile(f"[^{T.KEPT}]")


def recognised(picture: bytes, seconds: float = 180, mode: str = "3", spaces: bool = True) -> str:
    """Russian text of an image by ``tesseract``; characters outside the kept ones are gone."""
    keep = ("-c", "preserve_interword_spaces=1") if spaces else ()
    out = _run("tesseract", "{file}", "stdout", "-l", "rus", "--oem", "1", "--psm", mode, "-c", "tessedit_char_whitelist=" + WHITELIST, *keep, data=picture, suffix=".png", seconds=seconds, most=16 << 20)
    return _OUTSIDE.sub("", out.decode("utf-8", "replace"))


# Ways to prepare a photo, and modes of recognition, in the order they are tried.
_UPSCALE = ["-auto-orient", "-filter", "Lanczos", "-resize", "3000x3000>"]
RECIPES = {
    "screen_inverted": [*_UPSCALE, "-colorspace", "Gray", "-gaussian-blur", "0x2.2", "-negate", "-contrast-stretch", "1.5%x1.5%", "-level", "10%,90%,1.0", "-sharpen", "0x1.4"],
    "screen_binary": [*_UPSCALE, "-colorspace", "Gray", "-gaussian-blur", "0x2.8", "-negate", "-contrast-stretch", "0%", "100%", "-black-threshold", "52%", "-sharpen", "0x1"],
    "document": [*_UPSCALE, "-colorspace", "Gray", "-contrast-stretch", "0.5%x0.5%", "-sharpen", "0x0.9", "-normalize"],
}
MODES = ("4", "6", "3", "11")


def prepared(picture: bytes, recipe: str, seconds: float) -> bytes | None:
    """A photo prepared by a recipe with ImageMagick, None where that fails."""
    try:
        return _run("magick", "{file}", *RECIPES[recipe], "png:-", data=picture, suffix=".bin", seconds=min(seconds, 35), most=64 << 20)
    except Exception:
        return None


@dataclass(frozen=True)
class Tools:
    """The outside work of extraction. ``layers`` gives the text layers of a PDF by name, the
    first of equal ones being preferred; all functions take the bytes of a file."""

    layers: tuple = (("pdftotext", layer_by_program), ("pdf-parse", lambda data: layer_by_parsing(data)[0]))
    count: Callable = page_count
    raster: Callable = raster
    recognise: Callable = recognised
    prepare: Callable = prepared
    most_pages: int = 150
    seconds: float = 900
    dpi: int = 150
    photo_seconds: float = 120


def recognised_pages(data: bytes, tools: Tools, report: Callable = lambda page, of: None) -> list[tuple[int, str]]:
    """(page, text) of the first pages of a PDF. Pages that fail, can't be drawn or are blank are
    left out; each has an equal part of the time, fifteen seconds at least."""
    known = tools.count(data)
    total = min(known if known > 0 else tools.most_pages, tools.most_pages)
    each, out = max(15.0, tools.seconds // max(total, 1)), []
    for page in range(1, total + 1):
        report(page, total)
        picture = tools.raster(data, page, tools.dpi, each)
        if not picture:
            continue
        try:
            text = " ".join(_OUTSIDE.sub("", tools.recognise(picture, each, "3", False)).split())
        except Exception:
            continue
        if text:
            out.append((page, text))
    return out


def attempts(picture: bytes, tools: Tools) -> list[tuple[int, str, str]]:
    """(round, recipe, text) of every mode of recognition of a photo in every preparation; the
    photo as it is comes last, in a round of its own. Attempts that fail have no row."""
    out = []
    each = max(25.0, tools.photo_seconds // len(RECIPES))
    for number, recipe in enumerate([*RECIPES, "raw"]):
        ready = picture if recipe == "raw" else tools.prepare(picture, recipe, each)
        for mode in MODES if ready else ():
            try:
                out.append((number, recipe, tools.recognise(ready, max(10.0, each // len(MODES)), mode, True)))
            except Exception:
                continue
    return out


register("docx", "mammoth", docx)


def _read(files: DataFrame, readers: dict) -> DataFrame:
    """(slug, path, extractor, raw, pages, error) by Python readers; a failure is a value."""

    def run(batches):
        for batch in batches:
            rows: list[list] = [[] for _ in range(6)]
            for slug, path, content in zip(*(batch.column(c).to_pylist() for c in range(3))):
                name, reader = readers[path.rsplit(".", 1)[-1].lower()]
                try:
                    pages, error = reader(content), None
                except Exception as e:
                    pages, error = [], f"{type(e).__name__}: {e}"
                for column, value in zip(rows, (slug, path, name, "\n".join(pages) or None, pages if len(pages) > 1 else None, error)):
                    column.append(value)
            kinds = (pa.string(), pa.string(), pa.string(), pa.string(), pa.list_(pa.string()), pa.string())
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, kinds)], names=["slug", "path", "extractor", "raw", "raw_pages", "error"])

    return files.select("slug", "path", "content").mapInArrow(run, "slug string, path string, extractor string, raw string, raw_pages array<string>, error string")


def pdf_layers(files: DataFrame, tools: Tools = Tools()) -> DataFrame:
    """(slug, path, text, extractor, source_pages, usable, recognise) of PDF files (slug, path,
    content): the better text layer, the first on a tie, and whether it needs recognition."""
    names = [n for n, _ in tools.layers]

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, 16):
                some = batch.slice(at, 16)
                data = some.column(2).to_pylist()
                texts = [[_quiet(read, d) for _, read in tools.layers] for d in data]
                pages = [_quiet(tools.count, d) or 0 for d in data]
                yield pa.RecordBatch.from_arrays([*some.columns[:2], pa.array(texts, pa.list_(pa.string())), pa.array(pages, pa.int32())], names=["slug", "path", "layers", "n"])

    own = files.select("slug", "path", "content").mapInArrow(run, "slug string, path string, layers array<string>, n int")
    n = F.col("n")
    layers = [F.struct(T.extracted_text(F.element_at("layers", k + 1)).alias("text"), F.lit(name).alias("extractor"), F.lit(-k).alias("o")) for k, name in enumerate(names)]
    scored = F.transform(F.array(*layers), lambda x: F.struct(F.coalesce(Q.layer_score(x["text"], n), F.lit(-1)).alias("score"), x["o"].alias("o"), x["text"].alias("text"), x["extractor"].alias("extractor")))
    own = own.select("slug", "path", "n", F.array_max(scored).alias("b"))
    own = own.select("slug", "path", F.col("b.text").alias("text"), F.when(F.col("b.text").isNotNull(), F.col("b.extractor")).alias("extractor"), "n", Q.judged(F.col("b.text"), n).alias("j"))
    return own.select("slug", "path", "text", "extractor", F.col("n").alias("source_pages"), "j.usable", "j.recognise")


def _quiet(f: Callable, data: bytes):
    try:
        return f(data)
    except Exception:
        return None


def pdf_recognised(files: DataFrame, tools: Tools = Tools(), at_once: int | None = None) -> DataFrame:
    """(slug, path, pages) of PDF files by recognition; ``at_once`` limits how many files are
    recognised at the same time in the whole cluster."""

    def run(batches):
        kind = pa.list_(pa.struct([("page", pa.int32()), ("text", pa.string())]))
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                found = _quiet(lambda d: recognised_pages(d, tools), one.column(2)[0].as_py()) or []
                yield pa.RecordBatch.from_arrays([*one.columns[:2], pa.array([[{"page": p, "text": t} for p, t in found]], kind)], names=["slug", "path", "pages"])

    own = files.select("slug", "path", "content")
    return (own.repartition(at_once) if at_once else own).mapInArrow(run, "slug string, path string, pages array<struct<page:int,text:string>>")


def pdf_tiers(files: DataFrame, tools: Tools = Tools(), force: bool = False, at_once: int | None = None) -> DataFrame:
    """(slug, path, text, pages, extractor, confidence, source_pages) of PDF files.

    A usable text layer holds (.85), so does another one that needs no recognition (.75).
    Otherwise the file is recognised (.65); where that gives nothing its layer stays (.5), and
    without one there is no text (0). With ``force`` every file is recognised first. The text
    layers are written to the shared folder, and only the files that need it are read again.
    """
    layers = durable(pdf_layers(files, tools), "pdf-layers")
    wanted = layers.filter(F.lit(force) | F.col("recognise")).select("slug", "path")
    read = pdf_recognised(files.join(wanted, ["slug", "path"], "left_semi"), tools, at_once)
    joined = F.array_join(F.transform("pages", lambda p: p["text"]), "\n\n")
    read = read.select("slug", "path", F.when(F.size("pages") > 0, F.col("pages")).alias("pages"), T.extracted_text(joined).alias("by_pages"))
    both = layers.join(read, ["slug", "path"], "left")
    better = F.col("by_pages").isNotNull()
    failed = F.col("recognise") & ~better
    extractor = F.when(better | (failed & F.col("text").isNull()), "tesseract-ocr").otherwise(F.coalesce("extractor", F.lit("pdf-parse")))
    text = F.coalesce("by_pages", "text")
    confidence = F.when(text.isNull(), 0.0).when(better, 0.65).when(failed, 0.5).when(F.col("usable"), 0.85).otherwise(0.75)
    return both.select("slug", "path", text.alias("text"), F.when(better, F.col("pages")).alias("pages"), extractor.alias("extractor"), confidence.alias("confidence"), "source_pages")


def best_attempts(tried: DataFrame, *keys: str, least: float = 20) -> DataFrame:
    """(keys, text, score): the best recognised text of each photo from its attempts (keys, round,
    place, text). Within a round, and then among rounds, the first of the highest score wins;
    what scores below ``least`` gives no text."""
    scored = tried.select(*keys, "round", "place", "text", Q.photo_score(F.col("text")).alias("score"))
    first = scored.groupBy(*keys, "round").agg(F.max(F.struct("score", (-F.col("place")).alias("o"), "text")).alias("b"))
    best = first.groupBy(*keys).agg(F.max(F.struct("b.score", (-F.col("round")).alias("o"), "b.text")).alias("b"))
    return best.select(*keys, F.when(F.col("b.score") >= least, T.photo_text(F.col("b.text"))).alias("text"), F.col("b.score").alias("score"))


def photos(files: DataFrame, tools: Tools = Tools()) -> DataFrame:
    """(slug, path, text, score) of photos (slug, path, content): all preparations and modes are
    tried, and the best text is taken; the photo as it is counts only where none gave text."""

    def run(batches):
        for batch in batches:
            for at in range(batch.num_rows):
                one = batch.slice(at, 1)
                rows = _quiet(lambda d: attempts(d, tools), one.column(2)[0].as_py()) or []
                same = [one.column(c).take(pa.array([0] * len(rows), pa.int32())) for c in (0, 1)]
                yield pa.RecordBatch.from_arrays([*same, pa.array([r[0] for r in rows], pa.int32()), pa.array(range(len(rows)), pa.int32()), pa.array([r[2] for r in rows], pa.string())], names=["slug", "path", "round", "place", "text"])

    tried = files.select("slug", "path", "content").mapInArrow(run, "slug string, path string, round int, place int, text string")
    tried = durable(tried, "photos")
    raw = len(RECIPES)
    ready = best_attempts(tried.filter(F.col("round") < raw), "slug", "path").filter("text is not null")
    plain = best_attempts(tried.filter(F.col("round") == raw), "slug", "path").join(ready, ["slug", "path"], "left_anti")
    return ready.unionByName(plain)


def attachment_texts(files: DataFrame, tools: Tools = Tools(), readers: dict | None = None, limit: int = 12_000) -> DataFrame:
    """(slug, path, text, usable) of files sent with a question: not brought to the library's
    form, cut to ``limit`` characters; runs of a legacy document are shorter (8)."""
    readers = READERS if readers is None else readers
    ext = P.extension(P.base_name(F.col("path")))
    own = files.select("slug", "path", "content", ext.alias("ext"))
    plain = own.filter("ext in ('txt', 'md')").select("slug", "path", F.col("content").cast("string").alias("text"))
    legacy = own.filter("ext = 'doc'").select("slug", "path", T.latin_runs(F.col("content"), 8).alias("text"))
    words = _read(own.filter("ext = 'docx'"), dict(readers)).select("slug", "path", F.col("raw").alias("text"))
    by_pdf = pdf_tiers(own.filter("ext = 'pdf'"), tools).select("slug", "path", "text")
    pictures = photos(own.filter(F.col("ext").isin(*P.IMAGES)), tools).select("slug", "path", "text")
    texts = plain.unionByName(legacy).unionByName(words).unionByName(by_pdf).unionByName(pictures)
    out = own.select("slug", "path").join(texts, ["slug", "path"], "left").withColumn("text", F.nullif(F.substring(T.trim(F.col("text")), 1, limit), F.lit("")))
    return out.select("slug", "path", "text", Q.attachment_usable(F.col("text"), P.is_image(F.col("path"))).alias("usable"))


def extract(files: DataFrame, readers: dict | None = None, tools: Tools = Tools(), force: bool = False, at_once: int | None = None) -> DataFrame:
    """(slug, path, text, pages, extractor, confidence, chars, source_pages, indexed_pages,
    index_status, index_note, ok, error) of files (slug, path, content).

    Plain text and legacy Word stay on the JVM; PDF files go through tiers unless a reader is
    registered for them. Files without a reader, and images unless one is registered, give no
    text and the error ``extract_no_text``.
    """
    readers = READERS if readers is None else readers
    ext = P.extension(P.base_name(F.col("path")))
    own = files.select("slug", "path", "content", ext.alias("ext"))
    none = F.lit(None)
    pages_type = "array<struct<page:int,text:string>>"
    read = [none.cast("array<string>").alias("raw_pages"), none.cast("string").alias("error")]
    plain = own.filter(F.col("ext").isin("txt", "md")).select("slug", "path", F.lit("plain-text").alias("extractor"), F.col("content").cast("string").alias("raw"), *read)
    legacy = own.filter("ext = 'doc'").select("slug", "path", F.lit("legacy-doc-fallback").alias("extractor"), T.latin_runs(F.col("content")).alias("raw"), *read)
    by_reader = _read(own.filter(F.col("ext").isin(*readers)), dict(readers))
    tiered = [] if "pdf" in readers else ["pdf"]
    rest = own.filter(~F.col("ext").isin("txt", "md", "doc", *readers, *tiered)).select("slug", "path", none.cast("string").alias("extractor"), none.cast("string").alias("raw"), *read)
    raw = plain.unionByName(legacy).unionByName(by_reader).unionByName(rest)
    text = T.extracted_text(F.col("raw"))
    pages = F.filter(F.transform("raw_pages", lambda t, k: F.struct((k + 1).alias("page"), T.page_text(t).alias("text"))), lambda p: p["text"] != "").cast(pages_type)
    out = raw.select("slug", "path", "extractor", text.alias("text"), F.when(F.size(pages) > 0, pages).alias("pages"), F.size("raw_pages").alias("n"), "error")
    is_pdf = F.lower("path").endswith(".pdf")
    out = out.withColumn("n", F.when(is_pdf, F.greatest(F.col("n"), F.lit(0))).otherwise(F.lit(0)))
    out = out.withColumn("confidence", Q.confidence(F.col("extractor"), F.col("text"), F.col("n"), F.lit(False)))
    if tiered:
        tiers = pdf_tiers(own.filter("ext = 'pdf'"), tools, force, at_once)
        out = out.unionByName(tiers.select("slug", "path", "extractor", "text", F.col("pages").cast(pages_type).alias("pages"), F.col("source_pages").alias("n"), none.cast("string").alias("error"), "confidence"))
    info = Q.index_status(F.col("text"), F.coalesce("extractor", F.lit("")), F.size("pages"), F.col("n"), tools.most_pages)
    out = out.withColumn("i", info)
    return out.select(
        "slug", "path", "text", "pages", "extractor", "confidence", F.coalesce(F.length("text"), F.lit(0)).cast("long").alias("chars"),
        "i.source_pages", "i.indexed_pages", "i.index_status", "i.index_note", F.col("text").isNotNull().alias("ok"), F.when(F.col("text").isNull(), F.coalesce("error", F.lit("extract_no_text"))).alias("error"),
    )
