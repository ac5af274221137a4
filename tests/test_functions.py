"""Text, quality, catalog, path and job functions against fixed cases."""

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import catalog as C
from scriptorium.functions import jobs as J
from scriptorium.functions import paths as P
from scriptorium.functions import quality as Q
from scriptorium.functions import text as T


@pytest.fixture(scope="module")
def value(spark):
    """The value of an expression over one row of named inputs."""

    def run(expression, **columns):
        kinds = {str: "string", int: "int", float: "double", bool: "boolean", list: "array<string>", bytes: "binary", type(None): "string"}
        schema = ", ".join(f"{k} {kinds[type(v)]}" for k, v in columns.items()) or "x int"
        return spark.createDataFrame([tuple(columns.values()) or (1,)], schema).select(expression.alias("v")).first().v

    return run


c = F.col


@pytest.mark.parametrize(
    "query, inside",
    [("Как произвести первый запуск установки?", {"первый", "первичн", "запуск", "пуск"}), ("Извлечение элементов", {"извлечен", "мембран", "элементо"}), ("инструкции", {"инструкц"}), ("", set()), ("да и", set())],
)
def test_terms(value, query, inside):
    got = T.query_terms(query)
    assert inside <= set(got) and len(got) == len(set(got)) <= 16
    assert value(T.terms(c("q")), q=query) == got


def test_terms_drop_stop_words_and_cut_stems():
    assert T.query_terms("Какие установки") == []
    assert T.query_terms("Ёмкость электродвигателей") == ["емкость", "электрод"]
    assert len(T.query_terms(" ".join(f"слово{i:03d}" for i in range(30)))) == 16


@pytest.mark.parametrize("query, term", [("Что в разделе 14 про накопительные баки?", "14"), ("п. 3.2.1", "3.2.1"), ("Ф14 раздел", "14"), ("a14 раздел", None), ("14 раздел", "14")])
def test_section_terms(value, query, term):
    got = T.section_terms(query)
    assert (term in got) if term else got == []
    assert value(T.section_terms_column(c("q")), q=query) == got


def test_boost_phrases_are_cut_to_terms():
    assert T.boosted_terms("насос", ["14", "раздел 14"]) == ["насос", "раздел"]


@pytest.mark.parametrize(
    "text, expected",
    [("Какой 答案 вариант правильный?", "Какой  вариант правильный?"), ("工力エ問 фыва 漢字 テスト", " фыва  "), ("Überzug_#@=é", "berzug"), ("", ""), (None, None)],
)
def test_sanitized(value, text, expected):
    assert value(T.sanitized(c("t")), t=text) == expected


def test_page_text_drops_before_it_squeezes(value):
    assert value(T.page_text(c("t")), t="а б\fв\n\n г") == "абв г"
    assert value(T.extracted_text(c("t")), t="工") is None
    assert value(T.extracted_text(c("t"), 3), t="абвгд") == "абв"


def test_occurrences_do_not_overlap(value):
    assert value(T.occurrences(c("t"), ["аа"]), t="аааа") == 2
    assert value(T.occurrences(c("t"), ["пуск", "запуск"]), t="запуск") == 2
    assert value(T.occurrences(c("t"), []), t="x") == 0


def test_first_hit_and_snippet(value):
    assert value(T.first_hit(c("t"), ["б", "в"]), t="авб") == 1
    assert value(T.first_hit(c("t"), ["ж"]), t="авб") == 0
    assert value(T.snippet(c("t"), F.lit(2), F.lit("n.pdf")), t="а \n б  в") == "б в"
    assert value(T.snippet(c("t"), F.lit(0), F.lit("n.pdf")), t="  ") == "Файл: n.pdf"


def test_photo_text_and_runs(value):
    assert value(T.photo_text(c("t")), t="Вопрос  |  5\r\nа\n\nОтвет") == "Вопрос 5\nОтвет"
    assert value(T.latin_runs(c("t")), t=b"\x00short\x00a run of twelve\x01and another run") == "a run of twelve and another run"


def test_formats(value):
    assert value(T.escape_html(c("t")), t="<a & b>") == "&lt;a &amp; b&gt;"
    assert value(T.clipped(c("t"), 5), t=" аб  вгде ") == "аб в…"
    assert value(T.truncated(c("t"), 4), t=" абвгд ") == "абв…"
    assert value(T.highlighted(c("t"), F.lit("Порядок")), t="О порядке: порядок сверки").asDict() == {"before": "О порядке: ", "hit": "порядок", "after": " сверки"}
    assert value(T.highlighted(c("t"), F.lit("п")), t="абв").hit is None


DENSE = "Требования к эксплуатации электроустановок. "
LAYER = "Установка обратного осмоса EBC. Производительность пермеата 1,2 м3/ч. Давление на входе 2,5-4,0 бар. Режим промывки мембран при проводимости выше 450 мкСм/см."
CONTENTS = "1. ВВЕДЕНИЕ 3 2. НАЗНАЧЕНИЕ 4 3. ТЕХНИЧЕСКИЕ ХАРАКТЕРИСТИКИ 5 4. КОМПЛЕКТАЦИЯ 6 5. МОНТАЖ 7"
HEADINGS = "\n".join(f"{i}. ЭКСПЛУАТАЦИЯ НАКОПИТЕЛЬНЫХ БАКОВ" for i in range(1, 8))


@pytest.mark.parametrize(
    "text, pages, usable, recognise, poor",
    [
        (None, 0, False, True, True), ("", 0, False, True, True), ("short text", 0, False, True, True), ("Lorem ipsum dolor sit amet, consectetur adipiscing elit. " * 4, 0, False, True, True),
        (LAYER, 0, True, False, False), (CONTENTS, 40, False, True, True), (DENSE * 800, 120, True, False, True), ("Правила технической эксплуатации электроустановок. " * 120, 344, True, False, True),
    ],
)
def test_text_layers(value, text, pages, usable, recognise, poor):
    got = value(F.struct(Q.usable_layer(c("t"), c("n")), Q.wants_recognition(c("t"), c("n")), Q.wants_fallback(c("t"), c("n"))), t=text, n=pages)
    assert tuple(got) == (usable, recognise, poor)


def test_contents(value):
    long = " ".join(f"{i}. ПОРЯДОК МОНТАЖА И НАЛАДКИ {i + 3}" for i in range(1, 11))
    assert value(Q.contents_heavy(c("t"), 1), t=long) is True
    assert value(Q.contents_heavy(c("t"), 40), t=HEADINGS) is True
    assert value(Q.contents_heavy(c("t"), 1), t=LAYER) is False
    assert value(Q.contents_heavy(c("t"), 1), t=CONTENTS[:50]) is False


def test_full_text_scores_above_contents(value):
    full, thin = value(Q.extraction_score(c("t"), F.lit(10)), t=DENSE * 40), value(Q.extraction_score(c("t"), F.lit(10)), t=" ".join([CONTENTS] * 3))
    assert full > thin and value(Q.extraction_score(c("t"), F.lit(1)), t=None) == 0


QUIZ = "Вопрос № 5 из 23\nРазрешается ли надевать, снимать и поправлять на ходу приводные ремни теплоустановок?\n1. Разрешается при использовании защитных рукавиц.\n2. Не разрешается."


@pytest.mark.parametrize("text, photo, document", [(QUIZ, True, True), ("工力漢字テスト", False, False), ("аЦИ падает! се т", False, False), ("Какой вариант ответа верный?", False, True), ("short", False, False), (None, False, False)])
def test_photos_and_attachments(value, text, photo, document):
    assert value(Q.photo_usable(c("t")), t=text) is photo
    assert value(Q.attachment_usable(c("t"), F.lit(False)), t=text) is document


@pytest.mark.parametrize(
    "extractor, text, pages, source, most, status, note",
    [
        ("tesseract-ocr", DENSE * 99, 100, 100, 150, "ready", None), ("tesseract-ocr", DENSE * 99, 80, 120, 80, "partial", "80"), ("tesseract-ocr", DENSE, 20, 400, 80, "partial", "лимит 80"),
        ("pdf-parse", CONTENTS, None, 100, 80, "partial", "оглавление"), ("pdf-parse", DENSE, None, 2, 80, "ready", None), ("pdf-parse", None, None, 5, 80, "partial", "OCR"),
    ],
)
def test_index_status(value, extractor, text, pages, source, most, status, note):
    got = value(Q.index_status(c("t"), F.lit(extractor), F.lit(pages).cast("int"), F.lit(source), most), t=text)
    assert got.index_status == status and (note is None) == (got.index_note is None) and (note or "") in (got.index_note or "")


@pytest.mark.parametrize(
    "has, status, pdf, extractor, chars, source, indexed, pages, expected",
    [
        (False, None, True, None, 0, 0, None, None, "none"), (True, "partial", True, "pdf-parse", 0, 0, None, None, "partial"), (True, None, False, "mammoth", 0, None, None, None, "ready"),
        (True, None, True, "pdf-parse", 120_000, 200, None, None, "ready"), (True, None, True, "pdf-parse", 10_000, 100, None, None, "partial"), (True, None, True, "tesseract-ocr", 10, 9, 5, None, "partial"),
        (True, None, True, "tesseract-ocr", 10, 9, None, None, "partial"), (True, None, True, "tesseract-ocr", 10, 9, None, 9, "ready"),
    ],
)
def test_index_display(value, has, status, pdf, extractor, chars, source, indexed, pages, expected):
    lit = lambda v, t: F.lit(v).cast(t)
    shown = Q.index_display(F.lit(has), lit(status, "string"), lit(None, "string"), F.lit(pdf), lit(extractor, "string"), lit(chars, "long"), lit(source, "int"), lit(indexed, "int"), lit(pages, "int"))
    assert value(shown).text_index_status == expected


@pytest.mark.parametrize(
    "path, kind",
    [
        ("gas/ФЗ-123 газоснабжение.pdf", "law"), ("electro/ГОСТ 12345-2020.pdf", "standard"), ("buhgalteriya/Классификатор ОКОФ.pdf", "classifier"), ("a/Инструкция по СИЗ.pdf", "instruction"),
        ("СП 12.pdf", "other"), ("sp 12.pdf", "standard"), ("ТКП 5.pdf", "other"), ("ткp 5.pdf", "tkp"), ("Приказ 1.pdf", "regulation"), ("закон/письмо.pdf", "other"),
    ],
)
def test_document_types(value, path, kind):
    assert value(C.doc_type(c("p")), p=path) == kind


def test_catalog_entry(value):
    own = C.inferred(c("p"))
    got = value(F.struct(*[v.alias(k) for k, v in own.items()]), p="buhgalteriya\\Классификатор ОКОФ 2.pdf")
    assert got.path == "buhgalteriya/Классификатор ОКОФ 2.pdf" and got.title == "Классификатор ОКОФ 2" and got.doc_id == "2" and got.priority == 5
    assert got.aliases == ["Классификатор ОКОФ 2.pdf", "классификатор"] and got.references == [] and got.sections_hint == {}
    assert value(C.matches_path(c("p"), F.lit("инструкция по сиз.PDF")), p="ohrana/Инструкция по СИЗ.pdf")
    assert value(C.matches_alias(F.array(F.lit("Инструкция")), F.lit(" инструкция "))) and not value(C.matches_alias(F.array(F.lit("")), F.lit(" ")))


@pytest.mark.parametrize("name, ok", [("manual.pdf", True), ("virus.exe", False), (".pdf", False), ("A.DOCX", True), ("noext", False), ("a.tar.txt", True), ("", False)])
def test_allowed(value, name, ok):
    assert value(P.allowed(c("n")), n=name) is ok


@pytest.mark.parametrize("path, ok", [("", True), ("registr/manual.pdf", True), ("СИЗ/Постановление 110 от 2006г..docx", True), ("../x", False), ("a/../b", False), ("/a", False), ("a\\..\\b", False), ("a<b", False)])
def test_paths(value, path, ok):
    assert value(P.valid_path(c("p")), p=path) is ok
    if ok:
        assert P.check_path(path) == path
    else:
        with pytest.raises(ValueError):
            P.check_path(path)


def test_segments_and_names(value):
    assert value(P.segment(c("s")), s="  СИЗ   1 ") == "СИЗ 1" and value(P.segment(c("s")), s="..") is None
    broken = "Паспорт.pdf".encode().decode("latin-1")
    assert value(P.safe_name(c("s")), s=broken) == "Паспорт.pdf"
    assert value(P.safe_name(c("s")), s="a/b/c<d>..pdf") == "c_d_.pdf" and value(P.safe_name(c("s")), s="x.exe") is None
    assert value(P.safe_name(c("s")), s="Ñ\xff\xfe.pdf") == "___.pdf"


@pytest.mark.parametrize("title, slug", [("Газоснабжение", "gazosnabzhenie"), ("Охрана труда", "ohrana-truda"), ("Electro 2024", "electro-2024"), ("   ", "napravlenie"), ("Щёлочь — ЖЭК", "scheloch-zhek"), ("!!!", "napravlenie")])
def test_slugs(value, title, slug):
    assert value(P.slug_of(c("t")), t=title) == slug


def test_unique_slug(value):
    assert value(P.unique_slug(F.lit("Газ"), c("t")), t=["gaz", "gaz-2"]) == "gaz-3"
    assert value(P.unique_slug(F.lit("Газ"), c("t")), t=["x"]) == "gaz"


def test_scopes_and_renames(value):
    assert value(P.within(c("p"), "a/b"), p="a/b/c") and value(P.within(c("p"), "a/b"), p="a/b") and not value(P.within(c("p"), "a/b"), p="a/bc") and value(P.within(c("p"), ""), p="x")
    assert value(P.in_folders(c("p"), ["b"]), p="a/b/c") and not value(P.in_folders(c("p"), ["b"]), p="ab/c")
    assert value(P.renamed(c("p"), "a/b", "a/c"), p="a/b/x") == "a/c/x" and value(P.renamed(c("p"), "a/b", "a/c"), p="a/bb/x") == "a/bb/x"
    assert value(P.ancestors(c("p")), p="a/b/c.pdf") == ["a", "a/b"] and value(P.ancestors(c("p")), p="c.pdf") == []
    assert P.scope_of(" a\\b ") == "a/b" and P.scope_of("../x") == ""


def _weight(value, file, started, estimate, now, page=None, total=None):
    lit = lambda v, t="long": F.lit(v).cast(t)
    return value(J.weight(lit(file, "string"), lit(started), lit(estimate), lit(now), lit(page), lit(total)))


def test_job_weights(value):
    assert _weight(value, "a.pdf", 1, 90_000, 90_001) == pytest.approx(0.92)
    late = _weight(value, "a.pdf", 1, 90_000, 360_001)
    assert 0.92 < late <= 0.99
    assert _weight(value, "a.pdf", 1, 90_000, 1, 50, 100) == pytest.approx(0.5)
    assert _weight(value, None, None, 90_000, 5) == 0 and _weight(value, "a", 5, 90_000, 5) == pytest.approx(0.03)


@pytest.mark.parametrize("processed, total, phase, file, weight, expected", [(0, 10, "scanning", None, 0.0, 0), (5, 10, "indexing", None, 0.0, 50), (10, 10, "indexing", None, 0.0, 100), (0, 1, "indexing", "a", 0.475, 48), (0, 1, "indexing", "a", 0.0, 1), (0, 0, "indexing", None, 0.0, 0), (3, 0, "indexing", None, 0.0, 100)])
def test_percent(value, processed, total, phase, file, weight, expected):
    assert value(J.percent(F.lit(processed), F.lit(total), F.lit(phase), F.lit(file).cast("string"), F.lit(weight))) == expected


def test_eta(value):
    eta = lambda *a: value(J.eta_seconds(*map(F.lit, a)))
    assert eta(0, 0, 0, 0.0, 1, 5) is None and eta(0, 5, 5, 0.0, 1, 5) == 0
    assert eta(0, 1, 3, 0.0, 30_000, 60_000) == 120 and eta(0, 0, 3, 0.0, 30_000, 1) == 90


@pytest.mark.parametrize("scope, path, ok", [("tkp", "tkp", True), ("tkp@batch-abc", "tkp", True), ("tkp/docs", "tkp", True), ("tkp", "tkp/docs", True), ("other", "tkp", False), ("tkp@batch-x", "tkp/docs", False), ("a/b", "", False), ("a", "", True)])
def test_job_scopes(value, scope, path, ok):
    assert value(J.matches_scope(c("s"), F.lit(path)), s=scope) is ok


def test_job_views_and_batches(value):
    assert value(J.matches_view(F.lit("tkp@batch-1"), F.lit("tkp/a.pdf"), F.lit("tkp"))) and not value(J.matches_view(F.lit("tkp@batch-1"), F.lit("other/a.pdf"), F.lit("tkp")))
    assert value(J.batch_scope(F.lit("tkp"), c("f"), F.lit(1)), f=["tkp/doc.pdf"]) == "tkp/doc.pdf"
    import re

    assert re.fullmatch("tkp@batch-[a-f0-9]{8}", value(J.batch_scope(F.lit("tkp"), c("f"), F.lit(1)), f=["a", "b"]))


def test_labels_and_sizes(value):
    assert value(J.action_label(c("f")), f="a.JPG") == "OCR фото" and value(J.action_label(c("f")), f="a.md") == "Текст" and value(J.action_hint(c("f")), f="a.png") is None
    assert [value(J.duration(F.lit(s).cast("long"))) for s in (None, 0, 59, 60, 61)] == ["оценка…", "скоро", "59 сек", "1 мин", "1 мин 1 сек"]
    assert [value(J.byte_size(F.lit(s))) for s in (1023, 1536, 3 * 1024 * 1024)] == ["1023 B", "1.5 KB", "3.0 MB"]
    assert [value(J.hue_of_rank(F.lit(r))) for r in (0, 11, 12)] == [32, 55, 204] and value(J.hue_of_slug(c("s")), s="ab") == [32, 168, 210, 278, 12, 145, 95, 48, 320, 185, 220, 55][195 % 12]


def test_addresses(value):
    address = value(J.route(F.lit("gas"), F.lit("а б/c+d")))
    assert address == "#/gas/%D0%B0%20%D0%B1/c%2Bd"
    assert tuple(value(J.parsed_route(c("a")), a=address)) == ("direction", "gas", "а б/c+d")
    assert value(J.parsed_route(c("a")), a="#/").view == "home" and value(J.parsed_route(c("a")), a="#/gas/%zz").path == "%zz"


def test_settings():
    from scriptorium.functions.requests import Settings

    own = Settings.of({"ocr_max_pages": " 20 ", "default_slug": "", "default_scope": "a\\b", "unknown": "x"})
    assert (own.ocr_max_pages, own.ocr_timeout_sec, own.default_slug, own.default_scope) == (20, 900, None, "a/b")
    assert Settings.of({"default_scope": "../x"}).default_scope == ""
    for bad in ({"ocr_dpi": "0"}, {"ocr_dpi": "1.5"}, {"default_slug": "Ы"}):
        with pytest.raises(ValueError):
            Settings.of(bad)


@pytest.mark.parametrize("given, chars", [(None, 20_000), ("", 20_000), ("x", 20_000), ("5", 2_000), (" 30000abc", 30_000), ("999999999", 120_000), ("-4", 2_000)])
def test_limits_of_requests(value, given, chars):
    from scriptorium.functions import requests as R

    assert value(R.limited(c("t"), R.CONTEXT_CHARS), t=given) == chars
    assert value(R.listed(c("t")), t=None) == [] and value(R.listed(c("t")), t=" a, ,b ,") == ["a", "b"]


@pytest.mark.parametrize("slug, title, scope, label", [("", "x", "y", "направление не выбрано"), ("s", None, "", "s (все папки)"), ("s", "Газ", "a/b", "Газ → b")])
def test_session_labels(value, slug, title, scope, label):
    from scriptorium.functions import requests as R

    assert value(R.session_label(F.lit(slug).cast("string"), F.lit(title).cast("string"), F.lit(scope).cast("string"))) == label


def test_a_slug_is_stamped_where_all_numbers_are_taken(value):
    from scriptorium.functions import paths as P

    taken = F.concat(F.array(F.lit("gaz")), F.transform(F.sequence(F.lit(2), F.lit(999)), lambda n: F.concat(F.lit("gaz-"), n.cast("string"))))
    assert value(P.unique_slug(F.lit("Газ"), taken, F.lit("17"))) == "gaz-17" and value(P.unique_slug(F.lit("Газ"), F.slice(taken, 1, 900), F.lit("17"))) == "gaz-901"
    assert value(J.byte_size(F.lit(None).cast("long"))) is None and value(J.route(F.lit("s"), F.lit("a!(b)~'*/ч"))) == "#/s/a!(b)~'*/%D1%87"
