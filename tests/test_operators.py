"""Search, contexts, catalog, library, conversations and jobs on small frames."""

import random

import pytest
from pyspark.sql import functions as F

from scriptorium.functions import text as T
from scriptorium.operators import ask as A
from scriptorium.operators import catalog as K
from scriptorium.operators import context as X
from scriptorium.operators import jobs as Jobs
from scriptorium.operators import library as L
from scriptorium.operators import search as S
from scriptorium.sources.tables import distinct_pages, latest_meta

DOC = "entry_id long, slug string, path string, name string, text string, score int"  # score: a clashing extra column
FILE = "slug string, path string, name string, kind string, size long, modified_at timestamp, content_type string, has_text boolean, text_index_status string, text_index_note string"
PAGE = "page_id long, entry_id long, slug string, page int, text string"


@pytest.fixture(scope="module")
def docs(spark):
    rows = [
        (1, "gas", "a/Паспорт насоса.pdf", "Паспорт насоса.pdf", "Первый запуск насоса. Запуск в 8:00.", 9),
        (2, "gas", "b/Акт.docx", "Акт.docx", "Запуск запуск запуск ЁЛКА", 9),
        (3, "gas", "b/запуск.txt", "запуск.txt", "ничего", 9),
        (4, "gas", "c/пусто.txt", "пусто.txt", "", 9),
        (5, "gas", "c/нет.txt", "нет.txt", None, 9),
        (6, "electro", "a/Паспорт.pdf", "Паспорт.pdf", "раздел про пусконаладочные работы", 9),
    ]
    return spark.createDataFrame(rows, DOC)


@pytest.fixture(scope="module")
def files(spark, docs):
    at = "2024-01-01"
    rows = [(r.slug, r.path, r.name, "file", 10, None, None, True, "ready", None) for r in docs.collect()]
    rows += [("gas", "b/Запуск схема.png", "Запуск схема.png", "file", 5, None, None, False, "none", None), ("gas", "b/x.exe", "x.exe", "file", 5, None, None, False, "none", None)]
    return spark.createDataFrame(rows, FILE).withColumn("modified_at", F.lit(at).cast("timestamp"))


def paths(df):
    return [(r.path, r.score) for r in df.collect()]


def test_search_scores_and_orders(docs, files):
    # 'запуск' also asks for 'пуск', and both stand in 'запуск'
    got = paths(S.search(docs, files, "запуск", slug="gas"))
    assert set(got) == {("b/Акт.docx", 8.0), ("a/Паспорт насоса.pdf", 6.0), ("b/запуск.txt", 2.0), ("b/запуск.txt", 1.0), ("b/Запуск схема.png", 1.0)}
    assert [s for _, s in got] == sorted((s for _, s in got), reverse=True)


def test_search_over_all_directions(docs, files):
    assert ("a/Паспорт.pdf", 4.0) in paths(S.search(docs, files, "первый запуск"))


def test_blank_queries_and_queries_without_terms(docs, files):
    assert S.search(docs, files, "  ").count() == 0
    assert {s for _, s in paths(S.search(docs, files, "какие да", slug="gas"))} == {2.0}
    assert S.search(docs.limit(0), files.limit(0), "запуск").count() == 0


def test_filters_come_after_the_limit(docs, files):
    top = S.search(docs, files, "запуск", 1, slug="gas")
    assert S.in_scope(top, "a").count() == 0 and S.in_scope(top, "b").count() == 1
    assert S.in_folders(S.search(docs, files, "запуск"), ["a"]).count() == 2


def test_routes_types_and_names(spark, docs, files):
    catalog = K.infer(files)
    routes = K.routed(catalog, spark.createDataFrame([("АКТ.DOCX",), ("a\\Паспорт.pdf",), (None,), ("АКТ.DOCX",)], "wanted string"))
    assert {(r.slug, r.path) for r in routes.collect()} == {("gas", "b/Акт.docx"), ("electro", "a/Паспорт.pdf")}
    meta = spark.createDataFrame([("gas", "b/Акт.docx", "partial")], "slug string, path string, index_status string")
    assert paths(S.routed_search(docs, routes, meta, "запуск")) == [("b/Акт.docx", pytest.approx(8 * 0.85)), ("a/Паспорт.pdf", 4.0)]
    hits = S.search(docs, files, "запуск", None)
    assert S.of_types(hits, catalog, ["law"]).count() == 0 and S.of_types(hits, catalog, []).count() == hits.count()
    assert {p for p, _ in paths(S.named(hits, ["акт.docx"]))} == {"b/Акт.docx"}


def test_enrichment_and_fallback(spark, docs, files):
    meta = spark.createDataFrame([("gas", "b/Акт.docx", "mammoth", 0.8)], "slug string, path string, extractor string, confidence double")
    hit = {r.path: r for r in S.enriched(S.search(docs, files, "запуск", slug="gas"), docs, meta).collect()}
    assert hit["b/Акт.docx"].extractor == "mammoth" and hit["b/Запуск схема.png"].text == "Файл: Запуск схема.png" and hit["b/Запуск схема.png"].extractor is None
    none = S.search(docs, files, "zzz")
    assert {p for p, _ in paths(S.with_fallback(none, L.indexable_files(files, "b")))} == {"b/Акт.docx", "b/запуск.txt", "b/Запуск схема.png"}
    some = S.search(docs, files, "запуск")
    assert S.with_fallback(some, L.indexable_files(files, "b")).count() == some.count()


def test_many_queries(spark, docs):
    got = {r.query: (r.matched, r.occurrences) for r in S.many(docs, spark.createDataFrame([("запуск",), ("да",), (None,)], "query string")).collect()}
    assert got["запуск"] == (4, 6 + 4 + 0 + 2) and got["да"] == (5, 0)


# --- contexts against plain loops -------------------------------------------------------


def contents(text):
    return len(text) >= 120 and text.count("ОГЛАВЛЕНИЕ") > 0


def make_pages(rnd, n):
    out = []
    for p in range(1, n + 1):
        words = [rnd.choice(["насос", "кран", "бак", "труба", "вода", "запуск"]) for _ in range(rnd.randint(1, 40))]
        out.append((p, " ".join(words)))
    return out


def score(text, asked):
    return sum(text.lower().replace("ё", "е").count(t) for t in asked)


def blocks(pages):
    return [f"[стр. {p}]\n{t}" for p, t in pages]


def packed_narrow(pages, asked, most):
    hit = sorted(((score(t, asked), p, t) for p, t in pages if score(t, asked) > 0), key=lambda x: (-x[0], x[1]))
    out, used = [], 0
    for _, p, t in hit:
        b = f"[стр. {p}]\n{t}"
        if used >= most or (used + len(b) > most and out):
            break
        out.append(b)
        used += len(b) + 2
    return "\n\n".join(out)[:most]


def packed_wide(pages, asked, most):
    texts, chosen = dict(pages), {}
    for s, p in sorted(((-score(t, asked), p) for p, t in pages)):
        if s == 0 and len(chosen) >= 8:
            continue
        for x in (p, p - 1, p + 1) if s < 0 else (p,):
            chosen[x] = 1
        if len(chosen) >= 24:
            break
    for p, _ in pages:
        if len(chosen) >= 40:
            break
        chosen[p] = 1
    out, used = [], 0
    for p in sorted(x for x in chosen if x in texts):
        b = f"[стр. {p}]\n{texts[p]}"
        if used >= most:
            break
        if used + len(b) > most and out:
            continue
        out.append(b)
        used += len(b) + 2
    return "\n\n".join(out)[:most]


def spread(pages, most):
    step, out, used = max(1, len(pages) // 12), [], 0
    for p, t in pages[::step][:16]:
        if used >= most:
            break
        out.append(f"[стр. {p}]\n{t}")
        used += len(out[-1]) + 2
    return "\n\n".join(out)[:most]


@pytest.fixture(scope="module")
def entries():
    rnd = random.Random(3)
    return {e: make_pages(rnd, n) for e, n in enumerate([1, 2, 5, 13, 30, 60, 41])}


@pytest.fixture(scope="module")
def pages(spark, entries):
    rows = [(e * 100 + p, e, "gas", p, t) for e, own in entries.items() for p, t in own]
    random.Random(1).shuffle(rows)
    return spark.createDataFrame(rows, PAGE)


@pytest.mark.parametrize("asked, most", [(["насос"], 300), (["насос", "кран"], 90), (["запуск"], 5000), (["нет"], 300)])
def test_packing(pages, entries, asked, most):
    got = {r.entry_id: r.context for r in X.narrow(pages, asked, most).collect()}
    assert got == {e: w for e, p in entries.items() if (w := packed_narrow(p, asked, most))}
    got = {r.entry_id: r.context for r in X.wide(pages, asked, most).collect()}
    assert got == {e: packed_wide(p, asked, most) for e, p in entries.items()}
    got = {r.entry_id: r.context for r in X.spread_out(pages, most).collect()}
    assert got == {e: spread(p, most) for e, p in entries.items()}


def windowed(text, asked, most):
    low, spans = text.lower().replace("ё", "е"), []
    for t in asked:
        at = low.find(t)
        while at >= 0:
            spans.append((max(0, at - X.RADIUS), min(len(text), at + X.RADIUS)))
            at = low.find(t, at + len(t))
    if not spans:
        return text[:most]
    joined = []
    for a, b in sorted(spans):
        if joined and a <= joined[-1][1] + X.GAP:
            joined[-1][1] = max(joined[-1][1], b)
        else:
            joined.append([a, b])
    out, used = [], 0
    for a, b in joined:
        if used >= most:
            break
        part = text[a:b].strip()
        out.append(("... " if a else "") + part + (" ..." if b < len(text) else ""))
        used += len(part) + 2
    return "\n\n".join(out)[:most]


def test_windows(spark):
    rnd = random.Random(5)
    filler = lambda n: " ".join(rnd.choice(["вода", "труба"]) for _ in range(n))
    texts = {1: filler(2000) + " насос " + filler(3000) + " насос кран " + filler(100), 2: "насос", 3: filler(3000), 4: "насос" * 3 + filler(900) + "Насос"}
    df = spark.createDataFrame([(k, "gas", "p", "n", v, 1) for k, v in texts.items()], DOC)
    for most in (1000, 6000, 50_000):
        got = {r.entry_id: r.context for r in X.windowed(df, ["насос", "кран"], most).collect()}
        assert got == {k: windowed(v, ["насос", "кран"], most) for k, v in texts.items()}
    empty = spark.createDataFrame([(9, "gas", "p", "n", None, 1), (10, "gas", "p", "n", " ", 1)], DOC)
    assert X.windowed(empty, ["насос"], 10).count() == 0 and X.windows(df, []).count() == 0


def test_contents_page_ranks_last(spark):
    rows = [(1, 1, "gas", 1, "Оглавление 8. Пусконаладочные работы 8"), (2, 1, "gas", 12, "Первый запуск. Откройте кран. Запустите насос. Проверьте давление."), (3, 1, "gas", 13, None)]
    got = X.narrow(spark.createDataFrame(rows, PAGE), T.query_terms("первый запуск установки"), 80).first().context
    assert "[стр. 12]" in got and "Первый запуск" in got


def test_contexts_for_a_query(spark, docs, files, pages):
    meta = spark.createDataFrame([("gas", "b/Акт.docx", "mammoth", 0.8, "partial", "неполно")], "slug string, path string, extractor string, confidence double, index_status string, index_note string")
    own = pages.filter("entry_id = 1")
    got = {r.path: r for r in X.for_query(docs, files, own, meta, "запуск", prefer_wide=False).collect()}
    assert got["b/Акт.docx"].text.startswith("[Индекс неполный: неполно]\n\nЗапуск") and got["b/Акт.docx"].rank == 1
    assert got["a/Паспорт насоса.pdf"].text.startswith("[стр. ")
    # three files in the scope: wide, two documents, one of which has no text and is not replaced
    assert {r.path for r in X.for_query(docs, files, own, meta, "zzz", scope="b").collect()} == {"b/Акт.docx"}
    assert X.width(None, 0, 3) is False and X.width(None, 3, 9) is True and X.width(None, 0, 2) is True and X.width(False, 1, 1) is False
    assert X.for_query(docs, files, own, meta, "запуск", wanted=["акт.docx"]).count() == 1


def test_messages(spark, docs, files, pages):
    none = spark.createDataFrame([], "rank int, path string, name string, text string, extractor string, confidence double")
    assert A.context_text(none).first().context == A.NOTHING
    one = spark.createDataFrame([(2, "b", "B", "два", None, None), (1, "a", "A", "один", "mammoth", 0.8)], none.schema)
    context = A.context_text(one)
    assert context.first().context == "[1] A (a) [extractor=mammoth, confidence=0.80]\nодин\n\n---\n\n[2] B (b)\nдва"
    past = spark.createDataFrame([("c", k, "user" if k % 2 else "system", f" m{k} ") for k in range(30)] + [("c", 99, "user", "  "), ("c", 98, "user", None)], "conv_id string, turn int, role string, content string")
    got = A.messages(context, "sys", "вопрос", past, "вложение").first().messages
    assert [m.content for m in got[1:-1]] == [f"m{k}" for k in range(15, 30, 2)] and got[0].role == "system" and got[-1].content.startswith("вопрос\n\nвложение\n\n---\n\n[1]")
    prompts = A.messages(context, "sys", "q")
    assert A.answered(prompts, lambda m: m[0]["role"]).first().answer == "system"
    assert A.answered(prompts, lambda m: 1 / 0).first().error.startswith("ZeroDivisionError")


@pytest.mark.parametrize("text, yes", [("покажи", True), ("Покажи подробный ответ", True), (" да. ", True), ("ПОДРОБНЕЕ!", True), ("Какие требования к газопроводу?", False), ("да, но сначала уточни", False), (None, False)])
def test_expand(spark, text, yes):
    assert spark.createDataFrame([(text,)], "t string").select(A.asks_to_expand(F.col("t")).alias("v")).first().v is yes


def test_requests_are_read_whole(spark, tmp_path):
    from scriptorium.plans.catalogue import QUERIES

    texts = {1: "Покажи полный перечень оборудования", 2: "  Перечень оборудования", 3: "Покажи полный ответ", 4: "да, но сначала уточни", 5: None, 6: "Да"}
    spark.createDataFrame([(k, "c", t) for k, t in texts.items()], "doc_id long, source string, text string").write.parquet(str(tmp_path / "documents.parquet"))
    got = {r.turn: (r.action, r.expand) for r in QUERIES["expand_requests"](spark, str(tmp_path)).collect()}
    assert got == {1: ("ask", False), 2: ("ask", False), 3: ("expand", True), 4: ("ask", False), 5: ("ignore", False), 6: ("expand", True)}


def test_conversations(spark):
    rows = [("c", k, "assistant" if k in (3, 7) else "user", "x", k in (3, 7)) for k in range(10)] + [("d", 1, "user", "y", False)]
    df = spark.createDataFrame(rows, "conv_id string, turn int, role string, content string, pending boolean")
    assert sorted(r.turn for r in A.pending(df).collect()) == list(range(8))
    assert A.last(df, 4).count() == 5
    acts = spark.createDataFrame([("/start", "idle", False, "g"), ("x", "search", False, None), ("x", "question", False, None), ("покажи", "idle", True, None), ("вопрос", "idle", False, "g"), ("ab", "idle", False, "g")], "content string, mode string, has_pending boolean, slug string")
    assert [r.action for r in A.routed(acts).collect()] == ["command", "search", "ask", "expand", "ask", "ignore"]


# --- library and catalog ----------------------------------------------------------------


def test_current_files(spark):
    rows = [("g", "a", "old", "file", 1, "2020-01-01"), ("g", "a", "new", "file", 2, "2021-01-01"), ("g", "a", "old", "file", 1, "2020-01-01"), ("g", "b", "x", None, None, None), ("g", "a", "none", "file", 3, None)]
    df = spark.createDataFrame(rows, "slug string, path string, name string, kind string, size long, modified_at string")
    assert {(r.path, r.name) for r in L.current_files(df).collect()} == {("a", "new"), ("b", "x")}
    assert L.current_files(df.limit(0)).count() == 0


def test_latest_meta_and_pages(spark):
    rows = [(1, "2020", "a", 0.1), (1, "2021", "b", None), (1, "2021", "b", None), (1, None, "z", 0.9), (2, None, None, None)]
    df = spark.createDataFrame(rows, "entry_id long, extracted_at string, extractor string, confidence double")
    assert {(r.entry_id, r.extractor) for r in latest_meta(df, "extractor", "confidence").collect()} == {(1, "b"), (2, None)}
    pages = spark.createDataFrame([(1, 1, "g", 1, "x"), (1, 1, "g", 1, "x"), (2, 1, "g", 3, None)], PAGE)
    assert distinct_pages(pages).count() == 2


def test_directions_and_folders(spark, files):
    table = spark.createDataFrame([("gas", " Газ ", None), ("electro", "  ", None), ("x", None, None), ("_bad", "b", None)], "slug string, title string, created_at timestamp")
    got = {r.slug: r for r in L.directions(table).collect()}
    assert {k: v.title for k, v in got.items()} == {"gas": "Газ", "electro": "electro", "x": "x"} and got["gas"].created_at.year == 1970
    assert {(r.path, r.parent, r.depth, r.files) for r in L.folders(files.filter("slug = 'gas'")).collect()} == {("a", "", 1, 1), ("b", "", 1, 4), ("c", "", 1, 2)}
    shown = {(r.kind, r.path) for r in L.listing(files.filter("slug = 'gas'"), "b").collect()}
    assert shown == {("file", p) for p in ("b/Акт.docx", "b/запуск.txt", "b/Запуск схема.png", "b/x.exe")}
    view = {r.slug: r for r in L.folder_view(table, files).collect()}
    assert [f.name for f in view["gas"].folders] == ["a", "b", "c"] and view["x"].folders is None
    assert L.retitle(table, "gas", " Новый ").filter("title = 'Новый'").count() == 1
    with pytest.raises(LookupError):
        L.retitle(table, "nope", "t")
    with pytest.raises(ValueError):
        L.retitle(table, "gas", " ")


def test_changes(spark, files):
    assert {r.path for r in L.rename_folder(files, "gas", "b", "d").filter("slug = 'gas'").collect()} >= {"d/Акт.docx", "a/Паспорт насоса.pdf"}
    with pytest.raises(FileExistsError):
        L.rename_folder(files, "gas", "b", "c")
    with pytest.raises(LookupError):
        L.rename_folder(files, "gas", "zz", "d")
    with pytest.raises(ValueError):
        L.delete_folder(files, "gas", "b")
    assert L.delete_folder(files, "gas", "b", recursive=True).filter("path like 'b/%'").count() == 0
    assert L.delete_file(files, "gas", "b/Акт.docx").count() == files.count() - 1
    counts = L.reindex_counts(spark.createDataFrame([(True, 5), (True, 0), (False, 0)], "ok boolean, chars int")).first()
    assert (counts.processed, counts.updated, counts.failed) == (3, 1, 1)


def test_catalog_merge(spark, files):
    stored = "slug string, path string, doc_id string, title string, doc_type string, topics array<string>, aliases array<string>, references array<string>, sections_hint map<string,string>, priority int"
    rows = [("gas", "b/Акт.docx", " ", "Акт приёмки", "law", [], ["акт", "Акт.docx"], ["СП 1"], {"1": "x"}, None), ("gas", "c/нет.txt", None, None, None, None, None, None, None, 3)]
    got = {r.path: r for r in K.merge(K.infer(files.filter("slug = 'gas'")), spark.createDataFrame(rows, stored)).collect()}
    one = got["b/Акт.docx"]
    assert (one.title, one.doc_type, one.priority, one.aliases, one.references, one.sections_hint) == ("Акт приёмки", "law", 1, ["Акт.docx", "акт"], ["СП 1"], {"1": "x"})
    assert got["c/нет.txt"].priority == 3 and got["a/Паспорт насоса.pdf"].doc_type == "other" and "b/x.exe" not in got
    assert [r.priority for r in K.in_order(K.infer(files)).collect()] == sorted((r.priority for r in K.infer(files).collect()), reverse=True)
    changed = K.set_type(K.infer(files), "gas", "b/Акт.docx", "law").filter("path = 'b/Акт.docx'").first()
    assert changed.doc_type == "law" and changed.priority == 1
    with pytest.raises(ValueError):
        K.set_type(K.infer(files), "gas", "x", "novel")


def test_upsert(spark):
    old, new = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string"), spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(tuple(r) for r in L.upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]


# --- jobs -------------------------------------------------------------------------------


def step(state, kind):
    status, done, failed = state
    move = {"queued": ((None,), "queued"), "started": (("queued",), "running"), "finished": (("running",), "done"), "failed": (("running",), "failed")}
    if kind in move and status in move[kind][0]:
        return move[kind][1], done, failed
    if status == "running" and kind == "file_done":
        return status, done + 1, failed
    if status == "running" and kind == "file_failed":
        return status, done, failed + 1
    return state


def test_fold_against_a_state_machine(spark):
    rnd = random.Random(8)
    rows = [(f"j{rnd.randint(1, 12)}", f"2024-01-01 00:{k // 60:02d}:{k % 60:02d}", k, rnd.choice(Jobs.KINDS)) for k in range(400)]
    expected = {}
    for job, _, _, kind in rows:
        expected[job] = step(expected.get(job, (None, 0, 0)), kind)
    events = spark.createDataFrame(rows + rows[:50], "job_id string, at string, event_id long, kind string").withColumn("at", F.col("at").cast("timestamp"))
    got = {r.job_id: (r.status, r.processed, r.failed) for r in Jobs.fold(events).collect()}
    assert got == {k: v for k, v in expected.items() if v[0]}
    assert Jobs.fold(events.limit(0)).count() == 0


def test_queue_and_lists(spark):
    rows = [("a", "g", "running", 0, 1, None), ("b", "g", "queued", 1, None, 3), ("c", "g", "queued", 2, None, 2), ("d", "g", "done", 3, 5, None), ("e", "h", "queued", 1, None, None)]
    jobs = spark.createDataFrame(rows, "job_id string, slug string, status string, queued_at int, started_at int, queue_position int").withColumn("scope_path", F.lit("tkp")).withColumn("current_file", F.lit(None).cast("string"))
    got = {r.job_id: r.queue_position for r in Jobs.queue(jobs.drop("queue_position"), "slug").collect()}
    assert got == {"b": 2, "c": 3, "e": 1}
    assert [r.job_id for r in Jobs.listed(jobs).collect()] == ["c", "b", "a", "e"] and Jobs.listed(jobs, "other").count() == 0
    assert [r.job_id for r in Jobs.pruned(jobs, 2).collect()] == ["d", "a"]
    asked = spark.createDataFrame([("g", "tkp"), ("g", "new")], "slug string, scope_path string")
    assert [r.scope_path for r in Jobs.accepted(jobs, asked).collect()] == ["new"]
    both = Jobs.merged(spark.createDataFrame([("a", 1, "x")], "job_id string, updated_at int, v string"), spark.createDataFrame([("a", 2, "y"), ("b", 1, "z")], "job_id string, updated_at int, v string"))
    assert sorted(tuple(r) for r in both.collect()) == [("a", 2, "y"), ("b", 1, "z")]


def test_uploads_and_refusals(spark):
    from datetime import datetime

    from scriptorium.operators import library as L

    at = lambda k: datetime(2024, 1, k)
    sent = spark.createDataFrame(
        [("gas", " a\\b ", "x y.pdf", 5, at(1)), ("gas", "a/b", "x y.pdf", 7, at(2)), ("gas", "", "n.exe", 1, at(1)), ("gas", "../x", "n.txt", 1, at(1)), ("Bad", "", "n.txt", 1, at(1)), ("gas", "", "m?.TXT", None, None)],
        "slug string, folder string, filename string, size long, modified_at timestamp",
    )
    got = {r.path: r for r in L.uploaded(sent).collect()}
    assert set(got) == {"a/b/x y.pdf", "m_.TXT"} and got["a/b/x y.pdf"].size == 7 and got["m_.TXT"].content_type.startswith("text/plain") and not got["m_.TXT"].has_text
    assert L.uploaded(sent.limit(0)).count() == 0
    rows = [(1, "gas", "a.png", 1, "image"), (1, "gas", "a.pdf", 1, "document"), (2, "gas", "a.pdf", 300 << 20, None), (3, "gas", "a.exe", 1, None), (4, "gas", "a.pdf", 1, "image")] + [(5, "gas", f"{k}.txt", 1, None) for k in range(21)]
    refused = {r.request: r.error for r in L.refused(spark.createDataFrame(rows, "request int, slug string, filename string, size long, field string")).collect()}
    assert refused == {1: "image_and_document", 2: "file_too_large", 3: "invalid_filename", 5: "too_many_files"}


def test_folders_sidecars_and_reindexing(spark):
    from scriptorium.operators import library as L

    files = spark.createDataFrame([("s", "a/x.pdf"), ("s", "y.txt")], "slug string, path string")
    made = L.make_folder(L.make_folder(spark.createDataFrame([], "slug string, path string"), "s", "b/c"), "s", "b/c")
    assert {(r.path, r.files) for r in L.folders(files, made).collect()} == {("a", 1), ("b", 0), ("b/c", 0)}
    stored = spark.createDataFrame([("s", "a/x.pdf" + k) for k in ("", ".extracted.txt", ".extracted.meta.json", ".extracted.pages.json", ".library.json")], "slug string, path string")
    assert [r.path for r in L.without_sidecars(stored, files).collect()] == ["a/x.pdf"]
    assert {r.path for r in L.without_sidecars(stored, files, catalog=False).collect()} == {"a/x.pdf", "a/x.pdf.library.json"}
    texts = spark.createDataFrame([("s", "a/x.pdf", "alt"), ("s", "y.txt", "bleibt"), ("s", "z.txt", "weg")], "slug string, path string, text string")
    results = spark.createDataFrame([("s", "a/x.pdf", "neu", "pdftotext", None), ("s", "z.txt", None, "plain-text", None), ("s", "q.doc", None, None, "BadFile")], "slug string, path string, text string, extractor string, error string")
    assert {(r.path, r.text) for r in L.reindexed(texts, results).collect()} == {("a/x.pdf", "neu"), ("y.txt", "bleibt")}
    assert {(r.path, r.ok, r.chars, r.error) for r in L.reindex_results(results).collect()} == {("a/x.pdf", True, 3, None), ("z.txt", False, 0, "extract_no_text"), ("q.doc", False, 0, "BadFile")}


def test_places_in_order(spark):
    from scriptorium.operators import library as L

    own = spark.createDataFrame([(k * 7 % 101, k % 3) for k in range(101)], "v int, g int")
    got = L.with_place(own, F.desc("v")).orderBy("place").collect()
    assert [r.v for r in got] == list(range(100, -1, -1)) and [r.place for r in got] == list(range(1, 102))
    assert L.with_place(own.limit(0), "v").count() == 0
