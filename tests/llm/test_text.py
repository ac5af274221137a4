"""Wrong encodings, noise of scanning, look-alikes, subject areas and cut texts."""

import random
import re
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import p2_encoding as p2
from scriptorium.llm import p3_scan as p3
from scriptorium.llm import p4_forms as p4
from scriptorium.llm import p5_areas as p5
from scriptorium.llm import p9_cut as p9

SENTENCES = [
    "Ответственное лицо проверяет состояние заземляющего устройства не реже одного раза в год.", "Результаты проверки заносятся в журнал, а копия хранится десять лет.", "Запрещается продолжать работу без осмотра силового трансформатора под роспись.",
    "Показатель «ток короткого замыкания» фиксируется на уровне 12 кА.", "К вводу в действие кабельной линии допускаются лица с удостоверением № 14.", "Температура подающего трубопровода не превышает 95 °C зимой.",
    "Die Prüfung für Heizkessel erfolgt alle fünf Monate gemäß Blatt 12.", "Zusätzlich bleibt die Übergabe für Wärmetauscher offen.", "The value “heating load” stays below 100 kW at the owner’s expense.", "Праверка вадзяной свідравіны праводзіцца раз на год, пра што робіцца запіс.",
]


def make(rnd, n):
    return " ".join(rnd.choice(SENTENCES) for _ in range(n))


# --- wrong encodings --------------------------------------------------------------------

ENTRY = "entry_id long, slug string, path string, name string, text string, chains int, restored string"


@pytest.fixture(scope="module")
def entries(spark):
    rnd = random.Random(2)
    rows = [(k, "s", "p", "n", make(rnd, rnd.randint(3, 9)), 0, "") for k in range(120)]
    ru = SENTENCES[:6]
    chains = [(("utf-8", "cp1251"),), (("utf-8", "latin-1"),), (("utf-8", "cp1252"),), (("cp1251", "cp1252"),), (("cp1251", "cp866"),), (("koi8-r", "cp1251"),), (("utf-8", "cp1251"), ("utf-8", "cp1251")), (("cp866", "cp1251"),)]
    bad = {}
    for k, chain in enumerate(chains, 200):
        part = " ".join(rnd.sample(ru[:3], 3))
        whole = part if k % 2 else f"{SENTENCES[4]}\n{part}\n{SENTENCES[1]}"
        text = p2.garble(part, chain) if k % 2 else f"{SENTENCES[4]}\n{p2.garble(part, chain)}\n{SENTENCES[1]}"
        rows.append((k, "s", "p", "n", text, 0, ""))
        bad[k] = whole
    rows.append((300, "s", "p", "n", ru[0] + " " + p2.garble(ru[1], (("cp1251", "utf-8"),)), 0, ""))
    fine = ["工業 標準 です", "┌──┬──┐\n│ 1 │ 2 │\n└──┴──┘", "Müßig & Söhne, São Limão «à propos» ±5 % §12", "ПРОВЕРКА ЗАЗЕМЛЯЮЩЕГО УСТРОЙСТВА", "Джерело: їжа, ґанок, єдність", None, "", "x" * 50_000 + " конец"]
    rows += [(400 + k, "s", "p", "n", t, 0, "") for k, t in enumerate(fine)]
    rows.append(rows[-9])
    return spark.createDataFrame(rows, ENTRY), bad


def test_garbled_entries_are_found_and_restored(entries):
    df, bad = entries
    assert {r.entry_id for r in p2.found(df).collect()} == {*bad, 300}
    got = {r.entry_id: r for r in p2.garbled(df).collect()}
    assert {k: got[k].text for k in bad} == bad and all(got[k].restored for k in bad)
    assert not got[300].restored and "�" in got[300].text


def test_rates_and_empty_tables(spark, entries):
    df, _ = entries
    meta = spark.createDataFrame([(200, "2020", "mammoth"), (200, "2019", "x"), (1, "2020", "mammoth")], "entry_id long, extracted_at string, extractor string")
    got = {r.extractor: (r.entries, r.garbled) for r in p2.rates(df, meta).collect()}
    assert got["mammoth"] == (2, 1)
    assert p2.found(df.limit(0)).count() == 0 and p2.found(df.filter("text is null")).count() == 0


def test_words_of_all_texts_are_known(spark):
    rows = [(k, "x" * 20_000 + " замыкание" if k == 0 else SENTENCES[k % 6]) for k in range(40)] + [(100 + k, "Перечень: «шпунтованный» настил.") for k in range(4)]
    bad = p2.garble("замыкания", (("cp1251", "cp1252"),))
    rows += [(200 + k, f"Показатель {bad} фиксируется.") for k in range(3)]
    df = spark.createDataFrame(rows, "entry_id long, text string")
    own = {r.entry_id for r in p2.bounded_sample(df, "entry_id", 6).collect()}
    model = p2.train(df, sample=6)
    assert not own >= set(range(100, 104)) and "шпунтованный" in model.known and "настил" in model.known
    assert bad not in model.known
    assert p2.train(df.filter("entry_id = 0")).often["к"] == 1  # the end of a long text


def test_all_texts_teach_the_bigrams(spark):
    ids = spark.range(2600).withColumnRenamed("id", "entry_id")
    first = {r.entry_id for r in p2.bounded_sample(ids.withColumn("text", F.lit("x")), "entry_id", 2400).collect()}
    df = spark.createDataFrame([(k, "замыкание" if k in first else "größe") for k in range(2600)], "entry_id long, text string")
    model = p2.train(df)
    assert model.right(["größe"])[0] > model.right(["grüße"])[0] + 1 and model.often["ö"] == 200 and model.often["з"] == 2400


@pytest.mark.parametrize("chain", [c for c in p2.chains() if c[-1][1] != "utf-8"])
def test_chains_can_be_inverted(chain):
    word = "größe" if chain[0][0] == "cp1252" else "замыкания"
    assert p2.invert(p2.garble(word, chain), chain) == word


# --- scanning ---------------------------------------------------------------------------

PAGE = "page_id long, entry_id long, slug string, page int, text string, split string, places int"
BODY = ["ответственное лицо проверяет состояние", "заземляющего устройства в присутствии", "двух свидетелей и заносит результаты", "проверки в журнал, копия хранится год."]


@pytest.fixture(scope="module")
def scanned(spark):
    rows = []
    for k in range(60):  # enough clean pages for counts
        rows.append((k, 1000 + k, "s", 1, "Правила проверки\n" + "\n".join(BODY), "", 0))
    noisy = {
        500: ("\n".join(BODY).replace("состояние\nзаземляющего", "состо-\nяние заземляющего"), {"split"}),
        501: ("\n".join(BODY).replace("состояние\nзаземляющего", "состо¬\nяние заземляющего"), {"split"}),
        502: ("\n".join(BODY).replace("журнал", "журна/1"), {"misread"}),
        503: ("\n".join(BODY).replace("присутствии", "прису7ствии"), {"misread"}),
        504: ("\n".join(BODY).replace("свидетелей", "свидстслсй"), set()),  # three letters wrong: not linked
        505: ("\n".join([*BODY, "- 3 -"]), {"numbered"}),
        506: ("\n".join(["стр. 2", *BODY]), {"numbered"}),
        507: ("\n".join([*BODY[:2], "68", "33", *BODY[2:]]), set()),
    }
    for k, (text, _) in noisy.items():
        rows.append((k, 2000 + k, "s", 3 if k == 505 else 2, text, "", 0))
    for p in range(1, 5):
        head = "ТД-41. Редакция 7" if p != 3 else "ТД-4l. Рсдакция 7"
        rows.append((600 + p, 3000, "s", p, "\n".join([f"{head}    {p}", f"{p} раз " + BODY[0], *BODY[1:]]), "", 0))
    rows += [(700, 4000, "s", 1, None, "", 0), (701, 4000, "s", 2, "", "", 0), (702, 4000, "s", None, "x" * 40_000, "", 0), rows[-1], rows[60]]
    return spark.createDataFrame(rows, PAGE), noisy


def test_kinds_of_noise(scanned):
    df, noisy = scanned
    got = {r.page_id: r for r in p3.noise(df).collect()}
    assert len(got) == df.select("page_id").distinct().count()
    for k, (_, kinds) in noisy.items():
        assert {x for x in ("split", "misread", "running", "numbered") if got[k][x]} == kinds, k
    assert all(got[600 + p].running for p in range(1, 5))
    assert not any(got[k][x] for k in (0, 1, 700, 701, 702) for x in ("split", "misread", "running", "numbered"))
    found = [r.page_id for r in p3.found(df).collect()]
    assert sorted(found) == sorted({k for k, (_, kinds) in noisy.items() if kinds} | {601, 602, 603, 604})


def test_paragraphs(scanned):
    df, _ = scanned
    got = {r.page_id: r.text for r in p3.paragraphs(df).collect()}
    clean = " ".join(BODY)
    for k in (500, 501, 502, 503, 505, 506):
        assert got[k] == clean, k
    assert "Редакция" not in got[602] and "Рсдакция" not in got[603]
    assert got[700] is None and got[701] == ""


def test_scan_of_empty_tables(scanned):
    df, _ = scanned
    assert p3.found(df.limit(0)).count() == 0 and p3.paragraphs(df.filter("text is null")).count() == 1


def test_running_lines_misread_anywhere(spark):
    heads = {
        1: ["Приказ № 2447", "Приказ № 2447", "Прик.з № 2447", "Прика1 № 2447"],  # beside lines that repeat
        2: ["Памятка № 344", "Памя.ка № 344"],  # each stands once
        3: ["Журнал № 17", "Журнал № 17", "Отчёт № 52", "Отчёт № 52", "Жур.ал № 17", "Отч.т № 52"],  # like the less frequent line too
        4: ["Раздел первый", "Схема соединений", "Перечень кабелей"],
    }
    rows = [(10 * e + k, e, "s", k + 1, "\n".join(["9    " + head, *SENTENCES[k : k + 3]]), "", 0) for e, own in heads.items() for k, head in enumerate(own)]
    got = {r.page_id for r in p3.noise(spark.createDataFrame(rows, PAGE)).filter("running").collect()}
    assert got == {r[0] for r in rows if r[1] != 4}


def test_two_letters_with_a_digit_may_be_a_very_frequent_word():
    reader = p3.Reader({"по": 40_000, "бы": 40_000, "пт": 40, "состояние": 9_000, "т0": 900, "то": 50_000}, 3, {})
    assert reader.best("п0", []) == "по" and reader.best("6ы", []) == "бы" and reader.misread("Инструкция п0 передаче графика")
    assert not reader.link("п7") and not reader.link("П0") and not reader.link("т0") and not reader.link("ж0")


def test_context_decides_doubtful_misreadings():
    rnd = random.Random(3)
    texts = [[rnd.choice(["насос", "клапан"]), "установка", "трубы", rnd.choice(["воды", "пара"])] * 3 if k % 2 else [rnd.choice(["урок", "класс"]), "тетрадь", "школы", rnd.choice(["дети", "книга"])] * 3 for k in range(300)]
    vectors = p3.skip_gram(texts)
    counts = Counter(w for t in texts for w in t) | {"трубы": 30}
    reader, blind = p3.Reader(counts, 6, vectors), p3.Reader(counts, 6, {})
    # thirty are too few beside a rare word of letters, but not among words that stand beside them
    fits, strange = "насос установка трубьг воды насос установка", "урок тетрадь трубьг дети урок тетрадь"
    assert reader.misread(fits) and not reader.misread(strange) and not blind.misread(fits)
    assert "трубы" in reader.correct(fits) and "трубьг" in reader.correct(strange) and "трубьг" in blind.correct(fits)


def test_skip_gram_brings_words_of_like_contexts_together():
    import numpy as np

    rnd = random.Random(1)
    texts = [[rnd.choice("ab"), "x", rnd.choice("cd"), "y"] * 4 if rnd.random() < 0.5 else [rnd.choice("ef"), "z", rnd.choice("gh"), "w"] * 4 for _ in range(400)]
    v = p3.skip_gram(texts, size=8)
    cos = lambda a, b: float(np.dot(v[a][0], v[b][0]) / (np.linalg.norm(v[a][0]) * np.linalg.norm(v[b][0])))
    assert cos("a", "b") > cos("a", "e")
    assert p3.skip_gram([]) == {}


def test_vectors_are_of_all_pages(spark):
    rnd = random.Random(8)
    ids = p2.bounded_sample(spark.range(1900).select(F.col("id").alias("page_id"), F.lit("x").alias("text")), "page_id", 1500, 2_000_000)
    first = {r.page_id for r in ids.collect()}
    rows = [(k, k // 9, "s", 1, f"насос качает {rnd.choice(['воду', 'пар'])}" if k in first else f"класс читает {rnd.choice(['книгу', 'тетрадь'])}") for k in range(1900)]
    reader = p3.learn(spark.createDataFrame(rows, "page_id long, entry_id long, slug string, page int, text string"))
    assert {"насос", "воду", "класс", "книгу", "тетрадь"} <= set(reader.place)
    near = lambda a, b: float(reader.own[reader.place[a]] @ reader.context[reader.place[b]])
    assert near("класс", "книгу") > 0.5 > near("класс", "воду")
    # as from a list of the texts
    alone = p3.skip_gram([r[4].split() for r in rows])
    assert abs(near("класс", "книгу") - float(alone["класс"][0] @ alone["книгу"][1])) < 1e-3


# --- look-alikes ------------------------------------------------------------------------


@pytest.fixture(scope="module")
def forms():
    usual = "проверка заземляющего устройства № 12 °C mg kg fix \u00c4 \u00f6 \u0439 \u0451 " * 50
    odd = "１２ （３） ㎎ ﬁ 𝟭𝟮 ₁ \xa0 \u200b\xad\ufeff ℃ Ａ"
    counts = Counter(usual + odd) + Counter({"и\u0306": 2, "е\u0308": 2, "A\u0308": 2})
    return p4.Forms(counts).rewriter()


@pytest.mark.parametrize(
    "text, right",
    [
        ("№ １２, стр（３）", "№ 12, стр(3)"), ("5 ㎎ ﬁx", "5 mg fix"), ("𝟭𝟮₁", "121"), ("а\xa0б в", "а б в"), ("на\u200bсос\xad\ufeff", "насос"), ("маи\u0306", "ма\u0439"), ("сче\u0308т A\u0308", "сч\u0451т \u00c4"), ("20 ℃", "20 °C"),
        ("нac\u006fс", "насос"), ("h\u0430nd\u043ever", "handover"), ("п\u03bfсле", "после"), ("Ａ", "A"), ("SCADA-система", "SCADA-система"), ("ok", "ok"), ("", ""),
    ],
)
def test_one_form(forms, text, right):
    assert forms(text) == right
    assert forms(forms(text)) == forms(text)


def test_suspects_are_all_affected_texts(forms):
    texts = ["чисто", "нaсос", "", "a-б", "１", "x" * 1000, "и\u0306"]
    assert forms.suspects(texts) == [1, 4, 6] and [forms.affected(t) for t in texts] == [False, True, False, False, True, False, True]
    assert forms.suspects([]) == []


def test_union_find_is_transitive():
    c = p4.Classes()
    c.join("a", "b"), c.join("c", "d"), c.join("b", "d")
    assert c.find("a") == c.find("c") and len(c.members()) == 1


def test_found_forms(spark, entries):
    df, bad = entries
    pages = spark.createDataFrame([(1, 1, "s", 1, "насос １２"), (1, 1, "s", 1, "насос １２"), (2, 1, "s", 2, "чисто № 5 °"), (3, 1, "s", 3, None), (4, 1, "s", 4, ""), (5, 1, "s", 5, "нaсос " * 5000)], "page_id long, entry_id long, item_id string, page int, text string")
    more = df.unionByName(spark.createDataFrame([(900, "s", "p", "n", SENTENCES[0] + " нaсос", 0, "")], ENTRY))
    got = {(r.origin, r.item_id) for r in p4.found(pages, more).collect()}
    assert got == {("page", 1), ("page", 5), ("entry", 900)}
    texts = {(r.origin, r.item_id): r.text for r in p4.consistent(pages, more).collect()}
    assert texts["page", 1] == "насос 12" and texts["page", 3] is None and texts["page", 4] == "" and texts["entry", 900].endswith("насос") and texts["entry", 201] == bad[201]
    assert p4.found(pages.limit(0), df.limit(0)).count() == 0
    assert {(r.form, r.stands_for) for r in p4.classes(pages, more).collect()} >= {("U+FF11", "U+0031"), ("U+FF12", "U+0032")}


# --- subject areas ----------------------------------------------------------------------

TOPICS = {"power": ["трансформатора", "подстанции", "кабельной", "заземления", "напряжения"], "water": ["мембраны", "пермеата", "скважины", "реагента", "фильтра"], "labour": ["отпуска", "договора", "табеля", "взыскания", "расписания"]}


@pytest.fixture(scope="module")
def subjects(spark):
    rnd = random.Random(6)
    frame = ["порядок проверки {} определяет начальник", "результаты осмотра {} заносятся в журнал", "срок ремонта {} назначает комиссия"]
    plain = ["ознакомление завершает смежный отдел", "рассылка выполнена по списку адресов", "перечень приложений приведён на листе"]
    say = lambda a: rnd.choice(frame).format(rnd.choice(TOPICS[a])).capitalize() + "."
    rows, truth, labels = [], {}, []
    for k in range(400):
        main, other = rnd.sample(list(TOPICS), 2)
        mixed = rnd.random() < 0.15
        n = rnd.randint(10, 16)
        about = [main] * (n // 2 if mixed else n - 1) + [other] * (n // 2 if mixed else 1)
        own = [say(a) for a in about] + [rnd.choice(plain).capitalize() + "." for _ in range(2)]
        rnd.shuffle(own)
        truth[k] = {main, other} if mixed else {main}
        rows.append((k, f"dir-{main}" if rnd.random() < 0.8 else "misc", " ".join(own), "x"))
        if k % 4 == 0:
            for a in truth[k] if rnd.random() > 0.08 else {rnd.choice(list(TOPICS))}:
                labels.append((k, a, "a1"))
    rows += [(900, "misc", None, ""), (901, "misc", "", ""), (902, None, " ".join(plain[:1]) + ".", ""), (903, "misc", p2.garble(" ".join(say("water") for _ in range(12)), (("utf-8", "cp1251"),)), "")]
    truth[903] = {"water"}
    docs = spark.createDataFrame(rows + rows[:1], "entry_id long, slug string, text string, subject string")
    areas = spark.createDataFrame([("power", "Электрика"), ("water", "Вода"), ("labour", None), ("sport", "Спорт")], "subject string, title string")
    directions = spark.createDataFrame([("dir-power", "Электрика"), ("misc", None)], "slug string, title string")
    return docs, spark.createDataFrame(labels + labels[:1] + [(1, None, "a2"), (999, "power", "a2")], "entry_id long, subject string, annotator string"), areas, directions, truth


def test_areas(spark, subjects):
    docs, labels, areas, directions, truth = subjects
    got = [(r.entry_id, r.subject) for r in p5.assigned(docs, labels, areas, directions).collect()]
    assert len(got) == len(set(got)) and not {900, 901} & {e for e, _ in got}
    want = {(e, a) for e, own in truth.items() for a in own}
    assert len(want & set(got)) / len(want) > 0.95 and len(want & set(got)) / len(got) > 0.95
    assert (903, "water") in got
    shares = {r.subject: r for r in p5.composition(docs, labels, areas, directions).collect()}
    assert shares["sport"].entries == 0 and sum(r.entries for r in shares.values()) == len(got)


def test_areas_without_labels(subjects):
    docs, labels, areas, directions, _ = subjects
    assert p5.assigned(docs, labels.limit(0), areas, directions).count() == 0
    assert p5.assigned(docs.limit(0), labels, areas, directions).count() == 0


def test_all_entries_teach_areas(spark, subjects):
    _, _, areas, directions, _ = subjects
    plain = spark.range(3300).select(F.col("id").alias("entry_id"), F.lit("x").alias("text"))
    first = {r.entry_id for r in p2.bounded_sample(plain, "entry_id", 3000, 24_000_000).collect()}
    rows = [(k, "misc", "Ремонт трансформатора назначает комиссия." if k in first else "Промывка мембраны назначает комиссия.") for k in range(3300)]
    docs = spark.createDataFrame(rows, "entry_id long, slug string, text string")
    labels = spark.createDataFrame([(k, "power" if k in first else "water") for k in range(3300)], "entry_id long, subject string")
    model, entries = p5.train(docs, labels, areas, directions, p2.shared(spark, p2.train(docs.limit(50))))
    water = model.terms.log[[model.terms.of["cпромыв"], model.terms.of["cмембра"]], model.areas.index("water")]
    assert entries.count() == 3300 and (water > 0.5).all(), water


def test_terms_are_split_together():
    """Terms of many texts are found at once, as those of each sentence alone."""
    rnd = random.Random(3)
    texts = [make(rnd, rnd.randint(1, 9)) for _ in range(60)] + ["", " ", "....", "Щука плыла. Über Maß žluť", "слово-\n вое Ⅳглава word_word x²½¼. Ещё", "ΟΔΟΣΙΣ. İstanbulİs", "Ёмкость № 5! «Насос насоса насосный»"]
    want = []
    for text in texts:
        kind, joined = p5.writing(text), re.sub(r"(?<=[^\W\d_])[-‐¬\xad][ \t\r]*\n[ \t]*(?=[^\W\d_])", "", text)
        own = [{kind + w[:6] for w in re.findall(r"[^\W\d_]{4,}", s.lower())} for s in p5._SENTENCE.split(joined)]
        want.append([s for s in own if s])
    words, spots, terms, sizes, per = p5.said(texts)
    name = {h: "clmd"[k] + words[a:b] for h, k, a, b in spots.tolist()}
    sentences = iter(np.split(terms, np.cumsum(sizes)[:-1]))
    got = [[{name[h] for h in next(sentences).tolist()} for _ in range(n)] for n in per]
    assert got == want and len(set(name.values())) == len(name)


def test_texts_are_restored_together(spark):
    rnd = random.Random(4)
    right = [make(rnd, 6) for _ in range(40)]
    texts = right + [p2.garble(t, (("utf-8", "cp1251"),)) for t in right[:10]] + ["plain", "", "� � текст"]
    model = p2.train(spark.createDataFrame(list(enumerate(right)), "entry_id long, text string"))
    assert p2.Repairer(model).restored(texts) == [p2.Repairer(model).restore(t)[0] for t in texts]


# --- cut texts --------------------------------------------------------------------------

DOCUMENT = "doc_id long, source string, text string, score string, cut int, same string"
CLOSINGS = ["", "\n\nСоставлено 12.04.2009", "\n\nКОНЕЦ ДОКУМЕНТА", "\n\n1) ведомость\n2) копия паспорта", "\n\nИтого\t12\t15"]


@pytest.fixture(scope="module")
def cut(spark):
    rnd = random.Random(9)
    rows, gone = [], set()
    for k in range(900):
        text, source = make(rnd, rnd.randint(3, 9)) + rnd.choice(CLOSINGS), rnd.choice(["whole", "limit", "transfer", None])
        if source == "limit" and len(text) > 400:
            text = text[:400]
        elif source == "transfer" and rnd.random() < 0.2:
            text = text[: rnd.randint(60, len(text) - 30)] + rnd.choice(["", "…", " ", "...", "�"])
        else:
            rows.append((k, source, text, "", 0, ""))
            continue
        solid = text.rstrip(" …�").removesuffix("...")
        if solid[-1] not in ".!»":
            gone.add(k)
        rows.append((k, source, text, "", 0, ""))
    some = next(r for r in rows if r[0] in gone)
    rows += [(5000, "whole", some[2], "", 0, ""), (5001, "whole", None, "", 0, ""), (5002, None, "", "", 0, ""), (5003, None, " \n ", "", 0, ""), rows[0]]
    return spark.createDataFrame(rows, DOCUMENT), gone, some[0]


def test_cut_texts(cut):
    df, gone, some = cut
    got = {r.doc_id for r in p9.found(df).collect()}
    assert (5000 in got) == (some in got)  # a copy in a source that cuts nothing
    got -= {5000}
    assert len(got & gone) / len(gone) > 0.93 and len(got & gone) / len(got) > 0.93
    assert not {5001, 5002, 5003} & got
    rates = {r.source: r for r in p9.rates(df).collect()}
    assert rates["limit"].rate > 0.3 > rates["whole"].rate and sum(r.records for r in rates.values()) == df.count()
    assert ("limit", "c", 400) in {(r.source, r.kind, r.length) for r in p9.limits(df).collect()}


@pytest.mark.parametrize(
    "after, kind",
    [("", "none"), (" ", "space"), (" " * 200, "space"), ("\n" * 500 + "\t", "space"), ("�" * 100, "broken"), (" �" * 90, "broken"), ("…" + " " * 100, "mark"), (" " * 100 + "[…] далее", "mark"), ("…" * 100, "mark")],
)
def test_what_stands_after_a_cut_is_taken_off(after, kind):
    assert p9.stripped("Проверка кабельной ли" + after) == ("Проверка кабельной ли", kind)


def test_held_out_accuracy():
    import numpy as np

    rnd = random.Random(3)
    texts = [(make(rnd, rnd.randint(3, 9)) + rnd.choice(CLOSINGS), frozenset()) for _ in range(1500)]
    rows, y, w = p9.examples(texts)
    k = len(rows) * 4 // 5
    model = p9.fit(rows[:k], y[:k], w[:k])
    assert ((model.score(rows[k:]) > 0.5) == (y[k:] > 0.5)).mean() > 0.95 and isinstance(y, np.ndarray)


def test_cut_in_empty_tables(cut):
    df, _, _ = cut
    assert p9.found(df.limit(0)).count() == 0 and p9.rates(df.filter(F.col("text").isNull())).count() == 1


def test_letters_with_several_marks_and_frequent_forms(spark):
    texts = ["Việt Nam và ệ", "e\u0323\u0302 và Vie\u0323\u0302t", "сей\u0306 и и\u0306", "z\u0335\u0336\u0337 z"]
    df = spark.createDataFrame([(t,) for t in texts] * 3, "text string")
    forms = p4.learn(df)
    rewrite = forms.rewriter()
    assert rewrite(texts[1]) == "ệ và Việt" and rewrite(texts[2]).endswith("и й") and rewrite(texts[3]) == texts[3]
    # the most frequent form of a class stands for it
    often = p4.Forms(Counter({"…": 9_000_000, ".": 10, "ａ": 5, "a": 1, "\u200b": 50}))
    assert "…" not in often.rewrite and often.rewrite["ａ"] == "a" and often.rewrite["\u200b"] == ""
