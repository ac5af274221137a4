"""Splitting of pages and encoding of texts."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from scriptorium.llm import p1_split as p1
from scriptorium.llm import p7_encode as p7

PAGE = "page_id long, entry_id long, slug string, page int, text string, piece int, start string"  # the last two clash
rnd = random.Random(4)
WORDS = ["насос", "кран.", "вода", "«труба».", "x" * 30, "é", "конец!\n"]


def some_text(n):
    return " ".join(rnd.choice(WORDS) for _ in range(n))


def walk(text, limit, overlap):
    """The greedy cuts one after another, from the definition."""
    jump, at, out = p1.successors(text, limit, overlap), 0, []
    while at < len(text):
        at = int(jump[at])
        out.append(at)
    return out


@pytest.mark.parametrize("text", [some_text(600), "я" * 5000, some_text(90) + "я" * 3000 + some_text(50), "a\n" * 2000, "е́" * 1500, "конец. " + "б" * 2100, "\n" * 2500])
def test_cuts_by_squaring_are_those_of_a_walk(text):
    cuts = p1.cuts(text).tolist()
    assert cuts == walk(text, p1.LIMIT, p1.OVERLAP) and cuts[-1] == len(text)


def test_pieces(spark):
    texts = {1: some_text(700), 2: "я" * 2001, 3: "б" * 2000, 4: "", 5: None, 6: "конец. " + "б" * 4000, 7: some_text(60_000), 8: ("слово " * 400) + "😀" * 200}
    rows = [(k, 9, "s", k, t, 0, "x") for k, t in texts.items()]
    pages = spark.createDataFrame(rows + rows[:2], PAGE)
    by = {}
    for r in p1.split_pages(pages).collect():
        by.setdefault(r.page_id, []).append(r)
    assert set(by) == {k for k, t in texts.items() if t and len(t) > 2000}
    for k, own in by.items():
        own.sort(key=lambda r: r.piece)
        assert [r.piece for r in own] == list(range(1, len(own) + 1))
        whole, end = "", 0
        for r in own:
            assert len(r.text) <= 2000 and r.text == texts[k][r.start : r.end] and (r.start == 0 or r.start == end - 200)
            whole, end = whole[: r.start] + r.text, r.end
        assert whole == texts[k]
    assert sorted(r.page_id for r in p1.oversized(pages).collect()) == sorted(by)
    # natural boundaries wherever there is one
    assert all(r.text.rstrip()[-1:] in ".!»" for r in by[1][:-1])
    assert p1.split_pages(pages.limit(0)).count() == 0


def test_sizes(spark):
    pages = spark.createDataFrame([(1, 9, "s", 1, "я" * 2500, 0, ""), (2, 9, "s", 2, "б", 0, "")], PAGE)
    meta = spark.createDataFrame([(9, "2020", 2501), (9, "2019", 5), (8, "2020", 1)], "entry_id long, extracted_at string, chars long")
    assert p1.piece_sizes(pages, meta).first().entry_chars == 2501
    assert p1.piece_sizes(pages, meta.withColumn("chars", F.lit(3).cast("long"))).first().entry_chars is None


def test_overlap_must_be_below_the_limit():
    with pytest.raises(ValueError):
        p1.cuts("abc", 10, 10)


DOC = "doc_id long, text string, ids string, row int, k int, piece string"  # all but two clash


def encoded(spark, rows, **options):
    return sorted((r.doc_id, list(r.ids)) for r in p7.encode(spark.createDataFrame([(i, t, "x", 1, 2, "y") for i, t in rows], DOC), **options).collect())


ODD = ["слово ", "a1", "  ", "\n", " <|endoftext|>", "ü", "😀", "x" * 9, "it's ", "工業", "\r\n\t", "́"]


@pytest.mark.parametrize("chunk, reach, spread_over", [(64, 32, 1 << 20), (50, 49, 120), (32, 8, 64), (1 << 20, 1 << 12, 1 << 20)])
def test_chunks_encode_as_the_whole(spark, chunk, reach, spread_over):
    text = lambda n: "".join(rnd.choice(ODD) for _ in range(n))
    rows = [(1, None), (2, ""), (3, "hi"), (4, text(200)), (4, text(300)), (5, "a" * 300 + text(50)), (6, text(30)), (7, " " * 500), (8, text(100) + "b" * 100 + text(60)), (9, "1" * 200), (6, "hi"), (6, "hi"), (10, text(40) + "工" * 700 + text(40)), (11, "a\x1cb \x1d " * 90), (12, "it's we're " * 60)]
    whole = p7.tokenizer()
    assert encoded(spark, rows, chunk=chunk, reach=reach, spread_over=spread_over) == sorted((i, whole.encode_ordinary(t or "")) for i, t in rows)


def test_another_library_gives_the_same_ids(spark):
    from tokenizers import Tokenizer

    own = Tokenizer.from_file(f"{p7.FOLDER}/byte_bpe_50k.json")
    own.encode_special_tokens = True
    texts = ["Проверка <|endoftext|> 12,5 °C", "Prüfung “x”", "工業 😀\n\n  конец "]
    assert encoded(spark, list(enumerate(texts))) == [(k, own.encode(t, add_special_tokens=False).ids) for k, t in enumerate(texts)]


def test_decoding_and_counts(spark):
    text = "".join(ODD) * 40
    (_, ids), = encoded(spark, [(1, text)], chunk=100, reach=40)
    assert p7.decode(ids) == text
    df = spark.createDataFrame([(1, "hi there"), (2, None)], "doc_id long, text string")
    assert sorted((r.doc_id, r.n_tokens) for r in p7.token_counts(df).collect()) == [(1, 2), (2, 0)]
    assert p7.encode(df.limit(0)).count() == 0


def test_pieces_stay_near_the_size_of_a_chunk():
    text = "".join(rnd.choice(ODD) for _ in range(3000)) + "b" * 900 + "".join(rnd.choice(ODD) for _ in range(3000))
    at = [*p7.begins(text, 128, 32, p7._pattern()), len(text)]
    assert at == sorted(set(at)) and set(at[1:-1]) <= set(p7.boundaries(text, p7._pattern()).tolist())
    assert max(b - a for a, b in zip(at, at[1:])) < 900 + 4 * 128 and len(at) > len(text) // 300


def test_stitch_needs_a_common_boundary():
    pattern = p7._pattern()
    assert p7.stitch("a" * 100, 50, pattern) is None
    at = p7.stitch("слово слово слово слово слово слово", 15, pattern)
    assert at is not None and at >= 15 and at in p7.boundaries("слово слово слово слово слово слово", pattern)
    assert isinstance(p7.boundaries("", pattern), np.ndarray)
