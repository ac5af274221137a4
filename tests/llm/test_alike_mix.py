"""Alike texts and mixes of sources."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from scriptorium.llm import p6_alike as p6
from scriptorium.llm import p8_mix as p8

ENTRY = "entry_id long, slug string, text string, n string, mark int, runs int, key int"  # the last ones clash
rnd = random.Random(12)
VOCABULARY = [f"слово{k}" for k in range(400)]


def edited(words, part):
    return [rnd.choice(VOCABULARY) if rnd.random() < part else w for w in words]


def runs(text):
    w = re.findall(r"[^\W_]+", (text or "").lower())
    return {tuple(w[k : k + 3]) for k in range(len(w) - 2)}


@pytest.fixture(scope="module")
def texts():
    out, k = {}, 0
    for _ in range(60):
        base = [rnd.choice(VOCABULARY) for _ in range(rnd.choice([8, 40, 150]))]
        for part in (0.0, 0.0, 0.02, 0.05, 0.08, 0.12):
            if rnd.random() < 0.7:
                out[k] = " ".join(edited(base, part)).upper() if rnd.random() < 0.2 else " ".join(edited(base, part)) + "."
                k += 1
    copy = " ".join(rnd.choice(VOCABULARY) for _ in range(30))
    out |= {1000 + j: copy for j in range(40)} | {2000: None, 2001: "", 2002: "два слова", 2003: "!!!", 2004: " ".join(VOCABULARY) * 60, 2005: "три слова здесь", 2006: "Три, слова здесь!"}
    return out


@pytest.fixture(scope="module")
def alike(spark, texts):
    return spark.createDataFrame([(k, "s", t, "", 0, 0, 0) for k, t in texts.items()], ENTRY)


def test_pairs_are_those_of_brute_force(alike, texts):
    sets = {k: r for k, t in texts.items() if (r := runs(t))}
    keys = sorted(sets)
    want = {(a, b) for i, a in enumerate(keys) for b in keys[i + 1 :] if len(sets[a] & sets[b]) >= 0.7 * len(sets[a] | sets[b])}
    got = [(r.entry_a, r.entry_b) for r in p6.found(alike).collect()]
    assert len(got) == len(set(got)) and set(got) <= want
    assert len(want) > 100 and len(set(got)) >= 0.995 * len(want)


def test_splitting_changes_nothing(spark, alike):
    whole = sorted(map(tuple, p6.found(alike).collect()))
    assert sorted(map(tuple, p6.found(alike, cell=7).collect())) == whole
    again = alike.unionByName(alike.filter("entry_id < 20")).unionByName(alike.filter("entry_id = 3").withColumn("text", p6.F.lit("ещё три слова")))
    assert sorted(map(tuple, p6.found(again).collect())) == whole
    edges = [(0, k) for k in range(1, 90)] + [(k, 500 + k) for k in range(80)]
    got = {r.id: r.group for r in p6.components(spark.createDataFrame(edges, "a long, b long"), hub=20).collect()}
    assert set(got.values()) == {0} and len(got) == 170


def test_groups(alike, texts):
    got = {r.entry_id: r for r in p6.groups(alike).collect()}
    assert set(got) == {k for k, t in texts.items() if runs(t)}
    assert {got[1000 + j]["class"] for j in range(40)} == {1000} and got[1000].links == 0 and got[2006].group == 2005
    parent = {k: k for k in got}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for r in p6.found(alike).collect():
        parent[max(root(r.entry_a), root(r.entry_b))] = min(root(r.entry_a), root(r.entry_b))
    assert {k: r.group for k, r in got.items()} == {k: root(k) for k in got}


def test_alike_in_empty_tables(alike):
    assert p6.found(alike.limit(0)).count() == 0 and p6.groups(alike.filter("text is null")).count() == 0


def test_components(spark):
    edges = [(k, k + 1) for k in range(200)] + [(1000, 1001), (1001, 1002), (1002, 1000), (7, 7)]
    rnd.shuffle(edges)
    got = {r.id: r.group for r in p6.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 0 for k in range(201)} | {1000: 1000, 1001: 1000, 1002: 1000}


def test_golay_keys_meet_within_two_errors():
    g = np.random.default_rng(1)
    x = g.integers(0, 1 << 23, 400)
    kx = p6.codewords(x)
    assert {len(set(r)) for r in kx.tolist()} <= {1, 2, 3, 4, 5, 6, 7}
    for _ in range(30):
        a, b = g.integers(0, 23, 2)
        ky = p6.codewords(x ^ (1 << a) ^ (0 if a == b else 1 << b))
        assert all(set(r) & set(s) for r, s in zip(kx.tolist(), ky.tolist()))


# --- mixes ------------------------------------------------------------------------------

DOC = "doc_id long, source string, text string, n string, at int, block string"
TARGET = "mix_name string, source string, target_share double, max_repeats int"


@pytest.fixture(scope="module")
def sources(spark):
    rows, k = [], 0
    for source, n in (("big", 300), ("mid", 60), ("small", 12)):
        for _ in range(n):
            rows.append((k, source, " ".join(rnd.choice(VOCABULARY) for _ in range(rnd.randint(5, 120))), "", 0, ""))
            k += 1
    rows += [(k, "big", None, "", 0, ""), (k + 1, "mid", "", "", 0, ""), (k + 2, None, "ничей текст", "", 0, ""), (k + 3, "huge", "длинный текст " * 9000, "", 0, ""), rows[0]]
    targets = [("m", "big", 0.5, 1), ("m", "mid", 0.3, 2), ("m", "small", 0.2, 5), ("lack", "small", 0.5, 2), ("lack", "missing", 0.5, 9), ("one", "huge", 1.0, 3), ("none", "missing", 1.0, 3), ("m", "mid", 0.3, 2), (None, "big", 1.0, 1)]
    return spark.createDataFrame(rows, DOC), spark.createDataFrame(targets, TARGET)


def test_mix(sources):
    documents, targets = sources
    rows, _ = p8.mixed(documents, targets, 64)
    got = rows.collect()
    uses = Counter((r.mix_name, r.source, r.block) for r in got)
    most = {("m", "big"): 1, ("m", "mid"): 2, ("m", "small"): 5, ("lack", "small"): 2, ("one", "huge"): 3}
    assert {(m, s) for m, s, _ in uses} == set(most) and all(n <= most[m, s] for (m, s, _), n in uses.items())
    assert len({(r.mix_name, r.shard, r.slot) for r in got}) == len(got)
    shares = {(r.mix_name, r.source): r for r in p8.shares(documents, targets, 64).collect()}
    for source, target in (("big", 0.5), ("mid", 0.3), ("small", 0.2)):
        assert shares["m", source].actual_share == pytest.approx(target, abs=0.02) and shares["m", source].most_repeats <= shares["m", source].max_repeats
    assert shares["lack", "missing"].tokens == 0 and shares["lack", "small"].actual_share == 1 and shares["none", "missing"].actual_share == 0
    # the scarcest source is used up
    assert any(len({b for m, s, b in uses if (m, s) == key}) * n == sum(v for (m, s, _), v in uses.items() if (m, s) == key) for key, n in most.items() if key[0] == "m")
    assert sorted(map(tuple, (r[:7] for r in p8.mixed(documents, targets, 64)[0].collect()))) == sorted(map(tuple, (r[:7] for r in got)))


def test_blocks_hold_the_tokens_of_their_records(spark, sources):
    from scriptorium.llm.p7_encode import tokenizer

    documents, targets = sources
    documents = documents.dropDuplicates(["doc_id"])
    rows, _ = p8.mixed(documents, targets, 64)
    text = {r.doc_id: r.text for r in documents.collect()}
    spans = {(r.mix_name, r.shard, r.slot): r.spans for r in rows.collect()}
    got = p8.with_ids(rows, p8.packed(documents, targets, 64)).collect()
    assert len(got) == len(spans)
    for r in got:
        want = [i for s in spans[r.mix_name, r.shard, r.slot] for i in tokenizer().encode_ordinary(text[s.doc_id])[s["from"] : s.to]]
        assert r.ids == want and len(r.ids) == r.tokens <= 64


def test_mix_of_empty_tables(sources):
    documents, targets = sources
    assert p8.mixed(documents.limit(0), targets)[0].count() == 0 and p8.mixed(documents, targets.limit(0))[0].count() == 0
    assert p8.shares(documents.limit(0), targets).filter("tokens > 0").count() == 0


def test_draws_are_settled_to_the_exact_slots():
    m = {"mix": "m", "sources": ["a", "b", "c", "d"], "slots": np.array([70_000, 20_000, 9_000, 1_001]), "blocks": np.array([50_000, 9_000, 9_000, 400]), "total": 100_001, "shards": 390}
    each = np.concatenate([p8.draws(m, g) for g in range(4)])
    assert each.sum() == 100_001 and each.std(axis=0).min() > 0
    drawn = each.sum(axis=0)
    source = np.repeat(np.arange(4), drawn)
    number = np.concatenate([np.arange(n) for n in drawn])
    got, at = p8.settled(m, drawn, source, number)
    assert np.bincount(got).tolist() == m["slots"].tolist() and (got != source).sum() == np.maximum(drawn - m["slots"], 0).sum()
    for k, n in enumerate(m["slots"].tolist()):
        assert sorted(at[got == k].tolist()) == list(range(n))


@pytest.mark.parametrize("n", [1, 2, 3, 17, 64, 1000])
def test_permutations(n):
    for key in (1, 99):
        assert sorted(p8.permuted(np.arange(n), n, key).tolist()) == list(range(n))
    assert n < 17 or p8.permuted(np.arange(n), n, 1).tolist() != p8.permuted(np.arange(n), n, 2).tolist()
