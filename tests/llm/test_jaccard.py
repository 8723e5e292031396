"""The similarity join and components against brute force."""

import random
import re

import numpy as np
import pytest

from varloom.llm import jaccard_join
from varloom.llm.components import components


def brute(rows, k, percent):
    sets = []
    for d, t in rows:
        low = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "")
        w = re.findall(r"[^\x20\x09-\x0D]+", low)
        sets.append({tuple(w[i : i + k]) for i in range(max(len(w) - k + 1, min(len(w), 1)))} if w else set())
    ids = [d for d, _ in rows]
    root = {d: d for d in ids}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(ids[i]), find(ids[j])
                root[max(a, b)] = min(a, b)
    return sorted((d, len(s), find(d)) for (d, _), s in zip(rows, sets))


def corpus(seed, n=60, copies=40):
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(3))
    passage = [word() for _ in range(25)]
    texts = []
    for _ in range(n):
        t = [word() for _ in range(rng.randint(1, 120))]
        if rng.random() < 0.5:
            t[rng.randint(0, len(t)) : 0] = passage
        texts.append(t)
    base = texts[0] = [word() for _ in range(100)]
    for _ in range(copies):  # near copies of one text, from nearly equal to too far
        t = list(base)
        for _ in range(rng.randint(0, 6)):
            t[rng.randrange(len(t))] = word()
        texts.append(t)
    chain = [word() for _ in range(80)]
    for _ in range(12):  # each a little further from the first
        chain = list(chain)
        chain[rng.randrange(80)] = word()
        texts.append(chain)
    texts += [texts[3], texts[3], [w.upper() for w in texts[3]], [], ["one"], ["ONE"], ["one", "two"]]
    rows = [(d, " ".join(t)) for d, t in enumerate(texts)] + [(1000, None), (1001, "")]
    rng.shuffle(rows)
    return rows


@pytest.mark.parametrize("seed,k,percent,chunk,most", [(0, 4, 85, 512, 16), (2, 4, 85, 8, 16), (3, 3, 70, 6, 0), (4, 5, 80, 6, 1)])
def test_join(spark, monkeypatch, seed, k, percent, chunk, most):
    monkeypatch.setattr(jaccard_join, "CHUNK", chunk)
    monkeypatch.setattr(jaccard_join, "DEALT", most)
    rows = corpus(seed)
    df = spark.createDataFrame([(d, t, 1) for d, t in rows], "doc_id long, text string, n int")
    got = sorted((r["doc_id"], r["n_shingles"], r["component_id"]) for r in jaccard_join.link(df, k, percent).collect())
    assert got == brute(rows, k, percent)


def linked(spark, rows):
    got = jaccard_join.link(spark.createDataFrame(rows, "doc_id long, text string"))
    return sorted(((r["doc_id"], r["component_id"]) for r in got.collect()), key=str)


def test_no_id_and_repeated_rows(spark):
    text = " ".join(f"w{k}" for k in range(30))
    rows = [(None, text), (None, "x y z u v"), (5, text), (5, text), (6, "other words altogether in here")]
    assert linked(spark, rows) == sorted([(None, 5), (None, None), (5, 5), (5, 5), (6, 6)], key=str)


def test_rows_without_id_are_documents_of_their_own(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(None, a), (None, b), (None, c), (20, a), (21, b), (None, a + " end"), (None, None), (None, "")]
    assert linked(spark, rows) == sorted([(None, 20), (None, 21), (None, None), (20, 20), (21, 21), (None, 20), (None, None), (None, None)], key=str)


def test_texts_of_one_id_are_linked(spark):
    a, b, c = (" ".join(f"{x}{k}" for k in range(40)) for x in "abc")
    rows = [(1, a), (5, a + " end"), (5, b), (9, b), (7, c), (7, ""), (8, None), (3, "lone words of a text"), (7, None), (4, c)]
    assert linked(spark, rows) == sorted([(1, 1), (5, 1), (5, 1), (9, 1), (7, 4), (7, 4), (8, 8), (3, 3), (7, 4), (4, 4)], key=str)


def test_two_keys_that_link_share(spark):
    """The filter of blocks beyond one chunk: two sets that link share two of their prefixes' keys."""
    rng = np.random.default_rng(3)
    order, met = np.zeros(1 << jaccard_join.SKETCH_BITS, dtype=np.uint8), 0
    for _ in range(3000):
        n = rng.integers(1, 40)
        s = np.unique(rng.integers(0, 2**63, n).astype(np.uint64))
        t = np.unique(np.concatenate([s[rng.random(len(s)) < 0.93], rng.integers(0, 2**63, rng.integers(0, 4)).astype(np.uint64)]))
        for percent in (80, 85):
            if len(t) and (len(s) != len(t) or (s != t).any()) and jaccard_join.linked(s, t, percent):
                met += 1
                assert len(np.intersect1d(jaccard_join.prefix(s, order, percent), jaccard_join.prefix(t, order, percent))) >= 2
    assert met > 100


def test_one_frequent_shingle_makes_no_pairs(spark, monkeypatch):
    """Texts with nothing but one shingle in common, many more than a chunk: no block of the second round holds them."""
    rng = random.Random(1)
    texts = ["all these share " + " ".join(str(rng.randrange(10**9)) for _ in range(12)) for _ in range(1500)]
    rows = [(d, "lead in words " + t if d % 2 else t) for d, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    monkeypatch.setattr(jaccard_join, "DEALT", 1)
    assert jaccard_join.link(df, 3, 80).filter("component_id != doc_id").count() == 0


def test_tree_finds_every_possible_pair():
    rng = np.random.default_rng(0)
    sets = [np.unique(rng.integers(0, 400, rng.integers(40, 60)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) for _ in range(150)]
    for k in range(0, 150, 3):
        sets[k] = np.unique(np.concatenate([sets[k - k % 30][2:], sets[k][:1]]))
    ids, sizes = np.arange(150), np.array([len(s) for s in sets])
    a, b, _ = jaccard_join.block_pairs(ids, sizes, [jaccard_join.bitmap(s) for s in sets], np.arange(150), 70)
    found = set(zip(np.minimum(a, b).tolist(), np.maximum(a, b).tolist()))
    for i in range(150):
        for j in range(i):
            both = len(np.intersect1d(sets[i], sets[j]))
            if 100 * both >= 70 * (len(sets[i]) + len(sets[j]) - both):
                assert (j, i) in found
    assert len(found) < 150 * 149 / 2


def test_components(spark, tmp_path):
    rng = random.Random(0)
    edges = [(k, k + 1) for k in range(40)] + [(100, k) for k in range(200, 260)] + [(rng.randrange(300, 400), rng.randrange(300, 400)) for _ in range(60)] + [(7, 7)]
    root = {v: v for e in edges for v in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            m = min(root[a], root[b])
            changed |= root[a] != m or root[b] != m
            root[a] = root[b] = m
    got = {r["id"]: r["component"] for r in components(spark.createDataFrame(edges, "a long, b long"), str(tmp_path / "c")).collect()}
    assert got == {v: r for v, r in root.items() if r != v}
