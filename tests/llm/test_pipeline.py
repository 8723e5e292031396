"""The pipeline against a brute-force version of each stage, on the smallest tables."""

import hashlib
import itertools
import re

import pytest

import corpus_pipeline as cp
from tests.llm.test_jaccard import brute
from tests.llm.test_native import brute_lines
from tests.llm.test_texts import brute_quality, brute_tiles, brute_verdict, quality_fertility
from varloom.llm.common import shared_folder, written

SF = "/root/testdata/sf0.001"
COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


@pytest.fixture(scope="module")
def stages(spark):
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), []
    for _, f in cp.STAGES:
        before, docs = docs, written(f(spark, docs, SF), shared_folder(spark))
        out.append((before.collect(), docs.collect(), docs.columns))
    return out


def test_columns(stages):
    assert all(sorted(c) == sorted(COLUMNS) for _, _, c in stages[:-1])
    assert set(COLUMNS) < set(stages[-1][2])


def test_quality_stage(stages):
    """The verdicts by their definition, token by token."""
    before, after, _ = stages[0]
    words = [e.encode_ordinary for e in quality_fertility.encodings]
    keep = []
    for r in before:
        n, _, _, _, repeats = brute_quality(r["text"])
        keep.append(n >= 20 and 100 * repeats <= 30 * n and brute_verdict(r["text"], r["lang"], words))
    assert sorted(map(str, after)) == sorted(str(r) for r, k in zip(before, keep) if k)
    assert len(after) > 0.7 * len(before)


def test_line_stage(stages):
    before, after, _ = stages[1]
    want = {d: t for d, _, _, t in brute_lines([(r["doc_id"], r["text"]) for r in before])}
    assert {r["doc_id"]: r["text"] for r in after} == want and all(r["n_chars"] == len(r["text"]) for r in after)


def test_near_duplicate_stage(stages):
    before, after, _ = stages[2]
    want = sorted(d for d, _, c in brute([(r["doc_id"], r["text"]) for r in before], 5, 80) if d == c)
    assert sorted(r["doc_id"] for r in after) == want


def test_decontamination_stage(spark, stages):
    """Tiles by their definition, for the pairs that share five words in a row."""
    before, after, _ = stages[3]
    items = [i["text"].lower().split() for i in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    seeds = [{tuple(i[k : k + 5]) for k in range(len(i) - 4)} for i in items]
    bad = set()
    for r in before:
        words = (r["text"] or "").lower().split()
        own = {tuple(words[k : k + 5]) for k in range(len(words) - 4)}
        for i, s in zip(items, seeds, strict=True):
            if own & s and 2 * brute_tiles(i, words, 5) >= len(i):
                bad.add(r["doc_id"])
    assert sorted(r["doc_id"] for r in after) == sorted(r["doc_id"] for r in before if r["doc_id"] not in bad)
    assert bad


def test_mixing_stage(stages):
    """The copies by a run of all in one list: each source's documents by digest, copies by virtual finish time, cut at the budget."""
    before, after, _ = stages[4]
    size = {r["doc_id"]: len(re.findall(r"[^\x20\x09-\x0D]+", r["text"] or "")) for r in before}
    sources = sorted({r["source"] for r in before}, key=lambda s: (s is None, (s or "").encode()))
    total = {s: sum(size[r["doc_id"]] for r in before if r["source"] == s) for s in sources}
    copies = []
    for k, s in enumerate(sources):
        own = sorted((hashlib.md5(f"mix|{r['doc_id']}|{s or ''}|{size[r['doc_id']]}".encode()).hexdigest(), r["doc_id"]) for r in before if r["source"] == s)
        ends = list(itertools.accumulate(size[d] for _, d in own))
        copies += [((end + c * total[s]) / [5, 2, 1][k % 3], k, key, d, c) for (key, d), end in zip(own, ends, strict=True) for c in (0, 1)]
    want, words = [], 0
    for _, _, _, d, c in sorted(copies):
        words += size[d]
        if words > 1.5 * sum(total.values()):
            break
        want += [(d, c)] if size[d] else []
    assert sorted((r["doc_id"], r["copy"]) for r in after) == sorted(want)


def test_run(spark, stages):
    assert cp.run(spark, SF).count() == len(stages[-1][1])


def test_awkward_rows_pass(spark, tmp_path):
    prose = "some words that make up a text of this kind and go on for long enough to count as one whole piece of prose with no words twice"
    rows = [(1, None, None, None, None), (None, prose, "en", None, 5), (2, "", "xx", "s", 0), (3, prose + " end", "en", "s", 9), (3, prose + " end", "en", "s", 9)]
    spark.createDataFrame([(*r, "x") for r in rows], "doc_id long, text string, lang string, source string, n_chars long, kept string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    out = cp.run(spark, str(tmp_path)).collect()
    assert {r["doc_id"] for r in out} == {3} and all(r["kept"] == "x" for r in out)


def test_near_duplicates_keep_what_differs(spark):
    """Different texts without id, or of one id, all stay; of copies one does, with an id if any has one."""
    a, b, c, d, e = (" ".join(f"{x}{k}" for k in range(30)) for x in "abcde")
    rows = [(None, a), (None, b), (None, c), (7, d), (7, e), (7, e), (9, e + " end"), (20, a), (None, a + " end"), (None, None), (None, None), (5, ""), (None, c)]
    docs = spark.createDataFrame([(i, t, "en") for i, t in rows], "doc_id long, text string, lang string")
    got = sorted(((r["doc_id"], r["text"]) for r in cp.near_duplicates(spark, docs, "").collect()), key=str)
    assert got == sorted([(20, a), (None, b), (None, c), (7, d), (7, e), (None, None), (5, "")], key=str)
