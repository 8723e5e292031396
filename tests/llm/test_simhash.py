"""SimHash fingerprints and links against their definitions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from varloom.llm import simhash
from varloom.llm.common import lower_ascii, shared_folder
from varloom.llm.components import components

SF = "/root/testdata/sf0.001"


def roots(fp):
    """The smallest member that each fingerprint reaches, by all pairs."""
    root = {f: f for f in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for k, x in enumerate(fp):
        for y in fp[:k]:
            if (x ^ y).bit_count() <= 3 and find(x) != find(y):
                root[max(find(x), find(y))] = min(find(x), find(y))
    return {f: find(f) for f in fp}


def near(rng, f, bits):
    for b in rng.sample(range(64), bits):
        f ^= 1 << b
    return f


def members(seed):
    """Pairs at every distance, chains, and a dense cluster."""
    rng, out = random.Random(seed), {0, 2**64 - 1, 7, 15}
    for d in range(1, 7):
        for _ in range(20):
            f = rng.getrandbits(64)
            out |= {f, near(rng, f, d)}
    f = rng.getrandbits(64)
    for _ in range(30):
        f = near(rng, f, 3)
        out.add(f)
    out |= {near(rng, f, rng.randint(1, 4)) for _ in range(150)}
    return sorted(out)


@pytest.mark.parametrize("tile", [3, 16, 1024])
def test_tiles(tile):
    fp = members(1)
    want, x = roots(fp), np.array(fp, dtype=np.uint64)
    joined = lambda a, b: roots_of(fp, list(zip(a.tolist(), b.tolist(), strict=True)))
    assert joined(*simhash.tiled(x, tile=tile)) == want
    one, other = x[::2], x[1::2]
    a, b = simhash.tiled(np.concatenate([one, other]), len(one), tile=tile)
    edges = [(p, q) for p in one.tolist() for q in other.tolist() if (p ^ q).bit_count() <= 3]
    assert joined(a, b) == roots_of(fp, edges)


def roots_of(fp, edges):
    root = {f: f for f in fp}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for p, q in edges:
        root[max(find(p), find(q))] = min(find(p), find(q))
    return {f: find(f) for f in fp}


@pytest.mark.parametrize("chunk", [1, 5, 8192])
def test_links_lose_nothing(spark, chunk):
    """Whatever the size of a bin's parts."""
    fp = members(2)
    signed = lambda v: v - 2**64 if v >> 63 else v
    got = simhash.links(spark.createDataFrame([(signed(f),) for f in fp], "fp long"), chunk=chunk).collect()
    assert roots_of(fp, [(r["a"] % 2**64, r["b"] % 2**64) for r in got]) == roots(fp)


def test_every_link_has_a_bin():
    rng = random.Random(3)
    for _ in range(500):
        f = rng.getrandbits(64)
        g = near(rng, f, rng.randint(0, 3))
        assert any(f & m == g & m for m in simhash.masks())
    assert len(simhash.masks()) == 10 and all(m.bit_count() in (25, 26) for m in simhash.masks())


def test_fingerprint_is_that_of_the_hash_function_of_spark(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text")
    words = F.filter(F.split(lower_ascii(F.col("text")), "[ \t-\r]+"), lambda w: w != "")
    shingle = F.when(F.size("w") >= 3, F.transform(F.sequence(F.lit(1), F.size("w") - 2), lambda k: F.array_join(F.slice("w", k, 3), " "))).when(F.size("w") > 0, F.array(F.array_join("w", " "))).otherwise(F.array().cast("array<string>"))
    hashes = docs.withColumn("w", words).select("doc_id", F.transform(shingle, lambda s: F.xxhash64(s)).alias("h"))
    want = {}
    for r in hashes.collect():
        want[r["doc_id"]] = sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in r["h"]) > len(r["h"]))
    got = {r["doc_id"]: int(r["fingerprint"], 16) for r in simhash.op12(spark, SF).collect()}
    assert got == want
    assert {r["doc_id"]: r["component_id"] for r in simhash.op12(spark, SF).collect()} == by_pairs(want)


def by_pairs(fp):
    root, least = roots(sorted(set(fp.values()))), {}
    for d, f in fp.items():
        least[root[f]] = min(d, least.get(root[f], d))
    return {d: least[root[f]] for d, f in fp.items()}


def test_pieces_of_a_long_text():
    text = (" one\t two\n\n" + "x" * 300 + " Drei ÄÖ \x0b\r").encode() * 40
    assert {simhash.fingerprint(text, size) for size in (1, 7, 100, 1 << 20)} == {simhash.fingerprint(text)}
    assert simhash.fingerprint(b"A\xc2\xa0b") == simhash.fingerprint(b" a\xc2\xa0b ") != simhash.fingerprint(b"a b")


def test_edges(spark):
    long = " ".join(f"w{k}" for k in range(5000))
    rows = [(5, None), (3, ""), (None, " \n\t"), (9, "a b c d"), (9, "A  b\nC d"), (None, "a b c d"), (8, "a b c d"), (None, "only without id"), (None, "only without id"), (1, long), (2, long + " end"), (4, "two words")]
    docs = spark.createDataFrame([(d, t, k, "x") for k, (d, t) in enumerate(rows)], "doc_id long, text string, fp int, Component string")
    with pytest.raises(ValueError, match="there already"):
        simhash.near_duplicates(docs)
    out = simhash.near_duplicates(docs, prefix="_s_")
    assert out.columns == ["doc_id", "fp", "Component", "_s_fp", "_s_component_id"]
    got = {r["fp"]: r["_s_component_id"] for r in out.collect()}
    assert [got[k] for k in range(len(rows))] == [3, 3, 3, 8, 8, 8, 8, None, None, 1, 1, 4]
    with pytest.raises(ValueError, match="component_id"):
        simhash.near_duplicates(docs.selectExpr("doc_id", "text", "1 AS component_id"))


def test_components_of_a_chain(spark):
    links = spark.createDataFrame([(k - 50, k - 49) for k in range(100)], "a long, b long")
    got = components(links, f"{shared_folder(spark)}/c")
    assert got.count() == 100 and got.filter("component != -50").count() == 0
