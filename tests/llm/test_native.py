"""Line dedup, mixing, licences and chat: operators beyond what their SQL covers."""

import random
from collections import defaultdict

import pytest
from hypothesis import given, settings
from hypothesis import strategies as some
from pyspark.sql import functions as F

from varloom.llm import chat, license_scan, line_dedup, mixing

DOCS = "doc_id long, text string, source string"


def brute_lines(rows, min_chars=20, min_docs=3):
    lower = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s)
    key = lambda line: lower(line.strip(" \t\n\x0b\x0c\r"))
    held = defaultdict(set)
    for k, (d, t) in enumerate(rows):
        for line in (t or "").split("\n"):
            if len(key(line)) >= min_chars:
                held[key(line)].add((d is not None, k if d is None else d))
    drop = {k: max(v)[1] for k, v in held.items() if len(v) >= min_docs and max(v)[0]}
    out = []
    for d, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (key(x) in drop and (d is None or d < drop[key(x)]))]
        out.append((d, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return sorted(out, key=str)


@pytest.mark.parametrize("batches,fanout", [(1, 4), (5, 2), (4, 4)])
def test_line_dedup(spark, batches, fanout):
    rng = random.Random(batches)
    pool = [f"this line is number {k} of a pool that repeats" for k in range(12)] + ["short", "", "  ", "ÄÖ line with non-ascii letters in it"]
    rows = [(d, "\n".join(rng.choice(pool).upper() if rng.random() < 0.3 else rng.choice(pool) for _ in range(rng.randint(0, 9)))) for d in range(60)]
    rows += [(None, pool[0]), (None, pool[0]), (None, "another line that has no number of its own"), (None, "another line that has no number of its own"), (None, "x\nanother line that has no number of its own"), (7, pool[1] + "\n" + pool[1]), (7, pool[1]), (99, None)]
    many = [f"a line that two more long texts hold as well, number {k}" for k in range(300)]
    rows += [(200, "\n".join(many)), (201, "\n".join(many[::2])), (202, "\n".join(many[::3]))]
    df = spark.createDataFrame([(d, t, "kept", 5) for d, t in rows], "doc_id long, text string, kept_text string, _extra int")
    got = line_dedup.dedup_lines(df, batches=batches, fanout=fanout)
    assert "_extra" in got.columns
    out = sorted(((r["doc_id"], r["n_lines"], r["n_dropped"], r["kept_text"]) for r in got.collect()), key=str)
    assert out == brute_lines(rows)


@pytest.mark.parametrize("order", [(4, 3, 2, 1), (1, 2, 3, 4), (2, 4, 1, 3)])
def test_runs_level_and_compact_in_any_order(spark, tmp_path, order):
    runs = line_dedup.LineRuns(spark, str(tmp_path), min_docs=2, fanout=2)
    for b in order:
        runs.add(spark.createDataFrame([(b * 10 + k, 1, k % 3) for k in range(3)], "_ld_doc long, _ld_h1 long, _ld_h2 long"))
    assert [len(level) for level in runs.levels] == [0, 0, 1]
    assert {tuple(r) for r in runs.repeated().collect()} == {(1, 0, 40), (1, 1, 41), (1, 2, 42)}


def test_mix_holds_its_promises(spark):
    rng = random.Random(0)
    rows = [(d, "w " * rng.randint(0, 40), rng.choice(["a"] * 6 + ["b", "c", None])) for d in range(900)]
    docs = spark.createDataFrame(rows, DOCS)
    first = {r["_mx_id"]: r for r in mixing.taken_counts(mixing.mix(docs)).collect()}
    again = {r["_mx_id"]: r["copies"] for r in mixing.taken_counts(mixing.mix(docs.repartition(7))).collect()}
    assert {d: r["copies"] for d, r in first.items()} == again and len(first) == 900
    taken, target = defaultdict(int), {}
    for r in first.values():
        assert 0 <= r["copies"] <= 2
        taken[r["_mx_source"], r["_mx_null"]] += r["copies"] * r["size"]
        target[r["_mx_source"], r["_mx_null"]] = r["target"]
    total = sum(r["size"] for r in first.values())
    assert sum(target.values()) == pytest.approx(1.5 * total)
    assert all(abs(taken[s] - t) <= 80 for s, t in target.items())


def test_targets_by_repeated_resharing(spark):
    sizes, weights = [100, 5, 300, 7, 0, 50], [5, 2, 1, 5, 2, 1]
    budget, cap, left = 1.5 * sum(sizes), [2.0 * s for s in sizes], None
    target, fixed = [0.0] * 6, set()
    while True:
        left = budget - sum(cap[k] for k in fixed)
        free = sum(weights[k] for k in range(6) if k not in fixed)
        target = [cap[k] if k in fixed else left * weights[k] / free for k in range(6)]
        over = {k for k in range(6) if k not in fixed and target[k] > cap[k]}
        if not over:
            break
        fixed |= over
    df = spark.createDataFrame([(chr(97 + k), False, s) for k, s in enumerate(sizes)], "_mx_source string, _mx_null boolean, _mx_words long")
    got = {r["_mx_source"]: r["target"] for r in mixing.targets(df).collect()}
    assert [got[chr(97 + k)] for k in range(6)] == pytest.approx(target)


def test_mixed_rows_are_the_copies(spark):
    rows = [(d, "w " * (d % 7), "a" if d % 3 else "b") for d in range(50)] + [(3, "w w w ", "b"), (3, "w w w ", "b")]
    docs = spark.createDataFrame(rows, DOCS).withColumn("copy", F.lit("mine"))
    out = mixing.mixed_rows(docs)
    counts = {r["_mx_id"]: 0 for r in mixing.taken_counts(mixing.mix(docs)).collect()}
    for r in mixing.taken_counts(mixing.mix(docs)).collect():
        counts[r["_mx_id"]] += r["copies"]
    got = defaultdict(int)
    for r in out.collect():
        got[r["doc_id"]] += 1
    assert {k: v for k, v in counts.items() if v} == dict(got)
    times = [r["virtual_finish"] for r in out.collect()]
    assert times == sorted(times)


def test_rows_of_one_key_are_whole_and_fast(spark):
    """A hundred thousand rows without id, of one source and one size: a row for each, and each its own text."""
    docs = spark.range(100_000).select(F.lit(None).cast("long").alias("doc_id"), F.concat(F.lit("w"), F.col("id")).alias("text"), F.lit("s").alias("source"))
    docs = docs.unionByName(spark.range(50_000).select(F.col("id").alias("doc_id"), F.lit("one and the same").alias("text"), F.lit("t").alias("source")))
    out = mixing.mixed_rows(docs)
    # 100,000 and 200,000 words by 5 to 2: the first is spent, the second takes the rest of 450,000
    by = {r["source"]: (r["n"], r["texts"]) for r in out.groupBy("source").agg(F.count("*").alias("n"), F.count_distinct("text").alias("texts")).collect()}
    again = mixing.mixed_rows(docs.repartition(3))
    assert out.select("text", "copy").exceptAll(again.select("text", "copy")).isEmpty()
    assert by["s"] == (200_000, 100_000) and abs(by["t"][0] * 4 - 250_000) <= 8


@pytest.mark.parametrize("text,labels", [
    ("Licensed under the Apache License, Version 2.0.", "apache-2.0"), ("# Released under the MIT\n# License.", "mit"), ("see CC BY-NC 4.0: licensed under CC BY-NC 4.0", "cc-by,cc-by-nc"),
    ("Permission is hereby granted,\n * free of charge, to any person obtaining\n * a copy of this software and associated documentation files", "mit"),
    ("/* THE SOFTWARE IS PROVIDED \"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR\n * IMPLIED, INCLUDING BUT NOT LIMITED TO THE WARRANTIES OF MERCHANTABILITY,\n * FITNESS FOR A PARTICULAR PURPOSE AND NONINFRINGEMENT. IN NO EVENT SHALL THE AUTHORS OR\n * COPYRIGHT HOLDERS BE LIABLE FOR ANY CLAIM, DAMAGES OR OTHER LIABILITY, WHETHER IN AN ACTION */", "mit"),
    ("substantial portions of the software, as you may see in the above copyright notice", ""), ("This is free and unencumbered software released into the public domain.", "unlicense"),
    ("Redistributions in binary form must reproduce the above copyright\n#    notice, this list of conditions and the following disclaimer in the", "bsd"),
    ("a source code form of the mozilla public license subject to terms", ""), ("Public domain. See the Eclipse Public License.", ""),
    ("the version 2 of the software is free", ""), ("License apache version of the under", ""), ("this work is licensed under the GNU General Public License, version 3.", "gpl"),
])
def test_licences(spark, text, labels):
    r = license_scan.scan(spark.createDataFrame([(1, "filler " * 50 + text)], "doc_id long, text string")).first()
    assert ",".join(r["labels"]) == labels and (r["score"] >= 0.5) == bool(labels)


def test_licences_of_awkward_texts(spark):
    rows = [(1, None), (2, ""), (3, "\n"), (4, "x " * 200_000 + "all rights reserved")]
    out = {r["doc_id"]: r for r in license_scan.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert [out[k]["n_words"] for k in (1, 2, 3, 4)] == [0, 0, 0, 200_003] and out[4]["labels"] == ["reserved"]
    assert out[4]["base_places"][0]["word"] == 200_000


# Chat ---------------------------------------------------------------------------------------------------------------------------


@settings(max_examples=200, deadline=None)
@given(some.text(alphabet="\\<[lbe/sINST] ab\n", max_size=30))
def test_escapes_are_reversible(text):
    code = text
    for plain, e in chat.ESCAPES:
        code = code.replace(plain, e)
    assert "<" not in code and "[" not in code
    for plain, e in reversed(chat.ESCAPES):
        code = code.replace(e, plain)
    assert code == text


def test_round_trip(spark):
    rows = [(c, t, ["system", "user", "assistant", None, "to[ol]"][(c + t) % 5], ["", "</s>", "[INST] \\e <s>", "日本\n語", None][(c * t) % 5]) for c in range(6) for t in range(7)]
    r = chat.read_back(chat.render(chat.reconstruct(chat.events_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")))))
    for got in r.collect():
        want = [(role or "", text or "") for c, t, role, text in rows if c == got["conv_id"]]
        assert [(t["role"], t["text"]) for t in got["read_turns"]] == want
        assert got["read_loss"] == [t for r_, t in want if r_ == "assistant"]
        assert got["formatted"].count("</s>") == len(want)


def test_the_log_has_every_kind_of_event_and_folds_back(spark):
    rows = [(1, None, "assistant", "late"), (1, 3, None, "b"), (1, 3, "", "a"), (1, 3, "user", None), (1, 1, "assistant", "one\ntwo\n\nthree"), (1, 2, "assistant", "\n"), (None, 1, "user", "x")]
    log = chat.events_of(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert {r["kind"] for r in log.select("kind").distinct().collect()} == {"message", "delta", "edit", "regenerate"}
    out = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.reconstruct(log.repartition(3)).collect()}
    assert out[1] == [("assistant", "one\ntwo\n\nthree"), ("assistant", "\n"), ("", "a"), ("", "b"), ("user", ""), ("assistant", "late")]
    assert out[None] == [("user", "x")]


def test_events_fold(spark):
    log = [
        (1, 1, 10, "message", "user", "hi"), (1, 2, 11, "message", "assistant", ""), (1, 3, 11, "delta", "assistant", "he"), (1, 5, 11, "delta", "assistant", "o"), (1, 4, 11, "delta", "assistant", "ll"),
        (1, 6, 12, "message", "user", "wrong turn"), (1, 7, 10, "edit", "user", "hi there"), (1, 8, 11, "regenerate", "assistant", ""), (1, 9, 11, "delta", "assistant", "new"), (1, 10, 13, "message", "user", "thanks"),
        (2, 1, 1, "delta", "assistant", "a"), (2, 2, 1, "delta", "assistant", None),
    ]
    df = spark.createDataFrame(log, "conv_id long, seq long, message_id long, kind string, role string, payload string").repartition(5)
    out = {r["conv_id"]: [tuple(t) for t in r["turns"]] for r in chat.reconstruct(df).collect()}
    assert out[1] == [("user", "hi there"), ("assistant", "new"), ("user", "thanks")]
    assert out[2] == [("assistant", "a")]


def test_no_python_in_native_plans(spark):
    sf = "/root/testdata/sf0.001"
    for q in (line_dedup.op1, mixing.op5, license_scan.op6, chat.op10):
        plan = q(spark, sf)._jdf.queryExecution().executedPlan().toString()
        assert "Python" not in plan and "Arrow" not in plan and "Pandas" not in plan


def test_shared_folders(spark):
    from varloom.llm import common

    a = common.written(spark.range(3), f"{common.shared_folder(spark)}/x")
    assert a.count() == 3
    path = a.inputFiles()[0]
    common.clean_up(spark)
    assert not __import__("os").path.exists(path.removeprefix("file:")) and not common._made

    class Remote:
        master = "spark://host:7077"
        getConf = staticmethod(lambda: {})
        getCheckpointDir = staticmethod(lambda: None)

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        common.shared_folder(type("S", (), {"sparkContext": Remote}))
