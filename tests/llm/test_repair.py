"""Conversation repair against a search over all edits, whatever the size of its segments."""

import hashlib
import heapq
import random
import re
import zlib

import numpy as np
import pytest

from varloom.llm import repair

SPACE = " \t\n\x0b\x0c\r"
GRAMMAR = re.compile(r"(s?(ua)+)?")


def ordered(rows):
    key = lambda x: (x[0] is not None, x[0] or 0, x[1], hashlib.sha256(f"{len(x[1])}:{x[1]}{x[2]}".encode()).digest())
    return sorted(((t, " " if r is None else r, " " if x is None else x) for t, r, x in rows), key=key)


def by_search(rows):
    """rows: turn, role, text of one conversation. Its report and repaired rows, by a cheapest-first search over sequences of edits, least
    letters first among equal costs; what has been said is a string, checked by the grammar itself."""
    rows = ordered(rows)
    seen, kind = set(), []
    for _, r, x in rows:
        bare = x.strip(SPACE)
        kind.append("blank" if not bare else "duplicate" if (r, x) in seen else "truncated" if bare[-1] not in ".!?" else "")
        seen.add((r, x))
    turns = {t for t, _, _ in rows if t is not None}
    pairs = [a[1][:1] + b[1][:1] for a, b in zip(rows[:-1], rows[1:], strict=True)]
    counts = [max(turns) - min(turns) + 1 - len(turns) if turns else 0, *[kind.count(k) for k in ("blank", "duplicate", "truncated")], sum(p not in ("su", "ua", "au") for p in pairs)]
    queue, done = [(0, "", 0, "", ())], set()
    while True:
        cost, audit, i, said, out = heapq.heappop(queue)
        if i == len(rows) and GRAMMAR.fullmatch(said):
            return [*counts, cost, audit], list(out)
        short = (i, said[:1] if len(said) < 2 else said[-1] + "+")
        if short in done:
            continue
        done.add(short)
        prefix = lambda x: any(GRAMMAR.fullmatch(x + end) for end in ("", "a", "ua"))
        options = [("I", role, "", i, 2) for role in ("user", "assistant")]
        if i < len(rows):
            _, r, x = rows[i]
            options.append(("D", None, None, i + 1, 3))
            if kind[i] not in ("blank", "duplicate"):
                cut = kind[i] == "truncated"
                options += [("R", role, x, i + 1, 2 + cut) for role in ("user", "assistant")]
                if r[:1] in ("s", "u", "a") and r:
                    options.append(("K", r, x, i + 1, cut))
        for letter, role, text, j, price in options:
            after = said + role[0] if role else said
            if letter == "D" or prefix(after):
                heapq.heappush(queue, (cost + price, audit + letter, j, after, out if letter == "D" else (*out, (letter, role, text))))


def generated(seed, n):
    rng, out = random.Random(seed), []
    for conv in range(n):
        for k in range(rng.choice([1, 2, 3, 5, 9, 30])):
            turn = rng.choice([None, k, k, k, k // 2])
            role = rng.choice(["user", "assistant", "user", "assistant", "system", "tool", "", None])
            text = rng.choice(["Yes.", "No!", f"What {k}?", "cut", "cut too ", " \n", "", None, "Ja. \t"])
            out += [(None if conv == 3 else conv, turn, role, text)] * rng.choice([1, 1, 1, 2, 3])
    return out


@pytest.mark.parametrize(("chunk", "batch"), [(4096, 10_000), (1, 10_000), (3, 10_000), (4096, 2)])
def test_against_search(spark, chunk, batch):
    rows = generated(chunk + batch, 60)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", batch)
    try:
        report, repaired = repair.repair(spark.createDataFrame(rows, "conv_id long, turn int, role string, text string"), chunk)
        got = {r["conv_id"]: [r[k] for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit")] for r in report.collect()}
        texts = {}
        for r in sorted(repaired.collect(), key=lambda r: (r["seg"], r["pos"])):
            texts.setdefault(r["conv_id"], []).append((r["edit"], r["role"], r["text"]))
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    convs = {}
    for c, *x in rows:
        convs.setdefault(c, []).append(tuple(x))
    assert got.keys() == convs.keys() and len(got) == 60
    for c, x in convs.items():
        counts, out = by_search(x)
        assert got[c] == counts, x
        assert texts.get(c, []) == out
        assert GRAMMAR.fullmatch("".join(r[:1] for _, r, _ in out))


def test_costs_agree_in_both_directions():
    """Forward plus backward costs have the same minimum at every layer."""
    rng = np.random.default_rng(5)
    size = np.array([1, 7, 40, 3])
    code, begin = rng.integers(0, 16, size.sum()), np.concatenate([[0], np.cumsum(size)[:-1]])
    extra = 3 * rng.integers(0, 3, size.sum())
    at, f, b = repair._costs(code, extra, begin, size, np.tile(repair.START, (4, 1)), np.tile(repair.END, (4, 1)))
    for k in range(4):
        assert len({int((f[x] + b[x]).min()) for x in range(at[k], at[k] + size[k] + 1)}) == 1


def test_damage(spark):
    rows = [(c, t, "assistant", "One. Two! Three?") for c in range(40) for t in range(5)] + [(None, None, None, None), (None, 1, None, "x."), (7, None, "user", None)]
    want = []
    for c, t, r, x in rows:
        d = zlib.crc32(f"{' ' if c is None else c}:{' ' if t is None else t}".encode()) % 20
        r, x = " " if r is None else r, " " if x is None else x
        x = "" if d == 1 else "".join(k for k in x if k not in ".!?") if d == 2 else x
        want += [(c, t, "user" if d == 4 else r, x)] * (0 if d == 0 else 2 if d == 3 else 1)
    got = repair.damaged(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    assert sorted(map(str, (tuple(r) for r in got.collect()))) == sorted(map(str, want))


def test_only_named_columns_are_read(spark):
    rows = [("c", 0, "user", "Hi.", "x", 1), ("c", 1, "assistant", "Yes", "y", 2)]
    df = spark.createDataFrame(rows, "conv_id string, turn short, role string, text string, Seg string, audit int")
    report, repaired = repair.repair(df)
    assert [tuple(r) for r in report.collect()] == [("c", 0, 0, 0, 1, 0, 1, "KK")]
    assert sorted((r["pos"], r["edit"], r["role"], r["text"]) for r in repaired.collect()) == [(0, "K", "user", "Hi."), (1, "K", "assistant", "Yes")]
