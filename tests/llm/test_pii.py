"""Personal data: detection against a version in Python, surrogates by their promises."""

import random
import re

import pytest
import regex

from varloom.llm import pii

DOCS = "doc_id long, text string"


def luhn(s):
    return sum(d if k % 2 == 0 else 2 * d - 9 * (d > 4) for k, d in enumerate(map(int, reversed(s)))) % 10 == 0


def mod97(s):
    return int("".join(str(int(c, 36)) for c in s[4:] + s[:4])) % 97


def brute(text):
    """Mentions as (kind, text): the first pattern that matches at a place, checked in plain Python."""
    out = []
    for m in regex.finditer("|".join(f"(?P<{k}>{p})" for k, p in pii.PATTERNS.items()), text or ""):
        kind, plain = m.lastgroup, re.sub("[ -]", "", m.group())
        if not (kind == "card" and not luhn(plain) or kind == "iban" and mod97(plain) != 1):
            out.append((kind, m.group()))
    return out


def rewritten(spark, texts, **more):
    df = spark.createDataFrame(list(enumerate(texts)), DOCS)
    return {r["doc_id"]: r for r in pii.pseudonymise(df, **({"secret": "of these tests"} | more)).collect()}


def test_detection(spark):
    rng = random.Random(4)
    pool = [
        "a.b@mail.example.com", "A.B@MAIL.example.com", "x@y", "@z.com", "+1 (830) 555-5433", "(830) 555-5433", "830-555-5433", "+49 30 901820", "4111111111111111", "4111 1111 1111 1111",
        "4111111111111112", "12345678901234", "1.2.3.4", "300.1.1.1", "1.2.3.4.5", "123-45-6789", "GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765433", "1-555-123-4567", "1 (555) 123 4567", "(555) 123 4567", "555 123 4567", "555 123-4567", "Tel. 030 901820", "030 901820", "2001:db8:85a3:0:0:8a2e:370:7334", "fe80:0::1", "ad::be", "std::cout", "12:30:45", "x" * 90 + "@long.example.org", "Mr. John Smith", "Mrs Smith", "Frau Müller-Lüdenscheidt",
        "plain", "words,", "12.5", "2024-01-01", "é", "\n",
    ]
    texts = [" ".join(rng.choice(pool) for _ in range(rng.randint(0, 12))) for _ in range(150)]
    for d, r in rewritten(spark, texts).items():
        got = {k: r[f"n_{k}"] for k in pii.KINDS}
        want = [k for k, _ in brute(texts[d])]
        assert got == {k: want.count(k) for k in pii.KINDS}, texts[d]
        assert r["n_entities"] == len(want)


def test_distinct_and_the_same_everywhere(spark):
    rng = random.Random(5)
    mails = [f"{rng.choice('abc')}{rng.randint(0, 9)}@{rng.choice(['p', 'q', 'r'])}.com" for _ in range(300)]
    ips = [f"10.0.{rng.randint(0, 3)}.{rng.randint(0, 255)}" for _ in range(300)]
    out = rewritten(spark, [f"{a} x {b}" for a, b in zip(mails, ips, strict=True)])
    to = {}
    for d, r in out.items():
        a, _, b = r["text"].split(" ")
        assert to.setdefault(mails[d], a) == a and to.setdefault(ips[d], b) == b
    assert len(set(to.values())) == len(to) and not set(to) & set(to.values())
    assert len({m.split("@")[1] for m in mails}) == len({to[m].split("@")[1] for m in mails})


def test_full_space_ends(spark):
    """Every address of one letter is there: no surrogate of one letter is free, and distinct longer ones are found."""
    texts = [f"{c}@example.com" for c in "abcdefghijklmnopqrstuvwxyz"]
    got = [r["text"] for r in rewritten(spark, texts).values()]
    assert len(set(got)) == 26


def test_types_and_formats(spark):
    texts = ["4111 1111 1111 1111 4111111111111111", "GB82 WEST 1234 5698 7654 32", "+1 (830) 555-5433 830-555-5433", "10.1.2.3", "123-45-6789", "BOB@EXAMPLE.COM bob@example.com"]
    out = rewritten(spark, texts)
    spaced, plain = out[0]["text"].rsplit(" ", 1)
    assert spaced.replace(" ", "") == plain and luhn(plain) and plain[0] == "4" and plain != "4" + "1" * 15 and re.fullmatch(r"(\d{4} ){3}\d{4}", spaced)
    assert mod97(out[1]["text"].replace(" ", "")) == 1 and re.fullmatch(r"GB\d\d [A-Z]{4} (\d{4} ){3}\d\d", out[1]["text"])
    a, b = out[2]["text"].rsplit(" ", 1)
    assert re.fullmatch(r"\+1 \(\d{3}\) \d{3}-\d{4}", a) and re.sub(r"\D", "", a)[1:] == b.replace("-", "")
    assert brute(out[3]["text"])[0][0] == "ip" and re.fullmatch(r"\d{3}-\d{2}-\d{4}", out[4]["text"])
    upper, lower = out[5]["text"].split(" ")
    assert upper.isupper() and upper.lower() == lower and lower.endswith(".com")


def test_names(spark):
    out = rewritten(spark, ["Mrs. Anna Smith-Jones met Mr. Smith. Anna, Smith-Jones and Smith left; Smithson stayed.", "Herr SMITH", "господин Иван Петров, Петров", "Frau Anna Meier"])
    m = re.fullmatch(r"Mrs\. (\w+) (\w+) met Mr\. (\w+)\. (\w+), (\w+) and (\w+) left; Smithson stayed\.", out[0]["text"])
    anna, jones, smith = m.group(1, 2, 3)
    assert m.group(4, 5, 6) == (anna, jones, smith) and anna.endswith("a") and len({anna, jones, smith}) == 3
    assert out[1]["text"] == "Herr " + smith.upper() and out[3]["text"].split(" ")[1] == anna
    assert re.fullmatch(r"господин [А-Я][а-я]+ ([А-Я][а-я]+), \1", out[2]["text"]) and "Петров" not in out[2]["text"]


def test_long_names_and_common_words(spark):
    out = rewritten(spark, ["Mr Will Maria Juana Carlos Smith left. Will he come? He will. Smith may.", "Frau " + "Anna" * 20 + " kam", "Mr May x@may.org May stayed, Mr May"])
    t = out[0]["text"]
    assert "Will he come? He will." in t and "Smith" not in t and "Carlos" not in t and t.split(" ")[1] != "Will"
    assert "Anna" not in out[1]["text"]
    mr, name, mail, again, stayed, mr2, name2 = out[2]["text"].split(" ")
    assert name == again == name2 != "May" and mail.endswith(".org") and stayed == "stayed,"


def test_phones_and_addresses_keep_their_form(spark):
    out = rewritten(spark, ["1-555-123-4567", "(555) 123 4567", "555 123 4567", "Tel.: 030 901820", "2001:db8::ff00:42:8329"])
    a, b, c = (re.sub(r"\D", "", out[k]["text"])[-10:] for k in range(3))
    assert a == b == c != "5551234567" and re.fullmatch(r"1-\d{3}-\d{3}-\d{4}", out[0]["text"]) and re.fullmatch(r"\(\d{3}\) \d{3} \d{4}", out[1]["text"])
    assert re.fullmatch(r"Tel\.: \d{3} \d{6}", out[3]["text"]) and "901820" not in out[3]["text"]
    assert re.fullmatch(r"[0-9a-f]{4}:[0-9a-f]{3}::[0-9a-f]{4}:[0-9a-f]{2}:[0-9a-f]{4}", out[4]["text"]) and out[4]["n_ip"] == 1


def test_a_secret_is_needed(spark):
    with pytest.raises(ValueError, match="secret"):
        pii.pseudonymise(spark.createDataFrame([(1, "x")], DOCS), "")


def test_keyed_and_repeatable(spark):
    texts = ["write to someone@example.com"]
    assert rewritten(spark, texts)[0] == rewritten(spark, texts)[0]
    assert rewritten(spark, texts)[0]["text"] != rewritten(spark, texts, secret="another")[0]["text"]


def test_edges(spark):
    long = "word " * 100_000 + "a@b.org" + " word" * 100_000
    rows = [(1, None), (2, ""), (3, "nothing here, 12.5 and 2024"), (None, "a@b.org"), (4, long), (5, "a@b.org"), (5, "a@b.org"), (6, "@ + ( \\ $1 a@b.org $0 \\E")]
    df = spark.createDataFrame([(d, t, "kept", "k") for d, t in rows], DOCS + ", n_email string, c string")
    out = pii.pseudonymise(df, "of these tests").collect()
    assert len(out) == len(rows) and all(r["c"] == "k" for r in out)
    by = {r["doc_id"]: r for r in out}
    new = by[None]["text"]
    assert new != "a@b.org" and [by[k]["text"] for k in (1, 2, 3)] == [None, "", "nothing here, 12.5 and 2024"]
    assert by[4]["text"] == long.replace("a@b.org", new) and [r["text"] for r in out if r["doc_id"] == 5] == [new, new]
    assert by[6]["text"] == f"@ + ( \\ $1 {new} $0 \\E" and by[6]["n_email"] == 1


def test_whole_table(spark):
    """The query against plain Python: what is detected goes, all else stays."""
    sf = "/root/testdata/sf0.001"
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    out = pii.op4(spark, sf).collect()
    assert sorted(r["doc_id"] for r in out) == sorted(texts)
    for r in out:
        found = brute(texts[r["doc_id"]])
        assert r["n_entities"] == len(found) and (r["text"] == texts[r["doc_id"]]) == (not found)
        assert not any(m in r["text"] for _, m in found)


def test_native_plan(spark):
    plan = pii.op4(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Arrow", "Pandas"))


@pytest.mark.parametrize("kind", pii.KINDS)
def test_every_kind_is_found(spark, kind):
    text = {"email": "a@b.org", "iban": "DE89370400440532013000", "phone": "+1 830 555 5433", "ssn": "123-45-6789", "ip": "8.8.8.8", "card": "4111-1111-1111-1111", "name": "Mr. Smith"}[kind]
    r = rewritten(spark, [f"see {text}."])[0]
    assert r[f"n_{kind}"] == 1 and text not in r["text"] and r["text"].startswith("see ") and r["text"].endswith(".")
