"""The transformation against cuts by definition, its checkpoints, and the way back."""

import hashlib

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from varloom.llm import fill_middle as fm

TEXTS = st.text(alphabet=st.sampled_from(list("ab<PSM> \n\0é中🙂́")), max_size=400)


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 9), st.integers(1, 50))
def test_checkpoints(text, step, piece):
    index = fm.Checkpoints(text.encode(), step, piece)
    assert index.n == len(text) and len(index.byte) == max(1, -(-len(text) // step))
    for k in range(len(text) + 1):
        assert index.at(k) == len(text[:k].encode())


@settings(max_examples=300, deadline=None)
@given(st.one_of(st.none(), st.integers(-(2**63), 2**63 - 1)), TEXTS)
def test_by_definition(doc_id, text):
    x = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h = [int(x[8 * k : 8 * k + 8], 16) for k in range(4)]
    n, form, before, middle, output = fm.transformed(doc_id, text.encode())
    assert n == len(text) and fm.restored(form, output) == text.encode()
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h[2] % 100 >= 90:
        assert (form, before, middle, output) == ("plain", None, None, text.encode())
        return
    a, b = sorted((h[0] % (n + 1), h[1] % (n + 1)))
    p, m, s = text[:a], text[a:b], text[b:]
    assert form == ("spm" if h[3] % 100 < 20 else "psm") and (before, middle) == (a, b - a)
    assert output.decode() == (f"<P>{p}<S>{s}<M>{m}" if form == "psm" else f"<S>{s}<P>{p}<M>{m}")


def test_half_sentinels_at_the_cuts():
    for a in ("<", "<P", "<S", "<M", ">", "<<"):
        for form, output in (("psm", f"<P>{a}<S>{a}<M>{a}"), ("spm", f"<S>{a}<P>{a}<M>{a}")):
            assert fm.restored(form, output.encode()) == (3 * a).encode()


def test_rows(spark):
    long = "née 中\n" * 200_000
    rows = [(1, long, "a"), (None, "no id", "b"), (None, None, "c"), (2, "", "d"), (3, "x <M> y", "e"), (4, "same", "f"), (4, "same", "f")]
    docs = spark.createDataFrame(rows, "doc_id int, text string, Form string")
    with pytest.raises(ValueError, match="form"):
        fm.fill_middle(docs)
    out = fm.fill_middle(docs, prefix="fim_")
    assert out.columns == ["doc_id", "text", "Form", "fim_n", "fim_form", "fim_prefix_chars", "fim_middle_chars", "fim_output"]
    got = fm.restore(out, "fim_form", "fim_output", "again").collect()
    assert len(got) == len(rows) and all(r["again"] == (r["text"] or "") for r in got)
    by = {r["Form"]: r for r in got}
    assert by["a"]["fim_n"] == len(long) and by["a"]["fim_prefix_chars"] is not None and by["c"]["fim_form"] == by["d"]["fim_form"] == by["e"]["fim_form"] == "plain"
