"""Fill-in-the-middle transformation with a sparse checkpoint index.

A text is cut by code points but stored as UTF-8, where a code point has no fixed size. While a text's code points are counted, piece
by piece, the byte offset of every STEP-th one is recorded. A cut is found by binary search in these checkpoints and a short scan of at
most STEP code points from there. No array of all code points' places is made: beyond the text, memory is one checkpoint for STEP code
points and one piece.

A text is `plain` (as it is), `psm` (prefix, suffix, middle) or `spm` (suffix, prefix, middle); the parts follow their sentinels. Texts
that hold a sentinel stay plain, so every output is taken apart again by its form alone.

Edge cases: a null text is empty, and an empty text plain; a null id counts as an empty one (its choices are those of "1:"); repeated
rows stay, each with the same result; an empty table gives none; columns that are there already stay, and a clash with the new ones is an
error unless another prefix is given.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varloom.llm.wordhash import blocks

PREFIX, SUFFIX, MIDDLE = b"<P>", b"<S>", b"<M>"
#: Code points from one checkpoint to the next, and bytes that are counted at once.
STEP, PIECE = 1024, 1 << 16
#: Of 100 texts, those that are transformed, and of those the ones with the suffix first.
TRANSFORMED, SUFFIX_FIRST = 90, 20


class Checkpoints:
    """The number of code points of a UTF-8 text, and the bytes at which given ones begin."""

    def __init__(self, text: bytes, step: int = STEP, piece: int = PIECE):
        self.text, self.step = np.frombuffer(text, dtype=np.uint8), step
        self.n, found = 0, [np.zeros(1, dtype=np.int64)]
        for at in range(0, len(text), piece):
            first = np.flatnonzero((self.text[at : at + piece] & 0xC0) != 0x80)
            found.append(at + first[-self.n % step :: step])
            self.n += len(first)
        #: byte[k] is where code point k * step begins.
        self.byte = np.concatenate(found[1:]) if self.n else found[0]
        self.point = np.arange(len(self.byte), dtype=np.int64) * step

    def at(self, point: int) -> int:
        """The byte at which a code point begins; the text's end for its number of code points."""
        if point >= self.n:
            return len(self.text)
        k = int(np.searchsorted(self.point, point, side="right")) - 1
        begin = int(self.byte[k])
        near = np.flatnonzero((self.text[begin : begin + 4 * self.step] & 0xC0) != 0x80)
        return begin + int(near[point - int(self.point[k])])


def choices(doc_id: int | None) -> tuple[int, int, int, int]:
    """Four numbers of 32 bits that only the id decides."""
    digest = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).digest()
    return tuple(int.from_bytes(digest[k : k + 4], "big") for k in (0, 4, 8, 12))


def transformed(doc_id: int | None, text: bytes) -> tuple[int, str, int | None, int | None, bytes]:
    """Code points, form, those of the prefix and of the middle, output."""
    h1, h2, h3, h4 = choices(doc_id)
    index = Checkpoints(text)
    if not text or PREFIX in text or SUFFIX in text or MIDDLE in text or h3 % 100 >= TRANSFORMED:
        return index.n, "plain", None, None, text
    one, two = sorted((h1 % (index.n + 1), h2 % (index.n + 1)))
    a, b = index.at(one), index.at(two)
    prefix, middle, suffix = PREFIX + text[:a], MIDDLE + text[a:b], SUFFIX + text[b:]
    if h4 % 100 < SUFFIX_FIRST:
        return index.n, "spm", one, two - one, suffix + prefix + middle
    return index.n, "psm", one, two - one, prefix + suffix + middle


def restored(form: str, output: bytes) -> bytes:
    """The text, from output and form alone: no part holds a sentinel."""
    if form == "plain":
        return output
    head, middle = output.split(MIDDLE)
    if form == "psm":
        prefix, suffix = head.removeprefix(PREFIX).split(SUFFIX)
    else:
        suffix, prefix = head.removeprefix(SUFFIX).split(PREFIX)
    return prefix + middle + suffix


def fill_middle(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: str = "") -> DataFrame:
    """Adds n, form, prefix_chars, middle_chars and output; text_col stays."""
    new = T.StructType().add(f"{prefix}n", "long").add(f"{prefix}form", "string").add(f"{prefix}prefix_chars", "long").add(f"{prefix}middle_chars", "long").add(f"{prefix}output", "string")
    return _added(docs, new, (id_col, text_col), transformed)


def restore(rows: DataFrame, form_col: str = "form", output_col: str = "output", name: str = "restored") -> DataFrame:
    """Adds the text that each output was made from."""
    return _added(rows, T.StructType().add(name, "string"), (form_col, output_col), lambda form, output: (restored(form, output),))


def _added(df: DataFrame, new: T.StructType, use: tuple[str, str], row) -> DataFrame:
    """df with the columns that row(value, text as bytes) gives."""
    clash = {c.lower() for c in df.columns} & {c.lower() for c in new.names}
    if clash:
        raise ValueError(f"columns {sorted(clash)} are there already; give another prefix or name")
    kinds = [{"long": pa.int64(), "bigint": pa.int64(), "string": pa.string()}[f.dataType.simpleString()] for f in new]
    at = [df.columns.index(c) for c in use]

    def add(batches):
        for whole in batches:
            for b in blocks(whole, at[1]):
                texts = b.column(at[1]).cast(pa.large_binary())
                got = [row(v, t.as_buffer().to_pybytes() if t.is_valid else b"") for v, t in zip(b.column(at[0]).to_pylist(), texts, strict=True)]
                columns = [pa.array([x[k] for x in got], type=pa.binary() if kind == pa.string() and k == len(kinds) - 1 else kind).cast(kind) for k, kind in enumerate(kinds)]
                yield pa.RecordBatch.from_arrays([*b.columns, *columns], names=[*b.schema.names, *new.names])

    return df.mapInArrow(add, T.StructType([*df.schema.fields, *new.fields]))


def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    out = fill_middle(docs).drop("text")
    return restore(out).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256).alias("output_sha256"), F.sha2("restored", 256).alias("restored_sha256"))


SQL = """
WITH h AS (
  SELECT doc_id, coalesce(text, '') AS t, sha256('1:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS x FROM documents
), c AS (
  SELECT doc_id, t, length(t) AS n, ('0x' || x[1:8])::BIGINT % (length(t) + 1) AS p, ('0x' || x[9:16])::BIGINT % (length(t) + 1) AS q,
    CASE WHEN t = '' OR contains(t, '<P>') OR contains(t, '<S>') OR contains(t, '<M>') OR ('0x' || x[17:24])::BIGINT % 100 >= 90 THEN 'plain'
      WHEN ('0x' || x[25:32])::BIGINT % 100 < 20 THEN 'spm' ELSE 'psm' END AS form
  FROM h
), d AS (
  SELECT *, least(p, q) AS a, greatest(p, q) AS b, '<P>' || substr(t, 1, least(p, q)) AS pre,
    '<M>' || substr(t, least(p, q) + 1, greatest(p, q) - least(p, q)) AS mid, '<S>' || substr(t, greatest(p, q) + 1) AS suf
  FROM c
)
SELECT doc_id, CAST(n AS BIGINT) AS n, form, CASE WHEN form != 'plain' THEN CAST(a AS BIGINT) END AS prefix_chars,
  CASE WHEN form != 'plain' THEN CAST(b - a AS BIGINT) END AS middle_chars,
  sha256(CASE form WHEN 'plain' THEN t WHEN 'psm' THEN pre || suf || mid ELSE suf || pre || mid END) AS output_sha256,
  sha256(t) AS restored_sha256
FROM d
"""
