"""SimHash near-duplicates: fingerprints of 64 bits, linked where at most RADIUS bits differ, by tiled exact comparison.

A text's fingerprint comes from the XXH64 (seed 42) of its 3-word shingles, repeats included: a bit is set where more than half of the
hashes have it. Equal fingerprints are one member, so copies cost nothing beyond their fingerprint.

All members against all grow with the square of their number, so tiles are formed where links can be: the 64 bits make PARTS parts, and
RADIUS differences leave PARTS - RADIUS of them untouched. For every choice of that many parts, members that agree in them make a bin;
each link lies in a bin whole. A bin's members, in the order of their population counts, make tiles of TILE. Two tiles whose population
counts differ by more than the radius are skipped, others compared whole: exclusive-or of all pairs and a count of their bits, with
NumPy. Tiles whose members are all in one component already need no comparison.

What leaves a task is a forest: a member and another of its component, at most one row a member. A bin beyond CHUNK members is dealt by
population count and, beyond that, by a hash; parts of it meet in tasks of their own, two by two, where counts allow. A member's rows
grow with the number of such parts, one for CHUNK members.

Edge cases: a null, empty or blank text has fingerprint zero and is linked like any other; fewer than three words are one shingle;
repeated rows, rows of one id and rows without id are rows of their own; component_id is the smallest id reachable, null if none has one;
an empty table gives none; columns that are there already stay in place, whatever their names, if another prefix is given.
"""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.common import shared_folder, written
from varloom.llm.components import components
from varloom.llm.wordhash import blocks

WORDS, SEED, RADIUS = 3, 42, 3
PARTS = 5
TILE, CHUNK = 1024, 8192
#: Bytes of a text that are hashed at once.
PIECE = 1 << 20
_SPACE = b" \t\n\x0b\x0c\r"


def _pieces(text: bytes, size: int):
    """The text cut at white space into pieces of about size bytes."""
    at = 0
    while at < len(text):
        end = min(len(text), at + size)
        while end < len(text) and text[end] not in _SPACE:
            end += 1
        yield text[at:end]
        at = end


def fingerprint(text: bytes, size: int = PIECE) -> int:
    """Unsigned. Words of a piece that begin shingles of the next one are carried over."""
    ones, n, carried = np.zeros(64, dtype=np.int64), 0, []
    digest = xxhash.xxh64_intdigest

    def add(hashes):
        nonlocal ones, n
        h = np.array(hashes, dtype="<u8")
        ones += np.unpackbits(h.view(np.uint8), bitorder="little").reshape(-1, 64).sum(axis=0, dtype=np.int64)
        n += len(h)

    for piece in _pieces(text, size):
        words = carried + piece.lower().split()
        if len(words) >= WORDS:
            whole, ends = b" ".join(words), np.cumsum([len(w) + 1 for w in words]).tolist()
            add([digest(whole[a : b - 1], SEED) for a, b in zip([0, *ends[: -WORDS]], ends[WORDS - 1 :], strict=True)])
            carried = words[1 - WORDS :]
        else:
            carried = words
    if not n and carried:
        add([digest(b" ".join(carried), SEED)])
    return int(np.packbits(2 * ones > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, text_col: str = "text", name: str = "fp") -> DataFrame:
    """The columns of docs but text_col, and the fingerprint as a signed long."""
    if name.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"column {name} is there already; give another name")
    at, rest = docs.columns.index(text_col), [c for c in docs.columns if c != text_col]
    schema = docs.drop(text_col).schema.add(name, "long")

    def of(batches):
        for whole in batches:
            for b in blocks(whole, at):
                texts = b.column(at).cast(pa.large_binary())
                fp = np.array([fingerprint(t.as_buffer().to_pybytes()) if t.is_valid else 0 for t in texts], dtype=np.uint64)
                kept = [b.column(k) for k in range(b.num_columns) if k != at]
                yield pa.RecordBatch.from_arrays([*kept, pa.array(fp.view(np.int64))], names=[*rest, name])

    return docs.mapInArrow(of, schema)


def masks(radius: int = RADIUS, parts: int = PARTS) -> list[int]:
    """For each choice of parts that a link may leave untouched, their bits."""
    cut = [64 * k // parts for k in range(parts + 1)]
    return [sum(((1 << (cut[k + 1] - cut[k])) - 1) << cut[k] for k in chosen) for chosen in combinations(range(parts), parts - radius)]


def hooked(label: np.ndarray, i: np.ndarray, j: np.ndarray) -> None:
    """Joins the components of i[k] and j[k]; label holds each member's smallest one."""
    while len(i):
        a, b = label[i], label[j]
        apart = a != b
        i, j, a, b = i[apart], j[apart], a[apart], b[apart]
        np.minimum.at(label, np.maximum(a, b), np.minimum(a, b))
        while not np.array_equal(label, below := label[label]):
            label[:] = below


def tiled(fp: np.ndarray, left: int | None = None, radius: int = RADIUS, tile: int = TILE) -> tuple[np.ndarray, np.ndarray]:
    """A forest of the links within fp (unsigned), or, if left is given, of those between fp[:left] and fp[left:]: members and others."""
    label, count = np.arange(len(fp)), np.bitwise_count(fp)
    sides = [np.arange(len(fp))] if left is None else [np.arange(left), np.arange(left, len(fp))]
    sides = [s[np.argsort(count[s], kind="stable")] for s in sides]
    one, other = ([s[k : k + tile] for k in range(0, len(s), tile)] for s in (sides[0], sides[-1]))
    for x, a in enumerate(one):
        for b in other[x:] if left is None else other:
            low, high = max(count[a[0]], count[b[0]]), min(count[a[-1]], count[b[-1]])
            if int(low) - int(high) > radius:
                continue
            least = label[a[0]]
            if (label[a] == least).all() and (label[b] == least).all():
                continue
            i, j = np.nonzero(np.bitwise_count(fp[a][:, None] ^ fp[b][None]) <= radius)
            hooked(label, a[i], b[j])
    joined = np.flatnonzero(label != np.arange(len(fp)))
    return fp[joined], fp[label[joined]]


def bins(members: DataFrame, radius: int = RADIUS, parts: int = PARTS) -> DataFrame:
    """members: fp. A row for each choice of parts: fp, choice, bits (those of fp in these parts)."""
    chosen = F.array(*[F.struct(F.lit(k).alias("choice"), F.lit(m - 2**64 if m >> 63 else m).cast("long").alias("mask")) for k, m in enumerate(masks(radius, parts))])
    return members.select("fp", F.explode(chosen).alias("m")).select("fp", F.col("m.choice").alias("choice"), F.col("fp").bitwiseAND(F.col("m.mask")).alias("bits"))


def links(members: DataFrame, radius: int = RADIUS, parts: int = PARTS, chunk: int = CHUNK) -> DataFrame:
    """members: distinct fp. A forest of the links of every bin: a and b."""
    dealt = bins(members, radius, parts).withColumn("pop", F.bit_count("fp"))
    by_count = dealt.groupBy("choice", "bits", "pop").count()
    whole = by_count.groupBy("choice", "bits").agg(F.sum("count").alias("n"), F.collect_list(F.struct("pop", F.ceil(F.col("count") / chunk).cast("int").alias("chunks"))).alias("has")).filter("n > 1")
    small = F.array(F.struct(F.lit(-1).alias("p"), F.lit(0).alias("i"), F.lit(-1).alias("q"), F.lit(0).alias("j"), F.lit(True).alias("left")))
    mine = F.element_at(F.filter("has", lambda h: h["pop"] == F.col("pop")), 1)["chunks"]
    #: A part of a large bin is (population count, number); a pair of parts is named with the smaller first, a part with itself once.
    pairs = F.flatten(F.transform(
        F.filter("has", lambda h: F.abs(h["pop"] - F.col("pop")) <= radius),
        lambda h: F.transform(F.sequence(F.lit(0), h["chunks"] - 1), lambda j: F.when(
            (F.col("pop") < h["pop"]) | ((F.col("pop") == h["pop"]) & (F.col("part") <= j)),
            F.struct(F.col("pop").alias("p"), F.col("part").alias("i"), h["pop"].alias("q"), j.alias("j"), F.lit(True).alias("left")),
        ).otherwise(F.struct(h["pop"].alias("p"), j.alias("i"), F.col("pop").alias("q"), F.col("part").alias("j"), F.lit(False).alias("left")))),
    ))
    met = (
        dealt.join(whole, ["choice", "bits"])
        .withColumn("part", F.when(F.col("n") > chunk, F.pmod(F.xxhash64("fp", F.lit("part")), mine).cast("int")).otherwise(0))
        .select("fp", "choice", "bits", F.explode(F.when(F.col("n") > chunk, pairs).otherwise(small)).alias("m"))
        .select("choice", "bits", F.col("m.p").alias("p"), F.col("m.i").alias("i"), F.col("m.q").alias("q"), F.col("m.j").alias("j"), F.col("m.left").alias("left"), "fp")
    )
    key = ["choice", "bits", "p", "i", "q", "j"]
    sorted_ = met.repartition(*key).sortWithinPartitions(*key, "left")
    return sorted_.select(*key, "left", "fp").mapInArrow(lambda batches: _compared(batches, radius), "a long, b long")


def _compared(batches, radius: int):
    """Runs of rows of one key, sorted by it, to their forests. The last run of a batch may go on in the next one."""
    held: list[pa.RecordBatch] = []

    def forests(table):
        fp = table.column("fp").to_numpy().astype(np.int64).view(np.uint64)
        keys = [table.column(k).to_numpy() for k in ("choice", "bits", "p", "i", "q", "j")]
        left = table.column("left").to_numpy(zero_copy_only=False).astype(bool)
        edge = np.concatenate([[0], np.flatnonzero(np.any([k[1:] != k[:-1] for k in keys], axis=0)) + 1, [len(fp)]])
        size = np.diff(edge)
        a, b = [], []
        two = edge[:-1][(size == 2) & _within(keys, edge)]
        near = np.bitwise_count(fp[two] ^ fp[two + 1]) <= radius
        a.append(fp[two][near])
        b.append(fp[two + 1][near])
        for k in np.flatnonzero((size > 1) & ~((size == 2) & _within(keys, edge))):
            s = slice(edge[k], edge[k + 1])
            if keys[2][s.start] == keys[4][s.start] and keys[3][s.start] == keys[5][s.start]:
                x, y = tiled(fp[s], None, radius)
            else:  # rows of the second part come first, False before True
                x, y = tiled(fp[s], int((~left[s]).sum()), radius)
            a.append(x)
            b.append(y)
        return pa.RecordBatch.from_arrays([pa.array(np.concatenate(x).view(np.int64)) for x in (a, b)], names=["a", "b"])

    for batch in batches:
        if not batch.num_rows:
            continue
        held.append(batch)
        table = pa.Table.from_batches(held)
        last = {k: table.column(k)[-1].as_py() for k in ("choice", "bits", "p", "i", "q", "j")}
        first = {k: table.column(k)[0].as_py() for k in last}
        if first == last:
            continue
        open_ = np.ones(table.num_rows, dtype=bool)
        for k, v in last.items():
            open_ &= table.column(k).to_numpy() == v
        begin = int(np.flatnonzero(~open_)[-1]) + 1
        yield forests(table.slice(0, begin))
        held = table.slice(begin).to_batches()
    if held:
        yield forests(pa.Table.from_batches(held))


def _within(keys: list[np.ndarray], edge: np.ndarray) -> np.ndarray:
    """Which runs are a part with itself."""
    at = edge[:-1]
    return (keys[2][at] == keys[4][at]) & (keys[3][at] == keys[5][at])


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", prefix: str = "", radius: int = RADIUS, chunk: int = CHUNK) -> DataFrame:
    """The columns of docs but text_col; fp, a signed long; component_id, the smallest id reachable by links."""
    folder = shared_folder(docs.sparkSession)
    fp, component = f"{prefix}fp", f"{prefix}component_id"
    if component.lower() in (c.lower() for c in docs.columns):
        raise ValueError(f"column {component} is there already; give another prefix")
    prints = written(fingerprints(docs, text_col, fp), f"{folder}/prints")
    members = written(prints.groupBy(F.col(fp).alias("fp")).agg(F.min(id_col).alias("least")), f"{folder}/members")
    joined = written(links(members.select("fp"), radius, chunk=chunk).distinct(), f"{folder}/links")
    reached = components(joined, f"{folder}/components")
    root = F.coalesce("component", "fp")
    grouped = members.join(reached.select(F.col("id").alias("fp"), "component"), "fp", "left").select("fp", root.alias("root"), "least")
    least = grouped.groupBy("root").agg(F.min("least").alias(component))
    of_fp = grouped.join(least, "root").select(F.col("fp").alias(fp), component)
    return prints.join(of_fp, fp).select(*[F.col(f"`{c}`") for c in docs.columns if c != text_col], fp, component)


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return near_duplicates(docs).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
