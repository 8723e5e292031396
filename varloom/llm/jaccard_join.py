"""N-gram Jaccard join with signature trees, and the classes it links.

A document's set holds the hashes of its k-word shingles. Documents with equal sets are one class, which its smallest id stands
for. Two sets whose Jaccard similarity is p percent or more share one of the first n - ceil(p n / 100) + 1 shingles in any order
common to all sets (prefix filter); the order puts shingles last that a count sketch of fixed size shows to be frequent. Classes
that share such a shingle make a block. A block beyond CHUNK members is dealt into chunks by a hash.

Within a block a signature tree is built over the members by size: leaves hold a bitmap of the set's shingles, inner nodes the OR of
their bitmaps, the range of sizes and the largest number of shingles that bitmaps hide. A dual traversal drops node pairs whose sizes
or whose largest possible overlap rule out any link, and the exact test on the whole sets follows for the pairs that remain.

Groups of copies would make the pairs grow with the square of their size, so it is done in two rounds. The first keeps, for each
member, only its most promising earlier partner; tested links give components. The second traverses again the members of the pairs
that were left out, where their blocks still span several components, skips node pairs within one component, and keeps the members
that may link to another one. With the texts of
these a block's remaining pairs are tested where they are, none of them emitted: only links that join components leave the task.
Chunks of one block meet in the second round too: the members outside its largest component against all. Where these are more than DEALT
chunks, they meet only if they share a second shingle of their prefixes one longer, which two sets that link must (2-prefix filter): so
members that have nothing but one frequent shingle in common don't meet, and a member's rows don't grow with its block. No link between
components is lost, at any block size.

Edge cases: a null or empty text, or one without words, has an empty set and is linked with nothing, not even its like; a text of
fewer than k words has one shingle, the whole sequence; rows with one doc_id are one document, whose texts' classes are linked with
each other; each row with a null doc_id is a document of its own, which may join others (its component_id is the smallest doc_id
reachable, null if there is none); an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.common import delete, release, shared_folder, written
from varloom.llm.components import components
from varloom.llm.wordhash import blocks as slices
from varloom.llm.wordhash import mixed, shingles

#: Counters of the frequency sketch (a power of two), and the pieces in which they are summed.
SKETCH_BITS, PIECES = 20, 64
#: Members of a block that one tree holds; fanout of the tree's nodes.
CHUNK, FANOUT = 512, 16
#: Chunks of members outside a block's largest component up to which all others meet each of them.
DEALT = 16


def raw(text) -> bytes:
    return (text or "").encode("utf-8", "replace")


# The frequency sketch -------------------------------------------------------------------------------------------------------


def sketch(texts: DataFrame, k: int) -> np.ndarray:
    """texts: one column. For each counter, the order class of the shingles that fall on it: 0 up to twice the mean, one more for each doubling. The
    counters are of fixed number, summed by pieces on the executors; one byte for each comes to the driver."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << SKETCH_BITS, dtype=np.int64)
        for batch in batches:
            for part in slices(batch, 0):
                got = np.concatenate([shingles(raw(t.as_py()), k) for t in part.column(0)])
                counts += np.bincount((got >> np.uint64(64 - SKETCH_BITS)).astype(np.int64), minlength=len(counts))
        if counts.any():
            yield pieces(counts.reshape(PIECES, -1))

    def pieces(rows: np.ndarray, which=range(PIECES)) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(list(which), type=pa.int32()), pa.array([r.astype("<i4" if r.max() < 2**31 else "<i8").tobytes() for r in rows], type=pa.binary())], names=["piece", "counts"])

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        size = (1 << SKETCH_BITS) // PIECES
        for batch in batches:
            for p, c in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                b = c.as_buffer()
                part = np.frombuffer(b, dtype="<i4" if b.size == 4 * size else "<i8")
                sums[p] = sums.get(p, 0) + part.astype(np.int64)
        if sums:
            yield pieces(np.array(list(sums.values())), sums)

    schema = "piece int, counts binary"
    done = texts.mapInArrow(count, schema).repartition(PIECES, "piece").mapInArrow(add, schema)
    out, size = np.zeros((PIECES, (1 << SKETCH_BITS) // PIECES), dtype=np.int64), (1 << SKETCH_BITS) // PIECES
    for row in done.collect():  # PIECES rows, whatever the input
        c = bytes(row["counts"])
        out[row["piece"]] = np.frombuffer(c, dtype="<i4" if len(c) == 4 * size else "<i8")
    out = out.reshape(-1)
    return np.floor(np.log2(np.maximum(out / (2 * out.mean() + 1), 1))).astype(np.uint8)


def prefix(s: np.ndarray, classes: np.ndarray, percent: int) -> np.ndarray:
    """The first shingles in the common order, as int64 keys: order class, then hash. One more than the prefix filter needs, last."""
    n = len(s)
    order = (classes[(s >> np.uint64(64 - SKETCH_BITS)).astype(np.int64)].astype(np.uint64) << np.uint64(56)) | (s >> np.uint64(8))
    p = min(n, n + (-percent * n // 100) + 2)
    return np.sort(np.partition(order, p - 1)[:p] if p < n else order).view(np.int64)


def prefix_size(percent: int) -> Column:
    """The prefix filter's number of keys, of n."""
    return (F.col("n") - F.ceil(F.col("n") * F.lit(percent) / 100) + 1).cast("int")


# Signatures -----------------------------------------------------------------------------------------------------------------


def bitmap(s: np.ndarray, each: int = 2) -> np.ndarray:
    """2**j >= each n bits, 64 at least, by the low bits of the hashes: the map of half the size is the OR of the halves."""
    bits = max(64, 1 << (each * len(s) - 1).bit_length())
    at = (s & np.uint64(bits - 1)).astype(np.int64)
    out = np.zeros(bits // 64, dtype=np.uint64)
    np.bitwise_or.at(out, at >> 6, np.uint64(1) << (at & 63).astype(np.uint64))
    return out


class Tree:
    """Levels of nodes over members sorted by size, leaves last: of each node the OR of the bitmaps, sizes from and to, the most
    shingles hidden by shared bits, and the component if all members have the same one, else -1."""

    def __init__(self, n: np.ndarray, maps: np.ndarray, comp: np.ndarray):
        bits = np.bitwise_count(maps).sum(axis=1).astype(np.int64)
        self.levels = [(maps, n, n, n - bits, comp)]
        while len(self.levels[0][1]) > 1:
            maps, lo, hi, hidden, comp = self.levels[0]
            at = np.arange(0, len(lo), FANOUT)
            same = np.minimum.reduceat(comp, at) == np.maximum.reduceat(comp, at)
            self.levels.insert(0, (np.bitwise_or.reduceat(maps, at, axis=0), np.minimum.reduceat(lo, at), np.maximum.reduceat(hi, at), np.maximum.reduceat(hidden, at), np.where(same, comp[at], -1)))


def possible(a, b, i: np.ndarray, j: np.ndarray, percent: int, leaves: bool) -> tuple[np.ndarray, np.ndarray]:
    """Of the node pairs (i, j) of levels a and b: whether a link is possible, and the largest possible overlap."""
    common = np.empty(len(i), dtype=np.int64)
    step = max(1, 4_000_000 // max(1, a[0].shape[1]))
    for at in range(0, len(i), step):
        common[at : at + step] = np.bitwise_count(a[0][i[at : at + step]] & b[0][j[at : at + step]]).sum(axis=1)
    if leaves:  # each bit of its own is a shingle that the other lacks
        most = np.minimum(common + a[3][i], common + b[3][j])
    else:
        most = np.minimum(np.minimum(common + np.minimum(a[3][i], b[3][j]), a[2][i]), b[2][j])
    sizes = (100 * a[2][i] >= percent * b[1][j]) & (100 * b[2][j] >= percent * a[1][i])
    apart = (a[4][i] != b[4][j]) | (a[4][i] == -1)
    return sizes & apart & ((100 + percent) * most >= percent * (a[1][i] + b[1][j])), most


def traverse(a: Tree, b: Tree, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Dual traversal, level by level: the leaf pairs that may link, with their largest possible overlap."""
    x, y = len(a.levels), len(b.levels)
    i = j = np.zeros(1, dtype=np.int64)
    p = q = 0
    while True:
        leaves = p == x - 1 and q == y - 1
        ok, most = possible(a.levels[p], b.levels[q], i, j, percent, leaves)
        if a is b:
            ok &= i < j if leaves else i <= j
        i, j, most = i[ok], j[ok], most[ok]
        if leaves or not len(i):
            return i, j, most
        down_a, down_b = p < x - 1, q < y - 1
        if down_a:
            p += 1
        if down_b:
            q += 1
        i, j = children(i, len(a.levels[p][1]) if down_a else 0, down_a, j, len(b.levels[q][1]) if down_b else 0, down_b)


def children(i: np.ndarray, n_i: int, down_i: bool, j: np.ndarray, n_j: int, down_j: bool) -> tuple[np.ndarray, np.ndarray]:
    steps_i, steps_j = np.arange(FANOUT if down_i else 1), np.arange(FANOUT if down_j else 1)
    a = (i * (FANOUT if down_i else 1))[:, None, None] + steps_i[None, :, None] + 0 * steps_j[None, None, :]
    b = (j * (FANOUT if down_j else 1))[:, None, None] + steps_j[None, None, :] + 0 * steps_i[None, :, None]
    a, b = a.reshape(-1), b.reshape(-1)
    ok = np.ones(len(a), dtype=bool)
    if down_i:
        ok &= a < n_i
    if down_j:
        ok &= b < n_j
    return a[ok], b[ok]


def block_pairs(ids: np.ndarray, sizes: np.ndarray, maps: list[np.ndarray], comp: np.ndarray | None, percent: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The pairs of a block's members that may link, as places, with their largest possible overlap; with components, only the pairs
    between them."""
    by = np.lexsort((ids, sizes)) if comp is None else np.lexsort((ids, sizes, comp))
    sizes, maps = sizes[by], [maps[k] for k in by]
    comp = np.arange(len(ids)) if comp is None else comp[by]
    widths = np.array([len(m) for m in maps])
    found = []
    for w in np.unique(widths):
        at = np.flatnonzero(widths == w)
        tree = Tree(sizes[at], np.array([maps[k] for k in at]), comp[at])
        i, j, most = traverse(tree, tree, percent)
        found.append((at[i], at[j], most))
        up = np.flatnonzero(widths == 2 * w)  # beyond that, sizes differ too much to link
        if len(up):
            folded = np.array([maps[k][:w] | maps[k][w:] for k in up])
            i, j, most = traverse(tree, Tree(sizes[up], folded, comp[up]), percent)
            found.append((at[i], up[j], most))
    i, j, most = (np.concatenate([f[k] for f in found]) for k in range(3))
    return by[i], by[j], most


def most_promising(ids: np.ndarray, sizes: np.ndarray, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
    """Of a block's pairs, whether it is the one of the largest possible similarity of its later member with an earlier one, by size."""
    rank = np.empty(len(ids), dtype=np.int64)
    rank[np.lexsort((ids, sizes))] = np.arange(len(ids))
    early, late = np.minimum(rank[i], rank[j]), np.maximum(rank[i], rank[j])
    order = np.lexsort((early, -most / (sizes[i] + sizes[j]), late))
    out = np.zeros(len(i), dtype=bool)
    out[order] = np.diff(late[order], prepend=-1) != 0
    return out


def overlap(s: np.ndarray, t: np.ndarray) -> int:
    s, t = (s, t) if len(s) <= len(t) else (t, s)
    return int((t[np.minimum(np.searchsorted(t, s), len(t) - 1)] == s).sum()) if len(s) else 0


def linked(s: np.ndarray, t: np.ndarray, percent: int) -> bool:
    both = overlap(s, t)
    return both > 0 and 100 * both >= percent * (len(s) + len(t) - both)


# A filter of ids ------------------------------------------------------------------------------------------------------------


def filtered(docs: DataFrame, needed: DataFrame) -> DataFrame:
    """The rows of docs (h, h2, t) whose hash h may be needed: one bit for each hash, 16 bits for each needed one, in a map of 128 KB to
    64 MB whatever the input, put together on the executors by pieces. It keeps texts that no one needs from being shuffled; an
    exact join must follow. Beyond 30 million needed rows the map fills up, and lets more texts pass."""
    count = needed.count()
    bits = min(29, max(20, (16 * count).bit_length()))
    part = bits - 6  # 64 pieces

    def hashed(ids: pa.Array) -> np.ndarray:
        return mixed(ids.to_numpy(zero_copy_only=False).view(np.uint64)) >> np.uint64(64 - bits)

    def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """The bits of a piece; its rows are together."""
        maps: dict[int, np.ndarray] = {}
        for batch in batches:
            for piece, at in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                if piece not in maps:
                    maps[piece] = np.zeros(1 << part, dtype=bool)
                maps[piece][at] = True
        if maps:
            yield pa.RecordBatch.from_arrays([pa.array(list(maps), type=pa.int32()), pa.array([np.packbits(m).tobytes() for m in maps.values()], type=pa.binary())], names=["piece", "map"])

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = hashed(batch.column(0))
            yield pa.RecordBatch.from_arrays([pa.array((at >> np.uint64(part)).astype(np.int32)), pa.array((at & np.uint64((1 << part) - 1)).astype(np.int32))], names=["piece", "at"])

    pieces = needed.select("h").mapInArrow(place, "piece int, at int").distinct().repartition(64, "piece").mapInArrow(mark, "piece int, map binary")
    whole = np.zeros((64, (1 << part) // 8), dtype=np.uint8)
    for row in pieces.collect():  # 64 rows of bounded size
        whole[row["piece"]] = np.frombuffer(bytes(row["map"]), dtype=np.uint8)
    shared = docs.sparkSession.sparkContext.broadcast(whole.reshape(-1))

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = hashed(batch.column(0))
            on = (shared.value[(at >> np.uint64(3)).astype(np.int64)] >> (np.uint8(7) - (at & np.uint64(7)).astype(np.uint8))) & np.uint8(1)
            yield batch.filter(pa.array(on.astype(bool)))

    return docs.mapInArrow(keep, "h long, h2 long, t string")


# The join -------------------------------------------------------------------------------------------------------------------


def each_block(blocks: DataFrame, columns: list[str], f, fields: str) -> DataFrame:
    """f on the rows of each block (bid first), giving as many arrays of longs as there are fields."""
    names = [x.split()[0] for x in fields.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, parts, made = [], [], 0

        def close() -> None:
            nonlocal made
            if len(rows) > 1:
                got = f(rows)
                if len(got[0]):
                    parts.append(got)
                    made += len(got[0])
            rows.clear()

        def out() -> pa.RecordBatch:
            nonlocal made
            batch = pa.RecordBatch.from_arrays([pa.array(np.concatenate([p[k] for p in parts]), type=pa.int64()) for k in range(len(names))], names=names)
            parts.clear()
            made = 0
            return batch

        for batch in batches:
            for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if rows and rows[0][0] != row[0]:
                    close()
                    if made > 20_000:
                        yield out()
                rows.append(row)
        close()
        if made:
            yield out()

    return blocks.select(*columns).repartition("bid").sortWithinPartitions("bid").mapInArrow(run, fields)


def column(rows: list[tuple], k: int) -> np.ndarray:
    return np.array([r[k] for r in rows], dtype=np.int64)


def maps_of(rows: list[tuple], k: int) -> list[np.ndarray]:
    return [np.frombuffer(r[k], dtype=np.uint64) for r in rows]


def best_pairs(blocks: DataFrame, percent: int) -> DataFrame:
    """The first round on blocks (bid, d, n, map): with open = 0 its pairs x < y; with open = 1 the block x and a member y of pairs that
    it leaves out. The second round needs no others: every pair but these is ruled out or tested."""

    def f(rows: list[tuple]) -> tuple[np.ndarray, ...]:
        ids, sizes = column(rows, 1), column(rows, 2)
        i, j, most = block_pairs(ids, sizes, maps_of(rows, 3), None, percent)
        best = most_promising(ids, sizes, i, j, most)
        out = np.union1d(i[~best], j[~best])
        i, j = i[best], j[best]
        block = np.full(len(out), rows[0][0], dtype=np.int64)
        return np.repeat(np.array([0, 1]), [len(i), len(out)]), np.concatenate([np.minimum(ids[i], ids[j]), block]), np.concatenate([np.maximum(ids[i], ids[j]), ids[out]])

    return each_block(blocks, ["bid", "d", "n", "map"], f, "open long, x long, y long")


def groups_of(i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """For each of n members the smallest member that pairs (i, j) connect it with."""
    label = np.arange(n)
    while True:
        low = np.minimum(label[i], label[j])
        new = label.copy()
        np.minimum.at(new, i, low)
        np.minimum.at(new, j, low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def undecided(blocks: DataFrame, percent: int) -> DataFrame:
    """The members of blocks (bid, d, n, map, comp) that may link to another component, in blocks of their own: bid, d, comp. Members,
    not pairs, are the rows. A block falls apart into the groups that its pairs connect; a group is named by its members, so that the
    same group from many blocks is one."""

    def f(rows: list[tuple]) -> tuple[np.ndarray, ...]:
        ids, comp = column(rows, 1), column(rows, 4)
        i, j, _ = block_pairs(ids, column(rows, 2), maps_of(rows, 3), np.unique(comp, return_inverse=True)[1], percent)
        at = np.union1d(i, j)
        if not len(at):
            return ids[:0], ids[:0], ids[:0]
        _, group = np.unique(groups_of(i, j, len(ids))[at], return_inverse=True)
        name = np.zeros(group.max() + 1, dtype=np.uint64)
        np.add.at(name, group, mixed(ids[at].view(np.uint64)))
        return mixed(name)[group].view(np.int64), ids[at], comp[at]

    return each_block(blocks, ["bid", "d", "n", "map", "comp"], f, "bid long, d long, comp long").distinct()


def links_between(blocks: DataFrame, k: int, percent: int) -> DataFrame:
    """The links that join components within blocks (bid, d, comp, t): the tree on finer bitmaps, the exact test on the whole sets, the
    likeliest pair first, and no pair that earlier links have joined."""

    def f(rows: list[tuple]) -> tuple[np.ndarray, ...]:
        ids, comp, sets = column(rows, 1), np.unique(column(rows, 2), return_inverse=True)[1], [shingles(raw(r[3]), k) for r in rows]
        sizes = np.array([len(s) for s in sets])
        i, j, most = block_pairs(ids, sizes, [bitmap(s, 16) if len(s) else np.zeros(1, dtype=np.uint64) for s in sets], comp, percent)
        root = np.arange(comp.max() + 1)

        def find(c: int) -> int:
            while root[c] != c:
                root[c] = root[root[c]]
                c = root[c]
            return c

        a, b = [], []
        for p in np.argsort(-most / (sizes[i] + sizes[j] + 1), kind="stable").tolist():
            x, y = find(comp[i[p]]), find(comp[j[p]])
            if x != y and linked(sets[i[p]], sets[j[p]], percent):
                root[max(x, y)] = min(x, y)
                a.append(min(ids[i[p]], ids[j[p]]))
                b.append(max(ids[i[p]], ids[j[p]]))
        return np.array(a, dtype=np.int64), np.array(b, dtype=np.int64)

    return each_block(blocks, ["bid", "d", "comp", "t"], f, "a long, b long").distinct()


def tested(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs whose whole sets have a Jaccard similarity of percent or more. Texts travel, not sets: they are half as large."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [linked(shingles(raw(x.as_py()), k), shingles(raw(y.as_py()), k), percent) for x, y in zip(batch.column(2), batch.column(3), strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], names=["a", "b"]).filter(pa.array(keep, type=pa.bool_()))

    left = texts.select(F.col("d").alias("a"), F.col("t").alias("ta"))
    right = texts.select(F.col("d").alias("b"), F.col("t").alias("tb"))
    return pairs.join(left.hint("merge"), "a").join(right.hint("merge"), "b").select("a", "b", "ta", "tb").mapInArrow(run, "a long, b long").distinct()


#: What tells a row from others: two hashes of its id and text. What tells a class from others: its set's size and two sums of hashes.
ROW, SAME = ["h", "h2"], ["n", "s1", "s2"]


def row_hashes(id_col: str, text_col: str) -> list[Column]:
    own = [F.col(f"`{id_col}`"), F.col(f"`{text_col}`")]
    return [F.xxhash64(*own).alias("h"), F.xxhash64(F.lit(0x0DD), *own, F.isnull(own[0])).alias("h2")]


def grouped(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text", one_id: bool = True) -> DataFrame:
    """A row for each document row: d (its id), h and h2 (which tell id and text), n (its set's size), grp (a number for each group of
    rows that links join; null for an empty set), least (the group's smallest id). one_id: whether rows with one id are linked. percent is 50
or more: the bitmaps of sets of which one is over twice as large as the other are not compared."""
    if not 50 <= percent <= 100:
        raise ValueError("percent must be from 50 to 100")
    spark = docs.sparkSession
    folder = shared_folder(spark)
    narrow = docs.select(F.col(f"`{id_col}`").cast("long").alias("d"), *row_hashes(id_col, text_col), F.col(f"`{text_col}`").alias("t"))
    classes = spark.sparkContext.broadcast(sketch(narrow.select("t"), k))
    salt = np.uint64(0xD6E8FEB86659FD93)

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = classes.value
        for whole in batches:
            for batch in slices(whole, 3):
                sets = [shingles(raw(t.as_py()), k) for t in batch.column(3)]
                arrays = [batch.column(0), batch.column(1), batch.column(2), pa.array([len(s) for s in sets], type=pa.int64())]
                arrays += [pa.array(np.array([mixed(s ^ x).sum(dtype=np.uint64) for s in sets], dtype=np.uint64).view(np.int64)) for x in (np.uint64(0), salt)]
                own = [prefix(s, order, percent) if len(s) else np.empty(0, dtype=np.int64) for s in sets]
                ends = np.cumsum([0, *(len(x) for x in own)]).astype(np.int32)
                arrays.append(pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(own))))
                arrays.append(pa.array([bitmap(s).tobytes() if len(s) else b"" for s in sets], type=pa.binary()))
                yield pa.RecordBatch.from_arrays(arrays, names=["d", "h", "h2", "n", "s1", "s2", "keys", "map"])

    wide = written(narrow.mapInArrow(keys, "d long, h long, h2 long, n long, s1 long, s2 long, keys array<long>, map binary"), f"{folder}/wide")
    every = written(wide.select("d", *ROW, *SAME), f"{folder}/every")
    # A class is numbered as it is written; a row of it stands for its text.
    reps = wide.filter("n > 0").groupBy(*SAME).agg(F.min("d").alias("least"), F.min(F.struct(*ROW, "keys", "map")).alias("r")).select(*SAME, "least", "r.*")
    reps = written(reps.withColumn("d", F.monotonically_increasing_id()), f"{folder}/classes")
    delete(spark, f"{folder}/wide")
    release(spark)
    found = linked_classes(narrow.select(*ROW, "t"), reps, folder, k, percent)
    numbers = reps.select(*SAME, "d", "least")
    odd = None
    if one_id:  # ids of several texts: rare, so that one narrow sum finds them
        own = F.when(F.col("n") > 0, F.struct(*SAME))
        odd = every.filter("d IS NOT NULL").groupBy(F.col("d").alias("i")).agg(F.min(own).alias("x"), F.max(own).alias("y"), F.min("n").alias("fewest"))
        odd = written(odd.filter("x != y OR fewest = 0 AND y IS NOT NULL").select("i", F.expr("x != y").alias("several"), F.expr("fewest = 0").alias("empty")), f"{folder}/ids-of-several-texts")
        odd = None if odd.isEmpty() else odd
    if odd is not None:
        found = joined_by_id(every, numbers, odd.filter("several").select("i"), found, folder)
    group = F.coalesce("component", "d")
    named = numbers.join(found, numbers["d"] == found["id"], "left").select(*SAME, "least", group.alias("grp"))
    least = named.groupBy("grp").agg(F.min("least").alias("least"))
    named = named.drop("least").join(least, "grp")
    out = every.join(named.hint("merge"), SAME, "left")
    if odd is not None:  # an empty text shares the group of its id's other texts
        ids = odd.filter("empty").select(F.col("i").alias("d"))
        others = every.join(ids, "d", "left_semi").filter("n > 0").join(named, SAME).groupBy("d").agg(F.min("least").alias("of_id"))
        out = out.join(others, "d", "left").withColumn("least", F.coalesce("least", "of_id"))
    return out.select("d", *ROW, "n", "grp", F.coalesce("least", F.when(F.col("n") == 0, F.col("d"))).alias("least"))


def joined_by_id(every: DataFrame, numbers: DataFrame, several: DataFrame, found: DataFrame, folder: str) -> DataFrame:
    """found (id, component) with links between the classes of one id's texts. several: the ids (i) that have some."""
    pairs = every.filter("n > 0").join(several, every["d"] == several["i"], "left_semi").select(F.col("d").alias("i"), *SAME).distinct().join(numbers.select(*SAME, "d"), SAME).select("i", "d")
    pairs = written(pairs, f"{folder}/of-one-id")
    links = pairs.join(pairs.groupBy("i").agg(F.min("d").alias("a")), "i").filter("a < d").select("a", F.col("d").alias("b"))
    return components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(links), f"{folder}/components-3")


def linked_classes(narrow: DataFrame, reps: DataFrame, folder: str, k: int, percent: int) -> DataFrame:
    """id and component (classes' numbers) of each class that links join with a smaller one. narrow: h, h2, t of all rows; reps: a row
    for each class, d its number."""
    spark = narrow.sparkSession
    posts = reps.select("d", "n", F.explode(F.slice("keys", F.lit(1), F.least(F.size("keys"), prefix_size(percent)))).alias("key"))
    shared = posts.groupBy("key").agg(F.count("*").alias("c"), F.min("d").alias("lo"), F.max("d").alias("hi"), F.min("n").alias("least"), F.max("n").alias("most"))
    shared = written(shared.filter(f"c > 1 AND lo < hi AND (c > 2 OR 100 * least >= {percent} * most)"), f"{folder}/shared")
    release(spark)
    # Blocks: two members straight from the key's sums; more by a join with the keys that have them.
    chunks = F.ceil(F.col("c") / CHUNK).cast("int")
    chunk = F.pmod(F.xxhash64("d"), F.col("chunks").cast("long")).cast("int")
    more = posts.select("key", "d").join(shared.filter("c > 2").select("key", "c", "lo", chunks.alias("chunks")).hint("merge"), "key")
    big = posts.select("key", "d").join(shared.filter(F.col("c") > CHUNK).select("key"), "key")
    lists = more.groupBy("key", chunk.alias("chunk")).agg(F.array_sort(F.array_union(F.collect_set("d"), F.array(F.min("lo")))).alias("m"))
    lists = lists.select("m").unionByName(shared.filter("c = 2").select(F.array("lo", "hi").alias("m"))).filter("size(m) > 1").dropDuplicates(["m"])
    lists = written(lists.select(F.xxhash64("m").alias("bid"), "m"), f"{folder}/blocks")
    # Postings, maps and texts are met by merge joins at every size, so that a small run's plan is the one of a large run.
    members, maps = lists.select("bid", F.explode("m").alias("d")), reps.select("d", "n", "map").hint("merge")
    release(spark)

    def texts_of(ids: DataFrame, name: str) -> DataFrame:
        """The texts of these classes, and no others."""
        rows = written(reps.select("d", *ROW).join(ids.distinct(), "d", "left_semi"), f"{folder}/rows-{name}")
        out = written(filtered(narrow, rows).join(rows, ROW).select("d", "t").dropDuplicates(["d"]), f"{folder}/texts-{name}")
        release(spark)
        return out

    first = written(best_pairs(members.join(maps, "d"), percent), f"{folder}/round-1")
    pairs = written(first.filter("open = 0 AND x < y").select(F.col("x").alias("a"), F.col("y").alias("b")).distinct(), f"{folder}/pairs")
    release(spark)
    texts = texts_of(pairs.select(F.explode(F.array("a", "b")).alias("d")), "1")
    links = written(tested(pairs, texts, k, percent), f"{folder}/links")
    delete(spark, f"{folder}/texts-1")
    release(spark)
    found = components(links, f"{folder}/components-1")
    # The second round: the pairs left out, in blocks that span components.
    label = F.coalesce("component", "d").alias("comp")
    left = first.filter("open = 1").select(F.col("x").alias("bid"), F.col("y").alias("d"))
    inside = left.join(found, left["d"] == found["id"], "left").select("bid", "d", label)
    several = inside.groupBy("bid").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).filter("x < y").select("bid")
    rest = inside.join(several, "bid", "left_semi").select("bid", "d", "comp")
    if not shared.filter(F.col("c") > CHUNK).isEmpty():
        rest = rest.unionByName(across(big.join(found, big["d"] == found["id"], "left").select("key", "d", label), reps, folder))
    open_members = written(undecided(rest.join(maps, "d"), percent), f"{folder}/undecided")
    release(spark)
    texts = texts_of(open_members.select("d"), "2")
    more_links = written(links_between(open_members.join(texts.hint("merge"), "d"), k, percent), f"{folder}/links-2")
    delete(spark, f"{folder}/texts-2")
    release(spark)
    if not more_links.isEmpty():
        joined = found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionByName(more_links)
        found = components(joined, f"{folder}/components-2")
    return found


def outsiders(inside: DataFrame, by: list[str]) -> DataFrame:
    """inside (by, d, comp) with out: whether a member is outside its block's largest component. Blocks of one component go."""
    counts = inside.groupBy(*by, "comp").agg(F.count("*").alias("x"))
    largest = counts.groupBy(*by).agg(F.max(F.struct("x", "comp")).alias("top"), F.count("*").alias("c")).filter("c > 1").select(*by, F.col("top.comp").alias("main"))
    return inside.join(largest, by).withColumn("out", F.col("comp") != F.col("main")).drop("main")


def dealt(marked: DataFrame, by: list[str], most: int | None) -> tuple[DataFrame, DataFrame | None]:
    """Blocks (bid, d, comp) of marked (by, d, comp, out): a block within a chunk as it is, else its outsiders, by chunks, against all, by
    chunks. And the rows of the blocks that have more than most chunks of outsiders."""
    sizes = marked.groupBy(*by).agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"), F.ceil(F.sum(F.col("out").cast("int")) / CHUNK).cast("int").alias("others"))
    marked, hashed = marked.join(sizes, by), F.xxhash64("d")
    left = None
    if most is not None:
        left, marked = marked.filter(F.col("others") > most), marked.filter(F.col("others") <= most)
    deal = lambda x: F.pmod(hashed, F.col(x).cast("long")).cast("int")
    name = F.xxhash64(*by, "i", "j").alias("bid")
    small = marked.filter("chunks = 1").select(F.xxhash64(*by).alias("bid"), "d", "comp")
    large = marked.filter("chunks > 1")
    other = large.filter("out").withColumn("i", deal("others")).withColumn("j", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).select(name, "d", "comp")
    every = large.withColumn("j", deal("chunks")).withColumn("i", F.explode(F.sequence(F.lit(0), F.col("others") - 1))).select(name, "d", "comp")
    return small.unionByName(other).unionByName(every), left


def across(big: DataFrame, reps: DataFrame, folder: str) -> DataFrame:
    """The second round's blocks (bid, d, comp) of blocks (key, d, comp) beyond one chunk: the members outside the largest component
    against all. Of blocks with many of these, against all that share a second key with them, in blocks of two keys."""
    first = written(outsiders(big, ["key"]), f"{folder}/outsiders")
    few, many = dealt(first, ["key"], DEALT)
    many = written(many.select("key", "d", "comp", "out"), f"{folder}/blocks-of-many")
    if many.isEmpty():
        return few.distinct()
    keyed = many.join(reps.select("d", F.col("keys").alias("second")), "d").select("d", "comp", "out", F.explode("second").alias("key2"), "key").filter("key != key2")
    keyed = written(keyed.groupBy("d", "comp", F.least("key", "key2").alias("key"), F.greatest("key", "key2").alias("key2")).agg(F.max("out").alias("out")), f"{folder}/second-keys")
    met = keyed.groupBy("key", "key2").agg(F.count("*").alias("c"), F.max("out").alias("out")).filter("c > 1 AND out").select("key", "key2")
    two = dealt(outsiders(keyed.drop("out").join(met, ["key", "key2"]), ["key", "key2"]), ["key", "key2"], None)[0]
    return few.unionByName(two).distinct()


def link(docs: DataFrame, k: int = 4, percent: int = 85, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row for each document row: id_col, n_shingles, component_id (the smallest id reachable by links)."""
    return grouped(docs, k, percent, id_col, text_col).select(F.col("d").alias(id_col), F.col("n").alias("n_shingles"), F.col("least").alias("component_id"))


def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text"))


SQL = r"""
WITH RECURSIVE numbered AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, text FROM documents
), words AS MATERIALIZED (
  SELECT rid, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w FROM numbered
), shingles AS MATERIALIZED (
  SELECT DISTINCT rid, array_to_string(w[i:i + 3], ' ') AS s
  FROM (SELECT rid, w, unnest(range(1, greatest(len(w) - 3, least(len(w), 1)) + 1)) AS i FROM words)
), sizes AS MATERIALIZED (SELECT rid, count(*) AS n FROM shingles GROUP BY rid
), links AS MATERIALIZED (
  SELECT a, b FROM (SELECT x.rid AS a, y.rid AS b, count(*) AS c FROM shingles x JOIN shingles y USING (s) WHERE x.rid <> y.rid GROUP BY ALL)
  JOIN sizes p ON p.rid = a JOIN sizes q ON q.rid = b WHERE 100 * c >= 85 * (p.n + q.n - c)
  UNION SELECT x.rid, y.rid FROM words x JOIN words y USING (doc_id) WHERE x.rid <> y.rid
), reach AS (
  SELECT rid AS a, rid AS b FROM words UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b
)
SELECT w.doc_id, coalesce(s.n, 0) AS n_shingles, r.c AS component_id
FROM words w LEFT JOIN sizes s USING (rid) JOIN (SELECT a, min(doc_id) AS c FROM reach JOIN words ON b = rid GROUP BY a) r ON r.a = w.rid
"""
