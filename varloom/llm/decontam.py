"""Benchmark decontamination by greedy string tiling.

Documents and benchmark items are joined on shared seeds, runs of five words (A-Z lower-cased). For each pair that meets, running
Karp-Rabin hashes give the maximal matches of at least five words; the longest match whose words are all unmarked in both texts is
marked, again and again, and a match that is partly marked is cut to what is left. A document is contaminated by an item if the
tiles cover at least the given share of the item's words, in whatever order they stand in the document. An item of fewer than five
words is looked for as it stands: it contaminates the documents that hold all its words as one run. In scripts written without
spaces (Han, kana, Thai, Lao, Myanmar, Khmer) every character is a word. What the hashes report is compared word by word before it
counts.

Equal windows of an item and a document that repeat themselves make pairs in the product of their numbers. Beyond PAIRS of them the
matches are not listed: the longest common run of unmarked words is found anew for each tile, by bisection over names of runs of
doubling length, in memory that grows with the texts only.

The benchmark is broadcast as an index if its number of words is within block_words; beyond it, it is worked off in blocks of that
size by item, so that memory stays bounded and the result is the same.

Edge cases: a null or empty text or item shares nothing; an item of one or two common words contaminates every document that holds
them; repeated items and documents are compared one by one; an empty table on either side gives an empty result; a null
doc_id or item_id is carried along.
"""

from __future__ import annotations

import heapq
import math
import re
from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from varloom.llm.wordhash import blocks, bounds, runs, word_hashes

SEED, COVERAGE = 5, 0.5
BLOCK_WORDS = 2_000_000
#: Pairs of equal windows that are listed at once.
PAIRS = 4_000_000
#: Ranges of the scripts that are written without spaces.
UNSPACED = ((0xE00, 0xEFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3005, 0x3007), (0x3040, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF66, 0xFF9F), (0x20000, 0x3FFFF))
ALONE = re.compile("([" + "".join(f"{chr(a)}-{chr(b)}" for a, b in UNSPACED) + "])")


def spaced(text: str | None) -> bytes:
    """The text as bytes, with spaces around each character of a script that is written without."""
    text = text or ""
    return (text if text.isascii() else ALONE.sub(r" \1 ", text)).encode("utf-8", "replace")


def maximal(item: np.ndarray, doc: np.ndarray, seed: int) -> list[tuple[int, int, int]]:
    """Maximal common runs of at least seed windows' words, as (length, place in item, place in doc). item and doc: the hashes of
    their windows of seed words."""
    order = np.argsort(item, kind="stable")
    left, right = np.searchsorted(item[order], doc, "left"), np.searchsorted(item[order], doc, "right")
    times = right - left
    j = np.repeat(np.arange(len(doc)), times)
    if not len(j):
        return []
    i = order[np.repeat(left, times) + np.arange(len(j)) - np.repeat(np.cumsum(times) - times, times)]
    by = np.lexsort((i, j - i))
    i, j = i[by], j[by]
    new = np.concatenate([[True], (np.diff(j - i) != 0) | (np.diff(i) != 1)])
    at = np.flatnonzero(new)
    length = np.diff(np.concatenate([at, [len(i)]])) + seed - 1
    return list(zip(length.tolist(), i[at].tolist(), j[at].tolist(), strict=True))


def tiles(matches: list[tuple[int, int, int]], n_item: int, n_doc: int, seed: int) -> list[tuple[int, int, int]]:
    """Greedy string tiling: the longest match of unmarked words first; of equals the first in the item, then in the document."""
    heap = [(-n, i, j) for n, i, j in matches]
    heapq.heapify(heap)
    in_item, in_doc, out, free = np.zeros(n_item, dtype=bool), np.zeros(n_doc, dtype=bool), [], n_item
    while heap and free >= seed:
        n, i, j = heapq.heappop(heap)
        n = -n
        marked = in_item[i : i + n] | in_doc[j : j + n]
        if not marked.any():
            in_item[i : i + n] = in_doc[j : j + n] = True
            out.append((i, j, n))
            free -= n
        elif not marked.all():
            edge = np.flatnonzero(np.diff(np.concatenate([[True], marked, [True]])))
            for a, b in zip(edge[::2].tolist(), edge[1::2].tolist(), strict=True):
                if b - a >= seed:
                    heapq.heappush(heap, (a - b, i + a, j + a))
    return out


def pairs(item: np.ndarray, doc: np.ndarray) -> int:
    """The number of pairs of equal windows."""
    values, times = np.unique(item, return_counts=True)
    at = np.minimum(np.searchsorted(values, doc), len(values) - 1)
    return int(times[at][values[at] == doc].sum())


def named(item: np.ndarray, doc: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For 1, 2, 4 ... windows in a row the names of all runs of that many, equal names for equal runs and no others."""
    out, n = [], len(item)
    names = np.unique(np.concatenate([item, doc]), return_inverse=True)[1]
    out.append((names[:n], names[n:]))
    step = 1
    while 2 * step <= min(len(item), len(doc)):
        a, b = out[-1]
        both = np.concatenate([a[: len(a) - step] * (n + len(doc)) + a[step:], b[: len(b) - step] * (n + len(doc)) + b[step:]])
        names = np.unique(both, return_inverse=True)[1]
        out.append((names[: len(a) - step], names[len(a) - step :]))
        step *= 2
    return out


def tiles_by_length(item: np.ndarray, doc: np.ndarray, n_item: int, n_doc: int, seed: int) -> list[tuple[int, int, int]]:
    """The tiles of tiles(maximal(...)), without a list of matches: the longest run of unmarked words first, by bisection."""
    names, size = named(item, doc), len(item) + len(doc)
    in_item, in_doc, out = np.zeros(n_item + 1, dtype=np.int64), np.zeros(n_doc + 1, dtype=np.int64), []

    def free(marked: np.ndarray, windows: int, length: int) -> np.ndarray:
        """Where a run of so many windows has no marked word."""
        before = np.concatenate([[0], np.cumsum(marked[:-1])])
        at = np.arange(windows - length + 1)
        return at[before[at + length + seed - 1] == before[at]]

    def common(length: int) -> tuple[int, int] | None:
        """The first place in the item, then in the document, of an unmarked run of so many windows."""
        level = length.bit_length() - 1
        a, b = names[level]
        i, j = free(in_item, len(item), length), free(in_doc, len(doc), length)
        of_item, of_doc = a[i] * size + a[i + length - (1 << level)], b[j] * size + b[j + length - (1 << level)]
        hit = np.flatnonzero(np.isin(of_item, of_doc))
        return (int(i[hit[0]]), int(j[np.flatnonzero(of_doc == of_item[hit[0]])[0]])) if len(hit) else None

    top = min(len(item), len(doc))
    while top:
        at, low = common(top), 0
        if at is None:
            high = top
            while high - low > 1:
                mid = (low + high) // 2
                got = common(mid)
                low, high, at = (mid, high, got) if got else (low, mid, at)
            top = low
            if not top:
                break
        i, j = at
        n = top + seed - 1
        in_item[i : i + n] = in_doc[j : j + n] = 1
        out.append((i, j, n))
    return out


class Index:
    """The items of a block: their windows, and which items and places have a seed. Items shorter than a seed are one window each, in
    short by number of words."""

    def __init__(self, ids: list, texts: list[str | None], seed: int = SEED):
        self.seed, self.ids, self.words, self.windows, self.raw, less = seed, [], [], [], [], []
        for k, t in zip(ids, texts, strict=True):
            w = word_hashes(spaced(t), lower=True)
            if len(w) >= seed:
                self.ids.append(k)
                self.raw.append(spaced(t))
                self.words.append(len(w))
                self.windows.append(runs(w, seed))
            elif len(w):
                less.append((k, w, spaced(t)))
        self.short: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for n in sorted({len(w) for _, w, _ in less}):
            own = [(k, runs(w, n)[0], t) for k, w, t in less if len(w) == n]
            hashes = np.array([h for _, h, _ in own], dtype=np.uint64)
            by = np.argsort(hashes, kind="stable")
            self.short[n] = hashes[by], len(self.ids) + by
            self.ids += [k for k, _, _ in own]
            self.raw += [t for _, _, t in own]
            self.words += [n] * len(own)
        every = np.concatenate(self.windows) if self.windows else np.empty(0, dtype=np.uint64)
        owner = np.repeat(np.arange(len(self.windows)), [len(w) for w in self.windows])
        order = np.argsort(every, kind="stable")
        self.seeds, self.owner = every[order], owner[order]

    def found(self, texts: list[str | None], coverage: float) -> Iterator[tuple[int, int, int, int]]:
        """(text, item, matched words, number of tiles) of the pairs at or above the coverage."""
        raws = [spaced(t) for t in texts]
        raw = b"\n".join(raws)
        first = np.cumsum([0, *(len(r) + 1 for r in raws)])
        _, start, end = bounds(raw)
        h = word_hashes(raw, lower=True)
        doc = np.searchsorted(first, start, side="right") - 1
        words = lambda at, n: raw[start[at] : end[at + n - 1]].lower().split()
        for n, (hashes, items) in self.short.items():
            if len(h) < n:
                continue
            run = runs(h, n)
            at = np.searchsorted(hashes, run)
            hit = np.flatnonzero((hashes[np.minimum(at, len(hashes) - 1)] == run) & (doc[: len(run)] == doc[n - 1 :]))
            met = np.column_stack([doc[hit], at[hit]])
            _, which = np.unique(met, axis=0, return_index=True)
            for w in which.tolist():
                d, i = met[w].tolist()
                for k in items[i : np.searchsorted(hashes, hashes[i], "right")].tolist():
                    if words(hit[w], n) == self.raw[k].lower().split():
                        yield d, k, n, 1
        m = len(h) - self.seed + 1
        if m <= 0 or not len(self.seeds):
            return
        window = runs(h, self.seed)
        at = np.searchsorted(self.seeds, window)
        hit = np.flatnonzero((self.seeds[np.minimum(at, len(self.seeds) - 1)] == window) & (doc[:m] == doc[self.seed - 1 :]))
        edges = np.searchsorted(doc, np.arange(len(texts) + 1))
        ends = np.searchsorted(doc[hit], np.arange(len(texts) + 1))
        for d in np.unique(doc[hit]).tolist():
            own = np.unique(window[hit[ends[d] : ends[d + 1]]])
            left, right = np.searchsorted(self.seeds, own, "left"), np.searchsorted(self.seeds, own, "right")
            items = np.unique(np.concatenate([self.owner[a:b] for a, b in zip(left, right, strict=True)]))
            a, b = edges[d], edges[d + 1]
            whole = window[a : max(a, b - self.seed + 1)]
            for k in items.tolist():
                shared = np.isin(self.windows[k], own)
                mark = np.zeros(self.words[k] + 1, dtype=np.int64)
                np.add.at(mark, np.flatnonzero(shared), 1)
                np.add.at(mark, np.flatnonzero(shared) + self.seed, -1)
                if (np.cumsum(mark) > 0).sum() < coverage * self.words[k]:
                    continue  # tiles cover no more than all matches together
                if pairs(self.windows[k], whole) <= PAIRS:
                    got = tiles(maximal(self.windows[k], whole, self.seed), self.words[k], int(b - a), self.seed)
                else:
                    got = tiles_by_length(self.windows[k], whole, self.words[k], int(b - a), self.seed)
                if sum(n for _, _, n in got) >= coverage * self.words[k]:
                    item = self.raw[k].lower().split()
                    got = [(i, j, n) for i, j, n in got if item[i : i + n] == words(a + j, n)]
                matched = sum(n for _, _, n in got)
                if matched >= coverage * self.words[k]:
                    yield d, k, matched, len(got)


def indexes(benchmark: DataFrame, seed: int, block_words: int, item_col: str, item_text_col: str) -> Iterator[Index]:
    """The benchmark's items as one index, or in blocks of about block_words words."""
    items = benchmark.select(F.col(item_col).alias("k"), F.col(item_text_col).alias("t"))
    alone = F.regexp_count(F.coalesce("t", F.lit("")), F.lit("[" + "".join(f"\\x{{{a:X}}}-\\x{{{b:X}}}" for a, b in UNSPACED) + "]"))
    words = F.size(F.split(F.coalesce("t", F.lit("")), "[\\x20\\x09-\\x0D]+")) + 1 + 2 * alone
    total = items.agg(F.coalesce(F.sum(words), F.lit(0))).first()[0]
    blocks = math.ceil(2 * total / block_words) if total > block_words else 1
    for b in range(blocks):
        rows = items.filter(F.pmod(F.xxhash64("k", "t"), F.lit(blocks)) == b).collect()
        yield Index([r["k"] for r in rows], [r["t"] for r in rows], seed)


def contaminated(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED, block_words: int = BLOCK_WORDS, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """A row for each document and item that covers: id_col, item_col, item_words, matched_words, coverage, n_tiles."""
    id_type, item_type = docs.schema[id_col].dataType, benchmark.schema[item_col].dataType
    schema = f"`{id_col}` {id_type.simpleString()}, `{item_col}` {item_type.simpleString()}, item_words long, matched_words long, coverage double, n_tiles long"
    item_arrow = to_arrow_type(item_type)
    narrow = docs.select(F.col(id_col).alias("d"), F.col(text_col).alias("t"))

    def of_block(index: Index) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            ix = shared.value
            for whole in batches:
                for batch in blocks(whole, 1):
                    found = list(ix.found(batch.column(1).to_pylist(), coverage))
                    if found:
                        out = [batch.column(0).take(pa.array([f[0] for f in found])), pa.array([ix.ids[f[1]] for f in found], type=item_arrow)]
                        out += [pa.array([ix.words[f[1]] for f in found], type=pa.int64()), pa.array([f[2] for f in found], type=pa.int64())]
                        out += [pa.array([f[2] / ix.words[f[1]] for f in found], type=pa.float64()), pa.array([f[3] for f in found], type=pa.int64())]
                        yield pa.RecordBatch.from_arrays(out, names=[id_col, item_col, "item_words", "matched_words", "coverage", "n_tiles"])

        return narrow.mapInArrow(run, schema)

    return reduce(DataFrame.unionByName, map(of_block, indexes(benchmark, seed, block_words, item_col, item_text_col)))


def clean(docs: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, seed: int = SEED, block_words: int = BLOCK_WORDS, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of docs that no item contaminates, with docs' own columns. No shuffle: each block of items is one filter."""
    fields = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in docs.columns)

    def without(rest: DataFrame, index: Index) -> DataFrame:
        shared = docs.sparkSession.sparkContext.broadcast(index)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for whole in batches:
                for batch in blocks(whole, whole.schema.names.index(text_col)):
                    ok = np.ones(batch.num_rows, dtype=bool)
                    ok[[f[0] for f in shared.value.found(batch.column(batch.schema.names.index(text_col)).to_pylist(), coverage)]] = False
                    yield batch.filter(pa.array(ok))

        return rest.mapInArrow(run, fields)

    return reduce(without, indexes(benchmark, seed, block_words, item_col, item_text_col), docs)


def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
