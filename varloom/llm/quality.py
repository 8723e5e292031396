"""Quality rules: base counts of words, symbols and repeats, and tokeniser fertility.

Two public byte-level vocabularies split every word of each whole text, a space before each: one made for many languages, one mostly
for English. Measured are the characters per token of both, and with the first the share of tokens that are no whole characters (byte
fallback), the entropy of the tokens relative to the most that so many can have, and their min-entropy (minus the logarithm of the
commonest token's share). Each must lie in the band of the row's language, or of the text's script where the language has none. Prose
lies well inside; symbols stuck to words need more tokens a character, rows of a table and repeated text have one token or a few far
too often.

The bands hold at every length. What a few tokens measure scatters: a band is wider by DEVIATIONS standard deviations of its measure
over as many tokens as the text has, which fades with the root of their number.

Edge cases: a null text has no words and fails; an empty table gives an empty result; a null or unknown language, or none, takes
the script's band; repeated rows are judged one by one; whole texts are measured, however long, in blocks bounded by bytes.
"""

from __future__ import annotations

import base64
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from varloom.llm.wordhash import SPACES, blocks, bounds, runs, word_hashes

#: Where the public vocabularies are, and the two used: files in that folder, the first the one of most measures.
VOCABULARIES, VOCABULARY = "/opt/tokenizers", ("byte_bpe_multi_50k.tiktoken", "byte_bpe_50k.tiktoken")
WINDOW, MIN_WORDS, MAX_REPEAT = 8, 20, 30
SYMBOLS = np.zeros(256, dtype=bool)
SYMBOLS[list(b"#*$%&|<>")] = True
#: Words whose tokens a worker remembers.
REMEMBERED = 200_000

#: Bands: least and most word characters a token of the first vocabulary, most fallback share, least relative entropy, least min-entropy
#: in bits, least word characters a token of the second vocabulary. They are wide: outside lies what no prose of the language shows.
BANDS = {
    "en": (2.00, 8.0, 0.10, 0.30, 3.3, 1.80),
    "de": (2.00, 8.0, 0.15, 0.30, 3.3, 1.60),
    "es": (1.85, 8.0, 0.20, 0.30, 3.3, 1.45),
    "fr": (1.85, 8.0, 0.20, 0.30, 3.3, 1.45),
    "latin": (1.70, 8.0, 0.30, 0.25, 3.0, 1.20),
    "cyrillic": (1.00, 8.0, 0.40, 0.25, 2.4, 0.45),
    "greek": (0.70, 8.0, 0.60, 0.25, 2.4, 0.40),
    "arabic": (0.60, 8.0, 0.60, 0.25, 2.4, 0.40),
    "devanagari": (0.40, 8.0, 0.80, 0.20, 1.8, 0.25),
    "cjk": (0.30, 8.0, 0.80, 0.25, 2.2, 0.20),
    "other": (0.20, 8.0, 0.90, 0.20, 1.5, 0.15),
}
#: How far a band gives way for short texts: in standard deviations, for a token's characters and for shares of tokens.
DEVIATIONS, TOKEN_DEVIATION = 3.0, 0.8

#: The scripts of UTF-8 lead bytes. ASCII letters and U+00C0 to U+024F are Latin; E0 is Devanagari before A4 and A5.
SCRIPTS = ("latin", "cyrillic", "greek", "arabic", "devanagari", "cjk", "other")
LEADS = np.full(256, -1, dtype=np.int8)
LEADS[0xC2:0xF5] = SCRIPTS.index("other")
LEADS[[*range(65, 91), *range(97, 123), *range(0xC3, 0xCA)]] = SCRIPTS.index("latin")
LEADS[0xC2] = -1
LEADS[0xCD:0xD0] = SCRIPTS.index("greek")
LEADS[0xD0:0xD4] = SCRIPTS.index("cyrillic")
LEADS[0xD8:0xDC] = SCRIPTS.index("arabic")
LEADS[0xE3:0xEE] = SCRIPTS.index("cjk")


class Fertility:
    """Vocabularies, and the tokens of the words met so far."""

    def __init__(self, folder: str = VOCABULARIES, vocabulary: tuple[str, ...] = VOCABULARY):
        import tiktoken

        self.encodings, self.partial = [], None
        for name in vocabulary:
            with open(f"{folder}/{name}", "rb") as f:
                ranks = {base64.b64decode(a): int(n) for a, n in map(bytes.split, f)}
            # Letters, digits, other signs, or white space, each with one space before.
            self.encodings.append(tiktoken.Encoding("fertility", pat_str=r" ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+", mergeable_ranks=ranks, special_tokens={}))
            if self.partial is None:
                self.size = max(ranks.values()) + 1
                self.partial = np.zeros(self.size, dtype=bool)
                for piece, n in ranks.items():
                    try:
                        piece.decode()
                    except UnicodeDecodeError:
                        self.partial[n] = True
        #: By a word's hash: the other vocabularies' numbers of tokens, then the first one's tokens, as 32-bit numbers.
        self.at: dict[int, bytes] = {}

    def tokens(self, hashes: np.ndarray, word) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Of distinct words: the first vocabulary's tokens, end to end, each word's number of them, and of the other vocabularies'
        tokens. word: the bytes, by need."""
        if len(self.at) > REMEMBERED:
            self.at.clear()
        at, out = self.at, []
        for k, h in enumerate(hashes.tolist()):
            got = at.get(h)
            if got is None:
                text = " " + word(k).decode("utf-8", "replace")
                got = at[h] = array("I", [*(len(e.encode_ordinary(text)) for e in self.encodings[1:]), *self.encodings[0].encode_ordinary(text)]).tobytes()
            out.append(got)
        others = len(self.encodings) - 1
        sizes = np.fromiter(map(len, out), dtype=np.int64, count=len(out)) // 4
        flat, start = np.frombuffer(b"".join(out), dtype=np.uint32).astype(np.int64), np.cumsum(sizes) - sizes
        first = np.ones(len(flat), dtype=bool)
        for k in range(others):
            first[start + k] = False
        return flat[first], sizes - others, [flat[start + k] for k in range(others)]


def dup_lines(text: str) -> int:
    """Lines with a word that equal an earlier line."""
    lines = text.split("\n")
    if len(lines) == 1:
        return 0
    lines = [x for x in lines if x.strip(" \t\n\x0b\x0c\r")]
    return len(lines) - len(set(lines))


def scripts(b: np.ndarray, first: np.ndarray) -> list[str]:
    """The script of most letters of each text; latin without any. b: the bytes; first: each text's first byte."""
    of, count = LEADS[b], []
    for k, name in enumerate(SCRIPTS):
        here = of == k
        if name == "devanagari":
            here = np.zeros(len(b), dtype=bool)
            here[:-1] = (b[:-1] == 0xE0) & ((b[1:] == 0xA4) | (b[1:] == 0xA5))
        count.append(np.add.reduceat(here, first, dtype=np.int64))
    count[-1] -= count[SCRIPTS.index("devanagari")]
    return [SCRIPTS[k] for k in np.argmax(np.array(count), axis=0)]


COLUMNS = {"n_words": "long", "word_chars": "long", "n_symbols": "long", "n_dup_lines": "long", "n_repeat_words": "long", "base_failed": "boolean", "kept": "boolean", "n_tokens": "long", "chars_per_token": "double", "fallback_share": "double", "relative_entropy": "double", "min_entropy": "double", "chars_per_token_2": "double"}


def repeated_words(h: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    """Of each text the words that stand in a window found twice or more in it. Windows are told apart by the text."""
    m = len(h) - WINDOW + 1
    if m <= 1:
        return np.zeros(n, dtype=np.int64)
    inside = np.flatnonzero(doc[:m] == doc[WINDOW - 1 :])
    key = (runs(h, WINDOW) + doc[:m].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[inside]
    order = np.argsort(key)
    same = key[order][1:] == key[order][:-1]
    twice = inside[order[np.concatenate([[False], same]) | np.concatenate([same, [False]])]] if len(key) else inside
    if not len(twice):
        return np.zeros(n, dtype=np.int64)
    mark = np.bincount(twice, minlength=len(h) + 1) - np.bincount(twice + WINDOW, minlength=len(h) + 1)
    return np.bincount(doc[np.cumsum(mark)[:-1] > 0], minlength=n)


def fertility_of(h: np.ndarray, doc: np.ndarray, n: int, word, fertility: Fertility) -> tuple[np.ndarray, ...]:
    """Of each text: tokens, share of partial ones, entropy and min-entropy in bits, and tokens of the second vocabulary. Each text's
    distinct words are counted first, so that a word's tokens are looked at once for each text. word: the bytes of a word by its place."""
    tokens, partial, entropy, least, second = (np.zeros(n) for _ in range(5))
    if not len(h):
        return tokens, partial, entropy, least, second
    distinct, where, which = np.unique(h, return_index=True, return_inverse=True)
    flat, sizes, others = fertility.tokens(distinct, lambda k: word(where[k]))
    pair, times = np.unique(doc * len(distinct) + which, return_counts=True)
    owner, which = pair // len(distinct), pair % len(distinct)
    if others:
        second = np.bincount(owner, others[0][which] * times, n)
    begin, each = np.cumsum(sizes) - sizes, sizes[which]
    at = np.repeat(begin[which] - (np.cumsum(each) - each), each) + np.arange(int(each.sum()))
    token, owner, times = flat[at], np.repeat(owner, each), np.repeat(times, each)
    tokens, partial = np.bincount(owner, times, n), np.bincount(owner, times * fertility.partial[token], n)
    pair, place = np.unique(owner * fertility.size + token, return_inverse=True)
    count, owner = np.bincount(place, times), pair // fertility.size
    share = count / tokens[owner]
    entropy = np.bincount(owner, -share * np.log2(share), n)
    most = np.zeros(n)
    np.maximum.at(most, owner, share)
    least = np.where(most > 0, -np.log2(np.maximum(most, 1e-12)), 0)
    return tokens, partial / np.maximum(tokens, 1), entropy, least, second


def inside_bands(bands: np.ndarray, tokens: np.ndarray, per: np.ndarray, fallback: np.ndarray, entropy: np.ndarray, least: np.ndarray, per_2: np.ndarray) -> np.ndarray:
    """Whether each text's measures lie in its band, which is wider the fewer tokens there are."""
    low, high, most_fallback, low_entropy, low_min, low_2 = bands.T
    off = DEVIATIONS / np.sqrt(np.maximum(tokens, 1))
    widest = lambda share: share + off * np.sqrt(share * (1 - share))
    most_share = widest(2.0**-low_min)
    return (
        (per >= low - TOKEN_DEVIATION * off) & (per <= high + 4 * TOKEN_DEVIATION * off) & (fallback <= widest(most_fallback)) & (entropy >= low_entropy - 0.5 * off)
        & (2.0**-least <= most_share) & (per_2 >= low_2 - TOKEN_DEVIATION * off)
    )


def measured(texts: list[str | None], langs: list[str | None], fertility: Fertility, bands=BANDS) -> dict[str, np.ndarray]:
    """COLUMNS of a block of texts, all worked on together: the texts stand one after the other, a line break after each."""
    texts, n = [t or "" for t in texts], len(texts)
    raws = [t.encode("utf-8", "replace") + b"\n" for t in texts]
    first = np.cumsum([0, *(len(r) for r in raws)])  # each text's first byte; then the end
    raw = b"".join(raws)
    raws.clear()
    b, start, end = bounds(raw)
    doc = np.searchsorted(first, start, side="right") - 1
    words = np.bincount(doc, minlength=n)
    chars = np.add.reduceat(((b & 0xC0) != 0x80) & ~SPACES[b], first[:-1], dtype=np.int64)
    symbols = np.add.reduceat(SYMBOLS[b], first[:-1], dtype=np.int64)
    h = word_hashes(raw)
    repeat = repeated_words(h, doc, n)
    tokens, fallback, entropy, least, second = fertility_of(h, doc, n, lambda k: raw[start[k] : end[k]], fertility)
    some = np.maximum(tokens, 1)
    per, per_2, entropy = chars / some, chars / np.maximum(second, 1), entropy / np.maximum(1, np.log2(some))
    own = np.array([bands.get(x or "") or bands[s] for x, s in zip(langs, scripts(b, first[:-1]), strict=True)])
    failed = (words < MIN_WORDS) | (100 * repeat > MAX_REPEAT * words)
    dup = np.array([dup_lines(t) for t in texts], dtype=np.int64)
    kept = ~failed & inside_bands(own, tokens, per, fallback, entropy, least, per_2)
    return dict(zip(COLUMNS, (words, chars, symbols, dup, repeat, failed, kept, tokens.astype(np.int64), per, fallback, entropy, least, per_2), strict=True))


def rules(docs: DataFrame, folder: str = VOCABULARIES, vocabulary: tuple[str, ...] = VOCABULARY, bands=BANDS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """docs with the measures and kept. Columns of docs that have these names are replaced."""
    own = [c for c in docs.columns if c not in COLUMNS]
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own] + [f"{c} {t}" for c, t in COLUMNS.items()]
    types = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fertility = None
        for whole in batches:
            fertility = fertility or Fertility(folder, vocabulary)
            names = whole.schema.names
            for batch in blocks(whole, names.index(text_col)):
                texts = batch.column(names.index(text_col)).to_pylist()
                langs = batch.column(names.index(lang_col)).to_pylist() if lang_col in names else [None] * len(texts)
                made = measured(texts, langs, fertility, bands)
                arrays = [pa.array(made[c], type=types[t]) for c, t in COLUMNS.items()]
                yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in own), *arrays], names=[*own, *COLUMNS])

    return docs.mapInArrow(run, ", ".join(fields))


def keep(docs: DataFrame, folder: str = VOCABULARIES, vocabulary: tuple[str, ...] = VOCABULARY, bands=BANDS, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """The rows of docs that the rules keep, with docs' own columns only."""
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in docs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fertility = None
        for whole in batches:
            fertility = fertility or Fertility(folder, vocabulary)
            names = whole.schema.names
            for batch in blocks(whole, names.index(text_col)):
                texts = batch.column(names.index(text_col)).to_pylist()
                langs = batch.column(names.index(lang_col)).to_pylist() if lang_col in names else [None] * len(texts)
                yield batch.filter(pa.array(measured(texts, langs, fertility, bands)["kept"], type=pa.bool_()))

    return docs.mapInArrow(run, ", ".join(fields))


def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "lang")
    return rules(docs).drop("text", "lang")
