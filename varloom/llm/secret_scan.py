"""Secret scans: base patterns, and zstandard novelty primed with dictionaries.

Base spans come from three patterns. The method adds spans: a run of key-like characters near a word that announces a secret is a
candidate; its marginal size is what it adds to the compressed surrounding text, with zstandard primed by a dictionary of
identifiers, path parts, word endings and common code. What a dictionary or the surroundings contain costs next to nothing, a random key costs about its
entropy: candidates whose marginal bits per character are high are reported. The other spans of the text are never dropped.

Edge cases: a null or empty text has no spans; whole texts are scanned, however long (the surroundings of a candidate are a
window by definition); positions are code points, ends exclusive; repeated rows are scanned one by one; an empty table gives an
empty result.
"""

from __future__ import annotations

import itertools
import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: The base kinds in order, their patterns, and the least length of the whole match or, for assign, of group 2.
KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII)
ACCESS = re.compile(r"AKIA[A-Z0-9]+")
HEX = re.compile(r"[0-9a-f]{16,}")
LEAST = {"assign": 12, "access": 18}

#: Words that announce a secret.
ANNOUNCE = re.compile(r"(?i:passw|passphrase|secret|token|api[_ -]?key|credential|private[_ -]?key|access[_ -]?key|auth|bearer|client[_ -]?id|BEGIN [A-Z ]*PRIVATE)", re.ASCII)
CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
#: What stands between the runs of one secret: dots or line breaks, and shorter runs between them; the borders of a PEM block.
BETWEEN = re.compile(r"[\x20\t]*+(?:(?:\.|(?:\\[nr]|[\r\n])[\x20\t]*+)[A-Za-z0-9+/_=-]{0,15}+[\x20\t]*+)++")
BORDER = re.compile(r"-----(BEGIN|END)")
#: Characters before and after a candidate that count as its surroundings; least marginal bits a character.
AROUND, MIN_BITS = 200, 4.2
#: Runs made of words alone, as in prose, paths and identifiers, are measured next to PROSE too, so that letters have the cost that they have in
#: prose however short the text is; a long word that the dictionary does not have costs up to 5.2 bits a character there, letters drawn at
#: random 5 to 7 in lower case and more in both.
WORDLIKE = re.compile(r"[/_=+-]*(?:[A-Z]?[a-z]+|[A-Z]+)(?:[/_=+-]+(?:[A-Z]?[a-z]+|[A-Z]+))*[/_=+-]*|(?:[A-Z]?[a-z]{2,}){1,6}")
MIN_WORD_BITS = 5.3
PROSE = (
    "The weather was good, so they walked through the old town and looked for a place where everybody could rest and talk about the journey. "
    "Das Wetter war schön, deshalb gingen sie durch die alte Stadt und suchten einen Platz, an dem sich alle ausruhen und unterhalten konnten. "
    "Il faisait beau, ils ont donc traversé la vieille ville et cherché un endroit où chacun pouvait se reposer et parler du voyage. "
    "Hacía buen tiempo, así que pasearon por la ciudad vieja y buscaron un lugar donde todos pudieran descansar y hablar del viaje. "
)
NEAR = 60


def dictionary() -> bytes:
    """Identifiers and code fragments: what a key-like run may consist of without being secret."""
    heads = "get set is has to from new make build load save read write parse format open close start stop run test check validate update delete create insert select find".split()
    tails = "Password Secret Token ApiKey Credential PrivateKey AccessKey Value Name Id Key Path File User Config Session Request Response Client Server Manager Factory Handler Provider Service Exception".split()
    words = [h + t for h, t in itertools.product(heads, tails)] + [f"{a.lower()}_{b.lower()}" for a, b in itertools.product(tails, tails)]
    code = ["import os", "os.environ[", "getenv(", 'config.get("', "public static final String ", "private String ", "function(", "return ", "https://www.", "http://", ".example.com/", "-----BEGIN ", "-----END ", "0123456789abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "xxxxxxxxxxxxxxxx", "0000000000000000", "----------------", "================", "changeme", "your_api_key_here", "example"]
    paths = ["/usr/local/share/applications/", "/var/lib/", "/home/user/", "/etc/security/", "/opt/", "/node_modules/", "/site-packages/", "/src/main/resources/"]
    endings = "ization isation ational ationally ability fulness istically schaft gesellschaft ungen keiten heiten issement ellement aciones amiento mente idades inter trans counter über zwischen contre entre".split()
    types = ["AbstractSingletonProxyFactoryBean", "ConfigurationContextListener", "ControllerRepositoryInterface", "TemplateBuilderAdapterImplementation", "IllegalStateException", "ApplicationProperties", "AuthenticationFilterChain"]
    return "\n".join([*words, *paths, *endings, *types, *code]).encode()


class Novelty:
    def __init__(self):
        import zstandard

        self.packer = zstandard.ZstdCompressor(level=9, dict_data=zstandard.ZstdCompressionDict(dictionary(), dict_type=zstandard.DICT_TYPE_RAWCONTENT), write_content_size=False, write_checksum=False)

    def bits(self, before: str, run: str, after: str) -> float:
        """Marginal compressed bits a character that run adds to its surroundings."""
        around = (before + after).encode("utf-8", "replace")
        whole = (before + run + after).encode("utf-8", "replace")
        return 8.0 * (len(self.packer.compress(whole)) - len(self.packer.compress(around))) / len(run)


def base_spans(text: str) -> list[tuple[str, int, int]]:
    out = [("assign", *m.span()) for m in ASSIGN.finditer(text) if len(m[2]) >= LEAST["assign"]]
    out += [("access", *m.span()) for m in ACCESS.finditer(text) if len(m[0]) >= LEAST["access"]]
    return out + [("hex", *m.span()) for m in HEX.finditer(text)]


def announced(text: str) -> Iterator[tuple[int, int]]:
    """The key-like runs that an announcing word has within NEAR characters, and those that follow one of these after a dot or a line
    break; for a PEM block all up to its end. Runs are whole. Words and runs are each walked once, in step, so that the time grows with
    the text's length, whatever number of words announce nothing."""
    words = ANNOUNCE.finditer(text)
    first = next(words, None)
    if first is None:
        return
    runs, border, k = [m.span() for m in CANDIDATE.finditer(text)], BORDER.search(text), 0
    for a in itertools.chain([first], words):
        limit = a.end() + NEAR
        if a[0].startswith("BEGIN"):
            while border and border.start() < a.end():
                border = BORDER.search(text, border.end())
            if border and border[1] == "END":
                limit = max(limit, border.start())
        while k < len(runs) and runs[k][1] <= a.start() - NEAR:
            k += 1
        last = None
        while k < len(runs) and (runs[k][0] <= limit or last is not None and BETWEEN.fullmatch(text, last, runs[k][0])):
            yield runs[k]
            last = runs[k][1]
            k += 1
        if k == len(runs):
            return


def novel_spans(text: str, novelty: Novelty, min_bits: float = MIN_BITS) -> list[tuple[str, int, int]]:
    """The announced runs that are incompressible next to their surroundings."""
    found = []
    for a, b in announced(text):
        words = WORDLIKE.fullmatch(text, a, b) is not None
        bits = novelty.bits((PROSE if words else "") + text[max(0, a - AROUND) : a], text[a:b], text[b : b + AROUND])
        if bits >= (max(min_bits, MIN_WORD_BITS) if words else min_bits):
            found.append(("novel", a, b))
    return found


def joined(spans: list[tuple[str, int, int]]) -> str:
    order = {k: i for i, k in enumerate((*KINDS, "novel"))}
    return ",".join(f"{k}:{s}:{e}" for k, s, e in sorted(spans, key=lambda x: (x[1], order[x[0]], x[2])))


COLUMNS = {"n_assign": "long", "n_access": "long", "n_hex": "long", "n_novel": "long", "base_spans": "string", "spans": "string"}


def scan(docs: DataFrame, min_bits: float = MIN_BITS, text_col: str = "text") -> DataFrame:
    """docs with COLUMNS; spans are kind:start:end by start, joined by commas. Columns of docs that have these names are replaced."""
    own = [c for c in docs.columns if c not in COLUMNS]
    fields = [f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in own] + [f"{c} {t}" for c, t in COLUMNS.items()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        novelty = None
        for batch in batches:
            novelty = novelty or Novelty()
            rows, names = [], batch.schema.names
            for t in batch.column(names.index(text_col)):
                text = t.as_py() or ""
                base = base_spans(text)
                added = novel_spans(text, novelty, min_bits)
                rows.append((*(sum(s[0] == k for s in base) for k in KINDS), len(added), joined(base), joined(base + added)))
            arrays = [pa.array([r[k] for r in rows], type=pa.int64() if t == "long" else pa.string()) for k, t in enumerate(COLUMNS.values())]
            yield pa.RecordBatch.from_arrays([*(batch.column(names.index(c)) for c in own), *arrays], names=[*own, *COLUMNS])

    return docs.mapInArrow(run, ", ".join(fields))


def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return scan(docs).select("doc_id", "n_assign", "n_access", "n_hex", F.sha2("base_spans", 256).alias("base_sha256"), "spans", "n_novel")

