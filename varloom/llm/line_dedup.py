"""Line dedup over levelled sorted runs of line hashes.

A line's key is the line without the white space around it, A-Z lower-cased. Runs are Parquet tables, sorted by the 128-bit
hash of the key, with the number of documents that hold the key and the largest of their ids, its keeper. A batch of documents becomes a
run of its own: its keys are merge-anti-joined with the runs' settled keys, those already known in min_docs documents with a keeper no
smaller than the batch's, and what remains is added as a run of level 0. fanout runs of a level are compacted into one run of the next.
Batches may come in any order, of larger ids too, whenever they arrive; by falling doc_id most of their lines are settled.

Edge cases: a null or empty text is one empty line; rows with one doc_id are one document when documents are counted, and each
is rewritten by itself; each row with a null doc_id is a document of its own, below all others, and lines that only such rows hold stay
in all of them; an empty table gives an empty result.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm.common import NO_ID, SPACE, delete, lower_ascii, shared_folder, written

MIN_CHARS, MIN_DOCS = 20, 3
HASH = ["_ld_h1", "_ld_h2"]


def line_key(line: Column) -> Column:
    return lower_ascii(F.btrim(line, F.lit(SPACE)))


def key_hash(key: Column) -> Column:
    """128 bits of two independently seeded hashes."""
    return F.struct(F.xxhash64(key).alias("_ld_h1"), F.xxhash64(F.lit(0x5EED), key).alias("_ld_h2"))


def lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n", -1)


class LineRuns:
    """The runs, which any number of batches may be added to."""

    def __init__(self, spark: SparkSession, folder: str | None = None, min_docs: int = MIN_DOCS, fanout: int = 4):
        self.spark, self.folder, self.min_docs, self.fanout = spark, folder or shared_folder(spark), min_docs, fanout
        self.levels: list[list[DataFrame]] = [[]]
        self.paths: dict[int, str] = {}
        self.made = 0

    def _run(self, entries: DataFrame) -> DataFrame:
        self.made += 1
        path = f"{self.folder}/run-{self.made:06d}"
        run = written(entries.sortWithinPartitions(*HASH), path)
        self.paths[id(run)] = path
        return run

    def _all(self) -> DataFrame | None:
        runs = [run for level in self.levels for run in level]
        return reduce(DataFrame.unionByName, runs) if runs else None

    @staticmethod
    def _merged(runs: DataFrame) -> DataFrame:
        return runs.groupBy(*HASH).agg(F.sum("_ld_docs").alias("_ld_docs"), F.max("_ld_keeper").alias("_ld_keeper"))

    def add(self, batch: DataFrame) -> None:
        """batch: a row for each key of each document, as _ld_doc (null if it has no id) and the hash."""
        entries = batch.groupBy(*HASH).agg(F.count("*").alias("_ld_docs"), F.max("_ld_doc").alias("_ld_keeper"))
        known = self._all()
        if known is not None:
            settled = self._merged(known).filter(F.col("_ld_docs") >= self.min_docs)
            new, old = entries.alias("new"), settled.hint("merge").alias("old")
            same = reduce(lambda x, y: x & y, [F.col(f"new.{h}") == F.col(f"old.{h}") for h in HASH])
            no_more = F.col("new._ld_keeper").isNull() | (F.col("new._ld_keeper") <= F.col("old._ld_keeper"))
            entries = new.join(old, same & F.coalesce(no_more, F.lit(False)), "left_anti")
        self.levels[0].append(self._run(entries))
        self.compact()

    def compact(self) -> None:
        for k in range(len(self.levels)):
            if len(self.levels[k]) >= self.fanout:
                old = self.levels[k]
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._run(self._merged(reduce(DataFrame.unionByName, old))))
                self.levels[k] = []
                for run in old:
                    delete(self.spark, self.paths.pop(id(run)))

    def repeated(self) -> DataFrame:
        """Keys of at least min_docs documents, with their keeper."""
        known = self._all()
        return self._merged(known).filter(F.col("_ld_docs") >= self.min_docs).select(*HASH, "_ld_keeper")


def dedup_lines(docs: DataFrame, min_chars: int = MIN_CHARS, min_docs: int = MIN_DOCS, batches: int = 4, fanout: int = 4, id_col: str = "doc_id", text_col: str = "text", prefix: str = "") -> DataFrame:
    """docs with kept_text, n_lines and n_dropped (after prefix; columns of docs that have these names are replaced). A key of min_chars code points or more that is in min_docs documents or more
    stays only in the document of the largest id that holds it, there with all its lines."""
    spark = docs.sparkSession
    folder = shared_folder(spark)
    text, doc = F.col(f"`{text_col}`"), F.col(f"`{id_col}`").cast("long")
    # A row without id is told by its text.
    row = F.when(doc.isNull(), F.xxhash64(text)).otherwise(F.lit(0).cast("long"))
    keys = F.transform(lines(text), line_key)
    long_keys = F.filter(keys, lambda k: F.char_length(k) >= min_chars)
    cuts = docs.agg(F.percentile_approx(doc, [i / batches for i in range(1, batches)], 1000).alias("c")).first()["c"] or []
    cuts = sorted(set(cuts), reverse=True)
    staged = (
        docs.select(doc.alias("_ld_doc"), row.alias("_ld_row"), F.explode(F.array_distinct(F.transform(long_keys, key_hash))).alias("_ld_h"))
        .select("_ld_doc", "_ld_row", "_ld_h.*")
        .withColumn("_ld_batch", batch_of(cuts))
    )
    staged = written(staged, f"{folder}/lines")
    several = written(docs.select(doc.alias("_ld_doc")).filter("_ld_doc IS NOT NULL").groupBy("_ld_doc").agg(F.count("*").alias("c")).filter("c > 1").select("_ld_doc"), f"{folder}/ids-of-several-rows")
    held = staged
    if not several.isEmpty():  # only these can hold a key twice
        held = staged.join(several, "_ld_doc", "left_anti").unionByName(staged.join(several, "_ld_doc", "left_semi").dropDuplicates(["_ld_doc", *HASH]).select(*staged.columns))
    runs = LineRuns(spark, f"{folder}/runs", min_docs, fanout)
    for b in range(len(cuts) + 1):
        runs.add(held.filter(F.col("_ld_batch") == b).select("_ld_doc", *HASH))
    # Written, so that both sides of the next join are plain exchanges, whose skewed partitions are split at run time.
    repeated = written(runs.repeated(), f"{folder}/repeated")
    drops = (
        staged.join(repeated.hint("merge"), HASH)
        .filter(F.coalesce(F.col("_ld_doc") < F.col("_ld_keeper"), F.col("_ld_keeper").isNotNull()))
        .groupBy(F.coalesce("_ld_doc", F.lit(NO_ID)).alias("_ld_doc"), "_ld_row")
        .agg(F.collect_set(F.struct(*HASH)).alias("_ld_drops"))
    )
    ls = F.col("_ld_lines")
    # Membership by buckets, about the root of the number of drops: a text of many lines and drops takes their product's root, not the product.
    n = F.greatest(F.lit(1), F.floor(F.sqrt(F.size("_ld_drops"))).cast("int"))
    buckets = F.transform(F.sequence(F.lit(0), F.col("_ld_n") - 1), lambda b: F.filter("_ld_drops", lambda h: F.pmod(h["_ld_h1"], F.col("_ld_n")) == b))
    hashes = F.transform(ls, lambda x: key_hash(line_key(x)))
    gone = lambda h: F.array_contains(F.get("_ld_buckets", F.pmod(h["_ld_h1"], F.col("_ld_n")).cast("int")), h)
    kept = F.filter(ls, lambda x, i: ~gone(F.get("_ld_hashes", i)))
    touched = F.col("_ld_drops").isNotNull()
    return (
        docs.withColumns({"_ld_doc": F.coalesce(doc, F.lit(NO_ID)), "_ld_row": row})
        .join(drops, ["_ld_doc", "_ld_row"], "left")
        .withColumns({"_ld_lines": lines(text), "_ld_n": n})
        .withColumns({"_ld_buckets": F.when(touched, buckets), "_ld_hashes": F.when(touched, hashes)})
        .withColumn("_ld_kept", F.when(touched, kept).otherwise(ls))
        .withColumns({f"{prefix}kept_text": F.array_join("_ld_kept", "\n"), f"{prefix}n_lines": F.size(ls).cast("long"), f"{prefix}n_dropped": (F.size(ls) - F.size("_ld_kept")).cast("long")})
        .drop("_ld_doc", "_ld_row", "_ld_drops", "_ld_lines", "_ld_kept", "_ld_n", "_ld_buckets", "_ld_hashes")
    )


def batch_of(cuts: list[int]) -> Column:
    """0 for the largest ids; one more for each cut that the id does not exceed; a null id exceeds none."""
    return reduce(lambda a, cut: a + F.when(F.col("_ld_doc") > cut, 0).otherwise(1), cuts, F.lit(0))


def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")
    return dedup_lines(docs).select("doc_id", "n_lines", "n_dropped", F.sha2("kept_text", 256).alias("kept_sha256"))


SQL = r"""
WITH split_lines AS (
  SELECT rid, doc_id, generate_subscripts(ls, 1) AS pos, unnest(ls) AS line
  FROM (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents)
), keyed AS (
  SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS k
  FROM split_lines
), repeated AS (
  SELECT k, max(doc_id) AS keeper FROM keyed WHERE length(k) >= 20 GROUP BY k
  HAVING count(DISTINCT doc_id) + count(DISTINCT rid) FILTER (WHERE doc_id IS NULL) >= 3
), marked AS (
  SELECT keyed.*, coalesce(keyed.doc_id < repeated.keeper, repeated.keeper IS NOT NULL) AS gone FROM keyed LEFT JOIN repeated USING (k)
)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY rid
"""
