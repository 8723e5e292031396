"""A corpus pipeline: quality rules, line dedup, near duplicates, benchmark decontamination, mixing.

Each stage takes (spark, docs, sf_dir) and works on all that its predecessor kept. Between stages the documents are written as
Parquet to the shared folder and read again, so that a lost executor costs a stage at most.

Edge cases: repeated rows, null texts and ids, and empty tables pass as the operators define; a document that loses all its lines
stays, with an empty text; extra columns are carried along.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.llm import decontam, jaccard_join, line_dedup, mixing, quality
from varloom.llm.common import shared_folder, written


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the rules reject go."""
    return quality.keep(docs)


def line_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines that many documents hold stay in one of them; text and n_chars follow."""
    out = line_dedup.dedup_lines(docs, prefix="_ld_").withColumn("text", F.col("_ld_kept_text"))
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*[F.col(f"`{c}`") for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five words, a similarity of 0.8: of each group that links join, the document of the smallest id stays, one without id only where
    there is no other. Rows are documents of their own, whatever ids they share or lack, but repeated rows are one."""
    rows = jaccard_join.grouped(docs, k=5, percent=80, one_id=False)
    first = rows.filter("grp IS NOT NULL").groupBy("grp").agg(F.min(F.struct(F.isnull("d").alias("none"), "d", *jaccard_join.ROW)).alias("x")).select("x.h", "x.h2")
    stays = written(first.unionByName(rows.filter("grp IS NULL").select(*jaccard_join.ROW).distinct()), f"{shared_folder(spark)}/stays")
    kept = docs.select("*", *[c.alias(f"_nd_{n}") for c, n in zip(jaccard_join.row_hashes("doc_id", "text"), jaccard_join.ROW, strict=True)])
    own = [f"_nd_{n}" for n in jaccard_join.ROW]
    kept = kept.join(stays.select(*[F.col(n).alias(f"_nd_{n}") for n in jaccard_join.ROW]), own, "left_semi")
    repeated = rows.join(stays, jaccard_join.ROW, "left_semi").groupBy(*jaccard_join.ROW).count().filter("count > 1")
    return (kept if repeated.isEmpty() else kept.dropDuplicates(own)).drop(*own)


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold half of an item's words or more, in tiles of five words or more, go."""
    return decontam.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy in the mix, by virtual finish time."""
    return mixing.mixed_rows(docs)


STAGES = [
    ("quality rules", quality_rules),
    ("line dedup", line_dedup_stage),
    ("n-gram Jaccard join", near_duplicates),
    ("benchmark decontamination", benchmark_decontamination),
    ("mixing sources to target weights", mixing_stage),
]

#: Tokenisers and string tiling are beyond SQL; tests/llm compares the pipeline with a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = shared_folder(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = written(stage(spark, docs, sf_dir), f"{folder}/stage-{k}")
    return docs
