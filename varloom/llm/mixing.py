"""Mixing sources to target weights by weighted fair queueing.

Each source's documents are shuffled by a keyed digest. A copy's virtual finish time is the number of the source's words up to
and with it, divided by the source's weight; copies of the second pass follow those of the first. All copies are sorted by
virtual finish time over all sources (a range sort) and taken while the words so far stay within the total budget. Sources that
run out early leave their share to the others in proportion to their weights, which is how the targets are defined too.

No source is gathered in one task: rows are dealt to ranges of (source, digest), as many as there are shuffle partitions and of equal
size, sources large and small alike; running sums go by range, then over the ranges' totals. The global order is made likewise, by
ranges of the finish time. What is taken by a window without ranges has a row for each source or range.

Every row has a number of its own, given as the rows are written, by which its copies find it again: rows of one id, or none, are never
told apart by their contents.

Edge cases: a null source is a source of its own, last in order; a text without words or null has size 0 and is never needed, so
nothing of it is taken; repeated rows are documents of their own; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from varloom.llm.common import shared_folder, written

WEIGHTS, SHARE, PASSES = (5, 2, 1), 1.5, 2
SAME = ["_mx_source", "_mx_null"]


def words_in(text):
    """Number of words: white space is squeezed out and its runs counted, without an array of words."""
    squeezed = F.regexp_replace(F.coalesce(text, F.lit("")), "[^\\x20\\x09-\\x0D]+", "w")
    return F.octet_length(squeezed) - F.octet_length(F.replace(squeezed, F.lit("w"), F.lit("")))


def targets(sizes: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, passes: int = PASSES) -> DataFrame:
    """sizes: a row for each source with _mx_words. Adds its weight by rank and its target: a share of the budget by weight, at
    most passes times its words, the excess shared again by weight until none is above. Ordered by the level at which a source
    is exhausted, source i is capped if the budget reaches that level, which is one running sum."""
    turn = F.row_number().over(W.orderBy("_mx_null", "_mx_source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (turn % len(weights) + 1).cast("int"))
    level = W.orderBy("_mx_level", "_mx_null", "_mx_source")
    all_rows = W.partitionBy()
    capped = F.col("_mx_capped")
    return (
        sizes.withColumn("_mx_weight", weight)
        .withColumns({"_mx_cap": F.col("_mx_words") * float(passes), "_mx_budget": F.sum("_mx_words").over(all_rows) * float(share)})
        .withColumn("_mx_level", F.col("_mx_cap") / F.col("_mx_weight"))
        .withColumns({"_mx_caps": F.sum("_mx_cap").over(level), "_mx_rest": F.sum("_mx_weight").over(all_rows) - F.sum("_mx_weight").over(level)})
        .withColumn("_mx_capped", F.col("_mx_caps") + F.col("_mx_level") * F.col("_mx_rest") <= F.col("_mx_budget"))
        .withColumns({"_mx_used": F.sum(F.when(capped, F.col("_mx_cap")).otherwise(0.0)).over(all_rows), "_mx_free": F.sum(F.when(capped, 0.0).otherwise(F.col("_mx_weight"))).over(all_rows)})
        .withColumn("target", F.when(capped, F.col("_mx_cap")).otherwise((F.col("_mx_budget") - F.col("_mx_used")) * F.col("_mx_weight") / F.col("_mx_free")))
        .select(*SAME, "_mx_words", "_mx_weight", "target", F.col("_mx_budget").alias("_mx_budget"))
    )


def digest(seed: str, doc_id: Column, source: Column, size: Column) -> Column:
    """The place of a document in its source's shuffled order."""
    return F.md5(F.concat_ws("|", F.lit(seed), F.coalesce(doc_id.cast("string"), F.lit("null")), F.coalesce(source.cast("string"), F.lit("")), size.cast("string")))


def parts(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def ranged(df: DataFrame, order: Sequence[str], path: str) -> DataFrame:
    """df in global order, with _mx_range, the number of a row's range. Written, since the ranges are sampled: they hold only as long as
    they are not dealt again."""
    return written(df.repartitionByRange(parts(df.sparkSession), *order).withColumn("_mx_range", F.spark_partition_id()).sortWithinPartitions(*order), path)


def numbered(docs: DataFrame, text_col: str, path: str) -> DataFrame:
    """docs as written to path with _mx_row, a number for each row, and _mx_size, its words."""
    return written(docs.withColumns({"_mx_row": F.monotonically_increasing_id(), "_mx_size": words_in(F.col(f"`{text_col}`")).cast("long")}), path)


def mix(docs: DataFrame, weights: Sequence[int] = WEIGHTS, share: float = SHARE, passes: int = PASSES, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", folder: str | None = None) -> DataFrame:
    """A row for each copy that could be taken, narrow (no text): the id, _mx_row (its row's number), size, source_size, target,
    virtual_finish, copy, taken (boolean: the copy is in the mix) and running_words. docs may be numbered."""
    folder = folder or shared_folder(docs.sparkSession)
    src = F.col(f"`{source_col}`").cast("string")
    own = ["_mx_row", "_mx_size"] if "_mx_row" in docs.columns else [F.monotonically_increasing_id().alias("_mx_row"), words_in(F.col(f"`{text_col}`")).cast("long").alias("_mx_size")]
    rows = docs.select(F.col(f"`{id_col}`").alias("_mx_id"), F.coalesce(src, F.lit("")).alias("_mx_source"), src.isNull().alias("_mx_null"), F.xxhash64(F.col(f"`{text_col}`")).alias("_mx_text"), *own).withColumnRenamed("_mx_size", "size")
    rows = written(rows.withColumn("_mx_key", digest(seed, F.col("_mx_id"), F.col("_mx_source"), F.col("size"))), f"{folder}/rows")
    place = ["_mx_null", "_mx_source", "_mx_key", "_mx_id", "_mx_text", "_mx_row"]  # the text's hash: reruns agree however rows are dealt
    rows = ranged(rows, place, f"{folder}/by-source")
    sums = written(rows.groupBy(*SAME, "_mx_range").agg(F.sum("size").alias("_mx_words")), f"{folder}/range-sums")
    before = F.sum("_mx_words").over(W.partitionBy(*SAME).orderBy("_mx_range")) - F.col("_mx_words")
    plan = written(targets(sums.groupBy(*SAME).agg(F.sum("_mx_words").alias("_mx_words")), weights, share, passes), f"{folder}/targets")
    sums = sums.select(*SAME, "_mx_range", before.alias("_mx_before")).join(plan, SAME)
    inner = W.partitionBy("_mx_range", *SAME).orderBy(*place[2:]).rowsBetween(W.unboundedPreceding, 0)
    done = F.col("_mx_before") + F.col("_mx_sum") + F.col("copy") * F.col("_mx_words")
    copies = (
        rows.withColumn("_mx_sum", F.sum("size").over(inner))
        .join(sums, ["_mx_range", *SAME])
        .withColumn("copy", F.explode(F.sequence(F.lit(0), F.lit(passes - 1))))
        .withColumn("virtual_finish", done.cast("double") / F.col("_mx_weight"))
        .withColumnRenamed("_mx_words", "source_size")
        .drop("_mx_range")
    )
    return truncated(copies, folder)


#: The order over all copies; the rest of the list breaks ties between sources.
ORDER = ["virtual_finish", "_mx_null", "_mx_source", "_mx_key", "_mx_id", "_mx_text", "copy", "_mx_row"]


def truncated(copies: DataFrame, folder: str) -> DataFrame:
    """The copies in global order, with taken: the words up to and with the copy are within the budget."""
    rows = ranged(copies, ORDER, f"{folder}/ranged")
    totals = rows.groupBy("_mx_range").agg(F.sum("size").alias("_mx_total"))
    totals = totals.select("_mx_range", (F.sum("_mx_total").over(W.orderBy("_mx_range")) - F.col("_mx_total")).alias("_mx_ahead"))
    inner = W.partitionBy("_mx_range").orderBy(*ORDER).rowsBetween(W.unboundedPreceding, 0)
    running = F.col("_mx_ahead") + F.sum("size").over(inner)
    # one row for each range: as many as partitions, whatever the input
    return (
        rows.join(F.broadcast(totals), "_mx_range")
        .withColumn("running_words", running)
        .withColumn("taken", (F.col("running_words") <= F.col("_mx_budget")) & (F.col("size") > 0))
        .select("_mx_row", "_mx_id", "_mx_source", "_mx_null", "size", "source_size", "target", "virtual_finish", "copy", "running_words", "taken")
    )


def taken_counts(copies: DataFrame) -> DataFrame:
    """For each document row its number of copies in the mix."""
    same = ["_mx_id", "_mx_source", "_mx_null", "size", "source_size", "target"]
    return copies.groupBy("_mx_row").agg(*[F.first(c).alias(c) for c in same], F.sum(F.col("taken").cast("long")).alias("copies"))


def mixed_rows(docs: DataFrame, seed: str = "mix", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", **parameters) -> DataFrame:
    """The mix itself: a row of docs for each copy taken, with copy, virtual_finish and running_words, range-sorted by virtual finish
    time. Texts are shuffled twice: to their copies, by row number, and to their places in the order."""
    folder = shared_folder(docs.sparkSession)
    own = [f"`{c}`" for c in docs.columns if c not in ("copy", "virtual_finish", "running_words")]
    docs = numbered(docs.select(*own), text_col, f"{folder}/numbered")
    copies = mix(docs, seed=seed, id_col=id_col, text_col=text_col, source_col=source_col, folder=folder, **parameters)
    one = F.struct("copy", "virtual_finish", "running_words")
    taken = copies.filter("taken").groupBy("_mx_row").agg(F.collect_list(one).alias("_mx_c"))  # as many as there are passes
    out = docs.join(taken, "_mx_row").select(*own, F.explode("_mx_c").alias("_mx_c")).select(*own, "_mx_c.*")
    return out.repartitionByRange(parts(docs.sparkSession), "virtual_finish", "running_words").sortWithinPartitions("virtual_finish", "running_words")


def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text", "source")
    done = taken_counts(mix(docs))
    return done.select(F.col("_mx_id").alias("doc_id"), "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"))


SQL = r"""
WITH sized AS (
  SELECT row_number() OVER () AS rid, doc_id, coalesce(source, '') AS s, source IS NULL AS no_s,
    CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents
), keyed AS (
  SELECT *, md5('mix|' || coalesce(CAST(doc_id AS VARCHAR), 'null') || '|' || s || '|' || CAST(size AS VARCHAR)) AS k FROM sized
), per_source AS (
  SELECT s, no_s, CAST(sum(size) AS BIGINT) AS words,
    CAST([5, 2, 1][((row_number() OVER (ORDER BY no_s, encode(s)) - 1) % 3) + 1] AS DOUBLE) AS weight
  FROM keyed GROUP BY s, no_s
), levels AS (
  SELECT *, 2.0 * words AS cap, CAST(1.5 AS DOUBLE) * sum(words) OVER () AS budget, CAST(2.0 * words AS DOUBLE) / weight AS lvl FROM per_source
), summed AS (
  SELECT *, sum(cap) OVER (ORDER BY lvl, no_s, encode(s)) AS caps,
    sum(weight) OVER () - sum(weight) OVER (ORDER BY lvl, no_s, encode(s)) AS rest
  FROM levels
), capped AS (
  SELECT *, CAST(caps AS DOUBLE) + lvl * rest <= budget AS is_capped FROM summed
), targets AS (
  SELECT *, CASE WHEN is_capped THEN CAST(cap AS DOUBLE) ELSE
    (budget - CAST(sum(CASE WHEN is_capped THEN cap ELSE 0 END) OVER () AS DOUBLE)) * weight / sum(CASE WHEN is_capped THEN 0.0::DOUBLE ELSE weight END) OVER () END AS target
  FROM capped
), ordered AS (
  SELECT *, sum(size) OVER (PARTITION BY s, no_s ORDER BY k, doc_id, rid ROWS UNBOUNDED PRECEDING) AS cum FROM keyed
), copies AS (
  SELECT o.*, t.words, t.target, t.budget, c.copy, CAST(o.cum + c.copy * t.words AS DOUBLE) / t.weight AS finish
  FROM ordered o JOIN targets t ON o.s = t.s AND o.no_s = t.no_s, (VALUES (0), (1)) c(copy)
), ranked AS (
  SELECT *, sum(size) OVER (ORDER BY finish, no_s, encode(s), k, doc_id, copy, rid ROWS UNBOUNDED PRECEDING) AS running FROM copies
)
SELECT any_value(doc_id) AS doc_id, any_value(size) AS size, any_value(words) AS source_size, any_value(target) AS target,
  CAST(sum(CASE WHEN running <= budget THEN size ELSE 0 END) AS BIGINT) AS taken
FROM ranked GROUP BY rid
"""
