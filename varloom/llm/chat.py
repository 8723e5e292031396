"""Chat formatting from an event log.

Events have a conversation, a sequence number, a message, a kind, a role and a payload. A conversation's events are partitioned
by conversation and sorted by sequence. Per message, 'message' and 'edit' set the text, 'delta' adds to it, and 'regenerate'
sets it and discards the later messages that were begun before it. The final messages are rendered to one text with the spans
of the assistant's texts as loss mask, and read_back() takes a rendered text apart again.

Control strings all begin with < or [; both are escaped inside roles and texts with a backslash, itself escaped, so that no
control string of the template can occur in a text and unescaping restores every text.

A table of finished rows becomes such a log by events_of(): a user's or system's message is begun empty and edited to its text; an
assistant's is begun empty and streamed as deltas, a line each, and its first line is first streamed in a draft that a regeneration sets
aside. So the query folds every kind of event.

Edge cases: a null text or payload is empty; a null role is an empty role; rows with the same conversation and turn are kept,
in the order of turn, role, text, a null turn last, a null role and text as empty ones; a null conv_id is one conversation; an empty
table gives no conversation.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: The template: OPEN role MID text CLOSE for each turn.
OPEN, MID, CLOSE = "<s>[INST] ", " [/INST]", "</s>"
#: Escapes: the character and its letter after a backslash.
ESCAPES = (("\\", "\\e"), ("<", "\\l"), ("[", "\\b"))


def escaped(c: Column) -> Column:
    for plain, code in ESCAPES:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescaped(c: Column) -> Column:
    for plain, code in reversed(ESCAPES):
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def events_of(conversations: DataFrame) -> DataFrame:
    """The log of a table with one finished message a row. Of a message with number m, its place in the conversation, event e has the
    sequence number m * 2**32 + e."""
    role, text = F.coalesce("role", F.lit("")), F.coalesce("text", F.lit(""))
    nth = F.row_number().over(W.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_last(), role, text)).cast("long")
    event = lambda kind, payload: F.struct(F.lit(kind).alias("kind"), payload.alias("payload"))
    pieces = F.split(text, "(?<=\n)", -1)
    first = F.element_at(pieces, 1)
    streamed = F.concat(
        F.array(event("message", F.lit("")), event("delta", first), event("regenerate", F.lit(""))),
        F.transform(pieces, lambda p: event("delta", p)),
    )
    whole = F.array(event("message", F.lit("")), event("edit", text))
    log = F.when(role == "assistant", streamed).otherwise(whole)
    return (
        conversations.select("conv_id", nth.alias("message_id"), role.alias("role"), log.alias("log"))
        .select("conv_id", "message_id", "role", F.posexplode("log").alias("e", "event"))
        .select("conv_id", (F.col("message_id") * F.lit(2**32) + F.col("e")).alias("seq"), "message_id", "event.kind", "role", "event.payload")
    )


def reconstruct(events: DataFrame) -> DataFrame:
    """A row for each conversation: conv_id and turns, the final messages as array<struct<role, text>> in the order in which they
    began. events: conv_id, seq, message_id, kind (message, delta, edit or regenerate), role, payload."""
    log = F.sort_array(F.collect_list(F.struct("seq", F.coalesce("kind", F.lit("message")).alias("kind"), "role", F.coalesce("payload", F.lit("")).alias("payload"))))
    folded = events.groupBy("conv_id", "message_id").agg(log.alias("log"))
    sets = F.filter("log", lambda e: e["kind"] != "delta")
    reset = F.coalesce(F.array_max(F.transform(sets, lambda e: e["seq"])), F.element_at("log", 1)["seq"])
    redone = F.array_max(F.transform(F.filter("log", lambda e: e["kind"] == "regenerate"), lambda e: e["seq"]))
    messages = (
        folded.withColumns({"began": F.element_at("log", 1)["seq"], "reset": reset, "redone": redone})
        .withColumn("live", F.filter("log", lambda e: e["seq"] >= F.col("reset")))
        .withColumns({"text": F.array_join(F.transform("live", lambda e: e["payload"]), ""), "role": F.coalesce(F.element_at("log", 1)["role"], F.lit(""))})
    )
    earlier = W.partitionBy("conv_id").orderBy("began", "message_id").rowsBetween(W.unboundedPreceding, -1)
    return (
        messages.withColumn("cut", F.max("redone").over(earlier))
        .filter(F.col("cut").isNull() | (F.col("began") > F.col("cut")))
        .groupBy("conv_id")
        .agg(F.sort_array(F.collect_list(F.struct("began", "message_id", "role", "text"))).alias("m"))
        .select("conv_id", F.transform("m", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    )


def render(conversations: DataFrame) -> DataFrame:
    """Adds formatted, and loss_spans: array<struct<start, length>> over its code points, the assistant's escaped texts."""
    turn = F.transform("turns", lambda t: F.struct(escaped(t["role"]).alias("r"), escaped(t["text"]).alias("t"), (t["role"] == "assistant").alias("loss")))
    fixed = len(OPEN) + len(MID)
    head = F.lit(len(OPEN) + len(MID) + len(CLOSE))
    size = F.transform("_t", lambda t: (head + F.char_length(t["r"]) + F.char_length(t["t"])).cast("long"))
    nothing = F.struct(F.lit(0).cast("long").alias("at"), F.array().cast("array<long>").alias("starts"))
    starts = F.aggregate("_sizes", nothing, lambda a, s: F.struct((a["at"] + s).alias("at"), F.concat(a["starts"], F.array(a["at"])).alias("starts")), lambda a: a["starts"])
    spans = F.zip_with("_t", "_starts", lambda t, at: F.when(t["loss"], F.struct((at + fixed + F.char_length(t["r"])).alias("start"), F.char_length(t["t"]).cast("long").alias("length"))))
    return (
        conversations.withColumn("_t", turn)
        .withColumn("_sizes", size)
        .withColumn("_starts", starts)
        .withColumns({
            "formatted": F.array_join(F.transform("_t", lambda t: F.concat(F.lit(OPEN), t["r"], F.lit(MID), t["t"], F.lit(CLOSE))), ""),
            "loss_spans": F.filter(spans, lambda s: s.isNotNull()),
        })
        .drop("_t", "_sizes", "_starts")
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """From formatted and loss_spans alone: read_turns and read_loss (the unescaped texts under the mask)."""
    pieces = F.filter(F.split("formatted", "\\Q" + CLOSE + "\\E", -1), lambda p: p != "")
    parts = F.transform(pieces, lambda p: F.split(F.substring(p, len(OPEN) + 1, 2**31 - 1), "\\Q" + MID + "\\E", 2))
    turns = F.transform("_parts", lambda p: F.struct(unescaped(p[0]).alias("role"), unescaped(p[1]).alias("text")))
    loss = F.transform("loss_spans", lambda s: unescaped(F.substring(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return rendered.withColumn("_parts", parts).withColumns({"read_turns": turns, "read_loss": loss}).drop("_parts")


PROBE = "</s>[INST] ok [/INST]"


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    read = read_back(render(reconstruct(events_of(rows.unionByName(probe)))))
    said = F.array_join(F.transform("read_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lost = F.array_join("read_loss", "")
    return read.select(
        "conv_id", F.size("read_turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.char_length(lost).cast("long").alias("loss_chars"), F.sha2(lost, 256).alias("loss_sha256"), F.char_length("formatted").cast("long").alias("formatted_chars")
    )


SQL = r"""
WITH rows_in AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(length('<s>[INST] ' || ' [/INST]' || '</s>')
    + length(replace(replace(replace(role, '\', '\e'), '<', '\l'), '[', '\b'))
    + length(replace(replace(replace(text, '\', '\e'), '<', '\l'), '[', '\b'))) AS BIGINT) AS formatted_chars
FROM rows_in GROUP BY conv_id
"""
