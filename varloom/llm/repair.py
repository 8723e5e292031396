"""Conversation structure repair: the cheapest edits that make a conversation's roles alternate, by a bidirectional tight-arc graph.

A conversation's rows, in order, are the layers of a graph; its nodes are a layer and what has been said last (nothing, system, user,
assistant). Arcs are edits: Keep, Rerole and Delete lead to the next layer, Insert stays in its layer. Forward minimum costs (from the
start) and backward ones (to an accepted end) show which arcs are tight, that is on some cheapest path. A traversal then carries the set
of nodes that the letters so far may have led to, and at each step takes the least letter (D, I, K, R) of a tight arc out of the set.

A conversation may be of any size, so none is gathered for this. Rows are reduced to their kind and the digest of role and text, equal rows
to one with a count; they are range-sorted over the whole table and cut into segments. A segment's edits are a 4 x 4 matrix in the
(min, +) algebra; a scan over a conversation's matrices, one for CHUNK rows, gives every segment the forward costs at its begin and the backward
ones at its end. Each is then traversed from every tight node at its begin, and a second scan over (begin, end) picks the path. Texts are not
moved until the rows that stay fetch theirs by digest.

Order of rows: turn, nulls first; role; the digest of role and text. Edge cases: a null role or text is one space; a null conv_id is a
conversation; an empty role, or one whose initial is not s, u or a, can be reroled or deleted, not kept; repeated rows are duplicates; an
empty table gives none. Only the four named columns are read, so others may have any name.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from varloom.llm.common import SPACE, shared_folder, written

REROLE, DELETE, INSERT, CUT = 2, 3, 2, 1
#: What has been said last. An end is accepted after nothing and after the assistant.
NOTHING, SYSTEM, USER, ASSISTANT = range(4)
LETTERS = "DIKR"
INFINITE = 1 << 40
#: Rows of a segment, at most; a segment also ends with its Arrow batch.
CHUNK = 4096
#: From each node, the one that an utterance of this role leads to, or -1.
_SAID = {SYSTEM: [SYSTEM, -1, -1, -1], USER: [USER, USER, -1, USER], ASSISTANT: [-1, -1, ASSISTANT, -1]}
_OTHER = [USER, USER, ASSISTANT, USER]


def _times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The (min, +) product of the last two axes."""
    return np.minimum((a[..., :, :, None] + b[..., None, :, :]).min(axis=-2), INFINITE)


def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """By letter, code and node: target (or -1) and cost; and the closure of inserts. A code is initial + 4 * truncated + 8 * doomed; the
    initial is NOTHING where the row cannot be kept."""
    target, cost = np.full((4, 16, 4), -1), np.full((4, 16, 4), INFINITE)
    for code in range(16):
        initial, cut, doomed = code % 4, code // 4 % 2, code // 8
        arcs = {"D": (list(range(4)), DELETE), "I": (_OTHER, INSERT)}
        if not doomed:
            arcs["R"] = (_OTHER, REROLE + CUT * cut)
            if initial:
                arcs["K"] = (_SAID[initial], CUT * cut)
        for letter, (to, price) in arcs.items():
            k = LETTERS.index(letter)
            target[k, code] = to
            cost[k, code] = np.where(np.array(to) < 0, INFINITE, price)
    inserts = np.full((4, 4), INFINITE)
    inserts[range(4), range(4)] = 0
    step = inserts.copy()
    step[range(4), _OTHER] = INSERT
    return target, cost, _times(step, step)


TARGET, COST, INSERTS = _tables()
ROWS = np.full((16, 4, 4), INFINITE)
for _k in (0, 2, 3):
    for _code in range(16):
        for _s in range(4):
            if TARGET[_k, _code, _s] >= 0:
                ROWS[_code, _s, TARGET[_k, _code, _s]] = min(ROWS[_code, _s, TARGET[_k, _code, _s]], COST[_k, _code, _s])
#: A row's edits with the inserts after it, and with those before it.
AHEAD, BACK = _times(ROWS, INSERTS), _times(INSERTS, ROWS)
START = INSERTS[NOTHING]
END = INSERTS[:, [NOTHING, ASSISTANT]].min(axis=1)


def _products(code: np.ndarray, extra: np.ndarray, begin: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Each segment's matrix, for all segments side by side."""
    out = np.full((len(begin), 4, 4), INFINITE)
    out[:, range(4), range(4)] = 0
    for t in range(int(size.max(initial=0))):
        on = np.flatnonzero(size > t)
        row = begin[on] + t
        out[on] = np.minimum(_times(out[on], AHEAD[code[row]]) + extra[row, None, None], INFINITE)
    return out


def _costs(code, extra, begin, size, forward, backward) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Where each segment's layers begin, and the forward and backward costs of all of them."""
    at = begin + np.arange(len(begin))
    f, b = np.full((len(code) + len(begin), 4), INFINITE), np.full((len(code) + len(begin), 4), INFINITE)
    f[at], b[at + size] = forward, backward
    for t in range(int(size.max(initial=0))):
        on = np.flatnonzero(size > t)
        row, layer = begin[on] + t, at[on] + t
        f[layer + 1] = np.minimum((f[layer][:, :, None] + AHEAD[code[row]]).min(axis=1) + extra[row, None], INFINITE)
        row, layer = begin[on] + size[on] - 1 - t, at[on] + size[on] - 1 - t
        b[layer] = np.minimum((BACK[code[row]] + b[layer + 1][:, None, :]).min(axis=2) + extra[row, None], INFINITE)
    return at, f, b


def _traversed(code, extra, begin, size, forward, backward, last):
    """From every tight node at a segment's begin: segment, node at its begin and at its end (-1 in a conversation's last segment), and
    the steps as arrays: which traversal, letter, row (-1: none), node reached."""
    at, f, b = _costs(code, extra, begin, size, forward, backward)
    best = (forward + b[at]).min(axis=1)
    seg, enter = np.nonzero(forward + b[at] == best[:, None])
    layer, sets = np.zeros(len(seg), dtype=np.int64), np.zeros((len(seg), 4), dtype=bool)
    sets[range(len(seg)), enter] = True
    leave, steps = np.full(len(seg), -1), []
    on = np.arange(len(seg))
    while True:
        ended = layer[on] == size[seg[on]]
        node = at[seg[on]] + layer[on]
        #: At a conversation's end: nothing more where that is accepted. At another segment's end: the next one goes on.
        through = ended & (~last[seg[on]] | (sets[on] & (f[node] == best[seg[on], None]) & np.isin(range(4), [NOTHING, ASSISTANT])).any(axis=1))
        leave[on[through & ~last[seg[on]]]] = sets[on[through & ~last[seg[on]]]].argmax(axis=1)
        on, ended, node = on[~through], ended[~through], node[~through]
        if not len(on):
            break
        row = np.where(ended, 0, np.minimum(begin[seg[on]] + layer[on], max(len(code) - 1, 0)))
        reached, letter = np.zeros((len(on), 4), dtype=bool), np.full(len(on), -1)
        for k, name in enumerate(LETTERS):
            free = np.flatnonzero((letter < 0) & (~ended if name != "I" else True))
            if not len(free):
                continue
            c = code[row[free]] if name != "I" else np.zeros(len(free), dtype=np.int64)
            to, more = TARGET[k, c], extra[row[free]] if name != "I" else 0
            after = b[node[free] + (name != "I")]
            whole = f[node[free]] + COST[k, c] + np.broadcast_to(more, len(free))[:, None] + np.take_along_axis(after, np.maximum(to, 0), 1)
            tight = sets[on[free]] & (to >= 0) & (whole == best[seg[on[free]], None])
            found = np.flatnonzero(tight.any(axis=1))
            letter[free[found]] = k
            for s in range(4):
                hit = found[tight[found, s]]
                reached[free[hit], to[hit, s]] = True
        sets[on] = reached
        moved = letter != LETTERS.index("I")
        steps.append(np.stack([on, letter, np.where(moved, row, -1), reached.argmax(axis=1)]))
        layer[on] += moved
    walk = np.concatenate(steps, axis=1) if steps else np.empty((4, 0), dtype=np.int64)
    return seg, enter, leave, walk[:, np.argsort(walk[0], kind="stable")]


def faults(rows: DataFrame) -> DataFrame:
    """One row for equal ones: conv_id, turn, role, digest, copies, and code with `later`: role and text stood in an earlier turn."""
    here = filled(rows)
    bare = F.btrim("text", F.lit(SPACE))
    cut = (bare != "") & ~F.right(bare, F.lit(1)).isin(".", "!", "?")
    kinds = here.select("conv_id", "turn", "role", digest().alias("digest"), (bare == "").alias("blank"), cut.alias("cut"))
    one = kinds.groupBy("conv_id", "turn", "role", "digest", "blank", "cut").agg(F.count("*").alias("copies"))
    when = F.struct(F.isnotnull("turn").alias("has"), "turn")
    first = one.groupBy(F.col("conv_id").alias("c"), F.col("digest").alias("d")).agg(F.min(when).alias("first"), F.count("*").alias("places")).filter("places > 1")
    return (
        one.join(first, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
        .withColumn("later", F.coalesce(~when.eqNullSafe(F.col("first")) & F.isnotnull("places"), F.lit(False)))
        .select("conv_id", "turn", "role", "digest", "blank", "cut", "later", "copies")
    )


def filled(rows: DataFrame) -> DataFrame:
    return rows.select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.coalesce("text", F.lit(" ")).alias("text"))


def digest() -> Column:
    """Of role and text; the role's length keeps them apart."""
    return F.unhex(F.sha2(F.concat(F.char_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256))


def _segments(chunk: int):
    def of(batches):
        for b in batches:
            n = b.num_rows
            if not n:
                continue
            conv, turn, roles = b.column(0), b.column(1), b.column(2)
            same = np.array([x == y for x, y in zip(conv[1:].to_pylist(), conv[:-1].to_pylist(), strict=True)], dtype=bool)
            run = np.concatenate([[0], np.flatnonzero(~same) + 1, [n]])
            begin = np.concatenate([np.arange(x, y, chunk) for x, y in zip(run[:-1], run[1:], strict=True)])
            end = np.concatenate([begin[1:], [n]])
            blank, cut, later = (b.column(k).to_numpy(zero_copy_only=False).astype(bool) for k in (4, 5, 6))
            copies = b.column(7).to_numpy().astype(np.int64)
            letter = np.array([r[:1] for r in roles.to_pylist()])
            initial = np.select([letter == "s", letter == "u", letter == "a"], [SYSTEM, USER, ASSISTANT], NOTHING)
            code = initial + 4 * (cut & ~blank & ~later) + 8 * (blank | later)
            per = lambda x: np.add.reduceat(x.astype(np.int64), begin).tolist()
            legal = np.concatenate([[True], ((letter[:-1] == "s") | (letter[:-1] == "a")) & (letter[1:] == "u") | (letter[:-1] == "u") & (letter[1:] == "a")])
            legal[begin] = True  # across segments, the scan looks
            turns, has = turn.fill_null(0).to_numpy().astype(np.int64), ~np.array(turn.is_null())
            fresh = has & np.concatenate([[True], (turns[1:] != turns[:-1]) | ~has[:-1]])
            fresh[begin] = has[begin]
            matrix = _products(code, DELETE * (copies - 1), begin, end - begin)
            lists = lambda x: pa.ListArray.from_arrays(pa.array(np.append(begin, n), type=pa.int32()), x)
            known = [s + int(has[s:e].argmax()) for s, e in zip(begin, end, strict=True)]  # nulls come first
            low = [int(turns[k]) if has[k] else None for k in known]
            high = [int(turns[e - 1]) if has[e - 1] else None for e in end]
            yield pa.RecordBatch.from_arrays(
                [
                    conv.take(pa.array(begin)), pa.array(per(copies * blank)), pa.array(per(~blank * (copies - ~later))), pa.array(per(cut & ~blank & ~later)), pa.array(per(~legal + (copies - 1))),
                    pa.array(letter[begin].tolist(), pa.string()), pa.array(letter[end - 1].tolist(), pa.string()), pa.array(low, pa.int64()), pa.array(high, pa.int64()), pa.array(per(fresh)),
                    pa.array(matrix.reshape(len(begin), 16).tolist(), pa.list_(pa.int64())), lists(pa.array(code.astype(np.int32))), lists(pa.array(copies)), lists(roles), lists(b.column(3)),
                ],
                names=["conv_id", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns", "matrix", "code", "copies", "role", "digest"],
            )

    return of


def _scanned(batches):
    """A conversation's segments, in order, to its counts, its cost, and each segment's costs at begin and end."""
    for b in batches:
        out = []
        for conv, parts in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
            forward, backward = [START], [END]
            for p in parts[:-1]:
                forward.append(np.minimum((forward[-1][:, None] + np.array(p["matrix"]).reshape(4, 4)).min(axis=0), INFINITE))
            for p in parts[:0:-1]:
                # The matrix has the inserts after each row; those before the first are added here.
                backward.append(np.minimum(_times(INSERTS, np.array(p["matrix"]).reshape(4, 4) + backward[-1][None]).min(axis=1), INFINITE))
            backward.reverse()
            known = [p for p in parts if p["low"] is not None]
            turns = sum(p["turns"] for p in known) - sum(x["high"] == y["low"] for x, y in zip(known[:-1], known[1:], strict=True))
            legal = sum(x["last"] + y["first"] in ("su", "ua", "au") for x, y in zip(parts[:-1], parts[1:], strict=True))
            best = np.minimum((forward[-1][:, None] + np.array(parts[-1]["matrix"]).reshape(4, 4)).min(axis=0), INFINITE) + END
            out.append({
                "conv_id": conv, "gaps": known[-1]["high"] - known[0]["low"] + 1 - turns if known else 0,
                **{k: sum(p[k] for p in parts) for k in ("blank", "duplicate", "truncated")}, "illegal": sum(p["illegal"] for p in parts) + len(parts) - 1 - legal,
                "cost": int(best.min()), "segs": [{"seg": p["seg"], "forward": f.tolist(), "backward": g.tolist(), "end": k == len(parts) - 1} for k, (p, f, g) in enumerate(zip(parts, forward, backward, strict=True))],
            })
        schema = pa.schema([("conv_id", b.schema.field(0).type), *[(k, pa.int64()) for k in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")], ("segs", pa.list_(pa.struct([("seg", pa.int64()), ("forward", pa.list_(pa.int64())), ("backward", pa.list_(pa.int64())), ("end", pa.bool_())])))])
        yield pa.RecordBatch.from_pylist(out, schema=schema)


def _walked(batches):
    """Segments with their costs at both ends to their traversals: letters, and the rows that stay or are inserted."""
    for b in batches:
        if not b.num_rows:
            continue
        column = lambda k: b.column(b.schema.get_field_index(k))
        size = np.array([len(x) for x in column("code").to_pylist()])
        begin = np.concatenate([[0], np.cumsum(size)[:-1]])
        code, copies = (column(k).flatten().to_numpy().astype(np.int64) for k in ("code", "copies"))
        role, dig = column("role").flatten(), column("digest").flatten()
        ends = lambda k: np.array(column(k).to_pylist(), dtype=np.int64).reshape(-1, 4)
        seg, enter, leave, walk = _traversed(code, DELETE * (copies - 1), begin, size, ends("forward"), ends("backward"), column("end").to_numpy(zero_copy_only=False).astype(bool))
        cut = np.searchsorted(walk[0], np.arange(len(seg) + 1))
        letters = [LETTERS[k] + "D" * int(copies[r] - 1 if r >= 0 else 0) for k, r in zip(walk[1], walk[2], strict=True)]
        audit = ["".join(letters[x:y]) for x, y in zip(cut[:-1], cut[1:], strict=True)]
        stays = walk[:, walk[1] != 0]
        where = pa.array([r if r >= 0 else None for r in stays[2].tolist()], type=pa.int64())
        kept = role.take(where).to_pylist() if len(role) else []
        named = [kept[k] if s[1] == 2 else "user" if s[3] == USER else "assistant" for k, s in enumerate(stays.T.tolist())]
        items = pa.StructArray.from_arrays([pa.array([LETTERS[k] for k in stays[1]], pa.string()), pa.array(named, pa.string()), dig.take(where)], names=["edit", "role", "digest"])
        offsets = np.searchsorted(stays[0], np.arange(len(seg) + 1))
        yield pa.RecordBatch.from_arrays(
            [b.column(0).take(pa.array(seg)), column("seg").take(pa.array(seg)), pa.array(enter), pa.array(leave), pa.array(audit, pa.string()), pa.ListArray.from_arrays(pa.array(offsets, type=pa.int32()), items)],
            names=["conv_id", "seg", "enter", "leave", "audit", "items"],
        )


def _chosen(batches):
    """Of a conversation's traversals, by segment, those that begin where the one before ends."""
    for b in batches:
        seg, enter = [], []
        for steps in b.column(0).to_pylist():
            node = NOTHING
            by = {}
            for s in steps:
                by.setdefault(s["seg"], {})[s["enter"]] = s["leave"]
            for k in sorted(by):
                seg.append(k)
                enter.append(node)
                node = by[k][node]
        yield pa.RecordBatch.from_arrays([pa.array(seg, pa.int64()), pa.array(enter, pa.int64())], names=["seg", "enter"])


def repair(rows: DataFrame, chunk: int = CHUNK) -> tuple[DataFrame, DataFrame]:
    """rows: conv_id, turn, role, text. Two tables: for each conversation gaps, blank, duplicate, truncated, illegal, cost and audit; and the
    repaired rows: conv_id, seg and pos (their order), edit (K, R or I), role, text."""
    folder, kind = shared_folder(rows.sparkSession), rows.schema["conv_id"].dataType
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "digest"]
    longs = lambda *names: [T.StructField(n, T.LongType()) for n in names]
    conv, many = T.StructField("conv_id", kind), lambda name, of: T.StructField(name, T.ArrayType(of))
    text = lambda name: T.StructField(name, T.StringType())
    segment = T.StructType([conv, *longs("blank", "duplicate", "truncated", "illegal"), text("first"), text("last"), *longs("low", "high", "turns"), many("matrix", T.LongType()), many("code", T.IntegerType()), many("copies", T.LongType()), many("role", T.StringType()), many("digest", T.BinaryType())])
    entries = faults(rows).withColumn("turn", F.col("turn").cast("long")).repartitionByRange(*order).sortWithinPartitions(*order)
    segments = written(entries.mapInArrow(_segments(chunk), segment).withColumn("seg", F.monotonically_increasing_id()), f"{folder}/segments")

    bound = T.StructType(longs("seg")).add(many("forward", T.LongType())).add(many("backward", T.LongType())).add("end", "boolean")
    summary = segments.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("seg", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns", "matrix"))).alias("parts"))
    counts = written(summary.mapInArrow(_scanned, T.StructType([conv, *longs("gaps", "blank", "duplicate", "truncated", "illegal", "cost"), many("segs", bound)])), f"{folder}/counts")
    bounds = counts.select(F.explode("segs").alias("s")).select("s.*")

    item = T.StructType().add("edit", "string").add("role", "string").add("digest", "binary")
    walk = T.StructType([conv, *longs("seg", "enter", "leave"), text("audit"), many("items", item)])
    walks = written(segments.select("conv_id", "seg", "code", "copies", "role", "digest").join(bounds, "seg").select("conv_id", "seg", "code", "copies", "role", "digest", "forward", "backward", "end").mapInArrow(_walked, walk), f"{folder}/walks")
    chosen = walks.groupBy("conv_id").agg(F.collect_list(F.struct("seg", "enter", "leave")).alias("steps")).select("steps").mapInArrow(_chosen, T.StructType(longs("seg", "enter")))
    path = written(walks.join(chosen, ["seg", "enter"]).select("conv_id", "seg", "audit", "items"), f"{folder}/path")

    audit = path.groupBy(F.col("conv_id").alias("c")).agg(F.array_join(F.transform(F.sort_array(F.collect_list(F.struct("seg", "audit"))), lambda x: x["audit"]), "").alias("audit"))
    report = counts.drop("segs").join(audit, F.col("conv_id").eqNullSafe(F.col("c"))).drop("c")
    texts = filled(rows).groupBy(F.col("conv_id").alias("c"), digest().alias("d")).agg(F.first("text").alias("text"))
    stays = path.select("conv_id", "seg", F.posexplode("items").alias("pos", "x")).select("conv_id", "seg", "pos", "x.*")
    out = stays.join(texts, F.col("conv_id").eqNullSafe(F.col("c")) & (F.col("digest") == F.col("d")), "left")
    return report, out.select("conv_id", "seg", "pos", "edit", "role", F.coalesce("text", F.lit("")).alias("text"))


def damaged(rows: DataFrame) -> DataFrame:
    """The contract's damage, by a checksum of conversation and turn: 0 drops a row, 1 empties its text, 2 takes its sentence ends, 3 repeats it,
    4 makes it the user's."""
    here = filled(rows)
    key = F.concat(F.coalesce(F.col("conv_id").cast("string"), F.lit(" ")), F.lit(":"), F.coalesce(F.col("turn").cast("string"), F.lit(" ")))
    marked = here.withColumn("_d", F.crc32(key.cast("binary")) % 20).filter("_d != 0")
    text = F.when(F.col("_d") == 1, "").when(F.col("_d") == 2, F.translate("text", ".!?", "")).otherwise(F.col("text"))
    copies = F.when(F.col("_d") == 3, F.array(F.lit(1), F.lit(2))).otherwise(F.array(F.lit(1)))
    return marked.select("conv_id", "turn", F.when(F.col("_d") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("_c")).drop("_c")


def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    report, repaired = repair(damaged(rows))
    said = F.transform(F.sort_array(F.collect_list(F.struct("seg", "pos", F.concat("role", F.lit(":"), "text").alias("said")))), lambda x: x["said"])
    whole = repaired.groupBy(F.col("conv_id").alias("w")).agg(F.sha2(F.array_join(said, "\n"), 256).alias("sha"))
    every = rows.select("conv_id").distinct()
    got = report.withColumnRenamed("conv_id", "r")
    out = every.join(got, F.col("conv_id").eqNullSafe(F.col("r")), "left").join(whole, F.col("conv_id").eqNullSafe(F.col("w")), "left")
    numbers = [F.coalesce(n, F.lit(0)).cast("long").alias(n) for n in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return out.select("conv_id", *numbers, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("sha", F.sha2(F.lit(""), 256)).alias("repaired_sha256"))


def _sql() -> str:
    """The same by a recursion over rows: of each node the least (cost, audit), with the repaired rows so far."""
    said = {"u": "'user'", "a": "'assistant'", "own": "r.role"}
    via = lambda node, cost, letter, role, text: f"CASE WHEN {node} IS NOT NULL THEN {{'c': {node}.c + {cost}, 'a': {node}.a || '{letter}', 'r': {node}.r || " + (f"chr(10) || {said[role]} || ':' || {text}" if role else "''") + "} END"
    least = lambda *of: f"list_sort(list_filter([{', '.join(of)}], lambda x: x IS NOT NULL))[1]"
    gate = lambda when, x: f"CASE WHEN {when} THEN {x} END"
    keep = lambda node, letter: gate(f"r.initial = '{letter}' AND NOT r.doomed", via(node, "r.cut", "K", "own", "r.text"))
    other = lambda node, role: gate("NOT r.doomed", via(node, "2 + r.cut", "R", role, "r.text"))
    gone = lambda node: via(node, 3, "D", "", "")
    n, s, u, a = (f"d.{x}" for x in "nsua")
    step = {
        "n": least(gone(n)),
        "s": least(gone(s), keep(n, "s")),
        "u": least(gone(u), *[f(x, "u") for f in (keep, other) for x in (n, s, a)]),
        "a": least(gone(a), keep(u, "a"), other(u, "a")),
    }
    added = lambda node, role: via(node, 2, "I", role, "''")
    inserts = lambda of: f"SELECT conv_id, i, n, s, {least('u', *[added(x, 'u') for x in 'nsa'])} AS u, {least('a', added('u', 'a'))} AS a FROM ({of})"
    closed = lambda of: inserts(inserts(of))
    nothing = "CAST(NULL AS STRUCT(c BIGINT, a VARCHAR, r VARCHAR))"
    start = f"SELECT conv_id, CAST(0 AS BIGINT) AS i, {{'c': CAST(0 AS BIGINT), 'a': '', 'r': ''}} AS n, {nothing} AS s, {nothing} AS u, {nothing} AS a FROM k GROUP BY conv_id"
    bare = "trim(text, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))"
    return f"""
WITH RECURSIVE crc AS (
  SELECT list(list_reduce(range(8), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END, n) ORDER BY n) AS t FROM range(256) AS x(n)
), raw AS (
  SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
    xor(4294967295, list_reduce(list_transform(split(coalesce(CAST(conv_id AS VARCHAR), ' ') || ':' || coalesce(CAST(turn AS VARCHAR), ' '), ''), lambda ch: CAST(ord(ch) AS BIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1]), CAST(4294967295 AS BIGINT))) % 20 AS d
  FROM conversations, crc
), dealt AS (
  SELECT conv_id, turn, CASE d WHEN 4 THEN 'user' ELSE role END AS role, CASE d WHEN 1 THEN '' WHEN 2 THEN translate(text, '.!?', '') ELSE text END AS text
  FROM (SELECT *, unnest(range(CASE d WHEN 3 THEN 2 ELSE 1 END)) FROM raw WHERE d != 0)
), f AS (
  SELECT *, substr(role, 1, 1) AS initial, {bare} = '' AS blank, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY i) > 1 AS again, right({bare}, 1) NOT IN ('.', '!', '?') AS open
  FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, sha256(length(role) || ':' || role || text)) AS i FROM dealt)
), k AS (
  SELECT *, blank OR again AS doomed, CAST(open AND NOT blank AND NOT again AS BIGINT) AS cut, lag(initial) OVER (PARTITION BY conv_id ORDER BY i) AS before FROM f
), d AS (
  {closed(start)}
  UNION ALL
  {closed(f"SELECT d.conv_id, r.i AS i, {', '.join(f'{v} AS {c}' for c, v in step.items())} FROM d JOIN k AS r ON r.conv_id IS NOT DISTINCT FROM d.conv_id AND r.i = d.i + 1")}
), counted AS (
  SELECT conv_id, max(turn) - min(turn) + 1 - count(DISTINCT turn) AS gaps, sum(CAST(blank AS BIGINT)) AS blank, sum(CAST(again AND NOT blank AS BIGINT)) AS duplicate, sum(cut) AS truncated,
    sum(CAST(before || initial NOT IN ('su', 'ua', 'au') AS BIGINT)) AS illegal, count(*) AS rows_in
  FROM k GROUP BY conv_id
), best AS (
  SELECT c.*, {least('d.n', 'd.a')} AS b FROM counted AS c JOIN d ON d.conv_id IS NOT DISTINCT FROM c.conv_id AND d.i = c.rows_in
)
SELECT o.conv_id, CAST(coalesce(gaps, 0) AS BIGINT) AS gaps, CAST(coalesce(blank, 0) AS BIGINT) AS blank, CAST(coalesce(duplicate, 0) AS BIGINT) AS duplicate, CAST(coalesce(truncated, 0) AS BIGINT) AS truncated,
  CAST(coalesce(illegal, 0) AS BIGINT) AS illegal, CAST(coalesce(b.c, 0) AS BIGINT) AS cost, coalesce(b.a, '') AS audit, sha256(coalesce(substr(b.r, 2), '')) AS repaired_sha256
FROM (SELECT DISTINCT conv_id FROM conversations) AS o LEFT JOIN best ON best.conv_id IS NOT DISTINCT FROM o.conv_id
"""


SQL = _sql()
