"""The product store: one folder for each data set, size, method and configuration; in it the scalar rows ("rows") and arrays
("psi", "replicates", "rounds", "leaves") of the draws as Parquet partitioned by draw, config.json, runs/ (a file for each run) and manifest.json.

Arrays are written first and the scalar row last: a draw is done if its row is there. Folders are reached through Spark's file systems,
so that the store may lie on any of them.
"""

from __future__ import annotations

import json
import os
import platform
import re
import socket
import subprocess
import sys
import uuid
from collections.abc import Iterable, Sequence
from datetime import datetime, timezone

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from varloom.operators.ordering import islands

LEVEL = 0.84


def dir_tag(method: str, config: dict) -> str:
    """What tells configurations of a method apart: eps, level, M and k, or B."""
    if method == "boot":
        return f"B{config['B']}"
    if method != "qij":
        return ""
    out = [f"eps{config['eps']:g}"]
    if config.get("level", LEVEL) != LEVEL:
        out.append(f"level{config['level']:g}")
    if config.get("M"):
        out.append(f"M{config['M']}")
    return "_".join([*out, f"k{config.get('k') or config.get('workers') or 1}"])


def method_dir(out: str, dataset: str, estimator: str, n: int, method: str, tag: str = "") -> str:
    own = f"{method}_{estimator}" if method in ("ij", "qij") else method
    return f"{out.rstrip('/')}/{dataset}_N{n}/{own}" + (f"_{tag}" if tag else "")


# Small files, by Spark's file systems ---------------------------------------------------------------------------------------------


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _fs(spark, path)
    return fs.exists(p)


def read_text(spark: SparkSession, path: str) -> str | None:
    fs, p = _fs(spark, path)
    if not fs.exists(p):
        return None
    stream = fs.open(p)
    try:
        return spark.sparkContext._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8")
    finally:
        stream.close()


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """A whole file or none: written beside, then renamed."""
    fs, p = _fs(spark, path)
    _, tmp = _fs(spark, f"{path}.{uuid.uuid4().hex}.tmp")
    stream = fs.create(tmp, True)
    stream.write(bytearray(text.encode()))
    stream.close()
    if not fs.rename(tmp, p):  # where a rename does not replace
        fs.delete(p, False)
        fs.rename(tmp, p)


def folders(spark: SparkSession, pattern: str) -> list[str]:
    fs, p = _fs(spark, pattern)
    return sorted(s.getPath().toString() for s in (fs.globStatus(p) or []))


# Configuration and provenance -----------------------------------------------------------------------------------------------------


def ensure_config(spark: SparkSession, folder: str, config: dict, ignore: Iterable[str] = ()) -> None:
    """Written once; later runs must agree with it, as JSON."""
    new = json.loads(json.dumps(config))
    old = read_text(spark, f"{folder}/config.json")
    if old is None:
        write_text(spark, f"{folder}/config.json", json.dumps(new, indent=1, sort_keys=True))
        return
    old, skip = json.loads(old), set(ignore)
    differ = [f"{k}: {old.get(k)!r} there, {new.get(k)!r} here" for k in sorted({*old, *new} - skip) if old.get(k) != new.get(k)]
    if differ:
        raise RuntimeError(f"{folder} has another configuration: " + "; ".join(differ))


def code_commit(repo: str | None = None) -> str:
    """Twelve digits of the commit, -dirty with changes; 'unknown' outside a repository."""
    here = repo or os.path.dirname(os.path.abspath(__file__))
    git = lambda *a: subprocess.run(["git", "-C", here, *a], capture_output=True, text=True, timeout=30)
    try:
        head = git("rev-parse", "--short=12", "HEAD")
        if head.returncode:
            return "unknown"
        return head.stdout.strip() + ("-dirty" if git("status", "--porcelain").stdout.strip() else "")
    except (OSError, subprocess.SubprocessError):
        return "unknown"


def cpu_model() -> str:
    try:
        with open("/proc/cpuinfo") as f:
            found = re.search(r"model name\s*:\s*(.+)", f.read())
        return found[1].strip() if found else platform.processor() or "unknown"
    except OSError:
        return platform.processor() or "unknown"


def append_log(spark: SparkSession, folder: str, params: dict, written: Sequence[int], skipped: Sequence[int], argv: Sequence[str] | None = None) -> None:
    line = dict(time=datetime.now(timezone.utc).isoformat(timespec="seconds"), host=socket.gethostname(), cpu=cpu_model(), argv=list(sys.argv if argv is None else argv), params=params, written=list(written), skipped=list(skipped), code_commit=code_commit())
    name = f"{line['time'].replace(':', '')}-{uuid.uuid4().hex[:12]}"
    write_text(spark, f"{folder}/runs/{name}.json", json.dumps(line) + "\n")


def read_log(spark: SparkSession, folder: str) -> list[dict]:
    """The runs of a folder by time. Each is a file of its own, so that runs at the same time lose no line."""
    lines = [json.loads(read_text(spark, p)) for p in folders(spark, f"{folder}/runs/*.json")]
    return sorted(lines, key=lambda v: v["time"])


# Draws ----------------------------------------------------------------------------------------------------------------------------


def write_rows(df: DataFrame, folder: str, kind: str = "rows") -> None:
    """Rows with a column s, into the partitions of their draws; these are replaced, others stay."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("s").parquet(f"{folder}/{kind}")


def collect(spark: SparkSession, folder: str, kind: str = "rows", schema: str | None = None, draws: Sequence[int] | None = None) -> DataFrame:
    """All rows of a kind by draw; draws prunes partitions. Without any, an empty table of the schema, or of s alone."""
    if not exists(spark, f"{folder}/{kind}"):
        return spark.createDataFrame([], schema or "s int")
    df = spark.read.option("mergeSchema", True).parquet(f"{folder}/{kind}")
    if draws is not None:
        df = df.filter(F.col("s").isin([int(s) for s in draws]))
    return df.orderBy("s")


def pending(spark: SparkSession, folder: str, draws: Iterable[int], force: bool = False) -> DataFrame:
    """The requested draws that have no scalar row yet."""
    wanted = spark.createDataFrame([(int(s),) for s in draws], "s int")
    if force:
        return wanted
    return wanted.join(collect(spark, folder).select(F.col("s").cast("int").alias("s")), "s", "left_anti")


def draw_ranges(df: DataFrame, s: str = "s", by: Sequence[str] = ()) -> DataFrame:
    """first, last and n of each run of consecutive integers."""
    return islands(df, s, by)


def ranges_text(df: DataFrame) -> str:
    runs = draw_ranges(df).orderBy("first").collect()
    return ",".join(str(r["first"]) if r["first"] == r["last"] else f"{r['first']}..{r['last']}" for r in runs)


def write_manifest(spark: SparkSession, folder: str) -> dict:
    rows = collect(spark, folder).select("s")
    config = json.loads(read_text(spark, f"{folder}/config.json") or "{}")
    log = read_log(spark, folder)
    out = dict(config=config, n_draws=rows.distinct().count(), draws=ranges_text(rows), first=min((x["time"] for x in log), default=None), last=max((x["time"] for x in log), default=None), hosts=sorted({x["host"] for x in log}), commits=sorted({x["code_commit"] for x in log}))
    write_text(spark, f"{folder}/manifest.json", json.dumps(out, indent=1))
    return out


def write_readme(spark: SparkSession, root: str) -> str:
    lines = ["# Products", "", "| folder | draws | first | last | hosts | commits |", "|-|-|-|-|-|-|"]
    for path in folders(spark, f"{root.rstrip('/')}/*/*/manifest.json"):
        m = json.loads(read_text(spark, path))
        lines.append(f"| {'/'.join(path.split('/')[-3:-1])} | {m['n_draws']} ({m['draws']}) | {m['first']} | {m['last']} | {len(m['hosts'])} | {', '.join(m['commits'])} |")
    text = "\n".join(lines) + "\n"
    write_text(spark, f"{root.rstrip('/')}/README.md", text)
    return text


def per_output(df: DataFrame, arrays: Sequence[str], outputs: Sequence[str]) -> DataFrame:
    """Array columns over the outputs as columns array_output."""
    own = [F.col(c) for c in df.columns if c not in arrays]
    return df.select(*own, *[F.get(F.col(a), F.lit(j)).alias(f"{a}_{o}") for a in arrays for j, o in enumerate(outputs)])
