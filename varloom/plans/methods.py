"""The four methods over draws: oracle, ij, boot, qij. Each skips draws that are done, writes arrays before rows, and gives the draws
written and skipped. Data is made where it is used: oracle and ij run one task a draw, for all pending draws in one job."""

from __future__ import annotations

import time
from collections.abc import Iterable, Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from varloom.operators import qij as certified
from varloom.operators.evaluate import call
from varloom.operators.mixture import Mixture, continuation_audit
from varloom.operators.resample import bootstrap
from varloom.sources import products as store
from varloom.sources.draws import case, truth

K = 16


def _status(theta: np.ndarray, T) -> str:
    if np.isfinite(theta).all():
        return "ok"
    return (getattr(T, "last_fit", None) or {}).get("status") or "nan"


def _split(spark: SparkSession, folder: str, draws: Iterable[int], force: bool) -> tuple[DataFrame, list[int], list[int]]:
    draws = list(draws)
    todo = store.pending(spark, folder, draws, force)
    ids = sorted(r["s"] for r in todo.collect())  # the requested draws, as the caller listed them
    return todo, ids, sorted(set(draws) - set(ids))


def _per_draw(spark: SparkSession, ids: Sequence[int], run, schema: str) -> DataFrame:
    """One task a draw."""
    return spark.createDataFrame([(s,) for s in ids], "s int").repartition(max(1, len(ids)), "s").mapInPandas(run, schema)


def run_oracle(spark: SparkSession, dataset: str, estimator: str, n: int, draws: Iterable[int], out: str, seed: int = 0, force: bool = False, audit: bool = False) -> tuple[list[int], list[int]]:
    """The estimate of each draw, with the truth beside it."""
    folder = store.method_dir(out, dataset, estimator, n, "oracle")
    _, ids, skipped = _split(spark, folder, draws, force)
    outputs, true = case(dataset, estimator).make().outputs, truth(dataset, estimator)

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = case(dataset, estimator)
        T = c.make()
        for pdf in frames:
            rows = []
            for s in pdf["s"]:
                began = time.perf_counter()
                x = c.draw(n, seed + int(s))
                theta = call(T, x, np.ones(n), None, T.eta)
                row = dict(dataset=dataset, estimator=estimator, N=n, s=int(s), seed=seed + int(s), n_failed=int(~np.isfinite(theta).all()), fit_status=_status(theta, T))
                found = dict(search_gap=float("nan"), search_failed=False, search_status="none")
                if audit and isinstance(T, Mixture) and len(true) == len(T.outputs):
                    found = continuation_audit(T, x, np.ones(n), np.array([true[o] for o in T.outputs]))
                row |= found | dict(wall_time=time.perf_counter() - began)
                row |= {f"theta_true_{o}": true.get(o, float("nan")) for o in outputs} | {f"theta_hat_{o}": v for o, v in zip(outputs, theta, strict=True)}
                rows.append(row)
            yield pd.DataFrame(rows)

    schema = "dataset string, estimator string, N long, s int, seed long, n_failed long, fit_status string, search_gap double, search_failed boolean, search_status string, wall_time double, " + ", ".join(f"`theta_{k}_{o}` double" for k in ("true", "hat") for o in outputs)
    if ids:
        store.write_rows(_per_draw(spark, ids, run, schema), folder)
    return ids, skipped


def run_ij(spark: SparkSession, dataset: str, estimator: str, n: int, draws: Iterable[int], out: str, seed: int = 0, force: bool = False) -> tuple[list[int], list[int]]:
    """The analytic influences of each draw, and the variance of the estimate, mean psi^2 / n."""
    folder = store.method_dir(out, dataset, estimator, n, "ij")
    _, ids, skipped = _split(spark, folder, draws, force)
    outputs = case(dataset, estimator).make().outputs

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        c = case(dataset, estimator)
        T = c.make()
        for pdf in frames:
            for s in pdf["s"]:
                psi = T.influence(c.draw(n, seed + int(s)))
                yield pd.DataFrame({"s": int(s), "i": np.arange(n)} | {f"psi_{o}": psi[:, j] for j, o in enumerate(outputs)})

    if ids:
        from pyspark.sql import functions as F

        schema = "s int, i long, " + ", ".join(f"`psi_{o}` double" for o in outputs)
        store.write_rows(_per_draw(spark, ids, run, schema), folder, "psi")
        psi = store.collect(spark, folder, "psi", draws=ids)
        bad = F.max(F.greatest(*[F.isnan(f"psi_{o}").cast("int") for o in outputs], F.lit(0)))
        rows = psi.groupBy("s").agg(F.count("*").alias("N"), F.when(bad == 1, "nan").otherwise("ok").alias("fit_status"), *[(F.avg(F.col(f"psi_{o}") * F.col(f"psi_{o}")) / F.count("*")).alias(f"V_ij_{o}") for o in outputs])
        rows = rows.withColumns({"dataset": F.lit(dataset), "estimator": F.lit(estimator), "seed": F.col("s") + F.lit(seed)})
        store.write_rows(rows, folder)
    return ids, skipped


def run_boot(spark: SparkSession, dataset: str, estimator: str, n: int, draws: Iterable[int], out: str, b: int = 2000, seed: int = 0, force: bool = False) -> tuple[list[int], list[int]]:
    """The replicates of each draw: draw by draw, replicates in parallel where a refit is needed."""
    folder = store.method_dir(out, dataset, estimator, n, "boot", store.dir_tag("boot", {"B": b}))
    _, ids, skipped = _split(spark, folder, draws, force)
    c = case(dataset, estimator)
    T = c.make()
    for s in ids:
        began = time.perf_counter()
        r = bootstrap(T, c.draw(n, seed + s), b, seed + s, spark)
        replicates = [(s, k, *map(float, row), st) for k, (row, st) in enumerate(zip(r.replicates, r.status, strict=True))]
        store.write_rows(spark.createDataFrame(replicates, "s int, b int, " + ", ".join(f"`theta_{o}` double" for o in r.outputs) + ", fit_status string"), folder, "replicates")
        row = (dataset, estimator, n, s, seed + s, r.n_degenerate, float(r.eta), _status(r.theta, T), time.perf_counter() - began, *map(float, r.theta), *map(float, r.variance()))
        schema = "dataset string, estimator string, N long, s int, seed long, n_degenerate long, eta_full double, fit_status string, wall_time double, " + ", ".join(f"`{k}_{o}` double" for k in ("theta_hat", "V_boot") for o in r.outputs)
        store.write_rows(spark.createDataFrame([row], schema), folder)
    return ids, skipped


def qij_row(r: certified.Result, **extra) -> tuple[dict, str]:
    """The scalar row of a run and its schema."""
    per = dict(Vhat=r.v_hat, U=r.u, delta=r.delta, V_lb=r.v_lb, offset=r.offset, bound_eval=r.bound_eval, eval_error_max=r.eval_error_max)
    row = extra | dict(M=r.cells, K=r.leaves, rounds=r.rounds, E=r.evaluations, E_full=float(r.evaluations), passed=r.passed, n_inferred=r.n_inferred, n_repaired=r.counts["repairs"], n_redundant=r.redundant, eta_full=float(r.eta)) | {k: float(v) for k, v in r.timings.items()}
    row |= {f"{k}_{o}": float(v[j]) for k, v in per.items() for j, o in enumerate(r.outputs)}
    kind = {bool: "boolean", int: "long", float: "double", str: "string"}
    return row, ", ".join(f"`{k}` {'int' if k == 's' else kind[type(v)]}" for k, v in row.items())


def run_qij(spark: SparkSession, dataset: str, estimator: str, n: int, draws: Iterable[int], out: str, eps: float = 0.01, level: float = store.LEVEL, m: int | None = None, k: int = K, seed: int = 0, force: bool = False) -> tuple[list[int], list[int]]:
    folder = store.method_dir(out, dataset, estimator, n, "qij", store.dir_tag("qij", dict(eps=eps, level=level, M=m, k=k)))
    _, ids, skipped = _split(spark, folder, draws, force)
    c = case(dataset, estimator)
    for s in ids:
        r = certified.run(c.make(), c.draw(n, seed + s), eps=eps, level=level, cells=m, k=k, seed=seed + s, spark=spark, transform=c.transform)
        rounds = [(s, t["round"], t["phase"], t["n_taken"], t["n_repaired"], t["E"], t["K"], *[None if t[f] is None else [float(v) for v in t[f]] for f in ("R_hat", "U", "delta", "offset")]) for t in r.rounds_table]
        store.write_rows(spark.createDataFrame(rounds, "s int, round int, phase string, n_taken int, n_repaired int, E int, K int, R_hat array<double>, U array<double>, delta array<double>, offset array<double>"), folder, "rounds")
        leaves = [(s, t["leaf"], t["n"], [float(v) for v in t["mean"]], [float(v) for v in t["term"]], t["determined"], [float(v) for v in t["bound"]], t["inferred"]) for t in r.leaves_table]
        store.write_rows(store.per_output(spark.createDataFrame(leaves, "s int, leaf int, n int, mean array<double>, term array<double>, determined boolean, bound array<double>, inferred boolean"), ["mean", "term", "bound"], r.outputs), folder, "leaves")
        row, schema = qij_row(r, dataset=dataset, estimator=estimator, N=n, s=s, seed=seed + s, eps=eps, level=level)
        store.write_rows(spark.createDataFrame([tuple(row.values())], schema), folder)
    return ids, skipped
