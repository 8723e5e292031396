"""python -m varloom.cli DATASET ESTIMATOR {oracle,ij,boot,qij} --N 10000 --draws 0:5 --out FOLDER [options]"""

from __future__ import annotations

import argparse

from varloom.plans import methods
from varloom.session import session
from varloom.sources import products as store


def draws(text: str) -> range:
    first, end = text.split(":")
    return range(int(first), int(end))


def main(argv: list[str] | None = None) -> tuple[list[int], list[int]]:
    p = argparse.ArgumentParser(description=__doc__)
    p.add_argument("dataset")
    p.add_argument("estimator")
    p.add_argument("method", choices=("oracle", "ij", "boot", "qij"))
    p.add_argument("--N", type=int, required=True)
    p.add_argument("--draws", type=draws, required=True, help="first:end")
    p.add_argument("--out", required=True)
    p.add_argument("--seed", type=int, default=0)
    p.add_argument("--workers", type=int, default=1, help="default of --k")
    p.add_argument("--force", action="store_true")
    p.add_argument("--allow-commit-mismatch", action="store_true", help="continue a folder after a commit that did not touch the method")
    p.add_argument("--B", type=int, default=2000)
    p.add_argument("--eps", type=float, default=0.01)
    p.add_argument("--level", type=float, default=store.LEVEL)
    p.add_argument("--M", type=int)
    p.add_argument("--k", type=int, help="most splits in a round")
    a = p.parse_args(argv)
    spark = session()
    config = dict(method=a.method, dataset=a.dataset, estimator=a.estimator, N=a.N, seed=a.seed, code_commit=store.code_commit())
    k = a.k or a.workers
    if a.method == "boot":
        config["B"] = a.B
    elif a.method == "qij":
        config |= dict(eps=a.eps, level=a.level, M=a.M, k=k)
    folder = store.method_dir(a.out, a.dataset, a.estimator, a.N, a.method, store.dir_tag(a.method, config))
    store.ensure_config(spark, folder, config, ("code_commit",) if a.allow_commit_mismatch else ())
    common = (spark, a.dataset, a.estimator, a.N, a.draws, a.out)
    options = dict(seed=a.seed, force=a.force)
    if a.method == "oracle":
        done = methods.run_oracle(*common, **options)
    elif a.method == "ij":
        done = methods.run_ij(*common, **options)
    elif a.method == "boot":
        done = methods.run_boot(*common, b=a.B, **options)
    else:
        done = methods.run_qij(*common, eps=a.eps, level=a.level, m=a.M, k=k, **options)
    store.append_log(spark, folder, dict(N=a.N, draws=[a.draws.start, a.draws.stop], **options), *done)
    store.write_manifest(spark, folder)
    store.write_readme(spark, a.out)
    return done


if __name__ == "__main__":
    main()
