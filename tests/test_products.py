import json

import numpy as np
import pytest

from varloom.plans import methods
from varloom.sources import draws
from varloom.sources import products as store


def test_names():
    assert store.dir_tag("qij", dict(eps=0.01, k=16)) == "eps0.01_k16"
    assert store.dir_tag("qij", dict(eps=0.02, level=0.9, M=300, k=None, workers=4)) == "eps0.02_level0.9_M300_k4"
    assert store.dir_tag("boot", dict(B=50)) == "B50" and store.dir_tag("ij", {}) == ""
    assert store.method_dir("o", "pareto", "all", 10, "ij") == "o/pareto_N10/ij_all"
    assert store.method_dir("o/", "pareto", "all", 10, "boot", "B5") == "o/pareto_N10/boot_B5"


def test_config_is_kept(spark, tmp_path):
    folder = str(tmp_path / "c")
    store.ensure_config(spark, folder, dict(a=1, b=[2]))
    store.ensure_config(spark, folder, dict(a=1, b=(2,)))
    with pytest.raises(RuntimeError, match="a: 1 there, 3 here"):
        store.ensure_config(spark, folder, dict(a=3, b=[2]))
    store.ensure_config(spark, folder, dict(a=3, b=[2]), ignore=("a",))


def test_methods_write_resume_and_describe(spark, tmp_path):
    out = str(tmp_path)
    assert methods.run_oracle(spark, "pareto", "all", 300, range(3), out) == ([0, 1, 2], [])
    assert methods.run_oracle(spark, "pareto", "all", 300, range(5), out) == ([3, 4], [0, 1, 2])
    folder = store.method_dir(out, "pareto", "all", 300, "oracle")
    rows = store.collect(spark, folder).collect()
    assert [r["s"] for r in rows] == list(range(5)) and all(r["fit_status"] == "ok" for r in rows)
    T = draws.case("pareto", "all").make()
    assert rows[2]["theta_hat_alpha"] == pytest.approx(T(draws.draw("pareto", 300, 2), np.ones(300))[0], rel=1e-12)

    assert methods.run_ij(spark, "pareto", "all", 300, [1, 4], out) == ([1, 4], [])
    folder = store.method_dir(out, "pareto", "all", 300, "ij")
    psi = T.influence(draws.draw("pareto", 300, 4))
    assert store.collect(spark, folder).filter("s = 4").first()["V_ij_alpha"] == pytest.approx((psi[:, 0] ** 2).mean() / 300, rel=1e-9)
    assert store.collect(spark, folder, "psi", draws=[4]).count() == 300

    assert methods.run_boot(spark, "pareto", "all", 300, [0], out, b=40) == ([0], [])
    folder = store.method_dir(out, "pareto", "all", 300, "boot", "B40")
    assert store.collect(spark, folder, "replicates").count() == 40

    assert methods.run_qij(spark, "pareto", "shape", 300, [0], out, k=4) == ([0], [])
    folder = store.method_dir(out, "pareto", "shape", 300, "qij", "eps0.01_k4")
    row = store.collect(spark, folder).first()
    assert row["E"] > 0 and store.collect(spark, folder, "leaves").count() == row["K"]
    assert store.collect(spark, folder, "rounds").count() == row["rounds"]

    store.ensure_config(spark, folder, dict(x=1))
    before = len(store.read_log(spark, folder))
    for k in range(3):
        store.append_log(spark, folder, dict(N=300 + k), [0], [], ["cli"])
    assert [r["params"]["N"] for r in store.read_log(spark, folder)[before:]].count(301) == 1 and len(store.read_log(spark, folder)) == before + 3
    assert store.write_manifest(spark, folder)["draws"] == "0"
    assert "qij_shape" in store.write_readme(spark, out)
    assert json.loads(store.read_text(spark, folder + "/manifest.json"))["n_draws"] == 1


def test_empty_store(spark, tmp_path):
    assert store.collect(spark, str(tmp_path / "none"), schema="s int, E long").count() == 0


def test_ranges(spark):
    df = spark.createDataFrame([(v,) for v in (0, 1, 2, 5, 7, 8, 8)], "s int")
    assert store.ranges_text(df) == "0..2,5,7..8"


def test_per_output(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0])], "s int, v array<double>")
    assert store.per_output(df, ["v"], ["a", "b"]).first().asDict() == {"s": 1, "v_a": 1.0, "v_b": 2.0}


def test_truth_file(spark, tmp_path):
    path = tmp_path / "t.json"
    path.write_text(json.dumps({"shape": {"outputs": ["alpha"], "values": [2.0], "source": "law"}}, indent=1))
    assert draws.read_truth(spark, str(path)).collect() == [("shape", "alpha", 2.0, "law")]
    with pytest.raises(KeyError):
        draws.case("pareto", "nothing")
    assert draws.catalogue(spark).count() == len(draws.CASES)


def test_resample(spark):
    pool = spark.range(10).selectExpr("id AS i", "id * 2.0D AS v")
    assert draws.resample(pool, 50, 1).count() == 50


def test_cli(spark, tmp_path):
    from varloom import cli

    args = ["pareto", "shape", "boot", "--N", "200", "--draws", "0:2", "--out", str(tmp_path), "--B", "20"]
    assert cli.main(args) == ([0, 1], [])
    assert cli.main([*args, "--allow-commit-mismatch"]) == ([], [0, 1])


def test_text_replaces_what_is_there(spark, tmp_path):
    path = f"{tmp_path}/a.txt"
    for text in ("one", "two", "three"):
        store.write_text(spark, path, text)
        assert store.read_text(spark, path) == text
    assert sorted(p.name for p in tmp_path.iterdir() if not p.name.startswith(".")) == ["a.txt"]
