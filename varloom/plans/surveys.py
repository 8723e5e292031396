"""Queries over price cells as a quantized data set: influences of prototypes, the doubled step, refinement, and leaves cut by two-means."""

from __future__ import annotations

from pyspark.sql import functions as F

from varloom.functions import expressions as fx
from varloom.operators import statistics as st
from varloom.operators import survey
from varloom.plans.catalogue import PRICE_MIN, cells, prices, query, rounded

DELTA = 0.01
_PROTO = "proto AS (SELECT CAST(floor(o_totalprice / 50000.0) AS INTEGER) AS cell, count(*) / (SELECT count(*) FROM orders)::DOUBLE AS p, avg(o_totalprice) AS m FROM orders GROUP BY 1), all_of AS (SELECT sum(p * ln(m / 1000.0)) AS s FROM proto)"


def _response(delta: float) -> str:
    t = f"({delta} * p / (1 - p))"
    return f"((1 / ((1 - {t}) * s + {t} * ln(m / 1000.0)) - 1 / s) / {t})"


@query(f"WITH {_PROTO}, raw AS (SELECT cell, p, {_response(DELTA)} AS r FROM proto, all_of) SELECT cell, round(p, 9) AS p, round(r - (SELECT sum(p * r) / sum(p) FROM raw), 8) AS alpha FROM raw")
def proto_influences(spark, sf_dir):
    proto = survey.prototypes(cells(spark, sf_dir), "cell", ["o_totalprice"])
    return rounded(survey.prototype_influences(st.pareto_shape(PRICE_MIN), proto, "cell", ["o_totalprice"], DELTA), 8, p=9)


@query(f"WITH {_PROTO} SELECT cell, round(p, 9) AS p, round(2 * {_response(2 * DELTA)} / {_response(DELTA)}, 8) AS alpha FROM proto, all_of ORDER BY p DESC, cell LIMIT 5")
def step_doubling(spark, sf_dir):
    proto = survey.prototypes(cells(spark, sf_dir), "cell", ["o_totalprice"])
    return rounded(survey.step_doubling(st.pareto_shape(PRICE_MIN), proto, "cell", ["o_totalprice"], DELTA), 8, p=9)


#: Two cells of the price range, whose finite influences alone are centred: the logarithm of (price - 200000) is none below.
@query("WITH raw AS (SELECT CAST(floor(o_totalprice / 50000.0) AS INTEGER) AS cell, count(*)::DOUBLE AS p, ln(CASE WHEN avg(o_totalprice) > 200000 THEN avg(o_totalprice) - 200000 END) AS v FROM orders GROUP BY 1) SELECT cell, p, round(v - (SELECT sum(p * v) / sum(CASE WHEN v IS NOT NULL THEN p END) FROM raw), 8) AS v FROM raw")
def centred_finite(spark, sf_dir):
    """Centring over the cells whose value is finite."""
    own = cells(spark, sf_dir).groupBy("cell").agg(F.count("*").cast("double").alias("p"), F.log(F.avg("o_totalprice") - 200000.0).alias("v"))
    return rounded(survey.centred(own, "p", ["v"]), 8)


def loss(c):
    """Minus the log density of the Pareto law of shape 0.2."""
    return F.lit(1.2) * fx.log_ratio(c[0], PRICE_MIN)


@query()
def refined_units(spark, sf_dir):
    """Price cells refined until the mismatch of the Pareto law's loss is halved."""
    points = prices(spark, sf_dir).withColumn("unit", F.floor(F.col("o_totalprice") / 100000.0).cast("int"))
    units, totals = survey.refine(points, "unit", ["o_totalprice"], loss, survey.stored)
    return survey.mismatches(units, "unit", ["o_totalprice"], loss).withColumns({"first_total": F.lit(totals[0]), "last_total": F.lit(totals[-1]), "rounds": F.lit(len(totals) - 1)})
