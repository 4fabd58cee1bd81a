"""Windows made within tasks: statistics against plain Python, and plans that neither shuffle windows nor walk them cell by cell."""

import random
import statistics as st

import numpy as np
import pytest

from gapseries.operators import adapt, choice
from gapseries.operators import features as ft
from gapseries.plans import chosen, more  # noqa: F401 - adds to the queries
from gapseries.plans.queries import QUERIES, arrays, near, near_cells, panel

from compare import TABLES


def test_statistics_are_those_of_plain_python():
    r = random.Random(7)
    for size in (4, 5, 6):
        x = np.array([[[r.choice([np.nan, r.uniform(-5, 5), 1.0]) for _ in range(40)] for _ in range(3)] for _ in range(size)])
        got = ft.statistics(x)
        for c in range(3):
            for k in range(40):
                v = [(i + 1, a) for i, a in enumerate(x[:, c, k]) if a == a]
                s, t = sorted(a for _, a in v), dict(zip(ft.STATS, got[:, c, k], strict=True))
                assert t["valid_count"] == len(v)
                if len(v) < 2:
                    assert np.isnan(t["std"]) and np.isnan(t["slope"]) and (np.isnan(t["mean"]) if not v else t["mean"] == t["first"] == t["p25"] == s[0])
                    continue
                low, middle, high = st.quantiles(s, n=4, method="inclusive")
                slope = st.linear_regression(*zip(*v, strict=True)).slope
                want = {"mean": st.fmean(s), "median": middle, "std": st.pstdev(s), "min": s[0], "max": s[-1], "p25": low, "p75": high, "iqr": high - low, "first": v[0][1], "last": v[-1][1], "slope": slope}
                assert all(t[n] == pytest.approx(w, abs=1e-12) for n, w in want.items())


@pytest.mark.parametrize("name", ["feature_set_full", "feature_set_compact", "window_aggregates", "relative_positions_wide", "sequence_arrays", "sequence_masks", "mean_abs_difference"])
def test_windows_are_not_shuffled(spark, name):
    plan = QUERIES[name](spark, TABLES)._jdf.queryExecution().executedPlan().toString()
    assert "hashpartitioning(window_id" not in plan and "lambda" not in plan.split("Exchange")[0]


def test_rounding_is_that_of_decimals(spark):
    r = random.Random(3)
    rows = [(x,) for x in [None, 0.0, -0.0, 0.5, 2.5e-6, 1e15, -1e300, float("inf"), 123456.7890125, -3.1415925] + [r.uniform(-1e4, 1e4) for _ in range(500)]]
    df = spark.createDataFrame(rows, "x double").selectExpr("x", "round(x + 3e-10D, 6) + 0D as want").withColumn("got", near("x"))
    assert df.filter("not (got <=> want)").count() == 0
    want = [np.nan if x is None else x for (x,) in df.select("want").collect()]
    cells = np.array([[np.nan if x is None else x for (x,) in rows]])
    assert np.array_equal(near_cells(cells)[0], want, equal_nan=True)
    assert not np.signbit(near_cells(np.array([-1e-7, -0.0, -3e-10]))).any()


def test_channels_are_made_where_their_windows_are(spark, monkeypatch):
    monkeypatch.setattr(ft, "BLOCK", 2)
    keys = panel(spark, TABLES).select("entity_id").distinct().count()
    made = arrays(spark, TABLES)
    assert made.rdd.getNumPartitions() == max((keys // 2 + 1) // 4, min(keys // 2 + 1, spark.sparkContext.defaultParallelism)) > 8
    above, dealt, below = arrays(spark, TABLES)._jdf.queryExecution().executedPlan().toString().partition("REPARTITION_BY_NUM")
    assert dealt and "radar__vv_minus_vh" in above and "radar__vv_minus_vh" not in below


def test_cells_without_a_value_are_null():
    x = np.array([[1.5, np.nan, -0.0], [np.nan, np.inf, 2.0]])
    assert ft.nullable(x.T).to_pylist() == [1.5, None, None, np.inf, -0.0, 2.0]
    assert ft.nullable(x[:0]).to_pylist() == []


def test_year_statistics_take_no_buffers_of_values(spark):
    plan = QUERIES["aggregates_all_channels"](spark, TABLES)._jdf.queryExecution().executedPlan().toString()
    assert "percentile" not in plan and "channel#" not in "".join(x for x in plan.splitlines() if "Exchange" in x)


def test_learned_weights_do_not_put_a_repeat_into_one_task(spark):
    rows = spark.createDataFrame([(i % 2, i % 5, i % 3 % 2, i / 40, 1 - i / 50) for i in range(40)], "repeat int, fold int, label int, p1 double, p2 double")
    plan = choice.nested(rows, "repeat", "fold", "p1", "p2", "label")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastHashJoin") >= 3  # both uses of the weights left, and the best ones


def test_importances_of_one_method_take_its_fits_alone(spark, monkeypatch):
    swept = []

    def sweep(rows, features, key, label, methods, **more):
        swept.append((list(methods), more))
        raise RuntimeError("swept")

    monkeypatch.setattr(adapt, "sweep", sweep)
    with pytest.raises(RuntimeError, match="swept"):
        QUERIES["adaptation_importances"](spark, TABLES)
    assert swept == [(["baseline"], {"score": False})]
