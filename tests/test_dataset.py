import pytest
from pyspark.sql import functions as F

from gapseries.operators import dataset as ds
from gapseries.operators import panel as pn
from gapseries.plans import queries, whole

from compare import TABLES

COLUMNS = [f"{b}_{m:02d}" for b in pn.BANDS for m in pn.MONTHS]


def test_names_are_parsed_or_refused():
    assert ds.parsed(["VV_03", "re1_12"]) == [("VV", 3, "radar"), ("re1", 12, "optical")]
    for bad in ("VV_13", "VV_00", "XX_01", "VV_1", "VV", "_01"):
        with pytest.raises(ValueError, match="no band and month"):
            ds.parsed([bad])
    assert ds.grid_faults(COLUMNS) == {"absent": [], "repeated": []}
    assert ds.grid_faults([*COLUMNS[1:], COLUMNS[5]]) == {"absent": [COLUMNS[0]], "repeated": [COLUMNS[5]]}


def wide(spark, keys, label=None):
    row = {c: float(i) for i, c in enumerate(COLUMNS)} | {"VV_01": -9999.0}
    names = ["id", *(["label"] if label else []), *COLUMNS]
    rows = [(k, *([label[i]] if label else []), *[row[c] for c in COLUMNS]) for i, k in enumerate(keys)]
    kinds = ["id string", *(["label int"] if label else []), *[f"{c} double" for c in COLUMNS]]
    return spark.createDataFrame(rows, ", ".join(kinds)).select(*names)


def places(spark, keys):
    return spark.createDataFrame([(k, 0, 0.5, i) for i, k in enumerate(keys)], "id string, t int, r double, pos int")


def test_load(spark):
    train, test, sample = wide(spark, "abc", [0, 1, 1]), wide(spark, "xy"), places(spark, "xy")
    at = F.when(F.col("id") == "x", 0).otherwise(1)
    got = ds.load(train, test.withColumn("pos", at), sample, "id", "label", ["t", "r"])
    assert [r["VV_01"] for r in got.train.collect()] == [None] * 3
    assert train.first()["VV_01"] == -9999.0
    assert got.train_summary.first().asDict() == {"rows": 3, "cells": 432, "missing_cells": 3, "rows_with_missing": 3, "positives": 2, "negatives": 1, "positive_rate": pytest.approx(2 / 3)}
    assert got.test_summary.first()["rows"] == 2


@pytest.mark.parametrize(("change", "said"), [
    (lambda a, b, c: (a.withColumn("label", F.lit(1)), b, c), "label_classes: 1"),
    (lambda a, b, c: (a.withColumn("label", F.when(F.col("id") == "a", 2).otherwise(F.col("label"))), b, c), "label_values: 1"),
    (lambda a, b, c: (a.withColumn("label", F.lit(None).cast("int")), b, c), "label_values: 3"),
    (lambda a, b, c: (a.drop("label"), b, c), "label_absent_in_train: 1"),
    (lambda a, b, c: (a, b.withColumn("label", F.lit(1)), c), "label_present_in_test: 1"),
    (lambda a, b, c: (a, b.drop("VV_02"), c), "feature_order"),
    (lambda a, b, c: (a.select("id", "label", *reversed(COLUMNS)), b, c), "feature_order"),
    (lambda a, b, c: (a, b, c.select("id", "r", "t", "pos")), "sample_columns: 1"),
    (lambda a, b, c: (a, b, c.filter("id = 'x'")), "absent_in_sample: 1"),
    (lambda a, b, c: (a, b, c.union(c.filter("id = 'x'"))), "sample_repeated_keys: 1"),
    (lambda a, b, c: (a, b, c.withColumn("pos", 1 - F.col("pos"))), "sample_places: 2"),
    (lambda a, b, c: (a, b.filter("id = 'x'"), c), "unknown_in_sample: 1"),
    (lambda a, b, c: (a.withColumn("id", F.when(F.col("id") == "a", "x").otherwise(F.col("id"))), b, c), "keys_in_train_and_test: 1"),
    (lambda a, b, c: (a.withColumn("id", F.when(F.col("id") != "a", F.col("id"))), b, c), "train_null_keys: 1"),
    (lambda a, b, c: (a.withColumn("nir_02", F.lit(float("nan"))), b, c), "train_bad_rows: 3"),
])
def test_load_names_every_broken_rule(spark, change, said):
    test = wide(spark, "xy").withColumn("pos", F.when(F.col("id") == "x", 0).otherwise(1))
    with pytest.raises(ValueError, match=said):
        ds.load(*change(wide(spark, "abc", [0, 1, 1]), test, places(spark, "xy")), "id", "label", ["t", "r"])


def test_summary_of_nothing(spark):
    assert ds.summary(wide(spark, "a", [1]).limit(0), COLUMNS, "label").first()["positive_rate"] is None


def two(spark):
    a = spark.createDataFrame([("w1", 0, 1, 0.1), ("w2", 0, None, 0.2)], "w string, fold int, label int, p1 double")
    return a, a.drop("p1").withColumn("p2", F.lit(0.9))


def test_windows_are_aligned_or_refused(spark):
    a, b = two(spark)
    put = lambda x, y: sorted(map(tuple, ds.aligned_windows(x, y, ["w"], ["fold", "label"], ("p1", "p2")).collect()))
    assert put(a, b) == [("w1", 0, 1, 0.1, 0.9), ("w2", 0, None, 0.2, 0.9)]
    assert put(a.limit(0), b.limit(0)) == []
    for x, y in ((a.filter("w = 'w1'"), b), (a, b.filter("w = 'w1'")), (a.union(a), b), (a, b.union(b)), (a.withColumn("w", F.lit(None).cast("string")).limit(1), b.withColumn("w", F.lit(None).cast("string")).limit(1))):
        with pytest.raises(Exception, match="not one to one"):
            put(x, y)
    with pytest.raises(Exception, match="differ in their columns: w2"):
        put(a, b.withColumn("label", F.lit(1)))


def test_season_split_has_the_counts_of_all_splits(spark):
    from gapseries.operators import views

    rows = whole.predictions(spark, TABLES).withColumn("window_id", F.concat_ws(":", "entity_id", "window_length", "window_start")).cache()
    for r in views.season_out(rows).filter("repeat = 1 and fold < 2").collect():
        train, valid = ds.season_split(rows, r["repeat"], r["fold"], r["season"])
        assert (train.count(), valid.count()) == (r["training_n"], r["validation_n"])
        assert train.join(valid, "entity_id", "left_semi").count() == 0


def test_subset(spark):
    rows = spark.createDataFrame([("a", 1), ("a", 2), ("b", 3)], "window_id string, x int")
    pick = lambda *ids: spark.createDataFrame([(i,) for i in ids], "window_id string")
    assert sorted(r["x"] for r in ds.subset(rows, pick("a", "a")).collect()) == [1, 2]
    with pytest.raises(ValueError, match="nothing"):
        ds.subset(rows, pick("a").limit(0))
    with pytest.raises(ValueError, match="1 chosen are absent, such as z"):
        ds.subset(rows, pick("a", "z"))


def test_missing_by_row(spark):
    panel = queries.panel(spark, TABLES)
    rows = ds.missing_by_row(panel, "entity_id")
    assert rows.agg(F.sum("observations")).first()[0] == panel.count() * 12
    assert rows.filter("missing > observations or partial_months > 12 or rate < 0 or rate > 1").count() == 0
