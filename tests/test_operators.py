import math

import pytest
from pyspark.sql import functions as F

from gapseries.functions import safe_divide
from gapseries.operators import evaluation as ev
from gapseries.operators import features as ft
from gapseries.sources import check_submission, read_wide_csv, wide_schema
from gapseries.streaming import event_windows


def test_aggregates_of_gapped_series(spark):
    rows = spark.createDataFrame([("a", 1, 1.0), ("a", 2, None), ("a", 3, None), ("a", 4, 7.0), ("b", 2, 5.0), ("c", 1, None)], "k string, pos int, x double")
    r = {x["k"]: x for x in ft.aggregates(rows, ["k"]).collect()}
    a = r["a"]
    assert (a["valid_count"], a["mean"], a["std"], a["amplitude"], a["p25"], a["p75"], a["iqr"], a["first"], a["last"], a["first_to_last"], a["slope"]) == (2, 4, 3, 6, 2.5, 5.5, 3, 1, 7, 6, 2)
    assert r["b"]["mean"] == 5 and [r["b"][c] for c in ("std", "amplitude", "iqr", "first_to_last", "slope")] == [None] * 5
    assert r["c"]["valid_count"] == 0 and r["c"]["mean"] is None


def test_metrics_count_ties_half(spark):
    rows = spark.createDataFrame([(0, 0.1), (0, 0.5), (1, 0.5), (1, 0.9)], "y int, p double").withColumn("g", F.lit(1))
    m = ev.metrics(rows, ["g"], "p", "y").first()
    assert (m["tn"], m["fp"], m["fn"], m["tp"], m["f1"], m["auc"]) == (1, 1, 0, 2, 0.8, 0.875)
    assert ev.metrics(rows.filter("y = 1"), ["g"], "p", "y").first()["auc"] is None


def test_combine(spark):
    rows = spark.createDataFrame([(x,) for x in (0.1, 0.2, 0.8, 0.9)], "p double")
    got = rows.agg(*[ev.combine("p", h).alias(h) for h in ("mean", "median", "logit_mean")]).first()
    assert all(math.isclose(x, 0.5) for x in got)
    rows = spark.createDataFrame([(x,) for x in (0.0, 0.2, 0.3, 1.0)], "p double")
    assert math.isclose(rows.agg(ev.combine("p", "trimmed_mean")).first()[0], 0.25)


def test_density_weights_are_clipped(spark):
    rows = spark.createDataFrame([(x,) for x in (0.001, 0.2, 0.8, 0.999)], "p double")
    got = ev.density_weights(rows, "p").collect()
    assert all(0.5 <= x["weight"] <= 2 for x in got) and any(x["clipped_low"] for x in got) and any(x["clipped_high"] for x in got)


def test_safe_divide_rejects_bad_epsilon():
    with pytest.raises(ValueError):
        safe_divide(F.lit(1.0), F.lit(1.0), 0.0)


def test_csv_header_is_checked(spark, tmp_path):
    schema = wide_schema("label", bands=("VH",))
    (tmp_path / "a.csv").write_text(",".join(schema.fieldNames()) + "\nx,1" + ",1.5" * 12 + "\n")
    assert read_wide_csv(spark, str(tmp_path / "a.csv"), schema).first()["VH_12"] == 1.5
    (tmp_path / "b.csv").write_text("ID,label,VH_13\n")
    with pytest.raises(ValueError):
        read_wide_csv(spark, str(tmp_path / "b.csv"), schema)


def test_submission_checks(spark):
    good = ev.submission(spark.createDataFrame([("a", 0.1), ("b", 0.5), ("c", 0.9)], "k string, p double"), "k", "p")
    assert [x["TargetF1"] for x in good.orderBy("ID").collect()] == [0, 1, 1]
    assert not any(check_submission(good, good).values())
    assert check_submission(good.limit(2), good)["missing"] == 1


def test_stream_equals_batch(spark, tmp_path):
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet").select(F.col("ts").cast("timestamp").alias("ts"), "event_type", "value")
    events.repartition(2).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = event_windows(stream).writeStream.format("memory").queryName("got").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    got = {(r[0], r[1]): r["n"] for r in spark.table("got").collect()}
    assert got == {(r[0], r[1]): r["n"] for r in event_windows(events).collect()}
