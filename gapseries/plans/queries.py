"""Queries over the supplied tables: monthly panels from lineitem, and what follows from them."""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gapseries.functions import safe_divide, sigmoid
from gapseries.operators import evaluation as ev
from gapseries.operators import features as ft
from gapseries.operators import panel as pn
from gapseries.operators import selection as sel

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}


def query(f):
    QUERIES[f.__name__] = f
    return f


#: Added before rounding, so that halves that engines' sums bring out a last bit apart round alike.
NUDGE = 3e-10


def near(x, digits: int = 6):
    """x to so many digits, as SQL engines round: scaled, to the nearest whole number, scaled back (F.round goes through decimals, which
    takes most of a wide query's time). Numbers too large for that go through decimals."""
    y, scale = (F.col(x) if isinstance(x, str) else x) + NUDGE, float(10**digits)
    return F.when(F.abs(y) < 1e6, F.rint(y * scale) / scale).otherwise(F.round(y, digits)) + 0.0


def near_cells(x: np.ndarray, digits: int = 6) -> np.ndarray:
    """The same for many cells within a task; NaN stays."""
    y, scale = x + NUDGE, float(10**digits)
    with np.errstate(over="ignore"):
        out = np.rint(y * scale) / scale + 0.0
    for i in zip(*np.nonzero(np.abs(y) >= 1e6), strict=True):  # from 1e15 on there are no such digits
        out[i] = float(Decimal(repr(float(y[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP)) if abs(y[i]) < 1e15 else y[i]
    return out


def rounded(df: DataFrame, digits: int = 6) -> DataFrame:
    return df.withColumns({c: near(c, digits) for c, t in df.dtypes if t == "double"})


def obs(spark: SparkSession, d: str) -> DataFrame:
    """entity_id (supplier and year), month, radar bands over all its lines, optical bands over those with return flag N."""
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    n = lambda c: F.when(F.col("l_returnflag") == "N", F.col(c))
    q, p = "l_quantity", "l_extendedprice"
    return li.groupBy((F.col("l_suppkey") * 10000 + F.year("l_shipdate")).alias("entity_id"), F.month("l_shipdate").alias("month")).agg(
        (-F.avg(p) / 1000).alias("VH"), F.avg(q).alias("VV"), (F.avg(n("l_discount")) * 100 + 1).alias("blue"), (F.avg(n("l_tax")) * 100 + 1).alias("green"), F.avg(n(q)).alias("nir"), F.max(n(q)).alias("nira"),
        (F.min(n(q)) + 1).alias("re1"), F.avg(n("l_linenumber")).alias("re2"), (F.sum(n(q)) / 10).alias("re3"), (F.avg(n(p)) / 1000).alias("red"), (F.max(n(p)) / 1000).alias("swir1"), (F.min(n(p)) / 1000).alias("swir2"),
    )


def labels(spark: SparkSession, d: str) -> DataFrame:
    li = spark.read.parquet(f"{d}/lineitem.parquet")
    return li.groupBy((F.col("l_suppkey") * 10000 + F.year("l_shipdate")).alias("entity_id")).agg((F.round(F.avg("l_tax"), 9) > 0.04).cast("int").alias("label"))


def panel(spark: SparkSession, d: str) -> DataFrame:
    return pn.dense(obs(spark, d), ["entity_id"])


def views(spark: SparkSession, d: str) -> DataFrame:
    return ft.sliding_views(panel(spark, d), "entity_id")


def predictions(spark: SparkSession, d: str, *more) -> DataFrame:
    """A row for each entity, repeat and window: label, fold, window columns, two model probabilities, and more aggregates of the window.

    The months are dealt out by entity once, so windows are made, joined and averaged where they are."""
    v = ft.sliding_views(panel(spark, d).repartition("entity_id"), "entity_id")
    w = v.groupBy("entity_id", "window_length", "window_start").agg(F.avg("VV").alias("a"), F.avg("VH").alias("b"), F.count("VV").alias("radar_months"), F.count(F.when(pn.all_valid(pn.OPTICAL), 1)).alias("optical_months"), *more)
    extra = w.columns[7:]
    w = w.filter("a is not null").withColumn("gaps", F.col("radar_months") - F.col("optical_months"))
    lab = labels(spark, d)
    fold = ev.folds(lab, "entity_id", "label", 5, 2)
    one = lambda x: near(sigmoid(x))
    w = w.withColumn("s", F.when(F.col("entity_id") % 7 < 4, 0.3).otherwise(-0.3))
    j = w.join(fold, "entity_id")
    sign = 2 * F.col("label") - 1
    return j.select("entity_id", "repeat", "fold", "label", "window_length", "window_start", "radar_months", "optical_months", "gaps", one(sign * (F.col("s") + 0.2) + (F.col("a") - 25) / 8).alias("p1"), one(sign * 0.4 + (F.col("b") + 38) / 9).alias("p2"), *extra)


def originals(spark: SparkSession, d: str) -> DataFrame:
    return predictions(spark, d).groupBy("entity_id", "repeat", "fold", "label").agg(ev.mean9("p1").alias("p1"), ev.mean9("p2").alias("p2"))


@query
def panel_aggregates_14(s, d):
    """The flagship: NDVI of every entity and its 14 gap-aware statistics over the year."""
    c = ft.with_channels(panel(s, d), "entity_id", "month")
    return rounded(ft.aggregates(ft.long_channels(c, ["entity_id"], "month", ["optical__ndvi"]), ["entity_id"]))


@query
def panel_long(s, d):
    return rounded(obs(s, d))


@query
def panel_wide(s, d):
    return rounded(pn.to_wide(obs(s, d), ["entity_id"], pn.BANDS))


@query
def panel_unpivot(s, d):
    return rounded(pn.to_long(pn.to_wide(obs(s, d), ["entity_id"], pn.BANDS), ["entity_id"], pn.BANDS))


def _wide_columns():
    return [f"{b}_{m:02d}" for m in pn.MONTHS for b in pn.BANDS]


@query
def sentinel_counts(s, d):
    return pn.sentinel_counts(pn.to_wide(obs(s, d), ["entity_id"], pn.BANDS), _wide_columns())


@query
def schema_checks(s, d):
    wide = pn.to_wide(obs(s, d), ["entity_id"], pn.BANDS).join(labels(s, d), "entity_id")
    return pn.check(wide, "entity_id", "label", _wide_columns())


@query
def availability_by_month(s, d):
    return pn.availability(panel(s, d))


@query
def missingness_sets(s, d):
    return pn.missingness(panel(s, d))


@query
def observed_windows(s, d):
    return pn.observed_windows(panel(s, d), "entity_id")


@query
def window_distributions(s, d):
    return pn.distributions(pn.observed_windows(panel(s, d), "entity_id"))


@query
def mask_library(s, d):
    return pn.mask_library(pn.observed_windows(panel(s, d), "entity_id"))


@query
def windows_24(s, d):
    return ft.windows(s)


@query
def views_exhaustive(s, d):
    return views(s, d).groupBy("entity_id", "window_id", "window_length", "window_start").agg(F.count("VV").alias("radar_months"), F.count(F.when(pn.all_valid(pn.OPTICAL), 1)).alias("optical_months"), F.count(F.when(F.col("VV").isNotNull() & ~pn.all_valid(pn.OPTICAL), 1)).alias("gaps"))


@query
def views_sampled(s, d):
    w = pn.observed_windows(panel(s, d), "entity_id")
    return pn.sampled_masks(labels(s, d), "entity_id", pn.mask_library(w))


@query
def views_dropout(s, d):
    """Months that stay in each window after 10 % dropout, by hash."""
    from gapseries.functions import uniform

    v = views(s, d)
    return v.filter(uniform(F.lit("drop"), "window_id", "month") >= 0.1).groupBy("window_id").agg(F.count("*").alias("kept_months"), F.count("VV").alias("radar_months"))


@query
def channels_32(s, d):
    return rounded(ft.with_channels(panel(s, d), "entity_id", "month").select("entity_id", "month", *ft.channel_names()))


@query
def safe_divide_edges(s, d):
    rows = s.createDataFrame([(0, 1.0, 0.0), (1, 1.0, 1e-7), (2, 1.0, -2.0), (3, None, 1.0), (4, 1e308, 0.5), (5, 4.0, -2.0)], "i int, a double, b double")
    return rows.select("i", safe_divide(F.col("a"), F.col("b")).alias("q"))


def arrays(spark: SparkSession, d: str) -> DataFrame:
    return ft.channel_arrays(panel(spark, d), "entity_id")


@query
def window_aggregates(s, d):
    """14 statistics of all 32 channels for every view."""
    return ft.window_statistics(arrays(s, d), "entity_id", near_cells)


@query
def aggregates_all_channels(s, d):
    """14 statistics of all 32 channels over the year."""
    return ft.monthly_statistics(arrays(s, d), "entity_id", near_cells)


@query
def mean_abs_difference(s, d):
    names = {f"radar__{b}__mean_abs_first_difference": f"{b}_mean_abs_first_difference" for b in ("vv", "vh")}
    return sel.matrix(arrays(s, d), "entity_id", [*names], near_cells).drop("entity_id").withColumnsRenamed(names)


@query
def metadata_46(s, d):
    return rounded(ft.metadata(views(s, d), "entity_id"))


@query
def relative_positions_wide(s, d):
    names = [f"relative__position_{k:02d}__{n}" for k in range(1, sel.POSITIONS + 1) for n in ft.channel_names()]
    return sel.matrix(arrays(s, d), "entity_id", names, near_cells).drop("entity_id")


@query
def sequence_arrays(s, d):
    """values, mask and padding of every channel of every window."""
    return ft.window_sequences(arrays(s, d), "entity_id", shown=near)


@query
def folds_repeated(s, d):
    return ev.folds(labels(s, d), "entity_id", "label", 5, 3)


@query
def fold_balance(s, d):
    return ev.fold_balance(ev.folds(labels(s, d), "entity_id", "label", 5, 3), "label")


@query
def fold_leaks(s, d):
    return ev.leaks(ev.folds(labels(s, d), "entity_id", "label", 5, 3), "entity_id")


@query
def sample_weights(s, d):
    p = predictions(s, d).filter("repeat = 0")  # weights do not depend on the repeat
    return rounded(ev.weights(p, "entity_id", "label").select("entity_id", "window_length", "window_start", "equal_weight", "class_weight"))


@query
def oof_aggregation(s, d):
    return rounded(predictions(s, d).groupBy("repeat", "entity_id").agg(*[ev.combine("p1", h).alias(h) for h in ("mean", "median", "logit_mean", "trimmed_mean")]), 5)


@query
def stability(s, d):
    return rounded(ev.stability(predictions(s, d), ["repeat", "entity_id"], "p1", "label"), 5)


@query
def metrics_repeat(s, d):
    return rounded(ev.metrics(originals(s, d), ["repeat"], "p1", "label"))


@query
def metrics_repeat_fold(s, d):
    return rounded(ev.metrics(originals(s, d), ["repeat", "fold"], "p1", "label"))


@query
def slice_metrics(s, d):
    return rounded(ev.slice_metrics(predictions(s, d), ["repeat"], "entity_id", "p1", "label"))


@query
def robust_score(s, d):
    return rounded(ev.robust_of_levels(ev.level_metrics(predictions(s, d), ["repeat"], "entity_id", "p1", "label")))


@query
def level_metrics(s, d):
    """Metrics by repeat, by fold and by every slice, out of one scan of the predictions."""
    return rounded(ev.level_metrics(predictions(s, d), ["repeat"], "entity_id", "p1", "label"))


@query
def pairwise_diversity(s, d):
    return rounded(ev.pairwise(originals(s, d), "p1", "p2", "label", ["repeat"]))


@query
def blend_grid(s, d):
    return rounded(ev.blend_grid(originals(s, d), ["repeat"], "p1", "p2", "label"))


@query
def nested_weights(s, d):
    """For each repeat and fold the weight that is best on the repeat's other folds."""
    from gapseries.operators import choice
    from gapseries.sources.stored import materialize

    w = choice.nested(materialize(originals(s, d), "originals"), "repeat", "fold", "p1", "p2", "label")
    return rounded(w.select("repeat", "fold", "weight", F.col("training_f1").alias("f1"), F.col("training_brier").alias("brier")))


@query
def calibration_apply(s, d):
    p = F.col("p1")
    return rounded(originals(s, d).select("entity_id", "repeat", ev.calibrate(p, "sigmoid", 1.2, c=-0.1).alias("p_sigmoid"), ev.calibrate(p, "beta", 1.1, 0.9, 0.05).alias("p_beta")))


@query
def expected_calibration_error(s, d):
    return rounded(ev.calibration_error(originals(s, d), "p1", "label"))


@query
def prior_shift(s, d):
    """The positive rate that EM settles at, from the out-of-fold scores of every repeat."""
    o = originals(s, d).select("p1").persist()
    rate = ev.prior_shift(o, "p1", 0.5)
    o.unpersist()
    return s.range(1).select(F.round(F.lit(rate), 6).alias("positive_rate"))


def _domains(s, d):
    x = panel(s, d).select((F.col("entity_id") % 10000 >= 2001).cast("int").alias("domain"), *pn.BANDS)
    cells = F.array(*[F.struct(F.lit(c).alias("feature"), near(c).alias("x")) for c in pn.BANDS])
    return x.select("domain", F.explode(cells).alias("c")).select("domain", "c.*")


@query
def ks_wasserstein(s, d):
    return rounded(ev.ecdf_shift(_domains(s, d), ["feature"], "x", "domain"), 5)


@query
def psi(s, d):
    return rounded(ev.psi(_domains(s, d), ["feature"], "x", "domain"), 5)


@query
def density_weights(s, d):
    return rounded(ev.density_weights(originals(s, d).select("entity_id", "repeat", "p1"), "p1").drop("p1"), 4)


@query
def similarity_holdout(s, d):
    return ev.similarity_holdout(originals(s, d).filter("repeat = 0").select("entity_id", "label", "p2"), "entity_id", "p2", "label").select("entity_id", "label", "rank")


@query
def submission(s, d):
    return rounded(ev.submission(originals(s, d).filter("repeat = 0"), "entity_id", "p1"))


@query
def uncertainty(s, d):
    o = originals(s, d).withColumn("run", F.concat_ws(":", "entity_id", "repeat"))
    return rounded(ev.uncertainty(o, "run", "p1", "p2"), 5)


def _model_rows(s, d):
    x = obs(s, d).groupBy("entity_id").agg(*[F.avg(b).alias(b) for b in pn.BANDS])
    return x.join(ev.folds(labels(s, d), "entity_id", "label").select("entity_id", "label", "fold"), "entity_id")


MODEL_FEATURES = list(pn.BANDS)


@query
def logistic_out_of_fold(s, d):
    from gapseries.operators import models

    return models.out_of_fold(_model_rows(s, d), MODEL_FEATURES, "label", "fold").select("entity_id", "fold", "label", "p")


@query
def adversarial_auc(s, d):
    """How well early and late entities can be told apart."""
    from gapseries.operators import models

    rows = _model_rows(s, d).withColumn("domain", (F.col("entity_id") % 10000 >= 2001).cast("int"))
    return rounded(ev.metrics(models.out_of_fold(rows, MODEL_FEATURES, "domain", "fold").withColumn("all", F.lit(1)), ["all"], "p", "domain"))


@query
def cluster_balance(s, d):
    from gapseries.operators import models

    c = models.clusters(models.packed(_model_rows(s, d), "entity_id"), MODEL_FEATURES)
    return rounded(c.groupBy("cluster").agg(F.count("*").alias("n"), F.sum("label").alias("positives"), F.avg("label").alias("rate")))


@query
def cluster_holdouts(s, d):
    """Size and label balance of clusters, made anew for every held-out fold from the rows outside it."""
    from functools import reduce

    from gapseries.operators import models

    rows = models.packed(_model_rows(s, d), "entity_id")
    parts = [models.cluster_holdout(rows, "entity_id", MODEL_FEATURES, "fold", f, least=3) for f in range(5)]
    made = reduce(DataFrame.unionByName, parts).groupBy("outer_fold", "cluster").agg(F.count("*").alias("n"), F.sum("label").alias("positives"), F.avg("label").alias("rate"))
    return rounded(made)


@query
def permutation_importance(s, d):
    from gapseries.operators import models

    return rounded(models.permutation_importance(_model_rows(s, d), MODEL_FEATURES, "label", "fold", "entity_id"))


@query
def event_windows(s, d):
    """The streaming aggregation over the events as a batch table."""
    from gapseries.streaming import event_windows as windows

    e = s.read.parquet(f"{d}/events.parquet")
    w = windows(e)
    return rounded(w.withColumn("window_start", F.unix_timestamp("window_start")), 4)


@query
def fold_labels_documents(s, d):
    """Stratified folds over the labelled documents, and their balance."""
    lab = s.read.parquet(f"{d}/labels.parquet").select("doc_id", "quality")
    return ev.fold_balance(ev.folds(lab, "doc_id", "quality", 5, 2), "quality")
