"""Folds, weights, out-of-fold tables, metrics, slices, diversity, blends, calibration and shift statistics."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapseries.functions import clip, logit, season, sigmoid, uniform
from gapseries.sources.stored import spread

from . import ordered

MACHINE_EPSILON = 2.220446049250313e-16


def mean9(p: str) -> Column:
    """Mean of scores to nine digits, so that what ties in one engine ties in another (F.round goes through decimals, which takes longer)."""
    return F.rint((F.avg(p) + 1e-12) * 1e9) / 1e9


def folds(entities: DataFrame, key: str, label: str, n_folds: int = 5, repeats: int = 1, seed: int = 42) -> DataFrame:
    """key, label, repeat, fold: stratified, one fold for each key and repeat; seeds are seed + 10007 * repeat. A key with two labels,
    or with a null one, is an error when its row is computed."""
    each = ordered.one_label(entities, key, label).select("*", F.explode(F.sequence(F.lit(0), F.lit(repeats - 1))).alias("repeat"))
    each = each.withColumn("u", uniform(F.lit(seed) + 10007 * F.col("repeat"), key))
    # Equal shares of each label by rank; u is spread evenly, so ranges of equal width hold like numbers.
    at = ordered.ranked(each, ["repeat", label], "u", key, "i", F.floor(F.col("u") * 4096))
    return at.select(key, label, "repeat", ((F.col("i") - 1) % n_folds).cast("int").alias("fold"))


def fold_balance(assigned: DataFrame, label: str) -> DataFrame:
    """Per repeat and fold: validation and training counts, positives and rates."""
    g = assigned.groupBy("repeat", "fold").agg(F.count("*").alias("validation_n"), F.sum(F.col(label).cast("long")).alias("validation_positives"))
    w = Window.partitionBy("repeat")
    return g.select("repeat", "fold", "validation_n", "validation_positives", (F.sum("validation_n").over(w) - F.col("validation_n")).alias("train_n"), (F.sum("validation_positives").over(w) - F.col("validation_positives")).alias("train_positives"))


def leaks(assigned: DataFrame, key: str) -> DataFrame:
    """Keys with more than one fold in a repeat; must be empty."""
    return assigned.groupBy("repeat", key).agg(F.count_distinct("fold").alias("folds")).filter("folds > 1")


def weights(rows: DataFrame, key: str, label: str) -> DataFrame:
    """equal_weight: 1 / rows of the key. class_weight: N / (2 n_c) over distinct keys."""
    classes = rows.select(key, label).distinct().groupBy(label).count()
    total = classes.agg(F.sum("count").alias("total"))
    per = classes.crossJoin(total).select(label, (F.col("total") / (2 * F.col("count"))).alias("class_weight"))
    size = rows.groupBy(key).agg(F.count("*").alias("n"))
    return rows.join(size, key).join(F.broadcast(per), label).withColumn("equal_weight", 1 / F.col("n")).drop("n")


def combine(p: str, how: str, trim: float = 0.25) -> Column:
    """Probability of a group of views: mean, median, logit_mean or trimmed_mean."""
    if how == "mean":
        return F.avg(p)
    if how == "median":
        return F.percentile(F.col(p), F.lit(0.5))
    if how == "logit_mean":
        return sigmoid(F.avg(logit(F.col(p))))
    if how != "trimmed_mean":
        raise ValueError(how)
    ordered = F.sort_array(F.collect_list(p))
    cut = F.floor(F.size(ordered) * trim).cast("int")
    kept = F.slice(ordered, cut + 1, F.size(ordered) - 2 * cut)
    return F.aggregate(kept, F.lit(0.0), lambda a, x: a + x) / F.size(kept)


def stability(windows: DataFrame, keys: list[str], p: str, label: str) -> DataFrame:
    """Per original: n, mean, population std, min, max, range, share predicted positive, instability, whether in error."""
    share = F.avg((F.col(p) >= 0.5).cast("double"))
    g = windows.groupBy(*keys, label).agg(F.count("*").alias("n"), F.avg(p).alias("p_mean"), F.stddev_pop(p).alias("p_std"), F.min(p).alias("p_min"), F.max(p).alias("p_max"), share.alias("share_positive"))
    return g.withColumns({"p_range": F.col("p_max") - F.col("p_min"), "instability": F.least("share_positive", 1 - F.col("share_positive")), "is_error": ((F.col("p_mean") >= 0.5).cast("int") != F.col(label)).cast("int")})


def metrics(rows: DataFrame, keys: list[str], p: str, label: str) -> DataFrame:
    """Per group: counts, tp, fp, fn, tn, f1, auc (ties count half; null for one class), combined, log_loss, brier, accuracy and
    positive_prediction_rate.

    A score that is null, NaN or outside [0, 1], or a label other than 0 and 1, is an error when its row is computed.

    The AUC needs each distinct score once: counts by score, then the negatives below, within ranges of the score (finer towards both
    ends) and then from a table of the ranges' sums, so no task orders a whole group."""
    rows = ordered.checked(rows, p, label)
    y, hit = F.col(label), F.col(p) >= 0.5
    q = clip(F.col(p), MACHINE_EPSILON, 1 - MACHINE_EPSILON)
    loss = F.sum(-F.when(y == 1, F.log(q)).otherwise(F.log(1 - q)))
    by = rows.groupBy(*keys, p).agg(F.sum(F.when(y == 1, 1).otherwise(0)).alias("pos"), F.sum(F.when(y == 0, 1).otherwise(0)).alias("neg"), loss.alias("ll"), F.sum((F.col(p) - y) ** 2).alias("br"))
    by = by.withColumn("range", ordered.score_cell(F.col(p))).withColumn("hit", hit)
    inside = Window.partitionBy(*keys, "range").orderBy(p).rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumn("below", F.coalesce(F.sum("neg").over(inside), F.lit(0)))
    n = lambda c, when: F.sum(F.when(when, F.col(c)).otherwise(0))
    r = by.groupBy(*keys, "range").agg(
        F.sum("pos").alias("pos"), F.sum("neg").alias("neg"), n("pos", F.col("hit")).alias("tp"), n("neg", F.col("hit")).alias("fp"), n("pos", ~F.col("hit")).alias("fn"), n("neg", ~F.col("hit")).alias("tn"),
        F.sum(F.col("pos") * (F.col("below") + F.col("neg") / 2)).alias("u"), F.sum("ll").alias("ll"), F.sum("br").alias("br"),
    )
    before = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    r = r.withColumn("u", F.col("u") + F.col("pos") * F.coalesce(F.sum("neg").over(before), F.lit(0)))
    g = r.groupBy(*keys).agg(F.sum(F.col("pos") + F.col("neg")).alias("n"), F.sum("pos").alias("positives"), *[F.sum(c).alias(c) for c in ("tp", "fp", "fn", "tn")], F.sum("u").alias("_u"), F.sum("ll").alias("_ll"), F.sum("br").alias("_br"))
    down = 2 * F.col("tp") + F.col("fp") + F.col("fn")
    pairs = F.col("positives") * (F.col("n") - F.col("positives"))
    g = g.withColumn("f1", F.when(down > 0, 2 * F.col("tp") / down).otherwise(F.lit(0.0))).withColumn("auc", F.when(pairs > 0, F.col("_u") / pairs))
    g = g.withColumns({"combined": 0.6 * F.col("f1") + 0.4 * F.col("auc"), "log_loss": F.col("_ll") / F.col("n"), "brier": F.col("_br") / F.col("n")})
    return g.withColumns({"accuracy": (F.col("tp") + F.col("tn")) / F.col("n"), "positive_prediction_rate": (F.col("tp") + F.col("fp")) / F.col("n")}).drop("_u", "_ll", "_br")


def calibration_error(rows: DataFrame, p: str, label: str, bins: int = 15, keys: list[str] | None = None) -> DataFrame:
    """ece, by keys: sum over equal-width bins of share * |mean p - rate|; p = 1 goes to the last bin."""
    keys = keys or []
    b = F.least(F.floor(F.col(p) * bins), F.lit(bins - 1))
    g = rows.groupBy(*keys, b.alias("bin")).agg(F.count("*").alias("n"), F.avg(p).alias("m"), F.avg(F.col(label).cast("double")).alias("r"))
    return g.groupBy(*keys).agg((F.sum(F.col("n") * F.abs(F.col("m") - F.col("r"))) / F.sum("n")).alias("ece"))


def slices() -> Column:
    """Array of (slice_group, slice_value) that a window row belongs to; slices overlap. Needs window_length, window_start,
    gaps, radar_months, optical_months."""
    c = F.col
    share = c("optical_months") / c("window_length")
    one = lambda group, value: F.struct(F.lit(group).alias("slice_group"), value.alias("slice_value"))
    maybe = lambda group, when, value: F.when(when, one(group, F.lit(value)))
    return F.array_compact(F.array(
        one("window_length", c("window_length").cast("string")), one("start_month", c("window_start").cast("string")), one("season", season(c("window_start"))),
        one("optical_gaps", F.when(c("gaps") == 0, "0").when(c("gaps") == 1, "1").otherwise("2+")),
        one("optical_proportion", F.when(share < 0.5, "lt50").when(share < 0.8, "50to80").when(share < 1, "80to100").otherwise("100")),
        maybe("availability", c("radar_months") == c("window_length"), "radar_complete"), maybe("availability", c("optical_months") == c("window_length"), "optical_complete"),
        maybe("availability", c("optical_months") == 0, "radar_only"), maybe("availability", share < 0.5, "severely_limited"),
    ))


#: Slice groups by number, and the names of their values where those are no numbers themselves; then the levels above slices.
SLICES = (
    ("window_length", None), ("start_month", None), ("season", ("01-03", "04-06", "07-09")), ("optical_gaps", ("0", "1", "2+")), ("optical_proportion", ("lt50", "50to80", "80to100", "100")),
    ("availability", ("radar_complete", "optical_complete", "radar_only", "severely_limited")), ("repeat", ("all",)), ("fold", None),
)
WHOLE, FOLD = 6, 7


def slice_code(kind: int, place: Column) -> Column:
    """A long that stands for a value of the group with this place in SLICES: the value (from 0; null is -1), or its name's place there."""
    return F.coalesce(place.cast("long"), F.lit(-1).cast("long")) * len(SLICES) + kind


def slice_codes() -> Column:
    """slices() as an array of codes, null where a window is not in a slice: grouping by them takes far less than by text, and neither they
    nor the array need anything that is not compiled."""
    c = F.col
    share = c("optical_months") / c("window_length")
    of = lambda *when: reduce(lambda e, x: e.when(x[1], F.lit(x[0])), enumerate(when[1:], 1), F.when(when[0], F.lit(0))).otherwise(F.lit(len(when)))
    available = (c("radar_months") == c("window_length"), c("optical_months") == c("window_length"), c("optical_months") == 0, share < 0.5)
    return F.array(
        slice_code(0, c("window_length")), slice_code(1, c("window_start")), slice_code(2, of(c("window_start") <= 3, c("window_start") <= 6)), slice_code(3, of(c("gaps") == 0, c("gaps") == 1)),
        slice_code(4, of(share < 0.5, share < 0.8, share < 1)), *[F.when(when, slice_code(5, F.lit(i))) for i, when in enumerate(available)],
    )


def slice_names(code: Column) -> tuple[Column, Column]:
    """The group and the value that a code stands for."""
    kind = F.pmod(code, F.lit(len(SLICES))).cast("int")
    place = ((code - kind) / len(SLICES)).cast("int")
    names = F.array(*[F.array(*map(F.lit, values or ("",))) for _, values in SLICES])
    plain = kind.isin([i for i, (_, values) in enumerate(SLICES) if not values])
    value = F.when(plain, place.cast("string")).otherwise(F.get(F.get(names, kind), place))
    return F.get(F.array(*[F.lit(group) for group, _ in SLICES]), kind), F.when(place >= 0, value)


def slice_metrics(windows: DataFrame, keys: list[str], original: str, p: str, label: str) -> DataFrame:
    """Windows are sliced first, then averaged to originals within the slice, then scored: one explode, no loop over slices."""
    s = windows.select(*keys, original, label, p, F.explode(slices()).alias("s")).select(*keys, original, label, p, "s.*")
    g = s.groupBy(*keys, "slice_group", "slice_value", original, label).agg(mean9(p).alias("p"))
    return metrics(g, [*keys, "slice_group", "slice_value"], "p", label)


def level_metrics(windows: DataFrame, keys: list[str], original: str, p: str, label: str) -> DataFrame:
    """keys, level (repeat, fold or a slice group), value and the metrics of originals: all levels in one pass over the windows.

    Each window becomes a row for itself and one for each slice it is in (ten at most), by number; their means by original are then scored in one
    aggregation, the whole ones a second time by fold. An original with two folds is an error when its row is computed."""
    return level_metrics_of(windows, keys, original, label, [((), p)])


def level_metrics_of(windows: DataFrame, keys: list[str], original: str, label: str, scores: list[tuple[tuple[Column, ...], str]]) -> DataFrame:
    """level_metrics of several scores of the same windows, each given as the columns that name it and its own column. The names come before
    keys. Windows are sliced and averaged once for all scores, which become rows of their own only by original."""
    whole = slice_code(WHOLE, F.lit(0))
    s = windows.select(*keys, original, label, "fold", *[p for _, p in scores], F.explode(F.concat(F.array(whole), slice_codes())).alias("_code")).filter("_code is not null")
    two = F.raise_error(F.concat(F.lit("in two folds: "), F.min(F.col(original).cast("string")))).cast("int")
    means = [mean9(p).alias(f"_p{i}") for i, (_, p) in enumerate(scores)]
    g = s.groupBy(*keys, "_code", original, label).agg(*means, F.when(F.min("fold") == F.max("fold"), F.min("fold")).otherwise(two).alias("fold"))
    levels = F.when(F.col("_code") == whole, F.array(F.col("_code"), slice_code(FOLD, F.col("fold")))).otherwise(F.array("_code"))
    each = F.explode(F.array(*[F.struct(*names, F.col(f"_p{i}").alias("_p")) for i, (names, _) in enumerate(scores)]))
    m = g.select(*keys, label, *[f"_p{i}" for i in range(len(scores))], F.explode(levels).alias("_code")).select(*keys, label, "_code", each.alias("_s")).select(*keys, label, "_code", "_s.*")
    own = [*[c for c in m.columns if c not in (*keys, label, "_code", "_p")], *keys]
    scored = metrics(m, [*own, "_code"], "_p", label)
    level, value = slice_names(F.col("_code"))
    return scored.select(*own, level.alias("level"), value.alias("value"), *[c for c in scored.columns if c not in (*own, "_code")])


def robust_of_levels(levels: DataFrame, keys: list[str] | None = None) -> DataFrame:
    """keys and robust's columns from the rows of level_metrics, in one pass over them."""
    keys = keys or []
    used = levels.filter(F.col("level").isin("repeat", "fold", "window_length", "season"))
    said = F.raise_error(F.concat(F.col("level"), F.lit(": combined is undefined"))).cast("double")
    used = used.withColumn("combined", F.coalesce("combined", said))
    # Slices are averaged over repeats; repeats and folds stay apart.
    m = used.groupBy(*keys, "level", "value").agg(F.avg("combined").alias("m"), F.min("combined").alias("least"), F.sum("combined").alias("s"), F.count("*").alias("n"))
    at = lambda level, c: F.when(F.col("level") == level, F.col(c))
    lengths = F.array_sort(F.collect_set(at("window_length", "value")))
    wrong = F.when(lengths != F.array(F.lit("4"), F.lit("5"), F.lit("6")), F.raise_error(F.lit("window lengths must be 4, 5 and 6"))).cast("double")
    g = m.groupBy(*keys).agg((F.sum(at("repeat", "s")) / F.sum(at("repeat", "n"))).alias("repeat_mean"), F.min(at("fold", "least")).alias("worst_fold"), F.coalesce(wrong, F.min(at("window_length", "m"))).alias("worst_length"), F.min(at("season", "m")).alias("worst_season"))
    score = 0.5 * F.col("repeat_mean") + 0.2 * F.col("worst_fold") + 0.15 * F.col("worst_length") + 0.15 * F.col("worst_season")
    return g.withColumn("robust", F.coalesce(score, F.raise_error(F.lit("a component is undefined")).cast("double")))


def robust(by_repeat: DataFrame, by_fold: DataFrame, by_slice: DataFrame) -> DataFrame:
    """.5 mean over repeats + .2 worst fold + .15 worst mean by length + .15 worst mean by season, of combined.

    An undefined component, or window lengths other than 4, 5 and 6, is an error when the row is computed."""
    strict = lambda name: F.when(F.count("combined") < F.count("*"), F.raise_error(F.lit(f"{name}: combined is undefined")))
    a = by_repeat.agg(F.coalesce(strict("repeat").cast("double"), F.avg("combined")).alias("repeat_mean"))
    b = by_fold.agg(F.coalesce(strict("fold").cast("double"), F.min("combined")).alias("worst_fold"))
    m = by_slice.filter(F.col("slice_group").isin("window_length", "season")).groupBy("slice_group", "slice_value").agg(F.coalesce(strict("slice").cast("double"), F.avg("combined")).alias("m"))
    length = F.col("slice_group") == "window_length"
    lengths = F.array_sort(F.collect_set(F.when(length, F.col("slice_value"))))
    wrong = F.when(lengths != F.array(F.lit("4"), F.lit("5"), F.lit("6")), F.raise_error(F.lit("window lengths must be 4, 5 and 6")))
    worst = m.agg(F.coalesce(wrong.cast("double"), F.min(F.when(length, F.col("m")))).alias("worst_length"), F.min(F.when(~length, F.col("m"))).alias("worst_season"))
    score = 0.5 * F.col("repeat_mean") + 0.2 * F.col("worst_fold") + 0.15 * F.col("worst_length") + 0.15 * F.col("worst_season")
    return a.crossJoin(b).crossJoin(worst).withColumn("robust", F.coalesce(score, F.raise_error(F.lit("a component is undefined")).cast("double")))


def correlation(a: Column, b: Column) -> Column:
    """Pearson's, null where a side does not vary (corr itself divides by zero)."""
    return F.try_divide(F.covar_pop(a, b), F.stddev_pop(a) * F.stddev_pop(b))


def average_ranks(rows: DataFrame, keys: list[str], p: str) -> DataFrame:
    """keys, p, rank: the mean rank of each distinct score within its group, by ranges of the score in [0, 1]."""
    by = rows.groupBy(*keys, p).agg(F.count("*").alias("c"))
    at = ordered.running(by, keys, p, ["c"], ordered.score_cell(F.col(p)))
    return at.select(*keys, p, (F.col("before_c") + (F.col("c") + 1) / 2).alias("rank"))


def pairwise(rows: DataFrame, p1: str, p2: str, label: str, keys: list[str] | None = None) -> DataFrame:
    """By keys: correlations of scores, ranks and residuals, disagreement (also among positives), what one alone gets right, unique
    true and false positives, shared errors and their Jaccard index (1 without errors)."""
    keys = keys or []
    y, a, b = F.col(label), F.col(p1), F.col(p2)
    up, vp = a >= 0.5, b >= 0.5
    ea, eb = (up.cast("int") != y), (vp.cast("int") != y)
    n = lambda c: F.count(F.when(c, 1))
    ranks = [average_ranks(rows, keys, p).withColumnRenamed("rank", f"_{p}") for p in (p1, p2)]
    rows = rows.join(ranks[0], [*keys, p1]).join(ranks[1], [*keys, p2])
    split = (up != vp).cast("double")
    g = rows.groupBy(*keys).agg(
        F.count("*").alias("n"), correlation(a, b).alias("pearson"), correlation(F.col(f"_{p1}"), F.col(f"_{p2}")).alias("spearman"), correlation(y - a, y - b).alias("residual_corr"),
        F.avg(split).alias("disagreement"), F.avg(F.when(y == 1, split)).alias("disagreement_positives"), n(~ea & eb).alias("only_first_correct"), n(ea & ~eb).alias("only_second_correct"),
        n((y == 1) & up & ~vp).alias("unique_tp_first"), n((y == 1) & vp & ~up).alias("unique_tp_second"), n((y == 0) & up & ~vp).alias("unique_fp_first"), n((y == 0) & vp & ~up).alias("unique_fp_second"),
        n(ea & eb).alias("shared_errors"), n(ea | eb).alias("any_error"),
    )
    return g.withColumn("error_jaccard", F.when(F.col("any_error") == 0, F.lit(1.0)).otherwise(F.col("shared_errors") / F.col("any_error")))


def blend_grid(rows: DataFrame, keys: list[str], p1: str, p2: str, label: str, step: float = 0.01) -> DataFrame:
    """Metrics of (1 - w) p1 + w p2 for w from 0 to 1: rows times a fixed grid, one aggregation. Rows are spread first, as a task counts all
    the scores that it makes before it deals them out."""
    k = round(1 / step)
    w = spread(rows.select(*keys, label, p1, p2), k + 1, "blended").select(*keys, label, p1, p2, F.explode(F.sequence(F.lit(0), F.lit(k))).alias("wi")).withColumn("p", F.round((k - F.col("wi")) / k * F.col(p1) + F.col("wi") / k * F.col(p2), 12))
    return metrics(w, [*keys, "wi"], "p", label).withColumn("weight", F.col("wi") / k)


def best_weight(grid: DataFrame, keys: list[str]) -> DataFrame:
    """By combined, then Brier, then nearness to one half, then log loss."""
    order = [F.round("combined", 9).desc(), F.round("brier", 9), F.abs(F.col("weight") - 0.5), F.round("log_loss", 9), F.col("weight")]
    if keys:
        return grid.withColumn("r", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).filter("r = 1").drop("r")
    return grid.orderBy(*order).limit(1)


def calibrate(p: Column, how: str, a: float = 1.0, b: float = 0.0, c: float = 0.0) -> Column:
    """none; sigmoid: of a logit(p) + c; beta: of a ln p - b ln(1 - p) + c; p clipped at 1e-6, logits at 40."""
    q = clip(p, 1e-6, 1 - 1e-6)
    return p if how == "none" else sigmoid(a * F.log(q / (1 - q)) + c) if how == "sigmoid" else sigmoid(a * F.log(q) - b * F.log(1 - q) + c)


def prior_shift(rows: DataFrame, p: str, train_rate: float, iterations: int = 100, tolerance: float = 1e-8) -> float:
    """EM estimate of the positive rate; one aggregate a step. No rows: the training rate."""
    rate = rows.agg(F.avg(p)).first()[0]
    if rate is None:
        return train_rate
    for _ in range(iterations):
        up, down = rate / train_rate, (1 - rate) / (1 - train_rate)
        new = rows.agg(F.avg(up * F.col(p) / (up * F.col(p) + down * (1 - F.col(p))))).first()[0]
        if abs(new - rate) < tolerance:
            return new
        rate = new
    return rate


def value_counts(long: DataFrame, keys: list[str], x: str, domain: str) -> DataFrame:
    """keys, x, a, b: how often each value occurs in domain 0 and in domain 1; what follows from it shares one shuffle of the rows."""
    n = lambda k: F.sum(F.when(F.col(domain) == k, 1).otherwise(0))
    return long.filter(F.col(x).isNotNull()).groupBy(*keys, F.col(x).cast("double").alias(x)).agg(n(0).alias("a"), n(1).alias("b"))


def ecdf_shift(long: DataFrame, keys: list[str], x: str, domain: str) -> DataFrame:
    """ks and wasserstein between domain 0 and 1 of each group: counts by value, running shares, gaps to the next value. Null where a
    domain has no value. Values are counted in ranges (see ordered), and joined by the table of the ranges' sums."""
    v = ordered.with_ranges(value_counts(long, keys, x, domain), keys, x)
    sums = v.groupBy(*keys, "range").agg(F.sum("a").alias("ra"), F.sum("b").alias("rb"), F.min(x).alias("least"))
    w = Window.partitionBy(*keys)
    run = w.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select(*keys, "range", *[F.coalesce(F.sum(c).over(run), F.lit(0)).alias(f"{c}_before") for c in ("ra", "rb")], *[F.sum(c).over(w).alias(f"{c}_all") for c in ("ra", "rb")], F.lead("least").over(w.orderBy("range")).alias("next"))
    inside = Window.partitionBy(*keys, "range").orderBy(x)
    upto = inside.rowsBetween(Window.unboundedPreceding, 0)
    v = v.withColumns({"a": F.sum("a").over(upto), "b": F.sum("b").over(upto), "after": F.lead(x).over(inside)}).join(sums, [*keys, "range"])
    d = F.abs(F.try_divide(F.col("a") + F.col("ra_before"), F.col("ra_all")) - F.try_divide(F.col("b") + F.col("rb_before"), F.col("rb_all")))
    v = v.withColumns({"d": d, "gap": F.coalesce("after", "next") - F.col(x)})
    return v.groupBy(*keys).agg(F.max("d").alias("ks"), F.sum(F.col("d") * F.coalesce("gap", F.lit(0.0))).alias("wasserstein"))


def psi(long: DataFrame, keys: list[str], x: str, domain: str, bins: int = 10) -> DataFrame:
    """Population stability over quantile bins of the pooled sample; fewer than three distinct edges: 0; a domain without values: null."""
    v = value_counts(long, keys, x, domain)
    edges = ordered.quantiles_of_counts(v.withColumn("c", F.col("a") + F.col("b")), keys, x, "c", [i / bins for i in range(bins + 1)]).withColumn("edges", F.array_distinct("quantiles")).drop("quantiles")
    inner = F.slice("edges", 2, F.greatest(F.size("edges") - 2, F.lit(0)))
    b = v.join(edges, keys).withColumn("bin", F.size(F.filter(inner, lambda e: e <= F.col(x))))
    g = b.groupBy(*keys, "bin", F.size("edges").alias("k")).agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    w = Window.partitionBy(*keys)
    total = {c: F.sum(c).over(w) for c in ("a", "b")}
    pa, pb = (F.when(total[c] > 0, F.greatest(F.try_divide(F.col(c), total[c]), F.lit(1e-6))) for c in ("a", "b"))
    t = g.withColumn("t", (pb - pa) * F.log(pb / pa))
    return t.groupBy(*keys).agg(F.when(F.count("t") > 0, F.when(F.max("k") < 3, F.lit(0.0)).otherwise(F.sum("t"))).alias("psi"))


def density_weights(rows: DataFrame, p: str, lo: float = 0.5, hi: float = 2.0) -> DataFrame:
    """weight: p / (1 - p) over its median, clipped, and whether it was."""
    q = clip(F.col(p), 1e-6, 1 - 1e-6)
    r = rows.withColumn("_r", q / (1 - q))
    median = ordered.quantiles(r, [], "_r", [0.5]).select(F.get("quantiles", F.lit(0)).alias("_m"))
    raw = F.col("_r") / F.col("_m")
    return r.crossJoin(F.broadcast(median)).withColumns({"weight": clip(raw, lo, hi), "clipped_low": raw < lo, "clipped_high": raw > hi}).drop("_r", "_m")


def similarity_holdout(rows: DataFrame, key: str, score: str, label: str, share: float = 0.2, least: int = 2) -> DataFrame:
    """The most similar share of the rows: score descending, then key. max(least, share of all, rounded up) rows in all; each class
    gives its part, rounded half to even, and the last class what is left. Scores lie in [0, 1]; ranks come from ranges of them."""
    classes = rows.groupBy(label).agg(F.count("*").alias("c"))
    every = Window.partitionBy(F.lit(0))
    want = F.least(F.greatest(F.lit(least), F.ceil(F.round(F.sum("c").over(every) * share, 9))), F.sum("c").over(every))
    part = F.bround(F.col("want") * F.col("c") / F.sum("c").over(every)).cast("long")
    quota = classes.withColumn("want", want).withColumn("part", part).withColumn("last", F.col(label) == F.max(label).over(every))
    others = F.sum(F.when(~F.col("last"), F.col("part")).otherwise(0)).over(every)
    quota = quota.select(label, F.when(F.col("last"), F.col("want") - others).otherwise(F.col("part")).alias("quota"))
    ranked = ordered.ranked(rows, [label], score, key, "rank", ordered.score_cell(F.col(score)), descending=True).withColumn("rank", F.col("rank").cast("int"))
    return ranked.join(F.broadcast(quota), label).filter("rank <= quota").drop("quota")


def submission(rows: DataFrame, key: str, p: str) -> DataFrame:
    return rows.select(F.col(key).alias("ID"), (F.col(p) >= 0.5).cast("int").alias("TargetF1"), F.col(p).alias("TargetRAUC"))


def uncertainty(rows: DataFrame, key: str, p1: str, p2: str) -> DataFrame:
    a, b = F.col(p1), F.col(p2)
    return rows.select(key, ((a + b) / 2).alias("p_mean"), (F.abs(a - b) / 2).alias("p_std"), F.least(a, b).alias("p_min"), F.greatest(a, b).alias("p_max"), ((a >= 0.5) != (b >= 0.5)).cast("int").alias("disagree"))
