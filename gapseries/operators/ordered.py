"""Order in whole groups without ordering a group in one task: ranges of values, running sums over them, exact quantiles.

Ranges are a function of the value and of exact figures of its group (counts, least and greatest), so every plan that needs them twice gets
the same ones, also when a task is run again. Their number follows the data: there are 4096 for every halving of the distance to zero
(for scores, to the nearer end of [0, 1]), and what is still crowded is cut again by its own ends."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Cells for each halving, and distinct values in a cell beyond which it is cut into PIECES of equal width.
BITS, CROWDED, PIECES = 12, 1 << 16, 1 << 12


def cell(x: Column, bits: int = BITS) -> Column:
    """A long that never falls as x grows: 2^bits for each power of two, by the exponent and the share of the way to the next."""
    a = F.abs(x)
    e = F.floor(F.log2(a))
    place = F.floor((e + a / F.pow(F.lit(2.0), e) + 1200) * (1 << bits))
    return F.when(x == 0, F.lit(0).cast("long")).otherwise((F.signum(x) * place).cast("long"))


def score_cell(p: Column, bits: int = BITS) -> Column:
    """The same for scores in [0, 1], fine towards both ends."""
    return F.when(p <= 0.5, cell(p, bits)).otherwise(F.lit(2400 << bits).cast("long") - cell(1 - p, bits))


def with_ranges(by: DataFrame, keys: list[str], x: str) -> DataFrame:
    """by (a row for each distinct x of a group) with range: a struct that orders as x does. A cell with over CROWDED rows is cut."""
    r = by.withColumn("_cell", cell(F.col(x)))
    crowded = r.groupBy(*keys, "_cell").agg(F.count("*").alias("_n"), F.min(x).alias("_lo"), F.max(x).alias("_hi")).filter(F.col("_n") > CROWDED).drop("_n")
    # Half of each, so that distances stay finite.
    piece = F.floor((F.col(x) / 2 - F.col("_lo") / 2) / (F.col("_hi") / 2 - F.col("_lo") / 2) * (PIECES - 1)).cast("int")
    cut = r.join(crowded, [*keys, "_cell"], "left").withColumn("_piece", F.when(F.col("_lo") < F.col("_hi"), piece).otherwise(0))
    return cut.withColumn("range", F.struct("_cell", "_piece")).drop("_cell", "_piece", "_lo", "_hi")


def running(by: DataFrame, keys: list[str], x: str, sums: list[str], ranges: Column | None = None) -> DataFrame:
    """by (a row for each distinct x of a group) with before_<c> and all_<c>: the sums of c over the group's smaller x, and over all.

    Within ranges by a window, then from a table of the ranges' sums, which is joined by range. ranges: a column to use for them."""
    r = with_ranges(by, keys, x) if ranges is None else by.withColumn("range", ranges)
    inside = Window.partitionBy(*keys, "range").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    upto = Window.partitionBy(*keys).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = r.groupBy(*keys, "range").agg(*[F.sum(c).alias(c) for c in sums])
    every = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(0))
    sizes = sizes.select(*keys, "range", *[F.coalesce(F.sum(c).over(upto), F.lit(0)).alias(f"_b{i}") for i, c in enumerate(sums)], *[F.sum(c).over(every).alias(f"all_{c}") for c in sums])
    r = r.withColumns({f"before_{c}": F.coalesce(F.sum(c).over(inside), F.lit(0)) for c in sums}).join(sizes, [*keys, "range"])
    return r.withColumns({f"before_{c}": F.col(f"before_{c}") + F.col(f"_b{i}") for i, c in enumerate(sums)}).drop("range", *[f"_b{i}" for i in range(len(sums))])


def quantiles(rows: DataFrame, keys: list[str], x: str, probs: list[float]) -> DataFrame:
    """keys, quantiles: an array with the exact quantile (between two values in proportion) of x for each of probs; nulls do not count.

    Selection: values are counted by range, each wanted rank is found in the table of the ranges' counts, and only the ranges that hold
    one are ordered, each on its own. No aggregation buffer grows with the number of values."""
    own = keys or ["_all"]
    rows = rows if keys else rows.withColumn("_all", F.lit(0))
    by = rows.filter(F.col(x).isNotNull()).groupBy(*own, F.col(x).cast("double").alias("_x")).agg(F.count("*").alias("_c"))
    return quantiles_of_counts(by, own, "_x", "_c", probs).select(*keys, "quantiles")


def quantiles_of_counts(by: DataFrame, own: list[str], x: str, c: str, probs: list[float]) -> DataFrame:
    """quantiles, from a row for each distinct x of a group with how often it occurs."""
    by = by.select(*own, F.col(x).alias("_x"), F.col(c).alias("_c")).filter("_c > 0")
    r = with_ranges(by, own, "_x")
    w = Window.partitionBy(*own)
    table = r.groupBy(*own, "range").agg(F.sum("_c").alias("_s"))
    table = table.withColumns({"_before": F.coalesce(F.sum("_s").over(w.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)), "_n": F.sum("_s").over(w)})
    asked = F.explode(F.array(*[F.struct(F.lit(i).alias("_i"), F.lit(float(q)).alias("_q")) for i, q in enumerate(probs)]))
    want = table.select("*", asked.alias("_a")).select(*own, "range", "_s", "_before", "_n", "_a.*").withColumn("_at", (F.col("_n") - 1) * F.col("_q"))
    low = F.floor("_at")
    want = want.withColumns({"_share": F.col("_at") - low, "_low": low}).withColumn("_rank", F.explode(F.array(F.col("_low"), F.least(F.col("_low") + 1, F.col("_n") - 1))))
    want = want.filter((F.col("_rank") >= F.col("_before")) & (F.col("_rank") < F.col("_before") + F.col("_s"))).select(*own, "range", "_i", "_share", "_low", "_rank", "_before").distinct()
    some = r.join(want.select(*own, "range").distinct(), [*own, "range"], "left_semi")
    upto = Window.partitionBy(*own, "range").orderBy("_x").rowsBetween(Window.unboundedPreceding, -1)
    some = some.withColumn("_u", F.coalesce(F.sum("_c").over(upto), F.lit(0)))
    at = F.col("_rank") - F.col("_before")
    hit = some.join(want, [*own, "range"]).filter((at >= F.col("_u")) & (at < F.col("_u") + F.col("_c")))
    lo, hi = F.max(F.when(F.col("_rank") == F.col("_low"), F.col("_x"))), F.max(F.when(F.col("_rank") > F.col("_low"), F.col("_x")))
    share = F.max("_share")
    each = hit.groupBy(*own, "_i").agg(F.when(share > 0, lo * (1 - share) + hi * share).otherwise(lo).alias("_v"))
    out = each.groupBy(*own).agg(F.transform(F.array_sort(F.collect_list(F.struct("_i", "_v"))), lambda e: e["_v"]).alias("quantiles"))
    return out.select(*own, "quantiles")


def ranked(rows: DataFrame, groups: list[str], x: str, tie: str, name: str, ranges: Column, descending: bool = False) -> DataFrame:
    """rows with name: the place from 1 by x, then by tie, in each group; ranges as in running, of the first order."""
    r = rows.withColumn("_range", -ranges if descending else ranges)
    order = [F.col(x).desc() if descending else F.col(x), F.col(tie)]
    before = Window.partitionBy(*groups).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = r.groupBy(*groups, "_range").count().select(*groups, "_range", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_before"))
    at = F.row_number().over(Window.partitionBy(*groups, "_range").orderBy(*order))
    return r.withColumn("_at", at).join(sizes, [*groups, "_range"]).withColumn(name, (F.col("_at") + F.col("_before")).cast("long")).drop("_range", "_at", "_before")


def one_label(entities: DataFrame, key: str, label: str) -> DataFrame:
    """key, label, each key once; a key with two labels, or none, is an error when its row is computed."""
    kind = entities.schema[label].dataType
    bad = F.col("_lo").isNull() | (F.col("_lo") != F.col("_hi")) | (F.col("_n") < F.col("_all"))
    said = F.raise_error(F.concat(F.lit(f"{label} is not one value for {key} "), F.col(key).cast("string"))).cast(kind)
    g = entities.groupBy(key).agg(F.min(label).alias("_lo"), F.max(label).alias("_hi"), F.count(label).alias("_n"), F.count("*").alias("_all"))
    return g.select(key, F.when(bad, said).otherwise(F.col("_lo")).alias(label))


def checked(rows: DataFrame, p: str, label: str) -> DataFrame:
    """rows; a score that is null, NaN or outside [0, 1], or a label other than 0 and 1, is an error when its row is computed."""
    bad_p = reduce(lambda a, b: a | b, [F.col(p).isNull(), F.isnan(p), ~F.col(p).between(0, 1)])
    said = lambda c, what, kind: F.raise_error(F.concat(F.lit(what), F.coalesce(F.col(c).cast("string"), F.lit("null")))).cast(kind)
    bad_y = F.col(label).isNull() | ~F.col(label).isin(0, 1)
    return rows.withColumns({
        p: F.when(bad_p, said(p, "scores must be finite and within [0, 1]: ", "double")).otherwise(F.col(p)),
        label: F.when(bad_y, said(label, "labels must be 0 or 1: ", rows.schema[label].dataType)).otherwise(F.col(label)),
    })
