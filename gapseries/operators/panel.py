"""Monthly panels: wide tables with a sentinel, long tables with nulls, their audit, masks and observed windows."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gapseries.functions import bits, uniform

SENTINEL = -9999.0
RADAR = ("VH", "VV")
OPTICAL = ("blue", "green", "nir", "nira", "re1", "re2", "re3", "red", "swir1", "swir2")
BANDS = RADAR + OPTICAL
MONTHS = range(1, 13)


def all_valid(columns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a & b, [F.col(c).isNotNull() for c in columns])


def any_valid(columns: tuple[str, ...]) -> Column:
    return reduce(lambda a, b: a | b, [F.col(c).isNotNull() for c in columns])


def to_wide(obs: DataFrame, keys: list[str], bands: tuple[str, ...] = BANDS, sentinel: float = SENTINEL) -> DataFrame:
    """One row for each key, a column <band>_<MM> for each band and month, month by month; missing cells hold the sentinel."""
    cells = [F.coalesce(F.max(F.when(F.col("month") == m, F.col(b))), F.lit(sentinel)).alias(f"{b}_{m:02d}") for m in MONTHS for b in bands]
    return obs.groupBy(*keys).agg(*cells)


def sentinel_to_null(wide: DataFrame, columns: list[str], sentinel: float = SENTINEL) -> DataFrame:
    return wide.withColumns({c: F.when(F.col(c).cast("double") != sentinel, F.col(c).cast("double")) for c in columns})


def sentinel_counts(wide: DataFrame, columns: list[str], sentinel: float = SENTINEL) -> DataFrame:
    """rows, cells, missing_cells, rows_with_missing in one pass."""
    missing = reduce(lambda a, b: a + b, [F.when(F.col(c) == sentinel, 1).otherwise(0) for c in columns])
    return wide.agg(F.count("*").alias("rows"), (F.count("*") * len(columns)).alias("cells"), F.coalesce(F.sum(missing), F.lit(0)).alias("missing_cells"), F.count(F.when(missing > 0, 1)).alias("rows_with_missing"))


def to_long(wide: DataFrame, keys: list[str], bands: tuple[str, ...] = BANDS, sentinel: float = SENTINEL) -> DataFrame:
    """The inverse of to_wide: keys, month and a column for each band, all twelve months, sentinel as null."""
    one = lambda c: F.when(F.col(c).cast("double") != sentinel, F.col(c).cast("double"))
    months = F.array(*[F.struct(F.lit(m).alias("month"), *[one(f"{b}_{m:02d}").alias(b) for b in bands]) for m in MONTHS])
    return wide.select(*keys, F.explode(months).alias("x")).select(*keys, "x.*")


def dense(obs: DataFrame, keys: list[str]) -> DataFrame:
    """All twelve months of every key; absent months as rows of nulls."""
    grid = obs.select(*keys).distinct().select("*", F.explode(F.sequence(F.lit(1), F.lit(12))).alias("month"))
    return grid.join(obs, [*keys, "month"], "left")


def check(wide: DataFrame, id_col: str, label_col: str | None, columns: list[str]) -> DataFrame:
    """Rows, null ids, repeated ids, NaN or infinite cells and labels outside {0, 1}, in one pass; all but rows must be 0."""
    bad = reduce(lambda a, b: a | b, [F.col(c).isNull() | F.isnan(c) | (F.abs(F.col(c)) == float("inf")) for c in columns])
    label = F.count(F.when(F.col(label_col).isNull() | ~F.col(label_col).isin(0, 1), 1)) if label_col else F.lit(0)
    return wide.agg(F.count("*").alias("rows"), F.count(F.when(F.col(id_col).isNull(), 1)).alias("null_ids"), (F.count(id_col) - F.count_distinct(id_col)).alias("repeated_ids"), F.count(F.when(bad, 1)).alias("bad_rows"), label.alias("bad_labels"))


def missingness(panel: DataFrame, bands: tuple[str, ...] = BANDS) -> DataFrame:
    """level (band, month, sensor, all), key, observations, missing, rate, by one GROUPING SETS over the unpivoted panel."""
    cells = F.array(*[F.struct(F.lit("radar" if b in RADAR else "optical").alias("sensor"), F.lit(b).alias("band"), F.col(b).isNull().alias("missing")) for b in bands])
    flat = panel.select("month", F.explode(cells).alias("c")).select("month", "c.*")
    level = F.when(F.col("band").isNotNull(), "band").when(F.col("month").isNotNull(), "month").when(F.col("sensor").isNotNull(), "sensor").otherwise("all")
    name = F.coalesce("band", F.col("month").cast("string"), "sensor", F.lit("all"))
    b, m, n = F.col("band"), F.col("month"), F.col("sensor")
    g = flat.groupingSets([[b], [m], [n], []], b, m, n).agg(F.count("*").alias("observations"), F.count(F.when(F.col("missing"), 1)).alias("missing"))
    return g.select(level.alias("level"), name.alias("key"), "observations", "missing", F.round(F.col("missing") / F.col("observations"), 6).alias("rate"))


def availability(panel: DataFrame) -> DataFrame:
    """Per month: rows with all and any radar and optical bands, and partial optical rows."""
    return panel.groupBy("month").agg(
        F.count("*").alias("rows"), F.count(F.when(all_valid(RADAR), 1)).alias("radar_all"), F.count(F.when(all_valid(OPTICAL), 1)).alias("optical_all"),
        F.count(F.when(any_valid(OPTICAL), 1)).alias("optical_any"), F.count(F.when(any_valid(OPTICAL) & ~all_valid(OPTICAL), 1)).alias("optical_partial"),
    )


def observed_windows(panel: DataFrame, key: str) -> DataFrame:
    """Per key: radar and optical bit strings, first and last radar month, length, whether consecutive, optical months inside and
    outside, and gaps. panel must be dense; a key without any radar month is an error when its row is computed."""
    m = F.array_sort(F.collect_list(F.struct("month", all_valid(RADAR).alias("r"), all_valid(OPTICAL).alias("o"))))
    w = panel.groupBy(key).agg(m.alias("m"))
    on = lambda field: bits(F.transform("m", lambda x: x[field]))
    w = w.select(key, on("r").alias("radar_bits"), on("o").alias("optical_bits"))
    none = F.raise_error(F.concat(F.lit(f"no radar month for {key} "), F.col(key).cast("string"))).cast("string")
    w = w.withColumn("radar_bits", F.when(F.col("radar_bits").contains("1"), F.col("radar_bits")).otherwise(none))
    first = F.locate("1", F.col("radar_bits"))
    last = F.lit(13) - F.locate("1", F.reverse("radar_bits"))
    w = w.withColumn("first_month", first).withColumn("last_month", last).withColumn("window_length", F.col("last_month") - F.col("first_month") + 1)
    inside = F.substring("optical_bits", F.col("first_month"), F.col("window_length"))
    ones = lambda s: F.length(s) - F.length(F.replace(s, F.lit("1"), F.lit("")))
    w = w.withColumn("consecutive", ones(F.col("radar_bits")) == F.col("window_length")).withColumn("optical_inside", ones(inside)).withColumn("optical_outside", ones(F.col("optical_bits")) - F.col("optical_inside"))
    both = F.size(F.filter(F.sequence(F.lit(1), F.lit(12)), lambda i: (F.substring("radar_bits", i, F.lit(1)) == "1") & (F.substring("optical_bits", i, F.lit(1)) == "0")))
    return w.withColumn("gaps", both)


def distributions(windows: DataFrame) -> DataFrame:
    """Counts and shares by length, by start and length, and by length and gaps, in one GROUPING SETS."""
    n, m, x = F.col("window_length"), F.col("first_month"), F.col("gaps")
    g = windows.groupingSets([[n], [n, m], [n, x]], n, m, x).agg(F.count("*").alias("n"), F.grouping_id().alias("g"))
    return g.select("window_length", "first_month", "gaps", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("g")), 6).alias("share"))


def mask_library(windows: DataFrame) -> DataFrame:
    """mask_id (hash of the pattern), radar_bits, optical_bits, frequency of each distinct pattern."""
    ident = F.sha2(F.concat_ws("|", "radar_bits", "optical_bits"), 256)
    return windows.groupBy("radar_bits", "optical_bits").agg(F.count("*").alias("frequency")).select(ident.alias("mask_id"), "radar_bits", "optical_bits", "frequency")


def sampled_masks(keys: DataFrame, key: str, library: DataFrame, views: int = 8, seed: int = 42) -> DataFrame:
    """key, view_index, mask_id: views draws with replacement for each key, by frequency.

    Each mask stands in every one of 256 equal ranges of [0, 1) that its cumulated share touches; draws meet the masks of their
    range only."""
    of = F.substring(F.regexp_replace("mask_id", "^mask_", ""), 1, 2)  # running sums by ranges of the id, which is a hash
    parts = library.withColumn("part", of)
    sums = parts.groupBy("part").agg(F.sum("frequency").alias("s"))
    every = Window.partitionBy(F.lit(0))
    sums = sums.select("part", F.coalesce(F.sum("s").over(every.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"), F.sum("s").over(every).alias("total"))
    own = Window.partitionBy("part").orderBy("mask_id").rowsBetween(Window.unboundedPreceding, 0)
    upto = parts.join(sums, "part").withColumn("upto", F.col("before") + F.sum("frequency").over(own))
    cum = upto.select("mask_id", ((F.col("upto") - F.col("frequency")) / F.col("total")).alias("lo"), (F.col("upto") / F.col("total")).alias("hi"))
    cum = cum.withColumn("range", F.explode(F.sequence(F.floor(F.col("lo") * 256), F.least(F.floor(F.col("hi") * 256), F.lit(255)))))
    draws = keys.select(key, F.explode(F.sequence(F.lit(0), F.lit(views - 1))).alias("view_index")).withColumn("u", uniform(F.lit(seed), key, "view_index"))
    draws = draws.withColumn("range", F.floor(F.col("u") * 256))
    return draws.join(cum, "range").filter((F.col("u") >= F.col("lo")) & (F.col("u") < F.col("hi"))).select(key, "view_index", "mask_id")
