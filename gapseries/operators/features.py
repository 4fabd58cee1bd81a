"""Sliding views, monthly channels, gap-aware aggregates and window metadata."""

from __future__ import annotations

import math
from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from gapseries.functions import finite, safe_divide
from gapseries.functions import normalized_difference as nd

from .panel import BANDS, OPTICAL, RADAR, all_valid

LENGTHS = (4, 5, 6)
#: Roles of the optical bands in configured order (fixed values).
ROLES = {"blue": "blue", "green": "green", "nir": "nir", "nira": "narrow_nir", "re1": "red_edge_1", "re2": "red_edge_2", "re3": "red_edge_3", "red": "red", "swir1": "swir1", "swir2": "swir2"}
STATS = ("valid_count", "mean", "median", "std", "min", "max", "amplitude", "p25", "p75", "iqr", "first", "last", "first_to_last", "slope")


def windows(spark: SparkSession, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """window_index, window_length, window_start, window_end of every run of months within a year, by length and start."""
    rows = [(n, s, s + n - 1) for n in lengths for s in range(1, 14 - n)]
    return spark.createDataFrame([(i, *r) for i, r in enumerate(rows)], "window_index int, window_length int, window_start int, window_end int")


def sliding_views(panel: DataFrame, key: str) -> DataFrame:
    """The dense panel once for each window that holds the month, with pos from 1: a range join with 24 rows, which are broadcast."""
    w = F.broadcast(windows(panel.sparkSession))
    return panel.join(w, F.col("month").between(F.col("window_start"), F.col("window_end"))).withColumn("pos", F.col("month") - F.col("window_start") + 1).withColumn("window_id", F.concat_ws(":", F.col(key).cast("string"), F.col("window_length").cast("string"), F.col("window_start").cast("string")))


def channels() -> dict[str, Column]:
    """The monthly channels but for the two differences, which need the month before."""
    c = F.col
    radar = {"vv": c("VV"), "vh": c("VH"), "vv_minus_vh": finite(c("VV") - c("VH")), "vv_plus_vh": finite(c("VV") + c("VH")), "vv_over_abs_vh": safe_divide(c("VV"), F.abs(c("VH"))), "vh_over_abs_vv": safe_divide(c("VH"), F.abs(c("VV")))}
    index = {
        "ndvi": nd(c("nir"), c("red")), "ndwi": nd(c("green"), c("nir")), "mndwi": nd(c("green"), c("swir1")), "ndmi": nd(c("nir"), c("swir1")),
        "nbr": nd(c("nir"), c("swir2")), "ndre1": nd(c("nira"), c("re1")), "ndre2": nd(c("nira"), c("re2")), "chlorophyll_red_edge": safe_divide(c("nira"), c("re1")) - 1,
        "nir_over_swir1": safe_divide(c("nir"), c("swir1")), "nir_over_swir2": safe_divide(c("nir"), c("swir2")), "green_over_swir1": safe_divide(c("green"), c("swir1")),
        "green_over_swir2": safe_divide(c("green"), c("swir2")), "green_red_contrast": nd(c("green"), c("red")), "blue_green_contrast": nd(c("blue"), c("green")),
    }
    return {f"radar__{k}": v for k, v in radar.items()} | {f"optical__{ROLES[b]}": c(b) for b in OPTICAL} | {f"optical__{k}": v for k, v in index.items()}


def with_channels(views: DataFrame, key: str, order: str) -> DataFrame:
    """All 32 channels beside key and order; a difference is null unless both it and the place before are valid (no bridging). NaN and
    infinite cells count as missing, as do channels that would be."""
    views = views.withColumns({b: finite(F.col(b).cast("double")) for b in BANDS})
    w = Window.partitionBy(key).orderBy(order)
    step = lambda b: finite(F.when(F.lag(order).over(w) == F.col(order) - 1, F.col(b) - F.lag(b).over(w)))
    return views.withColumns(channels() | {"radar__vv_first_difference": step("VV"), "radar__vh_first_difference": step("VH")})


#: Names of the radar channels and of the optical indices, in the order of channels(), for use without a session.
RADAR_CHANNELS = ("vv", "vh", "vv_minus_vh", "vv_plus_vh", "vv_over_abs_vh", "vh_over_abs_vv")
INDICES = (
    "ndvi", "ndwi", "mndwi", "ndmi", "nbr", "ndre1", "ndre2", "chlorophyll_red_edge", "nir_over_swir1", "nir_over_swir2", "green_over_swir1",
    "green_over_swir2", "green_red_contrast", "blue_green_contrast",
)


def channel_names() -> list[str]:
    radar, optical = [f"radar__{c}" for c in RADAR_CHANNELS], [f"optical__{c}" for c in (*ROLES.values(), *INDICES)]
    return [*radar, *optical, "radar__vv_first_difference", "radar__vh_first_difference"]


def long_channels(frame: DataFrame, keys: list[str], order: str, names: list[str]) -> DataFrame:
    cells = F.array(*[F.struct(F.lit(n).alias("channel"), F.col(n).cast("double").alias("x")) for n in names])
    return frame.select(*keys, F.col(order).alias("pos"), F.explode(cells).alias("c")).select(*keys, "pos", "c.*")


def aggregates(long: DataFrame, keys: list[str], x: str = "x", pos: str = "pos") -> DataFrame:
    """The 14 statistics of x over true positions (gaps kept): null where fewer than one, or for spreads and trends two, are valid. NaN
    and infinite values are missing ones."""
    v = finite(F.col(x).cast("double"))
    p = F.when(v.isNotNull(), F.col(pos))
    n = F.count(v)
    two = lambda e: F.when(n >= 2, e)
    q = lambda f: F.percentile(v, F.lit(f))
    first, last = F.min_by(v, p), F.max_by(v, p)
    return long.groupBy(*keys).agg(
        n.alias("valid_count"), F.avg(v).alias("mean"), q(0.5).alias("median"), two(F.stddev_pop(v)).alias("std"), F.min(v).alias("min"), F.max(v).alias("max"),
        two(F.max(v) - F.min(v)).alias("amplitude"), q(0.25).alias("p25"), q(0.75).alias("p75"), two(q(0.75) - q(0.25)).alias("iqr"),
        first.alias("first"), last.alias("last"), two(last - first).alias("first_to_last"), two(F.regr_slope(v, p.cast("double"))).alias("slope"),
    )


def mean_abs_difference(frame: DataFrame, keys: list[str]) -> DataFrame:
    return frame.groupBy(*keys).agg(*[F.avg(F.abs(F.col(f"radar__{b}_first_difference"))).alias(f"{b}_mean_abs_first_difference") for b in ("vv", "vh")])


def longest_run(flags: Column) -> Column:
    """Length of the longest run of true in an array of booleans."""
    zero = F.struct(F.lit(0).alias("run"), F.lit(0).alias("best"))

    def step(a: Column, x: Column) -> Column:
        run = F.when(x, a["run"] + 1).otherwise(0)
        return F.struct(run.alias("run"), F.greatest(a["best"], run).alias("best"))

    return F.aggregate(flags, zero, step, lambda a: a["best"])


def metadata(views: DataFrame, key: str) -> DataFrame:
    """Per window: counts, proportions, longest runs, cyclic months and flags by position; never null."""
    m = F.array_sort(F.collect_list(F.struct("pos", all_valid(RADAR).alias("r"), all_valid(OPTICAL).alias("o"))))
    counts = [F.count(F.when(all_valid(RADAR), 1)).alias(f"{b.lower()}_valid_count") for b in RADAR]
    counts += [F.count(b).alias(f"{ROLES[b]}_valid_count") for b in OPTICAL]
    g = views.groupBy(key, "window_id", "window_length", "window_start", "window_end").agg(m.alias("m"), *counts)
    r, o = F.transform("m", lambda x: x["r"]), F.transform("m", lambda x: x["o"])
    size = lambda a: F.size(F.filter(a, lambda x: x))
    bands = sum((F.col(f"{ROLES[b]}_valid_count") for b in OPTICAL), F.lit(0))
    angle = lambda c: (F.col(c) - 1) * (2 * math.pi / 12)
    flags = {}
    at_pos = lambda k: F.get(F.filter("m", lambda x: x["pos"] == k), F.lit(0))
    for k in range(1, 7):
        at = at_pos(k)
        flags |= {f"position_{k:02d}_radar_valid": F.coalesce(at["r"], F.lit(False)).cast("int"), f"position_{k:02d}_optical_valid": F.coalesce(at["o"], F.lit(False)).cast("int"), f"position_{k:02d}_padding": at.isNull().cast("int")}
    return g.withColumns({
        "relative_position_count": F.size("m"), "radar_valid_count": size(r), "optical_valid_count": size(o), "total_valid_band_count": 2 * size(r) + bands,
        "optical_gap_count": size(F.transform("m", lambda x: x["r"] & ~x["o"])), "longest_optical_valid_run": longest_run(o), "longest_optical_missing_run": longest_run(F.transform("m", lambda x: x["r"] & ~x["o"])),
        "radar_valid_proportion": size(r) / F.col("window_length"), "optical_valid_proportion": bands / (F.col("window_length") * 10),
        "start_month_sin": F.sin(angle("window_start")), "start_month_cos": F.cos(angle("window_start")), "end_month_sin": F.sin(angle("window_end")), "end_month_cos": F.cos(angle("window_end")),
    } | flags).drop("m")


def relative_positions(frame: DataFrame, keys: list[str], names: list[str], positions: int = 6) -> DataFrame:
    """relative__position_0k__<channel> for each position and channel, null in padding."""
    return frame.groupBy(*keys).agg(*[F.max(F.when(F.col("pos") == k, F.col(n))).alias(f"relative__position_{k:02d}__{n}") for k in range(1, positions + 1) for n in names])


def sequences(frame: DataFrame, keys: list[str], name: str, positions: int = 6) -> DataFrame:
    """values, mask and padding arrays of positions cells for each window."""
    g = frame.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("pos", F.col(name).alias("x")))).alias("m"))
    steps = F.sequence(F.lit(1), F.lit(positions))
    return g.select(*keys, F.transform(steps, lambda i: F.try_element_at("m", i)).alias("values"), F.transform(steps, lambda i: F.try_element_at("m", i).isNotNull()).alias("mask"), F.transform(steps, lambda i: ~F.map_contains_key("m", i)).alias("padding"))


#: Keys whose windows a task works on at once: their cells are under two megabytes.
BLOCK = 512


def dealt(panel: DataFrame, key: str) -> DataFrame:
    """panel dealt out by key, about four blocks of keys to a task, one where cores would be idle. What follows makes thousands of cells of each
    key, so neither the few bytes of a panel nor those of the channels made of it may say how many tasks there are."""
    blocks = panel.select(key).distinct().count() // BLOCK + 1
    return panel.repartition(max(blocks // 4, min(blocks, panel.sparkSession.sparkContext.defaultParallelism)), key)


def channel_arrays(panel: DataFrame, key: str) -> DataFrame:
    """key and months: for each of the twelve months the array of all channels (in the order of channel_names), dense and in order."""
    c = with_channels(dealt(panel, key), key, "month").select(key, "month", F.array(*[F.col(n).cast("double") for n in channel_names()]).alias("x"))
    return c.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct("month", "x"))), lambda m: m["x"]).alias("months"))


def window_values(batches):
    """(keys, length, start, x) of every window of every block of keys, from Arrow batches of channel_arrays: x[i, c, k] is channel c
    of key k at position i + 1, NaN where missing. A difference at the first position looks before the window, so it is missing there."""
    steps = [i for i, n in enumerate(channel_names()) if n.endswith("_first_difference")]
    for batch in batches:
        for at in range(0, batch.num_rows, BLOCK):
            part = batch.slice(at, BLOCK)
            cells = part.column(1).flatten().flatten().to_numpy(zero_copy_only=False)
            months = cells.reshape(part.num_rows, 12, len(channel_names())).transpose(1, 2, 0).copy()
            for n in LENGTHS:
                for s in range(13 - n):
                    x = months[s : s + n].copy()
                    x[0, steps] = np.nan
                    yield part.column(0), n, s + 1, x


def statistics(x: np.ndarray) -> np.ndarray:
    """The 14 statistics (in the order of STATS) over the first axis, the positions; NaN is missing, in x and in what comes out."""
    known, (size, *_) = ~np.isnan(x), x.shape
    n = known.sum(axis=0)
    s = np.where(known, x, np.inf)
    for last in range(size - 1, 0, -1):  # in order by exchanges of neighbours, all series at once
        for i in range(last):
            s[i], s[i + 1] = np.minimum(s[i], s[i + 1]), np.maximum(s[i], s[i + 1])
    at = lambda i: np.take_along_axis(s, np.clip(i, 0, size - 1)[None], 0)[0]
    total = lambda v: np.where(known, v, 0.0).sum(axis=0)

    def quantile(q: float) -> np.ndarray:
        place = (n - 1) * q
        low = np.floor(place).astype(np.int64)
        lo, part = at(low), place - low
        return np.where(part > 0, lo + (at(np.where(part > 0, low + 1, low)) - lo) * part, lo)

    with np.errstate(all="ignore"):
        p = np.arange(1.0, size + 1).reshape(-1, *[1] * (x.ndim - 1))
        dx, dp = x - total(x) / n, p - total(np.broadcast_to(p, x.shape)) / n
        first, last = x[-1], x[0]
        for i in range(1, size):
            first, last = np.where(known[size - 1 - i], x[size - 1 - i], first), np.where(known[i], x[i], last)
        lo, hi, low, high = s[0], at(n - 1), quantile(0.25), quantile(0.75)
        out = np.stack([n, total(x) / n, quantile(0.5), np.sqrt(total(dx * dx) / n), lo, hi, hi - lo, low, high, high - low, first, last, last - first, total(dp * dx) / total(dp * dp)])
    for j, name in enumerate(STATS):
        if name != "valid_count":
            out[j][n < (2 if name in ("std", "amplitude", "iqr", "first_to_last", "slope") else 1)] = np.nan
    return out


def nullable(x: np.ndarray) -> pa.Array:
    """x flat, null where it is NaN."""
    x = np.ascontiguousarray(x).reshape(-1)
    known = np.packbits(~np.isnan(x), bitorder="little")
    return pa.Array.from_buffers(pa.float64(), len(x), [pa.py_buffer(known), pa.py_buffer(x)])


def window_id(key: str) -> Column:
    return F.concat_ws(":", F.col(key).cast("string"), F.col("window_length").cast("string"), F.col("window_start").cast("string"))


def window_statistics(arrays: DataFrame, key: str, shown: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> DataFrame:
    """window_id, channel and the 14 statistics (as shown gives them), a row for every window and channel."""
    many = len(channel_names())

    def rows(batches):
        for keys, length, start, x in window_values(batches):
            k = x.shape[2]
            stats = shown(statistics(x)).transpose(0, 2, 1)
            of = [keys.take(pa.array(np.repeat(np.arange(k), many))), *[pa.array(np.full(k * many, v, np.int32)) for v in (length, start)], pa.array(np.tile(np.arange(many, dtype=np.int32), k))]
            yield pa.RecordBatch.from_arrays([*of, *[nullable(v) for v in stats]], names=[key, "window_length", "window_start", "i", *STATS])

    kinds = [T.StructField(c, T.IntegerType()) for c in ("window_length", "window_start", "i")] + [T.StructField(c, T.DoubleType()) for c in STATS]
    made = arrays.select(key, "months").mapInArrow(rows, T.StructType([T.StructField(key, arrays.schema[key].dataType), *kinds]))
    names = F.array(*[F.lit(n) for n in channel_names()])
    return made.select(window_id(key).alias("window_id"), F.get(names, F.col("i")).alias("channel"), F.col("valid_count").cast("long").alias("valid_count"), *STATS[1:])


def monthly_statistics(arrays: DataFrame, key: str, shown: Callable[[np.ndarray], np.ndarray] = lambda x: x) -> DataFrame:
    """key, channel and the 14 statistics (as shown gives them) over the twelve months, from channel_arrays: within its tasks, without a shuffle."""
    many = len(channel_names())

    def rows(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                part = batch.slice(at, BLOCK)
                k = part.num_rows
                x = part.column(1).flatten().flatten().to_numpy(zero_copy_only=False).reshape(k, 12, many).transpose(1, 0, 2)
                stats = shown(statistics(x))
                of = [part.column(0).take(pa.array(np.repeat(np.arange(k), many))), pa.array(np.tile(np.arange(many, dtype=np.int32), k))]
                yield pa.RecordBatch.from_arrays([*of, *[nullable(v) for v in stats]], names=[key, "i", *STATS])

    kinds = [T.StructField(key, arrays.schema[key].dataType), T.StructField("i", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in STATS]]
    made = arrays.select(key, "months").mapInArrow(rows, T.StructType(kinds))
    names = F.array(*[F.lit(n) for n in channel_names()])
    return made.select(key, F.get(names, F.col("i")).alias("channel"), F.col("valid_count").cast("long").alias("valid_count"), *STATS[1:])


def window_sequences(arrays: DataFrame, key: str, positions: int = 6, shown: Callable[[Column], Column] = lambda x: x) -> DataFrame:
    """window_id, channel, and arrays of positions cells: values (as shown gives them), mask and padding; every row of arrays becomes one for each
    window and channel, without a shuffle."""
    w = F.array(*[F.struct(F.lit(n).alias("window_length"), F.lit(s).alias("window_start")) for n in LENGTHS for s in range(1, 14 - n)])
    c = F.array(*[F.struct(F.lit(i).alias("i"), F.lit(n).alias("channel"), F.lit(n.endswith("_first_difference")).alias("step")) for i, n in enumerate(channel_names())])
    rows = arrays.select(key, "months", F.explode(w).alias("w")).select(key, "months", "w.*").select("*", F.explode(c).alias("c")).select("*", "c.*")

    def cell(k: int) -> Column:
        there = (F.lit(k) < F.col("window_length")) & ~(F.col("step") & F.lit(k == 0))
        return F.when(there, F.get(F.get("months", F.col("window_start") - 1 + k), F.col("i")))

    steps = range(positions)
    return rows.select(window_id(key).alias("window_id"), "channel", F.array(*[shown(cell(k)) for k in steps]).alias("values"), F.array(*[cell(k).isNotNull() for k in steps]).alias("mask"), F.array(*[F.lit(k) >= F.col("window_length") for k in steps]).alias("padding"))


def window_validity(monthly: DataFrame, lengths: tuple[int, ...] = LENGTHS) -> DataFrame:
    """channel, cells, valid, missing over all windows, from the dense months with their channels: a month counts once for every window
    that holds it, a difference only where the month is not the window's first."""
    spans = [range(s, s + n) for n in lengths for s in range(1, 14 - n)]
    held = F.array(*[F.lit(sum(m in w for w in spans)) for m in range(1, 13)])
    later = F.array(*[F.lit(sum(m in w[1:] for w in spans)) for m in range(1, 13)])
    here = lambda a: F.get(a, F.col("month") - 1)
    sums = [F.coalesce(F.sum(F.when(F.col(n).isNotNull(), here(later if n.endswith("_first_difference") else held))), F.lit(0)).alias(n) for n in channel_names()]
    total = monthly.agg(F.coalesce(F.sum(here(held)), F.lit(0)).alias("cells"), *sums)
    each = F.explode(F.array(*[F.struct(F.lit(n).alias("channel"), F.col("cells"), F.col(n).alias("valid")) for n in channel_names()]))
    return total.select(each.alias("x")).select("x.*", (F.col("x.cells") - F.col("x.valid")).alias("missing"))
