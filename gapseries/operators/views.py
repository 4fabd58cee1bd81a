"""Temporal views as data: stable ids, masks applied to values, sampled and uniform views, dropout, season-out splits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gapseries.functions import season, uniform

from .panel import BANDS, OPTICAL, RADAR, all_valid


def window_hash(*fields: Column) -> Column:
    """window_ and 24 hex digits of the SHA-256 of the fields joined by |: id, fold, mode, seed, view, start, length, mask, patterns."""
    return F.concat(F.lit("window_"), F.substring(F.sha2(F.concat_ws("|", *[f.cast("string") for f in fields]), 256), 1, 24))


def mask_patterns(panel: DataFrame, key: str) -> DataFrame:
    """key, radar (12 flags) and optical (12 x 10 flags) of what was observed; panel must be dense."""
    flags = F.array(*[F.col(b).isNotNull().cast("int") for b in OPTICAL])
    g = panel.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("month", all_valid(RADAR).cast("int").alias("r"), flags.alias("o")))).alias("m"))
    return g.select(key, F.transform("m", lambda x: x["r"]).alias("radar"), F.transform("m", lambda x: x["o"]).alias("optical"))


def mask_templates(patterns: DataFrame) -> DataFrame:
    """mask_id (mask_ and 16 hex digits of the SHA-256 of the pattern as canonical JSON), radar_bits, optical_cells, frequency."""
    numbers = lambda a: F.concat(F.lit("["), F.array_join(F.transform(a, lambda x: x.cast("string")), ","), F.lit("]"))
    months = F.concat(F.lit("["), F.array_join(F.transform("optical", numbers), ","), F.lit("]"))
    names = "[" + ",".join(f'"{b}"' for b in OPTICAL) + "]"
    text = F.concat(F.lit('{"optical":'), months, F.lit(f',"optical_bands":{names},"radar":'), numbers(F.col("radar")), F.lit("}"))
    g = patterns.groupBy("radar", "optical").agg(F.count("*").alias("frequency"))
    ones = F.aggregate(F.flatten("optical"), F.lit(0), lambda a, x: a + x)
    return g.select(F.concat(F.lit("mask_"), F.substring(F.sha2(text, 256), 1, 16)).alias("mask_id"), F.array_join(F.transform("radar", lambda x: x.cast("string")), "").alias("radar_bits"), ones.alias("optical_cells"), "frequency")


def template_faults(patterns: DataFrame) -> DataFrame:
    """Counts of patterns by fault: no radar, a gap in radar, a length other than 4, 5 or 6, optical outside radar, partial optical."""
    bits = F.array_join(F.transform("radar", lambda x: x.cast("string")), "")
    size = F.aggregate("radar", F.lit(0), lambda a, x: a + x)
    held = F.rtrim(F.ltrim(F.translate(bits, "0", " ")))
    outside = F.exists(F.arrays_zip("radar", "optical"), lambda m: (m["radar"] == 0) & F.exists(m["optical"], lambda x: x == 1))
    partial = F.exists("optical", lambda m: F.exists(m, lambda x: x == 1) & F.exists(m, lambda x: x == 0))
    n = lambda c: F.count(F.when(c, 1))
    return patterns.agg(F.count("*").alias("rows"), n(size == 0).alias("no_radar"), n(held.contains(" ")).alias("radar_gap"), n(~size.isin(4, 5, 6)).alias("wrong_length"), n(outside).alias("optical_outside"), n(partial).alias("optical_partial"))


def uniform_views(keys: DataFrame, key: str, windows: DataFrame, views: int = 8, seed: int = 42) -> DataFrame:
    """key, view_index and the columns of a window of the 24, drawn with replacement by hash."""
    draws = keys.select(key, F.explode(F.sequence(F.lit(0), F.lit(views - 1))).alias("view_index"))
    draws = draws.withColumn("window_index", F.floor(uniform(F.lit(seed), F.lit("uniform"), key, "view_index") * 24).cast("int"))
    return draws.join(F.broadcast(windows), "window_index")


def dropped(views: DataFrame, temporal: float = 0.1, optical: float = 0.2) -> DataFrame:
    """Views (window_id, pos, bands) with whole months dropped, and then optical months that are left, by hash."""
    gone = uniform(F.lit("temporal"), "window_id", "pos") < temporal
    dark = all_valid(OPTICAL) & ~gone & (uniform(F.lit("optical"), "window_id", "pos") < optical)
    marked = views.withColumns({"_gone": gone, "_dark": dark})
    return marked.withColumns({b: F.when(~F.col("_gone") & (F.lit(b in RADAR) | ~F.col("_dark")), F.col(b)) for b in BANDS}).withColumnsRenamed({"_gone": "month_dropped", "_dark": "optical_dropped"})


def observed_view(observed: DataFrame, key: str) -> DataFrame:
    """One window for each key, as it was observed: fold and seed -1, view 0, no label; ids as for other views."""
    fields = [F.col(key), F.lit(-1), F.lit("observed"), F.lit(-1), F.lit(0), F.col("first_month"), F.col("window_length"), F.lit(""), F.col("radar_bits"), F.col("optical_bits")]
    return observed.select(key, window_hash(*fields).alias("window_id"), F.lit(-1).alias("fold"), F.lit(-1).alias("augmentation_seed"), F.lit(0).alias("view_index"), F.lit(None).cast("int").alias("label"), F.col("first_month").alias("window_start"), "window_length")


def shared_panel(drawn: DataFrame, folds: DataFrame, key: str, mode: str = "uniform", seed: int = 42) -> DataFrame:
    """The same views in every repeat; only fold, label and window_id differ. folds: key, label, repeat, fold."""
    fields = [F.col(key), F.col("fold"), F.lit(mode), F.lit(seed), F.col("view_index"), F.col("window_start"), F.col("window_length"), F.lit(""), F.lit(""), F.lit("")]
    return drawn.join(folds, key).select(key, "repeat", "fold", "label", "view_index", "window_start", "window_length", window_hash(F.col("repeat"), *fields).alias("window_id"))


def panel_differences(shared: DataFrame, key: str) -> DataFrame:
    """Rows of any repeat whose view is not in repeat 0, or the other way; must be empty."""
    view = [key, "view_index", "window_start", "window_length"]
    n = shared.select("repeat").distinct()
    base = shared.filter("repeat = 0").select(*view).crossJoin(F.broadcast(n)).select("repeat", *view)
    own = shared.select("repeat", *view)
    return own.exceptAll(base).unionByName(base.exceptAll(own))


def season_out(rows: DataFrame) -> DataFrame:
    """By repeat, fold and season: windows to validate (in both) and to train (in neither), and order-free sums over the validation
    ids. rows: repeat, fold, window_start, window_id. One pass by repeat, fold and season, then sums over that small table."""
    part = F.conv(F.substring(F.md5("window_id"), 1, 8), 16, 10).cast("long")
    g = rows.groupBy("repeat", "fold", season(F.col("window_start")).alias("season")).agg(F.count("*").alias("validation_n"), F.sum(part).alias("validation_sum"))
    other = g.select("repeat", F.col("fold").alias("f"), F.col("season").alias("s"), F.col("validation_n").alias("n"))
    train = g.join(F.broadcast(other), "repeat").filter("fold <> f and season <> s").groupBy("repeat", "fold", "season").agg(F.sum("n").alias("training_n"))
    return g.join(train, ["repeat", "fold", "season"], "left").withColumn("training_n", F.coalesce("training_n", F.lit(0)))
