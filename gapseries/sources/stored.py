"""Tables kept between steps: fingerprints that notice order, committed tables with a manifest, and working tables."""

from __future__ import annotations

import hashlib
import json
import uuid

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: The prime and the bases of the four polynomials.
PRIME = (1 << 31) - 1
BASES = (1_103_515_245, 1_664_525, 1_597_334_677, 1_181_783_497)

#: Rows that one task makes of its own, about, where each row is multiplied.
SPREAD = 1 << 18


class StoredTableError(ValueError):
    """A stored table is not what its manifest says."""


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder in the one that the session names in spark.checkpoint.dir, else in its warehouse: both are shared."""
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.sql.warehouse.dir")
    return f"{base.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def materialize(df: DataFrame, name: str, *by: str) -> DataFrame:
    """df written to a working folder (one of its own for each value of by) and read again: cuts the plan, and what was computed survives
    lost executors."""
    path = work_path(df.sparkSession, name)
    df.write.partitionBy(*by).parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def spread(df: DataFrame, copies: int, name: str) -> DataFrame:
    """df written as by materialize and dealt out evenly, in as many tasks as keep copies of each row under about SPREAD rows a task: what
    is multiplied in a task is grouped there too, before it is dealt out again, and takes memory by its own number of rows."""
    rows = materialize(df, name)
    return rows.repartition(rows.count() * copies // SPREAD + 1)


def encoded(columns: list[str]) -> Column:
    """A row as text from which its fields can be told: length:text each, - for null."""
    one = lambda c: F.coalesce(F.concat(F.length(c.cast("string")).cast("string"), F.lit(":"), c.cast("string")), F.lit("-"))
    return F.concat(*[one(F.col(f"`{c}`")) for c in columns])


def schema_text(schema: T.StructType) -> str:
    return ",".join(f"{f.name}:{f.dataType.simpleString()}" for f in schema)


def _powers(n: int) -> np.ndarray:
    """BASES to the powers from 0 to n, by doubling."""
    out = np.ones((len(BASES), n + 1), np.int64)
    have, step = 1, np.array(BASES, np.int64)[:, None] % PRIME
    while have <= n:
        take = min(have, n + 1 - have)
        out[:, have : have + take] = out[:, :take] * step % PRIME
        have, step = have + take, step * step % PRIME
    return out


def merge(a: tuple, b: tuple) -> tuple:
    """(rows, powers, sums) of one stretch of rows and the next as those of both: associative, so any cut into stretches will do."""
    return a[0] + b[0], [x * y % PRIME for x, y in zip(a[1], b[1], strict=True)], [(s * p + t) % PRIME for s, p, t in zip(a[2], b[1], b[2], strict=True)]


EMPTY = (0, [1] * len(BASES), [0] * len(BASES))


def _stretches(batches):
    total = EMPTY
    for b in batches:
        h = np.stack([b.column(i).to_numpy() for i in range(len(BASES))]).astype(np.int64)
        n = h.shape[1]
        pw = _powers(n)
        sums = (h * pw[:, :n][:, ::-1] % PRIME).sum(axis=1) % PRIME
        total = merge(total, (n, pw[:, n].tolist(), sums.tolist()))
    if total[0]:
        row = [TaskContext.get().partitionId(), total[0], *total[1], *total[2]]
        yield pa.RecordBatch.from_arrays([pa.array([int(x)], pa.int64()) for x in row], names=["at", "n", *[f"p{i}" for i in range(4)], *[f"s{i}" for i in range(4)]])


def stretch_of(df: DataFrame, order: list[str] | None = None) -> tuple:
    """(rows, powers, sums) of the whole table in the given order; rows that tie are ordered by their content.

    Only the order columns and 16 bytes a row are dealt out, by range; each task folds its rows into nine numbers, and the driver those
    of the tasks, in order. They are written first, as finding the ranges reads them once more, and hashing is most of the work. Without
    an order, rows are ordered by hash of their content, so the result does not depend on any."""
    order = order or []
    row = F.md5(encoded(df.columns))
    part = [(F.conv(F.substring(row, 1 + 8 * i, 8), 16, 10).cast("long") % PRIME).cast("int").alias(f"h{i}") for i in range(4)]
    keys = [F.col(f"`{c}`").alias(f"_o{i}") for i, c in enumerate(order)]
    names = [f"_o{i}" for i in range(len(order))] + [f"h{i}" for i in range(4)]
    rows = materialize(df.select(*part, *keys), "hashes").repartitionByRange(*(names[: len(order)] or names)).sortWithinPartitions(*names).select("h0", "h1", "h2", "h3")
    kinds = "at long, n long, " + ", ".join(f"{x}{i} long" for x in "ps" for i in range(4))
    total = EMPTY
    for r in sorted(rows.mapInArrow(_stretches, kinds).collect()):  # a row for each task
        total = merge(total, (r["n"], list(r[2:6]), list(r[6:10])))
    return total


def digest(schema: T.StructType, stretch: tuple) -> str:
    return hashlib.sha256(f"{schema_text(schema)}|{stretch[0]}|{':'.join(map(str, stretch[2]))}".encode()).hexdigest()


def fingerprint(df: DataFrame, order: list[str] | None = None) -> DataFrame:
    """rows and the fingerprint of a table: its schema, its number of rows and their content, in the given order if there is one.

    Four polynomials modulo a prime over hashes of the rows: two tables of equal rows in other places differ, and the same table cut
    into other partitions does not."""
    s = stretch_of(df, order)
    return df.sparkSession.createDataFrame([(s[0], digest(df.schema, s))], "rows long, fingerprint string")


def commit(spark: SparkSession, path: str, manifest: dict) -> None:
    spark.createDataFrame([(json.dumps(manifest, sort_keys=True),)], "value string").coalesce(1).write.text(f"{path}/manifest")


def write_committed(df: DataFrame, path: str, order: list[str], **facts) -> dict:
    """Writes df to path/data, then, from what can be read there, path/manifest: schema, rows, order, fingerprint and facts. A table
    without a manifest was never finished; nothing is overwritten."""
    spark = df.sparkSession
    df.write.mode("errorifexists").parquet(f"{path}/data")
    back = spark.read.schema(df.schema).parquet(f"{path}/data")
    s = stretch_of(back, order)
    manifest = {"schema": json.loads(back.schema.json()), "rows": s[0], "order": order, "fingerprint": digest(back.schema, s), "facts": facts}
    commit(spark, path, manifest)
    return manifest


def read_committed(spark: SparkSession, path: str, columns: list[str] | None = None, **facts) -> DataFrame:
    """The table at path (or some of its columns), after its files' schema, its rows and its fingerprint were found to be as in the
    manifest, and the manifest's facts as given; any difference is a StoredTableError."""
    try:
        manifest = json.loads(spark.read.text(f"{path}/manifest").first()[0])
    except Exception as e:
        raise StoredTableError(f"{path} has no manifest: it was never finished") from e
    schema = T.StructType.fromJson(manifest["schema"])
    found = spark.read.parquet(f"{path}/data").schema
    if schema_text(found) != schema_text(schema):
        raise StoredTableError(f"schema differs: {schema_text(found)} in place of {schema_text(schema)}")
    for name, value in facts.items():
        if manifest["facts"].get(name) != value:
            raise StoredTableError(f"{name} is {manifest['facts'].get(name)!r} in place of {value!r}")
    df = spark.read.schema(schema).parquet(f"{path}/data")
    s = stretch_of(df, manifest["order"])
    if s[0] != manifest["rows"]:
        raise StoredTableError(f"{s[0]} rows in place of {manifest['rows']}")
    if digest(schema, s) != manifest["fingerprint"]:
        raise StoredTableError("content differs from the fingerprint")
    return df.select(*columns) if columns else df


def no_faults(counts: DataFrame, what: str) -> None:
    """counts: one row of counts of faults, or rows of rule and faults; any but 0 (rows apart) is a StoredTableError."""
    if counts.columns == ["rule", "faults"]:
        bad = {r["rule"]: r["faults"] for r in counts.filter("faults > 0").collect()}
    else:
        bad = {k: v for k, v in counts.first().asDict().items() if v and k != "rows"}
    if bad:
        raise StoredTableError(f"{what}: {bad}")


def read_folds(spark: SparkSession, path: str, entities: DataFrame, key: str, label: str, n_folds: int, repeats: int, seed: int) -> DataFrame:
    """A committed fold table: as its manifest says, of this seed, and every entity once in each repeat with its own label."""
    from gapseries.operators import oof

    df = read_committed(spark, path, seed=seed)
    no_faults(oof.fold_faults(df, entities, key, label, n_folds, repeats), "folds")
    return df


def read_windows(spark: SparkSession, path: str, key: str, folds_fingerprint: str, mode: str, seed: int, per_key: int, columns: list[str] | None = None) -> DataFrame:
    """A committed window table of these folds, this mode and seed, with per_key windows of every key in every repeat."""
    from gapseries.operators import oof

    df = read_committed(spark, path, folds=folds_fingerprint, mode=mode, seed=seed)
    no_faults(oof.manifest_faults(df, key, "window_id", per_key), "windows")
    return df.select(*columns) if columns else df


def read_predictions(spark: SparkSession, windows: str, originals: str, key: str, p: str, label: str, repeats: int) -> tuple[DataFrame, DataFrame]:
    """Both committed tables of out-of-fold predictions; the second must be exactly what the first gives when it is averaged again."""
    from gapseries.operators import oof

    w, o = read_committed(spark, windows), read_committed(spark, originals)
    no_faults(oof.contract(w, o, key, p, label, repeats), "predictions")
    again = oof.originals(w, key, p, label).select(*o.columns)
    if again.exceptAll(o).limit(1).count() or o.exceptAll(again).limit(1).count():
        raise StoredTableError("originals are not what the windows give")
    return w, o
