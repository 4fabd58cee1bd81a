"""Queries over stored tables: fingerprints, committed tables read back, and what a changed cell does; each with its SQL."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gapseries.operators import evaluation as ev
from gapseries.operators import features as ft
from gapseries.operators import oof
from gapseries.operators import views as vw
from gapseries.sources import stored as st

from . import masked as pm
from . import oracles as o
from .more import _PRED, _UNI, sql
from .queries import labels, predictions


def _fingerprint_sql(source: str, columns: dict[str, str], order: str) -> str:
    """SELECT rows, fingerprint of source: the polynomials by powers of each row's distance from the end, from tables of a digit each."""
    text = " || ".join(f"coalesce(length(({c})::VARCHAR)::VARCHAR || ':' || ({c})::VARCHAR, '-')" for c in columns)
    power = lambda b: " % 2147483647 * ".join(f"({[pow(b, v << (8 * k), st.PRIME) for v in range(256)]}::BIGINT[])[((e >> {8 * k}) & 255) + 1]" for k in range(3))
    sums = [f"(sum((('0x' || substr(h, {1 + 8 * i}, 8))::BIGINT % {st.PRIME}) * ({power(b)} % {st.PRIME}) % {st.PRIME}) % {st.PRIME})::BIGINT::VARCHAR" for i, b in enumerate(st.BASES)]
    said = ",".join(f"{c.strip(chr(34))}:{t}" for c, t in columns.items())
    return f"SELECT count(*) AS rows, sha256('{said}|' || count(*) || '|' || {' || chr(58) || '.join(sums)}) AS fingerprint FROM (SELECT h, count(*) OVER () - row_number() OVER (ORDER BY {order}) AS e FROM (SELECT *, md5({text}) AS h FROM {source}))"


_ORDERS = {"o_orderkey": "bigint", "o_custkey": "bigint", "o_orderstatus": "string", "o_totalprice": "double", "o_orderdate": "date", "o_orderpriority": "string"}


@sql(_fingerprint_sql("(SELECT * REPLACE (o_orderdate::DATE AS o_orderdate) FROM orders)", _ORDERS, "o_orderkey"))
def table_fingerprint(s, d):
    """Of the orders in the order of their keys."""
    rows = s.read.parquet(f"{d}/orders.parquet").select(*[F.col(c).cast(t) for c, t in _ORDERS.items()])
    return st.fingerprint(rows, ["o_orderkey"])


_VIEW = {"entity_id": "bigint", "window_id": "string", "fold": "int", "view_index": "int", "window_start": "int", "window_length": "int", "radar_availability": "string", "optical_band_availability": "string"}


def _views(s, d) -> DataFrame:
    return st.materialize(pm.QUERIES_OF["manifest_exhaustive"](s, d).select(*[F.col(c).cast(t) for c, t in _VIEW.items()]), "manifest")


_SEEDLESS = {c: t for c, t in _VIEW.items() if c != "window_id"}


@sql(f"WITH mx AS ({pm.ORACLES_OF['manifest_exhaustive']}) SELECT 'with ids' AS what, * FROM ({_fingerprint_sql('mx', _VIEW, 'entity_id, view_index')}) UNION ALL SELECT 'without', * FROM ({_fingerprint_sql('mx', _SEEDLESS, 'entity_id, view_index')})")
def view_fingerprints(s, d):
    """Of the views of every entity, with and without the columns that the seed goes into."""
    v, order = _views(s, d), ["entity_id", "view_index"]
    one = lambda what, df: st.fingerprint(df, order).select(F.lit(what).alias("what"), "rows", "fingerprint")
    return one("with ids", v).unionByName(one("without", v.select(*_SEEDLESS)))


def _changed(df: DataFrame, column: str, order: list[str]) -> DataFrame:
    """df with one cell changed, in its first row."""
    first = df.orderBy(*order).select(*order).first()
    here = reduce(lambda a, b: a & b, [F.col(c) == first[c] for c in order])
    return df.withColumn(column, F.when(here, F.col(column) + 1).otherwise(F.col(column)).cast(df.schema[column].dataType))


@sql(f"WITH {_PRED}, {_UNI} SELECT * FROM (VALUES ('folds', (SELECT count(*) FROM fo), 'content differs from the fingerprint'), ('windows', (SELECT count(*) FROM uw) * 3, 'content differs from the fingerprint'), ('predictions', (SELECT count(*) FROM pred), 'content differs from the fingerprint')) t(name, rows, changed_cell)".replace(f"{o._LAB}, {o._WIN}, un AS", "un AS"))
def stored_tables(s, d):
    """Folds, windows and predictions written with manifests, read back and checked; then each again with one cell changed."""
    lab, base = labels(s, d), st.work_path(s, "stored")
    fold = ev.folds(lab, "entity_id", "label", 5, 3)
    made = st.write_committed(fold, f"{base}/folds", ["repeat", "entity_id"], seed=42)
    kept = st.read_folds(s, f"{base}/folds", lab, "entity_id", "label", 5, 3, 42)
    shared = vw.shared_panel(vw.uniform_views(lab, "entity_id", ft.windows(s)), kept, "entity_id").withColumn("window_id", F.concat_ws(":", "window_id", "view_index"))
    st.write_committed(shared, f"{base}/windows", ["repeat", "entity_id", "view_index"], folds=made["fingerprint"], mode="uniform", seed=42)
    windows = st.read_windows(s, f"{base}/windows", "entity_id", made["fingerprint"], "uniform", 42, 8)
    p = predictions(s, d)
    st.write_committed(p, f"{base}/predictions", ["repeat", "entity_id", "window_length", "window_start"])
    st.write_committed(oof.originals(s.read.parquet(f"{base}/predictions/data"), "entity_id", "p1", "label"), f"{base}/originals", ["repeat", "entity_id"])
    preds, _ = st.read_predictions(s, f"{base}/predictions", f"{base}/originals", "entity_id", "p1", "label", 2)
    found = []
    for name, df, column in (("folds", kept, "label"), ("windows", windows, "view_index"), ("predictions", preds, "gaps")):
        manifest = s.read.text(f"{base}/{name}/manifest")
        order = {"folds": ["repeat", "entity_id"], "windows": ["repeat", "entity_id", "view_index"], "predictions": ["repeat", "entity_id", "window_length", "window_start"]}[name]
        _changed(df, column, order).write.parquet(f"{base}/{name}-changed/data")
        manifest.write.text(f"{base}/{name}-changed/manifest")
        try:
            st.read_committed(s, f"{base}/{name}-changed")
            said = "nothing"
        except st.StoredTableError as e:
            said = str(e)
        found.append((name, df.count(), said))
    return s.createDataFrame(found, "name string, rows long, changed_cell string")
