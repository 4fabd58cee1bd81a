"""Queries of a data set as a whole: entities up to 1995 as training, the later ones as test, with a sample of answers."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapseries.operators import dataset as ds
from gapseries.operators import panel as pn

from . import oracles as o
from .chosen import _P
from .more import sql
from .queries import _wide_columns, labels, obs, panel, predictions, rounded

_E = "entity_id"


def _wide(s, d):
    return pn.to_wide(obs(s, d), [_E], pn.BANDS)


@sql(f"WITH {o._WIDE}, {o._LAB}, c AS (SELECT entity_id, {' + '.join(f'({b}_{m:02d} = -9999.0)::BIGINT' for b in pn.BANDS for m in range(1, 13))} AS x FROM wide) SELECT count(*) AS rows, count(*) * 144 AS cells, sum(x)::BIGINT AS missing_cells, count(*) FILTER (WHERE x > 0) AS rows_with_missing, sum(label)::BIGINT AS positives, sum(1 - label)::BIGINT AS negatives, round(avg(label) + 3e-10, 6) AS positive_rate FROM c JOIN lab USING (entity_id)")
def dataset_summary(s, d):
    """Rows, missing cells and labels of the wide table."""
    return rounded(ds.summary(_wide(s, d).join(labels(s, d), _E), _wide_columns(), "label"))


@sql(f"WITH {o._PANEL}, c AS (SELECT *, {' + '.join(f'({b} IS NULL)::INT' for b in pn.RADAR)} AS r, {' + '.join(f'({b} IS NULL)::INT' for b in pn.OPTICAL)} AS x FROM panel) SELECT entity_id, count(*) * 12 AS observations, sum(r)::BIGINT AS radar_missing, sum(x)::BIGINT AS optical_missing, count(*) FILTER (WHERE x > 0 AND x < {len(pn.OPTICAL)}) AS partial_months, (sum(r) + sum(x))::BIGINT AS missing, round((sum(r) + sum(x)) / (count(*) * 12) + 3e-10, 6) AS rate FROM c GROUP BY 1")
def missingness_by_row(s, d):
    return rounded(ds.missing_by_row(panel(s, d), _E))


def tables(s, d):
    """Train, test and sample, with known faults by the last digit of a supplier: 3 is in train and test, 5 is absent from the sample, 7
    is in it twice, 8 and 9 are one place off; labels of years that end in 2 are 2."""
    e = labels(s, d)
    early, last = F.col(_E) % 10000 <= 1995, F.col(_E) % 10
    of = F.floor(F.col(_E) / 10000) % 10
    train = e.filter(early | (of == 3)).select(_E, F.when(last == 2, 2).otherwise(F.col("label")).alias("label"), F.lit(0.0).alias("VV_01"))
    test = e.filter(~early).select(_E, F.lit(0.0).alias("VV_01"), (F.col(_E) * 2).alias("pos"))
    copies = F.explode(F.when(of == 5, F.array()).when(of == 7, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    sample = test.withColumn("_c", copies).select(_E, F.lit(0).alias("TargetF1"), F.lit(0.0).alias("TargetRAUC"), (F.col("pos") + F.when(of >= 8, 1).otherwise(0)).alias("pos"))
    return train, test, sample


@sql(f"""WITH {o._LAB}, e AS (SELECT *, entity_id % 10000 <= 1995 AS early, (entity_id // 10000) % 10 AS o, entity_id % 10 = 2 AS two FROM lab)
SELECT unnest(['label_absent_in_train', 'label_present_in_test', 'feature_order', 'sample_columns', 'label_values', 'label_classes', 'train_null_keys', 'train_repeated_keys', 'test_null_keys', 'test_repeated_keys', 'sample_null_keys', 'sample_repeated_keys', 'keys_in_train_and_test', 'absent_in_sample', 'unknown_in_sample', 'sample_places']) AS rule,
unnest([0, 0, 0, 0, count(*) FILTER (WHERE (early OR o = 3) AND two), 2 - count(DISTINCT label) FILTER (WHERE (early OR o = 3) AND NOT two), 0, 0, 0, 0, 0, count(*) FILTER (WHERE NOT early AND o = 7), count(*) FILTER (WHERE NOT early AND o = 3), count(*) FILTER (WHERE NOT early AND o = 5), 0, count(*) FILTER (WHERE NOT early AND o >= 8)]) AS faults FROM e""")
def dataset_agreement(s, d):
    """Broken rules of three tables that hold known faults."""
    train, test, sample = tables(s, d)
    return ds.agreement(train, test, sample, _E, "label", ["TargetF1", "TargetRAUC"])


@sql(f"WITH {_P} SELECT repeat, entity_id || ':' || window_length || ':' || window_start AS window_id, fold, label, window_length, p1, p2 FROM pred")
def aligned_windows(s, d):
    """Two models' windows one to one, their other columns held to be the same."""
    p = predictions(s, d).withColumn("window_id", F.concat_ws(":", _E, "window_length", "window_start"))
    return ds.aligned_windows(p.drop("p2"), p.drop("p1"), ["repeat", "window_id"], ["fold", "label", "window_length"], ("p1", "p2"))
