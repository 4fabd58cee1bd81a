"""Queries of domain validation: masked training windows against observed test windows, each with its SQL where one exists."""

from __future__ import annotations

from pyspark.sql import functions as F

from gapseries.functions import sigmoid
from gapseries.operators import domains as dm
from gapseries.operators import masks as mk
from gapseries.operators import oof
from gapseries.operators import panel as pn
from gapseries.sources.stored import materialize

from . import masked as pm
from . import oracles as o
from .more import sql
from .queries import near, panel, query, rounded

FEATURES = [f"{b}_{what}" for b in pn.BANDS for what in ("mean", "n")]
_R = " + 3e-10, 6) + 0.0"


def _features(values):
    return values.groupBy("entity_id", "window_id").agg(*[e for b in pn.BANDS for e in (near(F.avg(b)).alias(f"{b}_mean"), F.count(b).cast("double").alias(f"{b}_n"))])


def domain_rows(s, d):
    """The panel of both sides with folds and weights: eight masked windows of each training entity, one observed of each test entity."""
    views = materialize(mk.masked_views(pm._drawn(s, d), "entity_id", "test_like"), "views")
    train = _features(mk.view_values(views, panel(s, d), "entity_id"))
    sound = pm._sound(s, d).select("entity_id")
    test = _features(pm.test_observations(s, d).join(sound, "entity_id").withColumn("window_id", F.concat_ws(":", F.lit("observed"), "entity_id")))
    rows = materialize(dm.panel(train, test, "entity_id", FEATURES), "domains")
    return dm.weighted(rows.join(dm.group_folds(rows, "group_id", "domain"), "group_id"), "group_id", "domain")


_MEANS = ", ".join(f"round(avg({b}){_R} AS {b}_mean, count({b})::DOUBLE AS {b}_n" for b in pn.BANDS)
_ROWS = f"""mf AS ({pm._manifest_sql('test_like', pm._CHOSEN, 0, 0)}), {pm._TB}, {o._PANEL},
cells AS (SELECT mf.entity_id, window_id, {', '.join(f"CASE WHEN {'radar_availability[month - window_start + 1]' if b in pn.RADAR else f'''string_split(optical_band_availability, ';')[month - window_start + 1][{pn.OPTICAL.index(b) + 1}]'''} = '1' THEN {b} END AS {b}" for b in pn.BANDS)} FROM mf JOIN panel ON panel.entity_id = mf.entity_id AND month BETWEEN window_start AND window_end),
dp AS (SELECT 'train' AS source, entity_id::VARCHAR AS entity_id, 'train:' || entity_id AS group_id, window_id, 0 AS domain, {_MEANS} FROM cells GROUP BY ALL
  UNION ALL SELECT 'test', entity_id::VARCHAR, 'test:' || entity_id, 'observed:' || entity_id, 1, {_MEANS} FROM tobs WHERE entity_id IN (SELECT entity_id FROM tm WHERE {pm._OK}) GROUP BY entity_id),
gr AS (SELECT group_id, domain, count(*) AS w, {o._u('42', 'group_id')} AS u FROM dp GROUP BY 1, 2),
gi AS (SELECT *, row_number() OVER (PARTITION BY domain ORDER BY u, group_id) - 1 AS i, count(*) OVER (PARTITION BY domain) AS n, (SELECT count(*) FROM gr WHERE domain = 0) % 5 AS left_over FROM gr),
gf AS (SELECT group_id, domain, w, (CASE WHEN i < n - n % 5 THEN i ELSE i - (n - n % 5) + CASE WHEN domain = 1 THEN left_over ELSE 0 END END % 5)::INT AS fold FROM gi),
sc AS (SELECT h AS held, domain, sum(sum((fold <> h)::INT)) OVER (PARTITION BY h) / 2 / sum((fold <> h)::INT) AS train_scale, sum(sum((fold = h)::INT)) OVER (PARTITION BY h) / 2 / sum((fold = h)::INT) AS validation_scale FROM gf, (SELECT unnest(range(5)) AS h) GROUP BY 1, 2)"""


@sql(f"WITH {_ROWS} SELECT source, entity_id, dp.group_id, window_id, dp.domain, gf.fold, round(sc.validation_scale / w{_R} AS validation_weight, {', '.join(f'CASE WHEN gf.fold <> {h} THEN round((SELECT train_scale FROM sc x WHERE x.held = {h} AND x.domain = dp.domain) / w{_R} END AS train_weight_{h}' for h in range(5))}, {', '.join(FEATURES)} FROM dp JOIN gf USING (group_id) JOIN sc ON sc.held = gf.fold AND sc.domain = dp.domain")
def domain_panel(s, d):
    """Windows of both sides with their whole-entity folds and the weights of every fold's fit."""
    r = domain_rows(s, d)
    per = [near(F.try_element_at("train_weights", F.lit(h))).alias(f"train_weight_{h}") for h in range(5)]
    return r.select("source", "entity_id", "group_id", "window_id", "domain", "fold", near("validation_weight").alias("validation_weight"), *per, *FEATURES)


@sql(f"WITH {_ROWS}, en AS (SELECT source, entity_id, dp.group_id, dp.domain, gf.fold, round(avg(round(1 / (1 + exp(-(coalesce(VV_mean, 0) - 25) / 8)){_R}) + 1e-12, 9) AS p, count(*) AS n_windows FROM dp JOIN gf USING (group_id) GROUP BY ALL) SELECT source, entity_id, group_id, domain, fold, round(p{_R} AS p, n_windows FROM en")
def domain_entity_means(s, d):
    """Entity means of a score of the windows, as domain validation takes them of its predictions."""
    r = domain_rows(s, d).withColumn("p", near(sigmoid((F.coalesce("VV_mean", F.lit(0.0)) - 25) / 8)))
    return rounded(dm.entity_means(r))


_ENT = f"{_ROWS}, en AS (SELECT dp.group_id, dp.domain AS label, gf.fold, round(avg(round(1 / (1 + exp(-(coalesce(VV_mean, 0) - 25) / 8)){_R}) + 1e-12, 9) AS p FROM dp JOIN gf USING (group_id) GROUP BY ALL), lv AS (SELECT *, unnest(['all', 'fold ' || fold]) AS level FROM en)"


@sql(f"WITH {_ENT} SELECT level, n, auc, accuracy, log_loss, brier, positive_prediction_rate AS predicted_test_rate FROM ({o._metrics('lv', 'level', 'p').replace(', 6)', _R)})")
def domain_report(s, d):
    """Metrics of those entity means, over all and by fold."""
    r = domain_rows(s, d).withColumn("p", near(sigmoid((F.coalesce("VV_mean", F.lit(0.0)) - 25) / 8)))
    return rounded(dm.validation_report(r))


@query
def domain_validation(s, d):
    """How well a logistic model, fitted on the other folds, tells the sides' entities apart."""
    r = domain_rows(s, d)
    scored, _ = dm.out_of_fold(r.drop("train_weights", "validation_weight"), FEATURES, "group_id", "domain", "logistic")
    return rounded(dm.validation_report(scored), 4)


@query
def domain_importances(s, d):
    """What boosted trees that tell the sides apart split on: mean importance of each feature over folds, beside how far the sides' entity means are apart."""
    r = materialize(domain_rows(s, d).select("group_id", "domain", "fold", *FEATURES), "fitted")
    _, gains = dm.out_of_fold(r, FEATURES, "group_id", "domain", score=False)
    entity = r.groupBy("domain", "group_id").agg(*[F.avg(c).alias(c) for c in FEATURES])
    cells = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).alias("x")) for c in FEATURES]))
    shift = oof.shift_table(entity.select("domain", cells.alias("c")).select("domain", "c.*"))
    return rounded(dm.left_one_to_one(shift, oof.importance_summary(gains), ["feature"], ("shift", "importance")), 4)


@sql(f"WITH {o._LAB}, {o._WIN}, un AS (SELECT entity_id, i AS view_index, window_length, window_start FROM lab, (SELECT unnest(range(8)) AS i), win WHERE window_index = floor({o._u('42', chr(39) + 'uniform' + chr(39), 'entity_id', 'i')} * 24)), v AS (SELECT DISTINCT entity_id, window_length || ':' || window_start AS view FROM un), a AS (SELECT *, row_number() OVER w - 1 AS at, count(*) OVER (PARTITION BY entity_id) AS k FROM v WINDOW w AS (PARTITION BY entity_id ORDER BY view)) SELECT epoch::INT AS epoch, a.entity_id, a.view, b.view AS partner FROM a, (SELECT unnest(range(3)) AS epoch), a b WHERE a.k > 1 AND b.entity_id = a.entity_id AND b.at = (a.at + 1 + epoch % (a.k - 1)) % a.k")
def partner_views(s, d):
    """For three epochs, another view of the same entity for each of its distinct uniform views."""
    from gapseries.operators import features as ft
    from gapseries.operators import views as vw

    from .queries import labels

    v = vw.uniform_views(labels(s, d), "entity_id", ft.windows(s)).select("entity_id", F.concat_ws(":", "window_length", "window_start").alias("view"))
    return dm.partner_views(v, "entity_id", "view", 3)
