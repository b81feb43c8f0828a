"""Spending classes, the classification table, classifiers and their scores."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import rnd as rnd_col
from ..functions import stable, stored
from ..operators import features, labels, profile
from ..operators.classify import models, neighbours, scores
from ..sources.retail import lines, stored_lines
from ..sources.schemas import CLASS_FEATURES
from .base import rnd, with_profile
from .clean_profile import PRICE_CATEGORY, min_max_sql

QUERIES = {}
ORACLE = {}


def _add(name, fn, sql=None):
    QUERIES[name] = fn
    if sql:
        ORACLE[name] = sql


MIN_BASKETS, CAP, HIGH = 5, 230000, 195000
START = (0.2, 0.5, 0.8)
STEPS = 4
# fixed values: class shares given as priors
PRIORS = (0.47017189, 0.38574317, 0.14408493)


def _profile(s, d):
    return profile.customer_profile(stored_lines(s, d))


def _classes(s, d):
    return labels.spending_classes(
        stored(_profile(s, d)), MIN_BASKETS, CAP, HIGH, start=START, steps=STEPS
    )


def _classes_sql() -> str:
    out = [
        f"el AS MATERIALIZED (SELECT * FROM profile WHERE frequency >= {MIN_BASKETS} AND mean_basket_sale < {CAP})",
        f"lo AS (SELECT * FROM el WHERE mean_basket_sale < {HIGH})",
        """sx AS MATERIALIZED (SELECT customer_id, (mean_basket_sale - min(mean_basket_sale) OVER ())
  / (max(mean_basket_sale) OVER () - min(mean_basket_sale) OVER ()) AS x FROM lo)""",
        "m0 AS (SELECT " + ", ".join(f"CAST({v} AS DOUBLE) AS x{j}" for j, v in enumerate(START)) + ")",
    ]
    for r in range(STEPS + 1):
        out.append(
            f"""a{r} AS MATERIALIZED (SELECT customer_id, x, CASE WHEN d0 <= d1 AND d0 <= d2 THEN 0 WHEN d1 <= d2 THEN 1 ELSE 2 END AS label
  FROM (SELECT customer_id, x, (x - x0) * (x - x0) AS d0, (x - x1) * (x - x1) AS d1, (x - x2) * (x - x2) AS d2 FROM sx, m{r}))"""
        )
        means = ", ".join(
            f"coalesce({rnd(f'avg(x) FILTER (label = {j})', 6)}, (SELECT x{j} FROM m{r})) AS x{j}" for j in range(3)
        )
        out.append(f"m{r + 1} AS MATERIALIZED (SELECT {means} FROM a{r})")
    out.append(
        f"""classes AS MATERIALIZED (SELECT el.*, CAST(coalesce(a{STEPS}.label, 2) AS INT) AS label FROM el LEFT JOIN a{STEPS} USING (customer_id))"""
    )
    return ",\n".join(out)


CLASSES = _classes_sql()
TABLE = f"""{CLASSES},
kl AS (SELECT * FROM lines WHERE customer_id IN (SELECT customer_id FROM classes)),
{PRICE_CATEGORY.replace('lines', 'kl').replace('catkl', 'catlines')},
ms AS (SELECT customer_id, {rnd('avg(m)', 2)} AS mean_item_sale_basket FROM (SELECT customer_id, basket_id,
  CAST(sum(sale) AS DOUBLE) / count(*) AS m FROM kl WHERE qta > 0 GROUP BY 1, 2) GROUP BY 1),
cq AS (SELECT customer_id, category, CAST(floor({rnd('avg(q)', 2)}) AS BIGINT) AS q FROM (SELECT customer_id, basket_id, category,
  sum(qta) AS q FROM catlines WHERE qta > 0 GROUP BY 1, 2, 3) GROUP BY 1, 2),
cw AS (SELECT customer_id, {', '.join(f'coalesce(max(q) FILTER (category = {i}), 0) AS cat{i}' for i in range(3))} FROM cq GROUP BY 1),
cls AS MATERIALIZED (SELECT customer_id, recency, frequency, mean_basket_items, e_prods, e_sale, e_baskets, e_intervals,
  purchasing_freq, mean_item_sale_basket, {', '.join(f"{rnd(f'CAST(cat{i} AS DOUBLE) / frequency', 2)} AS cat{i}" for i in range(3))}, label
  FROM classes JOIN ms USING (customer_id) JOIN cw USING (customer_id))"""

_add(
    "eligible_customers",
    lambda s, d: labels.eligible_customers(profile.basket_features(lines(s, d)), MIN_BASKETS, CAP).select(
        "customer_id", "frequency", "mean_basket_sale"
    ),
    with_profile(
        f"SELECT customer_id, frequency, mean_basket_sale FROM profile WHERE frequency >= {MIN_BASKETS} AND mean_basket_sale < {CAP}"
    ),
)
_add(
    "eligibility_report",
    lambda s, d: labels.eligibility_report(profile.basket_features(lines(s, d)), MIN_BASKETS, CAP),
    with_profile(
        f"""SELECT count(*) AS n_all, count(*) FILTER (frequency >= {MIN_BASKETS}) AS n_enough_baskets,
  count(*) FILTER (frequency >= {MIN_BASKETS} AND mean_basket_sale < {CAP}) AS n_eligible FROM profile"""
    ),
)
_add(
    "high_spenders",
    lambda s, d: labels.split_high_spenders(profile.basket_features(lines(s, d)), HIGH)[1].select("customer_id"),
    with_profile(f"SELECT customer_id FROM profile WHERE mean_basket_sale >= {HIGH}"),
)
_add(
    "spending_classes",
    lambda s, d: _classes(s, d).select("customer_id", "mean_basket_sale", F.col("label").cast("int").alias("label")),
    with_profile(f", {CLASSES} SELECT customer_id, mean_basket_sale, label FROM classes"),
)
_add(
    "spending_classes_restarts",
    lambda s, d: labels.spending_classes(
        stored(_profile(s, d)), MIN_BASKETS, CAP, HIGH, n_init=1000, max_iter=1000
    ).select("customer_id", "label"),
)
_add(
    "class_thresholds",
    lambda s, d: labels.class_thresholds(_classes(s, d)).withColumn("label", F.col("label").cast("int")),
    with_profile(
        f", {CLASSES} SELECT label, count(*) AS n, max(mean_basket_sale) AS max_mean_basket_sale FROM classes GROUP BY 1"
    ),
)
_add(
    "restrict_lines",
    lambda s, d: labels.restrict_lines(
        lines(s, d), labels.eligible_customers(profile.basket_features(lines(s, d)), MIN_BASKETS, CAP)
    ).select("basket_id", "prod_id", "qta"),
    with_profile(
        f"""SELECT basket_id, prod_id, qta FROM lines WHERE customer_id IN
  (SELECT customer_id FROM profile WHERE frequency >= {MIN_BASKETS} AND mean_basket_sale < {CAP})"""
    ),
)
_add(
    "mean_item_sale_basket",
    lambda s, d: labels.mean_item_sale_basket(lines(s, d)),
    with_profile(
        f"""SELECT customer_id, {rnd('avg(m)', 2)} AS mean_item_sale_basket FROM (SELECT customer_id, basket_id,
  CAST(sum(sale) AS DOUBLE) / count(*) AS m FROM lines WHERE qta > 0 GROUP BY 1, 2) GROUP BY 1"""
    ),
)
_add(
    "category_quantity",
    lambda s, d: labels.category_quantity(lines(s, d)),
    with_profile(
        f""", {PRICE_CATEGORY},
cq AS (SELECT customer_id, category, CAST(floor({rnd('avg(q)', 2)}) AS BIGINT) AS q FROM (SELECT customer_id, basket_id, category,
  sum(qta) AS q FROM catlines WHERE qta > 0 GROUP BY 1, 2, 3) GROUP BY 1, 2)
SELECT customer_id, {', '.join(f'coalesce(max(q) FILTER (category = {i}), 0) AS cat{i}' for i in range(3))} FROM cq GROUP BY 1"""
    ),
)


def _table(s, d):
    rows = stored_lines(s, d)
    classes = labels.spending_classes(
        stored(profile.customer_profile(rows)), MIN_BASKETS, CAP, HIGH, start=START, steps=STEPS
    )
    return stored(labels.classification_table(classes, rows))


_add("classification_table", _table, with_profile(f", {TABLE} SELECT * FROM cls"))
_add(
    "class_weights_balanced",
    lambda s, d: features.class_weights(_classes(s, d).select(F.col("label").cast("int").alias("label"))),
    with_profile(
        f""", {CLASSES}, g AS (SELECT label, count(*) AS n FROM classes GROUP BY 1)
SELECT label, n, {rnd('CAST(sum(n) OVER () AS DOUBLE) / (count(*) OVER () * n)', 6)} AS weight FROM g"""
    ),
)

# scaled features and the split
SPLIT = f"""{TABLE},
hs AS (SELECT *, row_number() OVER (PARTITION BY label ORDER BY md5('22:' || CAST(customer_id AS VARCHAR)), customer_id) - 1 AS pos,
  count(*) OVER (PARTITION BY label) AS sz FROM cls),
sp AS MATERIALIZED (SELECT * EXCLUDE (pos, sz), CASE WHEN pos < floor(sz * CAST(0.3 AS DOUBLE) + 0.5) THEN 'test' ELSE 'train' END AS split FROM hs),
mm2 AS MATERIALIZED ({min_max_sql(CLASS_FEATURES, 'sp')}),
scd AS MATERIALIZED (SELECT mm2.*, label, split FROM mm2 JOIN sp USING (customer_id))"""


def _split(s, d):
    return features.stratified_split(_table(s, d))


def _scaled_split(s, d):
    # the published order: scale first, split afterwards
    return stable(features.min_max_scale(_split(s, d), CLASS_FEATURES))


def _sets(s, d):
    both = _scaled_split(s, d)
    return both.where("split = 'train'").drop("split"), both.where("split = 'test'").drop("split")


_add(
    "stratified_split",
    lambda s, d: _split(s, d).select("customer_id", "label", "split"),
    with_profile(f", {SPLIT} SELECT customer_id, label, split FROM sp"),
)


def _nb_sql() -> str:
    stats = ", ".join(f"avg({f}) AS m_{f}, var_pop({f}) AS v_{f}" for f in CLASS_FEATURES)
    floor = "1e-9 * greatest(" + ", ".join(f"var_pop({f})" for f in CLASS_FEATURES) + ")"
    like = " ".join(
        f"- 0.5 * ln(2 * pi() * (v_{f} + fl)) - (t.{f} - m_{f}) * (t.{f} - m_{f}) / (2 * (v_{f} + fl))" for f in CLASS_FEATURES
    )
    prior = " ".join(f"WHEN {i} THEN ln(CAST({p} AS DOUBLE))" for i, p in enumerate(PRIORS))
    return f"""{SPLIT},
nbs AS (SELECT label AS c, {stats} FROM scd WHERE split = 'train' GROUP BY 1),
nbf AS (SELECT {floor} AS fl FROM scd WHERE split = 'train'),
nbl AS (SELECT t.customer_id, t.label, c, CASE c {prior} END {like} AS ll FROM scd t, nbs, nbf WHERE split = 'test'),
nb AS MATERIALIZED (SELECT customer_id, label, c AS prediction FROM nbl
  QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY ll DESC, c) = 1)"""


NB = _nb_sql()


def _nb(s, d):
    train, test = _sets(s, d)
    return stable(models.gaussian_nb(train, test, CLASS_FEATURES, PRIORS))


_add(
    "naive_bayes",
    lambda s, d: _nb(s, d).select("customer_id", "label", "prediction"),
    with_profile(f", {NB} SELECT customer_id, label, prediction FROM nb"),
)
_add(
    "naive_bayes_log_likelihood",
    lambda s, d: _nb(s, d).select("customer_id", *[rnd_col(F.col("scores")[i], 4).alias(f"s{i}") for i in range(3)]),
    with_profile(
        f", {NB} SELECT customer_id, "
        + ", ".join(f"{rnd(f'max(ll) FILTER (c = {i})', 4)} AS s{i}" for i in range(3))
        + " FROM nbl GROUP BY 1"
    ),
)


def _knn_sql(k: int, p: int, weights: str) -> str:
    diffs = [f"(a.{f} - b.{f})" for f in CLASS_FEATURES]
    dist = " + ".join(f"abs({x})" for x in diffs) if p == 1 else "sqrt(" + " + ".join(f"{x} * {x}" for x in diffs) + ")"
    if weights == "uniform":
        order = "count(*) DESC"
    else:
        order = f"count(*) FILTER (d = 0) DESC, {rnd('coalesce(sum(1.0 / d) FILTER (d > 0), 0)', 9)} DESC"
    return f"""{SPLIT},
nn AS MATERIALIZED (SELECT a.customer_id, a.label, b.label AS c, {dist} AS d FROM scd a JOIN scd b
  ON a.split = 'test' AND b.split = 'train'
  QUALIFY row_number() OVER (PARTITION BY a.customer_id ORDER BY d, b.customer_id) <= {k}),
kn AS MATERIALIZED (SELECT customer_id, label, c AS prediction FROM nn GROUP BY 1, 2, 3
  QUALIFY row_number() OVER (PARTITION BY customer_id ORDER BY {order}, c) = 1)"""


def _knn(s, d, k=9, p=1, weights="distance"):
    train, test = _sets(s, d)
    return neighbours.knn_classify(train, test, CLASS_FEATURES, k, p, weights)


KNN = _knn_sql(9, 1, "distance")
_add("knn_manhattan_distance", _knn, with_profile(f", {KNN} SELECT * FROM kn"))
_add(
    "knn_euclidean_uniform",
    lambda s, d: _knn(s, d, 12, 2, "uniform"),
    with_profile(f", {_knn_sql(12, 2, 'uniform')} SELECT * FROM kn"),
)


def _score_sql(rel: str) -> str:
    return f"""cm AS (SELECT label, prediction, count(*) AS n FROM {rel} GROUP BY 1, 2),
pcl AS (SELECT c, coalesce((SELECT sum(n) FROM cm WHERE label = c AND prediction = c), 0) AS hits,
  coalesce((SELECT sum(n) FROM cm WHERE prediction = c), 0) AS predicted, coalesce((SELECT sum(n) FROM cm WHERE label = c), 0) AS support
  FROM (SELECT DISTINCT unnest([label, prediction]) AS c FROM cm)),
pr AS (SELECT c, coalesce(hits / nullif(CAST(predicted AS DOUBLE), 0), 0) AS precision, coalesce(hits / nullif(CAST(support AS DOUBLE), 0), 0) AS recall, support FROM pcl),
cs AS (SELECT c, precision, recall, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0) AS f1, support FROM pr)"""


_add(
    "classification_scores",
    lambda s, d: scores.classification_scores(_nb(s, d)),
    with_profile(
        f""", {NB}, {_score_sql('nb')} SELECT {rnd('sum(recall * support) / sum(support)', 6)} AS accuracy,
  {rnd('sum(precision * support) / sum(support)', 6)} AS precision, {rnd('sum(recall * support) / sum(support)', 6)} AS recall,
  {rnd('sum(f1 * support) / sum(support)', 6)} AS f1, CAST(sum(support) AS BIGINT) AS support FROM cs"""
    ),
)
_add(
    "class_scores",
    lambda s, d: scores.class_scores(_knn(s, d)).select(
        "class", *[rnd_col(c, 6).alias(c) for c in ("precision", "recall", "f1")], "support"
    ),
    with_profile(
        f""", {KNN}, {_score_sql('kn')} SELECT c AS class, {rnd('precision', 6)} AS precision, {rnd('recall', 6)} AS recall,
  {rnd('f1', 6)} AS f1, CAST(support AS BIGINT) AS support FROM cs"""
    ),
)
_add(
    "confusion_matrix",
    lambda s, d: scores.confusion_matrix(_knn(s, d)),
    with_profile(
        f", {KNN} SELECT label, "
        + ", ".join(f"count(*) FILTER (prediction = {c}) AS pred_{c}" for c in range(3))
        + " FROM kn GROUP BY 1"
    ),
)


def _roc_input(s, d):
    # one feature per class as its score keeps the curve independent of a trained model
    return _table(s, d).select(
        "label", F.array(-F.col("mean_basket_items"), F.col("e_prods"), F.col("mean_basket_items")).cast("array<double>").alias("scores")
    )


ROC = f"""{TABLE},
sc3 AS (SELECT label, unnest([0, 1, 2]) AS c, unnest([CAST(-mean_basket_items AS DOUBLE), e_prods, CAST(mean_basket_items AS DOUBLE)]) AS score FROM cls),
rin AS (SELECT CAST(c AS VARCHAR) AS curve, score, label = c AS hit FROM sc3 UNION ALL SELECT 'micro', score, label = c FROM sc3),
rg AS (SELECT curve, score, count(*) FILTER (hit) AS pos, count(*) FILTER (NOT hit) AS neg FROM rin GROUP BY 1, 2),
rc AS (SELECT curve, score, pos, neg, CAST(sum(pos) OVER w AS DOUBLE) AS tp, CAST(sum(neg) OVER w AS DOUBLE) AS fp,
  CAST(sum(pos) OVER (PARTITION BY curve) AS DOUBLE) AS p, CAST(sum(neg) OVER (PARTITION BY curve) AS DOUBLE) AS n
  FROM rg WINDOW w AS (PARTITION BY curve ORDER BY score DESC ROWS UNBOUNDED PRECEDING)),
roc AS MATERIALIZED (SELECT curve, score AS threshold, fp / n AS fpr, tp / p AS tpr, neg * (2 * tp - pos) / (2.0 * p * n) AS part FROM rc)"""
_add(
    "roc_curve",
    lambda s, d: scores.roc_curve(_roc_input(s, d)).select(
        "curve", "threshold", rnd_col("fpr", 6).alias("fpr"), rnd_col("tpr", 6).alias("tpr")
    ),
    with_profile(f", {ROC} SELECT curve, threshold, {rnd('fpr', 6)} AS fpr, {rnd('tpr', 6)} AS tpr FROM roc"),
)
_add(
    "roc_area",
    lambda s, d: scores.roc_area(stable(scores.roc_curve(_roc_input(s, d)))),
    with_profile(
        f""", {ROC}, kt AS (SELECT curve, fpr, min(tpr) AS low, max(tpr) AS high FROM
  (SELECT curve, fpr, tpr FROM roc WHERE curve <> 'micro' UNION ALL SELECT DISTINCT curve, 0.0, 0.0 FROM roc WHERE curve <> 'micro') GROUP BY 1, 2),
gr AS (SELECT DISTINCT fpr AS x FROM kt),
iv AS (SELECT curve, fpr AS x0, high AS y0, lead(fpr) OVER (PARTITION BY curve ORDER BY fpr) AS x1,
  lead(low) OVER (PARTITION BY curve ORDER BY fpr) AS y1 FROM kt),
ipo AS (SELECT x, curve, CASE WHEN x = x0 THEN y0 ELSE y0 + (y1 - y0) / (x1 - x0) * (x - x0) END AS y
  FROM gr JOIN iv ON x = x0 OR (x > x0 AND x < x1)),
mc2 AS (SELECT x, avg(y) AS y FROM ipo GROUP BY 1),
ar AS (SELECT (x - lag(x) OVER (ORDER BY x)) * (y + lag(y) OVER (ORDER BY x)) / 2 AS a FROM mc2)
SELECT curve, {rnd('sum(part)', 6)} AS area FROM roc GROUP BY 1 UNION ALL SELECT 'macro', {rnd('sum(a)', 6)} FROM ar"""
    ),
)

# ---- oversampling ---------------------------------------------------------------------------------


def _smote(s, d):
    train, _ = _sets(s, d)
    return stable(neighbours.smote(train, CLASS_FEATURES))


def _unit(c: str, tag: str, j: str) -> str:
    text = f"'22:' || {c} || ':{tag}:' || {j}"
    return f"CAST(CAST('0x' || substr(md5({text}), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0"


_F2 = " + ".join(f"(a.{f} - b.{f}) * (a.{f} - b.{f})" for f in CLASS_FEATURES)
_add(
    "smote",
    lambda s, d: _smote(s, d).select(
        "base", F.coalesce("synthetic", F.lit(-1)).alias("synthetic"), "label", *[rnd_col(c, 6).alias(c) for c in CLASS_FEATURES]
    ),
    with_profile(
        f""", {SPLIT}, tr AS MATERIALIZED (SELECT * EXCLUDE (split) FROM scd WHERE split = 'train'),
cz AS (SELECT label, count(*) AS n, max(count(*)) OVER () AS mx FROM tr GROUP BY 1),
nb5 AS MATERIALIZED (SELECT a.customer_id AS base, a.label, b.customer_id AS other,
  row_number() OVER (PARTITION BY a.customer_id ORDER BY sqrt({_F2}), b.customer_id) AS r
  FROM tr a JOIN tr b ON a.label = b.label AND a.customer_id <> b.customer_id QUALIFY r <= 5),
bp AS (SELECT tr.customer_id AS base, tr.label, row_number() OVER (PARTITION BY tr.label ORDER BY tr.customer_id) - 1 AS pos FROM tr),
js AS (SELECT label, n, unnest(range(0, mx - n)) AS j FROM cz),
pl3 AS (SELECT bp.base, js.label, j, CAST(floor({_unit('js.label', 'n', 'j')} * 5) AS BIGINT) + 1 AS r, {_unit('js.label', 'u', 'j')} AS u
  FROM js JOIN bp ON bp.label = js.label AND bp.pos = j % n)
SELECT customer_id AS base, CAST(-1 AS BIGINT) AS synthetic, label, {', '.join(f'{rnd(f, 6)} AS {f}' for f in CLASS_FEATURES)} FROM tr
UNION ALL SELECT pl3.base, j, pl3.label, {', '.join(f"{rnd(f'b.{f} + u * (o.{f} - b.{f})', 6)} AS {f}" for f in CLASS_FEATURES)}
FROM pl3 JOIN nb5 ON nb5.base = pl3.base AND nb5.r = pl3.r JOIN tr b ON b.customer_id = pl3.base JOIN tr o ON o.customer_id = other"""
    ),
)

# ---- trained models -------------------------------------------------------------------------------


def _balanced(s, d):
    """Oversampled training set (a synthetic row gets its own key) and test set."""
    train, test = _sets(s, d)
    more = neighbours.smote(train, CLASS_FEATURES)
    key = F.when(F.col("synthetic").isNull(), F.col("base")).otherwise(-1 - F.col("label") * 1_000_000_000 - F.col("synthetic"))
    return stable(more.select(key.cast("long").alias("customer_id"), *CLASS_FEATURES, "label")), test


def _tree_scores(s, d):
    train, test = _balanced(s, d)
    return models.train_test_scores(models.decision_tree(train, CLASS_FEATURES), train, test)


def _forest_scores(s, d):
    train, test = _balanced(s, d)
    return models.train_test_scores(models.random_forest(train, CLASS_FEATURES, max_depth=10), train, test)


def _leaves(s, d):
    train, _ = _sets(s, d)
    model = models.decision_tree(train, CLASS_FEATURES, impurity="entropy", max_depth=4, weights=None)
    return models.leaf_profile(model, train, CLASS_FEATURES)


def _svm(s, d):
    train, test = _sets(s, d)
    (out,) = models.rbf_svm(train, [test], CLASS_FEATURES)
    return out


def _mlp_scores(s, d):
    train, test = _sets(s, d)
    model, _ = models.mlp(train, CLASS_FEATURES)
    return models.train_test_scores(model, train, test)


# the published settings that Spark's trees have
TREE_GRID = {"impurity": ["gini", "entropy"], "maxDepth": list(range(10, 31))}
FOREST_GRID = {
    "impurity": ["entropy", "gini"],
    "maxDepth": list(range(2, 20)),
    "minInstancesPerNode": list(range(1, 10)),
    "bootstrap": [True, False],
}
CLASS_WEIGHTS = {"balanced": "balanced", "none": None, "0.1 0.3 0.6": {0: 0.1, 1: 0.3, 2: 0.6}}


def _weighted_search(train, estimator, grid):
    parts = [
        models.grid_search(train, CLASS_FEATURES, estimator, grid, weights)[1].withColumn(
            "setting", F.concat("setting", F.lit(f", weights={name}"))
        )
        for name, weights in CLASS_WEIGHTS.items()
    ]
    return reduce(DataFrame.unionByName, parts).orderBy(F.desc("accuracy"), "setting")


def _grid(s, d):
    train, _ = _sets(s, d)
    return _weighted_search(train, "decision_tree", TREE_GRID)


def _knn_grid(s, d):
    train, _ = _sets(s, d)
    return neighbours.knn_grid_search(models.stratified_folds(train), CLASS_FEATURES, ks=(*range(1, 16), 20, 30))


def _forest_grid(s, d):
    train, _ = _sets(s, d)
    return _weighted_search(train, "random_forest", FOREST_GRID)


_add("decision_tree_scores", _tree_scores)
_add("random_forest_scores", _forest_scores)
_add("tree_leaf_profile", _leaves)
_add("rbf_svm", _svm)
_add("mlp_scores", _mlp_scores)
_add("grid_search_decision_tree", _grid)
_add("grid_search_knn", _knn_grid)
_add("grid_search_random_forest", _forest_grid)
