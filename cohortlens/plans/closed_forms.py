"""Registered queries that compare fits, folds, resampling, sources and sinks with what SQL can say on its own.

Every order is a row: whether it is finished is the label, its priority the predictor. A logistic fit on
one binary term, or on all levels of a category, has a closed form in the counts of the table.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from cohortlens.operators import anomaly, boosting, correlation, distributions, encode, folds, importance, linear, oof, phenotypes, regression, resample
from cohortlens.plans import fixtures as X, oracle as O
from cohortlens.plans.queries import query, rounded
from cohortlens.session import materialize, scratch_path
from cohortlens.sources import tables as S

KEY = "o_orderkey"
_ROWS = """
WITH r AS (SELECT o_orderkey, (o_orderstatus = 'F')::INTEGER AS y, (o_orderpriority = '1-URGENT')::INTEGER AS urgent, o_orderpriority AS priority FROM orders),
c AS (SELECT sum(y * urgent)::DOUBLE AS a, sum((1 - y) * urgent)::DOUBLE AS b, sum(y * (1 - urgent))::DOUBLE AS c, sum((1 - y) * (1 - urgent))::DOUBLE AS d FROM r)"""
_LIKELIHOOD = "(SELECT sum(n1 * ln(n1 / n) + (n - n1) * ln(1 - n1 / n)) FROM (SELECT sum(y)::DOUBLE AS n1, count(*) AS n FROM r {by}))"


def finished_orders(spark: SparkSession, sf: str) -> DataFrame:
    """(key, y, one 0/1 column per priority but the fourth)."""
    named = {"urgent": "1-URGENT", "high": "2-HIGH", "medium": "3-MEDIUM", "low": "5-LOW"}
    return X.table(spark, sf, "orders").select(
        KEY, "o_totalprice", (F.col("o_orderstatus") == "F").cast("int").alias("y"),
        *[(F.col("o_orderpriority") == v).cast("int").alias(n) for n, v in named.items()])


# ---------------------------------------------------------------- regression

@query("logit_two_by_two", _ROWS + """,
t AS (SELECT 'const' AS term, ln(c / d) AS coef, sqrt(1 / c + 1 / d) AS se FROM c
  UNION ALL SELECT 'urgent', ln(a * d / (b * c)), sqrt(1 / a + 1 / b + 1 / c + 1 / d) FROM c)
SELECT 'y' AS outcome, term, round(coef, 5) AS coef, round(exp(coef), 5) AS odds_ratio,
  round(exp(coef - 1.959963984540054 * se), 5) AS ci_low, round(exp(coef + 1.959963984540054 * se), 5) AS ci_high,
  round(""" + O.chi2_tail("(coef / se) ** 2", "1") + """, 5) AS p_value FROM t""")
def logit_two_by_two(spark, sf):
    fit = regression.fit_logit(finished_orders(spark, sf), "y", ["urgent"])
    return rounded(regression.odds_table(spark, [fit]), 5)


@query("logit_likelihood", _ROWS + f"""
SELECT 'y' AS outcome, (SELECT count(*) FROM r) AS n, 1::INTEGER AS df_model, round(l, 4) AS loglik, round(l0, 4) AS null_loglik,
  round(1 - l / l0, 4) AS mcfadden_r2
FROM (SELECT {_LIKELIHOOD.format(by="GROUP BY urgent")} AS l, {_LIKELIHOOD.format(by="")} AS l0)""")
def logit_likelihood(spark, sf):
    fit = regression.fit_logit(finished_orders(spark, sf), "y", ["urgent"])
    return rounded(regression.fit_statistics(spark, [fit]), 4)


@query("nested_priorities", _ROWS + f"""
SELECT 'y' AS outcome, 'other_levels' AS comparison, (SELECT count(*) FROM r) AS n, 3::INTEGER AS df, round(lr, 4) AS lr_statistic,
  round({O.chi2_tail("lr", "3")}, 4) AS p_value
FROM (SELECT 2 * ({_LIKELIHOOD.format(by="GROUP BY priority")} - {_LIKELIHOOD.format(by="GROUP BY urgent")}) AS lr)""")
def nested_priorities(spark, sf):
    """One level against the rest, then all levels of the category."""
    steps = {"one_level": ["urgent"], "other_levels": ["high", "medium", "low"]}
    return rounded(regression.nested_table(finished_orders(spark, sf), "y", steps, []), 4)


@query("calibration_two_scores", _ROWS + """
SELECT 'score' AS model, round((ln(a / b) + ln(c / d)) / 2, 5) AS calibration_intercept,
  round((ln(a / b) - ln(c / d)) / (2 * ln(1.5::DOUBLE)), 5) AS calibration_slope FROM c""")
def calibration_two_scores(spark, sf):
    """A probability of two values: the line runs through the logits of both observed rates."""
    df = finished_orders(spark, sf).select("y", F.when(F.col("urgent") == 1, 0.6).otherwise(0.4).alias("score"))
    return rounded(regression.calibration_line(df, "y", ["score"]), 5)


@query("inflation_of_two", """
SELECT unnest(['l_quantity', 'l_extendedprice']) AS feature, round(v, 6) AS vif,
  CASE WHEN v < 5 THEN 'ok' WHEN v < 10 THEN 'elevated' ELSE 'severe' END AS flag
FROM (SELECT 1 / (1 - corr(l_quantity, l_extendedprice) ** 2) AS v FROM lineitem)""")
def inflation_of_two(spark, sf):
    return rounded(correlation.variance_inflation(X.table(spark, sf, "lineitem"), ["l_quantity", "l_extendedprice"]))


@query("normal_fits", """
WITH s AS (SELECT count(*)::DOUBLE AS n, var_pop(l_extendedprice) AS v, var_pop(ln(l_extendedprice)) AS vl, sum(ln(l_extendedprice)) AS sl
  FROM lineitem WHERE l_extendedprice > 0),
l AS (SELECT 'normal' AS distribution, n, -n / 2 * (ln(2 * pi() * v) + 1) AS ll FROM s
  UNION ALL SELECT 'lognormal', n, -n / 2 * (ln(2 * pi() * vl) + 1) - sl FROM s)
SELECT distribution, 2::INTEGER AS n_params, round(ll, 2) AS loglik, round(4 - 2 * ll, 2) AS aic, round(2 * ln(n) - 2 * ll, 2) AS bic FROM l""")
def normal_fits(spark, sf):
    """The two families whose likelihood is a formula of mean and variance."""
    fits = distributions.continuous_fits(X.table(spark, sf, "lineitem"), "l_extendedprice")
    return rounded(fits.where(F.col("distribution").isin("normal", "lognormal")).drop("ks_stat", "delta_aic"), 2)


@query("shape_fits", """
WITH RECURSIVE h AS (SELECT l_extendedprice AS x, count(*)::DOUBLE AS w FROM lineitem WHERE l_extendedprice > 0 GROUP BY 1),
s AS (SELECT sum(w) AS n, sum(w * x) / sum(w) AS m, sum(w * ln(x)) AS sl, max(x) AS top FROM h),
z AS (SELECT ln(x / top) AS lz, w FROM h, s),
weibull(i, low, high) AS (
  SELECT 0, 0.01::DOUBLE, 100.0::DOUBLE
  UNION ALL SELECT i + 1, CASE WHEN f < 0 THEN k ELSE low END, CASE WHEN f < 0 THEN high ELSE k END
  FROM (SELECT i, low, high, k, sum(w * exp(k * lz) * lz) / sum(w * exp(k * lz)) - 1 / k - any_value(sl / n - ln(top)) AS f
        FROM (SELECT i, low, high, sqrt(low * high) AS k FROM weibull WHERE i < 60), z, s GROUP BY i, low, high, k)),
gamma(i, low, high) AS (
  SELECT 0, 0.01::DOUBLE, 10000.0::DOUBLE
  UNION ALL SELECT i + 1, CASE WHEN f > 0 THEN a ELSE low END, CASE WHEN f > 0 THEN high ELSE a END
  FROM (SELECT i, low, high, a, ln(a) - (ln(b) - 1 / (2 * b) - 1 / (12 * b ** 2) + 1 / (120 * b ** 4) - 1 / (252 * b ** 6) + 1 / (240 * b ** 8)
          - list_sum([1 / (a + j) FOR j IN range(12)])) - (ln(m) - sl / n) AS f
        FROM (SELECT i, low, high, sqrt(low * high) AS a, sqrt(low * high) + 12 AS b FROM gamma WHERE i < 60), s)),
k AS (SELECT sqrt(low * high) AS k FROM weibull WHERE i = 60), a AS (SELECT sqrt(low * high) AS a FROM gamma WHERE i = 60),
scale AS (SELECT any_value(top) * (sum(w * exp(k * lz)) / any_value(n)) ** (1 / any_value(k)) AS scale FROM z, k, s),
cdf AS (SELECT 1 - exp(-((x / scale) ** k)) AS p, sum(w) OVER (ORDER BY x) / n AS high, (sum(w) OVER (ORDER BY x) - w) / n AS low FROM h, k, scale, s),
ks AS (SELECT max(greatest(abs(high - p), abs(p - low))) AS ks FROM cdf),
l AS (SELECT 'gamma' AS distribution, n, (a - 1) * sl - n * a - n * (a * ln(m / a) + lgamma(a)) AS ll, NULL::DOUBLE AS ks FROM s, a
  UNION ALL SELECT 'weibull', n, n * (ln(k) - k * ln(scale)) + (k - 1) * sl - n, ks FROM s, k, scale, ks)
SELECT distribution, 2::INTEGER AS n_params, round(ll, 2) AS loglik, round(4 - 2 * ll, 2) AS aic, round(2 * ln(n) - 2 * ll, 2) AS bic, round(ks, 5) AS weibull_ks FROM l""")
def shape_fits(spark, sf):
    """The two families whose shape solves an equation, which the comparison bisects; the distance of the one with a plain distribution function."""
    fits = distributions.continuous_fits(X.table(spark, sf, "lineitem"), "l_extendedprice").where(F.col("distribution").isin("gamma", "weibull"))
    ks = F.when(F.col("distribution") == "weibull", F.round("ks_stat", 5)).alias("weibull_ks")
    return fits.select("distribution", "n_params", *[F.round(c, 2).alias(c) for c in ("loglik", "aic", "bic")], ks)


# ---------------------------------------------------------------- folds, out-of-fold scores, resampling

@query("joint_fold_balance", _ROWS + """
SELECT y, urgent, count(*) AS n, (count(*) // 5)::BIGINT AS least, ((count(*) + 4) // 5)::BIGINT AS most FROM r GROUP BY 1, 2""")
def joint_fold_balance(spark, sf):
    """Per pattern of both labels: the smallest and largest fold."""
    dealt = folds.joint_folds(finished_orders(spark, sf).select(KEY, "y", "urgent"), KEY, ["y", "urgent"])
    by_fold = [F.count_if(F.col("fold") == k) for k in range(folds.N_FOLDS)]
    return dealt.groupBy("y", "urgent").agg(
        F.count(F.lit(1)).alias("n"), F.least(*by_fold).alias("least"), F.greatest(*by_fold).alias("most"))


@query("oof_rates", _ROWS + """,
f AS (SELECT (o_orderkey % 5)::INTEGER AS fold, urgent, count(*) AS n, sum(y) AS k FROM r GROUP BY 1, 2)
SELECT f.fold, f.urgent, any_value(f.n) AS n, round(sum(o.k)::DOUBLE / sum(o.n), 6) AS rate_of_other_folds, true AS score_is_rate
FROM f JOIN f o ON o.urgent = f.urgent AND o.fold <> f.fold GROUP BY 1, 2""")
def oof_rates(spark, sf):
    """With one binary predictor and next to no penalty, a row's score is the rate among the other folds' like rows."""
    df = finished_orders(spark, sf).select(KEY, "y", "urgent", F.pmod(F.col(KEY), F.lit(5)).cast("int").alias("fold"))
    scored = oof.out_of_fold(df, "fold", "y", KEY, lambda: [encode.FeatureEncoder([], ["urgent"], [])],
                             {"p": lambda n, pos: [oof.logistic("y", n, c=1e9)]})
    cells = scored.join(df.select(KEY, "urgent"), KEY).groupBy("fold", "urgent").agg(
        F.count(F.lit(1)).alias("n"), F.sum("y").alias("k"), F.min("p").alias("low"), F.max("p").alias("high"))
    other = cells.select(F.col("fold").alias("f"), F.col("urgent").alias("u"), F.col("n").alias("on"), F.col("k").alias("ok"))
    met = cells.join(other, (F.col("u") == F.col("urgent")) & (F.col("f") != F.col("fold")))
    rate = F.sum("ok") / F.sum("on")
    return met.groupBy("fold", "urgent").agg(
        F.first("n").alias("n"), F.round(rate, 6).alias("rate_of_other_folds"),
        ((F.abs(F.min("low") - rate) < 1e-4) & (F.abs(F.max("high") - rate) < 1e-4)).alias("score_is_rate"))


@query("bootstrap_identities", """
SELECT 'score - same' AS comparison, 0.0::DOUBLE AS mean_diff, 0.0::DOUBLE AS ci_low, 0.0::DOUBLE AS ci_high, false AS excludes_zero
UNION ALL SELECT 'perfect', 1.0, 1.0, 1.0, true""")
def bootstrap_identities(spark, sf):
    """Equal scores differ by nothing in any draw, and a perfect score keeps an average precision of one."""
    urgent = F.when(F.col("urgent") == 1, 0.7).otherwise(0.3)
    df = finished_orders(spark, sf).select(KEY, "y", urgent.alias("score"), urgent.alias("same"), F.col("y").cast("double").alias("perfect"))
    draws = resample.bootstrap_ap(df, KEY, "y", ["score", "same", "perfect"])
    same = resample.paired_differences(draws, [("score", "same")])
    perfect = resample.draw_intervals(draws).where("model = 'perfect'").join(
        draws.where("model = 'perfect'").groupBy("model").agg(F.avg("pr_auc").alias("mean")), "model")
    return rounded(same.unionByName(perfect.select(
        F.col("model").alias("comparison"), F.col("mean").alias("mean_diff"), "ci_low", "ci_high", (F.col("ci_low") > 0).alias("excludes_zero"))))


@query("sample_facts", "SELECT least(count(*), 1000) AS n, least(count(*), 1000) AS n_keys, 0::BIGINT AS strangers FROM orders")
def sample_facts(spark, sf):
    """Size of a seeded sample without replacement, its distinct keys, and keys that are not in the table."""
    orders = X.table(spark, sf, "orders")
    known = orders.select(KEY, F.lit(True).alias("known"))
    drawn = folds.hash_sample(orders, KEY, 1_000).join(known, KEY, "left")
    return drawn.agg(F.count(F.lit(1)).alias("n"), F.count_distinct(KEY).alias("n_keys"), F.count_if(F.col("known").isNull()).alias("strangers"))


@query("shapley_additivity", "SELECT count(*) AS n, 0.0::DOUBLE AS max_additivity_error FROM orders")
def shapley_additivity(spark, sf):
    """Base value plus contributions gives the score of every row."""
    df = finished_orders(spark, sf)
    rows = materialize(df.select(F.lit("all").alias("model"), KEY, F.col("y").alias("label"), F.lit(True).alias("train"),
                                 F.array("o_totalprice", F.col("urgent").cast("double"), F.col("low").cast("double")).alias("features")))
    models, _ = boosting.fit_boosted(rows, KEY)
    phi = importance.shapley_contributions(rows, KEY, models["all"])
    total = F.aggregate("phi", F.lit(0.0), lambda a, v: a + v)
    return phi.agg(F.count(F.lit(1)).alias("n"), F.round(F.max(F.abs(F.col("base") + total - F.col("p"))), 9).alias("max_additivity_error"))


@query("boosted_stumps", _ROWS + """,
f AS (SELECT (o_orderkey % 5)::INTEGER AS fold, urgent, count(*) AS n, sum(y) AS k FROM r GROUP BY 1, 2),
t AS (SELECT f.fold, f.urgent, any_value(f.n) AS held_out, sum(o.n)::DOUBLE AS n, sum(o.k)::DOUBLE AS k FROM f JOIN f o ON o.urgent = f.urgent AND o.fold <> f.fold GROUP BY 1, 2),
m0 AS (SELECT *, sum(k) OVER (PARTITION BY fold) / sum(n) OVER (PARTITION BY fold) AS p FROM t),
m1 AS (SELECT *, ln(p / (1 - p)) - 0.5 * (n * p - k) / (n * p * (1 - p) + 1) AS m FROM m0),
m2 AS (SELECT *, 1 / (1 + exp(-m)) AS q FROM m1),
m3 AS (SELECT *, m - 0.5 * (n * q - k) / (n * q * (1 - q) + 1) AS last FROM m2)
SELECT fold, urgent, held_out AS n, round(1 / (1 + exp(-last)), 6) AS low, round(1 / (1 + exp(-last)), 6) AS high FROM m3""")
def boosted_stumps(spark, sf):
    """Two rounds of one-split trees on a binary feature, out of fold: the leaves follow from the other folds' counts."""
    df = finished_orders(spark, sf).select(KEY, "y", "urgent", F.pmod(F.col(KEY), F.lit(5)).cast("int").alias("fold"))
    one_split = boosting.Settings(rounds=2, depth=1, rate=0.5, rows=1.0, columns=1.0, least_weight=0.0)
    scored = oof.out_of_fold(df, "fold", "y", KEY, lambda: [encode.FeatureEncoder([], ["urgent"], [])], {"p": one_split})
    return scored.join(df.select(KEY, "urgent"), KEY).groupBy("fold", "urgent").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.min("p"), 6).alias("low"), F.round(F.max("p"), 6).alias("high"))


@query("forest_walk", "SELECT count(*) AS n, 0.0::DOUBLE AS max_difference, true AS scores_differ_among_rows FROM orders")
def forest_walk(spark, sf):
    """Every row's forest score against the walk through the written node table in joins."""
    df = materialize(X.table(spark, sf, "orders").select(KEY, "o_totalprice", F.col("o_custkey").cast("double").alias("customer")))
    model = anomaly.IsolationForest(["o_totalprice", "customer"], KEY, trees=50).fit(df)
    both = model.transform(df).select(KEY, F.col("anomaly_score").alias("scored")).join(anomaly.walked_scores(df, KEY, model), KEY)
    return both.agg(F.count(F.lit(1)).alias("n"), F.round(F.max(F.abs(F.col("scored") - F.col("anomaly_score"))), 9).alias("max_difference"),
                    (F.stddev("scored") > 0.001).alias("scores_differ_among_rows"))


@query("two_clusters", """
SELECT (o_orderpriority = '1-URGENT')::INTEGER AS urgent, count(*) AS n, count(*) FILTER (WHERE o_orderstatus = 'F') AS events, 1.0::DOUBLE AS silhouette
FROM orders GROUP BY 1""")
def two_clusters(spark, sf):
    """A feature of two values falls into two clusters without spread, which are chosen among two and three."""
    df = materialize(finished_orders(spark, sf).select(KEY, "y", F.col("urgent").cast("double").alias("urgent")))
    selection, assigned, _ = phenotypes.phenotypes(df, KEY, "y", ["urgent"], ks=[2, 3], restarts=3)
    top = selection.where("k = 2").select(F.round("silhouette", 9).alias("silhouette"))
    cells = assigned.join(df.select(KEY, F.col("urgent").cast("int").alias("urgent")), KEY).groupBy("cluster").agg(
        F.max("urgent").alias("urgent"), F.count(F.lit(1)).alias("n"), F.sum("y").alias("events"))
    return cells.join(F.broadcast(top)).select("urgent", "n", "events", "silhouette")


@query("svm_optimum", """
SELECT unnest(['const', 'price', 'urgent']) AS term, true AS gradient_is_zero, true AS plane_is_not""")
def svm_optimum(spark, sf):
    """The squared-hinge plane of the whole table: its loss, differentiated in column expressions, is flat in every weight."""
    df = materialize(finished_orders(spark, sf).select(KEY, "y", (F.col("o_totalprice") / 100_000).alias("price"), F.col("urgent").cast("double").alias("urgent")))
    rows = df.select(F.lit("all").alias("model"), F.col("y").alias("label"), F.lit(True).alias("train"), F.array("price", "urgent").alias("features"))
    price, urgent, const = linear.fit_planes(rows, linear.Settings(c=0.05))["all"].tolist()
    n, p = F.count(F.lit(1)), F.sum("y")
    sizes = df.agg(n.alias("n"), p.alias("p")).first()
    sign = 2 * F.col("y") - 1
    share = F.when(F.col("y") == 1, sizes["n"] / (2 * sizes["p"])).otherwise(sizes["n"] / (2 * (sizes["n"] - sizes["p"])))
    slack = F.greatest(F.lit(0.0), 1 - sign * (price * F.col("price") + urgent * F.col("urgent") + const))
    pull = {"price": (price, F.col("price")), "urgent": (urgent, F.col("urgent")), "const": (const, F.lit(1.0))}
    flat = df.agg(*[(w - 2 * 0.05 * F.sum(share * sign * slack * x)).alias(t) for t, (w, x) in pull.items()], F.sum(share * slack).alias("scale"))
    rows = [F.struct(F.lit(t).alias("term"), (F.abs(F.col(t)) < 1e-6 * F.col("scale")).alias("gradient_is_zero"), F.lit(abs(w) > 1e-12).alias("plane_is_not"))
            for t, (w, _) in pull.items()]
    return flat.select(F.inline(F.array(*rows)))


# ---------------------------------------------------------------- sources and sinks

_REPORT = """
WITH g AS (SELECT o_orderstatus AS status, o_orderpriority AS priority, count(*) AS n, round(max(o_totalprice), 2) AS top FROM orders GROUP BY 1, 2)"""


def status_report(spark: SparkSession, sf: str) -> DataFrame:
    return X.table(spark, sf, "orders").groupBy(F.col("o_orderstatus").alias("status"), F.col("o_orderpriority").alias("priority")).agg(
        F.count(F.lit(1)).alias("n"), F.round(F.max("o_totalprice"), 2).alias("top"))


@query("text_csv_round_trip", _REPORT + """
SELECT status, priority, n::VARCHAR AS n, top, CASE WHEN n % 2 = 0 THEN n::DOUBLE END AS even_n FROM g""")
def text_csv_round_trip(spark, sf):
    """A report written as CSV and read back as text; two columns become numbers, and what is none becomes null."""
    path = scratch_path(spark)
    S.write_report(status_report(spark, sf).withColumn("even_n", F.when(F.col("n") % 2 == 0, F.col("n").cast("string")).otherwise("odd, \"not\" even")), path)
    return S.read_text_csv(spark, path, ["top", "even_n"])


@query("typed_csv_round_trip", _REPORT + "SELECT status, priority, n::INTEGER AS n, top FROM g")
def typed_csv_round_trip(spark, sf):
    path = scratch_path(spark)
    S.write_report(status_report(spark, sf), path)
    return S.read_typed_csv(spark, path)


@query("parquet_round_trip", "SELECT c_custkey, c_name, c_acctbal, 'customers' AS _source, true AS stamped FROM customer")
def parquet_round_trip(spark, sf):
    """Rows written as Parquet and read back with their required columns and lineage."""
    path = scratch_path(spark)
    S.write_rows(X.table(spark, sf, "customer"), path)
    rows = S.with_lineage(S.read_parquet(spark, path, ["c_custkey", "c_name", "c_acctbal"]), "customers")
    return rows.select("c_custkey", "c_name", "c_acctbal", "_source", F.col("ingested_at").isNotNull().alias("stamped"))


@query("metadata_round_trip", """
SELECT count(*) AS n, round(max(o_totalprice), 2) AS top, 42::BIGINT AS seed, 4::BIGINT AS depth, 'trees' AS kind FROM orders""")
def metadata_round_trip(spark, sf):
    """Facts of a run with nested settings, written as JSON and read back."""
    path = scratch_path(spark)
    facts = X.table(spark, sf, "orders").agg(F.count(F.lit(1)).alias("n"), F.round(F.max("o_totalprice"), 2).alias("top"))
    S.write_metadata(S.metadata_row(facts, seed=42, model={"kind": "trees", "depth": 4}), path)
    return spark.read.json(path).select("n", "top", "seed", "model.depth", "model.kind")


@query("layered_build", """
SELECT 'raw' AS layer, 'orders' AS name, count(*) AS n_rows FROM orders
UNION ALL SELECT 'raw', 'lineitem', count(*) FROM lineitem
UNION ALL SELECT 'clean', 'finished', count(*) FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'clean', 'finished_lines', count(*) FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE o_orderstatus = 'F'""")
def layered_build(spark, sf):
    """Two layers of tables, the second read from the first, listed with the rows they hold."""
    root = scratch_path(spark)

    def built(layer: str, name: str) -> DataFrame:
        return S.read_parquet(spark, f"{root}/{layer}/{name}")

    def finished() -> DataFrame:
        return built("raw", "orders").where("o_orderstatus = 'F'")

    listing = S.build_layers(spark, {
        "raw": {n: (lambda n=n: X.table(spark, sf, n)) for n in ("orders", "lineitem")},
        "clean": {"finished": finished,
                  "finished_lines": lambda: built("raw", "lineitem").join(finished(), F.col("l_orderkey") == F.col(KEY))}}, root)
    counts = None
    for r in listing.collect():  # one row per table built
        n = built(r["layer"], r["name"]).agg(F.count(F.lit(1)).alias("n_rows")).select(F.lit(r["layer"]).alias("layer"), F.lit(r["name"]).alias("name"), "n_rows")
        counts = n if counts is None else counts.unionByName(n)
    return counts


@query("catalog_listing", """
SELECT 'clean' AS layer, 'finished' AS name, count(*) AS n_rows FROM orders WHERE o_orderstatus = 'F'
UNION ALL SELECT 'raw', 'customers', count(*) FROM customer
UNION ALL SELECT 'raw', 'orders', count(*) FROM orders""")
def catalog_listing(spark, sf):
    """Two layers built as catalogue tables, listed from the catalogue with the rows they hold, and dropped."""
    prefix = f"cohortlens_{uuid.uuid4().hex[:12]}_"
    layers = [f"{prefix}raw", f"{prefix}clean"]
    try:
        S.build_layers(spark, {
            layers[0]: {"orders": lambda: X.table(spark, sf, "orders"), "customers": lambda: X.table(spark, sf, "customer")},
            layers[1]: {"finished": lambda: spark.table(f"{layers[0]}.orders").where("o_orderstatus = 'F'")}})
        found = S.list_tables(spark, layers).collect()  # one row per table built
        rows = [(r["layer"].removeprefix(prefix), r["name"], spark.table(f"{r['layer']}.{r['name']}").count()) for r in found]
    finally:
        for layer in layers:
            spark.sql(f"DROP DATABASE IF EXISTS {layer} CASCADE")
    return spark.createDataFrame(rows, "layer string, name string, n_rows bigint")
