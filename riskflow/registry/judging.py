"""Metrics, losses and calibration on a deterministic score: the discount of a line, ten times over."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskflow.functions.hashing import hash_fraction
from riskflow.functions.losses import average_loss, focal_terms
from riskflow.functions.scalars import at_least
from riskflow.operators import calibration, metrics
from riskflow.operators.models import rank_importances
from riskflow.operators.profile import melt
from riskflow.operators.sampling import split_rows
from riskflow.registry import fraction_sql, query, rounded, table
from riskflow.registry.splitting import LINE_KEY, LINE_KEY_SQL, SETS

SCORED = "SELECT *, (l_returnflag = 'R')::int AS y, l_discount * 10 AS p, l_discount * 10 * 0.5 + 0.2 AS q FROM lineitem"
SET = SETS.format(fraction_sql(LINE_KEY_SQL))


def scored_lines(spark, folder):
    return table(spark, folder, "lineitem").select(
        "*",
        (F.col("l_returnflag") == "R").cast("int").alias("y"),
        (F.col("l_discount") * 10).alias("p"),
        (F.col("l_discount") * 10 * 0.5 + 0.2).alias("q"),
    )


def auc_sql(score: str, source: str, by: str = "") -> str:
    """Rank-sum area with average ranks for ties."""
    part = f"PARTITION BY {by}" if by else ""
    peers = f"PARTITION BY {by + ', ' if by else ''}{score}"
    head = f"{by}, " if by else ""
    return (
        f"SELECT {head}(sum(rk) FILTER (y = 1) - count(*) FILTER (y = 1)::double * (count(*) FILTER (y = 1) + 1) / 2) "
        f"/ (count(*) FILTER (y = 1)::double * count(*) FILTER (y = 0)) AS roc_auc FROM ("
        f"SELECT *, rank() OVER ({part} ORDER BY {score}) + (count(*) OVER ({peers}) - 1) / 2.0 AS rk FROM {source}) "
        + (f"GROUP BY {by}" if by else "")
    )


@query("roc_auc", f"WITH s AS ({SCORED}) SELECT round(roc_auc, 6) AS roc_auc FROM ({auc_sql('p', 's')})")
def roc_auc(spark, folder):
    return rounded(metrics.roc_auc(scored_lines(spark, folder), "y", "p"))



@query(
    "roc_auc_continuous",
    f"WITH s AS (SELECT (l_returnflag = 'R')::int AS y, {fraction_sql(LINE_KEY_SQL)} AS h FROM lineitem) "
    f"SELECT round(roc_auc, 6) AS roc_auc FROM ({auc_sql('h', 's')})",
)
def roc_auc_continuous(spark, folder):
    """A score with nearly as many values as rows."""
    rows = scored_lines(spark, folder).select("y", hash_fraction(LINE_KEY, 42).alias("h"))
    return rounded(metrics.roc_auc(rows, "y", "h"))


RATES = (
    "round((tp + tn) / (tp + fp + fn + tn), 6) AS accuracy, coalesce(round(tp / nullif(tp + fp, 0), 6), 0) AS precision, "
    "coalesce(round(tp / nullif(tp + fn, 0), 6), 0) AS recall, coalesce(round(2 * tp / nullif(2 * tp + fp + fn, 0), 6), 0) AS f1_score"
)


def counts_sql(score: str, source: str, by: str = "") -> str:
    cells = {"tp": (1, ">="), "fp": (0, ">="), "fn": (1, "<"), "tn": (0, "<")}
    counted = ", ".join(f"count(*) FILTER (y = {y} AND {score} {op} 0.5) AS {n}" for n, (y, op) in cells.items())
    return f"SELECT {by + ', ' if by else ''}{counted} FROM {source}" + (f" GROUP BY {by}" if by else "")


@query("threshold_metrics", f"WITH s AS ({SCORED}) SELECT tp, fp, fn, tn, {RATES} FROM ({counts_sql('p', 's')})")
def threshold_metrics(spark, folder):
    return rounded(metrics.threshold_metrics(scored_lines(spark, folder), "y", "p"))


def edges_sql(score: str, n: int = 10) -> str:
    step = 1.0 / n
    edges = [i * step for i in range(n)] + [1.0]
    return "(" + " + ".join(f"({score} >= {e!r}::double)::int" for e in edges) + " - 1)"


def ece_sql(score: str, source: str, by: str = "") -> str:
    head = f"{by}, " if by else ""
    return (
        f"SELECT {head}sum(CASE WHEN b BETWEEN 0 AND 9 THEN abs(a - c) * n ELSE 0 END) / sum(n) AS ece FROM ("
        f"SELECT {head}{edges_sql(score)} AS b, avg(y) AS a, avg({score}) AS c, count(*) AS n FROM {source} "
        f"GROUP BY {head}b)" + (f" GROUP BY {by}" if by else "")
    )


@query("ece", f"WITH s AS ({SCORED}) SELECT round(ece, 6) AS ece FROM ({ece_sql('p', 's')})")
def ece(spark, folder):
    return rounded(metrics.ExpectedCalibrationError(10).compute(scored_lines(spark, folder), "y", "p"))


@query(
    "calibration_bins",
    f"WITH s AS ({SCORED}) SELECT {edges_sql('p')} AS bin, count(*) AS count, round(avg(y), 6) AS accuracy, "
    "round(avg(p), 6) AS confidence FROM s GROUP BY bin",
)
def calibration_bins(spark, folder):
    return rounded(metrics.calibration_bins(scored_lines(spark, folder), "y", "p"))


@query(
    "classification_report",
    f"WITH s AS (SELECT *, (p >= 0.5)::int AS h FROM ({SCORED})), "
    "c AS (SELECT k.label, count(*) FILTER (y = k.label) AS support, count(*) FILTER (h = k.label) AS predicted, "
    "count(*) FILTER (y = k.label AND h = k.label) AS hits FROM s, (SELECT unnest([0, 1]) AS label) k GROUP BY k.label), "
    "r AS (SELECT label, support, hits, coalesce(hits / nullif(predicted, 0), 0) AS p, coalesce(hits / nullif(support, 0), 0) AS r, "
    "coalesce(2 * hits / nullif(predicted + support, 0), 0) AS f FROM c) "
    "SELECT label::varchar AS label, round(p, 6) AS precision, round(r, 6) AS recall, round(f, 6) AS f1_score, support FROM r "
    "UNION ALL SELECT 'accuracy', NULL, NULL, round(sum(hits) / sum(support), 6), sum(support)::bigint FROM r "
    "UNION ALL SELECT 'macro avg', round(avg(p), 6), round(avg(r), 6), round(avg(f), 6), sum(support)::bigint FROM r "
    "UNION ALL SELECT 'weighted avg', round(sum(p * support) / sum(support), 6), round(sum(r * support) / sum(support), 6), "
    "round(sum(f * support) / sum(support), 6), sum(support)::bigint FROM r",
)
def classification_report(spark, folder):
    return rounded(metrics.classification_report(scored_lines(spark, folder), "y", at_least("p", 0.5)))


@query(
    "metrics_by_set",
    f"WITH s AS (SELECT *, {SET} AS \"set\" FROM ({SCORED})) SELECT round(roc_auc, 6) AS roc_auc, f1_score, precision, recall, "
    f"round(ece, 6) AS ece, \"set\" FROM ({auc_sql('q', 's', chr(34) + 'set' + chr(34))}) "
    f"JOIN (SELECT \"set\", {RATES} FROM ({counts_sql('q', 's', chr(34) + 'set' + chr(34))})) USING (\"set\") "
    f"JOIN ({ece_sql('p', 's', chr(34) + 'set' + chr(34))}) USING (\"set\")",
)
def metrics_by_set(spark, folder):
    rows = split_rows(scored_lines(spark, folder), LINE_KEY)
    return rounded(metrics.metrics_by_set(rows, "y", "q", "p"))


@query("mse", f"WITH s AS ({SCORED}) SELECT round(avg((y - p) * (y - p)), 6) AS mse FROM s")
def mse(spark, folder):
    return rounded(metrics.mean_squared_error(scored_lines(spark, folder), "y", "p"))


@query("accuracy", f"WITH s AS ({SCORED}) SELECT round(avg((y = (p >= 0.5)::int)::int), 6) AS accuracy FROM s")
def accuracy(spark, folder):
    rows = scored_lines(spark, folder).withColumn("h", at_least("p", 0.5))
    return rounded(metrics.accuracy(rows, "y", "h"))


MARGIN = "l_tax * 50 - l_discount * 20"


@query(
    "focal_grad_hess",
    "WITH z AS (SELECT l_orderkey, l_linenumber, (l_returnflag = 'R')::int AS y, "
    f"least(greatest(1 / (1 + exp(-({MARGIN}))), 1e-9), 1 - 1e-9) AS p FROM lineitem), "
    "t AS (SELECT *, CASE WHEN y = 1 THEN p ELSE 1 - p END AS pt FROM z) "
    "SELECT l_orderkey, l_linenumber, round(0.25 * (y - p) * pow(1 - pt, 2) * (2 * pt * ln(pt) + pt - 1), 6) + 0.0::double AS gradient, "
    "round(0.25 * pow(1 - pt, 2) * p * (1 - p), 6) + 0.0::double AS hessian FROM t",
)
def focal_grad_hess(spark, folder):
    rows = scored_lines(spark, folder)
    gradient, hessian = focal_terms(F.col("y"), F.col("l_tax") * 50 - F.col("l_discount") * 20)
    return rounded(rows.select("l_orderkey", "l_linenumber", gradient.alias("gradient"), hessian.alias("hessian")))


@query(
    "scoring_losses",
    "WITH s AS (SELECT (l_returnflag = 'R')::int AS y, least(greatest(l_discount * 10, 1e-7), 1 - 1e-7) AS p FROM lineitem), "
    "t AS (SELECT *, CASE WHEN y = 1 THEN p ELSE 1 - p END AS pt FROM s) "
    "SELECT round(avg(-(y * ln(p) + (1 - y) * ln(1 - p))), 6) AS binary_crossentropy, "
    "round(avg(-pow(1 - pt, 2) * ln(pt)), 6) AS focal_loss FROM t",
)
def scoring_losses(spark, folder):
    rows = scored_lines(spark, folder)
    return rounded(rows.agg(*(average_loss(n, "y", "p").alias(n) for n in ("binary_crossentropy", "focal_loss"))))


@query(
    "isotonic_calibration",
    f"WITH s AS ({SCORED}), d AS (SELECT p, sum(y) AS hits, count(*) AS n FROM s GROUP BY p), "
    "c AS (SELECT p, row_number() OVER (ORDER BY p) AS i, sum(hits) OVER (ORDER BY p) AS h, sum(n) OVER (ORDER BY p) AS m, "
    "hits, n FROM d), "
    "lowest AS (SELECT a.i AS i, a.p AS p, lo.i AS j, min((hi.h - lo.h + lo.hits) / (hi.m - lo.m + lo.n)) AS best "
    "FROM c a JOIN c lo ON lo.i <= a.i JOIN c hi ON hi.i >= a.i GROUP BY a.i, a.p, lo.i), "
    "fit AS (SELECT p, max(best) AS calibrated FROM lowest GROUP BY p) "
    "SELECT l_orderkey, l_linenumber, round(p, 6) AS p, round(calibrated, 6) AS calibrated FROM s JOIN fit USING (p)",
)
def isotonic_calibration(spark, folder):
    rows = scored_lines(spark, folder)
    model = calibration.fit_isotonic(rows, "y", "p")
    return rounded(calibration.calibrate(rows, model, "p").select("l_orderkey", "l_linenumber", "p", "calibrated"))


RANKED = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "importance_rank",
    "WITH f AS ("
    + " UNION ALL ".join(f"SELECT '{c}' AS feature_name, round(stddev_samp({c}) / avg({c}), 6) AS v FROM lineitem" for c in RANKED)
    + "), r AS (SELECT v AS feature_importance, feature_name, "
    "row_number() OVER (ORDER BY v DESC, feature_name) AS feature_importance_rank, "
    "round(sum(v) OVER (ORDER BY v DESC, feature_name ROWS UNBOUNDED PRECEDING), 6) AS cumulative_importances FROM f) "
    "SELECT * FROM r",
)
def importance_rank(spark, folder):
    """Ranking of a per-column statistic, taken here as the importance."""
    spread = [F.round(F.stddev_samp(c) / F.avg(c), 6).alias(f"v{i}") for i, c in enumerate(RANKED)]
    values = melt(table(spark, folder, "lineitem").agg(*spread), RANKED, "feature_name", feature_importance="v")
    ranked = rank_importances(values.select("feature_importance", "feature_name"))
    return rounded(ranked)


@query(
    "report_unknown_target",
    f"WITH s AS (SELECT y, (p >= 0.5)::int AS h FROM ({SCORED}) WHERE l_linestatus = 'F'), "
    "c AS (SELECT k.label, count(*) FILTER (y = k.label) AS support, count(*) FILTER (h = k.label) AS predicted, "
    "count(*) FILTER (y = k.label AND h = k.label) AS hits FROM s, (SELECT unnest([0, 1]) AS label) k GROUP BY k.label), "
    "r AS (SELECT label::varchar AS label, coalesce(hits / nullif(predicted, 0), 0) AS precision, coalesce(hits / nullif(support, 0), 0) AS recall, "
    "coalesce(2 * hits / nullif(predicted + support, 0), 0) AS f1_score, support, hits FROM c), "
    "a AS (SELECT label, precision, recall, f1_score, support FROM r "
    "UNION ALL SELECT 'accuracy', NULL, NULL, sum(hits) / sum(support), sum(support)::bigint FROM r "
    "UNION ALL SELECT 'macro avg', avg(precision), avg(recall), avg(f1_score), sum(support)::bigint FROM r "
    "UNION ALL SELECT 'weighted avg', sum(precision * support) / sum(support), sum(recall * support) / sum(support), "
    "sum(f1_score * support) / sum(support), sum(support)::bigint FROM r) "
    "SELECT label, round(precision, 6) AS precision, round(recall, 6) AS recall, round(f1_score, 6) AS f1_score, support, "
    "(SELECT round(avg((y = h)::int), 6) FROM s) AS accuracy FROM a",
)
def report_unknown_target(spark, folder):
    """Rows with an unknown target, -1 or null, take no part in accuracy, report and averages."""
    unknown = F.when(F.col("l_linestatus") == "F", F.col("y")).when(F.col("l_linenumber") % 2 == 0, F.lit(-1))
    rows = scored_lines(spark, folder).withColumn("y", unknown).withColumn("h", at_least("p", 0.5))
    report = metrics.classification_report(rows, "y", "h")
    return rounded(report.join(F.broadcast(metrics.accuracy(rows, "y", "h"))))  # one row


@query(
    "roc_auc_ranges",
    f"WITH s AS (SELECT (l_returnflag = 'R')::int AS y, {fraction_sql(LINE_KEY_SQL)} AS h FROM lineitem) "
    f"SELECT round(roc_auc, 6) AS roc_auc FROM ({auc_sql('h', 's')})",
)
def roc_auc_ranges(spark, folder):
    """The way taken past the counted bound of rows."""
    rows = scored_lines(spark, folder).select("y", hash_fraction(LINE_KEY, 42).alias("h"))
    return rounded(metrics.roc_auc(rows, "y", "h", single_task_rows=100))


@query(
    "bucketed_auc",
    f"WITH s AS ({SCORED}), t AS (SELECT i, CASE WHEN i = 0 THEN -1e-7 WHEN i = 199 THEN 1 + 1e-7 ELSE i / 199.0::double END AS cut "
    "FROM range(200) r(i)), c AS (SELECT i, count(*) FILTER (y = 1) / (SELECT count(*) FROM s WHERE y = 1) AS tpr, "
    "count(*) FILTER (y = 0) / (SELECT count(*) FROM s WHERE y = 0) AS fpr FROM t LEFT JOIN s ON p > cut GROUP BY i) "
    "SELECT round(sum((a.fpr - b.fpr) * (a.tpr + b.tpr) / 2), 6) AS bucketed_auc FROM c a JOIN c b ON b.i = a.i + 1",
)
def bucketed_auc(spark, folder):
    return rounded(metrics.bucketed_auc(scored_lines(spark, folder), "y", "p"))
