"""Models, embeddings and parameter search. Where SQL has no counterpart, tests check their properties."""

from __future__ import annotations

import json
import random

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.functions import vector_to_array
from pyspark.sql import functions as F

from riskflow.config import SEED
from riskflow.operators import metrics, models, stages
from riskflow.operators.boosting import NewtonBoostedClassifier, loss_by_round
from riskflow.operators.context import contextual_transform, token_pairs
from riskflow.operators.embeddings import fit_row_encoder
from riskflow.operators.rates import binned, bounded_counts, grouped_rows, out_of_fold_error
from riskflow.operators.sampling import split_rows, stratified_folds
from riskflow.operators.tuning import RandomSearch
from riskflow.plans.embedding import append_embeddings
from riskflow.plans.training import train_and_judge
from riskflow.registry import query, rounded, table
from riskflow.registry.eda import customer_orders
from riskflow.registry.splitting import LINE_KEY, LINE_KEY_SQL
from riskflow.session import materialise, scratch_path

NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]
CATEGORIES = ["l_linestatus", "l_linenumber"]


#: Least relative gain a round on the held-out rows; below it training ends.
TOLERANCE = 0.03
CHARGE_SQL = "l_extendedprice * (1 - l_discount) * (1 + l_tax)"


def returned_lines(spark, folder):
    return table(spark, folder, "lineitem").select(
        *LINE_KEY, "l_linestatus", *NUMBERS, (F.col("l_returnflag") == "R").cast("int").alias("returned")
    )


def valuable_lines(spark, folder):
    """A target that the features explain, and a fifth of the rows held out: the preset's rounds end when those gain no more."""
    charge = F.expr(CHARGE_SQL)
    lines = table(spark, folder, "lineitem").select(*LINE_KEY, "l_linestatus", *NUMBERS, charge.alias("charge"), (charge >= 50_000).cast("int").alias("valuable"))
    return split_rows(lines, LINE_KEY).withColumn("held_out", F.col("set") == "validation")


def classifier(**options) -> models.BoostedTreesClassifier:
    options = {"validation": "held_out", "validationTol": TOLERANCE, **options}
    return models.BoostedTreesClassifier(CATEGORIES, NUMBERS, "valuable", **options)


@query("gbt_scores")
def gbt_scores(spark, folder):
    rows = valuable_lines(spark, folder)
    scored = classifier(balanced=True).fit(rows).transform(rows)
    return scored.select(*LINE_KEY, "prediction", vector_to_array("probability")[1].alias("score"))


@query("gbt_margin")
def gbt_margin(spark, folder):
    rows = returned_lines(spark, folder)
    quick = models.BoostedTreesClassifier((), NUMBERS, "returned", **models.EXPLORATION_PARAMS)
    return quick.fit(rows).margins(rows).select(*LINE_KEY, "margin")


@query("gbt_regression")
def gbt_regression(spark, folder):
    rows = valuable_lines(spark, folder)
    model = models.BoostedTreesRegressor(CATEGORIES, NUMBERS, "charge", validation="held_out", validationTol=TOLERANCE)
    return model.fit(rows).predict(rows).select(*LINE_KEY, "charge", "prediction")


@query("gbt_early_stop")
def gbt_early_stop(spark, folder):
    """The preset's limit is 1000 rounds; ``rounds`` are those kept."""
    rows = valuable_lines(spark, folder)
    model = classifier().fit(rows)
    scored = model.predict_proba(rows)
    return metrics.roc_auc(scored, "valuable", "score", ["set"]).withColumn("rounds", F.lit(model.rounds))


@query("gbt_importances")
def gbt_importances(spark, folder):
    return classifier().fit(valuable_lines(spark, folder)).importances(top=30)


@query("model_evaluate")
def model_evaluate(spark, folder):
    """Save, load, then evaluate the loaded model on the whole table."""
    rows = valuable_lines(spark, folder)
    path = scratch_path(spark, "model")
    classifier().fit(rows).save(path)
    found = models.BoostedTreesClassifier.load(path).evaluate_all(rows)
    return spark.createDataFrame([(m, float(v)) for m, v in found.items()], "metric string, value double")


@query("training_metrics")
def training_metrics(spark, folder):
    rows = valuable_lines(spark, folder).drop("set", "held_out")
    return train_and_judge(
        rows, LINE_KEY, "valuable", CATEGORIES, NUMBERS, stop_on_validation=True, validationTol=TOLERANCE
    ).metrics


@query("row_embeddings")
def row_embeddings(spark, folder):
    rows = customer_orders(spark, folder).select(
        "o_orderkey", "o_orderpriority", "o_orderstatus", "c_mktsegment", "o_totalprice", "c_acctbal"
    )
    encoder = fit_row_encoder(rows, ["o_orderpriority", "o_orderstatus", "c_mktsegment"], ["o_totalprice", "c_acctbal"], 8)
    return encoder.transform(rows)


@query("value_embeddings")
def value_embeddings(spark, folder):
    rows = table(spark, folder, "events").select("event_type", "props", "value")
    encoder = fit_row_encoder(rows, ["event_type", "props"], ["value"], 8)
    return encoder.value_vectors().withColumn("vector", F.array_join(F.col("vector").cast("array<string>"), ","))


@query("embedding_head")
def embedding_head(spark, folder):
    """Trees over the row vectors beside the original numbers, until the held-out rows gain no more."""
    rows = customer_orders(spark, folder).select(
        "o_orderkey", "o_orderpriority", "c_mktsegment", "o_totalprice", "c_acctbal",
        (F.col("o_totalprice") + 10 * F.col("c_acctbal") >= 300_000).cast("int").alias("large"),
    )
    rows = split_rows(rows, "o_orderkey")
    parts = {"train": rows.where("set = 'train'"), "test": rows.where("set <> 'train'")}
    widened, _ = append_embeddings(parts, ["o_orderpriority", "c_mktsegment"], ["o_totalprice", "c_acctbal"], 4)
    vectors = [f"encoder_emb_{i}" for i in range(4)]
    model = models.BoostedTreesClassifier(
        (), ["o_totalprice", "c_acctbal", *vectors], "large", validation="held_out", validationTol=TOLERANCE
    )
    flagged = [part.withColumn("held_out", F.lit(name == "test")) for name, part in widened.items()]
    return model.fit(flagged[0].unionByName(flagged[1])).predict_proba(widened["test"]).select("o_orderkey", "large", "score")


# -- search -----------------------------------------------------------------------------------------------
BIN_CHOICES = [4, 8, 16, 32]
SPACE = {"bins": lambda rng: rng.choice(BIN_CHOICES), "smoothing": lambda rng: round(rng.uniform(0.5, 100.0), 1)}
CUTS = {"threshold": lambda rng: round(rng.uniform(0.0, 1.0), 6)}
SCORE_SQL = "(l_extendedprice / 105000.0)::double"


def drawn(space) -> list[dict]:
    """The parameters that a search with the default seed and number of trials draws."""
    rng = random.Random(SEED)
    return [{name: suggest(rng) for name, suggest in space.items()} for _ in range(RandomSearch().trials)]


def values_sql(space) -> str:
    return ", ".join(f"({n}, {', '.join(map(repr, p.values()))}, '{json.dumps({k: str(v) for k, v in p.items()}, separators=(',', ':'))}')" for n, p in enumerate(drawn(space)))


def _tuning_sql() -> str:
    """All trials, by counts per fold and value, each fold scored by the others' counts."""
    bins = ", ".join(
        f"floor({b} * (rank() OVER (ORDER BY {c}) - 1) / count(*) OVER ())::int AS b{b}_{c}"
        for b in BIN_CHOICES for c in NUMBERS
    )
    long = " UNION ALL ".join(
        [f"SELECT id, fold, y, {b} AS bins, '{c}' AS col, b{b}_{c}::varchar AS v FROM f" for b in BIN_CHOICES for c in NUMBERS]
        + [f"SELECT id, fold, y, {b}, '{c}', {c}::varchar FROM f" for b in BIN_CHOICES for c in CATEGORIES]
    )
    return (
        f"WITH t(number, bins, smoothing, params) AS (VALUES {values_sql(SPACE)}), "
        f"r AS (SELECT row_number() OVER () AS id, ({CHARGE_SQL} >= 50000)::int AS y, {LINE_KEY_SQL} AS k, * FROM lineitem), "
        f"f AS (SELECT *, ((row_number() OVER (PARTITION BY y ORDER BY md5('42|' || k), k) - 1) % 5)::int AS fold, {bins} FROM r), "
        f"long AS ({long}), "
        "own AS (SELECT bins, fold, col, v, count(*) AS n, sum(y) AS p FROM long GROUP BY ALL), "
        "every AS (SELECT bins, col, v, sum(n) AS n, sum(p) AS p FROM own GROUP BY ALL), "
        "share AS (SELECT a.fold, (sum(b.p) / sum(b.n))::double AS s FROM (SELECT fold FROM f GROUP BY 1) a, "
        "(SELECT fold, count(*) AS n, sum(y) AS p FROM f GROUP BY 1) b WHERE b.fold <> a.fold GROUP BY 1), "
        "rate AS (SELECT t.number, o.bins, o.fold, o.col, o.v, ((e.p - o.p) + smoothing::double * s) / ((e.n - o.n) + smoothing::double) AS r "
        "FROM t JOIN own o USING (bins) JOIN every e ON e.bins = o.bins AND e.col = o.col AND e.v = o.v JOIN share USING (fold)), "
        "scored AS (SELECT number, id, any_value(long.fold) AS fold, any_value(y) AS y, sum(r) / 6 AS score FROM long JOIN rate USING (bins, fold, col, v) GROUP BY number, id), "
        "folds AS (SELECT number, fold, avg((y - score) * (y - score)) AS e FROM scored GROUP BY ALL) "
        "SELECT number::int AS number, round(avg(e), 6) AS value, any_value(params) AS params, 'complete' AS state FROM folds JOIN t USING (number) GROUP BY number"
    )


@query("tuning_trials", _tuning_sql())
def tuning_trials(spark, folder):
    """100 trials x 5 stratified folds of a model whose fit is one aggregate, both kinds of columns: the whole table of trials."""
    lines = valuable_lines(spark, folder).withColumn("key", F.concat_ws("|", *LINE_KEY))
    rows = binned(lines, NUMBERS, CATEGORIES, BIN_CHOICES, ["key", "valuable"])
    folded = stratified_folds(materialise(rows, "binned"), "valuable", "key", 5, name="_fold")
    # A trial reads what its bins tell apart, which their number bounds. Written here, since what a trial writes goes with it.
    columns = {b: [*(f"bin_{b}_{c}" for c in NUMBERS), *(f"value_{c}" for c in CATEGORIES)] for b in BIN_CHOICES}
    finest = grouped_rows(folded, "_fold", "valuable", list(dict.fromkeys(c for some in columns.values() for c in some)))
    grouped = {b: grouped_rows(finest, "_fold", "valuable", some, "_weight") for b, some in columns.items()}
    cells = {b: bounded_counts(grouped[b], "_fold", "valuable", some, "_weight") for b, some in columns.items()}  # whatever the smoothing

    def objective(params):
        b = params["bins"]
        return out_of_fold_error(grouped[b], "_fold", "valuable", columns[b], params["smoothing"], cells[b], "_weight")

    search = RandomSearch(concurrent=4)
    search.optimize(objective, SPACE, "minimize")
    return rounded(search.trials_table().withColumn("params", F.to_json("params")))


@query(
    "search_objective",
    f"WITH t(number, threshold, params) AS (VALUES {values_sql(CUTS)}), "
    f"l AS (SELECT ({CHARGE_SQL} >= 50000)::int AS y, {SCORE_SQL} AS s FROM lineitem), "
    "c AS (SELECT number, any_value(params) AS params, count(*) FILTER (y = 1 AND s >= threshold) AS tp, count(*) FILTER (y = 0 AND s >= threshold) AS fp, "
    "count(*) FILTER (y = 1 AND s < threshold) AS fn FROM l, t GROUP BY number), "
    "v AS (SELECT number::int AS number, params, CASE WHEN number % 10 = 9 THEN -1.0 WHEN tp = 0 THEN 0.0 ELSE 2.0 * tp / (2.0 * tp + fp + fn) END::double AS value, "
    "CASE WHEN number % 10 = 9 THEN 'failed' ELSE 'complete' END AS state FROM c) "
    "SELECT number, round(value, 6) AS value, params, state, row_number() OVER (ORDER BY value DESC, number)::int AS place FROM v ORDER BY value DESC, number LIMIT 10",
)
def search_objective(spark, folder):
    """An objective of one's own: the threshold with the best F1; every tenth trial fails and the search goes on. The top 10."""
    scored = materialise(valuable_lines(spark, folder).select("valuable", (F.col("l_extendedprice") / F.lit(105000.0)).alias("score")), "scores")
    numbers = {p["threshold"]: n for n, p in enumerate(drawn(CUTS))}

    def objective(params):
        if numbers[params["threshold"]] % 10 == 9:
            raise ArithmeticError("a trial that fails")
        return metrics.threshold_metrics(scored, "valuable", "score", params["threshold"]).first()["f1_score"]

    search = RandomSearch(concurrent=4)
    search.optimize(objective, CUTS)
    top = search.top_trials(10).collect()
    assert (top[0]["number"], top[0]["value"]) == (search.best_trial()["number"], search.best_trial()["score"])
    placed = [(*r, i + 1) for i, r in enumerate(top)]
    named = spark.createDataFrame(placed, "number int, value double, params map<string,string>, state string, place int")
    return rounded(named.withColumn("params", F.to_json("params")))


STUMP = {"maxIter": 1, "maxDepth": 1, "seed": 42}
STUMP_FEATURES = ["l_quantity", "l_discount"]


def stump_sql(target: str) -> str:
    """Common tables: ``best`` (feature, cut) is the split between neighbouring values with the least squared error, ``leaf``
    the mean of ``target`` on each side."""
    sums = " UNION ALL ".join(
        f"SELECT '{f}' AS feature, {f} AS v, count(*) AS n, sum({target}) AS s FROM lineitem GROUP BY {f}" for f in STUMP_FEATURES
    )
    value = "CASE feature " + " ".join(f"WHEN '{f}' THEN {f}" for f in STUMP_FEATURES) + " END"
    return (
        f"sums AS ({sums}), runs AS (SELECT *, sum(n) OVER w AS nl, sum(s) OVER w AS sl, sum(n) OVER (PARTITION BY feature) AS nt, "
        "sum(s) OVER (PARTITION BY feature) AS st, lead(v) OVER (PARTITION BY feature ORDER BY v) AS above FROM sums "
        "WINDOW w AS (PARTITION BY feature ORDER BY v)), "
        "best AS (SELECT feature, (v + above) / 2 AS cut FROM runs WHERE above IS NOT NULL "
        "ORDER BY sl * sl / nl + (st - sl) * (st - sl) / (nt - nl) DESC LIMIT 1), "
        f"sided AS (SELECT l.*, best.feature, {value} <= best.cut AS low FROM lineitem l, best), "
        f"leaf AS (SELECT low, avg({target}) AS mean FROM sided GROUP BY low)"
    )


SIGN = "(CASE WHEN l_returnflag = 'R' THEN 1.0 ELSE -1.0 END)::double"
STUMP_SCORED = (
    f"WITH {stump_sql(SIGN)}, scored AS (SELECT l_orderkey, l_linenumber, (l_returnflag = 'R')::int AS y, mean AS margin, "
    "1 / (1 + exp(-2 * mean)) AS score, (mean > 0)::int AS h, feature FROM sided JOIN leaf USING (low)) "
)


def stump(spark, folder):
    rows = returned_lines(spark, folder)
    return rows, models.BoostedTreesClassifier((), STUMP_FEATURES, "returned", **STUMP).fit(rows)


@query(
    "stump_scores",
    STUMP_SCORED + "SELECT l_orderkey, l_linenumber, h::double AS prediction, round(score, 6) AS score, round(margin, 6) AS margin FROM scored",
)
def stump_scores(spark, folder):
    """A single split is exact: labels, probabilities and margins."""
    rows, model = stump(spark, folder)
    scored = model.transform(rows)
    margin = vector_to_array("rawPrediction")[1]
    return rounded(scored.select("l_orderkey", "l_linenumber", "prediction", vector_to_array("probability")[1].alias("score"), margin.alias("margin")), 6)


@query(
    "stump_regression",
    f"WITH {stump_sql('l_extendedprice')} SELECT l_orderkey, l_linenumber, round(mean, 4) AS prediction FROM sided JOIN leaf USING (low)",
)
def stump_regression(spark, folder):
    rows = returned_lines(spark, folder)
    model = models.BoostedTreesRegressor((), STUMP_FEATURES, "l_extendedprice", **STUMP).fit(rows)
    return rounded(model.predict(rows).select("l_orderkey", "l_linenumber", "prediction"), 4)


@query(
    "stump_saved_metrics",
    STUMP_SCORED + ", ranked AS (SELECT y, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0 AS r FROM scored) "
    "SELECT 'roc_auc' AS metric, round((sum(r) FILTER (y = 1) - count(*) FILTER (y = 1)::double * (count(*) FILTER (y = 1) + 1) / 2) "
    "/ (count(*) FILTER (y = 1)::double * count(*) FILTER (y = 0)), 6) AS value FROM ranked "
    "UNION ALL SELECT 'accuracy', round(avg((y = h)::int), 6) FROM scored",
)
def stump_saved_metrics(spark, folder):
    """Saved, loaded and then judged."""
    rows, model = stump(spark, folder)
    path = scratch_path(spark, "stump")
    model.save(path)
    loaded = models.BoostedTreesClassifier.load(path)
    found = [(m, float(loaded.evaluate(rows, m))) for m in ("roc_auc", "accuracy")]
    return rounded(spark.createDataFrame(found, "metric string, value double"))


FOCAL_G = "(0.0625 * (y - 0.5) * (ln(0.5) - 0.5))"
FOCAL_H = "0.015625"


@query(
    "focal_boost_stump",
    "WITH lineitem AS (SELECT *, (l_returnflag = 'R')::int::double AS y FROM main.lineitem), "
    f"{stump_sql(f'(-{FOCAL_G} / {FOCAL_H})')}, "
    f"steps AS (SELECT low, -sum({FOCAL_G}) / (sum({FOCAL_H}::double) + 1.0) AS step FROM sided GROUP BY low) "
    "SELECT l_orderkey, l_linenumber, round(0.1 * step, 9) AS margin, round(1 / (1 + exp(-0.1 * step)), 9) AS score, (step > 0)::int::double AS prediction "
    "FROM sided JOIN steps USING (low)",
)
def focal_boost_stump(spark, folder):
    """One Newton round of depth 1 on the focal loss is exact: split, leaf steps with their penalty, margins and scores."""
    rows = returned_lines(spark, folder)
    model = NewtonBoostedClassifier((), STUMP_FEATURES, "returned", rounds=1, depth=1, penalty=1.0).fit(rows)
    return rounded(model.transform(rows).select("l_orderkey", "l_linenumber", "margin", "score", "prediction"), 9)


@query("focal_boost_rounds")
def focal_boost_rounds(spark, folder):
    """Focal loss of both sets by round, until the held-out rows gain no more or the limit is reached."""
    rows = valuable_lines(spark, folder)
    model = NewtonBoostedClassifier(CATEGORIES, NUMBERS, "valuable", rounds=15, depth=4, step=0.5, patience=3, validation="held_out").fit(rows)
    return loss_by_round(model)


# -- tokens and context ------------------------------------------------------------------------------------
TOKEN_COLUMNS = (["o_orderpriority", "o_orderstatus"], ["o_totalprice"])
EIGHTHS = ", ".join(f"quantile_cont(o_totalprice, {i / 8})" for i in range(1, 8))
TOKENS_SQL = (
    f"e AS (SELECT [{EIGHTHS}] AS edges FROM orders), "
    "k AS (SELECT o_orderkey, o_orderpriority AS p, o_orderstatus AS s, len(list_filter(edges, lambda x: x <= o_totalprice))::varchar AS t FROM orders, e)"
)


@query("row_tokens", f"WITH {TOKENS_SQL} SELECT o_orderkey, 'o_orderpriority=' || p || '|o_orderstatus=' || s || '|o_totalprice=' || t AS tokens FROM k")
def row_tokens(spark, folder):
    """The column-value tokens of each row; numbers by bins between exact eighths."""
    rows = table(spark, folder, "orders")
    encoder = fit_row_encoder(rows, *TOKEN_COLUMNS, size=2)
    text = F.transform("_tokens", lambda t: F.concat(t["column"], F.lit("="), t["value"]))
    return encoder.tokens(rows).select("o_orderkey", F.array_join(text, "|").alias("tokens"))


@query(
    "row_context",
    f"WITH {TOKENS_SQL}, long AS (SELECT o_orderkey, unnest(['o_orderpriority=' || p, 'o_orderstatus=' || s, 'o_totalprice=' || t]) AS tok FROM k), "
    "alone AS (SELECT tok, count(*) AS n FROM long GROUP BY tok), "
    "pairs AS (SELECT a.tok AS a, b.tok AS b, count(*) AS n FROM long a JOIN long b USING (o_orderkey) WHERE a.tok <> b.tok GROUP BY 1, 2), "
    "w AS (SELECT a, b, greatest(ln((SELECT count(*) FROM orders)::double * pairs.n / (x.n::double * y.n)), 0) AS w FROM pairs JOIN alone x ON x.tok = a JOIN alone y ON y.tok = b), "
    "v AS (SELECT tok, length(tok)::double AS x, ascii(tok[-1])::double AS y FROM alone), "
    "beside AS (SELECT a.o_orderkey, w * x AS x, w * y AS y FROM long a JOIN long b USING (o_orderkey) JOIN w ON w.a = a.tok AND w.b = b.tok JOIN v ON v.tok = b.tok "
    "UNION ALL SELECT o_orderkey, x, y FROM long JOIN v USING (tok)) "
    "SELECT o_orderkey, round(sum(x) / 3, 6) AS encoder_emb_0, round(sum(y) / 3, 6) AS encoder_emb_1 FROM beside GROUP BY o_orderkey",
)
def row_context(spark, folder):
    """Contextual row vectors, from fixed two-dimensional token vectors: the token's length and its last letter."""
    rows = table(spark, folder, "orders")
    encoder = fit_row_encoder(rows, *TOKEN_COLUMNS, size=2)
    text = F.concat("column", F.lit("="), "value")
    vector = F.array(F.length(text).cast("float"), F.ascii(F.right(text, F.lit(1))).cast("float"))
    encoder.vectors = encoder.vectors.withColumn("vector", vector)
    pairs = token_pairs(encoder.tokens(rows), "_tokens")
    return rounded(contextual_transform(encoder, rows, pairs, ["o_orderkey"]))


# -- Spark ML stages -----------------------------------------------------------------------------------------
@query(
    "pipeline_stump",
    f"WITH m AS (SELECT avg(l_quantity) AS mean, stddev_samp(l_quantity) AS std FROM main.lineitem), "
    "lineitem AS (SELECT l_orderkey, l_linenumber, l_returnflag, (l_quantity - mean) / std AS l_quantity, l_discount FROM main.lineitem, m), "
    f"{stump_sql(SIGN)} SELECT l_orderkey, l_linenumber, round(1 / (1 + exp(-2 * mean)), 6) AS score, (mean > 0)::int AS predicted FROM sided JOIN leaf USING (low)",
)
def pipeline_stump(spark, folder):
    """Grouping, scaling and a single split as one Spark ML pipeline: fitted, saved, loaded, applied."""
    rows = returned_lines(spark, folder)
    trees = stages.BoostedTrees(numeric=STUMP_FEATURES, label="returned", maxIter=1, maxDepth=1)
    steps = [stages.CategoryGrouping(columns=["l_linestatus"]), stages.StandardScaling(columns=["l_quantity"]), trees]
    path = scratch_path(spark, "pipeline")
    Pipeline(stages=steps).fit(rows).write().overwrite().save(path)
    return rounded(PipelineModel.load(path).transform(rows).select("l_orderkey", "l_linenumber", "score", "predicted"))
