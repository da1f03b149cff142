"""Samples, splits, folds, weights."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskflow.functions.hashing import hash_fraction
from riskflow.operators import sampling
from riskflow.registry import bucket_sql, fraction_sql, query, rounded, table

LINE_KEY = ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber"]
LINE_KEY_SQL = " || '|' || ".join(LINE_KEY)


@query(
    "semi_join_cohort",
    f"SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE {fraction_sql('o_orderkey')} < 0.1)",
)
def semi_join_cohort(spark, folder):
    orders = table(spark, folder, "orders").withColumnRenamed("o_custkey", "c_custkey")
    chosen = sampling.sample_rows(orders, "o_orderkey", 0.1)
    return sampling.semi_join(table(spark, folder, "customer"), chosen, "c_custkey")


@query(
    "cohort_sample",
    f"WITH p AS (SELECT * FROM orders WHERE {fraction_sql('o_orderkey')} < 0.1) "
    "SELECT l_orderkey, l_partkey, l_linenumber, l_quantity FROM lineitem WHERE l_orderkey IN (SELECT o_orderkey FROM p)",
)
def cohort_sample(spark, folder):
    orders = table(spark, folder, "orders").withColumnRenamed("o_orderkey", "l_orderkey")
    _, lines = sampling.sample_cohort(orders, table(spark, folder, "lineitem"), "l_orderkey", 0.1)
    return lines.select("l_orderkey", "l_partkey", "l_linenumber", "l_quantity")


@query("row_sample", f"SELECT * FROM events WHERE {fraction_sql('event_id')} < 0.3")
def row_sample(spark, folder):
    return sampling.sample_rows(table(spark, folder, "events"), "event_id", 0.3)


SETS = "CASE WHEN {} <= 0.8 THEN 'train' ELSE 'validation' END"


@query(
    "hash_split",
    f"SELECT o_orderkey, o_totalprice, {SETS.format(fraction_sql('o_orderkey'))} AS \"set\", "
    f"round({fraction_sql('o_orderkey')}, 9) AS fraction FROM orders",
)
def hash_split(spark, folder):
    rows = sampling.split_rows(table(spark, folder, "orders"), "o_orderkey")
    fraction = F.round(hash_fraction("o_orderkey", 42), 9).alias("fraction")
    return rows.select("o_orderkey", "o_totalprice", "set", fraction)


@query(
    "modulo_holdout",
    f"SELECT o_orderkey, ({bucket_sql('o_orderkey')} % 5 = 0)::int AS held_out, "
    f"({bucket_sql('o_orderkey')} % 2 = 0)::int AS half FROM orders",
)
def modulo_holdout(spark, folder):
    return table(spark, folder, "orders").select(
        "o_orderkey",
        sampling.is_holdout("o_orderkey", 0.2).cast("int").alias("held_out"),
        sampling.is_holdout("o_orderkey", 0.9).cast("int").alias("half"),
    )


@query(
    "negative_sampling",
    "WITH r AS (SELECT l_orderkey, l_partkey, l_suppkey, l_linenumber, (l_returnflag = 'R')::int AS returned FROM lineitem), "
    "k AS (SELECT least(1.0::double, count(*) FILTER (returned = 1) / count(*) FILTER (returned = 0)) AS fraction FROM r) "
    f"SELECT r.* FROM r, k WHERE returned = 1 OR {fraction_sql(LINE_KEY_SQL)} < fraction",
)
def negative_sampling(spark, folder):
    lines = table(spark, folder, "lineitem").select(*LINE_KEY, (F.col("l_returnflag") == "R").cast("int").alias("returned"))
    return sampling.undersample_negatives(lines, "returned", LINE_KEY)


@query(
    "stratified_folds",
    "SELECT doc_id, toxic, ((row_number() OVER (PARTITION BY toxic ORDER BY md5('42|' || doc_id), doc_id) - 1) % 5)::int AS fold "
    "FROM labels",
)
def stratified_folds(spark, folder):
    return sampling.stratified_folds(table(spark, folder, "labels"), "toxic", "doc_id").select("doc_id", "toxic", "fold")


@query(
    "folds_ranges",
    "SELECT l_orderkey, l_linenumber, l_returnflag, ((row_number() OVER (PARTITION BY l_returnflag ORDER BY md5('42|' || k), k) - 1) % 5)::int AS fold "
    f"FROM (SELECT *, {LINE_KEY_SQL} AS k FROM lineitem)",
)
def folds_ranges(spark, folder):
    """Exact folds by the way taken past the counted bound of rows."""
    lines = table(spark, folder, "lineitem").withColumn("k", F.concat_ws("|", *LINE_KEY))
    found = sampling.stratified_folds(lines, "l_returnflag", "k", single_task_rows=100)
    return found.select("l_orderkey", "l_linenumber", "l_returnflag", "fold")


@query("hashed_folds", f"SELECT o_orderkey, ({bucket_sql('o_orderkey')} % 5)::int AS fold FROM orders")
def hashed_folds(spark, folder):
    return sampling.hashed_folds(table(spark, folder, "orders"), "o_orderkey").select("o_orderkey", "fold")


@query(
    "class_weights",
    "SELECT l_returnflag AS label, count(*) AS count, "
    "round((SELECT count(*) FROM lineitem) / ((SELECT count(DISTINCT l_returnflag) FROM lineitem) * count(*)), 6) AS weight "
    "FROM lineitem GROUP BY l_returnflag",
)
def class_weights(spark, folder):
    return rounded(sampling.class_weights(table(spark, folder, "lineitem"), "l_returnflag"))


@query(
    "weighted_rows",
    "SELECT l_orderkey, l_linenumber, l_returnflag, round(n / (k * c), 6) AS weight FROM lineitem "
    "JOIN (SELECT l_returnflag, count(*) AS c FROM lineitem GROUP BY 1) USING (l_returnflag), "
    "(SELECT count(*) AS n, count(DISTINCT l_returnflag) AS k FROM lineitem)",
)
def weighted_rows(spark, folder):
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_returnflag")
    return rounded(sampling.with_class_weights(lines, "l_returnflag"))


@query("seeded_order_preview", "SELECT * FROM orders ORDER BY md5('42|' || o_orderkey), o_orderkey LIMIT 100")
def seeded_order_preview(spark, folder):
    return sampling.preview(sampling.shuffled(table(spark, folder, "orders"), "o_orderkey"), 100)
