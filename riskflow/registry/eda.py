"""Profiles, counts, correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskflow.functions.scalars import to_integer
from riskflow.operators import columns, correlation, joins, profile
from riskflow.registry import query, rounded, table


def labelled_documents(spark, folder):
    return joins.left_join(table(spark, folder, "documents"), table(spark, folder, "labels"), "doc_id")


def customer_orders(spark, folder):
    customer = table(spark, folder, "customer").withColumnRenamed("c_custkey", "o_custkey")
    return joins.left_join(table(spark, folder, "orders"), customer, "o_custkey")


DOCS = "documents d LEFT JOIN labels l USING (doc_id)"
DOC_COLUMNS = ["doc_id", "text", "lang", "source", "n_chars", "quality", "toxic"]
ORDER_COLUMNS = {
    "o_orderkey": "n", "o_custkey": "n", "o_orderstatus": "t", "o_totalprice": "n", "o_orderdate": "d",
    "o_orderpriority": "t", "c_name": "t", "c_nationkey": "n", "c_acctbal": "n", "c_mktsegment": "t",
}
LINE_NUMBERS = ["l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query("left_join_identity", f"SELECT d.*, l.quality, l.toxic FROM {DOCS}")
def left_join_identity(spark, folder):
    return labelled_documents(spark, folder)


@query(
    "left_join_many",
    "SELECT c_custkey, c_mktsegment, o_orderkey, o_totalprice FROM customer LEFT JOIN orders ON c_custkey = o_custkey",
)
def left_join_many(spark, folder):
    """A right side that repeats the key."""
    orders = table(spark, folder, "orders").withColumnRenamed("o_custkey", "c_custkey")
    joined = joins.left_join(table(spark, folder, "customer"), orders, "c_custkey", right_unique=False)
    return joined.select("c_custkey", "c_mktsegment", "o_orderkey", "o_totalprice")


@query(
    "non_null_counts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c})::bigint AS non_null_count, count(*)::bigint AS row_count FROM {DOCS}"
        for c in DOC_COLUMNS
    ),
)
def non_null_counts(spark, folder):
    return profile.non_null_counts(labelled_documents(spark, folder))


@query(
    "group_counts_by_target",
    "SELECT toxic, "
    + ", ".join(f"count({c}) AS {c}" for c in DOC_COLUMNS if c != "toxic")
    + f" FROM {DOCS} WHERE toxic IS NOT NULL GROUP BY toxic",
)
def group_counts_by_target(spark, folder):
    return profile.counts_by_target(labelled_documents(spark, folder), "toxic")


@query(
    "fraud_by_category",
    f"SELECT lang, toxic, count(*) AS document_count FROM {DOCS} "
    "WHERE lang IS NOT NULL AND toxic IS NOT NULL GROUP BY lang, toxic ORDER BY lang, toxic",
)
def fraud_by_category(spark, folder):
    return profile.group_counts(labelled_documents(spark, folder), ["lang", "toxic"], "document_count")


@query(
    "value_counts",
    "SELECT event_type AS value, count(*) AS count FROM events WHERE event_type IS NOT NULL "
    "GROUP BY event_type ORDER BY count DESC, value",
)
def value_counts(spark, folder):
    return profile.value_counts(table(spark, folder, "events"), "event_type")


@query("distinct_values", "SELECT DISTINCT props AS value FROM events WHERE props IS NOT NULL")
def distinct_values(spark, folder):
    return profile.distinct_values(table(spark, folder, "events"), "props")


@query(
    "target_distribution",
    "SELECT toxic, count(*) AS count, round(100.0 * count(*) / sum(count(*)) OVER (), 6) AS percent "
    "FROM labels GROUP BY toxic ORDER BY toxic",
)
def target_distribution(spark, folder):
    return rounded(profile.target_distribution(table(spark, folder, "labels"), "toxic"))


@query(
    "positive_rate",
    "SELECT count(*) AS row_count, count(*) FILTER (toxic = 1) AS positives, "
    "round(100.0 * count(*) FILTER (toxic = 1) / count(*), 6) AS positive_percent, "
    "round(100.0 - 100.0 * count(*) FILTER (toxic = 1) / count(*), 6) AS other_percent FROM labels",
)
def positive_rate(spark, folder):
    return rounded(profile.positive_rate(table(spark, folder, "labels"), "toxic"))


@query(
    "missingness",
    "SELECT column_name, null_count, round(100.0 * null_count / row_count, 6) AS null_percent FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, (count(*) - count({c}))::bigint AS null_count, count(*) AS row_count FROM {DOCS}"
        for c in DOC_COLUMNS
    )
    + ") WHERE null_count > 0 ORDER BY null_count DESC, column_name",
)
def missingness(spark, folder):
    return rounded(profile.missingness(labelled_documents(spark, folder)))


def _profile_sql() -> str:
    joined = "orders o LEFT JOIN customer c ON o.o_custkey = c.c_custkey"
    parts = []
    for c, kind in ORDER_COLUMNS.items():
        if kind == "n":
            parts.append(
                f"SELECT '{c}' AS name, 'numeric' AS kind, round(avg({c}), 6) AS mean, "
                f"round(stddev_samp({c}), 6) AS std, NULL::varchar AS categories FROM {joined}"
            )
        elif kind == "t":
            few = f"count(DISTINCT {c}) < 1000"
            parts.append(
                f"SELECT '{c}', CASE WHEN {few} THEN 'categorical' ELSE 'free_text' END, NULL, NULL, "
                f"CASE WHEN {few} THEN string_agg(DISTINCT {c}, '|' ORDER BY {c}) END FROM {joined}"
            )
        else:
            parts.append(f"SELECT '{c}', 'free_text', NULL, NULL, NULL")
    return " UNION ALL ".join(parts)


@query("column_profile", _profile_sql())
def column_profile(spark, folder):
    profiled = profile.column_profile(customer_orders(spark, folder))
    return rounded(profiled.withColumn("categories", F.array_join("categories", "|")))


@query(
    "distinct_counts",
    " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count(DISTINCT {c}) AS distinct_count FROM {DOCS}" for c in DOC_COLUMNS
    ),
)
def distinct_counts(spark, folder):
    return profile.distinct_counts(labelled_documents(spark, folder), DOC_COLUMNS)


def _describe_sql(columns_: list[str], source: str) -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, count({c}) AS count, round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std, "
        f"round(min({c}::double), 6) AS min, "
        + ", ".join(f"round(quantile_cont({c}::double, {q}), 6) AS {n}" for n, q in (("p25", 0.25), ("p50", 0.5), ("p75", 0.75)))
        + f", round(max({c}::double), 6) AS max FROM {source}"
        for c in columns_
    )


@query("describe_numeric", _describe_sql(["o_orderkey", "o_custkey", "o_totalprice"], "orders"))
def describe_numeric(spark, folder):
    return rounded(profile.describe_numeric(table(spark, folder, "orders")))


def _matrix_sql(names: list[str], source: str, prefix: str = "") -> str:
    return " UNION ALL ".join(
        f"SELECT '{a}' AS column_a, '{b}' AS column_b, "
        f"round(corr({prefix}{a}, {prefix}{b}), 6) + 0.0::double AS correlation FROM {source}"
        for i, a in enumerate(names)
        for b in names[i:]
    )


@query("pearson_matrix", _matrix_sql(LINE_NUMBERS, "lineitem"))
def pearson_matrix(spark, folder):
    return rounded(correlation.pearson_matrix(table(spark, folder, "lineitem"), LINE_NUMBERS))


def _spearman_sql() -> str:
    ranks = ", ".join(
        f"rank() OVER (ORDER BY {c}) + (count(*) OVER (PARTITION BY {c}) - 1) / 2.0 AS r_{c}" for c in LINE_NUMBERS
    )
    return f"WITH ranked AS (SELECT {ranks} FROM lineitem) " + _matrix_sql(LINE_NUMBERS, "ranked", "r_")


@query("spearman_matrix", _spearman_sql())
def spearman_matrix(spark, folder):
    return rounded(correlation.spearman_matrix(table(spark, folder, "lineitem"), LINE_NUMBERS))


@query(
    "target_correlation_topk",
    "SELECT column_name, round(r, 6) + 0.0::double AS correlation FROM ("
    + " UNION ALL ".join(
        f"SELECT '{c}' AS column_name, corr({c}, (l_returnflag = 'R')::int) AS r FROM lineitem" for c in LINE_NUMBERS
    )
    + ") ORDER BY r DESC, column_name LIMIT 15",
)
def target_correlation_topk(spark, folder):
    lines = table(spark, folder, "lineitem").withColumn("returned", (F.col("l_returnflag") == "R").cast("int"))
    return rounded(correlation.target_correlation(lines, "returned", LINE_NUMBERS))


@query(
    "data_quality_report",
    "SELECT count(*) AS row_count, 7 AS column_count, 4 AS numeric_columns, 3 AS categorical_columns, ("
    + " + ".join(f"(count({c}) < count(*))::int" for c in DOC_COLUMNS)
    + ")::int AS columns_with_nulls, count(*) FILTER (toxic = 1) AS positives, "
    "round(100.0 * count(*) FILTER (toxic = 1) / count(*), 6) AS positive_percent, "
    f"round(100.0 - 100.0 * count(*) FILTER (toxic = 1) / count(*), 6) AS other_percent FROM {DOCS}",
)
def data_quality_report(spark, folder):
    return rounded(profile.data_quality(labelled_documents(spark, folder), "toxic"))


def _summary_sql() -> str:
    types = (
        "CASE data_type WHEN 'BIGINT' THEN 'bigint' WHEN 'INTEGER' THEN 'int' WHEN 'DOUBLE' THEN 'double' "
        "WHEN 'VARCHAR' THEN 'string' WHEN 'TIMESTAMP' THEN 'timestamp_ntz' ELSE data_type END"
    )
    return " UNION ALL ".join(
        f"SELECT '{t}' AS table_name, ordinal_position::int AS position, column_name, {types} AS data_type, "
        f"(SELECT count(*) FROM {t}) AS row_count FROM information_schema.columns WHERE table_name = '{t}'"
        for t in ("orders", "customer", "lineitem")
    )


@query("table_summary", _summary_sql())
def table_summary(spark, folder):
    parts = [columns.describe_schema(table(spark, folder, t), t) for t in ("orders", "customer", "lineitem")]
    return parts[0].unionByName(parts[1]).unionByName(parts[2])


@query(
    "select_features",
    "SELECT o_orderpriority, c_mktsegment, c_nationkey, o_totalprice, c_acctbal, o_orderstatus "
    "FROM orders LEFT JOIN customer ON o_custkey = c_custkey",
)
def select_features(spark, folder):
    joined = customer_orders(spark, folder)
    used = ["o_orderpriority", "c_mktsegment", "not_there", "c_nationkey", "o_totalprice", "c_acctbal"]
    categorical, numeric = columns.feature_order(joined.columns, used, columns.text_columns(joined))
    return columns.select_features(joined, [*categorical, *numeric], "o_orderstatus")


@query(
    "rename_and_cast",
    "SELECT doc_id, coalesce(quality::varchar, 'nan') AS quality_score, coalesce(toxic::varchar, 'nan') AS toxic_text, "
    "try_cast(coalesce(toxic::varchar, 'nan') AS int) AS target, coalesce(try_cast(source AS double), 0.0::double) AS source_number, "
    "coalesce(try_cast(substr(source, 4) AS double), 0.0::double) AS source_suffix, "
    "coalesce(toxic, 0) AS toxic_filled, coalesce(nullif(lang, 'en'), '') AS lang_filled, 0.0::double AS absent_feature "
    f"FROM {DOCS}",
)
def rename_and_cast(spark, folder):
    raw = labelled_documents(spark, folder).select(
        "doc_id",
        F.col("quality").alias("quality-score"),
        F.col("toxic").alias("toxic_text"),
        F.col("source").alias("source_number"),
        F.substring("source", 4, 20).alias("source_suffix"),
        F.col("toxic").alias("toxic_filled"),
        F.nullif("lang", F.lit("en")).alias("lang_filled"),
    )
    named = columns.categories_to_text(columns.underscore_names(raw), ["quality_score", "toxic_text"])
    typed = columns.coerce_numeric(named, ["source_number", "source_suffix"])
    filled = columns.fill_by_type(typed)
    with_target = filled.withColumn("target", to_integer("toxic_text"))
    return columns.with_defaults(with_target, {"absent_feature": F.lit(0.0)})


HOLED_SQL = (
    "SELECT nullif(p_size % 10, 3)::double AS a, CASE WHEN p_size % 7 <> 2 THEN p_retailprice END AS b, "
    "p_partkey::double AS c FROM part"
)


def holed_parts(spark, folder):
    """A double column with NaN, one with nulls, one whole."""
    part = table(spark, folder, "part")
    return part.select(
        F.when(F.col("p_size") % 10 == 3, F.lit(float("nan"))).otherwise((F.col("p_size") % 10).cast("double")).alias("a"),
        F.when(F.col("p_size") % 7 != 2, F.col("p_retailprice")).alias("b"),
        F.col("p_partkey").cast("double").alias("c"),
    )


@query(
    "nan_reports",
    f"WITH h AS ({HOLED_SQL}) SELECT a::bigint::varchar AS value, count(*) AS count, "
    "(SELECT count(DISTINCT a) FROM h) AS distinct_count, any_value(a::bigint::varchar) AS text FROM h WHERE a IS NOT NULL GROUP BY a",
)
def nan_reports(spark, folder):
    """NaN is no value in counts, distinct counts and categories, and whole numbers are spelled without a fraction."""
    rows = holed_parts(spark, folder)
    counted = profile.value_counts(rows, "a").select(F.col("value").cast("bigint").cast("string").alias("value"), "count")
    distinct = profile.distinct_counts(rows, ["a"]).select("distinct_count")
    text = columns.categories_to_text(rows, ["a"], None).select(F.col("a").alias("text")).where("text IS NOT NULL").distinct()
    values = profile.distinct_values(rows, "a").select(F.col("value").cast("bigint").cast("string").alias("value"))
    return counted.join(values, "value").join(text, F.col("value") == F.col("text")).join(F.broadcast(distinct))


def _rank_sql(column: str, source: str) -> str:
    return f"rank() OVER (ORDER BY {column}) + (count(*) OVER (PARTITION BY {column}) - 1) / 2.0 AS r_{column}"


@query(
    "spearman_with_nulls",
    f"WITH h AS ({HOLED_SQL}) "
    + " UNION ALL ".join(
        f"SELECT '{x}' AS column_a, '{y}' AS column_b, round(corr(r_x, r_y), 6) + 0.0::double AS correlation FROM ("
        f"SELECT {_rank_sql('x', 'h')}, {_rank_sql('y', 'h')} FROM (SELECT {x} AS x, {y} AS y FROM h) WHERE x IS NOT NULL AND y IS NOT NULL)"
        for x, y in (("a", "a"), ("a", "b"), ("a", "c"), ("b", "b"), ("b", "c"), ("c", "c"))
    ),
)
def spearman_with_nulls(spark, folder):
    return rounded(correlation.spearman_matrix(holed_parts(spark, folder), ["a", "b", "c"]))


def _quantile_sql() -> str:
    return " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(quantile_cont({c}::double, 0.1), 6) AS q0, round(quantile_cont({c}::double, 0.5), 6) AS q1, "
        f"round(quantile_cont({c}::double, 0.99), 6) AS q2 FROM lineitem"
        for c in ("l_extendedprice", "l_quantity")
    )


@query("quantile_ranges", _quantile_sql())
def quantile_ranges(spark, folder):
    """The way taken past the counted bound of rows: sorted ranges with the totals of earlier ones."""
    lines = table(spark, folder, "lineitem")
    return rounded(profile.exact_quantiles(lines, ["l_extendedprice", "l_quantity"], (0.1, 0.5, 0.99), single_task_rows=100))
