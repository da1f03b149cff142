"""Category grouping, scaling, vocabularies, encoded rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from riskflow.operators import assemble, categorical, columns, scaling
from riskflow.operators.sampling import is_holdout, split_rows
from riskflow.plans.features import fit_features
from riskflow.registry import bucket_sql, fraction_sql, query, rounded, table
from riskflow.registry.eda import customer_orders


def mapping_sql(column: str, source: str, where: str = "TRUE") -> str:
    """Mapping rows of one column."""
    return (
        f"SELECT '{column}' AS \"column\", value, count, cumulative_count, "
        "cumulative_count / total * 100 AS cumulative_percentage, "
        "CASE WHEN cumulative_count / total * 100 > 90 THEN 'Other' ELSE value END AS category FROM ("
        "SELECT value, count, (sum(count) OVER (ORDER BY count DESC, value ROWS UNBOUNDED PRECEDING))::bigint AS cumulative_count, "
        "sum(count) OVER () AS total FROM ("
        f"SELECT coalesce({column}::varchar, 'nan') AS value, count(*) AS count FROM {source} WHERE {where} GROUP BY 1))"
    )


MAPPED = [("p_brand", "part"), ("p_type", "part"), ("p_size", "part"), ("o_orderpriority", "orders"),
          ("o_custkey", "orders"), ("event_type", "events"), ("props", "events")]


def mapping_columns(inner: str) -> str:
    return (
        'SELECT "column", value, count, cumulative_count, '
        f"round(cumulative_percentage, 6) AS cumulative_percentage, category FROM ({inner})"
    )


@query("category_mapping", mapping_columns(" UNION ALL ".join(mapping_sql(c, t) for c, t in MAPPED)))
def category_mapping(spark, folder):
    fitted = [
        categorical.fit_category_mapping(table(spark, folder, source), [c for c, t in MAPPED if t == source])
        for source in ("part", "orders", "events")
    ]
    return rounded(fitted[0].unionByName(fitted[1]).unionByName(fitted[2]))


TRAIN_ORDERS = f"{fraction_sql('o_orderkey')} <= 0.8"


def grouping_sql(column: str, mapping: str) -> str:
    return f"coalesce((SELECT m.category FROM {mapping} m WHERE m.value = {column}::varchar), 'Other')"


@query(
    "category_grouping",
    f"WITH priority AS ({mapping_sql('o_orderpriority', 'orders', TRAIN_ORDERS)}), "
    f"buyer AS ({mapping_sql('o_custkey', 'orders', TRAIN_ORDERS)}) "
    "SELECT o_orderkey, coalesce(b.category, 'Other') AS o_custkey, coalesce(p.category, 'Other') AS o_orderpriority "
    "FROM orders LEFT JOIN buyer b ON b.value = o_custkey::varchar LEFT JOIN priority p ON p.value = o_orderpriority",
)
def category_grouping(spark, folder):
    orders = table(spark, folder, "orders")
    names = ["o_orderpriority", "o_custkey"]
    train = split_rows(orders, "o_orderkey").where("set = 'train'")
    mapping = categorical.fit_category_mapping(train, names)
    return categorical.apply_category_mapping(orders, mapping, names).select("o_orderkey", *names)


SCALED = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


@query(
    "standard_scaling",
    "SELECT l_orderkey, l_linenumber, "
    + ", ".join(f"round(({c} - m_{c}) / s_{c}, 6) + 0.0::double AS {c}" for c in SCALED)
    + " FROM lineitem, (SELECT "
    + ", ".join(f"avg({c}) AS m_{c}, stddev_samp({c}) AS s_{c}" for c in SCALED)
    + " FROM lineitem)",
)
def standard_scaling(spark, folder):
    lines = table(spark, folder, "lineitem")
    scaled = scaling.apply_scaling(lines, scaling.fit_scaling(lines, SCALED))
    return rounded(scaled.select("l_orderkey", "l_linenumber", *SCALED))


@query(
    "scaling_train_to_test",
    f"WITH s AS (SELECT *, CASE WHEN {TRAIN_ORDERS} THEN 'train' ELSE 'validation' END AS \"set\" FROM orders) "
    'SELECT o_orderkey, "set", round((o_totalprice - m) / d, 6) + 0.0::double AS o_totalprice FROM s, '
    "(SELECT avg(o_totalprice) AS m, stddev_samp(o_totalprice) AS d FROM s WHERE \"set\" = 'train')",
)
def scaling_train_to_test(spark, folder):
    rows = split_rows(table(spark, folder, "orders"), "o_orderkey")
    fitted = scaling.fit_scaling(rows.where("set = 'train'"), ["o_totalprice"])
    return rounded(scaling.apply_scaling(rows, fitted).select("o_orderkey", "set", "o_totalprice"))


@query(
    "scaling_parameters",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(avg({c}), 6) AS mean, round(stddev_samp({c}), 6) AS std FROM lineitem"
        for c in SCALED
    ),
)
def scaling_parameters(spark, folder):
    return rounded(scaling.fit_scaling(table(spark, folder, "lineitem"), SCALED).table(spark))


@query(
    "engineered_features",
    "WITH j AS (SELECT * FROM orders LEFT JOIN customer ON o_custkey = c_custkey), "
    f"priority AS ({mapping_sql('o_orderpriority', 'j')}), segment AS ({mapping_sql('c_mktsegment', 'j')}), "
    "stats AS (SELECT avg(o_totalprice) AS mp, stddev_samp(o_totalprice) AS sp, avg(c_acctbal) AS ma, "
    "stddev_samp(c_acctbal) AS sa FROM j) "
    "SELECT o_orderkey, round((o_totalprice - mp) / sp, 6) + 0.0::double AS o_totalprice, "
    "round((c_acctbal - ma) / sa, 6) + 0.0::double AS c_acctbal, coalesce(p.category, 'Other') AS o_orderpriority, "
    "coalesce(s.category, 'Other') AS c_mktsegment, o_orderstatus FROM j CROSS JOIN stats "
    "LEFT JOIN priority p ON p.value = coalesce(o_orderpriority, 'nan') "
    "LEFT JOIN segment s ON s.value = coalesce(c_mktsegment, 'nan')",
)
def engineered_features(spark, folder):
    joined = customer_orders(spark, folder)
    names = ["o_orderkey", "o_totalprice", "c_acctbal", "o_orderpriority", "c_mktsegment"]
    steps = fit_features(joined, names, "o_orderstatus", ["o_orderpriority", "c_mktsegment"], key="o_orderkey")
    return rounded(joined.transform(steps.transform))


TRAINING_ORDERS = f"{bucket_sql('o_orderkey')} % 5 <> 0"
ENCODED = ["o_orderpriority", "o_custkey"]


def vocabulary_sql(column: str, source: str, where: str = "TRUE") -> str:
    return (
        f"SELECT '{column}' AS \"column\", token, (row_number() OVER (ORDER BY count DESC, token DESC))::int AS index, count FROM ("
        f"SELECT {column}::varchar AS token, count(*) AS count FROM {source} WHERE {column} IS NOT NULL AND {where} GROUP BY 1)"
    )


def training_orders(spark, folder):
    return table(spark, folder, "orders").where(~is_holdout("o_orderkey", 0.2))


@query(
    "vocabulary",
    " UNION ALL ".join(vocabulary_sql(c, "orders", TRAINING_ORDERS) for c in ENCODED)
    + " UNION ALL "
    + vocabulary_sql("p_brand", "part"),
)
def vocabulary(spark, folder):
    fitted = categorical.fit_vocabulary(training_orders(spark, folder), ENCODED)
    return fitted.unionByName(categorical.fit_vocabulary(table(spark, folder, "part"), ["p_brand"]))


@query(
    "cardinalities",
    " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", (count(DISTINCT {c}) + 1)::int AS cardinality FROM orders WHERE {TRAINING_ORDERS}"
        for c in ENCODED
    ),
)
def cardinalities(spark, folder):
    return categorical.cardinalities(categorical.fit_vocabulary(training_orders(spark, folder), ENCODED))


def _encode_sql(select: str, source: str, columns_: list[str], where: str) -> str:
    ctes = ", ".join(f"v_{c} AS ({vocabulary_sql(c, source, where)})" for c in columns_)
    joins = " ".join(f"LEFT JOIN v_{c} ON v_{c}.token = {c}::varchar" for c in columns_)
    return f"WITH {ctes} SELECT {select} FROM {source} {joins}"


@query(
    "vocabulary_encode",
    _encode_sql(
        "o_orderkey, " + ", ".join(f"coalesce(v_{c}.index, 0) AS {c}_index" for c in ENCODED), "orders", ENCODED, TRAINING_ORDERS
    ),
)
def vocabulary_encode(spark, folder):
    fitted = categorical.fit_vocabulary(training_orders(spark, folder), ENCODED)
    encoded = categorical.encode_vocabulary(table(spark, folder, "orders"), fitted, ENCODED)
    return encoded.select("o_orderkey", *(f"{c}_index" for c in ENCODED))


TRAINING_LINES = f"{bucket_sql('l_orderkey')} % 5 <> 0"


@query(
    "vocabulary_encode_shuffled",
    _encode_sql(
        "l_orderkey, l_linenumber, coalesce(v_l_partkey.index, 0) AS l_partkey_index", "lineitem", ["l_partkey"], TRAINING_LINES
    ),
)
def vocabulary_encode_shuffled(spark, folder):
    """The plan used past the broadcast bounds: frequent tokens broadcast, the rest by shuffle."""
    lines = table(spark, folder, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey")
    fitted = categorical.fit_vocabulary(lines.where(~is_holdout("l_orderkey", 0.2)), ["l_partkey"])
    encoded = categorical.encode_vocabulary(lines, fitted, ["l_partkey"], broadcast_rows=0)
    return encoded.select("l_orderkey", "l_linenumber", "l_partkey_index")


@query(
    "assemble_features",
    _encode_sql(
        "o_orderkey, coalesce(v_o_orderpriority.index, 0) || ',' || coalesce(v_o_custkey.index, 0) || ',0' AS categorical_features, "
        "2 AS numeric_size, round(o_totalprice, 6) AS numeric_0, 0.0::double AS numeric_1",
        "orders",
        ENCODED,
        TRAINING_ORDERS,
    ),
)
def assemble_features(spark, folder):
    fitted = categorical.fit_vocabulary(training_orders(spark, folder), ENCODED)
    rows = assemble.encode_rows(
        table(spark, folder, "orders"), fitted, [*ENCODED, "absent_category"], ["o_totalprice", "absent_number"]
    )
    flat = assemble.spread_array(rows, "numeric_features", "numeric_", 2)
    return rounded(
        flat.select(
            "o_orderkey",
            F.array_join(F.col("categorical_features").cast("array<string>"), ",").alias("categorical_features"),
            F.size("numeric_features").alias("numeric_size"),
            "numeric_0",
            "numeric_1",
        )
    )


@query(
    "vector_to_columns",
    "SELECT vec_id, round(list_avg(embedding::double[]), 6) + 0.0::double AS mean_value, "
    + ", ".join(f"round(embedding[{i + 1}]::double, 6) + 0.0::double AS part_{i}" for i in range(64))
    + " FROM embeddings",
)
def vector_to_columns(spark, folder):
    vectors = table(spark, folder, "embeddings")
    spread = assemble.spread_array(vectors, "embedding", "part_", 64)
    return rounded(
        spread.select(
            "vec_id",
            assemble.array_mean("embedding").alias("mean_value"),
            *(F.col(f"part_{i}").cast("double").alias(f"part_{i}") for i in range(64)),
        )
    )


@query("default_target", "SELECT *, -1 AS is_fraud FROM orders")
def default_target(spark, folder):
    return columns.add_target_if_absent(table(spark, folder, "orders"), "is_fraud", -1)
