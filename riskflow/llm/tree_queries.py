"""Queries and SQL of the manifest, the prefix trie and decontamination."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from riskflow.llm import decontamination, merkle, prefix_trie


def _crc32(value: str) -> Column:
    return F.crc32(F.col(value).cast("string").cast("binary"))


def _crc32_sql(value: str) -> str:
    """Unsigned CRC-32 of a decimal number: bytes are mixed in, then eight shifts with the polynomial each."""
    steps = ", ".join(["-1"] * 8)
    return (
        f"xor(list_reduce([4294967295] || flatten(list_transform(string_split({value}::varchar, ''), lambda d: [ord(d)::bigint, {steps}])), "
        "lambda c, x: CASE WHEN x >= 0 THEN xor(c, x) ELSE xor(c >> 1, 3988292384 * (c & 1)) END), 4294967295)"
    )


FIELDS = ["doc_id", "source", "lang", "n_chars", "text"]


def op11_merkle_manifest(spark: SparkSession, folder: str) -> DataFrame:
    documents = spark.read.parquet(f"{folder}/documents.parquet")
    tampered = F.when(_crc32("doc_id") % 7 == 0, F.col("n_chars") + 1).otherwise(F.col("n_chars"))
    return merkle.build_manifest(documents, FIELDS, claims={"n_chars": tampered}).proofs().withColumnRenamed("key", "doc_id")


def _leaf_sql(changed: str | None = None) -> str:
    shown = (f"({changed})::varchar" if changed and f == "n_chars" else f"{f}::varchar" for f in FIELDS)
    return "sha256(" + " || ".join(f"coalesce(strlen({s}) || ':' || {s}, '-')" for s in shown) + ")"


OP11_SQL = f"""
WITH RECURSIVE rows AS (
  SELECT doc_id, coalesce('=' || lang, '') AS tree, {_leaf_sql()} AS leaf,
    CASE WHEN {_crc32_sql('doc_id')} % 7 = 0 AND n_chars IS NOT NULL THEN {_leaf_sql('n_chars + 1')} END AS claim
  FROM documents
), leaves AS (
  SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY tree) AS n FROM rows
), nodes(tree, level, pos, n, h) AS (
  SELECT tree, 0, pos, n, leaf FROM leaves
  UNION ALL
  SELECT tree, level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM nodes WHERE n > 1 GROUP BY tree, level, pos // 2, n
), subroots AS (
  SELECT tree, h, row_number() OVER (ORDER BY tree) - 1 AS pos, count(*) OVER () AS n FROM nodes WHERE n = 1
), tops(level, pos, n, h) AS (
  SELECT 0, pos, n, h FROM subroots
  UNION ALL
  SELECT level + 1, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' ORDER BY pos)) FROM tops WHERE n > 1 GROUP BY level, pos // 2, n
), steps AS (
  SELECT l.tree, l.pos, own.level AS step, CASE WHEN s.h IS NULL THEN 'A' WHEN s.pos > own.pos THEN 'R' || s.h ELSE 'L' || s.h END AS move
  FROM leaves l JOIN nodes own ON own.tree = l.tree AND own.n > 1 AND own.pos = l.pos >> own.level
  LEFT JOIN nodes s ON s.tree = own.tree AND s.level = own.level AND s.pos = xor(own.pos, 1)
  UNION ALL
  SELECT l.tree, l.pos, 1000 + own.level, CASE WHEN s.h IS NULL THEN 'A' WHEN s.pos > own.pos THEN 'R' || s.h ELSE 'L' || s.h END
  FROM leaves l JOIN subroots r ON r.tree = l.tree JOIN tops own ON own.n > 1 AND own.pos = r.pos >> own.level
  LEFT JOIN tops s ON s.level = own.level AND s.pos = xor(own.pos, 1)
), ways AS (
  SELECT tree, pos, list(move ORDER BY step) AS moves FROM steps GROUP BY tree, pos
), folded AS (
  SELECT l.doc_id, l.leaf, r.h AS subroot, (SELECT h FROM tops WHERE n = 1) AS root,
    sha256(coalesce(array_to_string(list_transform(w.moves, lambda m: m[2:]), ''), '')) AS proof_sha256,
    list_reduce([coalesce(l.claim, l.leaf)] || coalesce(w.moves, []), lambda c, m: sha256(CASE m[1] WHEN 'A' THEN c WHEN 'R' THEN c || m[2:] ELSE m[2:] || c END)) AS folded_root
  FROM leaves l JOIN subroots r ON r.tree = l.tree LEFT JOIN ways w ON w.tree = l.tree AND w.pos = l.pos
)
SELECT *, folded_root = root AS verified FROM folded
"""


def op12_prefix_trie(spark: SparkSession, folder: str) -> DataFrame:
    conversations = spark.read.parquet(f"{folder}/conversations.parquet")
    return prefix_trie.trie_nodes(prefix_trie.with_shared_start(prefix_trie.sequences(conversations)))


OP12_SQL = f"""
WITH turns AS (
  SELECT conv_id, list({{'role': coalesce(role, ''), 'text': coalesce(text, '')}} ORDER BY turn NULLS FIRST, role NULLS FIRST, text NULLS FIRST) AS said
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
), rebuilt AS (
  SELECT t.conv_id, coalesce(b.said, [])[1:h] || t.said[h + 1:] AS said
  FROM (SELECT *, {_crc32_sql('conv_id')} % 4 AS h FROM turns) t LEFT JOIN turns b ON b.conv_id = t.conv_id - t.conv_id % 20
), paths AS (
  SELECT conv_id, len(said) AS size, unnest(range(0, len(said) + 1)) AS depth, said FROM rebuilt
), keyed AS (
  SELECT conv_id, size, depth, said[1:depth] AS path, CASE WHEN size > depth THEN said[depth + 1] END AS following FROM paths
), nodes AS (
  SELECT depth, path, min(conv_id) AS conv_id, count(*) AS n_convs, count(DISTINCT following) AS n_children,
    sha256(coalesce(string_agg(conv_id::varchar, ',' ORDER BY conv_id) FILTER (size = depth), '')) AS ends_sha256,
    (count(*) - 1) * CASE WHEN depth = 0 THEN 0 ELSE len(regexp_extract_all(path[depth].text, '[^\\x20\\x09-\\x0D]+')) END AS saved
  FROM keyed GROUP BY depth, path
), below AS (
  SELECT n_children, saved, unnest(range(0, depth + 1)) AS up, path FROM nodes
), sums AS (
  SELECT path[1:up] AS path, up AS depth, count(*) FILTER (n_children = 0) AS n_leaves, sum(saved)::bigint AS saved_tokens FROM below GROUP BY 1, 2
)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, n.n_children, s.n_leaves, s.saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.depth = n.depth AND s.path = n.path LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.path[1:n.depth - 1]
"""


def op13_decontamination(spark: SparkSession, folder: str) -> DataFrame:
    documents, benchmark = (spark.read.parquet(f"{folder}/{name}.parquet") for name in ("documents", "benchmark"))
    found = decontamination.contamination(documents, benchmark)
    return found.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("bigint").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.col("n_hit") > 0).alias("contaminated"),
    )


_WORDS_SQL = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"

OP13_SQL = f"""
WITH d AS (SELECT doc_id, {_WORDS_SQL} AS w FROM documents),
items AS (SELECT coalesce(item_id::varchar, '') AS item, {_WORDS_SQL} AS w FROM benchmark),
spots AS (SELECT item, w, least(len(w), 10) AS n, unnest(range(0, greatest(len(w) - 10, 0) + 1)) AS i FROM items WHERE len(w) > 0),
windows AS (SELECT DISTINCT item, n, array_to_string(w[i + 1:i + n], ' ') AS words FROM spots),
places AS (SELECT d.doc_id, d.w, l.n, unnest(range(0, len(d.w) - l.n + 1)) AS i FROM d, (SELECT DISTINCT n FROM windows) l WHERE len(d.w) >= l.n),
runs AS (SELECT doc_id, i, n, array_to_string(w[i + 1:i + n], ' ') AS words FROM places),
found AS (SELECT r.doc_id, r.i, r.n, x.item FROM runs r JOIN windows x ON x.n = r.n AND x.words = r.words),
hit AS (SELECT doc_id, count(DISTINCT pos) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + n)) AS pos FROM found) GROUP BY doc_id),
named AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS ids FROM (SELECT DISTINCT doc_id, item FROM found) GROUP BY doc_id)
SELECT d.doc_id, len(d.w) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(ids, '')) AS items_sha256,
  n_hit IS NOT NULL AS contaminated
FROM d LEFT JOIN hit USING (doc_id) LEFT JOIN named USING (doc_id)
"""

QUERIES = {f.__name__: f for f in (op11_merkle_manifest, op12_prefix_trie, op13_decontamination)}
ORACLES = {"op11_merkle_manifest": OP11_SQL, "op12_prefix_trie": OP12_SQL, "op13_decontamination": OP13_SQL}
