"""Score, metric and vector tables derived from the given tables, each as one SQL text.

The text runs unchanged on Spark and on other SQL engines, so that a query and its reference SQL start from
the same rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from repselect.operators.sampling import uniform_cap
from repselect.session import table

FAMILY = "CASE WHEN n < 3 THEN 'Classification' WHEN n < 6 THEN 'Clustering' WHEN n = 6 THEN 'PairClassification' ELSE 'STS' END"
FEATURES = {  # name: (direction, expression)
    "harmonic": (1, "avg(l_discount) + avg(l_quantity) / 900"), "spectral_gap": (1, "avg(l_quantity) / 49.7"), "entropy": (1, "avg(l_extendedprice) / 100000"),
    "participation": (1, "avg(l_tax)"), "anisotropy": (-1, "avg(l_discount * l_tax)"), "intrinsic_dim": (1, "avg(CASE WHEN l_returnflag = 'R' THEN CAST(1 AS DOUBLE) ELSE CAST(0 AS DOUBLE) END)"),
    "curvature": (-1, "avg(l_quantity * l_tax)"), "infonce": (-1, "avg(l_discount) - avg(l_tax)"), "lidar": (1, "max(l_quantity) / 50"),
}
_KEYS = "concat('m', l_suppkey % 7) AS model_alias, concat('t', l_partkey % 11) AS task"

VIEWS = {
    "scores_long": f"""SELECT model_alias, task, {FAMILY} AS task_type, seed, layer, primary_score FROM (
      SELECT {_KEYS}, l_partkey % 11 AS n, 11 * (1 + l_orderkey % 4) AS seed, l_linenumber AS layer,
             round(avg(l_discount) + avg(l_quantity) / 1000, 6) AS primary_score
      FROM lineitem GROUP BY l_suppkey % 7, l_partkey % 11, l_orderkey % 4, l_linenumber)""",
    "metrics_long": " UNION ALL ".join(
        f"""SELECT {_KEYS}, l_linenumber AS layer, '{k}' AS feature, {d} AS direction, round({e}, 6) AS raw_value
      FROM lineitem GROUP BY l_suppkey % 7, l_partkey % 11, l_linenumber""" for k, (d, e) in FEATURES.items()),
    "curves_long": f"""SELECT model_alias, task, {FAMILY} AS task_type, layer, k, energy,
             round(sum(energy) OVER (PARTITION BY model_alias, task, layer ORDER BY k) / sum(energy) OVER (PARTITION BY model_alias, task, layer), 9) AS mass,
             round(ln(1 + sum(energy) OVER (PARTITION BY model_alias, task, layer ORDER BY k)), 9) AS h_k FROM (
      SELECT {_KEYS}, l_partkey % 11 AS n, l_linenumber AS layer, 1 + l_orderkey % 12 AS k, round(avg(l_quantity), 6) AS energy
      FROM lineitem GROUP BY l_suppkey % 7, l_partkey % 11, l_linenumber, 1 + l_orderkey % 12)""",
    "items": """SELECT d.doc_id AS item_id, d.lang AS task, l.quality AS label, d.source AS source FROM documents d JOIN labels l ON d.doc_id = l.doc_id""",
}


def sql_with(body: str, *names: str) -> str:
    """``body`` behind the named views."""
    return "WITH " + ", ".join(f"{n} AS ({VIEWS[n]})" for n in names) + " " + body


def view(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The derived table ``name`` over the tables of a data directory."""
    sources = {t: table(spark, sf_dir, t) for t in ("lineitem", "documents", "labels") if f" {t} " in VIEWS[name] + " "}
    text = VIEWS[name]
    for t in sources:
        text = text.replace(f"FROM {t} ", f"FROM {{{t}}} ").replace(f"JOIN {t} ", f"JOIN {{{t}}} ")
    return spark.sql(text, **sources)


def reps(spark: SparkSession, sf_dir: str, layers: tuple[int, ...] = (1, 4, 8)) -> DataFrame:
    """``model_alias, task, layer, item_id, vec``: model ``m0`` takes the first ``8 * layer`` numbers of each
    embedding, ``m1`` those of the reversed one."""
    vectors = table(spark, sf_dir, "embeddings").where("embedding is not null")
    layer = ", ".join(map(str, layers))
    return vectors.selectExpr("vec_id AS item_id", "label", "embedding", f"explode(array({layer})) AS layer").selectExpr(
        "layer", "item_id", "label", "explode(map('m0', slice(embedding, 1, 8 * layer), 'm1', slice(reverse(embedding), 1, 8 * layer))) AS (model_alias, vec)"
    ).selectExpr("model_alias", "'all' AS task", "layer", "item_id", "label", "vec")


#: Items of a candidate that pair and spectrum metrics are worked out on, drawn by a hash of seed and id.
COHORT, COHORT_SEED = 512, 123


def cohort(spark: SparkSession, sf_dir: str, layers: tuple[int, ...] = (1, 4, 8)) -> DataFrame:
    """``reps`` of a sample of ``COHORT`` items, the same for all candidates."""
    drawn = uniform_cap(table(spark, sf_dir, "embeddings").where("embedding is not null").selectExpr("vec_id AS item_id", "'all' AS task"), ["task"], COHORT, COHORT_SEED)
    return reps(spark, sf_dir, layers).join(drawn.select("item_id"), "item_id", "left_semi").select("model_alias", "task", "layer", "item_id", "label", "vec")


REPS_SQL = """reps AS (
  SELECT m AS model_alias, 'all' AS task, layer, vec_id AS item_id, label, CASE WHEN m = 'm0' THEN embedding[1:8 * layer] ELSE list_reverse(embedding)[1:8 * layer] END AS vec
  FROM embeddings, (SELECT unnest([1, 4, 8]) AS layer), (SELECT unnest(['m0', 'm1']) AS m) WHERE embedding IS NOT NULL)"""

COHORT_SQL = f"""drawn AS (SELECT * FROM embeddings WHERE embedding IS NOT NULL
  QUALIFY row_number() OVER (ORDER BY ('0x' || left(md5('{COHORT_SEED}|' || vec_id), 8))::BIGINT, vec_id) <= {COHORT}), """ + REPS_SQL.replace("FROM embeddings", "FROM drawn")
