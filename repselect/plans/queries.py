"""Registered queries of the library's own operators and their SQL.

Each query applies one operator to whole tables; doubles are rounded to nine digits on both sides.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from repselect.functions import scalars as S
from repselect.operators import evaluators as E, ranking as H, sampling as C, statistics as I, summaries as G, tiles as N, validation as J, vectors as D
from repselect.sources import tables as A
from repselect.sources.fixtures import COHORT, COHORT_SQL, REPS_SQL, cohort, reps, sql_with, view
from repselect.session import table

QUERIES: dict = {}
ORACLE_SQL: dict = {}
CASE = ["model_alias", "task"]
SEEDS = [11, 22, 33, 44]
#: The t quantile beyond the table's degrees of freedom, by the series.
T_FAR = "(" + " + ".join([str(S.Z_975), *[f"{c} * pow(1.0::DOUBLE / ({{n}} - 1), {k})" for k, c in enumerate(S.T_SERIES, 1)]]) + ")"
T = "[" + ", ".join(str(S.T_TABLE[k]) for k in sorted(S.T_TABLE)) + "]"


def query(sql: str | None = None, digits: int = 9):
    """Registers a function of (spark, sf_dir), its doubles rounded, under its name."""
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: S.rounded(f(spark, sf_dir), digits)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f
    return add


#: The hash of ``content_hash`` over rows whose MD5 is ``h``.
HASH = "md5(concat_ws(':', count(*), sum(('0x' || left(h, 12))::BIGINT)::VARCHAR, sum(('0x' || substr(h, 13, 12))::BIGINT)::VARCHAR))"


def r(*columns: str, digits: int = 9) -> str:
    """Select items that round ``name`` or ``expression AS name``."""
    out = []
    for c in columns:
        expression, _, name = c.rpartition(" AS ")
        out.append(f"round({expression or name}, {digits}) + 0 AS {name}")
    return ", ".join(out)


def scores(spark, sf_dir):
    return view(spark, sf_dir, "scores_long")


def metrics(spark, sf_dir):
    return view(spark, sf_dir, "metrics_long")


def curves(spark, sf_dir):
    return view(spark, sf_dir, "curves_long")


def items(spark, sf_dir):
    return view(spark, sf_dir, "items")


# sources and sinks


@query(sql_with("SELECT model_alias, task, seed, layer, primary_score FROM scores_long", "scores_long"))
def a1_collect_seed_results(spark, sf_dir):
    return A.explode_results(A.nest_results(scores(spark, sf_dir), [*CASE, "seed"]))


@query("SELECT l_orderkey, l_linenumber, " + r("l_discount AS primary_score") + " FROM lineitem")
def a2_read_long(spark, sf_dir):
    df = A.read_long(spark, f"{sf_dir}/lineitem.parquet", "l_orderkey long, l_linenumber int, l_discount double", required=("l_discount",))
    return A.select_by_alias(df, {"l_orderkey": [], "l_linenumber": [], "primary_score": ["score", "l_discount"]})


@query(sql_with("SELECT model_alias, task, layer, feature, direction * raw_value AS oriented_value FROM metrics_long", "metrics_long"))
def a6_flatten_metrics(spark, sf_dir):
    m = metrics(spark, sf_dir).withColumn("oriented", F.col("direction") * F.col("raw_value"))
    nested = m.groupBy(*CASE, "feature").agg(F.sort_array(F.collect_list(F.struct("layer", "oriented"))).alias("s"))
    return A.flatten_metrics(nested.select(*CASE, "feature", F.col("s.layer").alias("layer_indices"), F.col("s.oriented").alias("values")), CASE).withColumnRenamed("value", "oriented_value")


@query(sql_with("""SELECT model_alias, task, string_agg(layer, ',' ORDER BY layer) AS layers, count(*) AS n_layers, round(sum(m), 9) + 0 AS mean_sum, max(n) AS n_seeds
  FROM (SELECT model_alias, task, layer, avg(primary_score) AS m, count(*) AS n FROM scores_long GROUP BY ALL) GROUP BY model_alias, task""", "scores_long"))
def a7_export_targets(spark, sf_dir):
    s = scores(spark, sf_dir)
    doc = A.export_targets(G.summarize_profiles(s, [*CASE, "layer"]), s, CASE)
    return doc.select(*CASE, F.concat_ws(",", F.col("layers").cast("array<string>")).alias("layers"), F.size("layers").cast("long").alias("n_layers"),
                      F.aggregate("mean", F.lit(0.0), lambda a, b: a + b).alias("mean_sum"), F.size(F.map_keys("by_seed")).cast("long").alias("n_seeds"))


@query("""SELECT dataset, subset, split FROM (SELECT *, row_number() OVER (PARTITION BY dataset ORDER BY
    CASE split WHEN 'test' THEN 1 WHEN 'validation' THEN 2 WHEN 'dev' THEN 3 WHEN 'train' THEN 4 ELSE 99 END, CASE subset WHEN 'default' THEN 1 WHEN 'en' THEN 2 WHEN 'eng' THEN 3 WHEN 'en-en' THEN 4 ELSE 99 END, subset, split) AS rn
  FROM (SELECT DISTINCT source AS dataset, lang AS subset, CASE doc_id % 5 WHEN 0 THEN 'train' WHEN 1 THEN 'dev' WHEN 2 THEN 'validation' ELSE 'other' END AS split FROM documents)) WHERE rn = 1""")
def a8_resolve_split(spark, sf_dir):
    k = F.col("doc_id") % 5
    split = F.when(k == 0, "train").when(k == 1, "dev").when(k == 2, "validation").otherwise("other")
    return C.resolve_split(table(spark, sf_dir, "documents").select(F.col("source").alias("dataset"), F.col("lang").alias("subset"), split.alias("split")).distinct())


@query(sql_with("SELECT model_alias, task, seed, layer FROM scores_long WHERE NOT (seed = 11 AND layer < 4)", "scores_long"))
def a9_remaining_work(spark, sf_dir):
    s = scores(spark, sf_dir).select(*CASE, "seed", "layer", F.lit("f").alias("fingerprint"))
    return A.remaining_work(s, s.where("seed = 11 and layer < 4"), [*CASE, "seed", "layer"], "fingerprint").drop("fingerprint")


@query(f"""WITH {REPS_SQL}, n AS (SELECT model_alias, task, count(DISTINCT layer) AS num_layers FROM reps GROUP BY ALL),
  i AS (SELECT model_alias, task, count(*) AS n_items, {HASH} AS sample_hash FROM (SELECT DISTINCT model_alias, task, md5(concat_ws(':', '', item_id)) AS h FROM reps) GROUP BY ALL),
  e AS (SELECT model_alias, task, {HASH} AS embedding_hash FROM (SELECT model_alias, task, md5(concat_ws(':', layer, '', item_id, array_to_string(list_transform(vec, lambda x: round(x::DOUBLE * 1e6)::BIGINT), ','))) AS h FROM reps) GROUP BY ALL)
  SELECT model_alias, task, num_layers, n_items, sample_hash, embedding_hash, md5('pooling=mean') AS fingerprint FROM n JOIN i USING (model_alias, task) JOIN e USING (model_alias, task)""")
def a5_cache_meta(spark, sf_dir):
    return A.cache_meta(reps(spark, sf_dir), "pooling=mean")


# scalar functions


@query("""SELECT doc_id, md5(CASE WHEN trim(lang) <> '' AND lang <> 'en' THEN trim(lang) ELSE concat_ws(' ', nullif(trim(source), ''), nullif(trim(text), '')) END) AS text_md5 FROM documents""")
def b3_text_from_row(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").withColumn("preferred", F.when(F.col("lang") != "en", F.col("lang")))
    return docs.select("doc_id", F.md5(S.text_from_row("preferred", ["source", "text"])).alias("text_md5"))


@query(sql_with("SELECT DISTINCT task, task_type, task_type AS family FROM scores_long", "scores_long"))
def b4_family_of(spark, sf_dir):
    s = scores(spark, sf_dir).select("task", "task_type").distinct()
    return s.withColumn("family", S.family_of(F.concat(F.lit("My-"), F.col("task_type"), F.lit(" (v2)"))))


@query(sql_with("""SELECT DISTINCT feature, CASE feature WHEN 'harmonic' THEN 'Harmonic score' WHEN 'spectral_gap' THEN 'Spectral gap' WHEN 'infonce' THEN 'InfoNCE' WHEN 'lidar' THEN 'LiDAR'
  WHEN 'intrinsic_dim' THEN 'Intrinsic Dim' ELSE upper(feature[1]) || feature[2:] END AS label FROM metrics_long""", "metrics_long"))
def b5_display_name(spark, sf_dir):
    return metrics(spark, sf_dir).select("feature").distinct().withColumn("label", S.display_name(F.col("feature")))


@query("SELECT doc_id FROM documents WHERE source LIKE '%src1%'")
def b6_keep_if_any(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "source")
    return S.keep_if_any(S.keep_if_any(docs, F.col("source").rlike("src1")), F.col("source") == "nowhere").select("doc_id")


@query("SELECT event_id, " + r("try_cast(value AS DOUBLE) AS number") + " FROM events WHERE value IS NOT NULL")
def b7_numeric(spark, sf_dir):
    return table(spark, sf_dir, "events").select("event_id", S.number(F.col("value").cast("string").try_cast("double")).alias("number")).dropna(subset=["number"])


@query(sql_with("SELECT model_alias, task, layer, feature, direction * raw_value AS oriented_value, model_alias || '::L' || layer AS candidate FROM metrics_long", "metrics_long"))
def b8_orientation(spark, sf_dir):
    return metrics(spark, sf_dir).select(*CASE, "layer", "feature", (F.col("direction") * F.col("raw_value")).alias("oriented_value"), F.concat_ws("::L", "model_alias", "layer").alias("candidate"))


@query(sql_with("SELECT DISTINCT model_alias, task, layer, dense_rank() OVER (PARTITION BY model_alias, task ORDER BY layer) - 1 AS position FROM scores_long", "scores_long"))
def b9_layer_positions(spark, sf_dir):
    return scores(spark, sf_dir).select(*CASE, "layer").distinct().withColumn("position", F.dense_rank().over(Window.partitionBy(*CASE).orderBy("layer")).cast("long") - 1)


@query("SELECT 'a' AS side, vec_id FROM embeddings WHERE vec_id % 2 = 0 UNION ALL SELECT 'b', vec_id FROM embeddings WHERE vec_id % 2 = 1")
def b11_pair_nodes(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").select("vec_id")
    return A.both_sides(v.where("vec_id % 2 = 0"), v.where("vec_id % 2 = 1"))


@query("SELECT doc_id, left(sha256('{\"lang\":\"' || lang || '\",\"source\":\"' || source || '\"}'), 20) AS hash FROM documents")
def b15_stable_hash(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.stable_hash("source", "lang").alias("hash"))


@query("SELECT doc_id, ((('0x' || left(sha256('7||' || doc_id), 16))::UBIGINT) % 2147483647)::BIGINT AS seed FROM documents")
def b16_stable_seed(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", S.stable_seed(F.lit(7), F.col("doc_id")).alias("seed"))


@query(sql_with(f"SELECT model_alias, task, {HASH} AS hash FROM (SELECT model_alias, task, md5(concat_ws(':', row_number() OVER (PARTITION BY model_alias, task ORDER BY seed, layer) - 1, layer, seed)) AS h FROM scores_long) GROUP BY ALL", "scores_long"))
def b17_array_hash(spark, sf_dir):
    place = F.row_number().over(Window.partitionBy(*CASE).orderBy("seed", "layer")) - 1
    return scores(spark, sf_dir).withColumn("place", place).groupBy(*CASE).agg(S.content_hash(F.col("place"), F.col("layer"), F.col("seed")).alias("hash"))


@query("SELECT DISTINCT lang, dense_rank() OVER (ORDER BY lang) - 1 AS code FROM documents")
def b18_label_codes(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("lang").distinct().withColumn("code", F.dense_rank().over(Window.orderBy("lang")).cast("long") - 1)


# samples and splits

U = "(('0x' || left(md5(concat_ws('|', {})), 8))::BIGINT / 4294967296.0)"


@query(sql_with(f"SELECT task, item_id FROM (SELECT *, row_number() OVER (PARTITION BY task ORDER BY {U.format('7, item_id')}, item_id) AS p FROM items) WHERE p <= 40", "items"))
def c1_uniform_cap(spark, sf_dir):
    return C.uniform_cap(items(spark, sf_dir), ["task"], 40, 7).select("task", "item_id")


ALLOCATION = """counts AS (SELECT task, label, count(*) AS n_class FROM items GROUP BY ALL),
  shares AS (SELECT *, sum(n_class) OVER (PARTITION BY task) AS n FROM counts),
  floors AS (SELECT *, n_class * least({size}, n) / n AS share, floor(n_class * least({size}, n) / n) AS f FROM shares),
  takes AS (SELECT task, label, n_class, (f + CASE WHEN row_number() OVER (PARTITION BY task ORDER BY round(f - share, 9), label) <= least({size}, n) - sum(f) OVER (PARTITION BY task) THEN 1 ELSE 0 END)::BIGINT AS take FROM floors)"""


@query(sql_with("SELECT * FROM takes", "items").replace(" SELECT * FROM takes", ", " + ALLOCATION.format(size=50) + " SELECT * FROM takes"))
def c7_allocation(spark, sf_dir):
    return C.allocation(items(spark, sf_dir), ["task"], "label", F.lit(50))


PLACE = f"row_number() OVER (PARTITION BY task, label ORDER BY {U.format('{seed}, item_id')}, item_id)"


@query(sql_with("X", "items").replace(" X", ", " + ALLOCATION.format(size=50) + f""" SELECT task, label, item_id FROM (SELECT *, {PLACE.format(seed=3)} AS p FROM items) JOIN takes USING (task, label) WHERE p <= take"""))
def c7_stratified_subsample(spark, sf_dir):
    return C.stratified_subsample(items(spark, sf_dir), ["task"], "label", 50, 3).select("task", "label", "item_id")


@query(sql_with("X", "items").replace(" X", ", " + ALLOCATION.format(size=30) + f""",
  plan AS (SELECT task, CASE WHEN sum(n_class) <= 30 THEN 'all' WHEN min(n_class) < 2 OR 30 < count(*) OR sum(n_class) - 30 < count(*) THEN 'uniform' ELSE 'stratified' END AS strategy FROM counts GROUP BY task)
  SELECT task, strategy, count(*) AS n FROM (SELECT *, {PLACE.format(seed=3)} AS s, row_number() OVER (PARTITION BY task ORDER BY {U.format('3, item_id')}, item_id) AS u FROM items)
  JOIN plan USING (task) JOIN takes USING (task, label) WHERE CASE WHEN strategy = 'stratified' THEN s <= take ELSE u <= 30 END GROUP BY ALL"""))
def c2_stratified_cap(spark, sf_dir):
    return C.stratified_cap(items(spark, sf_dir), ["task"], "label", 30, 3).groupBy("task", "strategy").agg(F.count("*").alias("n"))


SPLIT = f"""split AS (SELECT task, label, item_id, CASE WHEN n > 1 AND p <= greatest(1, least(n - 1, round_even(n * 0.3::DOUBLE, 0))) THEN 'test' ELSE 'train' END AS part
  FROM (SELECT *, count(*) OVER (PARTITION BY task, label) AS n, {PLACE.format(seed=11)} AS p FROM items))"""


@query(sql_with("X", "items").replace(" X", f", {SPLIT} SELECT * FROM split"))
def c4_stratified_split(spark, sf_dir):
    return C.stratified_split(items(spark, sf_dir), ["task"], "label", 0.3, 11).select("task", "label", "item_id", "part")


@query(sql_with("X", "items").replace(" X", f""", {SPLIT} SELECT task, count(*) FILTER (part = 'train') AS n_train, count(*) FILTER (part = 'test') AS n_test, {r("avg(CASE WHEN part = 'test' THEN 1.0::DOUBLE ELSE 0.0 END) AS test_share")},
  count(DISTINCT label) AS n_classes, {HASH} AS split_hash FROM (SELECT *, md5(concat_ws(':', part, item_id)) AS h FROM split) GROUP BY task"""))
def c5_split_metadata(spark, sf_dir):
    return C.split_metadata(C.stratified_split(items(spark, sf_dir), ["task"], "label", 0.3, 11), ["task"], "label")


@query(sql_with(f"""SELECT task, role, view_id, item_id FROM (
    SELECT *, count(*) OVER (PARTITION BY task, role, view_id) AS n, row_number() OVER (PARTITION BY task, role, view_id ORDER BY {U.format('5, role, view_id, item_id')}, item_id) AS p
    FROM items, (SELECT unnest(['uncertainty', 'selection', 'evaluation']) AS role), (SELECT unnest([0, 1, 2]) AS view_id)) WHERE p <= least(n, greatest(10, round_even(n * 0.25::DOUBLE, 0)))""", "items"))
def c8_view_indices(spark, sf_dir):
    return C.view_indices(items(spark, sf_dir), ["task"], ["uncertainty", "selection", "evaluation"], 3, 0.25, 10, 5).select("task", "role", "view_id", "item_id")


BLANK = r"[ \t\n\x0B\f\r]"


@query(rf"""WITH w AS (SELECT doc_id, text, string_split_regex(regexp_replace(text, '^{BLANK}+|{BLANK}+$', '', 'g'), '{BLANK}+') AS w FROM documents),
  v AS (SELECT *, unnest([0, 1, 2]) AS view_id FROM w),
  k AS (SELECT doc_id, view_id, string_agg(word, ' ' ORDER BY i) AS t FROM (SELECT doc_id, view_id, unnest(w) AS word, unnest(range(len(w))) AS i FROM v WHERE view_id > 0 AND len(w) > 3)
    WHERE substr(md5(concat_ws('|', 9, doc_id, view_id, i // 4)), (i % 4 * 8 + 1)::INT, 8) > '1eb851ec' GROUP BY ALL)
  SELECT v.doc_id, v.view_id, md5(CASE WHEN v.view_id = 0 OR len(v.w) <= 3 THEN v.text ELSE coalesce(k.t, v.w[floor({U.format("9, v.doc_id, v.view_id, 'one'")} * len(v.w))::INT + 1]) END) AS view_md5 FROM v LEFT JOIN k ON k.doc_id = v.doc_id AND k.view_id = v.view_id""")
def c9_text_views(spark, sf_dir):
    return C.text_views(table(spark, sf_dir, "documents"), 3, 0.12, 9).select("doc_id", "view_id", F.md5("view_text").alias("view_md5"))


@query(f"""WITH t AS (SELECT doc_id, unnest(string_split(text, ' ')) AS w, unnest(range(len(string_split(text, ' ')))) AS pos FROM documents),
  v AS (SELECT doc_id, pos, CASE WHEN trim(w) <> '' THEN 1.0::DOUBLE ELSE 0.0 END AS mask, {U.format("'a', w")} AS x, length(w)::DOUBLE AS y FROM t)
  SELECT doc_id, {r("sum(x * mask) / greatest(sum(mask), 1e-6) AS mean_x", "sum(y * mask) / greatest(sum(mask), 1e-6) AS mean_y", "min_by(x, pos) AS cls_x", "coalesce(max_by(x, pos) FILTER (mask > 0), min_by(x, pos)) AS last_x")} FROM v GROUP BY doc_id""")
def c10_pool_tokens(spark, sf_dir):
    t = table(spark, sf_dir, "documents").select("doc_id", F.posexplode(F.split("text", " ")).alias("pos", "w"))
    t = t.select("doc_id", "pos", F.when(F.trim("w") != "", 1.0).otherwise(0.0).alias("mask"), F.array(S.uniform(F.lit("a"), F.col("w")), F.length("w").cast("double")).alias("vec"))
    p = C.pool_tokens(t, ["doc_id"])
    return p.select("doc_id", F.col("mean_vec")[0].alias("mean_x"), F.col("mean_vec")[1].alias("mean_y"), F.col("cls_vec")[0].alias("cls_x"), F.col("last_vec")[0].alias("last_x"))


# vectors

V = f"WITH {REPS_SQL}, long AS (SELECT model_alias, task, layer, item_id, unnest(vec)::DOUBLE AS x, unnest(range(len(vec))) AS d FROM reps)"


@query(f"""{V} SELECT model_alias, layer, item_id, {r("sum(z) AS z_sum", "sum(z * z) AS z_square", digits=6)} FROM (
  SELECT model_alias, layer, item_id, (x - avg(x) OVER w) / (stddev_samp(x) OVER w + 1e-6) AS z FROM long WINDOW w AS (PARTITION BY model_alias, layer, d)) GROUP BY ALL""", digits=6)
def d2_standardize(spark, sf_dir):
    z = D.standardize(reps(spark, sf_dir))
    total = lambda f: F.aggregate(F.transform("vec", f), F.lit(0.0), lambda a, b: a + b)
    return z.select("model_alias", "layer", "item_id", total(lambda x: x).alias("z_sum"), total(lambda x: x * x).alias("z_square"))


@query(f"""{V} SELECT model_alias, layer, item_id, {r("sum(x) / (sqrt(sum(x * x)) + 1e-12) AS sum_unit")} FROM long GROUP BY ALL""")
def d3_normalize_rows(spark, sf_dir):
    u = D.normalize_rows(reps(spark, sf_dir))
    return u.select("model_alias", "layer", "item_id", F.aggregate("vec", F.lit(0.0), lambda a, b: a + b).alias("sum_unit"))


PAIRS_SQL = "SELECT a.vec_id, a.embedding AS vec_a, b.embedding AS vec_b, a.label = b.label AS target, -abs(a.label - b.label) AS gold FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 WHERE a.vec_id % 2 = 0"
COSINES = f"pairs AS (SELECT vec_id, target, gold, list_cosine_similarity(list_transform(vec_a, lambda x: x::DOUBLE), list_transform(vec_b, lambda x: x::DOUBLE)) AS cosine FROM ({PAIRS_SQL}))"


def pairs(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    a = e.where("vec_id % 2 = 0").select("vec_id", F.col("embedding").alias("vec_a"), F.col("label").alias("la"))
    b = e.select((F.col("vec_id") - 1).alias("vec_id"), F.col("embedding").alias("vec_b"), F.col("label").alias("lb"))
    return D.cosine_pairs(a.join(b, "vec_id")).select("vec_id", "cosine", (F.col("la") == F.col("lb")).alias("target"), (-F.abs(F.col("la") - F.col("lb"))).alias("gold"), F.lit(1).alias("g"))


@query(f"WITH {COSINES} SELECT vec_id, {r('cosine')} FROM pairs")
def d4_cosine_pairs(spark, sf_dir):
    return pairs(spark, sf_dir).select("vec_id", "cosine")


DIST = f"""WITH {REPS_SQL}, d2 AS (SELECT a.model_alias, a.layer, a.item_id AS i, b.item_id AS j, list_sum(list_transform(list_zip(a.vec, b.vec), lambda p: (p[1]::DOUBLE - p[2]::DOUBLE) ** 2)) AS d2
  FROM reps a JOIN reps b ON a.model_alias = b.model_alias AND a.layer = b.layer AND a.item_id < b.item_id),
  tau AS (SELECT model_alias, layer, 0.5 * quantile_disc(d2, 0.5) AS tau2 FROM d2 WHERE d2 > 0 GROUP BY ALL)"""
BOTH = "both_ways AS (SELECT model_alias, layer, i, j, d2 FROM d2 UNION ALL SELECT model_alias, layer, j, i, d2 FROM d2)"
NEAR = "near AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY model_alias, layer, i ORDER BY d2, j) AS place FROM both_ways) WHERE place <= {})"
#: Neighbours of an item in the sparse graph.
NEIGHBOURS = 10


@query(f"{DIST} SELECT model_alias, layer, {r('tau2', digits=6)} FROM tau", digits=6)
def d5_bandwidth(spark, sf_dir):
    return N.bandwidth(N.item_blocks(reps(spark, sf_dir))).drop("task")


@query(f"""{DIST}, {BOTH} SELECT model_alias, layer, i AS item_id, {r('sum(exp(-d2 / (2 * tau2 + 1e-12))) AS degree', digits=6)} FROM both_ways JOIN tau USING (model_alias, layer) GROUP BY ALL""", digits=6)
def d6_affinity_degrees(spark, sf_dir):
    blocks = N.item_blocks(reps(spark, sf_dir))
    return N.degrees(blocks, N.bandwidth(blocks)).drop("task")


@query(f"""{DIST}, {BOTH}, {NEAR.format(NEIGHBOURS)} SELECT model_alias, layer, least(i, j) AS item_id, greatest(i, j) AS other, {r('sum(exp(-d2 / (2 * tau2 + 1e-12)) / 2) AS weight', digits=7)} FROM near JOIN tau USING (model_alias, layer) GROUP BY ALL""", digits=7)
def d7_knn_graph(spark, sf_dir):
    blocks = N.item_blocks(reps(spark, sf_dir))
    return N.knn_graph(N.nearest(blocks, NEIGHBOURS), N.bandwidth(blocks)).drop("task")


@query(f"""WITH {REPS_SQL}, n AS (SELECT model_alias, layer, item_id, list_transform(vec, lambda x: x::DOUBLE) AS v FROM reps)
  SELECT a.model_alias, a.layer, {r('avg(abs(list_cosine_similarity(a.v, b.v))) AS mean_abs_cosine', digits=7)} FROM n a JOIN n b ON a.model_alias = b.model_alias AND a.layer = b.layer AND a.item_id <> b.item_id GROUP BY ALL""", digits=7)
def d16_mean_abs_cosine(spark, sf_dir):
    return N.mean_abs_cosine(N.item_blocks(reps(spark, sf_dir))).drop("task")


@query(digits=6)
def d9_harmonic_score(spark, sf_dir):
    return D.score_candidates(cohort(spark, sf_dir), ["harmonic", "spectral_gap", "matrix_entropy", "abs_cosine"]).drop("error")


@query(digits=6)
def d13_matrix_entropy(spark, sf_dir):
    return D.entropy_metrics(reps(spark, sf_dir)).drop("error")


@query(digits=6)
def d10_harmonic_curves(spark, sf_dir):
    return D.harmonic_curves(cohort(spark, sf_dir), 40)


# With all modes the score needs no spectrum: energies sum to what the constant mode (the roots of the degrees)
# leaves of the centred items, and eigenvalues times energies to the trace of Z'LZ.
FULL = f"""WITH {COHORT_SQL}, long AS (SELECT model_alias, layer, item_id, unnest(vec)::DOUBLE AS x, unnest(range(len(vec))) AS d FROM reps),
  centred AS (SELECT model_alias, layer, item_id, d, x - avg(x) OVER (PARTITION BY model_alias, layer, d) AS z FROM long),
  zs AS (SELECT model_alias, layer, item_id, list(z ORDER BY d) AS z, sum(z * z) AS zz, count(*) AS dims FROM centred GROUP BY ALL),
  pairs AS (SELECT a.model_alias, a.layer, a.item_id AS i, b.item_id AS j, a.zz + b.zz - 2 * list_inner_product(a.z, b.z) AS d2, list_inner_product(a.z, b.z) AS dot
    FROM zs a JOIN zs b ON a.model_alias = b.model_alias AND a.layer = b.layer AND a.item_id <> b.item_id),
  tau AS (SELECT model_alias, layer, 0.5 * quantile_disc(d2, 0.5) AS tau2 FROM pairs WHERE i < j AND d2 > 0 GROUP BY ALL),
  w AS (SELECT model_alias, layer, i, j, dot, exp(-d2 / (2 * tau2 + 1e-12)) AS w FROM pairs JOIN tau USING (model_alias, layer)),
  deg AS (SELECT model_alias, layer, i AS item_id, sum(w) AS g FROM w GROUP BY ALL),
  first AS (SELECT model_alias, layer, sum(s * s) AS lost FROM (SELECT model_alias, layer, d, sum(z * sqrt(g)) / sqrt(sum(g)) AS s FROM centred JOIN deg USING (model_alias, layer, item_id) GROUP BY ALL) GROUP BY ALL),
  total AS (SELECT model_alias, layer, sum(zz) AS zz, max(dims) AS dims FROM zs GROUP BY ALL),
  cross_terms AS (SELECT w.model_alias, w.layer, sum(w * dot / sqrt(a.g * b.g)) AS c FROM w JOIN deg a ON a.model_alias = w.model_alias AND a.layer = w.layer AND a.item_id = w.i
    JOIN deg b ON b.model_alias = w.model_alias AND b.layer = w.layer AND b.item_id = w.j GROUP BY ALL)
  SELECT model_alias, layer, true AS consistent, {r('ln(1 + (zz - lost) / dims + (zz - c) / dims) AS full_score', digits=5)} FROM total JOIN first USING (model_alias, layer) JOIN cross_terms USING (model_alias, layer)"""


@query(FULL, digits=5)
def d11_curve_consistency(spark, sf_dir):
    own = D.score_candidates(cohort(spark, sf_dir), ["harmonic"]).where("field = 'score'").select("model_alias", "layer", "value")
    at = D.harmonic_curves(cohort(spark, sf_dir), COHORT).groupBy("model_alias", "layer").agg(F.max(F.when(F.col("k") == 10, F.col("h_k"))).alias("h"), F.max_by("h_k", "k").alias("full_score"))
    return own.join(at, ["model_alias", "layer"]).select("model_alias", "layer", (F.abs(F.col("value") - F.col("h")) < 1e-8).alias("consistent"), "full_score")


GRAM = f"""{V}, c AS (SELECT *, x - avg(x) OVER (PARTITION BY model_alias, layer, d) AS z FROM long),
  cov AS (SELECT a.model_alias, a.layer, a.d AS i, b.d AS j, sum(a.z * b.z) / (count(*) - 1) AS c, count(*) AS n FROM c a JOIN c b USING (model_alias, layer, item_id) GROUP BY ALL),
  pr AS (SELECT model_alias, layer, sum(c) FILTER (i = j) ** 2 / sum(c * c) AS pr, max(n) AS n, max(i) + 1 AS d FROM cov GROUP BY ALL),
  u AS (SELECT model_alias, layer, item_id, d, x / (sqrt(sum(x * x) OVER (PARTITION BY model_alias, layer, item_id)) + 1e-12) AS u FROM long),
  un AS (SELECT model_alias, layer, sum(s * s) AS ss, sum(q) AS q FROM (SELECT model_alias, layer, d, sum(u) AS s, sum(u * u) AS q FROM u GROUP BY ALL) GROUP BY ALL)"""


@query(f"""{GRAM} SELECT model_alias, layer, {r("pr AS participation_ratio", "pr / greatest(1, least(n - 1, d)) AS participation_norm", "1 / pr AS participation_inverse", "(ss - q) / (n * (n - 1)) AS anisotropy", digits=7)} FROM pr JOIN un USING (model_alias, layer)""", digits=7)
def d15_gram_metrics(spark, sf_dir):
    return D.gram_metrics(reps(spark, sf_dir)).drop("task", "concentration")


@query(digits=7)
def d17_concentration(spark, sf_dir):
    return D.gram_metrics(reps(spark, sf_dir)).select("model_alias", "layer", "concentration", (1 - F.col("concentration")).alias("isotropy"))


@query(digits=5)
def d25_partial_validation(spark, sf_dir):
    return D.partial_validation(cohort(spark, sf_dir)).drop("task")


@query(f"""WITH {REPS_SQL}, s AS (SELECT model_alias, layer, len(vec) AS d, list_transform(list_zip(vec, lag(vec) OVER w), lambda p: p[1]::DOUBLE - p[2]::DOUBLE) AS a, list_transform(list_zip(lead(vec) OVER w, vec), lambda p: p[1]::DOUBLE - p[2]::DOUBLE) AS b,
    lag(vec) OVER w IS NOT NULL AND lead(vec) OVER w IS NOT NULL AS ok FROM reps WINDOW w AS (PARTITION BY model_alias, layer ORDER BY item_id)),
  a AS (SELECT model_alias, layer, max(d) AS d, avg(acos(greatest(-1, least(1, list_cosine_similarity(a, b))))) AS c FROM s WHERE ok GROUP BY ALL) SELECT model_alias, layer, {r('c AS curvature', 'c / ln(greatest(d, 2)) AS curvature_norm', digits=7)} FROM a""", digits=7)
def d19_curvature(spark, sf_dir):
    return D.curvature(reps(spark, sf_dir)).drop("task")


@query(f"""{DIST}, {BOTH}, {NEAR.format(2)}, two AS (SELECT model_alias, layer, i, sqrt(min(d2)) AS r1, sqrt(max(d2)) AS r2 FROM near GROUP BY ALL)
  SELECT model_alias, layer, {r("1 / (avg(ln(r2 / r1 + 1e-12)) + 1e-12) AS dimension", digits=4)} FROM two WHERE r1 > 1e-12 GROUP BY ALL""", digits=4)
def d18_two_nn(spark, sf_dir):
    return N.two_nn(N.nearest(N.item_blocks(reps(spark, sf_dir)), 2)).drop("task")


def two_views(spark, sf_dir, of=None):
    r0 = of or cohort(spark, sf_dir)
    thin = F.transform("vec", lambda x, i: F.when(S.uniform(F.lit(4), F.col("item_id"), i) > 0.12, x.cast("double")).otherwise(0.0))
    return r0.withColumn("vec", F.col("vec").cast("array<double>")).withColumn("view_id", F.lit(0)).unionByName(r0.withColumn("vec", thin).withColumn("view_id", F.lit(1)))


@query(f"""WITH {COHORT_SQL}, u AS (SELECT model_alias, layer, item_id, list_transform(vec, lambda x: x::DOUBLE) AS a, list_transform(list_zip(vec, range(len(vec))), lambda p: CASE WHEN {U.format('4, item_id, p[2]')} > 0.12 THEN p[1]::DOUBLE ELSE 0.0 END) AS b FROM reps),
  n AS (SELECT model_alias, layer, item_id, list_transform(a, lambda x: x / (sqrt(list_sum(list_transform(a, lambda y: y * y))) + 1e-12)) AS a, list_transform(b, lambda x: x / (sqrt(list_sum(list_transform(b, lambda y: y * y))) + 1e-12)) AS b FROM u),
  l AS (SELECT x.model_alias, x.layer, x.item_id AS i, y.item_id AS j, list_inner_product(x.a, y.b) / 0.1 AS l FROM n x JOIN n y ON x.model_alias = y.model_alias AND x.layer = y.layer),
  e AS (SELECT model_alias, layer, i, ln(sum(exp(l))) - sum(l) FILTER (i = j) AS loss, count(*) AS n FROM l GROUP BY ALL)
  SELECT model_alias, layer, {r('avg(loss) AS loss', '1 - avg(loss) / ln(max(n)) AS bound', digits=6)} FROM e GROUP BY ALL""", digits=6)
def d20_infonce(spark, sf_dir):
    long = D.score_view_pairs(two_views(spark, sf_dir), ["infonce"])
    return long.groupBy("model_alias", "layer").pivot("field", ["loss", "bound"]).agg(F.first("value"))


@query(digits=6)
def d21_dime(spark, sf_dir):
    return D.dime_metrics(two_views(spark, sf_dir, reps(spark, sf_dir))).drop("error")


@query(digits=6)
def d22_lidar(spark, sf_dir):
    return D.lidar_metrics(two_views(spark, sf_dir, reps(spark, sf_dir))).drop("error")


@query(digits=6)
def d24_components(spark, sf_dir):
    return D.components(cohort(spark, sf_dir))


# evaluators


@query(digits=4)
def e1_classification(spark, sf_dir):
    drawn = cohort(spark, sf_dir, (1, 8))
    own = drawn.where("model_alias = 'm0' and layer = 1").select("task", "item_id", "label")  # the split is of the items evaluated
    split = C.stratified_split(own, ["task"], "label", 0.3, 11).withColumn("seed", F.lit(11))
    return E.classification_profile(drawn.drop("label"), split)


@query(digits=6)
def e2_clustering(spark, sf_dir):
    v = table(spark, sf_dir, "embeddings").where("embedding is not null").selectExpr("vec_id AS item_id", "label")
    return E.clustering_profile(cohort(spark, sf_dir, (1, 8)).drop("label"), v, [11, 22], n_init=2)


@query(f"""WITH t AS (SELECT lang AS label, source AS cluster, count(*)::DOUBLE AS c FROM documents GROUP BY ALL),
  w AS (SELECT *, sum(c) OVER () AS n, sum(c) OVER (PARTITION BY label) AS nl, sum(c) OVER (PARTITION BY cluster) AS nc FROM t),
  e AS (SELECT sum(-c / n * ln(nl / n)) AS hl, sum(-c / n * ln(nc / n)) AS hc, sum(-c / n * ln(c / nc)) AS hlc, sum(-c / n * ln(c / nl)) AS hcl FROM w),
  s AS (SELECT 1 - hlc / hl AS h, 1 - hcl / hc AS c FROM e) SELECT 1 AS g, {r('h AS homogeneity', 'c AS completeness', '2 * h * c / (h + c) AS v_measure')} FROM s""")
def e3_v_measure(spark, sf_dir):
    return E.v_measure(table(spark, sf_dir, "documents").select(F.lit(1).alias("g"), F.col("lang").alias("label"), F.col("source").alias("cluster")), ["g"])


@query("SELECT doc_id, toxic = 1 AS is_positive FROM labels")
def e4_positive_label(spark, sf_dir):
    return E.positive_label(table(spark, sf_dir, "labels").withColumn("g", F.lit(1)), ["g"], "toxic").select("doc_id", "is_positive")


@query(f"""WITH {COSINES}, s AS (SELECT cosine, sum(target::INT)::DOUBLE AS tp, count(*) AS c FROM pairs GROUP BY cosine),
  w AS (SELECT tp, sum(tp) OVER o AS ctp, sum(c) OVER o AS cn FROM s WINDOW o AS (ORDER BY cosine DESC ROWS UNBOUNDED PRECEDING)) SELECT 1 AS g, {r('sum(tp * ctp / cn) / sum(tp) AS average_precision')} FROM w""")
def e5_average_precision(spark, sf_dir):
    return E.average_precision(pairs(spark, sf_dir), ["g"], "cosine", "target")


def rank_sql(x: str, keys: str) -> str:
    by = f"PARTITION BY {keys}" if keys else ""
    return f"rank() OVER ({by} ORDER BY {x}) + (count(*) OVER (PARTITION BY {keys + ', ' if keys else ''}{x}) - 1) / 2.0"


@query(f"""WITH {COSINES}, k AS (SELECT ({rank_sql('gold', '')})::DOUBLE AS a, ({rank_sql('cosine', '')})::DOUBLE AS b FROM pairs) SELECT 1 AS g, {r('corr(a, b) AS spearman')}, count(*) AS n FROM k""")
def e6_sts(spark, sf_dir):
    return E.spearman_similarity(pairs(spark, sf_dir), ["g"], "gold", "cosine")


@query(sql_with("SELECT task, task_type, layer, model_alias, s.seed, " + r("v AS primary_score") + " FROM (SELECT task, task_type, layer, model_alias, avg(primary_score) AS v FROM scores_long WHERE task_type IN ('PairClassification', 'STS') GROUP BY ALL), (SELECT unnest([11, 22, 33, 44]) AS seed) s", "scores_long"))
def e7_seed_free(spark, sf_dir):
    free = scores(spark, sf_dir).where(F.col("task_type").isin(*E.SEED_FREE)).groupBy("task", "task_type", "layer", "model_alias").agg(F.avg("primary_score").alias("primary_score"))
    return E.for_all_seeds(free, SEEDS)
