"""The registered queries of this subpackage and their SQL."""

from __future__ import annotations

from public_tokenizers import path as tokenizer_path
from pyspark.sql import DataFrame, SparkSession, functions as F

from repselect.llm import align, bpe, cluster, embedding_dedup, langid, licenses, mixing, pack, quality, secrets, sharding, simhash, warc
from repselect.session import table

TOKENIZER = "byte_bpe_50k.json"
PIECES = "piece_bpe_32k.model"
LOWER_WORDS = "word_bpe_49k.json"


def op1_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")


def op2_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.digests(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER))


def op3_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.quality_report(table(spark, sf_dir, "documents"))


def op4_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.scan_licenses(table(spark, sf_dir, "documents"))


def op5_secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scan_secrets(table(spark, sf_dir, "documents"))


def op6_embedding_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_dedup.near_duplicates(table(spark, sf_dir, "embeddings"))


def op7_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharding.assign_shards(table(spark, sf_dir, "documents"))


def op8_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    rates = mixing.mixing_rates(docs, table(spark, sf_dir, "labels"))
    whole = mixing.copies(F.col("rate"), F.col("doc_id"))
    return rates.select("doc_id", "source", "tokens", "domain", F.round("rate", 6).alias("rate"), whole.alias("copies"), F.round("wanted", 3).alias("wanted"), F.round("reached", 3).alias("reached"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    model = langid.train(docs.where(~langid.held_out()))
    found = langid.identify(docs.select("doc_id", "text"), model)
    return found.select("doc_id", langid.held_out().alias("held_out"), "lang_pred", "score")


def op10_warc_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc.audit_drill(table(spark, sf_dir, "pages"))


def op11_centroid_clustering(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster.report(table(spark, sf_dir, "embeddings"))


def op12_tokenizer_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align.linked_counts(table(spark, sf_dir, "documents"), tokenizer_path(TOKENIZER), tokenizer_path(PIECES))


def op13_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack.pieces(pack.pack(table(spark, sf_dir, "documents"), tokenizer_path(LOWER_WORDS)))


QUERIES = {f.__name__: f for f in (
    op1_simhash_near_dedup, op2_bpe, op3_quality_rules, op4_license_scans, op5_secret_scans, op6_embedding_near_dedup, op7_sharding, op8_mixing,
    op9_language_id, op10_warc_fixity, op11_centroid_clustering, op12_tokenizer_alignment, op13_packing)}

WORDS = r"[^\x20\x09-\x0D]+"
LONG = " UNION ALL\n  ".join(
    f"SELECT r, lang, source, '{m}' AS m, {m} AS x FROM shares WHERE NOT base_failed" + (f" AND {m} >= {quality.LEAST}" if m in quality.RARE else "") for m in quality.MEASURES)

OP3_SQL = rf"""
WITH docs AS (
  SELECT row_number() OVER () AS r, doc_id, lang, source, coalesce(text, '') AS t,
         regexp_extract_all(coalesce(text, ''), '{WORDS}') AS w
  FROM documents),
windows AS (
  SELECT r, p, w[p] || ' ' || w[p + 1] || ' ' || w[p + 2] AS g
  FROM (SELECT r, w, unnest(range(1, len(w) - 1)) AS p FROM docs WHERE len(w) >= 3)),
twice AS (SELECT r, p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, g) AS n FROM windows) WHERE n > 1),
covered AS (SELECT r, count(DISTINCT q) AS n FROM (SELECT r, unnest([p, p + 1, p + 2]) AS q FROM twice) GROUP BY r),
split_lines AS (
  SELECT r, count(*) AS n, count(DISTINCT line) AS d
  FROM (SELECT r, unnest(string_split(t, chr(10))) AS line FROM docs) WHERE regexp_matches(line, '{WORDS}') GROUP BY r),
base AS (
  SELECT r, doc_id, lang, source, len(w)::BIGINT AS n_words, length(regexp_replace(t, '[\x20\x09-\x0D]', '', 'g')) AS word_chars,
         length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) AS n_symbols,
         length(t) - length(regexp_replace(t, '[A-Z]', '', 'g')) AS capitals_n,
         length(t) - length(regexp_replace(t, '[!?]', '', 'g')) AS marks_n,
         coalesce(l.n, 0) AS n_lines, coalesce(l.n - l.d, 0) AS n_dup_lines, coalesce(c.n, 0) AS n_repeat_words
  FROM docs LEFT JOIN split_lines l USING (r) LEFT JOIN covered c USING (r)),
shares AS (
  SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed,
         CASE WHEN word_chars > 0 THEN n_symbols::DOUBLE / word_chars ELSE 0 END AS symbols,
         CASE WHEN word_chars > 0 THEN capitals_n::DOUBLE / word_chars ELSE 0 END AS capitals,
         CASE WHEN n_lines > 0 THEN n_dup_lines::DOUBLE / n_lines ELSE 0 END AS dup_lines,
         CASE WHEN n_words > 0 THEN n_repeat_words::DOUBLE / n_words ELSE 0 END AS repeats,
         CASE WHEN n_words > 0 THEN word_chars::DOUBLE / n_words ELSE 0 END AS word_length,
         CASE WHEN word_chars > 0 THEN marks_n::DOUBLE / word_chars ELSE 0 END AS marks
  FROM base),
long AS (
  {LONG}),
bucketed AS (
  SELECT *, CASE WHEN x < {quality.LEAST} THEN 0 ELSE floor(ln(x / {quality.LEAST}) / ln({quality.GROWTH}::DOUBLE)) + 1 END AS b FROM long),
levels AS (
  SELECT 1 AS level, lang, source, m, b FROM bucketed UNION ALL
  SELECT 2, lang, NULL, m, b FROM bucketed UNION ALL
  SELECT 3, NULL, NULL, m, b FROM bucketed),
cumulated AS (
  SELECT *, count(*) OVER (PARTITION BY level, lang, source, m ORDER BY b) AS upto, count(*) OVER (PARTITION BY level, lang, source, m) AS texts FROM levels),
cuts AS (
  SELECT level, lang, source, m, texts, min(CASE WHEN upto >= ceil(texts * 0.5::DOUBLE) THEN b END) AS mid, min(CASE WHEN upto >= ceil(texts * 0.75::DOUBLE) THEN b END) AS high
  FROM cumulated GROUP BY ALL),
valued AS (
  SELECT *, CASE WHEN mid = 0 THEN 0 ELSE {quality.LEAST} * pow({quality.GROWTH}::DOUBLE, mid - 0.5) END AS vm,
         CASE WHEN high = 0 THEN 0 ELSE {quality.LEAST} * pow({quality.GROWTH}::DOUBLE, high - 0.5) END AS vh FROM cuts),
fences AS (SELECT level, lang, source, m, texts, vh + {quality.REACH}::DOUBLE * greatest(vh - vm, vm * {quality.GROWTH - 1}::DOUBLE, {quality.LEAST}) AS fence FROM valued),
beyond AS (
  SELECT DISTINCT x.r FROM long x
  JOIN fences a ON a.level = 1 AND a.m = x.m AND a.lang IS NOT DISTINCT FROM x.lang AND a.source IS NOT DISTINCT FROM x.source
  JOIN fences b ON b.level = 2 AND b.m = x.m AND b.lang IS NOT DISTINCT FROM x.lang
  JOIN fences c ON c.level = 3 AND c.m = x.m
  WHERE x.x > (a.texts * a.fence + {quality.PRIOR} * ((b.texts * b.fence + {quality.PRIOR} * c.fence) / (b.texts + {quality.PRIOR}))) / (a.texts + {quality.PRIOR}))
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, NOT base_failed AND b.r IS NULL AS kept
FROM shares LEFT JOIN beyond b ON b.r = shares.r
"""

OP6_SQL = """
WITH RECURSIVE v AS (
  SELECT vec_id, list_transform(embedding, lambda x: x::DOUBLE) AS e FROM embeddings
  WHERE embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) AND list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS a, vec_id AS b FROM embeddings UNION SELECT reach.a, l.b FROM reach JOIN l ON l.a = reach.b),
c AS (SELECT a AS vec_id, min(b) AS component_id FROM reach GROUP BY a),
n AS (SELECT a AS vec_id, count(*) AS n FROM l GROUP BY a)
SELECT e.vec_id, coalesce(n.n, 0)::BIGINT AS n_links, c.component_id, e.vec_id = c.component_id AS kept
FROM embeddings e JOIN c USING (vec_id) LEFT JOIN n USING (vec_id)
"""

_HEAD = """'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:page:' || k || '>' || chr(13) || chr(10)
    || 'WARC-Date: {date}' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
    || 'Content-Length: ' || strlen({body}) || chr(13) || chr(10) || chr(13) || chr(10) || {body}"""

OP10_SQL = f"""
WITH p AS (
  SELECT page_id, url, coalesce(html, '') AS h, coalesce(page_id::VARCHAR, 'none') AS k,
    CASE WHEN page_id % 97 = 0 AND strlen(right(html, 1)) = 1 THEN left(html, length(html) - 1) || '~' ELSE coalesce(html, '') END AS g FROM pages),
r AS (SELECT page_id, url, {_HEAD.format(date=warc.DATE, body='h')} AS one, {_HEAD.format(date=warc.DATE, body='g')} AS other, {_HEAD.format(date=warc.DATE, body="''")} AS extra FROM p),
o AS (SELECT *, row_number() OVER (ORDER BY page_id NULLS FIRST, url NULLS FIRST, sha256(one)) - 1 AS rank FROM r),
lost AS (SELECT *, coalesce(((page_id % 389) + 389) % 389 = 5, false) AS gone, coalesce(((page_id % 401) + 401) % 401 = 7, false) AS more, rank // {warc.PER_FILE} AS warc_file FROM o),
replica AS (
  SELECT page_id, warc_file, rank, 0 AS behind, other AS rec FROM lost WHERE NOT gone UNION ALL
  SELECT page_id, warc_file, rank, 1, extra FROM lost WHERE more),
placed AS (SELECT *, coalesce(sum(strlen(rec) + 4) OVER (PARTITION BY warc_file ORDER BY rank, behind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS record_offset FROM replica)
SELECT page_id, warc_file,
  coalesce(sum(strlen(one) + 4) OVER (PARTITION BY warc_file ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS record_offset,
  strlen(one) + 4 AS record_length, sha256(one) AS record_sha256, CASE WHEN gone AND NOT more THEN 'missing' WHEN gone OR one <> other THEN 'corrupt' ELSE 'ok' END AS status
FROM lost UNION ALL
SELECT page_id, warc_file, record_offset, strlen(rec) + 4, sha256(rec), 'added' FROM placed WHERE behind = 1 AND NOT (((page_id % 389) + 389) % 389 = 5)
"""

OP11_ROUND = """
a{r} AS MATERIALIZED (
  SELECT v.vec_id, v.e, x.best[2] AS c, x.best[1] AS d
  FROM (SELECT v.r, min([list_sum(list_transform(range(1, 65), lambda i: (v.e[i] - c.e[i]) * (v.e[i] - c.e[i])))::BIGINT, c.c]) AS best FROM v, c{r} c GROUP BY v.r) x JOIN v USING (r))"""
OP11_MOVE = """
s{r} AS (SELECT c, i, sum(x) AS s, count(*) AS n FROM (SELECT c, unnest(e) AS x, generate_subscripts(e, 1) AS i FROM a{r}) GROUP BY c, i),
m{r} AS (SELECT c, list((s - ((s % n) + n) % n) // n ORDER BY i) AS e FROM s{r} GROUP BY c),
c{next} AS MATERIALIZED (SELECT c.c, CASE WHEN m.e IS NULL THEN c.e ELSE m.e END AS e FROM c{r} c LEFT JOIN m{r} m USING (c))"""


def _op11_sql(k: int = 40, rounds: int = 5) -> str:
    """k-means written out round by round; every distance is measured."""
    steps = []
    for r in range(rounds + 1):
        steps.append(OP11_ROUND.format(r=r))
        if r < rounds:
            steps.append(OP11_MOVE.format(r=r, next=r + 1))
    return f"""
WITH v AS MATERIALIZED (
  SELECT row_number() OVER () AS r, vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)::BIGINT) AS e FROM embeddings
  WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
c0 AS MATERIALIZED (
  SELECT row_number() OVER (ORDER BY h, e) - 1 AS c, e FROM (SELECT sha256('2:' || vec_id) AS h, e FROM v WHERE vec_id IS NOT NULL ORDER BY h, e LIMIT {k})),
{",".join(steps)}
SELECT vec_id, a.c::INTEGER AS cluster, d::BIGINT AS distance, (sum(d) OVER (PARTITION BY a.c))::BIGINT AS cluster_inertia, (sum(d) OVER ())::BIGINT AS inertia,
  sha256(array_to_string(c{rounds}.e, ',')) AS centroid_sha256
FROM a{rounds} a JOIN c{rounds} ON c{rounds}.c = a.c
"""


ORACLE_SQL = {"op11_centroid_clustering": _op11_sql(), "op3_quality_rules": OP3_SQL, "op6_embedding_near_dedup": OP6_SQL, "op10_warc_fixity": OP10_SQL}
