"""Registered queries against their SQL, and kernels on small inputs."""

import math
import os

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from repselect import registry
from repselect.functions.scalars import t_975, t_quantile
from repselect.operators import evaluators, sampling, statistics, vectors
from repselect.sources import tables

DATA = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    own = duckdb.connect()
    for f in os.listdir(DATA):
        own.execute(f"CREATE VIEW {f.removesuffix('.parquet')} AS SELECT * FROM '{DATA}/{f}'")
    return own


def plain(rows):
    """Rows in the order of what is no double, then of doubles to four digits: their last digit hangs on the order of
    sums."""
    rows = [[None if v is None or v != v else v for v in r] for r in rows]
    exact = lambda r: (repr([v for v in r if not isinstance(v, float)]), repr([round(v, 4) + 0 for v in r if isinstance(v, float)]))
    return [v for r in sorted(rows, key=exact) for v in r]


@pytest.mark.parametrize("name", ["g1_summarize_profiles", "c7_stratified_subsample", "h1_best_layers_by_seed", "h25_support_audit", "i3_layerwise_correlations", "d15_gram_metrics", "e5_average_precision", "g20_validity", "i10_precision_tests", "i12_uncertainty_by_fraction", "i13_method_outcomes", "i15_negative_control", "i16_verdict", "h15_model_logratio", "j3_split_integrity", "j4_split_diversity", "j9_split_alignment"])
def test_query_matches_sql(spark, con, name):
    got = registry.QUERIES[name](spark, DATA)
    columns = sorted(got.columns)
    want = con.execute(f"SELECT {', '.join(columns)} FROM ({registry.ORACLE_SQL[name]})").fetchall()
    assert plain(map(tuple, got.select(columns).collect())) == pytest.approx(plain(want), abs=1e-7)


def test_kernels():
    rng = np.random.default_rng(7)
    x = rng.normal(size=(40, 9))
    found = vectors.harmonic_score(x, 5)
    lam, energy = vectors.harmonic_modes(x, 39)
    assert np.isclose(found["score"], np.log1p(((1 + lam[:5]) * energy[:5]).sum())) and np.isnan(vectors.harmonic_score(x[:2])["score"])
    # a label that is the sign of one coordinate can be learnt; a constant label is always right
    y = (x[:, 0] > 0).astype(int)
    far = x + 6 * np.eye(9)[0] * (2 * y - 1)[:, None]
    test = np.arange(40) % 3 == 1
    assert evaluators.accuracy(far, y, test) == 1 and evaluators.accuracy(x, np.zeros(40, int), test) == 1
    assert abs(t_quantile(0.975, 3) - 3.182446305) < 1e-6 and abs(t_quantile(0.975, 10) - 2.228138852) < 1e-6


def test_graph_on_a_square():
    """Four corners of a unit square: sides have squared length 1, diagonals 2; the lower median is 1."""
    x = np.array([[0.0, 0], [1, 0], [1, 1], [0, 1]])
    side, across = np.exp(-1.0), np.exp(-2.0)
    w = vectors.affinity(x)
    assert np.allclose(w, [[0, side, across, side], [side, 0, side, across], [across, side, 0, side], [side, across, side, 0]])
    # a circulant graph: eigenvalues of the Laplacian in closed form
    total = 2 * side + across
    assert np.allclose(np.linalg.eigvalsh(vectors.laplacian(w)), sorted([0, 1 - (2 * side * 0 - across) / total, 1 - (2 * side * 0 - across) / total, 1 - (across - 2 * side) / total]))
    # one neighbour each (the first of equals), then symmetrised
    near = vectors.affinity(x, 1)
    assert np.allclose(near, near.T) and np.allclose(near.sum(), 4 * side) and near[0, 2] == near[1, 3] == 0
    gap = vectors.spectral_gap(x)
    assert gap["n_components"] == 1 and np.isclose(gap["lambda2"], 1 + across / total)


def test_entropies_and_scatter():
    eye = np.eye(6)
    found = vectors.matrix_entropy(eye)
    assert np.isclose(found["raw"], np.log(6)) and np.isclose(found["max_entropy"], 1) and np.isclose(found["length"], np.log(6) / 6)
    assert np.isclose(vectors.renyi(np.diag([3.0, 1.0]), 2), -np.log((9 + 1) / 16))
    # equal Gram matrices of orthonormal items: the true pairing and any other give the same product, so no gain
    assert np.isclose(vectors.dime(eye, eye)["doe"], 0)
    # blocks of equal items: a wrong pairing breaks the blocks, and the entropy of the product rises
    blocks = np.repeat(np.eye(8)[:2], 4, axis=0)
    assert vectors.dime(blocks, blocks)["doe"] > 0.1
    # items on the axes without spread between views: all directions count alike but for the mean's
    views = np.repeat(np.eye(5)[:, None, :] * 3, 2, axis=1)
    assert np.isclose(vectors.lidar(views)["score"], 4)
    u = vectors.info_nce(eye, eye, 0.1)
    assert np.isclose(u["loss"], np.log(np.exp(10) + 5) - 10)
    assert np.isclose(vectors.abs_cosine(np.array([[1.0, 0], [-2, 0], [0, 1]]))["mean_abs_cosine"], 1 / 3)
    assert np.isnan(vectors.two_nn(np.eye(2))["dimension"])


def test_k_means_finds_far_groups():
    rng = np.random.default_rng(3)
    centres = np.array([[0.0, 0, 0], [50, 0, 0], [0, 50, 0], [0, 0, 50]])
    own = np.repeat(np.arange(4), (5, 9, 13, 3))
    for seed in (1, 2):
        assert len(set(zip(own, evaluators.k_means(centres[own] + rng.uniform(-1, 1, (30, 3)), 4, seed)))) == 4


def test_curves_and_concentration(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(25, 6)) * [5, 1, 1, 1, 1, 1]
    df = spark.createDataFrame([("m", "t", 1, k, row.tolist()) for k, row in enumerate(x)], "model_alias string, task string, layer int, item_id long, vec array<double>")
    lam, energy = vectors.harmonic_modes(x, 24)
    rows = sorted(vectors.harmonic_curves(df, 8).collect(), key=lambda r: r.k)
    part = np.cumsum((1 + lam[:8]) * energy[:8])
    assert [r.k for r in rows] == list(range(1, 9)) and np.allclose([r.h_k for r in rows], np.log1p(part)) and np.allclose([r.mass for r in rows], part / part[-1])
    got = vectors.gram_metrics(df).first()
    values = np.linalg.eigvalsh(np.cov(x.T))
    assert np.isclose(got.concentration, values[-1] / values.sum()) and np.isclose(got.participation_ratio, values.sum() ** 2 / (values ** 2).sum())
    told = vectors.partial_validation(df, 5).first()
    assert told.passed and max(told.score_error, told.eigenvalue_error, told.projector_error) < 1e-9
    bad = vectors.score_candidates(df, ["harmonic", "missing"]).where("error is not null").collect()
    assert [r.metric for r in bad] == ["missing"]
    with pytest.raises(Exception):
        vectors.score_candidates(df, ["missing"], strict=True).collect()


def test_paired_tests_and_bootstrap(spark):
    units = [(k, m, float(k) + (0.0 if m == "old" else (1.0 if k < 300 else -1.0 if k < 490 else 0.0))) for k in range(500) for m in ("old", "new")]
    df = spark.createDataFrame([("g", *u) for u in units], "g string, unit long, method string, value double")
    r = statistics.paired_tests(df, ["g"], "unit", "method", "old", "new", "value", draws=200).first()
    assert (r.wins, r.losses, r.ties, r.n_units) == (300, 190, 10, 500) and np.isclose(r.mean_advantage, 0.22)
    assert np.isclose(r.p_sign, min(1, 2 * sum(math.comb(490, k) for k in range(191)) / 2 ** 490), rtol=1e-9)
    small = spark.createDataFrame([(w, n - w) for n in (0, 1, 5, 60) for w in range(n + 1)], "w long, l long")
    for x in small.select("w", "l", statistics.sign_test(F.col("w"), F.col("l")).alias("p")).collect():
        n = x.w + x.l
        assert x.p is None if n == 0 else np.isclose(x.p, min(1, 2 * sum(math.comb(n, k) for k in range(min(x.w, x.l) + 1)) / 2 ** n))
    with pytest.raises(Exception, match="too many values"):
        statistics.sign_flip(df, ["g"], "value", draws=None).collect()
    few = spark.createDataFrame([("a", 2.0), ("b", 1.0), ("b", 3.0), ("b", 5.0), ("b", None)], "g string, v double")
    got = {x.g: x for x in statistics.bootstrap_mean(few, ["g"], "v", 2000).collect()}
    assert (got["a"].ci_low, got["a"].mean, got["a"].ci_high, got["a"].n) == (2, 2, 2, 1)
    assert got["b"].mean == 3 and got["b"].n == 3 and got["b"].ci_low in (1, 5 / 3) and got["b"].ci_high in (5, 13 / 3)
    again = {x.g: x for x in statistics.bootstrap_mean(few, ["g"], "v", 2000).collect()}
    assert got == again
    t = spark.createDataFrame([(n,) for n in (1, 2, 4, 121, 122, 1000)], "n long").select("n", t_975(F.col("n")).alias("t")).collect()
    assert [None if x.t is None else round(x.t, 6) for x in t] == [None if n == 1 else round(t_quantile(0.975, n - 1), 6) for n in (1, 2, 4, 121, 122, 1000)]


def test_cache_and_sorted_tables(spark, tmp_path):
    rows = [("m", "t", layer, side, k, [float(k), 0.5 * layer]) for layer in (1, 2) for side in "ab" for k in range(6)]
    reps = spark.createDataFrame(rows, "model_alias string, task string, layer int, side string, item_id long, vec array<double>")
    path = str(tmp_path / "cache")
    tables.write_cache(reps, path, "pooling=mean")
    back = tables.read_cache(spark, path, "pooling=mean", spark.read.parquet(f"{path}/meta"))
    assert sorted(map(repr, back.select(reps.columns).collect())) == sorted(map(repr, reps.collect()))
    meta = tables.cache_meta(reps, "pooling=mean").first()
    assert meta.num_layers == 2 and meta.n_items == 12
    assert tables.cache_meta(reps.repartition(5), "pooling=mean").first() == meta
    with pytest.raises(ValueError, match="settings"):
        tables.read_cache(spark, path, "pooling=cls")
    other = tables.cache_meta(reps.where("item_id > 0"), "pooling=mean")
    assert other.first().sample_hash != meta.sample_hash
    with pytest.raises(ValueError, match="samples"):
        tables.read_cache(spark, path, "pooling=mean", other)
    for kind in ("parquet", "csv"):
        long = reps.select("model_alias", "task", "side", "item_id", "layer").repartition(7)
        tables.write_long(long, f"{path}-{kind}", ["layer", "side", "item_id"], kind)
        schema = "model_alias string, task string, side string, item_id long, layer int"
        read = tables.read_long(spark, f"{path}-{kind}", schema, kind, ("layer",))
        assert sorted(map(tuple, read.collect())) == sorted(map(tuple, long.collect()))
        files = [[(r.layer, r.side, r.item_id) for r in spark.read.schema(schema).options(header=True).format(kind).load(str(f)).collect()] for f in sorted((tmp_path / f"cache-{kind}").glob("part-*"))]
        assert [r for f in files for r in f] == sorted((r.layer, r.side, r.item_id) for r in long.collect())


def test_text_views(spark):
    docs = spark.createDataFrame([(1, "  a \t b\nc "), (2, " ".join(f"w{k}" for k in range(400))), (3, "p q r s"), (4, ""), (5, None)], "doc_id long, text string")
    got = {(r.doc_id, r.view_id): r.view_text for r in sampling.text_views(docs, 4, 0.12, 9).collect()}
    assert len(got) == 20 and got[1, 2] == "  a \t b\nc " and got[5, 1] is None and got[4, 3] == ""
    kept = [len(got[2, v].split()) / 400 for v in (1, 2, 3)]
    assert got[2, 0].split() != got[2, 1].split() and all(0.8 < k < 0.95 for k in kept) and len({got[2, v] for v in (1, 2, 3)}) == 3
    lost = {r.view_text for r in sampling.text_views(docs.where("doc_id = 3"), 40, 1.0 - 1e-9, 9).where("view_id > 0").collect()}
    assert lost == {"p", "q", "r", "s"}
