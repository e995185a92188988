"""Pair metrics by tiles against whole matrices, and the partial solver against the full one."""

import numpy as np
import pytest

from repselect.operators import tiles, vectors

KEYS = ["model_alias", "task", "layer"]


def candidates(rng):
    near = rng.normal(size=(70, 5))
    near[40:52] = near[3]  # copies
    near[60] = near[5] + 1e-7
    return {"a": near, "b": rng.normal(size=(33, 3)) * [9, 1, 1], "flat": np.ones((6, 2)), "two": np.array([[0.0, 0], [3, 4]]), "one": np.array([[1.0, 2]])}


@pytest.fixture(params=[1024, 8])
def blocks(spark, monkeypatch, request):
    monkeypatch.setattr(tiles, "ROWS", request.param)
    found = candidates(np.random.default_rng(1))
    rows = [(m, "t", 1, 3 * k, v.tolist()) for m, x in found.items() for k, v in enumerate(x)]
    df = spark.createDataFrame(rows, "model_alias string, task string, layer int, item_id long, vec array<double>")
    return found, tiles.item_blocks(df)


def distances(x):
    return ((x[:, None] - x[None]) ** 2).sum(2)


def plain_tau(x):
    d = np.sort(distances(x)[np.triu_indices(len(x), 1)])
    d = d[d > 0]
    return max(0.5 * d[(len(d) - 1) // 2], 1e-12) if len(d) else 1.0


def test_bandwidth_degrees_and_cosines(blocks):
    found, made = blocks
    tau = tiles.bandwidth(made)
    got = {r.model_alias: r.tau2 for r in tau.collect()}
    assert got.keys() == found.keys() and all(np.isclose(got[m], plain_tau(x), rtol=1e-12) for m, x in found.items())
    own = {(r.model_alias, r.item_id): r.degree for r in tiles.degrees(made, tau).collect()}
    assert len(own) == sum(map(len, found.values()))
    for m, x in found.items():
        w = np.exp(-distances(x) / (2 * plain_tau(x) + 1e-12))
        np.fill_diagonal(w, 0)
        assert np.allclose([own[m, 3 * k] for k in range(len(x))], w.sum(1), rtol=1e-9)
    cosines = {r.model_alias: r.mean_abs_cosine for r in tiles.mean_abs_cosine(made).collect()}
    for m, x in found.items():
        want = vectors.abs_cosine(x)["mean_abs_cosine"]
        assert cosines[m] is None if np.isnan(want) else np.isclose(cosines[m], want)


@pytest.mark.parametrize("k", [2, 10])
def test_nearest_and_their_graph(blocks, k):
    found, made = blocks
    near, tau = tiles.nearest(made, k), tiles.bandwidth(made)
    got = {}
    for r in near.collect():
        got.setdefault((r.model_alias, r.item_id), []).append((r.place, r.d2, r.other))
    edges = {(r.model_alias, r.item_id, r.other): r.weight for r in tiles.knn_graph(near, tau).collect()}
    dims = {r.model_alias: r.dimension for r in tiles.two_nn(near).collect()}
    for m, x in found.items():
        d = distances(x)
        np.fill_diagonal(d, np.inf)
        for i in range(len(x)):
            want = sorted((round(d[i, j], 13), 3 * j) for j in range(len(x)) if j != i)[:k]
            assert [(p, o) for p, _, o in sorted(got.get((m, 3 * i), []))] == [(n + 1, o) for n, (_, o) in enumerate(want)]
        if 0 < k < len(x) - 1:
            w = np.zeros_like(d)
            for i in range(len(x)):
                for _, j in sorted((round(d[i, j], 13), j) for j in range(len(x)) if j != i)[:k]:
                    w[i, j] = np.exp(-d[i, j] / (2 * plain_tau(x) + 1e-12))
            w = (w + w.T) / 2
            want = {(m, 3 * i, 3 * j): w[i, j] for i in range(len(x)) for j in range(i + 1, len(x)) if w[i, j] > 0}
            mine = {e: v for e, v in edges.items() if e[0] == m}
            assert mine.keys() == want.keys() and np.allclose([mine[e] for e in want], list(want.values()))
        want = vectors.two_nn(x)["dimension"]
        if m in dims:
            assert dims[m] is None if np.isnan(want) else np.isclose(dims[m], want)


@pytest.fixture
def moved(monkeypatch):
    """A function that gives the bytes written to shuffle files since it was last asked, by collect and checkpoint."""
    from pyspark.sql.classic.dataframe import DataFrame

    plans = []
    for name in ("collect", "checkpoint"):
        def noted(self, *args, f=getattr(DataFrame, name), **more):
            plans.append(self._jdf.queryExecution())
            return f(self, *args, **more)
        monkeypatch.setattr(DataFrame, name, noted)

    def written(plan):
        kind = plan.nodeName()
        if kind.startswith("AdaptiveSparkPlan"):
            return written(plan.executedPlan())
        if "QueryStage" in kind:
            return written(plan.plan())
        own = plan.metrics().apply("shuffleBytesWritten").value() if kind == "Exchange" else 0
        return own + sum(written(plan.children().apply(k)) for k in range(plan.children().size()))

    def since():
        total = sum(written(p.executedPlan()) for p in plans)
        plans.clear()
        return total
    return since


@pytest.fixture
def many(spark, monkeypatch):
    """40 blocks of one candidate and the bytes of its vectors."""
    monkeypatch.setattr(tiles, "ROWS", 8)
    x = np.random.default_rng(7).normal(size=(320, 64))
    df = spark.createDataFrame([("a", "t", 1, k, v.tolist()) for k, v in enumerate(x)], "model_alias string, task string, layer int, item_id long, vec array<double>")
    return x, tiles.item_blocks(df), x.nbytes


def test_bandwidth_moves_no_vectors(many, moved):
    x, blocks, size = many
    moved()
    (row,) = tiles.bandwidth(blocks).collect()
    assert np.isclose(row.tau2, plain_tau(x), rtol=1e-12)
    assert moved() < 2 * size  # counts by bucket; all vectors to all blocks are 40 times their size


def test_bandwidth_lists_or_counts_to_the_last_bit(many, monkeypatch):
    x, blocks, _ = many
    for few in (1, 100, 1 << 18):
        monkeypatch.setattr(tiles, "FEW", few)
        assert np.isclose(tiles.bandwidth(blocks).collect()[0].tau2, plain_tau(x), rtol=1e-12)


def test_bandwidth_of_floats_and_odd_numbers(spark, monkeypatch):
    monkeypatch.setattr(tiles, "ROWS", 4)
    x = np.random.default_rng(8).normal(size=(30, 3)).astype(np.float32)
    rows = [(m, "t", 1, k, v.tolist()) for m in "ab" for k, v in enumerate(x)] + [("b", "t", 1, 30, [float("nan")] * 3), ("c", "t", 1, 0, [float("inf"), 0.0, 0.0]), ("c", "t", 1, 1, [0.0, 0.0, 0.0])]
    blocks = tiles.item_blocks(spark.createDataFrame(rows, "model_alias string, task string, layer int, item_id long, vec array<float>"))
    got = {r.model_alias: r.tau2 for r in tiles.bandwidth(blocks).collect()}
    assert np.isclose(got["a"], plain_tau(x.astype(np.float64)), rtol=1e-12) and got["b"] == got["a"]


def test_degrees_move_no_vectors(many, moved):
    x, blocks, size = many
    tau = tiles.bandwidth(blocks)
    moved()
    got = {r.item_id: r.degree for r in tiles.degrees(blocks, tau).collect()}
    w = np.exp(-distances(x) / (2 * plain_tau(x) + 1e-12))
    np.fill_diagonal(w, 0)
    assert np.allclose([got[k] for k in range(len(x))], w.sum(1), rtol=1e-9)
    assert moved() < size


def test_parts_of_a_block_are_joined(many, monkeypatch):
    x, blocks, _ = many
    tau, kept = tiles.bandwidth(blocks), {}
    for held in (1, 256):  # folds handed out after each pair of blocks, or at the end
        monkeypatch.setattr(tiles, "HELD", held)
        kept[held] = {r.item_id: r.degree for r in tiles.degrees(blocks, tau).collect()}
    assert kept[1].keys() == kept[256].keys() == set(range(len(x))) and all(np.isclose(kept[1][k], kept[256][k], rtol=1e-12) for k in kept[1])


@pytest.mark.parametrize("k", [2, 10])
def test_nearest_move_no_vectors(many, moved, k):
    x, blocks, size = many
    moved()
    near = tiles.nearest(blocks, k)
    rows = near.collect()
    assert moved() < size
    d = distances(x)
    np.fill_diagonal(d, np.inf)
    assert sorted((r.item_id, r.place, r.other) for r in rows) == [(i, p + 1, j) for i in range(len(x)) for p, j in enumerate(sorted(range(len(x)), key=lambda j: (d[i, j], j))[:k])]


def test_copies_tie_as_in_sql(spark, monkeypatch):
    """Copies of a vector are equally far from any other, wherever they stand in a tile: the smaller ids come first."""
    monkeypatch.setattr(tiles, "ROWS", 64)
    rng = np.random.default_rng(9)
    x = np.concatenate([np.repeat(rng.normal(size=(5, 33)), 37, axis=0), rng.normal(size=(100, 33))])[rng.permutation(285)]
    blocks = tiles.item_blocks(spark.createDataFrame([("a", "t", 1, k, v.tolist()) for k, v in enumerate(x)], "model_alias string, task string, layer int, item_id long, vec array<double>"))
    got = sorted((r.item_id, r.place, r.other) for r in tiles.nearest(blocks, 10).collect())
    d = np.add.accumulate((x[:, None] - x[None]) ** 2, axis=2)[:, :, -1]
    np.fill_diagonal(d, np.inf)
    assert got == [(i, p + 1, j) for i in range(len(x)) for p, j in enumerate(sorted(range(len(x)), key=lambda j: (d[i, j], j))[:10])]


def test_two_nn_moves_no_vectors(many, moved):
    x, blocks, size = many
    moved()
    (row,) = tiles.two_nn(tiles.nearest(blocks, 2)).collect()
    assert np.isclose(row.dimension, vectors.two_nn(x)["dimension"]) and moved() < size


def test_mean_abs_cosine_moves_no_vectors(many, moved):
    x, blocks, size = many
    moved()
    (row,) = tiles.mean_abs_cosine(blocks).collect()
    assert np.isclose(row.mean_abs_cosine, vectors.abs_cosine(x)["mean_abs_cosine"]) and moved() < size


def test_lanczos_finds_close_and_repeated_values():
    rng = np.random.default_rng(4)
    turn = np.linalg.qr(rng.normal(size=(400, 400)))[0]
    values = np.sort(np.concatenate([[0, 0, 0], 1e-7 * np.arange(1, 5), 0.3 + 1e-4 * np.arange(6), rng.uniform(0.5, 2, 387)]))
    got, basis = vectors.lanczos(turn * values @ turn.T, 12)
    assert np.allclose(got, values[:12], atol=1e-9)
    assert np.linalg.norm(basis @ basis.T - turn[:, :12] @ turn[:, :12].T) < 1e-5
    small, _ = vectors.lanczos(np.diag([3.0, 1, 2]), 12)
    assert np.allclose(small, [1, 2, 3])
    zero, q = vectors.lanczos(np.zeros((50, 50)), 4)
    assert np.allclose(zero, 0) and np.allclose(q.T @ q, np.eye(4))


def test_scores_from_few_modes_equal_those_from_all():
    rng = np.random.default_rng(5)
    for x in (rng.normal(size=(300, 20)), rng.normal(size=(300, 2)), np.repeat(rng.normal(size=(3, 6)), 100, axis=0) + 1e-3 * rng.normal(size=(300, 6))):
        own = vectors.harmonic_score(x)
        lam, modes = np.linalg.eigh(vectors.laplacian(vectors.affinity(x - x.mean(0))))
        energy = (((x - x.mean(0)).T @ modes[:, 1:11]) ** 2).sum(0) / x.shape[1]
        assert np.isclose(own["score"], np.log1p(((1 + np.maximum(lam[1:11], 0)) * energy).sum()), rtol=1e-8) and np.isclose(own["lambda10"], max(lam[9], 0), atol=1e-9)
        assert own["n_modes_available"] == 299
