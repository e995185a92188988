import random
from collections import Counter

from repselect.llm import similar
from repselect.llm.components import connected_components
from .conftest import odd_rows


def brute_groups(rows, shingle=5, similarity=0.8):
    sets = []
    for _, text in rows:
        words = (text or "").translate({c: c + 32 for c in range(65, 91)})
        words = words.encode().split()
        sets.append({tuple(words[i:i + shingle]) for i in range(max(1, len(words) - shingle + 1))} if words else set())
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            if a == sets[j] or 10 * len(a & sets[j]) >= round(10 * similarity) * len(a | sets[j]) > 0:
                root[find(i)] = find(j)
    least = {}
    for k, (i, _) in enumerate(rows):
        if i is not None:
            least[find(k)] = min(i, least.get(find(k), i))
    return sorted([(i, least.get(find(k))) for k, (i, _) in enumerate(rows)], key=repr)


def test_groups_against_brute_force(spark, monkeypatch):
    """Edited copies around the similarity of 0.8, a passage that many texts hold, and the odd rows."""
    monkeypatch.setattr(similar, "BUCKET", 8)
    rng = random.Random(1)
    word = lambda: f"w{rng.randrange(3000)}"
    passage = [word() for _ in range(40)]
    rows = [(r[0], r[1]) for r in odd_rows()]
    for k in range(40):
        base = [word() for _ in range(rng.choice([4, 5, 6, 30, 70, 200]))] + (passage if k % 2 else [])
        for c in range(4):
            own = list(base)
            for _ in range(round(len(own) * rng.choice([0, 0.01, 0.02, 0.025, 0.03]))):
                own[rng.randrange(len(own))] = word()
            rows.append((1000 + 10 * k + c, " ".join(own)))
    got = similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_groups(rows)


def test_pipeline_stage_drops_edited_copies(spark, odd_docs, no_docs):
    import corpus_pipeline

    rng = random.Random(2)
    base = [f"w{rng.randrange(900)}" for _ in range(100)]
    docs = spark.createDataFrame([(k, " ".join([*base[:50], f"edit{k}", *base[51:]])) for k in range(5)], "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.near_dedup(spark, docs, "").collect()] == [0]
    kept = similar.keep_one(odd_docs)
    assert kept.columns == odd_docs.columns
    got = Counter(r.doc_id for r in kept.collect())
    assert got.pop(None) == 2 and set(got.values()) == {1}
    assert similar.keep_one(no_docs).count() == 0


def pages(n, shared, own, seed=1):
    rng = random.Random(seed)
    word = lambda: f"w{rng.randrange(10 ** 6)}"
    base = [word() for _ in range(shared)]
    return [(k, " ".join([*base[:shared // 2], *[word() for _ in range(own)], *base[shared // 2:]])) for k in range(n)]


def test_pages_of_a_template_make_few_pairs(spark, caplog):
    """Pages that share 170 of 200 words are not similar: pairs to decide grow with the pages, not with their pairs."""
    caplog.set_level("INFO", similar.LOG.name)
    for n in (200, 400):
        caplog.clear()
        rows = pages(n, 170, 30) + [(1000 + k, t.replace("w", "v")) for k, t in pages(20, 170, 30)] + [(2000 + k, t + " x") for k, t in pages(3, 170, 30)]
        got = similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
        assert sorted(map(tuple, got.collect())) == [(i, i % 2000 if i >= 2000 else i) for i in sorted(i for i, _ in rows)]
        assert sum(r.args[2] for r in caplog.records) <= n


def test_bitmaps_bound_what_sets_lack():
    import numpy as np

    rng = np.random.default_rng(1)
    last = np.sort(rng.integers(0, 1 << 63, 900).astype(np.uint64))
    sets = []
    for size in (5, 20, 90, 100, 150, 180):
        own = rng.integers(0, 1 << 63, size).astype(np.uint64)
        sets.append(np.unique(np.concatenate([own, rng.choice(last, 800 - size)])))
        sets.append(np.unique(np.concatenate([own[:-2], rng.choice(last, 800 - size)])))
    found = [similar.early(x, last, 0.8) for x in sets]
    held = [k for k, (_, _, bits) in enumerate(found) if bits]
    assert len(held) >= 8 and all(len(found[k][2]) * (len(found[k][0]) - found[k][1]) <= 8 * len(sets[k]) for k in held)
    maps = similar.Bitmaps([found[k][2] for k in held])
    x, y = np.indices((len(held), len(held))).reshape(2, -1)
    less_x, less_y = maps.lacking(x, y)
    for i, j, a, b in zip(x, y, less_x, less_y):
        p, q = sets[held[i]], sets[held[j]]
        assert a <= len(np.setdiff1d(p, q)) and b <= len(np.setdiff1d(q, p))
    assert less_x.max() > 30


def test_stars_are_joined_by_few_tasks(spark):
    """A task costs a line of the log and small files, however few links it has."""
    kept = "spark.sql.adaptive.coalescePartitions.enabled"
    spark.conf.set(kept, "false")
    context = spark.sparkContext
    context.setJobGroup("stars", "stars")
    try:
        links = [(100 * k + c, 100 * k) for k in range(20) for c in range(1, 50)] + [(100 * k, 100 * k - 100) for k in range(1, 20, 2)]
        got = connected_components(spark.createDataFrame(links, "a long, b long").repartition(8))
        assert sorted(map(tuple, got.collect())) == sorted({(a, a // 200 * 200) for a, _ in links})
    finally:
        context.setLocalProperty("spark.jobGroup.id", None)
        spark.conf.unset(kept)
    told = context.statusTracker()
    stages = {s for j in told.getJobIdsForGroup("stars") for s in told.getJobInfo(j).stageIds}
    assert sum(info.numCompletedTasks for info in map(told.getStageInfo, stages) if info) <= 120


def near_copies(n, edits, seed=1):
    """Copies of a text of 150 words, each with words of its own in other places: most pairs are just not similar."""
    rng = random.Random(seed)
    base = [f"w{rng.randrange(10 ** 6)}" for _ in range(150)]
    rows = []
    for k in range(n):
        own = list(base)
        for c in range(edits(k)):
            own[rng.randrange(150)] = f"own{k}x{c}"
        rows.append((k, " ".join(own)))
    return rows


def rows_of_pairs(monkeypatch):
    """Rows of the tables that ``_verified`` is given, one a pair."""
    own, seen = similar._verified, []

    def verified(pairs, sets, similarity):
        seen.append(pairs.count())
        return own(pairs, sets, similarity)

    monkeypatch.setattr(similar, "_verified", verified)
    return seen


def test_near_copies_just_below_the_threshold_make_no_rows_of_pairs(spark, monkeypatch):
    """As many pairs are compared, but rows grow with the copies."""
    rows = near_copies(200, lambda k: 2 + k % 3)
    seen = rows_of_pairs(monkeypatch)
    got = similar.similar_groups(spark.createDataFrame(rows, "doc_id long, text string").repartition(4))
    assert sorted(map(tuple, got.collect()), key=repr) == brute_groups(rows)
    assert sum(seen) <= 4 * len(rows)  # with a row a pair, several thousand


def test_tiles_and_listed_pairs_give_the_same_groups(spark, monkeypatch):
    """Groups in one tile, in tiles of pairs of parts, and listed pair by pair."""
    rows = near_copies(60, lambda k: 1 + k % 4) + [(1000 + k, t.replace("w", "v")) for k, t in near_copies(7, lambda k: 2 + k % 2, 2)]
    want = brute_groups(rows)
    assert 1 < len({c for _, c in want}) < len(rows)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    for tile, elements in ((512, 1 << 19), (16, 1 << 19), (512, 1 << 11), (1, 1)):
        monkeypatch.setattr(similar, "TILE", tile)
        monkeypatch.setattr(similar, "TILE_ELEMENTS", elements)
        monkeypatch.setattr(similar, "ROUNDS", 1)
        assert sorted(map(tuple, similar.similar_groups(docs).collect()), key=repr) == want


def test_common_elements_of_pairs_in_parts(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(1)
    sets = [np.unique(rng.integers(0, 500, k).astype(np.uint64) << np.uint64(50)) for k in (0, 1, 30, 200, 400, 400)]
    x, y = np.triu_indices(6, 1)
    for columns in (64, 128, 1 << 13):
        monkeypatch.setattr(similar, "COLUMNS", columns)
        monkeypatch.setattr(similar, "PAIRED", 100)
        assert similar._common(sets, x, y).tolist() == [len(np.intersect1d(sets[a], sets[b])) for a, b in zip(x, y)]
    assert similar._common([], x[:0], y[:0]).tolist() == []
