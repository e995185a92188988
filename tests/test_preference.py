import itertools

from repselect import registry
from repselect.plans.queries_tables import candidates

DATA = "/root/testdata/sf0.001"


def test_preference_accuracy_of_all_features(spark):
    groups = {}
    for r in candidates(spark, DATA).collect():
        groups.setdefault((r.task, r.seed, r.feature), []).append((r.x, r.y))
    want = {}
    for k, rows in groups.items():
        told = [(a[0] - b[0], a[1] - b[1]) for a, b in itertools.combinations(rows, 2)]
        told = [(s, u) for s, u in told if abs(s) > 1e-12 and abs(u) > 1e-12]
        want[k] = (len(told), sum((s > 0) == (u > 0) for s, u in told) / len(told) if told else None)
    got = {(r.task, r.seed, r.feature): (r.n_pairs, r.accuracy_all) for r in registry.QUERIES["h11_preference_accuracy"](spark, DATA).collect()}
    assert len({k[2] for k in got}) == 9 and got.keys() == want.keys()
    assert all(got[k][0] == n and (x is None or abs(got[k][1] - x) < 1e-8) for k, (n, x) in want.items())
