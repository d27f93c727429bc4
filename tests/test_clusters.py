import random

from photoloom.operators.clusters import neighbour_clusters


def test_two_clouds_are_told_apart(spark):
    rnd = random.Random(1)
    rows = [(i, rnd.gauss(0 if i < 40 else 9, 1), rnd.gauss(0, 1)) for i in range(65)] + [(99, 500.0, 500.0), (98, None, 1.0)]
    got = {r.id: r.cluster for r in neighbour_clusters(spark.createDataFrame([(i, x, y) for i, x, y in rows], "id long, x double, y double"), 6.0, 2).collect()}
    assert 99 not in got and 98 not in got
    first = [got[i] for i in range(40)]
    second = [got[i] for i in range(40, 65)]
    assert sum(c == max(set(first), key=first.count) for c in first) >= 36
    assert max(set(first), key=first.count) != max(set(second), key=second.count)
