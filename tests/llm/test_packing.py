import random
from collections import Counter

from photoloom.llm.packing import pack, reduce_and_fit, usage

PACKS = "pack_id int, pack_name string, capacity_tokens int"


def loads(counts, capacity):
    runs, n, fixed = reduce_and_fit(counts, capacity)
    load, seen = Counter(), Counter()
    for s, first, until, container, each in runs:
        for i in range(first, until):
            load[container + (i - first) // each] += s
            seen[s, i] += 1
    assert set(seen) == {(s, i) for s, k in counts.items() for i in range(k)} and set(seen.values()) <= {1}
    assert sorted(load) == list(range(n)) and max(load.values(), default=0) <= capacity
    return n, fixed


def best_fit(counts, capacity):
    rooms = []
    for s in sorted((s for s, k in counts.items() for _ in range(k)), reverse=True):
        fits = [r for r in rooms if r >= s]
        if fits:
            rooms.remove(min(fits))
            rooms.append(min(fits) - s)
        else:
            rooms.append(capacity - s)
    return len(rooms)


def least(counts, capacity):
    """The optimum, by trying all ways for few items."""
    sizes = sorted((s for s, k in counts.items() for _ in range(k)), reverse=True)
    best = len(sizes)

    def go(i, rooms):
        nonlocal best
        if len(rooms) >= best:
            return
        if i == len(sizes):
            best = len(rooms)
            return
        for r in sorted(set(rooms)):
            if r >= sizes[i]:
                rest = list(rooms)
                rest.remove(r)
                go(i + 1, [*rest, r - sizes[i]])
        go(i + 1, [*rooms, capacity - sizes[i]])

    go(0, [])
    return best


def test_random_instances_are_valid_and_no_worse_than_best_fit():
    rnd = random.Random(1)
    for _ in range(150):
        capacity = rnd.randrange(5, 60)
        counts = dict(Counter(rnd.randrange(1, capacity + 1) for _ in range(rnd.randrange(0, 80))))
        n, _ = loads(counts, capacity)
        assert n <= best_fit(counts, capacity) + 1


def test_reduction_is_optimal_where_it_places_everything():
    rnd = random.Random(7)
    tried = 0
    for _ in range(400):
        capacity = rnd.randrange(5, 25)
        counts = dict(Counter(rnd.randrange(capacity // 4, capacity + 1) for _ in range(rnd.randrange(1, 9))))
        counts.pop(0, None)
        n, fixed = loads(counts, capacity)
        if fixed == n:
            tried += 1
            assert n == least(counts, capacity), counts
    assert tried > 100


def test_documents(spark):
    rnd = random.Random(3)
    rows = [(i, rnd.choice([0, None, 1, 7, 50, 99, 100, 101, 250, 10**4])) for i in range(400)] + [(5, 7), (None, 7)] + [(1000 + i, 100) for i in range(300)]
    packs = spark.createDataFrame([(1, "a", 100), (2, "b", 333), (3, "none", 0), (1, "a", 100)], PACKS)
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "doc_id long, n_tokens long, size string, pack_id int")
    got = pack(df, packs)
    out = got.collect()
    for p, capacity in ((1, 100), (2, 333)):
        mine = [r for r in out if r.pack_id == p]
        assert Counter(r.doc_id for r in mine if r.piece == 0) == Counter(d for d, _ in rows)
        assert sum(r.size for r in mine) == sum(n or 0 for _, n in rows)
        assert all(r.size == capacity or r.piece == max(x.piece for x in mine if x.doc_id == r.doc_id) for r in mine if r.doc_id not in (None, 5) and r.size < capacity)
        load = Counter()
        for r in mine:
            load[r.container_id] += r.size
        assert max(load.values()) <= capacity
        assert len(load) <= 1.02 * -(-sum(load.values()) // capacity) + 1
    assert {r.pack_id for r in usage(got, packs).collect()} == {1, 2}
    assert pack(df.limit(0), packs).count() == 0 and pack(df, packs.limit(0)).count() == 0
