"""Filling fixed-capacity containers with items (problem 7): dominance reduction, then best fit for the rest.

Only sizes matter, so the instance that is solved is the histogram of sizes: at most ``capacity`` rows, however many documents
there are.  It is solved in bulk, all items of a size at a time:

* Reduction (Martello and Toth): take the largest open size ``s`` with room ``c`` left beside it.  A set that fills the container
  exactly, or the best partner where no two smaller items fit beside ``s``, or a partner at least as large as every pair that
  fits, dominates every other container with ``s``: such containers are fixed, as often as the counts allow.
* What no rule decides goes best-fit decreasing into containers, each item into the fullest one that has room.

The plan gives runs of item numbers of a size to runs of containers; documents get their number within their size from salted
counts (``SALT`` buckets for each size), so a size that a third of all documents share is spread over many tasks.

Defined results
---------------
* a null or empty text has size 0 and goes into container 0, where it takes no room; a null key is a document like others.
* a document larger than the capacity is cut into full containers and one remainder, which is packed like an item.
* ties among documents of a size are broken by a hash and then by key; repeated rows are items of their own.
* capacities must be positive, others are left out; empty tables give an empty result.
"""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from photoloom.session import cut

#: Buckets that the items of one size are counted and numbered in.
SALT = 1024
#: Packs at most.
MOST_PACKS = 100
PLAN = "pack_id int, size long, first long, until long, container long, each long"


def reduce_and_fit(counts: dict[int, int], capacity: int) -> tuple[list[tuple[int, int, int, int, int]], int, int]:
    """Runs (size, first, until, container, each) that place all items, the number of containers, and how many of them the
    reduction fixed.  Item ``i`` of a run goes into container ``container + (i - first) // each``."""
    left = {s: n for s, n in counts.items() if n > 0 and 0 < s <= capacity}
    sizes = sorted(left)
    given = dict.fromkeys(left, 0)
    runs: list[tuple[int, int, int, int, int]] = []
    opened = 0

    def place(size: int, n: int, container: int, each: int) -> None:
        runs.append((size, given[size], given[size] + n, container, each))
        given[size] += n
        left[size] -= n
        if not left[size]:
            sizes.pop(bisect_left(sizes, size))

    def largest(most: int, but: int = 0) -> int:
        """The largest open size up to ``most``; of size ``but``, one item is spoken for."""
        i = bisect_left(sizes, most + 1) - 1
        if i >= 0 and sizes[i] == but and left[but] < 2:
            i -= 1
        return sizes[i] if i >= 0 else 0

    def smallest(k: int, but: int) -> int:
        """Sum of the k smallest open items besides one of size ``but``; more than any capacity if there are fewer."""
        total, need = 0, k
        for s in sizes[: k + 1]:
            n = min(need, left[s] - (s == but))
            total, need = total + n * s, need - n
            if not need:
                return total
        return capacity * 4

    def best_pair(room: int, but: int) -> tuple[int, int]:
        """The two open items with the largest sum up to ``room``, the larger one first."""
        best = (0, 0)
        hi = bisect_left(sizes, room) - 1
        while hi >= 0 and 2 * sizes[hi] > sum(best):
            a = sizes[hi]
            if left[a] - (a == but) > 0:
                i = bisect_left(sizes, min(room - a, a) + 1) - 1
                while i >= 0 and left[sizes[i]] - (sizes[i] == but) - (sizes[i] == a) <= 0:
                    i -= 1
                if i >= 0 and a + sizes[i] > sum(best):
                    best = (a, sizes[i])
            hi -= 1
        return best

    kept = []
    for s in reversed(list(sizes)):
        while left.get(s, 0):
            room = capacity - s
            n = left[s]
            k = largest(room, s)
            if not k:
                place(s, n, opened, 1)
                opened += n
                continue
            partners: tuple[int, ...] = ()
            if k == room or smallest(2, s) > room:
                partners = (k,)
            elif smallest(3, s) > room:
                a, b = best_pair(room, s)
                if k >= a + b:
                    partners = (k,)
                elif a == k and not any(x > b and 2 * x <= room for x in sizes[bisect_left(sizes, b + 1) :][:1]):
                    partners = (a, b)
            if not partners:
                break
            uses = {x: (x == s) + partners.count(x) for x in {s, *partners}}
            m = min(left[x] // u for x, u in uses.items())
            if not m:
                break
            for x, u in uses.items():
                place(x, m * u, opened, u)
            opened += m
        if left.get(s, 0):
            kept.append(s)
    fixed = opened
    # Best fit decreasing: ``rooms`` has the free room of open containers, ``spots`` the runs of containers with that room.
    rooms: list[int] = []
    spots: dict[int, list[tuple[int, int]]] = {}

    def free(room: int, container: int, n: int) -> None:
        if room > 0 and n > 0:
            if room not in spots:
                insort(rooms, room)
                spots[room] = []
            spots[room].append((container, n))

    for s in sorted((x for x in left if left[x]), reverse=True):
        while left[s]:
            n, i = left[s], bisect_left(rooms, s)
            if i == len(rooms):
                room, container, have = capacity, opened, -(-n // (capacity // s))
                opened += have
            else:
                room = rooms[i]
                container, have = spots[room].pop()
                if not spots[room]:
                    del spots[room], rooms[i]
            each = room // s
            full = min(have, n // each)
            if full:
                place(s, full * each, container, each)
                free(room - each * s, container, full)
            over = min(left[s], each - 1) if full < have else 0
            if over:
                place(s, over, container + full, over)
                free(room - over * s, container + full, 1)
            free(room, container + full + (1 if over else 0), have - full - (1 if over else 0))
    return runs, opened, fixed


def _plan(pdf: pd.DataFrame) -> pd.DataFrame:
    runs, _, _ = reduce_and_fit(dict(zip(pdf["size"], pdf["n"], strict=True)), int(pdf["capacity"].iloc[0]))
    out = pd.DataFrame(runs, columns=["size", "first", "until", "container", "each"])
    return out.assign(pack_id=int(pdf["pack_id"].iloc[0]))


def items(sizes: DataFrame, packs: DataFrame, *, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """pack_id, capacity, key, piece, size: every document once for each pack, cut only where it exceeds the capacity."""
    # The list of packs is a small fixed table: it becomes a literal, and each document is repeated once for each of them.
    listed = sorted({(r["pack_id"], r["capacity_tokens"]) for r in packs.where("capacity_tokens > 0").select("pack_id", "capacity_tokens").distinct().limit(MOST_PACKS + 1).collect()})
    if len(listed) > MOST_PACKS:
        raise ValueError(f"more than {MOST_PACKS} packs")
    array = F.array(*(F.struct(F.lit(p).cast("int").alias("pack_id"), F.lit(c).cast("long").alias("capacity")) for p, c in listed)) if listed else F.expr("cast(array() as array<struct<pack_id:int,capacity:bigint>>)")
    each = sizes.select(key, F.coalesce(F.col(size), F.lit(0)).cast("long").alias("_n"), F.inline(array))
    last = F.greatest(F.ceil(F.col("_n") / F.col("capacity")), F.lit(1)).cast("long") - 1
    cut_up = each.withColumn("_last", last).withColumn("piece", F.explode(F.sequence(F.lit(0).cast("long"), "_last")))
    return cut_up.select("pack_id", "capacity", key, "piece", F.when(F.col("piece") < F.col("_last"), F.col("capacity")).otherwise(F.col("_n") - F.col("_last") * F.col("capacity")).alias("size"))


def pack(sizes: DataFrame, packs: DataFrame, *, key: str = "doc_id", size: str = "n_tokens") -> DataFrame:
    """pack_id, container_id, ``key``, piece, size: the container of every document or piece."""
    all_items = items(sizes, packs, key=key, size=size)
    salted = all_items.withColumn("_salt", F.pmod(F.xxhash64(F.col(key), F.col("piece")), F.lit(SALT)).cast("int"))
    counts = cut(salted.groupBy("pack_id", "capacity", "size", "_salt").agg(F.count("*").alias("n")))
    plan = counts.where("size > 0").groupBy("pack_id", "capacity", "size").agg(F.sum("n").alias("n")).groupBy("pack_id").applyInPandas(_plan, PLAN)
    plan = plan.groupBy("pack_id", "size").agg(F.sort_array(F.collect_list(F.struct("first", "until", "container", "each"))).alias("runs"))
    earlier = W.partitionBy("pack_id", "size").orderBy("_salt").rowsBetween(W.unboundedPreceding, -1)
    offsets = counts.select("pack_id", "size", "_salt", F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("_offset"))
    within = W.partitionBy("pack_id", "size", "_salt").orderBy(key, "piece")
    numbered = salted.withColumn("_k", F.row_number().over(within) - 1).join(offsets, ["pack_id", "size", "_salt"]).join(plan, ["pack_id", "size"], "left")
    number = F.col("_k") + F.col("_offset")
    numbered = numbered.withColumn("_i", number).withColumn("_run", F.element_at(F.filter("runs", lambda r: (r["first"] <= F.col("_i")) & (F.col("_i") < r["until"])), 1))
    container = F.col("_run.container") + F.floor((F.col("_i") - F.col("_run.first")) / F.col("_run.each"))
    return numbered.select("pack_id", F.when(F.col("size") > 0, container).otherwise(F.lit(0)).cast("long").alias("container_id"), key, "piece", "size")


def usage(packed: DataFrame, packs: DataFrame) -> DataFrame:
    """pack_id, capacity_tokens, containers, tokens, least_containers (no packing has fewer), fill."""
    by = packed.where("size > 0").groupBy("pack_id", "container_id").agg(F.sum("size").alias("load")).groupBy("pack_id").agg(F.count("*").alias("containers"), F.sum("load").alias("tokens"))
    d = by.join(packs.select("pack_id", "capacity_tokens").distinct(), "pack_id")
    return d.select("pack_id", "capacity_tokens", "containers", "tokens", F.ceil(F.col("tokens") / F.col("capacity_tokens")).alias("least_containers"), (F.col("tokens") / F.col("containers") / F.col("capacity_tokens")).alias("fill"))
