"""Implausible readings in measured series (problem 2).

``score_readings`` scores every non-null reading of every value column.  A reading's features are taken within its night: the
level against the local median (of the reading, and of its difference to the instrument's own magnitude: real variability moves
both, a faulty reading only one), the differences to both neighbours, the course of the night, the run length, and, over all
nights of the source, the seasonal deviation from what it shows in that hour.  One isolation forest for each source and filter
learns what is normal there and scores all its readings.  A spike is a reading whose score stands out from the *source's own
scores* (``OUTSTANDING`` robust deviations above their median) and that an exact check confirms: off the local level, not
followed by the instrument's magnitude, and no longer than two readings.  Explicit rules go with the score: physical limits, and
runs of one value.

Layout: a source of at most ``PLENTY`` readings is one part of one shuffle, and its forest is grown where it is scored, many
sources side by side in NumPy.  A source with more takes steps of its own, which give the same numbers to the last bit: features
by night, exact medians by counting (``_medians``), and scores in chunks of its readings.  Each chunk has the readings that the
trees draw (``TREES`` x ``PSI`` at most, about), so it grows the same forest: all random choices are hashes of the source, the
reading, the tree and the node.  No task holds more than a batch and one part.  Sources above ``PLENTY`` are at most
``MOST_PLENTIFUL``, since the bound rises with the table; their keys and medians are broadcast.  The bound is one of layout only.

Defined results
---------------
* repeated rows (same source, filter, image) count once, the one of the least values; a null or NaN value is no reading; a null
  source or image is ignored; a null filter is one of its own.
* an image without a time gets only the rule of physical limits.
* ties in time are ordered by image number; a night of one or two readings has no spikes, only limits apply to it.
* an empty table gives an empty result; other columns of the input are not looked at.
"""

from __future__ import annotations

import math
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from photoloom.session import cut

#: A star in the night sky is never brighter than the first, and no detector reaches the second (magnitudes).
LIMITS = (-2.0, 30.0)
#: Readings of one value in a row that make a stuck run.
STUCK = 6
#: Trees, and readings for each tree, of an isolation forest.
TREES, PSI = 16, 128
#: Readings of a source that are kept in one part, and the most sources that may have more.
PLENTY, MOST_PLENTIFUL = 20_000, 65_536
#: Cells of the axis, for each unit of it, in which exact medians are sought, and the sources whose cells by hour are broadcast.
CELLS, FEW = 2**14, 4096
#: A score stands out from this many robust deviations above the median score of its source.
OUTSTANDING = 3.5
#: The bounds of the exact check in units of the local spread: of the reading, of its difference to the instrument's magnitude,
#: and of a reading without such a magnitude.
LEVEL_SIGMAS, FIT_SIGMAS, ALONE_SIGMAS = 4.0, 5.0, 7.0
#: Least spread that is believed (magnitudes): readings are printed with four decimals, some with two.
FLOOR = 0.004
HALF = 4

SCORED = "image_id int, object_id long, filter_name string, field_name string, value double, score double, impossible boolean, stuck boolean, spike boolean"


def image_times(frames: DataFrame) -> DataFrame:
    """image_id, jd: one row for each image; jd is taken from date_obs where it is null."""
    from_date = F.unix_micros(F.col("date_obs").cast("timestamp")) / F.lit(86_400e6) + F.lit(2_440_587.5)
    return frames.where(F.col("image_id").isNotNull()).groupBy("image_id").agg(F.coalesce(F.min("jd"), F.min(from_date)).alias("jd"))


def _near(v: np.ndarray, starts: np.ndarray, group: np.ndarray, k: int) -> np.ndarray:
    """The value ``k`` places further in the same series, NaN beyond its ends."""
    out = np.full(len(v), np.nan)
    if abs(k) < len(v):
        a, b = (slice(k, None), slice(None, -k)) if k > 0 else (slice(None, k), slice(-k, None))
        out[b] = np.where(group[a] == group[b], v[a], np.nan) if k else v
    return out


def _median(stack: np.ndarray) -> np.ndarray:
    """Median over the first axis, without NaN."""
    s = np.sort(stack, axis=0)
    n = (~np.isnan(s)).sum(axis=0)
    at = np.arange(s.shape[1])
    low, high = s[np.maximum(n - 1, 0) // 2, at], s[np.minimum(n // 2, len(s) - 1), at]
    return (low + high) / 2


def _local_median(v: np.ndarray, starts: np.ndarray, group: np.ndarray) -> np.ndarray:
    return _median(np.stack([v if k == 0 else _near(v, starts, group, k) for k in range(-HALF, HALF + 1)]))


def _group_median(v: np.ndarray, group: np.ndarray, n_groups: int) -> np.ndarray:
    """For each series the median of its values, without NaN (NaN where there is none)."""
    order = np.lexsort((v, group))
    good = np.bincount(group[~np.isnan(v)], minlength=n_groups)
    first = np.concatenate([[0], np.cumsum(np.bincount(group, minlength=n_groups))[:-1]])
    s = v[order]
    with np.errstate(invalid="ignore"):
        m = (s[np.minimum(first + np.maximum(good - 1, 0) // 2, len(s) - 1)] + s[np.minimum(first + good // 2, len(s) - 1)]) / 2
    return np.where(good > 0, m, np.nan)


def _hash(*parts: np.ndarray | int) -> np.ndarray:
    """A 64-bit hash of whole numbers, row by row: the random choices of the forests, the same in every layout."""
    out = np.uint64(0)
    with np.errstate(over="ignore"):
        for p in parts:
            out = (out ^ np.asarray(p).astype(np.uint64)) + np.uint64(0x9E3779B97F4A7C15)
            out = (out ^ (out >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
            out = (out ^ (out >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
            out = out ^ (out >> np.uint64(31))
    return out


def _unit(h: np.ndarray) -> np.ndarray:
    return (h >> np.uint64(11)).astype(float) / 2.0**53


def _expected(k: np.ndarray) -> np.ndarray:
    """Cuts that isolate a reading among ``k``, on average."""
    k = np.maximum(k, 1).astype(float)
    return np.where(k > 2, 2 * (np.log(np.maximum(k - 1, 1)) + 0.5772156649) - 2 * (k - 1) / k, np.where(k == 2, 1.0, 0.0))


def _draws(rows: np.ndarray, tree: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Whether a tree learns from a reading of a source that has ``size`` to learn from: all of them, or about ``PSI``."""
    return _unit(_hash(rows, tree)) * size < PSI


def forest_scores(x: np.ndarray, group: np.ndarray, seeds: np.ndarray, rows: np.ndarray, learns: np.ndarray, size: np.ndarray | None = None) -> np.ndarray:
    """Isolation scores of the rows of ``x`` (features in columns), one forest for each group, all trees grown side by side.

    ``group`` numbers rise from 0 and lie side by side, ``seeds`` has one number for each.  Every node draws a feature and a cut
    between the least and the largest value of the readings that its tree learns from (of those that ``learns`` allows at most
    about ``PSI``, by a hash of ``rows``); all readings walk down.  A reading that is alone after ``d`` cuts has depth ``d``; one
    in a node of ``n`` has ``d`` and what ``n`` readings take on average.  ``size`` has the readings that a group learns from, where
    only those are given that its trees draw.  The scores of a group do not depend on the other groups.
    """
    n, m = x.shape
    x = np.ascontiguousarray(x, dtype=np.float32).ravel()
    size = np.bincount(group[learns], minlength=len(seeds)) if size is None else size
    levels = math.ceil(math.log2(PSI))
    # Rows of a node lie side by side in ``here``; ``first`` has where each node begins, ``cuts`` how many lead to it.
    here = np.tile(np.arange(n, dtype=np.int32), TREES)
    tree = np.repeat(np.arange(TREES), n)
    learner = np.tile(learns, TREES)
    if size.max(initial=0) > PSI:
        learner &= _draws(rows[here], tree, size[group][here])
    everyone = bool(learner.all())
    first = np.flatnonzero(np.diff(tree * len(seeds) + group[here], prepend=-1))
    seed, cuts = _hash(seeds[group[here[first]]], tree[first]), np.zeros(len(first))
    total = np.zeros(n)
    for level in range(levels + 1):
        length = np.diff(np.append(first, len(here)))
        count = length if everyone else np.add.reduceat(learner, first, dtype=np.int64)
        ends = (count <= 1) | (level == levels)
        run = np.repeat(np.arange(len(first), dtype=np.int32), length)
        if ends.any():
            over = ends[run]
            total += np.bincount(here[over], weights=np.repeat((cuts + _expected(count))[ends], length[ends]), minlength=n)
            here = here[~over]
            if not len(here):
                break
            learner = learner if everyone else learner[~over]
            length, seed, cuts = length[~ends], seed[~ends], cuts[~ends]
            first = np.concatenate([[0], np.cumsum(length)[:-1]])
            run = np.repeat(np.arange(len(first), dtype=np.int32), length)
        v = x[here * m + (seed % np.uint64(m)).astype(np.int32)[run]]
        if everyone:
            low, high = np.minimum.reduceat(v, first), np.maximum.reduceat(v, first)
        else:
            low = np.minimum.reduceat(np.where(learner, v, np.float32(np.inf)), first)
            high = np.maximum.reduceat(np.where(learner, v, np.float32(-np.inf)), first)
        splits = high > low
        # A node whose drawn feature does not tell its readings apart counts no cut and draws another one.
        cut = np.where(splits, low + (high - low) * _unit(_hash(seed, 1)).astype(np.float32), np.float32(np.inf))
        right = v > cut[run]
        seen = np.concatenate([[0], np.cumsum(right)])
        n_right = seen[first + length] - seen[first]
        before = seen[:-1] - seen[first][run]
        place = np.where(right, (first + length - n_right)[run] + before, np.arange(len(here)) - before)
        moved = np.empty_like(here)
        moved[place] = here
        here = moved
        if not everyone:
            kept = np.empty_like(learner)
            kept[place] = learner
            learner = kept
        filled = np.stack([n_right < length, n_right > 0], axis=1)
        cuts = np.repeat(cuts + splits, 2).reshape(-1, 2)[filled]
        seed = np.stack([_hash(seed, 2), _hash(seed, 3)], axis=1)[filled]
        first = np.stack([first, first + length - n_right], axis=1)[filled]
    expected = np.maximum(_expected(np.minimum(size, PSI)), 1e-9)
    return np.where(size[group] > 2, 2.0 ** (-(total / TREES) / expected[group]), 0.5)


#: The features of a reading (the seasonal one is added where the whole source, or its sample, is at hand).
FEATURES = ("level", "course", "difference_level", "before", "after", "run_length")


def night_features(v: np.ndarray, fit: np.ndarray, night: np.ndarray) -> dict[str, np.ndarray]:
    """Rules and features of the readings ``v`` (no NaN), in time order within ``night`` (numbers that rise from 0)."""
    n = len(v)
    impossible = ~((v >= LIMITS[0]) & (v <= LIMITS[1]))
    new = (np.diff(v, prepend=np.nan) != 0) | (np.diff(night, prepend=-1) != 0)
    run = np.cumsum(new) - 1
    length = np.bincount(run)[run] if n else np.zeros(0)
    stuck = length >= STUCK
    ok = ~impossible & ~stuck
    x, confirmed = np.zeros((n, len(FEATURES))), np.zeros(n, bool)
    q = v - fit
    if ok.any():
        w, p = v[ok], q[ok]
        kept, h = np.unique(night[ok], return_inverse=True)
        g = len(kept)
        r = w - _local_median(w, None, h)
        spread = np.maximum(1.4826 * _group_median(np.abs(r), h, g), FLOOR)[h]
        rq = p - _local_median(p, None, h)
        sq = np.maximum(1.4826 * _group_median(np.abs(rq), h, g), FLOOR)[h]
        known = ~np.isnan(rq)
        with np.errstate(invalid="ignore"):
            level, off = r / spread, rq / sq
            # How much of the deviation the instrument's own magnitude does not share.
            alone = np.where(known, np.sign(off) * np.minimum(np.abs(level), np.abs(off)), level)
            back, ahead = (_median(np.stack([_near(w, None, h, side * k) for k in (1, 2, 3)])) for side in (-1, 1))
            course = (w - np.where(np.isnan(back), ahead, np.where(np.isnan(ahead), back, (back + ahead) / 2))) / spread
            steps = []
            for k in (-1, 1):
                by_fit, plain = (p - _near(p, None, h, k)) / sq, (w - _near(w, None, h, k)) / spread
                steps.append(np.where(np.isnan(by_fit), plain, by_fit))
            x[ok] = np.nan_to_num(np.stack([alone, course, np.where(known, off, level), *steps, np.log1p(length[ok])], axis=1))
            far = np.where(known, (np.abs(level) >= LEVEL_SIGMAS) & (np.abs(off) >= FIT_SIGMAS), np.abs(level) >= ALONE_SIGMAS)
        streak = np.cumsum((np.diff(far.astype(int), prepend=-1) != 0) | (np.diff(h, prepend=-1) != 0)) - 1
        confirmed[ok] = far & (np.bincount(streak)[streak] <= 2) & (np.bincount(h, minlength=g)[h] > 2)
    if not ok.all():
        # Broken readings are scored by the plain distance to the rest of their night.
        nights = int(night[-1]) + 1
        clean = np.where(ok, v, np.nan)
        centre = _group_median(clean, night, nights)
        centre = np.where(np.isnan(centre), _group_median(v, night, nights), centre)[night]
        scatter = np.maximum(np.nan_to_num(1.4826 * _group_median(np.abs(clean - centre), night, nights)), FLOOR)[night]
        level = (v - centre) / scatter
        steps = [np.nan_to_num((v - _near(v, None, night, k)) / scatter) for k in (-1, 1)]
        x[~ok] = np.stack([level, level, level, *steps, np.log1p(length)], axis=1)[~ok]
    return {"x": np.clip(x, -1e6, 1e6), "impossible": impossible, "stuck": stuck, "confirmed": confirmed, "ok": ok}


def _seasonal(v: np.ndarray, hour: np.ndarray, group: np.ndarray, n_groups: int, learns: np.ndarray) -> np.ndarray:
    """Deviation from the median of the source in the same hour, over all its nights, in units of its spread."""
    slot = group * 24 + hour
    usual = _group_median(np.where(learns, v, np.nan), slot, n_groups * 24)
    off = v - usual[slot]
    spread = np.maximum(np.nan_to_num(1.4826 * _group_median(np.where(learns, np.abs(off), np.nan), group, n_groups)), FLOOR)
    return np.clip(np.nan_to_num(off / spread[group]), -1e6, 1e6)


def score_sources(v: np.ndarray, fit: np.ndarray, hour: np.ndarray, night: np.ndarray, source: np.ndarray, seeds: np.ndarray, rows: np.ndarray) -> dict[str, np.ndarray]:
    """Scores and rules of readings, those of a source side by side, in time order within its nights."""
    got = night_features(v, fit, night)
    learns = got["ok"]
    season = _seasonal(v, hour, source, len(seeds), learns)
    score = forest_scores(np.column_stack([got["x"], season]), source, seeds, rows, learns)
    own = np.where(learns, score, np.nan)
    middle = _group_median(own, source, len(seeds))
    spread = 1.4826 * _group_median(np.abs(own - middle[source]), source, len(seeds))
    outstanding = score >= np.nan_to_num(middle + OUTSTANDING * spread, nan=np.inf)[source]
    return {"score": score, "impossible": got["impossible"], "stuck": got["stuck"], "spike": outstanding & got["confirmed"]}


def _starts(*columns: np.ndarray) -> np.ndarray:
    """Numbers from 0 that rise where any of the columns changes."""
    change = np.zeros(len(columns[0]), bool)
    for c in columns:
        change[1:] |= c[1:] != c[:-1]
    return np.cumsum(change)


def _names(filters: pd.Series) -> np.ndarray:
    """Names of filters, None where there is none."""
    return filters.astype(object).where(filters.notna(), None).to_numpy()


def _seeds(objects: np.ndarray, names: np.ndarray, k: int) -> np.ndarray:
    return _hash(objects, np.array([zlib.crc32((f or "").encode()) for f in names]), k)


class _Part:
    """The readings of one batch of whole parts, column by column."""

    def __init__(self, pdf: pd.DataFrame):
        name = _names(pdf["filter_name"])
        repeated = np.diff(_starts(pdf["object_id"].to_numpy(), name, pdf["image_id"].to_numpy()), prepend=-1) == 0
        self.pdf, self.name = pdf[~repeated], name[~repeated]
        jd = self.pdf["jd"].to_numpy(float)
        self.hour = np.floor(np.nan_to_num(jd - np.floor(jd)) * 24).astype(np.int64)

    def of(self, col: str):
        v = self.pdf[col].to_numpy(float)
        have = ~np.isnan(v)
        obj, night, flt = self.pdf["object_id"].to_numpy()[have], self.pdf["night"].to_numpy()[have], self.name[have]
        return have, v[have], self.pdf["fit"].to_numpy(float)[have], self.hour[have], _starts(obj, flt, night), _starts(obj, flt)


def _whole_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Batches that end where a part ends."""
    kept: list[pd.DataFrame] = []
    for pdf in batches:
        if pdf.empty:
            continue
        keys = pdf["object_id"].to_numpy(), _names(pdf["filter_name"]), pdf["part"].to_numpy()
        begin = int(np.searchsorted(part := _starts(*keys), part[-1]))
        if kept and last != tuple(k[0] for k in keys):
            yield pd.concat(kept)
            kept = []
        if begin:
            yield pd.concat([*kept, pdf.iloc[:begin]])
            kept = []
        kept.append(pdf.iloc[begin:])
        last = tuple(k[-1] for k in keys)
    if kept:
        yield pd.concat(kept)


def _work(columns: list[str]):
    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_parts(batches):
            part, out = _Part(pdf), []
            for k, col in enumerate(columns):
                have, v, fit, hour, night, source = part.of(col)
                if not have.any():
                    continue
                at = part.pdf[have]
                obj, name = at["object_id"].to_numpy(), part.name[have]
                first = np.flatnonzero(np.diff(source, prepend=-1))
                got = score_sources(v, fit, hour, night, source, _seeds(obj[first], name[first], k), at["image_id"].to_numpy())
                out.append(pd.DataFrame({"image_id": at["image_id"].to_numpy(), "object_id": obj, "filter_name": at["filter_name"].to_numpy(), "field_name": col, "value": v, **got}))
            if out:
                yield pd.concat(out)

    return work


#: Columns of the features in tables: those of the night, and the seasonal one.
X, SEASON = [f"x{i}" for i in range(len(FEATURES))], "season"

RULES = "impossible boolean, stuck boolean, confirmed boolean, ok boolean"
FEATURED = f"source int, chunks int, image_id int, object_id long, filter_name string, field int, hour int, value double, {', '.join(f'{x} double' for x in X)}, {RULES}"
WALKED = f"source int, field int, image_id int, object_id long, filter_name string, value double, score double, {RULES}"


def _columns(schema: str) -> list[str]:
    return [c.split()[0] for c in schema.split(", ")]


def _featured(columns: list[str]):
    """The features of the readings of whole nights."""

    def work(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in _whole_parts(batches):
            part = _Part(pdf)
            for k, col in enumerate(columns):
                have, v, fit, hour, night, _ = part.of(col)
                if have.any():
                    got = night_features(v, fit, night)
                    at = part.pdf.loc[have, ["source", "chunks", "image_id", "object_id", "filter_name"]]
                    yield at.assign(field=k, hour=hour, value=v, **dict(zip(X, got.pop("x").T, strict=True)), **got)[_columns(FEATURED)]

    return work


def _drawn(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """The readings that a tree of their source learns from."""
    for pdf in batches:
        rows, size = (pdf[c].to_numpy()[:, None] for c in ("image_id", "size"))
        yield pdf[_draws(rows, np.arange(TREES), size).any(axis=1)]


def _walked(drawn: pd.DataFrame, pdf: pd.DataFrame) -> pd.DataFrame:
    """The scores of a chunk of the readings of one source, by the forest of its drawn readings."""
    score = np.zeros(0)
    if len(pdf):
        x = np.concatenate([t[[*X, SEASON]].to_numpy(float) for t in (drawn, pdf)])
        rows = np.concatenate([t["image_id"].to_numpy(np.int64) for t in (drawn, pdf)])
        seed = _seeds(pdf["object_id"].to_numpy()[:1], _names(pdf["filter_name"])[:1], int(pdf["field"].iloc[0]))
        score = forest_scores(x, np.zeros(len(x), np.int64), seed, rows, np.arange(len(x)) < len(drawn), pdf["size"].to_numpy()[:1])[len(drawn) :]
    return pdf.assign(score=score)[_columns(WALKED)]


def _medians(df: DataFrame, keys: list[str], column: str, name: str, *, few: bool = True) -> DataFrame:
    """``keys``, size, ``name``: exact medians of a column of finite values, for groups of any size.

    Counts in cells of the axis tell where the middle ranks are; only the values of these cells are put in order. The cells of
    ``few`` groups are broadcast, so no value is moved that is in none of them."""
    group = Window.partitionBy(*keys)
    v = df.select(*keys, F.col(column).alias("v"), F.floor(F.col(column) * CELLS).alias("cell"))
    counts = v.groupBy(*keys, "cell").agg(F.count("*").alias("n"))
    ranked = counts.select(*keys, "cell", "n", F.sum("n").over(group.orderBy("cell")).alias("seen"), F.sum("n").over(group).alias("size"))
    middle = ranked.where("seen > (size - 1) div 2 AND seen - n <= size div 2").select(*keys, "cell", "size", (F.col("seen") - F.col("n")).alias("below"))
    values = v.join(F.broadcast(middle) if few else middle, [*keys, "cell"]).groupBy(*keys, "size", "v").agg(F.count("*").alias("n"), F.min("below").alias("below"))
    seen = F.min("below").over(group) + F.sum("n").over(group.orderBy("v"))
    low, high = (F.min(F.when(F.col("seen") > F.expr(rank), F.col("v"))) for rank in ("(size - 1) div 2", "size div 2"))
    return values.select(*keys, "size", "v", seen.alias("seen")).groupBy(*keys, "size").agg(((low + high) / 2).alias(name))


def _score_plentiful(timed: DataFrame, columns: list[str], keys: list[str], order: list, *, few: bool) -> DataFrame:
    """``SCORED`` of the sources that are too large for one part, number by number as ``score_sources`` has them."""
    laid = timed.withColumn("part", F.col("night")).repartition(*keys, "part").sortWithinPartitions(*keys, "part", *order)
    featured = cut(laid.mapInPandas(_featured(columns), FEATURED))
    one = ["source", "field"]
    hours = _medians(featured.where("ok"), [*one, "hour"], "value", "usual", few=few).groupBy(*one).agg(F.map_from_entries(F.collect_list(F.struct("hour", "usual"))).alias("usual"))
    off = featured.join(F.broadcast(hours), one, "left").withColumn("off", F.col("value") - F.try_element_at("usual", F.col("hour"))).drop("usual")
    spreads = _medians(off.where("ok").withColumn("far", F.abs("off")), one, "far", "spread")
    season = F.least(F.greatest(F.col("off") / F.greatest(1.4826 * F.col("spread"), F.lit(FLOOR)), F.lit(-1e6)), F.lit(1e6))
    chunk = F.pmod(F.xxhash64("image_id"), F.col("chunks"))
    ready = off.join(F.broadcast(spreads), one, "left").withColumns({SEASON: F.when(F.col("off").isNull(), 0.0).otherwise(season), "size": F.coalesce("size", F.lit(0)), "chunk": chunk})
    learned = ready.where("ok").select(*one, "chunks", "image_id", "size", *X, SEASON)
    drawn = learned.mapInPandas(_drawn, learned.schema).withColumn("chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.col("chunks") - F.lit(1).cast("long"))))
    part = [*one, "chunk"]
    scored = cut(drawn.groupBy(*part).cogroup(ready.groupBy(*part)).applyInPandas(_walked, WALKED))
    middles = F.broadcast(_medians(scored.where("ok"), one, "score", "middle").drop("size"))
    placed = scored.join(middles, one, "left")
    bounds = _medians(placed.where("ok").withColumn("far", F.abs(F.col("score") - F.col("middle"))), one, "far", "spread").drop("size")
    outstanding = F.coalesce(F.col("score") >= F.col("middle") + OUTSTANDING * (1.4826 * F.col("spread")), F.lit(False))
    field = F.element_at(F.array(*map(F.lit, columns)), F.col("field") + 1)
    return placed.join(F.broadcast(bounds), one, "left").select("image_id", "object_id", "filter_name", field.alias("field_name"), "value", "score", "impossible", "stuck", (outstanding & F.col("confirmed")).alias("spike"))


def score_readings(photometry: DataFrame, frames: DataFrame, columns: tuple[str, ...] = ("mag_cali_trans", "mag_cali_no_trans"), instrument: str = "mags_fit", *, plenty: int = PLENTY) -> DataFrame:
    """One row for each non-null reading of each of ``columns``: its score and which rules it breaks (``SCORED``)."""
    any_value = F.coalesce(*columns).isNotNull()
    rows = photometry.where(any_value & F.col("object_id").isNotNull() & F.col("image_id").isNotNull()).select("image_id", "object_id", "filter_name", F.col(instrument).alias("fit"), *columns)
    # A table of n readings has fewer than MOST_PLENTIFUL sources of more than n / MOST_PLENTIFUL: the keys are a bounded list.
    counts = rows.groupBy("object_id", "filter_name").agg(F.count("*").alias("readings"))
    bound = max(plenty, (rows.count() // MOST_PLENTIFUL))
    plentiful = counts.where(F.col("readings") > bound).collect()
    keys = ["object_id", "filter_name"]
    order = ["night", "jd", "image_id", *(F.col(c).asc_nulls_last() for c in (*columns, "fit"))]
    # Without a time, each image is its own night: only the limits can speak.
    night = F.coalesce(F.floor("jd"), -F.col("image_id").cast("long")).cast("long")

    def timed(rows: DataFrame) -> DataFrame:
        return rows.join(image_times(frames), "image_id", "left").withColumn("night", night)

    if plentiful:
        known = photometry.sparkSession.createDataFrame([(k, -(-r["readings"] // max(1, bound)), r["object_id"], r["filter_name"]) for k, r in enumerate(plentiful)], "source int, chunks int, _o long, _f string")
        rows = rows.join(F.broadcast(known), F.col("object_id").eqNullSafe(F.col("_o")) & F.col("filter_name").eqNullSafe(F.col("_f")), "left").drop("_o", "_f")
        large = _score_plentiful(timed(rows.where("source IS NOT NULL")), list(columns), keys, order, few=len(plentiful) <= FEW)
        rows = rows.where("source IS NULL").drop("source", "chunks")
    laid = timed(rows).withColumn("part", F.lit(0).cast("long")).repartition(*keys).sortWithinPartitions(*keys, *order)
    scored = laid.mapInPandas(_work(list(columns)), SCORED)
    return scored.union(large) if plentiful else scored


def spikes_found(photometry: DataFrame, frames: DataFrame) -> DataFrame:
    """image_id, object_id, field_name of every implausible reading."""
    scored = score_readings(photometry, frames)
    return scored.where("impossible OR stuck OR spike").select("image_id", "object_id", "field_name")
