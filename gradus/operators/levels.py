"""Equipment levels: count points per group, cluster the counts in 1-D, join the level back.

The counts are clustered on ``log1p(count)``, scaled to mean 0 and deviation 1. In one
dimension the best clusters are intervals, so a clustering is k-1 cut counts. They are found
exactly, for all wanted k together:

* Spark sums n, x, x^2 of the groups per slice of counts (a fixed number of slices; every
  count up to 512 has its own).
* A dynamic programme over the slice sums gives the best cuts at slice edges, an upper bound
  for the error. A second one, which leaves the cut slices out, gives a lower bound for a cut
  inside a slice. Slices that could still beat the upper bound are split and summed again.
* When none is left the cuts are the optimum over all groups.

So the driver sees slice sums only, whatever the number of rows, groups or distinct counts.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from multiprocessing.pool import ThreadPool

import numpy as np
from pyspark.ml.clustering import KMeans
from pyspark.ml.feature import Bucketizer, VectorAssembler
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus import schema as S
from gradus.operators.groups import group_sizes
from gradus.session import write_out

SIZE = "nombre_pdc_commune"
OWN_SLICE = 512          # counts up to here have a slice of their own in the first round
SLICES_PER_DOUBLING = 10  # width of the first-round slices above
SPLIT_BUDGET = 4096      # new slices per later round
GROUPS_TO_BROADCAST = 200_000
BROADCAST_BYTES = 32 << 20  # texts of the groups and their levels, at most, in a broadcast
PARALLEL_FITS = 5
SLICES = 64              # of the distinct sizes, for the silhouette's running sums
HOT_SHARE = 10_000       # a group above 1/10,000 of all points is hot: at most 10,000 groups are


@dataclass(frozen=True)
class Levels:
    """Clustering of group sizes into ordered levels.

    Level i holds the sizes above ``uppers[i-1]`` up to ``uppers[i]``; the last has no end.
    ``counts``, ``points`` and ``log_sums`` are groups, points and summed log1p per level.
    """

    k: int
    uppers: tuple[int, ...]
    inertia: float
    counts: tuple[int, ...]
    points: tuple[int, ...]
    log_sums: tuple[float, ...]

    def level(self, size: Column) -> Column:
        return _level(size, self.uppers)


def _level(size: Column, uppers: Sequence[int]) -> Column:
    out = F.lit(0)
    for upper in uppers:
        out = out + F.when(size > upper, 1).otherwise(0)
    return F.when(size.isNotNull(), out).cast("int")


class _Slices:
    """Sums per slice of sizes, in ascending order, with prefix sums for interval errors."""

    def __init__(self, rows):
        rows = sorted(rows)
        self.low = np.array([r[0] for r in rows], dtype=np.int64)
        self.high = np.array([r[1] for r in rows], dtype=np.int64)
        n = np.array([r[2] for r in rows], dtype=np.float64)
        points = np.array([float(r[5]) for r in rows])
        x = np.log1p(self.low)
        self.whole = self.low == self.high
        s = np.where(self.whole, n * x, [r[3] for r in rows])
        q = np.where(self.whole, n * x * x, [r[4] for r in rows])
        self.n, self.s, self.q, self.points = (
            np.concatenate([[0.0], np.cumsum(v)]) for v in (n, s, q, points)
        )

    def __len__(self):
        return len(self.low)

    def error(self, a, b):
        """Squared error of slices a..b-1 around their mean; 0 for none."""
        n = self.n[b] - self.n[a]
        s = self.s[b] - self.s[a]
        q = self.q[b] - self.q[a]
        return np.where(n > 0, np.maximum(q - s * s / np.where(n > 0, n, 1.0), 0.0), 0.0)

    def best_at_edges(self, kmax):
        """cost[j][b]: least error of slices 0..b-1 in j clusters; start[j][b]: the last cut."""
        m = len(self)
        cost = np.full((kmax + 1, m + 1), np.inf)
        start = np.zeros((kmax + 1, m + 1), dtype=np.int64)
        cost[1, 1:] = self.error(np.zeros(m, dtype=np.int64), np.arange(1, m + 1))
        for j in range(2, kmax + 1):
            for b in range(j, m + 1):
                a = np.arange(j - 1, b)
                total = cost[j - 1, a] + self.error(a, b)
                at = int(np.argmin(total))
                cost[j, b], start[j, b] = total[at], a[at]
        return cost, start

    def bound_left(self, kmax):
        """bound[j][b]: no j clusters that end inside slice b cost less on slices before b."""
        m = len(self)
        bound = np.zeros((kmax, m))
        bound[1] = self.error(np.zeros(m, dtype=np.int64), np.arange(m))
        for j in range(2, kmax):
            for b in range(m):
                a = np.arange(b + 1)
                bound[j, b] = np.min(bound[j - 1, a] + self.error(np.minimum(a + 1, b), b))
        return bound

    def bound_right(self, kmax):
        """The same for slices after b, in j clusters that start inside slice b."""
        m = len(self)
        bound = np.zeros((kmax, m))
        bound[1] = self.error(np.arange(1, m + 1), m)
        for j in range(2, kmax):
            for b in range(m):
                a = np.arange(b, m)
                bound[j, b] = np.min(bound[j - 1, a] + self.error(b + 1, np.maximum(a, b + 1)))
        return bound

    def open_slices(self, best):
        """Slices of several sizes in which a cut may lie that beats ``best`` (k -> error)."""
        mask = np.zeros(len(self), dtype=bool)
        if not best:
            return mask
        left, right = self.bound_left(max(best)), self.bound_right(max(best))
        for k, error in best.items():
            limit = error * (1 + 1e-9)
            for j in range(1, k):
                mask |= left[j] + right[k - j] <= limit
        return mask & ~self.whole


def _slice_sums(sizes: DataFrame, slice_id: Column, size: str) -> list:
    x = F.log1p(F.col(size).cast("double"))
    return (
        sizes.groupBy(slice_id.alias("slice"))
        .agg(
            F.min(size).alias("low"), F.max(size).alias("high"),
            F.count(F.lit(1)).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("q"),
            F.sum(size).alias("points"),
        )
        .select("low", "high", "n", "s", "q", "points").collect()
    )


def fit_levels(
    sizes: DataFrame, ks: Sequence[int] = (3,), size: str = SIZE,
    own_slice: int = OWN_SLICE, per_doubling: int = SLICES_PER_DOUBLING,
    split_budget: int = SPLIT_BUDGET,
) -> dict[int, Levels]:
    """Exact 1-D k-means of the group sizes for every k in ``ks``.

    ``sizes`` has one row per group. Fewer distinct sizes than k give as many levels as
    there are sizes. Sum the sizes from a written table where the groups are costly.
    """
    value = F.col(size)
    first = F.when(value <= own_slice, value.cast("double")).otherwise(
        own_slice + 1 + F.floor((F.log2(value.cast("double")) - F.log2(F.lit(float(own_slice)))) * per_doubling)
    )
    rows = [tuple(r) for r in _slice_sums(sizes, first, size)]
    if not rows:
        raise ValueError("no groups to cluster")
    while True:
        slices = _Slices(rows)
        kmax = min(max(ks), len(slices))
        cost, start = slices.best_at_edges(kmax)
        if slices.whole.all():
            break
        if kmax < max(ks):  # fewer slices than levels: look inside all of them
            opened = ~slices.whole
        else:
            opened = slices.open_slices({k: cost[k, len(slices)] for k in ks if k > 1})
        if not opened.any():
            break
        parts = max(2, split_budget // int(opened.sum()))
        lows = set()
        for low, high, split in zip(slices.low, slices.high, opened):
            lows.add(int(low))
            if split:
                width = int(high) - int(low) + 1
                step = -(-width // min(parts, width))
                lows.update(range(int(low), int(high) + 1, step))
        splits = [float("-inf"), *map(float, sorted(lows)[1:]), float("inf")]
        cut = Bucketizer(splits=splits, inputCol="size_value", outputCol="slice_id").transform(
            sizes.select(size, value.cast("double").alias("size_value"))
        )
        rows = [tuple(r) for r in _slice_sums(cut, F.col("slice_id"), size)]
    return {k: _levels(slices, cost, start, min(k, kmax)) for k in ks}


def _levels(slices: _Slices, cost, start, k: int) -> Levels:
    edges = [len(slices)]
    for j in range(k, 0, -1):
        edges.append(int(start[j, edges[-1]]) if j > 1 else 0)
    edges = edges[::-1]
    n, s, q = slices.n[-1], slices.s[-1], slices.q[-1]
    variance = q / n - (s / n) ** 2
    scale = variance if variance > 1e-12 else 1.0
    parts = list(zip(edges[:-1], edges[1:]))
    return Levels(
        k=k,
        uppers=tuple(int(slices.high[b - 1]) for _, b in parts[:-1]),
        inertia=float(cost[k, len(slices)] / scale),
        counts=tuple(int(slices.n[b] - slices.n[a]) for a, b in parts),
        points=tuple(int(slices.points[b] - slices.points[a]) for a, b in parts),
        log_sums=tuple(float(slices.s[b] - slices.s[a]) for a, b in parts),
    )


def label_groups(sizes: DataFrame, levels: Levels, size: str = SIZE) -> DataFrame:
    """Level beside each group size; a narrow expression, no join."""
    return sizes.withColumn(S.TARGET, levels.level(F.col(size)))


def _bytes(groups: DataFrame, group: str) -> int:
    return groups.agg(F.sum(F.octet_length(F.col(group).cast("string")) + 16)).first()[0] or 0


def join_labels(
    points: DataFrame, groups: DataFrame, group: str = S.GROUP, n_groups: int | None = None,
    n_points: int | None = None, how: str = "inner", size: str = SIZE,
    broadcast_limit: int = GROUPS_TO_BROADCAST, hot_share: int = HOT_SHARE,
) -> DataFrame:
    """Put the group's level on every point; ``groups`` is unique per group.

    ``inner`` drops points without a labelled group, ``left`` keeps them with NULL. Few
    groups are broadcast. Beyond ``broadcast_limit`` the groups that hold more than
    1/``hot_share`` of all points - there cannot be more than ``hot_share`` of them - are
    broadcast and their points spread over the shuffle instead of meeting in one task.
    """
    if n_groups is None or n_points is None:
        n_groups, n_points = groups.agg(F.count(F.lit(1)), F.sum(size)).first()
        n_points = n_points or 0
    labels = groups.select(group, S.TARGET)
    if n_groups <= broadcast_limit and _bytes(labels, group) <= BROADCAST_BYTES:
        joined = points.join(F.broadcast(labels), group, how)
        return joined.select(*points.columns, S.TARGET)  # the order of columns hangs on no size

    hot_from = max(n_points // hot_share, 1)
    hot = groups.filter(F.col(size) > hot_from).select(
        F.col(group).alias("hot_group"), F.col(S.TARGET).alias("hot_label")
    )
    cold = groups.filter(F.col(size) <= hot_from).select(
        F.col(group).cast("string").alias("cold_key"), F.col(S.TARGET).alias("cold_label")
    )
    matched = points.join(F.broadcast(hot), F.col(group) == F.col("hot_group"), "left")
    # Points of hot groups and points without a group find nothing in the shuffle join. They
    # get a key of their own there, a hash of the whole row: it spreads them over all tasks,
    # and a retried task that reads the same row builds the same key.
    is_cold = F.col("hot_group").isNull() & F.col(group).isNotNull()
    spread = F.concat(F.lit("\0"), F.xxhash64(*[F.col(c) for c in points.columns]).cast("string"))
    matched = matched.withColumns({
        "is_cold": is_cold,
        "join_key": F.when(is_cold, F.col(group).cast("string")).otherwise(spread),
    })
    joined = matched.join(cold, F.col("join_key") == F.col("cold_key"), "left")
    label = F.coalesce("hot_label", F.when(F.col("is_cold"), F.col("cold_label")))
    out = joined.select(*points.columns, label.alias(S.TARGET))
    return out.filter(F.col(S.TARGET).isNotNull()) if how == "inner" else out


def label_points(points: DataFrame, group: str = S.GROUP, k: int = 3) -> DataFrame:
    """The whole labelling step: sizes, exact levels, level on every point with a group.

    The sizes are written once to the shared folder: the fit and the join read that table.
    """
    sizes = write_out(group_sizes(points, group), "sizes")
    levels = fit_levels(sizes, (k,))[k]
    return join_labels(
        points, label_groups(sizes, levels), group,
        n_groups=sum(levels.counts), n_points=sum(levels.points),
    )


def level_summary(groups: DataFrame, size: str = SIZE) -> DataFrame:
    """Per level: groups, points, mean and largest size."""
    return groups.groupBy(S.TARGET).agg(
        F.count(F.lit(1)).alias("n_groups"),
        F.sum(size).cast("bigint").alias("n_points"),
        F.avg(size).alias("mean_points"),
        F.max(size).alias("max_points"),
    )


def rank_clusters(df: DataFrame, cluster: str, value: str) -> DataFrame:
    """Rename arbitrary cluster ids to ranks 0.. by ascending mean of ``value``.

    The window runs over one row per cluster, and that table is what is broadcast.
    """
    ranks = (
        df.groupBy(cluster).agg(F.avg(value).alias("mean_value"))
        .withColumn(
            S.TARGET,
            (F.row_number().over(Window.orderBy("mean_value", cluster)) - 1).cast("int"),
        )
    )
    return df.join(F.broadcast(ranks.select(cluster, S.TARGET)), cluster)


def histogram_of_sizes(sizes: DataFrame, size: str = SIZE) -> DataFrame:
    """Groups per distinct size. N points have at most sqrt(2N) distinct group sizes."""
    return sizes.groupBy(F.col(size).alias("size")).agg(F.count(F.lit(1)).alias("n"))


def kmeans_labels(
    sizes: DataFrame, k: int = 3, n_init: int = 10, seed: int = 42, size: str = SIZE,
) -> tuple[DataFrame, float]:
    """MLlib k-means on the scaled log sizes: best of ``n_init`` seeds, ids ranked by mean.

    It fits on the distinct sizes, weighted by their number of groups, and returns the labelled
    groups and the cost.
    """
    hist = write_out(histogram_of_sizes(sizes, size), "size-histogram")
    x = F.log1p(F.col("size").cast("double"))
    n, s, q = hist.agg(F.sum("n"), F.sum(x * F.col("n")), F.sum(x * x * F.col("n"))).first()
    mean, variance = s / n, q / n - (s / n) ** 2
    deviation = variance ** 0.5 if variance > 1e-12 else 1.0
    scaled = VectorAssembler(inputCols=["z"], outputCol="features").transform(
        hist.withColumn("z", (x - mean) / deviation)
    ).persist()
    try:
        estimator = KMeans(k=k, weightCol="n", maxIter=300, tol=1e-4)
        tries = estimator.fitMultiple(scaled, [{estimator.seed: seed + i} for i in range(n_init)])
        with ThreadPool(min(n_init, PARALLEL_FITS)) as pool:
            fits = dict(pool.map(lambda _: next(tries), range(n_init)))
        best = min((fits[i] for i in sorted(fits)), key=lambda m: m.summary.trainingCost)
        cost = best.summary.trainingCost
        clusters = (
            best.transform(scaled).groupBy("prediction")
            .agg((F.sum(F.col("size") * F.col("n")) / F.sum("n")).alias("mean"), F.max("size").alias("upper"))
            .orderBy("mean").collect()
        )
    finally:
        scaled.unpersist()
    # Each value went to its nearest centre, so in one dimension the clusters are intervals.
    labels = _level(F.col(size), [r["upper"] for r in clusters[:-1]])
    return sizes.withColumn(S.TARGET, labels), cost


def elbow(sizes: DataFrame, ks: Sequence[int] = tuple(range(2, 9)), size: str = SIZE) -> DataFrame:
    """Exact inertia per k, from one fit for all k."""
    fits = fit_levels(sizes, ks, size)
    return sizes.sparkSession.createDataFrame(
        [(k, fits[k].inertia) for k in ks], "k int, inertia double"
    )


def _slice(hist: DataFrame, size: Column) -> Column:
    """Number of the slice of the distinct sizes that a size is in; slices are in order."""
    ranks = [i / SLICES for i in range(1, SLICES)]
    edges = hist.agg(F.percentile_approx("size", ranks, 20 * SLICES)).first()[0] or []
    listed = F.array(*[F.lit(e) for e in sorted(set(edges))]).cast("array<bigint>")
    return F.size(F.filter(listed, lambda e: e < size))


def silhouette(sizes: DataFrame, ks: Sequence[int] = tuple(range(2, 9)), size: str = SIZE) -> DataFrame:
    """Euclidean silhouette per k, without comparing pairs.

    Clusters are intervals, so the summed distance of a value to its own cluster follows
    from running sums (over slices of the sizes, then inside them), and the mean distance to another cluster is the distance to its mean;
    only the two neighbouring clusters can be nearest.
    """
    fits = {k: f for k, f in fit_levels(sizes, ks, size).items() if f.k > 1}
    hist = write_out(histogram_of_sizes(sizes, size), "size-histogram")
    x = F.log1p(F.col("size").cast("double"))

    def per_level(fit: Levels):
        means = [s / n for s, n in zip(fit.log_sums, fit.counts)]
        return F.struct(
            F.lit(fit.k).alias("k"),
            fit.level(F.col("size")).alias("level"),
            F.array(*map(F.lit, fit.counts)).alias("counts"),
            F.array(*map(F.lit, fit.log_sums)).alias("sums"),
            F.array(*map(F.lit, means)).alias("means"),
        )

    rows = (
        hist.select("size", "n", x.alias("x"), F.explode(F.array(*map(per_level, fits.values()))).alias("f"))
        .select("size", "n", "x", "f.*")
    )
    rows = rows.withColumn("slice", _slice(hist, F.col("size")))
    n_all, s_all = F.get("counts", F.col("level")), F.get("sums", F.col("level"))
    weighted = F.col("x") * F.col("n")
    # Running sums: those of the slices before (a few dozen rows), then inside a slice.
    before = Window.partitionBy("k", "level").orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)
    earlier = rows.groupBy("k", "level", "slice").agg(F.sum("n").alias("n"), F.sum(weighted).alias("s")).select(
        "k", "level", "slice",
        F.coalesce(F.sum("n").over(before), F.lit(0)).alias("n_before"),
        F.coalesce(F.sum("s").over(before), F.lit(0.0)).alias("s_before"),
    )
    upto = Window.partitionBy("k", "level", "slice").orderBy("size").rowsBetween(
        Window.unboundedPreceding, Window.currentRow
    )
    running = rows.join(F.broadcast(earlier), ["k", "level", "slice"]).withColumns({
        "n_to": F.col("n_before") + F.sum("n").over(upto),
        "s_to": F.col("s_before") + F.sum(weighted).over(upto),
    })
    own_sum = (
        F.col("x") * F.col("n_to") - F.col("s_to")
        + (s_all - F.col("s_to")) - F.col("x") * (n_all - F.col("n_to"))
    )
    below = F.abs(F.col("x") - F.get("means", F.col("level") - 1))
    above = F.abs(F.col("x") - F.get("means", F.col("level") + 1))
    near = F.least(below, above)  # least() skips the missing neighbour of an outer level
    own = F.greatest(own_sum, F.lit(0.0)) / F.when(n_all > 1, n_all - 1)
    score = F.when(n_all > 1, (near - own) / F.greatest(near, own)).otherwise(0.0)
    return (
        running.withColumn("score", F.coalesce(score, F.lit(0.0))).groupBy("k")
        .agg((F.sum(F.col("score") * F.col("n")) / F.sum("n")).alias("silhouette"))
    )


def standardize(df: DataFrame, columns: Sequence[str], suffix: str = "_z") -> DataFrame:
    """Population z-score of each column beside it; a constant column becomes 0.

    Means and deviations come from one scalar subquery, not from a join.
    """
    stats = df.agg(
        F.struct(
            *[F.avg(c).alias(f"{c}_mean") for c in columns],
            *[F.stddev_pop(c).alias(f"{c}_sd") for c in columns],
        )
    ).scalar()
    out = df.withColumn("scale_stats", stats)
    scaled = {}
    for c in columns:
        sd = F.col(f"scale_stats.{c}_sd")
        scaled[f"{c}{suffix}"] = (F.col(c) - F.col(f"scale_stats.{c}_mean")) / F.when(
            sd == 0, 1.0
        ).otherwise(sd)
    return out.withColumns(scaled).drop("scale_stats")
