"""Exact k-nearest-neighbour join and vote.

Neighbours are ordered by squared Euclidean distance (rounded, so that the order does not hang
on the last bits of a sum) and then by id. Of equal training vectors only the k with the
smallest ids can ever be neighbours, so a vector that fills a third of the table shrinks to
k rows before anything else happens.

* Few training vectors (counted first, at most ``broadcast_bytes``): they are broadcast as one
  matrix and each query row is answered where it lies.
* More: training vectors are assigned to the nearest of some pivots, whose number grows with them, and
  every cell is cut into rings by the distance to its pivot. A query row first meets one block of
  the ring that it would lie in itself, which gives a true distance of k neighbours. With that radius
  it goes to the rings it can't rule out, by the ring's inner and outer gap and by the plane
  between two pivots, and to no other. A dense ring is cut into blocks by id hash, and so are many
  query rows of one ring. A block of bounded size is compared inside one task, which emits at most k
  rows per query row; a last shuffle keeps the best k over all blocks. A worker holds the
  pivots, a row for each ring, and distances of a million (row, pivot) pairs at a time.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from gradus.session import write_out

BROADCAST_BYTES = 8 << 20
BLOCK_ROWS = 20_000
PIVOTS, MOST_PIVOTS = 256, 4096
RINGS = 32  # rings of a cell at most
PAIRS = 1_000_000  # (row, pivot) pairs of a worker at a time: 8 MB an array
EMIT = 10_000  # routed rows that a worker makes at a time
DIGITS = 9
SAMPLE = 2048  # points from which a block's search radius is taken

_OUT = "query_id {q}, rank int, train_id {t}, dist2 double, label int"


def _searcher(k, digits=DIGITS, sample=SAMPLE):
    """Function (queries, points, ids) -> blocks of (query index, rank, point index, distance).

    A matrix product finds candidates; its rounding is covered by a margin, and the
    candidates are measured again coordinate by coordinate. Being local to this function it
    travels to the executors inside the job itself.
    """

    def search(queries, points, ids):
        import numpy as np

        id_rank = np.unique(ids, return_inverse=True)[1]
        norms = np.einsum("ij,ij->i", points, points)
        # |q|^2 + |p|^2 - 2 q.p as one product of widened matrices.
        wide = np.vstack([points.T, np.ones(len(points)), norms])
        step = max(1, 1_000_000 // len(points))
        for a in range(0, len(queries), step):
            block = queries[a:a + step]
            own = np.einsum("ij,ij->i", block, block)
            near = np.hstack([-2.0 * block, own[:, None], np.ones((len(block), 1))]) @ wide
            if len(points) > k:
                # The k-th distance to some of the points bounds the k-th to all of them.
                some = near[:, ::max(1, len(points) // max(sample, 16 * k))]
                kth = np.partition(some, k - 1, axis=1)[:, k - 1]
                margin = 1e-9 * (1.0 + own + norms.max()) + 2 * 10.0 ** -digits
                rows, cols = np.nonzero(near <= (kth + margin)[:, None])
            else:
                rows, cols = np.nonzero(np.ones_like(near, dtype=bool))
            exact = np.round(((block[rows] - points[cols]) ** 2).sum(axis=1), digits)
            order = np.lexsort((id_rank[cols], exact, rows))
            rows, cols, exact = rows[order], cols[order], exact[order]
            rank = np.arange(len(rows)) - np.searchsorted(rows, rows) + 1
            keep = rank <= k
            yield rows[keep] + a, rank[keep], cols[keep], exact[keep]

    return search


def _vector(features: Sequence[str] | str) -> Column:
    """The features as one array; a missing value fails the job, no row is left out for it."""
    if isinstance(features, str):
        vec = F.col(features).cast("array<double>")
    else:
        vec = F.array(*[F.col(c).cast("double") for c in features])
    return F.when(complete(vec), vec).otherwise(F.raise_error(F.lit("a feature is missing")))


def complete(vec: Column) -> Column:
    """Whether a vector is there and has no missing value."""
    return vec.isNotNull() & F.forall(vec, lambda x: x.isNotNull() & ~F.isnan(x))


def only_useful(train: DataFrame, same: Sequence[str], train_id: str, k: int) -> DataFrame:
    """Of the rows that agree in the columns ``same``, the k with the smallest ids.

    No other row can be among k neighbours. The limit per group is applied before the shuffle.
    """
    by_id = Window.partitionBy(*same).orderBy(train_id)
    return train.withColumn("copy", F.row_number().over(by_id)).filter(F.col("copy") <= k).drop("copy")


def _sides(test, train, features, test_id, train_id, label):
    queries = test.select(F.col(test_id).alias("query_id"), _vector(features).alias("vec"))
    points = train.select(
        F.col(train_id).alias("train_id"), F.col(label).cast("int").alias("label"),
        _vector(features).alias("vec"),
    )
    return queries, points


def knn_join(
    test: DataFrame, train: DataFrame, features: Sequence[str] | str, test_id: str, train_id: str,
    label: str = "label", k: int = 7, broadcast_bytes: int = BROADCAST_BYTES,
    block_rows: int = BLOCK_ROWS, pivots: int | None = None, prepared: bool = False,
) -> DataFrame:
    """The k nearest training rows of each test row: query_id, rank, train_id, dist2, label.

    ``features`` is a list of numeric columns or one array column; a missing value fails the
    job. Every test row has its k neighbours, also where its id repeats or is NULL.
    ``prepared`` says that ``train`` is a written table that went through ``only_useful``.
    """
    queries, points = _sides(test, train, features, test_id, train_id, label)
    first = train.select(F.size(_vector(features))).first()
    if first is None:
        raise ValueError("no training rows")
    width = first[0]
    room = broadcast_bytes // (8 * (width + 2))
    if not prepared:
        points = write_out(only_useful(points, ["vec"], "train_id", k), "knn-points")
    n_points = points.count()
    few = n_points <= room
    out = _OUT.format(
        q=queries.schema["query_id"].dataType.simpleString(),
        t=points.schema["train_id"].dataType.simpleString(),
    )
    if few:
        return _broadcast_join(queries, points.toPandas(), k, out)
    if pivots is None:  # about as many cells as rows in a cell, while their matrix stays small
        pivots = min(MOST_PIVOTS, max(PIVOTS, math.isqrt(n_points)))
    found = _partitioned_join(queries, points, k, f"query_key bigint, {out}", block_rows, pivots)
    best = Window.partitionBy("query_key").orderBy("dist2", "train_id")
    return found.withColumn("rank", F.row_number().over(best)).filter(F.col("rank") <= k).select(
        "query_id", "rank", "train_id", "dist2", "label"
    )


def _broadcast_join(queries: DataFrame, local, k: int, out: str) -> DataFrame:
    import numpy as np

    shared = queries.sparkSession.sparkContext.broadcast(
        (np.array(local["vec"].tolist(), dtype=float), local["train_id"].to_numpy(),
         local["label"].to_numpy())
    )
    search = _searcher(k)

    def run(batches):
        import numpy as np
        import pandas as pd

        points, ids, labels = shared.value
        for batch in batches:
            if batch.empty:
                continue
            vectors = np.array(batch["vec"].tolist(), dtype=float)
            query_ids = batch["query_id"].to_numpy()
            for rows, rank, cols, dist in search(vectors, points, ids):
                yield pd.DataFrame(
                    {"query_id": query_ids[rows], "rank": rank, "train_id": ids[cols],
                     "dist2": dist, "label": labels[cols]}
                )

    # Comparing costs far more than moving a row: use all tasks also for a small query table.
    tasks = int(queries.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return queries.repartition(tasks, "query_id").mapInPandas(run, out)


def _row_blocks(n: int, width: int):
    """Slices of rows whose pairs with ``width`` pivots fit a worker."""
    step = max(1, PAIRS // max(1, width))
    return [slice(a, min(n, a + step)) for a in range(0, n, step)]


def _gaps(vectors, centres, middle):
    """Distances of rows to all pivots, and a bound for their rounding errors.

    Measured from the middle of the pivots, as a matrix product.
    """
    import numpy as np

    v, c = vectors - middle, centres - middle
    own, other = np.einsum("ij,ij->i", v, v), np.einsum("ij,ij->i", c, c)
    square = own[:, None] + other - 2.0 * (v @ c.T)
    return np.sqrt(np.maximum(square, 0.0)), 1e-7 * np.sqrt(own + other.max())


def _cells(points: DataFrame, centres, middle) -> DataFrame:
    """Points with the ``cell`` of their nearest pivot and the ``gap`` to it."""
    shared = points.sparkSession.sparkContext.broadcast((centres, middle))

    def assign(batches):
        import numpy as np

        pivots, origin = shared.value
        for batch in batches:
            if batch.empty:
                continue
            vectors = np_array(batch["vec"])
            cell = np.concatenate([
                _gaps(vectors[part], pivots, origin)[0].argmin(axis=1)
                for part in _row_blocks(len(vectors), len(pivots))
            ])
            gap = np.sqrt(((vectors - pivots[cell]) ** 2).sum(axis=1))
            yield batch.assign(cell=cell.astype("int32"), gap=gap)

    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in points.schema.fields)
    return points.mapInPandas(assign, f"{fields}, cell int, gap double")


def _rings(placed: DataFrame, block_rows: int) -> tuple[DataFrame, DataFrame]:
    """Points with their ``ring`` and ``block``, and a row for each ring: rows, blocks, gaps.

    The rings of a cell have about as many rows each; what a ring has beyond ``block_rows`` is cut
    into blocks by a hash of the id.
    """
    ranks = [i / RINGS for i in range(1, RINGS)]
    edges = placed.groupBy("cell").agg(
        F.count(F.lit(1)).alias("n"), F.percentile_approx("gap", ranks, 10 * RINGS).alias("edges")
    )
    wanted = F.least(F.lit(RINGS), F.ceil(F.col("n") / block_rows)).cast("int")
    # Every (RINGS / wanted)-th edge.
    kept = F.transform(
        F.sequence(F.lit(1), wanted - 1), lambda i: F.col("edges")[F.floor(i * RINGS / wanted).cast("int") - 1]
    )
    cuts = edges.select("cell", F.when(wanted > 1, kept).otherwise(F.array().cast("array<double>")).alias("cuts"))
    ring = F.size(F.filter("cuts", lambda x: x < F.col("gap")))
    ringed = write_out(placed.join(cuts, "cell").withColumn("ring", ring).drop("cuts"), "knn-rings")
    stats = ringed.groupBy("cell", "ring").agg(
        F.count(F.lit(1)).alias("n"), F.min("gap").alias("inner"), F.max("gap").alias("outer")
    )
    stats = write_out(stats.withColumn("blocks", F.ceil(F.col("n") / block_rows).cast("int")), "knn-ring-stats")
    blocks = stats.select("cell", "ring", "blocks")
    block = F.pmod(F.xxhash64("train_id"), F.col("blocks")).cast("int")
    return ringed.join(blocks, ["cell", "ring"]).withColumn("block", block).drop("blocks", "gap"), stats


def _meet(left: DataFrame, right: DataFrame, k: int, block_rows: int, out: str, row_of) -> DataFrame:
    """Query rows (with cell, ring, block) compared with the points of their block.

    Many query rows of one block are cut by a hash of their key, and the block's points are
    copied for each part. ``row_of`` makes the result from a task's query rows and findings.
    """
    keys = ["cell", "ring", "block"]
    visits = left.groupBy(*keys).agg(F.ceil(F.count(F.lit(1)) / block_rows).cast("int").alias("parts"))
    visits = write_out(visits, "knn-visits")
    many = visits.filter("parts > 1")
    part = F.pmod(F.xxhash64("query_key"), F.coalesce("parts", F.lit(1))).cast("int")
    left = left.join(many, keys, "left").withColumn("part", part).drop("parts")
    copies = F.explode(F.sequence(F.lit(0), F.col("parts") - 1))
    right = right.join(visits, keys).withColumn("part", copies).drop("parts")
    search = _searcher(k)

    def compare(queries_pdf, points_pdf):
        if not len(queries_pdf):
            return row_of(queries_pdf, points_pdf, [])
        found = []
        if len(points_pdf):
            found = list(search(np_array(queries_pdf["vec"]), np_array(points_pdf["vec"]), points_pdf["train_id"].to_numpy()))
        return row_of(queries_pdf, points_pdf, found)

    return left.groupBy(*keys, "part").cogroup(right.groupBy(*keys, "part")).applyInPandas(compare, out)


def _found_rows(queries_pdf, points_pdf, found):
    """A row for each finding."""
    import pandas as pd

    parts = [
        queries_pdf[["query_key", "query_id"]].iloc[rows].reset_index(drop=True).assign(
            rank=rank, train_id=points_pdf["train_id"].to_numpy()[cols], dist2=dist,
            label=points_pdf["label"].to_numpy()[cols],
        )
        for rows, rank, cols, dist in found
    ]
    empty = pd.DataFrame({c: [] for c in ("query_key", "query_id", "rank", "train_id", "dist2", "label")})
    return pd.concat(parts) if parts else empty


def _partitioned_join(queries, points, k, out, block_rows, pivots) -> DataFrame:
    import numpy as np
    import pandas as pd

    spark = queries.sparkSession
    queries = write_out(queries.withColumn("query_key", F.monotonically_increasing_id()), "knn-queries")
    chosen = points.orderBy(F.md5(F.col("train_id").cast("string").cast("binary")), "train_id")
    picked = [r[0] for r in chosen.select("vec").limit(pivots).collect()]
    centres = np.unique(np.array(picked, dtype=float), axis=0)
    middle = centres.mean(axis=0)
    placed = write_out(_cells(points, centres, middle), "knn-cells")
    blocked, stats = _rings(placed, block_rows)
    blocked = write_out(blocked, "knn-blocks")
    # A row for each ring: at most the rows over ``block_rows``, and one more for each cell.
    rings = stats.orderBy("cell", "ring").toPandas()
    cell_at = np.unique(rings["cell"].to_numpy(), return_index=True)
    shared = spark.sparkContext.broadcast((centres, middle, rings, *cell_at))

    def near(vectors):
        """Distances to all pivots, their rounding errors, and distances to the pivots with a cell."""
        pivots_, middle_, _, used, _ = shared.value
        every, slack = _gaps(vectors, pivots_, middle_)
        return every, slack, every[:, used]

    def spread(cells_of_rows, starts, total):
        """All (row, ring) pairs of (row, cell) pairs: positions of the pair and of the ring."""
        ends = np.append(starts[1:], total)
        count = ends[cells_of_rows] - starts[cells_of_rows]
        pair = np.repeat(np.arange(len(count)), count)
        first = np.repeat(np.cumsum(count) - count, count)
        return pair, starts[cells_of_rows][pair] + np.arange(len(pair)) - first

    def at_home(batches):
        _, _, table, _, starts = shared.value
        n, inner, outer = (table[c].to_numpy() for c in ("n", "inner", "outer"))
        for batch in batches:
            if batch.empty:
                continue
            vectors, picks = np_array(batch["vec"]), []
            for part in _row_blocks(len(vectors), len(shared.value[0])):
                gap = near(vectors[part])[2]
                home = gap.argmin(axis=1)
                row, ring = spread(home, starts, len(table))
                own = gap[np.arange(len(gap)), home][row]
                off = np.maximum(np.maximum(inner[ring] - own, own - outer[ring]), 0.0)
                # The nearest ring that has k rows in its first block, else the one with most rows.
                off = np.where(n[ring] >= 2 * k, off, 1e200 / n[ring])
                order = np.lexsort((off, row))
                picks.append(ring[order[np.flatnonzero(np.diff(row[order], prepend=-1))]])
            ring = np.concatenate(picks)
            yield batch.assign(
                cell=table["cell"].to_numpy()[ring], ring=table["ring"].to_numpy()[ring], block=np.int32(0)
            )

    def with_findings(queries_pdf, points_pdf, found):
        """A row for each query row, its findings as arrays."""
        rows = queries_pdf.drop(columns=["part", "block"]).reset_index(drop=True)
        held = [([], [], []) for _ in range(len(rows))]
        if found:
            ids, labels = points_pdf["train_id"].to_numpy(), points_pdf["label"].to_numpy()
            for at, _, cols, dist in found:
                for i, j, d in zip(at, cols, dist):
                    for into, value in zip(held[i], (ids[j], float(d), int(labels[j]))):
                        into.append(value)
        names = ("train_ids", "dists", "labels")
        return rows.assign(**{name: pd.Series([h[i] for h in held], dtype=object) for i, name in enumerate(names)})

    def onward(batches):
        _, _, table, _, starts = shared.value
        inner, outer, blocks = (table[c].to_numpy() for c in ("inner", "outer", "blocks"))
        cell, ring_no = table["cell"].to_numpy(), table["ring"].to_numpy()
        sizes = np.add.reduceat(table["n"].to_numpy(), starts)
        widest = np.maximum.reduceat(outer, starts)
        closest = np.minimum.reduceat(inner, starts)
        for batch in batches:
            if batch.empty:
                continue
            vectors, seen = np_array(batch["vec"]), batch["dists"].to_numpy()
            for part in _row_blocks(len(vectors), len(shared.value[0])):
                every, slack, gap = near(vectors[part])
                at = np.arange(len(gap))
                reach = np.array([math.sqrt(d[k - 1]) if len(d) >= k else np.inf for d in seen[part]])
                # Where home had too few rows: all rows of the cells that surely hold k.
                far = gap + widest
                order = np.argsort(far, axis=1)
                held = np.cumsum(sizes[order], axis=1)
                enough = np.where(held[:, -1] >= k, (held >= k).argmax(axis=1), len(sizes) - 1)
                reach = np.minimum(reach, np.where(held[:, -1] >= k, far[at, order[at, enough]], np.inf))
                reach = reach + 1e-6 * (1.0 + reach) + slack
                # The plane halfway between a cell's pivot and the one nearest to the row.
                nearest = every.argmin(axis=1)
                between = _gaps(shared.value[0][nearest], shared.value[0], shared.value[1])[0][:, shared.value[3]]
                plane = (gap**2 - (every.min(axis=1) ** 2)[:, None]) / np.where(between > 0, 2 * between, np.inf)
                least = np.maximum(np.maximum(gap - widest, closest - gap), plane)
                row, column = np.nonzero(least <= reach[:, None])
                pair, ring = spread(column, starts, len(table))
                row = row[pair]
                own = gap[row, column[pair]]
                inside = np.maximum(own - outer[ring], inner[ring] - own) <= reach[row]
                row, ring = row[inside], ring[inside]
                copy = np.repeat(np.arange(len(row)), blocks[ring])
                block = np.arange(len(copy)) - np.repeat(np.cumsum(blocks[ring]) - blocks[ring], blocks[ring])
                row, ring = row[copy] + part.start, ring[copy]
                done = (block == 0) & (cell[ring] == batch["cell"].to_numpy()[row]) & (
                    ring_no[ring] == batch["ring"].to_numpy()[row])
                row, ring, block = row[~done], ring[~done], block[~done]
                # Vectors are copied by row: some of the pairs at a time.
                for some in _row_blocks(len(row), PAIRS // EMIT):
                    kept = batch[["query_id", "vec", "query_key"]].iloc[row[some]]
                    yield kept.assign(
                        cell=cell[ring[some]], ring=ring_no[ring[some]], block=block[some].astype("int32")
                    )

    kinds = {f.name: f.dataType.simpleString() for f in (*queries.schema.fields, *points.schema.fields)}
    fields = f"query_id {kinds['query_id']}, vec array<double>, query_key bigint, cell int, ring int"
    queries = queries.select("query_id", "vec", "query_key")
    home = write_out(queries.mapInPandas(at_home, f"{fields}, block int"), "knn-home")
    arrays = f"train_ids array<{kinds['train_id']}>, dists array<double>, labels array<int>"
    first = write_out(_meet(home, blocked, k, block_rows, f"{fields}, {arrays}", with_findings), "knn-first")
    routed = write_out(first.mapInPandas(onward, f"{fields}, block int"), "knn-routed")
    second = _meet(routed, blocked, k, block_rows, out, _found_rows)
    each = F.inline(F.arrays_zip("train_ids", "dists", "labels")).alias("train_id", "dist2", "label")
    own = first.select("query_key", "query_id", F.lit(0).alias("rank"), each)
    return second.unionByName(own)


def few_points(points: DataFrame, width: int, broadcast_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether the counted points are few enough to be broadcast."""
    return points.count() <= broadcast_bytes // (8 * (width + 2))


def vote_here(
    df: DataFrame, vec: Column, points: DataFrame, k: int, classes: Sequence[int],
) -> DataFrame:
    """``df`` with ``prediction`` and ``probabilities`` from few ``points`` (train_id, label, vec).

    Rows stay where they are, with all their columns: neighbours are found and counted within
    the batch. A row with a missing feature stays too, its prediction is NULL. Few input
    partitions are dealt anew first, as comparing costs far more than moving a row.
    """
    local = points.toPandas()
    spark = df.sparkSession
    shared = spark.sparkContext.broadcast(
        (np_array(local["vec"]), local["train_id"].to_numpy(), local["label"].to_numpy())
    )
    search, listed = _searcher(k), list(classes)

    @F.pandas_udf("array<double>")
    def shares(vectors: pd.Series) -> pd.Series:
        import numpy as np

        matrix, ids, labels = shared.value
        there = vectors.notna().to_numpy()
        counts = np.zeros((len(vectors), len(listed)))
        if there.any():
            at = np.flatnonzero(there)
            for rows, _, cols, _ in search(np.array(vectors[there].tolist(), dtype=float), matrix, ids):
                for c, name in enumerate(listed):
                    counts[:, c] += np.bincount(at[rows], labels[cols] == name, minlength=len(vectors))
        total = min(k, len(matrix))
        return pd.Series([list(row / total) if ok else None for row, ok in zip(counts, there)])

    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))
    if df.rdd.getNumPartitions() < tasks:
        df = df.repartition(tasks)
    names = F.array(*[F.lit(int(c)) for c in classes])
    voted = df.withColumn("probabilities", shares(F.when(complete(vec), vec)))
    winner = F.array_position("probabilities", F.array_max("probabilities"))
    chosen = F.try_element_at(names, winner.cast("int"))
    return voted.withColumn("prediction", F.when(F.col("probabilities").isNotNull(), chosen))


def np_array(vectors):
    import numpy as np

    return np.array(vectors.tolist(), dtype=float)


def knn_vote(neighbours: DataFrame, classes: Sequence[int]) -> DataFrame:
    """Class with most votes (the smallest wins a tie) and vote shares per listed class."""
    shares = [F.count_if(F.col("label") == c) / F.count(F.lit(1)) for c in classes]
    voted = neighbours.groupBy("query_id").agg(F.array(*shares).alias("probabilities"))
    names = F.array(*[F.lit(int(c)) for c in classes])
    winner = F.array_position("probabilities", F.array_max("probabilities"))
    return voted.select(
        "query_id", names[(winner - 1).cast("int")].alias("prediction"), "probabilities"
    )


def knn_predict(
    test: DataFrame, train: DataFrame, features: Sequence[str] | str, test_id: str, train_id: str,
    label: str = "label", k: int = 7, classes: Sequence[int] = (0, 1, 2), **options,
) -> DataFrame:
    neighbours = knn_join(test, train, features, test_id, train_id, label, k, **options)
    return knn_vote(neighbours, classes)
