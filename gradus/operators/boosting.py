"""Gradient-boosted trees with a softmax loss, on binned features.

Every feature is cut into at most 255 bins and a bin of its own for missing values. Rows with the
same bins are one row with a weight for each class, made by a grouped count. A round grows one tree
for each class, all classes at once and level by level: tasks add up gradient and hessian per node
and bin of their rows, the sums of all tasks give the best split of every node, and so the next
level. Only left children are summed; their siblings are the parent less the left child. Missing
values go to the side where they gain more.

Two routes lead to the same trees:

* ``by_level``: every level is a job over persisted blocks of rows with their margins. Tasks sum block by
  block, what they exchange is classes times nodes times bins, whatever the rows; a round's trees are
  added to the margins as the next round begins. Nothing is held in a task but a block and the sums.
* ``by_class``: at most ``FEW_ROWS`` rows (counted) are broadcast, as a small side of a join would be, and
  a job is a round: the classes' trees are grown beside each other by a task each. Short jobs are mostly
  latency, so a small table takes a sixth of the time. Here the child with fewer rows is summed. What a
  Python worker knows of the margins is a memo only: a task on a new worker works them out from the trees.

Features with few bins are summed together, in bundles: one code stands for the bins of all of them, a
row is added to one cell of each bundle, and the cells are summed by feature afterwards.
"""

from __future__ import annotations

import math
import uuid
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
from pyspark import RDD, StorageLevel
from pyspark.broadcast import Broadcast
from pyspark.sql import Column, DataFrame, Row, SparkSession
from pyspark.sql import functions as F

from gradus import schema as S
from gradus.functions.cleaning import nan_as_null
from gradus.functions.decisions import argmax_class
from gradus.operators.splitting import known_label
from gradus.operators.sums import FEW_PARTS, array_sum
from gradus.session import write_out

MOST_BINS = 255
#: Ridge on leaf values, least hessian of a child, least gain of a split: the usual defaults.
RIDGE, LEAST_CHILD, LEAST_GAIN = 1.0, 1.0, 1e-6
#: Binned rows that are broadcast at most: some 30 MB of codes and weights.
FEW_ROWS = 1_000_000
#: Rounds between two broadcasts of all trees, from which the margins are worked out anew.
ROUNDS_PER_WRITE = 10
#: Cells of a bundle of features, at most (a feature with more has a bundle of its own).
MOST_CELLS = 1024
#: Rows of a block, at most; rows that are worth a task of their own, and rows of a task, at most.
BLOCK_ROWS, LEAST_TASK, MOST_TASK = 65_536, 65_536, 1_000_000
INFO = "boosted_info"

_NODE = (
    "round int, tree_class int, node int, depth int, feature string, cut int, threshold double, "
    "missing_left boolean, gain double, cover double, value double"
)


class Layout:
    """Where the bins of each feature lie in a row of sums: its values' bins, then the missing one."""

    def __init__(self, cuts: Sequence[Sequence[float]]):
        self.cuts = [np.asarray(c, dtype=float) for c in cuts]
        sizes = np.array([len(c) + 2 for c in self.cuts])
        self.missing = sizes - 1
        self.starts = np.concatenate([[0], np.cumsum(sizes)[:-1]])
        self.width = int(sizes.sum())
        # Candidate splits: bins up to ``cut`` go left.
        self.feature = np.repeat(np.arange(len(sizes)), sizes - 1)
        self.cut = np.concatenate([np.arange(n - 1) for n in sizes])
        self.at = self.starts[self.feature] + self.cut
        # Bundles, the features with the fewest bins first.
        self.bundles: list[list[int]] = []
        self.cells: list[int] = []
        for f in np.argsort(sizes, kind="stable").tolist():
            if self.bundles and self.cells[-1] * sizes[f] <= MOST_CELLS:
                self.bundles[-1].append(f)
                self.cells[-1] *= int(sizes[f])
            else:
                self.bundles.append([f])
                self.cells.append(int(sizes[f]))
        #: By bundle: the bin of each of its features in each cell.
        self.digits = [
            np.stack(np.unravel_index(np.arange(n), tuple(sizes[own]))) for own, n in zip(self.bundles, self.cells)
        ]
        #: By bundle: where its features' bins lie in a row of sums, and which cells add up to each.
        self.places = [np.concatenate([self.starts[f] + np.arange(sizes[f]) for f in own]) for own in self.bundles]
        self.parts = [
            np.concatenate([d == np.arange(sizes[f])[:, None] for f, d in zip(own, digits)]).T.astype(float)
            for own, digits in zip(self.bundles, self.digits)
        ]

    def __reduce__(self):
        return Layout, (self.cuts,)

    def codes(self, bins: np.ndarray) -> np.ndarray:
        """Rows of bins to a row of codes for each bundle."""
        out = np.empty((len(self.bundles), len(bins)), dtype=np.uint16)
        for b, own in enumerate(self.bundles):
            code = bins[:, own[0]].astype(np.int64)
            for f in own[1:]:
                code = code * (self.missing[f] + 1) + bins[:, f]
            out[b] = code
        return out

    def bins(self, values: np.ndarray) -> np.ndarray:
        """Rows of values (NaN: missing) to rows of bins."""
        out = np.empty(values.shape, dtype=np.uint8)
        for f, cuts in enumerate(self.cuts):
            found = np.searchsorted(cuts, values[:, f], side="left")
            out[:, f] = np.where(np.isnan(values[:, f]), self.missing[f], found)
        return out


def split_gains(sums: np.ndarray, layout: Layout):
    """Gain of every candidate split of (class, node, bin) sums, missing values right or left, with
    the sums of its sides and of the node; a side without enough hessian makes it minus infinity."""
    end = layout.starts[0] + layout.missing[0] + 1
    total = sums[:, :, layout.starts[0]:end].sum(axis=2)
    run = np.concatenate([np.zeros_like(sums[:, :, :1]), sums.cumsum(axis=2)], axis=2)
    left = run[:, :, layout.at + 1] - run[:, :, layout.starts[layout.feature]]
    lost = sums[:, :, (layout.starts + layout.missing)[layout.feature]]
    sides = np.stack([left, left + lost], axis=2)
    rest = total[:, :, None, None] - sides

    def score(part):
        return part[..., 0] ** 2 / (part[..., 1] + RIDGE)

    gain = score(sides) + score(rest) - score(total)[:, :, None, None]
    gain[(sides[..., 1] < LEAST_CHILD) | (rest[..., 1] < LEAST_CHILD)] = -np.inf
    return gain, sides, rest, total


def descend(turns: list[np.ndarray], codes: np.ndarray, nodes: np.ndarray, levels: range) -> np.ndarray:
    """Nodes of rows further down; ``nodes`` are of the first of the levels."""
    word = None
    for level in levels:
        if level >= 6:  # nodes of several words
            word = np.zeros(len(nodes), dtype=np.int64)
            for words, code in zip(turns, codes):
                word |= words[nodes >> 6, code]
        elif word is None:
            word = turns[0][0].take(codes[0])
            for words, code in zip(turns[1:], codes[1:]):
                word |= words[0].take(code)
        nodes = 2 * nodes + 1 + (word >> (nodes & 63) & 1)
    return nodes


class Trees:
    """One tree for each class, as arrays over heap positions (children of i: 2i + 1 and 2i + 2)."""

    FIELDS = ("feature", "cut", "missing_left", "gain", "cover", "value")

    def __init__(self, classes: int, depth: int):
        shape = (classes, 2 ** (depth + 1) - 1)
        self.depth = depth
        self.feature = np.full(shape, -1, dtype=np.int16)
        self.cut = np.zeros(shape, dtype=np.int16)
        self.missing_left = np.zeros(shape, dtype=bool)
        self.gain, self.cover, self.value = (np.zeros(shape) for _ in range(3))
        self.parents: np.ndarray | None = None  # sums of the last level, while growing
        self.other = np.zeros((classes, 2**depth - 1), dtype=bool)  # whose right child is summed, while growing

    def split(self, sums: np.ndarray, level: int, layout: Layout, step: float) -> bool:
        """Take the best splits of a level from the sums of its left children (right ones where ``other``
        is set); whether any was."""
        first = 2**level - 1
        if level:
            pairs = np.stack([sums, self.parents - sums], axis=2)
            turned = self.other[:, (first - 1) // 2:first]
            pairs[turned] = pairs[turned][:, ::-1]
            whole = pairs.reshape(sums.shape[0], -1, *sums.shape[2:])
            whole[np.repeat(self.feature[:, (first - 1) // 2:first] < 0, 2, axis=1)] = 0
        else:
            whole = sums
        self.parents = whole
        gain, sides, rest, total = split_gains(whole, layout)
        if not level:
            self._leaf(0, total[:, 0], step)
        flat = gain.reshape(*gain.shape[:2], -1)
        # Of equal gains, up to rounding, the first.
        top = flat.max(axis=2, keepdims=True)
        best = (flat >= top - 1e-9 * np.abs(top)).argmax(axis=2)
        k, n = np.nonzero(np.take_along_axis(flat, best[:, :, None], axis=2)[..., 0] > LEAST_GAIN)
        side, which = np.divmod(best[k, n], gain.shape[3])
        at = first + n
        self.feature[k, at], self.cut[k, at] = layout.feature[which], layout.cut[which]
        self.missing_left[k, at], self.gain[k, at] = side == 1, flat[k, n, best[k, n]]
        for child, part in ((1, sides), (2, rest)):
            self._leaf((k, 2 * at + child), part[k, n, side, which], step)
        return len(k) > 0

    def _leaf(self, where, part: np.ndarray, step: float) -> None:
        where = where if isinstance(where, tuple) else (slice(None), where)
        self.cover[where] = part[..., 1]
        self.value[where] = -step * part[..., 0] / (part[..., 1] + RIDGE)

    def __getstate__(self):
        return self.__dict__ | {"parents": None, "other": None}  # of the process that grows them

    def turns(self, k: int, layout: Layout) -> list[np.ndarray]:
        """By bundle, for each 64 nodes and each cell a word whose bits are set where a row turns right.

        The words of all bundles together say where a row turns. In a leaf it does, so that
        nothing is summed for it.
        """
        inner = 2**self.depth - 1
        out = [np.zeros((inner // 64 + 1, n), dtype=np.int64) for n in layout.cells]
        feature = self.feature[k, :inner]
        bit = np.left_shift(np.int64(1), np.arange(inner) % 64)
        leaves = np.flatnonzero(feature < 0)
        np.bitwise_or.at(out[0], leaves // 64, bit[leaves, None])
        for words, own, digits in zip(out, layout.bundles, layout.digits):
            for f, bins in zip(own, digits):
                at = np.flatnonzero(feature == f)
                if len(at):
                    lost = ~self.missing_left[k, at, None]
                    right = np.where(bins == layout.missing[f], lost, bins > self.cut[k, at, None])
                    np.bitwise_or.at(words, at // 64, np.where(right, bit[at, None], 0))
        return out

    def right(self, k: int, node: int, layout: Layout) -> tuple[int, np.ndarray]:
        """The bundle that a node splits by, and which of its cells turn right."""
        f = self.feature[k, node]
        b = next(i for i, own in enumerate(layout.bundles) if f in own)
        bins = layout.digits[b][layout.bundles[b].index(f)]
        return b, np.where(bins == layout.missing[f], not self.missing_left[k, node], bins > self.cut[k, node])

    def reached(self, k: int, layout: Layout) -> list[np.ndarray]:
        """By bundle, for each cell a word with a bit for each place in the lowest level, at most 64.

        A split takes the places left of it from the cells that turn right. Of those that all bundles
        leave, the first is a row's place, or the first place below its leaf.
        """
        out = [np.full(n, 2**64 - 1, dtype=np.uint64) for n in layout.cells]
        for node in np.flatnonzero(self.feature[k, :2**self.depth - 1] >= 0).tolist():
            level = (node + 1).bit_length() - 1
            half = 2 ** (self.depth - level - 1)
            left = ((1 << half) - 1) << (node + 1 - 2**level) * 2 * half
            b, turns = self.right(k, node, layout)
            out[b][turns] &= np.uint64(~left & 2**64 - 1)
        return out

    def values(self, k: int) -> np.ndarray:
        """Value for each place in the lowest level: that of the leaf which a row there is in."""
        out = self.value[k, :1]
        for level in range(self.depth):
            first = 2**level - 1
            split = np.repeat(self.feature[k, first:2 * first + 1] >= 0, 2)
            out = np.where(split, self.value[k, 2 * first + 1:4 * first + 3], np.repeat(out, 2))
        return out

    def scorer(self, layout: Layout) -> Callable[[np.ndarray], np.ndarray]:
        """What the trees add to the margins, by class, of rows with codes by bundle."""
        flat = self.depth <= 6
        own = [((self.reached if flat else self.turns)(k, layout), self.values(k)) for k in range(len(self.feature))]

        def places(words: list[np.ndarray], codes: np.ndarray) -> np.ndarray:
            if not flat:
                nodes = descend(words, codes, np.zeros(codes.shape[1], dtype=np.int64), range(self.depth))
                return nodes - (2**self.depth - 1)
            left = words[0].take(codes[0])
            for word, code in zip(words[1:], codes[1:]):
                left &= word.take(code)
            return np.bitwise_count((left & -left) - np.uint64(1))  # the lowest bit's place

        def margins(codes: np.ndarray) -> np.ndarray:
            out = np.empty((len(own), codes.shape[1]))
            for k, (words, values) in enumerate(own):
                out[k] = values.take(places(words, codes))
            return out

        return margins

    @classmethod
    def side_by_side(cls, parts: Sequence[Trees]) -> Trees:
        """One object for the trees of several classes."""
        out = cls(len(parts), parts[0].depth)
        for name in cls.FIELDS:
            setattr(out, name, np.concatenate([getattr(p, name) for p in parts]))
        return out

    def rows(self, number: int, features: Sequence[str], layout: Layout) -> list[tuple]:
        """The nodes of a round's trees as rows of the model table."""
        out = []
        for k in range(len(self.feature)):
            used = [0]
            for node in used:
                f = int(self.feature[k, node])
                name, cut, threshold = None, -1, None
                if f >= 0:
                    used += [2 * node + 1, 2 * node + 2]
                    name, cut = features[f], int(self.cut[k, node])
                    threshold = float(layout.cuts[f][cut]) if cut < len(layout.cuts[f]) else math.inf
                out.append((
                    number, k, node, (node + 1).bit_length() - 1, name, cut, threshold,
                    bool(self.missing_left[k, node]), float(self.gain[k, node]),
                    float(self.cover[k, node]), float(self.value[k, node]),
                ))
        return out


def _shares(margins: np.ndarray) -> np.ndarray:
    """Shares of the classes from margins by class."""
    shifted = np.exp(margins - margins.max(axis=0))
    return shifted / shifted.sum(axis=0)


class Rows:
    """The binned rows of a task or block: codes by bundle, weights and margins by class."""

    def __init__(self, bins: np.ndarray, weights: np.ndarray, margins: np.ndarray, layout: Layout):
        self._take(layout.codes(bins), np.ascontiguousarray(weights.T), np.ascontiguousarray(margins.T), layout)

    @classmethod
    def of(cls, block: tuple[np.ndarray, np.ndarray, np.ndarray], layout: Layout) -> Rows:
        """The rows of a block of codes, weights and margins."""
        out = cls.__new__(cls)
        out._take(*block, layout)
        return out

    def _take(self, codes, weights, margins, layout) -> None:
        self.codes, self.weights, self.margins, self.layout = codes.astype(np.int64), weights, margins, layout

    def block(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        return self.codes.astype(np.uint16), self.weights, self.margins

    def begin(self, classes: Sequence[int] | None = None) -> None:
        """Gradients of the current margins for some classes (all by default); rows at the root."""
        own = slice(None) if classes is None else list(classes)
        shares, whole = _shares(self.margins)[own], self.weights.sum(axis=0)
        self.gradient = whole * shares - self.weights[own]
        self.hessian = np.maximum(2.0 * whole * shares * (1.0 - shares), 1e-16)
        self.nodes = np.zeros(self.gradient.shape, dtype=np.int64)

    def descend(self, trees: Trees, levels: range) -> None:
        for k in range(len(self.nodes)):
            self.nodes[k] = descend(trees.turns(k, self.layout), self.codes, self.nodes[k], levels)

    def sums(self, trees: Trees, level: int) -> np.ndarray:
        """Gradient and hessian by class, left node of the level, and bin; rows come from the level above."""
        classes, pairs = len(self.nodes), max(1, 2 ** (level - 1))
        out = np.zeros((classes, pairs, self.layout.width, 2))
        if level:
            self.descend(trees, range(level - 1, level))
        for k in range(classes):
            codes, pair, changes = self.codes, None, (self.gradient[k], self.hessian[k])
            if level:
                mine = np.flatnonzero(self.nodes[k] & 1)  # left children have odd numbers
                pair = (self.nodes[k].take(mine) - (2**level - 1)) >> 1
                codes, changes = codes.take(mine, axis=1), [c.take(mine) for c in changes]
            self._add_up(out[k], codes, pair, changes)
        return out

    def _add_up(self, out: np.ndarray, codes, pair: np.ndarray | None, changes) -> None:
        """Sums of rows' changes by pair (one if None) and bin."""
        pairs = len(out)
        for b, n in enumerate(self.layout.cells):
            cell = codes[b] if pair is None else pair * n + codes[b]
            for i, values in enumerate(changes):
                by_cell = np.bincount(cell, values, pairs * n).reshape(pairs, n)
                out[:, self.layout.places[b], i] = by_cell @ self.layout.parts[b]

    def lesser_sums(self, trees: Trees, level: int) -> np.ndarray:
        """As ``sums``, of the child with fewer rows of each node, which is told to the trees.

        All rows must be here. They are kept by node, and only those of split nodes are gone through.
        """
        if not level:
            self.below = [{0: np.arange(self.nodes.shape[1])} for _ in self.nodes]
            return self.sums(trees, 0)
        classes, pairs, first = len(self.nodes), 2 ** (level - 1), 2 ** (level - 1) - 1
        out = np.zeros((classes, pairs, self.layout.width, 2))
        for k in range(classes):
            below: dict[int, np.ndarray] = {}
            mine = [np.arange(0)] * pairs
            for node, rows in self.below[k].items():
                if trees.feature[k, node] >= 0:
                    b, turns = trees.right(k, node, self.layout)
                    right = turns.take(self.codes[b].take(rows))
                    sides = rows[~right], rows[right]
                    below[2 * node + 1], below[2 * node + 2] = sides
                    trees.other[k, node] = other = len(sides[1]) < len(sides[0])
                    mine[node - first] = sides[other]
            self.below[k] = below
            pair, mine = np.repeat(np.arange(pairs), [len(rows) for rows in mine]), np.concatenate(mine)
            changes = [c[k].take(mine) for c in (self.gradient, self.hessian)]
            self._add_up(out[k], [code.take(mine) for code in self.codes], pair, changes)
        return out

    def add(self, trees: Trees) -> None:
        self.margins = self.margins + trees.scorer(self.layout)(self.codes)


def grow(
    classes: int, depth: int, step: float, layout: Layout, sums_of: Callable[[Trees, int], np.ndarray],
) -> Trees:
    """One round: a tree for each class from sums over all rows, one call a level."""
    trees = Trees(classes, depth)
    for level in range(depth):
        if not trees.split(sums_of(trees, level), level, layout, step):
            break
    trees.parents = trees.other = None
    return trees


def find_cuts(
    train: DataFrame, features: Sequence[str], most_bins: int = MOST_BINS,
) -> list[list[float]]:
    """Per feature the upper ends of its bins but the last: all values but the largest where there
    are few, else quantiles. Two passes that keep a count and a bounded set or a sketch for each
    feature, and a third where a count was too low."""
    kinds = dict(train.dtypes)
    values = {c: nan_as_null(F.col(f"`{c}`"), kinds[c]).cast("double") for c in features}
    ranks = [i / most_bins for i in range(1, most_bins)]

    def ends_of(few: Sequence[str], many: Sequence[str]) -> dict[str, list[float]]:
        sets = [F.collect_set(values[c]) for c in few]
        sketches = [F.percentile_approx(values[c], ranks, 20 * most_bins) for c in many]
        return dict(zip([*few, *many], train.agg(*sets, *sketches).first())) if few or many else {}

    seen = train.agg(*[x for v in values.values() for x in (F.approx_count_distinct(v), F.max(v))]).first()
    about, top = dict(zip(features, seen[::2])), dict(zip(features, seen[1::2]))
    few = [c for c in features if about[c] <= 1.1 * most_bins]
    found = ends_of(few, [c for c in features if c not in few])
    found |= ends_of([], [c for c in few if len(found[c]) > most_bins])
    cuts = []
    for c in features:
        ends = sorted(set(found[c] or []))
        cuts.append([v for v in ends if v < top[c]] if ends else [])
    return cuts


def _numbers(column: pa.Array) -> np.ndarray:
    """Doubles, NaN for NULL."""
    return column.to_numpy(zero_copy_only=False).astype(float, copy=False)


def _texts(rows: np.ndarray) -> pa.Array:
    """A row of bytes as one value."""
    n, width = rows.shape
    ends = np.arange(n + 1, dtype=np.int32) * np.int32(width)
    return pa.Array.from_buffers(pa.binary(), n, [None, pa.py_buffer(ends), pa.py_buffer(np.ascontiguousarray(rows))])


def binned(
    train: DataFrame, features: Sequence[str], label: str, classes: Sequence[int], layout: Layout,
) -> DataFrame:
    """``bins, weights``: rows with equal bins as one, with the balanced weight of each class.

    Counted before the shuffle, so bins that a third of the rows share are a row a task.
    """
    names = list(features)

    def bin_rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            values = np.stack([_numbers(c) for c in batch.columns[1:]], axis=1)
            yield pa.RecordBatch.from_arrays([_texts(layout.bins(values)), batch.column(0)], ["bins", "y"])

    typed = [F.col(f"`{c}`").cast("double").alias(c) for c in names]
    labels = known_label(label, classes).cast("int").alias("y")
    rows = train.select(labels, *typed).mapInArrow(bin_rows, "bins binary, y int")
    counts = [F.count_if(F.col("y") == c).alias(f"n{i}") for i, c in enumerate(classes)]
    cells = write_out(rows.groupBy("bins").agg(*counts), "boosting-cells")
    totals = cells.agg(*[F.sum(f"n{i}") for i in range(len(classes))]).first()
    if not totals[0] and not any(totals):
        raise ValueError("no training rows")
    present, n = sum(t > 0 for t in totals), sum(totals)
    weight = [n / (present * t) if t else 0.0 for t in totals]
    return cells.select(
        "bins", F.array(*[F.col(f"n{i}") * F.lit(w) for i, w in enumerate(weight)]).alias("weights")
    )


def _arrays(batch: pa.RecordBatch | pa.Table, layout: Layout) -> tuple[np.ndarray, np.ndarray]:
    """Bins and weights of a batch of binned rows."""
    bins = np.frombuffer(b"".join(batch.column("bins").to_pylist()), dtype=np.uint8).reshape(-1, len(layout.cuts))
    weights = pa.compute.list_flatten(batch.column("weights")).to_numpy(zero_copy_only=False)
    return bins, weights.reshape(len(bins), -1)


def _packed(cells: DataFrame, layout: Layout) -> DataFrame:
    """Binned rows as blocks (``codes, weights`` as bytes), in an order that hangs on the rows only."""
    n, slots = cells.count(), cells.sparkSession.sparkContext.defaultParallelism
    tasks = max(1, math.ceil(n / MOST_TASK), min(slots, math.ceil(n / LEAST_TASK)))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def block() -> pa.RecordBatch:
            bins, weights = _arrays(pa.Table.from_batches(held), layout)
            codes = layout.codes(bins).tobytes()
            return pa.RecordBatch.from_pydict({"codes": [codes], "weights": [weights.T.tobytes()]})

        for batch in batches:
            if held and sum(map(len, held)) + len(batch) > BLOCK_ROWS:
                yield block()
                held = []
            if len(batch):
                held.append(batch)
        if held:
            yield block()

    spread = cells.repartition(tasks, "bins").sortWithinPartitions("bins")
    return spread.mapInArrow(pack, "codes binary, weights binary")


def _unpack(row: Row, bundles: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Codes, weights and margins of 0 of a block."""
    codes = np.frombuffer(row.codes, dtype=np.uint16).reshape(bundles, -1)
    weights = np.frombuffer(row.weights, dtype=float).reshape(-1, codes.shape[1])
    return codes, weights, np.zeros_like(weights)


#: In a Python worker: the rows of the fit it last worked for, and the rounds in their margins.
_HELD: dict[str, tuple[Rows, int]] = {}


def _held(key: str, make: Callable[[], Rows], trees: Sequence[Trees]) -> Rows:
    """Rows whose margins have all the trees; what this worker lacks is added."""
    if key not in _HELD:
        _HELD.clear()
        _HELD[key] = make(), 0
    rows, known = _HELD[key]
    if known > len(trees):  # a task of an earlier round, done again
        rows, known = make(), 0
    for t in trees[known:]:
        rows.add(t)
    _HELD[key] = rows, len(trees)
    return rows


def _grow_by_class(
    cells: DataFrame, layout: Layout, classes: int, rounds: int, depth: int, step: float,
    per_write: int = ROUNDS_PER_WRITE,
) -> list[Trees]:
    """All rounds, a job each, with a task for each class over few broadcast rows."""
    local = [_unpack(row, len(layout.bundles)) for row in _packed(cells, layout).collect()]  # FEW_ROWS at most
    block = tuple(np.concatenate(parts, axis=1) for parts in zip(*local))
    context, key = cells.sparkSession.sparkContext, uuid.uuid4().hex
    shared, older = context.broadcast((block, layout)), context.broadcast([])
    done: list[Trees] = []
    recent: list[Trees] = []
    slots = context.parallelize(range(classes), classes)
    while len(done) < rounds:
        def one(k: int, older=older, recent=tuple(recent)) -> Trees:
            own_block, own_layout = shared.value

            def make() -> Rows:
                return Rows.of(own_block, own_layout)

            rows = _held(key, make, [*older.value, *recent])
            rows.begin([k])
            return grow(1, depth, step, own_layout, rows.lesser_sums)

        parts = slots.map(one).collect()
        done.append(Trees.side_by_side(parts))
        recent.append(done[-1])
        if len(recent) == per_write:
            older.destroy()
            older, recent = context.broadcast(list(done)), []
    older.destroy()
    shared.destroy()
    return done


def _sums_by_job(state: RDD, shared: Broadcast, trees: Trees, level: int) -> np.ndarray:
    """The sums of a level over blocks of rows with their margins, as one job."""
    def level_sums(blocks: Iterator[tuple]) -> Iterator[np.ndarray]:
        total = None
        for block in blocks:
            rows = Rows.of(block, shared.value)
            rows.begin()
            if level > 1:
                rows.descend(trees, range(level - 1))
            own = rows.sums(trees, level)
            total = own if total is None else total + own
        if total is not None:
            yield total

    parts = state.mapPartitions(level_sums)
    if state.getNumPartitions() > FEW_PARTS:
        return parts.treeReduce(np.add, depth=3)
    return sum(parts.collect())


def _grow_by_level(
    cells: DataFrame, layout: Layout, classes: int, rounds: int, depth: int, step: float,
    per_write: int = ROUNDS_PER_WRITE,
) -> list[Trees]:
    """All rounds, a job for each level; blocks are summed one by one, whatever their number.

    The first job of a round adds the last one's trees to the margins. Every few rounds the margins
    are worked out from all trees, so that what a lost block is made from stays short.
    """
    context, level = cells.sparkSession.sparkContext, StorageLevel.MEMORY_AND_DISK
    shared = context.broadcast(layout)

    def moved(state: RDD, trees: Callable[[], Sequence[Trees]]) -> RDD:
        def move(block: tuple) -> tuple:
            rows = Rows.of(block, shared.value)
            for t in trees():
                rows.add(t)
            return rows.block()

        return state.map(move).persist(level)

    bundles = len(layout.bundles)
    base = _packed(cells, layout).rdd.map(lambda row: _unpack(row, bundles)).persist(level)
    state, done = base, []
    kept: list[RDD] = []  # what the state was made from, until it is made
    older: list[Broadcast] = []
    try:
        while True:
            def add_up(trees: Trees, at: int, state=state) -> np.ndarray:
                return _sums_by_job(state, shared, trees, at)

            done.append(grow(classes, depth, step, layout, add_up))
            for gone in kept:
                gone.unpersist()
            while len(older) > 1:
                older.pop(0).destroy()
            if len(done) >= rounds:
                return done
            kept = [] if state is base else [state]
            if len(done) % per_write:
                state = moved(state, lambda last=(done[-1],): last)
            else:
                older.append(context.broadcast(list(done)))
                state = moved(base, lambda every=older[-1]: every.value)
    finally:
        for rdd in {id(r): r for r in (*kept, state, base)}.values():
            rdd.unpersist()
        for b in (*older, shared):
            b.destroy()


class BoostedModel:
    """Fitted trees: a table of nodes, the cuts of the features, and how to score with them."""

    def __init__(self, trees: list[Trees], cuts, features: Sequence[str], classes: Sequence[int]):
        self.trees, self.features, self.classes = trees, list(features), list(classes)
        self.layout = Layout(cuts)

    @classmethod
    def fit(
        cls, train: DataFrame, features: Sequence[str] = tuple(S.FEATURES), label: str = S.TARGET,
        classes: Sequence[int] = S.LEVELS, rounds: int = 200, depth: int = 6, step: float = 0.1,
        route: str | None = None, most_bins: int = MOST_BINS,
    ) -> BoostedModel:
        """Trees with balanced class weights; a missing value (NaN too) has a bin of its own.

        ``route`` is chosen by the counted rows unless given. A label outside ``classes`` raises.
        """
        if not 1 <= most_bins <= MOST_BINS:
            raise ValueError(f"between 1 and {MOST_BINS} bins")
        # Read three times from here on, but made once.
        train = write_out(train.select(*[F.col(f"`{c}`") for c in dict.fromkeys([*features, label])]), "boosting-train")
        cuts = find_cuts(train, features, most_bins)
        layout = Layout(cuts)
        cells = write_out(binned(train, features, label, classes, layout), "boosting-rows")
        if route is None:
            route = "by_class" if cells.count() <= FEW_ROWS else "by_level"
        ways = {"by_class": _grow_by_class, "by_level": _grow_by_level}
        trees = ways[route](cells, layout, len(classes), rounds, depth, step)
        return cls(trees, cuts, features, classes)

    def nodes(self, spark: SparkSession) -> DataFrame:
        """The model as a table: a row for each node, its split or its value."""
        rows = [r for i, t in enumerate(self.trees) for r in t.rows(i, self.features, self.layout)]
        return spark.createDataFrame(pd.DataFrame(rows, columns=[x.split()[0] for x in _NODE.split(", ")]), _NODE)

    def importances(self) -> list[tuple[str, float]]:
        """Mean gain of a feature's splits, as shares of 1; the largest first."""
        total, count = np.zeros(len(self.features)), np.zeros(len(self.features))
        for t in self.trees:
            used = t.feature >= 0
            total += np.bincount(t.feature[used], t.gain[used], len(self.features))
            count += np.bincount(t.feature[used], minlength=len(self.features))
        mean = total / np.maximum(count, 1)
        shares = mean / (mean.sum() or 1.0)
        return sorted(zip(self.features, map(float, shares)), key=lambda pair: (-pair[1], pair[0]))

    def score(self, df: DataFrame) -> DataFrame:
        """``df`` with ``probabilities`` and ``prediction``; rows stay where they are.

        The trees are broadcast: rounds times classes times nodes, whatever the rows. Rows of a
        batch with the same bins are scored once.
        """
        shared = df.sparkSession.sparkContext.broadcast((self.trees, self.layout))

        @F.pandas_udf("array<double>")
        def shares(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
            trees, layout = shared.value
            scorers = [t.scorer(layout) for t in trees]
            for vectors in batches:
                bins = layout.bins(np.array(vectors.tolist(), dtype=float).reshape(-1, len(layout.cuts)))
                own, back = np.unique(layout.codes(bins), axis=1, return_inverse=True)
                out = _shares(sum(scorer(own) for scorer in scorers)).T
                yield pd.Series(list(out[np.ravel(back)]))

        def value(c: str) -> Column:
            return F.coalesce(F.col(f"`{c}`").cast("double"), F.lit(float("nan")))

        vector = F.array(*[value(c) for c in self.features])
        scored = df.withColumn("probabilities", shares(vector))
        return scored.withColumn("prediction", self._named(argmax_class(F.col("probabilities"))))

    def _named(self, position: Column) -> Column:
        """The class at a position; classes are mostly their own positions."""
        if self.classes == list(range(len(self.classes))):
            return position
        return F.get(F.array(*[F.lit(int(c)) for c in self.classes]), position)

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.nodes(spark).coalesce(1).write.mode("overwrite").parquet(f"{path}/nodes")
        depth = self.trees[0].depth if self.trees else 0
        info = (self.features, self.classes, [c.tolist() for c in self.layout.cuts], len(self.trees), depth)
        kinds = "features array<string>, classes array<int>, cuts array<array<double>>, rounds int, depth int"
        spark.createDataFrame([info], kinds).coalesce(1).write.mode("overwrite").parquet(f"{path}/{INFO}")

    @classmethod
    def load(cls, spark: SparkSession, path: str) -> BoostedModel:
        info = spark.read.parquet(f"{path}/{INFO}").first()
        trees = [Trees(len(info["classes"]), info["depth"]) for _ in range(info["rounds"])]
        places = {name: i for i, name in enumerate(info["features"])}
        table = spark.read.schema(_NODE).parquet(f"{path}/nodes").toPandas()  # the nodes of a model
        for r in table.itertuples():
            t, at = trees[r.round], (r.tree_class, r.node)
            t.gain[at], t.cover[at], t.value[at], t.missing_left[at] = r.gain, r.cover, r.value, r.missing_left
            if r.cut >= 0:
                t.feature[at], t.cut[at] = places[r.feature], r.cut
        return cls(trees, info["cuts"], info["features"], info["classes"])


def first_gains(
    train: DataFrame, features: Sequence[str] = tuple(S.FEATURES), label: str = S.TARGET,
    classes: Sequence[int] = S.LEVELS, most_bins: int = MOST_BINS,
) -> DataFrame:
    """``tree_class, feature, gain``: the best gain of each feature at the root of each class's first tree.

    The screening form of the importances: one pass of sums over the binned rows, no tree grown.
    A feature that no split helps has a gain of 0.
    """
    layout = Layout(find_cuts(train, features, most_bins))
    cells = binned(train, features, label, classes, layout)

    def root_sums(batch: pd.DataFrame) -> np.ndarray:
        bins, weights = _arrays(pa.RecordBatch.from_pandas(batch, preserve_index=False), layout)
        rows = Rows(bins, weights, np.zeros_like(weights), layout)
        rows.begin()
        return rows.sums(Trees(len(classes), 1), 0)

    shape = (len(classes), 1, layout.width, 2)
    sums = array_sum(cells, root_sums, math.prod(shape)).reshape(shape)
    gain = split_gains(sums, layout)[0][:, 0].max(axis=1)
    best = np.maximum(np.maximum.reduceat(gain, np.flatnonzero(layout.cut == 0), axis=1), 0.0)
    rows = [(int(c), name, float(g)) for c, own in zip(classes, best) for name, g in zip(features, own)]
    return train.sparkSession.createDataFrame(rows, "tree_class int, feature string, gain double")
