"""Benchmark passages in documents by the q-gram lemma, with edits allowed.

Texts are compared in lower case with runs of blanks as one blank. Every stretch of a benchmark
item as long as a window is looked for, wherever in the item it begins. A window of m characters
that occurs in a document with at most k edits shares at least m - q + 1 - kq q-grams with it, all on
diagonals that lie within k of each other. So the q-grams shared with an item are counted in diagonal
bands that overlap by more than that, along the item in a sliding count, and the windows that
reach the bound are verified by alignment within the band. The index holds each q-gram of an item
once. Documents are one narrow pass for each block of the benchmark, whose size is bounded.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm.common import modest_batches, table, texts

#: Characters in a q-gram and in a window; edits allowed per character.
Q, WINDOW, RATE = 10, 80, 0.075
#: Benchmark characters whose index goes to the workers at once, about 50 bytes each.
BLOCK_CHARS = 2_000_000
#: Characters of a document that are searched at once; pieces overlap by more than a window.
PIECE = 20_000
#: Shared q-grams that are counted at once, and windows that are verified at once.
HITS, BATCH = 2_000_000, 256

_BASE = 0x9E3779B97F4A7C15
_POWERS = {1 << i: np.uint64(pow(_BASE, 1 << i, 1 << 64)) for i in range(8)}
_BITS = 22
#: Characters from here on have no case and are no blanks.
_CASELESS = 0x1F000


@lru_cache(maxsize=1)
def _plain() -> np.ndarray:
    """What each character is compared as: lower case (if it is one character), blanks as one."""
    out = np.arange(_CASELESS, dtype=np.uint32)
    for c in range(_CASELESS):
        char = chr(c)
        if char.isspace():
            out[c] = 32
        elif len(low := char.lower()) == 1:
            out[c] = ord(low)
    return out


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Codes of the text in lower case, runs of blanks as one, none at either end; their places."""
    codes = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    plain = _plain()
    if len(codes) and codes.max() < _CASELESS:
        codes = plain[codes]
    else:
        known = codes < _CASELESS
        codes = np.where(known, plain[np.where(known, codes, 0)], codes)
    blank = codes == 32
    keep = ~blank
    keep[1:] |= ~blank[:-1]
    places = np.flatnonzero(keep)
    if len(places) and blank[places[-1]]:
        places = places[:-1]
    if len(places) and blank[places[0]]:
        places = places[1:]
    return codes[places], places


def grams(codes: np.ndarray, q: int) -> np.ndarray:
    """Hash of each q-gram, put together from those of 1, 2, 4, ... characters."""
    n = len(codes) - q + 1
    if n <= 0:
        return np.empty(0, dtype=np.uint64)
    part, length = codes.astype(np.uint64), 1  # hashes of grams of this length
    out, done = None, 0
    while True:
        if q & length:
            tail = part[done : done + n]
            out = tail.copy() if out is None else out * _POWERS[length] + tail
            done += length
        if 2 * length > q:
            break
        part = part[:-length] * _POWERS[length] + part[length:]
        length *= 2
    out ^= out >> np.uint64(31)
    out *= np.uint64(0xBF58476D1CE4E5B9)
    return out


def edit_budget(size: int, q: int = Q, rate: float = RATE) -> int:
    """Edits allowed in a window: its share, but so few that at least one q-gram stays."""
    return max(0, min(int(rate * size), (size - q) // q))


class Index:
    """Some benchmark items and where their q-grams are."""

    def __init__(self, items: list[tuple[int | None, str]], q: int = Q, window: int = WINDOW, rate: float = RATE):
        self.q = q
        self.item_ids: list[int | None] = []
        self.codes: list[np.ndarray] = []  # of each item
        for item_id, text in items:
            codes, _ = normalised(text)
            if len(codes) >= q:  # else too short for a q-gram
                self.item_ids.append(item_id)
                self.codes.append(codes)
        self.empty = not self.codes
        if self.empty:
            return
        parts = [grams(codes, q) for codes in self.codes]
        flat = np.concatenate(parts)
        # By hash, then item, then place: a stable sort of what comes by item and place.
        order = np.argsort(flat, kind="stable")
        self.place = np.concatenate([np.arange(len(p)) for p in parts])[order]
        self.item = np.repeat(np.arange(len(parts)), [len(p) for p in parts])[order]
        self.keys, self.first, self.count = np.unique(flat[order], return_index=True, return_counts=True)
        self.rank_item = np.repeat(np.arange(len(self.keys)), self.count) * len(parts) + self.item
        self.bitmap = np.zeros(1 << _BITS, dtype=bool)
        self.bitmap[(self.keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.length = np.array([len(codes) for codes in self.codes])
        self.size = np.minimum(self.length, window)  # of an item's windows
        self.budget = np.array([edit_budget(n, q, rate) for n in self.size])
        self.bound = self.size - q + 1 - self.budget * q
        self.reach = int((self.size + self.budget).max())

    def regions(self, codes: np.ndarray) -> Iterator[tuple[int, int, int, int, int]]:
        """``item, place in it, start, end, edits`` of every verified window of a document."""
        if self.empty or len(codes) < self.q:
            return
        overlap = self.reach + 4 * int(self.budget.max()) + self.q
        for at in range(0, len(codes), PIECE):
            yield from self._search(codes, at, min(len(codes), at + PIECE + overlap))
            if at + PIECE + overlap >= len(codes):
                break

    def _search(self, codes: np.ndarray, low: int, high: int) -> Iterator[tuple[int, int, int, int, int]]:
        found = grams(codes[low:high], self.q)
        hit = self.bitmap[(found >> np.uint64(64 - _BITS)).astype(np.int64)]
        # Fewer hits in any stretch as long as a window than the least bound: nothing to count.
        total = np.concatenate([[0], np.cumsum(hit)])
        if (total[min(self.reach, len(hit)) :] - total[: len(total) - min(self.reach, len(hit))]).max() < self.bound.min():
            return
        x = np.flatnonzero(hit)
        key = np.searchsorted(self.keys, found[x])
        key[key == len(self.keys)] = 0
        real = self.keys[key] == found[x]
        x, key = x[real], key[real]
        if len(x):
            yield from self._items(codes, x + low, key, 0, len(self.codes))

    def _items(self, codes: np.ndarray, x: np.ndarray, key: np.ndarray, a: int, b: int):
        """Windows of the items from ``a`` to before ``b``; parts of them where they share too much."""
        n = len(self.codes)
        if (a, b) == (0, n):
            first, count = self.first[key], self.count[key]
        else:
            first = np.searchsorted(self.rank_item, key * n + a)
            count = np.searchsorted(self.rank_item, key * n + b) - first
        hits = int(count.sum())
        if hits > HITS and b - a > 1:
            half = (a + b) // 2
            yield from self._items(codes, x, key, a, half)
            yield from self._items(codes, x, key, half, b)
            return
        if not hits:
            return
        posting = np.repeat(first - np.cumsum(count) + count, count) + np.arange(hits)
        item, place = self.item[posting], self.place[posting]
        band = np.floor_divide(np.repeat(x, count) - place, self.budget[item] + 1)
        # A band and the next one below overlap by a whole step: two bands for each q-gram.
        item, place = np.tile(item, 2), np.tile(place, 2)
        band = np.concatenate([band, band - 1])
        order = np.lexsort((place, band, item))
        item, band, place = item[order], band[order], place[order]
        new = np.concatenate([[True], (item[1:] != item[:-1]) | (band[1:] != band[:-1])])
        group = np.cumsum(new) - 1
        # How many follow within a window: along all groups at once, as each has a range of its own.
        span = int(self.length.max()) + WINDOW + 1
        spot = group * span + place
        last = self.size[item] - self.q
        within = np.searchsorted(spot, spot + last, side="right") - np.arange(len(spot))
        good = np.flatnonzero(within >= self.bound[item])
        if not len(good):
            return
        # A window that begins from one to the other has the bound's q-grams from here on.
        high = np.minimum(place[good], self.length[item[good]] - self.size[item[good]])
        low = np.maximum(0, place[good + self.bound[item[good]] - 1] - last[good])
        item, band, group = item[good], band[good], group[good]
        ends = [*np.flatnonzero(np.diff(group)) + 1, len(good)]
        for a, b in zip([0, *ends], ends):
            starts = np.unique(np.concatenate([np.arange(i, j + 1) for i, j in zip(low[a:b], high[a:b], strict=True)]))
            which = int(item[a])
            diagonal = int(band[a]) * (int(self.budget[which]) + 1)
            for i in range(0, len(starts), BATCH):
                yield from self.verify(codes, which, starts[i : i + BATCH], diagonal)

    def verify(self, codes: np.ndarray, item: int, starts: np.ndarray, diagonal: int):
        """Item, place in it, start, end and edits of the best alignment within a band of each of the
        item's windows that is good enough.

        The row after i characters of a window holds, for each diagonal d of the band, the edits
        of the best alignment that ends at document place i + d; a matrix has a row for each window.
        """
        size, k = int(self.size[item]), int(self.budget[item])
        width = 2 * (k + 1) + 2 * k
        lane = np.arange(width)
        whole, low, high = self.codes[item].astype(np.int64), int(starts[0]), int(starts[-1]) + size
        # Without edits a window stands on one diagonal: how many of its characters agree there.
        along = np.arange(low, high)
        where = diagonal - k + lane[:, None] + along
        inside = (where >= 0) & (where < len(codes))
        agree = inside & (codes[np.clip(where, 0, len(codes) - 1)] == whole[along])
        run = np.zeros((width, len(along) + 1), dtype=np.int32)
        np.cumsum(agree, axis=1, out=run[:, 1:])
        even = run[:, starts - low + size] - run[:, starts - low] == size
        done = even.any(axis=0)
        for i in np.flatnonzero(done):
            start = diagonal - k + int(even[:, i].argmax()) + int(starts[i])
            yield item, int(starts[i]), start, start + size, 0
        # The same lemma for grams half as long, on the band's diagonals only, spares most alignments.
        short = max(2, self.q // 2)
        shared = (run[:, short:] - run[:, :-short] == short).any(axis=0)
        count = np.concatenate([[0], np.cumsum(shared)])
        at = starts - low
        starts = starts[~done & (count[at + size - short + 1] - count[at] >= size - short + 1 - k * short)]
        if k == 0 or not len(starts):
            return
        part = whole[starts[:, None] + np.arange(size)]
        first = diagonal - k + starts[:, None]
        where = first + np.arange(width + size)
        inside = (where >= 0) & (where < len(codes))
        text = np.where(inside, codes[np.clip(where, 0, len(codes) - 1)].astype(np.int64), -1)
        far = np.int64(1) << np.int64(40)
        begin = first + lane
        row = np.where((begin < 0) | (begin > len(codes)), far, 0)
        for i in range(size):
            new = row + (text[:, i : i + width] != part[:, i : i + 1])
            new[~inside[:, i : i + width]] = far
            # A character of the window that the text lacks comes from the next diagonal.
            take = row[:, 1:] + 1 < new[:, :-1]
            new[:, :-1] = np.where(take, row[:, 1:] + 1, new[:, :-1])
            came = begin.copy()
            came[:, :-1] = np.where(take, begin[:, 1:], begin[:, :-1])
            # Characters that only the text has: running least, plus one for each step.
            slack = new - lane
            least = np.minimum.accumulate(slack, axis=1)
            source = np.maximum.accumulate(np.where(slack == least, lane, 0), axis=1)
            row, begin = least + lane, np.take_along_axis(came, source, axis=1)
            alive = row.min(axis=1) <= k
            if not alive.all():
                if not alive.any():
                    return
                row, begin, part, text, inside, first, starts = (
                    m[alive] for m in (row, begin, part, text, inside, first, starts)
                )
        best = row.argmin(axis=1)
        for i, j in enumerate(best):
            if row[i, j] <= k:
                yield item, int(starts[i]), int(begin[i, j]), int(first[i, 0] + size + j), int(row[i, j])

    def contains_any(self, text: str) -> bool:
        return next(self.regions(normalised(text)[0]), None) is not None

    def hits(self, text: str) -> list[tuple[int | None, int, int, int, int]]:
        """``item_id, start, end, windows, edits`` by item and passage: what windows of an item
        that overlap in the text span there (code points, end exclusive), how many places of the
        item these windows have, and the least edits of one."""
        codes, places = normalised(text)
        found: dict[int, list[tuple[int, int, int, int]]] = {}
        for item, at, start, end, edits in self.regions(codes):
            found.setdefault(item, []).append((start, end, at, edits))
        out = []
        for item, regions in sorted(found.items()):
            passages: list[list] = []
            for start, end, at, edits in sorted(regions):
                if not passages or start >= passages[-1][1]:
                    passages.append([start, end, set(), edits])
                now = passages[-1]
                now[1], now[3] = max(now[1], end), min(now[3], edits)
                now[2].add(at)
            for start, end, seen, edits in passages:
                out.append((self.item_ids[item], int(places[start]), int(places[end - 1]) + 1, len(seen), edits))
        return out


def indexes(benchmark: DataFrame, id_column: str = "item_id", text_column: str = "text") -> Iterator[Index]:
    """Indexes of the benchmark's blocks, one after the other.

    Items are dealt by a hash into as many blocks as their characters need, so what goes to the
    driver and the workers at once has a bound whatever the benchmark's size.
    """
    items = benchmark.select(
        F.col(f"`{id_column}`").cast("long").alias("item_id"),
        F.coalesce(F.col(f"`{text_column}`").cast("string"), F.lit("")).alias("text"),
    )
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = max(1, -(-chars // BLOCK_CHARS))
    for block in range(blocks):
        rows = items.where(F.pmod(F.xxhash64("item_id", "text"), F.lit(blocks)) == block)
        yield Index([(r["item_id"], r["text"]) for r in rows.orderBy("item_id", "text").collect()])


def find_passages(docs: DataFrame, benchmark: DataFrame, **columns: str) -> DataFrame:
    """``doc_id, item_id, start, end, windows, edits``: documents with passages of items.

    One row for each row of ``docs`` and passage in it where a window of an item occurs within its
    edits; windows that overlap in the document are one passage. A NULL or empty text has no passage; an item with fewer than ``Q`` characters is in none; NULL ids
    stay NULL; repeated rows and items give repeated results; empty tables give an empty result;
    other columns are ignored, whatever their names.
    """
    spark = docs.sparkSession
    schema = "doc_id long, item_id long, start long, end long, windows int, edits int"
    out = spark.createDataFrame([], schema)
    for index in indexes(benchmark):
        shared = spark.sparkContext.broadcast(index)

        def search(batches: Iterator[pd.DataFrame], shared=shared) -> Iterator[pd.DataFrame]:
            for batch in batches:
                rows = [
                    (None if pd.isna(doc) else int(doc), *hit)
                    for doc, text in zip(batch["doc_id"], batch["text"], strict=True)
                    for hit in shared.value.hits(text)
                ]
                frame = pd.DataFrame(rows, columns=["doc_id", "item_id", "start", "end", "windows", "edits"])
                yield frame.astype({"doc_id": "Int64", "item_id": "Int64"})

        out = out.unionByName(texts(docs, **columns).mapInPandas(search, schema))
    return out


def has_passage(benchmark_index, text: Column) -> Column:
    """Whether the text has a passage of the broadcast index."""

    @F.pandas_udf("boolean")
    def test(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for batch in series:
            yield pd.Series([benchmark_index.value.contains_any(x) for x in batch], dtype=bool)

    return test(F.coalesce(text.cast("string"), F.lit("")))


def decontaminate(docs: DataFrame, benchmark: DataFrame, text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` without a passage of any item, all columns as they were."""
    modest_batches(docs.sparkSession)
    out = docs
    for index in indexes(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(index)
        out = out.where(~has_passage(shared, F.col(f"`{text_column}`")))
    return out


def op9_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return find_passages(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
