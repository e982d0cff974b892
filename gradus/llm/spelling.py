"""Spelling variants grouped through Bloom-guided neighbourhoods.

Two words of a vocabulary are near if one inserted, deleted or replaced code point tells them
apart. Every word's deletions and replacements are generated as hashes only: a word's hash is a
sum over its code points, so an edit's hash is that sum with one term changed. The hashes are
probed against blocked Bloom filters, one for each word length, made in segments by as many tasks
and broadcast. What a filter lets through (the near words and about one false edit per word) is written out as text,
shuffled and joined with the vocabulary exactly, which removes what is false.

Insertions need no probe: they are the deletions of the other word. Of two words that differ by a
replacement the one with the smaller letter generates the pair, and of a run of equal letters only
the first is deleted, so each pair of near words comes out once.

Filters take 2 bytes a word. Those that are broadcast together are held to ``ROUND_BYTES``; a larger
vocabulary is probed in several rounds, each with its own filters, so the broadcast never grows with
the data and no word is left out.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm.common import mix64, table, texts
from gradus.session import write_out

LETTERS = "A-Za-zÀ-ÿ"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
LEAST_LENGTH, LEAST_COUNT = 7, 2
#: A word takes a near word as its form if that one is so many times as frequent.
FORM_RATIO = 10
#: A run of which the hash is a multiple of this loses a code point.
SLIP = 31

BITS_PER_WORD, BLOCK_BITS, PROBES = 16, 512, 6
#: Words of a filter's segment and of a generating task, about; bytes of the filters broadcast at once.
SEGMENT_WORDS, TASK_WORDS, ROUND_BYTES = 16_384, 20_000, 64 << 20
#: Edits that a task holds at once.
CELLS = 1_000_000


def slipped(run: Column, key: Column, slip: int = SLIP) -> Column:
    """``run`` without one code point where ``slip`` divides the CRC of key and run, else as it is."""
    h = F.crc32(F.concat(F.coalesce(key.cast("string"), F.lit("")), F.lit(":"), run).cast("binary"))
    at = (h % F.char_length(run)).cast("int")
    shorter = F.concat(run.substr(F.lit(1), at), run.substr(at + 2, F.char_length(run)))
    return F.when(h % slip == 0, shorter).otherwise(run)


def vocabulary(
    docs: DataFrame,
    least_length: int = LEAST_LENGTH,
    least_count: int = LEAST_COUNT,
    slip: int = SLIP,
    id_column: str = "doc_id",
    text_column: str = "text",
) -> DataFrame:
    """``word, n``: words of all texts with ``least_length`` code points and ``least_count`` occurrences.

    A word is a maximal run of letters with A-Z in lower case, after ``slipped``. Occurrences are
    counted before the shuffle, so a word with a third of them all is one row a task. A NULL text
    has no words, a NULL identifier hashes as empty text, rows that repeat count again.
    """
    # Shorter runs can't become words, and a run this long is matched from its first letter.
    pattern = F.lit(f"[{LETTERS}]{{{least_length},}}")
    runs = texts(docs, id_column, text_column).select(
        "doc_id", F.explode(F.regexp_extract_all("text", pattern, 0)).alias("run")
    )
    word = slipped(F.translate("run", UPPER, LOWER), F.col("doc_id"), slip)
    words = runs.select(word.alias("word")).where(F.char_length("word") >= least_length)
    return words.groupBy("word").agg(F.count("*").alias("n")).where(F.col("n") >= least_count)


def _places(length: int) -> np.ndarray:
    """An odd multiplier for each place of a word."""
    return mix64(np.arange(1, length + 1, dtype=np.uint64)) | np.uint64(1)


def _codes(words: list[str], length: int) -> np.ndarray:
    """Code points of words of one length, a row each."""
    data = "".join(words).encode("utf-32-le", "surrogatepass")
    return np.frombuffer(data, dtype="<u4").reshape(len(words), length).astype(np.uint64)


def _by_length(words: pd.Series) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """Length, positions in the batch and code points of the words of each length."""
    lengths = words.str.len().to_numpy()
    for length in np.unique(lengths):
        at = np.flatnonzero(lengths == length)
        yield int(length), at, _codes(words.iloc[at].tolist(), int(length))


def _sums(codes: np.ndarray) -> np.ndarray:
    return (codes * _places(codes.shape[1])).sum(axis=1, dtype=np.uint64)


def _part(hashes: np.ndarray, parts: int) -> np.ndarray:
    return ((hashes & np.uint64(0xFFFFFF)) % np.uint64(parts)).astype(np.int64)


def _slots(hashes: np.ndarray, blocks: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """The block of each mixed hash and its bits within the block."""
    block = ((hashes >> np.uint64(32)) * np.uint64(blocks)) >> np.uint64(32)
    more = mix64(hashes ^ np.uint64(0x9E3779B97F4A7C15))
    mask = np.uint64(BLOCK_BITS - 1)
    return block, [(more >> np.uint64(9 * j)) & mask for j in range(PROBES)]


def make_filter(hashes: np.ndarray, blocks: int) -> np.ndarray:
    """A blocked Bloom filter of mixed hashes: blocks of eight 64-bit words."""
    out = np.zeros(blocks * (BLOCK_BITS // 64), dtype=np.uint64)
    block, bits = _slots(hashes, blocks)
    for bit in bits:
        cell = block * np.uint64(BLOCK_BITS // 64) + (bit >> np.uint64(6))
        np.bitwise_or.at(out, cell.astype(np.int64), np.uint64(1) << (bit & np.uint64(63)))
    return out


def probe(bloom: np.ndarray, hashes: np.ndarray, blocks: int, segment: np.ndarray | int = 0) -> np.ndarray:
    """Positions of the hashes that their segment of the filter lets through."""
    words = np.uint64(BLOCK_BITS // 64)
    left = np.arange(len(hashes))
    block, bits = _slots(hashes, blocks)
    start = (block + np.asarray(segment, dtype=np.uint64) * np.uint64(blocks)) * words
    for bit in bits:
        own = bit[left]
        cell = start[left] + (own >> np.uint64(6))
        left = left[(bloom[cell.astype(np.int64)] >> (own & np.uint64(63))) & np.uint64(1) == 1]
    return left


class Shape:
    """How many segments the filter of each length has, and how many blocks a segment."""

    def __init__(self, counts: dict[int, int], segment_words: int):
        self.counts = counts
        self.parts = {length: math.ceil(n / segment_words) for length, n in counts.items()}
        self.blocks = {
            length: math.ceil(n / self.parts[length] * BITS_PER_WORD / BLOCK_BITS) for length, n in counts.items()
        }

    def rounds(self, room: int) -> list[list[tuple[int, int]]]:
        """All (length, part) in order, in lists whose filters take up to ``room`` bytes, or one segment."""
        out, left = [[]], room
        for length in sorted(self.parts):
            size = self.blocks[length] * BLOCK_BITS // 8
            for part in range(self.parts[length]):
                if size > left and out[-1]:
                    out.append([])
                    left = room
                out[-1].append((length, part))
                left -= size
        return out


def _segments(words: DataFrame, shape: Shape) -> DataFrame:
    """``length, part, bloom``: the filters of a written vocabulary, a segment of each in a task."""

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for length, _, codes in _by_length(batch["word"]):
                hashes = mix64(_sums(codes))
                part = _part(hashes, shape.parts[length])
                yield pd.DataFrame({"length": length, "part": part, "hash": hashes.view(np.int64)})

    def build(key: tuple, rows: pd.DataFrame) -> pd.DataFrame:
        bloom = make_filter(rows["hash"].to_numpy().view(np.uint64), shape.blocks[int(key[0])])
        return pd.DataFrame({"length": [key[0]], "part": [key[1]], "bloom": [bloom.tobytes()]})

    placed = words.select("word").mapInPandas(place, "length int, part int, hash long")
    return placed.groupBy("length", "part").applyInPandas(build, "length int, part int, bloom binary")


def _edits(codes: np.ndarray, alphabet: np.ndarray, shorter: bool, same: bool):
    """Blocks of edits of words of one length: their length, and (row, place, letter or 0 for a
    deletion, sum) of each."""
    n, length = codes.shape
    terms, sums = codes * _places(length), _sums(codes)
    if shorter:
        # Without the letter at i: the terms before it, and those behind it moved by one place.
        head = np.cumsum(terms, axis=1, dtype=np.uint64) - terms
        moved = np.zeros_like(codes)
        moved[:, :-1] = codes[:, 1:] * _places(length)[:-1]
        tail = np.cumsum(moved[:, ::-1], axis=1, dtype=np.uint64)[:, ::-1]
        first = np.ones(codes.shape, dtype=bool)
        first[:, 1:] = codes[:, 1:] != codes[:, :-1]
        row, place = np.nonzero(first)
        yield length - 1, (row, place, np.zeros(len(row), dtype=np.uint64), (head + tail)[row, place])
    if same:
        wide = max(1, CELLS // len(alphabet))
        high = max(1, wide // length)
        for a in range(0, n, high):
            for b in range(0, length, wide):
                some = codes[a : a + high, b : b + wide]
                row, place, letter = np.nonzero(some[:, :, None] < alphabet)
                row, place, new = row + a, place + b, alphabet[letter]
                change = (new - codes[row, place]) * _places(length)[place]
                yield length, (row, place, new, sums[row] + change)


def _candidates(
    words: DataFrame, blooms: dict[int, tuple[int, int, np.ndarray]], shape: Shape, alphabet: np.ndarray
) -> DataFrame:
    """``word, n, near``: each word with its edits that the given filters let through, written out.

    A filter is the array of the parts from a first to before a last one.
    """
    shared = words.sparkSession.sparkContext.broadcast(blooms)

    def text(codes: np.ndarray, place: int, letter: int) -> str:
        new = np.delete(codes, place) if letter == 0 else codes.copy()
        if letter:
            new[place] = letter
        return new.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")

    def generate(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        filters = shared.value
        for batch in batches:
            for length, at, codes in _by_length(batch["word"]):
                # A length with one word only has no near word of the same length.
                shorter, same = length - 1 in filters, length in filters and shape.counts[length] > 1
                for goal, (row, place, letter, sums) in _edits(codes, alphabet, shorter, same):
                    first, last, bloom = filters[goal]
                    hashes = mix64(sums)
                    part = _part(hashes, shape.parts[goal])
                    mine = np.flatnonzero((part >= first) & (part < last))
                    hits = mine[probe(bloom, hashes[mine], shape.blocks[goal], part[mine] - first)]
                    if len(hits):
                        own = batch.iloc[at[row[hits]]]
                        near = [text(codes[row[i]], place[i], int(letter[i])) for i in hits]
                        yield pd.DataFrame({"word": own["word"].to_numpy(), "n": own["n"].to_numpy(), "near": near})

    found = words.select("word", "n").mapInPandas(generate, "word string, n long, near string")
    found = write_out(found, "spelling-found")
    shared.destroy()  # the next round's filters take their place
    return found


def near_pairs(
    words: DataFrame, segment_words: int = SEGMENT_WORDS, round_bytes: int = ROUND_BYTES
) -> DataFrame:
    """``word, n, near, near_n``: every unordered pair of near words of a written vocabulary, once."""
    rows = words.groupBy(F.char_length("word").alias("length")).agg(F.count("*").alias("n")).collect()
    shape = Shape({r["length"]: r["n"] for r in rows}, segment_words)  # a row for each length of a word
    letters = words.select(F.explode(F.split("word", "")).alias("letter")).where("letter != ''").distinct()
    alphabet = np.array(sorted(ord(r[0]) for r in letters.collect()), dtype=np.uint64)  # 90 at most
    segments = write_out(_segments(words, shape), "spelling-filters")
    # The written vocabulary is a few files; generating edits is worth more tasks.
    dealt = words.repartition(math.ceil(sum(shape.counts.values()) / TASK_WORDS), "word")
    found = None
    for wanted in shape.rounds(round_bytes):
        low, high = (F.struct(*[F.lit(x) for x in end]) for end in (wanted[0], wanted[-1]))
        blooms = {}
        for length in sorted({length for length, _ in wanted}):
            own = [part for other, part in wanted if other == length]
            size = shape.blocks[length] * BLOCK_BITS // 64
            blooms[length] = own[0], own[-1] + 1, np.zeros(size * len(own), dtype=np.uint64)
        for r in segments.where(F.struct("length", "part").between(low, high)).collect():
            first, _, bloom = blooms[r["length"]]
            segment = np.frombuffer(bytes(r["bloom"]), dtype=np.uint64)
            bloom[(r["part"] - first) * len(segment):][:len(segment)] = segment
        some = _candidates(dealt, blooms, shape, alphabet)
        found = some if found is None else found.unionByName(some)
    known = words.select(F.col("word").alias("near"), F.col("n").alias("near_n"))
    return found.join(known, "near").select("word", "n", "near", "near_n")


def roots(forms: DataFrame) -> DataFrame:
    """``word, root`` of words that have a form: forms followed to the last, doubling each step.

    A form is ``FORM_RATIO`` times as frequent as its word, so there are no cycles and paths are
    short: four rounds reach the end of any path of 16 forms.
    """
    step = write_out(forms.select("word", F.col("form").alias("root")), "spelling-roots")
    while True:
        further = step.select(F.col("word").alias("root"), F.col("root").alias("next"))
        joined = step.join(further, "root", "left")
        moved = write_out(
            joined.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            "spelling-roots",
        )
        step = moved.select("word", "root")
        if moved.where("moved").isEmpty():
            return step


def variants(
    words: DataFrame, ratio: int = FORM_RATIO, segment_words: int = SEGMENT_WORDS, round_bytes: int = ROUND_BYTES
) -> DataFrame:
    """``word, form, root, n, n_near, form_n`` for every row of ``word, n``.

    ``form`` is the near word with the largest count (of equal ones the first in code-point order)
    if that is ``ratio`` times the word's own, else NULL; ``root`` is where following the forms ends.
    An empty vocabulary gives an empty result; a word of any length is compared.
    """
    words = write_out(words.select("word", "n"), "spelling-words")
    if words.isEmpty():
        empty = F.lit(None).cast("string")
        return words.select(
            "word", empty.alias("form"), empty.alias("root"), "n",
            F.lit(0).cast("long").alias("n_near"), F.lit(None).cast("long").alias("form_n"),
        )
    pairs = write_out(near_pairs(words, segment_words, round_bytes), "spelling-pairs")
    back = pairs.select(
        F.col("near").alias("word"), F.col("near_n").alias("n"), F.col("word").alias("near"), F.col("n").alias("near_n")
    )
    best = F.struct((-F.col("near_n")).alias("minus"), F.col("near").alias("word"))
    alone = words.select("word", "n", F.lit(None).cast("string").alias("near"), F.lit(None).cast("long").alias("near_n"))
    seen = (
        alone.unionByName(pairs)
        .unionByName(back)
        .groupBy("word")
        .agg(
            F.max("n").alias("n"),
            F.count("near").alias("n_near"),
            F.min(F.when(F.col("near").isNotNull(), best)).alias("best"),
        )
    )
    taken = -F.col("best.minus") >= ratio * F.col("n")
    seen = write_out(
        seen.select(
            "word", "n", "n_near",
            F.when(taken, F.col("best.word")).alias("form"), F.when(taken, -F.col("best.minus")).alias("form_n"),
        ),
        "spelling-forms",
    )
    ends = roots(seen.where("form IS NOT NULL"))
    return seen.join(ends, "word", "left").select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n"
    )


def op12_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(vocabulary(table(spark, sf_dir, "documents")))
