"""Toxicity of texts whose words may be disguised.

A noisy channel turns a written word into what is read: letters become look-alikes, are repeated
or spaced apart. What may be disguised (a look-alike beside letters, a letter twice or more,
short tokens in a row, whose blanks may be none) spans a lattice of readings; Viterbi decoding
takes the reading that a character trigram model of the whole corpus and the channel make
likeliest. A word without such marks has one reading, itself, and is not decoded. The restored
words are scored by log-odds of words and word beginnings learnt from labelled rows.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field
from zlib import crc32

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm.common import Memo, held_out, labelled_sample, platt, table, texts
from gradus.session import write_out

#: Labelled rows that are learnt from, at most about so many.
FIT_ROWS = 40_000
#: Features kept, at most; they must be seen in so many unlike toxic documents at least.
FEATURES, SUPPORT, LEAST_ODDS = 20_000, 4.0, 2.0
#: A feature seen in so many unlike toxic documents keeps half of its log-odds.
SHRINK = 3.0
#: Lengths of word beginnings that are features beside the whole word.
BEGINNINGS = (4, 5, 6, 7)
DECAY = 0.6
TOXIC = 0.5

# Letters that a look-alike may stand for.
LOOK_ALIKES = {
    "0": "o", "1": "il", "2": "z", "3": "e", "4": "a", "5": "s", "6": "g", "7": "t", "8": "b",
    "9": "g", "@": "a", "$": "s", "!": "i", "|": "il", "+": "t", "€": "e", "£": "l", "(": "c",
    "¡": "i", "¢": "c", "ø": "o", "*": "aeiou", "#": "h", "%": "o",
}
#: The alphabet of the language model: blank, letters, digits, all other characters as one.
LETTERS = "abcdefghijklmnopqrstuvwxyzàáâãäåæçèéêëìíîïñòóôõöùúûüýÿßœ"
ALPHABET = " " + LETTERS + "0123456789"
OTHER = len(ALPHABET)
RADIX = 80
#: Log-probabilities of the channel: a character as it is, one that is a look-alike by its kind
#: but stands for itself beside letters, one that stands for a letter, a dropped repetition; of a
#: letter written twice that is one; of a blank between short tokens that is one, or none.
AS_IS, ITSELF, ALIKE, DROPPED = math.log(0.9), math.log(0.1), math.log(0.3), math.log(0.2)
DOUBLED, KEPT, CLOSED = math.log(0.01), math.log(0.85), math.log(0.15)
#: Characters of a token, at most, that may be a piece of a spaced word.
SHORT = 3
#: Characters of a word, or pieces of a row, whose outline is looked at first.
BEGINS = 6
#: Entries of a memo of the channel.
MEMO = 300_000

_MARKS = "".join(LOOK_ALIKES)
_SUSPECT = re.compile(rf"[{re.escape(_MARKS)}]|(.)\1")
_LETTER = re.compile(r"[^\W\d_]")
_ENDS = re.compile(r"^[\W_]+|[\W_]+$")
_TAIL = re.compile(r"([^\w])\1+$|[.,;:?\"')\]}…»]+$")
_HEAD = re.compile(r"^[\"'(\[{«¿.,;:]+")
_JOINED = re.compile(r"^\w(?:[.\-_*·~/]+\w){2,}$")
_DOUBLE = re.compile(r"(.)\1")
_SEPARATORS = re.compile(r"[.\-_*·~/]+")
_RUNS = re.compile(r"(.)\1+")
_PIECE = re.compile(rf"[\w{re.escape(_MARKS)}]{{1,{SHORT}}}")


def _classes() -> dict[int, str]:
    """A class for each character: look-alikes and all letters that they may stand for are one."""
    one: dict[str, str] = {}

    def find(c: str) -> str:
        while one.setdefault(c, c) != c:
            c = one[c]
        return c

    for mark, letters in LOOK_ALIKES.items():
        for letter in letters:
            one[find(letter)] = find(mark)
    return {ord(c): find(c) for c in list(one)}


_CLASSES = _classes()


def outline(written: str) -> str:
    """What all readings of a word have in common: the classes of its characters, each run once."""
    return _RUNS.sub(r"\1", written.translate(_CLASSES))


def symbol_table() -> np.ndarray:
    """Symbol number of each character below U+0250; blanks count as a blank."""
    out = np.full(0x250, OTHER, dtype=np.int64)
    for i, c in enumerate(ALPHABET):
        out[ord(c)] = i
    for c in "\t\n\r\x0b\x0c\xa0":
        out[ord(c)] = 0
    return out


def symbols(text: str, numbers: np.ndarray) -> np.ndarray:
    codes = np.frombuffer(text.lower().encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return np.where(codes < 0x250, numbers[np.minimum(codes, 0x24F)], OTHER)


def trigram_counts(docs: DataFrame) -> DataFrame:
    """``trigram, n`` over every whole text, blanks around it.

    Each task sums into one array of fixed size; the shuffle has at most RADIX cubed rows a task.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        numbers, total = symbol_table(), np.zeros(RADIX**3, dtype=np.int64)
        held, size = [], 0

        def add() -> None:
            # Two blanks between texts, so that no trigram spans two of them.
            x = symbols("  " + "  ".join(held) + "  ", numbers)
            index = x[:-2] * (RADIX * RADIX) + x[1:-1] * RADIX + x[2:]
            np.add(total, np.bincount(index, minlength=RADIX**3), out=total)

        for batch in batches:
            for text in batch["text"]:
                held.append(text)
                size += len(text)
                if size > 500_000:
                    add()
                    held, size = [], 0
        if held:
            add()
        seen = np.flatnonzero(total)
        yield pd.DataFrame({"trigram": seen.astype(np.int32), "n": total[seen]})

    partial = texts(docs).select("text").mapInPandas(count, "trigram int, n long")
    return partial.groupBy("trigram").agg(F.sum("n").alias("n"))


@dataclass
class Channel:
    """The language model: ``table[a, b, c]`` is the log-probability of c behind a and b."""

    table: np.ndarray
    numbers: dict[str, int] = field(default_factory=lambda: {c: i for i, c in enumerate(ALPHABET)})
    #: Memos: the piece that a short token is, the fixed ends of a piece, whether a blank between such ends stays.
    pieces: dict[str, str] = field(default_factory=dict)
    ends: dict[str, tuple[str, str]] = field(default_factory=dict)
    stays: dict[str, bool] = field(default_factory=dict)

    @classmethod
    def learn(cls, counts: pd.DataFrame) -> Channel:
        """Trigram, pair and single probabilities, interpolated."""
        three = np.zeros(RADIX**3)
        three[counts["trigram"].to_numpy()] = counts["n"].to_numpy()
        three = three.reshape(RADIX, RADIX, RADIX)
        two, one = three.sum(0), three.sum((0, 1))
        p1 = (one + 1) / (one.sum() + RADIX)
        p2 = (two + 5 * p1) / (two.sum(1, keepdims=True) + 5)
        p3 = (three + 5 * p2[None]) / (three.sum(2, keepdims=True) + 5)
        return cls(np.log(p3).astype(np.float32))

    def lattice(self, written: str) -> list[list[tuple[str, float]]]:
        """One list of (reading, channel log-probability) per run of a character."""
        steps = []
        i = 0
        while i < len(written):
            c, j = written[i], i
            while j < len(written) and written[j] == c:
                j += 1
            run = j - i
            options = []
            for letter in dict.fromkeys((c, *LOOK_ALIKES.get(c, ""))):
                each = ALIKE if letter != c else ITSELF if c in LOOK_ALIKES else AS_IS
                if run <= 2:
                    options.append((letter * run, each * run))
                    if run == 2:
                        options.append((letter, each + DOUBLED))
                else:
                    options += [(letter, each + DROPPED), (letter * 2, 2 * each + DROPPED)]
            if run > 2 and c in LOOK_ALIKES:
                options.append((c * run, ITSELF * run))
            beside = {written[i - 1 : i], written[j : j + 1]} - {""}
            if beside & set(LOOK_ALIKES.get(c, "")):
                options.append(("", ALIKE * run + DROPPED))  # one letter repeated in two guises
            steps.append(options)
            i = j
        return steps

    def parts(self, row: list[str]) -> Iterator[str]:
        """The parts of a row of short tokens whose readings hang together, of two tokens or more.

        Where the two characters on either side of a blank have one reading each, what is read
        before and behind doesn't hang on that blank: whether it stays is a matter of those
        four characters. A row is cut where it does; decoding the parts is decoding the row.
        """
        start, before = 0, ""
        for i, piece in enumerate(row):
            fixed = self.ends.get(piece)
            if fixed is None:
                if len(self.ends) > MEMO:
                    self.ends.clear()
                fixed = self.ends[piece] = _fixed_ends(piece)
            if before and fixed[0]:
                four = before + fixed[0]
                kept = self.stays.get(four)
                if kept is None:
                    if len(self.stays) > MEMO:
                        self.stays.clear()
                    kept = self.stays[four] = self._kept(four)
                if kept:
                    if i - start > 1:
                        yield " ".join(row[start:i])
                    start = i
            before = fixed[1]
        if len(row) - start > 1:
            yield " ".join(row[start:])

    def _kept(self, four: str) -> bool:
        p, q, r, s = (self.numbers.get(c, OTHER) for c in four)
        logs = self.table
        kept = KEPT + logs[p, q, 0] + logs[q, 0, r] + logs[0, r, s]
        return bool(kept >= CLOSED + logs[p, q, r] + logs[q, r, s])

    def decode(self, written: str) -> str:
        """The likeliest reading of a word, or of a row of short tokens, each of whose blanks is
        one or none; the first of equals in the lattice's order."""
        steps: list[list[tuple[str, float]]] = []
        for piece in written.split(" "):
            if steps:
                steps.append([(" ", KEPT), ("", CLOSED)])
            steps += self.lattice(piece)
        numbers, logs = self.numbers, self.table
        best: dict[tuple[int, int], tuple[float, tuple]] = {(0, 0): (0.0, ())}
        for options in steps:
            new: dict[tuple[int, int], tuple[float, tuple]] = {}
            for (a, b), (score, path) in best.items():
                for reading, cost in options:
                    x, y, total = a, b, score + cost
                    for c in reading:
                        z = numbers.get(c, OTHER)
                        total += logs[x, y, z]
                        x, y = y, z
                    if (x, y) not in new or total > new[x, y][0]:
                        new[x, y] = (total, (path, reading))
            best = new
        ends = ((score + logs[a, b, 0], path) for (a, b), (score, path) in best.items())
        path, readings = max(ends, key=lambda end: end[0])[1], []
        while path:  # a chain, as a row may be as long as its text
            path, reading = path
            readings.append(reading)
        return "".join(reversed(readings))

    def restore(self, token: str) -> str:
        """A token (lower case) as it is read, punctuation around it gone; of a row of short
        tokens the words that it is read as, with blanks between them."""
        if " " in token:
            return " ".join(_ENDS.sub("", word) for word in self.decode(token).split())
        if _JOINED.match(token) and _LETTER.search(token):
            token = _SEPARATORS.sub("", token)
        if token.isalpha() and not _DOUBLE.search(token):
            return token
        word = _HEAD.sub("", _TAIL.sub("", token))
        if _SUSPECT.search(word) and _LETTER.search(word):
            word = self.decode(word)
        return _ENDS.sub("", word)


def _fixed_ends(piece: str) -> tuple[str, str]:
    """The first two and the last two characters of a piece, empty where they have several readings."""

    def fixed(i: int, j: int) -> bool:
        around = piece[max(i - 1, 0) : j + 1]
        return not any(c in LOOK_ALIKES for c in piece[i:j]) and not _DOUBLE.search(around)

    n = len(piece)
    if n < 2:
        return "", ""
    return piece[:2] if fixed(0, 2) else "", piece[-2:] if fixed(n - 2, n) else ""


def _piece(part: str) -> str:
    """A short token less the punctuation around it, empty if it is no piece of a spaced word."""
    piece = part if part.isalnum() else _HEAD.sub("", _TAIL.sub("", part))
    return piece if _PIECE.fullmatch(piece) else ""


def features(word: str) -> list[str]:
    """The word and its beginnings (marked, so that they differ from words)."""
    return [word, *[f"{word[:n]}-" for n in BEGINNINGS if len(word) >= n]]


def tokens(text: str, channel: Channel) -> set[str]:
    """The distinct tokens of a text in lower case, and the parts of its rows of short ones with a
    blank between them, whatever blanks the text has there."""
    parts, pieces = text.lower().split(), channel.pieces
    found = set(parts)
    row: list[str] = []
    for part in [*parts, ""]:
        if part and len(part) <= SHORT + 2:
            piece = pieces.get(part)
            if piece is None:
                if len(pieces) > MEMO:
                    pieces.clear()
                piece = pieces[part] = _piece(part)
            if piece:
                row.append(piece)
                continue
        if len(row) > 1:
            found.update(joined for joined in channel.parts(row) if _LETTER.search(joined))
        row = []
    return found


def read(text: str, restored: dict[str, str], channel: Channel) -> set[str]:
    """The words that a text is read as: its tokens and rows restored."""
    return {word for token in tokens(text, channel) for word in restored[token].split()}


@dataclass
class Model:
    channel: Channel
    odds: dict[str, float]
    curve: tuple[float, float]

    def __post_init__(self) -> None:
        #: Outlines of what a word with evidence begins with, and of those that are shorter.
        self.heads = {outline(f[:4]) for f in self.odds if len(f) >= 4}
        self.shorts = {outline(f) for f in self.odds if len(f) < 4}
        #: Memos: whether one of them begins what begins so, in a row of tokens and in a word.
        self.verdicts: tuple[dict[str, bool], dict[str, bool]] = {}, {}

    def strongest(self, word: str) -> float:
        """Evidence of a restored word: the highest log-odds of its features, 0 at least."""
        odds = self.odds
        return max((odds.get(f, 0.0) for f in features(word)), default=0.0)

    def hopeless(self, token: str) -> bool:
        """Whether no reading of a token or row has evidence, as its outline begins like that of no
        word that has. A word of a row begins where one of its tokens does."""
        if " " in token:
            pieces, verdicts = token.split(" "), self.verdicts[0]
            begins = ["".join(pieces[i : i + BEGINS]) for i in range(len(pieces))]
            shorts = self.heads | self.shorts if self.shorts else self.heads

            def whole(i: int) -> str:
                return "".join(pieces[i:])
        else:
            if not token.isalpha() and _JOINED.match(token) and _LETTER.search(token):
                token = _SEPARATORS.sub("", token)
            begins, shorts = [token if token.isalpha() else _HEAD.sub("", _TAIL.sub("", token))], self.heads
            whole, verdicts = begins.__getitem__, self.verdicts[1]
        for i, word in enumerate(begins):
            if not word[:1].isalnum():
                return False  # what is stripped from its reading isn't known
            # Four characters of an outline decide; few characters mostly have that many.
            known = verdicts.get(word[:BEGINS])
            if known is None:
                if len(verdicts) > MEMO:
                    verdicts.clear()
                shape = outline(word[:BEGINS])
                enough = len(shape) >= 4 or len(word) < BEGINS
                if not enough:
                    shape = outline(whole(i))
                known = any(shape[:n] in shorts for n in (1, 2, 3, 4)) or shape in self.shorts
                if enough:
                    verdicts[word[:BEGINS]] = known
            if known:
                return False
        return True

    def weigh(self, token: str) -> tuple[tuple[float, str], ...]:
        """Evidence of the words that a token or row is read as, and the words where it counts."""
        if self.hopeless(token):
            return ()
        words = self.channel.restore(token).split()
        return tuple((value, word) for word in words if (value := self.strongest(word)))

    def weigher(self) -> Memo:
        return Memo(self.weigh, 250_000)


def evidence(text: str, weigher: Memo, channel: Channel) -> float:
    """The strongest word counts whole, each next one ``DECAY`` times as much as before."""
    found = sorted(set().union(*map(weigher.__getitem__, tokens(text, channel))), reverse=True)
    return sum(value * DECAY**i for i, (value, _) in enumerate(found))


def _kin(text: str) -> int:
    """A number that near copies mostly share: the least hash of three words in a row."""
    words = text.lower().split()
    if len(words) < 3:
        return crc32(text.encode("utf-8"))
    return min(crc32(" ".join(words[i : i + 3]).encode("utf-8")) for i in range(len(words) - 2))


def feature_counts(rows: DataFrame, channel: Channel, only: frozenset[str] | None = None) -> DataFrame:
    """``feature, n``: the weight of the ``text, weight`` rows that have a feature, of some features or of all.

    Tasks sum in bounded dicts, Spark sums the rest.
    """
    shared = rows.sparkSession.sparkContext.broadcast((channel, only))

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        channel, only = shared.value
        restored = Memo(channel.restore, 200_000)
        sums: Counter[str] = Counter()

        def wanted(token: str) -> tuple[str, ...]:
            words = channel.restore(token).split()
            return tuple({f for word in words for f in features(word)} & only)

        kept = Memo(wanted, 200_000)

        def found(text: str) -> set[str]:
            if only is None:
                return {f for word in read(text, restored, channel) for f in features(word)}
            return set().union(*map(kept.__getitem__, tokens(text, channel)))

        def flush() -> pd.DataFrame:
            out = pd.DataFrame({"feature": list(sums), "n": list(sums.values())})
            sums.clear()
            return out.astype({"feature": str, "n": float})

        for batch in batches:
            for text, weight in zip(batch["text"], batch["weight"], strict=True):
                for f in found(text):
                    sums[f] += weight
                if len(sums) > 400_000:
                    yield flush()
        yield flush()

    counts = rows.select("text", "weight").mapInPandas(count, "feature string, n double")
    return counts.groupBy("feature").agg(F.sum("n").alias("n"))


def learn_odds(sample: DataFrame, channel: Channel) -> dict[str, float]:
    """Log-odds of the features that mark toxic texts, from ``label, text, weight`` rows.

    A document counts as one over its number of near copies, so that a copied passage does not
    pass for a habit. Features are found in the toxic rows; in all others only those that enough
    toxic rows have are counted, as no other is kept.
    """
    sums = sample.groupBy("label").agg(F.sum("weight").alias("n")).collect()
    total = {row["label"]: float(row["n"]) for row in sums}
    t_all, c_all = total.get(1, 0.0) + 1, total.get(0, 0.0) + 1
    toxic = F.col("label") == 1
    seen = feature_counts(sample.where(toxic), channel).withColumnRenamed("n", "t").where(F.col("t") >= SUPPORT)
    seen = write_out(seen, "toxic-features")
    # Some thousands: each is in several unlike rows of a bounded sample.
    only = frozenset(row["feature"] for row in seen.select("feature").toLocalIterator())
    clean = feature_counts(sample.where(~toxic), channel, only).withColumnRenamed("n", "c")
    odds = F.log((F.col("t") + 0.5) / F.lit(t_all)) - F.log((F.col("c") + 0.5) / F.lit(c_all))
    odds = odds * F.col("t") / (F.col("t") + SHRINK)  # few documents are weak evidence
    counts = (
        seen.join(clean, "feature", "left")
        .na.fill(0.0, ["c"])
        .withColumn("odds", odds)
        .where(F.col("odds") >= LEAST_ODDS)
    )
    top = counts.orderBy(F.desc(F.col("t") * F.col("odds")), "feature").limit(FEATURES)
    return {row["feature"]: row["odds"] for row in top.collect()}


def fit(docs: DataFrame, labels: DataFrame, bound: int = FIT_ROWS) -> Model:
    """The model of ``labels.toxic``: character counts of all of ``docs``, log-odds and curve
    from at most about ``bound`` labelled rows. Without toxic rows every score is near 0."""
    channel = Channel.learn(trigram_counts(docs).toPandas())  # at most RADIX cubed rows
    sample = labelled_sample(docs, labels, "toxic", bound)
    kin = F.pandas_udf(lambda texts: texts.map(_kin).astype("int64"), "long")
    sample = write_out(sample.withColumn("kin", kin("text")), "toxic-sample")
    sizes = sample.groupBy("label", "kin").agg((1 / F.count("*")).alias("weight"))
    sample = write_out(sample.join(sizes, ["label", "kin"]), "toxic-weighted")
    model = Model(channel, learn_odds(sample, channel), (1.0, -4.0))
    # Evidence in tenths, by label: a table of a few hundred rows is all that the driver gets.
    levels = (
        evidences(sample.select("doc_id", "text", "label", "weight"), model)
        .groupBy(F.round("evidence", 1).alias("level"), "label")
        .agg(F.sum("weight").alias("n"))
        .orderBy("level", "label")
        .toPandas()
    )
    if len(levels):
        model.curve = platt(levels["level"], levels["label"], levels["n"])
    return model


def evidences(rows: DataFrame, model: Model) -> DataFrame:
    """``rows`` with ``evidence`` in place of ``text``."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    @F.pandas_udf("double")
    def weigh(series: Iterator[pd.Series]) -> Iterator[pd.Series]:
        weigher, channel = shared.value.weigher(), shared.value.channel
        for batch in series:
            yield pd.Series([evidence(text, weigher, channel) for text in batch], dtype=float)

    return rows.withColumn("evidence", weigh("text")).drop("text")


def score(docs: DataFrame, model: Model, toxic: float = TOXIC) -> DataFrame:
    """``doc_id, held_out, score, predicted, evidence`` of every row of ``docs``.

    Narrow: one pass; the model has a fixed size. A NULL text is empty; a text without words has
    no evidence and the least score; a NULL id counts as held out; repeated rows get equal
    scores; other columns are ignored, whatever their names.
    """
    slope, offset = model.curve
    rows = texts(docs).withColumn("held_out", held_out("doc_id"))
    chance = 1 / (1 + F.exp(-(F.lit(slope) * F.col("evidence") + F.lit(offset))))
    return (
        evidences(rows, model)
        .withColumn("score", chance)
        .select(
            "doc_id",
            "held_out",
            "score",
            (F.col("score") >= toxic).cast("int").alias("predicted"),
            "evidence",
        )
    )


def op3_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return score(docs, fit(docs, table(spark, sf_dir, "labels")))
