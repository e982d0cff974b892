"""Chat transcripts parsed by a hidden Markov model, then rendered in canonical turns.

A transcript is a row of records in order; a record's lines are observations: which speaker
marker a line begins with, whether a gap (blank line or record edge) is before it, how long it
is and whether it asks. States are the roles, each at the beginning of a turn and inside one.
Starts, transitions and features are counted by Spark over the records whose role is given;
Viterbi decoding recovers the roles of all others.

A long transcript is decoded in chunks: the best score from every state before a chunk to every
state at its end is a small matrix, the chunks' matrices give the states at the edges, and each
chunk is then decoded between its edges. The path is that of decoding in one go. One task sees a
transcript's matrices together: some 300 bytes for 512 turns, 6 MB for ten million turns.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus.llm.common import held_out, table
from gradus.session import write_out

ROLES = ("system", "user", "assistant")
STATES = 2 * len(ROLES)  # a role's number times two, plus one inside a turn
#: Turn numbers in a chunk, and records of one (transcript, chunk) beyond which it is split.
CHUNK_TURNS, CHUNK_RECORDS = 512, 4096
#: Copies of one record that a task writes, at most.
COPIES_A_TASK = 100_000

# What transcripts write before a turn, by role.
MARKERS = {
    "system": ["system", "instructions", "context"],
    "user": ["user", "human", "question", "q", "customer", "me", "inst", "prompter"],
    "assistant": ["assistant", "ai", "bot", "answer", "a", "agent", "gpt", "model", "response"],
}
_NAMES = {name: role for role, names in MARKERS.items() for name in names}
_WORD = "|".join(sorted(_NAMES, key=len, reverse=True))
_MARKER = re.compile(
    rf"^\s*(?:[#>*\-]+\s*)?(?:<\|?|\[/?|\*\*)?\s*({_WORD})\s*(?:\|?>|\]|\*\*)?\s*(?::\s*(?:\*\*)?|(?<=[>\]])\s*|$)",
    re.IGNORECASE,
)
LENGTHS = 12
#: Share of turns that begin with their role's marker, and of lines that begin with a wrong one.
MARKED, MISMARKED = 0.2, 1e-6
SMOOTH = 0.5


def marker(line: str) -> tuple[int, str]:
    """Number of the role that the line's marker names (0: none), and the line behind it."""
    found = _MARKER.match(line)
    if not found or found.group(0).strip().lower() in ("a", "me", "q"):
        return 0, line  # a letter or pronoun alone is text
    return 1 + ROLES.index(_NAMES[found.group(1).lower()]), line[found.end() :]


def observe(text: str) -> list[int]:
    """Feature codes of the lines that aren't blank."""
    out, gap = [], 1
    for line in text.splitlines():
        if not line.strip():
            gap = 1
            continue
        size = min(LENGTHS - 1, len(line).bit_length())
        asks = int(line.rstrip()[-1] in "?？")
        out.append(((marker(line)[0] * 2 + gap) * LENGTHS + size) * 2 + asks)
        gap = 0
    return out


def _features(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    return codes // (4 * LENGTHS), codes // (2 * LENGTHS) % 2, codes // 2 % LENGTHS, codes % 2


@dataclass
class Model:
    """Log-probabilities: of the first state, of the next one, and of each feature in a state."""

    start: np.ndarray
    move: np.ndarray
    gap: np.ndarray
    size: np.ndarray
    asks: np.ndarray

    def emit(self, codes: np.ndarray) -> np.ndarray:
        """Log-probability of each line's features in each state."""
        marks, gaps, sizes, asks = _features(np.asarray(codes, dtype=np.int64))
        mark = np.full((len(ROLES) + 1, STATES), MISMARKED)
        mark[0] = 1.0
        for r in range(len(ROLES)):
            mark[0, 2 * r] = 1 - MARKED
            mark[1 + r, 2 * r] = MARKED
        return np.log(mark)[marks] + self.gap[gaps] + self.size[sizes] + self.asks[asks]

    def matrix(self, codes: np.ndarray) -> np.ndarray:
        """Best score from each state before the lines (the last row: from the start) to each at
        their end."""
        emitted = self.emit(codes)
        out = np.vstack([self.move, self.start]) + emitted[0]
        for row in emitted[1:]:
            out = (out[:, :, None] + self.move[None]).max(axis=1) + row
        return out

    def decode(self, codes: np.ndarray, before: int, last: int) -> np.ndarray:
        """The best states of the lines behind state ``before`` (``STATES``: the start), ending
        in state ``last`` (-1: any). The first of equals wins."""
        emitted = self.emit(codes)
        score = (self.start if before == STATES else self.move[before]) + emitted[0]
        back = []
        for row in emitted[1:]:
            every = score[:, None] + self.move
            back.append(every.argmax(axis=0))
            score = every.max(axis=0) + row
        state = int(score.argmax()) if last < 0 else last
        out = [state]
        for pointers in reversed(back):
            state = int(pointers[state])
            out.append(state)
        return np.array(out[::-1])


def edges(matrices: list[np.ndarray], model: Model) -> list[tuple[int, int]]:
    """State before and at the end of every chunk on the best path through all."""
    score, back = matrices[0][STATES], []
    for m in matrices[1:]:
        every = score[:, None] + m[:STATES]
        back.append(every.argmax(axis=0))
        score = every.max(axis=0)
    state = int(score.argmax())
    ends = [state]
    for pointers in reversed(back):
        state = int(pointers[state])
        ends.append(state)
    ends.reverse()
    return list(zip([STATES, *ends[:-1]], ends, strict=True))


def records(conversations: DataFrame) -> DataFrame:
    """``conv, own, turn, role, text, copies, codes``: distinct records, how often each is there, and
    its lines' features.

    ``own`` parts transcripts without an id: each of their records is a transcript by itself.
    """
    observed = F.pandas_udf(lambda texts: texts.map(observe), "array<int>")
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    rows = conversations.select(
        F.col("conv_id").cast("long").alias("conv"),
        F.coalesce(F.col("turn").cast("long"), F.lit(0)).alias("turn"),
        F.lower(F.trim(F.col("role").cast("string"))).alias("role"),
        text.alias("text"),
    )
    own = F.when(F.col("conv").isNull(), F.xxhash64("turn", "text", "role")).otherwise(F.lit(0))
    rows = rows.withColumn("own", own).groupBy("conv", "own", "turn", "role", "text")
    return rows.agg(F.count("*").alias("copies")).withColumn("codes", observed("text"))


def learn(rows: DataFrame) -> Model:
    """The model counted over ``rows`` (of ``records``) whose role is one of ``ROLES``.

    The driver gets counts by state and feature: a few hundred rows.
    """
    numbers = F.array(*[F.lit(role) for role in ROLES])
    known = rows.withColumn("r", F.array_position(numbers, F.col("role")).cast("int") - 1)
    known = known.where((F.col("r") >= 0) & (F.size("codes") > 0) & F.col("conv").isNotNull())
    known = known.select("conv", "turn", "r", "codes", F.size("codes").alias("n"))
    first = known.groupBy("conv").agg(F.min(F.struct("turn", "r")).alias("f"))
    starts = first.groupBy("f.r").count().collect()
    nexts = known.select("conv", (F.col("turn") - 1).alias("turn"), F.col("r").alias("to"))
    pairs = (
        known.join(nexts, ["conv", "turn"])
        .groupBy("r", "to", (F.col("n") > 1).alias("inside"))
        .count()
        .collect()
    )
    inner = known.groupBy("r").agg(
        F.count(F.when(F.col("n") > 1, 1)).alias("enter"), F.sum(F.greatest(F.col("n") - 2, F.lit(0))).alias("stay")
    )
    features = (
        known.select("r", F.posexplode("codes").alias("i", "code"))
        .groupBy((2 * F.col("r") + (F.col("i") > 0).cast("int")).alias("state"), "code")
        .count()
        .collect()
    )
    start = np.full(STATES, 1e-6)
    for r in range(len(ROLES)):
        start[2 * r] = SMOOTH
    for row in starts:
        start[2 * row["r"]] += row["count"]
    move = np.full((STATES, STATES), 1e-6)
    for r in range(len(ROLES)):
        move[2 * r : 2 * r + 2, 0::2] += SMOOTH  # to the beginning of any turn
        move[2 * r : 2 * r + 2, 2 * r + 1] += SMOOTH  # or on inside the same one
    for row in pairs:
        move[2 * row["r"] + int(row["inside"]), 2 * row["to"]] += row["count"]
    for row in inner.collect():
        move[2 * row["r"], 2 * row["r"] + 1] += row["enter"]
        move[2 * row["r"] + 1, 2 * row["r"] + 1] += row["stay"]
    gap, size, asks = (np.full((n, STATES), SMOOTH) for n in (2, LENGTHS, 2))
    gap[1, 0::2] += 1  # a turn mostly begins behind a gap, a line inside has none
    gap[0, 1::2] += 1
    for row in features:
        _, g, s, a = (int(x[0]) for x in _features(np.array([row["code"]])))
        gap[g, row["state"]] += row["count"]
        size[s, row["state"]] += row["count"]
        asks[a, row["state"]] += row["count"]
    return Model(
        np.log(start / start.sum()),
        np.log(move / move.sum(axis=1, keepdims=True)),
        *(np.log(x / x.sum(axis=0)) for x in (gap, size, asks)),
    )


def render(text: str, states: list[int]) -> tuple[str, list[str]]:
    """Canonical turns of a record's lines, markers taken off, and their roles.

    Lines inside a turn that an earlier record began come under that turn's role again.
    """
    turns: list[tuple[str, list[str]]] = []
    at = 0
    for line in text.splitlines():
        if not line.strip():
            if turns and turns[-1][1] and turns[-1][1][-1]:
                turns[-1][1].append("")
            continue
        role, begins = ROLES[states[at] // 2], states[at] % 2 == 0
        if begins or not turns:
            turns.append((role, []))
        turns[-1][1].append((marker(line)[1] if begins else line).strip())
        at += 1
    parts = [f"<|{role}|>\n" + "\n".join(lines).strip("\n") + "\n<|end|>" for role, lines in turns]
    return "\n".join(parts), [role for role, _ in turns]


def parse(rows: DataFrame, model: Model) -> DataFrame:
    """``conv_id, turn, given, roles, n_turns, rendered``: each of ``rows`` as often as it is there."""
    shared = rows.sparkSession.sparkContext.broadcast(model)
    block = F.floor(F.col("turn") / CHUNK_TURNS)
    rows = write_out(rows.withColumn("block", block), "chat-records")
    lined = rows.where(F.size("codes") > 0)
    sizes = lined.groupBy("conv", "own", "block").agg(F.count("*").alias("n"))
    crowded = sizes.where(F.col("n") > CHUNK_RECORDS).withColumn(
        "parts", F.ceil(F.col("n") / CHUNK_RECORDS).cast("long")
    )
    # Records of a crowded block are parted by turn, and by equal ranges of their texts' hashes.
    place = F.floor((F.crc32("text") * F.coalesce("parts", F.lit(1))) / F.lit(2**32)).cast("long")
    keys = [F.col(f"l.{k}").eqNullSafe(F.col(f"s.{k}")) for k in ("conv", "own", "block")]
    chunked = lined.alias("l").join(crowded.alias("s"), keys, "left").select(
        "l.*",
        F.when(F.col("parts").isNotNull(), F.col("turn")).otherwise(F.lit(0)).alias("sub"),
        F.when(F.col("parts").isNotNull(), place).otherwise(F.lit(0)).alias("part"),
    )
    chunk = ["conv", "own", "block", "sub", "part"]

    def ordered(group: pd.DataFrame) -> pd.DataFrame:
        said = group.assign(crc=[_crc(x) for x in group["text"]], said=group["role"].fillna(""))
        return said.sort_values(["turn", "crc", "text", "said"])

    def measure(group: pd.DataFrame) -> pd.DataFrame:
        codes = np.concatenate(ordered(group)["codes"].to_list())
        flat = shared.value.matrix(codes).ravel()
        return _keyed(group, chunk, matrix=[flat])

    def connect(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(["block", "sub", "part"])
        both = edges([np.reshape(m, (STATES + 1, STATES)) for m in group["matrix"]], shared.value)
        out = group[chunk].astype("Int64")
        return out.assign(before=[a for a, _ in both], last=[b for _, b in both])

    def decode(group: pd.DataFrame) -> pd.DataFrame:
        group = ordered(group)
        codes = group["codes"].to_list()
        before, last = int(group["before"].iloc[0]), int(group["last"].iloc[0])
        states = shared.value.decode(np.concatenate(codes), before, last)
        out, at = [], 0
        for text, own in zip(group["text"], codes, strict=True):
            out.append(render(text, [int(s) for s in states[at : at + len(own)]]))
            at += len(own)
        return pd.DataFrame(
            {
                "conv_id": group["conv"].astype("Int64"),
                "turn": group["turn"],
                "given": group["role"],
                "copies": group["copies"],
                "roles": [",".join(roles) for _, roles in out],
                "n_turns": [len(roles) for _, roles in out],
                "rendered": [text for text, _ in out],
            }
        )

    names = ", ".join(f"{k} long" for k in chunk)
    # Only transcripts of several chunks need matrices; one chunk goes from the start to any end.
    ends = F.struct("block", "sub", "part")
    several = chunked.groupBy("conv", "own").agg(F.min(ends).alias("low"), F.max(ends).alias("high"))
    several = several.where("low != high").select("conv", "own")
    long_rows = chunked.alias("l").join(
        several.alias("m"), [F.col(f"l.{k}").eqNullSafe(F.col(f"m.{k}")) for k in ("conv", "own")], "left_semi"
    )
    matrices = long_rows.groupBy(*chunk).applyInPandas(measure, f"{names}, matrix array<double>")
    between = matrices.groupBy("conv", "own").applyInPandas(connect, f"{names}, before int, last int")
    between = write_out(between, "chat-edges")
    joined = chunked.alias("l").join(
        between.alias("e"), [F.col(f"l.{k}").eqNullSafe(F.col(f"e.{k}")) for k in chunk], "left"
    ).select(
        "l.*",
        F.coalesce("e.before", F.lit(STATES)).alias("before"),
        F.coalesce("e.last", F.lit(-1)).alias("last"),
    )
    schema = "conv_id long, turn long, given string, copies long, roles string, n_turns int, rendered string"
    spoken = joined.groupBy(*chunk).applyInPandas(decode, schema)
    silent = rows.where(F.size("codes") == 0).select(
        F.col("conv").alias("conv_id"),
        "turn",
        F.col("role").alias("given"),
        "copies",
        F.lit("").alias("roles"),
        F.lit(0).alias("n_turns"),
        F.lit("").alias("rendered"),
    )
    return _repeated(write_out(spoken.unionByName(silent), "chat-parsed"))


def _repeated(rows: DataFrame) -> DataFrame:
    """Rows as often as ``copies`` says. Where a row is there very often, its copies are dealt to
    several tasks."""
    most = rows.agg(F.max("copies")).first()[0] or 0
    left = F.col("copies")
    if most > COPIES_A_TASK:
        parts = F.sequence(F.lit(0), F.floor((left - 1) / COPIES_A_TASK))
        rows = rows.withColumn("deal", F.explode(parts)).repartition("deal", F.xxhash64(*rows.columns))
        left = F.least(F.lit(COPIES_A_TASK), left - F.col("deal") * COPIES_A_TASK)
    kept = [c for c in rows.columns if c not in ("copies", "deal")]
    return rows.withColumn("copy", F.explode(F.sequence(F.lit(1), left))).select(*kept)


def _crc(text: str) -> int:
    from zlib import crc32

    return crc32(text.encode("utf-8"))


def _keyed(group: pd.DataFrame, keys: list[str], **columns) -> pd.DataFrame:
    first = group.iloc[:1][keys].astype("Int64").reset_index(drop=True)
    return first.assign(**columns)


def format_chats(conversations: DataFrame, model: Model | None = None) -> DataFrame:
    """``conv_id, turn, given, roles, n_turns, rendered`` for every record, repeated ones too.

    ``given`` is only reported: a role is an input of learning, never of decoding. Without a
    model one is learnt from the records of transcripts that aren't held out. Records that are
    equal in transcript, turn, role and text are decoded and learnt from as one, and returned as often
    as they are there; a NULL turn is turn 0; records of one turn are in order of their texts'
    checksum, then of their role; a record without transcript id is a transcript by
    itself; a record without lines (NULL text included) has no turns. An empty table gives an
    empty result; other columns are ignored, whatever their names.
    """
    rows = write_out(records(conversations), "chat-rows")
    if model is None:
        model = learn(rows.where(~held_out("conv")))
    return parse(rows, model)


def op5_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chats(table(spark, sf_dir, "conversations"))
