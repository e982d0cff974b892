"""Token counts by byte-pair merging, without making any identifier.

A text's symbols are its characters behind one leading blank mark, with blanks as marks too.
The adjacent pair whose union ranks lowest is merged until no union is in the vocabulary; a
heap holds the pairs, a linked list the symbols. The count is the number of symbols less the
merges; a character that the vocabulary lacks counts as its UTF-8 bytes.

No piece of the vocabulary has a blank mark behind another character (checked on loading), so
no merge crosses the place before a run of marks: the runs with what follows are counted one
by one, and a bounded memo keeps the counts of short ones.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
from pyspark.sql import DataFrame, SparkSession

from gradus.llm.common import Memo, table, texts

MARK = "▁"
LIMIT = 4096
_SEGMENT = re.compile(f"{MARK}+[^{MARK}]*")


class PieceCounter:
    """Counts the tokens of texts under one vocabulary of scored pieces."""

    def __init__(self, ranks: dict[str, float]):
        if any(MARK in piece.lstrip(MARK) for piece in ranks):
            raise ValueError("a piece has a blank mark inside: texts can't be cut at blanks")
        self.ranks = ranks
        self.memo = Memo(self.merge, 400_000)

    def merge(self, segment: str) -> int:
        """Symbols less merges for one segment; see the module's text."""
        ranks, symbols = self.ranks, list(segment)
        before = list(range(-1, len(symbols) - 1))
        after = list(range(1, len(symbols) + 1))
        count = sum(1 if c in ranks else len(c.encode("utf-8")) for c in symbols)
        heap = []

        def offer(left: int, right: int) -> None:
            union = symbols[left] + symbols[right]
            if (rank := ranks.get(union)) is not None:
                heapq.heappush(heap, (rank, left, right, union))

        for i in range(len(symbols) - 1):
            offer(i, i + 1)
        while heap:
            _, left, right, union = heapq.heappop(heap)
            if not symbols[left] or not symbols[right] or symbols[left] + symbols[right] != union:
                continue  # one side was merged meanwhile
            symbols[left], symbols[right] = union, ""
            count -= 1
            after[left] = after[right]
            if after[left] < len(symbols):
                before[after[left]] = left
                offer(left, after[left])
            if before[left] >= 0:
                offer(before[left], left)
        return count

    def count(self, text: str) -> int:
        if not text:
            return 0
        memo = self.memo
        return sum([memo[s] for s in _SEGMENT.findall(MARK + text.replace(" ", MARK))])


@lru_cache(maxsize=2)
def counter(model_path: str) -> PieceCounter:
    """The counter of a vocabulary file; one per worker process, memo included."""
    import sentencepiece

    library = sentencepiece.SentencePieceProcessor(model_file=model_path)
    skip = (library.is_control, library.is_unknown, library.is_byte, library.is_unused)
    return PieceCounter(
        {
            library.id_to_piece(i): -library.get_score(i)
            for i in range(library.vocab_size())
            if not any(test(i) for test in skip)
        }
    )


def count_tokens(docs: DataFrame, model_path: str, limit: int = LIMIT, **columns: str) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` for every row of ``docs``.

    Narrow: one pass, no shuffle, memory bounded by the memo and the longest text. A NULL text
    is empty and has 0 tokens; a NULL id stays NULL; repeated rows give repeated results; an
    empty table gives an empty one; other columns are ignored, whatever their names.
    """

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        pieces = counter(model_path)
        for batch in batches:
            tokens = [pieces.count(text) for text in batch["text"]]
            yield pd.DataFrame(
                {
                    "doc_id": batch["doc_id"].astype("Int64"),
                    "n_bytes": [len(text.encode("utf-8")) for text in batch["text"]],
                    "n_tokens": tokens,
                    "over_limit": [n > limit for n in tokens],
                }
            )

    return texts(docs, **columns).mapInPandas(
        count, "doc_id long, n_bytes long, n_tokens long, over_limit boolean"
    )


def op2_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return count_tokens(
        table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model")
    )
