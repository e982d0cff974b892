"""Small tables and brute-force versions for the tests of this folder."""

import re

from pyspark.sql import types as T

LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")

DOCS = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("source", T.StringType()),
        # Names that operators use themselves.
        T.StructField("score", T.StringType()),
        T.StructField("file", T.IntegerType()),
        T.StructField("rate", T.IntegerType()),
        T.StructField("copy", T.IntegerType()),
    ]
)


def documents(spark, rows):
    """A table of (doc_id, text[, source]) rows with further columns of clashing names."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "s", "x", 1, 2, 3) for r in rows]
    return spark.createDataFrame(full, DOCS)


ODD = [
    (1, None),
    (2, ""),
    (3, " \t\n "),
    (4, "one two three four five six seven eight"),
    (4, "one two three four five six seven eight"),
    (None, "one two three four five six seven eight"),
    (5, "One TWO three four five six seven eight"),
    (6, "É é Ñ ñ \U0001f642 ▁ \x00 x"),
    (7, "word " * 60_000),
    (8, "x" * 100_000),
]


def word_sets(rows, words):
    out = []
    for _, text in rows:
        w = WORD.findall((text or "").translate(LOWER))
        size = min(words, len(w))
        out.append(frozenset(tuple(w[i : i + size]) for i in range(len(w) - size + 1)) if w else frozenset())
    return out


def near_groups(rows, words, percent):
    """(doc_id, set size, smallest id reached, kept) by comparing all pairs; ids must differ."""
    sets = word_sets(rows, words)
    root = list(range(len(rows)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                a, b = find(i), find(j)
                root[max(a, b, key=lambda x: rows[x][0])] = min(a, b, key=lambda x: rows[x][0])
    return sorted((r[0], len(sets[i]), rows[find(i)][0], rows[find(i)][0] == r[0]) for i, r in enumerate(rows))
