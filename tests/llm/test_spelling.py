import re
import zlib
from collections import Counter

import numpy as np

from gradus.llm import spelling
from gradus.llm.common import mix64
from tests.llm.helpers import LOWER, ODD, documents

RUN = re.compile("[A-Za-zÀ-ÿ]+")


def counted(rows):
    """Words and counts, plainly."""
    seen = Counter()
    for key, text in rows:
        for run in RUN.findall(text or ""):
            run = run.translate(LOWER)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if h % 31 == 0:
                at = h % len(run)
                run = run[:at] + run[at + 1 :]
            seen[run] += 1
    return {w: n for w, n in seen.items() if len(w) >= 7 and n >= 2}


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) - len(a) == 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def grouped(words):
    """The rows of the result by comparing all words with all others."""
    rows, form = [], {}
    about = {w: [x for x in words if near(w, x)] for w in words}
    for w, n in words.items():
        best = min(about[w], key=lambda x: (-words[x], x), default=None)
        form[w] = best if best is not None and words[best] >= 10 * n else None
    for w, n in words.items():
        root = w
        while form[root] is not None:
            root = form[root]
        rows.append((w, form[w], root, n, len(about[w]), words[form[w]] if form[w] else None))
    return sorted(rows, key=lambda r: r[0])


def result(spark, words, **options):
    out = spelling.variants(spark.createDataFrame(list(words.items()), "word string, n long"), **options)
    assert out.columns == ["word", "form", "root", "n", "n_near", "form_n"]
    return sorted(map(tuple, out.collect()), key=lambda r: r[0])


def drawn(seed=5, n=400):
    """Words over few letters, so that many are near; counts from 2 to some thousands."""
    rng = np.random.default_rng(seed)
    letters = list("abÿéz")
    words = {}
    for _ in range(n):
        word = "".join(rng.choice(letters, rng.integers(7, 10)))
        words[word] = int(2 * 10 ** rng.uniform(0, 3.5))
        other = list(word)
        other.insert(int(rng.integers(0, len(word))), str(rng.choice(letters)))
        words["".join(other)] = int(2 * 10 ** rng.uniform(0, 3.5))
    return words


def test_words_and_counts(spark):
    texts = [(i, "Wörterbuch, ÉCOLE-école École×÷école straßenbahn Straßenbahn's dictionary " * (1 + i % 4)) for i in range(150)]
    rows = texts + ODD + [(None, "dictionary DICTIONARY")]
    got = {r.word: r.n for r in spelling.vocabulary(documents(spark, rows)).collect()}
    assert got == counted(rows)
    assert len(got) > 8  # some lost a letter


def test_variants_equal_all_pairs(spark):
    words = drawn()
    want = grouped(words)
    assert result(spark, words) == want
    assert sum(r[1] is not None for r in want) > 50


def test_segments_and_rounds_change_nothing(spark):
    words = drawn(6, 200)
    assert result(spark, words, segment_words=30, round_bytes=200) == grouped(words)


def test_ties_repeats_and_odd_words(spark):
    words = {
        "aaaaaaa": 2, "aaaaaaaa": 20, "aaaaaab": 20, "baaaaaa": 20, "aaaaaaaaa": 200,
        "lengthy" * 3000: 5, "lengthy" * 3000 + "s": 50, "x" * 30: 2,
    }
    want = grouped(words)
    assert result(spark, words) == want
    assert any(r[2] not in (r[0], r[1]) for r in want)  # a form of a form
    assert result(spark, {}) == []


def test_tables_from_rows(spark):
    rows = ODD + [(i, "Spelling variant spellings spellling Wörterbücher") for i in range(10, 260)]
    got = spelling.variants(spelling.vocabulary(documents(spark, rows))).collect()
    assert sorted(map(tuple, got), key=lambda r: r[0]) == grouped(counted(rows))
    assert spelling.variants(spelling.vocabulary(documents(spark, []))).collect() == []


def test_filter_has_no_false_negative_and_few_false_positives():
    keys = mix64(np.arange(1, 20_001, dtype=np.uint64))
    bloom = spelling.make_filter(keys, 625)
    assert len(spelling.probe(bloom, keys, 625)) == len(keys)
    others = mix64(np.arange(1_000_000, 1_200_000, dtype=np.uint64))
    assert len(spelling.probe(bloom, others, 625)) < 0.004 * len(others)
