import random

import numpy as np
import pytest

from gradus.llm import quality, toxicity
from gradus.llm.common import Memo, platt
from tests.llm.helpers import ODD, documents


def prose(draw, n=60):
    return [draw.choice(["river", "stone", "walk", "morning", "paper", "green", "table"]) + draw.choice(["", "s", "ed"]) for _ in range(n)]


def quality_corpus(seed=1, size=400):
    draw = random.Random(seed)
    rows, labels = [], []
    for i in range(size):
        words = prose(draw)
        good = i % 3 > 0
        if not good:
            kind = i % 4
            words = [
                [w for w in words for _ in range(8)],
                [x for w in words for x in (w, "|")],
                [w + "###" for w in words],
                [w.upper() + "!!" for w in words],
            ][kind]
        rows.append((i, " ".join(words)))
        labels.append((i, int(good), 0))
    return rows, labels


def test_quality_of_held_out_rows(spark):
    rows, labels = quality_corpus()
    docs = documents(spark, rows + [(9_000 + i, t) for i, (_, t) in enumerate(ODD)])
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = quality.fit(docs, marks)
    got = {r.doc_id: r for r in quality.score(docs, model).collect()}
    held = [(got[i], y) for i, y, _ in labels if got[i].held_out]
    assert len(held) > 40 and all(r.predicted == y for r, y in held)
    assert all(0 <= r.score <= 1 for r in got.values())
    kept = quality.accepted(docs, model)
    assert kept.schema == docs.schema
    assert kept.count() == sum(r.predicted for r in got.values())
    assert quality.score(documents(spark, []), model).count() == 0
    assert quality.accepted(documents(spark, []), model).count() == 0


def test_quality_without_both_labels(spark):
    docs = documents(spark, [(i, f"text {i}") for i in range(20)])
    schema = "doc_id long, quality int, toxic int"
    for labels, score in [([], 0.5), ([(i, 1, 0) for i in range(20)], 1.0), ([(3, None, None)], 0.5)]:
        model = quality.fit(docs, spark.createDataFrame(labels, schema))
        assert {round(r.score, 6) for r in quality.score(docs, model).collect()} == {score}


def test_dual_descent_reaches_the_primal_optimum():
    draw = np.random.default_rng(2)
    rows = [np.sort(draw.choice(30, size=draw.integers(3, 9), replace=False)) for _ in range(60)]
    labels = draw.integers(0, 2, 60)
    ratio = draw.normal(size=30)
    weights, offset = quality.dual_descent(rows, labels, ratio, epochs=3_000)
    ones = int(labels.sum())
    cost = np.where(labels == 1, 1.0, max(1.0, ones / (60 - ones)))

    def loss(w, b):
        margins = [
            (1 if y else -1) * (w[r] @ ratio[r] / len(r) ** 0.5 + b) for r, y in zip(rows, labels, strict=True)
        ]
        return 0.5 * (w @ w + b * b) + (cost * np.maximum(0, 1 - np.array(margins))).sum()

    plain = np.divide(weights, ratio)
    best = loss(plain, offset)
    for _ in range(300):
        assert loss(plain + draw.normal(scale=0.02, size=30), offset + draw.normal(scale=0.02)) >= best - 1e-6


def test_platt_finds_the_curve():
    draw = np.random.default_rng(3)
    x = draw.normal(size=20_000) * 3
    y = draw.random(20_000) < 1 / (1 + np.exp(-(1.5 * x - 0.7)))
    slope, offset = platt(x, y)
    assert slope == pytest.approx(1.5, abs=0.1) and offset == pytest.approx(-0.7, abs=0.1)


INSULTS = ["grimlok", "snarvel", "brotzen", "quadrip"]
GUISES = {"grimlok": "gr1ml0k", "snarvel": "$narv3l", "brotzen": "brooootzen", "quadrip": "q u a d r i p"}


def toxic_corpus(seed=5, size=500):
    draw = random.Random(seed)
    rows, labels = [], []
    for i in range(size):
        words = prose(draw, 40)
        bad = i % 5 == 0
        if bad:
            for _ in range(3):
                words.insert(draw.randrange(40), draw.choice(INSULTS) + draw.choice(["", "s", "."]))
        rows.append((i, " ".join(words).capitalize()))
        labels.append((i, 1, int(bad)))
    return rows, labels


def test_toxicity_of_held_out_and_disguised_rows(spark):
    rows, labels = toxic_corpus()
    draw = random.Random(8)
    planted = []
    for i, word in enumerate(INSULTS):
        words = prose(draw, 40)
        words.insert(20, GUISES[word])
        words.insert(9, GUISES[word])
        planted.append((10_000 + i, " ".join(words)))
    docs = documents(spark, rows + planted + [(9_000 + i, t) for i, (_, t) in enumerate(ODD)])
    marks = spark.createDataFrame(labels, "doc_id long, quality int, toxic int")
    model = toxicity.fit(docs, marks)
    got = {r.doc_id: r for r in toxicity.score(docs, model).collect()}
    held = [(got[i], y) for i, _, y in labels if got[i].held_out]
    assert len(held) > 50 and all(r.predicted == y for r, y in held)
    assert all(got[i].predicted == 1 for i, _ in planted)
    assert not any(got[9_000 + i].predicted for i in range(len(ODD)))
    assert all(0 <= r.score <= 1 for r in got.values())
    assert toxicity.score(documents(spark, []), model).count() == 0


def test_without_toxic_labels(spark):
    docs = documents(spark, [(i, f"text {i}") for i in range(20)])
    model = toxicity.fit(docs, spark.createDataFrame([], "doc_id long, quality int, toxic int"))
    assert not any(r.predicted for r in toxicity.score(docs, model).collect())


def all_readings(word):
    """Every reading of a word without runs, with the channel's log-probability."""
    out = [("", 0.0)]
    for c in word:
        itself = toxicity.ITSELF if c in toxicity.LOOK_ALIKES else toxicity.AS_IS
        options = [(c, itself)] + [(x, toxicity.ALIKE) for x in toxicity.LOOK_ALIKES.get(c, "")]
        out = [(text + x, p + q) for text, p in out for x, q in options]
    return out


def test_decoding_equals_trying_all_readings():
    draw = np.random.default_rng(1)
    channel = toxicity.Channel(draw.normal(size=(toxicity.RADIX,) * 3).astype(np.float32))

    def score(text, cost):
        a = b = 0
        for c in text:
            z = channel.numbers.get(c, toxicity.OTHER)
            cost += channel.table[a, b, z]
            a, b = b, z
        return cost + channel.table[a, b, 0]

    for word in ["1d10t", "l0s3r", "m0r0n", "a1b2c3", "$t@r"]:
        best = max(all_readings(word), key=lambda r: score(*r))
        assert channel.decode(word) == best[0]


def test_trigrams_equal_a_plain_count(spark):
    rows = [(1, "Abc  é9"), (2, None), (3, "x"), (4, "")]
    got = {r.trigram: r.n for r in toxicity.trigram_counts(documents(spark, rows)).collect()}
    numbers, want = toxicity.symbol_table(), {}
    text = "  " + "  ".join((t or "") for _, t in rows) + "  "
    x = [int(v) for v in toxicity.symbols(text, numbers)]
    for a, b, c in zip(x, x[1:], x[2:], strict=False):
        key = (a * toxicity.RADIX + b) * toxicity.RADIX + c
        want[key] = want.get(key, 0) + 1
    blank = 0  # blanks between texts depend on how texts are joined
    assert {k: v for k, v in got.items() if k != blank} == {k: v for k, v in want.items() if k != blank}


def test_memo_keeps_within_its_limit():
    calls = []
    memo = Memo(lambda key: calls.append(key) or len(key), limit=3)
    assert [memo[k] for k in ["a", "bb", "a", "ccc", "dddd", "a"]] == [1, 2, 1, 3, 4, 1]
    assert calls.count("a") == 1 and len(memo) + len(memo.older) <= 6


def test_spaced_and_doubled_words_are_decoded_in_the_lattice(spark):
    rows = [(i, "you are an idiot . a stupid idiot and you are dumb . it is a river") for i in range(40)]
    channel = toxicity.Channel.learn(toxicity.trigram_counts(documents(spark, rows)).toPandas())
    model = toxicity.Model(channel, {w: 5.0 for w in ("idiot", "stupid", "dumb")}, (1.0, -4.0))
    for text, words in [
        ("you are a i d i o t", {"idiot"}),  # a one-letter word beside the spaced one
        ("y o u a r e d u m b", {"dumb"}),  # several spaced words
        ("s t u p i d i d i o t", {"stupid", "idiot"}),
        ("what an id iot .", {"idiot"}),
        ("so st u pid", {"stupid"}),
        ("i  d\ni\t\to t", {"idiot"}),
        ("iddiioott", {"idiot"}),
        ("1 d i 0 t!", {"idiot"}),
        ("it is a river and you are", set()),
    ]:
        weigher = model.weigher()
        assert {word for token in toxicity.tokens(text, channel) for _, word in weigher[token]} == words, text
        assert words <= toxicity.read(text, Memo(channel.restore), channel), text
    assert channel.decode("y o u a r e d u m b") == "you are dumb"
    assert channel.decode("it is a") == "it is a"


def test_parts_of_a_row_are_read_as_the_whole_row():
    draw = np.random.default_rng(11)
    channel = toxicity.Channel((2 * draw.normal(size=(toxicity.RADIX,) * 3)).astype(np.float32))
    cut = 0
    for _ in range(1500):
        row = ["".join(draw.choice(list("abcée1"), draw.integers(1, 6))) for _ in range(draw.integers(2, 8))]
        want = channel.decode(" ".join(row)).split()
        got, at = [], 0
        for part in [*(p.split(" ") for p in channel.parts(row)), []]:
            while at < len(row) and row[at : at + len(part)] != part or (not part and at < len(row)):
                got += channel.decode(row[at]).split()  # a token by itself
                at += 1
            if part:
                got += channel.decode(" ".join(part)).split()
                at += len(part)
                cut += len(part) < len(row)
        assert got == want, row
    assert cut > 500


def test_tokens_without_hope_have_no_evidence():
    draw = np.random.default_rng(7)
    channel = toxicity.Channel(draw.normal(size=(toxicity.RADIX,) * 3).astype(np.float32))
    odds = {w: 3.0 for w in ("idiot", "idio-", "stup-", "as", "moron", "1337", "loser")}
    model = toxicity.Model(channel, odds, (1.0, -4.0))
    letters, marks = list("idotsupmrnlea"), list("01!$*@35|7.-'")
    tokens = [
        "".join(str(draw.choice(letters if draw.random() < 0.75 else marks)) for _ in range(draw.integers(1, 10)))
        for _ in range(3000)
    ]
    for word in ("idiot", "stupid", "as", "moron", "1337", "loser"):  # and what is like them
        for _ in range(300):
            out = [c * int(draw.integers(1, 3)) if draw.random() < 0.3 else c for c in word]
            at = int(draw.integers(0, len(out)))
            out[at] = str(draw.choice(marks)) if draw.random() < 0.7 else out[at]
            tokens.append((" " if draw.random() < 0.3 else "").join(out))
    skipped, found = 0, 0
    for token in tokens:
        got, hopeless = model.weigh(token), model.hopeless(token)
        words = channel.restore(token).split()
        want = tuple((v, w) for w in words if (v := model.strongest(w)))
        assert got == want, (token, words)
        skipped, found = skipped + hopeless, found + bool(want)
    assert skipped > 1500 and found > 30


def test_only_features_of_enough_toxic_rows_are_counted_in_the_others(spark):
    def corpus(marked):
        return [(f"{'stupid 1d1ot' if i % 2 else 'gentle breeze'} " + " ".join(prose(random.Random(i), 9)), 1.0 + i % 3,
                 int(i % 2 and marked)) for i in range(120)]

    rows = spark.createDataFrame(corpus(True), "text string, weight double, label int")
    channel = toxicity.Channel.learn(toxicity.trigram_counts(documents(spark, [(0, "an idiot " * 50)])).toPandas())
    every = {r.feature: r.n for r in toxicity.feature_counts(rows, channel).collect()}
    only = frozenset(["stupid", "stup-", "river", "absent"])
    some = {r.feature: r.n for r in toxicity.feature_counts(rows, channel, only).collect()}
    assert some == {f: every[f] for f in ("stupid", "stup-", "river")}

    odds = toxicity.learn_odds(rows, channel)
    t = {r.feature: r.n for r in toxicity.feature_counts(rows.where("label = 1"), channel).collect()}
    c = {r.feature: r.n for r in toxicity.feature_counts(rows.where("label = 0"), channel).collect()}
    total = {r.label: r.n for r in rows.groupBy("label").agg({"weight": "sum"}).toDF("label", "n").collect()}
    want = {}
    for f, n in t.items():
        value = np.log((n + 0.5) / (total[1] + 1)) - np.log((c.get(f, 0.0) + 0.5) / (total[0] + 1))
        if n >= toxicity.SUPPORT and value * n / (n + toxicity.SHRINK) >= toxicity.LEAST_ODDS:
            want[f] = value * n / (n + toxicity.SHRINK)
    assert odds == pytest.approx(want) and "stupid" in odds and "river" not in odds
    clean = spark.createDataFrame(corpus(False), "text string, weight double, label int")
    assert toxicity.learn_odds(clean, channel) == {}


def test_outlines_that_decide_are_found_behind_long_runs_too():
    model = toxicity.Model(toxicity.Channel(np.zeros((1, 1, 1))), {"abcdef": 3.0, "xy": 3.0}, (1.0, -4.0))
    for _ in range(2):  # worked out, and from the memo
        assert not model.hopeless("a" * 30 + "bcd") and model.hopeless("a" * 30 + "bxd")
        assert not model.hopeless("xxxxyyyyyy") and model.hopeless("xxxxyyyyyyu") and model.hopeless("xyu")
        assert not model.hopeless("qq a b cde") and not model.hopeless("qq xy u") and model.hopeless("qq uu")
