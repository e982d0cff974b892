import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from gradus.operators import boosting as B
from gradus.session import write_out

FEATURES = ["a", "b", "c", "d"]


def drawn(n=900, seed=3):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        label = int(rng.choice(3, p=[0.2, 0.3, 0.5]))
        a = None if rng.random() < 0.1 else round(float(rng.normal(label, 1.0)), 1)
        b = float("nan") if rng.random() < 0.05 and label else float(rng.integers(0, 4) + label)
        rows.append((i, a, b, 7.0, float(rng.integers(0, 2)), label))
    return rows


@pytest.fixture(scope="module")
def points(spark):
    kinds = "id long, a double, b double, c double, d double, label int"
    df = spark.createDataFrame(drawn(), kinds).persist()
    yield df
    df.unpersist()


def plain_trees(rows, rounds, depth, step):
    """Nodes (round, class, node, gain, value) of softmax boosting, by trying every split of every node."""
    x = np.array([[np.nan if v is None else v for v in r[1:5]] for r in rows], dtype=float)
    y = np.array([r[5] for r in rows])
    w = (len(y) / (3 * np.bincount(y)))[y]
    margins, out = np.zeros((len(y), 3)), []
    for number in range(rounds):
        p = np.exp(margins)
        p /= p.sum(axis=1, keepdims=True)
        change = np.zeros_like(margins)
        for k in range(3):
            g, h = w * (p[:, k] - (y == k)), 2 * w * p[:, k] * (1 - p[:, k])
            todo = [(0, np.arange(len(y)))]
            for node, mine in todo:
                def score(part):
                    return g[part].sum() ** 2 / (h[part].sum() + 1)

                value = -step * g[mine].sum() / (h[mine].sum() + 1)
                best = (1e-6, None)
                if (node + 1).bit_length() - 1 < depth:
                    for f in range(4):
                        seen = x[mine, f]
                        for cut in np.unique(seen[~np.isnan(seen)]):
                            for lost in (False, True):
                                goes = np.where(np.isnan(seen), lost, seen <= cut)
                                left, right = mine[goes], mine[~goes]
                                if min(h[left].sum(), h[right].sum()) >= 1:
                                    gain = score(left) + score(right) - score(mine)
                                    if gain > best[0] + 1e-9 * best[0]:
                                        best = (gain, (left, right))
                if best[1] is None:
                    change[mine, k] = value
                    out.append((number, k, node, 0.0, value))
                else:
                    todo += [(2 * node + 1, best[1][0]), (2 * node + 2, best[1][1])]
                    out.append((number, k, node, best[0], value))
        margins += change
    p = np.exp(margins)
    return sorted(out), p / p.sum(axis=1, keepdims=True)


def test_trees_equal_a_search_over_all_splits(spark, points):
    model = B.BoostedModel.fit(points, FEATURES, rounds=3, depth=3, step=0.3)
    want, shares = plain_trees(drawn(), 3, 3, 0.3)
    got = sorted(tuple(r) for r in model.nodes(spark).select("round", "tree_class", "node", "gain", "value").collect())
    assert [r[:3] for r in got] == [r[:3] for r in want]
    assert np.allclose([r[3:] for r in got], [r[3:] for r in want], rtol=1e-7, atol=1e-9)
    scored = model.score(points).orderBy("id").collect()
    assert np.allclose([r.probabilities for r in scored], shares, atol=1e-9)
    assert [r.prediction for r in scored] == list(shares.argmax(axis=1))


def test_routes_grow_the_same_trees(spark, points):
    fits = [
        B.BoostedModel.fit(points.repartition(n), FEATURES, rounds=12, depth=3, route=route)
        for n, route in ((3, None), (2, "by_class"), (2, "by_level"))
    ]
    scores = [np.array([r.probabilities for r in m.score(points).orderBy("id").collect()]) for m in fits]
    assert (scores[0] == scores[1]).all()
    assert np.allclose(scores[0], scores[2], atol=1e-9)


def test_bundles_sum_like_features_and_deep_trees_like_shallow_code():
    rng = np.random.default_rng(5)
    layout = B.Layout([np.arange(40.0), [0.5], [0.5], np.arange(200.0), [], [0.5, 1.5]])
    values = np.stack([rng.integers(-1, 41, 3000), *rng.integers(0, 2, (2, 3000)), rng.integers(-1, 202, 3000),
                       np.ones(3000), rng.integers(0, 3, 3000)], axis=1).astype(float)
    values[rng.random(values.shape) < 0.05] = np.nan
    bins = layout.bins(values)
    assert len(layout.bundles) < 6 and sorted(f for own in layout.bundles for f in own) == list(range(6))
    rows = B.Rows(bins, rng.random((3000, 2)) * 9, rng.normal(size=(3000, 2)), layout)
    rows.begin()
    depth, nodes, seen = 8, np.zeros((2, 3000), dtype=int), []

    def checked(trees, level):  # each node and bin by itself
        got = rows.sums(trees, level)
        for k in range(2):
            if level:
                f = trees.feature[k][nodes[k]]
                own = bins[np.arange(3000), np.maximum(f, 0)]
                right = np.where(own == layout.missing[f], ~trees.missing_left[k][nodes[k]], own > trees.cut[k][nodes[k]])
                nodes[k] = np.where(f < 0, -1, 2 * nodes[k] + 1 + right) * (nodes[k] >= 0) - (nodes[k] < 0)
            first = 2**level - 1
            for pair in range(got.shape[1]):
                mine = nodes[k] == first + (2 * pair if level else 0)
                for i, change in enumerate((rows.gradient[k], rows.hessian[k])):
                    want = [np.bincount(bins[mine, f], change[mine], layout.missing[f] + 1) for f in range(6)]
                    assert np.allclose(got[k, pair, :, i], np.concatenate(want), atol=1e-9)
        seen.append(level)
        return got

    trees = B.grow(2, depth, 0.3, layout, checked)
    assert seen == list(range(8))
    added = trees.scorer(layout)(rows.codes)
    for k in range(2):
        for i in range(0, 3000, 7):
            node = 0
            while (f := trees.feature[k, node]) >= 0:
                lost = bins[i, f] == layout.missing[f]
                node = 2 * node + 1 + int(not trees.missing_left[k, node] if lost else bins[i, f] > trees.cut[k, node])
            assert added[k, i] == trees.value[k, node]


def test_a_fit_makes_its_rows_once_and_its_rounds_write_nothing(spark, points, monkeypatch):
    made = []
    monkeypatch.setattr(B, "write_out", lambda df, name: made.append(name) or write_out(df, name))
    count = spark.sparkContext.accumulator(0)

    @F.udf("double")
    def counted(v):
        count.add(1)
        return v

    train = points.withColumn("d", counted("d"))
    fits = [B.BoostedModel.fit(train, FEATURES, rounds=21, depth=2, route=r) for r in ("by_class", "by_level")]
    assert count.value == 2 * points.count()
    assert made == ["boosting-train", "boosting-cells", "boosting-rows"] * 2
    a, b = ([r.probabilities for r in m.score(points).orderBy("id").collect()] for m in fits)
    assert np.allclose(a, b, atol=1e-9)


def test_a_new_or_late_worker_has_the_same_margins():
    layout = B.Layout([[1.0, 2.0], [0.5]])
    bins = layout.bins(np.array([[1.0, 0.0], [2.0, 1.0], [3.0, np.nan], [np.nan, 1.0]]))
    weights = np.eye(3)[[0, 1, 2, 2]] * 5

    def make():
        return B.Rows(bins, weights, np.zeros((4, 3)), layout)

    rows, trees = make(), []
    for _ in range(4):
        rows.begin()
        trees.append(B.grow(3, 2, 0.3, layout, rows.sums))
        rows.add(trees[-1])
    for seen in (2, 4, 1, 3):  # behind, level, and a task done again
        want = make()
        for t in trees[:seen]:
            want.add(t)
        assert (B._held("key", make, trees[:seen]).margins == want.margins).all()
    assert (B._held("other", make, []).margins == 0).all() and list(B._HELD) == ["other"]


def test_first_gains_are_those_of_the_first_trees(spark, points):
    gains = {(r.tree_class, r.feature): r.gain for r in B.first_gains(points, FEATURES).collect()}
    assert len(gains) == 12 and all(gains[k, "c"] == 0 for k in range(3))
    model = B.BoostedModel.fit(points, FEATURES, rounds=1, depth=1)
    for k in range(3):
        assert math.isclose(max(gains[k, f] for f in FEATURES), model.trees[0].gain[k, 0], rel_tol=1e-9)


def test_quantile_bins_and_bounds(spark):
    rows = spark.range(20_000).select(
        (F.col("id") * 7919 % 10_007).cast("double").alias("a"), (F.col("id") % 3).cast("int").alias("label")
    )
    rows = rows.withColumn("label", F.when(F.col("a") > 5000, 2).otherwise(F.col("label") % 2))
    cuts = B.find_cuts(rows, ["a"])
    assert 200 < len(cuts[0]) <= B.MOST_BINS
    model = B.BoostedModel.fit(rows, ["a"], rounds=5, depth=2)
    right = model.score(rows).agg(F.avg(((F.col("prediction") == 2) == (F.col("a") > 5000)).cast("int"))).first()[0]
    assert right > 0.99
    with pytest.raises(ValueError, match="bins"):
        B.BoostedModel.fit(rows, ["a"], most_bins=256)


def test_odd_tables(spark, points):
    same = points.withColumns({c: F.lit(None).cast("double") for c in FEATURES})
    model = B.BoostedModel.fit(same, FEATURES, rounds=2, depth=2)
    assert all((t.feature < 0).all() for t in model.trees)
    assert np.allclose(model.score(same).first().probabilities, [1 / 3] * 3)
    with pytest.raises(ValueError, match="no training rows"):
        B.BoostedModel.fit(points.limit(0), FEATURES, rounds=1)
    with pytest.raises(Exception, match="label not in the classes"):
        B.BoostedModel.fit(points.withColumn("label", F.lit(5)), FEATURES, rounds=1)
    one = B.BoostedModel.fit(points.filter("label = 1"), FEATURES, rounds=1, depth=1)
    assert one.score(points.limit(3)).first().prediction == 1


def test_unseen_values_and_saving(spark, points, tmp_path):
    model = B.BoostedModel.fit(points, FEATURES, rounds=4, depth=3)
    path = str(tmp_path / "model")
    model.save(path)
    again = B.BoostedModel.load(spark, path)
    odd = spark.createDataFrame([(1e9, -5.0, None, float("nan")), (None, None, None, None)], "a double, b double, c double, d double")
    rows = [[r.probabilities for r in m.score(odd).collect()] for m in (model, again)]
    assert rows[0] == rows[1]
    assert again.importances() == model.importances()
    assert math.isclose(sum(v for _, v in model.importances()), 1.0) and dict(model.importances())["c"] == 0.0


def test_the_child_with_fewer_rows_grows_the_same_trees(monkeypatch):
    rng = np.random.default_rng(8)
    layout = B.Layout([np.arange(60.0), [0.5], np.arange(200.0), [0.5, 1.5]])
    values = np.stack([rng.integers(-1, 61, 4000), rng.random(4000) < 0.9, rng.integers(0, 202, 4000),
                       rng.integers(0, 3, 4000)], axis=1).astype(float)
    values[rng.random(values.shape) < 0.05] = np.nan
    weights = np.eye(2)[((values[:, 0] > 20) | (rng.random(4000) < 0.1)).astype(int)] * 9
    rows, gone = B.Rows(layout.bins(values), weights, rng.normal(size=(4000, 2)), layout), []
    add_up = B.Rows._add_up
    monkeypatch.setattr(B.Rows, "_add_up", lambda self, out, codes, *a: gone.append(len(codes[0])) or add_up(self, out, codes, *a))
    rows.begin()
    want = B.grow(2, 6, 0.3, layout, rows.sums)
    every, gone[:] = sum(gone), []
    rows.begin()
    got = B.grow(2, 6, 0.3, layout, rows.lesser_sums)
    for name in B.Trees.FIELDS:
        assert np.allclose(getattr(want, name).astype(float), getattr(got, name).astype(float), rtol=1e-9, atol=1e-9)
    assert max(gone[2:]) <= 2000 and sum(gone) < every
    added = got.scorer(layout)(rows.codes)  # by words of places, against a walk down
    for k in range(2):
        nodes = B.descend(got.turns(k, layout), rows.codes, np.zeros(4000, dtype=np.int64), range(6))
        assert (added[k] == got.values(k)[nodes - 63]).all()


def test_only_features_with_many_values_are_sketched(spark, monkeypatch):
    rows = spark.range(3000).select(
        (F.col("id") % 7).cast("double").alias("few"), (F.col("id") % 2000).cast("double").alias("many"),
        F.lit(None).cast("double").alias("none"),
    )
    sketched, sketch = [], F.percentile_approx
    monkeypatch.setattr(F, "percentile_approx", lambda c, *a: sketched.append(str(c)) or sketch(c, *a))
    few, many, none = B.find_cuts(rows, ["few", "many", "none"])
    assert few == [0.0, 1.0, 2.0, 3.0, 4.0, 5.0] and 200 < len(many) <= B.MOST_BINS and none == []
    assert len(sketched) == 1 and "many" in sketched[0]
    # A count that was too low: the feature's set is found too large, and it is sketched after all.
    monkeypatch.setattr(F, "approx_count_distinct", lambda c: F.count_if(c < 0))
    assert B.find_cuts(rows, ["few", "many", "none"]) == [few, many, none] and len(sketched) == 2


def test_rows_of_a_table_at_size_are_broadcast(spark, points, monkeypatch):
    """orders 60 times sf0.1 have 735,848 binned rows where the shifted keys change the remainders."""
    assert B.FEW_ROWS >= 735_848
    taken = []
    for name in ("_grow_by_class", "_grow_by_level"):
        monkeypatch.setattr(B, name, lambda *a, name=name, f=getattr(B, name): taken.append(name) or f(*a))
    n = 500
    for few in (n, 10):
        monkeypatch.setattr(B, "FEW_ROWS", few)
        B.BoostedModel.fit(points, FEATURES, rounds=1, depth=1)
    assert taken == ["_grow_by_class", "_grow_by_level"]
