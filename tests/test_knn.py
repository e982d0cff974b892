import numpy as np
import pytest

from gradus.operators import knn as K


def frames(spark, train, test, labels):
    schema = "id {t}, vec array<double>, label int"
    a = spark.createDataFrame([(i, [float(x) for x in v], 0) for i, v in enumerate(test)], schema.format(t="bigint"))
    b = spark.createDataFrame([(i, [float(x) for x in v], int(c)) for i, (v, c) in enumerate(zip(train, labels))], schema.format(t="bigint"))
    return a, b


def brute(train, test, labels, k):
    out = set()
    for q, v in enumerate(test):
        d = np.round(((np.array(train) - v) ** 2).sum(axis=1), K.DIGITS)
        order = np.lexsort((np.arange(len(train)), d))[:k]
        out |= {(q, r + 1, int(i), float(d[i]), int(labels[i])) for r, i in enumerate(order)}
    return out


def found(df):
    return {tuple(r) for r in df.select("query_id", "rank", "train_id", "dist2", "label").collect()}


def data(kind, n=300, m=60, seed=0):
    rng = np.random.default_rng(seed)
    if kind == "flags":  # many equal vectors and ties
        pool = rng.integers(0, 2, (n + m, 4)).astype(float)
    elif kind == "hot":  # a third of the training rows is one vector, another third one tight lump
        pool = rng.normal(size=(n + m, 3))
        pool[: n // 3] = 0.25
        pool[n // 3: 2 * n // 3] = 5 + rng.normal(size=(n // 3, 3)) * 1e-3
    else:
        pool = rng.normal(size=(n + m, 5))
    return pool[:n], pool[n:], rng.integers(0, 3, n)


ROUTES = {
    "broadcast": {},
    "partitioned": dict(broadcast_bytes=0, pivots=8, block_rows=25),
    "one_pivot": dict(broadcast_bytes=0, pivots=1, block_rows=10_000),
    "many_pivots": dict(broadcast_bytes=0, pivots=1000, block_rows=50),
}


@pytest.mark.parametrize(
    "kind,route",
    [(kind, route) for kind in ("flags", "hot", "normal") for route in ("broadcast", "partitioned")]
    + [("hot", "one_pivot"), ("normal", "many_pivots")],
)
def test_all_routes_are_exact(spark, kind, route):
    train, test, labels = data(kind)
    a, b = frames(spark, train, test, labels)
    got = found(K.knn_join(a, b, "vec", "id", "id", k=7, **ROUTES[route]))
    assert got == brute(train, test, labels, 7)


@pytest.mark.parametrize("route", ["broadcast", "partitioned"])
def test_fewer_rows_than_neighbours(spark, route):
    train, test, labels = data("normal", 3, 5)
    a, b = frames(spark, train, test, labels)
    got = found(K.knn_join(a, b, "vec", "id", "id", k=7, **ROUTES[route]))
    assert got == brute(train, test, labels, 7) and len(got) == 15


@pytest.mark.parametrize("kind", ["flags", "hot", "normal"])
def test_sampled_radius_is_exact(kind):
    train, test, _ = data(kind, 3000, 40)
    ids = np.arange(3000)
    for sample in (1, 50, 10_000):
        got = {
            (int(q), int(r), int(i), float(d))
            for block in K._searcher(7, sample=sample)(test, train, ids) for q, r, i, d in zip(*block)
        }
        assert got == {row[:4] for row in brute(train, test, ids, 7)}


def test_text_ids_and_feature_columns(spark):
    train = spark.createDataFrame([("b", 0.0, 1), ("a", 0.0, 2), ("c", 3.0, 0)], "tid string, x double, label int")
    test = spark.createDataFrame([("q", 0.5)], "qid string, x double")
    for options in ROUTES.values():
        rows = K.knn_join(test, train, ["x"], "qid", "tid", k=2, **options).orderBy("rank").collect()
        assert [(r["train_id"], r["dist2"]) for r in rows] == [("a", 0.25), ("b", 0.25)]


def test_hot_vector_shrinks_before_the_join(spark):
    train, test, labels = data("hot")
    _, b = frames(spark, train, test, labels)
    points = K.only_useful(b, ["vec"], "id", 7)
    assert points.count() == 200 + 7
    assert "WindowGroupLimit" in points._jdf.queryExecution().executedPlan().toString()


def test_vote(spark):
    rows = [(1, c) for c in (2, 2, 0, 0, 1)] + [(2, 1)]
    df = spark.createDataFrame(rows, "query_id int, label int")
    got = {r["query_id"]: (r["prediction"], r["probabilities"]) for r in K.knn_vote(df, (0, 1, 2)).collect()}
    assert got == {1: (0, [0.4, 0.2, 0.4]), 2: (1, [0.0, 1.0, 0.0])}


def test_no_training_rows(spark):
    a, b = frames(spark, [[0.0]], [[1.0]], [0])
    with pytest.raises(ValueError):
        K.knn_join(a, b.limit(0), "vec", "id", "id")


def test_visits_stay_flat_as_training_rows_grow(spark, monkeypatch):
    visits = {}

    def noted(df, name, write=K.write_out):
        out = write(df, name)
        visits[name] = out.count()
        return out

    monkeypatch.setattr(K, "write_out", noted)
    rng = np.random.default_rng(3)
    test = rng.normal(size=(200, 3))
    per_query = []
    for n in (2_000, 20_000):
        a, b = frames(spark, rng.normal(size=(n, 3)), test, rng.integers(0, 3, n))
        rows = K.knn_join(a, b, "vec", "id", "id", k=7, broadcast_bytes=0, pivots=int(n**0.5), block_rows=100)
        assert rows.count() == 7 * len(test)
        per_query.append(visits["knn-routed"] / len(test))
    assert per_query[1] < 1.5 * per_query[0] and per_query[1] < 0.2 * 20_000 / 100


def test_values_far_from_zero_keep_their_neighbours(spark):
    train, test, labels = data("normal", 500, 40)
    a, b = frames(spark, train + 1e7, test + 1e7, labels)
    for options in (ROUTES["broadcast"], ROUTES["partitioned"]):
        rows = K.knn_join(a, b, "vec", "id", "id", k=7, **options)
        got = {(r.query_id, r.rank): r.dist2 for r in rows.collect()}
        want = {row[:2]: row[3] for row in brute(train + 1e7, test + 1e7, labels, 7)}
        assert got == want
