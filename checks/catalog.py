"""Every registered query beside the SQL that checks it."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from checks import tables as C
from checks.tables import raw_registry, scored, six_digits, table
from gradus import schema as S
from gradus.functions import cleaning, decisions
from gradus.operators import (
    boosting,
    groups,
    knn,
    levels,
    metrics,
    models,
    profiling,
    scenarios,
    splitting,
    thresholds,
)
from gradus.plans import explore, pipeline
from gradus.session import scratch_path, write_out
from gradus.sources import registry, tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function name, with its checking SQL if there is one."""
    def keep(fn):
        QUERIES[fn.__name__] = fn
        if sql is not None:
            ORACLES[fn.__name__] = sql
        return fn
    return keep


def _encoded(spark, sf_dir):
    return registry.with_features(registry.keep_operator(raw_registry(spark, sf_dir), C.OPERATOR))


def _cleaned(spark, sf_dir):
    return registry.clean_points(registry.keep_operator(raw_registry(spark, sf_dir), C.OPERATOR))


def _labelled(spark, sf_dir):
    return levels.label_points(_cleaned(spark, sf_dir))


def _sizes(spark, sf_dir):
    return write_out(groups.group_sizes(_cleaned(spark, sf_dir)), "sizes")


def _split(spark, sf_dir):
    # Written before they are counted, joined and filtered: a filter would repeat the features' long
    # expressions in one method, too large for the JVM to compile, and the join hashes whole rows.
    points = write_out(_cleaned(spark, sf_dir).select(S.POINT_ID, S.GROUP, *S.FEATURES), "points")
    usable = write_out(levels.label_points(points).na.drop(subset=S.FEATURES), "usable")
    return splitting.fit_split(usable, S.POINT_ID).apply(usable)


def _predictions(spark, sf_dir):
    rows = scored(spark, sf_dir)
    p = F.col("probabilities")
    rules = {
        "logistic_regression": decisions.argmax_class(p),
        "knn": F.col("other_rule"),
        "xgboost": decisions.threshold_class(p, S.CLASS0_THRESHOLD),
    }
    # One pass for all models: a row carries one prediction per model and is then unfolded.
    pairs = F.array(*[F.struct(F.lit(k).alias("model_key"), v.alias("p")) for k, v in rules.items()])
    return rows.select("y", F.inline(pairs))


MODEL_NAMES = {
    "logistic_regression": ("Logistic Regression", "models/logistic_regression"),
    "knn": ("K-Nearest Neighbors", "models/knn"),
    "xgboost": ("Gradient-Boosted Trees", "models/xgboost"),
}


def _metrics(spark, sf_dir):
    return metrics.evaluate_models(_predictions(spark, sf_dir), MODEL_NAMES)


def _sweep(spark, sf_dir):
    return thresholds.threshold_sweep(scored(spark, sf_dir))


# --- Scans, sources, sinks ----------------------------------------------------------------

@query(f"""WITH {C.RAW}
SELECT count(*) AS n_rows, 15::INT AS n_columns, count(DISTINCT consolidated_commune) AS n_consolidated_commune,
  count(DISTINCT id_station_itinerance) AS n_id_station_itinerance
FROM raw WHERE nom_operateur = '{C.OPERATOR}'""")
def scan_profile(spark, sf_dir):
    points = registry.keep_operator(raw_registry(spark, sf_dir), C.OPERATOR)
    return profiling.scan_profile(points, [S.GROUP, S.STATION_ID])


@query(f"""WITH {C.RAW}
SELECT count(*) AS n_rows, count(puissance_nominale) AS n_power, count(consolidated_commune) AS n_group,
  count(CASE WHEN nbre_pdc <> 'n/a' THEN 1 END) AS n_count,
  count(DISTINCT implantation_station) AS n_site_types FROM raw""")
def csv_scan(spark, sf_dir):
    """The registry as CSV in the shared folder, read back: missing texts become NULL."""
    path = scratch_path(spark, "registry")
    raw = raw_registry(spark, sf_dir)
    raw.write.mode("overwrite").option("header", True).option("escape", '"').option(
        "ignoreLeadingWhiteSpace", False).option("ignoreTrailingWhiteSpace", False).csv(path)
    back = registry.read_raw_csv(spark, path)
    return back.agg(
        F.count(F.lit(1)).alias("n_rows"), F.count(S.POWER).alias("n_power"),
        F.count(S.GROUP).alias("n_group"), F.count(S.POINT_COUNT).alias("n_count"),
        F.count_distinct(S.SITE_TYPE).alias("n_site_types"),
    )


@query(f"WITH {C.LEVELLED} SELECT "
       + ", ".join(f"round({c}, 6) AS {c}" if c in ("latitude", "longitude") else c for c in S.LABELLED_COLUMNS)
       + " FROM labelled")
def roundtrip_labelled(spark, sf_dir):
    path = scratch_path(spark, "labelled")
    tables.write_labelled(_labelled(spark, sf_dir), path)
    return six_digits(tables.read_labelled(spark, path))


@query(f"""WITH {C.LEVELLED}, places AS (SELECT consolidated_commune, avg(latitude) AS latitude,
  avg(longitude) AS longitude FROM labelled GROUP BY 1)
SELECT consolidated_commune, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude,
  p * 10.0::DOUBLE AS puissance_nominale, 0.0::DOUBLE AS prise_type_ef, 1.0::DOUBLE AS prise_type_2,
  1.0::DOUBLE AS prise_type_combo_ccs, 0.0::DOUBLE AS prise_type_chademo, 0.0::DOUBLE AS prise_type_autre,
  0::INT AS implantation_encoded, 1.0::DOUBLE AS acces_libre, 4.0::DOUBLE AS nbre_pdc
FROM places, range(41) AS r(p)""")
def whatif_grid(spark, sf_dir):
    return six_digits(scenarios.whatif_grid(_labelled(spark, sf_dir)))


# --- Projections, filters, predicates -----------------------------------------------------

@query(f"WITH {C.RAW} SELECT id_pdc_itinerance, nom_operateur, puissance_nominale FROM raw "
       f"WHERE nom_operateur = '{C.OPERATOR}'")
def filter_operator(spark, sf_dir):
    points = registry.keep_operator(raw_registry(spark, sf_dir), C.OPERATOR)
    return points.select(S.POINT_ID, S.OPERATOR, S.POWER)


@query(f"WITH {C.CLEANED} SELECT {', '.join(S.FEATURES)} FROM cleaned")
def project_features(spark, sf_dir):
    return _cleaned(spark, sf_dir).select(*S.FEATURES)


@query(f"""WITH {C.ENCODED} SELECT count(*) AS n_before,
  count(*) FILTER (puissance_nominale IS NULL) AS n_dropped, count(puissance_nominale) AS n_kept FROM encoded""")
def drop_missing_counts(spark, sf_dir):
    return registry.drop_counts(registry.keep_operator(raw_registry(spark, sf_dir), C.OPERATOR))


@query(f"""WITH {C.RAW}, keyed AS (SELECT *, CAST(id_pdc_itinerance AS BIGINT) AS key FROM raw)
SELECT count(*) + count(*) FILTER (key % 97 = 0) AS n_rows, count(*) FILTER (key % 97 = 0) AS n_broken,
  count(puissance_nominale) AS n_power, count(consolidated_commune) AS n_group,
  count(condition_acces) FILTER (key % 2 = 0) AS n_access FROM keyed""")
def csv_folder(spark, sf_dir):
    """A folder whose files have three headers, and rows with too few cells in some of them."""
    path = scratch_path(spark, "folder")
    key = F.col(S.POINT_ID).cast("long")
    raw = raw_registry(spark, sf_dir)
    plain = {"header": True, "escape": '"', "ignoreLeadingWhiteSpace": False, "ignoreTrailingWhiteSpace": False}
    raw.filter(key % 2 == 0).write.options(**plain).csv(path)
    turned = [c for c in reversed(raw.columns) if c != S.ACCESS]
    raw.filter(key % 2 != 0).select(*turned, F.lit("x").alias("more")).write.mode("append").options(**plain).csv(path)
    line = F.concat(F.col(S.POINT_ID), F.lit(",F")).alias(f"{S.POINT_ID},{S.OPERATOR},{S.POWER}")
    raw.filter(key % 97 == 0).select(line).write.mode("append").options(header=True, sep="\t").csv(path)
    back = registry.read_raw_folder(spark, path)
    sound = registry.sound_rows(back).agg(
        F.count(S.POWER).alias("n_power"), F.count(S.GROUP).alias("n_group"), F.count(S.ACCESS).alias("n_access")
    )
    return registry.broken_count(back).join(F.broadcast(sound))  # one row each


@query(f"""WITH {C.LEVELLED}, counts AS (SELECT
  (SELECT count(*) FROM encoded) AS rows_read,
  (SELECT count(*) FROM encoded WHERE puissance_nominale IS NULL) AS without_power,
  (SELECT count(*) FROM cleaned WHERE consolidated_commune IS NULL) AS without_group,
  (SELECT count(*) FROM labelled) AS labelled,
  (SELECT count(*) FROM labelled WHERE nbre_pdc IS NULL) AS without_feature)
SELECT step, "rows" FROM (UNPIVOT counts ON COLUMNS(*) INTO NAME step VALUE "rows")""")
def run_counts(spark, sf_dir):
    """What the training run reports and stores about the rows that it read."""
    _, counts = pipeline.prepare(raw_registry(spark, sf_dir), C.OPERATOR)
    path = scratch_path(spark, "run-counts")
    tables.write_run_counts(spark, counts, path)
    return tables.read_run_counts(spark, path)


@query(f"""WITH {C.USABLE}, {C.sql_split('usable', 'id_pdc_itinerance', 'label')}
SELECT label, split, count(*) AS n FROM divided GROUP BY ALL""")
def split_by_content(spark, sf_dir):
    """Quotas of a split whose rows are told apart by their content, as no row has an id."""
    usable = _labelled(spark, sf_dir).na.drop(subset=S.FEATURES).select(*S.FEATURES, S.TARGET)
    keyed = write_out(splitting.with_row_key(usable.withColumn(S.POINT_ID, F.lit(None).cast("string"))), "keyed")
    split = splitting.fit_split(keyed, S.POINT_ID, row_key=S.ROW_KEY).apply(keyed)
    return split.groupBy(S.TARGET, splitting.SPLIT).agg(F.count(F.lit(1)).alias("n"))


@query(f"""WITH {C.ENCODED} SELECT id_pdc_itinerance, latitude, longitude FROM encoded
WHERE longitude BETWEEN -5.5 AND 10.5 AND latitude BETWEEN 41 AND 52""")
def bbox_filter(spark, sf_dir):
    points = registry.keep_located(_encoded(spark, sf_dir))
    return registry.keep_in_viewport(points).select(S.POINT_ID, "latitude", "longitude")


@query(f"""WITH {C.RAW} SELECT id_pdc_itinerance, {', '.join(f'{C.sql_flag(c)} AS {c}' for c in S.PLUG_FLAGS)}
FROM raw""")
def bool_normalize(spark, sf_dir):
    raw = raw_registry(spark, sf_dir)
    return raw.select(S.POINT_ID, *[cleaning.flag_from_text(F.col(c)).alias(c) for c in S.PLUG_FLAGS])


@query(f"WITH {C.RAW} SELECT id_pdc_itinerance, {C.SQL_CODE} AS implantation_encoded FROM raw")
def encode_ordinal(spark, sf_dir):
    code = cleaning.ordinal_code(F.col(S.SITE_TYPE), S.SITE_TYPE_CODES)
    return raw_registry(spark, sf_dir).select(S.POINT_ID, code.alias("implantation_encoded"))


@query("""SELECT doc_id, CASE WHEN lower(text) LIKE '%license%' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS has_text
FROM documents""")
def contains_flag(spark, sf_dir):
    docs = table(spark, sf_dir, "documents")
    return docs.select("doc_id", cleaning.contains_flag(F.col("text"), "license").alias("has_text"))


@query(f"""WITH {C.RAW} SELECT id_pdc_itinerance, {C.sql_number('puissance_nominale')} AS puissance_nominale,
  {C.sql_number('nbre_pdc')} AS nbre_pdc, {C.sql_number('consolidated_longitude')} AS longitude FROM raw""")
def numeric_coerce(spark, sf_dir):
    raw = raw_registry(spark, sf_dir)
    n = cleaning.numeric_or_null
    return raw.select(
        S.POINT_ID, n(F.col(S.POWER)).alias(S.POWER), n(F.col(S.POINT_COUNT)).alias(S.POINT_COUNT),
        n(F.col(S.RAW_LONGITUDE)).alias("longitude"),
    )


@query("""SELECT event_id, CASE WHEN regexp_matches(json_extract_string(props, '$.k'), '^[0-9]+$')
  THEN CAST(json_extract_string(props, '$.k') AS DOUBLE) END AS k FROM events""")
def numeric_coerce_json(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select(
        "event_id", cleaning.numeric_or_null(F.get_json_object("props", "$.k")).alias("k")
    )


@query(f"WITH {C.SIZES} SELECT consolidated_commune, round(ln(1.0 + nombre_pdc_commune), 6) AS log_count FROM sizes")
def log_counts(spark, sf_dir):
    sizes = groups.group_sizes(_cleaned(spark, sf_dir))
    return six_digits(sizes.select(S.GROUP, F.log1p(F.col(levels.SIZE).cast("double")).alias("log_count")))


# --- Joins --------------------------------------------------------------------------------

@query(f"WITH {C.LEVELLED} SELECT id_pdc_itinerance, consolidated_commune, label FROM labelled")
def label_join_back(spark, sf_dir):
    return _labelled(spark, sf_dir).select(S.POINT_ID, S.GROUP, S.TARGET)


@query(f"""WITH {C.LEVELLED} SELECT c.id_pdc_itinerance, c.consolidated_commune, g.label
FROM cleaned c LEFT JOIN groups g USING (consolidated_commune)""")
def label_join_left(spark, sf_dir):
    """The left form, through the route for many groups: hot groups broadcast, the rest shuffled."""
    points = _cleaned(spark, sf_dir).select(S.POINT_ID, S.GROUP)
    sizes = _sizes(spark, sf_dir)
    fit = levels.fit_levels(sizes)[3]
    return levels.join_labels(
        points, levels.label_groups(sizes, fit), how="left", n_groups=sum(fit.counts),
        n_points=sum(fit.points), broadcast_limit=0,
    )


_Z = [f"{c}_z" for c in S.FEATURES]


@query(f"""WITH {C.USABLE}, {C.sql_split('usable', 'id_pdc_itinerance', 'label')},
scaled AS (SELECT id_pdc_itinerance AS id, label, split,
  {', '.join(f"({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END AS {c}_z" for c in S.FEATURES)}
  FROM divided),
pairs AS (SELECT t.id AS query_id, r.id AS train_id, r.label,
  round({' + '.join(f'(t.{z} - r.{z}) * (t.{z} - r.{z})' for z in _Z)}, 9) AS dist2
  FROM scaled t JOIN scaled r ON t.split = 'test' AND r.split = 'train'),
ranked AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY dist2, train_id) AS rank FROM pairs
  QUALIFY rank <= 7)
SELECT query_id, CAST(rank AS INT) AS rank, train_id, round(dist2, 6) AS dist2, label FROM ranked""")
def knn_join_topk(spark, sf_dir):
    scaled = levels.standardize(_split(spark, sf_dir), S.FEATURES)
    test = scaled.filter(F.col(splitting.SPLIT) == splitting.TEST)
    train = scaled.filter(F.col(splitting.SPLIT) == splitting.TRAIN)
    return six_digits(knn.knn_join(test, train, _Z, S.POINT_ID, S.POINT_ID))


_EMBED = f"""{C.sql_split('embeddings', 'vec_id', 'label')},
pairs AS (SELECT t.vec_id, r.vec_id AS train_id, r.label,
  round(list_sum([(x[1]::DOUBLE - x[2]::DOUBLE) * (x[1]::DOUBLE - x[2]::DOUBLE)
    FOR x IN list_zip(t.embedding, r.embedding)]), 9) AS dist2
  FROM divided t JOIN divided r ON t.split = 'test' AND r.split = 'train'),
near AS (SELECT * FROM pairs QUALIFY row_number() OVER (PARTITION BY vec_id ORDER BY dist2, train_id) <= 7),
votes AS (SELECT vec_id, label, count(*) AS n FROM near GROUP BY 1, 2)"""


def _embedding_sides(spark, sf_dir):
    vectors = table(spark, sf_dir, "embeddings")
    split = splitting.fit_split(vectors, "vec_id").apply(vectors)
    side = F.col(splitting.SPLIT)
    return split.filter(side == splitting.TEST), split.filter(side == splitting.TRAIN)


@query(f"""WITH {_EMBED} SELECT vec_id, CAST(arg_max(label, n * 100 - label) AS INT) AS prediction,
  round(max(n) / 7.0::DOUBLE, 6) AS share FROM votes GROUP BY vec_id""")
def knn_predict(spark, sf_dir):
    test, train = _embedding_sides(spark, sf_dir)
    voted = knn.knn_predict(test, train, "embedding", "vec_id", "vec_id", classes=range(10))
    return six_digits(voted.select(
        F.col("query_id").alias("vec_id"), "prediction", F.array_max("probabilities").alias("share")
    ))


@query(ORACLES["knn_predict"])
def knn_predict_partitioned(spark, sf_dir):
    """The same through the route for training tables too large to broadcast."""
    test, train = _embedding_sides(spark, sf_dir)
    voted = knn.knn_predict(
        test, train, "embedding", "vec_id", "vec_id", classes=range(10), broadcast_bytes=0, pivots=16,
    )
    return six_digits(voted.select(
        F.col("query_id").alias("vec_id"), "prediction", F.array_max("probabilities").alias("share")
    ))


# --- Aggregations -------------------------------------------------------------------------

@query(f"WITH {C.SIZES} SELECT * FROM sizes")
def group_sizes(spark, sf_dir):
    return groups.group_sizes(_cleaned(spark, sf_dir))


@query(f"""WITH {C.ENCODED} SELECT consolidated_commune, count(id_pdc_itinerance) AS nb_pdc,
  round(avg(latitude), 6) AS latitude, round(avg(longitude), 6) AS longitude FROM encoded
WHERE latitude IS NOT NULL AND longitude IS NOT NULL AND consolidated_commune IS NOT NULL GROUP BY 1""")
def group_profile(spark, sf_dir):
    return six_digits(groups.group_profile(registry.keep_located(_encoded(spark, sf_dir))))


@query(f"""WITH {C.CLEANED} SELECT consolidated_commune, round(avg(latitude), 6) AS latitude,
  round(avg(longitude), 6) AS longitude FROM cleaned WHERE consolidated_commune IS NOT NULL GROUP BY 1""")
def group_centroids(spark, sf_dir):
    return six_digits(groups.group_centroids(_cleaned(spark, sf_dir)))


@query(f"""WITH {C.CLEANED} SELECT consolidated_commune, round(avg(latitude), 6) AS latitude, round(avg(longitude), 6) AS longitude
FROM cleaned WHERE consolidated_commune = (SELECT min(consolidated_commune) FROM cleaned) GROUP BY ALL""")
def centroid_lookup(spark, sf_dir):
    """The mean position of one group, as the station form asks for it."""
    points = _cleaned(spark, sf_dir)
    return six_digits(groups.centroid_of(points, points.agg(F.min(S.GROUP)).first()[0]))


_LEVEL_NAME = "CASE label WHEN 0 THEN 'Sous-équipé' WHEN 1 THEN 'Normalement équipé' ELSE 'Bien équipé' END"


@query(f"""WITH {C.LEVELLED} SELECT consolidated_commune, round(avg(latitude), 6) AS latitude,
  round(avg(longitude), 6) AS longitude, count(label) AS nombre_pdc, max({_LEVEL_NAME}) AS "Niveau"
FROM labelled GROUP BY 1""")
def map_bubbles(spark, sf_dir):
    name = cleaning.name_of(F.col(S.TARGET), S.LEVEL_NAMES)
    return six_digits(groups.map_bubbles(_labelled(spark, sf_dir), name))


@query(f"""WITH {C.LEVELLED} SELECT label, count(*) AS n_groups, round(avg(nombre_pdc_commune), 6) AS mean_points,
  max(nombre_pdc_commune) AS max_points FROM groups GROUP BY label""")
def class_stats(spark, sf_dir):
    return six_digits(groups.class_stats(_labelled(spark, sf_dir)))


@query(f"""WITH {C.LEVELLED}, {C.REPORT} SELECT count(*) AS n_points, count(DISTINCT consolidated_commune) AS n_groups,
  round(avg(puissance_nominale), 6) AS mean_power,
  (SELECT round(max(f1_weighted), 6) FROM metrics) AS best_f1_weighted FROM labelled""")
def kpis(spark, sf_dir):
    return six_digits(groups.kpis(_labelled(spark, sf_dir), _metrics(spark, sf_dir)))


@query(f"""WITH {C.RAW}, missing AS (SELECT {', '.join(f'count(*) - count({c}) AS {c}' for c in S.RAW_COLUMNS)}
  FROM raw WHERE nom_operateur = '{C.OPERATOR}')
SELECT column_name, n_missing FROM (UNPIVOT missing ON COLUMNS(*) INTO NAME column_name VALUE n_missing)
WHERE n_missing > 0""")
def null_profile(spark, sf_dir):
    return profiling.null_profile(registry.keep_operator(raw_registry(spark, sf_dir), C.OPERATOR))


@query(f"""WITH {C.RAW} SELECT condition_acces AS value, count(*) AS n FROM raw
WHERE condition_acces IS NOT NULL AND nom_operateur = '{C.OPERATOR}' GROUP BY 1""")
def value_counts(spark, sf_dir):
    points = registry.keep_operator(raw_registry(spark, sf_dir), C.OPERATOR)
    return profiling.value_counts(points, S.ACCESS)


@query(f"""WITH {C.RAW} SELECT implantation_station AS value, substring(implantation_station, 1, 30) AS display,
  count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM raw
WHERE implantation_station IS NOT NULL AND nom_operateur = '{C.OPERATOR}' GROUP BY 1, 2""")
def value_shares(spark, sf_dir):
    points = registry.keep_operator(raw_registry(spark, sf_dir), C.OPERATOR)
    return six_digits(profiling.value_shares(points, S.SITE_TYPE))


@query(f"""WITH {C.LEVELLED} SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share
FROM labelled GROUP BY label""")
def label_shares(spark, sf_dir):
    return six_digits(metrics.label_shares(_labelled(spark, sf_dir)))


@query(f"WITH {C.CLEANED} " + " UNION ALL ".join(
    f"SELECT '{name}' AS name, CAST(sum({c}) AS BIGINT) AS total FROM cleaned" for c, name in S.PLUG_NAMES.items()))
def flag_totals(spark, sf_dir):
    return profiling.flag_totals(_cleaned(spark, sf_dir), S.PLUG_NAMES)


@query(f"""WITH {C.PREDICTIONS} SELECT model_key, CAST(y AS INT) AS truth,
  {', '.join(f'count(*) FILTER (p = {c}) AS pred_{c}' for c in S.LEVELS)}, 0::BIGINT AS pred_other,
  CASE y WHEN 0 THEN 'Sous-équipé' WHEN 1 THEN 'Normalement équipé' ELSE 'Bien équipé' END AS "Niveau"
FROM predictions GROUP BY model_key, y""")
def report_confusion(spark, sf_dir):
    """One square per model, through the report run."""
    return explore.report(_labelled(spark, sf_dir), _predictions(spark, sf_dir))["confusion"]


@query(f"""WITH {C.LEVELLED} SELECT label, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share,
  {_LEVEL_NAME} AS "Niveau" FROM labelled GROUP BY label""")
def report_label_shares(spark, sf_dir):
    return six_digits(explore.report(_labelled(spark, sf_dir))["label_shares"])


@query(ORACLES["null_profile"])
def explore_null_profile(spark, sf_dir):
    return explore.explore(raw_registry(spark, sf_dir), C.OPERATOR, (2, 3))["null_profile"]


def _describe_sql(source: str, column: str) -> str:
    return f"""SELECT count({column}) AS count, round(avg({column}), 6) AS mean, round(stddev_samp({column}), 6) AS std,
  round(min({column})::DOUBLE, 6) AS min, round(quantile_cont({column}, 0.25), 6) AS p25,
  round(quantile_cont({column}, 0.5), 6) AS p50, round(quantile_cont({column}, 0.75), 6) AS p75,
  round(max({column})::DOUBLE, 6) AS max FROM {source}"""


@query(_describe_sql("lineitem", "l_extendedprice"))
def describe(spark, sf_dir):
    return six_digits(profiling.describe(table(spark, sf_dir, "lineitem"), "l_extendedprice"))


@query(_describe_sql("lineitem", "l_extendedprice"))
def describe_large(spark, sf_dir):
    """The same through the rank search that replaces the in-memory percentile on large data."""
    return six_digits(profiling.describe(table(spark, sf_dir, "lineitem"), "l_extendedprice", keep=100))


@query(f"WITH {C.SIZES} " + _describe_sql("sizes", "nombre_pdc_commune"))
def describe_sizes(spark, sf_dir):
    return six_digits(profiling.describe(groups.group_sizes(_cleaned(spark, sf_dir)), levels.SIZE))


def _histogram_sql(prefix: str, source: str, value: str, bins: int, by: str = "") -> str:
    key = f"{by}, " if by else ""
    head = f"""{prefix} vals AS (SELECT {key}CAST({value} AS DOUBLE) AS x FROM {source} WHERE ({value}) IS NOT NULL),
span AS (SELECT CASE WHEN min(x) = max(x) THEN min(x) - 0.5 ELSE min(x) END AS lo,
  CASE WHEN min(x) = max(x) THEN max(x) + 0.5 ELSE max(x) END AS hi FROM vals),
edges AS (SELECT CAST(i AS INT) AS bin, i * ((hi - lo) / {bins}.0::DOUBLE) + lo AS low,
  CASE WHEN i = {bins - 1} THEN hi ELSE (i + 1) * ((hi - lo) / {bins}.0::DOUBLE) + lo END AS high
  FROM span, range({bins}) AS r(i))"""
    inside = f"v.x >= e.low AND (v.x < e.high OR (e.bin = {bins - 1} AND v.x <= e.high))"
    join = "JOIN" if by else "LEFT JOIN"
    group = f"v.{by}, " if by else ""
    return f"""{head}
SELECT {group}e.bin, round(e.low, 6) AS low, round(e.high, 6) AS high, count(v.x) AS n
FROM edges e {join} vals v ON {inside} GROUP BY {group}e.bin, e.low, e.high"""


@query(_histogram_sql("WITH", "orders", "o_totalprice", 40))
def histogram(spark, sf_dir):
    return six_digits(profiling.histogram(table(spark, sf_dir, "orders"), F.col("o_totalprice"), 40))


@query(_histogram_sql(f"WITH {C.SIZES},", "sizes", "nombre_pdc_commune", 30))
def histogram_sizes(spark, sf_dir):
    sizes = groups.group_sizes(_cleaned(spark, sf_dir))
    return six_digits(profiling.histogram(sizes, F.col(levels.SIZE), 30))


@query(_histogram_sql(f"WITH {C.SIZES},", "sizes", "ln(1.0 + nombre_pdc_commune)", 30))
def histogram_log(spark, sf_dir):
    sizes = groups.group_sizes(_cleaned(spark, sf_dir))
    return six_digits(profiling.histogram(sizes, F.log1p(F.col(levels.SIZE).cast("double")), 30))


@query(_histogram_sql(f"WITH {C.LEVELLED},", "labelled", "puissance_nominale", 20, by="label"))
def histogram_by_label(spark, sf_dir):
    points = write_out(_labelled(spark, sf_dir).select(S.TARGET, S.POWER), "labelled")  # read twice
    return six_digits(profiling.histogram(points, F.col(S.POWER), 20, by=[S.TARGET]))


@query(f"""WITH {C.LEVELLED} SELECT label, count(*) AS n,
  round(sum(count(*)) OVER () / (count(*) OVER () * count(*)), 6) AS weight FROM labelled GROUP BY label""")
def balanced_weights(spark, sf_dir):
    return six_digits(splitting.class_weights(_labelled(spark, sf_dir)))


@query(f"""WITH {C.LEVELLED}, w AS (SELECT label, sum(count(*)) OVER () / (count(*) OVER () * count(*)) AS weight
  FROM labelled GROUP BY label)
SELECT id_pdc_itinerance, label, round(weight, 6) AS weight FROM labelled JOIN w USING (label)""")
def sample_weights(spark, sf_dir):
    weighted = splitting.with_class_weight(_labelled(spark, sf_dir))
    return six_digits(weighted.select(S.POINT_ID, S.TARGET, "weight"))


@query(f"""WITH {C.USABLE} SELECT id_pdc_itinerance,
  {', '.join(f"round(({c} - avg({c}) OVER ()) / CASE WHEN stddev_pop({c}) OVER () = 0 THEN 1 ELSE stddev_pop({c}) OVER () END, 6) + 0.0 AS {c}_z" for c in S.FEATURES)}
FROM usable""")
def standardize(spark, sf_dir):
    usable = write_out(_labelled(spark, sf_dir).na.drop(subset=S.FEATURES).select(S.POINT_ID, *S.FEATURES), "usable")
    scaled = levels.standardize(usable, S.FEATURES)
    return six_digits(scaled.select(S.POINT_ID, *[(F.col(z) + 0.0).alias(z) for z in _Z]))


# --- Level labelling ----------------------------------------------------------------------

@query(f"WITH {C.LEVELLED} SELECT consolidated_commune, nombre_pdc_commune, label FROM groups")
def level_labels(spark, sf_dir):
    sizes = _sizes(spark, sf_dir)
    return levels.label_groups(sizes, levels.fit_levels(sizes)[3])


@query(f"""WITH {C.LEVELLED} SELECT label, count(*) AS n_groups, CAST(sum(nombre_pdc_commune) AS BIGINT) AS n_points,
  round(avg(nombre_pdc_commune), 6) AS mean_points, max(nombre_pdc_commune) AS max_points FROM groups GROUP BY label""")
def level_summary(spark, sf_dir):
    return six_digits(levels.level_summary(level_labels(spark, sf_dir)))


_PROFILE = f"""{C.ENCODED},
sizes AS (SELECT consolidated_commune, count(id_pdc_itinerance) AS nb_pdc, avg(latitude) AS latitude,
  avg(longitude) AS longitude FROM encoded WHERE latitude IS NOT NULL AND longitude IS NOT NULL
  AND consolidated_commune IS NOT NULL GROUP BY 1)"""


@query(f"""WITH {C.sql_clusters(3, _PROFILE, 'nb_pdc')}, cut AS (SELECT cuts FROM best3 ORDER BY i DESC LIMIT 1)
SELECT consolidated_commune, nb_pdc, round(latitude, 6) AS latitude, round(longitude, 6) AS longitude,
  CAST(len([c FOR c IN cut.cuts IF h.i > c]) AS INT) AS label
FROM sizes s JOIN hist h ON h.size = s.nb_pdc CROSS JOIN cut""")
def level_labels_profile(spark, sf_dir):
    """Levels of the exploratory counts: non-null ids of located points, whatever their power."""
    sizes = write_out(groups.group_profile(registry.keep_located(_encoded(spark, sf_dir))), "profile")
    fit = levels.fit_levels(sizes, size="nb_pdc")[3]
    return six_digits(levels.label_groups(sizes, fit, "nb_pdc"))


@query(f"WITH {C.SIZES} SELECT count(*) AS n_groups, TRUE AS not_below_the_optimum, TRUE AS in_order FROM sizes")
def level_kmeans_cost(spark, sf_dir):
    """MLlib's cost is no lower than the exact optimum (with few distinct sizes all its starts may
    end some 14 % above it), and larger groups have no lower level."""
    sizes = _sizes(spark, sf_dir)
    labelled, cost = levels.kmeans_labels(sizes)
    best = levels.fit_levels(sizes, (3,))[3].inertia
    ends = labelled.groupBy(S.TARGET).agg(
        F.min(levels.SIZE).alias("low"), F.max(levels.SIZE).alias("high"), F.count(F.lit(1)).alias("n")
    )
    rows = ends.orderBy(S.TARGET).collect()  # three
    ordered = all(a["high"] < b["low"] for a, b in zip(rows, rows[1:]))
    return spark.createDataFrame(
        [(sum(r["n"] for r in rows), bool(best * 0.999999 <= cost), ordered)],
        "n_groups bigint, not_below_the_optimum boolean, in_order boolean",
    )


@query()
def level_labels_kmeans(spark, sf_dir):
    return levels.kmeans_labels(_sizes(spark, sf_dir))[0]


@query(f"""WITH {C.LEVELLED}, raw_ids AS (SELECT *, (label * 2 + 1) % 3 AS cluster FROM groups),
means AS (SELECT cluster, row_number() OVER (ORDER BY avg(nombre_pdc_commune), cluster) - 1 AS r
  FROM raw_ids GROUP BY cluster)
SELECT consolidated_commune, CAST(cluster AS INT) AS cluster, CAST(r AS INT) AS label FROM raw_ids JOIN means USING (cluster)""")
def rank_clusters(spark, sf_dir):
    """Levels under scrambled ids are put back in order."""
    scrambled = level_labels(spark, sf_dir).withColumn("cluster", ((F.col(S.TARGET) * 2 + 1) % 3).cast("int"))
    ranked = levels.rank_clusters(scrambled.drop(S.TARGET), "cluster", levels.SIZE)
    return ranked.select(S.GROUP, "cluster", S.TARGET)


@query(f"WITH {C.sql_clusters(8)} " + " UNION ALL ".join(
    f"SELECT {k}::INT AS k, round(max_by(cost, i) / (SELECT variance FROM spread), 6) AS inertia FROM best{k}"
    for k in range(2, 9)))
def elbow(spark, sf_dir):
    return six_digits(levels.elbow(_sizes(spark, sf_dir)))


def _silhouette_sql() -> str:
    cuts = ", ".join(f"cut{k} AS (SELECT cuts FROM best{k} ORDER BY i DESC LIMIT 1)" for k in range(2, 9))
    marks = " UNION ALL ".join(
        f"SELECT {k} AS k, i, n, x, len([c FOR c IN cuts IF i > c]) AS lev FROM hist, cut{k}"
        for k in range(2, 9))
    return f"""WITH {C.sql_clusters(8)}, {cuts}, marked AS ({marks}),
dist AS (SELECT a.k, a.i, a.n, a.lev, b.lev AS other, sum(b.n) AS m, sum(b.n * abs(a.x - b.x)) AS d
  FROM marked a JOIN marked b ON a.k = b.k GROUP BY ALL),
own AS (SELECT k, i, n, CASE WHEN m > 1 THEN d / (m - 1) END AS a FROM dist WHERE lev = other),
near AS (SELECT k, i, min(d / m) AS b FROM dist WHERE lev <> other GROUP BY k, i)
SELECT CAST(k AS INT) AS k, round(sum(n * CASE WHEN a IS NULL OR greatest(a, b) = 0 THEN 0 ELSE (b - a) / greatest(a, b) END) / sum(n), 6) AS silhouette
FROM own JOIN near USING (k, i) GROUP BY k"""


@query(_silhouette_sql())
def silhouette(spark, sf_dir):
    return six_digits(levels.silhouette(_sizes(spark, sf_dir)))


# --- Split ---------------------------------------------------------------------------------

@query(f"""WITH {C.USABLE}, {C.sql_split('usable', 'id_pdc_itinerance', 'label')}
SELECT id_pdc_itinerance, label, split FROM divided""")
def stratified_split(spark, sf_dir):
    return _split(spark, sf_dir).select(S.POINT_ID, S.TARGET, splitting.SPLIT)


@query(f"""WITH {C.USABLE}, {C.sql_split('usable', 'id_pdc_itinerance', 'label')}
SELECT (SELECT count(*) FROM (SELECT id_pdc_itinerance FROM divided WHERE split = 'test'
    INTERSECT SELECT id_pdc_itinerance FROM divided WHERE split = 'train')) AS n_both,
  (SELECT count(*) FROM (SELECT id_pdc_itinerance FROM usable EXCEPT ALL SELECT id_pdc_itinerance FROM divided)) AS n_neither""")
def split_overlap(spark, sf_dir):
    return splitting.split_overlap(_split(spark, sf_dir), [S.POINT_ID])


# --- Sorts, limits, top rows -----------------------------------------------------------------

@query("SELECT * FROM orders ORDER BY o_orderkey LIMIT 3")
def preview(spark, sf_dir):
    return profiling.preview(table(spark, sf_dir, "orders"), "o_orderkey")


_METRIC_OUT = ", ".join(f"round({c}, 6) AS {c}" for c in S.METRICS)


@query(f"""WITH {C.REPORT} SELECT model_key, model_name, model_path, {_METRIC_OUT} FROM metrics
ORDER BY f1_weighted DESC, model_key LIMIT 1""")
def best_model(spark, sf_dir):
    return six_digits(metrics.best_model(_metrics(spark, sf_dir)))


# --- Decisions and metrics -------------------------------------------------------------------

@query(f"WITH {C.SCORED} SELECT id, CAST({C.SQL_ARGMAX} AS INT) AS prediction FROM scored")
def argmax_decision(spark, sf_dir):
    rule = decisions.argmax_class(F.col("probabilities"))
    return scored(spark, sf_dir).select("id", rule.alias("prediction"))


@query(f"WITH {C.SCORED} SELECT id, CAST({C.SQL_TUNED} AS INT) AS prediction FROM scored")
def threshold_decision(spark, sf_dir):
    rule = decisions.threshold_class(F.col("probabilities"), S.CLASS0_THRESHOLD)
    return scored(spark, sf_dir).select("id", rule.alias("prediction"))


@query(f"""WITH {C.PREDICTIONS} SELECT CAST(y AS INT) AS truth, {', '.join(f'count(*) FILTER (p = {c}) AS pred_{c}' for c in S.LEVELS)},
  count(*) FILTER (p IS NULL OR p NOT IN (0, 1, 2)) AS pred_other FROM predictions WHERE model_key = 'xgboost' GROUP BY y""")
def confusion(spark, sf_dir):
    return metrics.confusion_matrix(_predictions(spark, sf_dir).filter("model_key = 'xgboost'"))


@query("""WITH pairs AS (SELECT quality AS y, CASE WHEN n_chars > 500 THEN 1 ELSE 0 END AS p
  FROM labels JOIN documents USING (doc_id)),
r AS (SELECT l.label, count(*) FILTER (y = l.label AND p = l.label) AS hits, count(*) FILTER (p = l.label) AS called,
  count(*) FILTER (y = l.label) AS support
  FROM (SELECT y AS label FROM pairs UNION SELECT p FROM pairs) l, pairs GROUP BY l.label),
s AS (SELECT *, CASE WHEN called = 0 THEN 0 ELSE hits::DOUBLE / called END AS prec,
  CASE WHEN support = 0 THEN 0 ELSE hits::DOUBLE / support END AS rec, 2.0 * hits::DOUBLE / (called + support) AS f FROM r)
SELECT round(sum(hits)::DOUBLE / sum(support), 6) AS accuracy, round(sum(f * support) / sum(support), 6) AS f1_weighted,
  round(avg(f), 6) AS f1_macro, round(avg(prec), 6) AS precision_macro, round(avg(rec), 6) AS recall_macro FROM s""")
def classification_metrics(spark, sf_dir):
    """A length rule judged against the quality labels."""
    pairs = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents"), "doc_id").select(
        F.col("quality").alias("y"), F.when(F.col("n_chars") > 500, 1).otherwise(0).alias("p")
    )
    return six_digits(metrics.classification_metrics(pairs))


@query(f"""WITH {C.REPORT}, s AS (SELECT * FROM scores WHERE model_key = 'xgboost')
SELECT CAST(label AS VARCHAR) AS row, round(prec, 6) AS precision, round(rec, 6) AS recall, round(f1, 6) AS f1,
  support FROM s
UNION ALL SELECT 'accuracy', round(sum(hits)::DOUBLE / sum(support), 6), round(sum(hits)::DOUBLE / sum(support), 6),
  round(sum(hits)::DOUBLE / sum(support), 6), CAST(sum(support) AS BIGINT) FROM s
UNION ALL SELECT 'macro avg', round(avg(prec), 6), round(avg(rec), 6), round(avg(f1), 6), CAST(sum(support) AS BIGINT) FROM s
UNION ALL SELECT 'weighted avg', round(sum(prec * support) / sum(support), 6), round(sum(rec * support) / sum(support), 6),
  round(sum(f1 * support) / sum(support), 6), CAST(sum(support) AS BIGINT) FROM s""")
def class_report(spark, sf_dir):
    return six_digits(metrics.full_report(_predictions(spark, sf_dir).filter("model_key = 'xgboost'")))


@query(f"WITH {C.REPORT} SELECT model_key, model_name, model_path, {_METRIC_OUT} FROM metrics")
def evaluate_models(spark, sf_dir):
    return six_digits(_metrics(spark, sf_dir))


@query(ORACLES["evaluate_models"])
def roundtrip_metrics(spark, sf_dir):
    path = scratch_path(spark, "metrics")
    tables.write_metrics(_metrics(spark, sf_dir), path)
    return six_digits(tables.read_metrics(spark, path))


@query(f"WITH {C.REPORT} " + " UNION ALL ".join(
    f"SELECT model_key, model_name, '{c}' AS metric, round({c}, 6) AS value FROM metrics" for c in S.METRICS))
def metrics_long(spark, sf_dir):
    return six_digits(metrics.metrics_long(_metrics(spark, sf_dir)))


@query(f'WITH {C.REPORT} SELECT model_name AS "Modèle", '
       + ", ".join(f"printf('%.4f', {c}) AS {c}" for c in S.METRICS) + " FROM metrics")
def metrics_display(spark, sf_dir):
    return metrics.metrics_display(_metrics(spark, sf_dir))


@query(f"WITH {C.SWEEP} {C.SWEEP_OUT} sweep")
def threshold_sweep(spark, sf_dir):
    return six_digits(_sweep(spark, sf_dir))


@query(f"WITH {C.SWEEP} {C.SWEEP_OUT} (SELECT * FROM sweep ORDER BY f1 DESC, seuil LIMIT 1) AS top")
def threshold_best_f1(spark, sf_dir):
    return six_digits(thresholds.best_f1_threshold(_sweep(spark, sf_dir)))


@query(f"""WITH {C.SWEEP} {C.SWEEP_OUT}
(SELECT * FROM sweep WHERE rappel >= 0.8 ORDER BY precision DESC, seuil LIMIT 1) AS top""")
def threshold_best_recall(spark, sf_dir):
    return six_digits(thresholds.best_recall_threshold(_sweep(spark, sf_dir)))


@query(f"WITH {C.SWEEP} {C.SWEEP_OUT} (SELECT * FROM sweep ORDER BY abs(seuil - 0.333), seuil LIMIT 1) AS top")
def threshold_nearest(spark, sf_dir):
    return six_digits(thresholds.nearest_threshold(_sweep(spark, sf_dir), 0.333))


@query(f"WITH {C.SWEEP} SELECT round(rappel, 6) AS rappel, round(precision, 6) AS precision FROM sweep")
def pr_curve(spark, sf_dir):
    return six_digits(thresholds.pr_curve(_sweep(spark, sf_dir)))


@query(f"""WITH {C.SWEEP},
base AS (SELECT count(*) AS n, count(*) FILTER (c = 0) AS called, count(*) FILTER (c = 0 AND y = 0) AS hits,
  count(*) FILTER (y = 0) AS support, count(*) FILTER (y = c) AS good
  FROM (SELECT y, {C.SQL_ARGMAX} AS c FROM scored) AS decided),
picked AS (
  SELECT 'baseline' AS rule, NULL::DOUBLE AS seuil, hits::DOUBLE / called AS precision, hits::DOUBLE / support AS rappel,
    2.0 * hits::DOUBLE / (called + support) AS f1, good::DOUBLE / n AS accuracy FROM base
  UNION ALL SELECT 'max_f1', * FROM (SELECT * FROM sweep ORDER BY f1 DESC, seuil LIMIT 1) AS a
  UNION ALL SELECT 'min_recall', * FROM (SELECT * FROM sweep WHERE rappel >= 0.8 ORDER BY precision DESC, seuil LIMIT 1) AS b)
SELECT rule, round(seuil, 6) AS seuil, round(precision, 6) AS precision, round(rappel, 6) AS rappel,
  round(f1, 6) AS f1, round(accuracy, 6) AS accuracy FROM picked""")
def threshold_summary(spark, sf_dir):
    return six_digits(thresholds.threshold_summary(scored(spark, sf_dir)))


@query(f"""WITH {C.LEVELLED}, checked AS (SELECT CASE WHEN count(*) = 0 THEN 1 ELSE 0 END::BIGINT AS rows_missing,
  count(*) FILTER (label IS NULL OR label NOT IN (0, 1, 2)) AS label_unknown,
  {', '.join(f'count(*) - count({c}) AS null_{c}' for c in S.FEATURES)} FROM labelled)
SELECT check_name, n_bad, n_bad = 0 AS passed
FROM (UNPIVOT checked ON COLUMNS(*) INTO NAME check_name VALUE n_bad)""")
def quality_checks(spark, sf_dir):
    return metrics.quality_checks(_labelled(spark, sf_dir))


# --- Learned models: rows only ---------------------------------------------------------------

def _parts(spark, sf_dir):
    split = _split(spark, sf_dir)
    side = F.col(splitting.SPLIT)
    return split.filter(side == splitting.TRAIN), split.filter(side == splitting.TEST)


_LR_COLUMNS = [*S.FEATURES, "(intercept)"]


@query("SELECT class, feature, 0.0::DOUBLE AS gradient FROM (VALUES (0), (1), (2)) AS c(class), (VALUES "
       + ", ".join(f"('{c}')" for c in _LR_COLUMNS) + ") AS f(feature)")
def lr_gradient(spark, sf_dir):
    """Gradient of the summed, weighted and penalised loss at the stored coefficients: 0 where, and only
    where, the loss is least, as it is convex. Written here in SQL over the training rows."""
    train, _ = _parts(spark, sf_dir)
    path = scratch_path(spark, "logistic")
    models.fit_logistic(train).save(path)
    coefficients = spark.read.parquet(f"{path}/coefficients")
    values = ", ".join(f"'{c}', CAST({c} AS DOUBLE)" for c in S.FEATURES)
    return spark.sql(
        f"""
        WITH long AS (SELECT {S.POINT_ID} AS id, label, stack({len(_LR_COLUMNS)}, {values}, '(intercept)', 1D) AS (feature, v) FROM {{train}}),
        z AS (SELECT id, label, feature, class, coefficient, (v - mean) / deviation AS x FROM long JOIN {{coefficients}} USING (feature)),
        logit AS (SELECT id, label, class, sum(coefficient * x) AS s FROM z GROUP BY id, label, class),
        share AS (SELECT *, exp(s) / sum(exp(s)) OVER (PARTITION BY id) AS p FROM logit),
        n AS (SELECT label, count(*) AS m FROM {{train}} GROUP BY label),
        w AS (SELECT label, sum(m) OVER () / (count(*) OVER () * m) AS w FROM n)
        SELECT z.class, z.feature, round(abs(sum(w * (p - CAST(z.label = z.class AS INT)) * x)
          + max(CASE WHEN z.feature = '(intercept)' THEN 0D ELSE coefficient END)), 5) AS gradient
        FROM z JOIN share ON share.id = z.id AND share.class = z.class JOIN w ON w.label = z.label
        GROUP BY z.class, z.feature""",
        train=train, coefficients=coefficients,
    )


@query()
def lr_predictions(spark, sf_dir):
    train, test = _parts(spark, sf_dir)
    return models.fit_logistic(train).score(test).select(S.POINT_ID, S.TARGET, "prediction", "probabilities")


_FITTED: dict[tuple[str, str], models.BoostedModel] = {}


def _boosted(spark, sf_dir):
    """The registered boosted model (200 rounds of depth 6), fitted once a session and folder."""
    key = spark.sparkContext.applicationId, sf_dir
    if key not in _FITTED:
        train, _ = _parts(spark, sf_dir)
        _FITTED[key] = models.registry("models")["xgboost"].fit(train)
    return _FITTED[key]


@query()
def gbt_predictions(spark, sf_dir):
    _, test = _parts(spark, sf_dir)
    return models.score_with(_boosted(spark, sf_dir), test, S.CLASS0_THRESHOLD).select(
        S.POINT_ID, S.TARGET, "prediction", "probabilities"
    )


@query(C.FIRST_GAINS)
def gbt_first_gains(spark, sf_dir):
    """The best gain of every feature at the root of every class's first tree."""
    train, _ = _parts(spark, sf_dir)
    return six_digits(boosting.first_gains(train))


@query(C.FIRST_TREES)
def gbt_first_trees(spark, sf_dir):
    """Every node of the first round of the registered model."""
    nodes = _boosted(spark, sf_dir).nodes(spark).filter("round = 0")
    return six_digits(nodes.select("tree_class", "node", "depth", "feature", "threshold", "gain", "value"))


_TEST_ROWS = f"""WITH {C.USABLE}, {C.sql_split('usable', 'id_pdc_itinerance', 'label')}
SELECT id_pdc_itinerance, label, TRUE AS sums_to_one, TRUE AS by_rule, TRUE AS same_when_loaded
FROM divided WHERE split = 'test'"""


def _checked_rows(spark, model, test, threshold=None):
    """Every test row with: whether its shares sum to 1, whether the class follows the rule from
    them, and whether the model scores it alike once saved and loaded."""
    path = scratch_path(spark, "model")
    model.save(path)
    kept = [S.POINT_ID, S.TARGET, "prediction", "probabilities"]
    first = models.score_with(model, test, threshold).select(*kept)
    again = models.score_with(models.load_model(spark, path), test, threshold)
    again = again.select(S.POINT_ID, F.col("probabilities").alias("loaded"))
    shares = F.col("probabilities")
    rule = decisions.argmax_class(shares) if threshold is None else decisions.threshold_class(shares, threshold)
    total = F.aggregate(shares, F.lit(0.0), lambda a, b: a + b)
    return first.join(again, S.POINT_ID).select(
        S.POINT_ID, S.TARGET,
        (F.abs(total - 1) < 1e-9).alias("sums_to_one"),
        (F.col("prediction") == rule).alias("by_rule"),
        (shares == F.col("loaded")).alias("same_when_loaded"),
    )


@query(_TEST_ROWS)
def lr_rows(spark, sf_dir):
    train, test = _parts(spark, sf_dir)
    return _checked_rows(spark, models.fit_logistic(train), test)


@query(_TEST_ROWS)
def gbt_rows(spark, sf_dir):
    _, test = _parts(spark, sf_dir)
    return _checked_rows(spark, _boosted(spark, sf_dir), test, S.CLASS0_THRESHOLD)


@query(_TEST_ROWS)
def knn_rows(spark, sf_dir):
    train, test = _parts(spark, sf_dir)
    return _checked_rows(spark, models.KnnModel.fit(train, S.POINT_ID), test)


@query(f"""WITH {C.USABLE}, {C.sql_split('usable', 'id_pdc_itinerance', 'label')}
SELECT model_key, count(*) AS n_scored FROM divided, (VALUES {", ".join(f"('{k}')" for k in MODEL_NAMES)}) AS m(model_key)
WHERE split = 'test' GROUP BY model_key""")
def train_all_models(spark, sf_dir):
    """The whole training run with all registered models; each is loaded and scores the test rows."""
    folder = scratch_path(spark, "run")
    registered = models.registry(f"{folder}/models")
    split = pipeline.prepare_and_train(raw_registry(spark, sf_dir), C.OPERATOR, f"{folder}/labelled", registered)
    test = split.filter(F.col(splitting.SPLIT) == splitting.TEST)
    scored_rows = metrics.stack_predictions(pipeline.predict_all(spark, test, registered))
    return scored_rows.groupBy("model_key").agg(F.count("p").alias("n_scored"))


@query(f"""SELECT consolidated_commune, puissance_nominale, TRUE AS sums_to_one
FROM ({ORACLES["whatif_grid"]}) AS grid""")
def whatif_rows(spark, sf_dir):
    train, _ = _parts(spark, sf_dir)
    scored_grid = models.fit_logistic(train).score(scenarios.whatif_grid(_labelled(spark, sf_dir)))
    total = F.aggregate("probabilities", F.lit(0.0), lambda a, b: a + b)
    return scored_grid.select(S.GROUP, S.POWER, (F.abs(total - 1) < 1e-9).alias("sums_to_one"))


@query()
def feature_importance(spark, sf_dir):
    ranked = _boosted(spark, sf_dir).importances()
    return spark.createDataFrame(ranked, "feature string, importance double")


@query()
def whatif_scores(spark, sf_dir):
    """Every group at every power level, scored by a model trained on the labelled points."""
    train, test = _parts(spark, sf_dir)
    grid = scenarios.whatif_grid(_labelled(spark, sf_dir))
    scored_grid = models.fit_logistic(train).score(grid)
    return scored_grid.select(S.GROUP, S.POWER, "prediction", "probabilities")
