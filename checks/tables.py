"""Stand-ins: a raw registry and a scored table, derived from every row of ``orders``.

Both are plain SQL texts over ``{orders}``, so that Spark and the checking engine start from
the same rows. The operators under test are written twice, independently.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from gradus import schema as S

OPERATOR = "F"

REGISTRY_SQL = """
SELECT
  CAST(o_orderkey AS STRING) AS id_pdc_itinerance,
  CAST(o_orderkey - o_orderkey % 4 AS STRING) AS id_station_itinerance,
  o_orderstatus AS nom_operateur,
  CASE WHEN o_orderkey % 37 = 0 THEN NULL
       WHEN o_orderkey % 41 = 0 THEN '50,5'
       WHEN o_orderkey % 43 = 0 THEN '1d'
       WHEN o_orderkey % 47 = 0 THEN ' 12 '
       WHEN o_orderkey % 53 = 0 THEN '1.5e2'
       ELSE CAST(CAST(FLOOR(o_totalprice / 2000) AS BIGINT) AS STRING) END AS puissance_nominale,
  CASE o_orderkey % 6 WHEN 0 THEN 'True' WHEN 1 THEN 'true' WHEN 2 THEN 'FALSE'
       WHEN 3 THEN ' true' WHEN 4 THEN NULL ELSE '1' END AS prise_type_ef,
  CASE WHEN o_custkey % 3 = 0 THEN 'TRUE' ELSE 'False' END AS prise_type_2,
  CASE WHEN o_orderkey % 2 = 0 THEN 'True' ELSE 'False' END AS prise_type_combo_ccs,
  CASE WHEN o_custkey % 5 = 0 THEN 'true' ELSE 'vrai' END AS prise_type_chademo,
  CASE WHEN o_orderkey % 11 = 0 THEN 'true' ELSE NULL END AS prise_type_autre,
  CASE WHEN o_orderpriority = '1-URGENT' THEN 'Station dédiée à la recharge rapide'
       WHEN o_orderpriority = '2-HIGH' THEN 'Parking privé à usage public'
       WHEN o_orderpriority = '3-MEDIUM' THEN 'Voirie'
       WHEN o_orderpriority = '4-NOT SPECIFIED' THEN 'Parking public'
       WHEN o_orderkey % 3 = 0 THEN 'Parking privé réservé à la clientèle'
       WHEN o_orderkey % 3 = 1 THEN 'Autre'
       ELSE NULL END AS implantation_station,
  CASE o_orderkey % 5 WHEN 0 THEN 'Accès libre' WHEN 1 THEN 'ACCÈS LIBRE' WHEN 2 THEN 'non libre'
       WHEN 3 THEN 'Accès réservé' ELSE NULL END AS condition_acces,
  CASE WHEN o_orderkey % 101 = 0 THEN 'n/a'
       ELSE CAST(1 + o_custkey % 36 AS STRING) END AS nbre_pdc,
  CASE WHEN o_orderkey % 31 = 0 THEN NULL
       ELSE CAST(39 + o_custkey % 15 AS STRING) || '.' || CAST(100 + o_orderkey % 900 AS STRING)
       END AS consolidated_latitude,
  CASE WHEN o_orderkey % 61 = 0 THEN 'inconnu'
       ELSE CAST(o_custkey % 18 - 7 AS STRING) || '.' || CAST(100 + o_orderkey % 700 AS STRING)
       END AS consolidated_longitude,
  CASE WHEN o_orderkey % 29 = 0 THEN NULL
       ELSE 'Commune ' || CAST(o_custkey AS STRING) END AS consolidated_commune
FROM {orders}
"""

SCORED_SQL = """
SELECT id, p0, p1, p2,
  CASE WHEN (id * 31) % 10 >= 6 THEN cust % 3
       WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END AS y,
  CAST((cust * 7 + id) % 3 AS INT) AS other_rule
FROM (
  SELECT id, cust,
    CAST(a AS DOUBLE) / (a + b + c) AS p0,
    CAST(b AS DOUBLE) / (a + b + c) AS p1,
    CAST(c AS DOUBLE) / (a + b + c) AS p2
  FROM (
    SELECT o_orderkey AS id, o_custkey AS cust,
      (o_orderkey * 7919 + o_custkey * 31) % 1000 + 1 AS a,
      (o_orderkey * 10473 + o_custkey * 7) % 1000 + 1 AS b,
      (o_orderkey * 12997 + o_custkey) % 1000 + 1 AS c
    FROM {orders}) AS parts) AS shares
"""


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def raw_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(REGISTRY_SQL, orders=table(spark, sf_dir, "orders"))


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """id, y (int), probabilities (array of 3) and a rule standing in for a second model."""
    rows = spark.sql(SCORED_SQL, orders=table(spark, sf_dir, "orders"))
    return rows.select(
        "id", F.col("y").cast("int").alias("y"), "other_rule",
        F.array("p0", "p1", "p2").alias("probabilities"),
    )


def six_digits(df: DataFrame) -> DataFrame:
    """Doubles rounded to six digits, as on the checking side."""
    return df.select(
        *[
            F.round(F.col(f"`{n}`"), 6).alias(n) if t == "double" else F.col(f"`{n}`")
            for n, t in df.dtypes
        ]
    )


# --- Building blocks of the checking SQL -------------------------------------------------

def sql_number(column: str) -> str:
    return f"TRY_CAST(trim({column}) AS DOUBLE)"


def sql_flag(column: str) -> str:
    return f"CASE WHEN lower({column}) = 'true' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END"


SQL_CODE = "CASE implantation_station " + " ".join(
    f"WHEN '{text}' THEN {code}" for text, code in S.SITE_TYPE_CODES.items()
) + f" ELSE {S.UNKNOWN_CODE} END::INT"

RAW = f"raw AS ({REGISTRY_SQL.format(orders='orders')})"
ENCODED = f"""{RAW},
encoded AS (
  SELECT id_pdc_itinerance, id_station_itinerance, consolidated_commune,
    {sql_number('consolidated_latitude')} AS latitude,
    {sql_number('consolidated_longitude')} AS longitude,
    {sql_number('puissance_nominale')} AS puissance_nominale,
    {', '.join(f'{sql_flag(c)} AS {c}' for c in S.PLUG_FLAGS)},
    {SQL_CODE} AS implantation_encoded,
    CASE WHEN lower(condition_acces) LIKE '%libre%' THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END AS acces_libre,
    {sql_number('nbre_pdc')} AS nbre_pdc
  FROM raw WHERE nom_operateur = '{OPERATOR}')"""
CLEANED = f"""{ENCODED},
cleaned AS (SELECT * FROM encoded WHERE puissance_nominale IS NOT NULL)"""
SIZES = f"""{CLEANED},
sizes AS (SELECT consolidated_commune, count(*) AS nombre_pdc_commune FROM cleaned
          WHERE consolidated_commune IS NOT NULL GROUP BY 1)"""


def sql_clusters(kmax: int, sizes: str = SIZES, size: str = "nombre_pdc_commune") -> str:
    """Exact 1-D k-means of ``sizes``: tables best1..best<kmax> over the distinct sizes."""
    text = f"""{sizes},
hist AS (SELECT {size} AS size, count(*) AS n, ln(1.0 + {size}) AS x,
           row_number() OVER (ORDER BY {size}) AS i FROM sizes GROUP BY {size}),
pre AS (SELECT i, sum(n) OVER (ORDER BY i) AS cn, sum(n * x) OVER (ORDER BY i) AS cs,
          sum(n * x * x) OVER (ORDER BY i) AS cq FROM hist
        UNION ALL SELECT 0, 0, 0, 0),
seg AS (SELECT a.i AS lo, b.i AS hi,
          (b.cq - a.cq) - (b.cs - a.cs) * (b.cs - a.cs) / (b.cn - a.cn) AS err
        FROM pre a JOIN pre b ON a.i < b.i),
spread AS (SELECT max(cq) / max(cn) - (max(cs) / max(cn)) * (max(cs) / max(cn)) AS variance FROM pre),
best1 AS (SELECT hi AS i, err AS cost, CAST([] AS BIGINT[]) AS cuts FROM seg WHERE lo = 0)"""
    for j in range(2, kmax + 1):
        text += f""",
best{j} AS (SELECT s.hi AS i, min(p.cost + s.err) AS cost,
          arg_min(list_append(p.cuts, p.i), p.cost + s.err) AS cuts
        FROM best{j - 1} p JOIN seg s ON s.lo = p.i GROUP BY s.hi)"""
    return text


LEVELLED = f"""{sql_clusters(3)},
cut AS (SELECT cuts FROM best3 ORDER BY i DESC LIMIT 1),
groups AS (SELECT s.*, CAST(len([c FOR c IN cut.cuts IF h.i > c]) AS INT) AS label
           FROM sizes s JOIN hist h ON h.size = s.nombre_pdc_commune CROSS JOIN cut),
labelled AS (SELECT c.*, g.label FROM cleaned c JOIN groups g USING (consolidated_commune))"""
USABLE = f"""{LEVELLED},
usable AS (SELECT * FROM labelled WHERE nbre_pdc IS NOT NULL)"""


def sql_split(source: str, key: str, label: str, name: str = "divided") -> str:
    """Exact stratified split of a table: quotas by largest remainder, rows by hash order."""
    return f"""
quota0 AS (SELECT {label} AS cls, count(*) AS m FROM {source} GROUP BY 1),
quota1 AS (SELECT cls, m, sum(m) OVER () AS n,
             sum(m) OVER () - ceil(0.2::DOUBLE * sum(m) OVER ()) AS n_train FROM quota0),
quota2 AS (SELECT cls, m, n_train, CAST(m * n_train AS HUGEINT) // CAST(n AS HUGEINT) AS base,
             CAST(m * n_train AS HUGEINT) % CAST(n AS HUGEINT) AS rest FROM quota1),
quota3 AS (SELECT cls, m - base - CASE WHEN row_number() OVER (ORDER BY rest DESC, cls)
             <= n_train - sum(base) OVER () THEN 1 ELSE 0 END AS n_test FROM quota2),
{name} AS (SELECT t.*, CASE WHEN row_number() OVER (PARTITION BY t.{label}
               ORDER BY md5(CAST(t.{key} AS VARCHAR) || '-42'), CAST(t.{key} AS VARCHAR)) <= q.n_test
               THEN 'test' ELSE 'train' END AS split
             FROM {source} t JOIN quota3 q ON q.cls = t.{label})"""


SCORED = f"scored AS ({SCORED_SQL.format(orders='orders')})"
SQL_ARGMAX = "CASE WHEN p0 >= p1 AND p0 >= p2 THEN 0 WHEN p1 >= p2 THEN 1 ELSE 2 END"
SQL_TUNED = "CASE WHEN p0 >= 0.63::DOUBLE THEN 0 WHEN p2 > p1 THEN 2 ELSE 1 END"
PREDICTIONS = f"""{SCORED},
predictions AS (
  SELECT 'logistic_regression' AS model_key, y, {SQL_ARGMAX} AS p FROM scored
  UNION ALL SELECT 'knn', y, other_rule FROM scored
  UNION ALL SELECT 'xgboost', y, {SQL_TUNED} FROM scored)"""
REPORT = f"""{PREDICTIONS},
every_label AS (SELECT model_key, y AS label FROM predictions UNION SELECT model_key, p FROM predictions),
report AS (
  SELECT l.model_key, l.label,
    count(*) FILTER (r.y = l.label AND r.p = l.label) AS hits,
    count(*) FILTER (r.p = l.label) AS called,
    count(*) FILTER (r.y = l.label) AS support
  FROM every_label l JOIN predictions r USING (model_key) GROUP BY 1, 2),
scores AS (
  SELECT *, CASE WHEN called = 0 THEN 0 ELSE hits::DOUBLE / called END AS prec,
    CASE WHEN support = 0 THEN 0 ELSE hits::DOUBLE / support END AS rec,
    CASE WHEN called + support = 0 THEN 0 ELSE 2.0 * hits::DOUBLE / (called + support) END AS f1
  FROM report),
metrics AS (
  SELECT model_key,
    CASE model_key WHEN 'logistic_regression' THEN 'Logistic Regression'
      WHEN 'knn' THEN 'K-Nearest Neighbors' ELSE 'Gradient-Boosted Trees' END AS model_name,
    'models/' || model_key AS model_path,
    sum(hits)::DOUBLE / sum(support) AS accuracy, sum(f1 * support) / sum(support) AS f1_weighted,
    avg(f1) AS f1_macro, avg(prec) AS precision_macro, avg(rec) AS recall_macro
  FROM scores GROUP BY model_key)"""
SWEEP = f"""{SCORED},
grid AS (SELECT i, 0.05::DOUBLE + i * ((0.05::DOUBLE + 0.01::DOUBLE) - 0.05::DOUBLE) AS t
         FROM range(90) AS r(i)),
counted AS (
  SELECT i, t, count(*) AS n, count(*) FILTER (p0 >= t) AS called,
    count(*) FILTER (p0 >= t AND y = 0) AS hits, count(*) FILTER (y = 0) AS support,
    count(*) FILTER (y = CASE WHEN p0 >= t THEN 0 WHEN p2 > p1 THEN 2 ELSE 1 END) AS good
  FROM scored, grid GROUP BY i, t),
sweep AS (
  SELECT round(t, 3) AS seuil,
    CASE WHEN called = 0 THEN 0.0::DOUBLE ELSE hits::DOUBLE / called END AS precision,
    CASE WHEN support = 0 THEN 0.0::DOUBLE ELSE hits::DOUBLE / support END AS rappel,
    CASE WHEN called + support = 0 THEN 0.0::DOUBLE ELSE 2.0 * hits::DOUBLE / (called + support) END AS f1,
    good::DOUBLE / n AS accuracy
  FROM counted)"""
SWEEP_OUT = ("SELECT round(seuil, 6) AS seuil, round(precision, 6) AS precision, round(rappel, 6) AS rappel, "
             "round(f1, 6) AS f1, round(accuracy, 6) AS accuracy FROM ")


# --- Softmax boosting: the first round, by trying every value as a split -----------------------

TRAIN = f"""{USABLE}, {sql_split('usable', 'id_pdc_itinerance', 'label')},
train AS (SELECT * FROM divided WHERE split = 'train'),
share AS (SELECT label, sum(count(*)) OVER ()::DOUBLE / (count(*) OVER () * count(*)) AS w FROM train GROUP BY label),
weighted AS (SELECT t.*, w FROM train t JOIN share USING (label))"""
_LONG = "long AS (" + " UNION ALL ".join(
    f"SELECT id_pdc_itinerance AS id, {i} AS f, '{c}' AS feature, CAST({c} AS DOUBLE) AS v FROM weighted"
    for i, c in enumerate(S.FEATURES)
) + ")"
#: Gradient and hessian of each row and class where all classes have the same probability.
_CHANGES = """rows AS (
  SELECT id_pdc_itinerance AS id, k AS tree_class, w * (1.0::DOUBLE / 3 - CAST(label = k AS INT)) AS g,
    2.0 * w * (1.0::DOUBLE / 3) * (2.0::DOUBLE / 3) AS h
  FROM weighted, (VALUES (0), (1), (2)) AS classes(k))"""


def _sql_level(level: int) -> str:
    """Tables of one tree level: its candidate splits, the best one of each node, the rows below."""
    return f""",
run{level} AS (
  SELECT tree_class, node, f, feature, v, sum(g) OVER upto AS gl, sum(h) OVER upto AS hl, sum(g) OVER every AS gt, sum(h) OVER every AS ht
  FROM (SELECT tree_class, node, f, feature, v, sum(g) AS g, sum(h) AS h FROM at{level} JOIN long USING (id) GROUP BY ALL) AS bins
  WINDOW upto AS (PARTITION BY tree_class, node, f ORDER BY v), every AS (PARTITION BY tree_class, node, f)),
gain{level} AS (
  SELECT *, CASE WHEN hl >= 1 AND ht - hl >= 1
    THEN gl * gl / (hl + 1) + (gt - gl) * (gt - gl) / (ht - hl + 1) - gt * gt / (ht + 1) END AS gain FROM run{level}),
chosen{level} AS (
  SELECT tree_class, node, f, feature, v AS threshold, gain
  FROM (SELECT *, max(gain) OVER (PARTITION BY tree_class, node) AS top FROM gain{level}) AS tops
  WHERE gain >= top - 1e-9 * top AND top > 1e-6
  QUALIFY row_number() OVER (PARTITION BY tree_class, node ORDER BY f, v) = 1),
at{level + 1} AS (
  SELECT a.id, a.tree_class, CAST(2 * a.node + 1 + CAST(l.v > b.threshold AS INT) AS INT) AS node, a.g, a.h
  FROM at{level} a JOIN chosen{level} b USING (tree_class, node) JOIN long l ON l.id = a.id AND l.f = b.f)"""


_ROOT = f"WITH {TRAIN}, {_LONG}, {_CHANGES}, at0 AS (SELECT id, tree_class, 0 AS node, g, h FROM rows)"
FIRST_GAINS = f"""{_ROOT}{_sql_level(0)}
SELECT tree_class, feature, round(greatest(coalesce(max(gain), 0.0), 0.0), 6) AS gain FROM gain0 GROUP BY ALL"""
FIRST_TREES = f"{_ROOT}{''.join(_sql_level(i) for i in range(6))}\n" + " UNION ALL ".join(
    f"""SELECT tree_class, node, {i}::INT AS depth, any_value(feature) AS feature, round(any_value(threshold), 6) AS threshold,
  round(coalesce(any_value(gain), 0.0), 6) AS gain, round(-0.1 * sum(g) / (sum(h) + 1), 6) AS value
FROM at{i} LEFT JOIN {f'chosen{i}' if i < 6 else '(SELECT * FROM chosen5 WHERE FALSE) AS none'} USING (tree_class, node) GROUP BY tree_class, node"""
    for i in range(7)
)
