"""Fixed values shared by the whole pipeline: columns, codes, names, grids."""

from __future__ import annotations

from pyspark.sql import types as T

# Columns of the raw registry that the pipeline reads (all text).
POINT_ID = "id_pdc_itinerance"
ROW_KEY = "row_key"  # ours: tells labelled rows apart whose id is missing or repeated
STATION_ID = "id_station_itinerance"
OPERATOR = "nom_operateur"
GROUP = "consolidated_commune"
POWER = "puissance_nominale"
SITE_TYPE = "implantation_station"
ACCESS = "condition_acces"
POINT_COUNT = "nbre_pdc"
RAW_LATITUDE = "consolidated_latitude"
RAW_LONGITUDE = "consolidated_longitude"
PLUG_FLAGS = [
    "prise_type_ef",
    "prise_type_2",
    "prise_type_combo_ccs",
    "prise_type_chademo",
    "prise_type_autre",
]
RAW_COLUMNS = [
    POINT_ID, STATION_ID, OPERATOR, POWER, *PLUG_FLAGS, SITE_TYPE, ACCESS,
    POINT_COUNT, RAW_LATITUDE, RAW_LONGITUDE, GROUP,
]
RAW_SCHEMA = T.StructType([T.StructField(c, T.StringType()) for c in RAW_COLUMNS])

# The ordered feature contract, the target and the labelled layout.
FEATURES = [
    "puissance_nominale",
    "prise_type_ef",
    "prise_type_2",
    "prise_type_combo_ccs",
    "prise_type_chademo",
    "prise_type_autre",
    "implantation_encoded",
    "acces_libre",
    "nbre_pdc",
]
TARGET = "label"
LABELLED_COLUMNS = [GROUP, "latitude", "longitude", *FEATURES, TARGET]
_INT_COLUMNS = {"implantation_encoded", TARGET}
LABELLED_SCHEMA = T.StructType(
    [
        T.StructField(
            c,
            T.StringType() if c == GROUP
            else T.IntegerType() if c in _INT_COLUMNS
            else T.DoubleType(),
        )
        for c in LABELLED_COLUMNS
    ]
)

# Site type text -> ordinal code; any other text gets 99.
SITE_TYPE_CODES = {
    "Station dédiée à la recharge rapide": 0,
    "Parking privé à usage public": 1,
    "Voirie": 2,
    "Parking public": 3,
    "Parking privé réservé à la clientèle": 4,
}
UNKNOWN_CODE = 99
FREE_ACCESS_TEXT = "libre"

# Level names, plug names and the tuned class-0 threshold.
LEVEL_NAMES = {0: "Sous-équipé", 1: "Normalement équipé", 2: "Bien équipé"}
PLUG_NAMES = {
    "prise_type_ef": "Type EF",
    "prise_type_2": "Type 2",
    "prise_type_combo_ccs": "CCS Combo",
    "prise_type_chademo": "CHAdeMO",
    "prise_type_autre": "Autre",
}
LEVELS = (0, 1, 2)
CLASS0_THRESHOLD = 0.63
MIN_CLASS0_RECALL = 0.80

# Threshold grid start, step and length (0.05, 0.06, ... 0.94).
# The step is the difference of two stored doubles, so that a threshold such as
# "0.63" has the same binary value as in a floating-point range.
GRID_START = 0.05
GRID_STEP = (0.05 + 0.01) - 0.05
GRID_SIZE = 90

# Metric columns and the layout of the metrics table.
METRICS = ["accuracy", "f1_weighted", "f1_macro", "precision_macro", "recall_macro"]
MODEL_COLUMNS = ["model_key", "model_name", "model_path"]
METRICS_SCHEMA = T.StructType(
    [T.StructField(c, T.StringType()) for c in MODEL_COLUMNS]
    + [T.StructField(c, T.DoubleType()) for c in METRICS]
)

# Map viewport, and text that a CSV cell uses for "missing".
LONGITUDE_RANGE = (-5.5, 10.5)
LATITUDE_RANGE = (41.0, 52.0)
MISSING_TEXT = [
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "<NA>", "N/A", "NA", "NULL", "NaN", "None", "n/a", "nan", "null",
]
