"""Rasters, node tables and zones derived from the driver tables, once for Spark and once as SQL.

Every view covers the whole source table. Pixels come from ``events`` (its ids are dense, so
each block of 4000 ids is one 40 x 100 scene), nodes from ``orders`` and ``part``, zones from
``nation``. Spark and the SQL engine evaluate the same expression text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

BANDS = ("b1", "b2", "b3", "b4")
SCENE_PX = 4000
WIDTH = 100

# Expression text understood by both engines. `q` = scene number, `r`, `c` = pixel, `k` = event id.
_K100 = "CAST(floor(value * 100) AS BIGINT)"
_NODATA = f"(event_type = 'error' AND {_K100} % 11 = 0)"
_BAND_EXPR = {
    "b1": f"1000 + {_K100} % 700",
    "b2": "1200 + (user_id * 7 + c * 3) % 400",
    "b3": "900 + (k * 13) % 300",
    "b4": "2000 + (user_id * 11) % 500",
}
_CHANGED = "(r % 20 >= 3 AND r % 20 <= 8 + (q + c) % 7 AND c % 25 >= 4 AND c % 25 <= 8 + (q * 3 + r) % 14)"
_STEP = f"(CASE WHEN {_CHANGED} THEN 1500 ELSE 0 END + CASE WHEN user_id % 37 = 0 THEN 900 ELSE 0 END + (k * 7) % 20)"


def _band_sql(band: str, epoch: int) -> str:
    value = _BAND_EXPR[band] + (f" + {_STEP}" if epoch == 2 else "")
    nodata = 65535 if band == "b4" else 0
    return f"CAST(CASE WHEN {_NODATA} THEN {nodata} ELSE {value} END AS INT) AS {band}"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_GRID_SPARK = (
    "event_id AS k", f"event_id DIV {SCENE_PX} AS q", f"(event_id % {SCENE_PX}) DIV {WIDTH} AS r",
    f"event_id % {WIDTH} AS c", "value", "user_id", "event_type",
)
_GRID_SQL = (
    f"grid AS (SELECT event_id AS k, event_id // {SCENE_PX} AS q, (event_id % {SCENE_PX}) // {WIDTH} AS r, "
    f"event_id % {WIDTH} AS c, value, user_id, event_type FROM events)"
)
_KEYS = ("concat('S', CAST(q AS STRING)) AS scene_id", "CAST(r AS INT) AS row", "CAST(c AS INT) AS col")


def pixels(spark: SparkSession, sf_dir: str, epoch: int) -> DataFrame:
    """Raw digital numbers ``(scene_id, row, col, b1..b4)`` of one epoch; 0 and 65535 mark nodata."""
    grid = table(spark, sf_dir, "events").selectExpr(*_GRID_SPARK)
    return grid.selectExpr(*_KEYS, *[_band_sql(b, epoch) for b in BANDS])


def pixels_sql(epoch: int) -> str:
    keys = ", ".join(k.replace("AS STRING", "AS VARCHAR") for k in _KEYS)
    return f"px{epoch} AS (SELECT {keys}, {', '.join(_band_sql(b, epoch) for b in BANDS)} FROM grid)"


PX_SQL = f"{_GRID_SQL}, {pixels_sql(1)}, {pixels_sql(2)}"

# Pixel size 1e-4 degrees; scenes are stacked southwards from (25 N, 75 E).
PIXEL_DEG = 1e-4
_SCENE_F = "25.0 - q * 0.004"


def scenes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scene table: size and affine of each pixel block."""
    ids = table(spark, sf_dir, "events").selectExpr(*_GRID_SPARK)
    size = ids.groupBy("q").agg(F.max("r").alias("mr"), F.max("c").alias("mc"))
    return size.selectExpr(
        "concat('S', CAST(q AS STRING)) AS scene_id",
        "CAST(mr + 1 AS INT) AS n_rows",
        "CAST(mc + 1 AS INT) AS n_cols",
        f"named_struct('a', {PIXEL_DEG}D, 'b', 0D, 'c', 75D, 'd', 0D, 'e', -{PIXEL_DEG}D,"
        f" 'f', CAST({_SCENE_F} AS DOUBLE)) AS affine",
        "true AS is_geographic",
    )


def with_scene(rows: DataFrame, scene: DataFrame, key: str) -> DataFrame:
    """``rows`` with ``scene_no`` and ``scene_id``: the key modulo the number of scenes, one count beside every row."""
    n = scene.agg(F.count("*").alias("_scenes"))
    numbered = rows.join(F.broadcast(n), F.lit(True)).withColumn("scene_no", F.expr(f"{key} % _scenes")).drop("_scenes")
    return numbered.withColumn("scene_id", F.concat(F.lit("S"), F.col("scene_no").cast("string")))


SCENE_SQL = (
    "scene AS (SELECT 'S' || q AS scene_id, CAST(max(r) + 1 AS INT) AS n_rows, CAST(max(c) + 1 AS INT) AS n_cols, "
    f"75.0::DOUBLE AS lon0, CAST({_SCENE_F} AS DOUBLE) AS lat0, {PIXEL_DEG}::DOUBLE AS px FROM grid GROUP BY q)"
)

# --- nodes ------------------------------------------------------------------------------------

_CENTS = "CAST(round(o_totalprice * 100) AS BIGINT)"
_CLASS_LIST = (
    "Structure", "Road", "Structure", "Airstrip", "Structure",
    "GradedArea", "Revetment", "Road", "MilitaryPost", "Tower",
)


def _class_case(index: str) -> str:
    whens = " ".join(f"WHEN {i} THEN '{c}'" for i, c in enumerate(_CLASS_LIST))
    return f"CASE {index} {whens} END"


_ORDER_LAT = f"24.0 + CAST(o_orderkey / 100 AS BIGINT) * 0.002 + ({_CENTS} % 1000) * 0.000001"
_ORDER_LON = f"75.0 + (o_orderkey % 100) * 0.0025 + ({_CENTS} % 997) * 0.000001"
_ORDER_AREA = f"20 + ({_CENTS} % 30000)"
_SHIFT = "((o_custkey % 7) - 3) * 0.00002"


def _node_cols(node_id, lat, lon, area, cls, aspect, epoch, conf, status) -> list[str]:
    lat, lon = f"CAST({lat} AS DOUBLE)", f"CAST({lon} AS DOUBLE)"
    return [
        f"{node_id} AS node_id", f"{cls} AS class", f"{lat} AS lat", f"{lon} AS lon",
        f"CAST({area} AS DOUBLE) AS area_m2", f"CAST(40 + ({area}) * 0.02 AS DOUBLE) AS perimeter_m",
        f"CAST({aspect} AS DOUBLE) AS aspect_ratio",
        f"{lat} - 0.0002 AS min_lat", f"{lon} - 0.0002 AS min_lon",
        f"{lat} + 0.0002 AS max_lat", f"{lon} + 0.0002 AS max_lon",
        f"DATE '{epoch}' AS epoch", f"CAST({conf} AS DOUBLE) AS confidence", f"{status} AS delta_status",
    ]


T1_EPOCH, T2_EPOCH = "2024-01-15", "2025-01-15"
_ORDER_ID = "concat('n', CAST(o_orderkey AS STRING))"
_CLS = "(o_orderkey * 7 + o_custkey) % 10"
_ASPECT = "1 + (o_custkey % 100) / 10.0"
_CONF = "0.5 + (o_custkey % 50) / 100.0"
_NODE1 = _node_cols(_ORDER_ID, _ORDER_LAT, _ORDER_LON, _ORDER_AREA, _class_case(_CLS), _ASPECT, T1_EPOCH, _CONF,
                    "CAST(NULL AS STRING)")
_GROWN = f"({_ORDER_AREA}) * (CASE WHEN o_orderpriority = '1-URGENT' THEN 1.3 ELSE 1.05 END)"
_CLS2 = f"CASE WHEN o_orderpriority = '2-HIGH' THEN 'WaterBody' ELSE {_class_case(_CLS)} END"
_NODE2_ORDERS = _node_cols(_ORDER_ID, f"{_ORDER_LAT} + {_SHIFT}", f"{_ORDER_LON} - {_SHIFT}", _GROWN, _CLS2, _ASPECT,
                           T2_EPOCH, _CONF, "CAST(NULL AS STRING)")
_PART_LAT = "24.001 + CAST(p_partkey / 13 AS BIGINT) * 0.002 + (p_size % 7) * 0.0001"
_PART_LON = "75.001 + (p_partkey % 13) * 0.019 + (p_size % 11) * 0.0001"
_NODE2_PARTS = _node_cols("concat('delta_p', CAST(p_partkey AS STRING))", _PART_LAT, _PART_LON,
                          "200 + p_size * 800 + p_partkey % 90", _class_case("(p_partkey + p_size) % 10"),
                          "1 + (p_partkey % 90) / 10.0", T2_EPOCH, "0.6 + (p_size % 30) / 100.0", "'EMERGED'")


def _spark_text(cols: list[str]) -> list[str]:
    # Spark's integer division is DIV; its decimal literals must be doubles here.
    return [c.replace("CAST(o_orderkey / 100 AS BIGINT)", "(o_orderkey DIV 100)")
            .replace("CAST(p_partkey / 13 AS BIGINT)", "(p_partkey DIV 13)") for c in cols]


def _sql_text(cols: list[str]) -> str:
    return ", ".join(
        c.replace("CAST(o_orderkey / 100 AS BIGINT)", "(o_orderkey // 100)")
        .replace("CAST(p_partkey / 13 AS BIGINT)", "(p_partkey // 13)")
        .replace("AS STRING", "AS VARCHAR")
        for c in cols
    )


def _double_literals(cols: list[str]) -> list[str]:
    import re

    return [re.sub(r"(?<![\w.'-])(\d+\.\d+)(?![\w.'])", r"\1D", c) for c in cols]


def _double_literals_sql(text: str) -> str:
    import re

    return re.sub(r"(?<![\w.'-])(\d+\.\d+)(?![\w.'])", r"\1::DOUBLE", text)


def _as_nodes(df: DataFrame, cols: list[str]) -> DataFrame:
    out = df.selectExpr(*_double_literals(_spark_text(cols)))
    props = F.when(F.col("delta_status").isNotNull(), F.create_map(F.lit("delta_status"), F.col("delta_status")))
    empty = F.create_map().cast("map<string,string>")
    return out.withColumn("properties", F.coalesce(props, empty)).drop("delta_status")


def nodes_t1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _as_nodes(table(spark, sf_dir, "orders"), _NODE1)


def nodes_t2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Second epoch: fulfilled orders are gone, the others moved and grew, parts emerged."""
    standing = table(spark, sf_dir, "orders").filter("o_orderstatus <> 'F'")
    return _as_nodes(standing, _NODE2_ORDERS).unionByName(_as_nodes(table(spark, sf_dir, "part"), _NODE2_PARTS))


NODE_SQL = _double_literals_sql(
    f"node1 AS (SELECT {_sql_text(_NODE1)} FROM orders), "
    f"node2 AS (SELECT {_sql_text(_NODE2_ORDERS)} FROM orders WHERE o_orderstatus <> 'F' "
    f"UNION ALL SELECT {_sql_text(_NODE2_PARTS)} FROM part)"
)


_ZONE = ["concat('Z', CAST(n_nationkey AS STRING)) AS zone_name",
         "CAST(24.0 + n_nationkey * 0.012 AS DOUBLE) AS lat",
         "CAST(75.0 + (n_nationkey % 5) * 0.05 AS DOUBLE) AS lon",
         "CAST(500 + n_nationkey * 100 AS DOUBLE) AS radius_m"]


def zones(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "nation").selectExpr(*_double_literals(_ZONE))


ZONE_SQL = _double_literals_sql("zone AS (SELECT " + ", ".join(_ZONE).replace("AS STRING", "AS VARCHAR") + " FROM nation)")
LAT0, LON0 = 24.0, 75.0


def hav_sql(a: str, b: str) -> str:
    """Great-circle metres between rows aliased ``a`` and ``b``."""
    h = (
        f"(pow(sin(radians({b}.lat - {a}.lat) / 2), 2) + cos(radians({a}.lat)) * cos(radians({b}.lat))"
        f" * pow(sin(radians({b}.lon - {a}.lon) / 2), 2))"
    )
    return f"(2 * 6371000.0::DOUBLE * atan2(sqrt({h}), sqrt(1 - {h})))"


def plane_sql(a: str, b: str) -> str:
    """Tangent-plane metres between rows aliased ``a`` and ``b`` about (LAT0, LON0)."""
    k = f"cos(radians({LAT0}::DOUBLE))"
    dx = f"(radians({b}.lon - {a}.lon) * 6371000.0::DOUBLE * {k})"
    dy = f"(radians({b}.lat - {a}.lat) * 6371000.0::DOUBLE)"
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


def near_sql(a: str, b: str, metres: float) -> str:
    """Cheap exact prefilter: latitude band that contains every pair within ``metres``."""
    d = metres / 6371000.0 * 57.29577951308233 * 1.0001
    return f"{b}.lat BETWEEN {a}.lat - {d:.12f} AND {a}.lat + {d:.12f}"
