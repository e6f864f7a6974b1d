"""Feasibility and quality guards: statuses instead of exceptions, many requests at once."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from terradrift.session import save_table

# Catalogue terms and their characteristic size in metres.
CATALOGUE = (
    ("individual vehicle", 4.5), ("vehicle", 4.5), ("car", 4.0), ("truck", 7.0), ("tank", 7.5),
    ("armored vehicle", 7.0), ("apc", 6.5), ("artillery piece", 6.0), ("artillery", 6.0), ("single tree", 3.5),
    ("tree", 3.5), ("tent", 5.0), ("small boat", 6.0), ("boat", 6.0), ("gun position", 8.0),
    ("guard post", 4.0), ("checkpoint", 10.0), ("sniper hide", 3.0), ("airstrip", 80.0), ("runway", 60.0),
    ("paved runway", 60.0), ("runway extension", 50.0), ("perimeter revetment", 30.0), ("revetment", 30.0),
    ("fortification", 40.0), ("bunker complex", 35.0), ("barracks", 45.0), ("hangar", 50.0),
    ("forward operating base", 150.0), ("fob", 150.0), ("helipad", 25.0), ("road grading", 25.0), ("roadway", 20.0),
    ("unpaved road", 20.0), ("trench network", 40.0), ("ammunition depot", 60.0), ("clearings", 50.0),
    ("agricultural clearing", 100.0),
)
DEFAULT_GSD_M = 10.0
MIN_TEXT, MAX_TEXT = 3, 256


def catalogue(spark: SparkSession, terms: Sequence[tuple[str, float]] = CATALOGUE) -> DataFrame:
    if not terms:
        return spark.createDataFrame([], "term string, dimension_m double, ordinal int")
    # Literals, unlike rows sent from Python, have a size that the planner knows.
    rows = [F.struct(F.lit(t).alias("term"), F.lit(float(d)).alias("dimension_m"), F.lit(i).alias("ordinal")) for i, (t, d) in enumerate(terms)]
    return spark.range(1).select(F.inline(F.array(*rows)))


def catalogue_matches(requests: DataFrame, terms: DataFrame, text: str = "query_text", key: str = "request_id") -> DataFrame:
    """Longest catalogue term standing as whole words in each text: ``(key, term, dimension_m)``.

    Equal lengths go to the earlier term. Texts are read once, where they lie, and only keys and terms are shuffled: every text is
    searched for every term of the catalogue, which is taken to be small, and what it holds is confirmed to stand as whole words.
    """
    low = F.lower("term")
    quoted = F.regexp_replace(low, r"([^\w ])", r"\\$1")
    # The plain letters come first, so that the pattern is found as quickly as they are; the word's start is looked up behind them.
    whole = F.concat(F.lit("(?U)"), quoted, F.lit(r"(?<=\b"), quoted, F.lit(r")\b"))
    asked = terms.filter(F.regexp_like(low, F.lit(r"(?U)\w"))).withColumns({"_term": low, "_whole": whole})
    asked = save_table(asked, "catalogue")
    texts = requests.select(key, F.lower(text).alias("_low"))
    found = texts.join(asked, F.contains("_low", "_term") & F.regexp_like("_low", F.col("_whole")))
    rank = F.struct(F.length("term"), -F.col("ordinal"))
    return found.groupBy(key).agg(F.max_by(F.struct("term", "dimension_m"), rank).alias("_m")).select(key, "_m.*")


def resolution_status(
    requests: DataFrame, terms: DataFrame, gsd_m: Column | float = DEFAULT_GSD_M, text: str = "query_text", key: str = "request_id"
) -> DataFrame:
    """Feasibility per request: a named object must span at least two pixels."""
    best = catalogue_matches(requests, terms, text, key)
    gsd = gsd_m if isinstance(gsd_m, Column) else F.lit(float(gsd_m))
    small = F.col("dimension_m") < 2.0 * gsd
    status = F.when(small, "REJECTED_SUB_NYQUIST").otherwise("OK")
    return requests.join(best, key, "left").withColumn("status", F.coalesce(status, F.lit("OK")))


def request_problems() -> Column:
    """First rule a request breaks, else NULL."""
    n = F.length("query_text")

    def outside(c: str, low: float, high: float) -> Column:
        return F.col(c).isNull() | ~F.col(c).between(low, high)

    rules = [
        (n.isNull() | (n < MIN_TEXT) | (n > MAX_TEXT), "query_text length"),
        (~F.col("query_text").rlike("[A-Za-z0-9]"), "query_text noise"),
        (outside("min_lat", -90, 90) | outside("max_lat", -90, 90), "latitude range"),
        (outside("min_lon", -180, 180) | outside("max_lon", -180, 180), "longitude range"),
        ((F.col("max_lat") <= F.col("min_lat")) | (F.col("max_lon") <= F.col("min_lon")), "bounds order"),
        (outside("tau", 0.30, 0.95), "tau range"),
        (outside("cloud_percent", 5, 50), "cloud range"),
    ]
    return F.coalesce(*[F.when(bad, F.lit(name)) for bad, name in rules])


def validate_requests(requests: DataFrame) -> DataFrame:
    """Requests with ``problem`` (NULL when valid); missing tau and cloud limit get defaults."""
    filled = requests.withColumns(
        {
            "tau": F.coalesce("tau", F.lit(0.70)), "cloud_percent": F.coalesce("cloud_percent", F.lit(35.0)),
        }
    )
    return filled.withColumn("problem", request_problems())


def overall_status(requests: DataFrame, *verdicts: DataFrame, key: str = "request_id") -> DataFrame:
    """Combine verdict tables ``(key, status)``: the first that is not OK wins, else COMPLETED."""
    out = requests.select(key)
    names = []
    for i, v in enumerate(verdicts):
        names.append(f"_s{i}")
        out = out.join(v.select(key, F.col("status").alias(f"_s{i}")), key, "left")
    rejected = [F.when(F.col(n) != "OK", F.col(n)) for n in names]
    return out.select(key, F.coalesce(*rejected, F.lit("COMPLETED")).alias("status"))
