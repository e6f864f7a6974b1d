"""Decimal ties of vector components are rounded as in SQL."""

import hashlib
import math

import duckdb

from checks.registry import CHECKS
import checks.all_queries  # noqa: F401


def test_components_at_a_decimal_tie_agree_with_sql(spark, tmp_path):
    """A vector of length 2560 with a component of 23: 0.008984375 to eight places."""
    rest = 2560**2 - 23**2 - 2**2
    a, b, c = next((a, b, math.isqrt(rest - a * a - b * b)) for a in range(100, 2500) for b in range(100, a)
                   if rest - a * a - b * b > 0 and math.isqrt(rest - a * a - b * b) ** 2 == rest - a * a - b * b)
    words, places = [], set()
    for i in range(1000):
        place = int(hashlib.md5(f"w{i}".encode()).hexdigest()[:8], 16) % 64
        if place not in places and len(words) < 5:
            places.add(place)
            words.append(f"w{i}")
    text = " ".join(" ".join([w] * n) for w, n in zip(words, (23, 2, a, b, c)))
    spark.createDataFrame([(1, text)], "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    check = CHECKS["v1_hash_embedding"]
    got = sorted((r.doc_id, r.idx, r.value) for r in check.run(spark, str(tmp_path)).collect())
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM '{tmp_path}/documents.parquet/*.parquet'")
    assert len(got) == 5 and got == sorted(con.execute(check.sql).fetchall())
