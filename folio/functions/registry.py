"""The library's scalar functions for SQL, as temporary SQL functions over built-in expressions."""

from __future__ import annotations

from pyspark.sql import SparkSession

_FUNCTIONS = {
    "isbn13": ("x STRING", "STRING", "(SELECT s || pmod(10 - pmod(aggregate(sequence(1, 12), 0, (a, i) -> a + int(substr(s, i, 1)) * if(i % 2 = 0, 3, 1)), 10), 10) FROM (SELECT if(length(x) = 10, '978' || substr(x, 1, 9), substr(x, 1, 12)) AS s))"),
    "haversine_m": ("lat1 DOUBLE, lon1 DOUBLE, lat2 DOUBLE, lon2 DOUBLE", "DOUBLE", "2 * 6371008.8 * asin(sqrt(least(1.0D, pow(sin(radians(lat2 - lat1) / 2), 2) + cos(radians(lat1)) * cos(radians(lat2)) * pow(sin(radians(lon2 - lon1) / 2), 2))))"),
    "year_of": ("x STRING", "STRING", r"nullif(regexp_extract(x, '([01]\\d{3}|20\\d{2})', 1), '')"),
}


def register(spark: SparkSession) -> list[str]:
    for name, (args, kind, body) in _FUNCTIONS.items():
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return list(_FUNCTIONS)
