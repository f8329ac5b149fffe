"""The sketches' scalar parts as SQL functions, for use in spark.sql: inlined by Catalyst, no Python."""

from __future__ import annotations

from pyspark.sql import SparkSession

#: name, arguments, type, body
FUNCTIONS = [
    ("sketch_hash", "item STRING, part INT", "BIGINT", "CAST(conv(substring(md5(CAST(item AS BINARY)), 8 * part + 1, 8), 16, 10) AS BIGINT)"),
    ("sketch_probes", "item STRING, bits BIGINT, hashes INT", "ARRAY<BIGINT>", "transform(sequence(0, hashes - 1), i -> pmod(sketch_hash(item, 0) + i * (sketch_hash(item, 1) | 1), bits))"),
    ("sketch_cell", "item STRING, row INT, width BIGINT", "BIGINT", "pmod(CAST(conv(substring(md5(CAST(concat(CAST(row AS STRING), '|', item) AS BINARY)), 1, 8), 16, 10) AS BIGINT), width)"),
    ("sketch_fingerprint", "item STRING", "INT", "CAST(pmod(sketch_hash(item, 0), 255) + 1 AS INT)"),
]


def register(spark: SparkSession) -> list[str]:
    """Create the functions in this session; returns their names."""
    for name, args, kind, body in FUNCTIONS:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({args}) RETURNS {kind} RETURN {body}")
    return [f[0] for f in FUNCTIONS]
