"""Named sketches in a folder of Parquet tables: header and body, with the kind on every row.

Each save is a version of its own; its header is written last and names how many rows the body has and a sum of
their hashes, so a reader finds the version before or the new one as a whole, and a lost or changed part of a body.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.utils import AnalysisException

#: What holds for each row of a body of that kind.
KINDS = {
    "bloom": "page >= 0 and length(bitmap) = 4096",
    "cuckoo": "fp between 1 and 255 and slot >= 0 and cnt >= 0",
    "cms": "row >= 0 and col >= 0 and cnt between 0 and 4294967295",
    "topk": "item is not null and cnt >= 0",
    "tdigest": "compression >= 1 and n >= 0 and size(centroids) <= 6 * compression + 10 and abs(aggregate(centroids, 0D, (a, c) -> a + c.weight) - n) < 0.5 and (n = 0 or low <= high)",
}


def _summed(body: DataFrame):
    """(rows, sum of hashes) of a body, in any order of rows and columns."""
    return body.agg(F.count("*").alias("rows"), F.coalesce(F.sum(F.xxhash64(*sorted(body.columns)).cast("decimal(38,0)")), F.lit(0)).cast("string").alias("sum")).first()


class SketchStore:
    """save and load by name; a missing name is a KeyError, another kind a TypeError, an existing one or one that isn't
    whole a ValueError."""

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path.rstrip("/")

    def _at(self, name: str, part: str) -> str:
        if not name or "/" in name:
            raise ValueError(f"not a name: {name!r}")
        return f"{self.path}/{name}/{part}"

    def _headers(self, name: str) -> DataFrame | None:
        try:
            return self.spark.read.parquet(self._at(name, "header"))
        except AnalysisException:
            return None

    def exists(self, name: str) -> bool:
        return self._headers(name) is not None

    def save(self, name: str, kind: str, header: DataFrame, body: DataFrame | None = None, overwrite: bool = False) -> None:
        if kind not in KINDS:
            raise ValueError(f"kind must be one of {tuple(KINDS)}")
        old = self._headers(name)
        if old is not None and not overwrite:
            raise ValueError(f"{name!r} exists")
        version = 0 if old is None else old.agg(F.max("version")).first()[0] + 1
        rows, total = -1, ""
        if body is not None:
            at = self._at(name, f"body/version={version}")
            body.write.mode("overwrite").parquet(at)  # a save that failed may have left one of this number
            rows, total = _summed(self.spark.read.parquet(at))
        told = {"kind": F.lit(kind), "body_rows": F.lit(rows).cast("long"), "body_sum": F.lit(total)}
        header.withColumns(told).write.mode("overwrite").parquet(self._at(name, f"header/version={version}"))

    def load(self, name: str, kind: str, check: bool = True) -> tuple[DataFrame, DataFrame | None]:
        """Header and body of the last version; check reads the body once."""
        every = self._headers(name)
        if every is None:
            raise KeyError(name)
        version = every.agg(F.max("version")).first()[0]
        header = self.spark.read.parquet(self._at(name, f"header/version={version}"))
        told = header.select("kind", "body_rows", "body_sum").first()
        if told and told.kind != kind:
            raise TypeError(f"{name!r} is a {told.kind} sketch")
        body = None
        if told and told.body_rows >= 0:
            try:
                body = self.spark.read.parquet(self._at(name, f"body/version={version}"))
            except AnalysisException as e:
                raise ValueError(f"the body of {name!r} is missing") from e
            if check:
                if tuple(_summed(body)) != (told.body_rows, told.body_sum):
                    raise ValueError(f"the body of {name!r} isn't what was saved")
                if body.where(f"not coalesce({KINDS[kind]}, false)").limit(1).count():
                    raise ValueError(f"the body of {name!r} has rows that no {kind} sketch has")
        return header.drop("kind", "body_rows", "body_sum"), body


def read_items(spark: SparkSession, path: str, fmt: str = "parquet", **options) -> DataFrame:
    """A table from parquet, orc, csv, json or text files."""
    if fmt not in ("parquet", "orc", "csv", "json", "text"):
        raise ValueError(f"unknown format {fmt!r}")
    return spark.read.options(**options).format(fmt).load(path)
