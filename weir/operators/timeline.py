"""A keyed table with a log of commits: read as of a version or a time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from weir.operators.latest import latest_rows
from weir.session import folder_exists, pinned

_VERSION, _GONE = "version", "gone"


class Timeline:
    """Commits of changes to a table with unique ``keys``, below one folder.

    ``changes/version=n`` holds what commit n changed, ``log/version=n`` when it was made, written last:
    a commit counts from then on, and one that failed before is written over.  Every ``every`` commits
    the whole table is stored beside them (``snapshots/version=n``), so a read takes the last snapshot
    and the changes since, never the whole history.
    """

    def __init__(self, path: str, schema: StructType, keys: list[str], every: int = 10):
        self.path, self.keys, self.every = path, keys, every
        self.columns = schema.names
        self.stored = StructType(list(schema.fields)).add(_GONE, "boolean").add(_VERSION, "integer")

    def _part(self, spark: SparkSession, part: str, schema: StructType) -> DataFrame:
        folder = f"{self.path}/{part}"
        if not folder_exists(spark, folder):
            return spark.createDataFrame([], schema)
        return spark.read.schema(schema).parquet(folder)

    def log(self, spark: SparkSession) -> DataFrame:
        """``version`` and ``committed_at`` of every commit."""
        return self._part(spark, "log", StructType().add("committed_at", "timestamp").add(_VERSION, "integer"))

    def version_at(self, spark: SparkSession, at=None) -> int:
        """The last version committed by the time ``at``; 0 before the first."""
        log = self.log(spark)
        return (log if at is None else log.filter(F.col("committed_at") <= F.lit(at).cast("timestamp"))).agg(
            F.coalesce(F.max(_VERSION), F.lit(0))).first()[0]

    def commit(self, changes: DataFrame, at, gone: str | None = None) -> int:
        """Upsert the rows of ``changes``; those for which ``gone`` holds delete their key.  Keys must be
        unique in it.  Commits must come in the order of their time."""
        spark = changes.sparkSession
        version = self.version_at(spark) + 1
        flag = F.coalesce(F.expr(gone), F.lit(False)) if gone else F.lit(False)
        changes.select(*self.columns, flag.alias(_GONE)).write.mode("overwrite").parquet(f"{self.path}/changes/{_VERSION}={version}")
        if version % self.every == 0:
            whole = pinned(self._state(spark, version, version - self.every).drop(_VERSION), "snapshot")
            whole.write.mode("overwrite").parquet(f"{self.path}/snapshots/{_VERSION}={version}")
        time = spark.range(1).select(F.lit(at).cast("timestamp").alias("committed_at"))
        time.write.mode("overwrite").parquet(f"{self.path}/log/{_VERSION}={version}")
        return version

    def _state(self, spark: SparkSession, version: int, base: int) -> DataFrame:
        """The table as of a version, from the snapshot ``base`` (0: none) and the changes since."""
        rows = self._part(spark, "changes", self.stored).filter((F.col(_VERSION) > base) & (F.col(_VERSION) <= version))
        if base > 0:
            rows = rows.unionByName(self._part(spark, "snapshots", self.stored).filter(F.col(_VERSION) == base))
        return latest_rows(rows, self.keys, [_VERSION]).filter(~F.col(_GONE))

    def read(self, spark: SparkSession, version: int | None = None, timestamp=None) -> DataFrame:
        """The table as of a version, or as of a time, or now.  A version that is not there is an error."""
        last = self.version_at(spark)
        if version is None:
            version = last if timestamp is None else self.version_at(spark, timestamp)
        if not 0 <= version <= last:
            raise ValueError(f"version {version} is not one of 0 to {last}")
        return self._state(spark, version, version // self.every * self.every).select(*self.columns)
