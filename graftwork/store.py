"""The graph as append-only Parquet tables, one folder a batch: writing a batch again replaces it, so a retried batch leaves no copies."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from graftwork import schemas

TABLES = {"nodes": schemas.NODES, "edges": schemas.EDGES, "decisions": schemas.DECISIONS + ", what string", "events": schemas.EVENTS + ", batch_id bigint"}


class GraphStore:
    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path

    def _folder(self, name: str) -> str:
        return f"{self.path}/{name}"

    def read(self, name: str, before: int | None = None) -> DataFrame:
        """A table; ``before``: only batches below this number (so a retried batch does not see itself)."""
        jvm = self.spark.sparkContext._jvm
        path = jvm.org.apache.hadoop.fs.Path(self._folder(name))
        there = path.getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()).exists(path)
        schema = TABLES[name]
        df = self.spark.read.schema(schema + ", part bigint").parquet(self._folder(name)) if there else self.spark.createDataFrame([], schema + ", part bigint")
        return (df if before is None else df.where(f"part < {int(before)}")).drop("part")

    def write(self, name: str, part: int, rows: DataFrame) -> None:
        """Appends the rows as part ``part``, replacing what that part held."""
        rows.write.mode("overwrite").parquet(f"{self._folder(name)}/part={int(part)}")
