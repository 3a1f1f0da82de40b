"""A keyed table that a stream keeps up to date: the latest progress of each project, and where to resume.

Each batch of the stream is a version. It merges its rows into the buckets of the table that they fall into, writes these
buckets anew beside the old ones, and last of all a commit, a row of the version. A reader takes of each bucket the newest
version that is committed. So a batch that is written again, after a stop between write and commit, gives the same rows, and
one that is already committed is left out. Rows move by one shuffle on the key's bucket; the buckets that no row meets are
neither read nor written. `vacuum` names the folders that no reader needs any more."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


class Table:
    """A table below path with the columns of schema; rows of one key are one, the one with the greatest `order`."""

    def __init__(self, spark: SparkSession, path: str, schema: str, key: str, order: list[str], buckets: int = 16):
        self.spark, self.path, self.schema, self.key, self.order, self.buckets = spark, path.rstrip("/"), schema, key, order, buckets
        self.columns = StructType.fromDDL(schema).names

    def _read(self, folder: str, schema: str) -> DataFrame:
        try:
            return self.spark.read.schema(schema).parquet(f"{self.path}/{folder}")
        except AnalysisException as error:
            if error.getCondition() != "PATH_NOT_FOUND":
                raise
            return self.spark.createDataFrame([], schema)

    def committed(self) -> int:
        """The newest committed version; -1 if there is none."""
        return self._read("commits", "version long").agg(F.coalesce(F.max("version"), F.lit(-1).cast("long"))).first()[0]

    def _versions(self, upto: int) -> DataFrame:
        """(bucket, version) of the newest version of each bucket: as many rows as there are buckets, from folder names."""
        rows = self._read("rows", f"{self.schema}, version long, bucket int").select("bucket", "version")
        return rows.where(F.col("version") <= upto).groupBy("bucket").agg(F.max("version").alias("version"))

    def rows(self, upto: int | None = None) -> DataFrame:
        """The table as of its newest commit, or of that version."""
        upto = self.committed() if upto is None else upto
        newest = self._versions(upto)
        return self._read("rows", f"{self.schema}, version long, bucket int").join(F.broadcast(newest), ["bucket", "version"], "left_semi").select(*self.columns)

    def upsert(self, batch: DataFrame, version: int) -> None:
        """Merge a batch as that version; for foreachBatch."""
        if self._write(batch, version):
            self._commit(version)

    def _write(self, batch: DataFrame, version: int) -> bool:
        done = self.committed()
        if version <= done:
            return False
        bucket = F.pmod(F.xxhash64(self.key), F.lit(self.buckets)).cast("int")
        new = batch.where(F.col(self.key).isNotNull()).select(*self.columns).withColumn("bucket", bucket)
        met = [r[0] for r in new.select("bucket").distinct().collect()]  # at most as many as there are buckets
        before = self.rows(done).withColumn("bucket", bucket).where(F.col("bucket").isin(met)) if met else None
        every = new if before is None else new.unionByName(before)
        last = F.max_by(F.struct(*self.columns), F.struct(*self.order)).alias("row")
        merged = every.groupBy("bucket", self.key).agg(last).select("row.*", "bucket").withColumn("version", F.lit(version).cast("long"))
        if met:
            for_version = f"{self.path}/rows"
            merged.repartition(len(met), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version", "bucket").parquet(for_version)
        return True

    def _commit(self, version: int) -> None:
        self.spark.range(1).select(F.lit(version).cast("long").alias("version")).coalesce(1).write.mode("append").parquet(f"{self.path}/commits")

    def vacuum(self) -> list[str]:
        """Folders of versions that newer committed ones replace."""
        done = self.committed()
        kept = {tuple(r) for r in self._versions(done).collect()}
        every = self._read("rows", f"{self.schema}, version long, bucket int").select("bucket", "version").where(F.col("version") <= done).distinct().collect()
        return sorted(f"{self.path}/rows/version={v}/bucket={b}" for b, v in every if (b, v) not in kept)


def upsert_stream(events: DataFrame, table: Table, checkpoint: str) -> None:
    """Run the stream over all that is there into the table; a restart with the same checkpoint goes on where it stopped."""
    events.writeStream.outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(table.upsert).start().awaitTermination()


PROGRESS = "project_id long, phase string, done long, event_id long, ts timestamp"


def resume_points(table: Table) -> DataFrame:
    """(project_id, phase, next_file): where a job goes on; those that are completed have nothing to resume."""
    return table.rows().where("phase <> 'completed'").select("project_id", "phase", (F.col("done") + 1).alias("next_file"))
