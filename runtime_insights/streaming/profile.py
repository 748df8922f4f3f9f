"""Learn and detect on a stream, with the profile kept in tables.

The learn/detect machine of a container is not one keyed state that all its events must
pass: a hot container would be one task. Each micro-batch is instead reduced with the
same distributed operators as a batch job, and joined with the tables so far.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.utils import AnalysisException

from runtime_insights import schema as S
from runtime_insights.functions import timestamps as TS
from runtime_insights.operators import detect as D, profile as P
from runtime_insights.operators.paths import known, path_rows
from runtime_insights.operators.skew import is_small, salted_lookup
from runtime_insights.session import materialize, remove, scratch

_PATHS = (
    "container_name string, branch string, evt_type string, proc_name string, attr string, "
    "n bigint, first_ord decimal(38,0), last_us bigint"
)
_CONTAINERS = (
    "container_name string, start_ord decimal(38,0), novel_ord decimal(38,0), "
    "cut_ord decimal(38,0), last_ord decimal(38,0), late bigint"
)


@dataclass
class ProfileStream:
    """Profiles under ``path``: learned paths, container states and alerts by batch.

    Every batch writes folders of its own number and reads only earlier ones, so a
    batch that runs again after a failure gives the same tables. Folders that no batch
    can need any more are removed.

    Events may come late, in any order, and none is lost. A container that still learns
    also learns late events; they do not count for the end of learning, which is only
    found among events later than all before. A container whose learning has ended
    judges every event that comes. With the global scope the first end of
    learning holds for all containers, also for those that come later.
    """

    path: str
    learning: P.Learning = P.Learning()
    compact_every: int = 50

    # ------------------------------------------------------------------- tables

    def _read(self, spark: SparkSession, name: str, schema: str, first: int, end: int) -> DataFrame:
        table = _existing(spark, f"{self.path}/{name}", f"{schema}, batch bigint")
        return table.filter((F.col("batch") >= first) & (F.col("batch") < end)).drop("batch")

    def _write(self, df: DataFrame, name: str, batch_id: int) -> None:
        df.write.mode("overwrite").parquet(f"{self.path}/{name}/batch={batch_id}")

    def _base(self, batch_id: int) -> int:
        """Number of the last batch that wrote a compacted path table."""
        return batch_id // self.compact_every * self.compact_every

    def _path_rows(self, spark: SparkSession, end: int) -> DataFrame:
        first = self._base(max(0, min(end, self._last(spark) + 1) - 1))
        return self._read(spark, "paths", _PATHS, first, end)

    def paths(self, spark: SparkSession, end: int = 2**62) -> DataFrame:
        """Learned paths of all batches before ``end``; counts are added up."""
        return _summed(self._path_rows(spark, end))

    def containers(self, spark: SparkSession, end: int = 2**62) -> DataFrame:
        last = min(end, self._last(spark) + 1)
        return self._read(spark, "containers", _CONTAINERS, last - 1, last)

    def alerts(self, spark: SparkSession) -> DataFrame:
        return _existing(spark, f"{self.path}/alerts", None)

    def _last(self, spark: SparkSession) -> int:
        table = _existing(spark, f"{self.path}/containers", f"{_CONTAINERS}, batch bigint")
        # Folder names alone answer this.
        last = table.agg(F.max("batch")).first()[0] if "batch" in table.columns else None
        return -1 if last is None else last

    # -------------------------------------------------------------------- batch

    def process(self, events: DataFrame, batch_id: int) -> None:
        with scratch(events.sparkSession):
            self._process(events, batch_id)
        self._prune(events.sparkSession, batch_id)

    def _prune(self, spark: SparkSession, batch_id: int) -> None:
        """Batch ``batch_id`` may run again, so what it read stays; older folders go."""
        if batch_id > 1:
            remove(spark, f"{self.path}/containers/batch={batch_id - 2}")
        base = self._base(max(0, batch_id - 1))
        if base and batch_id - 1 == base:
            for old in range(max(0, base - self.compact_every), base):
                remove(spark, f"{self.path}/paths/batch={old}")

    def _process(self, events: DataFrame, batch_id: int) -> None:
        spark = events.sparkSession
        state = self.containers(spark, batch_id) if batch_id else spark.createDataFrame([], _CONTAINERS)
        learned = self._path_rows(spark, batch_id) if batch_id else spark.createDataFrame([], _PATHS)

        ord_ = TS.order_key(TS.micros(F.col("ts")), F.col("seq"))
        ended = None
        if self.learning.scope == "global":
            ended = state.agg(F.min("cut_ord")).first()[0]
        marked = salted_lookup(
            known(events).withColumn(D.EVENT_ID, F.monotonically_increasing_id()),
            state.select("container_name", "last_ord", F.col("cut_ord").alias("old_cut")),
            ["container_name"], ["seq"],
        ).withColumn("late", F.coalesce(ord_ <= F.col("last_ord"), F.lit(False))).withColumn(
            "old_cut", F.coalesce("old_cut", F.lit(ended).cast("decimal(38,0)"))
        )
        marked = materialize(marked.drop("last_ord"), "batch-events")
        open_ = marked.filter(F.col("old_cut").isNull()).drop("old_cut")
        learning, behind = (open_.filter(c).drop("late") for c in (~F.col("late"), F.col("late")))

        old = self._touched(learned, marked)
        rollup = materialize(P.path_rollup(learning, self.learning.quiet_gap_ms), "path-rollup")
        first_here = P.novel_paths(rollup).join(old, list(S.PATH), "left_anti").select(
            "container_name", "first_ord")
        before = state.filter(F.col("cut_ord").isNull()).select(
            "container_name", F.explode(F.array("start_ord", "novel_ord")).alias("first_ord")
        ).filter(F.col("first_ord").isNotNull())
        novel = materialize(first_here.unionByName(before), "novel")
        cuts = P.learning_cut(learning, self.learning, rollup, novel).select(
            "container_name", "cut_ord"
        )

        learnt = P.learned_events(learning, cuts)
        taught = materialize(P.path_counts(learnt.unionByName(behind)), "batch-paths")
        if batch_id and batch_id % self.compact_every == 0:
            # This batch's folder holds everything; readers start from it.
            self._write(_summed(learned.unionByName(taught)), "paths", batch_id)
        else:
            self._write(taught, "paths", batch_id)

        detecting = marked.filter(F.col("old_cut").isNotNull()).drop("old_cut", "late").unionByName(
            P.with_phase(learning, cuts).filter(F.col("phase") == "detect").drop("phase")
        )
        profile = old.unionByName(taught.select(*S.PATH))
        self._write(D.detect_against(detecting, profile), "alerts", batch_id)

        seen = marked.groupBy("container_name").agg(
            F.max(F.when(~F.col("late"), ord_)).alias("last_ord"),
            F.count_if(F.col("late")).alias("late"),
        )
        # No novelty counts after the end of learning.
        news = novel.join(cuts, "container_name", "left").filter(
            F.col("cut_ord").isNull() | (F.col("first_ord") <= F.col("cut_ord"))
        ).groupBy("container_name").agg(
            F.min("first_ord").alias("start_ord"), F.max("first_ord").alias("novel_ord"))
        rows = state
        for part in (seen, news, cuts):
            rows = rows.unionByName(part, allowMissingColumns=True)
        rows = rows.groupBy("container_name").agg(
            F.min("start_ord").alias("start_ord"), F.max("novel_ord").alias("novel_ord"),
            F.min("cut_ord").alias("cut_ord"), F.max("last_ord").alias("last_ord"),
            F.sum(F.coalesce("late", F.lit(0))).alias("late"),
        )
        if self.learning.scope == "global":
            rows = materialize(rows, "states")
            ended = rows.agg(F.min("cut_ord")).first()[0]
            rows = rows.withColumn("cut_ord", F.lit(ended).cast("decimal(38,0)"))
        self._write(rows, "containers", batch_id)

    @staticmethod
    def _touched(learned: DataFrame, events: DataFrame) -> DataFrame:
        """Learned paths that the batch is on, and all processes of its operations.

        The batch's few distinct paths go to the stored profile, which is read but not
        shuffled while the batch is small.
        """
        seen = materialize(path_rows(events).select(*S.PATH).distinct(), "batch-seen")
        operations = seen.select(*S.PATH[:3]).distinct()
        small = is_small(seen)

        def on(rows: DataFrame, keys: DataFrame) -> DataFrame:
            keys = F.broadcast(keys) if small else keys
            return rows.join(keys, keys.columns, "left_semi")

        stored = learned.select(*S.PATH)
        hits = on(stored, seen).unionByName(on(stored.filter(F.col("attr") == ""), operations))
        return materialize(hits.distinct(), "batch-profile")

    def start(
        self, events: DataFrame, checkpoint: str, every: str = "1 second", once: bool = False
    ) -> StreamingQuery:
        writer = events.writeStream.foreachBatch(self.process).option(
            "checkpointLocation", checkpoint
        )
        if once:
            return writer.trigger(availableNow=True).start()
        return writer.trigger(processingTime=every).start()


def _summed(rows: DataFrame) -> DataFrame:
    return rows.groupBy(*S.PATH).agg(
        F.sum("n").alias("n"), F.min("first_ord").alias("first_ord"),
        F.max("last_us").alias("last_us"),
    )


def _existing(spark: SparkSession, path: str, schema: str | None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    try:
        return reader.parquet(path)
    except AnalysisException as error:
        if error.getCondition() not in ("PATH_NOT_FOUND", "UNABLE_TO_INFER_SCHEMA"):
            raise
        return spark.createDataFrame([], schema or "container_name string")
