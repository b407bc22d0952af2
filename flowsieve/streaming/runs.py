"""Starting streams, running them to their end, and what a run reports about itself."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from threading import Event

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

from flowsieve.session import scratch_path


PROGRESS = "batch_id long, started string, input_rows long, rows_per_second double, duration_ms long, state_rows long, late_rows long"
#: Progress rows that are written as one file, and seconds that a finished query's last events may take.
PROGRESS_ROWS, EVENT_SECONDS = 100, 60


@dataclass(frozen=True)
class Run:
    """Where a finished stream left its output, its checkpoint and its progress."""

    output: str
    checkpoint: str
    query: StreamingQuery
    progress: str


class ProgressLog(StreamingQueryListener):
    """Writes the progress of every micro-batch of the queries of one name as a row.

    Spark reports each micro-batch to its listeners once, in order, so nothing is polled and nothing is missed, however fast the batches are.
    Rows are written in files of ``PROGRESS_ROWS`` and when the query ends; a restart adds files.
    """

    def __init__(self, spark: SparkSession, name: str, path: str):
        self.spark, self.name, self.path = spark, name, path
        self.rows: list[tuple] = []
        self.query_id: str | None = None
        self.ended = Event()

    def onQueryStarted(self, event) -> None:
        if event.name == self.name:
            self.query_id = str(event.id)

    def onQueryProgress(self, event) -> None:
        p = event.progress
        if p.name != self.name:
            return
        state = p.stateOperators
        self.rows.append(
            (
                int(p.batchId),
                p.timestamp,
                int(p.numInputRows),
                float(p.processedRowsPerSecond or 0.0),
                int(p.batchDuration),
                sum(int(s.numRowsTotal) for s in state),
                sum(int(s.numRowsDroppedByWatermark) for s in state),
            )
        )
        if len(self.rows) >= PROGRESS_ROWS:
            self.flush()

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        if str(event.id) == self.query_id:
            self.ended.set()

    def flush(self) -> None:
        rows, self.rows = self.rows, []
        self.spark.createDataFrame(rows, PROGRESS).write.mode("append").json(self.path)


def logged(spark: SparkSession, name: str, start: Callable[[str], StreamingQuery]) -> tuple[StreamingQuery, str]:
    """(finished query, folder of its progress) of a query that ``start`` begins under the given name."""
    path = scratch_path(spark, f"{name}-progress")
    unique = path.rsplit("/", 1)[-1]
    log = ProgressLog(spark, unique, path)
    spark.streams.addListener(log)
    try:
        query = start(unique)
        query.awaitTermination()
        # events are delivered after the fact; the last one is that the query has ended
        if not log.ended.wait(EVENT_SECONDS):
            raise RuntimeError(f"the end of query {unique} was not reported")
        log.flush()
    finally:
        spark.streams.removeListener(log)
    return query, path


def run_to_end(stream: DataFrame, name: str, fmt: str = "parquet", options: dict | None = None) -> Run:
    """Process everything that is available, in micro-batches, into files; survives a restart.

    ``availableNow`` keeps the source's per-trigger limits, which are the back-pressure of a run.
    """
    spark = stream.sparkSession
    output, checkpoint = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")
    writer = (
        stream.writeStream.format(fmt)
        .options(**(options or {}))
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(availableNow=True)
    )
    return Run(output, checkpoint, *logged(spark, name, lambda unique: writer.queryName(unique).start()))


def start_live(stream: DataFrame, output: str, checkpoint: str, every: str = "1 second", fmt: str = "parquet") -> StreamingQuery:
    """A long-running append query that starts a micro-batch at most every interval."""
    return (
        stream.writeStream.format(fmt)
        .option("path", output)
        .option("checkpointLocation", checkpoint)
        .outputMode("append")
        .trigger(processingTime=every)
        .start()
    )


def drain(query: StreamingQuery) -> None:
    """Finish what has arrived, then stop."""
    query.processAllAvailable()
    query.stop()


def run_versions(stream: DataFrame, name: str, mode: str = "update") -> Run:
    """Results of an updating aggregate as files: each micro-batch writes the groups it changed.

    A batch overwrites its own folder, so a repeated batch after a failure leaves one copy.
    """
    spark = stream.sparkSession
    output, checkpoint = scratch_path(spark, f"{name}-out"), scratch_path(spark, f"{name}-ckpt")

    def write(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{output}/batch_id={batch_id}")

    writer = stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).outputMode(mode).trigger(availableNow=True)
    return Run(output, checkpoint, *logged(spark, name, lambda unique: writer.queryName(unique).start()))


def latest(spark: SparkSession, run: Run, keys: list[str]) -> DataFrame:
    """The last version of each group of an updating run."""
    rows = spark.read.parquet(run.output)
    values = [c for c in rows.columns if c not in (*keys, "batch_id")]
    newest = F.max_by(F.struct(*values), F.col("batch_id")).alias("v")
    return rows.groupBy(*keys).agg(newest).select(*keys, "v.*")


def progress_table(spark: SparkSession, run: Run) -> DataFrame:
    """One row for each micro-batch: rows in, rate, state rows, rows dropped as late."""
    rows = spark.read.schema(PROGRESS).json(run.progress)
    return rows.groupBy("batch_id").agg(F.max_by(F.struct(*[c for c in rows.columns if c != "batch_id"]), "started").alias("r")).select("batch_id", "r.*")
