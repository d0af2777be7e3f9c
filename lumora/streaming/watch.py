"""Streams of file events: the same ingest logic as in batch, by micro-batch."""

from __future__ import annotations

from collections.abc import Callable

from py4j.protocol import Py4JJavaError
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.listener import StreamingQueryListener

from lumora.functions.scalar import base_name, media_type
from lumora.operators.ingest import ACTIONS
from lumora.sources.changes import SETTLE, register

DEBOUNCE = "2 seconds"
MOST_FILES = 512


def new_files(spark: SparkSession, folder: str) -> DataFrame:
    """New files below a folder as a stream; at most MOST_FILES a batch, so that a burst waits and nothing is lost."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    return spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", MOST_FILES).load(folder)


def media_events(events: DataFrame) -> DataFrame:
    """Events (path, kind, ts) of media files; the watcher leaves out thumbnails."""
    return events.where(media_type(F.col("path")).isNotNull() & ~base_name(F.col("path")).endswith(".thumb.jpg"))


def once(events: DataFrame, watermark: str = "10 minutes", key: str = "path") -> DataFrame:
    """Each key once within the watermark."""
    return events.withWatermark("ts", watermark).dropDuplicatesWithinWatermark([key])


def bursts(events: DataFrame, gap: str = DEBOUNCE, watermark: str = "10 minutes", key: str = "path") -> DataFrame:
    """The debounce in event time: a key's events with less than a gap between them are one burst."""
    rows = events.withWatermark("ts", watermark) if events.isStreaming else events
    return rows.groupBy(F.session_window("ts", gap).alias("w"), F.col(key)).agg(F.count(F.lit(1)).alias("n")).select(F.col(key), F.col("w.start").alias("first"), F.col("w.end").alias("until"), "n")


def changes(spark: SparkSession, folder: str, settle: float = SETTLE) -> DataFrame:
    """Created and changed media files below a folder as a stream (path, ts, length), each once it is quiet. A batch number's files may
    differ when it comes again; a file changed meanwhile then comes in a later batch, so none is lost."""
    return media_events(register(spark).readStream.format("media_changes").option("settle", settle).load(folder))


class StaleEpoch(RuntimeError):
    """Another stream has taken the target over."""


class Fence:
    """Who may write to a target: the stream that took the newest epoch. Epochs are empty files of rising numbers in a folder by the target,
    each made by one stream alone; Hadoop's file systems refuse to create what is there."""

    def __init__(self, spark: SparkSession, target: str):
        jvm = spark._jvm
        self.folder = jvm.org.apache.hadoop.fs.Path(f"{target.rstrip('/')}/_epochs")
        self.files = self.folder.getFileSystem(spark._jsc.hadoopConfiguration())
        self.path = jvm.org.apache.hadoop.fs.Path
        self.files.mkdirs(self.folder)
        self.epoch = self.newest() + 1
        while not self._taken(self.epoch):
            self.epoch += 1

    def _taken(self, epoch: int) -> bool:
        try:
            self.files.create(self.path(self.folder, f"{epoch:012d}"), False).close()
        except Py4JJavaError as e:
            if "AlreadyExists" in e.java_exception.getClass().getName() or self.files.exists(self.path(self.folder, f"{epoch:012d}")):
                return False
            raise
        return True

    def newest(self) -> int:
        return max((int(f.getPath().getName()) for f in self.files.listStatus(self.folder)), default=0)

    def check(self) -> None:
        """Raises StaleEpoch once another stream has a newer epoch."""
        if self.newest() > self.epoch:
            raise StaleEpoch(f"epoch {self.epoch} was replaced by {self.newest()}")

    def fenced(self, apply: Callable[[DataFrame, int], None]) -> Callable[[DataFrame, int], None]:
        """apply(), refused before it begins if the epoch is stale; if it turns stale meanwhile, the batch isn't committed either."""

        def checked(batch: DataFrame, number: int) -> None:
            self.check()
            apply(batch, number)
            self.check()

        return checked


def run(events: DataFrame, apply: Callable[[DataFrame, int], None], checkpoint: str, available_now: bool = False, key: str = "path", target: str | None = None) -> StreamingQuery:
    """Applies each micro-batch, its keys made distinct. apply() must be idempotent by batch number: after a failure a batch comes
    again. With a target, the stream takes that over: batches of streams that had it before are refused, and those streams end with StaleEpoch.
    Stop with query.stop(); query.status and query.lastProgress tell where it is."""
    trigger = {"availableNow": True} if available_now else {"processingTime": DEBOUNCE}
    act = apply if target is None else Fence(events.sparkSession, target).fenced(apply)
    return events.writeStream.foreachBatch(lambda batch, number: act(batch.dropDuplicates([key]), number)).option("checkpointLocation", checkpoint).trigger(**trigger).start()


COUNTERS = "found long, new long, skipped long, errors long"


def counted(actions: DataFrame, name: str = "ingest") -> DataFrame:
    """A stream of classified files (path, action) that reports, as it runs, the counters of ingest.summary and the last path of each batch."""
    n = lambda *kinds: F.coalesce(F.sum(F.when(F.col("action").isin(*kinds), 1).otherwise(0)), F.lit(0)).cast("long")
    return actions.observe(name, F.count(F.lit(1)).alias("found"), *[n(*kinds).alias(c) for c, kinds in ACTIONS.items()], F.max("path").alias("current"))


class Progress(StreamingQueryListener):
    """Takes the counters of counted() as they come: a row for each batch (run, batch, at, found, new, skipped, errors, current), to write() as a table."""

    SCHEMA = f"run string, batch long, at string, {COUNTERS}, current string"

    def __init__(self, name: str = "ingest") -> None:
        self.name, self.rows, self.seen = name, [], set()

    def onQueryStarted(self, event) -> None:  # noqa: N802
        pass

    def onQueryProgress(self, event) -> None:  # noqa: N802
        p = event.progress
        metrics = p.observedMetrics.get(self.name)
        if metrics is not None and (p.runId, p.batchId) not in self.seen and metrics["found"]:
            self.seen.add((p.runId, p.batchId))
            self.rows.append((str(p.runId), p.batchId, p.timestamp, *[metrics[c] for c in ("found", "new", "skipped", "errors", "current")]))

    def onQueryIdle(self, event) -> None:  # noqa: N802
        pass

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        pass

    @property
    def totals(self) -> dict[str, int]:
        return {c: sum(r[3 + k] for r in self.rows) for k, c in enumerate(("found", "new", "skipped", "errors"))}

    def write(self, spark: SparkSession, path: str) -> None:
        """Appends the rows so far to a table and forgets them."""
        rows, self.rows = self.rows, []
        if rows:
            spark.createDataFrame(rows, self.SCHEMA).coalesce(1).write.mode("append").parquet(path)


class SyncStatus(StreamingQueryListener):
    """idle, syncing, done or error, with the rows so far."""

    def __init__(self) -> None:
        self.state, self.rows, self.message = "idle", 0, ""

    def onQueryStarted(self, event) -> None:  # noqa: N802
        self.state = "syncing"

    def onQueryProgress(self, event) -> None:  # noqa: N802
        self.rows += event.progress.numInputRows

    def onQueryIdle(self, event) -> None:  # noqa: N802
        self.state = "idle"

    def onQueryTerminated(self, event) -> None:  # noqa: N802
        self.state, self.message = ("error", event.exception) if event.exception else ("done", "")
