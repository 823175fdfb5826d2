"""Analyze a newly arrived file only when its size is unusual.

Two streams. The first discovers files by name only, counts their rows with a distributed job and
appends one small row per file to an arrivals table; files that cannot be read go to a table of
their own with the reason. The second keeps the z-score state over the arrivals, decides, and runs
or parks the analyses: several at a time, each with an outcome, so a failing one leaves the others.
Both are checkpointed, so a restart continues with the full history; a first start can take one
from earlier counts.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from py4j.protocol import Py4JJavaError
from pyspark.errors import AnalysisException, PySparkException
from pyspark.sql import DataFrame, Row, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from tableinsight.names import readable_path, stem
from tableinsight.operators.anomaly import THRESHOLD, WINDOW_SIZE
from tableinsight.operators.approvals import APPROVED, PENDING, REJECTED, resolve
from tableinsight.plans.analyze import analyze, write_report
from tableinsight.session import shared_dir
from tableinsight.sources.csv import read_csv
from tableinsight.sources.files import extension, file_row_counts
from tableinsight.streaming.detector import DECISION_SCHEMA, HISTORY, decisions
from tableinsight.streaming.runs import DONE, FAILED, OUTCOME_SCHEMA, run_together

_FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"
_ARRIVAL_SCHEMA = "source string, path string, modified timestamp, n bigint, status string"
_RUN_SCHEMA = "run_id string, path string, n bigint, status string"
_UNREADABLE_SCHEMA = "source string, path string, modified timestamp, error string"
_RESOLUTION_SCHEMA = "run_id string, decision string, decided_at timestamp"
_KINDS = "*.{[cC][sS][vV],[pP][aA][rR][qQ][uU][eE][tT],[jJ][sS][oO][nN]}"

COUNTED, UNREADABLE = "counted", "unreadable"


def _is_bad_file(error: Exception) -> bool:
    """The content is at fault, not the cluster: a lost executor must fail the batch, not the file."""
    return isinstance(error, AnalysisException) or "FAILED_READ_FILE" in str(error)


def read_file(spark: SparkSession, path: str) -> DataFrame:
    kind = extension(path)
    if kind == ".parquet":
        return spark.read.parquet(path)
    return spark.read.json(path) if kind == ".json" else read_csv(spark, path)


# Arrival files, one per handled batch of files, that a decision batch takes at most.
_ARRIVAL_FILES = 1000


@dataclass
class ArrivalGate:
    spark: SparkSession
    watch_dir: str
    state_dir: str | None = None
    deliverables_dir: str | None = None
    require_approval: bool = False
    window_size: int = WINDOW_SIZE
    threshold: float = THRESHOLD
    max_files: int = 1
    width: int = 4  # analyses at a time
    history: DataFrame | None = None  # (modified, n) of earlier arrivals, for a first start
    analysis: Callable[[SparkSession, str, str], None] | None = None

    def __post_init__(self):
        self.watch_dir = self.watch_dir.rstrip("/")
        self.state_dir = self.state_dir or f"{shared_dir(self.spark)}/arrival-gate"
        self.deliverables_dir = self.deliverables_dir or f"{self.state_dir}/deliverables"
        for name, schema in (
            ("arrivals/batch_id=-1", _ARRIVAL_SCHEMA),
            ("decisions/batch_id=-1", DECISION_SCHEMA),
            ("runs/batch_id=-1", _RUN_SCHEMA),
            ("unreadable/batch_id=-1", _UNREADABLE_SCHEMA),
            ("outcomes/attempt=none", OUTCOME_SCHEMA),
            ("resolutions", _RESOLUTION_SCHEMA),
        ):
            empty = self.spark.createDataFrame([], schema)
            empty.write.mode("ignore").parquet(f"{self.state_dir}/{name}")
        if self.history is not None:
            self._remember(self.history)

    def _remember(self, history: DataFrame) -> None:
        """Earlier counts become arrivals that only fill the state, the latest of them."""
        latest = history.orderBy(F.desc("modified")).limit(self.window_size).select(
            F.lit(self.watch_dir).alias("source"), F.lit("").alias("path"), F.col("modified").cast("timestamp"),
            F.col("n").cast("bigint").alias("n"), F.lit(HISTORY).alias("status"),
        )
        latest.coalesce(1).write.mode("ignore").parquet(f"{self.state_dir}/arrivals/batch_id=-2")

    # -- first stream: files to arrivals -------------------------------------------------------

    def _discovered(self) -> DataFrame:
        """New files of the accepted kinds directly in the folder; their content is not read."""
        files = (
            self.spark.readStream.format("binaryFile")
            .schema(_FILE_SCHEMA)
            .option("pathGlobFilter", _KINDS)
            .option("maxFilesPerTrigger", self.max_files)
            .load(self.watch_dir)
        )
        # The file source spells paths as URIs, the folder may be given without a scheme.
        direct = F.col("path").endswith(
            F.concat(F.lit(self.watch_dir + "/"), F.substring_index("path", "/", -1))
        )
        return files.where(direct).select("path", F.col("modificationTime").alias("modified"))

    def _count(self, paths: list[str]) -> tuple[dict[str, int], dict[str, str]]:
        """Rows per readable file, and the reason for each file that cannot be read."""
        try:
            counts = file_row_counts(self.spark, paths).collect()  # one row per file
        except (PySparkException, Py4JJavaError) as error:
            if not _is_bad_file(error):
                raise
            if len(paths) == 1:
                return {}, {paths[0]: str(error).strip().split("\n", 1)[0]}
            # One bad file fails the shared job: halves are counted until it stands alone.
            middle = len(paths) // 2
            (first, bad), (second, worse) = self._count(paths[:middle]), self._count(paths[middle:])
            return first | second, bad | worse
        return {readable_path(r.path): r.n for r in counts}, {}

    def _record_arrivals(self, batch: DataFrame, batch_id: int) -> None:
        files = batch.collect()  # at most max_files rows of name and time
        if not files:
            return
        counts, errors = self._count([f.path for f in files])
        rows = [
            (self.watch_dir, f.path, f.modified, counts.get(f.path),
             COUNTED if f.path in counts else UNREADABLE)
            for f in files
        ]
        bad = [
            (self.watch_dir, f.path, f.modified, errors.get(f.path, "no rows and no header"))
            for f in files if f.path not in counts
        ]
        for name, found, schema in (("unreadable", bad, _UNREADABLE_SCHEMA), ("arrivals", rows, _ARRIVAL_SCHEMA)):
            told = self.spark.createDataFrame(found, schema).coalesce(1)
            told.write.mode("overwrite").parquet(f"{self.state_dir}/{name}/batch_id={batch_id}")

    # -- second stream: arrivals to decisions and runs -----------------------------------------

    def _decided(self) -> DataFrame:
        arrivals = (
            self.spark.readStream.schema(_ARRIVAL_SCHEMA + ", batch_id bigint")
            .option("maxFilesPerTrigger", _ARRIVAL_FILES)
            .parquet(f"{self.state_dir}/arrivals")
            .where(F.col("status").isin(COUNTED, HISTORY))
        )
        return decisions(arrivals, self.window_size, self.threshold)

    def _act(self, batch: DataFrame, batch_id: int) -> None:
        target = f"{self.state_dir}/decisions/batch_id={batch_id}"
        batch.write.mode("overwrite").parquet(target)
        # A run id depends on the file only, so a replayed batch repeats its runs in place.
        run_id = F.concat(
            F.lit("stream-"),
            F.regexp_replace(F.substring_index("path", "/", -1), r"\.[^.]*$", ""),
            F.lit("-"),
            F.sha2(F.concat("path", F.unix_micros("modified").cast("string")), 256),
        )
        runs = (
            self.spark.read.schema(DECISION_SCHEMA)
            .parquet(target)
            .where("should_run")
            .select(
                run_id.alias("run_id"),
                "path",
                "n",
                F.lit(PENDING if self.require_approval else APPROVED).alias("status"),
            )
        )
        runs.write.mode("overwrite").parquet(f"{self.state_dir}/runs/batch_id={batch_id}")
        if not self.require_approval:
            self._run_all(runs.collect(), f"attempt=batch-{batch_id}")  # at most one per arrived file

    def _run_all(self, runs: list[Row], name: str) -> list[tuple]:
        """Outcomes replace those of the same name, so a replayed batch tells its runs once."""
        outcomes = run_together(self.spark, runs, self._folder, self._run, self.width)
        told = self.spark.createDataFrame(outcomes, OUTCOME_SCHEMA).coalesce(1)
        told.write.mode("overwrite").parquet(f"{self.state_dir}/outcomes/{name}")
        return outcomes

    def _folder(self, run: Row) -> str:
        return f"{self.deliverables_dir}/{stem(run.path)}_{run.run_id[-64:]}"

    def _run(self, run: Row, folder: str) -> None:
        if self.analysis:
            self.analysis(self.spark, run.path, folder)
            return
        analysis = analyze(read_file(self.spark, run.path))
        write_report(
            analysis, folder, f"Analyse automatique : {stem(run.path)}", {run.path: run.n}, run.run_id
        )

    # -- running -------------------------------------------------------------------------------

    def _start(self, stream: DataFrame, handler, name: str, trigger: dict) -> StreamingQuery:
        return (
            stream.writeStream.foreachBatch(handler)
            .option("checkpointLocation", f"{self.state_dir}/checkpoints/{name}")
            .trigger(**trigger)
            .start()
        )

    def start(self, interval: str = "10 seconds") -> list[StreamingQuery]:
        trigger = {"processingTime": interval}
        return [
            self._start(self._discovered(), self._record_arrivals, "files", trigger),
            self._start(self._decided(), self._act, "decisions", trigger),
        ]

    def run_available(self) -> None:
        """Handle everything that has arrived so far, then stop."""
        trigger = {"availableNow": True}
        self._start(self._discovered(), self._record_arrivals, "files", trigger).awaitTermination()
        self._start(self._decided(), self._act, "decisions", trigger).awaitTermination()

    # -- results and approvals -----------------------------------------------------------------

    def _table(self, name: str, schema: str) -> DataFrame:
        return self.spark.read.schema(schema).parquet(f"{self.state_dir}/{name}")

    def arrivals(self) -> DataFrame:
        return self._table("arrivals", _ARRIVAL_SCHEMA)

    def decisions(self) -> DataFrame:
        return self._table("decisions", DECISION_SCHEMA)

    def unreadable(self) -> DataFrame:
        return self._table("unreadable", _UNREADABLE_SCHEMA)

    def outcomes(self) -> DataFrame:
        """One row per run that was started: done, or failed with the error; a retry replaces a failure."""
        best = F.max_by(F.struct("path", "folder", "status", "error"), (F.col("status") == DONE).cast("int"))
        return self._table("outcomes", OUTCOME_SCHEMA).groupBy("run_id").agg(best.alias("o")).select("run_id", "o.*")

    def runs(self) -> DataFrame:
        return resolve(
            self._table("runs", _RUN_SCHEMA), self._table("resolutions", _RESOLUTION_SCHEMA)
        )

    def approve(self, run_id: str) -> None:
        """Run what was parked; a failure is kept as its outcome and raised."""
        self._run_one(self._resolve(run_id, APPROVED))

    def retry(self, run_id: str) -> None:
        """Run a failed analysis again."""
        failed = self.outcomes().where((F.col("run_id") == run_id) & (F.col("status") == FAILED)).select("run_id")
        run = self.runs().join(failed, "run_id").first()
        if run is None:
            raise KeyError(f"no failed run {run_id}")
        self._run_one(run)

    def _run_one(self, run: Row) -> None:
        ((*_, status, error),) = self._run_all([run], f"attempt={run.run_id}")
        if status == FAILED:
            raise RuntimeError(f"{run.run_id}: {error}")

    def reject(self, run_id: str) -> None:
        self._resolve(run_id, REJECTED)

    def _resolve(self, run_id: str, decision: str) -> Row:
        pending = self.runs().where((F.col("run_id") == run_id) & (F.col("status") == PENDING))
        run = pending.first()
        if run is None:
            raise KeyError(f"no pending run {run_id}")
        row = self.spark.range(1).select(
            F.lit(run_id).alias("run_id"),
            F.lit(decision).alias("decision"),
            F.current_timestamp().alias("decided_at"),
        )
        row.write.mode("append").parquet(f"{self.state_dir}/resolutions")
        return run
