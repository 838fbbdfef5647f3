"""Write-once sinks: a version is claimed by one writer, written aside, and published whole with a manifest of its files' hashes, or not at all.

``Version`` claims its name by creating a marker that cannot be created twice, so of two
writers one fails before it writes.  Tables are written to a folder of the attempt, where
Spark's committer keeps what lost tasks wrote out of sight; ``publish`` reads the files
back, lists their sizes and hashes in a manifest, which is itself hashed, and writes the
seal, again a file that cannot be created twice, last.  Readers know a version by its
seal alone.  What a failed writer leaves has no seal and cannot get one.

``Budget`` bounds a run: rows and bytes are observed while Spark writes, files are
counted before anything is read, and a run that passes a bound stops before its next
step and leaves a compact report instead of a version.

Defined cases: an empty table is a table with no rows and is sealed like others; a name
that was claimed cannot be used again, whatever became of it; a file that was changed
after publication is found by ``verified``.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Observation, Row, SparkSession
from pyspark.sql import functions as F

CLAIM, SEAL, REPORT = "_CLAIM", "_SEALED", "_FAILED"


class LimitPassed(RuntimeError):
    """limit, most and found."""

    def __init__(self, limit: str, most: float, found: float):
        super().__init__(f"{limit}: {found} is more than {most}")
        self.limit, self.most, self.found = limit, most, found


@dataclass
class Budget:
    """Bounds of a run, and what it has used so far; None: no bound."""

    input_bytes: int | None = None
    output_rows: int | None = None
    output_bytes: int | None = None
    seconds: float | None = None
    used: dict[str, float] = field(default_factory=lambda: {"input_bytes": 0, "output_rows": 0, "output_bytes": 0, "seconds": 0.0})
    began: float = field(default_factory=time.monotonic)

    def spend(self, **amounts: float) -> None:
        """Add amounts and raise for the first bound that is passed."""
        for name, amount in amounts.items():
            self.used[name] += amount
        self.used["seconds"] = time.monotonic() - self.began
        for name, found in self.used.items():
            most = getattr(self, name)
            if most is not None and found > most:
                raise LimitPassed(name, most, found)


def _path(spark: SparkSession, path: str):
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.sc().hadoopConfiguration()), p


def exists(spark: SparkSession, path: str) -> bool:
    fs, p = _path(spark, path)
    return fs.exists(p)


def _create(spark: SparkSession, path: str, text: str) -> None:
    """A file that must not exist yet."""
    fs, p = _path(spark, path)
    try:
        out = fs.create(p, False)
    except Exception as e:
        raise FileExistsError(path) from e
    try:
        out.write(bytearray(text.encode()))
    finally:
        out.close()


def input_bytes(df: DataFrame) -> int:
    """Bytes of the files that ``df`` is read from, by listing alone."""
    total = 0
    for file in df.inputFiles():
        fs, p = _path(df.sparkSession, file)
        total += fs.getFileStatus(p).getLen()
    return total


def listing(spark: SparkSession, folder: str) -> DataFrame:
    """file (below ``folder``), size and sha256 of its data files."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(folder)
    return found.select(F.substring_index("path", f"{folder.rstrip('/').rpartition('/')[2]}/", -1).alias("file"), F.col("length").alias("size"), F.sha2("content", 256).alias("sha256")).where(~F.rlike("file", F.lit(r"(^|/)[._]")))


class Version:
    """A version in the making; a context that publishes at its end, or reports a failure and leaves nothing visible."""

    def __init__(self, spark: SparkSession, root: str, name: str, budget: Budget | None = None):
        self.spark, self.path, self.budget = spark, f"{root.rstrip('/')}/{name}", budget or Budget()
        self.attempt = uuid.uuid4().hex
        self.tables: dict[str, int] = {}
        self.state = "open"
        _create(spark, f"{self.path}/{CLAIM}", self.attempt)

    def put(self, table: str, df: DataFrame, form: str = "parquet") -> None:
        """Write a table; a failure closes the version for ever."""
        if self.state != "open":
            raise PermissionError(f"{self.path} is {self.state}")
        if table in self.tables:
            raise FileExistsError(f"{self.path}/{table}")
        seen = Observation()
        try:
            self.budget.spend(input_bytes=input_bytes(df))
            df.observe(seen, F.count(F.lit(1)).alias("rows")).write.mode("errorifexists").format(form).save(f"{self.path}/data-{self.attempt}/{table}")
            self.tables[table] = seen.get["rows"]
            fs, p = _path(self.spark, f"{self.path}/data-{self.attempt}/{table}")
            self.budget.spend(output_rows=self.tables[table], output_bytes=fs.getContentSummary(p).getLength())
        except Exception as e:
            self.failed(e)
            raise

    def publish(self) -> dict:
        """Seal the version; gives its manifest."""
        if self.state != "open":
            raise PermissionError(f"{self.path} is {self.state}")
        try:
            folder = f"{self.path}/data-{self.attempt}"
            manifest = {"attempt": self.attempt, "tables": self.tables, "files": 0, "bytes": 0, "sha256": None, "used": self.budget.used}
            if self.tables:
                listed = listing(self.spark, folder)
                listed.repartition(1).write.parquet(f"{self.path}/manifest-{self.attempt}")
                manifest |= _digest(self.spark.read.parquet(f"{self.path}/manifest-{self.attempt}"))
            self.budget.spend()
            _create(self.spark, f"{self.path}/{SEAL}", json.dumps(manifest, sort_keys=True))
        except Exception as e:
            self.failed(e)
            raise
        self.state = "sealed"
        return manifest

    seal = publish

    def failed(self, cause: Exception | str = "abandoned") -> None:
        """Close the version: its data go, and a compact report of the cause and of what was used stays."""
        if self.state == "sealed":
            raise PermissionError(f"{self.path} is sealed")
        if self.state == "open":
            self.state = "failed"
            fs, p = _path(self.spark, f"{self.path}/data-{self.attempt}")
            fs.delete(p, True)
            limit = {"limit": cause.limit, "most": cause.most, "found": cause.found} if isinstance(cause, LimitPassed) else {}
            report = {"status": "LIMIT" if limit else "FAIL", "cause": str(cause).splitlines()[0][:500] if str(cause) else type(cause).__name__, "used": self.budget.used, **limit}
            _create(self.spark, f"{self.path}/{REPORT}", json.dumps(report, sort_keys=True))

    def __enter__(self) -> Version:
        return self

    def __exit__(self, kind, error, trace) -> bool:
        if self.state == "open":
            self.publish() if error is None else self.failed(error)
        return False


def _digest(listed: DataFrame) -> dict:
    """files, bytes and sha256 over the sorted lines of a manifest, whose number is that of files."""
    line = F.concat_ws(" ", "sha256", "size", "file")
    folded = listed.agg(F.count(F.lit(1)).alias("files"), F.coalesce(F.sum("size"), F.lit(0)).alias("bytes"), F.sha2(F.array_join(F.array_sort(F.collect_list(line)), "\n").cast("binary"), 256).alias("sha256"))
    return folded.first().asDict()


def _text(spark: SparkSession, path: str) -> dict:
    fs, p = _path(spark, path)
    stream = fs.open(p)
    try:
        return json.loads(spark._jvm.org.apache.commons.io.IOUtils.toString(stream, "UTF-8"))
    finally:
        stream.close()


def manifest_of(spark: SparkSession, path: str) -> dict:
    """What a sealed version says of itself; others raise."""
    if not exists(spark, f"{path}/{SEAL}"):
        raise PermissionError(f"{path} is not sealed")
    return _text(spark, f"{path}/{SEAL}")


def report_of(spark: SparkSession, path: str) -> dict:
    """What is left of a version that failed."""
    return _text(spark, f"{path}/{REPORT}")


def read_version(spark: SparkSession, path: str, table: str, form: str = "parquet") -> DataFrame:
    """A table of a sealed version; others raise."""
    return spark.read.format(form).load(f"{path}/data-{manifest_of(spark, path)['attempt']}/{table}")


def verified(spark: SparkSession, path: str) -> DataFrame:
    """file and status of a sealed version's files: OK, CHANGED, MISSING or ADDED."""
    attempt = manifest_of(spark, path)["attempt"]
    then = spark.read.parquet(f"{path}/manifest-{attempt}")
    now = listing(spark, f"{path}/data-{attempt}").withColumnsRenamed({"size": "size_now", "sha256": "sha256_now"})
    status = F.when(F.col("sha256_now").isNull(), "MISSING").when(F.col("sha256").isNull(), "ADDED").when((F.col("sha256") == F.col("sha256_now")) & (F.col("size") == F.col("size_now")), "OK").otherwise("CHANGED")
    return then.join(now, "file", "full").select("file", status.alias("status"))


def within(budget: Budget, steps: list[tuple[str, Callable[[], DataFrame]]]) -> tuple[DataFrame | None, list[Row]]:
    """The last step's result, or None where a bound was passed, and a receipt a step: step, status (PASS, LIMIT or NOT_RUN), limit, rows and seconds.

    Each step's rows are counted while they are written to the shared folder; the
    bound is looked at before the next step begins.
    """
    from quarry.functions.stored import stored

    receipts, result, passed = [], None, None
    for name, step in steps:
        if passed is not None:
            receipts.append(Row(step=name, status="NOT_RUN", limit=None, rows=None, seconds=None))
            continue
        began, seen = time.monotonic(), Observation()
        try:
            df = step()
            budget.spend(input_bytes=input_bytes(df))
            result = stored(df.observe(seen, F.count(F.lit(1)).alias("rows")), "step")
            budget.spend(output_rows=seen.get["rows"])
            receipts.append(Row(step=name, status="PASS", limit=None, rows=seen.get["rows"], seconds=round(time.monotonic() - began, 3)))
        except LimitPassed as e:
            passed, result = e, None
            receipts.append(Row(step=name, status="LIMIT", limit=e.limit, rows=int(e.found) if e.limit == "output_rows" else None, seconds=round(time.monotonic() - began, 3)))
    return result, receipts


def first_failures(report: DataFrame, status: str, order: list[str], most: int = 10) -> tuple[list, int]:
    """At most ``most`` failing rows in order, and how many more there are."""
    bad = report.where(F.col(status) != "PASS")
    rows = bad.orderBy(*order).limit(most).collect()
    return rows, max(0, bad.count() - len(rows))
