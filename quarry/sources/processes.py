"""Outside programs as rows: each input runs one bounded child, and every input gives a row whatever becomes of it.

A child has limits of time, processor time, address space and output.  Its output is
read while it runs, and a child that writes more than it may is ended at once, so
neither memory nor a disk holds more than the limit.
"""

from __future__ import annotations

import contextlib
import os
import signal
import subprocess
import threading
import time
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import from_arrow_schema

RECEIPT = pa.schema([
    ("key", pa.string()), ("status", pa.string()), ("exit_code", pa.int32()), ("output", pa.binary()), ("diagnostic", pa.string()), ("seconds", pa.float64()), ("cpu_seconds", pa.float64()), ("peak_kib", pa.int64()),
])
#: Bytes of what a child says that are kept.
DIAGNOSTIC = 4096


class _Output(threading.Thread):
    """Reads a pipe to its end and keeps its first ``most`` bytes; calls ``beyond`` when it has so many."""

    def __init__(self, pipe, most: int, beyond=None):
        super().__init__(daemon=True)
        self.pipe, self.most, self.beyond = pipe, most, beyond
        self.data = bytearray()
        self.start()

    def run(self) -> None:
        while part := self.pipe.read1(1 << 16):
            self.data += part[: self.most - len(self.data)]
            if len(self.data) == self.most and self.beyond:
                self.beyond()


def _limits(memory: int | None, cpu: int | None):
    def apply() -> None:
        import resource

        resource.setrlimit(resource.RLIMIT_CORE, (0, 0))
        if memory:
            resource.setrlimit(resource.RLIMIT_AS, (memory, memory))
        if cpu:
            resource.setrlimit(resource.RLIMIT_CPU, (cpu, cpu + 1))

    return apply


def run_bounded(arguments: list[str], data: bytes, seconds: float, most: int, memory: int | None = None, cpu: int | None = None) -> dict:
    """COMPLETE, PROCESS_FAILURE (an exit code), TIMEOUT, CPU_LIMIT, OUTPUT_LIMIT or NOT_STARTED; output only if complete."""
    began = time.monotonic()
    row = {"status": "NOT_STARTED", "exit_code": None, "output": None, "diagnostic": None, "cpu_seconds": None, "peak_kib": None}
    try:
        child = subprocess.Popen(arguments, stdin=subprocess.PIPE, stdout=subprocess.PIPE, stderr=subprocess.PIPE, start_new_session=True, preexec_fn=_limits(memory, cpu))
    except (OSError, subprocess.SubprocessError) as bad:
        return row | {"diagnostic": str(bad), "seconds": round(time.monotonic() - began, 3)}

    def end() -> None:
        with contextlib.suppress(ProcessLookupError, PermissionError):
            os.killpg(child.pid, signal.SIGKILL)

    def feed() -> None:
        with contextlib.suppress(BrokenPipeError, OSError):
            child.stdin.write(data)
        with contextlib.suppress(BrokenPipeError, OSError):
            child.stdin.close()

    out, err = _Output(child.stdout, most + 1, end), _Output(child.stderr, DIAGNOSTIC)
    threading.Thread(target=feed, daemon=True).start()
    late = False
    while True:
        pid, state, usage = os.wait4(child.pid, os.WNOHANG)
        if pid:
            break
        if not late and time.monotonic() - began > seconds:
            late = True
            end()
        time.sleep(0.005)
    child.returncode = os.waitstatus_to_exitcode(state)
    end()  # what the child has left behind
    for reader in (out, err):
        reader.join(5)
    code = child.returncode
    row |= {"cpu_seconds": round(usage.ru_utime + usage.ru_stime, 3), "peak_kib": int(usage.ru_maxrss), "diagnostic": bytes(err.data).decode("utf-8", "replace")}
    if late:
        row["status"] = "TIMEOUT"
    elif len(out.data) > most:
        row["status"] = "OUTPUT_LIMIT"
    elif code == -signal.SIGXCPU:
        row["status"] = "CPU_LIMIT"
    else:
        row |= {"exit_code": code, "status": "COMPLETE" if code == 0 else "PROCESS_FAILURE", "output": bytes(out.data) if code == 0 else None}
    return row | {"seconds": round(time.monotonic() - began, 3)}


def run_for_rows(rows: DataFrame, key: str, data: str, arguments: list[str], seconds: float = 120, most: int = 64 << 20, memory: int | None = None, cpu: int | None = None) -> DataFrame:
    """A receipt for each row; the child reads the row's bytes from its standard input. ``memory``: bytes of address space; ``cpu``: seconds."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k, d in zip(batch.column("key"), batch.column("data"), strict=True):
                yield pa.RecordBatch.from_pylist([{"key": k.as_py()} | run_bounded(arguments, d.as_py() or b"", seconds, most, memory, cpu)], schema=RECEIPT)

    return rows.select(F.col(key).cast("string").alias("key"), F.col(data).cast("binary").alias("data")).mapInArrow(run, from_arrow_schema(RECEIPT))
