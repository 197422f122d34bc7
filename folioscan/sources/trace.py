"""Traces of operations: timed stages and fields, appended as one JSON row each."""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from datetime import UTC, datetime

from pyspark.sql import SparkSession


class Trace:
    def __init__(self, spark: SparkSession, path: str, operation: str):
        self.spark, self.path = spark, path
        self.row: dict = {"id": uuid.uuid4().hex, "operation": operation, "began": datetime.now(UTC).isoformat(), "stages_ms": {}}
        self.began = time.perf_counter()

    @contextmanager
    def stage(self, name: str) -> Iterator[None]:
        began = time.perf_counter()
        try:
            yield
        finally:
            done = self.row["stages_ms"]
            done[name] = round(done.get(name, 0.0) + (time.perf_counter() - began) * 1000, 3)

    def field(self, name: str, value) -> None:
        self.row[name] = value

    def finish(self, status: str = "ok", error: str = "") -> None:
        self.row |= {"status": status, "error": error, "total_ms": round((time.perf_counter() - self.began) * 1000, 3)}
        self.spark.createDataFrame([(json.dumps(self.row, ensure_ascii=False, default=str),)], "value string").coalesce(1).write.mode("append").text(self.path)
