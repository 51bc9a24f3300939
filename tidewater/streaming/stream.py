"""Structured Streaming: row-local pipelines as they are, contracts and profiles by micro-batch."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidewater.contract.schema import Schema
from tidewater.contract.validate import ValidationIssue, validate
from tidewater.functions.types import SPARK, canonical
from tidewater.plans.pipeline import ROW_LOCAL, parse_steps, pipeline
from tidewater.sources.csv import session


def stream_csv(path: str, types: dict[str, str], *, delimiter: str = ",", header: bool = True, max_files: int = 100, spark: SparkSession | None = None) -> DataFrame:
    """A stream of CSV files that appear in a folder; the types must be given, as a stream can't be looked at first."""
    shape = T.StructType([T.StructField(c, SPARK[canonical(t)]) for c, t in types.items()])
    return (spark or session()).readStream.schema(shape).options(sep=delimiter, header=header, maxFilesPerTrigger=max_files, quote='"', escape='"').csv(path)


def stream_jsonl(path: str, types: dict[str, str], *, max_files: int = 100, spark: SparkSession | None = None) -> DataFrame:
    shape = T.StructType([T.StructField(c, SPARK[canonical(t)]) for c, t in types.items()])
    return (spark or session()).readStream.schema(shape).option("maxFilesPerTrigger", max_files).json(path)


def stream_pipeline(stream: DataFrame, steps) -> DataFrame:
    """A pipeline on a stream. Only steps that look at single rows are possible; others are refused by name."""
    todo = parse_steps(steps)
    bad = [n for n, o in todo if n not in ROW_LOCAL or (n == "split_column" and o.get("check", True))]
    if bad:
        raise ValueError(f"not possible on a stream, as they need to see all rows: {', '.join(bad)}")
    return pipeline(stream, todo)


def drop_duplicates_within(stream: DataFrame, keys: list[str], event_time: str, delay: str) -> DataFrame:
    """Rows whose keys didn't come within ``delay`` before. An extension: the state is bounded by the watermark."""
    return stream.withWatermark(event_time, delay).dropDuplicatesWithinWatermark(keys)


def rolling_counts(stream: DataFrame, event_time: str, keys: list[str], window: str, slide: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """Counts by window and keys; rows later than ``delay`` are dropped."""
    w = F.window(event_time, window, slide) if slide else F.window(event_time, window)
    return stream.withWatermark(event_time, delay).groupBy(w.alias("window"), *keys).agg(F.count(F.lit(1)).alias("n"))


@dataclass
class StreamValidation:
    """Issues and rows seen so far by a validating stream."""

    schema: Schema
    max_errors: int | None = None
    rows: int = 0
    issues: list[ValidationIssue] = field(default_factory=list)

    def __call__(self, batch: DataFrame, batch_id: int) -> None:
        left = None if self.max_errors is None else self.max_errors - len(self.issues)
        if left is not None and left <= 0:
            return
        got = validate(batch, self.schema, left)
        self.issues += [ValidationIssue(i.column, i.rule, i.message, None if i.row_index is None else i.row_index + self.rows, i.value, i.severity) for i in got.issues]
        self.rows += got.row_count


def validate_stream(stream: DataFrame, schema, *, max_errors: int | None = None, checkpoint: str | None = None, sink: Callable | None = None):
    """Starts a query that checks each micro-batch; returns (query, StreamValidation).

    Rows are numbered through; uniqueness is judged within a batch. ``sink``
    (batch, id) gets each batch after its check.
    """
    state = StreamValidation(schema if isinstance(schema, Schema) else Schema(dict(schema)), max_errors)

    def each(batch: DataFrame, batch_id: int) -> None:
        batch = batch.persist()
        try:
            state(batch, batch_id)
            if sink:
                sink(batch, batch_id)
        finally:
            batch.unpersist()

    writer = stream.writeStream.foreachBatch(each).trigger(availableNow=True)
    if checkpoint:
        writer = writer.option("checkpointLocation", checkpoint)
    return writer.start(), state
