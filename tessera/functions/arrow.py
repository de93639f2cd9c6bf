"""Kernels over rows: one Arrow stage that adds a column and passes the others through."""

from __future__ import annotations

import time
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from ..errors import CodecError


#: Rows and bytes of input that are taken apart at once, so that what a worker holds beside a batch is bounded.
SLICE, SLICE_BYTES = 2000, 1 << 20
#: Small input is dealt over so many tasks a core, each of at least so many bytes of files; input with more for each is split well by its scan.
TASKS, TASK_BYTES, SPLIT_BYTES = 4, 32 << 10, 4 << 20


def sliced(batches: Iterator[pa.RecordBatch], inputs: list[int]) -> Iterator[pa.RecordBatch]:
    """Batches of at most SLICE rows and about SLICE_BYTES of text and bytes in the columns at inputs; one row at least."""
    for b in batches:
        size, at = np.zeros(b.num_rows, np.int64), 0
        for i in inputs:
            if pa.types.is_string(b.column(i).type) or pa.types.is_binary(b.column(i).type):
                size += pc.fill_null(pc.binary_length(b.column(i)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        ends = np.cumsum(size)
        while at < b.num_rows:
            n = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + SLICE_BYTES, "right")) - at
            n = max(1, min(n, SLICE, b.num_rows - at))
            yield b.slice(at, n)
            at += n


def dealt(df: DataFrame) -> DataFrame:
    """Rows of small files over all cores, once in a plan. A scan splits by bytes and at row groups, but a kernel's time goes by rows: a file
    of millions of narrow rows is one task otherwise."""
    if df.isStreaming:
        return df
    plan = df._jdf.queryExecution().optimizedPlan()
    if any(step in plan.toString() for step in ("MapInArrow", "Repartition")):
        return df
    leaves = plan.collectLeaves()
    size = sum(int(str(leaves.apply(i).stats().sizeInBytes())) for i in range(leaves.size()))
    tasks = TASKS * df.sparkSession.sparkContext.defaultParallelism
    n = min(tasks, size // TASK_BYTES)
    return df.repartition(n) if n > 1 and size < tasks * SPLIT_BYTES else df


def with_kernel(df: DataFrame, name: str, kind: str | T.DataType, inputs: list[str], kernel: Callable) -> DataFrame:
    """df with a column ``name`` = kernel(*inputs) per row; null inputs reach the kernel as None. An old column of that name gives way."""
    df = dealt(df.drop(name) if name not in inputs else df)
    kind = T._parse_datatype_string(kind) if isinstance(kind, str) else kind
    arrow = to_arrow_type(kind)
    at = [df.columns.index(c) for c in inputs]
    keep = [i for i, c in enumerate(df.columns) if c != name]
    schema = T.StructType([df.schema[i] for i in keep] + [T.StructField(name, kind)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in sliced(batches, at):
            made = [kernel(*row) for row in zip(*(b.column(i).to_pylist() for i in at), strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(i) for i in keep), pa.array(made, arrow)], names=schema.names)

    return df.mapInArrow(run, schema)


def of_few(kind: str, value: Column, kernel: Callable) -> Column:
    """kernel(value) where value is not null, null else: for the few rows that a native expression leaves. One pass of the table, and of the
    other rows only a null goes to Python."""
    arrow = to_arrow_type(T._parse_datatype_string(kind))

    @F.arrow_udf(kind)
    def run(values: pa.Array) -> pa.Array:
        if values.null_count == len(values):
            return pa.nulls(len(values), arrow)
        return pa.array([None if v is None else kernel(v) for v in values.to_pylist()], arrow)

    return run(value)


PLACE = "end_offset: bigint, container_path: string, json_path: string, major: int, info: int"
FAILURE = f"struct<code: string, message: string, byte_offset: bigint, related_offset: bigint, violation: string, {PLACE}>"


def failure(e: CodecError) -> dict:
    at = e.place
    place = {"end_offset": e.end, "container_path": at and at.path, "json_path": at and at.json_path, "major": at and at.major, "info": at and at.info}
    return {"code": e.code, "message": e.message, "byte_offset": e.offset, "related_offset": e.related, "violation": e.violation, **place}


def outcome(value: str) -> str:
    return f"struct<value: {value}, failure: {FAILURE}, observation: struct<nanoseconds: bigint, input_bytes: bigint, output_bytes: bigint>>"


def isolated(kernel: Callable) -> Callable:
    """A kernel whose failures are rows: exactly one of value and failure is set. A null input gives null."""

    def run(x):
        if x is None:
            return None
        size = lambda v: len(v.encode()) if isinstance(v, str) else len(v) if isinstance(v, bytes) else None
        began, value, fault = time.perf_counter_ns(), None, None
        try:
            value = kernel(x)
        except CodecError as e:
            fault = failure(e)
        except RecursionError:
            fault = failure(CodecError("ERR_RESOURCE_LIMIT", "items are nested too deep"))
        return {"value": value, "failure": fault, "observation": {"nanoseconds": time.perf_counter_ns() - began, "input_bytes": size(x), "output_bytes": size(value)}}

    return run
