"""The codec as SQL functions: scalar ones in Arrow batches, and a table function of a document's items."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql import types as T
from pyspark.sql.functions import arrow_udf, udtf
from pyspark.sql.pandas.types import to_arrow_type

from ..kernels import cbor, envelope, scan
from ..kernels.cbor import Limits, Policy
from ..kernels.envelope import Config
from .arrow import isolated, outcome, sliced


def batched(kernel: Callable, kind: str) -> Callable:
    """A kernel as a function over batches; failures are data, a null gives null."""
    run, arrow = isolated(kernel), to_arrow_type(T._parse_datatype_string(outcome(kind)))

    def over(values: pa.Array) -> pa.Array:
        parts = sliced(iter([pa.RecordBatch.from_arrays([values], names=["v"])]), [0])
        made = [pa.array([run(v) or {"value": None, "failure": None, "observation": None} for v in p.column(0).to_pylist()], arrow) for p in parts]
        return pa.concat_arrays([pa.array([], arrow), *made])

    return arrow_udf(over, outcome(kind))


def nodes(limits: Limits, policy: Policy) -> type:
    class Nodes:
        """A row per item of a document; none for bytes that are no document."""

        def eval(self, data: bytes) -> Iterator[tuple]:
            if data is None:
                return
            try:
                found = cbor.scan_nodes(bytes(data), limits, policy)
            except cbor.CodecError:
                return
            for i, n in enumerate(found[: limits.nodes]):
                yield i, n.start, n.end, n.depth, n.major, n.path, n.json_path

    return udtf(Nodes, returnType="ordinal int, start bigint, end bigint, depth int, major int, path string, json_path string")


def register(spark: SparkSession, config: Config = Config(), prefix: str = "tessera_") -> None:
    """Adds ``encode_json``, ``decode_json``, ``scan`` and the table function ``nodes`` to a session, all under one configuration."""
    functions = {
        "encode_json": batched(lambda s: envelope.encode(cbor.parse_json(s), config), "binary"),
        "decode_json": batched(lambda b: cbor.dump_json(envelope.decode(bytes(b), config)), "string"),
        "scan": batched(lambda b: scan.structural_scan(bytes(b), config.limits)._asdict(), "struct<byte_count: bigint, is_valid: boolean, first_error_offset: bigint, max_depth: int, item_count: bigint, error_code: string, message: string>"),
    }
    for name, f in functions.items():
        spark.udf.register(prefix + name, f)
    spark.udtf.register(prefix + "nodes", nodes(config.limits, Policy(allow_reserved_simple=True)))
