"""Documents to bytes and back. Known schemas are encoded by native expressions; JSON text, doubles and contexts by one Arrow stage.

Row-level failures are data: the outcome struct holds either a value or a failure. A configuration that can't work raises at once."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..errors import CodecError
from ..functions import expr
from ..functions.arrow import isolated, outcome, with_kernel
from ..kernels import cbor, envelope
from ..kernels.cbor import Limits, Policy
from ..kernels.envelope import Config
from ..kernels.tables import Dictionary


def encode_columns(df: DataFrame, columns: list[str], name: str = "encoded", mode: str = "lengthFirstDeterministic") -> DataFrame:
    """A 1.0 envelope without compression over the named columns, as one native projection."""
    fields = {c: (F.col(c), df.schema[c].dataType) for c in columns}
    return df.withColumn(name, expr.envelope(expr.document(fields, mode)))


def encode_json(df: DataFrame, json: str, config: Config = Config(), name: str = "encoded") -> DataFrame:
    """JSON text to bytes under any configuration: an outcome per row."""
    return with_kernel(df, name, outcome("binary"), [json], isolated(lambda s: envelope.encode(cbor.parse_json(s), config)))


def decode_json(df: DataFrame, data: str, config: Config = Config(), name: str = "decoded") -> DataFrame:
    """Bytes to JSON text: an outcome per row. What is over the byte limit is not walked."""
    return with_kernel(df, name, outcome("string"), [data], isolated(lambda b: cbor.dump_json(envelope.decode(b, config))))


def encode_typed(df: DataFrame, columns: list[str], config: Config = Config(), name: str = "encoded") -> DataFrame:
    """Columns of any type through JSON."""
    made = df.withColumn("_json", F.to_json(F.struct(*columns), {"ignoreNullFields": "false"}))
    return encode_json(made, "_json", config, name).drop("_json")


def decode_typed(df: DataFrame, data: str, schema: str, config: Config = Config(), name: str = "row") -> DataFrame:
    """Bytes to a struct of the given schema; null where decoding fails."""
    return decode_json(df, data, config, "_out").withColumn(name, F.from_json(F.col("_out.value"), schema)).drop("_out")


def with_dictionary(dictionary: Dictionary, contexts: dict | None = None, **more) -> Config:
    """A configuration for encoding with one dictionary. Contexts are documents by URL, already resolved."""
    dictionary.validate()
    return Config(registry_id=dictionary.code, tables={dictionary.code: dictionary.tables()} if dictionary.code > 1 else {}, contexts=contexts, **more)


def with_dictionaries(dictionaries: list[Dictionary], contexts: dict | None = None, **more) -> Config:
    """A configuration for decoding documents of several dictionaries; each code once."""
    tables: dict = {}
    for d in dictionaries:
        if d.validate().code in tables:
            raise CodecError("ERR_INVALID_DICTIONARY", f"code {d.code} has two dictionaries")
        tables[d.code] = d.tables()
    return Config(tables={k: t for k, t in tables.items() if k > 1}, contexts=contexts, **{"direct": False} | more)


def whole_document(df: DataFrame, data: str, config: Config, pins: dict[str, str] | None = None, dictionary_pin: str | None = None, operation: str = "decode", name: str = "document") -> DataFrame:
    """Pinned, bounded transform of whole documents: outcome and the digest of the transport bytes it belongs to."""
    from .integrity import context_fingerprint, dictionary_fingerprint

    lim, wanted = config.limits, {"encode": "string", "decode": "binary"}
    if operation not in wanted or df.schema[data].dataType.typeName() != wanted[operation]:
        raise CodecError("ERR_INVALID_INPUT", f"{operation} can't take the column {data}: JSON text is encoded, bytes are decoded")
    if min(lim.input_bytes, lim.depth, lim.items) < 0:
        raise CodecError("ERR_RESOURCE_LIMIT", "limits must not be negative")
    for code, tables in config.tables.items():
        if any(tables.values()) and dictionary_pin is None:
            raise CodecError("ERR_UNPINNED_DICTIONARY", f"dictionary {code} has no pin")
        if dictionary_pin is not None and dictionary_fingerprint(code, tables) != dictionary_pin:
            raise CodecError("ERR_INTEGRITY_MISMATCH", f"dictionary {code} differs from its pin")
    for url, doc in (config.contexts or {}).items():
        if url not in (pins or {}):
            raise CodecError("ERR_UNPINNED_CONTEXT", f"context {url} has no pin")
        if context_fingerprint(doc) != pins[url]:
            raise CodecError("ERR_INTEGRITY_MISMATCH", f"context {url} differs from its pin")
    if operation == "encode":

        def bounded(s: str) -> bytes:
            if len(s.encode()) > lim.input_bytes:
                raise CodecError("ERR_RESOURCE_LIMIT", "the input is longer than the limit", lim.input_bytes)
            return envelope.encode(cbor.parse_json(s), config)

        done = with_kernel(df, name, outcome("binary"), [data], isolated(bounded))
        return done.withColumn("transport_sha256", F.sha2(F.col(name)["value"], 256))
    return decode_json(df, data, config, name).withColumn("transport_sha256", F.sha2(F.col(data), 256))


def resolve_contexts(urls: list[str], documents: dict, pins: dict[str, str] | None = None, fallback=None) -> dict:
    """The contexts of urls for a configuration: registered documents, or else what the fallback (a function of the URL, called on the driver)
    gives. A pin, where there is one, must hold either way."""
    from .integrity import context_fingerprint

    found = {}
    for url in urls:
        found[url] = documents[url] if url in documents else fallback and fallback(url)
        if found[url] is None:
            raise CodecError("ERR_UNKNOWN_CONTEXT", f"no context is registered for {url}")
        if url in (pins or {}) and context_fingerprint(found[url]) != pins[url]:
            raise CodecError("ERR_INTEGRITY_MISMATCH", f"context {url} differs from its pin")
    return found


def with_legacy_contexts(contexts: dict[str, int], config: Config = Config()) -> Config:
    """config with an application's own context ids beside those of the legacy table (registry entry 1), before which they go."""
    from ..kernels.tables import LEGACY, LEGACY_CONTEXTS

    merged = {**LEGACY_CONTEXTS, **contexts}
    if len(set(merged.values())) < len(merged):
        raise CodecError("ERR_INVALID_TYPETABLE", "two contexts share an id")
    return replace(config, tables={**config.tables, 1: {**LEGACY, "context": merged, "url": merged, "none": merged}}, prepared={})


LITERAL = "struct<cbor: binary, back: string>"


def literals(df: DataFrame, value: str, kind: str, name: str = "literal", tables: dict | None = None) -> DataFrame:
    """Scalars of one type (``url``, ``none``, or the type's full name): the short form as CBOR, and the text that it gives back."""

    def run(v):
        from ..kernels.semantic import Session
        from ..kernels.tables import TypeTable

        session = Session(TypeTable(tables or {}), None)
        packed = cbor.encode(session.shrink_scalar(v, kind))
        back = session.grow_scalar(cbor.decode(packed), kind)
        return {"cbor": packed, "back": back if isinstance(back, str) else cbor.dump_json(back)}

    return with_kernel(df, name, outcome(LITERAL), [value], isolated(run))


def observed(df: DataFrame, name: str) -> DataFrame:
    """Totals over a batch of outcomes: rows, values, failures, bytes in and out, nanoseconds."""
    at = lambda f: F.col(f"{name}.observation.{f}")
    return df.agg(
        F.count("*").alias("n"), F.count(F.col(f"{name}.value")).alias("n_values"), F.count(F.col(f"{name}.failure")).alias("n_failures"),
        F.sum(at("input_bytes")).alias("input_bytes"), F.sum(at("output_bytes")).alias("output_bytes"), F.sum(at("nanoseconds")).alias("nanoseconds"),
    )


INSPECTION = "struct<format: string, registry_id: bigint, compressed: boolean, byte_count: bigint, payload: string, sha256: binary>"


def inspect(df: DataFrame, data: str, name: str = "inspection", limits: Limits = Limits(), policy: Policy = Policy()) -> DataFrame:
    return with_kernel(df, name, outcome(INSPECTION), [data], isolated(lambda b: envelope.inspect(b, limits, policy)))


NODES = "array<struct<start: bigint, end: bigint, depth: int, major: int, info: int, indefinite: boolean, path: string, json_path: string, violations: array<string>>>"
LOSSLESS = f"struct<nodes: {NODES}, truncated: boolean>"


def validate_lossless(df: DataFrame, data: str, name: str = "validated", limits: Limits = Limits(), policy: Policy = Policy(allow_reserved_simple=True)) -> DataFrame:
    """The items of each document with byte ranges, paths and breaches of the policy, sorted by offset and capped at limits.nodes."""

    def run(b: bytes) -> dict:
        found = cbor.scan_nodes(b, limits, policy)
        keep = ("start", "end", "depth", "major", "info", "indefinite", "path", "json_path", "violations")
        return {"nodes": [{k: getattr(n, k) for k in keep} for n in found[: limits.nodes]], "truncated": len(found) > limits.nodes}

    return with_kernel(df, name, outcome(LOSSLESS), [data], isolated(run))


def node_rows(df: DataFrame, data: str, limits: Limits = Limits(), policy: Policy = Policy(allow_reserved_simple=True)) -> DataFrame:
    """A row per item: the columns of df, ordinal, node, and the node's own bytes."""
    v = validate_lossless(df, data, "_v", limits, policy)
    rows = v.select(*df.columns, F.posexplode(F.col("_v.value.nodes")).alias("ordinal", "node"))
    return rows.withColumn("node_bytes", F.substring(data, F.col("node.start").cast("int") + 1, (F.col("node.end") - F.col("node.start")).cast("int")))


def decode_validated(df: DataFrame, data: str, config: Config, name: str = "decoded") -> DataFrame:
    """Nodes and JSON of documents in one walk each, under one policy."""
    walked = replace(config, policy=replace(config.policy, allow_reserved_simple=False), direct=False)

    def run(b: bytes) -> dict:
        found = cbor.scan_nodes(b, config.limits, config.policy)
        if breach := next((v for n in found for v in n.violations), None):
            raise CodecError("ERR_POLICY_MISMATCH", f"the document breaks its policy: {breach}")
        return {"json": cbor.dump_json(envelope.decode(b, walked)), "nodes": len(found)}

    return with_kernel(df, name, outcome("struct<json: string, nodes: bigint>"), [data], isolated(run))


def batch_guard(df: DataFrame, data: str, documents: int = 100_000, total_bytes: int = 256 << 20) -> DataFrame:
    """df itself if the batch keeps the limits; ERR_BATCH_LIMIT else. Only counts reach the driver."""
    n, size = df.agg(F.count("*"), F.sum(F.octet_length(data))).first()
    if n > documents or (size or 0) > total_bytes:
        raise CodecError("ERR_BATCH_LIMIT", f"{n} documents of {size} bytes are beyond the batch limits")
    return df
