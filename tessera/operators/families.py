"""The batch families over binary columns. Results keep each row's identity; where an order matters, it is a column.

Each has a native form (expressions, windows, joins) where Spark can state it, and an Arrow form where bytes must be walked."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..errors import CodecError
from ..functions import expr
from ..functions.arrow import isolated, of_few, outcome, with_kernel
from ..kernels import scan, tables, text
from ..kernels.cbor import Limits
from ..kernels.tables import Dictionary


def batched_sha256(df: DataFrame, data: str, name: str = "sha256") -> DataFrame:
    """struct(input_bytes, state_words, digest)."""
    c = F.col(data)
    return df.withColumn(name, F.when(c.isNotNull(), F.struct(F.octet_length(c).cast("long").alias("input_bytes"), expr.state_words(c).alias("state_words"), expr.sha256(c).alias("digest"))))


def byte_diff(df: DataFrame, left: str, right: str, name: str = "diff") -> DataFrame:
    return df.withColumn(name, expr.byte_diff(F.col(left), F.col(right)))


DIFF = "struct<left_bytes: bigint, right_bytes: bigint, mismatches: bigint, first_mismatch: bigint>"


def byte_diff_large(df: DataFrame, left: str, right: str, name: str = "diff") -> DataFrame:
    """The same for slices of megabytes."""

    def diff(a, b):
        if a is None or b is None:
            return None
        n = min(len(a), len(b))
        wrong = np.flatnonzero(np.frombuffer(a, np.uint8)[:n] != np.frombuffer(b, np.uint8)[:n])
        extra = max(len(a), len(b)) - n
        first = int(wrong[0]) if len(wrong) else n if extra else None
        return {"left_bytes": len(a), "right_bytes": len(b), "mismatches": len(wrong) + extra, "first_mismatch": first}

    return with_kernel(df, name, DIFF, [left, right], diff)


SCAN = "struct<byte_count: bigint, is_valid: boolean, first_error_offset: bigint, max_depth: int, item_count: bigint, error_code: string, message: string>"


def structural_scan(df: DataFrame, data: str, name: str = "scan", limits: Limits = Limits()) -> DataFrame:
    return with_kernel(df, name, SCAN, [data], lambda b: None if b is None else scan.structural_scan(b, limits)._asdict())


def exclusive_scan(df: DataFrame, value: str, order_by: str, name: str = "offset", bits: int = 64, partition_by: list[str] | None = None) -> DataFrame:
    """Sum of all values before a row, within each partition. A total beyond ``bits`` unsigned bits raises ERR_INTEGER_OVERFLOW.

    Without partition_by this is a global scan: rows are range-partitioned by the order, each range is summed on its own, and only one
    row per range meets the others, so no task holds the whole table."""
    kind = "decimal(38,0)"
    v = F.col(value).cast(kind)
    most = F.lit(str(2**bits - 1)).cast(kind)
    guard = lambda before: F.when(before + v > most, F.raise_error(F.lit("ERR_INTEGER_OVERFLOW"))).otherwise(before)
    if partition_by:
        w = Window.partitionBy(*partition_by).orderBy(order_by).rowsBetween(Window.unboundedPreceding, -1)
        out = df.withColumn(name, guard(F.coalesce(F.sum(v).over(w), F.lit(0).cast(kind))))
    else:
        cuts = _cuts(df, order_by)
        part = F.lit(0)
        for i, c in enumerate(cuts):
            part = F.when(F.col(order_by) >= F.lit(c), F.lit(i + 1)).otherwise(part)
        ranged = df.withColumn("_part", part)
        sums = ranged.groupBy("_part").agg(F.sum(v).alias("_sum"))
        base = sums.select(F.col("_part").alias("_of"), F.coalesce(F.sum("_sum").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast(kind)).alias("_base"))
        w = Window.partitionBy("_part").orderBy(order_by).rowsBetween(Window.unboundedPreceding, -1)
        # One row per range: at most RANGES of them, so the broadcast is bounded.
        joined = ranged.join(F.broadcast(base), ranged["_part"] == base["_of"])
        out = joined.withColumn(name, guard(F.col("_base") + F.coalesce(F.sum(v).over(w), F.lit(0).cast(kind)))).drop("_part", "_of", "_base")
    return out.withColumn(name, F.col(name).cast("long" if bits <= 32 else "decimal(20,0)"))


RANGES = 64


def _cuts(df: DataFrame, order_by: str) -> list:
    """Approximate quantiles of the order: at most RANGES - 1 values. They only balance the work."""
    parts = min(RANGES, int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    found = df.agg(F.percentile_approx(order_by, [i / parts for i in range(1, parts)], 1000)).first()[0] if parts > 1 else None
    return sorted(set(found or []))


def compact(df: DataFrame, data: str, order_by: str, group_by: list[str]) -> DataFrame:
    """Per group the slices joined in order, with the n + 1 boundaries."""
    n = F.octet_length(data).cast("long")
    ends = F.sum(n).over(Window.partitionBy(*group_by).orderBy(order_by).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    joined = F.expr(f"listagg({data}, X'') WITHIN GROUP (ORDER BY {order_by})")
    sorted_ends = F.array_sort(F.collect_list(F.coalesce("_end", F.lit(0))))  # ends rise in the order of the slices
    return df.withColumn("_end", ends).groupBy(*group_by).agg(joined.alias("bytes"), F.concat(F.array(F.lit(0).cast("long")), sorted_ends).alias("offsets"))


def unpack(df: DataFrame, data: str = "bytes", offsets: str = "offsets") -> DataFrame:
    """The slices of a compacted column, one row each with its ordinal."""
    spans = df.select("*", F.posexplode(F.slice(offsets, 1, F.size(offsets) - 1)).alias("ordinal", "_at"))
    end = F.element_at(offsets, F.col("ordinal") + 2)
    return spans.withColumn("slice", F.substring(data, F.col("_at").cast("int") + 1, (end - F.col("_at")).cast("int"))).drop("_at")


def byte_histogram(df: DataFrame, data: str, group_by: list[str]) -> DataFrame:
    """group columns, byte (two hex digits), n: counts of bytes. Each row's bytes are counted before anything is shuffled."""
    each = df.select(*group_by, F.explode(expr.pairs(expr.octets(F.col(data)))).alias("byte"))
    return each.groupBy(*group_by, "byte").agg(F.count("*").alias("n"))


STATS = "struct<byte_count: bigint, histogram: array<bigint>, entropy: double>"


def byte_statistics(df: DataFrame, data: str, name: str = "stats") -> DataFrame:
    """Dense 256-bin histogram and Shannon entropy of each slice, in one Arrow pass."""

    def stats(b):
        if b is None:
            return None
        b = b.encode() if isinstance(b, str) else b
        h = np.bincount(np.frombuffer(b, np.uint8), minlength=256)
        p = h[h > 0] / max(1, len(b))
        return {"byte_count": len(b), "histogram": h.tolist(), "entropy": max(0.0, float(-(p * np.log2(p)).sum()))}

    return with_kernel(df, name, STATS, [data], stats)


def canonical_key_order(df: DataFrame, keys: str, mode: str = "lengthFirstDeterministic", name: str = "ordered") -> DataFrame:
    return df.withColumn(name, expr.key_permutation(F.col(keys), mode))


def key_ranks(df: DataFrame, segment: str, ordinal: str, key: str, mode: str = "lengthFirstDeterministic", name: str = "rank") -> DataFrame:
    """Row form: the place of each key in its segment, from 0."""
    by = [F.octet_length(key), F.col(key), F.col(ordinal)][mode == "coreDeterministic" :]
    return df.withColumn(name, F.row_number().over(Window.partitionBy(segment).orderBy(*by)) - 1)


UTF8 = "struct<byte_count: bigint, is_valid: boolean, first_invalid_offset: bigint>"


def utf8_validate(df: DataFrame, data: str, name: str = "utf8") -> DataFrame:
    """Native validity; only rows that fail go on to the kernel that finds where."""
    fields = lambda valid, at: F.struct(F.octet_length(data).cast("long").alias("byte_count"), valid.alias("is_valid"), at.alias("first_invalid_offset"))
    ok = F.coalesce(F.is_valid_utf8(F.col(data)), F.lit(True))
    good = df.where(ok).withColumn(name, F.when(F.col(data).isNotNull(), fields(F.lit(True), F.lit(None).cast("long"))))
    bad = with_kernel(df.where(~ok), name, UTF8, [data], lambda b: {"byte_count": len(b), "is_valid": False, "first_invalid_offset": text.first_invalid_utf8(b)})
    return good.select(*df.columns, name).unionByName(bad.select(*df.columns, name))


def multibase_encode(df: DataFrame, data: str, kind: str, name: str = "multibase") -> DataFrame:
    if kind in "uM":
        return df.withColumn(name, expr.multibase(F.col(data), kind))
    return with_kernel(df, name, "string", [data], lambda b: None if b is None else text.multibase_encode(b, "z"))


MULTIBASE = "struct<decoded: binary, first_error_offset: bigint, message: string>"


def multibase_decode(df: DataFrame, value: str, name: str = "decoded", most: int = 64 << 20) -> DataFrame:
    """Native for sound ``u`` and ``M`` values; the others go on to the kernel, which says where they fail."""
    c, native = F.col(value), F.col("_native")
    made = F.struct(native.alias("decoded"), F.lit(None).cast("long").alias("first_error_offset"), F.lit(None).cast("string").alias("message"))
    run = lambda s: dict(zip(("decoded", "first_error_offset", "message"), text.multibase_decode(s, most), strict=True))
    done = _native_first(df.withColumn("_native", F.when(F.length(c) <= most, expr.multibase_decode(c))), name, native.isNotNull(), c, made, MULTIBASE, run)
    return done.drop("_native")


def _native_first(df: DataFrame, name: str, fine: Column, c: Column, made: Column, kind: str, kernel) -> DataFrame:
    """made where fine, the kernel's result of c else, null for a null; the column takes the place of an old one."""
    odd = of_few(kind, F.when(c.isNotNull() & ~F.coalesce(fine, F.lit(False)), c), kernel)
    return df.select(*df.columns, F.when(fine, made).otherwise(odd).cast(kind).alias(name))


VARINT = "struct<value: decimal(20,0), bytes_consumed: bigint, first_error_offset: bigint, message: string>"


def varint_encode(df: DataFrame, value: str, name: str = "varint") -> DataFrame:
    """Native for 63 bits; the rest of the unsigned range (decimal columns) by kernel."""
    if df.schema[value].dataType.typeName() in ("long", "integer", "short", "byte"):
        return df.withColumn(name, expr.varint(F.col(value).cast("long")))
    return with_kernel(df, name, "binary", [value], lambda n: None if n is None else text.varint_encode(int(n)))


def varint_decode(df: DataFrame, data: str, name: str = "decoded") -> DataFrame:
    """Native for values that fill their bytes and fit 63 bits; the others go on to the kernel."""
    import decimal

    c, native = F.col(data), F.col("_native")
    # A last byte of zero says nothing: such values are not in their shortest form, which is the kernel's to judge.
    short = (F.octet_length(c) == 1) | (F.hex(F.substring(c, -1, 1)) != "00")
    fine = native.isNotNull() & short
    made = F.struct(native.cast("decimal(20,0)").alias("value"), F.octet_length(c).cast("long").alias("bytes_consumed"), F.lit(None).cast("long").alias("first_error_offset"), F.lit(None).cast("string").alias("message"))

    def run(b):
        value, used, at, message = text.varint_decode(b)
        return {"value": None if value is None else decimal.Decimal(value), "bytes_consumed": used, "first_error_offset": at, "message": message}

    done = _native_first(df.withColumn("_native", expr.varint_value(c)), name, fine, c, made, VARINT, run)
    return done.drop("_native")


def dictionary_frame(spark: SparkSession, dictionary: Dictionary) -> DataFrame:
    rows = [(t, bytearray(k), v, i) for t, k, v, i in dictionary.validate().rows()]
    return spark.createDataFrame(rows, "dict_table string, value_key binary, value string, id long")


def pinned_dictionary(spark: SparkSession, dictionary: Dictionary, pin: str | None) -> DataFrame:
    """A dictionary for probing, held against the fingerprint that it must have."""
    from .integrity import dictionary_fingerprint

    if pin is None:
        raise CodecError("ERR_UNPINNED_DICTIONARY", f"dictionary {dictionary.code} has no pin")
    if dictionary_fingerprint(dictionary.code, dictionary.tables(), dictionary.profile) != pin:
        raise CodecError("ERR_INTEGRITY_MISMATCH", f"dictionary {dictionary.code} differs from its pin")
    return dictionary_frame(spark, dictionary)


def dictionary_conflicts(entries: DataFrame) -> DataFrame:
    """(dict_table, id, n_values) of ids that stand for more than one value."""
    return entries.groupBy("dict_table", "id").agg(F.countDistinct("value").alias("n_values")).where("n_values > 1")


def builtin_tables(spark: SparkSession) -> DataFrame:
    """The fixed ids of the wire format: keywords, legacy contexts, cryptosuites, URL schemes."""
    made = {"keyword": tables.KEYWORDS, "context": tables.LEGACY_CONTEXTS, "cryptosuite": tables.CRYPTOSUITES, "scheme": tables.SCHEMES}
    return spark.createDataFrame([(t, v, i) for t, ids in made.items() for v, i in ids.items()], "dict_table string, value string, id long")


def dictionary_probe(probes: DataFrame, table: Column, value_key: Column, dictionary: DataFrame, name: str = "id") -> DataFrame:
    """A null-preserving lookup: every probe stays, a miss has a null id. The dictionary's (table, value_key) is unique. No hint: Spark broadcasts a side
    that is small enough by its own statistics, and shuffles else."""
    d = dictionary.select(F.col("dict_table").alias("_t"), F.col("value_key").alias("_k"), F.col("id").alias(name))
    keyed = probes.withColumns({"_pt": table, "_pk": value_key})
    return keyed.join(d, (F.col("_pt") == F.col("_t")) & (F.col("_pk") == F.col("_k")), "left").drop("_pt", "_pk", "_t", "_k")


def packed_spans(df: DataFrame, data: str, order_by: str, group_by: list[str]) -> DataFrame:
    """(offset, length) of every slice in its group's packed bytes."""
    n = F.octet_length(data).cast("long")
    return exclusive_scan(df.withColumn("length", n), "length", order_by, "offset", 32, group_by)


def catalogue(spark: SparkSession) -> DataFrame:
    """The families with their priority and whether this library can run them without anything plugged in."""
    rows = [(f, p, f != "cddl-validation") for p, fs in FAMILIES.items() for f in fs]
    return spark.createDataFrame([(f"{f}.v1", p, ok) for f, p, ok in rows], "family string, priority string, available boolean")


#: The family names by priority.
FAMILIES = {
    "high": ("batched-sha256", "byte-diff", "cbor-structural-scan", "uint-prefix-scan", "byte-compaction"),
    "medium": ("byte-statistics", "canonical-key-ordering", "utf8-validation", "multibase-codec"),
    "low": ("unsigned-varint", "dictionary-probe", "whole-document-transform", "cddl-validation"),
}


def acceptance(family: str, c: Column) -> Column:
    """True where a result of a family contradicts itself; a field that is missing where it must not be is a contradiction."""
    steps = lambda ends: F.forall(F.sequence(F.lit(1), F.size(ends) - 1), lambda i: F.get(ends, i) >= F.get(ends, i - 1))
    tests = {
        "batched-sha256": lambda: (F.octet_length(c["digest"]) != 32) | (F.size(c["state_words"]) != 8) | (F.lower(F.hex(c["digest"])) != F.array_join(F.transform(c["state_words"], lambda w: F.lpad(F.lower(F.hex(w)), 8, "0")), "")),
        "byte-diff": lambda: (c["mismatches"] < F.abs(c["left_bytes"] - c["right_bytes"])) | (c["mismatches"] > F.greatest(c["left_bytes"], c["right_bytes"])) | ((c["mismatches"] == 0) != c["first_mismatch"].isNull()) | F.coalesce(c["first_mismatch"] >= F.greatest(c["left_bytes"], c["right_bytes"]), F.lit(False)),
        "cbor-structural-scan": lambda: (c["is_valid"] != c["first_error_offset"].isNull()) | (c["is_valid"] & (c["item_count"] < 1)) | F.coalesce(c["first_error_offset"] > c["byte_count"], F.lit(False)) | (c["is_valid"] != c["error_code"].isNull()),
        "uint-prefix-scan": lambda: (F.size(c["values"]) != F.size(c["offsets"])) | ~F.forall(F.sequence(F.lit(0), F.size(c["values"])), lambda i: F.coalesce(F.get(c["offsets"], i), c["total"]) == F.when(i == 0, 0).otherwise(F.get(c["offsets"], i - 1) + F.get(c["values"], i - 1))),
        "byte-compaction": lambda: (F.element_at(c["offsets"], 1) != 0) | (F.element_at(c["offsets"], -1) != F.octet_length(c["bytes"])) | ((F.size(c["offsets"]) > 1) & ~steps(c["offsets"])),
        "byte-statistics": lambda: (F.size(c["histogram"]) != 256) | (F.aggregate(c["histogram"], F.lit(0).cast("long"), lambda a, x: a + x) != c["byte_count"]) | (c["entropy"] < 0) | (c["entropy"] > 8 + 1e-9),
        "canonical-key-ordering": lambda: F.array_sort(c) != F.when(F.size(c) > 0, F.sequence(F.lit(0), F.size(c) - 1)).otherwise(F.array().cast("array<int>")),
        "utf8-validation": lambda: (c["is_valid"] != c["first_invalid_offset"].isNull()) | F.coalesce(c["first_invalid_offset"] >= c["byte_count"], F.lit(False)) | c["byte_count"].isNull(),
        "multibase-encode": lambda: ~c.rlike("^[uMz]") | (F.length(c) < 1),
        "multibase-codec": lambda: c["decoded"].isNull() == c["first_error_offset"].isNull(),
        "varint-encode": lambda: ~F.octet_length(c).between(1, 10) | ~F.hex(F.substring(c, -1, 1)).rlike("^[0-7]"),
        "unsigned-varint": lambda: (c["value"].isNull() == c["first_error_offset"].isNull()) | (c["value"].isNotNull() & ~F.coalesce(c["bytes_consumed"].between(1, 10), F.lit(False))),
        "dictionary-probe": lambda: (F.size(c["ids"]) != c["probes"]) | (F.size(F.filter(c["ids"], lambda i: i.isNotNull())) != c["hits"]) | F.exists(F.filter(c["ids"], lambda i: i.isNotNull()), lambda i: i < 0),
        "whole-document-transform": lambda: (c["value"].isNull() == c["failure"].isNull()) | (c["failure"].isNotNull() & ~F.coalesce(c["failure"]["code"].startswith("ERR_"), F.lit(False))),
        "cddl-validation": lambda: c["is_valid"] != (F.size(c["messages"]) == 0),
        "packed-batch": lambda: (c["offset"] < 0) | (c["length"] < 0) | (c["offset"] + c["length"] > c["total"]) | (c["total"] >= F.lit(1 << 32)),
    }
    if family not in tests:
        raise CodecError("ERR_COMPUTE_FAMILY_UNAVAILABLE", f"{family} has no acceptance test")
    return c.isNull() | F.coalesce(tests[family](), F.lit(True))


def contradictions(df: DataFrame, family: str, column: str) -> DataFrame:
    """Rows whose result contradicts itself: the acceptance test of results that come from elsewhere. Native; keep = audit, raise = strict."""
    return df.where(acceptance(family, F.col(column)))


def accepted(df: DataFrame, family: str, column: str) -> DataFrame:
    """df itself; a query that uses the column fails with ERR_INVALID_COMPUTE_OUTPUT at the first row that contradicts itself."""
    fault = F.raise_error(F.lit(f"ERR_INVALID_COMPUTE_OUTPUT: a result of {family} contradicts itself"))
    return df.withColumn(column, F.when(acceptance(family, F.col(column)), fault.cast(df.schema[column].dataType)).otherwise(F.col(column)))


#: Bounds of what a validation takes and says: bytes of a schema and of a document, messages, and characters of each.
CDDL_LIMITS = {"schema": 1 << 20, "document": 16 << 20, "messages": 100, "message": 1000}


def cddl_validate(df: DataFrame, data: str, schema: str, oracle=None, name: str = "cddl") -> DataFrame:
    """Validity against a CDDL schema by an injected oracle (schema, bytes) -> (is_valid, [messages]), as an outcome of each row.

    Documents beyond CDDL_LIMITS fail with ERR_RESOURCE_LIMIT, an oracle that raises or says more than it may is a failure of its row
    (ERR_INVALID_COMPUTE_OUTPUT); messages are cut, and truncated says so."""
    if oracle is None:
        raise CodecError("ERR_COMPUTE_FAMILY_UNAVAILABLE", "CDDL validation needs an oracle")
    if not schema or len(schema.encode()) > CDDL_LIMITS["schema"]:
        raise CodecError("ERR_RESOURCE_LIMIT", "the schema is empty or too long")

    def run(b):
        if len(b) > CDDL_LIMITS["document"]:
            raise CodecError("ERR_RESOURCE_LIMIT", f"a document of {len(b)} bytes is too long to validate")
        try:
            ok, messages = oracle(schema, b)
            messages = [str(m) for m in messages]
        except CodecError:
            raise
        except Exception as e:  # whatever an injected oracle may raise
            raise CodecError("ERR_INVALID_COMPUTE_OUTPUT", f"the oracle failed: {e}") from e
        if bool(ok) == bool(messages):
            raise CodecError("ERR_INVALID_COMPUTE_OUTPUT", "the oracle's verdict and messages contradict each other")
        cut = [m[: CDDL_LIMITS["message"]] for m in messages[: CDDL_LIMITS["messages"]]]
        return {"is_valid": bool(ok), "messages": cut, "truncated": cut != messages}

    return with_kernel(df, name, outcome("struct<is_valid: boolean, messages: array<string>, truncated: boolean>"), [data], isolated(run))
