"""Digests, fingerprints, manifests and verification reports. Digests are native; reports are arrays of checks that explode into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..errors import CodecError
from ..functions import expr
from ..functions.arrow import isolated, outcome, with_kernel
from ..kernels import cbor, envelope
from ..kernels.cbor import Pairs
from ..kernels.envelope import Config
from ..kernels.tables import value_key

#: Digest sizes by algorithm, and domains.
ALGORITHMS = {"sha256": 256, "sha384": 384, "sha512": 512}
DOMAINS = ("transport", "structural-document", "context-document", "document-dictionary")


def transport_digest(df: DataFrame, data: str, algorithm: str = "sha256", name: str = "digest") -> DataFrame:
    """struct(algorithm, domain, version, bytes) of the exact bytes."""
    if algorithm not in ALGORITHMS:
        raise CodecError("ERR_INVALID_DIGEST", f"unknown algorithm {algorithm}")
    made = F.unhex(F.sha2(expr.octets(F.col(data)), ALGORITHMS[algorithm]))
    return df.withColumn(name, F.struct(F.lit(algorithm).alias("algorithm"), F.lit("transport").alias("domain"), F.lit(1).cast("tinyint").alias("version"), made.alias("bytes")))


def chunk_digest(df: DataFrame, chunk: str, order_by: str, group_by: list[str], name: str = "sha256") -> DataFrame:
    """Hex SHA-256 of chunks joined in order. A group is one artifact: it must fit in one value (2 GB)."""
    joined = F.expr(f"listagg({chunk}, X'') WITHIN GROUP (ORDER BY {order_by})")
    return df.groupBy(*group_by).agg(F.sha2(joined, 256).alias(name))


def structural_fingerprint(df: DataFrame, columns: list[str], name: str = "fingerprint", domain: str = "structural-document") -> DataFrame:
    """Hex fingerprint of rows with a known schema: the domain-separated digest of their canonical bytes."""
    fields = {c: (F.col(c), df.schema[c].dataType) for c in columns}
    return df.withColumn(name, expr.fingerprint(expr.document(fields), domain))


def _fingerprint(value, domain: str) -> str:
    import hashlib

    return hashlib.sha256(b"CBOR-LD\0" + domain.encode() + b"\0\x01" + cbor.encode(value)).hexdigest()


def document_fingerprint(document) -> str:
    return _fingerprint(cbor.from_json(document), "structural-document")


def context_fingerprint(document) -> str:
    return _fingerprint(cbor.from_json(document), "context-document")


def dictionary_fingerprint(code: int, tables: dict, profile: str | None = None) -> str:
    entries = lambda t: Pairs((cbor.decode(value_key(v)), i) for v, i in (t.items() if isinstance(t, dict) else t))
    fields = Pairs([("code", code), ("contexts", entries(tables.get("context", {}))), ("uris", entries(tables.get("url", {}))), ("untypedValues", entries(tables.get("none", {})))])
    fields.append(("typedValues", Pairs((n, entries(t)) for n, t in tables.items() if n not in ("context", "url", "none"))))
    if profile is not None:
        fields.append(("profile", profile))
    return _fingerprint(fields, "document-dictionary")


def provenance(config: Config) -> Column:
    """What gives compressed values their meaning: fingerprints of the dictionaries by registry id, and of the contexts by URL. A literal
    column, to go with the documents that config decodes."""
    made = {
        "dictionaries": {str(k): dictionary_fingerprint(k, t) for k, t in sorted(config.tables.items())},
        "contexts": {u: context_fingerprint(d) for u, d in sorted((config.contexts or {}).items())},
    }
    return F.struct(*[F.create_map(*[F.lit(x) for kv in m.items() for x in kv]).cast("map<string,string>").alias(n) for n, m in made.items()])


def fingerprints(df: DataFrame, json: str, name: str = "fingerprint") -> DataFrame:
    """Fingerprints of JSON documents of any shape."""
    return with_kernel(df, name, outcome("string"), [json], isolated(lambda s: document_fingerprint(cbor.parse_json(s))))


def verify_digest(data: Column, expected: Column, algorithm: str = "sha256") -> Column:
    """Status of a digest: verified, mismatch, or not-checked without an expected value. Compared by equality, not in constant time."""
    made = F.unhex(F.sha2(expr.octets(data), ALGORITHMS[algorithm]))
    return F.when(expected.isNull(), "not-checked").when(made == expected, "verified").otherwise("mismatch")


def manifest(df: DataFrame, artifact: str, data: str, name: str = "manifest", contexts: dict | None = None, dictionary: tuple[int, dict] | None = None, structural: str | None = None) -> DataFrame:
    """A sidecar per artifact: transport digest, envelope facts, the structural fingerprint (a column, if given), and the fingerprints of the
    contexts and the dictionary that it was made with."""
    from .codec import inspect

    looked = inspect(df, data, "_i")
    pins = F.create_map(*[F.lit(x) for u, d in sorted((contexts or {}).items()) for x in (u, context_fingerprint(d))]) if contexts else F.create_map().cast("map<string,string>")
    bound = F.lit(dictionary_fingerprint(*dictionary)) if dictionary else F.lit(None).cast("string")
    facts = F.struct(*[F.col(f"_i.value.{c}").alias(c) for c in ENVELOPE])
    own = (F.col(structural) if structural else F.lit(None)).cast("string").alias("structural_sha256")
    made = F.struct(F.lit(1).alias("version"), F.col(artifact).cast("string").alias("artifact"), F.sha2(data, 256).alias("transport_sha256"), own, facts.alias("envelope"), pins.alias("contexts"), bound.alias("dictionary"))
    return looked.withColumn(name, F.when(F.col("_i.failure").isNull(), made)).drop("_i")


#: The facts of an envelope that a manifest states.
ENVELOPE = ("format", "registry_id", "compressed", "byte_count")


def manifest_fault(m: Column) -> Column:
    """ERR_INVALID_MANIFEST for a manifest whose version, envelope or digests can't be right; null for a sound one."""
    digest = lambda c: F.coalesce(c.rlike("^[0-9a-f]{64}$"), F.lit(False))
    or_none = lambda c: c.isNull() | digest(c)
    sound = (m["version"] == 1) & digest(m["transport_sha256"]) & or_none(m["structural_sha256"]) & or_none(m["dictionary"])
    sound = sound & F.coalesce(F.forall(F.map_values(m["contexts"]), digest), F.lit(True)) & (F.length(m["artifact"]) > 0) & (m["envelope"]["byte_count"] > 0)
    return F.when(~F.coalesce(sound, F.lit(False)), "ERR_INVALID_MANIFEST")


CHECK = "struct<kind: string, subject: string, status: string, expected: string, observed: string, message: string>"
#: What is checked, in order, and how a check can end.
KINDS = ("manifest", "envelope", "envelope-metadata", "format-support", "transport-digest", "document-dictionary", "context-document", "document-decoding", "structural-fingerprint")
STATUSES = ("verified", "mismatch", "invalid", "not-checked", "unavailable")


def _text(x) -> Column:
    return F.lit(x).cast("string") if not isinstance(x, Column) else x.cast("string")


def check(kind: str, status, expected=None, observed=None, message=None, subject=None) -> Column:
    """One check; without a subject it is about the whole document."""
    return F.struct(*[_text(x).alias(n) for n, x in (("kind", kind), ("subject", subject), ("status", status), ("expected", expected), ("observed", observed), ("message", message))])


def compared_to(expected: Column, observed: Column) -> Column:
    """not-checked without an expected value, unavailable without an observed one."""
    return F.when(expected.isNull(), "not-checked").when(observed.isNull(), "unavailable").when(expected == observed, "verified").otherwise("mismatch")


def verification_report(
    df: DataFrame, data: str, expected_sha256: str | None = None, config: Config = Config(), expected_fingerprint: str | None = None,
    context_pins: dict | Column | None = None, dictionary_pin: Column | str | None = None, expected_envelope: Column | None = None, name: str = "checks",
) -> DataFrame:
    """The checks of each document, in the order of KINDS. Never raises for a row.

    Expected values are columns or, for pins, values for all rows; null ones are not checked. Each pinned context has a check of its own: one
    that the configuration lacks is unavailable. The dictionary is the one of the document's registry entry. Decoding waits for these pins:
    where one does not hold, it is withheld, and so is the structural fingerprint."""
    pins = context_pins if isinstance(context_pins, Column) else F.create_map(*[F.lit(x) for kv in sorted((context_pins or {}).items()) for x in kv]).cast("map<string,string>")
    known = lambda found: F.create_map(*[F.lit(x) for kv in sorted(found.items()) for x in kv]) if found else F.create_map().cast("map<string,string>")
    contexts = known({u: context_fingerprint(d) for u, d in (config.contexts or {}).items()})
    dictionaries = known({str(code): dictionary_fingerprint(code, tables) for code, tables in {0: {}, 1: {}, **config.tables}.items()})
    pinned = dictionary_pin if isinstance(dictionary_pin, Column) else F.lit(dictionary_pin).cast("string")

    def look(b: bytes) -> dict:
        p = envelope.parse(b, config.limits, config.policy)
        return {"format": p.format, "registry_id": p.registry_id, "compressed": p.compressed, "byte_count": len(b)}

    kind = "struct<format: string, registry_id: bigint, compressed: boolean, byte_count: bigint>"
    seen = with_kernel(df, "_o", outcome(kind), [data], isolated(look))
    ok, v = F.col("_o.failure").isNull() & F.col("_o").isNotNull(), F.col("_o.value")
    sound = lambda status: F.when(~ok, "unavailable").otherwise(status)
    of_contexts = F.transform(
        F.array_sort(F.map_entries(F.coalesce(pins, F.create_map().cast("map<string,string>")))),
        lambda e: check("context-document", compared_to(e["value"], F.try_element_at(contexts, e["key"])), e["value"], F.try_element_at(contexts, e["key"]), subject=e["key"]),
    )
    of_contexts = F.when(F.size(of_contexts) > 0, of_contexts).otherwise(F.array(check("context-document", "not-checked")))
    own = F.try_element_at(dictionaries, v["registry_id"].cast("string"))
    of_dictionary = check("document-dictionary", sound(compared_to(pinned, own)), pinned, own, subject=v["registry_id"])
    seen = seen.withColumns({"_c": of_contexts, "_d": of_dictionary})
    held = F.forall("_c", lambda c: c["status"].isin("verified", "not-checked")) & F.col("_d.status").isin("verified", "not-checked")
    seen = seen.withColumn("_in", F.when(ok & held & v["format"].isin(*config.formats), F.col(data)))
    done = with_kernel(seen, "_f", outcome("string"), ["_in"], isolated(lambda b: document_fingerprint(envelope.decode(b, config))))
    made, want = F.col("_f.value"), lambda c: F.col(c) if c else F.lit(None).cast("string")
    facts = (F.lit(None) if expected_envelope is None else F.to_json(F.struct(*[expected_envelope[c].alias(c) for c in ENVELOPE]))).cast("string")
    facts = facts if expected_envelope is None else F.when(expected_envelope.isNotNull(), facts)
    now = F.to_json(F.struct(*[v[c].alias(c) for c in ENVELOPE]))
    observed = F.sha2(data, 256)
    checks = F.concat(
        F.array(
            check("envelope", F.when(ok, "verified").otherwise("invalid"), None, None, F.col("_o.failure.code")),
            check("envelope-metadata", F.when(facts.isNull(), "not-checked").otherwise(sound(compared_to(facts, now))), facts, now),
            check("format-support", sound(F.when(v["format"].isin(*config.formats), "verified").otherwise("mismatch")), subject=v["format"]),
            check("transport-digest", compared_to(want(expected_sha256), observed), want(expected_sha256), observed),
            F.col("_d"),
        ),
        F.col("_c"),
        F.array(
            check("document-decoding", F.when(F.col("_in").isNull(), "unavailable").when(made.isNotNull(), "verified").otherwise("invalid"), message=F.col("_f.failure.code")),
            check("structural-fingerprint", F.when(want(expected_fingerprint).isNull(), "not-checked").otherwise(compared_to(want(expected_fingerprint), made)), want(expected_fingerprint), made),
        ),
    )
    return done.withColumn(name, checks).drop("_o", "_c", "_d", "_in", "_f")


def report_against(df: DataFrame, manifests: DataFrame, artifact: str, data: str, config: Config = Config(), name: str = "checks") -> DataFrame:
    """Documents held against all that their manifests (a column manifest) state. Without one the manifest check is unavailable; one that
    can't be right is invalid, and its claims are not used.

    Manifests are as many as documents. Spark takes a kernel's rows for about as small as the file they come from, and would collect them on
    the driver to broadcast them; so both sides are sorted."""
    fault = manifest_fault(F.col("manifest"))
    held = manifests.select(F.when(fault.isNull(), F.col("manifest")).alias("_m"), fault.alias("_fault"), F.col("manifest.artifact").alias("_a"))
    joined = df.join(held.hint("merge"), F.col(artifact).cast("string") == F.col("_a"), "left")
    joined = joined.withColumns({"_sha": F.col("_m.transport_sha256"), "_own": F.col("_m.structural_sha256")})
    done = verification_report(joined, data, "_sha", config, "_own", F.col("_m.contexts"), F.col("_m.dictionary"), F.col("_m.envelope"), name)
    status = F.when(F.col("_a").isNull(), "unavailable").when(F.col("_fault").isNotNull(), "invalid").otherwise("verified")
    return done.withColumn(name, F.concat(F.array(check("manifest", status, message=F.col("_fault"))), F.col(name))).drop("_fault", "_a", "_m", "_sha", "_own")


def is_valid(checks: Column) -> Column:
    """What was not checked counts as valid; what could not be checked does not."""
    return F.forall(checks, lambda c: c["status"].isin("verified", "not-checked"))


def problems(checks: Column) -> Column:
    return F.filter(checks, lambda c: ~c["status"].isin("verified", "not-checked"))


def cross_decode_matrix(results: DataFrame) -> DataFrame:
    """results (fixture, encoder, decoder, hex, passed): per fixture the pass counts by encoder, and whether bytes and meaning agree."""
    return results.groupBy("fixture").pivot("encoder").agg(F.sum(F.col("passed").cast("int"))).join(
        results.groupBy("fixture").agg((F.countDistinct("hex") == 1).alias("same_bytes"), F.min("passed").alias("all_decoded")), "fixture"
    )


def lane_timing(samples: DataFrame, by: list[str], ns: str) -> DataFrame:
    """Minimum, median and 95th percentile of each lane."""
    return samples.groupBy(*by).agg(F.min(ns).alias("min_ns"), F.percentile(ns, F.lit(0.5)).alias("median_ns"), F.percentile(ns, F.lit(0.95)).alias("p95_ns"))


def compared(ratio: Column, tolerance: float = 0.05) -> Column:
    return F.when(ratio.isNull(), "unavailable").when(ratio > 1 + tolerance, "win").when(ratio < 1 - tolerance, "loss").otherwise("wash")
