"""More queries of the catalogue: literals of every type, scoped contexts, dictionaries, faulty input, manifests with all their pins."""

from __future__ import annotations

import json

from pyspark.sql import functions as F

from ..functions import expr
from ..kernels.cbor import Limits, Policy
from ..kernels.envelope import Config
from ..kernels.tables import CRYPTOSUITE, MULTIBASE, XSD, Dictionary
from ..operators import codec, families, integrity
from .catalogue import ENVELOPES, HEX, envelopes, low_hex, query, sql_head, sql_int, sql_text, table, text_bytes

# --- literals: the short form as CBOR, byte for byte


def shown(df, key, name="literal"):
    return df.select(key, low_hex(F.col(f"{name}.value.cbor")).alias("cbor"), F.col(f"{name}.value.back").alias("back"), F.col(f"{name}.failure.code").alias("code"))


_WHEN = "strftime(o_orderdate::DATE, '%Y-%m-%d') || CASE o_orderkey % 3 WHEN 0 THEN 'T10:20:30Z' WHEN 1 THEN 'T10:20:30.250Z' ELSE 'T10:20Z' END"
_SECONDS = "((epoch(o_orderdate::DATE))::BIGINT + 37230)"


@query(f"SELECT o_orderkey, {HEX(f'''CASE o_orderkey % 3 WHEN 0 THEN {sql_int(_SECONDS)} WHEN 1 THEN unhex('82') || {sql_int(_SECONDS)} || unhex('18fa') ELSE {sql_text('t')} END''')} AS cbor, t AS back, NULL AS code FROM (SELECT *, {_WHEN} AS t FROM orders)")
def datetime_literals(spark, sf_dir):
    """Seconds, seconds and milliseconds, and a form that stays text."""
    day, tail = F.date_format("o_orderdate", "yyyy-MM-dd"), F.element_at(F.array(*map(F.lit, ("T10:20:30Z", "T10:20:30.250Z", "T10:20Z"))), (F.col("o_orderkey") % 3 + 1).cast("int"))
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.concat(day, tail).alias("t"))
    return shown(codec.literals(o, "t", XSD + "dateTime"), "o_orderkey")


@query(f"SELECT o_orderkey, {HEX(f'''CASE WHEN o_orderkey % 4 = 0 THEN {sql_text('t')} ELSE {sql_int('(epoch(o_orderdate::DATE))::BIGINT')} END''')} AS cbor, t AS back, NULL AS code FROM (SELECT *, CASE WHEN o_orderkey % 4 = 0 THEN strftime(o_orderdate::DATE, '%d.%m.%Y') ELSE strftime(o_orderdate::DATE, '%Y-%m-%d') END AS t FROM orders)")
def date_literals_cbor(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    t = F.when(F.col("o_orderkey") % 4 == 0, F.date_format("o_orderdate", "dd.MM.yyyy")).otherwise(F.date_format("o_orderdate", "yyyy-MM-dd"))
    return shown(codec.literals(o.select("o_orderkey", t.alias("t")), "t", XSD + "date"), "o_orderkey")


_BASE64 = "base64(encode(c_name))"


@query(f"SELECT c_custkey, {HEX(f'''unhex('8304') || {sql_text('m')} || {sql_head(2, 'strlen(c_name)')} || encode(c_name)''')} AS cbor, 'data:' || m || ';base64,' || {_BASE64} AS back, NULL AS code FROM (SELECT *, 'text/' || c_mktsegment AS m FROM customer) WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, {HEX(f'''unhex('8204') || {sql_text('r')}''')}, 'data:' || r, NULL FROM (SELECT *, ',' || c_name AS r FROM customer) WHERE c_custkey % 2 = 1")
def data_urls(spark, sf_dir):
    """With base64 the bytes themselves, without it the rest of the text."""
    c = table(spark, sf_dir, "customer")
    b64 = F.regexp_replace(F.base64(F.col("c_name").cast("binary")), r"\s", "")
    url = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("data:text/"), "c_mktsegment", F.lit(";base64,"), b64)).otherwise(F.concat(F.lit("data:,"), "c_name"))
    return shown(codec.literals(c.select("c_custkey", url.alias("u")), "u", "url"), "c_custkey")


_DID = "lpad(c_custkey::VARCHAR, 9, '0')"


@query(f"SELECT c_custkey, {HEX(f'''CASE WHEN c_custkey % 2 = 0 THEN unhex('82190401') || {sql_text('k')} ELSE unhex('83190400') || {sql_text('k')} || {sql_text('f')} END''')} AS cbor, CASE WHEN c_custkey % 2 = 0 THEN 'did:key:' || k ELSE 'did:v1:nym:' || k || '#' || f END AS back, NULL AS code FROM (SELECT *, {_DID} AS k, 'key-' || c_nationkey AS f FROM customer)")
def did_urls(spark, sf_dir):
    """Method, identifier and fragment; identifiers here are no base58 text, so they stay as they are."""
    k = F.lpad(F.col("c_custkey").cast("string"), 9, "0")
    u = F.when(F.col("c_custkey") % 2 == 0, F.concat(F.lit("did:key:"), k)).otherwise(F.concat(F.lit("did:v1:nym:"), k, F.lit("#key-"), "c_nationkey"))
    return shown(codec.literals(table(spark, sf_dir, "customer").select("c_custkey", u.alias("u")), "u", "url"), "c_custkey")


@query(f"SELECT c_custkey, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE {HEX(f'''{sql_head(2, '(1 + strlen(c_name))')} || unhex('75') || encode(c_name)''')} END AS cbor, CASE WHEN c_custkey % 5 = 0 THEN NULL ELSE 'u' || rtrim(translate({_BASE64}, '+/', '-_'), '=') END AS back, CASE WHEN c_custkey % 5 = 0 THEN 'ERR_INVALID_INPUT' END AS code FROM customer")
def multibase_literals(spark, sf_dir):
    """The prefix's byte and the bytes; every fifth value is not sound and fails."""
    c = table(spark, sf_dir, "customer")
    m = F.when(F.col("c_custkey") % 5 == 0, F.lit("u!")).otherwise(expr.multibase(F.col("c_name"), "u"))
    return shown(codec.literals(c.select("c_custkey", m.alias("m")), "m", MULTIBASE), "c_custkey")


@query(f"SELECT c_custkey, {HEX(f'''CASE WHEN c_custkey % 2 = 0 THEN unhex('820350') || unhex(h) ELSE unhex('8203') || {sql_text('upper(t)')} END''')} AS cbor, 'urn:uuid:' || CASE WHEN c_custkey % 2 = 0 THEN t ELSE upper(t) END AS back, NULL AS code FROM (SELECT *, substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 4) || '-' || substr(h, 17, 4) || '-' || substr(h, 21) AS t FROM (SELECT *, md5(c_name) AS h FROM customer))")
def uuid_urls(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", expr.uuid_text(F.unhex(F.md5(F.col("c_name").cast("binary")))).alias("t"))
    u = F.concat(F.lit("urn:uuid:"), F.when(F.col("c_custkey") % 2 == 0, F.col("t")).otherwise(F.upper("t")))
    return shown(codec.literals(c.select("c_custkey", u.alias("u")), "u", "url"), "c_custkey")


@query(f"SELECT s_suppkey, {HEX('''CASE WHEN s_suppkey < 128 - 1 THEN unhex('41' || printf('%02x', s_suppkey)) WHEN s_suppkey < 32768 - 1 THEN unhex('42' || printf('%04x', s_suppkey)) ELSE unhex('44' || printf('%08x', s_suppkey)) END''')} AS cbor, s_suppkey::VARCHAR AS back, NULL AS code FROM supplier")
def integer_bytes(spark, sf_dir):
    """Integers of a type that has a table are bytes, as plain ones would be ids of it."""
    s = table(spark, sf_dir, "supplier").select("s_suppkey", F.col("s_suppkey").cast("long").alias("n"))
    return shown(codec.literals(s, "n", "ex:n", tables={"ex:n": {"a": 1}}), "s_suppkey")


_SUITES = ("ecdsa-rdfc-2019", "ecdsa-sd-2023", "eddsa-rdfc-2022", "ecdsa-xi-2023")


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 5 = 4 THEN '65' || lower(hex(encode('other'))) ELSE printf('%02x', n_nationkey % 5 + 1) END AS cbor, CASE n_nationkey % 5 " + " ".join(f"WHEN {i} THEN '{s}'" for i, s in enumerate(_SUITES)) + " ELSE 'other' END AS back, NULL AS code FROM nation")
def cryptosuite_ids(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    s = F.element_at(F.array(*map(F.lit, (*_SUITES, "other"))), (F.col("n_nationkey") % 5 + 1).cast("int"))
    return shown(codec.literals(n.select("n_nationkey", s.alias("s")), "s", CRYPTOSUITE, tables={CRYPTOSUITE: {x: i + 1 for i, x in enumerate(_SUITES)}}), "n_nationkey")


# --- contexts

_SCOPED = {
    "urn:a": {"@context": {"ex": "urn:ex#", "name": "ex:name", "made": {"@id": "ex:made", "@type": XSD + "date"}, "owner": {"@id": "ex:owner", "@context": {"name": {"@id": "ex:ownerName", "@type": "@id"}}}, "Part": {"@id": "ex:Part", "@context": {"size": {"@id": "ex:size"}}}}},
    "urn:safe": {"@context": {"@protected": True, "name": "urn:x:name"}},
    "urn:clash": {"@context": {"name": "urn:y:name"}},
}


@query("SELECT p_partkey, p_name AS name, p_size::BIGINT AS size, 'https://o.example/' || p_brand AS owner, true AS smaller FROM part")
def scoped_contexts(spark, sf_dir):
    """Property-scoped and type-scoped terms, and prefixes; terms within the owner don't leak out. All come back, in fewer bytes."""
    p = table(spark, sf_dir, "part")
    doc = F.struct(F.lit("urn:a").alias("@context"), F.lit("Part").alias("@type"), F.col("p_name").alias("name"), F.col("p_size").alias("size"), F.struct(F.concat(F.lit("https://o.example/"), "p_brand").alias("name")).alias("owner"))
    c = codec.encode_json(p.select("p_partkey", F.to_json(doc).alias("j")), "j", Config(registry_id=1, contexts=_SCOPED), "e").withColumn("b", F.col("e.value"))
    d = codec.decode_json(c, "b", Config(registry_id=1, contexts=_SCOPED))
    v = F.from_json("decoded.value", "name string, size long, owner struct<name: string>")
    return d.select("p_partkey", v["name"].alias("name"), v["size"].alias("size"), v["owner"]["name"].alias("owner"), (F.octet_length("b") < F.octet_length("j")).alias("smaller"))


@query("SELECT n_nationkey, CASE n_nationkey % 4 WHEN 1 THEN 'ERR_PROTECTED_TERM_REDEFINITION' WHEN 2 THEN 'ERR_UNKNOWN_CONTEXT' ELSE NULL END AS code FROM nation")
def context_faults(spark, sf_dir):
    """Sound, a protected term redefined, an unknown context, and the same definition twice."""
    c = F.element_at(F.array(*[F.lit(json.dumps(x)) for x in (["urn:safe"], ["urn:safe", "urn:clash"], ["urn:gone"], ["urn:safe", "urn:safe"])]), (F.col("n_nationkey") % 4 + 1).cast("int"))
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.concat(F.lit('{"@context": '), c, F.lit(', "name": "x"}')).alias("j"))
    return codec.encode_json(n, "j", Config(registry_id=1, contexts=_SCOPED)).select("n_nationkey", F.col("encoded.failure.code").alias("code"))


@query("SELECT n_nationkey, 'x' || n_name AS back, NULL AS code FROM nation WHERE n_nationkey % 3 < 2 UNION ALL SELECT n_nationkey, NULL, 'ERR_NO_TYPETABLE' FROM nation WHERE n_nationkey % 3 = 2")
def several_dictionaries(spark, sf_dir):
    """Documents of three dictionaries, of which the reader has two."""
    ctx = {"urn:d": {"@context": {"v": {"@id": "urn:v", "@type": "ex:n"}}}}
    made = [Dictionary(100 + k, typed={"ex:n": {f"value {k}": 1}}) for k in range(3)]
    n = table(spark, sf_dir, "nation").select("n_nationkey", F.to_json(F.struct(F.lit("urn:d").alias("@context"), F.concat(F.lit("x"), "n_name").alias("v"))).alias("j"))
    parts = [codec.encode_json(n.where(F.col("n_nationkey") % 3 == k), "j", codec.with_dictionary(d, ctx), "e") for k, d in enumerate(made)]
    e = parts[0].unionByName(parts[1]).unionByName(parts[2]).withColumn("b", F.col("e.value"))
    d = codec.decode_json(e, "b", codec.with_dictionaries(made[:2], ctx))
    return d.select("n_nationkey", F.from_json("decoded.value", "v string")["v"].alias("back"), F.col("decoded.failure.code").alias("code"))


@query("SELECT n_nationkey, n_nationkey % 2 = 0 AS short FROM nation")
def legacy_context_ids(spark, sf_dir):
    """An application's own ids in the legacy table: contexts with one don't appear in the bytes, and all come back."""
    ctx = {"urn:app:in": {"@context": {"x": "urn:x"}}, "urn:app:out": {"@context": {"x": "urn:x"}}}
    config = codec.with_legacy_contexts({"urn:app:in": 40_000}, Config(registry_id=1, contexts=ctx))
    u = F.when(F.col("n_nationkey") % 2 == 0, "urn:app:in").otherwise("urn:app:out")
    n = table(spark, sf_dir, "nation").select("n_nationkey", u.alias("u"), F.to_json(F.struct(u.alias("@context"), F.col("n_name").alias("x"))).alias("j"))
    d = codec.decode_json(codec.encode_json(n, "j", config, "e").withColumn("b", F.col("e.value")), "b", config)
    same = F.from_json("decoded.value", "`@context` string")["@context"] == F.col("u")
    return d.where(same).select("n_nationkey", (~F.col("b").cast("string").contains("urn:app")).alias("short"))


# --- faults as data


@query("SELECT c_custkey, CASE c_custkey % 4 WHEN 0 THEN NULL WHEN 1 THEN 0 WHEN 2 THEN 3 ELSE 3 END::BIGINT AS first_error_offset, CASE WHEN c_custkey % 4 = 0 THEN c_name END AS back FROM customer")
def multibase_faults(spark, sf_dir):
    """Sound values, an unknown prefix, a character outside the alphabet, and a base58 one likewise."""
    m = expr.multibase(F.col("c_name"), "u")
    kinds = F.array(m, F.concat(F.lit("x"), m), F.lit("uAA!A"), F.lit("zAA0"))
    c = table(spark, sf_dir, "customer").select("c_custkey", F.element_at(kinds, (F.col("c_custkey") % 4 + 1).cast("int")).alias("m"))
    d = families.multibase_decode(c, "m")
    return d.select("c_custkey", "decoded.first_error_offset", F.col("decoded.decoded").cast("string").alias("back"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey END AS value, CASE o_orderkey % 3 WHEN 0 THEN NULL ELSE strlen(s) - 2 END::BIGINT AS tail FROM (SELECT o_orderkey, 'xx' AS s FROM orders)")
def varint_faults(spark, sf_dir):
    """Whole values, values cut before their end, and empty ones."""
    o = table(spark, sf_dir, "orders").select("o_orderkey", expr.varint(F.col("o_orderkey").cast("long")).alias("v"))
    bad = F.when(F.col("o_orderkey") % 3 == 1, F.lit(b"\x80")).otherwise(F.lit(b""))
    d = families.varint_decode(o.select("o_orderkey", F.when(F.col("o_orderkey") % 3 == 0, F.col("v")).otherwise(bad).alias("v")), "v")
    tail = F.when(F.col("decoded.first_error_offset").isNotNull(), F.lit(0).cast("long"))
    return d.select("o_orderkey", F.col("decoded.value").cast("long").alias("value"), tail.alias("tail"))


@query(f"{ENVELOPES} SELECT CASE doc_id % 5 WHEN 0 THEN 'valid' WHEN 1 THEN 'ERR_NOT_CBORLD' WHEN 2 THEN 'ERR_RESOURCE_LIMIT' ELSE 'valid' END AS outcome, count(*)::BIGINT AS n FROM e GROUP BY 1")
def input_limits(spark, sf_dir):
    """Sound envelopes, ones that are none, and ones beyond the limit on bytes."""
    e = envelopes(spark, sf_dir)
    long = F.concat("c", F.repeat(F.lit("x"), 1 << 17).cast("binary"))
    b = F.when(F.col("doc_id") % 5 == 1, F.lit(b"\x01")).when(F.col("doc_id") % 5 == 2, F.substring(F.concat(long, long, long), 1, 300_000)).otherwise(F.substring("c", 1, 290_000))
    d = codec.decode_json(e.select(b.alias("b")), "b", Config(limits=Limits(input_bytes=290_000)))
    return d.groupBy(F.coalesce("decoded.failure.code", F.lit("valid")).alias("outcome")).agg(F.count("*").alias("n"))


_KINDS = "list_extract([NULL, 'ERR_INVALID_INPUT', '{}', 'ERR_INVALID_INPUT', 'ERR_INVALID_INPUT'], (c_custkey % 5 + 1)::INT)"


@query(f"SELECT c_custkey, {_KINDS.format('ERR_NOT_CBORLD')} AS direct, CASE WHEN c_custkey % 5 = 1 THEN 'ERR_NOT_CBORLD' ELSE {_KINDS.format('ERR_RESERVED_SIMPLE_VALUE')} END AS walked, CASE WHEN c_custkey % 5 = 0 THEN c_name END AS back FROM customer")
def plain_documents(spark, sf_dir):
    """Sound, a key twice, a reserved simple value, an integer beyond 64 bits, and bytes: read straight to JSON, and walked under a policy."""
    name = F.concat(F.unhex(F.hex(F.octet_length("c_name") + 0x60)), F.col("c_name").cast("binary"))
    tails = [F.concat(F.lit(b"\xa1\x61n"), name), *map(F.lit, (b"\xa2\x61n\x01\x61n\x02", b"\xa1\x61n\xf0", b"\xa1\x61n\x1b" + b"\xff" * 8, b"\xa1\x61n\x41x"))]
    b = F.concat(F.lit(b"\xd9\xcb\x1d\x82\x00"), F.element_at(F.array(*tails), (F.col("c_custkey") % 5 + 1).cast("int")))
    c = table(spark, sf_dir, "customer").select("c_custkey", b.alias("b"))
    limits = Limits(reject_duplicate_keys=True)
    d = codec.decode_json(codec.decode_json(c, "b", Config(limits=limits)), "b", Config(limits=limits, policy=Policy(reject_integer_widths=True)), "again")
    same = F.when(F.col("decoded.value").eqNullSafe(F.col("again.value")), F.from_json("decoded.value", "n string")["n"])
    return d.select("c_custkey", F.col("decoded.failure.code").alias("direct"), F.col("again.failure.code").alias("walked"), same.alias("back"))


@query("""SELECT c_custkey, 'ERR_NON_PREFERRED_INTEGER' AS code, 7 + strlen(c_name) AS byte_offset, 9 + strlen(c_name) AS end_offset, '$.tag[1].value[0]' AS container_path, '$[1].' || c_name AS json_path, 0::BIGINT AS major, 24::BIGINT AS info FROM customer WHERE c_custkey % 3 = 1
UNION ALL SELECT c_custkey, 'ERR_NOT_CBORLD', 7 + strlen(c_name), NULL, '$.tag[1]', '$[1]', 5, 1 FROM customer WHERE c_custkey % 3 = 2
UNION ALL SELECT c_custkey, NULL, NULL, NULL, NULL, NULL, NULL, NULL FROM customer WHERE c_custkey % 3 = 0""")
def failure_places(spark, sf_dir):
    """Sound, an integer in two bytes that fits in one, and a document cut before a value: where the fault is, and in which item."""
    tail = F.element_at(F.array(*map(F.lit, (b"\x05", b"\x18\x05", b""))), (F.col("c_custkey") % 3 + 1).cast("int"))
    b = F.concat(F.lit(b"\xd9\xcb\x1d\x82\x00\xa1"), F.unhex(F.hex(F.octet_length("c_name") + 0x60)), F.col("c_name").cast("binary"), tail)
    d = codec.decode_json(table(spark, sf_dir, "customer").select("c_custkey", b.alias("b")), "b", Config(policy=Policy(reject_integer_widths=True)))
    at = [F.col(f"decoded.failure.{c}") for c in ("code", "byte_offset", "end_offset", "container_path", "json_path")]
    return d.select("c_custkey", *at, *[F.col(f"decoded.failure.{c}").cast("long").alias(c) for c in ("major", "info")])


@query("SELECT doc_id % 3 = 0 AS valid, count(*)::BIGINT AS n, count(*) FILTER (WHERE doc_id % 3 = 2)::BIGINT AS failures FROM documents GROUP BY 1")
def cddl_verdicts(spark, sf_dir):
    """An injected oracle: sound, refused, and failing on the row."""

    def oracle(schema: str, b: bytes):
        k = int.from_bytes(b, "big") % 3
        if k == 2:
            raise ValueError("no verdict")
        return k == 0, [] if k == 0 else ["not a multiple of three"]

    d = table(spark, sf_dir, "documents").select(F.unhex(F.hex("doc_id")).alias("b"))
    r = families.cddl_validate(d, "b", "any", oracle)
    return r.groupBy(F.coalesce("cddl.value.is_valid", F.lit(False)).alias("valid")).agg(F.count("*").alias("n"), F.count("cddl.failure").alias("failures"))


@query("SELECT family, count(*)::BIGINT AS n FROM (SELECT 'byte-compaction' AS family FROM customer WHERE c_custkey % 2 = 1 UNION ALL SELECT 'uint-prefix-scan' FROM customer WHERE c_custkey % 3 = 1 UNION ALL SELECT 'canonical-key-ordering' FROM customer WHERE c_custkey % 5 = 1 UNION ALL SELECT 'packed-batch' FROM customer WHERE c_custkey % 7 = 1 UNION ALL SELECT 'cddl-validation' FROM customer WHERE c_custkey % 11 = 1 UNION ALL SELECT 'dictionary-probe' FROM customer WHERE c_custkey % 13 = 1) GROUP BY 1")
def spoilt_results(spark, sf_dir):
    """Results spoilt on purpose in every second, third, ... row: an end, a sum, a place, a span, a verdict, a count."""
    c, key = table(spark, sf_dir, "customer"), F.col("c_custkey")
    off = lambda k: F.when(key % k == 1, 1).otherwise(0)
    n = F.octet_length("c_name").cast("long")
    made = {
        "byte-compaction": F.struct(F.col("c_name").cast("binary").alias("bytes"), F.array(F.lit(0).cast("long"), n + off(2)).alias("offsets")),
        "uint-prefix-scan": F.struct(F.array(n, key).alias("values"), F.array(F.lit(0).cast("long"), n + off(3)).alias("offsets"), (n + key).alias("total")),
        "canonical-key-ordering": F.array(F.lit(1), off(5).cast("int")),
        "packed-batch": F.struct(F.lit(0).alias("offset"), (n + off(7)).alias("length"), n.alias("total")),
        "cddl-validation": F.struct(F.lit(True).alias("is_valid"), F.array_repeat(F.lit("x"), off(11)).alias("messages")),
        "dictionary-probe": F.struct(F.lit(1).alias("probes"), (1 + off(13)).alias("hits"), F.array(key).alias("ids")),
    }
    parts = [families.contradictions(c.select(v.alias("r")), f, "r").select(F.lit(f).alias("family")) for f, v in made.items()]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out.groupBy("family").agg(F.count("*").alias("n"))


# --- manifests and digests


@query("SELECT kind, status, count(*)::BIGINT AS n FROM (SELECT unnest(['manifest', 'envelope', 'envelope-metadata', 'format-support', 'transport-digest', 'document-dictionary', 'context-document', 'document-decoding', 'structural-fingerprint']) AS kind, unnest([CASE p_partkey % 5 WHEN 1 THEN 'invalid' ELSE 'verified' END, 'verified', CASE p_partkey % 5 WHEN 1 THEN 'not-checked' WHEN 2 THEN 'mismatch' ELSE 'verified' END, 'verified', CASE p_partkey % 5 WHEN 1 THEN 'not-checked' ELSE 'verified' END, CASE p_partkey % 5 WHEN 1 THEN 'not-checked' WHEN 3 THEN 'mismatch' ELSE 'verified' END, CASE p_partkey % 5 WHEN 1 THEN 'not-checked' WHEN 4 THEN 'unavailable' ELSE 'verified' END, CASE WHEN p_partkey % 5 IN (3, 4) THEN 'unavailable' ELSE 'verified' END, CASE p_partkey % 5 WHEN 1 THEN 'not-checked' WHEN 3 THEN 'unavailable' WHEN 4 THEN 'unavailable' ELSE 'verified' END]) AS status FROM part) GROUP BY 1, 2")
def manifest_pins(spark, sf_dir):
    """Manifests that are sound, can't be right, state another envelope, another dictionary, or a context that is not there."""
    ctx = {"urn:c": {"@context": {"v": {"@id": "urn:v", "@type": "ex:n"}}}}
    config = codec.with_dictionary(Dictionary(200, typed={"ex:n": {"a": 1}}), ctx)
    p = table(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct(F.lit("urn:c").alias("@context"), F.col("p_name").alias("v"))).alias("j"))
    e = codec.encode_json(p, "j", config, "e").select("p_partkey", "j", F.col("e.value").alias("c"))
    own = integrity.fingerprints(e, "j").select("p_partkey", "c", F.col("fingerprint.value").alias("own"))
    m = integrity.manifest(own, "p_partkey", "c", contexts=ctx, dictionary=(200, config.tables[200]), structural="own").select("p_partkey", "manifest")
    k, was = F.col("p_partkey") % 5, F.col("manifest")
    spoilt = (
        F.when(k == 1, was.withField("transport_sha256", F.lit("0"))).when(k == 2, was.withField("envelope.byte_count", F.lit(1).cast("long")))
        .when(k == 3, was.withField("dictionary", F.sha2(F.lit(b"other"), 256))).when(k == 4, was.withField("contexts", F.create_map(F.lit("urn:gone"), F.sha2(F.lit(b"c"), 256)))).otherwise(was)
    )
    r = integrity.report_against(e.select("p_partkey", "c"), m.select(spoilt.alias("manifest")), "p_partkey", "c", config)
    return r.select(F.explode("checks").alias("k")).groupBy("k.kind", "k.status").agg(F.count("*").alias("n"))


@query("SELECT p_partkey, p_name AS back, true AS pinned, 1::BIGINT AS dictionaries FROM part")
def decoding_provenance(spark, sf_dir):
    """Decoded documents with the fingerprints of what they were decoded with, which are those that their manifests pin."""
    ctx = {"urn:c": {"@context": {"v": {"@id": "urn:v", "@type": "ex:n"}}}}
    config = codec.with_dictionary(Dictionary(200, typed={"ex:n": {"a": 1}}), codec.resolve_contexts(["urn:c"], {}, fallback=ctx.get))
    p = table(spark, sf_dir, "part").select("p_partkey", F.to_json(F.struct(F.lit("urn:c").alias("@context"), F.col("p_name").alias("v"))).alias("j"))
    e = codec.encode_json(p, "j", config, "e").select("p_partkey", F.col("e.value").alias("c"))
    m = integrity.manifest(e, "p_partkey", "c", contexts=ctx, dictionary=(200, config.tables[200]))
    d = codec.decode_json(m, "c", config).withColumn("with", integrity.provenance(config))
    pinned = (F.col("with.dictionaries")["200"] == F.col("manifest.dictionary")) & (F.col("with.contexts")["urn:c"] == F.col("manifest.contexts")["urn:c"])
    return d.select("p_partkey", F.from_json("decoded.value", "v string")["v"].alias("back"), pinned.alias("pinned"), F.size("with.dictionaries").cast("long").alias("dictionaries"))


@query("SELECT doc_id, 'sha256:transport:v1:' || sha256(text) AS digest, doc_id % 2 = 0 AS sound FROM documents")
def digest_texts(spark, sf_dir):
    """Written and read again; every second one has lost its end."""
    d = integrity.transport_digest(text_bytes(spark, sf_dir), "b").withColumn("t", expr.digest_text("sha256", "transport", 1, F.col("digest.bytes")))
    read = expr.digest_parts(F.when(F.col("doc_id") % 2 == 0, F.col("t")).otherwise(F.substring("t", 1, 80)))
    return d.select("doc_id", F.col("t").alias("digest"), F.coalesce(read["bytes"] == F.col("digest.bytes"), F.lit(False)).alias("sound"))


@query("SELECT count(*)::BIGINT AS n, count(*) FILTER (WHERE doc_id % 4 > 0)::BIGINT AS n_values, count(*) FILTER (WHERE doc_id % 4 = 0)::BIGINT AS n_failures, true AS timed FROM documents")
def batch_observation(spark, sf_dir):
    e = envelopes(spark, sf_dir).select(F.when(F.col("doc_id") % 4 == 0, F.lit(b"\x01")).otherwise(F.col("c")).alias("c"))
    t = codec.observed(codec.decode_json(codec.batch_guard(e, "c", 1 << 40, 1 << 50), "c"), "decoded")
    return t.select("n", "n_values", "n_failures", (F.col("nanoseconds") > 0).alias("timed"))


@query("SELECT n_nationkey, CASE WHEN n_nationkey % 3 = 0 THEN NULL ELSE n_nationkey + 10 END::BIGINT AS id FROM nation")
def pinned_probe(spark, sf_dir):
    """A probe of a dictionary that is held against its fingerprint first."""
    names = [r["n_name"] for r in table(spark, sf_dir, "nation").orderBy("n_nationkey").collect()]  # a dictionary is a driver-side value of fixed size
    d = Dictionary(300, typed={"ex:n": {v: i + 10 for i, v in enumerate(names) if i % 3}})
    held = families.pinned_dictionary(spark, d, integrity.dictionary_fingerprint(300, d.tables()))
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_name")
    return families.dictionary_probe(n, F.lit("ex:n"), expr.item(F.col("n_name"), n.schema["n_name"].dataType), held).select("n_nationkey", "id")


@query(f"{ENVELOPES} SELECT doc_id, lower(hex(c)) AS bytes, text AS back, 14::BIGINT AS n_nodes, octet_length(c)::BIGINT AS last_end FROM e")
def sql_functions(spark, sf_dir):
    """The codec called from SQL: encoding, decoding, and a table function of items."""
    from ..functions import sql

    sql.register(spark)
    table(spark, sf_dir, "documents").createOrReplaceTempView("tessera_documents")
    return spark.sql("""
        WITH e AS (SELECT doc_id, tessera_encode_json(to_json(struct(doc_id, text, lang, source, n_chars))).value AS c FROM tessera_documents),
        n AS (SELECT doc_id, count(*) AS n_nodes, max(n.end) AS last_end FROM e, LATERAL tessera_nodes(c) n GROUP BY doc_id)
        SELECT e.doc_id, lower(hex(c)) AS bytes, from_json(tessera_decode_json(c).value, 'text string').text AS back, n_nodes, last_end FROM e JOIN n ON e.doc_id = n.doc_id""")
