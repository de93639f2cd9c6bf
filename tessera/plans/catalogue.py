"""Every registered query outside the training-data subpackage, and the SQL that each is held against.

Queries run over whole tables and whole texts. Bytes leave as lower-case hex, counts as 64-bit integers, floats rounded."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import expr
from ..kernels.envelope import Config
from ..kernels import tables
from ..kernels.tables import Dictionary
from ..operators import codec, families, integrity

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def text_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.col("text").cast("binary").alias("b"))


FIELDS = ["doc_id", "text", "lang", "source", "n_chars"]


def envelopes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return codec.encode_columns(table(spark, sf_dir, "documents"), FIELDS, "c")


def low_hex(c: Column) -> Column:
    return F.lower(F.hex(c))


# --- the same in SQL


def sql_head(major: int, n: str) -> str:
    m = 32 * major
    return f"unhex(CASE WHEN {n} < 24 THEN printf('%02x', {m} + {n}) WHEN {n} < 256 THEN printf('{m + 24:02x}%02x', {n}) WHEN {n} < 65536 THEN printf('{m + 25:02x}%04x', {n}) WHEN {n} < 4294967296 THEN printf('{m + 26:02x}%08x', {n}) ELSE printf('{m + 27:02x}%016x', {n}) END)"


def sql_text(c: str) -> str:
    return f"(CASE WHEN {c} IS NULL THEN unhex('f6') ELSE {sql_head(3, f'strlen({c})')} || encode({c}) END)"


def sql_int(c: str) -> str:
    return f"(CASE WHEN {c} IS NULL THEN unhex('f6') WHEN {c} >= 0 THEN {sql_head(0, c)} ELSE {sql_head(1, f'(-1 - {c})')} END)"


def sql_key(k: str) -> str:
    return f"unhex('{96 + len(k):02x}{k.encode().hex()}')"


MAP = f"unhex('a5') || {sql_key('lang')} || {sql_text('lang')} || {sql_key('text')} || {sql_text('text')} || {sql_key('doc_id')} || {sql_int('doc_id')} || {sql_key('source')} || {sql_text('source')} || {sql_key('n_chars')} || {sql_int('n_chars')}"
ENVELOPES = f"WITH e AS (SELECT *, unhex('d9cb1d8200') || {MAP} AS c FROM documents)"
HEX = lambda x: f"lower(hex({x}))"


# --- codec


@query(f"{ENVELOPES} SELECT lang, count(*)::BIGINT AS n, sum(octet_length(c))::BIGINT AS encoded_bytes, max(sha256(c)) AS max_sha256, min(sha256(c)) AS min_sha256 FROM e GROUP BY lang")
def encode_documents_by_lang(spark, sf_dir):
    e = envelopes(spark, sf_dir).select("lang", F.octet_length("c").alias("n"), F.sha2("c", 256).alias("d"))
    return e.groupBy("lang").agg(F.count("*").alias("n"), F.sum("n").cast("long").alias("encoded_bytes"), F.max("d").alias("max_sha256"), F.min("d").alias("min_sha256"))


_ORDER = f"unhex('d9cb1d8200a4') || {sql_key('o_custkey')} || {sql_int('o_custkey')} || {sql_key('o_orderkey')} || {sql_int('o_orderkey')} || {sql_key('o_orderstatus')} || {sql_text('o_orderstatus')} || {sql_key('o_orderpriority')} || {sql_text('o_orderpriority')}"


@query(f"SELECT o_orderkey, {HEX(_ORDER)} AS encoded FROM orders")
def encode_orders_bytes(spark, sf_dir):
    o = codec.encode_columns(table(spark, sf_dir, "orders"), ["o_orderkey", "o_custkey", "o_orderstatus", "o_orderpriority"])
    return o.select("o_orderkey", low_hex(F.col("encoded")).alias("encoded"))


@query("SELECT doc_id, text, lang, source, n_chars, true AS ok FROM documents")
def decode_roundtrip_documents(spark, sf_dir):
    e = envelopes(spark, sf_dir).select("c")
    d = codec.decode_typed(e, "c", "doc_id long, text string, lang string, source string, n_chars long")
    return d.select("row.*", F.col("row").isNotNull().alias("ok"))


@query(f"{ENVELOPES} SELECT doc_id, sha256(c) AS sha256 FROM e")
def encode_json_documents(spark, sf_dir):
    """The Arrow twin of the native encoder, on the same rows."""
    d = codec.encode_typed(table(spark, sf_dir, "documents"), FIELDS)
    return d.select("doc_id", F.sha2("encoded.value", 256).alias("sha256"))


CONTEXT = {"name": "ex:name", "nation": "ex:nation"}


@query(f"SELECT c_custkey, lower(hex(unhex('d9cb1d8201a300a2646e616d656765783a6e616d65666e6174696f6e6965783a6e6174696f6e1864') || {sql_text('c_name')} || unhex('1866') || {sql_int('c_nationkey')})) AS encoded, true AS same FROM customer")
def semantic_encode_inline_context(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    context = F.struct(*[F.lit(v).alias(k) for k, v in CONTEXT.items()])
    c = c.select("c_custkey", F.to_json(F.struct(context.alias("@context"), F.col("c_name").alias("name"), F.col("c_nationkey").alias("nation"))).alias("json"))
    c = codec.decode_json(codec.encode_json(c, "json", Config(registry_id=1)).withColumn("b", F.col("encoded.value")), "b", Config(registry_id=1))
    back = F.from_json("decoded.value", "name string, nation long")
    return c.select("c_custkey", low_hex(F.col("b")).alias("encoded"), (back == F.from_json("json", "name string, nation long")).alias("same"))


@query("SELECT c_custkey, lower(hex(unhex('d9cb1d8202a2001980001864') || CASE WHEN c_nationkey % 2 = 0 THEN unhex('19') || unhex(printf('%04x', 36864 + c_nationkey)) ELSE unhex(printf('%02x', 96 + strlen(n_name))) || encode(n_name) END)) AS encoded, true AS same FROM customer JOIN nation ON n_nationkey = c_nationkey")
def semantic_encode_type_table(spark, sf_dir):
    """Nation names through a typed table that has half of them; contexts and table pinned."""
    nations = table(spark, sf_dir, "nation")
    names = {r["n_name"]: 0x9000 + r["n_nationkey"] for r in nations.where("n_nationkey % 2 = 0").collect()}  # 25 nations at any scale
    d = Dictionary(2, contexts={"urn:c": 0x8000}, typed={"ex:t": names})
    config = codec.with_dictionary(d, {"urn:c": {"@context": {"nation": {"@id": "ex:nation", "@type": "ex:t"}}}})
    pins = {"urn:c": integrity.context_fingerprint(config.contexts["urn:c"])}
    pin = integrity.dictionary_fingerprint(2, d.tables())
    c = table(spark, sf_dir, "customer").join(F.broadcast(nations), F.col("c_nationkey") == F.col("n_nationkey"))  # 25 rows at any scale
    c = c.select("c_custkey", F.to_json(F.struct(F.lit("urn:c").alias("@context"), F.col("n_name").alias("nation"))).alias("json"))
    e = codec.whole_document(c, "json", config, pins, pin, "encode").select("c_custkey", "json", F.col("document.value").alias("b"))
    e = codec.whole_document(e, "b", config, pins, pin, "decode")
    same = F.from_json("document.value", "nation string") == F.from_json("json", "nation string")
    return e.select("c_custkey", low_hex(F.col("b")).alias("encoded"), same.alias("same"))


@query("SELECT CASE WHEN doc_id % 5 = 0 THEN 'ERR_NOT_CBORLD' ELSE 'OK' END AS code, count(*)::BIGINT AS n FROM documents GROUP BY 1")
def batch_decode_outcomes(spark, sf_dir):
    """Every fifth envelope is cut by a byte; failures stay with their rows."""
    e = envelopes(spark, sf_dir)
    cut = F.when(F.col("doc_id") % 5 == 0, F.substring("c", F.lit(1), F.octet_length("c") - 1)).otherwise(F.col("c"))
    d = codec.decode_json(e.select("doc_id", cut.alias("c")), "c")
    return d.groupBy(F.coalesce("decoded.failure.code", F.lit("OK")).alias("code")).agg(F.count("*").alias("n"))


@query("SELECT event_id, user_id, event_type FROM events")
def chunked_stream_decode(spark, sf_dir):
    """Events encoded, then decoded as a stream that takes all there is and ends."""
    from ..streaming import decode as streams

    path = f"{sf_dir.rstrip('/')}/events.parquet"
    schema = spark.read.parquet(path).schema
    source = spark.readStream.schema(schema).parquet(path + "*" if _is_file(spark, path) else path)
    encoded = codec.encode_columns(source.select("event_id", "user_id", "event_type"), ["event_id", "user_id", "event_type"])
    decoded = streams.decode_stream(encoded.select("encoded"), "encoded").select(F.from_json("decoded.value", "event_id long, user_id long, event_type string").alias("r")).select("r.*")
    base = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir") or tempfile.gettempdir()
    out = f"{base.rstrip('/')}/tessera-stream-{spark.sparkContext.applicationId}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(out)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    q = decoded.writeStream.format("parquet").option("path", out + "/rows").option("checkpointLocation", out + "/state").trigger(availableNow=True).start()
    q.awaitTermination()
    return spark.read.parquet(out + "/rows")


def _is_file(spark: SparkSession, path: str) -> bool:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p).isFile()


@query(f"{ENVELOPES} SELECT doc_id, 'cbor-ld-1.0' AS format, 0::BIGINT AS registry_id, false AS compressed, octet_length(c)::BIGINT AS byte_count, sha256(c) AS sha256 FROM e")
def inspect_envelopes(spark, sf_dir):
    i = codec.inspect(envelopes(spark, sf_dir).select("doc_id", "c"), "c")
    return i.select("doc_id", *[F.col(f"inspection.value.{x}").alias(x) for x in ("format", "registry_id", "compressed", "byte_count")], low_hex(F.col("inspection.value.sha256")).alias("sha256"))


@query(f"{ENVELOPES} SELECT doc_id, 14::BIGINT AS n_nodes, 3 AS max_depth, octet_length(c)::BIGINT AS last_end, sha256(c) AS root_sha256 FROM e")
def nodes_per_document(spark, sf_dir):
    n = codec.node_rows(envelopes(spark, sf_dir).select("doc_id", "c"), "c")
    root = F.max(F.when(F.col("ordinal") == 0, F.sha2("node_bytes", 256)))
    return n.groupBy("doc_id").agg(F.count("*").alias("n_nodes"), F.max("node.depth").alias("max_depth"), F.max("node.end").alias("last_end"), root.alias("root_sha256"))


# --- families


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def sha256_documents(spark, sf_dir):
    return families.batched_sha256(text_bytes(spark, sf_dir), "b").select("doc_id", low_hex(F.col("sha256.digest")).alias("sha256"))


@query("SELECT doc_id, i, ('0x' || substr(sha256(text), 8 * i + 1, 8))::BIGINT AS word FROM documents, (SELECT unnest(range(0, 8))::INTEGER AS i)")
def sha256_state_words(spark, sf_dir):
    return families.batched_sha256(text_bytes(spark, sf_dir), "b").select("doc_id", F.posexplode("sha256.state_words").alias("i", "word"))


_DIFF = """SELECT id, len(l)::BIGINT AS left_bytes, len(r)::BIGINT AS right_bytes, len(d)::BIGINT AS mismatches, (list_min(d) - 1)::BIGINT AS first_mismatch FROM
 (SELECT id, l, r, list_filter(range(1, greatest(len(l), len(r)) + 1), lambda i: l[i] IS DISTINCT FROM r[i]) AS d FROM p)"""


@query(f"WITH p AS (SELECT a.doc_id AS id, regexp_extract_all(hex(encode(a.text)), '..') AS l, regexp_extract_all(hex(encode(b.text)), '..') AS r FROM documents a JOIN documents b ON b.doc_id = a.doc_id + 1) {_DIFF}")
def byte_diff_neighbours(spark, sf_dir):
    a = text_bytes(spark, sf_dir).select(F.col("doc_id").alias("id"), F.col("b").alias("l"))
    b = text_bytes(spark, sf_dir).select((F.col("doc_id") - 1).alias("id"), F.col("b").alias("r"))
    return families.byte_diff_large(a.join(b, "id"), "l", "r").select("id", "diff.*")


@query(f"WITH p AS (SELECT item_id AS id, regexp_extract_all(hex(encode(d.text)), '..') AS l, regexp_extract_all(hex(encode(m.text)), '..') AS r FROM benchmark m JOIN documents d ON doc_id = item_id) {_DIFF}")
def byte_diff_benchmark_passages(spark, sf_dir):
    m = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").cast("binary").alias("r"))
    d = text_bytes(spark, sf_dir).select(F.col("doc_id").alias("item_id"), F.col("b").alias("l"))
    return families.byte_diff(d.join(m, "item_id"), "l", "r").select(F.col("item_id").alias("id"), "diff.*")


@query("SELECT doc_id, coalesce(sum(strlen(text)) OVER (ORDER BY doc_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS byte_offset FROM documents")
def exclusive_scan_text_bytes(spark, sf_dir):
    d = text_bytes(spark, sf_dir).select("doc_id", F.octet_length("b").alias("n"))
    return families.exclusive_scan(d, "n", "doc_id", "byte_offset").select("doc_id", F.col("byte_offset").cast("long").alias("byte_offset"))


@query("SELECT o_orderkey, o_custkey, coalesce(sum(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS before FROM orders")
def exclusive_scan_per_customer(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_custkey")
    return families.exclusive_scan(o, "o_orderkey", "o_orderkey", "before", 32, ["o_custkey"])


@query("SELECT source, sha256(string_agg(text, '' ORDER BY doc_id)) AS sha256, sum(strlen(text))::BIGINT AS total, count(*)::BIGINT + 1 AS boundaries FROM documents GROUP BY source")
def compact_text_per_source(spark, sf_dir):
    c = families.compact(table(spark, sf_dir, "documents").select("doc_id", "source", F.col("text").cast("binary").alias("b")), "b", "doc_id", ["source"])
    return c.select("source", F.sha2("bytes", 256).alias("sha256"), F.element_at("offsets", -1).alias("total"), F.size("offsets").cast("long").alias("boundaries"))


@query("SELECT n_regionkey, n_name AS slice, (row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) - 1)::INTEGER AS ordinal FROM nation")
def compact_unpack_roundtrip(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_regionkey", "n_nationkey", F.col("n_name").cast("binary").alias("b"))
    u = families.unpack(families.compact(n, "b", "n_nationkey", ["n_regionkey"]))
    return u.select("n_regionkey", F.col("slice").cast("string").alias("slice"), "ordinal")


@query("SELECT lang, b AS byte, count(*)::BIGINT AS n FROM (SELECT lang, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents) GROUP BY 1, 2")
def byte_histogram_by_lang(spark, sf_dir):
    """Each document's bins are summed in the scan, so a few hundred rows per task are shuffled, not every byte."""
    s = families.byte_statistics(text_bytes(spark, sf_dir), "b").select("lang", F.posexplode("stats.histogram").alias("i", "k")).where("k > 0")
    return s.groupBy("lang", F.lpad(F.hex("i"), 2, "0").alias("byte")).agg(F.sum("k").alias("n"))


@query("SELECT n_nationkey, b AS byte, count(*)::BIGINT AS n FROM (SELECT n_nationkey, unnest(regexp_extract_all(hex(encode(n_name)), '..')) AS b FROM nation) GROUP BY 1, 2")
def byte_histogram_native(spark, sf_dir):
    return families.byte_histogram(table(spark, sf_dir, "nation"), "n_name", ["n_nationkey"])


@query("""WITH h AS (SELECT doc_id, b, count(*) AS k FROM (SELECT doc_id, unnest(regexp_extract_all(hex(encode(text)), '..')) AS b FROM documents) GROUP BY 1, 2)
SELECT d.doc_id, strlen(d.text)::BIGINT AS byte_count, round(coalesce(e, 0), 9) + 0.0 AS entropy FROM documents d LEFT JOIN (SELECT h.doc_id, -sum((k / t) * log2(k / t)) AS e FROM h JOIN (SELECT doc_id, sum(k) AS t FROM h GROUP BY 1) USING (doc_id) GROUP BY 1) USING (doc_id)""")
def byte_entropy(spark, sf_dir):
    s = families.byte_statistics(text_bytes(spark, sf_dir), "b")
    return s.select("doc_id", "stats.byte_count", (F.round("stats.entropy", 9) + 0.0).alias("entropy"))


def _words(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.posexplode(F.split("p_name", " ")).alias("ord", "w"))
    return p.select("p_partkey", "ord", "w", F.col("w").cast("binary").alias("k"))


_KEYS = "SELECT p_partkey, (i - 1)::INTEGER AS ord, w, (row_number() OVER (PARTITION BY p_partkey ORDER BY {by}, i) - 1)::INTEGER AS rank FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) AS i FROM part)"


@query(_KEYS.format(by="strlen(w), encode(w)"))
def key_order_length_first(spark, sf_dir):
    return families.key_ranks(_words(spark, sf_dir), "p_partkey", "ord", "k").select("p_partkey", "ord", "w", "rank")


@query(_KEYS.format(by="encode(w)"))
def key_order_bytewise(spark, sf_dir):
    return families.key_ranks(_words(spark, sf_dir), "p_partkey", "ord", "k", "coreDeterministic").select("p_partkey", "ord", "w", "rank")


@query("SELECT p_partkey, string_agg(i, ',' ORDER BY strlen(w), encode(w), i) AS ordered FROM (SELECT p_partkey, unnest(string_split(p_name, ' ')) AS w, generate_subscripts(string_split(p_name, ' '), 1) - 1 AS i FROM part) GROUP BY 1")
def key_order_segments(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_partkey", F.transform(F.split("p_name", " "), lambda w: w.cast("binary")).alias("keys"))
    return families.canonical_key_order(p, "keys").select("p_partkey", F.array_join(F.transform("ordered", lambda i: i.cast("string")), ",").alias("ordered"))


_LAST = "SELECT doc_id, strlen(text) - 1 AS n, ascii(right(text, 1)) AS cp FROM documents WHERE strlen(text) > 0"


@query(f"SELECT doc_id, n::BIGINT AS byte_count, cp < 128 AS is_valid, CASE WHEN cp < 128 THEN NULL ELSE n - (CASE WHEN cp < 2048 THEN 1 WHEN cp < 65536 THEN 2 ELSE 3 END) END::BIGINT AS first_invalid_offset FROM ({_LAST})")
def utf8_validate_truncated(spark, sf_dir):
    """Texts without their last byte: invalid, at the last character's lead, where that has more than one."""
    d = text_bytes(spark, sf_dir).where(F.octet_length("b") > 0).select("doc_id", F.substring("b", F.lit(1), F.octet_length("b") - 1).alias("b"))
    return families.utf8_validate(d, "b").select("doc_id", "utf8.*")


@query("SELECT doc_id, 'u' || rtrim(translate(to_base64(encode(text)), '+/', '-_'), '=') AS multibase FROM documents")
def multibase_u(spark, sf_dir):
    return families.multibase_encode(text_bytes(spark, sf_dir), "b", "u").select("doc_id", "multibase")


@query("SELECT c_custkey, 'M' || rtrim(to_base64(encode(c_name)), '=') AS multibase FROM customer")
def multibase_m(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_name").cast("binary").alias("b"))
    return families.multibase_encode(c, "b", "M").select("c_custkey", "multibase")


@query("""WITH RECURSIVE r(k, v, s) AS (SELECT o_orderkey, o_orderkey, '' FROM orders UNION ALL SELECT k, v // 58, substr('123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz', (v % 58)::INTEGER + 1, 1) || s FROM r WHERE v > 0)
SELECT k AS o_orderkey, 'z' || repeat('1', CASE WHEN k = 0 THEN 8 WHEN k < 256 THEN 7 WHEN k < 65536 THEN 6 WHEN k < 16777216 THEN 5 WHEN k < 4294967296 THEN 4 ELSE 0 END) || s AS multibase FROM r WHERE v = 0""")
def multibase_z(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.unhex(F.lpad(F.hex("o_orderkey"), 16, "0")).alias("b"))
    return families.multibase_encode(o, "b", "z").select("o_orderkey", "multibase")


@query("SELECT doc_id, sha256(text) AS u_sha256, sha256(text) AS native_sha256, NULL::BIGINT AS first_error_offset FROM documents")
def multibase_roundtrip(spark, sf_dir):
    d = families.multibase_encode(text_bytes(spark, sf_dir), "b", "u")
    d = families.multibase_decode(d, "multibase").withColumn("native", expr.multibase_decode(F.col("multibase")))
    return d.select("doc_id", F.sha2("decoded.decoded", 256).alias("u_sha256"), F.sha2("native", 256).alias("native_sha256"), "decoded.first_error_offset")


_VARINT = " || ".join(f"CASE WHEN {i} = 0 OR (v >> {7 * i}) > 0 THEN printf('%02x', CASE WHEN (v >> {7 * (i + 1)}) > 0 THEN ((v >> {7 * i}) & 127) | 128 ELSE (v >> {7 * i}) & 127 END) ELSE '' END" for i in range(8))


@query(f"SELECT v AS o_orderkey, {_VARINT} AS varint FROM (SELECT o_orderkey AS v FROM orders)")
def varint_encode_orderkeys(spark, sf_dir):
    return families.varint_encode(table(spark, sf_dir, "orders"), "o_orderkey").select("o_orderkey", low_hex(F.col("varint")).alias("varint"))


@query("SELECT l_orderkey * 131 + l_linenumber AS v, l_orderkey * 131 + l_linenumber AS native, l_orderkey * 131 + l_linenumber AS kernel FROM lineitem")
def varint_roundtrip(spark, sf_dir):
    v = table(spark, sf_dir, "lineitem").select((F.col("l_orderkey") * 131 + F.col("l_linenumber")).alias("v"))
    v = families.varint_decode(families.varint_encode(v, "v"), "varint")
    return v.select("v", expr.varint_value(F.col("varint")).alias("native"), F.col("decoded.value").cast("long").alias("kernel"))


@query("SELECT c_custkey, n_name AS probe, CASE WHEN n_nationkey % 3 <> 0 THEN 32768 + n_nationkey END::BIGINT AS id FROM customer JOIN nation ON n_nationkey = c_nationkey")
def dictionary_probe_nation(spark, sf_dir):
    """A dictionary that lacks every third nation: misses stay, without an id."""
    nations = table(spark, sf_dir, "nation")
    d = Dictionary(7, typed={"ex:nation": {r["n_name"]: 32768 + r["n_nationkey"] for r in nations.where("n_nationkey % 3 <> 0").collect()}})  # 25 nations at any scale
    c = table(spark, sf_dir, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    found = families.dictionary_probe(c, F.lit("ex:nation"), expr.item(F.col("n_name"), nations.schema["n_name"].dataType), families.dictionary_frame(spark, d))
    return found.select("c_custkey", F.col("n_name").alias("probe"), "id")


@query("SELECT n_regionkey, n_nationkey, coalesce(sum(strlen(n_name)) OVER (PARTITION BY n_regionkey ORDER BY n_nationkey ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS span_offset, strlen(n_name)::BIGINT AS span_length FROM nation")
def packed_batch_spans(spark, sf_dir):
    s = families.packed_spans(table(spark, sf_dir, "nation"), "n_name", "n_nationkey", ["n_regionkey"])
    return s.select("n_regionkey", "n_nationkey", F.col("offset").alias("span_offset"), F.col("length").alias("span_length"))


_SCAN = ("byte_count", "is_valid", "first_error_offset", "max_depth", "item_count", "error_code")


@query(f"{ENVELOPES} SELECT doc_id, octet_length(c)::BIGINT AS byte_count, true AS is_valid, NULL::BIGINT AS first_error_offset, 3 AS max_depth, 14::BIGINT AS item_count, NULL::VARCHAR AS error_code FROM e")
def scan_valid_envelopes(spark, sf_dir):
    return families.structural_scan(envelopes(spark, sf_dir).select("doc_id", "c"), "c").select("doc_id", *[f"scan.{x}" for x in _SCAN])


@query(f"{ENVELOPES} SELECT doc_id, (octet_length(c) - 1)::BIGINT AS byte_count, false AS is_valid, (octet_length(c) - 1)::BIGINT AS first_error_offset, 'ERR_NOT_CBOR' AS error_code FROM e")
def scan_truncated_envelopes(spark, sf_dir):
    e = envelopes(spark, sf_dir).select("doc_id", F.substring("c", F.lit(1), F.octet_length("c") - 1).alias("c"))
    return families.structural_scan(e, "c").select("doc_id", *[f"scan.{x}" for x in ("byte_count", "is_valid", "first_error_offset", "error_code")])


@query("SELECT 'batched-sha256' AS family, 0::BIGINT AS contradictions UNION ALL SELECT 'byte-statistics', 0 UNION ALL SELECT 'utf8-validation', 0 UNION ALL SELECT 'unsigned-varint', count(*) FROM orders")
def acceptance_contradictions(spark, sf_dir):
    """Results held against their own consistency; those of the last family were spoilt on purpose."""
    d = text_bytes(spark, sf_dir)
    spoilt = families.varint_decode(families.varint_encode(table(spark, sf_dir, "orders"), "o_orderkey"), "varint").withColumn("decoded", F.struct(F.lit(None).cast("decimal(20,0)").alias("value"), "decoded.bytes_consumed", F.lit(None).cast("long").alias("first_error_offset"), F.lit(None).cast("string").alias("message")))
    made = {
        "batched-sha256": (families.batched_sha256(d, "b"), "sha256"),
        "byte-statistics": (families.byte_statistics(d, "b"), "stats"),
        "utf8-validation": (families.utf8_validate(d, "b"), "utf8"),
        "unsigned-varint": (spoilt, "decoded"),
    }
    counts = [families.contradictions(df, f, c).agg(F.count("*").alias("contradictions")).select(F.lit(f).alias("family"), "contradictions") for f, (df, c) in made.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out


_VALUES = lambda rows: ", ".join("(" + ", ".join(str(x).lower() if isinstance(x, bool) else str(x) if isinstance(x, int) else f"'{x}'" for x in r) + ")" for r in rows)
_FAMILIES = [(f"{f}.v1", p, f != "cddl-validation") for p, fs in families.FAMILIES.items() for f in fs]


@query(f"SELECT * FROM (VALUES {_VALUES(_FAMILIES)}) v(family, priority, available)")
def family_catalogue(spark, sf_dir):
    return families.catalogue(spark)


# --- scalars


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS literal, (epoch(o_orderdate::DATE))::BIGINT AS seconds FROM orders")
def date_literals(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("literal"))
    return o.withColumn("seconds", expr.date_seconds(F.col("literal")))


@query("SELECT page_id, CASE WHEN url LIKE 'https://%' THEN 2 WHEN url LIKE 'http://%' THEN 1 ELSE 0 END AS code, CASE WHEN url LIKE 'https://%' THEN substr(url, 9) WHEN url LIKE 'http://%' THEN substr(url, 8) ELSE url END AS rest FROM pages")
def url_scalars(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", expr.url_parts(F.col("url")).alias("u")).select("page_id", "u.*")


_MD5 = "md5(c_name)"


@query(f"SELECT c_custkey, {_MD5} AS packed, substr({_MD5}, 1, 8) || '-' || substr({_MD5}, 9, 4) || '-' || substr({_MD5}, 13, 4) || '-' || substr({_MD5}, 17, 4) || '-' || substr({_MD5}, 21) AS back FROM customer")
def uuid_scalars(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", expr.uuid_text(F.unhex(F.md5(F.col("c_name").cast("binary")))).alias("u"))
    return c.select("c_custkey", low_hex(expr.uuid_bytes(F.col("u"))).alias("packed"), expr.uuid_text(expr.uuid_bytes(F.col("u"))).alias("back"))


# --- integrity


@query(f"SELECT doc_id, sha256(unhex('{(b'CBOR-LD' + bytes(1) + b'structural-document' + bytes([0, 1])).hex()}') || {MAP}) AS fingerprint, true AS twin FROM documents")
def structural_fingerprint_documents(spark, sf_dir):
    d = integrity.structural_fingerprint(table(spark, sf_dir, "documents"), FIELDS)
    d = integrity.fingerprints(d.withColumn("json", F.to_json(F.struct(*FIELDS), {"ignoreNullFields": "false"})), "json", "arrow")
    return d.select("doc_id", "fingerprint", (F.col("arrow.value") == F.col("fingerprint")).alias("twin"))


def _tampered(spark, sf_dir):
    """Envelopes of which every seventh has its last bit turned, with the digest and fingerprint of the originals."""
    e = integrity.structural_fingerprint(envelopes(spark, sf_dir), FIELDS).withColumn("sha256", F.sha2("c", 256))
    last = F.conv(F.hex(F.substring("c", -1, 1)), 16, 10).cast("int").bitwiseXOR(1)
    turned = F.concat(F.substring("c", F.lit(1), F.octet_length("c") - 1), F.unhex(F.lpad(F.hex(last), 2, "0")))
    return e.select("doc_id", "sha256", "fingerprint", F.when(F.col("doc_id") % 7 == 0, turned).otherwise(F.col("c")).alias("c"))


@query("SELECT doc_id, CASE WHEN doc_id % 7 = 0 THEN 'mismatch' ELSE 'verified' END AS status FROM documents")
def verify_digest_mismatches(spark, sf_dir):
    return _tampered(spark, sf_dir).select("doc_id", integrity.verify_digest(F.col("c"), F.unhex("sha256")).alias("status"))


_T = "CASE WHEN doc_id % 7 = 0 THEN 'mismatch' ELSE 'verified' END"


_KINDS = [("envelope", "'verified'"), ("envelope-metadata", "'not-checked'"), ("format-support", "'verified'"), ("transport-digest", _T), ("document-dictionary", "'not-checked'"), ("context-document", "'not-checked'"), ("document-decoding", "'verified'"), ("structural-fingerprint", _T)]


@query("SELECT kind, status, count(*)::BIGINT AS n FROM (" + " UNION ALL ".join(f"SELECT '{k}' AS kind, {s} AS status FROM documents" for k, s in _KINDS) + ") GROUP BY 1, 2")
def verification_report_counts(spark, sf_dir):
    r = integrity.verification_report(_tampered(spark, sf_dir), "c", "sha256", expected_fingerprint="fingerprint")
    return r.select(F.explode("checks").alias("k")).groupBy("k.kind", "k.status").agg(F.count("*").alias("n"))


@query("SELECT doc_id, doc_id % 7 <> 0 AS valid, (CASE WHEN doc_id % 7 = 0 THEN 2 ELSE 0 END) AS n_problems FROM documents")
def manifest_reports(spark, sf_dir):
    """Manifests of the originals, structural fingerprints included, against the documents as they are now."""
    e = integrity.structural_fingerprint(envelopes(spark, sf_dir), FIELDS).select("doc_id", "c", "fingerprint")
    m = integrity.manifest(e, "doc_id", "c", structural="fingerprint").select("manifest")
    r = integrity.report_against(_tampered(spark, sf_dir).select("doc_id", "c"), m, "doc_id", "c")
    return r.select("doc_id", integrity.is_valid(F.col("checks")).alias("valid"), F.size(integrity.problems(F.col("checks"))).alias("n_problems"))


@query("SELECT doc_id, sha256(text) AS sha256 FROM documents")
def transport_digest_chunks(spark, sf_dir):
    """Texts in pieces of 1 KiB, digested as a whole again."""
    d = text_bytes(spark, sf_dir).select("doc_id", "b", F.posexplode(F.sequence(F.lit(0), F.greatest(F.octet_length("b") - 1, F.lit(0)), F.lit(1024))).alias("ord", "at"))
    pieces = d.select("doc_id", "ord", F.expr("substring(b, at + 1, 1024)").alias("piece"))
    return integrity.chunk_digest(pieces, "piece", "ord", ["doc_id"])


@query()
def transport_digest_512(spark, sf_dir):
    d = integrity.transport_digest(text_bytes(spark, sf_dir), "b", "sha512")
    return d.select("doc_id", expr.digest_text("sha512", "transport", 1, F.col("digest.bytes")).alias("digest"))


@query("SELECT lang AS fixture, bool_and(true) AS all_decoded, count(DISTINCT sha256(text)) = 1 AS same_bytes, sum(1)::BIGINT AS arrow, sum(1)::BIGINT AS native FROM documents GROUP BY lang")
def cross_decode_matrix(spark, sf_dir):
    """Two encoders of every document, by language: both decode; bytes agree where a language has one text."""
    d = table(spark, sf_dir, "documents")
    native = codec.encode_columns(d, ["text"]).select("lang", "text", F.lit("native").alias("encoder"), F.col("encoded").alias("c"))
    arrow = codec.encode_typed(d, ["text"]).select("lang", "text", F.lit("arrow").alias("encoder"), F.col("encoded.value").alias("c"))
    both = codec.decode_typed(native.unionByName(arrow), "c", "text string")
    results = both.select(F.col("lang").alias("fixture"), "encoder", F.hex("c").alias("hex"), (F.col("row.text") == F.col("text")).alias("passed"))
    return integrity.cross_decode_matrix(results.withColumn("hex", F.sha2("hex", 256)))


# --- tables, policies, lanes


@query("SELECT CASE WHEN c_nationkey % 5 = 0 THEN 7 ELSE c_nationkey END::BIGINT AS id, count(DISTINCT c_nationkey)::BIGINT AS n_values FROM customer GROUP BY 1 HAVING count(DISTINCT c_nationkey) > 1")
def dictionary_conflicts(spark, sf_dir):
    """Ids that a dictionary frame gives to more than one value: what a dictionary must not have."""
    c = table(spark, sf_dir, "customer").select(F.lit("ex:n").alias("dict_table"), F.col("c_nationkey").alias("value"), F.when(F.col("c_nationkey") % 5 == 0, F.lit(7)).otherwise(F.col("c_nationkey")).cast("long").alias("id"))
    return families.dictionary_conflicts(c).select("id", "n_values")


_TABLES = [("keyword", tables.KEYWORDS), ("context", tables.LEGACY_CONTEXTS), ("cryptosuite", tables.CRYPTOSUITES), ("scheme", tables.SCHEMES)]


@query("SELECT dict_table, value, id::BIGINT AS id FROM (VALUES " + _VALUES([(t, v, i) for t, ids in _TABLES for v, i in ids.items()]) + ") v(dict_table, value, id)")
def builtin_tables(spark, sf_dir):
    return families.builtin_tables(spark)


@query(f"{ENVELOPES} SELECT CASE WHEN doc_id % 3 = 0 THEN 'non-preferred-integer' ELSE 'none' END AS violation, count(*)::BIGINT AS n, max(CASE WHEN doc_id % 3 = 0 THEN 4 END)::BIGINT AS byte_offset FROM e GROUP BY 1")
def policy_breaches(spark, sf_dir):
    """Every third envelope has its registry id in a wider form than needed; the strict policy says so and where."""
    from ..kernels.cbor import Policy

    e = envelopes(spark, sf_dir)
    wide = F.concat(expr.raw(bytes.fromhex("d9cb1d821800")), F.expr("substring(c, 6)"))
    e = e.select(F.when(F.col("doc_id") % 3 == 0, wide).otherwise(F.col("c")).alias("c"))
    d = codec.decode_json(e, "c", Config(policy=Policy(reject_integer_widths=True, reject_length_widths=True)))
    return d.groupBy(F.coalesce("decoded.failure.violation", F.lit("none")).alias("violation")).agg(F.count("*").alias("n"), F.max("decoded.failure.byte_offset").alias("byte_offset"))


@query("SELECT event_type, min(value) AS min_ns, quantile_cont(value, 0.5) AS median_ns, quantile_cont(value, 0.95) AS p95_ns FROM events GROUP BY 1")
def lane_timings(spark, sf_dir):
    return integrity.lane_timing(table(spark, sf_dir, "events"), ["event_type"], "value")


@query("SELECT a.n_name AS lane, CASE WHEN (a.n_nationkey + 1) / 13 > 1.05 THEN 'win' WHEN (a.n_nationkey + 1) / 13 < 0.95 THEN 'loss' ELSE 'wash' END AS verdict FROM nation a")
def lane_comparison(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    return n.select(F.col("n_name").alias("lane"), integrity.compared((F.col("n_nationkey") + 1) / 13).alias("verdict"))


@query("SELECT customer.c_custkey, CASE WHEN c_nationkey % 2 = 0 THEN NULL ELSE 'ERR_NOT_CBORLD' END AS code, CASE WHEN c_nationkey % 2 = 0 THEN c_custkey END AS back FROM customer")
def legacy_formats(spark, sf_dir):
    """Legacy-range envelopes of customers, decoded where the format is enabled; odd nations are cut short."""
    from ..kernels.envelope import RANGE

    config = Config(format=RANGE)
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey", F.to_json(F.struct("c_custkey", "c_name")).alias("j"))
    e = codec.encode_json(c, "j", config, "e").withColumn("b", F.col("e.value"))
    e = e.withColumn("b", F.when(F.col("c_nationkey") % 2 == 0, F.col("b")).otherwise(F.substring("b", F.lit(1), F.octet_length("b") - 1)))
    d = codec.decode_json(e.select("c_custkey", "b"), "b", config)
    return d.select("c_custkey", F.col("decoded.failure.code").alias("code"), F.from_json("decoded.value", "c_custkey long")["c_custkey"].alias("back"))


@query("SELECT doc_id, false AS truncated, 14::BIGINT AS n_nodes FROM documents")
def lossless_and_decoded(spark, sf_dir):
    """Source maps and values of the same documents under one policy."""
    e = envelopes(spark, sf_dir).select("doc_id", "c")
    v = codec.validate_lossless(codec.decode_validated(e, "c", Config()), "c")
    return v.select("doc_id", "validated.value.truncated", F.col("decoded.value.nodes").alias("n_nodes"))


from . import coverage  # noqa: E402, F401  (adds its queries to this catalogue)
