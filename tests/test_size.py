"""What must not grow with the rows of a table: objects held at once, contexts defined, tasks left out, evaluations of a column."""

import json
import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tessera.errors import CodecError
from tessera.functions import arrow, expr
from tessera.kernels import cbor, envelope
from tessera.kernels.cbor import STRICT, Limits, Policy
from tessera.kernels.envelope import Config
from tessera.kernels.semantic import Session
from tessera.operators import codec, families, integrity

CONTEXTS = {
    "urn:base": {"@context": {"z": "urn:z", "b": {"@id": "urn:b", "@context": {"b": "urn:bb", "inner": "urn:inner"}}}},
    "urn:more": {"@context": {"@import": "urn:base", "a": "urn:a", "Kind": {"@id": "urn:Kind", "@context": {"k": "urn:k"}}}},
}
DOCUMENTS = [
    {"@context": "urn:base", "z": 1, "b": {"b": "x", "inner": 2}},
    {"@context": ["urn:base", "urn:more"], "a": 1, "z": "y", "b": {"inner": [1, 2]}},
    {"@context": "urn:more", "@type": "Kind", "a": 1, "k": {"z": 2}, "b": {"b": "x"}},
    {"@context": {"q": "urn:q", "b": "urn:b"}, "q": "x", "b": 3},
]


def test_contexts_are_defined_once_for_all_documents(monkeypatch):
    """scoped_contexts and the queries beside it."""
    defined, define = [], Session.define
    monkeypatch.setattr(Session, "define", lambda self, c: defined.append(1) or define(self, c))
    config = Config(registry_id=1, contexts=CONTEXTS)
    for _ in range(3):
        for d in DOCUMENTS:
            assert envelope.decode(envelope.encode(d, config), config) == d
        first = len(defined) if _ == 0 else first
    assert len(defined) == first


def test_shared_contexts_leave_ids_as_they_are():
    for seed in range(20):
        config, order = Config(registry_id=1, contexts=CONTEXTS), random.Random(seed).choices(DOCUMENTS, k=12)
        for d in order:
            assert envelope.encode(d, config) == envelope.encode(d, Config(registry_id=1, contexts=CONTEXTS))


def test_narrow_rows_of_a_small_file_are_many_tasks(spark, tmp_path):
    """one row group is one task of a scan."""
    path = str(tmp_path / "t.parquet")
    spark.range(0, 200_000, 1, 1).write.parquet(path)
    made = arrow.with_kernel(spark.read.parquet(path), "k", "long", ["id"], lambda n: n + 1)
    assert made.rdd.getNumPartitions() > 4
    assert made.agg(F.count("*"), F.sum(F.col("k") - F.col("id"))).first()[:] == (200_000, 200_000)
    again = arrow.with_kernel(made, "l", "long", ["k"], lambda n: n + 1)
    assert again._jdf.queryExecution().optimizedPlan().toString().count("Repartition") == 1


def test_a_worker_holds_a_slice_of_a_batch(spark):
    """F3, F4, F8, F9, F11: results of a whole batch were held as Python objects at once."""
    live = [0]

    class Held(dict):
        def __init__(self):
            live[0] += 1
            super().__init__(n=live[0])

        def __del__(self):
            live[0] -= 1

    made = arrow.with_kernel(spark.range(0, 9000, 1, 1), "k", "struct<n: long>", ["id"], lambda n: Held())
    assert made.agg(F.max("k.n")).first()[0] <= 2 * arrow.SLICE


def test_slices_keep_to_bytes_and_rows():
    b = pa.RecordBatch.from_arrays([pa.array(range(5000)), pa.array(["x" * (3 << 20 if i == 7 else 1000) for i in range(5000)])], names=["i", "t"])
    parts = list(arrow.sliced(iter([b]), [1]))
    assert pa.Table.from_batches(parts).equals(pa.Table.from_batches([b]))
    assert all(p.num_rows <= arrow.SLICE for p in parts) and all(p.num_rows == 1 or len("".join(p.column(1).to_pylist())) <= arrow.SLICE_BYTES for p in parts)
    assert list(arrow.sliced(iter([b.slice(0, 0)]), [1])) == []


def test_a_native_decoder_reads_its_table_once(spark, tmp_path):
    """the table was read, and its columns made, once for sound rows and once for the others."""
    path = str(tmp_path / "t.parquet")
    spark.range(100).write.parquet(path)
    v = spark.read.parquet(path).select("id", expr.varint(F.col("id")).alias("v"), expr.multibase(F.col("id").cast("string"), "u").alias("m"))
    for d in (families.varint_decode(v, "v"), families.multibase_decode(v, "m")):
        assert d._jdf.queryExecution().optimizedPlan().collectLeaves().size() == 1
        assert d.columns == ["id", "v", "m", "decoded"]


def test_varint_values_by_byte(spark):
    def value(b):
        fine = 0 < len(b) <= 9 and all(x >= 128 for x in b[:-1]) and b[-1] < 128
        return sum((x & 127) << 7 * i for i, x in enumerate(b)) if fine else None

    r = random.Random(0)
    rows = [b"", b"\x00", b"\x80", b"\x80\x00", b"\xff" * 8 + b"\x7f", b"\xff" * 9 + b"\x01", b"\xff" * 9, None]
    rows += [bytes(r.choice((0, 1, 127, 128, 255)) for _ in range(r.randrange(12))) for _ in range(400)]
    rows += [bytes([r.randrange(128, 256) for _ in range(n)] + [r.randrange(128)]) for n in range(10) for _ in range(10)]
    got = spark.createDataFrame([(None if b is None else bytearray(b),) for b in rows], "b binary").select("b", expr.varint_value(F.col("b")).alias("v")).collect()
    assert len(got) == len(rows) and all(x["v"] == (None if x["b"] is None else value(bytes(x["b"]))) for x in got)


@pytest.mark.parametrize("policy", [Policy(), STRICT, Policy(True, True), Policy(allow_reserved_simple=True)])
@pytest.mark.parametrize("limits", [Limits(), Limits(depth=2), Limits(items=2), Limits(reject_duplicate_keys=True), Limits(input_bytes=20)])
def test_plain_reader_and_walk_agree(policy, limits):
    def result(f):
        try:
            return repr(f())
        except CodecError as e:
            return e.code, e.message, e.offset, e.end, e.violation, e.place and (e.place.path, e.place.json_path)

    r = random.Random(3)
    seeds = [cbor.encode(cbor.from_json(json.loads(s))) for s in ('{"a":[1,-300,1.5,0.1,null,true],"b":{"c":"é","d":70000}}', '[[[[1]]]]', '{"a":1,"b":-5000000000}', '"x"')]
    seeds += [bytes.fromhex(h) for h in ("1800", "d9cb1d820043ffffff", "f0", "f97e00", "9f01ff", "a2616101616102", "3bffffffffffffffff", "")]
    for _ in range(300):
        b = bytearray(r.choice(seeds))
        for _ in range(r.randrange(3)):
            b[r.randrange(len(b) + 1) : r.randrange(len(b) + 1)] = bytes([r.randrange(256)])
        b = bytes(b)
        assert result(lambda: cbor.decode(b, limits, policy)) == result(lambda: cbor.Reader(b, limits, policy).read().value)


def test_sql_functions_take_slices(spark):
    """results of a whole batch were held as Python objects, and once more in pandas."""
    from tessera.functions import sql

    live, most = [0], [0]

    class Held(str):
        def __new__(cls, x):
            live[0] += 1
            most[0] = max(most[0], live[0])
            return super().__new__(cls, x)

        def __del__(self):
            live[0] -= 1

    over = sql.batched(lambda s: Held(s + "!"), "string").func
    made = over(pa.array([None, *map(str, range(8999))]))
    assert made.field("value").to_pylist() == [None, *(f"{i}!" for i in range(8999))] and most[0] <= 2 * arrow.SLICE


def test_manifests_are_not_collected_on_the_driver(spark, tmp_path):
    """manifest_pins. Spark estimates a kernel's rows from the size of the file, and broadcast a manifest for each of them."""
    path = str(tmp_path / "t.parquet")
    spark.range(0, 300, 1, 1).select("id", F.to_json(F.struct("id")).alias("j")).write.parquet(path)
    e = codec.encode_json(spark.read.parquet(path), "j", name="e").select("id", F.col("e.value").alias("c"))
    m = integrity.manifest(e, "id", "c").select("id", "manifest")
    wrong = F.when(F.col("id") % 3 == 1, F.col("manifest").withField("transport_sha256", F.lit("0"))).otherwise(F.col("manifest"))
    r = integrity.report_against(e, m.filter("id % 3 > 0").select(wrong.alias("manifest")), "id", "c")
    assert r.columns == ["id", "c", "checks"]
    rows = r.collect()
    assert "Broadcast" not in r._jdf.queryExecution().executedPlan().toString()
    ends = {0: ("unavailable", "not-checked"), 1: ("invalid", "not-checked"), 2: ("verified", "verified")}
    for x in rows:
        found = {c["kind"]: c["status"] for c in x["checks"]}
        assert (found["manifest"], found["transport-digest"]) == ends[x["id"] % 3]
    assert len(rows) == 300
