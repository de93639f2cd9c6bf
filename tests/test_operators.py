"""Operators over small frames: native and Arrow forms agree, failures are rows, plans are what they should be."""

import os

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from tessera.errors import CodecError
from tessera.functions import expr
from tessera.kernels import cbor, text
from tessera.kernels.envelope import Config
from tessera.kernels.tables import Dictionary
from tessera.operators import codec, families, integrity
from tessera.plans import catalogue
from tessera.sources import binary
from tessera.streaming import decode as streams


def hexes(spark, *rows):
    return spark.createDataFrame([(i, None if r is None else bytearray.fromhex(r)) for i, r in enumerate(rows)], "i long, b binary")


def column(df, c, order="i"):
    return [r[0] for r in df.orderBy(order).select(c).collect()]


def test_entry_runs(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


@pytest.mark.parametrize("name", sorted(catalogue.SQL))
def test_query_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    d = "/root/testdata/sf0.001"
    if not os.path.isdir(d):
        pytest.skip("no test tables")
    con = duckdb.connect()
    for t in ("nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "pages", "benchmark"):
        con.sql(f"create view {t} as select * from '{d}/{t}.parquet'")
    got, want = catalogue.QUERIES[name](spark, d).toPandas(), con.sql(catalogue.SQL[name]).df()
    cols = sorted(got.columns)
    assert cols == sorted(want.columns)
    key = lambda x: sorted(map(str, x[cols].astype(object).where(x[cols].notna(), None).itertuples(index=False, name=None)))
    norm = lambda rows: [r.replace(".0,", ",").replace(".0)", ")") for r in rows]
    assert norm(key(got)) == norm(key(want))


def test_native_and_arrow_encoders_agree(spark):
    rows = [(1, None, True, [1, -5, None], ("x", 2**40)), (-7, "é\"\n", False, [], (None, 0)), (2**62, "a" * 300, None, None, None)]
    df = spark.createDataFrame(rows, "n long, s string, f boolean, a array<long>, o struct<k: string, v: long>")
    cols = df.columns
    both = codec.encode_typed(codec.encode_columns(df, cols, "native"), cols, name="arrow")
    assert all(r["native"] == r["arrow"]["value"] for r in both.collect())
    plan = codec.encode_columns(df, cols)._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Arrow" not in plan
    with pytest.raises(TypeError):
        expr.item(F.lit(1.5), spark.createDataFrame([(1.5,)], "d double").schema["d"].dataType)


def test_families_on_golden_rows(spark):
    d = spark.createDataFrame([(0, b"", b""), (1, b"abc", b"axc"), (2, b"ab", b"abcd"), (3, b"a", b"bcd")], "i long, l binary, r binary")
    for f in (families.byte_diff, families.byte_diff_large):
        assert [(r[2], r[3]) for r in column(f(d, "l", "r"), "diff")] == [(0, None), (1, 1), (2, 2), (3, 0)]
    s = column(families.byte_statistics(hexes(spark, "000101ff", "", None), "b"), "stats")
    assert (s[0]["entropy"], s[1]["entropy"], s[2]) == (1.5, 0.0, None)
    k = spark.createDataFrame([(0, [bytearray.fromhex(x) for x in ("1864", "20", "20")]), (1, [])], "i long, k array<binary>")
    assert column(families.canonical_key_order(k, "k"), "ordered") == [[1, 2, 0], []]
    assert column(families.canonical_key_order(k, "k", "coreDeterministic"), "ordered") == [[0, 1, 2], []]
    u = column(families.utf8_validate(hexes(spark, "c080", "eda080", "f4908080", "80", "e282", "61", "", None), "b"), "utf8.first_invalid_offset")
    assert u == [0, 1, 1, 0, 0, None, None, None]


def test_varints_native_and_kernel(spark):
    values = [0, 1, 127, 128, 300, 2**32, 2**56 - 1, 2**62, 2**63 - 1]
    df = spark.createDataFrame(list(enumerate(values)), "i long, n long")
    done = families.varint_decode(families.varint_encode(df, "n"), "varint")
    assert column(done, "varint") == [text.varint_encode(n) for n in values]
    assert column(done, "decoded.value") == values
    assert column(done.select("i", expr.varint_value(F.col("varint")).alias("v")), "v") == values
    import decimal

    big = spark.createDataFrame([(0, decimal.Decimal(2**64 - 1))], "i long, n decimal(20,0)")
    assert column(families.varint_decode(families.varint_encode(big, "n"), "varint"), "decoded.value") == [2**64 - 1]


def test_scans_and_overflow(spark):
    df = spark.createDataFrame([(i, i * 3 % 7, i % 2) for i in range(50)], "o long, n long, g long")
    want, total = {}, 0
    for i in range(50):
        want[i], total = total, total + i * 3 % 7
    got = {r["o"]: int(r["s"]) for r in families.exclusive_scan(df, "n", "o", "s").collect()}
    assert got == want
    big = spark.createDataFrame([(0, 2**32 - 1), (1, 0)], "o long, n long")
    assert [int(x) for x in column(families.exclusive_scan(big, "n", "o", "s", 32), "s", "o")] == [0, 2**32 - 1]
    with pytest.raises(Exception, match="ERR_INTEGER_OVERFLOW"):
        families.exclusive_scan(big.unionByName(spark.createDataFrame([(2, 1)], "o long, n long")), "n", "o", "s", 32).collect()
    assert families.exclusive_scan(df.where("false"), "n", "o", "s").count() == 0


def test_compaction_round_trip(spark):
    df = spark.createDataFrame([(0, b"ab"), (1, b""), (2, b"c")], "o long, b binary").withColumn("g", F.lit(1))
    c = families.compact(df, "b", "o", ["g"])
    assert [tuple(r) for r in c.select("bytes", "offsets").collect()] == [(b"abc", [0, 2, 2, 3])]
    assert column(families.unpack(c), "slice", "ordinal") == [b"ab", b"", b"c"]


def test_multibase_forms(spark):
    df = hexes(spark, "", "00", "0000010203", "fbff", "00112233445566778899aabbccddeeff")
    for kind in "uMz":
        done = families.multibase_decode(families.multibase_encode(df, "b", kind), "multibase")
        assert column(done, "decoded.decoded") == column(df, "b")
        assert column(done, "multibase") == [text.multibase_encode(bytes(b), kind) for b in column(df, "b")]
    bad = spark.createDataFrame([(0, "uA"), (1, "xabc"), (2, "u+"), (3, None)], "i long, s string")
    assert column(bad.select("i", expr.multibase_decode(F.col("s")).alias("b")), "b") == [None] * 4


def test_probe_keeps_misses(spark):
    d = families.dictionary_frame(spark, Dictionary(7, typed={"t": {"a": 5}}, untyped={"a": 6}))
    p = spark.createDataFrame([(0, "t", "a"), (1, "none", "a"), (2, "t", "b"), (3, None, None)], "i long, t string, v string")
    got = families.dictionary_probe(p, F.col("t"), expr.item(F.col("v"), p.schema["v"].dataType), d)
    assert column(got, "id") == [5, 6, None, None]


def test_acceptance(spark):
    s = families.structural_scan(hexes(spark, "a0", "61ff", "f0"), "b")
    assert families.contradictions(s, "cbor-structural-scan", "scan").count() == 0
    assert families.accepted(s, "cbor-structural-scan", "scan").collect() == s.collect()
    wrong = s.withColumn("scan", F.col("scan").withField("is_valid", F.lit(True)))
    assert families.contradictions(wrong, "cbor-structural-scan", "scan").count() == 1
    with pytest.raises(Exception, match="ERR_INVALID_COMPUTE_OUTPUT"):
        families.accepted(wrong, "cbor-structural-scan", "scan").collect()
    with pytest.raises(CodecError, match="oracle"):
        families.cddl_validate(s, "b", "any")


def test_failures_stay_with_their_rows(spark):
    df = hexes(spark, "d9cb1d820000", "d9cb1d820001", "ff", None, "d9cb1d8200a1616101")
    out = column(codec.decode_json(df, "b"), "decoded")
    assert [o and (o["value"], o["failure"] and o["failure"]["code"]) for o in out] == [("0", None), ("1", None), (None, "ERR_NOT_CBORLD"), None, ('{"a":1}', None)]
    assert out[0]["observation"]["input_bytes"] == 6
    with pytest.raises(CodecError) as e:
        codec.batch_guard(df, "b", documents=2)
    assert e.value.code == "ERR_BATCH_LIMIT"


def test_lossless_rows(spark):
    df = hexes(spark, "d9cb1d82009f01ff", "d9cb1d8200e0", "d9cb1d8200850001020304")
    v = column(codec.validate_lossless(df, "b", limits=cbor.Limits(nodes=2)), "validated.value")
    assert [len(x["nodes"]) for x in v] == [2, 2, 2] and all(x["truncated"] for x in v)
    rows = codec.node_rows(df.where("i = 0"), "b").orderBy("ordinal").collect()
    assert [bytes(r["node_bytes"]).hex() for r in rows] == ["d9cb1d82009f01ff", "82009f01ff", "00", "9f01ff", "01"]
    assert [r["node"]["indefinite"] for r in rows] == [False, False, False, True, False]


def test_pins_guard_whole_documents(spark):
    ctx = {"urn:c": {"@context": {"x": "ex:x"}}}
    d = Dictionary(2, contexts={"urn:c": 0x8000})
    config = codec.with_dictionary(d, ctx)
    df = spark.createDataFrame([('{"@context": "urn:c", "x": "1"}',)], "j string")
    pins, pin = {"urn:c": integrity.context_fingerprint(ctx["urn:c"])}, integrity.dictionary_fingerprint(2, d.tables())
    assert codec.whole_document(df, "j", config, pins, pin, "encode").first()["document"]["failure"] is None
    for kw, code in (({"pins": {}, "dictionary_pin": pin}, "ERR_UNPINNED_CONTEXT"), ({"pins": pins}, "ERR_UNPINNED_DICTIONARY"), ({"pins": {"urn:c": "0"}, "dictionary_pin": pin}, "ERR_INTEGRITY_MISMATCH")):
        with pytest.raises(CodecError) as e:
            codec.whole_document(df, "j", config, operation="encode", **kw)
        assert e.value.code == code
    with pytest.raises(CodecError):
        codec.with_dictionaries([d, d])


def test_reports(spark):
    df = hexes(spark, "d9cb1d8200a0", "ff").withColumn("want", F.sha2("b", 256))
    r = integrity.verification_report(df, "b", "want")
    status = [[c["status"] for c in checks] for checks in column(r, "checks")]
    assert status[0] == ["verified", "not-checked", "verified", "verified", "not-checked", "not-checked", "verified", "not-checked"]
    assert status[1] == ["invalid", "not-checked", "unavailable", "verified", "unavailable", "not-checked", "unavailable", "not-checked"]
    assert [c["kind"] for c in column(r, "checks")[0]] == list(integrity.KINDS[1:])
    assert column(r.select("i", integrity.is_valid(F.col("checks")).alias("ok")), "ok") == [True, False]
    gated = integrity.verification_report(df, "b", config=Config(contexts={"urn:c": {"@context": {}}}), context_pins={"urn:c": "0"})
    assert column(gated, "checks")[0][6]["status"] == "unavailable"
    missing = integrity.verification_report(df, "b", context_pins={"urn:gone": "0"})
    assert column(missing, "checks")[0][5]["status"] == "unavailable" and not column(missing.select("i", integrity.is_valid(F.col("checks")).alias("ok")), "ok")[0]


FAULTY = {
    "batched-sha256": ("struct<digest: binary, state_words: array<bigint>>", [(b"x", [1]), (None, None)]),
    "byte-diff": ("struct<left_bytes: bigint, right_bytes: bigint, mismatches: bigint, first_mismatch: bigint>", [(3, 3, None, 0), (3, 3, 0, 1), (3, 5, 1, 3), (3, 3, 1, 3)]),
    "uint-prefix-scan": ("struct<values: array<bigint>, offsets: array<bigint>, total: bigint>", [([1, 2], [0, 2], 3), ([1], [1], 2), ([1], [0], 2), ([1], [0], None)]),
    "byte-compaction": ("struct<bytes: binary, offsets: array<bigint>>", [(b"abc", [0, 2, 1, 3]), (b"abc", [1, 3]), (b"abc", [0, 2]), (b"abc", None)]),
    "canonical-key-ordering": ("array<int>", [[0, 0], [1, 2]]),
    "utf8-validation": ("struct<byte_count: bigint, is_valid: boolean, first_invalid_offset: bigint>", [(3, True, 1), (3, False, 3), (None, True, None)]),
    "multibase-encode": ("string", ["", "xA"]),
    "varint-encode": ("binary", [b"", b"\x80", b"\xff" * 11]),
    "unsigned-varint": ("struct<value: decimal(20,0), bytes_consumed: bigint, first_error_offset: bigint>", [(None, 1, None)]),
    "dictionary-probe": ("struct<probes: int, hits: int, ids: array<bigint>>", [(2, 1, [1]), (2, 2, [1, None]), (1, 1, [-1])]),
    "cddl-validation": ("struct<is_valid: boolean, messages: array<string>>", [(True, ["x"]), (False, []), (None, [])]),
    "packed-batch": ("struct<offset: bigint, length: bigint, total: bigint>", [(2, 2, 3), (0, 1, None), (-1, 1, 3)]),
    "whole-document-transform": ("struct<value: string, failure: struct<code: string>>", [(None, None), ("a", ("ERR_X",)), (None, (None,))]),
}
SOUND = {
    "uint-prefix-scan": [([1, 2], [0, 1], 3), ([], [], 0)], "byte-compaction": [(b"abc", [0, 2, 3]), (b"", [0])], "canonical-key-ordering": [[1, 0], []],
    "multibase-encode": ["uA"], "varint-encode": [b"\x01"], "dictionary-probe": [(2, 1, [1, None]), (0, 0, [])], "cddl-validation": [(True, []), (False, ["x"])],
    "packed-batch": [(0, 3, 3), (3, 0, 3)], "whole-document-transform": [("a", None), (None, ("ERR_X",))], "byte-diff": [(3, 3, 0, None), (3, 5, 2, 3)],
}


@pytest.mark.parametrize("family", FAULTY)
def test_contradictions_of_each_family(spark, family):
    kind, wrong = FAULTY[family]
    frame = lambda rows: spark.createDataFrame([(i, r) for i, r in enumerate(rows)], f"i int, c {kind}")
    assert families.contradictions(frame([*wrong, None]), family, "c").count() == len(wrong) + 1
    assert families.contradictions(frame(SOUND.get(family, [])), family, "c").count() == 0


def test_cddl_outcomes(spark):
    df = spark.createDataFrame([(0, b"ok"), (1, b"bad"), (2, b"boom"), (3, b"odd"), (4, None)], "i long, b binary")

    def oracle(schema, b):
        if b == b"boom":
            raise KeyError("boom")
        return (b in (b"ok", b"odd"), ["no"] * 200 if b == b"bad" else ["?"] if b == b"odd" else [])

    got = column(families.cddl_validate(df, "b", "any", oracle), "cddl")
    assert got[0]["value"]["is_valid"] and not got[1]["value"]["is_valid"] and len(got[1]["value"]["messages"]) == 100 and got[1]["value"]["truncated"]
    assert [got[i]["failure"]["code"] for i in (2, 3)] == ["ERR_INVALID_COMPUTE_OUTPUT"] * 2 and got[4] is None


def test_manifests_hold_all_their_pins(spark):
    ctx = {"urn:c": {"@context": {"x": "urn:x"}}}
    config = codec.with_dictionary(Dictionary(2, typed={"t": {"1": 5}}), ctx)
    df = codec.encode_json(spark.createDataFrame([(0, '{"@context": "urn:c", "x": "1"}')], "i long, j string"), "j", config, "e").select("i", F.col("e.value").alias("b"))
    m = integrity.manifest(df, "i", "b", contexts=ctx, dictionary=(2, config.tables[2]))
    run = lambda frame, how: {c["kind"]: c["status"] for c in integrity.report_against(df, frame, "i", "b", how).first()["checks"]}
    assert set(run(m, config).values()) == {"verified", "not-checked"}
    other = codec.with_dictionary(Dictionary(2, typed={"t": {"1": 6}}), ctx)
    assert run(m, other)["document-dictionary"] == "mismatch" and run(m, other)["document-decoding"] == "unavailable"
    assert run(m, codec.with_dictionary(Dictionary(2, typed={"t": {"1": 5}})))["context-document"] == "unavailable"
    wrong = m.withColumn("manifest", F.col("manifest").withField("envelope.byte_count", F.lit(1).cast("long")))
    assert run(wrong, config)["envelope-metadata"] == "mismatch"
    bad = m.withColumn("manifest", F.col("manifest").withField("transport_sha256", F.lit("xyz")))
    checks = integrity.report_against(df, bad, "i", "b", config).first()["checks"]
    assert (checks[0]["status"], checks[0]["message"]) == ("invalid", "ERR_INVALID_MANIFEST")


def test_pins_and_legacy_contexts(spark):
    d = Dictionary(7, typed={"t": {"a": 5}})
    pin = integrity.dictionary_fingerprint(7, d.tables())
    assert families.pinned_dictionary(spark, d, pin).count() == 1
    for p, code in ((None, "ERR_UNPINNED_DICTIONARY"), ("0", "ERR_INTEGRITY_MISMATCH")):
        with pytest.raises(CodecError) as e:
            families.pinned_dictionary(spark, d, p)
        assert e.value.code == code
    config = codec.with_legacy_contexts({"urn:app": 40_000}, Config(registry_id=1, contexts={"urn:app": {"@context": {"x": "urn:x"}}}))
    df = codec.encode_json(spark.createDataFrame([(0, '{"@context": "urn:app", "x": 1}')], "i long, j string"), "j", config, "e").withColumn("b", F.col("e.value"))
    assert b"urn:app" not in bytes(df.first()["b"]) and "urn:app" in codec.decode_json(df, "b", config).first()["decoded"]["value"]
    with pytest.raises(CodecError):
        codec.with_legacy_contexts({"urn:app": 16})


def test_digest_of_known_answers(spark):
    df = spark.createDataFrame([(0, b""), (1, b"abc")], "i long, b binary")
    words = column(families.batched_sha256(df, "b"), "sha256.state_words")
    assert words[1][0] == 0xBA7816BF and words[0][7] == 0x7852B855
    assert column(integrity.transport_digest(df, "b", "sha384"), "digest.bytes")[1].hex().startswith("cb00753f45a35e8b")
    with pytest.raises(CodecError):
        integrity.transport_digest(df, "b", "md5")


def test_files(spark, tmp_path):
    (tmp_path / "a.bin").write_bytes(b"abc")
    (tmp_path / "b.bin").write_bytes(b"x")
    want = spark.createDataFrame([("a.bin", "ba7816bf8f01cfea414140de5dae2223b00361a396177a9cb410ff61f20015ad"), ("b.bin", "0"), ("c.bin", "0")], "name string, sha256 string")
    got = {r["name"]: r["status"] for r in binary.verify_files(spark, str(tmp_path), want).collect()}
    assert got == {"a.bin": "verified", "b.bin": "mismatch", "c.bin": "missing"}


def test_streams(spark, tmp_path):
    hexes(spark, "d9cb1d8200a0", "ff").write.parquet(str(tmp_path / "in"))
    s = streams.read_documents(spark, str(tmp_path / "in"), "i long, b binary")
    q = streams.write_guarded(streams.decode_stream(s, "b"), "b", str(tmp_path / "out"), str(tmp_path / "state"))
    q.awaitTermination()
    assert sorted(str(r["decoded"]["value"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()) == ["None", "{}"]
    q = streams.write_guarded(streams.read_documents(spark, str(tmp_path / "in"), "i long, b binary"), "b", str(tmp_path / "o2"), str(tmp_path / "s2"), documents=1)
    with pytest.raises(Exception, match="ERR_BATCH_LIMIT|batch limits"):
        q.awaitTermination()


def test_contexts_come_from_documents_or_a_fallback_and_keep_their_pins():
    doc = {"@context": {"v": "urn:v"}}
    pin = integrity.context_fingerprint(doc)
    assert codec.resolve_contexts(["a", "b"], {"a": doc}, {"b": pin}, lambda url: doc) == {"a": doc, "b": doc}
    for wrong, code in (({"documents": {}}, "ERR_UNKNOWN_CONTEXT"), ({"documents": {"a": doc}, "pins": {"a": "0" * 64}}, "ERR_INTEGRITY_MISMATCH")):
        with pytest.raises(CodecError) as e:
            codec.resolve_contexts(["a"], **wrong)
        assert e.value.code == code


def test_whole_documents_take_the_input_of_their_operation(spark):
    df = spark.createDataFrame([('{"a": 1}', bytearray(b"x"))], "j string, b binary")
    for data, operation in (("b", "encode"), ("j", "decode"), ("j", "other")):
        with pytest.raises(CodecError):
            codec.whole_document(df, data, Config(), operation=operation)
    small = Config(limits=cbor.Limits(input_bytes=4))
    assert codec.whole_document(df, "j", small, operation="encode").first()["document"]["failure"]["code"] == "ERR_RESOURCE_LIMIT"
