"""Golden vectors and properties of the kernels."""

import math
import struct

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from tessera.errors import CodecError
from tessera.kernels import cbor, envelope, scan, text
from tessera.kernels.cbor import Limits, Pairs, Policy, Tagged

JSON = st.recursive(
    st.none() | st.booleans() | st.integers(-(2**63), 2**63 - 1) | st.floats(allow_nan=False, allow_infinity=False) | st.text(),
    lambda x: st.lists(x, max_size=4) | st.dictionaries(st.text(max_size=5), x, max_size=4),
    max_leaves=20,
)


def test_document_bytes():
    doc = {"active": True, "count": 7, "items": [None, "hello", -3, 1.5], "nested": {"a": 1, "longer-key": "value"}}
    want = "a465636f756e7407656974656d7384f66568656c6c6f22f93e0066616374697665f5666e6573746564a26161016a6c6f6e6765722d6b65796576616c7565"
    assert cbor.encode(cbor.from_json(doc)).hex() == want
    assert cbor.to_json(cbor.decode(bytes.fromhex(want))) == doc
    assert cbor.encode(cbor.from_json({"aa": 0, "b": 0})).hex() == "a261620062616100"


def test_key_orders_differ():
    m = Tagged(100, Pairs([(10, True), (100, True), (-1, True), ("a", True), ("aa", True), ([100], True), ([-1], True), (False, True)]))
    assert cbor.encode(m).hex() == "d864a80af520f5f4f51864f56161f58120f5626161f5811864f5"
    assert cbor.encode(m, "coreDeterministic").hex() == "d864a80af51864f520f56161f5626161f5811864f58120f5f4f5"


@pytest.mark.parametrize(("x", "want"), [(1.5, "f93e00"), (-0.0, "f98000"), (math.nan, "f97e00"), (100000.0, "fa47c35000"), (1.1, "fb3ff199999999999a"), (3.4028234663852886e38, "fa7f7fffff"), (1e300, "fb7e37e43c8800759c")])
def test_floats(x, want):
    assert cbor.encode(x).hex() == want


def test_json_numbers():
    assert cbor.encode(cbor.from_json(1.0)) == b"\x01"
    assert cbor.encode(cbor.from_json(-0.0)) == b"\x00"
    assert cbor.parse_json("18446744073709551616") == 2.0**64
    with pytest.raises(CodecError):
        cbor.from_json(math.inf)


def test_every_half_pattern():
    for bits in range(65536):
        x = struct.unpack(">e", bits.to_bytes(2, "big"))[0]
        if x == x:
            assert cbor.half_bits(x) == bits


@settings(max_examples=150, deadline=None)
@given(JSON)
def test_round_trip_and_fixpoint(value):
    raw = cbor.encode(cbor.from_json(value))
    again = cbor.to_json(cbor.decode(raw))
    assert cbor.encode(cbor.from_json(again)) == raw
    found = scan.structural_scan(raw)
    assert found.is_valid and found.item_count == len(cbor.scan_nodes(raw))


@settings(max_examples=60, deadline=None)
@given(JSON)
def test_every_truncation_is_invalid(value):
    raw = cbor.encode(cbor.from_json(value))
    for k in range(len(raw)):
        found = scan.structural_scan(raw[:k])
        assert not found.is_valid and 0 <= found.first_error_offset <= k
        with pytest.raises(CodecError):
            cbor.decode(raw[:k])


@pytest.mark.parametrize("bad", ["ff", "1a0000", "61ff", "5f6161ff", "9f01", "0001", "e0", "f81f"])
def test_decoder_rejects(bad):
    with pytest.raises(CodecError):
        cbor.decode(bytes.fromhex(bad))


@pytest.mark.parametrize(
    ("data", "policy", "limits", "code", "offset"),
    [
        ("d9cb1d821800a0", cbor.STRICT, Limits(), "ERR_NON_PREFERRED_INTEGER", 4),
        ("d9cb1d980200a0", Policy(reject_length_widths=True), Limits(), "ERR_NON_PREFERRED_LENGTH", 3),
        ("d9cb1d8200fb3ff0000000000000", Policy(reject_float_widths=True), Limits(), "ERR_NON_PREFERRED_FLOAT", 5),
        ("d9cb1d8200a262616100616200", Policy(required_mode="lengthFirstDeterministic"), Limits(), "ERR_NON_PREFERRED_CBOR", None),
        ("d9cb1d8200a2616101616102", Policy(), Limits(reject_duplicate_keys=True), "ERR_NOT_CBORLD", 9),
        ("d9cb1d8200a0", Policy(), Limits(input_bytes=5), "ERR_RESOURCE_LIMIT", None),
        ("d9cb1d820083000102", Policy(), Limits(items=2), "ERR_RESOURCE_LIMIT", None),
        ("d9cb1d820081818100", Policy(), Limits(depth=4), "ERR_RESOURCE_LIMIT", None),
        ("a20100180101", Policy(), Limits(reject_duplicate_keys=True), "ERR_NOT_CBORLD", 3),
    ],
)
def test_policies_and_limits(data, policy, limits, code, offset):
    with pytest.raises(CodecError) as e:
        cbor.decode(bytes.fromhex(data), limits, policy)
    assert e.value.code == code and (offset is None or e.value.offset == offset)


def test_lossless_nodes():
    assert [n.violations for n in cbor.scan_nodes(bytes.fromhex("d9cb1d8200e0"))][-1] == ["reserved-simple-value"]
    nodes = cbor.scan_nodes(bytes.fromhex("d9cb1d8200a1616101"))
    assert [(n.start, n.end) for n in nodes] == [(0, 9), (3, 9), (4, 5), (5, 9), (6, 8), (8, 9)]
    assert nodes[-1].json_path == "$[1].a"


@pytest.mark.parametrize(
    ("data", "want"),
    [
        ("a26161016162820203", (True, None, 2, 7)),
        ("d9cb1d8200a0", (True, None, 2, 4)),
        ("f0", (True, None, 0, 1)),
        ("61ff", (False, 1, 0, 1)),
        ("f81f", (False, 0, 0, 1)),
        ("a2616101616282020300", (False, 9, 2, 7)),
    ],
)
def test_scan(data, want):
    s = scan.structural_scan(bytes.fromhex(data))
    assert (s.is_valid, s.first_error_offset, s.max_depth, s.item_count) == want


def test_scan_limits():
    s = scan.structural_scan(bytes.fromhex("9f01ff"))
    assert (s.is_valid, s.item_count, s.max_depth) == (True, 2, 1)
    assert scan.structural_scan(bytes.fromhex("9f01ff"), Limits(allow_indefinite=False)).first_error_offset == 0
    assert scan.structural_scan(bytes.fromhex("818100"), Limits(depth=0)).first_error_offset == 1
    assert scan.structural_scan(bytes.fromhex("a2616101616102"), Limits(reject_duplicate_keys=True)).first_error_offset == 4
    assert scan.structural_scan(bytes.fromhex("9b7fffffffffffffff")).error_code == "ERR_RESOURCE_LIMIT"


@pytest.mark.parametrize(("data", "want"), [("c080", 0), ("eda080", 1), ("f4908080", 1), ("80", 0), ("e282", 0), ("e28228", 2), ("e228", 0), ("f09f9880", None)])
def test_utf8_offsets(data, want):
    assert text.first_invalid_utf8(bytes.fromhex(data)) == want


def test_multibase():
    assert text.multibase_encode(bytes.fromhex("0000010203"), "z") == "z11Ldp"
    assert [text.multibase_decode(x)[1] for x in ("z0", "xabc", "uA")] == [1, 0, 2]
    assert text.multibase_decode("uAAAA", 2)[1] == 2
    assert text.multibase_decode("uAAABAgM")[0] == bytes.fromhex("0000010203")


@given(st.binary(max_size=40), st.sampled_from("zuM"))
def test_multibase_round_trip(data, kind):
    assert text.multibase_decode(text.multibase_encode(data, kind))[0] == data


@given(st.integers(0, 2**64 - 1))
def test_varint_round_trip(n):
    assert text.varint_decode(text.varint_encode(n))[0] == n


def test_varint_faults():
    faults = [text.varint_decode(bytes.fromhex(x))[2] for x in ("", "ff" * 9 + "02", "80", "0001")]
    assert faults == [0, 9, 0, 1]
    assert text.varint_decode(bytes.fromhex("8000"))[0] == 0


def direct_and_walked(payload: bytes):
    data = envelope.PLAIN + payload
    out = []
    for config in (envelope.Config(), envelope.Config(direct=False)):
        try:
            out.append(envelope.decode(data, config))
        except CodecError as e:
            out.append(e.code)
    return tuple(out)


def test_plain_documents_are_read_straight_to_json():
    for value in ({}, [], {"a": [1, -1, 2**63 - 1, -(2**63), 1.5, None, True, False, "é" * 300], "b": {"c": {}}}, list(range(300))):
        assert direct_and_walked(cbor.encode(cbor.from_json(value))) == (value, value)
    assert direct_and_walked(b"\x9f\x01\x7f\x61a\x61b\xff\xff") == ([1, "ab"], [1, "ab"])
    assert direct_and_walked(b"\xf0") == ("ERR_NOT_CBORLD", "ERR_RESERVED_SIMPLE_VALUE")
    for bad, code in ((b"\xa2\x61n\x01\x61n\x02", "ERR_INVALID_INPUT"), (b"\x41x", "ERR_INVALID_INPUT"), (b"\xa1\x01\x02", "ERR_INVALID_INPUT"), (b"\xf9\x7e\x00", "ERR_INVALID_INPUT"), (b"\x3b" + b"\xff" * 8, "ERR_NOT_CBORLD"), (b"\x62a", "ERR_NOT_CBORLD"), (b"\x9f\x01", "ERR_NOT_CBORLD"), (b"\x01\x01", "ERR_NOT_CBORLD"), (b"\x81" * 200 + b"\x01", "ERR_RESOURCE_LIMIT")):
        assert direct_and_walked(bad) == (code, code)


def test_a_failure_knows_its_item():
    with pytest.raises(CodecError) as e:
        cbor.decode(b"\x82\x01\xa1\x61k\x18\x05", policy=cbor.STRICT)
    assert (e.value.offset, e.value.end, e.value.place.path, e.value.place.json_path, e.value.place.info) == (5, 7, "$[1].value[0]", "$[1].k", 24)
