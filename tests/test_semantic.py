"""Golden vectors of envelopes and context-aware compression."""

import pytest

from tessera.errors import CodecError
from tessera.kernels import envelope, semantic
from tessera.kernels.envelope import RANGE, SINGLETON, V1, Config
from tessera.kernels.tables import CRYPTOSUITE, MULTIBASE, XSD, Dictionary

U = "urn:foo"


def config(context, typed=None, contexts=None, code=2):
    d = Dictionary(code, contexts=contexts or {U: 0x8000}, typed=typed or {}).validate()
    return Config(registry_id=code, tables={code: d.tables()}, contexts={u: {"@context": context} for u in (contexts or {U: 0})})


@pytest.mark.parametrize(
    ("fmt", "n", "want"),
    [(V1, 0, "d9cb1d8200a0"), (V1, 1, "d9cb1d8201a0"), (V1, 16, "d9cb1d8210a0"), (V1, 128, "d9cb1d821880a0"), (V1, 10**9, "d9cb1d821a3b9aca00a0"),
     (RANGE, 0, "d90600a0"), (RANGE, 1, "d90601a0"), (RANGE, 16, "d90610a0"), (RANGE, 128, "d90680824101a0"), (RANGE, 10**9, "d90680824494ebdc03a0"), (SINGLETON, 1, "d90501a0")],
)
def test_empty_documents(fmt, n, want):
    c = Config(format=fmt, registry_id=n, tables={n: {}})
    raw = envelope.encode({}, c)
    assert raw.hex() == want and envelope.decode(raw, c) == {}
    assert envelope.parse(raw).registry_id == (None if fmt == SINGLETON else n)


def both(doc, c, want):
    raw = envelope.encode(doc, c)
    assert raw.hex() == want
    assert envelope.decode(raw, c) == doc


def test_native_types():
    doc = {"@context": {"foo": "ex:foo"}, "foo": [-1, 0, 1, True, False, 1.1, 1.0, -1.1, "text"]}
    both(doc, Config(registry_id=1), "d9cb1d8201a200a163666f6f6665783a666f6f186589200001f5f4fb3ff199999999999a01fbbff199999999999a6474657874")


def test_typed_literals():
    c = config({"arbitraryPrefix": XSD, "foo": {"@id": "ex:foo", "@type": "arbitraryPrefix:dateTime"}})
    both({"@context": U, "foo": "2021-04-09T20:38:55Z"}, c, "d9cb1d8202a20019800018661a6070bb5f")
    c = config({"foo": {"@id": "ex:foo", "@type": XSD + "date"}})
    both({"@context": U, "foo": "2021-04-09"}, c, "d9cb1d8202a20019800018641a606f9900")
    doc = {"@context": U, "foo": ["MAQID", "zLdp", "uAQID"]}
    context = {"foo": {"@id": "ex:foo", "@type": MULTIBASE}}
    both(doc, config(context), "d9cb1d8202a200198000186583444d010203447a0102034475010203")
    table = {MULTIBASE: {"MAQID": 0x8001, "zLdp": 0x8002, "uAQID": 0x8003}}
    both(doc, config(context, table), "d9cb1d8202a200198000186583198001198002198003")
    context = {"foo": {"@id": "ex:foo", "@type": CRYPTOSUITE}}
    both({"@context": U, "foo": ["ecdsa-rdfc-2019", "ecdsa-sd-2023", "eddsa-rdfc-2022"]}, config(context, {CRYPTOSUITE: {"ecdsa-rdfc-2019": 1, "ecdsa-sd-2023": 2, "eddsa-rdfc-2022": 3}}), "d9cb1d8202a200198000186583010203")


@pytest.mark.parametrize(
    ("url", "tail"),
    [
        ("urn:uuid:75ef3fcc-9ae3-11eb-8e3e-10bf48838a41", "82035075ef3fcc9ae311eb8e3e10bf48838a41"),
        ("urn:uuid:75EF3FCC-9AE3-11EB-8E3E-10BF48838A41", "8203782437354546334643432d394145332d313145422d384533452d313042463438383338413431"),
        ("https://test.example", "82026c746573742e6578616d706c65"),
        ("http://test.example", "82016c746573742e6578616d706c65"),
        ("data:text/plain;base64,SGVsbG8sIFdvcmxkIQ==", "83046a746578742f706c61696e4d48656c6c6f2c20576f726c6421"),
        ("data:", "820460"),
        ("data:,", "8204612c"),
        ("data:;base64,", "83046040"),
        ("data:text/plain,test", "82046f746578742f706c61696e2c74657374"),
    ],
)
def test_urls(url, tail):
    both({"@context": U, "id": url}, config({"id": "@id"}), "d9cb1d8202a2001980001864" + tail)


def test_dids():
    key = "z6MkpTHR8VNsBxYAAWHut2Geadd9jSwuBV8xRoAnwWsdvktH"
    raw = "5822ed0194966b7c08e405775f8de6cc1c4508f6eb227403e1025b2c8ad2d7477398c5b2"
    context = {"@protected": True, "id": "@id", "type": "@type", "authentication": {"@id": "https://w3id.org/security#authenticationMethod", "@type": "@id", "@container": "@set"}}
    c = config(context, contexts={"https://w3id.org/did/v0.11": 0x8744})
    for prefix, code in (("did:key:", "190401"), ("did:v1:nym:", "190400")):
        doc = {"@context": "https://w3id.org/did/v0.11", "id": prefix + key, "authentication": [f"{prefix}{key}#{key}"]}
        both(doc, c, f"d9cb1d8202a3001987441865" f"8183{code}{raw}{raw}186682{code}{raw}")


def test_scoped_contexts():
    foo = {"foo": {"@id": "ex:foo", "@type": MULTIBASE}}
    doc = {"@context": U, "nested": {"foo": ["MAQID", "zLdp", "uAQID"]}}
    both(doc, config({"nested": {"@id": "ex:nested", "@context": foo}}), "d9cb1d8202a2001980001864a1186783444d010203447a0102034475010203".replace("1864a11867", "1864a11867"))
    c = config({"Scoped": {"@id": "ex:Scoped", "@context": foo}})
    doc = {"@context": U, "@type": "Scoped", "foo": ["MAQID", "zLdp", "uAQID"]}
    both(doc, c, "d9cb1d8202a300198000021864186783444d010203447a0102034475010203")


def test_dates_that_do_not_come_back_stay_text():
    for x in ("2021-13-01", "10000-01-01", "0000-01-01", "2021-4-9", "-1000-01-01"):
        assert semantic.shrink_date(x) is None
    assert semantic.shrink_date("0001-01-01") == -62135596800 and semantic.grow_date(-62135596800) == "0001-01-01"
    assert semantic.shrink_time("2021-04-09T20:38:55.500Z") == [1618000735, 500]
    assert semantic.grow_time([1618000735, 500]) == "2021-04-09T20:38:55.500Z"
    assert semantic.shrink_time("2021-04-09T20:38:55+02:00") is None


def test_integer_widths_are_kept_as_they_are():
    assert [semantic.unsigned_bytes(n).hex() for n in (254, 255, 65534, 65535)] == ["fe", "00ff", "fffe", "0000ffff"]
    assert [semantic.signed_bytes(n).hex() for n in (126, 127, -1, -129)] == ["7e", "007f", "ff", "7f"]


@pytest.mark.parametrize(
    ("raw", "code"),
    [("a0", "ERR_NOT_CBORLD"), ("d9cb1d8101", "ERR_NOT_CBORLD"), ("d9068082420100a0", "ERR_NOT_CBORLD"), ("d9cb1d8201a200a000a0", "ERR_INVALID_ENCODED_CONTEXT"),
     ("d9cb1d8201a2617801617802", "ERR_INVALID_INPUT"), ("d9cb1d8200f97e00", "ERR_INVALID_INPUT"), ("d9cb1d8201a10019ffff", "ERR_UNDEFINED_COMPRESSED_CONTEXT")],
)
def test_rejections(raw, code):
    with pytest.raises(CodecError) as e:
        envelope.decode(bytes.fromhex(raw))
    assert e.value.code == code


def test_context_errors():
    for context, code in (({"@import": "urn:foo"}, "ERR_INVALID_CONTEXT"), ({"x": 1}, "ERR_INVALID_TERM_DEFINITION"), ({"x": "ex:x", "@protected": True}, "ERR_PROTECTED_TERM_REDEFINITION")):
        with pytest.raises(CodecError) as e:
            envelope.encode({"@context": [U, {"x": "ex:y"}], "x": "1"}, config(context))
        assert e.value.code == code
    with pytest.raises(CodecError):
        envelope.encode({"@context": "urn:bar"}, config({}))
    with pytest.raises(CodecError) as e:
        Dictionary(2, typed={"url": {"a": 1}}).validate()
    assert e.value.code == "ERR_INVALID_DICTIONARY"
