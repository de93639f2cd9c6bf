"""Fixed values of the wire format, and dictionaries of typed values."""

from __future__ import annotations

from dataclasses import dataclass, field

from ..errors import CodecError
from . import cbor

#: Ids of keywords.
KEYWORDS = {
    "@context": 0, "@type": 2, "@id": 4, "@value": 6, "@direction": 8, "@graph": 10, "@included": 12, "@index": 14, "@json": 16,
    "@language": 18, "@list": 20, "@nest": 22, "@reverse": 24, "@base": 26, "@container": 28, "@default": 30, "@embed": 32, "@explicit": 34,
    "@none": 36, "@omitDefault": 38, "@prefix": 40, "@preserve": 42, "@protected": 44, "@requireAll": 46, "@set": 48, "@version": 50,
    "@vocab": 52, "@propagate": 54,
}
#: Ids of contexts in the legacy table.
LEGACY_CONTEXTS = {
    "https://www.w3.org/ns/activitystreams": 16,
    "https://www.w3.org/2018/credentials/v1": 17,
    "https://www.w3.org/ns/did/v1": 18,
    "https://w3id.org/security/suites/ed25519-2018/v1": 19,
    "https://w3id.org/security/suites/ed25519-2020/v1": 20,
    "https://w3id.org/cit/v1": 21,
    "https://w3id.org/age/v1": 22,
    "https://w3id.org/security/suites/x25519-2020/v1": 23,
    "https://w3id.org/veres-one/v1": 24,
    "https://w3id.org/webkms/v1": 25,
    "https://w3id.org/zcap/v1": 26,
    "https://w3id.org/security/suites/hmac-2019/v1": 27,
    "https://w3id.org/security/suites/aes-2019/v1": 28,
    "https://w3id.org/vaccination/v1": 29,
    "https://w3id.org/vc-revocation-list-2020/v1": 30,
    "https://w3id.org/dcc/v1": 31,
    "https://w3id.org/vc/status-list/v1": 32,
    "https://www.w3.org/ns/credentials/v2": 33,
    "https://w3id.org/security/data-integrity/v1": 48,
    "https://w3id.org/security/multikey/v1": 49,
    "https://purl.imsglobal.org/spec/ob/v3p0/context.json": 50,
    "https://w3id.org/security/data-integrity/v2": 51,
}
#: Ids of cryptosuites and of URL schemes, names of typed literals.
CRYPTOSUITES = {"ecdsa-rdfc-2019": 1, "ecdsa-sd-2023": 2, "eddsa-rdfc-2022": 3, "ecdsa-xi-2023": 4}
SCHEMES = {"https://": 2, "http://": 1, "urn:uuid:": 3, "data:": 4, "did:v1:nym:": 1024, "did:key:": 1025}
CRYPTOSUITE = "https://w3id.org/security#cryptosuiteString"
MULTIBASE = "https://w3id.org/security#multibase"
XSD = "http://www.w3.org/2001/XMLSchema#"
FIRST_TERM = 100
SAFE = 2**53 - 1


def value_key(value) -> bytes:
    """Two JSON values are equal if these bytes are: 1 and 1.0 are, true and 1 are not."""
    return cbor.encode(cbor.from_json(value))


class TypeTable:
    """Ids of values by type, both ways. Takes {type: [(value, id)]} or {type: {string: id}}."""

    def __init__(self, tables: dict):
        self.ids: dict[str, dict[bytes, int]] = {}
        self.values: dict[str, dict[int, object]] = {}
        for name, entries in {"context": {}, "url": {}, "none": {}, **tables}.items():
            pairs = list(entries.items()) if isinstance(entries, dict) else list(entries)
            self.ids[name] = {value_key(v): i for v, i in pairs}
            back = self.values[name] = {}
            for v, i in pairs:
                if i in back:
                    raise CodecError("ERR_INVALID_TYPETABLE", f"type {name} has id {i} twice")
                back[i] = v


LEGACY = {"context": LEGACY_CONTEXTS, "url": LEGACY_CONTEXTS, "none": LEGACY_CONTEXTS, CRYPTOSUITE: CRYPTOSUITES}


def as_bytes(name: str, legacy: bool) -> bool:
    """Whether ids of a type's table are written as bytes, as plain integers already have a meaning there."""
    return name in ("none", XSD + "date", XSD + "dateTime") or name == "url" and not legacy


@dataclass(frozen=True)
class Dictionary:
    """An application's dictionary: its registry code, and values with ids."""

    code: int = 1
    contexts: dict = field(default_factory=dict)
    uris: dict = field(default_factory=dict)
    untyped: dict = field(default_factory=dict)
    typed: dict = field(default_factory=dict)
    profile: str | None = None

    def tables(self) -> dict:
        return {"context": self.contexts, "url": self.uris, "none": self.untyped, **self.typed}

    def validate(self) -> Dictionary:
        bad = lambda m: CodecError("ERR_INVALID_DICTIONARY", m)
        if not 0 <= self.code <= SAFE:
            raise bad("the code is out of range")
        filled = any(self.tables().values())
        if self.code in (0, 1) and (filled or self.profile):
            raise bad("codes 0 and 1 stand for no dictionary")
        if any(t in ("context", "url", "none", "") for t in self.typed):
            raise bad("a typed table has a reserved name")
        for name, entries in self.tables().items():
            ids = [i for _, i in (entries.items() if isinstance(entries, dict) else entries)]
            if len(set(ids)) < len(ids) or any(not 0 <= i <= SAFE for i in ids):
                raise bad(f"table {name} has an id twice or out of range")
        return self

    def rows(self) -> list[tuple[str, bytes, str, int]]:
        """(table, value_key, value as JSON, id): the dictionary as a dimension table."""
        return [(t, value_key(v), cbor.dump_json(v), i) for t, entries in sorted(self.tables().items()) for v, i in (entries.items() if isinstance(entries, dict) else entries)]
