"""Envelopes of the three formats around a payload, and whole-document encoding and decoding."""

from __future__ import annotations

import hashlib
from dataclasses import dataclass, field

from ..errors import CodecError
from . import cbor, text
from .cbor import Limits, Policy, Tagged
from .semantic import Session, Shared
from .tables import LEGACY, SAFE, TypeTable

#: Format names and tags.
V1, RANGE, SINGLETON = "cbor-ld-1.0", "legacy-range", "legacy-singleton"
TAG_V1, TAG_RANGE, TAG_RAW, TAG_COMPRESSED = 51997, 1536, 1280, 1281


@dataclass(frozen=True)
class Config:
    """All that encoding and decoding depend on, resolved on the driver. tables: registry id -> {type: {value: id}}."""

    format: str = V1
    registry_id: int = 0
    mode: str = "lengthFirstDeterministic"
    tables: dict = field(default_factory=dict)
    contexts: dict | None = None
    limits: Limits = Limits()
    policy: Policy = Policy()
    formats: tuple[str, ...] = (V1, RANGE, SINGLETON)
    compressed: bool = True  # of the legacy singleton, which has no registry id
    direct: bool = True  # uncompressed 1.0 envelopes under the default policy are read straight to JSON, with the codes of that way
    prepared: dict = field(default_factory=dict, repr=False, compare=False)  # tables made so far, once in each worker
    shared: Shared = field(default_factory=Shared, init=False, repr=False, compare=False)  # contexts met so far, likewise

    def table(self, registry_id: int) -> TypeTable:
        if registry_id not in self.prepared:
            self.prepared[registry_id] = self.prepare(registry_id)
        return self.prepared[registry_id]

    def prepare(self, registry_id: int) -> TypeTable:
        if registry_id in self.tables:
            made = self.tables[registry_id]
            if any(t in made for t in ("http://www.w3.org/2001/XMLSchema#" + x for x in ("integer", "double", "boolean"))):
                raise CodecError("ERR_UNSUPPORTED_LITERAL_TYPE", "numbers and booleans have no table")
            return TypeTable(made)
        if registry_id <= 1:
            return TypeTable(LEGACY if registry_id == 1 else {})
        raise CodecError("ERR_NO_TYPETABLE", f"no type table for registry entry {registry_id}")


@dataclass(frozen=True)
class Parsed:
    format: str
    registry_id: int | None
    compressed: bool
    payload: object


def wrap(payload, format: str, registry_id: int, compressed: bool, mode: str) -> bytes:
    if not 0 <= registry_id <= SAFE:
        raise CodecError("ERR_INVALID_INPUT", "the registry entry id is out of range")
    if format == V1:
        return cbor.encode(Tagged(TAG_V1, [registry_id, payload]), mode)
    if format == SINGLETON:
        return cbor.encode(Tagged(TAG_COMPRESSED if compressed else TAG_RAW, payload), mode)
    first, rest = (raw := text.registry_varint(registry_id))[0], raw[1:]
    return cbor.encode(Tagged(TAG_RANGE + first, [rest, payload] if rest else payload), mode)


def parse(data: bytes, limits: Limits = Limits(), policy: Policy = Policy()) -> Parsed:
    top = cbor.decode(data, limits, policy)
    bad = lambda m: CodecError("ERR_NOT_CBORLD", m, 0)
    if not isinstance(top, Tagged):
        raise bad("the data has no envelope tag")
    tag, body = top
    if tag == TAG_V1:
        if not isinstance(body, list) or len(body) != 2 or isinstance(body, cbor.Pairs) or not _count(body[0]):
            raise bad("the envelope is not [registry id, payload]")
        return Parsed(V1, body[0], body[0] != 0, body[1])
    if tag in (TAG_RAW, TAG_COMPRESSED):
        return Parsed(SINGLETON, None, tag == TAG_COMPRESSED, body)
    if TAG_RANGE <= tag < TAG_RANGE + 256:
        first = tag - TAG_RANGE
        if first < 128:
            return Parsed(RANGE, first, first != 0, body)
        if not isinstance(body, list) or len(body) != 2 or not isinstance(body[0], bytes):
            raise bad("the envelope is not [rest of the registry id, payload]")
        n = text.registry_varint_decode(bytes([first]) + body[0])
        return Parsed(RANGE, n, n != 0, body[1])
    raise bad(f"tag {tag} is not an envelope's")


def _count(x) -> bool:
    return isinstance(x, int) and not isinstance(x, bool) and x >= 0


def encode(document, config: Config = Config()) -> bytes:
    compressed = config.registry_id != 0 if config.format != SINGLETON else config.compressed
    if not compressed:
        return wrap(cbor.from_json(document), config.format, config.registry_id, False, config.mode)
    legacy = config.format != V1
    table = config.table(1 if config.format == SINGLETON else config.registry_id)
    return wrap(Session(table, config.contexts, legacy, config.shared).compress(document), config.format, config.registry_id, True, config.mode)


#: Fixed value: the head of an uncompressed 1.0 envelope, up to its payload; how deep the direct way may recurse.
PLAIN, DIRECT_DEPTH = b"\xd9\xcb\x1d\x82\x00", 256


def decode(data: bytes, config: Config = Config()):
    if config.direct and data.startswith(PLAIN) and config.policy == Policy() and config.limits.depth <= DIRECT_DEPTH and V1 in config.formats:
        return cbor.read_json(data, len(PLAIN), config.limits, 2)
    p = parse(data, config.limits, config.policy)
    if p.format not in config.formats:
        raise CodecError("ERR_UNSUPPORTED_FORMAT", f"format {p.format} is not enabled")
    if not p.compressed:
        return cbor.to_json(p.payload)
    table = config.table(1 if p.registry_id is None else p.registry_id)
    return Session(table, config.contexts, p.format != V1, config.shared).expand_document(p.payload)


def inspect(data: bytes, limits: Limits = Limits(), policy: Policy = Policy()) -> dict:
    p = parse(data, limits, policy)
    return {"format": p.format, "registry_id": p.registry_id, "compressed": p.compressed, "byte_count": len(data), "payload": repr(p.payload), "sha256": hashlib.sha256(data).digest()}
