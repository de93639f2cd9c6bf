"""Context-aware compression: terms become ids in the order their contexts are met, typed scalars become short forms.

Contexts come from a registry (url -> document) that the caller has resolved; nothing is fetched here. A Session holds the state of one
document: which terms have ids so far.
"""

from __future__ import annotations

import base64
import datetime as dt
import re
from dataclasses import dataclass, replace

from ..errors import CodecError, invalid_input
from . import cbor, text
from .cbor import Pairs
from .tables import FIRST_TERM, KEYWORDS, MULTIBASE, SAFE, SCHEMES, XSD, TypeTable, as_bytes, value_key

UNKNOWN = "ERR_UNKNOWN_COMPRESSED_VALUE"


@dataclass(frozen=True)
class Term:
    values: dict
    protected: bool = False
    propagates: bool = True

    @property
    def id(self):
        return x if isinstance(x := self.values.get("@id"), str) else None

    @property
    def type(self):
        return x if isinstance(x := self.values.get("@type"), str) else None


NO_TERM = Term({})


@dataclass(frozen=True)
class Scope:
    """The terms in force at a place in the document, and the scope it came from."""

    terms: dict[str, Term]
    outer: Scope | None = None

    def type_terms(self) -> list[str]:
        return ["@type", *[t for t, d in self.terms.items() if d.id == "@type"]]

    def reverted(self) -> dict[str, Term]:
        """Terms that do not propagate give way to what they stood for further out."""
        if all(t.propagates for t in self.terms.values()):
            return self.terms
        out = {}
        for name, term in self.terms.items():
            scope = self
            while term is not None and not term.propagates:
                scope = scope.outer
                term = scope.terms.get(name) if scope else None
            if term is not None:
                out[name] = term
        return out


#: Most contexts, and most scopes, that are kept for the documents of one configuration.
SHARED = 256


class Shared:
    """What documents of one registry have in common: contexts by key with the names they bring, in order, and scopes made from others.

    No state of a document. Scopes are known by identity: an entry holds all that its key names, so an id is not used again while it is
    there. A copy in another process starts empty."""

    def __init__(self):
        self.clear()

    def __reduce__(self):
        return Shared, ()

    def clear(self) -> None:
        self.empty: dict[str, Term] = {}
        self.contexts: dict[bytes, tuple[dict, dict[str, Term], list[str]]] = {}
        self.keys: dict[int, tuple[object, bytes]] = {}
        self.extended: dict[tuple, tuple[dict, dict[str, Term]]] = {}
        self.reverted: dict[tuple, tuple[list, dict[str, Term]]] = {}

    def trim(self) -> None:
        if max(map(len, (self.contexts, self.keys, self.extended, self.reverted))) > SHARED:
            self.clear()

    def key(self, context) -> bytes:
        """The key of a context that a term holds, which is the same object in every document."""
        if id(context) not in self.keys:
            self.keys[id(context)] = context, value_key(context)
        return self.keys[id(context)][1]

    def outside(self, scope: Scope) -> dict[str, Term]:
        """scope.reverted()"""
        chain, at = [], scope
        while at is not None:
            chain.append(at.terms)
            at = at.outer
        key = tuple(map(id, chain))
        if key not in self.reverted:
            self.reverted[key] = chain, scope.reverted()
        return self.reverted[key][1]


class Session:
    def __init__(self, table: TypeTable, registry: dict | None, legacy: bool = False, shared: Shared | None = None):
        self.table, self.registry, self.legacy = table, registry, legacy
        self.shared = Shared() if shared is None else shared
        self.shared.trim()
        self.ids = dict(KEYWORDS)
        self.names = {i: t for t, i in KEYWORDS.items()}
        self.loaded: dict[bytes, tuple[dict, dict[str, Term], list[str]]] = {}
        self.loading: set[str] = set()
        self.met: list[list[str]] = []  # names of the contexts that are being defined, those of their imports first

    # --- contexts

    def load(self, context, key: bytes | None = None) -> tuple[dict, dict[str, Term]]:
        key = value_key(context) if key is None else key
        if key in self.loaded:
            if self.met:
                self.met[-1] += self.loaded[key][2]
        elif key in self.shared.contexts:
            self.loaded[key] = self.shared.contexts[key]
            for name in self.loaded[key][2]:
                self.learn(name)
        else:
            self.met.append([])
            if isinstance(context, str):
                if context in self.loading:
                    raise CodecError("ERR_INVALID_CONTEXT", f"{context} imports itself")
                if self.registry is None:
                    raise CodecError("ERR_NO_DOCUMENT_LOADER", f"no registry to find {context} in")
                if context not in self.registry:
                    raise CodecError("ERR_UNKNOWN_CONTEXT", f"the registry does not have {context}")
                found = self.registry[context]
                if not isinstance(found, dict) or "@context" not in found:
                    raise CodecError("ERR_INVALID_CONTEXT", f"{context} holds no @context")
                self.loading.add(context)
                try:
                    made = self.define(found["@context"])
                finally:
                    self.loading.discard(context)
            else:
                made = self.define(context)
            self.loaded[key] = self.shared.contexts[key] = *made, self.met.pop()
            if self.met:
                self.met[-1] += self.loaded[key][2]
        return self.loaded[key][:2]

    def learn(self, name: str) -> None:
        """The next id for a name without one."""
        if self.met:
            self.met[-1].append(name)
        if name not in self.ids:
            new = FIRST_TERM + 2 * (len(self.ids) - len(KEYWORDS))
            self.ids[name], self.names[new] = new, name

    def define(self, context) -> tuple[dict, dict[str, Term]]:
        if not isinstance(context, dict):
            raise CodecError("ERR_INVALID_CONTEXT", "a context is an object or a URL")
        if isinstance(context.get("@import"), str):
            context = {**self.load(context["@import"])[0], **context}
        terms = {}
        for name in sorted(n for n in context if not n.startswith("@") and context[n] is not None):
            made = context[name]
            if not isinstance(made, (str, dict)):
                raise CodecError("ERR_INVALID_TERM_DEFINITION", f"{name} is defined by neither a string nor an object")
            terms[name] = Term({"@id": made} if isinstance(made, str) else made, context.get("@protected") is True)
            self.learn(name)
        return context, terms

    def extend(self, terms: dict[str, Term], contexts, by_property: bool = False, by_type: bool = False) -> dict[str, Term]:
        for context in contexts if isinstance(contexts, list) else [contexts]:
            if context == {}:  # nothing new, nothing taken away
                continue
            key = self.shared.key(context) if by_property or by_type else value_key(context)
            raw, new = self.load(context, key)
            step = id(terms), key, by_property, by_type
            if step not in self.shared.extended:
                self.shared.extended[step] = terms, self.extended(terms, raw, new, by_property, by_type)
            terms = self.shared.extended[step][1]
        return terms

    def extended(self, terms: dict[str, Term], raw: dict, new: dict[str, Term], by_property: bool, by_type: bool) -> dict[str, Term]:
        propagates = raw["@propagate"] if isinstance(raw.get("@propagate"), bool) else not by_type
        made = {n: self.resolved(n, replace(t, propagates=propagates), terms, raw) for n, t in new.items()}
        for name, old in terms.items():
            if name not in made:
                if not (name in raw and raw[name] is None):
                    made[name] = old
            elif old.protected:
                if not by_property and value_key(made[name].values) != value_key(old.values):
                    raise CodecError("ERR_PROTECTED_TERM_REDEFINITION", f"{name} is protected")
                made[name] = Term(old.values, True, made[name].propagates)
        return made

    def resolved(self, name: str, term: Term, terms: dict, raw: dict) -> Term:
        full = lambda x: self.expand(x, terms, raw)
        values = dict(term.values)
        if term.id is not None:
            values["@id"] = full(term.id)
        elif ":" in (x := full(name)):
            values["@id"] = x
        if term.type is not None:
            values["@type"] = full(term.type)
        if not isinstance(values.get("@id"), str):
            raise CodecError("ERR_INVALID_TERM_DEFINITION", f"{name} has no @id")
        return replace(term, values=values)

    def expand(self, name: str, terms: dict, raw: dict) -> str:
        for _ in range(128):
            if ":" not in name:
                return name
            prefix, rest = name.split(":", 1)
            if prefix in raw:
                base = raw[prefix].get("@id") if isinstance(raw[prefix], dict) else raw[prefix]
            else:
                base = terms[prefix].id if prefix in terms else None
            if not isinstance(base, str):
                return name
            name = base + rest
        raise CodecError("ERR_INVALID_TERM_DEFINITION", f"{name} is defined by itself")

    def enter(self, scope: Scope, contexts) -> Scope:
        return Scope(self.extend(scope.terms, {} if contexts is None else contexts), scope)

    def typed(self, scope: Scope, types: set[str]) -> Scope:
        terms = scope.terms
        for t in sorted(types):
            terms = self.extend(terms, terms.get(t, NO_TERM).values.get("@context", {}), by_type=True)
        return Scope(terms, scope)

    def within(self, scope: Scope, term: str) -> Scope:
        return Scope(self.extend(self.shared.outside(scope), scope.terms.get(term, NO_TERM).values.get("@context", {}), by_property=True), scope)

    def name(self, key) -> tuple[str, bool]:
        if isinstance(key, str):
            return key, False
        if isinstance(key, bool) or not isinstance(key, int) or key < 0 or key - key % 2 not in self.names:
            raise CodecError("ERR_UNKNOWN_CBORLD_TERM_ID", f"{key!r} is not the id of a term")
        return self.names[key - key % 2], key % 2 == 1

    # --- documents

    def compress(self, document):
        top = Scope(self.shared.empty)
        one = lambda v: self.shrink(v, top) if isinstance(v, dict) else cbor.from_json(v)
        return [one(v) for v in document] if isinstance(document, list) else one(document)

    def shrink(self, obj: dict, scope: Scope) -> Pairs:
        if "@context" in obj and obj["@context"] is None:
            raise CodecError("ERR_INVALID_CONTEXT", "a context is an object or a URL")
        scope, out = self.enter(scope, obj.get("@context")), Pairs()
        if "@context" in obj:
            many = isinstance(obj["@context"], list)
            done = [self.context_id(c) for c in (obj["@context"] if many else [obj["@context"]])]
            out.append((1, done) if many else (0, done[0]))
        named = [v for t in scope.type_terms() if t in obj for v in (obj[t] if isinstance(obj[t], list) else [obj[t]])]
        scope = self.typed(scope, {v for v in named if isinstance(v, str)})
        for name in sorted(obj):
            if name == "@context":
                continue
            many = isinstance(obj[name], list)
            key = self.ids[name] + many if name in self.ids else name
            term, inner = scope.terms.get(name, NO_TERM), self.within(scope, name)
            done = [self.shrink_value(v, name, term, inner) for v in (obj[name] if many else [obj[name]])]
            out.append((key, done if many else done[0]))
        return out

    def shrink_value(self, v, name: str, term: Term, scope: Scope):
        if v is None:
            return None
        if isinstance(v, list):
            return [self.shrink_value(x, name, term, scope) for x in v]
        return self.shrink(v, scope) if isinstance(v, dict) else self.shrink_scalar(v, self.kind(name, term))

    def context_id(self, context):
        found = self.table.ids["context"].get(value_key(context)) if isinstance(context, str) else None
        return cbor.from_json(context) if found is None else found

    @staticmethod
    def kind(name: str, term: Term) -> str:
        """The table that a scalar under a term belongs to."""
        if {name, term.id} & {"@id", "@type"} or term.type in ("@id", "@vocab"):
            return "url"
        return term.type or "none"

    def shrink_scalar(self, v, kind: str):
        if kind == "url" and not isinstance(v, str):
            raise CodecError("ERR_UNSUPPORTED_JSON_TYPE", "a URL is a string")
        if kind in self.table.ids:
            if (found := self.table.ids[kind].get(value_key(v))) is not None:
                return unsigned_bytes(found) if as_bytes(kind, self.legacy) else found
            if kind != "none" and isinstance(v, (int, float)) and not isinstance(v, bool) and v == int(v) and -(2**63) <= v < 2**63:
                return signed_bytes(int(v))
        short = {"url": self.shrink_url, MULTIBASE: shrink_multibase, XSD + "date": shrink_date, XSD + "dateTime": shrink_time}.get(kind)
        done = short(v) if short and isinstance(v, str) else None
        return cbor.from_json(v) if done is None else done

    def shrink_url(self, url: str):
        if url in self.ids:
            return self.ids[url]
        scheme = next((s for s in SCHEMES if url.startswith(s)), None)
        if scheme is None:
            return None
        code, rest = SCHEMES[scheme], url[len(scheme) :]
        if scheme == "urn:uuid:":
            return [code, text.uuid_bytes(rest) if rest.lower() == rest else rest]
        if scheme == "data:" and ";base64," in rest:
            media, body = rest.split(";base64,", 1)
            raw = text.base64_strict(body)
            if raw is not None and base64.b64encode(raw).decode() == body:
                return [code, media, raw]
        if scheme.startswith("did:"):
            return [code, *[text.base58_decode(p[1:]) if p.startswith("z") else p for p in rest.split("#", 1)]]
        return [code, rest]

    def expand_document(self, value):
        top = Scope(self.shared.empty)
        one = lambda v: self.grow(v, top) if isinstance(v, Pairs) else cbor.to_json(v)
        return [one(v) for v in value] if isinstance(value, list) and not isinstance(value, Pairs) else one(value)

    def grow(self, pairs: Pairs, scope: Scope) -> dict:
        is_id = lambda k, n: isinstance(k, int) and not isinstance(k, bool) and k == n
        single, several = ([v for k, v in pairs if is_id(k, n)] for n in (0, 1))
        if len(single) + len(several) > 1:
            raise CodecError("ERR_INVALID_ENCODED_CONTEXT", "more than one encoded context")
        out = {}
        if single:
            out["@context"] = self.context_of(single[0])
        if several:
            if not isinstance(several[0], list) or isinstance(several[0], Pairs):
                raise CodecError("ERR_INVALID_ENCODED_CONTEXT", "several contexts are an array")
            out["@context"] = [self.context_of(v) for v in several[0]]
        scope = self.enter(scope, out.get("@context"))
        scope = self.typed(scope, self.types_of(pairs, scope))
        entries = {}
        for key, value in pairs:
            if is_id(key, 0) or is_id(key, 1):
                continue
            name, many = self.name(key)
            if name in entries:
                raise invalid_input(f"term {name} occurs twice")
            entries[name] = many, value
        for name in sorted(entries):
            many, value = entries[name]
            if many and (not isinstance(value, list) or isinstance(value, Pairs)):
                raise invalid_input(f"plural term {name} holds no array")
            term, inner = scope.terms.get(name, NO_TERM), self.within(scope, name)
            done = [self.grow_value(v, name, term, inner) for v in (value if many else [value])]
            out[name] = done if many else done[0]
        return out

    def types_of(self, pairs: Pairs, scope: Scope) -> set[str]:
        out = set()
        for t in scope.type_terms():
            if t in self.ids:
                found = [v for n in (self.ids[t], self.ids[t] + 1) for k, v in pairs if isinstance(k, int) and k == n][:1]
                for v in (found[0] if found and isinstance(found[0], list) and not isinstance(found[0], Pairs) else found):
                    done = self.grow_scalar(v, "url")
                    if isinstance(done, str):
                        out.add(done)
        return out

    def context_of(self, value):
        if isinstance(value, int) and not isinstance(value, bool) and value >= 0:
            if value not in self.table.values["context"]:
                raise CodecError("ERR_UNDEFINED_COMPRESSED_CONTEXT", f"context {value} is not in the table")
            return self.table.values["context"][value]
        return cbor.to_json(value)

    def grow_value(self, v, name: str, term: Term, scope: Scope):
        if v is None:
            return None
        done = self.grow_scalar(v, self.kind(name, term))
        if done is not None:
            return done
        return self.grow(v, scope) if isinstance(v, Pairs) else [self.grow_value(x, name, term, scope) for x in v]

    def grow_scalar(self, v, kind: str):
        """The JSON scalar, or None for arrays and maps that are no short form."""
        number = isinstance(v, int) and not isinstance(v, bool)
        if kind in self.table.values:
            raw = as_bytes(kind, self.legacy)
            if raw and isinstance(v, bytes) or not raw and number:
                found = unsigned_of(v) if raw else v
                if found in self.table.values[kind]:
                    return self.table.values[kind][found]
                if self.legacy and kind == "url" and found in self.names:
                    return self.grow_url(v)
                raise CodecError(UNKNOWN, f"value {found} is not in the table")
            if isinstance(v, bytes) and kind != "none":
                return signed_of(v)
        long = {"url": self.grow_url, MULTIBASE: grow_multibase, XSD + "date": grow_date, XSD + "dateTime": grow_time}.get(kind)
        done = long(v) if long else None
        return done if done is not None else None if isinstance(v, list) else cbor.to_json(v)

    def grow_url(self, v):
        if isinstance(v, str):
            return v
        if isinstance(v, int) and not isinstance(v, bool):
            return self.name(v)[0]
        if not isinstance(v, list) or isinstance(v, Pairs) or not v or isinstance(v[0], bool) or v[0] not in list(SCHEMES.values()):
            return None
        scheme, rest = next(s for s, c in SCHEMES.items() if c == v[0]), v[1:]
        kinds = tuple(type(x) for x in rest)
        if kinds == (str,) and not scheme.startswith("did:"):
            return scheme + rest[0]
        if scheme == "urn:uuid:" and kinds == (bytes,) and len(rest[0]) == 16:
            return scheme + text.uuid_text(rest[0])
        if scheme == "data:" and kinds == (str, bytes):
            return f"data:{rest[0]};base64,{base64.b64encode(rest[1]).decode()}"
        if scheme.startswith("did:") and len(rest) in (1, 2) and set(kinds) <= {str, bytes}:
            return scheme + "#".join(x if isinstance(x, str) else "z" + text.base58_encode(x) for x in rest)
        raise CodecError(UNKNOWN, "a compressed URL is malformed")


# --- scalars


def unsigned_bytes(n: int) -> bytes:
    """Big-endian, with widths chosen below the largest value of each, not up to it."""
    if n >= SAFE:
        raise CodecError("ERR_COMPRESSION_VALUE_TOO_LARGE", f"{n} is too large")
    return n.to_bytes(next(w for w in (1, 2, 4, 8) if n < 256**w - 1), "big")


def signed_bytes(n: int) -> bytes:
    """Two's complement with the same kind of widths; what is below one byte is cut to it."""
    if n >= SAFE:
        raise CodecError("ERR_COMPRESSION_VALUE_TOO_LARGE", f"{n} is too large")
    w = next(w for w in (1, 2, 4, 8) if n < 256**w // 2 - 1)
    return (n % 256**w).to_bytes(w, "big")


def unsigned_of(raw: bytes) -> int:
    if len(raw) not in (1, 2, 4):
        raise CodecError("ERR_UNRECOGNIZED_BYTES", "not the width of an unsigned integer")
    return int.from_bytes(raw, "big")


def signed_of(raw: bytes) -> int:
    if len(raw) not in (1, 2, 4, 8):
        raise CodecError("ERR_UNRECOGNIZED_BYTES", "not the width of a signed integer")
    n = int.from_bytes(raw, "big", signed=True)
    if n > SAFE:
        raise CodecError("ERR_COMPRESSION_VALUE_TOO_LARGE", f"{n} is too large")
    return n


def shrink_multibase(value: str):
    kind, rest = value[:1], value[1:]
    if kind not in text.PREFIXES:
        return None
    try:
        raw = text.base58_decode(rest) if kind == "z" else text.base64_strict(rest if kind == "M" else rest.translate(str.maketrans("-_", "+/")) + "=" * (-len(rest) % 4))
    except CodecError:
        raw = None
    if raw is None:
        raise invalid_input(f"not a {kind}-multibase value")
    return kind.encode() + raw


def grow_multibase(v):
    if not isinstance(v, bytes) or not v or chr(v[0]) not in text.PREFIXES:
        return None
    kind, raw = chr(v[0]), v[1:]
    return kind + (text.base58_encode(raw) if kind == "z" else text.base64url(raw) if kind == "u" else base64.b64encode(raw).decode())


EPOCH = dt.datetime(1970, 1, 1)


def shrink_date(value: str):
    """Seconds since 1970 of midnight, only if that gives the same text back."""
    if not re.fullmatch(r"\d{4}-\d\d-\d\d", value):
        return None
    try:
        n = int((dt.datetime.fromisoformat(value) - EPOCH).total_seconds())
    except ValueError:
        return None
    return n if grow_date(n) == value else None


def grow_date(v):
    return moment(v).strftime("%Y-%m-%d").zfill(10) if isinstance(v, int) and not isinstance(v, bool) and moment(v) else None


def moment(n: int):
    try:
        return EPOCH + dt.timedelta(seconds=n)
    except OverflowError:
        return None


def shrink_time(value: str):
    """Seconds since 1970, or [seconds, milliseconds], only if that gives the same text back."""
    if not re.fullmatch(r"\d{4}-\d\d-\d\dT\d\d:\d\d:\d\d(\.\d{3})?Z", value):
        return None
    try:
        when = dt.datetime.fromisoformat(value[:19])
    except ValueError:
        return None
    n = int((when - EPOCH).total_seconds())
    out = [n, int(value[20:23])] if len(value) > 20 else n
    return out if grow_time(out) == value else None


def grow_time(v):
    if isinstance(v, list) and len(v) == 2 and all(isinstance(x, int) and not isinstance(x, bool) for x in v) and 0 <= v[1] < 1000:
        base = grow_time(v[0])
        return base and f"{base[:-1]}.{v[1]:03d}Z"
    if not isinstance(v, int) or isinstance(v, bool) or not moment(v):
        return None
    return moment(v).strftime("%Y-%m-%dT%H:%M:%SZ").zfill(20)
