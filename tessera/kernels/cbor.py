"""CBOR over Python values: int, float, str, bytes, bool, None, list, and the classes below. No Spark here.

Reading is one pass over heads with an explicit stack, so nesting costs no recursion; every item leaves a Node with its byte range, from which
values, diagnostics and rows are all derived.
"""

from __future__ import annotations

import json
import math
import struct
from dataclasses import dataclass, field
from typing import NamedTuple

from ..errors import CodecError, invalid_input

MODES = ("lengthFirstDeterministic", "coreDeterministic", "preferred", "legacy")
INT64 = 1 << 63


@dataclass(frozen=True)
class Limits:
    input_bytes: int = 64 << 20
    depth: int = 128
    items: int = 1_000_000
    nodes: int = 10_000
    reject_duplicate_keys: bool = False
    allow_indefinite: bool = True


@dataclass(frozen=True)
class Policy:
    reject_integer_widths: bool = False
    reject_length_widths: bool = False
    reject_float_widths: bool = False
    allow_reserved_simple: bool = False
    required_mode: str | None = None


STRICT = Policy(True, True, True, False, "lengthFirstDeterministic")


class Pairs(list):
    """A map as its list of (key, value), so that duplicates and keys of any kind survive."""


class Tagged(NamedTuple):
    tag: int
    value: object


class Simple(NamedTuple):
    number: int


def head(major: int, n: int) -> bytes:
    if n < 24:
        return bytes([32 * major + n])
    for info, width in ((24, 1), (25, 2), (26, 4), (27, 8)):
        if n < 1 << 8 * width:
            return bytes([32 * major + info]) + n.to_bytes(width, "big")
    raise invalid_input(f"{n} does not fit in 64 bits")


def half_bits(x: float) -> int | None:
    """The binary16 bits of a double if they are exact."""
    try:
        raw = struct.pack(">e", x)
    except OverflowError:
        return None
    return int.from_bytes(raw, "big") if struct.pack(">d", struct.unpack(">e", raw)[0]) == struct.pack(">d", x) else None


def float_bytes(x: float) -> bytes:
    """The shortest of the three widths that keeps every bit; one NaN."""
    if math.isnan(x):
        return b"\xf9\x7e\x00"
    if (bits := half_bits(x)) is not None:
        return b"\xf9" + bits.to_bytes(2, "big")
    try:
        single = struct.pack(">f", x)
    except OverflowError:
        single = b""
    if single and struct.pack(">d", struct.unpack(">f", single)[0]) == struct.pack(">d", x):
        return b"\xfa" + single
    return b"\xfb" + struct.pack(">d", x)


def key_order(mode: str):
    return (lambda k: k) if mode == "coreDeterministic" else (lambda k: (len(k), k))


def encode(value, mode: str = "lengthFirstDeterministic") -> bytes:
    order, out = key_order(mode), []

    def put(v) -> bytes:
        if v is None:
            return b"\xf6"
        if v is True or v is False:
            return b"\xf5" if v else b"\xf4"
        if isinstance(v, int):
            return head(0, v) if v >= 0 else head(1, -1 - v)
        if isinstance(v, float):
            return float_bytes(v)
        if isinstance(v, str):
            raw = v.encode()
            return head(3, len(raw)) + raw
        if isinstance(v, bytes):
            return head(2, len(v)) + v
        if isinstance(v, Pairs):
            items = sorted(((put(k), put(x)) for k, x in v), key=lambda e: order(e[0]))
            return head(5, len(items)) + b"".join(k + x for k, x in items)
        if isinstance(v, list):
            return head(4, len(v)) + b"".join(map(put, v))
        if isinstance(v, Tagged):
            return head(6, v.tag) + put(v.value)
        if isinstance(v, Simple):
            return bytes([0xE0 + v.number]) if v.number < 24 else bytes([0xF8, v.number])
        raise invalid_input(f"no CBOR form for {type(v).__name__}")

    out.append(put(value))
    return out[0]


def from_json(value):
    """A JSON tree as CBOR values: whole doubles of up to 53 bits become integers."""
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return value
    if isinstance(value, float):
        if not math.isfinite(value):
            raise invalid_input("JSON numbers must be finite")
        return int(value) if value == int(value) and abs(value) <= 2**53 - 1 else value
    if isinstance(value, int):
        return value
    if isinstance(value, list):
        return [from_json(v) for v in value]
    return Pairs((k, from_json(v)) for k, v in value.items())


def to_json(value):
    if isinstance(value, Pairs):
        out = {}
        for k, v in value:
            if not isinstance(k, str):
                raise invalid_input("a JSON object needs string keys")
            if k in out:
                raise invalid_input(f"duplicate key {k!r}")
            out[k] = to_json(v)
        return out
    if isinstance(value, list):
        return [to_json(v) for v in value]
    if isinstance(value, float) and not math.isfinite(value):
        raise invalid_input("a number that is not finite has no JSON form")
    if isinstance(value, (bytes, Tagged, Simple)):
        raise invalid_input(f"{type(value).__name__} has no JSON form")
    if isinstance(value, int) and not isinstance(value, bool) and not -INT64 <= value < INT64:
        raise invalid_input("an integer beyond 64 bits has no JSON form")
    return value


def parse_json(text: str):
    """JSON text with numbers as 64-bit integers, or else doubles."""
    try:
        return json.loads(text, parse_int=lambda s: int(s) if -INT64 <= int(s) < INT64 else float(s))
    except ValueError as e:
        raise invalid_input(f"not JSON: {e}") from None


def dump_json(value) -> str:
    return json.dumps(value, sort_keys=True, ensure_ascii=False, separators=(",", ":"))


@dataclass
class Node:
    """One item: byte range, place in the tree, head."""

    start: int
    major: int
    info: int
    depth: int
    path: str
    json_path: str | None
    end: int = -1
    indefinite: bool = False
    arg: int = 0
    violations: list[str] = field(default_factory=list)
    value: object = None
    children: list = field(default_factory=list)


class _Frame:
    __slots__ = ("node", "left", "keys", "key")

    def __init__(self, node: Node, left: int | None):
        self.node, self.left, self.keys, self.key = node, left, {}, None


class Reader:
    """Reads one item that fills the data. ``lossless`` notes breaches of the policy on the nodes and goes on; else they are raised."""

    def __init__(self, data: bytes, limits: Limits = Limits(), policy: Policy = Policy(), lossless: bool = False):
        self.data, self.limits, self.policy, self.lossless = data, limits, policy, lossless
        self.at, self.nodes = 0, []

    def bad(self, message: str) -> CodecError:
        return CodecError("ERR_NOT_CBORLD", message, self.at)

    def breach(self, code: str, violation: str, node: Node) -> None:
        node.violations.append(violation)
        if not self.lossless:
            raise CodecError(code, f"policy: {violation}", node.start, violation=violation, end=self.at)

    def take(self, n: int) -> bytes:
        if n > len(self.data) - self.at:
            raise self.bad("unexpected end of data")
        self.at += n
        return self.data[self.at - n : self.at]

    def argument(self, info: int) -> int:
        if info < 24:
            return info
        if info > 27:
            raise self.bad(f"additional information {info} is not defined")
        return int.from_bytes(self.take(1 << info - 24), "big")

    def width(self, node: Node, kind: str) -> None:
        wanted = node.arg if node.arg < 24 else next(i for i, w in ((24, 8), (25, 16), (26, 32), (27, 64)) if node.arg < 1 << w)
        strict = self.policy.reject_integer_widths if kind == "integer" else self.policy.reject_length_widths
        if node.info != wanted and (strict or self.lossless):
            self.breach(f"ERR_NON_PREFERRED_{kind.upper()}", f"non-preferred-{kind}", node)

    def read(self) -> Node:
        """The item. A failure knows the innermost item that holds its offset, of those begun so far."""
        try:
            return self.walk()
        except CodecError as e:
            if e.offset is not None:
                e.place = next((n for n in reversed(self.nodes) if n.start <= e.offset and not -1 < n.end <= e.offset), None)
            raise

    def walk(self) -> Node:
        if len(self.data) > self.limits.input_bytes:
            raise CodecError("ERR_RESOURCE_LIMIT", "the input is longer than the limit", self.limits.input_bytes)
        stack: list[_Frame] = []
        root = None
        while True:
            top = stack[-1] if stack else None
            if top and (top.left == 0 or top.left is None and self.stop(top)):
                stack.pop()
                done = self.close(top)
            else:
                if top and top.left is None and top.node.major in (4, 5) and (top.node.major == 4 or top.key is None):
                    self.count(len(top.node.children) // (1 if top.node.major == 4 else 2) + 1)
                depth = top.node.depth + 1 if top else 0
                node = self.open(depth, *self.paths(top))
                frame = self.begin(node)
                if frame:
                    stack.append(frame)
                    continue
                done = node
            if not stack:
                root = done
                break
            self.add(stack[-1], done)
        if self.at != len(self.data):
            raise self.bad("data goes on after the item")
        mode = self.policy.required_mode
        if mode and (again := encode(root.value, mode)) != self.data:
            same = next((i for i, (a, b) in enumerate(zip(again, self.data, strict=False)) if a != b), min(len(again), len(self.data)))
            root.violations.append("required-serialization-mode")
            if not self.lossless:
                raise CodecError("ERR_NON_PREFERRED_CBOR", f"the data is not in {mode} form", same, violation="required-serialization-mode")
        return root

    def paths(self, top: _Frame | None) -> tuple[str, str | None]:
        if top is None:
            return "$", "$"
        n, j = top.node, top.node.json_path
        if n.major == 4:
            i = len(n.children)
            return f"{n.path}[{i}]", j and f"{j}[{i}]"
        if n.major == 6:
            return f"{n.path}.tag", j
        i = len(n.children) // 2
        if len(n.children) % 2 == 0:
            return f"{n.path}.key[{i}]", None
        key = n.children[-1].value
        return f"{n.path}.value[{i}]", f"{j}.{key}" if j and isinstance(key, str) else None

    def count(self, n: int) -> None:
        if n > self.limits.items:
            raise CodecError("ERR_RESOURCE_LIMIT", "a container has more items than the limit", self.at)

    def open(self, depth: int, path: str, json_path: str | None) -> Node:
        if depth > self.limits.depth:
            raise CodecError("ERR_RESOURCE_LIMIT", "items are nested deeper than the limit", self.at)
        start = self.at
        first = self.take(1)[0]
        node = Node(start, first >> 5, first & 31, depth, path, json_path)
        self.nodes.append(node)
        return node

    def begin(self, node: Node) -> _Frame | None:
        """Reads what follows the first byte; containers and tags give a frame, other items are finished."""
        major, info = node.major, node.info
        if info == 31 and 2 <= major <= 5:
            if not self.limits.allow_indefinite:
                raise self.bad("indefinite lengths are not allowed")
            node.indefinite = True
            if major > 3:
                return _Frame(node, None)
            node.value = self.chunks(major)
        elif major == 7:
            node.value = self.simple(node)
        else:
            node.arg = self.argument(info)
            self.width(node, "length" if 2 <= major <= 5 else "integer")
            if major == 0:
                node.value = node.arg
            elif major == 1:
                if node.arg >= INT64:
                    raise self.bad("the negative integer is below 64 bits")
                node.value = -1 - node.arg
            elif major == 6:
                return _Frame(node, 1)
            elif major in (2, 3):
                node.value = self.text(self.take(node.arg)) if major == 3 else self.take(node.arg)
            else:
                each = major - 3
                self.count(node.arg)
                if node.arg > (len(self.data) - self.at) // each:
                    raise self.bad("a container's length goes beyond the data")
                return _Frame(node, node.arg * each)
        node.end = self.at
        return None

    def text(self, raw: bytes) -> str:
        try:
            return raw.decode()
        except UnicodeDecodeError:
            raise self.bad("text is not UTF-8") from None

    def chunks(self, major: int):
        parts = []
        while not self.at_break():
            first = self.take(1)[0]
            if first >> 5 != major or first & 31 == 31:
                raise self.bad("a chunk is of another kind")
            raw = self.take(self.argument(first & 31))
            parts.append(self.text(raw) if major == 3 else raw)
        self.at += 1
        return ("" if major == 3 else b"").join(parts)

    def at_break(self) -> bool:
        if self.at >= len(self.data):
            raise self.bad("an indefinite item does not end")
        return self.data[self.at] == 0xFF

    def stop(self, top: _Frame) -> bool:
        if (top.node.major == 5 and len(top.node.children) % 2) or not self.at_break():
            return False
        self.at += 1
        return True

    def simple(self, node: Node):
        info = node.info
        if info in (20, 21, 22):
            return (False, True, None)[info - 20]
        if info in (25, 26, 27):
            raw = self.take((2, 4, 8)[info - 25])
            value = struct.unpack((">e", ">f", ">d")[info - 25], raw)[0]
            shortest = float_bytes(value)
            wide = shortest != bytes([0xE0 + info]) + raw
            if wide and (self.policy.reject_float_widths or self.lossless and (info == 27 and len(shortest) < 9)):
                self.breach("ERR_NON_PREFERRED_FLOAT", "non-preferred-float", node)
            return value
        if info < 24 or info == 24:
            number = self.take(1)[0] if info == 24 else info
            if not self.policy.allow_reserved_simple:
                self.breach("ERR_RESERVED_SIMPLE_VALUE", "reserved-simple-value", node)
            return Simple(number)
        raise self.bad(f"simple value {info} is not defined")

    def add(self, top: _Frame, child: Node) -> None:
        node = top.node
        node.children.append(child)
        if top.left is not None:
            top.left -= 1
        if node.major == 5:
            if len(node.children) % 2:
                top.key = child
            elif self.limits.reject_duplicate_keys:
                key, top.key = top.key, None
                same = encode(key.value)
                if same in top.keys:
                    raise CodecError("ERR_NOT_CBORLD", "a map has a key twice", key.start, top.keys[same], "duplicate-map-key")
                top.keys[same] = key.start
            else:
                top.key = None

    def close(self, top: _Frame) -> Node:
        node, values = top.node, [c.value for c in top.node.children]
        if node.major == 4:
            node.value = values
        elif node.major == 5:
            node.value = Pairs(zip(values[::2], values[1::2], strict=True))
        else:
            node.value = Tagged(node.arg, values[0])
        node.end = self.at
        return node


def read_json(data: bytes, at: int, limits: Limits = Limits(), depth: int = 0):
    """The JSON value that fills the data from ``at`` on, without nodes or CBOR values between: the quick way for plain documents.

    What JSON can't hold is ERR_INVALID_INPUT, a key that comes twice included; simple values other than the JSON ones are ERR_NOT_CBORLD."""
    size = len(data)
    bad = lambda message, at: CodecError("ERR_NOT_CBORLD", message, at)

    def argument(info: int, at: int) -> tuple[int, int]:
        if info < 24:
            return info, at
        if info > 27:
            raise bad(f"additional information {info} is not defined", at)
        end = at + (1 << info - 24)
        if end > size:
            raise bad("unexpected end of data", at)
        return int.from_bytes(data[at:end], "big"), end

    def open_ended(info: int, at: int) -> bool:
        if info == 31 and not limits.allow_indefinite:
            raise bad("indefinite lengths are not allowed", at)
        return info == 31

    def text(info: int, at: int) -> tuple[str, int]:
        if open_ended(info, at):
            parts = []
            while not ended(at):
                if data[at] >> 5 != 3 or data[at] & 31 == 31:
                    raise bad("a chunk is of another kind", at + 1)
                part, at = text(data[at] & 31, at + 1)
                parts.append(part)
            return "".join(parts), at + 1
        n, at = argument(info, at)
        if n > size - at:
            raise bad("unexpected end of data", at)
        try:
            return data[at : at + n].decode(), at + n
        except UnicodeDecodeError:
            raise bad("text is not UTF-8", at + n) from None

    def ended(at: int) -> bool:
        if at >= size:
            raise bad("an indefinite item does not end", at)
        return data[at] == 0xFF

    def simple(info: int, at: int):
        if info in (20, 21, 22):
            return (False, True, None)[info - 20], at
        if info not in (25, 26, 27):
            raise bad(f"simple value {info} is no JSON value", at)
        width = (2, 4, 8)[info - 25]
        if width > size - at:
            raise bad("unexpected end of data", at)
        number = struct.unpack_from((">e", ">f", ">d")[info - 25], data, at)[0]
        if not math.isfinite(number):
            raise invalid_input("a number that is not finite has no JSON form")
        return number, at + width

    def first(at: int, depth: int) -> int:
        if depth > limits.depth:
            raise CodecError("ERR_RESOURCE_LIMIT", "items are nested deeper than the limit", at)
        if at >= size:
            raise bad("unexpected end of data", at)
        return data[at]

    def counted(n: int, at: int) -> None:
        if n > limits.items:
            raise CodecError("ERR_RESOURCE_LIMIT", "a container has more items than the limit", at)

    def value(at: int, depth: int):
        byte = first(at, depth)
        major, info, at = byte >> 5, byte & 31, at + 1
        if major == 3:
            return text(info, at)
        if major == 7:
            return simple(info, at)
        if major in (2, 6):
            raise invalid_input("bytes and tags have no JSON form")
        if major < 2:
            n, at = argument(info, at)
            if n >= INT64:
                raise invalid_input("an integer beyond 64 bits has no JSON form") if major == 0 else bad("the negative integer is below 64 bits", at)
            return (-1 - n if major else n), at
        n, out, k = None, [] if major == 4 else {}, 0
        if not open_ended(info, at):
            n, at = argument(info, at)
            counted(n, at)
            if n > (size - at) // (major - 3):
                raise bad("a container's length goes beyond the data", at)
        while k != n:
            if n is None:
                if ended(at):
                    return out, at + 1
                counted(k + 1, at)
            k += 1
            if major == 4:
                item, at = value(at, depth + 1)
                out.append(item)
                continue
            byte = first(at, depth + 1)
            if byte >> 5 != 3:
                raise invalid_input("a JSON object needs string keys")
            key, at = text(byte & 31, at + 1)
            item, at = value(at, depth + 1)
            if key in out:
                raise invalid_input(f"duplicate key {key!r}")
            out[key] = item
        return out, at

    if size > limits.input_bytes:
        raise CodecError("ERR_RESOURCE_LIMIT", "the input is longer than the limit", limits.input_bytes)
    found, end = value(at, depth)
    if end != size:
        raise bad("data goes on after the item", end)
    return found


class _Odd(Exception):
    """Data that read_plain leaves to the Reader."""


#: How deep read_plain may recurse, and its parts: the least argument of each width, and the heads and formats of floats.
PLAIN_DEPTH, LEAST = 256, {24: 24, 25: 1 << 8, 26: 1 << 16, 27: 1 << 32}
FLOATS = {25: (2, ">e"), 26: (4, ">f"), 27: (8, ">d")}


def read_plain(data: bytes, limits: Limits, policy: Policy):
    """The value of data that keeps the limits and the policy and has definite lengths, without nodes; anything else raises."""
    size, most, items = len(data), limits.depth, limits.items
    strict = {m: policy.reject_length_widths if 2 <= m <= 5 else policy.reject_integer_widths for m in range(7)}

    def value(at: int, depth: int):
        if depth > most:
            raise _Odd
        major, n = data[at] >> 5, data[at] & 31
        at += 1
        if major == 7:
            if 20 <= n <= 22:
                return (False, True, None)[n - 20], at
            if n not in FLOATS or policy.reject_float_widths:
                raise _Odd
            width, kind = FLOATS[n]
            if width > size - at:
                raise _Odd
            return struct.unpack_from(kind, data, at)[0], at + width
        if n > 23:
            if n > 27:
                raise _Odd
            info, end = n, at + (1 << n - 24)
            n = int.from_bytes(data[at:end], "big")
            if end > size or strict[major] and n < LEAST[info]:
                raise _Odd
            at = end
        if major == 3 or major == 2:
            end = at + n
            if end > size:
                raise _Odd
            return (data[at:end].decode() if major == 3 else data[at:end]), end
        if major == 0:
            return n, at
        if major == 1:
            if n >= INT64:
                raise _Odd
            return -1 - n, at
        if major == 6:
            inner, at = value(at, depth + 1)
            return Tagged(n, inner), at
        if n > items or n > (size - at) // (major - 3):
            raise _Odd
        out = [] if major == 4 else Pairs()
        for _ in range(n):
            item, at = value(at, depth + 1)
            if major == 5:
                key = item
                item, at = value(at, depth + 1)
                item = key, item
            out.append(item)
        return out, at

    if size > limits.input_bytes or most > PLAIN_DEPTH or limits.reject_duplicate_keys or policy.required_mode:
        raise _Odd
    found, end = value(0, 0)
    if end != size:
        raise _Odd
    return found


def decode(data: bytes, limits: Limits = Limits(), policy: Policy = Policy()):
    """The value; what is not plain is walked, which says where it fails."""
    try:
        return read_plain(data, limits, policy)
    except (_Odd, IndexError, UnicodeDecodeError, RecursionError):
        return Reader(data, limits, policy).read().value


def scan_nodes(data: bytes, limits: Limits = Limits(), policy: Policy = Policy()) -> list[Node]:
    """Every item of the data in order of its offset; breaches of the policy are noted on their nodes."""
    reader = Reader(data, limits, policy, lossless=True)
    reader.read()
    return sorted(reader.nodes, key=lambda n: (n.start, -n.end))
