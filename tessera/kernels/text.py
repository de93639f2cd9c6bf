"""Byte and text codecs: UTF-8 validation with offsets, multibase, base58, LEB128."""

from __future__ import annotations

import base64
import re

from ..errors import CodecError, invalid_input

#: The alphabets.
BASE58 = "123456789ABCDEFGHJKLMNPQRSTUVWXYZabcdefghijkmnopqrstuvwxyz"
BASE64 = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/"
PREFIXES = {"z": "base58btc", "u": "base64url", "M": "base64"}


def first_invalid_utf8(data: bytes) -> int | None:
    """None if valid. A sequence that is cut off is wrong at its lead, even if its next byte is wrong too; else at the byte that is wrong."""
    try:
        data.decode()
        return None
    except UnicodeDecodeError as e:
        lead = e.start
    first = data[lead]
    size = 2 if 0xC2 <= first <= 0xDF else 3 if 0xE0 <= first <= 0xEF else 4 if 0xF0 <= first <= 0xF4 else 0
    if size == 0 or len(data) - lead < size:
        return lead
    low = {0xE0: 0xA0, 0xF0: 0x90}.get(first, 0x80)
    high = {0xED: 0x9F, 0xF4: 0x8F}.get(first, 0xBF)
    if not low <= data[lead + 1] <= high:
        return lead + 1
    return next(i for i in range(lead + 2, lead + size) if data[i] & 0xC0 != 0x80)


def base58_encode(data: bytes) -> str:
    zeros = len(data) - len(data.lstrip(b"\0"))
    n, out = int.from_bytes(data, "big"), []
    while n:
        n, r = divmod(n, 58)
        out.append(BASE58[r])
    return "1" * zeros + "".join(reversed(out))


def base58_decode(text: str) -> bytes:
    n = 0
    for i, c in enumerate(text):
        if (k := BASE58.find(c)) < 0:
            raise CodecError("ERR_INVALID_INPUT", "a character is not in the alphabet", i)
        n = n * 58 + k
    zeros = len(text) - len(text.lstrip("1"))
    return b"\0" * zeros + n.to_bytes((n.bit_length() + 7) // 8, "big")


def base64url(data: bytes) -> str:
    return base64.urlsafe_b64encode(data).decode().rstrip("=")


def base64_strict(text: str) -> bytes | None:
    """Padded standard base64, or None."""
    try:
        return base64.b64decode(text, validate=True)
    except ValueError:
        return None


def multibase_encode(data: bytes, kind: str) -> str:
    if kind == "z":
        return "z" + base58_encode(data)
    plain = base64.b64encode(data).decode().rstrip("=")
    return kind + (plain.translate(str.maketrans("+/", "-_")) if kind == "u" else plain)


def multibase_decode(text: str, most: int = 64 << 20) -> tuple[bytes | None, int | None, str | None]:
    """(bytes, None, None), or (None, offset of the fault, message). Alphabets are strict; there is no padding."""
    raw = text.encode()
    if len(raw) > most:
        return None, most, "the value is longer than the limit"
    kind = text[:1]
    if kind not in PREFIXES:
        return None, 0, "the prefix is not supported"
    body = text[1:]
    if kind == "z":
        wrong = re.search(f"[^{BASE58}]", body)
    else:
        wrong = re.search("[^A-Za-z0-9_-]" if kind == "u" else "[^A-Za-z0-9+/]", body)
    if wrong:
        return None, len(text[: 1 + wrong.start()].encode()), "a character is not in the alphabet"
    if kind == "z":
        out = base58_decode(body)
    elif len(body) % 4 == 1:
        return None, len(body) + 1, "the length is not possible"
    else:
        out = base64.b64decode(body.translate(str.maketrans("-_", "+/")) + "=" * (-len(body) % 4))
    return (None, most, "the value is longer than the limit") if len(out) > most else (out, None, None)


def varint_encode(n: int) -> bytes:
    if not 0 <= n < 1 << 64:
        raise CodecError("ERR_INTEGER_OVERFLOW", "only 64 unsigned bits can be encoded")
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    return bytes([*out, n])


def varint_decode(data: bytes) -> tuple[int | None, int, int | None, str | None]:
    """(value, bytes used, offset of the fault, message). Encodings need not be the shortest; all bytes must belong to the number."""
    n = 0
    for i, b in enumerate(data):
        if i > 9:
            return None, i, i, "the value is beyond 64 bits"
        if i == 9 and b & 127 > 1:
            return None, i + 1, i, "the value is beyond 64 bits"
        n |= (b & 127) << 7 * i
        if b < 128:
            return (n, i + 1, None, None) if i + 1 == len(data) else (None, i + 1, i + 1, "data goes on after the number")
    return None, len(data), max(0, len(data) - 1), "the number does not end"


def registry_varint(n: int) -> bytes:
    return varint_encode(n)


def registry_varint_decode(data: bytes) -> int:
    """The varint of an envelope: fewer than 24 bytes, bits beyond the 64th are lost."""
    if not 0 < len(data) < 24 or data[-1] & 128 or any(not b & 128 for b in data[:-1]):
        raise CodecError("ERR_NOT_CBORLD", "the registry entry id is not a varint")
    n = 0
    for i, b in enumerate(data):
        if 7 * i >= 64:
            raise CodecError("ERR_NOT_CBORLD", "the registry entry id is beyond 64 bits")
        n |= (b & 127) << 7 * i
    return n & (1 << 64) - 1


def uuid_bytes(text: str) -> bytes:
    plain = text.replace("-", "")
    if not re.fullmatch("[0-9a-fA-F]{32}", plain):
        raise invalid_input(f"{text!r} is not a UUID")
    return bytes.fromhex(plain)


def uuid_text(data: bytes) -> str:
    h = data.hex()
    return "-".join((h[:8], h[8:12], h[12:16], h[16:20], h[20:]))
