"""Structural scan of CBOR bytes: is this one well-formed item, how deep, how many items, and where does it fail. Not the decoder: unassigned
simple values pass, negative integers are not bounded, and keys are equal only if their bytes are."""

from __future__ import annotations

from typing import NamedTuple

from .cbor import Limits
from .text import first_invalid_utf8


class Scan(NamedTuple):
    byte_count: int
    is_valid: bool
    first_error_offset: int | None
    max_depth: int
    item_count: int
    error_code: str | None
    message: str | None


class _Stop(Exception):
    def __init__(self, offset: int, message: str, code: str = "ERR_NOT_CBOR"):
        super().__init__(message)
        self.offset, self.message, self.code = offset, message, code


def structural_scan(data: bytes, limits: Limits = Limits()) -> Scan:
    n, at, depth_seen, items = len(data), 0, 0, 0

    def need(k: int, what: str) -> None:
        if k > n - at:
            raise _Stop(n, f"{what} ends too early")

    def argument(info: int) -> int:
        nonlocal at
        if info < 24:
            return info
        if info > 27:
            raise _Stop(at - 1, "additional information is not defined")
        width = 1 << info - 24
        need(width, "an argument")
        at += width
        return int.from_bytes(data[at - width : at], "big")

    def length(info: int, start: int) -> int:
        k = argument(info)
        if k >= 1 << 63:
            raise _Stop(start, "a length is beyond 63 bits")
        return k

    def string(info: int, start: int, text: bool) -> None:
        nonlocal at
        k = length(info, start)
        need(k, "a string")
        if text and (wrong := first_invalid_utf8(data[at : at + k])) is not None:
            raise _Stop(at + wrong, "text is not UTF-8")
        at += k

    def at_break() -> bool:
        if at >= n:
            raise _Stop(n, "an indefinite item does not end")
        return data[at] == 0xFF

    # A frame: [items left or None, is a map, start, depth, items seen, keys' bytes, where the current key starts or None]
    stack: list[list] = []
    try:
        if min(limits.input_bytes, limits.depth, limits.items) < 0:
            raise _Stop(0, "limits must not be negative", "ERR_RESOURCE_LIMIT")
        if n > limits.input_bytes:
            raise _Stop(limits.input_bytes, "the input is longer than the limit", "ERR_RESOURCE_LIMIT")
        while True:
            depth = 0
            if stack:
                f = stack[-1]
                if f[6] is None or not f[1]:
                    if f[0] == 0 or f[0] is None and at_break():
                        at += f[0] is None
                        stack.pop()
                        if not stack:
                            break
                        _done(stack[-1], data, at, limits)
                        continue
                    if f[0] is None:
                        f[4] += 1
                        if f[4] > limits.items:
                            raise _Stop(f[2], "a container has more items than the limit", "ERR_RESOURCE_LIMIT")
                    if f[1]:
                        f[6] = at
                elif at >= n or data[at] == 0xFF:
                    raise _Stop(at, "a map lacks a value")
                depth = f[3] + 1
            start = at
            if depth > limits.depth:
                raise _Stop(start, "items are nested deeper than the limit", "ERR_RESOURCE_LIMIT")
            need(1, "an item")
            major, info = data[at] >> 5, data[at] & 31
            at += 1
            depth_seen, items = max(depth_seen, depth), items + 1
            frame = None
            if major in (2, 3, 4, 5) and info == 31:
                if not limits.allow_indefinite:
                    raise _Stop(start, "indefinite lengths are not allowed")
                if major > 3:
                    frame = [None, major == 5, start, depth, 0, set(), None]
                else:
                    while not at_break():
                        chunk = at
                        if data[at] >> 5 != major or data[at] & 31 == 31:
                            raise _Stop(chunk, "a chunk is of another kind")
                        at += 1
                        string(data[chunk] & 31, chunk, major == 3)
                    at += 1
            elif major in (2, 3):
                string(info, start, major == 3)
            elif major in (4, 5):
                k = length(info, start)
                if k > limits.items:
                    raise _Stop(start, "a container has more items than the limit", "ERR_RESOURCE_LIMIT")
                frame = [k, major == 5, start, depth, 0, set(), None]
            elif major == 7:
                if info > 27:
                    raise _Stop(start, "a simple value is reserved or out of place")
                if info == 24:
                    need(1, "a simple value")
                    at += 1
                    if data[at - 1] < 32:
                        raise _Stop(start, "a two-byte simple value is reserved")
                elif info > 24:
                    need(1 << info - 24, "a number")
                    at += 1 << info - 24
            else:
                argument(info)
                if major == 6:
                    frame = [1, False, start, depth, 0, set(), None]
            if frame:
                stack.append(frame)
            elif not stack:
                break
            else:
                _done(stack[-1], data, at, limits)
        if at != n:
            raise _Stop(at, "data goes on after the item")
    except _Stop as e:
        return Scan(n, False, max(0, min(e.offset, n)), depth_seen, items, e.code, e.message)
    return Scan(n, True, None, depth_seen, items, None, None)


def _done(frame: list, data: bytes, at: int, limits: Limits) -> None:
    """An item inside the frame has ended: it was a map's key, or an entry is complete."""
    if frame[1] and not (len(frame) > 7 and frame[7]):
        if limits.reject_duplicate_keys:
            key = data[frame[6] : at]
            if key in frame[5]:
                raise _Stop(frame[6], "a map has the same key bytes twice")
            frame[5].add(key)
        frame[7:] = [True]
        return
    frame[6], frame[7:] = None, []
    if frame[0] is not None:
        frame[0] -= 1
