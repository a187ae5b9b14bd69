"""MessagePack for what JSON can say: null, booleans, integers, doubles, text, arrays and maps; bytes when read."""

from __future__ import annotations

import struct


def packed(x: object) -> bytes:
    if x is None:
        return b"\xc0"
    if isinstance(x, bool):
        return b"\xc3" if x else b"\xc2"
    if isinstance(x, int):
        return _integer(x)
    if isinstance(x, float):
        return b"\xcb" + struct.pack(">d", x)
    if isinstance(x, str):
        raw = x.encode()
        return _head(len(raw), 0xA0, 31, (0xD9, 0xDA, 0xDB)) + raw
    if isinstance(x, list):
        return _head(len(x), 0x90, 15, (None, 0xDC, 0xDD)) + b"".join(map(packed, x))
    if isinstance(x, dict):
        return _head(len(x), 0x80, 15, (None, 0xDE, 0xDF)) + b"".join(packed(k) + packed(v) for k, v in x.items())
    raise TypeError(type(x))


def _head(n: int, short: int, most: int, long: tuple) -> bytes:
    if n <= most:
        return bytes([short | n])
    for mark, form, limit in zip(long, (">B", ">H", ">I"), (1 << 8, 1 << 16, 1 << 32), strict=True):
        if mark is not None and n < limit:
            return bytes([mark]) + struct.pack(form, n)
    raise ValueError("too long")


def _integer(x: int) -> bytes:
    if -32 <= x < 128:
        return struct.pack(">b", x)
    forms = ((0xCC, ">B"), (0xCD, ">H"), (0xCE, ">I"), (0xCF, ">Q")) if x >= 0 else ((0xD0, ">b"), (0xD1, ">h"), (0xD2, ">i"), (0xD3, ">q"))
    for mark, form in forms:
        try:
            return bytes([mark]) + struct.pack(form, x)
        except struct.error:
            continue
    raise ValueError(f"{x} doesn't fit in 64 bits")


NUMBERS = {0xCA: ">f", 0xCB: ">d", 0xCC: ">B", 0xCD: ">H", 0xCE: ">I", 0xCF: ">Q", 0xD0: ">b", 0xD1: ">h", 0xD2: ">i", 0xD3: ">q"}
SIZED = {0xC4: ("bytes", ">B"), 0xC5: ("bytes", ">H"), 0xC6: ("bytes", ">I"), 0xD9: ("text", ">B"), 0xDA: ("text", ">H"), 0xDB: ("text", ">I"), 0xDC: ("array", ">H"), 0xDD: ("array", ">I"), 0xDE: ("map", ">H"), 0xDF: ("map", ">I")}


def unpacked(raw: bytes) -> object:
    at = 0

    def take(n: int) -> bytes:
        nonlocal at
        if at + n > len(raw):
            raise ValueError("the message is cut short")
        at += n
        return raw[at - n : at]

    def sized(kind: str, n: int) -> object:
        if kind == "text":
            return take(n).decode()
        if kind == "bytes":
            return take(n)
        return [one() for _ in range(n)] if kind == "array" else {one(): one() for _ in range(n)}

    def one() -> object:
        mark = take(1)[0]
        if mark < 0x80 or mark >= 0xE0:
            return mark if mark < 0x80 else mark - 256
        if mark < 0xC0:
            return sized("map", mark & 15) if mark < 0x90 else sized("array", mark & 15) if mark < 0xA0 else sized("text", mark & 31)
        if mark in (0xC0, 0xC2, 0xC3):
            return {0xC0: None, 0xC2: False, 0xC3: True}[mark]
        if mark in NUMBERS:
            return struct.unpack(NUMBERS[mark], take(struct.calcsize(NUMBERS[mark])))[0]
        if mark in SIZED:
            kind, form = SIZED[mark]
            return sized(kind, struct.unpack(form, take(struct.calcsize(form)))[0])
        raise ValueError(f"unknown mark {mark:#x}")

    out = one()
    if at != len(raw):
        raise ValueError("there is more after the value")
    return out
