"""Reading and writing of the binary wire: varints, zigzag, fixed 64-bit and length-delimited fields."""

from __future__ import annotations

import struct

VARINT, FIXED64, DELIMITED, FIXED32 = 0, 1, 2, 5


def varint(n: int) -> bytes:
    out = bytearray()
    while n > 0x7F:
        out.append(n & 0x7F | 0x80)
        n >>= 7
    out.append(n)
    return bytes(out)


def read_varint(b: bytes, at: int) -> tuple[int, int]:
    """The number at a place, and the place after it."""
    n = shift = 0
    while True:
        if at >= len(b):
            raise ValueError("the bytes end within a varint")
        x = b[at]
        at += 1
        n |= (x & 0x7F) << shift
        if x < 0x80:
            return n, at
        shift += 7
        if shift > 63:
            raise ValueError("a varint is longer than 64 bits")


def signed(n: int, bits: int) -> int:
    n &= (1 << bits) - 1
    return n - (1 << bits) if n >> (bits - 1) else n


def zigzag(n: int) -> int:
    return (n << 1 ^ n >> 63) & (1 << 64) - 1


def unzigzag(n: int) -> int:
    return n >> 1 ^ -(n & 1)


def fields(b: bytes):
    """Number, wire type and value of each field of a message: an int, or bytes."""
    at = 0
    while at < len(b):
        tag, at = read_varint(b, at)
        number, kind = tag >> 3, tag & 7
        if kind == VARINT:
            value, at = read_varint(b, at)
        elif kind in (FIXED64, FIXED32):
            size = 8 if kind == FIXED64 else 4
            if at + size > len(b):
                raise ValueError("the bytes end within a field")
            value, at = int.from_bytes(b[at : at + size], "little"), at + size
        elif kind == DELIMITED:
            n, at = read_varint(b, at)
            if at + n > len(b):
                raise ValueError("the bytes end within a field")
            value, at = b[at : at + n], at + n
        else:
            raise ValueError(f"unknown wire type {kind}")
        yield number, kind, value


def field(number: int, kind: int, value: int | bytes) -> bytes:
    tag = varint(number << 3 | kind)
    if kind == VARINT:
        return tag + varint(value)
    if kind == FIXED64:
        return tag + struct.pack("<Q", value & (1 << 64) - 1)
    return tag + varint(len(value)) + value
