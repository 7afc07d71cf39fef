"""Text forms of fingerprints: Daylight ASCII, hex, 0/1, sparse lists and counted sparse."""

from __future__ import annotations

import struct

ALPHABET = b".0123456789ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz+"
_VALUE = {c: i for i, c in enumerate(ALPHABET)}


def ascii_to_bytes(text: str) -> bytes:
    """Three bytes of each four characters; the final character tells how many bytes of the last three are real."""
    raw = text.encode()
    tail, body = int(chr(raw[-1])), raw[:-1]
    out = bytearray()
    for i in range(0, len(body), 4):
        a, b, c, d = (_VALUE[x] for x in body[i : i + 4])
        v = a << 18 | b << 12 | c << 6 | d
        out += bytes((v >> 16 & 255, v >> 8 & 255, v & 255))
    return bytes(out[: len(out) - 3 + tail] if tail and out else out)


def bytes_to_ascii(data: bytes) -> str:
    tail = len(data) % 3 or 3
    data = data + bytes(3 - tail)
    out = bytearray()
    for i in range(0, len(data), 3):
        v = data[i] << 16 | data[i + 1] << 8 | data[i + 2]
        out += bytes(ALPHABET[v >> s & 63] for s in (18, 12, 6, 0))
    return out.decode() + str(tail)


def dense_from_ascii(text: str) -> list[int]:
    """Numbers of the bits set in ``ascii;nbits;...`` text, the first bit the highest of the first byte."""
    data = ascii_to_bytes(text.split(";")[0])
    return [8 * i + j for i, b in enumerate(data) for j in range(8) if b >> (7 - j) & 1]


def dense_to_ascii(bits: list[int], nbits: int) -> str:
    data = bytearray((nbits + 7) // 8)
    for b in bits:
        data[b >> 3] |= 128 >> (b & 7)
    return f"{bytes_to_ascii(bytes(data))};{nbits};{len(bits)};{nbits};{len(bits)};1"


def dense_from_hex(text: str) -> list[int]:
    data = bytes.fromhex(text)
    return [8 * i + j for i, b in enumerate(data) for j in range(8) if b >> (7 - j) & 1]


def dense_from_01(text: str) -> list[int]:
    return [i for i, c in enumerate(text) if c == "1"]


def dense_from_list(text: str) -> list[int]:
    """``1,3-5`` and the like; what follows ``;`` is the width."""
    out = []
    for part in filter(None, text.split(";")[0].split(",")):
        a, _, b = part.partition("-")
        out += range(int(a), int(b or a) + 1)
    return out


def counted_to_ascii(counts: dict[int, int]) -> str:
    """Groups of four bit numbers, big-endian, and their four counts (at most 255)."""
    items = sorted(counts.items())
    data = b""
    for i in range(0, len(items), 4):
        four = items[i : i + 4] + [(0, 0)] * (4 - len(items[i : i + 4]))
        data += struct.pack(">4I4B", *(b for b, _ in four), *(min(c, 255) for _, c in four))
    return bytes_to_ascii(data) if data else ""


def counted_from_ascii(text: str) -> dict[int, int]:
    out: dict[int, int] = {}
    data = ascii_to_bytes(text) if text else b""
    for i in range(0, len(data) - 19, 20):
        row = struct.unpack(">4I4B", data[i : i + 20])
        out.update({b: c for b, c in zip(row[:4], row[4:]) if c})
    return out
