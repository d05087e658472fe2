"""Pieces of DuckDB SQL that the queries' SQL shares."""

from __future__ import annotations


def _table() -> list[int]:
    """The bytewise table of the CRC-32 polynomial."""
    out = []
    for b in range(256):
        for _ in range(8):
            b = b >> 1 ^ (0xEDB88320 if b & 1 else 0)
        out.append(b)
    return out


def crc32(text: str) -> str:
    """SQL for the unsigned CRC-32 of a string whose code points are below 2048."""
    points = f"list_transform(list_filter(string_split({text}, ''), lambda c: c <> ''), lambda c: unicode(c))"
    octets = f"flatten(list_transform({points}, lambda p: CASE WHEN p < 128 THEN [p] ELSE [192 | (p >> 6), 128 | (p & 63)] END))"
    step = f"lambda c, b: xor(list_extract({_table()}::BIGINT[], (xor(c, b) & 255) + 1), c >> 8)"
    return f"xor(list_reduce({octets}::BIGINT[], {step}, 4294967295::BIGINT), 4294967295::BIGINT)"
