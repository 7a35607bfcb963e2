"""Camera, time and place out of a picture's bytes: a walk over its TIFF directories, batch by batch.

A JPEG holds a TIFF block in a segment of its own; a TIFF file is one. The block gives its byte order and the place of its first directory; a
directory is a list of entries (tag, type, count, value or the value's place), and two of its entries lead to further directories. What lies outside the
block, is of an unknown type or leads back to a directory that has been read gives nothing.
"""

from __future__ import annotations

import struct
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Sizes and codes of the entry types (bytes, text, shorts, longs, rationals and their signed kin), and the tags.
TYPES = {1: (1, "B"), 2: (1, "c"), 3: (2, "H"), 4: (4, "I"), 5: (8, "I"), 6: (1, "b"), 7: (1, "c"), 8: (2, "h"), 9: (4, "i"), 10: (8, "i")}
DETAILS, GPS = 0x8769, 0x8825
MAKE, MODEL, ORIENTATION, CHANGED, TAKEN, ZONE = 0x010F, 0x0110, 0x0112, 0x0132, 0x9003, 0x9011
EXPOSURE, APERTURE, SENSITIVITY, FOCAL, WIDTH, HEIGHT = 0x829A, 0x829D, 0x8827, 0x920A, 0xA002, 0xA003
LAT_REF, LAT, LON_REF, LON = 1, 2, 3, 4
#: Entries of a directory, and values of an entry, that are read at most: more is damage.
MOST = 4096
FACTS = "make string, model string, orientation int, taken string, zone string, exposure double, aperture double, sensitivity int, focal double, width int, height int, lat double, lon double"

Entries = dict[int, object]


def tiff_block(content: bytes) -> bytes | None:
    """The TIFF block of a JPEG or TIFF."""
    if content[:4] in (b"II*\0", b"MM\0*"):
        return content
    at = 2
    while content[:2] == b"\xff\xd8" and at + 4 <= len(content) and content[at] == 0xFF:
        kind, size = content[at + 1], int.from_bytes(content[at + 2 : at + 4], "big")
        if kind == 0xE1 and content[at + 4 : at + 10] == b"Exif\0\0":
            return content[at + 10 : at + 2 + size]
        if kind == 0xDA or size < 2:  # pixels begin
            return None
        at += 2 + size
    return None


def directory(block: bytes, order: str, at: int) -> Entries:
    """Tag to value of the directory at a place: text, a number or a tuple of numbers; rationals as quotients."""
    out: Entries = {}
    if at + 2 > len(block):
        return out
    (count,) = struct.unpack_from(order + "H", block, at)
    for k in range(min(count, MOST)):
        entry = at + 2 + 12 * k
        if entry + 12 > len(block):
            break
        tag, kind, n = struct.unpack_from(order + "HHI", block, entry)
        if kind not in TYPES or not 0 < n <= MOST:
            continue
        size, code = TYPES[kind]
        place = entry + 8 if size * n <= 4 else struct.unpack_from(order + "I", block, entry + 8)[0]
        if place + size * n > len(block):
            continue
        if code == "c":
            out.setdefault(tag, block[place : place + n].split(b"\0")[0].decode("utf-8", "replace").strip())
            continue
        values = struct.unpack_from(f"{order}{n * size // struct.calcsize(code)}{code}", block, place)
        if size == 8:
            values = tuple(a / b if b else None for a, b in zip(values[::2], values[1::2], strict=True))
        out.setdefault(tag, values if n > 1 else values[0])
    return out


def _degrees(parts: object, side: object, limit: float) -> float | None:
    if not isinstance(parts, tuple) or not isinstance(side, str) or len(parts) < 3 or None in parts[:3] or not side:
        return None
    value = parts[0] + parts[1] / 60 + parts[2] / 3600
    return (-value if side[0].upper() in "SW" else value) if value <= limit else None


def facts(content: bytes | None) -> tuple:
    """The columns of FACTS, null where a picture doesn't tell."""
    block = tiff_block(bytes(content)) if content else None
    own: Entries = {}
    place: Entries = {}
    if block is not None and len(block) >= 8 and block[:2] in (b"II", b"MM"):
        order = "<" if block[:2] == b"II" else ">"
        seen: set[int] = set()

        def read(at: object) -> Entries:
            if not isinstance(at, int) or at in seen or at < 8:
                return {}
            seen.add(at)
            return directory(block, order, at)

        own = read(struct.unpack_from(order + "I", block, 4)[0])
        place = read(own.get(GPS))
        own = own | read(own.get(DETAILS))
    text = lambda tag: own[tag] if isinstance(own.get(tag), str) and own[tag] else None
    number = lambda tag: float(own[tag]) if isinstance(own.get(tag), int | float) else None
    whole = lambda tag: int(own[tag]) if isinstance(own.get(tag), int) and own[tag] < 1 << 31 else None
    return (
        text(MAKE), text(MODEL), whole(ORIENTATION), text(TAKEN) or text(CHANGED), text(ZONE), number(EXPOSURE), number(APERTURE), whole(SENSITIVITY), number(FOCAL),
        whole(WIDTH), whole(HEIGHT), _degrees(place.get(LAT), place.get(LAT_REF), 90), _degrees(place.get(LON), place.get(LON_REF), 180),
    )


def picture_facts(df: DataFrame, content: str, *keep: str | Column) -> DataFrame:
    """(*keep, columns of FACTS) of pictures with their bytes in the column `content`; a null gives nulls. Time is as the camera wrote it."""

    @F.pandas_udf(f"struct<{FACTS.replace(' ', ':').replace(',:', ',')}>")
    def read(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for column in batches:
            yield pd.DataFrame([facts(c) for c in column], columns=[c.split()[0] for c in FACTS.split(", ")], dtype=object)

    return df.select(*keep, read(F.col(content)).alias("_facts")).select(*keep, "_facts.*")
