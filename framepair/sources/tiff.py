"""Decoding of plain TIFF bytes at full depth: strips of 8 or 16 bits, stored or deflated.

Radiometric cameras write these, and Spark's image reader has no TIFF.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

# The tags and field types of the format that are used here.
WIDTH, HEIGHT, BITS, COMPRESSION, OFFSETS, SAMPLES, COUNTS, PLANAR, PREDICTOR = 256, 257, 258, 259, 273, 277, 279, 284, 317
FIELDS = {1: "B", 3: "H", 4: "I"}
STORED, DEFLATED = (1,), (8, 32946)


def decode(data: bytes) -> np.ndarray | None:
    """``[h, w]`` or BGR(A) ``[h, w, c]`` of the first image; None when it is another kind of file."""
    try:
        return _decode(data)
    except (struct.error, zlib.error, ValueError, KeyError, IndexError):
        return None


def _tags(data: bytes, order: str) -> dict[int, tuple[int, ...]]:
    start = struct.unpack(f"{order}I", data[4:8])[0]
    n = struct.unpack(f"{order}H", data[start : start + 2])[0]
    out = {}
    for i in range(n):
        entry = data[start + 2 + 12 * i : start + 14 + 12 * i]
        tag, kind, count = struct.unpack(f"{order}HHI", entry[:8])
        if kind in FIELDS:
            code = f"{order}{count}{FIELDS[kind]}"
            size = struct.calcsize(code)
            at = struct.unpack(f"{order}I", entry[8:])[0]
            out[tag] = struct.unpack(code, entry[8 : 8 + size] if size <= 4 else data[at : at + size])
    return out


def _decode(data: bytes) -> np.ndarray | None:
    order = {b"II*\0": "<", b"MM\0*": ">"}.get(data[:4])
    if order is None:
        return None
    tags = _tags(data, order)
    one = lambda tag, default=None: tags.get(tag, (default,))[0]
    channels, bits, packing = one(SAMPLES, 1), set(tags.get(BITS, (1,))), one(COMPRESSION, 1)
    if bits not in ({8}, {16}) or channels not in (1, 3, 4) or one(PLANAR, 1) != 1 or packing not in STORED + DEFLATED:
        return None
    strips = [data[a : a + n] for a, n in zip(tags[OFFSETS], tags[COUNTS], strict=True)]
    raw = b"".join(zlib.decompress(s) if packing in DEFLATED else s for s in strips)
    kind = np.dtype(np.uint8 if bits == {8} else f"{order}u2")
    image = np.frombuffer(raw, kind).reshape(one(HEIGHT), one(WIDTH), channels).astype(kind.newbyteorder("="))
    if one(PREDICTOR, 1) == 2:
        image = np.add.accumulate(image, axis=1, dtype=image.dtype)
    if channels == 1:
        return image[..., 0]
    return np.concatenate([image[..., 2::-1], image[..., 3:]], axis=2)
