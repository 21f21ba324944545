"""Decoding of PNG bytes at full depth.

Spark's image reader keeps only the low byte of 16-bit samples, so radiometric
frames are decoded here instead. A helper for the reader in ``images``.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

SIGNATURE = b"\x89PNG\r\n\x1a\n"
# Samples per pixel of the grey, RGB, grey+alpha and RGBA types.
CHANNELS = {0: 1, 2: 3, 4: 2, 6: 4}


def decode(data: bytes) -> np.ndarray | None:
    """``[h, w]`` or BGR(A) ``[h, w, c]``; None when not a plain PNG of 8 or 16 bits."""
    try:
        return _decode(data)
    except (struct.error, zlib.error, ValueError, KeyError):
        return None


def _decode(data: bytes) -> np.ndarray | None:
    if data[:8] != SIGNATURE:
        return None
    at, body, head = 8, [], None
    while at < len(data):
        size, kind = struct.unpack(">I4s", data[at : at + 8])
        chunk = data[at + 8 : at + 8 + size]
        if kind == b"IHDR":
            head = struct.unpack(">IIBBBBB", chunk)
        elif kind == b"IDAT":
            body.append(chunk)
        at += size + 12
    if head is None or head[2] not in (8, 16) or head[6] != 0:
        return None
    width, height, depth, colour = head[:4]
    channels, size = CHANNELS[colour], depth // 8
    stride = width * channels * size
    rows = np.frombuffer(zlib.decompress(b"".join(body)), np.uint8).reshape(height, stride + 1)
    plain = _unfilter(rows[:, 0], rows[:, 1:], channels * size)
    image = plain.reshape(height, width, channels, size).astype(np.uint16)
    image = image[..., 0] if size == 1 else image[..., 0] * 256 + image[..., 1]
    if colour in (2, 6):
        image[..., :3] = image[..., 2::-1].copy()
    if colour == 4:
        image = image[..., :1]
    image = image.astype(np.uint8 if depth == 8 else np.uint16)
    return image[..., 0] if image.shape[2] == 1 else image


def _unfilter(kinds: np.ndarray, rows: np.ndarray, step: int) -> np.ndarray:
    """Undo the per-row prediction, one anti-diagonal of pixels at a time.

    A pixel needs its left, upper and upper-left neighbours only, so pixels with
    one sum of row and column are independent of each other.
    """
    if kinds.size and kinds.max() > 4:
        raise ValueError(f"unknown filter {kinds.max()}")
    height, width = len(rows), rows.shape[1] // step
    delta = rows.reshape(height, width, step).astype(np.int16)
    # One row and column of zeros in front stand for what lies outside.
    out = np.zeros((height + 1, width + 1, step), np.int16)
    for d in range(height + width - 1):
        y = np.arange(max(0, d - width + 1), min(height, d + 1))
        x = d - y
        left, up, corner = out[y + 1, x], out[y, x + 1], out[y, x]
        # Distances of left + up - corner to each of the three.
        to_left, to_up, to_corner = abs(up - corner), abs(left - corner), abs(left + up - 2 * corner)
        nearest = np.where((to_left <= to_up) & (to_left <= to_corner), left, np.where(to_up <= to_corner, up, corner))
        guess = np.choose(kinds[y][:, None], [np.zeros_like(left), left, up, (left + up) // 2, nearest])
        out[y + 1, x + 1] = (delta[y, x] + guess) & 255
    return out[1:, 1:].reshape(height, -1).astype(np.uint8)
