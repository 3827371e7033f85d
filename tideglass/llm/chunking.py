"""Content-defined cuts by a rolling gear hash."""

from __future__ import annotations

import numpy as np

from .common import random_table

#: One 16-bit value for each byte, by rule; 255, which no UTF-8 text holds, has 0 and so resets nothing.
GEAR = (random_table(256, 3) >> np.uint64(48)).astype(np.uint16)
GEAR[255] = 0
#: Bytes that the hash depends on: each step shifts it left by one of its 16 bits.
WINDOW = 16


def gear(buf: np.ndarray) -> np.ndarray:
    """Rolling gear hash at every byte: h = (h << 1) + GEAR[byte], by doubling the window."""
    h, width = GEAR[buf], 1
    while width < WINDOW:
        older = np.zeros_like(h)
        older[width:] = h[:-width]
        h = h + (older << np.uint16(width))
        width *= 2
    return h


def cuts(texts: list[bytes], bits: int, least: int, most: int, characters: bool = True) -> list[list[int]]:
    """Ends of the chunks of each text.

    A cut falls after a byte whose hash has `bits` zero top bits, at least `least` bytes after the
    last one, and `most` bytes after it at the latest; with `characters`, never inside a UTF-8
    character (a forced cut then comes up to three bytes earlier).  Cuts depend on the last 16
    bytes only, so they fall into step again after an insertion.  An empty text has no chunk.
    """
    gap = b"\xff" * WINDOW
    buf = np.frombuffer(gap + gap.join(texts) + gap, np.uint8)
    mark = gear(buf) < (1 << (16 - bits))
    if characters:
        mark[:-1] &= (buf[1:] & 0xC0) != 0x80
    places = np.flatnonzero(mark) + 1
    starts = np.cumsum([WINDOW] + [len(t) + WINDOW for t in texts])
    lo = np.searchsorted(places, starts[:-1], "right")
    hi = np.searchsorted(places, starts[1:] - WINDOW, "left")
    out = []
    for k, t in enumerate(texts):
        ends, last, n, base = [], 0, len(t), int(starts[k])
        for c in (places[lo[k] : hi[k]] - base).tolist():
            while c - last > most:
                last = _forced(t, last, most, characters)
                ends.append(last)
            if c - last >= least:
                ends.append(c)
                last = c
        while n - last > most:
            last = _forced(t, last, most, characters)
            ends.append(last)
        if n > last:
            ends.append(n)
        out.append(ends)
    return out


def _forced(text: bytes, last: int, most: int, characters: bool) -> int:
    end = last + most
    if characters:
        while end > last + most - 3 and text[end] & 0xC0 == 0x80:
            end -= 1
    return end
