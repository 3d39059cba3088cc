"""A cover sample chosen by content: in every string of SPAN bytes the K-byte string with the least hash is sampled.

Equal strings of SPAN bytes so have a sampled position at the same place, as they have in a difference cover, but one in
about (SPAN - K) / 2 positions is sampled, and each string needs one sampled position only.
"""

from __future__ import annotations

import numpy as np

from paperloom.llm.hashing import Substrings

SPAN, K = 100, 32
#: A string of SPAN bytes holds so many bytes on one side of its sampled K bytes at least.
HALF = (SPAN - K) // 2
#: Positions looked at together; a longer text is taken in pieces that overlap by SPAN - 1 bytes.
PIECE = 1 << 21
_BITS = PIECE.bit_length() + 1
_U = np.uint64


def cover(data: np.ndarray, begins: np.ndarray) -> dict[str, np.ndarray]:
    """For each sampled position of each text: doc, first start and number of the strings that it stands for (a run of
    neighbouring starts), its distance from the first start, the hash of its K bytes, the hash of all their bytes, and a
    byte of the hash of the HALF bytes to the left and to the right of its K bytes (as far as the text goes)."""
    parts = []
    k = 0
    n = len(begins) - 1
    while k < n:
        stop = max(k + 1, int(np.searchsorted(begins, begins[k] + PIECE, side="right")) - 1)
        if stop == k + 1 and begins[stop] - begins[k] > PIECE:
            for at in range(int(begins[k]), int(begins[stop]) - SPAN + 1, PIECE - SPAN + 1):
                end = min(at + PIECE, int(begins[stop]))
                parts.append(_cover(data[at:end], np.array([0, end - at]), k, at - int(begins[k])))
        else:
            parts.append(_cover(data[begins[k] : begins[stop]], begins[k : stop + 1] - begins[k], k, 0))
        k = stop
    return {name: np.concatenate([p[name] for p in parts]) for name in parts[0]} if parts else _cover(data[:0], np.zeros(1, np.int64), 0, 0)


def _cover(data: np.ndarray, begins: np.ndarray, doc0: int, shift: int) -> dict[str, np.ndarray]:
    none = {"doc": np.zeros(0, np.int64), "start": np.zeros(0, np.int64), "count": np.zeros(0, np.int64), "off": np.zeros(0, np.int64), "gram": np.zeros(0, _U), "all": np.zeros(0, _U), "left": np.zeros(0, np.uint8), "right": np.zeros(0, np.uint8)}
    m = len(data) - SPAN + 1
    if m <= 0:
        return none
    strings = Substrings(data)
    at = np.arange(len(data) - K + 1)
    least = (strings.of(at, at + K) >> _U(_BITS) << _U(_BITS)) | at.astype(_U)
    wide, width = SPAN - K + 1, 1
    while width * 2 <= wide:
        least = np.minimum(least[:-width], least[width:])
        width *= 2
    if wide > width:
        least = np.minimum(least[: -(wide - width)], least[wide - width :])
    p = (least & _U((1 << _BITS) - 1)).astype(np.int64)
    # Starts from which SPAN bytes stay within a text.
    lengths = np.diff(begins)
    doc = np.repeat(np.arange(len(lengths)), lengths)[:m]
    valid = np.arange(m) + SPAN <= begins[doc + 1]
    head = np.ones(m, bool)
    head[1:] = (p[1:] != p[:-1]) | (doc[1:] != doc[:-1])
    head &= valid
    tail = np.ones(m, bool)
    tail[:-1] = (p[1:] != p[:-1]) | (doc[1:] != doc[:-1]) | ~valid[1:]
    tail &= valid
    first, last = np.flatnonzero(head), np.flatnonzero(tail)
    if not len(first):
        return none
    spot, own = p[first], doc[first]
    left = strings.of(np.maximum(spot - HALF, begins[own]), spot).astype(np.uint8)
    right = strings.of(spot + K, np.minimum(spot + K + HALF, begins[own + 1])).astype(np.uint8)
    return {
        "doc": doc[first] + doc0, "start": first - begins[doc[first]] + shift, "count": last - first + 1, "off": spot - first,
        "gram": strings.of(spot, spot + K), "all": strings.of(first, last + SPAN) + (spot - first).astype(_U), "left": left, "right": right,
    }
