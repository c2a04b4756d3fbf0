"""64-bit hashes of words and word runs, computed over whole Arrow buffers at once.

The hash of a word is a polynomial over its bytes modulo 2**64, mixed afterwards; the prefix
sums of all bytes give every word's value by one subtraction, so no Python code runs per word.
"""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_INVERSE = np.uint64(pow(int(_BASE), -1, 1 << 64))
_STEP = np.uint64(0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _ladder(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse, 0 to n."""
    size = 1 << max(16, int(n).bit_length())
    if size not in _powers:
        _powers.clear()
        up, down = np.full(size, _BASE), np.full(size, _INVERSE)
        up[0] = down[0] = 1
        _powers[size] = np.cumprod(up), np.cumprod(down)
    return _powers[size]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit values that spreads every bit (the finaliser of SplitMix64)."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


#: ASCII white space: 0x09 to 0x0D and 0x20.
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


#: First and last code points of scripts that are written without spaces between words; of these, scripts that set a space between sentences; marks that end a sentence.
_UNSPACED = ((0x0E00, 0x0E7F), (0x0E80, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF), (0x3001, 0x30FF), (0x31F0, 0x31FF), (0x3400, 0x4DBF), (0x4E00, 0x9FFF), (0xF900, 0xFAFF), (0xFF01, 0xFF0F), (0xFF1A, 0xFF20), (0xFF61, 0xFF9F), (0x20000, 0x3FFFF))
_SPACED_SENTENCES = ((0x0E00, 0x0E7F), (0x0E80, 0x0EFF), (0x1000, 0x109F), (0x1780, 0x17FF))
_STOPS = (0x3002, 0xFF01, 0xFF0E, 0xFF1F, 0xFF61, 0x104B, 0x17D4)


def unspaced(raw: np.ndarray) -> np.ndarray | None:
    """Of each byte 0, or where a character of a script without spaces begins 1, in a script with spaces between sentences 2, and 3 for a mark that ends a sentence; None if there is none."""
    leads = np.flatnonzero(raw >= 0xE0)
    leads = leads[leads + 3 <= len(raw)]
    if not len(leads):
        return None
    b = [raw[leads + k].astype(np.int64) & 63 for k in (1, 2)]
    point = ((raw[leads].astype(np.int64) & 15) << 12) | (b[0] << 6) | b[1]
    four = raw[leads] >= 0xF0
    # Of four bytes the last six bits do not matter here.
    point[four] = ((raw[leads[four]].astype(np.int64) & 7) << 18) | (b[0][four] << 12) | (b[1][four] << 6)
    within = lambda ranges: np.logical_or.reduce([(point >= low) & (point <= high) for low, high in ranges])
    kind = within(_UNSPACED).astype(np.int8)
    if not kind.any():
        return None
    kind[within(_SPACED_SENTENCES)] = 2
    kind[np.isin(point, _STOPS)] = 3
    out = np.zeros(len(raw), np.int8)
    out[leads] = kind
    return out


def words(raw: np.ndarray, offsets: np.ndarray, separators: np.ndarray = _SPACE, lower: bool = True, scripts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte, row) of every word of the rows in a slice.

    A word is a maximal run of bytes that are no separators, within one row; A-Z count as a-z if
    lower is set. Characters that `scripts`, of unspaced(), tells are words of their own.
    """
    n = len(raw)
    if not n:
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none
    word = ~separators[raw]
    begins = word.copy()
    begins[1:] &= ~word[:-1]
    inner = offsets[1:-1]
    inner = inner[(inner > 0) & (inner < n)]
    begins[inner] = word[inner]
    if scripts is not None:
        alone = np.flatnonzero(scripts)
        begins[alone] = word[alone]
        after = alone + 3 + (raw[alone] >= 0xF0)
        after = after[after < n]
        begins[after] |= word[after]
    starts = np.flatnonzero(begins)
    if not len(starts):
        none = np.empty(0, np.int64)
        return np.empty(0, np.uint64), none, none, none
    # A word ends at the next separator or at the next start, whichever comes first.
    gaps = np.flatnonzero(~word)
    nexts = np.append(starts[1:], n)
    ends = np.append(gaps, n)[np.searchsorted(gaps, starts)]
    ends = np.minimum(ends, nexts)
    up, down = _ladder(n + 1)
    values = (_LOWER[raw] if lower else raw).astype(np.uint64)
    values += np.uint64(1)
    values *= up[:n]
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(values, out=sums[1:])
    hashes = (sums[ends] - sums[starts]) * down[starts]
    hashes += (ends - starts).astype(np.uint64) * _STEP
    rows = np.searchsorted(offsets, starts, side="right") - 1
    return mix(hashes), starts, ends, rows


def runs(hashes: np.ndarray, rows: np.ndarray, n_rows: int, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash, row, word index) of every run of `width` words within a row; a shorter row gives one run of all its words."""
    counts = np.bincount(rows, minlength=n_rows) if len(rows) else np.zeros(n_rows, np.int64)
    firsts = np.concatenate(([0], np.cumsum(counts)))
    n = len(hashes)
    found, at = [], []
    if n >= width:
        whole = np.flatnonzero(rows[: n - width + 1] == rows[width - 1 :])
        total = np.zeros(len(whole), np.uint64)
        for k in range(width):
            total = (total + hashes[whole + k]) * _BASE
        found.append(mix(total + np.uint64(width)))
        at.append(whole)
    for length in range(1, width):
        short = firsts[:-1][counts == length]
        if len(short):
            total = np.zeros(len(short), np.uint64)
            for k in range(length):
                total = (total + hashes[short + k]) * _BASE
            found.append(mix(total + np.uint64(length)))
            at.append(short)
    if not found:
        return np.empty(0, np.uint64), np.empty(0, np.int64), np.empty(0, np.int64)
    out, where = np.concatenate(found), np.concatenate(at)
    order = np.argsort(where, kind="stable")
    return out[order], rows[where[order]], where[order]
