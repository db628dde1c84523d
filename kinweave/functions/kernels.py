"""Vectorised hashing over Arrow string buffers: q-grams, words, shingles, minwise signatures.

No Python object is made for a value: a column's bytes are hashed in place with NumPy.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

_U = np.uint64


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """splitmix64 of each value."""
    with np.errstate(over="ignore"):
        x = x + _U((seed * 0x9E3779B97F4A7C15 + 0x632BE59BD9B4E019) % 2**64)
        x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
        return x ^ (x >> _U(31))


def buffers(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string column; a null counts as empty."""
    if isinstance(col, pa.ChunkedArray):
        col = col.combine_chunks()
    col = col.cast(pa.large_string()).fill_null("")
    off = np.frombuffer(col.buffers()[1], dtype=np.int64)[col.offset : col.offset + len(col) + 1]
    data = np.frombuffer(col.buffers()[2] or b"", dtype=np.uint8)
    return data[off[0] : off[-1]] if len(off) else data[:0], off - (off[0] if len(off) else 0)


def gram_hashes(col: pa.Array, q: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of each q-gram of bytes, start of each row's grams). Rows shorter than q have none."""
    data, off = buffers(col)
    n = np.maximum(np.diff(off) - q + 1, 0)
    starts = np.concatenate([[0], np.cumsum(n)])
    if not starts[-1]:
        return np.zeros(0, _U), starts
    at = np.repeat(off[:-1] - starts[:-1], n) + np.arange(starts[-1])
    h = np.zeros(len(at), _U)
    for i in range(q):
        h = h * _U(257) + data[at + i]
    return h, starts


def minwise(hashes: np.ndarray, starts: np.ndarray, n_hashes: int, salt: np.ndarray | None = None) -> np.ndarray:
    """(rows, n_hashes) minwise signature; a row without elements has all ones, the largest value.

    salt: a value for each row; rows of different salt share no element.
    """
    n = np.diff(starts)
    out = np.full((len(n), n_hashes), np.iinfo(np.uint64).max, _U)
    full = np.flatnonzero(n)
    if len(full):
        if salt is not None:
            hashes = mix(hashes ^ np.repeat(salt.astype(_U), n))
        for k in range(n_hashes):
            out[full, k] = np.minimum.reduceat(mix(hashes, k + 1), starts[:-1][full])
    return out


def band_keys(signature: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """(rows, bands) key of each band of a signature; the band's number is part of the key."""
    out = np.empty((len(signature), bands), _U)
    with np.errstate(over="ignore"):
        for b in range(bands):
            k = np.full(len(signature), b + 1, _U)
            for r in range(rows):
                k = mix(k * _U(31) + signature[:, b * rows + r])
            out[:, b] = k
    return out


def collision(similarity: float, bands: int, rows: int) -> float:
    """Chance that two sets of this Jaccard similarity share a band."""
    return 1 - (1 - similarity**rows) ** bands


def bands_for(similarity: float, rows: int, recall: float, most: int = 256) -> int:
    """Fewest bands of ``rows`` hashes that find pairs of this similarity with this recall."""
    return next(b for b in range(1, most + 1) if collision(similarity, b, rows) >= recall or b == most)


_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


def words(col: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(hash, first byte, end byte, row) of each word: a run of letters, digits or bytes over 127.

    ASCII letters count as lower case. Byte positions are in the column's joined bytes.
    """
    data, off = buffers(col)
    if not len(data):
        return np.zeros(0, _U), np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    low = _LOWER[data]
    inside = _WORD[data]
    start = inside.copy()
    start[1:] &= ~inside[:-1]
    edge = off[1:-1]
    edge = edge[edge < len(data)]
    start[edge] |= inside[edge]
    last = inside.copy()
    last[:-1] &= ~inside[1:]
    last[edge - 1] |= inside[edge - 1]
    a, b = np.flatnonzero(start), np.flatnonzero(last) + 1
    row = np.searchsorted(off, a, side="right") - 1
    with np.errstate(over="ignore"):
        n = len(a)
        # sum of bytes * 31^i from each word's start, by position within the word
        h = np.zeros(n, _U)
        length = b - a
        live = np.arange(n)
        i = 0
        while len(live):
            h[live] = h[live] * _U(1099511628211) + low[a[live] + i] + _U(1)
            i += 1
            live = live[length[live] > i]
    return mix(h), a, b, row


def shingles(word_hash: np.ndarray, row: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(hash of k consecutive words, index of the first) of all runs of k words within one row."""
    n = len(word_hash) - k + 1
    if n <= 0:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    at = np.flatnonzero(row[:n] == row[k - 1 : k - 1 + n])
    h = np.zeros(len(at), _U)
    with np.errstate(over="ignore"):
        for i in range(k):
            h = mix(h * _U(31) + word_hash[at + i])
    return h, at


def _padded(data: np.ndarray, off: np.ndarray, rows: np.ndarray, width: int) -> np.ndarray:
    """(rows, width) bytes of some rows, zeros behind their ends."""
    out = np.zeros((len(rows), width), np.uint8)
    n = np.diff(off)[rows]
    at = np.arange(width) < n[:, None]
    out[at] = data[np.repeat(off[:-1][rows] - np.concatenate([[0], np.cumsum(n)[:-1]]), n) + np.arange(n.sum())]
    return out


#: Longest string, in bytes, whose positions fit into one machine word.
_WORD_BITS = 63


def jaro_winkler(a: pa.Array, b: pa.Array, one_by_one, chunk: int = 20_000) -> np.ndarray:
    """Jaro-Winkler similarity of pairs of strings by their bytes; a null counts as empty. Positions already
    matched are bits of a word for each pair, so all pairs of a chunk take a step together; pairs with a string
    of more than 63 bytes go through ``one_by_one`` (two bytes objects to a number)."""
    (da, oa), (db, ob) = buffers(a), buffers(b)
    na, nb = np.diff(oa), np.diff(ob)
    out = np.zeros(len(na))
    for i in np.flatnonzero((np.maximum(na, nb) > _WORD_BITS) & (np.minimum(na, nb) > 0)):
        out[i] = one_by_one(da[oa[i] : oa[i + 1]].tobytes(), db[ob[i] : ob[i + 1]].tobytes())
    short = np.flatnonzero((np.maximum(na, nb) <= _WORD_BITS) & (np.minimum(na, nb) > 0))
    short = short[np.argsort(np.maximum(na, nb)[short], kind="stable")]  # pairs of like length share a chunk
    for c in range(0, len(short), chunk):
        rows = short[c : c + chunk]
        la, lb = na[rows], nb[rows]
        x, y = _padded(da, oa, rows, int(la.max())), _padded(db, ob, rows, int(lb.max()))
        reach = np.maximum(np.maximum(la, lb) // 2 - 1, 0)
        used, hit = np.zeros(len(rows), _U), np.zeros(x.shape, bool)
        one = _U(1)
        for i in range(x.shape[1]):
            same = np.zeros(len(rows), _U)
            for j in range(max(0, i - int(reach.max())), min(y.shape[1], i + int(reach.max()) + 1)):
                same |= (x[:, i] == y[:, j]).astype(_U) << _U(j)
            low = np.clip(i - reach, 0, _WORD_BITS).astype(_U)
            high = np.clip(np.minimum(lb, i + reach + 1), 0, _WORD_BITS).astype(_U)
            free = same & ~used & ((one << high) - one) & ~((one << low) - one)
            free[la <= i] = 0
            first = free & (~free + one)
            used |= first
            hit[:, i] = first != 0
        m = hit.sum(axis=1)
        taken = ((used[:, None] >> np.arange(y.shape[1], dtype=_U)) & one).astype(bool)
        width = int(m.max(initial=0))
        left, right = np.zeros((len(rows), width), np.uint8), np.zeros((len(rows), width), np.uint8)
        for into, which, text in ((left, hit, x), (right, taken, y)):
            r, k = np.nonzero(which)
            into[r, (np.cumsum(which, axis=1) - 1)[r, k]] = text[r, k]
        half = (left != right).sum(axis=1) // 2
        jaro = np.where(m > 0, (m / la + m / lb + (m - half) / np.maximum(m, 1)) / 3, 0.0)
        k = min(4, x.shape[1], y.shape[1])
        agree = (x[:, :k] == y[:, :k]) & (np.arange(k) < np.minimum(la, lb)[:, None])
        prefix = np.cumprod(agree, axis=1).sum(axis=1)
        out[rows] = np.where(jaro > 0.7, jaro + 0.1 * prefix * (1 - jaro), jaro)
    return out
