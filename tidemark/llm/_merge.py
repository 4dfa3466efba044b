"""Sorted runs of fixed-length byte strings: front coding, and merging by a loser tree that knows common prefixes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import zstandard


def common(a: np.ndarray) -> np.ndarray:
    """Bytes that each row of a sorted (n, width) array shares with the row before; 0 for the first."""
    out = np.zeros(len(a), np.uint8)
    for at in range(1, len(a), 65536):
        end = min(at + 65536, len(a))
        unlike = a[at:end] != a[at - 1 : end - 1]
        first = unlike.argmax(1)
        out[at:end] = np.where(unlike[np.arange(end - at), first], first, a.shape[1])
    return out


def pack(rows: np.ndarray, tags: np.ndarray) -> tuple[bytes, bytes]:
    """A sorted run as (front-coded strings, tags): of each string only what follows the prefix shared with the one before."""
    shared = common(rows)
    kept = rows[np.arange(rows.shape[1])[None, :] >= shared[:, None]]
    z = zstandard.ZstdCompressor(level=1)
    head = np.array([len(rows)], np.uint32).tobytes()
    return z.compress(head + shared.tobytes() + kept.tobytes()), z.compress(np.ascontiguousarray(tags).tobytes())


def _unpacked(packed: bytes) -> tuple[int, bytes, bytes]:
    """(strings, prefix of each in common with the one before, what follows these prefixes) of a front-coded run."""
    raw = zstandard.ZstdDecompressor().decompress(packed)
    size = int.from_bytes(raw[:4], "little")
    return size, raw[4 : 4 + size], raw[4 + size :]


def merged(packed: list[bytes], width: int) -> Iterator[tuple[int, int, int]]:
    """(run, place in it, prefix in common with the string before in the merged order), for all strings in order.

    Each inner node of the tree keeps the loser of its match and the prefix that loser has in common with the winner, the
    last string that passed there. A new contender arrives with its prefix in common with that same string. The longer
    prefix is the smaller string and nothing is compared; only at equal prefixes are the bytes after them compared.
    """
    runs = [_unpacked(p) for p in packed]
    sizes, shares, bodies = ([r[i] for r in runs] for i in range(3))
    strings = [body[:width] for body in bodies]
    spots, places = [width] * len(runs), [0] * len(runs)
    k = 1
    while k < len(runs):
        k *= 2
    loser, prefix = [-1] * k, [0] * k

    def least(a: int, b: int, p: int) -> tuple[int, int, int]:
        """(winner, loser, their common prefix) of two runs that share p bytes; an ended or missing run loses."""
        if a < 0:
            return b, a, 0
        if b < 0:
            return a, b, 0
        x, y = strings[a], strings[b]
        if x[p] == y[p]:  # the highest bit in which the rest differs tells the first unlike byte
            p = width - ((int.from_bytes(x) ^ int.from_bytes(y)).bit_length() + 7 >> 3)
            if p == width:
                return (a, b, p) if a < b else (b, a, p)
        return (a, b, p) if x[p] < y[p] else (b, a, p)

    winners = [i if i < len(runs) and sizes[i] else -1 for i in range(k)]
    node = k
    while node > 1:
        node //= 2
        following = []
        for i in range(node):
            w, lost, p = least(winners[2 * i], winners[2 * i + 1], 0)
            loser[node + i], prefix[node + i] = lost, p
            following.append(w)
        winners = following
    paths = []
    for i in range(k):
        node, path = (i + k) // 2, []
        while node:
            path.append(node)
            node //= 2
        paths.append(tuple(path))
    top, known = winners[0], 0
    while top >= 0:
        at = places[top]
        yield top, at, known
        at += 1
        path = paths[top]
        if at < sizes[top]:
            known = shares[top][at]
            spot = spots[top]
            spots[top] = end = spot + width - known
            strings[top] = strings[top][:known] + bodies[top][spot:end]
            places[top] = at
            now = top
        else:
            now = known = -1
        for node in path:
            other = loser[node]
            if other < 0:
                continue
            p = prefix[node]
            if p > known:
                loser[node], prefix[node] = now, known
                now, known = other, p
            elif p == known:
                if p < width:
                    w, loser[node], prefix[node] = least(now, other, p)
                    if w != now:
                        now, known = other, p
                elif other < now:
                    loser[node] = now
                    now = other
        top = now
