"""Vectorised 64-bit hashing of words and runs of characters."""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)

#: What ``str.split`` takes as white space.
_SPACE = np.zeros(0x3001, dtype=bool)
_SPACE[[c for c in range(0x3001) if chr(c).isspace()]] = True

_powers: dict[int, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection that spreads the bits of 64-bit words."""
    x = x ^ (x >> U(30))
    x = x * U(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U(27))
    x = x * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def powers(base: int, n: int) -> np.ndarray:
    """``base ** 0 .. base ** (n - 1)`` modulo 2 ** 64; the longest asked for is kept."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        have = np.cumprod(np.concatenate([[U(1)], np.full(max(n, 1 << 16) - 1, U(base), dtype=U)]), dtype=U)
        _powers[base] = have
    return have[:n]


def codes(text: str) -> np.ndarray:
    """Code points; lone surrogates are kept as they are."""
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


#: Characters that are hashed at a time.
SEGMENT = 2_000_000


def words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of each white-space separated word of ``texts``, and the index of its text.

    Texts longer than ``SEGMENT`` are read in segments that end at white space.
    """
    if any(len(t) > SEGMENT for t in texts):
        parts, whose = [], []
        for k, t in enumerate(texts):
            at = 0
            while at < len(t) or not t:
                stop = at + SEGMENT
                while stop < len(t) and not t[stop].isspace():
                    stop += 1
                parts.append(t[at:stop])
                whose.append(k)
                at = stop
                if not t:
                    break
        found = [_words([p]) for p in parts]
        return np.concatenate([h for h, _ in found]), np.concatenate([np.full(len(h), k) for (h, _), k in zip(found, whose)])
    return _words(texts)


def _words(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    c = codes("\n".join(texts) + "\n")
    n = len(c)
    space = np.zeros(n, dtype=bool)
    low = c < len(_SPACE)
    space[low] = _SPACE[c[low]]
    edge = np.diff(np.concatenate([[True], space]).astype(np.int8))
    first = np.flatnonzero(edge == -1)
    last = np.flatnonzero(edge == 1)
    if space[0] and len(last) and (not len(first) or last[0] < first[0]):
        last = last[1:]
    total = np.concatenate([[U(0)], np.cumsum(mix(c.astype(U) + U(1)) * powers(BASE, n), dtype=U)])
    h = mix((total[last] - total[first]) * powers(INVERSE, n)[first])
    ends = np.cumsum(np.array([len(t) + 1 for t in texts], dtype=np.int64))
    return h, np.searchsorted(ends, first, side="right")


def shingles(texts: list[str], run: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct hashes of ``run`` consecutive lower-cased words, sorted within each text.

    Returns the hashes, the index of each one's text, and the number of words of each text.
    """
    h, own = words([t.lower() for t in texts])
    n_words = np.bincount(own, minlength=len(texts))
    if len(h) < run:
        return np.zeros(0, U), np.zeros(0, np.int64), n_words
    acc = np.zeros(len(h) - run + 1, dtype=U)
    for k in range(run):
        acc = acc * U(0xD6E8FEB86659FD93) + h[k : k + len(acc)]
    acc = mix(acc)
    whole = own[: len(acc)] == own[run - 1 :]
    acc, own = acc[whole], own[: len(whole)][whole]
    order = np.lexsort((acc, own))
    acc, own = acc[order], own[order]
    new = np.ones(len(acc), dtype=bool)
    new[1:] = (acc[1:] != acc[:-1]) | (own[1:] != own[:-1])
    return acc[new], own[new], n_words


def runs(c: np.ndarray, k: int) -> np.ndarray:
    """The hash of each run of ``k`` code points of ``c``, by doubling."""
    part = mix(c.astype(U) + U(1))
    n, width, done, acc = len(c), 1, 0, None
    m = n - k + 1
    if m <= 0:
        return np.zeros(0, U)
    while True:
        if k & width:
            piece = part[done : done + m]
            acc = piece.copy() if acc is None else acc * U(pow(BASE, width, 1 << 64)) + piece
            done += width
        if width * 2 > k:
            return mix(acc)
        nxt = part[: len(part) - width] * U(pow(BASE, width, 1 << 64))
        nxt += part[width:]
        part, width = nxt, width * 2


def window_min(x: np.ndarray, w: int) -> np.ndarray:
    """The minimum of each window of ``w`` values, by doubling."""
    have, width = x, 1
    while width * 2 <= w:
        have = np.minimum(have[: len(have) - width], have[width:])
        width *= 2
    rest = w - width
    return np.minimum(have[: len(have) - rest], have[rest:]) if rest else have
