"""Word shingles of whole texts as 64-bit hashes, and their similarity sketches."""

from __future__ import annotations

import numpy as np

U = np.uint64
#: Coordinates of a sketch, kept as 16 bits each; a band is four of the first ones, so its key is 64 bits.
COORDINATES, ROWS, BANDS = 256, 4, 32
#: Texts are hashed in pieces of about so many bytes; powers are remembered up to twice that.
PIECE = 1 << 19

_rng = np.random.default_rng(20_240_501)
_BYTES = _rng.integers(1, 1 << 63, 256, dtype="u8") * U(2) + U(1)
_BASE = int(_rng.integers(1 << 40, 1 << 62)) * 8 + 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_PLACES = _rng.integers(1, 1 << 63, 8, dtype="u8") * U(2) + U(1)
_FOLD = np.arange(256, dtype="u1")
_FOLD[ord("A") : ord("Z") + 1] += 32
_BLANK = np.zeros(256, bool)
_BLANK[[0x20, *range(0x09, 0x0E)]] = True
_powers: list[np.ndarray] = []


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of a well-known generator)."""
    x = x + U(0x9E3779B97F4A7C15)
    x = (x ^ (x >> U(30))) * U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> U(27))) * U(0x94D049BB133111EB)
    return x ^ (x >> U(31))


def power(n: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse up to n."""
    if n > 2 * PIECE:
        return [_steps(base, n) for base in (_BASE, _INVERSE)]
    if not _powers:
        _powers.extend(_steps(base, 2 * PIECE) for base in (_BASE, _INVERSE))
    return _powers


def _steps(base: int, n: int) -> np.ndarray:
    steps = np.full(n + 1, base, "u8")
    steps[0] = 1
    return np.cumprod(steps)


def prefix(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix polynomial hashes of a byte string, and powers of the inverse base that shift a difference to its start."""
    up, down = power(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, "u8")
    np.cumsum(_BYTES[raw] * up[: len(raw)], out=sums[1:])
    return sums, down


def _pieces(raw: np.ndarray) -> list[tuple[int, int]]:
    """Cuts of a byte string at blanks, so that no word is split."""
    out, at, n = [], 0, len(raw)
    while at < n:
        end = min(n, at + PIECE)
        while end < n and not _BLANK[raw[end]]:
            ahead = np.flatnonzero(_BLANK[raw[end : end + PIECE]])
            end = end + int(ahead[0]) if len(ahead) else min(n, end + PIECE)
        out.append((at, end))
        at = end
    return out


def word_hashes(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash and first byte of every word of a byte string (A-Z folded)."""
    hashes, places = [np.zeros(0, "u8")], [np.zeros(0, "i8")]
    for a, b in _pieces(raw):
        piece = raw[a:b]
        edge = np.diff(_BLANK[piece].astype("i1"), prepend=1, append=1)
        first, last = np.flatnonzero(edge == -1), np.flatnonzero(edge == 1)
        sums, down = prefix(_FOLD[piece])
        hashes.append(mix((sums[last] - sums[first]) * down[first] + (last - first).astype("u8")))
        places.append(first + a)
    return np.concatenate(hashes), np.concatenate(places)


def shingle_sets(texts: list[str | None], size: int = 4) -> list[np.ndarray]:
    """The distinct shingle hashes of each text, ascending: size words each, or one of all words if fewer."""
    raw = [(x or "").encode() for x in texts]
    ends = np.cumsum([len(x) + 1 for x in raw])
    words, first = word_hashes(np.frombuffer(b" ".join(raw) + b" ", dtype="u1"))
    bounds = np.concatenate([[0], np.searchsorted(first, ends)])
    n = max(0, len(words) - size + 1)
    total = np.zeros(n, "u8")
    for k in range(size):
        total += words[k : k + n] * _PLACES[k]
    full = mix(total)
    out = []
    for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist()):
        if b - a >= size:
            out.append(np.unique(full[a : b - size + 1]))
        elif b > a:
            out.append(mix((words[a:b] * _PLACES[: b - a]).sum(keepdims=True) + U(b - a)))
        else:
            out.append(np.zeros(0, "u8"))
    return out


def fingerprints(sets: list[np.ndarray]) -> np.ndarray:
    """128 bits for each set that is not empty (empty sets must be left out)."""
    flat = np.concatenate(sets) if sets else np.zeros(0, "u8")
    first = np.cumsum([0, *map(len, sets)])[:-1]
    return np.stack([np.add.reduceat(mix(flat), first), np.add.reduceat(mix(flat ^ U(0x5851F42D4C957F2D)), first)], axis=1) if sets else np.zeros((0, 2), "u8")


def sketches(sets: list[np.ndarray]) -> np.ndarray:
    """Fast similarity sketches of sets that are not empty.

    In round i every element falls into a random bin with a random value; a bin takes the smallest value
    of the first round that reaches it. After COORDINATES such rounds, round COORDINATES + j puts all
    elements into bin j, so every coordinate is filled. A set drops out once its bins are full: sets
    larger than COORDINATES * ln(COORDINATES) need a round or two.
    """
    t = COORDINATES
    filled = np.zeros((len(sets), t), bool)
    out = np.zeros((len(sets), t), "u8")
    active = np.arange(len(sets))
    flat = np.concatenate(sets) if sets else np.zeros(0, "u8")
    of = np.repeat(active, [len(x) for x in sets])
    for i in range(2 * t):
        if not len(active):
            break
        h = mix(flat ^ mix(np.array([i + 1], "u8")))
        value = np.full((len(sets), t), U(0xFFFFFFFFFFFFFFFF))
        b = (h & U(t - 1)).astype("i8") if i < t else np.full(len(h), i - t)
        np.minimum.at(value.reshape(-1), of * t + b, h >> U(7))
        reached = (value != U(0xFFFFFFFFFFFFFFFF)) & ~filled
        out[reached] = mix(value[reached] + U(i))
        filled |= reached
        left = ~filled[active].all(axis=1)
        if not left.all():
            keep = np.zeros(len(sets), bool)
            keep[active[left]] = True
            active = active[left]
            use = keep[of]
            flat, of = flat[use], of[use]
    return (out >> U(48)).astype("<u2")
