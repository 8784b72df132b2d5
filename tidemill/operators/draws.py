"""Numbers drawn by a hash, and summaries of results in a row, over arrays inside tasks."""

from __future__ import annotations

import hashlib
import math

import numpy as np

#: MD5's constants, shifts and start.
_K = [int(abs(math.sin(i + 1)) * 2**32) for i in range(64)]
_SHIFTS = ((7, 12, 17, 22), (5, 9, 14, 20), (4, 11, 16, 23), (6, 10, 15, 21))
_START = (0x67452301, 0xEFCDAB89, 0x98BADCFE, 0x10325476)
#: Texts that are hashed at a time: their words stay in a core's cache. Texts of more bytes than one block of MD5 are hashed one by one.
_STEP, _BLOCK = 32768, 55


def _digests(words: list, n: int) -> np.ndarray:
    """The first 52 bits of the MD5 digests of ``n`` texts of one block: 16 words, each an array, or a number for all."""
    a, b, c, d = (np.full(n, x, np.uint32) for x in _START)
    for i in range(64):
        if i < 16:
            f, at = d ^ (b & (c ^ d)), i
        elif i < 32:
            f, at = c ^ (d & (b ^ c)), (5 * i + 1) % 16
        elif i < 48:
            f, at = b ^ c ^ d, (3 * i + 5) % 16
        else:
            f, at = c ^ (b | ~d), 7 * i % 16
        f += a
        if isinstance(words[at], int):
            f += np.uint32((_K[i] + words[at]) & 0xFFFFFFFF)
        else:
            f += words[at]
            f += np.uint32(_K[i])
        shift = _SHIFTS[i // 16][i % 4]
        turned = f << np.uint32(shift)
        f >>= np.uint32(32 - shift)
        turned |= f
        turned += b
        a, d, c, b = d, c, b, turned
    first, second = (a + np.uint32(_START[0])).byteswap(), (b + np.uint32(_START[1])).byteswap()
    return (first.astype(np.uint64) << np.uint64(20)) | (second >> np.uint32(12)).astype(np.uint64)


def numbers(seed: int, sim: int, places: np.ndarray) -> np.ndarray:
    """The first 13 hex digits of md5('seed:sim:place') as a number, for each of rising places."""
    head, out, done = f"{seed}:{sim}:".encode(), np.empty(len(places), np.uint64), 0
    for digits, end in enumerate([*np.searchsorted(places, [10**k for k in range(1, 19)]), len(places)], 1):
        length = len(head) + digits
        for lo in range(done, end, _STEP):
            rest = places[lo : min(lo + _STEP, end)]
            if length > _BLOCK:
                out[lo : lo + len(rest)] = [int(hashlib.md5(head + str(p).encode()).hexdigest()[:13], 16) for p in rest.tolist()]
                continue
            words = np.frombuffer(head.ljust(length, b"\0") + b"\x80".ljust(56 - length, b"\0"), "<u4").tolist() + [8 * length, 0]
            n, rest = len(rest), rest.astype(np.uint32 if digits < 10 else np.uint64)
            for at in range(length - 1, len(head) - 1, -1):
                left = rest // 10
                words[at // 4] = words[at // 4] + ((rest - left * 10 + 48).astype(np.uint32) << np.uint32(8 * (at % 4)))
                rest = left
            out[lo : lo + n] = _digests(words, n)
        done = max(done, end)
    return out


def dealt(places: np.ndarray, parts: int) -> tuple[np.ndarray, list[tuple[int, int, int]]]:
    """The order that brings rows of equal parts together, each part's in their order, and (part, from, to) of parts with rows."""
    order = np.argsort(places.astype(np.uint16) if parts <= 1 << 16 else places, kind="stable")
    cuts = np.searchsorted(places[order], np.arange(parts + 1)).tolist()
    return order, [(k, a, b) for k, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if a < b]


def ranked(drawn: np.ndarray) -> np.ndarray:
    """The order of rising numbers, equal ones as they come. They are hardly ever equal, and a sort that need not keep their order is
    faster."""
    order = np.argsort(drawn)
    rising = drawn[order]
    return np.argsort(drawn, kind="stable") if (rising[1:] == rising[:-1]).any() else order


def _runs(inside: np.ndarray) -> tuple[int, int, int]:
    """Lengths of the run at the head, of that at the tail, and of the longest."""
    ends, n = np.flatnonzero(~inside), len(inside)
    if not len(ends):
        return n, n, n
    head, tail = int(ends[0]), int(n - 1 - ends[-1])
    return head, tail, max(head, tail, int(np.diff(ends).max(initial=1)) - 1)


def summary(r: np.ndarray, fraction: float) -> dict[str, float]:
    """The summary of results in a row (at least one), field by field as ``robustness.composed`` makes it of two stretches."""
    found: dict[str, float] = {"n": len(r)}
    with np.errstate(divide="ignore", invalid="ignore"):
        log = np.log(np.maximum(0.0, 1 + fraction * r))
        for values, (total, high, low, drop) in ((r, ("sum", "high", "low", "drop")), (log, ("log", "log_high", "log_low", "log_drop"))):
            upto = values.cumsum()
            peak = np.maximum.accumulate(upto)
            found |= {total: float(upto[-1]), high: float(peak[-1]), low: float(upto.min()), drop: float(np.fmax.reduce(peak - upto, initial=0.0))}
    for name, inside in (("lose", r < 0), ("win", r > 0)):
        found |= dict(zip((f"{name}_head", f"{name}_tail", f"{name}_most"), _runs(inside), strict=True))
    return found
