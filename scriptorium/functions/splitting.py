"""Places of the chunks of a text, a helper for use inside vectorised functions."""

from __future__ import annotations

import numpy as np

_BASE = np.uint64(6364136223846793005)
#: Texts up to this length are searched for each chunk by itself, which is faster than hashing them.
SHORT = 32_768


def first_lines(text: str, chunks: list[str]) -> list[dict[str, int]]:
    """First and last line of the first occurrence of each chunk in the text, 0 and 0 without one.

    A short text is searched for each chunk by itself; so few chunks fit in it that this is bounded. In a longer one,
    chunks of a length between two powers of two share a window of the smaller one. A rolling hash of all windows
    of the text gives the few places where a chunk's beginning may stand; these are compared in order.
    """
    if len(text) <= SHORT:
        out, seen = [], {}
        for chunk in chunks:
            if chunk not in seen:
                place = text.find(chunk)
                seen[chunk] = 0 if place < 0 else text.count("\n", 0, place) + 1
            start = seen[chunk]
            out.append({"start_line": start, "end_line": start + chunk.count("\n") if start else 0})
        return out
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    newlines = np.r_[0, np.cumsum(points == 10)]
    places = {"": 0}
    by_window: dict[int, list[str]] = {}
    for chunk in set(chunks) - {""}:
        by_window.setdefault(1 << (len(chunk).bit_length() - 1), []).append(chunk)
    if by_window:
        # Powers of an odd base and of its inverse, modulo 2 ** 64: sums of scaled characters give the hash of any window.
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        up = np.cumprod(np.r_[np.uint64(1), np.full(len(points), _BASE)])
        sums = np.r_[np.uint64(0), np.cumsum((points + np.uint64(1)) * np.cumprod(np.r_[np.uint64(1), np.full(max(len(points) - 1, 0), inverse)])[: len(points)])]
        for window, group in by_window.items():
            if window > len(points):
                continue
            hashes = (sums[window:] - sums[:-window]) * up[: len(sums) - window]
            wanted = {chunk: _hash_of(chunk[:window], inverse) for chunk in group}
            at = np.flatnonzero(np.isin(hashes, np.array(list(set(wanted.values())), "u8")))
            order = np.argsort(hashes[at], kind="stable")
            at, found = at[order], hashes[at][order]
            for chunk, value in wanted.items():
                low, high = np.searchsorted(found, value), np.searchsorted(found, value, "right")
                places[chunk] = next((int(p) for p in at[low:high] if text.startswith(chunk, int(p))), -1)
    out = []
    for chunk in chunks:
        place = places.get(chunk, -1)
        start = 0 if place < 0 else int(newlines[place]) + 1
        out.append({"start_line": start, "end_line": start + chunk.count("\n") if start else 0})
    return out


def _hash_of(window: str, inverse: np.uint64) -> np.uint64:
    points = np.frombuffer(window.encode("utf-32-le", "surrogatepass"), "<u4").astype("u8")
    return ((points + np.uint64(1)) * np.cumprod(np.r_[np.uint64(1), np.full(len(points) - 1, inverse)])).sum(dtype="u8")
