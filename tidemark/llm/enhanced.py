"""Enhanced suffix arrays of short strings: order, common prefixes, and the tree of their intervals."""

from __future__ import annotations

import numpy as np

from .flat import ranges
from .jaccard import mixed

#: Ends every string; valid UTF-8 never holds it.
END = 0xFF
WORDS = 10
STEP = 0x9E3779B97F4A7C15


def byte_hashes(raw: np.ndarray, length: int) -> np.ndarray:
    """Hash of every run of ``length`` bytes, by doubling."""
    if len(raw) < length:
        return np.empty(0, np.uint64)
    n, power, whole = 1, STEP, raw.astype(np.uint64) + np.uint64(1)
    out, taken = None, 0
    while True:
        if length & n:
            own = whole[taken:]
            factor = np.uint64(power)
            out = own if out is None else out[: len(own)] * factor + own
            taken += n
        n *= 2
        if n > length:
            break
        whole = whole[: len(whole) - n // 2] * np.uint64(power) + whole[n // 2 :]
        power = power * power % (1 << 64)
    return mixed(out[: len(raw) - length + 1])


def big_endian(raw: np.ndarray) -> np.ndarray:
    """The eight bytes from every place on as one number, zeros beyond the end."""
    v = np.r_[raw, np.zeros(8 * WORDS + 8, np.uint8)].astype(np.uint64)
    for width in (1, 2, 4):
        v = (v[:-width] << np.uint64(8 * width)) | v[width:]
    return v


def suffix_order(numbers: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """``starts`` in the order of their first 80 bytes."""
    return starts[np.lexsort([numbers[starts + 8 * j] for j in reversed(range(WORDS))])]


def common_prefixes(numbers: np.ndarray, order: np.ndarray, room: np.ndarray) -> np.ndarray:
    """Bytes that each suffix shares with the one before it, within the ``room`` of both; 0 for the first."""
    if not len(order):
        return np.empty(0, np.int64)
    a, b = order[:-1], order[1:]
    length, same = np.zeros(len(a), np.int64), np.ones(len(a), bool)
    for j in range(WORDS):
        differing = numbers[a + 8 * j] ^ numbers[b + 8 * j]
        bytes_alike = np.full(len(a), 8, np.int64)
        for k in range(8):
            bytes_alike[(differing >> np.uint64(8 * (7 - k))) != 0] = np.minimum(bytes_alike[(differing >> np.uint64(8 * (7 - k))) != 0], k)
        length += np.where(same, bytes_alike, 0)
        same &= differing == 0
    return np.r_[0, np.minimum(length, np.minimum(room[:-1], room[1:]))]


def maximal_repeats(lcp: np.ndarray, left: np.ndarray, least: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(length, first, last, least) of each interval of suffixes whose common prefix is a maximal repeat.

    A stack holds the open intervals. ``left`` is the byte before each suffix, -1
    where nothing is known of it; an interval is put out only if the bytes before
    its suffixes differ, since else the repeat one byte to the left tells all.
    ``least`` is the smallest document of each suffix, and of each interval put out.
    """
    found: list[tuple[int, int, int, int]] = []
    heights, lows, chars, leasts = [0], [0], [-1], [0]
    values, before, smallest = np.r_[np.where(lcp < shortest, 0, lcp), 0].tolist(), left.tolist(), least.tolist()
    for i in range(1, len(before) + 1):
        height = values[i]
        if height == 0 and len(heights) == 1:
            continue
        low, char, small = i - 1, before[i - 1], smallest[i - 1]
        while height < heights[-1]:
            low, c, s = lows.pop(), chars.pop(), leasts.pop()
            char, small = (c if c == char else -1), (s if s < small else small)
            top = heights.pop()
            if char == -1:
                found.append((top, low, i - 1, small))
        if height > heights[-1]:
            heights.append(height)
            lows.append(low)
            chars.append(char)
            leasts.append(small)
        elif height:
            if chars[-1] != char:
                chars[-1] = -1
            if small < leasts[-1]:
                leasts[-1] = small
    out = np.array(found, np.int64).reshape(-1, 4)
    return out[:, 0], out[:, 1], out[:, 2], out[:, 3]


def repeat_groups(texts: list[bytes], least: np.ndarray, shortest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Maximal repeats of at least ``shortest`` bytes with all their occurrences.

    ``texts`` are distinct, of at most ``8 * WORDS`` bytes; ``least`` is the
    smallest document that holds each. Returns per occurrence (group, length,
    text, place in it, smallest document of the group).
    """
    sizes = np.array([len(t) for t in texts], np.int64)
    offsets = np.cumsum(sizes + 1) - sizes - 1
    raw = np.frombuffer(bytes([END]).join(texts) + bytes([END]), np.uint8)
    windows = np.maximum(sizes - shortest + 1, 0)
    starts, owner = ranges(offsets, windows), np.repeat(np.arange(len(texts)), windows)
    if not len(starts):
        none = np.empty(0, np.int64)
        return none, none, none, none, none
    # A suffix that shares its first bytes with no other is in no interval.
    hashes = byte_hashes(raw, shortest)[starts]
    ordered = np.sort(hashes)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    place = np.minimum(np.searchsorted(twice, hashes), max(len(twice) - 1, 0))
    starts, owner = (x[twice[place] == hashes] if len(twice) else x[:0] for x in (starts, owner))
    numbers, of_start = big_endian(raw), np.zeros(len(raw), np.int64)
    of_start[starts] = owner
    order = suffix_order(numbers, starts)
    text = of_start[order]
    room = offsets[text] + sizes[text] - order
    before = np.where(order == offsets[text], -1, raw[order - 1].astype(np.int64))
    length, first, last, small = maximal_repeats(common_prefixes(numbers, order, room), before, least[text], shortest)
    size = last - first + 1
    group, at = np.repeat(np.arange(len(size)), size), ranges(first, size)
    return group, length[group], text[at], order[at] - offsets[text[at]], small[group]
