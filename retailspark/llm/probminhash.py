"""ProbMinHash signatures of weighted word shingles, in numpy.

A shingle's weight is 1 + ln(count).  Two signatures agree in a register with
the probability Jaccard similarity of the weighted sets,

    J_P = sum over common i of 1 / sum over all j of max(a_j / a_i, b_j / b_i),

which is the plain Jaccard similarity where no shingle repeats.
"""

from __future__ import annotations

import sys

import numpy as np
from pyspark import cloudpickle

cloudpickle.register_pickle_by_value(sys.modules[__name__])

SHINGLE = 5
_BASE = np.uint64(0x9E3779B97F4A7C15)
_ORDER = [np.uint64(x) for x in (0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3)]


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the result depends on every bit of x."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _inverse(a: int) -> int:
    return pow(a, -1, 1 << 64)


def word_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the words (runs without white space, lower case) of all
    texts in order, and how many words each text has.

    With C[i] the sum of byte * base^i over the bytes before i, a word from s to e
    hashes to (C[e] - C[s]) / base^s, modulo 2^64."""
    parts = [t.lower().encode("utf-8", "replace") for t in texts]
    raw = np.frombuffer(b" ".join(parts) + b" ", dtype=np.uint8)
    ends_of_text = np.cumsum([len(p) + 1 for p in parts])
    blank = (raw == 32) | ((raw >= 9) & (raw <= 13)) | ((raw >= 28) & (raw <= 31))
    edge = np.flatnonzero(np.diff(np.concatenate([[True], blank, [True]]).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    power = np.full(len(raw) + 1, _BASE, dtype=np.uint64)
    power[0] = 1
    power = np.multiply.accumulate(power)
    sums = np.zeros(len(raw) + 1, dtype=np.uint64)
    np.cumsum((raw.astype(np.uint64) + np.uint64(1)) * power[:-1], out=sums[1:])
    back = np.full(len(raw) + 1, np.uint64(_inverse(int(_BASE))), dtype=np.uint64)
    back[0] = 1
    back = np.multiply.accumulate(back)
    hashes = mix((sums[ends] - sums[starts]) * back[starts])
    n = np.diff(np.searchsorted(starts, ends_of_text), prepend=0)
    return hashes, n


def shingle_hashes(texts: list[str]) -> list[np.ndarray]:
    """Per text the hashes of its runs of ``SHINGLE`` words, repeats kept; of all
    its words if there are fewer; none for a text without words."""
    words, n = word_hashes(texts)
    ends = np.cumsum(n)
    m = len(words) - SHINGLE + 1
    rolled = np.zeros(max(m, 0), dtype=np.uint64)
    for k in range(SHINGLE):
        if m > 0:
            rolled += words[k : k + m] * _ORDER[k]
    rolled = mix(rolled)
    out = []
    for count, end in zip(n.tolist(), ends.tolist(), strict=True):
        if count >= SHINGLE:
            out.append(rolled[end - count : end - SHINGLE + 1])
        else:
            few = words[end - count : end] * np.array(_ORDER[:count], dtype=np.uint64)
            out.append(mix(few.sum(keepdims=True, dtype=np.uint64) + np.uint64(count)) if count else few)
    return out


def weighted_set(shingles: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles in ascending order and their weights."""
    values, counts = np.unique(shingles, return_counts=True)
    return values, 1.0 + np.log(counts)


def signatures(sets: list[tuple[np.ndarray, np.ndarray]], registers: int) -> np.ndarray:
    """(texts x registers) hashes of the shingles that arrive first.

    Each shingle is a Poisson process whose rate is its weight; an arrival falls
    into a register picked by hash, and a register keeps its first arrival.  A
    shingle whose next arrival is later than the latest first arrival of its
    text can't change anything and stops.  An empty set has zeros."""
    size = np.array([len(v) for v, _ in sets], dtype=np.int64)
    first = np.full(len(sets) * registers, np.inf)
    keep = np.zeros(len(sets) * registers, dtype=np.uint64)
    if not size.sum():
        return keep.reshape(len(sets), registers)
    element = np.concatenate([v for v, _ in sets])
    weight = np.concatenate([w for _, w in sets])
    text = np.repeat(np.arange(len(sets)), size)
    time = np.zeros(len(element))
    index, step = 0, 1
    while len(element):
        # ``step`` further arrivals of every shingle that is still running
        number = np.arange(index, index + step, dtype=np.uint64)
        bits = mix(element[:, None] + (number + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
        gap = -np.log(((bits >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
        arrival = time[:, None] + np.cumsum(gap, axis=1) / weight[:, None]
        place = (mix(bits ^ np.uint64(0xD1B54A32D192ED03)) % np.uint64(registers)).astype(np.int64) + text[:, None] * registers
        before = first[place]
        earlier = arrival < before
        if earlier.any():
            at, when = place[earlier], arrival[earlier]
            np.minimum.at(first, at, when)
            won = first[at] == when
            keep[at[won]] = np.broadcast_to(element[:, None], arrival.shape)[earlier][won]
        last = first.reshape(len(sets), registers).max(axis=1)
        time = arrival[:, -1]
        running = time < last[text]
        element, weight, text, time = element[running], weight[running], text[running], time[running]
        index += step
        step = 1 if index < 4 else 16
    return keep.reshape(len(sets), registers)


def probability_jaccard(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """J_P of two weighted sets, exactly; 0 if either is empty."""
    (va, wa), (vb, wb) = a, b
    if not len(va) or not len(vb):
        return 0.0
    at = np.minimum(np.searchsorted(vb, va), len(vb) - 1)
    common = vb[at] == va
    if not common.any():
        return 0.0
    x, y = wa[common], wb[at[common]]
    only_a, only_b = wa.sum() - x.sum(), wb.sum() - y.sum()
    ratio = x / y
    order = np.argsort(ratio, kind="stable")
    x, y, ratio = x[order], y[order], ratio[order]
    low = np.searchsorted(ratio, ratio, side="left")  # how many have a smaller ratio
    up_a = np.concatenate([[0.0], np.cumsum(x)])
    up_b = np.concatenate([[0.0], np.cumsum(y)])
    total = (only_a + up_a[-1] - up_a[low]) / x + (only_b + up_b[low]) / y
    return float((1.0 / total).sum())
