"""Simple-8b word-aligned coding of id sequences, vectorised with numpy.

A 64-bit word holds a 4-bit selector in its top bits and, below, as many equally
wide values as fit.  Ids are coded in blocks of ``BLOCK``; a block starts on a
word and its number of words is kept, so all blocks decode in one pass.  Values
of more than 60 bits follow an escape word as they are.
"""

from __future__ import annotations

import numpy as np

#: Fixed values of the format: bits a value by selector; selector 0 is the escape.
BITS = np.array([64, 1, 2, 3, 4, 5, 6, 7, 8, 10, 12, 15, 20, 30, 60])
COUNTS = np.array([1, 60, 30, 20, 15, 12, 10, 8, 7, 6, 5, 4, 3, 2, 1])
BLOCK = 256
_U = np.uint64


def _widths(values: np.ndarray) -> np.ndarray:
    """Bits that each value needs (0 for zero)."""
    wide = np.frexp(values.astype(np.float64))[1].astype(np.uint8)
    exact = values > _U(1 << 52)  # a float rounds up there
    if exact.any():
        wide[exact] = [int(v).bit_length() for v in values[exact].tolist()]
    return wide


def encode(values: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Words of the sequences laid end to end in ``values``, and each block's word count.

    Every sequence starts a block of its own; one of n ids has ceil(n / BLOCK) blocks.
    """
    values = values.astype(_U)
    blocks = -(-lengths // BLOCK)
    total = int(blocks.sum())
    if not total:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    # each block's size, and how many of its ids are left at each id
    nth = np.arange(total) - np.repeat(np.cumsum(blocks) - blocks, blocks)
    size = np.minimum(BLOCK, np.repeat(lengths, blocks) - nth * BLOCK)
    stop = np.cumsum(size)
    n = len(values)
    left = (np.repeat(stop, size) - np.arange(n)).astype(np.uint16)
    # the most ids that the word which begins at each id can take
    run = _widths(values)
    largest, span, runs = int(run.max()), 1, {}
    while span < 64:  # maxima of runs of 1, 2, 4, ... values
        runs[span] = run
        run = np.maximum(run, np.append(run[span:], np.zeros(min(span, n), np.uint8)))
        span *= 2
    choice = np.full(n, 255, np.uint8)
    for selector in range(len(BITS) - 1, 0, -1):
        count, bits = int(COUNTS[selector]), int(BITS[selector])
        half = 1 << (count.bit_length() - 1)
        fits = left >= count
        if bits < largest:
            fits &= runs[half] <= bits
            if half < count < n + half:
                fits[: n - count + half] &= runs[half][count - half :] <= bits
        np.putmask(choice, fits, np.uint8(selector))
    choice[choice == 255] = 0
    # step through all blocks at once, a word each time
    takes = COUNTS[choice]
    at = stop - size
    heads = []
    while len(at):
        heads.append(at)
        at = at + takes[at]
        inside = at < stop
        at, stop = at[inside], stop[inside]
    heads = np.concatenate(heads)
    heads.sort()
    chosen = choice[heads]
    counts = COUNTS[chosen]
    escaped = chosen == 0
    place = np.arange(len(heads))
    if escaped.any():
        place += np.cumsum(escaped) - escaped
    words = np.zeros(len(heads) + int(escaped.sum()), _U)
    slot = np.arange(n) - np.repeat(heads, counts)
    shift = slot * np.repeat(BITS[chosen], counts)
    shift[heads] = 0
    parts = np.bitwise_or.reduceat(values << shift.astype(_U), heads)
    words[place] = np.where(escaped, _U(0), parts | (chosen.astype(_U) << _U(60)))
    words[place[escaped] + 1] = values[heads[escaped]]
    edges = np.searchsorted(heads, np.cumsum(size) - size)
    n_words = np.add.reduceat(1 + escaped, edges)
    return words, n_words.astype(np.int64)


def decode(words: np.ndarray) -> np.ndarray:
    """All values of whole blocks laid end to end, in order."""
    words = words.astype(_U, copy=False)
    selector = (words >> _U(60)).astype(np.int64)
    # only an escape is zero: the value after it has more than 60 bits
    raw = np.zeros(len(words), bool)
    raw[np.flatnonzero(words == 0) + 1] = True
    keep = np.flatnonzero(words)
    counts = np.where(raw[keep], 1, COUNTS[np.minimum(selector[keep], len(BITS) - 1)])
    owner = np.repeat(np.arange(len(keep)), counts)
    slot = np.arange(len(owner)) - np.repeat(np.cumsum(counts) - counts, counts)
    bits = np.where(raw[keep], 64, BITS[np.minimum(selector[keep], len(BITS) - 1)])[owner]
    shift = np.where(bits == 64, 0, slot * bits).astype(_U)
    mask = np.where(bits == 64, _U(0xFFFFFFFFFFFFFFFF),
                    (_U(1) << np.minimum(bits, 63).astype(_U)) - _U(1))
    return (words[keep][owner] >> shift) & mask
