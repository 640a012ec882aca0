"""Range asymmetric numeral system over token ids, many blocks at once in numpy.

A block is ``LANES`` interleaved states over ``BLOCK`` symbols; all blocks of a call
share one frequency table and are coded in step, as rows of one array. Symbols are
coded backwards. Every ``SEGMENT`` symbols the encoder notes its states and the place in
the block's word stream, so that a decoder can start there: segments are decoded in step
as well, which makes them the unit of parallel decoding.
"""

from __future__ import annotations

import zlib

import numpy as np

LANES = 32
SEGMENT = 8192
BLOCK = 8 * SEGMENT
SCALE = 18
_LOW = np.uint64(1 << 31)
_STEPS = SEGMENT // LANES


def frequencies(counts: np.ndarray) -> np.ndarray:
    """Counts scaled to a sum of ``2 ** SCALE``, at least 1 for each symbol that occurs."""
    total, whole = int(counts.sum()), 1 << SCALE
    if np.count_nonzero(counts) > whole:
        raise ValueError(f"more than {whole} different symbols")
    scaled = np.where(counts > 0, np.maximum(1, counts * whole // max(total, 1)), 0).astype(np.int64)
    rest = whole - int(scaled.sum())
    order = np.argsort(-scaled, kind="stable")
    if rest >= 0:
        scaled[order[0]] += rest
        return scaled
    for i in order:  # ones that were lifted are paid for by the most frequent symbols
        cut = min(-rest, int(scaled[i]) - 1, max(1, int(scaled[i]) // 2))
        scaled[i] -= cut
        rest += cut
        if rest == 0:
            return scaled
    return frequencies(scaled)


def _tables(freq: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    start = np.concatenate([[0], np.cumsum(freq)[:-1]])
    return freq.astype(np.uint64), start.astype(np.uint64)


def encode(symbols: np.ndarray, freq: np.ndarray) -> list[tuple[bytes, np.ndarray, np.ndarray, int]]:
    """Blocks of ``(words, states, places, crc32)``: the word stream, the states at the start
    of each segment, and how many words lie before it. The last block is filled up with
    the most frequent symbol."""
    n = len(symbols)
    blocks = -(-n // BLOCK)
    full = np.full(blocks * BLOCK, int(np.argmax(freq)), np.int64)
    full[:n] = symbols
    # Steps first, so that a step lies together.
    steps = np.ascontiguousarray(full.reshape(blocks, BLOCK // LANES, LANES).transpose(1, 0, 2))
    f, c = _tables(freq)
    limit, rest = f << np.uint64(63 - SCALE), np.uint64(1 << SCALE) - f
    state = np.full((blocks, LANES), _LOW, np.uint64)
    over, low = np.zeros(steps.shape, bool), np.zeros(steps.shape, np.uint32)
    states = np.zeros((blocks, BLOCK // SEGMENT, LANES), np.uint64)
    for t in range(BLOCK // LANES - 1, -1, -1):
        s = steps[t]
        np.greater_equal(state, limit[s], out=over[t])
        low[t] = state  # its low half
        state = np.where(over[t], state >> np.uint64(32), state)
        # state // f << SCALE, plus state % f, plus c
        state = state + state // f[s] * rest[s] + c[s]
        if t % _STEPS == 0:
            states[:, t // _STEPS] = state
    # Written from the last step and lane to the first, so read in the order of the symbols.
    over = np.ascontiguousarray(over.transpose(1, 0, 2))
    word = low.transpose(1, 0, 2)[over].astype("<u4")
    written = np.count_nonzero(over.reshape(blocks, BLOCK // SEGMENT, SEGMENT), axis=2)
    places = np.cumsum(written, axis=1) - written
    by_block = np.split(word, np.cumsum(written.sum(axis=1))[:-1]) if blocks else []
    out = []
    for b in range(blocks):
        stream, ends = by_block[b].tobytes(), places[b]
        crc = zlib.crc32(ends.astype("<i8").tobytes(), zlib.crc32(states[b].astype("<u8").tobytes(), zlib.crc32(stream)))
        out.append((stream, states[b], ends, crc))
    return out


def decode(blocks: list[tuple[bytes, np.ndarray, np.ndarray, int]], freq: np.ndarray, n: int) -> np.ndarray:
    """The ``n`` symbols of the blocks; a damaged block raises ``ValueError``."""
    for i, (stream, states, ends, crc) in enumerate(blocks):
        seen = zlib.crc32(ends.astype("<i8").tobytes(), zlib.crc32(states.astype("<u8").tobytes(), zlib.crc32(stream)))
        if seen != crc:
            raise ValueError(f"checksum of block {i}")
    if not blocks:
        return np.zeros(0, np.int64)
    streams = [np.frombuffer(b[0], "<u4") for b in blocks]
    base = np.cumsum([0] + [len(s) for s in streams])
    word = np.concatenate(streams + [np.zeros(LANES, np.uint32)]).astype(np.uint64)
    at = np.concatenate([b[2] + base[i] for i, b in enumerate(blocks)])
    state = np.concatenate([b[1] for b in blocks]).astype(np.uint64)
    f, c = _tables(freq)
    slot = np.repeat(np.arange(len(freq)), freq)
    out = np.empty((len(state), _STEPS, LANES), np.int64)
    low = np.uint64((1 << SCALE) - 1)
    for t in range(_STEPS):
        r = state & low
        s = slot[r.view(np.int64)]
        out[:, t] = s
        state = f[s] * (state >> np.uint64(SCALE)) + r - c[s]
        under = state < _LOW
        lanes = np.flatnonzero(under)
        read = np.count_nonzero(under, axis=1)
        ahead = np.cumsum(read) - read
        flat = state.reshape(-1)
        flat[lanes] = flat[lanes] << np.uint64(32) | word[np.repeat(at - ahead, read) + np.arange(len(lanes))]
        at = at + read
    return out.reshape(-1)[:n]
