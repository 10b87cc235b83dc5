"""Adaptive context-mixing range coder for token ids.

An id is one step of the coder.  Three predictions share its range: the id that last followed the
previous two (order 2), the one that last followed the previous id (order 1), and the counts of
all ids of the block (order 0), which its table holds.  How much of the range a prediction gets adapts,
after every id, to how often predictions of its order and confidence came true.  All arithmetic
is on integers, so blocks decode alike everywhere.

Every block starts from a fresh model and has its own header, table and checksum.  Blocks are
independent, so many are coded side by side, one id of all of them at a time.

Block: magic "CM2", bytes of the table (u16), ids (u32), words (u32), CRC-32 of the ids as little-endian
u32 and of what follows the header (u32), then the table and 16-bit words, all little-endian.  Table, deflated:
differences of the distinct ids in rising order (the first is itself) as four planes of bytes, lowest first, and
their counts less one as two.
"""

from __future__ import annotations

import struct
import zlib
from collections.abc import Iterator, Sequence

import numpy as np

BLOCK_IDS = 4096
LANES = 1024  # blocks coded side by side; models and buffers of one take about 100 kB
MAGIC, HEADER = b"CM2", struct.Struct("<3sHIII")
SLOTS = 1024  # of an order's predictions in a block; contexts are hashed into them
SCALE = 16  # of the counts
FULL = np.uint64(1) << np.uint64(48)
LOW32, ONE32 = np.uint64(0xFFFFFFFF), np.uint64(1 << 32)
B16, B32 = np.uint64(16), np.uint64(32)
LEVELS = 8  # of confidence; nothing is predicted at 0
# 256ths of the counts' sum that a prediction gets, by its success rate in 256ths.  A step adds at most one word,
# as the whole is below 2^16 times the least part: 16 times BLOCK_IDS.
ODDS = np.minimum(7 * 256, (np.arange(256) * 256) // np.maximum(1, 256 - np.arange(256)))


class Damaged(ValueError):
    """A block whose header, table or checksum is wrong."""


class _Models:
    """State of the models of all lanes; predictions of both orders are rows of one array."""

    def __init__(self, size: np.ndarray):
        lanes = len(size)
        self.mass = size.astype(np.int64) * SCALE
        self.entry = np.zeros(2 * lanes * SLOTS, np.uint64)  # id, and its confidence above
        self.slots = np.arange(2 * lanes).reshape(2, lanes) * SLOTS
        # Success rates by order, lane and confidence, in 65536ths.
        rate = np.full((2 * lanes, LEVELS), 32768, np.int64)
        rate[:, 0] = 0
        self.rate = rate.reshape(-1)
        self.rates = np.arange(2 * lanes).reshape(2, lanes) * LEVELS
        self.last = np.zeros((2, lanes), np.uint32)

    def open(self, n: int) -> None:
        """Look up the predictions for the next id of the first n lanes, and their parts of the range."""
        p1, p2 = self.last[0, :n], self.last[1, :n]
        hashed = np.empty((2, n), np.uint32)
        np.multiply(p1, np.uint32(0x9E3779B1), out=hashed[0])
        np.bitwise_xor(p1 * np.uint32(0x85EBCA77), p2 * np.uint32(0xC2B2AE3D) + np.uint32(0x27D4EB2F), out=hashed[1])
        self.at = self.slots[:, :n] + (hashed >> np.uint32(22))
        entry = self.entry.take(self.at)
        self.said, self.sure = entry.astype(np.uint32), (entry >> B32).view(np.int64)
        self.place = self.rates[:, :n] + self.sure
        self.known = self.rate.take(self.place)
        weight = (self.mass[:n] * ODDS.take(self.known >> 8)) >> 8
        weight[0] *= self.said[0] != self.said[1]
        weight *= weight >= SCALE
        self.weight, self.both = weight, weight[0] + weight[1]
        self.total = self.mass[:n] + self.both

    def part(self, second: np.ndarray, first: np.ndarray, begin: np.ndarray, count: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Begin and size of the part of the range that the ids have, by what predicted them: order 2
        comes first, then order 1, then the counts."""
        low = np.where(second, 0, np.where(first, self.weight[1], begin * SCALE + self.both))
        own = np.where(second, self.weight[1], np.where(first, self.weight[0], count * SCALE))
        return low.view(np.uint64), own.view(np.uint64)

    def close(self, n: int, ids: np.ndarray) -> None:
        """Adapt to the ids that came and store them as the next predictions of their contexts."""
        live = self.sure > 0
        hit = self.said == ids
        self.rate[self.place] = self.known + ((hit * 65535 - self.known) >> 5) * live
        sure = np.where(hit & live, np.minimum(self.sure + 1, LEVELS - 1), 1)
        self.entry[self.at] = ids | (sure << 32).view(np.uint64)
        self.last[1, :n] = self.last[0, :n]
        self.last[0, :n] = ids


def _running(size: np.ndarray) -> np.ndarray:
    """Lanes with an id at each step, for sizes in falling order."""
    return np.searchsorted(-size, -np.arange(size[0]), side="left")


def _encode_lanes(blocks: Sequence[np.ndarray], found: Sequence[tuple]) -> list[bytes]:
    """Words of blocks in order of falling length."""
    size, lanes = np.array([len(b) for b in blocks]), len(blocks)
    ids, begin, count = (_side_by_side(x, size[0]) for x in (blocks, [f[2] for f in found], [f[3] for f in found]))
    models = _Models(size)
    # A step adds at most one word, the end three.
    out = np.zeros((size[0] + 4, lanes), np.uint32)
    flat, at = out.reshape(-1), np.arange(lanes)
    low, span = np.zeros(lanes, np.uint64), np.full(lanes, FULL)
    for t, n in enumerate(_running(size).tolist()):
        models.open(n)
        came = ids[t, :n]
        first, second = (models.said == came) & (models.weight > 0)
        begins, own = models.part(second, first, begin[t, :n].astype(np.int64), count[t, :n].astype(np.int64))
        unit = span[:n] // models.total.view(np.uint64)
        new_low = low[:n] + begins * unit
        new_span = unit * own
        short = new_span < ONE32
        flat[at[:n]] = new_low >> B32
        at[:n] += short * lanes
        shift = short * B16
        low[:n] = np.where(short, new_low & LOW32, new_low) << shift
        span[:n] = new_span << shift
        models.close(n, came)
    for _ in range(3):
        flat[at] = low >> B32
        low = (low & LOW32) << B16
        at += lanes
    for t in range(len(out) - 1, 0, -1):  # carries go to the word before
        out[t - 1] += out[t] >> 16
    words = (out & 0xFFFF).astype("<u2").T.copy()
    return [words[i, : at[i] // lanes].tobytes() for i in range(lanes)]


def _decode_lanes(payloads: Sequence[bytes], tables: Sequence[tuple], size: np.ndarray) -> list[np.ndarray]:
    lanes = len(payloads)
    words = _side_by_side([np.frombuffer(p, "<u2") for p in payloads], max(len(p) for p in payloads) // 2 + 4)
    flat, end = words.reshape(-1), words.size - lanes
    # Each id of a block in rising order, with where its run begins and how long it is.
    ordered = np.concatenate([
        np.repeat(own | ((np.cumsum(counts) - counts) << 32).view(np.uint64) | (counts << 48).view(np.uint64), counts) for own, counts in tables])
    base = np.cumsum(size) - size
    ids = np.zeros((size[0], lanes), np.uint32)
    models = _Models(size)
    start = words[:3].astype(np.uint64)
    code = (start[0] << B32) | (start[1] << B16) | start[2]
    span, at = np.full(lanes, FULL), np.arange(lanes) + 3 * lanes
    for t, n in enumerate(_running(size).tolist()):
        models.open(n)
        unit = span[:n] // models.total.view(np.uint64)
        seen = np.minimum((code[:n] // unit).view(np.int64), models.total - 1)
        second, predicted = seen < models.weight[1], seen < models.both
        cell = ordered.take(base[:n] + (np.maximum(seen - models.both, 0) >> 4))
        begins, own = models.part(second, predicted, (cell >> B32).view(np.int64) & 0xFFFF, (cell >> np.uint64(48)).view(np.int64))
        came = np.where(second, models.said[1], np.where(predicted, models.said[0], cell.astype(np.uint32)))
        new_code = code[:n] - begins * unit
        new_span = unit * own
        short = new_span < ONE32
        shift = short * B16
        code[:n] = (new_code << shift) | (flat.take(at[:n]) * short)
        span[:n] = new_span << shift
        at[:n] = np.minimum(at[:n] + short * lanes, end)
        ids[t, :n] = came
        models.close(n, came)
    return [own[:n].copy() for own, n in zip(ids.T.copy(), size)]


def _counted(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Distinct ids in rising order and their counts; for every id, where its run begins in that order and its count."""
    order = np.argsort(ids.astype(np.uint16) if ids.max() < 1 << 16 else ids, kind="stable")
    ordered = ids[order]
    at = np.flatnonzero(np.concatenate([[True], ordered[1:] != ordered[:-1]]))
    counts = np.diff(at, append=len(ids))
    begin, count = np.empty(len(ids), np.uint16), np.empty(len(ids), np.uint16)
    begin[order] = np.repeat(at.astype(np.uint16), counts)
    count[order] = np.repeat(counts.astype(np.uint16), counts)
    return ordered[at], counts, begin, count


def _side_by_side(lanes: Sequence[np.ndarray], rows: int) -> np.ndarray:
    """Arrays as the columns of one, padded with zeros; some at a time, for the sake of the cache."""
    out = np.zeros((rows, len(lanes)), lanes[0].dtype)
    for i in range(0, len(lanes), 32):
        some = np.zeros((len(lanes[i : i + 32]), rows), out.dtype)
        for row, lane in zip(some, lanes[i : i + 32]):
            row[: len(lane)] = lane
        out[:, i : i + 32] = some.T
    return out


def _table(own: np.ndarray, counts: np.ndarray) -> bytes:
    steps = np.diff(own, prepend=np.uint32(0)).astype("<u4").view(np.uint8).reshape(-1, 4)
    return zlib.compress(steps.T.tobytes() + (counts - 1).astype("<u2").view(np.uint8).reshape(-1, 2).T.tobytes(), 6)


def _read_table(data: bytes, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct ids and their counts, which sum up to ``n``."""
    try:
        unpack = zlib.decompressobj()
        raw = np.frombuffer(unpack.decompress(data, 6 * n), np.uint8)
    except zlib.error as e:
        raise Damaged("table") from e
    if not unpack.eof or unpack.unused_data or len(raw) % 6:
        raise Damaged("table")
    k = len(raw) // 6
    own = np.cumsum(raw[: 4 * k].reshape(4, k).T.copy().view("<u4")[:, 0], dtype=np.uint32)
    counts = raw[4 * k :].reshape(2, k).T.copy().view("<u2")[:, 0].astype(np.int64) + 1
    if counts.sum() != n:
        raise Damaged("table")
    return own.astype(np.uint64), counts


def encode_blocks(blocks: Sequence[np.ndarray]) -> list[bytes]:
    """Blocks of up to BLOCK_IDS ids (unsigned, 32 bits) as bytes, header included."""
    out: list[bytes] = [HEADER.pack(MAGIC, 0, 0, 0, 0)] * len(blocks)
    for group in _grouped([len(b) for b in blocks]):
        found = [_counted(blocks[i]) for i in group]
        coded = _encode_lanes([blocks[i] for i in group], found)
        for i, (own, counts, *_), payload in zip(group, found, coded, strict=True):
            table, raw = _table(own, counts), blocks[i].astype("<u4")
            checksum = zlib.crc32(payload, zlib.crc32(table, zlib.crc32(raw.tobytes())))
            out[i] = HEADER.pack(MAGIC, len(table), len(raw), len(payload) // 2, checksum) + table + payload
    return out


def _grouped(size: Sequence[int]) -> Iterator[list[int]]:
    """Places of the blocks that have ids, longest first, cut evenly into LANES at most."""
    order = sorted((i for i, n in enumerate(size) if n), key=lambda i: -size[i])
    pieces = -(-len(order) // LANES)
    for k in range(pieces):
        yield order[k * len(order) // pieces : (k + 1) * len(order) // pieces]


def split_blocks(data: bytes) -> list[tuple[int, int, bytes, bytes]]:
    """(ids, checksum, table, words) of the blocks that follow each other in ``data``."""
    out, at = [], 0
    while at < len(data):
        if len(data) - at < HEADER.size:
            raise Damaged("header cut off")
        magic, table, ids, words, checksum = HEADER.unpack_from(data, at)
        at += HEADER.size
        end = at + table + 2 * words
        if magic != MAGIC or ids > BLOCK_IDS or end > len(data) or (not ids and end > at):
            raise Damaged("not a block, or cut off")
        out.append((ids, checksum, data[at : at + table], data[at + table : end]))
        at = end
    return out


def decode_blocks(blocks: Sequence[tuple[int, int, bytes, bytes]]) -> list[np.ndarray]:
    """Ids of blocks as ``split_blocks`` gives them; Damaged if a table or checksum is wrong."""
    if any(checksum for ids, checksum, *_ in blocks if not ids):
        raise Damaged("checksum")
    out: list[np.ndarray] = [np.zeros(0, np.uint32)] * len(blocks)
    for group in _grouped([b[0] for b in blocks]):
        size = np.array([blocks[i][0] for i in group])
        tables = [_read_table(blocks[i][2], blocks[i][0]) for i in group]
        decoded = _decode_lanes([blocks[i][3] for i in group], tables, size)
        for i, ids in zip(group, decoded, strict=True):
            _, checksum, table, words = blocks[i]
            if zlib.crc32(words, zlib.crc32(table, zlib.crc32(ids.astype("<u4").tobytes()))) != checksum:
                raise Damaged("checksum")
            out[i] = ids
    return out
