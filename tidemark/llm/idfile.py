"""Token-id files: adaptive context mixing drives a range coder over independent, checksummed blocks.

Per id three predictions are mixed: the id that last followed the previous two ids (order 2), the one that last
followed the previous id (order 1), and an order-0 distribution of the block's ids so far, with buckets for new ids.
How far orders 2 and 1 are trusted is learned from their past success at the same confidences. Their tables change
with every id; trust and order 0 are learned anew at fixed places of a block (_LEARNED). A block starts from an
empty model, so it can be decoded alone. When writing, all intervals are worked out for whole blocks at once, and
only the range coder runs in lockstep, one numpy lane a block; reading does both in lockstep. A lane never looks at
another.

File: the magic, then blocks of
    u32 ids, u32 documents, u32 payload bytes, u32 crc32 of everything else in the block
    per document: i64 key, u32 ids in this block, u8 flags (1 begins here, 2 ends here, 4 the key is null)
    payload
All integers are little-endian.
"""

from __future__ import annotations

import struct
import uuid
import zlib
from collections.abc import Iterable, Iterator
from itertools import islice

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.llm import store, tokens
from tidemark.llm.batches import mapped

MAGIC = b"IDMIX2\n"
BLOCK_IDS, LANES, READ_LANES = 4096, 2048, 2560
HEAD, DOC = struct.Struct("<IIII"), struct.Struct("<qIB")
BEGINS, ENDS, NULL_KEY = 1, 2, 4
_BITS, _LEAST = 12, 64  # shares of the mix, and the least of order 0
_ONE = 1 << _BITS
_SLOTS1, _SLOTS2 = 12, 13  # bits
_STATES = 128
_LOW, _BUCKETS = 10, 64  # ids are new to a block by buckets of 1,024
_LEARNED = (0, 32, 64, 128, 256, 512, 1024, 1536, 2048, 3072)  # where shares and order 0 are learned anew
_TOGETHER, _STRIP = 32, 64  # lanes modelled and steps laid out at a time, so that arrays stay in the cache
_COUNTED = 256  # steps counted at a time
_SHIFT, _SIXTEEN, _DIGIT, _KEPT = np.uint64(_BITS), np.uint64(16), np.uint64(32), np.uint64(30)
_WHOLE, _BOTTOM, _KEPT_MASK = np.uint64((1 << 62) - 1), np.uint64(1 << 30), np.uint64((1 << 30) - 1)
_SURE, _SURER = np.array([[7], [56]], np.uint32), np.array([[1], [8]], np.uint32)  # confidence bits of orders 1 and 2
_ZERO, _LOW16, _LOW_MASK, _NEW = np.uint64(0), np.uint64(0xFFFF), np.uint64((1 << _LOW) - 1), np.uint64(1 << 16)


class _Trust:
    """How often each guess was right, by lane and state: the two confidences, and whether both orders guess the same id."""

    def __init__(self, lanes: int) -> None:
        self.seen = np.zeros(lanes * _STATES * 4, np.int32)

    def learn(self, one: np.ndarray, two: np.ndarray, ids: np.ndarray, lane: np.ndarray, lanes: int) -> None:
        """From what the contexts told before each of ``ids``; ``lane`` is broadcast to them."""
        for first in range(0, len(ids), _COUNTED):  # what it works with stays small beside the tables
            self._count(*(x[first : first + _COUNTED] for x in (one, two, ids)), lane, lanes)

    def _count(self, one: np.ndarray, two: np.ndarray, ids: np.ndarray, lane: np.ndarray, lanes: int) -> None:
        told1, told2 = one >> np.uint32(6), two >> np.uint32(6)
        right2 = (told2 == ids) & ((two & 56) > 0)
        right1 = (told1 == ids) & ((one & 7) > 0) & ~right2
        at = (_state(one, two, told1 == told2).astype(np.int64) + lane * _STATES) * 4 + right2 * 2 + right1
        self.seen[: lanes * _STATES * 4] += np.bincount(at.ravel(), minlength=lanes * _STATES * 4).astype(np.int32)

    def shares(self, lanes: int) -> tuple[np.ndarray, np.ndarray]:
        """Of _ONE in every state: the share of order 2, and of orders 2 and 1 together; the rest is order 0's."""
        seen = self.seen[: lanes * _STATES * 4].reshape(lanes, _STATES, 4).astype(np.uint32)
        n = 2 * seen.sum(axis=2, dtype=np.uint32) + np.uint32(4)
        state = np.arange(_STATES)
        has1, has2, same = (state & 7) > 0, (state & 56) > 0, state >= 64
        f2 = np.where(has2, ((2 * seen[:, :, 2] + np.where(same & has1, 2, 1).astype(np.uint32)) << np.uint32(_BITS)) // n, np.uint32(0))
        f1 = np.where(has1 & ~(same & has2), ((2 * seen[:, :, 1] + np.uint32(1)) << np.uint32(_BITS)) // n, np.uint32(0))
        both = np.minimum(f2 + f1, np.uint32(_ONE - _LEAST))
        return np.minimum(f2, both).ravel(), both.ravel()


def _state(one: np.ndarray, two: np.ndarray, same: np.ndarray) -> np.ndarray:
    return (one & np.uint32(7)) | (two & np.uint32(56)) | (same.astype(np.uint32) << np.uint32(6))


def _slots(one: np.ndarray, two: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Where order 1 and order 2 look, after the ids ``two``, ``one``."""
    mixed = one * np.uint32(40503)
    return (mixed & np.uint32(0xFFFF)) >> np.uint32(16 - _SLOTS1), ((mixed + two * np.uint32(48271)) & np.uint32(0xFFFF)) >> np.uint32(16 - _SLOTS2)


def _told(slot: np.ndarray, ids: np.ndarray, shift: int) -> np.ndarray:
    """What a context table holds before each id: the confidence from bit ``shift`` on, and from bit 6 the id that last followed in its slot."""
    lanes, n = ids.shape
    key = np.sort((slot << np.uint32(12)) | np.arange(n, dtype=np.uint32), axis=1)
    at = (key & np.uint32(4095)).astype(np.int64) + (np.arange(lanes) * n)[:, None]
    follows = ids.ravel()[at]
    known = np.zeros((lanes, n), bool)
    known[:, 1:] = (key[:, 1:] ^ key[:, :-1]) < 4096
    hit = np.zeros((lanes, n), bool)
    hit[:, 1:] = known[:, 1:] & (follows[:, 1:] == follows[:, :-1])
    place = np.arange(n, dtype=np.int32)
    missed = np.maximum.accumulate(np.where(hit, np.int32(0), place), axis=1)
    entry = np.zeros((lanes, n), np.uint32)
    sure = np.minimum(1 + place[:-1] - missed[:, :-1], 7).astype(np.uint32)
    entry[:, 1:] = ((follows[:, :-1] << np.uint32(6)) | (sure << np.uint32(shift))) * known[:, 1:]
    out = np.empty(lanes * n, np.uint32)
    out[at.ravel()] = entry.ravel()
    return out.reshape(lanes, n)


def _ranked(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each id's rank among the distinct ids of its lane, whether it is the first of its kind, and the id of each rank."""
    lanes, n = ids.shape
    key = np.sort((ids << np.uint32(12)) | np.arange(n, dtype=np.uint32), axis=1)
    value = key >> np.uint32(12)
    new = np.zeros((lanes, n), np.int32)
    new[:, 1:] = value[:, 1:] != value[:, :-1]
    rank = np.cumsum(new, axis=1, dtype=np.int32)
    at = ((key & np.uint32(4095)) + (np.arange(lanes) * n)[:, None]).ravel()
    out, first = np.empty(lanes * n, np.int32), np.empty(lanes * n, bool)
    new[:, 0] = 1
    out[at], first[at] = rank.ravel(), new.ravel()
    symbol = np.zeros((lanes, int(rank[:, -1].max(initial=0)) + 1), np.uint32)
    symbol.ravel()[(rank + (np.arange(lanes) * symbol.shape[1])[:, None])[new > 0]] = value[new > 0]
    return out.reshape(lanes, n), first.reshape(lanes, n), symbol


def _intervals(ids: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Per id six numbers: begin and width among the mixed shares, then begin, width and total in order 0, and what is left of a new id.

    ``ids`` are whole lanes (unsigned 32-bit, short ones filled up), ``lengths`` fall.
    """
    lanes, n = ids.shape
    before = np.zeros((2, lanes, n), np.uint32)
    before[0, :, 1:], before[1, :, 2:] = ids[:, :-1], ids[:, :-2]
    slot1, slot2 = _slots(*before)
    one, two = _told(slot1, ids, 0), _told(slot2, ids, 3)
    rank, fresh, symbol = _ranked(ids)
    kinds = symbol.shape[1]
    lane = np.arange(lanes)[:, None]
    rank = rank + lane * kinds
    bucket = (ids >> np.uint32(_LOW)) + lane * _BUCKETS
    spot = (symbol >> np.uint32(_LOW)) + lane * _BUCKETS
    trust, count, weights = _Trust(lanes), np.zeros((lanes, kinds), np.int32), np.ones((lanes, _BUCKETS), np.int32)
    out = np.zeros((6, lanes, n), np.uint16)
    for begin, end in _phases(n):
        k = int(np.searchsorted(-lengths, -begin, side="left"))
        here = slice(begin, min(end, n))
        now, one_, two_ = ids[:k, here], one[:k, here], two[:k, here]
        shares = (f := trust.shares(k))[0] | (f[1] << np.uint32(16))
        told1, told2 = one_ >> np.uint32(6), two_ >> np.uint32(6)
        share = shares.take(_state(one_, two_, told1 == told2) + lane[:k] * _STATES)
        f2, both = (share & np.uint32(0xFFFF)).astype(np.uint16), (share >> np.uint32(16)).astype(np.uint16)
        pick2 = (told2 == now) & (f2 > 0)
        pick = pick2 | ((told1 == now) & (both > f2))
        # the first unit, the number of units from bit 13, and bit 26 for a seen id
        own = np.cumsum(weights[:k], axis=1, dtype=np.int32) - weights[:k] + np.int32(begin) + (weights[:k] << np.int32(13))
        held = np.cumsum(count[:k], axis=1, dtype=np.int32) - count[:k] + (count[:k] << np.int32(13)) + np.int32(1 << 26)
        held = np.where(count[:k] > 0, held, own.take(spot[:k]))
        units = held.take(rank[:k, here])
        units[pick] = (1 << 13) | (1 << 26)
        total = weights[:k].sum(axis=1, keepdims=True).astype(np.uint16) + np.uint16(begin)
        first = np.where(pick, f2, both)
        first[pick2] = 0
        out[0, :k, here] = first
        out[1, :k, here] = np.where(pick, np.where(pick2, f2, both - f2), np.uint16(_ONE) - both)
        out[2, :k, here] = units & np.int32(0x1FFF)
        out[3, :k, here] = (units >> np.int32(13)) & np.int32(0x1FFF)
        out[4, :k, here] = np.where(pick, np.uint16(1), total)
        out[5, :k, here] = np.where(units < 1 << 26, (now & np.uint32((1 << _LOW) - 1)) | np.uint32(1 << 15), np.uint32(0))
        if end < n:
            trust.learn(one_, two_, now, lane[:k], k)
            count[:k] += np.bincount(rank[:k, here].ravel(), minlength=k * kinds).reshape(k, kinds)
            weights[:k] += np.bincount(bucket[:k, here][fresh[:k, here]], minlength=k * _BUCKETS).reshape(k, _BUCKETS)
    return out


def _phases(n: int) -> list[tuple[int, int]]:
    return [(a, b) for a, b in zip(_LEARNED, (*_LEARNED[1:], BLOCK_IDS), strict=True) if a < n]


def _write(parts: np.ndarray, lengths: np.ndarray) -> list[bytes]:
    """Narrows all lanes in lockstep by the intervals of ``_intervals``."""
    _, lanes, n = parts.shape
    low, width = np.zeros(lanes, np.uint64), np.full(lanes, _WHOLE, np.uint64)
    out, size = np.zeros(lanes * (n + 4), np.uint64), np.arange(lanes, dtype=np.int64) * (n + 4)
    unit, step = np.empty(lanes, np.uint64), np.empty(lanes, np.uint64)
    for t in range(n):
        if t % _STRIP == 0:
            strip = np.ascontiguousarray(parts[:, :, t : t + _STRIP].transpose(2, 0, 1)).astype(np.uint64)
            drop = (strip[:, 5] >> np.uint64(15)) * np.uint64(_LOW)
            strip[:, 5] &= np.uint64((1 << _LOW) - 1)
        k = int(np.searchsorted(-lengths, -t, side="left"))  # lanes longer than t
        begin, share, first, count, total, rest = strip[t % _STRIP, :, :k]
        lo, wide, u, x = low[:k], width[:k], unit[:k], step[:k]
        np.right_shift(wide, _SHIFT, out=u)
        np.multiply(u, begin, out=x)
        np.add(lo, x, out=lo)
        np.multiply(u, share, out=u)
        np.floor_divide(u, total, out=u)
        np.multiply(u, first, out=x)
        np.add(lo, x, out=lo)
        np.multiply(u, count, out=u)
        np.right_shift(u, drop[t % _STRIP, :k], out=wide)
        np.multiply(wide, rest, out=x)
        np.add(lo, x, out=lo)
        go = np.flatnonzero(wide < _BOTTOM)
        if len(go):
            digit = lo[go]
            at = size[go]
            out[at] = digit >> _KEPT
            size[go] = at + 1
            lo[go] = (digit & _KEPT_MASK) << _DIGIT
            wide[go] <<= _DIGIT
    out[size] = low >> _KEPT
    out[size + 1] = (low & _KEPT_MASK) << np.uint64(2)
    grid = out.reshape(lanes, n + 4)
    size = size + 2 - np.arange(lanes) * (n + 4)
    grid = grid[:, : int(size.max(initial=0))]
    for c in range(grid.shape[1] - 1, 0, -1):  # a digit holds its carry in bit 32
        grid[:, c - 1] += grid[:, c] >> _DIGIT
    return [row[:m].tobytes() for row, m in zip(grid.astype("<u4"), size.tolist(), strict=True)]


def _places(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Order 0 learned from whole rows of ids: what each unit of the total stands for (all lanes on end), and the totals.

    A seen id has as many units as it was seen. New ids have one for each distinct id of their bucket and one more.
    An entry is the first unit, the number of units from bit 16, the id from bit 32, and bit 48 for a bucket.
    """
    lanes, n = ids.shape
    flat = np.sort(ids, axis=1, kind="stable").ravel()
    new = np.ones(len(flat), bool)
    new[1:] = flat[1:] != flat[:-1]
    new[:: max(n, 1)] = True
    at = np.flatnonzero(new)
    count, lane, symbol = np.diff(at, append=len(flat)), at // max(n, 1), flat[at].astype(np.int64)
    distinct = np.bincount(lane, minlength=lanes)
    weights = 1 + np.bincount(lane * _BUCKETS + (symbol >> _LOW), minlength=lanes * _BUCKETS).reshape(lanes, _BUCKETS)
    entry, times = np.empty(len(at) + lanes * _BUCKETS, np.int64), np.empty(len(at) + lanes * _BUCKETS, np.int64)
    spot = np.arange(len(at)) + lane * _BUCKETS
    entry[spot], times[spot] = (at - lane * n) | (count << 16) | (symbol << 32), count
    number = np.arange(_BUCKETS)
    spot = (np.cumsum(distinct) + np.arange(lanes) * _BUCKETS)[:, None] + number
    entry[spot], times[spot] = (n + np.cumsum(weights, axis=1) - weights) | (weights << 16) | (number << (32 + _LOW)) | (1 << 48), weights
    return np.repeat(entry, times).view(np.uint64), n + distinct + _BUCKETS


def _read(payloads: list[bytes], lengths: np.ndarray) -> np.ndarray:
    """The ids of all lanes, a row per lane; ``lengths`` fall."""
    lanes, n = len(lengths), int(lengths[0]) if len(lengths) else 0
    digits = np.zeros((lanes, max(map(len, payloads), default=0) // 4 + 4), np.uint64)
    for row, p in zip(digits, payloads, strict=True):
        row[: len(p) // 4] = np.frombuffer(p, "<u4", len(p) // 4)
    code = (digits[:, 0] << _KEPT) | (digits[:, 1] >> np.uint64(2))
    later = (((digits[:, 1:-1] << _KEPT) | (digits[:, 2:] >> np.uint64(2))) & np.uint64(0xFFFFFFFF)).ravel()
    following = np.arange(lanes, dtype=np.int64) * (digits.shape[1] - 2)
    width = np.full(lanes, _WHOLE, np.uint64)
    table = np.zeros(lanes * ((1 << _SLOTS1) + (1 << _SLOTS2)), np.uint32)  # lanes side by side in each slot: frequent slots stay in the cache
    lane = np.arange(lanes, dtype=np.int64)
    own = np.stack([lane, lane + (lanes << _SLOTS1)])
    before, at = np.zeros(lanes, np.uint32), own.copy()
    slot = np.zeros((2, lanes), np.uint32)
    grid = np.zeros((n, lanes), np.uint16)
    trust = _Trust(lanes)
    for begin, end in _phases(n):
        end = min(end, n)
        k = int(np.searchsorted(-lengths, -begin, side="left"))
        f2, both = trust.shares(k)
        shares = np.ascontiguousarray((f2 | (both.astype(np.uint64) << _SIXTEEN)).reshape(k, _STATES).T).ravel()
        apart = k
        places = None  # the last ones go before others are made
        parts = [_places(np.ascontiguousarray(grid[:begin, a : min(a + _TOGETHER, k)].T)) for a in range(0, k, _TOGETHER)]
        places, total = (np.concatenate(x) for x in zip(*parts, strict=True))
        del parts
        own4 = np.cumsum(total) - total
        total = total.astype(np.uint64)
        most = total - np.uint64(1)
        told, found = np.zeros((end - begin, 2, k), np.uint32), np.zeros((end - begin, k), np.uint32)
        for t in range(begin, end):
            if t and lengths[k - 1] <= t:
                k = int(np.searchsorted(-lengths, -t, side="left"))
            entry = told[t - begin, :, :k] = table.take(at[:, :k], mode="clip")
            guess = entry >> np.uint32(6)
            told1, told2 = guess
            share = shares.take(_state(*entry, told1 == told2) * np.int64(apart) + lane[:k], mode="clip")
            c, wide = code[:k], width[:k]
            unit = wide >> _SHIFT
            a, b = unit * (share & _LOW16), unit * (share >> _SIXTEEN)
            hit2, hit = c < a, c < b
            u = ((unit << _SHIFT) - b) // total[:k]
            s = np.minimum((c - b) // u, most[:k]).view(np.int64)
            s += own4[:k]
            e = places.take(s, mode="clip")
            lo, w = (e & _LOW16) * u, ((e >> _SIXTEEN) & _LOW16) * u
            lo += b
            e >>= _DIGIT
            ids = e.astype(np.uint32)
            new = np.flatnonzero((e >= _NEW) > hit)
            if len(new):
                part = w[new] >> np.uint64(_LOW)
                rest = np.minimum((c[new] - lo[new]) // part, _LOW_MASK)
                lo[new] += rest * part
                w[new] = part
                ids[new] = (ids[new] & np.uint32(0xFFFF)) | rest.astype(np.uint32)
            b -= a
            np.copyto(lo, a, where=hit)
            np.copyto(w, b, where=hit)
            np.copyto(ids, told1, where=hit)
            np.copyto(lo, _ZERO, where=hit2)
            np.copyto(w, a, where=hit2)
            np.copyto(ids, told2, where=hit2)
            c -= lo
            wide[:] = w
            go = np.flatnonzero(w < _BOTTOM)
            if len(go):
                next_ = following[go]
                c[go] = (c[go] << _DIGIT) | later.take(next_, mode="clip")
                following[go] = next_ + 1
                wide[go] <<= _DIGIT
            found[t - begin, :k] = ids
            entry &= _SURE
            entry += _SURER
            np.minimum(entry, _SURE, out=entry)
            entry *= guess == ids
            np.maximum(entry, _SURER, out=entry)
            entry |= ids << np.uint32(6)
            table[at[:, :k]] = entry
            slot[0, :k], slot[1, :k] = _slots(ids, before[:k])
            np.multiply(slot[:, :k], np.int64(lanes), out=at[:, :k])
            at[:, :k] += own[:, :k]
            before[:k] = ids
        grid[begin:end, : found.shape[1]] = found
        k = found.shape[1]
        if end < n:
            trust.learn(told[:, 0], told[:, 1], found, lane[:k], k)
    return np.ascontiguousarray(grid.T)


def encode(blocks: list[np.ndarray]) -> list[bytes]:
    """Each block of at most BLOCK_IDS ids (below 65,536) as bytes of its own."""
    order = sorted(range(len(blocks)), key=lambda k: -len(blocks[k]))
    lengths = np.array([len(blocks[k]) for k in order], np.int64)
    n = int(lengths.max(initial=0))
    if n > BLOCK_IDS or any(len(b) and int(b.max()) > 0xFFFF for b in blocks):
        raise ValueError(f"a block is at most {BLOCK_IDS:,} ids, and ids must be below 65,536")
    parts = np.zeros((6, len(blocks), n), np.uint16)
    for k in range(0, len(blocks) if n else 0, _TOGETHER):
        ids = np.zeros((len(order[k : k + _TOGETHER]), n), np.uint32)
        for row, b in zip(ids, order[k : k + _TOGETHER], strict=True):
            row[: len(blocks[b])] = blocks[b]
        parts[:, k : k + _TOGETHER] = _intervals(ids, lengths[k : k + _TOGETHER])
    out = [b""] * len(blocks)
    for k, data in zip(order, _write(parts, lengths), strict=True):
        out[k] = data
    return out


def decode(payloads: list[bytes], sizes: list[int]) -> list[np.ndarray]:
    if max(sizes, default=0) > BLOCK_IDS:
        raise ValueError("a block is too long")
    order = sorted(range(len(sizes)), key=lambda k: -sizes[k])
    grid = _read([payloads[k] for k in order], np.array([sizes[k] for k in order], np.int64))
    out = [np.zeros(0, np.uint32)] * len(sizes)
    for row, k in zip(grid, order, strict=True):
        out[k] = row[: sizes[k]].astype(np.uint32)
    return out


def packed_blocks(documents: list[tuple[int | None, np.ndarray]], begun: bool = False) -> Iterator[bytes]:
    """Blocks of whole and cut documents."""
    table: list[list[tuple[int, int, int]]] = [[]]
    parts: list[list[np.ndarray]] = [[]]
    room = BLOCK_IDS
    for key, ids in documents:
        at = 0
        while at < len(ids):
            if not room:
                table.append([])
                parts.append([])
                room = BLOCK_IDS
            n = min(room, len(ids) - at)
            flags = BEGINS * (at == 0) | ENDS * (at + n == len(ids)) | NULL_KEY * (key is None)
            table[-1].append((key or 0, n, flags))
            parts[-1].append(ids[at : at + n])
            at, room = at + n, room - n
    blocks = [np.concatenate(p) for p in parts if p]
    for docs, ids, data in zip(table, blocks, encode(blocks), strict=False):
        body = b"".join(DOC.pack(*d) for d in docs) + data
        head = struct.pack("<III", len(ids), len(docs), len(data))
        yield head + struct.pack("<I", zlib.crc32(body, zlib.crc32(head))) + body


def _blocks(stream) -> Iterator[tuple[list[tuple[int | None, int, int]], bytes, int]]:
    """The document table, payload and number of ids of each block, checked against its checksum."""
    if stream.read(len(MAGIC)) != MAGIC:
        raise ValueError("not a token-id file")
    while head := stream.read(HEAD.size):
        if len(head) < HEAD.size:
            raise ValueError("the file ends inside a block")
        n, docs, size, check = HEAD.unpack(head)
        body = stream.read(docs * DOC.size + size)
        if len(body) != docs * DOC.size + size or zlib.crc32(body, zlib.crc32(head[:12])) != check:
            raise ValueError("a block is damaged")
        yield [(None if f & NULL_KEY else key, m, f) for key, m, f in DOC.iter_unpack(body[: docs * DOC.size])], body[docs * DOC.size :], n


def _together(streams: Iterable) -> Iterator[tuple[int, list[tuple[int | None, int, int]], np.ndarray]]:
    """The number of the stream, document table and ids of each block; blocks of several streams are read in lockstep."""
    blocks = ((k, *block) for k, stream in enumerate(streams) for block in _blocks(stream))
    while some := list(islice(blocks, READ_LANES)):
        for (k, table, _, _), ids in zip(some, decode([b[2] for b in some], [b[3] for b in some]), strict=True):
            yield k, table, ids


def unpacked(stream) -> Iterator[tuple[list[tuple[int | None, int, int]], np.ndarray]]:
    """The document table and ids of each block, checked against its checksum."""
    for _, table, ids in _together([stream]):
        yield table, ids


def write(docs: DataFrame, folder: str, *, key: str = "doc_id", text: str = "text", vocabulary: str = tokens.BYTE_BPE, end_id: int = 2) -> DataFrame:
    """Writes all documents in ascending key order, nulls first, equal keys by text hash; a file per partition.

    Returns the manifest (file, path, n_ids), where file numbers give the order. A null or empty text is its
    end id alone. Keys are integers; other columns are ignored.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = tokens.encoder(vocabulary)
        where, root = store.opened(folder)
        where.create_dir(root, recursive=True)
        number = TaskContext.get().partitionId()
        name = f"{number:06d}-{uuid.uuid4().hex}.ids"
        held, size, total = [], 0, 0
        with where.open_output_stream(f"{root}/{name}", compression=None) as out:
            out.write(MAGIC)
            for batch in batches:
                for k, ids in zip(batch["key"].to_pylist(), coder.ids(batch["text"].to_pylist()), strict=True):
                    held.append((k, np.append(ids, np.uint32(end_id))))
                    size += len(held[-1][1])
                    if size >= BLOCK_IDS * LANES:
                        out.write(b"".join(packed_blocks(held)))
                        held, size, total = [], 0, total + size
            if held:
                out.write(b"".join(packed_blocks(held)))
        yield pa.RecordBatch.from_arrays([pa.array([number], pa.int64()), pa.array([f"{folder}/{name}"]), pa.array([total + size], pa.int64())], names=["file", "path", "n_ids"])

    rows = docs.select(F.col(key).cast("bigint").alias("key"), F.col(text).alias("text")).withColumn("tie", F.xxhash64("text"))
    parts = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = rows.repartitionByRange(parts, "key", "tie").sortWithinPartitions("key", "tie").select("key", "text")
    schema = "file bigint, path string, n_ids bigint"
    mapped(rows, run, schema).write.parquet(f"{folder}/manifest")
    return docs.sparkSession.read.schema(schema).parquet(f"{folder}/manifest")


def read(manifest: DataFrame, *, with_ids: bool = False) -> DataFrame:
    """key, start (ids of all documents before it), n_tokens, ids_crc32 (and ids) of every document in the files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files = [f for batch in batches for f in zip(batch["path"].to_pylist(), batch["first"].to_pylist(), strict=True)]

        def streams():
            for uri, _ in files:
                where, name = store.opened(uri)
                with where.open_input_stream(name, compression=None) as stream:
                    yield stream

        rows, kept, size, check, file, start = [], [], 0, 0, -1, 0
        for number, table, ids in _together(streams()):
            if number != file:
                file, start = number, files[number][1]
            at = 0
            for k, n, flags in table:
                part = ids[at : at + n].astype("<u4")
                at += n
                if flags & BEGINS:
                    kept, size, check = [], 0, 0
                size, check = size + n, zlib.crc32(part.tobytes(), check)
                if with_ids:
                    kept.append(part)
                if flags & ENDS:
                    rows.append((k, start, size, check, np.concatenate(kept).astype(np.int64) if with_ids else None))
                    start += size
            if len(rows) >= 5_000:
                yield made(rows)
                rows = []
        if rows:
            yield made(rows)

    def made(rows: list[tuple]) -> pa.RecordBatch:
        columns = list(zip(*rows, strict=True))
        arrays = [pa.array(c, pa.int64()) for c in columns[:4]] + ([pa.array(columns[4], pa.list_(pa.int64()))] if with_ids else [])
        return pa.RecordBatch.from_arrays(arrays, names=["key", "start", "n_tokens", "ids_crc32", "ids"][: len(arrays)])

    before = Window.orderBy("file").rowsBetween(Window.unboundedPreceding, -1)  # a row per file
    placed = manifest.select("path", F.coalesce(F.sum("n_ids").over(before), F.lit(0)).alias("first"))
    schema = "key bigint, start bigint, n_tokens bigint, ids_crc32 bigint" + ", ids array<bigint>" * with_ids
    # lockstep pays by lanes: a task reads as many files as fill READ_LANES, if enough tasks are left for all cores
    files, ids = manifest.agg(F.count("*"), F.coalesce(F.sum("n_ids"), F.lit(0))).first()
    spread = min(files, 2 * manifest.sparkSession.sparkContext.defaultParallelism)
    return mapped(placed.repartition(max(1, spread, ids // (BLOCK_IDS * READ_LANES) + 1)), run, schema)
