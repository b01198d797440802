"""Adaptive context-mixing range coder for token ids.

Ids are coded in blocks that reset all adaptive state and carry their own CRC-32, of code and ids. A frame holds many
blocks and a head: its distinct ids by falling frequency (an id's place there is its rank), groups of ids that others
follow alike, and the frequency of each rank after each group.

For each id, order 2 names the rank that followed the last two ids before in this block, order 1 the one that followed
the last. Whether order 2 is right, and if not, whether order 1 is, are two binary events: for each, three adaptive
probabilities - of order 0 by the block, of order 1 by the previous id, of order 2 or 1 by how often its guess held
last - are mixed by weights that follow how well each has predicted; they learn from each fourth id. An id that neither
names is coded by the head's frequencies after the previous id's group. All this drives an arithmetic coder with 62-bit ranges and 32-bit digits, in
integer arithmetic only, so that any machine decodes it.

Blocks of a frame advance together, one numpy lane each: a step costs some dozens of array operations for all blocks.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 2048
#: Groups of previous ids at most, and ids among which they are sought; the others are in the first group.
GROUPS, GROUPED = 64, 4096
#: Places of a frame, about, by which groups are sought.
_SAMPLED = 600_000
_BITS = 12  # of the probabilities of events
_LEAST = 32
_CONTEXTS, _HELD, _SLOTS = 8, 4, 64
_RATE = 4
#: Probabilities learn from each fourth id of a block, weights from each eighth; slots take every id.
_EVERY, _REWEIGH = 4, 8
#: Steps whose contexts and frequencies are looked up at once.
_STEPS = 16
#: Magic, ids, blocks, bytes of the packed head, kinds of ids, bits of frequencies, CRC-32 of packed head and index.
_HEAD = struct.Struct("<4sIIIIII")
_MAGIC = b"FTC4"
_EMPTY = -4
_U = np.uint64
_LOW = _U((1 << 30) - 1)
_FULL = _U(1 << 30)
_HALF, _LOWER = _U(32), _U(0xFFFFFFFF)


class _Model:
    """The adaptive state of all lanes. Arrays of two rows: the event of order 2, then that of order 1.

    Slots hold the rank that came last and how often in a row it was right, 3 at most. All indices are 64-bit, which
    numpy gathers and scatters fastest by.
    """

    def __init__(self, lanes: int):
        self.all = lanes
        self.q = np.full((3, 2, lanes), 1 << 13, np.int32)
        self.p = np.full(2 * lanes * (_CONTEXTS + _HELD), 1 << 13, np.int32)
        self.w = np.full((3, 2, lanes), 85, np.int32)
        self.slots = np.full(2 * lanes * _SLOTS, _EMPTY, np.int32)
        self.lanes(lanes)

    def lanes(self, n: int) -> None:
        """Go on with the first ``n`` lanes."""
        self.q, self.w = np.ascontiguousarray(self.q[:, :, :n]), np.ascontiguousarray(self.w[:, :, :n])
        own = np.arange(2)[:, None] * self.all + np.arange(n)
        self.base = np.stack([own * _CONTEXTS, 2 * self.all * _CONTEXTS + own * _HELD])
        self.at_slots = own * _SLOTS
        self.weighed, self.live = np.empty((3, 2, n), np.int32), np.empty(n, np.int32)

    def contexts(self, h1: np.ndarray, h2: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Slots, and places of probabilities as far as they hang on the ids before alone, of one step or of many.

        ``h1``, ``h2``: the hashes of the last rank and of the one before it, lanes last.
        """
        *steps, n = h1.shape
        slot, spot = np.empty((*steps, 2, n), np.int64), np.empty((*steps, 2, 2, n), np.int64)
        np.right_shift((h1 ^ h2 * 5) * 0x2C1B3C6D, 20, out=slot[..., 0, :])
        np.right_shift(h1, 8, out=slot[..., 1, :])
        slot &= _SLOTS - 1
        slot += self.at_slots
        np.add((h1 & (_CONTEXTS - 1))[..., None, :], self.base[0], out=spot[..., 0, :, :])
        return slot, spot

    def predict(self, slot: np.ndarray, spot: np.ndarray, mixed: np.ndarray) -> None:
        """Into ``mixed``: how likely each event is, of 1 << _BITS. Guesses: ``rank``, two rows."""
        held = self.slots.take(slot)
        self.rank = held >> 2
        held &= 3
        self.held = held
        np.add(self.base[1], held, out=spot[1])
        self.p.take(spot, out=self.q[1:], mode="clip")
        np.multiply(self.q, self.w, out=self.weighed)
        np.add.reduce(self.weighed, axis=0, dtype=np.int32, out=mixed)
        mixed >>= 24 - _BITS
        mixed |= _LEAST

    def update(self, four: np.ndarray, right: np.ndarray, came: np.ndarray, slot: np.ndarray, spot: np.ndarray, step: int) -> None:
        """``four``: the ranks that came, times 4; ``right``: which guesses they are; ``came``: which events came."""
        held = self.held
        held += held < 3
        held *= right
        held += four
        self.slots[slot] = held
        if step % _EVERY:
            return
        q = self.q
        target = np.multiply(came, 1 << 16, dtype=np.int32)
        change = target - q
        if step % _REWEIGH == 0:
            got = np.abs(change)
            got = (1 << 16) - got
            self.w += ((got << 8) // (got.sum(axis=0, dtype=np.int32) + 1) - self.w) >> 4
        change >>= _RATE
        np.right_shift(target[0], 16, out=self.live)
        self.live -= 1
        change[:, 1] &= self.live  # order 1's event comes only where order 2 was wrong
        q += change
        self.p[spot] = q[1:]


def _hashes(n: int) -> np.ndarray:
    """The hash of each rank."""
    h = np.arange(1, n + 1, dtype=np.int64) * 0x45D9F3B & 0xFFFFFFFF
    return h ^ (h >> 16)


def _turned(a: np.ndarray) -> np.ndarray:
    """Rows as columns, copied in strips that stay in the cache."""
    out = np.empty(a.shape[::-1], a.dtype)
    for i in range(0, len(a), 16):
        out[:, i : i + 16] = a[i : i + 16].T
    return out


def _distinct(ids: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted distinct ids, the place of each id among them, and their counts; by counting where ids are small."""
    if not len(ids) or ids.max() >= 1 << 20:
        return np.unique(ids, return_inverse=True, return_counts=True)
    counts = np.bincount(ids)
    table = np.flatnonzero(counts)
    place = np.zeros(len(counts), np.int32)
    place[table] = np.arange(len(table))
    return table.astype(np.uint32), place.take(ids), counts[table]


def _groups(before: np.ndarray, ranks: np.ndarray, n: int) -> np.ndarray:
    """The group of each rank, by which ranks follow it: spherical k-means, started from the most frequent ranks."""
    k = int(min(GROUPS, len(ranks) // (16 * n), n))
    out = np.zeros(n, np.uint8)
    if k < 2:
        return out
    m = min(n, GROUPED)
    step = max(3, len(ranks) // _SAMPLED)
    some = np.flatnonzero(before[::step] < m) * step
    what = ranks[some]
    what = np.where(what < 192, what, 192 + (what & 63))
    x = np.sqrt(np.bincount(before[some] * np.int64(256) + what, minlength=m * 256).reshape(m, 256).astype(np.float32))
    weight = np.sqrt((x * x).sum(axis=1, keepdims=True))
    unit = x / np.maximum(weight, 1e-6)
    centre = unit[:k]
    for _ in range(6):
        own = (unit @ centre.T).argmax(axis=1)
        centre = (own == np.arange(k)[:, None]).astype(np.float32) @ x
        centre /= np.maximum(np.sqrt((centre * centre).sum(axis=1, keepdims=True)), 1e-6)
    out[:m] = own
    return out


def _frequencies(spots: np.ndarray, k: int, n: int, bits: int) -> np.ndarray:
    """(k groups, n): frequencies of the ranks after each group, with a sum of 1 << bits; 0 for those that never follow.

    ``spots``: group * n + rank of each id.
    """
    counts = np.bincount(spots, minlength=k * n).reshape(k, n)
    total = counts.sum(axis=1, keepdims=True)
    out = np.where(counts, np.maximum(1, (counts << bits) // np.maximum(1, total)), 0)
    for i in np.flatnonzero(total):  # what rounding left over goes to the most frequent
        over = int(out[i].sum()) - (1 << bits)
        while over > 0:
            most = int(out[i].argmax())
            cut = min(over, int(out[i, most]) // 2)
            out[i, most] -= cut
            over -= cut
        out[i, int(out[i].argmax())] -= over
    return out


def encode(ids: np.ndarray) -> bytes:
    """One frame. Ids below 2**32, of at most 2**18 kinds; an empty array gives a frame without blocks."""
    ids = np.ascontiguousarray(ids, np.uint32)
    table, inverse, counts = _distinct(ids)
    order = np.argsort(-counts, kind="stable")
    table, n = table[order], len(table)
    if n > 1 << 18:
        raise ValueError("more distinct ids in a frame than the coder's ranks; encode fewer documents at a time")
    bits = max(14, n.bit_length() + 1)
    place = np.empty(n, np.int32)
    place[order] = np.arange(n, dtype=np.int32)
    blocks = -(-len(ids) // BLOCK)
    if not blocks:
        return _HEAD.pack(_MAGIC, 0, 0, 0, 0, bits, 0)
    ranks = np.zeros(blocks * BLOCK, np.int32)
    place.take(inverse, out=ranks[: len(ids)], mode="clip")
    before = np.zeros(len(ids), np.int32)
    before[1:] = ranks[: len(ids) - 1]
    before[::BLOCK] = 0
    groups = _groups(before, ranks[: len(ids)], n)
    rows = groups.astype(np.int64) * n
    frequency = _frequencies(rows.take(before) + ranks[: len(ids)], int(groups.max()) + 1, n, bits)
    packed = zlib.compress(table.astype("<u4").tobytes() + groups.tobytes() + frequency.astype("<u4").T.tobytes(), 6)
    digits, used = _encode_lanes(_turned(ranks.reshape(blocks, BLOCK)), rows, frequency, bits, len(ids) - BLOCK * (blocks - 1))
    coded = [d[:m].tobytes() for d, m in zip(digits, used, strict=True)]
    crcs = [zlib.crc32(ids[i * BLOCK : (i + 1) * BLOCK].astype("<u4", copy=False), zlib.crc32(c)) for i, c in enumerate(coded)]
    body = packed + np.array([used, crcs], dtype="<u4").tobytes()
    return _HEAD.pack(_MAGIC, len(ids), blocks, len(packed), n, bits, zlib.crc32(body)) + body + b"".join(coded)


def _intervals(frequency: np.ndarray) -> np.ndarray:
    """Where the interval of each rank of each group begins, in the upper half of a number, and its size."""
    return ((np.cumsum(frequency, axis=1, dtype=_U) - frequency.astype(_U) << _HALF) | frequency.astype(_U)).reshape(-1)


def _ends(mixed: np.ndarray) -> np.ndarray:
    """Where the interval of neither guess begins, of 1 << _BITS; order 2's ends, and order 1's begins, at its event's."""
    after = mixed[..., 0, :]
    return after + (((1 << _BITS) - after) * mixed[..., 1, :] >> _BITS)


def _encode_lanes(ranks: np.ndarray, rows: np.ndarray, frequency: np.ndarray, bits: int, last: int) -> tuple[np.ndarray, np.ndarray]:
    lanes = n = ranks.shape[1]
    model = _Model(lanes)
    low, width = np.zeros(lanes, _U), np.full(lanes, 1 << 62, _U)
    out = np.zeros((BLOCK + 8, lanes), _U)  # lanes side by side: they write at about the same height
    at = np.arange(lanes)
    flat = out.reshape(-1)
    whole, all_bits, event_bits = _U(1 << bits), _U(bits), _U(_BITS)
    intervals, hashes = _intervals(frequency), _hashes(frequency.shape[1])
    before, h = np.zeros((1, lanes), np.int32), np.zeros((2, lanes), np.int64)
    cuts = sorted({*range(0, BLOCK, _STEPS), last, BLOCK})
    for t, u in zip(cuts, cuts[1:], strict=False):
        if t == last:
            n -= 1
            if not n:
                break
            model.lanes(n)
        # what hangs on known ids alone, of all steps at once
        here = ranks[t:u, :n]
        before = np.concatenate((before[-1:, :n], here[:-1]))
        spots = rows.take(before)
        spots += here
        size = intervals.take(spots)
        h = np.concatenate((h[-2:, :n], hashes.take(here)))
        slots, places = model.contexts(h[1:-1], h[:-2])
        before, four = here, here << 2
        mixed, came = np.empty((u - t, 2, n), np.int32), np.empty((u - t, 2, n), bool)
        for i in range(u - t):
            model.predict(slots[i], places[i], mixed[i])
            right = model.rank == here[i]
            came[i, 0] = right[0]
            np.greater(right[1], right[0], out=came[i, 1])
            model.update(four[i], right, came[i], slots[i], places[i], t + i)
        end2, end1, hit2 = mixed[:, 0], _ends(mixed), came[:, 0]
        miss = ~(hit2 | came[:, 1])
        begin = np.where(miss, end1, np.where(hit2, 0, end2)).astype(_U)
        span = np.where(miss, 1 << _BITS, np.where(hit2, end2, end1)).astype(_U)
        span -= begin
        start = size >> _HALF
        start *= miss
        size &= _LOWER
        size[~miss] = whole
        lo, wi, a = low[:n], width[:n], at[:n]
        for i in range(u - t):
            wi >>= event_bits
            lo += wi * begin[i]
            wi *= span[i]
            wi >>= all_bits
            lo += wi * start[i]
            wi *= size[i]
            small = np.flatnonzero(wi < _FULL)
            if len(small):
                got, k = lo.take(small), a.take(small)
                flat[k] = got >> _U(30)
                a[small] = k + lanes
                lo[small] = (got & _LOW) << _U(32)
                wi[small] = wi.take(small) << _U(32)
    flat[at] = low >> _U(30)
    flat[at + lanes] = (low & _LOW) << _U(2)
    used = at // lanes + 2
    for j in range(int(used.max()) - 1, 0, -1):  # carries
        out[j - 1] += out[j] >> _U(32)
    return np.ascontiguousarray((out[: used.max()] & _U(0xFFFFFFFF)).astype("<u4").T), used


def decode(frame: bytes) -> np.ndarray:
    """The ids of a frame; ValueError if a checksum doesn't hold."""
    magic, count, blocks, size, n, bits, crc = _HEAD.unpack_from(frame)
    index_at = _HEAD.size + size
    body_at = index_at + 8 * blocks
    if magic != _MAGIC or zlib.crc32(frame[_HEAD.size : body_at]) != crc:
        raise ValueError("not a frame of token ids, or a damaged one")
    if not blocks:
        return np.zeros(0, np.uint32)
    head = zlib.decompress(frame[_HEAD.size : index_at])
    table, groups = np.frombuffer(head, "<u4", n).astype(np.uint32), np.frombuffer(head, np.uint8, n, 4 * n)
    frequency = np.ascontiguousarray(np.frombuffer(head, "<u4", offset=5 * n).reshape(n, -1).T)
    used, crcs = np.frombuffer(frame, "<u4", 2 * blocks, index_at).reshape(2, blocks).astype(np.int64)
    if body_at + 4 * int(used.sum()) != len(frame):
        raise ValueError("a frame of token ids was cut")
    digits = np.frombuffer(frame, "<u4", int(used.sum()), body_at)
    ranks = _decode_lanes(digits, used, groups.astype(np.int64), frequency, bits, count - BLOCK * (blocks - 1))
    if ranks.min() < 0 or ranks.max() >= n:
        raise ValueError("damaged block")
    ids = table.take(_turned(ranks).reshape(-1)[:count])
    upto = np.cumsum(used)
    for i in range(blocks):
        coded = zlib.crc32(np.ascontiguousarray(digits[upto[i] - used[i] : upto[i]]))
        if zlib.crc32(ids[i * BLOCK : (i + 1) * BLOCK].astype("<u4", copy=False), coded) != crcs[i]:
            raise ValueError(f"block {i} is damaged")
    return ids


def _decode_lanes(digits: np.ndarray, used: np.ndarray, groups: np.ndarray, frequency: np.ndarray, bits: int, last: int) -> np.ndarray:
    lanes, (k, n) = len(used), frequency.shape
    model = _Model(lanes)
    digits = np.append(digits, np.zeros(4, np.uint32)).astype(_U)
    at = np.cumsum(used) - used
    code = (digits[at] << _U(30)) | (digits[at + 1] >> _U(2))
    at += 1
    digits = (digits[:-1] & _U(3)) << _U(30) | digits[1:] >> _U(2)  # as the code takes them in, two bits behind
    width = np.full(lanes, 1 << 62, _U)
    out = np.zeros((BLOCK, lanes), np.int32)
    used_at = np.flatnonzero(frequency)  # group * n + rank of what follows a group at all
    guessed = len(used_at)  # stands for the whole range, where a guess is right
    ranks, intervals = np.append(used_at % n, 0).astype(np.int32), np.append(_intervals(frequency).take(used_at), _U(1 << bits))
    kind = np.uint16 if guessed < 1 << 16 else np.int32
    whole = np.zeros((k, 1 << bits), kind)  # which of those is at each place of a group's frequencies
    parts = np.searchsorted(used_at, np.arange(k + 1) * n)
    for i, (x, y) in enumerate(zip(parts, parts[1:], strict=False)):
        filled = np.repeat(np.arange(x, y).astype(kind), frequency[i][frequency[i] > 0])
        whole[i, : len(filled)] = filled
    whole = whole.reshape(-1)
    groups, hashes = groups << bits, _hashes(n)
    most, all_bits, event_bits = _U((1 << bits) - 1), _U(bits), _U(_BITS)
    co, wi, a, now = code, width, at, np.zeros(lanes, np.int32)
    h1 = h2 = np.zeros(lanes, np.int64)
    for t in range(BLOCK):
        if t == last and last < BLOCK:
            if lanes == 1:
                break
            model.lanes(lanes - 1)
            co, wi, a, now, h1, h2 = code[:-1], width[:-1], at[:-1], now[:-1], h1[:-1], h2[:-1]
        if t == 0 or t == last:
            m = len(now)
            mixed, came, own = np.empty((2, m), np.int32), np.empty((2, m), bool), np.arange(m)
            ends = np.zeros((4, m), _U)  # of the intervals of order 2's guess, of order 1's and of neither, from 0 on
            ends[3] = 1 << _BITS
        slot, spot = model.contexts(h1, h2)
        model.predict(slot, spot, mixed)
        ends[1], ends[2] = mixed[0], _ends(mixed)
        wi >>= event_bits
        beyond = co // wi >= ends[1:3]
        np.logical_not(beyond[0], out=came[0])
        np.greater(beyond[0], beyond[1], out=came[1])
        miss = beyond[1]
        event = np.add(beyond[0], miss, dtype=np.int64)
        event *= m
        event += own
        begin = ends.take(event)
        event += m
        co -= wi * begin
        wi *= ends.take(event) - begin
        wi >>= all_bits
        place = np.minimum(co // wi, most).astype(np.int64)
        place += groups.take(now)
        place = np.where(miss, whole.take(place), kind(guessed))
        rank = ranks.take(place)
        interval = intervals.take(place)
        co -= wi * (interval >> _HALF)
        interval &= _LOWER
        wi *= interval
        now = np.where(miss, rank, np.where(came[0], model.rank[0], model.rank[1]))
        small = np.flatnonzero(wi < _FULL)
        if len(small):
            k = a.take(small)
            a[small] = k + 1
            co[small] = (co.take(small) << _U(32)) | digits.take(k, mode="clip")
            wi[small] = wi.take(small) << _U(32)
        out[t, : len(now)] = now
        model.update(now << 2, model.rank == now, came, slot, spot, t)
        h1, h2 = hashes.take(now), h1
    return out
