"""Adaptive context-mixing range coder for blocks of token ids, many lanes at a time.

A block of ids is cut into lanes of equal length.  All lanes of a block advance together, one id a step; they share the
block's model, and each has a range coder of its own.  Three predictions are mixed for every id:

* order 0: a distribution over all ids, by how often each has come up in the block;
* order 1: the id that followed the previous one, with a confidence from 0 (none yet) to 7;
* order 2: the id that followed the previous two, likewise, in a hashed table.

How much weight orders 1 and 2 get beside order 0 is learned for every pair of confidences from how often they were
right.  The mixture is one interval for each id: its own part of order 0, widened by the weight of an order that names
it, and moved by the weights of orders that name a smaller id.  All arithmetic is on integers, so that every machine
decodes what another has coded.  A new block starts from an empty model.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK, LANES, LANE = 1 << 20, 8192, 128
# What an occurrence adds to an id's share of order 0 (which starts at 1), and steps between renewals of these shares.
STEP, RENEW = 24, 16
SURE = 8
SLOTS = 16
# What a confidence changes by: without a hit (from 1 down another id takes the place), then with one.
_CHANGE = np.array([*((k >> 1) - k for k in range(SURE)), *[1] * (SURE - 1), 0], np.int32)
# Buckets (as a power of two) that say about where a target lies.
BUCKETS = 14
# A weight is at most so many times that of order 0, which keeps totals below 2**32.
MOST = 63
LEAST_RANGE = np.uint64(1 << 48)
_WORD, _TOP = np.uint64(16), np.uint64(48)

HEADER = struct.Struct("<IIII")


class Model:
    """What a block has taught so far.  Coder and decoder call ``intervals`` and ``learn`` in the same order."""

    def __init__(self, vocabulary: int, lanes: int):
        self.share = np.ones(vocabulary, np.uint64)
        self.start = np.arange(vocabulary + 1, dtype=np.uint64)
        self.seen: list[np.ndarray] = []
        self.steps = 0
        # An id times eight plus the confidence, by previous id and by a hash of the previous two.
        self.follows = [np.full(n, vocabulary * SURE, np.int32) for n in (vocabulary + 1, 1 << SLOTS)]
        # For every pair of confidences, and whether both name one id: right of order 2, else of order 1, else neither.
        kind = np.arange(SURE * SURE * 2)
        self.right = np.tile(np.array([1, 1, 2]), (len(kind), 1))
        self.without2, self.without1 = (kind // SURE) % SURE == 0, (kind % SURE == 0) | (kind >= SURE * SURE)
        self.last = np.full(lanes, vocabulary, np.int32)
        self.slot2 = self._slot(self.last, self.last)
        self._renew()

    @staticmethod
    def _slot(before: np.ndarray, last: np.ndarray) -> np.ndarray:
        code = last.view(np.uint32) * np.uint32(0x9E3779B1)
        code ^= before.view(np.uint32) * np.uint32(0x85EBCA6B)
        return (code >> np.uint32(32 - SLOTS)).astype(np.int64)

    def _renew(self) -> None:
        """Starts of all ids' intervals."""
        np.cumsum(self.share, out=self.start[1:])
        self.every = int(self.start[-1])
        self.guess = None

    def _guess(self) -> None:
        """The first and last id that each bucket of targets can mean; only a decoder asks."""
        self.shift = max(0, self.every.bit_length() - BUCKETS)
        ends = np.searchsorted(self.start, np.arange((self.every >> self.shift) + 2, dtype=np.uint64) << np.uint64(self.shift), side="right")
        self.guess = np.minimum(ends - 1, len(self.share) - 1)

    def find(self, target: np.ndarray) -> np.ndarray:
        """The id in whose interval of order 0 each target lies."""
        if self.guess is None:
            self._guess()
        bucket = (target >> np.uint64(self.shift)).view(np.int64)
        found, last = self.guess.take(bucket), self.guess.take(bucket + 1)
        unsure = np.flatnonzero(found < last)
        found[unsure] = np.searchsorted(self.start, target[unsure], side="right") - 1
        return found

    def intervals(self, active: int):
        """Ids that orders 1 and 2 name, their weights, and the total, for the first ``active`` lanes."""
        self.at = self.last[:active].astype(np.int64), self.slot2[:active]
        self.held = [f.take(s) for f, s in zip(self.follows, self.at)]
        one, two = self.named = [h >> 3 for h in self.held]
        kind = ((self.held[1] & 7) << 3) | (self.held[0] & 7)
        kind |= (one == two).view(np.int8) << np.int32(6)
        self.kind = kind.astype(np.int64)
        ratio2, ratio1 = (np.minimum(self.every * self.right[:, k] // self.right[:, 2], self.every * MOST) for k in (0, 1))
        ratio2[self.without2] = 0
        ratio1[self.without1] = 0
        weight1, weight2 = ratio1.view(np.uint64).take(self.kind), ratio2.view(np.uint64).take(self.kind)
        total = weight1 + weight2
        total += np.uint64(self.every)
        return one, two, weight1, weight2, total

    def widths(self, x: np.ndarray, one: np.ndarray, two: np.ndarray, weight1: np.ndarray, weight2: np.ndarray):
        """Begin and width of the intervals of the ids ``x``."""
        begin = self.start.take(x)
        width = self.start.take(x + 1)
        width -= begin
        for named, weight in ((one, weight1), (two, weight2)):
            begin += weight * (named < x)
            width += weight * (named == x)
        return begin, width

    def learn(self, ids: np.ndarray) -> None:
        """``ids`` (int32) of the lanes that ``intervals`` was asked for."""
        one, two = (named == ids for named in self.named)
        outcome = self.kind * 3
        outcome += 2
        outcome -= one
        outcome -= two * (2 - one.view(np.int8))
        self.right += np.bincount(outcome, minlength=self.right.size).reshape(self.right.shape)
        fresh = (ids << 3) | 1
        for held, hit, follows, at in zip(self.held, (one, two), self.follows, self.at):
            state = held & 7
            state += hit.view(np.int8) << np.int8(3)
            after = _CHANGE.take(state)
            after += held
            np.copyto(after, fresh, where=state <= 1)
            follows[at] = after
        active = len(ids)
        self.slot2[:active] = self._slot(self.last[:active], ids)
        self.last[:active] = ids
        self.seen.append(ids)
        self.steps += 1
        if self.steps < 8 or self.steps % RENEW == 0:
            self.share += (STEP * np.bincount(np.concatenate(self.seen), minlength=len(self.share))).view(np.uint64)
            self.seen = []
            self._renew()


def lanes_of(n: int) -> tuple[int, int, int]:
    """Lanes, steps, and how many lanes take part in the last step."""
    lanes = min(LANES, max(1, n // LANE))
    steps = -(-n // lanes)
    return lanes, steps, n - lanes * (steps - 1)


def _turn(rows: np.ndarray, out: np.ndarray) -> None:
    """``out`` becomes the transpose of ``rows``, some rows at a time, so that a place of memory is met once."""
    for at in range(0, len(rows), 64):
        out[:, at : at + 64] = rows[at : at + 64].T


def rows_of(ids: np.ndarray) -> np.ndarray:
    """What each lane (column) has at each step (row); beyond a lane's end, 0."""
    lanes, steps, full = lanes_of(len(ids))
    rows = np.empty((steps, lanes), ids.dtype)
    _turn(ids[: full * steps].reshape(full, steps), rows[:, :full])
    _turn(ids[full * steps :].reshape(lanes - full, steps - 1), rows[:-1, full:])
    rows[-1, full:] = 0
    return rows


def encode(ids: np.ndarray, vocabulary: int) -> bytes:
    """A block: number of ids, of lanes, checksums of the body and of the ids; words of each lane, and the words."""
    n = len(ids)
    ids = np.ascontiguousarray(ids, np.int32)
    body = b""
    lanes, steps, full = lanes_of(n)
    if n:
        rows = rows_of(ids)
        model = Model(vocabulary, lanes)
        low, size = np.zeros(lanes, np.uint64), np.full(lanes, (1 << 64) - 1, np.uint64)
        words, used = np.zeros((2 * steps + steps // 4 + 8, lanes), np.uint16), np.zeros(lanes, np.int64)
        every, flat = np.arange(lanes), words.reshape(-1)

        def carry(lane: np.ndarray) -> None:
            place = used[lane] - 1
            while len(lane):
                words[place, lane] += np.uint16(1)
                over = words[place, lane] == 0
                lane, place = lane[over], place[over] - 1

        def put(lane: np.ndarray) -> None:
            words[used[lane], lane] = (low[lane] >> _TOP).astype(np.uint16)
            used[lane] += 1
            low[lane] <<= _WORD

        for step in range(steps):
            active = lanes if step < steps - 1 else full
            x = rows[step, :active]
            one, two, weight1, weight2, total = model.intervals(active)
            begin, width = model.widths(x, one, two, weight1, weight2)
            unit = size[:active] // total
            moved = low[:active] + unit * begin
            over = moved < low[:active]
            low[:active], size[:active] = moved, unit * width
            if over.any():
                carry(every[:active][over])
            # All lanes note their next word, which only those keep that go on behind it.
            small = size[:active] < LEAST_RANGE
            flat[used[:active] * lanes + every[:active]] = low[:active] >> _TOP
            used[:active] += small
            shift = small * _WORD
            low[:active] <<= shift
            size[:active] <<= shift
            while len(again := np.flatnonzero(size[:active] < LEAST_RANGE)):
                put(again)
                size[again] <<= _WORD
            model.learn(x)
        # One word names a number inside the last range; the decoder reads zeros behind it.
        end = low + (LEAST_RANGE - np.uint64(1))
        over = end < low
        low = end
        if over.any():
            carry(every[over])
        put(every)
        top = int(used.max())
        by_lane = np.empty((lanes, top), np.uint16)
        _turn(words[:top], by_lane)
        body = used.astype("<u2").tobytes() + by_lane[np.arange(top) < used[:, None]].astype("<u2").tobytes()
    return HEADER.pack(n, lanes if n else 0, zlib.crc32(body), zlib.crc32(ids.astype("<u4").tobytes())) + body


def decode(block: bytes, vocabulary: int) -> np.ndarray:
    """Ids of a block, int32; a block that doesn't match its checksums is an error."""
    n, lanes, check, own = HEADER.unpack_from(block)
    body = memoryview(block)[HEADER.size :]
    if zlib.crc32(body) != check:
        raise ValueError("damaged block: its bytes don't match their checksum")
    out = np.empty(n, np.int32)
    if n:
        used = np.frombuffer(body, "<u2", lanes).astype(np.int64)
        packed = np.frombuffer(body, "<u2", offset=2 * lanes)
        # A column of words for each lane, with zeros behind it.
        words = np.zeros((lanes, int(used.max()) + 8), np.uint16)
        words[np.arange(words.shape[1]) < used[:, None]] = packed
        words = np.ascontiguousarray(words.T)
        every, flat = np.arange(lanes), words.reshape(-1)
        _, steps, full = lanes_of(n)
        rows = np.empty((steps, lanes), np.int32)
        model = Model(vocabulary, lanes)
        size, code = np.full(lanes, (1 << 64) - 1, np.uint64), np.zeros(lanes, np.uint64)
        for word in words[:4]:
            code = code << _WORD | word
        at = np.full(lanes, 4)
        for step in range(steps):
            active = lanes if step < steps - 1 else full
            one, two, weight1, weight2, total = model.intervals(active)
            unit = size[:active] // total
            target = np.minimum(code[:active] // unit, total - np.uint64(1))
            swap = two < one
            first, second = np.minimum(one, two), np.maximum(one, two)
            weight, other = np.where(swap, weight2, weight1), np.where(swap, weight1, weight2)
            # A named id's weight lies behind its own part of order 0 and moves what follows.
            end = model.start.take(first + 1, mode="clip")
            behind = target >= end
            is_first = behind & (target < end + weight)
            target -= weight * (behind & ~is_first)
            end = model.start.take(second + 1, mode="clip")
            behind = (target >= end) & ~is_first
            is_second = behind & (target < end + other)
            target -= other * (behind & ~is_second)
            rest = np.flatnonzero(~(is_first | is_second))
            x = np.where(is_first, first, second)
            x[rest] = model.find(target[rest])
            begin, width = model.widths(x, one, two, weight1, weight2)
            code[:active] -= unit * begin
            size[:active] = unit * width
            small = size[:active] < LEAST_RANGE
            shift = small * _WORD
            size[:active] <<= shift
            code[:active] <<= shift
            code[:active] |= small * flat.take(at[:active] * lanes + every[:active])
            at[:active] += small
            while len(again := np.flatnonzero(size[:active] < LEAST_RANGE)):
                size[again] <<= _WORD
                code[again] = code[again] << _WORD | words[at[again], again]
                at[again] += 1
            rows[step, :active] = x
            model.learn(x)
        # Lanes that end a step early have nothing in the last row.
        out[: full * steps] = rows[:, :full].T.reshape(-1)
        out[full * steps :] = rows[:-1, full:].T.reshape(-1)
    if zlib.crc32(out.astype("<u4").tobytes()) != own:
        raise ValueError("damaged block: its ids don't match their checksum")
    return out
