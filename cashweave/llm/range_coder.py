"""Adaptive context-mixing range coder for token ids.

Ids are cut into blocks of ``BLOCK``. Every block starts from an empty model,
so blocks can be read on their own, and carries a CRC-32 of its ids. Per id:

* the order-2 context (the two ids before) and the order-1 context each
  propose the id they last saw, with a confidence;
* the two confidences and whether the proposals agree choose a mixing context,
  whose adaptive shares divide the coding range among "order 2 is right",
  "order 1 is right", "an id seen in this block" and "a new id";
* a seen id is then coded by its order-0 frequency, a new one at 16 bits or as
  many as the vocabulary takes.

Order-0 frequencies are brought up to date every so many ids, the contexts and
the mixing shares at every id. The coder is a carry-less range coder of 64 bits
that puts out 32 at a time: with at least 32 bits of range before an id, one
look at the range after it is enough. Many blocks are coded in step, one id of
each at a time, which lets numpy do the arithmetic; blocks don't influence each
other. A mixing context is one 64-bit number, the ends of its four shares in 16
bits each, so that one expression moves all of them. What doesn't depend on the
state of the model or the coder is worked out for ``STEPS`` ids of all blocks
at once when writing: hashes of contexts, order-0 intervals, shares.
"""

from __future__ import annotations

import struct
import zlib

import numpy as np

BLOCK = 4_096
LANES = 2048                 # blocks coded in step; bounds the memory of a task
GROUP_LANES = 8              # of which so many look up their ids at a time, in a table that caches hold
STEPS = 32                   # ids of a block that are prepared together
SLOTS = 1 << 13              # resolution of the order-0 frequencies, twice the ids of a block
SLOT_BITS = SLOTS.bit_length() - 1
SIZE_BITS = SLOT_BITS + 1
CONTEXTS = 1 << 12           # entries of each context table
MIX_BITS = 15
RATES = ((0, 4), (512, 5))   # from which id on the shares move by which power of two
HEADER = struct.Struct("<III")          # ids, bytes, CRC-32 of the ids as 32-bit integers
MAX_ID_BITS = 32 - MIX_BITS + 3         # a share is never under 15 of 1 << MIX_BITS
U64 = np.uint64
WORD, DIGIT, FIELD = U64(32), U64((1 << 32) - 1), U64(0xFFFF)


def _fields(values) -> np.uint64:
    return U64(sum(v << 16 * k for k, v in enumerate(values)))


def _rate(shift: int):
    """Of a rate: the shift, its mask, and what each kind adds to the ends.
    Neighbouring ends stay ``(1 << shift) - 1`` apart."""
    top = 1 << MIX_BITS - shift
    return U64(shift), _fields([0xFFFF >> shift] * 4), np.array(
        [_fields([top - 3 + j if kind <= j else j + 1 for j in range(4)]) for kind in range(4)], U64)


EVEN = _fields([(j + 1) << MIX_BITS - 2 for j in range(4)])


def _apart(lanes: int, length: int) -> np.ndarray:
    """Zeros, lane x time, of lanes that don't begin a power of two apart: the
    same ids of all lanes then don't share a few places of the caches."""
    return np.zeros((lanes, length + 16), np.int32)[:, :length]


class _Coder:
    """Range coder state of all lanes, writing or reading 32-bit words."""

    def __init__(self, lanes: int, words: np.ndarray):
        self.low, self.range, self.words = np.zeros(lanes, U64), np.full(lanes, (1 << 64) - 1, U64), words
        self.flat, self.at = words.reshape(-1), np.arange(lanes) * words.shape[1]

    def start_reading(self) -> None:
        self.code = self.words[:, 0].astype(U64) << WORD | self.words[:, 1]
        self.at += 2

    def settle(self, n: int, reading: bool) -> None:
        """Put out, or take in, a word in those of the first ``n`` lanes whose
        range is used up; one that straddles a word's edge is cut there."""
        lanes = (self.range[:n] <= DIGIT).nonzero()[0]
        if not len(lanes):
            return
        low, rng, at = self.low.take(lanes), self.range.take(lanes), self.at.take(lanes)
        room = (~low & DIGIT) + U64(1)
        self.range[lanes] = np.minimum(rng, room, out=room) << WORD
        if reading:
            self.code[lanes] = self.code.take(lanes) << WORD | self.flat.take(at)
        else:
            self.flat[at] = low >> WORD
        self.low[lanes] = low << WORD
        self.at[lanes] = at + 1

    def finish(self) -> list[bytes]:
        for _ in range(2):
            self.flat[self.at] = self.low >> WORD
            self.at += 1
            self.low <<= WORD
        width = self.words.shape[1]
        return [self.words[i, :n - i * width].astype("<u4").tobytes() for i, n in enumerate(self.at.tolist())]


def _refresh_at(length: int) -> set[int]:
    """Ids after which the order-0 frequencies are brought up to date."""
    return {1 << k for k in range(5, 10)} | set(range(1024, length, 1024))


class _Order0:
    """Order-0 frequencies of the ids each lane has seen, distinct ones in order."""

    def __init__(self, lanes: int, vocabulary: int):
        self.vocabulary, self.known = vocabulary, np.zeros(lanes, np.int64)
        self.kind = np.uint16 if vocabulary <= 1 << 16 else np.int32
        self.first = np.zeros(lanes, np.int64)      # each lane's first distinct id in ids and packed
        self.ids = self.packed = np.zeros(0, np.int32)
        self.slot, self.whole = np.zeros(0, np.int16), np.zeros(0, U64)     # of each slot, its distinct id in order; ids with packed

    def refresh(self, ids: np.ndarray, slots: bool) -> None:
        """Take in all ids (lane x time) so far; ``slots``: for decoding."""
        lanes, length = ids.shape
        ordered = ids.astype(self.kind)
        ordered.sort(axis=1)
        distinct = np.ones(ids.shape, bool)
        np.not_equal(ordered[:, 1:], ordered[:, :-1], out=distinct[:, 1:])
        place = np.flatnonzero(distinct)
        self.ids = ordered.reshape(-1).take(place).astype(np.int32)
        self.first = np.searchsorted(place, np.arange(lanes) * length)
        self.known = np.diff(self.first, append=len(place))
        # One correctly rounded division and product: the same on every machine.
        size = (np.diff(place, append=ids.size) * np.repeat((SLOTS - self.known) / length, self.known)).astype(np.int64) + 1
        size[self.first] += SLOTS - np.add.reduceat(size, self.first)
        start = np.cumsum(size) - size
        self.packed = ((start & (SLOTS - 1)) << SIZE_BITS | size).astype(np.int32)      # every lane has all of its SLOTS
        if slots:
            k = np.arange(len(size)) - np.repeat(self.first, self.known)
            self.slot = np.repeat(k.astype(np.int16), size)
            self.whole = self.ids.astype(U64) << WORD | self.packed.astype(U64)

    def ahead(self, ids: np.ndarray) -> np.ndarray:
        """Start and size, packed, of ids to come (lane x time); 0: a new one."""
        found = _apart(*ids.shape)
        table = np.zeros(min(GROUP_LANES, len(ids)) * self.vocabulary, np.int32)
        for a in range(0, len(ids) if len(self.ids) else 0, GROUP_LANES):
            b = min(a + GROUP_LANES, len(ids))
            i, j = self.first[a], self.first[b] if b < len(ids) else len(self.ids)
            of_lane = np.arange(b - a) * self.vocabulary
            at = np.repeat(of_lane, self.known[a:b]) + self.ids[i:j]
            table[at] = self.packed[i:j]
            found[a:b] = table.take(of_lane[:, None] + ids[a:b])
            table[at] = 0
        return found


class _Model:
    """Contexts and mixing shares of all lanes."""

    def __init__(self, lanes: int):
        self.guess = np.zeros(2 * lanes * CONTEXTS, np.int32)      # of order 1, then order 2: id << 2 | confidence
        self.mix = np.full(lanes * 32, EVEN)
        self.of_context = np.arange(lanes) * CONTEXTS + np.array([[0], [lanes * CONTEXTS]])
        self.of_mix = np.arange(lanes) * 32

    def propose(self, h: np.ndarray, n: int):
        """Both contexts' entries, the confidences, the mixing context, its ends."""
        entry = self.guess.take(h)
        sure = entry & 3
        context = sure[1] << 2
        context |= sure[0]
        context <<= 1
        context |= (entry[0] ^ entry[1]).view(np.uint32) < 4
        context = self.of_mix[:n] + context
        return entry, sure, context, self.mix.take(context)

    def learn(self, h, entry, sure, context, ends, kind, right, x4, rate) -> None:
        """Of ids ``x4 >> 2`` of the kinds ``kind``; ``right``: which proposals were."""
        shift, mask, added = rate
        moved = ends >> shift
        moved &= mask
        np.subtract(ends, moved, out=moved)
        moved += added.take(kind)
        self.mix[context] = moved
        missed = entry - 1
        np.copyto(missed, x4, where=sure < 2)
        self.guess[h] = np.where(right, entry + (sure < 3), missed)


def _spans(lengths: np.ndarray):
    """(from, to, lanes longer than from) of ids coded without a change of
    frequencies, rate or lanes; ``lengths`` descend."""
    longest = int(lengths.max(initial=0))
    cuts = {0, longest, *range(0, longest, STEPS), *lengths.tolist(), *(t for t in _refresh_at(longest) if t < longest)}
    cuts = sorted(cuts)
    return [(a, b, int(np.searchsorted(-lengths, -a, side="left"))) for a, b in zip(cuts, cuts[1:])]


def _encode(ids: np.ndarray, lengths: np.ndarray, vocabulary: int) -> list[bytes]:
    """Code lanes (lane x time) of descending ``lengths`` in step."""
    lanes, longest = ids.shape
    id_bits = _id_bits(vocabulary)
    coder, order0, model = _Coder(lanes, np.zeros((lanes, longest + 2), np.uint32)), _Order0(lanes, vocabulary), _Model(lanes)
    refresh = _refresh_at(longest)
    bits_of = np.array([0, 0, SLOT_BITS, id_bits], U64)
    stops = sorted(t for t in refresh if t < longest) + [longest]
    since, packed = 0, _apart(lanes, min(stops[0], longest))
    for a, b, n in _spans(lengths):
        if a in refresh:
            order0.refresh(ids[:, :a], False)
            since, stop = a, stops[stops.index(a) + 1]
            packed = order0.ahead(ids[:, a:stop])
        rate = RATE[a >= RATES[1][0]]
        x = np.zeros((b - a + 2, n), np.int32)                # with the two ids before
        x[max(0, 2 - a):] = ids[:n, max(0, a - 2):b].T
        found = np.ascontiguousarray(packed[:n, a - since:b - since].T)
        h = np.empty((b - a, 2, n), np.int64)
        np.add(x[1:-1] * 40503 >> 2 & CONTEXTS - 1, model.of_context[0, :n], out=h[:, 0])
        np.add(x[1:-1] * 26039 + x[:-2] * 48271 >> 3 & CONTEXTS - 1, model.of_context[1, :n], out=h[:, 1])
        x = x[2:]
        kind, x4, shares = 3 - (found > 0).astype(np.int64), x << 2, np.empty((b - a, n), U64)
        found = np.where(found > 0, found, x.astype(np.int64) << SIZE_BITS | 1).view(U64)
        for t in range(b - a):
            entry, sure, context, ends = model.propose(h[t], n)
            right = (entry ^ x4[t]).view(np.uint32) < 4
            np.copyto(kind[t], 1, where=right[0])
            np.copyto(kind[t], 0, where=right[1])
            shares[t] = ends
            model.learn(h[t], entry, sure, context, ends, kind[t], right, x4[t], rate)
        place = (kind << 4).view(U64)
        mix_size = shares >> place & FIELD
        mix_start = (shares << U64(16)) >> place & FIELD
        mix_size -= mix_start
        bits = bits_of.take(kind)
        np.copyto(found, 1, where=kind < 2)
        start, size = found >> U64(SIZE_BITS), found & U64((1 << SIZE_BITS) - 1)
        low, rng = coder.low[:n], coder.range[:n]
        for t in range(b - a):
            step = rng >> U64(MIX_BITS)
            low += step * mix_start[t]
            step *= mix_size[t]
            step >>= bits[t]
            low += step * start[t]
            np.multiply(step, size[t], out=rng)
            coder.settle(n, False)
    return coder.finish()


def _decode(words: np.ndarray, lengths: np.ndarray, vocabulary: int) -> np.ndarray:
    """Ids (lane x time) of lanes of descending ``lengths``."""
    lanes, longest = len(lengths), int(lengths.max(initial=0))
    id_bits = _id_bits(vocabulary)
    coder, order0, model = _Coder(lanes, words), _Order0(lanes, vocabulary), _Model(lanes)
    coder.start_reading()
    refresh = _refresh_at(longest)
    ids = _apart(lanes, longest)
    h, before = model.of_context.copy(), np.zeros(lanes, np.int32)
    of_slot, bits_of = np.arange(lanes) * SLOTS, np.array([0, 0, SLOT_BITS, id_bits], U64)
    fields, hashed, shifted = np.array([[0], [16], [32]], U64), np.array([[40503], [26039]], np.int32), np.array([[2], [3]], np.int32)
    for a, b, n in _spans(lengths):
        if a in refresh:
            order0.refresh(ids[:, :a], True)
        rate = RATE[a >= RATES[1][0]]
        low, rng, code, h, before = coder.low[:n], coder.range[:n], coder.code[:n], np.ascontiguousarray(h[:, :n]), before[:n]
        of_context = np.ascontiguousarray(model.of_context[:, :n])
        got = np.empty((b - a, n), np.int32)
        for t in range(b - a):
            entry, sure, context, ends = model.propose(h, n)
            step = rng >> U64(MIX_BITS)
            at = code - low
            past = at >= step * (ends >> fields & FIELD)
            kind = past[0].astype(np.int64)
            kind += past[1]
            kind += past[2]
            place = (kind << 4).view(U64)
            start = (ends << U64(16)) >> place & FIELD
            size = ends >> place & FIELD
            size -= start
            start *= step
            low += start
            at -= start
            np.multiply(step, size, out=rng)
            x = np.where(kind == 0, entry[1], entry[0])
            x >>= 2
            lane = (kind > 1).nonzero()[0]
            which = kind.take(lane)
            step = rng.take(lane) >> bits_of.take(which)
            start = at.take(lane) // step
            size, one = np.ones(len(lane), U64), start.astype(np.int32)
            seen = (which == 2).nonzero()[0]
            if len(seen):
                of = lane.take(seen)
                k = order0.slot.take(of_slot.take(of) + start.take(seen).view(np.int64)) + order0.first.take(of)
                whole = order0.whole.take(k)
                one[seen] = whole >> WORD
                start[seen] = (whole & DIGIT) >> U64(SIZE_BITS)
                size[seen] = whole & U64((1 << SIZE_BITS) - 1)
            x[lane] = one
            rng[lane] = step * size
            start *= step
            low[lane] += start
            coder.settle(n, True)
            x4 = x << 2
            model.learn(h, entry, sure, context, ends, kind, (entry ^ x4).view(np.uint32) < 4, x4, rate)
            mixed = x * hashed
            mixed[1] += before
            mixed >>= shifted
            mixed &= CONTEXTS - 1
            np.add(mixed, of_context, out=h)
            before = x * 48271
            got[t] = x
        ids[:n, a:b] = got.T
    return ids


RATE = [_rate(shift) for _, shift in RATES]


def _id_bits(vocabulary: int) -> int:
    bits = max(16, int(vocabulary - 1).bit_length())
    if bits > MAX_ID_BITS:
        raise ValueError(f"a vocabulary of {vocabulary} ids takes more than {MAX_ID_BITS} bits")
    return bits


def encode_blocks(ids: np.ndarray, vocabulary: int) -> list[bytes]:
    """Blocks (header and payload) of a run of at most ``LANES * BLOCK`` ids."""
    starts = range(0, len(ids), BLOCK)
    lengths = np.array([min(BLOCK, len(ids) - s) for s in starts], np.int64)
    table = _apart(len(lengths), int(lengths.max(initial=0)))
    for row, s, n in zip(table, starts, lengths):
        row[:n] = ids[s:s + n]
    payloads = _encode(table, lengths, vocabulary)
    return [HEADER.pack(int(n), len(p), zlib.crc32(row[:n].astype("<u4").tobytes())) + p
            for row, n, p in zip(table, lengths, payloads)]


def decode_blocks(blocks: list[tuple[int, int, bytes]], vocabulary: int) -> np.ndarray:
    """Ids of blocks given as (ids, CRC-32, payload); ValueError if one is damaged."""
    if not blocks:
        return np.zeros(0, "<u4")
    order = sorted(range(len(blocks)), key=lambda i: -blocks[i][0])
    lengths = np.array([blocks[i][0] for i in order], np.int64)
    words = np.zeros((len(blocks), int(lengths.max(initial=0)) + 2), np.uint32)     # an id takes in one word at most
    for row, i in zip(words, order):
        w = np.frombuffer(blocks[i][2], "<u4", min(len(row), len(blocks[i][2]) // 4))
        row[:len(w)] = w
    try:
        table = _decode(words, lengths, vocabulary)
    except IndexError as e:
        raise ValueError("a damaged block") from e
    out: list = [None] * len(blocks)
    for row, n, i in zip(table, lengths, order):
        out[i] = row[:n].astype("<u4")
        if zlib.crc32(out[i].tobytes()) != blocks[i][1]:
            raise ValueError("a block's ids don't match its checksum")
    return np.concatenate(out)
