"""Adaptive context-mixing range coder for token ids; many independent blocks are coded in step as NumPy lanes.

A block begins with an empty model, which learns from the block's own past at positions FIRST, 2 FIRST, 4 FIRST, ...  and
stays as it is between them, so that a step of all lanes takes few array operations.  Each token is one of four events:
the id that followed the last two ids (order 2), the id that followed the last one (order 1), an id from the counts of
the block's past (order 0), or another one, coded by a fixed prior that falls with the id.  How likely the events are
follows from how sure the order-2 and order-1 predictions are and whether they agree: distributions given both, given
either and given nothing are counted from what was coded, and mixed by their evidence.  The range coder then codes the event
and, without a hit, the id.  All arithmetic is on whole numbers, so every machine decodes what another one wrote.
"""

from __future__ import annotations

import numpy as np

FIRST = 128
STEP = 512  # tokens of a lane that are modelled at once
ENCODED, DECODED = 512, 1024  # lanes: decoding needs more array operations a step, and its tables are those of all lanes at once
EVENTS, CONTEXTS = 4, 32
OLD, NEW = 2, 3
EVENT_BITS, COUNT_BITS = 11, 12
FIELD = 12
WORD, MASK = 24, (1 << 24) - 1  # the coder's output in bits; its registers have two words
ID_BITS = 20
LONGEST = 2 << COUNT_BITS  # ids of a block: the counts learnt halfway hold an id each
PAST = 8  # what a mixture counts for in the one that is built upon it


class Prior:
    """The fixed distribution of ids below ``size``: shares of 2**bits, at least one each."""

    def __init__(self, size: int):
        if not 0 < size <= 1 << ID_BITS:
            raise ValueError("ids lie below 2**20")
        self.bits = 20 if size <= 1 << 16 else 22
        falls = (1 << 40) // (np.arange(size, dtype=np.int64) + 64)
        self.share = 1 + falls // -(-int(falls.sum()) // ((1 << self.bits) - size))
        self.ends = np.cumsum(self.share)
        self.begins = self.ends - self.share


def _mixed(seen: np.ndarray) -> np.ndarray:
    """Packed ends of the events' shares of 2**EVENT_BITS by lane and context, from how often each was coded."""
    n = seen.reshape(-1, 4, 4, 2, EVENTS).astype(np.int64)  # by order-2 and order-1 confidence and agreement
    one = 1 << 16

    def blend(counts, below):
        return (counts * one + PAST * below) // (counts.sum(-1, keepdims=True) + PAST)

    start = np.array([one // 8, one // 8, one // 4, one // 2], np.int64)
    none = blend(n.sum((1, 2, 3), keepdims=True), start)
    two, first = blend(n.sum(2, keepdims=True), none), blend(n.sum(1, keepdims=True), none)
    share = blend(n, (two + first) // 2)
    share = 1 + share * ((1 << EVENT_BITS) - EVENTS) // share.sum(-1, keepdims=True)
    ends = np.cumsum(share, -1).reshape(-1, EVENTS)
    ends[:, -1] = 1 << EVENT_BITS
    return ends[:, 0] << FIELD | ends[:, 1] << 2 * FIELD | ends[:, 2] << 3 * FIELD | ends[:, 3] << 4 * FIELD


class _Model:
    """What ``n`` lanes have learnt."""

    def __init__(self, n: int):
        self.seen = np.zeros((n, CONTEXTS * EVENTS), np.int64)
        self.row = np.arange(n)
        self.learn(np.zeros((n, 0), np.int32))

    def slots(self, one, two, row):
        """Places in the order-1 and order-2 tables; one, two: the last id and the one before."""
        a = one * 0x9E3779B1
        first = (a >> 9) & (self.width - 1)
        both = ((a + two * 0x85EBCA6B) >> 11) & (self.width - 1)
        base = row * self.width
        return base + first, base + both

    def learn(self, past: np.ndarray) -> None:
        """Build all tables anew from the ids of the lanes so far (lane, position)."""
        m, t = past.shape
        self.width = max(2, 1 << max(0, t - 1).bit_length())
        self.after = [np.zeros(m * self.width, np.int32) for _ in range(2)]  # id * 4 + confidence
        self.events = _mixed(self.seen[:m])
        self.distinct = self.lookup = None
        if not t:
            return
        one, two = np.zeros((m, t), np.int64), np.zeros((m, t), np.int64)
        one[:, 1:], two[:, 2:] = past[:, :-1], past[:, :-2]
        ids = past.ravel()
        for table, at in zip(self.after, self.slots(one, two, self.row[:m, None])):
            at = at.ravel()
            table[at] = ids  # the last one stays
            right = table.take(at) == ids
            all_, hits = np.bincount(at, minlength=len(table)), np.bincount(at[right], minlength=len(table))
            sure = np.where(all_ <= 1, all_, np.where((hits > 1) & (hits * 4 >= all_ * 3), 3, 2))
            table <<= 2
            table |= sure.astype(np.int32)
        ranked = np.sort(past, axis=1)
        new = np.ones((m, t), bool)
        new[:, 1:] = ranked[:, 1:] != ranked[:, :-1]
        at = np.flatnonzero(new.ravel())
        kinds = new.sum(1)
        self.bounds = np.r_[0, np.cumsum(kinds)]
        counts = np.diff(np.r_[at, m * t])
        share = 1 + counts * ((1 << COUNT_BITS) - kinds).repeat(kinds) // t
        sums = np.add.reduceat(share, self.bounds[:-1])
        share[self.bounds[1:] - 1] += (1 << COUNT_BITS) - sums
        begin = np.cumsum(share) - share - (self.row[:m] << COUNT_BITS).repeat(kinds)
        self.distinct = ranked.ravel()[at]
        self.packed = begin << 13 | share
        self.lookup = (self.distinct.astype(np.int64) << 26 | self.packed).repeat(share)


def _starts(lengths: np.ndarray, size: int):
    """(begin, end, lanes, whether the model learns first) of each run of steps."""
    at, learn = 0, FIRST
    while at < lengths[0]:
        m = int(np.searchsorted(-lengths, -at, "left"))
        anew = at == learn
        learn *= 1 + anew
        end = min(learn, at + STEP, int(lengths[m - 1]))
        yield at, end, m, anew
        at = end


def _by_lanes(run, lanes: int, items: list, lengths: np.ndarray, *more) -> list:
    """run over at most ``lanes`` items at once, the longest ones first."""
    out: list = [None] * len(items)
    order = np.argsort(-lengths, kind="stable")
    for some in np.array_split(order, -(-len(items) // lanes)) if items else ():
        for i, made in zip(some, run([items[i] for i in some], lengths[some], *more)):
            out[i] = made
    return out


def encode(blocks: list[np.ndarray], prior: Prior) -> list[bytes]:
    """The code of each block of 1 to LONGEST ids below the prior's size."""
    return _by_lanes(_encode, ENCODED, blocks, np.array([len(b) for b in blocks], np.int64), prior)


def decode(codes: list[bytes], lengths, prior: Prior) -> list[np.ndarray]:
    """The ids of each block, given how many they are."""
    return _by_lanes(_decode, DECODED, codes, np.asarray(lengths, np.int64), prior)


def _modelled(model: _Model, ids: np.ndarray, lo: int, hi: int, prior: Prior, places: np.ndarray):
    """(begin, share of the event; begin, share, bits of the id) by step and lane, of the tokens lo to hi of all lanes."""
    m, some = len(ids), ids[:, lo:hi]
    one, two = np.zeros(some.shape, np.int64), np.zeros(some.shape, np.int64)
    for back, x in ((1, one), (2, two)):
        begin = max(lo, back)
        if begin < hi:
            x[:, begin - lo :] = ids[:, begin - back : hi - back]
    first, second = (table.take(at) for table, at in zip(model.after, model.slots(one, two, model.row[:m, None])))
    sure1, sure2, id1, id2 = first & 3, second & 3, first >> 2, second >> 2
    context = (sure2 << 3) + (sure1 << 1) + (id1 == id2)
    event = np.full(some.shape, NEW)
    begin, share, bits = np.zeros(some.shape, np.int64), np.ones(some.shape, np.int64), np.zeros(some.shape, np.int64)
    if model.distinct is not None:
        for i in range(m):  # the order-0 shares of one lane at a time through a table by id
            own = slice(model.bounds[i], model.bounds[i + 1])
            places[model.distinct[own]] = model.packed[own]
            share[i] = places[some[i]]
            places[model.distinct[own]] = 0
        old = share > 0
        event[old] = OLD
        begin, share = share >> 13, share & 0x1FFF
        bits[old] = COUNT_BITS
    event[(sure1 > 0) & (id1 == some)] = 1
    event[(sure2 > 0) & (id2 == some)] = 0
    hit = event < OLD
    begin[hit], share[hit], bits[hit] = 0, 1, 0
    new = event == NEW
    begin[new], share[new], bits[new] = prior.begins[some[new]], prior.share[some[new]], prior.bits
    cell = (model.row[:m, None] * (CONTEXTS * EVENTS) + (context << 2) + event).ravel()
    model.seen[:m] += np.bincount(cell, minlength=m * CONTEXTS * EVENTS).reshape(m, -1)
    ends = model.events.take(model.row[:m, None] * CONTEXTS + context) >> event * FIELD
    low = ends & 0xFFF
    return [np.ascontiguousarray(x.T) for x in (low, (ends >> FIELD & 0xFFF) - low, begin, share, bits)]


def _encode(blocks: list[np.ndarray], lengths: np.ndarray, prior: Prior) -> list[bytes]:
    n, longest = len(blocks), int(lengths[0])
    ids = np.zeros((n, longest), np.int32)
    for i, block in enumerate(blocks):
        ids[i, : len(block)] = block
    model, places = _Model(n), np.zeros(len(prior.share), np.int64)
    cap = longest * 3 // 2 + 16
    words = np.zeros(n * cap, np.int32)
    pos, low, span = np.arange(n) * cap, np.zeros(n, np.int64), np.full(n, 1 << 2 * WORD, np.int64)

    def emit(rows):
        x = low.take(rows)
        at = pos.take(rows)
        words[at] = x >> WORD
        pos[rows] = at + 1
        low[rows] = (x & MASK) << WORD
        span[rows] = span.take(rows) << WORD

    for lo, hi, m, anew in _starts(lengths, longest):
        if anew:
            model.learn(ids[:m, :lo])
        a, s = low[:m], span[:m]
        begins, shares, id_begins, id_shares, bits = _modelled(model, ids[:m], lo, hi, prior, places)
        for k in range(hi - lo):
            s >>= EVENT_BITS
            a += begins[k] * s
            s *= shares[k]
            wide = bits[k]
            tight = ((s < 1 << WORD) & (wide > COUNT_BITS)).nonzero()[0]
            if len(tight):
                emit(tight)
            s >>= wide
            a += id_begins[k] * s
            s *= id_shares[k]
            emit((s < 1 << WORD).nonzero()[0])
    words[pos] = (low + MASK) >> WORD
    used = pos + 1 - np.arange(n) * cap
    words = words.reshape(n, cap)
    while (words > MASK).any():  # carries go to the words before
        over = words >> WORD
        words &= MASK
        words[:, :-1] += over[:, 1:]
    raw = words.astype(">u4").view(np.uint8).reshape(n, cap, 4)[:, :, 1:]
    return [raw[i, : used[i]].tobytes() for i in range(n)]


def _decode(codes: list[bytes], lengths: np.ndarray, prior: Prior) -> list[np.ndarray]:
    n, longest = len(codes), int(lengths[0])
    cap = max(map(len, codes)) // 3 + 4
    words = np.zeros((n, cap), np.int32)
    for i, code in enumerate(codes):
        w = np.frombuffer(code, np.uint8).reshape(-1, 3).astype(np.int32)
        words[i, : len(w)] = w[:, 0] << 16 | w[:, 1] << 8 | w[:, 2]
    words = words.ravel()
    pos = np.arange(n) * cap
    value, span = words[pos].astype(np.int64) << WORD | words[pos + 1], np.full(n, 1 << 2 * WORD, np.int64)
    pos += 2
    model, ids = _Model(n), np.zeros((longest, n), np.int32)
    one, two = np.zeros(n, np.int64), np.zeros(n, np.int64)

    def take(rows):
        at = pos.take(rows)
        value[rows] = value.take(rows) << WORD | words.take(at, mode="clip")
        pos[rows] = at + 1
        span[rows] = span.take(rows) << WORD

    for lo, hi, m, anew in _starts(lengths, longest):
        if anew:
            model.learn(np.ascontiguousarray(ids[:lo, :m].T))
        v, s, one, two = value[:m], span[:m], one[:m], two[:m]
        row = model.row[:m]
        at_event, at_lookup = row * CONTEXTS, row << COUNT_BITS
        cells = np.empty((hi - lo, m), np.int64)
        for k in range(lo, hi):
            first, second = (table.take(at) for table, at in zip(model.after, model.slots(one, two, row)))
            id1, id2 = first >> 2, second >> 2
            context = at_event + ((second & 3) << 3)
            context += (first & 3) << 1
            context += id1 == id2
            ends = model.events.take(context)
            s >>= EVENT_BITS
            x = v // s
            event = (x >= (ends >> FIELD & 0xFFF)).astype(np.int64)
            event += x >= (ends >> 2 * FIELD & 0xFFF)
            event += x >= (ends >> 3 * FIELD & 0xFFF)
            ends >>= event * FIELD
            begin = ends & 0xFFF
            v -= begin * s
            ends >>= FIELD
            ends &= 0xFFF
            ends -= begin
            s *= ends
            now = np.where(event, id1, id2).astype(np.int64)
            old = (event == OLD).nonzero()[0]
            if len(old):
                r = s.take(old) >> COUNT_BITS
                y = v.take(old)
                found = model.lookup.take(at_lookup.take(old) + np.minimum(y // r, (1 << COUNT_BITS) - 1))
                v[old] = y - (found >> 13 & 0x1FFF) * r
                s[old] = r * (found & 0x1FFF)
                now[old] = found >> 26
            new = (event == NEW).nonzero()[0]
            if len(new):
                take(new[s.take(new) < 1 << WORD])
                r = s.take(new) >> prior.bits
                y = v.take(new)
                number = np.searchsorted(prior.ends, y // r, "right")
                v[new] = y - prior.begins.take(number) * r
                s[new] = r * prior.share.take(number)
                now[new] = number
            take((s < 1 << WORD).nonzero()[0])
            context <<= 2
            context += event
            cells[k - lo] = context
            ids[k, :m] = now
            one, two = now, one
        model.seen[:m] += np.bincount(cells.ravel(), minlength=m * CONTEXTS * EVENTS).reshape(m, -1)
    return [np.ascontiguousarray(ids[: lengths[i], i]) for i in range(n)]
