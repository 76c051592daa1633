"""External induced suffix sorting: L and S suffixes are induced from sorted LMS suffixes through disk-backed priority queues, common prefixes are carried along, and the
reduced string is sorted by the same induction, level by level."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np

#: Bytes that the queues of one induction hold in memory before they write blocks to their folder.
HELD = 1 << 27
#: Suffixes that are handled at once, and that a range of symbols holds where there are many symbols.
STEP = 1 << 16
#: What queues hold: where a suffix starts, and how many symbols it shares with the one before it in its bucket.
SUFFIX = np.dtype([("at", "<i8"), ("lcp", "<i4")])
_FAR = np.iinfo(np.int32).max


class Store:
    """Files of one sort below a folder, a URI that the task can write to; they go with close()."""

    def __init__(self, folder: str | None):
        self.folder, self.fs, self.top, self.files = folder, None, "", 0

    def write(self, data: bytes) -> str:
        if self.fs is None:
            from .records import open_store

            self.fs, top = open_store(self.folder)
            self.top = f"{top}/queue-{uuid.uuid4().hex}"
            self.fs.create_dir(self.top, recursive=True)
        path = f"{self.top}/{self.files}"
        self.files += 1
        with self.fs.open_output_stream(path) as f:
            f.write(data)
        return path

    def read(self, path: str, at: int, size: int) -> bytes:
        with self.fs.open_input_file(path) as f:
            return f.read_at(size, at)

    def close(self) -> None:
        if self.fs is not None:
            self.fs.delete_dir(self.top)
            self.fs = None


class BucketQueue:
    """A priority queue of suffixes keyed by bucket; equal keys keep the order of arrival, so an item's rank is its place. Beyond `held` bytes all blocks are written to the
    store and read again, one at a time, when their bucket's turn comes. Without a folder everything stays in memory."""

    def __init__(self, buckets: int, store: Store, held: int = HELD):
        self.blocks: list[list] = [[] for _ in range(buckets)]
        self.size, self.held, self.store = 0, held, store

    def push(self, keys: np.ndarray, items: np.ndarray) -> None:
        """Append items to the queues of their keys, in their order."""
        if not len(items):
            return
        order = np.argsort(keys, kind="stable")
        keys, items = keys[order], items[order]
        edges = np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1], [True]]))
        for a, b in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
            self.put(int(keys[a]), items[a:b])

    def put(self, bucket: int, items: np.ndarray) -> None:
        if not len(items):
            return
        self.blocks[bucket].append(items)
        self.size += items.nbytes
        if self.store.folder and self.size > self.held:
            self._spill()

    def _spill(self) -> None:
        """Write what is in memory to one file, a block for each bucket."""
        parts, at, moved = [], 0, []
        for own in self.blocks:
            k = len(own)
            while k and isinstance(own[k - 1], np.ndarray):
                k -= 1
            if k < len(own):
                data = b"".join(x.tobytes() for x in own[k:])
                parts.append(data)
                moved.append((own, k, at, len(data)))
                at += len(data)
        path = self.store.write(b"".join(parts))
        for own, k, start, size in moved:
            own[k:] = [(path, start, size)]
        self.size = 0

    def pop(self, bucket: int, backwards: bool = False) -> Iterator[np.ndarray]:
        """The suffixes of a bucket, which leave the queue, in blocks of STEP or more where there are so many; a block on disk is read when its turn comes. Backwards the last block
        comes first, each in its own order."""
        own, self.blocks[bucket] = self.blocks[bucket], []
        parts, n = [], 0
        for block in reversed(own) if backwards else own:
            if isinstance(block, tuple):
                block = np.frombuffer(self.store.read(*block), SUFFIX)
            else:
                self.size -= block.nbytes
            parts.append(block)
            n += len(block)
            if n >= STEP:
                yield np.concatenate(parts[::-1] if backwards else parts)
                parts, n = [], 0
        if parts:
            yield np.concatenate(parts[::-1] if backwards else parts)


def s_types(text: np.ndarray) -> np.ndarray:
    """Whether each suffix is smaller than the next one; a suffix in a run of equal symbols is as the run's end. The last one counts as S."""
    n = len(text)
    out = np.ones(n, bool)
    if n > 1:
        step = np.where(text[:-1] < text[1:], 1, np.where(text[:-1] > text[1:], -1, 0)).astype(np.int8)
        place = np.where(step != 0, np.arange(n - 1), n - 1)
        place = np.minimum.accumulate(place[::-1])[::-1]  # of each suffix the next place where the symbol changes
        out[:-1] = np.append(step, np.int8(-1))[place] > 0
    return out


def symbol_ranges(text: np.ndarray, most: int) -> np.ndarray:
    """Edges of ranges of symbols: each symbol for itself where there are few, else as many as hold about `most` suffixes, or one."""
    total = np.cumsum(np.bincount(text))
    if len(total) <= 258:
        return np.arange(len(total) + 1)
    edges = [0]
    while edges[-1] < len(total):
        low = edges[-1]
        edges.append(max(low + 1, int(np.searchsorted(total, (total[low - 1] if low else 0) + most, "right"))))
    return np.array(edges)


class RangeMinimum:
    """Minima of values[low:high + 1], by a sparse table."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            last, half = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def get(self, low: np.ndarray, high: np.ndarray) -> np.ndarray:
        """Minima; an empty range has none, which counts as far."""
        out = np.full(len(low), _FAR, np.int32)
        size = high - low + 1
        level = np.where(size > 0, np.log2(np.maximum(size, 1)).astype(np.int64), -1)
        for k in np.unique(level[level >= 0]).tolist():
            own = level == k
            out[own] = np.minimum(self.levels[k][low[own]], self.levels[k][high[own] - (1 << k) + 1])
        return out


class Induction:
    """One level of the sort: a text whose last symbol is smaller than all others. `most` is the common prefix from which differences don't matter, None if none is carried."""

    def __init__(self, text: np.ndarray, store: Store, held: int, most: int | None = None, step: int = STEP):
        self.text, self.small, self.store, self.held, self.most, self.step = text, s_types(text), store, held, most, step
        self.edges = symbol_ranges(text, step)
        self.range_of = np.repeat(np.arange(len(self.edges) - 1, dtype=np.uint16 if len(self.edges) < 1 << 16 else np.int64), np.diff(self.edges))  # 16 bits sort in linear time
        lms = np.flatnonzero(self.small[1:] & ~self.small[:-1]) + 1
        self.lms = lms.astype(np.int64)

    def queue(self) -> BucketQueue:
        return BucketQueue(len(self.edges) - 1, self.store, self.held)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Symbols that suffixes a[k] and b[k] share, up to `most`, by comparing the text."""
        out, at, live = np.zeros(len(a), np.int32), 0, np.arange(len(a))
        view = np.lib.stride_tricks.sliding_window_view(np.concatenate([self.text, np.zeros(16, self.text.dtype)]), 16)
        ends = len(self.text) - np.maximum(a, b)
        while len(live) and at < self.most:
            x, y = np.minimum(a[live] + at, len(self.text)), np.minimum(b[live] + at, len(self.text))
            same = view[x] == view[y]
            first = np.where(same.all(axis=1), 16, same.argmin(axis=1))
            out[live] = at + first
            live, at = live[first == 16], at + 16
        return np.minimum(np.minimum(out, self.most), ends).astype(np.int32)

    def seeds(self, lms: np.ndarray) -> BucketQueue:
        """A queue of the LMS suffixes, in the order given within each bucket."""
        out = self.queue()
        for k in range(0, len(lms), self.step):
            own = lms[k : k + self.step]
            items = np.zeros(len(own), SUFFIX)
            items["at"] = own
            if self.most is not None and len(own):
                before = np.concatenate([lms[max(0, k - 1) : k] if k else own[:1], own[:-1]])
                items["lcp"] = self.common(before, own)
                if not k:
                    items["lcp"][0] = 0
            out.push(self.range_of[self.text[own]], items)
        return out

    def upwards(self, lms: np.ndarray) -> BucketQueue:
        """All L suffixes in order, from LMS suffixes in order."""
        return self._induce(self.seeds(lms), True)

    def downwards(self, larger: BucketQueue) -> BucketQueue:
        """All suffixes from the largest down, from L suffixes in order; each carries what it shares with the one before it, the next larger."""
        return self._induce(larger, False)

    def _induce(self, fixed: BucketQueue, up: bool) -> BucketQueue:
        """Scan the suffixes by symbol, upwards or downwards; each hands its left neighbour, if that is of the kind sought (L upwards, S downwards), to the queue of the neighbour's
        symbol. Within a symbol, suffixes of the kind sought come first, then the fixed ones. Upwards the result has the L suffixes only."""
        wait, out = self.queue(), self.queue()
        self.carried = np.full(int(self.text.max()) + 1, 0, np.int32) if self.most is not None else None
        if not up:  # the last suffix has no right neighbour to be induced from
            wait.put(int(self.range_of[self.text[-1]]), np.array([(len(self.text) - 1, 0)], SUFFIX))
        ranges = range(len(self.edges) - 1)
        for r in ranges if up else reversed(ranges):
            if self.edges[r + 1] - self.edges[r] == 1:
                self._one_symbol(r, wait, fixed, out, up)
            else:
                self._many_symbols(r, wait, fixed, out, up)
        return out

    def _left(self, at: np.ndarray, up: bool) -> tuple[np.ndarray, np.ndarray]:
        """(places in `at`, left neighbours) of those whose left neighbour is of the kind sought."""
        place = np.flatnonzero(at > 0)
        left = at[place] - 1
        sought = self.small[left] != up
        return place[sought], left[sought]

    def _one_symbol(self, r: int, wait: BucketQueue, fixed: BucketQueue, out: BucketQueue, up: bool) -> None:
        c, again = int(self.edges[r]), BucketQueue(1, self.store, self.held)
        last = None

        def hand_on(items: np.ndarray) -> None:
            for k in range(0, len(items), self.step):
                part = items[k : k + self.step]
                place, left = self._left(part["at"], up)
                symbols = self.text[left]
                made = np.zeros(len(left), SUFFIX)
                made["at"] = left
                if self.most is not None:
                    made["lcp"] = self._shared(part["lcp"], place, symbols)
                same = symbols == c
                wait.push(self.range_of[symbols[~same]], made[~same])
                again.put(0, made[same])

        def take(blocks: Iterator[np.ndarray]) -> bool:
            nonlocal last
            found = False
            for block in blocks:
                if last is None and self.most is not None:
                    block = block.copy()
                    block["lcp"][0] = 0  # the first of its symbol
                out.put(r, block)
                hand_on(block)
                last, found = int(block["at"][-1]), True
            return found

        take(wait.pop(r))
        while take(again.pop(0)):  # runs of the symbol, one longer each time
            pass
        held = None  # downwards, what a block's first suffix shares with the last of the block below it
        for block in fixed.pop(r, backwards=not up):
            if not up:
                items = block[::-1].copy()
                items["lcp"][1:] = block["lcp"][:0:-1]
                first, held = held, int(block["lcp"][0])
            else:
                items, first = block.copy(), None
            if self.most is not None:
                if first is not None:
                    items["lcp"][0] = first
                elif last is not None and (up is False or not getattr(self, "_in_fixed", False)):
                    items["lcp"][0] = self.common(np.array([last]), items["at"][:1])[0]
                elif last is None:
                    items["lcp"][0] = 0
            self._in_fixed = True
            if not up:
                out.put(r, items)
            hand_on(items)
            last = int(items["at"][-1])
        self._in_fixed = False

    def _shared(self, lcp: np.ndarray, place: np.ndarray, symbols: np.ndarray) -> np.ndarray:
        """What each suffix that is handed on shares with the last one handed to its symbol: one more than the least of what lies between the two it comes from."""
        order = np.argsort(symbols, kind="stable")
        at, to = place[order], symbols[order]
        first = np.ones(len(at), bool)
        first[1:] = to[1:] != to[:-1]
        low = np.where(first, 0, np.concatenate([[0], at[:-1] + 1]) if len(at) else at)
        table = RangeMinimum(lcp)
        least = table.get(low, at)
        least[first] = np.minimum(least[first], self.carried[to[first]])
        out = np.empty(len(at), np.int32)
        out[order] = np.minimum(least.astype(np.int64) + 1, self.most)
        np.minimum(self.carried, lcp.min() if len(lcp) else _FAR, out=self.carried)
        if len(at):
            ends = np.flatnonzero(np.append(first[1:], True))
            self.carried[to[ends]] = table.get(at[ends] + 1, np.full(len(ends), len(lcp) - 1))
        return out

    def _many_symbols(self, r: int, wait: BucketQueue, fixed: BucketQueue, out: BucketQueue, up: bool) -> None:
        """A whole range of symbols at once: suffixes handed on inside the range are added with a link to the one they come from, and all are ranked by symbol and by where their
        links lead, in steps that double."""
        empty = np.zeros(0, np.int64)
        queued = np.concatenate([empty, *(b["at"] for b in wait.pop(r))])
        known = np.concatenate([empty, *(b["at"] if up else b["at"][::-1] for b in fixed.pop(r, backwards=not up))])
        at, link = [queued, known], [np.arange(len(queued) + len(known))]
        frontier, base, n = np.concatenate(at), 0, len(queued) + len(known)
        while len(frontier):
            place, left = self._left(frontier, up)
            inside = self.range_of[self.text[left]] == r
            link.append(base + place[inside])
            base, frontier = n, left[inside]
            at.append(frontier)
            n += len(frontier)
        if not n:
            return
        at, link = np.concatenate(at), np.concatenate(link)
        symbol = self.text[at].astype(np.int64) if up else -self.text[at].astype(np.int64)
        is_known = np.zeros(n, np.int64)
        is_known[len(queued) : len(queued) + len(known)] = 1
        second = np.full(n, n, np.int64)  # what is added ties, after all that were queued
        second[: len(queued)] = np.arange(len(queued))
        second[len(queued) : len(queued) + len(known)] = np.arange(len(known))
        rank = _dense(np.lexsort((second, 2 * symbol + is_known)), 2 * symbol + is_known, second)
        while int(rank.max()) < n - 1:
            key = rank * n + rank[link]
            rank = _dense(np.argsort(key, kind="stable"), key)
            link = link[link]
        order = np.argsort(rank)
        at, is_known = at[order], is_known[order].astype(bool)
        items = np.zeros(n, SUFFIX)
        items["at"] = at
        out.put(r, items[~is_known] if up else items)
        _, left = self._left(at, up)
        beyond = self.range_of[self.text[left]] != r
        made = np.zeros(int(beyond.sum()), SUFFIX)
        made["at"] = left[beyond]
        wait.push(self.range_of[self.text[made["at"]]], made)

    def in_order(self, out: BucketQueue) -> np.ndarray:
        """The LMS suffixes of a whole result, upwards."""
        is_lms = np.zeros(len(self.text), bool)
        is_lms[self.lms] = True
        found = [b["at"][is_lms[b["at"]]] for r in reversed(range(len(self.edges) - 1)) for b in out.pop(r)]
        return np.concatenate(found)[::-1] if found else self.lms

    def names(self, by_piece: np.ndarray) -> np.ndarray:
        """Names of the pieces between LMS positions, in text order, from the pieces in order; equal pieces, symbol by symbol, have equal names."""
        ends = np.append(self.lms[1:] + 1, len(self.text))  # a piece runs to the next LMS position, included
        place = np.searchsorted(self.lms, by_piece)
        size = ends[place] - by_piece
        a, b = by_piece[:-1], by_piece[1:]
        equal = size[1:] == size[:-1]
        live, k = np.flatnonzero(equal), 0
        while len(live):
            same = self.text[a[live] + k] == self.text[b[live] + k]
            equal[live[~same]] = False
            k += 1
            live = live[same]
            live = live[k < size[live]]
        out = np.empty(len(self.lms), np.int64)
        out[place] = np.cumsum(np.concatenate([[False], ~equal]))
        return out


def _dense(order: np.ndarray, *keys: np.ndarray) -> np.ndarray:
    """Ranks by the given order, equal where all keys are."""
    moved = np.zeros(len(order), bool)
    for k in keys:
        moved[1:] |= k[order[1:]] != k[order[:-1]]
    rank = np.empty(len(order), np.int64)
    rank[order] = np.cumsum(moved)
    return rank


def sorted_lms(level: Induction) -> np.ndarray:
    """The LMS suffixes in order: pieces are sorted by induction and named, and the string of names, at most half as long, is sorted by the same means unless all differ."""
    by_piece = level.in_order(Induction.downwards(level, level.upwards(level.lms)))
    names = level.names(by_piece)
    if int(names.max()) == len(names) - 1:
        return by_piece
    below = Induction(names, level.store, level.held, None, level.step)
    order = np.concatenate([b["at"] for b in _blocks(below, sorted_lms(below))])[::-1]
    return level.lms[order]


def _blocks(level: Induction, lms: np.ndarray) -> Iterator[np.ndarray]:
    out = level.downwards(level.upwards(lms))
    for r in reversed(range(len(level.edges) - 1)):
        yield from out.pop(r)


def suffixes_down(text: np.ndarray, most: int | None = None, folder: str | None = None, held: int = HELD, step: int = STEP) -> Iterator[np.ndarray]:
    """Blocks of (at, lcp), from the largest suffix down; lcp is what it shares with the one before it, up to `most`. The last symbol of text is smaller than any before."""
    store = Store(folder)
    try:
        if len(text) == 1:
            yield np.zeros(1, SUFFIX)
            return
        order = Induction(text, store, held, None, step)
        lms = sorted_lms(order)
        order.most = most
        yield from _blocks(order, lms)
    finally:
        store.close()


def repeated_starts(pieces: list[bytes], size: int, folder: str | None = None, held: int = HELD, step: int = STEP) -> list[np.ndarray]:
    """For each piece the starts of its strings of `size` bytes that also start elsewhere in the pieces, in order.

    The pieces are sorted as one text of symbols byte + 2 with 1 after each and 0 at the end. Two starts that follow each other in the order are equal iff the least common prefix from
    one to the other reaches `size`. Text and types stay in memory, 3 bytes a suffix; the queues' 12 bytes a suffix go to the folder.
    """
    data = np.frombuffer(b"".join(x + b"\0" for x in pieces), np.uint8)
    if not len(data):
        return []
    text = data.astype(np.int16) + 2
    lengths = np.array([len(x) for x in pieces], np.int64)
    begins = np.concatenate([[0], np.cumsum(lengths + 1)])
    text[begins[1:] - 1] = 1
    text[-1] = 0
    is_start = np.ones(len(text), bool)
    for k in range(len(pieces)):
        is_start[max(begins[k], begins[k + 1] - size) : begins[k + 1]] = False
    if not is_start.any():
        return [np.zeros(0, np.int64) for _ in pieces]
    twice = np.zeros(len(text), bool)
    last, least = None, _FAR
    for block in suffixes_down(text, size, folder, held, step):
        place = np.flatnonzero(is_start[block["at"]])
        if not len(place):
            least = min(least, int(block["lcp"].min()))
            continue
        between = np.minimum.reduceat(block["lcp"][: place[-1] + 1], np.concatenate([[0], place[:-1] + 1]))  # from after one start to the next, included
        own = block["at"][place]
        if last is not None and min(least, int(between[0])) >= size:
            twice[[last, own[0]]] = True
        same = np.flatnonzero(between[1:] >= size)
        twice[own[same]] = True
        twice[own[same + 1]] = True
        last = own[-1]
        least = int(block["lcp"][place[-1] + 1 :].min(initial=_FAR))
    found = np.flatnonzero(twice)
    cut = np.searchsorted(found, begins)
    return [found[a:b] - begins[k] for k, (a, b) in enumerate(zip(cut[:-1], cut[1:], strict=True))]
