"""External induced sorting: suffixes and common prefixes by recursion, in bounded memory.

The order of all suffixes is induced from that of the LMS suffixes, where the text turns from falling to
rising.  A first induction sorts the LMS substrings and so names them; the string of names, half as long
at most, is sorted by the same procedure, recursively, until all names differ or the string is of ``BASE``
names or fewer: then their ranks are doubled in memory.  A second induction, from the LMS suffixes in their
right order, gives all L suffixes ascending and then all S suffixes descending.

An induction is driven by a priority queue keyed by first symbol and, within one, by order of arrival,
which is the suffixes' order.  It holds, for each range of symbols, a run of tuples of a suffix and what it
has in common with the one before.  A symbol of its own range is taken from its run a chunk at a time.  A
range of several symbols (names are many) is held in memory, as it has ``RANGE`` tuples at most, and taken
by batches; a batch ends where a suffix that it induces belongs.

What a suffix has in common with the one before it in its run is one more than the least common prefix of
all that was scanned since; these minima are kept for each symbol.  Common prefixes are cut off at ``CAP``.

Everything whose size grows with the text lies in a :class:`Scratch`: in memory as far as its limit goes, and
beyond that in files, mapped or read back by chunks.  So a text of any size takes the same memory.
"""

from __future__ import annotations

import bisect
import os
import tempfile
from collections.abc import Callable, Iterator

import numpy as np

CAP = 100
CHUNK = 1 << 17
RANGE, BATCH = 1 << 16, 2048
BASE = 1 << 20
OWN_RANGES = 512  # up to so many symbols, each has a range of its own
MEMORY = 32 << 20
PAD = CAP + 8


class Scratch:
    """Arrays and queues of a sort; beyond ``memory`` bytes they lie in files of ``folder``, which vanish with the process."""

    def __init__(self, folder: str | None = None, memory: int = MEMORY):
        self.folder, self.memory, self.held, self.spilled = folder, memory, 0, 0
        self.file = None

    def array(self, n: int, dtype) -> np.ndarray:
        size = n * np.dtype(dtype).itemsize
        if n == 0 or self.folder is None or self.held + size <= self.memory:
            self.held += size
            return np.zeros(n, dtype)
        self.spilled += size
        handle, path = tempfile.mkstemp(".sort", dir=self.folder)
        os.close(handle)
        out = np.memmap(path, dtype, "w+", shape=(n,))
        os.unlink(path)  # the mapping keeps it
        return out

    def free(self, *arrays: np.ndarray) -> None:
        for a in arrays:
            if not isinstance(a, np.memmap):
                self.held -= a.nbytes

    def write(self, data: np.ndarray) -> int:
        """Append to the one file of chunks; where they begin."""
        if self.file is None:
            self.file = tempfile.TemporaryFile(dir=self.folder, buffering=0)
            self.end = 0
        at, left = self.end, memoryview(data).cast("B")
        while len(left):
            done = os.pwrite(self.file.fileno(), left, self.end)
            self.end += done
            left = left[done:]
        self.spilled += data.nbytes
        return at

    def read(self, at: int, n: int, dtype) -> np.ndarray:
        out = np.empty(n, dtype)
        left = memoryview(out).cast("B")
        while len(left):
            done = os.preadv(self.file.fileno(), [left], at)
            at += done
            left = left[done:]
        return out

    def close(self) -> None:
        if self.file is not None:
            self.file.close()
            self.file = None


class Tape:
    """An array that grows; its parts go to a file when the scratch is full."""

    def __init__(self, scratch: Scratch, dtype):
        self.scratch, self.dtype, self.parts, self.file, self.n = scratch, np.dtype(dtype), [], None, 0

    def add(self, part: np.ndarray) -> None:
        part = np.ascontiguousarray(part, self.dtype)
        self.n += len(part)
        if self.file is None and (self.scratch.folder is None or self.scratch.held + part.nbytes <= self.scratch.memory):
            self.parts.append(part)
            self.scratch.held += part.nbytes
            return
        if self.file is None:
            self.file = tempfile.TemporaryFile(dir=self.scratch.folder)
            for old in self.parts:
                self.file.write(old)
                self.scratch.held -= old.nbytes
            self.parts = []
        self.file.write(part)
        self.scratch.spilled += part.nbytes

    def whole(self) -> np.ndarray:
        if self.file is None:
            return np.concatenate([np.empty(0, self.dtype), *self.parts])
        self.file.flush()
        return np.memmap(self.file, self.dtype, "r", shape=(self.n,))


class Runs:
    """The priority queue: a run of suffixes, and common prefixes if wanted, for each range of symbols."""

    def __init__(self, scratch: Scratch, ranges: int, word, prefixes: bool):
        self.scratch, self.kinds = scratch, (word, np.uint8) if prefixes else (word,)
        self.pieces: list[list] = [[] for _ in range(ranges)]  # of a run: first place, number, places in the file
        self.fresh: list[list] = [[] for _ in range(ranges)]  # then those in memory: first place, arrays
        self.sizes = [0] * ranges
        self.held = 0

    def put(self, r: int, *arrays: np.ndarray) -> None:
        arrays = tuple(a.astype(k) for a, k in zip(arrays, self.kinds, strict=False))
        self.fresh[r].append((self.sizes[r], *arrays))
        self.sizes[r] += len(arrays[0])
        size = sum(a.nbytes for a in arrays)
        self.held += size
        self.scratch.held += size
        if self.scratch.folder is not None and self.scratch.held > self.scratch.memory and self.held > self.scratch.memory // 8:
            self.flush()

    def flush(self) -> None:
        for r, run in enumerate(self.fresh):
            if run:
                arrays = [np.concatenate([x[1 + k] for x in run]) for k in range(len(self.kinds))]
                self.pieces[r].append((run[0][0], len(arrays[0]), [self.scratch.write(a) for a in arrays]))
                run.clear()
        self.scratch.held -= self.held
        self.held = 0

    def read(self, r: int, at: int, most: int = CHUNK) -> list[np.ndarray]:
        """Tuples from the ``at``-th on: ``most``, or fewer."""
        out: list[list] = [[np.empty(0, k)] for k in self.kinds]
        while at < self.sizes[r] and most > 0:
            pieces = self.pieces[r]
            i = bisect.bisect_right(pieces, at, key=lambda p: p[0]) - 1
            if i >= 0 and at < pieces[i][0] + pieces[i][1]:
                first, n, places = pieces[i]
                n = min(first + n - at, most)
                for k, kind in enumerate(self.kinds):
                    out[k].append(self.scratch.read(places[k] + (at - first) * np.dtype(kind).itemsize, n, kind))
            else:
                run = self.fresh[r]
                first, *arrays = run[bisect.bisect_right(run, at, key=lambda p: p[0]) - 1]
                n = min(first + len(arrays[0]) - at, most)
                for k, a in enumerate(arrays):
                    out[k].append(a[at - first : at - first + n])
            at, most = at + n, most - n
        return [np.concatenate(x) for x in out]

    def drop(self, r: int) -> None:
        size = sum(a.nbytes for x in self.fresh[r] for a in x[1:])
        self.held -= size
        self.scratch.held -= size
        self.fresh[r], self.pieces[r], self.sizes[r] = [], [], 0

    def close(self) -> None:
        self.scratch.held -= self.held
        self.held, self.fresh, self.pieces = 0, [], []


def _fours(t: np.ndarray) -> tuple[np.ndarray, int]:
    """A text with its padding as overlapping 64-bit words, one beginning at each symbol; and symbols in a word."""
    each = 8 // t.itemsize
    return np.ndarray((len(t) - each + 1,), "<u8", t, strides=(t.itemsize,)), each


def common_prefixes(t: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Lengths, ``CAP`` at most, of the common prefixes of suffixes ``a[i]`` and ``b[i]`` of the padded text ``t``, four symbols at a time."""
    words, _ = _fours(t)
    last = len(words) - 1
    out, active = np.full(len(a), CAP, np.uint8), np.arange(len(a))
    a, b = a.astype(np.int64), b.astype(np.int64)
    for k in range(0, CAP, 4):
        x = words[np.minimum(a[active] + k, last)] ^ words[np.minimum(b[active] + k, last)]
        if (differ := x != 0).any():
            low = x[differ]
            same = (low & np.uint64(0xFFFF) == 0).astype(np.int16)
            same += low & np.uint64(0xFFFFFFFF) == 0
            same += low & np.uint64(0xFFFFFFFFFFFF) == 0
            out[active[differ]] = np.minimum(k + same, CAP)
            active = active[~differ]
        if not len(active):
            break
    return out


def _same(t: np.ndarray, a: np.ndarray, b: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Whether ``length[i]`` symbols from ``a[i]`` and ``b[i]`` on are equal."""
    words, each = _fours(t)
    out, active, k = np.ones(len(a), bool), np.arange(len(a)), 0
    bits = np.uint64(8 * t.itemsize)
    while len(active):
        x = words[a[active] + k] ^ words[b[active] + k]
        left = np.minimum(length[active] - k, each).astype(np.uint64)
        x &= ~np.uint64(0) >> (np.uint64(64) - left * bits)
        equal = x == 0
        out[active[~equal]] = False
        k += each
        active = active[equal & (length[active] > k)]
    return out


def _types(t: np.ndarray, n: int, scratch: Scratch) -> tuple[np.ndarray, int]:
    """Whether each suffix is smaller than the next, the last one not; and the number of LMS suffixes."""
    s = scratch.array(n, np.bool_)
    after, n_lms = False, 0  # the type of the place after the block
    for hi in range(n - 1, 0, -CHUNK):
        lo = max(0, hi - CHUNK)
        block = t[lo : hi + 1].astype(np.int64)
        step = np.sign(np.diff(block))
        turn = np.where(step != 0, np.arange(len(step)), len(step))
        following = np.minimum.accumulate(turn[::-1])[::-1]
        own = np.append(step, 1 if after else -1)[following] > 0
        s[lo:hi] = own
        n_lms += int((np.append(own, after)[1:] & ~own).sum())
        after = bool(own[0])
    return s, n_lms


def _ranges(t: np.ndarray, n: int, symbols: int) -> np.ndarray:
    """Ends of symbol ranges: of one symbol, or with ``RANGE`` suffixes at most."""
    if symbols <= OWN_RANGES:
        return np.arange(symbols + 1)
    cuts = np.unique(np.linspace(0, symbols, 1025).astype(np.int64))
    while True:
        counts = np.zeros(len(cuts) - 1, np.int64)
        for at in range(0, n, CHUNK):
            counts += np.bincount(np.searchsorted(cuts, t[at : min(n, at + CHUNK)], "right") - 1, minlength=len(counts))
        wide = np.flatnonzero((counts > RANGE) & (np.diff(cuts) > 1))
        if not len(wide):
            break
        cuts = np.unique(np.concatenate([cuts, *(np.linspace(cuts[i], cuts[i + 1], 65).astype(np.int64) for i in wide)]))
    out, held = [0], 0
    for end, count in zip(cuts[1:].tolist(), counts.tolist(), strict=True):
        if held and held + count > RANGE:
            out.append(last)
            held = 0
        held, last = held + count, end
    return np.array([*out, symbols])


class _Induction:
    """One pass: scans the queue's ranges in order, and puts what is induced into it."""

    def __init__(self, t: np.ndarray, s: np.ndarray, cuts: np.ndarray, queue: Runs, rising: bool, prefixes: bool):
        self.t, self.s, self.cuts, self.queue, self.rising, self.prefixes = t, s, cuts, queue, rising, prefixes
        self.own = len(cuts) - 1 == cuts[-1]
        self.since = np.full(len(cuts) - 1, CAP, np.uint8)  # the least common prefix scanned since a symbol's run last grew

    def before(self, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Places in ``suffixes`` that induce, the suffixes induced and their symbols."""
        before = suffixes.astype(np.int64) - 1
        at = np.flatnonzero((before >= 0) & (self.s[before] if self.rising else ~self.s[before]))
        before = before[at]
        return at, before, self.t[before]

    def send(self, suffixes: np.ndarray, symbols: np.ndarray) -> None:
        ranges = symbols if self.own else np.searchsorted(self.cuts, symbols, "right") - 1
        by = np.argsort(ranges, kind="stable")
        suffixes, ranges = suffixes[by], ranges[by]
        cut = np.flatnonzero(np.diff(ranges)) + 1
        if len(ranges):
            for part, r in zip(np.split(suffixes, cut), ranges[np.append(0, cut)].tolist(), strict=True):
                self.queue.put(r, part)

    def induce(self, suffixes: np.ndarray, prefixes: np.ndarray | None) -> None:
        at, before, symbols = self.before(suffixes)
        if not self.prefixes:
            self.send(before, symbols)
            return
        by = np.argsort(symbols, kind="stable")
        at, before, symbols = at[by], before[by], symbols[by]
        starts = np.flatnonzero(np.append(True, symbols[1:] != symbols[:-1])).tolist() if len(at) else []
        left = np.minimum(self.since, prefixes.min())
        for start, stop in zip(starts, [*starts[1:], len(at)], strict=False):
            own, c = at[start:stop], int(symbols[start])
            low = np.minimum.reduceat(prefixes[: own[-1] + 1], np.append(0, own[:-1] + 1))
            low[0] = min(low[0], self.since[c])
            common = np.minimum(low + np.uint8(1), CAP)
            if not self.queue.sizes[c]:
                common[0] = 0
            self.queue.put(c, before[start:stop], common)
            rest = prefixes[own[-1] + 1 :]
            left[c] = rest.min() if len(rest) else CAP
        self.since = left

    def scan(self, seeds: Callable[[int], Iterator[list[np.ndarray]]], keep: bool) -> Iterator[tuple[np.ndarray, np.ndarray | None, bool]]:
        """All suffixes in order, by chunks: suffixes, common prefixes with the one scanned before, whether they are seeds.

        ``seeds(range)`` has those of the other kind, which come after the induced ones of their symbol."""
        n = len(self.cuts) - 1
        for r in range(n - 1, -1, -1) if self.rising else range(n):
            if self.cuts[r + 1] - self.cuts[r] > 1:
                yield from self._scan_range(r, seeds)
            else:
                at, last = 0, None
                while at < self.queue.sizes[r]:
                    suffixes, *more = self.queue.read(r, at)
                    at, last = at + len(suffixes), suffixes[-1:]
                    self.induce(suffixes, more[0] if more else None)
                    yield suffixes, more[0] if more else None, False
                first = True
                for suffixes, *more in seeds(r):
                    prefixes = more[0] if more else None
                    if prefixes is not None and first:
                        prefixes[0] = 0 if last is None else common_prefixes(self.t, last, suffixes[:1])[0]
                    first = False
                    self.induce(suffixes, prefixes)
                    yield suffixes, prefixes, True
            if not keep:
                self.queue.drop(r)

    def _scan_range(self, r: int, seeds) -> Iterator[tuple[np.ndarray, None, bool]]:
        """A range of several symbols, by batches; a batch ends before what it induces would belong in it."""
        lo, hi = int(self.cuts[r]), int(self.cuts[r + 1])
        key = lambda symbols: 2 * ((hi - 1 - symbols.astype(np.int64)) if self.rising else (symbols.astype(np.int64) - lo))
        arrived = self.queue.read(r, 0, self.queue.sizes[r])[0].astype(np.int64)
        others = np.concatenate([np.empty(0, np.int64), *(x[0].astype(np.int64) for x in seeds(r))])
        ready = np.concatenate([arrived, others])
        keys = np.concatenate([key(self.t[arrived]), key(self.t[others]) + 1])
        order = np.argsort(keys, kind="stable")
        ready, keys, at = ready[order], keys[order], 0
        while at < len(ready):
            batch, own = ready[at : at + BATCH], keys[at : at + BATCH]
            places, before, symbols = self.before(batch)
            inside = (symbols >= lo) & (symbols < hi)
            then = key(symbols[inside])
            n = int(np.searchsorted(own, then.min(), "right")) if len(then) else len(batch)
            done = places < n
            self.send(before[done & ~inside], symbols[done & ~inside])
            then, more = then[done[inside]], before[inside & done]
            if len(more):
                self.queue.put(r, more)
                by = np.argsort(then, kind="stable")
                ready, keys, at = ready[at:], keys[at:], 0
                where = np.maximum(np.searchsorted(keys, then[by], "right"), n)
                ready, keys = np.insert(ready, where, more[by]), np.insert(keys, where, then[by])
            yield batch[:n], None, (own[:n] & 1).astype(bool)
            at += n


def _descending(t: np.ndarray, n: int, symbols: int, scratch: Scratch, prefixes: bool) -> Iterator[tuple[np.ndarray, np.ndarray | None]]:
    """Suffixes of the padded text from the largest, by chunks, and what each has in common with the one given before it."""
    word = np.uint32 if n < 1 << 32 else np.int64
    s, n_lms = _types(t, n, scratch)
    lms, k = scratch.array(n_lms, word), 0
    for at in range(0, n, CHUNK):
        block = s[max(0, at - 1) : min(n, at + CHUNK)]
        found = np.flatnonzero(block[1:] & ~block[:-1]) + max(0, at - 1) + 1
        lms[k : k + len(found)] = found
        k += len(found)
    cuts = _ranges(t, n, symbols)
    ranges = len(cuts) - 1
    ordered, bounds = scratch.array(n_lms, word), np.zeros(ranges + 1, np.int64)
    if n_lms:
        by_symbol = Runs(scratch, ranges, word, False)
        sender = _Induction(t, s, cuts, by_symbol, False, False)
        for at in range(0, n_lms, CHUNK):
            own = lms[at : at + CHUNK].astype(np.int64)
            sender.send(own, t[own])
        bounds[1:] = np.cumsum(by_symbol.sizes)
        _order(t, n, s, lms, cuts, by_symbol, ordered, scratch)
        by_symbol.close()

    def sorted_seeds(r: int) -> Iterator[list[np.ndarray]]:
        for at in range(bounds[r], bounds[r + 1], CHUNK):
            own = ordered[at : min(at + CHUNK, bounds[r + 1])]
            if prefixes:
                yield [own, np.append(np.uint8(0), common_prefixes(t, ordered[at - 1 : at + len(own) - 1], own) if at > bounds[r] else common_prefixes(t, own[:-1], own[1:]))[-len(own) :].copy()]
            else:
                yield [own]

    yield from ((a, b) for a, b, _ in _two_passes(t, n, s, cuts, sorted_seeds, word, scratch, prefixes))
    scratch.free(s, lms, ordered)


def _two_passes(t, n, s, cuts, seeds, word, scratch: Scratch, prefixes: bool) -> Iterator[tuple[np.ndarray, np.ndarray | None, bool]]:
    """L suffixes induced ascending from the seeds, then S suffixes descending from those: all from the largest; whether they are L."""
    ranges = len(cuts) - 1
    falling, rising = Runs(scratch, ranges, word, prefixes), Runs(scratch, ranges, word, prefixes)
    up = _Induction(t, s, cuts, falling, False, prefixes)
    last = np.array([n - 1])
    falling.put(int(np.searchsorted(cuts, t[n - 1], "right")) - 1, last, np.zeros(1, np.uint8))
    if prefixes:
        up.since[t[n - 1]] = 0  # the empty suffix was scanned first: it has nothing in common
    for _ in up.scan(seeds, keep=True):
        pass

    def from_largest(r: int) -> Iterator[list[np.ndarray]]:
        stop, after = falling.sizes[r], 0
        while stop > 0:
            at = max(0, stop - CHUNK)
            suffixes, *more = falling.read(r, at, stop - at)
            if more:
                down = np.append(np.uint8(after), more[0][:0:-1])
                after = more[0][0]
                yield [suffixes[::-1], down]
            else:
                yield [suffixes[::-1]]
            stop = at
        falling.drop(r)

    try:
        yield from _Induction(t, s, cuts, rising, True, prefixes).scan(from_largest, keep=False)
    finally:
        falling.close()
        rising.close()


def _doubled(names: np.ndarray) -> np.ndarray:
    """Suffixes of a string of names in order, in memory: ranks by twice as many names each time, of tied suffixes alone."""
    rank = names.astype(np.int64)
    rank = (np.cumsum(np.bincount(rank)) - np.bincount(rank))[rank]  # places from which equal ones count
    tied, k = np.flatnonzero(np.bincount(rank, minlength=len(rank))[rank] > 1), 1
    while len(tied):
        key = np.where(tied + k < len(rank), rank[np.minimum(tied + k, len(rank) - 1)], -1) + 1
        key |= rank[tied] << 32
        order = np.argsort(key)
        key, tied = key[order], tied[order]
        group = np.append(True, (key[1:] >> 32) != (key[:-1] >> 32))
        new = np.append(True, key[1:] != key[:-1])
        place = np.arange(len(tied))
        rank[tied] += np.maximum.accumulate(np.where(new, place, 0)) - np.maximum.accumulate(np.where(group, place, 0))
        alone = new & np.append(new[1:], True)
        tied = np.sort(tied[~alone])
        k *= 2
    out = np.empty(len(rank), np.int64)
    out[rank] = np.arange(len(rank))
    return out


def _order(t: np.ndarray, n: int, s: np.ndarray, lms: np.ndarray, cuts: np.ndarray, by_symbol: Runs, ordered: np.ndarray, scratch: Scratch) -> None:
    """Fill ``ordered`` with the LMS suffixes in their order: name their substrings by induction, then sort the names."""

    def by_first_symbol(r: int) -> Iterator[list[np.ndarray]]:
        for at in range(0, by_symbol.sizes[r], CHUNK):
            yield by_symbol.read(r, at)

    word, n_lms = lms.dtype, len(lms)
    names, name, previous = scratch.array(n_lms + PAD, word), -1, None  # from the largest, of each LMS substring by place
    for suffixes, _, seeds in _two_passes(t, n, s, cuts, by_first_symbol, word, scratch, False):
        own = suffixes[~seeds].astype(np.int64) if isinstance(seeds, np.ndarray) else suffixes[:0].astype(np.int64) if seeds else suffixes.astype(np.int64)
        own = own[own > 0]
        own = own[~s[own - 1]]
        if not len(own):
            continue
        index = np.searchsorted(lms, own.astype(word))
        length = np.where(index + 1 < n_lms, lms[np.minimum(index + 1, n_lms - 1)].astype(np.int64) - own + 1, -1)
        start, size = np.append(-1 if previous is None else previous[0], own), np.append(-2 if previous is None else previous[1], length)
        new = (size[1:] != size[:-1]) | (size[1:] < 0)
        maybe = np.flatnonzero(~new)
        new[maybe] = ~_same(t, start[:-1][maybe], own[maybe], length[maybe])
        found = name + np.cumsum(new)
        names[index] = found
        name, previous = int(found[-1]), (own[-1], length[-1])
    for at in range(0, n_lms, CHUNK):  # now from the smallest
        names[at : min(n_lms, at + CHUNK)] = name - names[at : min(n_lms, at + CHUNK)].astype(np.int64)
    if name + 1 == n_lms:
        for at in range(0, n_lms, CHUNK):
            ordered[names[at : min(n_lms, at + CHUNK)]] = lms[at : at + CHUNK]
    elif n_lms <= BASE:
        ordered[:] = lms[_doubled(names[:n_lms])]
    else:
        stop = n_lms
        for suffixes, _ in _descending(names, n_lms, name + 1, scratch, False):
            ordered[stop - len(suffixes) : stop] = lms[suffixes.astype(np.int64)][::-1]
            stop -= len(suffixes)
    scratch.free(names)


def padded(n: int, scratch: Scratch) -> np.ndarray:
    """Room for a text of ``n`` symbols, with a padding that no symbol equals."""
    t = scratch.array(n + PAD, np.uint16)
    t[n:] = np.arange(1 << 15, (1 << 15) + PAD)
    return t


def descending(t: np.ndarray, scratch: Scratch) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Suffixes of a :func:`padded` text (symbols below 512) from the largest, by chunks, with the common
    prefix, ``CAP`` at most, of each and the one before it in this order."""
    n = len(t) - PAD
    if n:
        symbols = 1 + max(int(t[at : min(n, at + CHUNK)].max()) for at in range(0, n, CHUNK))
        yield from _descending(t, n, symbols, scratch, True)


def induced_sort(text: np.ndarray, folder: str | None = None, memory: int = MEMORY) -> tuple[np.ndarray, np.ndarray]:
    """Suffix array of ``text`` and common prefixes with the suffix before, up to ``CAP``, as whole arrays."""
    scratch = Scratch(folder, memory)
    t = padded(len(text), scratch)
    t[: len(text)] = text
    parts = list(descending(t, scratch))
    scratch.close()
    if not parts:
        return np.empty(0, np.int64), np.empty(0, np.int16)
    sa, after = np.concatenate([a for a, _ in parts])[::-1].astype(np.int64), np.concatenate([b for _, b in parts])[::-1]
    return sa, np.append(0, after[:-1]).astype(np.int16)
