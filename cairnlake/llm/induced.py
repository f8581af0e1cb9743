"""External induced sorting of suffixes, with common-prefix values.

A level sorts the S*-substrings of its text (from one left-most S-suffix to the next), names them by rank, and sorts the
string of the names by a level of its own, as long as two substrings are equal. Two sweeps then induce all other suffixes
from the sorted S*-suffixes: L-suffixes upward, S-suffixes downward. What is induced waits in a monotone priority queue of
tuples (suffix, common prefix with the tuple before), least symbol first, then first come. A common prefix counts symbols;
those of the S*-suffixes come from the common prefixes of the level below, by the places where the equal names end.

All arrays that grow with the text, queues included, come from a :class:`Space`: in memory up to its bound, beyond it
mapped from files of the task's temporary folder. All steps take at most ``BATCH`` tuples at a time.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np

#: Bytes of arrays that one sort keeps in memory; the rest lies on disk.
MEMORY = 256 << 20
#: Tuples that a step takes at a time.
BATCH = 1 << 18
FAR = np.int32(2**31 - 1)


class Space:
    """Where the arrays of one sort lie. ``on_disk`` counts the bytes of files, ``depth`` the levels of the recursion."""

    def __init__(self, memory: int = MEMORY):
        self.memory, self.left, self.on_disk, self.depth = max(memory, 1), memory, 0, 0

    def array(self, n: int, kind) -> np.ndarray:
        size = n * np.dtype(kind).itemsize
        if size <= self.left:
            self.left -= size
            return np.zeros(n, kind)
        self.on_disk += size
        with tempfile.TemporaryFile() as file:
            file.truncate(size)
            return np.memmap(file, kind, "r+", shape=(n,))

    def free(self, *arrays: np.ndarray) -> None:
        """The arrays are no longer used."""
        self.left += sum(0 if isinstance(x, np.memmap) else x.nbytes for x in arrays)


def pieces(n: int) -> Iterator[slice]:
    for a in range(0, n, BATCH):
        yield slice(a, min(a + BATCH, n))


class Queue:
    """A monotone priority queue of tuples (suffix, common prefix), least symbol first, then first come.

    How many tuples a symbol gets is known before; so each has a stretch of its own, and is complete when that is full.
    What has left the queue stays readable: in the end ``at`` and ``common`` hold all tuples in the order of leaving.
    """

    def __init__(self, counts: np.ndarray, kind, space: Space):
        self.start, self.filled = space.array(len(counts) + 1, np.int64), space.array(len(counts), np.int64)
        np.cumsum(counts, out=self.start[1:])
        self.filled[:] = self.start[:-1]
        self.at, self.common = space.array(int(self.start[-1]), kind), space.array(int(self.start[-1]), np.int32)
        self.low = 0

    def push(self, heads: np.ndarray, sizes: np.ndarray, at: np.ndarray, common: np.ndarray) -> None:
        """Tuples in the order of their symbols: ``sizes`` of them for each of ``heads``."""
        place = np.arange(len(at)) + np.repeat(self.filled[heads] - (np.cumsum(sizes) - sizes), sizes)
        self.at[place], self.common[place] = at, common
        self.filled[heads] += sizes

    def incomplete(self) -> int:
        """The least symbol that still waits for tuples; as many as there are symbols if none does."""
        width, many = 64, len(self.filled)
        while self.low < many:
            upto = min(self.low + width, many)
            hole = self.filled[self.low : upto] < self.start[self.low + 1 : upto + 1]
            k = int(hole.argmax())
            if hole[k]:
                self.low += k
                break
            self.low, width = upto, 2 * width
        return self.low


class Carrier:
    """The least common prefix that lies between two tuples of one symbol, over all batches in between."""

    def __init__(self, symbols: int, space: Space):
        self.tail, self.seen = space.array(symbols, np.int32), space.array(symbols, np.int32)
        self.between, self.batches = np.full(64, FAR, np.int32), 0  # between[k]: least of all batches after k

    def carried(self, order: np.ndarray, starts: np.ndarray, heads: np.ndarray, common: np.ndarray) -> np.ndarray:
        """For the chosen tuples ``order`` (by symbol, those of ``heads`` from ``starts``): one symbol more than they share with the last of the symbol."""
        padded = np.append(common, FAR)
        value = np.empty(len(order), np.int32)
        if len(order) > 1:
            spans = np.empty(2 * len(order) - 2, np.int64)
            spans[0::2], spans[1::2] = order[:-1] + 1, order[1:] + 1
            value[1:] = np.minimum.reduceat(padded, spans)[0::2]
        before = np.minimum.accumulate(common)
        after = np.minimum.accumulate(padded[::-1])[::-1]
        last = np.append(starts[1:], len(order)) - 1
        seen = self.seen[heads]
        known = np.minimum(np.minimum(self.tail[heads], self.between[seen]), before[order[starts]]) + 1
        value += 1
        value[starts] = np.where(seen > 0, known, 0)
        if self.batches + 2 > len(self.between):
            self.between = np.concatenate([self.between, np.full(len(self.between), FAR, np.int32)])
        self.batches += 1  # from 1: 0 is for symbols not seen
        k = int(np.searchsorted(self.between[: self.batches], after[0], side="right"))
        self.between[k : self.batches] = after[0]
        self.tail[heads], self.seen[heads] = after[order[last] + 1], self.batches
        return value

    def skip(self, common: np.ndarray) -> None:
        """A batch that pushes nothing."""
        least = common.min()
        k = int(np.searchsorted(self.between[: self.batches + 1], least, side="right"))
        self.between[k : self.batches + 1] = least


class Text:
    """Symbols with a word of zeros behind, read eight bytes at a time to compare suffixes."""

    def __init__(self, t: np.ndarray, space: Space):
        per = 8 // t.dtype.itemsize
        self.held = space.array(len(t) + per, t.dtype)
        for s in pieces(len(t)):
            self.held[s] = t[s]
        self.t, self.per, self.bits = self.held[: len(t)], per, 8 * t.dtype.itemsize
        self.words = np.ndarray((len(t),), "<u8", self.held, strides=(t.dtype.itemsize,))

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """How many symbols each pair of suffixes shares."""
        out = np.zeros(len(a), np.int32)
        left = np.arange(len(a))
        a, b = a.astype(np.int64), b.astype(np.int64)
        while len(left):
            differ = self.words[a] ^ self.words[b]
            same = differ == 0
            if not same.all():
                found = differ[~same]
                lowest = (found & (~found + np.uint64(1))).astype(np.float64).view(np.uint64) >> np.uint64(52)
                out[left[~same]] += ((lowest - np.uint64(1023)) // np.uint64(self.bits)).astype(np.int32)
                left, a, b = left[same], a[same], b[same]
            out[left] += self.per
            a, b = a + self.per, b + self.per
        return out


def types(t: np.ndarray, space: Space) -> np.ndarray:
    """True for S-suffixes; the last entry is the only least one."""
    out = space.array(len(t), bool)
    out[-1] = after = True
    for s in reversed(list(pieces(len(t) - 1))):
        here, then = t[s], t[s.start + 1 : s.stop + 1]
        change = np.flatnonzero(here != then)
        if len(change):
            upto = s.start + int(change[-1]) + 1
            out[upto : s.stop] = after
            up = here[change] < then[change]
            out[s.start : upto] = np.repeat(up, np.diff(change, prepend=-1))
            after = bool(up[0])
        else:
            out[s] = after
    return out


def tally(found: np.ndarray, counts: np.ndarray) -> None:
    """Counts symbols: few that are found, or few in all."""
    if len(found) < len(counts):
        symbols, times = np.unique(found, return_counts=True)
        counts[symbols] += times
    else:
        counts += np.bincount(found, minlength=len(counts))


def sweep(text: Text, key: np.ndarray, ok: np.ndarray, seeds: np.ndarray, seed_common: np.ndarray, symbols: int, space: Space) -> Queue:
    """Induces the suffixes marked in ``ok`` from the ``seeds``: in rising order of ``key``, in which the seeds are sorted.

    Of one symbol, induced suffixes come before the seeds. ``seed_common`` counts from the seed before.
    """
    upto, counts = space.array(symbols + 1, np.int64), space.array(symbols, np.int64)
    for s in pieces(len(seeds)):
        tally(key[seeds[s]], upto[1:])
    np.cumsum(upto, out=upto)
    for s in pieces(len(key)):
        tally(key[s][ok[s]], counts)
    queue, carrier = Queue(counts, seeds.dtype, space), Carrier(symbols, space)
    space.free(counts)
    pushed = space.array(len(key), np.int16 if symbols < 2**15 else np.int32)  # the symbol before each suffix that is induced from it, else -1
    pushed[0] = -1
    for s in pieces(len(key) - 1):
        pushed[s.start + 1 : s.stop + 1] = np.where(ok[s], key[s], pushed.dtype.type(-1))
    done, planted, last = 0, 0, -1  # tuples that left, seeds used, the last tuple if it was induced
    while True:
        wait = queue.incomplete()
        end, plant = (queue.filled[wait], upto[wait]) if wait < symbols else (queue.start[-1], upto[-1])
        if plant - planted > BATCH:
            plant = planted + BATCH
            end = min(end, queue.start[int(key[seeds[plant]]) + 1])
        if end - done > BATCH:
            end = done + BATCH
            plant = min(plant, upto[int(key[queue.at[end]])])
        if end == done and plant == planted:
            break
        at, common = queue.at[done:end], queue.common[done:end]
        if plant > planted:
            new, shared = seeds[planted:plant], seed_common[planted:plant]
            place, induced = np.arange(len(new)) + np.searchsorted(key[at], key[new], side="right"), np.ones(len(at) + len(new), bool)
            induced[place] = False
            both, value = np.empty(len(induced), seeds.dtype), np.empty(len(induced), np.int32)
            both[induced], both[place], value[induced], value[place] = at, new, common, shared
            seam = place[induced[place - 1] & (place > 0)]
            before = both[seam - 1]
            if place[0] == 0 and last >= 0:
                seam, before = np.append(seam, 0), np.append(before, last)
            meet = key[before] == key[both[seam]]
            value[seam] = 0
            value[seam[meet]] = text.common(before[meet], both[seam[meet]])
            at, common = both, value
            last = int(at[-1]) if induced[-1] else -1
        else:
            last = int(at[-1])
        done, planted = int(end), int(plant)
        symbol = pushed[at]
        chosen = np.flatnonzero(symbol >= 0)
        if not len(chosen):
            carrier.skip(common)
            continue
        symbol = symbol[chosen]
        by = np.argsort(symbol, kind="stable")
        symbol, order = symbol[by], chosen[by]
        target = at[order] - 1
        starts = np.flatnonzero(np.concatenate([[True], symbol[1:] != symbol[:-1]]))
        heads = symbol[starts].astype(np.int64)
        queue.push(heads, np.diff(np.append(starts, len(by))), target, carrier.carried(order, starts, heads, np.asarray(common)))
    space.free(carrier.tail, carrier.seen, queue.filled, upto, pushed)
    if done != queue.start[-1]:
        raise AssertionError("suffixes are left over")
    return queue


def ranked(keys: np.ndarray, kind, space: Space) -> np.ndarray:
    """The order of the keys: sorted in runs that fit into memory, between keys drawn from all."""
    order = space.array(len(keys), kind)
    runs = -(-len(keys) * 24 // space.memory)
    if runs < 2:
        order[:] = np.argsort(keys)
        return order
    drawn = np.unique(np.sort(keys[:: max(1, len(keys) // (64 * runs))])[:: 64])
    done = 0
    for k in range(len(drawn) + 1):
        for alone in (False, True):  # the keys below a drawn one, and those equal to it
            if alone and k == len(drawn):
                continue
            found = [np.zeros(0, np.int64)]
            for s in pieces(len(keys)):
                x = keys[s]
                if alone:
                    here = np.flatnonzero(x == drawn[k]) + s.start
                    order[done : done + len(here)] = here
                    done += len(here)
                else:
                    inside = (x < drawn[k]) if k < len(drawn) else np.ones(len(x), bool)
                    found.append(np.flatnonzero(inside & (x > drawn[k - 1]) if k else inside) + s.start)
            if not alone:
                here = np.concatenate(found)
                order[done : done + len(here)] = here[np.argsort(keys[here])]
                done += len(here)
    return order


def named(t: np.ndarray, stars: np.ndarray, symbols: int, space: Space) -> tuple[np.ndarray, np.ndarray, int]:
    """(the S*-substrings in order, their names in the order of the text, how many names).

    Substrings are read some symbols at a time. One that ends early goes on with what is greater than any symbol: the
    suffix behind an S-symbol goes on with a greater one than a suffix that goes on with an L-symbol there.
    """
    n, bits = len(stars), int(symbols).bit_length()
    per = 63 // bits
    size = lambda i: stars[np.minimum(i + 1, n - 1)] - stars[i] + 1

    def packed(i: np.ndarray, skip: int) -> np.ndarray:
        begin, length, out = stars[i].astype(np.int64) + skip, size(i).astype(np.int64) - skip, np.zeros(len(i), np.uint64)
        for k in range(per):
            inside = k < length
            symbol = np.full(len(i), symbols, np.uint64)
            symbol[inside] = t[begin[inside] + k]
            out = out << np.uint64(bits) | symbol
        return out

    keys = space.array(n, np.uint64)
    for s in pieces(n):
        keys[s] = packed(np.arange(s.start, s.stop), 0)
    order = ranked(keys, stars.dtype, space)
    new = space.array(n, bool)
    new[0] = True
    for s in pieces(n - 1):
        sorted_keys = keys[order[s.start : s.stop + 1]]
        new[s.start + 1 : s.stop + 1] = sorted_keys[1:] != sorted_keys[:-1]
    space.free(keys)
    del keys
    a = 0
    while a < n:  # longer ones among equals, by the symbols that follow; equals are not parted
        b = min(a + BATCH, n)
        while b < n and not new[b]:
            more = np.flatnonzero(new[b : b + BATCH])
            b = b + int(more[0]) if len(more) else min(b + BATCH, n)
        refine(order[a:b], new[a:b], packed, size, per)
        a = b
    names = space.array(n, np.int32 if n < FAR else np.int64)
    total = -1
    for s in pieces(n):
        fresh = total + np.cumsum(new[s])
        names[order[s]] = fresh
        total = int(fresh[-1])
    space.free(new)
    return order, names, total + 1


def refine(order: np.ndarray, new: np.ndarray, packed, size, per: int) -> None:
    """Sorts whole groups of equal keys by the symbols behind these, and marks where new substrings begin."""
    skip, many = per, len(order)
    active = np.flatnonzero(size(order) >= skip)
    while True:
        active = active[~new[active] | (active + 1 < many) & ~new[np.minimum(active + 1, many - 1)]]
        if not len(active):
            return
        head = np.concatenate([[True], new[active[1:]] | (np.diff(active) > 1)])
        group = np.cumsum(head)
        own = order[active]
        key = packed(own, skip)
        by = np.lexsort((key, group))
        order[active] = own[by]
        key, own = key[by], own[by]
        new[active] = head | np.concatenate([[True], key[1:] != key[:-1]])
        skip += per
        active = active[size(own) >= skip]


def suffix_sort(t: np.ndarray, symbols: int, space: Space, level: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """(suffix array, common prefixes with the suffix before) of symbols below ``symbols`` whose last is the only 0."""
    n = len(t)
    kind = np.int32 if n < FAR else np.int64
    space.depth = max(space.depth, level)
    if n == 1:
        return space.array(1, kind), space.array(1, np.int32)
    text = Text(t, space)
    t = text.t
    s_type = types(t, space)
    many = sum(int(np.count_nonzero(s_type[s.start + 1 : s.stop + 1] & ~s_type[s])) for s in pieces(n - 1))
    stars, done = space.array(many, kind), 0
    for s in pieces(n - 1):
        here = np.flatnonzero(s_type[s.start + 1 : s.stop + 1] & ~s_type[s]) + s.start + 1
        stars[done : done + len(here)] = here
        done += len(here)
    order, names, total = named(t, stars, symbols, space)
    shared = space.array(many, np.int32)
    if total < many:
        space.free(order, shared)
        order, shared = suffix_sort(names, total, space, level + 1)
    space.free(names)
    del names
    seeds, seed_common = space.array(many, kind), space.array(many, np.int32)
    for s in pieces(many):
        seeds[s] = stars[order[s]]
        a = max(s.start - 1, 0)
        one, two, equal = order[a : s.stop - 1], order[a + 1 : s.stop], shared[a + 1 : s.stop]
        x, y = stars[one + equal], stars[two + equal]
        seed_common[a + 1 : s.stop] = x - stars[one] + text.common(x, y)
    space.free(order, shared, stars)
    del order, shared, stars
    ok = space.array(n, bool)
    for s in pieces(n):
        ok[s] = ~s_type[s]
    up = sweep(text, t, ok, seeds, seed_common, symbols, space)
    space.free(seeds, seed_common)
    del seeds, seed_common
    key = space.array(n, t.dtype)
    for s in pieces(n):
        key[s], ok[s] = t.dtype.type(symbols - 1) - t[s], s_type[s]
    ok[-1] = False  # the last suffix is before all others; it induces nothing
    falling = up.common[::-1]  # counts from the next below: shifted by one
    shift = space.array(len(falling), np.int32)
    for s in pieces(len(falling) - 1):
        shift[s.start + 1 : s.stop + 1] = falling[s]
    down = sweep(text, key, ok, up.at[::-1], shift, symbols, space)
    space.free(shift, key, ok, s_type)
    del shift, key, ok, s_type
    out = merged(text, up, down, kind, n, space)
    space.free(up.start, up.at, up.common, down.start, down.at, down.common, text.held)
    return out


def merged(text: Text, up: Queue, down: Queue, kind, n: int, space: Space) -> tuple[np.ndarray, np.ndarray]:
    """All suffixes in order: the last one, then of each symbol the L-suffixes and the S-suffixes."""
    at, common = space.array(n, kind), space.array(n, np.int32)
    at[0] = n - 1
    last, symbols = len(down.at), len(up.start) - 1
    below = lambda c: last - down.start[symbols - c]  # noqa: E731  S-suffixes of lower symbols
    for s in pieces(len(up.at)):
        own = up.at[s]
        place = np.arange(s.start, s.stop) + below(text.t[own].astype(np.int64)) + 1
        at[place], common[place] = own, up.common[s]
    for s in pieces(last):  # rising: the reverse of how they were induced
        own = down.at[last - s.stop : last - s.start][::-1]
        place = np.arange(s.start, s.stop) + up.start[text.t[own].astype(np.int64) + 1] + 1
        at[place] = own
        behind = place[place < n - 1] + 1  # what it shares with the next greater one
        common[behind] = down.common[last - s.stop : last - s.start][::-1][: len(behind)]
    for s in pieces(symbols):
        c = np.arange(s.start, s.stop)
        first, upto, low, high = up.start[c], up.start[c + 1], below(c), below(c + 1)
        common[(first + low + 1)[upto + high > first + low]] = 0
        seam = (upto + low + 1)[(upto > first) & (high > low)]
        common[seam] = text.common(at[seam - 1], at[seam])
    return at, common


def windows(at: np.ndarray, common: np.ndarray, size: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(suffixes in order, numbers of their groups), a batch at a time: those of one group share ``size`` symbols."""
    group = -1
    for s in pieces(len(at)):
        numbers = group + np.cumsum(common[s] < size)
        yield at[s], numbers
        group = int(numbers[-1])
