"""External induced suffix sorting of a shard, with common-prefix values.

Suffix tuples (position, common prefix with the suffix before it) pass through queues, one for each first character;
as a pushed tuple never belongs before the one that induced it, the queues together are a monotone priority queue.
Queues keep blocks of tuples and write them to an unlinked temporary file of the machine when more than a bound is
held; the text, its types and every other array as long as the text are mapped from such files beyond a bound, so the
machine may drop and reread their pages, and results are given out character by character. A shard may so be larger
than memory, and what has to fit into it is the reduced string and the suffixes of one first character.

One round of induction sorts the LMS substrings, their names form the reduced string, and the order of its suffixes
feeds the second round. The reduced string itself is not induced again: its names are a large alphabet, for which
queues by character would be many and short. Its suffixes are ordered by doubling, in which only those that still have
equals take part. Only ``depth`` characters count: suffixes that agree in them may come in any order, and common
prefixes are cut at ``depth``. Strings are compared by their characters, never by hashes.
"""

from __future__ import annotations

import tempfile
from collections import deque
from collections.abc import Iterator

import numpy as np

#: Bytes of tuples in memory, for all queues of a round, and of an array beyond which it is mapped from a file.
HELD, ROOM = 24 << 20, 64 << 20
_FAR = np.int16(32767)
#: Characters of a load of eight bytes.
_WIDE = 4


def room(n: int, kind, fill=0) -> np.ndarray:
    """An array of n values, mapped from an unlinked file where it is large."""
    kind = np.dtype(kind)
    if n * kind.itemsize <= ROOM:
        return np.full(n, fill, kind)
    with tempfile.TemporaryFile() as file:
        out = np.memmap(file, kind, "w+", shape=(n,))
    if fill:
        out[:] = fill
    return out


class Queues:
    """Disk-backed first-in-first-out queues of (positions, common prefixes), by character."""

    def __init__(self, characters: int, held: int | None = None):
        self.blocks = [deque() for _ in range(characters)]
        self.most, self.held, self.file, self.written = HELD if held is None else held, 0, None, 0

    def push(self, character: int, at: np.ndarray, shared: np.ndarray) -> None:
        size = at.nbytes + shared.nbytes
        if self.held + size > self.most:
            if self.file is None:
                self.file = tempfile.TemporaryFile()
            self.file.seek(0, 2)
            offset = self.file.tell()
            self.file.write(at.tobytes())
            self.file.write(shared.tobytes())
            self.written += size
            self.blocks[character].append((offset, len(at), at.dtype, shared.dtype))
        else:
            self.held += size
            self.blocks[character].append((at, shared))

    def _get(self, block) -> tuple[np.ndarray, np.ndarray]:
        if len(block) == 2:
            return block
        offset, n, kind, other = block
        self.file.seek(offset)
        return np.frombuffer(self.file.read(n * kind.itemsize), kind), np.frombuffer(self.file.read(n * other.itemsize), other)

    def pop(self, character: int, most: int = 1 << 22) -> tuple[np.ndarray, np.ndarray] | None:
        """The next blocks of a queue as one, until they have ``most`` tuples; None if there are none."""
        queue, parts, n = self.blocks[character], [], 0
        while queue and n < most:
            block = queue.popleft()
            if len(block) == 2:
                self.held -= block[0].nbytes + block[1].nbytes
            parts.append(self._get(block))
            n += len(parts[-1][0])
        if len(parts) < 2:
            return parts[0] if parts else None
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def all(self, character: int) -> tuple[np.ndarray, np.ndarray]:
        parts = [self._get(b) for b in self.blocks[character]]
        if not parts:
            return np.zeros(0, np.int64), np.zeros(0, np.int16)
        return np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts])

    def forget(self, character: int) -> None:
        for block in self.blocks[character]:
            if len(block) == 2:
                self.held -= block[0].nbytes + block[1].nbytes
        self.blocks[character].clear()


class Text:
    """A shard's characters (0 ends it, 1 ends a part, others are bytes + 2) with what the rounds need of them."""

    characters = 258

    def __init__(self, parts: list[bytes], depth: int, held: int | None = None):
        self.depth, self.held = depth, held
        sizes = np.fromiter((len(p) + 1 for p in parts), np.int64, len(parts))
        self.begins = np.concatenate(([0], np.cumsum(sizes)))
        n = self.n = int(self.begins[-1]) + 1
        self.position = np.dtype(np.int32 if n < 1 << 31 else np.int64)
        whole = room(n + depth + _WIDE, np.int16)
        for p, at in zip(parts, self.begins.tolist(), strict=False):
            whole[at : at + len(p)] = np.frombuffer(p, np.uint8)
            whole[at : at + len(p)] += 2
        whole[self.begins[1:] - 1] = 1
        self.t = t = whole[:n]
        #: The characters from each place on, four in a load.
        self.loads = np.ndarray((n + depth,), "<u8", whole, strides=(2,))
        self.smaller = room(n, bool)  # S type
        edge = np.flatnonzero(t[1:] != t[:-1])  # the last places of runs of one character
        rises = t[edge] < t[edge + 1]
        lengths = np.diff(np.concatenate(([-1], edge, [n - 1])))
        self.smaller[:] = np.repeat(np.concatenate((rises, [True])), lengths)
        self.lms = (np.flatnonzero(self.smaller[1:] & ~self.smaller[:-1]) + 1).astype(self.position)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Common prefixes of pairs of suffixes, up to the depth, character by character (four at once)."""
        a, b = a.astype(np.int64), b.astype(np.int64)
        found = np.zeros(len(a), np.int64)
        left = np.arange(len(a))
        for k in range(0, self.depth, _WIDE):
            x = self.loads[a[left] + k] ^ self.loads[b[left] + k]
            end = x != 0
            if end.any():
                y = x[end]
                same = sum((y & np.uint64((1 << 16 * j) - 1) == 0).astype(np.int64) for j in range(1, _WIDE))
                found[left[end]] = k + same
                left = left[~end]
            if not len(left):
                break
        found[left] = self.depth
        return np.minimum(np.minimum(found, self.depth), self.n - np.maximum(a, b)).astype(np.int16)


def _spread(text: Text, at: np.ndarray, shared: np.ndarray, into: Queues, least: np.ndarray, started: np.ndarray, larger: bool) -> None:
    """Push what the scanned tuples induce. ``least`` holds for each character the smallest common prefix scanned
    since its queue was last pushed to; that, plus one, is the common prefix of the new tuple with the one before it."""
    t, depth = text.t, text.depth
    own = t[at]
    previous = np.maximum(at - 1, 0)
    before = t[previous]
    takes = (at > 0) & ((before >= own) if larger else (before <= own))
    if not larger:
        takes &= text.smaller[previous]
    chosen = np.flatnonzero(takes)
    if not len(chosen):
        np.minimum(least, shared.min(), out=least)
        return
    chars = before[chosen]
    order = np.argsort(chars, kind="stable")
    chosen, chars = chosen[order], chars[order]
    first = np.concatenate(([True], chars[1:] != chars[:-1]))
    low = np.where(first, 0, np.concatenate(([0], chosen[:-1] + 1)))
    padded = np.concatenate((shared, [_FAR]))
    spans = np.empty(2 * len(chosen), np.int64)
    spans[::2], spans[1::2] = low, chosen + 1
    smallest = np.minimum.reduceat(padded, spans)[::2]
    heads = np.flatnonzero(first)
    tails = np.concatenate((heads[1:], [len(chosen)]))
    groups = chars[heads].astype(np.int64)
    smallest[heads] = np.minimum(smallest[heads], least[groups])
    new = np.minimum(smallest + 1, depth).astype(np.int16)
    new[heads[~started[groups]]] = 0
    started[groups] = True
    np.minimum(least, shared.min(), out=least)
    last = chosen[tails - 1]
    rest = np.empty(2 * len(last), np.int64)
    rest[::2], rest[1::2] = last + 1, len(padded) - 1
    ends = np.minimum.reduceat(padded, np.minimum(rest, len(padded) - 1))[::2]
    least[groups] = np.where(last + 1 < len(shared), ends, _FAR)
    induced = (at[chosen] - 1).astype(text.position)
    for g, i, j in zip(groups.tolist(), heads.tolist(), tails.tolist(), strict=True):
        into.push(g, induced[i:j], new[i:j])


def _seam(text: Text, a: int, b: int) -> np.int16:
    return text.common(np.array([a]), np.array([b]))[0]


def _induce(text: Text, lms: np.ndarray, shared: np.ndarray) -> tuple[Queues, Queues]:
    """L and S suffixes by character, from LMS suffixes that are in order by first character at least. The S ones
    come in descending order; a common prefix there is with the larger neighbour."""
    characters = text.characters
    starts = np.searchsorted(text.t[lms], np.arange(characters + 1))
    work, large, small = (Queues(characters, text.held) for _ in range(3))
    least, started = np.zeros(characters, np.int16), np.zeros(characters, bool)
    for c in range(characters):
        last = None
        while block := work.pop(c):
            large.push(c, *block)
            _spread(text, *block, work, least, started, True)
            last = int(block[0][-1])
        i, j = starts[c], starts[c + 1]
        if i < j:
            own = shared[i:j].copy()
            own[0] = 0 if last is None else _seam(text, last, int(lms[i]))
            _spread(text, lms[i:j], own, work, least, started, True)
    least, started = np.zeros(characters, np.int16), np.zeros(characters, bool)
    for c in range(characters - 1, -1, -1):
        last = None
        while block := work.pop(c):
            small.push(c, *block)
            _spread(text, *block, work, least, started, False)
            last = int(block[0][-1])
        at, own = large.all(c)
        if len(at):
            back = np.concatenate(([np.int16(0)], own[:0:-1])).astype(np.int16)
            back[0] = 0 if last is None else _seam(text, last, int(at[-1]))
            _spread(text, at[::-1], back, work, least, started, False)
    return large, small


def _names(text: Text, ordered: np.ndarray) -> np.ndarray:
    """The reduced string: for each LMS place the name of its substring, from the places in order of these."""
    lms = text.lms
    number = np.searchsorted(lms, ordered)
    length = np.diff(np.concatenate((lms, [text.n - 1]))).astype(np.int64) + 1
    own = np.minimum(length[number], text.depth)
    same = np.zeros(len(ordered), bool)
    for low in range(1, len(ordered), 1 << 20):  # what is compared at once
        i = np.arange(low, min(low + (1 << 20), len(ordered)))
        i = i[own[i] == own[i - 1]]
        same[i] = text.common(ordered[i - 1], ordered[i]) >= own[i]
    name = np.empty(len(lms), np.int64)
    name[number] = np.cumsum(~same) - 1
    return name


def _reduced(text: Text, ordered: np.ndarray) -> np.ndarray:
    """The LMS suffixes in order by ``depth`` characters. The reduced string is ordered by doubling: a name becomes the
    place of its first holder, and holders of one name are told apart by the names that follow."""
    name = _names(text, ordered)
    n = len(name)
    place = np.argsort(name, kind="stable")
    head = np.concatenate(([True], name[place[1:]] != name[place[:-1]]))
    rank = np.empty(n, np.int64)
    rank[place] = np.maximum.accumulate(np.where(head, np.arange(n), 0))
    covered = 1
    while covered < text.depth:
        single = head & np.concatenate((head[1:], [True]))
        open_ = np.flatnonzero(~single)  # places in the order whose holders still have equals
        if not len(open_):
            break
        who = place[open_]
        after = np.where(who + covered < n, rank[np.minimum(who + covered, n - 1)], -1)
        order = np.lexsort((after, rank[who]))
        who, after = who[order], after[order]
        own = rank[who]
        place[open_] = who  # groups stay where they are, as ranks are places
        new = np.concatenate(([True], (own[1:] != own[:-1]) | (after[1:] != after[:-1])))
        head[open_] = new
        rank[who] = open_[np.maximum.accumulate(np.where(new, np.arange(len(who)), 0))]
        covered *= 2
    return text.lms[place]


def suffixes(text: Text) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The suffixes in order, those of one first character at a time: positions, and the common prefix of each (cut at
    the depth) with the one before it; 0 for the first of a character."""
    if not len(text.lms):
        return
    by_first = text.lms[np.argsort(text.t[text.lms], kind="stable")]
    _, small = _induce(text, by_first, np.zeros(len(by_first), np.int16))
    is_lms = room(text.n, bool)
    is_lms[text.lms] = True
    found = []
    for c in range(text.characters):
        at = small.all(c)[0][::-1]
        small.forget(c)
        found.append(at[is_lms[at]])
    seen = np.concatenate(found)
    del small, is_lms, found
    ordered = seen if len(seen) == len(text.lms) else np.concatenate((np.setdiff1d(text.lms, seen), seen))
    lms = _reduced(text, ordered)
    del seen, ordered
    lms = lms[np.argsort(text.t[lms], kind="stable")]
    shared = np.zeros(len(lms), np.int16)
    for low in range(1, len(lms), 1 << 20):
        high = min(low + (1 << 20), len(lms))
        shared[low:high] = text.common(lms[low - 1 : high - 1], lms[low:high])
    large, small = _induce(text, lms, shared)
    for c in range(text.characters):
        low, own = large.all(c)
        high, other = small.all(c)
        large.forget(c)
        small.forget(c)
        high, forward = high[::-1], np.zeros(len(other), np.int16)
        if len(high):
            forward[1:] = other[:0:-1]
            forward[0] = _seam(text, int(low[-1]), int(high[0])) if len(low) else 0
        if len(low) + len(high):
            at, common = np.concatenate((low, high)), np.concatenate((own, forward))
            common[0] = 0
            yield at, common
