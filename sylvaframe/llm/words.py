"""A per-worker memory of encoded words, and the gathering of their ids with numpy."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import chain

import numpy as np

#: Words and ids that a memory holds before it forgets all and starts again.
MOST_WORDS, MOST_IDS = 600_000, 6_000_000


class Growing:
    """An array to which rows are appended."""

    def __init__(self, kind: type):
        self.data, self.n = np.empty(1 << 12, kind), 0

    def extend(self, values: np.ndarray) -> None:
        if self.n + len(values) > len(self.data):
            self.data = np.concatenate((self.data[: self.n], np.empty(max(self.n, len(values)) + 1, self.data.dtype)))
        self.data[self.n : self.n + len(values)] = values
        self.n += len(values)


class WordMemory:
    """Ids of words, each in one of `variants` forms; encode(words, variants) gives those that are missing as (ids of all, one after the other; number of ids of each)."""

    def __init__(self, encode: Callable[[list, list[int]], tuple[np.ndarray, np.ndarray]], variants: int = 1, most_words: int = MOST_WORDS, most_ids: int = MOST_IDS):
        self.encode, self.variants, self.most = encode, variants, (most_words, most_ids)
        self.forget()

    def forget(self) -> None:
        self.numbers: dict = {}
        self.names: list = []
        self.slot, self.start, self.size, self.flat = Growing(np.int32), Growing(np.int64), Growing(np.int32), Growing(np.int32)

    def look_up(self, words: list, variant: np.ndarray | None = None) -> np.ndarray:
        """The slot of each word in its variant. Slots hold until the next call."""
        if len(self.numbers) > self.most[0] or self.flat.n > self.most[1]:
            self.forget()
        numbers, names = self.numbers, self.names
        get = numbers.get
        at = np.array([get(w, -1) for w in words], np.int64)
        missing = np.flatnonzero(at < 0)
        if len(missing):
            lost = [words[k] for k in missing.tolist()]
            new = [w for w in dict.fromkeys(lost)]
            numbers.update(zip(new, range(len(names), len(names) + len(new))))
            names += new
            at[missing] = [numbers[w] for w in lost]
            self.slot.extend(np.full(len(new) * self.variants, -1, np.int32))
        if self.variants > 1:
            at = at * self.variants + variant
        slots = self.slot.data[at]
        todo = np.unique(at[slots < 0])
        for k in range(0, len(todo), 1 << 16):
            some = todo[k : k + (1 << 16)]
            flat, sizes = self.encode([names[j] for j in (some // self.variants).tolist()], (some % self.variants).tolist())
            self.slot.data[some] = self.start.n + np.arange(len(some))
            self.start.extend(self.flat.n + np.cumsum(sizes) - sizes)
            self.size.extend(sizes)
            self.flat.extend(flat)
        return self.slot.data[at] if len(todo) else slots

    def gather(self, slots: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all slots in order, number of ids of each slot)."""
        return gather(self.flat.data, self.start.data[slots], self.size.data[slots])


def flattened(found: list[list[int]]) -> tuple[np.ndarray, np.ndarray]:
    """What WordMemory expects, from a list of ids for each word."""
    sizes = np.fromiter(map(len, found), np.int64, len(found))
    return np.fromiter(chain.from_iterable(found), np.int32, int(sizes.sum())), sizes


def gather(flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs start..start+size of flat, one after the other, and their sizes."""
    size = size.astype(np.int64)
    ends = np.cumsum(size)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.arange(total) + np.repeat(start - (ends - size), size)], size


def slices(text: bytes, size: int = 1 << 20) -> Iterator[bytes]:
    """The text in pieces of about `size` bytes that begin and end at white space, which they lose nothing but; words stay whole."""
    at = 0
    while len(text) - at > size:
        cut = at + size
        while cut < len(text) and text[cut] not in b" \t\n\r\x0b\x0c":
            cut += 1
        yield text[at:cut]
        at = cut
    yield text[at:] if at else text
