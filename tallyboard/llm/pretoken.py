"""Cuts texts into pre-tokens by scanning codepoint classes, without a pattern matcher.

Each codepoint becomes a symbol of a small automaton. A symbol is a function from states
to states; composing functions is associative, so the states before every codepoint come
from a scan over compositions: blocks are scanned side by side, then the blocks' totals,
then the two are combined. A pre-token begins where the automaton says so.
"""

from __future__ import annotations

import itertools
import unicodedata
from functools import lru_cache

import numpy as np

from tallyboard.llm.shared import powers, splitmix

# Symbols. "Last" white space is followed by a character of the same text that is not white.
LETTER, NUMBER, OTHER, SHORT, LONG, LAST_SPACE, LAST_WHITE, WHITE, RESET = range(9)
# States: what the codepoint before belonged to.
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, LEAD, IN_WHITE, ONE_LEFT, TWO_LEFT = range(8)
STATES = 8

#: White space of the splitting pattern, as codepoints.
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
#: Endings that stand as tokens of their own after an apostrophe.
ENDINGS = ["s", "t", "re", "ve", "m", "ll", "d"]


def step(state: int, symbol: int) -> tuple[int, bool]:
    """The state after ``symbol`` and whether a pre-token begins with it."""
    if symbol == RESET:
        return FRESH, False
    if state == TWO_LEFT:
        return ONE_LEFT, False
    if state == ONE_LEFT:
        return FRESH, False
    if symbol == LAST_SPACE:
        return LEAD, True
    if symbol == LAST_WHITE:
        return IN_WHITE, True
    if symbol == WHITE:
        return IN_WHITE, state != IN_WHITE
    if symbol in (SHORT, LONG):
        if state in (IN_OTHER, LEAD):
            return IN_OTHER, False
        return (ONE_LEFT if symbol == SHORT else TWO_LEFT), True
    own = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER}[symbol]
    return own, state not in (own, LEAD)


@lru_cache(maxsize=1)
def tables():
    """(codepoint classes, symbol functions, composition, application, begins).

    The functions reachable from the symbols by composition are numbered; function 0
    changes nothing.
    """
    classes = np.full(0x110000, OTHER, np.uint8)
    for at in range(0x110000):
        kind = unicodedata.category(chr(at))[0]
        if kind == "L":
            classes[at] = LETTER
        elif kind == "N":
            classes[at] = NUMBER
    classes[WHITE_SPACE] = WHITE
    symbol_maps = [tuple(step(s, y)[0] for s in range(STATES)) for y in range(9)]
    maps = list(dict.fromkeys([tuple(range(STATES)), *symbol_maps]))
    number = {m: i for i, m in enumerate(maps)}
    for m in maps:  # grows while it is read, until no symbol gives a new function
        for own in symbol_maps:
            both = tuple(own[s] for s in m)
            if both not in number:
                number[both] = len(maps)
                maps.append(both)
    size = len(maps)
    of_symbol = np.array([number[m] for m in symbol_maps], np.uint16)
    compose = np.array([[number[tuple(b[s] for s in a)] for b in maps] for a in maps], np.uint16)
    apply = np.array(maps, np.uint8)
    begins = np.array([[step(s, y)[1] for y in range(9)] for s in range(STATES)])
    return classes, of_symbol, compose.reshape(-1), apply.reshape(-1), begins.reshape(-1), size


def scan(functions: np.ndarray, compose: np.ndarray, size: int) -> np.ndarray:
    """All prefixes of the composition of ``functions``, in order."""
    n = len(functions)
    if n <= 64:
        out = functions.copy()
        for i in range(1, n):
            out[i] = compose[int(out[i - 1]) * size + int(functions[i])]
        return out
    rows = 128 if n > 16384 else 16
    columns = -(-n // rows)
    grid = np.zeros(columns * rows, np.uint16)
    grid[:n] = functions
    grid = np.ascontiguousarray(grid.reshape(columns, rows).T)
    wide = np.zeros(columns, np.intp)
    for r in range(rows):
        wide = compose[wide * size + grid[r]]
        grid[r] = wide
        wide = wide.astype(np.intp)
    before = np.zeros(columns, np.intp)
    before[1:] = scan(grid[-1], compose, size)[:-1]
    before *= size
    for r in range(rows):
        grid[r] = compose[before + grid[r]]
    return np.ascontiguousarray(grid.T).reshape(-1)[:n]


def boundaries(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray]:
    """(joined, cuts, first): pre-token j of text i is ``joined[cuts[j]:cuts[j + 1]]``
    for ``first[i] <= j < first[i + 1] - 1``; the last cut of a text is its end.
    """
    joined, _, cuts, first = _boundaries(texts)
    return joined, cuts, first


def _boundaries(texts: list[str]) -> tuple[str, np.ndarray, np.ndarray, np.ndarray]:
    """The same with the codepoints of ``joined``."""
    classes, of_symbol, compose, apply, begins, size = tables()
    joined = "\n".join(texts) + "\n"
    points = np.frombuffer(joined.encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts)) + 1
    stops = np.cumsum(lengths) - 1
    symbols = classes[points]
    white = symbols == WHITE
    white[stops] = True
    last = white.copy()
    last[:-1] &= ~white[1:]
    last[stops] = False
    symbols[last & (points == 32)] = LAST_SPACE
    symbols[last & (points != 32)] = LAST_WHITE
    for mark in np.flatnonzero(points == 39):
        # The separator after a text is no letter, so this never looks into the next text.
        after = joined[mark + 1 : mark + 3]
        if after[:1] in ENDINGS:
            symbols[mark] = SHORT
        elif after in ENDINGS:
            symbols[mark] = LONG
    symbols[stops] = RESET
    reached = apply[scan(of_symbol[symbols], compose, size).astype(np.intp) * STATES + FRESH]
    before = np.zeros(len(symbols), np.intp)
    before[1:] = reached[:-1]
    cut = begins[before * 9 + symbols]
    cut[stops] = True  # the end of a text
    cuts = np.flatnonzero(cut)
    first = np.zeros(len(texts) + 1, np.int64)
    first[1:] = np.searchsorted(cuts, stops, "right")
    return joined, points, cuts, first


def hashes_of(points: np.ndarray, starts: np.ndarray, stops: np.ndarray) -> np.ndarray:
    """64-bit hashes, never 0, of the runs of codepoints from each start to its stop.

    Runs follow each other without gaps.
    """
    if not len(starts):
        return np.zeros(0, np.uint64)
    sizes = stops - starts
    place = np.arange(int(stops[-1] - starts[0])) - np.repeat(starts - starts[0], sizes)
    with np.errstate(over="ignore"):
        parts = mixed()[points[starts[0] : stops[-1]]] * powers(int(sizes.max()))[place]
        return splitmix(np.add.reduceat(parts, starts - starts[0]) + sizes.astype(np.uint64)) | np.uint64(1)


@lru_cache(maxsize=1)
def mixed() -> np.ndarray:
    """A 64-bit number for each codepoint."""
    with np.errstate(over="ignore"):
        return splitmix(np.arange(1, 0x110001, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15))


class Pieces:
    """Ids of pre-tokens, each distinct one encoded once while it stays in the cache.

    ``encode(list of pre-tokens)`` gives a list of id lists. Pre-tokens are known by 64-bit
    hashes in an open table; only those that are new are cut out of their text. At ``limit``
    pre-tokens the cache starts anew, which bounds its memory and changes no result.
    """

    def __init__(self, encode, limit: int = 400_000):
        self.encode, self.limit = encode, limit
        self._clear(limit)

    def _clear(self, room: int):
        size = 1 << int(max(room, self.limit) * 2).bit_length()
        self.keys, self.slots = np.zeros(size, np.uint64), np.zeros(size, np.int32)
        self.mask = np.uint64(size - 1)
        self.ids = np.zeros(0, np.int32)
        self.starts = np.zeros(0, np.int64)
        self.sizes = np.zeros(0, np.int64)

    def _find(self, hashes: np.ndarray) -> np.ndarray:
        """The slot of each hash, -1 where it is not held."""
        out = np.full(len(hashes), -1, np.int64)
        todo, at = np.arange(len(hashes)), hashes & self.mask
        while len(todo):
            held = self.keys[at]
            same = held == hashes[todo]
            out[todo[same]] = self.slots[at[same]]
            further = ~same & (held != 0)
            todo, at = todo[further], (at[further] + np.uint64(1)) & self.mask
        return out

    def _add(self, hashes: np.ndarray, slots: np.ndarray) -> None:
        at = hashes & self.mask
        while len(hashes):
            free = self.keys[at] == 0
            _, one = np.unique(at[free], return_index=True)
            chosen = np.flatnonzero(free)[one]  # one hash for each free place
            self.keys[at[chosen]], self.slots[at[chosen]] = hashes[chosen], slots[chosen]
            left = np.ones(len(hashes), bool)
            left[chosen] = False
            hashes, slots, at = hashes[left], slots[left], (at[left] + np.uint64(1)) & self.mask

    def lookup(self, hashes: np.ndarray, piece) -> tuple[np.ndarray, np.ndarray]:
        """(ids of all pieces in a row, number of ids of each piece); ``piece(i)`` is the i-th."""
        slots = self._find(hashes)
        new = np.flatnonzero(slots < 0)
        if len(new):
            fresh, first = np.unique(hashes[new], return_index=True)
            if len(self.sizes) and len(self.sizes) + len(fresh) > self.limit:
                self._clear(len(np.unique(hashes)))
                return self.lookup(hashes, piece)
            if len(fresh) > self.limit:
                self._clear(len(fresh))
            found = self.encode([piece(i) for i in new[first].tolist()])
            sizes = np.fromiter(map(len, found), np.int64, len(found))
            ids = np.fromiter(itertools.chain.from_iterable(found), np.int32, int(sizes.sum()))
            known = len(self.sizes)
            self._add(fresh, np.arange(known, known + len(fresh), dtype=np.int32))
            self.starts = np.concatenate([self.starts, len(self.ids) + np.cumsum(sizes) - sizes])
            self.ids = np.concatenate([self.ids, ids])
            self.sizes = np.concatenate([self.sizes, sizes])
            slots[new] = self._find(hashes[new])
        sizes = self.sizes[slots]
        return self.ids[spread(self.starts[slots], sizes)], sizes


def spread(starts: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... (sizes[0] of them), then the same for 1, 2, ..."""
    total = int(sizes.sum())
    shift = starts - (np.cumsum(sizes) - sizes)
    return np.repeat(shift, sizes) + np.arange(total)


def encode_texts(texts: list[str], pieces: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all texts in a row, where each text's ids begin and, last, where all end)."""
    joined, points, cuts, first = _boundaries(texts)
    starts, stops = cuts[:-1], cuts[1:]
    # From the end of one text to the start of the next there is the separator: no token.
    real = np.ones(len(starts), bool)
    real[first[1:-1] - 1] = False
    own = np.flatnonzero(real)
    ids, found = pieces.lookup(hashes_of(points, starts, stops)[own], lambda i: joined[starts[own[i]] : stops[own[i]]])
    sizes = np.zeros(len(starts), np.int64)
    sizes[own] = found
    ends = np.concatenate([[0], np.cumsum(sizes)])
    bounds = ends[np.minimum(first, len(starts))]
    return ids, bounds
