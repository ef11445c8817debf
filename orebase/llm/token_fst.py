"""Exact byte-pair token counts with deterministic transducers, compiled once from the vocabulary.

The first machine splits text into pre-tokens: eight states over character classes that already carry
the little lookahead the split needs. Its transitions emit whether a pre-token starts. A run of
texts is cut into chunks; each chunk's map (the state it leads to from every state, and the number of
pre-tokens emitted on the way) is computed for all chunks side by side, and the maps are composed by a parallel
prefix scan, so that each chunk knows its first state and the number of its first pre-token. A second pass over all chunks
then writes the boundaries.

The second machine reads the bytes of pre-tokens; each transition emits the change in the number of
tokens. A state is the longest suffix that some token starts with, and for each place in it the
last token of the encoding up to there: a token may follow another exactly if no merge across
their border comes first, so that window decides every later step. The driver compiles it by running the whole
vocabulary through it and broadcasts the transitions; a pair of state and byte that no token has is added by the task that
meets it. All pre-tokens of a step go through the machine together, a byte at a time; they begin in the same
state, so their maps are constants and their counts compose by a prefix sum.
"""

from __future__ import annotations

import json
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import Carried, steps, string_column

STATES, SYMBOLS, FIRST = 8, 16, 8
FRESH, IN_LETTERS, IN_NUMBERS, IN_OTHER, IN_SPACE, LEADING, ONE_MORE, TWO_MORE = range(STATES)
LETTER, NUMBER, OTHER, LAST_SPACE, LAST_BLANK, INNER_BLANK, SHORT_CLITIC, LONG_CLITIC = range(8)
CHUNK = 256
#: States that a worker adds to the compiled ones before it starts anew from them.
MORE_STATES = 350_000
#: Pre-tokens that are still being read together; the last few are read one by one.
FEW = 16
#: Room for the change in tokens beside the next state.
HALF, SHIFT = 1 << 15, 16
#: Text bytes per numpy step.
STEP = 8 << 20


def _machine() -> tuple[np.ndarray, np.ndarray]:
    """(next state, whether the character starts a pre-token) by state and symbol."""
    goes = np.zeros((STATES, SYMBOLS), np.uint8)
    cuts = np.ones((STATES, SYMBOLS), bool)
    runs = {LETTER: IN_LETTERS, NUMBER: IN_NUMBERS, OTHER: IN_OTHER, LAST_SPACE: LEADING, LAST_BLANK: FRESH, INNER_BLANK: IN_SPACE, SHORT_CLITIC: ONE_MORE, LONG_CLITIC: TWO_MORE}
    for symbol, state in runs.items():
        goes[:, symbol] = state
    for state, symbol in ((IN_LETTERS, LETTER), (IN_NUMBERS, NUMBER), (IN_OTHER, OTHER), (IN_SPACE, INNER_BLANK), (LEADING, LETTER), (LEADING, NUMBER), (LEADING, OTHER)):
        cuts[state, symbol] = False
    for symbol in (SHORT_CLITIC, LONG_CLITIC):  # an apostrophe inside a run of signs, or after a space, is a sign
        goes[[IN_OTHER, LEADING], symbol] = IN_OTHER
        cuts[[IN_OTHER, LEADING], symbol] = False
    goes[TWO_MORE, LETTER], goes[ONE_MORE, LETTER] = ONE_MORE, FRESH
    cuts[[TWO_MORE, ONE_MORE], LETTER] = False
    goes[:, FIRST:], cuts[:, FIRST:] = goes[FRESH, :FIRST], True  # the first character of a text
    return goes, cuts


GOES, CUTS = _machine()


@lru_cache(1)
def _classes() -> np.ndarray:
    """LETTER, NUMBER, OTHER, or INNER_BLANK for white space, by code point."""
    out = np.full(0x110000, OTHER, np.uint8)
    points = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (INNER_BLANK, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, points):
            a, b = ord(points[m.start()]), ord(points[m.end() - 1])
            out[a : b + 1] = kind if b < 0xD800 or a >= 0xE000 else out[a : b + 1]
    return out


def symbols(points: np.ndarray, first: np.ndarray) -> np.ndarray:
    """The machine's input for code points; first marks where texts begin."""
    kind = _classes()[points]
    n = len(points)
    ends = np.ones(n, bool)
    ends[:-1] = first[1:]
    blank = kind == INNER_BLANK
    last = blank & ~ends
    last[:-1] &= ~blank[1:]
    kind[last] = np.where(points[last] == 0x20, LAST_SPACE, LAST_BLANK)
    at = np.flatnonzero(points == 0x27)
    for i in at[~ends[at]]:
        x = points[i + 1]
        if x in (0x73, 0x74, 0x6D, 0x64):  # s t m d
            kind[i] = SHORT_CLITIC
        elif not ends[i + 1] and (x, points[i + 2]) in ((0x72, 0x65), (0x76, 0x65), (0x6C, 0x6C)):  # re ve ll
            kind[i] = LONG_CLITIC
    return kind + FIRST * first.astype(np.uint8)


def composed(ends: np.ndarray, emitted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Maps of all chunks up to each one, by a parallel prefix scan; rows are chunks, columns their first states."""
    step = 1
    while step < len(ends):
        middle = ends[:-step].astype(np.intp)  # where the chunks before lead
        later = np.take_along_axis(emitted[step:], middle, 1)
        emitted[step:] = emitted[:-step] + later
        ends[step:] = np.take_along_axis(ends[step:], middle, 1)
        step *= 2
    return ends, emitted


def starts(symbol: np.ndarray) -> np.ndarray:
    """Indices of the characters that start a pre-token."""
    n = len(symbol)
    rows = -(-n // CHUNK)
    grid = np.full(rows * CHUNK, OTHER, np.uint8)
    grid[:n] = symbol
    grid = np.ascontiguousarray(grid.reshape(rows, CHUNK).T)
    goes, cuts = GOES.ravel(), CUTS.ravel().astype(np.uint16)
    ends = np.tile(np.arange(STATES, dtype=np.uint8)[:, None], (1, rows))
    emitted = np.zeros((STATES, rows), np.uint16)
    for column in grid:
        here = (ends << 4) | column
        emitted += cuts.take(here)
        ends = goes.take(here)
    ends, emitted = composed(np.ascontiguousarray(ends.T), emitted.T.astype(np.int64))
    state, number = np.zeros(rows, np.uint8), np.zeros(rows, np.int64)
    state[1:], number[1:] = ends[:-1, FRESH], emitted[:-1, FRESH]
    # Filled-up places of the last chunk may emit too: they come last and are cut off.
    out, base, cuts = np.zeros(emitted[-1, FRESH] + 1, np.int64), np.arange(rows) * CHUNK, CUTS.ravel()
    for j, column in enumerate(grid):
        here = (state << 4) | column
        starting = np.flatnonzero(cuts.take(here))
        out[number[starting]] = base[starting] + j
        number[starting] += 1
        state = goes.take(here)
    return out[: np.searchsorted(out[:-1], n)]


class PieceCounter:
    """The transducer from the bytes of a pre-token to its number of tokens."""

    def __init__(self, vocabulary: str):
        model = json.loads(vocabulary)["model"]
        # The vocabulary writes bytes as printable characters: those that are printable as themselves, the others from U+0100 on.
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        byte_of = {chr(b): b for b in shown} | {chr(0x100 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)}
        ids = {bytes(byte_of[c] for c in word): i for word, i in model["vocab"].items() if all(c in byte_of for c in word)}
        raw = {word: bytes(byte_of[c] for c in word) for word in model["vocab"] if all(c in byte_of for c in word)}
        self.parts, self.merged, made = {}, {}, set()
        for rank, merge in enumerate(model["merges"]):
            left, right = (raw[x] for x in (merge if isinstance(merge, list) else merge.split(" ")))
            self.parts[ids[left + right]] = (ids[left], ids[right], rank)
            self.merged[ids[left], ids[right]] = rank
            made.add(left + right)
        self.ids = {word: i for word, i in ids.items() if len(word) == 1 or word in made}
        self.prefixes = {word[:n] for word in self.ids for n in range(1, len(word) + 1)}
        if max(map(len, self.ids)) >= HALF:
            raise ValueError(f"tokens of {HALF} bytes or more don't fit into a transition")
        self.fits: dict[tuple[int, int], bool] = {}
        begin = (b"", (-1,), (0,))
        self.windows, self.numbers, self.moves = [begin], {begin: 0}, {}
        for word in self.ids:
            self._walk(word, 0)
        self.compiled = len(self.windows)
        self.base = self.moves
        self._reset()

    def _reset(self) -> None:
        for window in self.windows[self.compiled :]:
            del self.numbers[window]
        del self.windows[self.compiled :]
        self.moves = dict(self.base)
        self._tabulate()

    def _tabulate(self) -> None:
        """The transitions as sorted arrays."""
        keys = np.fromiter(self.moves.keys(), np.int64, len(self.moves))
        order = np.argsort(keys)
        self.keys, self.targets = keys[order], np.fromiter(self.moves.values(), np.int64, len(self.moves))[order]

    def __getstate__(self) -> dict:
        return {k: v for k, v in self.__dict__.items() if k not in ("moves", "keys", "targets")}

    def __setstate__(self, state: dict) -> None:
        self.__dict__.update(state)
        self._reset()

    def _may_follow(self, one: int, two: int) -> bool:
        """No merge over the border of two tokens comes before those that make them."""
        known = self.fits.get((one, two))
        if known is None:
            # Undo the merges of both sides, latest first; a border merge that ranks before the last undone one would have come first.
            a, b, limit = one, two, 1 << 60
            while True:
                rank = self.merged.get((a, b))
                if rank is not None and rank < limit:
                    known = False
                    break
                left, right = self.parts.get(a), self.parts.get(b)
                if left is None and right is None:
                    known = True
                    break
                if right is None or left is not None and left[2] > right[2]:
                    limit, a = left[2], left[1]
                else:  # where both sides merge at the same rank, the border on the left is met first
                    limit, b = right[2] + 1, right[0]
            if len(self.fits) > 500_000:
                self.fits.clear()
            self.fits[one, two] = known
        return known

    def _move(self, state: int, byte: int) -> int:
        """Adds the transition; returns the next state << SHIFT | change in tokens + HALF."""
        suffix, lasts, counts = self.windows[state]
        suffix += bytes((byte,))
        drop = 0
        while suffix[drop:] not in self.prefixes:
            drop += 1
        suffix, lasts, counts = suffix[drop:], lasts[drop:], counts[drop:]
        for i, last in enumerate(lasts):
            token = self.ids.get(suffix[i:])
            if token is not None and (last < 0 or self._may_follow(last, token)):
                break
        change = counts[i] + 1
        window = (suffix, (*lasts, token), (*[c - change for c in counts], 0))
        number = self.numbers.get(window)
        if number is None:
            number = self.numbers[window] = len(self.windows)
            self.windows.append(window)
        move = self.moves[state << 8 | byte] = number << SHIFT | change + HALF
        return move

    def _walk(self, piece: bytes, state: int) -> int:
        """Tokens that reading piece from a state adds."""
        n, moves = 0, self.moves
        for byte in piece:
            move = moves.get(state << 8 | byte)
            if move is None:
                move = self._move(state, byte)
            n += (move & (2 * HALF - 1)) - HALF
            state = move >> SHIFT
        return n

    def _next(self, key: np.ndarray) -> np.ndarray:
        """The transitions of keys state << 8 | byte."""
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        missing = np.flatnonzero(self.keys[at] != key)
        if len(missing):
            new = np.unique(key[missing])
            move = np.array([self._move(k >> 8, k & 255) for k in new.tolist()], np.int64)
            place = np.searchsorted(self.keys, new)
            self.keys, self.targets = np.insert(self.keys, place, new), np.insert(self.targets, place, move)
            at = np.searchsorted(self.keys, key)
        return self.targets[at]

    def count(self, pieces: pa.Array) -> np.ndarray:
        """Tokens of each pre-token of a large_binary array."""
        if len(self.windows) > self.compiled + MORE_STATES:
            self._reset()
        ends = np.frombuffer(pieces.buffers()[1], np.int64)[pieces.offset : pieces.offset + len(pieces) + 1]
        data = np.frombuffer(pieces.buffers()[2], np.uint8)
        order = np.argsort(ends[:-1] - ends[1:], kind="stable")  # longest first
        first, size = ends[:-1][order], np.diff(ends)[order]
        state, tokens = np.zeros(len(order), np.int64), np.zeros(len(order), np.int64)
        reading, j = int((size > 0).sum()), 0
        while reading > FEW:
            move = self._next(state[:reading] << 8 | data[first[:reading] + j])
            tokens[:reading] += (move & (2 * HALF - 1)) - HALF
            state[:reading] = move >> SHIFT
            j += 1
            reading = int(np.searchsorted(-size, -j, side="left"))
        known = len(self.moves)
        for i in range(reading):
            tokens[i] += self._walk(data[first[i] + j : first[i] + size[i]].tobytes(), int(state[i]))
        if len(self.moves) > known:
            self._tabulate()
        out = np.empty(len(order), np.int64)
        out[order] = tokens
        return out


def compiled(path: str) -> PieceCounter:
    """The count transducer of a byte-level BPE file."""
    return PieceCounter(Path(path).read_text(encoding="utf-8"))


def count_texts(texts: list[str], machine: PieceCounter) -> np.ndarray:
    """Tokens of each text."""
    encoded = [t.encode() for t in texts]
    sizes = np.array([len(t) for t in texts])
    if not sizes.sum():
        return np.zeros(len(texts), np.int64)
    points = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    first = np.zeros(len(points), bool)
    begins = np.cumsum(sizes) - sizes
    first[begins[sizes > 0]] = True
    cut = starts(symbols(points, first))
    ends = np.concatenate([[0], np.cumsum(1 + (points >= 0x80) + (points >= 0x800) + (points >= 0x10000), dtype=np.int64)])
    data = b"".join(encoded)
    pieces = pa.LargeBinaryArray.from_buffers(pa.large_binary(), len(cut), [None, pa.py_buffer(np.append(ends[cut], len(data))), pa.py_buffer(data)]).dictionary_encode()
    counts = machine.count(pieces.dictionary)[pieces.indices.to_numpy()]
    total = np.concatenate([[0], np.cumsum(counts)])
    return total[np.searchsorted(cut, begins + sizes)] - total[np.searchsorted(cut, begins)]


def token_counts(docs: DataFrame, tokenizer: str, special: tuple[str, ...] = ("<|endoftext|>",), text_col: str = "text") -> DataFrame:
    """The rows of docs with n_bytes and n_tokens of the whole text.

    tokenizer is the path of a byte-level BPE file, which the driver compiles. Strings in
    `special` count one token each. A null text counts as an empty one: 0 bytes and 0 tokens. Repeated rows are
    counted each; extra columns pass through, but for those named like a result, which are replaced; an empty
    table gives an empty result. A vocabulary with tokens too long for the transitions raises ValueError.
    """

    import pandas as pd

    split = regex.compile("|".join(map(regex.escape, special))) if special else None
    box = docs.sparkSession.sparkContext.broadcast(compiled(tokenizer))  # as large as the vocabulary makes it

    def run(batches):
        for column in batches:
            texts, out = string_column(pa.array(column, pa.large_string(), from_pandas=True)), []
            for a, b in steps(texts, STEP):
                part = texts.slice(a, b - a).to_pylist()
                units, of, extra = [], [], np.zeros(b - a, np.int64)
                for i, t in enumerate(part):
                    found = split.split(t) if split and any(s in t for s in special) else [t]
                    extra[i] = len(found) - 1
                    units += found
                    of += [i] * len(found)
                out.append(np.bincount(of, count_texts(units, box.value), b - a).astype(np.int64) + extra)
            yield pd.Series(np.concatenate(out) if out else np.zeros(0, np.int64))

    count = F.pandas_udf(run, "bigint", F.PandasUDFType.SCALAR_ITER)
    held = Carried(docs, "n_bytes", "n_tokens")
    text = held.col(text_col)
    return held.rows.select(*held.back, F.octet_length(F.coalesce(text, F.lit(""))).cast("bigint").alias("n_bytes"), count(text).alias("n_tokens"))
