"""Token counts of a score-ranked byte-pair vocabulary, by rank-synchronous merging of symbol arrays.

A batch's distinct pre-tokens lie one after the other in one array of symbols. Each step finds, for
every pre-token at once, the best-ranked pair it holds and merges all its occurrences, until no pair is
left; what remains are the tokens. A long pre-token is an array of its own in which symbols are linked, and
a step touches only the places where its best-ranked pair stands and their neighbours.
"""

from __future__ import annotations

import heapq
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StructField, StructType

from textguard.llm.base import small_batches

SPACE = "▁"
_NONE = np.int64(1) << np.int64(40)
#: Counts of so many distinct pre-tokens are remembered by a worker; then it starts anew.
MEMORY = 1_000_000
#: Symbols from which a pre-token is merged by itself: the steps of a batch are as many as its longest member needs.
LONG_RUN = 128


class PieceMerger:
    """Merges of a sentencepiece BPE model: which pairs join, into what, and which first."""

    def __init__(self, model_file: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=model_file)
        n = model.get_piece_size()
        special = [model.is_byte(i) or model.is_control(i) or model.is_unknown(i) for i in range(n)]
        self.ids = {model.id_to_piece(i): i for i in range(n) if not special[i]}
        self.size = n
        scores = np.array([model.get_score(i) for i in range(n)])
        rank_of = np.unique(-scores, return_inverse=True)[1].astype(np.int64)
        keys, into = [], []
        for piece, i in self.ids.items():
            for cut in range(1, len(piece)):
                a, b = self.ids.get(piece[:cut]), self.ids.get(piece[cut:])
                if a is not None and b is not None:
                    keys.append(a * n + b)
                    into.append(i)
        order = np.argsort(np.array(keys, np.int64))
        self.keys = np.array(keys, np.int64)[order]
        self.into = np.array(into, np.int64)[order]
        self.ranks = rank_of[self.into]
        # Where a piece can go on at once into a better-ranked one, its merges are made one by one.
        soonest = np.full(n, _NONE)
        for side in (self.keys // n, self.keys % n):
            np.minimum.at(soonest, side, self.ranks)
        self.one_by_one = np.zeros(int(rank_of.max()) + 1, bool)
        self.one_by_one[self.ranks[soonest[self.into] < self.ranks]] = True
        # Merges never reach over these, so texts can be cut there.
        self.breaks = "".join(c for c in "\n\t\r" if not any(c in p for p in self.ids))

    def _pairs(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged piece) of pairs of symbols; symbols below 0 join with nothing."""
        wanted = left * self.size + right
        at = np.minimum(np.searchsorted(self.keys, wanted), len(self.keys) - 1)
        known = (self.keys[at] == wanted) & (left >= 0) & (right >= 0)
        return np.where(known, self.ranks[at], _NONE), self.into[at]

    def count(self, words: list[str]) -> np.ndarray:
        """Tokens of each pre-token."""
        result = np.zeros(len(words), np.int64)
        lengths = np.array([len(w) for w in words], np.int64)
        joined = "".join(words)
        if not joined:
            return result
        chars, inverse = np.unique(np.frombuffer(joined.encode("utf-32-le"), "<u4"), return_inverse=True)
        # A character outside the vocabulary stays by itself and counts its UTF-8 bytes.
        piece = np.array([self.ids.get(chr(c), -1) for c in chars], np.int64)
        bytes_more = np.array([0 if p >= 0 else len(chr(c).encode()) - 1 for c, p in zip(chars, piece)], np.int64)
        owner = np.repeat(np.arange(len(words)), lengths)
        np.add.at(result, owner, bytes_more[inverse])
        symbols = piece[inverse]
        ends = np.cumsum(lengths)
        for word in np.flatnonzero(lengths > LONG_RUN):
            result[word] += LinkedRun(self, symbols[ends[word] - lengths[word] : ends[word]]).merged()
        short = lengths[owner] <= LONG_RUN
        symbols, owner = symbols[short], owner[short]
        rank, into = self._pair_arrays(symbols, owner)
        while len(symbols):
            starts = np.flatnonzero(np.diff(owner, prepend=-1))
            best = np.minimum.reduceat(rank, starts)
            sizes = np.diff(np.append(starts, len(symbols)))
            done = best == _NONE
            if done.any():
                result[owner[starts[done]]] += sizes[done]
                keep = np.repeat(~done, sizes)
                symbols, owner, rank, into = symbols[keep], owner[keep], rank[keep], into[keep]
                best, sizes = best[~done], sizes[~done]
                if not len(symbols):
                    break
            hit = rank == np.repeat(best, sizes)
            single = self.one_by_one[best]
            if single.any():
                begin = np.cumsum(sizes) - sizes
                before = np.cumsum(hit) - hit
                first = hit & (before == np.repeat(before[begin], sizes))
                hit = np.where(np.repeat(single, sizes), first, hit)
            # Of overlapping pairs the leftmost goes first, so every second one of a row of hits.
            numbers = np.arange(len(hit))
            row_start = np.maximum.accumulate(np.where(hit & ~np.append(False, hit[:-1]), numbers, 0))
            at = np.flatnonzero(hit & ((numbers - row_start) % 2 == 0))
            symbols[at] = into[at]
            keep = np.ones(len(symbols), bool)
            keep[at + 1] = False
            moved = np.cumsum(keep)[at] - 1
            symbols, owner, rank, into = symbols[keep], owner[keep], rank[keep], into[keep]
            touched = np.unique(np.concatenate([moved, moved[moved > 0] - 1]))
            inner = touched[touched + 1 < len(symbols)]
            rank[touched] = _NONE
            fresh, piece_in = self._pairs(symbols[inner], symbols[inner + 1])
            rank[inner] = np.where(owner[inner] == owner[inner + 1], fresh, _NONE)
            into[inner] = piece_in
        return result

    def _pair_arrays(self, symbols: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        rank, into = np.full(len(symbols), _NONE), np.zeros(len(symbols), np.int64)
        if len(symbols) > 1:
            found, into[:-1] = self._pairs(symbols[:-1], symbols[1:])
            rank[:-1] = np.where(owner[:-1] == owner[1:], found, _NONE)
        return rank, into


class LinkedRun:
    """The symbols of one long pre-token. Merged symbols stay where their left part was; the others drop out of the links.

    Places wait under the rank of the pair that begins there, and are looked at again only when that rank is the best one
    left: as arrays, or, for ranks that are merged one by one, in a heap from the left.
    """

    def __init__(self, merger: PieceMerger, symbols: np.ndarray):
        n = len(symbols)
        self.merger, self.symbols, self.left = merger, symbols.copy(), n
        # Place n is behind the end, and place -1 (the last of the array) before the beginning.
        self.next, self.before = np.append(np.arange(1, n + 1), [n, 0]), np.append(np.arange(-1, n), [0])
        self.symbols = np.append(self.symbols, [-1, -1])
        self.rank, self.into = np.full(n + 2, _NONE), np.zeros(n + 2, np.int64)
        self.arrays: dict[int, list[np.ndarray]] = {}
        self.heaps: dict[int, list[int]] = {}
        self.ranks: list[int] = []
        self._set(np.arange(n))

    def _set(self, places: np.ndarray) -> int:
        """Find the pairs that begin at some places (ascending), let these wait, and return the best rank among them."""
        rank, into = self.merger._pairs(self.symbols[places], self.symbols[self.next[places]])
        self.rank[places], self.into[places] = rank, into
        known = np.flatnonzero(rank != _NONE)
        if not len(known):
            return int(_NONE)
        order = known[np.argsort(rank[known], kind="stable")]
        rank, places = rank[order], places[order]
        begin = np.flatnonzero(np.append(True, rank[1:] != rank[:-1]))
        for r, part in zip(rank[begin].tolist(), np.split(places, begin[1:])):
            if self.merger.one_by_one[r]:
                waiting = self.heaps.get(r)
                if waiting:
                    for place in part.tolist():
                        heapq.heappush(waiting, place)
                else:
                    self.heaps[r] = part.tolist()
                    heapq.heappush(self.ranks, r)
            elif r in self.arrays:
                self.arrays[r].append(part)
            else:
                self.arrays[r] = [part]
                heapq.heappush(self.ranks, r)
        return int(rank[0])

    def _merge(self, at: np.ndarray) -> int:
        """Join the pairs at some places that do not overlap; the best rank of the pairs that arise."""
        gone = self.next[at]
        self.symbols[at] = self.into[at]
        behind = self.next[gone]
        self.next[at] = behind
        self.before[behind] = at
        self.rank[gone] = _NONE
        self.left -= len(at)
        around = self.before[at]
        return self._set(np.unique(np.concatenate([at, around[around >= 0]])))

    def _leftmost(self, places: np.ndarray) -> np.ndarray:
        """Of pairs that overlap in a row, every second one from the left."""
        numbers = np.arange(len(places))
        follows = np.append(False, self.next[places[:-1]] == places[1:])
        row_start = np.maximum.accumulate(np.where(follows, 0, numbers))
        return places[(numbers - row_start) % 2 == 0]

    def merged(self) -> int:
        """Merge until no pair is left; the number of symbols that remain."""
        while self.ranks:
            best = heapq.heappop(self.ranks)
            if self.merger.one_by_one[best]:
                waiting = self.heaps[best]
                while waiting:
                    place = heapq.heappop(waiting)
                    # A pair that arises and is better ranked goes first; the rest waits on.
                    if self.rank[place] == best and self._merge(np.array([place])) < best:
                        break
                if waiting:
                    heapq.heappush(self.ranks, best)
            else:
                parts = self.arrays.pop(best)
                places = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
                places = places[self.rank[places] == best]
                if len(places):
                    self._merge(self._leftmost(places))
        return self.left


class TokenCounter:
    """Counts tokens of whole texts; pre-tokens met before are looked up."""

    def __init__(self, model_file: str):
        self.merger = PieceMerger(model_file)
        other = re.escape(self.merger.breaks)
        parts = f"{SPACE}+[^{SPACE}{other}]*|[^{SPACE}{other}]+"
        self.cut = re.compile(parts + (f"|[{other}]+" if other else "")).findall
        self.known: dict[str, int] = {}

    def counts(self, texts: list[str]) -> list[int]:
        cut = [self.cut(SPACE + t.replace(" ", SPACE)) if t else [] for t in texts]
        missing = list(set().union(*cut) - self.known.keys())
        if len(self.known) + len(missing) > MEMORY:
            self.known.clear()
            missing = list(set().union(*cut))
        self.known.update(zip(missing, self.merger.count(missing).tolist()))
        return [sum(map(self.known.__getitem__, c)) for c in cut]


_counters: dict[str, TokenCounter] = {}


def count_tokens(
    docs: DataFrame,
    model_file: str,
    limit: int = 4096,
    id_col: str = "doc_id",
    text_col: str = "text",
) -> DataFrame:
    """Per row: id, ``n_bytes`` (UTF-8), ``n_tokens``, ``over_limit`` (more than ``limit`` tokens).

    ``model_file`` names a sentencepiece BPE model that is present on every worker. Begin and end tokens
    are not counted; their strings inside a text are ordinary text; characters outside the vocabulary
    count one token a byte. Null and empty texts have no bytes and no tokens. Rows are independent:
    repeated rows repeat the result, null ids stay null, an empty table gives no rows, further columns are
    not read. A text of any length is counted whole; a single pre-token is held as an array, and takes
    time in proportion to its length, but for a logarithm.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = _counters.get(model_file) or _counters.setdefault(model_file, TokenCounter(model_file))
        for b in batches:
            texts = b.column(1).fill_null("")
            counts = counter.counts(texts.to_pylist())
            sizes = pa.compute.binary_length(texts.cast(pa.binary())).cast(pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), sizes, pa.array(counts, pa.int64())], [id_col, "n_bytes", "n_tokens"])

    small_batches(docs.sparkSession)
    narrow = docs.select(F.col(id_col), F.col(text_col))
    schema = StructType([narrow.schema[0], StructField("n_bytes", LongType()), StructField("n_tokens", LongType())])
    return narrow.mapInArrow(run, schema).withColumn("over_limit", F.col("n_tokens") > limit)


