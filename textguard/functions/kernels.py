"""Numpy kernels that run on Arrow batches inside tasks."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa

try:
    from _md5 import md5  # Python's own: the other takes twice as long to set up for a short text
except ImportError:
    from hashlib import md5

PAIR_CHUNK = 1 << 16
# Hashes of pairs that are compared at once, and pairs that candidates are looked up for at once, about.
PAIR_VALUES = 1 << 21
CANDIDATE_CHUNK = 1 << 21
VECTOR_CHUNK = 1 << 10
# Marks of the shingles that some test sets of a cell hold, at once.
CELL_MARKS = 1 << 25
# Bits of a filter that are merged as one row: their places fit two bytes.
SLICE_BITS = 16
# Letters whose runs are hashed at once, about.
LETTER_CHUNK = 1 << 16
# Values per pass of the permutations: small enough for the processor cache.
VALUE_CHUNK = 1 << 15
# Bits dropped from a 64-bit minimum, so that a signature slot fits INT.
SLOT_SHIFT = 33


def permute_minimum(values: np.ndarray, starts: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Per set (slices of ``values`` beginning at ``starts``) the minimum of every permutation
    a * x + b modulo 2^64, cut to its upper 31 bits."""
    values = values.astype(np.uint64)
    out = np.empty((len(starts), len(a)), dtype=np.uint64)
    ends = np.append(starts[1:], len(values))
    row = 0
    while row < len(starts):
        stop = max(row + 1, int(np.searchsorted(ends, starts[row] + VALUE_CHUNK, "right")))
        part = values[starts[row] : ends[stop - 1]]
        offsets = starts[row:stop] - starts[row]
        work = np.empty_like(part)
        for i in range(len(a)):
            np.multiply(part, a[i], out=work)
            np.add(work, b[i], out=work)
            out[row:stop, i] = np.minimum.reduceat(work, offsets)
        row = stop
    return (out >> np.uint64(SLOT_SHIFT)).astype(np.int32)


def list_parts(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Flat values and row offsets of an Arrow list column."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    offsets = column.offsets.to_numpy()
    values = column.values.to_numpy(zero_copy_only=False)
    return values[offsets[0] : offsets[-1]], offsets - offsets[0]


def run_hashes(joined: pa.Array, k: int) -> pa.Array:
    """Per text of space-joined words the sorted distinct 60-bit hashes of its runs of ``k`` words (of all, if there are
    fewer): the upper bits of their MD5. Null stays null."""
    values, ends, nulls = [], [0], []
    for text in joined.cast(pa.binary()).to_pylist():
        nulls.append(text is None)
        if text is None:
            ends.append(ends[-1])
            continue
        blanks = np.flatnonzero(np.frombuffer(text, np.uint8) == 32).tolist()
        starts = [0, *(at + 1 for at in blanks[: max(0, len(blanks) + 1 - k)])]
        stops = [*blanks, len(text)][k - 1 :] or [len(text)]
        digests = b"".join([md5(text[a:e]).digest() for a, e in zip(starts, stops)])
        values.append(np.unique(np.frombuffer(digests, ">u8")[::2] >> 4).astype(np.int64))
        ends.append(ends[-1] + len(values[-1]))
    flat = np.concatenate(values) if values else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat), mask=pa.array(nulls, pa.bool_()))


def signature_batch(hashes: pa.Array, a: np.ndarray, b: np.ndarray) -> pa.Array:
    values, offsets = list_parts(hashes)
    rows = len(offsets) - 1
    if rows == 0:
        return pa.array([], type=pa.list_(pa.int32()))
    matrix = permute_minimum(values, offsets[:-1], a, b)
    ends = np.arange(rows + 1, dtype=np.int32) * len(a)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(matrix.reshape(-1)))


def band_keys(signatures: np.ndarray, bands: int, rows: int) -> np.ndarray:
    """One 64-bit key per signature and band."""
    keys = np.zeros((len(signatures), bands), dtype=np.uint64)
    cut = signatures[:, : bands * rows].astype(np.uint64).reshape(len(signatures), bands, rows)
    for i in range(rows):
        keys = keys * np.uint64(0x9E3779B97F4A7C15) + cut[:, :, i] + np.uint64(1)
        keys ^= keys >> np.uint64(29)
    return keys


def keep_best(
    best: np.ndarray, best_id: np.ndarray, row: np.ndarray, score: np.ndarray, other: np.ndarray
) -> None:
    """Fold (row, score, other id) triples into the best score per row; the lowest id wins ties."""
    if len(row) == 0:
        return
    order = np.lexsort((other, -score, row))
    row, score, other = row[order], score[order], other[order]
    first = np.r_[True, row[1:] != row[:-1]]
    row, score, other = row[first], score[first], other[first]
    better = (score > best[row]) | ((score == best[row]) & (other < best_id[row]))
    best[row[better]] = score[better]
    best_id[row[better]] = other[better]


def jaccard_pairs(
    left_values: np.ndarray,
    left_offsets: np.ndarray,
    right_values: np.ndarray,
    right_offsets: np.ndarray,
    left: np.ndarray,
    right: np.ndarray,
) -> np.ndarray:
    """Exact Jaccard of pairs of sorted distinct sets."""
    out = np.empty(len(left))
    sizes, others = np.diff(left_offsets)[left], np.diff(right_offsets)[right]
    steps = np.cumsum(sizes + others) // PAIR_VALUES
    for a, e in chunk_bounds(steps):
        x = left_values[ragged(left_offsets[left[a:e]], sizes[a:e])]
        y = right_values[ragged(right_offsets[right[a:e]], others[a:e])]
        # Values as numbers of their order, so that a pair's number fits in front of them.
        known, number = np.unique(np.concatenate([x, y]), return_inverse=True)
        pair = np.concatenate([np.repeat(np.arange(e - a), n[a:e]) for n in (sizes, others)])
        coded = pair * len(known) + number
        x, y, pair = coded[: len(x)], coded[len(x) :], pair[: len(x)]
        # Sets are sorted and pairs ascend, so both are.
        at = np.minimum(np.searchsorted(y, x), len(y) - 1)
        common = np.bincount(pair[y[at] == x], minlength=e - a)
        out[a:e] = common / (sizes[a:e] + others[a:e] - common)
    return out


def chunk_bounds(steps: np.ndarray) -> list[tuple[int, int]]:
    """(first, behind the last) of the runs of equal numbers."""
    begin = np.flatnonzero(np.append(True, steps[1:] != steps[:-1]))[: len(steps)]
    return list(zip(begin.tolist(), np.append(begin[1:], len(steps)).tolist()))


def ragged(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """The numbers start, start + 1, ... of all ranges, one after the other."""
    before = np.cumsum(lengths) - lengths
    return np.arange(int(lengths.sum())) - np.repeat(before - starts, lengths)


_letters: list[np.ndarray] = []


def _is_letter() -> np.ndarray:
    """Whether a code point is a letter of any script, for all of them; found once by a task."""
    if not _letters:
        _letters.append(np.fromiter((chr(c).isalpha() for c in range(0x110000)), bool, 0x110000))
    return _letters[0]


def letter_runs(texts: list[str | None], buckets: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """For some texts after the others: the number of the first one, the hash buckets of their overlapping runs of three letters,
    one text after the other, and how many runs each has. Letters are those of the words in lower case, with one blank
    between words and at both ends; null has none."""
    lowered = [(t or "").lower() for t in texts]
    long = np.fromiter(map(len, lowered), np.int64, len(texts)) + 2
    for a, e in chunk_bounds(np.cumsum(long) // LETTER_CHUNK):
        codes = np.frombuffer((" " + "  ".join(lowered[a:e]) + " ").encode("utf-32-le"), np.uint32)
        starts = np.cumsum(long[a:e]) - long[a:e]
        letter = _is_letter()[codes]
        kept = letter.copy()
        kept[1:] |= letter[:-1]
        kept[starts] = True
        sizes = np.add.reduceat(kept, starts, dtype=np.int64)
        codes = np.where(letter, codes, 32)[kept].astype(np.uint64)
        runs = np.maximum(sizes - 2, 0)
        first = ragged(np.cumsum(sizes) - sizes, runs)
        mixed = (codes[:-2] << np.uint64(42) | codes[1:-1] << np.uint64(21) | codes[2:]) * np.uint64(0x9E3779B97F4A7C15)
        mixed ^= mixed >> np.uint64(32)
        mixed *= np.uint64(0xD6E8FEB86659FD93)
        yield a, ((mixed[first] >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64), runs


def count_runs(batches: Iterator[pa.RecordBatch], buckets: int) -> Iterator[pa.RecordBatch]:
    """(language, bucket, n) of the runs of the (language, text) rows of a partition; under bucket -1 the rows of a language."""
    totals: dict[str, np.ndarray] = {}
    for b in batches:
        names = b.column(0).to_pylist()
        here = {name: k for k, name in enumerate(dict.fromkeys(names))}
        for name in here:
            totals.setdefault(name, np.zeros(buckets + 1, np.int64))
        number = np.array([here[name] for name in names], np.int64)
        rows = np.bincount(number, minlength=len(here))
        for first, found, runs in letter_runs(b.column(1).to_pylist(), buckets):
            of = np.repeat(number[first : first + len(runs)], runs)
            for name, k in here.items():
                totals[name][:buckets] += np.bincount(found[of == k], minlength=buckets)
        for name, k in here.items():
            totals[name][buckets] += rows[k]
    for name, counts in totals.items():
        at = np.flatnonzero(counts)
        columns = [pa.array([name] * len(at), pa.string()), pa.array(np.where(at == buckets, -1, at)), pa.array(counts[at])]
        yield pa.RecordBatch.from_arrays(columns, names=["language", "bucket", "n"])


def likeliest(given: pa.Array, priors: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Per text the number of the class with the largest prior and sum of weights (class x bucket) of its runs, that sum, and the runs."""
    texts = given.to_pylist()
    sums, runs = np.zeros((len(texts), len(priors))), np.zeros(len(texts), np.int64)
    for first, found, n in letter_runs(texts, weights.shape[1]):
        runs[first : first + len(n)] = n
        some = np.flatnonzero(n)
        if len(some):
            starts = (np.cumsum(n) - n)[some]
            for k, of_class in enumerate(weights):
                sums[first + some, k] = np.add.reduceat(of_class.take(found), starts)
    best = (sums + priors).argmax(axis=1)
    return best, sums[np.arange(len(texts)), best], runs


class BandIndex:
    """Lookup of a bounded set of signatures by band."""

    def __init__(self, ids: np.ndarray, signatures: np.ndarray, bands: int, rows: int):
        self.ids, self.signatures, self.bands, self.rows = ids, signatures, bands, rows
        keys = band_keys(signatures, bands, rows)
        self.order = np.argsort(keys, axis=0, kind="stable")
        self.sorted_keys = np.take_along_axis(keys, self.order, axis=0)

    def candidates(self, signatures: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Distinct (probe row, indexed row) pairs that share a band, for some probe rows after the others: a row has at
        most as many as there are bands and indexed rows, and a chunk little more than ``CANDIDATE_CHUNK``."""
        keys = band_keys(signatures, self.bands, self.rows)
        low, count = (np.empty(keys.shape, dtype=np.int64) for _ in range(2))
        for band in range(self.bands):
            column = self.sorted_keys[:, band]
            low[:, band] = np.searchsorted(column, keys[:, band], "left")
            count[:, band] = np.searchsorted(column, keys[:, band], "right") - low[:, band]
        for a, e in chunk_bounds(np.cumsum(count.sum(axis=1)) // CANDIDATE_CHUNK):
            n = count[a:e].ravel()
            band = np.repeat(np.tile(np.arange(self.bands), e - a), n)
            probe = np.repeat(np.repeat(np.arange(a, e), self.bands), n)
            hit = self.order[ragged(low[a:e].ravel(), n), band]
            codes = np.unique(probe * len(self.ids) + hit)
            yield codes // max(1, len(self.ids)), codes % max(1, len(self.ids))


def match_batches(batches, index: BandIndex, sets=None):
    """Best train row per indexed test row over the batches of one partition.

    A batch has ``id``, ``signature`` and, for exact Jaccard, ``hashes``; ``sets`` are then the flat
    values and offsets of the indexed rows. Copies within a batch are matched once. At most one row
    per test row leaves a partition, however many pairs share a band.
    """
    n = len(index.ids)
    best, best_id = np.full(n, -1.0), np.zeros(n, dtype=np.int64)
    found = np.zeros(n, dtype=np.int64)
    for batch in batches:
        ids = batch.column("id").to_numpy()
        if len(ids) == 0:
            continue
        flat, _ = list_parts(batch.column("signature"))
        signatures = flat.reshape(len(ids), -1)
        by_id = np.argsort(ids, kind="stable")
        ids, signatures = ids[by_id], signatures[by_id]
        same = signatures
        if sets is not None:
            values, offsets = list_parts(batch.column("hashes"))
            sizes, digest = np.diff(offsets), np.add.reduceat(values, offsets[:-1])
            same = np.column_stack([signatures, sizes[by_id], digest[by_id]])
        packed = np.ascontiguousarray(same).view(np.dtype((np.void, same.shape[1] * same.itemsize)))
        _, first, copies = np.unique(packed.ravel(), return_index=True, return_counts=True)
        ids, signatures, by_id = ids[first], signatures[first], by_id[first]

        for train, test in index.candidates(signatures):
            found += np.bincount(test, weights=copies[train], minlength=n).astype(np.int64)
            for start in range(0, len(train), PAIR_CHUNK):
                i, j = train[start : start + PAIR_CHUNK], test[start : start + PAIR_CHUNK]
                if sets is None:
                    score = (signatures[i] == index.signatures[j]).mean(axis=1)
                else:
                    score = jaccard_pairs(values, offsets, sets[0], sets[1], by_id[i], j)
                keep_best(best, best_id, j, score, ids[i])
    hit = np.flatnonzero(found)
    yield pa.RecordBatch.from_arrays(
        [
            pa.array(index.ids[hit]),
            pa.array(best_id[hit]),
            pa.array(best[hit]),
            pa.array(found[hit]),
        ],
        names=["test_id", "train_id", "similarity", "n_candidates"],
    )


def scattered(values: np.ndarray) -> np.ndarray:
    """Values as 64-bit hashes (splitmix64 finalizer)."""
    h = values.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    h = (h ^ (h >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(31))


def of_class(values: np.ndarray, number: int, classes: int) -> np.ndarray:
    """Whether values belong to one of so many classes of about equal size."""
    return scattered(values) % np.uint64(classes) == np.uint64(number)


def filter_slots(values: np.ndarray, bits: int) -> np.ndarray:
    """The two places of each value in a filter of 2^bits bits (32 at most), a row for each place."""
    h = scattered(scattered(values))
    return np.stack([h >> np.uint64(64 - bits), (h & np.uint64(0xFFFFFFFF)) >> np.uint64(32 - bits)]).astype(np.int64)


def slot_slices(batches: Iterator[pa.RecordBatch], bits: int, number: int, classes: int) -> Iterator[pa.RecordBatch]:
    """The places of one class of the values of (hashes) rows: (slice of the filter, places in it at two bytes each)."""
    for b in batches:
        values, _ = list_parts(b.column(0))
        slots = np.unique(filter_slots(values[of_class(values, number, classes)], bits))
        slices, begin = np.unique(slots >> SLICE_BITS, return_index=True)
        low = (slots & ((1 << SLICE_BITS) - 1)).astype("<u2")
        parts = [part.tobytes() for part in np.split(low, begin[1:])] if len(slices) else []
        yield pa.RecordBatch.from_arrays([pa.array(slices, pa.int32()), pa.array(parts, pa.binary())], ["slice", "low"])


def merged_slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of ``slot_slices``, sorted by slice, to one row of packed bits a slice."""

    def packed(number: int, bits: np.ndarray) -> pa.RecordBatch:
        column = pa.array([np.packbits(bits).tobytes()], pa.binary())
        return pa.RecordBatch.from_arrays([pa.array([number], pa.int32()), column], ["slice", "low"])

    now, bits = None, np.zeros(0, bool)
    for b in batches:
        for number, low in zip(b.column(0).to_pylist(), b.column(1).to_pylist()):
            if number != now:
                if now is not None:
                    yield packed(now, bits)
                now, bits = number, np.zeros(1 << SLICE_BITS, bool)
            bits[np.frombuffer(low, "<u2")] = True
    if now is not None:
        yield packed(now, bits)


def held_values(batches: Iterator[pa.RecordBatch], table: np.ndarray, number: int, classes: int) -> Iterator[pa.RecordBatch]:
    """(number, token) of the values of one class of (number, hashes) rows that a filter may hold."""
    bits = 3 + (len(table) - 1).bit_length()
    for b in batches:
        values, offsets = list_parts(b.column(1))
        at = np.flatnonzero(of_class(values, number, classes))
        slots = filter_slots(values[at], bits)
        at = at[((table[slots >> 3] >> (7 - (slots & 7)).astype(np.uint8)) & 1).all(axis=0)]
        row = np.repeat(b.column(0).to_numpy(), np.diff(offsets))
        yield pa.RecordBatch.from_arrays([pa.array(row[at]), pa.array(values[at])], ["number", "token"])


class SetIndex:
    """Lookup of a block of sets by shingle. Of each set there are the id, the size, the shingles that count, rarest first, which come
    after its others, and the sum of how many sets hold one of them."""

    def __init__(self, sets: pa.Table):
        values, self.offsets = list_parts(sets.column("o"))
        self.ids, self.sizes = (sets.column(c).to_numpy() for c in ("id", "size"))
        self.lengths = np.diff(self.offsets)
        self.known, self.codes = np.unique(values, return_inverse=True)
        row = np.repeat(np.arange(len(self.ids), dtype=np.int32), self.lengths)
        central = sets.column("total").to_numpy() / self.sizes
        by = np.lexsort((central[row], self.codes))
        ends = np.cumsum(np.bincount(self.codes, minlength=len(self.known)))
        self.centre = row[by[ends - 1]]
        # Postings of a shingle by size, so that sets of the sizes that can do are one range.
        self.span = int(self.sizes.max()) + 1
        key = self.codes * self.span + self.sizes[row]
        by = np.argsort(key, kind="stable")
        place = np.arange(len(values)) - np.repeat(self.offsets[:-1] - self.sizes + self.lengths, self.lengths)
        self.key, self.row, self.place = key[by], row[by], place[by]
        self.small = self.row[np.append(0, ends[:-1])]


def nearest_cell(train: pa.Table, test: pa.Table, threshold: float, seeds: bool, rounding: float) -> pa.Table:
    """What one cell finds for test sets (x, size, o, and the best so far: similarity, y) among its train sets: (x, y, similarity) of those
    that get better by sets at least ``threshold`` similar. With ``seeds``, the smallest and the most central train set of each shingle
    are tried first. Pairs stay in the cell, some at a time; a few test sets have their shingles marked, and others are counted by that."""
    names = ["x", "y", "similarity"]
    if not train.num_rows or not test.num_rows:
        return pa.table([pa.array([], type=k) for k in (pa.int64(), pa.int64(), pa.float64())], names=names)
    index = SetIndex(train)
    rows, width = len(index.ids), len(index.known)
    values, offsets = list_parts(test.column("o"))
    sizes, lengths = test.column("size").to_numpy(), np.diff(offsets)
    best = test.column("similarity").fill_null(-1.0).to_numpy().copy()
    best_id = test.column("y").fill_null(0).to_numpy().copy()
    before, before_id = best.copy(), best_id.copy()
    step = max(1, CELL_MARKS // width)
    mark = np.zeros(min(step, len(sizes)) * width, bool)

    def count(pairs: np.ndarray, first: int) -> None:
        """Similarity of distinct pairs (test set counted from ``first``) * rows + train set."""
        for a, e in chunk_bounds(np.cumsum(index.lengths[pairs % rows]) // PAIR_VALUES):
            x, y = pairs[a:e] // rows, pairs[a:e] % rows
            n = index.lengths[y]
            hit = mark[np.repeat(x * width, n) + index.codes[ragged(index.offsets[y], n)]]
            common = np.add.reduceat(hit, np.cumsum(n) - n, dtype=np.int64)
            keep_best(best, best_id, first + x, common / (sizes[first + x] + index.sizes[y] - common), index.ids[y])

    for first in range(0, len(sizes), step):
        stop = min(first + step, len(sizes))
        some = values[offsets[first] : offsets[stop]]
        c = np.minimum(np.searchsorted(index.known, some), width - 1)
        held = np.flatnonzero(index.known[c] == some)
        c, x = c[held], np.repeat(np.arange(first, stop), lengths[first:stop])[held]
        # How many shingles of its set there are from each one on.
        left = offsets[x + 1] - offsets[first] - held
        marked = (x - first) * width + c
        mark[marked] = True
        if seeds:
            tried = [(x - first) * rows + seed[c] for seed in (index.small, index.centre)]
            count(np.unique(np.concatenate(tried)), first)
        n, reach = sizes[x], np.maximum(best[x], threshold)
        # The first shingles of a set up to size * (1 - reach) + 1; the others may be shared with it by a lesser set only.
        prefix = left > np.ceil(reach * n - rounding) - 1
        x, c, left, n, reach = x[prefix], c[prefix], left[prefix], n[prefix], reach[prefix]
        low = np.ceil(reach * n - rounding).astype(np.int64)
        most = (1 + reach) * left / np.maximum(reach - rounding, rounding) - n
        high = np.minimum(np.floor(most), index.span - 1).astype(np.int64)
        begin = np.searchsorted(index.key, c * index.span + np.minimum(low, index.span))
        runs = np.maximum(np.searchsorted(index.key, c * index.span + np.maximum(high, -1), "right") - begin, 0)
        for a, e in chunk_bounds(np.cumsum(runs) // CANDIDATE_CHUNK):
            at, i = ragged(begin[a:e], runs[a:e]), np.repeat(np.arange(a, e), runs[a:e])
            y = index.row[at]
            overlap = np.minimum(left[i], index.sizes[y] - index.place[at])
            bound, known = overlap / (n[i] + index.sizes[y] - overlap), best[x[i]]
            useful = (bound > known) | ((bound == known) & (index.ids[y] < best_id[x[i]]))
            useful &= bound >= reach[i] - rounding
            count(np.unique((x[i][useful] - first) * rows + y[useful]), first)
        mark[marked] = False
    better = np.flatnonzero((best != before) | (best_id != before_id))
    return pa.table([test.column("x").take(pa.array(better)), pa.array(best_id[better]), pa.array(best[better])], names=names)


def unit_rows(flat: np.ndarray, rows: int) -> np.ndarray:
    """Rows scaled to length 1; a zero row stays zero."""
    matrix = flat.astype(np.float64).reshape(rows, -1)
    norm = np.sqrt((matrix * matrix).sum(axis=1, keepdims=True))
    return np.divide(matrix, norm, out=np.zeros_like(matrix), where=norm > 0)


def fold_cosine(
    best: np.ndarray, best_id: np.ndarray, test: np.ndarray, train: np.ndarray, ids: np.ndarray
) -> None:
    """Fold train vectors (rows in id order) into the best cosine per test vector, a block at a time
    so that the block of similarities stays small."""
    rows = np.arange(len(test))
    for start in range(0, len(train), VECTOR_CHUNK):
        sims = np.round(test @ train[start : start + VECTOR_CHUNK].T, 9)
        at = sims.argmax(axis=1)
        keep_best(best, best_id, rows, sims[rows, at], ids[start + at])


def cosine_batches(batches, test_ids: np.ndarray, test: np.ndarray):
    """Best train vector per test vector over the batches of one partition."""
    best, best_id = np.full(len(test_ids), -np.inf), np.zeros(len(test_ids), dtype=np.int64)
    seen = False
    for batch in batches:
        ids = batch.column("id").to_numpy()
        if len(ids) == 0:
            continue
        seen = True
        flat, _ = list_parts(batch.column("embedding"))
        by_id = np.argsort(ids, kind="stable")
        fold_cosine(best, best_id, test, unit_rows(flat, len(ids))[by_id], ids[by_id])
    if seen:
        yield pa.RecordBatch.from_arrays(
            [pa.array(test_ids), pa.array(best_id), pa.array(best)],
            names=["test_id", "train_id", "similarity"],
        )


def cosine_cell(train: pa.Table, test: pa.Table) -> pa.Table:
    """Best train vector per test vector within one cell of the block grid."""
    names = ["test_id", "train_id", "similarity"]
    if not train.num_rows or not test.num_rows:
        kinds = [pa.int64(), pa.int64(), pa.float64()]
        return pa.table([pa.array([], type=k) for k in kinds], names=names)
    ids, test_ids = train.column("id").to_numpy(), test.column("id").to_numpy()
    by_id = np.argsort(ids, kind="stable")
    vectors = unit_rows(list_parts(train.column("embedding"))[0], len(ids))[by_id]
    wanted = unit_rows(list_parts(test.column("embedding"))[0], len(test_ids))
    best, best_id = np.full(len(test_ids), -np.inf), np.zeros(len(test_ids), dtype=np.int64)
    fold_cosine(best, best_id, wanted, vectors, ids[by_id])
    return pa.table([pa.array(test_ids), pa.array(best_id), pa.array(best)], names=names)
