"""Best-fit packing of tokenised documents into sequences of a fixed capacity.

Only lengths matter to a packing, and there are at most ``capacity`` of them. The plan is therefore made on the number
of pieces of each length, which has a bounded size however many documents there are:

1. Documents become pieces: longer ones than the capacity are cut into full pieces and a rest.
2. Large-item matching: at most two pieces of more than a third of the capacity fit with a third one of that kind
   left out, so each is matched, longest first, with the longest other large piece that still fits.
3. The smaller pieces, longest first, go to the sequences with the least gap that holds them (best fit), or open new ones.
4. Each piece gets a number within its length, and from the plan its place. Pieces of one length are numbered in
   salted groups, so that a length that a third of all pieces have is not one task.

The plan takes equal sequences together, as (lengths, number of sequences); it does not grow with the number of pieces,
only the numbers in it do.

Defined results: null text is an empty text, which is one piece with the end mark only; repeated rows are packed each;
null doc_ids are packed; an empty table gives no rows.
"""

from __future__ import annotations

import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .shared import LOWER, Scratch, blocks, byte_hashes, word_bounds

#: Pieces numbered in one group of a length.
GROUP = 100_000
#: Words whose ids a worker remembers.
CACHE = 1_000_000
_ALNUM, _MARKS = np.zeros(256, bool), np.zeros(256, bool)
_ALNUM[48:58] = _ALNUM[65:91] = _ALNUM[97:123] = True
_MARKS[33:127] = ~_ALNUM[33:127]
_MARKS[39] = False  # an apostrophe may begin the ending of a word


def plan_sequences(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Patterns (lengths in order of place) and how many sequences have each, for counts of pieces by length."""
    third = capacity // 3
    large = sorted(n for n in counts if n > third and counts[n])
    left = {n: counts[n] for n in large}
    open_: dict[int, list[tuple[tuple[int, ...], int]]] = {}
    gaps: list[int] = []

    def put(pattern: tuple[int, ...], times: int) -> None:
        gap = capacity - sum(pattern)
        if gap not in open_:
            open_[gap] = []
            insort(gaps, gap)
        open_[gap].append((pattern, times))

    while large:
        n = large[-1]
        if not left[n]:
            large.pop()
            continue
        at = bisect_left(large, capacity - n + 1) - 1  # the longest that fits beside it
        while at >= 0 and not left[large[at]]:
            large.pop(at)
            at -= 1
        if at < 0:
            put((n,), left[n])
            left[n] = 0
        elif (m := large[at]) == n:
            if left[n] // 2:
                put((n, n), left[n] // 2)
            left[n] %= 2
            if left[n]:
                lower = at - 1
                while lower >= 0 and not left[large[lower]]:
                    lower -= 1
                if lower >= 0:
                    put((n, large[lower]), 1)
                    left[large[lower]] -= 1
                else:
                    put((n,), 1)
                left[n] = 0
        else:
            times = min(left[n], left[m])
            put((n, m), times)
            left[n] -= times
            left[m] -= times

    for n in sorted((n for n in counts if 0 < n <= third), reverse=True):
        more = counts[n]
        while more:
            at = bisect_left(gaps, n)
            if at == len(gaps):
                fit = capacity // n
                if more // fit:
                    put((n,) * fit, more // fit)
                if more % fit:
                    put((n,) * (more % fit), 1)
                break
            gap = gaps[at]
            pattern, times = open_[gap].pop()
            if not open_[gap]:
                del open_[gap]
                gaps.pop(at)
            fit = gap // n
            full = min(times, more // fit)
            if full:
                put(pattern + (n,) * fit, full)
                more -= full * fit
                times -= full
            if times and 0 < more < fit:
                put(pattern + (n,) * more, 1)
                more, times = 0, times - 1
            if times:
                put(pattern, times)
    return [x for gap in gaps for x in open_[gap]]


class Places:
    """From the number of a piece within its length to its sequence and offset, by the plan."""

    def __init__(self, plan: list[tuple[tuple[int, ...], int]]):
        """Slots of a length follow each other; a slot serves as many pieces as its pattern has sequences."""
        slots: dict[int, list[tuple[int, int, int]]] = {}
        first = 0
        for pattern, times in plan:
            offset = 0
            for n in pattern:
                slots.setdefault(n, []).append((times, first, offset))
                offset += n
            first += times
        self.sequences = first
        self.slots = {n: tuple(np.array(c, np.int64) for c in zip(*x)) for n, x in slots.items()}
        self.ends = {n: np.cumsum(x[0]) for n, x in self.slots.items()}

    def find(self, length: int, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        times, first, offset = self.slots[length]
        at = np.searchsorted(self.ends[length], numbers, side="right")
        return first[at] + numbers - (self.ends[length][at] - times[at]), offset[at]


class Memory:
    """Token ids of words by the words' 64-bit hashes: an open table with linear probing, all in numpy, 20 to 40 bytes a word."""

    def __init__(self, slots: int = 1 << 16):
        self.keys, self.at = np.zeros(slots, np.uint64), np.zeros(slots, np.int32)
        self.starts, self.pool = np.zeros(1 << 15, np.int64), np.zeros(1 << 17, np.uint32)
        self.words = 0

    def _first(self, hashes: np.ndarray) -> np.ndarray:
        return (hashes >> np.uint64(65 - len(self.keys).bit_length())).astype(np.int64)

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The number of each word, or -1."""
        out, left, slot = np.full(len(hashes), -1, np.int64), np.arange(len(hashes)), self._first(hashes)
        while len(left):
            key = self.keys[slot]
            hit = key == hashes[left]
            out[left[hit]] = self.at[slot[hit]]
            on = ~hit & (key != 0)
            left, slot = left[on], (slot[on] + 1) & (len(self.keys) - 1)
        return out

    def add(self, hashes: np.ndarray, sizes: np.ndarray, ids: np.ndarray) -> None:
        """Distinct new words with their numbers of ids, and all those ids in a row."""
        end = self.starts[self.words]
        if 2 * (self.words + len(hashes)) > len(self.keys):
            known = np.flatnonzero(self.keys)
            old, at = self.keys[known], self.at[known]
            grown = max(2 * len(self.keys), 1 << (4 * (self.words + len(hashes)) - 1).bit_length())
            self.keys, self.at = np.zeros(grown, np.uint64), np.zeros(grown, np.int32)
            self._put(old, at)
        self.starts = _room(self.starts, self.words + len(hashes) + 1)
        self.pool = _room(self.pool, end + len(ids))
        self.pool[end : end + len(ids)] = ids
        self._put(hashes, np.arange(self.words, self.words + len(hashes), dtype=np.int32))
        self.starts[self.words + 1 : self.words + len(hashes) + 1] = end + np.cumsum(sizes)
        self.words += len(hashes)

    def _put(self, hashes: np.ndarray, at: np.ndarray) -> None:
        left, slot = np.arange(len(hashes)), self._first(hashes)
        while len(left):
            free = self.keys[slot] == 0
            self.keys[slot[free]] = hashes[left[free]]  # of several words for one slot, one stays
            won = self.keys[slot] == hashes[left]
            self.at[slot[won]] = at[left[won]]
            left, slot = left[~won], (slot[~won] + 1) & (len(self.keys) - 1)

    def sizes(self, numbers: np.ndarray) -> np.ndarray:
        return self.starts[numbers + 1] - self.starts[numbers]

    def ids(self, numbers: np.ndarray, sizes: np.ndarray) -> np.ndarray:
        """The ids of words by their numbers, in a row."""
        return self.pool[np.arange(sizes.sum()) + np.repeat(self.starts[numbers] - np.cumsum(sizes) + sizes, sizes)]


def _room(array: np.ndarray, n: int) -> np.ndarray:
    if n <= len(array):
        return array
    grown = np.zeros(max(n, len(array) * 3 // 2), array.dtype)
    grown[: len(array)] = array
    return grown


class Ids:
    """Token ids of texts; ids of words are remembered where a tokenizer treats words between white space apart.

    Where it also ignores the case of ASCII words and takes ASCII marks after an ASCII letter or digit apart, words are
    remembered without either. Whether it does is tried on some words. New words are encoded together: those of letters only with spaces between them, told apart by the tokenizer's ends
    of words; others with an added token between them, which is found before anything else. Texts that hold an added
    token are encoded whole. Remembered words are in two generations: when the young one has half of ``CACHE``, the old
    one is forgotten, so that frequent words stay. ``shared`` keeps one such memory for all tasks of a worker.
    """

    _shared: dict[str, Ids] = {}

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        added = self.tokenizer.get_added_tokens_decoder()
        self.marks = [t.content.encode() for t in added.values()]
        self.young, self.old = Memory(), Memory()
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, bool)
        self.ends[[k for t, k in vocabulary.items() if t.endswith("</w>")]] = True
        self.apart = self.folds = False
        if added:
            self.mark_id, self.mark = next((k, t.content) for k, t in added.items())
            words = ("it's", "a1b", "É", "(x", "--", "ß", "9.")
            own = [self._ids(w) for w in words]
            self.apart = self._ids(self.mark.join(words)) == sum(([*w, self.mark_id] for w in own), [])[:-1] and all(
                self._ids(space.join(words)) == sum(own, []) for space in (" ", "\n", "\t ", "\r\n", "\x0b", "\x0c")
            )
            bases, ends = ("Word", "it's", "A1b2", "çãO", "'s", "x-Y", "QZ7"), (".", ",&&&", ")\"", "-", "!?", "%%%", "_", "~/<")
            self.folds = all(self._ids(b + e) == self._ids(b.lower() if b.isascii() else b) + self._ids(e) for b in bases for e in ends)

    @classmethod
    def shared(cls, path: str) -> Ids:
        if path not in cls._shared:
            cls._shared[path] = cls(path)
        return cls._shared[path]

    def _ids(self, text: str) -> list[int]:
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def _together(self, words: list[str], between: str) -> np.ndarray:
        return np.array(self.tokenizer.encode_batch_fast([between.join(words)], add_special_tokens=False)[0].ids, np.uint32)

    def _learn(self, words: list[str], hashes: np.ndarray) -> None:
        plain = np.fromiter((w.isalpha() for w in words), bool, len(words))
        letters, others = np.flatnonzero(plain), [np.flatnonzero(~plain)]
        for k in range(0, len(letters), 20_000):
            part = letters[k : k + 20_000]
            ids = self._together([words[i] for i in part], " ")
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == len(part):
                self.young.add(hashes[part], np.diff(ends, prepend=0), ids)
            else:  # some letter became more than one word
                others.append(part)
        rest = np.concatenate(others)
        for k in range(0, len(rest), 20_000):
            part = rest[k : k + 20_000]
            ids = self._together([words[i] for i in part], self.mark)
            cuts = np.flatnonzero(ids == self.mark_id)
            self.young.add(hashes[part], np.diff(cuts, prepend=-1, append=len(ids)) - 1, np.delete(ids, cuts))

    def _numbers(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray, hashes: np.ndarray) -> np.ndarray:
        """The number of each word in the young memory; it may hold one block's words beyond its bound."""
        numbers = self.young.find(hashes)
        miss = np.flatnonzero(numbers < 0)
        if not len(miss):
            return numbers
        new, first = np.unique(hashes[miss], return_index=True)
        if 2 * (self.young.words + len(new)) > CACHE and self.young.words:
            self.old, self.young = self.young, Memory()
            return self._numbers(data, starts, ends, hashes)
        at = self.old.find(new)
        known = at >= 0
        sizes = self.old.sizes(at[known])
        self.young.add(new[known], sizes, self.old.ids(at[known], sizes))
        raw, first = data.tobytes(), miss[first[~known]]
        self._learn([raw[a:b].decode() for a, b in zip(starts[first].tolist(), ends[first].tolist())], new[~known])
        numbers[miss] = self.young.find(hashes[miss])
        return numbers

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of whole texts in a row, and where each text's begin (and the end).

        Words are only looked up apart if nothing in the texts joins over white space.
        """
        raw = data.tobytes()
        if not self.apart or any(m in raw for m in self.marks):
            parts = [raw[a:b] for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())]
            if not self.apart or len(parts) == 1:
                own = [np.array(self._ids(p.decode()), np.uint32) for p in parts]
            else:
                own = [self.of(np.frombuffer(p, np.uint8), np.array([0, len(p)]))[0] for p in parts]
            return np.concatenate(own), np.concatenate([[0], np.cumsum([len(x) for x in own])])
        starts, ends, before = word_bounds(data, offsets)
        if self.folds and len(starts):
            data, starts, ends, before = _folded(data, starts, ends, before)
        hashes = np.maximum(byte_hashes(data, starts, ends), np.uint64(1))
        numbers = self._numbers(data, starts, ends, hashes)
        sizes = self.young.sizes(numbers)
        return self.young.ids(numbers, sizes), np.concatenate([[0], np.cumsum(sizes)])[before]


def _folded(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes with ASCII words in lower case, and bounds of words with their last marks as words of their own."""
    ascii_ = np.maximum.reduceat(data, starts) < 128  # white space after a word is ASCII too
    spans = np.diff(starts, append=len(data))
    data = data.copy()
    data[starts[0] :] = np.where(np.repeat(ascii_, spans), LOWER[data[starts[0] :]], data[starts[0] :])
    marked = np.flatnonzero(_MARKS[data[ends - 1]])
    last = np.maximum.accumulate(np.where(_MARKS[data], 0, np.arange(len(data))))[ends[marked] - 1]
    apart = (last >= starts[marked]) & _ALNUM[data[last]]
    marked, cut = marked[apart], last[apart] + 1
    return data, np.insert(starts, marked + 1, cut), np.insert(ends, marked, cut), before + np.searchsorted(marked, before)


def _pieces(path: str, capacity: int, end_id: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids = Ids.shared(path)
        for batch in batches:
            for row, stop, data, offsets in blocks(batch.column(1)):
                tokens, ends = ids.of(data, offsets)
                tokens = memoryview(np.insert(tokens, ends[1:], end_id).astype("<u4")).cast("B")
                first = ends[:-1] + np.arange(stop - row)
                sizes = np.diff(ends) + 1
                count = -(-sizes // capacity)
                doc = np.repeat(np.arange(stop - row), count)
                piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
                start = piece * capacity
                length = np.minimum(sizes[doc] - start, capacity)
                places = (4 * (first[doc] + start)).tolist()
                crc = [zlib.crc32(tokens[a : a + 4 * n]) for a, n in zip(places, length.tolist())]
                keys = batch.column(0)[row:stop].take(pa.array(doc))
                yield pa.record_batch([keys, pa.array(piece, pa.int32()), pa.array(start), pa.array(length), pa.array(crc, pa.int64())], _PIECE)

    return run


_PIECE = ["doc_id", "piece", "start", "length", "ids_crc32"]


def _placed(places):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lengths, numbers = batch.column(3).to_numpy(), batch.column(5).to_numpy()
            sequence, offset = np.zeros(len(lengths), np.int64), np.zeros(len(lengths), np.int64)
            for n in np.unique(lengths):
                at = np.flatnonzero(lengths == n)
                sequence[at], offset[at] = places.value.find(int(n), numbers[at])
            yield pa.record_batch([*batch.columns[:5], pa.array(sequence), pa.array(offset)], [*batch.schema.names[:5], "sequence_id", "offset"])

    return run


def pack_documents(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    scratch = Scratch(spark, "packing")
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    pieces = scratch.cut(plain.mapInArrow(_pieces(tokenizer, capacity, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long"), "pieces")
    counts = {r["length"]: r["count"] for r in pieces.groupBy("length").count().collect()}  # at most capacity rows
    places = spark.sparkContext.broadcast(Places(plan_sequences(counts, capacity)))
    groups = max(1, -(-max(counts.values(), default=1) // GROUP))
    grouped = pieces.withColumn("g", F.expr(f"pmod(xxhash64(doc_id, piece), {groups})"))
    before = Window.partitionBy("length").orderBy("g").rowsBetween(Window.unboundedPreceding, -1)
    starts = grouped.groupBy("length", "g").agg(F.count("*").alias("n")).withColumn("base", F.coalesce(F.sum("n").over(before), F.lit(0))).drop("n")
    within = Window.partitionBy("length", "g").orderBy("doc_id", "piece", "ids_crc32")
    numbered = (
        grouped.withColumn("k", F.row_number().over(within)).join(starts, ["length", "g"])
        .select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("base") + F.col("k") - 1).alias("number"))
    )
    return numbered.mapInArrow(_placed(places), "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
