"""Benchmark decontamination by an FM-index of each training shard.

A shard is one batch of documents. Its words become symbols: the numbers of benchmark words, all
others cannot match. Only stretches whose neighbouring words also stand beside each other somewhere
in the benchmark are indexed, which loses no occurrence, because each window consists of such pairs.
The index is a suffix array's Burrows-Wheeler transform in a wavelet matrix; all test windows are
searched backward at once, occurrences are located by sampled suffix positions, and their spans are
merged into removal spans.

Words are told apart by 64 bits of hashes. A benchmark within BLOCK_BYTES is broadcast; a larger one
makes blocks, which a task loads one after another from the shared folder.

Cases: a null or empty text has no words; an item without words has no window; items that repeat a
text or a window each count; repeated documents and identifiers are judged each; a very long text is
searched whole; an empty benchmark finds nothing; an empty table gives no rows; other columns are kept,
one with the name of a result under a new name with an underscore before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import LOWER, batches, chunks, fresh, prefix_hash, span_hash, word_spans
from ._blocks import Blocks

U64 = np.uint64
ALNUM_WORD = np.ones(256, bool)  # words are runs of anything but these bytes
ALNUM_WORD[[*range(0x00, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x80)]] = False
SLOT_BITS = 20
BLOCK_BYTES = 16 << 20


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each lower-cased word, and n+1 offsets of the texts into them."""
    starts, ends, of = word_spans(data, offsets, ALNUM_WORD)
    return span_hash(prefix_hash(data, LOWER), starts, ends), of


class WaveletMatrix:
    """Ranks of symbols in a sequence, for many symbols and places at once."""

    def __init__(self, sequence: np.ndarray, bits: int) -> None:
        self.levels: list[tuple[int, int, np.ndarray]] = []
        for level in range(bits - 1, -1, -1):
            bit = (sequence >> level & 1).astype(bool)
            ones = np.zeros(len(sequence) + 1, np.int32)
            np.cumsum(bit, out=ones[1:])
            self.levels.append((level, len(sequence) - int(ones[-1]), ones))
            sequence = np.concatenate([sequence[~bit], sequence[bit]])

    def rank(self, symbols: np.ndarray, places: np.ndarray) -> np.ndarray:
        """How often each symbol stands before its place."""
        low = np.zeros(len(symbols), np.int64)
        high = places.astype(np.int64)
        for level, zeros, ones in self.levels:
            bit = (symbols >> level & 1).astype(bool)
            ones_low, ones_high = ones[low], ones[high]
            low = np.where(bit, zeros + ones_low, low - ones_low)
            high = np.where(bit, zeros + ones_high, high - ones_high)
        return high - low


def suffix_array(sequence: np.ndarray) -> np.ndarray:
    """By doubling the compared length until all suffixes differ."""
    n = len(sequence)
    rank, step = np.unique(sequence, return_inverse=True)[1].astype(np.int64) + 1, 1
    while True:
        after = np.zeros(n, np.int64)
        after[: n - step] = rank[step:] if step < n else 0
        key = rank * (n + 2) + after
        order = np.argsort(key, kind="stable")
        new = np.concatenate([[True], key[order][1:] != key[order][:-1]]) if n else np.zeros(0, bool)
        rank = np.zeros(n, np.int64)
        rank[order] = np.cumsum(new)
        if n == 0 or rank[order[-1]] == n:
            return order
        step *= 2


class FMIndex:
    """Backward search over a sequence of symbols from 0 to top, where 0 parts stretches; an end symbol of its own follows."""

    SAMPLE = 16

    def __init__(self, sequence: np.ndarray, top: int) -> None:
        sequence = np.append(sequence + 1, 0)
        order = suffix_array(sequence)
        self.bwt = sequence[order - 1]
        self.matrix = WaveletMatrix(self.bwt, int(top + 1).bit_length())
        self.before = np.concatenate([[0], np.cumsum(np.bincount(sequence, minlength=top + 2))])[:-1]
        sampled = order % self.SAMPLE == 0
        self.sampled, self.kept = sampled, order[sampled]
        self.sample_rank = np.concatenate([[0], np.cumsum(sampled)])

    def search(self, patterns: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ranges of suffixes that begin with each row of patterns."""
        low, high = np.zeros(len(patterns), np.int64), np.full(len(patterns), len(self.bwt), np.int64)
        alive = np.arange(len(patterns))
        for j in range(patterns.shape[1] - 1, -1, -1):
            symbols = patterns[alive, j] + 1
            low[alive] = self.before[symbols] + self.matrix.rank(symbols, low[alive])
            high[alive] = self.before[symbols] + self.matrix.rank(symbols, high[alive])
            dead = alive[low[alive] >= high[alive]]
            high[dead] = low[dead]
            alive = alive[low[alive] < high[alive]]
            if not len(alive):
                break
        return low, high

    def locate(self, rows: np.ndarray) -> np.ndarray:
        """Where the suffixes of these rows begin, walking back to sampled ones."""
        out, rows, steps = np.zeros(len(rows), np.int64), rows.copy(), 0
        left = np.arange(len(rows))
        while len(left):
            done = self.sampled[rows[left]]
            out[left[done]] = self.kept[self.sample_rank[rows[left[done]]]] + steps
            left = left[~done]
            symbols = self.bwt[rows[left]]
            rows[left] = self.before[symbols] + self.matrix.rank(symbols, rows[left])
            steps += 1
        return out


@dataclass
class Phrases:
    """A block of the benchmark: its words, neighbouring pairs and windows by length."""

    vocabulary: np.ndarray
    slots: np.ndarray
    pairs: np.ndarray
    shortest: int
    windows: list[tuple[np.ndarray, list[tuple[str, ...]]]]

    @classmethod
    def of(cls, items: list[tuple[object, str | None]], width: int) -> Phrases:
        texts = pa.array([x or "" for _, x in items], pa.string())
        hashes, ofs, at = [], [0], 0
        for _, _, data, offsets in chunks(texts):
            h, of = words_of(data, offsets)
            hashes.append(h)
            ofs += (of[1:] + at).tolist()
            at += len(h)
        words = np.concatenate(hashes) if hashes else np.zeros(0, U64)
        vocabulary = np.unique(words)
        ids = np.searchsorted(vocabulary, words) + 1
        slots = np.zeros(1 << SLOT_BITS, bool)
        slots[(vocabulary & U64((1 << SLOT_BITS) - 1)).astype(np.int64)] = True
        found: dict[int, dict[tuple[int, ...], set[str]]] = {}
        pairs: set[int] = set()
        for (item, _), a, b in zip(items, ofs[:-1], ofs[1:], strict=True):
            own = ids[a:b].tolist()
            n = min(width, len(own))
            if n:
                pairs.update(x * (len(vocabulary) + 1) + y for x, y in zip(own[:-1], own[1:], strict=True))
                for i in range(len(own) - n + 1):
                    found.setdefault(n, {}).setdefault(tuple(own[i : i + n]), set()).add("" if item is None else str(item))
        windows = [(np.array(list(w), np.int64), [tuple(sorted(x)) for x in w.values()]) for _, w in sorted(found.items())]
        return cls(vocabulary, slots, np.array(sorted(pairs), np.int64), min(found, default=0), windows)

    def symbols(self, words: np.ndarray) -> np.ndarray:
        """The number of each word, 0 if the block lacks it."""
        out = np.zeros(len(words), np.int64)
        near = np.flatnonzero(self.slots[(words & U64((1 << SLOT_BITS) - 1)).astype(np.int64)])
        at = np.searchsorted(self.vocabulary, words[near])
        at[at == len(self.vocabulary)] = 0
        same = self.vocabulary[at] == words[near]
        out[near[same]] = at[same] + 1
        return out

    def stretches(self, symbols: np.ndarray, of: np.ndarray) -> np.ndarray:
        """Places of the words that a window may cover."""
        if not len(symbols):
            return np.zeros(0, np.int64)
        joined = np.zeros(len(symbols) + 1, bool)  # joined[i]: word i follows word i - 1 somewhere in the block
        near = np.flatnonzero((symbols[:-1] > 0) & (symbols[1:] > 0))
        key = symbols[near] * (len(self.vocabulary) + 1) + symbols[near + 1]
        at = np.searchsorted(self.pairs, key)
        at[at == len(self.pairs)] = 0
        if len(self.pairs):
            joined[near[self.pairs[at] == key] + 1] = True
        joined[of] = False  # never across documents
        starts = np.flatnonzero(~joined[:-1] & (symbols > 0))
        ends = np.flatnonzero(~joined[1:] & (symbols > 0)) + 1
        long = ends - starts >= self.shortest
        starts, ends = starts[long], ends[long]
        if not len(starts):
            return np.zeros(0, np.int64)
        sizes = ends - starts
        return np.repeat(starts - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())

    def occurrences(self, symbols: np.ndarray, of: np.ndarray) -> Iterator[tuple[np.ndarray, int, list[tuple[str, ...]], np.ndarray]]:
        """For each window length: first words of occurrences, the length, the windows' items, which window."""
        places = self.stretches(symbols, of)
        if not len(places):
            return
        gap = np.flatnonzero((np.diff(places) > 1) | np.isin(places[1:], of))
        sequence = np.insert(symbols[places], gap + 1, 0)
        origin = np.insert(places, gap + 1, -1)
        index = FMIndex(sequence, len(self.vocabulary))
        for patterns, items in self.windows:
            low, high = index.search(patterns)
            sizes = high - low
            rows = np.repeat(low - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
            yield origin[index.locate(rows)], patterns.shape[1], items, np.repeat(np.arange(len(patterns)), sizes)


RESULT = pa.schema([("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()), ("spans", pa.list_(pa.int32()))])
TYPES = "n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean, spans array<int>"


def judge(words: np.ndarray, of: np.ndarray, blocks: Iterable[Phrases], share: int) -> Iterator[tuple]:
    """A row for each document of the shard."""
    n_docs = len(of) - 1
    edge = np.zeros(len(words) + 1, np.int32)
    items: dict[int, set[str]] = {}
    for phrases in blocks:
        symbols = phrases.symbols(words)
        for first, length, names, which in phrases.occurrences(symbols, of):
            np.add.at(edge, first, 1)
            np.add.at(edge, first + length, -1)
            docs = np.searchsorted(of, first, "right") - 1
            for d, w in {*zip(docs.tolist(), which.tolist(), strict=True)}:
                items.setdefault(d, set()).update(names[w])
    hit = np.cumsum(edge[:-1]) > 0
    total = np.concatenate([[0], np.cumsum(hit)])
    for d in range(n_docs):
        a, b = int(of[d]), int(of[d + 1])
        n_hit, spans = int(total[b] - total[a]), []
        if n_hit:
            own = np.diff(np.concatenate([[0], hit[a:b], [0]]).astype(np.int8))
            spans = np.stack([np.flatnonzero(own == 1), np.flatnonzero(own == -1)], 1).ravel().tolist()
        names = ",".join(sorted(items.get(d, ())))
        yield b - a, n_hit, len(items.get(d, ())), hashlib.sha256(names.encode()).hexdigest(), n_hit > 0 and share * n_hit >= b - a, spans


def without_words(text: str, spans: list[int]) -> str:
    """The text without the spans (first word and end, one after another) and what parts them from the next word."""
    data = np.frombuffer(text.encode(), np.uint8)
    starts, ends, _ = word_spans(data, np.array([0, len(data)]), ALNUM_WORD)
    stays = np.ones(len(data), bool)
    for first, end in zip(spans[::2], spans[1::2], strict=True):
        stays[starts[first] : starts[end] if end < len(starts) else ends[end - 1]] = False
    return data[stays].tobytes().decode()


def scan(docs: DataFrame, benchmark: DataFrame, *, width: int = 13, share: int = 20, item_col: str = "item_id", text_col: str = "text", block_bytes: int = BLOCK_BYTES, cut: bool = False) -> DataFrame:
    """docs with n_words, n_hit, n_items, items_sha256, contaminated (share * n_hit >= n_words) and spans.

    spans has the first word and the end of each removal span, one after another; cut removes them from the text.
    """
    test = benchmark.select(F.col(item_col).alias("item"), F.col(text_col).cast("string").alias("text"))
    size = F.lit(16) + F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length(F.col("item").cast("string")), F.lit(0))
    blocks = Blocks(test, size, lambda rows: Phrases.of(rows, width), block_bytes)
    added = [f.name for f in RESULT]
    kept = [c if c == text_col else fresh([x for x in docs.columns if x != c] + added, c) for c in docs.columns]
    at = docs.columns.index(text_col)
    table = docs.select(*[(F.col(f"`{c}`").cast("string") if c == text_col else F.col(f"`{c}`")).alias(n) for c, n in zip(docs.columns, kept, strict=True)])

    def run(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.shards(rows):
            words, ofs, n = [], [np.zeros(1, np.int64)], 0
            for _, _, data, offsets in chunks(batch.column(at)):
                h, of = words_of(data, offsets)
                words.append(h)
                ofs.append(of[1:] + n)
                n += len(h)
            found = judge(np.concatenate(words) if words else np.zeros(0, U64), np.concatenate(ofs), blocks, share)
            result = list(batches(found, RESULT, most_rows=len(batch) + 1, most_bytes=1 << 40))
            if result:
                own = list(batch.columns)
                if cut:
                    spans = result[0].column(len(added) - 1).to_pylist()
                    texts = batch.column(at).to_pylist()
                    own[at] = pa.array([without_words(t, s) if s else t for t, s in zip(texts, spans, strict=True)], pa.string())
                yield pa.RecordBatch.from_arrays([*own, *result[0].columns], names=[*kept, *added])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in table.schema.fields)
    return table.mapInArrow(run, f"{types}, {TYPES}")
