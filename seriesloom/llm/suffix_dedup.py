"""Removal of repeated byte strings by a distributed merge sort of sampled suffixes.

Every LENGTH-byte string contains one *anchor*: the smallest of its hashed GRAM-byte strings, the
rightmost of equals. Equal strings have their anchors at equal places, so suffixes at anchors alone
decide every repeat. The steps:

1. Anchors whose gram occurs once are dropped: each task sends every distinct gram hash once, and
   the receiver tells the anchors' documents which hashes another anchor has too.
2. The suffix at each anchor left, cut at LENGTH bytes and followed by the bytes before the anchor
   in reverse, is a key. Each part sorts its keys to a run, front-codes it, and samples it.
3. Runs are exchanged by ranges of (key, place), so that not even equal keys meet in one task, and
   merged by a loser tree that knows how much each waiting key shares with the last one out: keys
   with different shared prefixes are ordered without a look at their bytes, others are compared
   from the shared prefix on.
4. In merged order, equal keys are neighbours: all but the first are covered whole. Keys of one gram
   that differ are compared for how far they agree before and after the anchor. Grams that reach
   over a range's border send each of their LENGTH-byte strings on, by hash, the first of a task only,
   and all but the earliest are covered.
5. Covered spans meet their documents, are joined and cut out.

Strings of grams with more than FEW different keys are told apart by 128 bits of hashes; everything
else compares bytes.

Cases: a null text is empty; texts under LENGTH bytes keep all; rows that repeat an identifier count
as documents in order of their texts; a null identifier comes first; a very long text is taken in
pieces; an empty table gives no rows; other columns are kept, one with the name of a result under a
new name with an underscore before it.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import BYTE_CODE, batches, begin_end, by_part, by_parts, checkpointed, chunks, dealt, expand, fresh, id_part, mix, pack, part_count, part_of, prefix_hash, span_hash, squeeze, tidy, unpack, unpack_all

U64 = np.uint64
LENGTH, GRAM = 100, 32
BEFORE = LENGTH - GRAM
ROW = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("sid", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
TYPES = "part int, kind int, sid long, a binary, b binary"
GRAMS, PLACES, TEXT, RUN, SAMPLE, SPANS, STRINGS = range(7)
NONE, MOST_DOCS, MOST_ANCHORS = 65535, 60_000, 700_000
PIECE = 4 << 20
SAMPLES, MOST_SAMPLED, FEW, MOST_STRINGS = 24, 200_000, 6, 2_000_000
OTHER_CODE = mix(BYTE_CODE ^ U64(0xA5A5A5A5A5A5A5A5))
LOWEST = -(1 << 63)


def anchors(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the anchors of texts that lie one after another, and their grams' hashes."""
    size, w = len(data), LENGTH - GRAM + 1
    if size < LENGTH:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    prefix = prefix_hash(data)
    at = np.arange(size - GRAM + 1)
    grams = span_hash(prefix, at, at + GRAM)
    low = grams & ~U64(0xFFFFFF) | (U64(0xFFFFFF) - at.astype(U64))
    span = 1
    while 2 * span <= w:
        low = np.minimum(low[:-span], low[span:])
        span *= 2
    if w > span:
        low = np.minimum(low[: len(low) - (w - span)], low[w - span :])
    starts = np.ones(size - LENGTH + 1, bool)  # where a whole string lies in one text
    edge = np.zeros(size - LENGTH + 2, np.int32)
    inner = offsets[1:-1]
    np.add.at(edge, np.clip(inner - LENGTH + 1, 0, len(starts)), 1)
    np.add.at(edge, np.clip(inner, 0, len(starts)), -1)
    starts = np.cumsum(edge[:-1]) == 0
    marked = np.zeros(size, bool)
    marked[0xFFFFFF - (low[: len(starts)][starts] & U64(0xFFFFFF)).astype(np.int64)] = True
    found = np.flatnonzero(marked)
    return found, grams[found]


def pieces(column: pa.Array) -> Iterator[tuple[int, np.ndarray, np.ndarray, int, bool]]:
    """(first row, bytes, offsets, base, whether more of the text follows) of chunks.

    A very long text comes in pieces that overlap by a string.
    """
    for i, _, data, offsets in chunks(column):
        if len(data) <= PIECE:
            yield i, data, offsets, 0, False
        else:  # one text
            step = PIECE - LENGTH
            for base in range(0, len(data), step):
                part = data[base : base + PIECE]
                yield i, part, np.array([0, len(part)]), base, base + step < len(data)


def gram_blocks(rows: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple]:
    """Each distinct gram of a segment once, with its place; places of grams that the segment has twice."""
    ids: list[np.ndarray] = []
    docs: list[np.ndarray] = []
    places: list[np.ndarray] = []
    hashes: list[np.ndarray] = []
    state = {"docs": 0, "anchors": 0}

    def flush() -> Iterator[tuple]:
        if not state["anchors"]:
            return
        doc_ids, doc, place, gram = np.concatenate(ids), np.concatenate(docs), np.concatenate(places), np.concatenate(hashes)
        order = np.argsort(gram, kind="stable")
        doc, place, gram = doc[order], place[order], gram[order]
        starts = np.flatnonzero(np.concatenate([[True], gram[1:] != gram[:-1]]))
        count = np.diff(np.append(starts, len(gram)))
        common = np.repeat(count > 1, count)
        owner = doc_ids[doc[common]]
        for p, (d, x) in by_part(id_part(owner, n), n, owner, place[common]):
            yield p, PLACES, None, squeeze(pack(d, x)), None
        who, where = np.where(count > 1, NONE, doc[starts]).astype(np.uint16), place[starts]
        first = gram[starts]
        for p, (g, w, x) in by_part(part_of(mix(first), n), n, first, who, where):  # anchors have small hashes, so mix them
            own = np.unique(w[w != NONE])
            turn = np.full(NONE + 1, NONE, np.uint16)
            turn[own] = np.arange(len(own), dtype=np.uint16)
            key = g & U64((1 << 40) - 1)
            yield p, GRAMS, None, squeeze(np.diff(doc_ids[own], prepend=0).tobytes()), pack((key & U64(0xFFFFFFFF)).astype(np.uint32), (key >> U64(32)).astype(np.uint8), turn[w], x)

    for batch in rows:
        own = batch.column(0).fill_null(LOWEST).to_numpy()
        before = 0
        for i, data, offsets, base, more in pieces(batch.column(1)):
            found, gram = anchors(data, offsets)
            if base == 0 and i >= before:
                count = len(offsets) - 1
                ids.append(own[i : i + count])
                state["docs"] += count
                before = i + count
            first = state["docs"] - (len(offsets) - 1)
            of = np.searchsorted(offsets, found, "right") - 1
            docs.append(of + first)
            places.append((found - offsets[of] + base).astype(np.uint32))
            hashes.append(gram)
            state["anchors"] += len(found)
            if not more and (state["anchors"] >= MOST_ANCHORS or state["docs"] >= MOST_DOCS - 10_000):
                yield from flush()
                ids, docs, places, hashes = [], [], [], []
                state.update(docs=0, anchors=0)
    yield from flush()


def repeated_places(rows: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple]:
    """Places of the anchors whose gram another anchor has too."""
    low, high, ref, place, tables, base = [], [], [], [], [], 0
    for batch in rows:
        for p, kind, a, b in zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4)), strict=True):
            if kind == PLACES:
                yield p, PLACES, None, a, None
                continue
            lo, hi, who, where = unpack(b, np.uint32, np.uint8, np.uint16, np.uint32)
            table = np.cumsum(np.frombuffer(expand(a), np.int64))
            low.append(lo)
            high.append(hi)
            ref.append(np.where(who == NONE, -1, who.astype(np.int64) + base))
            place.append(where)
            tables.append(table)
            base += len(table)
    if not low:
        return
    key = np.concatenate(low).astype(U64) | np.concatenate(high).astype(U64) << U64(32)
    who, where, ids = np.concatenate(ref), np.concatenate(place), np.concatenate(tables)
    order = np.argsort(key, kind="stable")
    key, who, where = key[order], who[order], where[order]
    starts = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    count = np.diff(np.append(starts, len(key)))
    shared = np.repeat((count > 1) | (np.minimum.reduceat(who, starts) < 0), count) & (who >= 0)
    owner = ids[who[shared]]
    for p, (d, x) in by_part(id_part(owner, n), n, owner, where[shared]):
        yield p, PLACES, None, squeeze(pack(d, x)), None


def common_prefix(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    x = int.from_bytes(a[:n], "big") ^ int.from_bytes(b[:n], "big")
    return n - (x.bit_length() + 7) // 8


Item = tuple[bytes, int, int, int]  # key, identifier, turn among equal identifiers, place


def key_at(text: bytes, place: int) -> bytes:
    """The suffix from the anchor, the bytes before it in reverse, and the lengths of both."""
    right, left = text[place : place + LENGTH], text[max(0, place - BEFORE) : place][::-1]
    return right + left + bytes((len(right), len(left)))


def sides(key: bytes) -> tuple[bytes, bytes]:
    r, n = key[-2], key[-1]
    return key[:r], key[r : r + n]


def reach(r: int, left: int, place: int) -> tuple[int, int] | None:
    """The bytes that strings inside r bytes from place on and left bytes before it cover."""
    return (place - left, place + r) if r + left >= LENGTH else None


def front_coded(items: list[Item], lcps: list[int] | None = None) -> bytes:
    """A sorted run: shared length with the key before, and the rest."""
    shared, rest, before = [], [], b""
    for i, (key, *_) in enumerate(items):
        n = (lcps[i] if lcps and i else 0 if not i else common_prefix(before, key))
        shared.append(n)
        rest.append(key[n:])
        before = key
    blob = pack(np.array(shared, np.uint8), np.array([len(x) for x in rest], np.uint8), np.array([x[1] for x in items], np.int64), np.array([x[2] for x in items], np.int32), np.array([x[3] for x in items], np.uint32))
    return squeeze(blob + b"".join(rest))


def decoded(blob: bytes) -> tuple[list[Item], list[int]]:
    """A run's items, and how much each key shares with the one before."""
    raw = expand(blob)
    shared, sizes, docs, turns, places = unpack(raw, np.uint8, np.uint8, np.int64, np.int32, np.uint32)
    at = 8 + len(shared) * (1 + 1 + 8 + 4 + 4)
    items, key, lcps = [], b"", shared.tolist()
    for n, m, d, t, p in zip(lcps, sizes.tolist(), docs.tolist(), turns.tolist(), places.tolist(), strict=True):
        key = key[:n] + raw[at : at + m]
        at += m
        items.append((key, d, t, p))
    return items, lcps


class SpanList:
    """Covered spans by identifier, on their way to the documents' parts."""

    def __init__(self) -> None:
        self.held: tuple[list[int], list[int], list[int], list[int]] = ([], [], [], [])
        self.blocks: list[tuple[np.ndarray, ...]] = []

    def add(self, doc: int, turn: int, span: tuple[int, int] | None) -> None:
        if span:
            for x, v in zip(self.held, (doc, turn, *span), strict=True):
                x.append(v)

    def add_starts(self, docs: np.ndarray, turns: np.ndarray, starts: np.ndarray) -> None:
        """Strings that begin at these places, neighbouring ones as one span."""
        if len(docs):
            order = np.lexsort((starts, turns, docs))
            d, t, s = docs[order], turns[order], starts[order].astype(np.int64)
            new = np.flatnonzero(np.concatenate([[True], (d[1:] != d[:-1]) | (t[1:] != t[:-1]) | (s[1:] > s[:-1] + LENGTH)]))
            last = np.append(new[1:], len(d)) - 1
            self.blocks.append((d[new], t[new], s[new], s[last] + LENGTH))

    def rows(self, n: int) -> Iterator[tuple]:
        blocks = [*self.blocks, tuple(np.array(x, np.int64) for x in self.held)]
        docs, *rest = (np.concatenate(x) for x in zip(*blocks, strict=True))
        rest = [x.astype(k) for x, k in zip(rest, (np.int32, np.uint32, np.uint32), strict=True)]
        for p, block in by_part(id_part(docs, n), n, docs.astype(np.int64), *rest):
            yield p, SPANS, None, squeeze(pack(*block)), None


def texts_of(rows: Iterator[pa.RecordBatch], kind: int) -> tuple[list[bytes], dict[int, list[tuple[int, bytes]]], list[pa.RecordBatch]]:
    """A part's blocks of one kind, its squeezed texts by identifier with their row numbers, and these rows."""
    blocks: list[bytes] = []
    held: list[pa.RecordBatch] = []
    for batch in rows:
        kinds = batch.column(1).to_numpy()
        blocks += [x.as_py() for x, k in zip(batch.column(3), kinds.tolist(), strict=True) if k == kind]
        if (kinds == TEXT).any():
            held.append(batch.filter(pa.array(kinds == TEXT)))
    found: dict[int, list[tuple[int, bytes]]] = {}
    row = 0
    for batch in held:
        for doc, a in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            found.setdefault(doc, []).append((row, a))
            row += 1
    return blocks, found, held


def in_turn(same: list[tuple[int, bytes]]) -> list[tuple[int, bytes]]:
    """(row, text) of the rows of one identifier, in order of their texts."""
    return sorted(((row, expand(a)) for row, a in same), key=lambda x: x[1]) if len(same) > 1 else [(same[0][0], expand(same[0][1]))]


def sorted_runs(rows: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple]:
    """The part's run of distinct keys, a sample of it, and spans of keys that the part has again."""
    blocks, texts, _ = texts_of(rows, PLACES)
    docs, places = unpack_all([expand(b) for b in blocks], np.int64, np.uint32)
    order = np.lexsort((places, docs))
    docs, places = docs[order], places[order]
    starts = np.flatnonzero(np.concatenate([[True], docs[1:] != docs[:-1]])) if len(docs) else np.zeros(0, np.int64)
    items: list[Item] = []
    for s, e in begin_end(starts, len(docs)):
        doc = int(docs[s])
        own = np.unique(places[s:e]).tolist()
        for turn, (_, text) in enumerate(in_turn(texts[doc])):
            items += [(key_at(text, p), doc, turn, p) for p in own if p + GRAM <= len(text)]
    items.sort()
    spans, distinct = SpanList(), []
    for item in items:
        if distinct and distinct[-1][0] == item[0]:
            key, doc, turn, place = item
            spans.add(doc, turn, reach(key[-2], key[-1], place))
        else:
            distinct.append(item)
    yield from spans.rows(n)
    if distinct:
        yield 0, RUN, len(distinct), front_coded(distinct), None
        step = max(1, len(distinct) // SAMPLES)
        yield 0, SAMPLE, step, front_coded(distinct[step // 2 :: step]), None


def borders(samples: list[tuple[int, bytes]], n: int) -> list[Item]:
    """n - 1 items that cut all runs into ranges of like size."""
    weighed = sorted((item, step) for step, blob in samples for item in decoded(blob)[0])
    total, out, seen = sum(w for _, w in weighed), [], 0
    for item, w in weighed:
        seen += w
        if seen * n >= total * (len(out) + 1) and len(out) < n - 1:
            out.append(item)
    return sorted(set(out))


def cut_runs(rows: Iterator[pa.RecordBatch], cuts: list[Item]) -> Iterator[tuple]:
    """Runs cut at the borders, each piece front-coded again."""
    from bisect import bisect_left

    for batch in rows:
        for blob in batch.column(3).to_pylist():
            items, lcps = decoded(blob)
            at = [0, *(bisect_left(items, c) for c in cuts), len(items)]
            for p, (s, e) in enumerate(zip(at[:-1], at[1:], strict=True)):
                if e > s:
                    yield p, RUN, None, front_coded(items[s:e], lcps[s:e]), None


class LoserTree:
    """Merges sorted runs; iterates over (shared length with the item before, item).

    Each waiting item carries the length that it shares with the last item out. Of two waiting items
    the one that shares more is smaller; only equal lengths need a look at the bytes after them.
    """

    def __init__(self, runs: list[tuple[list[Item], list[int]]]) -> None:
        self.size = 1 << max(0, (len(runs) - 1).bit_length())
        self.runs = runs
        self.at = [0] * len(runs)
        self.item: list[Item | None] = [r[0][0] for r in runs] + [None] * (self.size - len(runs))
        self.shared = [0] * self.size
        self.loser = [0] * self.size
        self.winner = self.play(1)

    def play(self, node: int) -> int:
        if node >= self.size:
            return node - self.size
        winner, self.loser[node] = self.match(self.play(2 * node), self.play(2 * node + 1))
        return winner

    def match(self, x: int, y: int) -> tuple[int, int]:
        a, b = self.item[x], self.item[y]
        if a is None or b is None:
            return (y, x) if a is None else (x, y)
        n, m = self.shared[x], self.shared[y]
        if n != m:
            return (x, y) if n > m else (y, x)
        s, t = a[0], b[0]
        if s == t:
            win, lose, same = (x, y, len(s)) if a < b else (y, x, len(s))
        else:
            same = n + common_prefix(s[n:], t[n:])
            win, lose = (x, y) if s[same:] < t[same:] else (y, x)
        self.shared[lose] = same
        return win, lose

    def __iter__(self) -> Iterator[tuple[int, Item]]:
        item, shared, loser, size, match, runs, at = self.item, self.shared, self.loser, self.size, self.match, self.runs, self.at
        winner = self.winner
        while (out := item[winner]) is not None:
            yield shared[winner], out
            items, lcps = runs[winner]
            at[winner] = i = at[winner] + 1
            if i < len(items):
                item[winner], shared[winner] = items[i], lcps[i]
            else:
                item[winner] = None
            node = (winner + size) >> 1
            while node:
                winner, loser[node] = match(winner, loser[node])
                node >>= 1


def first_places(one: np.ndarray, two: np.ndarray, docs: np.ndarray, turns: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of each string's earliest place, and rows of its other places. A place can come more than once."""
    order = np.lexsort((starts, turns, docs, two, one))
    a, b, d, t, s = (x[order] for x in (one, two, docs, turns, starts))
    begin = np.flatnonzero(np.concatenate([[True], (a[1:] != a[:-1]) | (b[1:] != b[:-1])])) if len(a) else np.zeros(0, np.int64)
    first = np.repeat(begin, np.diff(np.append(begin, len(a))))
    later = (d != d[first]) | (t != t[first]) | (s != s[first])
    return order[begin], order[later]


def resolve(group: list[Item], wide: bool, spans: SpanList, strings: list[tuple[np.ndarray, ...]]) -> None:
    """Cover what keys of one gram repeat of each other; keys of a wide group also go on as strings."""
    group.sort(key=lambda x: x[1:])
    parts = [sides(x[0]) for x in group]
    if not wide and len(group) <= FEW:
        for i in range(1, len(group)):
            right, left = parts[i]
            _, doc, turn, place = group[i]
            for j in range(i):
                spans.add(doc, turn, reach(common_prefix(right, parts[j][0]), common_prefix(left, parts[j][1]), place))
        return
    left = np.array([len(x) for _, x in parts])
    size = left + np.array([len(x) for x, _ in parts])
    text = np.frombuffer(b"".join(x[::-1] + y for y, x in parts), np.uint8)
    begin = np.cumsum(size) - size
    count = np.maximum(0, np.minimum(left, size - LENGTH) + 1)
    item = np.repeat(np.arange(len(group)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    docs, turns, places = (np.array(x, np.int64) for x in list(zip(*group, strict=True))[1:])
    starts = (places - left)[item] + nth
    at = begin[item] + nth
    one, two = (span_hash(prefix_hash(text, codes), at, at + LENGTH) for codes in (BYTE_CODE, OTHER_CODE))
    passes = 1 + len(item) // MOST_STRINGS
    for k in range(passes):  # strings of like hash stay together
        mine = np.flatnonzero(one % U64(passes) == k) if passes > 1 else np.arange(len(item))
        block = one[mine], two[mine], docs[item[mine]], turns[item[mine]], starts[mine]
        first, later = first_places(*block)
        spans.add_starts(*(x[later] for x in block[2:]))
        if wide:
            strings.append(tuple(x[first] for x in block))


def merged(rows: Iterator[pa.RecordBatch], cuts: list[Item], n: int) -> Iterator[tuple]:
    """Spans that the range's keys repeat, and strings of groups that may go on elsewhere."""
    runs, part = [], 0
    for batch in rows:
        for p, blob in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), strict=True):
            part = p
            runs.append(decoded(blob))
    if not runs:
        return
    edges = {c[0][:GRAM] for c in cuts[max(0, part - 1) : part + 1]}
    spans, strings = SpanList(), []
    group: list[Item] = []

    def finish() -> None:
        wide = group[0][0][:GRAM] in edges
        if wide or len(group) > 1:
            resolve(group, wide, spans, strings)

    for shared, item in LoserTree(runs):
        if group and shared >= GRAM:
            if shared == len(item[0]) == len(last):
                key, doc, turn, place = item
                spans.add(doc, turn, reach(key[-2], key[-1], place))
                continue
        elif group:
            finish()
            group = []
        last = item[0]
        group.append(item)
    finish()
    yield from spans.rows(n)
    if strings:
        one, two, docs, turns, starts = (np.concatenate(x) for x in zip(*strings, strict=True))
        first, _ = first_places(one, two, docs, turns, starts)
        block = one[first], two[first], docs[first], turns[first].astype(np.int32), starts[first].astype(np.uint32)
        for p, x in by_part(part_of(mix(one[first]), n), n, *block):
            yield p, STRINGS, None, pack(*x), None


def repeated_strings(rows: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple]:
    """Spans of the strings that an earlier place has too."""
    blocks = []
    for batch in rows:
        blocks += batch.column(3).to_pylist()
    one, two, docs, turns, starts = unpack_all(blocks, U64, U64, np.int64, np.int32, np.uint32)
    _, later = first_places(one, two, docs, turns, starts)
    spans = SpanList()
    spans.add_starts(docs[later], turns[later], starts[later])
    yield from spans.rows(n)


def step(df: DataFrame, f, *args) -> DataFrame:
    """f over each partition's record batches."""
    return df.mapInArrow(lambda rows: batches(f(rows, *args), ROW), TYPES)


def received(f, *args):
    """A pass over the record batches of a partition: f over those of each part."""
    return lambda rows: (batch for part in by_parts(rows) for batch in batches(f(part, *args), ROW))


def exchange(df: DataFrame, n: int, f, *args) -> DataFrame:
    """f over the rows of each of the n parts."""
    return dealt(df, n).mapInArrow(received(f, *args), TYPES)


def covered(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which bytes the spans cover."""
    edge = np.zeros(size + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, ends, -1)
    return np.cumsum(edge[:-1]) > 0


def kept_text(data: np.ndarray, gone: np.ndarray) -> str:
    """The text without the code points that are covered whole."""
    first = (data & 0xC0) != 0x80
    point = np.cumsum(first) - 1
    stays = np.zeros(int(point[-1]) + 1 if len(point) else 0, bool)
    stays[point[~gone]] = True
    return data[stays[point]].tobytes().decode() if len(point) else ""


@tidy
def trim(docs: DataFrame, *, id_col: str = "doc_id", text_col: str = "text", with_text: bool = False) -> DataFrame:
    """docs without the text, with n_bytes, n_removed, n_spans and kept_sha256 of each whole text.

    with_text adds the text again, without the code points whose bytes are all covered.
    """
    spark = docs.sparkSession
    n = part_count(docs)
    added = ["n_bytes", "n_removed", "n_spans", "kept_sha256", *([text_col] if with_text else [])]
    kept = [c for c in docs.columns if c != text_col]
    shown = [fresh([x for x in docs.columns if x != c] + added, c) for c in kept]
    table = docs.select(F.col(id_col).cast("long"), F.col(text_col).cast("string"), *[F.col(f"`{c}`").alias(f"__{n}") for c, n in zip(kept, shown, strict=True)])
    short = table.select(F.col(id_col), F.col(text_col))
    extra = [f"`__{n}` {docs.schema[c].dataType.simpleString()}" for c, n in zip(kept, shown, strict=True)]

    def texts(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in rows:
            ids = batch.column(0).fill_null(LOWEST)
            part = pa.array(id_part(ids.to_numpy(), n))
            blobs = pa.array([squeeze((x or "").encode()) for x in batch.column(1).to_pylist()], pa.binary())
            rest = [pa.array([TEXT] * len(batch), pa.int32()), ids, blobs, pa.nulls(len(batch), pa.binary())]
            yield pa.RecordBatch.from_arrays([part, *rest, *batch.columns[2:]], names=[*ROW.names, *batch.schema.names[2:]])

    places = exchange(step(short, gram_blocks, n), n, repeated_places, n)
    plain = short.mapInArrow(lambda rows: texts_only(texts(rows)), TYPES)
    runs = checkpointed(dealt(places.union(plain), n), received(sorted_runs, n), TYPES)
    sampled = runs.where((F.col("kind") == SAMPLE) & (F.rand(7) < MOST_SAMPLED / max(MOST_SAMPLED, SAMPLES * n)))
    samples = [(r.sid, bytes(r.a)) for r in sampled.select("sid", "a").collect()]  # MOST_SAMPLED keys or so, which only balance the ranges
    cuts = spark.sparkContext.broadcast(borders(samples, n))
    pieces_ = step(runs.where(F.col("kind") == RUN), lambda rows: cut_runs(rows, cuts.value))
    ranged = checkpointed(dealt(pieces_, n), received(lambda rows: merged(rows, cuts.value, n)), TYPES)
    strings = exchange(ranged.where(F.col("kind") == STRINGS), n, repeated_strings, n)
    spans = runs.where(F.col("kind") == SPANS).union(ranged.where(F.col("kind") == SPANS)).union(strings)

    whole = table.mapInArrow(texts, ", ".join([TYPES, *extra]))
    both = dealt(whole.unionByName(spans, allowMissingColumns=True), n)

    def cut(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        blocks, found, held = texts_of(rows, SPANS)
        ids, turns, starts, ends = unpack_all([expand(b) for b in blocks], np.int64, np.int32, np.uint32, np.uint32)
        order = np.lexsort((turns, ids))
        ids, turns, starts, ends = ids[order], turns[order], starts[order], ends[order]
        number = {}
        for doc, same in found.items():
            if len(same) > 1:
                number.update((row, t) for t, (row, _) in enumerate(in_turn(same)))
        row = 0
        for big in held:
            for k in range(0, len(big), 512):
                batch = big.slice(k, 512)
                out = []
                for doc, a in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
                    text = expand(a)
                    s, e = np.searchsorted(ids, [doc, doc + 1]) if doc != 2**63 - 1 else (np.searchsorted(ids, doc), len(ids))
                    mine = slice(s, e)
                    if e > s and doc in found and len(found[doc]) > 1:
                        mine = np.flatnonzero(turns[s:e] == number[row]) + s
                    row += 1
                    if e == s or not len(starts[mine]):
                        out.append((len(text), 0, 0, hashlib.sha256(text).hexdigest(), *([text.decode()] if with_text else [])))
                        continue
                    data = np.frombuffer(text, np.uint8)
                    gone = covered(len(data), starts[mine].astype(np.int64), ends[mine].astype(np.int64))
                    n_spans = int(gone[0]) + int((gone[1:] & ~gone[:-1]).sum())
                    out.append((len(text), int(gone.sum()), n_spans, hashlib.sha256(data[~gone].tobytes()).hexdigest(), *([kept_text(data, gone)] if with_text else [])))
                types = [pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
                columns = [pa.array(c, t) for c, t in zip(zip(*out, strict=True), types, strict=False)]
                yield pa.RecordBatch.from_arrays([*batch.columns[len(ROW.names) :], *columns], names=[*shown, *added])

    types = [x.replace("`__", "`", 1) for x in extra] + ["n_bytes long", "n_removed long", "n_spans long", "kept_sha256 string"] + [f"`{text_col}` string"] * with_text
    return both.mapInArrow(lambda rows: (batch for part in by_parts(rows) for batch in cut(part)), ", ".join(types))


def texts_only(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The exchange's own columns."""
    for batch in rows:
        yield batch.select(ROW.names)
