"""Exact self-join of documents on word-shingle sets by Jaccard similarity, and its components.

1. *Extended prefixes.* Shingles have one global order, that of their hashes. Of a set of n, the first
   n - ceil(t n) + K tokens (K = 1 + n/SHARE) contain at least K tokens of any similar set. Documents with
   fewer tokens that occur in another document's prefix cannot have a partner and leave.
2. *Copies.* Equal sets become one; sets are told apart by 128 bits.
3. *Frequencies.* Over the sets left, tokens are counted exactly; sets whose tokens of two or more sets
   fall short of ceil(t n) leave.
4. *Token combinations.* Tokens are ordered rare first. Rare tokens of the plain prefix are indexed
   singly. Frequent ones are indexed as combinations of two that follow each other in the order,
   within a prefix of n/2 + 2 tokens: two similar sets that share no rare token there share such a
   pair. (Of the first n/2 + 2 tokens of the set whose prefix ends first, a are not shared; each breaks
   at most two pairs, each of the b unshared tokens of the other set at most one, and 2a + b <= n/2.)
5. *Verification.* Each set goes to a few of its longest lists, which ones a hash of the lists' keys
   draws, and the sets of a list are compared as bit rows, in blocks of bounded size: a set that is
   linked is not looked for again. Components follow. Components that still share a list make groups: the sets of a
   group that is small, or most of which one list names, are compared by pairs of blocks, and in another group each
   set is compared with the whole of each larger component that it shares a list with, again in blocks. One link
   joins components. Sets inside one component are not compared.

Cases: null and empty texts, and texts without words, have no shingles and stand alone; a text of
fewer than k words has one, of all its words; repeated rows are all returned; a very long text is one
set like others; other columns are ignored; an empty table gives no rows. A null identifier's component
is the smallest one linked, or null; rows that share an identifier are rows of their own.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import batches, begin_end, by_part, by_parts, checkpointed, chunks, dealt, discard, expand, id_part, mix, pack, part_count, part_of, shingle_sets, spread_join, squeeze, tidy, unpack, unpack_all
from ._components import components

U64 = np.uint64
ROW = pa.schema([("part", pa.int32()), ("kind", pa.int32()), ("sid", pa.int64()), ("a", pa.binary()), ("b", pa.binary())])
TYPES = "part int, kind int, sid long, a binary, b binary"
TOKENS, VOTES, TEXT, SET, REPLY, LISTS, LABELS, QUERY, MEMBER, NESTED = range(10)
NONE, MOST_DOCS, MOST_TOKENS = 65535, 60_000, 1_000_000
SHARE, RARE, ROUNDS, BLOCK, NESTED_BLOCKS = 8, 16, 3, 512, 8
WORTH = 16  # m sets go to m * m / BLOCK places by pairs of blocks; a list of w components asks w * w / 2 times: as much at m = w * WORTH
MOST_TOLD = 500_000


def need(n: np.ndarray | int, percent: int):
    """The least number of tokens that a set of n shares with a similar one."""
    return -(-percent * n // 100)


def low_part(tokens: np.ndarray, n: int) -> np.ndarray:
    """Destination by the lower bits, which the order of tokens leaves even."""
    return ((tokens & U64(0xFFFFFFFF)) * U64(n) >> U64(32)).astype(np.int32)


def run_starts(keys: np.ndarray) -> np.ndarray:
    return np.flatnonzero(np.concatenate([[True], keys[1:] != keys[:-1]])) if len(keys) else np.zeros(0, np.int64)


def prefix_blocks(rows: Iterator[pa.RecordBatch], n: int, k: int, percent: int) -> Iterator[tuple]:
    """Tokens of the extended prefixes, each once for all documents of a segment that share it; votes of these."""
    ids: list[int] = []
    tokens: list[np.ndarray] = []
    size = 0

    def flush() -> Iterator[tuple]:
        doc_ids = np.array(ids, np.int64)
        all_tokens = np.concatenate(tokens) if tokens else np.zeros(0, U64)
        owner = np.repeat(np.arange(len(tokens)), [len(x) for x in tokens])
        order = np.argsort(all_tokens, kind="stable")
        all_tokens, owner = all_tokens[order], owner[order]
        starts = run_starts(all_tokens)
        count = np.diff(np.append(starts, len(all_tokens)))
        common = np.repeat(count > 1, count)
        votes = np.bincount(owner[common], minlength=len(doc_ids))
        voted = np.flatnonzero(votes)
        for p, (d, v) in by_part(id_part(doc_ids[voted], n), n, doc_ids[voted], votes[voted].astype(np.int32)):
            yield p, VOTES, None, pack(d, v), None
        first, who = all_tokens[starts], np.where(count > 1, NONE, owner[starts]).astype(np.uint16)
        for p, (t, w) in by_part(low_part(first, n), n, first, who):
            key = t >> U64(24)
            own = np.unique(w[w != NONE])
            place = np.full(NONE + 1, NONE, np.uint16)
            place[own] = np.arange(len(own), dtype=np.uint16)
            yield p, TOKENS, None, squeeze(np.diff(doc_ids[own], prepend=0).tobytes()), pack((key & U64(0xFFFFFFFF)).astype(np.uint32), (key >> U64(32)).astype(np.uint8), place[w])

    for batch in rows:
        doc_ids = batch.column(0).to_pylist()
        for i, _, data, offsets in chunks(batch.column(1)):
            for d, found in enumerate(shingle_sets(data, offsets, k)):
                if m := len(found):
                    ids.append(doc_ids[i + d] or 0)
                    tokens.append(found[: m - need(m, percent) + 1 + m // SHARE])
                    size += len(tokens[-1])
            if size >= MOST_TOKENS or len(ids) >= MOST_DOCS - 10_000:
                yield from flush()
                ids, tokens, size = [], [], 0
    yield from flush()


def count_votes(rows: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple]:
    """For each document, how many of its prefix tokens occur in another document's prefix."""
    keys, refs, base = [], [], 0
    tables = []
    for batch in rows:
        for kind, p, a, b in zip(*(batch.column(c).to_pylist() for c in (1, 0, 3, 4)), strict=True):
            if kind == VOTES:
                yield p, VOTES, None, a, None
                continue
            low, high, who = unpack(b, np.uint32, np.uint8, np.uint16)
            table = np.cumsum(np.frombuffer(expand(a), np.int64))
            keys.append(low.astype(U64) | high.astype(U64) << U64(32))
            refs.append(np.where(who == NONE, -1, who.astype(np.int64) + base))
            tables.append(table)
            base += len(table)
    if not keys:
        return
    key, ref, ids = np.concatenate(keys), np.concatenate(refs), np.concatenate(tables)
    order = np.argsort(key, kind="stable")
    key, ref = key[order], ref[order]
    starts = run_starts(key)
    count = np.diff(np.append(starts, len(key)))
    shared = (count > 1) | (np.minimum.reduceat(ref, starts) < 0)
    ref = ref[np.repeat(shared, count)]
    votes = np.bincount(ref[ref >= 0], minlength=len(ids))
    voted = np.flatnonzero(votes)
    for p, (d, v) in by_part(id_part(ids[voted], n), n, ids[voted], votes[voted].astype(np.int32)):
        yield p, VOTES, None, pack(d, v), None


FOUND = pa.schema([("doc_id", pa.int64()), ("n", pa.int64()), ("sid", pa.int64()), ("more", pa.int64()), ("tokens", pa.binary())])


def set_id(tokens: bytes, bits: int) -> tuple[int, int]:
    """A name of so many bits for a set, and 64 bits more that tell sets of one name apart."""
    digest = hashlib.blake2b(tokens, digest_size=16).digest()
    return int.from_bytes(digest[:8], "little", signed=True) >> 64 - bits, int.from_bytes(digest[8:], "little", signed=True)


def select_sets(rows: Iterator[pa.RecordBatch], k: int, percent: int, bits: int) -> Iterator[tuple]:
    """doc_id and set size of every document; set id and tokens of those with votes enough."""
    votes, texts = [], []
    for batch in rows:
        for kind, sid, a, b in zip(*(batch.column(c).to_pylist() for c in (1, 2, 3, 4)), strict=True):
            if kind == VOTES:
                votes.append(a)
            else:
                texts.append((None if b else sid, a))
    ids, counts = unpack_all(votes, np.int64, np.int32)
    order = np.argsort(ids, kind="stable")
    ids, counts = ids[order], counts[order]
    starts = run_starts(ids)
    total = dict(zip(ids[starts].tolist(), np.add.reduceat(counts, starts).tolist() if len(starts) else [], strict=True))
    for i in range(0, len(texts), 64):
        part = texts[i : i + 64]
        column = pa.array([expand(x) for _, x in part], pa.binary())
        at = 0
        for _, _, data, offsets in chunks(column):
            for found in shingle_sets(data, offsets, k):
                doc_id, m = part[at][0], len(found)
                at += 1
                if m and total.get(doc_id or 0, 0) > need(m, percent) // SHARE:
                    tokens = found.tobytes()
                    yield doc_id, m, *set_id(tokens, bits), tokens
                else:
                    yield doc_id, m, None, None, None


def one_of_copies(rows: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple]:
    """One row for each set."""
    seen: set[int] = set()
    for batch in rows:
        sids = batch.column(0).to_numpy()
        for sid, p, size, tokens in zip(sids.tolist(), id_part(sids, n).tolist(), batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
            if sid not in seen:
                seen.add(sid)
                yield p, SET, sid, tokens, size.to_bytes(8, "little")


def token_counts(rows: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple]:
    """Each token of a part's sets once, with the number of these sets."""
    found, origin = [], 0
    for batch in rows:
        if len(batch):
            origin = batch.column(0)[0].as_py()
        found += [np.frombuffer(x, U64) for x in batch.column(3).to_pylist()]
    if found:
        tokens, counts = np.unique(np.concatenate(found), return_counts=True)
        for p, (t, c) in by_part(low_part(tokens, n), n, tokens, counts.astype(np.int64)):
            yield p, TOKENS, origin, squeeze(pack(t, c, c)), None


def answer(rows: Iterator[pa.RecordBatch], judge: Callable) -> Iterator[tuple]:
    """Tally keys over all parts and tell each part about its keys: judge gives which matter, and a value."""
    keys, first, second, origins = [], [], [], []
    for batch in rows:
        for origin, a in zip(batch.column(2).to_pylist(), batch.column(3).to_pylist(), strict=True):
            t, x, y = unpack(expand(a), U64, np.int64, np.int64)
            keys.append(t)
            first.append(x)
            second.append(y)
            origins.append(np.full(len(t), origin, np.int32))
    if not keys:
        return
    key, x, y, origin = map(np.concatenate, (keys, first, second, origins))
    order = np.argsort(key, kind="stable")
    key, x, y, origin = key[order], x[order], y[order], origin[order]
    starts = run_starts(key)
    matters, value = judge(x, y, starts)
    size = np.diff(np.append(starts, len(key)))
    matters, value = np.repeat(matters, size), np.repeat(value, size)
    key, origin, value = key[matters], origin[matters], value[matters]
    for p in np.unique(origin).tolist():
        mine = origin == p
        yield p, REPLY, None, squeeze(pack(key[mine], value[mine])), None


def shared_by_two(x: np.ndarray, y: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    total = np.add.reduceat(x, starts)
    return total > 1, total


def of_two_components(x: np.ndarray, y: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return np.minimum.reduceat(x, starts) < np.maximum.reduceat(y, starts), starts


def gathered(rows: Iterator[pa.RecordBatch]) -> tuple[dict[int, list[tuple]], int | None]:
    """Rows of a part by kind, and the part's number."""
    out: dict[int, list[tuple]] = {}
    part = None
    for batch in rows:
        for p, kind, sid, a, b in zip(*(c.to_pylist() for c in batch.columns[:5]), strict=True):
            part = p
            out.setdefault(kind, []).append((sid, a, b))
    return out, part


def index_sets(rows: Iterator[pa.RecordBatch], percent: int, rare: int) -> Iterator[tuple]:
    """Shared tokens of the sets that can have a partner, and the lists' keys: rare tokens, pairs of frequent ones."""
    found, part = gathered(rows)
    tokens, counts = unpack_all([expand(a) for _, a, _ in found.get(REPLY, [])], U64, np.int64)
    order = np.argsort(tokens, kind="stable")
    tokens, counts = tokens[order], counts[order]
    keys, owners, sizes = [], [], []
    for sid, a, b in found.get(SET, []):
        own, n = np.frombuffer(a, U64), int.from_bytes(b, "little")
        at = np.searchsorted(tokens, own)
        at[at == len(tokens)] = 0
        shared = tokens[at] == own if len(tokens) else np.zeros(len(own), bool)
        if shared.sum() < need(n, percent):
            continue
        own, count = own[shared], counts[at[shared]]
        yield part, SET, sid, own.tobytes(), b
        turn = np.lexsort((own, count))
        own, count = own[turn], count[turn]
        alone = n - len(own)  # tokens of this set only come first in the order
        plain, longer = max(0, n - need(n, percent) + 1 - alone), max(0, n // 2 + 2 - alone)
        single = own[:plain][count[:plain] <= rare]
        many = own[:longer][count[:longer] > rare]
        pair = mix(many[:-1] * U64(0x9E3779B97F4A7C15) + many[1:]) ^ U64(1 << 63)
        if plain and not len(pair) and len(many):  # a single frequent token ends the set
            pair = mix(many)
        keys += [single, pair]
        owners += [np.full(len(single) + len(pair), sid, np.int64)]
        sizes += [np.full(len(single) + len(pair), n, np.int64)]
    if keys:
        yield part, LISTS, None, squeeze(pack(np.concatenate(keys), np.concatenate(owners), np.concatenate(sizes))), None


def labelled_lists(found: dict[int, list[tuple]]) -> tuple[np.ndarray, ...]:
    """Keys, sets, sizes, components and their numbers of sets of a part's lists, sorted by key and set."""
    key, sid, size = unpack_all([expand(a) for _, a, _ in found.get(LISTS, [])], U64, np.int64, np.int64)
    nodes, roots, members = unpack_all([a for _, a, _ in found.get(LABELS, [])], np.int64, np.int64, np.int64)
    comp, many = sid.copy(), np.ones(len(sid), np.int64)
    if len(nodes):
        order = np.argsort(nodes, kind="stable")
        nodes, roots, members = nodes[order], roots[order], members[order]
        at = np.minimum(np.searchsorted(nodes, sid), len(nodes) - 1)
        known = nodes[at] == sid
        comp[known], many[known] = roots[at[known]], members[at[known]]
    order = np.lexsort((sid, key))
    return key[order], sid[order], size[order], comp[order], many[order]


def fits(a: np.ndarray, b: np.ndarray, percent: int) -> np.ndarray:
    """Whether sets of these sizes can be similar."""
    return np.minimum(a, b) * 100 >= percent * np.maximum(a, b)


LINK = pa.schema([("u", pa.int64()), ("v", pa.int64())])


def chosen_lists(rows: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple]:
    """Each set on its way to a few of its longest lists; a list with many sets of the part is dealt to several blocks."""
    found, _ = gathered(rows)
    key, sid, _ = unpack_all([expand(a) for _, a, _ in found.get(LISTS, [])], U64, np.int64, np.int64)
    _, place, count = np.unique(key, return_inverse=True, return_counts=True)
    popular = np.log2(count[place]).astype(np.int64)
    chosen: dict[int, list[int]] = {}
    for turn in range(1, ROUNDS + 1):
        drawn = mix(key ^ U64(turn * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        order = np.lexsort((drawn, -popular, sid))
        first = order[run_starts(sid[order])]
        keys, back, counts = np.unique(key[first], return_inverse=True, return_counts=True)
        blocks = np.where(counts[back] > 1, -(-counts[back] * n // BLOCK), 1)
        block = mix(sid[first].view(U64) ^ U64(turn)) % blocks.astype(U64)
        for s, name in zip(sid[first].tolist(), (key[first] + block * U64(0x9E3779B97F4A7C15)).tolist(), strict=True):
            chosen.setdefault(s, []).append(name)
    for s, a, b in found.get(SET, []):
        for name in dict.fromkeys(chosen.get(s, ())):
            yield int(part_of(mix(np.array([name], U64)), n)[0]), SET, s, a, b + name.to_bytes(8, "little")


def bit_rows(token_sets: list[np.ndarray], universe: np.ndarray) -> np.ndarray:
    """A row of bits for each set over the sorted universe; tokens outside it are left out."""
    out = np.zeros((len(token_sets), -(-len(universe) // 8)), np.uint8)
    for k in range(0, len(token_sets), 64):
        part = token_sets[k : k + 64]
        row = np.zeros((len(part), len(universe)), bool)
        for i, x in enumerate(part):
            at = np.minimum(np.searchsorted(universe, x), len(universe) - 1)
            row[i, at[universe[at] == x]] = True
        out[k : k + 64] = np.packbits(row, axis=1)
    return out


def similar(row: np.ndarray, size: int, others: np.ndarray, sizes: np.ndarray, percent: int) -> np.ndarray:
    """Which of the others' bit rows are similar to a bit row."""
    same = np.bitwise_count(others & row).sum(1, dtype=np.int64)
    return 100 * same >= percent * (size + sizes - same)


def links_in_block(sids: list[int], token_sets: list[np.ndarray], sizes: np.ndarray, percent: int) -> Iterator[tuple[int, int]]:
    """Links that join the block's similar sets, found from one set to those not yet reached."""
    tokens, counts = np.unique(np.concatenate(token_sets), return_counts=True)
    universe = tokens[counts > 1]
    if not len(universe):
        return
    bits = bit_rows(token_sets, universe)
    left = np.arange(len(sids))
    while len(left):
        queue, left = [left[0]], left[1:]
        while queue and len(left):
            x = queue.pop()
            hit = similar(bits[x], sizes[x], bits[left], sizes[left], percent)
            for y in left[hit].tolist():
                yield sids[x], sids[y]
                queue.append(y)
            left = left[~hit]


def links_of_lists(rows: Iterator[pa.RecordBatch], percent: int) -> Iterator[tuple[int, int]]:
    """Links among the sets that chose the same list, in blocks."""
    lists: dict[bytes, list[tuple]] = {}
    for sid, a, b in gathered(rows)[0].get(SET, []):
        lists.setdefault(b[8:], []).append((sid, np.frombuffer(a, U64), int.from_bytes(b[:8], "little")))
    for members in lists.values():
        for i in range(0, len(members), BLOCK):
            sids, token_sets, sizes = zip(*members[i : i + BLOCK], strict=True)
            if len(sids) > 1:
                yield from links_in_block(list(sids), list(token_sets), np.array(sizes), percent)


def components_of_lists(rows: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple]:
    """The smallest and largest component of each list of a part."""
    found, part = gathered(rows)
    key, _, _, comp, _ = labelled_lists(found)
    starts = run_starts(key)
    if len(starts):
        low, high = np.minimum.reduceat(comp, starts), np.maximum.reduceat(comp, starts)
        for p, block in by_part(low_part(key[starts], n), n, key[starts], low, high):
            yield p, TOKENS, part, squeeze(pack(*block)), None


def open_lists(rows: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple]:
    """Entries of the lists that hold several components."""
    found, _ = gathered(rows)
    lists = labelled_lists(found)
    wanted = np.sort(unpack_all([expand(a) for _, a, _ in found.get(REPLY, [])], U64, np.int64)[0])
    if len(wanted) and len(lists[0]):
        at = np.minimum(np.searchsorted(wanted, lists[0]), len(wanted) - 1)
        mine = wanted[at] == lists[0]
        for p, block in by_part(low_part(lists[0][mine], n), n, *(x[mine] for x in lists)):
            yield p, LISTS, None, squeeze(pack(*block)), None


def distinct_lists(rows: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple]:
    """Whole lists under a name made of their sets: of lists of the same sets, which ask the same, one.

    Lists of one name are compared set by set; other sets that happen to have the name go along under it.
    """
    key, sid, size, comp, many = list_blocks(rows)
    starts = run_starts(key)
    if not len(starts):
        return
    count = np.diff(np.append(starts, len(key)))
    name = mix(np.add.reduceat(mix(sid.view(U64)), starts) ^ count.astype(U64))
    _, first, group = np.unique(name, return_index=True, return_inverse=True)
    model = first[group]  # the first list of each one's name
    at = np.repeat(starts[model] - starts, count) + np.arange(len(key))
    alike = sid == sid[np.minimum(at, len(key) - 1)]
    copies = np.logical_and.reduceat(alike, starts) & (count == count[model])
    copies[first] = False
    mine = np.repeat(~copies, count)
    names = np.repeat(name, count)[mine]
    for p, block in by_part(low_part(names, n), n, names, *(x[mine] for x in (sid, size, comp, many))):
        yield p, LISTS, None, squeeze(pack(*block)), None


def list_blocks(rows: Iterator[pa.RecordBatch]) -> tuple[np.ndarray, ...]:
    """Entries of a part's lists, sorted by key, components in ascending order of their sets, and set."""
    blocks = []
    for batch in rows:
        blocks += batch.column(3).to_pylist()
    key, sid, size, comp, many = unpack_all([expand(b) for b in blocks], U64, np.int64, np.int64, np.int64, np.int64)
    order = np.lexsort((sid, comp, many, key))
    return key[order], sid[order], size[order], comp[order], many[order]


PAIR = pa.schema([("u", pa.int64()), ("v", pa.int64()), ("mu", pa.int64()), ("mv", pa.int64())])
PAIR_TYPES = "u long, v long, mu long, mv long"


def told_once(pairs: np.ndarray, n: int) -> Iterator[tuple]:
    """Rows of four numbers, each once, packed for the part of the first."""
    once = np.unique(pairs, axis=0)
    for p, block in by_part(id_part(once[:, 0].copy(), n), n, *(x.copy() for x in once.T)):
        yield p, LISTS, None, squeeze(pack(*block)), None


def pairs_told(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The rows of four numbers that any part told, each once."""
    blocks = []
    for batch in rows:
        blocks += batch.column(3).to_pylist()
    if blocks:
        yield from map(tuple, np.unique(np.stack(unpack_all([expand(b) for b in blocks], *[np.int64] * 4), 1), axis=0).tolist())


def hub_links(rows: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple]:
    """(component, the list's largest, numbers of sets of both) of each list: what shares lists hangs together.

    (component, itself, w, 0) besides: of the lists whose largest it is, one has w components and none more.
    """
    key, _, _, comp, many = list_blocks(rows)
    starts = run_starts(key)
    if len(starts):
        count = np.diff(np.append(starts, len(key)))
        last = starts + count - 1
        hub = np.repeat(last, count)
        begins = np.concatenate([[True], (comp[1:] != comp[:-1]) | (key[1:] != key[:-1])])
        width, largest = np.add.reduceat(begins.astype(np.int64), starts), comp[last]
        order = np.lexsort((-width, largest))
        widest = order[run_starts(largest[order])]
        yield from told_once(np.stack([largest[widest], largest[widest], width[widest], np.zeros(len(widest), np.int64)], 1), n)
        yield from told_once(np.stack([comp, comp[hub], many, many[hub]], 1)[comp != comp[hub]], n)


def open_questions(rows: Iterator[pa.RecordBatch], n: int, percent: int) -> Iterator[tuple]:
    """(set, component, 0, the component's number of sets) for sets that share a list with a larger component."""
    key, sid, size, comp, many = list_blocks(rows)
    found: list[np.ndarray] = []
    held = 0
    for s, e in begin_end(run_starts(key), len(key)):
        at = s + np.flatnonzero(np.concatenate([[True], sid[s + 1 : e] != sid[s : e - 1]]))  # the same list can come from several parts
        for i, x in enumerate(at[:-1].tolist()):
            rest = at[i + 1 :]  # components stand in ascending order of their sets
            ok = rest[(comp[rest] != comp[x]) & fits(size[rest], size[x], percent)]
            if len(ok):
                found.append(np.stack([np.full(len(ok), sid[x]), comp[ok], np.zeros(len(ok), np.int64), many[ok]], 1))
                held += len(ok)
            if held > MOST_TOLD:  # within a list: it asks as often as the square of its components
                yield from told_once(np.concatenate(found), n)
                found, held = [], 0
    if found:
        yield from told_once(np.concatenate(found), n)


def named(*numbers: int) -> int:
    """One 64-bit name for some numbers."""
    out = 0
    for x in numbers:
        out = int(mix(np.array([(out + x) & (1 << 64) - 1], U64))[0])
    return out


def asked(rows: Iterator[pa.RecordBatch], n: int) -> Iterator[tuple]:
    """Tokens of the asking sets to every block of the component, those of its members to one block each.

    Sets of a dense group of components go to every pair of blocks of the group that theirs is in.
    """
    found, _ = gathered(rows)
    own = {sid: (a, b) for sid, a, b in found.get(SET, [])}
    for kind in (QUERY, MEMBER):
        for sid, a, _ in found.get(kind, []):
            for root, members in zip(*(x.tolist() for x in unpack(a, np.int64, np.int64)), strict=True):
                count = -(-members // BLOCK)
                for block in range(count) if kind == QUERY else [sid % count]:
                    name = named(root, block)
                    yield int(part_of(np.array([name], U64), n)[0]), kind, sid, own[sid][0], own[sid][1] + name.to_bytes(8, "little")
    for sid, a, _ in found.get(NESTED, []):
        group, comp, members = (int(x[0]) for x in unpack(a, np.int64, np.int64, np.int64))
        count = -(-members // BLOCK)
        mine = named(sid) % count
        for other in range(count):
            name = named(group, min(mine, other), max(mine, other))
            side = (0 if mine <= other else 1).to_bytes(1, "little") + comp.to_bytes(8, "little", signed=True)
            yield int(part_of(np.array([name], U64), n)[0]), NESTED, sid, own[sid][0], own[sid][1] + name.to_bytes(8, "little") + side


def nested_links(members: list[tuple], percent: int) -> Iterator[tuple[int, int]]:
    """Links between different components of a pair of blocks, one for each pair of components."""
    members.sort(key=lambda x: x[3])
    sids, token_sets, sizes, sides, comps = zip(*members, strict=True)
    tokens, counts = np.unique(np.concatenate(token_sets), return_counts=True)
    universe = tokens[counts > 1]
    if not len(universe):
        return
    bits, sizes, sides, comps = bit_rows(list(token_sets), universe), np.array(sizes), np.array(sides), np.array(comps)
    across, told = sides[-1] == 1, set()
    for x in range(len(sids)):
        begin = max(x + 1, int((sides == 0).sum())) if across else x + 1
        if across and sides[x] == 1 or begin >= len(sids):
            break
        rest = np.flatnonzero(comps[begin:] != comps[x]) + begin
        if len(rest):
            for y in rest[similar(bits[x], sizes[x], bits[rest], sizes[rest], percent)].tolist():
                pair = (int(comps[x]), int(comps[y]))
                if pair not in told:
                    told.add(pair)
                    yield sids[x], sids[y]


def answered(rows: Iterator[pa.RecordBatch], percent: int) -> Iterator[tuple[int, int]]:
    """One link for each asking set and block with a similar member."""
    found, _ = gathered(rows)
    blocks: dict[bytes, tuple[list, list]] = {}
    for kind in (QUERY, MEMBER):
        for sid, a, b in found.get(kind, []):
            blocks.setdefault(b[8:], ([], []))[kind == MEMBER].append((sid, np.frombuffer(a, U64), int.from_bytes(b[:8], "little")))
    nested: dict[bytes, list[tuple]] = {}
    for sid, a, b in found.get(NESTED, []):
        nested.setdefault(b[8:16], []).append((sid, np.frombuffer(a, U64), int.from_bytes(b[:8], "little"), b[16], int.from_bytes(b[17:], "little", signed=True)))
    for members in nested.values():
        yield from nested_links(members, percent)
    for queries, members in blocks.values():
        if not queries or not members:
            continue
        sids, token_sets, sizes = zip(*members, strict=True)
        universe, sizes = np.unique(np.concatenate(token_sets)), np.array(sizes)
        bits = bit_rows(list(token_sets), universe)
        for sid, tokens, size in queries:
            hit = np.flatnonzero(similar(bit_rows([tokens], universe)[0], size, bits, sizes, percent))
            if len(hit):
                yield sid, sids[hit[0]]


def step(df: DataFrame, f: Callable, *args) -> DataFrame:
    """f over each partition's record batches."""
    return df.mapInArrow(lambda rows: batches(f(rows, *args), ROW), TYPES)


def received(f: Callable, *args, schema: pa.Schema = ROW) -> Callable:
    """A pass over the record batches of a partition: f over those of each part."""
    return lambda rows: (batch for part in by_parts(rows) for batch in batches(f(part, *args), schema))


def exchange(df: DataFrame, n: int, f: Callable, *args, types: str = TYPES, schema: pa.Schema = ROW) -> DataFrame:
    """f over the rows of each of the n parts."""
    return dealt(df, n).mapInArrow(received(f, *args, schema=schema), types)


def label_rows(members: DataFrame, n: int) -> DataFrame:
    """Blocks of (node, root, number of nodes) for the nodes' parts."""

    def blocks(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in rows:
            node, root, many = (batch.column(i).to_numpy() for i in range(3))
            for p, block in by_part(id_part(node, n), n, node, root, many):
                yield p, LABELS, None, pack(*block), None

    return step(members.select("node", "root", "members"), blocks)


def request_rows(asks: DataFrame, n: int, kind: int) -> DataFrame:
    """(set, component, its number of sets) for the sets' parts, packed by set."""

    def blocks(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in rows:
            sid, root, many = (batch.column(i).to_numpy() for i in range(3))
            part = id_part(sid, n)
            order = np.argsort(sid, kind="stable")
            starts = run_starts(sid[order])
            for s, e in begin_end(starts, len(sid)):
                mine = order[s:e]
                yield int(part[mine[0]]), kind, int(sid[mine[0]]), pack(root[mine], many[mine]), None

    return step(asks.select("sid", "root", "members"), blocks)


def nested_rows(wanted: DataFrame, n: int) -> DataFrame:
    """(set, its component, group, number of sets in the group) for the sets' parts."""

    def blocks(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in rows:
            sid, comp, group, many = (batch.column(i).to_numpy() for i in range(4))
            for p, s, *x in zip(id_part(sid, n).tolist(), sid.tolist(), group, comp, many, strict=True):
                yield p, NESTED, s, pack(*(np.array([v], np.int64) for v in x)), None

    return step(wanted.select("sid", "comp", "grp", "many"), blocks)


def with_members(labels: DataFrame) -> DataFrame:
    """node, root and members of every node of a component, its root too."""
    nodes = labels.union(labels.select("root", "root").distinct())
    return spread_join(nodes, labels.groupBy("root").agg((F.count("*") + 1).alias("members")), "root", "node").select("node", "root", "members")


def requests(lists: DataFrame, members: DataFrame, n: int, percent: int) -> tuple[DataFrame, list[DataFrame]]:
    """Which sets' tokens go where, for the sets' parts, and the stored tables that this reads.

    Components that share lists make groups. The sets of a group of up to NESTED_BLOCKS blocks are
    compared by pairs of blocks, and so are those of a larger one where a single list would ask more
    often than blocks send; in other groups each set asks the components that it shares a list with.
    """

    def still(labels: DataFrame) -> DataFrame:
        two = exchange(exchange(lists.union(labels), n, components_of_lists, n), n, answer, of_two_components)
        return exchange(exchange(lists.union(labels).union(two), n, open_lists, n), n, distinct_lists, n)

    told = exchange(still(label_rows(members, n)), n, hub_links, n)
    hubs = checkpointed(exchange(told, n, pairs_told, types=PAIR_TYPES, schema=PAIR).distinct())
    across, wide = hubs.where("u <> v"), hubs.where("u = v").groupBy("u").agg(F.max("mu").alias("width"))
    labels = components(across.select("u", "v"))
    groups = labels.union(labels.select("root", "root").distinct()).toDF("comp", "grp")
    sizes = across.select(F.col("u").alias("comp"), F.col("mu").alias("m")).union(across.select("v", "mv")).distinct().join(groups, "comp")
    many = sizes.join(wide.select(F.col("u").alias("comp"), "width"), "comp", "left").groupBy("grp").agg(F.sum("m").alias("many"), F.max("width").alias("width"))
    dense = (F.col("many") <= BLOCK * NESTED_BLOCKS) | (F.col("many") <= F.col("width") * WORTH)
    comps = checkpointed(spread_join(sizes, many, "grp", "comp").withColumn("dense", F.coalesce(dense, F.lit(False))).drop("width"))
    discard(hubs, labels)
    inside = comps.where("dense").join(members.select(F.col("root").alias("comp"), "node"), "comp", "left").select(F.coalesce("node", "comp").alias("sid"), "comp", "grp", "many")
    nested = nested_rows(inside, n)
    if comps.where("not dense").isEmpty():
        return nested, [comps]
    as_one = inside.select(F.col("sid").alias("node"), F.col("grp").alias("root"), F.col("many").alias("members"))  # a dense group asks nothing here
    rest = members.join(as_one.select("node"), "node", "left_anti").select("node", "root", "members")
    told = exchange(still(label_rows(rest.union(as_one), n)), n, open_questions, n, percent)
    found = exchange(told, n, pairs_told, types=PAIR_TYPES, schema=PAIR)
    questions = checkpointed(found.select(F.col("u").alias("sid"), F.col("v").alias("root"), F.col("mv").alias("members")))
    roots = questions.select("root").distinct()
    alone = roots.join(members, "root", "left_anti").select(F.col("root").alias("sid"), "root", F.lit(1).cast("long").alias("members"))
    wanted = spread_join(members, roots, "root", "node").select(F.col("node").alias("sid"), "root", "members").union(alone)
    return nested.union(request_rows(questions, n, QUERY)).union(request_rows(wanted, n, MEMBER)), [comps, questions]


def told_apart(found: DataFrame) -> DataFrame:
    """found with a new sid for each of different sets that share one."""
    names = found.where("sid is not null").groupBy("sid").agg(F.min("more").alias("lo"), F.max("more").alias("hi"))
    shared = names.where("lo <> hi").select("sid", F.lit(True).alias("shared"))
    if shared.isEmpty():
        return found
    sid = F.when(F.col("shared"), F.xxhash64("sid", "more")).otherwise(F.col("sid")).alias("sid")
    out = checkpointed(found.join(shared, "sid", "left").select("doc_id", "n", sid, "more", "tokens"))
    discard(found)
    return out


@tidy
def link(docs: DataFrame, *, k: int = 5, percent: int = 75, rare: int = RARE, id_bits: int = 64, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles and component_id of every document."""
    n = part_count(docs)
    table = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))

    def texts(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for batch in rows:
            ids = batch.column(0)
            part = id_part(ids.fill_null(0).to_numpy(), n).tolist()
            for p, doc_id, text in zip(part, ids.to_pylist(), batch.column(1).to_pylist(), strict=True):
                yield p, TEXT, doc_id or 0, squeeze((text or "").encode()), b"null" if doc_id is None else None

    votes = exchange(step(table, prefix_blocks, n, k, percent), n, count_votes, n)
    joined = dealt(votes.union(step(table, texts)), n)
    found = checkpointed(joined, received(select_sets, k, percent, id_bits, schema=FOUND), "doc_id long, n long, sid long, more long, tokens binary")
    found = told_apart(found)

    copies = step(found.where("sid is not null").select("sid", "n", "tokens"), one_of_copies, n)
    reps = checkpointed(dealt(copies, n), received(one_each), TYPES)
    replies = exchange(exchange(reps, n, token_counts, n), n, answer, shared_by_two)
    indexed = checkpointed(dealt(reps.union(replies), n), received(index_sets, percent, rare), TYPES)
    discard(reps)
    sets, lists = indexed.where(F.col("kind") == SET), indexed.where(F.col("kind") == LISTS)

    links = "u long, v long"
    near = exchange(exchange(indexed, n, chosen_lists, n), n, links_of_lists, percent, types=links, schema=LINK)
    edges = checkpointed(near.distinct())
    first = components(edges)
    members = checkpointed(with_members(first))
    asks, used = requests(lists, members, n, percent)
    late = checkpointed(dealt(exchange(sets.union(asks), n, asked, n), n), received(answered, percent, schema=LINK), links)
    labels = components(edges.union(late))
    discard(indexed, edges, first, members, late, *used)

    known = found.where("sid is not null")
    by_set = known.groupBy("sid").agg(F.min("doc_id").alias("low"))
    rooted = by_set.join(labels.select(F.col("node").alias("sid"), "root"), "sid", "left").withColumn("root", F.coalesce("root", "sid"))
    lowest = rooted.groupBy("root").agg(F.min("low").alias("component_id"))
    placed = spread_join(rooted.select("sid", "root"), lowest, "root", "sid").select("sid", "component_id")
    alone = found.where("sid is null").select("doc_id", F.col("n").alias("n_shingles"), F.col("doc_id").alias("component_id"))
    return spread_join(known.select("doc_id", "n", "sid"), placed, "sid", "doc_id").select("doc_id", F.col("n").alias("n_shingles"), "component_id").union(alone)


def one_each(rows: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """The first of the rows of each set."""
    seen: set[int] = set()
    for batch in rows:
        for row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if row[2] not in seen:
                seen.add(row[2])
                yield row
