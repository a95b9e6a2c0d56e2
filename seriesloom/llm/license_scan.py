"""Licence scans: MinHash bands over overlapping windows find templates, exact containment verifies them.

Texts and templates are runs of lower-cased letters and digits; a template's shingles are SHINGLE
neighbouring words, or all of them if it has fewer. For each template length, windows of that many
words step by an eighth of it. A window's MinHash signature of BANDS bands of ROWS minima is looked
up among the templates of its length. Of a template whose shingles are contained to 0.75 in a place
of its own length, some window within a sixteenth of it shares 0.69 of the template's shingles, a
Jaccard similarity of 0.52 at least, so that a band agrees with probability 1 - (1 - 0.52^2)^32, over
0.9999. Windows that hold no shingle of any template are passed over, as no band could agree.
A template found is verified over the window and one step around it by exact containment.

Templates are a parameter, a dictionary or a table of any size: it is searched in blocks of
BLOCK_BYTES, of which a task holds one. Texts are scanned whole.

Cases: a null or empty text has no words and no match, and so has a null or empty template; templates
that repeat a text each count; overlapping matches of one template are one; an empty list of templates
matches nothing; repeated rows are scanned each, as is a very long text; an empty table gives no rows;
other columns are kept, one of the name n_words or matches under a new name with an underscore before it.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ._arrays import chunks, fresh, gram_hash, mix
from ._blocks import Blocks
from .fm_decontam import words_of
from .license_texts import NOTICES, TEXTS

U64 = np.uint64
SHINGLE, BANDS, ROWS, THRESHOLD = 5, 32, 2, 0.75
BLOCK_BYTES = 4 << 20
SEEDS = mix(np.arange(1, BANDS * ROWS + 1, dtype=U64) * U64(0x9E3779B97F4A7C15))


def band_keys(shingles: np.ndarray, window: int, starts: np.ndarray) -> np.ndarray:
    """Band keys of the windows of so many shingles that begin at the starts: one row for each window."""
    hashed = mix(shingles[None, :] ^ SEEDS[:, None])
    least = np.lib.stride_tricks.sliding_window_view(hashed, window, axis=1)[:, starts].min(-1)
    out = np.zeros((BANDS, len(starts)), U64)
    for row in range(ROWS):
        out = mix(out * U64(0x9E3779B97F4A7C15) + least[row::ROWS])
    return out.T


@dataclass
class Templates:
    """Templates by length: their shingles, and which of them have a band's key."""

    names: list[str]
    sizes: list[int] = field(default_factory=list)
    sets: list[np.ndarray] = field(default_factory=list)
    lengths: dict[int, dict[tuple[int, int], list[int]]] = field(default_factory=dict)
    shingles: dict[int, np.ndarray] = field(default_factory=dict)  # by words in a shingle
    by_length: dict[int, np.ndarray] = field(default_factory=dict)

    @classmethod
    def of(cls, notices: list[tuple[str | None, str | None]]) -> Templates:
        out = cls([name for name, _ in notices])
        for i, (_, text) in enumerate(notices):
            raw = (text or "").encode()
            words, _ = words_of(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
            n, k = len(words), min(SHINGLE, len(words))
            grams = gram_hash(words, k) if n else words
            out.sizes.append(n)
            out.sets.append(np.unique(grams))
            if n:
                bands = out.lengths.setdefault(n, {})
                for band, key in enumerate(band_keys(grams, len(grams), np.zeros(1, np.int64))[0].tolist()):
                    bands.setdefault((band, key), []).append(i)
                out.shingles[k] = np.union1d(out.shingles.get(k, grams[:0]), grams)
                out.by_length[n] = np.union1d(out.by_length.get(n, grams[:0]), grams)
        return out


def matches(words: np.ndarray, templates: Templates) -> list[tuple[int, int, int, float]]:
    """(template, first word, end, containment) of each match in a text, overlapping ones of a template joined."""
    found: dict[int, list[tuple[int, int, float]]] = {}
    grams = {k: gram_hash(words, k) for k in templates.shingles if len(words) >= k}
    hits = {k: np.flatnonzero(np.isin(g, templates.shingles[k])) for k, g in grams.items()}
    for n, bands in templates.lengths.items():
        k = min(SHINGLE, n)
        own_hits = hits[k][np.isin(grams[k][hits[k]], templates.by_length[n])] if k in hits else ()
        if not len(own_hits):
            continue
        step, window, size = max(1, n // 8), n - k + 1, len(grams[k])
        last = max(0, size - window)
        near = np.unique(np.clip(((own_hits[:, None] - np.arange(0, window + step, step)) // step) * step, 0, last))
        lo, hi = int(near[0]), min(size, int(near[-1]) + window)
        width = min(window, size)
        for s, keys in zip(near.tolist(), band_keys(grams[k][lo:hi], width, near - lo).tolist(), strict=True):
            for t in {t for band, key in enumerate(keys) for t in bands.get((band, key), ())}:
                a, b = max(0, s - step), s + window + step
                own = np.isin(grams[k][a:b], templates.sets[t])
                share = len(np.unique(grams[k][a:b][own])) / len(templates.sets[t])
                if share >= THRESHOLD:
                    at = np.flatnonzero(own) + a
                    found.setdefault(t, []).append((int(at[0]), int(at[-1]) + k, share))
    out = []
    for t, spans in found.items():
        spans.sort()
        joined = [spans[0]]
        for a, b, share in spans[1:]:
            if a < joined[-1][1]:
                joined[-1] = (joined[-1][0], max(b, joined[-1][1]), max(share, joined[-1][2]))
            else:
                joined.append((a, b, share))
        out += [(t, *x) for x in joined]
    return sorted(out)


FOUND = pa.list_(pa.struct([("template", pa.string()), ("first_word", pa.int32()), ("end_word", pa.int32()), ("containment", pa.float64())]))


def matches_of(data: np.ndarray, offsets: np.ndarray, known: Templates) -> Iterator[tuple[int, list[dict]]]:
    """The number of words and the matches of each text."""
    words, of = words_of(data, offsets)
    near = np.zeros(len(words), bool)  # words where some template's shingle begins
    for k, shingles in known.shingles.items():
        if len(words) >= k:
            grams = gram_hash(words, k)
            low = np.zeros(1 << 16, bool)
            low[(shingles & U64(0xFFFF)).astype(np.int64)] = True
            maybe = np.flatnonzero(low[(grams & U64(0xFFFF)).astype(np.int64)])
            near[maybe[np.isin(grams[maybe], shingles)]] = True
    some = np.concatenate([[0], np.cumsum(near)])
    for a, b in zip(of[:-1].tolist(), of[1:].tolist(), strict=True):
        found = matches(words[a:b], known) if some[b] > some[a] else []
        yield b - a, [{"template": known.names[t], "first_word": x, "end_word": y, "containment": c} for t, x, y, c in found]


def scan(docs: DataFrame, notices: dict[str, str] | DataFrame | None = None, *, text_col: str = "text", block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """docs without the text, with n_words and matches: an array of template, first_word, end_word, containment.

    notices has the templates' texts by name, or is a table of (name, text).
    """
    if not isinstance(notices, DataFrame):
        known = NOTICES | TEXTS if notices is None else notices
        notices = docs.sparkSession.createDataFrame(list(known.items()), "name string, text string")
    table = notices.select(F.col(notices.columns[0]).cast("string").alias("name"), F.col(notices.columns[1]).cast("string").alias("text"))
    size = F.lit(16) + F.coalesce(F.octet_length("text"), F.lit(0)) + F.coalesce(F.octet_length("name"), F.lit(0))
    blocks = Blocks(table, size, Templates.of, block_bytes)
    own = {c: fresh([x for x in docs.columns if x != c] + ["n_words", "matches"], c) for c in docs.columns if c != text_col}
    kept = list(own.values())
    rows = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in own.items()], F.col(f"`{text_col}`").cast("string").alias("__text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in blocks.shards(batches):
            counts, out = [0] * len(batch), [[] for _ in range(len(batch))]
            for known in blocks:
                for i, _, data, offsets in chunks(batch.column(len(kept))):
                    for d, (n, found) in enumerate(matches_of(data, offsets, known)):
                        counts[i + d] = n
                        out[i + d] += found
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], pa.array(counts, pa.int64()), pa.array(out, FOUND)], names=[*kept, "n_words", "matches"])

    types = [f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1]]
    return rows.mapInArrow(run, ", ".join([*types, "n_words long", "matches array<struct<template: string, first_word: int, end_word: int, containment: double>>"]))
