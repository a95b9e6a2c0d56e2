"""Language identification by a byte convolutional network, trained and applied in numpy.

Bytes are embedded, filters of several widths slide over fixed-length windows, each filter keeps its
maximum, and a softmax layer over these gives languages. A document's windows cover its whole text;
their probabilities are averaged by the bytes that they hold.

Training takes windows of labelled documents up to the bound ``most_windows``, in equal parts from all
languages as far as they have them; which ones, a hash of the identifier and the window's number draws.
Everything else covers all rows.

Cases: a null text, or one without any letter, is ``und`` with score 0; a text shorter than a window
is padded, a very long one cut to windows that cover it whole; without training rows every text is
``und``; equal texts have equal predictions, repeated rows are predicted each; labels that repeat count
each; rows without a label are not learned from, those without an identifier
are, being in no held-out fold; an empty table gives no rows; other columns are kept by
``predict``, one of the name lang_pred or score under a new name with an underscore before it.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ._arrays import batches, chunks, fresh

WINDOW, EMBED, FILTERS, WIDTHS = 256, 8, 16, (2, 3, 4)
WIDEST = max(WIDTHS)


@dataclass
class Network:
    """Weights of the network and its languages."""

    langs: list[str]
    weights: dict[str, np.ndarray] = field(default_factory=dict)

    @classmethod
    def fresh(cls, langs: list[str], seed: int = 7) -> Network:
        draw = np.random.default_rng(seed)
        f = np.float32
        w = {"embed": draw.normal(0, 0.5, (256, EMBED)).astype(f), "bias": np.zeros(FILTERS * len(WIDTHS), f)}
        for n in WIDTHS:
            w[f"conv{n}"] = draw.normal(0, (2 / (n * EMBED)) ** 0.5, (n * EMBED, FILTERS)).astype(f)
        w["out"] = draw.normal(0, 0.1, (FILTERS * len(WIDTHS), len(langs))).astype(f)
        w["out_bias"] = np.zeros(len(langs), f)
        return cls(langs, w)

    def kernel(self) -> np.ndarray:
        """All filters as one matrix of the widest width, the narrower ones filled with zeros."""
        k = np.zeros((WIDEST * EMBED, FILTERS * len(WIDTHS)), np.float32)
        for i, n in enumerate(WIDTHS):
            k[: n * EMBED, i * FILTERS : (i + 1) * FILTERS] = self.weights[f"conv{n}"]
        return k

    def features(self, windows: np.ndarray, kernel: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Each filter's response at every place, and the windows' embedded patches."""
        n, size = windows.shape
        x = self.weights["embed"][windows].reshape(n, size * EMBED)
        places = size - WIDEST + 1
        step = x.strides[1]
        patches = np.lib.stride_tricks.as_strided(x, (n, places, WIDEST * EMBED), (x.strides[0], EMBED * step, step)).reshape(n * places, WIDEST * EMBED)
        return (patches @ kernel).reshape(n, places, -1), patches

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        kernel, out = self.kernel(), np.empty((len(windows), len(self.langs)), np.float32)
        for i in range(0, len(windows), 32):
            response, _ = self.features(windows[i : i + 32], kernel)
            pooled = np.maximum(response.max(1) + self.weights["bias"], 0)
            out[i : i + 32] = softmax(pooled @ self.weights["out"] + self.weights["out_bias"])
        return out

    def train(self, windows: np.ndarray, labels: np.ndarray, *, epochs: int = 4, batch: int = 64, rate: float = 0.004, seed: int = 11) -> None:
        """Adam on the cross-entropy, each language weighted alike; gradients pass the maxima only."""
        draw = np.random.default_rng(seed)
        share = np.bincount(labels, minlength=len(self.langs)) / max(1, len(labels))
        weigh = (1 / np.maximum(share, 1e-6) / len(self.langs)).astype(np.float32)
        first = {k: np.zeros_like(v) for k, v in self.weights.items()}
        second = {k: np.zeros_like(v) for k, v in self.weights.items()}
        t = 0
        for _ in range(epochs):
            order = draw.permutation(len(windows))
            for i in range(0, len(order), batch):
                rows = order[i : i + batch]
                t += 1
                for k, g in self.gradients(windows[rows], labels[rows], weigh).items():
                    first[k] += 0.1 * (g - first[k])
                    second[k] += 0.001 * (g * g - second[k])
                    self.weights[k] -= rate * (first[k] / (1 - 0.9**t)) / (np.sqrt(second[k] / (1 - 0.999**t)) + 1e-8)

    def gradients(self, windows: np.ndarray, labels: np.ndarray, weigh: np.ndarray) -> dict[str, np.ndarray]:
        w, n = self.weights, len(windows)
        kernel = self.kernel()
        response, patches = self.features(windows, kernel)
        best = response.argmax(1)
        top = np.take_along_axis(response, best[:, None], 1)[:, 0] + w["bias"]
        pooled = np.maximum(top, 0)
        p = softmax(pooled @ w["out"] + w["out_bias"])
        p[np.arange(n), labels] -= 1
        p *= weigh[labels][:, None] / n
        back = (p @ w["out"].T) * (top > 0)
        places = response.shape[1]
        at = (np.arange(n)[:, None] * places + best).ravel()
        chosen = patches[at].reshape(n, -1, WIDEST * EMBED)  # window, filter, patch
        k_grad = np.einsum("nf,nfp->pf", back, chosen, optimize=True)
        out = {"out": pooled.T @ p, "out_bias": p.sum(0), "bias": back.sum(0)}
        for i, width in enumerate(WIDTHS):
            out[f"conv{width}"] = k_grad[: width * EMBED, i * FILTERS : (i + 1) * FILTERS]
        to_patch = (back[:, :, None] * kernel.T[None]).reshape(-1, WIDEST, EMBED)
        bytes_at = windows[np.arange(n)[:, None, None], best[:, :, None] + np.arange(WIDEST)].reshape(-1)
        embed = np.zeros_like(w["embed"])
        np.add.at(embed, bytes_at, to_patch.reshape(-1, EMBED))
        return out | {"embed": embed}


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


LOWER_BYTE = np.arange(256, dtype=np.uint8)
LOWER_BYTE[65:91] += 32


def fold(data: np.ndarray) -> np.ndarray:
    """Bytes with ASCII and Latin-1 capitals as small letters."""
    out = LOWER_BYTE[data]
    at = np.flatnonzero((data[:-1] == 0xC3) & (data[1:] >= 0x80) & (data[1:] <= 0x9E) & (data[1:] != 0x97)) + 1
    out[at] += 32
    return out


def cut(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Windows that cover the texts, padded with zeros; the text and the number of bytes of each."""
    sizes = np.diff(offsets)
    count = -(-sizes // WINDOW)
    text = np.repeat(np.arange(len(sizes)), count)
    nth = np.arange(count.sum()) - np.repeat(np.cumsum(count) - count, count)
    start = offsets[text] + nth * WINDOW
    held = np.minimum(WINDOW, offsets[text + 1] - start)
    padded = np.concatenate([fold(data), np.zeros(WINDOW, np.uint8)])
    windows = padded[start[:, None] + np.arange(WINDOW)]
    windows[np.arange(WINDOW) >= held[:, None]] = 0
    return windows, text, held


def sample(labelled: DataFrame, most_windows: int, *, a_text: int = 4) -> tuple[np.ndarray, list[str]]:
    """Up to most_windows windows of (id, lang, text) with their languages, a few spread over each text.

    A window is drawn where its hash is below a share of all hashes, so that no task or driver holds
    more than the sample. Languages have equal parts of it, and what a rare one leaves goes to the others.
    """
    each = F.when(F.octet_length(F.col("text").cast("string")) > WINDOW, a_text).otherwise(1)
    found = labelled.groupBy(F.col("lang").cast("string").alias("lang")).agg(F.sum(each).alias("n"))
    sizes = {r.lang: r.n for r in found.collect()}  # a row for each class of the model
    shares, room = {}, most_windows
    for i, lang in enumerate(sorted(sizes, key=lambda x: (sizes[x], x))):
        part = min(sizes[lang], room / (len(sizes) - i))
        shares[lang] = part / sizes[lang]
        room -= part
    schema = pa.schema([("lang", pa.string()), ("window", pa.binary()), ("turn", pa.int64())])

    def windows(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def each() -> Iterator[tuple]:
            for batch in rows:
                ids, langs = batch.column(0).to_pylist(), batch.column(1).to_pylist()
                for i, _, data, offsets in chunks(batch.column(2)):
                    for d, (a, b) in enumerate(zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)):
                        for j in range(a_text if b - a > WINDOW else 1):
                            turn = zlib.crc32(f"{ids[i + d]}/{j}".encode())
                            if turn < shares[langs[i + d]] * (1 << 32):
                                s = a + (b - a - WINDOW) * j // max(1, a_text - 1) if b - a > WINDOW else a
                                yield langs[i + d], data[s : min(s + WINDOW, b)].tobytes(), int(turn / shares[langs[i + d]])

        yield from batches(each(), schema)

    drawn = labelled.select(F.col("id").cast("string"), F.col("lang").cast("string"), F.col("text").cast("string")).mapInArrow(windows, "lang string, window binary, turn long")
    found = drawn.orderBy("turn", "window", "lang").limit(most_windows).collect()  # bounded by the parameter
    held = np.zeros((len(found), WINDOW), np.uint8)
    for i, r in enumerate(found):
        held[i, : len(r.window)] = fold(np.frombuffer(r.window, np.uint8))
    return held, [r.lang for r in found]


def fit(labelled: DataFrame, most_windows: int = 8000) -> Network | None:
    """Train on rows (id, lang, text); None without any."""
    has = labelled.where(F.col("lang").isNotNull() & has_letter(F.col("text")))
    windows, names = sample(has, most_windows)
    if not names:
        return None
    langs = sorted(set(names))
    net = Network.fresh(langs)
    net.train(windows, np.array([langs.index(x) for x in names]))
    return net


def has_letter(text: Column) -> Column:
    return F.coalesce(text, F.lit("")).rlike("\\p{L}")


def predict(docs: DataFrame, net: Network | None, *, text_col: str = "text") -> DataFrame:
    """docs with lang_pred and score."""
    kept = [c if c == text_col else fresh([x for x in docs.columns if x != c] + ["lang_pred", "score"], c) for c in docs.columns]
    docs = docs.select(*[F.col(f"`{c}`").alias(n) for c, n in zip(docs.columns, kept, strict=True)])
    if net is None:
        return docs.select(*kept, F.lit("und").alias("lang_pred"), F.lit(0.0).alias("score"))
    shared = docs.sparkSession.sparkContext.broadcast(net)  # the weights, of fixed size
    marked = docs.select(*kept, has_letter(F.col(text_col).cast("string")).alias("__letter"), F.col(text_col).cast("string").alias("__text"))

    def apply(rows: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Network = shared.value
        for batch in rows:
            mean = np.zeros((len(batch), len(model.langs)))
            for i, j, data, offsets in chunks(batch.column(len(kept) + 1)):
                windows, text, held = cut(data, offsets)
                weighed = model.probabilities(windows) * held[:, None]
                for c in range(len(model.langs)):
                    mean[i:j, c] = np.bincount(text, weighed[:, c], minlength=j - i)
                mean[i:j] /= np.maximum(np.diff(offsets), 1)[:, None]
            letter = batch.column(len(kept)).to_numpy(zero_copy_only=False).astype(bool)
            best = mean.argmax(1) if len(batch) else np.zeros(0, int)
            names = pa.array([model.langs[b] if ok else "und" for b, ok in zip(best.tolist(), letter.tolist(), strict=True)], pa.string())
            score = np.where(letter, np.clip(mean.max(1), 0, 1), 0.0) if len(batch) else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns[: len(kept)], names, pa.array(score, pa.float64())], names=[*kept, "lang_pred", "score"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*kept).schema.fields)
    return marked.mapInArrow(apply, f"{types}, lang_pred string, score double")


def held_out(doc_id: str = "doc_id") -> Column:
    """True for the fold that is not learned from: crc32 of the identifier's text leaves 2 by 4."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 4 == 2, F.lit(False))


def identify(docs: DataFrame, most_windows: int = 8000) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every whole text, learned from the other folds."""
    net = fit(docs.where(~held_out()).select(F.col("doc_id").alias("id"), "lang", "text"), most_windows)
    table = docs.select("doc_id", held_out().alias("held_out"), F.col("text").alias("text"))
    return predict(table, net).drop("text")
