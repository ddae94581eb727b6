"""Language identification by a byte convolutional network (operator 10).

The network reads windows of ``WINDOW`` bytes of the lower-cased UTF-8 text: byte embeddings, filters of several widths, the
maximum of each filter over the window, one softmax layer. It is trained here in numpy on a bounded sample of labelled
documents: at most ``per_language`` expected windows for each of the ``max_languages`` most frequent labels (parameters
of ``fit``). A prediction covers the whole text: the windows lie side by side until its end, and their probabilities
are averaged by length. Only the text goes into a prediction.

A null text and a text without a letter are ``und`` with score 0, and so is every text where there were no labels to
learn from. Repeated rows get equal predictions, ties between languages go to the first in alphabetical order, an empty
table gives an empty result, and other columns are carried along unless they are named like the two new ones.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from skylag.llm.words import sliced

WINDOW = 256
EMBED, WIDTHS, FILTERS = 6, (2, 3, 4), 12
UNKNOWN = "und"


@dataclass
class ByteNet:
    """Weights of the network; everything is float32."""
    languages: list[str]
    embed: np.ndarray  # bytes x EMBED
    filters: np.ndarray  # (widest x EMBED) x all filters, zero where a filter is narrower
    bias: np.ndarray
    out: np.ndarray
    out_bias: np.ndarray

    def pooled(self, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Patches at every place, and each filter's response there."""
        widest = max(WIDTHS)
        padded = np.pad(windows, ((0, 0), (0, widest - 1)))
        vectors = self.embed[padded].reshape(len(windows), -1)
        patches = np.lib.stride_tricks.sliding_window_view(vectors, widest * EMBED, axis=1)[:, ::EMBED]
        patches = np.ascontiguousarray(patches).reshape(-1, widest * EMBED)
        return patches, (patches @ self.filters).reshape(len(windows), windows.shape[1], -1)

    def probabilities(self, windows: np.ndarray) -> np.ndarray:
        _, responses = self.pooled(windows)
        hidden = np.maximum(responses.max(axis=1) + self.bias, 0)
        return softmax(hidden @ self.out + self.out_bias)


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def _mask() -> np.ndarray:
    """Which filter weights a filter of each width has."""
    mask = np.zeros((max(WIDTHS) * EMBED, len(WIDTHS) * FILTERS), np.float32)
    for k, width in enumerate(WIDTHS):
        mask[:width * EMBED, k * FILTERS:(k + 1) * FILTERS] = 1
    return mask


def train(texts: list[str], labels: list[str], steps: int = 750, batch: int = 64, rate: float = 0.01,
          seed: int = 7) -> ByteNet:
    """Fit the network by Adam; short pieces are mixed in so that short texts are known too."""
    random = np.random.default_rng(seed)
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels])
    x = np.zeros((len(texts), WINDOW), np.uint8)
    for row, text in zip(x, texts):
        data = np.frombuffer(text.lower().encode(), np.uint8)[:WINDOW]
        row[:len(data)] = data
    mask = _mask()
    net = ByteNet(languages, random.normal(0, 0.5, (256, EMBED)).astype(np.float32),
                  (random.normal(0, 0.3, mask.shape) * mask).astype(np.float32),
                  np.zeros(mask.shape[1], np.float32),
                  random.normal(0, 0.1, (mask.shape[1], len(languages))).astype(np.float32),
                  np.zeros(len(languages), np.float32))
    names = ("embed", "filters", "bias", "out", "out_bias")
    first, second = ({n: np.zeros_like(getattr(net, n)) for n in names} for _ in range(2))
    widest, order = max(WIDTHS), np.empty(0, int)
    for step in range(1, steps + 1):
        if len(order) < min(batch, len(x)):
            order = random.permutation(len(x))
        rows, order = order[:batch], order[batch:]
        windows = x[rows].copy()
        short = random.random(len(rows)) < 0.3
        lengths = np.where(short, random.integers(6, 64, len(rows)), WINDOW)
        windows[np.arange(WINDOW) >= lengths[:, None]] = 0
        patches, responses = net.pooled(windows)
        place = responses.argmax(axis=1)
        top = np.take_along_axis(responses, place[:, None], axis=1)[:, 0] + net.bias
        hidden = np.maximum(top, 0)
        error = softmax(hidden @ net.out + net.out_bias)
        error[np.arange(len(rows)), y[rows]] -= 1
        error /= len(rows)
        back = (error @ net.out.T) * (top > 0)
        chosen = patches.reshape(len(rows), WINDOW, -1)[np.arange(len(rows))[:, None], place]
        wide = back[:, :, None] * net.filters.T  # by row, filter, patch
        at_bytes = np.pad(windows, ((0, 0), (0, widest - 1)))
        touched = at_bytes[np.arange(len(rows))[:, None, None], place[:, :, None] + np.arange(widest)]
        to_embed = np.zeros_like(net.embed)
        np.add.at(to_embed, touched.reshape(-1), wide.reshape(-1, EMBED))
        gradients = {"embed": to_embed, "filters": np.einsum("rf,rfp->pf", back, chosen) * mask,
                     "bias": back.sum(axis=0), "out": hidden.T @ error, "out_bias": error.sum(axis=0)}
        for n in names:
            first[n] = 0.9 * first[n] + 0.1 * gradients[n]
            second[n] = 0.999 * second[n] + 0.001 * gradients[n] ** 2
            change = rate * (first[n] / (1 - 0.9 ** step)) / (np.sqrt(second[n] / (1 - 0.999 ** step)) + 1e-8)
            setattr(net, n, (getattr(net, n) - change).astype(np.float32))
    return net


def held_out(docs_id) -> F.Column:
    """The fold that no classifier learns from."""
    return F.coalesce(F.crc32(docs_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = 1500, max_languages: int = 64) -> ByteNet | None:
    """Train on a sample of the labelled documents outside the held-out fold; None where there are none.

    One window at a place drawn from the doc_id is taken of each sampled document, so what the driver receives is bounded by
    ``2 * per_language * max_languages`` windows.
    """
    labelled = docs.filter(F.col("lang").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id")))
    counts = {r["lang"]: r["count"] for r in
              labelled.groupBy("lang").count().orderBy(F.desc("count"), "lang").limit(max_languages).collect()}
    if not counts:
        return None
    share = F.element_at(F.create_map(*[F.lit(x) for lang, n in counts.items() for x in (lang, per_language / n)]),
                         F.col("lang"))
    draw = lambda salt: F.pmod(F.xxhash64("doc_id", F.lit(salt)), F.lit(1 << 20)) / float(1 << 20)
    start = F.floor(draw(2) * F.greatest(F.length("text") - WINDOW + 1, F.lit(1))).cast("int") + 1
    rows = (labelled.filter(draw(1) < share)
            .select("doc_id", "lang", F.substring(F.col("text"), start, F.lit(WINDOW)).alias("piece"))
            .orderBy(F.xxhash64("doc_id", F.lit(3)), "doc_id", "piece").limit(2 * per_language * len(counts)).collect())
    rows = [r for r in rows if any(c.isalpha() for c in r["piece"])]
    return train([r["piece"] for r in rows], [r["lang"] for r in rows]) if rows else None


def _windows(data: bytes) -> np.ndarray:
    count = -(-len(data) // WINDOW)
    return np.frombuffer(data.ljust(count * WINDOW, b"\0"), np.uint8).reshape(count, WINDOW)


def _predict_texts(net: ByteNet, texts: list[str | None]) -> tuple[list[str], list[float]]:
    """Languages and scores; windows of many texts go through the network together, long texts in several goes."""
    sums = np.zeros((len(texts), len(net.languages)))
    at_once, queue, owners, weights = 512, [], [], []

    def flush():
        windows = np.concatenate(queue)
        owner, weight = np.concatenate(owners), np.concatenate(weights)
        for at in range(0, len(windows), at_once):
            part = slice(at, at + at_once)
            np.add.at(sums, owner[part], net.probabilities(windows[part]) * weight[part, None])
        queue.clear(), owners.clear(), weights.clear()

    waiting = 0
    known = np.zeros(len(texts), bool)
    for row, text in enumerate(texts):
        if text is None or not any(c.isalpha() for c in text):
            continue
        known[row] = True
        windows = _windows(data := text.lower().encode())
        weight = np.full(len(windows), WINDOW, float)
        weight[-1] = len(data) - (len(windows) - 1) * WINDOW
        queue.append(windows), owners.append(np.full(len(windows), row)), weights.append(weight / len(data))
        waiting += len(windows)
        if waiting >= 8 * at_once:
            flush()
            waiting = 0
    if queue:
        flush()
    best = sums.argmax(axis=1)
    return ([net.languages[k] if ok else UNKNOWN for k, ok in zip(best, known)],
            [float(min(1.0, sums[row, k])) if ok else 0.0 for row, (k, ok) in enumerate(zip(best, known))])


def predict(docs: DataFrame, net: ByteNet | None) -> DataFrame:
    """``docs`` with ``lang_pred`` and ``score`` added (replaced where columns of that name exist)."""
    kept = [c for c in docs.columns if c not in ("lang_pred", "score")]
    docs = docs.select(*[F.col(f"`{c}`") for c in kept])
    if net is None:
        return docs.withColumns({"lang_pred": F.lit(UNKNOWN), "score": F.lit(0.0)})
    schema = T.StructType([*docs.schema.fields, T.StructField("lang_pred", T.StringType()),
                           T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, "text"):
            languages, scores = _predict_texts(net, batch.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays(
                [*batch.columns, pa.array(languages, pa.string()), pa.array(scores, pa.float64())],
                names=[*kept, "lang_pred", "score"])

    return docs.mapInArrow(run, schema)


def accept(docs: DataFrame, net: ByteNet | None, least: float) -> DataFrame:
    """The documents whose language is known with at least ``least`` probability; columns as they were."""
    marked = docs.select(*[F.col(f"`{c}`").alias(f"c{k}") if c != "text" else F.col("text") for k, c in enumerate(docs.columns)])
    good = predict(marked, net).filter((F.col("lang_pred") != UNKNOWN) & (F.col("score") >= least))
    return good.select(*[(F.col(f"c{k}") if c != "text" else F.col("text")).alias(c) for k, c in enumerate(docs.columns)])
