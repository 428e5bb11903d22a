"""Language of a text by a convolutional network on bytes, trained in numpy.

A text is cut into windows of WINDOW bytes, all of it. A window's bytes are embedded, filters of several widths slide
over it, each filter's largest answer goes into a softmax layer. A text's probabilities are those of its windows,
weighted by their letters.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType, StructType

from seqlattice.llm import words
from seqlattice.llm.names import col, columns, free, map_arrow

WINDOW = 128
WIDTHS = (2, 3, 4)
FILTERS = 16
EMBED = 8
UNKNOWN = "und"
# The training sample: texts of each language, texts of all (one of each language at least), and windows of each text.
SAMPLE_TEXTS = 400
SAMPLE_TOTAL = 25_600
SAMPLE_WINDOWS = 8
EPOCHS = 4
# Windows that go through the network together.
BATCH = 96


@dataclass
class Model:
    """Labels and weights; ``layers`` has the embedding, a filter matrix and bias for each width, and the last layer."""

    labels: list[str]
    layers: dict[str, np.ndarray]


def forward(layers: dict[str, np.ndarray], windows: np.ndarray) -> tuple[np.ndarray, list]:
    """Label probabilities of windows (a byte matrix), and what training needs of the way there."""
    embedded = layers["embed"][windows]
    kept, pooled = [], []
    for w in WIDTHS:
        wide = windows.shape[1] - w + 1
        columns = np.concatenate([embedded[:, k : k + wide] for k in range(w)], axis=2)
        answer = columns.reshape(-1, w * EMBED) @ layers[f"filter{w}"]
        answer = answer.reshape(len(windows), wide, -1)
        top = answer.max(axis=1)
        kept.append((answer, columns))
        pooled.append(np.maximum(top + layers[f"bias{w}"], 0))
    hidden = np.concatenate(pooled, axis=1)
    score = hidden @ layers["out"] + layers["out_bias"]
    score = np.exp(score - score.max(axis=1, keepdims=True))
    return score / score.sum(axis=1, keepdims=True), [kept, hidden]


def gradients(layers: dict[str, np.ndarray], windows: np.ndarray, target: np.ndarray) -> dict[str, np.ndarray]:
    """Of the mean cross entropy."""
    prob, (kept, hidden) = forward(layers, windows)
    n = len(windows)
    delta = prob.copy()
    delta[np.arange(n), target] -= 1
    delta /= n
    out = {"out": hidden.T @ delta, "out_bias": delta.sum(axis=0), "embed": np.zeros_like(layers["embed"])}
    back = (delta @ layers["out"].T) * (hidden > 0)
    for i, (w, (answer, columns)) in enumerate(zip(WIDTHS, kept)):
        part = back[:, i * FILTERS : (i + 1) * FILTERS]
        place = answer.argmax(axis=1)
        chosen = columns[np.arange(n)[:, None], place]
        out[f"bias{w}"] = part.sum(axis=0)
        out[f"filter{w}"] = np.einsum("nfk,nf->kf", chosen, part)
        flow = part[:, :, None] * layers[f"filter{w}"].T[None]
        for k in range(w):
            np.add.at(out["embed"], windows[np.arange(n)[:, None], place + k], flow[:, :, k * EMBED : (k + 1) * EMBED])
    return out


def fit(windows: np.ndarray, target: np.ndarray, labels: list[str], epochs: int = EPOCHS, batch: int = 64, rate: float = 0.01) -> Model:
    """Train by Adam on byte windows and label numbers; repeatable."""
    rng = np.random.default_rng(11)
    draw = lambda *shape: rng.normal(0, 1 / np.sqrt(shape[0]), shape).astype(np.float32)
    layers = {"embed": rng.normal(0, 1, (256, EMBED)).astype(np.float32), "out": draw(FILTERS * len(WIDTHS), len(labels)), "out_bias": np.zeros(len(labels), np.float32)}
    for w in WIDTHS:
        layers |= {f"filter{w}": draw(w * EMBED, FILTERS), f"bias{w}": np.zeros(FILTERS, np.float32)}
    mean = {k: np.zeros_like(v) for k, v in layers.items()}
    square = {k: np.zeros_like(v) for k, v in layers.items()}
    step = 0
    for _ in range(epochs):
        order = rng.permutation(len(windows))
        for cut in range(0, len(order), batch):
            rows = order[cut : cut + batch]
            step += 1
            for k, g in gradients(layers, windows[rows], target[rows]).items():
                mean[k] = 0.9 * mean[k] + 0.1 * g
                square[k] = 0.999 * square[k] + 0.001 * g * g
                layers[k] -= (rate * (mean[k] / (1 - 0.9**step)) / (np.sqrt(square[k] / (1 - 0.999**step)) + 1e-8)).astype(np.float32)
    return Model(labels, layers)


def byte_windows(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All windows of consecutive texts, A-Z lower-cased and filled up with spaces, and where each text's begin."""
    count = -(-np.diff(offsets) // WINDOW)
    first = np.concatenate([[0], np.cumsum(count)])
    start = np.repeat(offsets[:-1], count) + words._within(count) * WINDOW
    stop = np.repeat(offsets[1:], count)
    place = start[:, None] + np.arange(WINDOW)
    inside = place < stop[:, None]
    plain = words._LOWER[data]
    return np.where(inside, plain[np.minimum(place, max(len(plain) - 1, 0))], np.uint8(0x20)) if len(plain) else np.zeros((0, WINDOW), np.uint8), first


_LETTERS = np.zeros(256, bool)
_LETTERS[97:123] = True
_LETTERS[128:] = True


def held_out(doc_id: Column) -> Column:
    """Whether a document is kept from training; a null id is not held out, but not learned from either."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def has_letter(text: Column) -> Column:
    return F.coalesce(text.rlike(r"\p{L}"), F.lit(False))


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", texts: int = SAMPLE_TEXTS, total: int = SAMPLE_TOTAL) -> Model:
    """A model fitted to a bounded sample of labelled texts.

    Of rows with an id that is not held out, a text with a letter and a label, the ``texts`` smallest by a hash of
    the id are taken for each label, fewer where ``total`` texts are not enough for that, and SAMPLE_WINDOWS windows at hashed
    places of each. Every label is learned. The driver gets at most SAMPLE_WINDOWS windows of ``total`` texts, or of one text for
    each label where there are more labels than that. Without any such row there are no labels.
    """
    text, key = col(text_col).cast("string"), col(id_col)
    rows = docs.filter(key.isNotNull() & F.col(lang_col).isNotNull() & ~held_out(key) & has_letter(text))
    rows = rows.select(F.col(lang_col).cast("string").alias("lang"), F.xxhash64(key).alias("h"), text.alias("text"))
    counted = rows.groupBy("lang").count().collect()
    if not counted:
        return Model([], {})
    texts = max(1, min(texts, total // len(counted)))
    # About four times the sample of each label goes on to be ranked, however many rows the label has.
    below = [(lang, int(-(2**63) + min(1.0, 4 * texts / n) * (2**64 - 2**11))) for lang, n in counted]
    rows = rows.join(F.broadcast(docs.sparkSession.createDataFrame(below, "lang string, below long")), "lang")
    at = lambda i: F.pmod(F.xxhash64("h", i), F.greatest(F.length("text") - WINDOW + 1, F.lit(1))).cast("int")
    cuts = rows.filter(F.col("h") <= F.col("below")).withColumn("cuts", F.transform(F.sequence(F.lit(0), F.lit(SAMPLE_WINDOWS - 1)), lambda i: F.substring(F.col("text"), at(i) + 1, F.lit(WINDOW))))
    order = Window.partitionBy("lang").orderBy("h", "cuts")
    sample = cuts.select("lang", "h", "cuts").withColumn("n", F.row_number().over(order)).filter(F.col("n") <= texts).orderBy("lang", "n").collect()
    labels = sorted(lang for lang, _ in counted)
    number = {lang: k for k, lang in enumerate(labels)}
    pieces = [(c, number[r["lang"]]) for r in sample for c in r["cuts"]]
    raw = [c.encode()[:WINDOW] for c, _ in pieces]
    data = np.frombuffer(b"".join(raw), np.uint8)
    offsets = np.concatenate([[0], np.cumsum([len(b) for b in raw])])
    windows, first = byte_windows(data, offsets)
    target = np.array([t for _, t in pieces])[np.repeat(np.arange(len(pieces)), np.diff(first))]
    return fit(windows, target, labels)


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang_pred", score_col: str = "score") -> DataFrame:
    """``docs`` with the predicted label and its probability; columns of those names are replaced.

    The prediction reads the whole text and nothing else. A text that is null or has no letter, and any text for a model
    without labels, is ``und`` with score 0. Every row is predicted for itself, whatever its other columns hold.
    """
    plain, usable = free(docs, "plain_text", "usable_text")
    kept = columns(docs, (lang_col, score_col))
    text = col(text_col).cast("string")
    known = docs.select(*kept, has_letter(text).alias(usable), text.alias(plain))
    at = -1
    if isinstance(docs.schema[text_col].dataType, StringType) and text_col.lower() not in (lang_col.lower(), score_col.lower()):
        # The text travels once, as the column that it is.
        known = known.drop(plain)
        at = [c.lower() for c in known.columns].index(text_col.lower())
    sent = docs.sparkSession.sparkContext.broadcast(model)
    own = len(kept)
    schema = StructType(known.schema.fields[:own]).add(lang_col, StringType()).add(score_col, DoubleType())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        for batch in batches:
            label, score = [], []
            text, fine = batch.columns[at], batch.columns[own].to_pylist()
            for row, data, offsets in words.few_pieces(text):
                prob = _text_probabilities(model, data, offsets)
                best = prob.argmax(axis=1) if model.labels else np.zeros(len(prob), int)
                for k, b in enumerate(best.tolist()):
                    real = model.labels and fine[row + k]
                    label.append(model.labels[b] if real else UNKNOWN)
                    score.append(float(prob[k, b]) if real else 0.0)
            yield pa.RecordBatch.from_arrays([*batch.columns[:own], pa.array(label, pa.string()), pa.array(score, pa.float64())], schema.names)

    return map_arrow(known, run, schema)


def _text_probabilities(model: Model, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    texts = len(offsets) - 1
    if not model.labels:
        return np.zeros((texts, 0))
    windows, first = byte_windows(data, offsets)
    prob = np.zeros((len(windows), len(model.labels)))
    for cut in range(0, len(windows), BATCH):
        prob[cut : cut + BATCH] = forward(model.layers, windows[cut : cut + BATCH])[0]
    weight = _LETTERS[windows].sum(axis=1) + 1e-6
    total = np.zeros((texts, len(model.labels)))
    owner = np.repeat(np.arange(texts), np.diff(first))
    for c in range(len(model.labels)):
        total[:, c] = np.bincount(owner, prob[:, c] * weight, texts)
    return total / np.maximum(np.bincount(owner, weight, texts), 1e-9)[:, None]
