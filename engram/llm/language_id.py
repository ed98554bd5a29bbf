"""Language identification: sparse multinomial logistic regression on character n-grams.

Features. Characters are lower-cased; all but letters count as one blank. N-grams
of one to three characters that hold a letter are hashed to ``2 ** BITS`` buckets;
a text's value for a bucket is its share of the text's n-grams times the bucket's
inverse document frequency.

Training. ``sample_rows`` bounds the labelled rows that the model is fitted on: the
rows whose doc_id hash is below a threshold of their language, set from the count of
its rows. It leaves a language its share of ``sample_rows``, but about
``LANGUAGE_ROWS`` at least (all rows, if there are fewer), so that rare languages
are learned whatever the table's size. Document frequencies are the sample's. Their sparse vectors are made on the executors and fitted on
the driver by follow-the-regularised-leader with an elastic net, a step per batch
of rows; every fifth row of a language is kept from fitting and sets the temperature that divides
the logits (least log loss). Rows whose ``crc32(doc_id) mod 4`` is 2 are never
learned from. Doc_id, source and lang are no inputs of a prediction.

Scale. Prediction is a narrow map over whole texts: n-gram weights are gathered and
summed by numpy. The broadcast model has ``2 ** BITS`` floats a language. The driver
holds the sample's vectors, about ``sample_rows`` and ``LANGUAGE_ROWS`` a language at most.

Nulls and odd rows: a null text or one without a letter gets ``und`` and score 0.
A null doc_id is not held out and not learned from. Repeated rows get the same
result. Very long texts are read whole. Without any labelled row all texts are ``und``. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .textbatch import release_memory, slices

BITS = 18
SAMPLE_ROWS = 3000
LANGUAGE_ROWS = 100
ORDERS = (1, 2, 3)
UNDETERMINED = "und"

ALPHA, BETA, L1, L2 = 4.0, 1.0, 1e-3, 1e-4
EPOCHS, BATCH_ROWS = 4, 32

_TABLES: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """Per code point: its lower-case letter, or 0 if it is no letter."""
    if not _TABLES:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            ch = chr(c)
            if ch.isalpha():
                low = ch.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _TABLES.append(table)
    return _TABLES[0]


def _grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
    """Characters' offsets per row, letter counts per row, and the buckets of each order at each character.

    Bucket 0 marks an n-gram without a letter.
    """
    whole = data.tobytes()
    text = whole.decode("utf-8", "replace")
    begins = np.zeros(len(data) + 1, np.int64)
    np.cumsum((data & 0xC0) != 0x80, out=begins[1:])
    rows = begins[offsets]
    if len(text) != begins[-1] or ((data[offsets[:-1][offsets[:-1] < len(data)]] & 0xC0) == 0x80).any():  # a text isn't UTF-8: one by one, so that it changes no other
        texts = [whole[a:b].decode("utf-8", "replace") for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
        text, rows = "".join(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])])
    codes = _letters()[np.frombuffer(text.encode("utf-32-le"), np.uint32)]
    letters = np.zeros(len(codes) + 1, np.int64)
    np.cumsum(codes != 0, out=letters[1:])
    found = []
    key, some = np.zeros(len(codes), np.uint32), np.zeros(len(codes), bool)
    for n in range(1, max(ORDERS) + 1):
        size = max(0, len(codes) - n + 1)
        key = key[:size] * np.uint32(0x01000193) + codes[n - 1 : n - 1 + size] + np.uint32(n)
        some = some[:size] | (codes[n - 1 : n - 1 + size] != 0)
        if n in ORDERS:
            h = (key ^ (key >> np.uint32(15))) * np.uint32(0x9E3779B1)
            found.append(np.where(some, np.maximum(h >> np.uint32(32 - BITS), 1), 0).astype(np.int32))
    return rows, letters[rows[1:]] - letters[rows[:-1]], found


def _vector_map(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for low, high, data, offsets in slices(batch.column("text")):
            rows, _, grams = _grams(data, offsets)
            keys, values = [], []
            for i in range(high - low):
                own = np.concatenate([g[rows[i] : max(rows[i], rows[i + 1] - n + 1)] for n, g in zip(ORDERS, grams, strict=True)])
                bucket, count = np.unique(own[own > 0], return_counts=True)
                keys.append(bucket.astype("<i4").tobytes())
                values.append((count / max(1, count.sum())).astype("<f4").tobytes())
            yield pa.RecordBatch.from_arrays([batch.column("lang").slice(low, high - low), batch.column("at").slice(low, high - low), pa.array(keys, pa.binary()), pa.array(values, pa.binary())], ["lang", "at", "keys", "values"])
    release_memory()


class Model:
    """Weights per bucket and language (idf included), biases and temperature."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, temperature: float):
        self.languages, self.weights, self.bias, self.temperature = languages, weights, bias, temperature


def _softmax(z: np.ndarray) -> np.ndarray:
    e = np.exp(z - z.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


class FtrlRegression:
    """Multinomial logistic regression by FTRL-proximal with L1 and L2 penalties."""

    def __init__(self, dims: int, classes: int):
        self.z, self.n = np.zeros((dims, classes)), np.zeros((dims, classes))
        self.classes = classes

    def weights(self, at: np.ndarray | slice = slice(None)) -> np.ndarray:
        z, n = self.z[at], self.n[at]
        return np.where(np.abs(z) <= L1, 0.0, (np.sign(z) * L1 - z) / ((BETA + np.sqrt(n)) / ALPHA + L2))

    def step(self, keys: np.ndarray, values: np.ndarray, rows: np.ndarray, y: np.ndarray) -> None:
        """One update from a batch: entries (row, key, value) and the class of each row."""
        at, inverse = np.unique(keys, return_inverse=True)
        w = self.weights(at)
        logits = np.column_stack([np.bincount(rows, values * w[inverse, c], len(y)) for c in range(self.classes)])
        error = _softmax(logits)
        error[np.arange(len(y)), y] -= 1
        g = np.column_stack([np.bincount(inverse, values * error[rows, c], len(at)) for c in range(self.classes)])
        sigma = (np.sqrt(self.n[at] + g * g) - np.sqrt(self.n[at])) / ALPHA
        self.z[at] += g - sigma * w
        self.n[at] += g * g


def _temperature(logits: np.ndarray, y: np.ndarray) -> float:
    """The divisor of the logits with the least log loss, by golden section on its logarithm."""
    loss = lambda t: -np.log(_softmax(logits / np.exp(t))[np.arange(len(y)), y] + 1e-12).mean()
    low, high, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = high - ratio * (high - low), low + ratio * (high - low)
        low, high = (low, b) if loss(a) <= loss(b) else (a, high)
    return float(np.exp((low + high) / 2))


def fit(rows: list[tuple[str, np.ndarray, np.ndarray]], seed: int = 7) -> Model | None:
    """A model from (language, buckets, values) of each sampled row."""
    rows = [r for r in rows if len(r[1])]
    languages = sorted({r[0] for r in rows})
    if not languages:
        return None
    label = {name: i for i, name in enumerate(languages)}
    y = np.array([label[r[0]] for r in rows])
    place = np.empty(len(rows), np.int64)
    for c in range(len(languages)):
        place[y == c] = np.arange((y == c).sum())
    held = place % 5 == 4
    if held.sum() < 20:
        held[:] = False
    df = np.zeros(1 << BITS)
    for r in rows:
        df[r[1]] += 1
    idf = np.log((1 + len(rows)) / (1 + df)) + 1
    bias = 1 << BITS  # a feature that every row has
    model = FtrlRegression((1 << BITS) + 1, len(languages))
    fitted = np.flatnonzero(~held)
    rng = np.random.default_rng(seed)

    def entries(picked: np.ndarray):
        keys = np.concatenate([np.append(rows[i][1], bias) for i in picked])
        values = np.concatenate([np.append(rows[i][2] * idf[rows[i][1]], 1.0) for i in picked])
        return keys, values, np.repeat(np.arange(len(picked)), [len(rows[i][1]) + 1 for i in picked])

    for _ in range(EPOCHS):
        for picked in np.array_split(rng.permutation(fitted), max(1, len(fitted) // BATCH_ROWS)):
            keys, values, owner = entries(picked)
            model.step(keys, values, owner, y[picked])
    w = model.weights()
    temperature = 1.0
    if held.any():
        keys, values, owner = entries(np.flatnonzero(held))
        logits = np.column_stack([np.bincount(owner, values * w[keys, c], held.sum()) for c in range(len(languages))])
        temperature = _temperature(logits, y[held])
    weights = w[:bias] * idf[:, None]
    weights[0] = 0
    return Model(languages, weights.astype(np.float32), w[bias], temperature)


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def train(documents: DataFrame, sample_rows: int = SAMPLE_ROWS) -> Model | None:
    """Fit on about ``sample_rows`` labelled rows that aren't held out, some of each language."""
    known = documents.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & F.col("text").isNotNull() & ~held_out(F.col("doc_id"))).select("doc_id", F.col("lang").cast("string").alias("lang"), "text")
    counts = {r["lang"]: r["count"] for r in known.groupBy("lang").count().collect()}
    total = sum(counts.values())
    if not total:
        return None
    span = 1 << 32
    limits = [(name, min(span, span * max(LANGUAGE_ROWS, sample_rows * n // total) // n + 1)) for name, n in counts.items()]
    below = F.broadcast(documents.sparkSession.createDataFrame(limits, "sampled_lang string, below long"))
    at = F.pmod(F.xxhash64(F.col("doc_id"), F.lit(11)), F.lit(span))
    picked = known.join(below, F.col("lang") == F.col("sampled_lang")).where(at < F.col("below")).select("lang", at.alias("at"), F.col("text").cast("string").alias("text"))
    got = picked.mapInArrow(_vector_map, "lang string, at long, keys binary, values binary").collect()
    got.sort(key=lambda r: (r["at"], r["keys"], r["lang"]))
    return fit([(r["lang"], np.frombuffer(r["keys"], "<i4"), np.frombuffer(r["values"], "<f4").astype(float)) for r in got])


def _predict_map(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model: Model | None = shared.value
        for batch in batches:
            for low, high, data, offsets in slices(batch.column("text")):
                n = high - low
                rows, letters, grams = _grams(data, offsets)
                names, score = np.full(n, UNDETERMINED, object), np.zeros(n)
                if model is not None:
                    sums, count = np.zeros((n, len(model.languages))), np.zeros(n)
                    for order, g in zip(ORDERS, grams, strict=True):
                        last = np.minimum(np.maximum(rows[:-1], rows[1:] - order + 1), len(g))
                        first = np.minimum(rows[:-1], len(g))
                        upto = np.zeros(len(g) + 1)
                        np.cumsum(g > 0, out=upto[1:])
                        count += upto[last] - upto[first]
                        for c in range(len(model.languages)):
                            np.cumsum(model.weights[g, c], out=upto[1:])
                            sums[:, c] += upto[last] - upto[first]
                    p = _softmax((sums / np.maximum(count, 1)[:, None] + model.bias) / model.temperature)
                    best = p.argmax(axis=1)
                    told = letters > 0
                    names[told] = np.array(model.languages, object)[best[told]]
                    score[told] = p[told, best[told]]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(low, n), batch.column("held_out").slice(low, n), pa.array(names, pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])
        release_memory()

    return run


def identify(documents: DataFrame, model: Model | None) -> DataFrame:
    """(doc_id, held_out, lang_pred, score) of every document."""
    shared = documents.sparkSession.sparkContext.broadcast(model)
    docs = documents.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return docs.mapInArrow(_predict_map(shared), "doc_id long, held_out boolean, lang_pred string, score double")
