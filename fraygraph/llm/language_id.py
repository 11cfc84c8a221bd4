"""Language identification: blended-spectrum n-gram presence kernels, Nystroem landmarks, kernel ridge regression.

A text is the set of its byte n-grams of lengths 1 to ``LONGEST`` (A-Z lower-cased), hashed to ``WIDTH`` places. The kernel of
two texts is the number of places both have, over the geometric mean of their own numbers. ``LANDMARKS`` texts span the
Nystroem feature space; one ridge regression per language (one against the rest) is solved in it. Scoring a batch is a
presence matrix times the landmark matrix, a normalisation, and one more matrix product.

Only the fit is sampled: at most ``SAMPLE`` labelled texts per language, about ``MOST_SAMPLED`` in all (at least one per
language, however many there are), chosen by a hash of the document id. Every text is predicted, whole.

Nulls and odd input: a text that is null or has no letter is ``und`` with score 0; rows without language or id are never
learned from; with nothing to learn from every text is ``und``. Ties go to the language first in order. Repeated rows are
predicted each; an empty table gives no rows. Other columns stay, those named like a result column are replaced.
"""

from __future__ import annotations

from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from fraygraph.llm.tables import query, read, with_arrow

WIDTH = 4096
LONGEST = 3
SAMPLE = 400
MOST_SAMPLED = 20_000
LANDMARKS = 192
RIDGE = 1e-2
BATCH = 128
UNKNOWN = "und"
FOLDS = 5
# Odd multipliers that mix the bytes of an n-gram into its place.
MIX = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35))
SEPARATORS = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))


def places(data: bytes) -> np.ndarray:
    """Hashed places of all n-grams of lower-cased ``data``, with repeats."""
    own = np.frombuffer(data.translate(SEPARATORS), np.uint8).astype(np.uint32)
    mixed = np.zeros(len(own), np.uint32)
    found = []
    for n in range(LONGEST):
        if len(own) <= n:
            break
        mixed = (mixed[: len(own) - n] * np.uint32(257) + own[n:] + np.uint32(1)) if n else own + np.uint32(1)
        found.append(((mixed * MIX[n]) >> np.uint32(32 - 12)).astype(np.int32))
    return np.concatenate(found) if found else np.zeros(0, np.int32)


def presence(texts: list[str]) -> np.ndarray:
    matrix = np.zeros((len(texts), WIDTH), np.float32)
    for row, text in zip(matrix, texts):
        row[places(text.encode())] = 1
    return matrix


def kernel(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """Normalised presence kernel of all pairs of rows, a matrix product."""
    sizes = [np.sqrt(np.maximum(1, x.sum(axis=1))) for x in (left, right)]
    return (left @ right.T) / (sizes[0][:, None] * sizes[1][None, :])


class Model:
    """Landmarks and the weights that turn kernel values with them into one value per language."""

    def __init__(self, rows: np.ndarray, languages: list[str]):
        self.names = sorted(set(languages))
        spread = np.arange(len(rows)) if len(rows) <= LANDMARKS else np.unique(np.linspace(0, len(rows) - 1, LANDMARKS).astype(int))
        self.landmarks = rows[spread]
        values, vectors = np.linalg.eigh(kernel(self.landmarks, self.landmarks).astype(np.float64))
        useful = values > 1e-6 * values.max()
        self.to_features = vectors[:, useful] / np.sqrt(values[useful])
        features = kernel(rows, self.landmarks) @ self.to_features
        goals = np.where(np.array(languages)[:, None] == np.array(self.names)[None, :], 1.0, -1.0)
        # Every language weighs the same, however many texts of it there are.
        times = Counter(languages)
        weights = np.array([1 / times[x] for x in languages]) * len(languages) / len(self.names)
        self.mean = (weights[:, None] * features).sum(axis=0) / weights.sum()
        self.goal = (weights[:, None] * goals).sum(axis=0) / weights.sum()
        centred, wanted = features - self.mean, goals - self.goal
        gram = centred.T @ (weights[:, None] * centred) + RIDGE * len(rows) * np.eye(features.shape[1]) / features.shape[1]
        self.weights = np.linalg.solve(gram, centred.T @ (weights[:, None] * wanted))
        self.final = (self.to_features @ self.weights).astype(np.float32)
        self.offset = (self.goal - self.mean @ self.weights).astype(np.float32)

    def values(self, rows: np.ndarray) -> np.ndarray:
        return kernel(rows, self.landmarks) @ self.final + self.offset


def held_out(folds: int = FOLDS) -> Column:
    """Whether a document is kept from learning: crc32 of its id as text is divisible by ``folds``."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % folds == 0, F.lit(False))


def fit(documents: DataFrame) -> Model | None:
    """Learn from a bounded sample of the labelled documents (doc_id, text, lang) that are not held out."""
    usable = F.col("doc_id").isNotNull() & F.col("lang").isNotNull() & F.col("text").rlike(r"\p{L}") & ~held_out()
    labelled = documents.filter(usable).select("doc_id", "lang", F.xxhash64("doc_id").alias("_draw"))
    counts = labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()  # a row per language
    if not counts:
        return None
    each = max(1, min(SAMPLE, MOST_SAMPLED // len(counts)))
    # About twice the sample of each language by a threshold on the hash, then exactly the least hashes of those.
    share = {r.lang: min(1.0, (2 * each + 20) / r.n) for r in counts}
    below = F.element_at(F.create_map(*[F.lit(x) for r in share.items() for x in r]), F.col("lang"))
    drawn = documents.filter(usable & F.col("lang").isin(list(share))).withColumn("_draw", F.xxhash64("doc_id"))
    drawn = drawn.filter(F.pmod("_draw", F.lit(1 << 40)) < below * float(1 << 40)).select("lang", "doc_id", "_draw", "text")

    def features(batches):
        for batch in batches:
            texts = batch.column(3).to_pylist()
            rows = [np.packbits(presence([t])[0].astype(bool)).tobytes() for t in texts]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), batch.column(2), pa.array(rows, pa.binary())], names=["lang", "doc_id", "draw", "bits"])

    packed = drawn.mapInArrow(features, "lang string, doc_id long, draw long, bits binary")
    first = Window.partitionBy("lang").orderBy("draw", "doc_id", "bits")
    sample = packed.withColumn("n", F.row_number().over(first)).filter(F.col("n") <= each).orderBy("draw", "doc_id", "lang", "bits").collect()
    rows = np.array([np.unpackbits(np.frombuffer(r.bits, np.uint8)) for r in sample], np.float32)
    return Model(rows, [r.lang for r in sample])


def predict(documents: DataFrame, model: Model | None, text: str = "text") -> DataFrame:
    """``documents`` plus lang_pred and score, from the text alone."""
    names = model.names if model else []
    if model:  # plain arrays: at most LANDMARKS x WIDTH bits and a value per landmark and language
        bits, final, offset = np.packbits(model.landmarks.astype(bool), axis=1), model.final, model.offset
    ready: list = []

    def run(texts):
        tags, scores = [UNKNOWN] * len(texts), [0.0] * len(texts)
        known = [i for i, t in enumerate(texts) if t is not None and any(map(str.isalpha, t))] if names else []
        if not ready and names:
            landmarks = np.unpackbits(bits, axis=1).astype(np.float32)
            ready.append((landmarks / np.sqrt(np.maximum(1, landmarks.sum(axis=1)))[:, None]).T.copy())
        for start in range(0, len(known), BATCH):
            part = known[start : start + BATCH]
            rows = presence([texts[i] for i in part])
            values = (rows @ ready[0]) / np.sqrt(np.maximum(1, rows.sum(axis=1)))[:, None] @ final + offset
            best = values.argmax(axis=1)
            for i, k, v in zip(part, best.tolist(), values.max(axis=1).tolist()):
                tags[i], scores[i] = names[k], min(1.0, max(0.0, (v + 1) / 2))
        return {"lang_pred": tags, "score": scores}

    return with_arrow(documents, [text], "lang_pred string, score double", run)


@query("op5_language_id")
def _(spark, sf):
    documents = read(spark, sf, "documents", "doc_id", "text", "lang")
    model = fit(documents)
    return predict(documents.select("doc_id", "text", held_out().alias("held_out")), model).select("doc_id", "held_out", "lang_pred", "score")
