"""Quality classifier: supervised subword embeddings.

A document is the average of learned vectors of its words, its words' byte
n-grams (with the space on either side) and its word repeats, all hashed into
one table; a softmax layer scores it.  Training is stochastic gradient descent
in numpy on a bounded sample of labelled rows.  For scoring, the vectors and
the layer are folded into one number a hash, so that a text costs a few numpy
passes over its bytes.

Defined results: a null text is an empty one; a text without words has the
score of the layer's bias.  Rows are scored one by one, whatever their ids.
Labels that are null, of another value than 0 and 1, or without a document are
not used; without any usable label every score is 0.5.
"""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .shared import slices, small_batches
from .textvec import U, Words, mix, spaced

BUCKETS = 1 << 16
GRAMS = (3, 4, 5)
#: How far back a word's repeats are looked for, in words.
REPEATS = tuple(range(1, 9))
GRAIN = 1 << 24


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(5)) == 0, F.lit(False))


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, rows: int, chars: int, *, alike: bool = False) -> DataFrame:
    """``place, text, y`` of at most ``rows`` labelled documents outside the
    held-out fifth, in the order of a hash of doc_id, as far as their texts have
    at most ``chars`` characters together.  A repeated row counts once.  The
    driver sees at most ``rows`` ids and sizes, and no text.  alike: the labels
    take turns, so a rare one has half of the sample if there are so many."""
    usable = labels.where(~held_out(F.col("doc_id")) & F.col(label).isin(0, 1)).groupBy(F.col("doc_id").cast("long").alias("doc_id")).agg(F.max(F.col(label).cast("int")).alias("y"))
    order = F.xxhash64("doc_id", F.lit(label))
    chosen = usable.withColumn("_o", order)
    if alike:
        firsts = [chosen.where(F.col("y") == y).orderBy("_o", "doc_id").limit(rows) for y in (0, 1)]
        turn = F.row_number().over(Window.partitionBy("y").orderBy("_o", "doc_id"))
        chosen = firsts[0].unionAll(firsts[1]).withColumn("_o", turn * 2 - F.col("y"))
    chosen = chosen.orderBy("_o", "doc_id").limit(rows)
    crc = F.crc32(F.encode(F.coalesce("text", F.lit("")), "utf-8")).alias("crc")
    sized = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.length("text"), F.lit(0)).alias("size"), crc).join(F.broadcast(chosen), "doc_id")
    picked, total = {}, 0
    for r in sized.dropDuplicates(["doc_id", "crc"]).orderBy("_o", "doc_id", "crc").limit(rows).collect():
        if total + r["size"] <= chars:
            total += r["size"]
            picked[r["doc_id"], r["crc"]] = r["y"]
    wanted = docs.sparkSession.createDataFrame([(*k, i, y) for i, (k, y) in enumerate(picked.items())], "doc_id long, crc long, place long, y int")
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", crc).join(F.broadcast(wanted), ["doc_id", "crc"])
    return texts.select("place", "text", "y").dropDuplicates(["place"])


def fitted(sample: DataFrame, train: Callable[[pd.DataFrame], object]) -> object:
    """What ``train`` makes of the whole sample (text, y).  It runs in one task,
    to which the bounded sample is sent, so neither texts nor training weigh on
    the driver, and a lost executor costs a retry."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = [batch.to_pandas() for batch in batches]
        if rows:
            model = train(pd.concat(rows).sort_values("place", ignore_index=True))
            yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(model)], pa.binary())], names=["model"])

    found = sample.repartition(1).mapInArrow(run, "model binary").collect()
    return pickle.loads(found[0][0]) if found else train(pd.DataFrame({"text": [], "y": []}))


def features(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Hash bucket and text index of the features of a batch, part by part."""
    low = U(BUCKETS - 1)
    w = Words([spaced(t) for t in texts])
    yield (w.hashes & low).astype(np.uint16), w.doc
    for n in GRAMS:
        for h, d in w.grams(n):
            yield (h & low).astype(np.uint16), d
    for back in REPEATS:
        within = w.doc[back:] == w.doc[:-back]
        same = (w.hashes[back:] == w.hashes[:-back])[within]
        # said whether or not it repeats, so that its share in a text counts
        said = (mix(np.arange(2, dtype=U) + U(2 * back)) & low).astype(np.uint16)
        yield said[same.astype(np.int8)], w.doc[back:][within]


def train(sample: pd.DataFrame, *, dim: int = 8, epochs: int = 4, rate: float = 0.5, seed: int = 5) -> tuple[np.ndarray, float]:
    """Fitted table (a number a bucket: how far its vector speaks for label 1)
    and bias."""
    if sample.empty or sample.y.nunique() < 2:
        return np.zeros(BUCKETS), 0.0
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / dim, 1 / dim, (BUCKETS, dim)).astype(np.float32)
    layer, bias = rng.normal(0, 0.1, (dim, 2)).astype(np.float32), np.zeros(2, np.float32)
    rows = []
    texts = sample.text.tolist()
    for lo, hi in slices(texts):
        bucket, doc = (np.concatenate(x) for x in zip(*features(texts[lo:hi])))
        order = np.argsort(doc, kind="stable")
        bucket, ends = bucket[order], np.cumsum(np.bincount(doc, minlength=hi - lo))
        for start, end in zip(np.concatenate([[0], ends[:-1]]), ends):
            ids, counts = np.unique(bucket[start:end], return_counts=True)
            rows.append((ids, (counts / max(1, end - start)).astype(np.float32)))
    y = sample.y.to_numpy()
    steps, total = 0, epochs * len(rows)
    for _ in range(epochs):
        for i in rng.permutation(len(rows)):
            ids, share = rows[i]
            speed = rate * (1 - steps / total)
            steps += 1
            hidden = share @ vectors[ids]
            z = hidden @ layer + bias
            p = np.exp(z - z.max())
            p /= p.sum()
            p[y[i]] -= 1
            back = layer @ p
            layer -= speed * np.outer(hidden, p)
            bias -= speed * p
            # each feature's step is by its share of the average; scaled up, as averages are long
            vectors[ids] -= (speed * np.minimum(1.0, share * 20))[:, None] * back
    spread = layer[:, 1] - layer[:, 0]
    # multiples of a power of two: their sums are exact, whatever the order of the parts
    return np.round((vectors @ spread).astype(np.float64) * GRAIN) / GRAIN, float(bias[1] - bias[0])


def scores(texts: list[str | None], table: np.ndarray, bias: float) -> np.ndarray:
    out = np.empty(len(texts))
    for lo, hi in slices(texts):
        count, total = np.zeros(hi - lo), np.zeros(hi - lo)
        for bucket, doc in features(texts[lo:hi]):
            count += np.bincount(doc, minlength=hi - lo)
            total += np.bincount(doc, weights=table[bucket], minlength=hi - lo)
        out[lo:hi] = 1 / (1 + np.exp(-np.clip(total / np.maximum(count, 1) + bias, -60, 60)))
    return out


def quality_score(docs: DataFrame, labels: DataFrame, *, rows: int = 3000, chars: int = 12_000_000):
    """A function from a text column to its score, fitted on at most ``rows``
    labelled rows of at most ``chars`` characters together."""
    small_batches(docs.sparkSession)
    model = docs.sparkSession.sparkContext.broadcast(fitted(labelled_sample(docs, labels, "quality", rows, chars), train))

    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for part in parts:
            yield pd.Series(scores(part.tolist(), *model.value))

    run.__annotations__ = {"parts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return F.pandas_udf(run, "double")


def score_quality(docs: DataFrame, labels: DataFrame, **limits) -> DataFrame:
    """``doc_id, held_out, score, predicted`` for each row of ``docs``."""
    score = quality_score(docs, labels, **limits)
    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held_out(F.col("doc_id")).alias("held_out"), score("text").alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= 0.3).cast("int"))
