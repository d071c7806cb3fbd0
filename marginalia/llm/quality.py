"""Quality classifier over learned subword embeddings.

A document is the mean of vectors of its words, of their character n-grams, of pairs of the same
word and of its end, all hashed into one table; a softmax layer over that mean gives the classes.  Vectors and layer are learned together by
stochastic gradient descent in numpy, on a bounded sample of labelled rows.  Because the mean is
linear, a word's share of the output is the same wherever it stands: scoring looks up one number
for each word of a whole text.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.llm.spans import Pieces

BUCKETS, DIM = 1 << 17, 16
GRAMS = (3, 4)
#: Labelled rows that are learned from at most, those of least hash of their key.
MAX_ROWS, EPOCHS, BATCH, RATE = 3000, 12, 32, 2.0
#: Words of each of two generations that a worker holds: it keeps the memory after the stage.
WORDS = 100_000


def features(word: str) -> np.ndarray:
    """Table rows of a word: one for the whole, one for each n-gram of it within < and >."""
    raw = f"<{word}>".encode()
    return np.asarray([zlib.crc32(raw) % BUCKETS, *(zlib.crc32(raw[i : i + n], n) % BUCKETS for n in GRAMS for i in range(len(raw) - n + 1))], np.int32)


#: Table rows of the end of a text and of a word pair whose words are the same, and how often each
#: counts: the end steadies short texts, the pair tells running text from a word said over and over.
END, SAME = zlib.crc32(b"</s>") % BUCKETS, zlib.crc32(b"<w w>") % BUCKETS
END_COUNT, SAME_COUNT = 16, 8


def same_pairs(words: list[str]) -> int:
    return sum(map(eq, words, words[1:]))


def bag(text: str, words: Pieces) -> tuple[np.ndarray, np.ndarray]:
    """Distinct features of a whole text and their shares."""
    found = text.split()
    extra = np.repeat(np.asarray([END, SAME], np.int32), [END_COUNT, SAME_COUNT * same_pairs(found)])
    ids, n = np.unique(np.concatenate([extra, *map(words.__getitem__, found)]), return_counts=True)
    return ids.astype(np.int32), (n / n.sum()).astype(np.float32)


@dataclass
class Model:
    vectors: np.ndarray  # (BUCKETS, DIM)
    layer: np.ndarray  # (2, DIM)
    bias: np.ndarray  # (2,)

    def shares(self) -> np.ndarray:
        """What each feature adds to the difference of the two outputs."""
        return self.vectors @ (self.layer[1] - self.layer[0])


def train(bags: list[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, seed: int = 0) -> Model:
    """Softmax regression over mean vectors, both learned, by gradient descent in small batches."""
    rng = np.random.default_rng(seed)
    m = Model(rng.uniform(-1 / DIM, 1 / DIM, (BUCKETS, DIM)).astype(np.float32), rng.uniform(-1, 1, (2, DIM)).astype(np.float32), np.zeros(2, np.float32))
    if not len(labels):  # nothing to learn from: every score is 0.5
        m.layer[:] = 0
        return m
    steps, done = EPOCHS * -(-len(labels) // BATCH), 0
    for _ in range(EPOCHS):
        order = rng.permutation(len(labels))
        for i in range(0, len(order), BATCH):
            rate = RATE * (1 - done / steps)
            done += 1
            own = order[i : i + BATCH]
            sizes = [len(bags[j][0]) for j in own]
            ids = np.concatenate([bags[j][0] for j in own])
            share = np.concatenate([bags[j][1] for j in own])
            doc = np.repeat(np.arange(len(own)), sizes)
            mean = np.zeros((len(own), DIM), np.float32)
            for d in range(DIM):
                mean[:, d] = np.bincount(doc, share * m.vectors[ids, d], len(own))
            out = mean @ m.layer.T + m.bias
            p = np.exp(out - out.max(axis=1, keepdims=True))
            p /= p.sum(axis=1, keepdims=True)
            err = p.copy()
            err[np.arange(len(own)), labels[own]] -= 1  # of the cross entropy by the outputs
            m.layer -= rate / len(own) * err.T @ mean
            m.bias -= rate / len(own) * err.sum(axis=0)
            # with two classes err has one degree of freedom: one number for each feature
            direction = m.layer[1] - m.layer[0]
            pull = np.bincount(ids, share * err[doc, 1], BUCKETS)
            touched = np.flatnonzero(pull)
            m.vectors[touched] -= (rate * pull[touched, None] * direction).astype(np.float32)
    return m


def learned_from(key: Column) -> Column:
    """Rows whose labels may be learned: crc32 of the key as text, modulo 3, is not 1."""
    return (F.crc32(key.cast("string").cast("binary")) % 3) != 1


def fit(docs: DataFrame, labels: DataFrame, label: str = "quality", text: str = "text", key: str = "doc_id", max_rows: int = MAX_ROWS) -> Model:
    """Learn from at most ``max_rows`` labelled rows that ``learned_from`` admits; rows without a
    label, and labels without a row, are passed over."""
    known = labels.filter(F.col(label).isin(0, 1) & F.col(key).isNotNull() & learned_from(F.col(key))).select(F.col(key).alias("key"), F.col(label).cast("int").alias("label")).distinct()
    picked = known.orderBy(F.xxhash64("key"), "key", "label").limit(max_rows)
    # max_rows pairs of numbers at most
    rows = docs.select(F.col(key).alias("key"), F.col(text).alias("text")).join(F.broadcast(picked), "key")

    def bags(batches):
        words = Pieces(features, WORDS // 4)
        for b in batches:
            out = [bag(t or "", words) for t in b.column(2).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array([i.tobytes() for i, _ in out], pa.binary()), pa.array([s.tobytes() for _, s in out], pa.binary())], names=["key", "label", "ids", "share"])

    kind = docs.schema[key].dataType.simpleString()
    found = rows.select("key", "label", "text").mapInArrow(bags, f"key {kind}, label int, ids binary, share binary").toArrow()
    found = found.sort_by([("key", "ascending"), ("label", "ascending"), ("ids", "ascending")])
    data = [(np.frombuffer(i, np.int32), np.frombuffer(s, np.float32)) for i, s in zip(found["ids"].to_pylist(), found["share"].to_pylist())]
    return train(data, found["label"].to_numpy())


def scored(docs: DataFrame, model: Model, text: str = "text") -> DataFrame:
    """``docs`` with a last column score: the probability of class 1 for each whole text.

    A null text counts as empty; without words the vector of the text's end decides.
    """
    spark = docs.sparkSession
    # one number for each row of the table: 1 MB however large the corpus
    sent = spark.sparkContext.broadcast((model.shares().astype(np.float64), float(model.bias[1] - model.bias[0])))

    def score(texts):
        import pandas as pd

        shares, bias = sent.value

        def give(w):
            f = features(w)
            return complex(shares[f].sum(), len(f))  # its share and its number of features

        words = Pieces(give, WORDS)
        for batch in texts:
            out = np.zeros(len(batch))
            for i, t in enumerate(batch):
                found = t.split() if t else []
                same = SAME_COUNT * same_pairs(found)
                total = sum(map(words.__getitem__, found), complex(END_COUNT * shares[END] + same * shares[SAME], END_COUNT + same))
                z = bias + total.real / total.imag
                out[i] = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
            yield pd.Series(out)

    from collections.abc import Iterator

    import pandas as pd

    score.__annotations__ = {"texts": Iterator[pd.Series], "return": Iterator[pd.Series]}
    return docs.withColumn("score", F.pandas_udf(score, "double")(F.col(text)))


def quality_scores(docs: DataFrame, labels: DataFrame, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, held_out, score, predicted for every row of ``docs``.

    Only the text decides a score; equal rows give equal rows, an empty table none.  A null key is
    held out.  Without labelled rows to learn from every score is 0.5.
    """
    rows = docs.select(F.col(key), F.col(text).alias("text"))
    out = scored(rows, fit(docs, labels, text=text, key=key))
    return out.select(key, F.coalesce(~learned_from(F.col(key)), F.lit(True)).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
