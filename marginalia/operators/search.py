"""Search over notes: nearest vectors, and ranked words, for one question or a table of them."""

from __future__ import annotations

import functools
import heapq
import json

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions import lexemes as L
from marginalia.functions.udf import arrow
from marginalia.functions.vectors import cosine_similarity

K = 12
#: Questions of one pass over the notes: what the driver and every task hold of them at once; and
#: notes that are compared with them at a time.
QUESTIONS, NOTES = 4096, 256


def nearest(notes: DataFrame, vector: list[float], k: int = K) -> DataFrame:
    """The k notes (id, embedding) nearest to a vector, with their similarity; ties by id.

    The vector is a literal, so the scan projects and each task keeps k rows: no shuffle of notes.
    """
    q = F.array(*(F.lit(float(x)) for x in vector))
    found = notes.filter(F.col("embedding").isNotNull()).withColumn("similarity", F.round(cosine_similarity(F.col("embedding"), q), 6))
    return found.orderBy(F.col("similarity").desc(), "id").limit(k)


# ---------------------------------------------------------------- tables of vectors


def _unit(rows: list) -> np.ndarray:
    """Vectors of one dimension as rows of length one; a zero vector has no direction: NaN."""
    x = np.asarray(rows, np.float64)
    with np.errstate(invalid="ignore", divide="ignore"):
        return x / np.sqrt((x * x).sum(axis=1))[:, None]


def _best(keys: list, vectors: np.ndarray, k: int, kind: str):
    """The k best notes of a task for each question: a product of matrices for each batch, of which
    only what beats the k-th so far is looked at."""

    def run(batches):
        held: list[list] = [[] for _ in keys]  # least similarity first, of equals the largest id
        least = np.full(len(keys), -np.inf)
        schema = None
        for b in batches:
            schema = b.schema
            rows = [(i, v) for i, v in zip(b.column("id").to_pylist(), b.column("embedding").to_pylist()) if v is not None and None not in v and len(v) == vectors.shape[1]]
            if not rows:
                continue
            ids = [i for i, _ in rows]
            unit = _unit([v for _, v in rows])
            for at in range(0, len(rows), NOTES):
                similar = unit[at : at + NOTES] @ vectors.T
                for n, q in zip(*np.nonzero(similar >= least)):
                    entry = (float(similar[n, q]), _Falling(ids[at + n]))
                    if len(held[q]) < k:
                        heapq.heappush(held[q], entry)
                    elif held[q][0] < entry:
                        heapq.heapreplace(held[q], entry)
                    if len(held[q]) == k:
                        least[q] = held[q][0][0]
        out = [(n, e[1].value, e[0]) for n, h in enumerate(held) for e in h]
        if out:
            n, ids, similar = zip(*out)
            yield pa.RecordBatch.from_arrays([pa.array([keys[i] for i in n]).cast(_ARROW.get(kind, pa.string())), pa.array(ids, schema.field("id").type), pa.array(similar, pa.float64())], names=["question", "id", "similarity"])

    return run


_ARROW = {"bigint": pa.int64(), "int": pa.int32(), "string": pa.string()}


class _Falling:
    """A value whose order is turned round."""

    def __init__(self, value):
        self.value = value

    def __lt__(self, other):
        return other.value < self.value

    def __eq__(self, other):
        return self.value == other.value


def nearest_each(questions: DataFrame, notes: DataFrame, k: int = K, held: int = QUESTIONS) -> DataFrame:
    """(question, id, similarity, rank): the k notes nearest to each question's vector.

    ``questions`` has id and embedding, ``notes`` id and embedding.  Questions go to the notes in
    blocks of at most some ``held``, each one pass; a task hands on k rows for each question of the
    block, and these are merged.  Ties go by id; null, zero and other-dimensional vectors are near to
    nothing; ids are whole numbers or strings.
    """
    kind, of = questions.schema["id"].dataType.simpleString(), notes.schema["id"].dataType.simpleString()
    asked = questions.filter("embedding IS NOT NULL AND id IS NOT NULL").select("id", "embedding")
    blocks = max(1, -(-asked.count() // held))
    found = None
    for block in range(blocks):
        rows = asked.filter(F.pmod(F.xxhash64("id"), F.lit(blocks)) == block).collect()
        for size in sorted({len(r["embedding"]) for r in rows if None not in r["embedding"]}):
            own = [r for r in rows if len(r["embedding"]) == size]
            part = notes.select("id", "embedding").mapInArrow(_best([r["id"] for r in own], _unit([r["embedding"] for r in own]), k, kind), f"question {kind}, id {of}, similarity double")
            found = part if found is None else found.union(part)
    if found is None:
        found = notes.sparkSession.createDataFrame([], f"question {kind}, id {of}, similarity double")
    order = Window.partitionBy("question").orderBy(F.desc("similarity"), "id")
    return found.filter(~F.isnan("similarity")).withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


# ---------------------------------------------------------------- words


_VECTOR = pa.list_(pa.struct([("lexeme", pa.string()), ("at", pa.list_(pa.int32()))]))


def vectors(text: Column) -> Column:
    """Lexemes of texts with their places; equal texts of a batch are read once."""

    def read(texts: pa.Array) -> pa.Array:
        each = texts.fill_null("").dictionary_encode()
        found = [[{"lexeme": w, "at": at} for w, at in L.vector(t).items()] for t in each.dictionary.to_pylist()]
        return pa.array(found, _VECTOR).take(each.indices)

    return F.arrow_udf(read, "array<struct<lexeme:string,at:array<int>>>")(text)


def ranked(notes: DataFrame, query: str, k: int | None = K, text: str = "content", forms: dict[str, str] | None = None) -> DataFrame:
    """The k notes that match a query best, with their similarity; all without k.  Ties by id.

    See ``lexemes.parsed`` for queries and ``lexemes.rank`` for similarity; a query of which nothing
    is left matches nothing.  ``forms`` takes the place of the stemmer (``lexemes.lexeme``).
    """
    terms = L.parsed(query, forms)
    if not terms:
        return notes.withColumn("similarity", F.lit(0.0)).limit(0)

    @F.pandas_udf("double")
    def similar(texts: pd.Series) -> pd.Series:
        found = (L.vector(t, forms) for t in texts)
        return pd.Series([L.rank(terms, v) if L.holds(terms, v) else None for v in found], dtype="float64")

    hits = notes.withColumn("similarity", similar(F.col(text))).filter("similarity IS NOT NULL AND NOT isnan(similarity)")
    return hits if k is None else hits.orderBy(F.col("similarity").desc(), "id").limit(k)


def postings(notes: DataFrame, text: str = "content") -> DataFrame:
    """(lexeme, id, at): the inverted index of a table of notes, which may be kept for later."""
    return notes.select("id", F.explode(vectors(F.col(text))).alias("x")).select("x.lexeme", "id", "x.at")


@arrow("struct<query:string,words:array<string>>")
def _read(query: pd.Series) -> pd.DataFrame:
    found = [L.parsed(q or "") for q in query]
    return pd.DataFrame({"query": [json.dumps(q) for q in found], "words": [L.operands(q) for q in found]})


@functools.lru_cache(4096)
def _parsed(query: str) -> list[list[L.Term]]:
    return [[L.Term(n, tuple((w, d) for w, d in p)) for n, p in terms] for terms in json.loads(query)]


@functools.lru_cache(4096)
def _scored(query: str, met: str) -> float | None:
    places = {w["lexeme"]: w["at"] for w in json.loads(met)}
    return L.rank(_parsed(query), places) if L.holds(_parsed(query), places) else None


def _score(query, met):
    """Similarities; ``met`` comes as JSON, so that what was scored before is known again."""

    def score(queries: pa.Array, mets: pa.Array) -> pa.Array:
        return pa.array([None if x is None else float(x) for x in map(_scored, queries.to_pylist(), mets.to_pylist())], pa.float64())

    return F.arrow_udf(score, "double")(query, F.to_json(met))


def ranked_each(questions: DataFrame, index: DataFrame, k: int = K) -> DataFrame:
    """(question, id, similarity, rank): the k notes that match each query best.

    ``questions`` has id and query, ``index`` is what ``postings`` gives.  Words of queries meet the
    postings of the same lexeme alone, and for each pair of a question and a note that share one the
    places of the question's own words are gathered.  A note that holds no word of a query does not
    match it here, so a query of negated words alone finds only notes by the words that it negates.
    """
    read = questions.select(F.col("id").alias("question"), _read("query").alias("x")).select("question", "x.query", "x.words")
    words = read.select("question", F.explode("words").alias("lexeme"))
    met = words.join(index, "lexeme").groupBy("question", "id").agg(F.collect_list(F.struct("lexeme", "at")).alias("met"))
    scored = met.join(read.select("question", "query"), "question").withColumn("similarity", _score("query", "met")).filter("similarity IS NOT NULL AND NOT isnan(similarity)")
    order = Window.partitionBy("question").orderBy(F.desc("similarity"), "id")
    return scored.select("question", "id", "similarity").withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)
