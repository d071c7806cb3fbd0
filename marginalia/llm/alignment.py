"""Alignment of two tokenizers' tokens over the same bytes, by a dictionary of groups.

Both tokenizers read a space and the text.  Where a token of each ends at the same byte, the text is
cut; a group is what lies between two cuts, the A-ids and the B-ids of the same bytes.  Which of its
tokens overlap follows from the group alone, so links are expanded once for each distinct group.

A worker encodes each distinct piece (see ``spans``) once, as both tokenizers always end a token
before a space that follows other characters, and interns its groups.  Documents are taken in blocks
with a dictionary each; a document holds numbers of groups and how often each occurs, and for each
id pair linked in the block the block counts the documents that hold it.  Counts are summed over the corpus,
each distinct group of the corpus is scored once, and scores return to the blocks by the group.
"""

from __future__ import annotations

import hashlib
import os
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.bpe import Decoder
from marginalia.llm.common import Scratch
from marginalia.llm.spans import cut_rule, kept, led_pieces, load

#: Documents and entries of documents at which a block ends, groups that a worker interns at most
#: before it ends one, characters of texts whose pieces are encoded together.
DOCS, ENTRIES, GROUPS, TOGETHER = 4096, 1 << 21, 1 << 18, 1 << 18
#: Pieces that a worker holds, those that are cut at once, and those that A reads as one text.
PIECES, BATCH, JOINED = 400_000, 1 << 14, 64
#: The mark that stands for a space in pieces.
MARK = "▁"


class Aligner:
    """Groups of pieces, interned: each has a number, a text 'a1,a2|b1', and its links."""

    def __init__(self, a: str, b: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        self.a, self.bytes_a = load(a), Decoder(a).table
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=b)
        self.bytes_b = [self.piece_bytes(i) for i in range(self.b.get_piece_size())]
        self.size_a, self.size_b = (np.asarray([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.space = [self.b.piece_to_id(MARK)]
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        # no token of B runs from another character into a space, and a space is put before texts
        self.parted = cut_rule(a) == "led" and not any(MARK in p.lstrip(MARK) for p in pieces) and self.b.encode("a ") != self.b.encode("a")
        self.place: dict[str, int] = {}
        self.forget()

    def forget(self) -> None:
        """Drop all that is interned; numbers begin anew."""
        self.numbers: dict[str, int] = {}
        self.known: dict[tuple, int] = {}  # groups of several ids, A's and B's parted by -1
        self.texts: list[str] = []
        self.pairs: dict[int, int] = {}
        # of group i: tokens of A and of B, and pairs flat[first[i]:first[i + 1]]
        self.n_a, self.n_b, self.first, self.flat = (np.zeros(1 << 12, np.int64) for _ in range(4))
        self.drop_pieces()

    def drop_pieces(self) -> None:
        # groups of piece i: groups[begins[i]:begins[i + 1]]; a piece whose bytes differ is -1
        self.place.clear()
        self.used, self.begins, self.groups = 0, np.zeros(1 << 12, np.int64), np.zeros(1 << 12, np.int64)

    def piece_bytes(self, i: int) -> bytes:
        piece = self.b.id_to_piece(i)
        return bytes([int(piece[3:5], 16)]) if self.b.is_byte(i) else piece.replace(MARK, " ").encode()

    def cut(self, pieces: list[str], joined: int = 1) -> tuple[np.ndarray, np.ndarray] | None:
        """Numbers of the groups of pieces that begin with a space, and how many each piece has; None
        if what a tokenizer gives are not the bytes of some piece.  Calls cost more than pieces, so
        many are cut at once, and of those that do not end in white space A reads ``joined`` as one."""
        texts = pieces if joined == 1 else ["".join(pieces[i : i + joined]) for i in range(0, len(pieces), joined)]
        list_a = list(chain.from_iterable(e.ids for e in self.a.encode_batch_fast(texts, add_special_tokens=False)))
        # the library puts no space before nothing
        list_b = list(chain.from_iterable(ids or self.space for ids in self.b.encode([p[1:] for p in pieces], num_threads=1)))
        raw = [p.encode() for p in pieces]
        bounds, raw = np.cumsum(list(map(len, raw))), b"".join(raw)
        if any(b"".join(map(of.__getitem__, ids)) != raw for of, ids in ((self.bytes_a, list_a), (self.bytes_b, list_b))):
            return None
        flat_a, flat_b = np.asarray(list_a, np.int64), np.asarray(list_b, np.int64)
        ends_a, ends_b = np.cumsum(self.size_a[flat_a]), np.cumsum(self.size_b[flat_b])
        upto = np.searchsorted(ends_a, bounds)
        if (ends_a[upto] != bounds).any() or (ends_b[np.searchsorted(ends_b, bounds)] != bounds).any():
            return None
        # a group ends where a token of each ends
        place = np.searchsorted(ends_b, ends_a)
        last_a = np.flatnonzero(ends_b[place] == ends_a)
        last_b = place[last_a]
        n_a, n_b = np.diff(last_a, prepend=-1), np.diff(last_b, prepend=-1)
        numbers = np.empty(len(last_a), np.int64)
        one = (n_a == 1) & (n_b == 1)
        pairs, at = np.unique(flat_a[last_a[one]] << 32 | flat_b[last_b[one]], return_inverse=True)
        numbers[one] = np.asarray([self.number((p >> 32,), (p & 0xFFFFFFFF,)) for p in pairs.tolist()], np.int64)[at]
        some, known = [], self.known
        for x, y, n, m in zip(*(v[~one].tolist() for v in (last_a + 1, last_b + 1, n_a, n_b))):
            key = (*list_a[x - n : x], -1, *list_b[y - m : y])
            if (number := known.get(key)) is None:
                number = known[key] = self.number(key[:n], key[n + 1 :])
            some.append(number)
        numbers[~one] = some
        return numbers, np.diff(np.searchsorted(last_a, upto, "right"), prepend=0)

    def learn(self, pieces: list[str], joined: int = JOINED) -> None:
        """Keep the groups of pieces."""
        if joined > 1 and (apart := [p for p in pieces if p[-1].isspace()]):
            self.learn(apart, 1)
            pieces = [p for p in pieces if not p[-1].isspace()]
        found = self.cut(pieces, joined) if pieces else None
        if found is None:
            if len(pieces) == 1:
                self.place[pieces[0]] = -1
            elif pieces:
                half = len(pieces) // 2
                self.learn(pieces[:half], joined)
                self.learn(pieces[half:], joined)
            return
        numbers, sizes = found
        first, n = self.used, len(pieces)
        while first + n + 1 > len(self.begins):
            self.begins = np.concatenate([self.begins, np.zeros_like(self.begins)])
        ends = self.begins[first] + np.cumsum(sizes)
        while ends[-1] > len(self.groups):
            self.groups = np.concatenate([self.groups, np.zeros_like(self.groups)])
        self.groups[self.begins[first] : ends[-1]] = numbers
        self.begins[first + 1 : first + n + 1] = ends
        self.place.update(zip(pieces, range(first, first + n)))
        self.used += n

    def number(self, a, b) -> int:
        group = f"{','.join(map(str, a))}|{','.join(map(str, b))}"
        n = self.numbers.get(group)
        if n is None:
            n = self.numbers[group] = len(self.numbers)
            self.texts.append(group)
            linked = [self.pairs.setdefault(p, len(self.pairs)) for p in np.unique(self.overlaps(group)).tolist()]
            if n + 2 > len(self.first):
                self.n_a, self.n_b, self.first = (np.concatenate([x, np.zeros_like(x)]) for x in (self.n_a, self.n_b, self.first))
            end = self.first[n] + len(linked)
            while end > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
            self.n_a[n], self.n_b[n], self.first[n + 1], self.flat[self.first[n] : end] = len(a), len(b), end, linked
        return n

    def overlaps(self, group: str) -> np.ndarray:
        """a << 32 | b of every two tokens of a group whose bytes overlap."""
        a, b = (np.asarray(x.split(","), np.int64) for x in group.split("|"))
        if len(a) == len(b) == 1:
            return a << 32 | b
        ends_a, ends_b = np.cumsum(self.size_a[a]), np.cumsum(self.size_b[b])
        # between two ends next to each other lies one token of each
        ends = np.union1d(ends_a, ends_b)
        return a[np.searchsorted(ends_a, ends)] << 32 | b[np.searchsorted(ends_b, ends)]

    def __call__(self, texts: list[str]) -> list[np.ndarray | None]:
        """Numbers of the groups of each text in order; None for texts that have no tokens."""
        if self.used > PIECES:
            self.drop_pieces()
        split = [(led_pieces(" " + t) if self.parted else [" " + t]) if t else [] for t in texts]
        every = list(chain.from_iterable(split))
        at = list(map(self.place.get, every))
        if None in at:
            new = list({p for p, i in zip(every, at) if i is None})
            for i in range(0, len(new), BATCH):
                self.learn(new[i : i + BATCH])
            at = list(map(self.place.__getitem__, every))
            for p in new:
                if len(p) > 256:  # not to be held
                    del self.place[p]
        at = np.asarray(at, np.int64)
        first = self.begins[at]
        size = np.where(at < 0, 0, self.begins[at + 1] - first)
        groups = self.groups[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())]
        upto = np.concatenate([[0], np.cumsum(size)])
        out, end = [], 0
        for text, own in zip(texts, split):
            begin, end = end, end + len(own)
            found = groups[upto[begin] : upto[end]] if own else None
            if own and (at[begin:end] < 0).any():  # bytes that differ in a piece may agree in the text
                found = self.cut([" " + text])
                found = found and found[0]
            out.append(found)
        return out

    def pairs_of(self, groups: np.ndarray) -> np.ndarray:
        """Numbers of the pairs that are linked in some of these groups."""
        first = self.first[groups]
        size = self.first[groups + 1] - first
        return np.unique(self.flat[np.repeat(first - np.cumsum(size) + size, size) + np.arange(size.sum())])


class Block:
    """Documents with the dictionary of their groups."""

    def __init__(self, aligner: Aligner):
        self.aligner, self.entries, self.rows, self.seen = aligner, 0, [], []

    def add(self, key, groups: np.ndarray | None) -> None:
        if groups is None:
            self.rows.append((key, 0, 0, 0, 0, "", [], []))
            return
        own, often = np.unique(groups, return_counts=True)
        n_a, n_b = int(self.aligner.n_a[own] @ often), int(self.aligner.n_b[own] @ often)
        digest = hashlib.sha256(";".join(map(self.aligner.texts.__getitem__, groups.tolist())).encode()).hexdigest()
        self.entries += len(own)
        # of two sequences of tokens that end together at g places, overlaps number a + b - g
        self.rows.append((key, n_a, n_b, len(groups), n_a + n_b - len(groups), digest, own, often))
        self.seen.append(self.aligner.pairs_of(own))

    def full(self) -> bool:
        return len(self.rows) >= DOCS or self.entries >= ENTRIES

    def batch(self, block: str, kind: pa.DataType) -> pa.RecordBatch:
        """One row for each document, and a first one with the dictionary of what they hold."""
        nothing = np.zeros(0, np.int64)
        keys, n_a, n_b, n_groups, n_links, digests, own, often = zip(*self.rows)
        met = np.unique(np.concatenate([nothing, *own]).astype(np.int64))
        pairs, held = np.unique(np.concatenate([nothing, *self.seen]), return_counts=True)
        names, coded = np.asarray([*self.aligner.texts, ""], object), np.fromiter(self.aligner.pairs, np.int64, len(self.aligner.pairs))
        lists = lambda x, t: pa.array([[], *x], pa.list_(t))
        first = lambda x, t: pa.array([x, *[None] * len(self.rows)], pa.list_(t))
        longs = lambda x: pa.array([None, *x], pa.int64())
        return pa.RecordBatch.from_arrays(
            [
                pa.array([block] * (len(keys) + 1)), pa.array([True, *[False] * len(keys)]), pa.array([None, *keys], kind), longs(n_a), longs(n_b), longs(n_groups), longs(n_links),
                pa.array([None, *digests], pa.string()), lists([np.searchsorted(met, x).astype(np.int32) for x in own], pa.int32()), lists(often, pa.int64()), first(names[met].tolist(), pa.string()), first(coded[pairs], pa.int64()), first(held, pa.int64()),
            ],
            names=COLUMNS,
        )


def _aligner(paths: tuple[str, str]) -> Aligner:
    return Aligner(*paths)


COLUMNS = ["block", "head", "key", "n_a", "n_b", "n_groups", "n_links", "digest", "own", "often", "dictionary", "pairs", "held"]


def blocks(docs: DataFrame, a: str, b: str, text: str, key: str) -> DataFrame:
    """Documents and dictionaries of blocks; map-only."""
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        from pyspark import TaskContext

        task, n = TaskContext.get().partitionId(), 0
        aligner = kept(_aligner, (a, b))
        block = Block(aligner)
        for batch in batches:
            of = batch.schema.field(0).type
            keys, texts = batch.column(0).to_pylist(), [t or "" for t in batch.column(1).to_pylist()]
            at = 0
            while at < len(texts):
                size, end = 0, at
                while end < len(texts) and size < TOGETHER:
                    size += len(texts[end])
                    end += 1
                for k, pieces in zip(keys[at:end], aligner(texts[at:end])):
                    block.add(k, pieces)
                at = end
                if block.full() or len(aligner.texts) >= GROUPS:
                    yield block.batch(f"{task}-{n}", of)
                    if len(aligner.texts) >= GROUPS:
                        aligner.forget()
                    block, n = Block(aligner), n + 1
        if block.rows:
            yield block.batch(f"{task}-{n}", of)

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"block string, head boolean, key {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, digest string, own array<int>, often array<bigint>, dictionary array<string>, pairs array<bigint>, held array<bigint>")


def group_links(groups: DataFrame, a: str, b: str) -> DataFrame:
    """(grp, pair) for every link of each distinct group."""

    def run(batches):
        aligner = kept(_aligner, (a, b))
        for batch in batches:
            names = batch.column(0).to_pylist()
            found = [aligner.overlaps(g) for g in names]
            grp = pa.array(names, pa.string()).take(pa.array(np.repeat(np.arange(len(names)), [len(x) for x in found])))
            yield pa.RecordBatch.from_arrays([grp, pa.array(np.concatenate([np.zeros(0, np.int64), *found]))], names=["grp", "pair"])

    return groups.select("grp").mapInArrow(run, "grp string, pair bigint")


def _scored(key, docs: pa.Table, scores: pa.Table) -> pa.Table:
    order = np.argsort(scores.column("number").to_numpy())
    best, total = (scores.column(c).to_numpy()[order] for c in ("best", "total"))
    n_best, count_sum = [], []
    for own, often in zip(docs.column("own"), docs.column("often")):
        i, n = own.values.to_numpy(), often.values.to_numpy()
        n_best.append(int(best[i] @ n) if len(i) else 0)
        count_sum.append(int(total[i] @ n) if len(i) else 0)
    out = docs.select(["key", "n_a", "n_b", "n_groups", "n_links"])
    return out.append_column("n_best", pa.array(n_best, pa.int64())).append_column("count_sum", pa.array(count_sum, pa.int64())).append_column("groups_sha256", docs.column("digest"))


def alignment(docs: DataFrame, a: str, b: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_a, n_b, n_groups, n_links, n_best, count_sum and groups_sha256 of every whole text.

    ``a`` is the path of a byte-level ``tokenizers`` file, ``b`` that of a ``sentencepiece`` model
    which puts a space before texts.  A text that is null, empty, or whose tokens' bytes differ from
    space and text has zeros and an empty digest.  Of an A-id's pairs, all with its highest count are
    best.  Equal rows count as separate documents, a null key stays null, an empty table gives no
    rows, other columns, whatever their names, are not read.
    """
    kind = docs.schema[key].dataType.simpleString()
    scratch = Scratch(docs.sparkSession)
    held = scratch.keep(blocks(docs, a, b, text, key), "blocks")
    heads = held.filter("head")
    counts = heads.select(F.explode(F.arrays_zip("pairs", "held")).alias("x")).groupBy(F.col("x.pairs").alias("pair")).agg(F.sum("x.held").alias("n"))
    counts = scratch.keep(counts, "pairs")
    top = counts.groupBy(F.shiftright("pair", 32).alias("a")).agg(F.max("n").alias("top"))
    counts = counts.join(top, F.shiftright("pair", 32) == F.col("a")).select("pair", "n", (F.col("n") == F.col("top")).cast("bigint").alias("is_best"))
    numbered = heads.select("block", F.posexplode("dictionary").alias("number", "grp"))
    links = group_links(numbered.select("grp").distinct(), a, b)
    scores = links.join(counts, "pair").groupBy("grp").agg(F.sum("is_best").alias("best"), F.sum("n").alias("total"))
    back = numbered.join(scores, "grp").select("block", "number", "best", "total").toDF("block", "number", "best", "total")
    rows = held.filter("not head").select("block", "key", "n_a", "n_b", "n_groups", "n_links", "digest", "own", "often")
    done = rows.groupBy("block").cogroup(back.groupBy("block")).applyInArrow(_scored, f"key {kind}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, n_best bigint, count_sum bigint, groups_sha256 string")
    return done.withColumnRenamed("key", key)
