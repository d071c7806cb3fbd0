"""Byte-pair encoding with reuse of content-defined chunks, and decoding.

A rolling hash over the last characters cuts texts where their content says so, so that passages
shared by documents give the same chunks wherever they stand.  A worker encodes each distinct chunk
once.  A cut can fall inside a token, so every join is repaired: the last run of the left chunk and
the first of the right are encoded again together, and the stretch is widened by a run on each side
until its encoding agrees with those of the chunks at both ends.  Runs begin where the tokenizer
always cuts (see ``spans``), so what agrees there is exact.
"""

from __future__ import annotations

import hashlib
import json

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.spans import Encoder, kept, led_pieces

#: Characters the rolling hash looks back on, the bits that must be zero at a cut, characters held.
WINDOW, MASK, CACHE_CHARS = 8, np.uint32(0x3FF00000), 24_000_000
#: Runs that a chunk keeps apart at each end.
EDGE = 4
_FACTORS = [np.uint32(pow(0x9E3779B1, i, 1 << 32)) for i in range(1, WINDOW + 1)]


def cuts(text: str) -> list[int]:
    """Offsets at which chunks begin, the first 0; chunks average some 1,000 characters."""
    codes = np.frombuffer(text.encode("utf-32-le"), "<u4")
    if len(codes) <= WINDOW:
        return [0]
    rolled = np.zeros(len(codes) - WINDOW + 1, np.uint32)
    for i, f in enumerate(_FACTORS):
        rolled += codes[i : i + len(rolled)] * f
    return [0, *(np.flatnonzero((rolled & MASK) == 0) + WINDOW).tolist()]


class Chunks:
    """Encodings of distinct chunks: the first runs with their ids, the ids of the runs between,
    the last runs with theirs."""

    def __init__(self, path: str):
        self.encode, self.held, self.size, self.widened = kept(Encoder, path), {}, 0, 0

    def __getitem__(self, chunk: str) -> tuple[list, bytes, list]:
        found = self.held.get(chunk)
        if found is None:
            runs = [(r, self.encode.raw[r]) for r in led_pieces(chunk)]
            few = len(runs) <= 2 * EDGE
            found = (runs, b"", []) if few else (runs[:EDGE], b"".join(ids for _, ids in runs[EDGE:-EDGE]), runs[-EDGE:])
            self.size += 2 * len(chunk)
            if self.size > CACHE_CHARS:
                self.held.clear()
                self.size = 0
            self.held[chunk] = found
        return found

    def ids(self, text: str) -> bytes:
        """Ids of a whole text as little-endian unsigned 32-bit integers."""
        if self.encode.rule != "led":
            return self.encode(text)
        out: list[bytes] = []
        tail: list[tuple[str, bytes]] = []  # runs whose end a join may still change
        run: list[str] = []  # parts of a last run that goes on from chunk to chunk
        at = [*cuts(text), len(text)]
        for a, b in zip(at, at[1:]):
            if a == b:
                continue
            first, between, last = self[text[a:b]]
            if tail and len(first) == 1 and not last and not (first[0][0][0] == " " and not tail[-1][0][-1].isspace()):
                # the run goes on: it is encoded when its end has come
                run = run or [tail[-1][0]]
                run.append(first[0][0])
                tail = [*tail[:-1], (first[0][0], b"")]
                continue
            if run:
                tail, run = [*tail[:-1], self.whole(run)], []
            tail = self.joined(out, tail, first) if tail else first
            if last:
                out += [*(ids for _, ids in tail), between]
                tail = last
        if run:
            tail = [*tail[:-1], self.whole(run)]
        return b"".join([*out, *(ids for _, ids in tail)])

    def whole(self, parts: list[str]) -> tuple[str, bytes]:
        run = "".join(parts)
        return run, self.encode(run)

    def joined(self, out: list[bytes], tail: list, first: list) -> list:
        """Repair the join of two lists of runs.  What is settled is added to ``out``; the runs that
        the next join may change are returned."""
        if first[0][0][0] == " " and not tail[-1][0][-1].isspace():  # where the tokenizer always cuts
            out += [x for _, x in tail]
            return first
        for k in range(1, len(first) + 1):
            left, right = tail[-k:], first[:k]
            ids = self.encode("".join(r for r, _ in (*left, *right)))
            if k == 1:  # both encodings stand as they are
                agree = ids == left[0][1] + right[0][1]
            else:  # left of the first run, all is settled
                agree = (k > len(tail) or ids.startswith(left[0][1])) and ids.endswith(right[-1][1])
            if agree:
                out += [x for _, x in tail[:-k]]
                out.append(ids[: len(ids) - len(right[-1][1])])
                return first[k - 1 :]
            self.widened += 1
        whole = "".join(r for r, _ in (*tail, *first))  # no end agrees: one run to the next join
        return [(whole, self.encode(whole))]


class Decoder:
    """Bytes of each id, and texts of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        chars = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in set(plain))}
        vocab = spec["model"]["vocab"] | {t["content"]: t["id"] for t in spec.get("added_tokens") or []}
        self.table = [b""] * (max(vocab.values()) + 1)
        for token, i in vocab.items():
            self.table[i] = bytes(chars[c] for c in token) if all(c in chars for c in token) else token.encode()

    def __call__(self, ids: bytes) -> str:
        return b"".join(map(self.table.__getitem__, np.frombuffer(ids, "<u4").tolist())).decode("utf-8", "replace")


def bpe_round_trip(docs: DataFrame, tokenizer: str, text: str = "text", key: str = "doc_id", full: bool = False) -> DataFrame:
    """Encode every whole text and decode its ids again.

    Gives key, ids (binary) and decoded with ``full``; otherwise their digests n_tokens,
    ids_sha256 and decoded_sha256.  Map-only: no shuffle.  A null text counts as empty (no ids), a
    null key stays null, repeated rows give repeated rows, an empty table gives none, other columns
    are not read.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        chunks, decode = kept(Chunks, tokenizer), kept(Decoder, tokenizer)
        for b in batches:
            n, first, second = [], [], []
            for t in b.column(1).to_pylist():
                ids = chunks.ids(t or "")
                back = decode(ids)
                n.append(len(ids) // 4)
                first.append(ids if full else hashlib.sha256(ids).hexdigest())
                second.append(back if full else hashlib.sha256(back.encode()).hexdigest())
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array(n, pa.int64()), pa.array(first, pa.binary() if full else pa.string()), pa.array(second, pa.string())],
                names=[key, "n_tokens", *(("ids", "decoded") if full else ("ids_sha256", "decoded_sha256"))],
            )

    names = "ids binary, decoded string" if full else "ids_sha256 string, decoded_sha256 string"
    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, n_tokens bigint, {names}")
