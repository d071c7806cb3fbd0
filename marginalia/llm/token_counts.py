"""Token counts by a transducer compiled from the tokenizer's merges.

Texts are cut into chunks of CHUNK bytes.  A chunk is summed up as a map from the state that the
transducer is in before it to the state after it and the tokens counted between: up to its first
reset (the beginning of a piece) the map depends on the state, from there on it is one number.  What
the bytes before the reset give from the first state is known beforehand; from another state the
transducer soon comes to the same states, so a map is applied by a few steps.  Such maps compose
associatively, so the counts of a text come from a parallel prefix scan over its chunks, of which
the total needs the sweep upwards alone.  What lies between resets and cuts runs side by side for a
block of texts at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from marginalia.llm.spans import kept
from marginalia.llm.transducer import BLOCK, STATES, Transducer, piece_starts

CHUNK = 1 << 14


@dataclass(frozen=True)
class ChunkMap:
    """``heads`` run on from the state before: runs of bytes, each with the tokens and the last state
    that it gives from the first state.  Then, if the chunk has a reset, ``emitted`` tokens follow
    and ``state`` is the last; otherwise the state after the heads is."""

    heads: tuple[tuple[bytes, int, int], ...] = ()
    emitted: int = 0
    state: int = 0
    reset: bool = False


def compose(a: ChunkMap, b: ChunkMap, machine: Transducer) -> ChunkMap:
    """First ``a``, then ``b``."""
    if not a.reset:
        return ChunkMap(a.heads + b.heads, b.emitted, b.state, b.reset)
    added, state = machine.through(b.heads, a.state)
    return ChunkMap(a.heads, a.emitted + added + b.emitted, b.state if b.reset else state, True)


def scan_total(maps: list[ChunkMap], machine: Transducer) -> ChunkMap:
    """The composition of all: neighbours are composed in log2(n) rounds whose steps are independent."""
    while len(maps) > 1:
        maps = [compose(*maps[i : i + 2], machine) if i + 1 < len(maps) else maps[i] for i in range(0, len(maps), 2)]
    return maps[0]


def prefix_scan(maps: list[ChunkMap], machine: Transducer) -> list[ChunkMap]:
    """Compositions of every prefix, by doubling: log2(n) rounds whose steps are independent."""
    out, step = list(maps), 1
    while step < len(out):
        out = [compose(out[i - step], m, machine) if i >= step else m for i, m in enumerate(out)]
        step *= 2
    return out


def chunk_maps(texts: list[str], machine: Transducer, chunk: int = CHUNK) -> list[list[ChunkMap]]:
    """The maps of the chunks of each text, at least one; texts hold no added tokens."""
    if len(machine.states) > STATES:
        machine.clear()
    raws, flags = [], []
    for t in texts:
        raw = t.encode()
        raws.append(raw)
        codes = np.frombuffer(t.encode("utf-32-le"), "<u4")
        start = piece_starts(t, codes, machine.classes(codes))
        if len(raw) != len(codes):
            width = 1 + (codes >= 0x80) + (codes >= 0x800) + (codes >= 0x10000)
            at = np.zeros(len(raw), bool)
            at[(np.cumsum(width) - width)[start]] = True
            start = at
        flags.append(start)
    data, reset = np.frombuffer(b"".join(raws), np.uint8), np.concatenate([*flags, np.zeros(0, bool)])
    sizes = np.asarray([len(r) for r in raws], np.int64)
    first = np.cumsum(sizes) - sizes
    cuts = np.concatenate([np.arange(f, f + max(n, 1), chunk) for f, n in zip(first.tolist(), sizes.tolist())])
    chunks_of = -(-np.maximum(sizes, 1) // chunk)
    # runs between resets and cuts; those that no reset begins are heads
    begin = reset.copy()
    begin[cuts[cuts < len(data)]] = True
    begins = np.flatnonzero(begin)
    lengths = np.diff(np.append(begins, len(data)))
    whole = reset[begins]
    tokens, states = machine.lanes(data, begins, lengths)
    edges = np.searchsorted(begins, np.append(cuts, len(data)))
    summed = np.concatenate([[0], np.cumsum(np.where(whole, tokens, 0))])
    maps = []
    for c, (i, j) in zip(cuts.tolist(), zip(edges.tolist(), edges[1:].tolist())):
        is_head = i < j and not whole[i]
        heads = ((data[c : c + int(lengths[i])].tobytes(), int(tokens[i]), int(states[i])),) if is_head else ()
        reset = j - i > is_head
        maps.append(ChunkMap(heads, int(summed[j] - summed[i]), int(states[j - 1]) if reset else 0, reset))
    ends = np.cumsum(chunks_of)
    return [maps[b - n : b] for b, n in zip(ends.tolist(), chunks_of.tolist())]


def counts(texts: list[str], machine: Transducer, chunk: int = CHUNK) -> list[int]:
    """Tokens of whole texts, as the tokenizers library gives them.

    A tokenizer that the transducer does not express is asked itself.
    """
    if not machine.able:
        return [len(machine.tokenizer.encode(t, add_special_tokens=False).ids) for t in texts]
    total, parts, owner = [0] * len(texts), [], []
    for i, t in enumerate(texts):
        # strings of added tokens are one token each, and part what surrounds them
        own = machine.added.split(t) if machine.added else [t]
        total[i] += len(own) - 1
        parts += own
        owner += [i] * len(own)
    at = 0
    while at < len(parts):
        size, end = 0, at
        while end < len(parts) and (end == at or size + len(parts[end]) <= BLOCK):
            size += len(parts[end])
            end += 1
        for i, maps in zip(owner[at:end], chunk_maps(parts[at:end], machine, chunk)):
            total[i] += scan_total(maps, machine).emitted
        at = end
    return total


def token_counts(docs: DataFrame, tokenizer: str, limit: int = 1024, text: str = "text", key: str = "doc_id") -> DataFrame:
    """Number of tokens of every whole text: key, n_bytes, n_tokens, over_limit.

    Map-only: no shuffle.  A null text counts as empty (0 bytes, 0 tokens), a null key stays null,
    repeated rows give repeated rows, an empty table gives none, other columns are not read.
    ``tokenizer`` is the path of a ``tokenizers`` file that all workers can open; strings of added
    tokens inside texts are handled as that library does by default.
    """
    kind = docs.schema[key].dataType.simpleString()

    def run(batches):
        machine = kept(Transducer, tokenizer)
        for b in batches:
            texts = [t or "" for t in b.column(1).to_pylist()]
            n = counts(texts, machine)
            yield pa.RecordBatch.from_arrays(
                [b.column(0), pa.array([len(t.encode()) for t in texts], pa.int64()), pa.array(n, pa.int64()), pa.array([x > limit for x in n], pa.bool_())],
                names=[key, "n_bytes", "n_tokens", "over_limit"],
            )

    return docs.select(F.col(key), F.col(text)).mapInArrow(run, f"`{key}` {kind}, n_bytes bigint, n_tokens bigint, over_limit boolean")
