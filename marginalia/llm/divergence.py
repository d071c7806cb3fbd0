"""How the vocabulary of each source departs from its language's and from that of other sources.

Two passes over whole texts.  The first counts in how many documents of a language each term occurs
and keeps the terms that are common enough.  The second compiles the kept terms, each between two
delimiters, into an Aho-Corasick automaton and counts their occurrences; a vocabulary too large for
one automaton is dealt out by language and hash, and each share is counted in a run of its own over
the documents of its languages.  What a task has counted are sparse postings, lists of terms and
counts for each group, so a frequent term or a large source arrives summed up.  Postings are then
dealt by term; a task holds some terms with all groups, sums up for each pair of groups what its
terms add, and keeps each group's best terms.  All figures are integers.
"""

from __future__ import annotations

from collections import Counter, defaultdict

import ahocorasick
import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from marginalia.llm.common import Scratch, partitions

#: Parts that a whole is divided into; documents that a kept term occurs in; ranks of the terms.
UNIT, LEAST_DOCS, RANKS = 1_000_000_000, 3, 200
#: Terms of one automaton, half as many more at most: what the driver holds of the vocabulary at
#: once and sends to all tasks (some 5 MB), and 32 bytes a node in each Python worker (some 80 MB).
TERMS = 1 << 19
#: Terms of one list of the vocabulary, whose place in it makes their number.
LIST, PLACES = 1 << 13, 1 << 20
#: Occurrences that a task gathers before it counts them, entries before it hands them on.
HELD = 1 << 21
#: Postings dealt to a task, sources compared at once with all others, cells of their matrix.
DEALT, TILE, CELLS = 1 << 22, 256, 1 << 20

#: Letters A-Z become small, all else of ASCII but letters becomes the delimiter.
FOLD = bytes(b if b >= 0x80 or 97 <= b <= 122 else b + 32 if 65 <= b <= 90 else 32 for b in range(256))


def folded(text: str | None) -> bytes:
    """The terms of a text between delimiters, in UTF-8."""
    return (text or "").encode().translate(FOLD)


def term_documents(docs: DataFrame) -> DataFrame:
    """lang, term, n: in how many documents of a task's share a term occurs."""

    def run(batches):
        held: dict[str, Counter] = defaultdict(Counter)

        def rows():
            while held:
                lang, c = held.popitem()
                terms = pa.array(list(c), pa.binary()).cast(pa.string())
                yield pa.RecordBatch.from_arrays([pa.repeat(pa.scalar(lang, pa.string()), len(c)), terms, pa.array(np.fromiter(c.values(), np.int64, len(c)))], names=["lang", "term", "n"])

        for b in batches:
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text").to_pylist()):
                held[lang].update(set(folded(text).split()))
            if sum(map(len, held.values())) > HELD:
                yield from rows()
        yield from rows()

    return docs.select("lang", "text").mapInArrow(run, "lang string, term string, n bigint")


_BUILT: dict = {}


class Vocabulary:
    """The automaton of a share of the vocabulary, and the number of each (language, term) of it.

    Bytes stand as characters, so that a text is searched without decoding."""

    def __init__(self, lists: list[tuple[str, int, bytes]]):
        self.automaton, self.size, pairs, ids = ahocorasick.Automaton(), 0, [], []
        self.langs = {lang: i for i, lang in enumerate(dict.fromkeys(lang for lang, _, _ in lists))}
        for lang, number, joined in lists:
            own = []
            for t in joined.decode("latin-1").split(" "):
                t = f" {t} "
                i = self.automaton.get(t, -1)  # another language may have it too
                if i < 0:
                    i = self.size
                    self.automaton.add_word(t, i)
                    self.size += 1
                own.append(i)
            pairs.append(np.asarray(own, np.int64) << 20 | self.langs[lang])
            ids.append(np.arange(len(own)) + number * PLACES)
        self.automaton.make_automaton()
        pairs, ids = np.concatenate(pairs), np.concatenate(ids)
        order = np.argsort(pairs)
        self.pairs, self.ids = pairs[order], ids[order]

    def numbers(self, lang: str, terms: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of these are kept in a language, and their numbers."""
        asked = terms << 20 | self.langs[lang]
        place = np.minimum(np.searchsorted(self.pairs, asked), len(self.pairs) - 1)
        kept = self.pairs[place] == asked
        return kept, self.ids[place[kept]]


def built(mark: str, lists: list) -> Vocabulary:
    """One vocabulary for each Python worker, whose tasks share it."""
    if mark not in _BUILT:
        _BUILT.clear()
        _BUILT[mark] = Vocabulary(lists)
    return _BUILT[mark]


def occurrences(docs: DataFrame, lists: list[tuple[str, int, bytes]], mark: str) -> DataFrame:
    """lang, source, tid, n: lists of the terms of one share that occur in a group, and how often."""
    langs = sorted({lang for lang, _, _ in lists})

    def run(batches):
        words = built(mark, lists)
        search, size = words.automaton.iter, words.size
        groups: dict[tuple[str, str], int] = {}
        keys, counts, new, held = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

        def settle():
            nonlocal keys, counts, new, held
            codes, both = pd.factorize(np.concatenate([keys, *new]))
            n = np.bincount(codes[: len(keys)], counts, len(both)) + np.bincount(codes[len(keys) :], minlength=len(both))
            keys, counts, new, held = both, n.astype(np.int64), [], 0

        def rows():
            nonlocal keys, counts
            order = np.argsort(keys)
            keys, counts = keys[order], counts[order]
            ends = np.searchsorted(keys, np.arange(len(groups) + 1) * size)
            found = []
            for (lang, source), i, j in zip(groups, ends, ends[1:]):
                kept, ids = words.numbers(lang, keys[i:j] % size)
                found.append((lang, source, ids, counts[i:j][kept]))
            keys, counts = keys[:0], counts[:0]
            groups.clear()
            columns = list(zip(*found))
            kinds = (pa.string(), pa.string(), pa.list_(pa.int64()), pa.list_(pa.int64()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=["lang", "source", "tid", "n"])

        for b in batches:
            for lang, source, text in zip(*(b.column(c).to_pylist() for c in ("lang", "source", "text"))):
                g = groups.setdefault((lang, source), len(groups))
                found = np.fromiter((v for _, v in search(f" {folded(text).decode('latin-1')} ")), np.int64)
                new.append(found + g * size)
                held += len(found)
                if held > HELD:
                    settle()
                    if len(keys) > HELD:
                        yield rows()
        settle()
        if groups:
            yield rows()

    # no more languages than the run has terms, which are sent to all tasks as well
    own = docs.join(F.broadcast(docs.sparkSession.createDataFrame([(x,) for x in langs], "lang string")), "lang", "left_semi")
    return own.select("lang", "source", "text").mapInArrow(run, "lang string, source string, tid array<bigint>, n array<bigint>")


def vocabulary(common: DataFrame, held: int) -> DataFrame:
    """Kept terms (lang, term) in sorted lists: run, lang, number, terms.

    Runs have at most 1.5 * ``held`` terms: a large language's stand in as few as they fit in, small
    languages stand together.
    """
    sizes = common.groupBy("lang").agg(F.count("*").alias("v"))
    w = Window.orderBy("lang").rowsBetween(Window.unboundedPreceding, -1)
    large = F.col("v") > held // 2
    own = F.when(large, F.ceil(F.col("v") / held)).otherwise(0).cast("bigint")
    small = F.when(large, 0).otherwise(F.col("v"))
    before = sizes.select("lang", "v", large.alias("large"), own.alias("own"), F.coalesce(F.sum(own).over(w), F.lit(0)).alias("runs"), F.coalesce(F.sum(small).over(w), F.lit(0)).alias("small"))
    # runs of large languages are even, those of small ones odd
    run = F.when(F.col("large"), 2 * (F.col("runs") + F.pmod(F.xxhash64("term"), F.col("own")))).otherwise(2 * F.floor(F.col("small") / held) + 1)
    dealt = common.join(before, "lang").select("lang", "term", run.cast("bigint").alias("run"), F.pmod(F.xxhash64("term", F.lit(1)), F.ceil(F.col("v") / LIST)).alias("list"))
    lists = dealt.groupBy("run", "lang", "list").agg(F.array_sort(F.collect_list("term")).alias("terms"))
    return lists.select("run", "lang", F.row_number().over(Window.orderBy("run", "lang", "list")).cast("bigint").alias("number"), "terms")


def share(counts: np.ndarray, whole: np.ndarray) -> np.ndarray:
    """1 + floor(UNIT * (count + 1) / whole), exact: a long division by thousands."""
    out, rest = np.ones_like(counts), counts + 1
    for scale in (UNIT // 1000, UNIT // 1_000_000, 1):
        digit, rest = np.divmod(rest * 1000, whole)
        out += digit * scale
    return out


def compared(dealt: DataFrame, groups: pd.DataFrame, ranks: int) -> DataFrame:
    """a, b, value, pair: what the terms of a task add to each pair of groups (a, b), and of each
    group a the best terms b, of equals at the end all.

    ``groups`` has first (of its language), n, v, n_lang, in order of their numbers; the result has
    more pairs of them than they are themselves, but for languages of one source.
    """
    first, n, v, n_lang = (groups[c].to_numpy(np.int64) for c in ("first", "n", "v", "n_lang"))
    last = np.searchsorted(first, np.arange(len(first)), "right") if len(first) else first

    def best(f: np.ndarray, t: np.ndarray):
        if len(f) <= ranks:
            return f, t
        kept = f >= np.partition(f, -ranks)[-ranks]
        return f[kept], t[kept]

    def run(batches):
        rows = [[b.column(c).to_numpy() for c in ("gid", "tid", "n")] for b in batches if b.num_rows]
        if not rows:
            return
        gid, tid, count = (np.concatenate(x) for x in zip(*rows))
        for lead in np.unique(first[gid]).tolist():
            own = first[gid] == lead
            s, (tids, t), c = gid[own] - lead, np.unique(tid[own], return_inverse=True), count[own]
            order = np.argsort(t, kind="stable")
            s, t, c = s[order], t[order], c[order]
            size = int(last[lead]) - lead
            whole, step = (n + v)[lead : lead + size, None], max(1, CELLS // size)
            top: list[tuple] = [(np.zeros(0, np.int64), np.zeros(0, np.int64))] * size
            for one in range(0, size, TILE):
                sums = np.zeros((min(TILE, size - one), size), np.int64)
                for at in range(0, len(tids), step):
                    i, j = np.searchsorted(t, [at, at + step])
                    held = np.zeros((size, min(step, len(tids) - at)), np.int64)
                    np.add.at(held, (s[i:j], t[i:j] - at), c[i:j])
                    p = share(held, whole)
                    for k in range(len(sums)):
                        d = p[one + k] - p
                        sums[k] += (d * d // p).sum(axis=1)
                    if not one:
                        q = share(held.sum(axis=0), n_lang[lead] + v[lead])
                        for g in range(size):
                            used = np.flatnonzero((held[g] > 0) & (p[g] > q))
                            d = p[g, used] - q[used]
                            f, b = top[g]
                            top[g] = best(np.concatenate([f, d * d // q[used]]), np.concatenate([b, tids[at + used]]))
                a, b = np.divmod(np.arange(sums.size), size)
                yield pa.RecordBatch.from_arrays([pa.array(a + one + lead), pa.array(b + lead), pa.array(sums.ravel()), pa.repeat(True, sums.size)], names=["a", "b", "value", "pair"])
            f, b = (np.concatenate(x) for x in zip(*top))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(size) + lead, [len(x) for x, _ in top])), pa.array(b), pa.array(f), pa.repeat(False, len(f))], names=["a", "b", "value", "pair"])

    return dealt.mapInArrow(run, "a bigint, b bigint, value bigint, pair boolean")


def divergence(docs: DataFrame, least: int = LEAST_DOCS, ranks: int = RANKS, terms_held: int = TERMS) -> DataFrame:
    """lang, source, part, item, value, rank for every (lang, source) that occurs.

    Part ``pair``: each other source of the language, with the sum over all kept terms.  Part
    ``term``: the kept terms that the group uses more than its language, to ``ranks`` ranks.  Null
    text, lang and source count as empty strings; a document without terms still makes its group
    occur; equal rows are separate documents; ties in value go by the item's UTF-8 bytes; a language
    without kept terms has pairs of value 0; an empty table gives no rows; other columns, whatever
    their names, are not read.
    """
    spark = docs.sparkSession
    scratch = Scratch(spark)
    docs = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    common = scratch.keep(term_documents(docs).groupBy("lang", "term").agg(F.sum("n").alias("n")).filter(F.col("n") >= least).select("lang", "term"), "common")
    lists = scratch.keep(vocabulary(common, terms_held), "terms")
    kept = lists.select(F.posexplode("terms").alias("place", "item"), "number").select((F.col("number") * PLACES + F.col("place")).alias("tid"), "item")
    counts = spark.createDataFrame([], "lang string, source string, tid array<bigint>, n array<bigint>")
    # as many as the vocabulary fills; the driver holds one share of it at a time
    for run in sorted(r["run"] for r in lists.select("run").distinct().collect()):
        share_of = lists.filter(F.col("run") == run).select("lang", "number", F.array_join("terms", " ").alias("terms")).collect()
        counted = occurrences(docs, [(r["lang"], r["number"], r["terms"].encode()) for r in share_of], f"{scratch.paths[1]}:{run}")
        counts = counts.union(scratch.keep(counted, "counts"))

    sizes = lists.groupBy("lang").agg(F.sum(F.size("terms")).alias("v"))
    total = F.aggregate("n", F.lit(0).cast("bigint"), lambda x, y: x + y)
    totals = counts.groupBy("lang", "source").agg(F.sum(total).alias("n"), F.sum(F.size("tid")).alias("entries"))
    groups = docs.select("lang", "source").distinct().join(totals, ["lang", "source"], "left").join(sizes, "lang", "left").fillna(0, ["n", "v", "entries"])
    gid = F.row_number().over(Window.orderBy("lang", "source")).cast("bigint") - 1
    by_lang = Window.partitionBy("lang")
    groups = scratch.keep(groups.withColumn("gid", gid).withColumn("first", F.min("gid").over(by_lang)).withColumn("n_lang", F.sum("n").over(by_lang)), "groups")
    known = groups.sort("gid").select("first", "n", "v", "n_lang", "entries").toPandas()
    tasks = max(partitions(spark), -(-int(known["entries"].sum()) // DEALT))
    named = counts.join(groups.select("lang", "source", "gid"), ["lang", "source"])
    dealt = named.select("gid", F.explode(F.arrays_zip("tid", "n")).alias("x")).select("gid", "x.tid", "x.n").repartition(tasks, "tid")
    found = scratch.keep(compared(dealt, known, ranks), "found")

    own = groups.select("lang", "source", F.col("gid").alias("a"))
    other = groups.select("lang", F.col("source").alias("item"), F.col("gid").alias("b"))
    sums = found.filter("pair").groupBy("a", "b").agg(F.sum("value").alias("value"))
    pairs = own.join(other, "lang").filter("a <> b").join(sums, ["a", "b"], "left").select("lang", "source", F.lit("pair").alias("part"), "item", F.coalesce("value", F.lit(0)).cast("bigint").alias("value"))
    terms = found.filter("NOT pair").join(kept, F.col("b") == F.col("tid")).join(own, "a").select("lang", "source", F.lit("term").alias("part"), "item", "value")
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    return pairs.withColumn("rank", F.row_number().over(order)).union(terms.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= ranks))
