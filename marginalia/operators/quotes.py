"""Which blocks of a document hold a quote, found by the rarest of the quote's grams.

Quotes and blocks meet on (document, gram), and of a quote's grams only the one that the fewest
blocks of its document hold is looked up; what comes of that is tested by containment.  So a quote
meets the blocks that hold it, and few others, however many blocks the document has.  Blocks know the
grams that the quotes of their document have, unless these are very many, and hand on no others.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from marginalia.functions.grams import winnowed

#: Characters of a gram and grams of which one is kept, for quotes of at least their sum less one;
#: the first that a quote is long enough for.
TIERS = ((8, 9), (4, 1), (1, 1))
#: Grams of a document's quotes that go to each of its blocks; of more, none go, and the blocks hand
#: on all that they have.
KNOWN = 4096


def grams(rows: DataFrame, text: str) -> DataFrame:
    """``rows`` without their text, tiers and known, once for each tier in tiers and gram that is kept;
    where known is not null, of the grams in it alone."""
    others = [c for c in rows.columns if c not in (text, "tiers", "known")]

    def run(batches):
        for b in batches:
            at, tiers, kept = [], [], []
            known = b.column("known")
            for n, (t, asked) in enumerate(zip(b.column(text).to_pylist(), b.column("tiers").to_pylist())):
                for tier in asked:
                    found = winnowed(t, *TIERS[tier])
                    if known[n].is_valid:
                        found = np.intersect1d(found, known[n].values.to_numpy(), assume_unique=True)
                    kept.append(found)
                    at.append(n)
                    tiers.append(tier)
            ends = np.cumsum([0, *map(len, kept)])
            found = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate([np.zeros(0, np.int64), *kept])))
            place = pa.array(at, pa.int64())
            yield pa.RecordBatch.from_arrays([*(b.column(c).take(place) for c in others), pa.array(tiers, pa.int32()), found], names=[*others, "tier", "grams"])

    schema = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in others)
    kept = rows.mapInArrow(run, f"{schema}, tier int, grams array<bigint>")
    return kept.select(*others, "tier", F.explode("grams").alias("gram"))


def holders(quotes: DataFrame, blocks: DataFrame) -> DataFrame:
    """(document_id, quote, id, ord) of the blocks whose text contains a quote.

    ``quotes`` has document_id and quote, which may repeat; ``blocks`` id, document_id, ord, text.
    Nulls and empty quotes are held by none.
    """
    n, tier = F.char_length("quote"), F.lit(len(TIERS) - 1)
    for i in range(len(TIERS) - 2, -1, -1):
        tier = F.when(n >= sum(TIERS[i]) - 1, i).otherwise(tier)
    wanted = quotes.filter("quote <> ''").select("document_id", "quote").distinct().withColumn("tier", tier)
    asked = grams(wanted.select("document_id", "quote", F.col("quote").alias("copy"), F.array("tier").alias("tiers"), F.lit(None).cast("array<bigint>").alias("known")), "copy")
    # a document's blocks are cut into the grams of the tiers that its quotes are of; those of its
    # quotes are gathered where there are few, which is counted before
    distinct = asked.select("document_id", "tier", "gram").distinct()
    few = distinct.withColumn("n", F.row_number().over(Window.partitionBy("document_id").orderBy("tier", "gram"))).filter(F.col("n") <= KNOWN + 1)
    own = few.groupBy("document_id").agg(F.collect_set("gram").alias("known"), F.max("n").alias("n")).select("document_id", F.when(F.col("n") <= KNOWN, F.col("known")).alias("known"))
    of = wanted.groupBy("document_id").agg(F.collect_set("tier").alias("tiers")).join(own, "document_id", "left")
    here = blocks.filter("text IS NOT NULL").select("document_id", "id", "text").join(of, "document_id")
    key = ["document_id", "tier", "gram"]
    held = grams(here, "text").join(distinct, key, "left_semi")
    counts = held.groupBy(*key).agg(F.count("*").alias("n"))
    # a quote with a gram that no block holds is held by none
    rarest = asked.join(counts, key, "left").groupBy("document_id", "quote", "tier").agg(F.min_by("gram", F.struct("n", "gram")).alias("gram"), F.count_if(F.col("n").isNull()).alias("unheard")).filter("unheard = 0").drop("unheard")
    may = rarest.join(held, key).select("document_id", "quote", "id")
    texts = blocks.select("id", F.col("document_id").alias("d"), "ord", "text")
    tested = may.join(texts, "id").filter((F.col("document_id") == F.col("d")) & F.contains("text", "quote"))
    return tested.select("document_id", "quote", "id", "ord")
