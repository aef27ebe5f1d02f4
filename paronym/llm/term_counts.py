"""How often every distinct term occurs and in how many records.

A global dictionary gives each distinct term an integer.  Records are grouped
into blocks by a hash of their key; inside a block terms are summed before they
meet the dictionary, so a term that stands in a third of all records reaches it
at most once a block.  Encoded blocks are cut into identifier ranges and become
count arrays, which are summed range by range in one pass over sorted
partitions: one array is in memory at a time.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..session import cut_lineage


def global_dictionary(terms: DataFrame) -> DataFrame:
    """``(term, id)``: every distinct non-null ``term`` with an integer from 0, without gaps.

    Terms are spread by hash; a partition numbers its own and adds what the
    partitions before it hold.  Only the partitions' sizes meet in one place.
    """
    spark = terms.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    spread = terms.where("term is not null").select("term").distinct().withColumn("part", F.pmod(F.xxhash64("term"), F.lit(parts)))
    local = cut_lineage(spread.withColumn("at", F.row_number().over(Window.partitionBy("part").orderBy("term")) - 1))
    sizes = local.groupBy("part").agg(F.count("*").alias("n"))
    offsets = sizes.select("part", (F.sum("n").over(Window.orderBy("part")) - F.col("n")).alias("offset"))
    return local.join(F.broadcast(offsets), "part").select("term", (F.col("offset") + F.col("at")).alias("id"))


def _summed(width: int):
    """Sums the count arrays of each identifier range of a partition sorted by range."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        at, occurrences, records = None, np.zeros(width, np.int64), np.zeros(width, np.int64)

        def out() -> pd.DataFrame:
            ids = np.flatnonzero(records)
            return pd.DataFrame({"id": ids + at * width, "occurrences": occurrences[ids], "records": records[ids]})

        for batch in batches:
            for range_, slots, occ, rec in zip(batch["range"], batch["slots"], batch["occ"], batch["rec"]):
                if range_ != at:
                    if at is not None:
                        yield out()
                        occurrences[:], records[:] = 0, 0
                    at = range_
                slots = np.asarray(slots)
                occurrences[slots] += np.asarray(occ)
                records[slots] += np.asarray(rec)
        if at is not None:
            yield out()

    return run


def count_terms(rows: DataFrame, key: str, terms: str, blocks: int = 64, width: int = 65536) -> DataFrame:
    """``(term, occurrences, records)`` of every distinct term.

    ``rows`` has an array of terms; the rows of one ``key`` are one record, and
    a term counts once a record in ``records``.  Rows without a key, and null
    terms, are left out; an empty array adds nothing; repeated rows add to the
    occurrences.  Other columns of ``rows`` play no part.
    """
    held = rows.where(F.col(f"`{key}`").isNotNull()).select(F.col(f"`{key}`").alias("key"), F.explode(F.col(f"`{terms}`")).alias("term")).where("term is not null")
    per_record = held.groupBy("key", "term").agg(F.count("*").alias("n"))
    per_block = cut_lineage(per_record.groupBy(F.pmod(F.xxhash64("key"), F.lit(blocks)).alias("block"), "term").agg(F.sum("n").alias("occ"), F.count("*").alias("rec")))
    dictionary = cut_lineage(global_dictionary(per_block))
    encoded = per_block.join(dictionary, "term").select("block", (F.col("id") / width).cast("bigint").alias("range"), (F.col("id") % width).cast("int").alias("slot"), "occ", "rec")
    arrays = encoded.groupBy("range", "block").agg(F.collect_list(F.struct("slot", "occ", "rec")).alias("a")).select("range", F.col("a.slot").alias("slots"), F.col("a.occ").alias("occ"), F.col("a.rec").alias("rec"))
    sums = arrays.repartition("range").sortWithinPartitions("range").mapInPandas(_summed(width), "id bigint, occurrences bigint, records bigint")
    return sums.join(dictionary, "id").select("term", "occurrences", "records")


def band(records: str, total: int, common_share: float = 0.01):
    """``rara`` for a term of one record, ``comum`` for one in at least ``common_share`` of all, else null."""
    n = F.col(records)
    return F.when(n == 1, F.lit("rara")).when(n >= F.lit(common_share * total), F.lit("comum"))
