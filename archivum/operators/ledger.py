"""Merging of duplicates with undo: an append-only ledger, from which any state is worked out anew.

An entry is (seq, kind, survivor, absorbed, target): ``merge`` unites ``absorbed`` with ``survivor``, ``undo`` takes the entry
with the number ``target`` back.  Entries are never rewritten.  A state is the base rows and the ledger up to a number.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from archivum.operators.durable import discard, materialize
from archivum.operators.review import number_rows

LEDGER = "seq long, kind string, survivor long, absorbed long, target long"


def active_merges(ledger: DataFrame, upto: int | None = None) -> DataFrame:
    """(seq, survivor, absorbed) of the merges that hold after the entry ``upto`` (all: null).

    An undo counts if the entry that it names came before it; an undo may itself be undone, which brings the merge back: an
    entry holds if no undo of it holds.  Chains of undos are followed from their end, one step a pass.  A merge whose
    absorbed row has been absorbed by an earlier one that holds has no effect.
    """
    rows = ledger if upto is None else ledger.where(F.col("seq") <= upto)
    rows = rows.dropDuplicates(["seq"])
    undo = rows.where("kind = 'undo' and target < seq").select("seq", "target")
    held = materialize(undo, "undos")
    gone: DataFrame | None = None  # undos that are known not to hold
    while True:
        # an undo holds for sure if nothing undoes it, or all that does is gone
        against = held.select(F.col("seq").alias("by"), F.col("target").alias("seq"))
        if gone is not None:
            against = against.join(gone.withColumnRenamed("seq", "by"), "by", "left_anti")
        open_ = held.join(gone, "seq", "left_anti") if gone is not None else held
        sure = open_.join(against, "seq", "left_anti")
        new = sure.select(F.col("target").alias("seq")).join(held.select("seq"), "seq", "left_semi").distinct()
        if gone is not None:
            new = new.join(gone, "seq", "left_anti")
        new = materialize(new, "undone-undos")
        if new.isEmpty():
            break
        gone = new if gone is None else materialize(gone.unionByName(new), "undone-undos")
    valid = held if gone is None else held.join(gone, "seq", "left_anti")
    merges = rows.where("kind = 'merge' and survivor != absorbed").join(valid.select(F.col("target").alias("seq")), "seq", "left_anti")
    first = merges.groupBy("absorbed").agg(F.min_by(F.struct("seq", "survivor"), "seq").alias("m"))
    return first.select("m.seq", "m.survivor", "absorbed")


def survivors(merges: DataFrame) -> DataFrame:
    """(id, survivor) of every absorbed row: the end of its chain of merges; the merge that would close a ring has no effect.

    Pointers are doubled, so the number of passes grows with the logarithm of the longest chain.
    """
    now = materialize(merges.select(F.col("absorbed").alias("id"), "survivor", F.col("seq").alias("latest")), "chains")
    width, last = 1, -1
    while True:
        after = now.alias("a").join(now.alias("b"), F.col("a.survivor") == F.col("b.id"), "left")
        after = materialize(after.select("a.id", F.coalesce("b.survivor", "a.survivor").alias("survivor"), F.greatest("a.latest", "b.latest").alias("latest")), "chains")
        discard(now)
        now, width = after, 2 * width
        turning = now.join(now.select(F.col("id").alias("survivor")), "survivor", "left_semi")
        open_ = turning.count()
        if not open_:
            return now.select("id", "survivor")
        if open_ == last and width > open_:
            break
        last = open_
    # what still points at absorbed rows leads into rings; rows pointed at after so many steps are the rings themselves
    ring = turning.join(turning.select(F.col("survivor").alias("id")).distinct(), "id", "left_semi")
    closing = materialize(ring.select(F.col("latest").alias("seq")).distinct(), "closing")
    return survivors(merges.join(closing, "seq", "left_anti"))


def state(base: DataFrame, ledger: DataFrame, id_: str, sets: list[str], notes: str | None = None, upto: int | None = None) -> DataFrame:
    """The rows that are left after the ledger, each with what its absorbed rows had.

    ``sets``: array columns, united without repeats and sorted; ``notes``: a text column, joined by line feeds in order of
    id, the survivor's first; ``absorbed``: the ids that it has taken in, sorted.  A row that is absorbed by a missing
    survivor stays as it is.
    """
    links = survivors(active_merges(ledger, upto))
    known = links.join(base.select(F.col(id_).alias("survivor")).distinct(), "survivor", "left_semi")
    rows = base.join(known.withColumnRenamed("id", id_), id_, "left").withColumn("_to", F.coalesce("survivor", id_))
    own = F.col(id_) == F.col("_to")
    united = [F.array_sort(F.array_distinct(F.flatten(F.collect_list(F.coalesce(c, F.array().cast(base.schema[c].dataType)))))).alias(c) for c in sets]
    joined = [F.array_join(F.transform(F.array_sort(F.collect_list(F.when(F.col(notes).isNotNull(), F.struct((~own).alias("later"), F.col(id_).alias("id"), F.col(notes).alias("note"))))), lambda x: x["note"]), "\n").alias(notes)] if notes else []
    taken = F.array_sort(F.collect_list(F.when(~own, F.col(id_)))).alias("absorbed")
    return rows.groupBy(F.col("_to").alias(id_)).agg(*united, *joined, taken)


def merge_plan(df: DataFrame, id_: str, keys: list[str | Column], keep: list[Column], start: int = 1) -> DataFrame:
    """Ledger entries that merge all rows of equal ``keys`` with the first by ``keep``; ``seq`` counts from ``start``.

    The survivor is found by a minimum that combines before the shuffle, so a group of any size is no task of its own.
    Rows with a null key stay.
    """
    named = df.select(F.col(id_).alias("id"), F.struct(*keep, F.col(id_).alias("_id")).alias("order"), *[(F.col(k) if isinstance(k, str) else k).alias(f"k{i}") for i, k in enumerate(keys)]).na.drop(subset=[f"k{i}" for i in range(len(keys))])
    by = [f"k{i}" for i in range(len(keys))]
    first = named.groupBy(*by).agg(F.min_by("id", "order").alias("survivor"), F.count("*").alias("n")).where("n > 1")
    pairs = named.join(first, by).where("id != survivor").select("survivor", F.col("id").alias("absorbed"))
    numbered = number_rows(pairs, ["survivor", "absorbed"], "seq")
    return numbered.select((F.col("seq") + (start - 1)).alias("seq"), F.lit("merge").alias("kind"), "survivor", "absorbed", F.lit(None).cast("long").alias("target"))
