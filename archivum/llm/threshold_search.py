"""Ranked lexical search by Fagin's threshold algorithm over impact-sorted lists and a forward index.

One pass over the texts writes the forward index: of each document its length and the items' terms with their
frequencies.  Document frequencies and lengths are summed from it, over all documents.  Documents are then searched in
shards, as many at a time as a table of impacts (a row for each document, a column for each term) may hold.  A shard's lists
are its documents by falling impact, one list for each term.  An item reads its lists in turn, a block of rounds at a time;
each document that it meets for the first time is scored by looking up all its impacts.  The sum of the impacts where the
lists stand bounds the score of all documents not met; once it is strictly below the k-th score (so that no tie is lost),
the item is done with the shard.  The k best so far go with the task from shard to shard, so later shards stop sooner; the
tasks' best are merged by a window with a limit for each item.

Items are taken in blocks of a bounded number of terms; each block reads the texts once.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from archivum.llm.common import discard, materialize

#: Results of an item.
TOP = 50
#: Terms of the items of a block (with repeats over items): what a task is sent.
BLOCK_TERMS = 65_536
#: Cells of a shard's table of impacts, four bytes each, and the rounds of the first block; each further block has twice as many.
CELLS, ROUNDS = 16_000_000, 16
#: Words that are counted together.
WORDS = 500_000
#: Bytes other than letters, digits and those of further alphabets part terms; A-Z become lower case.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if b >= 128 or 97 <= b <= 122 or 48 <= b <= 57 else 32 for b in range(256))
_LAST = 2**63 - 1


def terms(text: bytes) -> list[bytes]:
    """The terms of a UTF-8 text, in order."""
    return text.translate(_TERMS).split()


def forward_index(docs: DataFrame, vocabulary: list[bytes]) -> DataFrame:
    """doc_id, n (terms of the text, with repeats), and of those in ``vocabulary``: numbers ``term`` and frequencies ``tf``."""
    number = {t: i for i, t in enumerate(vocabulary)}

    def index(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def counted(ids: list, texts: list[list[bytes]]) -> pa.RecordBatch:
            n = np.array([len(t) for t in texts], np.int64)
            every = np.fromiter((number.get(w, -1) for t in texts for w in t), np.int64, int(n.sum()))
            row = np.repeat(np.arange(len(n)), n)[every >= 0]
            key, tf = np.unique(row * len(vocabulary) + every[every >= 0], return_counts=True)
            bounds = pa.array(np.searchsorted(key, np.arange(len(n) + 1) * len(vocabulary)), pa.int32())
            lists = [pa.ListArray.from_arrays(bounds, pa.array(x.astype(np.int32))) for x in (key % max(1, len(vocabulary)), tf)]
            return pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n), *lists], ["doc_id", "n", "term", "tf"])

        for batch in batches:
            ids, texts, size = [], [], 0
            for doc, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").cast(pa.binary()), strict=True):
                ids.append(doc)
                texts.append(terms(text.as_py() or b""))
                size += len(texts[-1])
                if size > WORDS:
                    yield counted(ids, texts)
                    ids, texts, size = [], [], 0
            if ids:
                yield counted(ids, texts)

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(index, "doc_id long, n long, term array<int>, tf array<int>")


class Shard:
    """A table of impacts over some documents, with its impact-sorted lists."""

    def __init__(self, docs: np.ndarray, bounds: np.ndarray, term: np.ndarray, impact: np.ndarray, width: int):
        self.docs = docs
        row = np.repeat(np.arange(len(docs)), np.diff(bounds))
        self.table = np.zeros((len(docs), width), np.int32)
        self.table[row, term] = impact
        by = np.lexsort((-impact, term))
        self.list = row[by]
        self.begin = np.searchsorted(term[by], np.arange(width + 1))

    def search(self, term: np.ndarray, weight: np.ndarray, best: tuple[np.ndarray, np.ndarray], top: int) -> tuple[np.ndarray, np.ndarray]:
        """``best`` (scores, doc_ids; falling, ties by id) with this shard's documents in it, by the threshold algorithm."""
        begin, size = self.begin[term], self.begin[term + 1] - self.begin[term]
        met = np.zeros(len(self.docs), bool)
        depth, rounds = 0, ROUNDS
        longest = int(size.max(initial=0))
        while depth < longest:
            stop = depth + rounds
            new = np.concatenate([self.list[b + depth : b + min(s, stop)] for b, s in zip(begin.tolist(), size.tolist(), strict=True)])
            new = np.unique(new[~met[new]])
            met[new] = True
            scores = self.table[np.ix_(new, term)].astype(np.int64) @ weight
            if len(best[0]) == top:
                good = scores >= best[0][-1]
                new, scores = new[good], scores[good]
            if len(new):
                scores, ids = np.r_[best[0], scores], np.r_[best[1], self.docs[new]]
                by = np.lexsort((ids, -scores))[:top]
                best = scores[by], ids[by]
            # the impact at which each list stands; a list that has ended has none
            stands = np.flatnonzero(size > stop)
            last = self.list[begin[stands] + stop - 1]
            threshold = int(self.table[last, term[stands]].astype(np.int64) @ weight[stands])
            if len(best[0]) == top and threshold < best[0][-1]:
                break
            depth, rounds = stop, 2 * rounds
        return best


def _search(index: DataFrame, items: list[np.ndarray], weights: np.ndarray, n_docs: int, n_terms: int, top: int) -> DataFrame:
    """item, doc_id, score: each task's best of each item."""
    width = len(weights)
    least = max(1, CELLS // max(1, width))

    def shards(batches: Iterator[pa.RecordBatch]) -> Iterator[Shard]:
        held: list[pa.RecordBatch] = []
        for batch in batches:
            at = 0
            while at < batch.num_rows:
                part = batch.slice(at, least - sum(b.num_rows for b in held))
                held.append(part)
                at += part.num_rows
                if sum(b.num_rows for b in held) >= least:
                    yield build(held)
                    held = []
        if held:
            yield build(held)

    def build(held: list[pa.RecordBatch]) -> Shard:
        table = pa.Table.from_batches(held).combine_chunks()
        docs = table.column("doc_id").combine_chunks().fill_null(_LAST).to_numpy(zero_copy_only=False)
        n = table.column("n").to_numpy()
        term_lists, tf_lists = table.column("term").combine_chunks(), table.column("tf").combine_chunks()
        size = term_lists.value_lengths().to_numpy(zero_copy_only=False)
        term, tf = term_lists.flatten().to_numpy(), tf_lists.flatten().to_numpy().astype(np.int64)
        m = 50 + 50 * n * n_docs // n_terms
        return Shard(docs, np.r_[0, np.cumsum(size)], term, 1_000_000_000 * tf // (1000 * tf + 20 * np.repeat(m, size)), width)

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nothing = np.zeros(0, np.int64)
        best = [(nothing, nothing)] * len(items)
        for shard in shards(batches):
            for i, term in enumerate(items):
                best[i] = shard.search(term, weights[term], best[i], top)
        for i, (scores, ids) in enumerate(best):
            scores, ids = scores[scores > 0], ids[scores > 0]
            if len(ids):
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(ids), i, np.int32)), pa.array(ids, mask=ids == _LAST), pa.array(scores)], ["item", "doc_id", "score"])

    return index.mapInArrow(search, "item int, doc_id long, score long")


def _blocks(items: DataFrame) -> Iterator[list[tuple[object, list[bytes]]]]:
    """The items with their different terms, in blocks of at most BLOCK_TERMS terms (an item with more is one block)."""
    block, size = [], 0
    for row in items.select("item_id", F.col("text").cast("binary").alias("text")).toLocalIterator():
        own = list(dict.fromkeys(terms(bytes(row["text"] or b""))))
        if not own:
            continue
        if block and size + len(own) > BLOCK_TERMS:
            yield block
            block, size = [], 0
        block.append((row["item_id"], own))
        size += len(own)
    if block:
        yield block


def threshold_search(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """item_id, rank, doc_id, score: for each row of ``items`` its ``top`` highest-scoring documents with a score above 0.

    Terms are maximal stretches of ASCII letters and digits and of all characters beyond ASCII, A-Z in lower case.  With N
    documents that have a term, L terms in them, df documents with a term: its weight is floor(1000 ln((2N+2)/(2df+1))), and
    a document's score sums weight * ((10^9 tf) div (1000 tf + 20 m)) over the item's terms, m = 50 + (50 n N) div L for
    its n terms.  Equal scores rank by doc_id, a null one last.

    Null and empty texts have no terms: such documents and items are in no result.  Rows that repeat are ranked each; a
    null item_id is kept; further columns are ignored; empty tables give no rows.  A very long text is counted whole, by one
    task.  The items are the given queries: they reach the driver block by block, never all at once; each block of BLOCK_TERMS terms is
    one reading of the documents.  A task holds a shard of CELLS impacts and ``top`` results of each of the block's items.
    """
    spark = docs.sparkSession
    out = None
    for block in _blocks(items):
        vocabulary = list(dict.fromkeys(t for _, own in block for t in own))
        number = {t: i for i, t in enumerate(vocabulary)}
        index = materialize(forward_index(docs, vocabulary), "forward-index")
        n_docs, n_terms = index.where("n > 0").agg(F.count("*"), F.coalesce(F.sum("n"), F.lit(0))).first()
        df = np.zeros(len(vocabulary), np.int64)
        for row in index.select(F.explode("term").alias("term")).groupBy("term").count().collect():  # the block's terms at most
            df[row["term"]] = row["count"]
        weights = np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * x + 1))) for x in df.tolist()], np.int64)
        found = _search(index, [np.array([number[t] for t in own]) for _, own in block], weights, n_docs, max(1, n_terms), top)
        order = Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last())
        ranked = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
        names = spark.createDataFrame([(i, x) for i, (x, _) in enumerate(block)], f"item int, item_id {items.schema['item_id'].dataType.simpleString()}")
        part = materialize(ranked.join(F.broadcast(names), "item").select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score"), "ranked")
        discard(index)
        out = part if out is None else out.unionByName(part)
    if out is None:
        return spark.createDataFrame([], f"item_id {items.schema['item_id'].dataType.simpleString()}, rank int, doc_id long, score long")
    return out


_TERM_SQL = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
_LOWER_SQL = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
ORACLE_SQL = f"""
WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER_SQL}, '{_TERM_SQL}') AS ts FROM documents),
i AS (SELECT item_id, unnest(list_distinct(regexp_extract_all({_LOWER_SQL}, '{_TERM_SQL}'))) AS t FROM benchmark),
c AS (SELECT CAST(count(*) AS BIGINT) AS N, CAST(sum(len(ts)) AS BIGINT) AS L FROM d WHERE len(ts) > 0),
f AS (SELECT doc_id, t, count(*) AS tf FROM (SELECT doc_id, unnest(ts) AS t FROM d) WHERE t IN (SELECT t FROM i) GROUP BY 1, 2),
w AS (SELECT t, CAST(floor(1000 * ln((2 * N + 2) / CAST(2 * df + 1 AS DOUBLE))) AS BIGINT) AS w FROM (SELECT t, count(*) AS df FROM f GROUP BY 1), c),
m AS (SELECT doc_id, 100 - 50 + ((50 * len(ts) * N) // L) AS m FROM d, c WHERE len(ts) > 0),
s AS (SELECT item_id, doc_id, CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 20 * m))) AS BIGINT) AS score FROM i JOIN f USING (t) JOIN w USING (t) JOIN m USING (doc_id) GROUP BY 1, 2)
SELECT item_id, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank, doc_id, score FROM s WHERE score > 0
QUALIFY row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) <= 50
"""
