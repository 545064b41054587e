"""Items of capture pages with their states: pending, stored, failed, unavailable, kept by a stream for each page.

A page is done once all its items are stored or unavailable; the mark, up to which a sync needn't look again, stands
before the first page that isn't done.  Failed items come back as work until they have been tried often enough.
"""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

STATES = ("pending", "stored", "failed", "unavailable")
FINAL = ("stored", "unavailable")
PAGE = "page long, pending long, stored long, failed long, unavailable long, retry array<long>, final boolean, seen long"
_STATE = "items array<long>, states array<int>, latest array<long>, tries array<int>, seen long"


def page_states(stream: DataFrame, page: str, item: str, outcome: str, seq: str, tries: int = 3) -> DataFrame:
    """A row for a page whenever something happened to its items, with the number of items in each state.

    ``outcome`` is one of STATES (``pending``: the item was listed); an item's state is that of the outcome with the highest
    ``seq``, but ``stored`` and then ``unavailable`` are final whenever they come, so neither the order of events nor their
    division into batches matters, and an event that comes twice changes nothing but ``seen``.  ``retry``: failed items with fewer
    than ``tries`` failures.  A page's items are held together, as one page of a provider's listing; other outcomes and
    null items are left out.
    """

    def update(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        held: dict[int, list[int]] = {}
        seen = 0
        if state.exists:
            items, states, latest, failed, seen = state.get
            held = {i: [s, t, f] for i, s, t, f in zip(items, states, latest, failed, strict=True)}
        for frame in frames:
            for i, o, t in frame.sort_values(["item", "seq"])[["item", "outcome", "seq"]].itertuples(index=False):
                seen += 1
                code = STATES.index(o)
                now = held.setdefault(int(i), [0, -1, 0])
                final = STATES[now[0]] in FINAL
                now[2] += o == "failed" and t > now[1]
                if o == "stored" or not final and (o in FINAL or t > now[1]):
                    now[0] = code
                now[1] = max(now[1], int(t))
        order = sorted(held)
        state.update((order, [held[i][0] for i in order], [held[i][1] for i in order], [held[i][2] for i in order], seen))
        counts = [sum(held[i][0] == c for i in order) for c in range(len(STATES))]
        retry = [i for i in order if held[i][0] == STATES.index("failed") and held[i][2] < tries]
        yield pd.DataFrame({"page": [key[0]], **{n: [c] for n, c in zip(STATES, counts, strict=True)}, "retry": [retry], "final": [counts[0] + counts[2] == 0], "seen": [seen]})

    events = stream.select(F.col(page).cast("long").alias("page"), F.col(item).cast("long").alias("item"), F.col(outcome).alias("outcome"), F.col(seq).cast("long").alias("seq"))
    events = events.where(F.col("outcome").isin(*STATES) & F.col("item").isNotNull() & F.col("page").isNotNull() & F.col("seq").isNotNull())
    return events.groupBy("page").applyInPandasWithState(update, PAGE, _STATE, "update", GroupStateTimeout.NoTimeout)


def store_pages(pages: DataFrame, path: str, checkpoint: str):
    """Write each batch's rows to a folder of its number (a repeated batch replaces itself), over what is there, then end."""

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={number}")

    return pages.writeStream.outputMode("update").foreachBatch(keep).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def current_pages(stored: DataFrame) -> DataFrame:
    """The latest row of each page."""
    columns = [c.split()[0] for c in PAGE.split(", ")]
    row = F.max_by(F.struct(*columns), "seen").alias("r")
    return stored.groupBy(F.col("page").alias("p")).agg(row).select("r.*")


def mark(pages: DataFrame) -> DataFrame:
    """One row: ``mark``, the last page before the first that isn't done (null if the first isn't), and how many are open."""
    first = F.min(F.when(~F.col("final"), F.col("page")))
    found = pages.agg(first.alias("open"), F.count_if(~F.col("final")).alias("open_pages"))
    done = pages.where("final").crossJoin(F.broadcast(found)).where("open is null or page < open").agg(F.max("page").alias("mark"))
    return done.crossJoin(F.broadcast(found.select("open_pages")))
