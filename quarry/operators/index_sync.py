"""A vector index kept in step with its chunks: what is new or changed is embedded and merged, what is gone is pruned, and the counts say
whether the index is ready. Every step is a version of the points' table under the run's name, so a run that stopped goes on
where it was when it is started again, and a run that ended changes nothing."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from quarry.sources.stores import points
from quarry.sources.tables import settled
from quarry.sources.versions import Versions


def sync_index(index: Versions, chunks: DataFrame, embed: Callable[[DataFrame], DataFrame], dims: int, run: str, batches: int = 1) -> DataFrame:
    """One row: run, embedded, pruned, held, missing, ready.

    chunks: chunk_id, text_hash and any payload; embed: chunks -> (chunk_id, vector). A chunk is due if the index lacks it or holds
    another hash. Due chunks go in `batches` parts by a hash of their id, each committed by itself; ValueError if a part's vectors are too few
    or of another length than dims (earlier parts stay). Rows without a chunk_id are left out; an empty table prunes everything.
    """
    wanted = settled(chunks.where("chunk_id is not null").dropDuplicates(["chunk_id"]))
    log = index.log()
    done = {e["batch"]: e["facts"] for e in log if e["batch"].startswith(f"{run}/")}
    embedded = 0
    for i in range(batches):
        if (name := f"{run}/{i}of{batches}") in done:
            embedded += done[name]["n"]
            continue
        mine = wanted.where(F.pmod(F.xxhash64("chunk_id"), F.lit(batches)) == i)
        if index.log():
            mine = mine.join(index.read().select("chunk_id", "text_hash"), ["chunk_id", "text_hash"], "left_anti")
        mine = settled(mine)
        n = mine.count()
        index.merge(points(mine, embed(mine), dims), "point_id", keep=(), batch=name, facts={"n": n})
        embedded += n
    if f"{run}/prune" in done:
        pruned = done[f"{run}/prune"]["n"]
    else:
        gone = settled(index.read().join(wanted.select("chunk_id"), "chunk_id", "left_anti").select("point_id"))
        pruned = gone.count()
        if pruned:
            index.remove(gone, "point_id", batch=f"{run}/prune", facts={"n": pruned})
    held = index.read()
    missing = wanted.join(held.select("chunk_id", "text_hash"), ["chunk_id", "text_hash"], "left_anti").count()
    n = held.count()
    return chunks.sparkSession.createDataFrame([Row(run=run, embedded=embedded, pruned=pruned, held=n, missing=missing, ready=n > 0 and not missing)])
