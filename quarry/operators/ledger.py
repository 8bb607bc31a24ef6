"""Batches of units of work that go on where they stopped: a ledger holds each attempt with its state and reason, failures are rows and stop
nothing, and what has ended well is left out when the batch is started again."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quarry.sources.tables import settled
from quarry.sources.versions import Versions

#: States of an attempt. A blocked unit is refused by its source: it is not tried again before `retry_blocked`.
OK, BLOCKED, FAILED = "ok", "blocked", "failed"
_ATTEMPT = "unit string, attempt int, state string, reason string, result string, run string"


class Blocked(Exception):
    """Raised by work whose source refuses it."""


def latest(ledger: DataFrame) -> DataFrame:
    """The last attempt of each unit."""
    order = Window.partitionBy("unit").orderBy(F.desc("attempt"))
    return ledger.withColumn("__r", F.row_number().over(order)).where("__r = 1").drop("__r")


def due(units: DataFrame, ledger: DataFrame, unit: str, attempts: int, retry_blocked: bool) -> DataFrame:
    """units that are to be tried, with `attempt`, the number of this one."""
    last = latest(ledger).select(F.col("unit").alias("__unit"), F.col("attempt").alias("__attempt"), F.col("state").alias("__state"))
    over = (F.col("__state") == OK) | (F.col("__attempt") >= attempts)
    if not retry_blocked:
        over = over | (F.col("__state") == BLOCKED)
    named = units.where(F.col(unit).isNotNull()).dropDuplicates([unit])
    left = named.join(last.where(over), named[unit].cast("string") == F.col("__unit"), "left_anti")
    return left.join(last, left[unit].cast("string") == F.col("__unit"), "left").withColumn("attempt", (F.coalesce("__attempt", F.lit(0)) + 1).cast("int")).drop("__unit", "__attempt", "__state")


def run_batch(units: DataFrame, work: Callable[[dict], str], ledger: Versions, run: str, *, unit: str = "unit", attempts: int = 3, retry_blocked: bool = False) -> DataFrame:
    """Try what is due of units once, and publish all outcomes as one version of the ledger; run, state, n: how often each state came, with `skipped`
    for units that were not due.

    work: a unit's row as a dict -> its result as text; an exception makes the attempt failed (Blocked: blocked), with its reason, and the batch
    goes on. A run that is in the ledger already does nothing. Units without a name are left out, of those that share one, one is tried.
    """
    names = units.columns
    told = [e["batch"] for e in ledger.log()]
    held = ledger.read() if told else units.sparkSession.createDataFrame([], _ATTEMPT)
    if run not in told:
        todo = due(units, held, unit, attempts, retry_blocked)

        def tried(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                out = []
                for row in batch.to_pylist():
                    try:
                        out.append((str(row[unit]), row["attempt"], OK, None, work({k: row[k] for k in names})))
                    except Blocked as error:
                        out.append((str(row[unit]), row["attempt"], BLOCKED, str(error), None))
                    except Exception as error:  # any failure of a unit is its row, not the batch's end
                        out.append((str(row[unit]), row["attempt"], FAILED, f"{type(error).__name__}: {error}", None))
                yield pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*out, strict=True) if out else [()] * 5, (pa.string(), pa.int32(), pa.string(), pa.string(), pa.string()), strict=True)], ["unit", "attempt", "state", "reason", "result"])

        kind = StructType.fromDDL(_ATTEMPT.rpartition(",")[0])
        # Once: what is published is what was tried, though work may answer otherwise when it is asked again.
        ledger.append(settled(todo.mapInArrow(tried, kind)).withColumn("run", F.lit(run)), batch=run)
    mine = ledger.read().where(F.col("run") == run)
    n = units.where(F.col(unit).isNotNull()).select(unit).distinct().join(mine.select(F.col("unit").alias("__u")), F.col(unit).cast("string") == F.col("__u"), "left_anti")
    return mine.groupBy("run", "state").agg(F.count(F.lit(1)).alias("n")).unionByName(n.agg(F.lit(run).alias("run"), F.lit("skipped").alias("state"), F.count(F.lit(1)).alias("n")).where("n > 0"))
