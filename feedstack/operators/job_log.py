"""Job event logs (L24): every move judged, and the state that a job's events lead to.

The log is sorted once by (job, time, sequence number) into range partitions and written with a running row number, so a job
of any length is spread over as many tasks as its events need: no window and no list is kept per job.

* ``job_transitions`` looks at the row before each row.  Rows are compared inside blocks of 4,096 row numbers; the last row of
  each block is carried over to the next one.
* ``job_state`` replays the moves.  A run of events is a map from the state before it to the state after it, and such maps
  compose; so the events of a block are folded into one map, the maps of 4,096 blocks into one, and the few that are left into
  the state of the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..session import staged

JOB_TRANSITIONS = {  # allowed (from -> to) moves of a job
    "PENDING": ["IN_PROGRESS", "CANCELLED", "FAILED"],
    "IN_PROGRESS": ["COMPLETED", "FAILED", "CANCELLED"],
}
STATES = ["PENDING", "IN_PROGRESS", "COMPLETED", "FAILED", "CANCELLED"]
ENDED = [s for s in STATES if s not in JOB_TRANSITIONS]

#: Row numbers of a block and blocks of a segment, as powers of two; a task of the sort numbers its rows from a multiple of 2^33.
_BLOCK, _SEGMENT, _TASK = 12, 12, 33
_PROGRESS = ("processed_files", "failed_files", "total_reviews")
_OPTIONAL = {**dict.fromkeys(_PROGRESS, "int"), "file_name": "string", "file_list": "string"}


def ordered(events: DataFrame) -> DataFrame:
    """The log in order of (processing_id, event_ts, seq) with ``row_no``, which grows along that order and by one inside
    a task; written once, so that the numbers never change.  Events that share all three are ordered by their contents."""
    order = ["processing_id", "event_ts", "seq", *[c for c in ("status", *_OPTIONAL) if c in events.columns]]
    dealt = events.repartitionByRange(*order).sortWithinPartitions(*order)
    return staged(dealt.withColumn("row_no", F.monotonically_increasing_id()), "job-log")


def job_transitions(events: DataFrame) -> DataFrame:
    """Each event (``processing_id, event_ts, seq, status``, other columns as they come) with the status of the event
    before it in its job, and whether the move between them is legal; the first event of a job always is."""
    rows = ordered(events).withColumn("_block", F.shiftright("row_no", _BLOCK))
    last = rows.groupBy("_block").agg(F.max_by("processing_id", "row_no").alias("processing_id"),
                                      F.max_by("status", "row_no").alias("status"))
    # The block after the last one of a task is the first one of the next task that has rows: one row for each task.
    tasks = last.groupBy(F.shiftright("_block", _TASK - _BLOCK).alias("task")).agg(
        F.min("_block").alias("first"), F.max("_block").alias("_block"))
    tasks = tasks.select("_block", F.lead("first").over(Window.orderBy("task")).alias("next"))
    carried = last.join(tasks, "_block", "left").select(
        F.coalesce("next", F.col("_block") + 1).alias("_block"), "processing_id", "status", F.lit(-1).cast("long").alias("row_no"))
    w = Window.partitionBy("_block").orderBy("row_no")
    same = F.lag("processing_id").over(w).eqNullSafe(F.col("processing_id")) & F.lag("row_no").over(w).isNotNull()
    prev = F.col("previous_status")
    legal = F.lit(False)
    for src, dsts in JOB_TRANSITIONS.items():
        legal = legal | ((prev == src) & F.col("status").isin(*dsts))
    return (rows.unionByName(carried, allowMissingColumns=True)
            .withColumn("previous_status", F.when(same, F.lag("status").over(w))).filter("row_no >= 0")
            .withColumn("legal", prev.isNull() | legal).drop("_block", "row_no"))


def _map(state: Column | int, refused: Column, start: Column, end: Column) -> Column:
    state = F.lit(state) if isinstance(state, int) else state
    return F.struct(state.cast("int").alias("state"), refused.cast("long").alias("refused"),
                    start.cast("timestamp_ntz").alias("start"), end.cast("timestamp_ntz").alias("end"))


def _identity() -> Column:
    """The map of no events; entry 0 is a job without a status, entry i one in the i-th of ``STATES``."""
    return F.array(*[_map(s, F.lit(0), F.lit(None), F.lit(None)) for s in range(len(STATES) + 1)])


def _legal() -> Column:
    """Whether a job in state s may move to state c, at s * 6 + c; a status outside ``STATES`` is 0 and never legal."""
    names = [None, *STATES]
    return F.array(*[F.lit(c is not None and (s is None or c in JOB_TRANSITIONS.get(s, []))) for s in names for c in names])


def _apply(maps: Column, event: Column) -> Column:
    """The maps after one more event (code, at): a legal move is made, any other is refused and counted."""
    started, ended = STATES.index("IN_PROGRESS") + 1, [STATES.index(s) + 1 for s in ENDED]

    def move(s: Column) -> Column:
        ok = F.get(_legal(), s["state"] * (len(STATES) + 1) + event["code"])
        return _map(F.when(ok, event["code"]).otherwise(s["state"]), s["refused"] + F.when(ok, 0).otherwise(1),
                    F.when(ok & (event["code"] == started), event["at"]).otherwise(s["start"]),
                    F.when(ok & event["code"].isin(ended), event["at"]).otherwise(s["end"]))

    return F.transform(maps, move)


def _compose(maps: Column, later: Column) -> Column:
    """The maps of a run followed by those of a later run."""
    def follow(s: Column) -> Column:
        m = F.get(later, s["state"])
        return _map(m["state"], s["refused"] + m["refused"], F.coalesce(m["start"], s["start"]), F.coalesce(m["end"], s["end"]))

    return F.transform(maps, follow)


def job_state(events: DataFrame) -> DataFrame:
    """One row for each job of a log, as a replay of its events in order leaves it.

    An event may hold a ``status`` (a move), a progress report (``processed_files``, ``failed_files``, ``total_reviews``) and a
    file added to a list (``file_name`` with ``file_list`` ``processed`` or ``failed``); columns that the log does not have
    count as null.  A legal move sets the status, and the start or end time; any other leaves them and is counted in
    ``refused_moves`` (an unknown status too; the first known one is legal).  The last report counts, as a whole.  Events
    without a job are the job null; an empty log gives no row."""
    log = events.withColumns({c: F.lit(None).cast(t) for c, t in _OPTIONAL.items() if c not in events.columns})
    rows = ordered(log.select("processing_id", "event_ts", "seq", "status", *_OPTIONAL))
    code = F.coalesce(F.array_position(F.array(*map(F.lit, STATES)), F.col("status")), F.lit(0)).cast("int")
    moves = F.when(F.col("status").isNotNull(), F.struct("row_no", code.alias("code"), F.col("event_ts").alias("at")))
    reported = F.when(F.coalesce(*_PROGRESS).isNotNull(), F.col("row_no"))
    added = F.col("file_name").isNotNull()
    level = rows.groupBy("processing_id", F.shiftright("row_no", _BLOCK).alias("run")).agg(
        F.sort_array(F.collect_list(moves)).alias("moves"), F.count(F.lit(1)).alias("events"),
        F.max_by(F.struct(*_PROGRESS), reported).alias("progress"), F.max(reported).alias("reported"),
        F.count_if(added & (F.col("file_list") == "processed")).alias("added_processed"),
        F.count_if(added & (F.col("file_list") == "failed")).alias("added_failed"))
    level = level.withColumn("maps", F.aggregate("moves", _identity(), _apply)).drop("moves")
    sums = ["events", "added_processed", "added_failed"]
    for keys in ([F.shiftright("run", _SEGMENT).alias("run")], []):
        parts = F.sort_array(F.collect_list(F.struct("run", "maps")))
        level = level.groupBy("processing_id", *keys).agg(
            F.aggregate(parts, _identity(), lambda acc, p: _compose(acc, p["maps"])).alias("maps"),
            F.max_by("progress", "reported").alias("progress"), F.max("reported").alias("reported"),
            *[F.sum(c).alias(c) for c in sums])
    s = F.get("maps", F.lit(0))
    return level.select(
        "processing_id", F.get(F.array(F.lit(None).cast("string"), *map(F.lit, STATES)), s["state"]).alias("status"), "events",
        s["refused"].alias("refused_moves"), s["start"].alias("start_time"), s["end"].alias("end_time"),
        *[F.col(f"progress.{c}").alias(c) for c in _PROGRESS], "added_processed", "added_failed")
