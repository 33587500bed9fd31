"""Usage limits: a cap for each session, then a cap for each day over all sessions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quillon.session import durable

SESSION_CAP, DAY_CAP = 10, 150


def usage_caps(requests: DataFrame, session_cap: int = SESSION_CAP, day_cap: int = DAY_CAP) -> DataFrame:
    """requests (request_id, session, day, ts) with outcome: accept, session_cap or day_cap.

    Requests that the session's cap rejects never count for the day. Exact for sessions within one day; a session over
    midnight whose requests the day's cap rejects would keep more of its own.
    """
    own = Window.partitionBy("session").orderBy("ts", "request_id")
    rows = requests.withColumn("_s", F.row_number().over(own) > session_cap)
    daily = Window.partitionBy("day").orderBy("ts", "request_id")
    # The cap prunes each task's rows before the shuffle, so a busy day never meets in one task.
    within = rows.where(~F.col("_s")).withColumn("_n", F.row_number().over(daily)).where(F.col("_n") <= day_cap).select("request_id", F.lit(True).alias("_a"))
    rows = rows.join(within, "request_id", "left")
    return rows.withColumn("outcome", F.when(F.col("_s"), "session_cap").when(F.col("_a"), "accept").otherwise("day_cap")).drop("_s", "_a")


def remaining(cap: int, used: Column) -> Column:
    return F.greatest(F.lit(0), F.lit(cap) - used)


def admissions(requests: DataFrame, session_cap: int = SESSION_CAP, day_cap: int = DAY_CAP, group: str | None = None) -> DataFrame:
    """requests (request_id, session, day, ts) with outcome: accept, session_cap or day_cap, as if asked one by one.

    Exact also for sessions that go on over midnight: a session's count advances only if the day admits the request, and a
    request that the session's cap rejects doesn't count for the day. With `group`, each of its values has caps of its
    own. Order is by ts, then request_id; requests with a null session are one session, those with a null day one day,
    the first.

    Within a day, the accepted requests of a session are its first few, so a day needs to know only what each session had
    used before. All days are settled at once from an estimate of that, in rounds until nothing changes: after the first
    round the first day is right, after the next one the second too, and a day that cuts no session short costs none. A
    session has at most as many requests to look at a day as its cap, and a day's cap prunes rows before they are shuffled.
    """
    own = [group] if group else []
    keys = [*own, "session", "day"]
    first = Window.partitionBy(*keys).orderBy("ts", "request_id")
    asking = requests.select(*own, "request_id", "session", "day", "ts", F.row_number().over(first).alias("_r")).where(F.col("_r") <= session_cap)
    asking = durable(asking)
    daily = Window.partitionBy(*own, "day").orderBy("ts", "request_id")
    earlier = Window.partitionBy(*own, "session").orderBy("day").rowsBetween(Window.unboundedPreceding, -1)
    used = None  # keys, before: what a session had used before a day; taken: what it uses on that day
    while True:
        if used is None:
            held = asking.withColumn("_before", F.lit(0).cast("long"))
        else:
            held = _matched(asking, used.select(*keys, F.col("before").alias("_before")), keys).withColumn("_before", F.coalesce("_before", F.lit(0).cast("long")))
        rows = held.where(F.col("_r") <= session_cap - F.col("_before"))
        taken = rows.withColumn("_n", F.row_number().over(daily)).where(F.col("_n") <= day_cap)
        taken = taken.groupBy(*keys).agg(F.count("*").alias("taken"))
        # Days on which a session asked: what it had used before them counts there.
        days = asking.where("_r = 1").select(*keys)
        now = _matched(days, taken, keys).withColumn("taken", F.coalesce("taken", F.lit(0).cast("long")))
        now = durable(now.withColumn("before", F.coalesce(F.sum("taken").over(earlier), F.lit(0).cast("long"))))
        if used is not None and _matched(now, used.select(*keys, F.col("before").alias("_b"), F.col("taken").alias("_t")), keys).where("before <> _b or taken <> _t").isEmpty():
            break
        used = now
    ranked = requests.withColumn("_r", F.row_number().over(first))
    rows = _matched(ranked, used.select(*keys, F.col("before").alias("_before"), F.col("taken").alias("_taken")), keys)
    outcome = F.when(F.col("_r") <= F.col("_taken"), "accept").when(F.col("_before") + F.col("_taken") >= session_cap, "session_cap").otherwise("day_cap")
    return rows.withColumn("outcome", outcome).drop("_r", "_before", "_taken")


def _matched(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """A left join by keys in which null equals null."""
    same = F.lit(True)
    for k in keys:
        right = right.withColumnRenamed(k, f"_k_{k}")
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    return left.join(right, same, "left").drop(*[f"_k_{k}" for k in keys])
