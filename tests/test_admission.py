"""Usage caps request by request, against a plain loop."""

import datetime as dt
import random

import pytest

from quillon.operators import limits as L
from quillon.streaming import admission as A

SCHEMA = "deployment long, request_id long, session long, ts timestamp"


def requests(n=600, sessions=12, deployments=2, days=6):
    rng, start = random.Random(4), dt.datetime(2024, 3, 1, 22)
    return [(rng.randrange(deployments), i, rng.randrange(sessions), start + dt.timedelta(seconds=rng.randrange(days * 86400))) for i in range(n)]


def plain(rows, session_cap, day_cap):
    used, counts, found = {}, {}, {}
    for g, i, s, ts in sorted(rows, key=lambda r: (r[3], r[1])):
        if used.get((g, s), 0) >= session_cap:
            found[i] = "session_cap"
        elif counts.get((g, ts.date()), 0) >= day_cap:
            found[i] = "day_cap"
        else:
            found[i] = "accept"
            used[g, s], counts[g, ts.date()] = used.get((g, s), 0) + 1, counts.get((g, ts.date()), 0) + 1
    return found


@pytest.mark.parametrize("caps", [(10, 30), (15, 20), (200, 5), (3, 500), (1, 1)])
def test_batch(spark, caps):
    rows = requests()
    df = spark.createDataFrame(rows, SCHEMA).selectExpr("*", "to_date(ts) AS day", "'x' AS other")
    got = L.admissions(df, *caps, group="deployment")
    assert got.columns == [*df.columns, "outcome"]
    assert {r["request_id"]: r["outcome"] for r in got.collect()} == plain(rows, *caps)


def test_batch_without_rows_and_with_nulls(spark):
    schema = "request_id long, session long, day date, ts timestamp"
    assert L.admissions(spark.createDataFrame([], schema)).count() == 0
    at = dt.datetime(2024, 1, 1)
    rows = [(1, None, None, at), (2, None, at.date(), at), (3, 5, at.date(), at), (None, 5, at.date(), at)]
    got = L.admissions(spark.createDataFrame(rows, schema), 1, 9)
    assert sorted((str(r["request_id"]), r["outcome"]) for r in got.collect()) == [("1", "accept"), ("2", "session_cap"), ("3", "session_cap"), ("None", "accept")]


def test_stream_over_midnight(spark, tmp_path):
    """Batches cut the requests anywhere; sessions and the day's count go on from one to the next."""
    rows = sorted(requests(240), key=lambda r: (r[3], r[1]))
    old = spark.conf.get("spark.sql.streaming.stateStore.providerClass")
    spark.conf.set("spark.sql.streaming.stateStore.providerClass", A.STORE)
    try:
        for n, at in enumerate(range(0, 240, 80)):
            spark.createDataFrame(rows[at : at + 80], SCHEMA).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
            stream = A.admitted_stream(spark.readStream.schema(SCHEMA).parquet(f"{tmp_path}/in"), 8, 15)
            stream.writeStream.format("parquet").option("checkpointLocation", f"{tmp_path}/ck").trigger(availableNow=True).start(f"{tmp_path}/out").awaitTermination()
    finally:
        spark.conf.set("spark.sql.streaming.stateStore.providerClass", old)
    got = {r["request_id"]: r["outcome"] for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == plain(rows, 8, 15) and len(set(got.values())) == 3
