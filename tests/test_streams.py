"""Streams with state: caches that expire, and vectors that never come."""

from __future__ import annotations

from datetime import datetime, timedelta

from pyspark.sql import functions as F

from lodemill.streaming import caches, vectors

DAY = datetime(2024, 1, 1)
ROWS = "number long, user string, at timestamp, value string"


def batches(spark, root, *parts, schema):
    """Each part as a file, in this order; the stream takes one at a time."""
    import os
    import time

    for k, rows in enumerate(parts):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(f"{root}/{k}")
        for f in os.listdir(f"{root}/{k}"):
            os.utime(f"{root}/{k}/{f}", (time.time() - 100 + k,) * 2)
    return spark.readStream.schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", 1).parquet(root)


def at(hours: float) -> datetime:
    return DAY + timedelta(hours=hours)


def plain_cache(parts, hours: float) -> dict[int, tuple]:
    """Batch by batch, each in the order of time; later than an hour behind the batch before is dropped, and repeated numbers."""
    entries, seen, mark, out = {}, set(), DAY - timedelta(days=999), {}
    for rows in parts:
        for n, user, t, value in sorted({r[0]: r for r in rows if r[0] is not None and r[2] is not None}.values(), key=lambda r: (r[2], r[0])):
            if t <= mark or n in seen:
                continue
            seen.add(n)
            put = entries.get(user)
            hit = put is not None and t < put[1] + timedelta(hours=hours)
            if not hit:
                entries.pop(user, None)
                if value is not None:
                    entries[user] = (value, t)
            out[n] = (hit, put[0] if hit else value)
        mark = max(mark, max((r[2] for r in rows if r[0] is not None and r[2] is not None), default=mark) - timedelta(hours=1))
    return out


def test_entries_expire_and_nulls_are_not_kept(spark, tmp_path):
    parts = [
        [(1, "a", at(0), "x"), (2, "a", at(1), "y"), (3, "b", at(1), None), (4, "b", at(1.5), "z"), (5, None, at(1.6), "n"), (5, None, at(1.6), "n"), (None, "a", at(1), "q"), (6, "a", None, "q")],
        [(7, "a", at(1.99), "w"), (8, "a", at(2), "w"), (9, "b", at(3.49), None), (10, "b", at(3.5), None), (11, None, at(2), None), (2, "a", at(1), "y")],
        [(12, "a", at(0.2), "late"), (13, "a", at(3.9), "v"), (14, "a", at(4), "v"), (15, "c", at(40), None)],
        [(16, "c", at(41), "c"), (17, "a", at(41), None), (18, "c", at(42.5), None), (19, "c", at(43), None)],
    ]
    stream = batches(spark, str(tmp_path / "in"), *parts, schema=ROWS)
    with caches.rocksdb(spark):
        query = caches.asked(stream, "user", "number", "at", "value", 2 * 3600).writeStream.format("parquet").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start(str(tmp_path / "out"))
        query.awaitTermination()
        last = query.recentProgress[-1]
    got = {r["number"]: (r["hit"], r["value"]) for r in spark.read.parquet(str(tmp_path / "out")).collect()}
    assert got == plain_cache(parts, 2) and len(got) == 17 and 12 not in got
    cache = next(o for o in last["stateOperators"] if o["operatorName"] == "transformWithStateInPandasExec")
    assert cache["numRowsTotal"] <= 2  # of four users only the one whose entry has not ended is held, with its timer
    assert spark.conf.get(caches.PROVIDER) != caches.ROCKSDB


def test_vectors_that_never_come(spark, tmp_path):
    C, V = "document_id long, chunk_index int, n_chunks int, at timestamp", "document_id long, chunk_index int, at timestamp"
    c = [[(1, 0, 2, at(0)), (1, 1, 2, at(0)), (2, 0, 1, at(0)), (3, 0, 2, at(0.5)), (2, 0, 1, at(0))], [(3, 1, 2, at(5)), (2, 0, 1, at(0)), (4, 0, 3, at(5))], [(None, None, None, at(99))]]
    v = [[(1, 0, at(0.1)), (1, 1, at(1.0)), (1, 1, at(1.0)), (3, 0, at(0.6)), (2, 0, at(1.1))], [(3, 1, at(5.5)), (4, 0, at(5.2)), (9, 9, at(5))], [(None, None, at(99))]]
    found = vectors.outcomes(batches(spark, str(tmp_path / "c"), *c, schema=C), batches(spark, str(tmp_path / "v"), *v, schema=V))
    states = lambda: {r["document_id"]: (r["status"], r["error_message"]) for r in vectors.states(spark, str(tmp_path / "s"), 4).collect()}
    want = {1: ("INDEXED", None), 2: ("FAILED", "no vector"), 3: ("INDEXED", None), 4: ("PROCESSING", None)}
    for _ in range(2):
        vectors.follow(found, str(tmp_path / "s"), str(tmp_path / "cp"), 4)
        assert states() == want
    vectors.follow(found, str(tmp_path / "s"), str(tmp_path / "cp2"), 4)  # all batches again, from the start
    assert states() == want


def test_windows_and_sessions_are_those_of_a_table(spark, sf):
    from lodemill.streaming import ingest

    e = spark.read.parquet(f"{sf}/events.parquet")
    assert ingest.windowed_counts(e).agg(F.sum("n")).first()[0] == e.count() == ingest.sessions(e).agg(F.sum("n")).first()[0]


def test_a_range_of_days_is_landed_by_many_tasks_and_taken_as_one_batch(spark, tmp_path, monkeypatch):
    from lodemill.plans import streams

    monkeypatch.setattr(streams, "LANDED", 10)
    rows = spark.range(120).select("id", F.timestamp_seconds(1_704_067_200 + F.col("id") * 21_600).alias("ts"))
    stream = streams._landed(spark, str(tmp_path / "in"), rows, "ts")
    assert all(len(list((tmp_path / "in" / str(k)).glob("*.parquet"))) == 2 for k in range(4))
    took = []
    stream.writeStream.option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).foreachBatch(lambda df, k: took.append(sorted(r[0] for r in df.select("id").collect()))).start().awaitTermination()
    want = [sorted(r[0] for r in rows.where(f"dayofmonth(ts) > {a} and dayofmonth(ts) <= {b}").select("id").collect()) for a, b in ((0, 8), (8, 16), (16, 24), (24, 31))]
    assert took == want and sum(map(len, took)) == 120
