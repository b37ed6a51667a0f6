"""A store in buckets: what a change reads and writes, and the rows against plain Python."""

from __future__ import annotations

import os

from pyspark.sql import functions as F

from lodemill import spi
from lodemill.sources.buckets import Buckets
from lodemill.streaming import ingest

SCHEMA = "id long, name string, status string, error_message string, done boolean"


def files(path: str) -> dict[str, set[str]]:
    return {d: {f for _, _, fs in os.walk(f"{path}/{d}") for f in fs if f.endswith(".parquet")} for d in os.listdir(path) if d.startswith("bucket=")}


def opened(spark, tmp_path, n=32):
    b = Buckets(spark, str(tmp_path / "t"), SCHEMA, "id", n)
    b.upsert(spark.range(300).select("id", F.concat(F.lit("n"), "id").alias("name"), F.lit("NEW").alias("status"), F.lit("e").alias("error_message"), F.lit(False).alias("done")))
    return b


def test_a_change_reads_and_writes_what_it_touches(spark, tmp_path):
    b = opened(spark, tmp_path)
    before = files(b.path)
    assert len(before) == 32 and b.read().count() == 300
    asked: list = []
    read = b.read
    b.read = lambda buckets=None: asked.append(buckets) or read(buckets)
    changes = spark.createDataFrame([(7, "OLD", None), (9, "OLD", "x"), (999, "OLD", None)], "id long, status string, error_message string")
    touched = b.set_status(changes)
    after = files(b.path)
    assert 1 <= len(touched) <= 3 and asked == [touched]
    assert {d for d in after if after[d] != before.get(d)} <= {f"bucket={k}" for k in touched}
    assert all(f"bucket={k}" in f for f in b.of(changes).inputFiles() for k in [int(f.split("bucket=")[1].split("/")[0])] if k not in touched) is True
    assert {int(f.split("bucket=")[1].split("/")[0]) for f in b.of(changes).inputFiles()} <= set(touched)
    b.read = read
    got = {r["id"]: (r["status"], r["error_message"]) for r in b.read().collect()}
    assert len(got) == 300 and got[7] == ("OLD", None) and got[9] == ("OLD", "x") and got[8] == ("NEW", "e")


def test_changes_as_by_a_dictionary(spark, tmp_path):
    b = opened(spark, tmp_path, 8)
    want = {k: [f"n{k}", "NEW", "e", False] for k in range(300)}
    rows = [(k, None if k % 2 else f"m{k}", "UP", None, None) for k in range(250, 350, 3)]
    for _ in range(2):  # made again it changes nothing
        b.upsert(spark.createDataFrame(rows, SCHEMA))
    for k, *values in rows:
        want[k] = [v if v is not None else o for v, o in zip(values, want.get(k, [None] * 4), strict=True)]
    b.patch(spark.createDataFrame([(1, "p", None), (4000, "q", None)], "id long, name string, error_message string"), overwrite=("error_message",))
    want[1][0], want[1][2] = "p", None
    b.flag(spark.createDataFrame([(2,), (2,), (5000,)], "id long"), "done", F.lit(True))
    want[2][3] = True
    b.delete(spark.createDataFrame([(k,) for k in range(0, 300, 7)], "id long"))
    want = {k: v for k, v in want.items() if not (k < 300 and k % 7 == 0)}
    assert {r["id"]: [r["name"], r["status"], r["error_message"], r["done"]] for r in b.read().collect()} == want
    b.delete(b.read([3]).select("id"))
    assert not os.path.exists(f"{b.path}/bucket=3") and b.read([3]).count() == 0 and b.read().count() == len(want) - sum(1 for r in spark.createDataFrame([(k,) for k in want], "id long").select(b.bucket()).collect() if r[0] == 3)
    b.delete(b.read().select("id"))
    assert b.read().count() == 0 and b.upsert(spark.createDataFrame([(1, "again", None, None, None)], SCHEMA)) and b.read().count() == 1


def test_rows_without_key_and_inserted_rows(spark, tmp_path):
    b = opened(spark, tmp_path, 4)
    b.upsert(spark.createDataFrame([(None, "nobody", None, None, None)], SCHEMA))
    b.set_status(spark.createDataFrame([(None, "X", None)], "id long, status string, error_message string"))
    assert b.read().where("id is null and status is null").count() == 1
    more = spark.range(1000, 1100).select("id", F.lit("i").alias("name"), *[F.lit(None).cast(t).alias(c) for c, t in (("status", "string"), ("error_message", "string"), ("done", "boolean"))])
    for _ in range(2):
        b.insert(more, "5")
    assert b.read().count() == 401 and b.inserted("5").count() == 100
    b.flag(more, "done", F.lit(True))
    assert b.read().where("done").count() == 100


def test_ingestion_reads_only_buckets_of_its_documents(spark, tmp_path, monkeypatch):
    store = str(tmp_path / "s")
    docs = lambda a, b: spark.range(a, b).select("id", F.concat(F.lit("text of "), "id").alias("content"))
    ingest.process_batch(docs(0, 200), store, strategy="FIXED_LENGTH", batch=0)
    asked: list = []
    read = Buckets.read
    monkeypatch.setattr(Buckets, "read", lambda self, buckets=None: asked.append((self.path.rsplit("/", 1)[1], buckets)) or read(self, buckets))

    class Late(spi.HashEmbedder):
        def embed(self, texts):
            raise ValueError("not yet")

    before = files(f"{store}/chunks")
    ingest.process_batch(docs(199, 202), store, strategy="FIXED_LENGTH", batch=1, embedder=Late(16))
    after = files(f"{store}/chunks")
    assert all(before[d] <= after.get(d, set()) for d in before) and sum(map(len, after.values())) - sum(map(len, before.values())) <= 2
    assert ingest.backfill(spark, store, limit=10) == 2
    assert asked and all(name == "states" and buckets is not None and len(buckets) <= 3 for name, buckets in asked)
    monkeypatch.undo()
    assert ingest.states(spark, store).where("status = 'INDEXED'").count() == 202 and ingest.chunks(spark, store).where("vectorized").count() == 202
    assert ingest.backfill(spark, store) == 0 and not os.listdir(f"{store}/waiting") or all(not d.startswith("batch=") for d in os.listdir(f"{store}/waiting"))


def test_states_of_a_batch_are_found_without_its_content(spark, tmp_path, monkeypatch):
    """Of rows that share an id the least content counts; what tells a state shuffles no content."""
    plans, change = [], Buckets.change
    monkeypatch.setattr(Buckets, "change", lambda self, rows, how: plans.append(rows._jdf.queryExecution().executedPlan().toString()) or change(self, rows, how))
    docs = spark.createDataFrame([(1, None), (1, "b c"), (1, "a"), (2, ""), (2, "x"), (3, None), (4, "d"), (None, "e")], "id long, content string")
    for _ in range(2):
        ingest.process_batch(docs, str(tmp_path / "s"), embedder=spi.HashEmbedder(4), strategy="FIXED_LENGTH", batch=0)
    assert sorted(map(tuple, ingest.states(spark, str(tmp_path / "s")).collect())) == [(1, "INDEXED", None), (2, "FAILED", "no content"), (3, "FAILED", "no content"), (4, "INDEXED", None)]
    assert sorted((r["document_id"], r["content"]) for r in ingest.chunks(spark, str(tmp_path / "s")).collect()) == [(1, "a"), (4, "d")]
    assert len(plans) == 1 and "content#" not in plans[0]
