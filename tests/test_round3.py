"""The findings of the third round."""

from __future__ import annotations

import itertools
import json
import pickle
import random
import time
from types import SimpleNamespace

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from telemill.functions import sqltext
from telemill.operators import fleet
from telemill.operators.privacy import engine, jsonwalk
from telemill.operators.privacy.detectors import builtin_detectors, register_detector
from telemill.operators.privacy.policy import OPT_IN_DETECTORS, PrivacyPolicy
from telemill.plans import extension_queries, inputs, stream_queries, whole_queries
from telemill.sinks import spool
from telemill.streaming.keyindex import KeyIndex

PARTS = ["a@b.org", "x.y@h1.corp", "100000001", "123 456 789A", "0412 345 678", "10.1.2.3", "www.example.com", "DOB: 1/2/1990", "passport PA1234567",
         "driver 12345678", "123-456 account 12345678", "123456/87654321", "GB82WEST12345698765432", "gb82west12345698765432", "ABCDEFGH", "N12345", "DVA ",
         "4111 1111 1111 1111", "4-1-1-1-1-1-1-1-1-1-1-1-1-1-1-1", "user: bob", "sk-" + "a1" * 12, "token='" + "x" * 20 + "'", "PASSWORD=hunter22", "-----BEGIN CERTIFICATE-----x-----END CERTIFICATE-----",
         "bearer " + "q" * 20, "mysql://u:p@h/d", "SECRET", " ", ", ", "é", "ſ", "😀", "9", "-", "\n", "\t", "\"", "\\", "\u001c"]


def test_what_the_walk_rules_out_is_not_found(spark):
    rng = random.Random(3)
    texts = ["".join(rng.choice(PARTS) for _ in range(rng.randint(1, 8))) for _ in range(400)]
    policy = PrivacyPolicy(enabled_opt_in=OPT_IN_DETECTORS)
    gates = jsonwalk.Gates.of(engine.enabled_detectors(policy))
    asked = gates.asked(texts)
    # Fields that one text has must not lean on its neighbours.
    assert asked == [gates.asked([t])[0] for t in texts]
    rows = engine.scan_text(spark.createDataFrame(list(enumerate(texts)), "id int, text string"), "text", policy).collect()
    found = sum(len(r["_spans"]) for r in rows)
    missed = [(texts[r["id"]], s["ord"]) for r in rows for s in r["_spans"] if s["ord"] not in asked[r["id"]]]
    assert found > 400 and not missed
    # The same spans in a document as in plain text.
    docs = spark.createDataFrame([(i, json.dumps({"a": {"b": [t]}})) for i, t in enumerate(texts)], "id int, raw string")
    done = {r["id"]: r["redaction"]["findings"] for r in jsonwalk.redact_json(docs, "raw", policy).collect()}
    ids = [d.id for d in builtin_detectors()]
    for row in rows:
        ours = sorted((f["start"], f["size"], f["detector"]) for f in done[row["id"]])
        assert ours == sorted((s["start"], s["size"], ids[s["ord"]]) for s in row["_spans"]), texts[row["id"]]


def test_own_detectors_and_names_are_asked_everywhere(spark):
    catalogue = register_detector(builtin_detectors(), "x.end", r"\d$")
    df = spark.createDataFrame([('{"a":"x1","b":"1x","Pass-Word":{"c":"y2"},"d":"\\ud800 a@b.org"}',)], "raw string")
    done = jsonwalk.redact_json(df, "raw", detectors=catalogue).first()["redaction"]
    assert [(f["path"], f["detector"]) for f in done["findings"]] == [("$.Pass-Word", "field-name-secret"), ("$.a", "x.end"), ("$.d", "id.email")]
    assert json.loads(done["json"])["b"] == "1x"


def test_a_document_is_not_opened_as_variants(spark):
    """Opening every member as a variant of its own cost more than all detectors."""
    df = jsonwalk.redact_json(spark.createDataFrame([("{}",)], "raw string"), "raw", strict=True)
    plan = df.select(F.col("redaction.findings"))._jdf.queryExecution().optimizedPlan().toString()
    assert "try_variant_get" not in plan and "map<string,variant>" not in plan


class SlowStream:
    """A stream whose first batch takes hours of the clock and whose rows come in steps."""

    def __init__(self, rows):
        self.rows, self.looks, self.stopped, self.isActive = rows, 0, False, True
        self.status = {"isTriggerActive": True}

    def exception(self):
        return None

    @property
    def lastProgress(self):
        self.looks += 1
        return None if self.looks < 400 else SimpleNamespace(batchId=self.looks - 400, numInputRows=int(self.looks == 400))

    def written(self):
        return self.rows[min(self.looks - 400, len(self.rows) - 1)]

    def stop(self):
        self.stopped = True


def test_silence_waits_for_every_collector(monkeypatch):
    """The clock does not cut the result: the old loop read what there was after 120 seconds."""
    now = [0.0]
    monkeypatch.setattr(stream_queries.time, "sleep", lambda s: now.__setitem__(0, now[0] + s))
    monkeypatch.setattr(stream_queries.time, "monotonic", lambda: now[0])
    slow = SlowStream([0] * 50 + [3] * 50 + [7])
    stream_queries._wait_for(slow, 7, slow.written)
    assert slow.stopped and slow.looks >= 500 and now[0] > 120
    stuck = SlowStream([0, 3])
    with pytest.raises(RuntimeError, match="3 of 7"):
        stream_queries._wait_for(stuck, 7, stuck.written)
    assert stuck.stopped


def test_a_large_batch_meets_a_small_generation_in_slices(spark, tmp_path):
    """All keys of the batch were one group of one task, as a small generation has one bucket."""
    index = KeyIndex(spark, str(tmp_path), slice_keys=100)

    def keys(low, high):
        return spark.range(low, high).selectExpr("'event_id' AS kind", "concat('k', id) AS key")

    index.add(keys(0, 10), 0)
    batch = keys(5, 2_000)
    assert index.slices(batch.count(), 1) == 20
    plan = index.candidates(batch, index.live(1))._jdf.queryExecution().analyzed().toString()
    assert "cut" in plan
    assert sorted(r.key for r in index.known(batch, 1).collect()) == [f"k{i}" for i in range(5, 10)]


def test_rows_of_one_row_group_are_dealt_over_the_cores(spark, tmp_path):
    """A file of one row group was one task, and all events went through the wide expressions on one core."""
    spark.range(400).selectExpr("id AS event_id", "timestamp'2024-01-01' AS ts", "id AS user_id", "'click' AS event_type", "'{\"k\":7}' AS props").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    sizes = inputs.candidates(spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()
    assert len(sizes) >= spark.sparkContext.defaultParallelism and max(r["count"] for r in sizes) < 100


@pytest.mark.parametrize("query", [whole_queries.hostile_texts, whole_queries.wide_json])
def test_rows_that_grow_are_dealt_over_the_cores_before(spark, tmp_path, query):
    """Texts and records are made from rows of a few bytes; those of one row group were all made by one task."""
    spark.range(64).selectExpr("id AS p_partkey").coalesce(1).write.parquet(f"{tmp_path}/part.parquet")
    spark.range(64).selectExpr("id AS c_custkey", "concat('c', id) AS c_name").coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    plan = query(spark, str(tmp_path))._jdf.queryExecution().optimizedPlan().toString()
    assert f"Repartition {2 * spark.sparkContext.defaultParallelism}, true" in plan


def test_running_states_of_a_long_array(spark):
    """The states of all cells before were copied with each cell: a million elements took minutes."""
    values = "transform(sequence(1, {}), i -> cast(i % 7 AS int))"
    for n in (1, 127, 128, 129, 16_500):
        row = spark.sql(f"SELECT {values.format(n)} AS v, {sqltext.prefix_sums(values.format(n))} AS sums, {sqltext.prefix_maxima(values.format(n))} AS tops").first()
        assert row.sums == list(itertools.accumulate(row.v)) and row.tops == list(itertools.accumulate(row.v, max))
    assert spark.sql(f"SELECT {sqltext.prefix_sums('cast(array() AS array<int>)')} AS sums").first().sums == []
    spark.range(1).selectExpr("id AS n").createOrReplaceTempView("one")
    started = time.monotonic()
    sums = sqltext.prefix_sums("transform(sequence(1, 1000000 + cast(n AS int)), i -> 1)")
    assert spark.sql(f"SELECT element_at({sums}, -1) AS last FROM one").first().last == 1_000_000
    assert time.monotonic() - started < 20


def test_reports_are_not_sent_whole_to_every_task(spark):
    """All events' reports stood in each task, because the file they were made from is small."""
    report = "array(named_struct('source_id', concat('s', id % 3), 'type', 'file', 'status', 'ok', 'lag_seconds', id, 'last_event_at', timestamp'2024-01-01'))"
    events = spark.range(20).selectExpr("concat('c', id % 4) AS collector_id", "id AS seq", f"{report} AS sources")
    states = spark.range(4).selectExpr("concat('c', id) AS collector_id", "id + 16 AS reports_seq")
    found = fleet.current_reports(states, events, "sources")
    assert sorted((r.collector_id, r.lag_seconds) for r in found.collect()) == [(f"c{i}", i + 16) for i in range(4)]
    assert "Broadcast" not in found._jdf.queryExecution().executedPlan().toString()


def test_small_files_are_read_many_a_task(spark, tmp_path):
    """A task for every 32 files of a kilobyte cost more than all other steps."""
    rows = spark.range(300).selectExpr("'c' AS collector_id", "'s' AS stream", "cast(id AS string) AS event_id", "IF(id % 7 = 0, '', concat('é', id)) AS payload", "id AS received_at")
    packed = spool.pack_files(rows, 8)
    for _ in range(2):
        spool.write_delivery(packed, str(tmp_path), "d")
    files = list((tmp_path / "ready").iterdir())
    read = spool.read_delivered(spark, str(tmp_path))
    assert len(files) > 100 and read.rdd.getNumPartitions() == 1 and not (tmp_path / "active" / "d").exists()
    lines = [(f.name.removesuffix(".jsonl"), x) for f in files for x in f.read_text().split("\n")[:-1]]
    assert sorted(map(tuple, read.collect())) == sorted(lines) and len(lines) == 300
    assert spool.read_delivered(spark, str(tmp_path / "none")).count() == 0


def test_a_delivery_of_many_files_is_few_bytes_to_the_driver(tmp_path):
    """The driver holds what all tasks tell at a time: no name of a file, and names to read in few bytes each."""
    writer = spool.SpoolWriter(str(tmp_path), "d")
    rows = lambda low, high: iter([Row(stem="c1-main", batch_no=i // 50, file_no=i % 50, value=f"v{i}") for i in range(low, high)])
    messages = [writer.write(rows(0, 5000)), writer.write(iter([])), writer.write(rows(5000, 6000)), None]
    writer.write(rows(6000, 6010))
    assert all(len(pickle.dumps(m)) < 500 for m in messages)
    writer.commit(messages)
    # Run again, it replaces its files; what a lost task has written is gone.
    writer.commit([writer.write(rows(0, 100))])
    assert len(list((tmp_path / "ready").iterdir())) == 6000 and not list((tmp_path / "active").iterdir())
    reader = spool.SpoolReader(str(tmp_path))
    parts = reader.partitions()
    assert len(parts) == 3 and sum(len(pickle.dumps(p)) for p in parts) < 12 * 6000
    got = [r for p in parts for b in reader.read(pickle.loads(pickle.dumps(p))) for r in zip(b["file"].to_pylist(), b["value"].to_pylist())]
    assert sorted(got) == sorted((f"c1-main-d-{i // 50:010d}-{i % 50:06d}", f"v{i}") for i in range(6000))
    assert [list(spool.SpoolReader(str(tmp_path / "none")).read(p)) for p in spool.SpoolReader(str(tmp_path / "none")).partitions()] == [[]]


def test_event_ids_that_pass_for_tax_file_numbers(spark, tmp_path):
    """Their digits are masked in the event and its alert, so the number of the row cannot be read from there."""
    ids = [35_000_056, 35_000_005, 35_000_013]
    rows = [(i, "click", '{"k":33}') for i in ids]
    spark.createDataFrame(rows, "event_id long, event_type string, props string").selectExpr("*", "timestamp'2024-01-01' AS ts", "5L AS user_id").coalesce(1).write.parquet(f"{tmp_path}/events.parquet")
    got = [r.event_id for r in extension_queries.long_event_ids(spark, str(tmp_path)).collect()]
    # All have a secret's field; those numbers alone would be worth an alert, too.
    assert sorted(got) == sorted(ids)


def test_a_stream_has_a_file_for_every_core(spark, tmp_path):
    """A file is a task of the stream; eight of them kept no more than eight cores at work, however many there are."""
    cores, rows = spark.sparkContext.defaultParallelism, spark.range(500).selectExpr("id")
    for most, batches in ((4, 2), (8, 1), (2, 4)):
        place = f"{tmp_path}/{most}"
        arriving = stream_queries._as_stream(rows, place, most)
        assert len(list((tmp_path / str(most) / "in").glob("*.parquet"))) >= cores * 8 // most
        done = arriving.writeStream.format("parquet").option("path", f"{place}/out").option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start()
        done.awaitTermination()
        assert [p.numInputRows > 0 for p in done.recentProgress].count(True) == batches
        assert sorted(r.id for r in spark.read.parquet(f"{place}/out").collect()) == list(range(500))


def test_a_word_is_looked_for_once_in_a_document():
    """Each detector looked for its own words, most of which are nowhere."""
    gates = jsonwalk.Gates([(i, True, (f"w{i}", "both"), None, None) for i in range(40)] + [(40, True, (), "[0-9]", None), (41, False, (), None, None)])
    assert gates.words == sorted({"both", *(f"w{i}" for i in range(40))})
    assert gates.asked(["a W7.", "b", "é"]) == [[41, 7, 40], [41], [41]]
    assert gates.asked(["Both x", ""]) == [[41, *range(40)], [41]] and gates.asked([]) == []
