from __future__ import annotations

import gzip
import json

from conftest import rows_of
from pyspark.sql import functions as F

from tidewire.operators.history import rebuild_seen, sighting_times
from tidewire.schemas import SIGHTING
from tidewire.sources import readers, writers
from tidewire.streaming.ingest import Ingest


def test_json_lines_skip_broken_and_missing(spark, tmp_path):
    line = lambda k: json.dumps({"entry_key": k, "observed_at": "t"})
    (tmp_path / "a.jsonl").write_text(line("1") + "\n\n" + line("2") + "\n" + line("3")[:-5])
    with gzip.open(tmp_path / "b.jsonl.gz", "wt") as f:
        f.write(line("4") + "\n")
    assert [r[0] for r in rows_of(readers.json_lines(spark, f"{tmp_path}/*.jsonl*", SIGHTING).select("entry_key"))] == ["1", "2", "4"]
    assert readers.broken_lines(spark, f"{tmp_path}/*.jsonl*", SIGHTING) == 1
    assert readers.json_lines(spark, f"{tmp_path}/none*", SIGHTING).isEmpty()


def test_day_logs(spark, tmp_path):
    folder = tmp_path / "domestic" / "host-1"
    folder.mkdir(parents=True)
    (folder / "sightings-2026-09-01.jsonl").write_text(json.dumps({"entry_key": "a"}) + "\n")
    log = readers.sighting_log(spark, str(tmp_path))
    row = log.head()
    assert (row["file_branch"], row["file_host"], row["day"]) == ("domestic", "host-1", "2026-09-01")
    assert rows_of(readers.collector_hosts(log)) == [("domestic", "host-1")]


def test_sheet_with_mark_and_line_breaks(spark, tmp_path):
    df = spark.createDataFrame([("a", 'x "y"\nz'), ("b", None)], "id string, text string")
    writers.write_sheet(df, f"{tmp_path}/out")
    part = next((tmp_path / "out").glob("*.csv"))
    marked = tmp_path / "marked.csv"
    marked.write_bytes(b"\xef\xbb\xbf" + part.read_bytes())
    back = readers.sheet(spark, str(marked))
    assert back.columns == ["id", "text"]
    assert rows_of(back) == [("a", 'x "y"\nz'), ("b", "")]


def test_state_file(spark, tmp_path):
    assert readers.feed_state(spark, f"{tmp_path}/none.json").head()["state"] == {}
    (tmp_path / "bad.json").write_text("{")
    assert not readers.feed_state(spark, f"{tmp_path}/bad.json").head()["state"]
    (tmp_path / "s.json").write_text('{"d":{"h":{"u":{"feed_started_at":"t"}}}}')
    assert readers.feed_state(spark, f"{tmp_path}/s.json").head()["state"]["d"]["h"]["u"]["feed_started_at"] == "t"


def test_news_index(spark, tmp_path):
    (tmp_path / "1.json").write_text('{"articles":[{"url":"u","title":"t"},{"url":"u"},{"url":" "}]}')
    (tmp_path / "2.json").write_text("<html>")
    assert [r["url"] for r in readers.news_index(spark, f"{tmp_path}/*.json").collect()] == ["u"]


def test_replace_table_may_read_itself(spark, tmp_path):
    path = f"{tmp_path}/t"
    writers.write_table(spark.range(3), path)
    writers.replace_table(readers.table(spark, path).filter("id > 0"), path)
    assert rows_of(readers.table(spark, path)) == [(1,), (2,)]
    assert readers.table_or_empty(spark, f"{tmp_path}/none", "id long").isEmpty()
    assert json.loads(writers.write_manifest(spark.sql("select 2 as b, null as a"), f"{tmp_path}/m.json")) == {"a": None, "b": 2}
    assert (tmp_path / "m.json").exists()


def polled(k, link, content, at):
    return {"observed_at": at, "run_id": f"run{at}", "branch": "domestic", "collector_host": "h", "source_system": "rss", "source_locator": "feed", "content_hash": content, "payload": {"link": link, "title": f"t{k}"}}


def test_stream_equals_batch(spark, tmp_path):
    landing = tmp_path / "landing"
    landing.mkdir()
    ingest = Ingest(spark, f"file://{tmp_path}/logs")
    batches = [
        [polled(1, "u1", "h1", "2026-09-01T00:00:00Z"), polled(2, None, "h2", "2026-09-01T00:00:00Z")],
        [polled(1, "u1", "h1", "2026-09-01T00:10:00Z"), polled(3, "u1", "h3", "2026-09-01T00:10:00Z"), polled(4, "u4", "h1", "2026-09-01T00:10:00Z")],
    ]
    for k, rows in enumerate(batches):
        (landing / f"{k}.jsonl").write_text("\n".join(map(json.dumps, rows)) + "\n")
        ingest.run(str(landing), f"{tmp_path}/checkpoint").awaitTermination()
    payloads, sightings = spark.read.parquet(f"{tmp_path}/logs/payloads"), spark.read.parquet(f"{tmp_path}/logs/sightings")
    assert sorted((r["entry_key"], r["content_hash"]) for r in payloads.collect()) == [("nourl:h2", "h2"), ("u1", "h1"), ("u1", "h3"), ("u4", "h1")]
    assert sightings.count() == 5 and sightings.filter("is_new").count() == 4
    rebuilt = rebuild_seen(payloads, sightings, F.col("raw_record_id"))
    assert {(r["entry_key"], r["last_seen_at"]) for r in rebuilt.collect() if r["content_hash"] == "h1"} == {("u1", "2026-09-01T00:10:00Z"), ("u4", "2026-09-01T00:10:00Z")}
    assert dict((r[0], r[1:]) for r in rows_of(sighting_times(sightings)))["u1"] == ("2026-09-01T00:00:00Z", "2026-09-01T00:10:00Z")
    # a batch that is run again changes nothing
    ingest.write_batch(spark.read.schema(",".join(f"{f.name} {f.dataType.simpleString()}" for f in spark.read.json(str(landing)).schema)).json(f"{landing}/1.jsonl").withColumn("publisher_id_hint", F.lit(None).cast("string")).select("observed_at", "run_id", "branch", "collector_host", "source_system", "source_locator", "publisher_id_hint", "content_hash", F.struct("payload.link", "payload.title").alias("payload")), 1)
    assert spark.read.parquet(f"{tmp_path}/logs/sightings").count() == 5
    assert [(r["n_entries"], r["n_new"]) for r in ingest.feed_results().orderBy("batch").collect()] == [(2, 2), (3, 2)]
    assert rows_of(ingest.feed_starts()) == [("domestic", "h", "feed", "2026-09-01T00:00:00Z")]
    assert ingest.seen_pairs(near=spark.sql("select 'u1' as entry_key")).filter("entry_key = 'u1'").count() == 2
    pairs, results = rows_of(ingest.seen_pairs().drop("batch")), rows_of(ingest.feed_results().drop("batch"))
    ingest.compact(2)
    assert (rows_of(ingest.seen_pairs().drop("batch")), rows_of(ingest.feed_results().drop("batch"))) == (pairs, results)
    assert [p.name for p in (tmp_path / "logs" / "sightings").glob("batch=*")] == ["batch=1"] and spark.read.parquet(f"{tmp_path}/logs/sightings").count() == 5
