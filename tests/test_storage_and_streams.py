"""Sinks, readers and streams; a stream cut into many micro-batches must agree with one batch."""

import json
import shutil
from datetime import datetime, timedelta

from pyspark.sql import Window
from pyspark.sql import functions as F

from corpusmill.sources import corpus
from corpusmill.streaming import streams


def rows(df, *cols):
    return sorted(tuple(r) for r in df.select(*cols).collect())


def test_chunk_table_upsert(spark, tmp_path):
    path = str(tmp_path / "chunks")
    make = lambda data: spark.createDataFrame(data, "chunk_id string, space_id int, strategy string, content string, indexed_at int")
    corpus.write_chunks(make([("a", 1, "s", "one", 1), ("b", 1, "s", "two", 1), ("c", 2, "s", "three", 1)]), path)
    corpus.write_chunks(make([("b", 1, "s", "newer", 2), ("b", 1, "s", "newest", 3), ("d", 1, "t", "four", 2)]), path)
    got = spark.read.parquet(path)
    assert rows(got, "chunk_id", "content") == [("a", "one"), ("b", "newest"), ("c", "three"), ("d", "four")]
    assert rows(corpus.delete_space(got, 1), "chunk_id") == [("c",)]


def test_file_scan_and_run_reader(spark, tmp_path):
    for name in ("a/x.md", "a/skip/y.md", "b/z.MD", "b/w.bin"):
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_text("text")
    got = corpus.scan_files(spark, str(tmp_path), [".md"], ["skip"])
    assert rows(got, "relative_path", "name", "size") == [("a/x.md", "x.md", 4), ("b/z.MD", "z.MD", 4)]
    (tmp_path / "runs").mkdir()
    (tmp_path / "runs/r1.json").write_text(json.dumps({"results": [{"id": "q1", "gold": "1", "metrics": {"number_match": True}}, {"gold": "no id"}]}, indent=1))
    (tmp_path / "runs/other.json").write_text('{"rows": []}')
    runs = corpus.read_runs(spark, str(tmp_path / "runs/*.json"))
    assert rows(runs, "run_id", "qid", "number_match") == [("r1", "q1", True)]


def write_parts(spark, df, folder, n):
    """The table in ``n`` files that arrive one after another."""
    total = df.count()
    for i in range(n):
        part = df.where((F.col("seq") >= i * total / n) & (F.col("seq") < (i + 1) * total / n)).drop("seq")
        part.coalesce(1).write.mode("append").parquet(folder)


def events(spark, n=120):
    start = datetime(2024, 1, 1)
    data = [(i, i % 5, start + timedelta(minutes=(i * 37) // 2 + (i % 5) * 400 * (i // 60)), "abc"[(i // 15) % 3]) for i in range(n)]
    data.sort(key=lambda r: r[2])
    return spark.createDataFrame([(*r, s) for s, r in enumerate(data)], "event_id long, user_id long, ts timestamp, event_type string, seq long")


def parts_of(df):
    return df.select(
        F.col("user_id").alias("message_id"), F.col("event_type").alias("part_id"), F.col("event_id").alias("seq"), F.concat("event_type", F.col("event_id").cast("string")).alias("delta"),
        (F.col("event_id") % 11 == 0).alias("is_end"), "ts",
    )


def brute_parts(rows, gap=timedelta(hours=2)):
    out, open_ = [], {}
    for r in sorted(rows, key=lambda r: (r["ts"], r["seq"])):
        key = r["message_id"], r["part_id"]
        at, block, text, n = open_.get(key, (r["ts"], 0, "", 0))
        if n and r["ts"] - at > gap:
            out.append((*key, block, text, n, False))
            block, text, n = block + 1, "", 0
        text, n = text + r["delta"], n + 1
        if r["is_end"]:
            out.append((*key, block, text, n, True))
            block, text, n = block + 1, "", 0
        open_[key] = r["ts"], block, text, n
    return sorted(out + [(*key, b, t, n, False) for key, (_, b, t, n) in open_.items() if n])


def test_streams_do_not_depend_on_micro_batches(spark, tmp_path):
    """One file, and several with rows up to the allowed lateness behind others: the same rows, and nothing left open."""
    df = events(spark)
    late = df.withColumn("seq", F.row_number().over(Window.orderBy(F.unix_micros("ts") + F.when(F.col("event_id") % 3 == 0, 9 * 60_000_000).otherwise(0))) - 1)
    results = {}
    for name, table, parts in (("one", df, 1), ("late", late, 3)):
        folder = str(tmp_path / f"in-{name}")
        write_parts(spark, table, folder, parts)

        def stream():
            raw = spark.readStream.schema(df.drop("seq").schema).option("maxFilesPerTrigger", 1).parquet(folder)
            end = streams.Closing(spark)
            return end.joined(raw), end

        calls = lambda s: s.select(F.col("user_id").alias("thread_id"), F.col("event_id").alias("call_id"), "ts", F.col("event_type").alias("signature"))
        runs = {
            "repeat": (lambda s: streams.repeat_runs(calls(s), 3), ["thread_id", "call_id", "run_length"]),
            "quota": (lambda s: streams.rolling_quota(s.select("user_id", F.col("event_id").alias("request_id"), "ts"), 4), ["user_id", "request_id", "used", "allowed"]),
            "beats": (lambda s: streams.heartbeat_timeout(s.select(F.col("user_id").alias("job_id"), "ts"), 2 * 3600), ["job_id", "last_beat"]),
            "rates": (lambda s: streams.live_counts(s, ["event_type"], "1 hour"), ["window_start", "event_type", "n"]),
            "parts": (lambda s: streams.assemble_parts(parts_of(s), "2 hours"), streams.PARTS.names),
        }
        results[name] = {}
        for what, (op, cols) in runs.items():
            source, end = stream()
            results[name][what] = rows(streams.run_to_table(op(source), closing=end), *cols)
    for what, got in results["one"].items():
        assert got and got == results["late"][what], what
    data = df.collect()
    assert sum(r[2] for r in results["one"]["rates"]) == len(data)
    assert results["one"]["parts"] == brute_parts(parts_of(df).collect())
    times = {}
    for r in sorted(data, key=lambda r: r["ts"]):
        times.setdefault(r["user_id"], []).append(r["ts"])
    silent = [(u, a) for u, ts in times.items() for a, b in zip(ts, [*ts[1:], streams.END]) if b - a > timedelta(hours=2)]
    assert results["one"]["beats"] == sorted(silent)


def test_keys_are_there_once_for_all_time(spark, tmp_path):
    schema, folder, path = "event_id long, message_id long, ts timestamp", str(tmp_path / "in"), str(tmp_path / "out")
    day = lambda n: datetime(2024, 1, 1) + timedelta(days=n)
    arrivals = [[(1, 7, day(0)), (2, 7, day(0)), (3, None, day(0))], [(4, 7, day(40)), (5, None, day(40)), (6, 8, day(40))], [(7, 8, day(2)), (8, 9, day(90)), (9, 9, day(80))]]
    for some in arrivals:
        spark.createDataFrame(some, schema).coalesce(1).write.mode("append").parquet(folder)
        streams.append_once(spark.readStream.schema(schema).parquet(folder), path, buckets=4).awaitTermination()
    want = [(1, 7), (3, None), (5, None), (6, 8), (9, 9)]
    once = lambda: sorted((r["event_id"], r["message_id"]) for r in streams.once_rows(spark, path).collect())
    assert once() == want
    # The last batch runs again, as after a crash before its checkpoint.
    commits = sorted((tmp_path / "out/checkpoint/commits").glob("[0-9]*"))
    commits[-1].unlink()
    for crc in (tmp_path / "out/checkpoint/commits").glob(".*.crc"):
        crc.unlink()
    streams.append_once(spark.readStream.schema(schema).parquet(folder), path, buckets=4).awaitTermination()
    assert once() == want


INCOMING = "arrival long, space_id long, doc_type string, unique_id string, title string, content string"


def test_ingest_replaces_retitles_and_repeats(spark, tmp_path):
    path = str(tmp_path / "table")
    batches = [
        [(1, 1, "FILE", "a", "A", "alpha " * 300), (2, 1, "FILE", "b", "B", "alpha " * 300), (3, 1, "FILE", "c", " ", "gamma"), (4, 1, "FILE", "d", "D", "delta")],
        [(5, 1, "FILE", "a", "A", "alpha two"), (6, 1, "FILE", "d", "D, new title", "delta"), (7, 0, "FILE", "e", "E", "eps"), (8, 1, "FILE", "f", "F", "alpha " * 300)],
        [(9, 1, "FILE", "f", "F", "alpha " * 300), (10, 1, "FILE", "g", "G", "alpha two"), (11, 1, "FILE", "d", "D, new title", "delta")],
    ]
    corpus = streams.Corpus(spark, path, 4)

    def state():
        return (
            rows(corpus.documents(), "doc_id", "title", "content", "action"), rows(corpus.chunks().withColumn("n", F.length("content")), "doc_id", "idx", "n"), rows(corpus.rejects(), "unique_id"),
        )

    one = [(1, "A", "alpha " * 300, "new"), (4, "D", "delta", "new")]
    two = [(1, "A", "alpha two", "changed"), (4, "D, new title", "delta", "retitled")]
    wanted = [one, two, [*two, (9, "F", "alpha " * 300, "new")]]  # a content given up is free from the next batch on
    states = []
    for number, data in enumerate(batches):
        for _ in range(2):  # every batch runs twice
            streams.ingest_batch(spark.createDataFrame(data, INCOMING), number, path, ["chunk_text"], buckets=4)
        docs, chunks, rejects = state()
        assert docs == wanted[number]
        long_one = [(0, 800), (1, 799), (2, 400)]
        assert [c for c in chunks if c[0] == 4] == [(4, 0, 5)]
        assert [c[0] for c in chunks if c[0] == 1] == ([1] * len(long_one) if number == 0 else [1])
        assert rejects == ([("c",)] if number == 0 else [("c",), ("e",)])
        states.append((docs, chunks, rejects))
    corpus.compact()
    assert state() == states[-1]
    corpus.compact()  # nothing new
    assert state() == states[-1] and corpus.store.manifest().select("part").distinct().count() == 1
    streams.ingest_batch(spark.createDataFrame([(12, 1, "FILE", "f", "F", "alpha three")], INCOMING), 3, path, ["chunk_text"], buckets=4)
    assert [r for r in state()[1] if r[0] == 9] == [(9, 0, 11)]


def test_ingest_reads_touched_buckets_only(spark, tmp_path):
    path = str(tmp_path / "table")
    docs = [(i, 1, "FILE", f"u{i}", f"T{i}", f"text {i}") for i in range(40)]
    streams.ingest_batch(spark.createDataFrame(docs, INCOMING), 0, path, ["chunk_text"], buckets=8)
    store = streams.Corpus(spark, path, 8).store
    some = store.read("documents", buckets=[3])
    filters = [line for line in some._jdf.queryExecution().toString().splitlines() if "PartitionFilters" in line and "content_hash#" in line]
    assert filters and all("(bucket#" in f and "= 3)" in f for f in filters) and 0 < some.count() < 40


def test_half_a_commit_is_not_seen(spark, tmp_path):
    path = str(tmp_path / "table")
    streams.ingest_batch(spark.createDataFrame([(1, 1, "FILE", "a", "A", "alpha")], INCOMING), 0, path, ["chunk_text"], buckets=2)
    streams.ingest_batch(spark.createDataFrame([(2, 1, "FILE", "a", "A", "beta")], INCOMING), 1, path, ["chunk_text"], buckets=2)
    shutil.rmtree(f"{path}/manifest/version=3")  # as if the second batch had stopped before its manifest
    corpus = streams.Corpus(spark, path, 2)
    assert rows(corpus.documents(), "content") == [("alpha",)] and rows(corpus.chunks(), "content") == [("alpha",)]
    streams.ingest_batch(spark.createDataFrame([(2, 1, "FILE", "a", "A", "beta")], INCOMING), 1, path, ["chunk_text"], buckets=2)
    assert rows(corpus.documents(), "content") == [("beta",)] and rows(corpus.chunks(), "content") == [("beta",)]
