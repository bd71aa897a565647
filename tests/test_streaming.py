"""The chunk stream: order, repeats, restarts, documents that never finish."""

import pytest
from pyspark.sql import functions as F

from docloom.session import work_dir
from docloom.streaming import chunks as S


def deliver(spark, path, rows):
    """One file, so one trigger at one file a trigger."""
    spark.createDataFrame([(d, i, n, f"<html><body>{d}.{i}</body></html>") for d, i, n in rows], S.CHUNK_SCHEMA).coalesce(
        1).write.mode("append").parquet(path)


def upper(html):
    return html.upper().replace("BODY", "body")


class Stream:
    def __init__(self, spark, tmp_path):
        self.spark = spark
        self.p = {k: str(tmp_path / k) for k in ("in", "chunks", "progress", "done", "c1", "c2", "c3")}

    def run(self):
        src = S.read_chunk_stream(self.spark, self.p["in"], files_per_trigger=1)
        S.run_to_end(S.write_chunks(S.stream_chunks(src, upper), self.p["chunks"], self.p["c1"]), 120)
        arrived = S.read_chunk_stream(self.spark, self.p["chunks"], schema=S.TABLE_SCHEMA)
        S.run_to_end(S.write_progress(S.track_arrivals(arrived), self.p["progress"], self.p["c2"]), 120)
        originals = self.spark.range(100).selectExpr("id AS doc_id", "'o' AS original_html", "'hi' AS language", "'gemini' AS provider")
        done = S.track_done(S.read_progress_stream(self.spark, self.p["progress"]))
        S.run_to_end(S.write_done(done, self.p["chunks"], originals, self.p["done"], self.p["c3"]), 120)

    def table_rows(self):
        import glob

        return self.table().count() if glob.glob(self.p["chunks"] + "/slot=*/*.parquet") else 0

    def table(self):
        return self.spark.read.parquet(self.p["chunks"])

    def progress(self):
        return self.spark.read.schema(S.PROGRESS_SCHEMA).parquet(self.p["progress"])

    def done(self):
        return {r.doc_id: (r.done, r.total) for r in S.latest_progress(self.progress()).collect()}

    def events(self):
        return sorted((r.doc_id, r.part_no, r.part_total, r.original_html) for r in self.spark.read.parquet(self.p["done"]).collect())

    def documents(self):
        return {r.doc_id: r.html for r in S.finished_documents(self.table(), self.progress()).collect()}


@pytest.fixture
def stream(spark, tmp_path):
    return Stream(spark, tmp_path)


def test_any_order_repeats_and_restart(spark, stream):
    deliver(spark, stream.p["in"], [(1, 2, 3), (2, 0, 2)])
    deliver(spark, stream.p["in"], [(1, 0, 3), (1, 2, 3)])
    stream.run()
    assert stream.done() == {1: (2, 3), 2: (1, 2)} and stream.documents() == {}
    preview = {r.doc_id: r.html for r in S.partial_preview(stream.table()).collect()}
    assert preview[1].endswith("<body>1.01.2</body></html>")  # the gap is skipped

    deliver(spark, stream.p["in"], [(1, 1, 3), (3, 0, 1)])
    stream.run()
    assert stream.done() == {1: (3, 3), 2: (1, 2), 3: (1, 1)}
    docs = stream.documents()
    assert set(docs) == {1, 3} and docs[1].endswith("<body>1.01.11.2</body></html>")

    # a late repeat of a finished document neither opens it again nor changes it
    deliver(spark, stream.p["in"], [(1, 1, 3), (3, 0, 1)])
    stream.run()
    assert stream.done() == {1: (3, 3), 2: (1, 2), 3: (1, 1)} and stream.documents() == docs
    assert stream.events() == [(1, 0, 1, "o"), (3, 0, 1, "o")]  # each once, over all runs
    assert stream.table().count() == 8  # nothing is read twice across restarts


def test_long_document_is_tracked_under_many_keys(spark, stream, monkeypatch):
    monkeypatch.setattr(S, "BUCKET", 2)
    deliver(spark, stream.p["in"], [(1, i, 7) for i in range(6)])
    stream.run()
    assert stream.progress().select("bucket").distinct().count() == 3
    assert stream.done() == {1: (6, 7)}
    deliver(spark, stream.p["in"], [(1, 6, 7)])
    stream.run()
    assert stream.done() == {1: (7, 7)} and list(stream.documents()) == [1]


def test_repeated_chunk_takes_the_newest_body(spark):
    rows = [(1, 0, 1, "old", "ok", 1), (1, 0, 1, "new", "ok", 2)]
    table = spark.createDataFrame(rows, "doc_id long, chunk_index long, chunk_total long, html string, status string, t long")
    table = table.withColumn("received_at", F.timestamp_seconds("t"))
    assert [r.html for r in S.latest_chunks(table).collect()] == ["new"]


def test_done_events(spark):
    docs = spark.createDataFrame([(1, 0, 2, "h"), (1, 1, 2, "i")], "doc_id long, part_no long, part_total long, html string")
    originals = spark.createDataFrame([(1, "o", "hi", "gemini")], "doc_id long, original_html string, language string, provider string")
    rows = sorted(S.done_events(docs, originals).collect(), key=lambda r: r.part_no)
    assert [(r.type, r.html, r.original_html, r.language, r.provider) for r in rows] == [
        ("done", "h", "o", "hi", "gemini"), ("done", "i", None, "hi", "gemini")]


def test_a_document_of_many_chunks_gets_its_event(spark, stream):
    deliver(spark, stream.p["in"], [(1, i, 1500) for i in range(1500)])
    stream.run()
    assert stream.events() == [(1, 0, 2, "o"), (1, 1, 2, None)]


def test_old_arrivals_count_like_new_ones(spark, stream):
    """Files of a chunk table may come in any order of their times."""
    for trigger, (chunk, days) in enumerate([(0, 0), (1, -3), (2, 0), (3, -9)]):
        rows = spark.createDataFrame([(5, chunk, 4, "h", "ok", 1, 1)], "doc_id long, chunk_index long, chunk_total long, html string, status string, attempts int, done long")
        rows.withColumn("received_at", F.expr(f"current_timestamp() + INTERVAL {days} DAYS")).withColumn(
            "slot", S.slot_of()).coalesce(1).write.mode("append").partitionBy("slot").parquet(stream.p["chunks"])
        arrived = S.read_chunk_stream(spark, stream.p["chunks"], 1, S.TABLE_SCHEMA)
        S.run_to_end(S.write_progress(S.track_arrivals(arrived), stream.p["progress"], stream.p["c2"]), 120)
        assert stream.done() == {5: (trigger + 1, 4)}
    assert list(stream.documents()) == [5]


def test_indices_past_the_end_are_rejected(spark, stream):
    deliver(spark, stream.p["in"], [(1, 0, 3), (1, 1, 3), (1, 7, 3), (1, 90000, 3), (1, -1, 3), (2, 5, 3)])
    stream.run()
    rows = {r.doc_id: (r.done, r.total, r.rejected) for r in S.latest_progress(stream.progress()).collect()}
    assert rows == {1: (2, 3, 3), 2: (0, None, 1)} and stream.documents() == {} and stream.events() == []
    deliver(spark, stream.p["in"], [(1, 2, 3)])
    stream.run()
    assert stream.documents()[1].endswith("<body>1.01.11.2</body></html>") and stream.events() == [(1, 0, 1, "o")]


def test_abandoned_documents_are_reported(spark, stream):
    deliver(spark, stream.p["in"], [(1, 0, 2), (2, 0, 1)])

    def run():
        src = S.read_chunk_stream(spark, stream.p["in"], files_per_trigger=1)
        S.run_to_end(S.write_chunks(S.stream_chunks(src, upper), stream.p["chunks"], stream.p["c1"]), 120)
        arrived = S.track_arrivals(S.read_chunk_stream(spark, stream.p["chunks"], 1, S.TABLE_SCHEMA), abandon_after_ms=1)
        S.run_to_end(S.write_progress(arrived, stream.p["progress"], stream.p["c2"]), 120)

    run()
    deliver(spark, stream.p["in"], [(3, 0, 1)])
    run()
    assert {r.doc_id: r.abandoned for r in S.latest_progress(stream.progress()).collect()} == {1: True, 2: False, 3: False}


def test_an_abandoned_document_resumes(spark, stream):
    def run(*rows):
        if rows:
            deliver(spark, stream.p["in"], rows)
        src = S.read_chunk_stream(spark, stream.p["in"])
        S.run_to_end(S.write_chunks(S.stream_chunks(src, upper), stream.p["chunks"], stream.p["c1"]), 120)
        arrived = S.track_arrivals(S.read_chunk_stream(spark, stream.p["chunks"], schema=S.TABLE_SCHEMA), abandon_after_ms=1)
        S.run_to_end(S.write_progress(arrived, stream.p["progress"], stream.p["c2"]), 120)
        return {r.doc_id: (r.done, r.abandoned) for r in S.latest_progress(stream.progress()).collect()}

    run((1, 0, 3), (1, 1, 3))
    assert run((2, 0, 1)) == {1: (2, True), 2: (1, False)}
    assert run((1, 1, 3)) == {1: (2, False), 2: (1, False)}  # a repeat is a sign of life
    assert run((1, 2, 3)) == {1: (3, False), 2: (1, False)}
    assert list(stream.documents()) == [1, 2]


def test_a_trigger_writes_one_file_a_slot(spark, stream):
    deliver(spark, stream.p["in"], [(d, i, 3) for d in range(200) for i in range(3)])
    spark.read.parquet(stream.p["in"]).repartition(8).write.parquet(stream.p["in"] + "2")
    src = S.read_chunk_stream(spark, stream.p["in"] + "2")
    S.run_to_end(S.write_chunks(S.stream_chunks(src, upper), stream.p["chunks"], stream.p["c1"]), 120)
    files = stream.table().select(F.input_file_name().alias("f"), "slot").distinct()
    assert files.count() == files.select("slot").distinct().count() <= S.SLOTS


def test_a_stream_keeps_running_by_its_trigger(spark, stream):
    import time

    deliver(spark, stream.p["in"], [(1, 0, 2)])
    src = S.read_chunk_stream(spark, stream.p["in"])
    query = S.write_chunks(S.stream_chunks(src, upper), stream.p["chunks"], stream.p["c1"], {"processingTime": "200 milliseconds"})
    try:
        deliver(spark, stream.p["in"], [(1, 1, 2)])
        end = time.time() + 60
        while time.time() < end and (query.lastProgress is None or stream.table_rows() < 2):
            time.sleep(0.3)
        assert query.isActive and stream.table_rows() == 2
    finally:
        query.stop()


def test_the_session_keeps_its_own_state_store(spark, stream):
    name = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(name)
    deliver(spark, stream.p["in"], [(1, 0, 1)])
    stream.run()
    assert spark.conf.get(name) == before


def test_texts_are_paid_for_once_whatever_is_replayed(spark, tmp_path):
    import shutil

    from docloom.streaming.segments import write_translations

    log = tmp_path / "calls"
    log.touch()

    def fn(batch):
        with open(log, "a") as f:
            f.write("".join(t + "\n" for t in batch))
        if "bad" in batch:
            raise ValueError("no")
        return [t.upper() for t in batch]

    def run(out, checkpoint):
        src = spark.readStream.schema("id long, text string").option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
        S.run_to_end(write_translations(src, fn, str(tmp_path / "memory"), str(tmp_path / out), str(tmp_path / checkpoint), batch_size=1), 120)
        return sorted((r.id, r.text, r.translated) for r in spark.read.parquet(str(tmp_path / out)).collect())

    def deliver_texts(*rows):
        spark.createDataFrame(rows, "id long, text string").coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))

    deliver_texts((1, "a"), (2, "a"), (3, "b"))
    deliver_texts((4, "a"), (5, "c"), (6, "bad"))
    want = [(1, "a", "A"), (2, "a", "A"), (3, "b", "B"), (4, "a", "A"), (5, "c", "C"), (6, "bad", "bad")]
    assert run("out", "c1") == want
    assert sorted(log.read_text().split()) == ["a", "b", "bad", "c"]

    # the last trigger is replayed: its commit is lost, its answers are stored
    commits = sorted((tmp_path / "c1" / "commits").glob("[0-9]*"))
    shutil.copytree(tmp_path / "c1", tmp_path / "c2")
    (tmp_path / "c2" / "commits" / commits[-1].name).unlink()
    (tmp_path / "c2" / "commits" / f".{commits[-1].name}.crc").unlink(missing_ok=True)
    log.write_text("")
    assert run("out", "c2") == want and log.read_text().split() == ["bad"]  # only what failed before

    log.write_text("")
    assert run("other", "c3") == want and set(log.read_text().split()) == {"bad"}  # another stream, nothing known is asked


class FakeSession:
    """A session with a master and, perhaps, the cluster's shared folder."""

    def __init__(self, master, folder=None):
        self.sparkContext = self
        self.master, self.applicationId = master, "app"
        self.conf = {"spark.checkpoint.dir": folder} if folder else {}

    def getConf(self):
        return self.conf


def test_work_dir_follows_the_session(spark):
    assert work_dir(spark, "a") != work_dir(spark, "a")
    assert work_dir(FakeSession("yarn", "hdfs://x/y/"), "a").startswith("hdfs://x/y/docloom/a-")
    with pytest.raises(ValueError):
        work_dir(FakeSession("yarn"), "a")


def test_a_table_may_be_a_folder_of_files(spark, sf_dir, tmp_path):
    """the files of a table that is a folder have names of their own; another table's are left out."""
    from docloom.plans import QUERIES, load_all

    load_all()
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    docs.repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    docs.write.parquet(str(tmp_path / "documents_old.parquet"))
    got = QUERIES["stream_corrections"](spark, str(tmp_path))
    want = QUERIES["correction_entries"](spark, sf_dir)
    assert got.count() == docs.count()
    assert got.exceptAll(want).isEmpty() and want.exceptAll(got).isEmpty()
