"""Calls in flight, rates of engines over several tasks, split batches."""

import threading
import time
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from docloom.operators import review
from docloom.operators.policy import Pace, RetryPolicy, ask_batch, in_order
from docloom.operators.requests import plan_rates
from docloom.operators.translate import Engine, lanes_of, translate_by_engine, translate_chunks, translate_segments


def test_answers_come_in_order_and_calls_stay_within_the_window():
    now, most, lock = [0], [0], threading.Lock()

    def call(k):
        with lock:
            now[0] += 1
            most[0] = max(most[0], now[0])
        time.sleep(0.002 * (k % 5))
        with lock:
            now[0] -= 1
        return k * 2

    drawn = []

    def jobs():
        for k in range(200):
            drawn.append(k)
            yield k

    results = in_order(jobs(), call, 8)
    assert next(results) == 0 and len(drawn) <= 17
    assert list(results) == [2 * k for k in range(1, 200)] and most[0] == 8


def test_the_first_error_ends_it():
    seen = []

    def call(k):
        seen.append(k)
        time.sleep(0.01)
        if k == 3:
            raise ValueError("three")
        return k

    with pytest.raises(ValueError, match="three"):
        list(in_order(range(1000), call, 2))
    assert len(seen) < 20


def test_eight_in_flight_take_about_an_eighth():
    def call(_):
        time.sleep(0.05)

    def took(n):
        t = time.perf_counter()
        list(in_order(range(40), call, n))
        return time.perf_counter() - t

    assert took(8) < took(1) / 5


def test_slots_of_lanes_never_meet():
    """Simulated clock: calls of all lanes start in slots of their own, one gap apart at least."""
    starts = []
    for lane in range(5):
        at = [100.03 + 0.2 * lane]

        def sleep(seconds, at=at):
            at[0] += seconds

        pace = Pace(RetryPolicy(gap=0.5, sleep=sleep, clock=lambda at=at: at[0]), lane, 5)
        for _ in range(20):
            pace.wait()
            starts.append(at[0])
            at[0] += 0.9  # the call itself
    starts.sort()
    assert all(b - a > 0.49 for a, b in zip(starts, starts[1:]))


def test_lanes_follow_gap_and_latency():
    assert RetryPolicy().lanes(200) == 200
    assert RetryPolicy(gap=5).lanes(200) == 1
    assert RetryPolicy(gap=5, latency=40).lanes(200) == 8
    assert RetryPolicy(gap=5, latency=40, in_flight=4).lanes(200) == 2
    assert RetryPolicy(gap=5, latency=4000).lanes(16) == 16
    plan, total = lanes_of({"free": RetryPolicy(), "slow": RetryPolicy(gap=1, latency=3), "also": RetryPolicy()}, 10)
    assert plan == {"slow": (0, 3), "free": (3, 10), "also": (3, 10)} and total == 13


class Log:
    """Writes down when calls start, where the test can read it."""

    def __init__(self, path, latency=0.0):
        self.path, self.latency = str(path), latency

    def __call__(self, batch, *_):
        with open(self.path, "a") as f:
            f.write(f"{time.time()} {threading.get_ident()}\n")
        time.sleep(self.latency)
        return [t + "!" for t in batch]

    def starts(self):
        return sorted(float(x.split()[0]) for x in open(self.path))


def rows_of(spark, n, engines=("slow", "free")):
    return spark.range(n).selectExpr("concat('line ', id) AS text", "'hi' AS target_language").crossJoin(
        spark.createDataFrame([(e,) for e in engines], "llm_provider string"))


@pytest.mark.parametrize("partitions", [1, 3, 8])
def test_an_engine_keeps_its_rate_over_all_tasks(spark, tmp_path, partitions):
    gap, slow, free = 0.1, Log(tmp_path / "slow", 0.35), Log(tmp_path / "free", 0.01)
    engines = {"slow": Engine(slow, 5, RetryPolicy(gap=gap, latency=0.4)), "free": Engine(free, 5)}
    got = translate_by_engine(rows_of(spark, 90), engines, partitions=partitions).collect()
    assert len(got) == 180 and {r.status for r in got} == {"ok"} and all(r.translated == r.text + "!" for r in got)
    starts = slow.starts()
    assert len(starts) >= 18
    for window in (3, 6, 12):  # never more calls in a stretch of time than the rate allows
        assert all(b - a > (window - 1.5) * gap for a, b in zip(starts, starts[window:]))
    if partitions >= 4:  # and the rate is used: four tasks hide a latency of 0.4 s
        assert starts[-1] - starts[0] < 0.35 * len(starts) * 0.75
    assert free.starts()[-1] - free.starts()[0] < 3  # the others do not wait for it


def test_in_flight_inside_tasks_keeps_requests_and_rate(spark, tmp_path):
    df = rows_of(spark, 64, ["e"])

    def run(name, **policy):
        log = Log(tmp_path / name, 0.1)
        t = time.perf_counter()
        got = translate_by_engine(df, {"e": Engine(log, 4, RetryPolicy(**policy))}, partitions=1).collect()
        return [(r.text, r.translated, r.status, r.attempts) for r in got], time.perf_counter() - t, log.starts()

    one, slow, _ = run("one")
    eight, fast, _ = run("eight", in_flight=8)
    assert one == eight and fast < slow - 0.8
    paced, _, starts = run("paced", in_flight=8, gap=0.05)
    assert paced == one and all(b - a > 0.1 for a, b in zip(starts, starts[3:]))


def test_chunks_and_judges_share_the_rate(spark, tmp_path):
    policy = RetryPolicy(gap=0.05, latency=0.3)
    chunks = spark.range(24).selectExpr("id AS doc_id", "0L AS chunk_index", "concat('<body>', id, '</body>') AS html")
    log = Log(tmp_path / "chunks", 0.2)
    got = translate_chunks(chunks, lambda html: log([html])[0], policy, spread=False, partitions=4).collect()
    assert {r.status for r in got} == {"ok"} and len(got) == 24
    starts = log.starts()
    assert all(b - a > 1.5 * 0.05 for a, b in zip(starts, starts[3:]))
    pairs = spark.range(24).selectExpr("id AS original_text", "'x' AS translated_text", "'hi' AS target_language")
    log = Log(tmp_path / "judges", 0.2)
    got = review.evaluate(pairs, lambda o, t, x: log(["{}"])[0], policy=policy, partitions=4).collect()
    assert len(got) == 24
    starts = log.starts()
    assert len(starts) == 24 and all(b - a > 1.5 * 0.05 for a, b in zip(starts, starts[3:]))


def test_requests_go_on_over_the_ends_of_row_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        df = rows_of(spark, 53, ["a", "b"])
        engines = {"a": Engine(lambda b, _: [str(len(b))] * len(b), 10), "b": Engine(lambda b, _: [str(len(b))] * len(b), 4)}
        got = translate_by_engine(df, engines, partitions=1).groupBy("llm_provider", "translated").count().collect()
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "10000")
    assert {(r.llm_provider, r.translated): r["count"] for r in got} == {("a", "10"): 50, ("a", "3"): 3, ("b", "4"): 52, ("b", "1"): 1}


def test_planned_requests_are_those_that_are_made(spark, tmp_path):
    counts = defaultdict(lambda: Log(tmp_path / f"log{len(list(tmp_path.iterdir()))}"))
    policies = {"a": RetryPolicy(gap=0.001, latency=0.003), "b": RetryPolicy()}
    logs = {}
    for name in policies:
        (tmp_path / name).touch()
        logs[name] = counts[name] = Log(tmp_path / name)
    engines = {name: Engine(logs[name], 7, p) for name, p in policies.items()}
    df = rows_of(spark, 200, ["a", "b"])
    plan = {r.llm_provider: r for r in plan_rates(df, engines, partitions=5).collect()}
    translate_by_engine(df, engines, partitions=5).collect()
    assert {n: r.requests for n, r in plan.items()} == {n: len(log.starts()) for n, log in logs.items()}
    assert plan["a"].lanes == 3 and plan["b"].lanes == 5 and plan["b"].paced_s == 0
    assert plan["a"].paced_s == pytest.approx((plan["a"].requests - 1) * 0.001)


def bad(batch):
    bad.calls += 1
    if any("bad" in t for t in batch):
        raise ValueError("no")
    return [t + "!" for t in batch]


def test_one_bad_text_keeps_one_original():
    texts = [f"t{k}" for k in range(25)]
    texts[13] = "bad"
    bad.calls = 0
    outs, stats, tries = ask_batch(bad, RetryPolicy(split_calls=20), texts)
    assert outs == [t if t == "bad" else t + "!" for t in texts]
    assert stats == ["kept" if t == "bad" else "ok" for t in texts]
    assert bad.calls <= 11 and max(tries) == tries[13]
    bad.calls = 0
    outs, stats, _ = ask_batch(bad, RetryPolicy(split_calls=3), texts)
    assert bad.calls == 4 and 1 < stats.count("kept") < 25
    assert all(o == (t + "!" if s == "ok" else t) for o, s, t in zip(outs, stats, texts))
    bad.calls = 0
    assert set(ask_batch(bad, RetryPolicy(), texts)[1]) == {"kept"} and bad.calls == 1


def test_split_batches_that_lose_lines():
    def loses(batch):
        return [t for t in batch if t != "gone"]

    outs, stats, _ = ask_batch(loses, RetryPolicy(split_calls=50), ["a", "gone", "b", "c", "gone"])
    assert outs == ["a", "gone", "b", "c", "gone"] and stats == ["ok", "misaligned", "ok", "ok", "misaligned"]


def test_split_batches_on_spark(spark):
    df = spark.range(100).select(F.concat(F.when(F.col("id") == 41, "bad ").otherwise("line "), F.col("id").cast("string")).alias("text"))

    def fn(batch):
        if any(t.startswith("bad") for t in batch):
            raise ValueError("no")
        return [t + "!" for t in batch]

    got = translate_segments(df, fn, RetryPolicy(split_calls=12, in_flight=3), partitions=2).collect()
    assert [r.text for r in got if r.status != "ok"] == ["bad 41"] and len(got) == 100


def test_equal_pairs_that_are_a_third_of_all_rows(spark):
    df = spark.range(3000).selectExpr("id", "if(id % 3 = 0, 'same', cast(id AS string)) AS original_text", "'t' AS translated_text", "'hi' AS target_language")
    got = review.evaluate(df, lambda o, t, x: o + t, keep=("id",)).collect()
    assert len(got) == 3000 and all(r.raw == r.original_text + "t" for r in got)


def test_a_request_of_one_text_costs_no_work_on_frames(spark):
    """40,000 requests of one text took over 20 s of a task, nearly all of it in pandas."""
    segs = spark.range(40_000).selectExpr("concat('line ', id) AS text").localCheckpoint()
    t = time.perf_counter()
    got = translate_segments(segs, lambda b: [x + "!" for x in b], batch_size=1, partitions=1).where(
        "status = 'ok' AND translated = concat(text, '!') AND attempts = 1").count()
    assert got == 40_000 and time.perf_counter() - t < 10


def test_a_text_is_sorted_and_sent_once(spark):
    """a task of an engine with a gap sorts all its rows, each text of them once."""
    engines = {"a": Engine(lambda b, _: list(b), 5, RetryPolicy(gap=0.001))}
    text = translate_by_engine(rows_of(spark, 20, ["a"]), engines)._jdf.queryExecution().executedPlan().toString()
    assert "__plain" not in text and "__sent" not in text
    some = {"a": Engine(lambda b, _: list(b), 5, mask=True), "b": Engine(lambda b, _: list(b), 5, symbols=True)}
    rows = spark.createDataFrame([("a", "hi", "GST x"), ("b", "hi", "GST \uf0fe")], "llm_provider string, target_language string, text string")
    sent = {r.llm_provider: r.translated for r in translate_by_engine(rows, some).collect()}
    assert sent["a"] == "GST x" and sent["b"] != "GST \uf0fe" and sent["b"].startswith("GST ")
