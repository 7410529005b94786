import numpy as np
from pyspark.sql import functions as F

from loomgraph.operators import agent, evaluate, search
from loomgraph.streaming import quota


def test_knn_ties_nulls_and_bad_vectors(spark):
    v = lambda *x: [float(a) for a in x]
    rows = spark.createDataFrame([(0, v(1, 0)), (1, v(2, 0)), (2, v(3, 0)), (3, v(0, 1)), (4, None), (5, v(0, 0)), (6, v(float("nan"), 1)), (7, v(1, 2, 3)), (None, v(1, 1))], "id bigint, v array<float>")
    got = [tuple(r) for r in search.knn(rows, rows.where("id = 0"), "id", "v", 2).select("query_id", "id", "similarity").collect()]
    assert sorted(got) == [(0, 1, 1.0), (0, 2, 1.0)]
    assert search.knn(rows, rows.where("false"), "id", "v", 2).count() == 0


def test_knn_equals_brute_force(spark):
    rng = np.random.default_rng(1)
    m = rng.normal(size=(200, 8))
    rows = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(m)], "id bigint, v array<double>").repartition(5)
    got = {(r["query_id"], r["rank"]): r["id"] for r in search.knn(rows, rows.where("id % 10 = 0"), "id", "v", 3).collect()}
    u = m / np.linalg.norm(m, axis=1, keepdims=True)
    s = u @ u.T
    np.fill_diagonal(s, -2)
    assert all(got[q, k + 1] == np.argsort(-s[q])[k] for q in range(0, 200, 10) for k in range(3))


def test_bm25_of_empty_texts(spark):
    docs = spark.createDataFrame([(1, "cat cat dog"), (2, None), (3, ""), (4, "dog")], "id int, t string")
    assert [r["id"] for r in search.bm25(docs, "id", "t", ["Cat", "cat"]).collect()] == [1]
    assert search.bm25(docs.where("false"), "id", "t", ["cat"]).count() == 0


def test_embedding_is_deterministic(spark):
    docs = spark.createDataFrame([("a b",), (None,)], "t string")
    got = search.embed(docs, "t", 16).collect()
    assert np.allclose(got[0]["vector"], search.embed_query("a b", 16)) and not any(got[1]["vector"])


def test_half_open_minute(spark):
    rows = spark.createDataFrame([(i, "k", us) for i, us in enumerate([0, 1, 59_999_999, 60_000_000])], "event_id bigint, k string, us bigint")
    got = {r["event_id"]: r["rpm"] for r in quota.usage(rows, "k", F.lit(1)).collect()}
    assert got == {0: 1, 1: 2, 2: 3, 3: 3}


def test_usage_reads_time_once_whatever_a_window_holds(spark):
    rng = np.random.default_rng(5)
    edge = quota.DAYS * quota.DAY
    times = [int(x) for x in (*rng.integers(edge - 60_000_000, edge + 60_000_000, 300), *rng.integers(-2 * quota.DAY, 2 * edge, 300), edge - 1, edge, edge - quota.DAY, 2 * edge - quota.DAY, -quota.DAY, 0, 0)]
    rows = spark.createDataFrame([(i, "k", us, i % 7) for i, us in enumerate(times)], "event_id bigint, k string, us bigint, n bigint")
    used = quota.usage(rows, "k", F.col("n"))
    plan = used._jdf.queryExecution().optimizedPlan().toString()
    assert "RangeFrame, unboundedpreceding" in plan and "RangeFrame, -" not in plan
    for r in used.collect():
        minute = [j for j, u in enumerate(times) if r["us"] - quota.MINUTE < u <= r["us"]]
        day = [j for j, u in enumerate(times) if r["us"] - quota.DAY < u <= r["us"]]
        assert (r["rpm"], r["tpm"], r["rpd"], r["oldest"]) == (len(minute), sum(max(j % 7, 1) for j in minute), len(day), min(times[j] for j in minute))
    assert used.count() == len(times)


def fold(events, rpm, tpm, rpd):
    kept, out = {}, {}
    for i, k, us, n in sorted(events, key=lambda e: (e[1], e[2], e[0])):
        mine = kept.setdefault(k, [])
        minute = [x for x in mine if us - x[0] < quota.MINUTE]
        day = [x for x in mine if us - x[0] < quota.DAY]
        out[i] = len(minute) < rpm and sum(x[1] for x in minute) + n <= tpm and len(day) < rpd
        if out[i]:
            mine.append((us, n))
    return out


def test_admissions_equal_a_fold(spark):
    rng = np.random.default_rng(3)
    events = [(i, "ab"[int(rng.integers(2))], int(rng.integers(0, 400_000_000)), int(rng.integers(1, 30))) for i in range(300)]
    rows = spark.createDataFrame(events, "event_id bigint, k string, us bigint, tokens bigint").repartition(3)
    got = {r["event_id"]: r["admitted"] for r in quota.admissions(rows, "k", 4, 60, 20).collect()}
    assert got == fold(events, 4, 60, 20)


def test_admission_stream_keeps_state(spark, tmp_path):
    events = [(i, "a", i * 10_000_000, 5) for i in range(12)]
    for part in (0, 1):
        spark.createDataFrame(events[part * 6 : part * 6 + 6], "event_id bigint, k string, us bigint, tokens bigint").coalesce(1).write.parquet(str(tmp_path / "in" / f"p{part}"))
    stream = spark.readStream.schema("event_id bigint, k string, us bigint, tokens bigint").option("maxFilesPerTrigger", 1).option("recursiveFileLookup", "true").parquet(str(tmp_path / "in"))
    q = quota.admission_stream(stream, "k", 2, 100, 100).writeStream.format("memory").queryName("admitted").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    got = {r["event_id"]: r["admitted"] for r in spark.table("admitted").collect()}
    assert got == fold(events, 2, 100, 100)


def test_judge(spark):
    rows = spark.createDataFrame([("uses `a.b` and `cc` and `dd` `ee` `ff`", "A.B then CC"), ("plain words here", "nothing"), (None, "x"), ("`zz`", None)], "truth string, answer string")
    got = [(r["matched"], r["is_correct"]) for r in evaluate.judge(rows, "truth", "answer").collect()]
    assert got == [(2, True), (0, False), (0, False), (0, False)]
    assert evaluate.summary(rows.withColumn("p", F.lit(True)).withColumn("l", F.lit(1.0)).where("false"), "p", "l").first()["total"] == 0


def test_select_items(spark):
    items = spark.createDataFrame([("Q1", "Upstream"), ("Q2", "downstream"), ("Q3", None)], "id string, category string")
    assert [r["id"] for r in evaluate.select_items(items, ["Q3", "Q1", "Q9"]).collect()] == ["Q3", "Q1"]
    assert [r["id"] for r in evaluate.select_items(items, None, "STREAM", 1).collect()] == ["Q1"]


def test_agent_replans_once_and_reports():
    calls = []

    def find(name):
        calls.append(name)
        return {"results": [{"name": "test_x", "file_path": "tests/a.py"}, {"name": "real", "file_path": "a.py"}]} if name != "bad" else {}

    plans = iter(['{"steps": [{"tool": "find", "args": {"name": "bad"}}]}', 'text ```json {"steps": [{"tool": "find", "args": {"name": "q"}}, {"tool": "find", "args": {"name": "$DISCOVERED_SYMBOL"}}, {"tool": "none"}]}```'])
    a = agent.Agent({"find": find}, planner=lambda q, bad: next(plans))
    answer = a.ask("where?")
    assert calls == ["bad", "q", "real"] and answer.startswith("- {") and "(negative) none found nothing" in answer
    assert agent.Agent({}).ask("x") == "No verified facts were found."
    assert agent.parse_plan("no json", "q")[0]["tool"] == "semantic_search"
