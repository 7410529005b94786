"""Queries of retrieval, quotas, evaluation and agent operators, and their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomgraph.operators import agent, evaluate, search
from loomgraph.storage import current_rows, table
from loomgraph.streaming import quota

_TERMS = ["planner", "graph", "cache", "callers"]
_RPM, _TPM, _RPD = 3, 200, 40


def knn_cosine(spark, sf_dir):
    """The 4 nearest of each vector whose id is divisible by 100, among all vectors."""
    rows = table(spark, sf_dir, "embeddings")
    return search.knn(rows, rows.where("vec_id % 100 = 0"), "vec_id", "embedding", 4).select("query_id", "id", "similarity", "rank")


def bm25(spark, sf_dir):
    return search.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", _TERMS)


def hybrid_search(spark, sf_dir):
    """A vector's neighbours and a text query's documents, fused: rows of both are told by id."""
    vectors = table(spark, sf_dir, "embeddings")
    row = vectors.where("vec_id = 7").first()
    q = F.array(*[F.lit(x) for x in row["embedding"]]) if row else F.lit(None).cast("array<float>")
    dense = vectors.select(F.col("vec_id").alias("doc_id"), F.round(search.cosine(F.col("embedding"), q), 6).alias("score"))
    dense = dense.where("score is not null").orderBy(F.col("score").desc(), "doc_id").limit(20)
    return search.fuse(dense, search.bm25(table(spark, sf_dir, "documents"), "doc_id", "text", _TERMS, 20), "doc_id", 0.5, 10)


def snippet_top1(spark, sf_dir):
    chunks = current_rows(table(spark, sf_dir, "chunks").select("chunk_id", "node_id", "name", "chunk_type", "start_line", "ingest_seq"), "chunk_id", "ingest_seq")
    return search.snippet(chunks, "sync_row").select("node_id", "chunk_type", "match")


def class_methods(spark, sf_dir):
    """Methods of every class, in order of their lines."""
    chunks = current_rows(table(spark, sf_dir, "chunks").select("chunk_id", "node_id", "chunk_type", "ingest_seq"), "chunk_id", "ingest_seq")
    owner = F.regexp_extract("node_id", r"^(.*)\.[^.]*$", 1)
    methods = chunks.where("chunk_type = 'function'").select(owner.alias("class_id"), "node_id")
    classes = table(spark, sf_dir, "class_nodes").select(F.col("id").alias("class_id")).distinct()
    return methods.join(classes, "class_id").groupBy("class_id").agg(F.array_join(F.array_sort(F.collect_list(F.element_at(F.split("node_id", r"\."), -1))), ",").alias("methods"))


def _events(spark, sf_dir):
    return table(spark, sf_dir, "events").withColumn("us", quota.micros(F.col("ts"))).withColumn("tokens", F.length("props").cast("bigint"))


def _usage(spark, sf_dir):
    return quota.usage(_events(spark, sf_dir), "event_type", F.col("tokens"))


def rpm_window(spark, sf_dir):
    return _usage(spark, sf_dir).select("event_id", "rpm")


def tpm_window(spark, sf_dir):
    return _usage(spark, sf_dir).select("event_id", "tpm")


def rpd_window(spark, sf_dir):
    return _usage(spark, sf_dir).select("event_id", "rpd")


def capacity(spark, sf_dir):
    return _usage(spark, sf_dir).select("event_id", quota.capacity(_usage(spark, sf_dir), 10, 100, 100_000).alias("capacity"))


def wait_time(spark, sf_dir):
    return _usage(spark, sf_dir).select("event_id", quota.wait_seconds(2).alias("wait"))


def router_pick(spark, sf_dir):
    """For each user the type of event with the greatest capacity at its last use; ``click`` and ``view`` are preferred."""
    used = _usage(spark, sf_dir)
    rows = used.select("user_id", "event_type", "us", "event_id", quota.capacity(used, 10, 100, 100_000).alias("capacity"))
    last = quota.upsert_last(rows, ["user_id", "event_type"], "us", "event_id")
    return quota.pick(last.withColumn("preferred", F.col("event_type").isin("click", "view")), "user_id", "event_type", "preferred")


def admission_fold(spark, sf_dir):
    return quota.admissions(_events(spark, sf_dir), "event_type", _RPM, _TPM, _RPD).select("event_id", "event_type", "admitted")


def token_estimate(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", quota.token_estimate(F.col("text")).alias("tokens"))


def _judged(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    answers = docs.select((F.col("doc_id") + 1).alias("doc_id"), F.col("text").alias("answer"))
    return evaluate.judge(docs.join(answers, "doc_id"), "text", "answer")


def judge_fallback(spark, sf_dir):
    return _judged(spark, sf_dir).select("doc_id", "matched", F.size("keywords").alias("keywords"), "is_correct")


def running_accuracy(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("passed", F.col("value") >= 50)
    shown = evaluate.running(rows, "event_id", "event_type", "passed", "value")
    # A little more than a tie, so that halves round one way whatever the order of a sum.
    return shown.select("event_id", F.round(F.col("accuracy") + 1e-9, 6).alias("accuracy"), F.round(F.col("mean_latency") + 1e-9, 6).alias("mean_latency"))


def eval_summary(spark, sf_dir):
    rows = table(spark, sf_dir, "events").withColumn("passed", F.col("value") >= 50)
    return evaluate.summary(rows, "passed", "value")


def report_rows(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").withColumn("passed", F.col("doc_id") % 3 == 0)
    return evaluate.report_rows(rows, "doc_id", "passed", F.translate("text", "\n\r", "  "))


def benchmark_select(spark, sf_dir):
    items = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("id"), F.col("source").alias("category"))
    return evaluate.select_items(items, None, "BANK")


def chat_prompt(spark, sf_dir):
    return agent.chat_prompt(table(spark, sf_dir, "events"), "user_id", "event_id", "event_type", "props")


def fact_dedupe(spark, sf_dir):
    return agent.distinct_facts(table(spark, sf_dir, "documents"), "text", "doc_id")


def discover_symbol(spark, sf_dir):
    rows = table(spark, sf_dir, "env_vars").where("env_key is not null")
    return agent.discovered_symbol(rows, "name", "env_key", "id", "file_path").select("name", "id")


def heuristic_eval(spark, sf_dir):
    return agent.heuristic_verdicts(table(spark, sf_dir, "documents"), "source", "text")


def plan_json(spark, sf_dir):
    """The JSON objects that agent runs hold."""
    rows = table(spark, sf_dir, "documents").where("source = 'agent_runs'").withColumn("json", agent.extract_json(F.col("text")))
    return rows.where("json <> ''").select("doc_id", F.length("json").alias("chars"))


_NAMES = (knn_cosine, bm25, hybrid_search, snippet_top1, class_methods, rpm_window, tpm_window, rpd_window, capacity, wait_time, router_pick, admission_fold, token_estimate, judge_fallback, running_accuracy, eval_summary, report_rows, benchmark_select, chat_prompt, fact_dedupe, discover_symbol, heuristic_eval, plan_json)
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {f.__name__: f for f in _NAMES}

_W = "ranged AS (SELECT event_id, user_id, event_type, epoch_us(ts) AS us, greatest(length(props), 1) AS tokens FROM events), used AS (SELECT *, count(*) OVER m AS rpm, sum(tokens) OVER m AS tpm, count(*) OVER d AS rpd, min(us) OVER m AS oldest FROM ranged WINDOW m AS (PARTITION BY event_type ORDER BY us RANGE BETWEEN 59999999 PRECEDING AND CURRENT ROW), d AS (PARTITION BY event_type ORDER BY us RANGE BETWEEN 86399999999 PRECEDING AND CURRENT ROW))"
_CAP = "CASE WHEN rpd >= 100000 THEN 0 ELSE round(0.6 * greatest(0, (10 - rpm) / 10.0::DOUBLE) + 0.4 * greatest(0, (100 - tpm) / 100.0::DOUBLE), 6) END"
_BM = "WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '\\p{L}+') AS w FROM documents), c AS (SELECT doc_id, len(w) AS len, " + ", ".join(f"len(list_filter(w, lambda x: lower(x) = '{t}')) AS tf{i}" for i, t in enumerate(_TERMS)) + " FROM w), st AS (SELECT count(*) AS n, avg(len) AS av, " + ", ".join(f"count(*) FILTER (tf{i} > 0) AS df{i}" for i in range(4)) + " FROM c), sc AS (SELECT doc_id, round(" + " + ".join(f"CASE WHEN tf{i} > 0 THEN ln(1 + (n - df{i} + 0.5) / (df{i} + 0.5)) * tf{i} * 2.2 / (tf{i} + 1.2 * (0.25 + 0.75 * len / av)) ELSE 0 END" for i in range(4)) + ", 6) AS score FROM c, st), bm AS (SELECT doc_id, score FROM sc WHERE score > 0)"
_CHUNKS = "cur AS (SELECT * FROM chunks WHERE chunk_id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY chunk_id ORDER BY ingest_seq DESC) = 1)"
_TRUTH = "WITH d AS (SELECT a.doc_id, coalesce(a.text, '') AS truth, lower(coalesce(b.text, '')) AS answer FROM documents a JOIN documents b ON a.doc_id = b.doc_id + 1), k AS (SELECT *, regexp_extract_all(truth, '`([a-zA-Z0-9_.:]+)`', 1) AS m FROM d), w AS (SELECT *, CASE WHEN len(m) > 0 THEN m ELSE regexp_extract_all(truth, '([A-Za-z0-9_]{4,})', 1) END AS kw FROM k), h AS (SELECT *, len(list_filter(kw, lambda x: contains(answer, lower(x)))) AS matched FROM w)"
SQL: dict[str, str] = {
    "knn_cosine": """WITH q AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE vec_id % 100 = 0), s AS (SELECT q.vec_id AS query_id, a.vec_id AS id, round(list_cosine_similarity(q.e, a.embedding::DOUBLE[]), 6) AS similarity FROM q, embeddings a WHERE q.vec_id <> a.vec_id)
      SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY similarity DESC, id) AS rank FROM s QUALIFY rank <= 4""",
    "bm25": _BM + " SELECT doc_id, score FROM bm",
    "hybrid_search": _BM + """, sp AS (SELECT * FROM bm ORDER BY score DESC, doc_id LIMIT 20), de AS (SELECT a.vec_id AS doc_id, round(list_cosine_similarity(a.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS score FROM embeddings a, embeddings q WHERE q.vec_id = 7 ORDER BY score DESC, doc_id LIMIT 20),
      d AS (SELECT doc_id, CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 1 END AS s FROM de), b AS (SELECT doc_id, CASE WHEN max(score) OVER () > min(score) OVER () THEN (score - min(score) OVER ()) / (max(score) OVER () - min(score) OVER ()) ELSE 1 END AS s FROM sp)
      SELECT coalesce(d.doc_id, b.doc_id) AS doc_id, round(0.5 * coalesce(d.s, 0) + 0.5 * coalesce(b.s, 0), 6) AS score FROM d FULL JOIN b ON d.doc_id = b.doc_id ORDER BY score DESC, doc_id LIMIT 10""",
    "snippet_top1": f"WITH {_CHUNKS}, m AS (SELECT node_id, chunk_type, CASE WHEN name = 'sync_row' THEN 1 WHEN node_id LIKE '%::sync\\_row' ESCAPE '\\' THEN 3 WHEN contains(lower(name), 'sync_row') THEN 4 END AS match FROM cur) SELECT * FROM m WHERE match IS NOT NULL ORDER BY match, node_id LIMIT 1",
    "class_methods": f"WITH {_CHUNKS}, m AS (SELECT regexp_extract(node_id, '^(.*)\\.[^.]*$', 1) AS class_id, regexp_extract(node_id, '([^.]*)$', 1) AS method FROM cur WHERE chunk_type = 'function') SELECT class_id, array_to_string(list_sort(list(method)), ',') AS methods FROM m WHERE class_id IN (SELECT id FROM class_nodes) GROUP BY class_id",
    "admission_fold": f"""WITH RECURSIVE ev AS (SELECT event_id, event_type AS k, epoch_us(ts) AS us, length(props) AS t, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS i FROM events WHERE event_type IS NOT NULL AND ts IS NOT NULL),
      fold(k, i, event_id, admitted, m, d) AS (SELECT DISTINCT k, 0::BIGINT, NULL::BIGINT, false, []::STRUCT(u BIGINT, t BIGINT)[], []::BIGINT[] FROM ev
        UNION ALL SELECT k, i, event_id, ok, CASE WHEN ok THEN list_append(m, {{'u': us, 't': greatest(t, 1)}}) ELSE m END, CASE WHEN ok THEN list_append(d, us) ELSE d END
        FROM (SELECT k, i, event_id, us, t, m, d, len(m) < {_RPM} AND coalesce(list_sum(list_transform(m, lambda x: x.t)), 0) + t <= {_TPM} AND len(d) < {_RPD} AS ok
          FROM (SELECT ev.k, ev.i, ev.event_id, ev.us, ev.t, list_filter(f.m, lambda x: ev.us - x.u < 60000000) AS m, list_filter(f.d, lambda x: ev.us - x < 86400000000) AS d FROM fold f JOIN ev ON ev.k = f.k AND ev.i = f.i + 1)))
      SELECT event_id, k AS event_type, admitted FROM fold WHERE i > 0""",
    "rpm_window": f"WITH {_W} SELECT event_id, rpm FROM used",
    "tpm_window": f"WITH {_W} SELECT event_id, tpm::BIGINT AS tpm FROM used",
    "rpd_window": f"WITH {_W} SELECT event_id, rpd FROM used",
    "capacity": f"WITH {_W} SELECT event_id, {_CAP} AS capacity FROM used",
    "wait_time": f"WITH {_W} SELECT event_id, CASE WHEN rpm < 2 THEN 0 ELSE round(greatest(0, (oldest + 60000000 - us) / 1e6 + 0.1), 6) END AS wait FROM used",
    "router_pick": f"WITH {_W}, l AS (SELECT * FROM used WHERE user_id IS NOT NULL AND event_type IS NOT NULL QUALIFY row_number() OVER (PARTITION BY user_id, event_type ORDER BY us DESC, event_id DESC) = 1), c AS (SELECT *, {_CAP} AS cap FROM l) SELECT user_id, event_type FROM c WHERE cap > 0 QUALIFY row_number() OVER (PARTITION BY user_id ORDER BY event_type IN ('click', 'view') DESC, cap DESC, event_type) = 1",
    "token_estimate": "SELECT doc_id, length(text) // 3 + 200 AS tokens FROM documents",
    "judge_fallback": _TRUTH + " SELECT doc_id, matched, len(kw) AS keywords, (len(kw) > 0 AND matched / len(kw) >= 0.4) OR matched >= 2 AS is_correct FROM h",
    "running_accuracy": "SELECT event_id, round(avg(CASE WHEN value >= 50 THEN 1.0::DOUBLE ELSE 0 END) OVER w + 1e-9, 6) AS accuracy, round(avg(value) OVER w + 1e-9, 6) AS mean_latency FROM events WINDOW w AS (PARTITION BY event_type ORDER BY event_id ROWS UNBOUNDED PRECEDING)",
    "eval_summary": "SELECT count(*) AS total, count(*) FILTER (value >= 50) AS passed, count(*) - count(*) FILTER (value >= 50) AS failed, round(100.0::DOUBLE * count(*) FILTER (value >= 50) / count(*), 4) AS accuracy, round(avg(value), 6) AS mean_latency FROM events",
    "report_rows": "WITH t AS (SELECT doc_id, replace(translate(coalesce(text, ''), chr(10) || chr(13), '  '), '|', '\\|') AS r FROM documents) SELECT doc_id, '| ' || doc_id || ' | ' || CASE WHEN doc_id % 3 = 0 THEN 'PASS' ELSE 'FAIL' END || ' | ' || CASE WHEN length(r) > 85 THEN substring(r, 1, 85) || '...' ELSE r END || ' |' AS line FROM t",
    "benchmark_select": "SELECT CAST(doc_id AS VARCHAR) AS id, source AS category FROM documents WHERE contains(lower(source), 'bank')",
    "chat_prompt": "SELECT user_id, string_agg(upper(event_type) || ': ' || coalesce(props, ''), chr(10) || chr(10) ORDER BY event_id) AS prompt FROM events GROUP BY user_id",
    "fact_dedupe": "SELECT text, min(doc_id) AS doc_id FROM documents WHERE trim(text, ' ') <> '' GROUP BY text",
    "discover_symbol": "SELECT name, id FROM env_vars WHERE env_key IS NOT NULL AND id IS NOT NULL QUALIFY row_number() OVER (PARTITION BY name ORDER BY coalesce(contains(file_path, 'test'), false), env_key) = 1",
    "heuristic_eval": "SELECT source, bool_or(NOT coalesce(trim(text, ' ') = '' OR lower(text) LIKE 'error%', true)) AS sufficient, count(*) FILTER (coalesce(trim(text, ' ') = '' OR lower(text) LIKE 'error%', true)) AS failed FROM documents GROUP BY source",
    "plan_json": "SELECT doc_id, length(j) AS chars FROM (SELECT doc_id, regexp_extract(regexp_replace(text, '```(json)?', '', 'g'), '(\\{.*\\})', 1, 's') AS j FROM documents WHERE source = 'agent_runs') WHERE j <> ''",
}
