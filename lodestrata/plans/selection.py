"""Queries over text expressions, selection, profiles, sources and sinks, and batch twins of the streaming operators."""

from __future__ import annotations

from pyspark.sql import functions as F

from lodestrata.functions import text as tx
from lodestrata.operators import selection, sparse
from lodestrata.plans.roles import BM25, JUDGMENTS, judgments, table
from lodestrata.sources import readers, writers
from lodestrata.storage import new_path
from lodestrata.streaming import runs


def text_normalised(spark, d):
    t = F.col("text")
    docs = table(spark, d, "documents")
    return docs.select("doc_id", tx.squeezed(t).alias("squeezed"), tx.text_hash(t).alias("text_hash"), tx.duplicate_key(t).alias("duplicate_key"), tx.preview(t, 60).alias("preview"))


def text_nfkc(spark, d):
    docs = table(spark, d, "documents")
    return docs.select("doc_id", F.sha2(tx.nfkc(F.concat(F.lit("ﬁ "), "text")), 256).alias("h"))


def text_tokens(spark, d):
    terms = tx.tokens(F.col("text"))
    return table(spark, d, "documents").select("doc_id", F.size(terms).alias("n"), F.sha2(F.array_join(terms, " "), 256).alias("terms"))


def text_spans(spark, d):
    out = tx.exact_spans(F.col("text"), F.lit("th"))
    return table(spark, d, "conversations").select("conv_id", "turn", F.size(out).alias("n"), F.array_join(out.cast("array<string>"), ",").alias("starts"))


def identifiers(spark, d):
    raw = F.element_at(F.array(*map(F.lit, [" NaN ", "12.0", "-7.0", "1.50", "none", "A.0"])), (F.col("doc_id") % 6 + 1).cast("int"))
    return table(spark, d, "documents").select("doc_id", tx.clean_identifier(raw).alias("identifier"), tx.short_id("claim_", F.col("source"), F.col("lang")).alias("claim_id"))


def evidence_eligibility(spark, d):
    rows = table(spark, d, "conversations")
    kind = F.when(F.col("turn") == 0, "title").otherwise("abstract")
    section = F.when(F.col("role") == "user", "abstract").otherwise("results")
    reason = F.coalesce(tx.exclusion_reason(kind, section, F.col("text")), F.lit("eligible"))
    return rows.groupBy(reason.alias("reason")).agg(F.count("*").alias("n"))


def runs_page(spark, d):
    events = table(spark, d, "events").select("event_id", "ts", "event_type")
    first = selection.page(events, "ts", "event_id", 20)
    last = first.orderBy("ts", "event_id").first()
    return selection.page(events, "ts", "event_id", 20, (last["ts"], last["event_id"])).select("event_id", "event_type")


def first_groups(spark, d):
    return selection.first_groups(table(spark, d, "conversations"), "conv_id", 7).select("conv_id", "turn")


def sampled_groups(spark, d):
    return selection.sampled_groups(table(spark, d, "conversations"), "conv_id", 9, 42).select("conv_id", "turn")


def batches(spark, d):
    return selection.batched(table(spark, d, "documents").select("source", "doc_id"), "source", "doc_id", 8)


def table_profile(spark, d):
    return selection.profile(table(spark, d, "orders").drop("o_orderdate"))


def json_profile(spark, d):
    return selection.json_keys(table(spark, d, "events"), "props")


def cache_state(spark, d):
    rows = judgments(spark, d)
    return selection.cache_state(rows, "claim_id", rows.where("doc_id % 3 < 2"), "doc_id")


def split_overlaps(spark, d):
    out = selection.overlaps(table(spark, d, "documents"), "lang", "source")
    return out.select("lang", F.array_join("splits", ",").alias("splits"))


def range_scan(spark, d):
    return readers.key_range(table(spark, d, "documents"), "doc_id", 100, 200, "doc_id", "n_chars")


def trec_round_trip(spark, d):
    """A run written as TREC lines and read back."""
    hits = sparse.search(table(spark, d, "documents"), table(spark, d, "benchmark"), 5)
    path = new_path(spark, "trec")
    writers.write_trec(hits, path, "bm25", "item_id", "doc_id", 8)
    run = readers.trec_run(spark, path)
    return run.select("query", "document", "rank", F.round("score", 6).alias("score"), "run")


def json_round_trip(spark, d):
    path = new_path(spark, "json")
    writers.write_json_lines(table(spark, d, "benchmark"), path)
    return readers.json_by_name(spark, [path], "item_id long, text string")


def parquet_round_trip(spark, d):
    """Two tables with different columns, written by language and read as one."""
    docs = table(spark, d, "documents")
    path = new_path(spark, "parquet")
    writers.write_parquet(docs.where("lang = 'en'").select("doc_id", "n_chars"), f"{path}/a", ["doc_id"])
    writers.write_parquet(docs.where("lang <> 'en'").select("doc_id", "source"), f"{path}/b", ["doc_id"])
    return readers.parquet_by_name(spark, f"{path}/a", f"{path}/b").select("doc_id", "n_chars", "source")


def event_windows(spark, d):
    out = runs.windowed(table(spark, d, "events"))
    return out.select(F.unix_timestamp("start").alias("start"), "event_type", "n", F.round("value", 4).alias("value"))


def event_sessions(spark, d):
    out = runs.sessions(table(spark, d, "events"))
    return out.groupBy("user_id").agg(F.count("*").alias("sessions"), F.max("n").alias("longest"))


def latest_state(spark, d):
    return runs.latest_state(table(spark, d, "events")).select("user_id", "state")


QUERIES = [text_normalised, text_nfkc, text_tokens, text_spans, identifiers, evidence_eligibility, runs_page, first_groups, sampled_groups, batches, table_profile, json_profile, cache_state, split_overlaps, range_scan, trec_round_trip, json_round_trip, parquet_round_trip, event_windows, event_sessions, latest_state]

_SQ = "trim(regexp_replace(text, '\\s+', ' ', 'g'))"
_TOK = r"regexp_extract_all(lower(text), '[\p{L}\p{M}\p{N}_]+(?:[-/][\p{L}\p{M}\p{N}_]+)*')"
_PROFILE = " UNION ALL ".join(f"SELECT '{c}' AS \"column\", count(*) FILTER (WHERE {c} IS NULL) AS nulls, count(DISTINCT {c}) AS \"distinct\" FROM orders" for c in ("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderpriority"))

ORACLE = {
    "text_normalised": f"""WITH s AS (SELECT doc_id, {_SQ} AS t FROM documents) SELECT doc_id, t AS squeezed, substr(sha256(t), 1, 16) AS text_hash, regexp_replace(lower(t), '[.?!]+$', '') AS duplicate_key,
        CASE WHEN length(t) <= 60 THEN t ELSE substr(t, 1, 59) || '…' END AS preview FROM s""",
    "text_nfkc": "SELECT doc_id, sha256('fi ' || text) AS h FROM documents",
    "text_tokens": f"SELECT doc_id, CAST(len({_TOK}) AS INTEGER) AS n, sha256(array_to_string({_TOK}, ' ')) AS terms FROM documents",
    "text_spans": """WITH p AS (SELECT conv_id, turn, list_filter(range(0, length(text)), lambda i: substr(text, CAST(i + 1 AS BIGINT), 2) = 'th') AS s FROM conversations)
        SELECT conv_id, turn, CAST(len(s) AS INTEGER) AS n, array_to_string(s, ',') AS starts FROM p""",
    "identifiers": """SELECT doc_id, (['', '12', '-7', '1.50', '', 'A.0'])[doc_id % 6 + 1] AS identifier, 'claim_' || substr(sha256(source || chr(0) || lang), 1, 24) AS claim_id FROM documents""",
    "evidence_eligibility": """SELECT CASE WHEN turn = 0 THEN 'title_sentence' WHEN trim(text) = '' THEN 'empty_sentence'
        WHEN role <> 'user' AND NOT regexp_matches(text, '[.!?]["''’”\\)\\]]*\\s*$') THEN 'unterminated_structured_section_fragment' ELSE 'eligible' END AS reason, count(*) AS n FROM conversations GROUP BY 1""",
    "runs_page": "SELECT event_id, event_type FROM events ORDER BY ts DESC, event_id DESC LIMIT 20 OFFSET 20",
    "first_groups": "SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT DISTINCT conv_id FROM conversations ORDER BY 1 LIMIT 7)",
    "sampled_groups": "SELECT conv_id, turn FROM conversations WHERE conv_id IN (SELECT conv_id FROM (SELECT DISTINCT conv_id FROM conversations) ORDER BY sha256('42:' || conv_id), conv_id LIMIT 9)",
    "batches": "SELECT source, doc_id, (row_number() OVER (PARTITION BY source ORDER BY doc_id) - 1) // 8 AS batch FROM documents",
    "table_profile": _PROFILE,
    "json_profile": "SELECT key, count(*) AS n FROM (SELECT unnest(json_keys(props)) AS key FROM events) GROUP BY 1",
    "cache_state": f"""WITH {JUDGMENTS}, g AS (SELECT claim_id, count(*) AS total, count(*) FILTER (WHERE doc_id % 3 < 2) AS cached FROM judgments GROUP BY 1)
        SELECT *, CASE WHEN cached = total THEN 'complete' WHEN cached > 0 THEN 'incomplete' ELSE 'uncached' END AS state FROM g""",
    "split_overlaps": "SELECT lang, string_agg(DISTINCT source, ',' ORDER BY source) AS splits FROM documents GROUP BY 1 HAVING count(DISTINCT source) > 1",
    "range_scan": "SELECT doc_id, n_chars FROM documents WHERE doc_id >= 100 AND doc_id < 200",
    "trec_round_trip": f"""WITH {BM25}, r AS (SELECT *, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS rank FROM bm25)
        SELECT CAST(item_id AS VARCHAR) AS query, CAST(doc_id AS VARCHAR) AS document, rank, round(round(score, 8), 6) AS score, 'bm25' AS run FROM r WHERE rank <= 5""",
    "json_round_trip": "SELECT item_id, text FROM benchmark",
    "parquet_round_trip": "SELECT doc_id, CASE WHEN lang = 'en' THEN n_chars END AS n_chars, CASE WHEN lang <> 'en' THEN source END AS source FROM documents",
    "event_windows": "SELECT CAST(epoch(date_trunc('hour', ts)) AS BIGINT) AS start, event_type, count(*) AS n, round(sum(value), 4) AS value FROM events GROUP BY ALL",
    "event_sessions": """WITH l AS (SELECT user_id, ts, event_id, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS new FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)),
        s AS (SELECT user_id, sum(new) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS k FROM l), c AS (SELECT user_id, k, count(*) AS n FROM s GROUP BY ALL) SELECT user_id, count(*) AS sessions, max(n) AS longest FROM c GROUP BY 1""",
    "latest_state": "SELECT user_id, event_type AS state FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS k FROM events) WHERE k = 1",
}
