"""Queries over raw records, manifests, variants of claims, articles in several shapes, and checks of raw tables."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from lodestrata.functions.text import split_name, unit_interval
from lodestrata.operators import argument, records
from lodestrata.plans.corpus import _HASH, _SPLIT
from lodestrata.plans.roles import JUDGMENTS, judgments, table
from lodestrata.storage import stored


def manifest_joined(spark, d):
    """A manifest of document ids as numbers, joined one to one with the documents under their ids as text."""
    docs = table(spark, d, "documents")
    manifest = docs.select("doc_id", F.concat(F.lit("m"), F.col("doc_id") % 10).alias("part"))
    raw = docs.select(F.col("doc_id").cast("string").alias("raw_id"), "lang", "n_chars")
    return records.one_to_one(manifest, raw, "doc_id", "raw_id").select("doc_id", "part", "lang", "n_chars")


def composite_joined(spark, d):
    """Order lines with orders by the key, and with parts by an expression of two columns."""
    lines = table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", F.concat_ws("-", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("locator"))
    named = lines.select(F.col("l_orderkey").alias("k"), F.col("l_linenumber").alias("n"), "locator")
    both = lines.drop("locator").join(named, (F.col("l_orderkey") == F.col("k")) & (F.col("l_linenumber") == F.col("n")))
    orders = table(spark, d, "orders").select(F.col("o_orderkey").cast("string").alias("ok"), "o_orderstatus")
    out = both.join(orders, F.col("l_orderkey").cast("string") == F.col("ok"))
    return out.groupBy("o_orderstatus").agg(F.count("*").alias("lines"), F.countDistinct("locator").alias("locators"), F.sum("l_partkey").alias("parts"))


def covered_pairs(spark, d):
    """Judged pairs with their claims and documents; none may be missing."""
    pairs = judgments(spark, d).select("claim_id", "doc_id", "grade")
    claims = table(spark, d, "benchmark").select(F.col("item_id").alias("claim_id"), F.length("text").alias("claim_chars"))
    docs = table(spark, d, "documents").select("doc_id", "n_chars")
    return records.covered(pairs, [(claims, "claim_id"), (docs, "doc_id")])


def candidate_texts(spark, d):
    """Judged documents with the text of their inputs, which cover a part of them, or else of the corpus."""
    docs = table(spark, d, "documents")
    inputs = docs.where("doc_id % 3 = 0").select("doc_id", F.reverse(F.substring("text", 1, 20)).alias("text"))
    corpus = docs.where("doc_id % 5 <> 1").select("doc_id", F.substring("text", 1, 20).alias("text"))
    return records.with_fallback(judgments(spark, d).select("doc_id", "claim_id"), inputs, corpus, "doc_id", "text")


def _claim_rows(spark, d):
    """Turns as claims of their conversation's number by ten, under two split groups."""
    return table(spark, d, "conversations").select((F.col("conv_id") % 40).alias("claim_id"), (F.col("conv_id") % 2).alias("split_group"), F.when(F.col("conv_id") % 2 == 0, "train").otherwise("test").alias("split"), F.concat(F.lit(" "), F.substring("text", 1, 2), F.lit("  x ")).alias("text"))


def claim_variants(spark, d):
    return records.claim_variants(_claim_rows(spark, d)).drop("text_hash")


def claim_table(spark, d):
    return records.claims(_claim_rows(spark, d)).drop("text_hash")


def leaked_columns(spark, d):
    tables = {n: table(spark, d, n) for n in ("documents", "labels", "conversations", "benchmark")}
    return records.forbidden_columns(tables, {"quality", "toxic", "label", "role"})


def run_summaries(spark, d):
    """Results of runs as JSON, some without a summary, with numbers as text or as numbers."""
    o = table(spark, d, "orders")
    k = F.col("o_orderkey")
    summary = F.to_json(F.struct(F.struct(k.alias("total_claims"), F.create_map(F.lit("SUPPORTED"), (k % 5).cast("string"), F.lit("REFUTED"), F.lit("2")).alias("evidence_states"), F.lit("7").alias("articles")).alias("summary")))
    result = F.when(k % 7 == 0, F.lit('{"other": 1}')).otherwise(summary)
    out = o.select(k.alias("run_id"), records.run_summary(result).alias("s"))
    return out.select("run_id", F.col("s.total_claims"), F.coalesce(F.try_element_at("s.evidence_states", F.lit("SUPPORTED")), F.lit(-1)).alias("supported"), F.size("s.evidence_states").alias("states"), F.size("s.gaps").alias("gaps"), F.col("s.articles"), F.col("s.evidence"))


def coerced_articles(spark, d):
    """Documents as JSON articles of four shapes: abstract, text, sections as a list, sections as a map."""
    docs = table(spark, d, "documents")
    k, t = F.col("doc_id"), F.substring("text", 1, 40)
    listed = F.array(F.struct(F.lit(" Methods").alias("name"), t.alias("text")), F.struct(F.lit("Blank").alias("name"), F.lit(" ").alias("text")))
    shape = (
        F.when(k % 4 == 0, F.to_json(F.struct(k.alias("article_id"), F.lit(" T ").alias("title"), t.alias("abstract"), F.col("lang"))))
        .when(k % 4 == 1, F.to_json(F.struct(k.alias("paper_id"), t.alias("text"), F.col("source"), F.col("lang"))))
        .when(k % 4 == 2, F.to_json(F.struct(F.lit("").alias("article_id"), k.alias("pmid"), listed.alias("sections"))))
        .otherwise(F.to_json(F.struct(F.create_map(F.lit("RESULTS "), t).alias("sections"), t.alias("abstract"))))
    )
    out = records.coerced_articles(docs.select("doc_id", shape.alias("record")))
    return out.select("doc_id", "article_id", "title", F.sha2("abstract", 256).alias("abstract_hash"), F.array_join(F.transform("sections", lambda s: s["section"]), ",").alias("sections"), F.array_join(F.array_sort(F.map_keys("metadata")), ",").alias("metadata"), "problem")


def json_key_types(spark, d):
    """Keys of event properties, to which a word, a list and a null have been added, by type."""
    odd = F.when(F.col("event_id") % 3 == 0, F.lit('{"a": "x", "b": [1]}')).when(F.col("event_id") % 3 == 1, F.lit('{"a": null, "c": true}')).otherwise(F.col("props"))
    out = records.key_types(table(spark, d, "events").select(odd.alias("props")), "props")
    return out.select("key", F.when(F.col("type").startswith("ARRAY"), "ARRAY").when(F.col("type") == "VOID", "NULL").otherwise(F.col("type")).alias("type"), "n")


def json_signatures(spark, d):
    odd = F.when(F.col("event_id") % 3 == 0, F.lit('{"b": "x", "a": [1]}')).when(F.col("event_id") % 7 == 1, F.lit("{}")).otherwise(F.col("props"))
    return records.key_signatures(table(spark, d, "events").select(odd.alias("props")), "props")


def _manifest(spark, d):
    """Documents as records of a manifest, in three splits."""
    k = F.col("doc_id")
    split = F.when(k % 10 == 0, "test").when(k % 10 == 1, "dev").otherwise("train")
    return table(spark, d, "documents").select(k.alias("position"), F.concat(F.lit("q:"), k.cast("string")).alias("query_id"), split.alias("split"), F.concat("source", F.lit(".json")).alias("path"), k.cast("string").alias("record_id"))


def manifest_selection(spark, d):
    rows = _manifest(spark, d)
    return records.selected_manifest(rows.where("split = 'dev'"), "dev", 30).select("position", "query_id", "path", "record_id")


def located_queries(spark, d):
    raw = table(spark, d, "documents").select(F.concat("source", F.lit(".json")).alias("path"), F.col("doc_id").cast("string").alias("record_id"), "lang")
    return records.located(records.selected_manifest(_manifest(spark, d).where("split = 'test'"), "test"), raw).select("query_id", "path", "record_id", "lang")


def query_provenance(spark, d):
    return records.provenance(records.selected_manifest(_manifest(spark, d).where("split = 'test'"), "test"))


def canonical_queries(spark, d):
    """Conversations as pools: a turn has the aspect of its role and that of its length's last digit; one aspect no turn has, and defects by id."""
    turns = table(spark, d, "conversations").withColumn("aspects", F.array(F.col("role"), F.concat(F.lit("n"), (F.length("text") % 3).cast("string"))))
    k = F.col("query_id")
    place = F.row_number().over(Window.partitionBy("conv_id").orderBy("turn")) - 1
    rows = turns.withColumn("i", place.cast("int"))
    pools = rows.groupBy(F.col("conv_id").alias("query_id")).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "text"))), lambda x: x["text"]).alias("candidates"), F.transform(F.array_sort(F.collect_list(F.struct("i", "role"))), lambda x: x["role"]).alias("types"), F.map_from_entries(F.collect_list(F.struct("i", "aspects"))).alias("reverse"))
    links = rows.select(F.col("conv_id").alias("query_id"), "i", F.explode("aspects").alias("a"))
    forward = links.groupBy("query_id", "a").agg(F.sort_array(F.collect_list("i")).alias("at")).groupBy("query_id").agg(F.map_from_entries(F.collect_list(F.struct("a", "at"))).alias("forward"))
    out = pools.join(forward, "query_id")
    none = F.create_map(F.lit("none"), F.array().cast("array<int>"))
    given = F.array_sort(F.map_keys("forward"))
    bent = out.select(
        "query_id",
        "candidates",
        F.when(k % 11 == 1, F.slice("types", 2, 100)).otherwise(F.col("types")).alias("types"),
        F.when(k % 13 == 2, F.array_append(given, "stray")).otherwise(F.array_append(given, "none")).alias("aspects"),
        F.when(k % 17 == 3, F.map_concat("forward", none, F.create_map(F.lit("extra"), F.array(F.lit(0))))).when(k % 19 == 4, F.map_concat(F.transform_values("forward", lambda _, v: F.transform(v, lambda i: i + 100)), none)).when(k % 13 == 2, F.col("forward")).otherwise(F.map_concat("forward", none)).alias("forward"),
        F.when(k % 7 == 5, F.map_filter("reverse", lambda i, _: i > 0)).otherwise(F.col("reverse")).alias("reverse"),
        F.when(k % 5 == 0, 1).when(k % 23 == 6, 0).alias("optimal"),
    )
    found = records.canonical_queries(bent)
    join = lambda c: F.array_join(F.array_sort(c), ",").alias(c)
    return found.select("query_id", "candidates", join("coverable"), join("unmapped"), "budget_source", "problem")


def contract_examples(spark, d):
    return records.first_records({"nation": (table(spark, d, "nation").select("n_nationkey", "n_name"), "n_nationkey"), "region": (table(spark, d, "region").select("r_regionkey", "r_name"), "r_regionkey"), "labels": (table(spark, d, "labels"), "doc_id")})


def raw_table_checks(spark, d):
    labels = table(spark, d, "labels").select("doc_id", F.when(F.col("doc_id") % 9 == 0, "3").when(F.col("doc_id") % 9 == 1, "1.5").when(F.col("doc_id") % 9 == 2, "x").otherwise(F.col("quality").cast("string")).alias("label"))
    turns = table(spark, d, "conversations").select("conv_id", F.when(F.col("turn") % 4 != 3, F.col("text")).alias("text"), F.col("turn").alias("label"))
    return records.raw_violations("labels", labels, ["doc_id", "label", "origin"], "label", [0, 1, 2], "doc_id").union(records.raw_violations("turns", turns, ["conv_id", "text"], "label", [0, 1, 2], "conv_id"))


def vector_checks(spark, d):
    e = table(spark, d, "embeddings")
    k = F.col("vec_id")
    bent = e.select(F.when(k % 50 == 7, F.lit(1).cast("long")).otherwise(k).alias("vec_id"), F.when(k % 40 == 1, F.slice("embedding", 1, 3)).when(k % 40 == 2, F.transform("embedding", lambda x: F.lit(float("nan")).cast("float"))).when(k % 40 == 3, F.transform("embedding", lambda x: F.lit(0).cast("float"))).otherwise(F.col("embedding")).alias("embedding"))
    dim = len(e.first()["embedding"])
    return records.vector_violations(bent.where("vec_id <> 5"), "vec_id", dim, e.count())


def stance_input_checks(spark, d):
    t = table(spark, d, "conversations")
    k = F.col("conv_id")
    rows = t.select(F.concat("conv_id", F.lit("-"), F.when(k % 21 == 4, 0).otherwise(F.col("turn"))).alias("input_id"), F.when(k % 9 == 1, "other").otherwise("sentence").alias("task"), F.when(k % 2 == 0, "gold").otherwise("retrieved").alias("kind"), F.lit("c").alias("claim"), F.when(k % 15 == 2, " ").otherwise(F.col("text")).alias("text"), F.when(k % 6 == 0, "support").when(k % 35 == 1, "refute").alias("gold"))
    return records.stance_input_violations(rows, ["sentence", "article"], ["gold", "retrieved"])


def component_splits(spark, d):
    """Conversations as papers of reviews: whole components go to test up to the nearest tenth, and a hash parts the rest."""
    rows = table(spark, d, "conversations").select("conv_id").distinct()
    edges = rows.select((F.col("conv_id") * 2).alias("a"), (F.floor(F.col("conv_id") / 3) * 2 + 1).cast("long").alias("b"))
    found, _ = stored(argument.components(edges).where("node % 2 = 0").select((F.col("node") / 2).cast("long").alias("conv_id"), "component"), "components")
    sizes = found.groupBy("component").agg(F.count("*").alias("n")).withColumn("h", F.sha2(F.concat(F.lit("42:"), F.col("component").cast("string")), 256))
    test = argument.nearest_cutoff(sizes, ["h", "component"], "n", found.count() // 10).select("component", F.lit("test").alias("chosen"))
    rest = split_name(unit_interval("42", F.col("component").cast("string")))
    out = found.join(test, "component", "left")
    return out.select("conv_id", F.coalesce("chosen", F.when(rest == "test", "train").otherwise(rest)).alias("split"))


QUERIES = [manifest_joined, composite_joined, covered_pairs, candidate_texts, claim_variants, claim_table, leaked_columns, run_summaries, coerced_articles, json_key_types, json_signatures, manifest_selection, located_queries, query_provenance, canonical_queries, contract_examples, raw_table_checks, vector_checks, stance_input_checks, component_splits]

_CV = """r AS (SELECT conv_id % 40 AS claim_id, conv_id % 2 AS split_group, CASE WHEN conv_id % 2 = 0 THEN 'train' ELSE 'test' END AS split, trim(regexp_replace(' ' || substr(text, 1, 2) || '  x ', '\\s+', ' ', 'g')) AS text FROM conversations),
v AS (SELECT *, count(*) AS occurrence_count FROM r GROUP BY ALL), w AS (SELECT *, row_number() OVER (PARTITION BY claim_id ORDER BY occurrence_count DESC, length(text) DESC, text, split_group, split) AS text_rank, count(*) OVER (PARTITION BY claim_id) AS text_variant_count FROM v)"""
_MAN = "man AS (SELECT doc_id AS position, 'q:' || doc_id AS query_id, CASE WHEN doc_id % 10 = 0 THEN 'test' WHEN doc_id % 10 = 1 THEN 'dev' ELSE 'train' END AS split, source || '.json' AS path, CAST(doc_id AS VARCHAR) AS record_id, lang FROM documents)"

ORACLE = {
    "manifest_joined": "SELECT doc_id, 'm' || doc_id % 10 AS part, lang, n_chars FROM documents",
    "composite_joined": "SELECT o_orderstatus, count(*) AS lines, count(DISTINCT l_orderkey || '-' || l_linenumber) AS locators, CAST(sum(l_partkey) AS BIGINT) AS parts FROM (SELECT a.* FROM lineitem a JOIN lineitem b USING (l_orderkey, l_linenumber)) JOIN orders ON l_orderkey = o_orderkey GROUP BY 1",
    "covered_pairs": f"WITH {JUDGMENTS} SELECT claim_id, j.doc_id, grade, CAST(length(b.text) AS INTEGER) AS claim_chars, n_chars FROM judgments j JOIN benchmark b ON item_id = claim_id JOIN documents d USING (doc_id)",
    "candidate_texts": f"WITH {JUDGMENTS} SELECT j.doc_id, claim_id, CASE WHEN j.doc_id % 3 = 0 THEN reverse(substr(text, 1, 20)) ELSE substr(text, 1, 20) END AS text FROM judgments j JOIN documents USING (doc_id) WHERE j.doc_id % 3 = 0 OR j.doc_id % 5 <> 1",
    "claim_variants": f"WITH {_CV} SELECT * FROM w",
    "claim_table": f"WITH {_CV} SELECT * EXCLUDE (text_rank) FROM w WHERE text_rank = 1",
    "leaked_columns": """SELECT 'labels' AS "table", column_name AS "column" FROM (DESCRIBE labels) WHERE column_name IN ('quality', 'toxic', 'label', 'role') UNION ALL SELECT 'conversations', column_name FROM (DESCRIBE conversations) WHERE column_name IN ('quality', 'toxic', 'label', 'role')
        UNION ALL SELECT 'documents', column_name FROM (DESCRIBE documents) WHERE column_name IN ('quality', 'toxic', 'label', 'role') UNION ALL SELECT 'benchmark', column_name FROM (DESCRIBE benchmark) WHERE column_name IN ('quality', 'toxic', 'label', 'role')""",
    "run_summaries": """SELECT o_orderkey AS run_id, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE o_orderkey END AS total_claims, CASE WHEN o_orderkey % 7 = 0 THEN -1 ELSE o_orderkey % 5 END AS supported, CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 2 END AS states, 0 AS gaps,
        CASE WHEN o_orderkey % 7 = 0 THEN 0 ELSE 7 END AS articles, 0 AS evidence FROM orders""",
    "coerced_articles": """WITH x AS (SELECT doc_id, trim(substr(text, 1, 40), ' ') AS t, doc_id % 4 AS k FROM documents)
        SELECT doc_id, CASE WHEN k < 3 THEN CAST(doc_id AS VARCHAR) END AS article_id, CASE WHEN k = 0 THEN 'T' ELSE '' END AS title, CASE WHEN k <> 2 AND t <> '' THEN sha256(t) END AS abstract_hash,
        CASE WHEN k = 2 AND t <> '' THEN 'methods' WHEN k = 3 AND t <> '' THEN 'results' ELSE '' END AS sections, CASE WHEN k = 0 THEN 'lang' WHEN k = 1 THEN 'lang,source' ELSE '' END AS metadata,
        CASE WHEN k = 3 THEN 'no id' WHEN k <> 0 AND t = '' THEN 'no text' END AS problem FROM x""",
    "json_key_types": """WITH o AS (SELECT CASE WHEN event_id % 3 = 0 THEN '{"a": "x", "b": [1]}' WHEN event_id % 3 = 1 THEN '{"a": null, "c": true}' ELSE props END AS p FROM events), k AS (SELECT p, unnest(json_keys(p)) AS key FROM o)
        SELECT key, CASE json_type(p, '$.' || key) WHEN 'UBIGINT' THEN 'BIGINT' WHEN 'VARCHAR' THEN 'STRING' ELSE json_type(p, '$.' || key) END AS type, count(*) AS n FROM k GROUP BY ALL""",
    "json_signatures": """WITH o AS (SELECT CASE WHEN event_id % 3 = 0 THEN '{"b": "x", "a": [1]}' WHEN event_id % 7 = 1 THEN '{}' ELSE props END AS p FROM events)
        SELECT array_to_string(list_sort(json_keys(p)), ',') AS signature, count(*) AS n FROM o GROUP BY 1 ORDER BY n DESC, signature LIMIT 10""",
    "manifest_selection": f"WITH {_MAN} SELECT position, query_id, path, record_id FROM man WHERE split = 'dev' ORDER BY position LIMIT 30",
    "located_queries": f"WITH {_MAN} SELECT query_id, path, record_id, lang FROM man WHERE split = 'test'",
    "query_provenance": f"WITH {_MAN} SELECT path, count(*) AS queries, CAST(sum(CAST('0x' || substr(sha256(query_id), 1, 8) AS BIGINT)) AS BIGINT) AS fingerprint FROM man WHERE split = 'test' GROUP BY 1",
    "canonical_queries": """WITH r AS (SELECT conv_id AS q, row_number() OVER (PARTITION BY conv_id ORDER BY turn) - 1 AS i, [role, 'n' || length(text) % 3] AS a FROM conversations),
        l AS (SELECT q, i, unnest(a) AS a FROM r), p AS (SELECT q, count(*) AS n FROM r GROUP BY 1),
        g AS (SELECT q, list_sort(list(DISTINCT a)) AS given, list_sort(list(DISTINCT a) FILTER (WHERE NOT (q % 7 = 5 AND i = 0))) AS mapped FROM l GROUP BY 1),
        x AS (SELECT q, n, CASE WHEN q % 13 = 2 THEN list_append(given, 'stray') ELSE list_append(given, 'none') END AS aspects, coalesce(mapped, []) AS mapped FROM p JOIN g USING (q))
        SELECT q AS query_id, n::INTEGER AS candidates, array_to_string(list_sort(list_filter(aspects, lambda v: list_contains(mapped, v))), ',') AS coverable, array_to_string(list_sort(list_filter(aspects, lambda v: NOT list_contains(mapped, v))), ',') AS unmapped,
          CASE WHEN len(mapped) = 0 THEN NULL WHEN q % 5 = 0 OR q % 23 = 6 THEN 'given' ELSE 'derived' END AS budget_source,
          CASE WHEN q % 11 = 1 THEN 'types' WHEN q % 13 = 2 AND q % 17 <> 3 AND q % 19 <> 4 THEN 'aspect without mapping' WHEN q % 13 = 2 THEN 'aspect without mapping' WHEN q % 17 = 3 THEN 'unknown aspect' WHEN q % 19 = 4 THEN 'sentence outside the pool'
               WHEN q % 7 = 5 THEN 'mappings disagree' WHEN q % 5 <> 0 AND q % 23 = 6 THEN 'budget' END AS problem FROM x""",
    "contract_examples": """SELECT 'nation' AS dataset, CAST(n_nationkey AS VARCHAR) AS key, '{"n_name":"' || n_name || '","n_nationkey":' || n_nationkey || '}' AS record FROM nation WHERE n_nationkey = (SELECT min(n_nationkey) FROM nation)
        UNION ALL SELECT 'region', CAST(r_regionkey AS VARCHAR), '{"r_name":"' || r_name || '","r_regionkey":' || r_regionkey || '}' FROM region WHERE r_regionkey = (SELECT min(r_regionkey) FROM region)
        UNION ALL SELECT 'labels', CAST(doc_id AS VARCHAR), '{"doc_id":' || doc_id || ',"quality":' || quality || ',"toxic":' || toxic || '}' FROM labels WHERE doc_id = (SELECT min(doc_id) FROM labels)""",
    "raw_table_checks": """SELECT 'labels_missing_origin' AS "check", 1::BIGINT AS violations UNION ALL SELECT 'labels_null_doc_id', 0 UNION ALL SELECT 'labels_null_label', count(*) FROM labels WHERE doc_id % 9 > 2 AND quality IS NULL
        UNION ALL SELECT 'labels_label', count(*) FROM labels WHERE doc_id % 9 < 3 UNION ALL SELECT 'labels_key', 0 UNION ALL SELECT 'turns_null_conv_id', 0 UNION ALL SELECT 'turns_null_text', count(*) FROM conversations WHERE turn % 4 = 3
        UNION ALL SELECT 'turns_label', count(*) FROM conversations WHERE turn > 2 UNION ALL SELECT 'turns_key', count(*) FROM (SELECT conv_id FROM conversations GROUP BY 1 HAVING count(*) > 1)""",
    "vector_checks": """WITH b AS (SELECT CASE WHEN vec_id % 50 = 7 THEN 1 ELSE vec_id END AS k, vec_id AS v FROM embeddings), c AS (SELECT * FROM b WHERE k <> 5)
        SELECT 'length' AS "check", count(*) AS violations FROM c WHERE v % 40 = 1 UNION ALL SELECT 'finite', count(*) FROM c WHERE v % 40 = 2 UNION ALL SELECT 'zero', count(*) FROM c WHERE v % 40 = 3
        UNION ALL SELECT 'key', count(*) FROM (SELECT k FROM c GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'rows', (SELECT count(*) FROM embeddings) - (SELECT count(*) FROM c)""",
    "stance_input_checks": """WITH r AS (SELECT conv_id AS k, conv_id || '-' || CASE WHEN conv_id % 21 = 4 THEN 0 ELSE turn END AS i, text FROM conversations)
        SELECT 'input_id' AS "check", count(*) AS violations FROM (SELECT i FROM r GROUP BY 1 HAVING count(*) > 1) UNION ALL SELECT 'task', count(*) FROM r WHERE k % 9 = 1 UNION ALL SELECT 'kind', 0
        UNION ALL SELECT 'texts', count(*) FROM r WHERE k % 15 = 2 OR trim(text, ' ') = '' UNION ALL SELECT 'gold', count(*) FROM r WHERE (k % 2 = 0) <> (k % 6 = 0 OR k % 35 = 1)""",
    "component_splits": f"""WITH c AS (SELECT DISTINCT conv_id, conv_id // 3 AS g FROM conversations), m AS (SELECT conv_id, least(2 * min(conv_id) OVER (PARTITION BY g), 2 * g + 1) AS component FROM c),
        s AS (SELECT component, count(*) AS n, sha256('42:' || component) AS h FROM m GROUP BY 1), t AS (SELECT count(*) // 10 AS t FROM m),
        u AS (SELECT *, sum(n) OVER (ORDER BY h, component) AS cum, row_number() OVER (ORDER BY h, component) AS k FROM s), b AS (SELECT CASE WHEN min(abs(cum - t)) < any_value(t) THEN arg_min(k, row(abs(cum - t), k)) ELSE 0 END AS best FROM u, t),
        x AS (SELECT component, k <= best AS chosen, {_HASH.format('component')} AS u FROM u, b)
        SELECT conv_id, CASE WHEN chosen THEN 'test' WHEN {_SPLIT.format('u')} = 'test' THEN 'train' ELSE {_SPLIT.format('u')} END AS split FROM m JOIN x USING (component)""",
}
