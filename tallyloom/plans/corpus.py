"""Curation and retrieval queries over the given tables and the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import functions as F

from tallyloom.functions import text as tx
from tallyloom.operators import curation, retrieval
from tallyloom.session import spread, table

SEED = 7


def docs(spark, sf):
    return spread(table(spark, sf, "documents"))


def layers(spark, sf):
    bench = table(spark, sf, "benchmark")
    return {"id": bench.where("item_id % 2 = 0"), "ood": bench.where("item_id % 2 = 1"), "empty": bench.where("item_id < 0")}


_WORDS = "regexp_extract_all(lower(text), '[\\p{L}\\p{N}]+')"
_GRAMS = "unnest(list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) || CASE WHEN len(w) IN (1, 2) THEN [array_to_string(w, ' ')] ELSE [] END)"
_SETS = f"""ds AS (SELECT DISTINCT doc_id, {_GRAMS} AS s FROM (SELECT doc_id, {_WORDS} AS w FROM documents)),
dn AS (SELECT doc_id, count(*) AS n FROM ds GROUP BY 1),
bs AS (SELECT DISTINCT item_id, {_GRAMS} AS s FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)),
bn AS (SELECT item_id, count(*) AS n FROM bs GROUP BY 1)"""
_DD = """dd AS (SELECT x.doc_id, k / (a.n + b.n - k) AS j FROM (SELECT a.doc_id, b.doc_id AS other, CAST(count(*) AS DOUBLE) AS k FROM ds a JOIN ds b ON a.s = b.s AND a.doc_id > b.doc_id GROUP BY 1, 2) x
  JOIN dn a ON a.doc_id = x.doc_id JOIN dn b ON b.doc_id = x.other)"""
_DB = """db AS (SELECT x.doc_id, x.item_id, CASE WHEN x.item_id % 2 = 0 THEN 'id' ELSE 'ood' END AS layer, k / (a.n + b.n - k) AS j FROM (SELECT doc_id, item_id, CAST(count(*) AS DOUBLE) AS k FROM ds JOIN bs USING (s) GROUP BY 1, 2) x
  JOIN dn a ON a.doc_id = x.doc_id JOIN bn b ON b.item_id = x.item_id)"""


def source_check(spark, sf):
    return curation.validate_source(docs(spark, sf), ["doc_id", "text", "lang"], 1000)


def origins(spark, sf):
    return curation.provenance_counts(docs(spark, sf).selectExpr("CASE WHEN source IN ('src0', 'src1') THEN NULL WHEN lang = 'en' THEN 'customer' ELSE 'teacher' END AS origin"))


_THINK = "CASE WHEN turn % 3 = 0 THEN '<think>plan ' || text || '</think>' || text WHEN turn % 3 = 1 THEN '<think>open ' || text ELSE text END"


def stripped(spark, sf):
    rows = table(spark, sf, "conversations").selectExpr("conv_id", "turn", f"{_THINK} AS text")
    return rows.select("conv_id", "turn", tx.strip_think(F.col("text")).alias("text"), tx.has_closed_think(F.col("text")).alias("closed"))


def think(spark, sf):
    return curation.think_report(table(spark, sf, "conversations").selectExpr(f"{_THINK} AS text"), "text")


def exact_dupes(spark, sf):
    return curation.exact_duplicates(docs(spark, sf), "doc_id", ["text"])


def near_dupes(spark, sf):
    return curation.near_duplicates(docs(spark, sf), "doc_id", "text", 0.8)


def lengths(spark, sf):
    return curation.length_format_filter(docs(spark, sf), "text", 200, 4000, r"[.!?]\s*$").select("doc_id")


def pii(spark, sf):
    return curation.pii_scan(docs(spark, sf), "text").drop("note")


def scrubbed(spark, sf):
    return curation.pii_scrub(docs(spark, sf), "text").select("doc_id", F.md5("text").alias("digest"))


_PII_UNION = " UNION ALL ".join(
    f"SELECT '{k}' AS kind, CAST(len(regexp_extract_all(text, '{p}')) AS BIGINT) AS n FROM documents" for k, p in tx.PII_PATTERNS.items())
_SCRUB = "text"
for _k, _p in tx.PII_PATTERNS.items():
    _SCRUB = f"regexp_replace({_SCRUB}, '{_p}', '[{_k.upper()}]', 'g')"


def _scores(spark, sf):
    return table(spark, sf, "labels").selectExpr("doc_id", "quality * 3 + (1 - toxic) * 2 AS score")


def quality(spark, sf):
    return curation.quality_filter(docs(spark, sf), _scores(spark, sf), "doc_id").select("doc_id")


def split(spark, sf):
    return curation.split_by_hash(docs(spark, sf), "doc_id", SEED).select("doc_id", "split")


_SPLIT = f"SELECT *, CASE WHEN CAST('0x' || substr(md5('{SEED}:' || doc_id), 1, 7) AS BIGINT) % 100 < 90 THEN 'train' ELSE 'val' END AS split FROM documents"


def clean_rows(spark, sf):
    clean, _ = curation.decontaminate(docs(spark, sf), "doc_id", "text", layers(spark, sf), "item_id", "text", 0.3)
    return clean.select("doc_id")


def decontamination(spark, sf):
    return curation.decontaminate(docs(spark, sf), "doc_id", "text", layers(spark, sf), "item_id", "text")[1]


def overlap(spark, sf):
    return curation.contamination_check(docs(spark, sf), "doc_id", "text", layers(spark, sf), "item_id", "text", 0.3)


def hash_clean(spark, sf):
    held = docs(spark, sf).where("source = 'src3'")
    return curation.content_hash_decontaminate(docs(spark, sf).where("source <> 'src3'"), held, "text").select("doc_id")


def audit(spark, sf):
    labelled = docs(spark, sf).join(table(spark, sf, "labels").select("doc_id", "quality"), "doc_id", "left")
    return curation.readiness_audit(labelled, "doc_id", "text", "quality", layers(spark, sf), "item_id", "text")


_PII_ANY = " + ".join(f"len(regexp_extract_all(text, '{p}'))" for p in tx.PII_PATTERNS.values())
_AUDIT = f"""WITH {_SETS}, {_DD}, {_DB}, f AS (SELECT count(*) AS n_rows, count(*) FILTER (trim(coalesce(text, '')) = '') AS n_empty, count(quality) AS n_verifiable, count(*) FILTER ({_PII_ANY} > 0) AS n_with_pii
  FROM documents LEFT JOIN labels USING (doc_id)), nd AS (SELECT count(DISTINCT doc_id) AS n_near_duplicates FROM dd WHERE j >= 0.9),
nc AS (SELECT count(*) AS n_contaminated FROM (SELECT DISTINCT layer, doc_id FROM db WHERE j >= 0.6)),
g AS (SELECT *, array_to_string(list_filter([CASE WHEN n_verifiable = 0 THEN 'no ground truth' END, CASE WHEN n_empty > 0 THEN 'empty rows' END, CASE WHEN n_near_duplicates > 0.1 * n_rows THEN 'near duplicates' END,
  CASE WHEN n_contaminated > 0 THEN 'contaminated' END, CASE WHEN n_with_pii > 0 THEN 'personal data' END], lambda x: x IS NOT NULL), '|') AS gaps FROM f, nd, nc)
SELECT *, CASE WHEN n_verifiable = 0 OR n_contaminated > 0 THEN 'not-ready' WHEN gaps <> '' THEN 'ready-with-caveats' ELSE 'ready' END AS verdict FROM g"""


def _boxes(spark, sf):
    images = table(spark, sf, "part").selectExpr("p_partkey AS id", "'img-' || p_partkey AS file_name")
    notes = table(spark, sf, "lineitem").selectExpr(
        "l_partkey + CASE WHEN l_suppkey % 40 = 0 THEN 10000000 ELSE 0 END AS image_id", "l_linenumber AS category_id",
        "array(0D, 0D, l_quantity - 2, l_quantity) AS bbox")
    files = images.selectExpr("CASE WHEN id % 25 = 4 THEN 'lost-' || id ELSE file_name END AS file_name")
    return images, notes, files


def detection_set(spark, sf):
    return curation.validate_detection_set(*_boxes(spark, sf))


_DETSET = """SELECT 'image file missing' AS problem, 'img-' || p_partkey AS name, 1::BIGINT AS n FROM part WHERE p_partkey % 25 = 4
UNION ALL SELECT 'annotation of unknown image', '' || (l_partkey + CASE WHEN l_suppkey % 40 = 0 THEN 10000000 ELSE 0 END), count(*) FROM lineitem
  WHERE l_partkey + CASE WHEN l_suppkey % 40 = 0 THEN 10000000 ELSE 0 END NOT IN (SELECT p_partkey FROM part) GROUP BY 2
UNION ALL SELECT 'degenerate box', 'img-' || l_partkey, count(*) FROM lineitem WHERE l_quantity <= 2 AND l_suppkey % 40 <> 0 AND l_partkey IN (SELECT p_partkey FROM part) GROUP BY 2"""


def classes(spark, sf):
    return curation.class_distribution(_boxes(spark, sf)[1])


# ---- retrieval ---------------------------------------------------------------------------

def lexical(spark, sf):
    bench = table(spark, sf, "benchmark")
    return retrieval.lexical_topk(bench, "item_id", "text", docs(spark, sf), "doc_id", "text", 5)


_LEXICAL = f"""WITH {_SETS}, {_DB} SELECT item_id AS query_id, doc_id AS id, j AS jaccard, row_number() OVER (PARTITION BY item_id ORDER BY j DESC, doc_id) AS rank FROM db QUALIFY rank <= 5"""


def recall(spark, sf):
    bench = table(spark, sf, "benchmark").withColumn("layer", F.when(F.col("item_id") % 2 == 0, "id").otherwise("ood"))
    return retrieval.recall_at_k(lexical(spark, sf), bench, "item_id", "layer", 0.3)


_RECALL = f"""WITH {_SETS}, {_DB}, b AS (SELECT item_id, CASE WHEN item_id % 2 = 0 THEN 'id' ELSE 'ood' END AS layer, coalesce((SELECT max(j) FROM db WHERE db.item_id = benchmark.item_id), 0) AS best FROM benchmark)
SELECT layer, count(*) AS n_items, count(*) FILTER (best >= 0.3) AS n_hits, CAST(count(*) FILTER (best >= 0.3) AS DOUBLE) / count(*) AS recall, list(best ORDER BY best)[CAST(floor(count(*) / 2) AS BIGINT) + 1] AS best_p50 FROM b GROUP BY 1"""


def vectors(spark, sf):
    emb = table(spark, sf, "embeddings")
    queries = emb.selectExpr("vec_id AS query_id", "embedding")
    return retrieval.vector_topk(queries, emb.selectExpr("vec_id AS id", "embedding"), 5, block=300).select("query_id", "id", "rank")


_VECTORS = """WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
SELECT a.vec_id AS query_id, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.v, b.v) DESC, b.vec_id) AS rank FROM e a CROSS JOIN e b QUALIFY rank <= 5"""


def _assembled(spark, sf):
    """Documents' labels as tickets, nearest embeddings' documents as passages."""
    emb = table(spark, sf, "embeddings")
    near = retrieval.vector_topk(emb.selectExpr("vec_id AS query_id", "embedding"), emb.selectExpr("vec_id AS id", "embedding"), 6)
    got = near.selectExpr("CASE WHEN query_id % 10 = 9 THEN -1 - query_id ELSE query_id END AS doc_id", "id", "rank")
    rows = docs(spark, sf).join(emb.selectExpr("vec_id AS doc_id"), "doc_id", "left_semi").selectExpr("doc_id", "'ticket ' || doc_id AS ticket", "lang AS answer")
    oracle = rows.selectExpr("doc_id", "doc_id AS id")
    picked = retrieval.choose_passages(got, oracle, rows, "doc_id", SEED)
    return retrieval.assemble_rows(rows, picked, docs(spark, sf), "doc_id", "ticket", "answer", "doc_id", "text")


def assembled(spark, sf):
    return _assembled(spark, sf).select("doc_id", F.md5("user").alias("user_digest"), "assistant", "has_oracle", "n_passages")


_ASSEMBLED = f"""WITH e AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
near AS (SELECT a.vec_id AS doc_id, b.vec_id AS id, row_number() OVER (PARTITION BY a.vec_id ORDER BY list_dot_product(a.v, b.v) DESC, b.vec_id) AS rank FROM e a CROSS JOIN e b QUALIFY rank <= 6),
t AS (SELECT *, doc_id = id AS is_oracle FROM near WHERE doc_id % 10 <> 9),
u AS (SELECT *, row_number() OVER (PARTITION BY doc_id, is_oracle ORDER BY rank) AS n FROM t WHERE NOT is_oracle OR CAST('0x' || substr(md5('{SEED}:' || doc_id), 1, 7) AS BIGINT) % 100 < 80),
p AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY md5('{SEED}:' || doc_id || ':' || id)) AS slot FROM u WHERE (is_oracle AND n = 1) OR (NOT is_oracle AND n <= 3)),
b AS (SELECT p.doc_id, string_agg('[doc ' || slot || '] ' || d.text || chr(10), '' ORDER BY slot) AS body, bool_or(is_oracle) AS has_oracle, count(*) AS n_passages FROM p JOIN documents d ON d.doc_id = p.id GROUP BY 1),
a AS (SELECT d.doc_id, 'Use the retrieved context documents below to resolve the ticket. Some documents' || chr(10) || 'may be irrelevant; rely only on those that apply.' || chr(10) || chr(10) || '<retrieved_context>' || chr(10)
  || coalesce(body, '') || '</retrieved_context>' || chr(10) || chr(10) || 'Ticket: ticket ' || d.doc_id AS usr, lang AS assistant, coalesce(has_oracle, false) AS has_oracle, coalesce(n_passages, 0) AS n_passages
  FROM documents d LEFT JOIN b USING (doc_id) WHERE d.doc_id IN (SELECT vec_id FROM embeddings))"""


def assembled_stats(spark, sf):
    return retrieval.retrieval_stats(_assembled(spark, sf), F.length("user"), 4000)


# ---- funnel, census, probes --------------------------------------------------------------

def funnel(spark, sf):
    """Exact copies, near copies, benchmark overlap, then unscored or low-quality rows."""
    rows = docs(spark, sf).select("doc_id", "text")
    exact = curation.exact_duplicates(rows, "doc_id", ["text"]).select("doc_id")
    sets = curation.shingle_table(rows, "doc_id", "text")
    near = curation.near_duplicates(rows, "doc_id", "text", 0.9, sets=sets)
    dirty = curation.contaminated(rows, "doc_id", "text", curation.acceptance_layers(layers(spark, sf), "item_id", "text"), 0.3, sets=sets).select("doc_id")
    scored = _scores(spark, sf).where("score >= 4").select("doc_id")
    poor = rows.select("doc_id").join(scored, "doc_id", "left_anti")
    return curation.curation_funnel(rows, "doc_id", [("exact duplicates", exact), ("near duplicates", near), ("decontamination", dirty), ("quality", poor)])


_FUNNEL = f"""WITH {_SETS}, {_DD}, {_DB}, x AS (SELECT doc_id, 0 AS s FROM documents QUALIFY row_number() OVER (PARTITION BY text ORDER BY doc_id) > 1
  UNION ALL SELECT doc_id, 1 FROM dd WHERE j >= 0.9 UNION ALL SELECT doc_id, 2 FROM db WHERE j >= 0.3
  UNION ALL SELECT doc_id, 3 FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels WHERE quality * 3 + (1 - toxic) * 2 >= 4)),
f AS (SELECT d.doc_id, coalesce(min(s), 4) AS s FROM documents d LEFT JOIN x USING (doc_id) GROUP BY 1), st(s, stage) AS (VALUES (0, 'exact duplicates'), (1, 'near duplicates'), (2, 'decontamination'), (3, 'quality'))
SELECT CAST(s AS BIGINT) AS stage_no, stage, (SELECT count(*) FROM f WHERE f.s >= st.s) AS rows_in, (SELECT count(*) FROM f WHERE f.s = st.s) AS dropped, (SELECT count(*) FROM f WHERE f.s > st.s) AS rows_out FROM st"""


def _split_docs(spark, sf):
    return curation.split_by_hash(docs(spark, sf), "doc_id", SEED)


def kept_short(spark, sf):
    return curation.drop_overlong(docs(spark, sf), F.length("text"), 4000).select("doc_id")


def overlong(spark, sf):
    return curation.overlong_report(_split_docs(spark, sf), F.length("text"), 4000)


def overlong_tasks(spark, sf):
    rows = _split_docs(spark, sf).withColumn("task", F.concat_ws("-", "source", (F.col("doc_id") % 7).cast("string")))
    return curation.overlong_census(rows, F.length("text"), 4000, "task")


def tokens(spark, sf):
    return curation.token_census(_split_docs(spark, sf), F.floor(F.length("text") / 4), "split", 4.0)


def probes(spark, sf):
    return curation.probe_samples(docs(spark, sf), "doc_id", F.length("text"), 30, SEED).select("probe", "doc_id", "size")


def probe_means(spark, sf):
    rows = docs(spark, sf)
    return curation.probe_report(curation.probe_samples(rows, "doc_id", F.length("text"), 30, SEED), rows, F.length("text"))


_PROBES = f"""p AS ((SELECT 'representative' AS probe, doc_id, length(text) AS size FROM documents ORDER BY md5('{SEED}:' || doc_id), doc_id LIMIT 30)
UNION ALL (SELECT 'edge', doc_id, length(text) FROM documents ORDER BY length(text) DESC, doc_id LIMIT 30))"""


def capped(spark, sf):
    return curation.cap_rows(docs(spark, sf), ["doc_id"], 100).select("doc_id")


QUERIES = {
    "b1_validate_source": source_check,
    "b2_provenance_counts": origins,
    "b3_strip_think": stripped,
    "b3_think_report": think,
    "b4_exact_duplicates": exact_dupes,
    "b5_near_duplicates": near_dupes,
    "b6_length_format_filter": lengths,
    "b7_pii_scan": pii,
    "b7_pii_scrub": scrubbed,
    "b8_quality_filter": quality,
    "b9_split_90_10": split,
    "b10_decontaminate": clean_rows,
    "b10_decontamination_stats": decontamination,
    "b11_contamination_check": overlap,
    "b12_content_hash_decontaminate": hash_clean,
    "b13_data_readiness_audit": audit,
    "b14_validate_detection_set": detection_set,
    "b14_class_distribution": classes,
    "b15_assemble_retrieval_rows": assembled,
    "b16_lexical_topk": lexical,
    "b16_recall_at_k": recall,
    "b17_vector_topk": vectors,
    "b18_retrieval_stats": assembled_stats,
    "b19_curation_funnel": funnel,
    "b20_drop_overlong": kept_short,
    "b20_overlong_report": overlong,
    "b21_overlong_census": overlong_tasks,
    "b22_token_census": tokens,
    "b23_probe_samples": probes,
    "b23_probe_report": probe_means,
    "b24_cap_rows": capped,
}

_T = _THINK
SQL = {
    "b1_validate_source": "SELECT count(*) AS n_rows, 0::BIGINT AS n_unreadable, count(*) FILTER (doc_id IS NULL OR text IS NULL OR lang IS NULL) AS n_incomplete, 1000::BIGINT AS n_expected, '' AS missing_fields, count(*) = 1000 AND count(*) FILTER (doc_id IS NULL OR text IS NULL OR lang IS NULL) = 0 AS ok FROM documents",
    "b2_provenance_counts": "SELECT CASE WHEN source IN ('src0', 'src1') THEN 'unstated' WHEN lang = 'en' THEN 'customer' ELSE 'teacher' END AS origin, count(*) AS n FROM documents GROUP BY 1",
    "b3_strip_think": "SELECT conv_id, turn, CASE WHEN turn % 3 = 1 THEN '<think>open ' || text ELSE text END AS text, turn % 3 = 0 AS closed FROM conversations",
    "b3_think_report": "SELECT count(*) AS n_rows, count(*) FILTER (turn % 3 = 0) AS n_closed_think, CAST(count(*) FILTER (turn % 3 = 0) AS DOUBLE) / count(*) AS closed_think_rate, CAST(sum(CASE WHEN turn % 3 = 0 THEN length(text) + 20 ELSE 0 END) AS BIGINT) AS chars_removed FROM conversations",
    "b4_exact_duplicates": "SELECT doc_id, survivor FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS survivor FROM documents) WHERE doc_id <> survivor",
    "b5_near_duplicates": f"WITH {_SETS}, {_DD} SELECT DISTINCT doc_id FROM dd WHERE j >= 0.8",
    "b6_length_format_filter": r"SELECT doc_id FROM documents WHERE length(text) BETWEEN 200 AND 4000 AND regexp_matches(text, '[.!?]\s*$')",
    "b7_pii_scan": f"SELECT kind, CAST(sum(n) AS BIGINT) AS matches, count(*) FILTER (n > 0) AS rows_affected FROM ({_PII_UNION}) GROUP BY 1",
    "b7_pii_scrub": f"SELECT doc_id, md5({_SCRUB}) AS digest FROM documents",
    "b8_quality_filter": "SELECT doc_id FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE quality * 3 + (1 - toxic) * 2 >= 4)",
    "b9_split_90_10": f"SELECT doc_id, split FROM ({_SPLIT})",
    "b10_decontaminate": f"WITH {_SETS}, {_DB} SELECT doc_id FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM db WHERE j >= 0.3)",
    "b10_decontamination_stats": f"""WITH {_SETS}, {_DB}, bad AS (SELECT DISTINCT layer, doc_id FROM db WHERE j >= 0.6), l(layer) AS (VALUES ('id'), ('ood'), ('empty'))
SELECT layer, (SELECT count(*) FROM bad WHERE bad.layer = l.layer) AS dropped, coalesce((SELECT max(j) FROM db WHERE db.layer = l.layer AND doc_id NOT IN (SELECT doc_id FROM bad)), 0) AS max_jaccard_left FROM l""",
    "b11_contamination_check": f"WITH {_SETS}, {_DB}, l(layer) AS (VALUES ('id'), ('ood'), ('empty')) SELECT layer, (SELECT count(DISTINCT doc_id) FROM db WHERE db.layer = l.layer AND j >= 0.3) AS n_overlapping FROM l",
    "b12_content_hash_decontaminate": "SELECT doc_id FROM documents WHERE source <> 'src3' AND sha256(text) NOT IN (SELECT sha256(text) FROM documents WHERE source = 'src3')",
    "b13_data_readiness_audit": _AUDIT,
    "b14_validate_detection_set": _DETSET,
    "b14_class_distribution": "SELECT l_linenumber AS category_id, count(*) AS n_boxes FROM lineitem GROUP BY 1",
    "b15_assemble_retrieval_rows": f"{_ASSEMBLED} SELECT doc_id, md5(usr) AS user_digest, assistant, has_oracle, n_passages FROM a",
    "b16_lexical_topk": _LEXICAL,
    "b16_recall_at_k": _RECALL,
    "b17_vector_topk": _VECTORS,
    "b18_retrieval_stats": f"""{_ASSEMBLED}, z AS (SELECT list(length(usr) ORDER BY length(usr)) AS l, count(*) AS n, count(*) FILTER (has_oracle) AS o, count(*) FILTER (n_passages = 0) AS f, max(length(usr)) AS m FROM a)
SELECT n AS raft_rows, CAST(o AS DOUBLE) / n AS raft_oracle_fraction, f AS retrieval_failures, CAST(m AS BIGINT) AS max, l[CAST(floor(n / 2) AS BIGINT) + 1] AS p50, l[least(n - 1, CAST(floor(0.95 * n) AS BIGINT)) + 1] AS p95,
  l[least(n - 1, CAST(floor(0.95 * n) AS BIGINT)) + 1] > 4000 AS escalate FROM z""",
    "b19_curation_funnel": _FUNNEL,
    "b20_drop_overlong": "SELECT doc_id FROM documents WHERE length(text) <= 4000",
    "b20_overlong_report": f"SELECT split, count(*) AS before, count(*) FILTER (length(text) > 4000) AS dropped, 100.0 * count(*) FILTER (length(text) > 4000) / count(*) AS dropped_pct FROM ({_SPLIT}) GROUP BY 1",
    "b21_overlong_census": f"""SELECT split, CAST(sum(n) AS BIGINT) AS rows, CAST(sum(o) AS BIGINT) AS rows_dropped, count(*) AS tasks, count(*) FILTER (o = n) AS tasks_lost, count(*) FILTER (o > 0 AND o < n) AS tasks_straddling
FROM (SELECT split, source || '-' || (doc_id % 7) AS task, count(*) AS n, count(*) FILTER (length(text) > 4000) AS o FROM ({_SPLIT}) GROUP BY 1, 2) GROUP BY 1""",
    "b22_token_census": f"""SELECT split, n, l[CAST(floor(n / 2) AS BIGINT) + 1] AS p50, l[least(n - 1, CAST(floor(0.9 * n) AS BIGINT)) + 1] AS p90, l[least(n - 1, CAST(floor(0.99 * n) AS BIGINT)) + 1] AS p99, l[n] AS max, 4.0::DOUBLE AS chars_per_token
FROM (SELECT split, count(*) AS n, list(CAST(floor(length(text) / 4) AS BIGINT) ORDER BY length(text)) AS l FROM ({_SPLIT}) GROUP BY 1)""",
    "b23_probe_samples": f"WITH {_PROBES} SELECT * FROM p",
    "b23_probe_report": f"WITH {_PROBES} SELECT probe, count(*) AS n, CAST(sum(size) AS DOUBLE) / count(*) AS mean_size FROM p GROUP BY 1 UNION ALL SELECT 'corpus', count(*), CAST(sum(length(text)) AS DOUBLE) / count(*) FROM documents",
    "b24_cap_rows": "SELECT doc_id FROM documents ORDER BY doc_id LIMIT 100",
}
