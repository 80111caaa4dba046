"""One query per operator over its whole table, with production parameters."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import functions as F

from tallyloom.llm import alignment, chat, classifier, decontaminate, digest_index, html, language_model, merkle, mixing, near_duplicates, quality, token_counts, token_files
from tallyloom.llm.common import crc_mod
from tallyloom.session import durable, fresh_path, table


def op1(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    found = decontaminate.decontaminate(docs, table(spark, sf, "benchmark"), window=10, texts=False)
    return found.select("doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated")


def op2(spark, sf):
    return language_model.score_texts(table(spark, sf, "documents").select("doc_id", "text"))


def op3(spark, sf):
    return token_counts.count_tokens(table(spark, sf, "documents"), public_tokenizers.path("word_bpe_49k.json"), limit=2048)


def op4(spark, sf):
    verdicts = quality.judge(table(spark, sf, "documents").select("doc_id", "text", "source"))
    return verdicts.select(
        "doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "removed_words", "kept"
    )


def op5(spark, sf):
    return near_duplicates.near_duplicates(table(spark, sf, "documents").select("doc_id", "text"), width=2, threshold=0.8)


def op6(spark, sf):
    return html.extract(table(spark, sf, "pages"))


def op7(spark, sf):
    docs = table(spark, sf, "documents").select("doc_id", "text")
    model = classifier.learn(docs, table(spark, sf, "labels"), "quality", crc_mod("doc_id", 5) != 0)
    return classifier.score(docs, model, 0.3).withColumn("held_out", crc_mod("doc_id", 5) == 0)


def op8(spark, sf):
    folder = fresh_path(spark, "tokens")
    token_files.write_token_files(table(spark, sf, "documents"), folder, public_tokenizers.path("byte_bpe_50k.json"))
    return token_files.read_token_files(spark, folder)


def op9(spark, sf):
    return mixing.mix(table(spark, sf, "documents")).select("doc_id", "size", "source_size", "target", "taken")


#: Tools of the conversations view: tool, argument, type, required.
TOOLS = (
    ("search", "query", "string", True), ("search", "limit", "integer", False),
    ("lookup", "key", "string", True), ("lookup", "exact", "boolean", False),
)


def tool_messages(conversations):
    """Conversations as messages with tool calls: an assistant turn that answers a user becomes a
    call and its result; other turns stay. By conversation number some calls lack an argument, some
    results name a call there is not and leave theirs unanswered, some results come first, and some
    calls wait for a later one. Every text stays; a null number is none of these."""
    every = lambda modulus, rest: F.coalesce(F.col("conv_id") % modulus == rest, F.lit(False))
    call_id = F.concat(F.lit("c"), F.col("turn"))
    argument = F.when(every(2, 0), "query").otherwise("key")
    arguments = F.map_from_arrays(
        F.array(argument, F.lit("limit"), F.lit("after")),
        F.array(F.concat(F.lit("q"), F.col("turn")), F.when(every(5, 0), "many").otherwise("10"), F.when(every(6, 1), F.concat(F.lit("c"), F.col("turn") + 2))),
    )
    given = F.map_filter(arguments, lambda k, v: v.isNotNull() & ~((k == "limit") & every(2, 1)) & ~(every(7, 0) & (k != "limit")))
    name = F.when(every(9, 4), "other").when(every(2, 0), "search").otherwise("lookup")
    calls = F.to_json(F.struct(F.array(F.struct(call_id.alias("id"), name.alias("name"), given.alias("arguments"))).alias("tool_calls")))
    answered = F.when(every(10, 3), F.concat(F.lit("no"), call_id)).otherwise(call_id)
    result = F.to_json(F.struct(answered.alias("tool_call_id"), F.col("text").alias("content")))
    at = F.col("turn") * 4
    parts = F.when(F.col("role") == "assistant", F.array(
        F.struct(at.alias("turn"), F.lit("assistant").alias("role"), calls.alias("text")),
        F.struct(F.when(every(11, 0), at - 1).otherwise(at + 1).alias("turn"), F.lit("tool").alias("role"), result.alias("text")),
    )).otherwise(F.array(F.struct(at.alias("turn"), F.col("role"), F.col("text"))))
    rows = conversations.select("conv_id", F.explode(parts).alias("m"))
    return rows.select("conv_id", "m.turn", "m.role", "m.text")


def op10(spark, sf):
    schemas = spark.createDataFrame(list(TOOLS), "tool string, argument string, type string, required boolean")
    linked = chat.link(tool_messages(table(spark, sf, "conversations")), schemas)
    return linked.select(
        "conv_id", F.col("place.turn").alias("at_turn"), F.col("place.depth").cast("long").alias("depth"), F.col("place.own").alias("own_turn"),
        "kind", "call_id", "status", F.array_join("errors", "; ").alias("errors"), "line",
    )


def op11(spark, sf):
    found = alignment.align(
        table(spark, sf, "documents"), public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    )
    return found.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def op12(spark, sf):
    hit = F.col("doc_id").isNotNull() & (crc_mod("doc_id", 3) == 0)
    tampered = F.when(hit, merkle.leaf_digest(text=merkle.lowered("text")))
    manifest = merkle.build(table(spark, sf, "documents"), tampered=tampered)
    root, siblings = F.lit(manifest.root), F.transform("way", lambda step: F.concat(step["left"], step["right"]))
    rows = merkle.proofs(manifest).withColumn("folded_root", merkle.folded(F.coalesce("tampered", "digest"), F.col("way")))
    return rows.select(
        F.col("id").alias("doc_id"), F.col("digest").alias("leaf"), "subroot", root.alias("root"),
        merkle.hashed(F.array_join(siblings, "")).alias("proof_sha256"), "folded_root", (F.col("folded_root") == root).alias("verified"),
    )


def op13(spark, sf):
    rows = durable(digest_index.digests(table(spark, sf, "documents")), "digests")
    index = digest_index.DigestIndex(spark, fresh_path(spark, "digest-index"), int(spark.conf.get("spark.sql.shuffle.partitions")))
    for part in range(2):  # the second delivery meets the digests of the first
        index.deliver(rows.where(crc_mod("doc_id", 2) == part), f"delivery {part}")
    return digest_index.verdicts(rows, index)


def pipeline(spark, sf):
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf)


QUERIES = {
    "op1_benchmark_decontamination": op1,
    "op2_hierarchical_pitman_yor": op2,
    "op3_token_counts": op3,
    "op4_quality_rules": op4,
    "op5_odd_sketch_near_duplicates": op5,
    "op6_html_extraction": op6,
    "op7_quality_classifier": op7,
    "op8_token_files": op8,
    "op9_source_mixing": op9,
    "op10_tool_call_chat": op10,
    "op11_cross_tokenizer_alignment": op11,
    "op12_merkle_manifest": op12,
    "op13_digest_index": op13,
    "pipeline": pipeline,
}
