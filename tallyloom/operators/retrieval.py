"""Retrieval: lexical and vector top-k, recall, and context assembly."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tallyloom.functions.stats import count_where, order_statistics, quantile_position, upper_median_position
from tallyloom.operators.similarity import shingle_sets, top_similar
from tallyloom.session import durable

HIT_THRESHOLD, TOP_K, DISTRACTORS, ORACLE_PERCENT = 0.6, 5, 3, 80
BLOCK = 4_096
SPAN_BYTES = 32 << 20  # of one side's vectors in a task
CELLS = 1 << 21  # products a task holds at a time
FIRST = 256  # rows whose products are ordered outright

# Fixed template of the assembled user turn.
HEAD = (
    "Use the retrieved context documents below to resolve the ticket. Some documents\n"
    "may be irrelevant; rely only on those that apply.\n\n<retrieved_context>\n"
)
TAIL = "</retrieved_context>\n\nTicket: "


def lexical_topk(queries: DataFrame, query_key: str, query_text: str, corpus: DataFrame, key: str, text: str, k: int = TOP_K, n: int = 3, unit: str = "word") -> DataFrame:
    """The k corpus rows most similar to each query by n-gram Jaccard (query_id, id, jaccard, rank)."""
    return top_similar(
        shingle_sets(queries, query_key, query_text, n, unit), shingle_sets(corpus, key, text, n, unit), k
    )


def recall_at_k(retrieved: DataFrame, queries: DataFrame, query_key: str, layer: str, threshold: float = HIT_THRESHOLD) -> DataFrame:
    """Per layer: items, hits, recall and the upper median of the best similarity found."""
    best = retrieved.groupBy(F.col("query_id").alias(query_key)).agg(F.max("jaccard").alias("_best"))
    rows = queries.select(query_key, layer).join(best, query_key, "left").withColumn(
        "best", F.coalesce("_best", F.lit(0.0)))
    mid = order_statistics(rows, [layer], "best", {"best_p50": upper_median_position()}, 0.01)
    hits = count_where(F.col("best") >= threshold)
    return rows.groupBy(layer).agg(
        F.count("*").alias("n_items"), hits.alias("n_hits"), (hits / F.count("*")).alias("recall")
    ).join(mid.drop("n"), layer)


def probe_index(retrieved: DataFrame, probes: Sequence) -> None:
    """Refuse an index that returns nothing for every probe query."""
    if retrieved.where(F.col("query_id").isin(*probes)).isEmpty():
        raise ValueError("the index returned no passage for any probe query")


def nearest_rows(asks: np.ndarray, base: np.ndarray, k: int, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Per ask the rows of `base` with the k highest inner products, and those; earlier rows first on ties.

    `block` asks at a time pass over slices of `base`; after a short first slice only what beats an
    ask's k-th best so far is ordered, so the products are nearly all of the work.
    """
    k, block = min(k, len(base)), min(block, CELLS)
    rows, scores = np.zeros((len(asks), k), np.int64), np.zeros((len(asks), k))
    if not np.isfinite(asks).all() or not np.isfinite(base).all():
        block, first = max(1, CELLS // len(base)), len(base)
    else:
        first = min(len(base), max(k, FIRST))
    for start in range(0, len(asks), block):
        part = asks[start:start + block]
        found = part @ base[:first].T
        best = np.argsort(-found, axis=1, kind="stable")[:, :k]
        score = np.take_along_axis(found, best, axis=1)
        wide = max(1, CELLS // len(part))
        for at in range(first, len(base), wide):
            found = part @ base[at:at + wide].T
            ask, row = np.nonzero(found > score[:, -1:])
            if not len(ask):
                continue
            touched, ask_at = np.unique(ask, return_inverse=True)
            who = np.concatenate((np.repeat(np.arange(len(touched)), k), ask_at))
            what = np.concatenate((best[touched].ravel(), row + at))
            value = np.concatenate((score[touched].ravel(), found[ask, row]))
            order = np.lexsort((what, -value, who))
            begins = np.searchsorted(who[order], np.arange(len(touched)))
            take = order[begins[:, None] + np.arange(k)]
            best[touched], score[touched] = what[take], value[take]
        rows[start:start + block], scores[start:start + block] = best, score
    return rows, scores


def vector_topk(queries: DataFrame, corpus: DataFrame, k: int, block: int = BLOCK, query_id: str = "query_id", key: str = "id", vector: str = "embedding") -> DataFrame:
    """Exact k nearest by inner product: (query_id, id, rank); ties by id.

    Both sides are cut into spans of at most `SPAN_BYTES` of vectors, and each pair of spans meets
    in one task, which multiplies them `block` queries at a time and returns k rows per query; so
    neither side ever travels to the driver or into one task whole. A vector moves once per span of
    the other side: as often as it takes to keep the cores busy, and beyond that once per
    `SPAN_BYTES` of the other side.
    """
    spark = queries.sparkSession
    size = corpus.select(F.size(vector).alias("n")).first()
    span = max(1, SPAN_BYTES // (8 * max(1, size.n if size else 1)))
    grid = math.ceil(math.sqrt(2 * spark.sparkContext.defaultParallelism))
    spans = lambda n: max(1, -(-n // span), min(grid, -(-n // block)))
    n_q, n_c = spans(queries.count()), spans(corpus.count())
    side = lambda ids, blocks: F.pmod(F.xxhash64(ids), F.lit(blocks))
    fan = lambda n: F.explode(F.sequence(F.lit(0).cast("long"), F.lit(n - 1).cast("long")))
    pair = ["_qb", "_cb"]
    q = queries.select(
        F.col(query_id).alias("_q"), F.col(vector).alias("_v"), side(query_id, n_q).alias("_qb"), fan(n_c).alias("_cb"))
    c = corpus.select(
        F.col(key).alias("_c"), F.col(vector).alias("_v"), side(key, n_c).alias("_cb"), fan(n_q).alias("_qb"))
    q, c = q.repartition(4 * n_q * n_c, *pair), c.repartition(4 * n_q * n_c, *pair)
    id_q, id_c = queries.schema[query_id].dataType, corpus.schema[key].dataType
    out = T.StructType([T.StructField(query_id, id_q), T.StructField(key, id_c), T.StructField("score", T.DoubleType())])

    def product(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if left.empty or right.empty:
            return pd.DataFrame({query_id: [], key: [], "score": []})
        right = right.sort_values("_c", ignore_index=True)
        # Rows of a span are in id order, so the smaller id comes first among equal scores.
        best, scores = nearest_rows(np.stack(left["_v"]).astype("f8"), np.stack(right["_v"]).astype("f8"), k, block)
        return pd.DataFrame({
            query_id: left["_q"].to_numpy()[np.repeat(np.arange(len(left)), best.shape[1])],
            key: right["_c"].to_numpy()[best.ravel()], "score": scores.ravel(),
        })

    partial = q.groupBy(*pair).cogroup(c.groupBy(*pair)).applyInPandas(product, out)
    order = Window.partitionBy(query_id).orderBy(F.col("score").desc(), F.col(key))
    return partial.withColumn("rank", F.row_number().over(order).cast("long")).where(F.col("rank") <= k)


def _draw(seed: int, *cols: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(seed)), *[c.cast("string") for c in cols]))


def choose_passages(retrieved: DataFrame, oracle: DataFrame, rows: DataFrame, key: str, seed: int, distractors: int = DISTRACTORS, oracle_percent: int = ORACLE_PERCENT) -> DataFrame:
    """(key, id, is_oracle, slot): the passages of each row in shuffled order.

    `retrieved`: key, id, rank; `oracle`: key, id. Four rows in five keep their oracle passage
    when it was retrieved; the rest carry distractors only. At most 1 + distractors per row.
    """
    tagged = retrieved.join(oracle.select(key, "id", F.lit(True).alias("_o")), [key, "id"], "left").withColumn(
        "is_oracle", F.coalesce("_o", F.lit(False))).drop("_o")
    shows = F.conv(F.substring(_draw(seed, F.col(key)), 1, 7), 16, 10).cast("long") % 100 < oracle_percent
    usable = tagged.where(~F.col("is_oracle") | shows)
    by_rank = Window.partitionBy(key, "is_oracle").orderBy("rank")
    picked = usable.withColumn("_n", F.row_number().over(by_rank)).where(
        F.col("is_oracle") & (F.col("_n") == 1) | ~F.col("is_oracle") & (F.col("_n") <= distractors))
    shuffled = Window.partitionBy(key).orderBy(_draw(seed, F.col(key), F.col("id")))
    return picked.withColumn("slot", F.row_number().over(shuffled).cast("long")).select(key, "id", "is_oracle", "slot")


def assemble_rows(rows: DataFrame, passages: DataFrame, corpus: DataFrame, key: str, ticket: str, target: str, corpus_key: str, corpus_text: str) -> DataFrame:
    """Chat-ready rows: the assembled user turn and the verbatim target.

    A row without passages renders an empty block and counts as a retrieval failure. Each row
    has at most 1 + distractors passages, so the per-row list stays small.
    """
    texts = passages.join(corpus.select(F.col(corpus_key).alias("id"), F.col(corpus_text).alias("_p")), "id")
    blocks = texts.groupBy(key).agg(
        F.sort_array(F.collect_list(F.struct("slot", "_p"))).alias("_list"),
        F.bool_or("is_oracle").alias("has_oracle"), F.count("*").alias("n_passages"))
    lines = F.transform("_list", lambda p: F.concat(F.lit("[doc "), p["slot"].cast("string"), F.lit("] "), p["_p"], F.lit("\n")))
    body = F.coalesce(F.array_join(lines, ""), F.lit(""))
    return rows.select(key, ticket, target).join(blocks, key, "left").select(
        key, F.concat(F.lit(HEAD), body, F.lit(TAIL), F.col(ticket)).alias("user"),
        F.col(target).alias("assistant"), F.coalesce("has_oracle", F.lit(False)).alias("has_oracle"),
        F.coalesce("n_passages", F.lit(0)).alias("n_passages"))


def retrieval_stats(assembled: DataFrame, size: Column, window: int) -> DataFrame:
    """Rows, oracle share, retrieval failures and length tails against the trainer's window."""
    sized = durable(assembled.select("has_oracle", "n_passages", size.alias("_size")), "sizes").withColumn("_all", F.lit(0))
    tails = order_statistics(sized, ["_all"], "_size", {"p50": upper_median_position(), "p95": quantile_position(0.95)})
    return sized.groupBy("_all").agg(
        F.count("*").alias("raft_rows"), (count_where(F.col("has_oracle")) / F.count("*")).alias("raft_oracle_fraction"),
        count_where(F.col("n_passages") == 0).alias("retrieval_failures"), F.max("_size").alias("max"),
    ).join(tails.drop("n"), "_all").drop("_all").withColumn("escalate", F.col("p95") > window)
