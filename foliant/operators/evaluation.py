"""Evaluation of retrieval and of chunks: evidence by page, heading paths,
paired resampling, structure."""

from __future__ import annotations

import math

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from foliant.operators.retrieval import path_matches


def covered(ranked: DataFrame, evidence: DataFrame) -> DataFrame:
    """``(query_id, document_id, page, first, strict)``: for each piece of
    evidence the rank of the first found chunk whose pages cover it, and of
    the first that cites just this page; null if none does."""
    asked = evidence.select("query_id", "document_id", "page").distinct()
    met = asked.join(ranked.select("query_id", "document_id", "rank", "page_start", "page_end", "page_number"), ["query_id", "document_id"])
    inside = F.col("page").between(F.coalesce("page_start", "page_number"), F.coalesce("page_end", "page_number"))
    best = met.groupBy("query_id", "document_id", "page").agg(F.min(F.when(inside, F.col("rank"))).alias("first"), F.min(F.when(F.col("page") == F.col("page_number"), F.col("rank"))).alias("strict"))
    return asked.join(best, ["query_id", "document_id", "page"], "left")


def evidence_metrics(ranked: DataFrame, evidence: DataFrame) -> DataFrame:
    """hit@1, @3, @6, recall@6, MRR@10 and strict@6, means over the questions
    that have evidence, rounded to 3 places."""
    per = covered(ranked, evidence).groupBy("query_id").agg(
        F.min("first").alias("first"), F.min("strict").alias("strict"), F.avg(F.coalesce((F.col("first") <= 6).cast("double"), F.lit(0.0))).alias("recall"))
    mean = lambda c, name: F.round(F.avg(F.coalesce(c.cast("double"), F.lit(0.0))), 3).alias(name)
    first = F.col("first")
    return per.agg(F.count("*").alias("questions"), mean(first <= 1, "hit_1"), mean(first <= 3, "hit_3"), mean(first <= 6, "hit_6"), mean(F.col("recall"), "recall_6"),
                   mean(F.when(first <= 10, 1 / first), "mrr_10"), mean(F.col("strict") <= 6, "strict_6"))


def path_metrics(ranked: DataFrame, expected: DataFrame) -> DataFrame:
    """recall@5 and MRR@10 of heading paths: a found path is right in the same
    document if it begins with the expected one or the other way round."""
    met = expected.select("query_id", F.col("document_id").alias("_d"), F.col("path").alias("_p")).join(ranked.select("query_id", "document_id", "heading_path", "rank"), "query_id")
    right = (F.col("document_id") == F.col("_d")) & path_matches(F.col("heading_path"), F.col("_p"))
    first = met.groupBy("query_id").agg(F.min(F.when(right, F.col("rank"))).alias("first"))
    every = expected.select("query_id").distinct().join(first, "query_id", "left")
    mean = lambda c, name: F.round(F.avg(F.coalesce(c.cast("double"), F.lit(0.0))), 3).alias(name)
    return every.agg(F.count("*").alias("questions"), mean(F.col("first") <= 5, "recall_5"), mean(F.when(F.col("first") <= 10, 1 / F.col("first")), "mrr_10"))


def paired_bootstrap(scores: DataFrame, resamples: int = 10_000, seed: int = 0, block: int = 100_000) -> DataFrame:
    """Mean difference of two variants' scores ``(query_id, base, other)``, its
    95 % interval by paired resampling, and the exact McNemar test of hits.

    Questions are dealt to blocks; how many of a resample's draws fall into
    each block is drawn first (multinomially, from the seed alone, alike in
    all tasks), and a block's task draws these of its own, so any number of
    questions is resampled as a whole without meeting in one place."""
    n = scores.count()
    blocks = max(1, math.ceil(n / block))
    dealt = scores.select(F.xxhash64("query_id").alias("h"), (F.col("other") - F.col("base")).alias("d")).withColumn("block", F.pmod(F.col("h"), F.lit(blocks)).cast("int"))
    sizes = {r.block: r["count"] for r in dealt.groupBy("block").count().collect()}  # n / block rows
    shares = [sizes.get(b, 0) / max(n, 1) for b in range(blocks)]

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        import numpy as np

        mine = int(pdf["block"].iloc[0])
        d = pdf.sort_values(["h", "d"])["d"].to_numpy()
        sums = np.empty(resamples)
        for r in range(resamples):
            draws = np.random.default_rng([seed, r]).multinomial(n, shares)[mine] if blocks > 1 else n
            sums[r] = d[np.random.default_rng([seed, r, mine]).integers(0, len(d), draws)].sum()
        return pd.DataFrame({"r": np.arange(resamples), "s": sums})

    means = dealt.groupBy("block").applyInPandas(run, "r int, s double").groupBy("r").agg((F.sum("s") / max(n, 1)).alias("mean"))
    hit = scores.agg(F.avg(F.col("other") - F.col("base")).alias("difference"), F.count_if((F.col("other") > 0) & (F.col("base") == 0)).alias("won"), F.count_if((F.col("base") > 0) & (F.col("other") == 0)).alias("lost")).collect()[0]
    m = hit.won + hit.lost
    # exact up to where a float holds the sum's terms, by logarithms beyond
    tail = sum(math.exp(math.lgamma(m + 1) - math.lgamma(i + 1) - math.lgamma(m - i + 1) - m * math.log(2)) for i in range(min(hit.won, hit.lost) + 1)) if m else 0.5
    return means.agg(
        F.lit(n).alias("questions"), F.lit(hit.difference if n else 0.0).alias("difference"), F.percentile("mean", 0.025).alias("low"), F.percentile("mean", 0.975).alias("high"),
        F.lit(hit.won).alias("won"), F.lit(hit.lost).alias("lost"), F.lit(min(1.0, 2 * tail)).alias("mcnemar_p"))


def structure(chunks: DataFrame, titles: DataFrame, short: int = 200) -> DataFrame:
    """One row a document: chunks, median size, short ones, those over several
    pages, the titles ``(document_id, page, title)`` that a chunk of the file
    names in its path or text, and the share of chunks whose last heading is a
    title of the page they cite."""
    low = lambda c: F.lower(F.btrim(c))
    n = F.length("content")
    per = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"), F.median(n).alias("median_chars"), F.count_if(n < short).alias("short"), F.count_if(F.col("page_end") > F.col("page_start")).alias("multi_page"))
    wanted = titles.where("trim(title) <> ''").select("document_id", "page", low("title").alias("title")).distinct()
    text = F.concat_ws("\n", F.array_join("heading_path", "\n"), "content")
    kept = wanted.select("document_id", "title").distinct().join(chunks.select("document_id", F.lower(text).alias("text")), "document_id").groupBy("document_id", "title").agg(F.max(F.contains("text", F.col("title"))).alias("kept"))
    named = chunks.where("size(heading_path) > 0").select("document_id", "chunk_id", F.col("page_number").alias("page"), low(F.element_at("heading_path", -1)).alias("title"))
    right = named.join(wanted, ["document_id", "page", "title"], "left_semi").groupBy("document_id").agg(F.count("*").alias("right"))
    counts = kept.groupBy("document_id").agg(F.count("*").alias("titles"), F.count_if("kept").alias("titles_kept"))
    return per.join(counts, "document_id", "left").join(right, "document_id", "left").select(
        "document_id", "chunks", "median_chars", "short", "multi_page", F.coalesce("titles", F.lit(0)).alias("titles"), F.coalesce("titles_kept", F.lit(0)).alias("titles_kept"),
        F.round(F.coalesce("right", F.lit(0)) / F.col("chunks"), 4).alias("label_accuracy"))


def variants(named: dict[str, DataFrame]) -> DataFrame:
    """Chunks of several chunkers in one frame, told apart by ``variant``."""
    out = None
    for name, df in named.items():
        rows = df.withColumn("variant", F.lit(name))
        out = rows if out is None else out.unionByName(rows, allowMissingColumns=True)
    assert out is not None
    return out


def digest(c) -> F.Column:
    """Ten hexadecimal characters that stand for a text."""
    return F.substring(F.sha1(c), 1, 10)


def distinct_in_order(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """Distinct values of each key as a list, in order of their first place."""
    first = rows.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.min(order).alias("_at"))
    return first.groupBy(*keys).agg(F.transform(F.array_sort(F.collect_list(F.struct("_at", F.col(value).alias("v")))), lambda x: x["v"]).alias(f"{value}s"))


def document_extent(sections: DataFrame) -> DataFrame:
    """Characters of each document, and its headings in order, each once."""
    size = sections.groupBy("document_id").agg(F.sum(F.coalesce(F.length("content"), F.lit(0))).alias("chars"), F.count("*").alias("sections"))
    return size.join(distinct_in_order(sections.where("trim(heading) <> ''"), ["document_id"], "ord", "heading"), "document_id", "left")
