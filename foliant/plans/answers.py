"""Queries of answers, boxes and embeddings."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from foliant.functions import answers as A
from foliant.functions import geometry as G
from foliant.functions import vectors as V
from foliant.operators import embedding as E
from foliant.session import load


def choice_places(s, d):
    """Parts as questions, their suppliers as choices."""
    li = load(s, d, "lineitem").select(F.col("l_partkey").alias("question_id"), F.col("l_suppkey").alias("choice")).distinct()
    return A.shuffled_choices(li).select("question_id", "choice", "place")


def answer_places(s, d):
    """Brands as quizzes, parts as questions, the smallest supplier as the
    right one of its choices: it must come out at its balanced place."""
    li = load(s, d, "lineitem").select(F.col("l_partkey").alias("p_partkey"), F.col("l_suppkey").alias("choice")).distinct()
    least = F.min("choice").over(Window.partitionBy("p_partkey"))
    targets = A.balanced_positions(load(s, d, "part").select("p_brand", "p_partkey"), "p_brand", "p_partkey").withColumnRenamed("place", "target")
    return A.placed_choices(li.withColumn("correct", F.col("choice") == least), targets, "p_partkey").select("p_partkey", "choice", "correct", "place")


def parsed_answers(s, d):
    """Event properties as model answers: fenced, bare and broken ones."""
    e = load(s, d, "events")
    raw = F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("Sure:\n```json\n"), "props", F.lit("\n```"))).when(F.col("event_id") % 3 == 1, F.col("props")).otherwise(F.substring("props", 1, 4))
    out = A.parsed(e.withColumn("answer", raw), "answer", "k bigint")
    return out.groupBy("event_type", F.coalesce("error", F.lit("-")).alias("error")).agg(F.count("*").alias("n"), F.sum("value.k").alias("k"))


def _boxes(s, d):
    """Order lines as lines of text on pages of 100 by 100."""
    li = load(s, d, "lineitem")
    x0 = F.when(F.col("l_linenumber") % 2 == 0, 55.0).otherwise(5.0)
    return li.select(F.col("l_suppkey").alias("document_id"), (F.col("l_partkey") % 5).alias("page"), F.lit(100.0).alias("width"), F.lit(100.0).alias("height"),
                     G.box(x0, F.col("l_quantity"), x0 + F.col("l_discount") * 450, F.col("l_quantity") + 2).alias("bbox"))


def column_gutters(s, d):
    return G.column_gutters(_boxes(s, d))


def page_boxes(s, d):
    b = _boxes(s, d)
    return b.groupBy("document_id", "page").agg(G.union_box(F.col("bbox")).alias("u"), F.round(F.sum(G.clipped_share(F.col("bbox"), F.col("width"), F.col("height"))), 6).alias("covered")).select(
        "document_id", "page", F.col("u.x0").alias("x0"), F.col("u.y0").alias("y0"), F.round("u.x1", 4).alias("x1"), F.col("u.y1").alias("y1"), "covered")


def title_embeddings(s, d):
    m = load(s, d, "documents_meta").where("title IS NOT NULL").select("title").distinct()
    cache = E.embed_missing(m.where(F.length("title") % 2 == 0), "title", s.createDataFrame([], "sha1 string, vector array<float>"), 32)
    rest = E.embed_missing(m, "title", cache, 32)
    return cache.unionByName(rest).select("sha1", F.round(V.norm(F.col("vector")), 5).alias("norm"))


_B = """b AS (SELECT l_suppkey AS document_id, l_partkey % 5 AS page, CASE WHEN l_linenumber % 2 = 0 THEN 55.0::DOUBLE ELSE 5.0 END AS x0, l_quantity AS y0, l_quantity + 2 AS y1, l_discount FROM lineitem),
bb AS (SELECT *, x0 + l_discount * 450 AS x1 FROM b)"""
SQL = {
    "choice_places": """SELECT question_id, choice, row_number() OVER (PARTITION BY question_id ORDER BY sha256(question_id || ':' || choice), choice) - 1 AS place
FROM (SELECT DISTINCT l_partkey AS question_id, l_suppkey AS choice FROM lineitem)""",
    "answer_places": """WITH t AS (SELECT p_partkey, (row_number() OVER (PARTITION BY p_brand ORDER BY sha256(p_brand || ':' || p_partkey), p_partkey) - 1 + ascii(sha256(p_brand))) % 4 AS target FROM part),
c AS (SELECT DISTINCT l_partkey AS p_partkey, l_suppkey AS choice FROM lineitem), k AS (SELECT *, choice = min(choice) OVER (PARTITION BY p_partkey) AS correct, count(*) OVER (PARTITION BY p_partkey) AS n FROM c),
o AS (SELECT k.*, target % n AS tg, row_number() OVER (PARTITION BY k.p_partkey, correct ORDER BY sha256(k.p_partkey || ':' || choice), choice) - 1 AS drawn FROM k JOIN t ON t.p_partkey = k.p_partkey)
SELECT p_partkey, choice, correct, CAST(CASE WHEN correct THEN tg WHEN drawn >= tg THEN drawn + 1 ELSE drawn END AS INT) AS place FROM o""",
    "parsed_answers": """SELECT event_type, CASE WHEN event_id % 3 = 2 THEN 'no JSON' ELSE '-' END AS error, count(*) AS n, sum(CASE WHEN event_id % 3 <> 2 THEN CAST(json_extract_string(props, '$.k') AS BIGINT) END) AS k FROM events GROUP BY 1, 2""",
    "title_embeddings": "SELECT DISTINCT sha1(title) AS sha1, CASE WHEN trim(title) = '' THEN 0.0 ELSE 1.0 END::DOUBLE AS norm FROM documents_meta WHERE title IS NOT NULL",
    "column_gutters": f"""WITH {_B}, t AS (SELECT *, 100.0 * (0.3 + (0.7 - 0.3) * i / 32) AS pos FROM bb, (SELECT unnest(range(0, 33)) AS i)),
p AS (SELECT document_id, page, i, count(*) FILTER (NOT x1 <= pos AND NOT x0 >= pos) AS crossing, count(*) FILTER (x1 <= pos) AS nl, count(*) FILTER (x0 >= pos) AS nr,
  min(y0) FILTER (x1 <= pos) AS lt, max(y1) FILTER (x1 <= pos) AS lb, min(y0) FILTER (x0 >= pos) AS rt, max(y1) FILTER (x0 >= pos) AS rb FROM t GROUP BY 1, 2, 3)
SELECT document_id, page, bool_or(coalesce(crossing = 0 AND nl >= 3 AND nr >= 3 AND greatest(0, least(lb, rb) - greatest(lt, rt)) / nullif(least(lb - lt, rb - rt), 0) >= 0.5, false)) AS multi_column FROM p GROUP BY 1, 2""",
    "page_boxes": f"""WITH {_B} SELECT document_id, page, min(x0) AS x0, min(y0) AS y0, round(max(x1), 4) AS x1, max(y1) AS y1,
round(sum(greatest(0, least(x1, 100) - greatest(x0, 0)) * greatest(0, least(y1, 100) - greatest(y0, 0)) / 10000), 6) AS covered FROM bb GROUP BY 1, 2""",
}
QUERIES = {f.__name__: f for f in (choice_places, answer_places, parsed_answers, column_gutters, page_boxes, title_embeddings)}
