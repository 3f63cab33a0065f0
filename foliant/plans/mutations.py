"""Queries over write algebra, outbox and graph projections."""

from __future__ import annotations

from pyspark.sql import functions as F

from foliant.operators import graph as G
from foliant.operators import reads as R
from foliant.operators import writes as W
from foliant.plans.store import CHUNKS_SQL, DOCS_SQL, chunks, docs
from foliant.session import load

NOW = "2026-01-01 00:00:00"
WITH = f"WITH d AS {DOCS_SQL}, c AS {CHUNKS_SQL}\n"


def _now():
    return F.to_timestamp(F.lit(NOW + "+00:00"))


def chunk_snapshot_replace(s, d):
    """Every second part of each document is sent again; the rest is retired."""
    cols = ["chunk_id", "document_id", "course_id", "sort_order", "created_at", "deleted_at"]
    old = chunks(s, d).select(*cols)
    new = old.where("sort_order % 2 = 0").withColumn("created_at", _now())
    return W.snapshot_replace(old, new, docs(s, d), _now()).select("chunk_id", "course_id", "deleted_at", "created_at")


def soft_deleted_chunks(s, d):
    out = W.soft_delete_chunks(chunks(s, d), docs(s, d), _now())
    return out.where(F.col("deleted_at") == _now()).select("chunk_id", "document_id")


def mapping_upsert(s, d):
    m = load(s, d, "chunk_lo_mappings").where("chunk_id IS NOT NULL AND lo_id IS NOT NULL").select("chunk_id", "lo_id", "confidence", "source", "provenance", "mapped_at", "received_at")
    late = F.coalesce(F.unix_timestamp("received_at") - F.unix_timestamp("mapped_at") > 86400, F.lit(False))
    return W.upsert_mappings(m.where(~late).drop("received_at"), m.where(late).drop("received_at"))


def mappings_without_inferred(s, d):
    m = load(s, d, "chunk_lo_mappings").select("chunk_id", "lo_id", "provenance").distinct()
    of_unpublished = chunks(s, d).join(R.hidden_documents(docs(s, d)), "document_id", "left_semi")
    return W.delete_inferred(m.where("chunk_id IS NOT NULL"), of_unpublished)


def _concepts(s, d):
    t = load(s, d, "learning_outcomes").select(F.md5(F.col("code")).alias("concept_id"), F.col("statement_vi").alias("vi"), F.col("statement_en").alias("en"), "created_at", "version").distinct()
    old = t.groupBy("concept_id").agg(F.min("vi").alias("label"), F.max(F.when(F.col("version") > 1, "vi")).alias("language"), F.min("created_at").alias("updated_at"))
    new = t.where("en IS NOT NULL").groupBy("concept_id").agg(F.min("en").alias("label"), F.max(F.when(F.col("version") > 2, "en")).alias("language"), F.max("created_at").alias("updated_at"))
    return old, new


def concept_upsert(s, d):
    return W.upsert_concepts(*_concepts(s, d))


def _events(s, d):
    e = load(s, d, "events")
    return e.select(
        F.col("event_id").cast("string").alias("event_id"), F.col("event_type"), F.concat(F.lit("user-"), F.col("user_id").cast("string")).alias("aggregate_id"),
        F.col("props").alias("payload"), F.when(F.col("event_id") % 3 == 0, "SENT").otherwise("PENDING").alias("status"), (F.col("event_id") % 4).cast("int").alias("retry_count"))


def outbox_replace(s, d):
    e = _events(s, d)
    new = e.where("CAST(event_id AS bigint) % 10 = 0").withColumn("event_id", F.concat(F.lit("n"), "event_id"))
    return W.replace_pending(e, new).select("event_id", "event_type", "aggregate_id", "status", "retry_count")


def _wired(n: str = "event_id"):
    """Types of the outbox on the rows of ``events``: canonical, as old wires
    wrote them (lower case, blanks), and one that is none."""
    types = F.array(*(F.lit(t) for t in (*W.EVENT_TYPES, "DOCUMENT_RENAMED")))
    kind = F.element_at(types, (F.pmod(F.col(n).cast("bigint"), F.lit(6)) + 1).cast("int"))
    return F.when(F.pmod(F.col(n).cast("bigint"), F.lit(4)) == 1, F.concat(F.lit(" "), F.lower(kind), F.lit(" "))).otherwise(kind)


def event_validation(s, d):
    e = _events(s, d)
    out = W.validated_events(e.withColumn("event_type", _wired()))
    return out.groupBy("event_type", F.coalesce("error", F.lit("-")).alias("error")).agg(F.count("*").alias("n"))


def job_dedupe(s, d):
    m = load(s, d, "documents_meta").where("document_id IS NOT NULL").select("document_id", F.col("processing_generation").alias("generation"), F.col("created_at").alias("at"))
    return W.current_jobs(m.where("generation >= 0"))


def event_histogram(s, d):
    e = load(s, d, "events")
    return e.groupBy("event_type", F.least(F.floor(F.col("value") / 25), F.lit(8)).cast("int").alias("bucket")).agg(F.count("*").alias("n"))


def usage_by_user(s, d):
    e = load(s, d, "events").withColumn("k", F.get_json_object("props", "$.k").cast("bigint"))
    return e.groupBy("user_id").agg(F.count("*").alias("calls"), F.sum("k").alias("tokens"), F.sum(F.col("value").cast("decimal(18,6)")).alias("cost"))


def heading_graph_nodes(s, d):
    return G.heading_nodes(chunks(s, d))


def heading_graph_edges(s, d):
    return G.heading_edges(chunks(s, d))


def heading_graph_without_document(s, d):
    c = chunks(s, d)
    first = c.where("document_id IS NOT NULL").agg(F.min("document_id").alias("m"))
    nodes, edges = G.heading_nodes(c), G.heading_edges(c)
    doc = first.collect()[0].m
    nodes, edges = G.delete_document(nodes, edges, doc)
    return nodes.select(F.lit("node").alias("what"), F.col("heading_id").alias("id")).unionByName(edges.select(F.col("kind").alias("what"), F.concat_ws(" -> ", "source", "target").alias("id")))


def mention_projection(s, d):
    """Mappings as mentions: those whose chunk exists, and those that wait."""
    m = load(s, d, "chunk_lo_mappings").select("chunk_id", "lo_id").distinct()
    ready, waiting = G.concept_projection(m, chunks(s, d))
    return ready.groupBy(F.lit("ready").alias("state")).agg(F.count("*").alias("n")).unionByName(waiting.groupBy(F.lit("waiting").alias("state")).agg(F.count("*").alias("n")))


def _relations(s, d):
    """Relations with the course, file and chunk they were read from: a chunk's
    last heading is about the outcomes it is mapped to, and below its first."""
    c = chunks(s, d).where("document_id IS NOT NULL AND course_id IS NOT NULL AND size(heading_path) > 0").select(
        "chunk_id", "document_id", "course_id", "page_number", F.col("created_at").alias("at"), F.lower(F.element_at("heading_path", -1)).alias("last"), F.lower(F.element_at("heading_path", 1)).alias("first"))
    lo = load(s, d, "learning_outcomes").where("lo_id IS NOT NULL AND code IS NOT NULL").groupBy("lo_id").agg(F.lower(F.min("code")).alias("code"))
    m = load(s, d, "chunk_lo_mappings").where("chunk_id IS NOT NULL AND lo_id IS NOT NULL").select("chunk_id", "lo_id").distinct().join(lo, "lo_id").select("chunk_id", "code").distinct()
    about = c.join(m, "chunk_id").select("*", F.col("last").alias("source_key"), F.lit("ABOUT").alias("relation_type"), F.col("code").alias("target_key"))
    below = c.where("first <> last").select("*", F.col("first").alias("source_key"), F.lit("CONTAINS").alias("relation_type"), F.col("last").alias("target_key"))
    cols = ["chunk_id", "document_id", "course_id", "page_number", "at", "source_key", "relation_type", "target_key"]
    every = about.select(*cols).unionByName(below.select(*cols))
    return every.withColumn("relation_id", F.md5(F.concat_ws("|", "chunk_id", "source_key", "relation_type", "target_key"))).withColumnRenamed("at", "created_at")


def _scoped(s, d):
    return G.course_relations(_relations(s, d), chunks(s, d), docs(s, d), _COURSE)


def node_degrees(s, d):
    return G.degrees(G.course_relations(_relations(s, d), chunks(s, d), docs(s, d)), by_course=True)


def relations_1hop(s, d):
    return G.reachable(_scoped(s, d), "l.o.2.1", 1, 40).select("relation_id", "hop", "rank")


def relations_2hop(s, d):
    return G.reachable(_scoped(s, d), "l.o.2", 2, 60).select("relation_id", "hop", "rank")


#: The course with most files in all test data.
_COURSE = "52b2ce19-7113-562c-b647-bf1708f9257e"
_REL = """b AS (SELECT chunk_id, document_id, course_id, created_at, lower(heading_path[-1]) AS l, lower(heading_path[1]) AS f FROM c WHERE document_id IS NOT NULL AND course_id IS NOT NULL AND len(heading_path) > 0),
lo AS (SELECT lo_id, lower(min(code)) AS code FROM learning_outcomes WHERE lo_id IS NOT NULL AND code IS NOT NULL GROUP BY 1),
m AS (SELECT DISTINCT chunk_id, code FROM chunk_lo_mappings JOIN lo USING (lo_id) WHERE chunk_id IS NOT NULL),
rel0 AS (SELECT b.chunk_id, document_id, course_id, created_at, l AS source_key, 'ABOUT' AS relation_type, code AS target_key FROM b JOIN m ON m.chunk_id = b.chunk_id
  UNION ALL SELECT chunk_id, document_id, course_id, created_at, f, 'CONTAINS', l FROM b WHERE f <> l),
rel AS (SELECT md5(concat_ws('|', chunk_id, source_key, relation_type, target_key)) AS relation_id, r.* FROM rel0 r
  WHERE chunk_id IN (SELECT chunk_id FROM c WHERE deleted_at IS NULL) AND document_id IN (SELECT document_id FROM d WHERE deleted_at IS NULL AND coalesce(lms_published, true)) {course})"""
_DEG = "deg AS (SELECT key, count(*) AS degree FROM (SELECT source_key AS key FROM rel UNION ALL SELECT target_key FROM rel) GROUP BY key)"


def _seed_sql(concept: str) -> str:
    return f"""seeds AS (SELECT key FROM deg WHERE key = '{concept}' OR contains(key, '{concept}') OR (length(key) >= 4 AND contains('{concept}', key))
  ORDER BY (key = '{concept}') DESC, degree DESC, key LIMIT 5)"""


_EVENTS = """e AS (SELECT CAST(event_id AS VARCHAR) AS event_id, event_type, 'user-' || user_id AS aggregate_id, props AS payload,
  CASE WHEN event_id % 3 = 0 THEN 'SENT' ELSE 'PENDING' END AS status, CAST(event_id % 4 AS INT) AS retry_count FROM events)"""
SQL = {
    "chunk_snapshot_replace": WITH + f""", live AS (SELECT * FROM d WHERE deleted_at IS NULL),
new AS (SELECT c.chunk_id, c.document_id, live.course_id FROM c JOIN live ON live.document_id = c.document_id WHERE c.sort_order % 2 = 0),
touched AS (SELECT DISTINCT document_id FROM new)
SELECT c.chunk_id, CASE WHEN new.chunk_id IS NOT NULL THEN new.course_id ELSE c.course_id END AS course_id,
CASE WHEN new.chunk_id IS NOT NULL THEN NULL WHEN c.deleted_at IS NULL AND touched.document_id IS NOT NULL THEN TIMESTAMPTZ '{NOW}+00' ELSE c.deleted_at END AS deleted_at,
CASE WHEN new.chunk_id IS NOT NULL THEN TIMESTAMPTZ '{NOW}+00' ELSE c.created_at END AS created_at
FROM c LEFT JOIN new ON new.chunk_id = c.chunk_id LEFT JOIN touched ON touched.document_id = c.document_id""",
    "soft_deleted_chunks": WITH + "SELECT chunk_id, document_id FROM c WHERE deleted_at IS NULL AND document_id IN (SELECT document_id FROM d WHERE deleted_at IS NOT NULL)",
    "mapping_upsert": """WITH m AS (SELECT *, epoch(date_trunc('second', received_at)) - epoch(date_trunc('second', mapped_at)) > 86400 AS late0, coalesce(late0, false) AS late FROM chunk_lo_mappings WHERE chunk_id IS NOT NULL AND lo_id IS NOT NULL)
SELECT chunk_id, lo_id, max(confidence) AS confidence, first(source ORDER BY late DESC, mapped_at DESC NULLS LAST, source DESC NULLS LAST) AS source,
CASE WHEN bool_or(provenance = 'confirmed') THEN 'confirmed' ELSE first(provenance ORDER BY late DESC, mapped_at DESC NULLS LAST, provenance DESC NULLS LAST) END AS provenance FROM m GROUP BY 1, 2""",
    "mappings_without_inferred": WITH + """, gone AS (SELECT chunk_id FROM c WHERE document_id IN (SELECT document_id FROM d WHERE deleted_at IS NOT NULL OR lms_published IS FALSE))
SELECT DISTINCT chunk_id, lo_id, provenance FROM chunk_lo_mappings WHERE chunk_id IS NOT NULL AND (coalesce(provenance = 'confirmed', false) OR chunk_id NOT IN (SELECT chunk_id FROM gone))""",
    "concept_upsert": """WITH t AS (SELECT DISTINCT md5(code) AS concept_id, statement_vi AS vi, statement_en AS en, created_at, version FROM learning_outcomes),
old AS (SELECT concept_id, min(vi) AS label, max(CASE WHEN version > 1 THEN 'vi' END) AS language, min(created_at) AS updated_at FROM t GROUP BY 1),
new AS (SELECT concept_id, min(en) AS label, max(CASE WHEN version > 2 THEN 'en' END) AS language, max(created_at) AS updated_at FROM t WHERE en IS NOT NULL GROUP BY 1)
SELECT coalesce(new.concept_id, old.concept_id) AS concept_id, coalesce(new.label, old.label) AS label, coalesce(new.language, old.language) AS language, greatest(old.updated_at, new.updated_at) AS updated_at
FROM old FULL JOIN new ON old.concept_id = new.concept_id""",
    "outbox_replace": f"""WITH {_EVENTS}, new AS (SELECT * FROM e WHERE CAST(event_id AS BIGINT) % 10 = 0)
SELECT event_id, event_type, aggregate_id, status, retry_count FROM e WHERE NOT (status = 'PENDING' AND EXISTS (SELECT 1 FROM new n WHERE n.event_type = e.event_type AND n.aggregate_id = e.aggregate_id))
UNION ALL SELECT 'n' || event_id, event_type, aggregate_id, 'PENDING', 0 FROM new""",
    "event_validation": """SELECT CASE event_id % 6 WHEN 0 THEN 'HEADING_GRAPH_PROJECT' WHEN 1 THEN 'CONCEPT_GRAPH_PROJECT' WHEN 2 THEN 'DOCUMENT_DELETED' WHEN 3 THEN 'CONTENT_GENERATION_REQUESTED'
WHEN 4 THEN 'LESSON_PUBLISHED' ELSE 'DOCUMENT_RENAMED' END AS event_type, CASE WHEN event_id % 6 = 5 THEN 'unknown type' ELSE '-' END AS error, count(*) AS n FROM events GROUP BY 1, 2""",
    "job_dedupe": """SELECT document_id, generation, first_at, deliveries FROM (
SELECT document_id, processing_generation AS generation, min(created_at) AS first_at, count(*) AS deliveries, max(processing_generation) OVER (PARTITION BY document_id) AS latest
FROM documents_meta WHERE document_id IS NOT NULL AND processing_generation >= 0 GROUP BY 1, 2) WHERE generation = latest""",
    "event_histogram": "SELECT event_type, CAST(least(floor(value / 25), 8) AS INT) AS bucket, count(*) AS n FROM events GROUP BY 1, 2",
    "usage_by_user": "SELECT user_id, count(*) AS calls, sum(CAST(json_extract_string(props, '$.k') AS BIGINT)) AS tokens, sum(CAST(value AS DECIMAL(18,6))) AS cost FROM events GROUP BY 1",
    "heading_graph_nodes": WITH + """, p AS (SELECT DISTINCT document_id, heading_path FROM c WHERE deleted_at IS NULL AND document_id IS NOT NULL),
x AS (SELECT document_id, heading_path, unnest(range(1, len(heading_path) + 1)) AS level FROM p)
SELECT DISTINCT document_id || ':' || level || ':' || array_to_string(heading_path[1:level], ' > ') AS heading_id, document_id, level, heading_path[level] AS title FROM x""",
    "heading_graph_edges": WITH + """, live AS (SELECT * FROM c WHERE deleted_at IS NULL AND document_id IS NOT NULL AND len(heading_path) > 0),
p AS (SELECT DISTINCT document_id, heading_path FROM live), x AS (SELECT document_id, heading_path, unnest(range(1, len(heading_path))) AS i FROM p)
SELECT DISTINCT 'HAS_HEADING' AS kind, document_id AS source, document_id || ':1:' || heading_path[1] AS target FROM p
UNION ALL SELECT DISTINCT 'HAS_SUBHEADING', document_id || ':' || i || ':' || array_to_string(heading_path[1:i], ' > '), document_id || ':' || (i + 1) || ':' || array_to_string(heading_path[1:i + 1], ' > ') FROM x
UNION ALL SELECT 'HAS_CHUNK', document_id || ':' || len(heading_path) || ':' || array_to_string(heading_path, ' > '), chunk_id FROM live""",
    "mention_projection": WITH + """, m AS (SELECT DISTINCT chunk_id, lo_id FROM chunk_lo_mappings)
SELECT CASE WHEN EXISTS (SELECT 1 FROM c WHERE c.chunk_id = m.chunk_id) THEN 'ready' ELSE 'waiting' END AS state, count(*) AS n FROM m GROUP BY 1""",
    "node_degrees": WITH + f""", {_REL.format(course='')} SELECT course_id, key, count(*) AS degree FROM (SELECT course_id, source_key AS key FROM rel UNION ALL SELECT course_id, target_key FROM rel) GROUP BY 1, 2""",
    "relations_1hop": WITH + f""", {_REL.format(course=f"AND course_id = '{_COURSE}'")}, {_DEG}, {_seed_sql('l.o.2.1')}, h1 AS (SELECT * FROM rel WHERE source_key IN (SELECT key FROM seeds) OR target_key IN (SELECT key FROM seeds) ORDER BY created_at, relation_id LIMIT 40)
SELECT relation_id, 1 AS hop, row_number() OVER (ORDER BY created_at, relation_id) AS rank FROM h1""",
    "relations_2hop": WITH + f""", {_REL.format(course=f"AND course_id = '{_COURSE}'")}, {_DEG}, {_seed_sql('l.o.2')}, h1 AS (SELECT *, 1 AS hop FROM rel WHERE source_key IN (SELECT key FROM seeds) OR target_key IN (SELECT key FROM seeds) ORDER BY created_at, relation_id LIMIT 60),
f AS (SELECT source_key AS key FROM h1 UNION SELECT target_key FROM h1),
h2 AS (SELECT *, 2 AS hop FROM rel WHERE (source_key IN (SELECT key FROM f) OR target_key IN (SELECT key FROM f)) AND relation_id NOT IN (SELECT relation_id FROM h1)
  ORDER BY created_at, relation_id LIMIT (SELECT 60 - count(*) FROM h1))
SELECT relation_id, hop, row_number() OVER (ORDER BY hop, created_at, relation_id) AS rank FROM (SELECT * FROM h1 UNION ALL SELECT * FROM h2)""",
}
SQL["heading_graph_without_document"] = f"""WITH gone AS (SELECT min(document_id) AS g FROM chunks WHERE document_id IS NOT NULL), n AS ({SQL['heading_graph_nodes']}), e AS ({SQL['heading_graph_edges']})
SELECT 'node' AS what, heading_id AS id FROM n WHERE document_id <> (SELECT g FROM gone)
UNION ALL SELECT kind, source || ' -> ' || target FROM e WHERE source <> (SELECT g FROM gone) AND NOT starts_with(source, (SELECT g FROM gone) || ':') AND NOT starts_with(target, (SELECT g FROM gone) || ':')"""
QUERIES = {f.__name__: f for f in (
    chunk_snapshot_replace, soft_deleted_chunks, mapping_upsert, mappings_without_inferred, concept_upsert, outbox_replace, event_validation, job_dedupe, event_histogram,
    usage_by_user, heading_graph_nodes, heading_graph_edges, heading_graph_without_document, mention_projection, node_degrees, relations_1hop, relations_2hop)}
