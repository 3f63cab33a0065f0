"""Graph projections and traversal over node and edge frames."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from foliant.operators.reads import alive, visible_documents
from foliant.session import materialize


def heading_nodes(chunks: DataFrame) -> DataFrame:
    """Every prefix of every heading path, once a document."""
    level = F.posexplode("heading_path")
    return (
        chunks.where("deleted_at IS NULL AND document_id IS NOT NULL").select("document_id", "heading_path").distinct()
        .select("document_id", "heading_path", level)
        .select("document_id", (F.col("pos") + 1).alias("level"), F.col("col").alias("title"), F.array_join(F.slice("heading_path", 1, F.col("pos") + 1), " > ").alias("path"))
        .distinct()
        .select(F.concat_ws(":", "document_id", F.col("level").cast("string"), "path").alias("heading_id"), "document_id", "level", "title")
    )


def heading_edges(chunks: DataFrame) -> DataFrame:
    """``(kind, source, target)``: document to first headings, headings to
    their sub-headings, last headings to chunks."""
    live = chunks.where("deleted_at IS NULL AND document_id IS NOT NULL AND size(heading_path) > 0")
    node = lambda n: F.concat_ws(":", "document_id", n.cast("string"), F.array_join(F.slice("heading_path", F.lit(1), n), " > "))
    paths = live.select("document_id", "heading_path").distinct()
    n = F.size("heading_path")
    roots = paths.select(F.lit("HAS_HEADING").alias("kind"), F.col("document_id").alias("source"), node(F.lit(1)).alias("target")).distinct()
    deep = paths.where(n > 1).withColumn("i", F.explode(F.sequence(F.lit(1), n - 1)))
    subs = deep.select(F.lit("HAS_SUBHEADING").alias("kind"), node(F.col("i")).alias("source"), node(F.col("i") + 1).alias("target")).distinct()
    to_chunk = live.select(F.lit("HAS_CHUNK").alias("kind"), node(n).alias("source"), F.col("chunk_id").alias("target"))
    return roots.unionByName(subs).unionByName(to_chunk)


def course_relations(relations: DataFrame, chunks: DataFrame, docs: DataFrame, course_id: str | None = None) -> DataFrame:
    """Relations a reader may see: of a live chunk in a visible document, of
    one course if it is given.  Both joins are left to the size check."""
    some = relations if course_id is None else relations.where(F.col("course_id") == course_id)
    return some.join(chunks.where(alive()).select("chunk_id").distinct(), "chunk_id", "left_semi").join(visible_documents(docs).select("document_id"), "document_id", "left_semi")


def degrees(relations: DataFrame, by_course: bool = False) -> DataFrame:
    """Edges at each node, counted at both ends."""
    keys = ["course_id", "key"] if by_course else ["key"]
    return relations.select(*keys[:-1], F.explode(F.array("source_key", "target_key")).alias("key")).groupBy(*keys).agg(F.count("*").alias("degree"))


def seeds(relations: DataFrame, concept: str, n: int = 5) -> DataFrame:
    """Nodes that match a concept: equal ones first, then by degree.  The
    relations must already be those of the reader, see ``course_relations``."""
    key = F.col("key")
    matches = (key == concept) | F.contains(key, F.lit(concept)) | ((F.length(key) >= 4) & F.contains(F.lit(concept), key))
    return degrees(relations).where(matches).orderBy((key == concept).desc(), F.desc("degree"), "key").limit(n)


def reachable(relations: DataFrame, concept: str, hops: int = 2, limit: int = 25) -> DataFrame:
    """Relations within ``hops`` of the concept's seeds, at most ``limit``.

    Breadth first; within a hop by creation, then id; the next hop starts only
    from accepted relations.  The frontier is bounded by ``limit`` (a feature
    of the operator), so each hop is one join with a broadcast side.
    """
    frontier = seeds(relations, concept).select("key")
    found: DataFrame | None = None
    for hop in range(1, hops + 1):
        room = limit - (found.count() if found is not None else 0)
        if room <= 0:
            break
        ends = F.broadcast(frontier.withColumnRenamed("key", "_end"))
        met = relations.join(ends, F.col("source_key") == F.col("_end"), "left_semi").unionByName(relations.join(ends, F.col("target_key") == F.col("_end"), "left_semi")).dropDuplicates(["relation_id"])
        if found is not None:
            met = met.join(F.broadcast(found.select("relation_id")), "relation_id", "left_anti")
        taken = materialize(met.orderBy("created_at", "relation_id").limit(room).withColumn("hop", F.lit(hop)), "hop")
        found = taken if found is None else found.unionByName(taken)
        frontier = taken.select(F.explode(F.array("source_key", "target_key")).alias("key")).distinct()
    assert found is not None
    order = Window.orderBy("hop", "created_at", "relation_id")  # at most ``limit`` rows
    return found.withColumn("rank", F.row_number().over(order))


def delete_document(nodes: DataFrame, edges: DataFrame, document_id: str) -> tuple[DataFrame, DataFrame]:
    """Heading nodes and edges without those of a document (ids embed it)."""
    mine = lambda c: (F.col(c) == document_id) | F.startswith(F.col(c), F.lit(f"{document_id}:"))
    return nodes.where(F.col("document_id") != document_id), edges.where(~mine("source") & ~mine("target"))


def concept_projection(mentions: DataFrame, chunk_nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Mention edges whose chunk node exists, and those that must wait."""
    known = chunk_nodes.select("chunk_id").distinct()
    return mentions.join(known, "chunk_id", "left_semi"), mentions.join(known, "chunk_id", "left_anti")
