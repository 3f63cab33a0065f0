"""Deterministic identifiers as native expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: the URL name space of RFC 4122, without hyphens.
URL_SPACE = "6ba7b8119dad11d180b400c04fd430c8"
_UUID = r"^[0-9a-fA-F]{8}-?(?:[0-9a-fA-F]{4}-?){3}[0-9a-fA-F]{12}$"


def uuid5(name: Column, space: str = URL_SPACE) -> Column:
    """Name-based UUID, version 5, of a string; null for null."""
    h = F.sha1(F.concat(F.unhex(F.lit(space)), F.encode(name, "UTF-8")))
    variant = F.translate(F.substring(h, 17, 1), "0123456789abcdef", "89ab" * 4)
    return F.concat_ws(
        "-", F.substring(h, 1, 8), F.substring(h, 9, 4), F.concat(F.lit("5"), F.substring(h, 14, 3)),
        F.concat(variant, F.substring(h, 18, 3)), F.substring(h, 21, 12))


def stable_uuid(value: Column) -> Column:
    """A valid UUID in canonical form stays; other strings get their UUID 5."""
    hexes = F.lower(F.regexp_replace(value, "-", ""))
    canonical = F.concat_ws("-", *(F.substring(hexes, a, n) for a, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    return F.when(value.isNull(), None).when(value.rlike(_UUID), canonical).otherwise(uuid5(value))


def chunk_uuid(document_id: Column, version: Column, index: Column, path: Column, content: Column) -> Column:
    """Id of a chunk from what determines it."""
    def quoted(c):
        return F.to_json(F.array(c))

    return uuid5(F.concat_ws(",", quoted(document_id), quoted(version), index.cast("string"), F.to_json(path), F.md5(content)))


def job_id(document_id: Column, generation: Column) -> Column:
    """``<document>-g<generation>``; null where the generation is negative."""
    return F.when(generation >= 0, F.concat(document_id, F.lit("-g"), generation.cast("string")))
