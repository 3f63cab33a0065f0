"""The queries end to end on the smallest tables: SQL where there is one, and
for the others what must hold of every right result."""

from __future__ import annotations

import duckdb
import pytest

from foliant.llm import queries as Q
from tests.compare import DATA, actual, expected


@pytest.fixture(scope="module")
def result(spark):
    made: dict = {}

    def of(name):
        if name not in made:
            made[name] = Q.QUERIES[name](spark, DATA).toPandas()
        return made[name]

    return of


def table(sql):
    return duckdb.sql(sql.replace("{}", DATA)).fetchall()


@pytest.mark.parametrize("name", sorted(Q.SQL))
def test_same_rows_as_sql(spark, name):
    assert actual(Q.QUERIES[name](spark, DATA)) == expected(Q.SQL[name])


def test_neighbours_are_ranked_and_of_one_model(result):
    near, found = result("p2_neighbours"), result("p2_found")
    assert len(near) and near.groupby(["model", "chunk_id"])["rank"].apply(lambda r: sorted(r) == list(range(1, len(r) + 1))).all()
    assert (near["rank"] <= 10).all() and (near["chunk_id"] != near["other"]).all()
    close = near[near["sim"] >= 0.88]
    assert {tuple(sorted(x)) for x in close[["chunk_id", "other"]].itertuples(index=False, name=None)} == {tuple(x) for x in found[["chunk_a", "chunk_b"]].itertuples(index=False, name=None)}


def test_repaired_sections_are_those_with_traces(result):
    found, repaired = result("p3_found"), result("p3_repaired")
    keys = lambda t: set(t[["document_id", "ord"]].itertuples(index=False, name=None))
    assert keys(found) <= keys(repaired) and set(found["kind"]) == {"broken_word", "wrong_char", "running_line", "page_number"}


def test_languages_of_all_rows(result):
    labels, found, segments = result("p4_labels"), result("p4_found"), result("p4_segments")
    assert set(labels["lang"]) <= {"vi", "en", "fr", "de", "mixed"} and labels["confidence"].between(0, 1).all()
    assert set(labels["src_table"]) == {"documents", "documents_meta", "chunks"}
    every = set(labels[["src_table", "row_key", "lang"]].itertuples(index=False, name=None))
    assert set(found[["src_table", "row_key", "lang"]].itertuples(index=False, name=None)) <= every
    mixed = labels[(labels["lang"] == "mixed") & (labels["src_table"] != "documents_meta")]
    cut = segments[segments["src_table"] != "documents_meta"]
    assert set(mixed[["src_table", "row_key"]].itertuples(index=False, name=None)) == set(cut[["src_table", "row_key"]].itertuples(index=False, name=None)) and len(cut)
    assert (segments["begin"] < segments["end"]).all() and (cut.groupby(["src_table", "row_key"])["lang"].nunique() > 1).all()


def test_groups_hold_all_pairs(result):
    pairs, groups = result("p5_found"), result("p5_groups")
    of = dict(groups[["chunk_id", "group_id"]].itertuples(index=False, name=None))
    assert len(pairs) and all(of[a] == of[b] for a, b in pairs[["chunk_a", "chunk_b"]].itertuples(index=False, name=None))
    assert (groups.loc[groups["links"] == 0, "group_id"] == groups.loc[groups["links"] == 0, "class_id"]).all()


def test_pieces_cover_the_oversized(result):
    pieces, found = result("p6_pieces"), result("p6_found")
    keys = lambda t: set(t[["document_id", "ord"]].itertuples(index=False, name=None))
    assert keys(pieces) == keys(found) and len(pieces)


def test_ids_and_spans_of_all_documents(result):
    ids, spans = result("p7_ids"), result("p7_spans")
    texts = dict(table("SELECT doc_id, coalesce(text, '') FROM '{}/documents.parquet'"))
    assert set(ids["doc_id"]) == set(spans["doc_id"]) == set(texts) and spans["restored"].all()
    n = dict(zip(spans["doc_id"], spans["n_tokens"]))
    assert all(len(x) == n[k] and bool(len(x)) == bool(texts[k]) for k, x in zip(ids["doc_id"], ids["ids"]))


def test_containers_hold_all_tokens(result):
    packed, fill, spans = result("p8_containers"), result("p8_fill"), result("p7_spans")
    assert packed.groupby("doc_id")["n"].sum().to_dict() == dict(zip(spans["doc_id"], spans["n_tokens"]))
    assert (packed.groupby("container")["n"].sum() <= 2048).all() and fill["tokens"].sum() == spans["n_tokens"].sum() and fill["containers"].sum() == packed["container"].nunique()


def test_scores_found_and_rates_agree(result):
    scores, found, rates = result("p9_scores"), result("p9_found"), result("p9_rates")
    assert scores["score"].between(0, 1).all() and len(scores) == table("SELECT count(*) FROM '{}/documents.parquet'")[0][0]
    assert set(found["doc_id"]) == set(scores.loc[scores["score"] >= 0.5, "doc_id"])
    assert rates["texts"].sum() == len(scores) and rates["found"].sum() == (scores["score"] >= 0.5).sum() and (rates["rate"] == (rates["found"] / rates["texts"]).round(6)).all()
