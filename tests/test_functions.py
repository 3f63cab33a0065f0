from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from foliant.functions import ids, text, vectors


def one(spark, expr, **cols):
    df = spark.createDataFrame([tuple(cols.values())], list(cols)) if cols else spark.range(1)
    return df.select(expr.alias("x")).collect()[0].x


def test_uuid5_is_that_of_the_standard(spark):
    for s in ("a", "", "Bài tập", "x" * 500):
        assert one(spark, ids.uuid5(F.col("s")), s=s) == str(uuid.uuid5(uuid.NAMESPACE_URL, s))


def test_stable_uuid_keeps_uuids(spark):
    u = str(uuid.uuid4())
    assert one(spark, ids.stable_uuid(F.col("s")), s=u.upper().replace("-", "")) == u
    assert one(spark, ids.stable_uuid(F.col("s")), s="CO1") == str(uuid.uuid5(uuid.NAMESPACE_URL, "CO1"))


def test_fold_and_concept_key(spark):
    assert text.fold_text("  Đường   ĐI ß") == "duong di ss"
    assert one(spark, text.concept_key(F.col("s")), s="Hold-and-Wait (điều kiện)!") == "hold and wait dieu kien"


def test_quotes(spark):
    assert one(spark, text.quote_is_verbatim(F.lit("the  QUICK brown"), F.lit("See the quick\nbrown fox")))
    assert not one(spark, text.quote_is_verbatim(F.lit("the"), F.lit("the quick")))


def test_sentences_keep_abbreviations_and_numbers():
    split = text.split_sentences
    assert split("It is 3.5 m long. See e.g. Table 2. Good!") == ["It is 3.5 m long.", "See e.g. Table 2.", "Good!"]
    assert split("PGS. Lan đọc mục 4.1. Rồi cô nghỉ. Hết giờ.") == ["PGS. Lan đọc mục 4.1. Rồi cô nghỉ.", "Hết giờ."]
    assert split("Wait... Then go. (Really?) 3 left.") == ["Wait... Then go.", "(Really?)", "3 left."]
    assert split("One! «Two.» three. Four…\n\n— 5 more") == ["One!", "«Two.» three.", "Four…", "— 5 more"]
    assert split(None) == [] and split(" \n") == []


def test_common_prefix(spark):
    df = spark.createDataFrame([(["a", "b", "c"], ["a", "b", "d"]), (["a"], ["a", "b"]), (["x"], ["y"]), ([], ["y"])], "a array<string>, b array<string>")
    assert [r.x for r in df.select(text.common_prefix(F.col("a"), F.col("b")).alias("x")).collect()] == [["a", "b"], ["a"], [], []]


def test_codes_and_levels(spark):
    assert one(spark, text.outcome_code(F.lit("CO1: l.o.2.1"))) == "L.O.2.1"
    assert one(spark, text.outcome_code(F.lit("2.1"))) == "L.O.2.1"
    assert one(spark, text.bloom_level(F.lit(" Apply "))) == 3
    assert one(spark, text.bloom_level(F.lit("9"))) is None
    assert one(spark, text.json_block(F.lit("so:\n```json\n{\"a\": 1}\n```\nbye"))) == '{"a": 1}'


def test_zero_vectors(spark):
    df = spark.createDataFrame([([0.0, 0.0], [1.0, 0.0])], "a array<double>, b array<double>")
    assert df.select(vectors.cosine(F.col("a"), F.col("b")).alias("x")).collect()[0].x == 0.0
