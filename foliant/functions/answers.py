"""Answers of models and the layout of quiz choices."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from foliant.functions.text import json_block


def parsed(df: DataFrame, column: str, schema: str) -> DataFrame:
    """``value`` and ``error`` of JSON answers, fenced or not; one of the two
    is null."""
    block = json_block(F.col(column))
    value = F.from_json(block, f"{schema}, _bad string", {"mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad"})
    names = [x.strip().split(" ")[0].split(":")[0] for x in schema.split(",") if x.strip()]
    bad = value.isNull() | value["_bad"].isNotNull()
    missing = F.filter(F.array(*(F.when(value[n].isNull(), F.lit(n)) for n in names)), lambda x: x.isNotNull())
    error = F.when(F.col(column).isNull(), "no answer").when(bad, "no JSON").when(F.size(missing) > 0, F.concat(F.lit("missing: "), F.array_join(missing, ", ")))
    return df.withColumn("error", error).withColumn("value", F.when(F.col("error").isNull(), F.struct(*(value[n].alias(n) for n in names))))


def shuffle_key(seed: Column, index: Column) -> Column:
    """Key by which a seed orders choices, the same on every run."""
    return F.sha2(F.concat_ws(":", seed, index.cast("string")), 256)


def shuffled_choices(choices: DataFrame, question: str = "question_id", index: str = "choice") -> DataFrame:
    """Place of each choice of a question, in an order drawn from its id."""
    w = Window.partitionBy(question).orderBy(shuffle_key(F.col(question), F.col(index)), index)
    return choices.withColumn("place", F.row_number().over(w) - 1)


def placed_choices(choices: DataFrame, targets: DataFrame, question: str = "question_id", index: str = "choice") -> DataFrame:
    """Place of each choice: the right one (``correct``) of a question at its
    ``target`` modulo the number of choices, the others around it in an order
    drawn from the id.  A question with no right choice, or with several,
    keeps its order, for a validator to find it."""
    of = Window.partitionBy(question)
    known = choices.join(targets.select(question, "target"), question, "left").withColumns({"_n": F.count("*").over(of), "_right": F.sum(F.coalesce(F.col("correct").cast("int"), F.lit(0))).over(of)})
    wrong = F.coalesce(~F.col("correct"), F.lit(True))
    drawn = F.row_number().over(Window.partitionBy(question, wrong).orderBy(shuffle_key(F.col(question), F.col(index)), index)) - 1
    at = F.pmod(F.col("target"), F.col("_n"))
    place = F.when(~wrong, at).otherwise(drawn + (drawn >= at).cast("int"))
    kept = F.row_number().over(of.orderBy(index)) - 1
    return known.withColumn("place", F.when((F.col("_right") == 1) & F.col("target").isNotNull(), place).otherwise(kept).cast("int")).drop("_n", "_right", "target")


def balanced_positions(questions: DataFrame, quiz: str, question: str, choices: int = 4) -> DataFrame:
    """Place of the right answer: every place of a quiz is used equally often
    (counts differ by one at most), in an order drawn from the ids."""
    w = Window.partitionBy(quiz).orderBy(shuffle_key(F.col(quiz), F.col(question)), question)
    return questions.withColumn("place", F.pmod(F.row_number().over(w) - 1 + F.ascii(F.sha2(F.col(quiz).cast("string"), 256)), F.lit(choices)).cast("int"))
