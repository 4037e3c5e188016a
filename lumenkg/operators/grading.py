"""Grading of responses against solutions, as column expressions.

A solution item is a struct: tag (choice, fillin or solution), multiple, choices (array of structs with
correct), cases (array of structs: kind exact, range or regex; value; lo; hi; verdict). A response is a struct:
tag (multiple, single or text), picks (array of booleans), pick (number from 0), text.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def single(choices: Column, pick: Column) -> Column:
    """struct<points, correct>: a wrong choice is wrong; none, or one that does not exist, has no points but is not wrong."""
    right = F.get(choices, pick)["correct"]
    return F.struct(F.when(right, 1.0).otherwise(0.0).cast("float").alias("points"), F.coalesce(right, F.lit(True)).alias("correct"))


def multiple(choices: Column, picks: Column) -> Column:
    """struct<points, correct>: right less wrong by their number, not below 0, and 0 if nothing is chosen; null if the numbers differ."""
    n = F.size(choices)
    same = F.aggregate(F.zip_with(choices, picks, lambda c, p: (c["correct"] == p).cast("int")), F.lit(0), lambda a, x: a + x)
    points = F.when(F.exists(picks, lambda p: p), F.greatest((2 * same - n).cast("float") / n.cast("float"), F.lit(0.0))).otherwise(0.0)
    return F.when(F.size(picks) == n, F.struct(points.cast("float").alias("points"), (same == n).alias("correct")))


def number(text: Column) -> Column:
    """The value of an answer: whole numbers of 32 bits, or with a point digits before or after it and perhaps an exponent. Null for all else, blanks around it included."""
    whole = F.when(text.rlike(r"\A[+-]?[0-9]+\z"), text.try_cast("decimal(38,0)"))
    whole = F.when(whole.between(-(1 << 31), (1 << 31) - 1), whole.cast("float"))
    return F.coalesce(whole, F.when(text.rlike(r"\A[+-]?(?:[0-9]+\.[0-9]*|\.[0-9]+)(?:[eE][+-]?[0-9]+)?\z"), text.try_cast("float")))


def case_of(kind: Column, text: Column) -> Column:
    """struct<kind, value, lo, hi> from the written form; a range is lo-hi, either end may be missing, and a first minus belongs to the lower end, which it needs."""
    parts = F.regexp_extract_all(text, F.lit(r"^(-?[0-9.]+)?-([0-9.]+)?$"), F.lit(0))
    lo = F.nullif(F.regexp_extract(text, r"^(-?[0-9.]+)-", 1), F.lit("")).try_cast("float")
    hi = F.nullif(F.regexp_extract(text, r"-([0-9.]+)$", 1), F.lit("")).try_cast("float")
    given = (kind == "range") & (F.size(parts) > 0)
    return F.struct(kind.alias("kind"), F.when(kind != "range", text).alias("value"), F.when(given, lo).alias("lo"), F.when(given, hi).alias("hi"))


def fillin(cases: Column, text: Column) -> Column:
    """struct<points, correct> by the first case that fits; no case: wrong. Ranges include their ends; a pattern may fit anywhere."""

    def verdict(answer: Column) -> Column:
        value = answer["value"]

        def fits(c: Column) -> Column:
            ranged = value.isNotNull() & (c["lo"].isNull() | (value >= c["lo"])) & (c["hi"].isNull() | (value <= c["hi"]))
            return F.when(c["kind"] == "exact", answer["text"] == c["value"]).when(c["kind"] == "range", ranged).otherwise(F.regexp_like(answer["text"], c["value"]))

        return F.get(F.filter(cases, fits), 0)["verdict"]

    # the number is read once for all cases
    own = F.array(F.struct(text.alias("text"), number(text).alias("value")))
    right = F.coalesce(F.get(F.transform(own, verdict), 0), F.lit(False))
    return F.struct(right.cast("float").alias("points"), right.alias("correct"))


def graded(items: DataFrame, responses: DataFrame, *keys: str) -> DataFrame:
    """keys, score, correct: items (keys of the problem, ord, tag, multiple, choices, cases) with responses (keys, submission, ord, tag, picks, pick, text).

    Items that are plain solutions take no response; the others and the responses are paired in order.
    A missing or left-over response, or one of another kind or length, gives null.
    """
    nth = lambda *part: F.row_number().over(Window.partitionBy(*part).orderBy("ord"))
    own = items.where("tag != 'solution'").select(*keys, nth(*keys).alias("nth"), F.col("tag").alias("item"), "multiple", "choices", "cases")
    given = responses.select(*keys, "submission", nth(*keys, "submission").alias("nth"), "tag", "picks", "pick", "text")
    asked = responses.select(*keys, "submission").distinct().join(own, list(keys))
    met = asked.join(given, [*keys, "submission", "nth"], "full_outer")
    mark = (
        F.when((F.col("item") == "choice") & F.col("multiple") & (F.col("tag") == "multiple"), multiple(F.col("choices"), F.col("picks")))
        .when((F.col("item") == "choice") & ~F.col("multiple") & (F.col("tag") == "single"), single(F.col("choices"), F.col("pick")))
        .when((F.col("item") == "fillin") & (F.col("tag") == "text"), fillin(F.col("cases"), F.col("text")))
    )
    per = met.withColumn("mark", mark).groupBy(*keys, "submission")
    whole = F.count_if(F.col("mark").isNull()) == 0
    return per.agg(F.when(whole, F.sum(F.col("mark.points").cast("double")) / F.count("*")).alias("score"), F.when(whole, F.bool_and("mark.correct")).alias("correct"))


def answer_kind(text: Column) -> Column:
    """struct<kind, points>: +x or -x is a trait with points, anything else a class of its own."""
    points = F.when(text.rlike(r"^[+-][0-9]+(\.[0-9]+)?$"), text.try_cast("float"))
    return F.struct(F.when(points.isNotNull(), "trait").otherwise("class").alias("kind"), points.alias("points"))
