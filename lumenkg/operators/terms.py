"""Terms as flat rows: their display, and the variables that they mean."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..storage import stored


def presented(terms: DataFrame, notations: DataFrame) -> DataFrame:
    """owner, node and text of the outermost terms (owner, node, parent, ord, name).

    notations (name, template): $1, $2, ... stand for the arguments. Without a notation a term is its name,
    followed by its arguments in brackets. One join for each level, from the leaves up.
    """
    own = stored(terms.join(notations.dropDuplicates(["name"]), "name", "left").withColumn("text", F.lit(None).cast("string")), "terms")
    before = None
    while (waits := own.where("text is null").count()) and waits != before:  # on a cycle nothing changes any more
        before = waits
        inner = own.where("parent is not null").groupBy("owner", F.col("parent").alias("node")).agg(F.count_if(F.col("text").isNull()).alias("open"), F.array_sort(F.collect_list(F.struct("ord", "text"))).alias("args"))
        met = own.join(inner, ["owner", "node"], "left")
        texts = F.transform("args", lambda a: a["text"])
        filled = F.aggregate(F.sequence(F.size("args"), F.lit(1), F.lit(-1)), F.col("template"), lambda t, i: F.replace(t, F.concat(F.lit("$"), i.cast("string")), F.get(texts, i - 1)))
        plain = F.concat("name", F.lit("("), F.array_join(texts, ", "), F.lit(")"))
        text = F.when(F.col("args").isNull(), F.coalesce("template", "name")).when(F.col("open") == 0, F.coalesce(filled, plain))
        own = stored(met.withColumn("text", F.coalesce("text", text)).drop("open", "args"), "terms")
    return own.where("parent is null").select("owner", "node", "text")


def resolved_variables(uses: DataFrame, declared: DataFrame) -> DataFrame:
    """uses (doc, at, name) with decl: the latest declaration (doc, at, upto, name, uri) before the use whose scope still holds it and whose name ends with the steps that are used; of several open scopes the innermost."""
    steps = declared.select("doc", F.col("at").alias("from_"), "upto", "uri", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("name", "/"))), lambda n: F.array_join(F.slice(F.split("name", "/"), -n, n), "/"))).alias("name"))
    met = uses.join(steps, ["doc", "name"], "left").withColumn("ok", F.col("from_").isNull() | ((F.col("from_") < F.col("at")) & (F.col("at") < F.col("upto"))))
    nth = F.row_number().over(Window.partitionBy("doc", "at", "name").orderBy(F.desc("ok"), F.desc("from_")))
    return met.withColumn("nth", nth).where("nth = 1").select("doc", "at", "name", F.when(F.col("ok"), F.col("uri")).alias("decl"))
