"""Annotations of sources (file, path, uri, kind, start and stop as structs of line and col) and questions that editors ask."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# Commands of a source and what they are annotated as.
MACROS = {
    "importmodule": "import", "usemodule": "use", "usestructure": "use", "setmetatheory": "import", "inputref": "input", "mhinput": "input", "includeproblem": "input", "mhgraphics": "image", "cmhgraphics": "image",
    "symdecl": "symbol", "textsymdecl": "symbol", "symdef": "symbol", "notation": "notation", "vardef": "variable", "varseq": "variable", "symref": "reference", "sr": "reference", "symname": "reference", "sn": "reference", "Symname": "reference", "Sn": "reference",
    "sns": "reference", "Sns": "reference", "symuse": "reference", "svar": "variable", "definame": "definiendum", "Definame": "definiendum", "definames": "definiendum", "Definames": "definiendum", "definiendum": "definiendum", "definiens": "definiens", "defnotation": "definiendum",
    "inlinedef": "definition", "inlineass": "assertion", "inlinepara": "paragraph", "inlineex": "example", "copymod": "morphism", "interpretmod": "morphism", "precondition": "precondition", "objective": "objective",
}
ENVIRONMENTS = {
    "smodule": "module", "mathstructure": "structure", "extstructure": "structure", "extstructure*": "structure", "sassertion": "assertion", "sdefinition": "definition", "sparagraph": "paragraph", "sexample": "example", "ndefinition": "definition", "nparagraph": "paragraph",
    "copymodule": "morphism", "copymodule*": "morphism", "interpretmodule": "morphism", "interpretmodule*": "morphism", "sproblem": "problem", "subproblem": "problem",
}


def annotated(sources: DataFrame, text: str = "text") -> DataFrame:
    """file, line, col, kind, name, option, arg of the commands and environments (begin and end) of each line; comments do not count."""
    lines = sources.select("file", F.posexplode(F.split(text, "\n")).alias("line", "raw"))
    lines = lines.withColumn("raw", F.regexp_replace("raw", r"(?<!\\)%.*$", "")).where(F.contains("raw", F.lit("\\")))
    # what is before each backslash, and the command after it
    parts = lines.select("file", "line", F.posexplode(F.split("raw", r"\\")).alias("nth", "part"))
    before = Window.partitionBy("file", "line").orderBy("nth").rowsBetween(Window.unboundedPreceding, -1)
    own = parts.withColumn("col", F.sum(F.length("part") + 1).over(before) - 1).where("nth > 0")
    command = r"^([A-Za-z]+\*?)(?:\[([^\]]*)\])?(?:\{([^}]*)\})?"
    own = own.select("file", "line", F.col("col").cast("int").alias("col"), *[F.regexp_extract("part", command, n).alias(c) for n, c in ((1, "name"), (2, "option"), (3, "arg"))])
    table = lambda d: F.create_map(*[F.lit(x) for kv in d.items() for x in kv])
    edge = F.col("name").isin("begin", "end")
    kind = F.when(edge, F.try_element_at(table(ENVIRONMENTS), F.col("arg"))).otherwise(F.try_element_at(table(MACROS), F.col("name")))
    return own.withColumn("kind", kind).where(F.col("kind").isNotNull())


def diagnostics(found: DataFrame) -> DataFrame:
    """file, line, message: environments that are not closed or were not opened, and commands without an argument; each once."""
    step = F.when(F.col("name") == "begin", 1).when(F.col("name") == "end", -1)
    sums = found.where(F.col("name").isin("begin", "end")).groupBy("file", "arg").agg(F.sum(step).alias("open"), F.max("line").alias("line"))
    wrong = sums.where("open != 0").select("file", "line", F.concat(F.when(F.col("open") > 0, "not closed: ").otherwise("not opened: "), "arg").alias("message"))
    bare = found.where((F.col("arg") == "") & ~F.col("name").isin("begin", "end")).select("file", "line", F.concat(F.lit("no argument: "), "name").alias("message"))
    return wrong.unionByName(bare).distinct()


def at_positions(positions: DataFrame, ranges: DataFrame, block: int = 64) -> DataFrame:
    """positions (file, pos) with the deepest range (file, start, stop, depth, id) that holds each, the last of equal depth.

    Both sides meet in blocks of positions, so the join has equal keys; a range is in every block that it covers.
    """
    own = ranges.withColumn("block", F.explode(F.sequence(F.floor(F.col("start") / block), F.floor(F.col("stop") / block))))
    met = positions.withColumn("block", F.floor(F.col("pos") / block)).join(own, ["file", "block"])
    return met.where(F.col("pos").between(F.col("start"), F.col("stop"))).groupBy("file", "pos").agg(F.max_by("id", F.struct("depth", "start", "id")).alias("id"))


def token_deltas(tokens: DataFrame) -> DataFrame:
    """tokens (file, line, col, length, type) as differences to the one before; tokens that start before the end of the last are left out by their order, multi-line ones count as 999 long."""
    before = Window.partitionBy("file").orderBy("line", "col", "type")
    line, col = F.lag("line", 1, 0).over(before), F.lag("col", 1, 0).over(before)
    return tokens.select("file", "line", "col", "type", (F.col("line") - line).alias("d_line"), F.when(F.col("line") == line, F.col("col") - col).otherwise(F.col("col")).alias("d_col"), F.coalesce("length", F.lit(999)).alias("length"))


def best_states(old: DataFrame, new: DataFrame, *keys: str) -> DataFrame:
    """The better of two states of each file (rank); the new one at a tie."""
    both = old.withColumn("fresh", F.lit(0)).unionByName(new.withColumn("fresh", F.lit(1)))
    nth = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("rank"), F.desc("fresh")))
    return both.withColumn("nth", nth).where("nth = 1").drop("nth", "fresh")
