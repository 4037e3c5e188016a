"""Line dedup by a deletion-neighbourhood join, in DataFrame expressions only.

The edit distance of two lines counts words put in, left out or replaced; the bound is one. Where one of
the lines has few words, as in scripts without spaces, it counts characters instead; what is said of words
below holds for them, too. For each of its words a line emits the key of what is before and after that word, and for each gap between words the
key of what is before and after the gap. Lines share a key P, Q exactly if they are P w Q, P v Q or P Q:
any two of them are within the bound, so each line has to be held against the earliest of its bucket
only. What is met this way is then verified word by word.

Long lines have many words, so lines without a neighbour are sorted out first: of two lines within the
bound, either the first half of the longer one or its second half is in the other, at its start or end.
Four keys a line, and no line is lost; a line that shares its first half only emits the keys of its
second half. Texts are split into words once; after that, lines are hashes, and only those that share a
half are read again.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_filter, drop_since, flagged, made, stored

#: Lines of fewer words are compared by characters: one word is too large a part of them.
LEAST_WORDS = 8
#: No edit is allowed in lines of few words that have fewer characters: one is too large a part of them ("Chapter 1", "Chapter 2").
LEAST_CHARS = 12
#: Names of lines that hold at least one in so many of all lines are joined without a shuffle; there are no more of them than that.
HOT = 1000
# Fixed value: white space but for the space and the end of a line. The range around the higher characters lets others pass after two tests.
_SPACES = r"\t\x0B\f\r\x1C\x1D\x1E\x1F\x{85}\x{A0}[\x{1680}-\x{3000}&&[\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]]"
_SPACE = f"[{_SPACES}]"
#: Whether a text has anything but white space.
HAS_WORD = rf"[^ \n{_SPACES}]"


def plain(text: Column) -> Column:
    """In lower case, each white space but the ends of lines as a space; done on whole texts, which is cheaper than line by line."""
    return F.lower(F.regexp_replace(text, _SPACE, " "))


def folded(line: Column) -> Column:
    """The words of a line of a plain text: what stands between spaces."""
    return F.array_remove(F.split(line, " "), "")


def _chars(words: Column) -> Column:
    """The characters of a line, one space between words."""
    return F.split(F.array_join(words, " "), "")


def _sides(half: str) -> tuple[Column, Column]:
    """side and unit of a key of a half."""
    return F.col(half).bitwiseAND(F.lit(1)), F.col(half).bitwiseAND(F.lit(2))


def _halves(line: Column, n: Column, part: Callable[[Column, Column, Column], Column], unit: int) -> list[Column]:
    """Keys of the halves that a line would share with a neighbour, the longer of both having n or n + 1 words.

    part(line, start, length) cuts the line. The lowest bits of a key tell which half it is (0, 1) and the unit (0: words, 2: characters).
    """
    keys = []
    for m in (n, n + 1):
        h = F.floor(m / 2).cast("int")
        tail = (m - h).cast("int")
        for side, half in enumerate((part(line, F.lit(1), h), part(line, F.greatest(n - tail + 1, F.lit(1)), tail))):
            keys.append(F.xxhash64(m, half).bitwiseAND(F.lit(-4)).bitwiseOR(F.lit(unit + side)))
    return keys


def within_one(a: Column, b: Column) -> Column:
    """Whether two word sequences are equal or differ by one word put in, left out or replaced."""
    first = F.size(a) <= F.size(b)
    shorter, longer = F.when(first, a).otherwise(b), F.when(first, b).otherwise(a)
    n, m = F.size(shorter), F.size(longer)
    at = F.array_position(F.zip_with(shorter, F.slice(longer, F.lit(1), n), lambda x, y: x == y), False).cast("int")
    head = F.when(at == 0, n).otherwise(at - 1)
    rest = F.slice(longer, head + 2, m + 1)
    return (m - n <= 1) & (rest == F.slice(shorter, F.when(n == m, head + 2).otherwise(head + 1), m + 1))


def _lines(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Per line that has a word: doc_id, row (hash of the text), at (number of the line, from 0), line (plain)."""
    own = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("row"), plain(F.col(text)).alias("text"))
    return own.select("doc_id", "row", F.posexplode(F.split("text", "\n")).alias("at", "line")).where(F.trim("line") != "")


def hashed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per line that has a word: doc_id, row, at, a and b (128 bits of hash of the words), h0 to h3 (keys of halves; null for lines of fewer than LEAST_WORDS), c0 to c3 (the same of characters; null for lines of more than LEAST_WORDS, or fewer characters than LEAST_CHARS)."""
    own = _lines(docs, doc_id, text).select("doc_id", "row", "at", folded(F.col("line")).alias("w"))
    own = own.select("doc_id", "row", "at", "w", F.size("w").alias("n"))
    # one edit makes eight words of seven: lines of just LEAST_WORDS are compared both ways
    own = own.withColumn("c", F.when(F.col("n") <= LEAST_WORDS, F.array_join("w", " ")))
    halves = [F.when(F.col("n") >= LEAST_WORDS, key).alias(f"h{i}") for i, key in enumerate(_halves(F.col("w"), F.col("n"), F.slice, 0))]
    halves += [F.when(F.length("c") >= LEAST_CHARS, key).alias(f"c{i}") for i, key in enumerate(_halves(F.col("c"), F.length("c"), F.substring, 2))]
    return own.select("doc_id", "row", "at", F.xxhash64("w").alias("a"), F.xxhash64(F.lit(1), "w").alias("b"), *halves)


def _met(docs: DataFrame, names: DataFrame, doc_id: str, text: str) -> DataFrame:
    """Lines that share a half with a different line: id (in the order of first places), a, b, chars (whether by characters), fore, aft (the half they share), w (words or characters)."""
    halves = [f"{unit}{i}" for unit in "hc" for i in range(4)]
    keys = names.where("h0 is not null or c0 is not null").select("a", F.explode(F.array(*halves)).alias("key")).where("key is not null")
    shared = keys.groupBy("key").agg(F.min("a").alias("least"), F.max("a").alias("most")).where("least < most").select("key")
    side, unit = _sides("key")
    sides = keys.join(shared, "key").groupBy("a", (unit == 2).alias("chars")).agg((F.min(side) == 0).alias("fore"), (F.max(side) == 1).alias("aft"))
    firsts = names.select("a", "b", "first").join(sides, "a")
    firsts = stored(firsts.orderBy("first").select(F.monotonically_increasing_id().alias("id"), "a", "b", "chars", "fore", "aft", F.col("first.doc_id").alias("d"), F.col("first.row").alias("r"), F.col("first.at").alias("t")), "met")
    texts = stored(bit_filter(firsts, F.xxhash64("r")), "bits")
    bits = stored(bit_filter(firsts, F.xxhash64("d", "r", "t")), "bits")
    some = flagged(docs.select(doc_id, text), F.xxhash64(F.xxhash64(text)), texts, "__line_some").where("__line_some").drop("__line_some")
    every = flagged(_lines(some, doc_id, text).withColumn("place", F.xxhash64("doc_id", "row", "at")), F.col("place"), bits, "maybe").where("maybe")
    found = every.join(firsts, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")) & (F.col("at") == F.col("t")))
    # rows that repeat a document have the same lines
    found = found.groupBy("id").agg(*[F.first(c).alias(c) for c in ("a", "b", "chars", "fore", "aft", "line")]).withColumn("w", folded(F.col("line")))
    return stored(found.select("id", "a", "b", "chars", "fore", "aft", F.when(F.col("chars"), _chars(F.col("w"))).otherwise(F.col("w")).alias("w")), "words")


def near(docs: DataFrame, names: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """a, b of lines that come within one word, or one character, of a different line that is earlier. names: as in repeated()."""
    met = _met(docs, names, doc_id, text)
    word = met.select("id", "chars", "fore", "aft", F.size("w").alias("n"), F.posexplode("w").alias("j", "word"))
    word = word.select("id", "chars", "fore", "aft", "n", "j", F.xxhash64("j", "word").alias("before_"), F.xxhash64(F.col("n") - F.col("j"), "word", F.lit(1)).alias("after_"))
    so_far = Window.partitionBy("id").orderBy("j").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    word = word.withColumns({"upto": F.bit_xor("before_").over(so_far), "beyond": F.bit_xor("after_").over(so_far), "all": F.bit_xor("after_").over(Window.partitionBy("id"))})
    half = F.floor(F.col("n") / 2)
    word = word.where((F.col("fore") & (F.col("j") >= half)) | (F.col("aft") & (F.col("j") <= half)))
    before, after = F.col("upto").bitwiseXOR(F.col("before_")), F.col("all").bitwiseXOR(F.col("beyond"))
    gap, left_out = F.xxhash64(before, after.bitwiseXOR(F.col("after_")), "chars"), F.xxhash64(before, after, "chars")
    end = F.when(F.col("j") + 1 == F.col("n"), F.xxhash64("upto", F.lit(0).cast("long"), "chars"))
    keys = stored(word.select("id", F.explode(F.array(gap, left_out, end)).alias("key")).where("key is not null"), "variants")
    earliest = keys.groupBy("key").agg(F.min("id").alias("earlier"), F.max("id").alias("last")).where("earlier < last").drop("last")
    pairs = keys.join(earliest, "key").where("earlier < id").select("id", "earlier").distinct()
    pairs = pairs.join(met.select("id", "a", "b", "w"), "id").join(met.select(F.col("id").alias("earlier"), F.col("w").alias("x")), "earlier")
    return pairs.where(within_one(F.col("w"), F.col("x"))).select("a", "b").distinct()


def repeated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document with lines that go: doc_id, row (hash of its text), gone (their numbers).

    A line goes if an earlier one equals it or comes within one word of it, or, where one of the two has
    fewer than LEAST_WORDS words and both have LEAST_CHARS characters, within one character of it. Earlier is by doc_id (null
    first), hash of the text, and place in the text; an earlier line counts whether or not it goes itself.
    Case and white space make no difference; lines without words never go. Null and empty texts have no lines. Rows that are
    equal in doc_id and text are one document. A very long line is a line like others, its variants are hashes;
    an empty table gives no rows; other columns are left out.
    """
    every = stored(hashed(docs, doc_id, text), "lines")
    place = F.struct("doc_id", "row", "at")
    code = F.xxhash64("doc_id", "row", "at")
    names = every.groupBy("a", "b").agg(F.min(place).alias("first"), (F.min(code) != F.max(code)).alias("several"), F.count("*").alias("times"), *[F.first(f"{unit}{i}").alias(f"{unit}{i}") for unit in "hc" for i in range(4)])
    names = stored(names, "names")
    close = near(docs, names, doc_id, text).withColumn("close", F.lit(True))
    # of lines that occur once and have no near one earlier, nothing goes
    firsts = names.select("a", "b", "first", "several", "times").join(close, ["a", "b"], "left").where("close or several").select("a", "b", "first", "times", F.coalesce("close", F.lit(False)).alias("close"))
    firsts, rows = stored(firsts, "firsts"), every.select("doc_id", "row", "at", "a", "b")
    hot = F.broadcast(firsts.where(F.col("times") * HOT > every.count()))  # fewer than HOT rows
    cold = rows.join(hot.select("a", "b"), ["a", "b"], "left_anti").join(firsts, ["a", "b"])
    gone = rows.join(hot, ["a", "b"]).unionByName(cold).where(F.col("close") | ~place.eqNullSafe(F.col("first")))
    return gone.groupBy("doc_id", "row").agg(F.collect_set("at").alias("gone"))


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", n_chars: str = "n_chars", count: str | None = None) -> DataFrame:
    """docs without the lines of repeated().

    A document all of whose lines with words go, goes as a whole. Other documents stay, those with null
    or empty text as they are. All columns are kept; ``n_chars``, where there is such a column, follows
    the text. With ``count``, no document goes and a column of that name has the number of lines that
    went (0 for the others). Rows that repeat each other lose the same lines; very long texts are taken as
    a whole; an empty table stays empty; columns beginning with __line_ are this function's own.
    """
    mark = len(made())
    gone = stored(repeated(docs, doc_id, text).withColumnsRenamed({"doc_id": "__line_id", "row": "__line_row", "gone": "__line_gone"}), "gone")
    drop_since(docs.sparkSession, mark, gone)
    bits = stored(bit_filter(gone, F.xxhash64("__line_row")), "bits")
    own = flagged(docs.withColumn("__line_text", F.xxhash64(text)), F.xxhash64("__line_text"), bits, "__line_maybe")
    same = F.col(doc_id).eqNullSafe(F.col("__line_id")) & (F.col("__line_text") == F.col("__line_row"))
    places = F.array_except(F.sequence(F.lit(0), F.size("__line_parts") - 1), F.col("__line_gone"))
    rest = F.when(F.col("__line_gone").isNull(), F.col(text)).otherwise(F.array_join(F.transform(places, lambda k: F.get("__line_parts", k)), "\n"))
    some = own.where("__line_maybe").join(gone, same, "left").withColumn("__line_parts", F.split(text, "\n")).withColumn("__line_rest", rest)
    if count is None:
        some = some.where(F.col("__line_gone").isNull() | F.col("__line_rest").rlike(HAS_WORD))
    changed = {text: F.col("__line_rest")} | ({n_chars: F.when(F.col("__line_gone").isNull(), F.col(n_chars)).otherwise(F.length("__line_rest").cast(docs.schema[n_chars].dataType))} if n_chars in docs.columns else {})
    some = some.withColumns(changed)
    rest = own.where("not __line_maybe")
    if count is not None:
        some, rest = some.withColumn(count, F.coalesce(F.size("__line_gone"), F.lit(0)).cast("long")), rest.withColumn(count, F.lit(0).cast("long"))
    columns = docs.columns + ([count] if count else [])
    return rest.select(*columns).unionByName(some.select(*columns))


def counted(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_lines (with words), n_removed, n_kept_bytes, kept_sha256 (of the UTF-8 of the text left; null: of nothing).

    Rows that repeat each other have equal results; an empty table gives no rows; other columns are left out; the
    rest is as in repeated().
    """
    own = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).withColumn("n_lines", F.size(F.filter(F.split(F.coalesce("text", F.lit("")), "\n"), lambda x: x.rlike(HAS_WORD))).cast("long"))
    left = F.coalesce("text", F.lit(""))
    return deduplicated(own, "doc_id", "text", count="n_removed").select("doc_id", "n_lines", "n_removed", F.octet_length(left).cast("long").alias("n_kept_bytes"), F.sha2(left, 256).alias("kept_sha256"))
