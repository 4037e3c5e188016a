"""Document fingerprints: an exact digest of a canonical text.

The canonical text is NFKC-normalised, case-folded and has its white space folded. Its fingerprint is
128 bits of xxhash. Buckets of equal hashes are compared byte by byte (as a grouping on the canonical
bytes, which Spark aggregates before the shuffle, so a text that fills a third of the table reaches a
task once per partition that holds it); different texts in one bucket get different suffixes.
"""

from __future__ import annotations

import hashlib
import unicodedata
from collections.abc import Callable

import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import frugal, stored

#: Bits that say which fingerprints occur more than once; the driver and every executor hold BITS / 8 bytes.
BITS = 1 << 24


def canonical(text: str | None) -> bytes:
    """Null is the empty text. Texts that differ in normalisation form, case or white space only are the same."""
    text = text or ""
    if not text.isascii():
        text = unicodedata.normalize("NFKC", unicodedata.normalize("NFKC", text).casefold())
    else:
        text = text.lower()
    return " ".join(text.split()).encode("utf-8", "surrogatepass")


def digest(canon: bytes) -> str:
    return xxhash.xxh3_128_hexdigest(canon)


def repeated(found: DataFrame) -> bytearray:
    """Bits of the fingerprints that several rows of found have: BITS / 8 bytes, however many rows there are."""
    bit = F.conv(F.substring("fingerprint", 1, 12), 16, 10).cast("long") % BITS
    several = found.groupBy("fingerprint").count().where("count > 1").select((bit + 1).alias("bit"))  # Spark's bitmaps count from 1
    maps = several.groupBy(F.bitmap_bucket_number("bit").alias("bucket")).agg(F.bitmap_construct_agg(F.bitmap_bit_position("bit")).alias("bits"))
    out = bytearray(BITS // 8 + 4096)
    for row in maps.collect():  # at most BITS / 32768 rows of 4 KB
        at = (row["bucket"] - 1) * 4096
        out[at : at + 4096] = row["bits"]
    return out


def collisions(docs: DataFrame, bits: bytearray, text: str = "text", digest_of: Callable[[bytes], str] = digest) -> DataFrame:
    """Canonical texts that share a digest with a different one: digest, canon (compressed), rank (0: the first by bytes).

    bits: as from repeated(); a text whose bit is not set is alone in its bucket and is not compared.
    """
    sent = docs.sparkSession.sparkContext.broadcast(bytes(bits))

    def run(batches):
        pack, there = zstandard.ZstdCompressor(level=3), sent.value
        for batch in batches:
            digests, canons = [], []
            for t in batch.column(0).to_pylist():
                d = digest_of(canon := canonical(t))
                bit = int(d[:12], 16) % BITS
                if there[bit >> 3] >> (bit & 7) & 1:
                    digests.append(d)
                    canons.append(pack.compress(canon))
            yield pa.RecordBatch.from_arrays([pa.array(digests, pa.string()), pa.array(canons, pa.binary())], names=["digest", "canon"])

    # equal compressed bytes have equal contents, and one version of the compressor gives equal bytes for equal contents
    texts = docs.select(F.col(text).alias("text")).mapInArrow(frugal(run), "digest string, canon binary").distinct()
    several = texts.groupBy("digest").agg(F.min("canon").alias("first"), F.max("canon").alias("last")).where("first < last").select("digest")
    rank = F.row_number().over(Window.partitionBy("digest").orderBy("canon")) - 1
    return texts.join(several, "digest").select("digest", "canon", rank.alias("rank"))


def neighbours(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest_of: Callable[[bytes], str] = digest, contents: bool = False) -> DataFrame:
    """Per document, by ascending doc_id (null first; equal ids by length of text): doc_id, n_chars, edited_sha256,
    fingerprint, edited_fingerprint, near_edited, near_next.

    The edited text has its last floor(n_chars / 2) code points replaced by the first as many, or all, of
    the next document; after the last comes the first. A document alone is its own next. Texts meet their
    neighbours through one range shuffle of compressed texts; the last text of each partition meets the
    first of the following one in a join of one row a partition. With contents, there are also content
    and edited_content, SHA-256 of the canonical texts.
    """
    kind = docs.schema[doc_id].dataType.simpleString()
    result = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double" + ", content string, edited_content string" * contents

    def squeeze(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            texts = [(t or "") for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([len(t) for t in texts], pa.int64()), pa.array([pack.compress(t.encode("utf-8", "surrogatepass")) for t in texts], pa.binary())], names=["doc_id", "n_chars", "z"]
            )

    def judged(own: str, following: str) -> tuple:
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        canon, changed = canonical(own), canonical(edited)
        return len(own), hashlib.sha256(edited.encode("utf-8", "surrogatepass")).hexdigest(), digest_of(canon), digest_of(changed), float(canon == changed), float(canon == canonical(following)), *([hashlib.sha256(c).hexdigest() for c in (canon, changed)] if contents else [])

    def rows(batches):
        """Of each partition: finished rows, its first text (edge 0) and its last (edge 1) with the place of the partition."""
        from pyspark import TaskContext

        place, unpack = TaskContext.get().partitionId(), zstandard.ZstdDecompressor()
        names = [c.split(" ")[0] for c in result.split(", ")] + ["place", "edge", "z"]
        last = None
        for batch in batches:
            ids, zs = batch.column(0).to_pylist(), batch.column(2).to_pylist()
            out: list[tuple] = []
            for name, z in zip(ids, zs, strict=True):
                own = unpack.decompress(z).decode("utf-8", "surrogatepass")
                if last is None:
                    out.append((name, *[None] * (len(names) - 4), place, 0, z))
                else:
                    out.append((last[0], *judged(last[1], own), None, None, None))
                last = (name, own, z)
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=True)] if out else [pa.array([], f.type) for f in arrow], names=names)
        if last is not None:
            yield pa.RecordBatch.from_arrays([pa.array([v], f.type) for v, f in zip((last[0], *[None] * (len(names) - 4), place, 1, last[2]), arrow, strict=True)], names=names)

    def closing(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            text_of = lambda z: unpack.decompress(z).decode("utf-8", "surrogatepass")
            out = [(name, *judged(text_of(z), text_of(following))) for name, z, following in zip(*(batch.column(k).to_pylist() for k in range(3)), strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), arrow, strict=False)] if out else [pa.array([], f.type) for f in list(arrow)[:-3]], names=[f.name for f in list(arrow)[:-3]])

    from pyspark.sql.pandas.types import to_arrow_schema

    squeezed = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(frugal(squeeze), f"doc_id {kind}, n_chars long, z binary")
    shape = docs.sparkSession.createDataFrame([], f"{result}, place int, edge int, z binary").schema
    arrow = to_arrow_schema(shape)
    ordered = squeezed.repartitionByRange("doc_id", "n_chars").sortWithinPartitions("doc_id", "n_chars", "z")
    found = stored(ordered.mapInArrow(frugal(rows), shape), "neighbours")
    heads = found.where("edge = 0").select(F.col("place").alias("at"), F.col("z").alias("following"))
    # a row for each partition: the number of partitions is no larger than the tasks of one stage
    order = heads.select("at", F.lead("at").over(Window.orderBy("at")).alias("then"), F.first("at").over(Window.orderBy("at")).alias("start"))
    turn = order.select(F.col("at").alias("place"), F.coalesce("then", "start").alias("at"))
    tails = found.where("edge = 1").select("doc_id", "z", "place").join(turn, "place").join(heads, "at").select("doc_id", "z", "following")
    return found.where("edge is null").select(*[c.split(" ")[0] for c in result.split(", ")]).unionByName(tails.mapInArrow(closing, result))


def fingerprints(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", digest_of: Callable[[bytes], str] = digest) -> DataFrame:
    """neighbours(), with suffixes on fingerprints whose digest belongs to several canonical texts of docs; an edited text gets the suffix of the text that it equals.

    Equal texts always have equal fingerprints. near_edited and near_next compare the canonical bytes
    themselves: 1.0 for equal ones, else 0.0; an exact digest knows no degrees between. Long texts are
    fingerprinted as a whole; rows that repeat each other are documents of their own; other columns are
    left out; an empty table gives no rows.
    """
    found = neighbours(docs, doc_id, text, digest_of)
    several = stored(collisions(docs, repeated(found), text, digest_of), "collisions")
    if several.isEmpty():  # as good as always: 128 bits
        return found
    unpack = F.pandas_udf(lambda z: z.map(lambda x: hashlib.sha256(zstandard.ZstdDecompressor().decompress(x)).hexdigest()), "string")
    ranks = stored(several.where("rank > 0").select("digest", unpack("canon").alias("text_of"), "rank"), "ranks")
    out = neighbours(docs, doc_id, text, digest_of, contents=True)
    for name, content in (("fingerprint", "content"), ("edited_fingerprint", "edited_content")):
        own = ranks.withColumnsRenamed({"digest": name, "text_of": content})
        out = out.join(own, [name, content], "left").withColumn(name, F.concat_ws("-", name, F.col("rank").cast("string"))).drop("rank")
    return out.select(*found.columns)
