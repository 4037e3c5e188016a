"""Near-duplicate detection: banded MinHash, odd sketches, and links confirmed on the full shingle sets.

Documents with equal shingle sets are one class, and only classes are compared. Classes that share a
band of their MinHash signature meet in a bucket, in which all are compared with one of them, the pivot:
a bucket of n copies costs n pairs, not n squared. A pair has to pass the odd sketches of its two
classes (bitmaps that hold the parity of hashed MinHash samples; the population count of their XOR grows
with the number of samples that differ) before its texts are read. Buckets that still hold several
components are searched once more, by their rarest shingles, for links that no pivot has seen.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import drop_since, frugal, made, stored

#: 1 - (1 - s**ROWS)**BANDS of the pairs of similarity s share a bucket: all but 6e-11 at 0.85, all but 5e-8 at 0.8.
BANDS, ROWS = 32, 4
SAMPLES = BANDS * ROWS
#: Bits of an odd sketch, in words of 64.
SKETCH_WORDS = 8
#: Shingles that make up at least one in so many of all are joined without a shuffle; there are no more of them than that.
COMMON = 1000
#: Shingles of sets that a worker keeps while it compares pairs, before it forgets them.
MOST_KEPT = 50_000

_MIX1, _MIX2, _STEP = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB), np.uint64(0x9E3779B97F4A7C15)


def _mix(h: np.ndarray) -> np.ndarray:
    """The finaliser of splitmix64."""
    h = (h ^ (h >> np.uint64(30))) * _MIX1
    h = (h ^ (h >> np.uint64(27))) * _MIX2
    return h ^ (h >> np.uint64(31))


_XOR = _mix(np.arange(1, SAMPLES + 1, dtype=np.uint64) * _STEP)
_MUL = _mix(np.arange(1001, SAMPLES + 1001, dtype=np.uint64) * _STEP) | np.uint64(1)


def words(text: str | None) -> list[bytes]:
    """The words [^\\x20\\x09-\\x0D]+ of the text with A-Z in lower case, as UTF-8. Null has none."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(text: str | None, k: int) -> set[bytes]:
    """Distinct runs of k words; fewer words are one shingle, none no shingle."""
    ws = words(text)
    return {b" ".join(ws[i : i + k]) for i in range(max(1, len(ws) - k + 1))} if ws else set()


def hashed(text: str | None, k: int) -> np.ndarray:
    """Hashes of the distinct shingles, sorted."""
    ws = words(text)
    if not ws:
        return np.empty(0, dtype=np.uint64)
    h = np.fromiter(map(xxhash.xxh3_64_intdigest, ws), dtype=np.uint64, count=len(ws))
    size = min(k, len(ws))
    s = np.full(len(ws) - size + 1, size, dtype=np.uint64)
    for i in range(size):
        s = _mix(s + h[i : len(h) - size + 1 + i] + _STEP)
    return np.unique(s)


def signature(s: np.ndarray) -> np.ndarray:
    low = np.full(SAMPLES, np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(s), 4096):
        np.minimum(low, ((s[at : at + 4096, None] ^ _XOR) * _MUL).min(axis=0), out=low)
    return low


def bands(low: np.ndarray) -> np.ndarray:
    h = np.arange(1, BANDS + 1, dtype=np.uint64)
    for row in low.reshape(BANDS, ROWS).T:
        h = _mix(h * _STEP + row)
    return h.view(np.int64)


def odd_sketch(low: np.ndarray) -> np.ndarray:
    """Each MinHash sample, with its place in the signature, turns over one bit."""
    at = (_mix(low + np.arange(1, SAMPLES + 1, dtype=np.uint64) * _STEP) % np.uint64(64 * SKETCH_WORDS)).astype(np.int64)
    odd = (np.bincount(at, minlength=64 * SKETCH_WORDS) & 1).astype(np.uint8)
    return np.packbits(odd, bitorder="little").view(np.int64)


def most_bits(share: float) -> int:
    """Bits that the sketches of two sets of at least this similarity differ in at most (six standard deviations of the samples allowed)."""
    return math.ceil(2 * (SAMPLES * (1 - share) + 6 * math.sqrt(SAMPLES * share * (1 - share))))


def linked(a: set[bytes], b: set[bytes], percent: int) -> bool:
    both = len(a & b)
    return 100 * both >= percent * (len(a) + len(b) - both)


def components(edges: DataFrame) -> DataFrame:
    """Smallest member of the component, for each end of the edges (u, v): id, root. Large and small stars in turn (Kiveris et al., 2014)."""
    mark, spark, before = len(made()), edges.sparkSession, None
    edges = stored(edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v").distinct(), "edges")
    while True:
        # every larger neighbour of u goes to the smallest one
        both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy("u").agg(F.least(F.min("v"), F.first("u")).alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()
        # u and its smaller neighbours go to the smallest one
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionByName(least.withColumnRenamed("m", "v")).where("u != v").distinct()
        edges = stored(small, "edges")
        drop_since(spark, mark, edges)
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.select(F.col("u").alias("id"), F.col("v").alias("root")).unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("root"))).distinct()
        before = now


def signed(docs: DataFrame, k: int, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, row (hash of the text), n (shingles), digest (of the set), bands, s0 to s7 (odd sketch)."""
    kind = docs.schema[doc_id].dataType.simpleString()
    sketch = [f"s{i}" for i in range(SKETCH_WORDS)]

    def run(batches):
        for batch in batches:
            sizes, digests, keys, odd = [], [], [], []
            for t in batch.column(2).to_pylist():
                s = hashed(t, k)
                low = signature(s)
                sizes.append(len(s))
                digests.append(xxhash.xxh3_128_digest(s.tobytes()))
                keys.append(bands(low))
                odd.append(odd_sketch(low))
            odd = np.array(odd, dtype=np.int64).reshape(-1, SKETCH_WORDS)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(sizes, pa.int64()), pa.array(digests, pa.binary()), pa.array(keys, pa.list_(pa.int64())), *(pa.array(odd[:, i]) for i in range(SKETCH_WORDS))], names=["doc_id", "row", "n", "digest", "bands", *sketch])

    rows = docs.select(F.col(doc_id).alias("doc_id"), F.xxhash64(text).alias("row"), F.col(text).alias("text"))
    return rows.mapInArrow(frugal(run), f"doc_id {kind}, row long, n long, digest binary, bands array<long>, {', '.join(f'{s} long' for s in sketch)}")


def _texts(docs: DataFrame, wanted: DataFrame, k: int, doc_id: str, text: str) -> DataFrame:
    """rid and compressed text of the wanted classes (rid, doc_id, digest)."""

    def squeeze(batches):
        pack = zstandard.ZstdCompressor(level=3)
        for batch in batches:
            z = [pack.compress((t or "").encode("utf-8", "surrogatepass")) for t in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(z, pa.binary())], names=["doc_id", "z"])

    def right(batches):  # several rows may have the doc_id
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            own = [xxhash.xxh3_128_digest(hashed(unpack.decompress(z).decode("utf-8", "surrogatepass"), k).tobytes()) for z in batch.column(2).to_pylist()]
            yield batch.select(["rid", "z"]).filter(pa.array([a == b for a, b in zip(own, batch.column(1).to_pylist(), strict=True)], pa.bool_()))

    kind = docs.schema[doc_id].dataType.simpleString()
    z = docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(frugal(squeeze), f"doc_id {kind}, z binary")
    met = z.join(wanted.withColumnRenamed("doc_id", "d"), F.col("doc_id").eqNullSafe(F.col("d"))).select("rid", "digest", "z")
    return met.mapInArrow(frugal(right), "rid long, z binary").dropDuplicates(["rid"])


def _confirmed(pairs: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """The pairs (u, v) with ok: whether the full sets are linked."""

    def run(batches):
        unpack = zstandard.ZstdDecompressor()
        kept: dict[int, set[bytes]] = {}

        def of(rid: int, z: bytes) -> set[bytes]:
            if rid not in kept:
                if sum(map(len, kept.values())) > MOST_KEPT:
                    kept.clear()
                kept[rid] = shingles(unpack.decompress(z).decode("utf-8", "surrogatepass"), k)
            return kept[rid]

        for batch in batches:
            u, v, zu, zv = (batch.column(c).to_pylist() for c in ("u", "v", "zu", "zv"))
            yield pa.RecordBatch.from_arrays([batch.column("u"), batch.column("v"), pa.array([linked(of(a, x), of(b, y), percent) for a, b, x, y in zip(u, v, zu, zv, strict=True)], pa.bool_())], names=["u", "v", "ok"])

    met = pairs.join(texts.select(F.col("rid").alias("u"), F.col("z").alias("zu")), "u").join(texts.select(F.col("rid").alias("v"), F.col("z").alias("zv")), "v")
    return met.select("u", "v", "zu", "zv").mapInArrow(frugal(run), "u long, v long, ok boolean")


def _least_shared(n: Column, percent: int) -> Column:
    """Shingles that a set of n must share with any set it is linked with, at least."""
    return F.ceil(n * percent / 100 - 1e-9)


def _residual(members: DataFrame, roots: DataFrame, texts: DataFrame, k: int, percent: int) -> DataFrame:
    """Pairs (u, v) of classes of one bucket that may be linked though no pivot has linked them.

    Only classes of buckets that hold several components are left. Their shingles are put in order of
    their frequency among these classes, rarest first. Linked sets share a shingle among the first few of
    each, and from the first one they share on there must be enough of either set left; so an edited copy
    whose own edits are rare meets nothing but what shares these edits.
    """

    def explode(batches):
        unpack = zstandard.ZstdDecompressor()
        for batch in batches:
            sets = [hashed(unpack.decompress(z).decode("utf-8", "surrogatepass"), k).view(np.int64) for z in batch.column("z").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("rid"), batch.column("c"), pa.array(sets, pa.list_(pa.int64()))], names=["rid", "c", "gs"])

    own = members.select("key", "rid").join(roots.withColumnRenamed("id", "rid"), "rid", "left").select("key", "rid", F.coalesce("root", "rid").alias("c"))
    mixed = own.groupBy("key").agg(F.min("c").alias("a"), F.max("c").alias("b")).where("a < b").select("key")
    left = own.join(mixed, "key").select("rid", "c").distinct()
    sets = stored(left.join(texts, "rid").select("rid", "c", "z").mapInArrow(frugal(explode), "rid long, c long, gs array<long>"), "sets")
    often = stored(sets.select(F.explode("gs").alias("g")).groupBy("g").agg(F.count("*").alias("df")).where("df > 1"), "often")
    every = sets.select("rid", "c", F.size("gs").alias("n"), F.explode("gs").alias("g"))
    total = sets.agg(F.coalesce(F.sum(F.size("gs")), F.lit(0))).first()[0]
    common = F.broadcast(often.where(F.col("df") * COMMON > total))  # fewer than COMMON rows
    known = every.join(common, "g").unionByName(every.join(common.select("g"), "g", "left_anti").join(often, "g"))
    # shingles that no other class has come before all others
    every, order = Window.partitionBy("rid"), Window.partitionBy("rid").orderBy("df", "g")
    placed = known.withColumns({"nth": F.row_number().over(order), "known": F.count("*").over(every)}).withColumn("before", F.col("n") - F.col("known") + F.col("nth") - 1)
    first = stored(placed.where(F.col("before") <= F.col("n") - _least_shared(F.col("n"), percent)).select("g", "rid", "c", "n", "before"), "prefixes")
    sizes = first.groupBy("g", "c").agg(F.count("*").alias("size"))
    several = sizes.groupBy("g").agg(F.count("*").alias("parts"), F.max_by("c", F.struct("size", "c")).alias("largest")).where("parts > 1").select("g", "largest")
    # sizes of linked sets differ by percent at most: they lie in one band or in bands that touch
    band = F.floor(F.log(F.col("n").cast("double")) / math.log(100 / percent) + 1e-9) if percent < 100 else F.col("n")
    met = first.join(several, "g").withColumn("band", band)
    turn = met.where("c != largest").select("g", F.explode(F.array(*[F.col("band") + d for d in (-1, 0, 1)])).alias("band_"), *[F.col(x).alias(f"{x}_") for x in ("rid", "c", "n", "before")])
    enough = F.least(F.col("n") - F.col("before"), F.col("n_") - F.col("before_")) * (100 + percent) >= (F.col("n") + F.col("n_")) * percent
    once = (F.col("c") == F.col("largest")) | (F.col("rid") < F.col("rid_"))
    pairs = met.join(turn, (met["g"] == turn["g"]) & (F.col("band") == F.col("band_")) & (F.col("c") != F.col("c_")) & once & enough)
    return pairs.select(F.least("rid", "rid_").alias("u"), F.greatest("rid", "rid_").alias("v")).distinct()


def classes(docs: DataFrame, k: int, percent: int, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(per document: doc_id, row, n, digest; per set of shingles: digest, component_id, head).

    component_id is the smallest doc_id of the component (null if all are null), head whether that
    document is of this class. Documents without words are in no class.
    """
    mark = len(made())
    sigs = stored(signed(docs, k, doc_id, text), "signed")
    sketch = [f"s{i}" for i in range(SKETCH_WORDS)]
    reps = sigs.where("n > 0").groupBy("digest").agg(F.min("doc_id").alias("doc_id"), *[F.first(c).alias(c) for c in ("n", "bands", *sketch)])
    reps = stored(reps.withColumn("rid", F.monotonically_increasing_id()), "classes")
    members = reps.select("rid", F.explode("bands").alias("key"))
    several = members.groupBy("key").agg(F.count("*").alias("size")).where("size > 1")
    members = stored(members.join(several, "key"), "buckets")
    # The pivot of a bucket is the member with the fullest buckets: what most others are copies of.
    central = members.groupBy("rid").agg(F.sum("size").alias("met"))
    texts = stored(_texts(docs, reps.select("rid", "doc_id", "digest").join(central.select("rid"), "rid"), k, doc_id, text), "texts")
    pivots = members.join(central, "rid").groupBy("key").agg(F.max_by("rid", F.struct("met", -F.col("rid"))).alias("pivot"))
    pairs = members.join(pivots, "key").where("rid != pivot").select(F.least("rid", "pivot").alias("u"), F.greatest("rid", "pivot").alias("v")).distinct()

    sides = [reps.select(F.col("rid").alias(x), F.col("n").alias(f"n{x}"), *[F.col(s).alias(f"{s}{x}") for s in sketch]) for x in "uv"]
    differ = sum((F.bit_count(F.col(f"{s}u").bitwiseXOR(F.col(f"{s}v"))) for s in sketch), F.lit(0))
    close = (F.least("nu", "nv") * 100 >= F.greatest("nu", "nv") * percent) & (differ <= most_bits(percent / 100))
    near = pairs.join(sides[0], "u").join(sides[1], "v").where(close).select("u", "v")
    links = stored(_confirmed(near, texts, k, percent).where("ok").select("u", "v"), "links")
    roots = components(links)
    more = stored(_confirmed(_residual(members, roots, texts, k, percent), texts, k, percent).where("ok").select("u", "v"), "links")
    if not more.isEmpty():
        roots = components(more.unionByName(roots.select(F.col("id").alias("u"), F.col("root").alias("v"))))
    heads = stored(_heads(reps, roots), "heads")
    drop_since(docs.sparkSession, mark, sigs, heads)
    return sigs.select("doc_id", "row", "n", "digest"), heads


def _heads(reps: DataFrame, roots: DataFrame) -> DataFrame:
    own = reps.select("rid", "digest", "doc_id").join(roots.withColumnRenamed("id", "rid"), "rid", "left").select("digest", "doc_id", F.coalesce("root", "rid").alias("root"))
    # nulls count as larger than any id; of classes with one smallest id, the first by digest heads the component
    first = own.groupBy("root").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "digest")).alias("first"))
    return own.join(first, "root").select("digest", F.col("first.doc_id").alias("component_id"), (F.col("first.digest") == F.col("digest")).alias("head"))


def near_duplicates(docs: DataFrame, k: int = 3, percent: int = 85, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_shingles, component_id, kept (doc_id is component_id).

    Documents are linked where 100 * |A and B| >= percent * |A or B| for their sets of k-word shingles.
    Without words (null, empty, white space) a document is linked with nothing. Rows that repeat a
    document are linked with it and, having its doc_id, are kept with it; a null doc_id is larger than
    all others, and kept where nothing else is in its component. Very long texts are compared as whole
    sets; an empty table gives no rows; other columns are left out, whatever their names.
    """
    rows, found = classes(docs, k, percent, doc_id, text)
    out = rows.join(found.withColumnRenamed("digest", "class"), (F.col("digest") == F.col("class")) & (F.col("n") > 0), "left")
    out = out.select("doc_id", F.col("n").alias("n_shingles"), F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("doc_id")).alias("component_id"))
    return out.withColumn("kept", F.col("doc_id").eqNullSafe(F.col("component_id")))


def deduplicated(docs: DataFrame, k: int = 5, percent: int = 80, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """docs with one document of each component: the one with the smallest doc_id.

    Documents without words stay. Rows that are equal in doc_id and text are one document and stay or go
    together; all columns are kept, but none may begin with __near_. Very long texts are compared as whole
    sets; an empty table stays empty.
    """
    rows, found = classes(docs, k, percent, doc_id, text)
    out = rows.where("n > 0").join(found, "digest")
    gone = out.where(~(F.col("head") & F.col("doc_id").eqNullSafe(F.col("component_id")))).select(F.col("doc_id").alias("__near_id"), F.col("row").alias("__near_row")).distinct()
    same = F.col(doc_id).eqNullSafe(F.col("__near_id")) & (F.xxhash64(text) == F.col("__near_row"))
    return docs.join(gone, same, "left_anti")
