"""Removal of repeated byte strings by distributed prefix doubling over sampled positions.

A string of ``length`` (100) bytes that also starts earlier is removed. Ranking every position of a
corpus would shuffle many times its size, so the first rounds rank a sample that loses nothing: of the
69 strings of 32 bytes inside a window of 100 the one with the least hash is its anchor. Equal windows
have equal anchors at equal places, and an anchor speaks for the run of windows that chose it.

* First round, offset 32: anchors are sorted by (rank of their 32 bytes, rank of all that their run
  covers). A rank that is unique is done. Runs equal to an earlier one are removed as a whole.
* The same sort compares what reaches to 78 bytes, in three parts of a run; parts whose rank is unique
  at that length are done.
* Last round, past the threshold: single windows of the parts that are left are sorted by pairs of
  ranks, that of 64 bytes at the position and that of 64 bytes at offset 36.

Ranks are 64-bit hashes made by doubling (that of 2h bytes from those of h bytes at offsets 0 and h);
what is compared has at least two of them. Rows of a rank that are equal within a batch are merged
before the shuffle, and a rank with many different runs in a batch, or with very many rows in all, is passed
on to the last round, whose ranks are spread. There equal windows are merged over many batches before the
shuffle, so that a common string comes about once a task.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import bit_filter, drop_since, flagged, frugal, made, stored

#: Bytes of a window, of an anchor, windows of a part of a run, and parts.
WINDOW, GRAM, PART, PARTS = 100, 32, 23, 3
#: Windows that can choose an anchor.
REACH = WINDOW - GRAM + 1
#: Bytes that are ranked at once; texts that are longer are worked on in pieces that overlap by a window.
CHUNK = 1 << 20
#: Different runs of one rank in a batch that are sent to the first round; the others go on at once.
CROWD = 4
#: Rows of one rank that are held at once in the first round; the runs of a rank with more all go on.
HELD = 1 << 17
#: Windows that are merged at once in the last round.
FOLD = 1 << 19

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_A, _B = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F)
_PLACE = np.uint64((1 << 22) - 1)


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _M1
    h = (h ^ (h >> np.uint64(29))) * _M2
    return h ^ (h >> np.uint64(32))


_BYTE = _mix(np.arange(1, 257, dtype=np.uint64) * _A)


def ranks(raw: np.ndarray) -> dict[int, np.ndarray]:
    """Ranks of all strings of 32 and of 64 bytes, by doubling."""
    h, size, out = _BYTE[raw], 1, {}
    while size < 64:
        h = _mix(h[:-size] * _A + h[size:] * _B) if len(h) > size else h[:0]
        size *= 2
        out[size] = h
    return out


def _pair(of: np.ndarray, at: np.ndarray, offset: int) -> np.ndarray:
    return _mix(of[at] * _A + of[at + offset] * _B)


def _least(key: np.ndarray, width: int) -> np.ndarray:
    """Least of each run of width keys."""
    size = 1
    while 2 * size <= width:
        key = np.minimum(key[:-size], key[size:])
        size *= 2
    return np.minimum(key[: len(key) - (width - size)], key[width - size :]) if size < width else key


def runs(raws: list[bytes]) -> dict[str, np.ndarray]:
    """Runs of windows with one anchor: doc (index), start (in the text), rank, name, shape. Texts shorter than a window have none.

    shape, from the lowest bit: anchor less start (7 bits), windows after the first (7), ranks of the parts (16 each).
    """
    parts: list[tuple[int, int, bytes]] = []
    for doc, raw in enumerate(raws):
        if len(raw) >= WINDOW:
            for at in range(0, len(raw) - WINDOW + 1, CHUNK):
                parts.append((doc, at, raw[at : at + CHUNK + WINDOW - 1]))
    out: dict[str, list[np.ndarray]] = {name: [] for name in ("doc", "start", "rank", "name", "shape")}
    done = 0
    while done < len(parts):
        upto, size = done, 0
        while upto < len(parts) and (upto == done or size + len(parts[upto][2]) <= 2 * CHUNK):
            size += len(parts[upto][2])
            upto += 1
        for name, column in _runs(parts[done:upto]).items():
            out[name].append(column)
        done = upto
    return {name: np.concatenate(columns) if columns else np.empty(0, dtype=np.int64) for name, columns in out.items()}


def _runs(parts: list[tuple[int, int, bytes]]) -> dict[str, np.ndarray]:
    raw = np.frombuffer(b"".join(p[2] for p in parts), dtype=np.uint8)
    sizes = np.array([len(p[2]) for p in parts])
    begins = np.cumsum(sizes) - sizes
    of = ranks(raw)
    gram, wide = of[GRAM], of[64]
    least = _least((gram & ~_PLACE) | np.arange(len(gram), dtype=np.uint64), REACH)
    edge = np.zeros(len(raw) + 1, dtype=np.int8)
    edge[begins] += 1
    edge[begins + sizes - WINDOW + 1] -= 1  # no window starts here or later
    at = np.flatnonzero(np.cumsum(edge[: len(least)], dtype=np.int8) > 0)
    anchor = (least[at] & _PLACE).astype(np.int64)
    new = np.flatnonzero(np.concatenate([[True], anchor[1:] != anchor[:-1]]))
    a, s, e = anchor[new], at[new], at[np.append(new[1:], len(at)) - 1]
    ds, span = a - s, e - s
    shape = (ds | span << 7).astype(np.uint64)
    for part in range(PARTS):
        c = np.clip(a - PART * part, 0, len(raw) - 78)  # where the part has no window, its rank is not used
        shape |= (_pair(wide, c, 14) >> np.uint64(48)) << np.uint64(14 + 16 * part)
    name = _mix(_pair(wide, s, 36) * _A + _pair(wide, e, 36) * _B + shape % np.uint64(1 << 14) * _M2)
    which = np.searchsorted(begins, s, side="right") - 1
    docs, offsets = np.array([p[0] for p in parts]), np.array([p[1] for p in parts])
    return {"doc": docs[which], "start": s - begins[which] + offsets[which], "rank": gram[a], "name": name, "shape": shape}


def in_range(shape: np.ndarray, part: int) -> np.ndarray:
    """Whether the run has a window in the part."""
    most = (shape & np.uint64(127)).astype(np.int64)
    least = most - (shape >> np.uint64(7) & np.uint64(127)).astype(np.int64)
    return (least < PART * (part + 1)) & (most >= PART * part)


#: Kinds of rows in the first round, in the highest bits of shape.
_OPEN, _CROWDED, _AGAIN, _ONWARD = (np.uint64(k << 62) for k in range(4))


def _merged(found: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """Mark, within a batch in the order of its documents, what needs no other batch to be decided; such rows get a rank of their own."""
    order = np.lexsort((found["start"], found["doc"], found["name"], found["rank"]))
    out = {name: column[order] for name, column in found.items()}
    rank, name = out["rank"], out["name"]
    new_rank = np.concatenate([[True], rank[1:] != rank[:-1]])
    new_name = new_rank | np.concatenate([[True], name[1:] != name[:-1]])
    group = np.cumsum(new_rank) - 1
    nth = np.cumsum(new_name)
    nth = nth - nth[np.flatnonzero(new_rank)][group]  # of the runs of the rank
    crowded = np.bincount(group, weights=new_name)[group] > CROWD
    kind = np.where(~new_name, _AGAIN, np.where(crowded & (nth >= CROWD), _ONWARD, np.where(crowded, _CROWDED, _OPEN)))
    own = _mix(out["name"] + out["start"].astype(np.uint64) * _A + out["doc"].astype(np.uint64) * _B)
    return out | {"rank": np.where(kind >= _AGAIN, own, rank), "shape": out["shape"] | kind}


def _later(new: np.ndarray, moved: np.ndarray) -> np.ndarray:
    """Of sorted rows, whether one is at another position than the first of its group. new: begins a group; moved: is elsewhere than the row before."""
    steps = np.cumsum(moved | new)
    return steps != steps[np.flatnonzero(new)][np.cumsum(new) - 1]


def _decided(rank: np.ndarray, name: np.ndarray, moved: np.ndarray, shape: np.ndarray, forced: int | None = None) -> np.ndarray:
    """Of rows sorted by rank, name and position: 0 for runs that go, 1 to 7 (bits: parts) for those that go on, -1 for the rest.

    moved: whether the position is another one than that of the row before. forced: a rank whose first runs all go on.
    """
    kind = shape & ~np.uint64((1 << 62) - 1)
    out = np.where(kind == _AGAIN, 0, np.where(kind == _ONWARD, 7, -1))
    own = np.flatnonzero(kind < _AGAIN)
    if not len(own):
        return out
    rank, name, moved, shape, kind = rank[own], name[own], moved[own], shape[own], kind[own]
    new_rank = np.concatenate([[True], rank[1:] != rank[:-1]])
    new_name = new_rank | np.concatenate([[True], name[1:] != name[:-1]])
    first = ~_later(new_name, moved)
    group = np.cumsum(new_rank) - 1
    several = np.bincount(group, weights=new_name)[group] > 1
    crowded = np.bincount(group, weights=kind == _CROWDED)[group] > 0
    if forced is not None:
        crowded |= rank == forced
    parts = np.zeros(len(own), dtype=np.int64)
    open_ = np.flatnonzero(first & several & ~crowded & new_name)
    for part in range(PARTS):
        there = open_[in_range(shape[open_], part)]
        if not len(there):
            continue
        value = shape[there] >> np.uint64(14 + 16 * part) & np.uint64(0xFFFF)
        order = np.lexsort((value, group[there]))
        there, value = there[order], value[order]
        same = (group[there][1:] == group[there][:-1]) & (value[1:] == value[:-1])
        shared = np.concatenate([same, [False]]) | np.concatenate([[False], same])
        parts[there[shared]] |= 1 << part
    parts[first & crowded] = 7
    out[own] = np.where(first, np.where(parts > 0, parts, -1), 0)
    return out


def _sorted(batch: pa.RecordBatch) -> pa.Table:
    """The rows (doc_id, row, text) of a batch by doc_id and row, null first, each document once."""
    table = pa.Table.from_batches([batch])
    table = table.take(pc.sort_indices(table, sort_keys=[("doc_id", "ascending"), ("row", "ascending")], null_placement="at_start"))
    ids, rows = table.column("doc_id").to_pylist(), table.column("row").to_pylist()
    return table.filter(pa.array([not k or (ids[k], rows[k]) != (ids[k - 1], rows[k - 1]) for k in range(len(ids))], pa.bool_()))


def _codes(column: pa.Array) -> np.ndarray:
    return column.dictionary_encode().indices.fill_null(-1).to_numpy(zero_copy_only=False)


def _bytes(text: str | None) -> bytes:
    return (text or "").encode("utf-8", "surrogatepass")


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    """doc_id, row (31 bits of hash of the text, which tell documents with one doc_id apart), text."""
    return docs.select(F.col(doc_id).alias("doc_id"), F.shiftrightunsigned(F.xxhash64(text), 33).alias("row"), F.coalesce(text, F.lit("")).alias("text"))


def anchored(rows: DataFrame, most_held: int = HELD) -> DataFrame:
    """First round. doc_id, at (row and start in one number), ds, span, parts (0: the run goes).

    Of a rank with more than most_held rows only the first of the last run is kept while the rows go by.
    """
    kind = rows.schema["doc_id"].dataType.simpleString()

    def sample(batches):
        for batch in batches:
            table = _sorted(batch)
            found = runs([_bytes(t) for t in table.column("text").to_pylist()])
            if not len(found["doc"]):
                continue
            found = _merged(found)
            at = table.column("row").to_numpy()[found["doc"]] << 32 | found["start"]
            ids = table.column("doc_id").combine_chunks().take(pa.array(found["doc"]))
            yield pa.RecordBatch.from_arrays([pa.array(found["rank"].view(np.int64)), pa.array(found["name"].view(np.int64)), ids, pa.array(at), pa.array(found["shape"].view(np.int64))], names=["rank", "name", "doc_id", "at", "shape"])

    def decide(batches):
        def judged(t: pa.Table, forced: int | None, carried: bool) -> pa.RecordBatch:
            rank, name, at, shape = (t.column(c).to_numpy() for c in ("rank", "name", "at", "shape"))
            ids = _codes(t.column("doc_id").combine_chunks())
            moved = np.concatenate([[True], (at[1:] != at[:-1]) | (ids[1:] != ids[:-1])])
            shape = shape.view(np.uint64)
            parts = _decided(rank, name, moved, shape, forced)
            if carried:  # given out before
                parts[0] = -1
            keep = np.flatnonzero(parts >= 0)
            chosen = t.take(pa.array(keep))
            return pa.RecordBatch.from_arrays(
                [chosen.column("doc_id").combine_chunks(), chosen.column("at").combine_chunks(), *(pa.array(c.astype(np.int32)) for c in (shape[keep] & np.uint64(127), shape[keep] >> np.uint64(7) & np.uint64(127), parts[keep]))],
                names=["doc_id", "at", "ds", "span", "parts"],
            )

        held: list[pa.Table] = []  # rows of the rank that the next batch may go on with
        forced = None  # this rank, once it has had too many rows; then the first row of held is carried on
        for batch in batches:
            if not batch.num_rows:
                continue
            t = pa.Table.from_batches([batch])
            rank = batch.column("rank").to_numpy()
            last = int(np.searchsorted(rank, rank[-1]))
            if last or (held and held[0].column("rank")[0].as_py() != rank[0]):
                yield judged(pa.concat_tables([*held, t.slice(0, last)]).combine_chunks(), forced, forced is not None)
                held, forced = [], None
            held.append(t.slice(last))
            if sum(h.num_rows for h in held) > most_held:
                whole = pa.concat_tables(held).combine_chunks()
                yield judged(whole, int(rank[-1]), forced is not None)
                name, forced = whole.column("name").to_numpy(), int(rank[-1])
                held = [whole.slice(int(np.searchsorted(name, name[-1])), 1)]
        if held:
            yield judged(pa.concat_tables(held).combine_chunks(), forced, forced is not None)

    sampled = rows.mapInArrow(frugal(sample), f"rank long, name long, doc_id {kind}, at long, shape long")
    return sampled.repartition("rank").sortWithinPartitions("rank", "name", "doc_id", "at").mapInArrow(frugal(decide), f"doc_id {kind}, at long, ds int, span int, parts int")


def _row(at: str = "at") -> Column:
    return F.shiftright(F.col(at), 32)


def _start(at: str = "at") -> Column:
    return F.col(at).bitwiseAND(F.lit((1 << 32) - 1))


def _with_texts(rows: DataFrame, marks: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(the documents with marks, those without any): marks has doc_id, row and an array. Only texts that may have marks are shuffled."""
    own = marks.withColumnsRenamed({"doc_id": "d", "row": "r"})
    key = F.xxhash64("doc_id", "row")
    bits = stored(bit_filter(marks.select(key.alias("key")), F.col("key")), "bits")
    every = flagged(rows.withColumn("key", key), F.col("key"), bits, "maybe").drop("key")
    met = every.where("maybe").join(own, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("row") == F.col("r")), "left")
    return met.drop("d", "r", "maybe"), every.where("not maybe").drop("maybe")


def windows(rows: DataFrame, found: DataFrame, fold: int = FOLD) -> DataFrame:
    """Last round. doc_id, row, start of windows that also start earlier, of the runs that the first round passed on. Equal ones of about fold windows are merged before the shuffle."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    marks = found.where("parts > 0").groupBy("doc_id", _row().alias("row")).agg(F.collect_list(F.struct(_start().alias("s"), "ds", "span", "parts")).alias("runs"))
    met, _ = _with_texts(rows, stored(marks, "onward"))

    def folded(held: list[pa.RecordBatch]) -> pa.RecordBatch:
        t = pa.Table.from_batches(held)
        t = t.take(pc.sort_indices(t, sort_keys=[(c, "ascending") for c in ("one", "two", "doc_id", "at")], null_placement="at_start")).combine_chunks()
        one, two, at = (t.column(c).to_numpy() for c in ("one", "two", "at"))
        ids = _codes(t.column("doc_id").combine_chunks())
        new = np.concatenate([[True], (one[1:] != one[:-1]) | (two[1:] != two[:-1])])
        again = _later(new, np.concatenate([[True], (at[1:] != at[:-1]) | (ids[1:] != ids[:-1])]))
        one = np.where(again, _mix(one.view(np.uint64) + at.view(np.uint64) * _A + ids.astype(np.uint64) * _B).view(np.int64), one)
        return pa.RecordBatch.from_arrays([pa.array(one), pa.array(two), t.column("doc_id").combine_chunks(), pa.array(at), pa.array(again)], names=["one", "two", "doc_id", "at", "again"])

    def spread(batches):
        held: list[pa.RecordBatch] = []
        for batch in batches:
            table = _sorted(batch)
            which, starts, ones, twos = [], [], [], []
            for k, (t, own) in enumerate(zip(table.column("text").to_pylist(), table.column("runs").to_pylist(), strict=True)):
                raw = np.frombuffer(_bytes(t), dtype=np.uint8)
                marked = np.zeros(len(raw), dtype=bool)
                for r in own:
                    for part in range(PARTS):
                        if r["parts"] >> part & 1:  # places before the anchor from PART * part on
                            a = r["s"] + r["ds"]
                            marked[max(r["s"], a - PART * (part + 1) + 1) : max(0, min(r["s"] + r["span"], a - PART * part) + 1)] = True
                for at in range(0, len(raw), CHUNK):
                    p = np.flatnonzero(marked[at : at + CHUNK])
                    if len(p):
                        wide = ranks(raw[at : at + CHUNK + WINDOW - 1])[64]
                        which.append(np.full(len(p), k))
                        starts.append(p + at)
                        ones.append(wide[p])
                        twos.append(wide[p + WINDOW - 64])
            if not which:
                continue
            which, starts, ones, twos = (np.concatenate(x) for x in (which, starts, ones, twos))
            at = table.column("row").to_numpy()[which] << 32 | starts
            held.append(pa.RecordBatch.from_arrays([pa.array(ones.view(np.int64)), pa.array(twos.view(np.int64)), table.column("doc_id").combine_chunks().take(pa.array(which)), pa.array(at)], names=["one", "two", "doc_id", "at"]))
            if sum(h.num_rows for h in held) >= fold:
                yield folded(held)
                held = []
        if held:
            yield folded(held)

    pairs = met.where("runs is not null").mapInArrow(frugal(spread), f"one long, two long, doc_id {kind}, at long, again boolean")
    # rows that are known to come again have ranks of their own
    nth = F.rank().over(Window.partitionBy("one", "two", "again").orderBy("doc_id", "at"))
    return pairs.withColumn("nth", nth).where("again or nth > 1").select("doc_id", _row().alias("row"), _start().alias("start"))


def spans(rows: DataFrame, most_held: int = HELD, fold: int = FOLD) -> DataFrame:
    """Per document with repeated strings: doc_id, row, spans (start, stop in bytes; they may overlap and are in no order)."""
    found = stored(anchored(rows, most_held), "anchored")
    whole = found.where("parts = 0").select("doc_id", _row().alias("row"), _start().alias("start"), (_start() + F.col("span") + WINDOW).alias("stop"))
    single = windows(rows, found, fold).select("doc_id", "row", "start", (F.col("start") + WINDOW).alias("stop"))
    return whole.unionByName(single).groupBy("doc_id", "row").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))


def joined(own: list[dict]) -> list[tuple[int, int]]:
    """The spans, sorted, with those that touch made one."""
    starts = np.array([s["start"] for s in own], dtype=np.int64)
    stops = np.array([s["stop"] for s in own], dtype=np.int64)
    order = np.argsort(starts, kind="stable")
    starts, stops = starts[order], np.maximum.accumulate(stops[order])
    cut = np.flatnonzero(np.concatenate([[True], starts[1:] > stops[:-1]]))
    return list(zip(starts[cut].tolist(), stops[np.append(cut[1:], len(starts)) - 1].tolist(), strict=True))


def removed(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", most_held: int = HELD, fold: int = FOLD) -> DataFrame:
    """Per document: doc_id, n_bytes, n_removed, n_spans, kept_sha256 and spans (start, stop of the maximal removed runs of bytes).

    A byte goes if a string of WINDOW bytes over it also starts earlier, in a document with a smaller
    doc_id or before in the same one, judged on the texts as they come in. A null doc_id is smaller than
    all others; documents that share a doc_id are ordered by a hash of their texts, and rows that repeat
    doc_id and text are one document. Null and empty texts, and those shorter than a window, lose
    nothing. An empty table gives no rows; other columns are left out. most_held and fold bound what a task
    holds, and change no row.
    """
    rows = _rows(docs, doc_id, text)
    kind = rows.schema["doc_id"].dataType.simpleString()
    mark = len(made())
    own = stored(spans(rows, most_held, fold), "spans")
    drop_since(docs.sparkSession, mark, own)
    some, rest = _with_texts(rows, own)

    def cut(batches):
        for batch in batches:
            out: list[tuple] = []
            for t, own in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
                raw, at, kept, gone = _bytes(t), 0, hashlib.sha256(), 0
                own = joined(own) if own else []
                for a, b in own:
                    kept.update(raw[at:a])
                    gone, at = gone + b - a, b
                kept.update(raw[at:])
                out.append((len(raw), gone, len(own), kept.hexdigest(), [{"start": a, "stop": b} for a, b in own]))
            cols = list(zip(*out, strict=True)) or [()] * 5
            types = (pa.int64(), pa.int64(), pa.int64(), pa.string(), batch.schema.field("spans").type)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(c, t) for c, t in zip(cols, types, strict=True))], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "spans"])

    shape = "array<struct<start:bigint,stop:bigint>>"
    cut_ = some.select("doc_id", "text", "spans").mapInArrow(frugal(cut), f"doc_id {kind}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, spans {shape}")
    zero = F.lit(0).cast("long")
    whole = rest.select("doc_id", F.octet_length("text").cast("long").alias("n_bytes"), zero.alias("n_removed"), zero.alias("n_spans"), F.sha2(F.encode("text", "UTF-8"), 256).alias("kept_sha256"), F.array().cast(shape).alias("spans"))
    return whole.unionByName(cut_)


def brute_force(texts: dict[int, str | None], window: int = WINDOW) -> dict[int, tuple[int, int, int, str]]:
    """removed() by a set of all windows, for tests: n_bytes, n_removed, n_spans, kept_sha256."""
    seen: set[bytes] = set()
    out = {}
    for name in sorted(texts):
        raw = _bytes(texts[name])
        gone = bytearray(len(raw))
        for p in range(len(raw) - window + 1):
            if (own := raw[p : p + window]) in seen:
                gone[p : p + window] = b"\1" * window
            seen.add(own)
        starts = sum(1 for k, g in enumerate(gone) if g and (not k or not gone[k - 1]))
        out[name] = (len(raw), sum(gone), starts, hashlib.sha256(bytes(b for b, g in zip(raw, gone, strict=True) if not g)).hexdigest())
    return out

