"""Best-fit packing of tokenised documents: hierarchical residual packing.

Pieces are dealt at random to groups of bounded size. Each group packs its own pieces best-fit,
longest first. Bins that are nearly full are final; of the others, each group hands on those that can
still matter as items for the next round, in which a few groups meet in one, until one group is left.
Any two bins of a group that best-fit leaves behind are together larger than the capacity, so at most
one of them is at most half full; it and the roomiest others are all that a later round can join.
"""

from __future__ import annotations

import json
import re
import sys
import zlib
from array import array
from bisect import bisect_left, insort
from collections.abc import Callable, Iterator
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import frugal, stored

#: Pieces that a group packs at once, and groups that meet in a round.
GROUP_PIECES, FAN_IN = 8_192, 16
#: Roomy bins that a group hands on beside the one that is at most half full.
CARRY = 64
#: Distinct words whose ids a task remembers: as many that are new, and as many that were in use before.
CACHE_WORDS = 100_000
# Normalisation and splitting that never join characters across a space or a line feed, and split letters off signs.
_NORMAL = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = [{"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True}, {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False}]

#: Letters below U+0180 that have one small letter each, with ASCII signs before and after them. An apostrophe before letters is left out: it may belong to them.
_WORD = r"""^(?P<head>[(\[{"*#$%&_-]*)(?P<word>[A-Za-zªµºÀ-ÖØ-öø-įı-ſ]+)(?P<tail>[!-/:-@\[-`{-~]*)$"""


def _bytes(ids: list[int]) -> bytes:
    out = array("I", ids)
    if sys.byteorder == "big":
        out.byteswap()
    return out.tobytes()


def _taken(ids: np.ndarray, starts: np.ndarray, sizes: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Of runs of ids, by where they start and their sizes, those with the codes, one after the other."""
    lengths = sizes[codes]
    ends = np.cumsum(lengths)
    return ids[np.repeat(starts[codes] - ends + lengths, lengths) + np.arange(ends[-1] if len(ends) else 0)]


class Tokens:
    """Ids of whole texts, as little-endian unsigned 32-bit bytes.

    Where the tokenizer is known never to join characters across a space or a line feed, the ids of a
    text are those of its parts between them; words that were seen before, with whatever signs around them
    and in whatever case, are not tokenised again. Any other tokenizer gets whole texts.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.parted = self._parts_alone(json.loads(Path(path).read_text(encoding="utf-8")))
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        rest = [b for b in range(256) if b not in set(plain)]
        self.byte = {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(rest)}
        self.forget()

    @staticmethod
    def _parts_alone(found: dict) -> bool:
        normal, split, model = found.get("normalizer") or {}, found.get("pre_tokenizer") or {}, found.get("model") or {}
        alone = normal.get("normalizers") == _NORMAL and split.get("pretokenizers") == _SPLIT and model.get("type") == "BPE" and found.get("post_processor") is None and not found.get("truncation")
        return alone and all(t["special"] and not re.search(r"\s", t["content"]) and not t["lstrip"] and not t["rstrip"] for t in found.get("added_tokens") or [])

    def _whole(self, text: str) -> bytes:
        return _bytes(self.tokenizer.encode(text, add_special_tokens=False).ids)

    def _word(self, word: str) -> bytes:
        # normalisation leaves such a word as it is, and it is split off from signs
        raw = word if word.isascii() else "".join(map(self.byte.__getitem__, word.encode()))
        return _bytes([t.id for t in self.model.tokenize(raw)])

    def _kept(self, text: str, own: Callable[[str], bytes]) -> bytes:
        """Ids of a word, signs or a whole part, as own finds them, remembered."""
        ids = self.new.get(text)
        if ids is None:
            ids = self.old.get(text)
            if ids is None:
                ids = own(text)
            if len(text) < 64:
                if len(self.new) >= CACHE_WORDS:  # words that are in use come back from the old ones
                    self.new, self.old = {}, self.new
                self.new[text] = ids
        return ids

    def forget(self) -> None:
        self.new: dict[str, bytes] = {}
        self.old: dict[str, bytes] = {}

    def _parts(self, parts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """Ids of parts one after the other, and how many each has."""
        seen = pc.extract_regex(parts, _WORD)
        head, word, tail = (pc.fill_null(pc.struct_field(seen, name), "") for name in ("head", "word", "tail"))
        odd = pc.if_else(pc.is_valid(seen), "", parts)
        found: list[bytes] = []
        own = []
        for column, ids_of in ((head, self._whole), (pc.utf8_lower(word), self._word), (tail, self._whole), (odd, self._whole)):
            coded = column.dictionary_encode()
            own.append(coded.indices.to_numpy() + len(found))
            found += [self._kept(t, ids_of) for t in coded.dictionary.to_numpy(zero_copy_only=False).tolist()]
        sizes = np.fromiter((len(ids) // 4 for ids in found), dtype=np.int64, count=len(found))
        codes = np.stack(own, axis=1)
        ids = _taken(np.frombuffer(b"".join(found), dtype="<u4"), np.cumsum(sizes) - sizes, sizes, codes.ravel())
        return ids, sizes[codes].sum(axis=1)

    def of(self, texts: pa.Array) -> Iterator[bytes]:
        """Ids of each text (null: none). Each different part of the texts is taken apart once."""
        texts = pc.fill_null(texts, "")
        if not self.parted:
            yield from map(self._whole, texts.to_pylist())
            return
        parts = pc.split_pattern(pc.replace_substring(texts, "\n", " "), " ")
        coded = parts.flatten().dictionary_encode()
        ids, sizes = self._parts(coded.dictionary)
        starts, codes = np.cumsum(sizes) - sizes, coded.indices.to_numpy()
        ends = parts.offsets.to_numpy()
        for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True):
            yield _taken(ids, starts, sizes, codes[a:b]).tobytes()

    def __call__(self, text: str) -> bytes:
        return next(self.of(pa.array([text], pa.string())))


@lru_cache(maxsize=1)
def tokens_of(path: str) -> Tokens:
    """One for all tasks of a Python worker."""
    return Tokens(path)


def pieces(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, and part and slot, the place in the scan.

    A document's ids are those of its text (null: empty) and then end_id. One longer than capacity is
    cut into pieces of capacity ids, the last of which may be shorter. Rows with a null or repeated
    doc_id are documents of their own.
    """
    kind = docs.schema[doc_id].dataType
    schema = f"doc_id {kind.simpleString()}, piece int, start long, length long, ids_crc32 long, part int, slot long"

    def run(batches):
        from pyspark import TaskContext

        tokens, part, slot = tokens_of(tokenizer), TaskContext.get().partitionId(), 0
        last, width = np.array([end_id], dtype="<u4").tobytes(), 4 * capacity
        for batch in batches:
            rows: list[tuple] = []
            for k, ids in enumerate(tokens.of(batch.column(1))):
                ids += last
                for n, at in enumerate(range(0, len(ids), width)):
                    cut = ids[at : at + width]
                    rows.append((k, n, at // 4, len(cut) // 4, zlib.crc32(cut)))
            cols = np.array(rows, dtype=np.int64).reshape(-1, 5).T
            slots = np.arange(slot, slot + len(rows))
            slot += len(rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0).take(pa.array(cols[0])), pa.array(cols[1].astype(np.int32)), *(pa.array(c) for c in cols[2:]), pa.array(np.full(len(rows), part, dtype=np.int32)), pa.array(slots)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "part", "slot"],
            )
        tokens.forget()  # the worker lives on

    return docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")).mapInArrow(frugal(run), schema)


def best_fit(lengths: np.ndarray, capacity: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Bin and offset of each item, dealt in the given order to the fullest bin that has room, and the number of bins."""
    room: list[list[int]] = [[] for _ in range(capacity + 1)]  # bins by room left
    there: list[int] = []  # sorted: kinds of room that some bin has
    bins, offsets, made = np.empty(len(lengths), dtype=np.int64), np.empty(len(lengths), dtype=np.int64), 0
    for k, size in enumerate(lengths.tolist()):
        at = bisect_left(there, size)
        if at < len(there):
            left = there[at]
            b = room[left].pop()
            if not room[left]:
                del there[at]
        else:
            left, b, made = capacity, made, made + 1
        bins[k], offsets[k] = b, capacity - left
        if left > size:
            if not room[left - size]:
                insort(there, left - size)
            room[left - size].append(b)
    return bins, offsets, made


def _round(items: DataFrame, capacity: int, nearly: int, carry: int | None) -> DataFrame:
    """Pack the items (id, group, length) of each group; per item: id, bin (its least id), shift, fill, group, and whether the bin goes on."""

    def packed_(group: int, ids: np.ndarray, lengths: np.ndarray) -> pa.RecordBatch:
        bins, offsets, made = best_fit(lengths, capacity)
        fill = np.bincount(bins, weights=lengths, minlength=made).astype(np.int64)
        first = np.full(made, np.iinfo(np.int64).max)
        np.minimum.at(first, bins, ids)
        onward = np.zeros(made, dtype=bool)
        onward[np.argsort(fill, kind="stable")[: None if carry is None else carry + 1]] = True
        onward &= fill <= capacity - nearly
        return pa.RecordBatch.from_arrays([pa.array(c) for c in (ids, first[bins], offsets, fill[bins], np.full(len(ids), group, dtype=np.int64), onward[bins])], names=["id", "bin", "shift", "fill", "group", "onward"])

    def run(batches):
        held: list[tuple[np.ndarray, np.ndarray]] = []  # of the group that the next batch may go on with
        last = None
        for batch in batches:
            groups, ids, lengths = (batch.column(c).to_numpy() for c in ("group", "id", "length"))
            cuts = np.flatnonzero(np.concatenate([[True], groups[1:] != groups[:-1]])).tolist() if len(groups) else []
            for a, b in zip(cuts, [*cuts[1:], len(groups)], strict=True):
                if held and groups[a] != last:
                    yield packed_(last, *map(np.concatenate, zip(*held, strict=True)))
                    held = []
                last = int(groups[a])
                held.append((ids[a:b], lengths[a:b]))
        if held:
            yield packed_(last, *map(np.concatenate, zip(*held, strict=True)))

    # a task packs as many groups as make up a partition, one by one
    dealt = items.select("id", "group", "length").repartition("group").sortWithinPartitions("group", F.desc("length"), "id")
    return dealt.mapInArrow(frugal(run), "id long, bin long, shift long, fill long, group long, onward boolean")


def pack(items: DataFrame, capacity: int = 2048, nearly: int = 8, group_pieces: int = GROUP_PIECES, carry: int | None = CARRY) -> DataFrame:
    """items (with part, slot and length, 1 to capacity) with sequence_id and offset.

    The items must come from a table (they are read more than once) in which (part, slot) is unique.
    Bins with less than ``nearly`` of room are final at once; of the others a group hands on the carry
    roomiest and one more, or all (None). An empty table gives an empty result.
    """
    key = F.shiftleft(F.col("part").cast("long"), 36) + F.col("slot")
    groups = max(1, -(-items.count() // group_pieces))
    dealt = items.withColumn("id", key).withColumn("group", F.pmod(F.xxhash64("id"), F.lit(groups)))
    where = stored(_round(dealt, capacity, nearly, carry), "packed")
    moved, rest = None, where.where("onward")
    while groups > 1:
        groups = -(-groups // FAN_IN)
        bins = rest.groupBy(F.col("bin").alias("id")).agg(F.first("fill").alias("length"), F.floor(F.first("group") / FAN_IN).alias("group"))
        again = stored(_round(bins, capacity, nearly, carry), "packed")
        step = again.select("id", F.col("bin").alias("to"), F.col("shift").alias("by"))
        if moved is None:
            moved = step
        else:  # where the bins of the first round have come to
            moved = moved.join(step.withColumnsRenamed({"id": "to_", "to": "next", "by": "more"}), F.col("to") == F.col("to_"), "left")
            moved = moved.select("id", F.coalesce("next", "to").alias("to"), (F.col("by") + F.coalesce("more", F.lit(0))).alias("by"))
        rest = again.where("onward")
    placed = dealt.drop("group").join(where.select("id", "bin", "shift"), "id")
    if moved is None:
        return placed.withColumns({"sequence_id": F.col("bin"), "offset": F.col("shift")}).drop("id", "bin", "shift", "part", "slot")
    moved = moved.withColumnRenamed("id", "bin")
    return placed.join(moved, "bin", "left").withColumns({"sequence_id": F.coalesce("to", "bin"), "offset": F.col("shift") + F.coalesce("by", F.lit(0))}).drop("id", "bin", "shift", "to", "by", "part", "slot")


def packed(docs: DataFrame, tokenizer: str, capacity: int = 2048, end_id: int = 0, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset. Edge cases as in pieces(); very long texts become many pieces, other columns are left out."""
    found = pack(stored(pieces(docs, tokenizer, capacity, end_id, doc_id, text), "pieces"), capacity)
    return found.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")
