"""Benchmark decontamination with a generalised suffix automaton over the words of the test items.

The automaton is built on the driver from one bounded block of items at a time and sent to the
executors; documents stream through it word by word. Each step keeps the longest suffix of the words
read so far that occurs in some item, so the positions covered by item windows of n words are known
after one pass. With one block the result comes straight from the scan and nothing is shuffled. With
more, each block is scanned for by itself, what it hits (a key of the text and spans, no texts) is
written, its automaton is destroyed, and documents with hits are joined with them in the end; so no more
than one automaton is held at any time.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import bit_filter, flagged, frugal, stored

#: Words of a block of items. An automaton has at most two states a word, so this bounds what is broadcast.
BLOCK_WORDS = 200_000

#: A-Z to a-z; bytes that belong to no word to a space. Bytes of non-ASCII characters stay as they are.
_FOLD = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b <= 57 or 97 <= b <= 122 or b >= 128 else 32 for b in range(256))
_WORD = re.compile(rb"[^ ]+")


def words(text: str | None) -> list[bytes]:
    """The words [^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+ of the text with A-Z in lower case, as UTF-8. Null has none."""
    return text.encode("utf-8", "surrogatepass").translate(_FOLD).split() if text else []


class Automaton:
    """Generalised suffix automaton of word sequences.

    step: per state, word number to next state.  link: suffix links.  length: longest string of a state.
    anchor: of a state with strings of n words or more, the state that holds its suffix of n words.
    whole: items shorter than n words that end at a state.  held: items whose text runs through a state.
    """

    def __init__(self, items: list[tuple[object, list[bytes]]], n: int):
        self.n = n
        self.ids = {w: k for k, w in enumerate(dict.fromkeys(w for _, ws in items for w in ws))}
        self.step: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]
        ends: dict[int, set[int]] = {}
        shorts: dict[int, set[int]] = {}
        self.names = [name for name, _ in items]
        for k, (_, ws) in enumerate(items):
            at = 0
            for w in ws:
                at = self._add(at, self.ids[w])
                ends.setdefault(at, set()).add(k)
            if 0 < len(ws) < n:
                shorts.setdefault(at, set()).add(k)
        held: list[set[int] | None] = [None] * len(self.step)
        order = sorted(range(1, len(self.step)), key=self.length.__getitem__)
        for s in reversed(order):
            if self.length[s] >= n:
                held[s] = (held[s] or set()) | ends.get(s, set())
                up = self.link[s]
                if self.length[up] >= n:
                    held[up] = (held[up] or set()) | held[s]
        self.anchor = [-1] * len(self.step)
        self.whole: list[tuple[int, ...]] = [()] * len(self.step)  # states, longest first, that are items of fewer than n words
        for s in order:
            up = self.link[s]
            if self.length[s] >= n:
                self.anchor[s] = self.anchor[up] if self.length[up] >= n else s
            self.whole[s] = ((s,) if s in shorts else ()) + self.whole[up]
        self.held = {s: frozenset(v) for s, v in enumerate(held) if v and self.anchor[s] == s}
        self.shorts = {s: frozenset(v) for s, v in shorts.items()}

    def _add(self, at: int, w: int) -> int:
        step, link, length = self.step, self.link, self.length
        to = step[at].get(w)
        if to is not None:
            return to if length[to] == length[at] + 1 else self._clone(at, w, to)
        new = len(step)
        step.append({})
        length.append(length[at] + 1)
        link.append(0)
        while at != -1 and w not in step[at]:
            step[at][w] = new
            at = link[at]
        if at != -1:
            to = step[at][w]
            link[new] = to if length[to] == length[at] + 1 else self._clone(at, w, to)
        return new

    def _clone(self, at: int, w: int, to: int) -> int:
        new = len(self.step)
        self.step.append(dict(self.step[to]))
        self.length.append(self.length[at] + 1)
        self.link.append(self.link[to])
        self.link[to] = new
        while at != -1 and self.step[at].get(w) == to:
            self.step[at][w] = new
            at = self.link[at]
        return new

    def scan(self, ws: list[bytes]) -> tuple[list[tuple[int, int]], set[int]]:
        """Ranges of words hit by windows of items, joined where they touch, and the items by number."""
        n, step, link, length, anchor, whole = self.n, self.step, self.link, self.length, self.anchor, self.whole
        at = size = 0
        spans: list[list[int]] = []
        found: set[int] = set()
        seen: set[int] = set()
        for k, w in enumerate(map(self.ids.get, ws)):
            if w is None:
                at = size = 0
                continue
            to = step[at].get(w)
            if to is None:
                at = link[at]
                while at != -1 and (to := step[at].get(w)) is None:
                    at = link[at]
                if at == -1:
                    at = size = 0
                    continue
                size = length[at] + 1
            else:
                size += 1
            at = to
            got = 0
            if size >= n:
                got = n
                if anchor[at] not in seen:
                    seen.add(anchor[at])
                    found |= self.held[anchor[at]]
            if whole[at]:
                for s in whole[at]:
                    if length[s] <= size:
                        got = max(got, length[s])
                        if s not in seen:
                            seen.add(s)
                            found |= self.shorts[s]
            if got:
                start = k + 1 - got
                while spans and spans[-1][1] >= start:
                    start = min(start, spans.pop()[0])
                spans.append([start, k + 1])
        return [(a, b) for a, b in spans], found


def _blocks(items: DataFrame, item_id: str, text: str, block_words: int) -> Iterator[list[tuple[object, list[bytes]]]]:
    """Items, streamed partition by partition, in blocks of about block_words words; items without words are left out."""
    block, size = [], 0
    for row in items.select(F.col(item_id).alias("i"), F.col(text).alias("t")).toLocalIterator():
        if ws := words(row["t"]):
            block.append((row["i"], ws))
            size += len(ws)
        if size >= block_words:
            yield block
            block, size = [], 0
    if block:
        yield block


_SPANS = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("stop", T.LongType())]))
_ARROW_SPANS, _ARROW_NAMES = pa.list_(pa.struct([("start", pa.int64()), ("stop", pa.int64())])), pa.list_(pa.string())
Spans = list[tuple[int, int]]
#: From a batch, and of each of its texts the words, the hit ranges and the items, the batch that comes out.
Finish = Callable[[pa.RecordBatch, list[int], list[Spans], list[list[str]]], pa.RecordBatch]


def _union(spans: Spans) -> Spans:
    out: Spans = []
    for a, b in sorted(spans):
        if out and out[-1][1] >= a:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def _names(automaton: Automaton, found: set[int]) -> list[str]:
    return sorted({"" if automaton.names[k] is None else str(automaton.names[k]) for k in found})


def _dicts(spans: Spans) -> list[dict[str, int]]:
    return [{"start": a, "stop": b} for a, b in spans]


def _scanned(docs: DataFrame, items: DataFrame, n: int, text: str, item_id: str, item_text: str, block_words: int, finish: Finish, schema: T.StructType) -> DataFrame:
    """docs, batch by batch, through finish."""
    context, blocks = docs.sparkSession.sparkContext, _blocks(items, item_id, item_text, block_words)
    block, following = next(blocks, []), next(blocks, None)
    if following is None:
        sent = context.broadcast(Automaton(block, n))

        def run(batches):
            automaton = sent.value
            for batch in batches:
                sizes, spans, names = [], [], []
                for t in batch.column(text).to_pylist():
                    hit, found = automaton.scan(ws := words(t))
                    sizes.append(len(ws))
                    spans.append(hit)
                    names.append(_names(automaton, found))
                yield finish(batch, sizes, spans, names)

        return docs.mapInArrow(frugal(run), schema)

    keyed = lambda df: df.withColumns({"__dc_a": F.xxhash64(text), "__dc_b": F.xxhash64(F.lit(1), text)})
    hits = None
    while block is not None:
        sent = context.broadcast(Automaton(block, n))

        def scan(batches, sent=sent):
            automaton = sent.value
            for batch in batches:
                rows = {}  # copies of a text have the same hits
                for t, *key in zip(*(batch.column(c).to_pylist() for c in (text, "__dc_a", "__dc_b")), strict=True):
                    if tuple(key) not in rows:
                        hit, found = automaton.scan(words(t))
                        rows[tuple(key)] = (_dicts(hit), _names(automaton, found))
                there = [(*key, *got) for key, got in rows.items() if got[0]]
                columns = list(zip(*there, strict=True)) or [()] * 4
                yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.int64(), _ARROW_SPANS, _ARROW_NAMES), strict=True)], names=["__dc_x", "__dc_y", "__dc_at", "__dc_of"])

        own = keyed(docs.select(text)).mapInArrow(frugal(scan), "__dc_x long, __dc_y long, __dc_at array<struct<start:bigint,stop:bigint>>, __dc_of array<string>")
        own = stored(own.dropDuplicates(["__dc_x", "__dc_y"]), "hits")
        sent.destroy()
        hits = own if hits is None else hits.unionByName(own)
        block, following = following, next(blocks, None)
    # a row of hits for each block and text at most
    hits = stored(hits.groupBy("__dc_x", "__dc_y").agg(F.flatten(F.collect_list("__dc_at")).alias("__dc_at"), F.flatten(F.collect_list("__dc_of")).alias("__dc_of")), "hits")

    def close(batches):
        for batch in batches:
            spans = [_union([(s["start"], s["stop"]) for s in own or []]) for own in batch.column("__dc_at").to_pylist()]
            names = [sorted(set(own or [])) for own in batch.column("__dc_of").to_pylist()]
            yield finish(batch, [len(words(t)) for t in batch.column(text).to_pylist()], spans, names)

    every = flagged(keyed(docs), F.col("__dc_a"), stored(bit_filter(hits, F.col("__dc_x")), "bits"), "__dc_maybe")
    met = every.where("__dc_maybe").join(hits, (F.col("__dc_a") == F.col("__dc_x")) & (F.col("__dc_b") == F.col("__dc_y")), "left")
    none = {"__dc_at": F.lit(None).cast(_SPANS), "__dc_of": F.lit(None).cast("array<string>")}
    every = met.drop("__dc_x", "__dc_y").unionByName(every.where("not __dc_maybe").withColumns(none))
    return every.drop("__dc_a", "__dc_b", "__dc_maybe").mapInArrow(frugal(close), schema)


def match(docs: DataFrame, items: DataFrame, n: int = 10, text: str = "text", item_id: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS, prefix: str = "dc_") -> DataFrame:
    """Each row of docs with what the items hit in it.

    Adds, their names after prefix, ``words`` (words of the text), ``spans`` (ranges of words, half open,
    covered by windows of n item words; an item of fewer words is one window) and ``items`` (ids of items
    with occurring windows, as strings, sorted, each once). Null and empty texts have no words and no hits; items
    without words never match; a null item id counts as the empty string; rows repeated in docs are
    judged each for itself; an empty items table hits nothing. Existing columns of those three names are
    replaced. A very long text streams through the automaton like others, with its spans as its only extra.
    """
    added = {f"{prefix}words": "long", f"{prefix}spans": _SPANS, f"{prefix}items": "array<string>"}
    own = docs.select(*[c for c in docs.columns if c not in added])
    kept = own.columns

    def finish(batch: pa.RecordBatch, sizes: list[int], spans: list[Spans], names: list[list[str]]) -> pa.RecordBatch:
        put = [pa.array(sizes, pa.int64()), pa.array(list(map(_dicts, spans)), _ARROW_SPANS), pa.array(names, _ARROW_NAMES)]
        return pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), *put], names=[*kept, *added])

    schema = own.withColumns({c: F.lit(None).cast(kind) for c, kind in added.items()}).schema
    return _scanned(own, items, n, text, item_id, item_text, block_words, finish, schema)


def contamination(docs: DataFrame, items: DataFrame, n: int = 10, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """Per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated. Edge cases as in match()."""
    found = match(docs.select(F.col(doc_id).alias("doc_id"), F.col(text).alias("text")), items, n)
    hit = F.aggregate("dc_spans", F.lit(0).cast("long"), lambda a, s: a + s["stop"] - s["start"])
    return found.select(
        "doc_id",
        F.col("dc_words").alias("n_words"),
        hit.alias("n_hit"),
        F.size("dc_items").cast("long").alias("n_items"),
        F.sha2(F.concat_ws(",", "dc_items"), 256).alias("items_sha256"),
        (F.size("dc_spans") > 0).alias("contaminated"),
    )


def cut(text: str, spans: list[tuple[int, int]]) -> str:
    """The text without the given ranges of words, each cut from its first word to its last."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in _WORD.finditer(raw.translate(_FOLD))]
    out, last = [], 0
    for a, b in spans:
        out.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*out, raw[last:]]).decode("utf-8", "surrogatepass")


def remove(docs: DataFrame, items: DataFrame, n: int = 10, coverage: float = 0.5, text: str = "text", n_chars: str = "n_chars", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Documents without the spans that items cover.

    Spans of at least one window of n item words are cut out of the text. A document of which more than
    the share ``coverage`` of all words is hit goes as a whole. Other documents, those with null or
    empty text among them, stay as they are. The columns are those of docs; ``n_chars``, where there is
    such a column, follows the cut text.
    """
    kept = docs.columns

    def finish(batch: pa.RecordBatch, sizes: list[int], spans: list[Spans], names: list[list[str]]) -> pa.RecordBatch:
        own, texts = batch.select(kept), batch.column(text)
        stay = [sum(b - a for a, b in hit) <= coverage * size for hit, size in zip(spans, sizes, strict=True)]
        cuts = {k: cut(texts[k].as_py(), hit) for k, hit in enumerate(spans) if hit and stay[k]}
        if cuts:
            arrays = dict(zip(own.schema.names, own.columns, strict=True))
            arrays[text] = pa.array([cuts.get(k, t) for k, t in enumerate(texts.to_pylist())], own.schema.field(text).type)
            if n_chars in arrays:
                chars = arrays[n_chars].to_pylist()
                arrays[n_chars] = pa.array([len(cuts[k]) if k in cuts else c for k, c in enumerate(chars)], own.schema.field(n_chars).type)
            own = pa.RecordBatch.from_arrays(list(arrays.values()), names=list(arrays))
        return own.filter(pa.array(stay, pa.bool_()))

    return _scanned(docs, items, n, text, "item_id", "text", block_words, finish, docs.schema)


def brute_force(texts: dict[object, str | None], items: dict[object, str | None], n: int = 10) -> dict[object, tuple[int, int, int, str]]:
    """contamination() by comparing every window with every position, for tests: (n_words, n_hit, n_items, items_sha256)."""
    windows: dict[tuple[bytes, ...], set[str]] = {}
    for name, t in items.items():
        ws = words(t)
        for k in range(max(1, len(ws) - n + 1) if ws else 0):
            windows.setdefault(tuple(ws[k : k + n]), set()).add("" if name is None else str(name))
    out = {}
    for name, t in texts.items():
        ws, hit, found = words(t), set(), set()
        for k in range(len(ws)):
            for size in range(1, n + 1):
                if names := windows.get(tuple(ws[k : k + size])) if k + size <= len(ws) else None:
                    hit.update(range(k, k + size))
                    found |= names
        out[name] = (len(ws), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest())
    return out
