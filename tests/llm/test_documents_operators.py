"""The numbered operators on documents against brute-force versions, and their edge cases."""

from __future__ import annotations

import collections
import hashlib
import unicodedata
import zlib

import pytest

from lumenkg.llm import decontaminate, fingerprint, langid, linededup, neardup, packing, pii, sharding, suffixdedup
from lumenkg.llm.queries import vocabulary


def by_id(df, *names):
    return {r.doc_id: tuple(r[n] for n in names) for r in df.collect()}


def sha(s):
    return hashlib.sha256(s if isinstance(s, bytes) else s.encode()).hexdigest()


# 1 ------------------------------------------------------------------------------------------------


@pytest.fixture(scope="module")
def items(spark, docs):
    first = docs.texts[0].split()
    rows = [(1, " ".join(first[5:20])), (2, " ".join(first[40:44]).upper()), (3, None), (4, ""), (5, "nothing of this kind is there at all in any text here"), (6, " ".join(first[8:30])), (7, "one"), (8, " ".join(docs.texts[40].split()[:12]))]
    return rows, spark.createDataFrame(rows, "item_id long, text string")


@pytest.mark.parametrize("block", [20, 500_000])
def test_contamination(docs, items, block):
    rows, df = items
    want = decontaminate.brute_force(docs.texts, dict(rows))
    found = decontaminate.match(docs.df, df, block_words=block)
    got = {r.doc_id: (r.dc_words, sum(s.stop - s.start for s in r.dc_spans), len(r.dc_items), sha(",".join(r.dc_items))) for r in found.collect()}
    assert got == want and sum(v[1] > 0 for v in want.values()) > 5
    assert by_id(decontaminate.contamination(docs.df, df), "n_words", "n_hit", "n_items", "items_sha256") == want


def test_removal(docs, items):
    rows, df = items
    out = by_id(decontaminate.remove(docs.clashing, df, coverage=0.4), "text", "n_chars")
    hit = decontaminate.brute_force(docs.texts, dict(rows))
    assert set(out) == {k for k, (n, h, _, _) in hit.items() if h <= 0.4 * n}
    for k, (text, n) in out.items():
        if not hit[k][1]:
            assert text == docs.texts[k]
        else:
            assert len(decontaminate.words(text)) == hit[k][0] - hit[k][1] and n == len(text)
    assert decontaminate.remove(docs.clashing, df).columns == docs.clashing.columns
    assert decontaminate.contamination(docs.df, df.limit(0)).where("contaminated").count() == 0
    assert decontaminate.contamination(docs.empty, df).count() == 0
    assert decontaminate.contamination(docs.repeated, df).count() == docs.repeated.count()


# 2 ------------------------------------------------------------------------------------------------


def ids_of(texts):
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(vocabulary())
    return {k: tokenizer.encode(t or "", add_special_tokens=False).ids + [0] for k, t in texts.items()}


def check_packing(rows, wanted, capacity):
    pieces = collections.defaultdict(list)
    bins = collections.defaultdict(list)
    for r in rows:
        pieces[r.doc_id].append(r)
        bins[r.sequence_id].append((r.offset, r.length))
    assert set(pieces) == set(wanted)
    for k, own in pieces.items():
        own.sort(key=lambda r: r.piece)
        ids, at = wanted[k], 0
        assert len(own) == -(-len(ids) // capacity)
        for n, r in enumerate(own):
            cut = ids[at : at + capacity]
            assert (r.piece, r.start, r.length, r.ids_crc32) == (n, at, len(cut), zlib.crc32(b"".join(i.to_bytes(4, "little") for i in cut)))
            at += len(cut)
    for own in bins.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(bins)


@pytest.mark.parametrize("capacity", [64, 2048])
def test_packing(docs, capacity):
    wanted = ids_of(docs.texts)
    n = check_packing(packing.packed(docs.clashing, vocabulary(), capacity).collect(), wanted, capacity)
    assert n <= 1.05 * -(-sum(map(len, wanted.values())) // capacity) + 2
    assert packing.packed(docs.empty, vocabulary()).count() == 0


def test_packing_in_rounds(spark, docs):
    import random

    rng = random.Random(1)
    rows = [(0, k, rng.randint(1, 700)) for k in range(3000)]
    table = packing.stored(spark.createDataFrame(rows, "part int, slot long, length long").selectExpr("*", "slot AS doc_id"), "items")
    out = packing.pack(table, 1000, group_pieces=90).collect()
    bins = collections.defaultdict(list)
    for r in out:
        bins[r.sequence_id].append((r.offset, r.length))
    assert len(out) == 3000
    for own in bins.values():
        assert [o for o, _ in sorted(own)] == [sum(n for _, n in sorted(own)[:i]) for i in range(len(own))]
        assert sum(n for _, n in own) <= 1000
    lengths = sorted((n for _, _, n in rows), reverse=True)
    import numpy as np

    _, _, best = packing.best_fit(np.array(lengths), 1000)
    assert len(bins) <= 1.02 * best + 1


def test_ids_of_real_texts(spark):
    texts = {r.doc_id: r.text for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").collect()}
    texts |= {-1: "Don't STOP now İstanbul ſ ǅ ŉ é <|endoftext|> àb\tc\rd  ", -2: "ΟΔΟΣ ﬁ Ⅷ 12,5% x²", -3: "​﻿a\u0085b"}
    wanted = ids_of(texts)
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    check_packing(packing.packed(df, vocabulary()).collect(), wanted, 2048)


# 3 ------------------------------------------------------------------------------------------------


def test_fingerprints(docs):
    ids = sorted(docs.texts)
    out = by_id(fingerprint.fingerprints(docs.clashing), "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next")
    prints = {}
    for k, name in enumerate(ids):
        own, following = docs.texts[name] or "", docs.texts[ids[(k + 1) % len(ids)]] or ""
        half = len(own) // 2
        edited = own[: len(own) - half] + following[:half]
        n, digest, fp, fe, near, near_next = out[name]
        assert (n, digest) == (len(own), sha(edited))
        canon = fingerprint.canonical
        assert near == (canon(own) == canon(edited)) and near_next == (canon(own) == canon(following))
        prints.setdefault(fp, set()).add(canon(own))
        assert (fp == fe) == (canon(own) == canon(edited))
    assert all(len(v) == 1 for v in prints.values())
    assert fingerprint.fingerprints(docs.empty).count() == 0
    assert fingerprint.fingerprints(docs.repeated).count() == docs.repeated.count()


def test_canonical():
    same = ["Straße  X", "STRASSE\tx", "ｓｔｒａｓｓｅ x", unicodedata.normalize("NFD", "Straße X")]
    assert len({fingerprint.canonical(s) for s in same}) == 1
    assert fingerprint.canonical(None) == b"" != fingerprint.canonical("a")


def test_equal_digests_of_different_texts(spark, docs):
    """With a digest of two values most texts share one with others; their fingerprints still differ."""
    rows = [(1, "a x"), (2, "a y"), (3, "A  x"), (4, "b"), (5, None), (6, "")]
    for df, texts in ((spark.createDataFrame(rows, "doc_id long, text string"), dict(rows)), (docs.clashing, docs.texts)):
        found = fingerprint.fingerprints(df, digest_of=lambda canon: f"{len(canon) % 2:032x}")
        assert found.columns == fingerprint.fingerprints(df).columns
        out = by_id(found, "fingerprint", "edited_fingerprint")
        names = sorted(texts)
        canon = {k: fingerprint.canonical(texts[k]) for k in names}
        assert len({v[0] for v in out.values()}) == len(set(canon.values())) == len({(v[0], canon[k]) for k, v in out.items()})
        for k, following in zip(names, names[1:] + names[:1], strict=True):
            t, n = texts[k] or "", len(texts[k] or "") // 2
            edited = fingerprint.canonical(t[: len(t) - n] + (texts[following] or "")[:n])
            for other in names:
                if canon[other] == edited:
                    assert out[k][1] == out[other][0]


def test_bits_of_repeated(spark):
    rows = [("%032x" % (k << 80),) for k in (0, 1, 5, 32768, (1 << 24) - 1) for _ in range(2)] + [("%032x" % (9 << 80),)]
    bits = fingerprint.repeated(spark.createDataFrame(rows, "fingerprint string"))
    there = {k for k in (0, 1, 4, 5, 6, 9, 32767, 32768, 32769, (1 << 24) - 1) if bits[k >> 3] >> (k & 7) & 1}
    assert there == {0, 1, 5, 32768, (1 << 24) - 1}


# 4 ------------------------------------------------------------------------------------------------


def test_languages(spark, docs):
    df = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    lang = {r.doc_id: r.lang for r in df.collect()}
    out = by_id(langid.predictions(df), "held_out", "lang_pred", "score")
    assert all(v[0] == (zlib.crc32(str(k).encode()) % 5 == 0) and 0 <= v[2] <= 1 for k, v in out.items())
    held = [k for k, v in out.items() if v[0]]
    assert sum(out[k][1] == lang[k] for k in held) >= 0.98 * len(held)


def test_language_edges(docs):
    out = by_id(langid.predictions(docs.clashing), "lang_pred", "score")
    assert set(out) == set(docs.texts)
    for k, (pred, score) in out.items():
        letters = any(map(str.isalpha, docs.texts[k] or ""))
        assert (pred == "und") == (not letters) and 0 <= score <= 1
    assert langid.predictions(docs.empty).count() == 0
    kept = langid.accepted(docs.clashing)
    assert kept.columns == docs.clashing.columns and {r.doc_id for r in kept.select("doc_id").collect()} <= {k for k, v in out.items() if v[0] != "und"}


def test_mixture():
    import numpy as np

    texts = {"aa": "abra kadabra " * 40, "bb": "zyzzy quux " * 40}
    columns = [np.bincount(langid.trigrams(t), minlength=langid.CLASSES) + 0.01 for t in texts.values()]
    model = langid.Model(sorted(texts), np.stack([*(c / c.sum() for c in columns), np.full(langid.CLASSES, 1 / langid.CLASSES)], axis=1).astype(np.float32))
    (a, share, noise, _), (b, sure, _, only) = langid.infer(model, [texts["aa"][:300] + texts["bb"][:100], texts["bb"]])
    assert a == "aa" and 0.6 < share < 0.9 and noise < 0.1 and (b, round(sure, 3)) == ("bb", 1.0) and only == {"bb": 1.0}


# 5 ------------------------------------------------------------------------------------------------


def components(texts, k, percent):
    sets = {i: neardup.shingles(t, k) for i, t in texts.items()}
    root = {i: i for i in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a in sorted(texts):
        for b in sorted(texts):
            if a < b and sets[a] and sets[b] and neardup.linked(sets[a], sets[b], percent):
                x, y = find(a), find(b)
                root[max(x, y)] = min(x, y)
    return {i: (len(sets[i]), find(i), find(i) == i) for i in texts}


@pytest.mark.parametrize("k, percent", [(3, 85), (5, 80)])
def test_near_duplicates(docs, k, percent):
    want = components(docs.texts, k, percent)
    assert by_id(neardup.near_duplicates(docs.clashing, k, percent), "n_shingles", "component_id", "kept") == want
    kept = neardup.deduplicated(docs.clashing, k, percent)
    assert sorted(r.doc_id for r in kept.collect()) == sorted(i for i, v in want.items() if v[2])
    assert kept.columns == docs.clashing.columns


def test_near_duplicate_edges(spark, docs):
    assert neardup.near_duplicates(docs.empty).count() == 0
    again = neardup.near_duplicates(docs.repeated)
    assert again.count() == docs.repeated.count() and by_id(again, "component_id") == by_id(neardup.near_duplicates(docs.df), "component_id")
    nulls = spark.createDataFrame([(None, "a b c d e f"), (4, "a b c d e f"), (None, None)], "doc_id long, text string")
    assert sorted((r.component_id or -1, r.kept) for r in neardup.near_duplicates(nulls).collect()) == [(-1, True), (4, False), (4, True)]


def test_odd_sketches():
    import numpy as np

    rng = np.random.default_rng(3)
    for share in (0.85, 0.9, 0.95):
        a = rng.integers(0, 1 << 63, 2000, dtype=np.uint64)
        cut = round(2000 * 2 * share / (1 + share))
        b = np.concatenate([a[:cut], rng.integers(0, 1 << 63, 2000 - cut, dtype=np.uint64)])
        differ = (neardup.odd_sketch(neardup.signature(a)) ^ neardup.odd_sketch(neardup.signature(b))).view(np.uint8)
        assert np.unpackbits(differ).sum() <= neardup.most_bits(0.85)


# 7 ------------------------------------------------------------------------------------------------


def test_repeated_bytes(spark, docs):
    names = ("n_bytes", "n_removed", "n_spans", "kept_sha256")
    assert by_id(suffixdedup.removed(docs.clashing), *names) == suffixdedup.brute_force(docs.texts)
    assert suffixdedup.removed(docs.empty).count() == 0
    assert by_id(suffixdedup.removed(docs.repeated), *names) == suffixdedup.brute_force(docs.texts)


def test_crowded_ranks(spark, monkeypatch):
    import random

    rng = random.Random(4)
    word = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    common, other = word(150), word(260)
    texts = {k: word(rng.randint(0, 80)) + common[rng.randint(0, 60) : rng.randint(90, 150)] + word(rng.randint(0, 80)) + (other[k % 50 :] if k % 3 == 0 else "") for k in range(250)}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string").repartition(3)
    assert by_id(suffixdedup.removed(df), "n_bytes", "n_removed", "n_spans", "kept_sha256") == suffixdedup.brute_force(texts)


def test_ranks_with_too_many_rows(spark):
    import random

    rng = random.Random(5)
    word = lambda n: "".join(rng.choice("ab é") for _ in range(n))
    common, passages = word(40), [word(170) for _ in range(6)]
    texts = {k: word(rng.randint(0, 90)) + common + word(rng.choice([0, 3, 70])) + passages[min(k % 11, 5)] for k in range(200)}
    df = spark.createDataFrame([*texts.items(), (7, texts[7]), (90, texts[90])], "doc_id long, text string").repartition(3)
    before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
    try:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "25")
        for held, fold in ((1, 1), (30, 400), (1 << 17, 1 << 19)):
            assert by_id(suffixdedup.removed(df, most_held=held, fold=fold), "n_bytes", "n_removed", "n_spans", "kept_sha256") == suffixdedup.brute_force(texts)
    finally:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_chunks_of_long_texts(monkeypatch):
    monkeypatch.setattr(suffixdedup, "CHUNK", 1000)
    found = suffixdedup.runs([bytes(range(256)) * 20, b"x" * 99])
    covered = sorted((int(s), int(s + (h >> 7 & 127))) for s, h in zip(found["start"], found["shape"].astype("int64") & ((1 << 14) - 1), strict=True))
    assert covered[0][0] == 0 and covered[-1][1] == 5120 - 100
    assert all(b[0] == a[1] + 1 for a, b in zip(covered, covered[1:], strict=False)) and set(found["doc"].tolist()) == {0}


# 8 ------------------------------------------------------------------------------------------------


def within_one(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(b) - len(a) > 1:
        return False
    h = 0
    while h < len(a) and a[h] == b[h]:
        h += 1
    return a[h + (len(a) == len(b)) :] == b[h + 1 :] or a == b


def close_lines(a, b):
    """By the definition: one word where both lines have LEAST_WORDS of them, else one character."""
    if a == b or min(len(a), len(b)) >= linededup.LEAST_WORDS:
        return within_one(a, b)
    x, y = " ".join(a), " ".join(b)
    return max(len(a), len(b)) <= linededup.LEAST_WORDS and min(len(x), len(y)) >= linededup.LEAST_CHARS and within_one(x, y)


def lines_left(texts):
    seen, out = [], {}
    for name in sorted(texts):
        n, kept, gone = 0, [], 0
        for line in (texts[name] or "").split("\n"):
            ws = line.lower().split()
            go = bool(ws) and any(close_lines(ws, x) for x in seen)
            n, gone = n + bool(ws), gone + go
            if ws:
                seen.append(ws)
            if not go:
                kept.append(line)
        rest = "\n".join(kept) if texts[name] is not None else None
        out[name] = (n, gone, len((rest or "").encode()), sha(rest or ""), rest)
    return out


def test_lines(docs):
    want = lines_left(docs.texts)
    assert by_id(linededup.counted(docs.clashing), "n_lines", "n_removed", "n_kept_bytes", "kept_sha256") == {k: v[:4] for k, v in want.items()}
    out = by_id(linededup.deduplicated(docs.clashing), "text", "n_chars")
    assert set(out) == {k for k, v in want.items() if not v[1] or (v[4] or "").strip()}
    assert all(out[k][0] == (want[k][4] if want[k][1] else docs.texts[k]) and out[k][1] == (None if out[k][0] is None else len(out[k][0])) for k in out)
    assert linededup.deduplicated(docs.clashing).columns == docs.clashing.columns
    assert linededup.counted(docs.empty).count() == 0
    assert by_id(linededup.counted(docs.repeated), "n_removed") == {k: (v[1],) for k, v in want.items()}


def test_edits_of_lines(spark):
    a = "one two three four five six seven eight nine"
    texts = {0: a, 1: a.replace("five", "FIVE"), 2: a + " ten", 3: a.removeprefix("one "), 4: a.replace("five", "x").replace("six", "y"), 5: "short line", 6: "short lines", 7: "short  line"}
    df = spark.createDataFrame(list(texts.items()), "doc_id long, text string")
    assert by_id(linededup.counted(df), "n_removed") == {k: (int(k in (1, 2, 3, 7)),) for k in texts}
    assert {k: v[1] for k, v in lines_left(texts).items()} == {k: int(k in (1, 2, 3, 7)) for k in texts}


# 9 ------------------------------------------------------------------------------------------------


def test_shards(docs):
    rows = sharding.sharded(docs.clashing, 40).collect()
    slots = collections.defaultdict(list)
    for r in rows:
        raw = (docs.texts[r.doc_id] or "").encode()
        assert (r["size"], r.text_crc32, r.law) == (len(raw) + 16, zlib.crc32(raw), "key")
        assert 0 <= r.shard < 40 and r.grown_shard in (r.shard, 40)
        slots[r.shard].append(r.slot)
    assert all(sorted(v) == list(range(len(v))) for v in slots.values())
    again = {r.doc_id: r.shard for r in sharding.sharded(docs.df.repartition(2), 41).collect()}
    assert {r.doc_id: r.grown_shard for r in rows} == again
    assert sharding.sharded(docs.empty).count() == 0
    assert sharding.sharded(docs.repeated).count() == docs.repeated.count()


def test_jump_moves_few(spark):
    df = spark.range(20_000).select("id", sharding.jump(__import__("pyspark.sql.functions", fromlist=["col"]).col("id"), 40).alias("a"), sharding.jump(__import__("pyspark.sql.functions", fromlist=["col"]).col("id"), 41).alias("b"))
    assert df.where("a != b and b != 40").count() == 0
    assert 380 <= df.where("a != b").count() <= 600
    sizes = [r["count"] for r in df.groupBy("a").count().collect()]
    assert len(sizes) == 40 and min(sizes) > 400 and max(sizes) < 600


# 10 -----------------------------------------------------------------------------------------------

LETTER = "Write to Ann.Lee@mail.org or ANN.LEE@MAIL.ORG, call +1 (743) 555-3824, from 8.196.197.208. Card 4465 7583 8288 9437; IBAN DE89 3704 0044 0532 0130 00. Mrs. Anna Schmidt met Herr Schmidt and госпожа Иванова. Schmidt left. token = \"1eb9c654e721b4f812088970e66a6345cee33dd6\""


def test_surrogates(spark, docs):
    df = spark.createDataFrame([(0, LETTER, 1), (1, "ann.lee@mail.org wrote: version 3.1, 4465758382889438, 999.1.1.1", 2), (2, None, None), (3, "", 0)], "doc_id long, text string, n_chars long")
    out = {r.doc_id: r for r in pii.surrogates(df, b"key").collect()}
    text = out[0].text
    found = pii.entities(LETTER)
    assert out[0].n_entities == len(found) == 12 and out[0].n_chars == len(text)
    assert not any(LETTER[a:b] in text for a, b, _, _ in found)
    again = pii.entities(text)
    assert [e[2] for e in again] == [e[2] for e in found]  # kinds, check digits, scripts and genders are right
    for k in range(len(found)):
        for j in range(k):  # equal entities stay equal, others different
            assert (found[k][2:] == found[j][2:]) == (again[k][2:] == again[j][2:])
    assert out[1].text.startswith(again[0][3]) and out[1].text.endswith(" wrote: version 3.1, 4465758382889438, 999.1.1.1")
    assert (out[2].text, out[3].text, out[2].n_entities) == (None, "", 0)
    assert {r.doc_id: r.text for r in pii.surrogates(df, b"key").collect()} == {k: r.text for k, r in out.items()}
    assert pii.surrogates(df, b"other").where("doc_id = 0").first().text != text
    clean = pii.surrogates(docs.clashing, b"key")
    assert by_id(clean, "text") == {k: (v,) for k, v in docs.texts.items()} and clean.columns == [*docs.clashing.columns, "n_entities"]
    assert pii.surrogates(docs.empty, b"key").count() == 0


def test_clashes_are_drawn_again(spark):
    """Four digits of freedom for thousands of entities: many first draws clash."""
    found = packing.stored(spark.createDataFrame([("ip4", f"9.{a}.{b}.7") for a in range(50) for b in range(100)] + [("name:latin:f", f"n{k}") for k in range(3000)], "kind string, canon string"), "entities")
    rows = pii.assigned(found, b"k").collect()
    assert len(rows) == 8000 == len({(r.kind, r.value) for r in rows}) and max(r.draw for r in rows) > 0
    real = {(r.kind, r.canon) for r in rows}
    assert not any((r.kind, r.value) in real for r in rows)


def test_drawn_again_in_texts(spark):
    rows = [(k, f"Mrs. {''.join(chr(97 + int(d)) for d in str(k)).capitalize()}xx came") for k in range(1000, 7000)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = by_id(pii.surrogates(df, b"k"), "text")
    assert len({v for v in out.values()}) == len(rows)
    assert all(v[0].startswith("Mrs. ") and v[0].endswith(" came") for v in out.values())
