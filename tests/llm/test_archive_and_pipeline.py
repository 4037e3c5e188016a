from __future__ import annotations

import base64
import hashlib
import subprocess
import sys

import pytest

import corpus_pipeline
from lumenkg.llm import decontaminate, langid, packing, warc
from lumenkg.llm.queries import oracle_sql, queries

from test_documents_operators import check_packing, components, ids_of, lines_left  # isort: skip


def test_archive(spark):
    pages = spark.createDataFrame([(1, "http://a", "<p>x</p>"), (2, "http://b%\n", "<p>x</p>"), (3, None, None), (4, "u", ""), (5, "u", "é" * 5000), (6, "u", "<p>x</p>")], "page_id long, url string, html string")
    archive = warc.write(pages)
    rows = {r.page_id: r for r in warc.read(spark, archive).collect()}
    for r in pages.collect():
        raw = (r.html or "").encode()
        same = [p.page_id for p in pages.collect() if (p.html or "") == (r.html or "")]
        got = rows[r.page_id]
        assert (got.payload_bytes, got.payload_digest, got.url) == (len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), r.url)
        assert (got.record_type, got.refers_to) == (("response", None) if r.page_id == max(same) else ("revisit", max(same)))
    assert warc.spark_payloads(spark, archive).count() == 3
    for r in warc.records(spark, archive).collect():
        head, _, rest = bytes(r.record).partition(b"\r\n\r\n")
        length = int(warc.fields(bytes(r.record))["Content-Length"])
        assert len(rest) == length + 4 and rest.endswith(b"\r\n\r\n") and head.startswith(b"WARC/1.1")
    small = {r.page_id: r.record_type for r in warc.read(spark, warc.write(pages, least=100)).collect()}
    assert set(small.values()) == {"response"}
    assert warc.read(spark, warc.write(pages.limit(0))).count() == 0


def test_broken_payload(spark):
    archive = warc.write(spark.createDataFrame([(1, "u", "x")], "page_id long, url string, html string"))
    warc.spark_payloads(spark, archive).selectExpr("key", "cast('y' AS binary) AS payload").coalesce(1).write.mode("append").parquet(archive.payloads)
    with pytest.raises(Exception, match="digest|Python"):
        warc.read(spark, archive).collect()


def test_pipeline(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names = [n for n, _ in corpus_pipeline.STAGES]
    stage = dict(corpus_pipeline.STAGES)
    keep = lambda df: spark.createDataFrame(df.collect(), df.schema)
    texts = lambda df: {r.doc_id: r.text for r in df.collect()}
    assert names == ["language", "lines", "near_duplicates", "decontaminated", "packed"]
    before, after = texts(docs), keep(stage["language"](spark, docs, sf))
    assert all(before[k] == t and langid.has_letter(t) for k, t in texts(after).items()) and after.columns == docs.columns
    left = lines_left(texts(after))
    after = keep(stage["lines"](spark, after, sf))
    assert texts(after) == {k: v[4] for k, v in left.items() if not v[1] or v[4].strip()}
    want = components(texts(after), 5, 80)
    before, after = texts(after), keep(stage["near_duplicates"](spark, after, sf))
    assert texts(after) == {k: before[k] for k, v in want.items() if v[2]}
    items = {r.item_id: r.text for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()}
    hits = decontaminate.brute_force(texts(after), items)
    before, after = texts(after), keep(stage["decontaminated"](spark, after, sf))
    assert set(texts(after)) == {k for k, v in hits.items() if v[1] <= 0.5 * v[0]}
    assert not any(v[1] for k, v in hits.items() if texts(after).get(k) == before[k])
    rows = stage["packed"](spark, after, sf).collect()
    wanted = ids_of(texts(after))
    check_packing(rows, wanted, 2048)
    assert corpus_pipeline.ORACLE_SQL is None
    whole = corpus_pipeline.run(spark, sf)
    assert sorted((r.doc_id, r.piece, r.ids_crc32) for r in whole.collect()) == sorted((r.doc_id, r.piece, r.ids_crc32) for r in rows)


def test_sql(spark):
    import duckdb
    from compare import rows

    sf, duck = "/root/testdata/sf0.001", duckdb.connect()
    for t in ("documents", "benchmark", "pages", "embeddings"):
        duck.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    for name, sql in oracle_sql().items():
        found = queries()[name](spark, sf)
        asked = duck.execute(sql)
        cols = [d[0] for d in asked.description]
        assert sorted(found.columns) == sorted(cols)
        assert rows(found.columns, found.collect()) == rows(cols, asked.fetchall()), name


def test_the_rest_stands_alone():
    """Without the subpackage and the pipeline, the entry point still imports."""
    code = "import sys; sys.path.insert(0, '.'); sys.modules['lumenkg.llm'] = sys.modules['corpus_pipeline'] = None; import __spark_entry__ as e; assert not [n for n in e.queries() if n.startswith('op') or n == 'pipeline']; print(len(e.oracle_sql()))"
    done = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, cwd=str(corpus_pipeline.__file__).rsplit("/", 1)[0], check=False)
    assert done.returncode == 0, done.stderr
    assert packing is not None
