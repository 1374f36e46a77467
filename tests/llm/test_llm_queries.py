"""The numbered queries against their SQL, and all operators on odd and on empty tables."""

import datetime
import gzip
import io
import re

import numpy as np
import pytest
from helpers import rows_of, sql_rows
from helpers_llm import DOCS, FOLDER, odd_documents
from pyspark.sql import functions as F

from orderflow import llm
from orderflow.llm import decontaminate, html_extract, knn_quality, licenses, pieces, quality_rules, secret_scan, simhash, url_lists, warc
from orderflow.llm._shared import scratch_path


@pytest.mark.parametrize("name", sorted(llm.oracle_sql()))
def test_same_rows_as_sql(spark, name):
    assert rows_of(llm.queries()[name](spark, FOLDER)) == sql_rows(llm.oracle_sql()[name], FOLDER)


def test_all_numbers_are_there():
    assert sorted(int(n[2:].split("_")[0]) for n in llm.queries()) == list(range(1, 14))


BENCHMARK = "item_id long, text string"


def operators(spark, docs):
    bench = spark.createDataFrame([(1, "un deux"), (None, "seul"), (2, None)], BENCHMARK)
    labels = docs.where("doc_id IS NOT NULL").select("doc_id", (F.col("doc_id") % 2).cast("int").alias("quality"))
    return {
        "simhash": lambda: simhash.near_duplicate_classes(docs),
        "licenses": lambda: licenses.license_matches(docs),
        "pieces": lambda: pieces.encode_pieces(docs, pieces.model_bytes()),
        "ledger": lambda: quality_rules.ledger(docs),
        "secrets": lambda: secret_scan.scan(docs),
        "matches": lambda: decontaminate.benchmark_matches(docs, bench),
        "no benchmark": lambda: decontaminate.benchmark_matches(docs, bench.limit(0)),
        "knn": lambda: knn_quality.score(docs, knn_quality.fit(docs, labels)),
        "redact": lambda: secret_scan.redact(docs),
    }


@pytest.mark.parametrize("name", ["simhash", "licenses", "pieces", "ledger", "secrets", "matches", "no benchmark", "knn", "redact"])
def test_one_row_per_odd_row_and_none_for_none(spark, name):
    docs = odd_documents(spark)
    assert operators(spark, docs)[name]().count() == docs.count()
    assert operators(spark, spark.createDataFrame([], DOCS))[name]().count() == 0


def test_filters_keep_columns(spark):
    docs, bench = odd_documents(spark), spark.createDataFrame([(1, "un deux")], BENCHMARK)
    deduped = simhash.drop_near_duplicates(docs)
    assert deduped.columns == docs.columns
    # null and blank texts are one class, its smallest id stays; the text that is there three times stays once
    assert sorted((r.doc_id or 0, r.fp) for r in deduped.collect()) == [(1, 7), (4, 7), (5, 7), (6, 7)]
    clean = decontaminate.drop_contaminated(docs, bench)
    assert clean.columns == docs.columns and clean.where("contains(text, 'deux')").isEmpty() and clean.count() == 6
    kept = quality_rules.keep_documents(docs)
    assert kept.columns == docs.columns and kept.schema == docs.schema
    masked = secret_scan.redact(docs)
    assert masked.columns == docs.columns and {r["__key"] for r in masked.collect()} == {"k"}
    hidden = masked.where("doc_id = 5").first()
    assert "<SECRET>" in hidden.text and "0123456789abcdef" not in hidden.text and hidden.n_chars == len(hidden.text)
    empty = spark.createDataFrame([], DOCS)
    for job in (simhash.drop_near_duplicates, quality_rules.keep_documents, secret_scan.redact, lambda d: decontaminate.drop_contaminated(d, bench)):
        assert job(empty).count() == 0


def test_odd_pages(spark):
    pages = spark.createDataFrame([(1, None, None, "a"), (None, "http://a b/\n", "<p>x" + "y" * 200, "b"), (2, "u", "<p>x" + "y" * 200, "c"), (2, "u", "<p>x" + "y" * 200, "c"), (3, "HTTP://u@A.B.:80/c", "<p>z</p>" * 30_000, "d")], "page_id long, url string, html string, text string")
    text = {(r.page_id, r.n_chars) for r in html_extract.extract_main_text(pages).collect()}
    assert text == {(1, 0), (None, 201), (2, 201), (3, 59_999)}
    out = scratch_path(spark, "test-warc")
    manifest = warc.write_archives(pages, out).collect()
    assert sum(r.records for r in manifest) == 5
    got = sorted((r.page_id or 0, r.record_type, r.refers_to or 0, r.payload_bytes) for r in warc.read_archives(spark, out).collect())
    assert got == [(0, "revisit", 2, 204), (1, "response", 0, 0), (2, "response", 0, 204), (2, "revisit", 2, 204), (3, "response", 0, 240_000)]
    none = scratch_path(spark, "test-warc")
    assert warc.write_archives(pages.limit(0), none).count() == 0
    captures = pages.select("page_id", "url", F.lit("2024-05-01").cast("date").alias("fetched_on"))
    entries = spark.createDataFrame([("a.b", "2024-01-01", "add"), ("b", "2024-01-01", "add"), ("b", "2024-04-01", "remove"), ("a.b", None, "remove"), (None, "2024-01-01", "add")], "pattern string, listed_on string, action string").withColumn("listed_on", F.col("listed_on").cast("date"))
    flags = url_lists.flag_captures(captures, entries)
    assert sorted((r.page_id or 0, r.blocked, r.entry) for r in flags.collect()) == [(0, False, None), (1, False, None), (2, False, None), (2, False, None), (3, True, "a.b")]
    assert url_lists.flag_captures(captures, entries.limit(0)).where("blocked").isEmpty()
    assert url_lists.flag_captures(captures.limit(0), entries).isEmpty()


@pytest.mark.parametrize("ids", ["far apart", "one id", "no id"])
def test_no_shard_is_large(spark, ids):
    """An id far off, one id for all and no ids at all give shards of the asked size, and records with ids of their own."""
    id_of = {"far apart": "CASE WHEN id = 7 THEN 4611686018427387904 ELSE id END", "one id": "5L", "no id": "CAST(NULL AS LONG)"}[ids]
    pages = spark.range(2000).selectExpr(f"{id_of} AS page_id", "concat('u', id) AS url", "concat(repeat('x', 500), id DIV 2) AS html", "'s' AS shard", "1 AS kind", "'d' AS digest")
    out = scratch_path(spark, "test-warc")
    manifest = warc.write_archives(pages, out, shard_bytes=100_000).collect()
    per_shard = {}
    for r in manifest:
        per_shard[r.shard] = per_shard.get(r.shard, 0) + r.records
    assert sum(per_shard.values()) == 2000 and len(per_shard) >= 20 and max(per_shard.values()) <= 110
    got = warc.read_archives(spark, out).collect()
    assert len(got) == 2000 and sum(r.record_type == "revisit" for r in got) == (0 if ids == "no id" else 1000)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.warc.gz").load(out).collect()
    names = [h["warc-record-id"] for f in files for h, _ in warc.records(gzip.GzipFile(fileobj=io.BytesIO(f.content))) if h["warc-type"] != "warcinfo"]
    assert len(set(names)) == 2000
    refers = {h["warc-refers-to"] for f in files for h, _ in warc.records(gzip.GzipFile(fileobj=io.BytesIO(f.content))) if h["warc-type"] == "revisit"}
    assert refers <= set(names)


def test_list_entries_of_hosts_domains_and_paths(spark):
    """Against a plain search, with a top-level domain, a host and a path that a third of all captures fall under; and odd rows."""
    rng, day = np.random.default_rng(4), lambda n: datetime.date(2024, 1, 1) + datetime.timedelta(n)
    hosts = ["a.example.com", "b.example.com", "example.com", "x.org", "a.b.c.d.org", "com"]
    urls = [f"https://{hosts[0 if k % 3 == 0 else rng.integers(0, 6)]}/{'news' if k % 3 == 0 else 'n%d' % rng.integers(0, 3)}/{rng.integers(0, 4)}{'?q=%d' % rng.integers(0, 3) if k % 2 else ''}#f" for k in range(400)]
    urls += [None, "", "no url", "http://", "HTTP://U@A.EXAMPLE.COM.:80", "ftp://x.org//news//1/", "http://x.org?q=1", "http://x.org/?q=1"]
    rows = [(k if k % 9 else None, u, day(int(rng.integers(0, 60))) if k % 11 else None) for k, u in enumerate(urls)]
    entries = [("com", day(40), "add"), ("a.example.com", day(10), "add"), ("a.example.com", day(20), "remove"), ("a.example.com/news", day(5), "add"), ("x.org/n1", day(0), "add"), ("x.org/n1/2?q=1", day(30), "add")]
    entries += [("x.org/news/1", day(0), "add"), ("d.org", day(1), "add"), ("x.org?q=1", day(0), "add"), (None, day(0), "add"), ("x.org", None, "add"), ("x.org", day(0), "other")]
    spans = [(p, a, next((d for q, d, act in entries if q == p and act == "remove"), None)) for p, a, act in entries if p and a and act == "add"]

    def plain(url, on):
        m = re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://(?:[^/?#@]*@)?([^/:?#]+)[^/?#]*([^#]*)", url or "")
        if not m or on is None:
            return None
        host, path = m[1].lower().removesuffix("."), m[2]
        keys = {".".join(host.split(".")[k:]) for k in range(host.count(".") + 1)}
        steps = [s for s in path.split("?")[0].split("/") if s]
        keys |= {"/".join([host, *steps[: k + 1]]) for k in range(len(steps))} | ({host + path} if "?" in path else set())
        return max((p for p, a, b in spans if p in keys and a <= on and (b is None or on < b)), key=lambda p: (len(p), p), default=None)

    captures = spark.createDataFrame([(*r, "host", "best", "path", 1) for r in rows], "page_id long, url string, fetched_on date, host string, best string, path string, part int")
    given = spark.createDataFrame([(*e, "x") for e in entries], "pattern string, listed_on date, action string, deep string")
    got = url_lists.flag_captures(captures, given).collect()
    key = lambda r: (r[0] or -1, r[1] or "", str(r[2]), r[3] or "")
    assert sorted(((r.page_id, r.url, r.fetched_on, r.entry) for r in got), key=key) == sorted(((i, u, on, plain(u, on)) for i, u, on in rows), key=key)
    assert all(r.blocked == (r.entry is not None) for r in got) and len({r.entry for r in got}) >= 7
    assert url_lists.dated_lists(captures.limit(0)).count() == 0 and url_lists.dated_lists(captures).where("pattern IS NULL").isEmpty()
