"""Addresses, percent codes and backslashes in URLs, and ids at the ends of their range."""

import datetime

import pytest

from orderflow.llm import url_lists

DAY = datetime.date(2024, 5, 1)
CASES = [
    ("http://[2001:DB8::1]:80/a", "[2001:db8::1]", "[2001:db8::1]"),
    ("http://u@[::1]", "[::1]", None),
    ("http://10.0.3.4/x", "10.0.3.4", None),
    ("http://3.4/x", "3.4", "3.4"),
    ("http://a.org/%74est/%7euser%2f", "a.org", "a.org/test"),
    ("http://a.org/%54est", "a.org", None),
    ("http:\\\\a.org\\test\\x", "a.org", "a.org/test"),
    ("http://evil.org\\@a.org/test", "evil.org", "evil.org"),
    ("http://a.org/b%2Fc?q=%41", "a.org", "a.org/b%2Fc?q=A"),
    ("http://a.org/%zz%", "a.org", None),
]


def test_hosts_and_paths_as_browsers_read_them(spark):
    patterns = ["[2001:db8::1]", "3.4", "4", "a.org/%74est", "evil.org", "a.org/b%2fc?q=%41"]
    entries = spark.createDataFrame([(p, datetime.date(2024, 1, 1), "add") for p in patterns], "pattern string, listed_on date, action string")
    captures = spark.createDataFrame([(k, u, DAY) for k, (u, _, _) in enumerate(CASES)], "page_id long, url string, fetched_on date")
    got = {r.page_id: (r.host, r.entry) for r in url_lists.flag_captures(captures, entries).collect()}
    read = {"a.org/%74est": "a.org/test"}
    assert got == {k: (host, read.get(entry, entry)) for k, (_, host, entry) in enumerate(CASES)}


@pytest.mark.parametrize("page_id", [2**63 - 1, -(2**63), 2**62 // 3, -1])
def test_ids_at_the_ends(spark, tmp_path, page_id):
    spark.createDataFrame([(page_id, "http://a.org/x"), (None, None)], "page_id long, url string").write.parquet(f"{tmp_path}/pages.parquet")
    got = {r.page_id: r.fetched_on for r in url_lists.op9_url_filter(spark, str(tmp_path)).collect()}
    assert got == {page_id: datetime.date(2024, 1, 1) + datetime.timedelta(page_id * 37 % 365), None: None}
