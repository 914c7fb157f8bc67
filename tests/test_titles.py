"""Titles of pages whose character references are quotes or cut off."""

import duckdb

from sparkweave.plans import registry

PAGES = [(1, "<html><body><h1>a &amp;lt; &quot;b&quot; &lt;c&gt; d&amp</h1><p>x</p></body></html>"), (2, "<h1>  one\n two &quot</h1><p>y</p>"), (3, "<p>none</p>")]


def test_character_references_in_titles(spark, tmp_path):
    spark.createDataFrame(PAGES, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    got = registry.QUERIES["html_title_h1"](spark, str(tmp_path))
    pages = registry.values(PAGES, "page_id", "html")
    want = duckdb.sql(registry.ORACLE["html_title_h1"].replace("FROM pages", f"FROM {pages}")).fetchall()
    assert sorted((r["page_id"], r["title"]) for r in got.collect()) == sorted(want) == [(1, 'a &lt; "b" <c> d&'), (2, 'one two "')]
