"""Every query against its DuckDB counterpart; the rest run and give rows."""

import pytest
from conftest import rows_of

from foliospark.plans import registry


@pytest.mark.parametrize("name", sorted(registry.SQL))
def test_same_as_sql(name, spark, duck, sf_dir):
    got = registry.QUERIES[name](spark, sf_dir).toPandas()
    want = duck.execute(registry.SQL[name]).df()
    assert sorted(got.columns) == sorted(want.columns)
    assert rows_of(got) == rows_of(want)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.SQL)))
def test_runs(name, spark, sf_dir):
    assert registry.QUERIES[name](spark, sf_dir).count() > 0


def test_guarded_verdict_has_all_outcomes(spark, sf_dir):
    seen = {r["status"] for r in registry.QUERIES["guarded_verdict"](spark, sf_dir).select("status").distinct().collect()}
    assert {"policy_blocked", "unsafe_content"} <= seen and len(seen) > 2


def test_entry_module(spark):
    import __spark_entry__ as entry

    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert entry.entry(spark).columns


def test_candidates_before_rerank(spark, sf_dir):
    """Vectors, signals and ranks are for candidates; small sides are broadcast; no Python in the text plans."""
    plan = registry.QUERIES["hybrid_topk"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "Python" not in plan
    assert "Python" not in registry.QUERIES["page_text"](spark, sf_dir)._jdf.queryExecution().executedPlan().toString()


def test_sections_of_odd_texts_same_as_sql(spark, tmp_path):
    """Texts that are missing, blank, begin with a heading, have bare headings or other line breaks."""
    import duckdb

    texts = [None, "", " ", "\n", "## A\nb", "## ", "a\n## B \nc\n## \nd\n##  E", "a\r\n## B\r\nc", "a\u2028## B\nc", "a\r## B", "a\u0085## B", "a\x01b", "a\n\n\n## B\n\n\n## C", "plain"]
    rows = [(5 * i + k, t, "en", "src1", len(t or "")) for i, t in enumerate(texts) for k in range(5)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    for name in ("sections", "changed_sections", "change_events"):
        assert rows_of(registry.QUERIES[name](spark, str(tmp_path)).toPandas()) == rows_of(con.execute(registry.SQL[name]).df())
