import sys
from pathlib import Path

sys.path.insert(0, str(Path(__file__).parent.parent))

import __spark_entry__ as entry  # noqa: E402
from linewright.plans import registry  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_every_oracle_has_a_query():
    assert set(registry.ORACLES) <= set(registry.QUERIES)
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_entry(spark):
    out = entry.entry(spark)
    assert out.columns == ["doc_id", "ocr_text", "candidate_name", "rank_score"] and out.count() > 0


def test_scalar_queries_scan_once_without_exchange(spark):
    plan = registry.QUERIES["norm_key_rule"](spark, SF)._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and "Python" not in plan and "ReadSchema: struct<doc_id:bigint,text:string>" in plan
