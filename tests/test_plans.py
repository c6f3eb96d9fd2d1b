"""Plan-shape guards: partial aggregation before the shuffle, pruned scans, no pair blow-ups."""

import re

import pytest

SF = "/root/testdata/sf0.001"


def plan_of(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_dedupe_aggregates_before_the_shuffle(spark):
    from __spark_entry__ import queries
    p = plan_of(queries()["clean_job"](spark, SF))
    assert "partial_min_by" in p and "hashpartitioning" in p
    # exactly one hash shuffle (the dedupe) besides the round-robin spread of a narrow input
    assert len(re.findall(r"Exchange hashpartitioning", p)) == 1


def test_scans_read_only_used_columns(spark):
    from __spark_entry__ import queries
    p = plan_of(queries()["amount_symbols"](spark, SF))
    schema = re.search(r"ReadSchema: struct<([^>]*)>", p).group(1)
    assert set(x.split(":")[0] for x in schema.split(",")) == {"o_orderkey", "o_totalprice"}


@pytest.mark.parametrize("name", ["clean_job", "dedupe_first_wins", "clean_stats", "row_accounting",
                                  "project_ignore", "drop_empty_rows", "ghosts_amount_date", "ghosts_text",
                                  "audit_line", "preview", "sql_types"])
def test_no_cartesian_or_nested_loop(spark, name):
    from __spark_entry__ import queries
    p = plan_of(queries()[name](spark, SF))
    assert "CartesianProduct" not in p and "BroadcastNestedLoopJoin" not in p
