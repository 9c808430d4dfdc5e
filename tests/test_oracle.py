"""Every registered query against its DuckDB oracle on the smallest fixture."""

import os
import sys

import pytest

sys.path.insert(0, os.path.join(os.path.dirname(os.path.dirname(os.path.abspath(__file__))), "tools"))

import __spark_entry__ as entry  # noqa: E402
from oracle_check import canon, duck  # noqa: E402

SF = "/root/testdata/sf0.001"
ORACLES = entry.oracle_sql()
NAMES = sorted(ORACLES)


@pytest.fixture(scope="module")
def con():
    return duck(SF)


@pytest.mark.parametrize("name", NAMES)
def test_query_matches_oracle(spark, con, name):
    df = entry.queries()[name](spark, SF)
    srows = [tuple(r) for r in df.collect()]
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "EvalPython" not in plan and "InPandas" not in plan, "a Python UDF entered the plan"
    cur = con.execute(ORACLES[name])
    dcols = [d[0] for d in cur.description]
    drows = cur.fetchall()
    sc, sv, sh = canon(df.columns, srows)
    dc, dv, dh = canon(dcols, drows)
    assert sc == dc
    assert len(sv) == len(dv)
    assert sv == dv


def test_every_query_has_oracle_or_is_a_model_fit():
    no_oracle = {q for q in set(entry.queries()) - set(ORACLES) if not q.startswith("op") and q != "pipeline"}
    assert no_oracle <= {"ensemble_scores", "ensemble_confusion", "ensemble_report"}


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["subject_id", "charttime", "itemid", "valuenum"]
    assert df.count() >= 0


def test_flagship_plan_keeps_events_unshuffled(spark):
    """The event scan is pruned and joined by broadcast; only the result is range-sorted."""
    df = entry.queries()["cohort_lookback_a"](spark, "/root/testdata/sf0.01")
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan and "LeftSemi" in plan
    assert "hashpartitioning(subject_id" not in plan  # no per-subject shuffle of the events
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in \
        df._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted"))


def _plan(spark, df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_word_counts_and_tick_dedup_stay_hash_aggregates(spark):
    from chartwise.operators import predictions, text
    from chartwise.sources import fixtures as fx
    from chartwise.sources.tables import Tables

    t = Tables(spark, SF)
    words = text.top_words(fx.works(t))
    assert "SortAggregate" not in _plan(spark, words)
    dedup = predictions.first_per_tick(fx.pred(t))
    plan = _plan(spark, dedup)
    assert "HashAggregate" in plan and "SortAggregate" not in plan


def test_variant_b_has_no_per_subject_window(spark):
    df = entry.queries()["readmitted_stays_b"](spark, SF)
    plan = _plan(spark, df)
    # stay numbers come from slice positions, not row_number() over each subject's stays
    assert "row_number() windowspecdefinition(subject_id" not in plan
    assert "lag(" not in plan


@pytest.mark.parametrize("name", ["pred_first", "pred_halves"])
def test_expanded_predictions_are_not_shuffled(spark, name):
    """Ids are dealt, to a stated number of tasks, before they become rows; the rows stay where they are made."""
    df = entry.queries()[name](spark, SF)
    plan = df._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan[:plan.rindex("Generate")] and "REPARTITION_BY_NUM" in plan
    assert df.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions"))


@pytest.mark.parametrize("name", ["forecast_highs", "city_highs", "page_ads"])
def test_pages_of_one_file_are_parsed_in_many_tasks(spark, name):
    df = entry.queries()[name](spark, SF)
    assert df.rdd.getNumPartitions() >= int(spark.conf.get("spark.sql.shuffle.partitions")) > 1
