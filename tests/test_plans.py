"""Plan shape: no registered query plans a cartesian product or a nested-loop join,
and scans read only the columns they need."""

import contextlib
import io

import pytest

from conftest import SF001

HEAVY = ["feature_table_raw", "spell_candidates", "oversample", "length_batches", "plateau_stop",
         "aligned_ngrams_2", "tfidf_prompt_sim", "misspelled_cnt", "stratified_split", "backsort"]


def plan_text(df):
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        df.explain(mode="formatted")
    return buf.getvalue()


@pytest.mark.parametrize("key", HEAVY)
def test_no_all_pairs_joins(spark, key):
    import __spark_entry__ as E
    plan = plan_text(E.queries()[key](spark, SF001))
    assert "CartesianProduct" not in plan
    assert "BroadcastNestedLoopJoin" not in plan


def test_text_scan_is_pruned(spark):
    import __spark_entry__ as E
    plan = plan_text(E.queries()["word_cnt"](spark, SF001))
    assert "ReadSchema: struct<doc_id:bigint,text:string>" in plan


@pytest.mark.parametrize("key, table, most", [("feature_table_raw", "documents", 3), ("backsort", "documents", 3), ("training_set", "documents", 3),
                                              ("spell_candidates", "documents", 3), ("plateau_stop", "events", 3)])
def test_wide_columns_are_read_few_times(spark, key, table, most):
    """How often the last plan reads a table's texts (of events: any column)."""
    import re
    import __spark_entry__ as E
    buf = io.StringIO()
    with contextlib.redirect_stdout(buf):
        E.queries()[key](spark, SF001).explain(mode="simple")
    scans = re.findall(rf"FileScan parquet \[([^\]]*)\].*{table}\.parquet", buf.getvalue())
    assert sum(table != "documents" or "text" in s for s in scans) <= most
    assert len(scans) <= 12
