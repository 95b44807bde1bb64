"""Every registered query against its SQL on the same tables."""

import pytest
from compare import compare

import __spark_entry__ as entry
from driftspark.catalog import ORACLES, QUERIES

# Trained models and micro-batches: minutes, and covered by their own tests.
SLOW = {"drift_log", "drift_monitor", "compare_training", "train_all", "rescore_saved", "block_trees",
        "static_baseline", "ensemble_metrics", "kmeans_on_sample", "ensemble_scores_joined"}


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_sql(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), ORACLES[name], sf) is None


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(ORACLES) - SLOW))
def test_query_has_rows(spark, sf, name):
    assert QUERIES[name](spark, sf).count() > 0


def test_entry(spark):
    df = entry.entry(spark)
    assert df.columns == ["feature", "ks"]
    assert df.count() == 4
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_workers_need_no_installed_package(sf, tmp_path):
    """Run from another folder: task functions travel with the task."""
    import os
    import subprocess
    import sys

    root = os.path.dirname(os.path.abspath(entry.__file__))
    code = (f"import sys; sys.path.insert(0, {root!r}); import __spark_entry__ as e; "
            "from pyspark.sql import SparkSession; "
            "s = SparkSession.builder.master('local[2]').config('spark.sql.shuffle.partitions', '4')"
            ".config('spark.ui.enabled', 'false').getOrCreate(); "
            f"print('rows', e.queries()['swd_null'](s, {sf!r}).count(), e.queries()['swd_embeddings'](s, {sf!r}).count())")
    out = subprocess.run([sys.executable, "-c", code], cwd=tmp_path, capture_output=True, text=True, timeout=300)
    assert "rows 31 1" in out.stdout, out.stderr[-2000:]
