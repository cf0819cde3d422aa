"""Queries whose programs run: also where the session's master is a cluster, for which `verify` wants a choice."""

from __future__ import annotations

import json
import re
import tempfile

import pytest
from test_catalogue import rows_of

from sluicebox.functions import pysource as py
from sluicebox.operators import verify
from sluicebox.plans import catalogue
from sluicebox.plans.code_queries import TRUTH


@pytest.fixture
def cluster(spark, monkeypatch):
    """The tests' session under the name of a cluster's master."""
    monkeypatch.setattr(spark.sparkContext, "master", "spark://host:7077")
    return spark


def test_others_must_choose(cluster):
    rows = cluster.createDataFrame([("x = 1", "[]", "standard_input", "f")], "code string, cases string, io_mode string, fn_name string")
    with pytest.raises(ValueError, match="choose how programs are run"):
        verify.verify(rows)


@pytest.mark.parametrize("name", ["process_counters", "process_one", "score_completion", "verify_code", "verify_reference"])
def test_same_as_sql_on_a_cluster(name, cluster, data, duck):
    got = catalogue.QUERIES[name](cluster, data)
    want = duck.sql(catalogue.ORACLES[name])
    assert rows_of(got.columns, [tuple(r) for r in got.collect()]) == rows_of(want.columns, want.fetchall())


def test_counters_do_not_read_texts(spark, data):
    """Answers are read once; what is counted comes from the columns beside them."""
    plan = catalogue.QUERIES["process_counters"](spark, data)._jdf.queryExecution().executedPlan().toString()
    read = re.findall(r"FileScan parquet \[([^\]]*)\]", plan)
    assert read
    assert not [x for x in read if "answer#" in x or "locked#" in x]


def test_temp_folder_named_from_the_working_folder(tmp_path, monkeypatch):
    """An executor's temp folder may be /proc/self/cwd/.tmp, which is another folder for a program that runs elsewhere."""
    (tmp_path / ".tmp").mkdir()
    monkeypatch.chdir(tmp_path)
    monkeypatch.setattr(tempfile, "tempdir", "/proc/self/cwd/.tmp")
    cases, expected, _ = TRUTH["score_completion"]
    for case, want in zip(cases, expected, strict=True):
        code = py.extract_code(case["text"], case["io_mode"], case["fn_name"])
        if code is not None:
            got = verify.verify_code(code, json.loads(case["cases"]), case["io_mode"], case["fn_name"])
            assert got.error is None
            assert got.pass_rate == (1.0 if want["code_reward"] == 1.0 else 0.5)
