"""The module of the registered queries itself."""

import ast
import inspect
import os
import re
from collections import Counter

import pytest

from buildlens.plans import catalogue, views

SF = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")


def test_no_name_is_given_twice():
    # a query takes its SQL by name when it runs, so that a second text of that name would replace the first
    names = Counter()
    for node in ast.parse(inspect.getsource(catalogue)).body:
        if isinstance(node, ast.Assign):
            names.update(n.id for t in node.targets for n in ast.walk(t) if isinstance(n, ast.Name) and isinstance(n.ctx, ast.Store))
        elif isinstance(node, ast.FunctionDef):
            names[node.name] += 1
    assert [n for n, times in names.items() if times > 1] == []


@pytest.mark.parametrize("name", ["open_needs", "path_conflicts", "reconcile_outputs", "check_requested", "staging_totals", "unexpected_chunks"])
def test_partitions_grow_with_the_rows(spark, capsys, monkeypatch, name):
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    monkeypatch.setattr(views, "ROWS", -(-n // 60))
    catalogue.QUERIES[name](spark, SF).explain()
    dealt = [(keys, int(parts)) for keys, parts in re.findall(r"hashpartitioning\((.*?), (\d+)\)", capsys.readouterr().out)]
    # rows of lineitem are dealt by these keys; the session has 4 partitions
    many = [(keys, parts) for keys, parts in dealt if re.search(r"job_id#\d+L?, path_id|l_orderkey|build#\d+L?, reference|output#\d+L?, slice", keys)]
    assert many and {parts for _, parts in many} == {60}
