"""The plans of the registered core queries: no cartesian product, no Python in them, narrow scans."""

import os
import re

import pytest

from atlasloom.plans import registry

D = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(D), reason="no test tables")
#: These run blocks in pandas, or loop over written tables.
OTHER = {"vector_join", "word_set_join", "p2_found", "p2_paths", "p2_descendants", "container_paths", "block_chunks", "chunk_titles", "version_diffs", "node_neighbours"}


def plan(spark, name):
    return registry.QUERIES[name](spark, D)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - OTHER))
def test_plan(spark, name):
    text = plan(spark, name)
    assert "CartesianProduct" not in text
    assert "Python" not in text and "MapInArrow" not in text and "Pandas" not in text


def test_narrow_scans(spark):
    for name in ("active_nodes", "effective_tiers", "vector_coverage", "priority_scores"):
        nodes = [s for s in re.findall(r"ReadSchema: struct<([^>]*(?:>[^>]*)?)", plan(spark, name))]
        assert nodes and not any("detail:" in s for s in nodes), name
    assert "PushedFilters: [IsNotNull(id)" in plan(spark, "repeated_deliveries")


def test_entry_without_the_text_operators(monkeypatch):
    import importlib

    import __spark_entry__ as e

    def broken(name, *a):
        raise ImportError(name)

    monkeypatch.setattr(importlib, "import_module", broken)
    assert set(e.queries()) == set(registry.QUERIES) and set(e.oracle_sql()) <= set(e.queries())
