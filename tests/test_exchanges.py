"""What larger inputs cost: rows are exchanged by document once, before anything is rendered from them, and answers are decoded once."""

from __future__ import annotations

import pytest
from conftest import SF_SMALL

from vatloom.plans import registry


def plans(spark, name: str) -> tuple[str, str]:
    made = registry.QUERIES[name](spark, SF_SMALL)._jdf.queryExecution()
    return made.optimizedPlan().toString(), made.executedPlan().toString()


def test_layout_documents_joins_without_exchange(spark):
    assert "ENSURE_REQUIREMENTS" not in plans(spark, "layout_documents")[1]


@pytest.mark.parametrize("name", ["layout_lines", "layout_cells"])
def test_layout_answers_are_decoded_once(spark, name):
    logical, physical = plans(spark, name)
    assert logical.count("from_json(") == 1 and "ENSURE_REQUIREMENTS" not in physical
