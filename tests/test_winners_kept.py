"""What a task sorts to find winners: only the columns asked for, and of the full texts a quarter of what the session's partitions would hold."""

from __future__ import annotations

import re

from conftest import SF_SMALL

from vatloom.plans import registry


def test_full_texts_sort_little(spark):
    made = registry.QUERIES["fulltext_regex"](spark, SF_SMALL)._jdf.queryExecution()
    wanted = 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert re.search(rf"hashpartitioning\(doc_id#\d+L?, {wanted}\), REPARTITION_BY_NUM", made.executedPlan().toString())
    line = next(x for x in made.optimizedPlan().toString().split("\n") if "max_by" in x)
    assert "source_text" not in line and "confidence" in line
