"""Items whose templates repeat with other values."""

import pytest

pytest.importorskip("chronofold.llm.queries")
from chronofold.llm import decontaminate  # noqa: E402

ITEM = "First you pay 9 coins to enter the hall. Later they pay 4 coins to enter the yard."


def test_exact_copy_of_a_repeating_template(spark):
    docs = [(1, ITEM), (2, "Some words. " + ITEM + " And again they pay 77 coins to enter the house."), (3, ITEM.replace("9", "12").replace("4", "8")), (4, "They pay 3 coins to enter the mill. " * 40 + ITEM), (5, "nothing of it at all in here")]
    got = {r["doc_id"]: r for r in decontaminate.contaminated(spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame([(7, ITEM)], "item_id long, text string")).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert all(r["coverage"] == r["slot_consistency"] == 1.0 for r in got.values())
    assert [got[k]["same_values"] for k in (1, 2, 3, 4)] == [True, True, False, True]
