"""Lines numbered by ranges of ids, against the views' own numbers."""

import pytest

from ledgerloom.plans.views import Views

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize(("name", "order", "keep"), [("cs", "k, id", "k, "), ("oe", "k, id, n, qty, price, day", "")])
def test_numbers_by_ranges_are_the_views(spark, name, order, keep):
    v = Views(spark, SF)
    cols = ["file", "row", "value"]
    want, got = v._view(name).select(cols), v._numbered(name, order, keep, 13).select(cols)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


@pytest.mark.parametrize("name", ["csv_lines", "order_lines"])
def test_no_task_orders_a_file(spark, name):
    plan = getattr(Views(spark, SF), name)._jdf.queryExecution().optimizedPlan().toString()
    windows = [x for x in plan.splitlines() if "row_number()" in x]
    assert windows and all("_range" in x for x in windows)
