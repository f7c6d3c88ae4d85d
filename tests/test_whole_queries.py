"""Queries run the operator's whole job."""

from mixolve.plans.queries import QUERIES

DATA = "/root/testdata/sf0.001"


def test_distinguishability_has_fifty_concentrations_of_each_type(spark):
    rows = QUERIES["distinguishability"](spark, DATA).collect()
    steps = {}
    for r in rows:
        steps.setdefault(r.cell_type, {})[r.step] = r.concentration
    assert len(rows) == 50 * len(steps) and all(sorted(s) == list(range(50)) for s in steps.values())
    assert all(abs(s[0] - 1e-4) < 1e-9 and abs(s[49] - 0.2) < 1e-9 for s in steps.values())
