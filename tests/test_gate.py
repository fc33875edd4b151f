"""The gate's plan: what its checks share is written once, and its row is the one of its parts."""

from codelattice.jobs import docs as jobs
from codelattice.operators import docs
from codelattice.sources import docs as source

SF = "/root/testdata/sf0.001"


def test_gate_has_the_row_of_its_parts_and_a_small_plan(spark):
    whole = jobs.QUERIES["gate_summary"](spark, SF)
    parts = docs.gate(jobs._freshness(spark, SF), jobs._dangling(spark, SF), jobs._direct(spark, SF), jobs._ripple(spark, SF), docs.bad_pins(source.anchor_tokens(spark, SF)))
    assert whole.collect() == parts.collect()
    joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
    assert 2 * joins(whole) < joins(parts)
