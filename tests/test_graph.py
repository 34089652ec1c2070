"""Plans, closure and shapes."""

import pytest
from pyspark.sql import functions as F

from tessella.operators import graphs
from tessella.plans.query import Aggregate, Compiler, Exists, Hop, Plan, PlanError
from tessella.plans.query import Test as Check
from tessella.plans.vocabulary import COMMERCE


@pytest.fixture
def compiler(spark, folder):
    return Compiler(COMMERCE, spark, folder)


@pytest.mark.parametrize(
    "plan",
    [
        Plan("Customer", tests=(Check("orderTotal", ">", 1),)),
        Plan("Customer", where=Exists((Hop("lineOf"),))),
        Plan("Customer", tests=(Check("balance", "in", 3),)),
        Plan("Customer", tests=(Check("balance", "~", 3),)),
        Plan("Customer", related=(Hop("hasOrder"),), aggregate=Aggregate("sum")),
        Plan("Customer", related=(Hop("hasOrder"),), aggregate=Aggregate("count", "orderTotal")),
        Plan("Nation", anchor=("nation", 1), traversal=(Hop("inRegion"),)),
        Plan("Part", where=Exists((Hop("nothing"),))),
    ],
)
def test_plans_that_do_not_fit_are_refused(compiler, plan):
    with pytest.raises(PlanError):
        compiler.run(plan)


def test_subclass_closure_and_disjointness():
    up = COMMERCE.ancestors("PromoPart")
    assert up == {"PromoPart": ("PromoPart",), "Part": ("PromoPart", "Part"), "Item": ("PromoPart", "Part", "Item"), "Thing": ("PromoPart", "Part", "Item", "Thing")}
    assert COMMERCE.are_disjoint("PromoPart", "Customer") and not COMMERCE.are_disjoint("PromoPart", "SmallPart")
    assert graphs.verify(COMMERCE, "PromoPart", "subclass_of", "Item") == "ENTAILED"
    assert graphs.verify(COMMERCE, "PromoPart", "subclass_of", "Customer") == "CONTRADICTED"
    assert graphs.verify(COMMERCE, "PromoPart", "subclass_of", "SmallPart") == "UNKNOWN"
    assert graphs.verify(COMMERCE, "PromoPart", "subclass_of", "Nonsense") == "INVALID_REQUEST"
    assert graphs.verify(COMMERCE, "hasOrder", "inverse_of", "placedBy") == "ENTAILED"
    assert graphs.verify(COMMERCE, "placedBy", "range_of", "Party") == "ENTAILED"


def test_closure_of_a_cycle_ends(spark):
    e = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("x", None)], "s string, o string")
    got = {(r.s, r.o): r.steps for r in graphs.transitive_closure(e).collect()}
    assert got == {("a", "b"): 1, ("b", "c"): 1, ("c", "a"): 1, ("a", "c"): 2, ("b", "a"): 2, ("c", "b"): 2, ("a", "a"): 3, ("b", "b"): 3, ("c", "c"): 3}
    with pytest.raises(ValueError, match="more than 2"):
        graphs.transitive_closure(spark.createDataFrame([(i, i + 1) for i in range(5)], "s int, o int"), most=2)


def test_graph_hash_ignores_order_and_repeats(spark):
    rows = [("a", "p", "b"), ("b", "p", "c")]
    one = graphs.graph_hash(spark.createDataFrame(rows, "s string, p string, o string")).first()
    two = graphs.graph_hash(spark.createDataFrame([rows[1], rows[0], rows[0]], "s string, p string, o string")).first()
    other = graphs.graph_hash(spark.createDataFrame(rows[:1], "s string, p string, o string")).first()
    assert one == two and one != other


def test_scan_filters_are_pushed_down_and_columns_pruned(compiler):
    plan = compiler.run(Plan("PromoPart"))._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(p_type), EqualTo(p_type,PROMO)" in plan
    assert "p_retailprice" not in plan.split("== Physical Plan ==")[1]


def test_anchored_query_against_a_plain_join(compiler, spark, folder):
    t = lambda n: spark.read.parquet(f"{folder}/{n}.parquet")
    got = {r.entity for r in compiler.run(Plan("Order", anchor=("nation", 3), traversal=(Hop("locatedIn", inverse=True), Hop("placedBy", inverse=True)))).collect()}
    want = t("orders").join(t("customer"), F.col("o_custkey") == F.col("c_custkey")).where("c_nationkey = 3")
    assert got == {f"orders/{r.o_orderkey}" for r in want.collect()}
