"""Graph queries over the relational tables, with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from tessella.plans.query import Aggregate, And, Compiler, Exists, Hop, Not, Or, Plan, Test
from tessella.plans.vocabulary import COMMERCE

ORDERS, CUSTOMER, NATION, REGION = Hop("hasOrder"), Hop("placedBy"), Hop("locatedIn"), Hop("inRegion")

PLANS: dict[str, Plan] = {
    "type_scan_closure": Plan("Party"),
    "type_scan_leaf": Plan("PromoPart"),
    "count_instances": Plan("Record", count=True),
    "path_forward": Plan("OpenOrder", related=(CUSTOMER,)),
    "path_inverse": Plan("Customer", related=(Hop("placedBy", inverse=True, cls="FilledOrder"),)),
    "path_three_hop": Plan("LineItem", related=(Hop("lineOf"), CUSTOMER, Hop("locatedIn", key=7))),
    "anchored_traversal": Plan("Order", anchor=("nation", 3), traversal=(Hop("locatedIn", inverse=True), Hop("placedBy", inverse=True))),
    "anchored_with_hop_class": Plan("LineItem", anchor=("region", 2), traversal=(Hop("inRegion", inverse=True), Hop("locatedIn", inverse=True, cls="BuildingCustomer"), Hop("placedBy", inverse=True, cls="OpenOrder"), Hop("lineOf", inverse=True))),
    "related_filter_contains": Plan("Order", tests=(Test("customerName", "contains", "00012", (CUSTOMER,)),)),
    "filter_eq_iri": Plan("Order", where=Exists((Hop("placedBy", key=42),))),
    "filter_in_codes": Plan("Order", tests=(Test("priority", "in", ["1-URGENT", "2-HIGH"]),)),
    "filter_numeric_range": Plan("Part", tests=(Test("retailPrice", ">=", 950), Test("retailPrice", "<", 1000))),
    "label_filter_hop": Plan("Customer", where=Exists((NATION, Hop("inRegion", label="ASIA")))),
    "exclusion": Plan("Nation", exclude=(("nation", 0), ("nation", 4))),
    "code_ordinal_at_or_above": Plan("Order", tests=(Test("priority", "in", list(COMMERCE.codes["priority"][3:])),)),
    "date_range_target": Plan("Order", date_range=("orderDate", "1997-01-01", "1997-03-31")),
    "date_range_related": Plan("Customer", related=(ORDERS,), related_date_range=("orderDate", "1999-06-01", None), aggregate=Aggregate("count")),
    "where_and_or_not": Plan("Customer", where=And((Or((Test("balance", ">", 9000), Test("balance", "<", 100))), Not(Test("priority", "=", "1-URGENT", (ORDERS,)))))),
    "exists_path": Plan("Customer", where=Exists((ORDERS, Hop("lineOf", inverse=True), Hop("lineForPart", cls="PromoPart")))),
    "not_exists_path": Plan("Customer", where=Not(Exists((ORDERS,)))),
    "optional_path": Plan("Nation", project={"customer_balance": ((Hop("locatedIn", inverse=True, cls="FurnitureCustomer"),), "balance")}),
    "optional_projection_order": Plan("Part", project={"price": ((), "retailPrice"), "size": ((), "partSize")}, order=("price", True), limit=25),
    "latest_record": Plan("Customer", related=(ORDERS,), latest="orderDate"),
    "latest_in_window": Plan("Customer", related=(ORDERS,), related_date_range=("orderDate", None, "1998-12-31"), latest="orderDate"),
    "agg_count_having": Plan("Customer", related=(ORDERS,), aggregate=Aggregate("count", having=(">=", 12))),
    "agg_sum": Plan("Supplier", related=(Hop("lineFrom", inverse=True),), aggregate=Aggregate("sum", "extendedPrice")),
    "agg_avg": Plan("Nation", related=(Hop("locatedIn", inverse=True),), aggregate=Aggregate("avg", "balance")),
    "agg_max": Plan("Customer", related=(ORDERS,), aggregate=Aggregate("max", "orderTotal", having=(">", 400000.0))),
    "agg_min": Plan("Customer", related=(ORDERS,), aggregate=Aggregate("min", "orderTotal", having=("<", 5000.0))),
    "rank_top_n": Plan("Customer", related=(ORDERS,), aggregate=Aggregate("count"), order=("value", True), limit=20),
    "page_offset": Plan("Customer", related=(ORDERS,), aggregate=Aggregate("count"), order=("value", True), limit=10, offset=15),
    "region_top_customers": Plan("Customer", where=Exists((NATION, Hop("inRegion", label="EUROPE"))), related=(ORDERS,), aggregate=Aggregate("count", having=(">=", 5)), order=("value", True), limit=10),
}

_LINE = "concat('lineitem/', concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')))"
_C, _O = "'customer/' || c_custkey", "'orders/' || o_orderkey"
_RANKED = "select entity, value, rk from (select entity, value, row_number() over (order by value desc, entity) as rk from ({}))"
_COUNTS = f"select {_C} as entity, count(distinct o_orderkey) as value from customer join orders on o_custkey = c_custkey group by 1"

SQL: dict[str, str] = {
    "type_scan_closure": f"select {_C} as entity from customer union all select 'supplier/' || s_suppkey from supplier",
    "type_scan_leaf": "select 'part/' || p_partkey as entity from part where p_type = 'PROMO'",
    "count_instances": f"select (select count(*) from orders) + (select count(*) from events) + (select count(distinct {_LINE}) from lineitem) as n",
    "path_forward": f"select {_O} as entity, 'customer/' || o_custkey as related from orders where o_orderstatus = 'O'",
    "path_inverse": f"select {_C} as entity, {_O} as related from orders join customer on o_custkey = c_custkey where o_orderstatus = 'F'",
    "path_three_hop": f"select distinct {_LINE} as entity, 'nation/7' as related from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey where c_nationkey = 7",
    "anchored_traversal": f"select {_O} as entity from orders where o_custkey in (select c_custkey from customer where c_nationkey = 3)",
    "anchored_with_hop_class": f"select distinct {_LINE} as entity from lineitem where l_orderkey in (select o_orderkey from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey where o_orderstatus = 'O' and c_mktsegment = 'BUILDING' and n_regionkey = 2)",
    "related_filter_contains": f"select {_O} as entity from orders join customer on o_custkey = c_custkey where contains(c_name, '00012')",
    "filter_eq_iri": f"select {_O} as entity from orders where o_custkey = 42",
    "filter_in_codes": f"select {_O} as entity from orders where o_orderpriority in ('1-URGENT', '2-HIGH')",
    "filter_numeric_range": "select 'part/' || p_partkey as entity from part where round(p_retailprice, 2) >= 950 and round(p_retailprice, 2) < 1000",
    "label_filter_hop": f"select {_C} as entity from customer join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'ASIA'",
    "exclusion": "select 'nation/' || n_nationkey as entity from nation where n_nationkey not in (0, 4)",
    "code_ordinal_at_or_above": f"select {_O} as entity from orders where cast(left(o_orderpriority, 1) as int) >= 4",
    "date_range_target": f"select {_O} as entity from orders where cast(o_orderdate as date) between date '1997-01-01' and date '1997-03-31'",
    "date_range_related": f"select {_C} as entity, count(distinct o_orderkey) as value from customer join orders on o_custkey = c_custkey where cast(o_orderdate as date) >= date '1999-06-01' group by 1",
    "where_and_or_not": f"select {_C} as entity from customer where (c_acctbal > 9000 or c_acctbal < 100) and not exists (select 1 from orders where o_custkey = c_custkey and o_orderpriority = '1-URGENT')",
    "exists_path": f"select {_C} as entity from customer where exists (select 1 from orders join lineitem on l_orderkey = o_orderkey join part on l_partkey = p_partkey where o_custkey = c_custkey and p_type = 'PROMO')",
    "not_exists_path": f"select {_C} as entity from customer where not exists (select 1 from orders where o_custkey = c_custkey)",
    "optional_path": "select distinct 'nation/' || n_nationkey as entity, cast(c_acctbal as decimal(18,2)) as customer_balance from nation left join customer on c_nationkey = n_nationkey and c_mktsegment = 'FURNITURE'",
    "optional_projection_order": "select 'part/' || p_partkey as entity, cast(p_retailprice as decimal(18,2)) as price, p_size as size, row_number() over (order by cast(p_retailprice as decimal(18,2)) desc, 'part/' || p_partkey) as rk from part qualify rk <= 25",
    "latest_record": f"select {_C} as entity, {_O} as related from customer join orders on o_custkey = c_custkey where cast(o_orderdate as date) = (select max(cast(x.o_orderdate as date)) from orders x where x.o_custkey = c_custkey)",
    "latest_in_window": f"select {_C} as entity, {_O} as related from customer join orders on o_custkey = c_custkey where cast(o_orderdate as date) = (select max(cast(x.o_orderdate as date)) from orders x where x.o_custkey = c_custkey and cast(x.o_orderdate as date) <= date '1998-12-31')",
    "agg_count_having": f"select * from ({_COUNTS}) where value >= 12",
    "agg_sum": "select 'supplier/' || s_suppkey as entity, round(sum(p)::double, 4) as value from (select distinct l_suppkey, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) as k, cast(l_extendedprice as decimal(18,2)) as p from lineitem) join supplier on l_suppkey = s_suppkey group by 1",
    "agg_avg": "select 'nation/' || n_nationkey as entity, round(avg(cast(c_acctbal as decimal(18,2)))::double, 4) as value from nation join customer on c_nationkey = n_nationkey group by 1",
    "agg_max": f"select {_C} as entity, max(cast(o_totalprice as decimal(18,2)))::double as value from customer join orders on o_custkey = c_custkey group by 1 having max(o_totalprice) > 400000",
    "agg_min": f"select {_C} as entity, min(cast(o_totalprice as decimal(18,2)))::double as value from customer join orders on o_custkey = c_custkey group by 1 having min(o_totalprice) < 5000",
    "rank_top_n": _RANKED.format(_COUNTS) + " where rk <= 20",
    "page_offset": _RANKED.format(_COUNTS) + " where rk between 16 and 25",
    "region_top_customers": _RANKED.format(
        f"select {_C} as entity, count(*) as value from customer join orders on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'EUROPE' group by 1 having count(*) >= 5"
    ) + " where rk <= 10",
}


def _query(plan: Plan) -> Callable[[SparkSession, str], DataFrame]:
    return lambda spark, folder: Compiler(COMMERCE, spark, folder).run(plan)


QUERIES = {name: _query(plan) for name, plan in PLANS.items()}
