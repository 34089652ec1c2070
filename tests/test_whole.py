"""Queries over whole tables against brute force on the smallest ones."""

import pandas as pd

from tessella.plans import ontology_queries, scope_queries


def rows(folder, name, *columns):
    return pd.read_parquet(f"{folder}/{name}.parquet", columns=list(columns))


def test_scope_union_has_every_part(spark, folder):
    lines = rows(folder, "lineitem", "l_orderkey", "l_partkey", "l_suppkey")
    supplied = dict(rows(folder, "supplier", "s_suppkey", "s_nationkey").values)
    buyer = dict(rows(folder, "orders", "o_orderkey", "o_custkey").values)
    located = dict(rows(folder, "customer", "c_custkey", "c_nationkey").values)
    want = set()
    for order, part, supplier in lines.values:
        want |= {(part, n) for n in (supplied.get(supplier), located.get(buyer.get(order))) if n is not None}
    got = [tuple(r) for r in scope_queries.scope_union(spark, folder).collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert max(p for p, _ in got) == lines.l_partkey.max() > 20


def triples(folder):
    """All stored object triples."""
    out = set()
    for name, s, p, o, to in [("supplier", "s_suppkey", "suppliedFrom", "s_nationkey", "nation"), ("customer", "c_custkey", "locatedIn", "c_nationkey", "nation"), ("nation", "n_nationkey", "inRegion", "n_regionkey", "region"), ("orders", "o_orderkey", "placedBy", "o_custkey", "customer"), ("events", "event_id", "eventOf", "user_id", "customer")]:
        out |= {(f"{name}/{a}", p, f"{to}/{b}") for a, b in rows(folder, name, s, o).values}
    for (key, p, to), o in zip([("l_orderkey", "lineOf", "orders"), ("l_partkey", "lineForPart", "part"), ("l_suppkey", "lineFrom", "supplier")], lines(folder)[1:]):
        out |= {(f"lineitem/{a}", p, f"{to}/{b}") for a, b in zip(lines(folder)[0], o)}
    return out


def lines(folder):
    """The keys of all lines, and their orders, parts and suppliers."""
    d = rows(folder, "lineitem", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate")
    day = pd.to_datetime(d.l_shipdate).dt.strftime("%Y%m%d")
    key = [f"{a}-{b}-{c}-{e}-{f}" for a, b, c, e, f in zip(d.l_orderkey, d.l_linenumber, d.l_partkey, d.l_suppkey, day)]
    return key, list(d.l_orderkey), list(d.l_partkey), list(d.l_suppkey)


def test_two_steps_reach_lines_orders_and_parts(spark, folder):
    all_ = triples(folder)
    near = {t for t in all_ if "supplier/5" in (t[0], t[2])}
    reached = {x for t in near for x in (t[0], t[2])}
    want = {t for t in all_ if t[0] in reached or t[2] in reached}
    got = [tuple(r) for r in ontology_queries.neighbourhood_2hop(spark, folder).select("s", "p", "o").collect()]
    assert len(got) == len(set(got)) and set(got) == want
    assert {"lineFrom", "lineOf", "lineForPart"} <= {p for _, p, _ in got}


def test_every_record_has_its_evidence(spark, folder):
    kinds = {"O": "OpenOrder", "F": "FilledOrder", "P": "PartialOrder", "view": "ViewEvent", "signup": "SignupEvent", "error": "ErrorEvent", "click": "ClickEvent", "purchase": "PurchaseEvent"}
    want = {(f"lineitem/{k}", "LineItem", "LineItem > Record", "inferred") for k in lines(folder)[0]}
    for name, key, column, parent in [("orders", "o_orderkey", "o_orderstatus", "Order"), ("events", "event_id", "event_type", "Event")]:
        want |= {(f"{name}/{k}", kinds[x], f"{kinds[x]} > {parent} > Record", "inferred") for k, x in rows(folder, name, key, column).itertuples(index=False)}
    got = [tuple(r) for r in ontology_queries.type_evidence(spark, folder).collect()]
    assert len(got) == len(set(got)) and set(got) == want
