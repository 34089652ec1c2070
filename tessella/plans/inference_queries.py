"""Inference and listings of the schema, with their SQL."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from tessella.operators import graphs, inference
from tessella.plans.ontology_queries import _PROP, _REC
from tessella.plans.vocabulary import COMMERCE as V


def inferred_types(spark: SparkSession, folder: str) -> DataFrame:
    """Types of all entities by domains, ranges and equivalents."""
    return inference.inferred_types(V, spark, folder)


def subproperty_facts(spark: SparkSession, folder: str) -> DataFrame:
    """Facts that follow from sub-properties."""
    return inference.super_facts(V, spark, folder)


def declared_equivalents(spark: SparkSession, folder: str) -> DataFrame:
    """Declared equivalents in both orders."""
    return graphs.schema_frame(spark, [(c, x) for c in sorted({x for p in V.equivalent for x in p}) for x in V.equivalents(c)], "a string, b string")


def applicable_properties(spark: SparkSession, folder: str) -> DataFrame:
    """Every class with the properties it has, and the superclass that declares each."""
    return graphs.schema_frame(spark, inference.applicable(V), "cls string, property string, declared_on string, inherited boolean")


def class_restrictions(spark: SparkSession, folder: str) -> DataFrame:
    """Every class with the restrictions on it, inherited ones included, as text."""
    return graphs.schema_frame(spark, inference.restrictions(V), "cls string, property string, kind string, text string, inherited boolean")


def property_chains(spark: SparkSession, folder: str) -> DataFrame:
    """Declared chains, a row for each place in a chain, with the domain and range of the whole."""
    rows = [(n, k + 1, p, V.properties[ps[0]].domain, V.properties[ps[-1]].range_class) for n, ps in V.chains.items() for k, p in enumerate(ps)]
    return graphs.schema_frame(spark, rows, "chain string, place int, property string, domain string, reaches string")


def schema_summary(spark: SparkSession, folder: str) -> DataFrame:
    """Classes by module and depth, with their numbers of subclasses and own properties."""
    return graphs.schema_frame(spark, inference.summary(V), "module string, cls string, depth int, n_subclasses int, n_properties int")


_KEYS = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "lineitem": "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d'))"}
_FK = {"placedBy": "o_custkey", "lineOf": "l_orderkey", "lineForPart": "l_partkey", "lineFrom": "l_suppkey", "locatedIn": "c_nationkey", "suppliedFrom": "s_nationkey", "inRegion": "n_regionkey", "eventOf": "user_id"}


def _typed() -> str:
    out = []
    for n, p in V.properties.items():
        if p.inverse_of:
            continue
        value = _FK.get(n) or re.sub(r"^cast\((\w+) as .*$", r"\1", p.value)
        out.append(f"select '{p.table}/' || {_KEYS[p.table]} as entity, '{p.domain}' as type, 'domain' as rule from {p.table} where {value} is not null")
        if p.range_table:
            out.append(f"select '{p.range_table}/' || {_FK[n]}, '{p.range_class}', 'range' from {p.table} where {_FK[n]} is not null")
    return " union ".join(out)


_SAME = ", ".join(f"('{c}', '{x}')" for c in sorted({x for p in V.equivalent for x in p}) for x in V.equivalents(c))
_SUPER = " union ".join(
    f"select '{V.properties[n].table}/' || {_KEYS[V.properties[n].table]} as s, '{up}' as p, '{V.properties[n].range_table}/' || {_FK[n]} as o from {V.properties[n].table}" for n, up in V.subproperties.items()
)
_RES = ", ".join(f"('{c}', '{p}', '{k}', '{inference.render(('restriction', p, k, x))}')" for c, p, k, x in V.restrictions)
_CH = ", ".join(f"('{n}', {k + 1}, '{p}', '{ps[0]}', '{ps[-1]}')" for n, ps in V.chains.items() for k, p in enumerate(ps))
SQL = {
    "inferred_types": f"with t as ({_typed()}), q(a, b) as (values {_SAME}) select * from t union all select distinct entity, b, 'equivalent' from t join q on type = a",
    "subproperty_facts": f"select distinct * from ({_SUPER})",
    "declared_equivalents": f"with d(a, b) as (values {', '.join(f'{p}' for p in V.equivalent)}) select a, b from d union select b, a from d",
    "applicable_properties": f"{_REC}, {_PROP}, u as (select distinct sub, sup from up) select sub as cls, p as property, d as declared_on, d <> sub as inherited from u join prop on d = sup",
    "class_restrictions": f"{_REC}, r(c, p, k, t) as (values {_RES}), u as (select distinct sub, sup from up) select sub as cls, p as property, k as kind, t as text, c <> sub as inherited from u join r on c = sup",
    "property_chains": f"with {_PROP}, c(n, k, p, a, z) as (values {_CH}) select n as chain, k as place, c.p as property, x.d as domain, y.r as reaches from c join prop x on x.p = a join prop y on y.p = z",
    "schema_summary": f"{_REC}, {_PROP}, u as (select sub, sup, min(steps) as steps from up group by 1, 2), top as (select distinct sup from up where sup not in (select c from edge)), d as (select u.sub, u.steps, u.sup from u join top on top.sup = u.sup), m as (select d.sub, d.steps, coalesce((select x.sup from u x join edge e on e.c = x.sup and e.p = d.sup where x.sub = d.sub limit 1), d.sub) as module from d) select module, sub as cls, steps::int as depth, (select count(*) from u where u.sup = m.sub and u.sub <> m.sub)::int as n_subclasses, (select count(*) from prop where prop.d = m.sub)::int as n_properties from m",
}
QUERIES = {f.__name__: f for f in (inferred_types, subproperty_facts, declared_equivalents, applicable_properties, class_restrictions, property_chains, schema_summary)}
