"""Closure, inference, evidence and shape queries, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.functions.dates import day
from tessella.operators import graphs
from tessella.plans.asof_queries import _sql_day
from tessella.plans.vocabulary import COMMERCE as V
from tessella.sources.tables import table

_FIELDS = "s string, p string, o string"


def subclass_closure(spark: SparkSession, folder: str) -> DataFrame:
    """(sub, sup, steps) of the class hierarchy."""
    return graphs.schema_frame(spark, V.subclass_pairs(), "sub string, sup string, steps int")


def subclass_shortest_chain(spark: SparkSession, folder: str) -> DataFrame:
    """The shortest chain from every class to every superclass."""
    rows = [(c, a, " > ".join(chain)) for c in V.classes() for a, chain in V.ancestors(c).items() if a != c]
    return graphs.schema_frame(spark, rows, "sub string, sup string, chain string")


def verify_matrix(spark: SparkSession, folder: str) -> DataFrame:
    """The verdict on every pair of classes, and of properties and classes or properties, for all six relations."""
    c, p = V.classes(), sorted(V.properties)
    rows = [(a, r, b, graphs.verify(V, a, r, b)) for a in c for b in c for r in ("subclass_of", "disjoint_with", "equivalent_to")]
    rows += [(a, r, b, graphs.verify(V, a, r, b)) for a in p for b in c for r in ("domain_of", "range_of")] + [(a, "inverse_of", b, graphs.verify(V, a, "inverse_of", b)) for a in p for b in p]
    return graphs.schema_frame(spark, rows, "subject string, relation string, object string, verdict string")


def disjoint_pairs(spark: SparkSession, folder: str) -> DataFrame:
    """Pairs of classes that cannot share an instance."""
    c = V.classes()
    return graphs.schema_frame(spark, [(a, b) for a in c for b in c if a < b and V.are_disjoint(a, b)], "a string, b string")


def inverse_materialise(spark: SparkSession, folder: str) -> DataFrame:
    """Facts that follow by inverses."""
    return graphs.materialised(V, spark, folder).where("rule = 'inverse'")


def chain_materialise(spark: SparkSession, folder: str) -> DataFrame:
    """Facts that follow by chains."""
    return graphs.materialised(V, spark, folder).where("rule = 'chain'")


def rule_counts(spark: SparkSession, folder: str) -> DataFrame:
    """How many facts each rule yields."""
    return graphs.materialised(V, spark, folder).groupBy("rule", "p").agg(F.count("*").alias("n"))


def type_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """Why each record is a Record."""
    return graphs.type_evidence(V, spark, folder, "Record")


def neighbourhood_1hop(spark: SparkSession, folder: str) -> DataFrame:
    """Triples around one customer."""
    return graphs.neighbourhood(graphs.object_triples(V, spark, folder), "customer/7", 1)


def neighbourhood_2hop(spark: SparkSession, folder: str) -> DataFrame:
    """Triples two steps around one supplier."""
    return graphs.neighbourhood(graphs.object_triples(V, spark, folder), "supplier/5", 2)


_DOWN = ["inRegion", "locatedIn", "placedBy", "lineOf"]


def anchor_layers(spark: SparkSession, folder: str) -> DataFrame:
    """How many nodes each hop back from each region reaches."""
    return graphs.anchor_layers(V, spark, folder, _DOWN)


def witness_paths(spark: SparkSession, folder: str) -> DataFrame:
    """For every customer and its region, one chain of facts that shows it: the least."""
    return graphs.witness_paths(V, spark, folder, ["locatedIn", "inRegion"])


def orphan_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Entities that no edge of a property reaches, for every stored object property."""
    return graphs.orphans(V, spark, folder)


def degree_counts(spark: SparkSession, folder: str) -> DataFrame:
    """Edges at every node of the whole graph."""
    return graphs.degrees(graphs.object_triples(V, spark, folder))


def chain_audit(spark: SparkSession, folder: str) -> DataFrame:
    """For every chain: pairs that should be closed, and those that stored facts leave open."""
    return graphs.chain_audit(V, spark, folder)


def graph_digest(spark: SparkSession, folder: str) -> DataFrame:
    """The number of all stored triples and whether two orders of them have one hash."""
    t = graphs.object_triples(V, spark, folder)
    a, b = graphs.graph_hash(t), graphs.graph_hash(t.orderBy(F.desc("o")).select("o", "p", "s"))
    return a.join(b.withColumnRenamed("graph_hash", "other"), "n_triples").select("n_triples", (F.col("graph_hash") == F.col("other")).alias("same"))


def supersedes_closure(spark: SparkSession, folder: str) -> DataFrame:
    """Every version with the versions it supersedes, however far back."""
    e = table(spark, folder, "document_versions").select(F.col("version_id").alias("s"), F.col("supersedes").alias("o"))
    return graphs.transitive_closure(e)


def _versions(spark: SparkSession, folder: str) -> DataFrame:
    v = table(spark, folder, "document_versions").select("version_id", "document_id", "title", "publisher", "issued_date", "effective_from", "withdrawn_date", "supersedes", "status", "license", "sha256").distinct()
    return v.withColumns({"i": day(F.col("issued_date")), "f": day(F.col("effective_from")), "w": day(F.col("withdrawn_date"))})


def shape_cardinality(spark: SparkSession, folder: str) -> DataFrame:
    """Versions without a value that each must have."""
    needed = ["title", "publisher", "issued_date", "license"]
    checks = F.array(*[F.when(F.col(c).isNull(), F.lit(c)) for c in needed])
    return _versions(spark, folder).select("version_id", F.explode(F.filter(checks, lambda x: x.isNotNull())).alias("missing"))


def shape_datatype_pattern(spark: SparkSession, folder: str) -> DataFrame:
    """Versions whose dates are not written as days should be, or whose hash is none."""
    v = _versions(spark, folder)
    dates = [v.where(f"{c} is not null and not {c} rlike '^[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}$'").select("version_id", F.lit(c).alias("field")) for c in ("issued_date", "effective_from", "withdrawn_date")]
    bad = v.where("sha256 is null or not sha256 rlike '^[0-9a-f]{64}$'").select("version_id", F.lit("sha256").alias("field"))
    return dates[0].union(dates[1]).union(dates[2]).union(bad)


def shape_unique_key(spark: SparkSession, folder: str) -> DataFrame:
    """Titles that several documents share."""
    return _versions(spark, folder).where("title is not null").groupBy("title").agg(F.count_distinct("document_id").alias("n_documents")).where("n_documents > 1")


def shape_date_order(spark: SparkSession, folder: str) -> DataFrame:
    """Versions withdrawn before they took effect, or in force before they were issued."""
    v = _versions(spark, folder)
    return v.where("w < f").select("version_id", F.lit("withdrawn before effective").alias("violation")).union(v.where("f < i").select("version_id", F.lit("effective before issued").alias("violation")))


def shape_interval_overlap(spark: SparkSession, folder: str) -> DataFrame:
    """Versions whose validity begins while another version of the document is in force."""
    return graphs.overlapping_intervals(_versions(spark, folder).select("document_id", "version_id", "f", "w").distinct(), "document_id", "f", "w", "version_id")


def shape_threshold(spark: SparkSession, folder: str) -> DataFrame:
    """Nations with fewer suppliers than a threshold."""
    n = V.entities(spark, folder, "Nation")["nation"].select("key")
    s = V.edges(spark, folder, "suppliedFrom").groupBy("o").agg(F.count_distinct("s").alias("n"))
    return n.join(s, n.key == s.o, "left").select(F.col("key").alias("nation"), F.coalesce("n", F.lit(0)).alias("n_suppliers")).where("n_suppliers < 4")


def shape_self_reference(spark: SparkSession, folder: str) -> DataFrame:
    """Versions that supersede themselves, an unknown version, or one of another document."""
    v = _versions(spark, folder).select("version_id", "document_id", "supersedes")
    old = v.select(F.col("version_id").alias("supersedes"), F.col("document_id").alias("other"))
    d = v.where("supersedes is not null").join(old, "supersedes", "left")
    reason = F.when(F.col("supersedes") == F.col("version_id"), "itself").when(F.col("other").isNull(), "unknown").when(F.col("other") != F.col("document_id"), "other document")
    return d.select("version_id", reason.alias("violation")).where("violation is not null")


def enforce_valid_rows(spark: SparkSession, folder: str) -> DataFrame:
    """Receipts accepted as records: all checks pass, and the first of each version by time and id."""
    return _accepted(_receipts(spark, folder)).select("id", "version_id")


def enforce_errors(spark: SparkSession, folder: str) -> DataFrame:
    """Receipts rejected, one row for each reason."""
    d = _receipts(spark, folder)
    late = d.where(F.size("errors") == 0).join(_accepted(d).select("id"), "id", "left_anti").select("id", F.lit("version already taken").alias("error"))
    return d.select("id", F.explode("errors").alias("error")).union(late)


def _accepted(d: DataFrame) -> DataFrame:
    """Of the receipts without errors the first of each version, found by an aggregate."""
    d = d.where(F.size("errors") == 0)
    first = d.groupBy("version_id").agg(F.min(F.struct("fetched_at", "id")).alias("first"))
    return d.join(first.select(F.col("first.id").alias("id")), "id", "left_semi")


def _receipts(spark: SparkSession, folder: str) -> DataFrame:
    r = table(spark, folder, "receipts").groupBy("id").agg(F.min_by(F.struct("version_id", "http_status", "content_type", "byte_count", "sha256", "fetched_at"), "fetched_at").alias("r")).select("id", "r.*")
    errors = F.array(
        F.when(~F.coalesce(F.col("http_status") == 200, F.lit(False)), "status"),
        F.when(~F.coalesce(F.col("content_type") == "application/pdf", F.lit(False)), "content type"),
        F.when(~F.coalesce(F.col("byte_count") > 0, F.lit(False)), "size"),
        F.when(~F.coalesce(F.col("sha256").rlike("^[0-9a-f]{64}$"), F.lit(False)), "sha256"),
    )
    return r.withColumn("errors", F.filter(errors, lambda x: x.isNotNull()))


_SUB = "with edge(c, p) as (values {}), up as (select distinct c as sub, c as sup, 0 as steps from (select c from edge union select p from edge) t(c) union all select up.sub, e.p, up.steps + 1 from up join edge e on e.c = up.sup)"
_EDGES = ", ".join(f"('{c}', '{p}')" for c, ps in sorted(V.parents.items()) for p in ps)
_REC = _SUB.format(_EDGES).replace("with edge", "with recursive edge", 1)
_DISJOINT = "g(k, m) as (values " + ", ".join(f"({i}, '{m}')" for i, group in enumerate(V.disjoint) for m in group) + ")"
_DIS = f"{_REC}, {_DISJOINT}, dis as (select distinct a.sub as a, b.sub as b from g x join g y on x.k = y.k and x.m <> y.m join up a on a.sup = x.m join up b on b.sup = y.m)"
_null = lambda x: "null" if x is None else f"'{x}'"
_PROP = "prop(p, d, r, i) as (values " + ", ".join(f"('{p.name}', '{p.domain}', {_null(p.range_class)}, {_null(p.inverse_of)})" for p in V.properties.values()) + "), eq(a, b) as (values " + ", ".join(f"('{a}', '{b}')" for a, b in V.equivalent or (("", ""),)) + ")"
_VER = f"v as (select distinct version_id, document_id, title, publisher, issued_date, effective_from, withdrawn_date, supersedes, license, sha256, {_sql_day('issued_date')} as i, {_sql_day('effective_from')} as f, {_sql_day('withdrawn_date')} as w from document_versions)"
_TRI = {
    "suppliedFrom": "select 'supplier/' || s_suppkey as s, 'suppliedFrom' as p, 'nation/' || s_nationkey as o from supplier",
    "locatedIn": "select 'customer/' || c_custkey as s, 'locatedIn' as p, 'nation/' || c_nationkey as o from customer",
    "inRegion": "select 'nation/' || n_nationkey as s, 'inRegion' as p, 'region/' || n_regionkey as o from nation",
    "placedBy": "select 'orders/' || o_orderkey as s, 'placedBy' as p, 'customer/' || o_custkey as o from orders",
    "eventOf": "select 'events/' || event_id as s, 'eventOf' as p, 'customer/' || user_id as o from events",
    **{p: f"select distinct 'lineitem/' || concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')) as s, '{p}' as p, '{t}/' || {k} as o from lineitem" for p, t, k in (("lineOf", "orders", "l_orderkey"), ("lineForPart", "part", "l_partkey"), ("lineFrom", "supplier", "l_suppkey"))},
}
_NEAR = " union all ".join(_TRI.values())
_CHAINS = {
    "locatedInRegion": "select 'customer/' || c_custkey as s, 'locatedInRegion' as p, 'region/' || n_regionkey as o, 'chain' as rule, min('customer/' || c_custkey || ' locatedIn nation/' || n_nationkey || '; nation/' || n_nationkey || ' inRegion region/' || n_regionkey) as premises from customer join nation on c_nationkey = n_nationkey group by 1, 3",
    "orderNation": "select 'orders/' || o_orderkey as s, 'orderNation' as p, 'nation/' || c_nationkey as o, 'chain' as rule, min('orders/' || o_orderkey || ' placedBy customer/' || c_custkey || '; customer/' || c_custkey || ' locatedIn nation/' || c_nationkey) as premises from orders join customer on o_custkey = c_custkey group by 1, 3",
}
_INVERSE = "select distinct 'customer/' || o_custkey as s, 'hasOrder' as p, 'orders/' || o_orderkey as o, 'inverse' as rule, 'orders/' || o_orderkey || ' placedBy customer/' || o_custkey as premises from orders"
_RECEIPTS = """
r as (select * from (select *, row_number() over (partition by id order by fetched_at) as k from receipts) where k = 1),
e as (select id, version_id, fetched_at, list_filter([case when http_status is distinct from 200 then 'status' end, case when content_type is distinct from 'application/pdf' then 'content type' end,
  case when coalesce(byte_count, 0) <= 0 then 'size' end, case when sha256 is null or not regexp_full_match(sha256, '[0-9a-f]{64}') then 'sha256' end], lambda x: x is not null) as errors from r),
n as (select *, row_number() over (partition by version_id, len(errors) = 0 order by fetched_at, id) as n from e)
"""

SQL: dict[str, str] = {
    "subclass_closure": f"{_REC} select sub, sup, min(steps)::int as steps from up group by 1, 2",
    "subclass_shortest_chain": f"with recursive edge(c, p) as (values {_EDGES}), up as (select c as sub, p as sup, c || ' > ' || p as chain, 1 as steps from edge union all select up.sub, e.p, up.chain || ' > ' || e.p, up.steps + 1 from up join edge e on e.c = up.sup) select sub, sup, arg_min(chain, (steps, chain)) as chain from up group by 1, 2",
    "verify_matrix": f"{_DIS}, {_PROP}, c as (select distinct sub as x from up), m as (select a.x as s, b.x as o, exists (select 1 from up where sub = a.x and sup = b.x) as u, exists (select 1 from up where sub = b.x and sup = a.x) as d, exists (select 1 from dis where dis.a = a.x and dis.b = b.x) as j from c a, c b) select s as subject, 'subclass_of' as relation, o as object, case when u then 'ENTAILED' when j then 'CONTRADICTED' else 'UNKNOWN' end as verdict from m union all select s, 'disjoint_with', o, case when j then 'ENTAILED' when u or d then 'CONTRADICTED' else 'UNKNOWN' end from m union all select s, 'equivalent_to', o, case when s = o or (s, o) in (select a, b from eq union select b, a from eq) then 'ENTAILED' when j then 'CONTRADICTED' else 'UNKNOWN' end from m union all select p, r, x, case when k is null then 'UNKNOWN' when exists (select 1 from up where sub = k and sup = x) then 'ENTAILED' when exists (select 1 from dis where dis.a = k and dis.b = x) then 'CONTRADICTED' else 'UNKNOWN' end from (select p, 'domain_of' as r, d as k from prop union all select p, 'range_of', r from prop) cross join c union all select a.p, 'inverse_of', b.p, case when a.i = b.p or b.i = a.p then 'ENTAILED' else 'UNKNOWN' end from prop a, prop b",
    "disjoint_pairs": f"{_DIS} select a, b from dis where a < b",
    "inverse_materialise": _INVERSE,
    "chain_materialise": " union all ".join(_CHAINS.values()),
    "rule_counts": f"select rule, p, count(*) as n from ({_INVERSE} union all {' union all '.join(_CHAINS.values())}) group by 1, 2",
    "type_evidence": "select distinct * from (select 'orders/' || o_orderkey as entity, case o_orderstatus when 'O' then 'OpenOrder' when 'F' then 'FilledOrder' else 'PartialOrder' end as stated_type, stated_type || ' > Order > Record' as chain, 'inferred' as evidence from orders union all select 'events/' || event_id, upper(left(event_type, 1)) || substring(event_type, 2) || 'Event' as s, s || ' > Event > Record', 'inferred' from events union all select 'lineitem/' || concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, strftime(l_shipdate, '%Y%m%d')), 'LineItem', 'LineItem > Record', 'inferred' from lineitem)",
    "neighbourhood_1hop": f"select * from ({' union all '.join(_TRI.values())}) where s = 'customer/7' or o = 'customer/7'",
    "neighbourhood_2hop": f"with t as ({_NEAR}), a as (select * from t where s = 'supplier/5' or o = 'supplier/5'), n as (select s as x from a union select o from a union select 'supplier/5') select distinct t.* from t where s in (select x from n) or o in (select x from n)",
    "anchor_layers": "with n as (select n_regionkey as r, n_nationkey as k from nation), c as (select distinct r, c_custkey as k from customer join n on c_nationkey = n.k), o as (select distinct r, o_orderkey as k from orders join c on o_custkey = c.k), l as (select distinct r, concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate) as k from lineitem join o on l_orderkey = o.k), x as (select r, 1 as layer, 'inRegion' as property, k::varchar as k from n union all select r, 2, 'locatedIn', k::varchar from c union all select r, 3, 'placedBy', k::varchar from o union all select r, 4, 'lineOf', k from l) select 'region/' || r as anchor, layer, property, count(*) as n_nodes from x group by all",
    "witness_paths": "select 'customer/' || c_custkey as entity, 'region/' || n_regionkey as reached, min('customer/' || c_custkey || ' locatedIn nation/' || n_nationkey || '; nation/' || n_nationkey || ' inRegion region/' || n_regionkey) as path from customer join nation on c_nationkey = n_nationkey group by 1, 2",
    "orphan_entities": " union all ".join(f"select '{t}/' || {k} as entity, '{p}' as property from {t} where {k} not in (select {f} from {s} where {f} is not null)" for p, t, k, s, f in (("placedBy", "customer", "c_custkey", "orders", "o_custkey"), ("lineOf", "orders", "o_orderkey", "lineitem", "l_orderkey"), ("lineForPart", "part", "p_partkey", "lineitem", "l_partkey"), ("lineFrom", "supplier", "s_suppkey", "lineitem", "l_suppkey"), ("locatedIn", "nation", "n_nationkey", "customer", "c_nationkey"), ("suppliedFrom", "nation", "n_nationkey", "supplier", "s_nationkey"), ("inRegion", "region", "r_regionkey", "nation", "n_regionkey"), ("eventOf", "customer", "c_custkey", "events", "user_id"))),
    "chain_audit": "select 'locatedInRegion' as chain, count(*)::bigint as n_pairs, count(*)::bigint as n_open from (select distinct c_custkey, n_regionkey from customer join nation on c_nationkey = n_nationkey) union all select 'orderNation', count(*), count(*) from (select distinct o_orderkey, c_nationkey from orders join customer on o_custkey = c_custkey)",
    "graph_digest": f"select count(*) as n_triples, true as same from (select distinct * from ({_NEAR}))",
    "degree_counts": f"with t as ({_NEAR}), e as (select s as node, 1 as a, 0 as b from t union all select o, 0, 1 from t) select node, sum(a)::bigint as n_out, sum(b)::bigint as n_in from e group by 1",
    "supersedes_closure": "with recursive e as (select distinct version_id as s, supersedes as o from document_versions where supersedes is not null), t as (select s, o, 1 as steps from e union all select t.s, e.o, t.steps + 1 from t join e on e.s = t.o where t.steps < 32) select s, o, min(steps)::int as steps from t group by 1, 2",
    "shape_cardinality": f"with {_VER} select version_id, 'title' as missing from v where title is null union all select version_id, 'publisher' from v where publisher is null union all select version_id, 'issued_date' from v where issued_date is null union all select version_id, 'license' from v where license is null",
    "shape_datatype_pattern": f"with {_VER} select version_id, field from (select version_id, unnest(['issued_date', 'effective_from', 'withdrawn_date']) as field, unnest([issued_date, effective_from, withdrawn_date]) as x from v) where x is not null and not regexp_full_match(x, '[0-9]{{4}}-[0-9]{{2}}-[0-9]{{2}}') union all select version_id, 'sha256' from v where sha256 is null or not regexp_full_match(sha256, '[0-9a-f]{{64}}')",
    "shape_unique_key": "select title, count(distinct document_id) as n_documents from document_versions where title is not null group by 1 having count(distinct document_id) > 1",
    "shape_date_order": f"with {_VER} select version_id, 'withdrawn before effective' as violation from v where w < f union all select version_id, 'effective before issued' from v where f < i",
    "shape_interval_overlap": f"with {_VER}, x as (select distinct document_id, version_id, f, coalesce(w, date '9999-12-31') as w from v where f is not null) select a.document_id, a.version_id, a.f, max(b.w) as covered_until from x a join x b on a.document_id = b.document_id and (b.f, b.version_id) < (a.f, a.version_id) group by 1, 2, 3 having max(b.w) > a.f",
    "shape_threshold": "select n_nationkey as nation, count(s_suppkey) as n_suppliers from nation left join supplier on s_nationkey = n_nationkey group by 1 having count(s_suppkey) < 4",
    "shape_self_reference": f"with {_VER} select a.version_id, case when a.supersedes = a.version_id then 'itself' when b.version_id is null then 'unknown' else 'other document' end as violation from v a left join v b on a.supersedes = b.version_id where a.supersedes is not null and (a.supersedes = a.version_id or b.version_id is null or b.document_id <> a.document_id)",
    "enforce_valid_rows": f"with {_RECEIPTS} select id, version_id from n where len(errors) = 0 and n = 1",
    "enforce_errors": f"with {_RECEIPTS} select id, unnest(errors) as error from n union all select id, 'version already taken' from n where len(errors) = 0 and n > 1",
}

QUERIES = {
    f.__name__: f
    for f in (
        chain_audit, graph_digest, subclass_closure, subclass_shortest_chain, verify_matrix, disjoint_pairs, inverse_materialise, chain_materialise, rule_counts, type_evidence, neighbourhood_1hop, neighbourhood_2hop, anchor_layers,
        witness_paths, orphan_entities, degree_counts, supersedes_closure, shape_cardinality, shape_datatype_pattern, shape_unique_key, shape_date_order, shape_interval_overlap, shape_threshold,
        shape_self_reference, enforce_valid_rows, enforce_errors,
    )
}
