"""Streams with state, routed questions, evidence and answers, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella import service
from tessella.operators import graphs
from tessella.plans import retrieval_queries as r
from tessella.plans.ontology_queries import SQL as O_SQL
from tessella.plans.query import Compiler
from tessella.plans.schema import question_plan, retrieved_schema
from tessella.plans.vocabulary import COMMERCE as V
from tessella.sources.tables import shared_folder, table
from tessella.streaming import events

# -- streams ---------------------------------------------------------------------------------
def _stream(spark: SparkSession, folder: str, name: str) -> DataFrame:
    schema = table(spark, folder, name).schema
    return spark.readStream.schema(schema).parquet(f"{folder}/{name}.parquet*")


def stream_import(spark: SparkSession, folder: str) -> DataFrame:
    """All events imported twice as a stream: counts by type of what is stored."""
    path = shared_folder(spark, "import")
    for n in range(2):
        # The second pass has a state of its own: it is another run over the same events.
        events.import_stream(events.event_stream(spark, folder) if n == 0 else events.event_stream(spark, folder).where("event_id is not null"), f"{path}/store", "event_id", f"{path}/state")
    return spark.read.parquet(f"{path}/store").groupBy("event_type").agg(F.count("*").alias("n"))


def stream_unique(spark: SparkSession, folder: str) -> DataFrame:
    """Receipts as a stream: the first of each version is accepted, how many others are not."""
    s = _stream(spark, folder, "receipts").select("id", "version_id", "fetched_at")
    d = events.appended(events.first_of_each(s, "version_id", ["fetched_at", "id"], ["id", "version_id", "fetched_at"]), "unique")
    return d.groupBy("version_id").agg(F.max(F.when(F.col("accepted"), F.col("id"))).alias("accepted"), F.sum((~F.col("accepted")).cast("long")).alias("n_rejected"))


def incremental_chain(spark: SparkSession, folder: str) -> DataFrame:
    """The nations of orders materialised in two increments: orders before a day with all customers, then the rest; pairs by nation."""
    path = shared_folder(spark, "increments")
    orders = table(spark, folder, "orders").select(F.col("o_orderkey").alias("s"), F.col("o_custkey").alias("m"), "o_orderdate").where("m is not null")
    located = table(spark, folder, "customer").select(F.col("c_custkey").alias("m"), F.col("c_nationkey").alias("o")).where("o is not null")
    early = F.coalesce(F.col("o_orderdate") < F.lit("1997-01-01").cast("date"), F.lit(False))
    events.chain_increment(path, orders.where(early), located, 0)
    events.chain_increment(path, orders.where(~early), located.limit(0), 1)
    return spark.read.parquet(f"{path}/pairs").groupBy("o").agg(F.count("*").alias("n")).select(F.col("o").alias("nation"), "n")


# -- questions -------------------------------------------------------------------------------
ASKED = {
    "average": "average balance of the customers of each nation", "total": "total order total of the orders of each building customer", "latest": "latest order of each supplier and customer",
    "least": "customers with at least 10 orders", "top": "top 5 nations by suppliers",
}


def asked_average(spark: SparkSession, folder: str) -> DataFrame:
    """'nations by the average balance of their customers'."""
    return Compiler(V, spark, folder).run(question_plan(V, "nations by the average balance of their customers"))


def asked_total(spark: SparkSession, folder: str) -> DataFrame:
    """'building customers and the total of order total of their orders'."""
    return Compiler(V, spark, folder).run(question_plan(V, "building customers and the total of order total of their orders"))


def asked_latest(spark: SparkSession, folder: str) -> DataFrame:
    """'customers and their latest filled orders'."""
    return Compiler(V, spark, folder).run(question_plan(V, "customers and their latest filled orders"))


def asked_anchored(spark: SparkSession, folder: str) -> DataFrame:
    """'open orders of EUROPE': the region is the anchor, the preferred way leads to the orders."""
    return service.Engine(spark, folder).ask("open orders of EUROPE").rows


def asked_siblings(spark: SparkSession, folder: str) -> DataFrame:
    """'nations beside' the first nation by name: out to the region and back, itself left out."""
    name = table(spark, folder, "nation").agg(F.min("n_name")).first()[0]
    return service.Engine(spark, folder).ask(f"nations beside {name}").rows


def schema_retrieval(spark: SparkSession, folder: str) -> DataFrame:
    """The part of the vocabulary that each of some questions needs."""
    rows = [(k, *x) for k, q in ASKED.items() for x in retrieved_schema(V, q, 400)]
    return spark.createDataFrame(rows, "question string, kind string, name string, required boolean")


# -- evidence and answers ------------------------------------------------------------------------
def find_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """For every customer of a region: a claim's id, its facts and how many there are."""
    w = graphs.witness_paths(V, spark, folder, ["locatedIn", "inRegion"])
    claim = F.concat(F.lit("claim-"), F.substring(F.sha2(F.concat_ws("|", "entity", "reached"), 256), 1, 16))
    return w.select("entity", claim.alias("claim"), "path", F.size(F.split("path", "; ")).alias("n_facts"))


def verify_evidence(spark: SparkSession, folder: str) -> DataFrame:
    """For every pair of classes the verdict on sub-class with what shows it: the chain, the disjoint pair, or the question that stays open."""
    rows = []
    for a in V.classes():
        for b in V.classes():
            verdict = graphs.verify(V, a, "subclass_of", b)
            shown = " > ".join(V.ancestors(a)[b]) if verdict == "ENTAILED" else f"{a} disjoint {b}" if verdict == "CONTRADICTED" else f"ASK {{ ?x a {a} . FILTER NOT EXISTS {{ ?x a {b} }} }}"
            rows.append((a, b, verdict, shown))
    return spark.createDataFrame(rows, "subject string, object string, verdict string, evidence string")


def assembled_answers(spark: SparkSession, folder: str) -> DataFrame:
    """An answer for every title: its three best documents as citations, or why it has none, with a warning where the best is the document itself only."""
    asked = r._asked(spark, folder).select(F.col("query_id").alias("q"), "title")
    found = r.bm25_topk(spark, folder).where("rk <= 3").groupBy("q").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rk", "d"))), lambda x: x["d"].cast("string")), ",").alias("citations"), F.count("*").alias("n"), F.max((F.col("d") == F.col("q")).cast("int")).alias("own"))
    d = asked.join(found, "q", "left")
    status = F.when(F.col("title").isNull(), "no question").when(F.col("n").isNull(), "insufficient evidence").otherwise("answered")
    warning = F.when((F.col("own") == 1) & (F.col("n") == 1), "own text only").when(F.col("n") < 3, "few documents")
    return d.select("q", status.alias("status"), "citations", warning.alias("warning"))


def described_entities(spark: SparkSession, folder: str) -> DataFrame:
    """Every datatype fact of orders and parts."""
    return service.described(V, spark, folder, "orders").unionByName(service.described(V, spark, folder, "part"))


def compared_nations(spark: SparkSession, folder: str) -> DataFrame:
    """Every nation beside the others of its region: customers, suppliers, and how many of the region have more customers."""
    count = lambda p: V.edges(spark, folder, p).groupBy("o").agg(F.count_distinct("s").alias("n"))
    n = V.edges(spark, folder, "inRegion").select(F.col("s").alias("nation"), F.col("o").alias("region"))
    d = n.join(count("locatedIn").select(F.col("o").alias("nation"), F.col("n").alias("n_customers")), "nation", "left").join(count("suppliedFrom").select(F.col("o").alias("nation"), F.col("n").alias("n_suppliers")), "nation", "left").fillna(0)
    sizes = d.groupBy("region").agg(F.collect_list("n_customers").alias("all"))  # the nations of a region: a handful
    return d.join(sizes, "region").select("nation", "region", "n_customers", "n_suppliers", F.size(F.filter("all", lambda x: x > F.col("n_customers"))).alias("n_larger"))


_SUBCHAIN = O_SQL["subclass_shortest_chain"]
SQL = {
    "stream_import": "select event_type, count(distinct event_id) as n from events group by 1",
    "stream_unique": "select version_id, min_by(id, (fetched_at, id)) as accepted, (count(*) - 1)::bigint as n_rejected from receipts group by 1",
    "incremental_chain": "select c_nationkey as nation, count(distinct o_orderkey) as n from orders join customer on o_custkey = c_custkey group by 1",
    "asked_average": "select 'nation/' || c_nationkey as entity, round(avg(cast(c_acctbal as decimal(18,2)))::double, 4) as value from customer join nation on c_nationkey = n_nationkey group by 1",
    "asked_total": "select 'customer/' || c_custkey as entity, round(sum(cast(o_totalprice as decimal(18,2)))::double, 4) as value from customer join orders on o_custkey = c_custkey where c_mktsegment = 'BUILDING' group by 1",
    "asked_latest": "select 'customer/' || c_custkey as entity, 'orders/' || o_orderkey as related from customer join orders on o_custkey = c_custkey where o_orderstatus = 'F' and cast(o_orderdate as date) = (select max(cast(x.o_orderdate as date)) from orders x where x.o_custkey = c_custkey and x.o_orderstatus = 'F')",
    "asked_anchored": "select 'orders/' || o_orderkey as entity from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey where r_name = 'EUROPE' and o_orderstatus = 'O'",
    "asked_siblings": "select 'nation/' || n_nationkey as entity from nation where n_regionkey = (select n_regionkey from nation order by n_name limit 1) and n_name <> (select min(n_name) from nation)",
    "find_evidence": f"select entity, 'claim-' || substring(sha256(entity || '|' || reached), 1, 16) as claim, path, 2::int as n_facts from ({O_SQL['witness_paths']})",
    "verify_evidence": f"with c as (select subject, object, verdict from ({O_SQL['verify_matrix']}) where relation = 'subclass_of'), k as (select sub, sup, chain from ({_SUBCHAIN})) select subject, object, verdict, case when subject = object then subject when verdict = 'ENTAILED' then chain when verdict = 'CONTRADICTED' then subject || ' disjoint ' || object else 'ASK {{ ?x a ' || subject || ' . FILTER NOT EXISTS {{ ?x a ' || object || ' }} }}' end as evidence from c left join k on sub = subject and sup = object",
    "assembled_answers": f"with b as (select * from ({r.SQL['bm25_topk']}) where rk <= 3), g as (select q, string_agg(d::varchar, ',' order by rk) as citations, count(*) as n, max((d = q)::int) as own from b group by 1) select doc_id as q, case when title is null then 'no question' when n is null then 'insufficient evidence' else 'answered' end as status, citations, case when own = 1 and n = 1 then 'own text only' when n < 3 then 'few documents' end as warning from documents left join g on q = doc_id where doc_id % 20 = 0",
    "described_entities": "select 'orders/' || o_orderkey as entity, 'orderDate' as property, cast(o_orderdate as date)::varchar as value from orders where o_orderdate is not null union all select 'orders/' || o_orderkey, 'orderTotal', cast(o_totalprice as decimal(18,2))::varchar from orders where o_totalprice is not null union all select 'orders/' || o_orderkey, 'priority', o_orderpriority from orders where o_orderpriority is not null union all select 'part/' || p_partkey, 'partName', p_name from part where p_name is not null union all select 'part/' || p_partkey, 'partSize', p_size::varchar from part where p_size is not null union all select 'part/' || p_partkey, 'retailPrice', cast(p_retailprice as decimal(18,2))::varchar from part where p_retailprice is not null",
    "compared_nations": "with d as (select n_nationkey as nation, n_regionkey as region, (select count(*) from customer where c_nationkey = n_nationkey) as n_customers, (select count(*) from supplier where s_nationkey = n_nationkey) as n_suppliers from nation) select nation, region, n_customers, n_suppliers, (select count(*) from d x where x.region = d.region and x.n_customers > d.n_customers)::int as n_larger from d",
}
QUERIES = {
    f.__name__: f
    for f in (stream_import, stream_unique, incremental_chain, asked_average, asked_total, asked_latest, asked_anchored, asked_siblings, schema_retrieval, find_evidence, verify_evidence, assembled_answers, described_entities, compared_nations)
}
