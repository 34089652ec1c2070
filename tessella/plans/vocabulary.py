"""Classes, properties, chains and disjoint groups over the relational tables.

The vocabulary is schema-sized and stays on the driver. A class is bound to a table and a
condition, a property to a table and two expressions, so that a plan over the graph
becomes a plan over pruned, filtered parquet scans: no triple table is built unless a
query asks for triples.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessella.sources.tables import table


@dataclass(frozen=True)
class Property:
    """An object property if ``range_table`` is given, else a datatype property of the column's type."""

    name: str
    table: str
    value: str
    domain: str
    range_class: str | None = None
    range_table: str | None = None
    inverse_of: str | None = None


@dataclass(frozen=True)
class Vocabulary:
    """The schema: keys of tables, parents and bindings of classes, properties, chains, disjoint pairs."""

    keys: dict[str, str]
    labels: dict[str, str]
    parents: dict[str, tuple[str, ...]]
    bindings: dict[str, tuple[str, str]]
    properties: dict[str, Property]
    chains: dict[str, tuple[str, str]] = field(default_factory=dict)
    disjoint: tuple[tuple[str, ...], ...] = ()
    codes: dict[str, tuple[str, ...]] = field(default_factory=dict)
    repeated: frozenset[str] = frozenset()
    equivalent: tuple[tuple[str, str], ...] = ()
    subproperties: dict[str, str] = field(default_factory=dict)
    restrictions: tuple[tuple[str, str, str, object], ...] = ()

    # -- closures over the schema -----------------------------------------------------
    def ancestors(self, name: str) -> dict[str, tuple[str, ...]]:
        """Every superclass, itself included, with the shortest chain to it (of equal ones the first by name)."""
        found, level = {name: (name,)}, [name]
        while level:
            new: dict[str, tuple[str, ...]] = {}
            for c in level:
                for p in self.parents.get(c, ()):
                    chain = (*found[c], p)
                    if p not in found and (p not in new or chain < new[p]):
                        new[p] = chain
            found |= new
            level = sorted(new)
        return found

    def descendants(self, name: str) -> list[str]:
        """Every subclass, itself included."""
        return sorted(c for c in self.classes() if name in self.ancestors(c))

    def classes(self) -> list[str]:
        return sorted({*self.parents, *(p for ps in self.parents.values() for p in ps), *self.bindings})

    def subclass_pairs(self) -> list[tuple[str, str, int]]:
        """(subclass, superclass, steps) of the reflexive transitive closure."""
        return [(c, a, len(chain) - 1) for c in self.classes() for a, chain in self.ancestors(c).items()]

    def equivalents(self, name: str) -> list[str]:
        """Classes declared the same as ``name``, in either order."""
        return sorted({b for a, b in self.equivalent if a == name} | {a for a, b in self.equivalent if b == name})

    def codes_for(self, name: str, phrase: str) -> tuple[str, ...]:
        """The codes of an ordered list that a phrase means: 'X', 'X or more', 'X or less', 'above X', 'below X'; X is a code or its word."""
        codes, low = self.codes[name], phrase.lower()
        at = [k for k, c in enumerate(codes) if c.lower() in low or c.split("-", 1)[-1].lower() in low]
        if len(at) != 1:
            raise ValueError(f"{phrase!r} names no single code of {name}")
        k = at[0]
        if "or more" in low or "及以上" in low:
            return codes[: k + 1]
        if "or less" in low or "及以下" in low:
            return codes[k:]
        if "above" in low or "以上" in low:
            return codes[:k]
        if "below" in low or "以下" in low:
            return codes[k + 1 :]
        return (codes[k],)

    def are_disjoint(self, a: str, b: str) -> bool:
        """Whether superclasses of both are declared disjoint."""
        up_a, up_b = self.ancestors(a), self.ancestors(b)
        return any(x != y and x in up_a and y in up_b for group in self.disjoint for x in group for y in group)

    # -- data ---------------------------------------------------------------------------
    def tables_of(self, name: str) -> dict[str, str]:
        """Tables that hold instances of a class or its subclasses, with the condition on each."""
        out: dict[str, list[str]] = {}
        for c in self.descendants(name):
            if c in self.bindings:
                t, condition = self.bindings[c]
                out.setdefault(t, []).append(condition)
        return {t: " or ".join(f"({c})" for c in dict.fromkeys(cs)) for t, cs in out.items()}

    def unique(self, name: str) -> bool:
        """Whether a table's key names one row only."""
        return name not in self.repeated

    def rows(self, spark: SparkSession, folder: str, name: str) -> DataFrame:
        """A table with its entities' key as ``key``; columns not asked for later are not read."""
        return table(spark, folder, name).withColumn("key", F.expr(self.keys[name]))

    def entities(self, spark: SparkSession, folder: str, name: str) -> dict[str, DataFrame]:
        """Type scan: for each table its rows of the class with their ``key``; the condition reaches the scan."""
        return {t: self.rows(spark, folder, t).where(condition) for t, condition in self.tables_of(name).items()}

    def edges(self, spark: SparkSession, folder: str, name: str) -> DataFrame:
        """``s``, ``o`` of a property in the tables' own key types."""
        p = self.properties[name]
        if p.inverse_of:
            return self.edges(spark, folder, p.inverse_of).select(F.col("o").alias("s"), F.col("s").alias("o"))
        return table(spark, folder, p.table).select(F.expr(self.keys[p.table]).alias("s"), F.expr(p.value).alias("o")).where("s is not null and o is not null")

    def label(self, spark: SparkSession, folder: str, name: str) -> DataFrame:
        """``key``, ``label`` of a table's entities."""
        return table(spark, folder, name).select(F.expr(self.keys[name]).alias("key"), F.expr(self.labels[name]).alias("label"))

    def sides(self, name: str) -> tuple[str, str | None]:
        """The tables of a property's subjects and objects."""
        p = self.properties[name]
        if p.inverse_of:
            s, o = self.sides(p.inverse_of)
            assert o, f"{p.inverse_of} has literal objects"
            return o, s
        return p.table, p.range_table


def iri(table_name: str, key: F.Column | str) -> F.Column:
    """The identity of an entity: its table and key; a key of several columns is written out here only."""
    k = F.col(key) if isinstance(key, str) else key
    if table_name == "lineitem":
        k = F.concat_ws("-", k["l_orderkey"], k["l_linenumber"], k["l_partkey"], k["l_suppkey"], F.date_format(k["l_shipdate"], "yyyyMMdd"))
    return F.concat(F.lit(f"{table_name}/"), k.cast("string"))


LINE_KEY = "struct(l_orderkey, l_linenumber, l_partkey, l_suppkey, l_shipdate)"
LINE_LABEL = "concat_ws('-', l_orderkey, l_linenumber, l_partkey, l_suppkey, date_format(l_shipdate, 'yyyyMMdd'))"
_LEAVES = {
    "part": ("p_type", {"PromoPart": "PROMO", "StandardPart": "STANDARD", "SmallPart": "SMALL", "LargePart": "LARGE", "EconomyPart": "ECONOMY", "MediumPart": "MEDIUM"}, "Part"),
    "orders": ("o_orderstatus", {"OpenOrder": "O", "FilledOrder": "F", "PartialOrder": "P"}, "Order"),
    "events": ("event_type", {"ViewEvent": "view", "SignupEvent": "signup", "ErrorEvent": "error", "ClickEvent": "click", "PurchaseEvent": "purchase"}, "Event"),
    "customer": ("c_mktsegment", {"MachineryCustomer": "MACHINERY", "BuildingCustomer": "BUILDING", "AutomobileCustomer": "AUTOMOBILE", "FurnitureCustomer": "FURNITURE", "HouseholdCustomer": "HOUSEHOLD"}, "Customer"),
}


def _commerce() -> Vocabulary:
    parents: dict[str, tuple[str, ...]] = {
        "Place": ("Thing",), "Party": ("Thing",), "Item": ("Thing",), "Record": ("Thing",), "Region": ("Place",), "Nation": ("Place",), "Customer": ("Party",), "Supplier": ("Party",),
        "Part": ("Item",), "Order": ("Record",), "LineItem": ("Record",), "Event": ("Record",),
    }
    bindings = {"Region": ("region", "true"), "Nation": ("nation", "true"), "Supplier": ("supplier", "true"), "LineItem": ("lineitem", "true")}
    for t, (column, leaves, parent) in _LEAVES.items():
        for c, value in leaves.items():
            parents[c] = (parent,)
            bindings[c] = (t, f"{column} = '{value}'")
    p = [
        Property("placedBy", "orders", "o_custkey", "Order", "Customer", "customer"),
        Property("hasOrder", "orders", "", "Customer", "Order", "orders", inverse_of="placedBy"),
        Property("lineOf", "lineitem", "l_orderkey", "LineItem", "Order", "orders"),
        Property("lineForPart", "lineitem", "l_partkey", "LineItem", "Part", "part"),
        Property("lineFrom", "lineitem", "l_suppkey", "LineItem", "Supplier", "supplier"),
        Property("locatedIn", "customer", "c_nationkey", "Customer", "Nation", "nation"),
        Property("suppliedFrom", "supplier", "s_nationkey", "Supplier", "Nation", "nation"),
        Property("inRegion", "nation", "n_regionkey", "Nation", "Region", "region"),
        Property("eventOf", "events", "user_id", "Event", "Customer", "customer"),
        Property("orderDate", "orders", "cast(o_orderdate as date)", "Order"),
        Property("orderTotal", "orders", "cast(o_totalprice as decimal(18,2))", "Order"),
        Property("priority", "orders", "o_orderpriority", "Order"),
        Property("balance", "customer", "cast(c_acctbal as decimal(18,2))", "Customer"),
        Property("customerName", "customer", "c_name", "Customer"),
        Property("quantity", "lineitem", "cast(l_quantity as decimal(18,2))", "LineItem"),
        Property("extendedPrice", "lineitem", "cast(l_extendedprice as decimal(18,2))", "LineItem"),
        Property("shipDate", "lineitem", "cast(l_shipdate as date)", "LineItem"),
        Property("partName", "part", "p_name", "Part"),
        Property("partSize", "part", "p_size", "Part"),
        Property("retailPrice", "part", "cast(p_retailprice as decimal(18,2))", "Part"),
        Property("eventTime", "events", "ts", "Event"),
        Property("eventValue", "events", "cast(value as decimal(18,2))", "Event"),
    ]
    return Vocabulary(
        keys={"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "lineitem": LINE_KEY},
        labels={"region": "r_name", "nation": "n_name", "customer": "c_name", "supplier": "s_name", "part": "p_name", "orders": "cast(o_orderkey as string)", "events": "event_type", "lineitem": LINE_LABEL},
        parents=parents,
        bindings=bindings,
        properties={x.name: x for x in p},
        chains={"locatedInRegion": ("locatedIn", "inRegion"), "orderNation": ("placedBy", "locatedIn")},
        disjoint=(("Place", "Party", "Item", "Record"), ("OpenOrder", "FilledOrder", "PartialOrder"), ("Customer", "Supplier")),
        codes={"priority": ("1-URGENT", "2-HIGH", "3-MEDIUM", "4-NOT SPECIFIED", "5-LOW")},
        repeated=frozenset({"lineitem"}),
        equivalent=(("Customer", "Buyer"), ("Item", "Good")),
        restrictions=(
            ("Order", "placedBy", "some", ("class", "Customer")), ("Order", "placedBy", "exactly", (1, None)), ("LineItem", "lineOf", "some", ("class", "Order")),
            ("Nation", "inRegion", "only", ("class", "Region")), ("Record", "involves", "only", ("or", (("class", "Party"), ("class", "Item")))), ("Event", "eventOf", "max", (1, ("class", "Customer"))),
        ),
        subproperties={"locatedIn": "situatedIn", "suppliedFrom": "situatedIn", "inRegion": "situatedIn", "lineFrom": "involves", "lineForPart": "involves"},
    )


COMMERCE = _commerce()
