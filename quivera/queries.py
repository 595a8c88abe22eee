"""The registered graph queries over the driver's tables seen as a graph, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions import geo
from .functions import predicates as P
from .operators import mutations, olap
from .plans.graph import Graph
from .plans.native import GraphQuery, VertexQuery, multi_query
from .plans.raw_index import IndexQuery
from .plans.schema import connection_violations, multiplicity_violations, unique_violations
from .plans.traversal import DESC, __
from .sources.tables import id_of, star_graph
from .streaming import changelog

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def _query(sql: str | None = None):
    """Register a function of a graph (or of spark and the folder, by its argument names) under its own name."""

    def add(function):
        names = function.__code__.co_varnames[: function.__code__.co_argcount]

        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            given = {"spark": spark, "sf_dir": sf_dir}
            return function(*[star_graph(spark, sf_dir) if n == "g" else given[n] for n in names])

        QUERIES[function.__name__] = run
        if sql is not None:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def _sub(g: Graph, vertices: list[str], edges: list[str]) -> Graph:
    """The part of a graph that a query reads."""
    return Graph({x: g.vertex_tables[x] for x in vertices}, {x: g.edge_tables[x] for x in edges}, {x: g.ends[x] for x in edges if x in g.ends}, g.schema)


def _V(g: Graph, *labels: str):
    return g.traversal().V().hasLabel(*labels)


# ---- scans, filters, predicates ------------------------------------------------------------------------------


@_query("""select label, count(*) as n from (select 'region' as label from region union all select 'nation' from nation union all select 'customer' from customer
union all select 'supplier' from supplier union all select 'part' from part union all select 'order' from orders union all select 'document' from documents
union all select 'event' from events union all select 'user' from (select distinct user_id from events)) group by label""")
def scan_vertices(g):
    return g.vertices().groupBy("label").agg(F.count("*").alias("n"))


@_query("""select label, count(*) as n from (select 'placed' as label from orders union all select 'contains' from lineitem union all select 'supplied_by' from lineitem
union all select 'in_nation' from customer union all select 'in_nation' from supplier union all select 'in_region' from nation union all select 'did' from events) group by label""")
def scan_edges(g):
    return g.edges().groupBy("label").agg(F.count("*").alias("n"))


@_query("select s_suppkey * 16 + 3 as id, 's_name' as key, s_name as value from supplier union all select s_suppkey * 16 + 3, 's_suppkey', cast(s_suppkey as varchar) from supplier")
def scan_properties(g):
    found = GraphQuery(_sub(g, ["supplier"], [])).properties()
    return found.where(F.col("key").isin("s_name", "s_suppkey"))


@_query("select c_custkey, c_name from customer where c_custkey in (1, 7, 42, 99)")
def id_lookup(g):
    ids = [id_of("customer", k) for k in (1, 7, 42, 99)]
    return _sub(g, ["customer"], []).traversal().V(*ids).result(c_custkey="c_custkey", c_name="c_name")


@_query("select c_custkey, c_name from customer where c_mktsegment = 'BUILDING'")
def has_eq(g):
    return _V(g, "customer").has("c_mktsegment", "BUILDING").result(c_custkey="c_custkey", c_name="c_name")


@_query("select c_custkey, c_mktsegment from customer where c_mktsegment <> 'BUILDING'")
def has_neq(g):
    return _V(g, "customer").has("c_mktsegment", P.neq("BUILDING")).result(c_custkey="c_custkey", c_mktsegment="c_mktsegment")


@_query("select p_partkey, p_size from part where p_size > 10 and p_size <= 20")
def has_range(g):
    return _V(g, "part").has("p_size", P.gt(10)).has("p_size", P.lte(20)).result(p_partkey="p_partkey", p_size="p_size")


@_query("select o_orderkey from orders where o_totalprice < 20000 or o_totalprice >= 150000")
def has_outside(g):
    return _V(g, "order").has("o_totalprice", P.lt(20000.0).or_(P.gte(150000.0))).result(o_orderkey="o_orderkey")


@_query("select c_custkey from customer where c_mktsegment in ('BUILDING', 'MACHINERY')")
def has_within(g):
    return _V(g, "customer").has("c_mktsegment", P.within("BUILDING", "MACHINERY")).result(c_custkey="c_custkey")


@_query("select c_custkey from customer where c_mktsegment not in ('BUILDING', 'MACHINERY')")
def has_without(g):
    return _V(g, "customer").has("c_mktsegment", P.without("BUILDING", "MACHINERY")).result(c_custkey="c_custkey")


@_query("select c_custkey from customer where c_mktsegment = 'BUILDING' or (c_acctbal > 5000 and c_nationkey < 5)")
def has_or(g):
    return _V(g, "customer").or_(__.has("c_mktsegment", "BUILDING"), __.has("c_acctbal", P.gt(5000)).has("c_nationkey", P.lt(5))).result(c_custkey="c_custkey")


@_query("select s_suppkey from supplier")
def has_key(g):
    return g.traversal().V().hasLabel("supplier", "part").has("s_name").result(s_suppkey="s_suppkey")


@_query("select p_partkey from part")
def has_not_key(g):
    return g.traversal().V().hasLabel("supplier", "part").hasNot("s_name").result(p_partkey="p_partkey")


@_query("select key, count(*) as n from (select 'p_brand' as key from part union all select 'p_size' from part where p_size is not null) group by key")
def has_property_key(g):
    t = _V(g, "part").properties().hasKey("p_brand", "p_size")
    return t.df.groupBy(F.col("_key").alias("key")).agg(F.count("*").alias("n"))


@_query("select o_orderkey from orders where o_totalprice is not null and not (o_orderstatus = 'F')")
def predicate_negation(g):
    return _V(g, "order").has("o_orderstatus", P.eq("F").negate()).has("o_totalprice").result(o_orderkey="o_orderkey")


_TOKENS = r"list_filter(regexp_split_to_array(lower(text), '[^\p{L}\p{Nd}]'), lambda x: length(x) >= 2)"


@_query(f"select doc_id from documents where list_has_all({_TOKENS}, ['license', 'version'])")
def text_contains(g):
    return _V(g, "document").has("text", P.text_contains("License VERSION")).result(doc_id="doc_id")


@_query(f"select doc_id from documents where text is not null and not list_has_all({_TOKENS}, ['the'])")
def text_not_contains(g):
    return _V(g, "document").has("text", P.text_not_contains("the")).result(doc_id="doc_id")


@_query(f"select doc_id from documents where len(list_filter({_TOKENS}, lambda x: starts_with(x, 'licens'))) > 0")
def text_contains_prefix(g):
    return _V(g, "document").has("text", P.text_contains_prefix("Licens")).result(doc_id="doc_id")


@_query(f"select doc_id from documents where len(list_filter({_TOKENS}, lambda x: regexp_full_match(x, 'licen[cs]ed?'))) > 0")
def text_contains_regex(g):
    return _V(g, "document").has("text", P.text_contains_regex("licen[cs]ed?")).result(doc_id="doc_id")


@_query(f"select doc_id from documents where len(list_filter({_TOKENS}, lambda x: levenshtein(x, 'license') <= 2)) > 0")
def text_contains_fuzzy(g):
    return _V(g, "document").has("text", P.text_contains_fuzzy("license")).result(doc_id="doc_id")


@_query(f"select doc_id from documents where contains(' ' || array_to_string({_TOKENS}, ' ') || ' ', ' apache license version ')")
def text_contains_phrase(g):
    return _V(g, "document").has("text", P.text_contains_phrase("Apache License, Version")).result(doc_id="doc_id")


@_query("select p_partkey from part where starts_with(p_name, 'red') or starts_with(p_name, 'small r')")
def text_prefix(g):
    return _V(g, "part").has("p_name", P.text_prefix(" red ").or_(P.text_prefix("small r"))).result(p_partkey="p_partkey")


@_query("select c_custkey from customer where regexp_full_match(c_name, '.*#?0*1[0-9]')")
def text_regex(g):
    return _V(g, "customer").has("c_name", P.text_regex(".*#?0*1[0-9]")).result(c_custkey="c_custkey")


@_query("select p_partkey from part where levenshtein(trim(p_brand), 'Brand#11') <= 2")
def text_fuzzy(g):
    return _V(g, "part").has("p_brand", P.text_fuzzy("Brand#11")).result(p_partkey="p_partkey")


@_query("select c_custkey from customer where not regexp_full_match(c_name, '.*7') and not starts_with(c_name, 'Customer#00000001')")
def text_negations(g):
    return _V(g, "customer").has("c_name", P.text_not_regex(".*7")).has("c_name", P.text_not_prefix("Customer#00000001")).result(c_custkey="c_custkey")


@_query("select c_custkey from customer where ends_with(c_mktsegment, 'RY') and contains(c_name, '1')")
def text_p(g):
    return _V(g, "customer").has("c_mktsegment", P.ending_with("RY")).has("c_name", P.containing("1")).result(c_custkey="c_custkey")


def _places(g: Graph) -> Graph:
    """Customers with a place made of their keys: a grid over Europe and beyond."""
    c = g.vertex_tables["customer"]
    lat, lon = (F.col("c_custkey") % 1200) / 10 - 60, (F.col("c_custkey") % 700) / 5 - 70
    shape = geo.point_column(lat, lon)
    return Graph({"customer": c.withColumn("place", shape)}, {})


_GEO = "(select c_custkey, (c_custkey % 1200) / 10.0 - 60 as lat, (c_custkey % 700) / 5.0 - 70 as lon from customer)"
_KM = "2 * 6371.0087714 * asin(sqrt(least(1, pow(sin(radians(37.97 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(37.97)) * pow(sin(radians(23.72 - lon) / 2), 2))))"


@_query(f"select c_custkey from {_GEO} where {_KM} <= 3000")
def geo_within_circle(g):
    return _places(g).traversal().V().has("place", P.geo_within(geo.Geoshape.circle(37.97, 23.72, 3000))).result(c_custkey="c_custkey")


@_query(f"select c_custkey from {_GEO} where lat between -10 and 30 and lon between -20.5 and 40.5")
def geo_within_box(g):
    return _places(g).traversal().V().has("place", P.geo_within(geo.Geoshape.box(-10, -20.5, 30, 40.5))).result(c_custkey="c_custkey")


@_query(f"select c_custkey from {_GEO} where not ({_KM} <= 3000)")
def geo_disjoint_circle(g):
    return _places(g).traversal().V().has("place", P.geo_disjoint(geo.Geoshape.circle(37.97, 23.72, 3000))).result(c_custkey="c_custkey")


@_query(f"select c_custkey from {_GEO} where lat >= 0.05 and lat < 40.05 and lon < 30.05 and lon > -29.95")
def geo_intersect_polygon(g):
    ring = geo.Geoshape.polygon((0.05, -29.95), (0.05, 30.05), (40.05, 30.05), (40.05, -29.95))
    return _places(g).traversal().V().has("place", P.geo_intersect(ring)).result(c_custkey="c_custkey")


# ---- native queries ------------------------------------------------------------------------------------------


@_query("select c_custkey, c_acctbal from customer where c_mktsegment = 'BUILDING' and (c_nationkey = 3 or c_acctbal > 8000) order by c_acctbal desc, c_custkey limit 20")
def native_graph_query(g):
    s = _sub(g, ["customer"], [])
    q = GraphQuery(s).has("c_mktsegment", "BUILDING").or_(GraphQuery(s).has("c_nationkey", 3), GraphQuery(s).has("c_acctbal", P.gt, 8000.0))
    return q.orderBy("c_acctbal", "desc").orderBy("c_custkey").limit(20).vertices().select("c_custkey", "c_acctbal")


@_query("select o_orderkey from orders where o_totalprice >= 50000 and o_totalprice < 60000")
def interval_half_open(g):
    return GraphQuery(_sub(g, ["order"], [])).interval("o_totalprice", 50000.0, 60000.0).vertices().select("o_orderkey")


@_query("select count(*) as count from (select 1 from part where p_size > 25 limit 100)")
def native_limited_count(g):
    return GraphQuery(_sub(g, ["part"], [])).has("p_size", P.gt, 25).limit(100).count()


@_query("select count(p_size) as count, min(p_size) as min, max(p_size) as max, sum(p_size) as sum, round(avg(p_size), 6) as avg from part where p_size > 5")
def index_aggregation(g):
    q = GraphQuery(_sub(g, ["part"], [])).has("p_size", P.gt, 5)
    parts = [q.aggregate(k, "p_size") for k in ("COUNT", "MIN", "MAX", "SUM", "AVG")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p)  # one row each
    return out.select("count", "min", "max", "sum", F.round("avg", 6).alias("avg"))


@_query("""select c_custkey, o_orderkey from (select o_custkey as c_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as rn from orders) where rn <= 3""")
def vertex_topk_edges(g):
    t = _V(g, "customer").as_("c").local(__.outE("placed").order().by("o_totalprice", DESC).by("_dst").limit(3).inV())
    return t.result(c_custkey="c", o_orderkey="id").select(((F.col("c_custkey") - 2) / 16).cast("long").alias("c_custkey"), ((F.col("o_orderkey") - 5) / 16).cast("long").alias("o_orderkey"))


@_query("select c_custkey, coalesce(n, 0) as n from customer left join (select o_custkey, count(*) as n from orders where o_totalprice >= 1000 and o_totalprice < 90000 group by 1) on c_custkey = o_custkey")
def multi_vertex_count(g):
    c = g.vertex_tables["customer"]
    found = multi_query(g, c).direction("OUT").labels("placed").interval("o_totalprice", 1000.0, 90000.0).count()
    return found.select(((F.col("vertex") - 2) / 16).cast("long").alias("c_custkey"), F.col("count").alias("n"))


@_query("select n_nationkey, count(*) as n from nation join customer on c_nationkey = n_nationkey group by 1 union all select n_nationkey, count(*) from nation join supplier on s_nationkey = n_nationkey group by 1 order by 1")
def vertex_query_in(g):
    n = g.vertex_tables["nation"]
    ids = VertexQuery(g, n).direction("IN").labels("in_nation").vertexIds()
    kind = F.col("id") % 16
    return ids.groupBy("vertex", kind.alias("k")).agg(F.count("*").alias("n")).select(((F.col("vertex") - 1) / 16).cast("int").alias("n_nationkey"), "n")


@_query("select l_orderkey as o_orderkey, count(*) as n from lineitem where l_partkey in (1, 2, 3, 4, 5) group by 1")
def adjacent_vertices(g):
    s = _sub(g, ["order", "part"], ["contains"])
    parts = [id_of("part", k) for k in range(1, 6)]
    found = VertexQuery(s, g.vertex_tables["order"]).direction("OUT").labels("contains").adjacent(*parts).edges()
    return found.groupBy(((F.col("vertex") - 5) / 16).cast("long").alias("o_orderkey")).agg(F.count("*").alias("n"))


# ---- steps ---------------------------------------------------------------------------------------------------


@_query("select count(*) as n from customer join orders on o_custkey = c_custkey where c_mktsegment = 'BUILDING'")
def out_step(g):
    return _V(g, "customer").has("c_mktsegment", "BUILDING").out("placed").count().result(n="value")


@_query("select n_name, count(*) as n from nation join customer on c_nationkey = n_nationkey group by n_name")
def in_step(g):
    t = _V(g, "nation").as_("n").in_("in_nation").hasLabel("customer").select("n", by="n_name").groupCount()
    return t.result(n_name="key", n="value")


@_query("select count(*) as n from (select 1 from nation join region on n_regionkey = r_regionkey union all select 1 from nation join customer on c_nationkey = n_nationkey union all select 1 from nation join supplier on s_nationkey = n_nationkey)")
def both_step(g):
    return _V(g, "nation").both("in_region", "in_nation").count().result(n="value")


@_query("select o_orderkey, o_totalprice from orders where o_totalprice > 100000 and o_totalprice < 120000")
def outE_range(g):
    t = _V(g, "customer").outE("placed").has("o_totalprice", P.inside(100000.0, 120000.0))
    return t.result(o_orderkey="dst", o_totalprice="o_totalprice").select(((F.col("o_orderkey") - 5) / 16).cast("long").alias("o_orderkey"), "o_totalprice")


@_query("select c_name, o_orderkey from customer join orders on o_custkey = c_custkey where o_totalprice > 150000")
def inV_select(g):
    t = _V(g, "customer").as_("c").outE("placed").has("o_totalprice", P.gt(150000.0)).inV().as_("o").select("c", "o", by=["c_name", "o_orderkey"])
    return t.df.select("_value.c", "_value.o").toDF("c_name", "o_orderkey")


@_query("select o_orderstatus, count(*) as n from customer join orders on o_custkey = c_custkey group by 1")
def edge_ends(g):
    t = g.traversal().E().hasLabel("placed").bothV().hasLabel("order").groupCount("o_orderstatus")
    return t.result(o_orderstatus="key", n="value")


@_query("select count(*) as n from customer join orders on o_custkey = c_custkey")
def other_v(g):
    return _V(g, "order").bothE("placed").otherV().hasLabel("customer").count().result(n="value")


@_query("select p_brand, count(*) as n from customer join orders on o_custkey = c_custkey join lineitem on l_orderkey = o_orderkey join part on p_partkey = l_partkey where c_mktsegment = 'BUILDING' group by p_brand")
def two_hop(g):
    t = _V(g, "customer").has("c_mktsegment", "BUILDING").out("placed").out("contains").values("p_brand").groupCount()
    return t.result(p_brand="key", n="value")


@_query("select distinct p_brand from part")
def values_dedup(g):
    return _V(g, "part").values("p_brand").dedup().result(p_brand="value")


@_query("select p_partkey, p_retailprice from part order by p_retailprice desc, p_partkey limit 25")
def order_limit_total(g):
    return _V(g, "part").order().by("p_retailprice", DESC).by("p_partkey").limit(25).result(p_partkey="p_partkey", p_retailprice="p_retailprice")


@_query("select p_partkey from part order by p_partkey limit 10 offset 15")
def range_skip(g):
    return _V(g, "part").order().by("p_partkey").range_(15, 25).result(p_partkey="p_partkey")


@_query("select p_partkey from part order by p_partkey desc limit 7")
def tail_step(g):
    return _V(g, "part").order().by("p_partkey").tail(7).result(p_partkey="p_partkey")


@_query("select count(*) as n from lineitem")
def count(g):
    return g.traversal().E().hasLabel("contains").count().result(n="value")


@_query("select round(sum(o_totalprice), 2) as s, round(avg(o_totalprice), 4) as a, min(o_totalprice) as lo, max(o_totalprice) as hi from orders")
def sum_avg_min_max(g):
    v = _V(g, "order").values("o_totalprice")
    parts = [v.sum_().result(s="value"), v.mean().result(a="value"), v.min_().result(lo="value"), v.max_().result(hi="value")]
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p)  # one row each
    return out.select(F.round("s", 2).alias("s"), F.round("a", 4).alias("a"), "lo", "hi")


@_query("select count(*) as n from (select sum(o_totalprice) as s from orders where o_totalprice < -1) where s is not null")
def empty_reducer(g):
    return _V(g, "order").has("o_totalprice", P.lt(-1.0)).values("o_totalprice").sum_().count().result(n="value")


@_query("select c_mktsegment, count(*) as n from customer group by 1")
def group_count(g):
    return _V(g, "customer").groupCount("c_mktsegment").result(c_mktsegment="key", n="value")


@_query("select c_mktsegment, round(sum(c_acctbal), 2) as total from customer group by 1")
def group_by(g):
    t = _V(g, "customer").group("c_mktsegment", "c_acctbal", F.sum)
    return t.result(c_mktsegment="key", total="value").select("c_mktsegment", F.round("total", 2).alias("total"))


@_query("select count(*) as n from customer")
def fold_unfold(g):
    return _V(g, "customer").values("c_name").fold().unfold().count().result(n="value")


@_query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 140000)")
def where_semi(g):
    return _V(g, "customer").where(__.out("placed").has("o_totalprice", P.gt(140000.0))).result(c_custkey="c_custkey")


@_query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 100000)")
def not_anti(g):
    return _V(g, "customer").not_(__.out("placed").has("o_totalprice", P.gt(100000.0))).result(c_custkey="c_custkey")


@_query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'F') and exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'O')")
def and_step(g):
    return _V(g, "customer").and_(__.out("placed").has("o_orderstatus", "F"), __.out("placed").has("o_orderstatus", "O")).result(c_custkey="c_custkey")


@_query("select c_custkey from customer where (select count(*) from orders where o_custkey = c_custkey) >= 12")
def where_count(g):
    return _V(g, "customer").where(__.out("placed").count().is_(P.gte(12))).result(c_custkey="c_custkey")


@_query("select coalesce(o_orderkey, -1) as o, c_custkey as c from customer left join orders on o_custkey = c_custkey")
def optional_left(g):
    t = _V(g, "customer").as_("c").optional(__.out("placed"))
    is_order = F.col("o") % 16 == 5
    return t.result(o="id", c="c").select(F.when(is_order, ((F.col("o") - 5) / 16).cast("long")).otherwise(-1).alias("o"), ((F.col("c") - 2) / 16).cast("long").alias("c"))


@_query("""select c_custkey as c, count(*) as n from (select c_custkey from customer join orders on o_custkey = c_custkey and o_totalprice > 140000
union all select c_custkey from customer join nation on c_nationkey = n_nationkey where not exists (select 1 from orders where o_custkey = c_custkey and o_totalprice > 140000)) group by 1""")
def coalesce_step(g):
    t = _V(g, "customer").as_("c").coalesce(__.out("placed").has("o_totalprice", P.gt(140000.0)), __.out("in_nation"))
    return t.result(c="c").groupBy(((F.col("c") - 2) / 16).cast("long").alias("c")).agg(F.count("*").alias("n"))


@_query("select kind, count(*) as n from (select 'order' as kind from customer join orders on o_custkey = c_custkey union all select 'nation' from customer join nation on c_nationkey = n_nationkey) group by 1")
def union_step(g):
    return _V(g, "customer").union(__.out("placed"), __.out("in_nation")).groupCount("label").result(kind="key", n="value")


@_query("select count(*) as n from (select 1 from customer join orders on o_custkey = c_custkey where c_acctbal > 0 union all select 1 from customer join nation on n_nationkey = c_nationkey where not c_acctbal > 0)")
def choose_step(g):
    t = _V(g, "customer").choose(__.has("c_acctbal", P.gt(0.0)), __.out("placed"), __.out("in_nation"))
    return t.count().result(n="value")


@_query("select case c_mktsegment when 'BUILDING' then 'b' when 'MACHINERY' then 'm' else 'other' end as v, count(*) as n from customer group by 1")
def choose_options(g):
    t = _V(g, "customer").choose("c_mktsegment", options={"BUILDING": __.constant("b"), "MACHINERY": __.constant("m"), None: __.constant("other")})
    return t.groupCount().result(v="key", n="value")


@_query("select c_name as name, (select count(*) from orders where o_custkey = c_custkey) as orders from customer")
def project_by(g):
    t = _V(g, "customer").project("name", "orders", by=["c_name", __.out("placed").count()])
    return t.df.select("_value.name", "_value.orders")


@_query("select c_name, n_name from customer join nation on c_nationkey = n_nationkey")
def select_as(g):
    t = _V(g, "customer").as_("c").out("in_nation").as_("n").select("c", "n", by=["c_name", "n_name"])
    return t.df.select(F.col("_value.c").alias("c_name"), F.col("_value.n").alias("n_name"))


@_query("select s_suppkey * 16 + 3 || '>' || (s_nationkey * 16 + 1) || '>' || (n_regionkey * 16) as path from supplier join nation on n_nationkey = s_nationkey")
def path2(g):
    t = _V(g, "supplier").out("in_nation").out("in_region").path()
    return t.df.select(F.array_join("_value", ">").alias("path"))


@_query("select child, count(*) as n from (select cast(n_regionkey * 16 as varchar) as child from supplier join nation on s_nationkey = n_nationkey) group by 1")
def tree_step(g):
    t = _V(g, "supplier").out("in_nation").out("in_region").tree()
    return t.df.where(F.size("prefix") == 2).groupBy("child").agg(F.sum("_value").alias("n"))


@_query("select a.s_suppkey as s, count(*) as n from supplier a join supplier b on a.s_nationkey = b.s_nationkey and a.s_suppkey <> b.s_suppkey group by 1")
def simple_path(g):
    t = _V(g, "supplier").as_("s").out("in_nation").in_("in_nation").hasLabel("supplier").simplePath().select("s").groupCount()
    return t.df.select(((F.col("_key") - 3) / 16).cast("long").alias("s"), F.col("_value").alias("n"))


@_query("select count(*) as n from supplier")
def cyclic_path(g):
    return _V(g, "supplier").out("in_nation").in_("in_nation").hasLabel("supplier").cyclicPath().count().result(n="value")


@_query("select r_name, count(*) as n from region join nation on n_regionkey = r_regionkey join (select c_nationkey as k from customer union all select s_nationkey from supplier) on k = n_nationkey group by 1")
def repeat_times(g):
    t = _V(g, "region").as_("r").repeat(__.in_("in_region", "in_nation"), times=2).select("r", by="r_name").groupCount()
    return t.result(r_name="key", n="value")


@_query("select count(*) as n from (select 1 from region join nation on n_regionkey = r_regionkey union all select 1 from region join nation on n_regionkey = r_regionkey join (select c_nationkey as k from customer union all select s_nationkey from supplier) on k = n_nationkey)")
def repeat_emit(g):
    return _V(g, "region").repeat(__.in_("in_region", "in_nation"), times=2, emit=True).count().result(n="value")


@_query("""with recursive up(id, pos, kind) as (select s_suppkey, s_nationkey, 'nation' from supplier union all select id, n_regionkey, 'region' from up join nation on up.pos = n_nationkey where kind = 'nation')
select pos as r_regionkey, count(*) as n from up where kind = 'region' group by 1""")
def repeat_until(g):
    t = _V(g, "supplier").repeat(__.out("in_nation", "in_region"), until=__.hasLabel("region"), max_loops=4).groupCount("r_regionkey")
    return t.result(r_regionkey="key", n="value")


@_query("select c_custkey as c, s_suppkey as s from customer join nation on c_nationkey = n_nationkey join supplier on s_nationkey = n_nationkey where n_name in (select n_name from nation where n_nationkey < 3)")
def match_step(g):
    t = _V(g, "nation").has("n_nationkey", P.lt(3)).match(("n", __.in_("in_nation").hasLabel("customer"), "c"), ("n", __.in_("in_nation").hasLabel("supplier"), "s"))
    return t.result(c="c", s="s").select(((F.col("c") - 2) / 16).cast("long").alias("c"), ((F.col("s") - 3) / 16).cast("long").alias("s"))


@_query("select p_partkey, 2.0 * p_size + 1 as v from part")
def math_step(g):
    t = _V(g, "part").as_("p").values("p_size").math("_ * 2 + 1")
    return t.result(v="value", p="p").select(((F.col("p") - 4) / 16).cast("long").alias("p_partkey"), "v")


@_query("select c_custkey, cast(1 + c_nationkey + n_regionkey as bigint) as total from customer join nation on n_nationkey = c_nationkey")
def sack_step(g):
    t = _V(g, "customer").as_("c").withSack(1).sack(lambda a, b: a + b, "c_nationkey").out("in_nation").sack(lambda a, b: a + b, "n_regionkey").sack()
    return t.result(c="c", total="value").select(((F.col("c") - 2) / 16).cast("long").alias("c_custkey"), F.col("total").cast("long").alias("total"))


@_query("select upper(c_mktsegment) || '!' as v, count(*) as n from customer group by 1")
def map_step(g):
    return _V(g, "customer").values("c_mktsegment").map_(lambda c: F.concat(F.upper(c), F.lit("!"))).groupCount().result(v="key", n="value")


@_query("select count(*) as n from (select distinct n_regionkey from nation)")
def aggregate_cap(g):
    t = _V(g, "nation").values("n_regionkey").dedup().aggregate("x")
    return t.cap("x").count().result(n="value")


@_query("select n_nationkey as id, n_name, cast(n_regionkey as varchar) as region from nation")
def valuemap(g):
    t = _V(g, "nation").valueMap("n_name", "n_regionkey", "n_nationkey")
    v = F.col("_value")
    return t.df.select(v["n_nationkey"].cast("int").alias("id"), v["n_name"].alias("n_name"), v["n_regionkey"].alias("region"))


@_query("select cast(r_regionkey * 16 as varchar) as id, 'region' as label, r_name from region")
def element_map(g):
    v = F.col("_value")
    return _V(g, "region").elementMap("r_name").df.select(v["id"].alias("id"), v["label"].alias("label"), v["r_name"].alias("r_name"))


@_query("select cast(r_regionkey * 16 as bigint) as id, 'region' as label from region union all select n_nationkey * 16 + 1, 'nation' from nation")
def id_label(g):
    return g.traversal().V().hasLabel("region", "nation").result(id="id", label="label")


@_query("select count(*) as vertices, (select count(*) from nation join region on n_regionkey = r_regionkey) as edges from (select r_regionkey from region where r_regionkey in (select n_regionkey from nation) union all select n_nationkey from nation)")
def subgraph(g):
    s = _sub(g, ["region", "nation"], ["in_region"]).traversal().E().hasLabel("in_region").subgraph()
    return s.vertices().agg(F.count("*").alias("vertices")).join(s.edges().agg(F.count("*").alias("edges")))


@_query("select least(50, (select count(*) from customer)) as n, least(50, (select count(*) from customer)) as known")
def sample_step(g):
    """Size of a sample, and how many of it are customers, each once."""
    picked = _V(g, "customer").sample(50).result(c_custkey="c_custkey")
    known = picked.distinct().join(g.vertex_tables["customer"], "c_custkey", "left_semi").agg(F.count("*").alias("known"))
    return picked.agg(F.count("*").alias("n")).join(known)


@_query("select true as near_half, 0 as strangers")
def coin_step(g):
    """About half of the orders, and nothing else (five standard errors)."""
    kept, all_ = _V(g, "order").coin(0.5).result(o_orderkey="o_orderkey"), g.vertex_tables["order"]
    n = all_.agg(F.count("*").alias("n")).join(kept.agg(F.count("*").alias("k"))).join(kept.join(all_, "o_orderkey", "left_anti").agg(F.count("*").cast("int").alias("strangers")))
    return n.select((F.abs(F.col("k") - F.col("n") / 2) <= 2.5 * F.sqrt("n") + 1).alias("near_half"), "strangers")


# ---- graph computing -----------------------------------------------------------------------------------------


@_query("select c_custkey * 16 + 2 as id, (select count(*) from orders where o_custkey = c_custkey) as degree from customer union all select o_orderkey * 16 + 5, 0 from orders")
def degree_out(g):
    return olap.degree_counts(_sub(g, ["customer", "order"], ["placed"]), "out")


@_query("""select n_nationkey * 16 + 1 as id, (select count(*) from customer where c_nationkey = n_nationkey) + (select count(*) from supplier where s_nationkey = n_nationkey) as degree from nation
union all select c_custkey * 16 + 2, 0 from customer union all select s_suppkey * 16 + 3, 0 from supplier""")
def degree_in(g):
    return olap.degree_counts(_sub(g, ["customer", "supplier", "nation"], ["in_nation"]), "in")


@_query("""select n_nationkey * 16 + 1 as id, 1 + (select count(*) from supplier where s_nationkey = n_nationkey) + (select count(*) from customer where c_nationkey = n_nationkey) as degree from nation
union all select c_custkey * 16 + 2, 1 from customer union all select s_suppkey * 16 + 3, 1 from supplier union all select r_regionkey * 16, (select count(*) from nation where n_regionkey = r_regionkey) from region""")
def degree_both(g):
    return olap.degree_counts(_sub(g, ["customer", "supplier", "nation", "region"], ["in_nation", "in_region"]), "both")


@_query("""select s_suppkey * 16 + 3 as id, 1 as degree from supplier union all select c_custkey * 16 + 2, 1 from customer
union all select n_nationkey * 16 + 1, 0 from nation union all select r_regionkey * 16, 0 from region""")
def walk_counts(g):
    return olap.degree_counts(_sub(g, ["customer", "supplier", "nation", "region"], ["in_nation", "in_region"]), "out", length=2)


def _rank_sql(rounds: int) -> str:
    v = "select c_custkey * 16 + 2 as id from customer union all select o_orderkey * 16 + 5 from orders union all select p_partkey * 16 + 4 from part"
    e = "select o_custkey * 16 + 2 as src, o_orderkey * 16 + 5 as dst from orders union all select l_orderkey * 16 + 5, l_partkey * 16 + 4 from lineitem"
    out = [f"v as materialized ({v})", f"e as materialized ({e})", "d as materialized (select src, count(*) as deg from e group by 1)", "r0 as materialized (select id, 1.0::double / (select count(*) from v) as rank from v)"]
    for k in range(rounds):
        sent = f"select e.dst as id, sum(r{k}.rank / deg) as m from e join r{k} on r{k}.id = e.src join d on d.src = e.src group by 1"
        out.append(f"r{k + 1} as materialized (select v.id, 0.15 / (select count(*) from v) + 0.85 * coalesce(m, 0) as rank from v left join ({sent}) using (id))")
    return "with " + ", ".join(out) + f" select id, round(rank * 1000, 6) as rank from r{rounds}"


@_query(_rank_sql(9))
def pagerank(g):
    """Over customers, orders and parts with all their edges, parallel ones included."""
    s = _sub(g, ["customer", "order", "part"], ["placed", "contains"])
    return olap.page_rank(s).select("id", F.round(F.col("rank") * 1000, 6).alias("rank"))


@_query("""with r as (select 0 as id, 0 as distance union all select n_nationkey * 16 + 1, 1 from nation where n_regionkey = 0),
c as (select c_custkey * 16 + 2 as id, 2 as distance, c_custkey from customer where c_nationkey in (select n_nationkey from nation where n_regionkey = 0))
select id, cast(distance as double) as distance from r union all select id, distance from c union all select s_suppkey * 16 + 3, 2 from supplier where s_nationkey in (select n_nationkey from nation where n_regionkey = 0)""")
def sssp(g):
    """Distances to a region from all that reaches it."""
    return olap.shortest_distance(_sub(g, ["customer", "supplier", "nation", "region"], ["in_nation", "in_region"]), 0).where("distance is not null")


@_query("""select o_orderkey * 16 + 5 as id, least(c, l) as component from (select o_orderkey, o_custkey * 16 + 2 as c, min(o_orderkey) over (partition by o_custkey) * 16 + 5 as l from orders)
union all select c_custkey * 16 + 2, least(c_custkey * 16 + 2, coalesce((select min(o_orderkey) * 16 + 5 from orders where o_custkey = c_custkey), 9e18::bigint)) from customer""")
def connected_components(g):
    return olap.connected_components(_sub(g, ["customer", "order"], ["placed"]))


@_query("""select 16 * k + 3 as id, 3 as component from generate_series(0, 299) as t(k)""")
def components_of_a_chain(g):
    """A chain of 300 vertices is one component after a few rounds."""
    ids = g.spark.range(300).select((F.col("id") * 16 + 3).alias("id"))
    return olap.connected_components(Graph({"x": ids}, {"next": ids.where("id > 3").select("id", (F.col("id") - 16).alias("dst")).withColumnRenamed("id", "src")}))


@_query("""select s_suppkey * 16 + 3 as source, n_regionkey * 16 as target, 2 as distance, (s_suppkey * 16 + 3) || '>' || (s_nationkey * 16 + 1) || '>' || (n_regionkey * 16) as path from supplier join nation on s_nationkey = n_nationkey""")
def shortest_path(g):
    t = _V(_sub(g, ["customer", "supplier", "nation", "region"], ["in_nation", "in_region"]), "supplier").shortestPath(target=__.hasLabel("region"), max_depth=2)
    return t.df.where("distance = 2").select("source", "target", "distance", F.array_join("path", ">").alias("path"))


@_query("""select s_suppkey * 16 + 3 as id, s_suppkey * 16 + 3 as cluster from supplier union all select c_custkey * 16 + 2, c_custkey * 16 + 2 from customer
union all select n, min(x) from (select s_nationkey * 16 + 1 as n, s_suppkey * 16 + 3 as x from supplier union all select c_nationkey * 16 + 1, c_custkey * 16 + 2 from customer) group by n
union all select n_nationkey * 16 + 1, n_nationkey * 16 + 1 from nation where n_nationkey not in (select s_nationkey from supplier union all select c_nationkey from customer)""")
def peer_pressure(g):
    """Members of nations vote for themselves, so that a nation joins the least of them."""
    return olap.peer_pressure(_sub(g, ["customer", "supplier", "nation"], ["in_nation"]), rounds=4)


@_query("select o_orderpriority as key, count(*) as n from orders group by 1")
def map_reduce(g):
    state = g.vertex_tables["order"]
    return olap.Computer(g).map_reduce(state, F.col("o_orderpriority"), F.lit(1), F.sum, "n")


# ---- schema, changes, log ------------------------------------------------------------------------------------


@_query("select label, count(*) as n from (select 'placed' as label from orders where o_orderkey % 7 = 0) group by 1")
def ghost_edges(g):
    s = _sub(g, ["customer", "order"], ["placed"])
    gone = mutations.Graph({**s.vertex_tables, "order": s.vertex_tables["order"].where("o_orderkey % 7 <> 0")}, s.edge_tables, s.ends, s.schema)
    return mutations.ghost_edges(gone).groupBy("label").agg(F.count("*").alias("n"))


@_query("select l_orderkey as o, l_partkey as p, count(*) as n from lineitem group by 1, 2 having count(*) > 1")
def multiplicity_check(g):
    found = multiplicity_violations(g.edge_tables["contains"], "SIMPLE")
    return found.select(((F.col("src") - 5) / 16).cast("long").alias("o"), ((F.col("dst") - 4) / 16).cast("long").alias("p"), "n")


@_query("select p_brand, count(*) as n from part group by 1 having count(*) > 1")
def unique_check(g):
    return unique_violations(g.vertex_tables["part"], ["p_brand"])


@_query("select 'in_nation' as label, count(*) as n from supplier")
def connection_check(g):
    from .plans.schema import EdgeLabel, GraphSchema

    schema = GraphSchema().with_edge_label(EdgeLabel("in_nation", connections=(("customer", "nation"),)))
    found = connection_violations(_sub(g, ["customer", "supplier", "nation"], ["in_nation"]), schema)
    return found.groupBy("label").agg(F.count("*").alias("n"))


@_query("""select (select count(*) from nation where n_regionkey <> 0) as vertices,
(select count(*) from (select c_nationkey as k from customer union all select s_nationkey from supplier) join nation on k = n_nationkey where n_regionkey <> 0) as edges""")
def drop_step(g):
    s = _sub(g, ["nation", "customer", "supplier"], ["in_nation"])
    left = _V(s, "nation").has("n_regionkey", 0).drop()
    return left.vertices(("nation",)).agg(F.count("*").alias("vertices")).join(left.edges().agg(F.count("*").alias("edges")))


@_query("select r_regionkey, case when r_regionkey < 2 then 'merged' else r_name end as r_name from region union all select 99, 'merged'")
def merge_vertices(g):
    r = g.vertex_tables["region"]
    rows = r.where("r_regionkey < 2").select("r_regionkey").unionByName(r.limit(1).select(F.lit(99).alias("r_regionkey")))
    rows = rows.select((F.col("r_regionkey").cast("long") * 16).alias("id"), "r_regionkey", F.lit("merged").alias("r_name"))
    return mutations.merge_vertices(g, "region", rows, ["r_regionkey"]).vertex_tables["region"].select("r_regionkey", "r_name")


@_query("select event_type, count(*) as n from events where ts + interval 3 day > (select max(ts) from events) group by 1")
def ttl_filter(spark, sf_dir):
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    now = events.agg(F.max("ts")).first()[0]
    return changelog.alive(events, "ts", 3 * 86400, now).groupBy("event_type").agg(F.count("*").alias("n"))


@_query("select case when event_type = 'error' then 'REMOVED' else 'ADDED' end as op, 'edge' as kind, event_type as label, count(*) as n from events group by 1, 2, 3")
def changelog_counts(spark, sf_dir):
    return changelog.change_counts(changelog.events_as_changes(spark.read.parquet(f"{sf_dir}/events.parquet")))


@_query("select 'ADDED' as op, 'vertex' as kind, 'nation' as label, count(*) as n from nation where n_nationkey >= 20 union all select 'REMOVED', 'edge', 'in_region', count(*) from nation where n_regionkey = 1")
def changelog_diff(g):
    s = _sub(g, ["region", "nation"], ["in_region"])
    before = s.with_vertices("nation", s.vertex_tables["nation"].where("n_nationkey < 20"))
    after = s.with_edges("in_region", s.edge_tables["in_region"].where(F.col("dst") != 16))
    return changelog.change_counts(changelog.changes_between(before, after, "log", 1, "2024-01-01 00:00:00"))


@_query(f"select doc_id, round((cast(list_contains({_TOKENS}, 'license') as int) + cast(list_contains({_TOKENS}, 'apache') as int)) / 2.0, 3) as score from documents where list_contains({_TOKENS}, 'license') or list_contains({_TOKENS}, 'apache')")
def raw_index_query(g):
    found = IndexQuery(_sub(g, ["document"], []), "v.text:license v.text:apache").vertices()
    return found.select("doc_id", F.round("score", 3).alias("score"))


@_query(f"select count(*) as total from documents where list_contains({_TOKENS}, 'license') and not list_contains({_TOKENS}, 'apache')")
def raw_index_totals(g):
    return IndexQuery(_sub(g, ["document"], []), "+text:license -text:apache").vertexTotals()


@_query("select count(*) as n from (select distinct src, dst from (select n_nationkey as src, n_regionkey as dst from nation union all select n_nationkey, 0 from nation))")
def merge_edges(g):
    s = Graph({}, {"in_region": g.edge_tables["in_region"].select("src", "dst")})
    merged = s.traversal().mergeE("in_region", g.vertex_tables["nation"].select(F.col("id").alias("src"), F.lit(0).cast("long").alias("dst")))
    return merged.edges().agg(F.count("*").alias("n"))


@_query("select c_custkey from customer where c_nationkey = 3 or c_acctbal > 9000 order by c_acctbal desc, c_custkey limit 10 offset 5")
def or_distinct_range(g):
    """OR branches are one scan: an element that several branches accept comes once, then order and range."""
    s = _sub(g, ["customer"], [])
    q = GraphQuery(s).or_(GraphQuery(s).has("c_nationkey", 3), GraphQuery(s).has("c_acctbal", P.gt, 9000.0)).orderBy("c_acctbal", "desc").orderBy("c_custkey")
    return q.vertices().offset(5).limit(10).select("c_custkey")


@_query("select cast(c_nationkey as bigint) as v, count(*) as n from customer group by 1")
def coerced_values(g):
    from .functions.values import coerce
    from .plans.schema import PropertyKey

    v = _V(g, "customer").values("c_nationkey", "c_name")
    number = coerce(F.col("_value"), PropertyKey("x", "Long"))
    return v.df.select(number.alias("v")).where("v is not null").groupBy("v").agg(F.count("*").alias("n"))




@_query("select n_name, string_agg(c_name, ',' order by c_name) as names from nation join customer on c_nationkey = n_nationkey group by n_name")
def fold_names(g):
    t = _V(g, "customer").as_("c").out("in_nation").as_("n").select("c", "n", by=["c_name", "n_name"])
    return t.df.groupBy(F.col("_value.n").alias("n_name")).agg(F.array_join(F.sort_array(F.collect_list("_value.c")), ",").alias("names"))


@_query("select a.c_custkey as a, count(*) as n from customer a join customer b on a.c_nationkey = b.c_nationkey and a.c_custkey <> b.c_custkey group by 1")
def where_neq_label(g):
    """Counted by start, as the pairs grow with the square of a nation's customers."""
    t = _V(g, "customer").as_("a").out("in_nation").in_("in_nation").hasLabel("customer").where(P.neq("a")).select("a", by="c_custkey").groupCount()
    return t.result(a="key", n="value")


@_query("select o_orderkey, o_custkey * 16 + 2 as out_vertex, o_orderkey * 16 + 5 as in_vertex from orders")
def relation_ids(g):
    from .functions.values import parse_relation_id, relation_id

    e = g.edge_tables["placed"]
    text = e.select(relation_id(((F.col("dst") - 5) / 16).cast("long"), F.col("src"), F.lit(7), F.col("dst")).alias("r"))
    p = text.select(parse_relation_id(F.col("r")).alias("p"))
    return p.select(F.col("p.relation").alias("o_orderkey"), "p.out_vertex", "p.in_vertex")


@_query("select (select 2 * count(*) from region) as vertices, (select count(*) from nation) + (select count(*) from region) as edges")
def add_elements(g):
    r = g.vertex_tables["region"]
    s = Graph({"region": r}, {"in_region": g.edge_tables["in_region"].select("src", "dst")}, g.ends)
    more = r.select((F.col("id") + 1600).alias("id"), (F.col("r_regionkey") + 100).alias("r_regionkey"), "r_name")
    grown = s.traversal().addV("region", more.unionByName(r)).traversal()
    grown = grown.graph.with_vertices("nation", g.vertex_tables["nation"])
    grown = grown.traversal().addE("in_region", r.select((F.col("id") + 1600).alias("src"), F.col("id").alias("dst")).unionByName(r.select(F.lit(-1).cast("long").alias("src"), F.col("id").alias("dst"))))
    return grown.vertices(("region",)).agg(F.count("*").alias("vertices")).join(grown.edges().agg(F.count("*").alias("edges")))


# ---- edges that are parallel, branches by traverser, orders of two keys, long loops ---------------------------


@_query("select count(*) - 1 as edges, (select count(*) from orders) as vertices from lineitem")
def parallel_edges_drop(g):
    """Dropping the first of the edges between an order and a part leaves those beside it."""
    s = _sub(g, ["order", "part"], ["contains"])
    pair = multiplicity_violations(s.edge_tables["contains"], "SIMPLE").orderBy("src", "dst").limit(1)
    first = s.edges(("contains",)).join(pair.select("src", "dst"), ["src", "dst"], "left_semi").agg(F.min("id").alias("id"))
    left = mutations.drop_edges(s, first)
    return left.edges().agg(F.count("*").alias("edges")).join(left.vertices(("order",)).agg(F.count("*").alias("vertices")))


@_query("select l_returnflag, count(*) as n from lineitem group by 1")
def parallel_edges_subgraph(g):
    s = _sub(g, ["order", "part"], ["contains"]).traversal().E().hasLabel("contains").subgraph()
    return s.edges().groupBy("l_returnflag").agg(F.count("*").alias("n"))


@_query("""select c_custkey, o_orderkey from customer left join (select o_custkey, o_orderkey, row_number() over (partition by o_custkey order by o_totalprice desc, o_orderkey) as k from orders) on o_custkey = c_custkey and k = 1""")
def optional_local_limit(g):
    """A limit in an optional branch counts for each traverser by itself."""
    t = _V(g, "customer").as_("c").optional(__.out("placed").order().by("o_totalprice", DESC).by("id").limit(1))
    return t.df.select(((F.col("_as_c") - 2) / 16).cast("long").alias("c_custkey"), F.when(F.col("_id") % 16 == 5, ((F.col("_id") - 5) / 16).cast("long")).alias("o_orderkey"))


@_query("""select c_custkey, coalesce(n, c_nationkey * 16 + 1) as v from customer left join (select o_custkey, min(o_orderkey) * 16 + 5 as n from orders group by 1) on o_custkey = c_custkey""")
def coalesce_local_limit(g):
    t = _V(g, "customer").as_("c").coalesce(__.out("placed").order().by("id").limit(1), __.out("in_nation"))
    return t.df.select(((F.col("_as_c") - 2) / 16).cast("long").alias("c_custkey"), F.col("_id").alias("v"))


@_query("""select l_orderkey, l_linenumber from (select l_orderkey, l_linenumber, row_number() over (partition by l_orderkey order by l_returnflag, l_quantity, l_linenumber) as k from lineitem) where k <= 2""")
def vertex_order_two_keys(g):
    q = VertexQuery(_sub(g, ["order"], ["contains"])).labels("contains").direction("out").orderBy("l_returnflag").orderBy("l_quantity").orderBy("l_linenumber").limit(2)
    return q.edges().select(((F.col("vertex") - 5) / 16).cast("long").alias("l_orderkey"), "l_linenumber")


@_query("select 7 as last")
def repeat_deep_chain(g):
    """A chain of eight nations is walked to its end, and a loop that is cut off early raises."""
    ids = g.vertex_tables["nation"].select("id", "n_nationkey")
    chain = Graph({"nation": ids}, {"next": ids.where("n_nationkey < 7").select(F.col("id").alias("src"), (F.col("id") + 16).alias("dst"))}, {"next": (("nation",), ("nation",))})
    from .operators.olap import checkpointed

    t = _V(chain, "nation").has("n_nationkey", 0).repeat(__.out("next"), until=__.not_(__.out("next")), checkpoint=checkpointed)
    try:
        _V(chain, "nation").has("n_nationkey", 0).repeat(__.out("next"), until=__.not_(__.out("next")), max_loops=3)
    except RuntimeError:
        return t.result(last="n_nationkey")
    raise AssertionError("a loop was cut off without a word")


@_query("select c_custkey, 2 * c_acctbal + 1 as v from customer")
def math_without_blanks(g):
    return _V(g, "customer").as_("c").values("c_acctbal").math("_*2+1").df.select(((F.col("_as_c") - 2) / 16).cast("long").alias("c_custkey"), F.col("_value").alias("v"))


@_query("select o_orderkey, c_name from orders join customer on o_custkey = c_custkey")
def select_by_of_one_table(g):
    t = _V(g, "order").as_("o").in_("placed").as_("c").select("o", "c", by=["o_orderkey", "c_name"])
    return t.df.select("_value.o", "_value.c").withColumnsRenamed({"o": "o_orderkey", "c": "c_name"})


# ---- queries of single rules ---------------------------------------------------------------------------------


@_query("select r_regionkey * 16 as vertex, 2 as n from region")
def self_loop_both(g):
    """A loop comes twice in direction both."""
    r = g.vertex_tables["region"]
    s = Graph({"region": r}, {"self": r.select(F.col("id").alias("src"), F.col("id").alias("dst"))})
    return VertexQuery(s).direction("both").count().withColumnRenamed("count", "n")


@_query("select 0 as n")
def properties_in_direction_in(g):
    return VertexQuery(_sub(g, ["nation"], [])).direction("in").properties().agg(F.count("*").cast("int").alias("n"))


@_query("select (select count(*) from nation) as without, 0 as with_value")
def unknown_key(g):
    """A key that no element has: its absence holds everywhere, a value nowhere."""
    s = _sub(g, ["nation"], [])
    n = lambda q, c: q.vertices().agg(F.count("*").alias(c))
    return n(GraphQuery(s).hasNot("no_such_key"), "without").join(n(GraphQuery(s).has("no_such_key", 1), "with_value").select(F.col("with_value").cast("int")))


@_query("select 1 as refused, (select count(*) from nation where n_regionkey = 1) as found")
def force_index(g):
    """Under force-index a query without a condition on an enabled index raises, one with it runs."""
    from .plans.native import ScanNotAllowed
    from .plans.schema import Index

    s = _sub(g, ["nation"], [])
    s = Graph(s.vertex_tables, s.edge_tables, s.ends, s.schema.with_index(Index("byRegion", ("n_regionkey",), status="ENABLED")))
    try:
        GraphQuery(s, force_index=True).has("n_name", "FRANCE").vertices()
    except ScanNotAllowed:
        return GraphQuery(s, force_index=True).has("n_regionkey", 1).vertices().agg(F.count("*").alias("found")).withColumn("refused", F.lit(1))
    raise AssertionError("a full scan was allowed")


@_query("select o_orderkey from orders where o_totalprice > 100000")
def computer_filters(g):
    """A computer sees the vertices and edges that its filters pass."""
    s = _sub(g, ["order"], ["placed"])
    c = olap.Computer(s, vertex_filter=F.col("o_totalprice") > 100000, edge_labels=("placed",), edge_filter=F.col("o_totalprice") > 100000)
    ids = c.vertices().join(c.edges().select(F.col("dst").alias("id")), "id", "left_semi")
    return ids.select("o_orderkey")


@_query("select n_nationkey, (select count(*) from customer where c_nationkey = n_nationkey) + (select count(*) from supplier where s_nationkey = n_nationkey) as degree, 0 as edges from nation")
def computer_persist_new(g):
    """Results as properties of a new graph, which has no edges."""
    s = _sub(g, ["nation", "customer", "supplier"], ["in_nation"])
    kept = olap.Computer(s).persist(olap.degree_counts(s, "in"), "NEW")
    return kept.vertex_tables["nation"].select("n_nationkey", "degree", F.lit(len(kept.edge_tables)).alias("edges"))


@_query("select c_mktsegment as segment, count(*) as n from customer group by 1")
def vertex_scan_job(g):
    """A user's job over batches of vertices, with its metrics summed."""

    def job(batches):
        for b in batches:
            n = b.groupby("c_mktsegment").size()
            yield n.reset_index().set_axis(["segment", "n"], axis=1)

    return olap.scan_job(_sub(g, ["customer"], []), job, "segment string, n long", ("customer",)).groupBy("segment").agg(F.sum("n").alias("n"))


@_query("select r_regionkey, r_name from region")
def assigned_ids(g):
    """Ids made from natural keys join back to their rows, alike in both tables."""
    r = g.vertex_tables["region"].select("r_regionkey", "r_name")
    keyed = mutations.assign_ids(r, ["r_name"])
    again = mutations.assign_ids(r.select("r_name"), ["r_name"]).select("id")
    return keyed.join(again, "id").select("r_regionkey", "r_name")


@_query("select 'REMOVED' as op, 'n_name' as label, count(*) as n from nation where n_regionkey = 2 union all select 'ADDED', 'n_name', count(*) from nation where n_regionkey = 2")
def changelog_properties(g):
    """A property that changes under the same id is logged with its old and its new value."""
    s = _sub(g, ["nation"], [])
    after = s.with_vertices("nation", s.vertex_tables["nation"].withColumn("n_name", F.when(F.col("n_regionkey") == 2, F.concat("n_name", F.lit("!"))).otherwise(F.col("n_name"))))
    found = changelog.changes_between(s, after, "log", 1, "2024-01-01 00:00:00").where("kind = 'property'")
    return found.groupBy("op", "label").agg(F.count("*").alias("n"))


@_query("select event_type, count(*) as n from events group by 1")
def log_processor(spark, sf_dir):
    """A named processor over an appended log gets every change once; started again it gets nothing more."""
    import uuid

    from .operators.olap import checkpointed

    checkpointed(spark.range(1))  # sets the checkpoint folder where the session has none
    root = f"{spark.sparkContext.getCheckpointDir()}/log-{uuid.uuid4().hex}"
    changelog.append(changelog.events_as_changes(spark.read.parquet(f"{sf_dir}/events.parquet")), f"{root}/log")
    for _ in range(2):
        seen = changelog.LogProcessor(spark, f"{root}/log", "events", "counter", f"{root}/marks")
        seen.add(lambda state, batch: state.edges().groupBy("label").count().write.mode("append").parquet(f"{root}/out")).start(once=True).awaitTermination()
    return spark.read.parquet(f"{root}/out").groupBy(F.col("label").alias("event_type")).agg(F.sum("count").alias("n"))


@_query("select n_nationkey, r_name from nation join region on n_regionkey = r_regionkey")
def graphson_round_trip(g):
    """Nations and regions as adjacency JSON, read again as a graph and walked."""
    import uuid

    from .operators.olap import checkpointed
    from .sources.graphson import read_graphson, to_graphson

    checkpointed(g.spark.range(1))
    path = f"{g.spark.sparkContext.getCheckpointDir()}/graphson-{uuid.uuid4().hex}"
    to_graphson(_sub(g, ["nation", "region"], ["in_region"])).write.text(path)
    t = _V(read_graphson(g.spark, path), "nation").as_("n").out("in_region").hasLabel("region").as_("r").select("n", "r", by=["n_nationkey", "r_name"])
    return t.df.select(F.col("_value.n").alias("n_nationkey"), F.col("_value.r").alias("r_name"))


@_query("select count(*) as listed, (select min(n_name) from nation) as first, true as found from region")
def terminals(g):
    """toList, next, tryNext, hasNext and iterate."""
    names = _V(g, "region").values("r_name").toList()
    first = _V(g, "nation").values("n_name").order().by().next()
    found = _V(g, "region").iterate().hasNext() and _V(g, "region").has("r_name", "no such region").tryNext() is None
    return g.spark.createDataFrame([(len(names), first, found)], "listed long, first string, found boolean")
