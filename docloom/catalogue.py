"""Registered queries of the engine over the driver's tables, each with its SQL.

Tables become collections: orders/{o_orderkey}, customer/{c}/orders/{o}, and so
on; ``events`` is read as a change log (seq = event_id, path = users/{user_id},
deleted = error events).
"""

from __future__ import annotations

import datetime as dt
import uuid
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import errors
from .errors import InvalidArgument
from .functions import paths as P
from .functions import values as V
from .operators import changes, lookup, mutate, transforms, vector
from .operators.numbering import numbered
from .plans import explain as explain_plan
from .plans import page as pages
from .plans.analyze import analyze
from .plans.build import expand_projection, filtered, limit_to_last, sort_keys
from .plans.filters import compile_filter
from .plans.model import (
    CONTAINS, CONTAINS_ANY, ENTITY, EQ, GE, GT, HAS_ANCESTOR, IN, IS_NAN, IS_NOT_NAN, IS_NOT_NULL, IS_NULL, KEY, LE, LT, NAME, NE, NOT_IN,
    Avg, Count, Cursor, Nearest, Order, Query, Selector, Sum, Where, all_of, any_of,
)
from .sources import indexes, oplog, wire
from .sources.database import PATH, Collection, Database
from .sources.shared import shared_dir
from .sources.store import Store
from .streaming import watch

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(f):
        QUERIES[name] = f
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return add


def t(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def db_of(spark: SparkSession, sf_dir: str, *names: str) -> Database:
    """The tables as top-level collections named after them."""
    keys = {"region": "r_regionkey", "nation": "n_nationkey", "customer": "c_custkey", "supplier": "s_suppkey", "part": "p_partkey", "orders": "o_orderkey", "events": "event_id", "documents": "doc_id", "embeddings": "vec_id", "pages": "page_id", "benchmark": "item_id"}
    db = Database(spark)
    for n in names:
        db.register(n, t(spark, sf_dir, n), key=keys[n])
    return db


def derived(spark: SparkSession, sf_dir: str) -> Database:
    """Orders with holes: price missing for keys divisible by 7, NaN by 5; a nullable tag; a struct, a point, bytes, a reference, an array."""
    o = t(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    df = o.select(
        "o_orderkey", "o_custkey", "o_orderstatus",
        F.when(k % 7 == 0, F.lit(None)).when(k % 5 == 0, F.lit(float("nan"))).otherwise(F.col("o_totalprice")).cast("double").alias("price"),
        F.when(k % 3 == 0, F.lit(None)).otherwise(F.col("o_orderstatus")).alias("tag"),
        F.struct((k % 3).cast("int").alias("x"), (k % 2).cast("int").alias("y")).alias("coord"),
        F.struct((k % 4).cast("double").alias("lat"), (k % 3).cast("double").alias("lng")).alias("loc"),
        F.encode(F.col("o_orderstatus"), "UTF-8").alias("data"),
        F.concat(F.lit("customer/"), F.col("o_custkey").cast("string")).alias("ref"),
        F.array((k % 3).cast("int"), (k % 5).cast("int")).alias("nums"),
        "o_orderdate",
    )
    db = Database(spark)
    db.register("orders", df, key="o_orderkey", nulls=frozenset({"tag"}))
    return db


D = "(select *, case when o_orderkey % 7 = 0 then null when o_orderkey % 5 = 0 then 'nan'::double else o_totalprice end as price, case when o_orderkey % 3 = 0 then null else o_orderstatus end as tag from orders) d"
OF_ORDERS = (Selector("orders"),)


def find(name: str, where, sql_where: str, *, entity: bool = False, db=None, table: str = D, cols: str = "o_orderkey"):
    """A filter over derived orders that returns keys."""

    @query(name, f"select {cols} from {table} where {sql_where}")
    def run(spark, sf_dir):
        q = Query(OF_ORDERS, where=where, flavour=ENTITY if entity else "document")
        return (db or derived)(spark, sf_dir).query(q).select(*cols.split(", "))


# -- flagship and scans -----------------------------------------------------------------------------------


@query("flagship_top_orders", "select o_orderkey, o_totalprice, o_orderdate from orders where o_orderstatus = 'F' and o_totalprice > 100000 order by o_totalprice desc, o_orderkey limit 10")
def flagship(spark, sf_dir):
    q = Query(OF_ORDERS, where=all_of(Where("o_orderstatus", EQ, "F"), Where("o_totalprice", GT, 100000)), order=(Order("o_totalprice", True),), limit=10)
    return db_of(spark, sf_dir, "orders").query(q).select("o_orderkey", "o_totalprice", "o_orderdate")


@query("scan_collection", "select * from nation")
def scan_collection(spark, sf_dir):
    return db_of(spark, sf_dir, "nation").query(Query((Selector("nation"),))).drop(PATH)


def hierarchy(spark, sf_dir) -> Database:
    """region/{r}/nation/{n}/customer/{c}/orders/{o}."""
    r, n, c, o = (t(spark, sf_dir, x) for x in ("region", "nation", "customer", "orders"))
    db = Database(spark)
    db.register("region", r, key="r_regionkey")
    db.register("nation", n, key="n_nationkey", parent=(("region", "n_regionkey"),))
    customers = c.join(n, c.c_nationkey == n.n_nationkey)
    db.register("customer", customers.select(*c.columns, "n_nationkey", "n_regionkey"), key="c_custkey", parent=(("region", "n_regionkey"), ("nation", "n_nationkey")))
    orders = o.join(customers, o.o_custkey == customers.c_custkey).select(*o.columns, "c_custkey", "n_nationkey", "n_regionkey")
    db.register("orders", orders, key="o_orderkey", parent=(("region", "n_regionkey"), ("nation", "n_nationkey"), ("customer", "c_custkey")))
    return db


HIER = "('region/' || n_regionkey || '/nation/' || n_nationkey || '/customer/' || c_custkey || '/orders/' || o_orderkey)"
HIER_FROM = "from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey"


@query("scan_collection_group", f"select {HIER} as path, o_totalprice {HIER_FROM} where starts_with({HIER}, 'region/1/')")
def scan_collection_group(spark, sf_dir):
    q = Query((Selector("orders", True),), parent="region/1")
    return hierarchy(spark, sf_dir).query(q).select(F.col(PATH).alias("path"), "o_totalprice")


@query("scan_kindless", "select 'region/' || r_regionkey as path, 'region' as collection from region union all select 'nation/' || n_nationkey, 'nation' from nation union all select 'supplier/' || s_suppkey, 'supplier' from supplier")
def scan_kindless(spark, sf_dir):
    return db_of(spark, sf_dir, "region", "nation", "supplier").kindless().withColumnRenamed(PATH, "path")


@query("scan_kindless_query", "select path, row_number() over (order by path)::int as place from (select path from (select 'region/' || r_regionkey as path from region union all select 'nation/' || n_nationkey from nation union all select 'supplier/' || s_suppkey from supplier) order by path limit 40)")
def scan_kindless_query(spark, sf_dir):
    """Documents of all collections as one ordered result."""
    q = Query((Selector("", True),), order=(Order(NAME),), limit=40)
    got = db_of(spark, sf_dir, "region", "nation", "supplier").query(q)
    return got.select(F.col(PATH).alias("path"), F.row_number().over(W.orderBy(PATH)).alias("place"))


@query("scan_kindless_filter", "select 'supplier/' || s_suppkey as path, s_acctbal as balance from supplier where s_acctbal > 5000")
def scan_kindless_filter(spark, sf_dir):
    """A field that only some collections have; values of all types in one form."""
    q = Query((Selector("", True),), where=Where("s_acctbal", GT, 5000))
    got = db_of(spark, sf_dir, "region", "nation", "supplier").query(q)
    return got.select(F.col(PATH).alias("path"), F.col("fields")["s_acctbal"]["key"]["num"].alias("balance"))


@query("ds_kindless_is_empty", "select 0::bigint as n")
def ds_kindless_is_empty(spark, sf_dir):
    return db_of(spark, sf_dir, "region", "nation").query(Query((Selector("", True),), flavour=ENTITY)).agg(F.count(F.lit(1)).alias("n"))


@query("scan_multi_from", "select * from (select 'nation/' || n_nationkey as path from nation order by 1 limit 5) union all select * from (select 'supplier/' || s_suppkey from supplier order by 1 limit 5)")
def scan_multi_from(spark, sf_dir):
    q = Query((Selector("nation"), Selector("supplier")), limit=5, select=(NAME,))
    return db_of(spark, sf_dir, "nation", "supplier").query(q).withColumnRenamed(PATH, "path")


def of_customers(spark, sf_dir) -> Database:
    db = Database(spark)
    db.register("orders", t(spark, sf_dir, "orders"), key="o_orderkey", parent=(("customer", "o_custkey"),))
    return db


@query("kind_ancestor", "select o_orderkey, o_totalprice from orders where o_custkey = 42")
def kind_ancestor(spark, sf_dir):
    q = Query((Selector("orders", True),), where=Where(KEY, HAS_ANCESTOR, "customer/42"), flavour=ENTITY)
    return of_customers(spark, sf_dir).query(q).select("o_orderkey", "o_totalprice")


@query("scan_child_collection", "select o_orderkey from orders where o_custkey = 7")
def scan_child_collection(spark, sf_dir):
    """The collection below one parent: its key reaches the scan."""
    return of_customers(spark, sf_dir).query(Query((Selector("orders"),), parent="customer/7")).select("o_orderkey")


@query("filter_child_names", "select o_orderkey from orders where (o_custkey = 7 and o_orderkey in (select max(o_orderkey) from orders where o_custkey = 7)) or false")
def filter_child_names(spark, sf_dir):
    key = t(spark, sf_dir, "orders").where("o_custkey = 7").agg(F.max("o_orderkey")).first()[0]
    names = ["customer/7/orders/" + str(key), "customer/7/orders/x", "customer/8", "customer/07/orders/" + str(key)]
    return of_customers(spark, sf_dir).query(Query((Selector("orders", True),), where=Where(NAME, IN, names))).select("o_orderkey")


@query("namespace_isolation", "select p_partkey from part where 'ns' || (p_partkey % 3) = 'ns1' and p_size > 10")
def namespace_isolation(spark, sf_dir):
    parts = t(spark, sf_dir, "part").withColumn("namespace", F.concat(F.lit("ns"), (F.col("p_partkey") % 3).cast("string")))
    spaces = {}
    for ns in ("ns0", "ns1", "ns2"):
        spaces[ns] = Database(spark, namespace=ns)
        spaces[ns].register("part", parts.where(F.col("namespace") == ns), key="p_partkey")
    return spaces["ns1"].query(Query((Selector("part"),), where=Where("p_size", GT, 10), flavour=ENTITY)).select("p_partkey")


@query("database_isolation", "select 'a' as db, count(*) as n from orders where o_orderkey % 2 = 0 union all select 'b', count(*) from orders where o_orderkey % 2 = 1")
def database_isolation(spark, sf_dir):
    out = []
    for name, bit in (("a", 0), ("b", 1)):
        db = Database(spark, name=name)
        db.register("orders", t(spark, sf_dir, "orders").where(F.col("o_orderkey") % 2 == bit), key="o_orderkey")
        out.append(db.aggregate(Query(OF_ORDERS), [Count("n")]).select(F.lit(name).alias("db"), "n"))
    return out[0].unionByName(out[1])


@query("point_get", "select o_orderkey, o_totalprice from orders where o_orderkey = 7")
def point_get(spark, sf_dir):
    return db_of(spark, sf_dir, "orders").get("orders/7", ["o_orderkey", "o_totalprice"]).drop(PATH)


@query("batch_get_found_missing", "select 'labels/' || i as path, l.doc_id is not null as found, toxic from range(0, 100, 3) r(i) left join labels l on l.doc_id = i")
def batch_get(spark, sf_dir):
    db = Database(spark)
    c = db.register("labels", t(spark, sf_dir, "labels"), key="doc_id")
    request = lookup.keys_frame(spark, [f"labels/{i}" for i in range(0, 100, 3)] + ["labels/3"])
    return lookup.batch_get(c.df, request).select(F.col(PATH).alias("path"), "found", "toxic")


@query("lookup_found", "select doc_id from documents where doc_id in (select doc_id from labels)")
def lookup_found(spark, sf_dir):
    c = db_of(spark, sf_dir, "documents").tables["documents"][0]
    request = t(spark, sf_dir, "labels").select(F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias(PATH))
    return lookup.lookup(c.df, request)[0].select("doc_id")


@query("lookup_missing", "select 'labels/' || doc_id as path from documents where doc_id not in (select doc_id from labels)")
def lookup_missing(spark, sf_dir):
    labels = t(spark, sf_dir, "labels").select(F.concat(F.lit("labels/"), F.col("doc_id").cast("string")).alias(PATH))
    request = t(spark, sf_dir, "documents").select(F.concat(F.lit("labels/"), F.col("doc_id").cast("string")).alias(PATH))
    return lookup.lookup(labels, request)[1].withColumnRenamed(PATH, "path")


@query("list_documents_page2", "select 'orders/' || o_orderkey as path from orders where 'orders/' || o_orderkey > (select max(p) from (select 'orders/' || o_orderkey as p from orders order by p limit 300)) order by 1 limit 300")
def list_page2(spark, sf_dir):
    c = db_of(spark, sf_dir, "orders").tables["orders"][0]
    token = lookup.next_token(lookup.list_documents(c.df.select(PATH)), lookup.PAGE)
    return lookup.list_documents(c.df.select(PATH), token=token).withColumnRenamed(PATH, "path")


@query("list_show_missing", "select 'customer/' || c_custkey as path, false as missing from customer where c_custkey % 2 = 0 union all select distinct 'customer/' || o_custkey, true from orders where o_custkey not in (select c_custkey from customer where c_custkey % 2 = 0)")
def list_show_missing(spark, sf_dir):
    some = t(spark, sf_dir, "customer").where("c_custkey % 2 = 0").select(F.concat(F.lit("customer/"), F.col("c_custkey").cast("string")).alias(PATH))
    below = of_customers(spark, sf_dir).tables["orders"][0].df.select(PATH)
    return lookup.with_missing(some, below, "", "customer").withColumnRenamed(PATH, "path")


@query("list_collection_ids", "select 'orders' as collection where exists (select 1 from orders where o_custkey = 1) union select 'notes'")
def list_collection_ids(spark, sf_dir):
    orders = of_customers(spark, sf_dir).tables["orders"][0].df.select(PATH)
    notes = t(spark, sf_dir, "customer").select(F.concat(F.lit("customer/"), F.col("c_custkey").cast("string"), F.lit("/notes/1")).alias(PATH))
    return lookup.collection_ids(orders.unionByName(notes), "customer/1")


@query("content_statistics", "select 'orders' as table_name, count(*) as n_rows from orders union all select 'part', count(*) from part union all select 'events', count(*) from events")
def content_statistics(spark, sf_dir):
    return indexes.statistics({n: t(spark, sf_dir, n) for n in ("orders", "part", "events")})


@query("oplog_search", "select event_id, event_type, value from events where contains(lower(event_type), 'err') and value >= 10 order by event_id desc limit 100")
def oplog_search(spark, sf_dir):
    return oplog.search(t(spark, sf_dir, "events"), contains={"event_type": "ERR"}, least={"value": 10}).select("event_id", "event_type", "value")


@query("oplog_metrics", "select event_type, count(*) as calls, sum((value < 10)::int)::bigint as failures, round(avg(value), 6) as mean_value, max(value) as most_value from events group by 1")
def oplog_metrics(spark, sf_dir):
    return oplog.metrics(t(spark, sf_dir, "events"), "event_type", "value", F.col("value") < 10).withColumn("mean_value", F.round("mean_value", 6))


@query("oplog_latest", "select event_id, event_type from events order by event_id desc limit 60")
def oplog_latest(spark, sf_dir):
    return oplog.snapshot(t(spark, sf_dir, "events"), "event_type", "value", F.col("value") < 10)[1].select("event_id", "event_type")


@query("wire_roundtrip", "select o_orderkey, o_totalprice, o_orderstatus from orders where o_totalprice > 250000")
def wire_roundtrip(spark, sf_dir):
    """Encode documents to wire JSON, decode them again, filter on a decoded value."""
    o = t(spark, sf_dir, "orders")
    name = P.resource_name("p", "(default)", F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")))
    sent = o.select(wire.encode(o, name, ["o_orderkey", "o_totalprice", "o_orderstatus"]).alias("json"))
    db = Database(spark)
    db.register("orders", wire.decode(sent), path=F.regexp_extract("name", "documents/(.*)$", 1), prefix="orders")
    hit = db.query(Query(OF_ORDERS, where=Where("o_totalprice", GT, 250000)))
    value = lambda f: F.col("fields")[f]
    return hit.select(value("o_orderkey")["int"].alias("o_orderkey"), value("o_totalprice")["key"]["num"].alias("o_totalprice"), value("o_orderstatus")["key"]["text"].alias("o_orderstatus"))


@query("wire_all_types", """
select o_orderkey, case when o_orderkey % 3 = 0 then true end as tag_is_null, (o_orderkey % 3)::bigint as x, (o_orderkey % 4)::double as lat, o_orderstatus as data, 'customer/' || o_custkey as ref, (o_orderkey % 5)::bigint as second,
  case when o_orderkey % 7 = 0 then null when o_orderkey % 5 = 0 then 0 else 1 end as real, epoch_us(o_orderdate)::bigint as us, o_orderkey % 2 = 0 as even, 2::int as dims, ((o_orderkey % 10) / 4.0)::double as dim2, true as same from orders""")
def wire_all_types(spark, sf_dir):
    """Documents with values of all types to wire JSON, back, and to the same JSON again."""
    o = derived(spark, sf_dir).tables["orders"][0].df
    o = wire.spread(o).withColumn("even", F.col("o_orderkey") % 2 == 0).withColumn("vec", F.array(F.lit(0.5), (F.col("o_orderkey") % 10) / F.lit(4.0)))
    columns = ["o_orderkey", "price", "tag", "coord", "loc", "data", "ref", "nums", "o_orderdate", "even", "vec"]
    sent = o.select(wire.encode(o, F.col(PATH), columns, roles={"loc": "geo", "ref": "reference", "vec": "vector"}, nulls=frozenset({"tag"})).alias("json"))
    both = wire.decode(sent, keep=("json",))
    f = lambda n: F.col("fields")[n]["key"]
    ref = F.array_join(F.transform(f("ref")["ref"], lambda s: s["text"]), "/")
    equal = wire.encode_fields(F.col("name"), F.col("fields")) == F.col("json")
    return both.select(
        F.col("fields")["o_orderkey"]["int"].alias("o_orderkey"), F.when(f("tag")["rank"] == V.NULL, True).alias("tag_is_null"), f("coord")["items"][0]["exact"].alias("x"), f("loc")["lat"].alias("lat"), f("data")["bin"].cast("string").alias("data"), ref.alias("ref"),
        f("nums")["items"][1]["exact"].alias("second"), f("price")["real"].alias("real"), F.unix_micros(f("o_orderdate")["ts"]).alias("us"), (f("even")["real"] == 1).alias("even"), f("vec")["size"].alias("dims"), f("vec")["items"][1]["num"].alias("dim2"), equal.alias("same"),
    )


@query("field_index_by_field", "select field, in_array, rank, count(*) as n from (select 'w' as field, false as in_array, 2 as rank from orders union all select 'v', false, rank from " + "(select case o_orderkey % 6 when 5 then 0 when 3 then 1 when 1 then 2 when 4 then 2 when 2 then 4 end as rank from orders) where rank is not null) group by all")
def field_index_by_field(spark, sf_dir):
    return indexes.field_index(mixed(spark, sf_dir).tables["orders"][0].df).groupBy("field", "in_array", "rank").agg(F.count(F.lit(1)).alias("n"))


@query("field_index_rows", "select in_array, count(*) as n from (select false as in_array from part union all select true from (select unnest(string_split(p_name, ' ')) from part)) group by 1")
def field_index_rows(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    kind = V.VALUE
    words = F.split("p_name", " ")
    none = V.literal([])
    items = F.transform(words, lambda w: F.struct(F.lit("").alias("name"), *[(F.lit(V.STRING) if n == "rank" else w if n == "text" else F.lit(None)).alias(n) for n in ("rank", "real", "num", "exact", "ts", "text", "bin", "ref", "lat", "lng")], F.lit(None).cast("string").alias("json")))
    key = none["key"].withField("items", items)
    fields = F.map_from_arrays(F.array(F.lit("size"), F.lit("words")), F.array(V.lift(F.col("p_size"), "int"), F.struct(key.cast(V.KEY).alias("key"), F.lit(None).cast("long").alias("int"), F.lit(None).cast("string").alias("json")).cast(kind)))
    db = Database(spark)
    c = db.register("part", p.select("p_partkey", fields.alias("fields")), key="p_partkey")
    return indexes.field_index(c.df).groupBy("in_array").agg(F.count(F.lit(1)).alias("n"))


# -- projections ------------------------------------------------------------------------------------------


@query("project_fields", "select o_orderkey, o_totalprice from orders")
def project_fields(spark, sf_dir):
    return db_of(spark, sf_dir, "orders").query(Query(OF_ORDERS, select=("o_orderkey", "o_totalprice", "absent"))).drop(PATH)


@query("project_nested", "select event_id, json_extract_string(props, '$.k')::int as k from events where event_type = 'click'")
def project_nested(spark, sf_dir):
    e = t(spark, sf_dir, "events").withColumn("p", F.from_json("props", "k int, z int"))
    db = Database(spark)
    db.register("events", e, key="event_id")
    got = db.query(Query((Selector("events"),), where=Where("event_type", EQ, "click"), select=("event_id", "p.k")))
    return got.select("event_id", "p.k")


@query("project_quoted_path", "select o_orderkey, o_totalprice as price from orders where o_totalprice > 200000")
def project_quoted_path(spark, sf_dir):
    """A field whose name holds a dot and a backtick."""
    db = Database(spark)
    db.register("orders", t(spark, sf_dir, "orders").select("o_orderkey", F.col("o_totalprice").alias("total.price")), key="o_orderkey")
    got = db.query(Query(OF_ORDERS, where=Where("`total.price`", GT, 200000), select=("o_orderkey", P.format_field_path(["total.price"]))))
    return got.select("o_orderkey", F.col("`total.price`").alias("price"))


@query("field_paths", "select * from (values ('a.b', 'a|b'), ('`a.b`.c', 'a.b|c'), ('`x\\`y`', 'x`y'), ('a..b', null), ('`a', null), ('', null), ('a.', null)) v(path, segments)")
def field_paths(spark, sf_dir):
    def parsed(p):
        try:
            return "|".join(P.parse_field_path(p))
        except InvalidArgument:
            return None

    texts = ["a.b", "`a.b`.c", "`x\\`y`", "a..b", "`a", "", "a."]
    return spark.createDataFrame([(p, parsed(p)) for p in texts], "path string, segments string")


@query("keys_only", "select 'orders/' || o_orderkey as path from orders where o_orderstatus = 'O'")
def keys_only(spark, sf_dir):
    return db_of(spark, sf_dir, "orders").query(Query(OF_ORDERS, where=Where("o_orderstatus", EQ, "O"), select=(NAME,))).withColumnRenamed(PATH, "path")


@query("project_expand_array", "select p_partkey, unnest(string_split(p_name, ' ')) as word from (select * from part order by p_partkey limit 50)")
def project_expand_array(spark, sf_dir):
    db = Database(spark)
    db.register("part", t(spark, sf_dir, "part").withColumn("word", F.split("p_name", " ")), key="p_partkey")
    page = db.query(Query((Selector("part"),), order=(Order("p_partkey"),), limit=50, flavour=ENTITY))
    return expand_projection(page, ["p_partkey", "word"])


# -- filters ----------------------------------------------------------------------------------------------

for _name, _op, _sql in (("eq", EQ, "="), ("lt", LT, "<"), ("le", LE, "<="), ("gt", GT, ">"), ("ge", GE, ">=")):
    find(f"filter_{_name}", Where("price", _op, 150000.25 if _op != EQ else float("inf")) if _op != EQ else Where("o_orderstatus", EQ, "P"), f"price {_sql} 150000.25 and not isnan(price)" if _op != EQ else "o_orderstatus = 'P'")
find("filter_ne", Where("tag", NE, "F"), "tag is not null and tag <> 'F'")
find("filter_in", Where("o_orderstatus", IN, ["P", "F"]), "o_orderstatus in ('P', 'F')")
find("filter_not_in", Where("tag", NOT_IN, ["P", "F"]), "tag is not null and tag not in ('P', 'F')")
find("filter_is_null", Where("tag", IS_NULL), "tag is null")
find("filter_is_not_null", Where("price", IS_NOT_NULL), "price is not null")
find("filter_is_nan", Where("price", IS_NAN), "isnan(price)")
find("filter_is_not_nan", Where("price", IS_NOT_NAN), "price is not null and not isnan(price)")
find("filter_nan_literal_in", Where("price", IN, [float("nan"), -1.0]), "isnan(price)")
find("filter_nan_literal_ne", Where("price", NE, float("nan")), "price is not null and not isnan(price)")
find("filter_and_or_nested", any_of(all_of(Where("o_orderstatus", EQ, "F"), Where("price", GT, 200000)), all_of(Where("tag", EQ, "P"), Where("price", IS_NAN)), Where("price", LT, 2000)), "(o_orderstatus = 'F' and price > 200000 and not isnan(price)) or (tag = 'P' and isnan(price)) or (price < 2000)")
find("filter_struct_eq", Where("coord", EQ, {"x": 1, "y": 0}), "o_orderkey % 3 = 1 and o_orderkey % 2 = 0")
find("filter_geo_eq", Where("loc", EQ, V.Geo(2.0, 1.0)), "o_orderkey % 4 = 2 and o_orderkey % 3 = 1")
find("filter_array_eq", Where("nums", EQ, [1, 4]), "o_orderkey % 3 = 1 and o_orderkey % 5 = 4")
find("filter_bytes", Where("data", GT, b"F"), "o_orderstatus > 'F'")
find("filter_reference", Where("ref", EQ, V.Ref("customer/42")), "o_custkey = 42")
find("filter_timestamp_range", all_of(Where("o_orderdate", GE, dt.datetime(1995, 1, 1)), Where("o_orderdate", LT, dt.datetime(1996, 1, 1))), "o_orderdate >= timestamp '1995-01-01' and o_orderdate < timestamp '1996-01-01'")
find("filter_nested_field", Where("coord.x", EQ, 2), "o_orderkey % 3 = 2")
find("filter_key_in", Where(NAME, IN, ["orders/5", "orders/77", "orders/999999999"]), "o_orderkey in (5, 77)")
find("ds_key_eq", Where(KEY, EQ, "orders/7"), "o_orderkey = 7", entity=True)
find("ds_key_in", Where(KEY, IN, ["orders/5", "orders/x", "orders/77"]), "o_orderkey in (5, 77)", entity=True)
find("ds_key_range", all_of(Where(KEY, GT, "orders/98"), Where(KEY, LE, "orders/99")), "'orders/' || o_orderkey > 'orders/98' and 'orders/' || o_orderkey <= 'orders/99'", entity=True)
find("ds_key_ne", Where(KEY, NE, "orders/7"), "o_orderkey <> 7", entity=True)
find("ds_embedded_eq", Where("coord", EQ, {"x": 1, "y": 0}), "o_orderkey % 3 = 1 and o_orderkey % 2 = 0", entity=True)
find("filter_vector_eq", Where("nums", EQ, V.Vector((1, 4))), "o_orderkey % 3 = 1 and o_orderkey % 5 = 4")
find("filter_name_range", all_of(Where(NAME, GE, "orders/12"), Where(NAME, LT, "orders/13")), "'orders/' || o_orderkey >= 'orders/12' and 'orders/' || o_orderkey < 'orders/13'")
find("ds_ne_includes_missing", Where("tag", NE, "F"), "tag is null or tag <> 'F'", entity=True)
find("ds_not_in_includes_missing", Where("tag", NOT_IN, ["F", "P"]), "tag is null or tag not in ('F', 'P')", entity=True)
find("ds_array_any_equal", Where("nums", EQ, 4), "o_orderkey % 5 = 4", entity=True)
find("ds_array_any_range", Where("nums", GE, 3), "o_orderkey % 5 >= 3", entity=True)
find("filter_array_contains", Where("nums", CONTAINS, 2), "o_orderkey % 3 = 2 or o_orderkey % 5 = 2")
find("filter_array_contains_any", Where("nums", CONTAINS_ANY, [3, 4]), "o_orderkey % 5 in (3, 4)")


@query("filter_int_double_cross", "select count(*) as n from lineitem where l_linenumber > 2.5 and l_quantity = 17")
def filter_int_double_cross(spark, sf_dir):
    db = Database(spark)
    db.register("lineitem", t(spark, sf_dir, "lineitem"), key="l_orderkey")
    return db.aggregate(Query((Selector("lineitem"),), where=all_of(Where("l_linenumber", GT, 2.5), Where("l_quantity", EQ, 17))), [Count("n")])


def counts(db, wheres: dict, **kw) -> DataFrame:
    """How many documents each filter leaves, in one pass over the collection."""
    (c,) = db.tables_of(OF_ORDERS[0])
    return c.df.agg(*[F.count_if(compile_filter(w, c, kw.get("flavour", "document"))).alias(n) for n, w in wheres.items()])


@query("filter_empty_lists", "select 0::bigint as in_empty, 0::bigint as not_in_null, count(*) as not_in_empty from orders")
def filter_empty_lists(spark, sf_dir):
    return counts(db_of(spark, sf_dir, "orders"), {"in_empty": Where("o_orderstatus", IN, []), "not_in_null": Where("o_orderstatus", NOT_IN, ["F", None]), "not_in_empty": Where("o_orderstatus", NOT_IN, [])})


def unindexed(spark, sf_dir) -> Database:
    db = Database(spark)
    db.register("orders", t(spark, sf_dir, "orders"), key="o_orderkey", unindexed=frozenset({"o_orderpriority"}))
    return db


@query("ds_unindexed_property", "select 0::bigint as by_unindexed, count(*) as by_status from orders where o_orderstatus = 'F'")
def ds_unindexed(spark, sf_dir):
    return counts(unindexed(spark, sf_dir), {"by_unindexed": Where("o_orderpriority", NE, "x"), "by_status": Where("o_orderstatus", EQ, "F")}, flavour=ENTITY)


def with_arrays(spark, sf_dir) -> Database:
    """``v`` is null, an array that holds a null, an array of arrays, or absent."""
    k = F.col("o_orderkey")
    null = V.literal(None)
    held, deep = V.lift_any(F.array(F.lit(None).cast("long"), k), T.ArrayType(T.LongType())), V.lift_any(F.array(F.array(k)), T.ArrayType(T.ArrayType(T.LongType())))
    fields = F.when(k % 4 == 3, F.create_map().cast(f"map<string,{V.VALUE}>")).otherwise(F.create_map(F.lit("v"), F.when(k % 4 == 0, null).when(k % 4 == 1, held).otherwise(deep)))
    db = Database(spark)
    db.register("orders", t(spark, sf_dir, "orders").select("o_orderkey", fields.alias("fields")), key="o_orderkey")
    return db


find("array_with_null_is_not_null", Where("v", IS_NULL), "o_orderkey % 4 = 0", db=with_arrays, table="orders")
find("array_of_arrays_is_present", Where("v", IS_NOT_NULL), "o_orderkey % 4 in (1, 2)", db=with_arrays, table="orders")
find("dynamic_array_contains", Where("v", CONTAINS, 5), "o_orderkey = 5", db=with_arrays, table="orders")


# -- order, limits, cursors -------------------------------------------------------------------------------


def placed(rows: DataFrame, q: Query, c: Collection) -> DataFrame:
    """The rows of a limited result with their place in its order (a page is small)."""
    keys = [k for o in analyze(q).order for k in sort_keys(o, replace(c, df=rows), q.flavour)]
    return rows.withColumn("place", F.row_number().over(W.orderBy(*keys)))


def page(name: str, q: Query, sql: str, cols: tuple = ("o_orderkey",), db=derived):
    @query(name, sql)
    def run(spark, sf_dir):
        held = db(spark, sf_dir)
        return placed(held.query(q), q, held.tables["orders"][0]).select(*cols, "place")


def _ranked(order: str, limit: str, where: str = "true", cols: str = "o_orderkey", table: str = D) -> str:
    return f"select {cols}, row_number() over (order by {order})::int as place from (select * from {table} where {where} order by {order} {limit})"


BY_PATH = "'orders/' || o_orderkey"
NAN_FIRST = "case when price is null then 0 when isnan(price) then 1 else 2 end"
page("order_multi", Query(OF_ORDERS, order=(Order("o_orderstatus"), Order("o_custkey", True)), limit=40), _ranked(f"o_orderstatus, o_custkey desc, {BY_PATH} desc", "limit 40"))
page("order_nan_first", Query(OF_ORDERS, order=(Order("price"),), limit=700), _ranked(f"{NAN_FIRST}, price, {BY_PATH}", "limit 700", "price is not null"))
page("order_desc_nulls", Query(OF_ORDERS, order=(Order("tag", True),), limit=50, offset=9_000), _ranked(f"tag desc nulls last, {BY_PATH} desc", "limit 50 offset 9000"))
page("order_implicit_inequality", Query(OF_ORDERS, where=all_of(Where("price", GT, 1000), Where("o_custkey", LT, 100)), limit=30), _ranked(f"o_custkey, price, {BY_PATH}", "limit 30", "price > 1000 and not isnan(price) and o_custkey < 100"))
page("orderby_requires_field", Query(OF_ORDERS, order=(Order("price", True),), limit=25), _ranked(f"{NAN_FIRST} desc, price desc, {BY_PATH} desc", "limit 25", "price is not null"))
page("limit_offset", Query(OF_ORDERS, order=(Order("o_custkey"),), limit=20, offset=35), _ranked(f"o_custkey, {BY_PATH}", "limit 20 offset 35"))
page("ds_order_default", Query(OF_ORDERS, where=Where("o_orderstatus", EQ, "P"), limit=20, flavour=ENTITY), _ranked(BY_PATH, "limit 20", "o_orderstatus = 'P'"))

START = Cursor((150000.0,), True)
for _n, _kw, _w in (
    ("start_at", {"start": START}, "o_totalprice >= 150000"),
    ("start_after", {"start": Cursor((150000.0,), False)}, "o_totalprice > 150000"),
    ("end_at", {"end": Cursor((20000.0,), False)}, "o_totalprice <= 20000"),
    ("end_before", {"end": Cursor((20000.0,), True)}, "o_totalprice < 20000"),
):
    page(f"cursor_{_n}", Query(OF_ORDERS, order=(Order("o_totalprice"),), limit=30, **_kw), _ranked(f"o_totalprice, {BY_PATH}", "limit 30", _w, table="orders"), db=lambda s, d: db_of(s, d, "orders"))
page("cursor_desc", Query(OF_ORDERS, order=(Order("o_totalprice", True),), start=Cursor((150000.0,), False), end=Cursor((149000.0,), True), limit=30), _ranked(f"o_totalprice desc, {BY_PATH} desc", "limit 30", "o_totalprice < 150000 and o_totalprice > 149000", table="orders"), db=lambda s, d: db_of(s, d, "orders"))
page("cursor_multi_field", Query(OF_ORDERS, order=(Order("o_orderstatus"), Order("o_custkey", True)), start=Cursor(("O", 700, "orders/5"), True), limit=30), _ranked(f"o_orderstatus, o_custkey desc, {BY_PATH} desc", "limit 30", f"o_orderstatus > 'O' or (o_orderstatus = 'O' and (o_custkey < 700 or (o_custkey = 700 and {BY_PATH} <= 'orders/5')))"))
page("keyset_page_ds", Query(OF_ORDERS, order=(Order("o_custkey"),), start=Cursor((30, "orders/2"), False), limit=25, flavour=ENTITY), _ranked(f"o_custkey, {BY_PATH}", "limit 25", f"o_custkey > 30 or (o_custkey = 30 and {BY_PATH} > 'orders/2')"))
page("keyset_null_tail", Query(OF_ORDERS, order=(Order("tag", True),), start=Cursor((None, "orders/5000"), False), limit=25), _ranked(f"tag desc nulls last, {BY_PATH} desc", "limit 25", f"tag is null and {BY_PATH} < 'orders/5000'"))
page("ds_path_cursor", Query(OF_ORDERS, start=Cursor(("orders/200",), False), limit=15, flavour=ENTITY), _ranked(BY_PATH, "limit 15", f"{BY_PATH} > 'orders/200'"))


page("ds_end_cursor", Query(OF_ORDERS, order=(Order("o_custkey"),), start=Cursor((30,), True), end=Cursor((33,), True), flavour=ENTITY), _ranked(f"o_custkey, {BY_PATH}", "", "o_custkey >= 30 and o_custkey < 33"))
page("ds_order_by_key_desc", Query(OF_ORDERS, where=Where("o_orderstatus", EQ, "P"), order=(Order(KEY, True),), limit=30, flavour=ENTITY), _ranked(f"{BY_PATH} desc", "limit 30", "o_orderstatus = 'P'"))


@query("limit_to_last", f"select o_orderkey, row_number() over (order by o_totalprice, {BY_PATH})::int as place from (select * from orders order by o_totalprice desc, {BY_PATH} desc limit 12)")
def limit_last(spark, sf_dir):
    db, q = db_of(spark, sf_dir, "orders"), Query(OF_ORDERS, order=(Order("o_totalprice"),), limit=12)
    return placed(limit_to_last(db, q), q, db.tables["orders"][0]).select("o_orderkey", "place")


@query("limit_zero", "select 0::bigint as entity_rows, count(*) as document_rows from orders")
def limit_zero(spark, sf_dir):
    db = db_of(spark, sf_dir, "orders")
    a = db.aggregate(Query(OF_ORDERS, limit=0, flavour=ENTITY), [Count("entity_rows")])
    return a.join(db.aggregate(Query(OF_ORDERS, limit=0), [Count("document_rows")]))


@query("pagination_full_cover", "select count(*) as n, count(distinct n_nationkey) as ids from nation")
def pagination_full_cover(spark, sf_dir):
    """Pages of ten by keyset cursors cover a collection exactly once (the driver sees only cursors)."""
    db, out, start = db_of(spark, sf_dir, "nation"), None, None
    base = Query((Selector("nation"),), order=(Order("n_regionkey"),), limit=10)
    while True:
        got = db.query(replace(base, start=start))
        last = got.orderBy(F.desc("n_regionkey"), F.desc(PATH)).select("n_regionkey", PATH).first()
        if last is None:
            break
        out = got if out is None else out.unionByName(got)
        start = Cursor((last[0], last[1]), False)
    return out.agg(F.count(F.lit(1)).alias("n"), F.count_distinct("n_nationkey").alias("ids"))


@query("more_results", "select least(count(*), 300) as rows, count(*) >= 300 as more_after_limit from orders where o_orderstatus = 'P'")
def more_results(spark, sf_dir):
    got = db_of(spark, sf_dir, "orders").aggregate(Query(OF_ORDERS, where=Where("o_orderstatus", EQ, "P"), limit=300), [Count("rows")])
    return got.withColumn("more_after_limit", F.col("rows") == 300)


@query("order_virtual_ids", "select o_orderkey, row_number() over (order by (o_orderkey % 2 = 0), case when o_orderkey % 2 = 1 then o_orderkey end, 'k' || o_orderkey)::int as place from (select * from orders order by (o_orderkey % 2 = 0), case when o_orderkey % 2 = 1 then o_orderkey end, 'k' || o_orderkey limit 60 offset (select greatest(count(*) - 30, 0) from orders where o_orderkey % 2 = 1))")
def order_virtual_ids(spark, sf_dir):
    """Numeric ids in disguise sort first and by number, other ids by text."""
    o = t(spark, sf_dir, "orders")
    odd = o.where("o_orderkey % 2 = 1").count()
    k = F.col("o_orderkey").cast("string")
    db = Database(spark)
    path = F.concat(F.lit("orders/"), F.when(F.col("o_orderkey") % 2 == 1, F.concat(F.lit("__id"), k, F.lit("__"))).otherwise(F.concat(F.lit("k"), k)))
    db.register("orders", o, path=path, prefix="orders", virtual_ids=True)
    q = Query(OF_ORDERS, order=(Order(NAME),), limit=60, offset=max(odd - 30, 0))
    return placed(db.query(q), q, db.tables["orders"][0]).select("o_orderkey", "place")


def mixed(spark, sf_dir) -> Database:
    """Orders whose field ``v`` is of a type that depends on the key, absent for keys divisible by 6."""
    o = t(spark, sf_dir, "orders")
    k = F.col("o_orderkey")
    number, text, flag, none = V.lift(F.col("o_totalprice"), "double"), V.lift(F.col("o_orderpriority"), "string"), V.lift(F.col("o_custkey") % 2 == 0, "boolean"), V.literal(None)
    v = F.when(k % 6 == 1, number).when(k % 6 == 2, text).when(k % 6 == 3, flag).when(k % 6 == 4, V.lift(F.col("o_custkey"), "bigint")).otherwise(none)
    db = Database(spark)
    fields = F.map_from_arrays(F.when(k % 6 == 0, F.array(F.lit("w"))).otherwise(F.array(F.lit("w"), F.lit("v"))), F.when(k % 6 == 0, F.array(number)).otherwise(F.array(number, v)))
    db.register("orders", o.select("o_orderkey", fields.alias("fields")), key="o_orderkey")
    return db


MIXED = "(select *, case o_orderkey % 6 when 5 then 0 when 3 then 1 when 1 then 2 when 4 then 2 when 2 then 4 end as rank, case o_orderkey % 6 when 1 then o_totalprice when 4 then o_custkey::double end as num, case o_orderkey % 6 when 2 then o_orderpriority end as txt, case o_orderkey % 6 when 3 then (o_custkey % 2 = 0) end as flag from orders) m"


@query("order_cross_type", _ranked(f"rank, flag, num, txt, {BY_PATH}", "", "rank is not null", table=MIXED))
def order_cross_type(spark, sf_dir):
    """The place of every row: ranks in the order's own keys, range by range."""
    db = mixed(spark, sf_dir)
    (c,) = db.scans(OF_ORDERS[0])
    plan = analyze(Query(OF_ORDERS, order=(Order("v"),)))
    keys = [k.alias(f"_k{i}") for i, k in enumerate((c.value("v")["key"], c.path))]
    return numbered(filtered(plan, c).select("o_orderkey", *keys), ["_k0", "_k1"], 0, "place").select("o_orderkey", F.col("place").cast("int").alias("place"))


page("order_cross_type_top", Query(OF_ORDERS, order=(Order("v"),), limit=500, offset=20), _ranked(f"rank, flag, num, txt, {BY_PATH}", "limit 500 offset 20", "rank is not null", table=MIXED), db=mixed)
page("order_cross_type_desc", Query(OF_ORDERS, order=(Order("v", True),), limit=500), _ranked(f"rank desc, flag desc, num desc, txt desc, {BY_PATH} desc", "limit 500", "rank is not null", table=MIXED), db=mixed)
find("dynamic_range_same_type", Where("v", GE, 500), "rank = 2 and num >= 500", db=mixed, table=MIXED)
find("dynamic_is_null", Where("v", IS_NULL), "rank = 0", db=mixed, table=MIXED)
find("dynamic_not_equal", Where("v", NE, True), "rank > 0 and (flag is null or not flag)", db=mixed, table=MIXED)
find("dynamic_in_mixed", Where("v", IN, [True, "1-URGENT"]), "flag or txt = '1-URGENT'", db=mixed, table=MIXED)


def large_integers(spark, sf_dir) -> Database:
    """Orders with integers beyond 53 bits that differ by one."""
    db = Database(spark)
    big = V.lift(F.lit(1 << 53) + F.col("o_orderkey"), "bigint")
    db.register("orders", t(spark, sf_dir, "orders").select("o_orderkey", F.create_map(F.lit("v"), big).alias("fields")), key="o_orderkey")
    return db


find("dynamic_large_integer_eq", Where("v", EQ, (1 << 53) + 7), "o_orderkey = 7", db=large_integers, table="orders")
find("dynamic_large_integer_range", all_of(Where("v", GT, (1 << 53) + 6), Where("v", LE, (1 << 53) + 9)), "o_orderkey > 6 and o_orderkey <= 9", db=large_integers, table="orders")
page("order_large_integers", Query(OF_ORDERS, order=(Order("v", True),), limit=30), _ranked("o_orderkey desc", "limit 30", table="orders"), db=large_integers)


# -- aggregates -------------------------------------------------------------------------------------------


def total(name: str, sql: str, aggs, where=None, db=None, **kw):
    @query(name, sql)
    def run(spark, sf_dir):
        return (db or derived)(spark, sf_dir).aggregate(Query(OF_ORDERS, where=where, **kw), aggs)


def line_items(spark, sf_dir) -> Database:
    db = Database(spark)
    db.register("orders", t(spark, sf_dir, "lineitem").withColumn("money", F.col("l_extendedprice").cast("decimal(18,2)")), key="l_orderkey")
    return db


total("agg_count", "select count(*) as n from orders where o_orderstatus = 'F'", [Count("n")], Where("o_orderstatus", EQ, "F"))
total("agg_count_upto", "select 300::bigint as n", [Count("n", 300)])
total("agg_sum_int", "select sum(l_suppkey)::bigint as s, count(*) as n from lineitem where l_returnflag = 'R'", [Sum("l_suppkey", "s"), Count("n")], Where("l_returnflag", EQ, "R"), line_items)
total("agg_sum_empty", "select 0::bigint as s, null::double as a, 0::bigint as n", [Sum("o_custkey", "s"), Avg("o_custkey", "a"), Count("n")], Where("o_orderstatus", EQ, "none"))
total("agg_sum_nan", "select 'nan'::double as s, 'nan'::double as a from orders limit 1", [Sum("price", "s"), Avg("price", "a")])
total("agg_avg_nan_ds", "select null::double as a from orders limit 1", [Avg("price", "a")], flavour=ENTITY)
total("agg_limit_ordered", f"select sum(o_custkey)::bigint as s, count(*) as n from (select * from orders order by o_totalprice, {BY_PATH} limit 500)", [Sum("o_custkey", "s"), Count("n")], order=(Order("o_totalprice"),), limit=500, db=lambda s, d: db_of(s, d, "orders"))
total("agg_limit_unordered_ds", "select sum(o_custkey)::bigint as property_1 from (select o_custkey from orders order by o_custkey limit 500)", [Sum("o_custkey")], flavour=ENTITY, limit=500, db=lambda s, d: db_of(s, d, "orders"))
@query("agg_sum_mixed", "select count(*) as n, null::bigint as s_int, round(sum(case o_orderkey % 6 when 1 then o_totalprice when 4 then o_custkey end::decimal(18,2))::double, 2) as s from orders where o_orderkey % 6 <> 0")
def agg_sum_mixed(spark, sf_dir):
    return mixed(spark, sf_dir).aggregate(Query(OF_ORDERS), [Count("n"), Sum("v", "s")]).withColumn("s", F.round("s", 2))


@query("agg_sum_dynamic_int", "select sum(o_custkey)::bigint as s_int, sum(o_custkey)::double as s from orders where o_orderkey % 6 = 4")
def agg_sum_dynamic_int(spark, sf_dir):
    """All of the values that a filter leaves are integers: the sum is one."""
    db = mixed(spark, sf_dir)
    c = db.tables["orders"][0]
    db.tables["orders"][0] = replace(c, df=c.df.where(F.col("fields")["v"]["int"].isNotNull()))
    return db.aggregate(Query(OF_ORDERS), [Sum("v", "s")])


@query("agg_avg", "select round(avg(l_quantity), 6) as a, round(avg(l_discount), 6) as b from lineitem where l_linestatus = 'O'")
def agg_avg(spark, sf_dir):
    got = line_items(spark, sf_dir).aggregate(Query(OF_ORDERS, where=Where("l_linestatus", EQ, "O")), [Avg("l_quantity", "a"), Avg("l_discount", "b")])
    return got.select(F.round("a", 6).alias("a"), F.round("b", 6).alias("b"))


@query("agg_sum_double", "select round(sum(l_extendedprice::decimal(18,2))::double, 2) as s from lineitem")
def agg_sum_double(spark, sf_dir):
    return line_items(spark, sf_dir).aggregate(Query(OF_ORDERS), [Sum("l_extendedprice", "s")]).select(F.round("s", 2).alias("s"))


@query("agg_multi_required", f"select count(*) as n, sum(o_custkey)::bigint as s, sum((not isnan(price))::int)::bigint as real from {D} where price is not null")
def agg_multi_required(spark, sf_dir):
    """A sum over ``price`` in the request leaves documents without it out of every aggregate."""
    db = derived(spark, sf_dir)
    a = db.aggregate(Query(OF_ORDERS), [Count("n"), Sum("o_custkey", "s"), Avg("price", "p")]).drop("p")
    return a.join(db.aggregate(Query(OF_ORDERS, where=Where("price", IS_NOT_NAN)), [Count("real")]))


def overflowing(spark, sf_dir) -> Database:
    db = Database(spark)
    db.register("orders", t(spark, sf_dir, "customer").withColumn("big", (F.col("c_custkey") % 1000 + 1) * F.lit(9_000_000_000_000_000)), key="c_custkey")
    return db


for _n, _kw in (("agg_sum_overflow", {}), ("agg_sum_overflow_ds", {"flavour": ENTITY})):
    total(_n, "select sum((c_custkey % 1000 + 1)::hugeint * 9000000000000000)::double as s, sum(c_custkey)::bigint as fits, count(*) as n from customer", [Sum("big", "s"), Sum("c_custkey", "fits"), Count("n")], db=overflowing, **_kw)


@query("distinct_on", "select o_custkey, o_orderkey, o_totalprice from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, 'orders/' || o_orderkey desc) = 1")
def distinct_on(spark, sf_dir):
    q = Query(OF_ORDERS, order=(Order("o_totalprice", True),), distinct_on=("o_custkey",), flavour=ENTITY)
    return db_of(spark, sf_dir, "orders").query(q).select("o_custkey", "o_orderkey", "o_totalprice")


total("agg_distinct_on_ds", "select count(*) as n, sum(o_orderkey)::bigint as s from (select o_orderkey from orders qualify row_number() over (partition by o_custkey order by o_totalprice desc, 'orders/' || o_orderkey desc) = 1)", [Count("n"), Sum("o_orderkey", "s")], db=lambda s, d: db_of(s, d, "orders"), order=(Order("o_totalprice", True),), distinct_on=("o_custkey",), flavour=ENTITY)
total("agg_cursor_offset_ds", f"select count(*) as n, sum(o_orderkey)::bigint as s from (select o_orderkey from orders where o_custkey >= 20 and o_custkey <= 90 order by o_custkey, {BY_PATH} limit 60 offset 15)", [Count("n"), Sum("o_orderkey", "s")], db=lambda s, d: db_of(s, d, "orders"), order=(Order("o_custkey"),), start=Cursor((20,), True), end=Cursor((90,), False), offset=15, limit=60, flavour=ENTITY)


# -- nearest neighbours -----------------------------------------------------------------------------------

PROBE = tuple(((i * 37) % 64 - 32) / 100 for i in range(64))
PROBE_SQL = "[" + ", ".join(map(str, PROBE)) + "]::double[]"
OF_VECTORS = (Selector("embeddings"),)


def knn(name: str, n: Nearest, sql: str, where=None):
    @query(name, sql)
    def run(spark, sf_dir):
        return db_of(spark, sf_dir, "embeddings").query(Query(OF_VECTORS, where=where, nearest=n)).select("vec_id", F.round("d", 6).alias("d"))


def _knn_sql(expr: str, order: str, where: str = "true", limit: int = 10) -> str:
    return f"select vec_id, round(d, 6) as d from (select vec_id, {expr} as d from embeddings where {where}) where true order by d {order}, 'embeddings/' || vec_id limit {limit}"


_EUC = f"list_distance(embedding::double[], {PROBE_SQL})"
_COS = f"1 - list_cosine_similarity(embedding::double[], {PROBE_SQL})"
_DOT = f"list_inner_product(embedding::double[], {PROBE_SQL})"
knn("knn_euclidean", Nearest("embedding", PROBE, vector.EUCLIDEAN, 10, "d"), _knn_sql(_EUC, ""))
knn("knn_cosine", Nearest("embedding", PROBE, vector.COSINE, 10, "d"), _knn_sql(_COS, ""))
knn("knn_dot", Nearest("embedding", PROBE, vector.DOT, 10, "d"), _knn_sql(_DOT, "desc"))
knn("knn_threshold", Nearest("embedding", PROBE, vector.EUCLIDEAN, 200, "d", 1.75), _knn_sql(_EUC, "", f"{_EUC} <= 1.75", 200))
knn("knn_prefilter", Nearest("embedding", PROBE, vector.COSINE, 8, "d"), _knn_sql(_COS, "", "label in (1, 3)", 8), Where("label", IN, [1, 3]))


@query("knn_dynamic_vectors", _knn_sql(_EUC, ""))
def knn_dynamic_vectors(spark, sf_dir):
    """Vectors as dynamic values beside fields of other types."""
    e = t(spark, sf_dir, "embeddings")
    db = Database(spark)
    db.register("embeddings", e.select("vec_id", F.create_map(F.lit("v"), V.lift_vector(F.col("embedding")), F.lit("label"), V.lift(F.col("label").cast("long"), "bigint")).alias("fields")), key="vec_id")
    return db.query(Query(OF_VECTORS, nearest=Nearest("v", PROBE, vector.EUCLIDEAN, 10, "d"))).select("vec_id", F.round("d", 6).alias("d"))


# -- time travel and watch --------------------------------------------------------------------------------

LOG = "(select event_id as seq, 'users/' || user_id as path, ts as change_time, event_type = 'error' as deleted, event_type, value from events) g"


def log_of(spark, sf_dir) -> DataFrame:
    return t(spark, sf_dir, "events").select(F.col("event_id").alias("seq"), F.concat(F.lit("users/"), F.col("user_id").cast("string")).alias("path"), F.col("ts").alias("change_time"), (F.col("event_type") == "error").alias("deleted"), "event_type", "value")


def middle(spark, sf_dir) -> tuple[Column, Column]:
    """A position and a time in the middle of the log, as scalar subqueries: no job of their own."""
    events = t(spark, sf_dir, "events")
    seq = F.floor((F.min("event_id") + F.max("event_id")) / 2).cast("long")
    at = t(spark, sf_dir, "events").where(F.col("event_id") == events.agg(seq.alias("s")).scalar()).select("ts")
    return events.agg(seq.alias("s")).scalar(), at.agg(F.max("ts")).scalar()


def middle_values(spark, sf_dir) -> tuple[int, dt.datetime]:
    """The same as values, for tokens."""
    events = t(spark, sf_dir, "events")
    seq = events.agg((F.min("event_id") + F.max("event_id")).alias("s")).first().s // 2
    return seq, events.where(F.col("event_id") == seq).select("ts").first().ts


MID = "(select (min(event_id) + max(event_id)) // 2 from events)"
MID_TIME = f"(select ts from events where event_id = {MID})"
LATEST = "qualify row_number() over (partition by path order by seq desc) = 1"


@query("asof_snapshot", f"select path, seq, event_type, value from (select * from {LOG} where change_time <= {MID_TIME} {LATEST}) where not deleted")
def asof_snapshot(spark, sf_dir):
    return changes.as_of(log_of(spark, sf_dir), middle(spark, sf_dir)[1]).select("path", "seq", "event_type", "value")


@query("asof_point", f"select path, seq, event_type from (select * from {LOG} where change_time <= {MID_TIME} and path = 'users/1' {LATEST}) where not deleted")
def asof_point(spark, sf_dir):
    return changes.point_as_of(log_of(spark, sf_dir), "users/1", middle(spark, sf_dir)[1]).select("path", "seq", "event_type")


@query("asof_point_found", f"select path, seq, event_type from (select * from {LOG} where change_time <= {MID_TIME} {LATEST}) where not deleted and path = (select min(path) from (select * from {LOG} where change_time <= {MID_TIME} {LATEST}) where not deleted)")
def asof_point_found(spark, sf_dir):
    """The first document that was there at the time."""
    log, at = log_of(spark, sf_dir), middle(spark, sf_dir)[1]
    first = changes.as_of(log, at).agg(F.min("path")).scalar()
    return changes.point_as_of(log, first, at).select("path", "seq", "event_type")


@query("asof_aggregate", f"select count(*) as n, round(avg(value), 6) as a from (select * from {LOG} where change_time <= {MID_TIME} {LATEST}) where not deleted and event_type = 'click'")
def asof_aggregate(spark, sf_dir):
    db = Database(spark)
    db.register("users", changes.as_of(log_of(spark, sf_dir), middle(spark, sf_dir)[1]), path=F.col("path"), prefix="users")
    got = db.aggregate(Query((Selector("users"),), where=Where("event_type", EQ, "click")), [Count("n"), Avg("value", "a")])
    return got.withColumn("a", F.round("a", 6))


@query("asof_ordered_page", f"select path, value, row_number() over (order by value desc, path desc)::int as place from (select path, value from (select * from {LOG} where change_time <= {MID_TIME} {LATEST}) where not deleted and value < 90 order by value desc, path desc limit 25 offset 5)")
def asof_ordered_page(spark, sf_dir):
    """A past state is filtered, cut by a cursor, sorted, and only then skipped and limited."""
    db = Database(spark)
    c = db.register("users", changes.as_of(log_of(spark, sf_dir), middle(spark, sf_dir)[1]), path=F.col("path"), prefix="users")
    q = Query((Selector("users"),), order=(Order("value", True),), start=Cursor((90.0,), False), offset=5, limit=25)
    return placed(db.query(q), q, c).select("path", "value", "place")


@query("asof_collection_group", f"select path, seq from (select * from (select seq, 'region/' || (user_id % 5) || '/users/' || user_id as path, change_time, deleted from (select *, split_part(path, '/', 2)::bigint as user_id from {LOG})) where change_time <= {MID_TIME} {LATEST}) where not deleted and starts_with(path, 'region/1/')")
def asof_collection_group(spark, sf_dir):
    """Collections of one id at several parents in a past state: the parent counts."""
    log = log_of(spark, sf_dir)
    user = F.substring_index("path", "/", -1)
    nested = log.withColumn("path", F.concat(F.lit("region/"), (user.cast("long") % 5).cast("string"), F.lit("/users/"), user))
    db = Database(spark)
    db.register("users", changes.as_of(nested, middle(spark, sf_dir)[1]), path=F.col("path"))
    return db.query(Query((Selector("users", True),), parent="region/1")).select("path", "seq")


@query("changes_since_seq", f"select path, min_seq as first_seq, seq, deleted from (select *, min(seq) over (partition by path) as min_seq from {LOG} where seq > {MID} {LATEST})")
def changes_since_seq(spark, sf_dir):
    return changes.since_seq(log_of(spark, sf_dir), middle(spark, sf_dir)[0]).select("path", "first_seq", "seq", "deleted")


@query("docs_since_time", f"select path, seq, deleted from (select * from {LOG} where true {LATEST}) where change_time > {MID_TIME}")
def docs_since_time(spark, sf_dir):
    return changes.since_time(log_of(spark, sf_dir), middle(spark, sf_dir)[1]).select("path", "seq", "deleted")


@query("current_seq", "select coalesce(max(event_id), 0) as seq from events")
def current_seq(spark, sf_dir):
    return changes.current_seq(log_of(spark, sf_dir))


HIT = "coalesce(event_type in ('click', 'view') and not deleted, false)"


@query("watch_batch_diff", f"""
select a.path, case when a.hit then 'CHANGE' when a.deleted then 'DELETE' else 'REMOVE' end as change, a.seq
from (select *, {HIT} as hit from {LOG} where true {LATEST}) a left join (select path, {HIT} as hit from {LOG} where seq <= {MID} {LATEST}) b using (path)
where a.seq > {MID} and (a.hit or coalesce(b.hit, false))""")
def watch_batch_diff(spark, sf_dir):
    log = log_of(spark, sf_dir)
    seq = middle(spark, sf_dir)[0]
    top = log.agg(F.max("seq")).scalar()
    return changes.diff(log, F.col("event_type").isin("click", "view"), seq, top).select("path", "change", "seq")


EVENTS = f"""
select target, path, seq, case when now then 'CHANGE' when deleted then 'DELETE' else 'REMOVE' end as change from (
  select *, coalesce(lag(now) over (partition by target, path order by seq), false) as was from (
    select 'clicks' as target, *, {HIT} as now from {LOG} union all select 'dear', *, coalesce(value > 50 and not deleted, false) from {LOG}))
where now or was"""


@query("watch_events", EVENTS)
def watch_events(spark, sf_dir):
    return watch.events_batch(log_of(spark, sf_dir), {"clicks": F.col("event_type").isin("click", "view"), "dear": F.col("value") > 50})


@query("change_of_one_since", f"select path, min_seq as first_seq, seq, event_type from (select *, min(seq) over (partition by path) as min_seq from {LOG} where seq > {MID} and path = 'users/1' {LATEST})")
def change_of_one_since(spark, sf_dir):
    return changes.point_since_seq(log_of(spark, sf_dir), "users/1", middle(spark, sf_dir)[0]).select("path", "first_seq", "seq", "event_type")


OF_STREAM = "stream-1"


def clicks():
    return F.col("event_type").isin("click", "view")


def marks(once: bool = False) -> str:
    more = ", (4, 'REMOVE_TARGET')" if once else ""
    return f"select place, null::varchar as path, change from (values (0, 'ADD'), (2, 'CURRENT'), (3, 'NO_CHANGE'){more}) m(place, change)"


DIFF = f"""select 1 as place, a.path, case when a.hit then 'CHANGE' when a.deleted then 'DELETE' else 'REMOVE' end as change
from (select *, {HIT} as hit from {LOG} where true {LATEST}) a left join (select path, {HIT} as hit from {LOG} where %s {LATEST}) b using (path)
where %s and (a.hit or coalesce(b.hit, false))"""
SNAPSHOT = f"select 1 as place, path, 'CHANGE' as change from (select * from {LOG} where true {LATEST}) where {HIT}"


def opened_at_end(name: str, sql: str, kw):
    """What a target gets when it is added at the end of the log."""

    @query(name, sql)
    def run(spark, sf_dir):
        log = log_of(spark, sf_dir)
        top = log.agg(F.max("seq")).first()[0]
        return watch.opened(log, clicks(), "clicks", top, OF_STREAM, **kw(spark, sf_dir)).select("place", "path", "change")


opened_at_end("watch_opened", f"{marks()} union all {SNAPSHOT}", lambda *_: {})
opened_at_end("watch_once", f"{marks(True)} union all {SNAPSHOT}", lambda *_: {"once": True})
opened_at_end("watch_resume_token", f"{marks()} union all {DIFF % (f'seq <= {MID}', f'a.seq > {MID}')}", lambda s, d: {"resume_token": watch.token(middle_values(s, d)[0], OF_STREAM)})
opened_at_end("watch_resume_other_stream", f"{marks()} union all {SNAPSHOT}", lambda s, d: {"resume_token": watch.token(middle_values(s, d)[0], "stream-2")})
opened_at_end("watch_resume_time", f"{marks()} union all {DIFF % (f'change_time <= {MID_TIME}', f'a.change_time > {MID_TIME}')}", lambda s, d: {"read_time": middle(s, d)[1]})


@query("watch_documents", f"select target, path, seq, case when now then 'CHANGE' when deleted then 'DELETE' else 'REMOVE' end as change from (select *, coalesce(lag(now) over (partition by path order by seq), false) as was from (select 'some' as target, *, path in ('users/1', 'users/2', 'users/3') and not deleted as now from {LOG})) where now or was")
def watch_documents(spark, sf_dir):
    return watch.events_batch(log_of(spark, sf_dir), {"some": watch.documents_target(["users/1", "users/2", "users/3"])})


@query("watch_sent_paths", f"select 'clicks' as target, path from (select * from {LOG} where seq <= {MID} {LATEST}) where {HIT} union all select 'dear', path from (select * from {LOG} where seq <= {MID} {LATEST}) where coalesce(value > 50 and not deleted, false)")
def watch_sent_paths(spark, sf_dir):
    return watch.sent_paths(log_of(spark, sf_dir), {"clicks": clicks(), "dear": F.col("value") > 50}, middle(spark, sf_dir)[0])


# -- writes -----------------------------------------------------------------------------------------------


@query("transform_increment", "select p_partkey, p_size + 3 as p_size, p_retailprice + 2 as p_retailprice, 5 as fresh from part")
def transform_increment(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    return p.select("p_partkey", transforms.increment(F.col("p_size"), 3).alias("p_size"), transforms.increment(F.col("p_retailprice"), 2).alias("p_retailprice"), transforms.increment(F.lit(None).cast("int"), 5).alias("fresh"))


@query("transform_max_min", "select p_partkey, greatest(p_size, 25) as high, least(p_size, 10) as low from part")
def transform_max_min(spark, sf_dir):
    p = t(spark, sf_dir, "part")
    return p.select("p_partkey", transforms.maximum(F.col("p_size"), 25).alias("high"), transforms.minimum(F.col("p_size"), 10).alias("low"))


WORDS = "string_split(p_name, ' ')"


@query("transform_array_append", f"select p_partkey, array_to_string({WORDS} || list_filter(['new', {WORDS}[1], 'new'], lambda x: not list_contains({WORDS}, x)), ' ') as words from part")
def transform_array_append(spark, sf_dir):
    w = F.split("p_name", " ")
    return t(spark, sf_dir, "part").select("p_partkey", F.array_join(transforms.append_missing(w, F.array(F.lit("new"), w[0], F.lit("new"))), " ").alias("words"))


@query("transform_array_remove", f"select p_partkey, array_to_string(list_filter({WORDS}, lambda x: x <> {WORDS}[1]), ' ') as words from part")
def transform_array_remove(spark, sf_dir):
    w = F.split("p_name", " ")
    return t(spark, sf_dir, "part").select("p_partkey", F.array_join(transforms.remove_all(w, F.array(w[0])), " ").alias("words"))


@query("transform_request_time", "select p_partkey, timestamp '2024-03-01 12:00:00' as updated from part")
def transform_request_time(spark, sf_dir):
    return t(spark, sf_dir, "part").select("p_partkey", transforms.request_time(dt.datetime(2024, 3, 1, 12)).cast("timestamp_ntz").alias("updated"))


def store(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    """(live documents, writes) of all orders: two of three keys are live, every key is written by its residue modulo 4; each key in every pair of a live or absent document with an operation."""
    o = t(spark, sf_dir, "orders")
    path = F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string"))
    live = o.where("o_orderkey % 3 <> 0").select(path.alias("path"), "o_totalprice", "o_orderstatus", (F.col("o_orderkey") % 5 + 1).alias("version"))
    k = F.col("o_orderkey") % 4
    op = F.when(k == 0, "insert").when(k == 1, "update").when(k == 2, "delete").otherwise("upsert")
    writes = o.select(path.alias("path"), op.alias("op"), (F.col("o_totalprice") + 1).alias("o_totalprice"), F.lit("W").alias("o_orderstatus"), F.when(k == 3, F.lit(2)).cast("long").alias("base_version"), F.when(k == 2, F.lit(True)).alias("exists"))
    return live, writes


LIVE = "(select 'orders/' || o_orderkey as path, o_totalprice, o_orderstatus, o_orderkey % 5 + 1 as version from orders where o_orderkey % 3 <> 0)"
WRITES = "(select 'orders/' || o_orderkey as path, case o_orderkey % 4 when 0 then 'insert' when 1 then 'update' when 2 then 'delete' else 'upsert' end as op, o_totalprice + 1 as o_totalprice, 'W' as o_orderstatus, case when o_orderkey % 4 = 3 then 2 end as base_version, case when o_orderkey % 4 = 2 then true end as must_exist from orders)"


@query("write_status", f"""
select w.path, op, case when op = 'insert' and l.path is not null then 'ALREADY_EXISTS' when op = 'update' and l.path is null then 'NOT_FOUND'
  when must_exist is not null and must_exist <> (l.path is not null) then 'FAILED_PRECONDITION' when base_version is not null and base_version <> coalesce(l.version, 0) then 'CONFLICT' else 'OK' end as status
from {WRITES} w left join {LIVE} l using (path)""")
def write_status(spark, sf_dir):
    return mutate.judged(*store(spark, sf_dir)).select("path", "op", "status")


@query("upsert_merge", f"""
select path, coalesce(w.o_totalprice, l.o_totalprice) as o_totalprice, coalesce(w.o_orderstatus, l.o_orderstatus) as o_orderstatus, (case when w.path is null then l.version else coalesce(l.version, 0) + 1 end)::bigint as version
from {LIVE} l full join {WRITES} w using (path) where coalesce(op, '') <> 'delete'""")
def upsert_merge(spark, sf_dir):
    return mutate.post_image(*store(spark, sf_dir), ["o_totalprice", "o_orderstatus"]).select("path", "o_totalprice", "o_orderstatus", "version")


@query("update_mask_merge", f"select path, coalesce(w.o_totalprice, l.o_totalprice) as o_totalprice, l.o_orderstatus from {LIVE} l left join (select * from {WRITES} where op = 'upsert') w using (path)")
def update_mask_merge(spark, sf_dir):
    live, writes = store(spark, sf_dir)
    held = writes.where("op = 'upsert'").join(live.select("path"), "path", "left_semi")
    return mutate.post_image(live, held, ["o_totalprice", "o_orderstatus"], ["o_totalprice"]).select("path", "o_totalprice", "o_orderstatus")


@query("insert_conflicts", f"select w.path from {WRITES} w join {LIVE} l using (path) where op = 'insert'")
def insert_conflicts(spark, sf_dir):
    live, writes = store(spark, sf_dir)
    return mutate.judged(live, writes.where("op = 'insert'").drop("base_version", "exists")).where("status = 'ALREADY_EXISTS'").select("path")


@query("delete_tombstones", f"select path, true as deleted from {WRITES} where op = 'delete'")
def delete_tombstones(spark, sf_dir):
    live, writes = store(spark, sf_dir)
    return mutate.tombstones(live, writes.where("op = 'delete'"))


@query("delete_tombstones_ds", f"select path, true as deleted from {WRITES} where op = 'delete' and path in (select path from {LIVE})")
def delete_tombstones_ds(spark, sf_dir):
    live, writes = store(spark, sf_dir)
    return mutate.tombstones(live, writes.where("op = 'delete'"), even_absent=False)


@query("occ_conflicts", f"select r.path, r.version, l.version as current_version from (select 'orders/' || o_orderkey as path, 2::bigint as version from orders) r left join {LIVE} l using (path) where l.version is null or l.version > r.version")
def occ_conflicts(spark, sf_dir):
    live, writes = store(spark, sf_dir)
    return mutate.conflicts(writes.select("path", F.lit(2).cast("long").alias("version")), live)


@query("allocate_ids", "select n_name, (100 + row_number() over (order by n_name))::bigint as id from nation")
def allocate_ids(spark, sf_dir):
    return mutate.allocate_ids(t(spark, sf_dir, "nation").select("n_name"), 100, ["n_name"])


def _refused(i: str) -> bool:
    try:
        P.check_id(i)
    except InvalidArgument:
        return True
    return False


@query("reserved_ids", "select * from (values ('__x__', true), ('__id7__', false), ('__id-12__', false), ('__idx__', true), ('____', true), ('', true), ('a/b', true), ('__a', false), ('plain', false), ('7', false)) v(id, refused)")
def reserved_ids(spark, sf_dir):
    """The check of a request; the same over a column agrees with it."""
    ids = ["__x__", "__id7__", "__id-12__", "__idx__", "____", "", "a/b", "__a", "plain", "7"]
    df = spark.createDataFrame([(i, _refused(i)) for i in ids], "id string, asked boolean")
    return df.select("id", F.when(P.refused_id(F.col("id")) == F.col("asked"), F.col("asked")).alias("refused"))


@query("reserved_ids_column", "select count(*) as n, sum((o_orderkey % 4 = 0)::int)::bigint as refused from orders")
def reserved_ids_column(spark, sf_dir):
    k = F.col("o_orderkey").cast("string")
    i = F.when(F.col("o_orderkey") % 4 == 0, F.concat(F.lit("__x"), k, F.lit("__"))).when(F.col("o_orderkey") % 4 == 1, F.concat(F.lit("__id"), k, F.lit("__"))).otherwise(k)
    return t(spark, sf_dir, "orders").agg(F.count(F.lit(1)).alias("n"), F.count_if(P.refused_id(i)).alias("refused"))


@query("auto_ids", "select 20 as length, 200::bigint as ids, 0::bigint as refused")
def auto_ids(spark, sf_dir):
    ids = [mutate.auto_id() for _ in range(200)]
    df = spark.createDataFrame([(i,) for i in ids], "id string")
    return df.agg(F.max(F.length("id")).alias("length"), F.count_distinct("id").alias("ids"), F.count_if(P.refused_id(F.col("id")) | ~F.col("id").rlike("^[A-Za-z0-9]{20}$")).alias("refused"))


@query("complete_keys", "select n_name, case when n_nationkey % 2 = 0 then n_nationkey::bigint else 100 + row_number() over (partition by n_nationkey % 2 order by n_name) end as id from nation")
def complete_keys(spark, sf_dir):
    """Complete keys pass through, incomplete ones get ids in order."""
    keys = t(spark, sf_dir, "nation").select("n_name", F.when(F.col("n_nationkey") % 2 == 0, F.col("n_nationkey").cast("long")).alias("id0"))
    return mutate.complete_keys(keys, "id0", 100, ["n_name"]).select("n_name", F.col("id0").alias("id"))


# -- writes that are folded path by path ------------------------------------------------------------------

DOC = "price double, status string, n long, tags array<string>, m struct<x: long, y: string>"


def documents_of(spark, sf_dir) -> DataFrame:
    """All orders as live documents, but for keys divisible by 5."""
    o = t(spark, sf_dir, "orders").where("o_orderkey % 5 <> 0")
    when = F.lit(dt.datetime(2024, 1, 1)).cast("timestamp")
    return o.select(
        F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("path"), (F.col("o_orderkey") % 4 + 1).alias("version"), when.alias("create_time"), (when + F.make_interval(secs=F.col("o_orderkey") % 3)).alias("change_time"),
        F.col("o_totalprice").alias("price"), F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("n"), F.array(F.col("o_orderstatus"), F.lit("b")).alias("tags"), F.struct(F.col("o_custkey").alias("x"), F.col("o_orderpriority").alias("y")).alias("m"),
    )


def write_rows(spark, sf_dir, place: int, op: str, where: str = "true", **columns) -> DataFrame:
    """A write for every order: columns that are not given are null."""
    o = t(spark, sf_dir, "orders").where(where)
    given = {"price": "double", "status": "string", "n": "long", "tags": "array<string>", "m": "struct<x: long, y: string>"}
    cols = [columns.get(k, F.lit(None)).cast(v).alias(k) for k, v in given.items()]
    more = [v.alias(k) for k, v in columns.items() if k not in given]
    return o.select(F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("path"), F.lit(place).cast("long").alias("place"), F.lit(op).alias("op"), *cols, *more)


def fold_of(spark, sf_dir, writes: DataFrame, **kw) -> DataFrame:
    return mutate.fold(documents_of(spark, sf_dir), writes, T.StructType.fromDDL(DOC), dt.datetime(2024, 6, 1), **kw)


LIVE5 = "(o_orderkey % 5 <> 0)"


@query("commit_in_order", f"""
select 'orders/' || o_orderkey as path, 1::bigint as place, case when {LIVE5} then 'ALREADY_EXISTS' else 'OK' end as status, case when {LIVE5} then null else -1.0 end as price, (case when {LIVE5} then o_orderkey % 4 + 1 else 1 end)::bigint as version from orders
union all select 'orders/' || o_orderkey, 2, 'OK', case when {LIVE5} then o_totalprice * 2 else 0.5 end, (case when {LIVE5} then o_orderkey % 4 + 2 else 2 end)::bigint from orders
union all select 'orders/' || o_orderkey, 3, 'OK', null, (case when {LIVE5} then o_orderkey % 4 + 3 else 3 end)::bigint from orders where o_orderkey % 2 = 0
union all select 'orders/' || o_orderkey, 4, case when o_orderkey % 2 = 0 then 'NOT_FOUND' else 'OK' end, case when o_orderkey % 2 = 0 then null else 7.0 end, (case when {LIVE5} then o_orderkey % 4 + 3 else 3 end)::bigint from orders""")
def commit_in_order(spark, sf_dir):
    """Insert, update, delete and update again, all to one path in one commit."""
    twice = F.when(F.col("o_orderkey") % 5 != 0, F.col("o_totalprice") * 2).otherwise(F.lit(0.5))
    w = write_rows(spark, sf_dir, 1, "insert", price=F.lit(-1.0)).unionByName(write_rows(spark, sf_dir, 2, "update", price=twice)).unionByName(write_rows(spark, sf_dir, 3, "delete", "o_orderkey % 2 = 0")).unionByName(write_rows(spark, sf_dir, 4, "update", price=F.lit(7.0)))
    return fold_of(spark, sf_dir, w).select("path", "place", "status", "doc.price", "version")


@query("commit_nested_masks", f"""
select 'orders/' || o_orderkey as path, case when {LIVE5} then o_totalprice end as price, null::varchar as status, (case when {LIVE5} then o_custkey end)::bigint as x, 'new' as y from orders""")
def commit_nested_masks(spark, sf_dir):
    """``m.y`` is set, ``status`` is in the mask and not written: removed; all else stays."""
    mask = F.array(F.lit("m.y"), F.lit("status"))
    w = write_rows(spark, sf_dir, 1, "upsert", price=F.lit(9.0), m=F.struct(F.lit(-1).cast("long").alias("x"), F.lit("new").alias("y")), mask=mask)
    return fold_of(spark, sf_dir, w).select("path", "doc.price", "doc.status", "doc.m.x", "doc.m.y")


def transform_rows(*wanted) -> Column:
    return F.array(*[F.struct(F.lit(f).alias("field"), F.lit(k).alias("kind"), F.lit(w).cast("long").alias("whole"), F.lit(d).cast("double").alias("number"), F.lit(i).cast("string").alias("items")) for f, k, w, d, i in mutate.transforms_column(list(wanted))])


@query("commit_transforms", f"""
select 'orders/' || o_orderkey as path, case when {LIVE5} then o_totalprice else 0 end + 2.5 as price, greatest(case when {LIVE5} then o_custkey else 0 end + 3, 50)::bigint as n,
  case when {LIVE5} then o_orderstatus || ',b' || case when o_orderstatus = 'F' then '' else ',F' end || ',z,z' else 'F,z,z' end as tags, least(case when {LIVE5} then o_custkey else 0 end, 10)::bigint as x,
  least(case when {LIVE5} then o_custkey else 0 end, 10)::varchar as x_result from orders""")
def commit_transforms(spark, sf_dir):
    wanted = transform_rows(("price", "increment", 2.5), ("n", "increment", 3), ("n", "maximum", 50), ("tags", "append_missing_elements", ["F", "z", "z"]), ("m.x", "minimum", 10))
    w = write_rows(spark, sf_dir, 1, "upsert", mask=F.array().cast("array<string>"), transforms=wanted)
    got = fold_of(spark, sf_dir, w)
    return got.select("path", "doc.price", "doc.n", F.array_join("doc.tags", ",").alias("tags"), "doc.m.x", F.col("results")[4].alias("x_result"))


@query("commit_transform_results_ds", f"select 'orders/' || o_orderkey as path, (case when {LIVE5} then o_custkey else 0 end + 1)::varchar as n_result, true as none_for_array, case when {LIVE5} then array_to_string(list_filter([o_orderstatus, 'b'], lambda x: x <> 'F'), ',') end as tags from orders")
def commit_transform_results_ds(spark, sf_dir):
    wanted = transform_rows(("n", "increment", 1), ("tags", "remove_all_from_array", ["F"]))
    w = write_rows(spark, sf_dir, 1, "upsert", mask=F.array().cast("array<string>"), transforms=wanted)
    return fold_of(spark, sf_dir, w, null_arrays=True).select("path", F.col("results")[0].alias("n_result"), F.col("results")[1].isNull().alias("none_for_array"), F.array_join("doc.tags", ",").alias("tags"))


@query("precondition_update_time", f"select 'orders/' || o_orderkey as path, case when {LIVE5} and o_orderkey % 3 = 1 then 'OK' else 'FAILED_PRECONDITION' end as status from orders")
def precondition_update_time(spark, sf_dir):
    w = write_rows(spark, sf_dir, 1, "upsert", price=F.lit(1.0), update_time=F.lit(dt.datetime(2024, 1, 1, 0, 0, 1)).cast("timestamp"))
    return fold_of(spark, sf_dir, w).select("path", "status")


@query("batch_write", "select 'orders/' || o_orderkey as path, case when o_orderkey % 3 = 0 then 'NOT_FOUND' when o_orderkey % 3 = 1 then 'OK' else 'ALREADY_EXISTS' end as status, case when o_orderkey % 3 = 1 then 2::bigint end as version from orders")
def batch_write(spark, sf_dir):
    """A store with two of three orders; updates and inserts of all, each on its own."""
    s = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", "orders", "price double")
    o = t(spark, sf_dir, "orders")
    path = F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("path")
    s.commit(o.where("o_orderkey % 3 <> 0").select(path, F.lit("insert").alias("op"), F.col("o_totalprice").alias("price")))
    op = F.when(F.col("o_orderkey") % 3 == 2, "insert").otherwise("update").alias("op")
    return s.batch_write(o.select(path, op, F.lit(0.0).alias("price"))).select("path", "status", "version")


@query("store_commits", "select count(*) as n, 2 * count(*) as changes, 2 * count(*) as last_seq, 0::bigint as gaps_under_a_millisecond, round(sum(o_totalprice + 1), 2) as price from orders")
def store_commits(spark, sf_dir):
    """Two commits of all orders: gapless numbers, times that rise, and the latest values."""
    s = Store(spark, f"{shared_dir(spark)}/store-{uuid.uuid4().hex}", "orders", "price decimal(18,2)")
    o = t(spark, sf_dir, "orders")
    path = F.concat(F.lit("orders/"), F.col("o_orderkey").cast("string")).alias("path")
    for more in (0, 1):
        s.commit(o.select(path, F.lit("upsert").alias("op"), (F.col("o_totalprice").cast("decimal(18,2)") + more).alias("price")))
    log = s.changes()
    # Neighbours in order, by a join on the number.
    after = log.select((F.col("seq") - 1).alias("seq"), F.col("change_time").alias("next_time"))
    gaps = log.join(after, "seq").agg(F.count_if(F.unix_micros("next_time") - F.unix_micros("change_time") < 1000).alias("gaps_under_a_millisecond"), (F.count(F.lit(1)) + 1).alias("changes"), F.max(F.col("seq") + 1).alias("last_seq"))
    live = s.live().agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("price").cast("double"), 2).alias("price"))
    return live.crossJoin(gaps)  # two rows of one


# -- the same transforms over dynamic values --------------------------------------------------------------


@query("transform_value_numbers", """
select o_orderkey, case when k = 4 then o_custkey + 5 when k = 1 then null else 5 end::bigint as plus_int, case when k = 4 then o_custkey + 5 when k = 1 then o_totalprice + 5 else 5 end::double as plus,
  case when k = 4 then greatest(o_custkey, 700)::double when k = 1 then greatest(o_totalprice, 700) else 700 end::double as most, case when k = 4 then least(o_custkey, 700)::double when k = 1 then least(o_totalprice, 700) else 0 end::double as least
from (select *, o_orderkey % 6 as k from orders)""")
def transform_value_numbers(spark, sf_dir):
    """Strings, booleans, nulls and missing fields count as 0."""
    df, v = mixed(spark, sf_dir).tables["orders"][0].df, F.col("fields")["v"]
    plus, most, least = transforms.increment_value(v, 5), transforms.maximum_value(v, 700), transforms.minimum_value(v, 700)
    return df.select("o_orderkey", plus["int"].alias("plus_int"), plus["key"]["num"].alias("plus"), most["key"]["num"].alias("most"), least["key"]["num"].alias("least"))


@query("transform_value_arrays", """
select o_orderkey, array_to_string(case when o_orderkey % 2 = 0 then [o_orderstatus, 'b'] || list_filter(['F', 'F', 'b'], lambda x: not list_contains([o_orderstatus, 'b'], x)) else ['F', 'F', 'b'] end, ',') as appended,
  case when o_orderkey % 2 = 0 then array_to_string(list_filter([o_orderstatus, 'b'], lambda x: x <> 'b'), ',') end as removed, case when o_orderkey % 2 = 1 then o_orderstatus end as kept from orders""")
def transform_value_arrays(spark, sf_dir):
    """What is no array becomes one when elements are appended, and stays when elements are removed."""
    kind = T.ArrayType(T.StringType())
    v = F.when(F.col("o_orderkey") % 2 == 0, V.lift_any(F.array(F.col("o_orderstatus"), F.lit("b")), kind)).otherwise(V.lift(F.col("o_orderstatus"), "string"))
    df = t(spark, sf_dir, "orders").select("o_orderkey", v.alias("v"))
    texts = lambda x: F.array_join(F.transform(x["key"]["items"], lambda e: e["text"]), ",")
    more, less = transforms.append_missing_value(F.col("v"), ["F", "F", "b"]), transforms.remove_all_value(F.col("v"), ["b"])
    return df.select("o_orderkey", texts(more).alias("appended"), texts(less).alias("removed"), less["key"]["text"].alias("kept"))


# -- pages and explain ------------------------------------------------------------------------------------


@query("page_by_token", f"select o_orderkey, row_number() over (order by o_custkey, {BY_PATH})::int as place from (select * from orders order by o_custkey, {BY_PATH} limit 40 offset 40)")
def page_by_token(spark, sf_dir):
    db, q = db_of(spark, sf_dir, "orders"), Query(OF_ORDERS, order=(Order("o_custkey"),), limit=40, flavour=ENTITY)
    second = pages.page(db, q, pages.page(db, q).end_cursor)
    return placed(second.rows, q, db.tables["orders"][0]).select("o_orderkey", "place")


@query("page_figures", "select 30::bigint as skipped, 'MORE_RESULTS_AFTER_LIMIT' as more, (select count(*) from orders where o_orderstatus = 'P')::bigint as all_skipped, 'NO_MORE_RESULTS' as none_more")
def page_figures(spark, sf_dir):
    db = db_of(spark, sf_dir, "orders")
    some = pages.page(db, Query(OF_ORDERS, order=(Order("o_custkey"),), limit=20, offset=30, flavour=ENTITY))
    none = pages.page(db, Query(OF_ORDERS, where=Where("o_orderstatus", EQ, "P"), limit=20, offset=10_000_000, flavour=ENTITY))
    return spark.createDataFrame([(some.skipped_results, some.more_results, none.skipped_results, none.more_results)], "skipped long, more string, all_skipped long, none_more string")


@query("partition_query", "select count(*) as n from (select 1 where false)")
def partition_query(spark, sf_dir):
    return pages.partitions(db_of(spark, sf_dir, "orders"), Query((Selector("orders", True),), order=(Order(NAME),)), 8).agg(F.count(F.lit(1)).alias("n"))


def _items(spark, got: dict) -> DataFrame:
    return spark.createDataFrame([(k, str(v)) for k, v in got.items() if k != "seconds"], "item string, value string")


@query("explain_analyze", "select 'results' as item, count(*)::varchar as value from orders where o_totalprice > 100000 union all select 'read_operations', count(*)::varchar from orders where o_totalprice > 100000 union all select 'documents_scanned', count(*)::varchar from orders union all select * from (values ('query_scope', 'Collection'), ('properties', '(o_totalprice DESC, __name__ DESC)'), ('includes_ancestors', 'False'), ('name_field', '__name__')) v(item, value)")
def explain_analyze(spark, sf_dir):
    return _items(spark, explain_plan.analyze_run(db_of(spark, sf_dir, "orders"), Query(OF_ORDERS, where=Where("o_totalprice", GT, 100000), order=(Order("o_totalprice", True),))))


@query("explain_aggregation_ds", "select 'results' as item, '1' as value union all select 'read_operations', greatest(1, ceil(count(*) / 1000.0))::int::varchar from orders union all select 'documents_scanned', count(*)::varchar from orders union all select * from (values ('query_scope', 'Collection group'), ('properties', '(o_totalprice ASC, __key__ ASC)'), ('includes_ancestors', 'True'), ('name_field', '__key__')) v(item, value)")
def explain_aggregation_ds(spark, sf_dir):
    q = Query((Selector("orders", True),), where=Where(KEY, HAS_ANCESTOR, "customer/42"), flavour=ENTITY)
    return _items(spark, explain_plan.analyze_run(of_customers(spark, sf_dir), q, [Count("n"), Sum("o_totalprice", "s")]))


INDEXES = """
indexes:
- kind: Order
  ancestor: yes
  properties:
  - name: status
  - name: price
    direction: desc
- kind: Part
  properties:
  - name: size  # the default direction
"""


@query("index_list", "select md5('[\"Order\",true,[[\"status\",\"asc\"],[\"price\",\"desc\"]]]')[1:16] as index_id, 'Order' as kind, true as ancestor, 'status asc, price desc' as properties union all select md5('[\"Part\",false,[[\"size\",\"asc\"]]]')[1:16], 'Part', false, 'size asc'")
def index_list(spark, sf_dir):
    return indexes.index_frame(spark, indexes.parse_index_config(INDEXES))


@query("index_get", "select 'Part' as kind, false as ancestor")
def index_get(spark, sf_dir):
    held = indexes.parse_index_config(INDEXES)
    return indexes.index_frame(spark, [indexes.get_index(held, held[1]["id"])]).select("kind", "ancestor")


@query("error_model", "select * from (values ('NotFound', 'NOT_FOUND', 404), ('AlreadyExists', 'ALREADY_EXISTS', 409), ('FailedPrecondition', 'FAILED_PRECONDITION', 400), ('Aborted', 'ABORTED', 409), ('InvalidArgument', 'INVALID_ARGUMENT', 400), ('Unimplemented', 'UNIMPLEMENTED', 501), ('Conflict', 'ABORTED', 409)) v(name, status, http)")
def error_model(spark, sf_dir):
    kinds = (errors.NotFound, errors.AlreadyExists, errors.FailedPrecondition, errors.Aborted, errors.InvalidArgument, errors.Unimplemented, errors.Conflict)
    return spark.createDataFrame([(k.__name__, k.status, k.http) for k in kinds], "name string, status string, http int")


@query("explain_plan_only", "select * from (values ('query_scope', 'Collection'), ('properties', '(o_orderstatus ASC, o_totalprice ASC, __name__ ASC)'), ('includes_ancestors', 'False'), ('name_field', '__name__')) v(item, value)")
def explain_plan_only(spark, sf_dir):
    q = Query(OF_ORDERS, where=Where("o_totalprice", GT, 1000), order=(Order("o_orderstatus"),))
    return spark.createDataFrame([(k, str(v)) for k, v in explain_plan.summary(q).items()], "item string, value string")


# -- extensions: natural in Spark, not part of the document model -----------------------------------------


@query("ext_group_by", "select o_orderstatus, count(*) as n, max(o_totalprice) as most from orders group by 1")
def ext_group_by(spark, sf_dir):
    return t(spark, sf_dir, "orders").groupBy("o_orderstatus").agg(F.count(F.lit(1)).alias("n"), F.max("o_totalprice").alias("most"))


@query("ext_reference_join", "select c_custkey, count(*) as n from customer join orders on o_custkey = c_custkey where c_mktsegment = 'BUILDING' group by 1")
def ext_reference_join(spark, sf_dir):
    """Orders beside the customers that they refer to."""
    customers = db_of(spark, sf_dir, "customer").tables["customer"][0]
    orders = derived(spark, sf_dir).tables["orders"][0].df.select("o_orderkey", "ref")
    met = lookup.dereference(orders, "ref", customers).where("ref_document.c_mktsegment = 'BUILDING'")
    return met.groupBy(F.col("ref_document.c_custkey").alias("c_custkey")).agg(F.count(F.lit(1)).alias("n"))
