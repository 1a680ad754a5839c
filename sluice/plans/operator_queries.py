"""One query for each operator, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from ..functions import call
from ..operators import (
    AllAggregate, AntiJoin, Append, AsOfJoin, ChangeType, CogroupedMap, Combine, ConcatColumn, Copy, CrosstableUDF, CumAggr, DropColumns, DropDuplicate, DropNA, FillNA, Filter, GetDummies, GroupBy, GroupedMap, GroupingSets,
    InnerJoin, IntervalJoin, Join, LeftOuterJoin, Node, NotIn, PipelinePath, Pivot, Rename, ScalarComputation, Select, SemiJoin, SetItem, SetItemWithDependency, SortValues, Split, SubPipeline, Subquery, SubpipeInput, TopN, UnPivot,
    agg, outer,
)
from ..predicate import Arith, Case, Cast, Contains, InTuples, Lit, Not, Opaque, col

Tables = Callable[[str], Node]
PIPELINES: dict[str, Callable[[Tables], Node]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None):
    def keep(make: Callable[[Tables], Node]):
        PIPELINES[make.__name__] = make
        if sql:
            SQL[make.__name__] = sql
        return make

    return keep


def with_nulls(t: Tables) -> Node:
    """Customers whose segment MACHINERY and negative balances are nulls."""
    c = SetItem(t("customer"), "c_mktsegment", Case(((col("c_mktsegment") != "MACHINERY", col("c_mktsegment")),)))
    return SetItem(c, "c_acctbal", Case(((col("c_acctbal") >= 0, col("c_acctbal")),)))


NULLS_SQL = "(SELECT * REPLACE (CASE WHEN c_mktsegment <> 'MACHINERY' THEN c_mktsegment END AS c_mktsegment, CASE WHEN c_acctbal >= 0 THEN c_acctbal END AS c_acctbal) FROM customer) c"


@query("SELECT * FROM nation")
def init_table(t):
    return t("nation")


@query("SELECT * FROM lineitem WHERE l_quantity > 45 AND NOT (l_discount >= 0.05 OR l_returnflag = 'A')")
def filter_rows(t):
    return Filter(t("lineitem"), (col("l_quantity") > 45) & ~((col("l_discount") >= 0.05) | (col("l_returnflag") == "A")))


@query(f"SELECT c_custkey, c_mktsegment FROM {NULLS_SQL} WHERE NOT COALESCE(c_mktsegment = 'BUILDING', FALSE)")
def filter_two_valued_not(t):
    return Select(Filter(with_nulls(t), Not(col("c_mktsegment") == "BUILDING", two_valued=True)), ["c_custkey", "c_mktsegment"])


@query("SELECT p_partkey, p_name FROM part WHERE contains(p_name, 'blue') AND (p_brand, p_size) IN (('Brand#1', 1), ('Brand#2', 2), ('Brand#3', 3), ('Brand#4', 4), ('Brand#5', 5))")
def filter_contains_tuples(t):
    rows = tuple((f"Brand#{i}", i) for i in range(1, 6))
    return Select(Filter(t("part"), Contains(col("p_name"), Lit("blue")) & InTuples((col("p_brand"), col("p_size")), rows)), ["p_partkey", "p_name"])


@query("SELECT * REPLACE (l_extendedprice * (1 - l_discount) AS l_extendedprice), CASE WHEN l_quantity > 25 THEN 'big' ELSE 'small' END AS kind FROM lineitem")
def set_item(t):
    return SetItem(SetItem(t("lineitem"), "l_extendedprice", col("l_extendedprice") * (1 - col("l_discount"))), "kind", Case(((col("l_quantity") > 25, Lit("big")),), Lit("small")))


def _shout(names):
    return names.str.upper() + "!"


@query("SELECT p_partkey, upper(p_name) || '!' AS loud FROM part")
def set_item_python(t):
    return Select(SetItem(t("part"), "loud", Opaque(_shout, (col("p_name"),), "string")), ["p_partkey", "loud"])


@query("SELECT o_orderkey, round(o_totalprice / (SELECT avg(o_totalprice) FROM orders), 6) AS share FROM orders")
def set_item_with_dependency(t):
    mean = AllAggregate(t("orders"), [agg("mean", "o_totalprice", "m")])
    return Select(SetItemWithDependency(t("orders"), "share", {"m": mean}, call("round", col("o_totalprice") / col("m"), 6)), ["o_orderkey", "share"])


@query("SELECT n_nationkey AS id, n_name, n_regionkey AS region FROM nation")
def rename(t):
    return Rename(t("nation"), {"n_nationkey": "id", "n_regionkey": "region"})


@query("SELECT * FROM region")
def copy(t):
    return Copy(t("region"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def drop_columns(t):
    return DropColumns(t("orders"), ["o_orderstatus", "o_orderdate", "o_orderpriority"])


@query("SELECT o_orderkey, CAST(trunc(o_totalprice) AS BIGINT) AS whole, CAST(o_orderkey AS VARCHAR) AS o_key, CAST(o_custkey AS DOUBLE) AS cust FROM orders")
def change_type(t):
    c = ChangeType(ChangeType(ChangeType(t("orders"), "int", "o_totalprice", "whole"), "str", "o_orderkey", "o_key"), "float", "o_custkey", "cust")
    return Select(c, ["o_orderkey", "whole", "o_key", "cust"])


@query("SELECT event_id, TRY_CAST(left(CAST(ts AS VARCHAR), 19) AS TIMESTAMP) AS at, TRY_CAST(event_type AS BIGINT) AS none FROM events")
def change_type_dirty(t):
    s = SetItem(ChangeType(t("events"), "str", "ts", "text"), "text", call("substring", col("text"), 1, 19))
    return Select(ChangeType(ChangeType(s, "datetime", "text", "at"), "int", "event_type", "none"), ["event_id", "at", "none"])


@query(f"SELECT * FROM {NULLS_SQL} WHERE c_mktsegment IS NOT NULL AND c_acctbal IS NOT NULL")
def drop_na(t):
    return DropNA(with_nulls(t), ["c_mktsegment", "c_acctbal"])


@query(f"SELECT * REPLACE (coalesce(c_mktsegment, 'BUILDING') AS c_mktsegment) FROM {NULLS_SQL}")
def fill_na(t):
    return FillNA(with_nulls(t), "c_mktsegment", "BUILDING")


@query("SELECT *, nullif(split_part(p_name, ' ', 1), '') AS adjective, nullif(split_part(p_name, ' ', 2), '') AS noun, nullif(split_part(p_name, ' ', 3), '') AS more FROM part")
def split_by(t):
    return Split(t("part"), "p_name", ["adjective", "noun", "more"], by=" ")


@query("SELECT *, regexp_extract(p_brand, '^([A-Za-z]+)#(\\d+)$', 1) AS word, regexp_extract(p_brand, '^([A-Za-z]+)#(\\d+)$', 2) AS number FROM part")
def split_regex(t):
    return Split(t("part"), "p_brand", ["word", "number"], regex="^([A-Za-z]+)#(\\d+)$")


@query("SELECT * EXCLUDE (o_orderstatus), CAST(o_orderstatus = 'F' AS INTEGER) AS \"o_orderstatus_F\", CAST(o_orderstatus = 'O' AS INTEGER) AS \"o_orderstatus_O\" FROM orders")
def get_dummies(t):
    return GetDummies(t("orders"), {"o_orderstatus": ["F", "O"]})


@query("SELECT o_orderkey, o_totalprice, o_custkey, o_orderstatus FROM orders")
def concat_column(t):
    return ConcatColumn(Select(t("orders"), ["o_orderkey", "o_totalprice"]), Select(t("orders"), ["o_orderkey", "o_custkey", "o_orderstatus"]), ["o_orderkey"])


@query("SELECT coalesce(a.k, b.k) AS k, coalesce(a.v, b.v) AS v FROM (SELECT c_custkey AS k, c_acctbal AS v FROM customer WHERE c_nationkey < 15) a FULL JOIN (SELECT c_custkey AS k, 0.0::DOUBLE AS v FROM customer WHERE c_nationkey > 10) b ON a.k = b.k")
def combine(t):
    c = Rename(Select(t("customer"), ["c_custkey", "c_acctbal", "c_nationkey"]), {"c_custkey": "k", "c_acctbal": "v"})
    a, b = Filter(c, col("c_nationkey") < 15), Filter(c, col("c_nationkey") > 10)
    return Combine(Select(a, ["k", "v"]), Select(SetItem(b, "v", Lit(0.0)), ["k", "v"]), ["k"])


@query("SELECT a.n_nationkey AS n_nationkey_x, a.n_name AS n_name_x, a.n_regionkey, b.n_nationkey AS n_nationkey_y, b.n_name AS n_name_y FROM nation a JOIN nation b ON a.n_regionkey = b.n_regionkey")
def inner_join_suffixes(t):
    return InnerJoin(t("nation"), t("nation"), ["n_regionkey"])


@query("SELECT * FROM orders LEFT JOIN lineitem ON o_orderkey = l_orderkey")
def left_outer_join(t):
    return LeftOuterJoin(t("orders"), t("lineitem"), ["o_orderkey"], ["l_orderkey"])


@query(f"SELECT c.c_custkey AS a, d.s_suppkey AS b FROM {NULLS_SQL} JOIN (SELECT s_suppkey, CASE WHEN s_acctbal >= 5000 THEN 'BUILDING' END AS seg FROM supplier) d ON c.c_mktsegment IS NOT DISTINCT FROM d.seg")
def inner_join_null_keys(t):
    s = SetItem(t("supplier"), "seg", Case(((col("s_acctbal") >= 5000, Lit("BUILDING")),)))
    c, s = Select(with_nulls(t), ["c_custkey", "c_mktsegment"]), Select(s, ["s_suppkey", "seg"])
    j = InnerJoin(c, s, ["c_mktsegment"], ["seg"], null_safe=True, few_keys=True)
    return Rename(Select(j, ["c_custkey", "s_suppkey"]), {"c_custkey": "a", "s_suppkey": "b"})


@query("SELECT o_orderkey, l_partkey FROM (SELECT * FROM orders WHERE o_orderstatus = 'F') RIGHT JOIN lineitem ON o_orderkey = l_orderkey")
def right_join(t):
    return Select(Join(Filter(t("orders"), col("o_orderstatus") == "F"), t("lineitem"), ["o_orderkey"], ["l_orderkey"], how="right"), ["o_orderkey", "l_partkey"])


@query("SELECT coalesce(a.k, b.k) AS k, x, y FROM (SELECT n_nationkey AS k, n_name AS x FROM nation WHERE n_nationkey < 15) a FULL JOIN (SELECT n_nationkey AS k, n_regionkey AS y FROM nation WHERE n_nationkey > 10) b ON a.k = b.k")
def full_join(t):
    a = Rename(Select(Filter(t("nation"), col("n_nationkey") < 15), ["n_nationkey", "n_name"]), {"n_nationkey": "k", "n_name": "x"})
    b = Rename(Select(Filter(t("nation"), col("n_nationkey") > 10), ["n_nationkey", "n_regionkey"]), {"n_nationkey": "k", "n_regionkey": "y"})
    return Join(a, b, ["k"], how="full")


@query("SELECT l_orderkey, l_partkey, l_extendedprice, o_orderdate FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate < o_orderdate + INTERVAL 0 DAY OR l_quantity * 1000 > o_totalprice")
def theta_join(t):
    j = InnerJoin(t("lineitem"), t("orders"), ["l_orderkey"], ["o_orderkey"], condition=(col("l_shipdate") < col("o_orderdate")) | (col("l_quantity") * 1000 > col("o_totalprice")))
    return Select(j, ["l_orderkey", "l_partkey", "l_extendedprice", "o_orderdate"])


@query("SELECT * FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def semi_join(t):
    return SemiJoin(t("customer"), Filter(t("orders"), col("o_totalprice") > 300000), ["c_custkey"], ["o_custkey"])


@query("SELECT * FROM orders WHERE NOT EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey)")
def anti_join(t):
    return AntiJoin(t("orders"), t("lineitem"), ["o_orderkey"], ["l_orderkey"])


@query(f"SELECT n_nationkey FROM nation WHERE n_nationkey NOT IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9990) UNION ALL SELECT n_nationkey FROM nation WHERE n_name NOT IN (SELECT c_mktsegment FROM {NULLS_SQL})")
def not_in(t):
    few = NotIn(t("nation"), Filter(t("customer"), col("c_acctbal") > 9990), "n_nationkey", "c_nationkey")
    none = NotIn(t("nation"), with_nulls(t), "n_name", "c_mktsegment")
    return Append([Select(few, ["n_nationkey"]), Select(none, ["n_nationkey"])])


@query(f"""SELECT c_mktsegment, count(*) AS n, count(c_acctbal) AS known, round(sum(c_acctbal), 2) AS total, round(avg(c_acctbal), 4) AS mean, max(c_acctbal) AS most, min(c_acctbal) AS least,
    count(DISTINCT c_nationkey) AS nations, round(sum(CASE WHEN c_nationkey < 5 THEN c_acctbal END), 2) AS some FROM {NULLS_SQL} GROUP BY c_mktsegment""")
def group_by(t):
    g = GroupBy(with_nulls(t), ["c_mktsegment"], [
        agg("count", alias="n"), agg("count", "c_acctbal", "known"), agg("sum", "c_acctbal", "total"), agg("mean", "c_acctbal", "mean"), agg("max", "c_acctbal", "most"), agg("min", "c_acctbal", "least"),
        agg("count_distinct", "c_nationkey", "nations"), agg("sum", "c_acctbal", "some", when=col("c_nationkey") < 5)])
    for c, n in (("total", 2), ("mean", 4), ("some", 2)):
        g = SetItem(g, c, call("round", col(c), n))
    return g


@query("SELECT o_orderstatus, array_to_string(list_sort(list_distinct(list(o_orderpriority))), ';') AS kinds FROM orders GROUP BY o_orderstatus")
def group_by_unique(t):
    from pyspark.sql import functions as F

    from ..functions import register

    register("join_text", lambda c, by: F.array_join(c, by), lambda v, by: by.join(v), "ARRAY_TO_STRING({all})")
    return SetItem(GroupBy(t("orders"), ["o_orderstatus"], [agg("unique", "o_orderpriority", "kinds")]), "kinds", call("join_text", col("kinds"), ";"))


@query("SELECT l_returnflag, l_linestatus, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)")
def grouping_sets(t):
    return GroupingSets(t("lineitem"), ["l_returnflag", "l_linestatus"], [agg("count", alias="n")])


@query("SELECT l_returnflag, l_linestatus, sum(l_linenumber) AS n FROM lineitem GROUP BY ROLLUP (l_returnflag, l_linestatus)")
def rollup(t):
    return GroupingSets(t("lineitem"), ["l_returnflag", "l_linestatus"], [agg("sum", "l_linenumber", "n")], "rollup")


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n, max(o_orderdate) AS last FROM orders GROUP BY GROUPING SETS ((o_orderstatus), (o_orderpriority), ())")
def explicit_grouping_sets(t):
    return GroupingSets(t("orders"), ["o_orderstatus", "o_orderpriority"], [agg("count", alias="n"), agg("max", "o_orderdate", "last")], [["o_orderstatus"], ["o_orderpriority"], []])


@query(f"SELECT c_custkey, least(c_acctbal, 100.0) AS low, greatest(c_acctbal, 5000.0) AS high, least(c_acctbal, c_nationkey) AS both, greatest(c_acctbal, NULL) AS same FROM {NULLS_SQL}")
def min_max_of_two(t):
    c = SetItem(SetItem(with_nulls(t), "low", Arith("min", col("c_acctbal"), Lit(100.0))), "high", Arith("max", col("c_acctbal"), Lit(5000.0)))
    c = SetItem(SetItem(c, "both", call("least", col("c_acctbal"), col("c_nationkey"))), "same", call("greatest", col("c_acctbal"), Cast(Lit(None), "double")))
    return Select(c, ["c_custkey", "low", "high", "both", "same"])


@query("SELECT count(*) AS n, max(o_totalprice) AS most, min(o_orderdate) AS first FROM orders")
def all_aggregate(t):
    return AllAggregate(t("orders"), [agg("count", alias="n"), agg("max", "o_totalprice", "most"), agg("min", "o_orderdate", "first")])


@query("SELECT max(l_quantity * 100 + l_linenumber) AS best FROM lineitem")
def all_aggregate_fold(t):
    fold = (0.0, lambda s, row: max(s, row["l_quantity"] * 100 + row["l_linenumber"]), max)
    return AllAggregate(Select(t("lineitem"), ["l_quantity", "l_linenumber"]), fold=fold, alias="best")


@query("SELECT DISTINCT ON (o_custkey, o_orderstatus) o_custkey, o_orderstatus, o_orderkey FROM orders ORDER BY o_custkey, o_orderstatus, o_orderkey")
def drop_duplicate(t):
    return DropDuplicate(Select(t("orders"), ["o_custkey", "o_orderstatus", "o_orderkey"]), ["o_custkey", "o_orderstatus"], ["o_orderkey"])


@query("SELECT event_id, ts, round(sum(value) OVER (ORDER BY ts, event_id), 4) AS total FROM events")
def cum_sum(t):
    c = CumAggr(Select(t("events"), ["event_id", "ts", "value"]), "value", "sum", ["ts", "event_id"], "total")
    return Select(SetItem(c, "total", call("round", col("total"), 4)), ["event_id", "ts", "total"])


@query("""SELECT event_id, user_id, product(f) OVER w AS p, count(f) OVER w AS n, min(value) OVER w AS least FROM (SELECT *, CASE WHEN event_id % 3 > 0 THEN CASE WHEN event_id % 2 = 0 THEN 2.0 ELSE 0.5 END END AS f FROM events)
    WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)""")
def cum_prod_count_min_by_user(t):
    odd = Case(((Cast(Cast(col("event_id") / 2, "bigint") * 2, "bigint") == col("event_id"), Lit(2.0)),), Lit(0.5))
    e = SetItem(t("events"), "f", Case(((Cast(col("event_id") / 3, "bigint") * 3 != col("event_id"), odd),)))
    for column, fn, new in (("f", "prod", "p"), ("f", "count", "n"), ("value", "min", "least")):
        e = CumAggr(e, column, fn, ["ts", "event_id"], new, partition_by=["user_id"])
    return Select(e, ["event_id", "user_id", "p", "n", "least"])


@query("SELECT row_number() OVER (ORDER BY p_brand, p_partkey) AS place, p_partkey FROM part")
def cum_count_by_name(t):
    c = CumAggr(Select(t("part"), ["p_brand", "p_partkey"]), "p_partkey", "count", ["p_brand", "p_partkey"], "place")
    return Select(c, ["place", "p_partkey"])


@query("SELECT event_id, user_id, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS best FROM events")
def cum_max_by_user(t):
    return Select(CumAggr(t("events"), "value", "max", ["ts", "event_id"], "best", partition_by=["user_id"]), ["event_id", "user_id", "best"])


@query("""SELECT o_orderpriority, round(sum(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END), 2) AS "F", round(sum(CASE WHEN o_orderstatus = 'O' THEN o_totalprice END), 2) AS "O",
    round(sum(CASE WHEN o_orderstatus = 'P' THEN o_totalprice END), 2) AS "P" FROM orders GROUP BY o_orderpriority""")
def pivot(t):
    p = Pivot(t("orders"), ["o_orderpriority"], "o_orderstatus", "o_totalprice", ["F", "O", "P"], "sum")
    for c in "FOP":
        p = SetItem(p, c, call("round", col(c), 2))
    return p


PLACES_SQL = ", ".join(f'max(CASE WHEN n_nationkey // 5 = {i} THEN n_name END) AS "{i}"' for i in range(5))


@query(f"SELECT n_regionkey, {PLACES_SQL} FROM nation GROUP BY n_regionkey")
def pivot_values(t):
    n = SetItem(t("nation"), "place", Case(tuple((col("n_nationkey") < 5 * i, Lit(i - 1)) for i in range(1, 5)), Lit(4)))
    return Pivot(n, ["n_regionkey"], "place", "n_name", [0, 1, 2, 3, 4], None)


@query("SELECT l_orderkey, variable, value FROM (SELECT l_orderkey, l_quantity, l_discount, l_tax FROM lineitem) UNPIVOT INCLUDE NULLS (value FOR variable IN (l_quantity, l_discount, l_tax))")
def unpivot(t):
    return UnPivot(t("lineitem"), ["l_orderkey"], ["l_quantity", "l_discount", "l_tax"])


@query("SELECT s_suppkey, s_name, s_acctbal FROM supplier")
def sort_values(t):
    return SortValues(Select(t("supplier"), ["s_suppkey", "s_name", "s_acctbal"]), ["s_acctbal", "s_suppkey"], [True, False])


@query("SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderdate LIMIT 15")
def top_n(t):
    return TopN(t("orders"), 15, ["o_totalprice", "o_orderdate"], [True, False])


@query("SELECT c_custkey AS id, c_name AS name, c_acctbal FROM customer UNION ALL SELECT s_suppkey, s_name, NULL FROM supplier")
def append(t):
    c = Rename(Select(t("customer"), ["c_custkey", "c_name", "c_acctbal"]), {"c_custkey": "id", "c_name": "name"})
    return Append([c, Rename(Select(t("supplier"), ["s_suppkey", "s_name"]), {"s_suppkey": "id", "s_name": "name"})])


@query("SELECT round((SELECT sum(l_tax) FROM lineitem) / (SELECT count(*) FROM orders), 6) AS value")
def scalar_computation(t):
    return ScalarComputation({"a": AllAggregate(t("lineitem"), [agg("sum", "l_tax", "a")]), "b": AllAggregate(t("orders"), [agg("count", alias="b")])}, call("round", col("a") / col("b"), 6))


@query("SELECT p_partkey, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey AND l_quantity < p_size) AS small FROM part")
def crosstable_condition(t):
    q = Subquery(SubpipeInput(t("lineitem")), [("p_partkey", "l_partkey")], agg("count", alias="small"), condition=col("l_quantity") < outer("p_size"))
    return Select(CrosstableUDF(t("part"), "small", q), ["p_partkey", "small"])


@query("""SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN (SELECT max(o_totalprice) FROM orders WHERE o_custkey = c_custkey) WHEN c_mktsegment = 'MACHINERY' THEN c_acctbal
    ELSE (SELECT min(o_totalprice) FROM orders WHERE o_custkey = c_custkey) END AS v FROM customer""")
def crosstable_branches(t):
    by = [("c_custkey", "o_custkey")]
    paths = SubPipeline([
        PipelinePath(Subquery(t("orders"), by, agg("max", "o_totalprice", "v")), col("c_mktsegment") == "BUILDING"), PipelinePath(col("c_acctbal"), col("c_mktsegment") == "MACHINERY"),
        PipelinePath(Subquery(t("orders"), by, agg("min", "o_totalprice", "v")))])
    return Select(CrosstableUDF(t("customer"), "v", paths), ["c_custkey", "v"])


@query("SELECT o_custkey, max(o_totalprice) AS \"0\" FROM orders GROUP BY o_custkey")
def grouped_map_scalar(t):
    return GroupedMap(t("orders"), ["o_custkey"], [agg("max", "o_totalprice", "0")])


def _gaps(pdf):
    import pandas as pd

    days = pdf["o_orderdate"].to_numpy("datetime64[D]")
    return pd.DataFrame({"orders": [len(days)], "span": [int((days.max() - days.min()).astype(int))]})


@query("SELECT o_custkey, count(*) AS orders, CAST(date_diff('day', CAST(min(o_orderdate) AS DATE), CAST(max(o_orderdate) AS DATE)) AS BIGINT) AS span FROM orders GROUP BY o_custkey")
def grouped_map_table(t):
    return GroupedMap(Select(t("orders"), ["o_custkey", "o_orderdate"]), ["o_custkey"], fn=_gaps, schema="orders bigint, span bigint")


def _balance(a, b):
    import pandas as pd

    return pd.DataFrame({"customers": [len(a)], "suppliers": [len(b)]})


@query("SELECT k AS nation, count(c_custkey) AS customers, count(s_suppkey) AS suppliers FROM (SELECT c_nationkey AS k, c_custkey, NULL AS s_suppkey FROM customer UNION ALL SELECT s_nationkey, NULL, s_suppkey FROM supplier) GROUP BY k")
def cogrouped_map(t):
    return CogroupedMap(Rename(t("customer"), {"c_nationkey": "nation"}), Rename(t("supplier"), {"s_nationkey": "nation"}), ["nation"], _balance, "customers bigint, suppliers bigint")


@query("""WITH e AS (SELECT CASE WHEN event_type <> 'error' THEN CAST(ts AS DATE) END AS date, value, event_type FROM events)
    SELECT date, round(sum(value), 4) AS frequency FROM e WHERE date IS NOT NULL AND event_type IN ('click', 'view', 'purchase', 'error') GROUP BY date""")
def notebook_search_frequency(t):
    def part(kind):
        e = SetItem(t("events"), "date", Case(((col("event_type") != "error", call("to_date", col("ts"))),)))
        return DropNA(Filter(e, col("event_type") == kind), ["date"])

    a = Append([Append([Append([part("click"), part("view")]), part("purchase")]), part("error")])
    g = GroupBy(SortValues(a, ["date"]), ["date"], [agg("sum", "value", "frequency")])
    return SetItem(g, "frequency", call("round", col("frequency"), 4))


@query("SELECT s_suppkey, s_acctbal, c_custkey, c_acctbal, c_acctbal + c_nationkey AS upto FROM supplier, customer WHERE s_acctbal BETWEEN c_acctbal AND c_acctbal + c_nationkey")
def interval_join(t):
    c = SetItem(Select(t("customer"), ["c_custkey", "c_acctbal", "c_nationkey"]), "upto", col("c_acctbal") + col("c_nationkey"))
    return DropColumns(IntervalJoin(Select(t("supplier"), ["s_suppkey", "s_acctbal"]), c, "s_acctbal", "c_acctbal", "upto"), ["c_nationkey"])


@query("""SELECT s.s_suppkey, c.c_custkey, c.c_nationkey FROM supplier s JOIN customer c ON s_nationkey = c_nationkey AND s_acctbal >= c_acctbal AND s_acctbal < c_acctbal + 500""")
def interval_join_by_nation(t):
    c = SetItem(Select(t("customer"), ["c_custkey", "c_acctbal", "c_nationkey"]), "upto", col("c_acctbal") + 500)
    j = IntervalJoin(Select(t("supplier"), ["s_suppkey", "s_acctbal", "s_nationkey"]), c, "s_acctbal", "c_acctbal", "upto", by=[("s_nationkey", "c_nationkey")], closed=False)
    return Select(j, ["s_suppkey", "c_custkey", "c_nationkey"])


def _events(t: Tables, kind: str, *columns: str) -> Node:
    return Select(Filter(t("events"), col("event_type") == kind), list(columns))


@query("""WITH p AS (SELECT * FROM events WHERE event_type = 'purchase'), c AS (SELECT * FROM events WHERE event_type = 'click')
    SELECT p.event_id, p.user_id, p.ts, c.event_id AS click, c.ts AS clicked FROM p ASOF LEFT JOIN c ON p.user_id = c.user_id AND p.ts >= c.ts""")
def as_of_join(t):
    clicks = Rename(_events(t, "click", "event_id", "user_id", "ts"), {"event_id": "click", "ts": "clicked"})
    return AsOfJoin(_events(t, "purchase", "event_id", "user_id", "ts"), clicks, "ts", "clicked", by=[("user_id", "user_id")])


@query("""WITH e AS (SELECT * FROM events WHERE event_type = 'error'), v AS (SELECT * FROM events WHERE event_type = 'view')
    SELECT e.event_id, e.ts, v.event_id AS event_id_y, v.ts AS ts_y, v.value FROM e ASOF LEFT JOIN v ON e.ts > v.ts""")
def as_of_join_global(t):
    return AsOfJoin(_events(t, "error", "event_id", "ts"), _events(t, "view", "event_id", "ts", "value"), "ts", "ts", strict=True)
