"""Decision-support queries as pipelines, each with SQL that gives the same rows.

The shapes are those of the 22 TPC-H queries, put in terms of the tables at hand:
what a part's supplier offers is aggregated from line items, and columns that are not
there are replaced by ones that are.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable

from ..functions import call
from ..operators import (
    AllAggregate, AntiJoin, CrosstableUDF, DropColumns, Filter, GroupBy, InnerJoin, LeftOuterJoin, Node, NotIn, Rename, ScalarComputation, Select, SemiJoin, SetItem, SetItemWithDependency, SortValues,
    Subquery, TopN, agg,
)
from ..predicate import Case, col

Tables = Callable[[str], Node]
REVENUE = col("l_extendedprice") * (1 - col("l_discount"))
REVENUE_SQL = "l_extendedprice * (1 - l_discount)"
#: Line items of each part and supplier, in place of a table of offers.
OFFERS_SQL = "(SELECT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, sum(l_quantity) AS ps_availqty, min(l_extendedprice) / 100 AS ps_supplycost FROM lineitem GROUP BY ALL)"


def day(y: int, m: int, d: int) -> dt.datetime:
    return dt.datetime(y, m, d)


def rounded(dep: Node, *columns: str, digits: int = 2) -> Node:
    for c in columns:
        dep = SetItem(dep, c, call("round", col(c), digits))
    return dep


def offers(t: Tables) -> Node:
    g = GroupBy(t("lineitem"), ["l_partkey", "l_suppkey"], [agg("sum", "l_quantity", "ps_availqty"), agg("min", col("l_extendedprice") / 100, "ps_supplycost")])
    return Rename(g, {"l_partkey": "ps_partkey", "l_suppkey": "ps_suppkey"})


def nation_of(t: Tables, prefix: str) -> Node:
    return Select(Rename(t("nation"), {"n_nationkey": f"{prefix}_key", "n_name": f"{prefix}_nation"}), [f"{prefix}_key", f"{prefix}_nation"])


def q1(t: Tables) -> Node:
    f = Filter(t("lineitem"), col("l_shipdate") <= day(1998, 9, 2))
    charge = REVENUE * (1 + col("l_tax"))
    g = GroupBy(f, ["l_returnflag", "l_linestatus"], [
        agg("sum", "l_quantity", "sum_qty"), agg("sum", "l_extendedprice", "sum_base_price"), agg("sum", REVENUE, "sum_disc_price"), agg("sum", charge, "sum_charge"),
        agg("mean", "l_quantity", "avg_qty"), agg("mean", "l_extendedprice", "avg_price"), agg("mean", "l_discount", "avg_disc"), agg("count", alias="count_order")])
    return SortValues(rounded(g, "sum_qty", "sum_base_price", "sum_disc_price", "sum_charge", "avg_qty", "avg_price", "avg_disc"), ["l_returnflag", "l_linestatus"])


def european(t: Tables) -> Node:
    r = Filter(t("region"), col("r_name") == "EUROPE")
    n = InnerJoin(t("nation"), r, ["n_regionkey"], ["r_regionkey"])
    s = InnerJoin(t("supplier"), n, ["s_nationkey"], ["n_nationkey"])
    return InnerJoin(t("lineitem"), s, ["l_suppkey"], ["s_suppkey"])


def q2(t: Tables) -> Node:
    p = Filter(t("part"), (col("p_size") <= 15) & (col("p_type") == "ECONOMY"))
    offered = InnerJoin(p, european(t), ["p_partkey"], ["l_partkey"])
    least = CrosstableUDF(offered, "least", Subquery(european(t), [("p_partkey", "l_partkey")], agg("min", "l_extendedprice", "least")))
    f = Filter(least, col("l_extendedprice") == col("least"))
    return TopN(Select(f, ["s_acctbal", "s_name", "n_name", "p_partkey", "p_brand", "l_orderkey", "l_linenumber", "l_extendedprice"]), 100, ["s_acctbal", "n_name", "s_name", "p_partkey"], [True, False, False, False])


def q3(t: Tables) -> Node:
    c = Filter(t("customer"), col("c_mktsegment") == "BUILDING")
    o = Filter(t("orders"), col("o_orderdate") < day(1998, 3, 15))
    l = Filter(t("lineitem"), col("l_shipdate") > day(1998, 3, 15))
    j = InnerJoin(InnerJoin(c, o, ["c_custkey"], ["o_custkey"]), l, ["o_orderkey"], ["l_orderkey"])
    g = GroupBy(SetItem(j, "amount", REVENUE), ["l_orderkey", "o_orderdate"], [agg("sum", "amount", "revenue")])
    return TopN(rounded(g, "revenue"), 10, ["revenue", "o_orderdate"], [True, False])


def q4(t: Tables) -> Node:
    o = Filter(t("orders"), (col("o_orderdate") >= day(1996, 7, 1)) & (col("o_orderdate") < day(1996, 10, 1)))
    e = SemiJoin(o, Filter(t("lineitem"), col("l_returnflag") == "R"), ["o_orderkey"], ["l_orderkey"])
    return SortValues(GroupBy(e, ["o_orderpriority"], [agg("count", alias="order_count")]), ["o_orderpriority"])


def q5(t: Tables) -> Node:
    r = Filter(t("region"), col("r_name") == "ASIA")
    n = InnerJoin(t("nation"), r, ["n_regionkey"], ["r_regionkey"])
    s = InnerJoin(t("supplier"), n, ["s_nationkey"], ["n_nationkey"])
    o = Filter(t("orders"), (col("o_orderdate") >= day(1996, 1, 1)) & (col("o_orderdate") < day(1997, 1, 1)))
    co = InnerJoin(t("customer"), o, ["c_custkey"], ["o_custkey"])
    col_ = InnerJoin(co, t("lineitem"), ["o_orderkey"], ["l_orderkey"])
    j = InnerJoin(col_, s, ["l_suppkey", "c_nationkey"], ["s_suppkey", "s_nationkey"])
    return SortValues(rounded(GroupBy(j, ["n_name"], [agg("sum", REVENUE, "revenue")]), "revenue"), ["revenue"], True)


def q6(t: Tables) -> Node:
    f = Filter(t("lineitem"), (col("l_shipdate") >= day(1995, 1, 1)) & (col("l_shipdate") < day(1996, 1, 1)) & col("l_discount").between(0.05, 0.07) & (col("l_quantity") < 24))
    return rounded(AllAggregate(f, [agg("sum", col("l_extendedprice") * col("l_discount"), "revenue")]), "revenue")


def q7(t: Tables) -> Node:
    s = InnerJoin(t("supplier"), nation_of(t, "supp"), ["s_nationkey"], ["supp_key"])
    c = InnerJoin(t("customer"), nation_of(t, "cust"), ["c_nationkey"], ["cust_key"])
    j = InnerJoin(InnerJoin(InnerJoin(t("lineitem"), s, ["l_suppkey"], ["s_suppkey"]), t("orders"), ["l_orderkey"], ["o_orderkey"]), c, ["o_custkey"], ["c_custkey"])
    pair = ((col("supp_nation") == "NATION_1") & (col("cust_nation") == "NATION_2")) | ((col("supp_nation") == "NATION_2") & (col("cust_nation") == "NATION_1"))
    f = SetItem(Filter(j, pair & col("l_shipdate").between(day(1995, 1, 1), day(1998, 12, 31))), "l_year", call("year", col("l_shipdate")))
    g = GroupBy(f, ["supp_nation", "cust_nation", "l_year"], [agg("sum", REVENUE, "revenue")])
    return SortValues(rounded(g, "revenue"), ["supp_nation", "cust_nation", "l_year"])


def q8(t: Tables) -> Node:
    p = Filter(t("part"), col("p_type") == "ECONOMY")
    n1 = InnerJoin(t("nation"), Filter(t("region"), col("r_name") == "AMERICA"), ["n_regionkey"], ["r_regionkey"])
    c = InnerJoin(t("customer"), n1, ["c_nationkey"], ["n_nationkey"])
    o = Filter(t("orders"), col("o_orderdate").between(day(1995, 1, 1), day(1996, 12, 31)))
    s = InnerJoin(t("supplier"), nation_of(t, "supp"), ["s_nationkey"], ["supp_key"])
    j = InnerJoin(InnerJoin(InnerJoin(InnerJoin(t("lineitem"), p, ["l_partkey"], ["p_partkey"]), o, ["l_orderkey"], ["o_orderkey"]), c, ["o_custkey"], ["c_custkey"]), s, ["l_suppkey"], ["s_suppkey"])
    j = SetItem(SetItem(j, "o_year", call("year", col("o_orderdate"))), "volume", REVENUE)
    g = GroupBy(j, ["o_year"], [agg("sum", Case(((col("supp_nation") == "NATION_1", col("volume")),), lit0()), "mine"), agg("sum", "volume", "all")])
    return SortValues(Select(SetItem(g, "mkt_share", call("round", col("mine") / col("all"), 6)), ["o_year", "mkt_share"]), ["o_year"])


def lit0():
    from ..predicate import Lit

    return Lit(0.0)


def q9(t: Tables) -> Node:
    p = Filter(t("part"), col("p_name").like("%blue%"))
    s = InnerJoin(t("supplier"), nation_of(t, "supp"), ["s_nationkey"], ["supp_key"])
    j = InnerJoin(InnerJoin(InnerJoin(t("lineitem"), p, ["l_partkey"], ["p_partkey"]), s, ["l_suppkey"], ["s_suppkey"]), offers(t), ["l_partkey", "l_suppkey"], ["ps_partkey", "ps_suppkey"])
    j = InnerJoin(j, t("orders"), ["l_orderkey"], ["o_orderkey"])
    j = SetItem(SetItem(j, "o_year", call("year", col("o_orderdate"))), "amount", REVENUE - col("ps_supplycost") * col("l_quantity"))
    return SortValues(rounded(GroupBy(j, ["supp_nation", "o_year"], [agg("sum", "amount", "sum_profit")]), "sum_profit"), ["supp_nation", "o_year"], [False, True])


def q10(t: Tables) -> Node:
    o = Filter(t("orders"), (col("o_orderdate") >= day(1996, 10, 1)) & (col("o_orderdate") < day(1997, 1, 1)))
    l = Filter(t("lineitem"), col("l_returnflag") == "R")
    j = InnerJoin(InnerJoin(InnerJoin(t("customer"), o, ["c_custkey"], ["o_custkey"]), l, ["o_orderkey"], ["l_orderkey"]), t("nation"), ["c_nationkey"], ["n_nationkey"])
    g = GroupBy(j, ["c_custkey", "c_name", "c_acctbal", "n_name"], [agg("sum", REVENUE, "revenue")])
    return TopN(rounded(g, "revenue"), 20, ["revenue"], True)


def q11(t: Tables) -> Node:
    s = InnerJoin(t("supplier"), Filter(t("nation"), col("n_name").isin("NATION_1", "NATION_2", "NATION_3")), ["s_nationkey"], ["n_nationkey"])
    j = SetItem(InnerJoin(offers(t), s, ["ps_suppkey"], ["s_suppkey"]), "value", col("ps_supplycost") * col("ps_availqty"))
    total = ScalarComputation({"total": AllAggregate(j, [agg("sum", "value", "total")])}, col("total") * 0.001, "least")
    g = SetItemWithDependency(GroupBy(j, ["ps_partkey"], [agg("sum", "value")]), "least", {"least": total}, col("least"))
    return SortValues(rounded(DropColumns(Filter(g, col("value") > col("least")), ["least"]), "value"), ["value"], True)


def q12(t: Tables) -> Node:
    l = Filter(t("lineitem"), col("l_returnflag").isin("A", "R") & (col("l_shipdate") >= day(1997, 1, 1)) & (col("l_shipdate") < day(1998, 1, 1)))
    j = InnerJoin(t("orders"), l, ["o_orderkey"], ["l_orderkey"])
    f = Filter(j, col("o_orderdate") < col("l_shipdate"))
    urgent = col("o_orderpriority").isin("1-URGENT", "2-HIGH")
    g = GroupBy(f, ["l_linestatus"], [agg("count", alias="high_line_count", when=urgent), agg("count", alias="low_line_count", when=~urgent)])
    return SortValues(g, ["l_linestatus"])


def q13(t: Tables) -> Node:
    l = Filter(t("lineitem"), ~col("l_returnflag").like("N%"))
    per = GroupBy(LeftOuterJoin(t("orders"), l, ["o_orderkey"], ["l_orderkey"]), ["o_orderkey"], [agg("count", "l_partkey", "c_count")])
    return SortValues(GroupBy(per, ["c_count"], [agg("count", alias="dist")]), ["dist", "c_count"], True)


def q14(t: Tables) -> Node:
    l = Filter(t("lineitem"), (col("l_shipdate") >= day(1996, 9, 1)) & (col("l_shipdate") < day(1996, 10, 1)))
    j = InnerJoin(l, t("part"), ["l_partkey"], ["p_partkey"])
    a = AllAggregate(j, [agg("sum", Case(((col("p_type").like("PROMO%"), REVENUE),), lit0()), "promo"), agg("sum", REVENUE, "total")])
    return Select(SetItem(a, "promo_revenue", call("round", col("promo") * 100.0 / col("total"), 6)), ["promo_revenue"])


def q15(t: Tables) -> Node:
    l = Filter(t("lineitem"), (col("l_shipdate") >= day(1996, 1, 1)) & (col("l_shipdate") < day(1996, 4, 1)))
    view = rounded(GroupBy(l, ["l_suppkey"], [agg("sum", REVENUE, "total_revenue")]), "total_revenue")
    best = ScalarComputation({"m": AllAggregate(view, [agg("max", "total_revenue", "m")])}, col("m"), "m")
    f = Filter(SetItemWithDependency(view, "most", {"m": best}, col("m")), col("total_revenue") == col("most"))
    return Select(InnerJoin(t("supplier"), f, ["s_suppkey"], ["l_suppkey"]), ["s_suppkey", "s_name", "total_revenue"])


def q16(t: Tables) -> Node:
    p = Filter(t("part"), (col("p_brand") != "Brand#9") & ~col("p_type").like("MEDIUM%") & col("p_size").isin(3, 9, 14, 19, 23, 36, 45, 49))
    ps = NotIn(Select(t("lineitem"), ["l_partkey", "l_suppkey"]), Select(Filter(t("supplier"), col("s_acctbal") < 0), ["s_suppkey"]), "l_suppkey", "s_suppkey")
    g = GroupBy(InnerJoin(ps, p, ["l_partkey"], ["p_partkey"]), ["p_brand", "p_type", "p_size"], [agg("count_distinct", "l_suppkey", "supplier_cnt")])
    return SortValues(g, ["supplier_cnt", "p_brand", "p_type", "p_size"], [True, False, False, False])


def q17(t: Tables) -> Node:
    j = InnerJoin(t("lineitem"), Filter(t("part"), col("p_brand") == "Brand#23"), ["l_partkey"], ["p_partkey"])
    c = CrosstableUDF(j, "avg_qty", Subquery(t("lineitem"), [("l_partkey", "l_partkey")], agg("mean", "l_quantity", "avg_qty")))
    f = Filter(c, col("l_quantity") < col("avg_qty") * 0.5)
    a = AllAggregate(f, [agg("sum", "l_extendedprice", "total")])
    return Select(SetItem(a, "avg_yearly", call("round", col("total") / 7.0, 2)), ["avg_yearly"])


def q18(t: Tables) -> Node:
    big = Filter(GroupBy(t("lineitem"), ["l_orderkey"], [agg("sum", "l_quantity", "qty")]), col("qty") > 250)
    o = SemiJoin(t("orders"), big, ["o_orderkey"], ["l_orderkey"])
    j = InnerJoin(InnerJoin(t("customer"), o, ["c_custkey"], ["o_custkey"]), t("lineitem"), ["o_orderkey"], ["l_orderkey"])
    g = GroupBy(j, ["c_name", "c_custkey", "o_orderkey", "o_orderdate", "o_totalprice"], [agg("sum", "l_quantity", "sum_qty")])
    return TopN(g, 100, ["o_totalprice", "o_orderdate"], [True, False])


def q19(t: Tables) -> Node:
    j = InnerJoin(t("lineitem"), t("part"), ["l_partkey"], ["p_partkey"])
    one = (col("p_brand") == "Brand#12") & col("l_quantity").between(1, 11) & col("p_size").between(1, 5)
    two = (col("p_brand") == "Brand#23") & col("l_quantity").between(10, 20) & col("p_size").between(1, 10)
    three = (col("p_brand") == "Brand#4") & col("l_quantity").between(20, 30) & col("p_size").between(1, 15)
    return rounded(AllAggregate(Filter(j, one | two | three), [agg("sum", REVENUE, "revenue")]), "revenue")


def q20(t: Tables) -> Node:
    l = Filter(t("lineitem"), (col("l_shipdate") >= day(1996, 1, 1)) & (col("l_shipdate") < day(1997, 1, 1)))
    ps = SemiJoin(offers(t), Filter(t("part"), col("p_name").like("blue%")), ["ps_partkey"], ["p_partkey"])
    c = CrosstableUDF(ps, "sold", Subquery(l, [("ps_partkey", "l_partkey"), ("ps_suppkey", "l_suppkey")], agg("sum", "l_quantity", "sold")))
    f = Filter(c, col("ps_availqty") > col("sold") * 0.5)
    s = InnerJoin(t("supplier"), Filter(t("nation"), col("n_nationkey") < 10), ["s_nationkey"], ["n_nationkey"])
    return SortValues(Select(SemiJoin(s, f, ["s_suppkey"], ["ps_suppkey"]), ["s_suppkey", "s_name", "n_name"]), ["s_name"])


def q21(t: Tables) -> Node:
    s = InnerJoin(t("supplier"), Filter(t("nation"), col("n_nationkey") < 5), ["s_nationkey"], ["n_nationkey"])
    late = Filter(t("lineitem"), col("l_returnflag") == "R")
    l1 = InnerJoin(late, Filter(t("orders"), col("o_orderstatus") == "F"), ["l_orderkey"], ["o_orderkey"])
    l1 = InnerJoin(l1, s, ["l_suppkey"], ["s_suppkey"])
    other = col("right.l_suppkey") != col("l_suppkey")
    e = SemiJoin(l1, t("lineitem"), ["l_orderkey"], ["l_orderkey"], condition=other)
    a = AntiJoin(e, late, ["l_orderkey"], ["l_orderkey"], condition=other)
    return TopN(GroupBy(a, ["s_name"], [agg("count", alias="numwait")]), 100, ["numwait", "s_name"], [True, False])


def q22(t: Tables) -> Node:
    c = Filter(t("customer"), col("c_nationkey").isin(1, 3, 5, 7, 9, 11, 13))
    average = ScalarComputation({"a": AllAggregate(Filter(c, col("c_acctbal") > 0), [agg("mean", "c_acctbal", "a")])}, col("a"), "a")
    rich = Filter(SetItemWithDependency(c, "average", {"a": average}, col("a")), col("c_acctbal") > col("average"))
    n = AntiJoin(rich, Filter(t("orders"), col("o_orderstatus") == "P"), ["c_custkey"], ["o_custkey"])
    g = GroupBy(n, ["c_nationkey"], [agg("count", alias="numcust"), agg("sum", "c_acctbal", "totacctbal")])
    return SortValues(rounded(g, "totacctbal"), ["c_nationkey"])


#: DuckDB SQL of each query.
SQL: dict[str, str] = {
    "q1": f"""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum({REVENUE_SQL}), 2) AS sum_disc_price,
        round(sum({REVENUE_SQL} * (1 + l_tax)), 2) AS sum_charge, round(avg(l_quantity), 2) AS avg_qty, round(avg(l_extendedprice), 2) AS avg_price, round(avg(l_discount), 2) AS avg_disc, count(*) AS count_order
        FROM lineitem WHERE l_shipdate <= TIMESTAMP '1998-09-02' GROUP BY ALL""",
    "q2": """WITH e AS (SELECT * FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'EUROPE')
        SELECT s_acctbal, s_name, n_name, p_partkey, p_brand, l_orderkey, l_linenumber, l_extendedprice FROM part JOIN e ON p_partkey = l_partkey
        WHERE p_size <= 15 AND p_type = 'ECONOMY' AND l_extendedprice = (SELECT min(x.l_extendedprice) FROM e x WHERE x.l_partkey = p_partkey)
        ORDER BY s_acctbal DESC, n_name, s_name, p_partkey, p_brand, l_orderkey, l_linenumber, l_extendedprice LIMIT 100""",
    "q3": f"""SELECT l_orderkey, o_orderdate, round(sum({REVENUE_SQL}), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey
        WHERE c_mktsegment = 'BUILDING' AND o_orderdate < TIMESTAMP '1998-03-15' AND l_shipdate > TIMESTAMP '1998-03-15' GROUP BY l_orderkey, o_orderdate ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 10""",
    "q4": """SELECT o_orderpriority, count(*) AS order_count FROM orders WHERE o_orderdate >= TIMESTAMP '1996-07-01' AND o_orderdate < TIMESTAMP '1996-10-01'
        AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R') GROUP BY ALL""",
    "q5": f"""SELECT n_name, round(sum({REVENUE_SQL}), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey AND c_nationkey = s_nationkey
        JOIN nation ON s_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = 'ASIA' AND o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01' GROUP BY ALL""",
    "q6": """SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem
        WHERE l_shipdate >= TIMESTAMP '1995-01-01' AND l_shipdate < TIMESTAMP '1996-01-01' AND l_discount >= CAST(0.05 AS DOUBLE) AND l_discount <= CAST(0.07 AS DOUBLE) AND l_quantity < 24""",
    "q7": f"""SELECT a.n_name AS supp_nation, b.n_name AS cust_nation, CAST(year(l_shipdate) AS INTEGER) AS l_year, round(sum({REVENUE_SQL}), 2) AS revenue
        FROM lineitem JOIN supplier ON l_suppkey = s_suppkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation a ON s_nationkey = a.n_nationkey JOIN nation b ON c_nationkey = b.n_nationkey
        WHERE ((a.n_name = 'NATION_1' AND b.n_name = 'NATION_2') OR (a.n_name = 'NATION_2' AND b.n_name = 'NATION_1')) AND l_shipdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1998-12-31' GROUP BY ALL""",
    "q8": f"""SELECT CAST(year(o_orderdate) AS INTEGER) AS o_year, round(sum(CASE WHEN b.n_name = 'NATION_1' THEN {REVENUE_SQL} ELSE 0 END) / sum({REVENUE_SQL}), 6) AS mkt_share
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation a ON c_nationkey = a.n_nationkey JOIN region ON a.n_regionkey = r_regionkey
        JOIN supplier ON l_suppkey = s_suppkey JOIN nation b ON s_nationkey = b.n_nationkey WHERE p_type = 'ECONOMY' AND r_name = 'AMERICA' AND o_orderdate BETWEEN TIMESTAMP '1995-01-01' AND TIMESTAMP '1996-12-31' GROUP BY ALL""",
    "q9": f"""SELECT n_name AS supp_nation, CAST(year(o_orderdate) AS INTEGER) AS o_year, round(sum({REVENUE_SQL} - ps_supplycost * l_quantity), 2) AS sum_profit
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey JOIN {OFFERS_SQL} o ON l_partkey = ps_partkey AND l_suppkey = ps_suppkey
        JOIN orders ON l_orderkey = o_orderkey WHERE p_name LIKE '%blue%' GROUP BY ALL""",
    "q10": f"""SELECT c_custkey, c_name, c_acctbal, n_name, round(sum({REVENUE_SQL}), 2) AS revenue FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON l_orderkey = o_orderkey JOIN nation ON c_nationkey = n_nationkey
        WHERE o_orderdate >= TIMESTAMP '1996-10-01' AND o_orderdate < TIMESTAMP '1997-01-01' AND l_returnflag = 'R' GROUP BY c_custkey, c_name, c_acctbal, n_name ORDER BY revenue DESC, c_custkey, c_name, c_acctbal, n_name LIMIT 20""",
    "q11": f"""WITH v AS (SELECT ps_partkey, ps_supplycost * ps_availqty AS value FROM {OFFERS_SQL} o JOIN supplier ON ps_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey WHERE n_name IN ('NATION_1', 'NATION_2', 'NATION_3'))
        SELECT ps_partkey, round(sum(value), 2) AS value FROM v GROUP BY ps_partkey HAVING sum(value) > (SELECT sum(value) * 0.001 FROM v)""",
    "q12": """SELECT l_linestatus, count(*) FILTER (WHERE o_orderpriority IN ('1-URGENT', '2-HIGH')) AS high_line_count, count(*) FILTER (WHERE o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS low_line_count
        FROM orders JOIN lineitem ON o_orderkey = l_orderkey WHERE l_returnflag IN ('A', 'R') AND l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND o_orderdate < l_shipdate GROUP BY ALL""",
    "q13": """WITH c AS (SELECT o_orderkey, count(l_partkey) AS c_count FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag NOT LIKE 'N%') l ON o_orderkey = l_orderkey GROUP BY o_orderkey)
        SELECT c_count, count(*) AS dist FROM c GROUP BY c_count""",
    "q14": f"""SELECT round(100.0 * sum(CASE WHEN p_type LIKE 'PROMO%' THEN {REVENUE_SQL} ELSE 0 END) / sum({REVENUE_SQL}), 6) AS promo_revenue FROM lineitem JOIN part ON l_partkey = p_partkey
        WHERE l_shipdate >= TIMESTAMP '1996-09-01' AND l_shipdate < TIMESTAMP '1996-10-01'""",
    "q15": f"""WITH v AS (SELECT l_suppkey, round(sum({REVENUE_SQL}), 2) AS total_revenue FROM lineitem WHERE l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1996-04-01' GROUP BY l_suppkey)
        SELECT s_suppkey, s_name, total_revenue FROM supplier JOIN v ON s_suppkey = l_suppkey WHERE total_revenue = (SELECT max(total_revenue) FROM v)""",
    "q16": """SELECT p_brand, p_type, p_size, count(DISTINCT l_suppkey) AS supplier_cnt FROM lineitem JOIN part ON l_partkey = p_partkey WHERE p_brand <> 'Brand#9' AND p_type NOT LIKE 'MEDIUM%'
        AND p_size IN (3, 9, 14, 19, 23, 36, 45, 49) AND l_suppkey NOT IN (SELECT s_suppkey FROM supplier WHERE s_acctbal < 0) GROUP BY ALL""",
    "q17": """SELECT round(sum(l_extendedprice) / 7.0, 2) AS avg_yearly FROM lineitem l JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#23'
        AND l_quantity < (SELECT 0.5 * avg(x.l_quantity) FROM lineitem x WHERE x.l_partkey = l.l_partkey)""",
    "q18": """SELECT c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice, sum(l_quantity) AS sum_qty FROM customer JOIN orders ON c_custkey = o_custkey JOIN lineitem ON o_orderkey = l_orderkey
        WHERE o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 250) GROUP BY c_name, c_custkey, o_orderkey, o_orderdate, o_totalprice
        ORDER BY o_totalprice DESC, o_orderdate, c_name, c_custkey, o_orderkey, sum_qty LIMIT 100""",
    "q19": f"""SELECT round(sum({REVENUE_SQL}), 2) AS revenue FROM lineitem JOIN part ON l_partkey = p_partkey WHERE (p_brand = 'Brand#12' AND l_quantity BETWEEN 1 AND 11 AND p_size BETWEEN 1 AND 5)
        OR (p_brand = 'Brand#23' AND l_quantity BETWEEN 10 AND 20 AND p_size BETWEEN 1 AND 10) OR (p_brand = 'Brand#4' AND l_quantity BETWEEN 20 AND 30 AND p_size BETWEEN 1 AND 15)""",
    "q20": f"""SELECT s_suppkey, s_name, n_name FROM supplier JOIN nation ON s_nationkey = n_nationkey WHERE n_nationkey < 10 AND s_suppkey IN (SELECT ps_suppkey FROM {OFFERS_SQL} o
        WHERE ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 'blue%') AND ps_availqty > (SELECT 0.5 * sum(l_quantity) FROM lineitem
        WHERE l_partkey = ps_partkey AND l_suppkey = ps_suppkey AND l_shipdate >= TIMESTAMP '1996-01-01' AND l_shipdate < TIMESTAMP '1997-01-01'))""",
    "q21": """SELECT s_name, count(*) AS numwait FROM lineitem l1 JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON l_suppkey = s_suppkey JOIN nation ON s_nationkey = n_nationkey
        WHERE n_nationkey < 5 AND o_orderstatus = 'F' AND l1.l_returnflag = 'R' AND EXISTS (SELECT 1 FROM lineitem x WHERE x.l_orderkey = l1.l_orderkey AND x.l_suppkey <> l1.l_suppkey)
        AND NOT EXISTS (SELECT 1 FROM lineitem y WHERE y.l_orderkey = l1.l_orderkey AND y.l_suppkey <> l1.l_suppkey AND y.l_returnflag = 'R') GROUP BY s_name ORDER BY numwait DESC, s_name LIMIT 100""",
    "q22": """SELECT c_nationkey, count(*) AS numcust, round(sum(c_acctbal), 2) AS totacctbal FROM customer WHERE c_nationkey IN (1, 3, 5, 7, 9, 11, 13)
        AND c_acctbal > (SELECT avg(c_acctbal) FROM customer WHERE c_acctbal > 0 AND c_nationkey IN (1, 3, 5, 7, 9, 11, 13)) AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P') GROUP BY ALL""",
}

PIPELINES: dict[str, Callable[[Tables], Node]] = {f"q{i}": globals()[f"q{i}"] for i in range(1, 23)}
