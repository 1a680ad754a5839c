"""Lineage questions, each about one table, with SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..lineage import SnapshotStore, lineage
from ..functions import call
from ..operators import CrosstableUDF, Filter, GroupBy, InnerJoin, Node, PipelinePath, Select, SetItem, SubPipeline, Subquery, agg
from ..operators.base import name
from ..pipeline import Pipeline
from ..predicate import Case, Expr, col, lit, row_predicate
from . import operator_queries, tpch

Tables = Callable[[str], Node]
#: Name: (pipeline, table, mode, order that picks the row or a predicate, SQL).
QUESTIONS: dict[str, tuple[Callable[[Tables], Node], str, str, Sequence[str] | Expr, str]] = {}


def first_row(p: Pipeline, order: Sequence[str]):
    """The first row by the columns, a minus in front meaning from the largest."""
    df = p.frame()
    keys = [name(c[1:]).desc_nulls_last() if c[0] == "-" else name(c).asc_nulls_last() for c in order]
    return df.orderBy(*keys, *[name(c).asc_nulls_last() for c in df.columns if c not in {k.lstrip("-") for k in order}]).first()


def ask(make: Callable[[Tables], Node], table: str, mode: str, which: Sequence[str] | Expr):
    """The query that answers one question. The row that it is about is one row, picked on the driver."""

    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        from .catalog import tables

        p = Pipeline(spark, make(tables(sf_dir)))
        if isinstance(which, Expr):
            f = which
        else:
            order, columns = which if isinstance(which, tuple) else (which, None)
            row = first_row(p, order)
            if row is None:
                return p.frame(next(s for s in p.sources if s.table == table)).filter(F.lit(False))
            f = row_predicate(row, columns)
        store = None
        if mode == "snapshot":
            from ..sources.scratch import scratch_folder

            store = SnapshotStore(scratch_folder(spark, "snapshots"))
            store.build(p)
        return lineage(p, f, mode, store, check_exists=isinstance(which, Expr), tables=[table])[table].rows

    return run


def dependent_group(t: Tables) -> Node:
    """Orders of customers, by columns that the customer's key determines, and one that is computed from those."""
    j = InnerJoin(t("customer"), Filter(t("orders"), col("o_orderstatus") == "F"), ["c_custkey"], ["o_custkey"])
    j = SetItem(j, "label", call("concat", col("c_name"), col("c_mktsegment")))
    return GroupBy(j, ["o_custkey", "c_nationkey", "label", "o_orderstatus"], [agg("count", alias="n"), agg("max", "o_orderdate", "last")])


def question(key: str, make, table: str, which, sql: str, mode: str = "auto") -> None:
    QUESTIONS[key] = (make, table, mode, which, sql)


_Q3 = f"WITH r AS (SELECT * FROM ({tpch.SQL['q3']}) ORDER BY revenue DESC, o_orderdate, l_orderkey LIMIT 1) "
_Q3_ORDER = ["-revenue", "o_orderdate"]
for _mode in ("auto", "snapshot", "eager"):
    _end = "" if _mode == "auto" else f"_{_mode}"
    question(f"q3_customer{_end}", tpch.q3, "customer", _Q3_ORDER, _Q3 + "SELECT * FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderkey = (SELECT l_orderkey FROM r))", _mode)
    question(f"q3_orders{_end}", tpch.q3, "orders", _Q3_ORDER, _Q3 + "SELECT * FROM orders WHERE o_orderkey = (SELECT l_orderkey FROM r)", _mode)
    question(f"q3_lineitem{_end}", tpch.q3, "lineitem", _Q3_ORDER, _Q3 + "SELECT * FROM lineitem WHERE l_orderkey = (SELECT l_orderkey FROM r) AND l_shipdate > TIMESTAMP '1998-03-15'", _mode)

_Q10 = f"WITH r AS (SELECT * FROM ({tpch.SQL['q10']}) ORDER BY revenue DESC, c_acctbal, c_custkey LIMIT 1) "
_Q10_ORDERS = "o_custkey = (SELECT c_custkey FROM r) AND o_orderdate >= TIMESTAMP '1996-10-01' AND o_orderdate < TIMESTAMP '1997-01-01'"
_Q10_ORDER = ["-revenue", "c_acctbal", "c_custkey"]
question("q10_customer", tpch.q10, "customer", _Q10_ORDER, _Q10 + "SELECT * FROM customer WHERE c_custkey = (SELECT c_custkey FROM r)")
question("q10_orders", tpch.q10, "orders", _Q10_ORDER, _Q10 + f"SELECT * FROM orders WHERE {_Q10_ORDERS} AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')")
question("q10_lineitem", tpch.q10, "lineitem", _Q10_ORDER, _Q10 + f"SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IN (SELECT o_orderkey FROM orders WHERE {_Q10_ORDERS})")
question("q10_nation", tpch.q10, "nation", _Q10_ORDER, _Q10 + "SELECT * FROM nation WHERE n_name = (SELECT n_name FROM r)")
question("q10_orders_snapshot", tpch.q10, "orders", _Q10_ORDER, QUESTIONS["q10_orders"][4], "snapshot")
question("q10_lineitem_eager", tpch.q10, "lineitem", _Q10_ORDER, QUESTIONS["q10_lineitem"][4], "eager")

question("q1_lineitem_of_a_predicate", tpch.q1, "lineitem", col("l_returnflag") == "R", "SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_shipdate <= TIMESTAMP '1998-09-02'")
question("q1_lineitem_of_no_row", tpch.q1, "lineitem", col("l_returnflag") == "X", "SELECT * FROM lineitem WHERE FALSE")
question("q4_orders", tpch.q4, "orders", ["o_orderpriority"], """SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '1996-07-01' AND o_orderdate < TIMESTAMP '1996-10-01'
    AND EXISTS (SELECT 1 FROM lineitem WHERE l_orderkey = o_orderkey AND l_returnflag = 'R')""")
question("q4_lineitem", tpch.q4, "lineitem", ["o_orderpriority"], """SELECT * FROM lineitem WHERE l_returnflag = 'R' AND l_orderkey IN
    (SELECT o_orderkey FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderdate >= TIMESTAMP '1996-07-01' AND o_orderdate < TIMESTAMP '1996-10-01')""")
_Q13 = "(SELECT o_orderkey FROM orders LEFT JOIN (SELECT * FROM lineitem WHERE l_returnflag NOT LIKE 'N%') l ON o_orderkey = l_orderkey GROUP BY o_orderkey HAVING count(l_partkey) = 0)"
question("q13_orders_without_match", tpch.q13, "orders", ["c_count"], f"SELECT * FROM orders WHERE o_orderkey IN {_Q13}")
question("q13_lineitem_without_match", tpch.q13, "lineitem", ["c_count"], "SELECT * FROM lineitem WHERE FALSE")
question("q17_lineitem", tpch.q17, "lineitem", ["avg_yearly"], """WITH k AS (SELECT DISTINCT l.l_partkey FROM lineitem l JOIN part ON l_partkey = p_partkey WHERE p_brand = 'Brand#23'
    AND l_quantity < (SELECT 0.5 * avg(x.l_quantity) FROM lineitem x WHERE x.l_partkey = l.l_partkey)) SELECT * FROM lineitem WHERE l_partkey IN (SELECT l_partkey FROM k)""")
question("q18_lineitem", tpch.q18, "lineitem", ["-o_totalprice"], f"SELECT * FROM lineitem WHERE l_orderkey = (SELECT o_orderkey FROM ({tpch.SQL['q18']}) ORDER BY o_totalprice DESC, c_name LIMIT 1)")
question("q22_customer", tpch.q22, "customer", ["c_nationkey"], """WITH c AS (SELECT * FROM customer WHERE c_nationkey IN (1, 3, 5, 7, 9, 11, 13)), k AS (SELECT * FROM c WHERE c_acctbal > (SELECT avg(c_acctbal) FROM c WHERE c_acctbal > 0)
    AND NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')) SELECT * FROM c WHERE c_acctbal > 0 OR c_custkey IN (SELECT c_custkey FROM k WHERE c_nationkey = (SELECT min(c_nationkey) FROM k))""")
question("notebook_events", operator_queries.notebook_search_frequency, "events", ["date"], "SELECT * FROM events WHERE event_type IN ('click', 'view', 'purchase') AND CAST(ts AS DATE) = DATE '2024-01-01'")
question("top_n_orders", operator_queries.top_n, "orders", ["o_totalprice"], "SELECT * FROM (SELECT * FROM orders ORDER BY o_totalprice DESC, o_orderdate LIMIT 15) ORDER BY o_totalprice, o_orderkey LIMIT 1")
question("drop_duplicate_orders", operator_queries.drop_duplicate, "orders", ["o_custkey"], "SELECT * FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders WHERE (o_custkey, o_orderstatus) = (SELECT (o_custkey, o_orderstatus) FROM orders ORDER BY o_custkey, o_orderstatus LIMIT 1))")
question("pivot_orders", operator_queries.pivot, "orders", ["o_orderpriority"], "SELECT * FROM orders WHERE o_orderpriority = '1-URGENT' AND o_orderstatus IN ('F', 'O', 'P')")
question("cum_sum_events", operator_queries.cum_sum, "events", ["ts", "event_id"], "SELECT * FROM events ORDER BY ts, event_id LIMIT 1")
question("append_supplier", operator_queries.append, "supplier", ["id", "-name"], "SELECT * FROM supplier WHERE s_suppkey = (SELECT min(s_suppkey) FROM supplier)")
question("grouped_map_orders", operator_queries.grouped_map_table, "orders", ["-o_custkey"], "SELECT * FROM orders WHERE o_custkey = (SELECT max(o_custkey) FROM orders)")
question("right_join_lineitem", operator_queries.right_join, "lineitem", ["-l_partkey", "o_orderkey"], """WITH j AS (SELECT o.o_orderkey, l.* FROM (SELECT * FROM orders WHERE o_orderstatus = 'F') o RIGHT JOIN lineitem l ON o_orderkey = l_orderkey),
    r AS (SELECT o_orderkey, l_partkey FROM j ORDER BY l_partkey DESC, o_orderkey NULLS LAST LIMIT 1) SELECT j.* EXCLUDE (o_orderkey) FROM j, r WHERE j.l_partkey = r.l_partkey AND j.o_orderkey IS NOT DISTINCT FROM r.o_orderkey""")


def branch_on(condition: Expr) -> Callable[[Tables], Node]:
    """Orders from key 5 on, x being half the key or, below 100, null; the quantity of an order is looked up under a condition on x."""

    def make(t: Tables) -> Node:
        orders = Select(Filter(t("orders"), col("o_orderkey") >= 5), ["o_orderkey"])
        orders = SetItem(SetItem(orders, "half", col("o_orderkey") / lit(2.0)), "late", Case(((col("o_orderkey") > 100, lit(9.0)),)))
        return CrosstableUDF(orders, "qty", SubPipeline([PipelinePath(Subquery(t("lineitem"), [("o_orderkey", "l_orderkey")], agg("sum", "l_quantity", "q")), condition)]))

    return make


# Branches that only Spark's own rules for halves and nulls take: order 5 has half 2.5 and no late value.
for _key, _condition in (("round", call("round", col("half"), 0) == 3.0), ("least", call("least", col("late"), 5.0) == 5.0), ("greatest", call("greatest", col("late"), 5.0) == 5.0)):
    for _mode in ("auto", "eager"):
        question(f"crosstable_{_key}" + ("" if _mode == "auto" else "_eager"), branch_on(_condition), "lineitem", ["o_orderkey"], "SELECT * FROM lineitem WHERE l_orderkey = 5", _mode)

# Of the row, the customer's key and aggregates alone are given; the other group columns follow from the key.
_DEPENDENT = "WITH r AS (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey ORDER BY count(*) DESC, o_custkey LIMIT 1) "
for _mode in ("pushdown", "eager"):
    _end, _which = "" if _mode == "pushdown" else f"_{_mode}", (["-n", "o_custkey"], ["o_custkey", "n", "last"])
    question(f"dependent_orders{_end}", dependent_group, "orders", _which, _DEPENDENT + "SELECT orders.* FROM orders JOIN r USING (o_custkey) WHERE o_orderstatus = 'F'", _mode)
    question(f"dependent_customer{_end}", dependent_group, "customer", _which, _DEPENDENT + "SELECT * FROM customer WHERE c_custkey = (SELECT o_custkey FROM r)", _mode)

def declared_groups(t: Tables) -> Node:
    """Line items, whose flags are a declared domain, by number and flag."""
    items = t("lineitem").declared(col("l_returnflag").isin("A", "N", "R"), col("l_linenumber") >= 1)
    return GroupBy(items, ["l_linenumber", "l_returnflag"], [agg("count", alias="n"), agg("max", "l_quantity", "most")])


def declared_join(t: Tables) -> Node:
    """Orders and customers joined on the nation that a range leaves, by segment."""
    orders = Filter(t("orders").declared(col("o_orderstatus").isin("F", "O", "P")), ~col("o_orderstatus").isin("O", "P"))
    j = InnerJoin(Filter(t("customer"), (col("c_nationkey") > 3) & (col("c_nationkey") < 5)), orders, ["c_custkey"], ["o_custkey"])
    return GroupBy(j, ["c_nationkey", "o_orderstatus", "c_mktsegment"], [agg("count", alias="n")])


# Ranges and domains leave a group's keys one value each; the question names none of them as a value.
_LEFT_OVER = ((col("l_linenumber") > 2) & (col("l_linenumber") < 4) | (col("l_linenumber") == 3) & (col("most") > 0.0)) & ~col("l_returnflag").isin("A", "N") & (col("n") > 0)
_ONE_NATION = (col("c_mktsegment") >= "BUILDING") & (col("c_mktsegment") <= "BUILDING") & (col("n") > 0)
for _mode in ("pushdown", "eager"):
    _end = "" if _mode == "pushdown" else f"_{_mode}"
    question(f"domain_lineitem{_end}", declared_groups, "lineitem", _LEFT_OVER, "SELECT * FROM lineitem WHERE l_linenumber = 3 AND l_returnflag = 'R'", _mode)
    question(f"domain_customer{_end}", declared_join, "customer", _ONE_NATION, "SELECT * FROM customer WHERE c_nationkey = 4 AND c_mktsegment = 'BUILDING' AND c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')", "auto" if _mode == "pushdown" else _mode)

# The rules of every operator, pushed and tracked alike, against SQL.
_FIRST_ORDER = "SELECT * FROM orders WHERE o_orderkey = (SELECT min(o_orderkey) FROM orders)"
_FIRST_NATION = "(SELECT least((SELECT min(c_nationkey) FROM customer), (SELECT min(s_nationkey) FROM supplier)))"
for _key, _make, _table, _order, _sql in (
    ("unpivot_lineitem", operator_queries.unpivot, "lineitem", ["l_orderkey"], """WITH f AS (SELECT * FROM lineitem WHERE l_orderkey = (SELECT min(l_orderkey) FROM lineitem)) SELECT * FROM f WHERE l_discount = (SELECT min(l_discount) FROM f)"""),
    ("split_part", operator_queries.split_by, "part", ["p_partkey"], "SELECT * FROM part WHERE p_partkey = (SELECT min(p_partkey) FROM part)"),
    ("get_dummies_orders", operator_queries.get_dummies, "orders", ["o_orderkey"], _FIRST_ORDER),
    ("concat_column_orders", operator_queries.concat_column, "orders", ["o_orderkey"], _FIRST_ORDER),
    ("all_aggregate_orders", operator_queries.all_aggregate, "orders", ["n"], "SELECT * FROM orders"),
    ("scalar_lineitem", operator_queries.scalar_computation, "lineitem", ["value"], "SELECT * FROM lineitem"),
    ("dependency_orders", operator_queries.set_item_with_dependency, "orders", ["o_orderkey"], "SELECT * FROM orders"),
    ("combine_customer", operator_queries.combine, "customer", ["k"], "SELECT * FROM customer WHERE c_custkey = (SELECT min(c_custkey) FROM customer)"),
    ("cogrouped_customer", operator_queries.cogrouped_map, "customer", ["nation"], f"SELECT * FROM customer WHERE c_nationkey = {_FIRST_NATION}"),
    ("cogrouped_supplier", operator_queries.cogrouped_map, "supplier", ["-suppliers", "nation"], "SELECT * FROM supplier WHERE s_nationkey = (SELECT s_nationkey FROM supplier GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1)"),
    ("crosstable_condition_lineitem", operator_queries.crosstable_condition, "lineitem", ["-small", "p_partkey"], """WITH r AS (SELECT p_partkey, p_size, (SELECT count(*) FROM lineitem WHERE l_partkey = p_partkey AND l_quantity < p_size) AS small FROM part ORDER BY small DESC, p_partkey LIMIT 1)
        SELECT l.* FROM lineitem l, r WHERE l_partkey = p_partkey AND l_quantity < p_size"""),
    ("cum_max_events", operator_queries.cum_max_by_user, "events", ["-event_id"], """WITH r AS (SELECT * FROM events ORDER BY event_id DESC LIMIT 1) SELECT e.* FROM events e, r WHERE e.user_id = r.user_id AND (e.ts, e.event_id) <= (r.ts, r.event_id)"""),
    ("interval_customer", operator_queries.interval_join, "customer", ["-c_custkey", "s_suppkey"], f"SELECT * FROM customer WHERE c_custkey = (SELECT max(c_custkey) FROM ({operator_queries.SQL['interval_join']}))"),
    ("as_of_events", operator_queries.as_of_join, "events", ["-event_id"], f"WITH r AS (SELECT * FROM ({operator_queries.SQL['as_of_join']}) ORDER BY event_id DESC LIMIT 1) SELECT e.* FROM events e, r WHERE e.event_id IN (r.event_id, r.click)"),
):
    question(_key, _make, _table, _order, _sql)
    question(f"{_key}_eager", _make, _table, _order, _sql, "eager")
for _key in ("drop_duplicate_orders", "pivot_orders", "cum_sum_events", "append_supplier", "grouped_map_orders", "top_n_orders", "q4_lineitem", "q13_orders_without_match"):
    question(f"{_key}_eager", *[QUESTIONS[_key][i] for i in (0, 1, 3, 4)], "eager")


QUERIES = {f"lineage_{k}": ask(make, table, mode, which) for k, (make, table, mode, which, _) in QUESTIONS.items()}
SQL = {f"lineage_{k}": sql for k, (_, _, _, _, sql) in QUESTIONS.items()}
