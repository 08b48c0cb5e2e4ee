"""Named queries over the driver's tables: a script each, and the same in SQL.

Every query binds tables to a session, runs its script and returns the rows of
``res``, so parser, evaluator and operators are exercised end to end.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .model import Dataset
from .session import Session

IDS = {"orders": ["o_orderkey"], "customer": ["c_custkey"], "nation": ["n_nationkey"], "region": ["r_regionkey"], "part": ["p_partkey"], "supplier": ["s_suppkey"], "events": ["event_id"], "lineitem": []}


@dataclass(frozen=True)
class Query:
    script: str
    sql: str
    tables: dict[str, list[str] | None] = field(default_factory=dict)
    prepare: Callable[[Session], None] | None = None

    def __call__(self, spark: SparkSession, sf_dir: str) -> DataFrame:
        session = Session(spark)
        for name in IDS:
            if name in self.tables or name in self.script:
                session.bind(name, spark.read.parquet(f"{sf_dir}/{name}.parquet"), ids=self.tables.get(name, IDS[name]))
        if self.prepare:
            self.prepare(session)
        out = session.run(self.script)["res"]
        return out.df if isinstance(out, Dataset) else spark.range(1).select(out.column.alias("res"))


Q: dict[str, Query] = {}


def add(name: str, script: str, sql: str, tables=None, prepare=None) -> None:
    Q[name] = Query(script, sql, tables or {}, prepare)


# ---- flagship
add(
    "entry",
    "res := lineitem[filter l_quantity > 10][aggr n := count(), s := sum(l_quantity), p := avg(l_extendedprice) group by l_returnflag, l_linestatus][calc p := round(p, 4)];",
    "SELECT l_returnflag, l_linestatus, count(*) AS n, sum(l_quantity) AS s, round(avg(l_extendedprice), 4) AS p FROM lineitem WHERE l_quantity > 10 GROUP BY ALL",
)

# ---- clauses
add("filter", 'res := orders[filter o_totalprice > 200000 and o_orderstatus <> "F"];', "SELECT * FROM orders WHERE o_totalprice > 200000 AND o_orderstatus <> 'F'")
add(
    "calc_arith",
    "res := orders[calc a := o_totalprice * 2 + 1, b := o_custkey - 5, c := o_totalprice / 4, d := -o_custkey][keep a, b, c, d];",
    "SELECT o_orderkey, o_totalprice * 2 + 1 AS a, o_custkey - 5 AS b, o_totalprice / 4 AS c, -o_custkey AS d FROM orders",
)
add(
    "calc_overwrite",
    "res := orders[calc o_totalprice := o_totalprice + 1, before := o_totalprice][keep o_totalprice, before];",
    "SELECT o_orderkey, o_totalprice + 1 AS o_totalprice, o_totalprice AS before FROM orders",
)
add("calc_role", "res := orders[calc identifier k := o_custkey, attribute note := o_orderstatus][keep note];", "SELECT o_orderkey, o_custkey AS k, o_orderstatus AS note FROM orders")
add("keep", "res := orders[keep o_totalprice, o_custkey];", "SELECT o_orderkey, o_totalprice, o_custkey FROM orders")
add("drop", "res := orders[drop o_orderdate, o_orderpriority];", "SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
add(
    "rename_swap",
    "res := orders[keep o_orderstatus, o_orderpriority][rename o_orderstatus to o_orderpriority, o_orderpriority to o_orderstatus];",
    "SELECT o_orderkey, o_orderstatus AS o_orderpriority, o_orderpriority AS o_orderstatus FROM orders",
)
add("membership", "res := orders#o_totalprice;", "SELECT o_orderkey, o_totalprice FROM orders")
add(
    "subspace",
    'res := orders[calc identifier st := o_orderstatus][keep o_totalprice][sub st = "O"];',
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'O'",
)
PIVOT_BASE = "base := orders[aggr t := count() group by o_orderpriority, o_orderstatus];"
PIVOT_SQL = "SELECT o_orderpriority, {} FROM orders GROUP BY o_orderpriority"
PIVOTED = ", ".join(f"nullif(count(*) FILTER (o_orderstatus = '{s}'), 0) AS \"{s}\"" for s in "FOP")
add("pivot", PIVOT_BASE + "res := base[pivot o_orderstatus, t];", PIVOT_SQL.format(PIVOTED))
add("custom_pivot", PIVOT_BASE + 'res := base[customPivot o_orderstatus, t in "F", "O"];', PIVOT_SQL.format(", ".join(PIVOTED.split(", ", 4)[:4])))
add(
    "unpivot",
    "res := customer[calc balance := c_acctbal, nation := c_nationkey * 1.0][keep balance, nation][unpivot what, amount];",
    "SELECT c_custkey, 'balance' AS what, c_acctbal AS amount FROM customer UNION ALL SELECT c_custkey, 'nation', c_nationkey::DOUBLE FROM customer",
)
add(
    "sub_filter_scalar",
    "k := 150000; res := orders[filter o_totalprice > k][keep o_totalprice];",
    "SELECT o_orderkey, o_totalprice FROM orders WHERE o_totalprice > 150000",
)

# ---- scalar functions
add(
    "num_round_trunc",
    "res := orders[calc a := round(o_totalprice / 7, 2), b := trunc(o_totalprice, 1), c := ceil(o_totalprice), d := floor(o_totalprice), e := abs(0 - o_totalprice), f := round(o_totalprice, -2)][keep a, b, c, d, e, f];",
    "SELECT o_orderkey, round(o_totalprice / 7, 2) AS a, trunc(o_totalprice::DECIMAL(18,2) * 10)::DOUBLE / 10 AS b, ceil(o_totalprice)::BIGINT AS c, floor(o_totalprice)::BIGINT AS d, o_totalprice AS e, round(o_totalprice, -2) AS f FROM orders",
)
add(
    "num_round_column",
    "res := part[calc n := cast(mod(p_size, 3), integer)][calc r := round(p_retailprice / 7, n)][keep r];",
    "SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN round(p_retailprice / 7, 0) WHEN 1 THEN round(p_retailprice / 7, 1) ELSE round(p_retailprice / 7, 2) END AS r FROM part",
)
add(
    "num_mod",
    "res := orders[calc a := mod(o_custkey, 7), b := mod(o_custkey, -7), c := mod(o_custkey, 0)][keep a, b, c];",
    "SELECT o_orderkey, (o_custkey % 7)::DOUBLE AS a, -(o_custkey % 7)::DOUBLE AS b, o_custkey::DOUBLE AS c FROM orders",
)
add(
    "num_log_ln_exp",
    "res := customer[calc a := round(ln(c_custkey + 1), 8), b := round(log(c_custkey + 1, 2), 8), c := round(exp(c_nationkey / 10), 6), d := round(sqrt(c_custkey), 8), e := power(c_nationkey, 2)][keep a, b, c, d, e];",
    "SELECT c_custkey, round(ln(c_custkey + 1), 8) AS a, round(ln(c_custkey + 1) / ln(2), 8) AS b, round(exp(c_nationkey / 10.0::DOUBLE), 6) AS c, round(sqrt(c_custkey), 8) AS d, power(c_nationkey, 2)::DOUBLE AS e FROM customer",
)
add(
    "num_div_zero",
    "res := customer[calc a := if (c_nationkey - c_nationkey) = 0 and c_acctbal > 0 and c_acctbal / (c_nationkey - c_nationkey) > 1000000 then 1 else 0, b := isnull(ln(0))][keep a, b];",
    "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN 1 ELSE 0 END::BIGINT AS a, false AS b FROM customer",
)
add(
    "num_random",
    "res := nation[calc a := random(n_nationkey, 1)][keep a][aggr n := count(), lo := min(a), hi := max(a)][calc ok := lo >= 0 and hi < 1][keep n, ok];",
    "SELECT count(*) AS n, true AS ok FROM nation",
)
add(
    "str_case_trim",
    'res := customer[calc a := upper(c_name), b := lower(c_mktsegment), c := trim("  " || c_name || "  "), d := length(c_name), e := ltrim("  x"), f := rtrim("x  ")][keep a, b, c, d, e, f];',
    "SELECT c_custkey, upper(c_name) AS a, lower(c_mktsegment) AS b, c_name AS c, length(c_name)::BIGINT AS d, 'x' AS e, 'x' AS f FROM customer",
)
add(
    "str_substr_instr",
    'res := customer[calc a := substr(c_name, 3, 5), b := substr(c_name, 12), c := instr(c_name, "0", 0, 2), d := instr(c_name, "zz")][keep a, b, c, d];',
    "SELECT c_custkey, substr(c_name, 3, 5) AS a, substr(c_name, 12) AS b, (instr(c_name, '0') + instr(substr(c_name, instr(c_name, '0') + 1), '0'))::BIGINT AS c, 0::BIGINT AS d FROM customer",
)
add("str_replace_regex", 'res := customer[calc a := replace(c_name, "0+", "-")][keep a];', "SELECT c_custkey, regexp_replace(c_name, '0+', '-', 'g') AS a FROM customer")
add("str_levenshtein", 'res := customer[calc a := levenshtein(c_mktsegment, "MACHINE")][keep a];', "SELECT c_custkey, levenshtein(c_mktsegment, 'MACHINE')::BIGINT AS a FROM customer")
add(
    "cmp_between_in",
    'res := orders[filter between(o_totalprice, 1000, 200000) and o_orderstatus in {"O", "P"} and o_custkey not_in {1, 2, 3}][keep o_custkey];',
    "SELECT o_orderkey, o_custkey FROM orders WHERE o_totalprice BETWEEN 1000 AND 200000 AND o_orderstatus IN ('O', 'P') AND o_custkey NOT IN (1, 2, 3)",
)
add(
    "in_value_domain",
    "res := customer[filter c_mktsegment in segments][keep c_acctbal];",
    "SELECT c_custkey, c_acctbal FROM customer WHERE c_mktsegment IN ('MACHINERY', 'BUILDING')",
    prepare=lambda s: s.value_domain("segments", ["MACHINERY", "BUILDING"]),
)
add("match_characters", 'res := part[filter match_characters(p_brand, "Brand#1[0-9]")][keep p_brand];', "SELECT p_partkey, p_brand FROM part WHERE regexp_full_match(p_brand, 'Brand#1[0-9]')")
NULLED = "CASE WHEN o_custkey % 3 = 0 THEN NULL ELSE o_custkey % 2 = 0 END"
add(
    "bool_3vl_xor",
    "base := orders[calc p := if mod(o_custkey, 3) = 0 then null else mod(o_custkey, 2) = 0, q := o_totalprice > 100000][keep p, q]; res := base[calc a := p and q, b := p or q, c := p xor q, d := not p, e := isnull(p)];",
    f"SELECT o_orderkey, p, q, p AND q AS a, p OR q AS b, p <> q AS c, NOT p AS d, p IS NULL AS e FROM (SELECT o_orderkey, {NULLED} AS p, o_totalprice > 100000 AS q FROM orders)",
)
add(
    "if_null_cond",
    'res := orders[calc a := if (if mod(o_custkey, 3) = 0 then null else mod(o_custkey, 2) = 0) then "even" else "odd"][keep a];',
    f"SELECT o_orderkey, CASE WHEN ({NULLED}) IS NULL THEN NULL WHEN {NULLED} THEN 'even' ELSE 'odd' END AS a FROM orders",
)
add(
    "case_null",
    'res := orders[calc a := case when (if mod(o_custkey, 3) = 0 then null else true) and o_totalprice > 300000 then "big" when o_totalprice > 100000 then "mid" else "small"][keep a];',
    "SELECT o_orderkey, CASE WHEN o_custkey % 3 <> 0 AND o_totalprice > 300000 THEN 'big' WHEN o_totalprice > 100000 THEN 'mid' ELSE 'small' END AS a FROM orders",
)
add("nvl", "res := orders[calc a := nvl(if mod(o_custkey, 3) = 0 then null else o_custkey, -1)][keep a];", "SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN -1 ELSE o_custkey END AS a FROM orders")
add(
    "cast_matrix",
    'res := orders[calc a := cast(o_custkey, string), b := cast(o_custkey, number), c := cast(o_custkey, boolean), d := cast("12", integer), e := cast(true, integer), f := cast(o_orderdate, string, "YYYY-MM-DD"), g := cast("31/01/2020", date, "DD/MM/YYYY")][keep a, b, c, d, e, f, g];',
    "SELECT o_orderkey, o_custkey::VARCHAR AS a, o_custkey::DOUBLE AS b, o_custkey <> 0 AS c, 12::BIGINT AS d, 1::BIGINT AS e, strftime(o_orderdate, '%Y-%m-%d') AS f, TIMESTAMP '2020-01-31' AS g FROM orders",
)
add(
    "date_parts",
    "res := orders[calc a := getyear(o_orderdate), b := getmonth(o_orderdate), c := dayofmonth(o_orderdate), d := dayofyear(o_orderdate)][keep a, b, c, d];",
    "SELECT o_orderkey, year(o_orderdate) AS a, month(o_orderdate) AS b, day(o_orderdate) AS c, dayofyear(o_orderdate) AS d FROM orders",
)
add(
    "date_add_diff",
    'res := orders[calc a := dateadd(o_orderdate, 2, "M"), b := datediff(o_orderdate, cast("2000-01-01", date, "YYYY-MM-DD")), c := o_orderdate + cast("P1Y2M3DT4H", duration), d := truncate_time(o_orderdate, "month")][keep a, b, c, d];',
    "SELECT o_orderkey, o_orderdate + INTERVAL 2 MONTH AS a, abs(date_diff('day', o_orderdate, TIMESTAMP '2000-01-01')) AS b, o_orderdate + INTERVAL 14 MONTH + INTERVAL 3 DAY + INTERVAL 4 HOUR AS c, date_trunc('month', o_orderdate)::TIMESTAMP AS d FROM orders",
)
add(
    "days_durations",
    'res := nation[calc a := daytoyear(n_nationkey * 100), b := daytomonth(n_nationkey * 7), c := yeartoday("P1Y20D"), d := monthtoday("P3M5D")][keep a, b, c, d];',
    "SELECT n_nationkey::BIGINT AS n_nationkey, 'P' || (n_nationkey * 100 // 365) || 'Y' || (n_nationkey * 100 % 365) || 'D' AS a, 'P' || (n_nationkey * 7 // 30) || 'M' || (n_nationkey * 7 % 30) || 'D' AS b, 385::BIGINT AS c, 95::BIGINT AS d FROM nation",
)
add(
    "define_operator",
    "define operator scaled (x number, f number default 10) returns number is x * f + 1 end operator; res := orders[calc a := scaled(o_totalprice), b := scaled(o_totalprice, 2)][keep a, b];",
    "SELECT o_orderkey, o_totalprice * 10 + 1 AS a, o_totalprice * 2 + 1 AS b FROM orders",
)


def _register(session: Session) -> None:
    session.register("halved", lambda x: x / 2, ["number"], "number")
    session.register_dataset_fn("above", lambda ds, n: Dataset(ds.df.filter(f"a > {n}"), ds.structure))


add("registered_functions", "res := above(orders[calc a := halved(o_totalprice)][keep a], 1000);", "SELECT o_orderkey, o_totalprice / 2 AS a FROM orders WHERE o_totalprice / 2 > 1000", prepare=_register)

# ---- joins
CUSTOMERS = "c := customer[rename c_custkey to o_custkey]; o := orders[calc identifier o_custkey2 := o_custkey][drop o_custkey][rename o_custkey2 to o_custkey];"
NATIONS = "n := nation[calc identifier r_regionkey := n_regionkey][drop n_regionkey];"
add(
    "inner_using",
    CUSTOMERS + "res := inner_join(o as a, c as b using o_custkey filter c_acctbal > 0 calc z := o_totalprice + c_acctbal keep z, c_name);",
    "SELECT o_orderkey, o_custkey, c_name, o_totalprice + c_acctbal AS z FROM orders JOIN customer ON o_custkey = c_custkey WHERE c_acctbal > 0",
)
add(
    "left_using",
    CUSTOMERS + "f := c[filter c_acctbal > 5000]; res := left_join(o as a, f as b using o_custkey keep o_totalprice, c_name);",
    "SELECT o_orderkey, o_custkey, o_totalprice, c_name FROM orders LEFT JOIN (SELECT * FROM customer WHERE c_acctbal > 5000) ON o_custkey = c_custkey",
)
add(
    "full_join",
    "a := customer[filter c_acctbal > 0][keep c_acctbal][rename c_acctbal to x]; b := customer[filter c_nationkey > 5][keep c_nationkey][rename c_nationkey to y]; res := full_join(a, b);",
    "SELECT c_custkey, CASE WHEN c_acctbal > 0 THEN c_acctbal END AS x, CASE WHEN c_nationkey > 5 THEN c_nationkey END::BIGINT AS y FROM customer WHERE c_acctbal > 0 OR c_nationkey > 5",
)
add("cross_join", "res := cross_join(nation[keep n_name] as a, region as b);", "SELECT n_nationkey::BIGINT AS n_nationkey, n_name, r_regionkey::BIGINT AS r_regionkey, r_name FROM nation, region")
add(
    "join_chain",
    NATIONS + "g := inner_join(n, region using r_regionkey); res := g[aggr k := count() group by r_name];",
    "SELECT r_name, count(*) AS k FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name",
)
add(
    "join_body_aggr",
    CUSTOMERS + "res := inner_join(o as a, c as b using o_custkey aggr t := sum(o_totalprice), k := count() group by c_mktsegment having count() > 10)[calc t := round(t, 2)];",
    "SELECT c_mktsegment, round(sum(o_totalprice), 2) AS t, count(*) AS k FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment HAVING count(*) > 10",
)
add(
    "join_duplicates",
    "a := customer[keep c_acctbal]; b := customer[calc c_acctbal := c_acctbal * 2][keep c_acctbal]; res := inner_join(a as d1, b as d2 calc total := d1#c_acctbal + d2#c_acctbal);",
    "SELECT c_custkey, c_acctbal * 2 AS c_acctbal, c_acctbal + c_acctbal * 2 AS total FROM customer",
)
add(
    "join_apply",
    'a := customer[keep c_acctbal]; b := customer[filter c_mktsegment <> "BUILDING"][keep c_acctbal]; res := inner_join(a as d1, b as d2 apply d1 + d2);',
    "SELECT c_custkey, c_acctbal + c_acctbal AS c_acctbal FROM customer WHERE c_mktsegment <> 'BUILDING'",
)
add(
    "exists_in",
    CUSTOMERS + "k := orders[aggr n := count() group by o_custkey]; res := exists_in(c, k, all);",
    "SELECT c_custkey AS o_custkey, c_custkey IN (SELECT o_custkey FROM orders) AS bool_var FROM customer",
)
add(
    "exists_in_true",
    CUSTOMERS + "k := orders[aggr n := count() group by o_custkey]; res := exists_in(c, k, true);",
    "SELECT c_custkey AS o_custkey, true AS bool_var FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders)",
)

# ---- sets
PARTS = 'a := events[filter event_type <> "click"][keep value]; b := events[filter value > 20][calc value := value + 1][keep value];'
IN_A, IN_B = "coalesce(event_type <> 'click', false)", "coalesce(value > 20, false)"
add("union_first_wins", PARTS + "res := union(a, b);", f"SELECT event_id, CASE WHEN {IN_A} THEN value ELSE value + 1 END AS value FROM events WHERE {IN_A} OR {IN_B}")
add("intersect", PARTS + "res := intersect(a, b);", f"SELECT event_id, value FROM events WHERE {IN_A} AND {IN_B}")
add("setdiff", PARTS + "res := setdiff(a, b);", f"SELECT event_id, value FROM events WHERE {IN_A} AND NOT {IN_B}")
add("symdiff", PARTS + "res := symdiff(a, b);", f"SELECT event_id, value FROM events WHERE {IN_A} AND NOT {IN_B} UNION ALL SELECT event_id, value + 1 FROM events WHERE {IN_B} AND NOT {IN_A}")

# ---- aggregation
add("group_by", "res := orders[aggr n := count(), s := round(sum(o_totalprice), 2) group by o_orderstatus];", "SELECT o_orderstatus, count(*) AS n, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_orderstatus")
add(
    "group_except",
    "res := orders[calc identifier st := o_orderstatus, identifier pr := o_orderpriority][aggr n := count() group except o_orderkey];",
    "SELECT o_orderstatus AS st, o_orderpriority AS pr, count(*) AS n FROM orders GROUP BY ALL",
)
add("group_all", 'res := orders[aggr n := count() group all truncate_time(o_orderdate, "month")];', "SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS time, count(*) AS n FROM orders GROUP BY ALL")
add(
    "group_time_agg",
    'res := orders[calc identifier day := o_orderdate][keep o_totalprice][aggr n := count() group by time_agg("Q")];',
    "SELECT date_trunc('quarter', o_orderdate)::TIMESTAMP AS day, count(*) AS n FROM orders GROUP BY ALL",
)
add("aggr_global", "res := orders[aggr n := count(), lo := min(o_totalprice), hi := max(o_totalprice)];", "SELECT count(*) AS n, min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders")
add(
    "having",
    "res := orders[aggr s := round(sum(o_totalprice), 2) group by o_custkey having avg(o_totalprice) > 250000 and count() > 3];",
    "SELECT o_custkey, round(sum(o_totalprice), 2) AS s FROM orders GROUP BY o_custkey HAVING avg(o_totalprice) > 250000 AND count(*) > 3",
)
add(
    "minmax",
    "res := orders[aggr a := min(o_orderdate), b := max(o_orderpriority), c := min(o_totalprice) group by o_orderstatus];",
    "SELECT o_orderstatus, min(o_orderdate) AS a, max(o_orderpriority) AS b, min(o_totalprice) AS c FROM orders GROUP BY o_orderstatus",
)
add("median", "res := lineitem[aggr m := median(l_extendedprice) group by l_returnflag][calc m := round(m, 6)];", "SELECT l_returnflag, round(median(l_extendedprice), 6) AS m FROM lineitem GROUP BY l_returnflag")
add(
    "median_discrete",
    "res := lineitem[aggr m := median(l_quantity) group by l_returnflag];",
    "SELECT l_returnflag, quantile_disc(l_quantity, 0.5) AS m FROM lineitem GROUP BY l_returnflag",
    prepare=lambda s: setattr(s, "median", "discrete"),
)
add(
    "stddev_var",
    "res := lineitem[aggr a := round(stddev_pop(l_quantity), 6), b := round(stddev_samp(l_quantity), 6), c := round(var_pop(l_quantity), 6), d := round(var_samp(l_quantity), 6) group by l_returnflag];",
    "SELECT l_returnflag, round(stddev_pop(l_quantity), 6) AS a, round(stddev_samp(l_quantity), 6) AS b, round(var_pop(l_quantity), 6) AS c, round(var_samp(l_quantity), 6) AS d FROM lineitem GROUP BY l_returnflag",
)
add(
    "aggr_dataset",
    "o := orders[calc identifier st := o_orderstatus][keep o_totalprice, o_custkey]; res := max(o group by st);",
    "SELECT o_orderstatus AS st, max(o_custkey) AS o_custkey, max(o_totalprice) AS o_totalprice FROM orders GROUP BY o_orderstatus",
)

# ---- analytic
OVER = "OVER (PARTITION BY o_custkey ORDER BY o_orderkey"
add(
    "an_sum_range_default",
    "res := orders[calc s := round(sum(o_totalprice over (partition by o_custkey order by o_orderdate)), 2)][keep s];",
    "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate), 2) AS s FROM orders",
)
add(
    "an_rows",
    "res := orders[calc s := round(sum(o_totalprice over (partition by o_custkey order by o_orderkey data points between 2 preceding and 1 following)), 2), a := round(avg(o_totalprice over (partition by o_custkey order by o_orderkey data points between 3 preceding and 1 preceding)), 4)][keep s, a];",
    f"SELECT o_orderkey, round(sum(o_totalprice) {OVER} ROWS BETWEEN 2 PRECEDING AND 1 FOLLOWING), 2) AS s, round(avg(o_totalprice) {OVER} ROWS BETWEEN 3 PRECEDING AND 1 PRECEDING), 4) AS a FROM orders",
)
add(
    "an_range",
    "res := orders[calc a := round(avg(o_totalprice over (partition by o_custkey order by o_orderkey range between 1000 preceding and 1000 following)), 4), n := count(o_totalprice over (partition by o_custkey order by o_orderkey range between 1000 preceding and current data point))][keep a, n];",
    f"SELECT o_orderkey, round(avg(o_totalprice) {OVER} RANGE BETWEEN 1000 PRECEDING AND 1000 FOLLOWING), 4) AS a, count(o_totalprice) {OVER} RANGE BETWEEN 1000 PRECEDING AND CURRENT ROW) AS n FROM orders",
)
add(
    "an_first_last",
    "res := orders[calc f := first_value(o_totalprice over (partition by o_custkey order by o_orderkey)), l := last_value(o_totalprice over (partition by o_custkey order by o_orderkey data points between unbounded preceding and unbounded following))][keep f, l];",
    f"SELECT o_orderkey, first_value(o_totalprice) {OVER}) AS f, last_value(o_totalprice) {OVER} ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS l FROM orders",
)
add(
    "an_lag_lead",
    "res := orders[calc a := lag(o_totalprice, 1 over (partition by o_custkey order by o_orderkey)), b := lead(o_totalprice, 2, 0.0 over (partition by o_custkey order by o_orderkey))][keep a, b];",
    f"SELECT o_orderkey, lag(o_totalprice, 1) {OVER}) AS a, lead(o_totalprice, 2, 0.0) {OVER}) AS b FROM orders",
)
add(
    "an_ratio",
    "res := orders[calc r := round(ratio_to_report(o_totalprice over (partition by o_custkey)), 8)][keep r];",
    "SELECT o_orderkey, round(o_totalprice / sum(o_totalprice) OVER (PARTITION BY o_custkey), 8) AS r FROM orders",
)
add(
    "an_rank",
    "res := orders[calc r := rank(over (partition by o_orderstatus order by o_totalprice desc, o_orderkey))][filter r <= 10][keep r];",
    "SELECT o_orderkey, r FROM (SELECT o_orderkey, rank() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS r FROM orders) WHERE r <= 10",
)
add(
    "an_median_frame",
    "res := orders[calc m := round(median(o_totalprice over (partition by o_custkey order by o_orderkey data points between 2 preceding and current data point)), 4)][keep m];",
    f"SELECT o_orderkey, round(median(o_totalprice) {OVER} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 4) AS m FROM orders",
)
add(
    "an_stddev_frame",
    "res := orders[calc s := round(stddev_pop(o_totalprice over (partition by o_custkey order by o_orderkey data points between 2 preceding and current data point)), 3), v := round(var_samp(o_custkey over (partition by o_orderstatus)), 3)][keep s, v];",
    f"SELECT o_orderkey, round(stddev_pop(o_totalprice) {OVER} ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 3) AS s, round(var_samp(o_custkey) OVER (PARTITION BY o_orderstatus), 3) AS v FROM orders",
)
add(
    "an_dataset",
    "o := orders[calc identifier st := o_orderstatus][keep o_totalprice, o_custkey]; res := max(o over (partition by st order by o_orderkey));",
    "SELECT o_orderkey, o_orderstatus AS st, max(o_totalprice) OVER w AS o_totalprice, max(o_custkey) OVER w AS o_custkey FROM orders WINDOW w AS (PARTITION BY o_orderstatus ORDER BY o_orderkey)",
)

# ---- dataset operations
TWO = "a := customer[calc x := c_acctbal, y := c_nationkey * 1.0][keep x, y]; b := customer[calc x := c_acctbal / 2, y := c_custkey * 1.0][keep x, y];"
add("ds_plus_ds", TWO + "res := a + b;", "SELECT c_custkey, c_acctbal + c_acctbal / 2 AS x, c_nationkey + c_custkey::DOUBLE AS y FROM customer")
add("ds_scalar", TWO + "res := round(a * 3 - 1, 2);", "SELECT c_custkey, round(c_acctbal * 3 - 1, 2) AS x, c_nationkey * 3.0::DOUBLE - 1 AS y FROM customer")
add("ds_compare_bool_var", "res := customer#c_acctbal > 1000;", "SELECT c_custkey, c_acctbal > 1000 AS bool_var FROM customer")
add("ds_multi_bool", TWO + "res := a > b;", "SELECT c_custkey, c_acctbal > c_acctbal / 2 AS x, c_nationkey > c_custkey AS y FROM customer")
add(
    "ds_if",
    "v := customer#c_acctbal; cond := v > 1000; res := if cond then v else v * 0.5;",
    "SELECT c_custkey, CASE WHEN c_acctbal > 1000 THEN c_acctbal ELSE c_acctbal * 0.5 END AS c_acctbal FROM customer",
)
add(
    "ds_case",
    'v := customer#c_acctbal; res := case when v > 5000 then "high" when v > 0 then "low" else "none";',
    "SELECT c_custkey, CASE WHEN c_acctbal > 5000 THEN 'high' WHEN c_acctbal > 0 THEN 'low' ELSE 'none' END AS bool_var FROM customer",
)
add(
    "ds_string_functions",
    'res := substr(customer[keep c_name, c_mktsegment], 1, 4) || "!";',
    "SELECT c_custkey, substr(c_name, 1, 4) || '!' AS c_name, substr(c_mktsegment, 1, 4) || '!' AS c_mktsegment FROM customer",
)
add("ds_isnull_in", 'res := customer#c_mktsegment in {"MACHINERY", "BUILDING"};', "SELECT c_custkey, c_mktsegment IN ('MACHINERY', 'BUILDING') AS bool_var FROM customer")

# ---- validation
CHECK_SQL = "SELECT o_orderkey, {}NULL::DOUBLE AS imbalance, CASE WHEN NOT ok THEN 'low' END AS errorcode, CASE WHEN NOT ok THEN 2 END::BIGINT AS errorlevel FROM (SELECT *, o_totalprice > 50000 AS ok FROM orders){}"
add("check_all", 'res := check(orders#o_totalprice > 50000 errorcode "low" errorlevel 2 all);', CHECK_SQL.format("ok AS bool_var, ", ""))
add("check_invalid", 'res := check(orders#o_totalprice > 50000 errorcode "low" errorlevel 2 invalid);', CHECK_SQL.format("", " WHERE NOT ok"))
add(
    "check_imbalance",
    'p := orders#o_totalprice; res := check(p > 50000 errorcode "low" errorlevel 2 imbalance p - 50000);',
    CHECK_SQL.replace("NULL::DOUBLE", "o_totalprice - 50000").format("ok AS bool_var, ", ""),
)
RULES = (
    "define datapoint ruleset dr (variable o_totalprice as p, o_orderstatus as s) is "
    'open: when s = "O" then p > 100000 errorcode "open low" errorlevel 1; p > 1000 errorcode "tiny" errorlevel 5; done: when s = "F" then p < 400000 end datapoint ruleset; '
    "o := orders[keep o_totalprice, o_orderstatus];"
)
RULES_SQL = """WITH r AS (
SELECT o_orderkey, o_totalprice, o_orderstatus, 'open' AS ruleid, o_orderstatus <> 'O' OR o_totalprice > 100000 AS bool_var, CASE WHEN o_orderstatus = 'O' AND NOT o_totalprice > 100000 THEN 'open low' END AS errorcode, CASE WHEN o_orderstatus = 'O' AND NOT o_totalprice > 100000 THEN 1 END::BIGINT AS errorlevel FROM orders
UNION ALL SELECT o_orderkey, o_totalprice, o_orderstatus, 'dr_2', o_totalprice > 1000, CASE WHEN NOT o_totalprice > 1000 THEN 'tiny' END, CASE WHEN NOT o_totalprice > 1000 THEN 5 END FROM orders
UNION ALL SELECT o_orderkey, o_totalprice, o_orderstatus, 'done', o_orderstatus <> 'F' OR o_totalprice < 400000, NULL, NULL FROM orders) """
add("check_datapoint", RULES + "res := check_datapoint(o, dr);", RULES_SQL + "SELECT * EXCLUDE (bool_var) FROM r WHERE NOT bool_var")
add("check_datapoint_all", RULES + "res := check_datapoint(o, dr all);", RULES_SQL + "SELECT * FROM r")
add("check_datapoint_all_measures", RULES + "res := check_datapoint(o, dr components o_totalprice, o_orderstatus all_measures);", RULES_SQL + "SELECT * FROM r")
add(
    "check_datapoint_valuedomain",
    "define datapoint ruleset dv (valuedomain money as m) is big: m > 100000 errorcode \"x\" end datapoint ruleset; res := check_datapoint(priced, dv all)[keep bool_var, errorcode];",
    "SELECT o_orderkey, 'big' AS ruleid, o_totalprice > 100000 AS bool_var, CASE WHEN NOT o_totalprice > 100000 THEN 'x' END AS errorcode FROM orders",
    tables={"orders": ["o_orderkey"]},
    prepare=lambda s: s.bind("priced", s.inputs["orders"].df.select("o_orderkey", "o_totalprice"), ids=["o_orderkey"], value_domains={"o_totalprice": "money"}),
)
HR = (
    "define hierarchical ruleset hr (variable rule code) is total: T = O + F + P errorcode \"off\" errorlevel 4; diff: O >= T - F errorcode \"less\" errorlevel 2; M = O + X end hierarchical ruleset; "
    "base := orders[calc identifier cust := o_custkey, identifier code := if mod(o_orderkey, 11) = 0 then \"T\" else o_orderstatus, v := floor(o_totalprice / 1000) - 100][keep v]; "
    "items := base[aggr v := sum(v) group by cust, code][calc v := if mod(cust, 7) = 0 and code = \"F\" then null else if mod(cust, 5) = 0 then 0 else v];"
)
HR_SQL = """WITH base AS (SELECT o_custkey AS cust, CASE WHEN o_orderkey % 11 = 0 THEN 'T' ELSE o_orderstatus END AS code, (floor(o_totalprice / 1000) - 100)::BIGINT AS v FROM orders),
items AS (SELECT cust, code, CASE WHEN cust % 7 = 0 AND code = 'F' THEN NULL WHEN cust % 5 = 0 THEN 0 ELSE sum(v)::BIGINT END AS v FROM base GROUP BY cust, code),
g AS (SELECT cust, bool_or(code = 'T') AS pt, bool_or(code = 'O') AS po, bool_or(code = 'F') AS pf, bool_or(code = 'P') AS pp, max(v) FILTER (code = 'T') AS t, max(v) FILTER (code = 'O') AS o, max(v) FILTER (code = 'F') AS f, max(v) FILTER (code = 'P') AS p FROM items GROUP BY cust),
z AS (SELECT cust, pt, po, pf, pp, t, o, f, p, {t} AS ft, {o} AS fo, {f} AS ff, {p} AS fp, {x} AS fx FROM g),
r AS (
SELECT cust, 'T' AS code, 'total' AS ruleid, ft AS v, ft = fo + ff + fp AS bool_var, ft - (fo + ff + fp) AS imbalance, CASE WHEN NOT ft = fo + ff + fp THEN 'off' END AS errorcode, CASE WHEN NOT ft = fo + ff + fp THEN 4 END::BIGINT AS errorlevel FROM z WHERE {e1}
UNION ALL SELECT cust, 'O', 'diff', fo, fo >= ft - ff, fo - (ft - ff), CASE WHEN NOT fo >= ft - ff THEN 'less' END, CASE WHEN NOT fo >= ft - ff THEN 2 END FROM z WHERE {e2}
UNION ALL SELECT cust, 'M', 'hr_3', fx, fx = fo + fx, fx - (fo + fx), NULL, NULL FROM z WHERE {e3}) """


def hr_sql(mode: str) -> str:
    zero = mode in ("non_zero", "partial_zero", "always_zero")
    fill = {k: f"CASE WHEN p{k} THEN {k} {'ELSE 0 ' if zero else ''}END" for k in "tofp"} | {"x": "0::BIGINT" if zero else "NULL::BIGINT"}

    def emit(items: str, missing: bool) -> str:
        if mode == "non_null":
            return "false" if missing else " AND ".join(f"{k} IS NOT NULL" for k in items)
        if mode == "non_zero":
            return "(" + " OR ".join(f"(p{k} AND coalesce({k} <> 0, true))" for k in items) + ")"
        if mode.startswith("partial"):
            return "(" + " OR ".join(f"{k} IS NOT NULL" for k in items) + ")"
        return "true"

    return HR_SQL.format(**fill, e1=emit("tofp", False), e2=emit("otf", False), e3=emit("o", True))


for _mode in ("non_null", "non_zero", "partial_null", "partial_zero", "always_null", "always_zero"):
    add(f"check_hierarchy_{_mode}", HR + f"res := check_hierarchy(items, hr rule code {_mode} all_measures);", hr_sql(_mode) + "SELECT * FROM r")
add("check_hierarchy", HR + "res := check_hierarchy(items, hr rule code);", hr_sql("non_null") + "SELECT * EXCLUDE (bool_var) FROM r WHERE NOT bool_var")
add("check_hierarchy_all", HR + "res := check_hierarchy(items, hr rule code partial_zero all);", hr_sql("partial_zero") + "SELECT * EXCLUDE (v) FROM r")
add(
    "hierarchy",
    HR + 'define hierarchical ruleset hs (variable rule code) is A = O + F; B = A - P end hierarchical ruleset; res := hierarchy(items, hs rule code partial_zero);',
    HR_SQL.split("z AS")[0].rstrip().rstrip(",")
    + """, y AS (SELECT cust, o, f, p, CASE WHEN po THEN o ELSE 0 END AS fo, CASE WHEN pf THEN f ELSE 0 END AS ff, CASE WHEN pp THEN p ELSE 0 END AS fp, o IS NOT NULL OR f IS NOT NULL AS ea FROM g),
x AS (SELECT *, CASE WHEN ea THEN fo + ff END AS a, CASE WHEN ea THEN fo + ff ELSE 0 END AS fa FROM y)
SELECT cust, 'A' AS code, a AS v FROM x WHERE ea UNION ALL SELECT cust, 'B', fa - fp FROM x WHERE a IS NOT NULL OR p IS NOT NULL""",
)

# ---- time
DAILY = 'd := events[calc day := truncate_time(ts, "day")][aggr v := round(sum(value), 2), n := count() group by event_type, day];'
DAILY_SQL = "WITH d AS (SELECT event_type, date_trunc('day', ts)::TIMESTAMP AS day, round(sum(value), 2) AS v, count(*) AS n FROM events GROUP BY ALL) "
add(
    "flow_to_stock",
    DAILY + "res := flow_to_stock(d)[calc v := round(v, 2)];",
    DAILY_SQL + "SELECT event_type, day, round(sum(v) OVER w, 2) AS v, (sum(n) OVER w)::BIGINT AS n FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day ROWS UNBOUNDED PRECEDING)",
)
add(
    "stock_to_flow",
    DAILY + "res := stock_to_flow(d)[calc v := round(v, 2)];",
    DAILY_SQL + "SELECT event_type, day, round(v - coalesce(lag(v) OVER w, 0), 2) AS v, n - coalesce(lag(n) OVER w, 0) AS n FROM d WINDOW w AS (PARTITION BY event_type ORDER BY day)",
)
add("timeshift", DAILY + "res := timeshift(d, -3);", DAILY_SQL + "SELECT event_type, day - INTERVAL 3 DAY AS day, v, n FROM d")
add("time_agg", DAILY + 'e := time_agg("M", _, d); res := sum(e group by event_type, day)[calc v := round(v, 2)];', DAILY_SQL + "SELECT event_type, date_trunc('month', day)::TIMESTAMP AS day, round(sum(v), 2) AS v, sum(n)::BIGINT AS n FROM d GROUP BY ALL")
add(
    "fill_time_series",
    DAILY + "e := d[filter dayofmonth(day) <> 5 and dayofmonth(day) <> 17]; res := fill_time_series(e, single);",
    DAILY_SQL + "SELECT d.event_type, d.day, CASE WHEN day(d.day) IN (5, 17) THEN NULL ELSE v END AS v, CASE WHEN day(d.day) IN (5, 17) THEN NULL ELSE n END AS n FROM d",
)
add(
    "period_functions",
    'res := orders[calc a := cast("2020-01-01/2020-04-01", time_period), b := timeshift(cast("2020-01-01/2020-02-01", time_period), 1)][calc pa := period_indicator(a), y := getyear(b), m := getmonth(b)][keep pa, y, m];',
    "SELECT o_orderkey, 'Q' AS pa, 2020::BIGINT AS y, 2::BIGINT AS m FROM orders",
)

# ---- language: order of statements, persistent results, comments, routines, providers
add(
    "script_order",
    "res <- b[calc z := x + 1] /* read before they are assigned */; b := a[calc x := o_totalprice * 2][keep x]; // to the end of the line\na := orders;",
    "SELECT o_orderkey, o_totalprice * 2 AS x, o_totalprice * 2 + 1 AS z FROM orders",
)
add(
    "eval_routine",
    'res := eval(above(orders, 150000) language "spark" returns dataset);',
    "SELECT * FROM orders WHERE o_totalprice > 150000",
    prepare=lambda s: s.register_routine("above", lambda ds, n: Dataset(ds.df.filter(F.col("o_totalprice") > n.column), ds.structure)),
)
add(
    "provider",
    "res := orders[calc a := third(o_totalprice), b := initial(o_orderstatus)][keep a, b];",
    "SELECT o_orderkey, o_totalprice / 3 AS a, substr(o_orderstatus, 1, 1) AS b FROM orders",
    prepare=lambda s: s.use({"third": (lambda x: x / 3, ["number"], "number"), "initial": (lambda x: F.substring(x, 1, 1), ["string"], "string")}),
)
add(
    "join_left_chain",
    "a := customer[keep c_acctbal]; b := customer[filter c_acctbal > 0][keep c_nationkey]; c := customer[filter c_nationkey > 5][keep c_mktsegment]; res := left_join(a, b, c);",
    "SELECT c_custkey, c_acctbal, CASE WHEN c_acctbal > 0 THEN c_nationkey END::BIGINT AS c_nationkey, CASE WHEN c_nationkey > 5 THEN c_mktsegment END AS c_mktsegment FROM customer",
)

# ---- numbers and texts at their edges
add(
    "round_beyond",
    "res := orders[calc n := cast(mod(o_orderkey, 3) * 20 - 20, integer), x := o_totalprice * 10][calc r := round(x, n), t := trunc(x, n), u := trunc(x * power(10, 20))][keep r, t, u];",
    "SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey % 3 = 1 THEN round(o_totalprice * 10) ELSE o_totalprice * 10 END AS r, "
    "CASE WHEN o_orderkey % 3 = 0 THEN 0 WHEN o_orderkey % 3 = 1 THEN trunc(o_totalprice * 10) ELSE o_totalprice * 10 END AS t, o_totalprice * 10 * pow(10, 20) AS u FROM orders",
)
add(
    "matches_whole",
    'res := nation[calc a := match_characters(n_name, "[A-Z ]+"), b := match_characters(n_name, "A|[A-Z]*A"), c := match_characters(n_name || "x", "[A-Z]+")][keep a, b, c];',
    "SELECT n_nationkey::BIGINT AS n_nationkey, regexp_full_match(n_name, '[A-Z ]+') AS a, regexp_full_match(n_name, 'A|[A-Z]*A') AS b, regexp_full_match(n_name || 'x', '[A-Z]+') AS c FROM nation",
)
add(
    "pivot_cells",
    "a := orders[calc identifier st := o_orderstatus, identifier cust := o_custkey][aggr v := round(sum(o_totalprice), 2) group by cust, st]; res := a[pivot st, v];",
    "SELECT o_custkey AS cust, round(sum(o_totalprice) FILTER (o_orderstatus = 'F'), 2) AS F, round(sum(o_totalprice) FILTER (o_orderstatus = 'O'), 2) AS O, round(sum(o_totalprice) FILTER (o_orderstatus = 'P'), 2) AS P FROM orders GROUP BY o_custkey",
)

# ---- intervals and zones
add(
    "intervals",
    'res := orders[calc a := cast("2020-01-15/2020-03-15", time_period), b := cast("2020-01-15/P2M", time_period), c := cast("P2M/2020-03-15", time_period), d := o_orderdate + cast("P1Y2M", duration)]'
    "[calc ya := dayofyear(a), yb := dayofyear(b), yc := dayofyear(c), same := a = b and b = c, year := getyear(d), month := getmonth(d)][keep ya, yb, yc, same, year, month];",
    "SELECT o_orderkey, 15::BIGINT AS ya, 15::BIGINT AS yb, 15::BIGINT AS yc, true AS same, year(o_orderdate + INTERVAL 14 MONTH)::BIGINT AS year, month(o_orderdate + INTERVAL 14 MONTH)::BIGINT AS month FROM orders",
)
add(
    "periods_of_dates",
    'res := orders[calc m := time_agg("M", _, o_orderdate), q := time_agg("Q", _, o_orderdate), now := current_date() > o_orderdate][keep m, q, now];',
    "SELECT o_orderkey, date_trunc('month', o_orderdate)::TIMESTAMP AS m, date_trunc('quarter', o_orderdate)::TIMESTAMP AS q, true AS now FROM orders",
)
add(
    "truncate_periods",
    'res := orders[calc p := timeshift(cast("2020-02-10/2020-03-10", time_period), cast(mod(o_orderkey, 5), integer))][calc m := truncate_time(p, "month"), y := truncate_time(p, "year")]'
    "[calc d := dayofmonth(m), k := getmonth(m), i := period_indicator(m), j := period_indicator(y)][keep d, k, i, j];",
    "SELECT o_orderkey, 1::BIGINT AS d, 2 + o_orderkey % 5 AS k, 'M' AS i, 'A' AS j FROM orders",
)
add(
    "zones",
    'res := events[calc a := at_zone(ts, "+02:00"), b := truncate_time(ts, "day", "+02:00")][keep a, b];',
    "SELECT event_id, ts + INTERVAL 2 HOUR AS a, date_trunc('day', ts + INTERVAL 2 HOUR)::TIMESTAMP - INTERVAL 2 HOUR AS b FROM events",
)

# ---- priorities of hierarchical rules
PRIORITY = "define hierarchical ruleset hp (variable rule code) is T = O + F; U = T + P end hierarchical ruleset; " + HR.partition("end hierarchical ruleset; ")[2]
PRIORITY_SQL = HR_SQL.split("z AS")[0].rstrip().rstrip(",")
add(
    "hierarchy_rule_priority",
    PRIORITY + "res := hierarchy(items, hp rule code non_null rule_priority);",
    PRIORITY_SQL + " SELECT cust, 'T' AS code, o + f AS v FROM g WHERE o + f IS NOT NULL UNION ALL SELECT cust, 'U', coalesce(o + f, t) + p FROM g WHERE coalesce(o + f, t) + p IS NOT NULL",
)
add(
    "check_dataset_priority",
    PRIORITY + "res := check_hierarchy(items, hp rule code non_null dataset_priority all_measures)[keep bool_var, imbalance];",
    PRIORITY_SQL
    + " SELECT cust, 'T' AS code, 'hp_1' AS ruleid, coalesce(t, o + f) = o + f AS bool_var, coalesce(t, o + f) - (o + f) AS imbalance FROM g WHERE o + f IS NOT NULL"
    + " UNION ALL SELECT cust, 'U', 'hp_2', true, 0 FROM g WHERE coalesce(t, o + f) + p IS NOT NULL",
)

# ---- conditions of hierarchical rules
WHEN = (
    "define hierarchical ruleset hw (variable condition cust as k, n as m rule code) is late: when mod(k, 3) = 0 then T = O + F errorcode \"late\"; many: when m > 4 then O = F errorcode \"many\"; every: F = O - P end hierarchical ruleset; "
    "define hierarchical ruleset hx (variable condition cust as k rule code) is when mod(k, 3) = 0 then A = O + F; when mod(k, 3) <> 0 then A = O - F; B = A + P end hierarchical ruleset; "
    "base := orders[calc identifier cust := o_custkey, identifier code := if mod(o_orderkey, 11) = 0 then \"T\" else o_orderstatus, v := floor(o_totalprice / 1000) - 100][keep v]; "
    "items := base[aggr v := sum(v), n := count() group by cust, code][calc v := v, attribute n := n]; "
)
WHEN_SQL = """WITH items AS (SELECT o_custkey AS cust, CASE WHEN o_orderkey % 11 = 0 THEN 'T' ELSE o_orderstatus END AS code, sum((floor(o_totalprice / 1000) - 100)::BIGINT)::BIGINT AS v, count(*) AS n FROM orders GROUP BY ALL),
g AS (SELECT cust, max(v) FILTER (code = 'T') AS t, max(v) FILTER (code = 'O') AS o, max(v) FILTER (code = 'F') AS f, max(v) FILTER (code = 'P') AS p, max(v) FILTER (code = 'O' AND n > 4) AS o4, max(v) FILTER (code = 'F' AND n > 4) AS f4 FROM items GROUP BY cust) """
add(
    "check_hierarchy_when",
    WHEN + "res := check_hierarchy(items, hw rule code non_null all_measures)[drop errorlevel];",
    WHEN_SQL
    + """SELECT cust, 'T' AS code, 'late' AS ruleid, t AS v, t = o + f AS bool_var, t - (o + f) AS imbalance, CASE WHEN NOT t = o + f THEN 'late' END AS errorcode FROM g WHERE cust % 3 = 0 AND t + o + f IS NOT NULL
UNION ALL SELECT cust, 'O', 'many', o4, o4 = f4, o4 - f4, CASE WHEN NOT o4 = f4 THEN 'many' END FROM g WHERE o4 + f4 IS NOT NULL
UNION ALL SELECT cust, 'F', 'every', f, f = o - p, f - (o - p), NULL FROM g WHERE f + o + p IS NOT NULL""",
)
add(
    "hierarchy_when",
    WHEN + "res := hierarchy(items, hx rule code non_null);",
    WHEN_SQL + ", a AS (SELECT cust, p, CASE WHEN cust % 3 = 0 THEN o + f ELSE o - f END AS a FROM g) SELECT cust, 'A' AS code, a AS v FROM a WHERE a IS NOT NULL UNION ALL SELECT cust, 'B', a + p FROM a WHERE a + p IS NOT NULL",
)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return dict(Q)


def oracle_sql() -> dict[str, str]:
    return {k: q.sql for k, q in Q.items()}
