"""The decision-support suite over the test tables.

The test tables lack some columns and one table of the suite. They are made from keys by fixed rules (the first part of each text), and literals are moved to
values that occur. Results come in the suite's order.
"""

from __future__ import annotations

from millrace.plans.dialect import OTHER, Dialect, query, render


class _Made:
    """Columns made from keys."""

    def __init__(self, x: Dialect) -> None:
        self.x = x
        spark = type(x) is Dialect
        add = (lambda c, n: f"date_add(CAST({c} AS DATE), CAST({n} AS INT))") if spark else (lambda c, n: f"(CAST({c} AS DATE) + CAST({n} AS INTEGER))")
        pick = lambda n, values: "CASE " + " ".join(f"WHEN {n} % {len(values)} = {i} THEN '{v}'" for i, v in enumerate(values)) + " END"
        self.lines = f"""lines AS (SELECT *, {add("l_shipdate", "(l_partkey + l_linenumber) % 60 - 20")} AS l_commitdate, {add("l_shipdate", "(l_suppkey + l_orderkey) % 30 + 1")} AS l_receiptdate,
  {pick("(l_orderkey + l_linenumber)", ["MAIL", "SHIP", "AIR", "AIR REG", "RAIL", "TRUCK", "FOB"])} AS l_shipmode,
  {pick("(l_partkey + l_suppkey)", ["DELIVER IN PERSON", "COLLECT COD", "NONE", "TAKE BACK RETURN"])} AS l_shipinstruct FROM lineitem)"""
        self.offers = """offers AS (SELECT DISTINCT l_partkey AS ps_partkey, l_suppkey AS ps_suppkey, (l_partkey * 7 + l_suppkey * 13) % 99 + 1 AS ps_availqty,
  CAST((l_partkey * 31 + l_suppkey * 17) % 100000 AS DOUBLE) / 100 AS ps_supplycost FROM lineitem)"""
        self.parts = f"""parts AS (SELECT *, {pick("p_partkey", ["SM CASE", "SM BOX", "MED BAG", "MED BOX", "LG CASE", "LG BOX", "WRAP JAR"])} AS p_container, concat('MFGR-', CAST(p_partkey % 5 AS STRING)) AS p_mfgr FROM part)"""
        self.customers = "customers AS (SELECT *, concat(CAST(10 + c_nationkey AS STRING), '-', CAST(100 + c_custkey % 900 AS STRING)) AS c_phone, concat('road ', CAST(c_custkey * 3 AS STRING)) AS c_address, concat('customer of ', CAST(c_nationkey AS STRING)) AS c_comment FROM customer)"
        self.ordered = """ordered AS (SELECT *, CASE WHEN o_orderkey % 11 = 0 THEN 'quick special late requests' WHEN o_orderkey % 7 = 0 THEN 'special packages' ELSE 'plain' END AS o_comment, o_custkey % 2 AS o_shippriority FROM orders)"""
        self.sellers = "sellers AS (SELECT *, CASE WHEN s_suppkey % 9 = 0 THEN 'Customer had Complaints' ELSE 'fine' END AS s_comment, concat('street ', CAST(s_suppkey * 7 AS STRING)) AS s_address, concat(CAST(10 + s_nationkey AS STRING), '-', CAST(s_suppkey AS STRING)) AS s_phone FROM supplier)"

    def year(self, column: str) -> str:
        return f"CAST(EXTRACT(YEAR FROM {column}) AS BIGINT)"


def _with(*parts: str):
    """A text that begins with the named made tables; a body that begins with + goes on with steps of its own."""

    def wrap(body):
        def text(x: Dialect) -> str:
            made = _Made(x)
            rest = body(made) if callable(body) else body
            steps = [getattr(made, p) for p in parts]
            if rest.startswith("+"):
                return "WITH " + ",\n".join([*steps, rest[1:].lstrip()])
            return ("WITH " + ",\n".join(steps) + "\n" if steps else "") + rest

        return text

    return wrap


_R = "l_extendedprice * (1 - l_discount)"

TEXTS = {
    "tpch_q01": _with()(
        f"""SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base, round(sum({_R}), 2) AS sum_disc, round(sum({_R} * (1 + l_tax)), 2) AS sum_charge,
round(avg(l_quantity), 4) AS avg_qty, round(avg(l_extendedprice), 4) AS avg_price, round(avg(l_discount), 4) AS avg_disc, count(*) AS n
FROM lineitem WHERE l_shipdate < DATE '2001-06-01' GROUP BY l_returnflag, l_linestatus ORDER BY l_returnflag, l_linestatus"""
    ),
    "tpch_q02": _with("offers", "parts", "sellers")(
        """SELECT s.s_acctbal, s.s_name, n.n_name, p.p_partkey, p.p_mfgr, s.s_address, s.s_phone, s.s_comment
FROM parts p JOIN offers f ON f.ps_partkey = p.p_partkey JOIN sellers s ON s.s_suppkey = f.ps_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN region r ON r.r_regionkey = n.n_regionkey
WHERE p.p_size < 15 AND p.p_type LIKE '%Y' AND r.r_name = 'EUROPE' AND f.ps_supplycost = (
  SELECT min(f2.ps_supplycost) FROM offers f2 JOIN supplier s2 ON s2.s_suppkey = f2.ps_suppkey JOIN nation n2 ON n2.n_nationkey = s2.s_nationkey JOIN region r2 ON r2.r_regionkey = n2.n_regionkey
  WHERE f2.ps_partkey = p.p_partkey AND r2.r_name = 'EUROPE')
ORDER BY s.s_acctbal DESC, n.n_name, s.s_name, p.p_partkey"""
    ),
    "tpch_q03": _with("ordered")(
        f"""SELECT o.o_orderkey, round(sum({_R}), 2) AS revenue, o.o_orderdate, o.o_shippriority FROM customer c JOIN ordered o ON o.o_custkey = c.c_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey
WHERE c.c_mktsegment = 'BUILDING' AND o.o_orderdate < DATE '1998-03-15' AND l.l_shipdate > DATE '1998-03-15' GROUP BY o.o_orderkey, o.o_orderdate, o.o_shippriority ORDER BY revenue DESC, o.o_orderdate"""
    ),
    "tpch_q04": _with("lines")(
        """SELECT o_orderpriority, count(*) AS n FROM orders o LEFT SEMI JOIN (SELECT l_orderkey FROM lines WHERE l_commitdate < l_receiptdate) t ON t.l_orderkey = o.o_orderkey
WHERE o_orderdate >= DATE '1996-07-01' AND o_orderdate < DATE '1996-10-01' GROUP BY o_orderpriority ORDER BY o_orderpriority"""
    ),
    "tpch_q05": _with()(
        f"""SELECT n.n_name, round(sum({_R}), 2) AS revenue FROM region r JOIN nation n ON n.n_regionkey = r.r_regionkey JOIN supplier s ON s.s_nationkey = n.n_nationkey JOIN lineitem l ON l.l_suppkey = s.s_suppkey
JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey AND c.c_nationkey = n.n_nationkey
WHERE r.r_name = 'ASIA' AND o.o_orderdate >= DATE '1996-01-01' AND o.o_orderdate < DATE '1997-01-01' GROUP BY n.n_name ORDER BY revenue DESC"""
    ),
    "tpch_q06": _with()(
        "SELECT round(sum(l_extendedprice * l_discount), 2) AS revenue FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1997-01-01' AND l_discount BETWEEN CAST(0.0499 AS DOUBLE) AND CAST(0.0701 AS DOUBLE) AND l_quantity < 24"
    ),
    "tpch_q07": _with()(
        lambda m: f"""+ moved AS (SELECT a.n_name AS supp, b.n_name AS cust, {m.year("l.l_shipdate")} AS yr, {_R} AS volume FROM lineitem l JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation a ON a.n_nationkey = s.s_nationkey
  JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation b ON b.n_nationkey = c.c_nationkey WHERE l.l_shipdate BETWEEN DATE '1996-01-01' AND DATE '1997-12-31')
SELECT supp, cust, yr, round(sum(volume), 2) AS revenue FROM moved WHERE (supp, cust) IN (('NATION_6', 'NATION_7'), ('NATION_7', 'NATION_6')) GROUP BY supp, cust, yr ORDER BY supp, cust, yr"""
    ),
    "tpch_q08": _with()(
        lambda m: f"""+ sold AS (SELECT {m.year("o.o_orderdate")} AS yr, {_R} AS volume, sn.n_name AS nation FROM part p JOIN lineitem l ON l.l_partkey = p.p_partkey JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation sn ON sn.n_nationkey = s.s_nationkey
  JOIN orders o ON o.o_orderkey = l.l_orderkey JOIN customer c ON c.c_custkey = o.o_custkey JOIN nation cn ON cn.n_nationkey = c.c_nationkey JOIN region r ON r.r_regionkey = cn.n_regionkey
  WHERE r.r_name = 'AMERICA' AND p.p_type = 'ECONOMY' AND o.o_orderdate BETWEEN DATE '1996-01-01' AND DATE '1997-12-31')
SELECT yr, round(sum(CASE WHEN nation = 'NATION_3' THEN volume ELSE 0 END) / sum(volume), 4) AS share FROM sold GROUP BY yr ORDER BY yr"""
    ),
    "tpch_q09": _with("offers")(
        lambda m: f"""+ gains AS (SELECT n.n_name AS nation, {m.year("o.o_orderdate")} AS yr, {_R} - f.ps_supplycost * l.l_quantity AS amount FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey
  JOIN offers f ON f.ps_partkey = l.l_partkey AND f.ps_suppkey = l.l_suppkey JOIN supplier s ON s.s_suppkey = l.l_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey JOIN orders o ON o.o_orderkey = l.l_orderkey WHERE p.p_name LIKE '%re%')
SELECT nation, yr, round(sum(amount), 2) AS profit FROM gains GROUP BY nation, yr ORDER BY nation, yr DESC"""
    ),
    "tpch_q10": _with("customers")(
        f"""SELECT c.c_custkey, c.c_name, round(sum({_R}), 2) AS revenue, round(c.c_acctbal, 2) AS acctbal, n.n_name, c.c_address, c.c_phone, c.c_comment FROM customers c JOIN nation n ON n.n_nationkey = c.c_nationkey JOIN orders o ON o.o_custkey = c.c_custkey
JOIN lineitem l ON l.l_orderkey = o.o_orderkey WHERE l.l_returnflag = 'R' AND o.o_orderdate >= DATE '1996-10-01' AND o.o_orderdate < DATE '1997-01-01' GROUP BY c.c_custkey, c.c_name, c.c_acctbal, c.c_phone, n.n_name, c.c_address, c.c_comment ORDER BY revenue DESC"""
    ),
    "tpch_q11": _with("offers")(
        """+ held AS (SELECT f.ps_partkey, sum(f.ps_supplycost * f.ps_availqty) AS worth FROM offers f JOIN supplier s ON s.s_suppkey = f.ps_suppkey JOIN nation n ON n.n_nationkey = s.s_nationkey WHERE n.n_name = 'NATION_6' GROUP BY f.ps_partkey)
SELECT ps_partkey, round(worth, 2) AS worth FROM held WHERE worth > (SELECT sum(worth) * CAST(0.001 AS DOUBLE) FROM held) ORDER BY worth DESC"""
    ),
    "tpch_q12": _with("lines")(
        """SELECT l.l_shipmode, count_if(o.o_orderpriority IN ('1-URGENT', '2-HIGH')) AS high, count_if(o.o_orderpriority NOT IN ('1-URGENT', '2-HIGH')) AS low FROM lines l JOIN orders o ON o.o_orderkey = l.l_orderkey
WHERE l.l_shipmode IN ('MAIL', 'SHIP') AND l.l_commitdate < l.l_receiptdate AND CAST(l.l_shipdate AS DATE) < l.l_commitdate AND l.l_receiptdate >= DATE '1996-01-01' AND l.l_receiptdate < DATE '1997-01-01' GROUP BY l.l_shipmode ORDER BY l.l_shipmode"""
    ),
    "tpch_q13": _with("ordered")(
        """+ each AS (SELECT c.c_custkey, count(o.o_orderkey) AS orders FROM customer c LEFT JOIN ordered o ON o.o_custkey = c.c_custkey AND o.o_comment NOT LIKE '%special%requests%' AND o.o_orderstatus = 'F' GROUP BY c.c_custkey)
SELECT orders, count(*) AS customers FROM each GROUP BY orders ORDER BY customers DESC, orders DESC"""
    ),
    "tpch_q14": _with()(
        f"""SELECT round(100 * sum(CASE WHEN p.p_type LIKE 'PROMO%' THEN {_R} ELSE 0 END) / sum({_R}), 4) AS share FROM lineitem l JOIN part p ON p.p_partkey = l.l_partkey WHERE l.l_shipdate >= DATE '1996-09-01' AND l.l_shipdate < DATE '1996-10-01'"""
    ),
    "tpch_q15": _with("sellers")(
        f"""+ revenue AS (SELECT l_suppkey, round(sum({_R}), 2) AS total FROM lineitem WHERE l_shipdate >= DATE '1996-01-01' AND l_shipdate < DATE '1996-04-01' GROUP BY l_suppkey)
SELECT s.s_suppkey, s.s_name, s.s_address, s.s_phone, v.total FROM sellers s JOIN revenue v ON v.l_suppkey = s.s_suppkey WHERE v.total = (SELECT max(total) FROM revenue) ORDER BY s.s_suppkey"""
    ),
    "tpch_q16": _with("offers", "sellers")(
        """SELECT p.p_brand, p.p_type, p.p_size, count(DISTINCT f.ps_suppkey) AS suppliers FROM offers f JOIN part p ON p.p_partkey = f.ps_partkey WHERE p.p_brand <> 'Brand#45' AND p.p_type NOT LIKE 'MEDIUM%' AND p.p_size IN (49, 14, 23, 45, 19, 3, 36, 9)
AND f.ps_suppkey NOT IN (SELECT s_suppkey FROM sellers WHERE s_comment LIKE '%Customer%Complaints%') GROUP BY p.p_brand, p.p_type, p.p_size ORDER BY suppliers DESC, p.p_brand, p.p_type, p.p_size"""
    ),
    "tpch_q17": _with("parts")(
        """SELECT round(sum(l.l_extendedprice) / 7, 2) AS yearly FROM lineitem l JOIN parts p ON p.p_partkey = l.l_partkey
WHERE p.p_container = 'MED BOX' AND l.l_quantity < (SELECT avg(u.l_quantity) / 5 FROM lineitem u WHERE u.l_partkey = p.p_partkey)"""
    ),
    "tpch_q18": _with()(
        """SELECT c.c_name, c.c_custkey, o.o_orderkey, o.o_orderdate, round(o.o_totalprice, 2) AS price, round(sum(l.l_quantity), 2) AS qty
FROM orders o JOIN customer c ON c.c_custkey = o.o_custkey JOIN lineitem l ON l.l_orderkey = o.o_orderkey
WHERE o.o_orderkey IN (SELECT l_orderkey FROM lineitem GROUP BY l_orderkey HAVING sum(l_quantity) > 250)
GROUP BY c.c_name, c.c_custkey, o.o_orderkey, o.o_orderdate, o.o_totalprice ORDER BY price DESC, o.o_orderdate"""
    ),
    "tpch_q19": _with("lines", "parts")(
        f"""SELECT round(sum({_R}), 2) AS revenue FROM lines l JOIN parts p ON p.p_partkey = l.l_partkey WHERE l.l_shipmode IN ('AIR', 'AIR REG') AND l.l_shipinstruct = 'DELIVER IN PERSON' AND (
(p.p_container LIKE 'SM%' AND l.l_quantity BETWEEN 1 AND 21 AND p.p_size BETWEEN 1 AND 15) OR (p.p_container LIKE 'MED%' AND l.l_quantity BETWEEN 10 AND 30 AND p.p_size BETWEEN 1 AND 30) OR (p.p_container LIKE 'LG%' AND l.l_quantity BETWEEN 20 AND 50 AND p.p_size BETWEEN 1 AND 45))"""
    ),
    "tpch_q20": _with("offers", "sellers")(
        """SELECT s.s_name, s.s_address FROM sellers s JOIN nation n ON n.n_nationkey = s.s_nationkey
WHERE n.n_regionkey < 3 AND s.s_suppkey IN (
  SELECT f.ps_suppkey FROM offers f WHERE f.ps_partkey IN (SELECT p_partkey FROM part WHERE p_name LIKE 's%') AND f.ps_availqty > (
    SELECT sum(l.l_quantity) / 2 FROM lineitem l WHERE l.l_partkey = f.ps_partkey AND l.l_suppkey = f.ps_suppkey
    AND l.l_shipdate >= DATE '1996-01-01' AND l.l_shipdate < DATE '1996-01-01' + INTERVAL '1' YEAR))
ORDER BY s.s_name"""
    ),
    "tpch_q21": _with("lines")(
        """SELECT s.s_name, count(*) AS waits FROM supplier s JOIN lines a ON a.l_suppkey = s.s_suppkey JOIN orders o ON o.o_orderkey = a.l_orderkey JOIN nation n ON n.n_nationkey = s.s_nationkey
WHERE o.o_orderstatus = 'F' AND a.l_receiptdate > a.l_commitdate AND n.n_regionkey < 3 AND EXISTS (SELECT 1 FROM lines b WHERE b.l_orderkey = a.l_orderkey AND b.l_suppkey <> a.l_suppkey)
AND NOT EXISTS (SELECT 1 FROM lines c WHERE c.l_orderkey = a.l_orderkey AND c.l_suppkey <> a.l_suppkey AND c.l_receiptdate > c.l_commitdate) GROUP BY s.s_name ORDER BY waits DESC, s.s_name"""
    ),
    "tpch_q22": _with("customers")(
        """+ coded AS (SELECT c_custkey, c_acctbal, substring(c_phone FROM 1 FOR 2) AS code FROM customers),
chosen AS (SELECT * FROM coded WHERE code IN ('13', '31', '23', '29', '30', '18', '17'))
SELECT code, count(*) AS customers, round(sum(c_acctbal), 2) AS balance FROM chosen WHERE c_acctbal > (SELECT avg(c_acctbal) FROM chosen WHERE c_acctbal > 0)
AND NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = chosen.c_custkey AND o.o_orderstatus = 'P' AND o.o_orderdate >= DATE '1998-01-01') GROUP BY code ORDER BY code"""
    ),
}

QUERIES = {k: query(v) for k, v in TEXTS.items()}
SQL = {k: render(v, OTHER).replace("LEFT SEMI JOIN", "SEMI JOIN") for k, v in TEXTS.items()}
