"""DuckDB SQL twins of the fixture queries (same column names and types).

Written independently as plain SQL — pairs, correlated subqueries and list
slicing are fine here, this only has to be obviously right on sf0.01.
Rounding is DuckDB's own ``round`` of a DOUBLE (halves away from zero).
"""

from __future__ import annotations


def R(expr: str, d: int) -> str:
    return f"round(CAST(({expr}) AS DOUBLE), {d})"


EV_AS_OF = "TIMESTAMP '2024-01-31 00:00:00'"
ORD_AS_OF = "TIMESTAMP '2001-08-02 00:00:00'"

COUNTERS = """
counters AS (
  WITH ev AS (SELECT user_id % 3 AS instance_id, CAST(ts AS DATE) AS d, event_type AS stat FROM events),
  days AS (SELECT instance_id, CAST(unnest(generate_series(CAST(min(d) AS TIMESTAMP), CAST(max(d) AS TIMESTAMP), INTERVAL 1 DAY)) AS DATE) AS d
           FROM ev GROUP BY instance_id),
  spine AS (SELECT instance_id, d, stat FROM days, (VALUES ('click'),('error'),('purchase'),('signup'),('view')) s(stat)),
  daily AS (SELECT instance_id, d, stat, count(*) AS n FROM ev GROUP BY ALL)
  SELECT s.instance_id, s.d, s.stat,
         CAST(SUM(COALESCE(n, 0)) OVER (PARTITION BY s.instance_id, s.stat ORDER BY s.d
              ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS BIGINT) AS value,
         CAST(date_diff('day', DATE '2024-01-01', s.d) AS BIGINT) AS snap_id,
         CAST(date_diff('day', DATE '2024-01-01', s.d) // 10 AS BIGINT) AS startup
  FROM spine s LEFT JOIN daily USING (instance_id, d, stat))
"""

PAIR = COUNTERS + """,
snaps AS (SELECT DISTINCT instance_id, snap_id, startup FROM counters),
p AS (SELECT instance_id, snap_id AS begin_snap,
             lead(snap_id) OVER (PARTITION BY instance_id, startup ORDER BY snap_id) AS end_snap FROM snaps),
pair AS (SELECT instance_id, arg_max(begin_snap, end_snap) AS begin_snap, max(end_snap) AS end_snap
         FROM p WHERE end_snap IS NOT NULL GROUP BY instance_id)
"""

DELTA = PAIR + """,
delta AS (
  SELECT c.instance_id, c.stat, pair.begin_snap, pair.end_snap,
         max(CASE WHEN c.snap_id = pair.begin_snap THEN c.value END) AS begin_value,
         max(CASE WHEN c.snap_id = pair.end_snap THEN c.value END) AS end_value
  FROM counters c JOIN pair ON c.instance_id = pair.instance_id
  WHERE c.snap_id IN (pair.begin_snap, pair.end_snap)
  GROUP BY ALL)
"""

HOURS = ", ".join(f"count(*) FILTER (WHERE hour(ts) = {h}) AS h{h:02d}" for h in range(24))
RED_CELLS = " + ".join(f"CAST(count(*) FILTER (WHERE hour(ts) = {h}) > 10 AS BIGINT)" for h in range(24))

LINES = "(SELECT doc_id, lang, unnest(string_split_regex(text, '\\r?\\n')) AS line FROM documents)"

DOC_CASE = """CASE
  WHEN regexp_matches(line, '(?i)licen[cs]e') THEN 'license'
  WHEN regexp_matches(line, '\\+1 \\(\\d{3}\\) \\d{3}-\\d{4}') THEN 'phone'
  WHEN regexp_matches(line, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]+') THEN 'email'
  WHEN regexp_matches(line, '\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}\\.\\d{1,3}') THEN 'ip'
  WHEN regexp_matches(line, '(?i)(password|passwd|secret|api[_-]?key|token)') THEN 'secret'
END"""

SQL: dict[str, str] = {}

SQL["hour_matrix"] = f"""
SELECT user_id % 3 AS instance_id, strftime(ts, '%Y-%m-%d') AS day, {HOURS}, count(*) AS total,
       ({RED_CELLS}) AS red_cells, count(*) > 120 AS is_abnormal
FROM events GROUP BY 1, 2"""

SQL["threshold_flag"] = """
SELECT s_suppkey, s_name, s_acctbal AS metric, COALESCE(s_acctbal < 0, false) AS is_abnormal,
       CAST(0 AS DOUBLE) AS threshold
FROM supplier"""

SQL["utilization_pct"] = f"""
WITH p AS (SELECT p_partkey, p_size AS used, CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE 50.0::DOUBLE END AS limit_value FROM part)
SELECT *, {R("100.0::DOUBLE * (CAST(used AS DOUBLE) / NULLIF(CAST(limit_value AS DOUBLE), 0))", 2)} AS pct,
       COALESCE({R("100.0::DOUBLE * (CAST(used AS DOUBLE) / NULLIF(CAST(limit_value AS DOUBLE), 0))", 2)} >= 90, false) AS is_abnormal
FROM p"""

SQL["config_audit"] = """
WITH rules(name, kind, expected, advice) AS (VALUES
  ('AUTOMOBILE', 'lt', '0', 'balance below zero'),
  ('BUILDING', 'gt', '9000', 'balance above 9000'),
  ('FURNITURE', 'lt', '-500', 'balance below -500'),
  ('HOUSEHOLD', 'ge', '9500', 'balance at or above 9500'),
  ('MACHINERY', 'eq', '0', 'balance exactly zero'))
SELECT c_custkey, c_mktsegment AS setting_name, c_acctbal AS setting_value, kind, expected,
       CAST(expected AS DOUBLE) AS threshold,
       COALESCE(CASE kind WHEN 'lt' THEN c_acctbal < CAST(expected AS DOUBLE)
                          WHEN 'gt' THEN c_acctbal > CAST(expected AS DOUBLE)
                          WHEN 'ge' THEN c_acctbal >= CAST(expected AS DOUBLE)
                          WHEN 'eq' THEN c_acctbal = CAST(expected AS DOUBLE) END, false) AS is_abnormal,
       advice
FROM customer JOIN rules ON c_mktsegment = rules.name"""

SQL["settings_select"] = """
SELECT n_nationkey, n_name AS name, n_name || ' ' || r_name AS display_value
FROM nation JOIN region ON n_regionkey = r_regionkey
WHERE n_name IN ('NATION_1','NATION_3','NATION_5','NATION_8','NATION_13','NATION_17','NATION_21','NATION_24')"""

SQL["status_wide"] = """
SELECT user_id % 3 AS instance_id,
       count(*) FILTER (WHERE event_type = 'click') AS n_click,
       count(*) FILTER (WHERE event_type = 'error') AS n_error,
       count(*) FILTER (WHERE event_type = 'purchase') AS n_purchase,
       count(*) FILTER (WHERE event_type = 'signup') AS n_signup,
       count(*) FILTER (WHERE event_type = 'view') AS n_view
FROM events GROUP BY 1"""

SQL["topn"] = """
SELECT * FROM (
  SELECT o_orderstatus, o_orderkey, o_totalprice,
         row_number() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice DESC, o_orderkey) AS rn
  FROM orders) WHERE rn <= 10"""

SQL["topn_per_group"] = """
SELECT * FROM (
  SELECT p_brand, p_partkey, p_retailprice,
         row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_partkey) AS rn
  FROM part) WHERE rn <= 3"""

SQL["latest_per_key"] = """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders)
SELECT c_custkey, CAST(o_orderkey AS DOUBLE) AS o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS last_order_date, o_totalprice
FROM customer LEFT JOIN o ON o.o_custkey = c_custkey AND o.rn = 1"""

SQL["recent_failures"] = f"""
SELECT * FROM (
  SELECT user_id, event_id, strftime(ts, '%Y-%m-%d %H:%M:%S') AS ts, value,
         dense_rank() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rnk
  FROM events
  WHERE event_type = 'error' AND ts >= {EV_AS_OF} - INTERVAL 7 DAY AND ts < {EV_AS_OF})
WHERE rnk <= 3"""

SQL["long_running"] = f"""
SELECT o_orderkey, o_custkey, date_diff('second', o_orderdate, {ORD_AS_OF}) AS elapsed_s,
       CAST(floor(date_diff('second', o_orderdate, {ORD_AS_OF}) / 86400) AS BIGINT) AS age_days,
       date_diff('second', o_orderdate, {ORD_AS_OF}) > 1825 * 86400 AS is_abnormal
FROM orders
WHERE o_orderstatus = 'O' AND date_diff('second', o_orderdate, {ORD_AS_OF}) > 365 * 86400"""

SQL["age_flag"] = f"""
WITH last AS (SELECT o_custkey, max(o_orderdate) AS last_ts FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1)
SELECT c_custkey, strftime(last_ts, '%Y-%m-%d') AS last_date,
       CAST(date_diff('day', CAST(last_ts AS DATE), CAST({ORD_AS_OF} AS DATE)) AS DOUBLE) AS age_days,
       COALESCE(last_ts IS NULL OR date_diff('day', CAST(last_ts AS DATE), CAST({ORD_AS_OF} AS DATE)) > 1000, false) AS is_abnormal
FROM customer LEFT JOIN last ON o_custkey = c_custkey"""

SQL["expiry_window"] = """
SELECT l_orderkey, l_linenumber, l_partkey,
       date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) AS days_left,
       date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) <= 7 AS is_abnormal
FROM lineitem JOIN orders ON o_orderkey = l_orderkey
WHERE date_diff('day', CAST(o_orderdate AS DATE), CAST(l_shipdate AS DATE)) BETWEEN 0 AND 30"""

SQL["blocking_pairs"] = """
WITH l AS (SELECT event_id, strftime(ts, '%Y-%m-%d') AS day, event_type, NULLIF(user_id % 10, 0) AS lock_key,
                  value >= 1 AS granted FROM events)
SELECT w.day, w.event_type, CAST(w.lock_key AS DOUBLE) AS lock_key, w.event_id AS waiter, count(*) AS n_holders, min(h.event_id) AS first_holder
FROM l w JOIN l h ON w.day = h.day AND w.event_type = h.event_type AND w.lock_key IS NOT DISTINCT FROM h.lock_key
                 AND h.event_id <> w.event_id
WHERE NOT w.granted AND h.granted
GROUP BY ALL"""

SQL["blocking_parent"] = """
SELECT c.conv_id, c.turn, c.role, CAST(p.turn AS DOUBLE) AS blocker_turn, p.role AS blocker_role
FROM conversations c LEFT JOIN conversations p ON p.conv_id = c.conv_id AND p.turn = c.turn - 1"""

SQL["missing_related"] = """
SELECT c_custkey, c_name FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderpriority = '1-URGENT')"""

SQL["member_of"] = """
SELECT doc_id, lang, source FROM documents WHERE doc_id IN (SELECT doc_id FROM labels WHERE toxic = 1)"""

SQL["backup_freshness"] = f"""
SELECT o_custkey AS c_custkey, CAST(o_orderkey AS DOUBLE) AS o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS order_date, 'history' AS kind
FROM orders WHERE o_orderdate >= {ORD_AS_OF} - INTERVAL 90 DAY
UNION ALL
SELECT c_custkey, NULL::DOUBLE, NULL, 'missing' FROM customer c
WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderdate >= {ORD_AS_OF} - INTERVAL 90 DAY)"""

SQL["duplicate_index"] = """
WITH m AS (SELECT DISTINCT l_linenumber, l_partkey, l_orderkey FROM lineitem
           WHERE l_linenumber IS NOT NULL AND l_partkey IS NOT NULL AND l_orderkey IS NOT NULL),
s AS (SELECT l_linenumber, l_partkey, count(*) AS n_sharing, min(l_orderkey) AS first_index,
             max(l_orderkey) AS last_index
      FROM m GROUP BY ALL HAVING count(*) > 1)
SELECT m.l_linenumber, m.l_partkey, m.l_orderkey, s.n_sharing, s.first_index, s.last_index
FROM m JOIN s ON m.l_linenumber = s.l_linenumber AND m.l_partkey = s.l_partkey"""

SQL["redundant_index"] = """
WITH l AS (SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, list(event_type ORDER BY event_id) AS cols
           FROM events GROUP BY ALL)
SELECT a.day, a.user_id, CAST(len(a.cols) AS BIGINT) AS width, count(*) AS n_covering, min(b.user_id) AS first_covering
FROM l a JOIN l b ON a.day = b.day AND len(b.cols) > len(a.cols) AND b.cols[1:len(a.cols)] = a.cols
GROUP BY ALL"""

SQL["type_limit_usage"] = f"""
WITH lim(prefix, mx) AS (VALUES ('standard', 1500), ('standard red', 1200), ('small', 1000), ('small small', 900),
  ('large', 2500), ('large hot', 2000), ('economy', 1100), ('economy blue', 1000), ('medium', 1800),
  ('medium old', 1600), ('promo', 2200), ('promo red widget', 1300)),
p AS (SELECT p_partkey, p_type || ' ' || p_name AS type_name, p_retailprice FROM part),
m AS (SELECT p.*, lim.prefix, lim.mx,
             row_number() OVER (PARTITION BY p_partkey ORDER BY length(lim.prefix) DESC, lim.prefix) AS rk
      FROM p LEFT JOIN lim ON starts_with(lower(type_name), lim.prefix))
SELECT p_partkey, type_name, prefix AS type_prefix, CAST(mx AS BIGINT) AS type_max,
       {R("100.0::DOUBLE * p_retailprice / CAST(mx AS DOUBLE)", 2)} AS pct_of_max,
       COALESCE({R("100.0::DOUBLE * p_retailprice / CAST(mx AS DOUBLE)", 2)} > 80, false) AS is_abnormal
FROM m WHERE rk = 1"""

SQL["object_matrix"] = """
SELECT n_nationkey, n_name,
       (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey) AS n_customers,
       (SELECT count(*) FROM supplier WHERE s_nationkey = n_nationkey) AS n_suppliers,
       (SELECT count(*) FROM customer WHERE c_nationkey = n_nationkey AND c_acctbal < 0) AS n_neg_customers
FROM nation"""

SQL["daily_volume"] = f"""
SELECT user_id % 3 AS instance_id, strftime(ts, '%Y-%m-%d') AS day,
       CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS volume
FROM events WHERE ts >= {EV_AS_OF} - INTERVAL 10 DAY AND ts < {EV_AS_OF}
GROUP BY 1, 2"""

SQL["daily_growth"] = """
WITH l AS (SELECT user_id % 3 AS instance_id, user_id, strftime(ts, '%Y-%m-%d') AS day, value,
                  row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m-%d') ORDER BY ts DESC, event_id DESC) AS rk
           FROM events),
t AS (SELECT instance_id, day, sum(CAST(value AS DECIMAL(18,2))) AS total FROM l WHERE rk = 1 GROUP BY ALL)
SELECT instance_id, day, CAST(total AS DOUBLE) AS total,
       CAST(total - lag(total) OVER (PARTITION BY instance_id ORDER BY day) AS DOUBLE) AS growth
FROM t"""

SQL["snapshot_pair"] = "WITH " + PAIR + "SELECT instance_id, begin_snap, end_snap FROM pair"

SQL["snapshot_delta"] = "WITH " + DELTA + """
SELECT instance_id, stat, begin_snap, end_snap, begin_value, end_value,
       CASE WHEN end_value - begin_value >= 0 THEN end_value - begin_value END AS delta
FROM delta WHERE begin_value IS NOT NULL AND end_value IS NOT NULL"""

SQL["rate_per_second"] = "WITH " + DELTA + f""",
d2 AS (SELECT instance_id, stat, CASE WHEN end_value - begin_value >= 0 THEN end_value - begin_value END AS delta
       FROM delta WHERE begin_value IS NOT NULL AND end_value IS NOT NULL)
SELECT instance_id, stat, delta, {R("CAST(delta AS DOUBLE) / 86400.0", 6)} AS per_sec FROM d2"""

SQL["ratio_kpi"] = f"""
WITH w AS (SELECT user_id % 3 AS instance_id,
                  count(*) FILTER (WHERE event_type = 'error') AS n_error,
                  count(*) FILTER (WHERE event_type = 'click') AS n_click,
                  count(*) FILTER (WHERE event_type = 'view') AS n_view,
                  count(*) AS n_all
           FROM events GROUP BY 1),
r AS (SELECT *, {R("100.0::DOUBLE * (1.0::DOUBLE - CAST(n_error AS DOUBLE) / NULLIF(CAST(n_all AS DOUBLE), 0))", 4)} AS success_pct,
             {R("100.0::DOUBLE * (CAST(n_click AS DOUBLE) / NULLIF(CAST(n_click + n_view AS DOUBLE), 0))", 4)} AS ctr_pct
      FROM w)
SELECT *, COALESCE(success_pct < 80 OR ctr_pct < 80, false) AS is_abnormal FROM r"""

SQL["time_share"] = f"""
WITH g AS (SELECT user_id % 3 AS instance_id, event_type, sum(CAST(value AS DECIMAL(18,2))) AS total_value
           FROM events GROUP BY ALL)
SELECT instance_id, event_type, CAST(total_value AS DOUBLE) AS total_value,
       CASE WHEN event_type <> 'view' THEN
         {R("100.0::DOUBLE * CAST(total_value AS DOUBLE) / CAST(sum(CASE WHEN event_type <> 'view' THEN total_value END) OVER (PARTITION BY instance_id) AS DOUBLE)", 2)}
       END AS pct
FROM g"""

SQL["pareto"] = f"""
WITH r AS (SELECT n_name, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS revenue
           FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey
           WHERE n_name NOT IN ('NATION_3', 'NATION_7') GROUP BY n_name),
w AS (SELECT n_name, revenue, sum(revenue) OVER () AS total,
             sum(revenue) OVER (ORDER BY revenue DESC, n_name ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS running,
             row_number() OVER (ORDER BY revenue DESC, n_name) AS rn
      FROM r)
SELECT n_name, CAST(revenue AS DOUBLE) AS revenue,
       {R("100.0::DOUBLE * CAST(revenue AS DOUBLE) / CAST(total AS DOUBLE)", 4)} AS pct,
       {R("100.0::DOUBLE * CAST(running AS DOUBLE) / CAST(total AS DOUBLE)", 4)} AS running_pct, rn
FROM w WHERE rn <= 20"""

SQL["sql_window_stats"] = f"""
WITH g AS (SELECT l_returnflag, l_partkey, sum(CAST(l_quantity AS DECIMAL(18,2))) AS qty,
                  sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS elapsed, count(*) AS execs
           FROM lineitem
           WHERE l_shipdate > TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate <= TIMESTAMP '1997-12-31 00:00:00'
           GROUP BY ALL),
t AS (SELECT g.*, sum(elapsed) OVER (PARTITION BY l_returnflag) AS tot FROM g),
f AS (SELECT t.*, p_name FROM t JOIN part ON p_partkey = l_partkey WHERE p_name NOT LIKE '%bolt%'),
k AS (SELECT f.*, row_number() OVER (PARTITION BY l_returnflag ORDER BY elapsed DESC, l_partkey) AS rn FROM f)
SELECT l_returnflag, l_partkey, p_name, execs, CAST(qty AS DOUBLE) AS qty, CAST(elapsed AS DOUBLE) AS elapsed,
       {R("CAST(elapsed AS DOUBLE) / NULLIF(CAST(execs AS DOUBLE), 0)", 2)} AS per_exec,
       {R("100.0::DOUBLE * CAST(elapsed AS DOUBLE) / CAST(tot AS DOUBLE)", 4)} AS pct_total, rn
FROM k WHERE rn <= 10"""

SQL["metric_trend"] = """
SELECT user_id % 3 AS instance_id, strftime(ts, '%Y-%m-%d') AS day,
       count(*) FILTER (WHERE event_type = 'error') AS n_error,
       count(*) FILTER (WHERE event_type = 'click') AS n_click,
       count(*) FILTER (WHERE event_type = 'signup') AS n_signup
FROM events GROUP BY 1, 2"""

SQL["counter_trend"] = "WITH " + COUNTERS + f"""
SELECT instance_id, stat, strftime(d, '%Y-%m-%d') AS day, value,
       {R("CAST(value - COALESCE(lag(value) OVER (PARTITION BY instance_id, stat ORDER BY snap_id), value) AS DOUBLE) / 86400.0", 6)} AS rate
FROM counters"""

SQL["sequence_gap"] = """
SELECT conv_id, CAST(max(turn) FILTER (WHERE role = 'assistant') AS DOUBLE) AS applied, max(turn) AS current,
       CAST(max(turn) - max(turn) FILTER (WHERE role = 'assistant') AS DOUBLE) AS gap,
       COALESCE(max(turn) - max(turn) FILTER (WHERE role = 'assistant') > 0, false) AS is_abnormal
FROM conversations GROUP BY conv_id"""

SQL["group_total_sets"] = """
SELECT CASE WHEN grouping(o_orderstatus) = 1 THEN 'total' ELSE o_orderstatus END AS o_orderstatus,
       CASE WHEN grouping(o_orderpriority) = 1 THEN 'all' ELSE o_orderpriority END AS o_orderpriority,
       count(*) AS n_orders, CAST(sum(CAST(o_totalprice AS DECIMAL(18,2))) AS DOUBLE) AS total_price
FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), ())"""

SQL["rollup_total"] = """
SELECT c_nationkey, CASE WHEN grouping(c_mktsegment) = 1 THEN 'SUM' ELSE c_mktsegment END AS c_mktsegment,
       count(*) AS n_customers, CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS total_bal
FROM customer GROUP BY c_nationkey, ROLLUP (c_mktsegment)"""

SQL["ordered_concat"] = """
SELECT r_name, string_agg(n_name, ',' ORDER BY n_name) AS nations
FROM nation JOIN region ON n_regionkey = r_regionkey GROUP BY r_name"""

SQL["ordered_concat_distinct"] = """
SELECT c_nationkey, string_agg(DISTINCT c_mktsegment, ',' ORDER BY c_mktsegment) AS segments
FROM customer GROUP BY c_nationkey"""

SQL["tagged_union"] = """
SELECT 'customer' AS tag, c_custkey AS obj_key, c_name AS obj_name, c_acctbal AS balance FROM customer WHERE c_acctbal < 0
UNION ALL
SELECT 'supplier', s_suppkey, s_name, s_acctbal FROM supplier WHERE s_acctbal < 0"""

SQL["large_segments"] = """
WITH g AS (SELECT l_partkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS total_size FROM lineitem GROUP BY 1
           HAVING sum(CAST(l_extendedprice AS DECIMAL(18,2))) > 2000000),
k AS (SELECT *, row_number() OVER (ORDER BY total_size DESC, l_partkey) AS rn FROM g)
SELECT l_partkey, p_name, CAST(total_size AS DOUBLE) AS total_size, rn, total_size > 2700000 AS is_abnormal
FROM k JOIN part ON p_partkey = l_partkey WHERE rn <= 10"""

SQL["bloat_estimate"] = f"""
WITH t AS (SELECT source, lang, count(*) AS n_rows, count(DISTINCT floor(doc_id / 20)) AS actual_pages,
                  CAST(sum(n_chars) AS DOUBLE) / count(*) AS avg_width
           FROM documents GROUP BY ALL),
e AS (SELECT *, CAST(ceil(CAST(n_rows AS DOUBLE) / greatest(floor(8192.0::DOUBLE / (24.0::DOUBLE + avg_width)), 1)) + 1 AS BIGINT) AS expected_pages
      FROM t),
b AS (SELECT *, {R("100.0::DOUBLE * CAST(actual_pages - expected_pages AS DOUBLE) / CAST(actual_pages AS DOUBLE)", 2)} AS bloat_pct FROM e)
SELECT source, lang, n_rows, actual_pages, expected_pages, bloat_pct, bloat_pct > 40 AS is_abnormal
FROM b WHERE bloat_pct > 10"""

SQL["fragmentation_class"] = f"""
WITH g AS (SELECT l_partkey, {R("1000.0::DOUBLE * (CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*))", 2)} AS frag_pct,
                  CAST(sum(CAST(l_quantity AS DECIMAL(18,2))) AS BIGINT) AS pages
           FROM lineitem GROUP BY 1)
SELECT l_partkey, frag_pct, pages,
       CASE WHEN frag_pct > 55 AND pages > 600 THEN 'REBUILD' WHEN frag_pct > 45 AND pages > 600 THEN 'REORGANIZE'
            ELSE 'OK' END AS action,
       (frag_pct > 45 AND pages > 600) AS is_abnormal
FROM g"""

SQL["capacity_autoextend"] = f"""
WITH f AS (SELECT c_nationkey AS nationkey,
                  sum(CAST(greatest(c_acctbal, 0) AS DECIMAL(18,2))) AS total_bytes,
                  sum(CASE WHEN c_mktsegment = 'BUILDING' THEN CAST(greatest(c_acctbal, 0) AS DECIMAL(18,2)) * 2
                           ELSE CAST(greatest(c_acctbal, 0) AS DECIMAL(18,2)) END) AS max_bytes,
                  count(*) AS n_files
           FROM customer GROUP BY 1),
fr AS (SELECT s_nationkey AS nationkey, sum(CAST(greatest(s_acctbal, 0) AS DECIMAL(18,2))) AS free_bytes
       FROM supplier GROUP BY 1),
j AS (SELECT f.*, COALESCE(fr.free_bytes, 0) AS free_bytes FROM f LEFT JOIN fr USING (nationkey))
SELECT nationkey, n_files, CAST(total_bytes AS DOUBLE) AS total_bytes, CAST(max_bytes AS DOUBLE) AS max_bytes,
       CAST(free_bytes AS DOUBLE) AS free_bytes, CAST(total_bytes - free_bytes AS DOUBLE) AS used_bytes,
       {R("100.0::DOUBLE * (CAST(total_bytes - free_bytes AS DOUBLE) / NULLIF(CAST(total_bytes AS DOUBLE), 0))", 2)} AS used_pct,
       {R("100.0::DOUBLE * (CAST(total_bytes - free_bytes AS DOUBLE) / NULLIF(CAST(max_bytes AS DOUBLE), 0))", 2)} AS used_of_max_pct,
       COALESCE({R("100.0::DOUBLE * (CAST(total_bytes - free_bytes AS DOUBLE) / NULLIF(CAST(max_bytes AS DOUBLE), 0))", 2)} >= 90, false) AS is_abnormal
FROM j"""

SQL["latency_per_op"] = f"""
WITH g AS (SELECT user_id, count(*) FILTER (WHERE event_type = 'error') AS n_ops,
                  sum(CAST(value AS DECIMAL(18,2))) FILTER (WHERE event_type = 'error') AS stall
           FROM events GROUP BY 1)
SELECT user_id, n_ops, CAST(stall AS DOUBLE) AS stall,
       CASE WHEN COALESCE(n_ops, 0) = 0 THEN 0.0::DOUBLE
            ELSE {R("CAST(stall AS DOUBLE) / NULLIF(CAST(n_ops AS DOUBLE), 0)", 2)} END AS avg_latency,
       COALESCE(CASE WHEN COALESCE(n_ops, 0) = 0 THEN 0.0::DOUBLE
            ELSE {R("CAST(stall AS DOUBLE) / NULLIF(CAST(n_ops AS DOUBLE), 0)", 2)} END > 50, false) AS is_abnormal
FROM g"""

SQL["impact_score"] = f"""
WITH g AS (SELECT l_partkey, count(*) AS n_lines,
                  CAST(sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_price,
                  CAST(sum(CAST(l_discount AS DECIMAL(18,2))) AS DOUBLE) / count(*) AS avg_disc
           FROM lineitem GROUP BY 1),
s AS (SELECT l_partkey, n_lines, {R("avg_price * avg_disc * CAST(n_lines AS DOUBLE)", 2)} AS impact FROM g),
k AS (SELECT *, row_number() OVER (ORDER BY impact DESC, l_partkey) AS rn FROM s)
SELECT l_partkey, n_lines, impact, rn, impact > 60000 AS is_abnormal FROM k WHERE rn <= 20"""

SQL["log_severity"] = f"""
SELECT DISTINCT lang, {DOC_CASE} AS severity, line FROM {LINES} WHERE {DOC_CASE} IS NOT NULL"""

SQL["log_fingerprint"] = f"""
WITH m AS (SELECT trim(regexp_replace(line, '^[^A-Za-z]+', '')) AS message FROM {LINES}),
g AS (SELECT message, count(*) AS n_lines FROM m WHERE message <> '' GROUP BY 1),
k AS (SELECT *, row_number() OVER (ORDER BY n_lines DESC, message) AS rn FROM g)
SELECT message, n_lines, rn FROM k WHERE rn <= 10"""

SQL["log_totals"] = f"""
SELECT lang, count(*) AS n_lines,
       count(*) FILTER (WHERE regexp_matches(line, '(?i)licen[cs]e')) AS n_license,
       count(*) FILTER (WHERE regexp_matches(line, '\\+1 \\(\\d{{3}}\\) \\d{{3}}-\\d{{4}}')) AS n_phone,
       count(*) FILTER (WHERE regexp_matches(line, '[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\\.[A-Za-z]+')) AS n_email,
       count(*) FILTER (WHERE regexp_matches(line, '[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}\\.[0-9]{{1,3}}')) AS n_ip,
       count(*) FILTER (WHERE regexp_matches(line, '(?i)(password|passwd|secret|api[_-]?key|token)')) AS n_secret
FROM {LINES} GROUP BY lang"""

SQL["status_decode"] = """
SELECT o_orderkey, o_orderstatus,
       CASE o_orderstatus WHEN 'O' THEN 'OPEN' WHEN 'F' THEN 'FINISHED' WHEN 'P' THEN 'PARTIAL' END AS status_label,
       COALESCE(o_orderstatus = 'P', false) AS is_abnormal
FROM orders"""

SQL["partition_headroom"] = """
WITH p AS (SELECT o_orderpriority, strftime(o_orderdate, '%Y-%m') AS partition_name, count(*) AS n_rows,
                  min(o_orderdate) AS d FROM orders GROUP BY 1, 2),
k AS (SELECT *, CAST(year(d) * 100 + month(d) AS BIGINT) AS position,
             strftime(date_trunc('month', d) + INTERVAL 1 MONTH, '%Y-%m-%d') AS high_value,
             row_number() OVER (PARTITION BY o_orderpriority ORDER BY year(d) * 100 + month(d) DESC) AS rk
      FROM p)
SELECT o_orderpriority, position, partition_name, high_value, n_rows FROM k WHERE rk = 2"""

SQL["name_ioc"] = """
SELECT p_partkey, p_name, label AS pattern
FROM part JOIN (VALUES ('hot', '%hot%'), ('red_bolt', 'red bolt%'), ('gizmo', '%gizmo')) AS ioc(label, pat)
  ON p_name LIKE ioc.pat"""

SQL["file_summary"] = """
WITH r AS (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY n_chars DESC, doc_id) AS rk FROM documents)
SELECT d.source, count(*) AS n_files, CAST(sum(n_chars) AS BIGINT) AS total_size, min(r.doc_id) AS largest_id
FROM documents d JOIN r ON r.source = d.source AND r.rk = 1 GROUP BY d.source"""

SQL["role_matrix"] = """
SELECT doc_id, CASE WHEN quality <> 0 THEN 'YES' ELSE 'no' END AS is_quality,
       CASE WHEN toxic <> 0 THEN 'YES' ELSE 'no' END AS is_toxic,
       COALESCE(toxic = 1 AND quality = 1, false) AS is_abnormal
FROM labels"""

SQL["host_port_split"] = """
WITH a AS (SELECT page_id, url, regexp_extract(url, '^[A-Za-z]+://([^/?#]*)', 1) AS authority FROM pages)
SELECT page_id, split_part(authority, ':', 1) AS host,
       CAST(CASE WHEN strpos(authority, ':') > 0 THEN TRY_CAST(split_part(authority, ':', -1) AS INTEGER) END AS DOUBLE) AS port,
       regexp_extract(url, '^[A-Za-z]+://[^/?#]*([^?#]*)', 1) AS path, contains(url, '?') AS has_query
FROM a"""

SQL["os_section_parse"] = r"""
WITH s AS (SELECT conv_id, turn, string_split_regex('## ' || role || chr(10) || text, '\r?\n') AS parts FROM conversations),
l AS (SELECT conv_id, turn, CAST(generate_subscripts(parts, 1) AS BIGINT) AS line_no, unnest(parts) AS line FROM s),
m AS (SELECT *, NULLIF(regexp_extract(line, '^#{2,}\s*(\S.*?)\s*#*$', 1), '') AS head,
             regexp_extract(line, '^\*\*\s*([^:]+):', 1) <> '' AS host FROM l),
f AS (SELECT *, last_value(head IGNORE NULLS) OVER (PARTITION BY conv_id, turn ORDER BY line_no) AS section FROM m)
SELECT conv_id, turn, section, line_no, line FROM f
WHERE head IS NULL AND NOT host AND trim(line) <> '' AND section IS NOT NULL"""

SQL["split_lines"] = """
WITH s AS (SELECT conv_id, turn, role, string_split_regex(text, '\\r?\\n') AS parts FROM conversations)
SELECT conv_id, turn, role AS section, CAST(generate_subscripts(parts, 1) AS BIGINT) AS line_no, unnest(parts) AS line
FROM s"""

SQL["os_usage"] = f"""
WITH g AS (SELECT c_nationkey, sum(CAST(greatest(c_acctbal, 0) AS DECIMAL(18,2))) AS pos_bal,
                  sum(CAST(abs(c_acctbal) AS DECIMAL(18,2))) AS abs_bal FROM customer GROUP BY 1)
SELECT c_nationkey, CAST(pos_bal AS DOUBLE) AS pos_bal, CAST(abs_bal AS DOUBLE) AS abs_bal,
       {R("100.0::DOUBLE * (CAST(pos_bal AS DOUBLE) / NULLIF(CAST(abs_bal AS DOUBLE), 0))", 2)} AS used_pct
FROM g"""

SQL["html_table_extract"] = """
SELECT s_suppkey, 'supplier' AS table_id, CAST(r AS BIGINT) AS row_no, CAST(c AS BIGINT) AS col_no, cell, is_red
FROM (SELECT s_suppkey, 0 AS r, 1 AS c, 'name' AS cell, false AS is_red FROM supplier
      UNION ALL SELECT s_suppkey, 0, 2, 'balance', false FROM supplier
      UNION ALL SELECT s_suppkey, 1, 1, s_name, false FROM supplier
      UNION ALL SELECT s_suppkey, 1, 2, CAST(CAST(s_acctbal AS DECIMAL(18,2)) AS VARCHAR), s_acctbal < 0 FROM supplier
      UNION ALL SELECT s_suppkey, 2, 1, 'nation', false FROM supplier
      UNION ALL SELECT s_suppkey, 2, 2, CAST(s_nationkey AS VARCHAR), false FROM supplier)"""

SQL["html_list_extract"] = """
WITH x AS (SELECT page_id,
                  regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 1) AS h,
                  regexp_extract_all(html, '<li><a href="([^"]*)">([^<]*)</a></li>', 2) AS t
           FROM pages)
SELECT page_id, CAST(generate_subscripts(h, 1) AS BIGINT) AS item_no, unnest(h) AS href, unnest(t) AS text FROM x"""

HOUR_ROWS = f"""
SELECT user_id % 3 AS instance_id, strftime(ts, '%Y-%m-%d') AS day, count(*) AS total
FROM events GROUP BY 1, 2"""

SQL["health_summary"] = f"""
WITH f AS (
  SELECT 'supplier_balance' AS check_id, COALESCE(s_acctbal < 0, false) AS is_abnormal FROM supplier
  UNION ALL
  SELECT 'part_size_pct', COALESCE(CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size * 2 END >= 90, false) FROM part
  UNION ALL
  SELECT 'event_hour_matrix', total > 120 FROM ({HOUR_ROWS})
  UNION ALL
  SELECT 'conversation_gap', COALESCE(max(turn) - max(turn) FILTER (WHERE role = 'assistant') > 0, false)
  FROM conversations GROUP BY conv_id),
pr(check_id, priority, advice) AS (VALUES
  ('supplier_balance', 'high', 'investigate negative supplier balances'),
  ('part_size_pct', 'low', 'review part sizes near the limit'),
  ('event_hour_matrix', 'medium', 'spread the busiest hours')),
g AS (SELECT check_id, count(*) FILTER (WHERE NOT is_abnormal) AS n_normal,
             count(*) FILTER (WHERE is_abnormal) AS n_abnormal FROM f GROUP BY 1)
SELECT g.check_id, n_normal, n_abnormal, COALESCE(pr.priority, 'medium') AS priority,
       CASE WHEN n_abnormal > 0 THEN pr.advice END AS advice,
       CASE WHEN n_abnormal > 0 THEN 'abnormal' ELSE 'normal' END AS status
FROM g LEFT JOIN pr USING (check_id)"""

SQL["newest_collection"] = """
WITH ev AS (SELECT event_type AS instance_id, CAST(ts AS DATE) AS d, event_id, CAST(value AS DECIMAL(18,2)) AS v
            FROM events WHERE event_type <> 'view' OR day(ts) <= 15),
m AS (SELECT instance_id, max(d) FILTER (WHERE d <= DATE '2024-01-31') AS d, count(*) AS n_held FROM ev GROUP BY 1)
SELECT instance_id, strftime(d, '%Y-%m-%d') AS day, count(*) AS n_events, CAST(sum(v) AS DOUBLE) AS total, min(event_id) AS first_event, n_held
FROM ev JOIN m USING (instance_id, d) GROUP BY instance_id, d, n_held"""

SQL["apply_top"] = """
SELECT c_custkey, c_name, CAST(o_orderkey AS DOUBLE) AS o_orderkey, o_totalprice, o_orderstatus
FROM customer LEFT JOIN LATERAL (SELECT o_orderkey, o_totalprice, o_orderstatus FROM orders WHERE o_custkey = c_custkey
                                 ORDER BY o_totalprice DESC NULLS LAST, o_orderkey LIMIT 2) ON true"""

SQL["apply_rows"] = """
SELECT o_orderkey, o_orderstatus, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_partkey, l_quantity
FROM orders, LATERAL (SELECT l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey = o_orderkey)
WHERE o_orderpriority = '1-URGENT'"""

SQL["section_table"] = """
SELECT s_suppkey, 'n' || s_nationkey AS host, CAST(4 AS BIGINT) AS line_no,
       CASE WHEN s_suppkey % 4 = 0 THEN '/dev/vg ' || s_suppkey ELSE s_name END AS filesystem, 'xfs' AS fstype,
       floor(abs(s_acctbal)) * 1048576 AS size_bytes,
       CASE WHEN s_acctbal < 0 THEN NULL ELSE (s_nationkey + 0.5::DOUBLE) * 1024 END AS used_bytes, 0.0::DOUBLE AS avail_bytes,
       CAST(s_suppkey % 101 AS DOUBLE) AS used_pct, '/data ' || s_suppkey AS mount
FROM supplier"""

SQL["section_pairs"] = """
SELECT s_suppkey, CAST(11 AS BIGINT) AS line_no, 'MemTotal' AS name, floor(abs(s_acctbal)) AS value, 'kB' AS unit FROM supplier
UNION ALL SELECT s_suppkey, 12, 'HugePages_Total', CAST(s_nationkey AS DOUBLE), NULL FROM supplier
UNION ALL SELECT s_suppkey, 13, 'Cached', NULL, NULL FROM supplier
UNION ALL SELECT s_suppkey, 8, 'Mem:total', floor(abs(s_acctbal)), 'kB' FROM supplier
UNION ALL SELECT s_suppkey, 8, 'Mem:used', CAST(s_nationkey AS DOUBLE), 'kB' FROM supplier
UNION ALL SELECT s_suppkey, 8, 'Mem:free', CAST(s_suppkey % 101 AS DOUBLE), 'kB' FROM supplier
UNION ALL SELECT s_suppkey, 8, 'Mem:shared', NULL, 'kB' FROM supplier"""

SQL["layout_bloat"] = f"""
WITH t AS (SELECT source, lang, count(*) AS n_rows, count(DISTINCT floor(doc_id / 20)) AS actual_pages,
                  count(*) FILTER (WHERE lang = 'en' AND (n_chars <= 400 OR n_chars IS NULL OR text IS NULL)) AS n_null,
                  greatest(8, CAST(floor(avg(n_chars) / 40) AS INTEGER)) AS wide
           FROM documents GROUP BY ALL),
h AS (SELECT *, CASE WHEN n_null > 0 THEN (2 + wide) / 8.0::DOUBLE ELSE 0::DOUBLE END AS nullhdr FROM t),
p AS (SELECT *, CAST(ceil(n_rows / (105::DOUBLE / (4 + nullhdr + 8 - CASE WHEN nullhdr % 8 = 0 THEN 8 ELSE nullhdr % 8 END))) + 1 AS BIGINT) AS expected_pages
      FROM h)
SELECT source, lang, n_rows, actual_pages, expected_pages, CAST(128 * greatest(actual_pages - expected_pages, 0) AS BIGINT) AS bloat_bytes,
       {R("100.0::DOUBLE * (actual_pages - expected_pages) / actual_pages", 1)} AS bloat_pct,
       100.0::DOUBLE * (actual_pages - expected_pages) / actual_pages > 40 AS is_abnormal
FROM p WHERE actual_pages > 3 AND 100.0::DOUBLE * (actual_pages - expected_pages) / actual_pages > 10"""

SQL["type_limit_join"] = SQL["type_limit_usage"]

SQL["guaranteed_rows"] = """
SELECT n_nationkey, coalesce(c_name, 'N/A') AS c_name, coalesce(c_acctbal, 0) AS balance, c_custkey IS NOT NULL AS found
FROM nation LEFT JOIN customer ON c_nationkey = n_nationkey AND c_mktsegment = 'MACHINERY' AND c_acctbal < -900"""

SQL["log_records"] = r"""
WITH l AS (SELECT doc_id, unnest(string_split_regex(text, '\r?\n')) AS line, generate_subscripts(string_split_regex(text, '\r?\n'), 1) AS line_no FROM documents),
n AS (SELECT *, count(*) FILTER (WHERE regexp_matches(line, '^[A-Z]')) OVER (PARTITION BY doc_id ORDER BY line_no) AS record_no FROM l)
SELECT doc_id, record_no, CAST(CASE WHEN record_no > 0 THEN min(line_no) END AS DOUBLE) AS record_ts, count(*) AS n_lines,
       md5(string_agg(line, chr(10) ORDER BY line_no)) AS text_md5
FROM n GROUP BY doc_id, record_no"""

SQL["log_recent"] = r"""
WITH e AS (SELECT user_id, ts, event_type || ' ' || CAST(value AS DECIMAL(18,2)) AS line FROM events
           WHERE ts > TIMESTAMP '2024-01-13' AND ts <= TIMESTAMP '2024-01-20'),
c AS (SELECT *, CASE WHEN regexp_matches(line, '^error [1-9][0-9]') THEN 'error'
                     WHEN regexp_matches(line, '^purchase [0-9]{2,}\.') THEN 'large' END AS severity FROM e)
SELECT DISTINCT user_id, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') AS ts, severity, line FROM c WHERE severity IS NOT NULL"""

SQL["abnormal_list"] = f"""
WITH f AS (
  SELECT 'supplier_balance' AS check_id, CAST(s_suppkey AS VARCHAR) AS k, CAST(s_acctbal AS DOUBLE) AS m, 0.0::DOUBLE AS t, COALESCE(s_acctbal < 0, false) AS red FROM supplier
  UNION ALL
  SELECT 'part_size_pct', CAST(p_partkey AS VARCHAR), CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE CAST(p_size * 2 AS DOUBLE) END, 90.0,
         COALESCE(CASE WHEN p_partkey % 7 = 0 THEN NULL ELSE p_size * 2 END >= 90, false) FROM part
  UNION ALL
  SELECT 'event_hour_matrix', instance_id || '/' || day, total, 120.0, total > 120 FROM ({HOUR_ROWS})
  UNION ALL
  SELECT 'conversation_gap', CAST(conv_id AS VARCHAR), max(turn) - max(turn) FILTER (WHERE role = 'assistant'), 0.0,
         COALESCE(max(turn) - max(turn) FILTER (WHERE role = 'assistant') > 0, false)
  FROM conversations GROUP BY conv_id),
r AS (SELECT *, row_number() OVER (PARTITION BY check_id ORDER BY abs(m - t) DESC NULLS LAST, k) AS rk FROM f WHERE red),
w AS (SELECT check_id, string_agg(k, ', ' ORDER BY rk) AS worst, count(*) AS n_worst FROM r WHERE rk <= 3 GROUP BY 1),
pr(check_id, priority, advice) AS (VALUES
  ('supplier_balance', 'high', 'investigate negative supplier balances'),
  ('part_size_pct', 'low', 'review part sizes near the limit'),
  ('event_hour_matrix', 'medium', 'spread the busiest hours')),
g AS (SELECT check_id, count(*) FILTER (WHERE NOT red) AS n_normal, count(*) FILTER (WHERE red) AS n_abnormal, NULL AS error FROM f GROUP BY 1
      UNION ALL SELECT 'region_' || lower(r_name), 0, 0, CASE WHEN r_regionkey = 0 THEN 'not readable' END
      FROM region WHERE r_regionkey = 0 OR length('region_' || r_name) > 10)
SELECT check_id, n_normal, n_abnormal, COALESCE(priority, 'medium') AS priority, CASE WHEN n_abnormal > 0 THEN advice END AS advice,
       CASE WHEN error IS NOT NULL THEN 'error' WHEN n_abnormal > 0 THEN 'abnormal' ELSE 'normal' END AS status, error,
       COALESCE(worst, '') AS worst, COALESCE(n_worst, 0) AS n_worst
FROM g LEFT JOIN pr USING (check_id) LEFT JOIN w USING (check_id)"""

SQL["statement_report"] = f"""
WITH g AS (SELECT l_returnflag, l_partkey, sum(CAST(l_extendedprice AS DECIMAL(18,2))) AS elapsed, count(*) AS execs,
                  sum(CAST(CAST(l_extendedprice AS DECIMAL(18,2)) * CAST(l_discount AS DECIMAL(4,2)) AS DECIMAL(18,4))) AS cpu,
                  sum(CAST(l_quantity AS DECIMAL(18,2))) AS qty
           FROM lineitem WHERE l_shipdate > TIMESTAMP '1996-01-01 00:00:00' AND l_shipdate <= TIMESTAMP '1997-12-31 00:00:00'
           GROUP BY ALL),
t AS (SELECT g.*, sum(elapsed) OVER (PARTITION BY l_returnflag) AS tot FROM g),
k AS (SELECT t.*, p_name, row_number() OVER (PARTITION BY l_returnflag ORDER BY elapsed DESC, l_partkey) AS rn
      FROM t JOIN part ON p_partkey = l_partkey WHERE p_name NOT LIKE '%bolt%' AND p_name NOT LIKE 'small%')
SELECT l_returnflag, l_partkey, p_name, execs, CAST(elapsed AS DOUBLE) AS elapsed,
       {R("CAST(elapsed AS DOUBLE) / CAST(execs AS DOUBLE)", 2)} AS per_exec,
       {R("100.0::DOUBLE * CAST(elapsed AS DOUBLE) / CAST(tot AS DOUBLE)", 2)} AS pct_total,
       {R("100.0::DOUBLE * (CAST(cpu AS DOUBLE) / CAST(elapsed AS DOUBLE))", 2)} AS pct_cpu,
       {R("100.0::DOUBLE * (CAST(qty AS DOUBLE) / CAST(elapsed AS DOUBLE))", 2)} AS pct_qty, rn
FROM k WHERE rn <= 5"""

SQL["partition_bound"] = """
WITH p AS (SELECT o_orderpriority, date_trunc('month', o_orderdate) AS m, count(*) AS n_rows FROM orders GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY o_orderpriority ORDER BY m DESC) AS rk FROM p)
SELECT o_orderpriority, CAST(year(m) * 100 + month(m) AS BIGINT) AS position, strftime(m, '%Y-%m') AS partition_name, n_rows,
       strftime(m + INTERVAL 1 MONTH, '%Y-%m-%d %H:%M:%S') AS upper_bound,
       date_diff('day', DATE '2001-07-20', CAST(m + INTERVAL 1 MONTH AS DATE)) AS days_left,
       date_diff('day', DATE '2001-07-20', CAST(m + INTERVAL 1 MONTH AS DATE)) <= 14 AS is_abnormal
FROM r WHERE rk = 2"""

SQL["pareto_all"] = f"""
WITH o AS (SELECT o_custkey, sum(CAST(o_totalprice AS DECIMAL(18,2))) AS revenue FROM orders GROUP BY 1),
w AS (SELECT *, sum(revenue) OVER () AS total, sum(revenue) OVER (ORDER BY revenue DESC, o_custkey ROWS UNBOUNDED PRECEDING) AS running,
             row_number() OVER (ORDER BY revenue DESC, o_custkey) AS rn FROM o)
SELECT o_custkey, CAST(revenue AS DOUBLE) AS revenue, {R("100.0::DOUBLE * CAST(revenue AS DOUBLE) / CAST(total AS DOUBLE)", 4)} AS pct,
       {R("100.0::DOUBLE * CAST(running AS DOUBLE) / CAST(total AS DOUBLE)", 4)} AS running_pct, rn FROM w"""

SQL["time_share_all"] = f"""
WITH g AS (SELECT event_type, sum(CAST(value AS DECIMAL(18,2))) AS v FROM events GROUP BY 1)
SELECT event_type, CAST(v AS DOUBLE) AS total_value,
       CASE WHEN event_type <> 'view' THEN {R("100.0::DOUBLE * CAST(v AS DOUBLE) / CAST((SELECT sum(v) FROM g WHERE event_type <> 'view') AS DOUBLE)", 3)} END AS pct
FROM g"""

SQL["nested_rollup"] = """
SELECT c_nationkey, c_mktsegment, CAST(c_acctbal < 0 AS VARCHAR) AS overdrawn,
       CAST(3 - grouping(c_mktsegment) - grouping(c_acctbal < 0) AS BIGINT) AS level, count(*) AS n_customers,
       CAST(sum(CAST(c_acctbal AS DECIMAL(18,2))) AS DOUBLE) AS balance, min(c_custkey) AS first_key
FROM customer
GROUP BY GROUPING SETS ((c_nationkey, c_mktsegment, c_acctbal < 0), (c_nationkey, c_mktsegment), (c_nationkey))"""

SQL["log_fingerprint_recent"] = """
WITH l AS (SELECT event_type, '[ERROR] ' || event_type || ' by user ' || (user_id % 7) AS message FROM events
           WHERE user_id % 10 = 0 OR (date_trunc('second', ts) >= TIMESTAMP '2024-01-13' AND date_trunc('second', ts) <= TIMESTAMP '2024-01-20')),
g AS (SELECT event_type, message, count(*) AS n_lines FROM l GROUP BY ALL),
k AS (SELECT *, row_number() OVER (PARTITION BY event_type ORDER BY n_lines DESC, message) AS rn FROM g)
SELECT * FROM k WHERE rn <= 4"""

SQL["sequence_gap_current"] = """
SELECT conv_id, max(turn) FILTER (WHERE role = 'assistant') AS applied, max(turn) FILTER (WHERE role <> 'system') AS current,
       max(turn) FILTER (WHERE role <> 'system') - max(turn) FILTER (WHERE role = 'assistant') AS gap,
       max(turn) FILTER (WHERE role <> 'system') - max(turn) FILTER (WHERE role = 'assistant') > 1 AS is_abnormal
FROM conversations GROUP BY conv_id HAVING count(*) FILTER (WHERE role = 'assistant') > 0"""

SQL["position_lag"] = """
WITH o AS (SELECT o_custkey, max(o_orderkey) AS sent, max(o_orderkey) FILTER (WHERE o_orderstatus = 'F') AS done FROM orders GROUP BY 1),
p AS (SELECT *, CAST(sent // 64 AS HUGEINT) * 4294967296 + (sent % 64) * 67108864 AS a, CAST(done // 64 AS HUGEINT) * 4294967296 + (done % 64) * 67108864 AS b FROM o)
SELECT o_custkey, upper(hex(sent // 64)) || '/' || upper(hex((sent % 64) * 67108864)) AS sent_lsn,
       upper(hex(done // 64)) || '/' || upper(hex((done % 64) * 67108864)) AS replay_lsn, CAST(a - b AS DOUBLE) AS lag_bytes,
       COALESCE(a - b > 10000000000, false) AS is_abnormal FROM p"""

SQL["html_span_extract"] = """
SELECT s_suppkey, 'name' AS span_id, s_name AS value FROM supplier
UNION ALL SELECT s_suppkey, 'nation', CAST(s_nationkey AS VARCHAR) FROM supplier
UNION ALL SELECT s_suppkey, 'empty', '' FROM supplier"""
