"""SQL for the registered queries, written for DuckDB and independently of the operators: pairing by
message walks a pointer chain, sync statistics enumerate all pairs."""

from __future__ import annotations

TIMING_EVENTS = """
te AS (
  SELECT event_type AS event, epoch_us(ts) * 1000 AS time_ns, event_id % 2 = 0 AS toggled,
         'Device_' || user_id AS device_id,
         CAST((user_id + CASE WHEN event_id % 10 = 0 THEN 1 ELSE 0 END) % 8 + 1 AS DOUBLE) AS position,
         CASE WHEN k % 3 <> 0 THEN 'MSG_' || (k % 3) END AS message_id, event_id AS ord
  FROM (SELECT *, CAST(json_extract_string(props, '$.k') AS INT) AS k FROM events))"""


def _plain(keys: str) -> str:
    return f"""{TIMING_EVENTS},
heads AS (
  SELECT * FROM (
    SELECT *, lag(toggled) OVER (PARTITION BY {keys} ORDER BY time_ns, ord) AS before FROM te)
  WHERE before IS NULL OR before <> toggled),
ex AS (
  SELECT *, end_ns - start_ns AS duration_ns FROM (
    SELECT device_id, event, toggled, message_id, time_ns AS start_ns, ord AS start_ord,
           lead(time_ns) OVER (PARTITION BY {keys} ORDER BY time_ns, ord) AS end_ns,
           lead(ord) OVER (PARTITION BY {keys} ORDER BY time_ns, ord) AS end_ord
    FROM heads)
  WHERE toggled AND end_ns IS NOT NULL)"""


PLAIN = _plain("device_id, event")
BASIC = _plain("event")

MATCHED = f"""{TIMING_EVENTS},
r AS (
  SELECT *, row_number() OVER (PARTITION BY device_id, event ORDER BY time_ns, ord) AS i FROM te),
nt AS (
  SELECT device_id, event, i, min(CASE WHEN toggled THEN i END) OVER (
           PARTITION BY device_id, event ORDER BY i ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING
         ) AS next_true
  FROM r),
cl AS (
  SELECT s.device_id, s.event, s.i, min(f.i) AS en
  FROM r s JOIN r f ON s.device_id = f.device_id AND s.event = f.event AND f.i > s.i
       AND s.toggled AND NOT f.toggled AND f.message_id IS NOT DISTINCT FROM s.message_id
  GROUP BY ALL),
walk AS (
  SELECT device_id, event, min(i) AS i FROM r WHERE toggled GROUP BY ALL
  UNION ALL
  SELECT w.device_id, w.event, nt.next_true
  FROM walk w JOIN cl ON w.device_id = cl.device_id AND w.event = cl.event AND w.i = cl.i
       JOIN nt ON nt.device_id = cl.device_id AND nt.event = cl.event AND nt.i = cl.en
  WHERE nt.next_true IS NOT NULL),
ex AS (
  SELECT s.device_id, s.event, s.time_ns AS start_ns, e.time_ns AS end_ns,
         e.time_ns - s.time_ns AS duration_ns, s.message_id, s.ord AS start_ord, e.ord AS end_ord
  FROM walk w JOIN cl USING (device_id, event, i) JOIN r s USING (device_id, event, i)
       JOIN r e ON e.device_id = w.device_id AND e.event = w.event AND e.i = cl.en)"""

STATS = """
st AS (
  SELECT device_id, event, count(*) AS count, avg(duration_ns) AS mean_ns,
         stddev_pop(duration_ns) AS std_ns, min(duration_ns) AS min_ns, max(duration_ns) AS max_ns
  FROM ex GROUP BY ALL)"""

SHIPMENTS = """
sh AS (
  SELECT l_orderkey, l_linestatus, epoch_us(l_shipdate) * 1000 AS time_ns, 'N' || s_nationkey AS device_id,
         CAST(s_nationkey % 5 AS DOUBLE) AS position,
         l_linenumber * 1000000000000000 + l_partkey
           + date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) * 1000000000 AS ord
  FROM lineitem JOIN supplier ON l_suppkey = s_suppkey)"""

STARTS = f"""{SHIPMENTS},
starts AS (
  SELECT message_id, device_id, time_ns AS start_ns FROM (
    SELECT 'SYNC_' || l_orderkey AS message_id, device_id, time_ns,
           row_number() OVER (PARTITION BY l_orderkey, device_id ORDER BY ord DESC, time_ns DESC) AS n
    FROM sh WHERE l_linestatus = 'O')
  WHERE n = 1),
prs AS (
  SELECT a.message_id, a.device_id AS device1, b.device_id AS device2,
         abs(a.start_ns - b.start_ns) AS time_diff_ns
  FROM starts a JOIN starts b ON a.message_id = b.message_id AND a.device_id < b.device_id),
ss AS (
  SELECT message_id, CAST((1 + sqrt(1 + 8 * count(*))) / 2 AS BIGINT) AS device_count,
         max(time_diff_ns) AS max_diff_ns, min(time_diff_ns) AS min_diff_ns,
         avg(time_diff_ns) AS mean_diff_ns, stddev_pop(time_diff_ns) AS std_diff_ns
  FROM prs GROUP BY ALL)"""

PROPAGATION = f"""{SHIPMENTS},
snd AS (
  SELECT 'MSG_' || o_orderkey AS message_id, 'N' || c_nationkey AS device_id,
         CAST(c_nationkey % 5 AS DOUBLE) AS position, epoch_us(o_orderdate) * 1000 AS time_ns,
         row_number() OVER (PARTITION BY o_orderkey ORDER BY o_orderdate) AS n
  FROM orders JOIN customer ON o_custkey = c_custkey),
rcv AS (
  SELECT *, 'MSG_' || l_orderkey AS message_id,
         row_number() OVER (PARTITION BY l_orderkey, device_id ORDER BY ord, time_ns) AS n FROM sh),
pr AS (
  SELECT s.message_id, s.device_id AS from_device, r.device_id AS to_device,
         s.position AS from_position, r.position AS to_position, abs(r.position - s.position) AS hops,
         r.time_ns - s.time_ns AS time_ns,
         CASE WHEN r.position <> s.position
              THEN (r.time_ns - s.time_ns) / abs(r.position - s.position) ELSE 0.0 END AS time_per_hop_ns
  FROM snd s JOIN rcv r ON s.message_id = r.message_id AND r.device_id <> s.device_id
  WHERE s.n = 1 AND r.n = 1)"""

DEVICES = f"""{TIMING_EVENTS},
modes AS (
  SELECT device_id, position FROM (
    SELECT device_id, position,
           row_number() OVER (PARTITION BY device_id ORDER BY count(*) DESC, position) AS n
    FROM te GROUP BY device_id, position)
  WHERE n = 1),
dv AS (
  SELECT device_id, position, first_ord, coalesce(rising, 0) AS rising_edges
  FROM modes JOIN (SELECT device_id, min(ord) AS first_ord FROM te GROUP BY ALL) USING (device_id)
  LEFT JOIN (
    SELECT device_id, count(*) AS rising FROM (
      SELECT DISTINCT event, time_ns, toggled, device_id, position, message_id FROM te WHERE toggled)
    GROUP BY ALL) USING (device_id)),
pl AS (
  SELECT *, row_number() OVER (ORDER BY position, first_ord) AS p,
         row_number() OVER (ORDER BY first_ord) AS a, count(*) OVER () AS n FROM dv)"""


def _edges(condition: str) -> str:
    return f"""SELECT DISTINCT least(x.device_id, y.device_id) AS src, greatest(x.device_id, y.device_id) AS dst
  FROM pl x JOIN pl y ON {condition}"""


DAISY = _edges("y.p = x.p + 1")
DAISY_APPEARANCE = _edges("y.a = x.a + 1")
STAR = _edges("x.a = 1 AND y.a > 1")

LINKS = "SELECT DISTINCT least(from_device, to_device) AS src, greatest(from_device, to_device) AS dst FROM pr WHERE from_device IS NOT NULL AND to_device IS NOT NULL"

LOG_LINES = f"""{TIMING_EVENTS},
ln AS (SELECT * FROM te WHERE NOT (ord % 29 = 6 OR ord % 31 = 7 OR ord % 37 = 8))"""

BOX = """
  SELECT {keys}, count(*) AS count, min(d) AS min_ns, round(any_value(q[1]), 0) AS q1_ns,
         round(any_value(q[2]), 0) AS median_ns, round(any_value(q[3]), 0) AS q3_ns, max(d) AS max_ns,
         min(CASE WHEN d BETWEEN lo AND hi THEN d END) AS low_whisker_ns,
         max(CASE WHEN d BETWEEN lo AND hi THEN d END) AS high_whisker_ns,
         count(CASE WHEN d NOT BETWEEN lo AND hi THEN 1 END) AS outliers
  FROM (
    SELECT {keys}, duration_ns AS d, q, q[1] - (q[3] - q[1]) * 1.5::DOUBLE AS lo,
           q[3] + (q[3] - q[1]) * 1.5::DOUBLE AS hi
    FROM ex JOIN (
      SELECT {keys}, quantile_cont(CAST(duration_ns AS DOUBLE), [0.25, 0.5, 0.75]) AS q FROM ex GROUP BY ALL
    ) USING ({keys}))
  GROUP BY {keys}"""

BASIC_STATS = """SELECT event, count(*) AS count, round(avg(duration_ns), -2) AS mean_ns,
  round(stddev_pop(duration_ns), -3) AS std_ns, min(duration_ns) AS min_ns, max(duration_ns) AS max_ns
  FROM ex GROUP BY ALL"""

# Duration buckets: whole values below 256, then 128 for each power of two; a bucket stands for its middle.
BUCKETS = """
bk AS (
  SELECT event, device_id, start_ns // 86400000000000 AS day, duration_ns, shift * 128 + (duration_ns >> shift) AS bucket,
         (duration_ns >> shift)::DOUBLE * power(2::DOUBLE, shift) + (power(2::DOUBLE, shift) - 1) / 2 AS middle
  FROM (SELECT *, greatest(length(bin(duration_ns)) - 8, 0) AS shift FROM ex))"""

ORACLES: dict[str, str] = {
    "q_executions": f"""WITH {PLAIN}
SELECT device_id, event, start_ns, end_ns, duration_ns, message_id, start_ord, end_ord FROM ex""",
    "q_executions_msg": f"""WITH RECURSIVE {MATCHED} SELECT * FROM ex""",
    "q_executions_basic": f"""WITH {BASIC}
SELECT event, start_ns, end_ns, duration_ns, start_ord, end_ord FROM ex""",
    "q_exec_stats": f"""WITH RECURSIVE {MATCHED}, {STATS}
SELECT device_id, event, count, round(mean_ns, -2) AS mean_ns, round(std_ns, -6) AS std_ns, min_ns, max_ns
FROM st""",
    "q_exec_stats_basic": f"WITH {BASIC} {BASIC_STATS}",
    "q_pooled_stats": f"""WITH RECURSIVE {MATCHED}
SELECT event, round(avg(duration_ns), -4) AS mean_ns, round(stddev_pop(duration_ns), -6) AS std_ns,
       count(*) AS count FROM ex GROUP BY ALL""",
    "q_kpis": f"""WITH RECURSIVE {MATCHED}, {STATS}
SELECT CAST(sum(count) AS BIGINT) AS total_executions, round(avg(mean_ns), -4) AS mean_of_means_ns FROM st""",
    "q_fastest_slowest": f"""WITH RECURSIVE {MATCHED}, {STATS},
em AS (SELECT event, avg(mean_ns) AS m FROM st GROUP BY ALL)
SELECT (SELECT event FROM em ORDER BY m, event LIMIT 1) AS fastest_event,
       (SELECT round(min(m), -4) FROM em) AS fastest_ns,
       (SELECT event FROM em ORDER BY m DESC, event LIMIT 1) AS slowest_event,
       (SELECT round(max(m), -4) FROM em) AS slowest_ns""",
    "q_event_distribution": f"""WITH RECURSIVE {MATCHED}
SELECT event, count(*) AS count, CAST(count(*) AS DOUBLE) / (SELECT count(*) FROM ex) AS share
FROM ex GROUP BY event""",
    "q_trends": f"""WITH RECURSIVE {MATCHED}
SELECT event, row_number() OVER (PARTITION BY event ORDER BY start_ns, device_id, end_ns) - 1 AS instance,
       device_id, start_ns, duration_ns FROM ex""",
    "q_histogram": f"""WITH RECURSIVE {MATCHED},
b AS (SELECT min(duration_ns) AS lo, (max(duration_ns) - min(duration_ns)) / 30.0::DOUBLE AS w FROM ex)
SELECT event, bin, round(lo + bin * w, 0) AS bin_start_ns, count(*) AS count
FROM (SELECT event, lo, w, CAST(least(floor((duration_ns - lo) / w), 29) AS BIGINT) AS bin FROM ex, b)
GROUP BY ALL""",
    "q_box_summary": f"WITH RECURSIVE {MATCHED} {BOX.format(keys='event, device_id')}",
    "q_box_summary_basic": f"WITH {BASIC} {BOX.format(keys='event')}",
    "q_device_comparison": f"""WITH RECURSIVE {MATCHED}, {STATS}
SELECT event, device_id, round(mean_ns / 1000.0::DOUBLE, 1) AS mean_us FROM st""",
    "q_device_matrix": f"""WITH RECURSIVE {MATCHED}, {STATS}
SELECT device_id,
  round(max(CASE WHEN event = 'click' THEN mean_ns END) / 1000.0::DOUBLE, 1) AS click,
  round(max(CASE WHEN event = 'error' THEN mean_ns END) / 1000.0::DOUBLE, 1) AS error,
  round(max(CASE WHEN event = 'purchase' THEN mean_ns END) / 1000.0::DOUBLE, 1) AS purchase,
  round(max(CASE WHEN event = 'signup' THEN mean_ns END) / 1000.0::DOUBLE, 1) AS signup,
  round(max(CASE WHEN event = 'view' THEN mean_ns END) / 1000.0::DOUBLE, 1) AS view
FROM st GROUP BY device_id""",
    "q_device_summary": f"""WITH RECURSIVE {MATCHED}, {STATS}
SELECT device_id, CAST(sum(count) AS BIGINT) AS total_executions, round(avg(mean_ns), -4) AS mean_of_means_ns
FROM st GROUP BY device_id""",
    "q_device_summary_chosen": f"""WITH RECURSIVE {MATCHED}, {STATS}
SELECT device_id, CAST(sum(count) AS BIGINT) AS total_executions, round(avg(mean_ns), -4) AS mean_of_means_ns
FROM st WHERE device_id IN (SELECT device_id FROM te WHERE event = 'error') GROUP BY device_id""",
    "q_sync_starts": f"WITH {STARTS} SELECT * FROM starts",
    "q_ranked_starts": f"""WITH {STARTS}
SELECT message_id, device_id, start_ns, row_number() OVER w AS rank,
       count(*) OVER (PARTITION BY message_id) AS device_count, start_ns - first_value(start_ns) OVER w AS offset_ns,
       start_ns - lag(start_ns) OVER w AS gap_ns
FROM starts WINDOW w AS (PARTITION BY message_id ORDER BY start_ns, device_id)""",
    "q_sync_pairs": f"WITH {STARTS} SELECT * FROM prs",
    "q_sync_stats": f"""WITH {STARTS}
SELECT message_id, device_count, max_diff_ns, min_diff_ns, round(mean_diff_ns, -4) AS mean_diff_ns,
       round(std_diff_ns, -6) AS std_diff_ns FROM ss""",
    "q_sync_summary": f"""WITH {STARTS}
SELECT count(*) AS sync_pulses,
       (SELECT count(*) FROM (SELECT device1 FROM prs UNION SELECT device2 FROM prs)) AS devices,
       max(max_diff_ns) AS max_diff_ns, round(avg(mean_diff_ns), -6) AS mean_diff_ns FROM ss""",
    "q_propagation": f"WITH {PROPAGATION} SELECT * FROM pr",
    "q_message_stats": f"""WITH {PROPAGATION}
SELECT message_id, from_device AS source_device, count(*) AS destination_count FROM pr GROUP BY ALL""",
    "q_pair_means": f"""WITH {PROPAGATION}
SELECT from_device, to_device, round(avg(time_ns), -5) AS mean_time_ns, avg(hops) AS mean_hops
FROM pr GROUP BY ALL""",
    "q_hop_cost": f"""WITH {PROPAGATION}
SELECT count(*) AS n_propagations, count(DISTINCT message_id) AS n_messages, sum(hops) AS total_hops,
       round(CAST(sum(time_ns) AS DOUBLE) / sum(hops), -3) AS time_per_hop_ns FROM pr""",
    "q_hop_trend": f"""WITH {PROPAGATION}
SELECT from_device, round(regr_slope(time_ns, hops), -6) AS slope_ns,
       round(regr_intercept(time_ns, hops), -6) AS intercept_ns, round(regr_r2(time_ns, hops), 9) AS r2,
       CAST(regr_count(time_ns, hops) AS BIGINT) AS n FROM pr GROUP BY ALL""",
    "q_device_table": f"WITH {DEVICES} SELECT * FROM dv",
    "q_device_count": f"WITH {TIMING_EVENTS} SELECT count(DISTINCT device_id) AS devices FROM te",
    "q_topo_daisy": f"WITH {DEVICES} {DAISY}",
    "q_topo_daisy_appearance": f"WITH {DEVICES} {DAISY_APPEARANCE}",
    "q_topo_star": f"WITH {DEVICES} {STAR}",
    "q_topo_ring": f"WITH {DEVICES} {_edges('y.a = x.a % x.n + 1')}",
    "q_topo_mesh": f"WITH {DEVICES} {_edges('x.a < y.a')}",
    "q_topo_custom": f"WITH {PROPAGATION} {LINKS}",
    "q_topo_edit": f"""WITH {DEVICES},
chain AS (SELECT x.device_id AS source, y.device_id AS target, x.p AS n FROM pl x JOIN pl y ON y.p = x.p + 1),
star AS (SELECT source, target, row_number() OVER (ORDER BY a) AS n
         FROM (SELECT x.device_id AS source, y.device_id AS target, y.a FROM pl x JOIN pl y ON x.a = 1 AND y.a > 1)
         WHERE (source, target) NOT IN (SELECT (source, target) FROM chain)),
edited AS (SELECT * FROM chain UNION ALL SELECT source, target, n + (SELECT max(n) FROM chain) FROM star)
SELECT source, target, n AS edge_ord FROM edited WHERE n < (SELECT max(n) FROM edited)""",
    "q_node_degree": f"""WITH {DEVICES},
e AS ({DAISY} UNION {STAR}),
dg AS (
  SELECT device_id, (SELECT count(*) FROM e WHERE src = device_id) + (SELECT count(*) FROM e WHERE dst = device_id)
         AS degree
  FROM dv)
SELECT device_id, degree, CASE WHEN degree = 0 THEN 'isolated' WHEN degree <= 2 THEN 'low'
       WHEN degree <= 4 THEN 'medium' ELSE 'high' END AS tier FROM dg""",
    "q_topology_size": f"""WITH {TIMING_EVENTS}, {PROPAGATION}, e AS ({LINKS})
SELECT (SELECT count(*) FROM (
          SELECT device_id FROM te UNION SELECT src FROM e UNION SELECT dst FROM e)) AS nodes,
       (SELECT count(*) FROM e) AS edges""",
    "q_placed_edges": f"""WITH RECURSIVE {MATCHED}, {DEVICES.replace(TIMING_EVENTS + ',', '')}
SELECT * FROM ({DAISY_APPEARANCE})
WHERE src IN (SELECT device_id FROM ex) AND dst IN (SELECT device_id FROM ex)""",
    "q_unbalanced": f"""WITH {TIMING_EVENTS}
SELECT device_id, event, count(*) FILTER (toggled) AS starts, count(*) FILTER (NOT toggled) AS ends
FROM te GROUP BY ALL HAVING starts <> ends""",
    "q_profile": f"""WITH {TIMING_EVENTS}
SELECT count(*) AS row_count, count(DISTINCT event) AS events, count(DISTINCT device_id) AS devices,
       count(DISTINCT toggled) AS toggle_values, min(time_ns) AS min_time_ns, max(time_ns) AS max_time_ns
FROM te""",
    "q_preview": f"WITH {TIMING_EVENTS} SELECT * FROM te ORDER BY ord LIMIT 10",
    "q_label_rows": f"""WITH RECURSIVE {MATCHED}
SELECT device_id, event, time_ns, ord, toggled,
       CASE WHEN ord IN (SELECT start_ord FROM ex) THEN 'start' WHEN ord IN (SELECT end_ord FROM ex) THEN 'end'
            WHEN (device_id, event, i) IN (SELECT (device_id, event, i) FROM walk) THEN 'unclosed'
            ELSE 'ignored' END AS role
FROM r""",
    "q_groups_without_execution": f"""WITH RECURSIVE {MATCHED}
SELECT DISTINCT device_id, event FROM te
WHERE (device_id, event) NOT IN (SELECT (device_id, event) FROM ex)""",
    "q_parse_lines": f"""WITH {LOG_LINES}
SELECT ord, event, time_ns, toggled, device_id, position, message_id FROM ln
WHERE NOT (ord % 17 = 3 OR ord % 23 = 5)""",
    "q_quarantine": f"""WITH {LOG_LINES}
SELECT ord,
       event || ',' || CASE WHEN ord % 17 = 3 THEN 'n/a' WHEN ord % 19 = 4 THEN time_ns || '.0'
                            ELSE CAST(time_ns AS VARCHAR) END
       || ',' || CASE WHEN ord % 23 = 5 THEN 'maybe' WHEN ord % 5 = 0 THEN CAST(toggled::INT AS VARCHAR)
                      WHEN toggled THEN 'True' ELSE 'False' END
       || ',' || device_id || ',' || CAST(position AS VARCHAR) || ',' || coalesce(message_id, '') AS value,
       CASE WHEN ord % 17 = 3 THEN 'bad_time' ELSE 'bad_toggle' END AS reason
FROM ln WHERE ord % 17 = 3 OR ord % 23 = 5""",
    "q_parse_files": f"""WITH {LOG_LINES}
SELECT ord, event, time_ns, toggled, device_id, position, message_id, CASE WHEN ord % 2 = 1 THEN 'n' || ord END AS "Note"
FROM ln WHERE NOT (ord % 17 = 3 OR ord % 23 = 5)""",
    "q_mesh_summary": f"""WITH {TIMING_EVENTS}, n AS (SELECT count(DISTINCT device_id) AS n FROM te)
SELECT n AS devices, n - 1 AS degree, n * (n - 1) // 2 AS edges FROM n""",
    "q_trends_basic": f"""WITH {BASIC}
SELECT event, row_number() OVER (PARTITION BY event ORDER BY start_ns, end_ns, start_ord) - 1 AS instance,
       start_ns, duration_ns FROM ex""",
    "q_label_rows_basic": f"""WITH {BASIC},
run_heads AS (
  SELECT event, ord, lead(ord) OVER (PARTITION BY event ORDER BY time_ns, ord) AS next, toggled
  FROM (SELECT event, ord, time_ns, toggled, lag(toggled) OVER (PARTITION BY event ORDER BY time_ns, ord) AS before FROM te)
  WHERE before IS NULL OR before <> toggled)
SELECT event, time_ns, ord, toggled,
       CASE WHEN ord IN (SELECT start_ord FROM ex) THEN 'start' WHEN ord IN (SELECT end_ord FROM ex) THEN 'end'
            WHEN ord IN (SELECT ord FROM run_heads WHERE toggled AND next IS NULL) THEN 'unclosed' ELSE 'ignored' END AS role
FROM te""",
    "q_executions_stored": f"""WITH RECURSIVE {MATCHED} SELECT * FROM ex""",
    "q_executions_stream": f"""WITH RECURSIVE {MATCHED} SELECT * FROM ex""",
    "q_nested_log": f"""WITH {TIMING_EVENTS}
SELECT event, time_ns, toggled, device_id, position, message_id, ord FROM te""",
    "q_nested_executions": f"""WITH RECURSIVE {MATCHED}
SELECT device_id, event, start_ns, end_ns, duration_ns, message_id FROM ex""",
    "q_nested_messages": f"WITH {PROPAGATION} SELECT message_id, from_device, to_device, hops, time_ns FROM pr",
    "q_box_approximate": f"""WITH RECURSIVE {MATCHED}, {BUCKETS},
vl AS (
  SELECT *, sum(n) OVER (PARTITION BY event ORDER BY bucket) AS upto FROM (
    SELECT event, bucket, count(*) AS n, least(greatest(any_value(middle), any_value(lo)::DOUBLE), any_value(hi)::DOUBLE) AS v,
           any_value(total) AS total, any_value(lo) AS lo, any_value(hi) AS hi
    FROM bk JOIN (SELECT event, count(*) AS total, min(duration_ns) AS lo, max(duration_ns) AS hi FROM ex GROUP BY event) USING (event)
    GROUP BY event, bucket)),
ends AS (
  SELECT event, p, min(CASE WHEN upto > floor((total - 1) * p) THEN v END) AS low,
         min(CASE WHEN upto > ceil((total - 1) * p) THEN v END) AS high, any_value((total - 1) * p) AS place
  FROM vl, (VALUES (0.25::DOUBLE), (0.5::DOUBLE), (0.75::DOUBLE)) ps(p) GROUP BY event, p),
q AS (
  SELECT event, max(CASE WHEN p = 0.25 THEN x END) AS q1, max(CASE WHEN p = 0.5 THEN x END) AS q2, max(CASE WHEN p = 0.75 THEN x END) AS q3
  FROM (SELECT event, p, low + (high - low) * (place - floor(place)) AS x FROM ends) GROUP BY event)
SELECT event, any_value(total) AS count, any_value(lo) AS min_ns, round(any_value(q1), 0) AS q1_ns, round(any_value(q2), 0) AS median_ns,
       round(any_value(q3), 0) AS q3_ns, any_value(hi) AS max_ns,
       round(min(CASE WHEN inside THEN v END), 0) AS low_whisker_ns, round(max(CASE WHEN inside THEN v END), 0) AS high_whisker_ns,
       CAST(coalesce(sum(CASE WHEN NOT inside THEN n END), 0) AS BIGINT) AS outliers
FROM (SELECT *, v BETWEEN q1 - (q3 - q1) * 1.5::DOUBLE AND q3 + (q3 - q1) * 1.5::DOUBLE AS inside FROM vl JOIN q USING (event))
GROUP BY event""",
    "q_quantile_buckets": f"""WITH RECURSIVE {MATCHED}, {BUCKETS}
SELECT event, CAST(day AS INT) AS day, min(min(duration_ns)) OVER w AS min_ns, max(max(duration_ns)) OVER w AS max_ns,
       CAST(bucket AS INT) AS bucket, count(*) AS n
FROM bk GROUP BY event, day, bucket WINDOW w AS (PARTITION BY event, day)""",
    "q_device_matrix_wide": f"""WITH RECURSIVE {MATCHED}, {STATS},
nr AS (SELECT device_id, row_number() OVER (ORDER BY device_id) - 1 AS i FROM (SELECT DISTINCT device_id FROM st))
SELECT event, i // 64 AS block, count(*) AS devices,
       string_agg((i % 64) || '=' || CAST(round(round(mean_ns / 1000.0::DOUBLE, 1) * 10) AS BIGINT), ' ' ORDER BY i) AS means
FROM st JOIN nr USING (device_id) GROUP BY event, i // 64""",
    "q_sync_pairs_beyond": f"WITH {STARTS} SELECT * FROM prs WHERE time_diff_ns > 30 * 86400000000000",
    "q_log_files": f"WITH {TIMING_EVENTS} SELECT event, time_ns, toggled, device_id, position, message_id FROM te",
    "q_basic_files": f"WITH {BASIC} SELECT event, start_ns, end_ns, duration_ns FROM ex",
    "q_topology_files": f"WITH {DEVICES} SELECT src, dst, 'daisy' AS mode FROM ({DAISY})",
    "q_sorted_report": f"""WITH RECURSIVE {MATCHED}, {STATS}
SELECT device_id, event, count, row_number() OVER (ORDER BY device_id, event) AS place FROM st""",
}
