"""The measurement chain over the events table as SQL steps, for the SQL of the registered queries.

A query's SQL names the last steps that it needs; ``steps`` puts them together.
"""

STEPS = {
    "ev": """SELECT CAST(user_id AS VARCHAR) AS flow_id, CAST(user_id % 5 AS INTEGER) AS region, 'net→' || CAST(user_id % 5 AS VARCHAR) AS route, ts AS t,
        CASE WHEN event_type <> 'error' THEN value END AS rtt,
        CASE WHEN event_type <> 'error' THEN abs(value - lag(value) OVER (PARTITION BY user_id ORDER BY ts, event_id)) END AS jitter,
        CAST(CASE WHEN event_type = 'error' THEN 100 ELSE 0 END AS DOUBLE) AS loss_pct,
        CAST(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END AS INTEGER) AS is_timeout FROM events""",
    "meas": """SELECT ev.*, CASE WHEN t < (SELECT min(t) FROM ev) + INTERVAL 360 HOURS THEN 'A' ELSE 'B' END AS period FROM ev""",
    "stats": """SELECT flow_id, route, count(*) AS n_rows, count(rtt) AS n_valid, quantile_cont(rtt, 0.5) AS median0, quantile_cont(rtt, 0.75) - quantile_cont(rtt, 0.25) AS iqr,
        quantile_cont(jitter, 0.5) AS jitter_typical, quantile_cont(loss_pct, 0.5) AS loss_typical, CAST(count(rtt) AS DOUBLE) / count(*) AS response_rate FROM meas WHERE period = 'A' GROUP BY flow_id, route""",
    "mads": """SELECT m.flow_id, quantile_cont(abs(rtt - median0), 0.5) AS mad0 FROM meas m JOIN stats s ON m.flow_id = s.flow_id WHERE period = 'A' AND rtt IS NOT NULL GROUP BY m.flow_id""",
    "card": """SELECT s.flow_id, s.route, n_rows, n_valid, CASE WHEN n_valid >= 20 THEN median0 END AS median, iqr, jitter_typical, loss_typical, response_rate,
        CASE WHEN n_valid >= 20 THEN mad0 END AS mad, n_valid < 20 AS insufficient FROM stats s LEFT JOIN mads d ON s.flow_id = d.flow_id""",
    "rel0": """SELECT m.*, median, mad, iqr, jitter_typical, rtt / nullif(median, 0) AS latency_ratio, (rtt - median) / nullif(median, 0) * 100 AS increase_pct,
        CASE WHEN rtt IS NULL THEN NULL WHEN mad = 0 AND rtt = median THEN 0.0
             ELSE (rtt - median) / CASE WHEN mad > 0 THEN 1.4826 * mad ELSE greatest(iqr / 1.349, 1.0) END END AS robust_z,
        CASE WHEN jitter_typical = 0 THEN CASE WHEN jitter = 0 THEN 1.0 WHEN jitter IS NOT NULL THEN 3.0 END ELSE jitter / nullif(jitter_typical, 0) END AS jitter_ratio
        FROM meas m JOIN card c ON m.flow_id = c.flow_id WHERE period = 'B' AND NOT insufficient""",
    "rel": """SELECT *, CAST(coalesce((robust_z >= 2 AND robust_z < 3.5) OR increase_pct BETWEEN 30 AND 80 OR jitter_ratio >= 3, false) AS INTEGER) AS moderate,
        CAST(coalesce(robust_z >= 2 OR increase_pct >= 30 OR is_timeout = 1, false) AS INTEGER) AS deviated FROM rel0""",
    "feat": """SELECT *, CAST(sum(is_timeout) OVER w AS BIGINT) AS n5_timeout, CAST(sum(CAST(increase_pct > 80 AS INTEGER)) OVER w AS BIGINT) AS n5_increase80, CAST(sum(moderate) OVER w AS BIGINT) AS n5_moderate,
        (rtt - avg(rtt) OVER w) / nullif(median, 0) AS trend, avg(deviated) OVER w AS persistence, min(robust_z) OVER w AS min5_z, avg(robust_z) OVER w AS mean5_z
        FROM rel WINDOW w AS (PARTITION BY flow_id ORDER BY t ROWS BETWEEN 4 PRECEDING AND CURRENT ROW)""",
    "ruled": """SELECT *, CAST(CASE WHEN loss_pct >= 10 THEN 1 WHEN n5_timeout >= 3 THEN 2 WHEN robust_z >= 3.5 AND increase_pct >= 30 THEN 3 WHEN n5_increase80 >= 2 THEN 4 WHEN moderate = 1 AND n5_moderate >= 2 THEN 5 ELSE 6 END AS INTEGER) AS rule FROM feat""",
    "lab": """SELECT *, CASE WHEN rule <= 4 THEN 'FAIL' WHEN rule = 5 THEN 'RISK' ELSE 'OK' END AS status_now FROM ruled""",
    "ahead": """SELECT *, CAST(floor(epoch(lead(t, 3) OVER f)) - floor(epoch(t)) AS BIGINT) AS delta_s, lead(t, 3) OVER f AS t_future, lead(status_now, 3) OVER f AS status3 FROM lab WINDOW f AS (PARTITION BY flow_id ORDER BY t)""",
    "fut": """SELECT *, CASE WHEN delta_s BETWEEN 65000 AND 152000 THEN status3 END AS status_future, status_now AS persistence_pred,
        CASE WHEN mean5_z >= 3.5 THEN 'FAIL' WHEN mean5_z >= 2 OR moderate = 1 THEN 'RISK' ELSE 'OK' END AS rule_pred FROM ahead""",
    "ends": """SELECT min(epoch_us(t)) AS a, max(epoch_us(t)) AS b FROM fut""",
    "blk": """SELECT fut.*, CASE WHEN epoch_us(t) < a + floor((b - a) * 0.5) THEN 'train' WHEN epoch_us(t) < a + floor((b - a) * 0.7) THEN 'validation' ELSE 'test' END AS block FROM fut, ends""",
    "gapped": """SELECT *, block <> 'test' AND row_number() OVER (PARTITION BY flow_id, block ORDER BY t DESC) <= 3 AS in_gap FROM blk""",
    "classes": """SELECT unnest(['OK', 'RISK', 'FAIL']) AS class""",
    "cm": """SELECT a.class AS truth, b.class AS pred, count(f.flow_id) AS n FROM classes a CROSS JOIN classes b LEFT JOIN fut f ON f.status_future = a.class AND f.rule_pred = b.class GROUP BY a.class, b.class""",
    "per": """SELECT class, coalesce(hit / nullif(said, 0), 0.0) AS precision, coalesce(hit / nullif(support, 0), 0.0) AS recall, CAST(support AS BIGINT) AS support FROM (
        SELECT class, CAST(sum(CASE WHEN truth = class AND pred = class THEN n ELSE 0 END) AS DOUBLE) AS hit, sum(CASE WHEN pred = class THEN n ELSE 0 END) AS said, sum(CASE WHEN truth = class THEN n ELSE 0 END) AS support FROM classes, cm GROUP BY class)""",
    "f1s": """SELECT *, coalesce(2 * precision * recall / nullif(precision + recall, 0), 0.0) AS f1 FROM per""",
    "bursts0": """SELECT l_orderkey AS o_orderkey, CAST(count(*) AS INTEGER) AS packets_sent, CAST(count(*) FILTER (WHERE l_discount < 0.10) AS INTEGER) AS packets_received FROM lineitem GROUP BY l_orderkey""",
    "pings": """SELECT l_orderkey AS o_orderkey, CAST(l_quantity AS DOUBLE) AS rtt, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS k FROM lineitem WHERE l_discount < 0.10 AND l_quantity > 0""",
    "steps": """SELECT o_orderkey, rtt, abs(rtt - lag(rtt) OVER (PARTITION BY o_orderkey ORDER BY k)) AS step FROM pings""",
    "rtts": """SELECT o_orderkey, avg(rtt) AS rtt, avg(step) AS jitter FROM steps GROUP BY o_orderkey""",
    "om": """SELECT CAST(c_nationkey AS VARCHAR) || '|' || o_orderpriority || '|1' AS flow_id, CAST(c_nationkey AS BIGINT) AS prb_id, o_orderpriority AS dst_addr, CAST(1 AS BIGINT) AS msm_id, 'net→' || r_name AS route, n_name AS destination_country, r_name AS destination_region,
        CAST(o_orderdate AS TIMESTAMP) + to_seconds(o.o_orderkey % 86400) AS t, r.rtt, r.jitter, CAST(packets_sent - packets_received AS DOUBLE) / packets_sent * 100 AS loss_pct,
        CAST(coalesce(r.rtt IS NULL OR packets_received = 0, false) AS INTEGER) AS is_timeout, o.o_orderkey
        FROM orders o JOIN bursts0 b ON o.o_orderkey = b.o_orderkey LEFT JOIN rtts r ON r.o_orderkey = o.o_orderkey JOIN customer ON c_custkey = o_custkey JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey""",
    "hub": """SELECT CAST(n_nationkey AS INTEGER) AS hub, n_name AS name, CAST(n_regionkey AS INTEGER) AS region, CAST(n_nationkey * 37 % 360 - 180 AS DOUBLE) AS lon, CAST(n_nationkey * 17 % 180 - 90 AS DOUBLE) AS lat FROM nation""",
    "probe": """SELECT CAST(s_suppkey AS INTEGER) AS probe, CAST(s_nationkey AS INTEGER) AS nation, CAST(s_suppkey * 37 % 360 - 180 AS DOUBLE) AS lon, CAST(s_suppkey * 17 % 180 - 90 AS DOUBLE) AS lat FROM supplier""",
}

#: Haversine between (a.lon, a.lat) and (b.lon, b.lat) in kilometres.
KM = "2 * 6371.0 * asin(least(sqrt(pow(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2), 2)), 1.0))"


def steps(select: str) -> str:
    """The select with the steps that it and they name, in order."""
    import re

    def names(text: str) -> set[str]:
        return {n for n in STEPS if re.search(rf"\b(?:FROM|JOIN|,)\s+{n}\b", text)}

    need: set[str] = set()
    todo = names(select)
    while todo:
        need |= todo
        todo = set().union(*(names(STEPS[n]) for n in todo)) - need
    return ("WITH " + ",\n".join(f"{n} AS ({STEPS[n]})" for n in STEPS if n in need) + "\n" if need else "") + select
