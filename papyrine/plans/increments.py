"""Incremental operators T1-T14 and reports X1-X22 as batch queries over the event log."""

TEMPLATES = {
    # Candidates inside the lookback, both ends included
    "t1_lookback": lambda d: f"SELECT event_type, count(*) AS n FROM {d.t('events')} WHERE ts BETWEEN TIMESTAMP '2024-01-10 00:00:00' AND TIMESTAMP '2024-01-20 00:00:00' GROUP BY event_type",
    # Tiers widened until enough are found
    "t2_tier_funnel": lambda d: f"""
        SELECT tier, n, before_n, before_n < 500 AS searched FROM (SELECT tier, n, coalesce(CAST(sum(n) OVER (ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0) AS before_n FROM (
          SELECT CAST(floor({d.days("ts", "TIMESTAMP '2024-01-01 00:00:00'")} / 3) AS BIGINT) AS tier, count(*) AS n FROM {d.t("events")} WHERE event_type = 'purchase' GROUP BY CAST(floor({d.days("ts", "TIMESTAMP '2024-01-01 00:00:00'")} / 3) AS BIGINT)) x) y""",
    # One drop reason for each candidate
    "t3_select_reasons": lambda d: f"""
        SELECT reason, count(*) AS n FROM (SELECT CASE WHEN event_type NOT IN ('purchase', 'click') THEN 'rubric' WHEN value < 20 THEN 'scope' WHEN row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) > 1 THEN 'duplicate' ELSE 'selected' END AS reason FROM {d.t("events")}) x GROUP BY reason""",
    # At-least-once log to exactly-once rows
    "t6_exactly_once": lambda d: f"SELECT user_id, event_type, min({d.us('ts')}) AS first_us, count(*) AS copies FROM {d.t('events')} GROUP BY user_id, event_type",
    # What of the current set is classified
    "t7_coverage": lambda d: f"SELECT lang, count(*) AS shortlisted, count(l.doc_id) AS classified FROM {d.t('documents')} x LEFT JOIN {d.t('labels')} l ON l.doc_id = x.doc_id GROUP BY lang",
    # Projection times a margin against what remains
    "t10_spend_gate": lambda d: f"SELECT event_type, round(spent, 4) AS spent, spent * 1.2e0 <= 110000 AS allowed FROM (SELECT event_type, sum(value) AS spent FROM {d.t('events')} GROUP BY event_type) x",
    # An overrun from the third call on
    "t11_overrun": lambda d: f"""
        SELECT event_type, count(*) AS flagged FROM (SELECT event_type, row_number() OVER (PARTITION BY event_type ORDER BY ts, event_id) AS rn, avg(value) OVER (PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS mean FROM {d.t("events")}) x WHERE rn >= 3 AND mean > 52 GROUP BY event_type""",
    # Pacing by month
    "t13_monthly_pace": lambda d: f"SELECT CAST(year(o_orderdate) AS BIGINT) AS yr, CAST(month(o_orderdate) AS BIGINT) AS mon, count(*) AS n, count(*) <= 200 AS within_limit FROM {d.t('orders')} GROUP BY year(o_orderdate), month(o_orderdate)",
    # Of each term, how often it is there and how often the text is not on the domain
    "x1_term_leaks": lambda d: f"""
        SELECT term, count(*) AS n, round(avg(CASE WHEN quality = 0 THEN 1e0 ELSE 0e0 END), 6) AS off_rate FROM (SELECT quality, {d.explode(d.distinct(d.all_of("lower(text)", "[a-z]+")))} AS term FROM {d.t("documents")} x JOIN {d.t("labels")} l ON l.doc_id = x.doc_id) y GROUP BY term HAVING count(*) >= 20""",
    # Bursts as islands of adjacent entries
    "x3_islands": lambda d: f"""
        SELECT user_id, min(seq) AS first_seq, count(*) AS size, count(*) = 3 AS proven FROM (
          SELECT user_id, seq, seq - row_number() OVER (PARTITION BY user_id ORDER BY seq) AS island FROM (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS seq FROM {d.t("events")}) x WHERE event_type = 'view') y
        GROUP BY user_id, island HAVING count(*) >= 2""",
    # An audit by stage with compensating entries
    "x4_ledger_audit": lambda d: f"SELECT event_type, count(*) AS calls, count(DISTINCT user_id) AS users, round(sum(value) - sum(CASE WHEN event_id % 50 = 0 THEN value ELSE 0 END), 4) AS corrected FROM {d.t('events')} GROUP BY event_type",
    # Two arms side by side
    "x6_two_arms": lambda d: f"SELECT source, round(avg(CASE WHEN lang = 'en' THEN CAST(n_chars AS DOUBLE) END), 4) AS english, round(avg(CASE WHEN lang = 'de' THEN CAST(n_chars AS DOUBLE) END), 4) AS german FROM {d.t('documents')} GROUP BY source",
    # Accounting of the pairs that touch an entity
    "x9_pair_accounting": lambda d: f"""
        SELECT node, count(*) AS shortlisted, CAST(sum(flag) AS BIGINT) AS flagged FROM (SELECT l_suppkey AS node, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END AS flag FROM {d.t("lineitem")} UNION ALL SELECT l_partkey, CASE WHEN l_returnflag = 'R' THEN 1 ELSE 0 END FROM {d.t("lineitem")}) x GROUP BY node""",
    # A table with its total row
    "x10_total_row": lambda d: f"SELECT coalesce(event_type, 'total') AS stage, round(sum(value), 4) AS cost, count(*) AS calls FROM {d.t('events')} GROUP BY ROLLUP (event_type)",
    # The ratio of sums over the last five days that qualify
    "x12_trailing_ratio": lambda d: f"""
        SELECT round(sum(buys) / sum(views), 6) AS ratio, count(*) AS days FROM (SELECT CAST(ts AS DATE) AS day, sum(CASE WHEN event_type = 'purchase' THEN value ELSE 0 END) AS buys, sum(CASE WHEN event_type = 'view' THEN value ELSE 0 END) AS views, row_number() OVER (ORDER BY CAST(ts AS DATE) DESC) AS rn FROM {d.t("events")} GROUP BY CAST(ts AS DATE)) x WHERE rn <= 5 AND views > 0""",
    # A linear model of the run time
    "x13_run_time": lambda d: f"SELECT source, round(30e0 + 0.5e0 * count(*) + 0.001e0 * sum(n_chars), 4) AS seconds FROM {d.t('documents')} GROUP BY source",
    # What is stale once keys are removed
    "x15_stale": lambda d: f"SELECT doc_id FROM {d.t('labels')} l WHERE NOT EXISTS (SELECT 1 FROM {d.t('documents')} x WHERE x.doc_id = l.doc_id AND source <> 'src3')",
    # The same count from several tables
    "x19_consistency": lambda d: f"SELECT (SELECT count(*) FROM {d.t('lineitem')}) AS items, CAST((SELECT sum(n) FROM (SELECT count(*) AS n FROM {d.t('lineitem')} GROUP BY l_orderkey) x) AS BIGINT) AS by_order, (SELECT count(*) FROM {d.t('lineitem')} JOIN {d.t('orders')} ON l_orderkey = o_orderkey) AS joined",
    # extensions: grouping sets and cube, an as-of join, tumbling and session windows
    "ext_cube": lambda d: f"SELECT coalesce(lang, '*') AS lang, coalesce(source, '*') AS source, count(*) AS n FROM {d.t('documents')} GROUP BY CUBE (lang, source)",
    "ext_as_of": lambda d: f"""
        SELECT event_id, prev FROM (SELECT event_id, event_type, max(CASE WHEN event_type = 'view' THEN {d.us("ts")} END) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS prev FROM {d.t("events")}) x WHERE event_type = 'purchase'""",
    "ext_tumbling": lambda d: f"SELECT CAST(floor({d.us('ts')} / 3600000000) AS BIGINT) AS hour, event_type, count(*) AS n FROM {d.t('events')} GROUP BY CAST(floor({d.us('ts')} / 3600000000) AS BIGINT), event_type",
    "ext_sessions": lambda d: f"""
        SELECT user_id, session, count(*) AS n FROM (SELECT user_id, CAST(sum(fresh) OVER (PARTITION BY user_id ORDER BY us, event_id ROWS UNBOUNDED PRECEDING) AS BIGINT) AS session FROM (
          SELECT user_id, event_id, {d.us("ts")} AS us, CASE WHEN {d.us("ts")} - lag({d.us("ts")}) OVER (PARTITION BY user_id ORDER BY ts, event_id) < 14400000000 THEN 0 ELSE 1 END AS fresh FROM {d.t("events")}) x) y GROUP BY user_id, session""",
}
