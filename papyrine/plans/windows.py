"""Windows and ranking W2-W17, and set operations U1-U8."""

TEMPLATES = {
    # The k best of each row's group, ties by id
    "w2_top_per_group": lambda d: f"SELECT user_id, event_id, rn FROM (SELECT user_id, event_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS BIGINT) AS rn FROM {d.t('events')}) x WHERE rn <= 3",
    # The sum over the last 60 minutes, the lower bound exclusive
    "w6_rolling_sum": lambda d: f"SELECT event_id, round(sum(value) OVER (PARTITION BY user_id ORDER BY {d.us('ts')} RANGE BETWEEN 3599999999 PRECEDING AND CURRENT ROW), 4) AS rolling FROM {d.t('events')}",
    "w7_year_pairs": lambda d: f"SELECT yr, lead(yr) OVER (ORDER BY yr) AS next_year, n, lead(n) OVER (ORDER BY yr) - n AS change FROM (SELECT CAST(year(o_orderdate) AS BIGINT) AS yr, count(*) AS n FROM {d.t('orders')} GROUP BY year(o_orderdate)) x",
    "w8_earliest": lambda d: f"SELECT l_partkey, CAST(min(year(l_shipdate)) AS BIGINT) AS first_year FROM {d.t('lineitem')} GROUP BY l_partkey",
    # Fair order by what is owed, last served, size and name
    "w9_fair_order": lambda d: f"""
        SELECT p_brand, CAST(row_number() OVER (ORDER BY owed DESC, coalesce(last_served, 0), -candidates, p_brand) AS BIGINT) AS place FROM (
          SELECT p_brand, count(*) % 5 AS owed, CAST(min(p_size) AS BIGINT) AS last_served, count(DISTINCT p_type) AS candidates FROM {d.t("part")} GROUP BY p_brand) x""",
    # Equal shares, the remainder to the first
    "w11_equal_split": lambda d: f"SELECT n_name, CAST(floor(107 / n) AS BIGINT) + CASE WHEN rn <= 107 - n * CAST(floor(107 / n) AS BIGINT) THEN 1 ELSE 0 END AS share FROM (SELECT n_name, row_number() OVER (ORDER BY n_name) AS rn, count(*) OVER () AS n FROM {d.t('nation')}) x",
    # So many of each stratum in the order of a digest of id and seed
    "w13_stratified_sample": lambda d: f"SELECT doc_id, lang, rn FROM (SELECT doc_id, lang, CAST(row_number() OVER (PARTITION BY lang ORDER BY {d.sha('concat(CAST(doc_id AS VARCHAR(20)), ' + chr(39) + '|7' + chr(39) + ')')}, doc_id) AS BIGINT) AS rn FROM {d.t('documents')}) x WHERE rn <= 15",
    "w17_capped_paging": lambda d: f"SELECT o_custkey, o_orderkey, rn FROM (SELECT o_custkey, o_orderkey, CAST(row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS BIGINT) AS rn FROM {d.t('orders')}) x WHERE rn <= 4",
    # Union of sources, distinct and in order
    "u1_union_distinct": lambda d: f"SELECT key FROM (SELECT s_nationkey AS key FROM {d.t('supplier')} UNION SELECT c_nationkey FROM {d.t('customer')}) x",
    # Order-stable union of two lists
    # Jaccard of the words of neighbouring items
    "u3_jaccard": lambda d: f"""
        WITH s AS (SELECT item_id, {d.distinct(d.all_of("lower(text)", "[a-z]+"))} AS w FROM {d.t("benchmark")})
        SELECT a.item_id, CAST({d.size(d.both("a.w", "b.w"))} AS BIGINT) AS common, round(CAST({d.size(d.both("a.w", "b.w"))} AS DOUBLE) / ({d.size("a.w")} + {d.size("b.w")} - {d.size(d.both("a.w", "b.w"))}), 9) AS jaccard FROM s a JOIN s b ON b.item_id = a.item_id + 1""",
    # Difference of sets
    "u5_difference": lambda d: f"SELECT p_partkey FROM {d.t('part')} EXCEPT SELECT l_partkey FROM {d.t('lineitem')} WHERE l_quantity > 45",
    "u5_intersection": lambda d: f"SELECT l_partkey FROM {d.t('lineitem')} WHERE l_returnflag = 'R' INTERSECT SELECT l_partkey FROM {d.t('lineitem')} WHERE l_returnflag = 'A'",
    # What appeared and what left between two snapshots, with reasons
    "u7_snapshot_diff": lambda d: f"""
        SELECT coalesce(a.k, b.k) AS k, CASE WHEN a.k IS NULL THEN 'appeared' WHEN b.k IS NULL THEN 'left' WHEN a.n <> b.n THEN 'changed' ELSE 'same' END AS status
        FROM (SELECT user_id AS k, count(*) AS n FROM {d.t("events")} WHERE ts < TIMESTAMP '2024-01-08 00:00:00' GROUP BY user_id) a
        FULL OUTER JOIN (SELECT user_id AS k, count(*) AS n FROM {d.t("events")} WHERE ts >= TIMESTAMP '2024-01-23 00:00:00' GROUP BY user_id) b ON a.k = b.k""",
    # U8: the old list must be a prefix of the new one
}
