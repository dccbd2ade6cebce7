"""Aggregations: A1-A30 on stand-in tables."""

_REFS = lambda d: f"(SELECT DISTINCT l_suppkey AS citing, l_partkey AS cited, CAST(year(l_shipdate) AS BIGINT) AS yr FROM {d.t('lineitem')})"

TEMPLATES = {
    "a1_group_counts": lambda d: f"SELECT source, lang, count(*) AS n FROM {d.t('documents')} GROUP BY source, lang",
    "a2_corpus_stats": lambda d: f"""
        SELECT count(*) AS n_docs, count(DISTINCT source) AS n_sources, CAST(sum(CASE WHEN lang = 'en' THEN 1 ELSE 0 END) AS BIGINT) AS n_english,
          CAST(sum(CASE WHEN n_chars >= 3000 THEN 1 ELSE 0 END) AS BIGINT) AS n_fulltext, CAST(max(n_chars) AS BIGINT) AS longest FROM {d.t("documents")}""",
    # A3: distinct papers of each category, the ten largest, their sum beside it
    "a3_top_categories": lambda d: f"""
        SELECT category, papers, CAST(sum(papers) OVER () AS BIGINT) AS total FROM (
          SELECT p_type AS category, count(DISTINCT l_orderkey) AS papers, row_number() OVER (ORDER BY count(DISTINCT l_orderkey) DESC, p_type) AS rn
          FROM {d.t("lineitem")} JOIN {d.t("part")} ON l_partkey = p_partkey WHERE l_returnflag = 'N' GROUP BY p_type) x WHERE rn <= 10""",
    "a4_hedged_share": lambda d: f"""
        SELECT lang, count(*) AS n, CAST(sum(CASE WHEN hedged THEN 1 ELSE 0 END) AS BIGINT) AS hedged, round(avg(CASE WHEN hedged THEN 1e0 ELSE 0e0 END), 6) AS share
        FROM (SELECT lang, {d.matches("concat(' ', lower(text), ' ')", " (by|for|from|with) ")} AS hedged FROM {d.t("documents")}) x GROUP BY lang""",
    # A5: counts by verdict with zeros for those that do not occur
    "a5_audit_summary": lambda d: f"""
        SELECT v.verdict, coalesce(n, 0) AS n FROM (SELECT 'genuine' AS verdict UNION ALL SELECT 'artifact' UNION ALL SELECT 'duplicate') v
        LEFT JOIN (SELECT CASE WHEN quality = 1 THEN 'genuine' ELSE 'artifact' END AS verdict, count(*) AS n FROM {d.t("labels")} GROUP BY quality) x ON x.verdict = v.verdict""",
    # The mean vector of each owner, one row a component
    "a6_mean_vector": lambda d: f"""
        SELECT owner, pos, round(avg(x), 5) AS mean FROM (
          SELECT label AS owner, CAST(pos AS BIGINT) AS pos, CAST({d.at("embedding", "pos")} AS DOUBLE) AS x FROM (SELECT label, embedding, {d.explode(d.range(1, 64))} AS pos FROM {d.t("embeddings")}) y) z GROUP BY owner, pos""",
    # One representative for each known first author, unknown ones alone; distinct methods
    "a7_independent_sets": lambda d: f"""
        SELECT category, count(*) AS independent, min(paper) AS first_paper, max(methods) AS methods FROM (
          SELECT category, author_key, min(paper) AS paper, max(methods) AS methods FROM (
            SELECT p_type AS category, CASE WHEN o_custkey % 7 = 0 THEN concat('paper:', CAST(o_orderkey AS VARCHAR(20))) ELSE concat('author:', CAST(o_custkey AS VARCHAR(20))) END AS author_key, o_orderkey AS paper, 1 AS methods
            FROM {d.t("lineitem")} JOIN {d.t("orders")} ON l_orderkey = o_orderkey JOIN {d.t("part")} ON l_partkey = p_partkey) x GROUP BY category, author_key) y GROUP BY category""",
    "a8_fidelity_weighted": lambda d: f"SELECT source, CAST(sum(CASE WHEN n_chars < 3000 THEN 3e0 ELSE 1e0 END) AS DOUBLE) AS weighted FROM {d.t('documents')} GROUP BY source",
    # Missing venues leave the denominator
    "a9_hhi": lambda d: f"""
        SELECT lang, round(sum(share * share), 9) AS hhi FROM (
          SELECT lang, CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (PARTITION BY lang) AS share FROM {d.t("documents")} WHERE source IS NOT NULL GROUP BY lang, source) x GROUP BY lang""",
    # A10: the hits are counted once each, the references as often as listed; rows without any stay out
    "a10_reference_rate": lambda d: f"""
        SELECT round(avg(hits / refs), 9) AS rate, count(*) AS n FROM (
          SELECT l_orderkey, CAST(count(DISTINCT CASE WHEN l_partkey % 3 = 0 THEN l_partkey END) AS DOUBLE) AS hits, count(*) AS refs FROM {d.t("lineitem")} GROUP BY l_orderkey) x WHERE refs > 0""",
    "a11_median_span": lambda d: f"""
        SELECT p_brand, CAST(floor({d.percentile("CAST(year(l_shipdate) AS DOUBLE)", "0.5")}) AS BIGINT) AS median_year, CAST(max(year(l_shipdate)) - min(year(l_shipdate)) AS BIGINT) AS span
        FROM {d.t("lineitem")} JOIN {d.t("part")} ON l_partkey = p_partkey GROUP BY p_brand""",
    # Totals by stage, the running total, and what came after a cut
    "a12_stage_totals": lambda d: f"""
        SELECT event_type AS stage, count(*) AS calls, round(sum(value), 4) AS cost, round(sum(CASE WHEN ts >= TIMESTAMP '2024-01-15 00:00:00' THEN value ELSE 0 END), 4) AS after_cut
        FROM {d.t("events")} GROUP BY event_type""",
    # Commitments without a matching record
    "a14_pending": lambda d: f"""
        SELECT o_orderpriority, count(*) AS pending, round(sum(o_totalprice), 2) AS amount FROM {d.t("orders")}
        WHERE NOT EXISTS (SELECT 1 FROM {d.t("lineitem")} WHERE l_orderkey = o_orderkey AND l_linestatus = 'F') GROUP BY o_orderpriority""",
    "a15_mean_sd": lambda d: f"SELECT l_linenumber, round(avg(l_quantity), 6) AS mean, round(stddev_pop(l_quantity), 6) AS sd FROM {d.t('lineitem')} GROUP BY l_linenumber",
    # Slope and fit in log-log space, and its band
    "a16_loglog_slope": lambda d: f"""
        SELECT round(slope, 6) AS slope, round(r2, 6) AS r2, CASE WHEN r2 >= 0.9 THEN 'firm' WHEN r2 >= 0.7 THEN 'fair' ELSE 'weak' END AS band, round(power(8.0, slope), 4) AS cost_at_8_times FROM (
          SELECT regr_slope(ln(pairs), ln(n)) AS slope, regr_r2(ln(pairs), ln(n)) AS r2 FROM (
            SELECT CAST(count(*) AS DOUBLE) AS n, CAST(count(DISTINCT l_partkey) AS DOUBLE) AS pairs FROM {d.t("lineitem")} GROUP BY l_suppkey) x) y""",
    # Mean Jaccard distance of the first 200 pairs i < j in order of id, all among the first 201 rows; empty sets give none
    "a17_pair_distance": lambda d: f"""
        WITH s AS (SELECT doc_id, {d.distinct(d.all_of("lower(text)", "[a-z]+"))} AS w FROM (SELECT doc_id, text FROM {d.t("documents")} ORDER BY doc_id LIMIT 201) z),
        p AS (SELECT a.w AS x, b.w AS y, row_number() OVER (ORDER BY a.doc_id, b.doc_id) AS rn FROM s a JOIN s b ON a.doc_id < b.doc_id)
        SELECT round(avg(1 - CAST({d.size(d.both("x", "y"))} AS DOUBLE) / ({d.size("x")} + {d.size("y")} - {d.size(d.both("x", "y"))})), 6) AS distance FROM p
        WHERE rn <= 200 AND {d.size("x")} + {d.size("y")} > 0""",
    # Jensen-Shannon divergence of consecutive year cohorts
    "a18_cohort_divergence": lambda d: f"""
        WITH c AS (SELECT CAST(year(l_shipdate) AS BIGINT) AS yr, p_type AS ref, CAST(count(*) AS DOUBLE) AS n FROM {d.t("lineitem")} JOIN {d.t("part")} ON l_partkey = p_partkey GROUP BY year(l_shipdate), p_type),
        p AS (SELECT yr, ref, n / sum(n) OVER (PARTITION BY yr) AS p FROM c), y AS (SELECT yr, lead(yr) OVER (ORDER BY yr) AS nxt FROM (SELECT DISTINCT yr FROM c) z),
        f AS (SELECT y.yr, p.ref, p.p AS a, CAST(0 AS DOUBLE) AS b FROM y JOIN p ON p.yr = y.yr WHERE nxt IS NOT NULL UNION ALL SELECT y.yr, p.ref, CAST(0 AS DOUBLE), p.p FROM y JOIN p ON p.yr = y.nxt),
        j AS (SELECT yr, ref, sum(a) AS a, sum(b) AS b FROM f GROUP BY yr, ref)
        SELECT yr, round(abs(sum(CASE WHEN a > 0 THEN 0.5 * a * log2(2 * a / (a + b)) ELSE 0 END + CASE WHEN b > 0 THEN 0.5 * b * log2(2 * b / (a + b)) ELSE 0 END)), 6) AS divergence FROM j GROUP BY yr""",
    # Null with fewer than five pairs or chance agreement of one
    "a19_cohen_kappa": lambda d: f"""
        WITH r AS (SELECT doc_id, quality AS a, 1 - toxic AS b FROM {d.t("labels")}),
        m AS (SELECT CAST(count(*) AS DOUBLE) AS n, avg(CASE WHEN a = b THEN 1e0 ELSE 0e0 END) AS po, avg(CAST(a AS DOUBLE)) AS pa, avg(CAST(b AS DOUBLE)) AS pb FROM r)
        SELECT CAST(n AS BIGINT) AS n, CASE WHEN n < 5 OR pa * pb + (1 - pa) * (1 - pb) >= 1 THEN NULL ELSE round((po - (pa * pb + (1 - pa) * (1 - pb))) / (1 - (pa * pb + (1 - pa) * (1 - pb))), 6) END AS kappa FROM m""",
    # Agreement with a key, and whether it suffices
    "a20_reviewer_agreement": lambda d: f"""
        SELECT source AS reviewer, count(*) AS items, CAST(sum(CASE WHEN answer = truth THEN 1 ELSE 0 END) AS BIGINT) AS agree, CAST(sum(CASE WHEN answer > truth THEN 1 ELSE 0 END) AS BIGINT) AS over_called,
          avg(CASE WHEN answer = truth THEN 1e0 ELSE 0e0 END) >= 0.8 AS passed
        FROM (SELECT source, l.quality AS truth, CASE WHEN n_chars > 400 THEN 1 ELSE 0 END AS answer FROM {d.t("documents")} x JOIN {d.t("labels")} l ON l.doc_id = x.doc_id) y GROUP BY source""",
    # Edges between two groups, both directions together
    "a22_cross_group_edges": lambda d: f"""
        SELECT least(a, b) AS a, greatest(a, b) AS b, count(*) AS n FROM (
          SELECT CAST(s.s_nationkey AS BIGINT) AS a, CAST(c.c_nationkey AS BIGINT) AS b FROM {d.t("lineitem")} JOIN {d.t("supplier")} s ON l_suppkey = s_suppkey JOIN {d.t("orders")} ON l_orderkey = o_orderkey JOIN {d.t("customer")} c ON o_custkey = c_custkey) x
        WHERE a <> b GROUP BY least(a, b), greatest(a, b)""",
    "a24_growth": lambda d: f"SELECT event_type, count(*) AS n, CAST(max({d.us('ts')}) AS BIGINT) AS last_us FROM {d.t('events')} WHERE ts >= TIMESTAMP '2024-01-10 00:00:00' GROUP BY event_type",
    # A type that was not checked has no count, one without results has 0
    "a25_checked_counts": lambda d: f"""
        SELECT t.kind, CASE WHEN t.kind = 'not_run' THEN NULL ELSE coalesce(n, 0) END AS n
        FROM (SELECT 'view' AS kind UNION ALL SELECT 'purchase' UNION ALL SELECT 'absent' UNION ALL SELECT 'not_run') t LEFT JOIN (SELECT event_type, count(*) AS n FROM {d.t("events")} GROUP BY event_type) e ON e.event_type = t.kind""",
    # What is cited most outside the owned set
    "a26_cocitation": lambda d: f"""
        SELECT cited, count(*) AS n FROM {_REFS(d)} r WHERE NOT EXISTS (SELECT 1 FROM {d.t("part")} WHERE p_partkey = cited AND p_size < 10) GROUP BY cited""",
    "a27_document_frequency": lambda d: f"SELECT term, count(*) AS df FROM (SELECT doc_id, {d.explode(d.distinct(d.all_of('lower(text)', '[a-z0-9]+')))} AS term FROM {d.t('documents')}) x GROUP BY term",
    # A digest of ordered canonical lines
    "a28_fingerprint": lambda d: f"SELECT r_regionkey AS region, {d.sha(d.joined('n_name', '|'))} AS digest FROM {d.t('nation')} JOIN {d.t('region')} ON r_regionkey = n_regionkey GROUP BY r_regionkey",
    # Counts by year and the share of the last three
    "a30_timeline": lambda d: f"""
        SELECT yr, n, CAST(sum(CASE WHEN yr > newest - 3 THEN n ELSE 0 END) OVER () AS BIGINT) AS recent FROM (
          SELECT CAST(year(o_orderdate) AS BIGINT) AS yr, count(*) AS n, max(CAST(year(o_orderdate) AS BIGINT)) OVER () AS newest FROM {d.t("orders")} GROUP BY year(o_orderdate)) x""",
}
