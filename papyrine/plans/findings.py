"""Scorers R1 and R10, phrases I17, validation V1-V18, coherence C1-C7 and classification K1-K8."""

_CLAIMS = lambda d: f"(SELECT vec_id, CAST(floor(vec_id / 5) AS BIGINT) AS paper, 2010 + vec_id % 12 AS yr, label, embedding FROM {d.t('embeddings')})"
_TOKENS = lambda d, x: d.keep_if(d.all_of(f"lower({x})", "[a-z0-9]+"), "w", "length(w) > 2")


TEMPLATES = {
    # Recurring limitations of independent papers, scored by weight, methods and span of years
    "r1_recurring_limitations": lambda d: f"""
        WITH own AS (
          SELECT concat(p_type, '/', p_brand) AS category, l_orderkey AS paper, o_custkey AS author, p_size AS method, CAST(year(o_orderdate) AS BIGINT) AS yr, CASE WHEN o_totalprice >= 200000 THEN 1 ELSE 0 END AS fulltext
          FROM {d.t("lineitem")} JOIN {d.t("orders")} ON l_orderkey = o_orderkey JOIN {d.t("part")} ON l_partkey = p_partkey WHERE l_returnflag = 'R'),
        reps AS (SELECT category, coalesce(CAST(author AS VARCHAR(20)), concat('paper:', CAST(paper AS VARCHAR(20)))) AS who, min(paper) AS paper, max(fulltext) AS fulltext FROM own GROUP BY category, coalesce(CAST(author AS VARCHAR(20)), concat('paper:', CAST(paper AS VARCHAR(20))))),
        a AS (SELECT category, count(*) AS n, sum(CASE WHEN fulltext = 1 THEN 1e0 ELSE 3e0 END) AS weight, avg(CAST(fulltext AS DOUBLE)) AS full_share FROM reps GROUP BY category HAVING count(*) >= 3),
        b AS (SELECT category, count(DISTINCT method) AS methods, max(yr) - min(yr) AS span FROM own GROUP BY category),
        s AS (SELECT a.category, n, methods, round(0.55e0 * weight / (weight + 3) + 0.25e0 * methods / (methods + 3e0) + 0.20e0 * least(1e0, span / 5e0), 6) AS score,
          round(greatest(0e0, least(1e0, 0.30e0 + 0.08e0 * (n - 3) + 0.25e0 * full_share)), 6) AS confidence FROM a JOIN b ON b.category = a.category)
        SELECT category, n, methods, score, confidence, CASE WHEN confidence >= 0.60 THEN 'high' WHEN confidence >= 0.35 THEN 'medium' ELSE 'low' END AS tier,
          CAST(row_number() OVER (ORDER BY round(score * confidence, 6) DESC, category) AS BIGINT) AS place FROM s""",
    # The number of clusters for a collection
    "r7_cluster_count": lambda d: f"SELECT source, count(*) AS n, CAST(greatest(2, round(sqrt(count(*)))) AS BIGINT) AS clusters FROM {d.t('documents')} GROUP BY source",
    # Results without support or without a trail, and those that few independent papers support
    "r10_validity_audit": lambda d: f"""
        WITH support AS (SELECT l_partkey AS result, count(DISTINCT l_orderkey) AS papers, count(DISTINCT l_suppkey) AS independent FROM {d.t("lineitem")} WHERE l_returnflag = 'R' AND l_discount >= 0.08 GROUP BY l_partkey),
        trail AS (SELECT l_partkey AS result, count(*) AS steps FROM {d.t("lineitem")} WHERE l_returnflag = 'A' AND l_discount < 0.03 GROUP BY l_partkey)
        SELECT p_partkey AS result, coalesce(papers, 0) AS papers, coalesce(steps, 0) AS steps, CASE WHEN papers IS NULL AND steps IS NULL THEN 'no support, no trail' WHEN papers IS NULL THEN 'no support' WHEN steps IS NULL THEN 'no trail' ELSE 'valid' END AS verdict, coalesce(independent, 0) < 3 AS weak
        FROM {d.t("part")} LEFT JOIN support s ON s.result = p_partkey LEFT JOIN trail t ON t.result = p_partkey""",
    # Phrases that one corpus has and others do not
    "i17_distinctive": lambda d: f"""
        WITH t AS (SELECT lang, {d.explode(d.distinct(_TOKENS(d, "text")))} AS term FROM {d.t("documents")}), n AS (SELECT lang, CAST(count(*) AS DOUBLE) AS n FROM {d.t("documents")} GROUP BY lang),
        s AS (SELECT t.lang, term, count(*) / max(n) AS share FROM t JOIN n ON n.lang = t.lang GROUP BY t.lang, term),
        m AS (SELECT a.lang, a.term, a.share - coalesce(max(b.share), 0) AS lead FROM s a LEFT JOIN s b ON b.term = a.term AND b.lang <> a.lang GROUP BY a.lang, a.term, a.share)
        SELECT lang, term, rn FROM (SELECT lang, term, CAST(row_number() OVER (PARTITION BY lang ORDER BY round(lead, 9) DESC, term) AS BIGINT) AS rn FROM m) x WHERE rn <= 15""",
    # V6: area under the curve with half ties; rows are counted by score before the running sum, which sees distinct scores only
    "v6_auc": lambda d: f"""
        WITH s AS (SELECT n_chars AS score, CAST(sum(quality) AS DOUBLE) AS pos, CAST(sum(1 - quality) AS DOUBLE) AS neg FROM {d.t("documents")} x JOIN {d.t("labels")} l ON l.doc_id = x.doc_id GROUP BY n_chars),
        r AS (SELECT pos, neg, sum(neg) OVER (ORDER BY score ROWS UNBOUNDED PRECEDING) - neg / 2e0 AS below FROM s)
        SELECT round(sum(pos * below) / (sum(pos) * sum(neg)), 9) AS auc FROM r""",
    # V7: percentile intervals over draws that a digest makes
    "v7_bootstrap": lambda d: f"""
        WITH r AS (SELECT doc_id, quality, {d.explode(d.range(1, 40))} AS b FROM {d.t("labels")}), w AS (SELECT b, quality, substr({d.sha("concat(CAST(doc_id AS VARCHAR(20)), '|', CAST(b AS VARCHAR(5)))")}, 1, 1) AS h FROM r),
        m AS (SELECT b, sum(CASE WHEN h < '6' THEN 0e0 WHEN h < 'c' THEN quality ELSE 2e0 * quality END) / sum(CASE WHEN h < '6' THEN 0e0 WHEN h < 'c' THEN 1e0 ELSE 2e0 END) AS mean FROM w GROUP BY b)
        SELECT round({d.percentile("mean", "0.025")}, 6) AS low, round({d.percentile("mean", "0.975")}, 6) AS high FROM m""",
    # V8: a permutation p-value with digests as the permutations
    "v8_permutation": lambda d: f"""
        WITH r AS (SELECT doc_id, quality, toxic, {d.explode(d.range(1, 30))} AS b FROM {d.t("labels")}), o AS (SELECT avg(CASE WHEN toxic = 1 THEN CAST(quality AS DOUBLE) END) - avg(CASE WHEN toxic = 0 THEN CAST(quality AS DOUBLE) END) AS d FROM {d.t("labels")}),
        m AS (SELECT b, avg(CASE WHEN h < '2' THEN CAST(quality AS DOUBLE) END) - avg(CASE WHEN h >= '2' THEN CAST(quality AS DOUBLE) END) AS d FROM (SELECT b, quality, substr({d.sha("concat(CAST(b AS VARCHAR(5)), '/', CAST(doc_id AS VARCHAR(20)))")}, 1, 1) AS h FROM r) x GROUP BY b)
        SELECT round((1 + sum(CASE WHEN abs(m.d) >= abs(o.d) THEN 1e0 ELSE 0e0 END)) / (1 + count(*)), 6) AS p_value FROM m CROSS JOIN o""",
    # Confusion counts of a rule against labels
    "v13_confusion": lambda d: f"SELECT toxic, CASE WHEN {d.matches('lower(text)', 'idiot|stupid|trash|moron|loser|clown')} THEN 1 ELSE 0 END AS flagged, count(*) AS n FROM {d.t('documents')} x JOIN {d.t('labels')} l ON l.doc_id = x.doc_id GROUP BY toxic, CASE WHEN {d.matches('lower(text)', 'idiot|stupid|trash|moron|loser|clown')} THEN 1 ELSE 0 END",
    "c7_domain_selection": lambda d: f"SELECT source, n, CAST(row_number() OVER (ORDER BY CASE WHEN n >= 40 THEN score ELSE -1 END DESC, source) AS BIGINT) AS place FROM (SELECT source, count(*) AS n, round(0.7e0 * avg(CASE WHEN n_chars >= 3000 THEN 1e0 ELSE 0e0 END) + 0.3e0 * count(DISTINCT lang) / 4, 9) AS score FROM {d.t('documents')} GROUP BY source) x",
    # K1: strict precedence, with the rule that decided
    "k1_three_way": lambda d: f"""
        SELECT doc_id, CASE WHEN n_chars < 50 THEN 'off' WHEN {d.matches("lower(text)", "licen[cs]e")} THEN 'on' WHEN {d.matches("text", "[#$%&|]")} THEN 'off' WHEN lang = 'en' THEN 'on' ELSE 'borderline' END AS label,
          CASE WHEN n_chars < 50 THEN 'too short' WHEN {d.matches("lower(text)", "licen[cs]e")} THEN 'core term' WHEN {d.matches("text", "[#$%&|]")} THEN 'exclusion term' WHEN lang = 'en' THEN 'language' ELSE 'no rule' END AS rationale FROM {d.t("documents")}""",
    # K5, K6: a second gate and the hard cases
    "k5_second_gate": lambda d: f"""
        SELECT source, CAST(sum(CASE WHEN {d.matches("lower(text)", "(^| )(the|der|les|los) ")} AND {d.matches("lower(text)", "(^| )(of|und|des|del) ")} THEN 1 ELSE 0 END) AS BIGINT) AS passed, CAST(sum(CASE WHEN n_chars < 100 OR {d.matches("text", "@")} THEN 1 ELSE 0 END) AS BIGINT) AS hard FROM {d.t("documents")} GROUP BY source""",
    # K7: members and the reason of every exclusion
    "k7_membership": lambda d: f"SELECT reason, count(*) AS n FROM (SELECT CASE WHEN l.doc_id IS NULL THEN 'unlabelled' WHEN quality = 0 THEN 'low quality' WHEN toxic = 1 THEN 'toxic' ELSE 'kept' END AS reason FROM {d.t('documents')} x LEFT JOIN {d.t('labels')} l ON l.doc_id = x.doc_id) y GROUP BY reason",
}
