"""Scalar functions F1-F37 over documents, pages and events."""

TEMPLATES = {
    # prefixes of an identifier go one after the other
    "f3_identifier": lambda d: f"""SELECT page_id, nullif({d.rx(d.rx(d.rx("lower(trim(url))", "^https?://", ""), "^www[.]", ""), "^doi:", "")}, '') AS identifier FROM {d.t("pages")}""",
    # "Last, First" and "First Last"
    "f4_surname": lambda d: f"""SELECT c_custkey, {d.rx("lower(CASE WHEN c_name LIKE '%,%' THEN " + d.extract("c_name", "^([^,]*)", 1) + " ELSE " + d.extract("c_name", "([^ #]*)$", 1) + " END)", "[^a-z-]", "")} AS surname FROM {d.t("customer")}""",
    "f5_url_tail": lambda d: f"""SELECT page_id, {d.extract("url", "([^/]*)$", 1)} AS tail FROM {d.t("pages")}""",
    # an inverted index back into text
    "f6_uninverted": lambda d: f"""
        WITH w AS (SELECT item_id, {d.split("text", "[ \\n]+")} AS w FROM {d.t("benchmark")}),
        p AS (SELECT item_id, w, {d.explode(d.range("1", d.size("w")))} AS pos FROM w),
        q AS (SELECT item_id, CAST(pos AS BIGINT) AS pos, {d.at("w", "pos")} AS word FROM p)
        SELECT item_id, count(*) AS words, count(DISTINCT word) AS distinct_words, max(CASE WHEN pos = 1 THEN word END) AS first_word FROM q GROUP BY item_id""",
    # the first suffix that is there, if enough is left
    "f7_stem": lambda d: f"""
        SELECT term, CASE WHEN length(term) > 6 AND term LIKE '%tion' THEN left(term, length(term) - 4) WHEN length(term) > 5 AND term LIKE '%ing' THEN left(term, length(term) - 3)
          WHEN length(term) > 4 AND term LIKE '%ed' THEN left(term, length(term) - 2) WHEN length(term) > 4 AND term LIKE '%es' THEN left(term, length(term) - 2) WHEN length(term) > 3 AND term LIKE '%s' THEN left(term, length(term) - 1) ELSE term END AS stem
        FROM (SELECT DISTINCT {d.explode(d.all_of("lower(text)", "[a-z]+"))} AS term FROM {d.t("benchmark")}) x""",
    # Tokens without short and numeric ones, adjacent pairs
    "f9_bigrams": lambda d: f"""
        WITH t AS (SELECT item_id, {d.keep_if(d.all_of("lower(text)", "[a-z0-9]+"), "w", "length(w) > 2 AND NOT " + d.matches("w", "^[0-9]+$"))} AS w FROM {d.t("benchmark")}),
        p AS (SELECT item_id, w, {d.explode("CASE WHEN " + d.size("w") + " > 1 THEN " + d.range("1", d.size("w") + " - 1") + " END")} AS pos FROM t)
        SELECT item_id, CAST(pos AS BIGINT) AS pos, concat({d.at("w", "pos")}, '__', {d.at("w", "pos + 1")}) AS bigram FROM p""",
    # control and zero-width characters out, white space collapsed, cut at 200 and 80
    "f11_query_hygiene": lambda d: f"""SELECT item_id, left(q, 200) AS query, CASE WHEN length(q) > 80 THEN concat(left(q, 79), '…') ELSE q END AS echo FROM (SELECT item_id, trim({d.rx(d.rx("text", "[\\x00-\\x08\\x0B-\\x1F\\x7F]", " "), "\\s+", " ")}) AS q FROM {d.t("benchmark")}) x""",
    "f12_hedge": lambda d: f"""SELECT item_id, {d.matches("concat(' ', lower(text), ' ')", " (may|might|could|is|are) ")} AS hedged FROM {d.t("benchmark")}""",
    # the first list with a hit names the construct
    "f13_router": lambda d: f"""SELECT doc_id, CASE WHEN {d.matches("lower(text)", "licen[cs]e")} THEN 'licence' WHEN {d.matches("text", "@|[+][0-9]")} THEN 'contact' WHEN {d.matches("lower(text)", "token")} THEN 'secret' ELSE 'general' END AS construct FROM {d.t("documents")}""",
    # sentences with a term of either set
    "f14_sentences": lambda d: f"""SELECT item_id, {d.size(d.split("text", "[.!?]+\\s+"))} AS sentences, {d.size(d.keep_if(d.split("lower(text)", "[.!?]+\\s+"), "s", d.matches("s", "\\b(the|der|la|el)\\b") + " AND " + d.matches("s", "\\b(of|und|de)\\b")))} AS both_sets FROM {d.t("benchmark")}""",
    "f17_token_estimate": lambda d: f"SELECT doc_id, greatest(1, CAST(floor(n_chars / 3) AS BIGINT)) AS tokens FROM {d.t('documents')}",
    "f19_text_clean": lambda d: f"""SELECT item_id, {d.rx(d.rx("text", "-\\n", ""), "[ \\t]+", " ")} AS clean FROM {d.t("benchmark")}""",
    "f21_first_sentence": lambda d: f"""SELECT item_id, concat(upper(left(s, 1)), substr(s, 2)) AS sentence FROM (SELECT item_id, left({d.extract("text", "^([^.]*[.])", 1)}, 160) AS s FROM {d.t("benchmark")}) x""",
    "f22_slug": lambda d: f"""SELECT p_partkey, {d.rx(d.rx("lower(p_name)", "[^a-z0-9]+", "-"), "^-|-$", "")} AS slug, {d.rx("p_type", "[-_]", " ")} AS readable FROM {d.t("part")}""",
    # clamp, saturation, length of a vector
    "f25_norms": lambda d: f"""SELECT vec_id, round(sqrt({d.dot("embedding", "embedding")}), 5) AS norm, round(greatest(-1e0, least(1e0, {d.dot("embedding", "embedding")})), 5) AS clamped, round(vec_id / (vec_id + 8e0), 9) AS saturated FROM {d.t("embeddings")}""",
    "f27_pair_fidelity": lambda d: f"""
        SELECT a.doc_id, CASE WHEN a.n_chars >= 3000 AND b.n_chars >= 3000 THEN 1e0 WHEN a.n_chars >= 3000 OR b.n_chars >= 3000 THEN 0.9e0 ELSE 0.8e0 END AS factor FROM {d.t("documents")} a JOIN {d.t("documents")} b ON b.doc_id = a.doc_id + 1""",
    "f28_cost": lambda d: f"SELECT l_orderkey, l_linenumber, round((l_quantity * 1.5e0 + l_extendedprice * 7.5e0) * CASE WHEN l_returnflag = 'N' THEN 0.5e0 ELSE 1e0 END / 1e6, 12) AS cost FROM {d.t('lineitem')}",
    "f29_lookback": lambda d: f"SELECT event_id FROM {d.t('events')} WHERE ts >= TIMESTAMP '2024-01-21 00:00:00' - INTERVAL 10 DAY AND ts <= TIMESTAMP '2024-01-21 00:00:00'",
    # a strict field of a JSON text, null where it is not there
    "f30_json": lambda d: f"""SELECT event_id, CAST({d.json("props", "k")} AS BIGINT) AS k, CASE WHEN {d.json("props", "k")} IS NULL THEN 'no_field' WHEN {d.json("props", "missing")} IS NULL THEN 'partial' ELSE 'whole' END AS verdict FROM {d.t("events")}""",
    "f31_template": lambda d: f"SELECT item_id, substr({d.sha('replace(' + chr(39) + 'Classify: [text]' + chr(39) + ', ' + chr(39) + '[text]' + chr(39) + ', text)')}, 1, 12) AS prompt_hash FROM {d.t('benchmark')}",
    "f32_url_id": lambda d: f"""SELECT page_id, nullif({d.extract("url", "/([0-9]+)", 1)}, '') AS native_id, {d.extract("url", "^[a-z]+://([^/:]+)", 1)} AS host FROM {d.t("pages")}""",
    "f36_banned_words": lambda d: f"""SELECT source, count(*) AS n FROM {d.t("documents")} WHERE {d.matches("lower(text)", "\\b(stupid|trash|idiot)\\b")} GROUP BY source""",
    # Fields of a page's markup
    "s19_body_text": lambda d: f"""SELECT page_id, length(trim({d.rx(d.rx(d.rx("html", "<(script|style)[^>]*>[^<]*</(script|style)>", " "), "<[^>]*>", " "), "\\s+", " ")})) AS text_length, {d.size(d.all_of("html", "<p>"))} AS paragraphs FROM {d.t("pages")}""",
    # The first method that gives enough text, and how many each resolves
    "s18_waterfall": lambda d: f"""
        SELECT method, count(*) AS n, round(100 * CAST(count(*) AS DOUBLE) / sum(count(*)) OVER (), 4) AS percent FROM (
          SELECT CASE WHEN n_chars >= 3000 THEN 'cache' WHEN source IN ('src1', 'src2', 'src3') THEN 'location' WHEN lang = 'en' THEN 'title' ELSE 'miss' END AS method FROM {d.t("documents")}) x GROUP BY method""",
    # A line of CSV, every cell quoted, quotes doubled
    "s15_csv_lines": lambda d: f"""SELECT c_custkey, concat('"', replace(c_name, '"', '""'), '","', coalesce(replace(c_mktsegment, '"', '""'), ''), '"') AS line FROM {d.t("customer")}""",
    # Cite keys with a letter for each further one of the same name and year
    # A listing by substring, sorted, with a limit
    # S3: credits by endpoint
    "s3_credit_ledger": lambda d: f"SELECT event_type AS endpoint, count(*) AS calls, CAST(sum(CASE WHEN value > 50 THEN 10 ELSE 1 END) AS BIGINT) AS credits FROM {d.t('events')} GROUP BY event_type",
    # The latest version of each key; corrupt entries do not count
    "s13_keep_latest": lambda d: f"SELECT user_id, event_type, event_id FROM (SELECT user_id, event_type, event_id, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS rn FROM {d.t('events')} WHERE props IS NOT NULL) x WHERE rn = 1",
    # A synthetic corpus by modular picks
    "s22_generator": lambda d: f"SELECT CAST(id AS BIGINT) AS id, concat('paper-', CAST(id AS VARCHAR(10))) AS title, CAST(2010 + id % 12 AS BIGINT) AS yr, CAST(CASE WHEN id > 3 THEN id - 1 - id % 3 END AS BIGINT) AS cites FROM (SELECT {d.explode(d.range(1, 200))} AS id) x",
}
