"""Joins J4-J19, deduplication D16-D20 and graph operators G1-G8 that SQL states directly."""

_CLAIMS = lambda d: f"(SELECT vec_id, CAST(floor(vec_id / 5) AS BIGINT) AS paper, 2010 + vec_id % 12 AS yr, label, embedding FROM {d.t('embeddings')})"
#: Citation graph: a supplier's item cites the items that the same orders bought from the same nation.
_EDGES = lambda d: f"(SELECT DISTINCT l_suppkey AS citing, l_partkey % 97 AS cited FROM {d.t('lineitem')} WHERE l_suppkey <> l_partkey % 97)"
#: A document's title is its first line up to a full stop.
_DOCS = lambda d: f"(SELECT doc_id, source, CAST(2000 + doc_id % 3 AS BIGINT) AS yr, trim({d.rx(f"lower({d.extract('text', _TITLE, 0)})", '[^a-z0-9]+', ' ')}) AS title, n_chars FROM {d.t('documents')})"
_TITLE = "^[^.\\n]*"

TEMPLATES = {
    # The citation graph, without self-edges, and its symmetric form
    "j4_citation_edges": lambda d: f"SELECT citing, cited FROM {_EDGES(d)} e",
    "g1_undirected": lambda d: f"SELECT DISTINCT least(citing, cited) AS a, greatest(citing, cited) AS b FROM {_EDGES(d)} e",
    "g8_degrees": lambda d: f"SELECT node, CAST(sum(o) AS BIGINT) AS out_edges, CAST(sum(i) AS BIGINT) AS in_edges FROM (SELECT citing AS node, 1 AS o, 0 AS i FROM {_EDGES(d)} e UNION ALL SELECT cited, 0, 1 FROM {_EDGES(d)} f) x GROUP BY node",
    # Modularity of a partition in closed form
    "g2_modularity": lambda d: f"""
        WITH e AS (SELECT DISTINCT least(citing, cited) AS a, greatest(citing, cited) AS b FROM {_EDGES(d)} x), m AS (SELECT CAST(count(*) AS DOUBLE) AS m FROM e),
        g AS (SELECT a % 5 AS c, 1 AS deg FROM e UNION ALL SELECT b % 5, 1 FROM e), k AS (SELECT c, CAST(count(*) AS DOUBLE) AS deg FROM g GROUP BY c),
        i AS (SELECT a % 5 AS c, CAST(count(*) AS DOUBLE) AS inner_edges FROM e WHERE a % 5 = b % 5 GROUP BY a % 5)
        SELECT round(sum(coalesce(inner_edges, 0) / m - (deg / (2 * m)) * (deg / (2 * m))), 9) AS q FROM k CROSS JOIN m LEFT JOIN i ON i.c = k.c""",
    # Two hops from seeds, so many of each
    "g5_two_hops": lambda d: f"""
        WITH e AS {_EDGES(d)}, h1 AS (SELECT citing AS seed, cited, row_number() OVER (PARTITION BY citing ORDER BY cited) AS rn FROM e WHERE citing IN (SELECT s_suppkey FROM {d.t("supplier")} WHERE s_acctbal < 0)),
        k1 AS (SELECT DISTINCT cited AS node FROM h1 WHERE rn <= 15), h2 AS (SELECT e.cited, count(*) AS n FROM e JOIN k1 ON e.citing = k1.node GROUP BY e.cited)
        SELECT cited, n FROM (SELECT cited, n, row_number() OVER (ORDER BY n DESC, cited) AS rn FROM h2) x WHERE rn <= 20""",
    # What cites both
    "j12_cites_both": lambda d: f"SELECT citing, count(DISTINCT cited) AS cited_of_both FROM {_EDGES(d)} e WHERE cited IN (3, 5) AND citing NOT IN (3, 5) GROUP BY citing HAVING count(DISTINCT cited) = 2",
    # Edges that go both ways
    "j14_reciprocal": lambda d: f"SELECT a.citing, a.cited FROM {_EDGES(d)} a JOIN {_EDGES(d)} b ON a.citing = b.cited AND a.cited = b.citing",
    # Verdicts by canonical unordered pair
    "j6_verdict_by_pair": lambda d: f"""
        SELECT p.a, p.b, coalesce(v.verdict, 'unaudited') AS verdict FROM (SELECT DISTINCT least(citing, cited) AS a, greatest(citing, cited) AS b FROM {_EDGES(d)} e) p
        LEFT JOIN (SELECT least(l_suppkey, l_partkey % 97) AS a, greatest(l_suppkey, l_partkey % 97) AS b, max(CASE WHEN l_returnflag = 'R' THEN 'artifact' ELSE 'genuine' END) AS verdict FROM {d.t("lineitem")} GROUP BY least(l_suppkey, l_partkey % 97), greatest(l_suppkey, l_partkey % 97)) v
        ON v.a = p.a AND v.b = p.b""",
    # Ids resolved against a tagged union, the first kind wins
    "j7_resolve_kinds": lambda d: f"""
        WITH k AS (SELECT s_suppkey AS id, 'supplier' AS kind, 1 AS prio FROM {d.t("supplier")} UNION ALL SELECT p_partkey, 'part', 2 FROM {d.t("part")} UNION ALL SELECT c_custkey, 'customer', 3 FROM {d.t("customer")})
        SELECT id, kind FROM (SELECT id, kind, row_number() OVER (PARTITION BY id ORDER BY prio) AS rn FROM k) x WHERE rn = 1""",
    # Chained anti joins
    "j8_known_items": lambda d: f"""
        SELECT p_partkey FROM {d.t("part")} p WHERE NOT EXISTS (SELECT 1 FROM {d.t("lineitem")} WHERE l_partkey = p_partkey AND l_quantity >= 50)
          AND NOT EXISTS (SELECT 1 FROM {d.t("supplier")} WHERE s_suppkey = p_partkey) AND NOT EXISTS (SELECT 1 FROM {d.t("customer")} WHERE c_custkey = p_partkey * 2)""",
    # Inner join on a key of four columns
    "j5_cache_join": lambda d: f"""
        SELECT m.doc_id, l.quality FROM (SELECT doc_id, 'm' AS model, lang AS src, 'p1' AS prompt FROM {d.t("documents")}) m
        JOIN (SELECT doc_id, 'm' AS model, 'en' AS src, 'p1' AS prompt, quality FROM {d.t("labels")}) l ON l.doc_id = m.doc_id AND l.model = m.model AND l.src = m.src AND l.prompt = m.prompt""",
    # An edge in either direction
    "j11_either_direction": lambda d: f"""
        SELECT p.s_suppkey AS a, p.s_suppkey + 1 AS b, max(CASE WHEN e.citing IS NULL THEN 0 ELSE 1 END) AS linked FROM {d.t("supplier")} p
        LEFT JOIN (SELECT citing, cited FROM {_EDGES(d)} x UNION SELECT cited, citing FROM {_EDGES(d)} y) e ON e.citing = p.s_suppkey AND e.cited = p.s_suppkey + 1 GROUP BY p.s_suppkey""",
    # Ownership with a preferred owner
    "j19_owner": lambda d: f"SELECT id, owner FROM (SELECT id, owner, row_number() OVER (PARTITION BY id ORDER BY pref, owner) AS rn FROM (SELECT l_partkey AS id, l_suppkey AS owner, CASE WHEN l_suppkey % 10 = 0 THEN 0 ELSE 1 END AS pref FROM {d.t('lineitem')}) y) x WHERE rn = 1",
    # How often a headline is there
    "d19_headline_suffix": lambda d: f"SELECT doc_id, CASE WHEN n > 1 THEN concat(h, ' (', CAST(rn AS VARCHAR(10)), ')') ELSE h END AS headline FROM (SELECT doc_id, h, count(*) OVER (PARTITION BY h) AS n, row_number() OVER (PARTITION BY h ORDER BY doc_id) AS rn FROM (SELECT doc_id, title AS h FROM {_DOCS(d)} z) y) x",
    # Extractions of merged records under their survivor
    "d16_fold": lambda d: f"""
        WITH t AS {_DOCS(d)}, s AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY title) AS survivor FROM t)
        SELECT survivor, count(*) AS rows_folded, max(toxic) AS toxic FROM s JOIN {d.t("labels")} l ON l.doc_id = s.doc_id GROUP BY survivor""",
    # The strongest reason of each key; idempotent materialisation
    "d17_strongest_reason": lambda d: f"SELECT user_id, event_type, value FROM (SELECT user_id, event_type, value, row_number() OVER (PARTITION BY user_id ORDER BY value DESC, event_id) AS rn FROM {d.t('events')}) x WHERE rn = 1",
    "d18_verdict_log": lambda d: f"SELECT verdict, count(*) AS n FROM (SELECT user_id, props, event_type AS verdict, row_number() OVER (PARTITION BY user_id, props ORDER BY ts, event_id) AS rn FROM {d.t('events')}) x WHERE rn = 1 GROUP BY verdict",
}
