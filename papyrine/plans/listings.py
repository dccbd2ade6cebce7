"""Listings, filters and labels: P1-P16, with the sorted listings W1, W4 and W15."""

_URGENT = "o_orderstatus = 'F' AND o_orderpriority IN ('1-URGENT', '2-HIGH') AND o_totalprice >= 1000"

TEMPLATES = {
    # Conjunctive filters, the total before paging, offset and limit after a total order
    "p1_paged_listing": lambda d: f"""
        SELECT o_orderkey, o_totalprice, total FROM (
          SELECT o_orderkey, o_totalprice, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) AS place FROM (SELECT o_orderkey, o_totalprice FROM {d.t("orders")} WHERE {_URGENT} ORDER BY o_totalprice DESC, o_orderkey LIMIT 35) y) x
        CROSS JOIN (SELECT count(*) AS total FROM {d.t("orders")} WHERE {_URGENT}) n WHERE place > 10""",
    "p2_point_lookup": lambda d: f"SELECT doc_id, lang, source, n_chars FROM {d.t('documents')} WHERE doc_id = 7",
    # Two optional equality filters, newest first, an unknown year counting as 0; the first page
    "p3_year_listing": lambda d: f"""
        SELECT o_orderkey, yr, CAST(row_number() OVER (ORDER BY coalesce(yr, 0) DESC, o_orderkey) AS BIGINT) AS place
        FROM (SELECT o_orderkey, CAST(year(o_orderdate) AS BIGINT) AS yr FROM {d.t("orders")} WHERE o_orderstatus = 'P' AND o_orderpriority = '1-URGENT' ORDER BY coalesce(CAST(year(o_orderdate) AS BIGINT), 0) DESC, o_orderkey LIMIT 100) x""",
    "p4_by_type": lambda d: f"SELECT event_id, user_id, value FROM {d.t('events')} WHERE event_type = 'purchase'",
    # P5: a parent with counts of two collections and the first 25 children
    "p5_detail_document": lambda d: f"""
        SELECT c.c_custkey, c.c_name, n.n_name, coalesce(o.orders, 0) AS orders, coalesce(k.keys, '') AS order_keys, coalesce(o.total, 0) AS total
        FROM {d.t("customer")} c LEFT JOIN {d.t("nation")} n ON n.n_nationkey = c.c_nationkey
        LEFT JOIN (SELECT o_custkey, count(*) AS orders, round(sum(o_totalprice), 2) AS total FROM {d.t("orders")} GROUP BY o_custkey) o ON o.o_custkey = c.c_custkey
        LEFT JOIN (SELECT o_custkey, {d.joined("CAST(o_orderkey AS VARCHAR(20))", ",")} AS keys FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS rn FROM {d.t("orders")}) x WHERE rn <= 25 GROUP BY o_custkey) k ON k.o_custkey = c.c_custkey""",
    # Own-work filter, visibility with a default verdict, full text, exclusions by flag
    "p6_visible_own_work": lambda d: f"""
        SELECT x.doc_id, CASE WHEN n_chars >= 3000 THEN 'fulltext' ELSE 'abstract' END AS input_source
        FROM {d.t("documents")} x LEFT JOIN (SELECT doc_id, CASE WHEN min(quality) = 0 THEN 'artifact' ELSE 'genuine' END AS verdict FROM {d.t("labels")} GROUP BY doc_id) l ON l.doc_id = x.doc_id
        WHERE coalesce(verdict, 'genuine') = 'genuine' AND lang = 'en' AND NOT coalesce(n_chars < 20, false)""",
    # Codes of the rules that apply, in the rules' order
    "p12_caveat_codes": lambda d: f"""
        SELECT doc_id, {d.listed(d.keep_if(d.array("CASE WHEN n_chars < 3000 THEN 'abstract_only' END", "CASE WHEN lang <> 'en' THEN 'other_language' END", "CASE WHEN n_chars > 15000 THEN 'very_long' END"), "c", "c IS NOT NULL"), ",")} AS caveats
        FROM {d.t("documents")}""",
    # Findings set aside and hits withheld
    "p13_set_aside": lambda d: f"""
        SELECT lang, count(*) AS n, CAST(sum(CASE WHEN n_chars < 200 THEN 1 ELSE 0 END) AS BIGINT) AS set_aside,
          CASE WHEN sum(CASE WHEN n_chars < 200 THEN 1 ELSE 0 END) * 10 > count(*) THEN 'withheld' ELSE 'shown' END AS verdict
        FROM {d.t("documents")} GROUP BY lang""",
    # Internal documents by their first line, title is the first line
    "p15_internal_excluded": lambda d: f"""
        SELECT doc_id, {d.extract("text", "^([^\\n]*)", 1)} AS title FROM {d.t("documents")} WHERE NOT {d.matches("text", "^The and attion")}""",
    "w4_core_first_trim": lambda d: f"""
        SELECT o_orderkey, CAST(row_number() OVER (ORDER BY tier, o_totalprice DESC, o_orderkey) AS BIGINT) AS place FROM (
          SELECT o_orderkey, o_totalprice, CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END AS tier FROM {d.t("orders")} ORDER BY CASE WHEN o_orderpriority = '1-URGENT' THEN 0 ELSE 1 END, o_totalprice DESC, o_orderkey LIMIT 100) x""",
    # At most 20 of each type, then in order of value
    "w15_cap_per_type": lambda d: f"""
        SELECT event_id, event_type, value, CAST(row_number() OVER (ORDER BY value DESC, event_id) AS BIGINT) AS place FROM (
          SELECT event_id, event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value DESC, event_id) AS rn FROM {d.t("events")}) x
        WHERE rn <= 20""",
}
