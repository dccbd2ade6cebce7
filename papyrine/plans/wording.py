"""Wording and phrase operators (W3, F10, F15, F23, F34, F35, I18), ingestion and report plans."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from papyrine.functions import wording
from papyrine.operators import terms
from papyrine.plans import dialect
from papyrine.shared import new_path

_WORDS = lambda d, x: d.keep_if(d.all_of(f"lower({x})", "[a-z0-9]+"), "w", "length(w) > 2")
SYNONYMS = {"the": ("article",), "on": ("upon", "above"), "and": ("also", "with")}
ONE, OTHER, WINDOW = ("on in", "the"), ("and", "of the"), 12
POOLS = (("red", "small", "large", "blue", "green"), ("widget", "ring", "bolt", "gear", "panel"))
#: A claim that has words of both lists sounds like the first.
TONES = {"up": ("standard", "promo"), "down": ("economy",)}
ENDINGS = {("up", "down"): "first up, then down", ("down", "up"): "first down, then up", ("up", "up"): "both up"}
OTHERWISE, WITHOUT = "no clear direction", "Two claims without a common subject"


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def f10_synonyms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Words of each passage followed by synonyms of its words."""
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    return _read(spark, sf_dir, "benchmark").select("item_id", F.array_join(wording.expand(words, words, SYNONYMS), " ").alias("expanded"))


def f15_co_occurrence(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0))
    return _read(spark, sf_dir, "documents").select("doc_id", wording.co_occur(words, ONE, OTHER, WINDOW).alias("near"))


def f23_latex(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", wording.latex(F.col("text")).alias("escaped"))


def f34_disagreements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Titles of pairs of parts of one brand and size that follow each other, as claims that disagree."""
    claim = F.lower(F.concat_ws(" ", "p_name", "p_type")).alias("claim")
    before = Window.partitionBy("p_brand", "p_size").orderBy("p_partkey")
    pairs = _read(spark, sf_dir, "part").select("p_partkey", "p_brand", "p_size", claim).withColumn("other", F.lag("claim").over(before)).where("other IS NOT NULL")
    return pairs.select("p_partkey", wording.pair_title(F.col("other"), F.col("claim"), POOLS, TONES, ENDINGS, OTHERWISE, WITHOUT).alias("title"))


def s6_multi_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All sources that can be read, missing columns as nulls, one record a key with the first source's fields."""
    sources = []
    for i, (table, columns) in enumerate({"supplier": {"key": "s_suppkey", "name": "s_name"}, "missing": {"key": "key"}, "part": {"key": "p_partkey", "name": "p_name", "size": "p_size"}}.items()):
        try:
            sources.append(_read(spark, sf_dir, table).select(*(F.col(c).alias(n) for n, c in columns.items()), F.lit(i).alias("prio")))
        except Exception as error:  # a source that fails is left out
            if "PATH_NOT_FOUND" not in str(error):
                raise
    rows = sources[0]
    for more in sources[1:]:
        rows = rows.unionByName(more, allowMissingColumns=True)
    filled = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("prio"))).alias(c)
    return rows.groupBy("key").agg(filled("name"), filled("size"))


def s14_labels_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels written as CSV with every cell quoted, and read back with a schema."""
    path = new_path(spark, "labels-csv")
    _read(spark, sf_dir, "labels").select("doc_id", "quality", "toxic").write.option("header", True).option("quoteAll", True).csv(path)
    return spark.read.schema("doc_id long, quality int, toxic int").option("header", True).csv(path).groupBy("quality", "toxic").agg(F.count("*").alias("n"))


def w3_top_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The best words and, apart, the best pairs of adjacent words of each document, see :func:`terms.top_terms`."""
    return terms.top_terms(_read(spark, sf_dir, "documents"))


TEMPLATES = {
    # The best words and, apart, the best pairs of adjacent words of each document
    "w3_top_terms": lambda d: f"""
        WITH t AS (SELECT doc_id, {_WORDS(d, "text")} AS w FROM {d.t("documents")}), u AS (SELECT doc_id, w FROM t WHERE {d.size("w")} >= 2),
        raw AS (SELECT doc_id, {d.explode("w")} AS term, 0 AS bigram FROM t UNION ALL SELECT doc_id, {d.explode(d.each(d.range("1", d.size("w") + " - 1"), "i", f"concat({d.at('w', 'i')}, '__', {d.at('w', 'i + 1')})"))}, 1 FROM u),
        tf AS (SELECT doc_id, term, bigram, CAST(count(*) AS DOUBLE) AS c FROM raw GROUP BY doc_id, term, bigram),
        n AS (SELECT CAST(count(*) AS DOUBLE) AS n FROM t),
        idf AS (SELECT term, bigram, ln((max(n) + 1) / (count(*) + 0.5e0)) AS idf FROM tf CROSS JOIN n GROUP BY term, bigram HAVING count(*) >= 2 + bigram),
        m AS (SELECT doc_id, term, bigram, c, max(c) OVER (PARTITION BY doc_id, bigram) AS most FROM tf),
        s AS (SELECT doc_id, m.term, m.bigram, round((0.5e0 + 0.5e0 * c / most) * idf, 6) AS weight FROM m JOIN idf ON idf.term = m.term AND idf.bigram = m.bigram),
        r AS (SELECT doc_id, term, bigram, weight, CAST(row_number() OVER (PARTITION BY doc_id, bigram ORDER BY weight DESC, term) AS BIGINT) AS place FROM s)
        SELECT doc_id, term, bigram, weight, place FROM r WHERE place <= CASE WHEN bigram = 1 THEN 25 ELSE 45 END""",
    # Edges under the names of merged records, without loops and repeats
    "s11_alias_edges": lambda d: f"""
        WITH alias AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY text) AS kept FROM {d.t("documents")} WHERE text IS NOT NULL),
        e AS (SELECT DISTINCT l_orderkey AS x, l_partkey AS y FROM {d.t("lineitem")})
        SELECT DISTINCT coalesce(a.kept, x) AS x, coalesce(b.kept, y) AS y FROM e LEFT JOIN alias a ON a.doc_id = x LEFT JOIN alias b ON b.doc_id = y WHERE coalesce(a.kept, x) <> coalesce(b.kept, y)""",
    # What a replay of the deduplication reports
    "d12_replay": lambda d: f"""
        SELECT count(*) AS before, count(DISTINCT text) AS after, count(*) - count(DISTINCT text) AS merged, CAST(sum(CASE WHEN source IS NULL OR source = '' THEN 1 ELSE 0 END) AS BIGINT) AS without_source FROM {d.t("documents")} WHERE text IS NOT NULL""",
    # Cards of several scorers under one ranking of each kind, with their evidence's kind and caveats
    "r8_cards": lambda d: f"""
        WITH found AS (
          SELECT 'supplier' AS kind, s_suppkey AS id, least(1e0, greatest(0e0, CAST(s_acctbal AS DOUBLE) / 10000)) AS score, 0.5e0 AS confidence FROM {d.t("supplier")}
          UNION ALL SELECT 'part', p_partkey, CAST(p_size AS DOUBLE) / 50, CASE WHEN p_type = 'PROMO' THEN 0.7e0 ELSE 0.3e0 END FROM {d.t("part")})
        SELECT kind, id, {d.round("score * confidence", 6)} AS trust, CASE WHEN confidence >= 0.60 THEN 'high' WHEN confidence >= 0.35 THEN 'medium' ELSE 'low' END AS tier, CASE WHEN score < 0.1 THEN 'thin' END AS caveat,
          CAST(row_number() OVER (PARTITION BY kind ORDER BY {d.round("score * confidence", 6)} DESC, id) AS BIGINT) AS place FROM found""",
    # The fifteen best leads with a context string
    "r11_lead_shortlist": lambda d: f"""
        WITH best AS (SELECT o_custkey, count(*) AS n FROM {d.t("orders")} GROUP BY o_custkey ORDER BY n DESC, o_custkey LIMIT 15),
        said AS (SELECT DISTINCT b.o_custkey, o_orderpriority FROM best b JOIN {d.t("orders")} o ON o.o_custkey = b.o_custkey)
        SELECT c_custkey, c_name AS lead, context, n FROM best JOIN {d.t("customer")} ON c_custkey = best.o_custkey JOIN (SELECT o_custkey, {d.joined("o_orderpriority", " | ")} AS context FROM said GROUP BY o_custkey) s ON s.o_custkey = best.o_custkey""",
    # The verdict on a score that is measured with an interval
    "v11_verdicts": lambda d: f"""
        WITH m AS (SELECT lang, count(*) AS n, CAST(sum(quality) AS BIGINT) AS positive, avg(CAST(quality AS DOUBLE)) AS mean FROM {d.t("documents")} x JOIN {d.t("labels")} l ON l.doc_id = x.doc_id GROUP BY lang),
        i AS (SELECT *, mean - 1.96e0 * sqrt(mean * (1 - mean) / n) AS low FROM m)
        SELECT lang, n, round(low, 6) AS low, CASE WHEN positive < 10 OR n - positive < 10 THEN 'inconclusive' WHEN low > 0.8 THEN 'supported' WHEN low > 0.5 THEN 'not supported: popularity' ELSE 'not supported' END AS verdict FROM i""",
    # K4: labelled before and deduplicated: the longest text of each title of 25 characters stays
    "k4_prelabelled": lambda d: f"""
        WITH t AS (SELECT doc_id, lang, n_chars, trim({d.rx(f"lower({d.extract('text', '^[^.]*', 0)})", '[^a-z0-9]+', ' ')}) AS title FROM {d.t("documents")}),
        r AS (SELECT doc_id, lang, n_chars, row_number() OVER (PARTITION BY title ORDER BY n_chars DESC, doc_id) AS rn FROM t WHERE length(title) >= 25)
        SELECT doc_id, lang, CASE WHEN n_chars >= 3000 THEN 'in' WHEN n_chars >= 300 THEN 'maybe' ELSE 'out' END AS label FROM r WHERE rn = 1""",
    # categories in words
    "f35_readable": lambda d: f"SELECT DISTINCT translate(concat(event_type, '_of-', CAST(user_id AS VARCHAR(20))), '-_', '  ') AS category FROM {d.t('events')}",
    # The first phrase of a passage, by place, that some document has as adjacent words and that few others have
    "i18_phrase_check": lambda d: f"""
        WITH q AS (SELECT item_id, {_WORDS(d, "text")} AS w FROM {d.t("benchmark")}), q2 AS (SELECT item_id, w FROM q WHERE {d.size("w")} >= 2),
        p AS (SELECT item_id, w, {d.explode(d.range("1", d.size("w") + " - 1"))} AS pos FROM q2), c AS (SELECT item_id, pos, concat({d.at("w", "pos")}, '__', {d.at("w", "pos + 1")}) AS phrase FROM p),
        t AS (SELECT doc_id, {_WORDS(d, "text")} AS w FROM {d.t("documents")}), u AS (SELECT doc_id, w FROM t WHERE {d.size("w")} >= 2),
        b AS (SELECT DISTINCT doc_id, {d.explode(d.each(d.range("1", d.size("w") + " - 1"), "i", f"concat({d.at('w', 'i')}, '__', {d.at('w', 'i + 1')})"))} AS phrase FROM u),
        f AS (SELECT phrase, count(*) AS df FROM b GROUP BY phrase HAVING count(*) BETWEEN 1 AND 20),
        r AS (SELECT item_id, CAST(pos AS BIGINT) AS pos, c.phrase, df, row_number() OVER (PARTITION BY item_id ORDER BY pos) AS rn FROM c JOIN f ON f.phrase = c.phrase)
        SELECT item_id, pos, phrase, df FROM r WHERE rn = 1""",
}


def _quoted(x: str) -> str:
    return "'" + x.replace("'", "''") + "'"


def _latex_sql() -> str:
    cases = " ".join(f"WHEN {_quoted(char)} THEN {_quoted(written)}" for char, written in wording.LATEX.items())
    return f"SELECT doc_id, CASE WHEN text IS NOT NULL THEN array_to_string(list_transform(string_split(text, ''), lambda c: CASE c {cases} ELSE c END), '') END AS escaped FROM documents"


def _near_sql() -> str:
    def spans(phrases: tuple[str, ...]) -> str:
        found = []
        for p in phrases:
            words = p.split()
            here = " AND ".join(f"w{k} = '{w}'" for k, w in enumerate(words))
            found.append(f"SELECT doc_id, i AS first, i + {len(words)} AS past FROM l WHERE {here}")
        return " UNION ALL ".join(found)

    following = ", ".join(f"lead(w0, {k}) OVER (PARTITION BY doc_id ORDER BY i) AS w{k}" for k in range(1, max(len(p.split()) for p in ONE + OTHER)))
    return f"""
        WITH t AS (SELECT doc_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM documents), u AS (SELECT doc_id, unnest(w) AS w0, generate_subscripts(w, 1) AS i FROM t),
        l AS (SELECT doc_id, i, w0, {following} FROM u), x AS ({spans(ONE)}), y AS ({spans(OTHER)}),
        n AS (SELECT DISTINCT x.doc_id FROM x JOIN y ON y.doc_id = x.doc_id AND least(abs(x.first - y.past), abs(y.first - x.past)) <= {WINDOW})
        SELECT doc_id, doc_id IN (SELECT doc_id FROM n) AS near FROM documents"""


def _pair_title_sql() -> str:
    has = lambda side, words: "(" + " OR ".join(f"list_contains({side}, '{w}')" for w in words) + ")"
    first = lambda pool: "CASE " + " ".join(f"WHEN list_contains(x, '{w}') AND list_contains(y, '{w}') THEN '{w}'" for w in pool) + " END"
    sounds = lambda side: "CASE " + " ".join(f"WHEN {has(side, words)} THEN '{name}'" for name, words in TONES.items()) + " ELSE '' END"
    endings = " ".join(f"WHEN tx = '{a}' AND ty = '{b}' THEN '{ending}'" for (a, b), ending in ENDINGS.items())
    return f"""
        WITH c AS (SELECT p_partkey, list_filter(string_split_regex(regexp_replace(lower(concat_ws(' ', p_name, p_type)), '[^a-z0-9\\- ]+', '', 'g'), ' +'), lambda t: length(t) > 2) AS y, p_brand, p_size FROM part),
        p AS (SELECT p_partkey, y, lag(y) OVER (PARTITION BY p_brand, p_size ORDER BY p_partkey) AS x FROM c),
        q AS (SELECT p_partkey, {first(POOLS[0])} AS e, {first(POOLS[1])} AS o, {sounds("x")} AS tx, {sounds("y")} AS ty FROM p WHERE x IS NOT NULL)
        SELECT p_partkey, CASE WHEN e IS NULL OR o IS NULL THEN '{WITHOUT}' ELSE e || ' / ' || o || ': ' || CASE {endings} ELSE '{OTHERWISE}' END END AS title FROM q"""


_SYNONYM_SQL = "CASE w " + " ".join(f"WHEN '{w}' THEN {list(own)!r}" for w, own in SYNONYMS.items()) + " ELSE CAST([] AS VARCHAR[]) END"

QUERIES, SQL = dialect.queries(TEMPLATES)
QUERIES |= {f.__name__: f for f in (f10_synonyms, f15_co_occurrence, f23_latex, f34_disagreements, s6_multi_source, s14_labels_csv, w3_top_terms)}
SQL |= {
    "f10_synonyms": f"SELECT item_id, array_to_string(list_concat(w, flatten(list_transform(w, lambda w: {_SYNONYM_SQL}))), ' ') AS expanded FROM (SELECT item_id, regexp_extract_all(lower(text), '[a-z0-9]+') AS w FROM benchmark) x",
    "f15_co_occurrence": _near_sql(),
    "f23_latex": _latex_sql(),
    "f34_disagreements": _pair_title_sql(),
    "s6_multi_source": """
        WITH r AS (SELECT s_suppkey AS key, s_name AS name, NULL AS size, 0 AS prio FROM supplier UNION ALL SELECT p_partkey, p_name, p_size, 2 FROM part)
        SELECT key, arg_min(name, CASE WHEN name IS NOT NULL THEN prio END) AS name, arg_min(size, CASE WHEN size IS NOT NULL THEN prio END) AS size FROM r GROUP BY key""",
    "s14_labels_csv": "SELECT CAST(quality AS INTEGER) AS quality, CAST(toxic AS INTEGER) AS toxic, count(*) AS n FROM labels GROUP BY quality, toxic",
}
