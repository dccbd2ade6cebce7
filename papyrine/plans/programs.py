"""Queries whose operators are DataFrame programs, with SQL where it can state their rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from papyrine.functions import intents, statistics
from papyrine.operators import folds
from papyrine.operators.chunks import section_chunks
from papyrine.operators.components import connected_components
from papyrine.operators.kmeans import kmeans
from papyrine.operators.matching import popularity_matches
from papyrine.operators.similarity import similar_pairs
from papyrine.operators.titles import fuzzy_titles
from papyrine.streaming import events as stream


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def j1_similar_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("label").cast("long").alias("owner"), F.col("embedding").alias("v"))
    return similar_pairs(rows, 0.3, 10).select("i", "j", F.round("sim", 5).alias("sim"))


def g7_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders and items that the lines of the orders link, as components; items have negative ids."""
    rows = _read(spark, sf_dir, "lineitem")
    return connected_components(rows.select(F.col("l_orderkey").alias("src"), (-F.col("l_partkey")).alias("dst")))


def g4_kmeans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return kmeans(_read(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").alias("v")), 8, 3)


def g3_communities(spark: SparkSession, sf_dir: str) -> DataFrame:
    edges = _read(spark, sf_dir, "lineitem").select(F.year("l_shipdate").cast("long").alias("graph"), F.col("l_suppkey").alias("a"), (-(F.col("l_partkey") % 211) - 1).alias("b")).distinct()
    return folds.louvain(edges, "graph")


def d14_first_seen(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _read(spark, sf_dir, "events").select("user_id", "event_id", F.col("props"), F.concat("event_type", (F.col("value") % 7).cast("int").cast("string")).alias("title"))
    return folds.first_seen(rows, "user_id", "event_id", ["props", "title"])


def t8_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.greedy_chunks(_read(spark, sf_dir, "events"), "user_id", "value", 200.0, "event_id")


def t12_admission(spark: SparkSession, sf_dir: str) -> DataFrame:
    return folds.admit(_read(spark, sf_dir, "events"), "user_id", "value", 1500.0, "event_id")


def f18_section_chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents cut to 500 estimated tokens, each chunk with its length and digest."""
    found = section_chunks(_read(spark, sf_dir, "documents"), "doc_id", "text", 500)
    return found.select("doc_id", "chunk", "tokens", F.length("text").cast("long").alias("length"), F.sha2("text", 256).alias("digest"))


def d11_fuzzy_titles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Names of parts that are nearly equal; odd keys stand for preprints."""
    rows = _read(spark, sf_dir, "part").select(F.col("p_partkey").alias("id"), F.lower("p_name").alias("title"), (F.col("p_partkey") % 2 == 1).alias("preprint"))
    return fuzzy_titles(rows).withColumn("ratio", F.round("ratio", 6))


def j20_popularity_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Toxic documents and clean ones of the same source and like length, one to one."""
    rows = _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels"), "doc_id")
    found = popularity_matches(rows.select("source", F.col("doc_id").alias("id"), (F.col("toxic") == 1).alias("positive"), F.col("n_chars").alias("count")), "source", 0.5)
    return found.withColumn("gap", F.round("gap", 9))


def _by_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled and bad documents of each source, beside those of all sources."""
    rows = _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels"), "doc_id")
    each = rows.groupBy("source").agg(F.count("*").alias("drawn"), F.sum((F.col("quality") == 0).cast("long")).alias("k"))
    return each.crossJoin(F.broadcast(each.agg(F.sum("drawn").alias("total"), F.sum("k").alias("marked"))))  # one row


def v5_enrichment_tail(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _by_source(spark, sf_dir).select("source", "k", "drawn", F.round(statistics.hypergeometric_tail("k", "total", "marked", "drawn"), 6).alias("tail"))


def v10_power(spark: SparkSession, sf_dir: str) -> DataFrame:
    share = F.col("k") / F.col("drawn")
    return _by_source(spark, sf_dir).select("source", "drawn", F.round(statistics.ranking_power(F.col("drawn"), share), 6).alias("power"), statistics.required_size(share).alias("needed"))


def x18_intents(spark: SparkSession, sf_dir: str) -> DataFrame:
    q = F.col("text")
    return _read(spark, sf_dir, "conversations").select("conv_id", "turn", intents.distress(q).alias("distress"), intents.advice(q).alias("advice"), intents.self_harm(q).alias("self_harm"), intents.blocked(q).alias("blocked"))


def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event log as a stream, in complete mode, so that no window stays open."""
    _, path = stream.run_to_table(stream.hourly_counts(stream.read_events(spark, f"{sf_dir}/events.parquet")), "hourly", "complete")
    return spark.read.parquet(path).select((F.unix_micros("start") / 3600000000).cast("long").alias("hour"), "event_type", F.col("count").alias("n"))


def stream_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, path = stream.run_to_table(stream.once(stream.read_events(spark, f"{sf_dir}/events.parquet"), ["event_id"]), "once")
    return spark.read.parquet(path).select("event_id", "user_id", "event_type")


def stream_rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    _, path = stream.run_to_table(stream.rate_limited(stream.read_events(spark, f"{sf_dir}/events.parquet"), 150.0, 86_400), "limited")
    return spark.read.parquet(path)


def _says(pattern: str, flag: str = "(?i)") -> str:
    return "coalesce(regexp_matches(text, '" + flag + pattern.replace("'", "''") + "'), false)"


def _kmeans_sql(k: int, rounds: int) -> str:
    steps = [f"p AS MATERIALIZED (SELECT vec_id AS id, CAST(embedding AS DOUBLE[]) AS v FROM embeddings), c0 AS (SELECT row_number() OVER (ORDER BY id) - 1 AS cl, v FROM (SELECT * FROM p ORDER BY id LIMIT {k}) x)"]
    for i in range(rounds):
        steps.append(f"a{i} AS MATERIALIZED (SELECT id, any_value(v) AS v, arg_min(cl, (d, cl)) AS cl FROM (SELECT p.id, p.v, c.cl, list_sum(list_transform(list_zip(p.v, c.v), lambda z: (z[1] - z[2]) * (z[1] - z[2]))) AS d FROM p CROSS JOIN c{i} c) x GROUP BY id)")
        steps.append(f"m{i} AS (SELECT cl, list(x ORDER BY pos) AS v FROM (SELECT cl, pos, avg(x) AS x FROM (SELECT cl, unnest(v) AS x, generate_subscripts(v, 1) AS pos FROM a{i}) y GROUP BY cl, pos) z GROUP BY cl), c{i + 1} AS MATERIALIZED (SELECT c{i}.cl, coalesce(m{i}.v, c{i}.v) AS v FROM c{i} LEFT JOIN m{i} ON m{i}.cl = c{i}.cl)")
    return f"WITH {', '.join(steps)} SELECT id, CAST(cl AS BIGINT) AS cluster FROM a{rounds - 1}"


QUERIES = {f.__name__: f for f in (j1_similar_pairs, g7_components, g4_kmeans, g3_communities, d14_first_seen, t8_chunks, t12_admission, f18_section_chunks, d11_fuzzy_titles, j20_popularity_matches, v5_enrichment_tail, v10_power, x18_intents, stream_hourly, stream_once, stream_rate_limit)}
SQL = {
    "j1_similar_pairs": """
        WITH p AS (SELECT a.vec_id AS x, b.vec_id AS y, list_dot_product(CAST(a.embedding AS DOUBLE[]), CAST(b.embedding AS DOUBLE[])) AS sim FROM embeddings a JOIN embeddings b ON a.vec_id <> b.vec_id AND a.label <> b.label),
        r AS (SELECT x, y, sim, row_number() OVER (PARTITION BY x ORDER BY sim DESC, y) AS rn FROM p WHERE sim >= 0.3)
        SELECT least(x, y) AS i, greatest(x, y) AS j, round(max(sim), 5) AS sim FROM r WHERE rn <= 10 GROUP BY least(x, y), greatest(x, y)""",
    "v5_enrichment_tail": """
        WITH e AS (SELECT source, count(*) AS drawn, CAST(sum(CASE WHEN quality = 0 THEN 1 ELSE 0 END) AS BIGINT) AS k FROM documents JOIN labels USING (doc_id) GROUP BY source),
        a AS (SELECT source, k, drawn, CAST(sum(drawn) OVER () AS BIGINT) AS total, CAST(sum(k) OVER () AS BIGINT) AS marked FROM e),
        i AS (SELECT *, unnest(range(greatest(k, drawn + marked - total), least(marked, drawn) + 1)) AS i FROM a),
        p AS (SELECT source, k, drawn, exp(lgamma(marked + 1) - lgamma(i + 1) - lgamma(marked - i + 1) + lgamma(total - marked + 1) - lgamma(drawn - i + 1) - lgamma(total - marked - drawn + i + 1)
          - lgamma(total + 1) + lgamma(drawn + 1) + lgamma(total - drawn + 1)) AS p FROM i)
        SELECT source, k, drawn, round(least(1, sum(p)), 6) AS tail FROM p GROUP BY source, k, drawn""",
    "x18_intents": f"""
        SELECT conv_id, turn, {_says(intents.DISTRESS_INTENT)} OR ({_says(intents.FIRST_PERSON)} AND {_says(intents.DISTRESS_WORDS)}) AS distress, {_says(intents.ADVICE)} AS advice,
          {_says(intents.SELF_HARM)} AS self_harm, {_says(intents.SELF_HARM)} OR {_says(intents.SEXUAL)} OR {_says(intents.SLURS)} OR {_says(intents.PERSON_NAME, "")} AS blocked FROM conversations""",
    "g4_kmeans": _kmeans_sql(8, 3),
    "t8_chunks": """
        WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
        r AS (SELECT user_id, event_id, value, n, value AS used, 0::BIGINT AS chunk FROM e WHERE n = 1
          UNION ALL SELECT e.user_id, e.event_id, e.value, e.n, CASE WHEN r.used + e.value > 200 THEN e.value ELSE r.used + e.value END, r.chunk + CASE WHEN r.used + e.value > 200 THEN 1 ELSE 0 END FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
        SELECT user_id, event_id, value, chunk FROM r""",
    "t12_admission": """
        WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, value, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
        r AS (SELECT user_id, event_id, value, n, CASE WHEN value <= 1500 THEN value ELSE 0 END AS spent, value <= 1500 AS admitted FROM e WHERE n = 1
          UNION ALL SELECT e.user_id, e.event_id, e.value, e.n, r.spent + CASE WHEN r.spent + e.value <= 1500 THEN e.value ELSE 0 END, r.spent + e.value <= 1500 FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1)
        SELECT user_id, event_id, value, admitted FROM r""",
    "stream_rate_limit": """
        WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, value, epoch_us(ts) AS us, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS n FROM events),
        r AS (SELECT user_id, event_id, n, value <= 150 AS admitted, CASE WHEN value <= 150 THEN [{'us': us, 'cost': value}] ELSE [] END AS kept FROM e WHERE n = 1
          UNION ALL SELECT user_id, event_id, n, ok, CASE WHEN ok THEN list_append(live, {'us': us, 'cost': value}) ELSE live END FROM (
            SELECT e.user_id, e.event_id, e.n, e.us, e.value, list_filter(r.kept, lambda x: e.us - x.us < 86400000000) AS live, coalesce(list_sum(list_transform(list_filter(r.kept, lambda x: e.us - x.us < 86400000000), lambda x: x.cost)), 0) + e.value <= 150 AS ok
            FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) z)
        SELECT user_id, event_id, admitted FROM r""",
    "d14_first_seen": """
        WITH RECURSIVE e AS MATERIALIZED (SELECT user_id, event_id, props, event_type || CAST(CAST(trunc(value % 7) AS INTEGER) AS VARCHAR) AS title, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
        r AS (SELECT user_id, event_id, props, title, n, true AS kept, list_filter(['p' || props, 't' || title], lambda x: x IS NOT NULL) AS seen FROM e WHERE n = 1
          UNION ALL SELECT user_id, event_id, props, title, n, NOT list_has_any(seen, own), CASE WHEN list_has_any(seen, own) THEN seen ELSE list_concat(seen, own) END FROM (
            SELECT e.user_id, e.event_id, e.props, e.title, e.n, r.seen, list_filter(['p' || e.props, 't' || e.title], lambda x: x IS NOT NULL) AS own FROM r JOIN e ON e.user_id = r.user_id AND e.n = r.n + 1) z)
        SELECT user_id, event_id, props, title FROM r WHERE kept""",
    "g7_components": """
        WITH RECURSIVE e AS MATERIALIZED (SELECT DISTINCT l_orderkey AS a, -l_partkey AS b FROM lineitem WHERE l_orderkey <> -l_partkey), m AS MATERIALIZED (SELECT a, b FROM e UNION SELECT b, a FROM e),
        r(step, node, label) AS (SELECT 0, a, least(a, min(b)) FROM m GROUP BY a UNION ALL SELECT any_value(r.step) + 1, x.node, least(any_value(x.label), min(r.label)) FROM r JOIN m ON m.b = r.node JOIN r x ON x.node = m.a WHERE r.step < 24 GROUP BY x.node)
        SELECT node, label AS component FROM r WHERE step = 24""",
    "stream_hourly": "SELECT CAST(floor(epoch_us(ts) / 3600000000) AS BIGINT) AS hour, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "stream_once": "SELECT DISTINCT event_id, user_id, event_type FROM events",
}
