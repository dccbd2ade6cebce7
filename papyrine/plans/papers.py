"""Records of papers made from the documents: mappers, stores and sinks (S1, S5, S7-S8, S10, S12, S16-S17, S21), merge rules."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from papyrine.functions.text import ascii_fold
from papyrine.operators import dedup
from papyrine.shared import keep, new_path
from papyrine.sources import mappers, resolver


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def papers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A record for each document: the first sentence is the title, the first words are the authors, the rest follows from id and title."""
    docs = _read(spark, sf_dir, "documents").where("doc_id IS NOT NULL")
    title = F.regexp_extract("text", "^[^.\n]*", 0)
    h = F.substring(F.sha2(F.coalesce(title, F.lit("")), 256), 1, 10)
    n = F.col("doc_id")
    doi = F.when(n % 5 == 0, F.concat(F.lit("https://doi.org/10.48550/arXiv."), h)).when((n % 5).isin(1, 2), F.concat(F.lit(" DOI:10.1000/"), F.upper(h))).when(n % 5 == 3, F.concat(F.lit("10.1000/x"), n))
    return docs.select(
        F.concat(F.lit("W"), F.lpad(n.cast("string"), 9, "0")).alias("id"), doi.alias("doi"), title.alias("title"), (2000 + n % 4).cast("long").alias("year"),
        F.slice(F.regexp_extract_all(F.lower(F.coalesce("text", F.lit(""))), F.lit("[a-z]+"), F.lit(0)), 1, 3).alias("surnames"), F.when(n % 3 != 0, F.col("source")).alias("venue"),
        F.col("n_chars").cast("long").alias("citations"), (n % 2 == 0).alias("reviewed"), F.array(n % 7, n % 11, n % 7).alias("refs"), F.col("text").alias("abstract"),
    )


_ENTITIES: dict[tuple[str, str], DataFrame] = {}


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The entities of all rules, made once a session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _ENTITIES:
        rows = papers(spark, sf_dir)
        _ENTITIES[key] = keep(dedup.entities(rows, keep(dedup.links(rows), "links")), "entities")
    return _ENTITIES[key]


def _by_rule(rule) -> object:
    def query(spark: SparkSession, sf_dir: str) -> DataFrame:
        rows = papers(spark, sf_dir)
        return dedup.entities(rows, rule(rows))

    return query


def d5_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(dedup.near_duplicates(papers(spark, sf_dir)))


def d7_candidate_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _measured(dedup.candidate_report(papers(spark, sf_dir)), "blocked_by")


def _measured(found: DataFrame, *more: str) -> DataFrame:
    return found.select("a", "b", "a_members", "b_members", F.round("title_jaccard", 6).alias("title_jaccard"), F.round("abstract_jaccard", 6).alias("abstract_jaccard"), *more)


def d8_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.survivors(papers(spark, sf_dir), _entities(spark, sf_dir))


def d9_field_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    return dedup.merged(papers(spark, sf_dir), _entities(spark, sf_dir)).withColumn("refs", F.array_join("refs", ","))


def d10_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _entities(spark, sf_dir).select("id", "entity")


def s1_seed_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A folder of files with one record each: those whose name has the query, in the files' order, so many."""
    path = new_path(spark, "seed")
    _read(spark, sf_dir, "nation").orderBy("n_nationkey").write.option("maxRecordsPerFile", 1).json(path)
    return resolver.seed(spark, path, "n_nationkey long, n_name string, n_regionkey long", "n_name", "Tion_1", 5, "n_nationkey").select("n_nationkey", "n_name")


def s5_source_resolver(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which source each setting reads, and how many rows it has; no setting mixes two."""
    sources = {"seed": lambda: _read(spark, sf_dir, "region").select(F.col("r_name").alias("name")), "live": lambda: _read(spark, sf_dir, "nation").select(F.col("n_name").alias("name"))}
    rows = []
    for setting, available in (("seed", True), ("live", True), ("auto", True), ("auto", False)):
        kind, found = resolver.resolve(setting, sources["seed"], sources["live"], available)
        rows.append(found.agg(F.count("*").alias("n")).select(F.lit(setting).alias("setting"), F.lit(available).alias("available"), F.lit(kind).alias("source"), "n"))
    return rows[0].union(rows[1]).union(rows[2]).union(rows[3])


def _flat(mapped: DataFrame) -> DataFrame:
    return mapped.select("id", "doi", "title", "year", "venue", "citations", F.array_join("surnames", "|").alias("surnames"), F.array_join("refs", "|").alias("refs"), F.length("abstract").cast("long").alias("abstract_length"))


def s7_provider_a(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as nested JSON of one provider (text as an inverted index) and mapped back."""
    rows = papers(spark, sf_dir)
    words = F.regexp_extract_all(F.lower(F.coalesce("abstract", F.lit(""))), F.lit("[a-z]+"), F.lit(0))
    few = F.slice(words, 1, 12)
    inverted = F.map_from_entries(F.transform(F.array_distinct(few), lambda w: F.struct(w, F.filter(F.transform(few, lambda x, i: F.when(x == w, i)), lambda i: i.isNotNull()))))
    raw = F.to_json(F.struct(
        F.concat(F.lit("https://records.example/"), F.col("id")).alias("id"), F.col("doi"), F.when(F.col("citations") % 2 == 0, F.col("title")).alias("display_name"), F.col("title").alias("title"), F.col("year").alias("publication_year"),
        F.struct(F.struct(F.col("venue").alias("display_name")).alias("source")).alias("primary_location"), F.transform("surnames", lambda s: F.struct(F.struct(F.concat(F.lit("Ann "), s).alias("display_name")).alias("author"))).alias("authorships"),
        F.col("citations").alias("cited_by_count"), F.transform("refs", lambda r: F.concat(F.lit("https://records.example/W"), r)).alias("referenced_works"), inverted.alias("abstract_inverted_index"),
    ))
    return _flat(mappers.provider_a(rows.select(raw.alias("raw"))))


def s8_provider_b(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records as JSON of another provider and mapped back; broken ones are left out."""
    rows = papers(spark, sf_dir)
    raw = F.to_json(F.struct(
        F.col("id").alias("paperId"), F.struct(F.col("doi").alias("DOI")).alias("externalIds"), "title", "year", F.coalesce("venue", F.lit("")).alias("venue"), F.transform("surnames", lambda s: F.struct(F.concat(s, F.lit(", B.")).alias("name"))).alias("authors"),
        F.col("citations").alias("citationCount"), F.transform("refs", lambda r: F.struct(F.concat(F.lit("W"), r).alias("paperId"))).alias("references"), F.substring("abstract", 1, 40).alias("abstract"),
    ))
    broken = F.when(F.col("citations") % 10 == 3, F.substring(raw, 1, 20)).otherwise(raw)
    return _flat(mappers.provider_b(rows.select(broken.alias("raw"))))


def s10_corpus_claims(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Claims of the papers of a manifest in order: papers without an extraction of the manifest's model and prompt are left out."""
    rows = papers(spark, sf_dir)
    manifest = rows.select("id", F.when(F.col("reviewed"), "large").otherwise("small").alias("model"), F.lit("fulltext").alias("source"), F.lit("p1").alias("prompt"))
    model = F.when(F.col("citations") % 3 == 0, "large").otherwise("small")
    cache = rows.select("id", model.alias("model"), F.lit("fulltext").alias("source"), F.when(F.col("year") == 2003, "p0").otherwise("p1").alias("prompt"), F.col("surnames").alias("claims"))
    found = manifest.join(cache, ["id", "model", "source", "prompt"]).select("id", F.posexplode("claims").alias("place", "claim"))
    return found.select(F.concat_ws(":", "id", "place").alias("claim_id"), F.col("id").alias("paper"), F.col("place").cast("long").alias("place"), "claim")


def s12_stores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Vectors as a Parquet store and links as lines of JSON, written, read back and joined."""
    vectors, links = new_path(spark, "vectors"), new_path(spark, "links")
    rows = _read(spark, sf_dir, "embeddings")
    rows.select("vec_id", F.col("embedding").cast("array<float>").alias("v")).write.parquet(vectors)
    rows.select(F.col("vec_id").alias("from_id"), (F.col("vec_id") + 1).alias("to_id"), F.when(F.col("label") % 2 == 0, "supports").otherwise("contradicts").alias("relationship")).write.json(links)
    found = spark.read.schema("from_id long, to_id long, relationship string").json(links)
    v = spark.read.parquet(vectors)
    ends = found.join(v.select(F.col("vec_id").alias("from_id"), F.size("v").alias("a")), "from_id").join(v.select(F.col("vec_id").alias("to_id"), F.size("v").alias("b")), "to_id")
    return ends.groupBy("relationship").agg(F.count("*").alias("n"), F.sum(F.col("a") + F.col("b")).cast("long").alias("components"))


_UMLAUTS = {"ü": "ue", "ö": "oe", "ä": "ae", "Ü": "Ue", "Ö": "Oe", "Ä": "Ae"}


def cite_key(surname: Column, year: Column, record: Column) -> Column:
    """Surname and year, umlauts written out and other accents dropped; the record's id where one is missing."""
    written = surname
    for char, plain in _UMLAUTS.items():
        written = F.replace(written, F.lit(char), F.lit(plain))
    family = F.lower(F.regexp_replace(ascii_fold(F.coalesce(written, F.lit(""))), "[^A-Za-z]", ""))
    return F.when((family != "") & year.isNotNull(), F.concat(family, year)).otherwise(F.concat(F.lit("record"), record))


def s16_cite_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cite keys and the first lines of BibTeX entries; further records of a key get a letter, in their order (beyond z a number)."""
    docs = _read(spark, sf_dir, "documents")
    family = F.nullif(F.regexp_extract("text", r"[^\x00-\x40\x5B-\x60\x7B-\x7F]{4,}", 0), F.lit(""))
    keyed = docs.select("doc_id", cite_key(family, F.when(F.col("doc_id") % 9 != 0, 2000 + F.col("doc_id") % 4).cast("string"), F.col("doc_id").cast("string")).alias("base"))
    place = F.row_number().over(Window.partitionBy("base").orderBy("doc_id"))
    suffix = F.when(F.col("n") == 1, "").when(F.col("n") <= 27, F.char(95 + F.col("n"))).otherwise(F.concat(F.lit("-"), F.col("n").cast("string")))
    return keyed.withColumn("n", place).select("doc_id", F.concat("base", suffix).alias("cite_key"), F.concat(F.lit("@article{"), "base", suffix, F.lit(",")).alias("line"))


def s17_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents of each source as lines of JSON in a folder of its own, with a manifest; both read back."""
    path, manifest = new_path(spark, "snapshot"), new_path(spark, "manifest")
    rows = papers(spark, sf_dir).withColumn("library", F.coalesce("venue", F.lit("none")))
    body = F.to_json(F.struct("id", "title", "year", "citations"))
    rows.select("library", body.alias("value")).repartition("library").write.partitionBy("library").text(path)
    rows.groupBy("library").agg(F.count("*").alias("listed")).write.json(manifest)
    back = spark.read.schema("value string, library string").text(path).select("library", F.from_json("value", "id string, title string, year long, citations long").alias("r"))
    counted = back.groupBy("library").agg(F.count("*").alias("n"), F.sum("r.citations").alias("citations"), F.min("r.id").alias("first"))
    return counted.join(spark.read.schema("library string, listed long").json(manifest), "library").select("library", "n", "listed", "citations", "first")


def s21_slim(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The slim form of the records, as it is written: no abstracts, references as a number."""
    path = new_path(spark, "slim")
    rows = papers(spark, sf_dir)
    rows.select("id", "doi", "year", "venue", "citations", F.size("refs").cast("long").alias("n_refs")).write.parquet(path)
    return spark.read.parquet(path)


QUERIES = {f.__name__: f for f in (d5_near_duplicates, d7_candidate_report, d8_survivors, d9_field_merge, d10_entities, s1_seed_scan, s5_source_resolver, s7_provider_a, s8_provider_b, s10_corpus_claims, s12_stores, s16_cite_keys, s17_snapshot, s21_slim)}
QUERIES |= {"d1_same_doi": _by_rule(dedup.by_doi), "d2_same_title": _by_rule(dedup.by_title_and_year), "d3_near_year": _by_rule(dedup.by_title_near_year), "d4_preprint": _by_rule(dedup.by_preprint)}

# SQL from the definitions: all pairs that a rule allows, and what they connect by recursion.
_RAW = """
raw AS (SELECT doc_id AS n, text, source, n_chars, coalesce(regexp_extract(text, '^[^.\\n]*'), '') AS t FROM documents WHERE doc_id IS NOT NULL),
p AS MATERIALIZED (SELECT 'W' || lpad(CAST(n AS VARCHAR), 9, '0') AS id,
  CASE WHEN n % 5 = 0 THEN 'https://doi.org/10.48550/arXiv.' || sha256(t)[:10] WHEN n % 5 IN (1, 2) THEN ' DOI:10.1000/' || upper(sha256(t)[:10]) WHEN n % 5 = 3 THEN '10.1000/x' || n END AS doi,
  CASE WHEN text IS NOT NULL THEN t END AS title, CAST(2000 + n % 4 AS BIGINT) AS year, (regexp_extract_all(lower(coalesce(text, '')), '[a-z]+'))[:3] AS surnames, CASE WHEN n % 3 <> 0 THEN source END AS venue,
  CAST(n_chars AS BIGINT) AS citations, n % 2 = 0 AS reviewed, [n % 7, n % 11, n % 7] AS refs, text AS abstract FROM raw),
k AS MATERIALIZED (SELECT *, nullif(regexp_replace(lower(trim(doi)), '^(https?://(dx[.])?doi[.]org/|doi:)', ''), '') AS d,
  trim(regexp_replace(lower(regexp_replace(strip_accents(regexp_replace(coalesce(title, ''), '<[^>]*>', '', 'g')), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g')) AS tk,
  list_sort(list_distinct(regexp_extract_all(lower(coalesce(title, '')), '[a-z0-9]+'))) AS tw, list_sort(list_distinct(regexp_extract_all(lower(coalesce(abstract, '')), '[a-z0-9]+'))) AS aw FROM p)"""
_SAME_TITLE = "x.tk <> '' AND x.tk = y.tk AND x.id < y.id AND list_has_any(x.surnames, y.surnames)"
_PAIRS = {
    "d1_same_doi": "SELECT x.id AS a, y.id AS b FROM k x JOIN k y ON x.d = y.d AND x.id < y.id",
    "d2_same_title": f"SELECT x.id AS a, y.id AS b FROM k x JOIN k y ON {_SAME_TITLE} AND x.year = y.year",
    "d3_near_year": f"SELECT x.id AS a, y.id AS b FROM k x JOIN k y ON {_SAME_TITLE} AND abs(x.year - y.year) BETWEEN 1 AND 2",
    "d4_preprint": f"SELECT x.id AS a, y.id AS b FROM k x JOIN k y ON {_SAME_TITLE} AND x.d IS NOT NULL AND y.d IS NOT NULL AND starts_with(x.d, '10.48550/') <> starts_with(y.d, '10.48550/')",
}


def _likeness(a: str, b: str) -> str:
    return f"coalesce(CAST(len(list_intersect({a}, {b})) AS DOUBLE) / nullif(len({a}) + len({b}) - len(list_intersect({a}, {b})), 0), 0)"


def _near(rows: str, least: float) -> str:
    numbers = lambda x: f"list_filter({x}, lambda w: regexp_matches(w, '[0-9]'))"
    return f"""SELECT x.id AS a, y.id AS b, x.members AS a_members, y.members AS b_members, {_likeness("x.tw", "y.tw")} AS title_jaccard, {numbers("x.tw")} = {numbers("y.tw")} AS same_numbers, {_likeness("x.aw", "y.aw")} AS abstract_jaccard
        FROM {rows} x JOIN {rows} y ON x.surname = y.surname AND x.id < y.id AND abs(x.year - y.year) <= 2 WHERE {_likeness("x.tw", "y.tw")} >= {least}"""


_CLASSES = "c AS MATERIALIZED (SELECT surnames[1] AS surname, year, tw, aw, min(id) AS id, count(*) AS members FROM k WHERE len(surnames) > 0 AND len(tw) > 0 GROUP BY ALL)"


def _closure(pairs: str) -> str:
    return f"""l AS MATERIALIZED (SELECT a, b FROM ({pairs}) z UNION SELECT b, a FROM ({pairs}) z), r(id, seen) AS (SELECT id, id FROM k UNION SELECT r.id, l.b FROM r JOIN l ON l.a = r.seen), e AS MATERIALIZED (SELECT id, min(seen) AS entity FROM r GROUP BY id)"""


_ALL_PAIRS = " UNION ALL ".join([*(f"({x})" for x in _PAIRS.values()), f"(SELECT a, b FROM ({_near('(SELECT *, surnames[1] AS surname, 1 AS members FROM k WHERE len(surnames) > 0 AND len(tw) > 0)', 0.75)}) q WHERE same_numbers AND abstract_jaccard >= 0.5)"])
_ORDER = "(CASE WHEN d IS NOT NULL AND NOT starts_with(d, '10.48550/') THEN 0 ELSE 1 END, CASE WHEN venue IS NULL THEN 1 ELSE 0 END, -coalesce(citations, 0), k.id)"
_MERGE = f"WITH RECURSIVE {_RAW}, {_closure(_ALL_PAIRS)}, o AS MATERIALIZED (SELECT e.entity, k.*, row_number() OVER (PARTITION BY e.entity ORDER BY {_ORDER}) AS rk FROM k JOIN e ON e.id = k.id)"
_JSON_COLUMNS = "array_to_string(surnames, '|') AS surnames"
SQL = {name: f"WITH RECURSIVE {_RAW}, {_closure(pairs)} SELECT id, entity FROM e" for name, pairs in _PAIRS.items()}
SQL |= {
    "d5_near_duplicates": f"WITH {_RAW}, {_CLASSES} SELECT a, b, a_members, b_members, round(title_jaccard, 6) AS title_jaccard, round(abstract_jaccard, 6) AS abstract_jaccard FROM ({_near('c', 0.75)}) q WHERE same_numbers AND abstract_jaccard >= 0.5",
    "d7_candidate_report": f"""WITH {_RAW}, {_CLASSES} SELECT a, b, a_members, b_members, round(title_jaccard, 6) AS title_jaccard, round(abstract_jaccard, 6) AS abstract_jaccard,
        CASE WHEN title_jaccard < 0.75 THEN 'title' WHEN NOT same_numbers THEN 'numbers' WHEN abstract_jaccard < 0.5 THEN 'abstract' ELSE 'none' END AS blocked_by FROM ({_near('c', 0.6)}) q WHERE title_jaccard < 1""",
    "d8_survivors": f"{_MERGE} SELECT entity, max(CASE WHEN rk = 1 THEN id END) AS survivor, count(*) AS n FROM o GROUP BY entity",
    "d9_field_merge": f"""{_MERGE}, f AS (SELECT entity, u.ref, min(rk * 10 + u.i) AS place FROM (SELECT entity, rk, unnest(list_zip(refs, range(len(refs)))) AS z FROM o) v, LATERAL (SELECT z[1] AS ref, z[2] AS i) u GROUP BY entity, u.ref)
        SELECT o.entity, first(id ORDER BY rk) AS survivor, first(doi ORDER BY rk) FILTER (doi IS NOT NULL) AS doi, first(title ORDER BY rk) FILTER (title IS NOT NULL) AS title, first(year ORDER BY rk) FILTER (year IS NOT NULL) AS year,
          first(venue ORDER BY rk) FILTER (venue IS NOT NULL) AS venue, max(citations) AS citations, bool_or(reviewed) AS reviewed, count(*) - 1 AS n_merged, any_value(g.refs) AS refs
        FROM o JOIN (SELECT entity, string_agg(CAST(ref AS VARCHAR), ',' ORDER BY place) AS refs FROM f GROUP BY entity) g ON g.entity = o.entity GROUP BY o.entity""",
    "d10_entities": f"WITH RECURSIVE {_RAW}, {_closure(_ALL_PAIRS)} SELECT id, entity FROM e",
    "s1_seed_scan": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation WHERE lower(n_name) LIKE '%tion^_1%' ESCAPE '^' ORDER BY n_nationkey LIMIT 5",
    "s5_source_resolver": "SELECT * FROM (VALUES ('seed', true, 'seed'), ('live', true, 'live'), ('auto', true, 'live'), ('auto', false, 'seed')) s(setting, available, source) JOIN (SELECT 'seed' AS source, count(*) AS n FROM region UNION ALL SELECT 'live', count(*) FROM nation) USING (source)",
    "s7_provider_a": f"""WITH {_RAW}, w AS (SELECT *, (regexp_extract_all(lower(coalesce(abstract, '')), '[a-z]+'))[:12] AS few FROM k)
        SELECT id, d AS doi, title, year, venue, citations, {_JSON_COLUMNS}, array_to_string(list_transform(refs, lambda r: 'W' || r), '|') AS refs, CASE WHEN len(few) > 0 THEN CAST(length(array_to_string(few, ' ')) AS BIGINT) END AS abstract_length FROM w""",
    "s8_provider_b": f"""WITH {_RAW} SELECT id, d AS doi, title, year, venue, citations, {_JSON_COLUMNS}, array_to_string(list_transform(refs, lambda r: 'W' || r), '|') AS refs, CAST(length(abstract[:40]) AS BIGINT) AS abstract_length
        FROM k WHERE coalesce(citations % 10 <> 3, true)""",
    "s10_corpus_claims": f"""WITH {_RAW}, c AS (SELECT id, unnest(surnames) AS claim, generate_subscripts(surnames, 1) - 1 AS place FROM k WHERE reviewed = (citations % 3 = 0) AND year <> 2003)
        SELECT id || ':' || place AS claim_id, id AS paper, CAST(place AS BIGINT) AS place, claim FROM c""",
    "s12_stores": "SELECT CASE WHEN a.label % 2 = 0 THEN 'supports' ELSE 'contradicts' END AS relationship, count(*) AS n, CAST(sum(len(a.embedding) + len(b.embedding)) AS BIGINT) AS components FROM embeddings a JOIN embeddings b ON b.vec_id = a.vec_id + 1 GROUP BY 1",
    "s16_cite_keys": r"""
        WITH f AS (SELECT doc_id, nullif(regexp_extract(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]{4,}'), '') AS family FROM documents),
        u AS (SELECT doc_id, lower(regexp_replace(strip_accents(replace(replace(replace(replace(replace(replace(coalesce(family, ''), 'ü', 'ue'), 'ö', 'oe'), 'ä', 'ae'), 'Ü', 'Ue'), 'Ö', 'Oe'), 'Ä', 'Ae')), '[^A-Za-z]', '', 'g')) AS fam FROM f),
        b AS (SELECT doc_id, CASE WHEN fam <> '' AND doc_id % 9 <> 0 THEN fam || (2000 + doc_id % 4) ELSE 'record' || doc_id END AS base FROM u),
        n AS (SELECT doc_id, base, row_number() OVER (PARTITION BY base ORDER BY doc_id) - 1 AS later FROM b)
        SELECT doc_id, base || s AS cite_key, '@article{' || base || s || ',' AS line FROM (SELECT doc_id, base, CASE WHEN later = 0 THEN '' WHEN later <= 26 THEN chr(CAST(96 + later AS INTEGER)) ELSE '-' || (later + 1) END AS s FROM n) x""",
    "s17_snapshot": f"WITH {_RAW} SELECT coalesce(venue, 'none') AS library, count(*) AS n, count(*) AS listed, CAST(sum(citations) AS BIGINT) AS citations, min(id) AS first FROM k GROUP BY 1",
    "s21_slim": f"WITH {_RAW} SELECT id, doi, year, venue, citations, CAST(len(refs) AS BIGINT) AS n_refs FROM k",
}
