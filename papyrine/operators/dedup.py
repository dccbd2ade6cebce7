"""Merge rules for bibliographic records (D1-D10): links of exact and near duplicates, survivors, merged fields.

Records have ``id, doi, title, year, surnames, venue, citations, reviewed, refs, abstract``;
the two last but one and ``surnames`` are arrays. A rule links every record
to the first one that it agrees with instead of all of them, so that a group
of n copies gives about n links; what the links connect is the same.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from papyrine.functions.text import title_key
from papyrine.operators.components import connected_components
from papyrine.operators.sets import similar_sets
from papyrine.shared import keep

# What is taken off an identifier, the registrant of preprints, years between versions, the thresholds of near duplicates and of the report.
DOI_PREFIXES = "^(https?://(dx[.])?doi[.]org/|doi:)"
PREPRINT = "10.48550/"
YEARS, TITLE_NEAR, ABSTRACT_NEAR, TITLE_REPORTED = 2, 0.75, 0.5, 0.6


def normal_doi(doi: Column) -> Column:
    """An identifier without address and case; null if nothing is left."""
    return F.nullif(F.regexp_replace(F.lower(F.trim(doi)), DOI_PREFIXES, ""), F.lit(""))


def is_preprint(doi: Column) -> Column:
    return F.coalesce(normal_doi(doi).startswith(PREPRINT), F.lit(False))


def words_of(text: Column) -> Column:
    return F.array_sort(F.array_distinct(F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit("[a-z0-9]+"), F.lit(0))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays without repeats; 0 if both are empty."""
    common = F.size(F.array_intersect(a, b))
    return F.coalesce(common / F.nullif(F.size(a) + F.size(b) - common, F.lit(0)), F.lit(0.0))


def _to_first(rows: DataFrame, keys: list[str], rule: str) -> DataFrame:
    """``a, b, rule``: each record of a key and the key's first one."""
    first = rows.groupBy(*keys).agg(F.min("id").alias("a"), F.count("*").alias("n")).where("n > 1")
    return rows.join(first, keys).where("id <> a").select("a", F.col("id").alias("b"), F.lit(rule).alias("rule"))


def by_doi(papers: DataFrame) -> DataFrame:
    """The same normalised identifier. Records without one are linked to nothing."""
    return _to_first(papers.select("id", normal_doi(F.col("doi")).alias("doi")).where("doi IS NOT NULL"), ["doi"], "same_doi")


def _named(papers: DataFrame) -> DataFrame:
    """A row for each surname of a record with a title."""
    keyed = papers.select("id", "doi", "year", title_key(F.col("title")).alias("title"), F.explode(F.array_distinct("surnames")).alias("surname"))
    return keyed.where("title <> '' AND surname IS NOT NULL")


def by_title_and_year(papers: DataFrame) -> DataFrame:
    """The same title and year and a surname in common."""
    return _to_first(_named(papers).where("year IS NOT NULL").select("id", "title", "year", "surname"), ["title", "year", "surname"], "same_title").distinct()


def by_title_near_year(papers: DataFrame) -> DataFrame:
    """D3: the same title, a surname in common, one or two years apart: each record and the first one of such a year."""
    rows = _named(papers).where("year IS NOT NULL").select("id", "title", "surname", "year")
    firsts = rows.groupBy("title", "surname", "year").agg(F.min("id").alias("first"))
    gaps = [k for k in range(-YEARS, YEARS + 1) if k]
    near = firsts.select("title", "surname", "first", F.explode(F.array(*(F.col("year") + k for k in gaps))).alias("year"))
    return rows.join(near, ["title", "surname", "year"]).select(F.least("id", "first").alias("a"), F.greatest("id", "first").alias("b"), F.lit("near_year").alias("rule")).distinct()


def by_preprint(papers: DataFrame) -> DataFrame:
    """The same title and a surname in common, one identifier of a preprint and one of another kind, whatever the years."""
    rows = _named(papers).withColumn("preprint", is_preprint(F.col("doi"))).where(normal_doi(F.col("doi")).isNotNull()).select("id", "title", "surname", "preprint")
    of = lambda kind: F.min(F.when(F.col("preprint") == kind, F.col("id")))
    firsts = rows.groupBy("title", "surname").agg(of(True).alias("first_preprint"), of(False).alias("first_other")).where("first_preprint IS NOT NULL AND first_other IS NOT NULL")
    other = F.when(F.col("preprint"), F.col("first_other")).otherwise(F.col("first_preprint"))
    return rows.join(firsts, ["title", "surname"]).select(F.least("id", other).alias("a"), F.greatest("id", other).alias("b"), F.lit("preprint").alias("rule")).distinct()


def _keyed(papers: DataFrame, *more: str) -> DataFrame:
    """Records with what D5 looks at: first surname, year, words of the title, a digest of those of the abstract and whether there are any; ``more`` columns beside it."""
    found = words_of(F.col("abstract"))
    return papers.select("id", F.get("surnames", 0).alias("surname"), F.col("year").cast("long").alias("year"), words_of(F.col("title")).alias("words"), F.sha2(F.array_join(found, " "), 256).alias("digest"), (F.size(found) > 0).alias("worded"), *more)


def _classes(keyed: DataFrame) -> tuple[DataFrame, DataFrame]:
    """``id, t, year, members, worded`` of records that agree in first surname, year, title and abstract, and ``block, t, words`` of the titles of a surname.

    Both are named by the first record (``members`` says how many there are).
    """
    rows = keyed.where("surname IS NOT NULL AND year IS NOT NULL AND size(words) > 0")
    one = keep(rows.groupBy("surname", "year", "words", "digest", "worded").agg(F.min("id").alias("id"), F.count("*").alias("members")), "classes")
    titles = keep(one.groupBy(F.col("surname").alias("block"), "words").agg(F.min("id").alias("t")), "titles")
    of_title = one.withColumnRenamed("surname", "block").join(titles, ["block", "words"]).select("id", "t", "year", "members", "worded")
    return keep(of_title, "of-title"), titles


def _sided(pairs: DataFrame, one: DataFrame) -> DataFrame:
    """Pairs ``a, b`` of classes at most ``YEARS`` apart, with their members."""
    side = lambda x: one.select(F.col("id").alias(x), *(F.col(c).alias(f"{x}_{c}") for c in ("year", "members", "worded")))
    return pairs.join(side("a"), "a").join(side("b"), "b").where(F.abs(F.col("a_year") - F.col("b_year")) <= YEARS)


def _alike(one: DataFrame, titles: DataFrame, least: float) -> DataFrame:
    """Pairs of classes with the same first surname, years at most two apart and titles that are not the same but of Jaccard similarity ``least`` or more."""
    hashed = keep(titles.select("block", F.col("t").alias("id"), F.transform("words", lambda w: F.xxhash64(w)).alias("set")), "title-sets")
    words = lambda x: titles.select(F.col("t").alias(x), F.col("words").alias(f"{x}_words"))
    numbers = lambda x: F.filter(f"{x}_words", lambda w: w.rlike("[0-9]"))
    like = jaccard(F.col("i_words"), F.col("j_words"))
    found = similar_sets(hashed, least).join(words("i"), "i").join(words("j"), "j").select("i", "j", like.alias("title_jaccard"), (numbers("i") == numbers("j")).alias("same_numbers")).where(F.col("title_jaccard") >= least)
    ids = lambda t, x: one.select(F.col("t").alias(t), F.col("id").alias(x))
    pairs = found.join(ids("i", "x"), "i").join(ids("j", "y"), "j").select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), "title_jaccard", "same_numbers")
    return keep(_sided(pairs, one), "alike")


def _sets_of(papers: DataFrame, ids: DataFrame) -> DataFrame:
    """``id, set``: the digests of the abstract's words of some records."""
    rows = papers.select("id", "abstract").join(ids.distinct(), "id", "left_semi")
    return keep(rows.select("id", F.transform(words_of(F.col("abstract")), lambda w: F.xxhash64(w)).alias("set")), "abstract-sets")


def _compared(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """Pairs with the similarity of their abstracts."""
    own = lambda x: sets.select(F.col("id").alias(x), F.col("set").alias(f"{x}_set"))
    like = F.coalesce(jaccard(F.col("a_set"), F.col("b_set")), F.lit(0.0))
    return pairs.join(own("a"), "a", "left").join(own("b"), "b", "left").withColumn("abstract_jaccard", like).drop("a_set", "b_set")


_MEASURED = ("a", "b", "a_members", "b_members", "title_jaccard", "same_numbers", "abstract_jaccard")


def blocked_by() -> Column:
    """The first condition of D5 that a pair fails, in their order; null if it fails none."""
    return F.when(F.col("title_jaccard") < TITLE_NEAR, "title").when(~F.col("same_numbers"), "numbers").when(F.col("abstract_jaccard") < ABSTRACT_NEAR, "abstract")


def near_duplicates(papers: DataFrame, keyed: DataFrame | None = None) -> DataFrame:
    """Pairs that fail no condition, between the first records of equal ones; ``keyed`` are the rows of :func:`_keyed` if they are there.

    Classes of one title are joined by their abstracts (:func:`similar_sets`), so
    that a title which many texts share costs a comparison of signatures a pair and no row.
    Words of abstracts are compared by 64-bit digests.
    """
    one, titles = _classes(_keyed(papers) if keyed is None else keyed)
    others = _alike(one, titles, TITLE_NEAR).where("same_numbers AND a_worded AND b_worded")
    shared = one.where("worded").groupBy("t").agg(F.count("*").alias("n")).where("n > 1").select("t")
    same = keep(one.where("worded").join(shared, "t", "left_semi").select("t", "id"), "same-title")
    sets = _sets_of(papers, same.select("id").union(others.select("a")).union(others.select("b")))
    blocks = keep(sets.join(same, "id").select(F.col("t").alias("block"), "id", "set"), "title-blocks")
    found = similar_sets(blocks, ABSTRACT_NEAR).select(F.col("i").alias("a"), F.col("j").alias("b"), F.lit(1.0).alias("title_jaccard"), F.lit(True).alias("same_numbers"), F.col("like").alias("abstract_jaccard"))
    return _sided(found, one).select(*_MEASURED).unionByName(_compared(others, sets).where(blocked_by().isNull()).select(*_MEASURED))


def candidate_report(papers: DataFrame) -> DataFrame:
    """Pairs whose titles are alike but not the same, with the condition that keeps them apart."""
    one, titles = _classes(_keyed(papers))
    pairs = _alike(one, titles, TITLE_REPORTED)
    sets = _sets_of(papers, pairs.where("a_worded AND b_worded").select(F.explode(F.array("a", "b")).alias("id")))
    return _compared(pairs, sets).select(*_MEASURED).withColumn("blocked_by", F.coalesce(blocked_by(), F.lit("none")))


def links(papers: DataFrame) -> DataFrame:
    """All links ``a, b, rule`` of D1 to D5. Records that agree in all that D5 looks at are linked to the first of them as well."""
    slim = keep(_keyed(papers, "doi", "title", "surnames"), "slim")
    same = slim.where("surname IS NOT NULL AND year IS NOT NULL AND size(words) > 0 AND worded").select("id", "surname", "year", "words", "digest")
    rules = [by_doi(slim), by_title_and_year(slim), by_title_near_year(slim), by_preprint(slim), _to_first(same, ["surname", "year", "words", "digest"], "near"), near_duplicates(papers, slim).select("a", "b", F.lit("near").alias("rule"))]
    return reduce(DataFrame.unionByName, rules)


def _order() -> Column:
    """Identifiers other than a preprint's first, then a venue, then citations, then the id."""
    published = normal_doi(F.col("doi")).isNotNull() & ~is_preprint(F.col("doi"))
    return F.struct((~published).alias("p"), F.col("venue").isNull().alias("v"), (-F.coalesce("citations", F.lit(0))).alias("c"), F.col("id").alias("i"))


def entities(papers: DataFrame, found: DataFrame) -> DataFrame:
    """``id, entity``: every record, and the smallest id of what the links ``found`` connect it to."""
    return papers.select("id").join(connected_components(found, "a", "b").withColumnRenamed("node", "id"), "id", "left").select("id", F.coalesce("component", "id").alias("entity"))


def survivors(papers: DataFrame, entity: DataFrame) -> DataFrame:
    """``entity, survivor, n``: the record of each entity that the order of D8 puts first."""
    return papers.join(entity, "id").groupBy("entity").agg(F.min_by("id", _order()).alias("survivor"), F.count("*").alias("n"))


def merged(papers: DataFrame, entity: DataFrame) -> DataFrame:
    """One record for each entity. A field is that of the first record in the survivor's order that has it; citations
    are the largest, ``reviewed`` is true if any is, references come in the order in which they are first met. ``n_merged`` counts the other
    records; who they are is ``entity`` itself, so that no row holds a list of them.
    """
    rows = papers.join(entity, "id").withColumn("order", _order())
    filled = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("order"))).alias(c)
    fields = rows.groupBy("entity").agg(F.min_by("id", "order").alias("survivor"), *map(filled, ("doi", "title", "year", "venue")), F.max("citations").alias("citations"), F.coalesce(F.bool_or("reviewed"), F.lit(False)).alias("reviewed"), (F.count("*") - 1).alias("n_merged"))
    cited = rows.select("entity", "order", F.posexplode("refs").alias("place", "ref")).where("ref IS NOT NULL")
    refs = cited.groupBy("entity", "ref").agg(F.min(F.struct("order", "place")).alias("first")).groupBy("entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "ref"))), lambda x: x["ref"]).alias("refs"))
    return fields.join(refs, "entity", "left").withColumn("refs", F.coalesce("refs", F.array().cast(papers.schema["refs"].dataType)))
