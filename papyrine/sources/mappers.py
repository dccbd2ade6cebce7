"""Records of two providers' JSON as papers (S7, S8): ``id, doi, title, year, surnames, venue, citations, refs, abstract``.

Records that are not JSON, or have no id or title, are left out; fields that are missing are null, lists that are missing are empty.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from papyrine.operators.dedup import normal_doi

A = """id string, doi string, display_name string, title string, publication_year long, primary_location struct<source: struct<display_name: string>>,
  authorships array<struct<author: struct<display_name: string>>>, cited_by_count long, referenced_works array<string>, abstract_inverted_index map<string, array<int>>"""
B = """paperId string, externalIds struct<DOI: string>, title string, year long, venue string, authors array<struct<name: string>>, citationCount long,
  references array<struct<paperId: string>>, abstract string"""


def tail(url: Column) -> Column:
    """What comes after the last slash."""
    return F.regexp_extract(url, "([^/]*)$", 1)


def surname(name: Column) -> Column:
    """Of "Last, First" what is before the comma, of "First Last" the last word; lower case."""
    return F.lower(F.trim(F.when(F.contains(name, F.lit(",")), F.substring_index(name, ",", 1)).otherwise(F.substring_index(F.trim(name), " ", -1))))


def uninverted(index: Column) -> Column:
    """the text of an inverted index, words in the order of their places; null without words."""
    places = F.flatten(F.transform(F.map_entries(index), lambda e: F.transform(e["value"], lambda i: F.struct(i.alias("i"), e["key"].alias("w")))))
    return F.nullif(F.array_join(F.transform(F.array_sort(places), lambda x: x["w"]), " "), F.lit(""))


def _list(values: Column) -> Column:
    return F.coalesce(F.filter(values, lambda x: x.isNotNull()), F.array().cast("array<string>"))


def _usable(mapped: DataFrame) -> DataFrame:
    return mapped.where("id IS NOT NULL AND id <> '' AND title IS NOT NULL")


def provider_a(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Titles fall back to the second field for them, ids and references are the ends of addresses, the text is an inverted index."""
    r = rows.select(F.from_json(raw, A).alias("r")).select("r.*")
    return _usable(r.select(
        tail(F.col("id")).alias("id"), normal_doi(F.col("doi")).alias("doi"), F.coalesce("display_name", "title").alias("title"), F.col("publication_year").alias("year"),
        _list(F.transform("authorships", lambda a: surname(a["author"]["display_name"]))).alias("surnames"), F.nullif(F.col("primary_location.source.display_name"), F.lit("")).alias("venue"),
        F.coalesce("cited_by_count", F.lit(0)).alias("citations"), _list(F.transform("referenced_works", tail)).alias("refs"), uninverted(F.col("abstract_inverted_index")).alias("abstract"),
    ))


def provider_b(rows: DataFrame, raw: str = "raw") -> DataFrame:
    """Flat names and references by id; an empty venue is none."""
    r = rows.select(F.from_json(raw, B).alias("r")).select("r.*")
    return _usable(r.select(
        F.col("paperId").alias("id"), normal_doi(F.col("externalIds.DOI")).alias("doi"), "title", "year", _list(F.transform("authors", lambda a: surname(a["name"]))).alias("surnames"), F.nullif(F.col("venue"), F.lit("")).alias("venue"),
        F.coalesce("citationCount", F.lit(0)).alias("citations"), _list(F.transform("references", lambda x: x["paperId"])).alias("refs"), "abstract",
    ))
