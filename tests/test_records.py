"""Merge rules, mappers, sources, batches, PDF files and search over small tables that can be checked by hand."""

import random

import pytest
from pyspark.sql import functions as F

from papyrine.functions import text
from papyrine.operators import dedup, folds, search
from papyrine.sources import mappers, pdf, resolver
from papyrine.streaming import batches

PAPER = "id string, doi string, title string, year long, surnames array<string>, venue string, citations long, reviewed boolean, refs array<long>, abstract string"


def paper(i, title="A long title of work", doi=None, year=2000, surnames=("li",), venue=None, citations=0, reviewed=False, refs=(), abstract="some words"):
    return (i, doi, title, year, list(surnames) if surnames is not None else None, venue, citations, reviewed, list(refs) if refs is not None else None, abstract)


def groups(papers, links):
    found = {}
    for r in dedup.entities(papers, links).collect():
        found.setdefault(r["entity"], set()).add(r["id"])
    return sorted(map(sorted, found.values()))


def test_rules_of_identifiers_titles_years_and_preprints(spark):
    rows = [
        paper("a", doi="https://doi.org/10.1/X", title="One"), paper("b", doi="DOI:10.1/x", title="Two", surnames=("wu",)), paper("c", doi=" ", title="Three", surnames=None), paper("d", doi=None, title="Four", surnames=()),
        paper("e", title="Über <b>x</b>!", year=2001, surnames=("li", "wu")), paper("f", title="uber x", year=2001, surnames=("wu",)), paper("g", title="uber x", year=2003, surnames=("wu", "ng")), paper("h", title="uber x", year=2004, surnames=("ng",)),
        paper("i", title="uber x", year=2007, surnames=("ng",)), paper("j", title="Same", doi="10.48550/1", year=1990, surnames=("oh",)), paper("k", title="same", doi="10.2/2", year=2010, surnames=("oh",)), paper("l", title="same", doi="10.2/3", year=2015, surnames=("oh",)), paper("m", title=None, year=None),
    ]
    df = spark.createDataFrame(rows, PAPER)
    of = lambda rule: [g for g in groups(df, rule(df)) if len(g) > 1]
    assert of(dedup.by_doi) == [["a", "b"]]
    assert of(dedup.by_title_and_year) == [["e", "f"]]
    assert of(dedup.by_title_near_year) == [["e", "f", "g", "h"]]
    assert of(dedup.by_preprint) == [["j", "k", "l"]]
    assert dedup.links(df.limit(0)).count() == 0


def test_near_duplicates_equal_all_pairs(spark):
    rng = random.Random(3)
    rows = []
    for i in range(80):
        words = [rng.choice(["alpha", "beta", "gamma", "delta", "7", "8"]) for _ in range(rng.randint(1, 7))]
        rows.append(paper(f"p{i:02d}", title=" ".join(words), year=2000 + rng.randrange(5), surnames=(rng.choice("xyz"),), abstract=" ".join(rng.choice("abcdef") for _ in range(rng.randint(0, 5)))))
    df = spark.createDataFrame(rows + rows[:5], PAPER).dropDuplicates(["id"])

    def words_of(t):
        return set(t.split())

    def like(a, b):
        return len(a & b) / len(a | b) if a | b else 0.0

    def near(x, y):
        a, b = words_of(x[2]), words_of(y[2])
        return x[4][0] == y[4][0] and abs(x[3] - y[3]) <= 2 and like(a, b) >= 0.75 and {w for w in a if w.isdigit()} == {w for w in b if w.isdigit()} and like(words_of(x[9]), words_of(y[9])) >= 0.5

    classes = {}
    for r in rows:
        classes.setdefault((r[4][0], r[3], frozenset(words_of(r[2])), frozenset(words_of(r[9]))), r)
    reps = list(classes.values())
    want = sorted((x[0], y[0]) for x in reps for y in reps if x[0] < y[0] and near(x, y))
    assert sorted((r["a"], r["b"]) for r in dedup.near_duplicates(df).collect()) == want and want
    reported = dedup.candidate_report(df).collect()
    assert {r["blocked_by"] for r in reported} <= {"title", "numbers", "abstract", "none"} and all(0.6 <= r["title_jaccard"] < 1 for r in reported)


def test_survivors_and_merged_fields(spark):
    rows = [
        paper("a", doi="10.48550/1", venue="v", citations=9, refs=(3, 1), reviewed=True), paper("b", doi="10.2/2", venue=None, citations=5, year=None, refs=(1, 2, 1)), paper("c", doi="10.2/3", venue="w", citations=5, refs=None), paper("d", doi="10.2/4", venue="w", citations=7, refs=(8,)),
    ]
    df = spark.createDataFrame(rows, PAPER)
    entity = spark.createDataFrame([(x, "a") for x in "abcd"], "id string, entity string")
    assert tuple(dedup.survivors(df, entity).first()) == ("a", "d", 4)
    r = dedup.merged(df, entity).first()
    assert (r["survivor"], r["doi"], r["year"], r["venue"], r["citations"], r["reviewed"], r["n_merged"]) == ("d", "10.2/4", 2000, "w", 9, True, 3)
    assert r["refs"] == [8, 1, 2, 3]


def test_mappers_of_broken_and_thin_records(spark):
    a = ['{"id": "https://x/W1", "title": "T", "abstract_inverted_index": {"b": [1, 3], "a": [0, 2]}, "authorships": [{"author": {"display_name": "Ann Li"}}, {"author": null}]}', '{"id": "W2"}', "no json", None, '{"id": "W3", "display_name": "D", "title": "T"}']
    got = mappers.provider_a(spark.createDataFrame([(x,) for x in a], "raw string")).orderBy("id").collect()
    assert [(r["id"], r["title"], r["abstract"], r["surnames"], r["refs"], r["citations"]) for r in got] == [("W1", "T", "a b a b", ["li"], [], 0), ("W3", "D", None, [], [], 0)]
    b = ['{"paperId": "p", "title": "T", "venue": "", "authors": [{"name": "Li, Ann"}], "references": [{"paperId": null}, {"paperId": "q"}], "externalIds": {"DOI": "10.1/A"}}', '{"title": "x"}', "{"]
    got = mappers.provider_b(spark.createDataFrame([(x,) for x in b], "raw string")).collect()
    assert [(r["id"], r["doi"], r["surnames"], r["venue"], r["refs"]) for r in got] == [("p", "10.1/a", ["li"], None, ["q"])]


def test_resolver_reads_one_source():
    no = lambda: pytest.fail("the other source was read")
    assert resolver.resolve("seed", lambda: 1, no, True) == ("seed", 1) and resolver.resolve("live", no, lambda: 2, True) == ("live", 2)
    assert resolver.resolve("auto", no, lambda: 2, True) == ("live", 2) and resolver.resolve("auto", lambda: 1, no, False) == ("seed", 1)
    for setting, there in (("other", True), ("live", False)):
        with pytest.raises(ValueError):
            resolver.resolve(setting, no, no, there)


def test_batches_survive_repeats(spark, tmp_path):
    rows = spark.createDataFrame([(1, 1, 2.0), (1, 2, 3.0), (2, 3, 4.0), (3, 4, 5.0)], "batch long, request long, cost double")
    answers = rows.withColumn("answer", F.col("cost") > 2)
    store = batches.Batches(spark, f"file://{tmp_path}/b")
    assert store.state().count() == 0
    store.submit(rows.where("batch < 3"))
    store.collect(answers)  # batch 3 was never submitted
    for _ in range(2):
        batches.Batches(spark, store.path).submit(rows.where("batch < 3"))
        batches.Batches(spark, store.path).collect(answers)
    assert sorted(map(tuple, store.state().collect())) == [(1, 2, 2, 1, 5.0), (2, 1, 1, 1, 4.0)]


def test_widening_stops():
    class Tier:
        def __init__(self, n):
            self.n = n

        def count(self):
            return self.n

    assert batches.widen([Tier(3), Tier(4), Tier(9)], 5, 9) == [(0, True, 3, 3, "searching"), (1, True, 4, 7, "searching"), (2, False, 0, 7, "enough")]
    assert [r[4] for r in batches.widen([Tier(1)] * 3, 5, 2)] == ["searching", "searching", "budget"]


def test_pdf_round_trip_and_other_files():
    for deflate in (False, True):
        lines = ["Plain (text) with \\ signs", "é — second", ""]
        assert pdf.text_of(pdf.file_of(lines, deflate)) == "\n".join(lines[:2])
    assert pdf.text_of(b"") == pdf.text_of(b"not a pdf") == ""
    assert pdf.text_of(b"<< /Length 9 >>\nstream\nBT <48 65> Tj (l\\154o) Tj ET\nendstream") == "Hello"


def test_round_robin_passes_over_what_is_too_dear(spark):
    rows = [("r", "a", 1, 5.0), ("r", "a", 2, 6.0), ("r", "b", 3, 4.0), ("r", "b", 4, 9.0), ("r", "c", 5, 20.0), ("r", "c", 6, 99.0)]
    df = spark.createDataFrame(rows, "run string, library string, item long, cost double")
    got = folds.round_robin(df, 3, 20.0).orderBy("place").collect()
    assert [r["item"] for r in got] == [1, 3, 2]


def test_text_keys(spark):
    one = lambda c, t: spark.range(1).select(F.lit(t).cast("string").alias("t")).select(c.alias("x")).first().x
    t = F.col("t")
    assert one(text.title_key(t), "<i>Ünï</i>—Cödé ﬁ x² ß") == "uni code fi x2" or one(text.title_key(t), "<i>Ünï</i>—Cödé ﬁ x² ß") == "unicode fi x2"
    assert one(text.title_key(t), None) is None
    assert one(text.capped(t, 10), "one two three") == "one two..." and one(text.capped(t, 99), "one") == "one" and one(text.capped(t, 4), "abcdefg") == "abcd..."
    assert one(text.atoms(t, ["is"]), "We (1) go far away, (2) come back home.") == ["go far away", "come back home"]
    assert one(text.atoms(t, ["is"]), "this is good; that is bad") == ["this is good", "that is bad"] and one(text.atoms(t, ["is"]), "a; b") == ["a; b"]
    assert one(text.redacted(t), "to a.b@c.org api_key = xyz, sk-abcdefghijklmnop") == "to [e-mail] api_key = [secret], [secret]"


def test_search_of_small_libraries(spark):
    language = search.Language((("s", 3),), ("the",), {"cars": ("automobile",)})
    rows = [(i, "finding" if i == 3 else "paper", f"Fair model {i}", "fairness of the models and automobile parity") for i in range(4)] + [(9, "paper", None, None), (10, "paper", "", "")]
    docs = spark.createDataFrame(rows, "doc long, kind string, title string, text string")
    index = search.stored(docs, language, "small")
    asked = spark.createDataFrame([(1, "models"), (2, "cars"), (3, "zebra quark"), (4, ""), (5, None), (6, "the fairn"), (7, "parity parity")], "q long, text string")
    weighted, known = search.vectors(asked, index, language)
    found = search.hits(weighted, index)
    verdict = {r["q"]: r["verdict"] for r in search.verdicts(weighted, known, found, index).collect()}
    assert verdict == {1: "in_domain", 2: "in_domain", 3: "out_of_domain", 4: "empty", 5: "empty", 6: "in_domain", 7: "in_domain"}
    best = search.ranked(found, 2).where("q = 7").orderBy("place").collect()
    assert len(best) == 3 and [r["place"] for r in best] == [1, 2, 3]
    weighted, known = search.vectors(asked, index, language, True)
    typed = {r["q"]: r["verdict"] for r in search.verdicts(weighted, known, search.hits(weighted, index), index, True).collect()}
    assert typed[6] == "typing" and typed[3] == "out_of_domain"
    empty = search.stored(docs.limit(0), language, "none")
    assert empty.n == 0 and search.hits(weighted, empty).count() == 0
