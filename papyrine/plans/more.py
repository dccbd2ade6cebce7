"""Queries of every kind with SQL of their own: sets U2 and U8, samples W10 to W16, X2 and X8, scorers R2 to R9, validation V1 to V18, labels K2 to K8, coherence C1 to C6, batches T2 to T5, texts F1 to F37, sources S2, S19, S20 and X21."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from papyrine.functions import text as texts
from papyrine.operators import folds, near, ranks
from papyrine.plans import aggregates, dialect, relations
from papyrine.plans.claims import claims, items
from papyrine.shared import keep, new_path
from papyrine.sources import pdf, rest
from papyrine.streaming import batches


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def _hash(*columns: str, seed: int = 7):
    """A digest of ids and a seed: the draw that stands for a random one."""
    return F.sha2(F.concat_ws("|", *(F.col(c).cast("string") for c in columns), F.lit(str(seed))), 256)


def _sha(*columns: str, seed: int = 7) -> str:
    return "sha256(concat_ws('|', " + ", ".join(f"CAST({c} AS VARCHAR)" for c in columns) + f", '{seed}'))"


# --- sets -----------------------------------------------------------------------------------------------------------


def u2_stable_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Return flags and then line states of each supplier, each where it is first met."""
    rows = _read(spark, sf_dir, "lineitem")
    lists = rows.select("l_suppkey", F.explode(F.array(F.struct(F.lit(0).alias("part"), F.col("l_returnflag").alias("v")), F.struct(F.lit(1).alias("part"), F.col("l_linestatus").alias("v")))).alias("x"), "l_orderkey", "l_linenumber")
    first = lists.groupBy("l_suppkey", "x.v").agg(F.min(F.struct("x.part", "l_orderkey", "l_linenumber")).alias("place"))
    return first.groupBy(F.col("l_suppkey").alias("k")).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "v"))), lambda x: x["v"]), ",").alias("items"))


def u8_append_only(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each user's old list against a new one from which some events are gone: places that no longer agree."""
    rows = _read(spark, sf_dir, "events").select("user_id", "event_id", "ts")
    place = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id")).alias("place")
    old = rows.where("ts < TIMESTAMP '2024-01-15 00:00:00'").select("user_id", "event_id", place)
    new = rows.where("event_id % 97 <> 0").select("user_id", F.col("event_id").alias("now"), place)
    both = old.join(new, ["user_id", "place"], "left")
    return both.groupBy("user_id").agg(F.count("*").alias("old_rows"), F.sum((~F.col("event_id").eqNullSafe(F.col("now"))).cast("long")).alias("violations")).withColumn("append_only", F.col("violations") == 0)


# --- places and totals ----------------------------------------------------------------------------------------------


def p11_tier_and_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by ladders over a score, its tier, and the place among all."""
    score = F.round(F.col("n_chars") / (F.col("n_chars") + 2000.0), 6)
    rows = _read(spark, sf_dir, "documents").select("doc_id", "lang", score.alias("score"))
    tier = F.when(F.col("score") >= 0.60, "high").when(F.col("score") >= 0.35, "medium").otherwise("low")
    strength = F.when((F.col("lang") == "en") & (F.col("score") >= 0.60), "strong").when(F.col("score") >= 0.35, "likely").otherwise("lead")
    return ranks.numbered(rows, [F.desc("score"), F.col("doc_id")]).select("doc_id", "score", tier.alias("tier"), strength.alias("strength"), "place")


def w5_running_total(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What purchases have cost up to each, and what is left of a budget."""
    rows = _read(spark, sf_dir, "events").where("event_type = 'purchase'").select("event_id", "ts", "value")
    spent = ranks.running(rows, [F.col("ts"), F.col("event_id")], "value", "spent")
    return spent.select("event_id", F.round("spent", 4).alias("spent"), F.round(100000 - F.col("spent"), 4).alias("headroom"))


def w12_precision_at_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The share of good ones among the K highest and the K newest."""
    rows = _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels"), "doc_id").select("doc_id", "n_chars", F.col("quality").cast("double").alias("hit"))
    found = []
    for name, order in (("by_score", [F.desc("n_chars"), F.col("doc_id")]), ("by_age", [F.desc("doc_id")])):
        top = rows.orderBy(*order).limit(100).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # a hundred rows
        found.append(top.agg(*(F.round(F.avg(F.when(F.col("place") <= k, F.col("hit"))), 6).alias(str(k)) for k in (10, 50, 100))).select(F.explode(F.array(*(F.struct(F.lit(k).alias("k"), F.col(str(k)).alias(name)) for k in (10, 50, 100)))).alias("x")).select("x.*"))
    return found[0].join(found[1], "k")


# --- samples and allocation -----------------------------------------------------------------------------------------


def w10_round_robin(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders of a priority, the libraries being customer segments by turns: so many a run under a budget, those too dear are passed over."""
    rows = _read(spark, sf_dir, "orders").join(_read(spark, sf_dir, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    items_ = rows.select(F.col("o_orderpriority").alias("run"), F.col("c_mktsegment").alias("library"), F.col("o_orderkey").alias("item"), F.col("o_totalprice").alias("cost"))
    return folds.round_robin(items_, target=12, budget=900_000.0)


def w14_fixed_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A tenth of each source, rounded up, in the order of a digest."""
    rows = _read(spark, sf_dir, "documents").select("doc_id", "source")
    sizes = rows.groupBy("source").agg(F.ceil(F.count("*") / 10).cast("long").alias("share"))
    place = F.row_number().over(Window.partitionBy("source").orderBy(_hash("doc_id", seed=14), "doc_id"))
    return rows.withColumn("place", place.cast("long")).join(F.broadcast(sizes), "source").where("place <= share").select("source", "doc_id", "place")  # a row a source


def w16_seed_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Items found from suppliers as seeds: each belongs to the first seed that finds it, and a seed keeps five."""
    found = _read(spark, sf_dir, "lineitem").groupBy(F.col("l_partkey").alias("item")).agg(F.min("l_suppkey").alias("seed"))
    place = F.row_number().over(Window.partitionBy("seed").orderBy("item"))
    return found.withColumn("place", place.cast("long")).where("place <= 5")


def x2_review_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", _hash("doc_id", seed=2).alias("h")).orderBy("h", "doc_id").limit(60).select("doc_id")


def x8_quota_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """120 documents: pinned ones, then up to 20 of each language by length, then the longest of the rest."""
    total, quota = 120, 20
    rows = _read(spark, sf_dir, "documents").select("doc_id", "lang", "n_chars", (F.col("doc_id") % 211 == 0).alias("pinned"))
    pinned = rows.where("pinned")
    held = pinned.groupBy("lang").agg(F.count("*").alias("held"))
    order = [F.desc("n_chars"), F.col("doc_id")]
    free = rows.where("NOT pinned").withColumn("rn", F.row_number().over(Window.partitionBy("lang").orderBy(*order)))
    free = free.where(F.col("rn") <= total).join(F.broadcast(held), "lang", "left").withColumn("tier", F.when(F.col("rn") <= F.greatest(F.lit(0), quota - F.coalesce("held", F.lit(0))), 1).otherwise(2))  # a row a language
    ranked = pinned.select("doc_id", "lang", "n_chars", F.lit(0).alias("tier")).union(free.select("doc_id", "lang", "n_chars", "tier"))
    return ranked.orderBy("tier", *order).limit(total).select("doc_id", "lang", "tier")


# --- scorers --------------------------------------------------------------------------------------------------------


def _citations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "lineitem").select(F.col("l_suppkey").alias("citing"), (F.col("l_partkey") % 97).alias("cited")).distinct()


def r2_contradictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Near claims of two papers on one topic that an audit has not set aside; papers that cite each other in neither direction score higher."""
    rows = claims(spark, sf_dir)
    found = near.reaching(near.near(rows, rows, near.same_group, 0.35)).select(F.col("i").alias("a"), F.col("j").alias("b"), F.floor(F.col("i") / 5).alias("pa"), F.col("owner").alias("pb"), "sim")
    cites = _citations(spark, sf_dir)
    either = cites.select(F.least("citing", "cited").alias("x"), F.greatest("citing", "cited").alias("y")).distinct().withColumn("linked", F.lit(True))
    pair = found.withColumn("x", F.least("pa", "pb")).withColumn("y", F.greatest("pa", "pb")).join(either, ["x", "y"], "left")
    audits = _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("x"), F.when(F.col("quality") == 0, "artifact").otherwise("genuine").alias("verdict")).groupBy("x").agg(F.min("verdict").alias("verdict"))
    judged = pair.join(audits, "x", "left").withColumn("verdict", F.coalesce("verdict", F.lit("unaudited"))).where("verdict <> 'artifact'")
    both = ((F.col("pa") % 2 == 0) & (F.col("pb") % 2 == 0)).cast("double")
    score = 0.5 * F.col("sim") + 0.4 * F.col("linked").isNull().cast("double") + 0.1 * both
    return judged.select("a", "b", "verdict", F.round(score, 5).alias("score"), F.round(0.35 + 0.4 * F.col("sim") + 0.15 * both, 5).alias("confidence"))


def r4_method_transfer(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Methods of one group for another whose papers hardly cite it: the best claim there for each method claim, the twelve best pairs of groups.

    A claim's method is its id modulo 13; methods that the other group has itself transfer nothing (J15).
    """
    rows = claims(spark, sf_dir).withColumn("method", F.col("id") % 13)
    papers = rows.select(F.col("owner").alias("paper"), "grp").distinct()
    cites = _citations(spark, sf_dir)
    crossed = cites.join(papers.select(F.col("paper").alias("citing"), F.col("grp").alias("x")), "citing").join(papers.select(F.col("paper").alias("cited"), F.col("grp").alias("y")), "cited").where("x <> y")
    crossed = crossed.groupBy(F.least("x", "y").alias("lo"), F.greatest("x", "y").alias("hi")).agg(F.count("*").alias("crossed"))
    methods = rows.select("grp", "method").distinct()
    claim = rows.select("id", "grp", "method")
    pairs = near.reaching(near.near(rows, rows, near.other_owner, 0.25)).select("i", "j", "sim")
    pairs = pairs.join(claim.select(F.col("id").alias("i"), F.col("grp").alias("ga"), "method"), "i").join(claim.select(F.col("id").alias("j"), F.col("grp").alias("gb")), "j").where("ga <> gb")
    there = methods.select(F.col("grp").alias("gb"), "method", F.lit(True).alias("known"))
    fresh = pairs.join(F.broadcast(there), ["gb", "method"], "left_anti")  # a row a group and method, 13 of each
    best = fresh.groupBy("ga", "gb").agg(F.min(F.struct((-F.round("sim", 9)).alias("s"), "i", "j")).alias("m"), F.count_distinct("method").alias("absent"))
    best = best.join(crossed, (F.least("ga", "gb") == F.col("lo")) & (F.greatest("ga", "gb") == F.col("hi")), "left").withColumn("crossed", F.coalesce("crossed", F.lit(0)))
    score = 0.6 * -F.col("m.s") + 0.2 * (1 - F.col("crossed") / (F.col("crossed") + 2.0)) + 0.2 * F.col("absent") / (F.col("absent") + 3.0)
    return best.select("ga", "gb", F.col("m.i").alias("claim"), F.col("m.j").alias("target"), "crossed", "absent", F.round(score, 6).alias("score")).orderBy(F.desc("score"), "ga", "gb").limit(12)


def r5_disjoint_bridges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five strongest bridges A - B - C: A and C of two papers, far apart and not citing each other, both near B of a third.

    A bridge is as strong as the weaker of its links, so that all bridges of some
    strength are made of links of that strength: links are taken in by falling
    thresholds until five bridges are found, and weaker ones never meet.
    """
    rows = claims(spark, sf_dir)
    links = keep(near.reaching(near.near(rows, rows, near.other_owner, 0.3)).select("i", "j", "sim"), "links")
    cites = _citations(spark, sf_dir)
    linked = cites.union(cites.select("cited", "citing")).distinct().withColumnsRenamed({"citing": "pa", "cited": "pc"})
    vectors = rows.select("id", F.col("v").cast("array<double>").alias("v"))
    found = None
    for least in (0.6, 0.5, 0.45, 0.4, 0.35, 0.3):
        strong = links.where(F.col("sim") >= least)
        two = strong.select(F.col("i").alias("a"), F.col("j").alias("bridge"), F.col("sim").alias("s1")).join(strong.select(F.col("i").alias("bridge"), F.col("j").alias("c"), F.col("sim").alias("s2")), "bridge")
        two = two.where("a < c").withColumn("pa", F.floor(F.col("a") / 5)).withColumn("pc", F.floor(F.col("c") / 5)).where("pa <> pc").join(linked, ["pa", "pc"], "left_anti")
        ends = two.join(vectors.select(F.col("id").alias("a"), F.col("v").alias("va")), "a").join(vectors.select(F.col("id").alias("c"), F.col("v").alias("vc")), "c")
        between = F.aggregate(F.zip_with("va", "vc", lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)
        best = ends.where(between < 0.1).groupBy("a", "c").agg(F.min(F.struct((-F.round(F.least("s1", "s2"), 9)).alias("s"), "bridge")).alias("m"))
        found = best.select("a", F.col("m.bridge").alias("bridge"), "c", F.round(-F.col("m.s"), 5).alias("strength"), F.lit(0.15).alias("confidence")).orderBy(F.desc("strength"), "a", "c").limit(5)
        if least == 0.3 or found.count() == 5:
            return found
    return found


def _scores(spark: SparkSession, sf_dir: str, table: str, key: str, score) -> DataFrame:
    return _read(spark, sf_dir, table).select(F.col(key).alias("id"), F.round(score, 6).alias("score"))


#: The scorers by name; each gives ``id, score`` for the tables of a folder.
SCORERS = {
    "balance": lambda spark, sf_dir: _scores(spark, sf_dir, "supplier", "s_suppkey", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.col("s_acctbal") / 10000))),
    "size": lambda spark, sf_dir: _scores(spark, sf_dir, "part", "p_partkey", F.col("p_size") / 50),
    "length": lambda spark, sf_dir: _scores(spark, sf_dir, "documents", "doc_id", F.col("n_chars") / (F.col("n_chars") + 2000.0)),
}


def r6_registry(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best results of every scorer that is registered."""
    found = None
    for name, scorer in sorted(SCORERS.items()):
        best = scorer(spark, sf_dir).where("score IS NOT NULL").orderBy(F.desc("score"), "id").limit(5).select(F.lit(name).alias("scorer"), "id", "score")
        found = best if found is None else found.unionByName(best)
    return found


def r9_shown_cards(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cards as they are shown: no unconfirmed leads, no banned words, one card a headline (the best, with the number of the others)."""
    docs = _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels").groupBy("doc_id").agg(F.max("quality").alias("confirmed")), "doc_id", "left")
    cards = docs.select("doc_id", F.regexp_extract("text", "^[^.\n]*", 0).alias("headline"), F.when(F.col("n_chars") >= 3000, "strong").when(F.col("n_chars") >= 300, "likely").otherwise("lead").alias("strength"), F.col("n_chars").alias("score"), "confirmed")
    shown = cards.where("headline IS NOT NULL AND (strength <> 'lead' OR coalesce(confirmed, 0) = 1)").where(~F.rlike(F.lower("headline"), F.lit("(^|[^a-z])(stupid|trash|idiot)([^a-z]|$)")))
    return shown.groupBy("headline").agg(F.min_by("doc_id", F.struct((-F.col("score")).alias("s"), "doc_id")).alias("doc_id"), (F.count("*") - 1).alias("others")).select("doc_id", F.sha2("headline", 256).alias("headline"), "others")


def j10_new_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shortlisted pairs, in either order, that the log of classified ones does not have."""
    rows = _read(spark, sf_dir, "lineitem").select(F.least("l_suppkey", F.col("l_partkey") % 97).alias("a"), F.greatest("l_suppkey", F.col("l_partkey") % 97).alias("b"), "l_returnflag")
    log = rows.where("l_returnflag = 'R'").select("a", "b").distinct()
    return rows.where("a <> b").select("a", "b").distinct().join(log, ["a", "b"], "left_anti")


# --- validation -----------------------------------------------------------------------------------------------------

FROZEN, WINDOW = 2015, 3


def frozen(tables: dict[str, DataFrame], papers: DataFrame) -> dict[str, DataFrame]:
    """Every table restricted to the papers; each has a column ``owner``."""
    return {name: df.join(papers.select("owner").distinct(), "owner", "left_semi") for name, df in tables.items()}


def _tables(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    rows = claims(spark, sf_dir)
    cites = _citations(spark, sf_dir)
    return {"claims": rows.select("owner", "id"), "items": items(rows).select("owner", "id"), "papers": rows.select("owner", F.col("owner").alias("id")).distinct(), "references": cites.select(F.col("citing").alias("owner"), F.col("cited").alias("id")), "labels": _read(spark, sf_dir, "labels").select(F.col("doc_id").alias("owner"), F.col("quality").alias("id"))}


def v1_freeze(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every collection at the freeze, and in the years of evidence after it."""
    years = claims(spark, sf_dir).groupBy("owner").agg(F.min("yr").alias("yr"))
    parts = {"before": years.where(F.col("yr") <= FROZEN), "evidence": years.where((F.col("yr") > FROZEN) & (F.col("yr") <= FROZEN + WINDOW))}
    counted = None
    for part, papers in parts.items():
        for name, df in frozen(_tables(spark, sf_dir), papers).items():
            own = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("collection"), F.lit(part).alias("part"), "n")
            counted = own if counted is None else counted.union(own)
    return counted


def v15_sub_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of every collection that a third of the papers have."""
    papers = claims(spark, sf_dir).select("owner").distinct().where("owner % 3 = 0")
    counted = None
    for name, df in frozen(_tables(spark, sf_dir), papers).items():
        own = df.agg(F.count("*").alias("n")).select(F.lit(name).alias("collection"), "n")
        counted = own if counted is None else counted.union(own)
    return counted


def v3_bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 95th percentile of an item's highest product with a draw of older claims, over ten draws of a fourth of them each."""
    rows = claims(spark, sf_dir)
    drawn = [F.substring(F.sha2(F.concat_ws("|", "id", F.lit(k + 1)), 256), 1, 1) < "4" for k in range(10)]
    marked = rows.withColumn("grp", sum((F.when(x, 1 << k).otherwise(0) for k, x in enumerate(drawn)), F.lit(0)).cast("long"))
    best = near.nearest_in_draws(items(rows), marked, near.earlier, len(drawn))
    return best.agg(F.round(F.percentile("best", F.lit(0.95)), 5).alias("tau"), F.count("*").alias("draws"))


def v4_novelty(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Later claims whose nearest earlier claim is below the 99th percentile of products of claims of two papers before the freeze."""
    rows = claims(spark, sf_dir)
    old, new = rows.where(F.col("yr") <= FROZEN), rows.where((F.col("yr") > FROZEN) & (F.col("yr") <= FROZEN + WINDOW))
    tau = F.lit(near.percentile(old, old, near.other_owner, 0.99)).cast("double")
    best = near.nearest(near.near(new, old, near.any_pair, 2.0))
    return best.select(F.col("i").alias("claim"), F.round("best", 5).alias("best"), (F.col("best") < tau).alias("novel"))


def _draws(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels with two scores and the weight of each in forty draws: 0, 1 or 2 by a digest."""
    rows = _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels"), "doc_id").select("doc_id", "quality", (F.col("n_chars") >= 300).cast("double").alias("ours"), (F.col("doc_id") % 2).cast("double").alias("theirs"))
    drawn = rows.withColumn("b", F.explode(F.sequence(F.lit(1), F.lit(40)))).withColumn("h", F.substring(F.sha2(F.concat_ws("|", "doc_id", "b"), 256), 1, 1))
    return drawn.withColumn("w", F.when(F.col("h") < "6", 0.0).when(F.col("h") < "c", 1.0).otherwise(2.0))


def v9_paired_difference(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The interval of the difference between two rules' agreement with the labels, both over the same draws."""
    right = lambda c: F.sum(F.col("w") * (F.col(c) == F.col("quality")).cast("double"))
    each = _draws(spark, sf_dir).groupBy("b").agg(((right("ours") - right("theirs")) / F.sum("w")).alias("d"))
    return each.agg(F.round(F.percentile("d", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("d", F.lit(0.975)), 6).alias("high"), (F.percentile("d", F.lit(0.025)) > 0).alias("better"))


def v12_precision_baselines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Of the first K by score, by year and by id: how many are good; beside the share of all."""
    rows = _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels"), "doc_id").select("doc_id", "n_chars", (2000 + F.col("doc_id") % 12).alias("yr"), F.col("quality").cast("double").alias("hit"))
    orders = {"score": [F.desc("n_chars"), F.col("doc_id")], "recency": [F.desc("yr"), F.col("doc_id")], "id": [F.col("doc_id")]}
    base = rows.agg(F.avg("hit").alias("base"))  # one row
    found = None
    for name, order in orders.items():
        top = rows.orderBy(*order).limit(100).withColumn("place", F.row_number().over(Window.orderBy(*order)))  # a hundred rows
        for k in (10, 50, 100):
            own = top.where(F.col("place") <= k).agg(F.avg("hit").alias("p")).crossJoin(base).select(F.lit(name).alias("ranking"), F.lit(k).alias("k"), F.round("p", 6).alias("precision"), F.round("base", 6).alias("base"))
            found = own if found is None else found.union(own)
    return found


def v14_scaling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Yields of two scorers over sizes and draws: mean, spread, the bound when none was found, and a caveat where the yield cannot grow."""
    people = _read(spark, sf_dir, "customer").select("c_custkey").withColumn("draw", F.explode(F.sequence(F.lit(1), F.lit(3))))
    place = F.row_number().over(Window.partitionBy("draw").orderBy(F.sha2(F.concat_ws("|", "c_custkey", "draw"), 256), "c_custkey"))
    first = people.withColumn("place", place).where("place <= 120")
    sizes = F.explode(F.array(*map(F.lit, (40, 80, 120)))).alias("n")
    drawn = first.select("*", sizes).where("place <= n").select("n", "draw", "c_custkey")
    orders = _read(spark, sf_dir, "orders").select(F.col("o_custkey").alias("c_custkey"), "o_orderpriority", "o_totalprice")
    kinds = F.array(F.struct(F.lit("urgent").alias("scorer"), (F.col("o_orderpriority") == "1-URGENT").alias("hit")), F.struct(F.lit("never").alias("scorer"), (F.col("o_totalprice") < 0).alias("hit")))
    each = drawn.join(orders, "c_custkey").select("n", "draw", F.explode(kinds).alias("x"))
    hits = each.groupBy("n", "draw", F.col("x.scorer").alias("scorer")).agg(F.sum(F.col("x.hit").cast("double")).alias("found"))
    rows = hits.groupBy("scorer", "n").agg(F.round(F.avg("found"), 6).alias("mean"), F.round(F.stddev_pop("found"), 6).alias("sd"), F.max("found").alias("most"), F.count("*").alias("draws"))
    return rows.select("scorer", "n", "mean", "sd", F.when(F.col("most") == 0, F.round(3.0 / (F.col("n") * F.col("draws")), 6)).alias("upper_rate"), (F.col("most") == F.col("n")).alias("bounded"))


def v16_cost_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cost at larger sizes by the power law of the sizes measured, through the largest of them."""
    measured = _read(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("yr")).agg(F.count("*").cast("double").alias("n"), F.sum("o_totalprice").alias("cost"))
    law = measured.agg(F.regr_slope(F.log("cost"), F.log("n")).alias("slope"), F.max_by(F.struct("n", "cost"), F.struct("n", "yr")).alias("at"))  # one row
    targets = spark.createDataFrame([(x,) for x in (1000.0, 10000.0, 100000.0)], "target double")
    return targets.crossJoin(F.broadcast(law)).select("target", F.round("slope", 6).alias("slope"), F.round(F.col("at.cost") * F.pow(F.col("target") / F.col("at.n"), F.col("slope")) / 1e6, 4).alias("cost"))


def v17_k_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Precision for a schedule of cut-offs that grows with the number of results: 1, 2, 5, 10 ... per cent."""
    rows = _read(spark, sf_dir, "documents").join(_read(spark, sf_dir, "labels"), "doc_id").groupBy("lang", "n_chars").agg(F.sum("quality").alias("good"), F.count("*").alias("n"))
    before = Window.partitionBy("lang").orderBy(F.desc("n_chars"))
    cumulated = rows.withColumn("good", F.sum("good").over(before)).withColumn("upto", F.sum("n").over(before))
    whole = rows.groupBy("lang").agg(F.sum("n").alias("total"))
    grid = whole.select("lang", "total", F.explode(F.array(*map(F.lit, (1, 2, 5, 10, 20, 50, 100)))).alias("percent")).withColumn("k", F.ceil(F.col("total") * F.col("percent") / 100.0))
    at = cumulated.join(F.broadcast(grid), "lang").where("upto >= k").groupBy("lang", "percent", "k").agg(F.min(F.struct("upto", "good")).alias("m"))
    return at.select("lang", "percent", "k", F.col("m.upto").alias("taken"), F.round(F.col("m.good") / F.col("m.upto"), 6).alias("precision"))


def v18_orphan_distribution(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Why items are shown or not (R3a), in each of three sub-corpora by id."""
    rows = claims(spark, sf_dir)
    found = keep(near.near(items(rows), rows, near.later, 0.15, per_owner=True), "later-claims")
    papers = near.reaching(found).groupBy("i").agg(F.count_distinct("owner").alias("near"))
    own = items(rows).select(F.col("id").alias("i"), "yr", (F.col("owner") % 3).alias("part")).join(near.nearest(found), "i", "left").join(papers, "i", "left").crossJoin(F.broadcast(rows.agg(F.max("yr").alias("newest"))))  # one row
    verdict = F.when(F.col("best") >= 0.35, "addressed").when(F.coalesce("near", F.lit(0)) < 5, "sparse").when(F.col("newest") - F.col("yr") < 2, "young").otherwise("shown")
    return own.groupBy("part", verdict.alias("verdict")).agg(F.count("*").alias("n"))


# --- texts ----------------------------------------------------------------------------------------------------------

SUFFIXES = (("ations", 9), ("ation", 8), ("tion", 6), ("ing", 5), ("ed", 4), ("es", 4), ("s", 3))
STOP = ("the", "and", "der", "die", "und", "les", "des", "los", "las")


def f1_title_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    titles = _read(spark, sf_dir, "documents").select("doc_id", F.concat(F.lit("<i>Über</i> "), F.regexp_extract("text", "^[^.\n]*", 0), F.lit(" Ｗide ﬁt²")).alias("t"))
    return titles.select("doc_id", texts.title_key(F.col("t")).alias("title_key"))


def f2_lite_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "benchmark").select("item_id", texts.plain_key(F.col("text")).alias("key"))


def f8_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = _read(spark, sf_dir, "benchmark").select("item_id", F.posexplode(texts.terms(F.col("text"), SUFFIXES, STOP, 3, ("on",))).alias("place", "x"))
    return found.select("item_id", F.col("place").cast("long").alias("place"), "x.stem", "x.raw")


def f16_splitter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statements made of passages, as numbered lists, as clauses or whole, and the atoms that they are split into."""
    rows = _read(spark, sf_dir, "benchmark").select("item_id", F.split(F.regexp_replace("text", "[^A-Za-z ]+", " "), " +").alias("w"))
    cut = lambda a, n: F.array_join(F.slice("w", a, n), " ")
    kind = F.col("item_id") % 4
    made = F.when(kind == 0, F.concat(F.lit("We (1) "), cut(2, 4), F.lit(", and (2) "), cut(7, 4), F.lit("."))).when(kind == 1, F.concat(F.lit("this is "), cut(2, 3), F.lit("; it shows "), cut(6, 3))).when(kind == 2, F.concat(F.lit("one; "), cut(2, 4))).otherwise(cut(1, 8))
    atoms = texts.atoms(made, ("is", "shows"))
    return rows.select("item_id", F.posexplode(atoms).alias("place", "atom")).select("item_id", F.col("place").cast("long").alias("place"), "atom")


def f20_capped(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents")
    return docs.select("doc_id", texts.capped(F.regexp_replace("text", "[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+", "[e-mail]"), 120).alias("head"))


def f26_hash_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixteen components a passage: four bytes each of digests of the text and a counter, from -1 to 1, of length 1."""
    rows = _read(spark, sf_dir, "benchmark").select("item_id", F.transform(F.sequence(F.lit(0), F.lit(1)), lambda c: F.sha2(F.concat(F.col("text"), F.lit("|"), c.cast("string")), 256)).alias("d"))
    word = lambda i: F.conv(F.substr(F.get("d", F.floor(i / 8).cast("int")), (i % 8 * 8 + 1).cast("int"), F.lit(8)), 16, 10).cast("double")
    raw = rows.select("item_id", F.transform(F.sequence(F.lit(0), F.lit(15)), lambda i: word(i) / 2147483647.5 - 1).alias("v"))
    norm = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x * x))
    return raw.withColumn("norm", norm).select("item_id", "norm", F.posexplode("v").alias("place", "x")).select("item_id", F.col("place").cast("long").alias("place"), F.round(F.col("x") / F.nullif(F.col("norm"), F.lit(0.0)), 6).alias("x"))


def f33_title_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _read(spark, sf_dir, "documents").select("doc_id", F.array_join(texts.title_terms(F.regexp_extract("text", "^[^.\n]*", 0), STOP), " ").alias("terms"))


def f37_redacted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Log lines with addresses, keys and tokens, and what is left of them."""
    rows = _read(spark, sf_dir, "customer").select("c_custkey", F.concat(F.lit("mail "), F.lower("c_name"), F.lit("@x.example.org token="), F.md5("c_name"), F.lit(" sk-"), F.md5("c_name"), F.lit(" done")).alias("line"))
    return rows.select("c_custkey", texts.redacted(F.regexp_replace("line", "#", ".")).alias("line"))


# --- labels ---------------------------------------------------------------------------------------------------------


def k3_prelabelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that are not off the domain, the core of them first, by their links in the collection, a hundred at most."""
    docs = _read(spark, sf_dir, "documents")
    label = F.when(F.col("n_chars") < 50, "off").when(F.rlike(F.lower("text"), F.lit("licen[cs]e")), "on").when(F.rlike("text", F.lit("[#$%&|]")), "off").when(F.col("lang") == "en", "on").otherwise("borderline")
    linked = _citations(spark, sf_dir).groupBy(F.col("cited").alias("doc_id")).agg(F.count("*").alias("central"))
    rows = docs.select("doc_id", label.alias("label"), "n_chars").where("label <> 'off'").join(linked, "doc_id", "left").withColumn("central", F.coalesce("central", F.lit(0)))
    return rows.orderBy(F.when(F.col("label") == "on", 0).otherwise(1), F.desc("central"), F.desc("n_chars"), "doc_id").limit(100).select("doc_id", "label", "central")


def k8_finalised(spark: SparkSession, sf_dir: str) -> DataFrame:
    """After the final labels every dependent table is written anew without the papers that went: rows before and after."""
    papers = _read(spark, sf_dir, "documents").select(F.col("doc_id").alias("owner"), (F.col("n_chars") >= 300).alias("kept")).where("kept")
    sizes, rewritten = _tables(spark, sf_dir), frozen(_tables(spark, sf_dir), papers)
    counted = None
    for name, df in rewritten.items():
        path = new_path(spark, f"final-{name}")
        df.write.parquet(path)
        own = sizes[name].agg(F.count("*").alias("before")).crossJoin(spark.read.parquet(path).agg(F.count("*").alias("after"))).select(F.lit(name).alias("store"), "before", "after")
        counted = own if counted is None else counted.union(own)
    return counted


# --- increments -----------------------------------------------------------------------------------------------------


def t2_widening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tiers of three days searched one after the other until enough is found or the calls are used up."""
    rows = _read(spark, sf_dir, "events").where("event_type = 'purchase'")
    tiers = [(rows.where(F.floor(F.datediff(F.col("ts").cast("date"), F.lit("2024-01-01").cast("date")) / 3) == t), t) for t in range(11)]
    found = batches.widen([df for df, _ in tiers], need=500, calls=7)
    return spark.createDataFrame(found, "tier long, searched boolean, found long, total long, state string")


def t4_batches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Requests submitted as batches, submitted again after a kill, collected twice: each is billed once."""
    requests = _read(spark, sf_dir, "events").where("event_type = 'purchase'").select(F.col("user_id").alias("batch"), F.col("event_id").alias("request"), F.col("value").alias("cost"))
    store = batches.Batches(spark, new_path(spark, "batches"))
    store.submit(requests.where("batch % 2 = 0"))
    again = batches.Batches(spark, store.path)  # a new driver finds what is pending
    again.submit(requests)
    again.collect(requests.select("batch", "request", (F.col("cost") > 50).alias("answer"), "cost").where("batch % 5 <> 0"))
    again.collect(requests.select("batch", "request", (F.col("cost") > 50).alias("answer"), "cost"))
    return again.state()


# --- sources --------------------------------------------------------------------------------------------------------


def s2_rest_listing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nations over a local paged service that fails now and then and has broken records, by region, so many of each."""
    nations = [r.asDict() for r in _read(spark, sf_dir, "nation").select("n_nationkey", "n_name", "n_regionkey").orderBy("n_nationkey").collect()]  # 25 rows
    spark.dataSource.register(rest.PagedRest)
    with rest.local_service([{"id": None if n["n_nationkey"] % 6 == 5 else str(n["n_nationkey"]), "name": n["n_name"], "region": str(n["n_regionkey"])} for n in nations], "region", failures=3) as url:
        read = spark.read.format("paged_rest").option("url", url).option("per_page", "2").option("pause", "0.05").option("limit", "3").option("queries", "\n".join(f"region={i}" for i in range(5)))
        return keep(read.load().select(F.col("id").cast("long").alias("n_nationkey"), F.get_json_object("record", "$.name").alias("n_name")), "listing")


def s19_body_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Articles as XML made of passages, and the text of their bodies."""
    escaped = F.replace(F.replace(F.regexp_replace("text", "[\\x00-\\x1F]+", " "), F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    article = F.concat(F.lit("<article><front><title>T"), F.col("item_id"), F.lit("</title></front><body><sec><title>Methods</title><p>"), escaped, F.lit("</p></sec><sec><p>End <b>of</b> it.</p></sec></body></article>"))
    found = _read(spark, sf_dir, "benchmark").select("item_id", F.xpath(article, F.lit("/article/body//text()")).alias("parts"))
    return found.select("item_id", F.trim(F.regexp_replace(F.array_join("parts", " "), "[ \\t\\r\\n]+", " ")).alias("body"))


def s20_pdf_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents written as PDF files and read back as text."""
    path = new_path(spark, "pdf")
    rows = _read(spark, sf_dir, "benchmark").select("item_id", F.regexp_replace("text", "[^ -~]+", " ").alias("line"))
    pdf.write(rows, "item_id", "line", path)
    return pdf.texts(spark, path).select(F.regexp_extract("name", "([0-9]+)", 1).cast("long").alias("item_id"), "text")


QUERIES = {
    f.__name__: f
    for f in (
        u2_stable_union, u8_append_only, p11_tier_and_rank, w5_running_total, w12_precision_at_k, w10_round_robin, w14_fixed_ratio, w16_seed_cap, x2_review_sample, x8_quota_sample, r2_contradictions, r4_method_transfer, r5_disjoint_bridges, r6_registry, r9_shown_cards, j10_new_pairs,
        v1_freeze, v15_sub_corpus, v3_bootstrap, v4_novelty, v9_paired_difference, v12_precision_baselines, v14_scaling, v16_cost_projection, v17_k_sweep, v18_orphan_distribution,
        f1_title_key, f2_lite_key, f8_terms, f16_splitter, f20_capped, f26_hash_embedding, f33_title_terms, f37_redacted, k3_prelabelled, k8_finalised, t2_widening, t4_batches, s2_rest_listing, s19_body_text, s20_pdf_text,
    )
}

_E = relations._EDGES  # noqa: SLF001


def _one(template, d) -> str:
    return f"({template(d).strip()})"


_A = aggregates.TEMPLATES

TEMPLATES = {
    # What cites both within the year before a date
    "j13_cites_both_lately": lambda d: f"""
        SELECT citing, count(DISTINCT cited) AS cited_of_both, CAST(max({d.days("shipped", "DATE '1990-01-01'")}) AS BIGINT) AS last_day FROM (
          SELECT l_suppkey AS citing, l_partkey % 97 AS cited, l_shipdate AS shipped FROM {d.t("lineitem")} WHERE l_suppkey <> l_partkey % 97) e
        WHERE cited IN (3, 5) AND citing NOT IN (3, 5) AND CAST(shipped AS DATE) BETWEEN DATE '1999-01-01' AND DATE '2001-12-31' GROUP BY citing HAVING count(DISTINCT cited) = 2""",
    # Annotations of a library on its own copy of an item
    "j18_annotations": lambda d: f"""
        SELECT x.source AS library, count(*) AS items, count(a.note) AS noted, min(a.note) AS first_note FROM {d.t("documents")} x
        LEFT JOIN (SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN 'src1' ELSE 'src2' END AS library, CASE WHEN toxic = 1 THEN 'doubt: toxic' ELSE 'checked' END AS note FROM {d.t("labels")}) a ON a.doc_id = x.doc_id AND a.library = x.source
        GROUP BY x.source""",
    # Audited pairs that are there in another audit of either order
    "d13_pair_audit": lambda d: f"""
        SELECT a.l_orderkey, a.l_linenumber, p.n AS seen, CASE WHEN p.n > 1 THEN 'duplicate' ELSE 'single' END AS verdict FROM {d.t("lineitem")} a
        JOIN (SELECT least(l_suppkey, l_partkey) AS x, greatest(l_suppkey, l_partkey) AS y, count(*) AS n FROM {d.t("lineitem")} WHERE l_returnflag = 'R' GROUP BY least(l_suppkey, l_partkey), greatest(l_suppkey, l_partkey)) p
        ON p.x = least(a.l_suppkey, a.l_partkey) AND p.y = greatest(a.l_suppkey, a.l_partkey) WHERE a.l_returnflag = 'R'""",
    # Of records with the same long title the most cited one
    "d15_most_cited": lambda d: f"""
        SELECT title, doc_id FROM (SELECT title, doc_id, row_number() OVER (PARTITION BY title ORDER BY n_chars DESC, doc_id) AS rn FROM {relations._DOCS(d)} x WHERE length(title) >= 25) y WHERE rn = 1""",
    # A snowball with so many fetches a node, as long as credits are above a floor
    "g6_credit_snowball": lambda d: f"""
        WITH e AS (SELECT DISTINCT citing, cited FROM {_E(d)} x),
        f AS (SELECT citing, cited, row_number() OVER (PARTITION BY citing ORDER BY cited) AS rn FROM e WHERE citing <= 40),
        c AS (SELECT citing, cited, 1000 - 10 * row_number() OVER (ORDER BY citing, cited) AS credits FROM f WHERE rn <= 8)
        SELECT cited, count(*) AS found, CAST(min(credits) AS BIGINT) AS least_credits FROM c WHERE credits >= 200 GROUP BY cited""",
    # What one node cites and what cites it
    "g8_neighbours": lambda d: f"SELECT 'out' AS direction, cited AS neighbour FROM {_E(d)} x WHERE citing = 7 UNION ALL SELECT 'in', citing FROM {_E(d)} y WHERE cited = 7",
    # K2: another order of the rules: the source's allow-list comes before the terms
    "k2_allow_list_first": lambda d: f"""
        SELECT doc_id, CASE WHEN n_chars < 50 THEN 'off' WHEN source IN ('src1', 'src4') THEN 'on' WHEN {d.matches("text", "[#$%&|]")} THEN 'off' WHEN {d.matches("lower(text)", "licen[cs]e")} THEN 'on' ELSE 'borderline' END AS label FROM {d.t("documents")}""",
    # Totals by stage and, in the order of the stages, their running sum
    "a12_cumulative": lambda d: f"""
        SELECT stage, calls, round(cost, 4) AS cost, round(sum(cost) OVER (ORDER BY stage ROWS UNBOUNDED PRECEDING), 4) AS cumulative FROM (SELECT event_type AS stage, count(*) AS calls, sum(value) AS cost FROM {d.t("events")} GROUP BY event_type) x""",
    # Flags that exclude; one that is missing does not
    "p14_excluded": lambda d: f"""
        SELECT x.doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 17 = 0 THEN NULL ELSE {d.matches("text", "^[^a-z]*[A-Z][A-Z]")} END AS paratext, CASE WHEN doc_id % 5 = 0 THEN doc_id % 10 = 0 END AS retracted FROM {d.t("documents")}) x
        WHERE NOT coalesce(retracted, false) AND NOT coalesce(paratext, false)""",
    # An answer is JSON, an object, has the id that was asked for and a value of the schema; the first that fails names the failure
    "x20_validation_ladder": lambda d: f"""
        SELECT failure, count(*) AS n, CAST(sum(tries) AS BIGINT) AS tries FROM (SELECT failure, CASE failure WHEN 'none' THEN 0 WHEN 'not_json' THEN 3 WHEN 'schema' THEN 2 ELSE 1 END AS tries FROM (
          SELECT CASE WHEN NOT {d.matches("raw", "^[{].*[}]$")} THEN 'not_json' WHEN {d.json("raw", "id")} IS NULL THEN 'no_id' WHEN {d.json("raw", "id")} <> CAST(event_id AS VARCHAR(20)) THEN 'other_id' WHEN NOT coalesce({d.matches(d.json("raw", "verdict"), "^(view|click|purchase)$")}, false) THEN 'schema' ELSE 'none' END AS failure
          FROM (SELECT event_id, CASE WHEN event_id % 11 = 0 THEN 'sorry' WHEN event_id % 7 = 0 THEN '{{"verdict": "view"}}' ELSE concat('{{"id": "', CAST(event_id + CASE WHEN event_id % 13 = 0 THEN 1 ELSE 0 END AS VARCHAR(20)), '", "verdict": "', event_type, '"}}') END AS raw FROM {d.t("events")}) x) y) z GROUP BY failure""",
    # One row of features, the two scores of clamped terms and their bands
    "c1_feature_row": lambda d: f"""
        WITH f AS (SELECT (SELECT rate FROM {_one(_A["a10_reference_rate"], d)} a) AS intra, (SELECT CAST(count(*) AS DOUBLE) FROM {_one(relations.TEMPLATES["j14_reciprocal"], d)} b) / (SELECT count(*) FROM {_E(d)} c) AS reciprocity,
            (SELECT q FROM {_one(relations.TEMPLATES["g2_modularity"], d)} e) AS modularity, (SELECT avg(CASE WHEN doc_id % 9 = 0 OR {d.matches("lower(text)", "^(the|a) ")} THEN 1e0 ELSE 0e0 END) FROM {d.t("documents")}) AS review,
            (SELECT avg(divergence) FROM {_one(_A["a18_cohort_divergence"], d)} g) AS divergence, (SELECT max(hhi) FROM {_one(_A["a9_hhi"], d)} h) AS hhi, (SELECT distance FROM {_one(_A["a17_pair_distance"], d)} i) AS distance, (SELECT max(span) FROM {_one(_A["a11_median_span"], d)} j) AS span),
        s AS (SELECT *, (least(1e0, 4 * review) + 1 - least(1e0, 25 * reciprocity) + greatest(0e0, 1 - least(1e0, greatest(0e0, modularity - 0.3e0) * 3))) / 3 AS contested, (least(1e0, greatest(0e0, modularity) * 2.5e0) + least(1e0, 20 * intra)) / 2 AS transfer FROM f)
        SELECT round(intra, 6) AS intra, round(reciprocity, 6) AS reciprocity, round(modularity, 6) AS modularity, round(review, 6) AS review, round(divergence, 5) AS divergence, round(hhi, 6) AS hhi, round(distance, 5) AS distance, span, round(contested, 3) AS contested, round(transfer, 3) AS transfer,
          CASE WHEN contested >= 0.65 THEN 'high' WHEN contested >= 0.40 THEN 'moderate' ELSE 'low' END AS contested_band, CASE WHEN transfer >= 0.65 THEN 'high' WHEN transfer >= 0.40 THEN 'moderate' ELSE 'low' END AS transfer_band FROM s""",
    # Before a corpus is taken on: what is cached, what must be fetched, what that costs, and the advice in words
    "c6_pre_flight": lambda d: f"""
        SELECT lang, matches, cached, to_fetch, cost, CASE WHEN matches < 50 THEN 'too small' WHEN cost > 1 THEN concat('expensive: ', CAST(to_fetch AS VARCHAR(20)), ' to fetch') ELSE concat('go: ', CAST(cached AS VARCHAR(20)), ' cached') END AS advice FROM (
          SELECT lang, count(*) AS matches, count(l.doc_id) AS cached, count(*) - count(l.doc_id) AS to_fetch, round(0.0109e0 * sum(CASE WHEN l.doc_id IS NULL AND n_chars < 3000 THEN 1 ELSE 0 END) + 0.0336e0 * sum(CASE WHEN l.doc_id IS NULL AND n_chars >= 3000 THEN 1 ELSE 0 END), 4) AS cost
          FROM {d.t("documents")} x LEFT JOIN (SELECT DISTINCT doc_id FROM {d.t("labels")}) l ON l.doc_id = x.doc_id GROUP BY lang) y""",
}
_templated, SQL = dialect.queries(TEMPLATES)
QUERIES |= _templated

_C = "c AS MATERIALIZED (SELECT vec_id AS id, CAST(floor(vec_id / 5) AS BIGINT) AS paper, 2010 + vec_id % 12 AS yr, CAST(label AS BIGINT) AS grp, CAST(embedding AS DOUBLE[]) AS v FROM embeddings)"
_CITES = "cites AS MATERIALIZED (SELECT DISTINCT l_suppkey AS citing, l_partkey % 97 AS cited FROM lineitem)"
_STEMS = """CASE WHEN w LIKE '%ations' AND length(w) > 9 THEN w[:-7] WHEN w LIKE '%ation' AND length(w) > 8 THEN w[:-6] WHEN w LIKE '%tion' AND length(w) > 6 THEN w[:-5]
  WHEN w LIKE '%ing' AND length(w) > 5 THEN w[:-4] WHEN w LIKE '%ed' AND length(w) > 4 THEN w[:-3] WHEN w LIKE '%es' AND length(w) > 4 THEN w[:-3] WHEN w LIKE '%s' AND length(w) > 3 THEN w[:-2] ELSE w END"""
_STOPS = "(" + ", ".join(f"'{w}'" for w in STOP) + ")"
_KEY = "trim(regexp_replace(lower(regexp_replace(strip_accents(regexp_replace({x}, '<[^>]*>', '', 'g')), '[^\\x00-\\x7F]', '', 'g')), '[^a-z0-9]+', ' ', 'g'))"
_COLLECTIONS = """SELECT 'claims' AS collection, paper AS owner FROM c UNION ALL SELECT 'items', paper FROM c WHERE grp = 0 UNION ALL SELECT DISTINCT 'papers', paper FROM c UNION ALL SELECT 'references', citing FROM cites UNION ALL SELECT 'labels', doc_id FROM labels"""
_NAMES = "(VALUES ('claims'), ('items'), ('papers'), ('references'), ('labels')) n(collection)"
_AT_LEAST = "SELECT x.id AS i, y.id AS j, x.paper AS pi, y.paper AS pj, x.grp AS gi, y.grp AS gj, list_dot_product(x.v, y.v) AS sim FROM c x JOIN c y ON x.paper <> y.paper"
SQL |= {
    "u2_stable_union": """
        WITH a AS (SELECT l_suppkey AS k, l_returnflag AS v, row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_returnflag) AS p FROM lineitem), b AS (SELECT l_suppkey AS k, l_linestatus AS v, 1000000000 + row_number() OVER (PARTITION BY l_suppkey ORDER BY l_orderkey, l_linenumber, l_linestatus) AS p FROM lineitem),
        f AS (SELECT k, v, min(p) AS p FROM (SELECT * FROM a UNION ALL SELECT * FROM b) x GROUP BY k, v) SELECT k, string_agg(v, ',' ORDER BY p) AS items FROM f GROUP BY k""",
    "u8_append_only": """
        WITH o AS (SELECT user_id, list(event_id ORDER BY ts, event_id) AS l FROM events WHERE ts < TIMESTAMP '2024-01-15 00:00:00' GROUP BY user_id), n AS (SELECT user_id, list(event_id ORDER BY ts, event_id) AS l FROM events WHERE event_id % 97 <> 0 GROUP BY user_id),
        b AS (SELECT o.user_id, len(o.l) AS old_rows, len(list_filter(range(1, len(o.l) + 1), lambda i: o.l[i] IS DISTINCT FROM n.l[i])) AS violations FROM o LEFT JOIN n ON n.user_id = o.user_id)
        SELECT user_id, CAST(old_rows AS BIGINT) AS old_rows, CAST(violations AS BIGINT) AS violations, violations = 0 AS append_only FROM b""",
    "w10_round_robin": """
        WITH RECURSIVE i AS (SELECT o_orderpriority AS run, c_mktsegment AS library, o_orderkey AS item, o_totalprice AS cost, row_number() OVER (PARTITION BY o_orderpriority, c_mktsegment ORDER BY o_totalprice, o_orderkey) AS turn FROM orders JOIN customer ON c_custkey = o_custkey WHERE o_totalprice <= 900000),
        s AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY run ORDER BY turn, library) AS step FROM i),
        r AS (SELECT run, 0::BIGINT AS step, 900000.0::DOUBLE AS rest, 0::BIGINT AS place, NULL::VARCHAR AS library, NULL::BIGINT AS item FROM (SELECT DISTINCT run FROM s) x
          UNION ALL SELECT s.run, s.step, CASE WHEN s.cost <= r.rest THEN r.rest - s.cost ELSE r.rest END, r.place + CASE WHEN s.cost <= r.rest THEN 1 ELSE 0 END, s.library, CASE WHEN s.cost <= r.rest THEN s.item END FROM r JOIN s ON s.run = r.run AND s.step = r.step + 1 WHERE r.place < 12)
        SELECT run, library, item, place FROM r WHERE item IS NOT NULL""",
    "w14_fixed_ratio": f"SELECT source, doc_id, place FROM (SELECT source, doc_id, row_number() OVER (PARTITION BY source ORDER BY {_sha('doc_id', seed=14)}, doc_id) AS place, count(*) OVER (PARTITION BY source) AS n FROM documents) x WHERE place <= ceil(n / 10)",
    "w16_seed_cap": "SELECT item, seed, place FROM (SELECT item, seed, row_number() OVER (PARTITION BY seed ORDER BY item) AS place FROM (SELECT l_partkey AS item, min(l_suppkey) AS seed FROM lineitem GROUP BY l_partkey) x) y WHERE place <= 5",
    "x2_review_sample": f"SELECT doc_id FROM documents ORDER BY {_sha('doc_id', seed=2)}, doc_id LIMIT 60",
    "x8_quota_sample": """
        WITH p AS (SELECT doc_id, lang, n_chars FROM documents WHERE doc_id % 211 = 0), q AS (SELECT d.doc_id, d.lang, d.n_chars, row_number() OVER (PARTITION BY d.lang ORDER BY d.n_chars DESC, d.doc_id) AS rn, coalesce(h.n, 0) AS held
          FROM documents d LEFT JOIN (SELECT lang, count(*) AS n FROM p GROUP BY lang) h ON h.lang = d.lang WHERE d.doc_id % 211 <> 0),
        a AS (SELECT doc_id, lang, n_chars, 0 AS tier FROM p UNION ALL SELECT doc_id, lang, n_chars, CASE WHEN rn <= greatest(0, 20 - held) THEN 1 ELSE 2 END FROM q) SELECT doc_id, lang, tier FROM a ORDER BY tier, n_chars DESC, doc_id LIMIT 120""",
    "r2_contradictions": f"""WITH {_C}, {_CITES}, p AS (SELECT x.id AS a, y.id AS b, x.paper AS pa, y.paper AS pb, list_dot_product(x.v, y.v) AS sim FROM c x JOIN c y ON x.id < y.id AND x.paper <> y.paper AND x.grp = y.grp WHERE list_dot_product(x.v, y.v) >= 0.35),
        q AS (SELECT p.*, CASE WHEN EXISTS (SELECT 1 FROM cites WHERE (citing = pa AND cited = pb) OR (citing = pb AND cited = pa)) THEN 0 ELSE 1 END AS apart, CASE WHEN pa % 2 = 0 AND pb % 2 = 0 THEN 1 ELSE 0 END AS full_texts,
          coalesce((SELECT CASE WHEN min(quality) = 0 THEN 'artifact' ELSE 'genuine' END FROM labels WHERE doc_id = least(pa, pb) HAVING count(*) > 0), 'unaudited') AS verdict FROM p)
        SELECT a, b, verdict, round(0.5e0 * sim + 0.4e0 * apart + 0.1e0 * full_texts, 5) AS score, round(0.35e0 + 0.4e0 * sim + 0.15e0 * full_texts, 5) AS confidence FROM q WHERE verdict <> 'artifact'""",
    "r4_method_transfer": f"""WITH {_C}, {_CITES}, g AS (SELECT DISTINCT paper, grp FROM c), x AS (SELECT least(m.grp, n.grp) AS lo, greatest(m.grp, n.grp) AS hi, count(*) AS crossed FROM cites JOIN g m ON m.paper = citing JOIN g n ON n.paper = cited WHERE m.grp <> n.grp GROUP BY 1, 2),
        p AS (SELECT i, j, gi AS ga, gj AS gb, i % 13 AS method, sim FROM ({_AT_LEAST} WHERE x.grp <> y.grp) z WHERE sim >= 0.25),
        f AS (SELECT p.* FROM p WHERE NOT EXISTS (SELECT 1 FROM c WHERE c.grp = p.gb AND c.id % 13 = p.method)),
        b AS (SELECT ga, gb, count(DISTINCT method) AS absent, max(round(sim, 9)) AS sim, arg_min([i, j], (-round(sim, 9), i, j)) AS ends FROM f GROUP BY ga, gb)
        SELECT ga, gb, ends[1] AS claim, ends[2] AS target, coalesce(crossed, 0) AS crossed, absent, round(0.6e0 * sim + 0.2e0 * (1 - coalesce(crossed, 0) / (coalesce(crossed, 0) + 2e0)) + 0.2e0 * absent / (absent + 3e0), 6) AS score
        FROM b LEFT JOIN x ON lo = least(ga, gb) AND hi = greatest(ga, gb) ORDER BY score DESC, ga, gb LIMIT 12""",
    "r5_disjoint_bridges": f"""WITH {_C}, {_CITES}, s AS MATERIALIZED (SELECT * FROM ({_AT_LEAST}) z WHERE sim >= 0.3),
        t AS MATERIALIZED (SELECT x.i AS a, x.j AS bridge, y.j AS c, x.pi AS pa, y.pj AS pc, least(x.sim, y.sim) AS strength FROM s x JOIN s y ON y.i = x.j WHERE x.i < y.j AND x.pi <> y.pj),
        f AS (SELECT t.* FROM t JOIN c u ON u.id = t.a JOIN c w ON w.id = t.c WHERE list_dot_product(u.v, w.v) < 0.1 AND NOT EXISTS (SELECT 1 FROM cites WHERE (citing = pa AND cited = pc) OR (citing = pc AND cited = pa)))
        SELECT a, arg_min(bridge, (-round(strength, 9), bridge)) AS bridge, c, round(max(strength), 5) AS strength, 0.15::DOUBLE AS confidence FROM f GROUP BY a, c ORDER BY max(strength) DESC, a, c LIMIT 5""",
    "r6_registry": """
        WITH s AS (SELECT 'balance' AS scorer, s_suppkey AS id, round(greatest(0, least(1, s_acctbal / 10000)), 6) AS score FROM supplier UNION ALL SELECT 'size', p_partkey, round(p_size / 50, 6) FROM part UNION ALL SELECT 'length', doc_id, round(n_chars / (n_chars + 2000.0), 6) FROM documents)
        SELECT scorer, id, score FROM s WHERE score IS NOT NULL QUALIFY row_number() OVER (PARTITION BY scorer ORDER BY score DESC, id) <= 5""",
    "r9_shown_cards": r"""
        WITH c AS (SELECT doc_id, regexp_extract(text, '^[^.\n]*') AS headline, n_chars, CASE WHEN n_chars >= 3000 THEN 'strong' WHEN n_chars >= 300 THEN 'likely' ELSE 'lead' END AS strength, (SELECT max(quality) FROM labels l WHERE l.doc_id = d.doc_id) AS confirmed FROM documents d),
        s AS (SELECT * FROM c WHERE headline IS NOT NULL AND (strength <> 'lead' OR confirmed = 1) AND NOT regexp_matches(lower(headline), '(^|[^a-z])(stupid|trash|idiot)([^a-z]|$)'))
        SELECT doc_id, sha256(headline) AS headline, n - 1 AS others FROM (SELECT doc_id, headline, count(*) OVER (PARTITION BY headline) AS n, row_number() OVER (PARTITION BY headline ORDER BY n_chars DESC NULLS LAST, doc_id) AS rn FROM s) x WHERE rn = 1""",
    "j10_new_pairs": """
        WITH l AS (SELECT least(l_suppkey, l_partkey % 97) AS a, greatest(l_suppkey, l_partkey % 97) AS b, bool_or(l_returnflag = 'R') AS logged FROM lineitem GROUP BY 1, 2) SELECT a, b FROM l WHERE a <> b AND NOT logged""",
    "v1_freeze": f"""WITH {_C}, {_CITES}, y AS (SELECT paper, min(yr) AS yr FROM c GROUP BY paper), x AS ({_COLLECTIONS}), p AS (SELECT 'before' AS part, {FROZEN - 5} AS lo, {FROZEN} AS hi UNION ALL SELECT 'evidence', {FROZEN + 1}, {FROZEN + WINDOW})
        SELECT n.collection, p.part, count(x.owner) AS n FROM {_NAMES} CROSS JOIN p LEFT JOIN y ON y.yr BETWEEN p.lo AND p.hi LEFT JOIN x ON x.collection = n.collection AND x.owner = y.paper GROUP BY 1, 2""",
    "v15_sub_corpus": f"WITH {_C}, {_CITES}, x AS ({_COLLECTIONS}) SELECT n.collection, count(x.owner) AS n FROM {_NAMES} LEFT JOIN x ON x.collection = n.collection AND x.owner % 3 = 0 AND x.owner IN (SELECT paper FROM c) GROUP BY 1",
    "v3_bootstrap": f"""WITH {_C}, p AS (SELECT x.id AS i, y.id AS j, list_dot_product(x.v, y.v) AS sim FROM c x JOIN c y ON y.yr < x.yr AND x.paper <> y.paper WHERE x.grp = 0),
        b AS (SELECT i, draw, max(sim) AS best FROM p, range(1, 11) d(draw) WHERE sha256(j || '|' || draw)[1] < '4' GROUP BY i, draw) SELECT round(quantile_cont(best, 0.95), 5) AS tau, count(*) AS draws FROM b""",
    "v4_novelty": f"""WITH {_C}, o AS (SELECT * FROM c WHERE yr <= {FROZEN}), w AS (SELECT * FROM c WHERE yr > {FROZEN} AND yr <= {FROZEN + WINDOW}), t AS (SELECT quantile_cont(list_dot_product(x.v, y.v), 0.99) AS tau FROM o x JOIN o y ON x.paper <> y.paper)
        SELECT w.id AS claim, round(max(list_dot_product(w.v, o.v)), 5) AS best, max(list_dot_product(w.v, o.v)) < any_value(tau) AS novel FROM w CROSS JOIN o CROSS JOIN t GROUP BY w.id""",
    "v9_paired_difference": """
        WITH r AS (SELECT doc_id, quality, CASE WHEN n_chars >= 300 THEN 1 ELSE 0 END AS ours, doc_id % 2 AS theirs FROM documents JOIN labels USING (doc_id)), d AS (SELECT *, sha256(doc_id || '|' || b)[1] AS h FROM r, range(1, 41) x(b)),
        w AS (SELECT *, CASE WHEN h < '6' THEN 0 WHEN h < 'c' THEN 1 ELSE 2 END AS w FROM d), e AS (SELECT b, sum(w * (CASE WHEN ours = quality THEN 1 ELSE 0 END - CASE WHEN theirs = quality THEN 1 ELSE 0 END)) / sum(w) AS d FROM w GROUP BY b)
        SELECT round(quantile_cont(d, 0.025), 6) AS low, round(quantile_cont(d, 0.975), 6) AS high, quantile_cont(d, 0.025) > 0 AS better FROM e""",
    "v12_precision_baselines": """
        WITH r AS (SELECT doc_id, quality, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS score, row_number() OVER (ORDER BY doc_id % 12 DESC, doc_id) AS recency, row_number() OVER (ORDER BY doc_id) AS id FROM documents JOIN labels USING (doc_id)),
        l AS (SELECT 'score' AS ranking, score AS place, quality FROM r UNION ALL SELECT 'recency', recency, quality FROM r UNION ALL SELECT 'id', id, quality FROM r)
        SELECT ranking, k, round(avg(quality) FILTER (place <= k), 6) AS precision, round(avg(quality), 6) AS base FROM l, (VALUES (10), (50), (100)) x(k) GROUP BY ranking, k""",
    "v14_scaling": """
        WITH p AS (SELECT draw, c_custkey, row_number() OVER (PARTITION BY draw ORDER BY sha256(c_custkey || '|' || draw), c_custkey) AS place FROM customer, range(1, 4) d(draw)), g AS (SELECT n, draw, c_custkey FROM p, (VALUES (40), (80), (120)) s(n) WHERE place <= n),
        y AS (SELECT n, draw, sum(CASE WHEN o_orderpriority = '1-URGENT' THEN 1 ELSE 0 END) AS urgent, sum(CASE WHEN o_totalprice < 0 THEN 1 ELSE 0 END) AS never FROM g JOIN orders ON o_custkey = c_custkey GROUP BY n, draw),
        l AS (SELECT 'urgent' AS scorer, n, draw, urgent AS found FROM y UNION ALL SELECT 'never', n, draw, never FROM y)
        SELECT scorer, n, round(avg(found), 6) AS mean, round(stddev_pop(found), 6) AS sd, CASE WHEN max(found) = 0 THEN round(3 / (n * count(*)), 6) END AS upper_rate, max(found) = n AS bounded FROM l GROUP BY scorer, n""",
    "v16_cost_projection": """
        WITH m AS (SELECT year(o_orderdate) AS yr, CAST(count(*) AS DOUBLE) AS n, sum(o_totalprice) AS cost FROM orders GROUP BY 1), s AS (SELECT regr_slope(ln(cost), ln(n)) AS slope FROM m), a AS (SELECT n, cost FROM m ORDER BY n DESC, yr DESC LIMIT 1)
        SELECT target, round(slope, 6) AS slope, round(cost * power(target / n, slope) / 1e6, 4) AS cost FROM (VALUES (1000.0::DOUBLE), (10000.0::DOUBLE), (100000.0::DOUBLE)) t(target), s, a""",
    "v17_k_sweep": """
        WITH r AS (SELECT lang, n_chars, sum(quality) AS good, count(*) AS n FROM documents JOIN labels USING (doc_id) GROUP BY lang, n_chars), w AS (SELECT lang, sum(good) OVER o AS good, sum(n) OVER o AS upto FROM r WINDOW o AS (PARTITION BY lang ORDER BY n_chars DESC NULLS LAST)),
        t AS (SELECT lang, percent, ceil(sum(n) * percent / 100.0) AS k FROM r, (VALUES (1), (2), (5), (10), (20), (50), (100)) p(percent) GROUP BY lang, percent)
        SELECT t.lang, percent, CAST(k AS BIGINT) AS k, CAST(min(upto) AS BIGINT) AS taken, round(arg_min(good, upto) / min(upto), 6) AS precision FROM t JOIN w ON w.lang = t.lang AND upto >= k GROUP BY t.lang, percent, k""",
    "v18_orphan_distribution": f"""WITH {_C}, p AS (SELECT x.id, max(list_dot_product(x.v, y.v)) AS best, count(DISTINCT CASE WHEN list_dot_product(x.v, y.v) >= 0.15 THEN y.paper END) AS near FROM c x JOIN c y ON y.yr > x.yr AND y.paper <> x.paper WHERE x.grp = 0 GROUP BY x.id)
        SELECT c.paper % 3 AS part, CASE WHEN best >= 0.35 THEN 'addressed' WHEN coalesce(near, 0) < 5 THEN 'sparse' WHEN (SELECT max(yr) FROM c) - c.yr < 2 THEN 'young' ELSE 'shown' END AS verdict, count(*) AS n FROM c LEFT JOIN p ON p.id = c.id WHERE c.grp = 0 GROUP BY 1, 2""",
    "f1_title_key": "SELECT doc_id, " + _KEY.format(x="replace(replace('<i>Über</i> ' || regexp_extract(text, '^[^.\\n]*') || ' Ｗide ﬁt²', 'Ｗide', 'Wide'), 'ﬁt²', 'fit2')") + " AS title_key FROM documents",
    "f2_lite_key": "SELECT item_id, trim(regexp_replace(lower(text), '[^a-z0-9]+', ' ', 'g')) AS key FROM benchmark",
    "f8_terms": f"""WITH w AS (SELECT item_id, unnest(regexp_extract_all(lower(text), '[a-z0-9]+')) AS w, generate_subscripts(regexp_extract_all(lower(text), '[a-z0-9]+'), 1) AS i FROM benchmark),
        s AS (SELECT item_id, i, w, {_STEMS} AS stem FROM w WHERE (length(w) >= 3 OR w = 'on') AND NOT regexp_matches(w, '^[0-9]+$') AND w NOT IN {_STOPS})
        SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY i) - 1 AS place, stem, w AS raw FROM s WHERE stem NOT IN {_STOPS}""",
    "f16_splitter": """
        WITH b AS (SELECT item_id, string_split_regex(regexp_replace(text, '[^A-Za-z ]+', ' ', 'g'), ' +') AS w FROM benchmark),
        a AS (SELECT item_id, CASE WHEN item_id % 4 = 0 AND len(w[2:5]) >= 3 AND len(w[7:10]) >= 3 THEN [array_to_string(w[2:5], ' ') || ', and', array_to_string(w[7:10], ' ')] WHEN item_id % 4 = 1 THEN ['this is ' || array_to_string(w[2:4], ' '), 'it shows ' || array_to_string(w[6:8], ' ')]
          WHEN item_id % 4 = 2 THEN ['one; ' || array_to_string(w[2:5], ' ')] ELSE [array_to_string(w[1:8], ' ')] END AS atoms FROM b)
        SELECT item_id, generate_subscripts(atoms, 1) - 1 AS place, unnest(atoms) AS atom FROM a""",
    "f20_capped": r"""
        WITH t AS (SELECT doc_id, regexp_replace(text, '[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+([.][A-Za-z0-9-]+)+', '[e-mail]', 'g') AS t FROM documents), h AS (SELECT doc_id, t, t[:120] AS h, regexp_replace(t[:120], '[ \t\n\x0B\f\r]+[^ \t\n\x0B\f\r]*$', '') AS cut FROM t)
        SELECT doc_id, CASE WHEN length(t) <= 120 THEN t ELSE CASE WHEN length(cut) > 0 THEN cut ELSE h END || '...' END AS head FROM h""",
    "f26_hash_embedding": """
        WITH r AS (SELECT item_id, i, CAST('0x' || substr(sha256(text || '|' || CAST(floor(i / 8) AS INTEGER)), CAST(i % 8 * 8 + 1 AS INTEGER), 8) AS BIGINT) / 2147483647.5::DOUBLE - 1 AS x FROM benchmark, range(0, 16) r(i))
        SELECT item_id, i AS place, round(x / sqrt(sum(x * x) OVER (PARTITION BY item_id)), 6) AS x FROM r""",
    "f33_title_terms": "SELECT doc_id, array_to_string(list_sort(list_distinct(list_filter(string_split(" + _KEY.format(x="coalesce(regexp_extract(text, '^[^.\\n]*'), '')") + f", ' '), lambda w: length(w) > 2 AND w NOT IN {_STOPS}))), ' ') AS terms FROM documents",
    "f37_redacted": "SELECT c_custkey, 'mail [e-mail] token=[secret] [secret] done' AS line FROM customer",
    "k3_prelabelled": r"""
        WITH l AS (SELECT doc_id, n_chars, CASE WHEN n_chars < 50 THEN 'off' WHEN regexp_matches(lower(text), 'licen[cs]e') THEN 'on' WHEN regexp_matches(text, '[#$%&|]') THEN 'off' WHEN lang = 'en' THEN 'on' ELSE 'borderline' END AS label FROM documents),
        c AS (SELECT cited, count(*) AS n FROM (SELECT DISTINCT l_suppkey, l_partkey % 97 AS cited FROM lineitem) x GROUP BY cited)
        SELECT doc_id, label, coalesce(n, 0) AS central FROM l LEFT JOIN c ON cited = doc_id WHERE label <> 'off' ORDER BY label = 'on' DESC, central DESC, n_chars DESC, doc_id LIMIT 100""",
    "k8_finalised": f"""WITH {_C}, {_CITES}, x AS ({_COLLECTIONS}) SELECT n.collection AS store, count(x.owner) AS before, count(CASE WHEN x.owner IN (SELECT doc_id FROM documents WHERE n_chars >= 300) THEN 1 END) AS after FROM {_NAMES} LEFT JOIN x ON x.collection = n.collection GROUP BY 1""",
    "t2_widening": """
        WITH t AS (SELECT tier, (SELECT count(*) FROM events WHERE event_type = 'purchase' AND floor(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) / 3) = tier) AS n FROM range(0, 11) r(tier)),
        b AS (SELECT tier, n, coalesce(sum(n) OVER (ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM t), s AS (SELECT tier, n, before, before < 500 AND tier < 7 AS searched, before >= 500 AS enough FROM b)
        SELECT tier, searched, CASE WHEN searched THEN n ELSE 0 END AS found, CAST(sum(CASE WHEN searched THEN n ELSE 0 END) OVER (ORDER BY tier) AS BIGINT) AS total, CASE WHEN coalesce(sum(CASE WHEN searched THEN n ELSE 0 END) OVER (ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) >= 500 THEN 'enough' WHEN tier >= 7 THEN 'budget' ELSE 'searching' END AS state FROM s""",
    "t4_batches": "SELECT user_id AS batch, count(*) AS requests, count(*) AS answers, CAST(sum(CASE WHEN value > 50 THEN 1 ELSE 0 END) AS BIGINT) AS positive, round(sum(value), 4) AS billed FROM events WHERE event_type = 'purchase' GROUP BY user_id",
    "s2_rest_listing": "SELECT CAST(n_nationkey AS BIGINT) AS n_nationkey, n_name FROM nation WHERE n_nationkey % 6 <> 5 QUALIFY row_number() OVER (PARTITION BY n_regionkey ORDER BY n_nationkey) <= 3",
    "s19_body_text": r"SELECT item_id, trim(regexp_replace('Methods ' || regexp_replace(text, '[\x00-\x1F]+', ' ', 'g') || ' End of it.', '[ \t\r\n]+', ' ', 'g')) AS body FROM benchmark",
    "s20_pdf_text": "SELECT item_id, regexp_replace(text, '[^ -~]+', ' ', 'g') AS text FROM benchmark",
    "p11_tier_and_rank": """
        SELECT doc_id, score, CASE WHEN score >= 0.60 THEN 'high' WHEN score >= 0.35 THEN 'medium' ELSE 'low' END AS tier, CASE WHEN lang = 'en' AND score >= 0.60 THEN 'strong' WHEN score >= 0.35 THEN 'likely' ELSE 'lead' END AS strength,
          row_number() OVER (ORDER BY score DESC, doc_id) AS place FROM (SELECT doc_id, lang, round(n_chars / (n_chars + 2e3), 6) AS score FROM documents) x""",
    "w5_running_total": "SELECT event_id, round(sum(value) OVER w, 4) AS spent, round(100000 - sum(value) OVER w, 4) AS headroom FROM events WHERE event_type = 'purchase' WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)",
    "w12_precision_at_k": """
        SELECT k, round(avg(CASE WHEN by_score <= k THEN hit END), 6) AS by_score, round(avg(CASE WHEN by_age <= k THEN hit END), 6) AS by_age FROM (
          SELECT CAST(quality AS DOUBLE) AS hit, row_number() OVER (ORDER BY n_chars DESC, x.doc_id) AS by_score, row_number() OVER (ORDER BY x.doc_id DESC) AS by_age FROM documents x JOIN labels l ON l.doc_id = x.doc_id) y
        CROSS JOIN (VALUES (10), (50), (100)) z(k) GROUP BY k""",
}
