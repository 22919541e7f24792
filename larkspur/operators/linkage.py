"""Institutions against the sponsor register: candidates, decisions, and what people decided by hand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import classify, text

# The similarity that counts as a find, how many candidates are kept, the confidence of a normalised match.
THRESHOLD, MOST, NORMALISED = 0.62, 8, 0.95


def longest_tokens(name: Column, most: int = 2) -> Column:
    """The longest core tokens of four or more letters; of equally long ones the alphabetically first."""
    by_length = lambda a, b: F.when(F.length(a) != F.length(b), F.length(b) - F.length(a)).when(a < b, -1).when(a > b, 1).otherwise(0)
    return F.filter(F.slice(F.array_sort(text.core_tokens(text.normalise_name(name)), by_length), 1, most), lambda t: F.length(t) >= 4)


def _rare_grams(names: DataFrame, register: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """(name, n, gram) and (register_name, m, gram) cut to the grams that a pair of the least similarity must share one of.

    Grams are ranked from the rarest on. Two sets of n and m grams with a Jaccard similarity of at least t share
    at least ceil(t * max(n, m)), so one of the first n - ceil(t * n) + 1 of either is shared.
    """
    left = names.select("name", text.trigrams(F.col("name")).alias("grams"))
    right = register.select("register_name", text.trigrams(F.col("register_name")).alias("grams"))
    counts = right.select(F.explode("grams").alias("gram")).groupBy("gram").agg(F.count("*").alias("times"))

    def first(df: DataFrame, key: str) -> DataFrame:
        each = df.select(key, F.size("grams").alias("n"), F.explode("grams").alias("gram")).join(counts, "gram", "left")
        ranked = each.groupBy(key, "n").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("times", F.lit(0)).alias("times"), "gram"))).alias("g"))
        kept = F.slice("g", F.lit(1), (F.col("n") - F.ceil(F.lit(least) * F.col("n")) + 1).cast("int"))
        return ranked.select(key, F.explode(kept).alias("x")).select(key, F.col("x.gram").alias("gram"))

    return first(left, "name"), first(right, "register_name")


def candidate_pairs(names: DataFrame, register: DataFrame, least: float = THRESHOLD / 2) -> DataFrame:
    """(name, register_name, similarity): register names alike enough, or holding one of the name's two longest core tokens."""
    n, r = names.select("name").distinct(), register.select("register_name").distinct()
    left, right = _rare_grams(n, r, least)
    alike = left.join(right, "gram").select("name", "register_name").distinct()
    tokens = n.select("name", F.explode(longest_tokens(F.col("name"))).alias("token"))
    # A token of four or more letters that stands anywhere in a register name starts with one of its runs of four letters.
    places = F.sequence(F.lit(1), F.length("low") - 3)
    runs = r.withColumn("low", F.lower("register_name")).where(F.length("low") >= 4).select("register_name", "low", F.explode(F.array_distinct(F.transform(places, lambda i: F.substring(F.col("low"), i, F.lit(4))))).alias("head"))
    holds = tokens.withColumn("head", F.substring("token", 1, 4)).join(runs, "head").where(F.contains("low", "token")).select("name", "register_name").distinct()
    pairs = alike.unionByName(holds.withColumn("held", F.lit(True)), allowMissingColumns=True).groupBy("name", "register_name").agg(F.coalesce(F.max("held"), F.lit(False)).alias("held"))
    scored = pairs.withColumn("similarity", text.trigram_similarity(F.col("name"), F.col("register_name")))
    return scored.where((F.col("similarity") >= least) | F.col("held")).drop("held")


def candidates(names: DataFrame, register: DataFrame, most: int = MOST, least: float = THRESHOLD / 2) -> DataFrame:
    """JOIN-11 and STR-08: the most similar of candidate_pairs() for each name, ties by register name."""
    pairs = candidate_pairs(names, register, least)
    best = F.slice(F.array_sort(F.collect_list(F.struct((-F.col("similarity")).alias("far"), "register_name"))), 1, most)
    kept = pairs.groupBy("name").agg(best.alias("best")).select("name", F.explode("best").alias("b"))
    return kept.select("name", F.col("b.register_name").alias("register_name"), (-F.col("b.far")).alias("similarity"))


def ranked(found: DataFrame) -> DataFrame:
    """ORD-04: candidates with their score, the better of both similarities, and their place: best first, then shorter, then by name."""
    scored = found.withColumn("score", F.greatest("similarity", text.name_similarity(F.col("name"), F.col("register_name"))))
    order = Window.partitionBy("name").orderBy(F.desc("score"), F.length("register_name"), "register_name")
    return scored.withColumn("place", F.row_number().over(order))


def decide(names: DataFrame, found: DataFrame, register: DataFrame, threshold: float = THRESHOLD) -> DataFrame:
    """STR-09: a decision for each of names (name) from candidates() and register (register_name, type_rating, route).

    The same name, or the same name or core tokens once normalised, decides; anything weaker is for a person to review.
    (name, verdict, matched_name, method, confidence, needs_review, candidates)
    """
    of = ranked(found).join(register.select("register_name", classify.sponsor_verdict(F.col("type_rating"), F.col("route")).alias("entry")), "register_name")
    exact = F.trim("register_name") == F.trim("name")
    left, right = text.normalise_name(F.col("name")), text.normalise_name(F.col("register_name"))
    same = (left == right) | (text.core_tokens(left) == text.core_tokens(right))
    rung = F.when(exact, 0).when(same, 1).otherwise(2)
    rows = of.select("name", F.struct(rung.alias("rung"), "place", "register_name", "entry").alias("first"), F.struct("place", "register_name").alias("listed"), "score")
    best = rows.groupBy("name").agg(F.min("first").alias("first"), F.max("score").alias("best"), F.array_sort(F.collect_list("listed")).alias("listed"))
    d, rung = names.select("name").distinct().join(best, "name", "left"), F.coalesce("first.rung", F.lit(2))
    score = F.coalesce("best", F.lit(0.0))
    return d.select(
        "name", F.when(rung < 2, F.col("first.entry")).otherwise("NOT_FOUND").alias("verdict"), F.when(rung < 2, F.col("first.register_name")).alias("matched_name"),
        F.when(rung == 0, "EXACT").when(rung == 1, "NORMALISED").when(score >= threshold, "TRIGRAM").otherwise("NONE").alias("method"),
        F.when(rung == 0, 1.0).when(rung == 1, NORMALISED).otherwise(score).alias("confidence"), (rung == 2).alias("needs_review"),
        F.coalesce(F.col("listed.register_name"), F.array().cast("array<string>")).alias("candidates"),
    )


def search_register(register: DataFrame, query: str, limit: int = 25) -> DataFrame:
    """FLT-19: register names that contain what was typed, or are 0.3 alike, best first."""
    typed = query.strip()
    rows = register.select("register_name", text.trigram_similarity(F.col("register_name"), F.lit(query)).alias("similarity"))
    found = rows.where(F.lit(bool(typed)) & (F.contains(F.lower("register_name"), F.lower(F.lit(typed))) | (F.col("similarity") >= 0.3)))
    return found.orderBy(F.desc("similarity"), "register_name").limit(limit)


def updated_matches(matches: DataFrame, decisions: DataFrame) -> DataFrame:
    """STR-12: matches (institution_id, ..., resolved_by_human) with new decisions, except where a person has decided."""
    settled = matches.where("resolved_by_human")
    columns = [c for c in matches.columns if c != "resolved_by_human"]
    fresh = decisions.select(*columns).join(settled.select("institution_id"), "institution_id", "left_anti").select(*columns, F.lit(False).alias("resolved_by_human"))
    rest = matches.where("NOT resolved_by_human").join(decisions.select("institution_id"), "institution_id", "left_anti")
    return settled.unionByName(fresh).unionByName(rest)


def resolved(matches: DataFrame, answers: DataFrame) -> DataFrame:
    """STR-12 and API-06: what a person answered (institution_id, registered_legal_name, verdict) replaces whatever was there."""
    human = answers.select("institution_id", "registered_legal_name", "verdict", F.lit("HUMAN").alias("method"), F.lit(1.0).alias("confidence"), F.lit(False).alias("needs_review"), F.lit(True).alias("resolved_by_human"))
    rest = matches.select(*human.columns).join(answers.select("institution_id"), "institution_id", "left_anti")
    return rest.unionByName(human)


def review_queue(institutions: DataFrame, matches: DataFrame) -> DataFrame:
    """FLT-20 and JOIN-12: institutions whose match needs a person, or that have none."""
    m = matches.select("institution_id", "needs_review")
    return institutions.join(m, "institution_id", "left").where(F.coalesce("needs_review", F.lit(True))).drop("needs_review")


def compare_registers(previous: DataFrame, current: DataFrame, matches: DataFrame) -> DataFrame:
    """JOIN-17 and SET-01: (register_name, side) of matched names on one register alone."""
    ours = matches.where("registered_legal_name <> ''").select(F.col("registered_legal_name").alias("register_name")).distinct()
    old, new = (r.select("register_name").distinct().join(ours, "register_name", "left_semi") for r in (previous, current))
    gone, come = old.join(new, "register_name", "left_anti"), new.join(old, "register_name", "left_anti")
    return gone.withColumn("side", F.lit("dropped_off")).unionByName(come.withColumn("side", F.lit("newly_listed")))


def seeded_matches(institutions: DataFrame, seeds: DataFrame) -> DataFrame:
    """SRC-04 and JOIN-19: matches from a seed file (slug, register_status, type_rating, routes, registered_legal_name).

    Rows whose slug no institution has come with a null institution_id, so that they can be counted as skipped.
    """
    s = seeds.join(institutions.select("slug", "institution_id"), "slug", "left")
    told = classify.seed_verdict(F.col("register_status"), F.col("type_rating"), F.col("routes"))
    name = F.coalesce("registered_legal_name", F.lit(""))
    s = s.select("slug", "institution_id", name.alias("registered_legal_name"), told.alias("told"))
    return s.select("slug", "institution_id", "registered_legal_name", "told.verdict", F.lit("SEED").alias("method"), F.when(name != "", 1.0).otherwise(0.0).alias("confidence"), "told.needs_review")


def refresh(names: DataFrame, register: DataFrame, previous: DataFrame, matches: DataFrame) -> tuple[DataFrame, DataFrame]:
    """API-18: the decisions of a new register, and which matched names came or went."""
    return decide(names, candidates(names, register), register), compare_registers(previous, register, matches)
