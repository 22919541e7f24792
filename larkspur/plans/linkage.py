"""Queries over names, the sponsor register and institutions."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import classify, text
from larkspur.operators import institutions, linkage, records
from larkspur.plans.registry import query
from larkspur.sources import files

_NORMAL = r"regexp_replace(trim(regexp_replace({0}, '\s+', ' ', 'g')), '^the\s+', '')"


def normalised(name: str) -> str:
    """normalise_name() as SQL."""
    out = rf"trim(regexp_replace(regexp_replace(replace(regexp_replace(strip_accents(lower({name})), '\([^)]*\)', ' ', 'g'), '&', ' and '), '[^\w\s]', ' ', 'g'), '\s+', ' ', 'g'))"
    for suffix in text.SUFFIXES:
        out = rf"regexp_replace({out}, '{suffix}', ' ', 'g')"
    return _NORMAL.format(out)


_QUOTED = lambda words: ", ".join(f"'{w}'" for w in words)
_WORDS = lambda n: f"list_filter(string_split({n}, ' '), lambda t: t <> '')"
CORE = lambda n: f"list_sort(list_distinct(list_filter({_WORDS(n)}, lambda t: t NOT IN ({_QUOTED(text.STOPWORDS + text.GENERIC)}))))"
GRAMS = "list_distinct(flatten(list_transform(list_filter(string_split(regexp_replace(lower({0}), '[^a-z0-9_]+', ' ', 'g'), ' '), lambda w: w <> ''), lambda w: list_transform(range(1, length(w) + 2), lambda i: substring(concat('  ', w, ' '), i, 3)))))"
ALIKE = "CASE WHEN len({0}) + len({1}) = 0 THEN 0.0 ELSE len(list_intersect({0}, {1})) / len(list_distinct(list_concat({0}, {1}))) END"
_SHARED = "len(list_intersect(a.core, b.core))"
#: Names of the tables hold no acronyms, so the short form's rung of name_similarity() is never reached here.
NAMED = f"CASE WHEN len(a.core) = 0 OR len(b.core) = 0 THEN 0.0 WHEN a.core = b.core THEN 1.0 ELSE 0.75 * {_SHARED} / least(len(a.core), len(b.core)) + 0.25 * {_SHARED} / len(list_distinct(list_concat(a.core, b.core))) END"
_READY = f"""names AS (SELECT DISTINCT name FROM named WHERE p_partkey % 20 = 0), lefts AS (SELECT name, {normalised('name')} AS plain, {GRAMS.format('name')} AS grams FROM names), a_ AS (SELECT *, {CORE('plain')} AS core FROM lefts),
 rights AS (SELECT register_name, min(type_rating) AS type_rating, min(route) AS route, {normalised('register_name')} AS plain, {GRAMS.format('register_name')} AS grams FROM register GROUP BY register_name), b_ AS (SELECT *, {CORE('plain')} AS core FROM rights),
 tokens AS (SELECT name, list_filter(list_transform(list_sort(list_transform(core, lambda t: (-length(t), t)))[1:2], lambda x: x[2]), lambda t: length(t) >= 4) AS longest FROM a_),
 pairs AS (SELECT a.name, b.register_name, {ALIKE.format('a.grams', 'b.grams')} AS similarity, {NAMED} AS named_alike, a.plain = b.plain OR a.core = b.core AS same, b.type_rating, b.route
 FROM a_ a CROSS JOIN b_ b JOIN tokens t ON t.name = a.name WHERE {ALIKE.format('a.grams', 'b.grams')} >= 0.31 OR len(list_filter(t.longest, lambda w: contains(lower(b.register_name), w))) > 0),
 best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY name ORDER BY similarity DESC, register_name) AS n FROM pairs) WHERE n <= 8)"""


def _register(r):
    """One row a name."""
    return r.groupBy("register_name").agg(F.min("type_rating").alias("type_rating"), F.min("route").alias("route"))


def _some(n):
    return n.where("p_partkey % 20 = 0").select("name").distinct()


query("str_02_normalised_names", "named", f"SELECT p_partkey, {normalised('name')} AS normalised FROM named", lambda n: n.select("p_partkey", text.normalise_name(F.col("name")).alias("normalised")))
query("str_04_core_tokens", "named", f"SELECT p_partkey, array_to_string({CORE(normalised('name'))}, ' ') AS core FROM named", lambda n: n.select("p_partkey", F.array_join(text.core_tokens(text.normalise_name(F.col("name"))), " ").alias("core")))
query("str_05_acronyms", "named", f"SELECT p_partkey, array_to_string(list_transform(list_filter({_WORDS(normalised('name'))}, lambda t: t NOT IN ({_QUOTED(text.STOPWORDS)})), lambda t: substring(t, 1, 1)), '') AS acronym FROM named",
      lambda n: n.select("p_partkey", text.acronym(text.normalise_name(F.col("name"))).alias("acronym")))
query("str_06_name_similarity", "named", f"SELECT p_partkey, round({NAMED}, 6) AS score FROM (SELECT p_partkey, {CORE(normalised('name'))} AS core FROM named) a, (SELECT {CORE(normalised(chr(39) + 'University of the Blue Steel Works' + chr(39)))} AS core) b",
      lambda n: n.select("p_partkey", F.round(text.name_similarity(F.col("name"), F.lit("University of the Blue Steel Works")), 6).alias("score")))
query("str_07_trigram_similarity", "named", f"SELECT p_partkey, round({ALIKE.format('a', 'b')}, 6) AS similarity FROM (SELECT p_partkey, {GRAMS.format('name')} AS a, {GRAMS.format(chr(39) + 'university of spring' + chr(39))} AS b FROM named)",
      lambda n: n.select("p_partkey", F.round(text.trigram_similarity(F.col("name"), F.lit("university of spring")), 6).alias("similarity")))
query("str_10_entry_verdict", "register", """SELECT register_name, CASE WHEN NOT contains(lower(route), 'skilled worker') THEN 'OTHER_ROUTE_ONLY' WHEN contains(lower(type_rating), 'provisional') THEN 'PROVISIONAL' WHEN contains(lower(type_rating), 'b rating') THEN 'B_RATED' ELSE 'CONFIRMED' END AS verdict FROM register""",
      lambda r: r.select("register_name", classify.sponsor_verdict(F.col("type_rating"), F.col("route")).alias("verdict")))
query("join_11_register_candidates", "named register", "SELECT name, register_name, round(similarity, 6) AS similarity FROM best", lambda n, r: linkage.candidates(_some(n), _register(r)).select("name", "register_name", F.round("similarity", 6).alias("similarity")), _READY)
query("ord_04_ranked_candidates", "named register", "SELECT name, register_name, row_number() OVER (PARTITION BY name ORDER BY greatest(similarity, named_alike) DESC, length(register_name), register_name) AS place FROM best",
      lambda n, r: linkage.ranked(linkage.candidates(_some(n), _register(r))).select("name", "register_name", "place"), _READY)
_VERDICT = "CASE WHEN NOT contains(lower(route), 'skilled worker') THEN 'OTHER_ROUTE_ONLY' WHEN contains(lower(type_rating), 'provisional') THEN 'PROVISIONAL' WHEN contains(lower(type_rating), 'b rating') THEN 'B_RATED' ELSE 'CONFIRMED' END"
query("str_09_sponsor_decision", "named register", f"""SELECT n.name, CASE WHEN rung < 2 THEN entry ELSE 'NOT_FOUND' END AS verdict, CASE WHEN rung < 2 THEN register_name END AS matched_name,
 CASE WHEN rung = 0 THEN 'EXACT' WHEN rung = 1 THEN 'NORMALISED' WHEN top >= 0.62 THEN 'TRIGRAM' ELSE 'NONE' END AS method, round(CASE WHEN rung = 0 THEN 1.0 WHEN rung = 1 THEN 0.95 ELSE coalesce(top, 0.0) END, 6) AS confidence, coalesce(rung, 2) = 2 AS needs_review,
 coalesce(listed, '') AS candidates FROM names n LEFT JOIN (SELECT name, min(rung) AS rung, arg_min(register_name, (rung, place)) AS register_name, arg_min(entry, (rung, place)) AS entry, max(score) AS top, string_agg(register_name, '|' ORDER BY place) AS listed
 FROM (SELECT *, CASE WHEN trim(name) = trim(register_name) THEN 0 WHEN same THEN 1 ELSE 2 END AS rung, {_VERDICT} AS entry, greatest(similarity, named_alike) AS score,
 row_number() OVER (PARTITION BY name ORDER BY greatest(similarity, named_alike) DESC, length(register_name), register_name) AS place FROM best) GROUP BY name) d ON d.name = n.name""",
      lambda n, r: linkage.decide(_some(n), linkage.candidates(_some(n), _register(r)), _register(r)).withColumns({"confidence": F.round("confidence", 6), "candidates": F.array_join("candidates", "|")}), _READY)
query("flt_19_register_search", "register", f"SELECT register_name FROM (SELECT DISTINCT register_name, {ALIKE.format(GRAMS.format('register_name'), GRAMS.format(chr(39) + 'gear' + chr(39)))} AS s FROM register) WHERE contains(lower(register_name), 'gear') OR s >= 0.3 ORDER BY s DESC, register_name LIMIT 25",
      lambda r: linkage.search_register(_register(r), "Gear").select("register_name"))
query("flt_20_review_queue", "institution match", "SELECT i.institution_id FROM institution i LEFT JOIN match m USING (institution_id) WHERE coalesce(m.needs_review, true)", lambda i, m: linkage.review_queue(i, m).select("institution_id"))
query("str_12_updated_matches", "match", "SELECT institution_id, CASE WHEN institution_id % 3 = 0 AND NOT resolved_by_human THEN 'PROVISIONAL' ELSE verdict END AS verdict, resolved_by_human FROM match UNION ALL SELECT 100008, 'PROVISIONAL', false",
      lambda m: linkage.updated_matches(m, _decisions(m)).select("institution_id", "verdict", "resolved_by_human"))
query("str_12_resolved_by_hand", "match", "SELECT institution_id, CASE WHEN institution_id % 9 = 1 THEN 'CONFIRMED_VIA_PARENT' ELSE verdict END AS verdict, CASE WHEN institution_id % 9 = 1 THEN 'HUMAN' ELSE method END AS method, institution_id % 9 = 1 OR resolved_by_human AS resolved_by_human FROM match",
      lambda m: linkage.resolved(m, m.where("institution_id % 9 = 1").select("institution_id", F.lit("Parent").alias("registered_legal_name"), F.lit("CONFIRMED_VIA_PARENT").alias("verdict"))).select("institution_id", "verdict", "method", "resolved_by_human"))


def _decisions(m):
    rows = m.where("institution_id % 3 = 0").unionByName(m.limit(1).withColumn("institution_id", F.lit(100008).cast(m.schema["institution_id"].dataType)))
    return rows.withColumn("verdict", F.lit("PROVISIONAL"))


query("join_12_institution_match", "institution match", "SELECT i.institution_id, m.verdict FROM institution i LEFT JOIN match m USING (institution_id)", lambda i, m: i.join(m, "institution_id", "left").select("institution_id", "verdict"))
query("join_17_register_changes", "register match", """SELECT DISTINCT register_name, CASE WHEN length(register_name) % 3 = 0 THEN 'newly_listed' ELSE 'dropped_off' END AS side FROM register WHERE length(register_name) % 3 < 2 AND length(register_name) % 2 = 0""",
      lambda r, m: linkage.compare_registers(r.where("length(register_name) % 3 <> 0"), r.where("length(register_name) % 3 <> 1"), r.where("length(register_name) % 2 = 0").select(F.col("register_name").alias("registered_legal_name"))))
query("src_02_register_rows", "named", f"SELECT trim(concat(' ', name, ' ')) AS organisation_name, CASE WHEN p_partkey % 2 = 0 THEN 'Bath' ELSE 'Leeds' END AS town_city, {normalised('name')} AS normalised_name FROM named WHERE p_partkey % 3 <> 0 OR p_partkey % 2 = 1",
      lambda n: files.register_rows(n.selectExpr("CASE WHEN p_partkey % 3 = 0 THEN ' ' WHEN p_partkey % 2 = 0 THEN concat(' ', name, ' ') END AS `﻿Organisation Name`", "CASE WHEN p_partkey % 2 = 1 THEN name ELSE '' END AS organisation_name",
                                                 "CASE WHEN p_partkey % 2 = 0 THEN 'Bath' END AS `Town/City`", "' Leeds ' AS town_city")).where("organisation_name <> ''").select("organisation_name", "town_city", "normalised_name"))
query("src_04_seeded_matches", "institution", """SELECT slug, CASE WHEN institution_id % 4 <> 0 THEN institution_id END AS institution_id, CASE WHEN institution_id % 2 = 0 THEN 'CONFIRMED' ELSE 'NOT_FOUND' END AS verdict, institution_id % 2 = 1 AS needs_review, CASE WHEN institution_id % 5 = 0 THEN 0.0 ELSE 1.0 END AS confidence FROM institution""",
      lambda i: linkage.seeded_matches(i.where("institution_id % 4 <> 0"), i.selectExpr("slug", "CASE WHEN institution_id % 2 = 0 THEN 'On Register ' ELSE 'VIA PARENT' END AS register_status", "'Worker (A rating)' AS type_rating", "'Skilled Worker' AS routes", "CASE WHEN institution_id % 5 = 0 THEN NULL ELSE name END AS registered_legal_name")).select("slug", "institution_id", "verdict", "needs_review", "confidence"))
query("src_03_seeded_institutions", "institution", "SELECT slug, CASE WHEN institution_id % 3 = 0 THEN 'created' WHEN institution_id % 5 = 0 THEN 'updated' ELSE 'unchanged' END AS state FROM institution",
      lambda i: files.seeded(i.where("institution_id % 3 <> 0"), i.withColumn("city", F.when(F.col("institution_id") % 5 == 0, "Elsewhere").otherwise(F.col("city")))))
query("src_03_after_seeding", "institution", "SELECT slug, CASE WHEN institution_id % 7 = 0 THEN 'Elsewhere' ELSE city END AS city, CASE WHEN institution_id % 7 = 0 AND institution_id % 2 <> 0 THEN true ELSE crawl_enabled END AS crawl_enabled FROM institution",
      lambda i: files.seed_institutions(i.where("institution_id % 7 <> 0 OR institution_id % 2 = 0"), i.where("institution_id % 7 = 0").withColumn("city", F.lit("Elsewhere"))).select("slug", "city", "crawl_enabled"))
query("prj_05_effective_platform", "institution", "SELECT institution_id, CASE WHEN adapter_override <> '' THEN adapter_override ELSE platform END AS effective FROM institution", lambda i: i.select("institution_id", institutions.effective_platform(F.col("adapter_override"), F.col("platform")).alias("effective")))
query("prj_06_careers_host", "institution", "SELECT institution_id, CASE WHEN careers_url = '' THEN '' ELSE lower(string_split(string_split(careers_url, '//')[2], '/')[1]) END AS host FROM institution", lambda i: i.select("institution_id", institutions.careers_host(F.col("careers_url")).alias("host")))
query("ext_17_homepages", "institution", "SELECT institution_id, CASE WHEN website <> '' THEN website WHEN careers_url = '' THEN '' ELSE concat(regexp_extract(careers_url, '^[^/]+//[^/]+'), '/') END AS homepage FROM institution", lambda i: i.select("institution_id", institutions.homepage(F.col("website"), F.col("careers_url")).alias("homepage")))
query("str_26_slugs", "institution", "SELECT institution_id, regexp_replace(regexp_replace(lower(name), '[^a-z0-9\\s_-]', '', 'g'), '[-\\s]+', '-', 'g') AS slug FROM institution", lambda i: i.select("institution_id", text.slugify(F.col("name")).alias("slug")))
query("api_04_assigned", "institution", "SELECT institution_id FROM institution WHERE institution_id % 6 = 2", lambda i: institutions.assigned(i, i.select("institution_id", (F.col("institution_id") % 6).alias("user")), 2).select("institution_id"))
query("api_07_new_careers_page", "institution", "SELECT institution_id, CASE WHEN institution_id = 3 THEN 'UNKNOWN' ELSE platform END AS platform, CASE WHEN institution_id = 3 THEN 'https://new/' ELSE careers_url END AS careers_url FROM institution",
      lambda i: institutions.updated(i, 3, "ADMIN", {"careers_url": "https://new/"}).select("institution_id", "platform", "careers_url"))
query("api_08_deleted", "institution job", "SELECT institution_id FROM institution WHERE institution_id <> 3", lambda i, j: institutions.deleted(i, j.where("institution_id <> 3"), 3).select("institution_id"))
query("api_09_verdict_list", "institution match", "SELECT i.institution_id, i.name, m.verdict, m.method FROM institution i JOIN match m USING (institution_id)", lambda i, m: institutions.verdict_list(i, m).select("institution_id", "name", "verdict", "method"))
query("agg_23_health", "institution job run", """SELECT (SELECT count(*) FROM institution) AS institutions, (SELECT count(*) FROM job) AS jobs, (SELECT count(*) FROM institution WHERE institution_id % 6 = 0) AS active_rulesets, (SELECT count(*) FROM job WHERE job_id % 9 = 0) AS unscreened,
 (SELECT count(DISTINCT run_id) FROM run WHERE run_id % 3 = 0 AND run_id % 120 > 30) AS stuck_runs, (SELECT count(*) FROM run WHERE outcome <> 'OK' AND run_id = (SELECT arg_max(run_id, (started_at, run_id)) FROM run)) AS not_ok,
 (SELECT CASE WHEN arg_max(run_id, (started_at, run_id)) % 3 = 0 THEN 'RUNNING' ELSE 'COMPLETE' END FROM run) AS last_status""", lambda i, j, r: _health(i, j, r))


def _health(i: DataFrame, j: DataFrame, r: DataFrame) -> DataFrame:
    now = F.lit("2024-05-10 12:00:00").cast("timestamp")
    runs = r.groupBy("run_id").agg(F.max("started_at").alias("started_at")).withColumns({"status": F.expr("CASE WHEN run_id % 3 = 0 THEN 'RUNNING' ELSE 'COMPLETE' END"), "heartbeat_at": now - F.make_dt_interval(mins=F.col("run_id").cast("int") % 120)})
    return institutions.health(i, j, j.where("job_id % 9 <> 0"), i.select((F.col("institution_id") % 6 == 0).alias("is_active")), runs, r, now)


query("api_07_fields_by_role", "institution", "SELECT institution_id, CASE WHEN institution_id = 4 THEN 'seen to' ELSE notes END AS notes, name FROM institution", lambda i: institutions.updated(i, 4, "MANAGER", {"notes": "seen to", "name": "no"}).select("institution_id", "notes", "name"))
query("api_07_by_a_recruiter", "institution", "SELECT institution_id, website, CASE WHEN institution_id = 4 THEN '1 Road' ELSE '' END AS address FROM institution", lambda i: institutions.updated(i.withColumn("address", F.lit("")), 4, "RECRUITER", {"address": "1 Road", "website": "no"}, i.select("institution_id", (F.col("institution_id") % 6).alias("user")), 4).select("institution_id", "website", "address"))
query("ord_07_attention", "run institution", """SELECT i.institution_id, CASE WHEN r.outcome IS NULL THEN 1 WHEN r.outcome <> 'OK' OR r.dropped THEN 0 WHEN r.fallback_fired THEN 2 ELSE 3 END AS rank FROM institution i
 LEFT JOIN (SELECT institution_id, arg_max(outcome, (started_at, run_id)) AS outcome, arg_max(fallback_fired, (started_at, run_id)) AS fallback_fired,
 arg_max(vacancies_found = 0 AND coalesce(p, 0) > 0, (started_at, run_id)) AS dropped FROM (SELECT *, lag(vacancies_found) OVER (PARTITION BY institution_id ORDER BY started_at, run_id) AS p FROM run WHERE institution_id % 5 <> 0) GROUP BY institution_id) r USING (institution_id)""",
      lambda r, i: i.join(records.last_crawls(r.where("institution_id % 5 <> 0")), "institution_id", "left").select("institution_id", institutions.attention(F.col("last_crawl")).alias("rank")))
