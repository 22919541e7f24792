"""Queries over the smaller parts that the others are made of."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.functions import classify, fitness, text
from larkspur.operators import insights, linkage, profiles, records, screening, search, tracking
from larkspur.plans.linkage import _register, _some, _WORDS, normalised
from larkspur.plans.registry import query
from larkspur.plans.searching import _mine

_NAME = lambda: text.normalise_name(F.col("name"))
query("str_01_without_accents", "documents", "SELECT doc_id, replace(strip_accents(lower(text)), 'ß', 'ss') AS plain FROM documents", lambda d: d.select("doc_id", text.strip_accents(F.lower("text")).alias("plain")))
query("str_03_tokens", "named", f"SELECT p_partkey, array_to_string({_WORDS(normalised('name'))}, '|') AS tokens FROM named", lambda n: n.select("p_partkey", F.array_join(text.tokens(_NAME()), "|").alias("tokens")))
query("set_07_token_sets", "named", f"""SELECT p_partkey, len(list_intersect(a, b)) AS shared, len(list_distinct(list_concat(a, b))) AS either FROM (SELECT p_partkey, list_distinct({_WORDS(normalised('name'))}) AS a, ['blue', 'university', 'of'] AS b FROM named)""",
      lambda n: n.select("p_partkey", F.array_distinct(text.tokens(_NAME())).alias("a"), F.array(*map(F.lit, ["blue", "university", "of"])).alias("b")).select("p_partkey", F.size(F.array_intersect("a", "b")).cast("long").alias("shared"), F.size(F.array_union("a", "b")).cast("long").alias("either")))
query("set_09_merged_lists", "nation", "SELECT n_nationkey, concat('a,b', CASE WHEN n_nationkey % 2 = 0 THEN ',c' ELSE '' END) AS merged FROM nation", lambda n: n.select("n_nationkey", F.array_join(profiles.merged(F.array(F.lit("a"), F.lit("b"), F.lit("a")), F.expr("CASE WHEN n_nationkey % 2 = 0 THEN array('b', 'c') ELSE array('b') END")), ",").alias("merged")))
query("str_14_search_terms", "nation", "SELECT n_nationkey, concat('c++,node.js,key', CASE WHEN n_nationkey >= 10 THEN concat(',', n_nationkey) ELSE '' END) AS terms FROM nation", lambda n: n.select("n_nationkey", F.array_join(text.search_terms(F.concat(F.lit(" The C++ and node.js. job, Key_"), "n_nationkey", F.lit(" c++"))), ",").alias("terms")))
_LONG = "concat(repeat('long ', 60 + CAST(n_nationkey AS INTEGER)), 'cannot offer sponsorship ', repeat('tail ', 40))"
query("str_21_excerpts", "nation", "SELECT n_nationkey, concat('… ', repeat('long ', 22), 'cannot offer sponsorship ', repeat('tail ', 21), 'tail …') AS quote FROM nation", lambda n: n.select("n_nationkey", text.exclusion_sentence(F.expr(_LONG)).alias("quote")))
query("str_22_whole_words", "documents", r"SELECT doc_id, regexp_matches(lower(text), '(^|[^\wà-ÿ])the($|[^\wà-ÿ])') AS found FROM documents WHERE lang = 'en'", lambda d: d.where("lang = 'en'").select("doc_id", classify.term_present(F.lit("The"), F.col("text")).alias("found")))
query("agg_24_largest_years", "job", r"SELECT job_id, list_max(list_filter(list_transform(regexp_extract_all(lower(description_text), '(\d{1,2})\s*\+?\s*(?:or\s+more\s+)?years?', 1), lambda x: CAST(x AS INTEGER)), lambda y: y BETWEEN 1 AND 30)) AS years FROM job", lambda j: j.select("job_id", classify.required_years(F.col("description_text")).alias("years")))
query("join_04_application_status", "job saved scored application", "SELECT j.job_id, (SELECT a.status FROM application a WHERE a.job_id = j.job_id AND a.owner = 8) AS application_status FROM job j", lambda *t: _mine(*t, owner=8).select("job_id", "application_status"))
query("join_05_own_scores_in_on", "job saved scored application", "SELECT j.job_id, coalesce(f.score, 0) AS fitness_score FROM job j LEFT JOIN scored f ON f.job_id = j.job_id AND f.owner = 8", lambda *t: _mine(*t, owner=8).select("job_id", "fitness_score"))
query("join_07_jobs_of_a_run", "job run", "SELECT DISTINCT j.job_id FROM job j JOIN run r USING (institution_id) WHERE r.run_id = 12 AND j.first_seen >= DATE '1996-01-01'", lambda j, r: j.where("first_seen >= DATE '1996-01-01'").join(r.where("run_id = 12"), "institution_id", "left_semi").select("job_id"))
query("join_09_changed_without_new", "revision job", "SELECT revision_id FROM revision WHERE run_id = 12 AND job_id NOT IN (SELECT job_id FROM job WHERE first_seen >= DATE '1998-01-01')", lambda v, j: v.where("run_id = 12").join(j.where("first_seen >= DATE '1998-01-01'"), "job_id", "left_anti").select("revision_id"))
query("join_15_event_dimensions", "event job institution", "SELECT e.event_id AS actor, coalesce(e.institution_id, j.institution_id) AS institution_id FROM event e LEFT JOIN job j ON j.job_id = e.event_id",
      lambda e, j, i: insights.recorded(e.select("kind", "day", F.col("event_id").alias("actor"), "actor_role", F.col("event_id").alias("job_id"), "institution_id", "query", "result_count"), j, i).select("actor", "institution_id"))


def _scores(j: DataFrame) -> DataFrame:
    from larkspur.plans.verdicts import _existing, _profiles

    return fitness.rescore(j, _profiles(j), _existing(j), 5, force=True).agg(F.count("*").alias("scored"), F.count_if("changed").alias("changed"))


query("fit_06_forced_rescore", "job", "SELECT count(*) AS scored, count(*) AS changed FROM job", _scores)
query("prj_09_days_to_closing", "job", "SELECT job_id, closing_date - DATE '1998-01-01' AS days FROM job", lambda j: j.select("job_id", tracking.days_until(F.col("closing_date"), F.lit("1998-01-01").cast("date")).cast("long").alias("days")))
query("prj_08_dropped_to_zero", "run", "SELECT count(*) AS n FROM (SELECT vacancies_found, lag(vacancies_found) OVER (PARTITION BY institution_id ORDER BY started_at, result_id) AS p FROM run) WHERE vacancies_found = 0 AND p > 0", lambda r: records.previous_count(r.drop("run_id").withColumnRenamed("result_id", "run_id")).agg(F.count_if("dropped_to_zero").alias("n")))
query("dat_05_events_of_a_day", "event", "SELECT event_id FROM event WHERE day = DATE '2024-01-10'", lambda e: e.where("day = DATE '2024-01-10'").select("event_id"))
query("lim_03_digest_top", "job", "SELECT CAST(3 AS BIGINT) AS search_id, job_id FROM (SELECT job_id FROM job WHERE first_seen >= DATE '1997-12-31' AND nation = 'WALES' ORDER BY posted_date DESC NULLS FIRST, first_seen DESC NULLS FIRST, job_id LIMIT 20)", lambda j: _digest(j))


def _digest(j: DataFrame) -> DataFrame:
    import datetime

    return tracking.new_matches(j, [{"search_id": 3, "query": "nation=WALES", "last_run": None}], datetime.date(1998, 1, 1))


query("str_24_fingerprints", "nation", "SELECT n_nationkey, true AS same, false AS other FROM nation", lambda n: n.select("n_nationkey", F.lit(fitness.Criteria(["a"]).fingerprint() == fitness.Criteria(["a"]).fingerprint()).alias("same"), F.lit(fitness.Criteria(["a"]).fingerprint() == fitness.Criteria(["b"]).fingerprint()).alias("other")))
query("cv_02_no_section", "documents", "SELECT doc_id, 0 AS skills FROM documents", lambda d: d.select("doc_id", F.size(profiles.declared_skills(F.coalesce("text", F.lit("")))).alias("skills")))
query("agg_20_unchanged_batch", "job", "SELECT count(*) AS screened, CAST(0 AS BIGINT) AS changed FROM job", lambda j: screening.rescreen_report(j, j))
query("api_06_hand_search", "register", "SELECT register_name FROM (SELECT DISTINCT register_name FROM register) WHERE contains(lower(register_name), 'gear')", lambda r: linkage.search_register(_register(r), " Gear ", 100_000).where(F.contains(F.lower("register_name"), F.lit("gear"))).select("register_name"))
query("api_18_register_refresh", "named register match", "SELECT count(DISTINCT name) AS decided FROM named WHERE p_partkey % 20 = 0", lambda n, r, m: linkage.refresh(_some(n), _register(r), _register(r), m)[0].agg(F.count("*").alias("decided")))
query("flt_14_with_parameters", "job", "SELECT job_id FROM job WHERE nation = 'WALES'", lambda j: search.listed(j, {"nation": ["WALES"]}).select("job_id"))
