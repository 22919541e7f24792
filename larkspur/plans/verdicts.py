"""Queries over pay, classes, exclusions, fitness, screening and rule sets."""

from __future__ import annotations

from pyspark.sql import functions as F

from larkspur.functions import classify, fitness, salary, text
from larkspur.operators import screening
from larkspur.plans.registry import query
from larkspur.sources.lineage import spread

#: Figures of a rule set; data, given to every function that needs them.
RULES = {"personal_floor": 60000, "current_package": 120000, "going_rate": 200000, "standard_general": 90000}


def rules() -> dict:
    return {k: F.lit(v).cast("decimal(12,2)") for k, v in RULES.items()}


_D = lambda c: F.col(c).cast("double").alias(c.split(".")[-1])
_AMOUNTS = r"list_transform(regexp_extract_all(t, '(?i)(?:£|GBP\s?)\s*((?:\d{1,3}(?:,\d{3})+|\d+)(?:\.\d{1,2})?)', 1), lambda a: CAST(replace(a, ',', '') AS DECIMAL(14,2)))"
_PERIOD = "CASE " + " ".join("WHEN regexp_matches(lower(t), '\\b(?:{})\\b') THEN '{}'".format("|".join(p.replace(" ", r"\s+") for p in phrases), name) for name, phrases in salary.PERIODS.items()) + " ELSE 'UNKNOWN' END"
_PARSED = rf"""trimmed AS (SELECT job_id, salary_raw, trim(salary_raw) AS t FROM job), amounts AS (SELECT job_id, salary_raw, t, {_AMOUNTS} AS a FROM trimmed), figures AS (
 SELECT job_id, salary_raw, t, len(a) = 0 OR len(list_filter(a, lambda x: x < 1000 OR x > 500000)) > 0 AS bad, regexp_matches(t, '(?i)^[^£]*\b(?:up\s+to|maximum\s+of)\b\s*(?:£|GBP)') AS ceiling, len(a) > 1 AS many, a[1] AS first, list_max(a) AS top,
 regexp_matches(t, '(?i)(?:£|GBP\s?)\s*[\d,.]+\s*(?:[-–—]|(?:up\s+)?to\b)') AS dangling FROM amounts), parsed AS (
 SELECT job_id, salary_raw, t, CASE WHEN NOT bad AND NOT ceiling THEN CAST(first AS DOUBLE) END AS minimum, CASE WHEN bad THEN NULL WHEN ceiling OR many THEN CAST(top AS DOUBLE) WHEN NOT dangling THEN CAST(first AS DOUBLE) END AS maximum,
 CASE WHEN bad THEN 'UNPARSEABLE' WHEN ceiling OR many THEN 'PARSED' WHEN dangling THEN 'LOW' ELSE 'EXACT' END AS confidence, {_PERIOD} AS period,
 nullif(regexp_extract(t, '(?i)grade \d+|band b|UE\d\d'), '') AS grade FROM figures)"""
query("sal_06_parse_salary", "job", "SELECT job_id, minimum, maximum, confidence, period, grade FROM parsed", lambda j: j.select("job_id", salary.parse_salary(F.col("salary_raw")).alias("s")).select("job_id", _D("s.minimum"), _D("s.maximum"), "s.confidence", "s.period", "s.grade"), _PARSED)
query("sal_01_amounts", "job", f"SELECT job_id, len(a) AS n, CAST(a[1] AS DOUBLE) AS first FROM (SELECT job_id, {_AMOUNTS} AS a FROM (SELECT job_id, salary_raw AS t FROM job))",
      lambda j: j.select("job_id", salary.amounts(F.col("salary_raw")).alias("a")).select("job_id", F.size("a").cast("long").alias("n"), F.get("a", F.lit(0)).cast("double").alias("first")))
_MONEY = "concat('£', regexp_replace(reverse(regexp_replace(reverse(CAST(CAST(round_even({0}, 0) AS BIGINT) AS VARCHAR)), '(\\d\\d\\d)', '\\1,', 'g')), '^,', ''))"
_GOING = "soc_2134_going_rate going rate of £200,000."
_OK = "minimum IS NOT NULL AND confidence <> 'UNPARSEABLE' AND period IN ('ANNUAL', 'UNKNOWN')"
_BANDS = f"""assessed AS (SELECT *, CASE WHEN NOT ok THEN 'SALARY_UNCLEAR' WHEN minimum < 60000 THEN 'EXCLUDED_BELOW_FLOOR' WHEN minimum < 120000 THEN 'PAY_CUT' WHEN minimum < 200000 THEN 'LATERAL_CONTINGENT' ELSE 'TARGET_BAND' END AS verdict,
 CASE WHEN ok THEN minimum END AS screened_on, CASE WHEN ok THEN minimum >= 90000 END AS general_threshold_met, CASE WHEN ok THEN minimum >= 200000 END AS going_rate_met,
 CASE WHEN confidence = 'UNPARSEABLE' THEN concat('Salary could not be parsed from ''', salary_raw, '''.')
 WHEN minimum IS NULL THEN concat('''', salary_raw, ''' states a ceiling but no floor. A ceiling is not screened: the advertised start salary is what matters.')
 WHEN NOT ok THEN concat('''', salary_raw, ''' is quoted ', CASE period WHEN 'HOURLY' THEN 'per hour' WHEN 'DAILY' THEN 'per day' WHEN 'WEEKLY' THEN 'per week' ELSE 'per month' END, ', not per annum. Annualising it would mean guessing at contracted hours.')
 ELSE concat('Screened on the bottom of the range. ', {_MONEY.format('minimum')}, CASE WHEN minimum < 60000 THEN ' is below the personal floor of £60,000.' WHEN minimum < 120000 THEN ' is below the current package of £120,000.'
 WHEN minimum < 200000 THEN ' matches or beats the current package but is below the {_GOING}' ELSE ' meets the {_GOING}' END) END AS explanation FROM (SELECT *, {_OK} AS ok FROM parsed))"""
_ASSESSED = lambda j: j.select("job_id", salary.assess(salary.parse_salary(F.col("salary_raw")), rules()).alias("a"))
query("thr_01_screened_bands", "job", "SELECT job_id, verdict, screened_on, general_threshold_met, going_rate_met FROM assessed", lambda j: _ASSESSED(j).select("job_id", "a.verdict", _D("a.screened_on"), "a.general_threshold_met", "a.going_rate_met"), _PARSED, _BANDS)
query("thr_03_explanations", "job", "SELECT job_id, explanation FROM assessed", lambda j: _ASSESSED(j).select("job_id", "a.explanation"), _PARSED, _BANDS)
_KEYS = ", ".join(f"('{k}', {1000 * (i + 40)})" for i, k in enumerate(screening.FIGURES))


def _figures(j):
    return j.sparkSession.createDataFrame([(k, str(1000 * (i + 40))) for i, k in enumerate(screening.FIGURES)], "key string, value string")


query("thr_04_thresholds", "nation", "SELECT 49000.0 AS personal_floor, 48000.0 AS current_package, 42000.0 AS going_rate, 41000.0 AS standard_general", lambda n: n.limit(1).select(*[c.cast("double").alias(k) for k, c in screening.thresholds(_figures(n)).items()]))
query("set_08_missing_figures", "nation", "SELECT n_nationkey, CASE WHEN n_nationkey % 2 = 0 THEN 'personal_floor' ELSE '' END AS missing FROM nation", lambda n: n.select(
    "n_nationkey", F.array_join(screening.missing_figures(F.when(F.col("n_nationkey") % 2 == 0, F.array(*map(F.lit, screening.FIGURES[:-1]))).otherwise(F.array(*map(F.lit, screening.FIGURES)))), ",").alias("missing")))
_RULESETS = "SELECT r_regionkey AS version, r_name AS name, DATE '2024-01-01' AS effective_from, r_regionkey = 3 AS is_active FROM region"
query("thr_05_new_version", "region", f"SELECT version, name, effective_from, false AS is_active FROM ({_RULESETS}) UNION ALL SELECT 5, 'next', DATE '2026-04-01', true", lambda r: screening.with_new_ruleset(r.selectExpr("CAST(r_regionkey AS INT) AS version", "r_name AS name", "DATE '2024-01-01' AS effective_from", "r_regionkey = 3 AS is_active"), "next", "2026-04-01"))
query("lim_04_active_ruleset", "region", "SELECT 3 AS version", lambda r: screening.active_ruleset(r.selectExpr("CAST(r_regionkey AS INT) AS version", "r_regionkey = 3 AS is_active")).select("version"))

# Exclusions, over whole documents with a phrase put in.
_BODY = "CASE doc_id % 4 WHEN 0 THEN text WHEN 1 THEN concat(text, ' Sorry, no sponsorship  is available. Bye.') WHEN 2 THEN concat('Well, we are unable to sponsor you! ', text) ELSE concat(text, ' and cannot offer sponsorship or cannot offer visa sponsorship ', text) END"
_P = "[" + ", ".join("'" + p + "'" for p in text.EXCLUSIONS) + "]"
_HIT = f"""cut AS (SELECT doc_id, list_filter(list_transform(string_split(regexp_replace(coalesce({_BODY}, ''), '([.!?])\\s+', concat('\\1', chr(1)), 'g'), chr(1)), lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))),
 lambda s: len(list_filter({_P}, lambda p: contains(lower(s), p))) > 0)[1] AS s FROM documents), placed AS (SELECT doc_id, s, list_filter({_P}, lambda p: contains(lower(s), p))[1] AS p FROM cut),
 ends AS (SELECT doc_id, s, greatest(0, strpos(lower(s), p) - 1 - 110) AS a, least(length(s), strpos(lower(s), p) - 1 + length(p) + 110) AS b FROM placed)"""
query("str_20_exclusion_sentence", "documents", "SELECT doc_id, CASE WHEN s IS NULL OR length(s) <= 300 THEN s ELSE concat(CASE WHEN a > 0 THEN '… ' ELSE '' END, trim(substring(s, a + 1, b - a)), CASE WHEN b < length(s) THEN ' …' ELSE '' END) END AS quote FROM ends",
      lambda d: d.select("doc_id", text.exclusion_sentence(F.expr(_BODY)).alias("quote")), _HIT)
query("scr_01_advert_overrides", "job", "SELECT job_id, CASE WHEN advert_excludes_sponsorship THEN 'NOT_FOUND' ELSE coalesce(sponsor_verdict, 'NOT_FOUND') END AS verdict FROM job", lambda j: j.select("job_id", screening.advert_overrides(F.col("sponsor_verdict"), F.col("advert_excludes_sponsorship")).alias("verdict")))

# Classes.
_CASE = lambda t, rules, other: "CASE " + " ".join(f"WHEN regexp_matches({t}, '{p}') THEN '{n}'" for n, p in rules) + f" ELSE '{other}' END"
_ADVERT = "CASE doc_id % 6 WHEN 0 THEN concat('Fixed-term role, hybrid. ', text) WHEN 1 THEN concat('Permanent, full time. ', text) WHEN 2 THEN concat('Secondment; 0.5 FTE on-site. ', text) ELSE text END"
query("cls_01_contract_hours_place", "documents", f"SELECT doc_id, {_CASE('t', classify.CONTRACT, 'UNKNOWN')} AS contract, {_CASE('t', classify.HOURS, 'UNKNOWN')} AS hours, {_CASE('t', classify.WORKPLACE, 'UNKNOWN')} AS workplace FROM (SELECT doc_id, coalesce(lower({_ADVERT}), '') AS t FROM documents)",
      lambda d: d.select("doc_id", F.coalesce(F.expr(_ADVERT), F.lit("")).alias("t")).select("doc_id", *[classify.first_match(F.col("t"), r).alias(n) for n, r in (("contract", classify.CONTRACT), ("hours", classify.HOURS), ("workplace", classify.WORKPLACE))]))
_DISCIPLINE = _CASE("lower(concat_ws(' ', nullif(title, ''), nullif(category, ''), nullif(department, '')))", [(n, "|".join(p)) for n, p in classify.DISCIPLINES.items()], "OTHER")
query("cls_04_discipline", "job", f"SELECT job_id, {_DISCIPLINE} AS discipline FROM job", lambda j: j.select("job_id", classify.discipline(F.col("title"), F.col("category"), F.col("department")).alias("discipline")))
query("cls_06_reclassified", "job", f"SELECT count(*) AS classified, count(*) FILTER (discipline <> {_DISCIPLINE}) AS changed FROM job", classify.reclassified)
query("cls_07_seed_verdicts", "region nation", """SELECT n_nationkey, CASE WHEN n_nationkey % 4 <> 0 THEN 'NOT_FOUND' WHEN n_nationkey % 3 = 0 THEN 'OTHER_ROUTE_ONLY' WHEN n_nationkey % 8 = 0 THEN 'B_RATED' ELSE 'PROVISIONAL' END AS verdict, n_nationkey % 4 <> 0 AS needs_review FROM nation""",
      lambda r, n: n.select("n_nationkey", classify.seed_verdict(F.expr("CASE n_nationkey % 4 WHEN 0 THEN ' on register' WHEN 1 THEN 'NOT FOUND' WHEN 2 THEN 'VIA PARENT' END"), F.expr("CASE WHEN n_nationkey % 8 = 0 THEN 'Worker (B rating), provisional' ELSE 'Provisional' END"), F.expr("CASE WHEN n_nationkey % 3 = 0 THEN 'Temporary' ELSE 'Skilled Worker' END")).alias("v")).select("n_nationkey", "v.verdict", "v.needs_review"))

# Fitness.
ME = fitness.Criteria(skills=["Python", "django", "C++", "go"], domains=["research", "machine learning"], seniority=[], projects=["tradition"], education=["PhD"], years_experience=10)
_HAS = lambda *terms: " + ".join("CAST(regexp_matches(a, '(^|[^\\w]){}($|[^\\w])') AS INTEGER)".format(t.lower().replace("+", r"\+")) for t in terms)
_ADVERT_SQL = "adverts AS (SELECT job_id, lower(concat_ws('. ', nullif(title, ''), nullif(description_text, ''))) AS a FROM job)"
_ASKED = r"list_max(list_filter(list_transform(regexp_extract_all(a, '(\d{1,2})\s*\+?\s*(?:or\s+more\s+)?years?', 1), lambda x: CAST(x AS INTEGER)), lambda y: y BETWEEN 1 AND 30))"
_SCORE = f"CAST(round_even(100 * (3 * ({_HAS(*ME.skills)}) / 4.0::DOUBLE + 2 * ({_HAS(*ME.domains)}) / 2.0::DOUBLE + 2 * CASE WHEN coalesce({_ASKED}, 0) > 10 THEN 0 ELSE 1 END + ({_HAS('tradition')}) + ({_HAS('phd')})) / 11, 0) AS INTEGER)"
query("fit_04_scores", "job", f"SELECT job_id, {_SCORE} AS score, {_HAS(*ME.skills)} AS skills_found, {_ASKED} AS asked FROM adverts", lambda j: fitness.score(spread(j), ME).select("job_id", "score", F.size(F.expr("reasons[0].matched")).alias("skills_found")).join(
    spread(j).select("job_id", classify.required_years(fitness.advert_text(F.col("title"), F.col("description_text"))).alias("asked")), "job_id"), _ADVERT_SQL)
query("fit_01_missing_terms", "job", f"SELECT job_id, concat_ws(',', CASE WHEN ({_HAS('Python')}) = 0 THEN 'Python' END, CASE WHEN ({_HAS('django')}) = 0 THEN 'django' END, CASE WHEN ({_HAS('C++')}) = 0 THEN 'C++' END, CASE WHEN ({_HAS('go')}) = 0 THEN 'go' END) AS missing FROM adverts",
      lambda j: fitness.score(j, ME).select("job_id", F.array_join(F.expr("reasons[0].missing"), ",").alias("missing")), _ADVERT_SQL)
query("fit_02_required_years", "documents", r"""SELECT doc_id, list_max(list_filter(list_transform(regexp_extract_all(lower(t), '(\d{1,2})\s*\+?\s*(?:or\s+more\s+)?years?', 1), lambda x: CAST(x AS INTEGER)), lambda y: y BETWEEN 1 AND 30)) AS years
 FROM (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN concat(text, ' ', doc_id % 40, '+ years, 2 or more years') WHEN 1 THEN concat('At least 7 YEAR ', text) ELSE text END AS t FROM documents)""",
      lambda d: d.select("doc_id", classify.required_years(F.expr("CASE doc_id % 3 WHEN 0 THEN concat(text, ' ', doc_id % 40, '+ years, 2 or more years') WHEN 1 THEN concat('At least 7 YEAR ', text) ELSE text END")).alias("years")))
query("fit_03_years_criterion", "job", f"SELECT job_id, CASE WHEN coalesce({_ASKED}, 0) > 10 THEN 0.0::DOUBLE ELSE 1.0 END AS fraction, CASE WHEN {_ASKED} IS NULL THEN 'Advert states no minimum years of experience.' ELSE concat('Advert asks for ', {_ASKED}, ' years; profile has 10.') END AS note FROM adverts",
      lambda j: j.select("job_id", fitness.years_result(10, fitness.advert_text(F.col("title"), F.col("description_text"))).alias("r")).select("job_id", "r.fraction", "r.note"), _ADVERT_SQL)


def _profiles(j):
    return j.sparkSession.createDataFrame([(1, 5, True, ME.skills, ME.domains, None, ME.projects, ME.education, 10), (2, 5, False, ["x"], None, None, None, None, 1)], "profile_id long, owner long, is_active boolean, skills array<string>, domains array<string>, seniority array<string>, projects array<string>, education array<string>, years_experience int")


def _existing(j):
    return j.select(F.lit(5).cast("long").alias("owner"), "job_id", F.lit(-1).alias("score"), F.when(F.col("job_id") % 2 == 0, ME.fingerprint()).otherwise("old").alias("criteria_hash"))


query("fit_05_rescored", "job", f"SELECT CAST(5 AS BIGINT) AS owner, job_id, CASE WHEN job_id % 2 = 0 THEN -1 ELSE {_SCORE} END AS score, job_id % 2 <> 0 AS changed FROM adverts", lambda j: fitness.rescore(j, _profiles(j), _existing(j), 5).drop("criteria_hash"), _ADVERT_SQL)
query("fit_05_without_profile", "job", "SELECT CAST(5 AS BIGINT) AS owner, job_id FROM job WHERE false", lambda j: fitness.rescore(j, _profiles(j), _existing(j), 6).select("owner", "job_id"))

# Screenings.
_EXCLUDED = "(description_text LIKE '%This post is  not eligible%' OR description_text LIKE '%unable to sponsor%')"
_SCREENED = f"""screened AS (SELECT j.job_id, CASE WHEN {_EXCLUDED} THEN 'NOT_FOUND' ELSE coalesce(m.verdict, 'NOT_FOUND') END AS sponsor_verdict, coalesce(m.registered_legal_name, '') AS sponsor_matched_name, {_EXCLUDED} AS advert_excludes_sponsorship,
 a.verdict AS threshold_verdict, coalesce(a.grade, j.grade_raw) AS grade_raw FROM job j JOIN assessed a USING (job_id) LEFT JOIN match m ON m.institution_id = j.institution_id)"""
_COLUMNS = "job_id, sponsor_verdict, sponsor_matched_name, advert_excludes_sponsorship, threshold_verdict, grade_raw"
query("scr_02_screened", "job match", f"SELECT {_COLUMNS} FROM screened", lambda j, m: screening.screened(j, m, rules()).select(*_COLUMNS.split(", ")), _PARSED, _BANDS, _SCREENED)
query("scr_03_rescreen_report", "job match", "SELECT count(*) AS screened, count(*) FILTER (s.job_id % 3 = 0 OR s.sponsor_verdict IS DISTINCT FROM j.sponsor_verdict OR s.threshold_verdict <> j.threshold_verdict) AS changed FROM screened s JOIN job j USING (job_id)",
      lambda j, m: screening.rescreen_report(j.where("job_id % 3 <> 0"), screening.screened(j, m, rules())), _PARSED, _BANDS, _SCREENED)
query("set_02_rescreen_targets", "job", "SELECT job_id FROM job WHERE job_id % 2 = 0 OR job_id % 3 = 0 OR job_id % 5 = 0", lambda j: screening.rescreen_targets(*[j.where(f"job_id % {k} = 0") for k in (2, 3, 5)]))
