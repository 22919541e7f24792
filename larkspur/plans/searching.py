"""Queries over vacancies as people look at them: filters, facets, search, order, pages, rows, personal tables."""

from __future__ import annotations

import uuid

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from larkspur.operators import insights, institutions, records, screening, search, text_index
from larkspur.plans.registry import query
from larkspur.sources.lineage import shared_folder

_PARAMS = {"status": ["OPEN", "DISAPPEARED"], "category": ["1-URGENT", "2-HIGH", "3-MEDIUM"], "posted_after": "1996-01-01", "min_fitness": 20, "nation": ["ENGLAND", "WALES"]}
_TESTS = {"status": "status IN ('OPEN', 'DISAPPEARED')", "category": "category IN ('1-URGENT', '2-HIGH', '3-MEDIUM')", "posted_after": "posted_date >= DATE '1996-01-01'", "min_fitness": "fitness_score >= 20", "nation": "nation IN ('ENGLAND', 'WALES')"}
_SPONSORING = "coalesce(sponsor_verdict IN (" + ", ".join(f"'{v}'" for v in screening.SPONSORING) + ") AND NOT advert_excludes_sponsorship, false)"


def _filter(name: str, params: dict, test: str) -> None:
    query(name, "job", f"SELECT job_id FROM job WHERE {test}", lambda j: search.filtered(j, params).select("job_id"))


_filter("flt_01_institution", {"institution": ["inst-3", "inst-17"]}, "institution IN ('inst-3', 'inst-17')")
_filter("flt_02_nation", {"nation": ["SCOTLAND", "WALES"]}, "nation IN ('SCOTLAND', 'WALES')")
_filter("flt_03_city_contains", {"city": "BA"}, "contains(lower(city), 'ba')")
_filter("flt_04_category", {"category": ["1-URGENT"]}, "category = '1-URGENT'")
_filter("flt_05_discipline", {"discipline": ["LAW", "PSYCHOLOGY"]}, "discipline IN ('LAW', 'PSYCHOLOGY')")
_filter("flt_06_five_choices", {"status": ["OPEN"], "source": ["PORTAL", "MANUAL"], "contract_type": ["PERMANENT"], "hours": ["FULL_TIME"], "workplace": ["REMOTE"]}, "status = 'OPEN' AND source IN ('PORTAL', 'MANUAL') AND contract_type = 'PERMANENT' AND hours = 'FULL_TIME' AND workplace = 'REMOTE'")
_filter("flt_07_verdicts", {"sponsor_verdict": ["B_RATED", "NOT_FOUND"], "threshold_verdict": ["PAY_CUT"]}, "sponsor_verdict IN ('B_RATED', 'NOT_FOUND') AND threshold_verdict = 'PAY_CUT'")
_filter("flt_08_sponsorable", {"sponsorable": True}, _SPONSORING)
_filter("flt_08_not_sponsorable", {"sponsorable": False}, f"NOT {_SPONSORING}")
_filter("flt_09_floor_range", {"salary_min": 50000, "salary_max": 150000}, "salary_min >= 50000 AND salary_min <= 150000")
_filter("flt_10_min_fitness", {"min_fitness": 60}, "fitness_score >= 60")
_filter("flt_11_closing_window", {"closing_after": "1997-01-01", "closing_before": "1997-06-30"}, "closing_date >= DATE '1997-01-01' AND closing_date <= DATE '1997-06-30'")
_filter("flt_01_many_filters", _PARAMS, " AND ".join(_TESTS.values()))

_OWNED = "EXISTS (SELECT 1 FROM saved s WHERE s.job_id = j.job_id AND s.owner = 7)"


def _mine(j, s, f, a, owner=7):
    bare = j.drop("is_saved", "fitness_score")
    return search.with_owner(bare, owner, s, f.withColumn("reasons", F.array(F.lit("skills"))), a)


query("flt_12_saved", "job saved scored application", f"SELECT job_id FROM job j WHERE {_OWNED}", lambda *t: search.filtered(_mine(*t), {"saved": True}).select("job_id"))
query("flt_12_not_saved", "job saved scored application", f"SELECT job_id FROM job j WHERE NOT {_OWNED}", lambda *t: search.filtered(_mine(*t), {"saved": False}).select("job_id"))
query("flt_12_saved_by_nobody", "job saved scored application", "SELECT job_id FROM job WHERE false", lambda *t: search.filtered(_mine(*t, owner=None), {"saved": True}).select("job_id"))
query("flt_13_screened_only", "job", "SELECT job_id FROM job WHERE job_id % 3 <> 0", lambda j: screening.visible(j, j.where("job_id % 3 <> 0")).select("job_id"))
query("flt_14_default_open", "job", "SELECT job_id FROM job WHERE status = 'OPEN'", lambda j: search.listed(j, {}).select("job_id"))
query("flt_15_crawlable", "institution", "SELECT institution_id FROM institution WHERE crawl_enabled AND careers_url <> ''", lambda i: records.crawlable(i).select("institution_id"))
query("flt_16_open_crawled_withdrawn", "job", "SELECT job_id, status = 'OPEN' AS open, source <> 'MANUAL' AS crawled, status = 'WITHDRAWN' AS withdrawn FROM job", lambda j: j.select("job_id", (F.col("status") == "OPEN").alias("open"), (F.col("source") != "MANUAL").alias("crawled"), (F.col("status") == "WITHDRAWN").alias("withdrawn")))
query("flt_18_owned", "application", "SELECT application_id FROM application WHERE owner = 7", lambda a: search.owned(a, 7).select("application_id"))
query("flt_21_equal_filters", "application", "SELECT application_id FROM application WHERE owner = 8 AND status = 'OFFER'", lambda a: search.owned(a, 8).where("status = 'OFFER'").select("application_id"))
query("flt_22_log_after", "revision", "SELECT revision_id AS id FROM revision WHERE revision_id > 100 ORDER BY 1 LIMIT 500", lambda r: records.after_log(r.select(F.col("revision_id").alias("id")), 100))

query("agg_01_facets", "job", " UNION ALL ".join(
    f"SELECT '{d}' AS dimension, {d} AS value, count(*) AS n FROM job WHERE {' AND '.join(t for k, t in _TESTS.items() if k != d)} AND {d} <> '' GROUP BY {d}" for d in search.DIMENSIONS
), lambda j: search.facets(j, _PARAMS))
query("agg_02_facet_total", "job", "SELECT count(*) AS n FROM job WHERE " + " AND ".join(_TESTS.values()), lambda j: search.filtered(j, _PARAMS).agg(F.count("*").alias("n")))
_LABELS = "labels_(grouping, position, value, label) AS (VALUES ('Academic', 1, 'LAW', 'Law'), ('Academic', 2, 'ECONOMICS', 'Economics'), ('Services', 3, 'OTHER', 'Other'))"
query("agg_25_discipline_browse", "job", "SELECT grouping, position, value, label, (SELECT count(*) FROM job WHERE discipline = value AND nation = 'WALES') AS n FROM labels_", lambda j: search.browse(
    search.facets(j, {"nation": ["WALES"]}), j.sparkSession.createDataFrame([("Academic", 1, "LAW", "Law"), ("Academic", 2, "ECONOMICS", "Economics"), ("Services", 3, "OTHER", "Other")], "grouping string, position int, value string, label string")), _LABELS)

_DIRECTION = {"-": "DESC NULLS FIRST", "": "ASC NULLS LAST"}
for _keys in (["-fitness", "-posted"], ["closing", "title"], ["-salary", "seen"]):
    _sql = ", ".join(f"{search.KEYS[k.lstrip('-')]} {_DIRECTION['-' if k[0] == '-' else '']}" for k in _keys)
    query("ord_01_by_" + "_".join(k.lstrip("-") for k in _keys), "job", f"SELECT job_id FROM job ORDER BY {_sql}, job_id LIMIT 40 OFFSET 40", lambda j, keys=_keys: search.page(search.ordered(j, keys), 2, 40).select("job_id"))
query("ord_03_newest", "job", "SELECT job_id FROM job ORDER BY posted_date DESC NULLS FIRST, first_seen DESC NULLS FIRST, job_id LIMIT 25", lambda j: search.page(search.ordered(j, None), 1).select("job_id"))
query("lim_01_page_counts", "job", "SELECT count(*) AS count, CAST(greatest(1, ceil(count(*) / 40)) AS BIGINT) AS total_pages FROM job WHERE status = 'OPEN'", lambda j: search.page_counts(j.where("status = 'OPEN'"), 40))
query("lim_02_clamped", "event", "SELECT event_id, CAST(greatest(1, least(365, event_id % 1000 - 100)) AS INTEGER) AS days, CAST(greatest(1, least(500, event_id % 1000 - 100)) AS INTEGER) AS rows FROM event",
      lambda e: e.select("event_id", insights.clamped_days((F.col("event_id") % 1000 - 100).cast("int")).alias("days"), insights.clamped_rows((F.col("event_id") % 1000 - 100).cast("int")).alias("rows")))
query("ord_06_busiest_first", "institution job", "SELECT institution_id, open_jobs FROM (SELECT i.institution_id, i.name, count(j.job_id) FILTER (j.status = 'OPEN') AS open_jobs FROM institution i LEFT JOIN job j USING (institution_id) GROUP BY ALL) ORDER BY open_jobs DESC, name LIMIT 30",
      lambda i, j: institutions.busiest_first(institutions.open_jobs(i, j)).limit(30).select("institution_id", "open_jobs"))
query("ord_07_by_ranking", "institution", "SELECT institution_id, ranking FROM institution ORDER BY ranking ASC NULLS LAST, name LIMIT 40", lambda i: institutions.by_ranking(i).limit(40).select("institution_id", "ranking"))
query("agg_14_open_jobs", "institution job", "SELECT i.institution_id, count(j.job_id) FILTER (j.status = 'OPEN') AS open_jobs FROM institution i LEFT JOIN job j USING (institution_id) GROUP BY i.institution_id", lambda i, j: institutions.open_jobs(i, j).select("institution_id", "open_jobs"))
query("agg_16_jobs_by_status", "job", "SELECT status, count(*) AS n FROM job GROUP BY status", lambda j: j.groupBy("status").agg(F.count("*").alias("n")))

# Substring rungs alone can be said in SQL: a search whose words no stem adds to, and the ladder over them.
_TERM = "softwareh"
_RUNGS = f"CASE WHEN contains(lower(title), '{_TERM}') THEN 4 WHEN contains(lower(department), '{_TERM}') OR contains(lower(name), '{_TERM}') THEN 3 WHEN contains(lower(description_text), '{_TERM}') THEN 1 ELSE 0 END"
query("str_17_substring_search", "job", f"SELECT job_id, relevance FROM (SELECT job_id, {_RUNGS} AS relevance FROM job) WHERE relevance > 0", lambda j: search.searched(search.with_vectors(j), _TERM).select("job_id", "relevance"))
_WORDS = lambda c, *words: " AND ".join(rf"regexp_matches(lower({c}), '\b{w}\b')" for w in words)
query("str_16_word_search", "job", f"""SELECT job_id, CASE WHEN {_WORDS('title', 'software', 'engineer')} THEN 5 WHEN {_WORDS("concat_ws(' ', title, department, name, description_text)", 'software', 'engineer')} THEN 2 ELSE 0 END AS relevance
 FROM job WHERE {_WORDS("concat_ws(' ', title, department, name, description_text)", 'software', 'engineer')}""", lambda j: search.searched(search.with_vectors(j), "engineers software").select("job_id", "relevance"))
query("str_16_phrase_or_without", "job", rf"""SELECT job_id, CASE WHEN regexp_matches(lower(title), '\bhead\s+\w+\s+estates\b') OR regexp_matches(lower(title), 'physics') AND NOT regexp_matches(lower(title), 'django') THEN 5 ELSE 2 END AS relevance
 FROM (SELECT *, lower(concat_ws(' ', title, department, name, description_text)) AS t FROM job) WHERE regexp_matches(t, '\bhead\s+\w+\s+estates\b') OR regexp_matches(t, 'physics') AND NOT regexp_matches(t, 'django')
 OR regexp_matches(lower(title), 'physics')""", lambda j: search.searched(search.with_vectors(j), '"head of estate" or physics -django').select("job_id", "relevance"))
query("ord_02_search_page", "job", f"SELECT job_id FROM (SELECT job_id, posted_date, {_RUNGS} AS relevance FROM job) WHERE relevance > 0 ORDER BY relevance DESC, posted_date DESC NULLS FIRST, job_id LIMIT 25", lambda j: search.page(search.ordered(search.searched(search.with_vectors(j), _TERM), None, _TERM), 1).select("job_id"))


def _by_index(j: DataFrame, term: str) -> DataFrame:
    """A search of an index that is built for it."""
    index = text_index.build(j, f"{shared_folder(j.sparkSession)}/text_index-{uuid.uuid4().hex}", buckets=64)
    return text_index.found(j.sparkSession, index, term)


query("str_17_indexed_letters", "job", f"SELECT job_id, relevance FROM (SELECT job_id, {_RUNGS} AS relevance FROM job) WHERE relevance > 0", lambda j: _by_index(j, _TERM))
_T, _ALL = "lower(title)", "lower(concat_ws(' ', title, department, name, description_text))"
_EITHER = lambda t: rf"regexp_matches({t}, '\bhead\s+\w+\s+estates\b') OR regexp_matches({t}, '\bphysics\b') AND NOT regexp_matches({t}, '\bdjango\b')"
query("str_16_indexed_phrases", "job", f"""SELECT job_id, CASE WHEN {_EITHER(_T)} THEN 5 ELSE 2 END AS relevance FROM job WHERE {_EITHER(_T)} OR {_EITHER(_ALL)}""", lambda j: _by_index(j, '"head of estate" or physics -django'))

# Rows.
query("prj_01_list_rows", "job saved scored application", """SELECT j.job_id, j.title, j.nation, j.sponsor_verdict AS verdict, j.salary_min, EXISTS (SELECT 1 FROM saved s WHERE s.job_id = j.job_id AND s.owner = 7) AS is_saved,
 coalesce((SELECT score FROM scored f WHERE f.job_id = j.job_id AND f.owner = 7), 0) AS fitness_score FROM job j WHERE sponsor_verdict IS NOT NULL""",
      lambda j, *t: search.list_rows(_mine(j.where("sponsor_verdict IS NOT NULL"), *t)).select("job_id", "title", "nation", F.col("screening.sponsor_verdict").alias("verdict"), "screening.salary_min", "is_saved", "fitness_score"))
query("prj_02_detail_rows", "job saved scored application revision", """SELECT j.job_id, j.source_url AS apply_url, a.application_id, a.status AS application_status, least(20, coalesce(r.n, 0)) AS shown, r.newest FROM job j
 LEFT JOIN (SELECT * FROM application WHERE owner = 7) a ON a.job_id = j.job_id LEFT JOIN (SELECT job_id, count(*) AS n, arg_max(concat(field, ' ', value_before, ' ', value_after), (changed_at, revision_id)) AS newest FROM revision GROUP BY job_id) r ON r.job_id = j.job_id
 WHERE sponsor_verdict IS NOT NULL""", lambda j, s, f, a, r: search.detail_rows(_mine(j.where("sponsor_verdict IS NOT NULL"), s, f, a), r).select(
    "job_id", "apply_url", "application_id", "application_status", F.size("revisions").cast("long").alias("shown"), F.expr("concat_ws(' ', get(revisions, 0).field, get(revisions, 0).before, get(revisions, 0).after)").alias("newest_")).select(
    "job_id", "apply_url", "application_id", "application_status", "shown", F.nullif(F.col("newest_"), F.lit("")).alias("newest")))
query("prj_03_annotated", "job saved scored application", """SELECT j.job_id, EXISTS (SELECT 1 FROM saved s WHERE s.job_id = j.job_id AND s.owner = 9) AS is_saved, coalesce(f.score, 0) AS fitness_score, a.application_id, a.status AS application_status
 FROM job j LEFT JOIN (SELECT * FROM scored WHERE owner = 9) f ON f.job_id = j.job_id LEFT JOIN (SELECT * FROM application WHERE owner = 9) a ON a.job_id = j.job_id""",
      lambda *t: _mine(*t, owner=9).select("job_id", "is_saved", "fitness_score", "application_id", "application_status"))
query("join_01_job_institution", "job institution", "SELECT j.job_id, i.name, i.nation FROM job j JOIN institution i USING (institution_id)", lambda j, i: j.drop("name", "nation").join(i.select("institution_id", "name", "nation"), "institution_id").select("job_id", "name", "nation"))
query("join_02_screening_ruleset", "job", "SELECT job_id, CASE WHEN job_id % 3 <> 0 THEN sponsor_verdict END AS sponsor_verdict, CASE WHEN job_id % 3 <> 0 AND job_id % 5 < 4 THEN job_id % 5 + 10 END AS ruleset_version FROM job",
      lambda j: screening.with_screening(j.select("job_id"), j.where("job_id % 3 <> 0").select("job_id", "sponsor_verdict", (F.col("job_id") % 5).alias("ruleset_id")), j.sparkSession.range(4).select(F.col("id").alias("ruleset_id"), (F.col("id") + 10).alias("version"))).select("job_id", "sponsor_verdict", "ruleset_version"))
query("join_03_saved_flag", "job saved scored application", f"SELECT job_id, {_OWNED} AS is_saved FROM job j", lambda *t: _mine(*t).select("job_id", "is_saved"))
query("join_08_unscreened", "job", "SELECT job_id FROM job WHERE job_id % 3 = 0", lambda j: screening.unscreened(j, j.where("job_id % 3 <> 0")).select("job_id"))
query("api_12_taken", "saved", "SELECT owner, job_id FROM saved WHERE job_id % 8 = 0", lambda s: records.taken(s, s.where("job_id % 8 = 0").select("owner", "job_id").unionByName(s.select("owner", (-1 - F.col("job_id")).alias("job_id"))), "job_id"))
_SAVED_SEARCHES = ["sponsorable=true&min_fitness=60", "nation=WALES&nation=ENGLAND&category=1-URGENT,2-HIGH&closing_after=1997-01-01", "status=OPEN&city=bath&order=-salary"]
_SAVED_TESTS = [f"{_SPONSORING} AND fitness_score >= 60", "nation = 'WALES' AND category IN ('1-URGENT', '2-HIGH') AND closing_date >= DATE '1997-01-01'", "status = 'OPEN' AND contains(lower(city), 'bath')"]
for _k, (_q, _t) in enumerate(zip(_SAVED_SEARCHES, _SAVED_TESTS)):
    _filter(f"jsn_03_saved_search_{_k}", search.parse_saved(_q), _t)
_URL = "concat('nation=WALES&nation=ENGLAND&status=&page=2&', CASE conv_id % 4 WHEN 0 THEN concat('q=', CAST(conv_id AS STRING)) WHEN 1 THEN 'salary_min=1' WHEN 2 THEN 'city=Bath&order=title' ELSE 'hours=FULL_TIME' END)"


def _urls(c: DataFrame) -> DataFrame:
    """As a page reads its address: parsed once for each distinct address, with what people are told of it."""
    @F.pandas_udf("active int, most string, back string")
    def told(urls: pd.Series) -> pd.DataFrame:
        each = [search.parse_filters(u) for u in urls]
        return pd.DataFrame([(search.active_count(p), search.most_restrictive(p), search.query_string(p)) for p in each], columns=["active", "most", "back"])

    return c.select("conv_id", "turn", told(F.expr(_URL)).alias("t")).select("conv_id", "turn", "t.active", "t.most", "t.back")


query("jsn_04_url_filters", "conversations", """SELECT conv_id, turn, 2 AS active, CASE conv_id % 4 WHEN 0 THEN 'q' WHEN 1 THEN 'salary_min' WHEN 2 THEN 'city' ELSE 'hours' END AS most,
 CASE conv_id % 4 WHEN 0 THEN concat('nation=WALES&nation=ENGLAND&q=', conv_id, '&page=2') WHEN 1 THEN 'nation=WALES&nation=ENGLAND&salary_min=1&page=2' WHEN 2 THEN 'nation=WALES&nation=ENGLAND&city=Bath&order=title&page=2' ELSE 'nation=WALES&nation=ENGLAND&hours=FULL_TIME&page=2' END AS back FROM conversations""", _urls)
