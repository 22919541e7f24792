"""Snapshot diffs and what they change, crawl runs, application states."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from larkspur.functions import classify, pages, text
from larkspur.operators import screening, search

# Fields whose changes are recorded; the longest texts that fields hold.
TRACKED = ["title", "salary_raw", "closing_date", "location_raw"]
LENGTHS = {"title": 500, "department": 300, "category": 200, "reference": 120, "location_raw": 300, "salary_raw": 500, "grade_raw": 120, "contract_raw": 200, "hours_raw": 200}
# Fields that a content hash covers, in order.
HASHED = ["title", "salary_raw", "grade_raw", "location_raw", "department", "category", "reference", "contract_raw", "closing_date"]
# States from which a run may be paused, resumed and cancelled, and where that leads.
TRANSITIONS = {("pause", "RUNNING"): "PAUSED", ("resume", "PAUSED"): "RUNNING", ("cancel", "RUNNING"): "CANCELLED", ("cancel", "PAUSED"): "CANCELLED", ("finalise", "RUNNING"): "COMPLETE"}
# Outcomes that a log shows as warnings; applications' columns on the board; replies.
WARNINGS = ["BLOCKED", "OFFLINE", "TIMEOUT", "PARSE_ERROR", "NO_ADAPTER"]
BOARD = ["FOUND", "READY", "APPLIED", "ACKNOWLEDGED", "INTERVIEW", "OFFER", "REJECTED", "GHOSTED"]
REPLIES = ["ACKNOWLEDGED", "INTERVIEW", "OFFER", "REJECTED"]


def first_by(df: DataFrame, key: str, order: str) -> DataFrame:
    """SET-05: the first row of each key; order has no ties within a key. Combined before the shuffle."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.min_by(F.struct(*rest), order).alias("r")).select(key, "r.*").select(*df.columns)


def diff(fetched: DataFrame, stored: DataFrame, outcome: Column, key: str = "source_url", ordinal: str | None = None) -> DataFrame:
    """DIF-01 and JOIN-10: new, updated, unchanged, disappeared or kept; nothing disappears unless the crawl's outcome is OK.

    Of rows fetched under one key the first counts, by ordinal where given.
    """
    f = first_by(fetched.select(key, "content_hash", F.col(ordinal) if ordinal else F.lit(0).alias("o")), key, ordinal or "o")
    f = f.select(key, F.col("content_hash").alias("new_hash"), F.lit(True).alias("found"))
    s = stored.select(key, F.col("content_hash").alias("old_hash"), "status", "is_manual", "is_withdrawn", F.lit(True).alias("known"))
    both = f.join(s, key, "full_outer").withColumns({"found": F.coalesce("found", F.lit(False)), "known": F.coalesce("known", F.lit(False))})
    other = (F.col("status") != "OPEN") | ~F.col("old_hash").eqNullSafe(F.col("new_hash"))
    state = (
        F.when(F.col("found") & ~F.col("known"), "new").when(F.col("found") & F.col("is_withdrawn"), "unchanged")
        .when(F.col("found") & other, "updated").when(F.col("found"), "unchanged")
        .when((F.col("status") == "OPEN") & ~F.col("is_manual") & (outcome == "OK"), "disappeared").otherwise("kept")
    )
    return both.select(key, state.alias("state"))


def field_changes(fetched: DataFrame, stored: DataFrame, key: str = "source_url", tracked: list[str] = TRACKED) -> DataFrame:
    """DIF-02: a row for each tracked field whose trimmed value differs."""
    trimmed = lambda side, c: F.trim(F.coalesce(F.col(f"{side}.{c}").cast("string"), F.lit("")))
    parts = [F.struct(F.lit(c).alias("field"), trimmed("s", c).alias("value_before"), trimmed("f", c).alias("value_after")) for c in tracked]
    both = fetched.alias("f").join(stored.alias("s"), key)
    return both.select(key, F.explode(F.array(*parts)).alias("c")).select(key, "c.*").where("value_before <> value_after")


def stored_fields(vacancies: DataFrame) -> DataFrame:
    """DIF-05: vacancies as they are stored: cut to length, with their classes and content hash; a raw field wins over the advert."""
    v = vacancies.withColumns({c: F.substring(F.coalesce(c, F.lit("")), 1, n) for c, n in LENGTHS.items()} | {"description_text": F.coalesce("description_text", F.lit(""))})
    combined = F.array_join(F.filter(F.array("contract_raw", "hours_raw", "description_text"), lambda t: t != ""), " ")
    own = lambda c: F.when(F.col(c) != "", F.col(c)).otherwise(combined)
    return v.withColumns(
        {
            "contract_type": classify.first_match(own("contract_raw"), classify.CONTRACT), "hours": classify.first_match(own("hours_raw"), classify.HOURS), "workplace": classify.first_match(combined, classify.WORKPLACE),
            "discipline": classify.discipline(F.col("title"), F.col("category"), F.col("department")), "content_hash": text.content_hash(*HASHED),
        }
    )


def applied(fetched: DataFrame, stored: DataFrame, states: DataFrame, now: Column, key: str = "source_url") -> DataFrame:
    """DIF-04: the stored table after a diff's states: found rows replaced and open, withdrawn ones as they were, disappeared ones closed.

    fetched and stored share their columns, status, last_seen and disappeared_at among them.
    """
    s, columns = states.select(key, "state"), stored.columns
    fresh = fetched.join(s.where("state IN ('new', 'updated', 'unchanged')"), key).join(stored.where("is_withdrawn").select(key), key, "left_anti")
    fresh = fresh.withColumns({"status": F.lit("OPEN"), "last_seen": now, "disappeared_at": F.lit(None).cast(stored.schema["disappeared_at"].dataType)}).select(*columns)
    old = stored.join(s, key).where("state IN ('disappeared', 'kept') OR is_withdrawn")
    gone = F.col("state") == "disappeared"
    old = old.withColumns({"status": F.when(gone, "DISAPPEARED").otherwise(F.col("status")), "disappeared_at": F.when(gone, now).otherwise(F.col("disappeared_at"))}).select(*columns)
    return fresh.unionByName(old)


def run_view(run_id: int, started: Column, finished: Column, jobs: DataFrame, results: DataFrame, revisions: DataFrame) -> DataFrame:
    """DIF-07, JOIN-06, 07 and 09: (job_id, part) of what a run changed; a job is new, changed or disappeared, never two of them.

    New and disappeared jobs are of the run's institutions, first seen or closed while it ran.
    """
    ours = jobs.join(results.where(F.col("run_id") == run_id).select("institution_id").distinct(), "institution_id", "left_semi")
    during = lambda c: (F.col(c) >= started) & (F.col(c) <= F.coalesce(finished, F.col(c)))
    new = ours.where(during("first_seen")).select("job_id")
    changed = revisions.where(F.col("run_id") == run_id).select("job_id").distinct().join(new, "job_id", "left_anti")
    gone = ours.where((F.col("status") == "DISAPPEARED") & during("disappeared_at")).select("job_id").join(new, "job_id", "left_anti").join(changed, "job_id", "left_anti")
    parts = [(new, "new"), (changed, "changed"), (gone, "disappeared")]
    return parts[0][0].withColumn("part", F.lit("new")).unionByName(parts[1][0].withColumn("part", F.lit("changed"))).unionByName(parts[2][0].withColumn("part", F.lit("disappeared")))


def except_both(left: DataFrame, right: DataFrame, key: str) -> DataFrame:
    """SET-01: keys of one side alone, by one aggregation of both. A null key is no other's equal, so it counts on each side that has it."""
    of = lambda df, is_left: df.select(key, F.lit(is_left).alias("left"), F.lit(not is_left).alias("right"))
    sides = of(left, True).unionByName(of(right, False)).groupBy(key).agg(F.max("left").alias("left"), F.max("right").alias("right"))
    alone = sides.where(~(F.col("left") & F.col("right")) | F.col(key).isNull())
    return alone.select(key, F.explode(F.array_compact(F.array(F.when(F.col("left"), "dropped_off"), F.when(F.col("right"), "newly_listed")))).alias("side"))


def latest_by(df: DataFrame, key: str, at: str) -> DataFrame:
    """JOIN-13, SRC-09 and LIM-04: the newest row of each key."""
    rest = [c for c in df.columns if c != key]
    return df.groupBy(key).agg(F.max_by(F.struct(*rest), at).alias("r")).select(key, "r.*")


def previous_count(runs: DataFrame) -> DataFrame:
    """JOIN-14 and PRJ-08: the vacancies that the run before found at the same institution; an OK crawl permits closing."""
    w = Window.partitionBy("institution_id").orderBy("started_at", "run_id")
    return runs.withColumn("previous_found", F.lag("vacancies_found").over(w)).withColumns({"dropped_to_zero": (F.col("vacancies_found") == 0) & (F.coalesce("previous_found", F.lit(0)) > 0), "permits_closure": F.col("outcome") == "OK"})


def last_crawls(runs: DataFrame) -> DataFrame:
    """PRJ-10: the newest result of each institution as a struct, with the count before it."""
    keep = ["run_id", "outcome", "vacancies_found", "previous_found", "dropped_to_zero", "fallback_fired", "started_at"]
    return previous_count(runs).groupBy("institution_id").agg(F.max_by(F.struct(*keep), F.struct("started_at", "run_id")).alias("last_crawl"))


def run_totals(results: DataFrame) -> DataFrame:
    """AGG-15: of each run."""
    return results.groupBy("run_id").agg(F.count("*").alias("institutions_done"), *[F.sum(c).alias(c) for c in ("jobs_new", "jobs_updated", "jobs_closed")])


def latest_outcomes(results: DataFrame) -> DataFrame:
    """AGG-17: the latest run's outcomes; of runs started together the one with the largest id."""
    newest = results.agg(F.max_by("run_id", F.struct("started_at", "run_id")).alias("run_id"))
    return results.join(newest, "run_id", "left_semi").groupBy("outcome").agg(F.count("*").alias("n"))


def crawl_age(runs: DataFrame, now: Column) -> DataFrame:
    """AGG-18: whole seconds since the last start, null where nothing has run."""
    return runs.agg(F.bround(now.cast("double") - F.max("started_at").cast("timestamp").cast("double"), 0).cast("long").alias("age_seconds"))


def problems_first(rows: DataFrame) -> DataFrame:
    """ORD-05: what went wrong, then the most vacancies, then the name."""
    return rows.orderBy(F.when(F.col("outcome") == "OK", 1).otherwise(0), F.desc("vacancies_found"), "name", "run_id")


def log_level(outcome: Column) -> Column:
    """API-13."""
    return F.when(outcome.isin(WARNINGS), "WARNING").otherwise("INFO")


def outcome_line(name: Column, label: Column, found: Column, outcome: Column, new: Column, updated: Column, closed: Column, error: Column) -> Column:
    """API-13: one line on what a crawl of an institution did."""
    number = lambda c: c.cast("string")
    counts = F.when(outcome == "OK", F.concat(F.lit(" (+"), number(new), F.lit(" new, ~"), number(updated), F.lit(" updated, -"), number(closed), F.lit(" closed)"))).otherwise("")
    return F.concat(name, F.lit(": "), label, F.lit(" — "), number(found), F.lit(" found"), counts, F.when(error != "", F.concat(F.lit(" — "), error)).otherwise(""))


def duration_seconds(started: Column, finished: Column) -> Column:
    """PRJ-07: null while a run goes on."""
    return finished.cast("timestamp").cast("double") - started.cast("timestamp").cast("double")


def is_active(status: Column) -> Column:
    """PRJ-07."""
    return status.isin("RUNNING", "PAUSED")


def run_action(runs: DataFrame, run_id: int, action: str, now: Column) -> DataFrame:
    """STM-05 and API-11: runs after an action on one of them; from any other state it is an error."""
    mine = F.col("run_id") == run_id
    target = F
    for (name, state), to in TRANSITIONS.items():
        if name == action:
            target = target.when(F.col("status") == state, to)
    illegal = F.raise_error(F.concat(F.lit(f"cannot {action} run {run_id}: it is "), F.col("status")))
    settled = F.col("status") if action == "finalise" else illegal.cast("string")
    status = F.when(mine, target.otherwise(settled)).otherwise(F.col("status"))
    ends = mine if action in ("cancel", "finalise") else F.lit(False)
    return runs.withColumn("finished_at", F.when(ends, F.coalesce("finished_at", now)).otherwise(F.col("finished_at"))).withColumn("status", status)


def started(runs: DataFrame, trigger: str, scope: list[int], now: Column) -> DataFrame:
    """STM-05: runs and the next, unless one is active."""
    active = runs.agg(F.coalesce(F.max(F.when(is_active(F.col("status")), F.col("run_id"))), F.lit(0)).alias("active"), (F.coalesce(F.max("run_id"), F.lit(0)) + 1).alias("run_id"))
    free = F.when(F.col("active") > 0, F.raise_error(F.concat(F.lit("run "), F.col("active").cast("string"), F.lit(" is active"))).cast("string")).otherwise("RUNNING")
    ids = F.array(*map(F.lit, scope)).cast("array<long>") if scope else F.array().cast("array<long>")
    new = active.select("run_id", free.alias("status"), F.lit(trigger).alias("trigger"), now.alias("started_at"), F.lit(None).cast("timestamp").alias("finished_at"), ids.alias("institution_ids"))
    return runs.select(*new.columns).unionByName(new)


def run_scope(runs: DataFrame, run_id: int, institutions: DataFrame) -> DataFrame:
    """SET-04: (institution_id, position) of a run's own list, or of all crawlable institutions where it has none."""
    own = runs.where(F.col("run_id") == run_id).select(F.posexplode("institution_ids").alias("position", "institution_id"))
    every = crawlable(institutions).select(F.col("institution_id").alias("position"), "institution_id")
    empty = runs.where((F.col("run_id") == run_id) & (F.size("institution_ids") == 0)).select("run_id")
    return own.select("institution_id", F.col("position").cast("long").alias("position")).unionByName(every.where(F.lit(not empty.isEmpty())).select("institution_id", F.col("position").cast("long").alias("position")))


def retriable(scope: DataFrame, results: DataFrame) -> DataFrame:
    """SET-03: the scope without what came out OK, in its order."""
    return scope.join(results.where("outcome = 'OK'").select("institution_id"), "institution_id", "left_anti").orderBy("position")


def skipped(institutions: DataFrame, run_id: int, reason: str) -> DataFrame:
    """STM-07: result rows of institutions that a run never reached; none of them closes a job."""
    return institutions.select(F.lit(run_id).cast("long").alias("run_id"), "institution_id", F.lit("SKIPPED").alias("outcome"), F.lit(reason).alias("error_detail"), F.lit(0).alias("vacancies_found"))


def stalled(runs: DataFrame, now: Column, minutes: int = 90) -> DataFrame:
    """STM-08."""
    old = (F.col("status") == "RUNNING") & (F.col("heartbeat_at") < now - F.make_dt_interval(mins=F.lit(minutes)))
    return runs.withColumn("status", F.when(old, "INCOMPLETE").otherwise(F.col("status")))


def after_log(log: DataFrame, last: int, limit: int = 500) -> DataFrame:
    """FLT-22: what a live log has that its reader hasn't."""
    return log.where(F.col("id") > last).orderBy("id").limit(limit)


def crawlable(institutions: DataFrame) -> DataFrame:
    """FLT-15."""
    return institutions.where("crawl_enabled AND careers_url <> ''")


def application_state(events: DataFrame) -> DataFrame:
    """STM-01: status now, first application and first reply from (application_id, to_status, occurred_at, event_id).

    An event that repeats the status before it changes nothing; an application starts as FOUND.
    """
    w = Window.partitionBy("application_id").orderBy("occurred_at", "event_id")
    moves = events.withColumn("from_status", F.coalesce(F.lag("to_status").over(w), F.lit("FOUND"))).where(~F.col("to_status").eqNullSafe(F.col("from_status")))
    when = lambda test: F.min(F.when(test, F.col("occurred_at")))
    return moves.groupBy("application_id").agg(
        F.max_by("to_status", F.struct("occurred_at", "event_id")).alias("status"), when(F.col("to_status") == "APPLIED").alias("applied_at"),
        when(F.col("to_status").isin(REPLIES)).alias("response_at"), F.count("*").alias("moves"),
    )


def flagged(applications: DataFrame, now: Column, days: int = 21) -> DataFrame:
    """STM-02: sets the flag of applications that nobody has answered; never the status."""
    quiet = classify.looks_ghosted(F.col("status"), F.col("applied_at"), F.col("response_at"), now, days)
    return applications.withColumn("ghosted_flagged", F.coalesce("ghosted_flagged", F.lit(False)) | quiet)


def board(applications: DataFrame) -> DataFrame:
    """AGG-19: an owner's applications (application_id, status) in the board's columns, empty ones kept."""
    columns = F.explode(F.array(*[F.struct(F.lit(k).alias("position"), F.lit(s).alias("status")) for k, s in enumerate(BOARD)])).alias("c")
    all_columns = applications.sparkSession.range(1).select(columns).select("c.*")
    cards = applications.groupBy("status").agg(F.array_sort(F.collect_list("application_id")).alias("cards"))
    return all_columns.join(cards, "status", "left").select("position", "status", F.coalesce("cards", F.array().cast("array<long>")).alias("cards"))


def withdrawn(jobs: DataFrame, ids: list[int], now: Column) -> DataFrame:
    """STM-03."""
    mine = F.col("job_id").isin(ids)
    return jobs.withColumns({"status": F.when(mine, "WITHDRAWN").otherwise(F.col("status")), "withdrawn_at": F.when(mine, now).otherwise(F.col("withdrawn_at"))})


def reinstated(jobs: DataFrame, ids: list[int]) -> DataFrame:
    """STM-03: withdrawn jobs open again; others stay."""
    mine = F.col("job_id").isin(ids) & (F.col("status") == "WITHDRAWN")
    return jobs.withColumns({"status": F.when(mine, "OPEN").otherwise(F.col("status")), "withdrawn_at": F.when(mine, F.lit(None)).otherwise(F.col("withdrawn_at"))})


def without_manual(jobs: DataFrame, ids: list[int]) -> DataFrame:
    """STM-03: only jobs added by hand may be deleted; asking for another is an error."""
    mine = F.col("job_id").isin(ids)
    wrong = F.raise_error(F.concat(F.lit("not added by hand: "), F.col("job_id").cast("string"))).cast("boolean")
    return jobs.where(F.when(mine & (F.col("source") != "MANUAL"), wrong).otherwise(~mine))


def upserted(rows: DataFrame, new: DataFrame, *key: str) -> DataFrame:
    """STM-04: new rows replace those of their key."""
    return rows.join(new.select(*key), list(key), "left_anti").select(*rows.columns).unionByName(new.select(*rows.columns))


def manual_jobs(drafts: DataFrame) -> DataFrame:
    """API-01: jobs added by hand as they are stored: text from HTML and classes from the text, each only where nobody gave it. See added_by_hand() for their screenings."""
    d = drafts.withColumn("description_text", F.coalesce(F.nullif(F.col("description_text"), F.lit("")), pages.html_to_text(F.col("description_html"))))
    classes = ["contract_type", "hours", "workplace", "discipline"]
    given = stored_fields(d.select("*", *[F.col(c).alias(f"given_{c}") for c in classes]))
    chosen = {c: F.coalesce(F.nullif(F.col(f"given_{c}"), F.lit("")), F.col(c)) for c in classes}
    return given.withColumns(chosen | {"source": F.lit("MANUAL"), "status": F.lit("OPEN")}).drop(*[f"given_{c}" for c in classes])


def added_by_hand(drafts: DataFrame, matches: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """API-01: manual_jobs() and the screening of each, made at once as for any other job."""
    jobs = manual_jobs(drafts)
    return jobs, screening.screened(jobs, matches, rules)


def edited(jobs: DataFrame, job_id: int, changes: dict) -> DataFrame:
    """API-02: one job added by hand with changed fields; editing a crawled one is an error. See edited_by_hand() for what follows from it."""
    mine = F.col("job_id") == job_id
    wrong = F.raise_error(F.lit(f"job {job_id} was not added by hand")).cast("string")
    source = F.when(mine & (F.col("source") != "MANUAL"), wrong).otherwise(F.col("source"))
    return jobs.withColumns({"source": source} | {c: F.when(mine, F.lit(v)).otherwise(F.col(c)) for c, v in changes.items()})


def edited_by_hand(jobs: DataFrame, screenings: DataFrame, job_id: int, changes: dict, matches: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame, DataFrame]:
    """API-02: all jobs after an edit, all screenings with that job's made anew, and that job with its search vectors made anew."""
    after = edited(jobs, job_id, changes)
    one = after.where(F.col("job_id") == job_id)
    return after, upserted(screenings, screening.screened(one, matches, rules), "job_id"), search.with_vectors(one)


def taken(rows: DataFrame, wanted: DataFrame, *key: str) -> DataFrame:
    """API-12: the wanted rows (owner and key) that exist already."""
    return wanted.join(rows.select("owner", *key).distinct(), ["owner", *key], "left_semi")
