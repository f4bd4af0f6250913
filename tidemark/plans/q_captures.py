"""Registered queries: capture selection and fetch bookkeeping."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import urls as U
from tidemark.operators import captures as C
from tidemark.operators import fetchlog as L
from tidemark.plans.inputs import FIRST_YEAR, LAST_YEAR, captures, errors, fetch_log, oracle
from tidemark.plans.registry import query, table
from tidemark.session import work_dir, written
from tidemark.sources.tables import KeyedTable

# The page URLs of a community.
_TEMPLATES = (
    "https://www.reddit.com/r/{}/about/moderators",
    "https://www.reddit.com/r/{}/wiki/index",
)

_COLLAPSED = """select * from (select *, lag(digest) over (partition by url order by ts14, pos) as prev,
  row_number() over (partition by url order by ts14, pos) as rn from captures)
  where rn = 1 or prev is distinct from digest"""

_OK = """(capture_url = final_url or (substr(ts14, 1, 4) = substr(split_part(final_url, '/', 5), 1, 4)
  and (month <= 6) = (cast(substr(split_part(final_url, '/', 5), 5, 2) as int) <= 6)))"""

_MARKED = f"""select *, (error_code in (3, 4, 5) or (error_code = 0 and not {_OK})) as rej,
  row_number() over (partition by url, year, half order by ts14, pos) as nth from collapsed"""


@query(
    "join_seed_template",
    """select c_custkey as id, replace(t, '{}', c_name) as url from customer,
      (values ('https://www.reddit.com/r/{}/about/moderators'),
              ('https://www.reddit.com/r/{}/wiki/index')) v(t)""",
)
def join_seed_template(spark, sf_dir):
    seeds = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), "c_name")
    return C.expand_templates(seeds, _TEMPLATES, "c_name").select("id", "url")


@query("win_collapse_digest", oracle("select pos, url, ts14, digest from collapsed", "captures", collapsed=_COLLAPSED))
def win_collapse_digest(spark, sf_dir):
    return C.collapse_digest(captures(spark, sf_dir)).select("pos", "url", "ts14", "digest")


@query(
    "win_first_per_slot",
    oracle(
        """select url, year, half, pos, capture_url from (
          select *, row_number() over (partition by url, year, half order by ts14, pos) as n
          from collapsed) where n = 1""",
        "captures",
        collapsed=_COLLAPSED,
    ),
)
def win_first_per_slot(spark, sf_dir):
    kept = C.collapse_digest(captures(spark, sf_dir).drop("year", "month", "half"))
    slots = C.year_filter(C.with_slot(kept), FIRST_YEAR, LAST_YEAR)
    return C.first_per_slot(slots).select("url", "year", "half", "pos", "capture_url")


@query(
    "win_resolve_slot",
    oracle(
        """select url, year, half,
          case when min(nth) filter (not rej) is null then 'exhausted'
               when arg_min(error_code, nth) filter (not rej) in (0, 7) then 'filled'
               else 'deferred' end as state,
          arg_min(pos, nth) filter (not rej) as pos,
          coalesce(min(nth) filter (not rej), count(*)) as attempts, count(*) as candidates
        from marked group by url, year, half""",
        "captures",
        collapsed=_COLLAPSED,
        marked=_MARKED,
    ),
)
def win_resolve_slot(spark, sf_dir):
    kept = C.collapse_digest(captures(spark, sf_dir), keep=True)
    ok = U.redirect_ok(F.col("capture_url"), F.col("final_url"))
    return C.resolve_slots(kept, ok).select(
        "url", "year", "half", "state", "pos", "attempts", "candidates"
    )


@query(
    "agg_slot_gaps",
    oracle(
        """select g.url, g.year, g.half,
          case when not exists (select 1 from seen s where s.url = g.url) then 'url'
               when not exists (select 1 from seen s where s.url = g.url and s.year = g.year) then 'year'
               else 'half' end as reason
        from (select url, cast(y as int) as year, cast(h as int) as half
              from wanted, range(1995, 2005) a(y), (values (1), (2)) b(h)) g
        where not exists (select 1 from seen s where s.url = g.url and s.year = g.year and s.half = g.half)""",
        "captures",
        seen="select distinct url, year, half from captures where error_code = 0",
        wanted="select concat('https://www.reddit.com/r/c', cast(c_custkey as string), '/about/moderators') as url from customer",
    ),
)
def agg_slot_gaps(spark, sf_dir):
    """Slots without a successful capture, for every seed."""
    template = "https://www.reddit.com/r/c{}/about/moderators"
    seeds = table(spark, sf_dir, "customer").select(F.col("c_custkey").cast("string").alias("name"))
    wanted = C.expand_templates(seeds, [template]).select("url")
    seen = captures(spark, sf_dir).where("error_code = 0")
    return C.slot_gaps(wanted, seen, 1995, 2004)


@query(
    "agg_capture_counts",
    oracle("select url, count(*) as captures from captures group by url", "captures"),
)
def agg_capture_counts(spark, sf_dir):
    return C.capture_counts(captures(spark, sf_dir))


_STORED = "select distinct md5(concat(final_url, '{}')) as k from captures where error_code in (0, 1)"


@query(
    "join_skip_cached",
    oracle(
        """select pos, md5(concat(capture_url, '{}')) as cache_key from captures
        where md5(concat(capture_url, '{}')) not in (select k from stored)""",
        "captures",
        stored=_STORED,
    ),
)
def join_skip_cached(spark, sf_dir):
    return _cached(spark, sf_dir, hits=False)


@query(
    "join_cached_hits",
    oracle(
        """select pos, md5(concat(capture_url, '{}')) as cache_key from captures
        where md5(concat(capture_url, '{}')) in (select k from stored)""",
        "captures",
        stored=_STORED,
    ),
)
def join_cached_hits(spark, sf_dir):
    return _cached(spark, sf_dir, hits=True)


@query(
    "join_skip_cached_requested",
    oracle(
        """select pos, md5(concat(capture_url, '{}')) as cache_key from captures
        where md5(concat(capture_url, '{}')) not in (select k from stored)""",
        "captures",
        stored=_STORED
        + " union select md5(concat(capture_url, '{}')) from captures where error_code in (0, 1)",
    ),
)
def join_skip_cached_requested(spark, sf_dir):
    return _cached(spark, sf_dir, hits=False, also_requested=True)


def _cached(spark, sf_dir, hits, also_requested=False):
    """Requests against the stored pages, which are never shuffled: they lie in buckets by their key."""
    rows = captures(spark, sf_dir)
    stored = rows.where("error_code in (0, 1)").select(
        U.cache_key(F.col("final_url")).alias("cache_key"),
        U.cache_key(F.col("capture_url")).alias("requested_key"),
    )
    pages = KeyedTable(spark, work_dir(spark, "pages"), "cache_key", [stored.schema["requested_key"]])
    pages.put(stored, 0)
    requests = rows.select("pos", U.cache_key(F.col("capture_url")).alias("cache_key"))
    if also_requested:  # a page was asked for under several keys, of which the store has the last
        return C.skip_cached(requests, stored, hits, also_requested).select("pos", "cache_key")
    return C.skip_cached(requests, pages.current(), hits).select("pos", "cache_key")


_STATE = """select url, max(ts * 10 + error_code) as top,
  cast(max(ts * 10 + error_code) as bigint) % 10 in (3, 4, 5) as fatal from errors group by url"""
_FAILED = "select distinct url from errors where error_code in (1, 2, 6)"


@query(
    "join_rescue",
    oracle(
        "select url from state where not fatal and url in (select url from failed)",
        "errors",
        state=_STATE,
        failed=_FAILED,
    ),
)
def join_rescue(spark, sf_dir):
    events = errors(spark, sf_dir)
    return L.rescue_list(events.where("error_code in (1, 2, 6)"), L.fail_state(events))


@query(
    "join_rescue_outcome",
    oracle(
        """select url, fatal from state
        where url not in (select url from errors where error_code = 0 and ts > 10000)""",
        "errors",
        state=_STATE,
    ),
)
def join_rescue_outcome(spark, sf_dir):
    events = errors(spark, sf_dir)
    second = events.where("ts > 10000").select("url", "error_code")
    return L.rescue_outcome(L.fail_state(events), second).select("url", "fatal")


ERROR_LISTS_ORACLE = oracle(
    """select url, cast((seq - 1) // 4 as bigint) as chunk, count(*) as n,
      string_agg(concat(cast(cast(ts as bigint) as string), ':', cast(error_code as string)), ',' order by seq) as errors
    from (select *, row_number() over (partition by url order by ts, error_code) as seq from errors)
    group by 1, 2""",
    "errors",
)


def error_texts(lists):
    """Lists of errors as comparable text rows."""
    text = F.transform(
        "errors",
        lambda e: F.concat(
            e["ts"].cast("bigint").cast("string"), F.lit(":"), e["error_code"].cast("string")
        ),
    )
    return lists.select(
        "url",
        "chunk",
        F.size("errors").cast("bigint").alias("n"),
        F.array_join(text, ",").alias("errors"),
    )


@query("agg_error_history", ERROR_LISTS_ORACLE)
def agg_error_history(spark, sf_dir):
    return error_texts(L.error_history(errors(spark, sf_dir), chunk=4))


_OUTCOME = """select url, coalesce(arg_min(code, n) filter (code is not null), case when max(n) >= 3 then 6 end) as error_code,
          cast(coalesce(min(n) filter (code is not null), max(n)) as int) as attempts
        from (
          select url, n, case when error = 'ssl' then 4 when error = 'timeout' then null
            when error = 'connection' then 2 when error is not null then 5
            when status = 429 or status between 500 and 599 then null
            when status = 403 and url like 'https://%' and forbidden = 0 then null
            when status between 400 and 499 then 3 else 0 end as code
          from (select *, coalesce(sum(case when status = 403 then 1 else 0 end) over (
                  partition by url order by n rows between unbounded preceding and 1 preceding), 0)
                as forbidden from made))
        group by url"""
_MADE = """select url, n, status, error from (select *, row_number() over (
          partition by url order by attempt, status nulls first, error nulls first) as n
          from fetch_log) where n <= 3"""


@query("agg_fetch_outcome", oracle(_OUTCOME, "fetch_log", made=_MADE))
def agg_fetch_outcome(spark, sf_dir):
    return L.fetch_outcome(fetch_log(spark, sf_dir))


@query(
    "agg_index_retry",
    oracle(
        """select url, case when c1 <> 2 then c1 when c2 is not null then c2 end as error_code,
          case when c1 <> 2 or c2 is null then 1 else 2 end as calls,
          coalesce((case when c1 <> 2 then c1 else c2 end) = 0, false) as has_index
        from (select url, min(case when n = 1 then error_code end) as c1,
                min(case when n = 2 then error_code end) as c2
              from (select url, error_code,
                      row_number() over (partition by url order by cast(ts % 2 as int), error_code) as n from errors)
              group by url)""",
        "errors",
    ),
)
def agg_index_retry(spark, sf_dir):
    calls = errors(spark, sf_dir).select(
        "url", "error_code", (F.lit(1) + (F.col("ts") % 2).cast("int")).alias("call")
    )
    return L.index_outcome(calls)


_JOB_ORDER = "order by ts14, pos rows between unbounded preceding and 1 preceding"


def _job_tables(unknown: str) -> dict:
    """Tables of the capture job; captures under the condition ``unknown`` have no outcome yet."""
    return dict(
        made=_MADE,
        outcome=_OUTCOME,
        fetched=f"""select c.* exclude (error_code), cast(case when c.pos % 13 = 0 then 7 when {unknown} then null
            else coalesce(o.error_code, 6) end as int)
          as error_code from captures c left join (
            select cast(split_part(url, '/', 4) as bigint) as pos, error_code from outcome) o on c.pos = o.pos""",
        collapsed=_COLLAPSED.replace("from captures)", "from fetched)"),
        marked=_MARKED,
        tried=f"""select * from (select *, coalesce(sum(case when rej then 0 else 1 end) over (
          partition by url, year, half {_JOB_ORDER}), 0) as stops from marked) where stops = 0""",
    )


def _job(spark, sf_dir, unknown):
    outcome = L.fetch_outcome(fetch_log(spark, sf_dir)).select(
        F.element_at(F.split("url", "/"), 4).cast("bigint").alias("pos"), "error_code"
    )
    # Written once: the job's sample, sums and rows each read its input.
    rows = captures(spark, sf_dir).drop("error_code").join(written(outcome, "outcomes"), "pos", "left")
    code = F.when(~unknown, F.coalesce("error_code", F.lit(6)))
    rows = rows.withColumn("error_code", code).withColumn("cache_key", U.cache_key(F.col("pos").cast("string")))
    cached = rows.where("pos % 13 = 0").select("cache_key")
    ok = U.redirect_ok(F.col("capture_url"), F.col("final_url"))
    return C.capture_job(rows, cached, ok, FIRST_YEAR, LAST_YEAR)


@query(
    "job_capture",
    oracle(
        """select 'tried' as target, url, year, half, pos, error_code from tried
        union all select 'error', url, year, half, pos, error_code from tried where error_code not in (0, 7)
        union all select 'rescue', url, year, half, pos, error_code from tried where error_code in (1, 2, 6)
        union all select 'slot', url, year, half, arg_min(pos, nth) filter (not rej),
          arg_min(error_code, nth) filter (not rej) from marked group by url, year, half""",
        "captures",
        "fetch_log",
        **_job_tables("false"),
    ),
)
def job_capture(spark, sf_dir):
    """The capture job as one plan, from index rows and the attempts log."""
    job = _job(spark, sf_dir, F.lit(False))
    columns = ("url", "year", "half", "pos", "error_code")
    parts = {"slot": job.slots, "tried": job.tried, "error": job.errors, "rescue": job.rescue}
    out = None
    for name, part in parts.items():
        part = part.select(F.lit(name).alias("target"), *columns)
        out = part if out is None else out.unionByName(part)
    return out


@query(
    "job_fetch_list",
    oracle(
        "select url, year, half, pos, capture_url from tried where error_code is null",
        "captures",
        "fetch_log",
        **_job_tables("c.pos % 3 = 0"),
    ),
)
def job_fetch_list(spark, sf_dir):
    """What a fetcher gets next: per slot the first capture without an outcome, if all before it were rejected."""
    job = _job(spark, sf_dir, F.col("pos") % 3 == 0)
    return job.fetch.select("url", "year", "half", "pos", "capture_url")
