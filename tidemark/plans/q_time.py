"""Registered queries: incremental jobs and changes over time."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.operators import evolution as V
from tidemark.plans.inputs import errors, oracle
from tidemark.plans.q_layouts import DISPATCH_ORACLE, dispatch_pages, dispatch_rows, md5_scorer
from tidemark.plans.q_captures import ERROR_LISTS_ORACLE, error_texts
from tidemark.plans.registry import query, table
from tidemark.session import work_dir
from tidemark.sources.tables import VersionedTable
from tidemark.streaming import jobs


def _parse(spark, *arrivals):
    """Each part arrives after the job has handled the one before it."""
    landing, root = work_dir(spark, "landing"), work_dir(spark, "parsed")
    tables = jobs.PageTables(spark, root)
    for pages in arrivals:
        pages.write.mode("append").parquet(landing)
        stream = jobs.read_landing(spark, landing, jobs.PAGE_SCHEMA)
        jobs.finish(
            jobs.parse_pending(stream, tables, f"{root}/checkpoint", md5_scorer, 0.505, interval=None)
        )
    return dispatch_rows(tables.rules.current(), tables.moderators.current())


@query("stream_parse_pending", DISPATCH_ORACLE)
def stream_parse_pending(spark, sf_dir):
    pages = dispatch_pages(spark, sf_dir).withColumn("stamp", F.lit(1.0))
    return _parse(spark, pages)


@query("stream_reparse_on_replace", DISPATCH_ORACLE)
def stream_reparse_on_replace(spark, sf_dir):
    """Moderator pages are stored twice: an older copy with other people, then the current one."""
    pages = dispatch_pages(spark, sf_dir).withColumn("stamp", F.lit(2.0))
    old = pages.where(F.col("original").endswith("/about/moderators")).select(
        "page_id",
        "original",
        F.replace("html", F.lit("/u"), F.lit("/old")).alias("html"),
        F.lit(1.0).alias("stamp"),
    )
    stale = old.withColumn("html", F.regexp_replace("html", "<b>", "<b>9"))
    return _parse(spark, stale, pages)


@query(
    "stream_error_history",
    oracle(
        """select url, cast(max(ts * 10 + error_code) as bigint) % 10 in (3, 4, 5) as fatal,
          cast(cast(max(ts * 10 + error_code) as bigint) % 10 as int) as last_code,
          max(ts) as last_ts, count(*) as n_errors
        from errors group by url""",
        "errors",
    ),
)
def stream_error_history(spark, sf_dir):
    landing, root = work_dir(spark, "landing"), work_dir(spark, "errors")
    state = VersionedTable(spark, f"{root}/state", ["url"], "n_errors")
    events = errors(spark, sf_dir)
    for part in (events.where("ts % 2 = 0"), events.where("ts % 2 <> 0")):
        part.write.mode("append").parquet(landing)
        stream = jobs.read_landing(spark, landing, jobs.ERROR_SCHEMA)
        jobs.finish(jobs.track_errors(stream, state, f"{root}/checkpoint", interval=None))
    return state.current()


@query("stream_error_list", ERROR_LISTS_ORACLE)
def stream_error_list(spark, sf_dir):
    """The ordered lists after two runs, the second of which goes on from the first one's checkpoint."""
    landing, root = work_dir(spark, "landing"), work_dir(spark, "error_lists")
    log = VersionedTable(spark, f"{root}/log", ["url", "seq"], "ts")
    events = errors(spark, sf_dir)
    middle = events.agg(F.avg("ts")).scalar()
    for part in (events.where(F.col("ts") <= middle), events.where(F.col("ts") > middle)):
        part.write.mode("append").parquet(landing)
        stream = jobs.read_landing(spark, landing, jobs.ERROR_SCHEMA)
        jobs.finish(jobs.list_errors(stream, log, f"{root}/checkpoint", chunk=4, interval=None))
    return error_texts(jobs.error_lists(log.log()))


# Facts per community and half-year, from orders and line items.
_JOINED = """select concat('c', cast(o_custkey % 100 as string)) as community,
    cast(year(o_orderdate) * 2 + (case when month(o_orderdate) <= 6 then 0 else 1 end) as int) as slot,
    l_suppkey, l_quantity, l_returnflag, l_partkey
  from orders join lineitem on o_orderkey = l_orderkey"""


def _joined(spark, sf_dir):
    month = F.month("o_orderdate")
    slot = V.slot_number(F.year("o_orderdate"), F.when(month <= 6, 1).otherwise(2))
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey",
        F.concat(F.lit("c"), (F.col("o_custkey") % 100).cast("string")).alias("community"),
        slot.alias("slot"),
    )
    items = table(spark, sf_dir, "lineitem").select(
        "l_orderkey", "l_suppkey", "l_quantity", "l_returnflag", "l_partkey"
    )
    return orders.join(items, F.col("o_orderkey") == F.col("l_orderkey"))


_CHANGES = """select coalesce(n.community, b.community) as community, coalesce(n.slot, b.slot) as slot,
    coalesce(n.item, b.item) as item,
    case when n.item is not null and b.item is not null then 'kept'
         when n.item is not null then 'added' else 'removed' end as change
  from (select f.* from facts f join slots s on f.community = s.community and f.slot = s.slot
        where s.prev is not null) n
  full outer join (select f.community, s.next as slot, f.item from facts f
        join slots s on f.community = s.community and f.slot = s.slot where s.next is not null) b
  on n.community = b.community and n.slot = b.slot and n.item = b.item"""
_SLOTS = """select community, slot, lag(slot) over w as prev, lead(slot) over w as next
  from (select distinct community, slot from facts) window w as (partition by community order by slot)"""


@query(
    "evo_rules_diff",
    oracle(
        "select * from changes where change <> 'kept'",
        joined=_JOINED,
        facts="select distinct community, slot, p_name as item from joined join part on l_partkey = p_partkey",
        slots=_SLOTS,
        changes=_CHANGES,
    ),
)
def evo_rules_diff(spark, sf_dir):
    parts = table(spark, sf_dir, "part").select("p_partkey", F.col("p_name").alias("item"))
    facts = _joined(spark, sf_dir).join(parts, F.col("l_partkey") == F.col("p_partkey"))
    return V.rules_diff(facts)


@query(
    "evo_moderator_churn",
    oracle(
        """select community, slot, count(*) filter (change = 'added') as joined,
          count(*) filter (change = 'removed') as departed, count(*) filter (change = 'kept') as stayed
        from changes group by 1, 2""",
        joined=_JOINED,
        facts="select distinct community, slot, l_suppkey as item from joined",
        slots=_SLOTS,
        changes=_CHANGES,
    ),
)
def evo_moderator_churn(spark, sf_dir):
    return V.moderator_churn(_joined(spark, sf_dir).withColumnRenamed("l_suppkey", "item"))


@query(
    "evo_permission_change",
    oracle(
        """select community, username, slot, old, permission as new from (
          select *, lag(permission) over (partition by community, username order by slot) as old,
            row_number() over (partition by community, username order by slot) as n
          from (select community, l_suppkey as username, slot, max(l_returnflag) as permission
                from joined group by 1, 2, 3))
        where n > 1 and old is distinct from permission""",
        joined=_JOINED,
    ),
)
def evo_permission_change(spark, sf_dir):
    roster = _joined(spark, sf_dir).select(
        "community",
        F.col("l_suppkey").alias("username"),
        "slot",
        F.col("l_returnflag").alias("permission"),
    )
    return V.permission_changes(roster)


@query(
    "evo_trend",
    oracle(
        """select slot, count(*) as communities, cast(sum(n) as bigint) as entries,
          round(avg(n), 6) as mean_size, max(karma) as top_karma
        from (select slot, community, count(*) as n, max(cast(l_quantity as int)) as karma
              from joined group by 1, 2) group by slot""",
        joined=_JOINED,
    ),
)
def evo_trend(spark, sf_dir):
    roster = _joined(spark, sf_dir).select(
        "community", "slot", F.col("l_quantity").cast("int").alias("karma")
    )
    return V.trend(roster).withColumn("mean_size", F.round("mean_size", 6))
