"""Registered queries: sources and sinks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import urls as U
from tidemark.operators import fetchlog
from tidemark.plans.inputs import captures, errors, oracle
from tidemark.plans.registry import query, table
from tidemark.session import work_dir
from tidemark.sources import capture_index, page_store, tsv
from tidemark.sources.files import remove_listed, write_listed
from tidemark.sources.tables import KeyedTable

_COMMUNITY_PATH = "concat('/r/', lower(lang), cast(page_id % 40 as string), '/about')"


@query(
    "src_seed_tsv",
    "select trim(c_name) as name, count(*) as n from customer group by 1",
)
def src_seed_tsv(spark, sf_dir):
    path = work_dir(spark, "seeds")
    customers = table(spark, sf_dir, "customer")
    customers.select(
        F.concat(F.lit("  "), "c_name", F.lit(" ")).alias("name"), "c_mktsegment"
    ).write.csv(
        path,
        sep="\t",
        header=True,
        ignoreLeadingWhiteSpace=False,
        ignoreTrailingWhiteSpace=False,
    )
    return tsv.read_seeds(spark, path).groupBy("name").agg(F.count(F.lit(1)).alias("n"))


@query(
    "src_labelled_tsv",
    """select coalesce(nullif(s, ''), '') as text, label, count(*) as n
    from (select case when event_id % 5 = 0 then '' else props end as s,
                 case when event_type = 'error' then 'rule' else 'non-rule' end as label from events)
    group by 1, 2""",
)
def src_labelled_tsv(spark, sf_dir):
    path = work_dir(spark, "labelled")
    (
        table(spark, sf_dir, "events")
        .select(
            F.when(F.col("event_id") % 5 != 0, F.col("props")).alias("text"),
            F.when(F.col("event_type") == "error", " rule ").otherwise("non-rule").alias("label"),
        )
        .write.csv(path, sep="\t", header=True, escape='"', quote='"')
    )
    return (
        tsv.read_labelled(spark, path)
        .groupBy("text", "label")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def _store(spark, key, rows):
    """An empty keyed table for the fields of the rows."""
    fields = [f for f in rows.schema.fields if f.name != key]
    return KeyedTable(spark, work_dir(spark, "store"), key, fields)


# Rows of one response at most: a range of order keys.
_RESPONSE = 4096


# Index files on the disk at a time, about.
_FILES = 1 << 18


def _responses(spark, sf_dir):
    """Index responses rendered from the captures, one per URL, second and range of positions; a few
    are damaged."""
    group = F.floor(F.col("pos") / _RESPONSE).cast("string")
    row = F.array(
        "url", "ts14", "url", F.lit("text/html"), F.lit("200"), "digest", F.col("pos").cast("string")
    )
    header = F.array(*[F.lit(c) for c in capture_index.INDEX_COLUMNS])
    return (
        captures(spark, sf_dir)
        .groupBy("url", "ts14", group.alias("part"))
        .agg(F.sort_array(F.collect_list(F.struct("pos", row.alias("row")))).alias("rows"))
        .select(
            F.concat("url", F.lit("#"), "ts14", F.lit("#"), "part").alias("seed_url"),
            F.to_json(F.concat(F.array(header), F.col("rows.row"))).alias("json"),
            F.substring("ts14", 7, 2).alias("day"),
        )
        .select("seed_url", F.when(F.col("day") == "13", F.lit("{broken")).otherwise(F.col("json")).alias("body"))
    )


@query(
    "src_capture_index",
    oracle(
        """select concat(url, '#', ts14, '#', pos // 4096) as seed_url,
           cast(row_number() over (partition by url, ts14, pos // 4096 order by pos) - 1 as int) as pos,
           ts14, url as original, digest, pos as length
        from captures where substr(ts14, 7, 2) <> '13'""",
        "captures",
    ),
)
def src_capture_index(spark, sf_dir):
    return capture_index.parse_index(_responses(spark, sf_dir)).select(
        "seed_url", "pos", "ts14", "original", "digest", "length"
    )


@query(
    "src_capture_index_rejected",
    oracle(
        """select distinct concat(url, '#', ts14, '#', pos // 4096) as seed_url, '{broken' as body
        from captures where substr(ts14, 7, 2) = '13'""",
        "captures",
    ),
)
def src_capture_index_rejected(spark, sf_dir):
    return capture_index.rejected_responses(_responses(spark, sf_dir))


def _page_docs(spark, sf_dir):
    """Pages under community URLs, and documents pointing at them; some point nowhere."""
    url = F.concat(
        F.lit("https://web.archive.org/web/20200101000000/https://www.reddit.com/r/c"),
        (F.col("page_id") % 40).cast("string"),
        F.lit("/"),
        F.col("page_id").cast("string"),
    )
    pages = table(spark, sf_dir, "pages").select("page_id", url.alias("url"), "html")
    docs = pages.select(
        "page_id",
        F.when(F.col("page_id") % 11 == 0, F.lit("https://www.reddit.com/about"))
        .otherwise(U.original_url(F.col("url")))
        .alias("original"),
        F.when(F.col("page_id") % 7 == 0, F.lit(None))
        .when(F.col("page_id") % 5 == 0, F.lit("gone.html"))
        .otherwise(U.file_path(F.col("url")))
        .alias("file_path"),
    )
    return pages, docs


@query(
    "src_pages_by_path",
    """select page_id,
      case when page_id % 11 = 0 then 'bad_url' when page_id % 7 = 0 then 'no_path'
           when page_id % 5 = 0 then 'missing_file' else 'ok' end as status,
      case when page_id % 7 = 0 or page_id % 5 = 0 then 0 else length(html) end as html_chars
    from pages""",
)
def src_pages_by_path(spark, sf_dir):
    pages, docs = _page_docs(spark, sf_dir)
    store = page_store.with_path(pages)
    return page_store.pages_for_docs(docs, store).select(
        "page_id", "status", F.coalesce(F.length("html"), F.lit(0)).cast("bigint").alias("html_chars")
    )


@query(
    "src_pages_from_files",
    """select page_id,
      case when page_id % 11 = 0 then 'bad_url' when page_id % 7 = 0 then 'no_path'
           when page_id % 5 = 0 or page_id % 9 = 0 then 'missing_file' else 'ok' end as status,
      case when page_id % 7 = 0 or page_id % 5 = 0 or page_id % 9 = 0 then null else md5(html) end as html_md5
    from pages where page_id % 4 <> 0""",
)
def src_pages_from_files(spark, sf_dir):
    """Pending documents as the manifest of a folder of page files, of which some were deleted."""
    pages, docs = _page_docs(spark, sf_dir)
    root = work_dir(spark, "page_files")
    page_store.write_page_files(pages.where("page_id % 9 <> 0"), root)
    cache = docs.withColumn("pending", F.col("page_id") % 4 != 0)
    found = page_store.pages_from_files(page_store.pending(cache), root)
    return found.select("page_id", "status", F.md5("html").alias("html_md5"))


@query(
    "src_index_from_files",
    oracle(
        """select concat(url, '#', ts14, '#', pos // 4096) as seed_url, 'capture' as kind,
           cast(row_number() over (partition by url, ts14, pos // 4096 order by pos) - 1 as int) as pos,
           ts14, digest
        from captures where substr(ts14, 7, 2) <> '13' and substr(ts14, 7, 2) <> '07'
        union all select distinct concat(url, '#', ts14, '#', pos // 4096), 'rejected', null, null, null
        from captures where substr(ts14, 7, 2) = '13'
        union all select distinct concat(url, '#', ts14, '#', pos // 4096), 'missing_file', null, null, null
        from captures where substr(ts14, 7, 2) = '07'""",
        "captures",
    ),
)
def src_index_from_files(spark, sf_dir):
    """Index responses from one file per seed URL; some seeds have none, some files cannot be used.

    A file takes a block of the disk, however short it is. So responses are written, read and removed in rounds of
    about ``_FILES`` files, and the rows are kept."""
    rounds = captures(spark, sf_dir).count() // _FILES + 1
    responses = _responses(spark, sf_dir).withColumn("round", F.pmod(F.xxhash64("seed_url"), F.lit(rounds)))
    path, root, kept = (work_dir(spark, label) for label in ("responses", "index_files", "index_rows"))
    responses.write.partitionBy("round").parquet(path)
    for i in range(rounds):
        some = spark.read.schema(responses.schema).parquet(path).where(F.col("round") == i).drop("round")
        read = _index_files(some, root).persist()  # each file is read once
        rows = _index_rows(read)
        rows.write.mode("append").parquet(kept)
        read.unpersist()
        remove_listed(some.select(capture_index.index_file(F.col("seed_url"), spread=True).alias("file")), "file", root)
    return spark.read.schema(rows.schema).parquet(kept)


def _index_files(responses, root):
    """What the files of the responses hold, once they are written but for some."""
    named = responses.withColumn("file", capture_index.index_file(F.col("seed_url"), spread=True))
    day = F.substring(F.element_at(F.split("seed_url", "#"), -2), 7, 2)
    write_listed(named.where(day != "07"), "file", "body", root)
    return capture_index.responses_from_files(responses.select("seed_url"), root, spread=True)


def _index_rows(read):
    nothing = [F.lit(None).cast(t).alias(c) for c, t in (("pos", "int"), ("ts14", "string"), ("digest", "string"))]
    there = read.where("status = 'ok'")
    rejected = capture_index.rejected_responses(there).select("seed_url", F.lit("rejected").alias("kind"), *nothing)
    missing = read.where("status <> 'ok'").select("seed_url", F.col("status").alias("kind"), *nothing)
    rows = capture_index.parse_index(there).select("seed_url", F.lit("capture").alias("kind"), "pos", "ts14", "digest")
    return rows.union(rejected).union(missing)


@query(
    "sink_page_store",
    """select page_id, substr(concat('c', cast(page_id % 40 as string)), 1, 3) as prefix,
      concat(substr(concat('c', cast(page_id % 40 as string)), 1, 3),
        '/https___web.archive.org_web_20200101000000_https___www.reddit.com_r_c',
        cast(page_id % 40 as string), '_', cast(page_id as string), '.html') as file_path,
      md5(html) as html_md5
    from pages""",
)
def sink_page_store(spark, sf_dir):
    pages, _ = _page_docs(spark, sf_dir)
    path = work_dir(spark, "page_store")
    page_store.write_pages(pages, path)
    return page_store.read_pages(spark, path).select(
        "page_id", F.col("prefix").cast("string").alias("prefix"), "file_path", F.md5("html").alias("html_md5")
    )


@query(
    "src_pending",
    "select o_orderkey as pos from orders where o_orderstatus = 'P'",
)
def src_pending(spark, sf_dir):
    cache = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("pos"), (F.col("o_orderstatus") == "P").alias("pending")
    )
    return page_store.pending(cache).select("pos")


@query(
    "sink_cache_upsert",
    oracle(
        """select cache_key, pos, year, stamp from (
          select *, row_number() over (partition by cache_key order by stamp desc) as rn from (
            select md5(concat(url, cast(year as string), '{}')) as cache_key, pos, year,
                   cast(pos as double) as stamp from captures)) where rn = 1""",
        "captures",
    ),
)
def sink_cache_upsert(spark, sf_dir):
    rows = captures(spark, sf_dir).select(
        U.cache_key(F.concat("url", F.col("year").cast("string"))).alias("cache_key"),
        "pos",
        "year",
        F.col("pos").cast("double").alias("stamp"),
        "digest",
    )
    stored, new = rows.where("digest = 'P'").drop("digest"), rows.where("digest <> 'P'").drop("digest")
    store = _store(spark, "cache_key", stored)
    store.put(stored, 0, "stamp")
    store.put(new, 1, "stamp")
    return store.current()


@query(
    "sink_field_upsert",
    """select coalesce(o.o_orderkey, n.k) as id,
      case when n.k is not null then concat('new', cast(n.v as string)) else o.o_orderpriority end as rules,
      o.o_orderstatus as moderators
    from orders o full outer join (
      select l_orderkey * 2 as k, max(l_partkey * 1000 + l_suppkey) as v from lineitem group by 1) n
    on o.o_orderkey = n.k""",
)
def sink_field_upsert(spark, sf_dir):
    stored = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"),
        F.col("o_orderpriority").alias("rules"),
        F.col("o_orderstatus").alias("moderators"),
    )
    stamp = F.col("l_partkey") * 1000 + F.col("l_suppkey")
    new = table(spark, sf_dir, "lineitem").select(
        (F.col("l_orderkey") * 2).alias("id"),
        stamp.alias("stamp"),
        F.concat(F.lit("new"), stamp.cast("string")).alias("rules"),
    )
    store = _store(spark, "id", stored)
    store.put(stored, 0)
    store.set_field(new, "rules", 1, "stamp")
    return store.current()


@query(
    "sink_fail_append",
    oracle(
        """select url, count(*) as n_errors,
          cast(max(ts * 10 + error_code) as bigint) % 10 in (3, 4, 5) as fatal
        from errors group by url""",
        "errors",
    ),
)
def sink_fail_append(spark, sf_dir):
    events = errors(spark, sf_dir)
    log = fetchlog.append_errors(events.where("error_code < 3"), events.where("error_code >= 3"))
    return fetchlog.fail_state(log).select("url", "n_errors", "fatal")


@query(
    "sink_delete_by_id",
    """select o_orderkey as id, o_orderstatus as state from orders
    where o_orderkey not in (select l_orderkey from lineitem where l_returnflag = 'R')""",
)
def sink_delete_by_id(spark, sf_dir):
    stored = table(spark, sf_dir, "orders").select(
        F.col("o_orderkey").alias("id"), F.col("o_orderstatus").alias("state")
    )
    gone = table(spark, sf_dir, "lineitem").where("l_returnflag = 'R'").select(
        F.col("l_orderkey").alias("id")
    )
    store = _store(spark, "id", stored)
    store.put(stored, 0)
    store.delete(gone, 1)
    return store.current()
