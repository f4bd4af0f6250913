"""Registered queries: projections, predicates and scalar functions."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import urls as U
from tidemark.operators import captures as C
from tidemark.plans.inputs import captures, labelled, oracle
from tidemark.plans.registry import query, table

# Fixed value.
_TEMPLATE = "https://www.reddit.com/r/{}/about/moderators"


@query(
    "url_from_template",
    f"select c_custkey as id, replace('{_TEMPLATE}', '{{}}', c_name) as url from customer",
)
def url_from_template(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"),
        U.url_from_template(F.lit(_TEMPLATE), F.col("c_name")).alias("url"),
    )


@query("capture_url", oracle("select pos, capture_url from captures", "captures"))
def capture_url(spark, sf_dir):
    return captures(spark, sf_dir).select(
        "pos", U.capture_url(F.col("ts14"), F.col("url")).alias("capture_url")
    )


@query("capture_date_parts", oracle("select pos, year, month from captures", "captures"))
def capture_date_parts(spark, sf_dir):
    url = F.col("capture_url")
    return captures(spark, sf_dir).select(
        "pos", U.capture_year(url).alias("year"), U.capture_month(url).alias("month")
    )


@query(
    "half_year",
    oracle(
        "select pos, half, concat('S', cast(half as string)) as label from captures", "captures"
    ),
)
def half_year(spark, sf_dir):
    month = U.capture_month(F.col("capture_url"))
    return captures(spark, sf_dir).select(
        "pos", U.half_year(month).alias("half"), U.half_label(month).alias("label")
    )


@query(
    "year_filter",
    oracle("select pos, year from captures where year between 1997 and 1999", "captures"),
)
def year_filter(spark, sf_dir):
    return C.year_filter(captures(spark, sf_dir), 1997, 1999).select("pos", "year")


@query(
    "month_range_filter",
    oracle("select pos, month from captures where month between 7 and 12", "captures"),
)
def month_range_filter(spark, sf_dir):
    month = U.capture_month(F.col("capture_url"))
    return captures(spark, sf_dir).where(U.in_month_range(month, 7, 12)).select("pos", "month")


@query("original_url", oracle("select pos, url as original from captures", "captures"))
def original_url(spark, sf_dir):
    return captures(spark, sf_dir).select(
        "pos", U.original_url(F.col("capture_url")).alias("original")
    )


@query(
    "community_from_path",
    oracle(
        """select pos, 'capture' as kind, community from captures union all
        select page_id, 'page', 'unknown' from pages""",
        "captures",
    ),
)
def community_from_path(spark, sf_dir):
    shouted = F.replace(F.col("capture_url"), F.lit("/r/c"), F.lit("/R/C"))
    left = captures(spark, sf_dir).select(
        "pos", F.lit("capture").alias("kind"), U.community_from_path(shouted).alias("community")
    )
    right = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("pos"),
        F.lit("page").alias("kind"),
        U.community_from_path(F.col("url")).alias("community"),
    )
    return left.unionByName(right)


@query(
    "community_from_regex",
    oracle(
        """select pos, community from captures union all
        select page_id, nullif(regexp_extract(url, '/r/([^/]+)', 1), '') from pages""",
        "captures",
    ),
)
def community_from_regex(spark, sf_dir):
    left = captures(spark, sf_dir).select(
        "pos", U.community_from_text(F.col("capture_url")).alias("community")
    )
    right = table(spark, sf_dir, "pages").select(
        F.col("page_id").alias("pos"), U.community_from_text(F.col("url")).alias("community")
    )
    return left.unionByName(right)


@query(
    "sanitize_key",
    r"""select page_id, translate(url, '\/*?:"<>|&=', '___________') as name from pages""",
)
def sanitize_key(spark, sf_dir):
    return table(spark, sf_dir, "pages").select("page_id", U.sanitize_key(F.col("url")).alias("name"))


@query(
    "storage_prefix",
    """select c_custkey as id,
      case when c_custkey % 10 = 0 then 'unk' else substr(c_name, 1, 3) end as prefix from customer""",
)
def storage_prefix(spark, sf_dir):
    name = F.when(F.col("c_custkey") % 10 == 0, F.lit("")).otherwise(F.col("c_name"))
    return table(spark, sf_dir, "customer").select(
        F.col("c_custkey").alias("id"), U.storage_prefix(name).alias("prefix")
    )


@query(
    "cache_key",
    oracle(
        """select pos, md5(concat(capture_url, '{}')) as plain,
          md5(concat(url, '{"collapse": "digest", "url": "', community, '"}')) as keyed
        from captures""",
        "captures",
    ),
)
def cache_key(spark, sf_dir):
    params = F.create_map(
        F.lit("url"), F.col("community"), F.lit("collapse"), F.lit("digest")
    )
    return captures(spark, sf_dir).select(
        "pos",
        U.cache_key(F.col("capture_url")).alias("plain"),
        U.cache_key(F.col("url"), params).alias("keyed"),
    )


# URL forms of each page type.
_ROUTES = (
    "case o_orderkey % 8 when 0 then 'https://www.reddit.com/r/{}/about/moderators' "
    "when 1 then 'http://old.reddit.com/r/{}/about/moderators/' when 2 then 'https://reddit.com/r/{}/wiki/index' "
    "when 3 then 'https://old.reddit.com/r/{}/wiki/index' when 4 then 'https://www.reddit.com/r/{}/' "
    "when 5 then 'http://reddit.com/r/{}' when 6 then 'https://old.reddit.com/r/{}' "
    "else 'https://www.reddit.com/r/{}?sort=new' end"
)


@query(
    "page_type",
    """select o_orderkey as pos, case o_orderkey % 8 when 0 then 'moderators' when 1 then 'moderators'
      when 2 then 'wiki' when 4 then 'homepage' when 5 then 'homepage' when 6 then 'homepage_old'
      else null end as page_type from orders""",
)
def page_type(spark, sf_dir):
    name = F.concat(F.lit("c"), F.col("o_custkey").cast("string"))
    return (
        table(spark, sf_dir, "orders")
        .select(
            F.col("o_orderkey").alias("pos"),
            U.url_from_template(F.expr(_ROUTES), name).alias("url"),
        )
        .select("pos", U.page_type(F.col("url")).alias("page_type"))
    )


@query(
    "redirect_ok",
    oracle(
        """select pos, capture_url = final_url or (
          (case when month <= 6 then 1 else 2 end) =
          (case when cast(substr(split_part(final_url, '/', 5), 5, 2) as int) <= 6 then 1 else 2 end)
          and year = cast(substr(split_part(final_url, '/', 5), 1, 4) as int)) as ok
        from captures""",
        "captures",
    ),
)
def redirect_ok(spark, sf_dir):
    return captures(spark, sf_dir).select(
        "pos", U.redirect_ok(F.col("capture_url"), F.col("final_url")).alias("ok")
    )


@query(
    "error_class",
    oracle(
        """select pos, case when error_code = 0 then 'success' when error_code = 7 then 'cached'
          when error_code in (3, 4, 5) then 'fatal' else 'retryable' end as class,
          case error_code when 0 then 'success' when 1 then 'timeout' when 2 then 'connection'
            when 3 then 'http' when 4 then 'ssl' when 5 then 'generic'
            when 6 then 'retries_exhausted' when 7 then 'cached' end as name
        from captures""",
        "captures",
    ),
)
def error_class(spark, sf_dir):
    code = F.col("error_code")
    return captures(spark, sf_dir).select(
        "pos",
        F.when(code == 0, "success").otherwise(U.error_class(code)).alias("class"),
        U.error_name(code).alias("name"),
    )


@query(
    "clean_text",
    """select doc_id, md5(trim(regexp_replace(regexp_replace(lower(text), 'http\\S+', '', 'g'),
      '[^a-z0-9\\s]', '', 'g'), chr(32) || chr(9) || chr(10) || chr(13) || chr(160))) as cleaned,
      length(text) as chars from (select doc_id, concat(' See HTTPS://x.example/a?b=', cast(doc_id as string), ' ', text)
      as text from documents)""".replace("\\\\", "\\"),
)
def clean_text(spark, sf_dir):
    text = F.concat(
        F.lit(" See HTTPS://x.example/a?b="), F.col("doc_id").cast("string"), F.lit(" "), F.col("text")
    )
    return table(spark, sf_dir, "documents").select(
        "doc_id",
        F.md5(X.clean_text(text)).alias("cleaned"),
        F.length(text).cast("bigint").alias("chars"),
    )


@query(
    "label_encode",
    """select doc_id, case when doc_id % 10 = 0 then null else quality end as label from labels""",
)
def label_encode(spark, sf_dir):
    name = (
        F.when(F.col("doc_id") % 10 == 0, F.lit("other"))
        .when(F.col("quality") == 1, F.lit(" rule "))
        .otherwise(F.lit("non-rule"))
    )
    return table(spark, sf_dir, "labels").select("doc_id", X.label_encode(name).alias("label"))


@query(
    "parse_karma",
    """select event_id, case when event_id % 4 = 0 then user_id end as digits,
      case event_id % 4 when 0 then user_id when 1 then -user_id when 2 then user_id end as lenient
    from events""",
)
def parse_karma(spark, sf_dir):
    user = F.col("user_id").cast("string")
    text = F.expr(
        "case event_id % 4 when 0 then concat(' ', user_id, ' ') when 1 then concat('-', user_id) "
        "when 2 then concat(' +', user_id, ' ') else concat(user_id, '.5') end"
    )
    return table(spark, sf_dir, "events").select(
        "event_id", X.digits_or_null(text).alias("digits"), X.int_or_null(text).alias("lenient")
    )


@query(
    "rule_text",
    """select p_partkey as id, p_name as title_only,
      case when p_partkey % 3 = 0 then p_name else concat(p_name, ' ', p_type) end as spaced,
      case when p_partkey % 3 = 0 then p_name else concat(p_name, ' - ', p_type) end as dashed
    from part""",
)
def rule_text(spark, sf_dir):
    description = F.when(F.col("p_partkey") % 3 == 0, F.lit("")).otherwise(F.col("p_type"))
    title = F.col("p_name")
    return table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        X.rule_text(title).alias("title_only"),
        X.rule_text(title, description).alias("spaced"),
        X.dashed(title, description).alias("dashed"),
    )
