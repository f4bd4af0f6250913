"""Range buckets give what a plain window gives, whichever key holds the rows."""

import re

import pytest
from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.operators import captures as C
from tidemark.operators import fetchlog as L
from tidemark.operators.ordered import BUCKET, previous_value, running_sum, spread


@pytest.fixture(scope="module")
def rows(spark):
    """A third of all rows belongs to one URL, many of them to one second; some keys are null."""
    n = F.col("id")
    return spark.range(6000).select(
        F.when(n % 3 == 0, F.lit("hot")).when(n % 50 == 1, F.lit(None)).otherwise(
            F.concat(F.lit("u"), (n % 97).cast("string"))
        ).alias("url"),
        F.when(n % 2 == 0, F.lit("20150101000000"))
        .otherwise(F.concat(F.lit("2015"), F.lpad((n % 12 + 1).cast("string"), 2, "0"), F.lit("01000000")))
        .alias("ts14"),
        F.pmod(n * 7919, F.lit(6000)).alias("pos"),
        F.when(n % 11 != 0, F.concat(F.lit("d"), (F.floor(n / 7) % 3).cast("string"))).alias("digest"),
        (n % 8).cast("int").alias("error_code"),
        F.lit(2015).alias("year"),
        F.lit(1).alias("half"),
    )


def as_set(df):
    return sorted(map(tuple, df.collect()), key=str)


ORDER = ["ts14", "pos"]


def plain_previous(rows, key, value):
    w = Window.partitionBy(key).orderBy(*ORDER)
    return rows.withColumn("prev", F.lag(F.struct(F.col(value).alias("v"))).over(w))


def plain_sums(rows, keys, values):
    w = Window.partitionBy(*keys).orderBy(*ORDER).rowsBetween(Window.unboundedPreceding, 0)
    return rows.select("*", *[F.sum(F.coalesce(v, F.lit(0))).over(w).alias(n) for n, v in values.items()])


@pytest.fixture(params=["many keys", "one key", "one row", "no row"])
def some(request, rows):
    if request.param == "one key":
        return rows.withColumn("url", F.lit("only"))
    return {"many keys": rows, "one row": rows.limit(1), "no row": rows.where("pos < 0")}[request.param]


def test_previous_value(some):
    assert as_set(previous_value(some, ["url"], ORDER, "digest", "prev")) == as_set(plain_previous(some, "url", "digest"))


def test_running_sum(some):
    values = {"run": F.col("error_code").cast("bigint"), "k": F.lit(1).cast("bigint")}
    assert as_set(running_sum(some, ["url"], ORDER, values)) == as_set(plain_sums(some, ["url"], values))


def test_running_sum_on_a_spread(some):
    """A step after another one, with longer keys, on the same buckets."""
    longer = some.withColumn("kind", F.substring("ts14", 5, 2))
    values = {"run": F.col("error_code").cast("bigint")}
    got = running_sum(spread(longer, ["url"], ORDER), ["url", "kind"], ORDER, values)
    assert as_set(got.drop(BUCKET)) == as_set(plain_sums(longer, ["url", "kind"], values))


def test_whole_table_running_sum(spark):
    df = running_sum(spark.range(1000), [], ["id"], {"s": F.col("id")})
    assert all(r.s == r.id * (r.id + 1) // 2 for r in df.collect())


def test_a_key_is_spread_over_all_buckets(spark, rows):
    one = spread(rows.withColumn("url", F.lit("only")), ["url"], ORDER)
    sizes = {r[BUCKET]: r["count"] for r in one.groupBy(BUCKET).count().collect()}
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    assert len(sizes) == n and max(sizes.values()) < 2 * 6000 / n


def exchanges(df):
    """The exchanges of rows that were run, without those that are read again; and the plan."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    return set(re.findall(r"ShuffleQueryStage \d+\n[ :+-]*(Exchange shufflepartition.*plan_id=\d+)", plan)), plan


def test_one_exchange(spark, tmp_path, rows):
    rows.write.parquet(str(tmp_path / "captures"))
    stored = spark.read.parquet(str(tmp_path / "captures"))
    found, plan = exchanges(C.collapse_digest(stored))
    assert len(found) == 1 and "hashpartitioning(url" not in plan
    ok = F.col("pos") % 2 == 0
    found, plan = exchanges(C.resolve_slots(C.collapse_digest(stored, keep=True), ok))
    assert len(found) == 1
    found, plan = exchanges(L.number_errors(stored.withColumnRenamed("ts14", "ts")))
    assert len(found) == 1


def test_collapse_and_resolve(some):
    ok = F.col("pos") % 2 == 0
    marked = plain_previous(some, "url", "digest")
    kept = marked.where(F.col("prev").isNull() | ~F.col("prev.v").eqNullSafe(F.col("digest"))).drop("prev")
    assert as_set(C.collapse_digest(some)) == as_set(kept)
    apart = C.resolve_slots(kept, ok)
    assert as_set(apart) == as_set(C.resolve_slots(C.collapse_digest(some, keep=True), ok))
    code = F.col("error_code")
    rej = F.coalesce(code.isin(3, 4, 5) | ((code == 0) & ~ok), F.lit(False))
    nth = F.row_number().over(Window.partitionBy(*C.SLOT).orderBy(*ORDER))
    want = kept.withColumn("n", nth).groupBy(*C.SLOT).agg(
        F.coalesce(F.min(F.when(~rej, F.col("n"))), F.count("*")).alias("attempts")
    )
    assert as_set(apart.select(*C.SLOT, "attempts")) == as_set(want)


def test_resolve_by_hand(spark):
    data = [
        ("u", "20150101000000", 1, 3),
        ("u", "20150201000000", 2, 0),
        ("u", "20150301000000", 3, 7),
        ("v", "20150101000000", 1, 4),
        ("v", "20150102000000", 2, 5),
        ("w", "20150901000000", 1, 2),
    ]
    df = C.with_slot(spark.createDataFrame(data, "url string, ts14 string, pos int, error_code int"))
    out = {
        r.url: (r.half, r.state, r.pos, r.attempts)
        for r in C.resolve_slots(df, F.col("pos") != 2).collect()
    }
    # u: fatal, then a bad redirect, then a cached hit; v: only fatal; w: retryable
    assert out == {
        "u": (1, "filled", 3, 3),
        "v": (1, "exhausted", None, 2),
        "w": (2, "deferred", 1, 1),
    }


def test_error_history_chunks(spark):
    events = spark.range(25).select(
        F.when(F.col("id") < 20, "a").otherwise("b").alias("url"),
        (F.col("id") % 7).cast("int").alias("error_code"),
        F.col("id").cast("double").alias("ts"),
    )
    chunks = L.error_history(events, chunk=8).collect()
    assert sorted((r.url, r.chunk, len(r.errors)) for r in chunks) == [
        ("a", 0, 8),
        ("a", 1, 8),
        ("a", 2, 4),
        ("b", 0, 5),
    ]
    seqs = [e.seq for r in sorted(chunks, key=lambda r: (r.url, r.chunk)) if r.url == "a" for e in r.errors]
    assert seqs == list(range(1, 21))


def test_fetch_outcome_rules(spark):
    def log(url, *steps):
        return [(url, k + 1, s if isinstance(s, int) else None, s if isinstance(s, str) else None) for k, s in enumerate(steps)]

    rows = (
        log("https://ok", 200)
        + log("https://later", 503, "timeout", 200)
        + log("https://gone", 404)
        + log("https://forbid", 403, 200)
        + log("https://forbid2", 403, 403)
        + log("http://forbid", 403)
        + log("https://busy", 429, 429, 429, 200)
        + log("https://ssl", "ssl")
        + log("https://net", 500, "connection")
        + log("https://other", "other")
        + log("https://moved", 304)
    )
    df = spark.createDataFrame(rows, "url string, attempt int, status int, error string")
    out = {r.url: (r.error_code, r.attempts) for r in L.fetch_outcome(df).collect()}
    assert out == {
        "https://ok": (0, 1),
        "https://later": (0, 3),
        "https://gone": (3, 1),
        "https://forbid": (0, 2),
        "https://forbid2": (3, 2),
        "http://forbid": (3, 1),
        "https://busy": (6, 3),
        "https://ssl": (4, 1),
        "https://net": (2, 2),
        "https://other": (5, 1),
        "https://moved": (0, 1),
    }
