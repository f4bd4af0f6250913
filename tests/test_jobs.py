"""Streams: same state as the batch for any split of the input; a restart adds nothing."""

import pytest
from pyspark.sql import functions as F

from tidemark.operators import extract as E
from tidemark.operators import fetchlog as L
from tidemark.operators import metrics, model
from tidemark.sources.tables import VersionedTable
from tidemark.streaming import jobs


def score(candidates):
    return candidates.withColumn("score", F.lit(1.0))


@pytest.fixture(scope="module")
def pages(spark):
    name = F.col("id").cast("string")
    return spark.range(60).select(
        F.col("id").alias("page_id"),
        F.concat(
            F.lit("https://www.reddit.com/r/c"),
            name,
            F.when(F.col("id") % 2 == 0, "/about/moderators").otherwise("/wiki/index"),
        ).alias("original"),
        F.when(
            F.col("id") % 2 == 0,
            F.concat(F.lit('<div class="md">m'), name, F.lit(" (7)</div>")),
        )
        .otherwise(
            F.concat(
                F.lit('<div class="md"><h2>Rules</h2><ul><li><strong>R'), name, F.lit("</strong></li></ul></div>")
            )
        )
        .alias("html"),
        F.lit(1.0).alias("stamp"),
    )


def state(tables):
    rules = sorted((r.page_id, [tuple(x) for x in r.rules]) for r in tables.rules.current().collect())
    mods = sorted(
        (r.page_id, [tuple(x) for x in r.moderators]) for r in tables.moderators.current().collect()
    )
    return rules, mods


@pytest.mark.parametrize("files, per_batch", [(1, None), (3, 2)])
def test_parse_stream(spark, pages, tmp_path, files, per_batch):
    landing, root = str(tmp_path / "landing"), str(tmp_path / "out")
    pages.repartition(files).write.parquet(landing)
    tables = jobs.PageTables(spark, root)

    def run():
        stream = jobs.read_landing(spark, landing, jobs.PAGE_SCHEMA, per_batch)
        jobs.finish(jobs.parse_pending(stream, tables, f"{root}/checkpoint", score, interval=None))

    run()
    rules, mods, _ = E.extract(pages, "page_id", score)
    want = (
        sorted((r.page_id, [tuple(x) for x in r.rules]) for r in rules.collect()),
        sorted((r.page_id, [tuple(x) for x in r.moderators]) for r in mods.collect()),
    )
    assert state(tables) == want
    before = tables.rules.log().count()
    run()  # restart from the checkpoint: nothing new
    assert tables.rules.log().count() == before
    # a page that is stored again is parsed again
    pages.where("page_id = 0").withColumn("html", F.lit('<div class="md">new (1)</div>')).withColumn(
        "stamp", F.lit(2.0)
    ).write.mode("append").parquet(landing)
    run()
    changed = dict(state(tables)[1])
    assert changed[0] == [("new", 1, None, None)] and changed[2] == [("m2", 7, None, None)]


def test_first_batch_without_known_pages(spark, pages, tmp_path):
    landing, root = str(tmp_path / "landing"), str(tmp_path / "out")
    other = pages.withColumn("original", F.lit("https://www.reddit.com/r/a/new"))
    other.coalesce(1).write.parquet(landing)
    tables = jobs.PageTables(spark, root)
    for _ in range(2):
        stream = jobs.read_landing(spark, landing, jobs.PAGE_SCHEMA)
        jobs.finish(jobs.parse_pending(stream, tables, f"{root}/checkpoint", score, interval=None))
        pages.where("page_id < 2").write.mode("append").parquet(landing)
    rules, mods = state(tables)
    assert [k for k, _ in rules] == [1] and [k for k, _ in mods] == [0]


def test_error_stream(spark, tmp_path):
    events = spark.range(300).select(
        F.concat(F.lit("u"), (F.col("id") % 9).cast("string")).alias("url"),
        (F.col("id") % 7).cast("int").alias("error_code"),
        F.col("id").cast("double").alias("ts"),
    )
    landing = str(tmp_path / "landing")
    events.repartition(3).write.parquet(landing)
    table = VersionedTable(spark, str(tmp_path / "state"), ["url"], "n_errors")
    stream = jobs.read_landing(spark, landing, jobs.ERROR_SCHEMA, 1)
    jobs.finish(jobs.track_errors(stream, table, str(tmp_path / "checkpoint"), interval=None))
    columns = ["url", "fatal", "last_code", "last_ts", "n_errors"]
    got = sorted(tuple(r) for r in table.current().select(columns).collect())
    assert got == sorted(tuple(r) for r in L.fail_state(events).select(columns).collect())


def test_model(spark, tmp_path):
    n = F.col("id")
    rows = spark.range(200).select(
        F.when(n % 2 == 0, F.concat(F.lit("Do not post spam number "), n.cast("string")))
        .otherwise(F.concat(F.lit("Welcome to our friendly place "), n.cast("string")))
        .alias("text"),
        (1 - n % 2).cast("int").alias("label"),
    )
    fitted = model.fit(rows, max_features=50, rounds=3)
    path = str(tmp_path / "model")
    model.save(fitted, path)
    scored = model.score(model.load(path), rows)
    report = {r["class"]: r for r in metrics.class_report(scored).collect()}
    assert report["accuracy"].f1 == 1.0
    candidates = spark.createDataFrame(
        [(1, "Do not post spam number"), (2, "Welcome to our friendly place")], "page_id long, score_text string"
    )
    kept = E.filter_by_threshold(model.scorer(fitted)(candidates), 0.5)
    assert {r.page_id: r.kept for r in kept.collect()} == {1: True, 2: False}


def test_pr_curve_by_hand(spark):
    scored = spark.createDataFrame(
        [(0.9, 1), (0.8, 0), (0.8, 1), (0.3, 0)], "score double, label int"
    )
    curve = {r.threshold: (r.precision, r.recall) for r in metrics.pr_curve(scored).collect()}
    assert curve == {0.9: (1.0, 0.5), 0.8: (2 / 3, 1.0), 0.3: (0.5, 1.0)}
    best = metrics.best_threshold(metrics.pr_curve(scored)).first()
    assert best.threshold == 0.8 and abs(best.f1 - 0.8) < 1e-12


def test_cascade(spark):
    """Each page's first case with a kept text, and no case after it is scored."""
    cases = [
        (1, "homepage", [(1, ["keep a", "no"]), (4, ["keep b"]), (9, ["keep c"])]),
        (2, "homepage", [(2, ["no", "no"]), (5, ["no"]), (11, ["keep d", "keep e"])]),
        (3, "homepage", [(3, ["no"])]),
        (4, "wiki", [(1, ["keep f", "no", "keep F"])]),
        (5, "homepage", []),
        (6, "wiki", None),
    ]
    rows = [
        (k, kind, c if c is None else [(n, [(t, None) for t in texts]) for n, texts in c]) for k, kind, c in cases
    ]
    layouts = spark.createDataFrame(rows, f"page_id long, page_type string, candidates {E.CANDIDATES}")
    asked = []

    def score_keep(candidates):
        asked.append(sorted(r.score_text for r in candidates.collect()))
        return candidates.withColumn("score", F.contains("score_text", F.lit("keep")).cast("double"))

    got = E.first_kept(layouts, "page_id", score_keep, 0.5)
    every = E.filter_by_threshold(score_keep(E.rule_candidates(layouts, "page_id")), 0.5).where("kept")
    want = E.first_layout(every, "page_id", E.AFTER_SCORE)
    columns = ["page_id", "page_type", "case_no", "pos", "title", "description"]
    as_rows = lambda df: sorted(map(tuple, df.select(columns).collect()), key=str)
    assert as_rows(got) == as_rows(want) and len(as_rows(got)) == 5
    *rounds, whole = asked
    assert [len(r) for r in rounds] == [8, 1, 2] and len(whole) == 13
    assert as_rows(E.first_kept(layouts.limit(0), "page_id", score_keep, 0.5)) == []


def test_error_lists(spark, tmp_path):
    """The lists grow over batches and a restart, and equal those of the batch operator."""
    n = F.col("id")
    events = spark.range(400).select(
        F.when(n % 2 == 0, F.lit("hot")).otherwise(F.concat(F.lit("u"), (n % 9).cast("string"))).alias("url"),
        F.when(n % 11 != 0, (n % 7).cast("int")).alias("error_code"),
        F.floor(n / 3).cast("double").alias("ts"),
    )
    landing, checkpoint = str(tmp_path / "landing"), str(tmp_path / "checkpoint")
    log = VersionedTable(spark, str(tmp_path / "log"), ["url", "seq"], "ts")
    for low, high in ((0, 40), (40, 41), (41, 200)):
        events.where((F.col("ts") >= low) & (F.col("ts") < high)).coalesce(2).write.mode("append").parquet(landing)
        stream = jobs.read_landing(spark, landing, jobs.ERROR_SCHEMA)
        jobs.finish(jobs.list_errors(stream, log, checkpoint, chunk=16, interval=None))
    as_rows = lambda df: sorted((r.url, r.chunk, [tuple(e) for e in r.errors]) for r in df.collect())
    got = as_rows(jobs.error_lists(log.log()))
    assert got == as_rows(L.error_history(events, chunk=16).select("url", "chunk", "errors"))
    assert max(len(e) for _, _, e in got) == 16
    # A batch that is run again replaces its rows.
    last = log.log().where("batch = 2").drop("batch")
    log.add(spark.createDataFrame(last.collect(), last.schema), 2)
    assert as_rows(jobs.error_lists(log.log())) == got


def test_error_numbers_go_on_natively(spark, tmp_path, monkeypatch):
    """No URL's rows go to Python; numbers go on over compactions, of a null URL too, and a batch run again."""
    monkeypatch.setattr(jobs, "_COMPACT_EVERY", 2)
    landing, checkpoint = str(tmp_path / "landing"), str(tmp_path / "checkpoint")
    log = VersionedTable(spark, str(tmp_path / "log"), ["url", "seq"], "ts")
    url = F.when(F.col("id") % 3 > 0, F.concat(F.lit("u"), (F.col("id") % 3).cast("string")))
    events = spark.range(60).select(url.alias("url"), F.lit(1).alias("error_code"), F.col("id").cast("double").alias("ts"))
    for part in range(5):
        events.where(F.floor(F.col("ts") / 12) == part).coalesce(1).write.mode("append").parquet(landing)
        query = jobs.list_errors(jobs.read_landing(spark, landing, jobs.ERROR_SCHEMA), log, checkpoint, interval=None)
        jobs.finish(query)
        assert "InPandas" not in query._jsq.explainInternal(True)
    want = [(u, k // 3 + 1, float(k)) for k in range(60) for u in [f"u{k % 3}" if k % 3 else None]]
    as_rows = lambda df: sorted(map(tuple, df.select("url", "seq", "ts").collect()), key=lambda r: r[2])
    assert as_rows(log.log()) == want
    last = events.where("ts >= 48")
    again = jobs._number_batch(last, 4, f"{checkpoint}-seen", 1024)
    assert as_rows(again) == [r for r in want if r[2] >= 48]


def test_tasks_are_not_joined_beyond_16_mb(spark):
    """Small rows take many times their shuffled size in a task's hash table."""
    from tidemark.session import configure

    configure(spark)
    assert spark.conf.get("spark.sql.adaptive.advisoryPartitionSizeInBytes") == "16m"
