import os
import re

import pytest
from pyspark.sql import functions as F

from tidemark.functions import text as X
from tidemark.functions import urls as U
from tidemark.plans import q_sources
from tidemark.sources import capture_index, files, page_store, tsv
from tidemark.sources.tables import KeyedTable, VersionedTable


def test_tsv(spark, tmp_path):
    path = tmp_path / "seeds.tsv"
    path.write_text('name\tx\n funny \t1\n\n"a\tb"\t2\nfunny\t3\n')
    assert sorted(r.name for r in tsv.read_seeds(spark, str(path)).collect()) == ["a\tb", "funny", "funny"]
    path = tmp_path / "labelled.tsv"
    path.write_text('text\tlabel\nBe kind\t rule \n\tnon-rule\nNA\trule\n"two\nlines ""q"""\trule\n')
    rows = [tuple(r) for r in tsv.read_labelled(spark, str(path)).collect()]
    assert rows == [("Be kind", "rule"), ("", "non-rule"), ("", "rule"), ('two\nlines "q"', "rule")]


def test_capture_index_files(spark, tmp_path):
    good = '[["urlkey","timestamp","original"],["k","20130115000000","http://x/r/a"],["k","20130701000000","http://x/r/b","t","200","D","7"]]'
    urls = {"http://x/r/good+1": good, "http://x/r/bad": "<html>", "short": '[["urlkey"],["k","20130115000000"]]', "é mpty": "[]"}
    for url, body in urls.items():
        name = url.replace("/", "_").replace(":", "_")
        (tmp_path / f"{name}.json").write_text(body)
    (tmp_path / "of no seed.json").write_text(good)
    seeds = spark.createDataFrame([(u,) for u in urls], "seed_url string")
    responses = capture_index.read_index_files(spark, str(tmp_path), seeds)
    assert {r.seed_url: r.body for r in responses.collect()} == urls
    rows = capture_index.parse_index(responses).orderBy("pos").collect()
    assert [(r.pos, r.ts14, r.original, r.length) for r in rows] == [
        (0, "20130115000000", "http://x/r/a", None),
        (1, "20130701000000", "http://x/r/b", 7),
    ]
    rejected = capture_index.rejected_responses(responses).collect()
    assert sorted(r.seed_url for r in rejected) == ["http://x/r/bad", "short"]


def test_index_files_spread_over_folders(spark, tmp_path):
    """No folder gets a name per seed; each seed still has a file of its own."""
    seeds = spark.range(300).select(F.concat(F.lit("http://x/r/"), "id").alias("seed_url"), F.col("id").cast("string").alias("body"))
    there = seeds.where("body <> '7'").withColumn("file", capture_index.index_file(F.col("seed_url"), spread=True))
    assert files.write_listed(there, "file", "body", str(tmp_path)) == 299
    assert len(list(tmp_path.iterdir())) > 200 and (tmp_path / there.first().file).is_file()
    got = capture_index.responses_from_files(seeds, str(tmp_path), spread=True).collect()
    want = {f"http://x/r/{i}": (str(i), "ok") if i != 7 else (None, "missing_file") for i in range(300)}
    assert {r.seed_url: (r.body, r.status) for r in got} == want


def test_page_files(spark, tmp_path):
    (tmp_path / "fun").mkdir()
    (tmp_path / "fun" / "a.html").write_text("<p>a\nb</p>")
    row = page_store.read_page_files(spark, str(tmp_path)).first()
    assert row.file_path == "fun/a.html" and row.html == "<p>a\nb</p>"


def test_page_files_meet_their_documents(spark, tmp_path):
    url = "https://web.archive.org/web/20200101000000/https://www.reddit.com/r/funny+x y/?a=1"
    docs = spark.createDataFrame(
        [(1, "https://www.reddit.com/r/funny", url), (2, "https://www.reddit.com/r/a", None)], "id int, original string, url string"
    ).withColumn("file_path", U.file_path(F.col("url")))
    path = tmp_path / docs.first().file_path
    path.parent.mkdir()
    path.write_text("<p>x</p>")
    found = page_store.pages_for_docs(docs, page_store.read_page_files(spark, str(tmp_path)))
    assert sorted((r.id, r.status, r.html) for r in found.collect()) == [(1, "ok", "<p>x</p>"), (2, "no_path", None)]


def test_listed_files(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(files, "_BATCH_BYTES", 40)
    bodies = {f"d{i % 3}/n {i}.html": f"<p>{'é' * i}</p>" for i in range(30)}
    rows = spark.createDataFrame([*bodies.items(), (None, "x"), ("../out.html", "x"), ("d0/null", None)], "p string, t string")
    root = str(tmp_path / "root")
    assert files.write_listed(rows.repartition(3), "p", "t", root) == 30
    assert files.write_listed(rows.where("p like 'd1/%'"), "p", "t", f"file://{root}") == 10  # again
    assert not (tmp_path / "out.html").exists() and not [f for f in (tmp_path / "root").rglob("_*")]
    (tmp_path / "root" / "bad").write_bytes(b"\xff\xfe")
    (tmp_path / "secret").write_text("not below the root")
    asked = [(p, 7) for p in list(bodies)[:20]] + [("d1", 1), ("none", 2), (None, 3), ("", 4), ("../secret", 5), ("bad", 6), ("/etc/hosts", 8)]
    for at in (root, f"file://{root}"):
        got = files.read_listed(spark.createDataFrame(asked, "p string, status int"), "p", at, "p2", "state").collect()
        assert {(r.p, r.status): (r.p2, r.state) for r in got} == {
            **{(p, 7): (bodies[p], "ok") for p in list(bodies)[:20]},
            ("d1", 1): (None, "missing_file"), ("none", 2): (None, "missing_file"), (None, 3): (None, "no_path"),
            ("", 4): (None, "no_path"), ("../secret", 5): (None, "missing_file"), ("bad", 6): (None, "unreadable"),
            ("/etc/hosts", 8): (None, "missing_file"),
        }
    only = files.read_listed(spark.createDataFrame([("d0/n 0.html",)], "p string"), "p", root)
    assert "Exchange" not in only._jdf.queryExecution().executedPlan().toString()
    assert files.write_listed(rows.limit(0), "p", "t", root) == 0


def test_keyed_table(spark, tmp_path):
    fields = spark.createDataFrame([], "a int, b string").schema.fields
    table = KeyedTable(spark, str(tmp_path / "k"), "k", fields)
    table.put(spark.createDataFrame([("x", 1, "p"), ("y", 2, "q"), ("z", 3, None)], "k string, a int, b string"), 0)
    table.set_field(spark.createDataFrame([("x", 9), ("new", 8)], "k string, a int"), "a", 1)
    table.delete(spark.createDataFrame([("y",), ("none",)], "k string"), 2)
    table.put(spark.createDataFrame([("z", None, "r")], "k string, a int, b string"), 3)
    table.put(spark.createDataFrame([("z", None, "r")], "k string, a int, b string"), 3)
    want = [("new", 8, None), ("x", 9, "p"), ("z", None, "r")]
    assert sorted(tuple(r) for r in table.current().collect()) == want
    table.set_field(spark.createDataFrame([("y", "back")], "k string, b string"), "b", 4)
    assert sorted(tuple(r) for r in table.current().collect()) == sorted([*want, ("y", None, "back")])
    again = KeyedTable(spark, str(tmp_path / "k"), "k", fields, buckets=99)  # the stored number counts
    assert again.buckets == table.buckets and as_rows(again.current()) == as_rows(table.current())


def as_rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def keyed(spark, path, buckets=4):
    fields = spark.createDataFrame([], "a int, b string").schema.fields
    table = KeyedTable(spark, str(path), "k", fields, buckets)
    n = F.col("id")
    table.put(spark.range(1000).select(n.alias("k"), n.cast("int").alias("a"), F.lit("b").alias("b")), 0)
    small = spark.range(5, 25)
    table.set_field(small.select(n.alias("k"), F.lit(-1).alias("a"), (n * 1.5).alias("s")), "a", 1, "s")
    table.set_field(small.select(n.alias("k"), F.lit("late").alias("b"), F.lit(0.5).alias("s")), "b", 2, "s")
    table.delete(spark.range(10, 15).select(n.alias("k"), F.lit(30.0).alias("s")), 3, "s")
    return table


def plan_of(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString()


def test_keyed_reads_exchange_nothing_stored(spark, tmp_path):
    table = keyed(spark, tmp_path / "k")
    assert "Exchange" not in plan_of(table.current())
    asked = spark.range(0, 2000, 7).select(F.col("id").alias("k"), F.lit("x").alias("page"))
    plan = plan_of(asked.hint("merge").join(table.current().select("k"), "k", "left_anti"))
    assert set(re.findall(r"Exchange hashpartitioning\([^,]*, (\d+)\)", plan)) == {"4"}
    scans = [x for x in plan.split("Initial Plan")[0].splitlines() if "FileScan" in x]
    assert len(scans) == 1 and "Bucketed: true" in scans[0]


@pytest.mark.parametrize("buckets", [None, [1], [0, 3]])
def test_compact(spark, tmp_path, buckets):
    table = keyed(spark, tmp_path / "k")
    want, before = as_rows(table.current()), {b: table.files([b]) for b in range(4)}
    table.compact(buckets)
    assert as_rows(table.current()) == want and "Exchange" not in plan_of(table.current())
    for b in range(4):
        if buckets is None or b in buckets:
            assert len(table.files([b])) == 1 and not set(table.files([b])) & set(before[b])
        else:
            assert table.files([b]) == before[b]
    # Late changes find their place: older ones change nothing, newer ones do.
    late = spark.createDataFrame([(11, 77, 11.0), (12, 78, 31.0), (6, 79, 1.0), (7, 80, 99.0)], "k long, a int, s double")
    table.set_field(late, "a", 4, "s")
    got = {r.k: (r.a, r.b) for r in table.current().where("k < 15").collect()}
    assert 11 not in got and got[12] == (78, None) and got[6] == (-1, "late") and got[7] == (80, "late")
    assert KeyedTable(spark, str(tmp_path / "k"), "k", table.fields).current().count() == table.current().count()
    table.compact()
    assert {r.k: (r.a, r.b) for r in table.current().where("k < 15").collect()} == got


def test_versioned_table(spark, tmp_path):
    table = VersionedTable(spark, str(tmp_path / "t"), ["k"], "v")
    assert table.current() is None
    one = spark.createDataFrame([("a", 1, "x"), ("b", 5, "y")], "k string, v int, d string")
    two = spark.createDataFrame([("a", 2, "z"), ("b", 3, "old")], "k string, v int, d string")
    table.add(one, 0)
    table.add(two, 1)
    table.add(two, 1)  # the same batch again
    want = [("a", 2, "z"), ("b", 5, "y")]
    assert sorted(tuple(r) for r in table.current().collect()) == want
    assert table.log().count() == 4
    compacted = table.compact(str(tmp_path / "c"))
    assert sorted(tuple(r) for r in compacted.current().collect()) == want


def values(spark, cases, expr):
    rows = spark.createDataFrame([(i, c) for i, c in enumerate(cases)], "i int, v string")
    return [r[0] for r in rows.orderBy("i").select(expr(F.col("v"))).collect()]


def test_url_expressions(spark):
    urls = [
        "https://web.archive.org/web/20230701000000/https://www.reddit.com/r/Python/about",
        "https://x.org/a/r",
        "https://x.org/R/Foo;p?q#f",
        "/r//x",
        "https://x.org/rr/r/Zed/r/two",
        "",
    ]
    assert values(spark, urls, U.community_from_path) == ["python", "unknown", "foo", "", "zed", "unknown"]
    assert values(spark, urls, U.community_from_text) == ["Python", None, None, None, "Zed", None]
    assert values(spark, urls[:2], U.original_url) == ["https://www.reddit.com/r/Python/about", None]
    months = ["https://w/web/202301/x", "https://w/web/2023ab/x", "https://w", "https://w/web/202313/x"]
    assert values(spark, months, U.capture_month) == [1, None, None, 13]
    assert values(spark, months, lambda u: U.half_year(U.capture_month(u))) == [1, None, None, 2]
    routes = [
        "https://old.reddit.com/r/a.b/about/moderators/",
        "http://reddit.com/r/a",
        "https://old.reddit.com/r/a",
        "https://old.reddit.com/r/a/wiki/index",
        "https://www.reddit.com:80/r/a",
    ]
    assert values(spark, routes, U.page_type) == ["moderators", "homepage", "homepage_old", None, None]


def test_text_expressions(spark):
    texts = ["Don't http://x.y/z spam!", " É a b ", None, "a_b 1"]
    assert values(spark, texts, X.clean_text) == ["dont  spam", "a b", "", "ab 1"]
    karma = [" 12 ", "+5", "12.5", "x", "", "-3"]
    assert values(spark, karma, X.digits_or_null) == [12, None, None, None, None, None]
    assert values(spark, karma, X.int_or_null) == [12, 5, None, None, None, -3]
    grams = values(spark, ["No personal attacks", "a b", ""], lambda t: X.bigrams(X.words(t)))
    assert grams == [["no personal", "personal attacks"], [], []]


def test_index_files_are_written_and_removed_in_rounds(spark, tmp_path, monkeypatch):
    """No more than a round's files are on the disk at a time, none are left, and no row is lost."""
    monkeypatch.setattr(q_sources, "_FILES", 60)
    held, root, files_of = [], [], q_sources._index_files

    def noted(responses, at):
        read = files_of(responses, at)
        root.append(at)
        held.append(sum(len(names) for _, _, names in os.walk(at)))
        return read

    monkeypatch.setattr(q_sources, "_index_files", noted)
    keys = [*range(200), 200, 200, None]  # orders 200 and the one without a key: repeats and nulls are rows as others
    orders = spark.createDataFrame([(k, (k or 0) % 7, f"1996-0{1 + (k or 0) % 2}-{1 + (k or 0) % 28:02d}", "O") for k in keys], "o_orderkey long, o_custkey long, d string, o_orderstatus string")
    orders.withColumn("o_orderdate", F.to_timestamp("d")).drop("d").write.parquet(str(tmp_path / "orders.parquet"))
    got = q_sources.src_index_from_files(spark, str(tmp_path))
    kinds = {r["kind"]: r["count"] for r in got.groupBy("kind").count().collect()}
    seeds = q_sources._responses(spark, str(tmp_path)).select("seed_url")
    day = F.substring(F.element_at(F.split("seed_url", "#"), -2), 7, 2)
    days = {r[0]: r[1] for r in seeds.distinct().groupBy(day).count().collect()}
    whole = sum(1 + (k or 0) % 28 not in (7, 13) for k in keys)
    assert kinds["rejected"] == days["13"] and kinds["missing_file"] == days["07"]
    assert kinds["capture"] + kinds.get("no_path", 0) == whole
    assert len(held) == len(keys) // 60 + 1 and max(held) < 150
    assert not [n for _, _, names in os.walk(root[0]) for n in names]


def test_only_named_files_are_removed(spark, tmp_path):
    for name in ("a.json", "b.json"):
        (tmp_path / name).write_text("[]")
    names = spark.createDataFrame([("a.json",), ("a.json",), ("gone.json",), ("../a.json",), (None,)], "p string")
    assert files.remove_listed(names.coalesce(1), "p", str(tmp_path)) == 1
    assert [p.name for p in tmp_path.iterdir()] == ["b.json"]
