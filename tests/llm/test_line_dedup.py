"""Removal of repeated windows against a plain loop."""

import random

from pyspark.sql import functions as F

from tidemark.llm import line_dedup


def plain(rows):
    """rows: (key, text); equal rows are one document. Gives (key, text, removed) per row."""
    seen, out = set(), {}
    for key, text in sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0)):
        if text is None:
            out[key, text] = (None, 0)
            continue
        lines, gone = text.split("\n"), set()
        for i in range(len(lines) - 2):
            w = tuple(lines[i : i + 3])
            if any(x.strip(" ") for x in w):
                if w in seen:
                    gone |= {i, i + 1, i + 2}
                seen.add(w)
        out[key, text] = ("\n".join(x for i, x in enumerate(lines) if i not in gone), len(gone))
    return sorted((str(k), *map(str, out[k, t])) for k, t in rows)


def check(spark, rows):
    df = spark.createDataFrame([(k, t, "a", 1) for k, t in rows], "doc_id long, text string, a string, first int")
    got = line_dedup.remove_repeats(df.repartition(4)).collect()
    assert all(r["a"] == "a" and r["first"] == 1 for r in got)
    assert sorted((str(r["doc_id"]), str(r["text"]), str(r["ld_removed"])) for r in got) == plain(rows)
    assert all(r["ld_lines"] == (0 if t is None else t.count("\n") + 1) for r, t in zip(
        sorted(got, key=lambda r: (str(r["doc_id"]), r["ld_lines"])),
        [t for _, t in sorted(rows, key=lambda r: (str(r[0]), 0 if r[1] is None else r[1].count("\n") + 1))],
    ))


def test_random_texts(spark):
    rng = random.Random(1)
    passage = [f"line {i}" for i in range(9)]
    rows = []
    for i in range(120):
        lines = [rng.choice(["", " ", f"own {i} {j}", "x"]) for j in range(rng.randint(0, 12))]
        for _ in range(rng.randint(0, 2)):
            a = rng.randint(0, 8)
            at = rng.randint(0, len(lines))
            lines[at:at] = passage[a : rng.randint(a, 9)]
        rows.append((i, "\n".join(lines)))
    rows += [(500 + i, "\n".join(passage)) for i in range(40)]
    check(spark, rows)


def test_odd_rows(spark):
    run = "\n".join(["same"] * 8)
    rows = [(1, None), (2, ""), (3, "a\nb"), (4, run), (5, "\n" * 6), (6, "a\nb\nc"), (6, "a\nb\nc"), (7, "x\na\nb\nc\ny")]
    check(spark, [*rows, (None, "a\nb\nc"), (8, "p\n" * 5000 + "q")])
    check(spark, [])


def test_runs_no_python(spark):
    df = spark.createDataFrame([(1, "a\nb\nc")], "doc_id long, text string")
    plan = line_dedup.remove_repeats(df)._jdf.queryExecution().executedPlan().toString()
    assert not any(x in plan for x in ("Python", "Pandas", "Arrow"))


def test_columns_with_names_of_its_own(spark):
    text = "one line\ntwo lines\nthree lines\nfour"
    names = ["ld_key", "ld_end", "LD_hash", "ld_gaps", "ld_k", "aside_1", "ld_lines"]
    rows = spark.createDataFrame([(1, text), (2, "own\n" + text)], "doc_id long, text string")
    odd = rows.select(F.col("doc_id").alias("ld_at"), F.col("text").alias("ld_split"), *[F.lit(c).alias(c) for c in names])
    got = {r["ld_at"]: r for r in line_dedup.remove_repeats(odd, "ld_at", "ld_split").collect()}
    assert got[1]["ld_split"] == text and got[2]["ld_split"] == "own"
    assert got[2]["ld_lines"] == 5 and got[2]["ld_removed"] == 4
    assert all(r[c] == c for r in got.values() for c in names[:-1])
