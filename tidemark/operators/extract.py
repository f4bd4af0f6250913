"""From stored pages to rosters and rules: route, read the layouts, score, choose, number, group.

One pass shreds a page and reads its layouts inside the row; HTML and nodes are never shuffled. Its
result, a few short texts per page, is written once, because rules and rosters both read it. Rule
candidates are then scored case by case until a page has a rule, and brought together again by page.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import lru_cache
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions import urls as U
from tidemark.functions.text import rule_text, strip
from tidemark.operators import dom as D
from tidemark.operators.layouts import LAYOUT_KEEP, homepage, moderators, sections
from tidemark.operators.ordered import latest_per_key
from tidemark.session import written

# Fixed value: a candidate is kept when its probability of being a rule reaches this.
RULE_THRESHOLD = 0.105

Scorer = Callable[[DataFrame], DataFrame]

CANDIDATES = "array<struct<case_no:int,rules:array<struct<title:string,description:string>>>>"

# How a page's case is chosen, by page type.
AFTER_SCORE, BEFORE_SCORE, CONTAINER = "after_score", "before_score", "container"


def layout_dom(pages: DataFrame) -> DataFrame:
    """Shred pages, keeping only what some layout looks at."""
    return D.shred(pages, LAYOUT_KEEP)


def moderator_rows(dom: DataFrame, *keys: str) -> DataFrame:
    """One row per moderator, ``pos`` in page order."""
    nodes, runs = F.col("nodes"), F.col("runs")
    return (
        dom.select(*keys, "nodes", "runs", moderators.layout_number(nodes).alias("layout"))
        .select(*keys, "layout", F.posexplode(moderators.roster(nodes, runs, F.col("layout"))).alias("pos", "m"))
        .select(*keys, "layout", "pos", "m.*")
    )


def with_since(rows: DataFrame) -> DataFrame:
    """Add ``since``, the moderator's timestamp as a time where it is written in ISO form. The text
    itself stays as found: other layouts show it as "5 years ago"."""
    return rows.withColumn("since", F.col("timestamp").try_cast("timestamp"))


def section_candidates(dom: DataFrame, cases, *keys: str) -> DataFrame:
    """Rules of the first section layout that yields some."""
    found = sections.first_case(cases, F.col("nodes"), F.col("runs"))
    return (
        dom.select(*keys, found.alias("f"))
        .select(*keys, "f.case_no", F.posexplode("f.rules").alias("pos", "r"))
        .select(*keys, "case_no", "pos", "r.*")
    )


def scored_text() -> Column:
    return rule_text(F.col("title"), F.col("description"))


def filter_by_threshold(scored: DataFrame, threshold: float = RULE_THRESHOLD) -> DataFrame:
    """Flag candidates as kept; rejected ones stay visible until the flag is used."""
    return scored.withColumn("kept", F.col("score") >= threshold)


def first_layout(cases: DataFrame, key: str, mode: str) -> DataFrame:
    """Rows of the first case per page.

    ``after_score``: first case with a kept row. ``before_score`` and ``container``: first case that
    has rows at all; a container case without entries is given as a row with a null ``pos``.
    """
    counts = F.col("kept") if mode == AFTER_SCORE else F.lit(True)
    w = Window.partitionBy(key)
    chosen = cases.withColumn(
        "__first", F.min(F.when(counts, F.col("case_no"))).over(w)
    ).where(F.col("case_no") == F.col("__first"))
    if mode == CONTAINER:
        chosen = chosen.where(F.col("pos").isNotNull())
    return chosen.drop("__first")


def number_and_dedup(rules: DataFrame, key: str) -> DataFrame:
    """Number a page's rules in order, then drop repeats that differ in case only.

    Numbers are given before repeats are dropped, so gaps remain. A page's rules come from one page,
    so the window per page is bounded by that page.
    """
    numbered = rules.withColumn(
        "number", F.row_number().over(Window.partitionBy(key).orderBy("pos"))
    )
    same = numbered.withColumn("__t", F.lower(strip(F.col("title")))).withColumn(
        "__d", F.lower(strip(F.coalesce("description", F.lit(""))))
    )
    return latest_per_key(same, [key, "__t", "__d"], [F.col("number").asc()]).drop("__t", "__d")


def group_rules(rules: DataFrame, *keys: str) -> DataFrame:
    """Rules as stored: an ordered array per page."""
    entry = F.struct("pos", "number", "title", "description")
    return rules.groupBy(*keys).agg(
        F.transform(
            F.sort_array(F.collect_list(entry)),
            lambda e: F.struct(
                e["number"].alias("number"),
                e["title"].alias("title"),
                e["description"].alias("description"),
            ),
        ).alias("rules")
    )


def route(pages: DataFrame, original: str = "original") -> DataFrame:
    """Pages of a known type; others have nothing to extract."""
    return pages.withColumn("page_type", U.page_type(F.col(original))).where(
        F.col("page_type").isNotNull()
    )


@lru_cache(maxsize=2)
def _layout_columns(application: str) -> tuple[Column, Column]:
    """(moderators, candidates) by page type. The expressions are large, so a session builds them
    once; every batch of a stream reuses them."""
    nodes, runs, kind = F.col("nodes"), F.col("runs"), F.col("page_type")
    front = F.transform(
        homepage.candidates(nodes, runs),
        lambda c: F.struct(
            c["case_no"].alias("case_no"),
            F.transform(
                c["texts"],
                lambda t: F.struct(t.alias("title"), F.lit(None).cast("string").alias("description")),
            ).alias("rules"),
        ),
    )
    front = F.filter(front, lambda c: F.size(c["rules"]) > 0).cast(CANDIDATES)
    wiki = F.array(sections.first_case(sections.WIKI_CASES, nodes, runs)).cast(CANDIDATES)
    old = F.array(sections.first_case(sections.OLD_CASES, nodes, runs)).cast(CANDIDATES)
    return (
        F.when(kind == "moderators", moderators.roster(nodes, runs)).alias("moderators"),
        F.when(kind == "homepage", front)
        .when(kind == "wiki", wiki)
        .when(kind == "homepage_old", old)
        .alias("candidates"),
    )


def read_layouts(dom: DataFrame, *keys: str) -> DataFrame:
    """(keys, page_type, parse_error, moderators, candidates) of shredded, routed pages.

    ``candidates`` holds every front-page case, or the chosen case of a section page. Each row only
    evaluates the layouts of its own page type.
    """
    columns = _layout_columns(dom.sparkSession.sparkContext.applicationId)
    return dom.select(*keys, "page_type", "parse_error", *columns)


def rule_candidates(layouts: DataFrame, key: str, *carried: str) -> DataFrame:
    """One row per candidate: (key, carried columns, page_type, case_no, pos, title, description,
    score_text)."""
    return (
        layouts.select(key, *carried, "page_type", F.inline("candidates"))
        .select(key, *carried, "page_type", "case_no", F.posexplode("rules").alias("pos", "r"))
        .select(key, *carried, "page_type", "case_no", "pos", "r.*")
        .withColumn("score_text", scored_text())
    )


def first_kept(
    layouts: DataFrame, key: str, scorer: Scorer, threshold: float = RULE_THRESHOLD, carried: Sequence[str] = ()
) -> DataFrame:
    """The kept candidates of each page's first case that has any: (key, carried columns, page_type, case_no,
    pos, title, description).

    Case by case: the first one of every page is scored, and only pages of which nothing was kept go on to
    their next one. So there are as many rounds as the most undecided page has cases, eleven at most, and
    each reads what the one before wrote. A key names one page.
    """
    names = [key, *carried, "page_type"]
    left = layouts.select(*names, "candidates").where(F.size("candidates") > 0)
    found, k = None, 0
    while True:
        case = F.get("candidates", F.lit(k))
        rows = left.select(*names, case["case_no"].alias("case_no"), F.posexplode(case["rules"]).alias("pos", "r"))
        rows = rows.select(*names, "case_no", "pos", "r.*").withColumn("score_text", scored_text())
        kept = filter_by_threshold(scorer(rows), threshold).where("kept")
        kept = written(kept.select(*names, "case_no", "pos", "title", "description"), "kept")
        found = kept if found is None else found.unionByName(kept)
        k += 1
        rest = left.where(F.size("candidates") > k)
        left = written(rest.join(kept.select(key).distinct(), key, "left_anti"), "undecided")
        if left.isEmpty():
            return found


def final_rules(chosen: DataFrame, key: str, carried: Sequence[str] = ()) -> DataFrame:
    """(key, carried columns, page_type, case_no, pos, number, title, description) of the chosen candidates.

    Front pages keep their texts as they are and have no numbers; sections are numbered and freed of
    repeats.
    """
    front = F.col("page_type") == "homepage"
    by_page = Window.partitionBy(key).orderBy("pos")
    same = Window.partitionBy(
        key,
        F.when(front, F.col("pos")),
        F.lower(strip(F.col("title"))),
        F.lower(strip(F.coalesce("description", F.lit("")))),
    ).orderBy("pos")
    return (
        chosen.withColumn("number", F.when(~front, F.row_number().over(by_page)))
        .withColumn("__copy", F.row_number().over(same))
        .where("__copy = 1")
        .select(key, *carried, "page_type", "case_no", "pos", "number", "title", "description")
    )


class Extracted(NamedTuple):
    """What pages gave: stored rules and moderators, and the pages that could not be read."""

    rules: DataFrame
    moderators: DataFrame
    quarantine: DataFrame


def extract(
    pages: DataFrame, key: str, scorer: Scorer, threshold: float = RULE_THRESHOLD
) -> Extracted:
    """Rules, moderators and quarantine, from pages with ``key``, ``original`` and ``html``."""
    dom = layout_dom(route(pages.select(key, "original", "html")))
    layouts = written(read_layouts(dom, key), "layouts")
    return Extracted(
        stored_rules(layouts, key, scorer, threshold), stored_rosters(layouts, key), unreadable(layouts, key)
    )


def stored_rules(
    layouts: DataFrame, key: str, scorer: Scorer, threshold: float = RULE_THRESHOLD, carried: Sequence[str] = ()
) -> DataFrame:
    """Rules as stored. ``carried`` columns have one value per key."""
    chosen = first_kept(layouts.where("page_type <> 'moderators'"), key, scorer, threshold, carried)
    return group_rules(final_rules(chosen, key, carried), key, *carried)


def stored_rosters(layouts: DataFrame, key: str, *carried: str) -> DataFrame:
    return layouts.where("page_type = 'moderators'").select(key, *carried, "moderators").where(
        F.size("moderators") > 0
    )


def unreadable(layouts: DataFrame, *keys: str) -> DataFrame:
    """Quarantine: pages whose HTML could not be read."""
    return layouts.where(F.col("parse_error").isNotNull()).select(*keys, "parse_error")
