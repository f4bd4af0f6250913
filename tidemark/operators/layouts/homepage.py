"""Rules on community front pages: eleven layouts, each an array of texts."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import dashed, strip
from tidemark.operators.dom import (
    child_number,
    first,
    following,
    has_class,
    let,
    next_node,
    next_sibling,
    own_contains,
    parent_of,
    running,
    select,
    subtree,
    tag,
    text,
)

# Class pairs of the outer and inner element of two layouts.
CARD_CLASSES = {
    7: (("_8ZLJI1-ZiP7pHJ_yO1L4Z", "_3osxlOKfiylmgqNqsW7erB"), ("tbIApBd2DM_drfZQJjIum",)),
    8: (("s1i3808h-2", "ckCcrs"), ("s1i3808h-4", "eBcdMM")),
}
NO_TEXTS = "array<string>"


def _nonempty(texts: Column) -> Column:
    return F.filter(texts, lambda t: t != "")


def _in_form(nodes: Column):
    """form > div > div > (element)"""

    def test(n: Column) -> Column:
        inner = parent_of(nodes, n)
        outer = parent_of(nodes, inner)
        form = parent_of(nodes, outer)
        return (inner["tag"] == "div") & (outer["tag"] == "div") & (form["tag"] == "form")

    return test


def _item_paragraphs(nodes: Column, runs: Column, box: Column) -> Column:
    """Text of the first paragraph of every list item of ``box``; it may be empty."""

    def items(b: Column) -> Column:
        paragraphs = F.transform(
            select(subtree(nodes, b), tag("li")),
            lambda li: first(select(subtree(nodes, li), tag("p"))),
        )
        return F.transform(
            F.filter(paragraphs, lambda p: p.isNotNull()), lambda p: text(runs, p)
        )

    return let(box, items)


def _numbered_list(k: int):
    def case(nodes: Column, runs: Column) -> Column:
        box = first(select(nodes, tag("ul"), child_number(k), _in_form(nodes)))
        return _item_paragraphs(nodes, runs, box)

    return case


def case_3(nodes: Column, runs: Column) -> Column:
    return _item_paragraphs(nodes, runs, first(select(nodes, tag("ol"), _in_form(nodes))))


def _rules_h1(nodes: Column) -> Column:
    return first(select(nodes, tag("h1"), own_contains("rules")))


def case_4(nodes: Column, runs: Column) -> Column:
    """Second-level headings up to the next first-level heading."""

    def heads(rest: Column) -> Column:
        stop = first(select(rest, tag("h1")))
        upto = F.when(stop.isNull(), rest).otherwise(
            F.slice(rest, F.lit(1), stop["i"] - F.get(rest, F.lit(0))["i"])
        )
        return F.transform(select(upto, tag("h2")), lambda h: text(runs, h))

    return _nonempty(let(let(_rules_h1(nodes), lambda h: following(nodes, h)), heads))


def case_5(nodes: Column, runs: Column) -> Column:
    quote = let(_rules_h1(nodes), lambda h: next_node(nodes, h, tag("blockquote")))
    paragraphs = let(quote, lambda q: select(subtree(nodes, q), tag("p")))
    return _nonempty(F.transform(paragraphs, lambda p: text(runs, p, " ")))


def case_6(nodes: Column, runs: Column) -> Column:
    table = let(_rules_h1(nodes), lambda h: next_node(nodes, h, tag("table")))
    rows = let(table, lambda t: select(subtree(nodes, t), tag("tr")))
    cells = F.transform(rows, lambda r: select(subtree(nodes, r), tag("td")))
    return F.transform(
        F.filter(cells, lambda c: F.size(c) > 0),
        lambda c: dashed(
            text(runs, first(c)), F.when(F.size(c) > 1, text(runs, F.get(c, F.lit(1))))
        ),
    )


def _cards(k: int):
    outer, inner = CARD_CLASSES[k]

    def case(nodes: Column, runs: Column) -> Column:
        found = F.transform(
            select(nodes, tag("div"), has_class(*outer)),
            lambda d: first(select(subtree(nodes, d), tag("div"), has_class(*inner))),
        )
        return F.transform(F.filter(found, lambda n: n.isNotNull()), lambda n: text(runs, n))

    return case


def _headed(nodes: Column, runs: Column, *tags: str) -> Column:
    """First heading whose full text mentions rules."""
    return first(
        select(nodes, tag(*tags), lambda h: F.contains(F.lower(text(runs, h)), F.lit("rules")))
    )


def _items(nodes: Column, runs: Column, box: Column) -> Column:
    items = let(box, lambda b: select(subtree(nodes, b), tag("li")))
    return _nonempty(F.transform(items, lambda li: text(runs, li)))


def case_9(nodes: Column, runs: Column) -> Column:
    box = let(_headed(nodes, runs, "h1"), lambda h: next_sibling(nodes, h, tag("ul")))
    return _items(nodes, runs, box)


def case_10(nodes: Column, runs: Column) -> Column:
    box = let(_headed(nodes, runs, "h1", "h2", "h3"), lambda h: next_node(nodes, h, tag("ol")))
    return _items(nodes, runs, box)


def case_11(nodes: Column, runs: Column) -> Column:
    """Blocks whose text starts with a number, a dot or bracket and a blank.

    Runs are stripped once per page and empty ones left out. As no run starts with a blank, the dot or
    bracket and the blank after it stand in one run: the first of the block that holds more than digits.
    Which one that is, is known for every place of the page, so a block is tested by one look, and only
    the text of those that pass is put together.
    """
    # The pattern of a text, taken apart at its number.
    digits, after_digits, numbered = r"(?U)^\d+\z", r"(?U)^\d*[.)]\s", r"(?U)^\d+[.)]\s"
    none = F.array().cast(NO_TEXTS)

    def blocks(stripped: Column) -> Column:
        bare = _nonempty(stripped)
        filled = F.transform(stripped, lambda t: (t != "").cast("int"))
        counts = running(filled, "int", F.lit(0), lambda a, b: a + b)

        def with_bare(bare: Column) -> Column:
            # Place of the first run from here on that is no number.
            far = F.lit(2**31 - 1)
            places = F.transform(bare, lambda t, k: F.when(t.rlike(digits), far).otherwise(k))
            ahead = F.reverse(running(F.reverse(places), "int", far, lambda a, b: F.least(a, b)))

            def with_scans(scans: Column) -> Column:
                before = lambda t: F.coalesce(F.get(scans["counts"], t - 1), F.lit(0))

                def starts(d: Column) -> Column:
                    a, b = before(d["t0"]), before(d["t1"])
                    at = F.get(scans["ahead"], a)
                    run = F.get(bare, at)
                    fits = F.when(at == a, run.rlike(numbered)).otherwise(run.rlike(after_digits))
                    return F.coalesce((at < b) & fits, F.lit(False))

                def whole(d: Column) -> Column:
                    a = before(d["t0"])
                    return F.array_join(F.slice(bare, a + 1, before(d["t1"]) - a), "")

                return F.transform(F.filter(select(nodes, tag("div")), starts), whole)

            found = let(F.struct(counts.alias("counts"), ahead.alias("ahead")), with_scans)
            return F.when(F.exists(bare, lambda t: t.rlike(after_digits)), found).otherwise(none)

        return let(bare, with_bare)

    return let(F.transform(runs, strip), blocks)


CASES = (
    (1, _numbered_list(7)),
    (2, _numbered_list(10)),
    (3, case_3),
    (4, case_4),
    (5, case_5),
    (6, case_6),
    (7, _cards(7)),
    (8, _cards(8)),
    (9, case_9),
    (10, case_10),
    (11, case_11),
)


def candidates(nodes: Column, runs: Column) -> Column:
    """Array of (case_no, texts) over all layouts; the choice is made after scoring."""
    return F.array(
        *[
            F.struct(
                F.lit(number).alias("case_no"),
                F.coalesce(case(nodes, runs), F.array().cast(NO_TEXTS)).cast(NO_TEXTS).alias("texts"),
            )
            for number, case in CASES
        ]
    )
