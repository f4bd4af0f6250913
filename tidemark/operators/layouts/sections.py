"""Rules in text sections (wiki pages and old front pages): arrays of (title, description)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import strip
from tidemark.operators.dom import (
    children,
    first,
    has_class,
    inside,
    let,
    next_node,
    own_contains,
    select,
    subtree,
    tag,
    text,
)

PAIRS = "array<struct<title:string,description:string>>"
HEADINGS = ("h1", "h2", "h3", "h4", "h5")
# Fixed value: an item without a title counts as a rule when its text is longer than this.
SHORT_ITEM = 10


def _pair(title: Column, description: Column | None = None) -> Column:
    desc = F.lit("") if description is None else description
    return F.struct(title.alias("title"), desc.alias("description"))


def _boxes(nodes: Column) -> Column:
    return select(nodes, tag("div"), has_class("md"))


def _rule_header(nodes: Column, box: Column) -> Column:
    return first(select(subtree(nodes, box), tag(*HEADINGS), own_contains("rule")))


def _after_header(nodes: Column, *tags: str) -> Column:
    """Next element of the given names after the rule heading, if it lies in the same section."""

    def in_box(box: Column) -> Column:
        hit = let(_rule_header(nodes, box), lambda h: next_node(nodes, h, tag(*tags)))
        return let(hit, lambda n: F.when(inside(n, box), n))

    return let(first(_boxes(nodes)), in_box)


def quoted(nodes: Column, runs: Column) -> Column:
    """Direct paragraphs of the quote after "posting rules"; first section that has some."""

    def from_box(box: Column) -> Column:
        header = first(select(subtree(nodes, box), tag("h1"), own_contains("posting rules")))
        quote = let(header, lambda h: next_node(nodes, h, tag("blockquote")))
        paragraphs = let(quote, lambda q: children(nodes, q, tag("p")))
        texts = F.transform(paragraphs, lambda p: text(runs, p, " "))
        return F.transform(F.filter(texts, lambda t: t != ""), lambda t: _pair(t))

    found = F.transform(_boxes(nodes), from_box)
    return first(F.filter(found, lambda f: F.size(f) > 0))


def table_rows(nodes: Column, runs: Column) -> Column:
    """Two-cell rows of the table after the rule heading."""
    rows = let(
        _after_header(nodes, "table"), lambda t: select(subtree(nodes, t), tag("tr"))
    )
    cells = F.transform(rows, lambda r: select(subtree(nodes, r), tag("td")))
    return F.transform(
        F.filter(cells, lambda c: F.size(c) == 2),
        lambda c: _pair(text(runs, F.get(c, F.lit(0))), text(runs, F.get(c, F.lit(1)), " ")),
    )


def list_items(nodes: Column, runs: Column) -> Column:
    """Direct items of the list after the rule heading: bold or linked title, else the whole text."""

    def item(li: Column) -> Column:
        def read(sub: Column) -> Column:
            strong = first(select(sub, tag("strong")))
            head = F.coalesce(strong, first(select(sub, tag("a"))))
            whole = text(runs, li, " ")
            title = text(runs, head)
            rest = strip(F.replace(whole, title, F.lit("")))
            return F.when(head.isNotNull(), _pair(title, rest)).when(
                F.length(whole) > SHORT_ITEM, _pair(whole)
            )

        return let(subtree(nodes, li), read)

    items = let(_after_header(nodes, "ul", "ol"), lambda b: children(nodes, b, tag("li")))
    return F.filter(F.transform(items, item), lambda p: p.isNotNull())


def any_list(nodes: Column, runs: Column) -> Column:
    """Direct items of the list after any heading whose full text mentions rules; first that has some."""

    def from_box(box: Column) -> Column:
        def from_header(h: Column) -> Column:
            hit = let(
                next_node(nodes, h, tag("ul", "ol")), lambda n: F.when(inside(n, box), n)
            )
            items = let(hit, lambda b: children(nodes, b, tag("li")))
            texts = F.transform(items, lambda li: text(runs, li, " "))
            return F.transform(F.filter(texts, lambda t: t != ""), lambda t: _pair(t))

        headers = select(
            subtree(nodes, box),
            tag(*HEADINGS),
            lambda h: F.contains(F.lower(text(runs, h)), F.lit("rules")),
        )
        found = F.transform(headers, from_header)
        return first(F.filter(found, lambda f: F.size(f) > 0))

    found = F.transform(_boxes(nodes), from_box)
    return first(F.filter(found, lambda f: F.size(f) > 0))


WIKI_CASES = ((1, table_rows), (2, list_items))
OLD_CASES = ((1, quoted), (2, table_rows), (3, list_items), (4, any_list))


def first_case(cases, nodes: Column, runs: Column) -> Column:
    """(case_no, rules) of the first case that yields rules, chosen before scoring."""

    def option(number: int, rules: Column) -> Column:
        chosen = lambda r: F.struct(F.lit(number).alias("case_no"), r.alias("rules"))
        return let(rules, lambda r: F.when(F.size(r) > 0, chosen(r)))

    return F.coalesce(*[option(k, case(nodes, runs).cast(PAIRS)) for k, case in cases])
