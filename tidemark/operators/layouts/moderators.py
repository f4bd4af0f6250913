"""Moderator rosters: four layouts, chosen by the first container that exists on the page."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tidemark.functions.text import LINE_ENDS, digits_or_null, int_or_null, strip
from tidemark.operators.dom import (
    attr,
    attr_contains,
    first,
    has_attr,
    has_class,
    let,
    outermost,
    raw_text,
    reach,
    reached,
    select,
    subtree,
    tag,
    text,
    within,
)

ROSTER_TYPE = "array<struct<username:string,karma:bigint,permission:string,timestamp:string>>"


def _entry(username, karma=None, permission=None, timestamp=None) -> Column:
    none = F.lit(None).cast("string")
    return F.struct(
        username.alias("username"),
        (F.lit(None).cast("bigint") if karma is None else karma).alias("karma"),
        (none if permission is None else permission).alias("permission"),
        (none if timestamp is None else timestamp).alias("timestamp"),
    )


def _named(entries: Column) -> Column:
    return F.filter(entries, lambda e: F.coalesce(e["username"], F.lit("")) != "")


def _stripped(runs: Column, node: Column) -> Column:
    return F.when(node.isNotNull(), strip(raw_text(runs, node)))


def _cards(nodes: Column) -> Column:
    return select(nodes, tag("div"), attr("data-testid", "moderator"))


def layout_1(nodes: Column, runs: Column) -> Column:
    """One card per moderator."""

    def card(c: Column) -> Column:
        def read(sub: Column) -> Column:
            name = first(select(sub, tag("a"), attr_contains("href", "/user/")))
            karma = first(select(sub, tag("span"), lambda n: digits_or_null(n["own"]).isNotNull()))
            when = first(select(sub, tag("time")))
            return _entry(
                let(name, lambda n: _stripped(runs, n)),
                let(karma["own"], digits_or_null),
                None,
                when["attrs"]["datetime"],
            )

        return let(subtree(nodes, c), read)

    return _named(F.transform(_cards(nodes), card))


def _table_by_id(nodes: Column) -> Column:
    return first(select(nodes, tag("div"), attr("id", "moderator-table")))


def layout_2(nodes: Column, runs: Column) -> Column:
    """Rows of the tables in the container with a fixed id."""

    def row(r: Column) -> Column:
        def read(sub: Column) -> Column:
            name = first(select(sub, tag("a"), has_attr("href")))
            karma = first(select(sub, tag("b")))
            return _entry(
                let(name, lambda n: _stripped(runs, n)),
                let(let(karma, lambda k: raw_text(runs, k)), digits_or_null),
            )

        return let(subtree(nodes, r), read)

    def rows(box: Column) -> Column:
        # Rows in the box that are in a table; a table may be inside the box or around it.
        return F.flatten(
            F.transform(
                outermost(nodes, tag("table")),
                lambda t: let(
                    F.greatest(t["i"], box["i"]),
                    lambda i: select(
                        F.slice(nodes, i + 2, F.greatest(F.least(t["j"], box["j"]) - i, F.lit(0))), tag("tr")
                    ),
                ),
            )
        )

    found = let(_table_by_id(nodes), lambda box: F.when(box.isNotNull(), rows(box)))
    return _named(F.transform(found, row))


def _bits(nodes: Column) -> Column:
    return select(nodes, tag("span"), has_class("permission-bit"))


def _table_by_class(nodes: Column) -> Column:
    return first(select(nodes, tag("div"), has_class("moderator-table")))


def summaries_reach(nodes: Column) -> Column:
    """How far the permission summaries reach, see ``dom.reach``."""
    return reach(nodes, tag("div"), has_class("permission-summary"))


def permission(nodes: Column, runs: Column, sub: Column, summaries: Column) -> Column:
    """Permission of a table row: grey label, summary bits, bits nested in a cell, input value.

    ``summaries`` is ``summaries_reach`` of the page, so a bit is looked up, not compared with each.
    """
    by_label = let(
        first(select(sub, tag("span"), has_class("gray"))), lambda grey: F.when(grey.isNotNull(), text(runs, grey))
    )

    def joined(bits: Column, read) -> Column:
        return F.when(F.size(bits) > 0, F.array_join(F.transform(bits, read), ", "))

    summary = first(select(sub, has_class("permission-summary")))
    by_summary = let(
        let(summary, lambda s: _bits(within(sub, s))),
        lambda bits: joined(bits, lambda b: strip(raw_text(runs, b))),
    )

    def cell(td: Column) -> Column:
        box = first(select(within(sub, td), tag("div"), has_class("permissions")))
        bits = let(
            box,
            lambda b: F.filter(_bits(within(sub, b)), lambda n: reached(n, summaries)),
        )
        return let(bits, lambda found: joined(found, lambda b: text(runs, b)))

    cells = F.transform(select(sub, tag("td")), cell)
    # Bits count only inside summaries, so a page without one needs no look at its cells.
    by_cell = F.when(F.size(summaries) > 0, first(F.filter(cells, lambda c: c.isNotNull())))
    by_input = let(
        first(select(sub, tag("input"), attr("name", "permissions"))),
        lambda field: F.when(field.isNotNull(), strip(F.coalesce(field["attrs"]["value"], F.lit("")))),
    )

    def given(value: Column) -> Column:
        return F.when(value != "", value)

    # Each way is tried once; the last three tell an empty text from none.
    return let(
        by_label,
        lambda label: F.coalesce(
            given(label),
            let(
                by_summary,
                lambda bits: F.coalesce(
                    given(bits),
                    let(by_cell, lambda found: F.coalesce(given(found), by_input, found)),
                    bits,
                ),
            ),
            label,
        ),
    )


def layout_3(nodes: Column, runs: Column) -> Column:
    """Rows of the first table in the container with a fixed class."""

    def rows_of(summaries: Column) -> Column:
        def row(r: Column) -> Column:
            def read(sub: Column) -> Column:
                name = first(select(sub, tag("a"), has_attr("href")))
                karma = first(select(sub, tag("b")))
                when = first(select(sub, tag("time")))
                return _entry(
                    let(name, lambda n: F.when(n.isNotNull(), text(runs, n))),
                    let(let(karma, lambda k: text(runs, k)), int_or_null),
                    permission(nodes, runs, sub, summaries),
                    let(when, lambda n: F.when(n.isNotNull(), text(runs, n))),
                )

            return let(subtree(nodes, r), read)

        table = let(
            _table_by_class(nodes), lambda box: first(select(subtree(nodes, box), tag("table")))
        )
        return F.transform(let(table, lambda t: select(subtree(nodes, t), tag("tr"))), row)

    return _named(let(summaries_reach(nodes), rows_of))


def _text_box(nodes: Column) -> Column:
    return first(select(nodes, tag("div"), has_class("md")))


def layout_4(nodes: Column, runs: Column) -> Column:
    """Text lines ``name (karma)``."""
    lines = let(
        _text_box(nodes), lambda box: F.split(raw_text(runs, box, "\n"), LINE_ENDS)
    )
    shaped = F.filter(
        F.transform(lines, strip),
        lambda s: F.contains(s, F.lit(")")) & (F.size(F.split(s, r"\(")) == 2),
    )
    entries = F.transform(
        shaped,
        lambda s: _entry(
            strip(F.substring_index(s, "(", 1)),
            int_or_null(F.btrim(F.substring_index(s, "(", -1), F.lit(") "))),
        ),
    )
    return F.filter(entries, lambda e: e["karma"].isNotNull())


LAYOUTS = (
    (1, lambda nodes: _exists(nodes, tag("div"), attr("data-testid", "moderator")), layout_1),
    (2, lambda nodes: _exists(nodes, tag("div"), attr("id", "moderator-table")), layout_2),
    (3, lambda nodes: _exists(nodes, tag("div"), has_class("moderator-table")), layout_3),
    (4, lambda nodes: _exists(nodes, tag("div"), has_class("md")), layout_4),
)


def _exists(nodes: Column, *tests) -> Column:
    def passed(n: Column) -> Column:
        out = tests[0](n)
        for test in tests[1:]:
            out = out & test(n)
        return F.coalesce(out, F.lit(False))

    return F.exists(nodes, passed)


def layout_number(nodes: Column) -> Column:
    """First layout whose container is on the page, even if it yields no moderator."""
    chain = None
    for number, exists, _ in LAYOUTS:
        chain = F.when(exists(nodes), number) if chain is None else chain.when(exists(nodes), number)
    return chain


def roster(nodes: Column, runs: Column, number: Column | None = None) -> Column:
    """Moderators by the first layout whose container exists; empty when there is none. ``number`` is the
    page's layout, where it is known."""

    def read(found: Column) -> Column:
        chain = F
        for layout, _, entries in LAYOUTS:
            rows = F.coalesce(entries(nodes, runs), F.array().cast(ROSTER_TYPE)).cast(ROSTER_TYPE)
            chain = chain.when(found == layout, rows)
        return chain.otherwise(F.array().cast(ROSTER_TYPE))

    return let(layout_number(nodes), read) if number is None else read(number)
