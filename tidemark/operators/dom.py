"""The DOM of stored pages as columns, and structural queries over it.

``shred`` turns a page table into one row per page with ``nodes`` and ``runs``. A node's place in the
array is its document order, so its subtree is a slice of the array and its text is a slice of the
runs. Structural steps therefore run inside the row: no node is exploded, shuffled or joined, and a
page costs the same whatever else is in the table. ``dom_nodes`` and the pair operators give the
relational view of the same data.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tidemark.functions.expr import let
from tidemark.functions.shred import Keep, node_ddl, shred_batches
from tidemark.functions.text import strip

Test = Callable[[Column], Column]


def shred(pages: DataFrame, keep: Keep = Keep()) -> DataFrame:
    """Replace ``html`` by ``nodes``, ``runs`` and ``parse_error``; other columns pass through."""
    others = [f"`{f.name}` {f.dataType.simpleString()}" for f in pages.schema.fields if f.name != "html"]
    nodes = node_ddl(keep.fields)
    schema = ", ".join(others + [f"nodes {nodes}", "runs array<string>", "parse_error string"])
    return pages.mapInArrow(lambda batches: shred_batches(batches, keep), schema)


def first(nodes: Column) -> Column:
    return F.get(nodes, F.lit(0))


def select(nodes: Column, *tests: Column | Test) -> Column:
    """Nodes that pass all tests, in document order."""

    def keep(n: Column) -> Column:
        passed = None
        for test in tests:
            one = test(n)
            passed = one if passed is None else passed & one
        return F.coalesce(passed, F.lit(False))

    return F.filter(nodes, keep)


def tag(*names: str) -> Test:
    return lambda n: n["tag"].isin(*names) if len(names) > 1 else n["tag"] == names[0]


def has_class(*names: str) -> Test:
    def test(n: Column) -> Column:
        out = F.array_contains(n["classes"], names[0])
        for name in names[1:]:
            out = out & F.array_contains(n["classes"], name)
        return out

    return test


def attr(name: str, value: str) -> Test:
    return lambda n: n["attrs"][name] == value


def attr_contains(name: str, part: str) -> Test:
    return lambda n: F.contains(n["attrs"][name], F.lit(part))


def has_attr(name: str) -> Test:
    return lambda n: n["attrs"][name].isNotNull()


def own_contains(part: str) -> Test:
    return lambda n: F.contains(F.lower(n["own"]), F.lit(part))


def child_number(k: int) -> Test:
    return lambda n: n["child_idx"] == k


def subtree(nodes: Column, a: Column) -> Column:
    """Descendants of ``a``."""
    return F.slice(nodes, a["i"] + 2, a["j"] - a["i"])


def within(part: Column, a: Column) -> Column:
    """Descendants of ``a``, which is a node of ``part``, a subtree: what is cut is the part, not the page."""
    return F.slice(part, a["i"] + 2 - first(part)["i"], a["j"] - a["i"])


def following(nodes: Column, a: Column) -> Column:
    """All nodes that start after ``a`` starts, its descendants included."""
    return F.slice(nodes, a["i"] + 2, F.size(nodes) - a["i"] - 1)


def next_node(nodes: Column, a: Column, *tests: Test) -> Column:
    return first(select(following(nodes, a), *tests))


def next_sibling(nodes: Column, a: Column, *tests: Test) -> Column:
    beyond = F.slice(nodes, a["j"] + 2, F.size(nodes) - a["j"] - 1)
    return first(select(beyond, lambda n: n["parent"] == a["parent"], *tests))


def children(nodes: Column, a: Column, *tests: Test) -> Column:
    return select(subtree(nodes, a), lambda n: n["up"] == a["i"], *tests)


def parent_of(nodes: Column, a: Column) -> Column:
    return F.get(nodes, a["up"])


def inside(a: Column, b: Column) -> Column:
    """Whether ``a`` is a descendant of ``b``."""
    return (a["i"] > b["i"]) & (a["i"] <= b["j"])


_SCAN = 128  # values of a running fold that are appended one by one


def running(values: Column, kind: str, zero: Column, step: Callable[[Column, Column], Column]) -> Column:
    """Inclusive running fold of an array by an associative ``step``.

    Blocks are folded on their own, then what comes before a block is added, so the copying that an
    append costs stays within a block.
    """
    nothing = F.array().cast(f"array<{kind}>")

    def scan(part: Column) -> Column:
        return F.aggregate(
            part, nothing, lambda acc, x: F.array_append(acc, step(F.coalesce(F.get(acc, F.size(acc) - 1), zero), x))
        )

    def folded(all_: Column) -> Column:
        blocks = F.transform(
            F.sequence(F.lit(0), F.ceil(F.size(all_) / _SCAN).cast("int") - 1),
            lambda k: scan(F.slice(all_, k * _SCAN + 1, F.lit(_SCAN))),
        )

        def joined(parts: Column) -> Column:
            upto = scan(F.transform(parts, lambda p: F.element_at(p, -1)))
            return let(
                upto,
                lambda u: F.flatten(
                    F.transform(
                        parts,
                        lambda p, k: let(
                            F.coalesce(F.get(u, k - 1), zero), lambda before: F.transform(p, lambda x: step(before, x))
                        ),
                    )
                ),
            )

        return let(blocks, joined)

    return let(values, lambda v: F.when(F.size(v) > 0, folded(v)).otherwise(nothing))


def outermost(nodes: Column, *tests: Test) -> Column:
    """Nodes that pass all tests and are inside no other such node. Subtrees are nested, so one is inside
    another where an earlier one ends after it."""

    def alone(marked: Column) -> Column:
        ends = running(F.transform(marked, lambda n: n["j"].cast("int")), "int", F.lit(-1), lambda a, b: F.greatest(a, b))
        return let(ends, lambda e: F.filter(marked, lambda n, k: n["i"] > F.coalesce(F.get(e, k - 1), F.lit(-1))))

    return let(select(nodes, *tests), lambda marked: F.when(F.size(marked) > 1, alone(marked)).otherwise(marked))


def reach(nodes: Column, *tests: Test) -> Column:
    """For each place up to the end of the last marked node, the end of the outermost marked node it is in,
    or -1. Empty where no node is marked."""

    def spread(marked: Column) -> Column:
        return F.flatten(
            F.transform(
                marked,
                lambda n, k: F.concat(
                    F.array_repeat(F.lit(-1), n["i"] - F.coalesce(F.get(marked, k - 1)["j"], F.lit(-1)) - 1),
                    F.array_repeat(n["j"].cast("int"), n["j"] - n["i"] + 1),
                ),
            )
        )

    return let(outermost(nodes, *tests), spread)


def reached(n: Column, reaches: Column) -> Column:
    """Whether ``n`` is inside a marked node, by ``reach``."""
    return F.coalesce(F.get(reaches, n["i"] - 1) >= n["i"], F.lit(False))


def _runs(runs: Column, a: Column) -> Column:
    return F.slice(runs, a["t0"] + 1, a["t1"] - a["t0"])


def raw_text(runs: Column, a: Column, sep: str = "") -> Column:
    return F.array_join(_runs(runs, a), sep)


def text(runs: Column, a: Column, sep: str = "") -> Column:
    """Text of ``a``: every run stripped, empty ones dropped, joined by ``sep``."""
    return F.array_join(F.filter(F.transform(_runs(runs, a), strip), lambda t: t != ""), sep)


# Relational views


def dom_nodes(dom: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per element."""
    return dom.select(key, F.inline("nodes"))


def dom_text(dom: DataFrame, key: str = "page_id") -> DataFrame:
    """One row per text run."""
    return dom.select(key, F.posexplode("runs").alias("pos", "text"))


def dom_text_agg(dom: DataFrame, test: Test, sep: str = "", key: str = "page_id") -> DataFrame:
    """Text of every matching element."""
    rows = F.transform(
        select(F.col("nodes"), test),
        lambda n: F.struct(n["pre"].alias("pre"), text(F.col("runs"), n, sep).alias("text")),
    )
    return dom.select(key, F.inline(rows))


def _pairs(dom: DataFrame, anchor: Test, related: Callable[[Column], Column], key: str) -> DataFrame:
    """One anchor at a time: the pairs of a page never stand in one array."""
    anchors = dom.select(key, "nodes", F.explode(select(F.col("nodes"), anchor)).alias("a"))
    a = F.col("a")
    return anchors.select(key, a["pre"].alias("a_pre"), F.explode(related(a)).alias("b")).select(
        key, "a_pre", F.col("b.pre").alias("b_pre")
    )


def join_descendant(dom: DataFrame, anchor: Test, test: Test, key: str = "page_id") -> DataFrame:
    return _pairs(dom, anchor, lambda a: select(subtree(F.col("nodes"), a), test), key)


def join_child(dom: DataFrame, anchor: Test, test: Test, key: str = "page_id") -> DataFrame:
    return _pairs(dom, anchor, lambda a: children(F.col("nodes"), a, test), key)


def join_next(dom: DataFrame, anchor: Test, test: Test, key: str = "page_id") -> DataFrame:
    """Each anchor with the first matching node after its start; an anchor without one has no row.

    The matches cut the node array into consecutive pieces, and all anchors in the piece before a
    match belong to it, so each node is looked at once.
    """
    nodes = F.col("nodes")

    def piece(matches: Column) -> Column:
        def before(b: Column, k: Column) -> Column:
            begin = F.coalesce(F.get(matches, k - 1)["i"], F.lit(0))
            anchors = select(F.slice(nodes, begin + 1, b["i"] - begin), anchor)
            return F.transform(
                anchors, lambda a: F.struct(a["pre"].alias("a_pre"), b["pre"].alias("b_pre"))
            )

        return F.flatten(F.transform(matches, before))

    return dom.select(key, F.inline(let(select(nodes, test), piece)))


def join_sibling(dom: DataFrame, anchor: Test, test: Test, key: str = "page_id") -> DataFrame:
    """Each anchor with its first matching later sibling: a window over the children of one parent."""
    either = select(F.col("nodes"), lambda n: anchor(n) | test(n))
    flags = F.transform(
        either,
        lambda n: F.struct(
            n["pre"].alias("pre"),
            n["parent"].alias("parent"),
            F.coalesce(anchor(n), F.lit(False)).alias("is_a"),
            F.coalesce(test(n), F.lit(False)).alias("is_b"),
        ),
    )
    later = (
        Window.partitionBy(key, "parent")
        .orderBy(F.col("pre").desc())
        .rowsBetween(Window.unboundedPreceding, -1)
    )
    b_pre = F.last(F.when(F.col("is_b"), F.col("pre")), ignorenulls=True).over(later)
    return (
        dom.select(key, F.inline(flags))
        .withColumn("b_pre", b_pre)
        .where("is_a and b_pre is not null")
        .select(key, F.col("pre").alias("a_pre"), "b_pre")
    )
