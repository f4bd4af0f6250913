"""Registered queries: shredding, structural queries, layouts.

Layout pages are rendered from a row of a given table, shredded and read again; the oracle is the
relation the page was rendered from.
"""

from __future__ import annotations

import re

from pyspark.sql import Window
from pyspark.sql import functions as F

from tidemark.functions.shred import Keep
from tidemark.functions.text import hash_bucket
from tidemark.operators import dom as D
from tidemark.operators import extract as E
from tidemark.operators.layouts import homepage, moderators, sections
from tidemark.plans.registry import dealt, query, table


def fill(template: str, **columns):
    """Column for a template with {name} marks, its tags on indented lines as in real pages."""
    parts = []
    template = re.sub(r"><(?!!)", ">\n  <", template)
    for piece in re.split(r"(\{\w+\})", template):
        if piece.startswith("{"):
            parts.append(F.col(columns[piece[1:-1]]).cast("string"))
        elif piece:
            parts.append(F.lit(piece))
    return F.concat(*parts)


# Structural queries


@query(
    "html_shred",
    """select page_id, cast(i - 1 as int) as pos, replace(items[i], '&amp;', '&') as text from (
      select page_id, items, unnest(range(1, len(items) + 1)) as i from (
        select page_id, regexp_extract_all(html, '<li><a href="[^"]*">([^<]*)</a></li>', 1) as items from pages))""",
)
def html_shred(spark, sf_dir):
    dom = D.shred(table(spark, sf_dir, "pages").select("page_id", "html"))
    nodes, runs = F.col("nodes"), F.col("runs")
    links = D.select(nodes, D.tag("a"), lambda n: D.parent_of(nodes, n)["tag"] == "li")
    return dom.select(
        "page_id",
        F.posexplode(F.transform(links, lambda n: D.raw_text(runs, n))).alias("pos", "text"),
    )


@query(
    "html_shred_counts",
    """select page_id, tag, count(*) as n from (
      select page_id, lower(unnest(regexp_extract_all(
        regexp_replace(html, '<(script|style)([^>]*)>.*?</(script|style)>', '<\\1></\\1>', 'gs'),
        '<([a-zA-Z][a-zA-Z0-9]*)[ />]', 1))) as tag from pages) group by page_id, tag""",
)
def html_shred_counts(spark, sf_dir):
    dom = D.shred(table(spark, sf_dir, "pages").select("page_id", "html"))
    return D.dom_nodes(dom).groupBy("page_id", "tag").agg(F.count(F.lit(1)).alias("n"))


@query(
    "dom_text_agg",
    """select page_id, trim(replace(regexp_extract(html, '<h1>([^<]*)</h1>', 1), '&amp;', '&')) as text
    from pages where html like '%<h1>%'""",
)
def dom_text_agg(spark, sf_dir):
    dom = D.shred(table(spark, sf_dir, "pages").select("page_id", "html"), Keep(tags=("h1",), attrs=(), own=()))
    return D.dom_text_agg(dom, D.tag("h1")).select("page_id", "text")


def _tree(spark, sf_dir):
    """div > ul > p_size items with one link each; elements are numbered in a known way."""
    pages = dealt(table(spark, sf_dir, "part"), "p_partkey").select(
        F.col("p_partkey").alias("page_id"),
        F.concat(
            F.lit("<div><ul>"),
            F.expr("repeat('<li>x<a>y</a></li>', p_size)"),
            F.lit("</ul></div>"),
        ).alias("html"),
    )
    return D.shred(pages)


_ITEMS = "part, lateral (select unnest(range(0, cast(p_size as bigint))) as k)"


def _node_oracle(source: str, *values: str) -> str:
    names = ("pre", "last", "parent", "depth", "child_idx")
    numbers = [f"cast({v} as int) as {n}" for n, v in zip(names, values)]
    ends = [f"cast({v} as int) as {n}" for n, v in zip(("t0", "t1"), values[6:])]
    return f"select p_partkey as page_id, {', '.join(numbers)}, '{values[5]}' as tag, {', '.join(ends)} from {source}"


@query(
    "html_shred_nodes",
    " union all ".join(
        [
            _node_oracle("part", "0", "1 + 2 * p_size", "-1", "0", "1", "div", "0", "2 * p_size"),
            _node_oracle("part", "1", "1 + 2 * p_size", "0", "1", "1", "ul", "0", "2 * p_size"),
            _node_oracle(_ITEMS, "2 + 2 * k", "3 + 2 * k", "1", "2", "k + 1", "li", "2 * k", "2 * k + 2"),
            _node_oracle(_ITEMS, "3 + 2 * k", "3 + 2 * k", "2 + 2 * k", "3", "1", "a", "2 * k + 1", "2 * k + 2"),
        ]
    ),
)
def html_shred_nodes(spark, sf_dir):
    return D.dom_nodes(_tree(spark, sf_dir)).select(
        "page_id", "pre", "last", "parent", "depth", "child_idx", "tag", "t0", "t1"
    )


@query(
    "html_shred_text",
    f"""select p_partkey as page_id, cast(2 * k + o as int) as pos, case o when 0 then 'x' else 'y' end as text
    from {_ITEMS}, (values (0), (1)) v(o)""",
)
def html_shred_text(spark, sf_dir):
    return D.dom_text(_tree(spark, sf_dir))


@query(
    "join_dom_descendant",
    f"""select p_partkey as page_id, a as a_pre, cast(3 + 2 * k as int) as b_pre
    from {_ITEMS}, (values (0), (1)) v(a)""",
)
def join_dom_descendant(spark, sf_dir):
    return D.join_descendant(_tree(spark, sf_dir), D.tag("div", "ul"), D.tag("a"))


@query(
    "join_dom_child",
    f"select p_partkey as page_id, 1 as a_pre, cast(2 + 2 * k as int) as b_pre from {_ITEMS}",
)
def join_dom_child(spark, sf_dir):
    return D.join_child(_tree(spark, sf_dir), D.tag("div", "ul"), D.tag("li"))


@query(
    "join_dom_next",
    f"""select p_partkey as page_id, cast(2 + 2 * k as int) as a_pre, cast(4 + 2 * k as int) as b_pre
    from {_ITEMS} where k < p_size - 1
    union all select p_partkey, 1, 2 from part where p_size > 0""",
)
def join_dom_next(spark, sf_dir):
    return D.join_next(_tree(spark, sf_dir), D.tag("ul", "li"), D.tag("li"))


@query(
    "join_dom_sibling",
    f"""select p_partkey as page_id, cast(2 + 2 * k as int) as a_pre, cast(4 + 2 * k as int) as b_pre
    from {_ITEMS} where k < p_size - 1""",
)
def join_dom_sibling(spark, sf_dir):
    return D.join_sibling(_tree(spark, sf_dir), D.tag("ul", "li"), D.tag("li"))


# Moderator layouts: one page per order, two moderators

_MOD_HTML = {
    1: '<div data-testid="moderator"><p><a href="/x">no</a><a href="https://www.reddit.com/user/{cust}"> c{cust} </a></p>'
    '<span>about</span><span> {key} </span><time datetime="{date}">x</time></div>'
    '<div data-testid="moderator"><a href="/user/z">z<b>{key}</b></a><span>12.5</span></div>'
    '<div data-testid="moderator"><a href="/user/none"></a><span>3</span></div>',
    2: '<div id="moderator-table"><p>x</p><table><tr><th>head</th></tr><tr><td><a>nolink</a><a href="/u">c{cust}</a><b>{key}</b></td></tr>'
    '<tr><td><a href="">z<i>{key}</i></a> <b>+3</b></td></tr></table><tr><td><a href="/w">out</a></td></tr></div>',
    3: '<div class="side moderator-table"><table><tr><td><a href="/u">c <b>{cust}</b></a></td><td>{label}</td>'
    "<td><time>{date} ago</time></td></tr>"
    '<tr><td><a href="/z">z{key}</a></td><td><b>-{key}</b><b>9</b></td></tr></table><table><tr><td><a href="/w">out</a></td></tr></table></div>',
    4: '<div class="md"><p>c{cust} ({key})</p><p>bad (x)</p><p>a (1) (2)</p>(7) <br>z{key} ( -5 ))</div>'
    '<div class="md"><p>other (1)</p></div>',
}
# Permission markup by order priority: the four ways to find it, and none.
_PERMISSIONS = (
    "case substr(o_orderpriority, 1, 1) "
    "when '1' then concat('<span class=\"gray\"> ', o_orderstatus, ' </span>') "
    "when '2' then '<div class=\"permission-summary\"><span class=\"permission-bit\">posts </span><span class=\"permission-bit\">wiki</span></div>' "
    "when '3' then '<span class=\"gray\"></span><div class=\"permissions\"><div class=\"permission-summary\"><span class=\"permission-bit\">mail</span></div></div>' "
    "when '4' then concat('<input name=\"permissions\" value=\" +', o_orderstatus, ' \">') else '' end"
)
_PERMISSION_SQL = (
    "case substr(o_orderpriority, 1, 1) when '1' then o_orderstatus when '2' then 'posts, wiki' "
    "when '3' then 'mail' when '4' then concat('+', o_orderstatus) end"
)
_DAY = "strftime(o_orderdate, '%Y-%m-%d')"
_MOD_ROWS = {
    1: [
        (0, "concat('c', o_custkey)", "o_orderkey", "null", _DAY),
        (1, "concat('z', o_orderkey)", "null", "null", "null"),
    ],
    2: [
        (0, "concat('c', o_custkey)", "o_orderkey", "null", "null"),
        (1, "concat('z', o_orderkey)", "null", "null", "null"),
    ],
    3: [
        (0, "concat('c', o_custkey)", "o_custkey", _PERMISSION_SQL, f"concat({_DAY}, ' ago')"),
        (1, "concat('z', o_orderkey)", "-o_orderkey", "null", "null"),
    ],
    4: [
        (0, "concat('c', o_custkey)", "o_orderkey", "null", "null"),
        (1, "''", "7", "null", "null"),
        (2, "concat('z', o_orderkey)", "-5", "null", "null"),
    ],
}


def _mod_oracle(number: int) -> str:
    rows = [
        f"select o_orderkey as page_id, {number} as layout, {pos} as pos, {name} as username, "
        f"cast({karma} as bigint) as karma, cast({perm} as string) as permission, "
        f"cast({stamp} as string) as timestamp from orders"
        for pos, name, karma, perm, stamp in _MOD_ROWS[number]
    ]
    return " union all ".join(rows)


def moderator_pages(spark, sf_dir, number):
    orders = dealt(table(spark, sf_dir, "orders"), "o_orderkey").select(
        "o_orderkey",
        "o_custkey",
        F.date_format("o_orderdate", "yyyy-MM-dd").alias("day"),
        F.expr(_PERMISSIONS).alias("label"),
    )
    html = fill(_MOD_HTML[number], cust="o_custkey", key="o_orderkey", date="day", label="label")
    return orders.select(F.col("o_orderkey").alias("page_id"), html.alias("html"))


def _register_moderators(number):
    @query(f"mod_layout_{number}", _mod_oracle(number))
    def run(spark, sf_dir):
        dom = E.layout_dom(moderator_pages(spark, sf_dir, number))
        return E.moderator_rows(dom, "page_id")


for _n in _MOD_HTML:
    _register_moderators(_n)


@query(
    "mod_permission",
    f"""select o_orderkey as page_id, 0 as pos, {_PERMISSION_SQL} as permission from orders
    union all select o_orderkey, 1, null from orders union all select o_orderkey, 2, null from orders""",
)
def mod_permission(spark, sf_dir):
    dom = E.layout_dom(moderator_pages(spark, sf_dir, 3))
    nodes, runs = F.col("nodes"), F.col("runs")
    rows = D.select(nodes, D.tag("tr"))
    summaries = moderators.summaries_reach(nodes)
    found = D.let(
        summaries,
        lambda s: F.transform(rows, lambda r: moderators.permission(nodes, runs, D.subtree(nodes, r), s)),
    )
    return dom.select("page_id", F.posexplode(found).alias("pos", "permission"))


# Rule layouts: one page per part

_BOX7, _IN7 = homepage.CARD_CLASSES[7]
_BOX8, _IN8 = homepage.CARD_CLASSES[8]
_LIST = (
    "<li><p>Be <b>{name}</b></p><p>second</p></li><li>no paragraph</li>"
    "<li><div><p> {type} &amp; co </p></div></li>"
)
_LIST_TEXTS = ["concat('Be', p_name)", "concat(p_type, ' & co')"]


def _card(outer, inner):
    return (
        f'<div class="{" ".join(outer)} z"><p>t</p><div class="{" ".join(inner)}">{{name}}</div>'
        f'<div class="{" ".join(inner)}">second</div></div>'
        f'<div class="{outer[0]}"><div class="{" ".join(inner)}">half</div></div>'
        f'<div class="{" ".join(reversed(outer))}"><div><div class="{" ".join(inner)}">{{brand}}</div></div></div>'
    )


_HOME_HTML = {
    1: f"<form><div><div>{'<i></i>' * 6}<ul>{_LIST}</ul></div></div></form>",
    2: f"<form><div><div>{'<i></i>' * 9}<ul>{_LIST}</ul></div></div></form>",
    3: f"<form><p></p><div><div><p>x</p><ol>{_LIST}</ol></div></div></form>",
    4: "<h1>About</h1><h2>no</h2><h1>The RULES</h1><h2>{name}</h2><div><h2>{brand} <i>x</i></h2></div>"
    "<h2> </h2><h1>End</h1><h2>{type}</h2>",
    5: "<h1>Rules<!-- no --></h1><blockquote><p>wrong</p></blockquote><h1>Site rules</h1><p>x</p>"
    "<blockquote><p>{name} <b>{brand}</b></p><div><p>{type}</p></div><p></p></blockquote>",
    6: "<h1>Rules</h1><table><tr><th>head</th></tr><tr><td>{name}</td><td>{type}</td><td>z</td></tr>"
    "<tr><td>{brand}</td></tr></table>",
    7: _card(_BOX7, _IN7),
    8: _card(_BOX8, _IN8),
    9: "<ul><li>before</li></ul><h1>Our <b>rules</b></h1><p>x</p><div><ul><li>deep</li></ul></div>"
    "<ul><li>{name}</li><li></li><li>{brand}<p>{type}</p></li></ul><ul><li>later</li></ul>",
    10: "<h2>Our <i>rules</i></h2><ul><li>no</li></ul><div><ol><li>{name}<ol><li>{brand}</li></ol></li></ol></div>",
    11: "<div>1. {name}</div><div>3 {brand}</div><div><b>2</b>) {brand}</div><div>x<div> 4) {type}</div></div>"
    "<div>&nbsp;<span> </span><b>5. {name}</b></div><div>{name}<p>6. no</p></div>",
}
_HOME_TEXTS = {
    1: _LIST_TEXTS,
    2: _LIST_TEXTS,
    3: _LIST_TEXTS,
    4: ["p_name", "concat(p_brand, 'x')"],
    5: ["concat(p_name, ' ', p_brand)", "p_type"],
    6: ["concat(p_name, ' - ', p_type)", "p_brand"],
    7: ["p_name", "p_brand"],
    8: ["p_name", "p_brand"],
    9: ["p_name", "concat(p_brand, p_type)"],
    10: ["concat(p_name, p_brand)", "p_brand"],
    11: [
        "concat('1. ', p_name)", "concat('2) ', p_brand)", "concat('4) ', p_type)", "concat('5. ', p_name)",
    ],
}


def _rule_pages(spark, sf_dir, template):
    html = fill(template, name="p_name", brand="p_brand", type="p_type")
    return dealt(table(spark, sf_dir, "part"), "p_partkey").select(
        F.col("p_partkey").alias("page_id"), html.alias("html")
    )


def _texts_oracle(texts: list[str]) -> str:
    return " union all ".join(
        f"select p_partkey as page_id, {pos} as pos, {text} as title from part"
        for pos, text in enumerate(texts)
    )


def _register_homepage(number, case):
    @query(f"home_case_{number}", _texts_oracle(_HOME_TEXTS[number]))
    def run(spark, sf_dir):
        dom = E.layout_dom(_rule_pages(spark, sf_dir, _HOME_HTML[number]))
        texts = case(F.col("nodes"), F.col("runs"))
        return dom.select("page_id", F.posexplode(texts).alias("pos", "title"))


for _n, _case in homepage.CASES:
    _register_homepage(_n, _case)

_TABLE_HTML = (
    '<table><tr><td>out</td><td>out</td></tr></table><div class="md wiki"><h1>Hello</h1><h2>House Rules</h2><p>x</p>'
    "<table><tr><td>{name}</td><td>{type} <b>{brand}</b></td></tr><tr><td>one</td></tr>"
    "<tr><td>1</td><td>2</td><td>3</td></tr><tr><td>B</td><td></td></tr></table></div>"
)
_TABLE_PAIRS = [("p_name", "concat(p_type, ' ', p_brand)"), ("'B'", "''")]
_LIST_HTML = (
    '<div class="md"><h3>rule list</h3><ul><li><strong>{name}</strong> {type}, {name} too</li>'
    '<li><a href="#">{brand}</a> see <i>this</i></li><li>Plain text of {brand}</li><li>short</li>'
    "<li><p>x</p><ul><li><strong>inner</strong></li></ul></li></ul></div>"
)
_LIST_PAIRS = [
    ("p_name", "concat(p_type, ',  too')"),
    ("p_brand", "'see this'"),
    ("concat('Plain text of ', p_brand)", "''"),
    ("'inner'", "'x'"),
]
_SECTION = {
    "old_case_1": (
        sections.quoted,
        '<div class="md"><h1>Posting Rules</h1><p>none</p></div><div class="md"><p>x</p></div><div class="md"><h1>posting rules</h1>'
        "<blockquote><p>{name} <b>{brand}</b></p><div><p>deep</p></div><p></p><p>{type}</p></blockquote></div>",
        # The first heading finds the same quote, which lies in a later section.
        [("concat(p_name, ' ', p_brand)", "''"), ("p_type", "''")],
    ),
    "old_case_2": (sections.table_rows, _TABLE_HTML, _TABLE_PAIRS),
    "old_case_3": (sections.list_items, _LIST_HTML, _LIST_PAIRS),
    "old_case_4": (
        sections.any_list,
        '<div class="md"><h2>No <i>rules</i></h2></div><ol><li>outside</li></ol>'
        '<div class="md"><h3>The <i>rules</i></h3><ol><li>{name} <b>{brand}</b><ul><li>{type}</li></ul></li><li></li></ol></div>',
        [("concat(p_name, ' ', p_brand, ' ', p_type)", "''")],
    ),
    "wiki_case_1": (sections.table_rows, _TABLE_HTML, _TABLE_PAIRS),
    "wiki_case_2": (sections.list_items, _LIST_HTML, _LIST_PAIRS),
}


def _pairs_oracle(pairs) -> str:
    return " union all ".join(
        f"select p_partkey as page_id, {pos} as pos, {t} as title, {d} as description from part"
        for pos, (t, d) in enumerate(pairs)
    )


def _register_section(name, case, template, pairs):
    cases = sections.WIKI_CASES if name.startswith("wiki") else sections.OLD_CASES

    @query(name, _pairs_oracle(pairs))
    def run(spark, sf_dir):
        dom = E.layout_dom(_rule_pages(spark, sf_dir, template))
        if name.startswith("wiki"):
            rows = E.section_candidates(dom, cases, "page_id")
            return rows.select("page_id", "pos", "title", "description")
        rules = case(F.col("nodes"), F.col("runs"))
        return dom.select("page_id", F.posexplode(rules).alias("pos", "r")).select(
            "page_id", "pos", "r.title", "r.description"
        )


for _name, (_case, _template, _pairs) in _SECTION.items():
    _register_section(_name, _case, _template, _pairs)


# Choice of layout, numbering, grouping


def _case_rows(spark, sf_dir):
    """Candidate rows of several cases per page, from line items: page = order, case = line number."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page_id"),
        F.col("l_linenumber").alias("case_no"),
        F.when(F.col("l_returnflag") != "R", F.col("l_partkey")).alias("pos"),
        F.col("l_suppkey").alias("title"),
        (F.col("l_suppkey") % 3 == 0).alias("kept"),
    )


def _first_oracle(test: str, extra: str = "true") -> str:
    return f"""select page_id, case_no, pos, title, kept from (
      select *, min(case when {test} then case_no end) over (partition by page_id) as f from (
        select l_orderkey as page_id, l_linenumber as case_no,
          case when l_returnflag <> 'R' then l_partkey end as pos, l_suppkey as title,
          l_suppkey % 3 = 0 as kept from lineitem)) where case_no = f and {extra}"""


def _register_first(name, mode, oracle):
    @query(name, oracle)
    def run(spark, sf_dir):
        return E.first_layout(_case_rows(spark, sf_dir), "page_id", mode)


_register_first("win_first_layout", E.AFTER_SCORE, _first_oracle("kept"))
_register_first("win_first_layout_before_score", E.BEFORE_SCORE, _first_oracle("true"))
_register_first("win_first_layout_container", E.CONTAINER, _first_oracle("true", "pos is not null"))


def _rule_rows(spark, sf_dir):
    """Rules of a page from line items; titles repeat in other case."""
    return table(spark, sf_dir, "lineitem").select(
        F.col("l_orderkey").alias("page_id"),
        F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_quantity", "l_extendedprice").alias("pos"),
        F.when(F.col("l_linenumber") % 2 == 0, F.col("l_returnflag"))
        .otherwise(F.lower("l_returnflag"))
        .alias("title"),
        F.col("l_linestatus").alias("description"),
    )


_NUMBERED = """select *, row_number() over (partition by page_id order by n, p, s, q, e) as number from (
  select l_orderkey as page_id, l_linenumber as n, l_partkey as p, l_suppkey as s,
    l_quantity as q, l_extendedprice as e,
    case when l_linenumber % 2 = 0 then l_returnflag else lower(l_returnflag) end as title,
    l_linestatus as description from lineitem)"""


@query(
    "win_dedup_numbered",
    f"""select page_id, cast(number as int) as number, title, description from (
      select *, row_number() over (partition by page_id, lower(title), lower(description) order by number) as r
      from ({_NUMBERED})) where r = 1""",
)
def win_dedup_numbered(spark, sf_dir):
    return E.number_and_dedup(_rule_rows(spark, sf_dir), "page_id").select(
        "page_id", "number", "title", "description"
    )


@query(
    "agg_group_to_array",
    f"""select page_id, count(*) as n,
      string_agg(concat(cast(number as string), ':', title, '/', description), '|' order by number) as rules
    from ({_NUMBERED}) group by page_id""",
)
def agg_group_to_array(spark, sf_dir):
    numbered = _rule_rows(spark, sf_dir).withColumn(
        "number", F.row_number().over(Window.partitionBy("page_id").orderBy("pos"))
    )
    text = F.transform(
        "rules",
        lambda e: F.concat(
            e["number"].cast("string"), F.lit(":"), e["title"], F.lit("/"), e["description"]
        ),
    )
    return E.group_rules(numbered, "page_id").select(
        "page_id", F.size("rules").cast("bigint").alias("n"), F.array_join(text, "|").alias("rules")
    )


def md5_scorer(candidates):
    """Deterministic score of a text, the same in the oracle."""
    return candidates.withColumn("score", hash_bucket(F.col("score_text"), 7) / 100.0)


_SCORE = "cast(cast('0x' || substr(md5(concat({t}, ':7')), 1, 8) as bigint) % 100 as double) / 100"


@query(
    "filter_by_threshold",
    f"""select id, text, {_SCORE.format(t='text')} >= 0.105 as kept
    from (select p_partkey as id, concat(p_name, ' ', p_type) as text from part)""",
)
def filter_by_threshold(spark, sf_dir):
    rows = table(spark, sf_dir, "part").select(
        F.col("p_partkey").alias("id"),
        F.col("p_name").alias("title"),
        F.col("p_type").alias("description"),
    )
    scored = md5_scorer(rows.withColumn("score_text", E.scored_text()))
    return E.filter_by_threshold(scored).select("id", F.col("score_text").alias("text"), "kept")


_DISPATCH_HTML = (
    "case p_partkey % 5 "
    "when 0 then concat('<div id=\"moderator-table\"><table><tr><td><a href=\"/u\">', p_name, '</a><b>', p_size, '</b></td></tr></table></div>') "
    "when 1 then concat('<div class=\"md\"><h2>Rules</h2><ul><li><strong>', p_name, '</strong> ', p_type, '</li><li><strong>', upper(p_name), '</strong> ', p_type, '</li><li><a>', p_brand, '</a></li></ul></div>') "
    "when 2 then concat('<h1>Rules</h1><h2>', p_name, '</h2><h1>x</h1><blockquote><p>', p_brand, '</p></blockquote>') "
    "when 3 then concat('<div class=\"md\"><h1>Posting rules</h1><blockquote><p>', p_name, '</p><p>', p_type, '</p></blockquote></div>') "
    "else concat('<h1>Rules</h1><h2>', p_name, '</h2>') end"
)
_DISPATCH_URL = (
    "concat(case p_partkey % 5 when 3 then 'https://old.reddit.com' else 'https://www.reddit.com' end, '/r/c', "
    "cast(p_partkey as string), case p_partkey % 5 when 0 then '/about/moderators' when 1 then '/wiki/index' "
    "when 4 then '/comments/1' else '' end)"
)


def dispatch_pages(spark, sf_dir):
    return dealt(table(spark, sf_dir, "part"), "p_partkey").select(
        F.col("p_partkey").alias("page_id"),
        F.expr(_DISPATCH_URL).alias("original"),
        F.expr(_DISPATCH_HTML).alias("html"),
    )


_CANDIDATES = """
  select p_partkey as page_id, 'wiki' as kind, 1 as case_no, 0 as pos, p_name as title, p_type as description from part where p_partkey % 5 = 1
  union all select p_partkey, 'wiki', 1, 1, upper(p_name), p_type from part where p_partkey % 5 = 1
  union all select p_partkey, 'wiki', 1, 2, p_brand, '' from part where p_partkey % 5 = 1
  union all select p_partkey, 'homepage', 4, 0, p_name, null from part where p_partkey % 5 = 2
  union all select p_partkey, 'homepage', 5, 0, p_brand, null from part where p_partkey % 5 = 2
  union all select p_partkey, 'homepage_old', 1, 0, p_name, '' from part where p_partkey % 5 = 3
  union all select p_partkey, 'homepage_old', 1, 1, p_type, '' from part where p_partkey % 5 = 3"""

DISPATCH_ORACLE = f"""with cands as ({_CANDIDATES}),
  kept as (select * from cands where
    {_SCORE.format(t="trim(concat(title, ' ', coalesce(description, '')))")} >= 0.505),
  chosen as (select * from (select *, min(case_no) over (partition by page_id) as f from kept) where case_no = f),
  numbered as (select *, row_number() over (partition by page_id order by pos) as number from chosen),
  final as (select * from (select *, row_number() over (
      partition by page_id, lower(title), lower(coalesce(description, '')) order by number) as r from numbered)
    where r = 1 or kind = 'homepage')
  select page_id, 'rules' as target, count(*) as n,
    string_agg(concat(case when kind = 'homepage' then '' else cast(number as string) end, ':', title, '/',
      coalesce(description, '')), '|' order by pos) as body
  from final group by page_id
  union all select p_partkey, 'moderators', 1, concat(p_name, '/', cast(p_size as string)) from part
  where p_partkey % 5 = 0"""


def dispatch_rows(rules, mods):
    """Stored results of both targets as comparable text rows."""
    entry = F.transform(
        "rules",
        lambda e: F.concat(
            F.coalesce(e["number"].cast("string"), F.lit("")),
            F.lit(":"),
            e["title"],
            F.lit("/"),
            F.coalesce(e["description"], F.lit("")),
        ),
    )
    who = F.transform(
        "moderators", lambda m: F.concat(m["username"], F.lit("/"), m["karma"].cast("string"))
    )
    left = rules.select(
        "page_id",
        F.lit("rules").alias("target"),
        F.size("rules").cast("bigint").alias("n"),
        F.array_join(entry, "|").alias("body"),
    )
    right = mods.select(
        "page_id",
        F.lit("moderators").alias("target"),
        F.size("moderators").cast("bigint").alias("n"),
        F.array_join(who, "|").alias("body"),
    )
    return left.unionByName(right)


@query("extract_dispatch", DISPATCH_ORACLE)
def extract_dispatch(spark, sf_dir):
    pages = dispatch_pages(spark, sf_dir)
    out = E.extract(pages, "page_id", md5_scorer, 0.505)
    return dispatch_rows(out.rules, out.moderators)


@query(
    "extract_quarantine",
    """select p_partkey as page_id, true as has_error from part
    where p_partkey % 5 <> 4 and p_size % 7 = 0""",
)
def extract_quarantine(spark, sf_dir):
    """Pages without readable HTML among those of a known type."""
    pages = dispatch_pages(spark, sf_dir).join(
        table(spark, sf_dir, "part").select(F.col("p_partkey").alias("page_id"), "p_size"), "page_id"
    )
    pages = pages.withColumn("html", F.when(F.col("p_size") % 7 != 0, F.col("html")))
    found = E.extract(pages, "page_id", md5_scorer, 0.505).quarantine
    return found.select("page_id", F.col("parse_error").isNotNull().alias("has_error"))


@query(
    "result_shape",
    """select p_partkey as page_id, case p_partkey % 5 when 0 then 'moderators' else 'rules' end as target
    from part where p_partkey % 5 <> 4""",
)
def result_shape(spark, sf_dir):
    pages = dispatch_pages(spark, sf_dir)
    out = E.extract(pages, "page_id", md5_scorer, 0.0)
    return dispatch_rows(out.rules, out.moderators).select("page_id", "target")
