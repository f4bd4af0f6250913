"""HTML to nodes: the one step that runs in Python workers (Arrow in, Arrow out).

A page becomes a row of two arrays: ``runs`` (its text runs in document order) and ``nodes`` (its
elements in document order). Everything that reads a layout is a column expression over these.
"""

from __future__ import annotations

import re
from collections.abc import Collection, Iterator
from html.entities import html5
from html.parser import HTMLParser
from itertools import accumulate
from operator import attrgetter
from typing import NamedTuple

import pyarrow as pa

# Fixed values of lenient HTML parsing: elements without content, elements whose text is not page
# text, elements that keep their white space.
VOID_TAGS = frozenset(
    "area base basefont bgsound br col command embed frame hr image img input isindex keygen link "
    "menuitem meta nextid param source spacer track wbr".split()
)
HIDDEN_TEXT_TAGS = frozenset("script style template rt rp".split())
KEEP_SPACE_TAGS = frozenset("pre textarea".split())
SPECIAL_TEXT_TAGS = HIDDEN_TEXT_TAGS | KEEP_SPACE_TAGS
RAW_TEXT_TAGS = frozenset(
    "script style textarea title xmp iframe noembed noframes noscript plaintext".split()
)
# Tags in their plainest form are read in runs with one match each, together with the text up to the next
# markup; an empty match ends the run. All other markup is left to the library's parser.
_TAG = re.compile(r"<(/?[a-zA-Z][^<>&]*)>([^<&]*)|")
_PLAIN = re.compile(
    r"/([a-zA-Z][a-zA-Z0-9]*)"
    r'|([a-zA-Z][a-zA-Z0-9]*)((?:\s+[a-zA-Z][-a-zA-Z0-9_]*="[^"<>&]*")*)\s*(/?)'
)
_MEMO, _MEMO_TAG = 10_000, 200  # tags remembered, characters of the longest
_PLAIN_ATTR = re.compile(r'([a-zA-Z][-a-zA-Z0-9_]*)="([^"]*)"')
_ASCII_SPACE = " \n\t\f\r"

NODE_FIELDS = [
    ("i", pa.int32()),  # position in the nodes array
    ("j", pa.int32()),  # position of the last node inside this one
    ("up", pa.int32()),  # position of the parent, -1 when it is not in the array
    ("pre", pa.int32()),  # document order over all elements
    ("last", pa.int32()),  # greatest pre inside this element
    ("parent", pa.int32()),  # pre of the parent, -1 at the top
    ("depth", pa.int32()),
    ("child_idx", pa.int32()),  # 1-based position among element siblings
    ("tag", pa.string()),
    ("attrs", pa.map_(pa.string(), pa.string())),
    ("classes", pa.list_(pa.string())),
    ("own", pa.string()),  # own string: set when the content is a single text chain
    ("t0", pa.int32()),  # text runs t0 <= k < t1 lie inside this element
    ("t1", pa.int32()),
]
_DDL = {pa.int32(): "int", pa.string(): "string"}


def node_ddl(fields: Collection[str] | None = None) -> str:
    """Spark type of the nodes array."""
    parts = []
    for name, kind in NODE_FIELDS:
        if fields is None or name in fields:
            ddl = {"attrs": "map<string,string>", "classes": "array<string>"}.get(name) or _DDL[kind]
            parts.append(f"{name}:{ddl}")
    return f"array<struct<{','.join(parts)}>>"


class _Tags(dict):
    """What stands between < and > of a plain tag, remembered for the tags of late: (opens, closes, name,
    attributes); ``None`` for tags that are left to the library's parser."""

    def __missing__(self, inner: str) -> tuple | None:
        value = self._read(inner)
        if len(inner) <= _MEMO_TAG:
            if len(self) >= _MEMO:
                self.clear()
            self[inner] = value
        return value

    @staticmethod
    def _read(inner: str) -> tuple | None:
        found = _PLAIN.fullmatch(inner)
        if found is None:
            return None
        end, name, attrs, closed = found.groups()
        if end:
            return False, True, end.lower(), ()
        name = name.lower()
        if name in RAW_TEXT_TAGS:
            return None
        pairs = tuple((k.lower(), v) for k, v in _PLAIN_ATTR.findall(attrs)) if attrs else ()
        return True, bool(closed) or name in VOID_TAGS, name, pairs


_TAGS = _Tags()


class _Node:
    """An element while its page is read."""

    __slots__ = (
        "pre", "last", "parent", "depth", "child_idx", "tag", "attrs", "own", "t0", "t1",
        "kids", "elements", "only",
    )

    def __init__(self, pre, parent, depth, child_idx, tag, attrs, t0):
        self.pre = self.last = pre
        self.parent, self.depth, self.child_idx = parent, depth, child_idx
        self.tag, self.attrs, self.own = tag, attrs, None
        self.t0 = self.t1 = t0
        self.kids = self.elements = 0  # children of any kind, element children
        self.only = None  # the first child: a string or a node


class Shredder(HTMLParser):
    """Builds the node list of one page. End tags close the nearest open element of their name."""

    def __init__(self):
        super().__init__(convert_charrefs=False)
        self.nodes, self.runs, self.pending = [], [], []
        self.stack = [_Node(-1, -1, -1, 0, "", (), 0)]
        self.open_names, self.closed_void = {}, {}
        self.hidden = self.spaced = 0  # open elements that hide text, or keep white space

    def _child(self, item) -> None:
        top = self.stack[-1]
        top.kids += 1
        if top.kids == 1:
            top.only = item

    def _flush(self) -> None:
        pending = self.pending
        if not pending:
            return
        text = pending[0] if len(pending) == 1 else "".join(pending)
        self.pending = []
        if not text:
            return
        if text[0] in _ASCII_SPACE and not self.spaced and not text.strip(_ASCII_SPACE):
            text = "\n" if "\n" in text else " "
        top = self.stack[-1]
        top.kids += 1
        if top.kids == 1:
            top.only = text
        if not self.hidden:
            self.runs.append(text)

    def _mark(self, text: str) -> None:
        """Comments and declarations split text and count as content, but are not page text."""
        self._flush()
        self._child(text)

    def _close_top(self) -> None:
        node = self.stack.pop()
        tag = node.tag
        self.open_names[tag] -= 1
        if tag in SPECIAL_TEXT_TAGS:
            self.hidden -= tag in HIDDEN_TEXT_TAGS
            self.spaced -= tag in KEEP_SPACE_TAGS
        node.last = len(self.nodes) - 1
        node.t1 = len(self.runs)
        if node.kids == 1:
            only = node.only
            node.own = only if isinstance(only, str) else only.own

    def _start(self, tag, attrs) -> None:
        if self.pending:
            self._flush()
        parent = self.stack[-1]
        parent.elements += 1
        node = _Node(
            len(self.nodes), parent.pre, parent.depth + 1, parent.elements, tag, attrs, len(self.runs)
        )
        parent.kids += 1
        if parent.kids == 1:
            parent.only = node
        self.nodes.append(node)
        self.stack.append(node)
        self.open_names[tag] = self.open_names.get(tag, 0) + 1
        if tag in SPECIAL_TEXT_TAGS:
            self.hidden += tag in HIDDEN_TEXT_TAGS
            self.spaced += tag in KEEP_SPACE_TAGS

    def _end(self, tag) -> None:
        if self.pending:
            self._flush()
        while self.open_names.get(tag):
            name = self.stack[-1].tag
            self._close_top()
            if name == tag:
                break

    def updatepos(self, i, j):
        return j  # line numbers are not needed

    def _plain_run(self, i):
        """Handle plain tags and their texts from ``i`` on; returns where the first other markup starts.

        The common steps of ``_flush``, ``_start`` and ``_close_top`` are written out here.
        """
        nodes, runs, stack, open_names = self.nodes, self.runs, self.stack, self.open_names
        text, self.pending = "".join(self.pending), []
        for match in _TAG.finditer(self.rawdata, i):
            inner, after = match.groups()
            found = _TAGS[inner] if inner else None
            if found is None:
                self.pending = [text] if text else []
                return match.start()
            opens, closes, tag, attrs = found
            top = stack[-1]
            if text:
                if text[0] in _ASCII_SPACE and not self.spaced and not text.strip(_ASCII_SPACE):
                    text = "\n" if "\n" in text else " "
                top.kids += 1
                if top.kids == 1:
                    top.only = text
                if not self.hidden:
                    runs.append(text)
            if tag in SPECIAL_TEXT_TAGS or opens and closes:
                if not opens:
                    self.handle_endtag(tag)
                elif inner[-1] == "/":
                    self.handle_startendtag(tag, attrs)
                else:
                    self.handle_starttag(tag, attrs)
            elif opens:
                top.elements += 1
                top.kids += 1
                node = _Node(len(nodes), top.pre, top.depth + 1, top.elements, tag, attrs, len(runs))
                if top.kids == 1:
                    top.only = node
                nodes.append(node)
                stack.append(node)
                open_names[tag] = open_names.get(tag, 0) + 1
            elif top.tag == tag and tag not in VOID_TAGS:
                del stack[-1]
                open_names[tag] -= 1
                top.last = len(nodes) - 1
                top.t1 = len(runs)
                if top.kids == 1:
                    only = top.only
                    top.own = only if isinstance(only, str) else only.own
            else:
                self.handle_endtag(tag)
            text = after

    def parse_starttag(self, i):
        k = self._plain_run(i)
        return k if k > i else super().parse_starttag(i)

    def parse_endtag(self, i):
        k = i if self.cdata_elem else self._plain_run(i)
        return k if k > i else super().parse_endtag(i)

    def handle_starttag(self, tag, attrs):
        self._start(tag, attrs)
        if tag in VOID_TAGS:
            self._end(tag)
            self.closed_void[tag] = self.closed_void.get(tag, 0) + 1

    def handle_startendtag(self, tag, attrs):
        self._start(tag, attrs)
        self._end(tag)

    def handle_endtag(self, tag):
        if self.closed_void.get(tag):
            self.closed_void[tag] -= 1
        else:
            self._end(tag)

    def handle_data(self, data):
        self.pending.append(data)

    def handle_entityref(self, name):
        self.pending.append(html5.get(name + ";") or html5.get(name) or "&" + name)

    def handle_charref(self, name):
        try:
            code = int(name[1:], 16) if name[:1] in "xX" else int(name)
            if code < 256:
                text = bytes([code]).decode("windows-1252", errors="ignore") or chr(code)
            else:
                text = chr(code)
            text.encode("utf-8")
        except (ValueError, OverflowError):
            text = "\N{REPLACEMENT CHARACTER}"
        self.pending.append(text)

    def handle_comment(self, data):
        self._mark(data)

    def handle_decl(self, decl):
        self._mark(decl)

    def handle_pi(self, data):
        self._mark(data)

    def unknown_decl(self, data):
        self._flush()
        if data.upper().startswith("CDATA["):
            self._child(data[6:])
            self.runs.append(data[6:])
        else:
            self._child(data)

    def finish(self):
        self.close()
        self._flush()
        while len(self.stack) > 1:
            self._close_top()
        return self.nodes, self.runs


def read_page(html: str | None) -> tuple[list[_Node], list[str], str | None]:
    """(nodes, runs, error) of one page; a page that cannot be read gives its error, not a failure."""
    if html is None:
        return [], [], "no page"
    parser = Shredder()
    try:
        parser.feed(html)
        nodes, runs = parser.finish()
    except Exception as exc:  # one bad page must not stop the job
        return [], [], f"{type(exc).__name__}: {exc}"
    return nodes, runs, None


class Keep(NamedTuple):
    """What a job needs of the nodes; ``None`` stands for everything."""

    tags: Collection[str] | None = None
    attrs: Collection[str] | None = None
    own: Collection[str] | None = None  # elements whose own string is needed
    fields: Collection[str] | None = None


class _Columns:
    """Flat columns of a batch of pages, turned into nested Arrow arrays at once."""

    def __init__(self, keep: "Keep"):
        self.keep_tags, self.keep_attrs, self.keep_own = keep.tags, keep.attrs, keep.own
        self.fields = [f for f in NODE_FIELDS if keep.fields is None or f[0] in keep.fields]
        self.flat = {n: [] for n, _ in self.fields if n not in ("attrs", "classes")}
        self.node_ends, self.run_ends = [0], [0]
        self.attr_ends, self.attr_keys, self.attr_values = [0], [], []
        self.class_ends, self.class_names = [0], []
        self.runs, self.errors = [], []

    def add(self, html: str | None) -> None:
        nodes, runs, error = read_page(html)
        keep = self.keep_tags
        kept = nodes if keep is None else [n for n in nodes if n.tag in keep]
        # Number of kept nodes up to and including each node; the extra last item stands for "no parent".
        upto = list(accumulate([keep is None or n.tag in keep for n in nodes]))
        place = [-1] * (len(nodes) + 1)
        for at, node in enumerate(kept):
            place[node.pre] = at
        own = self.keep_own
        for name, column in self.flat.items():
            if name == "i":
                column.extend(range(len(kept)))
            elif name == "j":
                column.extend([upto[n.last] - 1 for n in kept])
            elif name == "up":
                column.extend([place[n.parent] for n in kept])
            elif name == "own" and own is not None:
                column.extend([n.own if n.tag in own else None for n in kept])
            else:
                column.extend(map(attrgetter(name), kept))
        for node in kept:
            if node.attrs:
                values = dict(node.attrs)
                for name, value in values.items():
                    if self.keep_attrs is None or name in self.keep_attrs:
                        self.attr_keys.append(name)
                        self.attr_values.append(value or "")
                self.class_names.extend((values.get("class") or "").split())
            self.attr_ends.append(len(self.attr_keys))
            self.class_ends.append(len(self.class_names))
        self.node_ends.append(self.node_ends[-1] + len(kept))
        self.runs.extend(runs)
        self.run_ends.append(len(self.runs))
        self.errors.append(error)

    def arrays(self) -> list[pa.Array]:
        offsets = lambda ends: pa.array(ends, pa.int32())
        children = []
        for name, kind in self.fields:
            if name == "attrs":
                column = pa.MapArray.from_arrays(
                    offsets(self.attr_ends),
                    pa.array(self.attr_keys, pa.string()),
                    pa.array(self.attr_values, pa.string()),
                )
            elif name == "classes":
                column = pa.ListArray.from_arrays(
                    offsets(self.class_ends), pa.array(self.class_names, pa.string())
                )
            else:
                column = pa.array(self.flat[name], kind)
            children.append(column)
        nodes = pa.StructArray.from_arrays(children, fields=[pa.field(n, k) for n, k in self.fields])
        return [
            pa.ListArray.from_arrays(offsets(self.node_ends), nodes),
            pa.ListArray.from_arrays(offsets(self.run_ends), pa.array(self.runs, pa.string())),
            pa.array(self.errors, pa.string()),
        ]


def shred_batches(
    batches: Iterator[pa.RecordBatch],
    keep: Keep,
    html_per_batch: int = 16 << 20,
) -> Iterator[pa.RecordBatch]:
    """Arrow batches with column ``html`` replaced by ``nodes``, ``runs`` and ``parse_error``.

    A result batch is closed after a fixed amount of HTML, so memory does not grow with page size.
    """
    for batch in batches:
        at = batch.schema.get_field_index("html")
        others = [n for n in batch.schema.names if n != "html"]
        html = batch.column(at)
        start, size, columns = 0, 0, _Columns(keep)
        for row in range(batch.num_rows):
            page = html[row].as_py()
            columns.add(page)
            size += len(page or "")
            if size >= html_per_batch or row == batch.num_rows - 1:
                part = batch.slice(start, row + 1 - start)
                values = [part.column(part.schema.get_field_index(n)) for n in others]
                yield pa.RecordBatch.from_arrays(
                    values + columns.arrays(), others + ["nodes", "runs", "parse_error"]
                )
                start, size, columns = row + 1, 0, _Columns(keep)
