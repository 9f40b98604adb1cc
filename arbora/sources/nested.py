"""Tree sources other than the IR: node tables, HTML, JSON values, text, parent-child rows.

Each gives the IR's text, so that every tree goes through the same kernels: an element or object is an Lprim of its
name over its children, a piece of text or a value an Lconst or an Lvar of its content.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from arbora.functions.irtree import Node, print_tree

#: Elements without an end tag.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}


class _Dom(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.stack: list[tuple[str, list]] = [("document", [])]

    def _close(self):
        name, kids = self.stack.pop()
        self.stack[-1][1].append(Node("Lprim", name, kids, ["arg"] * len(kids)))

    def handle_starttag(self, tag, attrs):
        self.stack.append((tag, []))
        if tag in VOID:
            self._close()

    def handle_startendtag(self, tag, attrs):
        self.stack.append((tag, []))
        self._close()

    def handle_endtag(self, tag):
        if any(name == tag for name, _ in self.stack[1:]):
            while self.stack[-1][0] != tag:
                self._close()
            self._close()

    def handle_data(self, data):
        if data.strip():
            self.stack[-1][1].append(Node("Lvar", data.strip()))


def html_tree(text: str) -> Node:
    """Elements nest as written; unknown end tags are ignored, open elements closed at the end."""
    dom = _Dom()
    dom.feed(text)
    dom.close()
    while len(dom.stack) > 1:
        dom._close()
    name, kids = dom.stack[0]
    return Node("Lprim", name, kids, ["arg"] * len(kids))


def json_tree(value) -> Node:
    """Objects by sorted key, arrays in order; scalars are variables of their JSON text."""
    if isinstance(value, dict):
        kids = [Node("Lprim", k, [json_tree(v)], ["arg"]) for k, v in sorted(value.items())]
        return Node("Lprim", "object", kids, ["arg"] * len(kids))
    if isinstance(value, list):
        kids = [json_tree(v) for v in value]
        return Node("Lprim", "array", kids, ["arg"] * len(kids))
    return Node("Lvar", json.dumps(value))


def text_tree(text: str) -> Node:
    """Document, lines, tokens; blank lines are left out."""
    lines = []
    for line in text.split("\n"):
        words = [Node("Lvar", w) for w in line.split()]
        if words:
            lines.append(Node("Lprim", "line", words, ["arg"] * len(words)))
    return Node("Lprim", "text", lines, ["arg"] * len(lines))


def _json_text(text: str) -> Node:
    return json_tree(json.loads(text))


#: Parsers by kind of source.
TREE_OF = {"html": html_tree, "json": _json_text, "text": text_tree}


def with_tree(df: DataFrame, column: str, kind: str, out: str = "ir") -> DataFrame:
    """df plus the IR text of the tree in a column; kind is html, json or text. Null or malformed input gives null."""
    make = TREE_OF[kind]
    names, at = df.columns, df.columns.index(column)

    def one(text):
        if text is None:
            return None
        try:
            return print_tree(make(text))
        except (ValueError, RecursionError):
            return None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array([one(t) for t in b.column(at).to_pylist()], pa.string())], [*names, out])

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    return df.mapInArrow(run, f"{schema}, `{out}` string")


def trees_from_nodes(nodes: DataFrame) -> DataFrame:
    """(tree_id, ir) from a node table (tree_id, node_id, parent_id, ord, role, kind, payload, case_key).

    One group per tree: a tree is what a kernel must hold anyway."""

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["parent_id", "ord"], na_position="first")
        kids: dict = {}
        for r in pdf.itertuples():
            kids.setdefault(None if pd.isna(r.parent_id) else int(r.parent_id), []).append(r)
        made: dict[int, Node] = {}
        stack = [(r, False) for r in kids.get(None, [])]
        while stack:
            r, ready = stack.pop()
            below = kids.get(int(r.node_id), [])
            if not ready:
                stack.append((r, True))
                stack.extend((x, False) for x in below)
                continue
            roles = [(x.role or "") + (f":{x.case_key}" if x.case_key is not None and not pd.isna(x.case_key) else "") for x in below]
            made[int(r.node_id)] = Node(r.kind, r.payload or "", [made[int(x.node_id)] for x in below], roles)
        root = kids.get(None)
        return pd.DataFrame({"tree_id": [pdf["tree_id"].iloc[0]], "ir": [print_tree(made[int(root[0].node_id)]) if root else None]})

    return nodes.groupBy("tree_id").applyInPandas(build, "tree_id string, ir string")


def lines_of(docs: DataFrame, key: str, text: str) -> DataFrame:
    """(key, ord, line): the lines of a text, line ends of either kind."""
    parts = F.split(F.regexp_replace(F.col(text), "\r\n?", "\n"), "\n", -1)
    return docs.select(F.col(key), F.posexplode(parts).alias("ord", "line"))
