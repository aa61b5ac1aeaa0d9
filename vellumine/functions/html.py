"""HTML to text by walking tags, for structure that patterns can't see. Arrow UDFs over stdlib parsing."""

from __future__ import annotations

import html
from html.parser import HTMLParser

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

VOID = frozenset("area base br col embed hr img input link meta source track wbr".split())


class _Node:
    def __init__(self, tag: str, parent: _Node | None):
        self.tag, self.parent, self.children = tag, parent, []

    def text(self) -> str:
        return "".join(c if isinstance(c, str) else c.text() for c in self.children)

    def all(self, *tags: str) -> list[_Node]:
        found = []
        for c in self.children:
            if isinstance(c, _Node):
                found += [c] * (c.tag in tags) + c.all(*tags)
        return found

    def become(self, text: str) -> None:
        self.children = [text]


class _Tree(HTMLParser):
    def __init__(self):
        super().__init__(convert_charrefs=True)
        self.root = self.at = _Node("", None)

    def handle_starttag(self, tag, attrs):
        node = _Node(tag, self.at)
        self.at.children.append(node)
        if tag not in VOID:
            self.at = node

    def handle_startendtag(self, tag, attrs):
        self.at.children.append(_Node(tag, self.at))

    def handle_endtag(self, tag):
        node = self.at
        while node is not self.root and node.tag != tag:
            node = node.parent
        if node is not self.root:  # an end tag without a start changes nothing
            self.at = node.parent

    def handle_data(self, data):
        self.at.children.append(data)


def parse(text: str) -> _Node:
    tree = _Tree()
    tree.feed(text)
    tree.close()
    return tree.root


def structured_text(text: str) -> str:
    """Headings get hashes, list items markers, strong and emphasised text stars; other tags go.

    Numbers of ordered lists run on through nested ones; marked text loses markup inside it.
    """
    root = parse(text)
    for level in range(1, 7):
        for node in root.all(f"h{level}"):
            node.become(f"{'#' * level} {node.text()}")
    for node in root.all("ul"):
        for item in node.all("li"):
            item.become(f"- {item.text()}")
    for node in root.all("ol"):
        for i, item in enumerate(node.all("li"), 1):
            item.become(f"{i}. {item.text()}")
    for node in root.all("strong", "b"):
        node.become(f"**{node.text()}**")
    for node in root.all("em", "i"):
        node.become(f"*{node.text()}*")
    return root.text()


@F.pandas_udf(StringType())
def html_text(texts: pd.Series) -> pd.Series:
    """Text without tags."""
    return texts.map(lambda t: parse(t).text(), na_action="ignore")


@F.pandas_udf(StringType())
def html_unescape(texts: pd.Series) -> pd.Series:
    return texts.map(html.unescape, na_action="ignore")


@F.pandas_udf(StringType())
def html_structure(texts: pd.Series) -> pd.Series:
    """``structured_text``, stripped."""
    return texts.map(lambda t: structured_text(t).strip(), na_action="ignore")
