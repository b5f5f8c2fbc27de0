"""Per-page HTML reading used inside Spark tasks: a flat node table and a small selector subset.

Only what rules need: tag, ``.class``, ``#id``, ``[a]``, ``[a=v]``, ``[a*=v]``, ``[a^=v]``,
``[a$=v]``, descendant, child and comma. A part of a list that is anything else matches nothing and is
named by :func:`selector_gaps`; the other parts of the list still match.
"""

from __future__ import annotations

import re
from bisect import bisect_left, bisect_right
from functools import lru_cache
from html.parser import HTMLParser

VOID_TAGS = frozenset("area base br col embed hr img input link meta source track wbr".split())
HIDDEN_TAGS = frozenset(["script", "style", "template"])
CLOSED_BY = {
    "li": ({"li"}, {"ul", "ol"}), "option": ({"option"}, {"select"}), "tr": ({"tr", "td", "th"}, {"table"}),
    "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}),
    "dt": ({"dt", "dd"}, {"dl"}), "dd": ({"dt", "dd"}, {"dl"}),
}
P_ENDERS = frozenset("p div ul ol dl table section article footer header nav form h1 h2 h3 h4 h5 h6 address".split())
P_SCOPES = {"div", "td", "th", "li", "article", "section", "body", "footer", "header", "nav", "form", "dd"}


class Page(HTMLParser):
    """Nodes in document order; node ``i`` spans nodes ``i..last[i]`` and its own slice of texts."""

    def __init__(self, html: str, url: str = ""):
        self.source, self.url, self.error, self._index = html, url, None, None
        try:
            self._read(html)
        except AssertionError as problem:
            # The parser gives up on unknown marked sections; read as comments of the same length they do no harm.
            self.error = f"markup: {problem}"
            self._read(html.replace("<![", "<!?"))

    def _read(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        self.tags, self.attrs, self.parent, self.last = ["#page"], [{}], [-1], [0]
        self.text_from, self.text_to, self.texts = [0], [0], []
        self.span = [[0, len(html)]]
        self._open, self._lines = [0], [0]
        self._lines += [m.end() for m in re.finditer("\n", html)]
        self.feed(html)
        self.close()
        self._close_to(0)
        self._end(0, len(html))

    def _offset(self) -> int:
        line, column = self.getpos()
        return self._lines[line - 1] + column

    def _end(self, node: int, offset: int) -> None:
        self.last[node], self.text_to[node], self.span[node][1] = len(self.tags) - 1, len(self.texts), offset

    def _close_to(self, depth: int, offset: int | None = None) -> None:
        while len(self._open) > max(depth, 1):
            self._end(self._open.pop(), len(self.source) if offset is None else offset)

    def _close_open(self, names: set, scopes: set) -> None:
        for depth in range(len(self._open) - 1, 0, -1):
            tag = self.tags[self._open[depth]]
            if tag in names:
                return self._close_to(depth, self._offset())
            if tag in scopes:
                return None

    def handle_starttag(self, tag, attrs):
        if tag in CLOSED_BY:
            self._close_open(*CLOSED_BY[tag])
        if tag in P_ENDERS:
            self._close_open({"p"}, P_SCOPES)
        node, start = len(self.tags), self._offset()
        self.tags.append(tag)
        self.attrs.append({k: v or "" for k, v in attrs})
        self.parent.append(self._open[-1])
        self.last.append(node)
        self.text_from.append(len(self.texts))
        self.text_to.append(len(self.texts))
        self.span.append([start, start + len(self.get_starttag_text() or "")])
        if tag not in VOID_TAGS:
            self._open.append(node)

    def handle_startendtag(self, tag, attrs):
        self.handle_starttag(tag, attrs)
        if tag not in VOID_TAGS:
            self._end(self._open.pop(), self.span[-1][1])

    def handle_endtag(self, tag):
        for depth in range(len(self._open) - 1, 0, -1):
            if self.tags[self._open[depth]] == tag:
                close = self.source.find(">", self._offset())
                return self._close_to(depth, close + 1 if close >= 0 else None)

    def handle_data(self, data):
        top = self._open[-1]
        if self.tags[top] in HIDDEN_TAGS:
            self.attrs[top]["#code"] = self.attrs[top].get("#code", "") + data
        elif data.strip():
            self.texts.append(data.strip())

    def text(self, node: int) -> str:
        return " ".join(self.texts[self.text_from[node]:self.text_to[node]])

    def outer(self, node: int) -> str:
        return self.source[self.span[node][0]:self.span[node][1]]

    def _is(self, node: int, test) -> bool:
        tag, checks = test
        if tag and self.tags[node] != tag:
            return False
        attrs = self.attrs[node]
        for name, how, wanted in checks:
            value = attrs.get(name)
            if value is None or (how == "~" and wanted not in value.split()) or (how == "=" and value != wanted):
                return False
            if (how == "*=" and not (wanted and wanted in value)) or (how == "^=" and not (wanted and value.startswith(wanted))) \
                    or (how == "$=" and not (wanted and value.endswith(wanted))):
                return False
        return True

    def _fits(self, node: int, chain) -> bool:
        if not self._is(node, chain[-1][1]):
            return False
        if len(chain) == 1:
            return True
        child_only, above = chain[-1][0] == ">", self.parent[node]
        while above > 0:
            if self._fits(above, chain[:-1]):
                return True
            if child_only:
                return False
            above = self.parent[above]
        return False

    def _candidates(self, test, scope: int):
        """Nodes under ``scope`` that have the tag of a test, or else its first attribute, in document order."""
        tag, checks = test
        if not (tag or checks):
            return range(scope + 1, self.last[scope] + 1)
        if self._index is None:
            self._index = {}
            for node, (name, attrs) in enumerate(zip(self.tags, self.attrs)):
                self._index.setdefault(name, []).append(node)
                for attr in attrs:
                    self._index.setdefault(("attr", attr), []).append(node)
        nodes = self._index.get(tag or ("attr", checks[0][0]), ())
        return nodes[bisect_left(nodes, scope + 1):bisect_right(nodes, self.last[scope])]

    def select(self, selector: str, scope: int = 0):
        """Matching nodes under ``scope`` in document order, as a generator."""
        chains = parse_selector(selector)
        found = [nodes for nodes in (self._candidates(chain[-1][1], scope) for chain in chains) if nodes]
        for node in found[0] if len(found) == 1 else sorted(set().union(*found)):
            if any(self._fits(node, chain) for chain in chains):
                yield node

    def first(self, selector: str, scope: int = 0) -> int | None:
        return next(self.select(selector, scope), None)


_PART = re.compile(r"\.([\w-]+)|#([\w-]+)|\[\s*([\w:-]+)\s*(?:([*^$]?=)\s*(?:\"([^\"]*)\"|'([^']*)'|([^\]\s]*)))?\s*\]")
_STEP = re.compile(r"\s*(>?)\s*([a-zA-Z][\w-]*|\*)?((?:\.[\w-]+|#[\w-]+|\[(?:\"[^\"]*\"|'[^']*'|[^\]\"'])*\])*)")


def selector_gaps(selector: str) -> list[str]:
    """The parts of a selector list that are not understood."""
    return [g.strip() for g in _groups(selector) if g.strip() and not parse_selector(g)]


def _groups(selector: str) -> list[str]:
    return re.split(r",(?![^\[]*\])", selector or "")


@lru_cache(maxsize=4096)
def parse_selector(selector: str) -> tuple:
    """Comma-separated chains of (combinator, (tag, attribute tests)); parts that are not understood are left out."""
    chains = []
    for group in _groups(selector):
        steps, at, group = [], 0, group.strip()
        while at < len(group):
            step = _STEP.match(group, at)
            if step.end() == at or not (step.group(2) or step.group(3)):
                steps = []
                break
            checks = []
            for cls, ident, attr, how, *values in _PART.findall(step.group(3)):
                if cls:
                    checks.append(("class", "~", cls))
                elif ident:
                    checks.append(("id", "=", ident))
                else:
                    checks.append((attr.lower(), how, next((v for v in values if v), "")))
            tag = (step.group(2) or "").lower()
            steps.append((step.group(1), ("" if tag == "*" else tag, tuple(checks))))
            at = step.end()
        if steps:
            chains.append(tuple(steps))
    return tuple(chains)
