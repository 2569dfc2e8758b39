"""Markdown with annotations, parsed to flat node rows in one Arrow stage.

The parser covers the CommonMark blocks and inlines behind the node kinds below, with
tables, strikethrough, footnotes and task marks, and heading attributes. A footnote's
definition is a Paragraph that holds its blocks, and a reference to it is left out. Trees
come out as rows in pre-order: node_id, parent_id, depth, and `last_id`, the greatest id
below a node, so a subtree is a range of ids and later stages never recurse. Annotated
nodes and headings carry the text below them, so no stage joins it to them.
"""

from __future__ import annotations

import html
import json
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quillgraph.functions.iri import BUILTIN_PREFIXES
from quillgraph.sources.attributes import ANNOTATIONS, BLOCK_DIRECTIVE, INLINE_DIRECTIVE, LINK_PREFIX, annotation, classify, resolve_name, tokenize

NODES = (
    "doc_id string, node_id int, parent_id int, last_id int, depth int, kind string, level int, attr_id string, name string, language string, "
    f"content string, list_start long, text string, dest string, title string, annotations {ANNOTATIONS}, text_content string"
)
DIRECTIVES = "doc_id string, seq int, directive_id string, name string, content string, attrs_raw string, is_block boolean"
HEADERS = "doc_id string, doc_type string, template string, title string, context string, prefixes map<string,string>, extra string, content string"

#: Bytes a core is worth: inputs of fewer are dealt to all cores.
SPLIT_BYTES = 64 << 20

_INLINE, _BLOCK, _PREFIX = re.compile(INLINE_DIRECTIVE), re.compile(BLOCK_DIRECTIVE), re.compile(LINK_PREFIX)
_FRONT = re.compile(r"\A---[ \t]*\r?\n(.*?)^---[ \t]*(?:\r?\n|\Z)", re.S | re.M)


@dataclass
class Node:
    kind: str
    children: list[Node] = field(default_factory=list)
    annotations: list[dict] = field(default_factory=list)
    values: dict = field(default_factory=dict)


def json_value(value):
    """YAML values as JSON ones: numbers that aren't finite are null, keys are text, dates are text."""
    if isinstance(value, dict):
        return {str(k): json_value(v) for k, v in value.items()}
    if isinstance(value, list | tuple | set):
        return [json_value(v) for v in value]
    if isinstance(value, float) and value - value != 0:
        return None
    return value if value is None or isinstance(value, bool | int | float | str) else str(value)


def split_header(source: str) -> tuple[dict, str]:
    """(header fields, content). A header that isn't a YAML mapping counts as empty."""
    m = _FRONT.match(source)
    if not m:
        return {}, source
    import yaml

    try:
        found = yaml.load(m[1], Loader=getattr(yaml, "CSafeLoader", yaml.SafeLoader))
    except yaml.YAMLError:
        found = None
    if not isinstance(found, dict):
        found = {}
    given = found.get("prefixes")
    if any(not isinstance(found.get(k), str | None) for k in ("@type", "template", "title")) or not isinstance(given, dict | None):
        return {}, source[m.end() :]
    known = {"@context", "prefixes", "@type", "template", "title"}
    out = {"doc_type": found.get("@type"), "template": found.get("template"), "title": found.get("title"), "context": found.get("@context")}
    out["prefixes"] = {str(k): str(v) for k, v in (given or {}).items()}
    out["extra"] = {str(k): json_value(v) for k, v in found.items() if k not in known}
    return out, source[m.end() :]


@dataclass
class Directive:
    name: str
    content: str
    attrs: str | None
    is_block: bool


def extract_directives(content: str) -> tuple[list, list[tuple[str, str]], list[Directive]]:
    """(lines and block marks, prefixes, directives in order). Blocks don't nest and run to a line `:::` or to the end."""
    out: list = []
    prefixes: list[tuple[str, str]] = []
    found: list[Directive] = []
    rows = content.split("\n")
    if rows and rows[-1] == "":
        rows.pop()
    it = iter(r.removesuffix("\r") for r in rows)
    for line in it:
        if m := _PREFIX.match(line):
            prefixes.append((m[1], m[2]))
            out.append(line)
        elif m := _BLOCK.match(line):
            body = []
            for inner in it:
                if inner.strip() == ":::":
                    break
                body.append(inner)
            found.append(Directive(m[1], "\n".join(body), m[2], True))
            out += [("open", len(found) - 1), "", *body, "", ("close", len(found) - 1)]
        else:
            while m := _INLINE.search(line):
                found.append(Directive(m[1], m[2], m[3], False))
                # Private-use characters stand for the ends of a span until inlines are parsed.
                line = f"{line[: m.start()]}\ue000{len(found) - 1}\ue001{m[2]}\ue002{line[m.end() :]}"
            out.append(line)
    return out, prefixes, found


def link_prefixes(content: str) -> list[tuple[str, str]]:
    """The prefixes of `extract_directives` alone."""
    out: list[tuple[str, str]] = []
    it = iter(r.removesuffix("\r") for r in content.split("\n"))
    for line in it:
        if m := _PREFIX.match(line):
            out.append((m[1], m[2]))
        elif _BLOCK.match(line):
            for inner in it:
                if inner.strip() == ":::":
                    break
    return out


# Blocks -----------------------------------------------------------------------------------------

_ATX = re.compile(r" {0,3}(#{1,6})(?:[ \t]+(.*?))?(?:[ \t]+#+)?[ \t]*$")
_FENCE = re.compile(r"( {0,3})(`{3,}|~{3,})[ \t]*([^`]*|(?<=~)[^\n]*)$")
_RULE = re.compile(r" {0,3}(?:(?:\*[ \t]*){3,}|(?:-[ \t]*){3,}|(?:_[ \t]*){3,})$")
_ITEM = re.compile(r"( {0,3})([-+*]|\d{1,9}[.)])(?:([ \t]+)|$)")
_QUOTE = re.compile(r" {0,3}> ?")
_DELIMITER_ROW = re.compile(r" {0,3}\|?[ \t]*:?-+:?[ \t]*(?:\|[ \t]*:?-+:?[ \t]*)*\|?[ \t]*$")
_LINK_DEF = re.compile(r" {0,3}\[([^\]\n]+)\]:[ \t]*(?:<([^>\n]*)>|(\S+))(?:[ \t]+(?:\"([^\"]*)\"|'([^']*)'|\(([^)]*)\)))?[ \t]*$")
_FOOTNOTE = re.compile(r" {0,3}\[\^([^\]\s\[]+)\]:[ \t]*(.*)$")
_HTML_BLOCK = re.compile(r" {0,3}<(?:!--|\?|![A-Za-z]|/?(?:address|article|aside|blockquote|body|details|dialog|dd|div|dl|dt|fieldset|figure|footer|form|h[1-6]|head|header|hr|html|li|link|main|menu|nav|ol|p|section|summary|table|tbody|td|tfoot|th|thead|title|tr|ul|script|pre|style|textarea)(?=[\s/>]|$))", re.I)
_HEADING_ATTRS = re.compile(r"[ \t]*\{([^{}]*)\}[ \t]*$")


class Parser:
    """Builds the tree of one document."""

    def __init__(self, directives: list[Directive], prefixes: dict[str, str]):
        self.directives, self.prefixes = directives, prefixes
        self.references: dict[str, tuple[str, str]] = {}
        self.footnotes: set[str] = set()

    def blocks(self, rows: list) -> list[Node]:
        for line in rows:
            if isinstance(line, str) and (m := _FOOTNOTE.match(line)):
                self.footnotes.add(m[1].lower())
            elif isinstance(line, str) and (m := _LINK_DEF.match(line)):
                self.references.setdefault(" ".join(m[1].lower().split()), (m[2] if m[2] is not None else m[3], m[4] or m[5] or m[6] or ""))
        return self._blocks(rows)

    def _blocks(self, rows: list, tight: bool = False) -> list[Node]:
        out: list[Node] = []
        at = 0
        while at < len(rows):
            line = rows[at]
            if isinstance(line, tuple):
                # A directive block reaches to its own close mark.
                end = next((i for i in range(at + 1, len(rows)) if rows[i] == ("close", line[1])), len(rows))
                if line[0] == "open":
                    out.append(self._directive_block(line[1], rows[at + 1 : end]))
                    at = end
                at += 1
            elif not line.strip():
                at += 1
            elif m := _FOOTNOTE.match(line):
                at = self._footnote(rows, at, m, out)
            elif (m := _LINK_DEF.match(line)) and self.references.get(" ".join(m[1].lower().split())) is not None:
                at += 1
            elif m := _FENCE.match(line):
                at = self._fenced(rows, at, m, out)
            elif line[:4].strip(" ") == "" and len(line) >= 4 or line.startswith("\t"):
                at = self._indented(rows, at, out)
            elif m := _ATX.match(line):
                out.append(self._heading(len(m[1]), m[2] or ""))
                at += 1
            elif _RULE.match(line):
                out.append(Node("Rule"))
                at += 1
            elif _QUOTE.match(line):
                at = self._quote(rows, at, out)
            elif _ITEM.match(line):
                at = self._list(rows, at, out)
            elif _HTML_BLOCK.match(line):
                at = self._html(rows, at, out)
            elif "|" in line and at + 1 < len(rows) and isinstance(rows[at + 1], str) and _DELIMITER_ROW.match(rows[at + 1]) and len(cells(line)) == len(cells(rows[at + 1])):
                at = self._table(rows, at, out)
            else:
                at = self._paragraph(rows, at, out, tight)
        return out

    def _directive_block(self, k: int, rows: list) -> Node:
        d = self.directives[k]
        notes = classify(tokenize(d.attrs), self.prefixes) if d.attrs is not None else []
        if ":" in d.name:
            notes.insert(0, annotation("type", resolve_name(d.name, self.prefixes), d.name))
        return Node("DirectiveBlock", self._blocks(rows), notes, {"name": d.name})

    def _heading(self, level: int, text: str) -> Node:
        node = Node("Section", values={"level": level})
        if m := _HEADING_ATTRS.search(text):
            tokens = tokenize(m[1])
            ids = [n for k, n, _ in tokens if k == "id"]
            node.values["attr_id"] = ids[-1] if ids else None
            # Classes come before keys, whatever their order is; a bare word is a key without value.
            bare = set(m[1].split())
            classes = [t for t in tokens if t[0] == "class" and f".{t[1]}" in bare]
            keys = [("key", n, v or "") for k, n, v in tokens if k == "key" or (k == "class" and f".{n}" not in bare)]
            node.annotations = classify(classes + keys, self.prefixes, external=False)
            text = text[: m.start()]
        node.children = self.inlines(text.strip())
        return node

    def _fenced(self, rows: list, at: int, m: re.Match, out: list[Node]) -> int:
        body, indent, fence = [], len(m[1]), m[2]
        close = re.compile(rf" {{0,3}}{re.escape(fence[0])}{{{len(fence)},}}[ \t]*$")
        at += 1
        while at < len(rows):
            line = rows[at]
            if isinstance(line, tuple):
                break
            at += 1
            if close.match(line):
                break
            body.append(line[min(indent, len(line) - len(line.lstrip(" "))) :])
        out.append(Node("CodeBlock", values={"language": html.unescape(m[3].strip()) or None, "content": plain("".join(b + "\n" for b in body))}))
        return at

    def _indented(self, rows: list, at: int, out: list[Node]) -> int:
        body = []
        while at < len(rows) and isinstance(rows[at], str) and (not rows[at].strip() or rows[at].startswith(("    ", "\t"))):
            body.append(rows[at][1:] if rows[at].startswith("\t") else rows[at][4:])
            at += 1
        while body and not body[-1].strip():
            body.pop()
        out.append(Node("CodeBlock", values={"language": None, "content": plain("".join(b + "\n" for b in body))}))
        return at

    def _quote(self, rows: list, at: int, out: list[Node]) -> int:
        body = []
        while at < len(rows) and isinstance(rows[at], str):
            if m := _QUOTE.match(rows[at]):
                body.append(rows[at][m.end() :])
            elif rows[at].strip() and body and body[-1].strip() and not starts_block(rows[at]):
                body.append(rows[at])  # a paragraph may go on without the mark
            else:
                break
            at += 1
        out.append(Node("BlockQuote", self._blocks(body)))
        return at

    def _footnote(self, rows: list, at: int, m: re.Match, out: list[Node]) -> int:
        """A definition goes on in a paragraph's further lines, and in what is indented by four."""
        body = [m[2]]
        at += 1
        while at < len(rows) and isinstance(rows[at], str):
            line = rows[at]
            if not line.strip():
                after = next((r for r in rows[at:] if not isinstance(r, str) or r.strip()), None)
                if not (isinstance(after, str) and after.startswith(("    ", "\t"))):
                    break
                body.append("")
            elif line.startswith(("    ", "\t")):
                body.append(line[1:] if line.startswith("\t") else line[4:])
            elif body[-1].strip() and not starts_block(line) and not _FOOTNOTE.match(line) and not _ITEM.match(line):
                body.append(line)
            else:
                break
            at += 1
        out.append(Node("Paragraph", self._blocks(body)))
        return at

    def _list(self, rows: list, at: int, out: list[Node]) -> int:
        first = _ITEM.match(rows[at])
        mark = first[2][-1]
        items: list[list] = []
        loose = False
        while at < len(rows) and isinstance(rows[at], str):
            m = _ITEM.match(rows[at])
            if not m or m[2][-1] != mark or _RULE.match(rows[at]):
                break
            gap = len(m[3] or "")
            indent = len(m[1]) + len(m[2]) + (gap if 0 < gap <= 4 else 1)
            body, blank = [rows[at][indent:] if m[3] else ""], False
            at += 1
            while at < len(rows) and isinstance(rows[at], str):
                line = rows[at]
                if not line.strip():
                    blank = True
                    body.append("")
                elif len(line) - len(line.lstrip(" ")) >= indent:
                    loose |= blank and bool(body[:-1] or body[0])
                    blank = False
                    body.append(line[indent:])
                elif not blank and not starts_block(line) and not _ITEM.match(line):
                    body.append(line.lstrip())
                else:
                    break
                at += 1
            while body and not body[-1].strip():
                body.pop()
            items.append(body)
            if blank and at < len(rows) and isinstance(rows[at], str) and (n := _ITEM.match(rows[at])) and n[2][-1] == mark:
                loose = True
        start = int(first[2][:-1]) if first[2][:-1] else None
        out.append(Node("List", [Node("Item", self._blocks([re.sub(r"^\[[ xX]\] ", "", i[0]), *i[1:]] if i else [], tight=not loose)) for i in items], values={"list_start": start}))
        return at

    def _html(self, rows: list, at: int, out: list[Node]) -> int:
        line = rows[at]
        comment = line.lstrip().startswith("<!--")
        while at < len(rows) and isinstance(rows[at], str):
            line = rows[at]
            if not comment and not line.strip():
                break
            out.append(Node("Html", values={"content": plain(line) + "\n"}))
            at += 1
            if comment and "-->" in line:
                break
        return at

    def _table(self, rows: list, at: int, out: list[Node]) -> int:
        width = len(cells(rows[at]))
        make = lambda kind, line: Node(kind, [Node("TableCell", self.inlines(c)) for c in (cells(line) + [""] * width)[:width]])
        table = Node("Table", [make("TableHead", rows[at])])
        at += 2
        while at < len(rows) and isinstance(rows[at], str) and rows[at].strip() and not starts_block(rows[at]):
            table.children.append(make("TableRow", rows[at]))
            at += 1
        out.append(table)
        return at

    def _paragraph(self, rows: list, at: int, out: list[Node], tight: bool) -> int:
        body = [rows[at].lstrip()]
        at += 1
        while at < len(rows) and isinstance(rows[at], str) and rows[at].strip():
            if m := re.match(r" {0,3}(=+|-+)[ \t]*$", rows[at]):
                out.append(self._heading(1 if m[1][0] == "=" else 2, "\n".join(body)))
                return at + 1
            if starts_block(rows[at]) or _FOOTNOTE.match(rows[at]) or ((m := _ITEM.match(rows[at])) and m[3] and m[2] in ("-", "+", "*", "1.", "1)")):
                break
            body.append(rows[at].lstrip())
            at += 1
        inner = self.inlines("\n".join(body).rstrip())
        if tight:
            out += inner
        elif inner:
            out.append(Node("Paragraph", inner))
        return at

    # Inlines ------------------------------------------------------------------------------------

    _SCAN = re.compile(
        r"\\(?P<escape>[!-/:-@\[-`{-~])|(?P<hard>(?: {2,}|\\)\n[ ]*)|(?P<soft>[ ]?\n[ ]*)|(?P<ticks>`+)"
        r"|<(?P<auto>[A-Za-z][A-Za-z0-9+.-]{1,31}:[^\s<>]*|[\w.+-]+@[\w-]+(?:\.[\w-]+)+)>"
        r"|(?P<tag></?[A-Za-z][A-Za-z0-9-]*(?:\s+[A-Za-z_:][\w.:-]*(?:\s*=\s*(?:[^\s\"'=<>`]+|'[^']*'|\"[^\"]*\"))?)*\s*/?>|<!--.*?-->|<\?.*?\?>|<![A-Z]+\s[^>]*>)"
        r"|(?P<entity>&(?:#[0-9]{1,7}|#[xX][0-9a-fA-F]{1,6}|[A-Za-z][A-Za-z0-9]{1,31});)"
        r"|(?P<note>\[\^[^\]\s\[]+\])|(?P<open>!?\[)|(?P<close>\])|(?P<run>\*+|_+|~+)|\ue000(?P<span>\d+)\ue001|(?P<span_end>\ue002)",
        re.S,
    )

    def inlines(self, text: str) -> list[Node]:
        """Nodes of inline text: one pass makes leaves and delimiter marks, then pairs of marks close around what is between them."""
        items: list = []  # nodes, and lists [kind, text, ...] of marks that may pair
        at, plain_text = 0, []

        def flush() -> None:
            if plain_text:
                items.append(Node("Text", values={"text": "".join(plain_text)}))
                plain_text.clear()

        while m := self._SCAN.search(text, at):
            plain_text.append(text[at : m.start()])
            at = m.end()
            kind = m.lastgroup
            if kind == "escape":
                plain_text.append(m["escape"])
            elif kind == "entity":
                plain_text.append(html.unescape(m["entity"]))
            elif kind == "ticks":
                end = re.compile(rf"(?<!`){m['ticks']}(?!`)").search(text, at)
                if end:
                    flush()
                    code = text[at : end.start()].replace("\n", " ")
                    code = code[1:-1] if code.startswith(" ") and code.endswith(" ") and code.strip() else code
                    items.append(Node("InlineCode", values={"text": plain(code)}))
                    at = end.end()
                else:
                    plain_text.append(m[0])
            elif kind in ("hard", "soft"):
                flush()
                items.append(Node("HardBreak" if kind == "hard" else "SoftBreak"))
            elif kind == "auto":
                flush()
                dest = m["auto"] if ":" in m["auto"] else f"mailto:{m['auto']}"
                items.append(Node("Link", [Node("Text", values={"text": m["auto"]})], values={"dest": dest, "title": ""}))
            elif kind == "tag":
                flush()
                items.append(Node("Html", values={"content": plain(m["tag"])}))
            elif kind == "note":
                flush()
                if m["note"][2:-1].lower() not in self.footnotes:
                    # No footnote: a bracket like any other.
                    at = m.start() + 1
                    items.append(["[", "["])
            elif kind == "open":
                flush()
                items.append(["[", m["open"]])
            elif kind == "close":
                flush()
                at = self._link(items, text, at)
            elif kind == "run":
                flush()
                before, after = text[m.start() - 1 : m.start()] or " ", text[at : at + 1] or " "
                left = not after.isspace() and (not mark_like(after) or before.isspace() or mark_like(before))
                right = not before.isspace() and (not mark_like(before) or after.isspace() or mark_like(after))
                if m["run"][0] == "_":
                    left, right = left and (not right or mark_like(before)), right and (not left or mark_like(after))
                items.append(["run", m["run"], left, right, len(m["run"])])
            elif kind == "span":
                flush()
                items.append(["span", "", int(m["span"])])
            else:
                flush()
                start = next((i for i in range(len(items) - 1, -1, -1) if isinstance(items[i], list) and items[i][0] == "span"), None)
                if start is not None:
                    d = self.directives[items[start][2]]
                    notes = classify(tokenize(d.attrs), self.prefixes) if d.attrs is not None else []
                    items[start:] = [Node("InlineDirective", pair_runs(items[start + 1 :]), notes, {"name": d.name})]
        plain_text.append(text[at:])
        flush()
        return pair_runs(items)

    def _link(self, items: list, text: str, at: int) -> int:
        start = next((i for i in range(len(items) - 1, -1, -1) if isinstance(items[i], list) and items[i][0] == "["), None)
        if start is None:
            items.append(Node("Text", values={"text": "]"}))
            return at
        mark = items[start][1]
        m = re.compile(r"\(\s*(?:<([^<>\n]*)>|((?:[^\s()\\]|\\.|\([^\s()]*\))*))(?:\s+(?:\"((?:[^\"\\]|\\.)*)\"|'((?:[^'\\]|\\.)*)'|\(([^()]*)\)))?\s*\)").match(text, at)
        if m:
            found, at_end = (m[1] if m[1] is not None else m[2], m[3] or m[4] or m[5] or ""), m.end()
        else:
            label = re.compile(r"\[([^\[\]]*)\]").match(text, at)
            inner = text_of_items(items[start + 1 :])
            name = label[1] if label and label[1] else inner
            found, at_end = self.references.get(" ".join(name.lower().split())), label.end() if label else at
        if found is None:
            items[start] = Node("Text", values={"text": mark})
            items.append(Node("Text", values={"text": "]"}))
            return at
        unescape = lambda s: html.unescape(re.sub(r"\\([!-/:-@\[-`{-~])", r"\1", s))
        items[start:] = [Node("Image" if mark == "![" else "Link", pair_runs(items[start + 1 :]), values={"dest": unescape(found[0]), "title": unescape(found[1])})]
        if mark == "[":
            for i in items[:start]:
                if isinstance(i, list) and i[0] == "[" and i[1] == "[":
                    i[0] = "text"  # links hold no links
        return at_end


def mark_like(c: str) -> bool:
    import unicodedata

    return unicodedata.category(c)[0] in "PS"


def starts_block(line: str) -> bool:
    return bool(_ATX.match(line) or _FENCE.match(line) or _RULE.match(line) or _QUOTE.match(line) or _HTML_BLOCK.match(line))


def cells(line: str) -> list[str]:
    parts = re.split(r"(?<!\\)\|", line.strip())
    if parts and not parts[0].strip():
        parts = parts[1:]
    if parts and not parts[-1].strip():
        parts = parts[:-1]
    return [p.strip().replace("\\|", "|") for p in parts]


def plain(text: str) -> str:
    """In code and raw HTML a directive is seen as the span that stands for it: extraction knows no code fences."""
    if "\ue000" not in text:
        return text
    return re.sub("\ue000(\\d+)\ue001", lambda m: f'<span data-sd="SD{int(m[1]) + 1:04d}">', text).replace("\ue002", "</span>")


def text_of_items(items: list) -> str:
    return "".join(i[1] if isinstance(i, list) else text_content(i) for i in items)


def text_content(node: Node) -> str:
    """Text of Text nodes below a node; code and breaks have none."""
    return node.values["text"] if node.kind == "Text" else "".join(map(text_content, node.children))


def pair_runs(items: list) -> list[Node]:
    """Emphasis, strong and strikethrough: each closing run takes the nearest run that can open it; what is left is text."""
    k = 0
    while k < len(items):
        it = items[k]
        if not (isinstance(it, list) and it[0] == "run" and it[3]):
            k += 1
            continue
        c = it[1][0]

        def opens(o, it=it, c=c) -> bool:
            if not (isinstance(o, list) and o[0] == "run" and o[1][:1] == c and o[2]):
                return False
            if c == "~":
                return len(o[1]) == len(it[1]) <= 2
            return not ((o[3] or it[2]) and (o[4] + it[4]) % 3 == 0 and (o[4] % 3 or it[4] % 3))

        start = next((i for i in range(k - 1, -1, -1) if opens(items[i])), None)
        if start is None:
            k += 1
            continue
        n = len(it[1]) if c == "~" else 2 if len(it[1]) >= 2 and len(items[start][1]) >= 2 else 1
        node = Node("Strikethrough" if c == "~" else "Strong" if n == 2 else "Emphasis", loose_marks(items[start + 1 : k]))
        items[start][1], it[1] = items[start][1][n:], it[1][n:]
        keep_left, keep_right = [items[start]] if items[start][1] else [], [it] if it[1] else []
        items[start : k + 1] = [*keep_left, node, *keep_right]
        k = start + len(keep_left) + 1
    return loose_marks(items)


def loose_marks(items: list) -> list[Node]:
    """Marks that paired with nothing are text; texts side by side are one."""
    out: list[Node] = []
    for i in items:
        node = i if isinstance(i, Node) else Node("Text", values={"text": i[1]})
        if node.kind == "Text" and out and out[-1].kind == "Text":
            out[-1] = Node("Text", values={"text": out[-1].values["text"] + node.values["text"]})
        elif node.kind != "Text" or node.values["text"]:
            out.append(node)
    return out


@dataclass
class Document:
    header: dict
    prefixes: dict[str, str]
    directives: list[Directive]
    nodes: list[Node]


def parse_text(source: str) -> Document:
    header, content = split_header(source)
    rows, linked, directives = extract_directives(content)
    prefixes = dict(sorted((BUILTIN_PREFIXES | header.get("prefixes", {}) | dict(linked)).items()))
    return Document(header, prefixes, directives, Parser(directives, prefixes).blocks(rows))


def node_rows(doc_id: str, nodes: list[Node]) -> list[tuple]:
    """Rows of NODES in pre-order, by an explicit stack: trees may be deep."""
    out: list[list] = []
    todo = [(n, None, 0, False) for n in reversed(nodes)]
    while todo:
        node, parent, depth, done = todo.pop()
        if done:
            out[parent][3] = len(out) - 1
            continue
        v = node.values
        mine = len(out)
        text = v.get("text")
        out.append([doc_id, mine, parent, mine, depth, node.kind, v.get("level"), v.get("attr_id"), v.get("name"), v.get("language"), v.get("content"), v.get("list_start"), text, v.get("dest"), v.get("title"), node.annotations, text_content(node) if node.annotations or node.kind == "Section" else None])
        todo.append((node, mine, depth, True))
        todo += [(c, mine, depth + 1, False) for c in reversed(node.children)]
    return [tuple(r) for r in out]


_COLUMNS = [c.strip().split()[0] for c in NODES.split(f", annotations {ANNOTATIONS}")[0].split(",")] + ["annotations", "text_content"]


def spread(docs: DataFrame) -> DataFrame:
    """A small input, which may be one split, dealt to all cores by row; a large one has splits enough and stays as it is."""
    spark = docs.sparkSession
    cores = spark.sparkContext.defaultParallelism
    size = int(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())
    return docs.repartition(cores) if size <= cores * SPLIT_BYTES else docs


def parse_documents(docs: DataFrame) -> DataFrame:
    """Node rows of documents (doc_id, source): one narrow Arrow stage; a null source has no nodes."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [r for d, s in zip(batch["doc_id"], batch["source"]) if s is not None for r in node_rows(d, parse_text(s).nodes)]
            frame = pd.DataFrame(rows, columns=_COLUMNS)
            for c in ("parent_id", "level", "list_start"):
                frame[c] = frame[c].astype("Int64")
            yield frame

    return spread(docs.select(F.col("doc_id").cast("string"), F.col("source").cast("string"))).mapInPandas(run, NODES)


def parse_headers(docs: DataFrame) -> DataFrame:
    """One row per document: header fields, all its prefixes (built-in, then header, then link references), content."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for d, s in zip(batch["doc_id"], batch["source"]):
                header, content = split_header(s or "")
                linked = link_prefixes(content)
                js = lambda v: None if v is None else json.dumps(json_value(v), sort_keys=True, ensure_ascii=False)
                rows.append((d, header.get("doc_type"), header.get("template"), header.get("title"), js(header.get("context")), BUILTIN_PREFIXES | header.get("prefixes", {}) | dict(linked), js(header.get("extra", {})), content))
            yield pd.DataFrame(rows, columns=["doc_id", "doc_type", "template", "title", "context", "prefixes", "extra", "content"])

    return spread(docs.select(F.col("doc_id").cast("string"), F.col("source").cast("string"))).mapInPandas(run, HEADERS)


def extract_all_directives(docs: DataFrame) -> DataFrame:
    """Directives of documents (doc_id, content) in order, numbered over blocks and inlines together."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = [(d, k, f"SD{k + 1:04d}", x.name, x.content, x.attrs, x.is_block) for d, c in zip(batch["doc_id"], batch["content"]) for k, x in enumerate(extract_directives(c or "")[2])]
            yield pd.DataFrame(rows, columns=["doc_id", "seq", "directive_id", "name", "content", "attrs_raw", "is_block"])

    return spread(docs.select(F.col("doc_id").cast("string"), F.col("content").cast("string"))).mapInPandas(run, DIRECTIVES)


def text_contents(nodes: DataFrame) -> DataFrame:
    """(doc_id, node_id, text_content) of annotated nodes and headings."""
    return nodes.where((F.size("annotations") > 0) | (F.col("kind") == "Section")).select("doc_id", "node_id", "text_content")
