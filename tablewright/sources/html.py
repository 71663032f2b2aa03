"""HTML to tables and paragraphs, with the standard library's parser.

``extract_tables`` and ``extract_paragraphs`` run over pages with
``mapInArrow``: a page that fails gives a row with ``error`` instead of failing
the job.  Everything after them is relational."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from dataclasses import dataclass, field
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Elements without content.
VOID = {"area", "base", "br", "col", "embed", "hr", "img", "input", "link", "meta", "source", "track", "wbr"}
#: What opening one of these closes (the open elements up to the boundary).
CLOSES = {"tr": ({"tr", "td", "th"}, {"table"}), "td": ({"td", "th"}, {"tr", "table"}), "th": ({"td", "th"}, {"tr", "table"}), "p": ({"p"}, {"div", "td", "th", "body", "li", "article", "section"}), "li": ({"li"}, {"ul", "ol"})}


@dataclass
class Node:
    name: str
    attrs: dict[str, str] = field(default_factory=dict)
    parent: Node | None = None
    children: list[Node | str] = field(default_factory=list)

    def classes(self) -> list[str]:
        return self.attrs.get("class", "").split()

    def walk(self) -> Iterator[Node]:
        """All elements below, in document order, without recursion."""
        stack = [c for c in reversed(self.children) if isinstance(c, Node)]
        while stack:
            node = stack.pop()
            yield node
            stack += [c for c in reversed(node.children) if isinstance(c, Node)]

    def find(self, *names: str) -> list[Node]:
        return [n for n in self.walk() if n.name in names]

    def text(self) -> str:
        out: list[str] = []
        stack: list[Node | str] = list(reversed(self.children))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
            else:
                stack += reversed(x.children)
        return "".join(out)

    def only_string(self) -> str | None:
        """The one string below a chain of only children."""
        node: Node = self
        while len(node.children) == 1:
            (x,) = node.children
            if isinstance(x, str):
                return x
            node = x
        return None

    def before(self) -> list[Node | str]:
        """Earlier siblings, nearest first."""
        if self.parent is None:
            return []
        own = next(i for i, c in enumerate(self.parent.children) if c is self)
        return self.parent.children[:own][::-1]

    def markup(self) -> str:
        out: list[str] = []
        stack: list[Node | str] = [self]
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                out.append(x)
                continue
            out.append("<" + x.name + "".join(f' {k}="{v}"' for k, v in x.attrs.items()) + ">")
            if x.name not in VOID:
                stack += [f"</{x.name}>", *reversed(x.children)]
        return "".join(out)


class Builder(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.root = self.at = Node("#root")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        closed, bounds = CLOSES.get(tag, (set(), set()))
        node = self.at
        last = None
        while node.parent is not None and node.name not in bounds:
            if node.name in closed:
                last = node
            node = node.parent
        if last is not None:
            self.at = last.parent or self.root
        made = Node(tag, {k: v or "" for k, v in attrs}, self.at)
        self.at.children.append(made)
        if tag not in VOID:
            self.at = made

    def handle_startendtag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        self.at.children.append(Node(tag, {k: v or "" for k, v in attrs}, self.at))

    def handle_endtag(self, tag: str) -> None:
        node: Node | None = self.at
        while node is not None and node.name != tag:
            node = node.parent
        if node is not None and node.parent is not None:
            self.at = node.parent

    def handle_data(self, data: str) -> None:
        self.at.children.append(data)


def parse(html: str) -> Node:
    builder = Builder()
    builder.feed(html)
    builder.close()
    return builder.root


def normal(text: str) -> str:
    return unicodedata.normalize("NFKD", text)


def cell_text(cell: Node) -> str:
    """The readable text of a cell: its parts joined by a space."""
    parts: list[str] = []
    for c in cell.children:
        string = c if isinstance(c, str) else c.only_string()
        if string is not None:
            string = string.strip()
            if string and not string.startswith(".mw-parser-output"):
                parts.append(normal(string))
        elif c.name == "span":
            if said := span_text(c):
                parts.append(said)
        elif c.name == "div":
            if said := cell_text(c):
                parts.append(said)
        else:
            parts.append(normal(c.text().strip()))
    return " ".join(parts)


def span_text(span: Node) -> str:
    """Visible text, else a flag's link title, else a title, else a sort key
    that is an integer."""
    if seen := span.text().strip():
        return normal(seen)
    if "class" in span.attrs:
        links = span.find("a") if "flagicon" in span.classes() else []
        return normal(links[0].attrs.get("title", "").strip()) if links else ""
    if "title" in span.attrs:
        return normal(span.attrs["title"])
    key = span.attrs.get("data-sort-value", "").replace("!", "").strip()
    return str(int(key)) if re.fullmatch(r"[+-]?[0-9]+", key) else ""


def hidden(node: Node) -> bool:
    return bool({"reference", "sortkey"} & set(node.classes())) or bool(re.search(r"display\s*:\s*none", node.attrs.get("style", "")))


def without_hidden(table: Node) -> None:
    for node in [table, *table.walk()]:
        node.children = [c for c in node.children if isinstance(c, str) or not hidden(c)]


def span_of(cell: Node, key: str) -> int:
    """A span: an integer, else its first run of digits, else 1."""
    value = cell.attrs.get(key, "1").strip()
    if re.fullmatch(r"[+-]?[0-9]+", value):
        return int(value)
    found = re.search("[0-9]+", value)
    return int(found[0]) if found else 1


def strict_span_of(cell: Node, key: str) -> int:
    value = cell.attrs.get(key, "1").strip(";")
    return int(value) if re.fullmatch(r"\s*[+-]?[0-9]+\s*", value) else 1


#: No table is wider than this; column spans beyond are cut. Row spans end with the rows.
WIDEST = 2000


def expanded(rows: list[list[Node]], deep: bool = True) -> list[list[str]]:
    """The text grid with column spans repeated to the right and row spans
    downward.  A span's first cell has the text; copies have it too when
    ``deep``.  Unfilled rows stay short."""
    flat: list[list[tuple[str, int]]] = []
    for row in rows:
        line: list[tuple[str, int]] = []
        for cell in row:
            said, down = cell_text(cell), span_of(cell, "rowspan")
            wide = min(max(1, span_of(cell, "colspan")), WIDEST)
            line += [(said, down)] + [(said if deep else "", down)] * (wide - 1)
        flat.append(line)
    width = max(map(len, flat), default=0)
    open_: dict[int, tuple[str, int]] = {}
    out: list[list[str]] = []
    for line in flat:
        cells, done = iter(line), []
        for column in range(width):
            said, left = open_.get(column, ("", 0))
            if left > 0:
                done.append(said if deep else "")
                open_[column] = said, left - 1
                continue
            cell = next(cells, None)
            if cell is None:
                continue
            done.append(cell[0])
            if cell[1] > 1:
                open_[column] = cell[0], cell[1] - 1
        out.append(done)
    return out


def section_titles(table: Node) -> list[str]:
    """Headings above a table, outermost first: going back over siblings,
    each of a higher rank than the last, up to a second-level one; where there
    are none, from the parent."""
    node: Node | None = table
    while node is not None and not (node.name == "div" and node.attrs.get("id") == "bodyContent"):
        found, rank = [], 10
        for item in node.before():
            if isinstance(item, Node) and re.fullmatch("h[0-9]", item.name):
                own = int(item.name[1])
                if own < rank:
                    rank = own
                    heads = [s for s in item.find("span") if "mw-headline" in s.classes()]
                    found.append((heads[0] if heads else item).text())
                if own == 2:
                    break
        if found:
            return found[::-1]
        node = node.parent
    return []


def caption(table: Node) -> str | None:
    """A table's caption; of a table inside a cell, the nearest bold text
    before it."""
    captions = table.find("caption")
    if captions:
        return captions[0].text().strip()
    if table.parent is not None and table.parent.name == "td":
        return next((x.text() for x in table.before() if isinstance(x, Node) and x.name == "b"), None)
    return None


def title(page: Node) -> str | None:
    titles = page.find("title")
    return titles[0].text() if titles else None


def selected(page: Node, css_class: str | None) -> list[Node]:
    """Tables of a class, or with None those not inside another table."""
    if css_class is not None:
        return [n for n in page.walk() if css_class in n.classes()]

    def top(node: Node) -> bool:
        up = node.parent
        while up is not None and up.name != "table":
            up = up.parent
        return up is None

    return [n for n in page.find("table") if top(n)]


def tables_of(html: str, css_class: str | None = "wikitable", deep: bool = True) -> list[dict]:
    page, out = parse(html), []
    for i, table in enumerate(selected(page, css_class)):
        raw = table.markup()
        without_hidden(table)
        rows = [tr.find("th", "td") for tr in table.find("tr")]
        spans = [[{"text": cell_text(c), "rowspan": strict_span_of(c, "rowspan"), "colspan": strict_span_of(c, "colspan"), "is_header": c.name == "th"} for c in r] for r in rows]
        out.append({"idx": i, "page_title": title(page), "section_titles": section_titles(table), "table_caption": caption(table), "is_infobox": "infobox" in table.classes(), "grid": expanded(rows, deep), "spans": spans, "html": raw})
    return out


def paragraphs_of(html: str) -> list[dict]:
    """Paragraphs without superscripts; each paragraph's text has only what
    isn't in a paragraph inside it."""
    page, out = parse(html), []
    name = title(page)
    for i, p in enumerate(page.find("p")):
        texts: list[str] = []
        stack: list[Node | str] = list(reversed(p.children))
        while stack:
            x = stack.pop()
            if isinstance(x, str):
                texts.append(x)
            elif x.name not in ("sup", "p", "script", "style") and not (x.name == "font" and "position" in x.attrs.get("style", "")):
                stack += reversed(x.children)
        out.append({"para_id": i, "text": "".join(texts), "title": name})
    return out


SPAN = pa.struct([("text", pa.string()), ("rowspan", pa.int32()), ("colspan", pa.int32()), ("is_header", pa.bool_())])
TABLE_FIELDS = [("url", pa.string()), ("idx", pa.int32()), ("page_title", pa.string()), ("section_titles", pa.list_(pa.string())), ("table_caption", pa.string()), ("is_infobox", pa.bool_()), ("grid", pa.list_(pa.list_(pa.string()))), ("spans", pa.list_(pa.list_(SPAN))), ("html", pa.string()), ("error", pa.string())]
TABLE_SCHEMA = "url string, idx int, page_title string, section_titles array<string>, table_caption string, is_infobox boolean, grid array<array<string>>, spans array<array<struct<text:string,rowspan:int,colspan:int,is_header:boolean>>>, html string, error string"
PARAGRAPH_FIELDS = [("url", pa.string()), ("para_id", pa.int32()), ("text", pa.string()), ("title", pa.string()), ("error", pa.string())]


def over_pages(pages: DataFrame, extract, fields: list[tuple[str, pa.DataType]], schema: str) -> DataFrame:
    """``extract`` over each page's HTML; failures become ``error`` rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows: list[dict] = []
            for url, html in zip(batch.column("url").to_pylist(), batch.column("html").to_pylist(), strict=True):
                try:
                    rows += [{"url": url} | r for r in extract(html or "")]
                except (ValueError, RecursionError, AssertionError) as e:
                    rows.append({"url": url, "error": repr(e)})
            yield pa.RecordBatch.from_pylist(rows, schema=pa.schema(fields))

    return pages.select("url", "html").mapInArrow(run, schema)


def extract_tables(pages: DataFrame, css_class: str | None = "wikitable", deep: bool = True) -> DataFrame:
    """``pages`` (``url, html``) to one row a table; pages without a table
    tag never reach Python."""
    likely = pages.filter(F.lower("html").contains("<tr"))
    return over_pages(likely, lambda html: tables_of(html, css_class, deep), TABLE_FIELDS, TABLE_SCHEMA)


def extract_paragraphs(pages: DataFrame) -> DataFrame:
    return over_pages(pages, paragraphs_of, PARAGRAPH_FIELDS, "url string, para_id int, text string, title string, error string")
