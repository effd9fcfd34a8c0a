"""HTML and SVG documents as element rows: a small tokenizer helper over Arrow batches.

The tree is what the tags say, with void elements and optional end tags of the public HTML standard; html, head
and body are not inserted and nesting is not repaired beyond that.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator
from html import unescape
from html.parser import HTMLParser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from siteaudit.functions.text import BARE_NAMESPACES, PREFIXES

# Fixed values of the HTML standard: elements without end tags, and which open elements a start tag closes.
VOID = "area base br col embed hr img input link meta source track wbr".split()
CLOSED_BY = {
    "p": "address article aside blockquote details div dl fieldset figure footer form h1 h2 h3 h4 h5 h6 header hr main nav ol p pre section table ul".split(),
    "li": ["li"], "dt": ["dt", "dd"], "dd": ["dt", "dd"], "option": ["option", "optgroup"], "optgroup": ["optgroup"],
    "tr": ["tr", "tbody", "tfoot"], "td": ["td", "th", "tr"], "th": ["td", "th", "tr"], "thead": ["tbody", "tfoot"], "tbody": ["tbody", "tfoot"],
    "head": ["body"],
}
SCOPES = "button caption html marquee object table td template th svg math".split()
HTML_NS, SVG_NS = "http://www.w3.org/1999/xhtml", "http://www.w3.org/2000/svg"
SCHEMA = "doc_url string, ord int, parent_ord int, depth int, name string, namespace string, attributes array<struct<name:string,value:string>>, children array<string>"


#: Element rows that are sent on together.
ROWS = 1000

_XML_ATTRIBUTE = re.compile(r"""([^\s=/<>"']+)\s*=\s*("[^"]*"|'[^']*')""")


def qualified(name: str, spaces: dict[str, str], element: bool) -> str:
    """A name of an XML document as functions.text.qualify_name gives it; spaces: what its prefixes stand for."""
    prefix, colon, local = name.rpartition(":")
    space = spaces.get(prefix) if colon or element else None
    if space in PREFIXES:
        return f"{PREFIXES[space]}:{local}"
    if not colon or element and space in BARE_NAMESPACES:
        return local
    return f"{space}:{local}" if space and prefix in PREFIXES.values() else name


class _Tree(HTMLParser):
    """Rows of one document in document order."""

    def __init__(self, xml: bool):
        super().__init__(convert_charrefs=True)
        self.xml, self.rows, self.open, self.spaces = xml, [], [], []
        self.tags: list[str] = []
        if xml:
            self.CDATA_CONTENT_ELEMENTS = ()

    def handle_starttag(self, tag: str, attrs: list, closed: bool = False) -> None:
        name, spaces = tag, {}
        if self.xml:  # names as they are written
            text = self.get_starttag_text()
            name = text[1:].split(None, 1)[0].rstrip("/>")
            attrs = [(k, unescape(v[1:-1])) for k, v in _XML_ATTRIBUTE.findall(text[1 + len(name) :])]
            spaces = (self.spaces[self.open[-1]] if self.open else {"xml": "http://www.w3.org/XML/1998/namespace"}) | {k[6:]: v for k, v in attrs if k == "xmlns" or k.startswith("xmlns:")}
        else:
            while self.open and tag in CLOSED_BY.get(self.rows[self.open[-1]]["name"], ()):
                self.open.pop()
            if tag in CLOSED_BY["p"]:
                self._close_paragraph()
        parent = self.rows[self.open[-1]] if self.open else None
        if self.xml:
            space, raw = spaces.get(name.rpartition(":")[0]), name
            name = qualified(name, spaces, element=True)
        else:
            space, raw = SVG_NS if tag == "svg" else dict(attrs).get("xmlns") or (parent["namespace"] if parent else HTML_NS), name
        if parent is not None:
            parent["children"].append(name)
        pairs = [{"name": qualified(k, spaces, element=False) if self.xml else k, "value": v or ""} for k, v in attrs if k != "xmlns" and not k.startswith("xmlns:")]
        self.spaces.append(spaces)
        self.tags.append(raw.lower())
        self.rows.append({"ord": len(self.rows), "parent_ord": parent["ord"] if parent else None, "depth": len(self.open), "name": name, "namespace": space, "attributes": pairs, "children": []})
        if not closed and (self.xml or tag not in VOID):
            self.open.append(len(self.rows) - 1)

    def _close_paragraph(self) -> None:
        """A block ends an open paragraph, whatever inline elements are still open in it."""
        for i in range(len(self.open) - 1, -1, -1):
            name = self.rows[self.open[i]]["name"]
            if name == "p":
                del self.open[i:]
                return
            if name in SCOPES:
                return

    def handle_startendtag(self, tag: str, attrs: list) -> None:
        self.handle_starttag(tag, attrs, closed=self.xml or tag in VOID or any(self.rows[o]["namespace"] == SVG_NS for o in self.open))

    def handle_endtag(self, tag: str) -> None:
        for i in range(len(self.open) - 1, -1, -1):
            if self.tags[self.open[i]] == tag:
                del self.open[i:]
                return

    def handle_data(self, data: str) -> None:
        if self.open and data.strip():
            children = self.rows[self.open[-1]]["children"]
            if not children or children[-1] != "#text":
                children.append("#text")


def parse(text: str, xml: bool) -> list[dict]:
    tree = _Tree(xml)
    tree.feed(text)
    tree.close()
    return tree.rows


_ROW = pa.schema([("doc_url", pa.string()), ("ord", pa.int32()), ("parent_ord", pa.int32()), ("depth", pa.int32()), ("name", pa.string()), ("namespace", pa.string()), ("attributes", pa.list_(pa.struct([("name", pa.string()), ("value", pa.string())]))), ("children", pa.list_(pa.string())), ("is_svg", pa.bool_())])


def _element_rows(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Element rows of batches of documents (URL, text, whether it is XML), at most ROWS at once."""
    for b in batches:
        rows: list[dict] = []
        for url, text, xml in zip(*b.columns[:3]):  # scalars: a batch as Python strings would be there at once
            url, xml = url.as_py(), xml.as_py()
            rows += [r | {"doc_url": url, "is_svg": xml} for r in parse(text.as_py() or "", xml)]
            full = len(rows) // ROWS * ROWS
            for k in range(0, full, ROWS):
                yield pa.RecordBatch.from_pylist(rows[k : k + ROWS], _ROW)
            rows = rows[full:]
        yield pa.RecordBatch.from_pylist(rows, _ROW)


def elements(docs: DataFrame, url_col: str = "url", body_col: str = "html", svg_col: str | None = None, with_svg: bool = False) -> DataFrame:
    """Element rows (SCHEMA) of each document; svg_col says which documents are SVG, read as XML. with_svg: rows say it too, as is_svg. children: names in order, #text for text that isn't blank. Narrow.

    A null or empty document has no rows. Beside Arrow's batch (10,000 documents or 64 MB, by Spark's settings) memory holds
    one document's text and rows: documents become Python values one by one, and rows are sent on by the thousand.
    """
    svg = F.coalesce(F.col(svg_col), F.lit(False)) if svg_col else F.lit(False)
    rows = docs.select(F.col(url_col), F.col(body_col), svg.alias("__svg")).mapInArrow(_element_rows, f"{SCHEMA}, is_svg boolean")
    return rows if with_svg else rows.drop("is_svg")


def svg_root_errors(elements: DataFrame, ignored: list[str] | None = None) -> DataFrame:
    """doc_url, ord, kind, detail: the root of an SVG document must have the SVG namespace and the name svg, unless its name is ignored; both errors may appear."""
    roots = elements.where("depth = 0 AND ord = 0")
    if ignored:
        roots = roots.where(~F.col("name").rlike("^(?:" + "|".join(ignored) + ")$"))
    wrong = F.array_compact(
        F.array(
            F.when(~F.col("namespace").eqNullSafe(SVG_NS), F.struct(F.lit("root_namespace").alias("kind"), F.coalesce("namespace", F.lit("")).alias("detail"))),
            F.when(F.col("name") != "svg", F.struct(F.lit("root_name").alias("kind"), F.col("name").alias("detail"))),
        )
    )
    return roots.select("doc_url", "ord", F.explode(wrong).alias("e")).select("doc_url", "ord", "e.kind", "e.detail")
