"""Structured documents from TEI XML.

Single values come by XPath on the JVM side (``first_text``); the tree of
sections and references has mixed content, which XPath flattens, so
``parse_tei`` reads it in one Arrow pass with the standard XML parser.  Names of
namespaces don't matter.

Defined results: XML that isn't well-formed, or that declares its own entities,
gives null fields and empty lists; elements without text are left out; a
paragraph without coordinates is located by its text where page texts are given.
"""

from __future__ import annotations

import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docsieve.functions.text import compact

_PLACE = "page:int,bbox:array<double>"
PARAGRAPHS = f"array<struct<text:string,{_PLACE}>>"
SECTIONS = f"array<struct<ordinal:int,heading:string,{_PLACE},paragraphs:{PARAGRAPHS}>>"
REFERENCES = f"array<struct<ordinal:int,raw_citation:string,title:string,authors:array<string>,year:string,venue:string,doi:string,parse_status:string,failure_reason:string,confidence:double,{_PLACE}>>"
PAGES = "array<struct<page:int,width:double,height:double>>"
SCHEMA = f"title string, authors array<string>, abstract string, language string, sections {SECTIONS}, references {REFERENCES}, page_map {PAGES}"


def _path(path: str) -> str:
    return "".join(f"{sep}*[local-name()='{name}']" for sep, name in _steps(path))


def _steps(path: str) -> list[tuple[str, str]]:
    out = []
    for part in path.replace("//", "/\0").strip("/").split("/"):
        out.append(("//" if part.startswith("\0") else "/", part.lstrip("\0")))
    return out


def first_text(xml: Column, paths: list[str]) -> Column:
    """Text of the first path that isn't empty."""
    return F.coalesce(*[F.nullif(compact(F.xpath_string(xml, F.lit(_path(p)))), F.lit("")) for p in paths])


class Node:
    """An element by local names."""

    __slots__ = ("e",)

    def __init__(self, e: ET.Element) -> None:
        self.e = e

    @staticmethod
    def _name(e: ET.Element) -> str:
        return e.tag.rpartition("}")[2] if isinstance(e.tag, str) else ""

    def children(self, name: str) -> list[Node]:
        return [Node(c) for c in self.e if self._name(c) == name]

    def below(self, name: str) -> list[Node]:
        return [Node(c) for c in self.e.iter() if c is not self.e and self._name(c) == name]

    def walk(self, *names: str) -> list[Node]:
        at = [self]
        for n in names:
            at = [c for x in at for c in x.children(n)]
        return at

    def text(self) -> str:
        return " ".join("".join(self.e.itertext()).split())

    def attribute(self, name: str) -> str | None:
        return next((v for k, v in self.e.attrib.items() if k.rpartition("}")[2] == name), None)

    def place(self) -> tuple[int | None, list[float] | None]:
        """Page and box of the element, else of the first element in it that states them."""
        for e in self.e.iter():
            page, box = coordinates(e.attrib.get("coords"))
            if page:
                return page, box
        return None, None


def coordinates(text: str | None) -> tuple[int | None, list[float] | None]:
    """(page, box) of 'page,x,y,width,height;..': the union of the boxes on the first box's page."""
    boxes = []
    for part in (text or "").split(";"):
        fields = part.split(",")
        try:
            page, (x, y, w, h) = int(fields[0]), map(float, fields[1:])
        except ValueError:
            continue
        boxes.append((page, x, y, x + w, y + h))
    if not boxes:
        return None, None
    _, x0, y0, x1, y1 = zip(*(b for b in boxes if b[0] == boxes[0][0]), strict=True)
    return boxes[0][0], [min(x0), min(y0), max(x1), max(y1)]


def names_of(node: Node | None) -> list[str]:
    """The authors in a node: all forenames and the surname of each, else the plain text; each name once."""
    found: dict[str, None] = {}
    for author in node.below("author") if node else []:
        person = next(iter(author.below("persName")), None)
        parts = [p.text() for p in [*person.children("forename"), *person.children("surname")[:1]]] if person else []
        name = " ".join(p for p in parts if p) or (person.text() if person else "") or author.text()
        if name:
            found[name] = None
    return list(found)


def locate(text: str, pages: list[tuple[int, str]]) -> int | None:
    """The first page that holds the first 120, 80 or 50 characters of a text, of which at least 20 are needed."""
    flat = " ".join(text.split())
    heads = [h for n in (120, 80, 50) if len(h := flat[:n]) >= 20]
    return next((page for page, body in pages if any(h in body for h in heads)), None)


def read_reference(node: Node, ordinal: int) -> dict:
    """One bibliographic entry with its status: parsed if it has a title, or authors and a year."""

    def first(*nodes: list[Node]) -> str | None:
        return next((t for group in nodes for n in group[:1] if (t := n.text())), None)

    analytic, book = node.children("analytic"), node.children("monogr")
    titles = node.walk("analytic", "title")
    title = first([t for t in titles if t.attribute("level") == "a"], titles, node.walk("monogr", "title"))
    authors = names_of((analytic or book or [None])[0])
    when = next((d.attribute("when") for d in node.below("date")), None)
    doi = next((i.text() for i in node.below("idno") if (i.attribute("type") or "").upper() == "DOI"), None)
    year = when[:4] if when else None
    parsed = bool(title or (authors and year))
    page, box = node.place()
    return {
        "ordinal": ordinal, "raw_citation": first([n for n in node.children("note") if n.attribute("type") == "raw_reference"]) or node.text() or f"reference {ordinal}", "title": title, "authors": authors, "year": year,
        "venue": first(node.walk("monogr", "title")), "doi": doi, "parse_status": "parsed" if parsed else "failed", "failure_reason": None if parsed else "bibliographic_fields_missing",
        "confidence": 1.0 if title and authors else 0.7 if parsed else 0.0, "page": page, "bbox": box,
    }


def read_document(xml: str | None, pages: list[tuple[int, str]]) -> dict | None:
    """The tree of one document; None if it can't be read."""
    if not xml or re.search(r"<!(?:DOCTYPE|ENTITY)", xml):
        return None
    try:
        root = Node(ET.fromstring(xml))
    except ET.ParseError:
        return None
    header = next(iter(root.below("teiHeader")), None)
    titles = header.walk("fileDesc", "titleStmt", "title") if header else []
    title = next((t for n in [*[x for x in titles if x.attribute("type") == "main"][:1], *titles[:1]] if (t := n.text())), None)
    sections = []
    for number, div in enumerate((d for t in root.below("text") for d in t.walk("body", "div")), 1):
        paragraphs = []
        for p in div.children("p"):
            if t := p.text():
                page, box = p.place()
                paragraphs.append({"text": t, "page": page if page is not None else locate(t, pages), "bbox": box})
        if not paragraphs and (t := " ".join(x for p in div.below("p") if (x := p.text()))):
            paragraphs.append({"text": t, "page": locate(t, pages), "bbox": None})
        heading = next((h.text() for h in div.children("head")), "") or f"section {number}"
        located = next((p for p in paragraphs if p["page"] is not None), {"page": None, "bbox": None})
        sections.append({"ordinal": number, "heading": heading, "page": located["page"], "bbox": located["bbox"], "paragraphs": paragraphs})
    surfaces = [(s.attribute("n"), s.attribute("lrx"), s.attribute("lry")) for s in root.below("surface")]
    page_map = [{"page": int(n), "width": float(w), "height": float(h)} for n, w, h in surfaces if n and w and h]
    references = [read_reference(b, i) for i, b in enumerate((b for l in root.below("listBibl") for b in l.children("biblStruct")), 1)]
    abstract = next((t for n in (header.walk("profileDesc", "abstract") if header else [])[:1] if (t := n.text())), None)
    return {"title": title, "authors": names_of(header), "abstract": abstract, "language": root.attribute("lang") or next((t.attribute("lang") for t in root.children("text")), None), "sections": sections, "references": references, "page_map": page_map}


def parse_tei(df: DataFrame, key: str, xml: str, pages: str | None = None) -> DataFrame:
    """(key, title, authors, abstract, language, sections, references, page_map) of each TEI document.

    ``pages``: a column of array<struct<page:int,text:string>> in which
    paragraphs without coordinates are looked up.
    """
    kind = df.schema[key].dataType.simpleString()
    rows = df.select(key, xml, *([pages] if pages else []))

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(2).to_pylist() if pages else [None] * b.num_rows
            out = [read_document(x, [(p["page"], p["text"] or "") for p in t or []]) or {"sections": [], "references": [], "authors": [], "page_map": []} for x, t in zip(b.column(1).to_pylist(), texts, strict=True)]
            columns = [pa.array([o.get(f.name) for o in out], f.type) for f in fields]
            yield pa.RecordBatch.from_arrays([b.column(0), *columns], names=[key, *[f.name for f in fields]])

    from pyspark.sql.pandas.types import to_arrow_schema
    from pyspark.sql.types import StructType

    fields = list(to_arrow_schema(StructType.fromDDL(SCHEMA)))
    return rows.mapInArrow(work, f"`{key}` {kind}, {SCHEMA}")


def locate_text(needle: Column, pages: Column) -> Column:
    """First page number whose text holds the first 120, 80 or 50 characters of ``needle`` (at least 20); ``pages``: array of (page, text)."""
    flat = compact(needle)
    heads = F.filter(F.array(*[F.substr(flat, F.lit(1), F.lit(n)) for n in (120, 80, 50)]), lambda h: F.length(h) >= 20)
    return F.try_element_at(F.filter(pages, lambda p: F.exists(heads, lambda h: F.contains(compact(p["text"]), h))), F.lit(1))["page"]
