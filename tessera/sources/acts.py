"""Acts in XML and HTML: units with their places in a canonical text of blocks.

A parser gives a document's blocks of text and, for every unit, the blocks it reaches
over or the part of a block that it is. Places follow from the blocks' lengths
when all are known.
"""

from __future__ import annotations

import hashlib
import re
from dataclasses import dataclass, field
from html.parser import HTMLParser
from itertools import accumulate
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

UNIT_SCHEMA = (
    "unit_id string, document_code string, unit_type string, number string, title string, text string, parent_unit_id string, "
    "canonical_char_start long, canonical_char_end long, legal_order long, source_text_sha256 string, source_path string"
)
#: The order of documents, and the patterns of paragraphs in HTML acts.
DOCUMENT_ORDER = ("B", "RI", "RII", "G", "E", "W")
ARTICLE_TITLE = re.compile(r"Article\s+(\d+[a-z]?)", re.IGNORECASE)
RECITAL_MARK = re.compile(r"\((\d+)\)")
PARAGRAPH_MARK = re.compile(r"(\d+)\.\s*.+")
ITEM_MARK = re.compile(r"\(([a-zivx]+)\)\s*.+", re.IGNORECASE)
GAP = "\n\n"


def clean(text: str | None) -> str:
    return " ".join((text or "").split())


@dataclass
class _Unit:
    kind: str
    number: str
    parent: int | None
    title: str = ""
    #: A text of its own, or what the canonical text has at its place.
    text: str | None = None
    #: Blocks from the first up to the last; or characters of the first one.
    first: int = 0
    last: int = 0
    part: tuple[int, int] | None = None
    #: Whether the unit begins where the block before its first one ends.
    loose: bool = False


@dataclass
class Act:
    code: str
    blocks: list[str] = field(default_factory=list)
    units: list[_Unit] = field(default_factory=list)

    def block(self, text: str) -> int:
        """The number of a new block; blocks without text leave none."""
        if text:
            self.blocks.append(text)
        return len(self.blocks) - bool(text)

    def add(self, kind: str, number: str, parent: int | None, **more) -> int:
        self.units.append(_Unit(kind, number, parent, **more))
        return len(self.units) - 1

    def label(self, unit: _Unit) -> str:
        short = {"document": "Root", "chapter": f"Chap. {unit.number}", "recital": f"Rec. {unit.number}"}
        return f"{self.code} {short.get(unit.kind, f'Art. {unit.number}')}"

    @property
    def text(self) -> str:
        return GAP.join(self.blocks)

    def rows(self, digest: str, path: str) -> list[tuple]:
        """The units in order; of several with one id the first counts."""
        ends = list(accumulate((len(b) + len(GAP) for b in self.blocks), initial=0))
        whole, out, seen = self.text, [], set()
        for unit in self.units:
            made = self.label(unit)
            if made in seen:
                continue
            seen.add(made)
            start = ends[unit.first] if unit.first < len(self.blocks) else len(whole)
            stop = ends[unit.last] - len(GAP) if unit.last else 0
            if unit.part:
                start, stop = start + unit.part[0], start + unit.part[1]
            elif unit.loose:
                start = max(0, ends[unit.first] - len(GAP))
            stop = max(start, stop)
            text = whole[start:stop] if unit.text is None else unit.text
            parent = None if unit.parent is None else self.label(self.units[unit.parent])
            out.append((made, self.code, unit.kind, unit.number, unit.title, clean(text), parent, start, stop, len(out), digest, path))
        return out


def _name(node) -> str:
    return node.tag.rsplit("}", 1)[-1]


def _first(node, name: str):
    return next((c for c in node if _name(c) == name), None)


def _below(node, name: str) -> list:
    return [n for n in node.iter() if _name(n) == name]


def _all_text(node) -> str:
    return "" if node is None else clean(" ".join(node.itertext()))


def _body(node) -> str:
    """The text of a node's content, or else all but its number and heading."""
    content = _first(node, "content")
    if content is not None:
        return _all_text(content)
    parts = [node.text]
    for child in node:
        parts += [*(child.itertext() if _name(child) not in ("num", "heading") else ()), child.tail]
    return clean(" ".join(p for p in parts if p))


def _number(node) -> str:
    return re.sub(r"(?i)article|chapter", "", _all_text(_first(node, "num"))).strip(" ().")


def parse_xml(code: str, content: bytes) -> Act:
    """One XML act: recitals, then chapters with articles, paragraphs and items.

    A paragraph without a number has its place among its article's paragraphs, and
    an article without paragraphs is its own one. Items without a number, or whose
    text is not found behind the item before it, are left out.
    """
    root = ElementTree.fromstring(content)
    act = Act(code)
    top = act.add("document", code, None)
    for recital in _below(root, "recital"):
        number = _number(recital)
        text = clean(f"Recital {number}. {_body(recital)}")
        at = act.block(text)
        act.add("recital", number, top, text=text, first=at, last=at + 1)
    for chapter in _below(root, "chapter"):
        number, title = _number(chapter), _all_text(_first(chapter, "heading"))
        if not number:
            named = re.match(r"(?i)chapter\s+(\S+)", title)
            if not named:
                raise ValueError(f"{code}: a chapter has no number: {title!r}")
            number, title = named[1].strip(" ."), ""
        own = act.add("chapter", number, top, title=title, first=len(act.blocks), loose=True)
        for article in _below(chapter, "article"):
            _xml_article(act, article, own)
        act.units[own].last = len(act.blocks)
    act.units[top].last = len(act.blocks)
    return act


def _xml_article(act: Act, article, parent: int) -> None:
    number, title = _number(article), _all_text(_first(article, "heading"))
    own = act.add("article", number, parent, title=title, first=act.block(clean(f"Article {number}. {title}")))
    paragraphs = [c for c in article if _name(c) == "paragraph"] or [article]
    for place, paragraph in enumerate(paragraphs, 1):
        mark = _number(paragraph) or str(place)
        text = clean(f"{mark}. {_body(paragraph)}")
        at = act.block(text)
        para = act.add("paragraph", f"{number}.{mark}", own, text=text, first=at, last=at + 1)
        behind = 0
        for item in _below(paragraph, "item"):
            letter, body = _number(item), _body(item)
            start = text.find(body, behind) if letter and body else -1
            if start >= 0:
                behind = start + len(body)
                act.add("subparagraph", f"{number}.{mark}.{letter}", para, text=f"{letter} {body}", first=at, part=(start, behind))
    act.units[own].last = len(act.blocks)


class _Paragraphs(HTMLParser):
    """Classes and text of paragraphs. What stands in scripts and styles is no text, and a paragraph that begins replaces an open one."""

    def __init__(self) -> None:
        super().__init__()
        self.found: list[tuple[list[str], str]] = []
        self.classes: list[str] | None = None
        self.pieces: list[str] = []
        self.silent = 0

    def handle_starttag(self, tag, attrs):
        if tag == "p":
            self.classes, self.pieces = (dict(attrs).get("class") or "").split(), []
        self.silent += tag in ("script", "style")

    def handle_endtag(self, tag):
        if tag == "p" and self.classes is not None:
            text = clean(" ".join(self.pieces))
            self.found += [(self.classes, text)] if text else []
            self.classes = None
        self.silent -= tag in ("script", "style") and self.silent > 0

    def handle_data(self, data):
        if self.classes is not None and not self.silent:
            self.pieces.append(data)


def html_paragraphs(content: bytes) -> list[tuple[list[str], str]]:
    """Paragraphs of a page; bytes that are no UTF-8 are left out."""
    parser = _Paragraphs()
    parser.feed(content.decode("utf-8", "ignore"))
    return parser.found


def parse_html(code: str, content: bytes) -> Act:
    """One HTML act: recitals before the first article, then articles that run from one title to the next.

    A recital is a number in brackets and the paragraph behind it. In an article,
    further titles are its title; a body paragraph is a numbered paragraph, an item of
    the paragraph before it, or takes the article's next number of its own.
    """
    act, found = Act(code), html_paragraphs(content)
    top = act.add("document", code, None)
    heads = [i for i, (kinds, text) in enumerate(found) if "title-article-norm" in kinds and ARTICLE_TITLE.fullmatch(text)]
    place, end = 0, heads[0] if heads else len(found)
    while place < end - 1:
        (kinds, text), (next_kinds, body) = found[place], found[place + 1]
        mark = RECITAL_MARK.fullmatch(text)
        if mark and "norm" in kinds and "norm" in next_kinds:
            made = clean(f"Recital {mark[1]}. {body}")
            at = act.block(made)
            act.add("recital", mark[1], top, text=made, first=at, last=at + 1)
            place += 1
        place += 1
    for head, stop in zip(heads, [*heads[1:], len(found)], strict=True):
        rest = found[head + 1 : stop]
        title = clean(" ".join(t for kinds, t in rest if "title-article-norm" in kinds))
        _html_article(act, ARTICLE_TITLE.fullmatch(found[head][1])[1], title, [t for kinds, t in rest if "norm" in kinds and "title-article-norm" not in kinds], top)
    act.units[top].last = len(act.blocks)
    return act


def _html_article(act: Act, number: str, title: str, bodies: list[str], top: int) -> None:
    first = act.block(clean(f"Article {number}. {title}"))
    own = act.add("article", number, top, title=title, first=first)
    at = act.block(clean("\n".join(bodies)))
    act.units[own].last = len(act.blocks)
    parent, prefix, spare, start = own, number, 0, 0
    for body in bodies:
        paragraph, item = PARAGRAPH_MARK.fullmatch(body), ITEM_MARK.fullmatch(body)
        if item and not paragraph:
            act.add("subparagraph", f"{prefix}.{item[1]}", parent, text=body, first=at, part=(start, start + len(body)))
        else:
            spare += not paragraph
            prefix = f"{number}.{paragraph[1] if paragraph else spare}"
            parent = act.add("paragraph", prefix, own, text=body, first=at, part=(start, start + len(body)))
        start += len(body) + 1


def _parsed(path: str, content: bytes, html: bool, codes: dict[str, str]) -> tuple[Act, str, str]:
    file = path.rsplit("/", 1)[-1]
    stem = re.sub(r"\.\w+$", "", file)
    parse = parse_html if html else parse_xml
    return parse(codes.get(stem, stem), content), hashlib.sha256(content).hexdigest(), file


def read_acts(spark: SparkSession, path: str, *, html: bool = False, codes: dict[str, str] | None = None) -> DataFrame:
    """Units of all acts below ``path``. ``codes`` names documents by their files' names without endings; others are named by these."""
    named = codes or {}

    def run(frames):
        for frame in frames:
            rows = [u for name, content in zip(frame.path, frame.content, strict=True) for act, digest, file in [_parsed(name, bytes(content), html, named)] for u in act.rows(digest, file)]
            yield pd.DataFrame(rows, columns=[c.split()[0] for c in UNIT_SCHEMA.split(", ")])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, UNIT_SCHEMA)


def read_canonical(spark: SparkSession, path: str, *, html: bool = False, codes: dict[str, str] | None = None) -> DataFrame:
    """``document_code, text, char_length, source_text_sha256``, a row per act."""
    named = codes or {}

    def run(frames):
        for frame in frames:
            acts = [_parsed(name, bytes(content), html, named) for name, content in zip(frame.path, frame.content, strict=True)]
            yield pd.DataFrame([(act.code, act.text, len(act.text), digest) for act, digest, _ in acts], columns=["document_code", "text", "char_length", "source_text_sha256"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "document_code string, text string, char_length long, source_text_sha256 string")


def read_corpus(spark: SparkSession, xml: str, html: str, *, codes: dict[str, str] | None = None, order: tuple[str, ...] = DOCUMENT_ORDER) -> DataFrame:
    """Units of XML and HTML acts with ``document_order``, the document's place in a fixed order."""
    units = read_acts(spark, xml, codes=codes).unionByName(read_acts(spark, html, html=True, codes=codes))
    place = F.array_position(F.array(*map(F.lit, order)), F.col("document_code"))
    return units.withColumn("document_order", F.when(place > 0, place).otherwise(len(order) + 1).cast("int"))
