"""Markup to paragraphs, and book archives to chapters, as table functions of binary files."""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from html.parser import HTMLParser
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tessera.functions.udf import mapped

# Elements by their part.
BLOCKS = set("p div li td th blockquote dd dt".split())
SKIPPED = set("script style sup".split())
HEADINGS = {f"h{i}" for i in range(1, 7)}
VOID = set("area base br col embed hr img input link meta param source track wbr".split())


class Paragraphs(HTMLParser):
    """Text of block elements, the first heading apart; notes, page anchors and scripts left out."""

    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.open: list[tuple[str, str]] = []
        self.text: dict[str, list[str]] = {"para": [], "heading": []}
        self.paragraphs: list[str] = []
        self.headings: list[str] = []

    def _part(self) -> str | None:
        parts = [p for _, p in self.open]
        return None if "skip" in parts else "heading" if "heading" in parts else "para"

    def _finish(self, part: str) -> None:
        line = " ".join("".join(self.text[part]).split())
        self.text[part].clear()
        if line:
            (self.headings if part == "heading" else self.paragraphs).append(line)

    def handle_starttag(self, tag: str, attrs) -> None:
        if tag == "br":
            self.handle_data(" ")
        if tag in VOID:
            return
        href = dict(attrs).get("href") or ""
        skip = tag in SKIPPED or (tag == "a" and (href.startswith("notes.html#") or "#page_" in href))
        if tag in BLOCKS or tag in HEADINGS:
            self._finish("para")
        self.open.append((tag, "skip" if skip else "heading" if tag in HEADINGS else "block" if tag in BLOCKS else "inline"))

    def handle_startendtag(self, tag: str, attrs) -> None:
        if tag == "br":
            self.handle_data(" ")

    def handle_endtag(self, tag: str) -> None:
        if tag in VOID or not self.open:
            return
        part = self.open.pop()[1]
        if part == "heading":
            self._finish("heading")
        elif part == "block":
            self._finish("para")

    def handle_data(self, data: str) -> None:
        if part := self._part():
            self.text[part].append(data)

    def close(self) -> None:
        super().close()
        self._finish("para")
        self._finish("heading")


def parse(html: str | None) -> dict:
    p = Paragraphs()
    p.feed(html or "")
    p.close()
    return {"heading": p.headings[0] if p.headings else None, "paragraphs": p.paragraphs}


@mapped("struct<heading:string,paragraphs:array<string>>")
def parsed(html):
    return parse(html)


def chapter_of(href: str) -> str | None:
    """Chapter id of a member name: ch01 from ch1.html or ch01d.xhtml, or the name of a front or back part."""
    base = posixpath.basename(href).partition(".")[0].lower()
    if m := re.fullmatch(r"ch(?:apter)?0*(\d{1,2})[a-z]?", base):
        return f"ch{int(m[1]):02d}"
    return base if base in {"preface", "names", "introduction", "conclusion", "epilogue"} else None


def read_archive(content: bytes) -> list[dict]:
    """Chapters' members of an EPUB in spine order: (spine_pos, chapter, member, html)."""
    local = lambda e: e.tag.rpartition("}")[2]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        box = ElementTree.fromstring(z.read("META-INF/container.xml"))
        opf = next(e.get("full-path") for e in box.iter() if local(e) == "rootfile")
        package = ElementTree.fromstring(z.read(opf))
        items = {e.get("id"): e.get("href") for e in package.iter() if local(e) == "item"}
        out = []
        for pos, ref in enumerate(e for e in package.iter() if local(e) == "itemref"):
            href = items.get(ref.get("idref"))
            if href and (chapter := chapter_of(href)):
                member = posixpath.normpath(posixpath.join(posixpath.dirname(opf), href))
                out.append({"spine_pos": pos, "chapter": chapter, "member": member, "html": z.read(member).decode("utf-8")})
    return out


def read_metadata(content: bytes) -> dict:
    """Dublin Core facts of an EPUB without markup."""
    local = lambda e: e.tag.rpartition("}")[2]
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        box = ElementTree.fromstring(z.read("META-INF/container.xml"))
        package = ElementTree.fromstring(z.read(next(e.get("full-path") for e in box.iter() if local(e) == "rootfile")))
    wanted = ("title", "creator", "publisher", "date", "language", "description")
    found = {local(e): re.sub(r"<[^>]+>", "", "".join(e.itertext())).strip() for e in reversed(list(package.iter())) if local(e) in wanted}
    return {k: found.get(k) for k in wanted}


_MEMBERS = "array<struct<spine_pos:int,chapter:string,member:string,html:string>>"


@mapped(_MEMBERS)
def members_of(content):
    return read_archive(content)


def read_books(spark: SparkSession, path: str) -> DataFrame:
    """(path, spine_pos, chapter, member, heading, para, text) of EPUB files through Spark's binary reader."""
    rows = spark.read.format("binaryFile").load(path).select("path", F.explode(members_of("content")).alias("m")).select("path", "m.*")
    rows = rows.withColumn("p", parsed("html"))
    return rows.select("path", "spine_pos", "chapter", "member", F.col("p.heading").alias("heading"), F.posexplode("p.paragraphs").alias("para", "text"))


def missing_chapters(rows: DataFrame, required: list[str]) -> DataFrame:
    """Required chapters that no row has."""
    want = rows.sparkSession.createDataFrame([(r,) for r in required], "chapter string")
    return want.join(rows.select("chapter").distinct(), "chapter", "left_anti")
