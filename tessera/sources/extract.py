"""From files to text. Reading PDF bytes is a plug-in, slides are read from their XML; the rules on the output are expressions."""

from __future__ import annotations

import io
import posixpath
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tessera.functions import text as T
from tessera.functions.models import VisionModel

LEAST_PAGE_CHARS, LEAST_TOTAL = 100, 500

#: A plug-in: a file's bytes to its pages, each with page, native, tables, ocr and visual (text or "").
PageReader = Callable[[bytes], list[dict]]


def acquire(local: bytes | None, url: str | None, fetch: Callable[[str], bytes], attempts: int = 3) -> bytes | None:
    """A file's bytes: the local copy if there is one, else what fetch gets, tried again on time-outs."""
    if local is not None:
        return local
    for _ in range(attempts if url else 0):
        try:
            return fetch(url)
        except TimeoutError:
            continue
    return None


def fetch_files(sources: DataFrame, fetch: Callable[[str], bytes], attempts: int = 3) -> DataFrame:
    """(key, content) of (key, content, url) rows: the local content if there is one, else what fetch gets; null without either."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf.key, "content": [acquire(c, u, fetch, attempts) for c, u in zip(pdf.content, pdf.url)]})

    return sources.select("key", "content", "url").mapInPandas(run, "key string, content binary")


def read_pages(files: DataFrame, reader: PageReader) -> DataFrame:
    """(path, page, native, tables, ocr, visual) of (path, content) rows, as of the binaryFile source."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for path, content in zip(pdf.path, pdf.content):
                rows = [(path, int(p["page"]), *(p.get(c) or "" for c in ("native", "tables", "ocr", "visual"))) for p in reader(content)]
                yield pd.DataFrame(rows, columns=["path", "page", "native", "tables", "ocr", "visual"])

    return files.select("path", "content").mapInPandas(run, "path string, page int, native string, tables string, ocr string, visual string")


def assemble(pages: DataFrame, describe_visuals: bool = True) -> DataFrame:
    """(path, text, needs_fallback): pages in order; native text if there is enough of it, else what was read off the image.

    needs_fallback: so little text and no table that another reader should try.
    """
    head = F.when(T.strip(F.col("native")) != "", F.concat(T.strip(F.col("native")), F.lit("\n"))).otherwise("")
    described = F.when(F.col("visual") != "", F.concat(F.lit("\n\n[VISUAL DESCRIPTION]\n"), "visual", F.lit("\n[/VISUAL DESCRIPTION]"))).otherwise("")
    if describe_visuals:
        read = F.concat(F.lit("[VISUAL DESCRIPTION]\n"), head, "ocr", F.lit("\n[/VISUAL DESCRIPTION]\n"), "tables")
    else:
        read = F.concat(F.lit("[OCR PAGE "), F.col("page").cast("string"), F.lit("]\n"), head, "ocr", F.lit("\n"), "tables")
    text = F.when(F.length("native") >= LEAST_PAGE_CHARS, F.concat("native", "tables", described)).when(F.col("ocr") != "", read).when(T.strip(F.col("native")) != "", F.concat("native", "tables"))
    rows = F.array_sort(F.collect_list(F.when(text.isNotNull(), F.struct("page", text.alias("text")))))
    df = pages.groupBy("path").agg(F.array_join(rows["text"], "\n\n").alias("text"), F.max((F.col("ocr") != "") | (F.col("visual") != "")).alias("seen"))
    return df.select("path", "text", (~F.col("seen") & (F.length("text") <= LEAST_TOTAL) & ~F.contains("text", F.lit("[TABLE]"))).alias("needs_fallback"))


def table_text(rows: list[list[str | None]]) -> str:
    """A table's rows with bars between cells, in table tags."""
    return "\n[TABLE]\n" + "\n".join(" | ".join((c or "").strip() for c in r) for r in rows) + "\n[/TABLE]\n"


#: Fewer words read off an image are taken for a failure.
LEAST_WORDS = 10


def read_image(vision: VisionModel, content: bytes, mime: str, half: Callable[[bytes], bytes]) -> str:
    """The text of an image; with fewer than LEAST_WORDS words, what is read off one of half its size."""
    text = vision.read(content, mime)
    return text if len(text.split()) >= LEAST_WORDS else vision.read(half(content), mime)


def read_images(images: DataFrame, vision: VisionModel, half: Callable[[bytes], bytes]) -> DataFrame:
    """(key, text) of (key, mime, content): as of read_image()."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            yield pd.DataFrame({"key": pdf.key, "text": [read_image(vision, c, m, half) for c, m in zip(pdf.content, pdf.mime)]})

    return images.select("key", "mime", "content").mapInPandas(run, "key string, text string")


#: XML namespaces of presentations.
DRAWING = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
SLIDES = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
LINKS = "{http://schemas.openxmlformats.org/package/2006/relationships}"
LINK_ID = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}id"
EMBED = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}embed"


def _related(archive: zipfile.ZipFile, part: str) -> dict[str, tuple[str, str]]:
    """id -> (last word of the kind, path) of what a part refers to."""
    folder, name = posixpath.split(part)
    path = f"{folder}/_rels/{name}.rels"
    if path not in archive.namelist():
        return {}
    found = ElementTree.fromstring(archive.read(path)).iter(f"{LINKS}Relationship")
    return {r.get("Id"): (r.get("Type", "").rsplit("/", 1)[-1], posixpath.normpath(posixpath.join(folder, r.get("Target", ""))).lstrip("/")) for r in found if r.get("TargetMode") != "External"}


def _paragraphs(element: ElementTree.Element) -> str:
    lines = ("".join(t.text or "" for t in p.iter(f"{DRAWING}t")).strip() for p in element.iter(f"{DRAWING}p"))
    return "\n".join(x for x in lines if x)


def pptx_slides(content: bytes) -> list[dict]:
    """The slides of a presentation file, in order: slide_number, title, body, tables, notes and images (bytes). A file that can't be read has none."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        deck = "ppt/presentation.xml"
        links = _related(archive, deck)
        order = [links[s.get(LINK_ID)][1] for s in ElementTree.fromstring(archive.read(deck)).iter(f"{SLIDES}sldId")]
        return [_slide(archive, part, i) for i, part in enumerate(order, 1)]
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return []


def _slide(archive: zipfile.ZipFile, part: str, number: int) -> dict:
    root, links = ElementTree.fromstring(archive.read(part)), _related(archive, part)
    titles, bodies = [], []
    for shape in root.iter(f"{SLIDES}sp"):
        if text := _paragraphs(shape):
            kind = next((p.get("type") for p in shape.iter(f"{SLIDES}ph")), None)
            (titles if kind in ("title", "ctrTitle") else bodies).append(text)
    cells = [[_paragraphs(c).replace("\n", " ") for c in r.iter(f"{DRAWING}tc")] for r in root.iter(f"{DRAWING}tr")]
    rows = [" | ".join(r) for r in cells if any(r)]
    notes = [_paragraphs(s) for _, p in links.values() if p.startswith("ppt/notesSlides/") for s in ElementTree.fromstring(archive.read(p)).iter(f"{SLIDES}sp") if any(h.get("type") == "body" for h in s.iter(f"{SLIDES}ph"))]
    images = [archive.read(links[b.get(EMBED)][1]) for b in root.iter(f"{DRAWING}blip") if b.get(EMBED) in links]
    return {"slide_number": number, "title": titles[-1] if titles else "", "body": "\n\n".join(bodies), "tables": "[TABLE]\n" + "\n".join(rows) + "\n[/TABLE]" if rows else "", "notes": "\n".join(n for n in notes if n), "images": images}


def read_slides(files: DataFrame, reader: Callable[[bytes], list[dict]] = pptx_slides) -> DataFrame:
    """(key, slide_number, title, body, tables, notes) of (key, content) rows."""
    columns = ["slide_number", "title", "body", "tables", "notes"]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for key, content in zip(pdf.key, pdf.content):
                yield pd.DataFrame([(key, *(s[c] for c in columns)) for s in reader(content)], columns=["key", *columns])

    return files.select("key", "content").mapInPandas(run, "key string, slide_number int, title string, body string, tables string, notes string")
