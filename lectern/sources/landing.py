"""Landing files: listing them, and turning their bytes into text as a distributed job."""

from __future__ import annotations

import io
import posixpath
import zipfile
import zlib
from collections.abc import Callable, Iterator, Mapping
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.config import DOCUMENT_TYPES
from lectern.functions.text import assemble_sections, clean_text, doc_type

# An extractor turns the bytes of one file into its parts (pages or slides), in order; a part
# that cannot be read is None and keeps its number.
Extractor = Callable[[bytes], list[str | None]]

_GLOB = "*.{" + ",".join("".join(f"[{c}{c.upper()}]" for c in t) for t in DOCUMENT_TYPES) + "}"


#: Files, and bytes of files, that a task turns into parts at a time.
PIECE_FILES, PIECE_BYTES = 256, 4 << 20


def landing_reader(reader, path: str):
    """Options shared by the batch and the streaming listing of a landing directory."""
    return (
        reader.format("binaryFile")
        .option("recursiveFileLookup", "true")
        .option("pathGlobFilter", _GLOB)
    ).load(path)


def file_name(path):
    return F.element_at(F.split(path, "/"), -1)


def scan_landing(spark: SparkSession, path: str) -> DataFrame:
    """`filename, path` of every accepted file below `path`; no file is an empty result.

    The content column is not selected, so no file is opened.
    """
    files = landing_reader(spark.read, path)
    return files.select(file_name(F.col("path")).alias("filename"), "path")


def read_landing(spark: SparkSession, path: str) -> DataFrame:
    """`path, content` of every accepted file."""
    return landing_reader(spark.read, path).select("path", "content")


# ---- extractors --------------------------------------------------------------------------

# The namespaces of a presentation package.
_P = "{http://schemas.openxmlformats.org/presentationml/2006/main}"
_A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_DECK = "ppt/presentation.xml"
_DECK_LINKS = "ppt/_rels/presentation.xml.rels"


def pptx_slides(content: bytes) -> list[str | None]:
    """The text lines of every slide, in show order."""
    with zipfile.ZipFile(io.BytesIO(content)) as package:
        links = {
            link.get("Id"): posixpath.normpath(posixpath.join("/ppt", link.get("Target")))[1:]
            for link in ElementTree.fromstring(package.read(_DECK_LINKS))
        }
        deck = ElementTree.fromstring(package.read(_DECK))
        names = [links[s.get(f"{_R}id")] for s in deck.iterfind(f"{_P}sldIdLst/{_P}sldId")]
        return [_slide_text(ElementTree.fromstring(_member(content, package, n))) for n in names]


def _member(content: bytes, package: zipfile.ZipFile, name: str) -> bytes:
    """What `package.read(name)` gives, taken from the bytes at hand; what is unusual or damaged is left to it."""
    info = package.getinfo(name)
    at = info.header_offset
    begin = at + 30 + int.from_bytes(content[at + 26 : at + 28], "little")
    if content[at : at + 4] == b"PK\x03\x04" and not info.flag_bits & 0x61 and content[at + 30 : begin] == name.encode():
        begin += int.from_bytes(content[at + 28 : at + 30], "little")
        data = content[begin : begin + info.compress_size]
        if info.compress_type == zipfile.ZIP_DEFLATED:
            try:
                data = zlib.decompress(data, -15)
            except zlib.error:
                return package.read(name)
        elif info.compress_type != zipfile.ZIP_STORED:
            return package.read(name)
        if len(data) == info.file_size and zlib.crc32(data) == info.CRC:
            return data
    return package.read(name)


#: The way from a slide to its paragraphs, a step for each level.
_TO_PARAGRAPHS = (f"{_P}cSld", f"{_P}spTree", f"{_P}sp", f"{_P}txBody", f"{_A}p")
_RUN, _TEXT = f"{_A}r", f"{_A}t"


def _slide_text(slide: ElementTree.Element) -> str:
    lines, found = [], [slide]
    for tag in _TO_PARAGRAPHS:
        found = [child for element in found for child in element if child.tag == tag]
    for paragraph in found:
        runs = [next((t.text for t in run if t.tag == _TEXT), None) for run in paragraph if run.tag == _RUN]
        line = " ".join(r for r in runs if r).strip()
        if line:
            lines.append(line)
    return "\n".join(lines)


def pdf_pages(content: bytes) -> list[str | None]:
    """The text of every page, where a PDF reader is installed."""
    try:
        from pypdf import PdfReader
    except ImportError as missing:
        raise RuntimeError("no PDF reader is installed") from missing
    pages: list[str | None] = []
    for page in PdfReader(io.BytesIO(content)).pages:
        try:
            pages.append(page.extract_text() or "")
        except Exception:  # one bad page must not lose the others
            pages.append(None)
    return pages


EXTRACTORS: Mapping[str, Extractor] = {"pdf": pdf_pages, "pptx": pptx_slides}


def extract_documents(
    files: DataFrame, extractors: Mapping[str, Extractor] = EXTRACTORS
) -> DataFrame:
    """`filename, path, raw_text, error` of files given as `path, content`.

    Python only turns bytes into parts; cleaning, numbering and joining are built-in functions.
    A file that cannot be read keeps its row: the text says so in brackets and `error` holds the
    reason, so later steps can leave it out. An unknown type gives an empty text.
    """
    registry = dict(extractors)

    def read_one(kind: str, content: bytes) -> tuple[list, str | None]:
        try:
            extract = registry.get(kind)
            return (extract(content) if extract else []), None
        except Exception as failure:
            return [], f"{type(failure).__name__}: {failure}"

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            # the parts of a file may be many times its size, so a few files leave at a time
            step = max(1, min(PIECE_FILES, batch.num_rows * PIECE_BYTES // max(1, batch.nbytes)))
            for at in range(0, batch.num_rows, step):
                piece = batch.slice(at, step)
                found = [read_one(*x) for x in zip(piece.column("kind").to_pylist(), piece.column("content").to_pylist())]
                columns = [
                    piece.column("path"), piece.column("kind"),
                    pa.array([p for p, _ in found], pa.list_(pa.string())), pa.array([e for _, e in found], pa.string()),
                ]
                yield pa.RecordBatch.from_arrays(columns, ["path", "kind", "parts", "error"])

    kinds = files.select("path", doc_type(file_name(F.col("path"))).alias("kind"), "content")
    read = kinds.mapInArrow(parts, "path string, kind string, parts array<string>, error string")
    pages = assemble_sections(F.transform("parts", clean_text), "Page")
    slides = assemble_sections(F.col("parts"), "Slide")
    text = (
        F.when(
            F.col("error").isNotNull(),
            F.concat(F.lit("["), F.upper("kind"), F.lit(" extraction failed: "), "error", F.lit("]")),
        )
        .when(F.col("kind") == "pptx", slides)
        .otherwise(pages)
    )
    return read.select(
        file_name(F.col("path")).alias("filename"), "path", text.alias("raw_text"), "error"
    )
