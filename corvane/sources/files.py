"""Files as text: Spark lists and reads them, small decoders take one file's bytes."""

from __future__ import annotations

import hashlib
import io
import json
import re
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions import text as T

READERS: dict[str, Callable[[bytes], str]] = {}
TEXT = "path string, size long, mtime timestamp, text string, error string, file_hash string"


def reader(*extensions: str):
    """Registers a decoder of a file's bytes for file extensions; a later one for an extension replaces it."""

    def register(fn: Callable[[bytes], str]) -> Callable[[bytes], str]:
        READERS.update(dict.fromkeys(extensions, fn))
        return fn

    return register


def plain(raw: bytes) -> str:
    """UTF-16 by its mark, else UTF-8 without one; a NUL among the first 8 KB means a binary file."""
    if raw[:2] in (b"\xff\xfe", b"\xfe\xff"):
        return raw.decode("utf-16", "replace")
    if b"\0" in raw[:8192]:
        raise ValueError("binary file")
    return raw.decode("utf-8-sig", "replace")


@reader("ipynb")
def notebook(raw: bytes) -> str:
    """Markdown and code cells."""
    cells = json.loads(plain(raw)).get("cells", [])
    return "\n\n".join("".join(c.get("source", [])) for c in cells if c.get("cell_type") in ("markdown", "code"))


@reader("svg")
def svg(raw: bytes) -> str:
    found = re.findall(r"<(?:text|title|desc|tspan)\b[^>]*>([^<]{3,})<", plain(raw))
    return "\n".join(x.strip() for x in found)[:4000]


def _parts(raw: bytes, pattern: str) -> Iterator[ElementTree.Element]:
    with zipfile.ZipFile(io.BytesIO(raw)) as z:
        names = [n for n in z.namelist() if re.fullmatch(pattern, n)]
        for n in sorted(names, key=lambda n: [int(x) for x in re.findall(r"\d+", n)]):
            yield ElementTree.fromstring(z.read(n))


def _text(node: ElementTree.Element, tag: str) -> str:
    return "".join(x.text or "" for x in node.iter() if x.tag.endswith(f"}}{tag}"))


@reader("docx")
def docx(raw: bytes) -> str:
    """Paragraphs in order, headings as ``#`` lines, table rows as ``a | b``."""
    out = []
    for root in _parts(raw, "word/document.xml"):
        body = next((x for x in root if x.tag.endswith("}body")), [])
        for block in body:
            if block.tag.endswith("}tbl"):
                rows = (r for r in block.iter() if r.tag.endswith("}tr"))
                out += [" | ".join(_text(c, "t") for c in r if c.tag.endswith("}tc")) for r in rows]
            elif line := _text(block, "t"):
                style = next((v for x in block.iter() if x.tag.endswith("}pStyle") for k, v in x.attrib.items() if k.endswith("}val")), "")
                level = re.fullmatch(r"(?i)heading\s*([1-6])", style)
                out.append("#" * int(level[1]) + " " + line if level else line)
    return "\n".join(out)


@reader("pptx")
def pptx(raw: bytes) -> str:
    """One part for each slide, a line for each paragraph."""
    slides = []
    for root in _parts(raw, r"ppt/slides/slide\d+\.xml"):
        slides.append("\n".join(line for p in root.iter() if p.tag.endswith("}p") and (line := _text(p, "t"))))
    return "\n\n".join(slides)


@reader("rtf")
def rtf(raw: bytes) -> str:
    """Plain text: control words dropped, groups of tables and pictures skipped, ``\\'hh`` and ``\\u`` decoded."""
    out, stack, skip, drop = [], [], False, 0
    page = re.search(rb"\\ansicpg(\d+)", raw)
    code = f"cp{page[1].decode()}" if page else "cp1252"
    for m in re.finditer(rb"\\([a-z]+)(-?\d+)? ?|\\'([0-9a-f]{2})|\\(.)|([{}])|([^\\{}\r\n]+)", raw, re.S | re.I):
        word, number, pair, symbol, brace, text = m.groups()
        if brace == b"{":
            stack.append(skip)
        elif brace == b"}":
            skip = stack.pop() if stack else False
        elif symbol == b"*" or word in (b"fonttbl", b"colortbl", b"stylesheet", b"info", b"pict", b"header", b"footer", b"generator"):
            skip = True
        elif skip:
            continue
        elif word in (b"par", b"line", b"row"):
            out.append("\n")
        elif word in (b"tab", b"cell"):
            out.append("\t")
        elif word == b"u" and number:
            out.append(chr(int(number) % 65536))
            drop = 1
        elif drop and (pair or text):
            drop, text = 0, text[1:] if text else None
            out.append(text.decode(code, "replace") if text else "")
        elif pair:
            out.append(bytes.fromhex(pair.decode()).decode(code, "replace"))
        elif symbol in (b"\\", b"{", b"}"):
            out.append(symbol.decode())
        elif text:
            out.append(text.decode(code, "replace"))
    return "".join(out)


def _decode(readers: dict[str, Callable[[bytes], str]]):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            texts, errors = [], []
            for path, raw in zip(batch["path"], batch["content"], strict=True):
                try:
                    texts.append(readers.get(path.rpartition(".")[2].lower(), plain)(bytes(raw)))
                    errors.append(None)
                except Exception as e:  # a file that can't be read is a row with its error
                    texts.append(None)
                    errors.append(f"{type(e).__name__}: {e}"[:200])
            yield pd.DataFrame({"path": batch["path"], "size": batch["length"], "mtime": batch["modificationTime"], "text": texts, "error": errors, "file_hash": batch["file_hash"]})

    return run


def read_files(spark: SparkSession, root: str, glob: str = "*") -> DataFrame:
    """(path, size, mtime, text, error, file_hash) of the files below ``root`` whose names match ``glob``."""
    found = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", glob).load(root)
    return found.select("path", "length", "modificationTime", "content", F.sha2("content", 256).alias("file_hash")).mapInPandas(_decode(dict(READERS)), TEXT)


def read_paths(found: DataFrame) -> DataFrame:
    """(path, size, mtime, text, error, file_hash) of the files of ``found`` (path, size, mtime), which tasks open one by one.

    A file that went away since it was listed is a row with its error and without a hash.
    """
    decoders = dict(READERS)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        from pyarrow import fs

        decode = _decode(decoders)
        for batch in batches:
            for r in batch.itertuples(index=False):
                try:
                    where, path = fs.FileSystem.from_uri(r.path)
                    with where.open_input_stream(path) as stream:
                        raw, error = stream.read(), None
                except OSError as e:
                    raw, error = b"", f"{type(e).__name__}: {e}"[:200]
                one = pd.DataFrame({"path": [r.path], "content": [raw], "length": [r.size], "modificationTime": [r.mtime], "file_hash": [hashlib.sha256(raw).hexdigest()]})
                if error:
                    yield pd.DataFrame({"path": [r.path], "size": [r.size], "mtime": [r.mtime], "text": [None], "error": [error], "file_hash": [None]})
                else:
                    yield from decode(iter([one]))

    # files are dealt singly: a task's share does not depend on how the listing was stored
    return found.select("path", "size", "mtime").repartition("path").mapInPandas(run, TEXT)


def repeated_lines(lines: DataFrame, share: float = 0.5) -> DataFrame:
    """(doc, page, n, line) rows without lines whose key is on ``max(2, share)`` of a document's pages."""
    keyed = lines.withColumn("key", T.line_key(F.col("line")))
    pages = keyed.groupBy("doc").agg(F.countDistinct("page").alias("pages"))
    often = keyed.where("key <> ''").groupBy("doc", "key", "page").agg(F.lit(1)).groupBy("doc", "key").agg(F.count(F.lit(1)).alias("on")).join(pages, "doc").where(F.col("on") >= F.greatest(F.lit(2), share * F.col("pages")))
    return keyed.join(often.select("doc", "key"), ["doc", "key"], "left_anti").drop("key")
