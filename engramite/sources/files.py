"""Document files: scans, text extraction by format, change checks, collections, marked-up notes."""

from __future__ import annotations

import io
import re
import zipfile
from collections.abc import Iterator
from html.parser import HTMLParser
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest file that is read, in bytes.
MOST_BYTES = 25 << 20


def scan(spark: SparkSession, root: str, extensions: list[str]) -> DataFrame:
    """(path, modified, size, content) of the files below a folder with one of the extensions, in either case."""
    ends = "|".join(re.escape(e.lstrip(".").lower()) for e in extensions)
    rows = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(root)
    return rows.where(F.lower("path").rlike(rf"\.({ends})$")).select("path", F.col("modificationTime").alias("modified"), F.col("length").alias("size"), "content")


class _Text(HTMLParser):
    def __init__(self) -> None:
        super().__init__(convert_charrefs=True)
        self.parts, self.hidden = [], 0

    def handle_starttag(self, tag, attrs):
        self.hidden += tag in ("script", "style")

    def handle_endtag(self, tag):
        self.hidden -= tag in ("script", "style") and self.hidden > 0

    def handle_data(self, data):
        if not self.hidden and data.strip():
            self.parts.append(data.strip())


def extract(name: str, content: bytes) -> tuple[str, str | None]:
    """(status, text): extracted, skipped_unsupported, skipped_too_large or error; never raises."""
    kind = name.rsplit(".", 1)[-1].lower()
    if len(content) > MOST_BYTES:
        return "skipped_too_large", None
    try:
        if kind in ("txt", "md"):
            return "extracted", content.decode("utf-8", "replace")
        if kind == "csv":
            import csv

            return "extracted", "\n".join(" ".join(row) for row in csv.reader(io.StringIO(content.decode("utf-8", "replace"))))
        if kind in ("html", "htm"):
            parser = _Text()
            parser.feed(content.decode("utf-8", "replace"))
            return "extracted", "\n".join(parser.parts)
        if kind == "xml":
            if b"<!DOCTYPE" in content or b"<!ENTITY" in content:
                return "error", None  # entity definitions are refused
            return "extracted", "\n".join(t.strip() for t in ElementTree.fromstring(content).itertext() if t.strip())
        if kind == "docx":
            with zipfile.ZipFile(io.BytesIO(content)) as parts:
                space = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
                tree = ElementTree.fromstring(parts.read("word/document.xml"))
                return "extracted", "\n".join("".join(t.text or "" for t in p.iter(f"{space}t")) for p in tree.iter(f"{space}p"))
    except Exception:
        return "error", None
    return "skipped_unsupported", None


def extract_texts(files: DataFrame) -> DataFrame:
    """(path, size, status, text) of scanned files."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            found = [extract(p, bytes(c)) for p, c in zip(frame["path"], frame["content"], strict=True)]
            yield pd.DataFrame({"path": frame["path"], "size": frame["size"], "status": [s for s, _ in found], "text": [t for _, t in found]})

    return files.select("path", "size", "content").mapInPandas(run, "path string, size long, status string, text string")


def changed(files: DataFrame, seen: DataFrame) -> DataFrame:
    """Files whose (path, modified, size) was not seen."""
    return files.join(seen.select("path", "modified", "size"), ["path", "modified", "size"], "left_anti")


def collections(spark: SparkSession, entries: list[dict]) -> DataFrame:
    """(name, path, scope, extensions, ocr) of a registry; refuses unknown scopes, missing extensions and repeated names."""
    rows = []
    for entry in entries:
        extensions = [e.lower().lstrip(".") for e in entry.get("extensions", []) if e.strip(". ")]
        if entry.get("scope") not in ("global", "restricted") or not extensions or not entry.get("name"):
            raise ValueError(f"not a collection: {entry}")
        rows.append((entry["name"], entry["path"], entry["scope"], extensions, bool(entry.get("ocr"))))
    if len({r[0] for r in rows}) < len(rows):
        raise ValueError("a collection's name occurs twice")
    return spark.createDataFrame(rows, "name string, path string, scope string, extensions array<string>, ocr boolean")


def notes(files: DataFrame, text: str = "text") -> DataFrame:
    """``files`` with front (map of the front matter) and sections (map of lower-case headings of two or three signs, blanks as underscores, to their bodies)."""
    body = F.regexp_replace(text, r"^---\r?\n(?s:.*?)\r?\n---\r?\n", "")
    head = F.regexp_extract(text, r"^---\r?\n((?s:.*?))\r?\n---\r?\n", 1)
    lines = F.filter(F.split(head, r"\r?\n"), lambda s: s.rlike("^[^:#]+:"))
    front = F.map_from_entries(F.transform(lines, lambda s: F.struct(F.trim(F.substring_index(s, ":", 1)), F.trim(F.regexp_replace(s, "^[^:]*:", "")))))
    parts = F.filter(F.split(F.concat(F.lit("\n"), body), r"\n(?=#{2,3} )"), lambda s: s.rlike("^#{2,3} "))
    section = F.map_from_entries(F.transform(parts, lambda s: F.struct(F.regexp_replace(F.lower(F.trim(F.regexp_extract(s, "^#{2,3} ([^\n]*)", 1))), " +", "_"), F.trim(F.regexp_replace(s, "^[^\n]*\n?", "")))))
    return files.withColumns({"front": front, "sections": section})


def kind_of(path):
    """handoff, handoff_yaml, plan, continuity or null, from a path."""
    handoff, note = F.contains(path, F.lit("handoffs")), F.endswith(path, F.lit(".md"))
    return F.when(handoff & path.rlike(r"\.ya?ml$"), "handoff_yaml").when(handoff & note, "handoff").when(F.contains(path, F.lit("plans")) & note, "plan").when(path.rlike("(^|/)CONTINUITY_CLAUDE-[^/]*$"), "continuity")
