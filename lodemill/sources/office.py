"""Word, Excel and PowerPoint files of the Open XML kind, from their zip archives. Older binary files are refused."""

from __future__ import annotations

import io
import re
import zipfile
from datetime import datetime, timedelta
from xml.etree import ElementTree

OLE = b"\xd0\xcf\x11\xe0"
#: Number formats of a workbook that are dates.
DATE_FORMATS = frozenset((*range(14, 23), *range(45, 48)))


class Unsupported(ValueError):
    """A file that is not of the Open XML kind."""


def _open(content: bytes) -> zipfile.ZipFile:
    if content[:4] == OLE:
        raise Unsupported("an older binary office file")
    if content[:2] != b"PK":
        raise Unsupported("not an office file")
    return zipfile.ZipFile(io.BytesIO(content))


def _name(e: ElementTree.Element) -> str:
    return e.tag.rsplit("}", 1)[-1]


def _all(root: ElementTree.Element, name: str) -> list[ElementTree.Element]:
    return [e for e in root.iter() if _name(e) == name]


def _xml(archive: zipfile.ZipFile, path: str) -> ElementTree.Element | None:
    return ElementTree.fromstring(archive.read(path)) if path in archive.namelist() else None


def _properties(archive: zipfile.ZipFile) -> dict[str, str]:
    root = _xml(archive, "docProps/core.xml")
    return {} if root is None else {_name(e): e.text for e in root if e.text}


def _numbered(archive: zipfile.ZipFile, pattern: str) -> list[str]:
    found = [(int(m[1]), n) for n in archive.namelist() if (m := re.fullmatch(pattern, n))]
    return [n for _, n in sorted(found)]


def read_word(content: bytes) -> tuple[str, dict[str, str]]:
    """Paragraphs, one a line, and the core properties."""
    with _open(content) as archive:
        root = _xml(archive, "word/document.xml")
        if root is None:
            raise Unsupported("not a Word file")
        lines = []
        for p in _all(root, "p"):
            parts = [(e.text or "") if _name(e) == "t" else "\t" if _name(e) == "tab" else "\n" for e in p.iter() if _name(e) in ("t", "tab", "br")]
            lines.append("".join(parts))
        return "\n".join(lines), _properties(archive)


def read_powerpoint(content: bytes) -> tuple[str, dict[str, str]]:
    """A head for each slide and the text of its shapes that are not blank, and the number of slides."""
    with _open(content) as archive:
        slides = _numbered(archive, r"ppt/slides/slide(\d+)\.xml")
        out = []
        for k, path in enumerate(slides, 1):
            out.append(f"--- Slide {k} ---")
            for shape in _all(_xml(archive, path), "sp"):
                text = "\n".join("".join(t.text or "" for t in _all(p, "t")) for p in _all(shape, "p"))
                out += [text] if text.strip() else []
        return "\n".join(out), _properties(archive) | {"slideCount": str(len(slides))}


def _cell(c: ElementTree.Element, shared: list[str], dates: list[bool]) -> str:
    kind = c.get("t", "n")
    value = next((e.text or "" for e in c if _name(e) == "v"), "")
    if kind == "s":
        return shared[int(value)] if value else ""
    if kind == "inlineStr":
        return "".join(t.text or "" for t in _all(c, "t"))
    if kind == "b":
        return "true" if value == "1" else "false"
    if kind in ("str", "e") or not value:
        return value or next(("=" + (e.text or "") for e in c if _name(e) == "f"), "")
    if int(c.get("s", 0)) < len(dates) and dates[int(c.get("s", 0))]:
        return (datetime(1899, 12, 30) + timedelta(days=float(value))).isoformat()
    number = float(value)
    return str(int(number)) if number.is_integer() else str(number)


def read_excel(content: bytes) -> tuple[str, dict[str, str]]:
    """Every sheet under its name: cells apart by tabs, rows by line ends."""
    with _open(content) as archive:
        book = _xml(archive, "xl/workbook.xml")
        if book is None:
            raise Unsupported("not an Excel file")
        names = [s.get("name", "") for s in _all(book, "sheet")]
        strings = _xml(archive, "xl/sharedStrings.xml")
        shared = [] if strings is None else ["".join(t.text or "" for t in _all(s, "t")) for s in _all(strings, "si")]
        styles = _xml(archive, "xl/styles.xml")
        formats = [] if styles is None else [int(x.get("numFmtId", 0)) for g in _all(styles, "cellXfs") for x in g]
        dates = [f in DATE_FORMATS for f in formats]
        out = []
        for name, path in zip(names, _numbered(archive, r"xl/worksheets/sheet(\d+)\.xml"), strict=False):
            out.append(f"=== Sheet: {name} ===")
            out += ["\t".join(_cell(c, shared, dates) for c in _all(r, "c")) for r in _all(_xml(archive, path), "row")]
        return "\n".join(out), _properties(archive) | {"sheetCount": str(len(names))}
