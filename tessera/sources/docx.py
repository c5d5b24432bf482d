"""Word documents to blocks and Markdown, from the ZIP parts alone; guarded against hostile archives."""

from __future__ import annotations

import base64
import io
import posixpath
import re
import xml.etree.ElementTree as ET
import zipfile
from dataclasses import dataclass

from tessera.sources.omml import M, to_latex

W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"
R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
A = "{http://schemas.openxmlformats.org/drawingml/2006/main}"
WP = "{http://schemas.openxmlformats.org/drawingml/2006/wordprocessingDrawing}"
_THROUGH = {W + x for x in ("sdt", "sdtContent", "ins", "moveTo", "smartTag", "customXml", "bdo", "dir", "fldSimple")}
_MAX_CELLS, _EMU = 1_000_000, 9525


class ArchiveLimit(ValueError):
    """An archive asks for more than the limits allow."""


@dataclass(frozen=True)
class Limits:
    members: int = 10_000
    member_bytes: int = 64 << 20
    total_bytes: int = 256 << 20
    ratio: float = 100.0
    elements: int = 2_000_000
    text_chars: int = 8 << 20


def guard(content: bytes, limits: Limits = Limits()) -> zipfile.ZipFile:
    """The opened archive, if its directory and XML parts keep the limits."""
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
    except zipfile.BadZipFile as e:
        raise ValueError("not a ZIP document") from e
    members = archive.infolist()
    if len(members) > limits.members:
        raise ArchiveLimit("too many members")
    if any(m.flag_bits & 1 for m in members):
        raise ValueError("encrypted archive")
    if any(m.file_size > limits.member_bytes for m in members) or sum(m.file_size for m in members) > limits.total_bytes:
        raise ArchiveLimit("too large when unpacked")
    if any(m.file_size > limits.ratio * max(1, m.compress_size) for m in members if m.file_size):
        raise ArchiveLimit("compressed too strongly")
    elements = chars = 0
    for m in members:
        if m.filename.endswith((".xml", ".rels")):
            with archive.open(m) as part:
                for _, node in ET.iterparse(part):
                    elements += 1
                    chars += len(node.text or "") + len(node.tail or "")
                    node.clear()
                    if elements > limits.elements or chars > limits.text_chars:
                        raise ArchiveLimit("too much XML")
    return archive


def _val(node: ET.Element | None, name: str = "val") -> str | None:
    return None if node is None else node.get(W + name)


def _on(node: ET.Element | None) -> bool | None:
    return None if node is None else _val(node) not in ("0", "false", "none", "off")


class _Package:
    def __init__(self, archive: zipfile.ZipFile):
        self.archive, self.names = archive, set(archive.namelist())
        self.document = self.xml("word/document.xml")
        self.rels = self._rels("word/document.xml")
        self.styles = {s.get(W + "styleId"): s for s in self.root("word/styles.xml").findall(W + "style")}
        numbering = self.root("word/numbering.xml")
        abstract = {a.get(W + "abstractNumId"): a for a in numbering.findall(W + "abstractNum")}
        self.numbers = {n.get(W + "numId"): abstract.get(_val(n.find(W + "abstractNumId"))) for n in numbering.findall(W + "num")}
        self.notes = {}
        for note in self.root("word/footnotes.xml").findall(W + "footnote"):
            if int(note.get(W + "id", "0")) > 0:
                self.notes[note.get(W + "id")] = "".join(t.text or "" for t in note.iter(W + "t")).strip()

    def xml(self, name: str) -> ET.Element | None:
        return ET.fromstring(self.archive.read(name)) if name in self.names else None

    def root(self, name: str) -> ET.Element:
        found = self.xml(name)
        return ET.Element("none") if found is None else found

    def _rels(self, part: str) -> dict[str, tuple[str, bool]]:
        folder, name = posixpath.split(part)
        out = {}
        for r in self.root(f"{folder}/_rels/{name}.rels"):
            outside = r.get("TargetMode") == "External"
            target = r.get("Target", "")
            out[r.get("Id")] = (target if outside else posixpath.normpath(posixpath.join(folder, target)).lstrip("/"), outside)
        return out

    def chain(self, style_id: str | None):
        """A style and those it is based on."""
        seen = set()
        while style_id in self.styles and style_id not in seen:
            seen.add(style_id)
            yield self.styles[style_id]
            style_id = _val(self.styles[style_id].find(W + "basedOn"))

    def level(self, num_id: str, level: int) -> ET.Element | None:
        abstract = self.numbers.get(num_id)
        return None if abstract is None else next((x for x in abstract.findall(W + "lvl") if x.get(W + "ilvl") == str(level)), None)


def _format(package: _Package, run: ET.Element, paragraph_style: str | None) -> tuple[bool, bool, bool]:
    """(bold, italic, strike): direct, then character styles (but the hyperlink one), then paragraph styles."""
    pr = run.find(W + "rPr")
    own = None if pr is None else _val(pr.find(W + "rStyle"))
    sources = [pr] + [s.find(W + "rPr") for s in package.chain(own) if (_val(s.find(W + "name")) or "").lower() != "hyperlink"] + [s.find(W + "rPr") for s in package.chain(paragraph_style)]
    out = []
    for tag in ("b", "i", "strike"):
        found = next((v for s in sources if s is not None and (v := _on(s.find(W + tag))) is not None), False)
        out.append(bool(found))
    return tuple(out)


def rich(text: str, bold: bool = False, italic: bool = False, strike: bool = False, url: str | None = None) -> str:
    """Markdown marks around the text, inside its outer white space."""
    core = text.strip()
    if not core:
        return text
    head, tail = text[: len(text) - len(text.lstrip())], text[len(text.rstrip()) :]
    for on, mark in ((strike, "~~"), (italic, "*"), (bold, "**")):
        core = f"{mark}{core}{mark}" if on else core
    return head + (f"[{core}]({url})" if url else core) + tail


def merge(segments: list[tuple]) -> list[tuple]:
    """Neighbours of one format as one segment; segments are (text, format...)."""
    out: list[tuple] = []
    for s in segments:
        if out and out[-1][1:] == s[1:]:
            out[-1] = (out[-1][0] + s[0], *s[1:])
        else:
            out.append(s)
    return out


class _Reader:
    def __init__(self, package: _Package):
        self.p, self.blocks, self.counters, self.images = package, [], {}, 0

    def inline(self, node: ET.Element, style: str | None, url: str | None = None):
        """Segments (text, bold, italic, strike, url, math) and image blocks of a paragraph, in order."""
        segments, images, fields = [], [], []
        def walk(parent, url):
            for child in parent:
                if child.tag in _THROUGH:
                    walk(child, url)
                elif child.tag == W + "hyperlink":
                    walk(child, self.p.rels.get(child.get(R + "id"), (url, True))[0])
                elif child.tag in (M + "oMath", M + "oMathPara"):
                    for math in [child] if child.tag == M + "oMath" else child.findall(M + "oMath"):
                        try:
                            text = to_latex(math)
                        except Exception:  # noqa: BLE001 - the formula's own text is better than none
                            text = "".join(t.text or "" for t in math.iter(M + "t"))
                        segments.append((text, False, False, False, None, True))
                elif child.tag == W + "r":
                    pr = child.find(W + "rPr")
                    if pr is not None and (_on(pr.find(W + "vanish")) or _on(pr.find(W + "webHidden"))):
                        continue
                    look = _format(self.p, child, style)
                    for x in child:
                        if x.tag == W + "fldChar":
                            kind = x.get(W + "fldCharType")
                            if kind == "begin":
                                fields.append(["", False])
                            elif kind == "separate" and fields:
                                fields[-1][1] = True
                            elif kind == "end" and fields:
                                fields.pop()
                        elif x.tag == W + "instrText" and fields:
                            fields[-1][0] += x.text or ""
                        elif x.tag in (W + "t", W + "tab", W + "br", W + "cr", W + "noBreakHyphen", W + "footnoteReference"):
                            if fields and not fields[-1][1]:
                                continue
                            link = url
                            if fields and (m := re.search(r'HYPERLINK\s+"([^"]+)"', fields[-1][0])):
                                link = m[1]
                            if x.tag == W + "footnoteReference":
                                note = self.p.notes.get(x.get(W + "id"))
                                text = f"（{note}）" if note else ""
                            else:
                                text = {W + "t": x.text or "", W + "tab": "\t", W + "noBreakHyphen": "-"}.get(x.tag, "\n")
                            if text:
                                segments.append((text, *look, link, False))
                        else:
                            images.extend(self.pictures(x))
        walk(node, url)
        return merge(segments), images

    def pictures(self, node: ET.Element):
        for blip in node.iter(A + "blip"):
            target, outside = self.p.rels.get(blip.get(R + "embed") or blip.get(R + "link"), ("", True))
            if outside or target not in self.p.names:
                continue
            self.images += 1
            extent, about = next(node.iter(WP + "extent"), None), next(node.iter(WP + "docPr"), None)
            size = lambda k: int(extent.get(k, "0")) // _EMU if extent is not None else 0
            yield {"type": "image", "id": f"image{self.images}", "name": posixpath.basename(target), "format": posixpath.splitext(target)[1].lstrip(".").lower(), "alt_text": about.get("descr", "") if about is not None else "", "width": size("cx"), "height": size("cy"), "content": base64.b64encode(self.p.archive.read(target)).decode()}

    @staticmethod
    def text(segments) -> str:
        return "".join(f"${t}$" if math else rich(t, b, i, s, url) for t, b, i, s, url, math in segments)

    def numbering(self, pr: ET.Element | None, style: str | None) -> tuple[str, int] | None:
        for source in [pr] + [s.find(W + "pPr") for s in self.p.chain(style)]:
            num = None if source is None else source.find(W + "numPr")
            if num is not None and (num_id := _val(num.find(W + "numId"))):
                return None if num_id == "0" else (num_id, int(_val(num.find(W + "ilvl")) or 0))
        return None

    def heading(self, style: str | None) -> int | None:
        for s in self.p.chain(style):
            name = (_val(s.find(W + "name")) or "").lower()
            if name == "title":
                return 1
            if m := re.match(r"heading\s*(\d+)$", name):
                return min(9, max(1, int(m[1])))
        return None

    def number(self, num_id: str, level: int) -> str:
        """The next heading number of a list: deeper levels start again."""
        counts = self.counters.setdefault(num_id, [0] * 9)
        def start(k):
            found = self.p.level(num_id, k)
            return int(_val(found.find(W + "start")) or 1) if found is not None and found.find(W + "start") is not None else 1
        counts[level] = counts[level] + 1 if counts[level] else start(level)
        counts[level + 1 :] = [0] * (8 - level)
        spec = self.p.level(num_id, level)
        form = _val(spec.find(W + "lvlText")) if spec is not None else None
        return re.sub(r"%(\d)", lambda m: str(counts[int(m[1]) - 1] or start(int(m[1]) - 1)), form or ".".join(f"%{k + 1}" for k in range(level + 1)))

    def paragraph(self, node: ET.Element) -> None:
        pr = node.find(W + "pPr")
        style = None if pr is None else _val(pr.find(W + "pStyle"))
        segments, images = self.inline(node, style)
        text = self.text(segments).strip()
        level, number = self.heading(style), self.numbering(pr, style)
        caption = any("SEQ" in (i.text or "") for i in node.iter(W + "instrText"))
        if level is None and number and text:
            self.item(text, *number)
        elif level is not None and text:
            block = {"type": "heading", "level": level, "content": text}
            if number:
                block["number"] = self.number(*number)
            self.blocks.append(block)
        elif len([s for s in segments if s[0].strip()]) == 1 and any(s[5] for s in segments):
            self.blocks.append({"type": "equation", "content": f"$${next(s[0] for s in segments if s[5])}$$"})
        elif text:
            self.blocks.append({"type": "caption" if caption else "text", "content": text})
        self.blocks += images

    def item(self, text: str, num_id: str, level: int) -> None:
        spec = self.p.level(num_id, level)
        form = _val(spec.find(W + "numFmt")) if spec is not None else "bullet"
        ordered = "ordered" if form in ("decimal", "decimalZero", "lowerRoman", "upperRoman", "lowerLetter", "upperLetter") else "unordered"
        last = self.blocks[-1] if self.blocks else None
        if not last or last["type"] != "list" or last["num_id"] != num_id:
            last = {"type": "list", "num_id": num_id, "attribute": ordered, "content": []}
            self.blocks.append(last)
        for _ in range(level):
            inner = last["content"][-1] if last["content"] else None
            if not inner or inner["type"] != "list":
                inner = {"type": "list", "num_id": num_id, "attribute": ordered, "content": []}
                last["content"].append(inner)
            last = inner
        last["content"].append({"type": "text", "content": text})

    def table(self, node: ET.Element) -> None:
        grid = node.find(W + "tblGrid")
        width = 0 if grid is None else len(grid.findall(W + "gridCol"))
        if not width:
            return
        rows, above = [], {}
        for tr in node.findall(W + "tr"):
            pr = tr.find(W + "trPr")
            gap = lambda tag: min(width, int(_val(pr.find(W + tag)) or 0)) if pr is not None and pr.find(W + tag) is not None else 0  # noqa: B023, E731
            row = [""] * gap("gridBefore")
            for tc in tr.findall(W + "tc"):
                cell = tc.find(W + "tcPr")
                span = max(1, int(_val(cell.find(W + "gridSpan")) or 1)) if cell is not None and cell.find(W + "gridSpan") is not None else 1
                if (len(rows) + 1) * max(width, len(row) + span) > _MAX_CELLS:
                    text = "\n".join(filter(None, ("".join(t.text or "" for t in p.iter(W + "t")).strip() for p in node.iter(W + "p"))))
                    self.blocks.append({"type": "caption", "content": f"[table too large] {text}"})
                    return
                merged = None if cell is None else cell.find(W + "vMerge")
                at = len(row)
                text = "\n".join(filter(None, (self.text(self.inline(p, None)[0]).strip() for p in tc.findall(W + "p"))))
                if merged is not None and _val(merged) != "restart":
                    text = above.get(at, "")
                above[at] = text
                row += [text] + [""] * (span - 1)
            rows.append(row + [""] * gap("gridAfter"))
        if not any(any(r) for r in rows):
            return
        wide = max(map(len, rows))
        rows = [r + [""] * (wide - len(r)) for r in rows]
        self.blocks.append({"type": "table", "rows": rows, "row_count": len(rows), "col_count": wide, "content": markdown_table(rows)})

    def body(self, node: ET.Element) -> None:
        for child in node:
            if child.tag == W + "p":
                self.paragraph(child)
            elif child.tag == W + "tbl":
                self.table(child)
            elif child.tag in _THROUGH:
                self.body(child)

    def margins(self) -> None:
        seen = set()
        for kind in ("header", "footer"):
            for ref in self.p.document.iter(f"{W}{kind}Reference"):
                part = self.p.xml(self.p.rels.get(ref.get(R + "id"), ("", True))[0])
                text = "\n".join(filter(None, ("".join(t.text or "" for t in p.iter(W + "t")).strip() for p in part.iter(W + "p")))) if part is not None else ""
                if text and not text.isnumeric() and (kind, text) not in seen:
                    seen.add((kind, text))
                    self.blocks.append({"type": kind, "content": text})


def markdown_table(rows: list[list[str]]) -> str:
    line = lambda r: "| " + " | ".join(c.replace("|", "\\|").replace("\n", "<br>") for c in r) + " |"
    return "\n".join([line(rows[0]), line(["---"] * len(rows[0])), *map(line, rows[1:])])


def blocks(content: bytes, limits: Limits = Limits()) -> list[dict]:
    """Blocks of a document in order, headers and footers last."""
    package = _Package(guard(content, limits))
    if package.document is None:
        raise ValueError("not a Word document")
    reader = _Reader(package)
    reader.body(package.document.find(W + "body"))
    reader.margins()
    return reader.blocks


def _list_lines(block: dict, depth: int = 0) -> list[str]:
    out = []
    for k, item in enumerate(block["content"], start=1):
        if item["type"] == "list":
            out += _list_lines(item, depth + 1)
        else:
            out.append("  " * depth + (f"{k}. " if block["attribute"] == "ordered" else "- ") + item["content"])
    return out


def block_markdown(b: dict) -> str:
    kind = b["type"]
    if kind == "heading":
        return "#" * min(6, max(1, b["level"])) + " " + " ".join(filter(None, (b.get("number"), b["content"])))
    if kind == "list":
        return "\n".join(_list_lines(b))
    if kind == "image":
        alt = b.get("alt_text") or b.get("name", "")
        return f"![{alt}](images/{b['id']}.{b['format']})" if b.get("format") in ("png", "jpg", "jpeg", "gif", "webp", "bmp") else f"[image: {alt}]"
    return b["content"]


def markdown(found: list[dict], margins: bool = False, images: bool = True) -> str:
    """Markdown of blocks, without headers and footers unless asked for."""
    skip = set() if margins else {"header", "footer"}
    skip |= set() if images else {"image"}
    return "\n\n".join(t for b in found if b["type"] not in skip and (t := block_markdown(b)))
