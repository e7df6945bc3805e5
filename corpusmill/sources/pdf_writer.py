"""PDF files written without a library: a store of objects that knows their places, and pages that lines, ruled tables and figures flow onto."""

from __future__ import annotations

import itertools
import zlib
from dataclasses import dataclass, field

#: A4 in points, margins, and the distance of lines for a size of type.
PAGE, MARGIN, LEADING = (595, 842), 54, 1.35
FIGURE = 60


class Name(str):
    """A name object."""


@dataclass(frozen=True)
class Ref:
    """A reference to an object by its number."""

    number: int


def syntax(value) -> bytes:
    """A value as PDF writes it: dictionaries, arrays, names, references, numbers; bytes as a hexadecimal string."""
    match value:
        case dict():
            return b"<<" + b" ".join(syntax(Name(k)) + b" " + syntax(v) for k, v in value.items()) + b">>"
        case list() | tuple():
            return b"[" + b" ".join(map(syntax, value)) + b"]"
        case Name():
            return b"/" + value.encode()
        case Ref():
            return b"%d 0 R" % value.number
        case bytes():
            return b"<" + value.hex().encode() + b">"
    return f"{value:g}".encode()


class Store:
    """Objects by number; a number may be taken before its value is known, so that parents and children can refer to each other."""

    def __init__(self):
        self._values: list[bytes] = []

    def take(self) -> Ref:
        self._values.append(b"null")
        return Ref(len(self._values))

    def put(self, value, data: bytes | None = None, at: Ref | None = None) -> Ref:
        """Stores a value, or with data a stream whose dictionary it is, packed by deflate."""
        at = at or self.take()
        if data is None:
            self._values[at.number - 1] = syntax(value)
        else:
            packed = zlib.compress(data)
            head = syntax({**value, "Length": len(packed), "Filter": Name("FlateDecode")})
            self._values[at.number - 1] = head + b" stream\n" + packed + b"\nendstream"
        return at

    def file(self, root: Ref) -> bytes:
        """Head, objects in order, the table of their places, and where that table is."""
        chunks = [b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n"] + [b"%d 0 obj %b endobj\n" % (i, v) for i, v in enumerate(self._values, 1)]
        places = list(itertools.accumulate(map(len, chunks)))
        rows = ["0000000000 65535 f\r\n"] + [f"{p:010d} 00000 n\r\n" for p in places[:-1]]
        table = f"xref\n0 {len(rows)}\n{''.join(rows)}trailer ".encode()
        return b"".join([*chunks, table, syntax({"Size": len(rows), "Root": root}), b"\nstartxref\n%d\n%%%%EOF\n" % places[-1]])


@dataclass(frozen=True)
class Line:
    """A line of text; what doesn't fit the page's width is broken at blanks."""

    text: str
    size: float = 11
    bold: bool = False


@dataclass(frozen=True)
class Table:
    """Rows of cells with rules around them."""

    rows: list[list[str]]
    size: float = 10


@dataclass(frozen=True)
class Figure:
    """A grey picture with a caption under it."""

    caption: str = ""


@dataclass
class _Sheet:
    commands: list[bytes] = field(default_factory=list)
    y: float = PAGE[1] - MARGIN

    def say(self, x: float, y: float, size: float, bold: bool, text: str) -> None:
        font = Name("F2" if bold else "F1")
        self.commands.append(b"BT %b %g Tf 1 0 0 1 %g %g Tm %b Tj ET" % (syntax(font), size, x, y, syntax(text.encode("cp1252", "replace"))))

    def rule(self, *ends: float) -> None:
        self.commands.append(b"%g %g m %g %g l S" % ends)


def broken(text: str, size: float) -> list[str]:
    """Lines of a text; a letter counts half its size, which is about right for this type."""
    most, out = int((PAGE[0] - 2 * MARGIN) / (0.5 * size)), [""]
    for word in text.split(" "):
        if out[-1] and len(out[-1]) + 1 + len(word) > most:
            out.append(word)
        else:
            out[-1] = f"{out[-1]} {word}" if out[-1] else word
    return out


def write_pdf(pages: list[list[str | Line | Table | Figure]]) -> bytes:
    """Each list begins a page; what runs over goes on to another."""
    store = Store()
    tree, picture = store.take(), None
    fonts = {k: store.put({"Type": Name("Font"), "Subtype": Name("Type1"), "BaseFont": Name(n), "Encoding": Name("WinAnsiEncoding")}) for k, n in (("F1", "Helvetica"), ("F2", "Helvetica-Bold"))}
    sheets: list[_Sheet] = []

    def room(height: float) -> _Sheet:
        if sheets[-1].y - height < MARGIN:
            sheets.append(_Sheet())
        sheets[-1].y -= height
        return sheets[-1]

    for page in pages or [[]]:
        sheets.append(_Sheet())
        for item in page:
            if isinstance(item, str):
                item = Line(item)
            if isinstance(item, Line):
                for part in broken(item.text, item.size):
                    sheet = room(item.size * LEADING)
                    sheet.say(MARGIN, sheet.y, item.size, item.bold, part)
            elif isinstance(item, Table):
                columns = max(map(len, item.rows), default=0)
                width, height = (PAGE[0] - 2 * MARGIN) / max(columns, 1), item.size * 1.8
                for row in item.rows:
                    sheet = room(height)
                    for y in (sheet.y, sheet.y + height):
                        sheet.rule(MARGIN, y, MARGIN + columns * width, y)
                    for i in range(columns + 1):
                        sheet.rule(MARGIN + i * width, sheet.y, MARGIN + i * width, sheet.y + height)
                    for i, cell in enumerate(row):
                        sheet.say(MARGIN + i * width + 3, sheet.y + 0.4 * height, item.size, False, cell)
            else:
                picture = picture or store.put({"Type": Name("XObject"), "Subtype": Name("Image"), "Width": 1, "Height": 1, "ColorSpace": Name("DeviceGray"), "BitsPerComponent": 8}, b"\x99")
                sheet = room(FIGURE + 4)
                sheet.commands.append(b"q %g 0 0 %g %g %g cm /Im1 Do Q" % (2 * FIGURE, FIGURE, MARGIN, sheet.y))
                if item.caption:
                    sheet = room(11 * LEADING)
                    sheet.say(MARGIN, sheet.y, 11, False, item.caption)
    resources = store.put({"Font": fonts, **({"XObject": {"Im1": picture}} if picture else {})})
    kids = []
    for sheet in sheets:
        content = store.put({}, b"\n".join(sheet.commands))
        kids.append(store.put({"Type": Name("Page"), "Parent": tree, "MediaBox": [0, 0, *PAGE], "Resources": resources, "Contents": content}))
    store.put({"Type": Name("Pages"), "Kids": kids, "Count": len(kids)}, at=tree)
    return store.file(store.put({"Type": Name("Catalog"), "Pages": tree}))


def minimal_pdf(lines: list[str]) -> bytes:
    """One page, or as many as the lines need."""
    return write_pdf([list(lines)])


def markdown_pdf(text: str) -> bytes:
    """Headings, bullets and paragraphs of Markdown as a PDF; table rows and rules are left out, marks of emphasis go."""
    items: list[Line] = []
    for raw in text.split("\n"):
        line = raw.strip()
        plain = line.replace("**", "").replace("`", "")
        if not line or line.startswith("|") or set(line) <= set("-_* "):
            continue
        level = len(line) - len(line.lstrip("#"))
        if level and line[level : level + 1] == " ":
            items.append(Line(plain[level:].strip(), max(12, 20 - 3 * level), True))
        elif line[:2] in ("- ", "* "):
            items.append(Line(f"• {plain[2:].strip()}"))
        else:
            items.append(Line(plain))
    return write_pdf([items])
