"""Pages of PDF files as a data source of Spark: glyphs, drawings, pictures and sizes of pages, read from their content streams.

    spark.dataSource.register(PdfPages)
    spark.read.format("pdf_pages").option("table", "glyphs").load("file:///shelf")

``path`` is a file, or a folder with files that end in .pdf, at any depth. A file is cut into slices of its pages by its size; a task gets a slice, or
many of small files, reads a file's objects and interprets the streams of its own pages. Streams are stored or deflated; encrypted files and other
filters are refused. Objects are found where they stand in the file, the last of a number counts, so a damaged table of them does no harm.

Coordinates are points from the top left corner of a page. A glyph stands at its origin, one font size above the base line; its character is that
of the font's own table (ToUnicode), else of Latin text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

TABLES = {
    "glyphs": "file string, page int, seq int, x0 double, y0 double, font string, size double, color int, ch string",
    "drawings": "file string, page int, x0 double, y0 double, x1 double, y1 double, items int",
    "images": "file string, page int, x0 double, y0 double, x1 double, y1 double, name string",
    "pages": "file string, page int, width double, height double",
}
#: Bytes of a file for each of its slices, and of slices for each task; what opening one counts for; and tasks that small files are dealt to at least, unless
#: a task's share were less than some files.
SLICE, OPENED, TASKS, SOME = 4 << 20, 4 << 10, 64, 8

# Fixed values of the file format: what parts tokens, and tokens.
SPACE, APART = rb"\x00\t\n\f\r ", rb"\x00\t\n\f\r ()<>\[\]{}/%"
TOKEN = re.compile(rb"[" + SPACE + rb"]*(?:%[^\r\n]*[" + SPACE + rb"]*)*(?:(?P<number>[+-]?(?:\d+\.?\d*|\.\d+)(?=[" + APART + rb"]|$))|(?P<name>/[^" + APART + rb"]*)|(?P<mark><<|>>|\[|\]|\(|\{|\})|<(?P<hex>[0-9A-Fa-f" + SPACE + rb"]*)>|(?P<word>[^" + APART + rb"]+))")
REFERENCE = re.compile(rb"[" + SPACE + rb"]+(\d+)[" + SPACE + rb"]+R(?=[" + APART + rb"]|$)")
OBJECT = re.compile(rb"(?<![0-9])(\d+)[" + SPACE + rb"]+\d+[" + SPACE + rb"]+obj\b")
ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
CONSTANTS = {b"true": True, b"false": False, b"null": None}
END = object()


class Name(str):
    pass


class Word(bytes):
    """An operator."""


@dataclass(frozen=True)
class Reference:
    number: int


class Tokens:
    """Values of the format, one after another."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def value(self):
        found = TOKEN.match(self.data, self.at)
        if not found:
            self.at = len(self.data)
            return END
        self.at = found.end()
        kind = found.lastgroup
        text = found[kind]
        if kind == "number":
            if text.isdigit() and (other := REFERENCE.match(self.data, self.at)):
                self.at = other.end()
                return Reference(int(text))
            return float(text) if b"." in text else int(text)
        if kind == "name":
            return Name(re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), text[1:]).decode("latin-1"))
        if kind == "hex":
            digits = re.sub(rb"[" + SPACE + rb"]", b"", text)
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if kind == "word":
            return CONSTANTS[text] if text in CONSTANTS else Word(text)
        if text == b"(":
            return self._string()
        if text in (b"[", b"<<"):
            out = []
            while (x := self.value()) is not END and not (isinstance(x, Word) and x in (b"]", b">>")):
                out.append(x)
            return out if text == b"[" else dict(zip(out[::2], out[1::2], strict=False))
        return Word(text)

    def _string(self) -> bytes:
        out, deep = [], 1
        while self.at < len(self.data):
            c = self.data[self.at : self.at + 1]
            self.at += 1
            if c == b"\\":
                if octal := re.compile(rb"[0-7]{1,3}").match(self.data, self.at):
                    out.append(bytes([int(octal[0], 8) & 255]))
                    self.at = octal.end()
                    continue
                if broken := re.compile(rb"\r\n?|\n").match(self.data, self.at):
                    self.at = broken.end()
                    continue
                c = self.data[self.at : self.at + 1]
                self.at += 1
                out.append(ESCAPES.get(c, c))
                continue
            deep += (c == b"(") - (c == b")")
            if not deep:
                break
            out.append(c)
        return b"".join(out)


class Document:
    """Objects of a file by number, and its pages in order."""

    def __init__(self, data: bytes):
        self.data, self.places, self.packed, self.known = data, {}, {}, {}
        if re.search(rb"/Encrypt[" + SPACE + rb"]+\d", data):
            raise ValueError("encrypted files cannot be read")
        for found in OBJECT.finditer(data):
            self.places[int(found[1])] = found.end()
        for number in [n for n, at in self.places.items() if b"/ObjStm" in data[at : at + 400]]:
            held = self.get(Reference(number))
            if isinstance(held, dict) and held.get("Type") == "ObjStm":
                body, first = self.stream(held), self.get(held["First"])
                head = Tokens(body[:first])
                for _ in range(self.get(held["N"])):
                    inner, at = head.value(), head.value()
                    if inner not in self.places:
                        self.packed[inner] = (body, first + at)

    def get(self, x):
        """A value, followed to where it stands."""
        while isinstance(x, Reference):
            if x.number not in self.known:
                if x.number in self.places:
                    tokens = Tokens(self.data, self.places[x.number])
                    found = tokens.value()
                    begin = re.compile(rb"[" + SPACE + rb"]*stream\r?\n").match(self.data, tokens.at) if isinstance(found, dict) else None
                    if begin:
                        found["_begin"] = begin.end()
                    self.known[x.number] = found
                elif x.number in self.packed:
                    body, at = self.packed[x.number]
                    self.known[x.number] = Tokens(body, at).value()
                else:
                    return None
            x = self.known[x.number]
        return x

    def stream(self, held: dict) -> bytes:
        begin, size = held["_begin"], self.get(held.get("Length"))
        if not isinstance(size, int) or b"endstream" not in self.data[begin + size : begin + size + 20]:
            size = self.data.find(b"endstream", begin) - begin
        raw = self.data[begin : begin + size]
        filters = self.get(held.get("Filter")) or []
        for name in filters if isinstance(filters, list) else [filters]:
            if self.get(name) != "FlateDecode" or (self.get(held.get("DecodeParms")) or {}).get("Predictor", 1) != 1:
                raise ValueError(f"streams of kind {name} cannot be read")
            raw = zlib.decompressobj().decompress(raw)
        return raw

    def pages(self) -> list[dict]:
        """Pages with what they inherit."""
        roots = [x for n in (*self.places, *self.packed) if isinstance(x := self.get(Reference(n)), dict) and x.get("Type") == "Catalog"]
        out: list[dict] = []
        todo = [(roots[-1].get("Pages"), {})] if roots else []
        seen = set()
        while todo:
            where, inherited = todo.pop()
            node = self.get(where)
            if not isinstance(node, dict) or id(node) in seen:
                continue
            seen.add(id(node))
            own = inherited | {k: node[k] for k in ("Resources", "MediaBox") if k in node}
            if "Kids" in node:
                todo += [(kid, own) for kid in reversed(self.get(node["Kids"]) or [])]
            else:
                out.append(node | own)
        return out


class Font:
    """Characters and widths of a font's codes."""

    def __init__(self, document: Document, spec: dict):
        get = document.get
        self.name = re.sub(r"^[A-Z]{6}\+", "", str(get(spec.get("BaseFont")) or ""))
        self.bytes = 2 if get(spec.get("Subtype")) == "Type0" else 1
        self.first, self.widths = get(spec.get("FirstChar")) or 0, get(spec.get("Widths")) or []
        self.table: dict[int, str] = {}
        self.get = get
        table = get(spec.get("ToUnicode"))
        if isinstance(table, dict):
            self._read(document.stream(table))

    def _read(self, body: bytes) -> None:
        tokens, held = Tokens(body), []
        text = lambda raw: raw.decode("utf-16-be", "replace")
        while (x := tokens.value()) is not END:
            if not isinstance(x, Word):
                held.append(x)
                continue
            if x == b"endbfchar":
                for code, to in zip(held[::2], held[1::2], strict=False):
                    self.table[int.from_bytes(code, "big")] = text(to)
            elif x == b"endbfrange":
                for low, high, to in zip(held[::3], held[1::3], held[2::3], strict=False):
                    a, b = int.from_bytes(low, "big"), int.from_bytes(high, "big")
                    for i in range(b - a + 1):
                        self.table[a + i] = text(to[i]) if isinstance(to, list) else text(to[:-1] + bytes([(to[-1] + i) & 255]))
            held = []

    def codes(self, raw: bytes) -> Iterator[tuple[int, str, float]]:
        """Code, character and width in parts of the font size."""
        for i in range(0, len(raw) - self.bytes + 1, self.bytes):
            code = int.from_bytes(raw[i : i + self.bytes], "big")
            at = code - self.first
            width = self.get(self.widths[at]) if 0 <= at < len(self.widths) else 1000 if self.bytes == 2 else 500
            yield code, self.table.get(code) or (bytes([code]).decode("cp1252", "replace") if code < 256 else chr(code)), width / 1000


Matrix = tuple[float, float, float, float, float, float]
UNIT: Matrix = (1, 0, 0, 1, 0, 0)


def product(m: Matrix, n: Matrix) -> Matrix:
    """First ``m``, then ``n``."""
    return (m[0] * n[0] + m[1] * n[2], m[0] * n[1] + m[1] * n[3], m[2] * n[0] + m[3] * n[2], m[2] * n[1] + m[3] * n[3], m[4] * n[0] + m[5] * n[2] + n[4], m[4] * n[1] + m[5] * n[3] + n[5])


def _color(parts: list[float]) -> int:
    """Red, green and blue as one number, from one, three or four parts."""
    if len(parts) == 4:
        parts = [(1 - x) * (1 - parts[3]) for x in parts[:3]]
    red, green, blue = parts if len(parts) == 3 else [parts[0]] * 3 if parts else [0] * 3
    return (round(255 * red) << 16) + (round(255 * green) << 8) + round(255 * blue)


class Page:
    """What a page's streams draw: ``glyphs``, ``drawings`` and ``images`` as rows without file and page."""

    def __init__(self, document: Document, spec: dict):
        get = self.get = document.get
        self.document = document
        box = [float(get(x)) for x in get(spec.get("MediaBox")) or (0, 0, 612, 792)]
        self.left, self.top, self.width, self.height = box[0], box[3], box[2] - box[0], box[3] - box[1]
        self.glyphs: list[tuple] = []
        self.drawings: list[tuple] = []
        self.images: list[tuple] = []
        contents = get(spec.get("Contents")) or []
        streams = [get(x) for x in contents] if isinstance(contents, list) else [contents]
        self._run(b"\n".join(document.stream(x) for x in streams if isinstance(x, dict)), get(spec.get("Resources")) or {}, UNIT, 0)

    def _place(self, x: float, y: float, m: Matrix) -> tuple[float, float]:
        return m[0] * x + m[2] * y + m[4] - self.left, self.top - (m[1] * x + m[3] * y + m[5])

    def _run(self, body: bytes, resources: dict, base: Matrix, deep: int) -> None:
        get, tokens, held = self.get, Tokens(body), []
        fonts: dict[str, Font] = {}
        state = {"m": base, "font": None, "size": 1.0, "color": 0, "char": 0.0, "word": 0.0, "scale": 1.0, "rise": 0.0, "lead": 0.0}
        stack: list[dict] = []
        text = line = UNIT
        path: list[tuple[float, float]] = []
        items = 0

        def show(raw: bytes) -> None:
            nonlocal text
            font, size = state["font"], state["size"]
            if font is None:
                return
            for code, ch, width in font.codes(raw):
                m = product((size * state["scale"], 0, 0, size, 0, state["rise"]), product(text, state["m"]))
                tall = (m[2] ** 2 + m[3] ** 2) ** 0.5
                x, y = self._place(0, 0, m)
                self.glyphs.append((len(self.glyphs), x, y - tall, font.name, tall, state["color"], ch))
                step = (width * size + state["char"] + (state["word"] if code == 32 and font.bytes == 1 else 0)) * state["scale"]
                text = product((1, 0, 0, 1, step, 0), text)

        def follow(x: float, y: float) -> None:
            nonlocal text, line
            text = line = product((1, 0, 0, 1, x, y), line)

        while (x := tokens.value()) is not END:
            if not isinstance(x, Word):
                held.append(x)
                continue
            op, args, held = x.decode("latin-1"), held, []
            numbers = [a for a in args if isinstance(a, (int, float)) and not isinstance(a, bool)]
            if op == "q":
                stack.append(dict(state))
            elif op == "Q" and stack:
                state = stack.pop()
            elif op == "cm" and len(numbers) == 6:
                state["m"] = product(tuple(numbers), state["m"])
            elif op == "BT":
                text = line = UNIT
            elif op == "Tf" and len(args) == 2:
                if args[0] not in fonts:
                    spec = get((get(resources.get("Font")) or {}).get(args[0]))
                    fonts[args[0]] = Font(self.document, spec) if isinstance(spec, dict) else None
                state["font"], state["size"] = fonts[args[0]], float(args[1])
            elif op in ("Tc", "Tw", "Ts", "TL") and numbers:
                state[{"Tc": "char", "Tw": "word", "Ts": "rise", "TL": "lead"}[op]] = numbers[0]
            elif op == "Tz" and numbers:
                state["scale"] = numbers[0] / 100
            elif op in ("Td", "TD") and len(numbers) == 2:
                if op == "TD":
                    state["lead"] = -numbers[1]
                follow(*numbers)
            elif op == "Tm" and len(numbers) == 6:
                text = line = tuple(numbers)
            elif op == "T*":
                follow(0, -state["lead"])
            elif op in ("Tj", "'", '"') and args and isinstance(args[-1], bytes):
                if op == '"' and len(numbers) == 2:
                    state["word"], state["char"] = numbers
                if op != "Tj":
                    follow(0, -state["lead"])
                show(args[-1])
            elif op == "TJ" and args and isinstance(args[-1], list):
                for part in args[-1]:
                    if isinstance(part, bytes):
                        show(part)
                    elif isinstance(part, (int, float)):
                        text = product((1, 0, 0, 1, -part / 1000 * state["size"] * state["scale"], 0), text)
            elif op in ("g", "rg", "k", "sc", "scn") and len(numbers) in (1, 3, 4):
                state["color"] = _color(numbers)
            elif op == "re" and len(numbers) == 4:
                a, b, w, h = numbers
                path += [self._place(p, q, state["m"]) for p, q in ((a, b), (a + w, b), (a + w, b + h), (a, b + h))]
                items += 1
            elif op in ("m", "l", "c", "v", "y") and len(numbers) >= 2:
                path += [self._place(p, q, state["m"]) for p, q in zip(numbers[::2], numbers[1::2], strict=False)]
                items += op != "m"
            elif op == "h":
                items += bool(path)
            elif op in ("S", "s", "f", "F", "f*", "B", "B*", "b", "b*", "n"):
                if path and op != "n":
                    items += op in ("s", "b", "b*")
                    xs, ys = zip(*path, strict=True)
                    self.drawings.append((min(xs), min(ys), max(xs), max(ys), items))
                path, items = [], 0
            elif op == "BI":  # a picture within the stream
                end = re.compile(rb"[" + SPACE + rb"]EI(?=[" + SPACE + rb"]|$)").search(body, tokens.at)
                tokens.at = end.end() if end else len(body)
                self._picture("", state["m"])
            elif op == "Do" and args:
                held_ = get((get(resources.get("XObject")) or {}).get(args[0]))
                if isinstance(held_, dict) and get(held_.get("Subtype")) == "Image":
                    self._picture(str(args[0]), state["m"])
                elif isinstance(held_, dict) and "_begin" in held_ and deep < 10:
                    own = tuple(float(get(v)) for v in get(held_.get("Matrix")) or UNIT)
                    self._run(self.document.stream(held_), get(held_.get("Resources")) or resources, product(own, state["m"]), deep + 1)

    def _picture(self, name: str, m: Matrix) -> None:
        xs, ys = zip(*(self._place(p, q, m) for p in (0, 1) for q in (0, 1)), strict=True)
        self.images.append((min(xs), min(ys), max(xs), max(ys), name))


@dataclass
class Slice(InputPartition):
    """What a task reads: of each file its path, and which of how many parts of its pages."""

    held: list[tuple[str, int, int]]


def dealt(sizes: list[tuple[str, int]]) -> list[Slice]:
    """Files (path, bytes) cut and put together: as many tasks as their bytes need, however many files there are."""
    cut = [((path, i, n), size / n + OPENED) for path, size in sizes for n in [max(1, -(-size // SLICE))] for i in range(n)]
    share = min(SLICE, max(sum(size for _, size in cut) / TASKS, SOME * OPENED))
    out, held, filled = [], [], 0.0
    for one, size in cut:
        if held and filled + size > share:
            out.append(Slice(held))
            held, filled = [], 0.0
        held.append(one)
        filled += size
    return out + [Slice(held)] * bool(held)


class Reader(DataSourceReader):
    def __init__(self, options: dict):
        self.path, self.table = options["path"], options.get("table", "glyphs")

    def partitions(self) -> list[Slice]:
        """Slices by the sizes of files; none is opened here."""
        from pyarrow import fs

        store, at = fs.FileSystem.from_uri(self.path)
        info = store.get_file_info(at)
        found = store.get_file_info(fs.FileSelector(at, recursive=True)) if info.type == fs.FileType.Directory else [info]
        return dealt(sorted((x.path, x.size) for x in found if x.type == fs.FileType.File and (x.path == at or x.path.lower().endswith(".pdf"))))

    def read(self, part: Slice) -> Iterator[tuple]:
        from pyarrow import fs

        store, _ = fs.FileSystem.from_uri(self.path)
        for path, place, of in part.held:
            with store.open_input_file(path) as source:
                document = Document(source.read())
            pages = document.pages()
            for number in range(len(pages) * place // of, len(pages) * (place + 1) // of):
                page = Page(document, pages[number])
                rows = [(page.width, page.height)] if self.table == "pages" else getattr(page, self.table)
                for row in rows:
                    yield (path, number, *row)


class PdfPages(DataSource):
    """See the module."""

    @classmethod
    def name(cls) -> str:
        return "pdf_pages"

    def schema(self) -> str:
        table = self.options.get("table", "glyphs")
        if table not in TABLES:
            raise ValueError(f"no table {table}; there are {', '.join(TABLES)}")
        return TABLES[table]

    def reader(self, schema) -> Reader:
        return Reader(dict(self.options))
