"""Text of PDF files by their object graph.

Objects are found through the cross-reference chain (tables, streams and object streams), or by a scan where that is
broken; pages come in the order of the page tree, with the resources they inherit; codes become characters by a
font's ToUnicode map, else by its encoding. Text is given in the order it is shown. ``page_texts`` is the table
function's row source: a page a row, nothing is gathered over files.
"""

from __future__ import annotations

import re
import unicodedata
import zlib
from collections.abc import Callable, Iterator

_TOKEN = re.compile(rb"%[^\r\n]*|(?P<s>\()|<(?P<h>[0-9A-Fa-f\s]*)>|(?P<n>/[^\s()<>\[\]{}/%]*)|(?P<r>\d+\s+\d+\s+R\b)|(?P<d>[-+]?(?:\d+\.?\d*|\.\d+))|(?P<o><<|>>|[\[\]{}])|(?P<k>[^\s()<>\[\]{}/%]+)", re.S)
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r\n": b"", b"\r": b""}
#: Glyph names that no rule gives.
_GLYPHS = dict(space=" ", comma=",", period=".", hyphen="-", colon=":", semicolon=";", quotesingle="'", quotedbl='"', parenleft="(", parenright=")", slash="/", at="@", ampersand="&", plus="+", bullet="•", endash="–", emdash="—", quoteright="’", quoteleft="‘", quotedblleft="“", quotedblright="”", germandbls="ß", fi="fi", fl="fl", Euro="€", percent="%", underscore="_", exclam="!", question="?")
_ACCENTS = dict(acute="ACUTE", grave="GRAVE", circumflex="CIRCUMFLEX", dieresis="DIAERESIS", tilde="TILDE", caron="CARON", cedilla="CEDILLA", ring="RING ABOVE")
_CODECS = {"WinAnsiEncoding": "cp1252", "MacRomanEncoding": "mac_roman"}
MOST_STREAM, MOST_DEPTH = 64 << 20, 40


class Ref(int):
    """The number of another object."""


class Name(str):
    """A name, without its slash."""


def _string(data: bytes, at: int) -> tuple[bytes, int]:
    """A literal string whose opening parenthesis is before ``at``."""
    out, depth = [], 1
    for m in re.compile(rb"\\([0-7]{1,3}|\r\n|.)|([()])|[^\\()]+", re.S).finditer(data, at):
        if m[1]:
            out.append(bytes([int(m[1], 8) & 255]) if m[1][:1] in b"01234567" else _ESCAPED.get(m[1], m[1]))
            continue
        depth += (m[2] == b"(") - (m[2] == b")")
        if not depth:
            return b"".join(out), m.end()
        out.append(m[0])
    return b"".join(out), len(data)


def tokens(data: bytes, at: int = 0) -> Iterator[tuple[object, int]]:
    """Values and operators (as bytes) with the place after each."""
    while m := _TOKEN.search(data, at):
        at, value = m.end(), None
        if m["s"]:
            value, at = _string(data, at)
            yield (b"(", value), at
        elif m["h"] is not None:
            digits = re.sub(rb"\s", b"", m["h"])
            yield (b"(", bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())), at
        elif m["n"]:
            yield Name(re.sub(r"#([0-9A-Fa-f]{2})", lambda x: chr(int(x[1], 16)), m["n"][1:].decode("latin-1"))), at
        elif m["r"]:
            yield Ref(m["r"].split()[0]), at
        elif m["d"]:
            yield float(m["d"]) if b"." in m["d"] else int(m["d"]), at
        elif m["o"] or m["k"]:
            yield m["o"] or m["k"], at


def value_at(data: bytes, at: int) -> tuple[object, int]:
    """One value, with arrays and dictionaries built on a stack."""
    stack: list[list] = []
    for token, at in tokens(data, at):
        if token in (b"[", b"<<") and isinstance(token, bytes):
            stack.append([token])
            continue
        if token in (b"]", b">>") and isinstance(token, bytes):
            if not stack:
                return None, at
            kind, *items = stack.pop()
            token = items if kind == b"[" else {k: v for k, v in zip(items[::2], items[1::2]) if isinstance(k, str)}
        elif isinstance(token, tuple):
            token = token[1]
        elif isinstance(token, bytes):
            token = {b"true": True, b"false": False}.get(token)
        if not stack:
            return token, at
        stack[-1].append(token)
    return None, len(data)


class Pdf:
    """A file's objects, read when they are asked for."""

    def __init__(self, data: bytes) -> None:
        self.data, self.places, self.held, self.trailer = data, {}, {}, {}
        try:
            self._chain(int(re.findall(rb"startxref\s+(\d+)", data)[-1]))
            if not isinstance(self.get(self.trailer.get("Root")), dict):
                raise ValueError
        except (ValueError, IndexError, KeyError, TypeError, AttributeError, zlib.error):
            self._scan()

    def _chain(self, at: int) -> None:
        """The newest entry of an object holds."""
        seen = set()
        while at is not None and at not in seen:
            seen.add(at)
            if self.data[at : at + 4] == b"xref":
                body, _, rest = self.data[at + 4 :].partition(b"trailer")
                fields, k = body.split(), 0
                while k + 1 < len(fields):
                    first, count = int(fields[k]), int(fields[k + 1])
                    for n in range(count):
                        place, _, kind = fields[k + 2 + 3 * n : k + 5 + 3 * n]
                        if kind == b"n":
                            self.places.setdefault(first + n, int(place))
                    k += 2 + 3 * count
                trailer = value_at(rest, 0)[0]
            else:
                trailer, rows = self._object(at)
                widths, size = trailer["W"], sum(trailer["W"])
                index = trailer.get("Index") or [0, trailer["Size"]]
                numbers = [n for a, c in zip(index[::2], index[1::2]) for n in range(a, a + c)]
                for n, k in zip(numbers, range(0, len(rows), size)):
                    cut = [int.from_bytes(rows[k + sum(widths[:i]) : k + sum(widths[: i + 1])]) for i in range(3)]
                    kind = cut[0] if widths[0] else 1
                    if kind:
                        self.places.setdefault(n, cut[1] if kind == 1 else (cut[1], cut[2]))
            self.trailer = {**trailer, **self.trailer}
            at = trailer.get("Prev")

    def _scan(self) -> None:
        self.places = {int(m[1]): m.start() for m in re.finditer(rb"(?<!\d)(\d+)\s+\d+\s+obj\b", self.data)}
        self.held, self.trailer = {}, {}
        for n in list(self.places):
            found = self.get(Ref(n))
            if isinstance(found, tuple) and found[0].get("Type") == "ObjStm":
                for k in range(int(found[0].get("N", 0))):
                    inside = found[1].split(None, 2 * k + 1)
                    self.places.setdefault(int(inside[2 * k]), (n, k))
        self.held = {}
        for n in list(self.places):
            found = self.get(Ref(n))
            if isinstance(found, dict) and found.get("Type") == "Catalog":
                self.trailer["Root"] = Ref(n)
        if b"/Encrypt" in self.data:
            self.trailer["Encrypt"] = True

    def _object(self, at: int) -> tuple[dict, bytes] | object:
        """The object at a place: a value, or a dictionary and the decoded bytes of its stream."""
        head = re.compile(rb"\s*\d+\s+\d+\s+obj").match(self.data, at)
        if not head:
            raise ValueError("no object")
        found, end = value_at(self.data, head.end())
        begin = re.compile(rb"\s*stream\r?\n").match(self.data, end)
        if not (begin and isinstance(found, dict)):
            return found
        size = self.get(found.get("Length"))
        last = begin.end() + size if isinstance(size, int) else -1
        if last < 0 or not re.compile(rb"\s*endstream").match(self.data, last):
            last = self.data.find(b"endstream", begin.end())
        return found, self._decoded(self.data[begin.end() : last], found)

    def _decoded(self, raw: bytes, head: dict) -> bytes:
        filters, params = self.get(head.get("Filter")) or [], self.get(head.get("DecodeParms")) or {}
        for name in filters if isinstance(filters, list) else [filters]:
            if name in ("FlateDecode", "Fl"):
                raw = zlib.decompressobj().decompress(raw, MOST_STREAM)
            elif name in ("ASCIIHexDecode", "AHx"):
                raw = bytes.fromhex(re.sub(rb"[^0-9A-Fa-f]", b"", raw.split(b">")[0]).decode().ljust(2, "0"))
            else:
                return b""
        params = params[-1] if isinstance(params, list) and params else params
        if isinstance(params, dict) and params.get("Predictor", 1) >= 10:
            raw = _unpredicted(raw, params.get("Columns", 1) * params.get("Colors", 1) * params.get("BitsPerComponent", 8) // 8)
        return raw

    def get(self, value: object) -> object:
        """What a value refers to; references to what is not there are None."""
        for _ in range(MOST_DEPTH):
            if not isinstance(value, Ref):
                return value
            if value not in self.held:
                self.held[value] = None
                place = self.places.get(int(value))
                try:
                    if isinstance(place, tuple):
                        head, body = self.get(Ref(place[0]))
                        at = int(body.split(None, 2 * place[1] + 2)[2 * place[1] + 1])
                        self.held[value] = value_at(body, self.get(head["First"]) + at)[0]
                    elif place is not None:
                        self.held[value] = self._object(place)
                except (ValueError, KeyError, IndexError, TypeError, zlib.error):
                    pass
            value = self.held[value]
        return None

    def pages(self) -> Iterator[tuple[dict, dict]]:
        """Pages in the order of the tree, with their resources; each node once."""
        root = self.get(self.trailer.get("Root"))
        todo, seen = [(root.get("Pages"), {})] if isinstance(root, dict) else [], set()
        while todo:
            ref, inherited = todo.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or id(node) in seen:
                continue
            seen.add(id(node))
            resources = self.get(node.get("Resources")) or inherited
            kids = self.get(node.get("Kids"))
            if isinstance(kids, list):
                todo += [(k, resources) for k in reversed(kids)]
            else:
                yield node, resources

    def font(self, ref: object) -> Callable[[bytes], str]:
        """How a font's strings read."""
        font = self.get(ref)
        font = font if isinstance(font, dict) else {}
        mapped = self.get(font.get("ToUnicode"))
        encoding = self.get(font.get("Encoding"))
        if isinstance(mapped, tuple):
            return _by_map(*code_map(mapped[1]))
        if font.get("Subtype") == "Type0":
            return lambda raw: raw.decode("utf-16-be", "replace")
        base = encoding.get("BaseEncoding") if isinstance(encoding, dict) else encoding
        table = [bytes([c]).decode(_CODECS.get(base, "latin-1"), "replace") for c in range(256)]
        if isinstance(encoding, dict):
            code = 0
            for x in self.get(encoding.get("Differences")) or []:
                if isinstance(x, Name):
                    if code < 256:
                        table[code] = glyph(x)
                    code += 1
                elif isinstance(x, int):
                    code = x
        return lambda raw: "".join(table[c] for c in raw)


def _unpredicted(raw: bytes, width: int) -> bytes:
    """Rows of PNG predictors none, sub and up."""
    out, before = bytearray(), bytearray(width)
    for at in range(0, len(raw), width + 1):
        kind, row = raw[at], bytearray(raw[at + 1 : at + 1 + width].ljust(width, b"\0"))
        for k in range(width):
            row[k] = (row[k] + (before[k] if kind == 2 else row[k - 1] if kind == 1 and k else 0)) & 255
        out += row
        before = row
    return bytes(out)


def glyph(name: str) -> str:
    """A character by its glyph's name: a letter, uniXXXX, a digit's word, a letter with an accent, or a fixed one."""
    if len(name) == 1:
        return name
    if m := re.fullmatch(r"(?:uni|u)([0-9A-F]{4,6})", name):
        return chr(int(m[1], 16)) if int(m[1], 16) < 0x110000 else "�"
    letter, accent = name[0], _ACCENTS.get(name[1:])
    spoken = f"LATIN {'CAPITAL' if letter.isupper() else 'SMALL'} LETTER {letter.upper()} WITH {accent}" if accent else f"DIGIT {name.upper()}"
    try:
        return unicodedata.lookup(spoken)
    except KeyError:
        return _GLYPHS.get(name, "�")


def code_map(data: bytes) -> tuple[int, dict[int, str]]:
    """Bytes a code has, and the text of each code, of a ToUnicode map."""
    width, found, items = 1, {}, []
    text = lambda raw: raw.decode("utf-16-be", "replace")
    listed: list | None = None
    for token, _ in tokens(data):
        if isinstance(token, tuple):
            (items if listed is None else listed).append(token[1])
        elif token == b"[":
            listed = []
        elif token == b"]" and listed is not None:
            items.append(listed)
            listed = None
        elif isinstance(token, bytes):
            if token == b"endcodespacerange" and items and isinstance(items[0], bytes):
                width = max(1, len(items[0]))
            elif token == b"endbfchar":
                found |= {int.from_bytes(a): text(b) for a, b in zip(items[::2], items[1::2])}
            elif token == b"endbfrange":
                for low, high, to in zip(items[::3], items[1::3], items[2::3]):
                    first, last = int.from_bytes(low), min(int.from_bytes(high), int.from_bytes(low) + 0xFFFF)
                    for k in range(last - first + 1):
                        if isinstance(to, list):
                            found |= {first + k: text(to[k])} if k < len(to) else {}
                        else:
                            found[first + k] = text((int.from_bytes(to) + k).to_bytes(len(to) + 1)[1:])
            if token.startswith((b"begin", b"end")):
                items, listed = [], None
    return width, found


def _by_map(width: int, found: dict[int, str]) -> Callable[[bytes], str]:
    return lambda raw: "".join(found.get(int.from_bytes(raw[k : k + width]), "�") for k in range(0, len(raw), width))


def shown(pdf: Pdf, stream: bytes, resources: dict, depth: int = 0) -> Iterator[str]:
    """The texts that a content stream shows, with line ends where the line moves."""
    fonts, read, args = {}, lambda raw: raw.decode("latin-1"), []
    named = pdf.get(resources.get("Font")) or {}
    height = None
    depth_of_array: list | None = None
    for token, _ in tokens(stream):
        if token == b"[":
            depth_of_array = []
        elif token == b"]" and depth_of_array is not None:
            args.append(depth_of_array)
            depth_of_array = None
        elif not isinstance(token, bytes):
            (args if depth_of_array is None else depth_of_array).append(token)
        else:
            if token == b"Tf" and len(args) >= 2:
                if args[-2] not in fonts:
                    fonts[args[-2]] = pdf.font(named.get(args[-2]))
                read = fonts[args[-2]]
            elif token in (b"Tj", b"'", b'"') and args and isinstance(args[-1], tuple):
                yield ("\n" if token != b"Tj" else "") + read(args[-1][1])
            elif token == b"TJ" and args and isinstance(args[-1], list):
                yield "".join(read(x[1]) if isinstance(x, tuple) else " " if isinstance(x, (int, float)) and x < -200 else "" for x in args[-1])
            elif token in (b"T*", b"ET") or (token in (b"Td", b"TD") and len(args) >= 2 and args[-1] != 0):
                yield "\n"
            elif token == b"Tm" and len(args) >= 6:
                yield "\n" if height is not None and args[-1] != height else ""
                height = args[-1]
            elif token == b"Do" and args and depth < 5:
                form = pdf.get((pdf.get(resources.get("XObject")) or {}).get(args[-1]))
                if isinstance(form, tuple) and form[0].get("Subtype") == "Form":
                    yield from shown(pdf, form[1], pdf.get(form[0].get("Resources")) or resources, depth + 1)
            args, depth_of_array = [], None


def page_texts(data: bytes) -> Iterator[tuple[int, str]]:
    """page (from 1) and text. Encrypted files, and what is no PDF, raise ValueError."""
    if b"%PDF-" not in data[:1024]:
        raise ValueError("no PDF")
    pdf = Pdf(data)
    if "Encrypt" in pdf.trailer:
        raise ValueError("encrypted")
    for number, (page, resources) in enumerate(pdf.pages(), 1):
        parts = pdf.get(page.get("Contents"))
        streams = [pdf.get(p) for p in parts] if isinstance(parts, list) else [parts]
        body = b"\n".join(x[1] for x in streams if isinstance(x, tuple))
        yield number, re.sub(r"\n{2,}", "\n", "".join(shown(pdf, body, resources if isinstance(resources, dict) else {}))).strip("\n")
