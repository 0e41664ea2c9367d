"""Text of PDF pages with the standard library alone: objects, streams, fonts' Unicode maps and text operators.

Files without encryption, with plain or Flate streams, are read; objects are found by scanning, so that broken reference
tables do no harm. A page that is an image has no text.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

_BLANK = b" \t\r\n\x0c\x00"
_END = _BLANK + b"()<>[]{}/%"
_OBJECT = re.compile(rb"(?<!\d)(\d{1,10})\s+(\d{1,5})\s+obj\b")
_REFERENCE = re.compile(rb"(\d+)\s+(\d+)\s+R(?![A-Za-z])")
# Escapes of literal strings.
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}


class Name(str):
    """A name, or in a content stream an operator."""


class Reference(tuple):
    """Number of an indirect object."""


class Stream(dict):
    """A stream's dictionary, with its bytes as they are stored."""

    raw: bytes = b""


class _Parser:
    """Reads objects one after the other."""

    def __init__(self, data: bytes, at: int = 0):
        self.data, self.at = data, at

    def _skip(self) -> None:
        data, n = self.data, len(self.data)
        while self.at < n:
            c = data[self.at : self.at + 1]
            if c == b"%":
                ends = [x for x in (data.find(b"\n", self.at), data.find(b"\r", self.at)) if x >= 0]
                self.at = min(ends, default=n)
            elif c in _BLANK:
                self.at += 1
            else:
                return

    def _until(self, close: bytes) -> list:
        out = []
        while True:
            self._skip()
            if self.at >= len(self.data) or self.data.startswith(close, self.at):
                self.at += len(close)
                return out
            out.append(self.value())

    def value(self):  # noqa: ANN201
        """The next object; an operator comes as a ``Name`` that doesn't begin with a slash."""
        self._skip()
        data, at = self.data, self.at
        if at >= len(data):
            raise EOFError
        c = data[at : at + 1]
        if data.startswith(b"<<", at):
            self.at += 2
            items = self._until(b">>")
            return {str(k)[1:]: v for k, v in zip(items[::2], items[1::2], strict=False)}
        if c == b"<":
            end = data.find(b">", at)
            end = len(data) if end < 0 else end
            self.at = end + 1
            digits = re.sub(rb"[^0-9A-Fa-f]", b"", data[at:end])
            return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
        if c == b"[":
            self.at += 1
            return self._until(b"]")
        if c == b"(":
            return self._literal()
        if m := _REFERENCE.match(data, at):
            self.at = m.end()
            return Reference((int(m[1]),))
        end = at + 1
        while end < len(data) and data[end : end + 1] not in _END:
            end += 1
        self.at = end
        word = data[at:end].decode("latin-1")
        if word[0] == "/":
            return Name(re.sub("#([0-9A-Fa-f]{2})", lambda m: chr(int(m[1], 16)), word))
        try:
            return float(word) if "." in word else int(word)
        except ValueError:
            return Name(word)

    def _literal(self) -> bytes:
        data, out, depth = self.data, bytearray(), 1
        i = self.at + 1
        while i < len(data):
            c = data[i : i + 1]
            if c == b"\\":
                n = data[i + 1 : i + 2]
                if m := re.compile(rb"[0-7]{1,3}").match(data, i + 1):
                    out.append(int(m[0], 8) & 255)
                    i = m.end()
                    continue
                if n not in (b"\n", b"\r"):
                    out += _ESCAPES.get(n, n)
                i += 3 if data[i + 1 : i + 3] == b"\r\n" else 2
                continue
            depth += (c == b"(") - (c == b")")
            if not depth:
                break
            out += c
            i += 1
        self.at = i + 1
        return bytes(out)


class Document:
    """The objects of a file."""

    def __init__(self, data: bytes):
        if b"%PDF" not in data[:1024]:
            raise ValueError("no PDF")
        if b"/Encrypt" in data[-4096:]:
            raise ValueError("encrypted")
        self.data, self.known = data, {}
        self.places = {int(m[1]): m.end() for m in _OBJECT.finditer(data)}  # of a number that is there twice the last counts
        self.packed: dict[int, object] = {}
        for n in list(self.places):
            found = self.get(Reference((n,)))
            if isinstance(found, Stream) and found.get("Type") == "/ObjStm":
                body, first, count = self.body(found), int(self.get(found["First"])), int(self.get(found["N"]))
                head = [int(x) for x in body[:first].split()[: 2 * count]]
                for number, at in zip(head[::2], head[1::2], strict=True):
                    self.packed[number] = _Parser(body, first + at).value()

    def get(self, x):  # noqa: ANN001, ANN201
        """The object itself, where ``x`` refers to one."""
        hops = 0
        while isinstance(x, Reference) and hops < 20:
            n = x[0]
            if n not in self.known:
                self.known[n] = self._read(n)
            x, hops = self.known[n], hops + 1
        return x

    def _read(self, n: int):  # noqa: ANN202
        if n not in self.places:
            return self.packed.get(n)
        p = _Parser(self.data, self.places[n])
        value = p.value()
        p._skip()
        if isinstance(value, dict) and self.data.startswith(b"stream", p.at):
            at = p.at + 6
            at += 2 if self.data.startswith(b"\r\n", at) else 1
            size = self.get(value.get("Length"))
            end = at + size if isinstance(size, int) and self.data[at + size : at + size + 12].lstrip().startswith(b"endstream") else self.data.find(b"endstream", at)
            out = Stream(value)
            out.raw = self.data[at:end]
            return out
        return value

    def body(self, s: Stream) -> bytes:
        """The bytes of a stream, unpacked; none where it has a filter that isn't known."""
        filters = self.get(s.get("Filter")) or []
        data = s.raw
        for f in filters if isinstance(filters, list) else [filters]:
            if self.get(f) not in ("/FlateDecode", "/Fl"):
                return b""
            data = zlib.decompressobj().decompress(data)
        return data

    def pages(self) -> Iterator[dict]:
        """The pages in order, each with the resources it inherits."""
        every = (self.get(Reference((n,))) for n in [*self.places, *self.packed])
        root = next((x for x in every if isinstance(x, dict) and x.get("Type") == "/Catalog"), {})
        todo: list[tuple[object, object, int]] = [(root.get("Pages"), None, 0)]
        while todo:
            ref, resources, depth = todo.pop()
            node = self.get(ref)
            if not isinstance(node, dict) or depth > 50:
                continue
            resources = node.get("Resources", resources)
            if "Kids" in node:
                todo += [(k, resources, depth + 1) for k in reversed(self.get(node["Kids"]))]
            else:
                yield {**node, "Resources": resources}


def _units(b: bytes) -> str:
    return b.decode("utf-16-be", "replace")


class _Font:
    """Codes of a font as text."""

    def __init__(self, doc: Document, font: dict):
        self.size = 2 if font.get("Subtype") == "/Type0" else 1
        self.known: dict[int, str] = {}
        self.plain = self.size == 1
        encoding = doc.get(font.get("Encoding"))
        if isinstance(encoding, dict):
            at = 0
            for x in map(doc.get, doc.get(encoding.get("Differences")) or []):
                if isinstance(x, Name):
                    name = x[1:]
                    m = re.fullmatch("uni([0-9A-F]{4})", name)
                    if m or len(name) == 1:
                        self.known[at] = chr(int(m[1], 16)) if m else name
                    at += 1
                else:
                    at = int(x)
        cmap = doc.get(font.get("ToUnicode"))
        if isinstance(cmap, Stream):
            self._map(doc.body(cmap))

    def _map(self, data: bytes) -> None:
        stack: list = []
        parser = _Parser(data)
        try:
            while True:
                x = parser.value()
                if not isinstance(x, Name) or x.startswith("/"):
                    stack.append(x)
                    continue
                if x == "endcodespacerange" and stack and isinstance(stack[-1], bytes):
                    self.size = len(stack[-1])
                elif x == "endbfchar":
                    for code, to in zip(stack[::2], stack[1::2], strict=False):
                        self.known[int.from_bytes(code)] = _units(to)
                elif x == "endbfrange":
                    for low, high, to in zip(stack[::3], stack[1::3], stack[2::3], strict=False):
                        for k, code in enumerate(range(int.from_bytes(low), min(int.from_bytes(high), int.from_bytes(low) + 65535) + 1)):
                            if isinstance(to, list):
                                self.known[code] = _units(to[k]) if k < len(to) else ""
                            else:
                                text = _units(to)
                                self.known[code] = text[:-1] + chr(ord(text[-1]) + k) if text else ""
                stack = []
        except (EOFError, TypeError, ValueError):
            return

    def text(self, codes: bytes) -> str:
        out = []
        for i in range(0, len(codes), self.size):
            code = int.from_bytes(codes[i : i + self.size])
            out.append(self.known.get(code, bytes([code]).decode("cp1252", "replace") if self.plain and code < 256 else ""))
        return "".join(out)


def _shown(doc: Document, content: bytes, resources: dict, out: list[str], depth: int = 0) -> None:
    """Appends the text that a content stream shows; a move to another line is a line end."""
    fonts_at, forms = doc.get((resources or {}).get("Font")) or {}, doc.get((resources or {}).get("XObject")) or {}
    fonts: dict[str, _Font] = {}
    font, stack, line = None, [], None
    parser = _Parser(content)

    def say(codes: object) -> None:
        if font and isinstance(codes, bytes):
            out.append(font.text(codes))

    def move(y: float | None) -> None:
        nonlocal line
        if out and out[-1] != "\n" and (y is None or y != line):
            out.append("\n")
        line = y

    while True:
        try:
            x = parser.value()
        except EOFError:
            return
        if not isinstance(x, Name) or x.startswith("/"):
            stack.append(x)
            continue
        try:
            if x == "Tf":
                name = str(stack[-2])[1:]
                if name not in fonts:
                    fonts[name] = _Font(doc, doc.get(fonts_at.get(name)) or {})
                font = fonts[name]
            elif x == "Tj":
                say(stack[-1])
            elif x == "TJ":
                for part in stack[-1]:
                    if isinstance(part, (int, float)):
                        if part < -200 and out and not out[-1].endswith((" ", "\n")):
                            out.append(" ")
                    else:
                        say(part)
            elif x in ("Td", "TD"):
                if stack[-1]:
                    move((line or 0) + stack[-1])
                elif out and stack[-2] and not out[-1].endswith((" ", "\n")):
                    out.append(" ")
            elif x == "Tm":
                move(stack[-1])
            elif x in ("T*", "'", '"'):
                move(None)
                if x != "T*":
                    say(stack[-1])
            elif x == "ID":  # an image in the stream
                end = content.find(b"EI", parser.at)
                parser.at = len(content) if end < 0 else end + 2
            elif x == "Do" and depth < 8:
                form = doc.get(forms.get(str(stack[-1])[1:]))
                if isinstance(form, Stream) and form.get("Subtype") == "/Form":
                    _shown(doc, doc.body(form), doc.get(form.get("Resources")) or resources, out, depth + 1)
        except (IndexError, TypeError):
            pass
        stack = []


def read_pdf(data: bytes) -> list[str]:
    """The text of each page."""
    doc = Document(data)
    texts = []
    for page in doc.pages():
        parts = doc.get(page.get("Contents"))
        streams = [doc.get(p) for p in (parts if isinstance(parts, list) else [parts])]
        content = b"\n".join(doc.body(s) for s in streams if isinstance(s, Stream))
        out: list[str] = []
        _shown(doc, content, doc.get(page.get("Resources")) or {}, out)
        texts.append("".join(out))
    return texts
