"""A Python data source for PDFs, with the standard library alone: ``spark.read.format("folio_pdf").load(glob)``.

Understands plain and Flate streams, object streams, page trees with inherited boxes, and the text operators of simple
fonts and of composite ones that say what their codes mean (ToUnicode); encrypted files are an error, anything else needs
a real parser, to be put in its place. One partition per file, one row per page, in the shape of schema.RAW_PAGES.
alt_text is a second reading: lines from top to bottom, whatever their order in the file. Metadata and embedded images
with their places come from ``info_of`` and ``images_of``.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Iterator

from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

from ..schema import RAW_IMAGES, RAW_PAGES

_OBJECT = re.compile(rb"(\d+)\s+(\d+)\s+obj\b(.*?)\bendobj", re.S)
_STREAM = re.compile(rb"stream\r?\n(.*?)\r?\n?endstream", re.S)
_NUMBER = rb"[-+]?\d*\.?\d+"
_TOKEN = re.compile(rb"\((?:\\.|[^\\()])*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/<>\[\]()]+|" + _NUMBER + rb"|[A-Za-z'\"*]+", re.S)
_ESCAPES = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f"}
INFO_KEYS = {"title": "Title", "author": "Author", "subject": "Subject", "keywords": "Keywords", "creator": "Creator", "producer": "Producer", "creationDate": "CreationDate", "modDate": "ModDate", "trapped": "Trapped"}


class Pdf:
    """The objects of a file."""

    def __init__(self, data: bytes):
        if not data.startswith(b"%PDF-"):
            raise ValueError("not a PDF")
        self.version = data[5:8].decode("latin-1")
        self.objects = {int(n): body for n, _, body in _OBJECT.findall(data)}
        packed = [n for n, body in self.objects.items() if re.search(rb"/Type\s*/ObjStm", body)]
        self.trailer = data[data.rfind(b"trailer") :] if b"trailer" in data else b""
        if not self.trailer:  # a cross-reference stream has the trailer's entries
            self.trailer = b"".join(b.split(b"stream")[0] for b in self.objects.values() if re.search(rb"/Type\s*/XRef", b))
        self.encrypted = b"/Encrypt" in self.trailer
        for n in packed if not self.encrypted else ():
            self._unpack(n)

    def _unpack(self, n: int) -> None:
        """Objects of an object stream: pairs of number and offset, then the objects."""
        head, data = self.objects[n].split(b"stream")[0], self.stream(n)
        first = re.search(rb"/First\s+(\d+)", head)
        if not first:
            return
        at = int(first[1])
        numbers = [int(x) for x in data[:at].split()]
        places = [*zip(numbers[::2], numbers[1::2], strict=False)]
        for (k, begin), (_, end) in zip(places, [*places[1:], (0, len(data) - at)], strict=True):
            self.objects.setdefault(k, data[at + begin : at + end])

    def ref(self, body: bytes, key: str) -> int | None:
        m = re.search(rb"/" + key.encode() + rb"\s+(\d+)\s+\d+\s+R", body)
        return int(m[1]) if m else None

    def stream(self, n: int) -> bytes:
        m = _STREAM.search(self.objects.get(n, b""))
        if not m:
            return b""
        return zlib.decompressobj().decompress(m[1]) if b"/FlateDecode" in self.objects[n][: m.start()] else m[1]

    def pages(self) -> list[tuple[int, bytes]]:
        """Page objects in order, each with its ancestors' entries behind its own."""
        root = self.ref(self.trailer, "Root")
        top = self.ref(self.objects.get(root, b""), "Pages") if root else None
        out: list[tuple[int, bytes]] = []
        todo, seen = [(top, b"")] if top else [], set()
        while todo:
            n, above = todo.pop(0)
            body = self.objects.get(n, b"")
            if n in seen:
                continue
            seen.add(n)
            kids = re.search(rb"/Kids\s*\[(.*?)\]", body, re.S)
            if kids:
                todo = [(int(k), body + above) for k in re.findall(rb"(\d+)\s+\d+\s+R", kids[1])] + todo
            else:
                out.append((n, body + above))
        return out

    def size(self, page: bytes) -> tuple[float, float]:
        m = re.search(rb"/MediaBox\s*\[\s*" + rb"\s+".join([rb"(" + _NUMBER + rb")"] * 4) + rb"\s*\]", page)
        x0, y0, x1, y1 = map(float, m.groups()) if m else (0, 0, 612, 792)
        return x1 - x0, y1 - y0

    def content(self, page: bytes) -> bytes:
        many = re.search(rb"/Contents\s*\[(.*?)\]", page, re.S)
        refs = [int(k) for k in re.findall(rb"(\d+)\s+\d+\s+R", many[1])] if many else [self.ref(page, "Contents")]
        return b"\n".join(self.stream(n) for n in refs if n)

    def fonts(self, page: bytes) -> dict[str, str]:
        found = re.search(rb"/Font\s*<<(.*?)>>", page, re.S)
        out = {}
        for name, n in re.findall(rb"/(\S+)\s+(\d+)\s+\d+\s+R", found[1]) if found else []:
            base = re.search(rb"/BaseFont\s*/([^\s/<>\[\]()]+)", self.objects.get(int(n), b""))
            out[name.decode("latin-1")] = base[1].decode("latin-1") if base else "Unknown"
        return out

    def cmaps(self, page: bytes) -> dict[str, tuple[int, dict[bytes, str]]]:
        """Of fonts that say so: bytes of a code, and the text of each code."""
        found = re.search(rb"/Font\s*<<(.*?)>>", page, re.S)
        out = {}
        for name, n in re.findall(rb"/(\S+)\s+(\d+)\s+\d+\s+R", found[1]) if found else []:
            at = self.ref(self.objects.get(int(n), b""), "ToUnicode")
            if at:
                out[name.decode("latin-1")] = code_map(self.stream(at))
        return out

    def xobjects(self, page: bytes) -> list[tuple[str, int]]:
        found = re.search(rb"/XObject\s*<<(.*?)>>", page, re.S)
        return [(a.decode("latin-1"), int(n)) for a, n in re.findall(rb"/(\S+)\s+(\d+)\s+\d+\s+R", found[1] if found else b"")]

    def info(self) -> dict[str, str | None]:
        body = self.objects.get(self.ref(self.trailer, "Info") or -1, b"")
        out: dict[str, str | None] = {"format": f"PDF {self.version}"}
        for key, name in INFO_KEYS.items():
            m = re.search(rb"/" + name.encode() + rb"\s*(\((?:\\.|[^\\()])*\))", body, re.S)
            out[key] = literal(m[1]) if m else ""
        return out | {"encryption": "Standard" if self.encrypted else None}


def code_map(data: bytes) -> tuple[int, dict[bytes, str]]:
    """Bytes of a code and the text of each code, from a ToUnicode stream."""
    text = lambda x: bytes.fromhex(x.decode()).decode("utf-16-be", "replace")
    out: dict[bytes, str] = {}
    for part in re.findall(rb"beginbfchar(.*?)endbfchar", data, re.S):
        for code, to in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>", part):
            out[bytes.fromhex(code.decode())] = text(to)
    for part in re.findall(rb"beginbfrange(.*?)endbfrange", data, re.S):
        for low, high, to, many in re.findall(rb"<([0-9A-Fa-f]+)>\s*<([0-9A-Fa-f]+)>\s*(?:<([0-9A-Fa-f]+)>|\[(.*?)\])", part, re.S):
            a, b, size = int(low, 16), int(high, 16), len(low) // 2
            each = [text(x) for x in re.findall(rb"<([0-9A-Fa-f]+)>", many)]
            for k in range(min(b - a + 1, 1 << 16)):
                if to:
                    begin = text(to)
                    out[(a + k).to_bytes(size, "big")] = begin[:-1] + chr(min(ord(begin[-1]) + k, 0x10FFFF))
                elif k < len(each):
                    out[(a + k).to_bytes(size, "big")] = each[k]
    return (len(next(iter(out))) if out else 1), out


def raw_string(token: bytes) -> bytes:
    """Bytes of a string token."""
    if token[:1] == b"<":
        digits = re.sub(rb"\s", b"", token[1:-1])
        return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode())
    return re.sub(rb"\\([0-7]{1,3}|\r?\n|.)", lambda m: bytes([int(m[1], 8) & 255]) if m[1][:1].isdigit() else _ESCAPES.get(m[1], b"" if m[1][-1:] == b"\n" else m[1]), token[1:-1], flags=re.S)


def literal(token: bytes, codes: tuple[int, dict[bytes, str]] | None = None) -> str:
    """Text of a string token, by a font's map of codes if it has one."""
    raw = raw_string(token)
    if codes and codes[1]:
        return "".join(codes[1].get(raw[k : k + codes[0]], "") for k in range(0, len(raw), codes[0]))
    return raw.decode("utf-16") if raw[:2] == b"\xfe\xff" else raw.decode("latin-1")


def lines_of(content: bytes, fonts: dict[str, str], height: float, cmaps: dict | None = None) -> list[list[dict]]:
    """Text blocks (one per BT ... ET) as lists of placed lines: text, font, size, x0, y0, x1, y1 from the top left."""
    blocks: list[list[dict]] = []
    stack: list[bytes] = []
    font, size, lead, x, y, line, codes = "Unknown", 12.0, 0.0, 0.0, 0.0, (0.0, 0.0), None
    for m in _TOKEN.finditer(content):
        t = m[0]
        if not t[:1].isalpha() and t not in (b"'", b'"'):
            stack.append(t)
            continue
        number = [float(s) for s in stack if re.fullmatch(_NUMBER, s)]
        strings = [literal(s, codes) for s in stack if s[:1] in b"(<"]
        if t == b"BT":
            blocks.append([])
            x = y = 0.0
            line = (0.0, 0.0)
        elif t == b"Tf" and number:
            size = number[-1]
            name = next((s[1:].decode("latin-1") for s in stack if s[:1] == b"/"), "")
            font, codes = fonts.get(name, "Unknown"), (cmaps or {}).get(name)
        elif t == b"TL" and number:
            lead = number[-1]
        elif t in (b"Td", b"TD") and len(number) >= 2:
            x, y = line = (line[0] + number[-2], line[1] + number[-1])
            lead = -number[-1] if t == b"TD" else lead
        elif t == b"Tm" and len(number) >= 6:
            x, y = line = (number[-2], number[-1])
        if t in (b"T*", b"'", b'"'):
            x, y = line = (line[0], line[1] - (lead or size * 1.2))
        if t in (b"Tj", b"TJ", b"'", b'"') and strings and blocks:
            text = "".join(strings)
            wide = 0.5 * size * len(text)
            blocks[-1].append({"text": text, "font": font, "size": size, "x0": x, "y0": height - y - size, "x1": x + wide, "y1": height - y})
            x += wide
        stack = []
    return [b for b in blocks if b]


def places_of(content: bytes, height: float) -> dict[str, tuple[float, float, float, float]]:
    """Where each external object is first drawn: the unit square under the matrix in force, from the top left."""
    stack: list[bytes] = []
    now, saved, out = (1.0, 0.0, 0.0, 1.0, 0.0, 0.0), [], {}
    for m in _TOKEN.finditer(content):
        t = m[0]
        if not t[:1].isalpha() and t not in (b"'", b'"'):
            stack.append(t)
            continue
        if t == b"q":
            saved.append(now)
        elif t == b"Q" and saved:
            now = saved.pop()
        elif t == b"cm":
            v = [float(x) for x in stack if re.fullmatch(_NUMBER, x)][-6:]
            if len(v) == 6:
                (a, b, c, d, e, f), (g, h, i, j, k, n) = v, now
                now = (a * g + b * i, a * h + b * j, c * g + d * i, c * h + d * j, e * g + f * i + k, e * h + f * j + n)
        elif t == b"Do" and stack and stack[-1][:1] == b"/":
            a, b, c, d, e, f = now
            xs, ys = (e, e + a, e + c, e + a + c), (f, f + b, f + d, f + b + d)
            out.setdefault(stack[-1][1:].decode("latin-1"), (min(xs), height - max(ys), max(xs), height - min(ys)))
        stack = []
    return out


def reading_order(blocks: list[list[dict]]) -> str:
    """Lines from top to bottom and left to right, those of one height on one line."""
    rows: dict[int, list[dict]] = {}
    for line in (x for b in blocks for x in b):
        rows.setdefault(round(line["y1"]), []).append(line)
    return "\n".join(" ".join(x["text"] for x in sorted(rows[y], key=lambda x: x["x0"])) for y in sorted(rows))


def page_rows(doc_id: str, data: bytes) -> Iterator[tuple]:
    """Rows of RAW_PAGES."""
    pdf = readable(data)
    for k, (_, page) in enumerate(pdf.pages()):
        width, height = pdf.size(page)
        blocks = lines_of(pdf.content(page), pdf.fonts(page), height, pdf.cmaps(page))
        raw = []
        for seq, lines in enumerate(blocks):
            place = (min(s["x0"] for s in lines), min(s["y0"] for s in lines), max(s["x1"] for s in lines), max(s["y1"] for s in lines))
            raw.append((seq, 0, place, [([(s["text"], s["font"], s["size"])],) for s in lines]))
        text = "\n".join(s["text"] for b in blocks for s in b)
        yield (doc_id, k + 1, width, height, text, reading_order(blocks), raw)


def readable(data: bytes) -> Pdf:
    pdf = Pdf(data)
    if pdf.encrypted:
        raise ValueError("encrypted PDF")
    return pdf


def image_rows(doc_id: str, data: bytes) -> Iterator[tuple]:
    """(doc_id, page_number, img_index, xref, format, place, bytes) of the images that pages refer to; place may be None."""
    pdf = readable(data)
    for k, (_, page) in enumerate(pdf.pages()):
        places = places_of(pdf.content(page), pdf.size(page)[1])
        for i, (name, n) in enumerate(pdf.xobjects(page)):
            body = pdf.objects.get(n, b"")
            if b"/Image" in body and (m := _STREAM.search(body)):
                yield (doc_id, k + 1, i, n, "jpeg" if b"/DCTDecode" in body else "png", places.get(name), m[1])


class PdfDataSource(DataSource):
    """Pages of PDF files. The path may be a file, a folder or a glob that the executors can open."""

    @classmethod
    def name(cls) -> str:
        return "folio_pdf"

    def schema(self):
        return RAW_PAGES

    def reader(self, schema) -> DataSourceReader:
        return PdfReader(self.options["path"])


class PdfReader(DataSourceReader):
    def __init__(self, path: str):
        self.path = path.removeprefix("file://")

    def partitions(self):
        import glob
        import os

        found = glob.glob(os.path.join(self.path, "*")) if os.path.isdir(self.path) else glob.glob(self.path)
        files = sorted(f for f in found if f.lower().endswith(".pdf"))
        if not files:
            raise FileNotFoundError(self.path)
        return [InputPartition(f) for f in files]

    def read(self, partition) -> Iterator[tuple]:
        with open(partition.value, "rb") as f:
            yield from page_rows(partition.value, f.read())


def register(spark: SparkSession) -> None:
    spark.dataSource.register(PdfDataSource)


def pages_of(files):
    """RAW_PAGES of (path, content) rows, for files that only Spark's readers reach.

    A file that can't be read has no page; ``info_of`` has a row with its error.
    """
    from ..runtime import ship

    ship(files.sparkSession)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    rows += list(page_rows(path, content))
                except (ValueError, zlib.error):
                    continue
            if rows:
                box = lambda b: dict(zip(("x0", "y0", "x1", "y1"), b, strict=True))
                shaped = [
                    (*r[:6], [{"raw_seq": s, "type": k, "bbox": box(b), "lines": [{"spans": [dict(zip(("text", "font", "size"), p, strict=True)) for p in line[0]]} for line in ls]} for s, k, b, ls in r[6]])
                    for r in rows
                ]
                yield pd.DataFrame(shaped, columns=RAW_PAGES.names)

    return files.select("path", "content").mapInPandas(run, RAW_PAGES)


def images_of(files):
    """RAW_IMAGES of (path, content) rows; the place of an image that no page draws is null."""
    from ..runtime import ship

    ship(files.sparkSession)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    box = lambda b: b and dict(zip(("x0", "y0", "x1", "y1"), b, strict=True))
                    rows += [(*r[:5], box(r[5]), r[6]) for r in image_rows(path, content)]
                except (ValueError, zlib.error):
                    continue
            if rows:
                yield pd.DataFrame(rows, columns=RAW_IMAGES.names)

    return files.select("path", "content").mapInPandas(run, RAW_IMAGES)


def info_of(files):
    """(doc_id, total_pages, metadata, error) of (path, content) rows; a file that can't be read has an error."""
    from ..runtime import ship

    ship(files.sparkSession)

    def run(batches):
        import pandas as pd

        for pdf in batches:
            rows = []
            for path, content in zip(pdf["path"], pdf["content"], strict=True):
                try:
                    one = Pdf(content)
                    rows.append((path, len(one.pages()), one.info(), "encrypted PDF" if one.encrypted else None))
                except (ValueError, zlib.error) as e:
                    rows.append((path, 0, {}, str(e)))
            yield pd.DataFrame(rows, columns=["doc_id", "total_pages", "metadata", "error"])

    return files.select("path", "content").mapInPandas(run, "doc_id string, total_pages int, metadata map<string,string>, error string")
