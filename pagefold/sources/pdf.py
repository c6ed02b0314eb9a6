"""The bytes of PDF files: unencrypted ones, Flate or plain streams, simple font encodings.

What is per page or per file and nothing else; documents.py makes lines and texts, numbers objects and deals pages in Spark.
Files of other kinds raise ValueError, which the Spark side turns into a status row.
"""

import re
import zlib

from pagefold.functions.drawing import MORE_CHARACTERS, OTHER_CHARACTERS

_OBJECT = re.compile(rb"(\d+)\s+\d+\s+obj\b(.*?)\bendobj\b", re.S)
_STREAM = re.compile(rb"(.*?)\bstream\r?\n(.*)", re.S)
_REF = r"(\d+)\s+\d+\s+R"
_TOKEN = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)|<[0-9A-Fa-f\s]*>|\[|\]|/[^\s/\[\]()<>]*|[^\s/\[\]()<>]+", re.S)
_TOKEN_STRING = re.compile(rb"\((?:[^()\\]|\\.|\((?:[^()\\]|\\.)*\))*\)", re.S)
_ESCAPE = re.compile(rb"\\([0-7]{1,3}|\r?\n|.)", re.S)
_ESCAPED = {b"n": b"\n", b"r": b"\r", b"t": b"\t", b"b": b"\b", b"f": b"\f", b"\n": b"", b"\r\n": b""}


def _objects(raw: bytes) -> dict[int, tuple[bytes, bytes | None]]:
    """Dictionary text and stream of each object, those in object streams too; the last definition counts."""
    out: dict[int, tuple[bytes, bytes | None]] = {}
    for m in _OBJECT.finditer(raw):
        head, data = m[2], None
        if s := _STREAM.match(head):
            head, data = s[1], s[2]
            if n := re.search(rb"/Length\s+(\d+)(?!\s+\d+\s+R)", head):
                data = data[: int(n[1])]
            else:
                data = re.sub(rb"\r?\n?endstream.*$", b"", data, flags=re.S)
            if b"/FlateDecode" in head:
                data = zlib.decompressobj().decompress(data)
            elif b"/Filter" in head:
                data = None
        out[int(m[1])] = (head.strip(), data)
    for head, data in list(out.values()):
        if b"/ObjStm" in head and data is not None:
            n, first = (int(re.search(rb"/" + k + rb"\s+(\d+)", head)[1]) for k in (b"N", b"First"))
            numbers = list(map(int, data[:first].split()[: 2 * n]))
            ends = [*numbers[3::2], len(data) - first]
            for number, a, b in zip(numbers[::2], numbers[1::2], ends, strict=True):
                out.setdefault(number, (data[first + a : first + b].strip(), None))
    return out


def _unescape(text: bytes) -> str:
    def one(m):
        return bytes([int(m[1], 8) & 255]) if m[1].isdigit() and m[1] < b"8" else _ESCAPED.get(m[1], m[1])

    return _ESCAPE.sub(one, text).decode("cp1252", "replace")


def _string(token: bytes) -> str:
    if token[:1] == b"(":
        return _unescape(token[1:-1])
    digits = re.sub(rb"\s", b"", token[1:-1])
    return bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()).decode("cp1252", "replace")


def shown(content: bytes) -> list[dict]:
    """y (downwards), x and text of the strings that a content stream shows."""
    out: list[dict] = []
    stack: list = []
    a, line, leading = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0], [0.0, 0.0], 0.0
    depth = 0
    for m in _TOKEN.finditer(content):
        t = m[0]
        if t[:1] in b"(<[]/" or re.fullmatch(rb"[+-]?(\d+\.?\d*|\.\d+)", t):
            depth += (t == b"[") - (t == b"]")
            stack.append(t)
            continue
        number = lambda k: float(stack[k])
        if t in (b"Td", b"TD"):
            line = [line[0] + number(-2), line[1] + number(-1)]
            leading = -number(-1) if t == b"TD" else leading
        elif t == b"TL":
            leading = number(-1)
        elif t == b"Tm":
            a, line = [number(k) for k in range(-6, 0)], [0.0, 0.0]
        elif t == b"BT":
            a, line = [1.0, 0.0, 0.0, 1.0, 0.0, 0.0], [0.0, 0.0]
        elif t in (b"T*", b"'", b'"'):
            line = [line[0], line[1] - leading]
        if t in (b"Tj", b"'", b'"', b"TJ"):
            text = "".join(_string(x) for x in stack if x[:1] in b"(<")
            out.append({"y": -round(a[1] * line[0] + a[3] * line[1] + a[5], 1), "x": a[0] * line[0] + a[2] * line[1] + a[4], "text": text})
        stack = []
    return out


#: Marks pages that name no fonts but those that page_objects() gives them.
OWN = b"/PagefoldFonts true"
_NAMED = re.compile(rb"/[^\s/\[\]()<>]+\s+(?:[-+.\d]+\s+Tf|Do|gs|cs|CS|sh|scn|SCN|ri|BDC|DP)\b")
_OWN_NAMED = re.compile(rb"/[^\s/\[\]()<>]+\s+(?:Do|gs|cs|CS|sh|scn|SCN|ri|BDC|DP)\b")


def loss(head: bytes, content: bytes, moved: bool) -> str | None:
    """Why a page can't be written again from its content alone, or null if it can."""
    if moved or re.search(rb"/Rotate\s+-?0*[1-9]", head):
        return "the page is turned or its origin is moved"
    if m := (_OWN_NAMED if OWN in head else _NAMED).search(re.sub(_TOKEN_STRING, b"", content)):
        return f"the page has a resource of its own: {m[0].split()[0].decode('latin-1')}"
    return None


def read(raw: bytes) -> list[dict]:
    """page_no, width, height, shown, payload (the content) and loss of each page in order."""
    if b"%PDF-" not in raw[:1024]:
        raise ValueError("Error: End-of-File, expected line")
    if b"/Encrypt" in raw:
        raise ValueError("encrypted files are not read")
    objects = _objects(raw)
    refs = lambda text, key: [int(x) for x in re.findall(_REF.encode(), re.search(rb"/" + key + rb"\s*(\[.*?\]|\d+\s+\d+\s+R)", text, re.S)[1])] if re.search(rb"/" + key + rb"\s*(\[|\d)", text) else []
    roots = [h for h, _ in objects.values() if re.search(rb"/Type\s*/Catalog\b", h)]
    if not roots or not (top := refs(roots[-1], b"Pages")):
        raise ValueError("no page tree")
    out: list[dict] = []
    todo, seen = [(top[0], (612.0, 792.0, b""))], set()
    while todo:
        number, box = todo.pop()
        if number in seen or number not in objects:
            continue
        seen.add(number)
        head = objects[number][0]
        if m := re.search(rb"/MediaBox\s*\[([^\]]*)\]", head):
            x0, y0, x1, y1 = map(float, m[1].split())
            box = (x1 - x0, y1 - y0, b"moved" if x0 or y0 else b"")
        if turned := re.search(rb"/Rotate\s+-?\d+", head):
            box = (*box[:2], box[2].split(b"/")[0] + turned[0])
        if re.search(rb"/Type\s*/Pages\b", head):
            todo += [(k, box) for k in reversed(refs(head, b"Kids"))]
        else:
            content = b"\n".join(objects[k][1] or b"" for k in refs(head, b"Contents") if k in objects)
            out.append({"page_no": len(out) + 1, "width": box[0], "height": box[1], "shown": shown(content), "payload": content, "loss": loss(head + box[2], content, box[2].startswith(b"moved"))})
    return out


def _literal(text: str) -> bytes:
    return b"(" + re.sub(rb"([()\\])", rb"\\\1", text.encode("cp1252", "replace")) + b")"


def _shown(text: str, font: str) -> bytes:
    """A drawn text; what the font lacks is not changed but fails."""
    for c in text:
        if not (" " <= c <= "~" or "\xa0" <= c <= "\xff" or c in MORE_CHARACTERS) or font in OTHER_CHARACTERS:
            raise ValueError(f"U+{ord(c):04X} is not available in the font {font}")
    return _literal(text)


def _drawn(o: dict, images: list[bytes]) -> bytes:
    n = lambda *v: " ".join(f"{float(x):.4f}".rstrip("0").rstrip(".") for x in v).encode()
    rgb = int(o.get("rgb") or 0)
    colour = n(*((rgb >> k & 255) / 255 for k in (16, 8, 0))) + b" rg "
    if o["kind"] == "rect":
        return b"q " + colour + n(o["x"], o["y"], o["w"], o["h"]) + b" re f Q"
    if o["kind"] == "image":
        if o["image"] is None:
            raise ValueError("the image is missing")
        images.append(o["image"])
        return b"q " + n(o["w"], 0, 0, o["h"], o["x"], o["y"]) + f" cm /I{len(images)} Do Q".encode()
    matrix = o.get("matrix") if o.get("matrix") is not None else (1, 0, 0, 1, o["x"], o["y"])
    return b"q " + colour + b"BT /" + (o.get("font") or "HELVETICA").encode() + b" " + n(o.get("font_size") or 12) + b" Tf " + n(*matrix) + b" Tm " + _shown(o.get("text") or "", o.get("font") or "HELVETICA") + b" Tj ET Q"


def _image(data: bytes) -> bytes:
    """An image object: JPEG as it is; PNG of 8 bits, not interlaced, by its own rows and predictors."""
    if data[:2] == b"\xff\xd8":
        at = 2
        while data[at + 1] not in (0xC0, 0xC1, 0xC2):
            at += 2 + int.from_bytes(data[at + 2 : at + 4])
        h, w = int.from_bytes(data[at + 5 : at + 7]), int.from_bytes(data[at + 7 : at + 9])
        space = {1: b"/DeviceGray", 3: b"/DeviceRGB", 4: b"/DeviceCMYK"}[data[at + 9]]
        return b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace %s /BitsPerComponent 8 /Filter /DCTDecode /Length %d >>\nstream\n" % (w, h, space, len(data)) + data + b"\nendstream"
    if data[:8] != b"\x89PNG\r\n\x1a\n":
        raise ValueError("not a PNG or JPEG image")
    w, h, bits, kind, _, _, laced = *(int.from_bytes(data[a : a + 4]) for a in (16, 20)), *data[24:29]
    if bits != 8 or kind not in (0, 2, 4, 6) or laced:
        raise ValueError("only plain PNG images of 8 bits are drawn")
    parts, at = [], 8
    while at < len(data):
        n = int.from_bytes(data[at : at + 4])
        if data[at + 4 : at + 8] == b"IDAT":
            parts.append(data[at + 8 : at + 8 + n])
        at += 12 + n
    colours = {0: 1, 2: 3, 4: 2, 6: 4}[kind]
    if kind in (4, 6):  # the alpha channel is left out
        rows, out, last = zlib.decompress(b"".join(parts)), bytearray(), bytes(w * colours)
        for y in range(h):
            filtered = rows[y * (w * colours + 1)]
            row = bytearray(rows[y * (w * colours + 1) + 1 : (y + 1) * (w * colours + 1)])
            for x in range(len(row)):
                a, b, c = row[x - colours] if x >= colours else 0, last[x], last[x - colours] if x >= colours else 0
                p = min((a, b, c), key=lambda v, s=a + b - c: abs(s - v))
                row[x] = row[x] + (0, a, b, (a + b) // 2, p)[filtered] & 255
            out += b"\0" + b"".join(row[x : x + colours - 1] for x in range(0, len(row), colours))
            last = bytes(row)
        parts, colours = [zlib.compress(bytes(out))], colours - 1
    body = b"".join(parts)
    return b"<< /Type /XObject /Subtype /Image /Width %d /Height %d /ColorSpace %s /BitsPerComponent 8 /Filter /FlateDecode /DecodeParms << /Predictor 15 /Colors %d /Columns %d >> /Length %d >>\nstream\n" % (
        w, h, b"/DeviceGray" if colours == 1 else b"/DeviceRGB", colours, w, len(body)) + body + b"\nendstream"


def page_objects(page: dict, drawn: list[dict], first: int, fonts: dict[str, str]) -> list[bytes]:
    """The objects of a page, numbered from first: its stream, its images and the page itself. page: width, height, and
    payload (content) or text; drawn: its overlays in order of painting."""
    images: list[bytes] = []
    content = page.get("payload")
    if content is None:
        lines = (page.get("text") or "").split("\n")
        content = b"BT /F1 12 Tf 14 TL 50 %d Td " % (page["height"] - 50) + b" ".join(_literal(x) + b" Tj T*" for x in lines) + b" ET" if page.get("text") else b""
    painted = b"\n".join(_drawn(o, images) for o in drawn)
    data = zlib.compress(b"q\n" + content + b"\nQ\n" + painted if painted else content)
    named = " ".join(f"/{k} {n} 0 R" for n, k in enumerate([*fonts, "F1"], FIRST))
    held = " ".join(f"/I{j} {first + j} 0 R" for j in range(1, len(images) + 1))
    own = f"<< /Type /Page /Parent 2 0 R {OWN.decode()} /MediaBox [0 0 {page['width']:g} {page['height']:g}] /Resources << /Font << {named} >> /XObject << {held} >> >> /Contents {first} 0 R >>"
    return [b"<< /Length %d /Filter /FlateDecode >>\nstream\n" % len(data) + data + b"\nendstream", *map(_image, images), own.encode()]


#: The number of the first font's object; pages' objects come after the fonts'.
FIRST = 3


def assembled(pages: list[list[bytes]], fonts: dict[str, str]) -> bytes:
    """A file of the objects of its pages, which follow each other from FIRST + len(fonts) + 1 on."""
    body = [f"<< /Type /Font /Subtype /Type1 /BaseFont /{v} >>".encode() for v in [*fonts.values(), "Helvetica"]]
    kids = []
    for objects in pages:
        body += objects
        kids.append(f"{len(body) + FIRST - 1} 0 R")
    body = [b"<< /Type /Catalog /Pages 2 0 R >>", f"<< /Type /Pages /Kids [{' '.join(kids)}] /Count {len(kids)} >>".encode(), *body]
    out, at, size = [b"%PDF-1.4\n"], [], 9
    for k, o in enumerate(body, 1):
        at.append(size)
        out.append(b"%d 0 obj\n" % k + o + b"\nendobj\n")
        size += len(out[-1])
    out += [b"xref\n0 %d\n0000000000 65535 f \n" % (len(body) + 1), *(b"%010d 00000 n \n" % a for a in at)]
    return b"".join([*out, b"trailer\n<< /Size %d /Root 1 0 R >>\nstartxref\n%d\n%%%%EOF\n" % (len(body) + 1, size)])
