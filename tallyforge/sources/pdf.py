"""Structure of PDF files with a plain cross-reference table: objects, page tree, media boxes, contents.

Values are read by a tokenizer, so what stands in strings, comments or streams is never taken for
structure. Objects must lie one after another between header and table, and the table must name
exactly the places where they begin. Problems are listed by name; none raises.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

_BLANK = rb"[\x00\t\n\f\r ]"
_TOKEN = re.compile(
    rb"(?P<blank>(?:" + _BLANK + rb"+|%[^\r\n]*)+)|(?P<open><<|\[)|(?P<close>>>|\])|(?P<hex><[0-9A-Fa-f\x00\t\n\f\r ]*>)"
    rb"|(?P<name>/[^\x00\t\n\f\r ()<>\[\]{}/%]*)|(?P<number>[-+]?(?:\d+\.?\d*|\.\d+)(?![^\x00\t\n\f\r ()<>\[\]{}/%]))|(?P<word>[^\x00\t\n\f\r ()<>\[\]{}/%]+)|(?P<text>\()"
)
_STRING_PART = re.compile(rb"[^()\\]+|\\.|[()]", re.S)
_WORDS = {b"true": True, b"false": False, b"null": None}
#: The format's header, its end, the beginning of an object, and an entry of the table.
_HEADER = re.compile(rb"%PDF-(?:1\.[0-7]|2\.0)(?:\r\n?|\n)")
_END = re.compile(rb"startxref\s+(\d+)\s+%%EOF\s*\Z")
_OBJECT = re.compile(rb"(\d+)[\x00\t\n\f\r ]+(\d+)[\x00\t\n\f\r ]+obj(?![^\x00\t\n\f\r ()<>\[\]{}/%])")
_ENTRY = re.compile(rb"(\d{10}) (\d{5}) ([fn])")
#: How deep values may lie within values, and pages within page nodes.
DEEPEST = 200


class Malformed(ValueError):
    """What is wrong, by name."""


class Name(bytes):
    """A name, so that it is not taken for a string."""


class Reference(tuple):
    """(number, generation) of an object."""


def _string(data: bytes, at: int) -> int:
    """Where the string that opens just before ``at`` ends: brackets within it balance."""
    deep = 1
    for m in _STRING_PART.finditer(data, at):
        if m[0] == b"(":
            deep += 1
        elif m[0] == b")":
            deep -= 1
            if not deep:
                return m.end()
    raise Malformed("open_string")


def tokens(data: bytes, at: int, end: int) -> Iterator[tuple[str, bytes, int]]:
    """(kind, text, where it ends), blanks and comments left out."""
    while at < end:
        m = _TOKEN.match(data, at, end)
        if m is None:
            raise Malformed("token")
        kind = m.lastgroup or ""
        at = m.end() if kind != "text" else _string(data, m.end())
        if kind != "blank":
            yield kind, data[m.start() : at], at


def value(data: bytes, at: int, end: int) -> tuple[object, int]:
    """The value at a place, and where it ends. Containers are built on a stack; a word R makes a reference."""
    stack: list[tuple[bytes, list]] = [(b"", [])]
    done = at
    for kind, text, after in tokens(data, at, end):
        items = stack[-1][1]
        if kind == "open":
            if len(stack) > DEEPEST:
                raise Malformed("too_deep")
            stack.append((text, []))
        elif kind == "close":
            opened, inner = stack.pop()
            if opened != (b"<<" if text == b">>" else b"["):
                raise Malformed("brackets")
            stack[-1][1].append(_dictionary(inner) if text == b">>" else inner)
        elif kind == "name":
            items.append(Name(text))
        elif kind == "number":
            items.append(int(text) if re.fullmatch(rb"[-+]?\d+", text) else float(text))
        elif kind in ("hex", "text"):
            items.append(text)
        elif text == b"R" and len(items) >= 2 and all(type(x) is int and x >= 0 for x in items[-2:]):
            items[-2:] = [Reference(items[-2:])]
        elif text in _WORDS:
            items.append(_WORDS[text])
        elif len(stack) == 1 and items:
            return _single(items), done  # a word of the file's own, such as endobj
        else:
            raise Malformed("word")
        done = after
    if len(stack) > 1:
        raise Malformed("brackets")
    return _single(stack[0][1]), done


def _single(items: list) -> object:
    if len(items) != 1:
        raise Malformed("value")
    return items[0]


def _dictionary(items: list) -> dict:
    keys = items[::2]
    if len(items) % 2 or not all(isinstance(k, Name) for k in keys) or len(set(keys)) < len(keys):
        raise Malformed("dictionary")
    return dict(zip(keys, items[1::2], strict=True))


def table(data: bytes, at: int) -> tuple[dict[Reference, int], dict]:
    """The cross-reference table at a place: where each object in use begins; and the trailer."""
    if not data.startswith(b"xref", at):
        raise Malformed("no_xref")
    lines = data[at + 4 :].lstrip(b"\t ").splitlines(keepends=True)
    place, entries = at + 4 + (len(data[at + 4 :]) - len(data[at + 4 :].lstrip(b"\t "))), {}
    number = left = 0
    for line in lines:
        place += len(line)
        text = line.strip()
        if text == b"trailer" and not left:
            break
        if left:
            m = _ENTRY.fullmatch(text)
            if m is None:
                raise Malformed("xref_entry")
            if m[3] == b"n":
                key = Reference((number, int(m[2])))
                if key in entries:
                    raise Malformed("xref_twice")
                entries[key] = int(m[1])
            number, left = number + 1, left - 1
        elif text:
            m = re.fullmatch(rb"(\d+)\s+(\d+)", text)
            if m is None or not int(m[2]):
                raise Malformed("xref_section")
            number, left = int(m[1]), int(m[2])
    else:
        raise Malformed("no_trailer")
    trailer, _ = value(data, place, len(data))
    if not isinstance(trailer, dict):
        raise Malformed("no_trailer")
    return entries, trailer


def objects(data: bytes, begin: int, end: int, entries: dict[Reference, int]) -> dict[Reference, tuple[object, bool]]:
    """Every object as (value, whether it has a stream). They lie side by side, just where the table says."""
    out: dict[Reference, tuple[object, bool]] = {}
    at = begin
    for key, start in sorted(entries.items(), key=lambda e: e[1]):
        m = _OBJECT.match(data, start)
        if m is None or (int(m[1]), int(m[2])) != key:
            raise Malformed("xref_place")
        gap = _TOKEN.match(data, at, start)
        if start < at or (start > at and (gap is None or gap.lastgroup != "blank" or gap.end() != start)):
            raise Malformed("xref_place")
        held, after = value(data, m.end(), end)
        kind, text, at = next(tokens(data, after, end), ("", b"", after))
        streamed = text == b"stream"
        if streamed:
            at = _past_stream(data, at, end, held, entries)
            kind, text, at = next(tokens(data, at, end), ("", b"", at))
        if text != b"endobj":
            raise Malformed("object_end")
        out[key] = (held, streamed)
    rest = _TOKEN.match(data, at, end)
    if at < end and (rest is None or rest.lastgroup != "blank" or rest.end() != end):
        raise Malformed("object_unlisted")
    return out


def _past_stream(data: bytes, at: int, end: int, held: object, entries: dict[Reference, int]) -> int:
    """Where a stream that begins after ``at`` ends, by its declared length."""
    size = held.get(b"/Length") if isinstance(held, dict) else None
    if isinstance(size, Reference):
        m = _OBJECT.match(data, entries.get(size, len(data)))
        size = value(data, m.end(), end)[0] if m else None
    start = re.compile(rb"[\x00\t\f ]*(?:\r\n|\n|\r)").match(data, at)
    if type(size) is not int or size < 0 or start is None or start.end() + size > end:
        raise Malformed("stream_length")
    kind, text, after = next(tokens(data, start.end() + size, end), ("", b"", at))
    if text != b"endstream":
        raise Malformed("stream_length")
    return after


def inspect(data: bytes) -> dict:
    """(pages, problems, smallest_side, objects, encrypted, compressed); pages is None where no tree was reached."""
    out = {"pages": None, "problems": [], "smallest_side": None, "objects": 0, "encrypted": False, "compressed": False}
    try:
        header, last = _HEADER.search(data[:1024]), _END.search(data)
        if header is None:
            raise Malformed("no_header")
        if last is None or not header.end() <= int(last[1]) < last.start():
            raise Malformed("no_xref")
        where = int(last[1])
        if _OBJECT.match(data, where):  # the table itself is a stream of an object
            out["compressed"] = True
            raise Malformed("compressed")
        entries, trailer = table(data, where)
        held = objects(data, header.end(), where, entries)
        out["objects"], out["encrypted"] = len(held), b"/Encrypt" in trailer
        problems, boxes, pages = _pages(held, trailer)
        out |= {"pages": pages, "problems": sorted(set(problems)), "smallest_side": min((min(abs(b[2] - b[0]), abs(b[3] - b[1])) for b in boxes), default=None)}
    except Malformed as e:
        out["problems"] = [str(e)]
    return out


def _pages(held: dict[Reference, tuple[object, bool]], trailer: dict) -> tuple[list[str], list[list[float]], int | None]:
    """Problems, media boxes and number of the pages; nodes are visited from a stack, each once."""
    of = lambda r: held.get(r, (None, False))[0] if isinstance(r, Reference) else None
    catalog = of(trailer.get(b"/Root"))
    top = catalog.get(b"/Pages") if isinstance(catalog, dict) and catalog.get(b"/Type") == b"/Catalog" else None
    if not isinstance(top, Reference):
        return ["no_catalog"], [], None
    problems: list[str] = []
    boxes: list[list[float]] = []
    seen: set[Reference] = set()
    found: dict[Reference, int] = {}
    declared: list[tuple[Reference, object, list]] = []
    stack: list[tuple[Reference, Reference | None, object]] = [(top, None, None)]
    while stack:
        at, parent, box = stack.pop()
        if at in seen:
            problems.append("cycle")
            continue
        seen.add(at)
        body = of(at)
        if not isinstance(body, dict):
            problems.append("missing_object")
            continue
        if parent is not None and body.get(b"/Parent") != parent:
            problems.append("parent_differs")
        box = body.get(b"/MediaBox", box)
        if body.get(b"/Type") == b"/Pages":
            kids = body.get(b"/Kids")
            kids = kids if isinstance(kids, list) and all(isinstance(k, Reference) for k in kids) else []
            if not kids:
                problems.append("no_kids")
            declared.append((at, body.get(b"/Count"), kids))
            stack += [(k, at, box) for k in reversed(kids)]
        elif body.get(b"/Type") == b"/Page" and parent is not None:
            found[at] = 1
            if isinstance(box, list) and len(box) == 4 and all(type(x) in (int, float) for x in box):
                boxes.append(box)
            else:
                problems.append("no_media_box")
            contents = body.get(b"/Contents")
            parts = contents if isinstance(contents, list) else [contents]
            if not parts or not all(isinstance(p, Reference) and held.get(p, (None, False))[1] for p in parts):
                problems.append("no_contents")
        else:
            problems.append("not_a_page")
    for at, count, kids in reversed(declared):  # children come after their parents
        found[at] = sum(found.get(k, 0) for k in kids)
        if count != found[at]:
            problems.append("count_differs")
    return problems, boxes, found.get(top, 0)


def write(pages: list[tuple[float, float, bytes]]) -> bytes:
    """A plain PDF of pages (width, height, content), as ``inspect`` wants it."""
    kids = " ".join(f"{3 + 2 * i} 0 R" for i in range(len(pages)))
    bodies = [b"<</Type/Catalog/Pages 2 0 R>>", f"<</Type/Pages/Kids[{kids}]/Count {len(pages)}>>".encode()]
    for i, (w, h, content) in enumerate(pages):
        bodies.append(f"<</Type/Page/Parent 2 0 R/MediaBox[0 0 {w:g} {h:g}]/Contents {4 + 2 * i} 0 R>>".encode())
        bodies.append(b"<</Length %d>>\nstream\n" % len(content) + content + b"\nendstream")
    out, places = b"%PDF-1.7\n", []
    for n, body in enumerate(bodies, 1):
        places.append(len(out))
        out += b"%d 0 obj\n" % n + body + b"\nendobj\n"
    rows = b"".join(b"%010d 00000 n \n" % p for p in places)
    return out + b"xref\n0 %d\n0000000000 65535 f \n" % (len(bodies) + 1) + rows + b"trailer\n<</Root 1 0 R/Size %d>>\nstartxref\n%d\n%%%%EOF\n" % (len(bodies) + 1, len(out))
