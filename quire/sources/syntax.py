"""The document syntax of one file: tokens, objects, revisions, index sections, and the writer. Plain Python, used inside UDFs and the data source."""

from __future__ import annotations

import hashlib
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

from quire.functions.codecs import decode_stream
from quire.functions.text import unescape_bytes
from quire.sources import security

SPACE = b" \t\r\n\0\f"
DEEPEST = 500
TOKEN = re.compile(
    rb"(?P<space>[ \t\r\n\0\f]+)|(?P<comment>%[^\r\n]*)|(?P<ref>\d+[ \t\r\n]+\d+[ \t\r\n]+R(?![^ \t\r\n\0\f()<>\[\]{}/%]))|(?P<start_object>\d+[ \t\r\n]+\d+[ \t\r\n]+obj(?![a-z]))"
    rb"|(?P<number>[-+]?(?:\d+\.?\d*|\.\d+))|(?P<name>/[^ \t\r\n\0\f()<>\[\]{}/%]*)|(?P<start_dictionary><<)|(?P<end_dictionary>>>)|(?P<hexadecimal><[0-9A-Fa-f \t\r\n\0\f]*>)"
    rb"|(?P<start_array>\[)|(?P<end_array>\])|(?P<string>\()|(?P<keyword>true|false|null|xref|trailer|startxref|endobj|endstream)|(?P<start_stream>stream(?:\r\n|\n|\r))|(?P<other>[^ \t\r\n\0\f()<>\[\]{}/%]+|.)",
    re.S,
)


@dataclass
class Token:
    kind: str
    at: int
    data: bytes


def tokens(data: bytes, at: int = 0) -> Iterator[Token]:
    """All tokens from a place on; white space and comments too, so that they join to the input again."""
    while at < len(data):
        m = TOKEN.match(data, at)
        kind, end = m.lastgroup, m.end()
        if kind == "string":
            end = string_end(data, at)
        if kind == "start_stream":
            yield Token(kind, at, m[0])
            stop = data.find(b"endstream", end)
            stop = len(data) if stop < 0 else stop
            yield Token("stream_chunk", end, data[end:stop])
            at = stop
            continue
        if kind == "keyword":
            word = m[0].decode()
            kind = {"true": "boolean", "false": "boolean", "xref": "xref_start", "endobj": "end_object", "endstream": "end_stream"}.get(word, word)
        yield Token(kind, at, data[at:end])
        at = end


BRACKET = re.compile(rb"\\.|[()]", re.S)


def string_end(data: bytes, at: int) -> int:
    depth = 0
    for m in BRACKET.finditer(data, at):
        if m[0] == b"(":
            depth += 1
        elif m[0] == b")":
            depth -= 1
            if not depth:
                return m.end()
    raise ValueError(f"string at {at} doesn't end")


@dataclass
class Node:
    """A value: kind, and what it holds (pairs for a dictionary, which keeps repeated keys)."""

    kind: str
    value: object = None
    raw: bytes = b""

    def get(self, key: str) -> Node | None:
        return next((v for k, v in self.value if k == key), None) if self.kind in ("dictionary", "stream") else None

    def number(self, key: str, other: int = 0) -> int:
        own = self.get(key)
        return int(own.value) if own and own.kind == "number" else other


@dataclass
class Indirect:
    obj_no: int
    gen_no: int
    at: int
    end: int
    node: Node
    revision: int = 0
    inside: int | None = None  # the object stream that holds it
    index: int | None = None


@dataclass
class Entry:
    obj_no: int
    gen_no: int
    kind: int  # 0 free, 1 at an offset, 2 in an object stream
    offset: int | None
    stream_no: int | None = None
    index: int | None = None
    revision: int = 0


@dataclass
class Revision:
    number: int
    kind: str = ""
    xref_at: int | None = None
    startxref: int | None = None
    trailer: Node | None = None


@dataclass
class Document:
    version: str | None = None
    objects: list[Indirect] = field(default_factory=list)
    entries: list[Entry] = field(default_factory=list)
    revisions: list[Revision] = field(default_factory=list)
    security: security.Security | None = None

    def live(self) -> dict[int, Indirect]:
        """The object that counts for each number: where the newest index entry points; without an index, the last."""
        at = {(o.obj_no, o.at): o for o in self.objects if o.inside is None}
        inside = {(o.obj_no, o.inside): o for o in self.objects if o.inside is not None}
        newest: dict[int, Entry] = {}
        for e in self.entries:
            if e.obj_no not in newest or e.revision > newest[e.obj_no].revision:
                newest[e.obj_no] = e
        if not newest:
            return {o.obj_no: o for o in self.objects}
        found = {n: at.get((n, e.offset)) if e.kind == 1 else inside.get((n, e.stream_no)) if e.kind == 2 else None for n, e in newest.items()}
        return {n: o for n, o in found.items() if o}

    def trailer(self, key: str) -> Node | None:
        return next((v for r in reversed(self.revisions) if r.trailer and (v := r.trailer.get(key))), None)


def name_text(data: bytes) -> str:
    return re.sub(rb"#([0-9A-Fa-f]{2})", lambda m: bytes([int(m[1], 16)]), data[1:]).decode("utf-8", "replace")


class Parser:
    def __init__(self, data: bytes, at: int = 0):
        self.data = data
        self.stream = (t for t in tokens(data, at) if t.kind not in ("space", "comment"))
        self.held: Token | None = None

    def next(self) -> Token | None:
        token, self.held = self.held or next(self.stream, None), None
        return token

    def value(self, token: Token | None = None, depth: int = 0) -> Node | None:
        t = token or self.next()
        if t is None:
            return None
        if depth > DEEPEST:
            raise ValueError("nested too deeply")
        if t.kind == "number":
            return Node("number", float(t.data) if b"." in t.data else int(t.data), t.data)
        if t.kind == "name":
            return Node("name", name_text(t.data), t.data)
        if t.kind == "string":
            return Node("string", unescape_bytes(t.data[1:-1]), t.data)
        if t.kind == "hexadecimal":
            digits = b"".join(t.data[1:-1].split())
            return Node("hexadecimal", bytes.fromhex((digits + b"0" * (len(digits) % 2)).decode()), t.data)
        if t.kind == "boolean":
            return Node("boolean", t.data == b"true", t.data)
        if t.kind == "null":
            return Node("null", None, t.data)
        if t.kind == "ref":
            n, g, _ = t.data.split()
            return Node("reference", (int(n), int(g)), t.data)
        if t.kind == "start_array":
            items = []
            while (t := self.next()) and t.kind != "end_array":
                items.append(self.value(t, depth + 1))
            return Node("array", items)
        if t.kind == "start_dictionary":
            pairs = []
            while (t := self.next()) and t.kind != "end_dictionary":
                if t.kind != "name":
                    raise ValueError(f"a key is expected at {t.at}")
                pairs.append((name_text(t.data), self.value(depth=depth + 1)))
            return Node("dictionary", pairs)
        raise ValueError(f"unexpected {t.data[:20]!r} at {t.at}")

    def indirect(self, t: Token) -> Indirect:
        n, g = t.data.split()[:2]
        node, end = self.value(), len(self.data)
        while (x := self.next()) and x.kind != "end_object":
            if x.kind == "stream_chunk":
                size = node.get("Length")
                raw = x.data
                if size is not None and size.kind == "number" and size.value <= len(raw):
                    raw = raw[: size.value]
                elif raw.endswith(b"\r\n"):
                    raw = raw[:-2]
                elif raw[-1:] in (b"\n", b"\r"):
                    raw = raw[:-1]
                node = Node("stream", node.value, raw)
        if x:
            end = x.at + len(x.data)
        return Indirect(int(n), int(g), t.at, end, node)


def stream_data(node: Node) -> bytes:
    """A stream's bytes with its filters and predictors undone."""
    names, parms = node.get("Filter"), node.get("DecodeParms")
    listed = lambda x: [] if x is None else x.value if x.kind == "array" else [x]
    plain = [None if p is None or p.kind != "dictionary" else {k: v.value for k, v in p.value if v.kind == "number"} for p in listed(parms)]
    return decode_stream(node.raw, [n.value for n in listed(names)], plain)


def stream_entries(node: Node) -> Iterator[tuple[int, int, int, int]]:
    """(obj_no, type, second, third field) of an index stream's fixed-width rows; a missing type is 1."""
    widths = [int(w.value) for w in node.get("W").value]
    index = node.get("Index")
    index = [int(i.value) for i in index.value] if index else [0, node.number("Size")]
    data, at = stream_data(node), 0
    for first, count in zip(index[::2], index[1::2]):
        for n in range(first, first + count):
            cut = []
            for w in widths:
                cut.append(int.from_bytes(data[at : at + w], "big"))
                at += w
            yield n, cut[0] if widths[0] else 1, cut[1], cut[2]


def members(node: Node, stream_no: int) -> Iterator[Indirect]:
    """The objects of an object stream: pairs of number and offset, then the values."""
    data, first = stream_data(node), node.number("First")
    head = [int(x) for x in data[:first].split()][: 2 * node.number("N")]
    for i, (n, at) in enumerate(zip(head[::2], head[1::2])):
        yield Indirect(n, 0, at, at, Parser(data, first + at).value(), inside=stream_no, index=i)


def read(data: bytes, password: bytes = b"") -> Document:
    """Objects, index entries and revisions of a file. A protected file is decrypted, if the password opens it."""
    doc = Document()
    head = re.search(rb"%PDF-(\d\.\d)", data[:1024])
    doc.version = head[1].decode() if head else None
    revision = Revision(0)
    last = 0
    parser = Parser(data)
    parser.stream = (t for t in tokens(data) if t.kind != "space" and (t.kind != "comment" or t.data.strip().lower() == b"%%eof"))
    while t := parser.next():
        if t.kind == "comment":
            doc.revisions.append(revision)
            revision, last = Revision(revision.number + 1), t.at
        elif t.kind == "start_object":
            found = parser.indirect(t)
            found.revision = revision.number
            doc.objects.append(found)
            kind = found.node.get("Type")
            kind = kind.value if kind and kind.kind == "name" else None
            if found.node.kind == "stream" and kind == "XRef":
                revision.kind, revision.xref_at, revision.trailer = "stream", found.at, Node("dictionary", found.node.value)
                for n, e, a, b in stream_entries(found.node):
                    doc.entries.append(Entry(n, b if e < 2 else 0, e, a if e == 1 else None, a if e == 2 else None, b if e == 2 else None, revision.number))
        elif t.kind == "xref_start":
            revision.kind, revision.xref_at = "table", t.at
            body = re.compile(rb"\s*(\d+) +(\d+)\s*").match(data, t.at + 4)
            while body:
                first, count, at = int(body[1]), int(body[2]), body.end()
                for n in range(first, first + count):
                    line = re.compile(rb"(\d+) +(\d+) +([nf])\s*").match(data, at)
                    if not line:
                        break
                    doc.entries.append(Entry(n, int(line[2]), int(line[3] == b"n"), int(line[1]), revision=revision.number))
                    at = line.end()
                body = re.compile(rb"\s*(\d+) +(\d+)\s*(?=\d)").match(data, at)
            parser.stream = (x for x in tokens(data, at) if x.kind != "space" and (x.kind != "comment" or x.data.strip().lower() == b"%%eof"))
        elif t.kind == "trailer":
            revision.trailer = parser.value()
        elif t.kind == "startxref":
            place = parser.next()
            revision.startxref = int(place.data) if place and place.kind == "number" else None
    if not doc.revisions or any(o.revision == revision.number for o in doc.objects) and last:
        doc.revisions.append(revision)
    decrypt(doc, password)
    for o in [o for o in doc.objects if o.node.kind == "stream" and (k := o.node.get("Type")) and k.value == "ObjStm"]:
        for member in members(o.node, o.obj_no):
            member.revision = o.revision
            doc.objects.append(member)
    return doc


def plain(node: Node | None) -> object:
    """A value as Python has it: names as text, references as None."""
    if node is None or node.kind == "reference":
        return None
    if node.kind == "array":
        return [plain(v) for v in node.value]
    if node.kind in ("dictionary", "stream"):
        return {k: plain(v) for k, v in reversed(node.value)}
    return node.value


def decrypt(doc: Document, password: bytes) -> None:
    """Strings and streams in plain; an unknown handler and a wrong password are errors. Members of object streams are plain already, as their stream is."""
    secret = doc.trailer("Encrypt")
    if secret is None:
        return
    own_no = secret.value[0] if secret.kind == "reference" else None
    rules = plain(next((o.node for o in doc.objects if o.obj_no == own_no), None) if own_no else secret)
    if rules is None:
        raise ValueError("the encryption dictionary is missing")
    rules["CF"] = {k: v.get("CFM", "None") for k, v in (rules.get("CF") or {}).items()}
    ids = plain(doc.trailer("ID"))
    doc.security = security.opened(rules, password, ids[0] if ids else b"")

    def walk(node: Node | None, o: Indirect) -> None:
        if node is None:
            return
        if node.kind in ("string", "hexadecimal"):
            node.value, node.raw = doc.security.decrypted(node.value, o.obj_no, o.gen_no, doc.security.strings), b""
        elif node.kind == "array":
            for x in node.value:
                walk(x, o)
        elif node.kind in ("dictionary", "stream"):
            for _, x in node.value:
                walk(x, o)
            if node.kind == "stream":
                kind, filters, parms = plain(node.get("Type")), plain(node.get("Filter")), plain(node.get("DecodeParms"))
                first = filters[0] if isinstance(filters, list) and filters else filters
                named = parms[0] if isinstance(parms, list) and parms else parms
                own = (named or {}).get("Name", security.IDENTITY) if first == "Crypt" else None
                node.raw = doc.security.decrypted(node.raw, o.obj_no, o.gen_no, doc.security.method_of_stream(kind, own))

    for o in doc.objects:
        kind = o.node.get("Type") if o.node else None
        if o.obj_no != own_no and not (kind and kind.value == "XRef"):
            walk(o.node, o)


def encrypt(value: object, number: int, own: security.Security, count: list[int] | None = None) -> object:
    """A value as ``write`` takes it with its strings and its stream encrypted for the object of that number."""
    count = count if count is not None else [0]
    if isinstance(value, tuple) and len(value) == 2 and isinstance(value[0], dict):
        head = encrypt(value[0], number, own, count)
        kind = str(value[0].get("Type", "")).removeprefix("/")
        return head, own.encrypted(value[1], number, 0, own.method_of_stream(kind, None))
    if isinstance(value, bytes):
        count[0] += 1
        return own.encrypted(value, number, 0, own.strings, count[0])
    if isinstance(value, list):
        return [encrypt(v, number, own, count) for v in value]
    if isinstance(value, dict):
        return {k: encrypt(v, number, own, count) for k, v in value.items()}
    return value


def escaped(data: bytes) -> bytes:
    for a, b in ((b"\\", b"\\\\"), (b"\n", b"\\n"), (b"\r", b"\\r"), (b"\t", b"\\t"), (b"\b", b"\\b"), (b"\f", b"\\f"), (b"(", b"\\("), (b")", b"\\)")):
        data = data.replace(a, b)
    return data


def dump(value: object) -> bytes:
    """A Python value as document syntax: names are strings with a leading slash, references are (number, generation)."""
    if isinstance(value, Node):
        if value.kind == "stream":
            return dump(dict(value.value)) + b"\nstream\n" + value.raw + b"\nendstream"
        return value.raw or dump(dict(value.value) if value.kind == "dictionary" else value.value)
    if value is None:
        return b"null"
    if isinstance(value, bool):
        return b"true" if value else b"false"
    if isinstance(value, int):
        return b"%d" % value
    if isinstance(value, float):
        return f"{value:.6f}".rstrip("0").rstrip(".").encode()
    if isinstance(value, bytes):
        return b"(" + escaped(value) + b")"
    if isinstance(value, str):
        return b"/" + re.sub(rb"[^+,A-Za-z0-9\-_.]", lambda m: b"#%02X" % m[0][0], value.removeprefix("/").encode())
    if isinstance(value, tuple):
        return b"%d %d R" % value
    if isinstance(value, list):
        return b"[" + b" ".join(map(dump, value)) + b"]"
    return b"<<" + b" ".join(b"%s %s" % (dump("/" + k), dump(v)) for k, v in value.items()) + b">>"


def body_of(value: object) -> bytes:
    """An object's bytes; a stream is (dictionary, bytes)."""
    if isinstance(value, tuple) and len(value) == 2 and isinstance(value[0], dict):
        return dump(value[0] | {"Length": len(value[1])}) + b"\nstream\n" + value[1] + b"\nendstream"
    return dump(value)


def packed(objects: dict[int, object], first_number: int, most: int = 100) -> tuple[dict[int, object], dict[int, tuple[int, int]]]:
    """Object streams of up to ``most`` objects each, by number from ``first_number``, and (stream, place in it) of each object; streams can't be packed and are left out."""
    streams, places = {}, {}
    fit = [(n, v) for n, v in objects.items() if not (isinstance(v, tuple) and len(v) == 2 and isinstance(v[0], dict))]
    for at in range(0, len(fit), most):
        bodies = [(n, dump(v)) for n, v in fit[at : at + most]]
        offset, head = 0, []
        for i, (n, body) in enumerate(bodies):
            head.append(b"%d %d" % (n, offset))
            places[n] = (first_number, i)
            offset += len(body) + 1
        lead = b" ".join(head) + b"\n"
        data = zlib.compress(lead + b"\n".join(b for _, b in bodies))
        streams[first_number] = ({"Type": "/ObjStm", "N": len(bodies), "First": len(lead), "Filter": "/FlateDecode"}, data)
        first_number += 1
    return streams, places


def index_stream(rows: dict[int, tuple[int, int, int]], trailer: dict[str, object]) -> tuple[dict, bytes]:
    """An index stream of (type, second, third field) by number: sections of consecutive numbers, fields no wider than their largest value needs."""
    numbers = sorted(rows)
    starts = [i for i, n in enumerate(numbers) if i == 0 or n != numbers[i - 1] + 1] + [len(numbers)]
    index = [x for a, b in zip(starts, starts[1:]) for x in (numbers[a], b - a)]
    widths = [max(1, (max((r[k] for r in rows.values()), default=0).bit_length() + 7) // 8) for k in range(3)]
    data = b"".join(v.to_bytes(w, "big") for n in numbers for v, w in zip(rows[n], widths))
    return trailer | {"Type": "/XRef", "W": widths, "Index": index, "Filter": "/FlateDecode"}, zlib.compress(data)


def write(objects: dict[int, object], root: int, before: bytes = b"", info: int | None = None, protect: dict | None = None, compressed: bool = False, free: list[int] = ()) -> bytes:
    """A file of those objects (or, after the bytes of one, a further revision of it). A stream is (dictionary, bytes).

    ``protect`` has what ``security.created`` takes: the file is encrypted. ``compressed``: objects go to object streams and the index is a
    stream. ``free`` are numbers of objects that a further revision deletes.
    """
    out = bytearray(before or b"%PDF-1.7\n%\xe2\xe3\xcf\xd3\n")
    trailer: dict[str, object] = {"Root": (root, 0)}
    own = None
    top = max([*objects, *free, 0])
    if before:
        earlier = read(before)
        top = max(top, max((r.trailer.number("Size") for r in earlier.revisions if r.trailer), default=1) - 1)
        trailer["Prev"] = next(r.startxref for r in reversed(earlier.revisions) if r.startxref is not None)
    if info:
        trailer["Info"] = (info, 0)
    places: dict[int, tuple[int, int]] = {}
    if compressed:
        streams, places = packed(objects, top + 1)
        objects = {n: v for n, v in objects.items() if n not in places} | streams
        top += len(streams)
    if protect is not None:
        file_id = hashlib.md5(b"".join(body_of(v) for v in objects.values())).digest()
        rules, own = security.created(**{"file_id": file_id, "seed": file_id} | protect)
        top += 1
        trailer |= {"Encrypt": (top, 0), "ID": [file_id, file_id]}
        objects = {n: encrypt(v, n, own) for n, v in objects.items()} | {top: rules}
    offsets: dict[int, int] = {}
    for n, value in objects.items():
        offsets[n] = len(out)
        out += b"%d 0 obj\n%s\nendobj\n" % (n, body_of(value))
    at = len(out)
    if compressed:
        number = top + 1
        rows = {n: (1, o, 0) for n, o in offsets.items()} | {n: (2, *p) for n, p in places.items()} | {n: (0, 0, 1) for n in free} | {number: (1, at, 0)}
        if not before:
            rows[0] = (0, 0, 65535)
        out += b"%d 0 obj\n%s\nendobj\n" % (number, body_of(index_stream(rows, {"Size": number + 1} | trailer)))
    else:
        out += b"xref\n"
        lines = {n: b"%010d 00000 n \n" % o for n, o in offsets.items()} | {n: b"0000000000 00001 f \n" for n in free}
        if not before:
            lines[0] = b"0000000000 65535 f \n"
        numbers = sorted(lines)
        start = 0
        for i in range(1, len(numbers) + 1):
            if i == len(numbers) or numbers[i] != numbers[i - 1] + 1:
                out += b"%d %d\n" % (numbers[start], i - start) + b"".join(lines[n] for n in numbers[start:i])
                start = i
        out += b"trailer\n" + dump({"Size": top + 1} | trailer) + b"\n"
    out += b"startxref\n%d\n%%%%EOF\n" % at
    return bytes(out)
