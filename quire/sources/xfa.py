"""Form data packets: an array of names and streams, and values inside the data packet by path."""

from __future__ import annotations

import re
from xml.sax.saxutils import escape, unescape

from pyspark.sql import DataFrame

from quire.sources import documents, syntax

NAME = r"[A-Za-z_][\w.\-]*"
ELEMENT = re.compile(rf"<({NAME}(?::{NAME})?)((?:\s[^>]*?)?)(/?)>|</({NAME}(?::{NAME})?)\s*>|<!--.*?-->|<\?.*?\?>|<!\[CDATA\[(.*?)\]\]>", re.S)


def components(doc: syntax.Document) -> list[tuple[int, str, int | None, bytes]]:
    """(place, name, object, bytes) of the packets of a document's form; one stream without names is the packet ``xdp``."""
    live = doc.live()
    at = lambda ref: live.get(ref.value[0]) if ref is not None and ref.kind == "reference" else None
    root = at(doc.trailer("Root"))
    form = root.node.get("AcroForm") if root else None
    form = at(form).node if form is not None and form.kind == "reference" and at(form) else form
    held = form.get("XFA") if form is not None else None
    if held is None:
        return []
    if held.kind == "reference" and at(held) and at(held).node.kind == "stream":
        return [(0, "xdp", held.value[0], syntax.stream_data(at(held).node))]
    items = held.value if held.kind == "array" else []
    found = []
    for i, (name, ref) in enumerate(zip(items[::2], items[1::2])):
        stream = at(ref)
        if name.kind in ("string", "hexadecimal") and stream is not None and stream.node.kind == "stream":
            found.append((i, name.value.decode("latin-1"), ref.value[0], syntax.stream_data(stream.node)))
    return found


def packets(files: DataFrame, password: str = "") -> DataFrame:
    """(doc_id, place, name, obj_no, data) of every packet; files without any give no row."""
    return documents.parsed(files, "place int, name string, obj_no int, data binary", components, password)


def paths(xml: str) -> list[tuple[str, int, int, int, int]]:
    """(dotted path, element's begin, content's begin, content's end, element's end) of every element, prefixes left out; what is not closed is left out too."""
    found, stack = [], []
    for m in ELEMENT.finditer(xml):
        if m[1]:
            stack.append((m[1], m.start(), m.end()))
            if m[3]:
                found.append((".".join(s[0].rpartition(":")[2] for s in stack), m.start(), m.end(), m.end(), m.end()))
                stack.pop()
        elif m[4] and any(s[0] == m[4] for s in stack):
            while stack and stack[-1][0] != m[4]:
                stack.pop()
            _, begin, inner = stack[-1]
            found.append((".".join(s[0].rpartition(":")[2] for s in stack), begin, inner, m.start(), m.end()))
            stack.pop()
    return found


def plain_path(name: str) -> str:
    """A field's dotted name without the places of repeated parts."""
    return re.sub(r"\[\d+\]", "", name).removeprefix("#subform.").replace(".#subform", "")


def value(xml: str, name: str) -> str | None:
    """The text of the first element whose path ends with a field's name."""
    own = plain_path(name)
    hits = [p for p in paths(xml) if p[0] == own or p[0].endswith("." + own)]
    if not hits:
        return None
    _, _, begin, end, _ = min(hits, key=lambda p: p[1])
    return unescape(re.sub(r"<[^>]*>", "", xml[begin:end]), {"&quot;": '"', "&apos;": "'"})


def with_value(xml: str, name: str, text: str) -> str:
    """``xml`` with a field's text set; elements of its path that are missing are made inside the nearest one that isn't."""
    own, said = plain_path(name), escape(text)
    steps = own.split(".")
    for known in range(len(steps), -1, -1):
        path = ".".join(steps[:known])
        hits = [p for p in paths(xml) if known and (p[0] == path or p[0].endswith("." + path))] or ([p for p in paths(xml) if p[0].rpartition(".")[2] == "data"] if not known else [])
        if hits:
            whole, begin, inner, end, stop = min(hits, key=lambda p: p[1])
            rest = steps[known:]
            made = "".join(f"<{s}>" for s in rest) + said + "".join(f"</{s}>" for s in reversed(rest))
            content = made if not rest else xml[inner:end] + made if xml[begin:stop].rstrip()[-2:] != "/>" else made
            if stop == inner:  # an element without content
                tag = re.match(rf"<({NAME}(?::{NAME})?)", xml[begin:stop])[1]
                return xml[:begin] + xml[begin:stop].rstrip()[:-2].rstrip() + ">" + content + f"</{tag}>" + xml[stop:]
            return xml[:inner] + content + xml[end:]
    raise ValueError("there is no data to set a value in")


def imported(xml: str, values: dict[str, str]) -> str:
    for name, text in values.items():
        xml = with_value(xml, name, text)
    return xml
