"""Document files as DataFrames, and DataFrames as document files."""

from __future__ import annotations

import json
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from quire.operators.shared import sliced, small_batches
from quire.sources import syntax


def files(spark: SparkSession, path: str) -> DataFrame:
    """(doc_id, path, content) of the files of a folder; the id is a hash of the path."""
    rows = spark.read.format("binaryFile").load(path)
    return rows.select(F.xxhash64("path").alias("doc_id"), "path", "content")


def parsed(documents: DataFrame, schema: str, work, password: str = "") -> DataFrame:
    """``work(doc_id, document)`` of every file (doc_id, content), a task reading whole files; a file that can't be read gives no rows here (see ``errors``).

    A file's own ``password`` column, if there is one, opens it; else the one given.
    """
    small_batches(documents.sparkSession)
    kind = dict(documents.dtypes)["doc_id"]
    fields = documents.sparkSession.createDataFrame([], f"doc_id {kind}, {schema}")
    arrow = fields.limit(0).toArrow().schema

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = []
            for doc_id, content, secret in zip(*(batch.column(c).to_pylist() for c in ("doc_id", "content", "password"))):
                try:
                    made += [(doc_id, *row) for row in work(syntax.read(content or b"", (secret or "").encode()))]
                except (ValueError, PermissionError, AttributeError, RecursionError):
                    continue
            yield pa.RecordBatch.from_arrays([pa.array([m[i] for m in made], f.type) for i, f in enumerate(arrow)], arrow.names)

    return with_password(documents, password).mapInArrow(run, fields.schema)


def with_password(documents: DataFrame, password: str) -> DataFrame:
    given = F.lit(password)
    return documents.select("doc_id", "content", (F.coalesce(F.col("password"), given) if "password" in documents.columns else given).alias("password"))


def errors(documents: DataFrame, password: str = "") -> DataFrame:
    """(doc_id, error) of the files that can't be read."""
    small_batches(documents.sparkSession)
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            ids, said = [], []
            for i, (content, secret) in enumerate(zip(batch.column("content").to_pylist(), batch.column("password").to_pylist())):
                try:
                    syntax.read(content or b"", (secret or "").encode())
                except Exception as error:  # noqa: BLE001
                    ids.append(i)
                    said.append(f"{type(error).__name__}: {error}")
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(ids, pa.int64())), pa.array(said, pa.string())], ["doc_id", "error"])

    return with_password(documents, password).mapInArrow(run, f"doc_id {kind}, error string")


def as_json(node: syntax.Node | None) -> object:
    """The canonical form of a value."""
    if node is None:
        return None
    if node.kind == "dictionary":
        return {"type": "dictionary", "entries": {k: as_json(v) for k, v in reversed(node.value)}}
    if node.kind == "stream":
        return {"type": "stream", "header": {k: as_json(v) for k, v in reversed(node.value)}, "dataLength": len(node.raw)}
    if node.kind == "array":
        return {"type": "array", "items": [as_json(v) for v in node.value]}
    if node.kind == "reference":
        return {"type": "reference", "objectNumber": node.value[0], "generationNumber": node.value[1]}
    value = node.value
    return {"type": node.kind, "value": value.hex() if node.kind == "hexadecimal" else value.decode("latin-1") if isinstance(value, bytes) else value}


def objects(documents: DataFrame, password: str = "") -> DataFrame:
    def work(doc):
        for i, o in enumerate(doc.objects):
            yield o.revision, i, o.obj_no, o.gen_no, o.at if o.inside is None else None, o.inside, o.index, o.node.kind if o.node else "null", json.dumps(as_json(o.node))

    return parsed(documents, "revision_no int, ordinal int, obj_no int, gen_no int, byte_offset long, compressed_in int, idx_in_stream int, kind string, value string", work, password)


def walk(node: syntax.Node | None, path: str = "") -> Iterator[tuple]:
    """(path, parent path, ordinal, key, index, kind, number, bytes, text, referenced object, its generation) of a value and all below it."""
    todo = [(node, path, None, 0, None, None)]
    while todo:
        node, path, parent, ordinal, key, index = todo.pop()
        if node is None:
            continue
        value = node.value
        yield (
            path,
            parent,
            ordinal,
            key,
            index,
            node.kind,
            float(value) if node.kind == "number" else None,
            value if node.kind in ("string", "hexadecimal") else node.raw if node.kind == "stream" else None,
            value if node.kind == "name" else str(value).lower() if node.kind == "boolean" else None,
            value[0] if node.kind == "reference" else None,
            value[1] if node.kind == "reference" else None,
        )
        if node.kind == "array":
            todo += [(v, f"{path}/{i}", path, i, None, i) for i, v in reversed([*enumerate(value)])]
        elif node.kind in ("dictionary", "stream"):
            todo += [(v, f"{path}/{k}", path, i, k, None) for i, (k, v) in reversed([*enumerate(value)])]


def nodes(documents: DataFrame, password: str = "") -> DataFrame:
    """Every value of every live object, one row each; of repeated keys the first counts (lowest ``ord``)."""

    def work(doc):
        for n, o in sorted(doc.live().items()):
            for row in walk(o.node):
                yield n, o.gen_no, *row

    return parsed(documents, "obj_no int, gen_no int, path string, parent_path string, ord int, key string, idx int, kind string, num double, bytes binary, text string, ref_obj int, ref_gen int", work, password)


def xref_entries(documents: DataFrame, password: str = "") -> DataFrame:
    return parsed(documents, "revision_no int, obj_no int, gen_no int, entry_type int, byte_offset long, objstm_no int, idx int", lambda doc: ((e.revision, e.obj_no, e.gen_no, e.kind, e.offset, e.stream_no, e.index) for e in doc.entries), password)


def revisions(documents: DataFrame, password: str = "") -> DataFrame:
    def work(doc):
        for r in doc.revisions:
            prev = r.trailer.get("Prev") if r.trailer else None
            root = r.trailer.get("Root") if r.trailer else None
            yield r.number, r.startxref, r.xref_at, r.kind, int(prev.value) if prev else None, r.trailer.number("Size") if r.trailer else None, root.value[0] if root and root.kind == "reference" else None

    return parsed(documents, "revision_no int, startxref long, xref_offset long, xref_kind string, prev long, size int, root_obj int", work, password)


def tokens(documents: DataFrame) -> DataFrame:
    """(doc_id, pos, offset, type, length) of every token."""
    small_batches(documents.sparkSession)
    kind = dict(documents.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            for i, content in enumerate(batch.column("content").to_pylist()):
                found = [(n, t.at, t.kind, len(t.data)) for n, t in enumerate(syntax.tokens(content or b""))]
                cols = list(zip(*found)) or [[]] * 4
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array([i] * len(found), pa.int64())), pa.array(cols[0], pa.int32()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int32())], ["doc_id", "pos", "offset", "type", "length"])

    return documents.select("doc_id", "content").mapInArrow(run, f"doc_id {kind}, pos int, offset long, type string, length int")


def leaves(doc: syntax.Document) -> Iterator[tuple[int, syntax.Node]]:
    """(object number, page) depth first; a page tree with a cycle ends where it would begin again."""
    live = doc.live()
    at = lambda ref: live.get(ref.value[0]) if ref is not None and ref.kind == "reference" else None
    root = at(doc.trailer("Root"))
    todo, seen = [root.node.get("Pages")] if root else [], set()
    while todo:
        found = at(todo.pop())
        if found is None or found.obj_no in seen:
            continue
        seen.add(found.obj_no)
        kids = found.node.get("Kids")
        if kids is not None and kids.kind == "array":
            todo += reversed(kids.value)
        else:
            yield found.obj_no, found.node


def box(node: syntax.Node, name: str, other: list[float] | None = None) -> list[float] | None:
    own = node.get(name)
    return [float(v.value) for v in own.value] if own is not None and own.kind == "array" and all(v.kind == "number" for v in own.value) else other


def pages(documents: DataFrame, password: str = "") -> DataFrame:
    """One row a page: number, boxes (a page's own; its media box is a letter page's by default), size, rotation and what it refers to."""

    def work(doc):
        for i, (n, page) in enumerate(leaves(doc)):
            media = box(page, "MediaBox", [0.0, 0.0, 612.0, 792.0])
            boxes = [media, *[box(page, b, media) for b in ("CropBox", "BleedBox", "TrimBox", "ArtBox")]]
            annots = page.get("Annots")
            yield i, n, *boxes, media[2] - media[0], media[3] - media[1], page.number("Rotate"), len(annots.value) if annots is not None and annots.kind == "array" else 0

    boxes = ", ".join(f"{b} array<double>" for b in ("media_box", "crop_box", "bleed_box", "trim_box", "art_box"))
    return parsed(documents, f"page_no int, obj_no int, {boxes}, width double, height double, rotate int, n_annotations int", work, password)


def fields(documents: DataFrame, password: str = "") -> DataFrame:
    """Form fields with their dotted names; type, value, flags and appearance come from the parent (or the form) where a field has none."""

    def work(doc):
        live = doc.live()
        at = lambda ref: (live[ref.value[0]].node if ref.value[0] in live else None) if ref is not None and ref.kind == "reference" else ref
        root = at(doc.trailer("Root"))
        form = at(root.get("AcroForm")) if root else None
        if form is None:
            return
        said = lambda v: None if v is None else v.value.decode("utf-16-be", "replace")[1:] if isinstance(v.value, bytes) and v.value[:2] == b"\xfe\xff" else v.value.decode("latin-1") if isinstance(v.value, bytes) else str(v.value)
        top = form.get("Fields")
        todo = [(ref, "", {}) for ref in reversed(top.value if top is not None and top.kind == "array" else [])]
        seen = set()
        while todo:
            ref, prefix, above = todo.pop()
            node = at(ref)
            number = ref.value[0] if ref.kind == "reference" else None
            if node is None or number in seen:
                continue
            seen.add(number)
            part = said(node.get("T"))
            path = prefix if part is None else f"{prefix}.{part}" if prefix else part
            own = {k: v for k in ("FT", "V", "DV", "Ff", "DA", "Q") if (v := node.get(k) or above.get(k) or (form.get(k) if k in ("DA", "Q") else None)) is not None}
            kids = node.get("Kids")
            if kids is not None and kids.kind == "array":
                todo += [(k, path, own) for k in reversed(kids.value)]
            if "FT" in own:
                yield number, path, said(own["FT"]), said(own.get("V")), said(own.get("DV")), int(own["Ff"].value) if "Ff" in own else 0, said(own.get("DA")), int(own["Q"].value) if "Q" in own else 0

    return parsed(documents, "obj_no int, name string, field_type string, value string, default_value string, flags int, appearance string, quadding int", work, password)


def said(node: syntax.Node | None) -> str | None:
    """A string's or name's text."""
    if node is None:
        return None
    if isinstance(node.value, bytes):
        return node.value.decode("utf-16-be", "replace")[1:] if node.value[:2] == b"\xfe\xff" else node.value.decode("latin-1")
    return None if node.value is None else str(node.value)


def follower(doc: syntax.Document):
    """Values behind references, over references to references; None where one leads nowhere."""
    live = doc.live()

    def at(node: syntax.Node | None) -> syntax.Node | None:
        for _ in range(32):
            if node is None or node.kind != "reference":
                return node
            found = live.get(node.value[0])
            node = found.node if found else None
        return None

    return at


def annotations(documents: DataFrame, password: str = "") -> DataFrame:
    """Annotations page by page: kind, normalised rectangle, flags, the states of the normal appearance and the present one, whether it is a widget, its parent and the page it names itself."""

    def work(doc):
        at = follower(doc)
        for i, (number, page) in enumerate(leaves(doc)):
            listed = at(page.get("Annots"))
            for j, ref in enumerate(listed.value if listed is not None and listed.kind == "array" else []):
                node = at(ref)
                if node is None or node.kind != "dictionary":
                    continue
                corners = [float(v.value) for v in map(at, at(node.get("Rect")).value) if v is not None and v.kind == "number"] if at(node.get("Rect")) is not None and at(node.get("Rect")).kind == "array" else []
                x1, y1, x2, y2 = corners if len(corners) == 4 else [0.0] * 4
                normal = at(at(node.get("AP")).get("N")) if at(node.get("AP")) is not None else None
                states = [k for k, _ in normal.value] if normal is not None and normal.kind == "dictionary" else []
                parent, own_page, subtype = node.get("Parent"), node.get("P"), said(node.get("Subtype"))
                yield i, number, j, ref.value[0] if ref.kind == "reference" else None, subtype, [min(x1, x2), min(y1, y2), max(x1, x2), max(y1, y2)], node.number("F"), states, said(node.get("AS")), subtype == "Widget", parent.value[0] if parent is not None and parent.kind == "reference" else None, own_page.value[0] if own_page is not None and own_page.kind == "reference" else None

    return parsed(documents, "page_no int, page_obj int, place int, obj_no int, subtype string, rect array<double>, flags int, states array<string>, state string, is_widget boolean, parent_obj int, own_page int", work, password)


def options(documents: DataFrame, password: str = "") -> DataFrame:
    """The options of choice fields in order: what is exported and what is shown (one string is both), and whether it is chosen."""

    def work(doc):
        at = follower(doc)
        for number, o in sorted(doc.live().items()):
            listed = at(o.node.get("Opt")) if o.node is not None and o.node.kind == "dictionary" else None
            if listed is None or listed.kind != "array":
                continue
            held = at(o.node.get("V"))
            chosen = {said(at(v)) for v in held.value} if held is not None and held.kind == "array" else {said(held)} if held is not None else set()
            for i, item in enumerate(map(at, listed.value)):
                pair = [said(at(v)) for v in item.value[:2]] if item is not None and item.kind == "array" else [said(item)] * 2
                if len(pair) == 2:
                    yield number, i, pair[0], pair[1], pair[0] in chosen

    return parsed(documents, "obj_no int, place int, export string, shown string, chosen boolean", work, password)


def form_file(fields: list[tuple[str, str, dict]], pages: int = 1) -> bytes:
    """A file with a form: (name, type, entries) of each field, whose widgets go to the pages in turn."""
    kids = [(3 + i, 0) for i in range(pages)]
    first = 3 + pages
    objects: dict[int, object] = {
        1: {"Type": "/Catalog", "Pages": (2, 0), "AcroForm": {"Fields": [(first + i, 0) for i in range(len(fields))], "DA": b"/Helv 0 Tf 0 g"}},
        2: {"Type": "/Pages", "Kids": kids, "Count": pages},
    }
    for i in range(pages):
        objects[3 + i] = {"Type": "/Page", "Parent": (2, 0), "MediaBox": [0, 0, 612, 792], "Annots": [(first + k, 0) for k in range(i, len(fields), pages)]}
    for i, (name, kind, entries) in enumerate(fields):
        objects[first + i] = {"Type": "/Annot", "Subtype": "/Widget", "FT": "/" + kind, "T": name.encode("latin-1", "replace"), "Rect": [0, 0, 10, 10], "P": kids[i % pages]} | entries
    return syntax.write(objects, 1)


def write(texts: DataFrame, id_col: str = "doc_id", text_col: str = "text", version: int = 0, password: str = "", owner: str | None = None, permission: int = -4, compressed: bool = False, revision: int = 6) -> DataFrame:
    """(doc_id, content): a file of one page for each text, which its content stream shows.

    ``version`` 1, 2, 4 or 5: encrypted with the passwords of user and owner. ``compressed``: with object streams and an index stream.
    """
    protect = {"version": version, "user": password.encode(), "owner": None if owner is None else owner.encode(), "permission": permission, "revision": revision} if version else None
    small_batches(texts.sparkSession)
    kind = dict(texts.dtypes)[id_col]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = []
            for n, text in zip(batch.column("doc_id").to_pylist(), batch.column("text").to_pylist()):
                shown = syntax.dump(b"\xfe\xff" + (text or "").encode("utf-16-be"))
                content = b"BT /F1 12 Tf 72 720 Td " + shown + b" Tj ET"
                made.append(syntax.write({1: {"Type": "/Catalog", "Pages": (2, 0)}, 2: {"Type": "/Pages", "Kids": [(3, 0)], "Count": 1}, 3: {"Type": "/Page", "Parent": (2, 0), "MediaBox": [0, 0, 612, 792], "Contents": (4, 0), "Resources": {"Font": {"F1": (5, 0)}}}, 4: ({}, content), 5: {"Type": "/Font", "Subtype": "/Type1", "BaseFont": "/Helvetica"}}, 1, protect=protect and protect | {"seed": f"{n}".encode()}, compressed=compressed))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.binary())], ["doc_id", "content"])

    return texts.select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")).mapInArrow(run, f"doc_id {kind}, content binary")


def write_pages(pages: DataFrame) -> DataFrame:
    """(doc_id, content): a file of each document's pages (doc_id, page_no, text, width, height, rotate), in order of their numbers, in a tree of up to ten a branch."""
    small_batches(pages.sparkSession)
    kind = dict(pages.dtypes)["doc_id"]
    held = pages.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("page_no", "text", F.col("width").cast("long").alias("width"), F.col("height").cast("long").alias("height"), F.col("rotate").cast("long").alias("rotate")))).alias("pages"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches):
            made = []
            for own in batch.column("pages").to_pylist():
                branches = [own[i : i + 10] for i in range(0, len(own), 10)]
                objects: dict[int, object] = {1: {"Type": "/Catalog", "Pages": (2, 0)}, 3: {"Type": "/Font", "Subtype": "/Type1", "BaseFont": "/Helvetica"}}
                number, kids = 4, []
                for branch in branches:
                    node, leaves_ = number, []
                    number += 1
                    for page in branch:
                        shown = b"BT /F1 12 Tf 72 720 Td " + syntax.dump(b"\xfe\xff" + (page["text"] or "").encode("utf-16-be")) + b" Tj ET"
                        objects[number] = {"Type": "/Page", "Parent": (node, 0), "MediaBox": [0, 0, page["width"], page["height"]], "Rotate": page["rotate"], "Contents": (number + 1, 0), "Resources": {"Font": {"F1": (3, 0)}}}
                        objects[number + 1] = ({}, shown)
                        leaves_.append((number, 0))
                        number += 2
                    objects[node] = {"Type": "/Pages", "Parent": (2, 0), "Kids": leaves_, "Count": len(leaves_)}
                    kids.append((node, 0))
                objects[2] = {"Type": "/Pages", "Kids": kids, "Count": len(own)}
                made.append(syntax.write(dict(sorted(objects.items())), 1))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(made, pa.binary())], ["doc_id", "content"])

    return held.mapInArrow(run, f"doc_id {kind}, content binary")


def page_texts(documents: DataFrame, password: str = "") -> DataFrame:
    """(doc_id, n_pages, n_objects, digest): the md5 of the UTF-8 text that the pages' content streams show."""
    import hashlib

    def work(doc):
        live, shown, n = doc.live(), [], 0
        for _, page in leaves(doc):
            n += 1
            body = page.get("Contents")
            refs = body.value if body is not None and body.kind == "array" else [body] if body is not None else []
            for ref in refs:
                found = live.get(ref.value[0])
                for t in syntax.tokens(syntax.stream_data(found.node)) if found else ():
                    if t.kind == "string":
                        data = syntax.unescape_bytes(t.data[1:-1])
                        shown.append(data[2:].decode("utf-16-be") if data[:2] == b"\xfe\xff" else data.decode("latin-1"))
        yield n, len(live), hashlib.md5("".join(shown).encode()).hexdigest()

    return parsed(documents, "n_pages int, n_objects int, digest string", work, password)


def serialised(tokens_: DataFrame) -> DataFrame:
    """(doc_id, pos, byte_offset, length) of tokens when written one after another."""
    w = W.partitionBy("doc_id").orderBy("pos").rowsBetween(W.unboundedPreceding, -1)
    return tokens_.select("doc_id", "pos", F.coalesce(F.sum("length").over(w), F.lit(0)).alias("byte_offset"), "length")
