"""Office packages: parts under guards, relationships, content types, XML nodes; and rewritten packages.

Files come through Spark's binaryFile reader, so that any store that Spark reads will do. Nothing raises on bad data: a
package that breaks a guard gives one row with an error code.
"""

from __future__ import annotations

import io
import posixpath
import re
import zipfile
from collections.abc import Iterator
from dataclasses import dataclass
from urllib.parse import unquote, urlsplit

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType
from pyspark.sql.window import Window

#: Formats by suffix, with their main part's content type and the MIME types of uploads.
FORMATS = {
    ".pptx": ("pptx", "application/vnd.openxmlformats-officedocument.presentationml.presentation.main+xml", "application/vnd.openxmlformats-officedocument.presentationml.presentation"),
    ".docx": ("docx", "application/vnd.openxmlformats-officedocument.wordprocessingml.document.main+xml", "application/vnd.openxmlformats-officedocument.wordprocessingml.document"),
    ".xlsx": ("xlsx", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml", "application/vnd.openxmlformats-officedocument.spreadsheetml.sheet"),
    ".xlsm": ("xlsm", "application/vnd.ms-excel.sheet.macroEnabled.main+xml", "application/vnd.ms-excel.sheet.macroEnabled.12"),
    ".pub": ("pub", "", "application/x-mspublisher"),
}
OLE_MAGIC = bytes.fromhex("d0cf11e0a1b11ae1")
ZIP_MAGIC = b"PK\x03\x04"


@dataclass(frozen=True)
class Limits:
    """What a package may hold."""

    package_bytes: int = 200 << 20
    entries: int = 5_000
    part_bytes: int = 50 << 20
    total_bytes: int = 600 << 20
    ratio: int = 200
    xml_elements: int = 500_000
    macros: bool = False


PART = "package string, ord int, part string, content binary, bytes bigint, stored bigint, error string"


def formats(spark: SparkSession) -> DataFrame:
    """The formats as a small table."""
    return spark.createDataFrame([(s, f, m) for s, (f, _, m) in FORMATS.items()], "suffix string, format string, mime string")


def format_of(name: Column) -> Column:
    """The format of a file name, by its suffix in any case; null if none."""
    suffix = F.lower(F.regexp_extract(name, r"(\.[^.]+)$", 1))
    return F.create_map(*[F.lit(x) for s, (f, _, _) in FORMATS.items() for x in (s, f)])[suffix]


def upload_error(name: Column, mime: Column) -> Column:
    """The error code of an upload's name and type; null if there is none."""
    kind = F.lower(F.trim(F.split(F.coalesce(mime, F.lit("")), ";")[0]))
    own = F.create_map(*[F.lit(x) for f, _, m in FORMATS.values() for x in (f, m)])
    bad_name = (F.coalesce(F.length(name), F.lit(0)) == 0) | (F.length(name) > 240) | F.rlike(name, F.lit(r"[/\\\x00-\x1f\x7f]"))
    return F.when(bad_name, "invalid_name").when(format_of(name).isNull(), "unsupported_type").when(~kind.isin("", "application/octet-stream") & (kind != own[format_of(name)]), "invalid_mime")


def signature_error(content: Column) -> Column:
    head = F.hex(F.substring(content, 1, 8))
    return F.when(head == OLE_MAGIC.hex().upper(), "encrypted_package").when(~F.startswith(head, F.lit(ZIP_MAGIC.hex().upper())), "invalid_signature")


def _unsafe(name: str) -> bool:
    parts = name.replace("\\", "/").split("/")
    return not name or "\\" in name or "\0" in name or name.startswith("/") or ".." in parts or bool(re.match(r"[A-Za-z]:", name))


def package_parts(name: str, content: bytes, limits: Limits) -> Iterator[tuple]:
    """Rows of PART for one package; a broken guard gives one row with its code, the first in the order of the checks."""
    fail = lambda code: iter([(name, -1, None, None, None, None, code)])
    if len(content) > limits.package_bytes:
        return fail("package_limit")
    if content[:8] == OLE_MAGIC:
        return fail("encrypted_package")
    if content[:4] != ZIP_MAGIC:
        return fail("invalid_signature")
    try:
        archive = zipfile.ZipFile(io.BytesIO(content))
        entries = archive.infolist()
    except (zipfile.BadZipFile, ValueError, OSError, RuntimeError, NotImplementedError):
        return fail("invalid_package")
    if len(entries) > limits.entries:
        return fail("entry_limit")
    seen: set[str] = set()
    total, rows = 0, []
    for i, e in enumerate(entries):
        if _unsafe(e.filename) or (e.external_attr >> 16) & 0o170000 == 0o120000:
            return fail("unsafe_path")
        if e.is_dir():
            continue
        if (key := e.filename.casefold()) in seen:
            return fail("duplicate_part")
        seen.add(key)
        if e.flag_bits & 1 or e.compress_type not in (zipfile.ZIP_STORED, zipfile.ZIP_DEFLATED):
            return fail("unsupported_compression")
        total += e.file_size
        if total > limits.total_bytes or e.file_size > max(e.compress_size, 1) * limits.ratio:
            return fail("expansion_limit")
        if e.file_size > limits.part_bytes:
            rows.append((name, i, e.filename, None, e.file_size, e.compress_size, "part_limit"))
            continue
        try:
            data = archive.read(e)
        except (zipfile.BadZipFile, OSError, EOFError, ValueError, RuntimeError):
            rows.append((name, i, e.filename, None, e.file_size, e.compress_size, "damaged_part"))
            continue
        rows.append((name, i, e.filename, data, e.file_size, e.compress_size, None))
    if "[content_types].xml" not in seen:
        return fail("missing_content_types")
    if not limits.macros and any(k.endswith("vbaproject.bin") for k in seen):
        return fail("macros_not_allowed")
    return iter(rows)


def read_files(spark: SparkSession, path: str, pattern: str = "*") -> DataFrame:
    return spark.read.format("binaryFile").option("pathGlobFilter", pattern).option("recursiveFileLookup", "true").load(path)


def parts(files: DataFrame, limits: Limits | None = None) -> DataFrame:
    """Parts of packages (path, content): one package in memory at a time, each part a row."""
    held = limits or Limits()

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("package", pa.string()), ("ord", pa.int32()), ("part", pa.string()), ("content", pa.binary()), ("bytes", pa.int64()), ("stored", pa.int64()), ("error", pa.string())])
        for batch in batches:
            for i in range(batch.num_rows):
                rows = list(package_parts(batch.column(0)[i].as_py(), batch.column(1)[i].as_py() or b"", held))
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return files.select("path", "content").mapInArrow(work, PART)


NODE = "package string, part string, node int, parent int, ord int, depth int, ns string, tag string, text string, tail string, attrs map<string,string>, path array<struct<node:int,tag:string>>, error string"


def xml_nodes(name: str, part: str, data: bytes, most: int) -> Iterator[tuple]:
    """Rows of NODE in document order; one row with an error code for what isn't plain, bounded XML."""
    from xml.parsers import expat

    rows: list[list] = []
    stack: list[int] = []
    problem: list[str] = []
    parser = expat.ParserCreate(namespace_separator="}")

    def refuse(*_: object) -> int:
        problem.append("invalid_xml")
        return 0

    def start(tag: str, attrs: dict) -> None:
        if len(rows) >= most:
            problem.append("xml_limit")
        if problem:
            return
        ns, _, local = tag.rpartition("}")
        node = len(rows)
        path = [*(rows[stack[-1]][11] if stack else []), {"node": node, "tag": local}]
        rows.append([name, part, node, stack[-1] if stack else None, node, len(stack), ns, local, "", "", dict(attrs), path, None])
        stack.append(node)

    def end(_: str) -> None:
        if stack and not problem:
            last[0] = stack.pop()

    def text(data_: str) -> None:
        if problem or not rows:
            return
        if stack and (last[0] is None or rows[last[0]][3] != stack[-1]):
            rows[stack[-1]][8] += data_
        elif last[0] is not None:
            rows[last[0]][9] += data_

    last: list[int | None] = [None]
    parser.StartElementHandler, parser.EndElementHandler, parser.CharacterDataHandler = start, end, text
    parser.StartDoctypeDeclHandler = refuse
    parser.EntityDeclHandler = refuse
    try:
        parser.Parse(data, True)
    except expat.ExpatError:
        problem.append("invalid_xml")
    if problem:
        return iter([(name, part, -1, None, -1, 0, None, None, None, None, None, None, problem[0])])
    return (tuple(r) for r in rows)


def nodes(part_rows: DataFrame, most: int = Limits.xml_elements) -> DataFrame:
    """The XML nodes of parts, flat: with parent, depth and the path of ancestors."""

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        s, i = pa.string(), pa.int32()
        kinds = [s, s, i, i, i, i, s, s, s, s, pa.map_(s, s), pa.list_(pa.struct([("node", i), ("tag", s)])), s]
        names = [x.split()[0] for x in re.split(r", (?![^<]*>)", NODE)]
        for batch in batches:
            for k in range(batch.num_rows):
                rows = list(xml_nodes(batch.column(0)[k].as_py(), batch.column(1)[k].as_py(), batch.column(2)[k].as_py(), most))
                for a in range(0, len(rows), 20_000):
                    cols = list(zip(*rows[a : a + 20_000], strict=True))
                    cols[10] = [None if m is None else list(m.items()) for m in cols[10]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], names)

    own = part_rows.where("content is not null and (part like '%.xml' or part like '%.rels' or part like '%.vml')")
    return own.select("package", "part", "content").mapInArrow(work, NODE)


def rels_owner(part: str) -> str:
    """The part that a relationships part belongs to: a/_rels/b.xml.rels to a/b.xml, the root's to the empty name."""
    folder, name = posixpath.split(part)
    return posixpath.join(posixpath.dirname(folder), name.removesuffix(".rels")) if name != ".rels" else ""


def resolved_target(owner: str, target: str) -> str | None:
    """The part that an internal target names; None if it is unsafe."""
    target = unquote(target or "")
    if "\\" in target or "\0" in target or urlsplit(target).scheme:
        return None
    target = target.split("#", 1)[0]
    joined = target.lstrip("/") if target.startswith("/") else posixpath.join(posixpath.dirname(owner), target)
    clean = posixpath.normpath(joined) if joined else ""
    return None if clean.startswith("..") or clean in (".", "/") else clean


@F.udf(StringType())
def _resolved(owner: str | None, target: str | None) -> str | None:
    return resolved_target(owner or "", target or "")


def relationships(node_rows: DataFrame, part_rows: DataFrame) -> DataFrame:
    """(package, owner, id, type, target, external, resolved, missing, error) of all relationships.

    A target is looked up in any case; one that isn't there is flagged. Ids that repeat or are empty, and targets that
    leave the package, are errors.
    """
    rel = node_rows.where("tag = 'Relationship' and part like '%.rels'")
    folder = F.regexp_replace("part", r"_rels/([^/]*)\.rels$", "$1")
    rows = rel.select(
        "package",
        folder.alias("owner"),
        F.col("attrs")["Id"].alias("id"),
        F.col("attrs")["Type"].alias("type"),
        F.col("attrs")["Target"].alias("target"),
        (F.lower(F.coalesce(F.col("attrs")["TargetMode"], F.lit(""))) == "external").alias("external"),
    )
    rows = rows.withColumn("wanted", F.when(~F.col("external"), _resolved("owner", "target")))
    known = part_rows.where("part is not null").select("package", F.lower("part").alias("__key"), F.col("part").alias("resolved"))
    found = rows.withColumn("__key", F.lower("wanted")).join(known, ["package", "__key"], "left")
    n = F.count(F.lit(1)).over(Window.partitionBy("package", "owner", "id"))
    error = F.when(F.coalesce("id", F.lit("")) == "", "invalid_relationship").when(n > 1, "duplicate_relationship").when(~F.col("external") & F.col("wanted").isNull(), "unsafe_relationship")
    return found.select("package", "owner", "id", "type", "target", "external", "resolved", (~F.col("external") & F.col("resolved").isNull()).alias("missing"), error.alias("error"))


def content_types(part_rows: DataFrame, node_rows: DataFrame) -> DataFrame:
    """Parts with their type: by override, else by extension, else octet-stream."""
    types = node_rows.where("part = '[Content_Types].xml'")
    over = types.where("tag = 'Override'").select("package", F.lower(F.ltrim(F.col("attrs")["PartName"], F.lit("/"))).alias("__part"), F.col("attrs")["ContentType"].alias("__over"))
    by = types.where("tag = 'Default'").select("package", F.lower(F.col("attrs")["Extension"]).alias("__ext"), F.col("attrs")["ContentType"].alias("__default"))
    own = part_rows.where("part is not null").withColumn("__part", F.lower("part")).withColumn("__ext", F.lower(F.regexp_extract("part", r"\.([^./]+)$", 1)))
    out = own.join(over, ["package", "__part"], "left").join(by, ["package", "__ext"], "left")
    return out.withColumn("content_type", F.coalesce("__over", "__default", F.lit("application/octet-stream"))).drop("__part", "__ext", "__over", "__default")


def feature_counts(part_rows: DataFrame) -> DataFrame:
    """How many parts of each package have a feature, by path."""
    own = lambda prefix: F.count(F.when(F.startswith("part", F.lit(prefix)) & ~F.endswith("part", F.lit(".rels")), 1))
    kinds = {"pivots": "xl/pivotTables/", "queries": "xl/queryTables/", "connections": "xl/connections", "forms": "xl/ctrlProps/", "activex": "xl/activeX/", "embedded": "xl/embeddings/", "charts": "xl/charts/chart", "external_links": "xl/externalLinks/externalLink"}
    return part_rows.groupBy("package").agg(*[own(p).alias(k) for k, p in kinds.items()])


def cells(part_rows: DataFrame, node_rows: DataFrame) -> DataFrame:
    """(package, part, ref, type, has_formula, formula_type, value, text_length, is_text): facts of worksheet cells."""
    sheet = node_rows.where("part like 'xl/worksheets/%.xml'")
    c = sheet.where("tag = 'c'").select("package", "part", F.col("node").alias("parent"), F.col("attrs")["r"].alias("ref"), F.coalesce(F.col("attrs")["t"], F.lit("n")).alias("type"))
    inner = sheet.where("tag in ('v', 'f', 't')").withColumn("cell", F.element_at(F.filter("path", lambda p: p["tag"] == "c"), -1)["node"])
    facts = inner.groupBy("package", "part", F.col("cell").alias("parent")).agg(
        F.max(F.when(F.col("tag") == "v", F.col("text"))).alias("value"),
        F.bool_or(F.col("tag") == "f").alias("has_formula"),
        F.max(F.when(F.col("tag") == "f", F.coalesce(F.col("attrs")["t"], F.lit("ordinary")))).alias("formula_type"),
        F.max(F.when(F.col("tag") == "f", F.length("text"))).alias("formula_length"),
        F.sum(F.when(F.col("tag") == "t", F.length("text"))).alias("inline_length"),
        F.max(F.when(F.col("tag") == "t", F.col("text"))).alias("inline_text"),
    )
    strings = node_rows.where("part = 'xl/sharedStrings.xml'")
    si = strings.where("tag = 't'").withColumn("si", F.element_at(F.filter("path", lambda p: p["tag"] == "si"), -1)["node"])
    shared = si.groupBy("package", "si").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("ord", "text"))), lambda x: x["text"]), "").alias("shared"))
    index = strings.where("tag = 'si'").select("package", F.col("node").alias("si"), (F.row_number().over(Window.partitionBy("package").orderBy("ord")) - 1).cast("string").alias("value_key"))
    by_index = index.join(shared, ["package", "si"], "left").select("package", "value_key", F.coalesce("shared", F.lit("")).alias("shared"))
    own = c.join(facts, ["package", "part", "parent"], "left").withColumn("value_key", F.when(F.col("type") == "s", F.trim("value")))
    out = own.join(by_index, ["package", "value_key"], "left")
    text = F.when(F.col("type") == "s", F.col("shared")).when(F.col("type") == "inlineStr", F.col("inline_text")).when(F.col("type") == "str", F.col("value"))
    length = F.greatest(F.coalesce(F.length(text), F.lit(0)), F.coalesce("formula_length", F.lit(0)))
    return out.select("package", "part", "ref", "type", F.coalesce("has_formula", F.lit(False)).alias("has_formula"), "formula_type", "value", length.alias("text_length"), text.alias("text"), (F.col("value").isNotNull() | F.col("inline_text").isNotNull() | F.coalesce("has_formula", F.lit(False))).alias("populated"))


def sheet_rollup(cell_rows: DataFrame, most_text: int = 50_000) -> DataFrame:
    """(package, part, max_row, max_col, populated, formulas, errors, text_dates, oversized) of each sheet."""
    from ..functions.text import is_text_date, reference_column, reference_row

    dates = ~F.col("has_formula") & F.col("type").isin("s", "inlineStr") & is_text_date(F.col("text"))
    return cell_rows.groupBy("package", "part").agg(
        F.coalesce(F.max(reference_row(F.col("ref"))), F.lit(0)).alias("max_row"),
        F.coalesce(F.max(reference_column(F.col("ref"))), F.lit(0)).alias("max_col"),
        F.count(F.when(F.col("populated"), 1)).alias("populated"),
        F.count(F.when(F.col("has_formula"), 1)).alias("formulas"),
        F.count(F.when(F.col("type") == "e", 1)).alias("errors"),
        F.count(F.when(dates, 1)).alias("text_dates"),
        F.count(F.when(F.col("text_length") > most_text, 1)).alias("oversized"),
    )


def workbook_rollup(sheets: DataFrame) -> DataFrame:
    """Sums over the sheets of each workbook, and the cells of their grids."""
    total = [F.sum(c).alias(c) for c in ("populated", "formulas", "errors", "text_dates", "oversized")]
    return sheets.groupBy("package").agg(F.count(F.lit(1)).alias("sheets"), F.sum(F.col("max_row") * F.col("max_col")).alias("grid_cells"), F.max("max_col").alias("max_col"), *total)


def paragraph_texts(node_rows: DataFrame) -> DataFrame:
    """(package, part, ord, text) of the paragraphs of slides and documents: runs joined, tabs and breaks kept as such."""
    piece = F.when(F.col("tag") == "t", F.col("text")).when(F.col("tag") == "tab", F.lit("\t")).when(F.col("tag").isin("br", "cr"), F.lit("\n")).when(F.col("tag") == "noBreakHyphen", F.lit("-")).when(F.col("tag") == "softHyphen", F.lit("")).when(F.col("tag") == "sym", F.lit("\x00"))
    hidden = F.exists("path", lambda p: p["tag"].isin("Fallback", "del", "pPr", "rPr"))
    own = node_rows.where(piece.isNotNull() & ~hidden).withColumn("p", F.element_at(F.filter("path", lambda p: p["tag"] == "p"), -1)["node"]).where("p is not null")
    grouped = own.groupBy("package", "part", "p").agg(F.array_sort(F.collect_list(F.struct(F.col("ord"), piece.alias("piece")))).alias("x"))
    return grouped.select("package", "part", F.col("p").alias("ord"), F.array_join(F.transform("x", lambda x: x["piece"]), "").alias("text"))


def slide_list(node_rows: DataFrame, rels: DataFrame) -> DataFrame:
    """(package, position, part) of slides in the order of the deck, with an error where the list does not resolve."""
    ids = node_rows.where("part = 'ppt/presentation.xml' and tag = 'sldId'")
    listed = ids.select("package", F.element_at(F.map_filter("attrs", lambda k, v: F.endswith(k, F.lit("}id"))), F.lit("http://schemas.openxmlformats.org/officeDocument/2006/relationships}id")).alias("id"), F.row_number().over(Window.partitionBy("package").orderBy("ord")).alias("position"))
    own = rels.where("owner = 'ppt/presentation.xml'").select("package", "id", "type", "external", "resolved")
    out = listed.join(own, ["package", "id"], "left")
    again = F.count(F.lit(1)).over(Window.partitionBy("package", "resolved"))
    error = F.when(F.coalesce("external", F.lit(False)), "external_slide").when(F.col("resolved").isNull(), "missing_slide").when(~F.endswith("type", F.lit("/slide")), "invalid_slide").when(again > 1, "repeated_slide")
    return out.select("package", "position", F.col("resolved").alias("part"), error.alias("error"))


def media_assets(part_rows: DataFrame, prefix: str = "ppt/media/") -> DataFrame:
    """Distinct media of each package by content, first part by name."""
    own = part_rows.where(F.startswith("part", F.lit(prefix)) & F.col("content").isNotNull())
    return own.groupBy("package", F.sha2("content", 256).alias("sha256")).agg(F.min("part").alias("first_part"), F.array_sort(F.collect_list("part")).alias("parts"), F.max("bytes").alias("bytes"))


def picture_size(content: Column) -> Column:
    """(kind, width, height) from the head of a PNG, GIF or BMP, without decoding; nulls for others."""
    number = lambda at, n: F.conv(F.hex(F.substring(content, at, n)), 16, 10).cast("long")
    little = lambda at, n: F.conv(F.concat(*[F.hex(F.substring(content, at + k, 1)) for k in range(n - 1, -1, -1)]), 16, 10).cast("long")
    head = F.hex(F.substring(content, 1, 8))
    kind = F.when(head == "89504E470D0A1A0A", "png").when(F.startswith(head, F.lit("474946")), "gif").when(F.startswith(head, F.lit("424D")), "bmp").when(F.startswith(head, F.lit("FFD8FF")), "jpeg")
    return F.struct(
        kind.alias("kind"),
        F.when(kind == "png", number(17, 4)).when(kind == "gif", little(7, 2)).when(kind == "bmp", little(19, 4)).alias("width"),
        F.when(kind == "png", number(21, 4)).when(kind == "gif", little(9, 2)).when(kind == "bmp", little(23, 4)).alias("height"),
    )


def pdf_pages(content: bytes) -> int | None:
    """Pages of a plain PDF by its page objects; None if it is encrypted or unreadable."""
    if not content or not content.startswith(b"%PDF-") or b"/Encrypt" in content:
        return None
    n = len(re.findall(rb"/Type\s*/Page(?![a-zA-Z])", content))
    return n or None


def write_packages(part_rows: DataFrame, path: str) -> DataFrame:
    """(package, file, bytes): packages zipped again from their parts, sorted by name, as Parquet rows below ``path``.

    A package is built in one task, as its archive is one file; parts arrive sorted, so only the archive is held.
    """

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, buffer, archive = None, None, None

        def closed() -> pa.RecordBatch:
            archive.close()
            data = buffer.getvalue()
            return pa.RecordBatch.from_arrays([pa.array([current]), pa.array([data], pa.binary()), pa.array([len(data)], pa.int64())], ["package", "content", "bytes"])

        for batch in batches:
            for i in range(batch.num_rows):
                name = batch.column(0)[i].as_py()
                if name != current:
                    if archive is not None:
                        yield closed()
                    current, buffer = name, io.BytesIO()
                    archive = zipfile.ZipFile(buffer, "w", zipfile.ZIP_DEFLATED)
                info = zipfile.ZipInfo(batch.column(1)[i].as_py(), (1980, 1, 1, 0, 0, 0))
                info.compress_type = zipfile.ZIP_DEFLATED
                archive.writestr(info, batch.column(2)[i].as_py())
        if archive is not None:
            yield closed()

    own = part_rows.where("part is not null and content is not null").select("package", "part", "content")
    rows = own.repartition("package").sortWithinPartitions("package", "part").mapInArrow(work, "package string, content binary, bytes bigint")
    rows.write.mode("overwrite").parquet(path)
    return part_rows.sparkSession.read.parquet(path)


def replaced(part_rows: DataFrame, changes: DataFrame, dropped: DataFrame | None = None) -> DataFrame:
    """Parts with changed contents (package, part, content), without the dropped ones (package, part)."""
    new = changes.select("package", "part", F.col("content").alias("__new"))
    out = part_rows.join(new, ["package", "part"], "left").withColumn("content", F.coalesce("__new", "content")).drop("__new")
    return out if dropped is None else out.join(dropped.select("package", "part"), ["package", "part"], "left_anti")

