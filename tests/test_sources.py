import io
import json
import struct
import zipfile

import pytest
from pyspark.sql import functions as F

from folioscope.sources import bundle, package

TYPES = '<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="main"/></Types>'


def zipped(parts, symlink=None):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        for name, data in parts.items():
            z.writestr(name, data)
    return out.getvalue()


def files(spark, named):
    return spark.createDataFrame([(k, v) for k, v in named.items()], "path string, content binary")


@pytest.mark.parametrize(
    ("content", "code"),
    [
        (package.OLE_MAGIC + b"x", "encrypted_package"),
        (b"hello", "invalid_signature"),
        (b"PK\x03\x04junk", "invalid_package"),
        (zipped({"a.xml": "x"}), "missing_content_types"),
        (zipped({"[Content_Types].xml": TYPES, "../a.xml": "x"}), "unsafe_path"),
        (zipped({"[Content_Types].xml": TYPES, "A.xml": "x", "a.xml": "y"}), "duplicate_part"),
        (zipped({"[Content_Types].xml": TYPES, "big.xml": "0" * 1_000_000}), "expansion_limit"),
        (zipped({"[Content_Types].xml": TYPES, "xl/vbaProject.bin": "x"}), "macros_not_allowed"),
    ],
)
def test_guards(content, code):
    assert [r[6] for r in package.package_parts("p", content, package.Limits())] == [code]


def workbook():
    sheet = '<worksheet><sheetData><row><c r="A1" t="s"><v>1</v></c><c r="C7"><f>A1*2</f><v>4</v></c><c r="B2" t="e"><v>#REF!</v></c><c r="D1" t="inlineStr"><is><t>3/4/21</t></is></c><c r="E1"/></row></sheetData></worksheet>'
    strings = "<sst><si><t>no</t></si><si><r><t>1/2/</t></r><r><t>1999</t></r></si></sst>"
    rels = '<Relationships xmlns="r"><Relationship Id="a" Type="t/sheet" Target="worksheets/Sheet1.xml"/><Relationship Id="b" Type="t/x" Target="http://e.com/x" TargetMode="External"/><Relationship Id="c" Type="t/x" Target="../../up.xml"/><Relationship Id="d" Type="t/x" Target="/xl/gone.xml"/></Relationships>'
    return zipped({"[Content_Types].xml": TYPES, "xl/workbook.xml": "<workbook/>", "xl/worksheets/sheet1.xml": sheet, "xl/sharedStrings.xml": strings, "xl/_rels/workbook.xml.rels": rels})


def test_workbook(spark):
    parts = package.parts(files(spark, {"w.xlsx": workbook()}))
    nodes = package.nodes(parts)
    sheet = package.sheet_rollup(package.cells(parts, nodes)).first()
    assert (sheet.max_row, sheet.max_col, sheet.populated, sheet.formulas, sheet.errors, sheet.text_dates) == (7, 5, 4, 1, 1, 2)
    assert package.workbook_rollup(package.sheet_rollup(package.cells(parts, nodes))).first().grid_cells == 35
    rels = {r.id: (r.resolved, r.missing, r.error) for r in package.relationships(nodes, parts).collect()}
    assert rels == {"a": ("xl/worksheets/sheet1.xml", False, None), "b": (None, False, None), "c": (None, True, "unsafe_relationship"), "d": (None, True, None)}
    kinds = {r.part: r.content_type for r in package.content_types(parts, nodes).collect()}
    assert kinds["xl/workbook.xml"] == "main" and kinds["xl/sharedStrings.xml"] == "application/xml" and kinds["xl/_rels/workbook.xml.rels"] == "application/octet-stream"


def test_xml_guards(spark):
    bad = {"a.xml": b"<a>", "b.xml": b'<!DOCTYPE a [<!ENTITY x "y">]><a>&x;</a>', "c.xml": b"<a><b/><b/><b/></a>"}
    got = {k: [r[12] for r in package.xml_nodes("p", k, v, 3)] for k, v in bad.items()}
    assert got == {"a.xml": ["invalid_xml"], "b.xml": ["invalid_xml"], "c.xml": ["xml_limit"]}
    rows = list(package.xml_nodes("p", "x.xml", b"<a>t<b>u</b>v</a>", 9))
    assert [(r[7], r[8], r[9], r[5]) for r in rows] == [("a", "t", "", 0), ("b", "u", "v", 1)]


def test_deck_and_rewrite(spark, tmp_path):
    R = 'xmlns:r="http://schemas.openxmlformats.org/officeDocument/2006/relationships"'
    deck = {
        "[Content_Types].xml": TYPES,
        "ppt/presentation.xml": f'<p {R}><sldIdLst><sldId r:id="r2"/><sldId r:id="r1"/></sldIdLst></p>',
        "ppt/_rels/presentation.xml.rels": '<Relationships><Relationship Id="r1" Type="x/slide" Target="slides/slide1.xml"/><Relationship Id="r2" Type="x/slide" Target="slides/slide2.xml"/></Relationships>',
        "ppt/slides/slide1.xml": "<sld><p><r><t>one</t></r><br/><r><t>more</t></r></p></sld>",
        "ppt/slides/slide2.xml": "<sld><p><r><t>two</t></r></p></sld>",
        "ppt/media/image1.png": b"same",
        "ppt/media/image2.png": b"same",
    }
    parts = package.parts(files(spark, {"d.pptx": zipped(deck)}))
    nodes = package.nodes(parts)
    slides = package.slide_list(nodes, package.relationships(nodes, parts))
    assert [(r.position, r.part, r.error) for r in slides.orderBy("position").collect()] == [(1, "ppt/slides/slide2.xml", None), (2, "ppt/slides/slide1.xml", None)]
    assert {r.part: r.text for r in package.paragraph_texts(nodes).collect()} == {"ppt/slides/slide1.xml": "one\nmore", "ppt/slides/slide2.xml": "two"}
    assert package.media_assets(parts).first().parts == ["ppt/media/image1.png", "ppt/media/image2.png"]
    changed = spark.createDataFrame([("d.pptx", "ppt/media/image1.png", b"new")], "package string, part string, content binary")
    dropped = spark.createDataFrame([("d.pptx", "ppt/media/image2.png")], "package string, part string")
    out = package.write_packages(package.replaced(parts, changed, dropped), str(tmp_path / "out")).first()
    with zipfile.ZipFile(io.BytesIO(bytes(out.content))) as z:
        assert z.read("ppt/media/image1.png") == b"new" and "ppt/media/image2.png" not in z.namelist() and z.namelist() == sorted(z.namelist())


def test_small_readers(spark):
    png = b"\x89PNG\r\n\x1a\n" + struct.pack(">I", 13) + b"IHDR" + struct.pack(">II", 640, 480)
    df = files(spark, {"a": png, "b": b"GIF89a" + struct.pack("<HH", 3, 4), "c": b"none"})
    assert {r.path: tuple(r.s) for r in df.select("path", package.picture_size(F.col("content")).alias("s")).collect()} == {"a": ("png", 640, 480), "b": ("gif", 3, 4), "c": (None, None, None)}
    assert package.pdf_pages(b"%PDF-1.4 /Type /Pages /Type /Page /Type/Page ") == 2 and package.pdf_pages(b"x") is None
    ups = spark.createDataFrame([("a.docx", None), ("a/b.docx", None), ("a.txt", None), ("a.PPTX", "image/png"), ("a.xlsx", "application/octet-stream; x")], "n string, m string")
    assert [r[0] for r in ups.select(package.upload_error(F.col("n"), F.col("m"))).collect()] == [None, "invalid_name", "unsupported_type", "invalid_mime", None]


def test_bundles(spark, tmp_path):
    element = lambda i, z, **k: {"id": i, "type": "text", "pageIndex": 0, "zIndex": z, "compatibility": {"status": "NATIVE"}, "bounds": {"x": 1.0, "y": 1.0, "width": 2.0, "height": 2.0}} | k
    doc = {
        "document": {"pageCount": 2},
        "assets": {"count": 2, "ids": ["a"]},
        "fonts": [],
        "pages": [
            {"id": "p0", "index": 0, "kind": "page", "elements": [element("e0", 0, parentId="e1"), element("e1", 2), element("e1", 2, image={"assetId": "zz"})]},
            {"id": "p1", "index": 1, "kind": "page", "elements": [element("e3", 0, pageIndex=1)]},
        ],
    }
    (tmp_path / "b.json").write_text(json.dumps(doc))
    read = bundle.read_bundles(spark, str(tmp_path / "b.json"))
    found = sorted(r.code for r in bundle.problems(read).collect())
    assert found == ["asset_count", "duplicate_element", "forward_parent", "sparse_z", "unknown_asset"]
    assert bundle.report(read).first().elements_by_type == {"text": 4}
    assert bundle.probable_masters(read).first().n_pages == 2
