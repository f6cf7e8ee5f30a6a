import time
import zlib

from lectern.operators import geometry, lines
from lectern.sources import pdf, store
from lectern.streaming import drop_folder


def small_pdf(compress=True):
    body = b"q 2 0 0 2 10 20 cm 0 0 30 40 re S Q BT /F1 12 Tf 1 0 0 1 50 700 Tm (Hello \\(PDF\\)) Tj 0 -20 Td [(wor) -20 (ld)] TJ ET q 100 0 0 50 0 0 cm /Im1 Do Q"
    data = zlib.compress(body) if compress else body
    head = b"<< /Length %d %s>>" % (len(data), b"/Filter /FlateDecode " if compress else b"")
    parts = [
        b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj",
        b"2 0 obj << /Type /Pages /Kids [3 0 R] /Count 1 /MediaBox [0 0 595 842] >> endobj",
        b"3 0 obj << /Type /Page /Parent 2 0 R /Contents 4 0 R >> endobj",
        b"4 0 obj " + head + b" stream\n" + data + b"\nendstream endobj",
    ]
    return b"%PDF-1.4\n" + b"\n".join(parts) + b"\n%%EOF"


def test_pdf_scan(spark, tmp_path):
    (tmp_path / "June 2024 Question Paper 11.pdf").write_bytes(small_pdf())
    (tmp_path / "plain.pdf").write_bytes(small_pdf(False))
    (tmp_path / "broken.pdf").write_bytes(b"nothing")
    pages = pdf.scan(spark, str(tmp_path)).cache()
    assert {r["resource_id"]: r["error"] for r in pages.collect()} == {"June 2024 Question Paper 11": None, "plain": None, "broken": "not a PDF"}
    runs = pdf.text_elements(pages).where("resource_id = 'plain'")
    assert [(r["id"], r["text"], r["x"], r["y"], r["font_size"]) for r in runs.orderBy("ord").collect()] == [("1-0", "Hello (PDF)", 50.0, 130.0, 12.0), ("1-1", "world", 50.0, 150.0, 12.0)]
    assert [r["text"] for r in lines.reconstruct_lines(runs).orderBy("line_ord").collect()] == ["Hello (PDF)", "world"]
    tracked = geometry.track_ctm(pdf.operation_list(pages).where("resource_id = 'plain'"))
    view = geometry.matrix(1.0, 0.0, 0.0, -1.0, 0.0, 842.0)
    box, image = geometry.path_boxes(tracked, view).first(), geometry.image_boxes(tracked, view).first()
    assert (box["x"], box["y"], box["width"], box["height"]) == (10.0, 742.0, 60.0, 80.0)
    assert (image["x"], image["y"], image["width"], image["height"]) == (0.0, 792.0, 100.0, 50.0)


def stream(number, head, data):
    packed = zlib.compress(data)
    return b"%d 0 obj << %s /Length %d /Filter /FlateDecode >> stream\n" % (number, head, len(packed)) + packed + b"\nendstream endobj"


def rich_pdf():
    """Two pages below an inner node: a composite font, a font with widths, a form that paints an image, an inline image, a hidden object."""
    cmap = b"begincmap 1 beginbfchar <0003> <00480069> endbfchar 1 beginbfrange <0010> <0012> <0041> endbfrange endcmap"
    one = b"BT /T0 10 Tf 1 0 0 1 50 700 Tm <000300100012> Tj ET BT /F1 20 Tf 2 Tc 50 600 Td (AB) Tj 100 Tz [(A) 500 (B)] TJ ET q 2 0 0 2 0 0 cm /Fm Do Q"
    two = b"q 10 0 0 10 5 5 cm BI /W 1 /H 1 ID \x01) EI Q 0 0 100 50 re f"
    hidden = b"20 0 << /N 3 >>"
    parts = [
        b"1 0 obj << /Type /Catalog /Pages 2 0 R >> endobj",
        b"2 0 obj << /Type /Pages /Kids [3 0 R] /Count 2 /MediaBox [0 0 600 800] /Resources << /Font << /T0 6 0 R /F1 9 0 R >> /XObject << /Fm 10 0 R >> >> >> endobj",
        b"3 0 obj << /Type /Pages /Parent 2 0 R /Kids [4 0 R 5 0 R] >> endobj",
        b"5 0 obj << /Type /Page /Parent 3 0 R /Contents [13 0 R] >> endobj",
        b"4 0 obj << /Type /Page /Parent 3 0 R /Contents 12 0 R >> endobj",
        b"6 0 obj << /Type /Font /Subtype /Type0 /BaseFont /ABCDEF+Times-Roman /DescendantFonts [7 0 R] /ToUnicode 8 0 R >> endobj",
        b"7 0 obj << /Type /Font /DW 500 /W [3 [1000] 16 17 250] >> endobj",
        stream(8, b"", cmap),
        b"9 0 obj << /Type /Font /Subtype /Type1 /BaseFont /Helvetica /FirstChar 65 /Widths [600 700] >> endobj",
        stream(10, b"/Type /XObject /Subtype /Form /Matrix [1 0 0 1 30 40] /Resources << /XObject << /Im 11 0 R >> >>", b"q 5 0 0 5 0 0 cm /Im Do Q"),
        stream(11, b"/Subtype /Image /Width 2 /Height 1 /BitsPerComponent 8 /ColorSpace [/ICCBased 20 0 R]", b"\x01\x02\x03\x04\x05\x06"),
        stream(12, b"", one),
        stream(13, b"", two),
        stream(14, b"/Type /ObjStm /N 1 /First 5", hidden),
    ]
    return b"%PDF-1.5\n" + b"\n".join(parts) + b"\n%%EOF"


def test_pdf_fonts_forms_and_images(spark, tmp_path):
    (tmp_path / "rich.pdf").write_bytes(rich_pdf())
    pages = pdf.scan(spark, str(tmp_path)).cache()
    assert [(r["page"], r["height"], r["error"]) for r in pages.orderBy("page").collect()] == [(1, 800.0, None), (2, 800.0, None)]
    runs = [(r["text"], r["font_family"], r["x"], r["y"], round(r["width"], 6)) for r in pdf.text_elements(pages).orderBy("page", "ord").collect()]
    assert runs == [("HiAC", "serif", 50.0, 90.0, 17.5), ("AB", "sans-serif", 50.0, 180.0, 30.0), ("AB", "sans-serif", 80.0, 180.0, 20.0)]
    fns = [(r["page"], r["fn"]) for r in pdf.operation_list(pages).orderBy("page", "op_idx").collect()]
    assert fns == [(1, f) for f in ("save", "transform", "paintFormXObjectBegin", "save", "transform", "paintImageXObject", "restore", "paintFormXObjectEnd", "restore")] + [
        (2, f) for f in ("save", "transform", "paintInlineImageXObject", "restore", "constructPath")
    ]
    found = pdf.page_elements(pages)
    (image,) = found["images"].collect()
    assert (image["element_id"], image["x"], image["y"], image["width"], image["height"], bytes(image["pixels"])) == ("1-image-0", 60.0, 710.0, 10.0, 10.0, b"\x01\x02\x03\x04\x05\x06")
    (png,) = store.image_files(found["images"].selectExpr("path", "page", "n", "px_width as width", "px_height as height", "pixels")).collect()
    assert png["image_path"].endswith("rich.images/page-1-image-0.png")
    (drawing,) = found["drawings"].collect()
    assert (drawing["page"], drawing["y"], drawing["width"], drawing["height"]) == (2, 750.0, 100.0, 50.0)


def test_images_and_sidecars(spark):
    rows = [("a/b.pdf", 1, 0, 2, 1, b"\x01\x02\x03\x04\x05\x06"), ("a/b.pdf", 1, 1, 2, 1, b"12"), ("a/b.pdf", 2, 0, 1, 1, None)]
    got = store.image_files(spark.createDataFrame(rows, "path string, page int, n int, width int, height int, pixels binary")).collect()
    assert [r["image_path"] for r in got] == ["a/b.images/page-1-image-0.png"] and bytes(got[0]["png"])[:4] == b"\x89PNG"
    side = store.sidecars(spark.createDataFrame([("x/y.pdf", "QP")], "path string, type string")).first()
    assert (side["path"], side["metadata"]) == ("x/y.pdf.metadata.json", '{"type":"QP"}')


def test_tree_is_pruned(spark, tmp_path):
    df = spark.createDataFrame([("Cambridge", "past-papers/2024", "a"), ("Cambridge", "syllabus", "b")], "board string, category string, title string")
    store.write_tree(df, str(tmp_path / "tree"))
    found = spark.read.parquet(str(tmp_path / "tree")).where("category = 'syllabus'")
    assert [r["title"] for r in found.collect()] == ["b"] and "PartitionFilters: [isnotnull(category" in found._jdf.queryExecution().toString()


def test_drop_folder_is_idempotent(spark, tmp_path):
    folder, target = tmp_path / "in", str(tmp_path / "out")
    folder.mkdir()
    (folder / "June-2024-Question-Paper-11.pdf").write_bytes(b"x")

    def run(n):
        files = drop_folder.read_drop_folder(spark, str(folder))
        drop_folder.catalogue_stream(files, target, str(tmp_path / f"check{n}"), "Cambridge", "Cambridge IGCSE", "0625").awaitTermination(60)
        return sorted(r["resource_id"] for r in spark.read.parquet(target).collect())

    assert run(0) == ["CAM-0625-MJ-2024-11-QP"]
    time.sleep(0.1)
    (folder / "2026-Syllabus.pdf").write_bytes(b"y")
    assert run(1) == ["CAM-0625-MJ-2024-11-QP", "CAM-0625-SYL-2026"]  # a new checkpoint sees the old file again
