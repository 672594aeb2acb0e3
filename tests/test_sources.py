"""Readers and writers on small texts, and GDSII round trips with every kind of element."""

import xml.etree.ElementTree as ET

import pytest

from maskloom.sources import bookshelf, layout, markup, netlists, oasis


def texts(spark, *values):
    return spark.createDataFrame([(f"f{i}", v) for i, v in enumerate(values)], "path string, value string")


def test_real8():
    for v in (0.0, 1.0, -2.5, 90.0, 270.0, 1e-3, 1e-9, 123456.789):
        assert layout.from_real8(layout.real8(v)) == pytest.approx(v, rel=1e-15)


def test_gds_elements(tmp_path, spark):
    rows = [
        layout.element("A", "box", [(-5, 0), (10, 7)], 1, 2),
        layout.element("A", "polygon", [(0, 0), (0, 9), (4, 9)], 1, 0),
        layout.element("A", "path", [(0, 0), (50, 0), (50, 20)], 3, 1, width=6),
        layout.element("A", "text", [(1, 2)], 7, 0, text="net1"),
        layout.element("B", "ref", [(100, -3)], child="A", rot=1, mirror=True, cols=1, rows=1, col_x=0, col_y=0, row_x=0, row_y=0),
        layout.element("B", "ref", [(0, 0)], child="A", rot=0, mirror=False, cols=3, rows=2, col_x=20, col_y=0, row_x=0, row_y=30),
    ]
    data = layout.gds_head() + b"".join(layout.gds_cell(c, [r for r in rows if r["cell"] == c]) for c in "AB") + layout.gds_tail()
    back = list(layout.parse_gds(data))
    assert [{k: v for k, v in r.items() if v is not None} for r in back] == [{k: v for k, v in r.items() if v is not None} for r in rows]
    with pytest.raises(layout.LayoutError):
        list(layout.parse_gds(data[:-3]))
    (tmp_path / "x.gds").write_bytes(data)
    e = layout.read(spark, str(tmp_path / "x.gds"), "gds").cache()
    assert layout.instances(e).count() == 7 and layout.shapes(e).count() == 4
    assert {(r.x0, r.y0, r.x1, r.y1) for r in layout.shapes(e).filter("kind = 'path'").collect()} == {(-3, -3, 53, 23)}
    layout.save_gds(e, str(tmp_path / "y.gds"))
    assert (tmp_path / "y.gds").read_bytes() == data.replace(b"LIB\0", b"LIB\0")


def test_cif():
    text = b"(a comment; here); DS 2 1 1; L L1; B 100 50 50 25; DF; DS 1; C 2 T 0 0; C 2 R 0 1 T 20 0; C 2 MX T 60 0; L L3; P 0 0 10 0 5 10; DF; C 1; E"
    rows = list(layout.parse_cif(text))
    assert rows[0]["points"] == [(0, 0), (1000, 500)] and rows[0]["layer"] == 1
    assert [(r["rot"], r["mirror"], r["points"][0]) for r in rows[1:4]] == [(0, False, (0, 0)), (1, False, (200, 0)), (2, True, (600, 0))]
    assert rows[4]["kind"] == "polygon" and len(rows[4]["points"]) == 3


def test_dxf():
    pairs = [(0, "SECTION"), (2, "BLOCKS"), (0, "BLOCK"), (2, "B1"), (0, "CIRCLE"), (8, "2"), (10, "0"), (20, "0"), (40, "1"), (0, "ENDBLK"), (0, "ENDSEC"), (0, "LINE"), (8, "1"), (10, "0"), (20, "0"), (11, "10"), (21, "2.5"), (0, "LWPOLYLINE"), (8, "1"), (70, "1"), (10, "0"), (20, "0"), (10, "0"), (20, "2"), (10, "3"), (20, "2"), (10, "3"), (20, "0"), (0, "INSERT"), (2, "B1"), (10, "5"), (20, "6"), (50, "90"), (0, "EOF")]
    rows = list(layout.parse_dxf("\n".join(f"{a}\n{b}" for a, b in pairs).encode()))
    assert [(r["cell"], r["kind"]) for r in rows] == [("B1", "polygon"), ("TOP", "path"), ("TOP", "box"), ("TOP", "ref")]
    assert rows[2]["points"] == [(0, 0), (3000, 2000)] and rows[3]["rot"] == 1 and len(rows[0]["points"]) == 64


def test_mag_use():
    rows = list(layout.parse_mag(b"magic\n<< m1 >>\nrect 0 0 3 4\nuse inv inv_0\ntransform 0 -1 5 1 0 6\nbox 0 0 1 1\n<< end >>\n", "top"))
    assert rows[0]["points"] == [(0, 0), (3000, 4000)] and (rows[1]["child"], rows[1]["rot"], rows[1]["mirror"], rows[1]["points"]) == ("inv", 1, False, [(5000, 6000)])


def test_spef(spark):
    text = '*SPEF "x"\n*DESIGN "d"\n*NAME_MAP\n*1 a\n*2 b\n*D_NET *1 1.5\n*CONN\n*I U1:Y I\n*P port O\n*CAP\n1 *1:GROUND *2:GROUND 0.25\n2 *1 0.5\n*RES\n1 *1:1 *1:2 10\n2 *1:2 *1:3 5\n*END\n'
    r = netlists.read_spef(texts(spark, text)).first()
    assert (r.design, r.net, r.total_cap, r.resistance, r.connections) == ("d", "a", 1.5, 15.0, ["U1:Y"]) and [(c.net, c.cap) for c in r.coupling] == [("b", 0.25)]
    with pytest.raises(Exception, match="f0"):
        netlists.read_spef(texts(spark, "*D_NET *1 x")).collect()


def test_liberty(spark):
    text = 'library(l) { /* c */ cell(INV) { area : 1.5; pin(A) { direction : input; capacitance : 0.4; } pin(Y) { direction : output; function : "!A"; timing() { related_pin : "A"; timing_sense : negative_unate; cell_rise(t) { index_1("1, 2"); values("1, 2", \\\n "3, 4"); } } } } }'
    rows = netlists.read_liberty(texts(spark, text)).orderBy("pin").collect()
    assert [(r.cell, r.area, r.pin, r.direction, r.cap, r.related_pin) for r in rows] == [("INV", 1.5, "A", "input", 0.4, None), ("INV", 1.5, "Y", "output", 0.0, "A")]


def test_lef_and_def(spark):
    lef = "MACRO INV\n SIZE 0.92 BY 1.4 ;\n PIN A\n DIRECTION INPUT ; USE SIGNAL ;\n PORT LAYER m1 ; RECT 0.1 0.5 0.3 0.9 ; END\n END A\nEND INV\n"
    r = netlists.read_lef(texts(spark, lef)).first()
    assert (r.macro, r.width, r.height, r.pin, r.direction, r.layer, r.x0, r.y1) == ("INV", 920, 1400, "A", "INPUT", "m1", 100, 900)
    text = "DESIGN top ;\nDIEAREA ( 0 0 ) ( 100 200 ) ;\nCOMPONENTS 2 ;\n- U1 INV + PLACED ( 10 20 ) N ;\n- U2 INV + FIXED ( -5 0 ) FS ;\nEND COMPONENTS\nSPECIALNETS 1 ;\n- VDD ( * VDD ) ;\nEND SPECIALNETS\nNETS 1 ;\n- n1 ( U1 Y ) ( U2 A ) + ROUTED m1 ( 0 0 ) ( 5 * ) ;\nEND NETS\nEND DESIGN\n"
    rows = netlists.read_def(texts(spark, text)).collect()
    assert [(r.kind, r.name, r.x, r.orient) for r in rows][2:4] == [("component", "U1", 10, "N"), ("component", "U2", -5, "FS")]
    assert [(r.name, r.pins) for r in rows if r.kind == "net"] == [("n1", ["U1:Y", "U2:A"])]


def test_sdf_and_layermap(spark):
    sdf = '(DELAYFILE (DESIGN "d") (CELL (CELLTYPE "INV") (INSTANCE u1) (DELAY (ABSOLUTE (IOPATH A Y (0.1:0.2:0.3) (0.4)) ))) (CELL (CELLTYPE "BUF") (INSTANCE u2) (DELAY (ABSOLUTE (IOPATH B Z (1:2:3))))))'
    rows = netlists.read_sdf(texts(spark, sdf)).collect()
    assert [(r.instance, r.from_pin, r.rise, r.fall) for r in rows] == [("u1", "A", [0.1, 0.2, 0.3], [0.4] * 3), ("u2", "B", [1.0, 2.0, 3.0], [1.0, 2.0, 3.0])]
    rows = netlists.read_layermap(texts(spark, "# map\nm1 drawing 10 0 // first\n\nm2 pin 20 5\nbad line\n")).collect()
    assert [(r.name, r.purpose, r.layer, r.datatype) for r in rows] == [("m1", "drawing", 10, 0), ("m2", "pin", 20, 5)]


def _library():
    return [
        layout.element("A", "box", [(-5, 0), (10, 7)], 1, 2),
        layout.element("A", "polygon", [(0, 0), (0, 9), (4, 9)], 1, 0),
        layout.element("A", "path", [(0, 0), (50, 0), (50, -20)], 3, 1, width=6),
        layout.element("A", "text", [(1, 2)], 7, 0, text="net1"),
        layout.element("B", "ref", [(100, -3)], child="A", rot=1, mirror=True, cols=1, rows=1, col_x=0, col_y=0, row_x=0, row_y=0),
        layout.element("B", "ref", [(0, 0)], child="A", rot=2, mirror=False, cols=3, rows=2, col_x=20, col_y=0, row_x=0, row_y=-30),
    ]


@pytest.mark.parametrize("threshold", [1, 10**6])
def test_oasis_elements(threshold):
    rows = _library()
    data = oasis.oasis_head() + b"".join(oasis.oasis_cell(c, [r for r in rows if r["cell"] == c], threshold) for c in "AB") + oasis.oasis_tail()
    drop = lambda rs: [{k: v for k, v in r.items() if v is not None} for r in rs]
    assert drop(oasis.parse_oasis(data)) == drop(rows)
    for cut in range(1, len(data) - 256, 3):
        with pytest.raises(layout.LayoutError):
            list(oasis.parse_oasis(data[:cut]))
    with pytest.raises(layout.LayoutError):
        oasis.oasis_cell("A", [layout.element("A", "path", [(0, 0), (1, 0)], 1, 0, width=3)])


def test_oasis_save(tmp_path, spark):
    (tmp_path / "x.gds").write_bytes(layout.gds_head() + b"".join(layout.gds_cell(c, [r for r in _library() if r["cell"] == c]) for c in "AB") + layout.gds_tail())
    e = layout.read(spark, str(tmp_path / "x.gds"), "gds")
    layout.save(e, str(tmp_path / "x.oas"), "oas")
    back = layout.read(spark, str(tmp_path / "x.oas"), "oas")
    assert back.drop("path").exceptAll(e.drop("path")).count() == 0 and back.count() == 6


def test_oasis_modal_values_repetitions_and_tables():
    u, s = oasis.unsigned, oasis.signed
    body = b"\x0d" + u(4)  # a cell by number, named after its use
    body += bytes([20, 0xDB]) + u(5) + u(1) + u(10) + s(100) + s(200)  # a square
    body += b"\x10" + bytes([20, 0x10]) + s(-30)  # relative from here; all but x as before
    body += bytes([20, 0x04]) + u(1) + u(1) + u(0) + u(20) + u(40)  # three columns, two rows
    body += bytes([20, 0x14]) + s(1000) + u(0)  # the same repetition again
    body += b"\x0f" + bytes([21, 0x3C]) + u(0) + u(3) + s(4) + s(5) + s(-2) + s(0) + s(0) + u(10) + u(0) + u(1 << 2 | 1) + s(7)
    body += bytes([23, 0x60 | 0x18]) + u(20) + u(10) + s(3) + s(-2) + s(0) + s(0)
    body += bytes([26, 0xD8]) + u(16) + u(8) + s(0) + s(0)
    body += bytes([27, 0x38]) + u(100) + s(0) + s(0)
    body += bytes([19, 0x7B]) + u(9) + u(2) + u(0) + s(1) + s(1)
    body += bytes([28, 0x14]) + oasis._string("p") + u(8) + u(77) + bytes([29])
    body += bytes([18, 0x80 | 0x30 | 0x07]) + oasis._string("X") + u(0) + u(1) + u(0) + u(270) + s(5) + s(6)
    data = oasis.oasis_head() + body + b"\x04" + oasis._string("top") + u(4) + b"\x06" + oasis._string("hello") + u(9) + oasis.oasis_tail()
    rows = list(oasis.parse_oasis(data))
    boxes = [r["points"] for r in rows if r["kind"] == "box"]
    assert {r["cell"] for r in rows} == {"top"} and {r["layer"] for r in rows if r["kind"] == "box"} == {5}
    assert boxes[:2] == [[(100, 200), (110, 210)], [(70, 200), (80, 210)]]
    assert [b[0] for b in boxes[2:8]] == [(70 + 20 * c, 200 + 40 * r) for r in range(2) for c in range(3)] and boxes[8][0] == (1070, 200) and len(boxes) == 14
    polygons = [r["points"] for r in rows if r["kind"] == "polygon"]
    assert polygons[0] == [(0, 0), (4, 0), (4, 5), (2, 5), (2, 0)] and polygons[1][0] == (1, 7)
    assert polygons[2] == [(3, 10), (18, 10), (20, 0), (0, 0)] and polygons[3] == [(0, 0), (0, 8), (8, 0)] and len(polygons[4]) == 64
    assert [(r["text"], r["layer"]) for r in rows if r["kind"] == "text"] == [("hello", 2)]
    assert [(r["child"], r["rot"], r["mirror"], r["points"]) for r in rows if r["kind"] == "ref"] == [("X", 3, True, [(5, 6)])]


def test_bookshelf(tmp_path, spark):
    files = {
        "d.aux": "RowBasedPlacement : d.nodes d.nets d.wts d.pl d.scl\n",
        "d.nodes": "UCLA nodes 1.0\n# c\nNumNodes : 3\nNumTerminals : 1\n a 4 10\n b\t6 10 # wide\n p 1 1 terminal\n",
        "d.pl": "UCLA pl 1.0\n\na 10 20 : N\np -5 0 : N /FIXED\nb 7 0 : N /FIXED\n",
        "d.nets": "UCLA nets 1.0\nNumNets : 3\nNumPins : 7\nNetDegree : 3 n1\n a I : 0 1\n b O\n a O\nNetDegree : 2\n p I\n b O : 2 2\nNetDegree : 2 lonely\n a I\n unknown O\n",
        "d.scl": "UCLA scl 1.0\nNumRows : 2\nCoreRow Horizontal\n Coordinate : 0\n Height : 10\n Sitewidth : 1\n Sitespacing : 1\n SubrowOrigin : -3 NumSites : 50\nEnd\nCoreRow Horizontal\n Coordinate : 10\n Height : 10\nEnd\n",
    }
    for name, text in files.items():
        (tmp_path / name).write_text(text)
    d = bookshelf.read_bookshelf(spark, str(tmp_path / "d.aux"))
    assert sorted(map(tuple, d["cells"].collect())) == [("a", 4, 10, 10, 20, False), ("b", 6, 10, 7, 0, True), ("p", 1, 1, -5, 0, True)]
    assert [tuple(r) for r in d["rows"].collect()] == [(-3, 0, 1, 50, 10)]
    assert sorted((r.net, r.cell) for r in d["pins"].collect()) == [("n1", "a"), ("n1", "b"), ("net_1", "b"), ("net_1", "p")]


def test_markup(spark):
    text = '<?xml version="1.0"?>\n<technology><name>t&amp;u</name><dbu>0.005</dbu><layer-properties><properties><name>m1 &lt;a&gt;</name><source>1/0@1</source><visible>false</visible><width>x</width></properties><properties/></layer-properties></technology>'
    source = texts(spark, text)
    layers, tech = markup.read_layer_properties(source), markup.read_technology(source)
    assert [(r.seq, r.name, r.source, r.visible, r.valid, r.width) for r in layers.orderBy("seq").collect()] == [(0, "m1 <a>", "1/0@1", False, True, 1), (1, "", "", True, True, 1)]
    again = markup.write_technology(tech, layers)
    assert markup.read_layer_properties(again).orderBy("seq").collect() == layers.orderBy("seq").collect() and markup.read_technology(again).collect() == tech.collect()
    assert tech.first().dbu == 0.005
    with pytest.raises(Exception, match="f0"):
        markup.read_technology(texts(spark, "<technology>")).collect()
    rules = spark.createDataFrame([(0, "w<1"), (1, "s")], "seq int, rule string")
    found = spark.createDataFrame([("w<1", [(0, 0), (0, 5), (3, 5)])], "rule string, points array<struct<x:bigint,y:bigint>>")
    root = ET.fromstring("\n".join(r.value for r in markup.write_report(rules, found, "a&b").collect()))
    assert [c.text for c in root.findall("categories/category/name")] == ["w<1", "s"] and root.findtext("top-cell") == "a&b"
    assert [(i.findtext("category"), i.findtext("values/value")) for i in root.findall("items/item")] == [("w<1", "polygon: (0,0;0,5;3,5)")]


def test_def_comes_in_pieces(spark):
    """A written DEF is no single row, its pieces make up the file that its reader takes whole too, and pieces that begin within a section are read as such."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        rows = [(f"U{i}", f"W{i % 3}", i * 5 - 20, i % 4, "N") for i in range(100)]
        pieces = netlists.write_def(spark.createDataFrame(rows, "name string, master string, x bigint, y bigint, orient string"), "top")
        text = "".join(r.value for r in pieces.orderBy("part").collect())
        assert pieces.count() > 10 and "COMPONENTS 100 ;" in text and text.count("\n- ") == 100
        assert [x.split()[1] for x in text.splitlines() if x.startswith("- ")] == sorted(r[0] for r in rows)
        for source in (pieces, texts(spark, text)):
            assert sorted((r.name, r.master, r.x, r.y, r.orient) for r in netlists.read_def(source).collect()) == sorted(rows)
        cut = ["DESIGN d ;\nCOMPONENTS 2 ;\n- a M + PLACED ( 1 2 ) N ;\n", "- b M + PLACED ( 3 4 ) S ;\nEND COMPONENTS\nSPECIALNETS 1 ;\n- vdd ( * v ) ;\n", "- vss ( * v ) ;\nEND SPECIALNETS\nNETS 2 ;\n- n1 ( a x ) ;\n", "- n2 ( b y ) ;\n", "END NETS\nEND DESIGN\n"]
        got = netlists.read_def(spark.createDataFrame([("f", i, v) for i, v in enumerate(cut)], "path string, part bigint, value string")).collect()
        assert sorted((r.design, r.kind, r.name) for r in got) == [("d", "component", "a"), ("d", "component", "b"), ("d", "net", "n1"), ("d", "net", "n2")]
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
