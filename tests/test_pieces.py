"""Layout files in pieces: no row holds a cell, and what is read back is what was written."""

import pytest
from pyspark.sql import functions as F

from maskloom.sources import layout, netlists


def elements(spark, fmt, n=90):
    rows = []
    for i in range(n):
        box = layout.element(f"C{i % 3}", "box", [(1000 * i, 0), (1000 * i + 20000, 7000)], i % 4, 0, text=f"m{i % 4}")
        ref = layout.element(f"C{i % 3}", "ref", [(1000 * i, 10)], child="C7", rot=i % 4, mirror=False, cols=1, rows=1, col_x=0, col_y=0, row_x=0, row_y=0)
        ring = layout.element(f"C{i % 3}", "polygon", [(0, 0), (0, 9000), (4000 + 10 * i, 9000)], i % 2, 0)
        rows.append({**(box if fmt == "mag" or i % 2 else ring if i % 4 else ref), "path": "f", "seq": i // 3})
    point = lambda p: [{"x": x, "y": y} for x, y in p]
    names = [f.split(" ")[0] for f in layout.ELEMENT.split(", ")]
    return spark.createDataFrame([tuple(point(r["points"]) if f == "points" else r.get(f) for f in names) for r in rows], layout.ELEMENT)


@pytest.mark.parametrize("fmt", ["gds", "oas", "cif", "mag"])
def test_files_in_pieces(spark, monkeypatch, fmt):
    e = elements(spark, fmt)
    monkeypatch.setattr(layout.encode_pieces, "__defaults__", ("gds", 4))
    files = layout.cell_files(e, fmt)
    assert files.count() >= 3 * (2 + 30 // 4) and files.filter("path = 'C1'").agg(F.max(F.length("content"))).first()[0] < 700
    back = layout.parse(files, fmt)
    columns = ["cell", "seq", "points"] if fmt == "mag" else ["cell", "seq", "kind", "layer", "points", "child", "rot"]
    value = F.col("layer") if fmt != "mag" else F.col("text")
    if fmt == "mag":  # by layer, then in order
        e = e.withColumn("seq", F.expr("row_number() over (partition by cell order by text, seq) - 1"))
    if fmt != "mag":
        e = e.withColumns({"layer": F.when(F.col("kind") != "ref", value), "rot": F.when(F.col("kind") == "ref", F.col("rot"))})
        back = back.withColumns({"layer": F.when(F.col("kind") != "ref", F.col("layer")), "rot": F.when(F.col("kind") == "ref", F.col("rot"))})
    key = lambda df: sorted(map(str, df.select(*columns).collect()))
    assert key(back) == key(e)
    # the pieces in the order of part are one file, which the reader of whole files takes
    one = files.groupBy("path").agg(F.sort_array(F.collect_list(F.struct("part", "content"))).alias("p")).collect()
    whole = spark.createDataFrame([(r.path, bytearray(b"".join(bytes(p.content) for p in r.p))) for r in one], "path string, content binary")
    assert key(layout.parse(whole, fmt).withColumns({c: back[c] for c in ()})) == key(layout.parse(files, fmt)) if fmt == "mag" else layout.parse(whole, fmt).count() == 90


def test_pieces_must_end_between_elements(spark):
    data = layout.gds_elements([layout.element("A", "box", [(0, 0), (5, 5)], 1, 0)])
    for cut in (10, len(data) - 4):
        files = spark.createDataFrame([("f", 0, bytearray(layout.gds_open("A") + data[:cut])), ("f", 1, bytearray(data[cut:]))], "path string, part bigint, content binary")
        with pytest.raises(Exception, match="f: "):
            layout.parse(files, "gds").collect()


def test_spef_in_pieces(spark):
    """Small pieces give what the file as a whole gives, names of couplings too."""
    rows = [(f"n{i:03}", float(i), i % 7 + 0.5, [f"P{j}:A" for j in range(i % 4)], i % 2) for i in range(60)]
    nets = spark.createDataFrame(rows, "net string, total_cap double, resistance double, connections array<string>, g int")
    pieces = netlists.write_spef(nets, "top", "g", 4)
    assert pieces.agg(F.max(F.length("value"))).first()[0] < 500 and pieces.count() == 2 * (1 + 2 * 8)
    texts = {}
    for r in sorted(pieces.collect(), key=lambda r: (r.path, r.part)):
        texts[r.path] = texts.get(r.path, "") + r.value
    assert texts["0"].splitlines()[9] == "*1 n000" and texts["0"].count("*D_NET") == 30
    # a coupling in the last piece of one file names a net of the first, and one that has no name
    more = '\n*D_NET *3 4.0\n*CONN\n*CAP\n1 *3:GROUND *1:4 0.25\n2 *3:GROUND *99 0.5\n3 *3:GROUND other:1 0.75\n*END\n'
    texts["0"] += more
    pieces = pieces.unionByName(spark.createDataFrame([("0", 1 << 62, more)], "path string, part bigint, value string"))
    key = lambda df: sorted(map(str, df.collect()))
    got = netlists.read_spef(pieces)
    assert key(got) == key(netlists.read_spef(spark.createDataFrame(list(texts.items()), "path string, value string")))
    assert [(c.net, c.cap) for r in got.filter("size(coupling) > 0").collect() for c in r.coupling] == [("n000", 0.25), ("net_99", 0.5), ("other", 0.75)]
