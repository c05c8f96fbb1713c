import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from perilmap.functions.text import split_hashes
from perilmap.sources import readers, writers


def docx(path, paragraphs):
    ns = "http://schemas.openxmlformats.org/wordprocessingml/2006/main"
    body = "".join(f"<w:p><w:r><w:t>{p}</w:t></w:r></w:p>" for p in paragraphs)
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="{ns}"><w:body>{body}</w:body></w:document>')


def xlsx(path):
    s = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
    r = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    with zipfile.ZipFile(path, "w") as z:
        z.writestr("xl/workbook.xml", f'<workbook xmlns="{s}" xmlns:r="{r}"><sheets><sheet name="Sheet1" sheetId="1" r:id="r1"/><sheet name="two" sheetId="2" r:id="r2"/></sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Target="worksheets/sheet1.xml"/><Relationship Id="r2" Target="worksheets/sheet2.xml"/></Relationships>')
        z.writestr("xl/sharedStrings.xml", f'<sst xmlns="{s}"><si><t>Factors</t></si><si><t>a; b</t></si></sst>')
        z.writestr("xl/worksheets/sheet1.xml", f'<worksheet xmlns="{s}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c><c r="C1" t="inlineStr"><is><t>N</t></is></c></row><row r="2"><c r="A2" t="s"><v>1</v></c><c r="C2"><v>7</v></c></row></sheetData></worksheet>')
        z.writestr("xl/worksheets/sheet2.xml", f'<worksheet xmlns="{s}"><sheetData><row r="1"><c r="A1" t="s"><v>0</v></c></row></sheetData></worksheet>')


def test_docx(spark, tmp_path):
    docx(tmp_path / "a.docx", ["Case 1", "  ", " text "])
    (tmp_path / "b.docx").write_bytes(b"broken")
    got = sorted(r["text"] for r in readers.read_docx(spark, str(tmp_path)).collect())
    assert got == ["", "Case 1\ntext"]
    with pytest.raises(Exception, match="BadZipFile"):
        readers.read_docx(spark, str(tmp_path), failfast=True).collect()


def test_text_directory_and_cases(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.txt").write_text("x\n##########\ny", encoding="utf-8")
    assert readers.read_text_directory(spark, str(tmp_path / "in")).first()["text"].startswith("x\n#")


def test_cases_in_order(spark, tmp_path):
    """One file is the reference's joined text; several hold the same segments, file after file."""
    rows = [(d, k, f"Case{d}.{k} é\nmore") for d in range(40) for k in range(d % 5 + 1)]
    shuffled = spark.createDataFrame(rows, "doc_id long, seg_no int, segment string").repartition(7)
    writers.write_cases(shuffled, str(tmp_path / "one"))
    [file] = (tmp_path / "one").glob("part-*")
    assert file.read_text() == ("\n" + "#" * 10 + "\n\n").join(s for _, _, s in rows) + "\n"
    writers.write_cases(shuffled, str(tmp_path / "many"), files=3)
    files = sorted((tmp_path / "many").glob("part-*"))
    assert 1 < len(files) <= 3
    again = [s for f in files for s in f.read_text()[:-1].split("\n##########\n\n")]
    assert again == [s for _, _, s in rows]
    assert sorted(r["segment"] for r in readers.read_cases(spark, str(tmp_path / "many")).collect()) == sorted(again)
    hashes = readers.read_text_directory(spark, str(tmp_path / "one")).select(F.lit(1).alias("doc_id"), "text")
    assert [r["segment"] for r in split_hashes(hashes).orderBy("seg_no").collect()] == again
    writers.write_cases(shuffled.limit(0), str(tmp_path / "none"))
    assert readers.read_cases(spark, str(tmp_path / "none")).count() == 0


@pytest.mark.parametrize("size", [7, 64, 1000, 1 << 20])
def test_csv_of_another_charset_by_ranges(spark, tmp_path, size):
    """Quotes, doubled quotes and line breaks inside quotes, wherever a range begins or ends."""
    import random

    rng = random.Random(size)
    rows = [(k, "".join(rng.choice('焊接a, "\n é') for _ in range(rng.randrange(12))), rng.choice(["", "x", "裂纹"])) for k in range(300)]
    quote = lambda t: '"' + t.replace('"', '""') + '"'
    head = '"序号",n,"多\n行"\n'
    for name, text in (("a", head + "".join(f"{quote(t)},{k},{c}\n" for k, t, c in rows)), ("b", head.rstrip("\n")), ("c", head + '"open to the end",7,"x\ny"')):
        (tmp_path / f"{name}.csv").write_bytes(text.encode("gb18030"))
    read = readers.read_csv(spark, str(tmp_path), "GB18030", "n int, 序号 string, `多\n行` string", range_bytes=size)
    assert sorted(map(tuple, read.collect())) == sorted([(k, t, c) for k, t, c in rows] + [(7, "open to the end", "x\ny")])


def test_a_large_file_is_read_by_several_tasks(spark, tmp_path):
    line = '"焊接, 接头\n裂纹",{},"' + "长" * 200 + '"\n'
    with open(tmp_path / "g.csv", "wb") as f:
        f.write(b"a,k,b\n")
        for k in range(40):
            f.write("".join(line.format(k * 1000 + j) for j in range(1000)).encode("gbk"))
    read = readers.read_csv(spark, str(tmp_path / "g.csv"), "GBK", "k long, a string", range_bytes=2 << 20)
    parts = read.groupBy(F.spark_partition_id().alias("p")).agg(F.count("k").alias("n"), F.sum("k").alias("s"), F.min("a").alias("a")).collect()
    assert sum(r["n"] for r in parts) == 40_000 and sum(r["s"] for r in parts) == sum(range(40_000)) and {r["a"] for r in parts} == {"焊接, 接头\n裂纹"}
    assert sum(r["n"] > 0 for r in parts) >= 3


def test_csv(spark, tmp_path):
    df = spark.createDataFrame([("a,b", 'say "x"'), ("line\nbreak", "é")], "phenomenon string, cause string")
    writers.write_csv(df, str(tmp_path / "c"), {"cause": "Root Cause Analysis"}, byte_order_mark=True)
    back = readers.read_csv(spark, str(tmp_path / "c"))
    assert back.columns == ["phenomenon", "Root Cause Analysis"]
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, df.collect()))
    (tmp_path / "g.csv").write_bytes("名,n\n焊接,3\n".encode("gbk"))
    row = readers.read_csv(spark, str(tmp_path / "g.csv"), "GBK", "名 string, n int").first()
    assert tuple(row) == ("焊接", 3)
    (tmp_path / "h.csv").write_bytes('Occurrence Time,Root Cause Analysis,cost\n,"焊, 接",1.50\n2020,y,x\n'.encode("gbk"))
    rows = readers.read_csv(spark, str(tmp_path / "h.csv"), "GBK", "`Root Cause Analysis` string, cost decimal(10,2)", rows_at_once=1).collect()
    assert [(r["Root Cause Analysis"], r["cost"]) for r in rows] == [("焊, 接", Decimal("1.50")), ("y", None)]


def test_workbook(spark, tmp_path):
    xlsx(tmp_path / "w.xlsx")
    rows = readers.read_workbook(spark, str(tmp_path / "w.xlsx")).collect()
    assert [(r["sheet"], r["row_pos"], r["cells"]) for r in rows] == [("Sheet1", 1, {"Factors": "a; b", "N": "7"})]


def test_excel_files(spark, tmp_path):
    df = spark.createDataFrame([(k, f"a & b <{k}> {{x}}", None if k % 2 else k / 2) for k in range(7)], "n int, `Risk Factors` string, t double").repartition(2)
    assert writers.write_workbooks(df, (tmp_path / "x").as_uri(), "Path risks", most_rows=3) == len(list((tmp_path / "x").glob("*.xlsx")))
    rows = readers.read_workbook(spark, str(tmp_path / "x"), "Path risks").collect()
    assert sorted((int(r["cells"]["n"]), r["cells"]["Risk Factors"], r["cells"].get("t")) for r in rows) == [(k, f"a & b <{k}> {{x}}", None if k % 2 else str(k // 2)) for k in range(7)]


def test_sheets(spark, tmp_path):
    df = spark.createDataFrame([("Sheet1", 1), ("two", 2)], "sheet string, v int")
    writers.write_sheets(df, str(tmp_path / "s"))
    assert readers.read_sheets(spark, str(tmp_path / "s"), "two").first()["v"] == 2
    writers.add_sheet_column(readers.read_sheets(spark, str(tmp_path / "s")), str(tmp_path / "t"), "code", F.lit("x"))
    assert {(r["sheet"], r["code"]) for r in readers.read_sheets(spark, str(tmp_path / "t")).collect()} == {("Sheet1", "x"), ("two", None)}
    with pytest.raises(ValueError, match="no sheet"):
        writers.add_sheet_column(df.filter("sheet = 'two'"), str(tmp_path / "u"), "code", F.lit("x"))


def test_graph_files(spark, tmp_path):
    edges = spark.createDataFrame([(1, "a", "H", "LEADS_TO", "b", "H"), (1, "a", "H", "CAUSED_BY", "b", "H")], "case_id long, head string, head_type string, relation string, tail string, tail_type string")
    writers.write_graph(edges.selectExpr("head AS name", "head_type AS type").distinct(), edges, str(tmp_path / "g"))
    assert readers.read_graph_edges(spark, str(tmp_path / "g")).count() == 1
    assert readers.exists(spark, str(tmp_path / "g")) and not readers.exists(spark, str(tmp_path / "none"))
    writers.write_json(edges, str(tmp_path / "j"))
    assert spark.read.json(str(tmp_path / "j")).count() == 2
