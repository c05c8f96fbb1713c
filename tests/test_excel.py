import datetime as dt
import zipfile
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from perilmap.sources import excel
from test_sources import xlsx

SCHEMA = "n int, big long, `Risk Factors` string, t double, ok boolean, d date, at timestamp, cost decimal(12,3)"


def rows(n):
    out = []
    for k in range(n):
        row = (k, 2**60 + k, f" a & b <{k}> {{x}}\n é\r; ", k / 8, k % 3 == 0, dt.date(1899, 12, 31) + dt.timedelta(days=k * 997), dt.datetime(2020, 2, 29, 23, 59, 59, 123000) + dt.timedelta(hours=k * 31), Decimal(k * 12345678) / 1000)
        out.append(tuple(None if (k + j) % 9 == 0 else v for j, v in enumerate(row)))
    return out


@pytest.fixture(scope="module")
def book(spark):
    excel.register(spark)
    return spark


def test_typed_round_trip_over_tasks(book, tmp_path):
    want = rows(57)
    df = book.createDataFrame(want, SCHEMA).repartition(3)
    df.write.format("workbook").mode("overwrite").option("maxrows", 10).save(str(tmp_path / "x"))
    files = list((tmp_path / "x").iterdir())
    assert len(files) >= 6 and all(f.suffix == ".xlsx" for f in files)
    back = book.read.format("workbook").schema(SCHEMA).load(str(tmp_path / "x"))
    assert back.schema == df.schema and back.rdd.getNumPartitions() == len(files)
    assert sorted(map(str, back.collect())) == sorted(map(str, df.collect()))
    inferred = book.read.format("workbook").load(str(tmp_path / "x"))
    assert {f.name: f.dataType.simpleString() for f in inferred.schema.fields} == {"n": "bigint", "big": "string", "Risk Factors": "string", "t": "double", "ok": "boolean", "d": "date", "at": "timestamp", "cost": "double"}
    few = book.read.format("workbook").schema("t double, n string, missing int").load(str(tmp_path / "x"))
    assert few.agg(F.sum("t"), F.count("missing"), F.count("n")).first() == (sum(r[3] for r in want if r[3] is not None), 0, sum(r[0] is not None for r in want))
    df.limit(5).coalesce(1).write.format("workbook").mode("overwrite").save(str(tmp_path / "x"))
    assert book.read.format("workbook").schema(SCHEMA).load(str(tmp_path / "x")).count() == 5
    df.limit(5).coalesce(1).write.format("workbook").mode("append").save(str(tmp_path / "x"))
    assert book.read.format("workbook").schema(SCHEMA).load(str(tmp_path / "x")).count() == 10


def test_all_sheets_are_rewritten_with_a_column(book, tmp_path):
    one = book.createDataFrame([("Sheet1", "a; b", 1), ("Sheet1", "c", 2), ("no & te", None, 3)], "sheet string, `Secondary_Factors` string, v int")
    one.coalesce(1).sortWithinPartitions("sheet").write.format("workbook").mode("overwrite").option("sheetcolumn", "sheet").option("onefile", True).save(str(tmp_path / "in"))
    read = book.read.format("workbook").option("sheetcolumn", "sheet").load(str(tmp_path / "in"))
    assert read.rdd.getNumPartitions() == 2 and read.columns == ["sheet", "Secondary_Factors", "v"]
    coded = read.withColumn("Factor_Codes", F.when(F.col("sheet") == "Sheet1", F.concat(F.lit("H"), F.col("v").cast("string"))))
    coded.coalesce(1).sortWithinPartitions("sheet").write.format("workbook").mode("overwrite").option("sheetcolumn", "sheet").option("onefile", True).save(str(tmp_path / "out"))
    assert len(list((tmp_path / "out").iterdir())) == 1
    back = book.read.format("workbook").schema("sheet string, Factor_Codes string, v int").option("sheetcolumn", "sheet").load(str(tmp_path / "out"))
    assert sorted(map(tuple, back.collect())) == [("Sheet1", "H1", 1), ("Sheet1", "H2", 2), ("no & te", None, 3)]
    first = back.filter("sheet = 'Sheet1'")
    assert first.rdd.getNumPartitions() == 1 and first.count() == 2 and back.filter("sheet IN ('no & te', 'x') AND v > 1").count() == 1
    named = book.read.format("workbook").option("sheet", "no & te|other").load(str(tmp_path / "out"))
    assert [r["v"] for r in named.collect()] == [3]


def test_a_failed_job_leaves_no_file(book, tmp_path):
    path = str(tmp_path / "f")
    book.range(3).coalesce(1).write.format("workbook").mode("overwrite").save(path)
    bad = book.range(0, 4000, 1, 4).select("id", F.when(F.col("id") == 3999, F.raise_error(F.lit("broken"))).otherwise("x").alias("t"))
    for mode in ("append", "overwrite"):
        with pytest.raises(Exception, match="broken"):
            bad.write.format("workbook").mode(mode).save(path)
        assert len(list((tmp_path / "f").iterdir())) == 1 and book.read.format("workbook").load(path).count() == 3
    apart = book.createDataFrame([("a", 1), ("b", 2), ("a", 3)], "s string, v int").coalesce(1)
    with pytest.raises(Exception, match="do not follow one another"):
        apart.write.format("workbook").mode("overwrite").option("sheetcolumn", "s").save(str(tmp_path / "g"))
    with pytest.raises(Exception, match="onefile"):
        book.range(0, 10, 1, 2).write.format("workbook").mode("overwrite").option("onefile", True).save(str(tmp_path / "h"))
    assert not list((tmp_path / "g").glob("*")) and not list((tmp_path / "h").glob("*"))


def test_a_repeated_attempt_counts_once(tmp_path):
    """Two attempts of one task write; only the one whose message arrives is kept."""
    import pyarrow as pa
    from pyspark.sql.types import StructType

    writer = excel.WorkbookWriter({"path": str(tmp_path / "r")}, StructType.fromDDL("v int"), False)
    batch = pa.record_batch([pa.array([1, 2], pa.int32())], ["v"])
    writer.write(iter([batch]))
    writer.commit([writer.write(iter([batch])), None])
    assert len(list((tmp_path / "r").iterdir())) == 1


def test_files_of_other_programs(book, tmp_path):
    xlsx(tmp_path / "w.xlsx")
    df = book.read.format("workbook").load(str(tmp_path / "w.xlsx"))
    assert df.columns == ["Factors", "N"] and [tuple(r) for r in df.collect()] == [("a; b", 7)]
    with zipfile.ZipFile(tmp_path / "w.xlsx", "a") as z:
        z.writestr("xl/styles.xml", '<styleSheet xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"><numFmts><numFmt numFmtId="164" formatCode="yyyy\\-mm"/><numFmt numFmtId="165" formatCode="0.00&quot;day&quot;"/></numFmts><cellXfs><xf numFmtId="164"/><xf numFmtId="165"/></cellXfs></styleSheet>')
    assert book.read.format("workbook").load(str(tmp_path / "w.xlsx")).schema["N"].dataType.simpleString() == "date"
    assert book.read.format("workbook").schema("N timestamp").load(str(tmp_path / "w.xlsx")).first()["N"] == dt.datetime(1900, 1, 6)


def test_empty_frames(book, tmp_path):
    book.range(0).write.format("workbook").mode("overwrite").save(str(tmp_path / "e"))
    assert book.read.format("workbook").schema("id long").load(str(tmp_path / "e")).count() == 0
