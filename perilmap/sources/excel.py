"""Excel workbooks as a data source: ``spark.read.format("workbook")`` and ``df.write.format("workbook")``.

Reading: one partition for each sheet of each file, parsed as a stream of rows, so memory does
not grow with a sheet. The first row names the columns. With a schema only its columns are
made; without one the types are inferred from the first ``inferrows`` rows of the first sheet.
Cells that do not fit their type are null. A filter on the sheet's name (option ``sheetcolumn``
names the column that gets it) leaves out the other sheets' partitions.

Writing: each task writes workbooks of at most ``maxrows`` rows a sheet, aside; when all tasks
have succeeded the driver moves the files of committed attempts into place (names only, no
contents), so a failed or repeated task leaves none. With ``sheetcolumn`` the rows of a sheet must follow one
another (``repartition`` and ``sortWithinPartitions`` by it). ``onefile`` demands that all rows
come from one task, as one file of all sheets has one writer.

Options: ``sheet`` (names parted by ``|``; all without it), ``sheetcolumn``, ``inferrows``,
``maxrows``, ``timezone`` (of timestamps; UTC), ``onefile``. Numbers that a double can't hold
are stored as text, timestamps to the millisecond; control characters that XML can't hold are dropped.
"""

from __future__ import annotations

import datetime as dt
import re
import uuid
import zipfile
from collections.abc import Iterator
from decimal import Decimal, InvalidOperation
from xml.etree import ElementTree
from xml.sax.saxutils import escape, quoteattr
from zoneinfo import ZoneInfo

import pyarrow as pa
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, EqualTo, Filter, In, InputPartition
from pyspark.sql.pandas.types import to_arrow_schema
from pyspark.sql.types import BooleanType, DataType, DateType, DecimalType, DoubleType, FloatType, IntegralType, LongType, StringType, StructField, StructType, TimestampNTZType, TimestampType

from .staged import Staging, Written, files_of, filesystem

_S = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_R = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"
_OPC = "http://schemas.openxmlformats.org/package/2006/"
_KIND = "application/vnd.openxmlformats-officedocument.spreadsheetml."
EPOCH, EPOCH_1904 = dt.datetime(1899, 12, 30), dt.datetime(1904, 1, 1)
MOST_ROWS = 1_048_575
BATCH = 5000
# The numbers of the built-in formats that show a date or a time.
DATE_FORMATS = frozenset((*range(14, 23), *range(27, 37), *range(45, 48), *range(50, 59)))


class Book:
    """A workbook that is open for reading."""

    def __init__(self, path: str, uri: str):
        store, _ = filesystem(uri)
        self.zip = zipfile.ZipFile(store.open_input_file(path))
        names = set(self.zip.namelist())
        links = {r.get("Id"): r.get("Target") for r in ElementTree.fromstring(self.zip.read("xl/_rels/workbook.xml.rels"))}
        root = ElementTree.fromstring(self.zip.read("xl/workbook.xml"))
        place = lambda t: t.lstrip("/") if t.lstrip("/").startswith("xl/") else f"xl/{t.lstrip('/')}"
        self.sheets = {s.get("name"): place(links[s.get(f"{_R}id")]) for s in root.iter(f"{_S}sheet")}
        old = next(root.iter(f"{_S}workbookPr"), None)
        self.epoch = EPOCH_1904 if old is not None and old.get("date1904") in ("1", "true") else EPOCH
        self._names = names

    def __enter__(self) -> Book:
        return self

    def __exit__(self, *_) -> None:
        self.zip.close()

    def _shared(self) -> list[str]:
        if "xl/sharedStrings.xml" not in self._names:
            return []
        out = []
        with self.zip.open("xl/sharedStrings.xml") as f:
            for _, node in ElementTree.iterparse(f):
                if node.tag == f"{_S}si":
                    out.append("".join(t.text or "" for t in node.iter(f"{_S}t")))
                    node.clear()
        return out

    def _dates(self) -> list[bool]:
        """Whether each style shows a date."""
        if "xl/styles.xml" not in self._names:
            return []
        root = ElementTree.fromstring(self.zip.read("xl/styles.xml"))
        own = {int(f.get("numFmtId")): bool(re.search("[dmyhs]", re.sub(r'"[^"]*"|\[[^\]]*\]|\\.', "", f.get("formatCode", "").lower()))) for f in root.iter(f"{_S}numFmt")}
        xfs = root.find(f"{_S}cellXfs")
        return [own.get(k, k in DATE_FORMATS) for k in (int(x.get("numFmtId", 0)) for x in (xfs if xfs is not None else ()))]

    def rows(self, sheet: str) -> Iterator[dict[int, object]]:
        """Cells by column of each row: text, float, bool or datetime."""
        shared, dates = self._shared(), self._dates()
        with self.zip.open(self.sheets[sheet]) as f:
            for _, row in ElementTree.iterparse(f):
                if row.tag != f"{_S}row":
                    continue
                cells, at = {}, -1
                for c in row.findall(f"{_S}c"):
                    letters = (c.get("r") or "").rstrip("0123456789")
                    at = _column(letters) if letters else at + 1
                    value = self._value(c, shared, dates)
                    if value is not None:
                        cells[at] = value
                yield cells
                row.clear()

    def _value(self, c: ElementTree.Element, shared: list[str], dates: list[bool]) -> object:
        kind, v = c.get("t", "n"), c.find(f"{_S}v")
        if kind == "inlineStr":
            return "".join(t.text or "" for t in c.iter(f"{_S}t"))
        if v is None or v.text is None:
            return "" if kind == "str" and v is not None else None
        if kind == "s":
            return shared[int(v.text)]
        if kind == "b":
            return v.text == "1"
        if kind != "n":
            return None if kind == "e" else v.text
        style = int(c.get("s", 0))
        number = float(v.text)
        return self.moment(number) if style < len(dates) and dates[style] else number

    def moment(self, days: float) -> dt.datetime:
        return self.epoch + dt.timedelta(milliseconds=round(days * 86_400_000))


def _column(letters: str) -> int:
    at = 0
    for ch in letters:
        at = at * 26 + ord(ch) - 64
    return at - 1


def _letters(k: int) -> str:
    out = ""
    k += 1
    while k:
        k, rest = divmod(k - 1, 26)
        out = chr(65 + rest) + out
    return out


def shown(value: object) -> str:
    """A cell as text: whole numbers without a point, moments in ISO form."""
    if isinstance(value, bool):
        return "true" if value else "false"
    if isinstance(value, float):
        return str(int(value)) if value.is_integer() and abs(value) < 1e15 else repr(value)
    if isinstance(value, dt.datetime):
        return value.date().isoformat() if value.time() == dt.time() else value.isoformat(" ")
    return str(value)


def fitted(value: object, kind: DataType, book: Book) -> object:
    """A cell as a value of the type; null where it doesn't fit."""
    if value is None or isinstance(kind, StringType):
        return None if value is None else shown(value)
    try:
        if isinstance(kind, BooleanType):
            return value if isinstance(value, bool) else {"true": True, "false": False}.get(str(value).strip().lower())
        if isinstance(kind, (DateType, TimestampType, TimestampNTZType)):
            if isinstance(value, float):
                value = book.moment(value)
            elif isinstance(value, str):
                value = dt.datetime.fromisoformat(value.strip())
            if not isinstance(value, dt.datetime):
                return None
            return value.date() if isinstance(kind, DateType) else value
        if isinstance(value, (bool, dt.datetime)):
            return None
        if isinstance(kind, IntegralType):
            number = Decimal(shown(value).strip())
            size = {"byte": 7, "short": 15, "integer": 31, "long": 63}[kind.typeName()]
            return int(number) if number == number.to_integral_value() and -(1 << size) <= number < 1 << size else None
        if isinstance(kind, DecimalType):
            number = Decimal(shown(value).strip()).quantize(Decimal(1).scaleb(-kind.scale))
            return number if len(number.as_tuple().digits) <= kind.precision else None
        if isinstance(kind, (DoubleType, FloatType)):
            return float(value)
    except (ValueError, InvalidOperation, OverflowError):
        return None
    raise TypeError(f"a workbook has no cells of type {kind.simpleString()}")


def guessed(values: list[object]) -> DataType:
    """The narrowest type that all of a column's cells have."""
    kinds = {type(v) for v in values}
    if kinds == {float}:
        return LongType() if all(v.is_integer() and abs(v) < 2**53 for v in values) else DoubleType()
    if kinds == {bool}:
        return BooleanType()
    if kinds == {dt.datetime}:
        return DateType() if all(v.time() == dt.time() for v in values) else TimestampType()
    return StringType()


class SheetPartition(InputPartition):
    def __init__(self, path: str, sheet: str):
        self.path, self.sheet = path, sheet


class Workbook(DataSource):
    @classmethod
    def name(cls) -> str:
        return "workbook"

    def _sheets(self) -> list[str] | None:
        return self.options["sheet"].split("|") if "sheet" in self.options else None

    def schema(self) -> StructType:
        uri = self.options["path"]
        for path in files_of(uri, ".xlsx"):
            with Book(path, uri) as book:
                for sheet in self._sheets() or book.sheets:
                    if sheet not in book.sheets:
                        continue
                    rows = book.rows(sheet)
                    header = next(rows, {})
                    if not header:
                        continue
                    some = [r for r, _ in zip(rows, range(int(self.options.get("inferrows", 1000))), strict=False)]
                    fields = [StructField(shown(name), guessed([r[k] for r in some if k in r])) for k, name in sorted(header.items())]
                    extra = self.options.get("sheetcolumn")
                    return StructType(([StructField(extra, StringType())] if extra else []) + fields)
        raise ValueError(f"no sheet with a header at {uri}")

    def reader(self, schema: StructType) -> DataSourceReader:
        return WorkbookReader(self.options["path"], schema, self._sheets(), self.options.get("sheetcolumn"), self.options.get("timezone", "UTC"))

    def writer(self, schema: StructType, overwrite: bool) -> DataSourceArrowWriter:
        return WorkbookWriter(self.options, schema, overwrite)


class WorkbookReader(DataSourceReader):
    def __init__(self, uri: str, schema: StructType, sheets: list[str] | None, sheet_column: str | None, zone: str):
        self.uri, self.fields, self.sheets, self.sheet_column, self.zone = uri, schema, sheets, sheet_column, zone

    def pushFilters(self, filters: list[Filter]) -> Iterator[Filter]:
        for f in filters:
            own = isinstance(f, (EqualTo, In)) and self.sheet_column is not None and f.attribute == (self.sheet_column,)
            if own:
                wanted = [f.value] if isinstance(f, EqualTo) else list(f.value)
                self.sheets = wanted if self.sheets is None else [s for s in self.sheets if s in wanted]
            else:
                yield f

    def partitions(self) -> list[SheetPartition]:
        out = []
        for path in files_of(self.uri, ".xlsx"):
            with Book(path, self.uri) as book:
                out += [SheetPartition(path, s) for s in book.sheets if self.sheets is None or s in self.sheets]
        return out

    def read(self, partition: SheetPartition | None) -> Iterator[pa.RecordBatch]:
        if partition is None:  # no sheet at all
            return
        zone = ZoneInfo(self.zone)
        target = to_arrow_schema(self.fields)

        def packed(rows: list[tuple]) -> pa.RecordBatch:
            columns = [list(c) for c in zip(*rows, strict=True)] if self.fields.fields else []
            for k, f in enumerate(self.fields.fields):
                if isinstance(f.dataType, TimestampType):
                    columns[k] = [v and v.replace(tzinfo=zone) for v in columns[k]]
            return pa.record_batch([pa.array(c, t.type) for c, t in zip(columns, target, strict=True)], schema=target)

        with Book(partition.path, self.uri) as book:
            rows = book.rows(partition.sheet)
            header = {shown(v): k for k, v in reversed(next(rows, {}).items())}
            held = []
            for cells in rows:
                held.append(tuple(partition.sheet if f.name == self.sheet_column else fitted(cells.get(header.get(f.name, -1)), f.dataType, book) for f in self.fields.fields))
                if len(held) == BATCH:
                    yield packed(held)
                    held = []
            if held:
                yield packed(held)


class WorkbookWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], schema: StructType, overwrite: bool):
        self.fields = schema.fields
        self.sheet_column = options.get("sheetcolumn")
        self.sheet = options.get("sheet", "Sheet1")
        self.most = min(MOST_ROWS, int(options.get("maxrows", MOST_ROWS)))
        self.zone, self.one_file = options.get("timezone", "UTC"), options.get("onefile", "false").lower() == "true"
        self.staging = Staging(options["path"], ".xlsx", overwrite)

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        attempt, names, file = uuid.uuid4().hex, [], None
        for batch in iterator:
            columns = {f.name: self._plain(batch.column(k), f.dataType) for k, f in enumerate(self.fields)}
            sheets = columns.pop(self.sheet_column) if self.sheet_column else None
            for k in range(batch.num_rows):
                sheet = str(sheets[k]) if sheets else self.sheet
                if file is not None and sheet != file.now and sheet in file.done:
                    raise ValueError(f"the rows of sheet {sheet} do not follow one another")
                if file is not None and sheet == file.now and file.rows == self.most:
                    file.close()
                    file = None
                if file is None:
                    name, sink = self.staging.new_file(attempt, len(names))
                    names.append(name)
                    file = BookFile(sink, list(columns))
                file.add(sheet, [c[k] for c in columns.values()])
        if file is not None:
            file.close()
        return Written(tuple(names))

    def _plain(self, column: pa.Array, kind: DataType) -> list:
        values = column.to_pylist()
        if isinstance(kind, TimestampType):
            zone = ZoneInfo(self.zone)
            return [v and v.astimezone(zone).replace(tzinfo=None) for v in values]
        return values

    def commit(self, messages: list[Written | None]) -> None:
        if self.one_file and sum(len(m.names) for m in messages if m) > 1:
            self.staging.abort()
            raise ValueError("onefile: the rows come from several tasks or exceed a sheet; coalesce them first")
        self.staging.commit(messages)

    def abort(self, messages: list[Written | None]) -> None:
        self.staging.abort()


class BookFile:
    """A workbook that is written as a stream, sheet after sheet."""

    def __init__(self, sink, columns: list[str]):
        self.sink, self.columns = sink, columns
        self.zip = zipfile.ZipFile(sink, "w", zipfile.ZIP_DEFLATED)
        self.now, self.part, self.rows = None, None, 0
        self.done: list[str] = []

    def add(self, sheet: str, row: list) -> None:
        if sheet != self.now:
            self._end()
            self.now, self.rows = sheet, 0
            self.done.append(sheet)
            self.part = self.zip.open(f"xl/worksheets/sheet{len(self.done)}.xml", "w", force_zip64=True)
            self.part.write(f'{_HEAD}<worksheet xmlns="{_S[1:-1]}"><sheetData>'.encode())
            self._row(0, self.columns)
        self.rows += 1
        self._row(self.rows, row)

    def _row(self, n: int, row: list) -> None:
        self.part.write((f'<row r="{n + 1}">' + "".join(_cell(f"{_letters(k)}{n + 1}", v) for k, v in enumerate(row) if v is not None) + "</row>").encode())

    def _end(self) -> None:
        if self.part is not None:
            self.part.write(b"</sheetData></worksheet>")
            self.part.close()

    def close(self) -> None:
        self._end()
        n = len(self.done)
        sheets = "".join(f'<sheet name={quoteattr(s)} sheetId="{k}" r:id="r{k}"/>' for k, s in enumerate(self.done, 1))
        links = "".join(f'<Relationship Id="r{k}" Type="{_R[1:-1]}/worksheet" Target="worksheets/sheet{k}.xml"/>' for k in range(1, n + 1))
        kinds = "".join(f'<Override PartName="/xl/worksheets/sheet{k}.xml" ContentType="{_KIND}worksheet+xml"/>' for k in range(1, n + 1))
        self.zip.writestr("[Content_Types].xml", f'{_HEAD}<Types xmlns="{_OPC}content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="{_KIND}sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="{_KIND}styles+xml"/>{kinds}</Types>')
        self.zip.writestr("_rels/.rels", f'{_HEAD}<Relationships xmlns="{_OPC}relationships"><Relationship Id="r1" Type="{_R[1:-1]}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        self.zip.writestr("xl/workbook.xml", f'{_HEAD}<workbook xmlns="{_S[1:-1]}" xmlns:r="{_R[1:-1]}"><sheets>{sheets}</sheets></workbook>')
        self.zip.writestr("xl/_rels/workbook.xml.rels", f'{_HEAD}<Relationships xmlns="{_OPC}relationships">{links}<Relationship Id="s1" Type="{_R[1:-1]}/styles" Target="styles.xml"/></Relationships>')
        formats = "".join(f'<xf numFmtId="{k}" fontId="0" fillId="0" borderId="0" xfId="0" applyNumberFormat="1"/>' for k in (0, 14, 22))
        self.zip.writestr("xl/styles.xml", f'{_HEAD}<styleSheet xmlns="{_S[1:-1]}"><fonts count="1"><font/></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="3">{formats}</cellXfs></styleSheet>')
        self.zip.close()
        self.sink.close()


_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>'


def _cell(at: str, value: object) -> str:
    if isinstance(value, bool):
        return f'<c r="{at}" t="b"><v>{int(value)}</v></c>'
    if isinstance(value, dt.datetime):
        return f'<c r="{at}" s="2"><v>{round((value - EPOCH) / dt.timedelta(milliseconds=1)) / 86_400_000!r}</v></c>'
    if isinstance(value, dt.date):
        return f'<c r="{at}" s="1"><v>{(value - EPOCH.date()).days}</v></c>'
    if isinstance(value, float):
        return f'<c r="{at}"><v>{value!r}</v></c>' if value - value == 0 else ""
    if isinstance(value, (int, Decimal)) and abs(value) < 2**53 and Decimal(repr(float(value))) == value:
        return f'<c r="{at}"><v>{value}</v></c>'
    text = escape("".join(c for c in str(value) if c in "\t\n\r" or c >= " "), {"\r": "&#13;"})
    return f'<c r="{at}" t="inlineStr"><is><t xml:space="preserve">{text}</t></is></c>'


def register(spark) -> None:
    """Make the format known; filters reach a source in Python only where the session allows it."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", True)
    spark.dataSource.register(Workbook)
