"""Files: CSV, workbooks, JSON documents, result sets (SRC-09..15, SRC-17, SRC-20..22, SNK-*)."""

from __future__ import annotations

import glob
import os
import re
import xml.etree.ElementTree as ET
import zipfile
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

_MAIN = "{http://schemas.openxmlformats.org/spreadsheetml/2006/main}"
_REL = "{http://schemas.openxmlformats.org/officeDocument/2006/relationships}"


def read_csv(spark: SparkSession, path: str, infer: bool = True, **options: str) -> DataFrame:
    """CSV with a header; a byte order mark before the first name is dropped (SRC-11)."""
    df = spark.read.options(header=True, inferSchema=infer, **options).csv(path)
    return df.toDF(*[c.lstrip("﻿") for c in df.columns])


def read_csv_text(spark: SparkSession, path: str) -> DataFrame:
    """CSV with every column as text, empty cells as empty texts (SRC-14)."""
    df = spark.read.options(header=True, inferSchema=False, nullValue="\u0001", emptyValue="").csv(path)
    df = df.toDF(*[c.lstrip("﻿") for c in df.columns])
    return df.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in df.columns])


def write_csv(df: DataFrame, path: str, mark: bool = False) -> None:
    """CSV with a header, also for empty tables (SNK-01, SNK-09, SNK-11); mark puts a byte order mark before each file's header."""
    if mark and df.columns:
        df = df.withColumnRenamed(df.columns[0], "\ufeff" + df.columns[0])
    df.write.mode("overwrite").options(header=True).csv(path)


def write_table(df: DataFrame, name: str, **options: str) -> None:
    """Replace a catalog table (SNK-02)."""
    df.write.mode("overwrite").options(**options).saveAsTable(name)


def write_records(df: DataFrame, path: str) -> None:
    """One JSON object a line (SNK-04)."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def write_json_array(df: DataFrame, path: str) -> None:
    """One local JSON file with an array of the rows, nulls kept, dates as text; rows are streamed through the driver (SNK-04)."""
    import json

    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for n, row in enumerate(df.toLocalIterator()):
            f.write(("," if n else "") + "\n  " + json.dumps(row.asDict(recursive=True), ensure_ascii=False, default=str))
        f.write("\n]\n")


def read_dictionary(spark: SparkSession, path: str) -> DataFrame:
    """(category, key, code, ord) of a mapping dictionary {category: {key: code}}; counters are left out (SRC-15)."""
    import json

    with open(path, encoding="utf-8") as f:
        listed = [(c, k, str(v), n) for c, entries in json.load(f).items() if isinstance(entries, dict) and not c.startswith("_counter_") for n, (k, v) in enumerate(entries.items())]
    return spark.createDataFrame(listed, "category string, key string, code string, ord bigint")


def suffixed(path: str, suffix: str) -> str:
    """`a.xlsx` to `a_suffix.xlsx` (SNK-03)."""
    stem, ext = os.path.splitext(path)
    return f"{stem}_{suffix}{ext}"


# ---------------------------------------------------------------- workbooks (SRC-10, SRC-12, SRC-13)
def sheet_names(path: str) -> list[tuple[str, str]]:
    """(sheet name, part in the archive) of a workbook."""
    with zipfile.ZipFile(path) as z:
        book = ET.fromstring(z.read("xl/workbook.xml"))
        rels = {r.get("Id"): r.get("Target") for r in ET.fromstring(z.read("xl/_rels/workbook.xml.rels"))}
    return [(s.get("name"), "xl/" + rels[s.get(_REL + "id")].lstrip("/").removeprefix("xl/")) for s in book.iter(_MAIN + "sheet")]


def sheet_rows(path: str, part: str) -> Iterator[list[str | None]]:
    """Cells of one sheet as text, row by row, missing ones null."""
    with zipfile.ZipFile(path) as z:
        shared: list[str] = []
        if "xl/sharedStrings.xml" in z.namelist():
            shared = ["".join(t.text or "" for t in si.iter(_MAIN + "t")) for si in ET.fromstring(z.read("xl/sharedStrings.xml")).iter(_MAIN + "si")]
        with z.open(part) as f:
            for _, row in ET.iterparse(f):
                if row.tag != _MAIN + "row":
                    continue
                cells: list[str | None] = []
                for c in row.iter(_MAIN + "c"):
                    letters = re.match(r"[A-Z]+", c.get("r") or "")
                    at = len(cells)
                    if letters:
                        at = 0
                        for ch in letters.group():
                            at = at * 26 + ord(ch) - 64
                        at -= 1
                    cells += [None] * (at + 1 - len(cells))
                    v = c.find(_MAIN + "v")
                    if c.get("t") == "inlineStr":
                        cells[at] = "".join(t.text or "" for t in c.iter(_MAIN + "t"))
                    elif v is not None:
                        cells[at] = shared[int(v.text)] if c.get("t") == "s" else v.text
                yield cells
                row.clear()


class _SheetPartition(InputPartition):
    def __init__(self, path: str, name: str, part: str):
        super().__init__(name)
        self.path, self.name, self.part = path, name, part


class _WorkbookReader(DataSourceReader):
    def __init__(self, schema: T.StructType, options: dict):
        self.schema, self.paths, self.sheet = schema, sorted(glob.glob(options["path"])), options.get("sheet")

    def partitions(self) -> list[_SheetPartition]:
        return [_SheetPartition(p, n, part) for p in self.paths for n, part in sheet_names(p) if self.sheet in (None, n)]

    def read(self, partition: _SheetPartition) -> Iterator[tuple]:
        wanted = [f.name for f in self.schema.fields]
        rows = sheet_rows(partition.path, partition.part)
        header = next(rows, [])
        at = {h: i for i, h in enumerate(header) if h is not None}
        for n, cells in enumerate(rows, 1):
            own = {"_file": os.path.basename(partition.path), "_sheet": partition.name, "_row": n}
            yield tuple(own[c] if c in own else (cells[at[c]] if c in at and at[c] < len(cells) else None) for c in wanted)


class WorkbookSource(DataSource):
    """`spark.read.format("workbook").option("path", glob)`: every sheet of every workbook, one task for a sheet.

    All cells are text; columns are the union of the headers plus _file, _sheet and _row.
    """

    @classmethod
    def name(cls) -> str:
        return "workbook"

    def schema(self) -> T.StructType:
        names: dict[str, None] = {}
        for path in sorted(glob.glob(self.options["path"])):
            for n, part in sheet_names(path):
                if self.options.get("sheet") in (None, n):
                    names.update(dict.fromkeys(h for h in next(sheet_rows(path, part), []) if h is not None))
        head = [T.StructField("_file", T.StringType()), T.StructField("_sheet", T.StringType()), T.StructField("_row", T.IntegerType())]
        return T.StructType(head + [T.StructField(n, T.StringType()) for n in names])

    def reader(self, schema: T.StructType) -> _WorkbookReader:
        return _WorkbookReader(schema, self.options)


def read_workbook(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    spark.dataSource.register(WorkbookSource)
    reader = spark.read.format("workbook").option("path", path)
    return (reader.option("sheet", sheet) if sheet else reader).load()


def read_any(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """{sheet: table} by the file's ending; a CSV is one sheet named like the file (SRC-09). Other endings raise."""
    stem, ext = os.path.splitext(os.path.basename(path))
    if ext.lower() == ".csv":
        return {stem: read_csv(spark, path)}
    if ext.lower() == ".xlsx":
        return {n: read_workbook(spark, path, n) for n, _ in sheet_names(path)}
    raise ValueError(f"cannot read {ext or 'files without an ending'}")


def read_workbooks(spark: SparkSession, paths: list[str]) -> tuple[dict[tuple[str, str], DataFrame], dict[tuple[str, str], str]]:
    """({(path, sheet): table}, {(path, sheet): error}): a missing file is skipped with a note, a sheet or file that can't be read does not stop the others (SRC-10, SRC-12).

    Errors of a whole file have an empty sheet name. Old binary workbooks (.xls) are such errors: no reader of theirs is here.
    """
    good: dict[tuple[str, str], DataFrame] = {}
    bad: dict[tuple[str, str], str] = {}
    for path in paths:
        if not os.path.exists(path):
            bad[path, ""] = "no such file"
            continue
        try:
            names = [n for n, _ in sheet_names(path)] if path.lower().endswith(".xlsx") else list(read_any(spark, path))
        except Exception as e:
            bad[path, ""] = str(e).split("\n")[0] or type(e).__name__
            continue
        for name in names:
            try:
                good[path, name] = read_any(spark, path)[name] if not path.lower().endswith(".xlsx") else read_workbook(spark, path, name)
            except Exception as e:
                bad[path, name] = str(e).split("\n")[0] or type(e).__name__
    return good, bad


# ---------------------------------------------------------------- result sets (SRC-20..22)
def read_results(spark: SparkSession, pattern: str) -> DataFrame:
    """(model, result fields) of every results_<model>.json that fits the pattern; of equal ids in a file the last stays."""
    raw = spark.read.option("multiLine", True).json(pattern).withColumn("model", F.regexp_extract(F.input_file_name(), r"(?:^|/)results_([^/]+)\.json$", 1))
    rows = raw.select("model", F.posexplode("all_results").alias("at", "r"))
    last = rows.groupBy("model", F.col("r.id").alias("id")).agg(F.max_by("r", "at").alias("r"))
    return last.select("model", "r.*")


def per_query_metric(results: DataFrame, metric: str, difficulty: str | None = None, cluster: str | None = None) -> DataFrame:
    """(model, id, value) after the filters; an empty result raises (SRC-21, PRJ-06)."""
    kept = results
    if difficulty is not None:
        kept = kept.where(F.col("difficulty") == difficulty)
    if cluster is not None:
        kept = kept.where(F.col("cluster") == cluster)
    if kept.isEmpty():
        raise ValueError("no results fit the filters")
    return kept.select("model", "id", F.col(metric).cast("double").alias("value"))


def read_benchmark(spark: SparkSession, path: str) -> DataFrame:
    """One row for each query of a benchmark document (SRC-22)."""
    return spark.read.option("multiLine", True).json(path).select(F.explode("queries").alias("q")).select("q.*")


def index_fresh(index: DataFrame, content: str) -> bool:
    """Whether a stored index was made from this catalog text; an index without the mark is stale (SRC-25, HSH-02)."""
    import hashlib

    if "catalog_sha256" not in index.columns:
        return False
    row = index.select("catalog_sha256").first()
    return bool(row) and row[0] == hashlib.sha256(content.encode()).hexdigest()


def write_index(vectors: DataFrame, path: str, content: str) -> None:
    """Store an index (source_id, doc, vector) with the mark of the catalog text it was made from (SNK-07)."""
    import hashlib

    vectors.withColumn("catalog_sha256", F.lit(hashlib.sha256(content.encode()).hexdigest())).write.mode("overwrite").parquet(path)


def cached_index(spark: SparkSession, path: str, content: str, make) -> DataFrame:
    """The stored index if it is fresh, else what make() gives, stored (SRC-25, RET-04)."""
    try:
        held = spark.read.parquet(path)
        if index_fresh(held, content):
            return held
    except Exception:
        pass  # nothing stored yet, or nothing readable
    write_index(make(), path, content)
    return spark.read.parquet(path)


#: Fixed value: rows that one sheet of a workbook can hold.
SHEET_ROWS = 1_048_576


def write_workbook(sheets: dict[str, DataFrame], path: str) -> None:
    """One .xlsx file with a sheet for each table, header first, all cells as text (SNK-03).

    A workbook is one local file, so rows are streamed to the driver; a table beyond SHEET_ROWS is refused, not cut.
    """
    from xml.sax.saxutils import escape

    ns = 'xmlns="http://schemas.openxmlformats.org/spreadsheetml/2006/main"'
    rel = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
    for name, df in sheets.items():
        if df.limit(SHEET_ROWS).count() >= SHEET_ROWS:
            raise ValueError(f"{name} has more rows than a sheet holds")

    def cells(values) -> str:
        return "<row>" + "".join("<c/>" if v is None else f'<c t="inlineStr"><is><t xml:space="preserve">{escape(str(v))}</t></is></c>' for v in values) + "</row>"

    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        parts = "".join(f'<Override PartName="/xl/worksheets/s{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", f'<Types xmlns="http://schemas.openxmlformats.org/package/2006/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/>{parts}</Types>')
        z.writestr("_rels/.rels", f'<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships"><Relationship Id="r1" Type="{rel}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        listed = "".join(f'<sheet name="{escape(n[:31])}" sheetId="{i}" r:id="rId{i}"/>' for i, n in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", f'<workbook {ns} xmlns:r="{rel}"><sheets>{listed}</sheets></workbook>')
        z.writestr("xl/_rels/workbook.xml.rels", '<Relationships xmlns="http://schemas.openxmlformats.org/package/2006/relationships">' + "".join(f'<Relationship Id="rId{i}" Type="{rel}/worksheet" Target="worksheets/s{i}.xml"/>' for i in range(1, len(sheets) + 1)) + "</Relationships>")
        for i, df in enumerate(sheets.values(), 1):
            with z.open(f"xl/worksheets/s{i}.xml", "w", force_zip64=True) as f:
                f.write(f"<worksheet {ns}><sheetData>{cells(df.columns)}".encode())
                for row in df.toLocalIterator():
                    f.write(cells(row).encode())
                f.write(b"</sheetData></worksheet>")
