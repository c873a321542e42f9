"""Deliverables: JSON, flat CSV and workbooks (survey K1-K10).

The ``*_dir`` sinks write in parallel; the single-file ones stream rows to the driver one
partition at a time and are meant for deliverables of a size people open.
"""

from __future__ import annotations

import csv
import json
import os
import zipfile
from collections.abc import Iterable
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from acequia.config import CATEGORIES
from acequia.functions.scalars import category_sheet, flatten
from acequia.schema import CATEGORY_COLUMNS, CONSOLIDATED_FIELDS, FLAT_COLUMNS


def json_dir(df: DataFrame, path: str) -> None:
    """K1 at scale: JSON lines."""
    df.write.mode("overwrite").option("ignoreNullFields", "false").json(path)


def json_file(df: DataFrame, path: str, order: str | None = None) -> bool:
    """One indented array, not written if there are no rows."""
    rows = (df.orderBy(order) if order else df).toLocalIterator()
    first = next(rows, None)
    if first is None:
        return False
    with open(path, "w", encoding="utf-8") as f:
        f.write("[")
        for i, r in enumerate(_chain(first, rows)):
            body = json.dumps(r.asDict(True), ensure_ascii=False, indent=2, default=str).replace("\n", "\n  ")
            f.write(("," if i else "") + "\n  " + body)
        f.write("\n]")
    return True


def _chain(first, rest):
    yield first
    yield from rest


def envelope_file(buckets: dict[str, DataFrame], metadata: dict, path: str) -> None:
    """K2: {metadata, results}, written row by row."""
    text = lambda v, by: json.dumps(v, ensure_ascii=False, indent=2, default=str).replace("\n", "\n" + " " * by)
    with open(path, "w", encoding="utf-8") as f:
        f.write('{\n  "metadata": ' + text(metadata, 2) + ',\n  "results": {')
        for i, (name, df) in enumerate(buckets.items()):
            f.write(("," if i else "") + "\n    " + json.dumps(name, ensure_ascii=False) + ": [")
            n = 0
            for r in df.select(F.to_json(F.struct(*df.columns), {"ignoreNullFields": "false"}).alias("j")).toLocalIterator():
                f.write(("," if n else "") + "\n      " + text(json.loads(r.j), 6))
                n += 1
            f.write("\n    ]" if n else "]")
        f.write("\n  }\n}" if buckets else "}\n}")


def flat_rows(items: DataFrame, order: str = "ingest_seq") -> DataFrame:
    """K3: rank and order of each row with the thirteen flat columns of its category."""
    rank = F.array_position(F.array(*[F.lit(c) for c in CATEGORIES]), F.col("category"))
    known = items.withColumn("_rank", rank).where("_rank > 0")
    return flatten(known, "_rank", F.col(order).alias("_o"), "category").select("_rank", "_o", *FLAT_COLUMNS)


def csv_file(rows: DataFrame, columns: list[str], path: str) -> None:
    """K3, K7: UTF-8 with a byte-order mark, rows end in CRLF; the frame's order is kept."""
    with open(path, "w", encoding="utf-8-sig", newline="") as f:
        out = csv.writer(f)
        out.writerow(columns)
        for r in rows.select(*columns).toLocalIterator():
            out.writerow(["" if v is None else v for v in r])


def csv_dir(rows: DataFrame, path: str) -> None:
    """K3 at scale: CSV parts with a header, quotes doubled, empty cells empty."""
    rows.write.mode("overwrite").option("header", True).option("escape", '"').option("emptyValue", "").csv(path)


def consolidated_rows(df: DataFrame, order: str = "first_seq") -> DataFrame:
    """K7: jobs, then companies; other types drop out."""
    rank = F.when(F.col("type") == "job", 0).when(F.col("type") == "company", 1)
    return df.withColumn("_rank", rank).where("_rank is not null").orderBy("_rank", order).select(*CONSOLIDATED_FIELDS)


# ------------------------------------------------------------------------- workbooks

_HEAD = '<?xml version="1.0" encoding="UTF-8" standalone="yes"?>\n'
_MAIN = "http://schemas.openxmlformats.org/spreadsheetml/2006/main"
_REL = "http://schemas.openxmlformats.org/officeDocument/2006/relationships"
_PKG = "http://schemas.openxmlformats.org/package/2006"


def _letters(n: int) -> str:
    s = ""
    while n:
        n, r = divmod(n - 1, 26)
        s = chr(65 + r) + s
    return s


def _clean(v) -> str:
    return escape("".join(c for c in str(v) if c in "\t\n\r" or ord(c) >= 32))


def _sheet(columns: list[str], rows: Iterable, width: int = 22) -> Iterable[str]:
    yield _HEAD + f'<worksheet xmlns="{_MAIN}"><sheetViews><sheetView workbookViewId="0"><pane ySplit="1" topLeftCell="A2" state="frozen"/></sheetView></sheetViews>'
    yield f'<cols><col min="1" max="{max(1, len(columns))}" width="{width}" customWidth="1"/></cols><sheetData>'
    for n, row in enumerate(_chain(columns, rows), 1):
        style = ' s="1"' if n == 1 else ""
        cells = "".join(f'<c r="{_letters(i)}{n}" t="inlineStr"{style}><is><t xml:space="preserve">{_clean(v)}</t></is></c>' for i, v in enumerate(row, 1) if v is not None)
        yield f'<row r="{n}">{cells}</row>'
    yield "</sheetData></worksheet>"


def workbook(sheets: list[tuple[str, list[str], Iterable]], path: str) -> None:
    """K4, K8: (name, columns, rows) sheets, first row bold and frozen; text cells only."""
    with zipfile.ZipFile(path, "w", zipfile.ZIP_DEFLATED) as z:
        types = "".join(f'<Override PartName="/xl/worksheets/sheet{i}.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.worksheet+xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("[Content_Types].xml", _HEAD + f'<Types xmlns="{_PKG}/content-types"><Default Extension="rels" ContentType="application/vnd.openxmlformats-package.relationships+xml"/><Default Extension="xml" ContentType="application/xml"/><Override PartName="/xl/workbook.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.sheet.main+xml"/><Override PartName="/xl/styles.xml" ContentType="application/vnd.openxmlformats-officedocument.spreadsheetml.styles+xml"/>{types}</Types>')
        z.writestr("_rels/.rels", _HEAD + f'<Relationships xmlns="{_PKG}/relationships"><Relationship Id="r1" Type="{_REL}/officeDocument" Target="xl/workbook.xml"/></Relationships>')
        names = "".join(f'<sheet name="{escape(n[:31])}" sheetId="{i}" r:id="r{i}"/>' for i, (n, _, _) in enumerate(sheets, 1))
        z.writestr("xl/workbook.xml", _HEAD + f'<workbook xmlns="{_MAIN}" xmlns:r="{_REL}"><sheets>{names}</sheets></workbook>')
        links = "".join(f'<Relationship Id="r{i}" Type="{_REL}/worksheet" Target="worksheets/sheet{i}.xml"/>' for i in range(1, len(sheets) + 1))
        z.writestr("xl/_rels/workbook.xml.rels", _HEAD + f'<Relationships xmlns="{_PKG}/relationships">{links}<Relationship Id="s" Type="{_REL}/styles" Target="styles.xml"/></Relationships>')
        z.writestr("xl/styles.xml", _HEAD + f'<styleSheet xmlns="{_MAIN}"><fonts count="2"><font/><font><b/></font></fonts><fills count="1"><fill/></fills><borders count="1"><border/></borders><cellStyleXfs count="1"><xf/></cellStyleXfs><cellXfs count="2"><xf/><xf fontId="1" applyFont="1"/></cellXfs></styleSheet>')
        for i, (_, columns, rows) in enumerate(sheets, 1):
            with z.open(f"xl/worksheets/sheet{i}.xml", "w") as f:
                for part in _sheet(columns, rows):
                    f.write(part.encode("utf-8"))


def export_all(items: DataFrame, folder: str, stamp: str, order: str = "ingest_seq") -> tuple[str, str]:
    """K3, K4, K5: workbook and flat CSV of all categories; gives their paths."""
    os.makedirs(folder, exist_ok=True)
    counts = {r["category"]: r["n"] for r in items.groupBy("category").agg(F.count("*").alias("n")).collect()}
    sheets: list = [("README", ["category", "rows"], [(c, counts.get(c, 0)) for c in CATEGORIES])]
    for c in CATEGORIES:
        rows = category_sheet(items.where(F.col("category") == c).orderBy(order), c)
        sheets.append((c, CATEGORY_COLUMNS[c], (tuple(r) for r in rows.toLocalIterator())))
    book, flat = f"{folder}/records_{stamp}.xlsx", f"{folder}/records_{stamp}.csv"
    workbook(sheets, book)
    csv_file(flat_rows(items, order).orderBy("_rank", "_o"), FLAT_COLUMNS, flat)
    return book, flat


def consolidated_workbook(df: DataFrame, path: str, order: str = "first_seq") -> None:
    """K8: jobs and, if there are any, companies under their own labels."""
    rows = consolidated_rows(df, order)
    plain = [c for c in CONSOLIDATED_FIELDS if not c.startswith("_")]
    labels = {"_emails": "emails", "_telefonos": "telefonos", "_sector": "sector"}
    sheets: list = [("README", ["sheet"], [("jobs",), ("companies",)]), ("jobs", plain, (tuple(r) for r in rows.where("type = 'job'").select(*plain).toLocalIterator()))]
    companies = rows.where("type = 'company'")
    if not companies.isEmpty():
        cols = plain + list(labels)
        sheets.append(("companies", [labels.get(c, c) for c in cols], (tuple(r) for r in companies.select(*cols).toLocalIterator())))
    workbook(sheets, path)


def safe_write(df: DataFrame, path: str) -> None:
    """K9: write beside, then rename; a failure leaves the old result, or it beside as ``.old``."""
    spark = df.sparkSession
    df.write.mode("overwrite").parquet(path + ".part")
    jvm = spark.sparkContext._jvm
    old, new = jvm.org.apache.hadoop.fs.Path(path), jvm.org.apache.hadoop.fs.Path(path + ".part")
    fs = old.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration())
    aside = jvm.org.apache.hadoop.fs.Path(path + ".old")
    if fs.exists(old):
        fs.delete(aside, True)
        if not fs.rename(old, aside):
            raise OSError(f"{path} can't be set aside")
    if not fs.rename(new, old):
        if fs.exists(aside):
            fs.rename(aside, old)
        raise OSError(f"{path} can't be replaced")
    fs.delete(aside, True)
