"""Sheets: CSV with a sniffed delimiter and encoding, XLSX by the standard library, and mapping files."""

from __future__ import annotations

import io
import json
import re
import tomllib
import zipfile
from collections.abc import Iterator
from datetime import datetime, timedelta
from functools import reduce
from xml.etree import ElementTree

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .shared import materialise

#: Encodings to try, delimiters to count, characters to look at.
ENCODINGS, DELIMITERS, LOOK = ("utf-8-sig", "cp1252", "latin-1"), ";,\t|", 4000


def sniff(head: bytes) -> tuple[str, str]:
    """(encoding, delimiter) by the beginning of a file: the first encoding that reads it, the delimiter that every line has equally often, else the more frequent of ; and ,."""
    for encoding in ENCODINGS:
        try:
            text = head.decode(encoding)
            break
        except UnicodeDecodeError as e:
            if e.end >= len(head) - 3:  # a character cut at the end
                text = head[: e.start].decode(encoding)
                break
    lines = [line for line in text[:LOOK].splitlines() if line.strip()][:20]
    counts = {d: [line.count(d) for line in lines] for d in DELIMITERS}
    steady = [d for d, n in counts.items() if n and min(n) == max(n) > 0]
    delimiter = max(steady, key=lambda d: counts[d][0]) if steady else ";" if sum(counts[";"]) >= sum(counts[","]) else ","
    return encoding, delimiter


#: cp1252 is ISO-8859-1 with letters where that has control characters.
_OWN = [(bytes([b]).decode("latin-1"), bytes([b]).decode("cp1252", "ignore")) for b in range(0x80, 0xA0)]
_CONTROLS, _LETTERS = ("".join(x) for x in zip(*[x for x in _OWN if x[1]], strict=True))
#: Lines of a file that are looked at.
HEAD_LINES = 20


def kinds_of_files(spark: SparkSession, path: str) -> dict[tuple[str, str], list[str]]:
    """The files at ``path`` by (encoding, delimiter), each sniffed by its first lines: tasks cut them off, and nothing else reaches the driver."""
    lines = spark.read.schema("line string").csv(path, sep="\u0001", quote="", encoding="ISO-8859-1", maxCharsPerColumn=-1)
    lines = lines.select("line", F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("start"), F.monotonically_increasing_id().alias("nr")).where("start = 0")
    first = lines.withColumn("n", F.row_number().over(Window.partitionBy("file").orderBy("nr"))).where(F.col("n") <= HEAD_LINES)
    heads = first.groupBy("file").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("n", F.substring("line", 1, LOOK).alias("line")))), lambda x: x["line"]), "\n").alias("head"))
    out: dict[tuple[str, str], list[str]] = {}
    for r in heads.orderBy("file").collect():
        out.setdefault(sniff(r["head"].encode("latin-1")), []).append(r["file"])
    return out


def read_csv(spark: SparkSession, path: str, multiline: bool = False, numbered: bool = False) -> DataFrame:
    """Rows of the CSV files at ``path`` with their headings as columns; files of different encodings and delimiters may lie together.

    Files are cut into tasks at their lines. Quoted line breaks need ``multiline``, which reads each file in one task. ``numbered`` adds file and
    row, the line's number as a citation has it: headings are row 1; empty lines are not counted. A folder without files gives an error, as in Spark.
    """
    parts = []
    for (encoding, delimiter), files in kinds_of_files(spark, path).items():
        charset = "UTF-8" if encoding == "utf-8-sig" else "ISO-8859-1"
        for group in _by_headings(spark, files, delimiter, charset):
            rows = spark.read.csv(group, sep=delimiter, encoding=charset, header=True, multiLine=multiline, nullValue="")
            if encoding == "cp1252":
                told = lambda name: name.translate(str.maketrans(_CONTROLS, _LETTERS))
                place = [F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start")] if numbered else []
                rows = rows.select(*[F.translate(f"`{c}`", _CONTROLS, _LETTERS).alias(told(c)) for c in rows.columns], *place)
            elif numbered:
                rows = rows.select("*", F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"))
            parts.append(_numbered(rows) if numbered else rows)
    if not parts:
        return spark.read.csv(path, header=True)
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), parts)


def _by_headings(spark: SparkSession, files: list[str], delimiter: str, charset: str) -> list[list[str]]:
    """Files of the same headings, in the same order: Spark reads the headings of one file for all that it reads at once."""
    out: dict[tuple, list[str]] = {}
    for file in files:
        out.setdefault(tuple(spark.read.csv(file, sep=delimiter, encoding=charset, header=True).columns), []).append(file)
    return list(out.values())


def _numbered(rows: DataFrame) -> DataFrame:
    """``rows`` with file and row: counts of a file's pieces are summed up, and within each the rows stand in order."""
    kept = [c for c in rows.columns if c not in ("_file", "_start")]
    rows = materialise(rows.withColumn("_nr", F.monotonically_increasing_id()), "rows")
    counts = rows.groupBy("_file", "_start").agg(F.count("*").alias("n"))
    before = counts.select("_file", "_start", (F.sum("n").over(Window.partitionBy("_file").orderBy("_start")) - F.col("n")).alias("_before"))
    nr = F.row_number().over(Window.partitionBy("_file", "_start").orderBy("_nr"))
    return rows.withColumn("_at", nr).join(before, ["_file", "_start"]).select(*kept, F.col("_file").alias("file"), (F.col("_before") + F.col("_at") + 1).cast("int").alias("row"))


_NS = {"m": "http://schemas.openxmlformats.org/spreadsheetml/2006/main", "r": "http://schemas.openxmlformats.org/officeDocument/2006/relationships"}


def column_index(letters: str) -> int:
    """A column's number from 0: A is 0, AA is 26."""
    n = 0
    for letter in letters.upper():
        n = n * 26 + ord(letter) - 64
    return n - 1


def _dates_of(z: zipfile.ZipFile) -> list[bool]:
    """For each cell style of a workbook whether its number is a date."""
    if "xl/styles.xml" not in z.namelist():
        return []
    root = ElementTree.parse(z.open("xl/styles.xml")).getroot()
    own = {int(f.get("numFmtId")): re.sub(r'"[^"]*"|\\[.*?\\]', "", f.get("formatCode", "")).lower() for f in root.iterfind("m:numFmts/m:numFmt", _NS)}
    ids = [int(x.get("numFmtId", 0)) for x in root.iterfind("m:cellXfs/m:xf", _NS)]
    return [14 <= i <= 22 or 45 <= i <= 47 or bool(re.search("[dmy]", own.get(i, ""))) for i in ids]


def _as_date(serial: str) -> str:
    """The ISO text of a spreadsheet's day number, with the time if it has one."""
    moment = datetime(1899, 12, 30) + timedelta(seconds=round(float(serial) * 86400))
    return moment.isoformat() if moment.time() != datetime.min.time() else moment.date().isoformat()


def _sheets(content: bytes) -> Iterator[tuple[str, int, int, str]]:
    """(sheet, row, col, value) of every filled cell of a workbook; dates as ISO text, whole numbers without a point."""
    with zipfile.ZipFile(io.BytesIO(content)) as z:
        shared = [] if "xl/sharedStrings.xml" not in z.namelist() else ["".join(t.text or "" for t in s.iter(f"{{{_NS['m']}}}t")) for s in ElementTree.parse(z.open("xl/sharedStrings.xml")).getroot()]
        rels = {r.get("Id"): r.get("Target") for r in ElementTree.parse(z.open("xl/_rels/workbook.xml.rels")).getroot()}
        dates = _dates_of(z)
        for sheet in ElementTree.parse(z.open("xl/workbook.xml")).getroot().iterfind("m:sheets/m:sheet", _NS):
            target = rels[sheet.get(f"{{{_NS['r']}}}id")].lstrip("/")
            for cell in ElementTree.parse(z.open(target if target.startswith("xl/") else f"xl/{target}")).getroot().iterfind(".//m:c", _NS):
                place, kind, style = re.match(r"([A-Z]+)(\d+)", cell.get("r")), cell.get("t", "n"), int(cell.get("s", 0))
                value = "".join(t.text or "" for t in cell.iter(f"{{{_NS['m']}}}t")) if kind == "inlineStr" else cell.findtext("m:v", None, _NS)
                if value in (None, ""):
                    continue
                if kind == "s":
                    value = shared[int(value)]
                elif kind == "n" and style < len(dates) and dates[style]:
                    value = _as_date(value)
                elif kind == "n" and re.fullmatch(r"-?\d+\.0+", value):
                    value = value.split(".")[0]
                yield sheet.get("name"), int(place[2]), column_index(place[1]), value


def read_xlsx(spark: SparkSession, path: str) -> DataFrame:
    """(file, sheet, row, col, value): the filled cells of all workbooks at ``path``, a workbook to a task."""

    def run(rows):
        import pandas as pd

        for frame in rows:
            for file, content in zip(frame["path"], frame["content"], strict=True):
                yield pd.DataFrame([(file, *cell) for cell in _sheets(content)], columns=["file", "sheet", "row", "col", "value"])

    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(run, "file string, sheet string, row int, col int, value string")


def list_sheets(cells: DataFrame) -> DataFrame:
    """(file, sheet, n_rows, headings) of cells: how many rows below the first say anything, and the headings (array of struct(col, title))."""
    rows = cells.where("row > 1").groupBy("file", "sheet").agg(F.countDistinct("row").alias("n_rows"))
    heads = cells.where("row = 1").groupBy("file", "sheet").agg(F.array_sort(F.collect_list(F.struct("col", F.col("value").alias("title")))).alias("headings"))
    none = F.array().cast("array<struct<col:int,title:string>>")
    return heads.join(rows, ["file", "sheet"], "full").select("file", "sheet", F.coalesce("n_rows", F.lit(0)).alias("n_rows"), F.coalesce("headings", none).alias("headings"))


def sheet_rows(cells: DataFrame) -> DataFrame:
    """(file, sheet, row, values): the rows from the second on that say anything, as maps of column to cell."""
    return cells.where("row > 1 AND trim(value) <> ''").groupBy("file", "sheet", "row").agg(F.map_from_entries(F.collect_list(F.struct("col", "value"))).alias("values"))


def load_mapping(text: str) -> list[dict]:
    """Sheets of a mapping file: name, register, blanks, file if one is named, and fields as (field, [column numbers], constant).

    A column is a letter or a run of letters like S-AN; ``X = "field=const"`` sets a constant for every tick in X. A sheet is a section of its own, ``[taufe]``, or one of
    ``[register.taufe]`` with its columns in ``[register.taufe.spalten]``; what stands for nothing is named before all sections, in ``[allgemein]`` or in a sheet's own.
    """
    data = tomllib.loads(text)
    blanks = [*data.get("leer", []), *data.get("allgemein", {}).get("leer", [])]
    out = []
    for name, body in {**{k: v for k, v in data.items() if k not in ("register", "allgemein")}, **data.get("register", {})}.items():
        if not isinstance(body, dict):
            continue
        columns = body.get("spalten", {k: v for k, v in body.items() if re.fullmatch(r"[A-Z]+(-[A-Z]+)?", k)})
        fields = []
        for place, field in columns.items():
            first, _, last = (x.strip() for x in place.partition("-"))
            run = list(range(column_index(first), column_index(last or first) + 1))
            field, _, constant = str(field).partition("=")
            if field:
                fields.append((field.strip(), run, constant.strip() or None))
        register = body.get("register", re.sub(r"_\d+$", "", name))
        out.append(({"file": body["datei"]} if "datei" in body else {}) | {"name": body.get("blatt", name), "register": register, "blanks": blanks + list(body.get("leer", [])), "fields": fields})
    return out


def _quoted(text: str) -> str:
    """A TOML string."""
    return json.dumps(text, ensure_ascii=False)


def dump_mapping(sheets: list[dict]) -> str:
    """A mapping file's text; a second sheet of a register gets a numbered section.

    A proposal may carry the sheet's "file", the dates that lead ("lead"), for each place what is said about it ("notes": place to a comment; "comments": by first column), and headings that no field takes
    ("open": (column, title)), which stand as lines to be filled in.
    """
    seen: dict[str, int] = {}
    out = []
    letters = lambda i: (letters(i // 26 - 1) if i >= 26 else "") + chr(65 + i % 26)
    line = lambda s: re.sub(r"\s+", " ", s)
    blanks = sorted({w for s in sheets for w in s.get("blanks", [])})
    if blanks:
        out += [f"leer = [{', '.join(map(_quoted, blanks))}]", ""]
    for s in sheets:
        seen[s["register"]] = n = seen.get(s["register"], 0) + 1
        out += [f"[{s['register']}{f'_{n}' if n > 1 else ''}]", f"blatt = {_quoted(s['name'])}"]
        out += [f"datei = {_quoted(s['file'])}"] if s.get("file") else []
        out += [f"leitdatum = [{', '.join(map(_quoted, s['lead']))}]"] if s.get("lead") else []
        out.append("")
        for field, run, constant in s["fields"]:
            place = letters(run[0]) if len(run) == 1 else f"{letters(run[0])}-{letters(run[-1])}"
            note = s.get("notes", {}).get(place) or s.get("comments", {}).get(run[0])
            out.append(f'{place} = {_quoted(field + (f"={constant}" if constant else ""))}' + (f"  # {line(note)}" if note else ""))
        out += [f'# {letters(col)} = "???"  # {line(title)}' for col, title in s.get("open", [])]
        out.append("")
    return "\n".join(out)
