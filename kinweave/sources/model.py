"""The rules' model out of a stored family book: tables, an SQLite file or a GEDCOM, told apart by what they begin with."""

from __future__ import annotations

import sqlite3

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.dates import date_struct, rule_date
from ..operators.rules import Model
from ..operators.verdicts import age_in_text
from . import gedcom

c = F.col

#: Tables and columns of a stored family book. The last two tables may be absent, and any column but the ids.
TABLES = {
    "ofb_individuum": "id long, artikel_id long, rolle string, vn_kanonisch string, fn_kanonisch string, geschlecht string, geburt_iso string, tod_iso string, beruf string, notiz string, ort string, eigenes_artikel_id long",
    "ofb_familie": "id long, vater_id long, mutter_id long, heirat_iso string, notiz string",
    "ofb_familie_kind": "familie_id long, individuum_id long, geburtsreihe long",
    "ofb_person_kanon": "id long, kanon_id long",
    "blank_artikel": "id long, roh_text string",
}
NEEDED = ("ofb_individuum", "ofb_familie", "ofb_familie_kind")
SQLITE = b"SQLite format 3\0"


def _fields(schema: str) -> list[tuple[str, str]]:
    return [tuple(x.split()) for x in schema.split(", ")]


def shaped(table: DataFrame, schema: str) -> DataFrame:
    """``table`` with the columns of ``schema``: absent ones null, others as they can be read in its types (null where they can't), further ones left out."""
    return table.select(*[(c(f"`{name}`").try_cast(kind) if name in table.columns else F.lit(None).cast(kind)).alias(name) for name, kind in _fields(schema)])


def _rows_of(table: str, schema: str):
    fields = _fields(schema)
    kinds = {"long": pa.int64(), "string": pa.string()}
    arrow = pa.schema([(name, kinds[kind]) for name, kind in fields])

    def rows(batches):
        for batch in batches:
            for content in batch.column("content"):
                data = bytearray(content.as_py())
                data[18:20] = b"\x01\x01"  # a file kept with a log beside it opens as one without
                con = sqlite3.connect(":memory:")
                con.deserialize(data)
                there = {x[1] for x in con.execute(f'PRAGMA table_info("{table}")')}
                if there:
                    told = {"long": "CAST({0} AS INTEGER)", "string": "CAST({0} AS TEXT)"}
                    cells = ", ".join(told[kind].format(f'"{name}"') if name in there else "NULL" for name, kind in fields)
                    cursor = con.execute(f'SELECT {cells} FROM "{table}"')
                    while some := cursor.fetchmany(8192):
                        yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*some), arrow)], schema=arrow)
                con.close()

    return rows


def read_sqlite(spark: SparkSession, path: str, table: str, schema: str) -> DataFrame:
    """A table of the SQLite file at ``path``, with columns of type long or string; absent columns are null, an absent table has no rows.

    A task reads a file whole, so it must be under 2 GB; larger books are read as tables. What stands in a log beside the file isn't seen.
    """
    files = spark.read.format("binaryFile").load(path).select("content")
    return files.mapInArrow(_rows_of(table, schema), schema)


def from_tables(tables: dict[str, DataFrame]) -> Model:
    """The model of a family book's tables, by name (see :data:`TABLES`).

    Rows merged into another person are no persons; of each the dates of death on both sides are kept for the rules. A child with an article of its own
    is known to be the same as the head of that article. Children stand by their order of birth, those without one last, then by number. The age at death is what an article's text says
    behind the date of death. Sexes but m and w are u, absent texts empty.
    """
    if missing := [name for name in NEEDED if name not in tables]:
        raise ValueError(f"a family book has the tables {', '.join(NEEDED)}; missing: {', '.join(missing)}")
    t = {name: shaped(tables[name], schema) for name, schema in TABLES.items() if name in tables}
    every = t["ofb_individuum"].where("id IS NOT NULL")
    own, merged = every, None
    if "ofb_person_kanon" in t:
        folded = t["ofb_person_kanon"].where("id IS NOT NULL")
        died = lambda key, as_: every.select(c("id").alias(key), c("tod_iso").alias(as_))
        merged = folded.join(died("kanon_id", "death_a"), "kanon_id").join(died("id", "death_b"), "id").select(c("kanon_id").alias("person_id"), "death_a", "death_b")
        own = every.join(folded.select("id").distinct(), "id", "left_anti")
    text_age: Column = F.lit(None).cast("double")
    if "blank_artikel" in t:
        own = own.join(t["blank_artikel"].select(c("id").alias("artikel_id"), "roh_text"), "artikel_id", "left")
        text_age = age_in_text(c("roh_text"), c("tod_iso"))
    said = lambda name: F.coalesce(name, F.lit(""))
    none = date_struct(*[F.lit(None).cast("int")] * 3)
    never = F.when(F.lit(False), none)
    p = own.select(
        c("id").alias("person_id"), F.trim(said("vn_kanonisch")).alias("given"), F.trim(said("fn_kanonisch")).alias("surname"), F.when(c("geschlecht").isin("m", "w"), c("geschlecht")).otherwise("u").alias("sex"),
        rule_date(c("geburt_iso")).alias("birth"), rule_date(c("tod_iso")).alias("death"), never.alias("baptism"), never.alias("burial"), said("beruf").alias("occupation"), said("notiz").alias("note"),
        said("ort").alias("place"), said("rolle").alias("role"), c("artikel_id").alias("article"), text_age.alias("text_age"),
    )
    heads = p.where("role = 'kopf' AND article IS NOT NULL").select(c("person_id").alias("b"), c("article").alias("eigenes_artikel_id"))
    alias = own.select(c("id").alias("a"), "eigenes_artikel_id").join(heads, "eigenes_artikel_id").select("a", "b")
    f = t["ofb_familie"].where("id IS NOT NULL").select(c("id").alias("family_id"), c("vater_id").alias("husband"), c("mutter_id").alias("wife"), rule_date(c("heirat_iso")).alias("wedding"), said("notiz").alias("note"))
    place = F.row_number().over(Window.partitionBy("family_id").orderBy(F.coalesce("geburtsreihe", F.lit(9999)), "child"))
    fc = t["ofb_familie_kind"].select(c("familie_id").alias("family_id"), c("individuum_id").alias("child"), "geburtsreihe").withColumn("pos", place).drop("geburtsreihe")
    return Model(p, f, fc, alias=alias, merged=merged)


def open_model(spark: SparkSession, path: str) -> Model:
    """The model of what is at ``path``: a folder with a Parquet table for each of :data:`TABLES` there is, an SQLite file, or else a GEDCOM."""
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    fs = at.getFileSystem(spark._jsc.hadoopConfiguration())
    if fs.getFileStatus(at).isDirectory():
        names = {x.getPath().getName().removesuffix(".parquet"): x.getPath().toString() for x in fs.listStatus(at)}
        if set(NEEDED) & set(names):
            return from_tables({name: spark.read.parquet(names[name]) for name in TABLES if name in names})
        return Model(*gedcom.model_of(gedcom.read_texts(spark, path)))
    opened = fs.open(at)
    try:
        head = bytes(x for x in (opened.read() for _ in SQLITE) if x >= 0)
    finally:
        opened.close()
    if head == SQLITE:
        return from_tables({name: read_sqlite(spark, path, name, schema) for name, schema in TABLES.items()})
    return Model(*gedcom.model_of(gedcom.read_texts(spark, path)))
