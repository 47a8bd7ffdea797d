"""Readers of landed files: JSON envelopes, CSV, ZIP members, worksheets, cubes and the shapes that feeds come in.

Downloads are somebody else's work: a feed is a file or folder here. What is missing or can't be read is an empty table with
the declared columns, never an error, as the scheduled run must go on.
"""

from __future__ import annotations

import functools
import io
import json
import re
import time
import zipfile
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tillage.functions.parse import country_key

META = "_meta struct<generated_at:timestamp, source:string, notes:string, version:string>"


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(p)


def envelope(spark: SparkSession, path: str, payload: str) -> DataFrame:
    """One row of _meta and data; payload is the data's type. Nothing is inferred, so keys of a map don't become columns."""
    schema = f"{META}, data {payload}"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def keyed_rows(documents: DataFrame, key: str = "iso3") -> DataFrame:
    """A row for each key of a map of structs."""
    flat = documents.select(F.explode("data").alias(key, "v"))
    return flat.select(key, "v.*")


def two_level_rows(documents: DataFrame, key: str = "iso3", metric: str = "metric") -> DataFrame:
    """A row for each key and inner key of a map of maps of structs."""
    return documents.select(F.explode("data").alias(key, "m")).select(key, F.explode("m").alias(metric, "v")).select(key, metric, "v.*")


def feed_meta(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """feed, present, generated_at, source, notes, version, n_rows (keys of the data; 0 for none) of some envelopes.

    Only the envelope is parsed; the data come as text, whose top-level keys are counted.
    """
    parts = []
    for feed, path in paths.items():
        found = envelope(spark, path, "string")
        keys = F.coalesce(F.json_array_length("data"), F.size(F.json_object_keys("data")), F.lit(0))
        row = found.agg(F.lit(feed).alias("feed"), F.count_if(F.col("_meta").isNotNull()) > 0, F.first("_meta.generated_at"), F.first("_meta.source"), F.first("_meta.notes"), F.first("_meta.version"), F.coalesce(F.sum(keys), F.lit(0)))
        parts.append(row.toDF("feed", "present", "generated_at", "source", "notes", "version", "n_rows"))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def csv_rows(spark: SparkSession, path: str, encoding: str = "UTF-8") -> DataFrame:
    """CSV with a header, every cell as text; headings are trimmed and lose a byte-order mark."""
    df = spark.read.option("header", True).option("inferSchema", False).option("encoding", encoding).option("multiLine", False).option("mode", "PERMISSIVE").csv(path)
    return df.toDF(*(c.lstrip("﻿").strip() for c in df.columns))


def csv_cells(spark: SparkSession, path: str, columns: int) -> DataFrame:
    """CSV without a header contract: so many text columns _c0, _c1, ...; shorter rows are filled with nulls, the order is kept in ord."""
    df = spark.read.option("header", False).schema(", ".join(f"_c{k} string" for k in range(columns))).csv(path)
    return df.withColumn("ord", F.monotonically_increasing_id())


def find_column(df: DataFrame, *names: str) -> str | None:
    """The column that has one of some names but for case, blanks, underscores and (cpc); an exact name comes first."""
    norm = lambda s: s.lower().replace("(cpc)", "").replace(" ", "").replace("_", "")
    for n in names:
        if n in df.columns:
            return n
    by = {norm(c): c for c in reversed(df.columns)}
    return next((by[norm(n)] for n in names if norm(n) in by), None)


def land_zip(spark: SparkSession, path: str, folder: str, wanted: str = r"\.csv$", encoding: str = "utf-8") -> DataFrame:
    """Text lines of the first member whose name fits (else the first .csv) of a ZIP file, or of each in a folder, written to a folder and read from it.

    A ZIP member is one stream, so an archive is one task's work, line by line; of a folder of archives each is a task and a file of its own,
    held whole while it is read (member_lines of paged.py holds none, where tasks can open the archives). What comes after reads the folder in parallel.
    """

    def lines(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for content in batch["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as z:
                    names = [n for n in z.namelist() if re.search(wanted, n)] or [n for n in z.namelist() if n.endswith(".csv")]
                    if not names:
                        continue
                    with z.open(names[0]) as member:
                        text, held = io.TextIOWrapper(member, encoding=encoding, errors="replace", newline=""), []
                        for line in text:
                            held.append(line.rstrip("\r\n"))
                            if len(held) >= 50_000:
                                yield pd.DataFrame({"value": held})
                                held = []
                        yield pd.DataFrame({"value": held})

    if not exists(spark, path):
        return spark.createDataFrame([], "value string")
    own = spark.newSession()  # its settings are seen by no other query
    own.conf.set("spark.sql.files.maxPartitionBytes", "1b")  # no two archives in a task, nor in a file
    own.read.format("binaryFile").load(path).select("content").mapInPandas(lines, "value string").write.mode("overwrite").text(folder)
    return spark.read.text(folder)


def sheet_cells(spark: SparkSession, sheet: str, strings: str | None = None) -> DataFrame:
    """row, col (from 0), value of an unpacked worksheet's XML, shared strings put in; read by Spark's XML source."""
    cell = "struct<_r:string, _t:string, v:string, is:struct<t:string>>"
    rows = spark.read.format("xml").option("rowTag", "row").schema(f"_r int, c array<{cell}>").load(sheet)
    cells = rows.select(F.col("_r").alias("row"), F.explode("c").alias("c"))
    letters = F.regexp_extract("c._r", "^([A-Z]+)", 1)
    at = F.aggregate(F.filter(F.split(letters, ""), lambda x: x != ""), F.lit(0), lambda n, x: n * 26 + F.ascii(x) - 64) - 1
    cells = cells.select("row", at.alias("col"), F.col("c._t").alias("t"), F.coalesce("c.v", "c.is.t").alias("v"))
    if strings is None:
        return cells.select("row", "col", F.col("v").alias("value"))
    shared = spark.read.format("xml").option("rowTag", "sst").schema("si array<struct<t:string, r:array<struct<t:string>>>>").load(strings).select(F.posexplode("si").alias("k", "s"))
    shared = shared.select("k", F.coalesce("s.t", F.array_join(F.col("s.r.t"), "")).alias("text"))
    out = cells.join(shared, (F.col("t") == "s") & (F.col("v").try_cast("int") == F.col("k")), "left")
    return out.select("row", "col", F.coalesce("text", "v").alias("value"))


def workbook_cells(spark: SparkSession, path: str, sheet: str | None = None) -> DataFrame:
    """path, row, col (from 0), value of a worksheet, by its name (none: the first), of a workbook or of each in a folder; unknown sheets give nothing.

    A workbook is one task's work; its cells are read one by one. Shared and inline texts may be rich (of several runs).
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for name, content in zip(batch["path"], batch["content"]):
                with zipfile.ZipFile(io.BytesIO(content)) as book:
                    cells = list(_sheet(book, sheet))
                yield pd.DataFrame([(name, *c) for c in cells], columns=["path", "row", "col", "value"])

    schema = "path string, row int, col int, value string"
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInPandas(read, schema)


def _sheet(book: zipfile.ZipFile, name: str | None) -> Iterator[tuple[int, int, str]]:
    local = lambda e: e.tag.rpartition("}")[2]
    under = lambda e, tag: [x for x in e.iter() if local(x) == tag]
    # phonetic hints (rPh) stand beside the runs and are no part of the text
    words = lambda e: "".join(t.text or "" for part in e if local(part) in ("t", "r") for t in ([part] if local(part) == "t" else under(part, "t")))
    tree = lambda member: ElementTree.fromstring(book.read(member))
    files = set(book.namelist())
    listed = [(s.get("name"), next(v for k, v in s.attrib.items() if k.endswith("}id"))) for s in under(tree("xl/workbook.xml"), "sheet")]
    ids = [i for n, i in listed if name is None or n == name]
    targets = {r.get("Id"): r.get("Target") for r in under(tree("xl/_rels/workbook.xml.rels"), "Relationship")}
    if not ids or ids[0] not in targets:
        return
    target = targets[ids[0]].lstrip("/")
    shared = [words(si) for si in tree("xl/sharedStrings.xml") if local(si) == "si"] if "xl/sharedStrings.xml" in files else []
    with book.open(target if target in files else f"xl/{target}") as member:
        for _, e in ElementTree.iterparse(member):
            if local(e) != "row":
                continue
            for c in (x for x in e if local(x) == "c"):
                letters, number = re.fullmatch(r"([A-Z]+)(\d+)", c.get("r")).groups()
                value = next((x.text for x in c if local(x) == "v"), None)
                if c.get("t") == "s" and value is not None:
                    value = shared[int(value)]
                elif c.get("t") == "inlineStr":
                    value = next((words(x) for x in c if local(x) == "is"), None)
                if value is not None:
                    yield int(number), functools.reduce(lambda n, x: n * 26 + ord(x) - 64, letters, 0) - 1, value
            e.clear()


def table_below(cells: DataFrame, header: dict[str, str], first_rows: int = 8) -> DataFrame:
    """Rows under the heading that one of the first rows holds; header: our name -> pattern of the heading, blanks and dashes taken out.

    The heading row is the first that holds the first two names; other columns that are missing are null.
    """
    clean = F.regexp_replace(F.replace(F.upper("value"), F.lit("&"), F.lit("AND")), r"[\s-]", "")
    name = F.lit(None).cast("string")
    for ours, pattern in reversed(header.items()):
        name = F.when(clean.rlike(pattern), ours).otherwise(name)
    heads = cells.where(F.col("row") <= first_rows).withColumn("name", name).where("name is not null")
    need = list(header)[:2]
    at = heads.where(F.col("name").isin(need)).groupBy("row").agg(F.count_distinct("name").alias("n")).where(F.col("n") == len(need)).agg(F.min("row").alias("head"))
    columns = heads.join(F.broadcast(at), F.col("row") == F.col("head")).groupBy("col").agg(F.min("name").alias("name"), F.first("head").alias("head"))  # one row; a few columns
    named = cells.join(F.broadcast(columns), "col").where(F.col("row") > F.col("head"))
    return named.groupBy("row").pivot("name", list(header)).agg(F.first("value"))


def whole_text(spark: SparkSession, path: str) -> DataFrame:
    """A row for each file: path, value."""
    if not exists(spark, path):
        return spark.createDataFrame([], "path string, value string")
    return spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")


def world_bank_rows(texts: DataFrame) -> DataFrame:
    """indicator, iso3, country, year, value, ord of [page, rows] documents; unknown values are kept as null."""
    row = "array<struct<indicator:struct<id:string>, country:struct<value:string>, countryiso3code:string, date:string, value:double>>"
    body = F.get(F.from_json("value", "array<string>"), F.lit(1))
    flat = texts.select(F.posexplode(F.from_json(body, row)).alias("ord", "r"))
    return flat.select(F.col("r.indicator.id").alias("indicator"), F.upper(F.trim("r.countryiso3code")).alias("iso3"), F.col("r.country.value").alias("country"), F.col("r.date").try_cast("int").alias("year"), "r.value", "ord").where("iso3 <> ''")


def json_stat_cells(texts: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """cells(pos, value), rows(row, row_pos, label), columns(col, col_pos) of a cube of geo by time."""
    axis = "struct<category:struct<index:map<string,int>, label:map<string,string>>>"
    doc = texts.select(F.from_json("value", f"struct<dimension:struct<geo:{axis}, time:{axis}>, value:map<string,double>>").alias("d"))
    cells = doc.select(F.explode("d.value").alias("pos", "value")).select(F.col("pos").cast("int").alias("pos"), "value")
    geo = doc.select(F.explode("d.dimension.geo.category.index").alias("row", "row_pos"), F.col("d.dimension.geo.category.label").alias("labels"))
    rows = geo.select("row", "row_pos", F.try_element_at("labels", F.col("row")).alias("label"))
    return cells, rows, doc.select(F.explode("d.dimension.time.category.index").alias("col", "col_pos"))


def _is(kind: str, v: Column | str) -> Column:
    """Whether a variant is of a kind, by its own type: ARRAY, OBJECT, STRING; false for none."""
    return F.coalesce(F.schema_of_variant(v).startswith(kind), F.lit(False))


def feature_properties(texts: DataFrame) -> DataFrame:
    """key, props, geometry: the properties and geometry of each feature, as variants, whichever way they are wrapped; each text is parsed once.

    A list of features stands under body.features, features or at the top; or the document is a map by iso3, which is the key then (else null).
    Properties may be an object, a text that holds one, or the feature itself. What is no object goes.
    """
    at = F.try_variant_get
    some = lambda v: v.isNotNull() & ~F.is_variant_null(v)
    doc = texts.select(F.try_parse_json("value").alias("doc"))
    listed = F.filter(F.coalesce(*(at("doc", p, "array<variant>") for p in ("$.body.features", "$.features", "$"))), some)

    def feature(f: Column) -> Column:
        own = F.when(some(at(f, "$.properties", "variant")), at(f, "$.properties", "variant")).otherwise(f)
        props = F.when(_is("STRING", own), F.try_parse_json(at(own, "$", "string"))).otherwise(own)
        return F.struct(F.lit(None).cast("string").alias("key"), props.alias("props"), at(f, "$.geometry", "variant").alias("geometry"))

    keyed = F.transform(F.map_entries(at("doc", "$", "map<string,variant>")), lambda e: F.struct(e["key"].alias("key"), e["value"].alias("props"), F.lit(None).cast("variant").alias("geometry")))
    keyed = F.filter(keyed, lambda e: country_key(e["key"]).isNotNull())
    # All of a text is told in one expression and an outer explode: a condition on what was parsed would be pushed below the parsing, and parse again.
    found = doc.select(F.explode_outer(F.when(F.size(listed) > 0, F.transform(listed, feature)).otherwise(keyed)).alias("f"))
    return found.select("f.*").where(_is("OBJECT", "props"))


def polygons(geometry: Column | str) -> Column:
    """array<polygon>, each of rings of points [lon, lat], of a Polygon or MultiPolygon; null for other geometries."""
    at = F.try_variant_get
    kind, ring = at(geometry, "$.type", "string"), "array<array<array<double>>>"
    one = at(geometry, "$.coordinates", ring)
    return F.when(kind == "MultiPolygon", at(geometry, "$.coordinates", f"array<{ring}>")).when((kind == "Polygon") & one.isNotNull(), F.array(one))


def year_mean(texts: DataFrame, value: str = "value") -> DataFrame:
    """texts with mean: the mean over years of a response in any of five shapes: years to values, by country, wrapped in data, records, one value.

    The text is parsed once; each shape is a path of what came of it.
    """
    at = F.try_variant_get
    number = lambda v: at(v, "$", "string").try_cast("double")
    parsed = texts.withColumn("doc__", F.try_parse_json(value)).withColumn("data__", at("doc__", "$.data", "variant"))
    parsed = parsed.withColumn("in__", F.when(F.col("data__").isNull() | F.is_variant_null("data__"), F.col("doc__")).otherwise(F.col("data__")))
    parsed = parsed.withColumns({"list__": at("in__", "$", "array<variant>"), "map__": at("in__", "$", "map<string,variant>")})
    parsed = parsed.withColumn("only__", F.when(F.size("map__") == 1, F.map_values("map__")[0]))
    parsed = parsed.withColumn("years__", F.coalesce(at("only__", "$", "map<string,variant>"), F.col("map__")))
    records = F.transform("list__", lambda r: F.coalesce(*(at(r, f"$.{k}", "string").try_cast("double") for k in ("value", "val", "mean"))))
    listed = F.transform(F.filter(F.map_entries("years__"), lambda e: e["key"].rlike(r"^\d{4}")), lambda e: number(e["value"]))
    single = F.coalesce(number(F.try_element_at("years__", F.lit("value"))), number(F.col("only__")))
    known = F.filter(F.coalesce(records, listed), lambda x: x.isNotNull())
    mean = F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda a, x: a + x) / F.size(known))
    out = parsed.withColumn("mean", F.coalesce(F.when(F.col("list__").isNull(), single), mean))
    return out.drop("doc__", "data__", "in__", "list__", "map__", "only__", "years__")


def fields(texts: DataFrame, value: str = "value", name: str = "key", out: str = "field") -> DataFrame:
    """texts with a row for each field of a JSON object: its name and its value as a variant; texts that hold no object give no row."""
    doc = texts.withColumn("doc__", F.try_parse_json(value))
    return doc.select(*texts.columns, F.explode_outer(F.try_variant_get("doc__", "$", "map<string,variant>")).alias(name, out)).where(F.col(name).isNotNull())


_JS = re.compile(r"""(?P<text>"(?:[^"\\]|\\.)*"|'(?:[^'\\]|\\.)*'|`(?:[^`\\]|\\.)*`)|(?P<skip>//[^\n]*|/\*.*?\*/|\s+)|(?P<name>[A-Za-z_$][\w$]*)|(?P<number>-?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?)|(?P<mark>.)""", re.DOTALL)
_ESCAPE = re.compile(r"\\(u[0-9a-fA-F]{4}|x[0-9a-fA-F]{2}|\n|.)", re.DOTALL)
_ESCAPED = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f", "\n": ""}


def object_literals(code: str, first: str) -> list[str]:
    """The object literals of a script whose first key is so called, as JSON; strings, escapes, comments and nesting are told apart by their tokens."""
    tokens = [(m.lastgroup, m.group()) for m in _JS.finditer(code) if m.lastgroup != "skip"]
    unescaped = lambda t: _ESCAPE.sub(lambda m: chr(int(m[1][1:], 16)) if len(m[1]) > 1 else _ESCAPED.get(m[1], m[1]), t[1:-1])
    found: list[str] = []
    out: list[str] = []
    depth = 0  # of brackets since the literal began; 0: outside of one
    for k, (kind, t) in enumerate(tokens):
        if not depth:
            begins = t == "{" and k + 2 < len(tokens) and tokens[k + 1][1].strip("\"'") == first and tokens[k + 2][1] == ":"
            out, depth = (["{"], 1) if begins else ([], 0)
            continue
        if kind == "text":
            out.append(json.dumps(unescaped(t)))
        elif kind == "number":
            out.append(json.dumps(float(t)))
        elif kind == "name":
            key = k + 1 < len(tokens) and tokens[k + 1][1] == ":"
            out.append(json.dumps(t) if key else t if t in ("true", "false", "null") else "null")
        else:
            depth += (t in "{[") - (t in "}]")
            if t in "}]" and out[-1] == ",":
                out.pop()
            out.append(t)
            if not depth:
                found.append("".join(out))
    return found


RECORD = "iso string, name string, region string, fdrs double, f2030 double, w double, r double, m double, net double, fi double, c array<double>, supPct array<double>, imports array<string>, exports array<string>, exportDests array<string>, suppliers array<string>"


def js_records(texts: DataFrame) -> DataFrame:
    """A row for each country of a dashboard's object literals, with the columns of RECORD; lists that are missing are empty, records without iso go.

    A script is one text, told apart by its tokens; what comes of it is parsed by Spark.
    """

    @F.pandas_udf("array<string>")
    def literals(code: pd.Series) -> pd.Series:
        return code.map(lambda c: object_literals(c or "", "iso"))

    rows = texts.select(F.explode(literals("value")).alias("b")).select(F.from_json("b", RECORD).alias("v")).select("v.*")
    lists = {c: F.coalesce(c, F.array().cast(kind)) for c, kind in rows.dtypes if kind.startswith("array")}
    return rows.withColumns(lists).where("iso is not null")


def company_documents(spark: SparkSession, folder: str) -> DataFrame:
    """The company files of a folder, with their names as file, by which "first" is told; names that begin with an underscore and files that can't be read are passed over."""
    from tillage.operators.companies import DOCUMENT

    found = spark.read.schema(f"{DOCUMENT}, _corrupt_record string").option("multiLine", True).option("pathGlobFilter", "[!_]*.json").json(folder)
    return found.withColumn("file", F.col("_metadata.file_name")).where("_meta is not null").drop("_corrupt_record")


def attempts(get: Callable[[], object], tries: int = 3, backoff: float = 2.0, patient: bool = False, sleep: Callable[[float], None] = time.sleep) -> object:
    """What get() returns, tried again after growing waits (backoff ** k seconds, or 15, 30, 60 and 120 with at least five tries); the last failure is raised."""
    tries = max(tries, 5) if patient else tries
    for k in range(tries):
        try:
            return get()
        except OSError:
            if k == tries - 1:
                raise
            sleep((15, 30, 60, 120)[min(k, 3)] if patient else backoff**k)
    return None


def pages(get: Callable[[int], list], size: int, most: int) -> Iterator[list]:
    """Pages 1, 2, ... until one is short or empty, or there are `most`; a page that fails is passed over."""
    for k in range(1, most + 1):
        try:
            rows = get(k)
        except OSError:
            continue
        if rows:
            yield rows
        if len(rows) < size:
            return


def offset_pages(get: Callable[[int, int], list], total: Callable[[], int], size: int = 1000) -> Iterator[list]:
    """Pages of so many rows, from offset 0 to the total that is asked for first; a page that fails or is empty is passed over."""
    for offset in range(0, total(), size):
        try:
            rows = get(offset, size)
        except OSError:
            continue
        if rows:
            yield rows


def first_large(bodies: list[tuple[str, str]], least: int) -> tuple[str, str] | None:
    """The first (url, body) of some candidates whose body has so many characters."""
    return next(((u, b) for u, b in bodies if b and len(b) >= least), None)
