from __future__ import annotations

import re
from pathlib import Path

import duckdb
import pytest
from pyspark.sql import functions as F

from tillage.llm import licenses

MIT = dict(licenses.KNOWN)  # the last text of each name
TEXT = {name: text for name, text in reversed(licenses.KNOWN)}


def scanned(spark, documents, rows):
    return sorted(((r.doc_id, r.license, r.line_licenses) for r in licenses.scan(documents(rows), licenses.known_licenses(spark)).collect()), key=str)


def test_whole_texts_in_other_guises(spark, documents):
    mit = TEXT["MIT"]
    rows = [
        (1, mit), (2, mit.upper()), (3, "Copyright (c) 2020 Jane\n\n" + mit), (4, re.sub(r"[,.]", " ; ", mit)), (5, mit.replace(" ", "\n  ")), (6, mit.replace("sublicense", "sub-license").replace("whether", "wether").replace("WHETHER", "wether")),
        (7, mit + " and more"), (8, mit[:-40]), (9, TEXT["0BSD"]), (10, TEXT["ISC"]), (11, "(c) 1999-2004 me\nAll rights reserved.\n" + TEXT["Zlib"]),
    ]
    out = {d: name for d, name, _ in scanned(spark, documents, rows)}
    assert out == {1: "MIT", 2: "MIT", 3: "MIT", 4: "MIT", 5: "MIT", 6: "MIT", 7: None, 8: None, 9: "0BSD", 10: "ISC", 11: "Zlib"}


def test_lines_that_state_a_licence(spark, documents):
    rows = [(1, "Some prose here.\nReleased under the MIT licence\nmore"), (2, "Licensed under CC BY 4.0.\nLicenced under the Apache License, version 2.0"), (3, "It is released under the MIT License.")]
    assert scanned(spark, documents, rows) == [(1, None, "MIT"), (2, None, "Apache-2.0,CC-BY-4.0"), (3, None, None)]


def test_defined_cases(spark, documents):
    rows = [(1, None), (2, ""), (3, " .,; \n"), (None, TEXT["ISC"]), (4, TEXT["ISC"]), (4, TEXT["ISC"]), (5, "w " * 100_000)]
    out = scanned(spark, documents, rows)
    assert out == sorted([(1, None, None), (2, None, None), (3, None, None), (None, "ISC", "ISC"), (4, "ISC", "ISC"), (4, "ISC", "ISC"), (5, None, None)], key=str)
    assert scanned(spark, documents, []) == []


def test_empty_digest_and_unknown_table(spark, documents):
    none = spark.createDataFrame([], "license string, text string")
    out = licenses.scan(documents([(1, None), (2, "MIT")]), none).collect()
    assert {(r.license, r.line_licenses) for r in out} == {(None, None)}
    assert {r.doc_id: r.digest for r in out}[1] == spark.range(1).select(F.sha2(F.lit(""), 256)).first()[0]


def test_spellings_are_of_whole_words(spark, documents):
    texts = ["The licence of the programme programme, sub-licence it", "the license of the program program sublicense it", "a programmer's favourite licencee", "a programr s favorite licensee"]
    found = [r[0] for r in documents(list(enumerate(texts))).orderBy("doc_id").select(licenses.canonical("text")).collect()]
    assert found[0] == found[1] and found[2] == "a programmer s favourite licencee" and found[3] == "a programr s favorite licensee"


def test_every_known_text_is_found_and_texts_of_a_folder_too(spark, documents, tmp_path):
    (tmp_path / "Own-1.0.txt").write_text("Anyone may use it.\n\nNobody is liable, whilst they do.")
    known = licenses.known_licenses(spark).union(licenses.licenses_of(spark, str(tmp_path)))
    rows = [(k, f"Copyright (c) 20{k:02d} Somebody\n\n{t.lower()}") for k, (_, t) in enumerate(licenses.KNOWN)] + [(100, "ANYONE may use it. Nobody is liable, while they do")]
    out = {r.doc_id: r.license for r in licenses.scan(documents(rows), known).collect()}
    assert all(out[k] == name for k, (name, _) in enumerate(licenses.KNOWN)) and out[100] == "Own-1.0"


#: Where Debian keeps whole texts, and what they are called there.
COMMON = Path("/usr/share/common-licenses")
FILES = {"Apache-2.0": "Apache-2.0", "Artistic-1.0-Perl": "Artistic", "CC0-1.0": "CC0-1.0", "GFDL-1.2": "GFDL-1.2", "GFDL-1.3": "GFDL-1.3", "GPL-1.0": "GPL-1", "GPL-2.0": "GPL-2", "GPL-3.0": "GPL-3", "LGPL-2.0": "LGPL-2", "LGPL-2.1": "LGPL-2.1", "LGPL-3.0": "LGPL-3", "MPL-1.1": "MPL-1.1", "MPL-2.0": "MPL-2.0"}


@pytest.mark.skipif(not COMMON.is_dir(), reason="no whole texts here")
def test_digests_are_those_of_the_published_texts(spark, documents, tmp_path):
    end, rows, names = "END OF TERMS AND CONDITIONS", [], []
    for name, file in FILES.items():
        text = (COMMON / file).read_text(encoding="utf-8")
        guises = [text, text.upper(), "Copyright 2021 Somebody\n\n" + re.sub(r"[,;]", " ", text), re.sub(r"\blicense\b", "licence", text).replace("\n", "\r\n")]
        if end in text:
            guises.append(text[: text.index(end)] + end)
        rows += [(len(rows) + k, g) for k, g in enumerate(guises)]
        names += [name] * len(guises)
        rows.append((len(rows), text[:-200]))
        names.append(None)
    docs = documents(rows)
    out = {r.doc_id: r for r in licenses.scan(docs, licenses.known_licenses(spark), licenses.known_digests(spark)).collect()}
    assert [out[k].license for k in range(len(rows))] == names
    assert {r.digest for r in out.values()} >= {d for _, d in licenses.DIGESTS} and {n for n, _ in licenses.DIGESTS} == set(FILES)
    docs.write.parquet(str(tmp_path / "documents"))
    con = duckdb.connect()
    con.execute(f"create view documents as select * from '{tmp_path}/documents/*.parquet'")
    assert sorted(con.execute(licenses.oracle()).fetchall()) == sorted((r.doc_id, r.digest, r.license, r.line_licenses) for r in out.values())


def test_a_listed_digest_and_a_known_text_of_one_name_or_two(spark, documents):
    listed = documents([(1, "Own terms, whole.")]).select(F.lit("Own-2.0").alias("license"), F.sha2(licenses.canonical("text"), 256).alias("digest"))
    known = spark.createDataFrame([("Own-9.0", "own terms whole")], "license string, text string")
    rows = [(1, "OWN TERMS\nwhole"), (2, "Own terms"), (3, None)]
    assert sorted((r.doc_id, r.license, r.line_licenses) for r in licenses.scan(documents(rows), known, listed).collect()) == [(1, "Own-2.0", None), (2, None, None), (3, None, None)]
