from pathlib import Path

import duckdb
import pytest

from tessera.llm.licence_scan import scan_licences, scan_sql
from tessera.llm.licence_texts import LICENCES

SCHEMA = "doc_id long, text string, license_id string, line int"


def test_whole_texts_and_lines(spark):
    mit = dict(reversed(LICENCES))["MIT"]
    changed = "Copyright (c) 2019 Somebody\n" + mit.upper().replace("LICENSE", "LICENCE").replace(",", " ,") + "\n\n© 2020 all"
    rows = [
        (1, mit, "x", 1), (2, changed, "x", 1), (3, mit + " and more", "x", 1), (4, "Text.\n  released under the MIT licence!\nmore", "x", 1),
        (5, None, "x", 1), (6, "", "x", 1), (7, "...\n--", "x", 1), (4, "Text.\n  released under the MIT licence!\nmore", "x", 1), (None, "Licensed under CC BY 4.0.", "x", 1), (8, "word " * 200000, "x", 1),
    ]
    got = sorted(((r.doc_id or -1), r.scope, r.line, r.license_id) for r in scan_licences(spark.createDataFrame(rows, SCHEMA)).collect())
    assert got == [(-1, "document", -1, "CC-BY-4.0"), (-1, "line", 0, "CC-BY-4.0"), (1, "document", -1, "MIT"), (2, "document", -1, "MIT"), (4, "line", 1, "MIT"), (4, "line", 1, "MIT")]
    assert scan_licences(spark.createDataFrame([], SCHEMA)).collect() == []
    assert scan_licences(spark.createDataFrame(rows, SCHEMA), known=[]).collect() == []
    mine = scan_licences(spark.createDataFrame(rows, SCHEMA), known=[("ours", "Text."), ("later", "text")]).collect()
    assert {(r.doc_id, r.line, r.license_id) for r in mine} == {(4, 0, "later")}


#: Where Debian keeps the long licences: (file, identifier).
FOLDER = Path("/usr/share/common-licenses")
LONG = [("Apache-2.0", "Apache-2.0"), ("GPL-2", "GPL-2.0"), ("GPL-3", "GPL-3.0"), ("LGPL-2.1", "LGPL-2.1"), ("LGPL-3", "LGPL-3.0"), ("MPL-2.0", "MPL-2.0"), ("CC0-1.0", "CC0-1.0"), ("GFDL-1.3", "GFDL-1.3")]


@pytest.mark.skipif(not FOLDER.is_dir(), reason="no licence texts on this machine")
def test_long_licences(spark):
    """Whole texts, also in capitals, with other copyright lines and without the appendix; a text that lacks a word is none."""
    rows, wanted = [], set()
    for n, (name, licence) in enumerate(LONG):
        text = (FOLDER / name).read_text()
        changed = "Copyright 2024 Somebody\n\n" + text.upper().replace("\n\n", "\n \n\n")
        end = text.find("END OF TERMS AND CONDITIONS")
        for k, version in enumerate((text, changed, text[:end] if end > 0 else text, text.replace("the", "", 1))):
            rows.append((n * 4 + k, version, "x", 1))
            if k < 3:
                wanted.add((n * 4 + k, licence))
    df = spark.createDataFrame(rows, SCHEMA)
    got = {(r.doc_id, r.license_id) for r in scan_licences(df).where("scope = 'document'").collect()}
    assert got == wanted
    c = duckdb.connect()
    c.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR)")
    c.executemany("INSERT INTO documents VALUES (?, ?)", [r[:2] for r in rows])
    assert {(r[0], r[3]) for r in c.execute(scan_sql()).fetchall() if r[1] == "document"} == wanted
