import duckdb

from twinsieve.llm import licences
from twinsieve.llm.licence_texts import KNOWN, MIT


def found(docs, rows):
    return sorted(((r.doc_id, r.licence, r.notices, r.n_notice_lines) for r in licences.scan_known(docs(rows)).collect()), key=str)


def test_equivalent_texts(docs):
    wrapped = "\r\n".join(f" * {w}" for w in MIT.split("\n"))
    rows = [
        (1, MIT), (2, "Copyright (c) 2024 A. Holder\nAll rights reserved.\n\n" + MIT.upper()), (3, "© 1999-2001 X\n" + wrapped), (4, MIT.replace('"', "'").replace("License", "Licence")),
        (5, MIT + " and one more word"), (6, MIT.replace("NONINFRINGEMENT", "NON-INFRINGEMENT")), (7, None), (8, ""), (9, "!!!"), (9, "!!!"), (None, MIT),
        (10, MIT.replace("The above copyright notice", "The above")),
    ]
    got = {}
    for d, licence, _, _ in found(docs, rows):
        got.setdefault(d, []).append(licence)
    assert {d for d, x in got.items() if x == ["MIT"]} == {1, 2, 3, 4, 6, None}
    assert got[5] == got[7] == got[8] == got[10] == [None] and got[9] == [None, None]


def test_every_known_text_is_found(docs):
    rows = [(i, f"Copyright {2000 + i} Someone\n{text}") for i, (_, text) in enumerate(KNOWN)]
    assert [r[1] for r in sorted(found(docs, rows))] == [name for name, _ in KNOWN]


def test_notices_in_lines(docs):
    rows = [(1, "Some prose.\nLicensed under CC BY-NC 4.0.\nmore\n  released under the MIT licence\n"), (2, "x Licensed under CC BY-NC 4.0."), (1, "Other")]
    got = {(r.doc_id, r.notices): r.n_notice_lines for r in licences.scan_known(docs(rows)).collect()}
    assert got == {(1, "CC-BY-NC-4.0,MIT"): 2, (2, None): 0, (1, None): 0}


def test_own_known_texts(spark, docs):
    known = spark.createDataFrame([("B", "Some Text"), ("A", "some text."), ("C", None)], "licence string, text string")
    assert [r.licence for r in licences.scan(docs([(1, "SOME  text!")]), known).collect()] == ["A"]
    assert licences.scan(docs([]), known).collect() == []


def test_sql(spark, docs, sf):
    documents = spark.read.parquet(f"{sf}/documents.parquet").toPandas()
    documents.loc[3, "text"] = MIT
    documents.loc[4, "text"] = "Copyright (C) 1\ncopyright notice stays\n(c) x\nall rights reserved\nLicensed under CC BY-NC 4.0.\r\rend"
    con = duckdb.connect()
    con.register("documents", documents)
    columns = ["doc_id", "text_sha256", "licence", "notices", "n_notice_lines"]
    got = licences.scan_known(spark.createDataFrame(documents)).select(columns).collect()
    want = con.sql(f"SELECT {', '.join(columns)} FROM ({licences.scan_sql()})").fetchall()
    assert sorted(map(tuple, got), key=str) == sorted(want, key=str) and sum(r.licence == "MIT" for r in got) == 1
