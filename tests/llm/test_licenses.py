import duckdb

from treelake.llm import licenses, queries

MIT = licenses.KNOWN["MIT"]
ROWS = [
    (1, MIT), (2, "Copyright (c) 2020 X\n(c) Y\n\n" + MIT.upper().replace(" ", "  \n")), (3, MIT + " and more"), (4, None), (5, ""), (6, " .,;\n"),
    (7, licenses.KNOWN["Zlib"].replace("acknowledgment", "acknowledgement")), (8, "licence licence LICENSE"), (9, "license license license"),
    (10, "Licensed under the Apache License, Version 2.0."), (11, "é É – x"), (12, MIT.replace('"Software"', "“Software”")), (None, MIT),
]


def test_forms_and_matches(spark):
    docs = spark.createDataFrame([(*r, "old", 3) for r in ROWS], "doc_id long, text string, license string, form int")
    got = {r.doc_id: r for r in licenses.scan(docs, licenses.known_licenses(spark)).collect()}
    assert {i: r.license for i, r in got.items() if r.license} == {1: "MIT", 2: "MIT", 7: "Zlib", 10: "Apache-2.0-line", 12: "MIT", None: "MIT"}
    assert got[8].digest == got[9].digest and {got[i].canonical_chars for i in (4, 5, 6)} == {0}
    assert licenses.scan(docs.limit(0), licenses.known_licenses(spark)).collect() == []


def test_equals_duckdb(spark, tmp_path):
    spark.createDataFrame(ROWS, "doc_id long, text string").coalesce(1).write.parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.sql(f"create view documents as select * from read_parquet('{tmp_path}/documents.parquet/*.parquet')")
    expected = con.sql(queries.ORACLE_SQL["op10_license_scan"])
    got = queries.queries()["op10_license_scan"](spark, str(tmp_path))
    assert sorted(map(str, map(tuple, got.collect()))) == sorted(map(str, expected.fetchall()))
