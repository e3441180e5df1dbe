"""Licence files as they are commonly distributed."""

from treelake.llm import licenses


def test_files_titles_and_plain_notices(spark):
    files = {f.stem: f.read_text() for f in licenses.TEXTS.glob("*.txt")}
    assert len(files) == 16
    mit = licenses.KNOWN["MIT"]
    wrapped = mit.replace("COPYRIGHT HOLDERS", "\nCOPYRIGHT HOLDERS").replace("The above copyright", "The above\ncopyright")
    cases = [(text, name) for name, text in files.items()]
    cases += [
        (f"MIT License\n\nCopyright (c) 2020 Jane Doe\n\n{mit}\n", "MIT"), (f"The MIT License (MIT)\n\nCopyright Jane Doe\n\n{wrapped}", "MIT"), (f"Copyright Jane Doe\nCopyright John Roe\n\n{mit}", "MIT"),
        (f"MIT License\r\n\r\nCopyright Jane Doe\r\n\r\n{mit}", "MIT"), (f"BSD 3-Clause License\n\nCopyright 2020, X\nAll rights reserved.\n\n{files['BSD-3-Clause']}", "BSD-3-Clause"),
        (f"BSD 2-Clause License\n\nCopyright X contributors\nAll rights reserved.\n\n{licenses.KNOWN['BSD-2-Clause']}", "BSD-2-Clause"), (f"{files['Unlicense']}\nFor more information, please refer to <https://unlicense.org>", "Unlicense"),
        (files["Apache-2.0"].split("APPENDIX:")[0], "Apache-2.0"), (f"{mit}\n\nCopyright law is a field.\n\nMore prose.", None), ("Copyright Jane Doe\n\n", None), (files["GPL-3.0"][:-9000], None), (None, None),
    ]
    docs = spark.createDataFrame([(i, t) for i, (t, _) in enumerate(cases)], "doc_id long, text string")
    got = {r.doc_id: r.license for r in licenses.scan(docs, licenses.known_licenses(spark)).collect()}
    assert [(i, got[i], name) for i, (_, name) in enumerate(cases) if got[i] != name] == []
