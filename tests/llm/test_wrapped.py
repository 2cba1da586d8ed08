"""Licence notices that are wrapped over lines."""

from marlstone.llm import licenses

WRAPPED = [
    ("mit", "The above copyright notice and this permission notice shall be included in\nall copies or substantial portions of the Software."),
    ("bsd", "Copyright 2020 A\nRedistribution and use in source and binary forms, with or without\nmodification, are permitted provided that the following conditions are\nmet:\n\n1. Keep this."),
    ("gpl", " * This program is free software: you can redistribute it and/or modify\n * it under the terms of the GNU General Public License as published by\n * the Free Software Foundation, either version 3 of the License, or\n * (at your option) any later version."),
    ("apache-2.0", "Text.\nLicensed under the Apache License,\nVersion 2.0."),
]


def scan(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return {r.doc_id: r for r in licenses.license_scan(df).collect()}


def test_wrapped_notices(spark):
    got = scan(spark, [t for _, t in WRAPPED])
    assert [(got[i].n_notices, got[i].licenses) for i in range(len(WRAPPED))] == [(1, x) for x, _ in WRAPPED]
    assert [got[i].dice for i in (0, 3)] == [1.0, 1.0] and got[1].dice == 1.0


def test_lines_and_runs_do_not_count_twice(spark):
    texts = [
        "Licensed under the MIT License\nsee the file\nLicensed under the MIT\nLicense\nAll rights\nreserved",
        "Licensed under the MIT License\nLicensed under the MIT License",
        "\n".join(["All rights", "reserved"] * 500),
        "\n".join(["some line of a text without a stop"] * 300),
        "All rights reserved " * 40,
    ]
    got = scan(spark, texts)
    assert (got[0].n_notices, got[0].licenses) == (3, "mit,proprietary") and (got[1].n_notices, got[1].dice) == (1, 1.0)
    assert got[2].licenses == "proprietary" and got[3].n_notices == 0 and (got[4].n_notices, got[4].licenses) == (1, "proprietary")


def test_equal_rows_count_once(spark):
    df = spark.createDataFrame([(1, "Licensed under\nthe MIT License. Licensed under the Apache terms")] * 3, "doc_id long, text string")
    assert [(r.n_notices, r.dice, r.licenses) for r in licenses.license_scan(df).collect()] == [(1, 1.0, "mit")] * 3


def test_licence_texts(spark):
    """A whole licence, wrapped; one with another beginning; a paragraph between others; too little of one."""
    import textwrap

    name, text = licenses.TEXTS[0]
    parts = text.split("\n\n")
    wrapped = "\n\n".join(textwrap.fill(x, 60) for x in parts)
    rows = [wrapped, "Copyright 2020 A Person\n\n" + wrapped, "def f(): pass\n\n" + textwrap.fill(parts[2], 50) + "\n\nmore code", " ".join(parts[2].split()[:20])]
    got = scan(spark, rows)
    assert [got[i].text_license for i in range(4)] == [name, name, name, None] and got[0].text_dice == got[2].text_dice == 1.0


def test_repeated_sentence_agrees_with_sql(spark):
    import duckdb
    import pandas as pd

    documents = pd.DataFrame({"doc_id": range(3), "text": ["All rights reserved " * 60, "All rights reserved " * 20, licenses.TEXTS[1][1]]})
    theirs = {r[0]: r for r in duckdb.sql(licenses.OP10_SQL).fetchall()}
    for i, r in scan(spark, documents["text"].tolist()).items():
        assert tuple(r) == theirs[i], i
