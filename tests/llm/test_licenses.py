import re

import pytest
from pyspark.sql import functions as F

from tessella.llm import licenses, queries
from tests.llm.conftest import larger

DOCS = "doc_id long, text string, paragraph string, w int"
PLANTED = {
    "This work is licensed under the GNU General Public License, version 3.": "gpl",
    "Licensed under CC BY-NC 4.0.": "cc-by-nc",
    "Released under the MIT License.": "mit",
    "Licensed under the Apache License, Version 2.0.": "apache-2.0",
}


#: As written in the wild; nothing of it is trained or calibrated on.
HELD_OUT = [
    ("You are free to use this module under the terms of the MIT License.", "mit"), ("Copyright (c) 2021 Some Author. MIT License.", "mit"),
    ("All files in this folder are licensed under the Apache License, Version 2.0 unless stated otherwise.", "apache-2.0"),
    ("Unless required by applicable law or agreed to in writing, software distributed under the License is distributed on an \"AS IS\" BASIS", "apache-2.0"),
    ("This library is distributed under the BSD 3-Clause License.", "bsd"),
    ("Neither the name of the University nor the names of its contributors may be used to endorse or promote products derived from this software", "bsd"),
    ("The kernel is licensed under the GNU General Public License v2.", "gpl"), ("along with this program; you should have received a copy of the GNU General Public License", "gpl"),
    ("This wrapper is free software; you can redistribute it under the terms of the GNU Lesser General Public License as published by the Free Software Foundation", "lgpl"),
    ("The service is licensed under the GNU Affero General Public License.", "agpl"), ("The add-on is subject to the terms of the Mozilla Public License, v. 2.0.", "mpl-2.0"),
    ("Content on this site is licensed under a Creative Commons Attribution 4.0 International License.", "cc-by"),
    ("The course notes are licensed under a Creative Commons Attribution-ShareAlike 4.0 International License.", "cc-by-sa"),
    ("Slides licensed under CC BY-NC 4.0.", "cc-by-nc"), ("The dataset is released under the CC0 1.0 Universal Public Domain Dedication", "cc0"),
    ("Copyright 1998 Example Press. All rights reserved.", "reserved"), ("Licensed under the Eclipse Public License v2.0", "unknown"), ("SPDX-License-Identifier: ISC", "unknown"),
    ("Boost Software License, Version 1.0", "unknown"), ("The software is provided as is", "unknown"), ("SPDX-License-Identifier: BSL-1.0", "unknown"),
    ("Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted", "unknown"),
    ("Distributed under the IBM Public License.", "unknown"), ("Licensed under the Sleepycat License.", "unknown"), ("She renewed her driving licence last week.", "none"),
    ("The public library is free for all residents of the city.", "none"), ("Version 3 of the timetable was published in May.", "none"), ("The bank granted permission to sell the house.", "none"),
    ("Copies of the report were handed to the members.", "none"), ("No part of the wall was left standing after the storm.", "none"), ("The rights of the child are the subject of the convention.", "none"),
    ("They distribute bread and water in the morning.", "none"), ("The work of the foundation is open to anyone.", "none"), ("The source of the river was found in 1862.", "none"),
]
WRAPPED = {
    "mit": """Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software, and to permit persons to whom the Software is
furnished to do so, subject to the following conditions:""",
    "gpl": """This program is free software: you can redistribute it and/or modify
it under the terms of the GNU General Public License as published by
the Free Software Foundation, either version 3 of the License, or
(at your option) any later version.""",
    "bsd": """Redistribution and use in source and binary forms, with or without
modification, are permitted provided that the following conditions
are met:""",
    "apache-2.0": """Licensed under the Apache License, Version 2.0 (the "License");
you may not use this file except in compliance with the License.""",
    "unknown": """Permission to use, copy, modify, and/or distribute this software for any
purpose with or without fee is hereby granted, provided that the above
copyright notice and this permission notice appear in all copies.""",
}


def plain(docs):
    out = set()
    for i, text in docs:
        for k, part in enumerate(licenses.paragraphs(text or "")):
            found = licenses.classifier().judge(part)
            if found:
                out.add((i, k, found[0], found[1], round(found[2], 9), round(found[3], 9)))
    return out


def rounded(rows):
    return {(*tuple(r)[:4], round(r.probability, 9), round(r.share, 9)) for r in rows}


def family(text):
    return (licenses.classifier().judge(text) or ("none",))[0]


def test_held_out_accuracy():
    assert licenses.classifier().calibrated >= 0.95
    assert sum(family(t) == k for t, k in HELD_OUT) >= 0.9 * len(HELD_OUT)
    assert all(family(t) == "none" for t, k in HELD_OUT if k == "none")
    assert all(family(t) not in licenses.TEMPLATES for t, k in HELD_OUT if k in ("unknown", "none"))


@pytest.mark.parametrize("sign", ["", "# ", " * ", "// "])
def test_wrapped_notices(spark, sign):
    docs = [(k, f"A line before.\n\n{sign}" + t.replace("\n", f"\n{sign}") + "\n\nCode follows", "p", 1) for k, t in enumerate(WRAPPED.values())]
    got = licenses.findings(spark.createDataFrame(docs, DOCS)).collect()
    assert {(r.doc_id, r.family) for r in got} == set(enumerate(WRAPPED))
    assert rounded(got) == plain([d[:2] for d in docs])


def test_paragraphs(spark):
    texts = [
        "One.\nTwo\nthree!\n four: x\n\nfive", "\n\n \na\n \t\n\nb.*** \nc", "a.\n\nb", "...\n!!!\nx", "", "\n", "é.\né…\nz\r\n.\n", "x\x00.\ny" + "!" * 100_000 + "\n" + "*" * 100_000 + "z",
    ]
    docs = spark.createDataFrame([(k, t, "p", 1) for k, t in enumerate(texts)], DOCS)
    got = {r.doc_id: r.parts for r in docs.select("doc_id", licenses._paragraphs(F.split(F.translate("text", "\0", " "), "\n")).alias("parts")).collect()}
    assert [got[k] for k in range(len(texts))] == [licenses.paragraphs(t) for t in texts]
    assert got[0] == ["One.", "Two\nthree!", " four: x\n", "five"] and got[3] == ["...\n!!!\nx"]


def test_query_equals_brute_force_and_finds_what_is_planted(spark, sf):
    sf = larger(sf)
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf}/documents.parquet").collect()]
    got = queries.op3_licenses(spark, sf).collect()
    assert rounded(got) == plain(docs) and len(got) == len(rounded(got))
    # a planted notice is the last line, and the line before it ends a sentence in all but junk
    planted = {(i, PLANTED[x]) for i, t in docs for x in (t or "").split("\n") if x in PLANTED}
    found = {(r.doc_id, r.paragraph, r.family) for r in got}
    assert planted and planted <= {(i, f) for i, _, f in found}
    cue = re.compile(r"licen[cs]e|copyright|permission|rights", re.I)
    text = dict(docs)
    assert all(cue.search(licenses.paragraphs(text[i])[k]) for i, k, _ in found)  # clean text is left alone


@pytest.mark.parametrize("family", licenses.TEMPLATES)
def test_every_template_is_its_family(family):
    for notice in licenses.TEMPLATES[family]:
        assert licenses.classifier().judge(notice.upper())[0] == family
        assert licenses.classifier().judge("some words before " + notice + " and after it")[0] == family


def test_odd_rows(spark):
    mit = "Released under the MIT License."
    rows = [
        (1, None), (2, ""), (3, "\n\n"), (None, mit), (4, f"x\n{mit}\n{mit}"), (4, f"x\n{mit}\n{mit}"), (4, "Licensed under CC BY 4.0."),
        (5, "word " * 200_000 + mit), (6, "This is licensed under the Bar General Public License"), (7, "mit"), (8, "the license"),
    ]
    got = licenses.findings(spark.createDataFrame([(*r, "p", 1) for r in rows], DOCS)).collect()
    assert rounded(got) == plain(rows)
    assert len(got) == len(rounded(got)) + 2  # the repeated row's two notices
    assert {(r.doc_id, r.family) for r in got} >= {(None, "mit"), (4, "mit"), (4, "cc-by"), (5, "mit"), (6, "unknown")}
    assert licenses.findings(spark.createDataFrame([], DOCS)).collect() == []


def test_no_python_in_the_plan(spark, sf):
    plan = queries.op3_licenses(spark, sf)._jdf.queryExecution().toString()
    assert "Python" not in plan and "Arrow" not in plan and "BroadcastHashJoin" in plan


def test_short_reserved_notice(spark, sf):
    line = "All rights reserved."
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{larger(sf)}/documents.parquet").collect()]
    planted = {(i, "reserved") for i, t in docs for x in (t or "").split("\n") if x == line}
    assert planted and planted <= {(r.doc_id, r.family) for r in queries.op3_licenses(spark, larger(sf)).collect()}
    assert licenses.classifier().judge("All rights of way in the valley are marked on the map.") is None
