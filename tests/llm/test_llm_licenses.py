"""Licence scans against a plain search."""

import re

import pytest

from seekgrain.llm import licenses
from seekgrain.llm.queries import ORACLES, QUERIES

FOLDER = "/root/testdata/sf0.001"
WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    "documentation files (the \"Software\"), to deal in the Software without restriction, including without limitation the "
    "rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software, and to permit "
    "persons to whom the Software is furnished to do so, subject to the following conditions: The above copyright notice and "
    "this permission notice shall be included in all copies or substantial portions of the Software. THE SOFTWARE IS PROVIDED "
    "\"AS IS\", WITHOUT WARRANTY OF ANY KIND, EXPRESS OR IMPLIED"
)


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")


def plain(text):
    """(words, {(template, phrase): starts})"""
    words = WORDS.findall(lower_ascii(text))
    found = {}
    for t, template in enumerate(licenses.TEMPLATES):
        for p, (_, phrase) in enumerate(template.phrases):
            wanted = phrase.split()
            found[t, p] = [i for i in range(len(words) - len(wanted) + 1) if words[i : i + len(wanted)] == wanted]
    return words, found


TEXTS = [
    None, "", " \n", "cc by", "CC-BY CC_BY ccby cc by", "-cc by nc 4.0", "General Public License; general public licenses",
    "all rights reserved all rights reserved", "ALL RIGHTS  \n RESERVED by cc by all", "the Apache License, Version 2.0 and MIT License",
    "All rights re­served", "all rİghts reserved", "all rights reserved", "aK cc by K", "général public license",
    MIT, MIT.upper(), "x " * 30 + MIT, MIT.replace("conditions", "conditions " + "and " * 6), MIT.replace("conditions", "so " * 80),
    MIT[300:], "cc by " * 3000, "by " * 20_000 + "cc", "word " * 200_000 + "all rights reserved",
]


def test_against_plain_search(spark):
    rows = [(i if i % 4 else None, i, t) for i, t in enumerate(TEXTS)]
    rows += rows[3:5]
    frame = spark.createDataFrame(rows, "doc_id long, licences int, text string").withColumnRenamed("licences", "Places")
    weights = licenses.word_weights(frame)
    out = licenses.scan(frame, weights).collect()
    assert len(out) == len(rows)
    for r in out:
        words, found = plain(r.text)
        places = sorted((s, t, p) for (t, p), starts in found.items() for s in starts)
        assert r.licences.n_words == len(words)
        assert [tuple(p) for p in r.licences.places] == places
        single = {t.label for k, t in enumerate(licenses.TEMPLATES) if len(t.phrases) == 1 and found[k, 0]}
        assert single <= set(r.licences.labels) <= single | {"mit", "bsd"}
        assert r.licences.labels == sorted(set(r.licences.labels))
        assert (r.licences.score == 1.0) == bool(r.licences.labels) and 0 <= r.licences.score <= 1
    labels = {r.Places: (r.licences.labels, r.licences.score) for r in out}
    assert labels[15][0] == labels[16][0] == labels[17][0] == labels[18][0] == ["mit"]
    assert labels[19][0] == [] and labels[19][1] == pytest.approx(0.5, abs=1e-6)  # out of position
    assert labels[20][0] == [] and 0 < labels[20][1] < 0.5


def test_weights_and_anchors(spark):
    rows = [(i, "all the general rights" if i else "reserved") for i in range(10)]
    weights = licenses.word_weights(spark.createDataFrame(rows, "doc_id long, text string"))
    assert weights["reserved"] > weights["all"] >= 1 and weights["license"] > weights["reserved"]
    assert licenses.rarest("all rights reserved", weights) == ("reserved", 2)
    none = licenses.word_weights(spark.createDataFrame([], "doc_id long, text string"))
    assert set(none.values()) == {1.0}


def test_oracle(spark):
    import duckdb

    base = duckdb.connect()
    base.execute(f"create view documents as select * from '{FOLDER}/documents.parquet'")
    frame = QUERIES["op12_license_scan"](spark, FOLDER)
    names = sorted(frame.columns)
    expected = base.execute(f"select {', '.join(names)} from ({ORACLES['op12_license_scan']})").fetchall()
    assert sorted(map(repr, map(tuple, frame.select(*names).collect()))) == sorted(map(repr, expected))


def test_empty(spark):
    frame = spark.createDataFrame([], "doc_id long, text string")
    assert licenses.scan(frame, licenses.word_weights(frame)).count() == 0
