import re
import string

import duckdb

from kindred.llm import licenses as L

LOWER = str.maketrans(string.ascii_uppercase, string.ascii_lowercase)


def brute(text):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOWER))
    found = set()
    for label, base, _, phrase in L.TEMPLATES:
        key = phrase.split()
        found |= {(i, label, base) for i in range(len(words) - len(key) + 1) if words[i : i + len(key)] == key}
    return len(words), found


TEXTS = [
    "Released under the MIT License.", "mit license MIT-LICENSE, mit  license mit", "Licensed under the Apache License, Version 2.0.", "GNU General Public License, version 3 general public license", "mit é license", "MITé License mit license",
    "\x7fmit\x00license\x7f", "İMIT License K license", "license mit", "Licensed under CC BY-NC 4.0. x CC BY 4.0", "general public general public license", "Permission is hereby granted, free of charge, to any person",
    "redistribution and use in source and binary forms", "word " * 20_000 + "apache license", "", None, "mit", "ſmit license", "apache\nlicense\tversion 2.0",
]


def test_against_brute_force(spark):
    rows = [(k, t, "clash") for k, t in enumerate(TEXTS)] + [(0, TEXTS[0], "again"), (None, TEXTS[0], "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, _words string")
    for r in L.scan_licenses(df).collect():
        n, places = brute(TEXTS[r["doc_id"] or 0])
        assert r["n_words"] == n
        assert {(x["start"], x["label"], x["base"]) for x in r["found"] or []} == places
        assert all(0 < x["score"] <= 1 for x in r["found"] or [])


def test_whole_table(spark, sf):
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    for r in L.op8_license_positional(spark, sf).collect():
        n, places = brute(texts[r["doc_id"]])
        base = sorted(p for p in places if p[2])
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (n, len(base), base[0][0] if base else None, base[-1][0] if base else None)
        assert r["base_labels"] == ",".join(sorted({p[1] for p in base})) and r["labels"] == ",".join(sorted({p[1] for p in places}))
        assert 0 <= r["score"] <= 1


def test_whole_licences_score(spark):
    """A whole text scores 1 under its own label, with a header before it and other words for its signs; a mention of the key phrase scores little."""
    whole = {label: text for label, base, text, _ in L.TEXTS if len(text) > 100}
    rows = [(k, f"Copyright (c) 2020 Some One\n\n# {t.replace(', ', ',\n# ')}\nint main()") for k, t in enumerate(whole.values())]
    rows += [(100 + k, next(p for n, _, _, p in L.TEMPLATES if n == label)) for k, label in enumerate(whole)]
    got = {r["doc_id"]: {x["label"]: x["score"] for x in r["found"]} for r in L.scan_licenses(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, label in enumerate(whole):
        assert got[k][label] == 1.0 and 0 < got[100 + k][label] < 0.4


def test_key_phrases_stand_in_their_templates():
    assert all(f" {phrase} " in f" {text} " for _, _, text, phrase in L.TEMPLATES)


def test_no_rows(nothing):
    assert L.scan_licenses(nothing).count() == 0


def test_same_as_sql(spark, sf):
    duckdb.sql(f"CREATE OR REPLACE VIEW documents AS SELECT * FROM '{sf}/documents.parquet'")
    assert sorted(map(tuple, L.op8_license_positional(spark, sf).collect())) == sorted(duckdb.sql(L.OP8_SQL).fetchall())
