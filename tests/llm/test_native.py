"""The DataFrame-only operators: SQL over the same rows, and edge cases."""

import pytest

duckdb = pytest.importorskip("duckdb")

from keytide.llm import licenses, mixing, rollup  # noqa: E402

MIT = "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"
ROWS = [
    (1, "Under the MIT License. under the mit license", "en", "src0"), (2, None, "en", "src0"), (3, "", None, None), (4, "apache license, VERSION 2 cc by-nc", "de", "src7"),
    (5, MIT.replace("person", "body"), "en", "src13"), (6, MIT[:60], "en", "src13"), (7, "x " * 200 + MIT + " y" * 200, "fr", "src99"), (7, "x " * 200 + MIT + " y" * 200, "fr", "src99"),
    (7, "released under the terms", "fr", "src99"), (8, "under the\u00e9 mit license", "es", "src1"), (9, "\n".join(["line"] * 50 + ["Released under the MIT license."]), "en", "src2"), (None, "cc by nc", "en", "src3"),
    (10, "\u0130cense \u212a under the mit license", "en", "src4"),
]


@pytest.fixture(scope="module")
def rows(spark):
    return spark.createDataFrame([(*r, len(r[1] or ""), "x") for r in ROWS], "doc_id long, text string, lang string, source string, n_chars long, id string")


def in_duckdb(sql, rows):
    con = duckdb.connect()
    con.execute("CREATE TABLE documents (doc_id BIGINT, text VARCHAR, lang VARCHAR, source VARCHAR, n_chars BIGINT)")
    for r in rows:
        con.execute("INSERT INTO documents VALUES (?, ?, ?, ?, ?)", [*r, len(r[1] or "")])
    got = con.execute(sql)
    names = [d[0] for d in got.description]
    return names, sorted(map(repr, got.fetchall()))


def same(df, sql, rows=ROWS):
    names, want = in_duckdb(sql, rows)
    assert sorted(names) == sorted(df.columns)
    assert sorted(repr(tuple(r[n] for n in names)) for r in df.collect()) == want


def test_licenses_equal_sql(spark, rows):
    same(licenses.scanned(rows), licenses.sql())
    got = {r["doc_id"]: r for r in licenses.scanned(rows).collect()}
    assert (got[1]["n_base"], got[1]["first_word"], got[1]["last_word"], got[1]["base_labels"]) == (2, 0, 4, "mit")
    assert got[4]["base_labels"] == "apache-2,cc-by-nc" and got[2]["labels"] == "" and got[2]["score"] == 0
    assert got[5]["labels"] == "mit" and got[5]["score"] < 1 and got[6]["labels"] == "" and got[8]["n_base"] == 0
    same(licenses.scanned(rows.limit(0)), licenses.sql(), [])


BSD = "Redistribution and use in source and binary forms,\n * with or without modification,\n * are permitted provided that"
MPL = "This Source Code Form is subject to\nthe terms of the Mozilla\nPublic License, v. 2.0."


def test_license_statements_cross_lines(spark):
    words = MIT.split()
    texts = [
        ("mit", MIT.replace("free of charge, to any", "free of charge,\nto any").replace("software and", "software\nand")), ("mit", "\n".join(words)), ("mit", "x\n" * 45 + "\n".join(words) + "\ny" * 500), ("bsd", BSD), ("mpl-2", "// " + MPL.replace("\n", "\r\n// ")),
        ("bsd,mit,mpl-2", "\n\n".join([BSD, "word " * 100, MPL, "\n".join(words)])), ("", "\n".join(words[:9])), ("", "\n".join(w + " pad" * 8 for w in words)),
        ("mit", "x\n" * 20 + " ".join(w + " pad" for w in words)),  # a line longer than any two blocks of the text share
    ]
    df = spark.createDataFrame([(i, t) for i, (_, t) in enumerate(texts)], "doc_id long, text string")
    same(licenses.scanned(df), licenses.sql(), [(i, t, None, None) for i, (_, t) in enumerate(texts)])
    got = {r["doc_id"]: r for r in licenses.scanned(df).collect()}
    for i, (want, _) in enumerate(texts):
        assert got[i]["labels"] == want and (got[i]["score"] >= 0.9) == bool(want) and got[i]["n_base"] == 0


@pytest.mark.parametrize("m", [mixing.Mixture(), mixing.Mixture(epochs=1, budget=(1, 3), seed=3), mixing.Mixture(budget=(9, 1)), mixing.Mixture(domain_weights={"web": 0, "other": 7}, lang_weights={})])
def test_mixing_equals_sql(spark, rows, m):
    same(mixing.selected(rows, m).drop("th"), mixing.sql(m))


def test_mixing_of_no_rows_and_of_whole_rows(spark, rows):
    assert mixing.selected(rows.limit(0)).count() == 0
    taken = mixing.selected(rows, mixing.Mixture(epochs=1))
    whole = mixing.mixed(rows, mixing.Mixture(epochs=1), "doc_id")
    assert whole.columns == rows.columns and whole.where("text IS NOT NULL").count() >= taken.select("doc_id", "th").distinct().count() - 1


def test_equal_rows_are_taken_as_often_as_selected(spark):
    """Four equal rows and a budget of two; other columns may have any name."""
    schema = "doc_id long, text string, lang string, source string, n_chars long, key string, `_th` int, row int"
    rows = spark.createDataFrame([(1, "a b c d e", "en", "src0", 9, "x", i, 0) for i in range(4)], schema)
    m = mixing.Mixture(epochs=1, budget=(1, 2))
    assert mixing.selected(rows, m).count() == 2
    got = mixing.mixed(rows, m)
    assert got.columns == rows.columns and got.count() == 2 and len({r["_th"] for r in got.collect()}) == 2
    twice = mixing.Mixture(epochs=2, budget=(3, 2))
    assert mixing.mixed(rows, twice).count() == mixing.selected(rows, twice).count() == 6


def test_shortages_stay_among_siblings(spark):
    """Ten tokens are missing in one source of a language: its sibling gives them, no other language."""
    leaves = [("web", "en", "src0", 10), ("web", "en", "src1", 100), ("web", "de", "src2", 100), ("books", "en", "src5", 200)]
    df = spark.createDataFrame(leaves, "domain string, lang string, source string, tokens long")
    m = mixing.Mixture(epochs=1, budget=(160, 410), domain_weights={"web": 1, "books": 1}, lang_weights={"en": 1, "de": 1}, source_weights={"src0": 1, "src1": 1})
    got = {r["source"]: r["share"] for r in mixing.budgets(df, m).collect()}
    assert got == {"src0": 10, "src1": 30, "src2": 40, "src5": 80}


def test_rollup(spark, tmp_path):
    state = rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    assert state.totals().count() == 0
    rows = spark.createDataFrame([("s", "en", 5), ("s", None, 2), (None, "en", None)], "source string, lang string, n int")
    load = rollup.change(rows, "v1", (0, 0), (1, rows["n"]))
    assert state.commit("load 1/a", load) and not state.commit("load 1/a", load)
    total = lambda: {(r["source"], r["lang"], r["n_docs"], r["n_tokens"]) for r in state.totals().collect()}
    assert total() == {("s", "en", 1, 5), ("s", None, 1, 2), (None, "en", 1, 0)}
    state.commit("revise", rollup.change(rows.where("lang IS NULL"), "v1", (1, rows["n"]), (1, 9)))
    state.commit("delete", rollup.change(rows.where("source IS NOT NULL AND lang IS NOT NULL"), "v1", (1, rows["n"]), (0, 0)))
    state.commit("nothing", load.limit(0))
    assert total() == {("s", None, 1, 9), (None, "en", 1, 0)}
    again = rollup.TokenRollup(spark, f"file://{tmp_path}/r")
    assert not again.commit("revise", load) and len(again.batches()) == 4
    assert state.merge() and not again.merge() and total() == {("s", None, 1, 9), (None, "en", 1, 0)}
    assert not again.commit("load 1/a", load) and again.commit("load 2", load)
    assert total() == {("s", "en", 1, 5), ("s", None, 2, 11), (None, "en", 2, 0)}
    assert state.merge() and total() == {("s", "en", 1, 5), ("s", None, 2, 11), (None, "en", 2, 0)}


def test_one_of_two_drivers_commits_a_batch(spark, tmp_path, monkeypatch):
    one, two = (rollup.TokenRollup(spark, f"file://{tmp_path}/r") for _ in range(2))
    load = rollup.change(spark.createDataFrame([("s", "en", 5)], "source string, lang string, n int"), "v1", (0, 0), (1, 5))
    staged = one._staged
    monkeypatch.setattr(one, "_staged", lambda x: [staged(x), two.commit("b", load)][0])  # the other one is faster
    assert not one.commit("b", load)
    assert [(r["n_docs"], r["n_tokens"]) for r in one.totals().collect()] == [(1, 5)]
