"""License scans: exact phrases, and an exact set-similarity join of text blocks with license templates.

DataFrame functions only. Words are runs outside ASCII punctuation, controls and capitals, after lower-casing A-Z.
Base labels come from phrases whose words stand consecutively. The method joins blocks (runs of at most ``BLOCK``
words, starting every ``STEP`` words of the whole text, across line breaks, and of each line) with the templates: a
block gets a template's label if it contains at least ``THRESHOLD`` of the template's distinct words. Words are ordered by document frequency over the whole table,
rarest first. Filters, all exact: a block must contain one of the template's size - need + 1 rarest words (prefix),
must have at least ``need`` distinct words (length), and from the first shared word on enough words must be left on
both sides (position).

The templates and their vocabulary are parameters of bounded size; they are the only thing broadcast or collected
(one count per word of the vocabulary). No shuffle carries text.

Defined results: null or empty text has no words, no labels and score 0; a row's labels depend on its own text only,
so repeated rows and rows that share an id get what their text earns; null ids are rows like others.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import written

#: Phrases and labels of the base rules.
PHRASES = (("under the mit license", "mit"), ("apache license version 2", "apache-2"), ("cc by nc", "cc-by-nc"))
#: Opening statements of public licenses, as words.
TEMPLATES = (
    ("released under the mit license", "mit"),
    ("permission is hereby granted free of charge to any person obtaining a copy of this software and associated documentation files", "mit"),
    ("licensed under the apache license version 2 0", "apache-2"),
    ("licensed under cc by nc 4 0", "cc-by-nc"),
    ("this work is licensed under the gnu general public license version 3", "gpl-3"),
    ("redistribution and use in source and binary forms with or without modification are permitted", "bsd"),
    ("this source code form is subject to the terms of the mozilla public license v 2 0", "mpl-2"),
    ("this work is licensed under a creative commons attribution 4 0 international license", "cc-by"),
)
THRESHOLD = (9, 10)
BLOCK, STEP = 64, 32
SEPARATOR = "[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z in lower case. lower() does it fast; of all other letters it only turns U+0130 and U+212A into ASCII ones."""
    return F.when(F.contains(text, F.lit("\u0130")) | F.contains(text, F.lit("\u212a")), F.translate(text, UPPER, LOWER)).otherwise(F.lower(text))


def word_array(text: Column) -> Column:
    return F.array_remove(F.split(F.coalesce(text, F.lit("")), SEPARATOR), "")


def starts(tokens: Column, phrase: str) -> Column:
    """Word numbers at which the phrase stands."""
    parts = phrase.split()
    same = lambda i: F.slice(tokens, i + 1, len(parts)) == F.array(*map(F.lit, parts))
    return F.when(
        F.contains(F.concat(F.lit(" "), F.array_join(tokens, " "), F.lit(" ")), F.lit(f" {phrase} ")),
        F.filter(F.sequence(F.lit(0), F.size(tokens) - 1), same),
    ).otherwise(F.array().cast("array<int>"))


def prefix_table(df: DataFrame, frequency: dict[str, int], templates=TEMPLATES, threshold=THRESHOLD) -> tuple[list[str], DataFrame]:
    """The vocabulary, rarest word first, and (word, template, label, words, at, size, need) of the templates' prefixes."""
    vocabulary = sorted({w for t, _ in templates for w in t.split()}, key=lambda w: (frequency.get(w, 0), w))
    place = {w: i for i, w in enumerate(vocabulary)}
    rows = []
    for i, (text, label) in enumerate(templates):
        own = sorted(set(text.split()), key=place.get)
        need = -(-threshold[0] * len(own) // threshold[1])
        rows += [(w, i, label, own, at, len(own), need) for at, w in enumerate(own[: len(own) - need + 1])]
    return vocabulary, df.sparkSession.createDataFrame(rows, "word string, template int, label string, words array<string>, at int, size int, need int")


def scanned(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates=TEMPLATES, threshold=THRESHOLD) -> DataFrame:
    """id_col, n_words, n_base, first_word, last_word, base_labels, labels and score of every row."""
    text = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string").alias("text"))
    lower = text.select("id", F.coalesce(F.xxhash64("text"), F.lit(0)).alias("th"), lowered(F.col("text")).alias("low"))
    tokens = lower.withColumn("tokens", word_array(F.col("low")))
    every = sorted({w for t, _ in templates for w in t.split()})
    have = F.array_intersect(F.array(*map(F.lit, every)), F.col("tokens"))
    found = [starts(F.col("tokens"), p).alias(f"p{i}") for i, (p, _) in enumerate(PHRASES)]
    base = written(tokens.select("id", "th", F.size("tokens").cast("long").alias("n_words"), have.alias("have"), *found), "license-words")

    frequency = {r["w"]: r["n"] for r in base.select(F.explode("have").alias("w")).groupBy("w").agg(F.count(F.lit(1)).alias("n")).collect()}
    vocabulary, prefix = prefix_table(df, frequency, templates, threshold)
    heads = sorted({r["word"] for r in prefix.select("word").collect()})

    # blocks that hold a prefix word, as their words of the vocabulary, rarest first; lines of up to STEP + 1 words lie within a block of the text
    hit = lambda x: F.arrays_overlap(x, F.array(*map(F.lit, heads)))
    lines = F.filter(F.transform(F.split("low", "\n"), word_array), lambda w: F.size(w) > STEP + 1)
    runs = tokens.where(hit(F.col("tokens"))).select("id", "th", F.explode(F.concat(F.array("tokens"), F.when(F.contains("low", F.lit("\n")), lines).otherwise(F.array().cast("array<array<string>>")))).alias("w"))
    cut = F.transform(F.sequence(F.lit(0), F.greatest(F.size("w") - 1 - STEP, F.lit(0)), F.lit(STEP)), lambda s: F.slice("w", s + 1, BLOCK))
    blocks = runs.select("id", "th", F.explode(cut).alias("w")).where(hit(F.col("w"))).select("id", "th", F.size(F.array_distinct("w")).alias("n"), F.array_intersect(F.array(*map(F.lit, vocabulary)), F.col("w")).alias("own"))
    probes = blocks.select("id", "th", "n", "own", F.posexplode("own").alias("j", "word"))
    met = probes.join(F.broadcast(prefix), "word").where((F.col("n") >= F.col("need")) & (F.least(F.col("size") - F.col("at"), F.size("own") - F.col("j")) + F.least("at", "j") >= F.col("need")))
    shared = F.size(F.array_intersect("words", "own"))
    links = met.select("id", "th", "label", "size", "need", shared.alias("shared")).where("shared >= need")
    added = links.groupBy("id", "th").agg(F.collect_set("label").alias("more"), F.max(F.col("shared") / F.col("size")).alias("best"))

    all_starts = F.concat(*[f"p{i}" for i in range(len(PHRASES))])
    plain = F.array_compact(F.array(*[F.when(F.size(f"p{i}") > 0, F.lit(label)) for i, (_, label) in enumerate(PHRASES)]))
    out = base.alias("b").join(added.alias("m"), F.col("b.id").eqNullSafe(F.col("m.id")) & (F.col("b.th") == F.col("m.th")), "left")
    joined = lambda x: F.array_join(F.array_sort(F.array_distinct(x)), ",")
    return out.select(
        F.col("b.id").alias(id_col), "n_words", F.size(all_starts).cast("long").alias("n_base"),
        F.array_min(all_starts).cast("long").alias("first_word"), F.array_max(all_starts).cast("long").alias("last_word"),
        joined(plain).alias("base_labels"), joined(F.concat(plain, F.coalesce("more", F.array().cast("array<string>")))).alias("labels"),
        F.when(F.size(plain) > 0, F.lit(1.0)).otherwise(F.coalesce("best", F.lit(0.0))).alias("score"),
    )


def sql(templates=TEMPLATES, threshold=THRESHOLD) -> str:
    """The same result as DuckDB SQL over documents, every block against every template."""
    rows = ", ".join(f"([{', '.join(repr(w) for w in sorted(set(t.split())))}], '{label}')" for t, label in templates)
    phrases = ", ".join(f"([{', '.join(repr(w) for w in p.split())}], '{label}')" for p, label in PHRASES)
    split = lambda x: f"list_filter(regexp_split_to_array({x}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda y: y <> '')"
    return rf"""
WITH templates(words, label) AS (VALUES {rows}),
phrases(words, label) AS (VALUES {phrases}),
d AS (SELECT row_number() OVER () AS rid, doc_id, translate(coalesce(text, ''), '{UPPER}', '{LOWER}') AS low FROM documents),
w AS (SELECT rid, doc_id, low, {split('low')} AS words FROM d),
places AS (
  SELECT rid, label, i FROM (SELECT rid, words, unnest(range(len(words))) AS i FROM w) x, phrases p
  WHERE x.words[i + 1:i + len(p.words)] = p.words
),
base AS (SELECT rid, count(*) AS n_base, min(i) AS first_word, max(i) AS last_word, list_distinct(list(label)) AS base FROM places GROUP BY rid),
lines AS (SELECT rid, words FROM w UNION ALL SELECT rid, {split('line')} AS words FROM (SELECT rid, unnest(string_split(low, chr(10))) AS line FROM w)),
blocks AS (SELECT rid, words[s + 1:s + {BLOCK}] AS words FROM (SELECT rid, words, unnest(range(0, greatest(len(words) - {STEP}, 1), {STEP})) AS s FROM lines) y),
met AS (
  SELECT rid, label, len(list_intersect(t.words, b.words)) AS shared, len(t.words) AS size FROM blocks b, templates t
  WHERE {threshold[1]} * len(list_intersect(t.words, b.words)) >= {threshold[0]} * len(t.words)
),
more AS (SELECT rid, list_distinct(list(label)) AS more, max(shared / size) AS best FROM met GROUP BY rid)
SELECT doc_id, CAST(len(words) AS BIGINT) AS n_words, coalesce(n_base, 0) AS n_base, first_word, last_word,
       coalesce(array_to_string(list_sort(base), ','), '') AS base_labels,
       coalesce(array_to_string(list_sort(list_distinct(list_concat(coalesce(base, []), coalesce(more, [])))), ','), '') AS labels,
       CASE WHEN n_base > 0 THEN 1.0::DOUBLE ELSE coalesce(best, 0.0::DOUBLE) END AS score
FROM w LEFT JOIN base USING (rid) LEFT JOIN more USING (rid)
"""
