"""Mixing sources to target weights with hierarchical budgets.

Leaves are (domain, lang, source). A node's budget is shared among its children by weight; a child takes no more than
its capacity (tokens of its leaves times ``epochs``), and what it cannot take goes to its siblings by weight. Since a
child's capacity is that of its whole subtree, a shortage inside a subtree is made good there first and reaches the
ancestors only when the subtree has nothing left. All shares are whole tokens in integer arithmetic.

A leaf with budget b and t tokens gives b div t whole epochs and, of the next one, the prefix of its documents in the
order of a seeded hash (seed, epoch, id) that starts within the remaining b mod t tokens. Prefixes need no sorting of
a leaf: token sums by hash bucket show the bucket in which the budget ends, and only that bucket is put in order.

DataFrame functions only. Defined results: null lang or source counts as the empty name; names without a weight get
the default weight, weight 0 gets nothing; null text has no tokens and comes with the whole epochs of its leaf, or
with a prefix if its place is before the end; leaves without tokens give nothing; rows that share an id stand in the
order of their texts' hashes; a budget above all capacity selects all of it; an empty table gives no rows.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .scratch import written

WORD = "[^\\x20\\x09-\\x0D]+"
#: Hex digits of the hash that make a bucket.
DIGITS = 3


@dataclass(frozen=True)
class Mixture:
    """domains: (pattern of the source's name, domain), the first that matches counts, else ``other``."""

    domains: tuple[tuple[str, str], ...] = (("^src[0-4]$", "web"), ("^src([5-9]|1[0-1])$", "books"), ("^src1[2-6]$", "code"))
    domain_weights: dict[str, int] = field(default_factory=lambda: {"web": 40, "books": 30, "code": 20, "other": 10})
    lang_weights: dict[str, int] = field(default_factory=lambda: {"en": 50, "de": 20, "fr": 20, "es": 10})
    source_weights: dict[str, int] = field(default_factory=dict)
    default_weight: int = 5
    #: The budget as a share (numerator, denominator) of all tokens.
    budget: tuple[int, int] = (3, 5)
    epochs: int = 4
    seed: int = 17


def domain(m: Mixture, source: Column) -> Column:
    out = F.lit("other")
    for pattern, name in reversed(m.domains):
        out = F.when(source.rlike(pattern), F.lit(name)).otherwise(out)
    return out


def weight(m: Mixture, weights: dict[str, int], name: Column) -> Column:
    out = F.lit(m.default_weight)
    for key, value in weights.items():
        out = F.when(name == key, F.lit(value)).otherwise(out)
    return out.cast("long")


def filled(children: DataFrame, parent: list[str], name: str) -> DataFrame:
    """children (parent columns, ``name``, w, cap, budget of the parent) with ``share``: weights, then capacity.

    In the order of cap / w a child is full if the budget, spread by weight over it and all after it, would reach its
    capacity; the others share by weight what full ones leave.
    """
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    # cap / w in two parts, so that no large quotient is rounded
    order = group.orderBy(F.expr("cap div w"), (F.col("cap") % F.col("w")) / F.col("w"), name).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    x = children.where("w > 0 AND cap > 0")
    x = x.withColumns({"_c": F.sum("cap").over(order), "_v": F.sum("w").over(order), "_all": F.sum("w").over(group)})
    x = x.withColumn("_full", F.col("w") * (F.col("budget") - F.col("_c")) >= F.col("cap") * (F.col("_all") - F.col("_v")))
    x = x.withColumns({"_held": F.sum(F.when(F.col("_full"), F.col("cap")).otherwise(0)).over(group), "_rest": F.sum(F.when(F.col("_full"), 0).otherwise(F.col("w"))).over(group)})
    part = F.expr("w * (budget - _held) div greatest(_rest, 1L)")
    return x.withColumn("share", F.when(F.col("_full"), F.col("cap")).otherwise(part)).drop("_c", "_v", "_all", "_full", "_held", "_rest")


def budgets(leaves: DataFrame, m: Mixture) -> DataFrame:
    """(domain, lang, source, tokens, share) of the leaves (domain, lang, source, tokens)."""
    x = leaves.where("tokens > 0").withColumns({"cap": F.col("tokens") * m.epochs, "w1": weight(m, m.domain_weights, F.col("domain")), "w2": weight(m, m.lang_weights, F.col("lang")), "w3": weight(m, m.source_weights, F.col("source"))})
    x = x.where("w1 > 0 AND w2 > 0 AND w3 > 0")
    total = leaves.agg(F.sum("tokens").alias("t")).select(F.expr(f"t * {m.budget[0]} div {m.budget[1]}").alias("budget"))
    one = x.groupBy("domain").agg(F.first("w1").alias("w"), F.sum("cap").alias("cap")).join(F.broadcast(total))
    one = filled(one, [], "domain").select("domain", F.col("share").alias("budget"))
    two = x.groupBy("domain", "lang").agg(F.first("w2").alias("w"), F.sum("cap").alias("cap")).join(one, "domain")
    two = filled(two, ["domain"], "lang").select("domain", "lang", F.col("share").alias("budget"))
    three = x.select("domain", "lang", "source", "tokens", F.col("w3").alias("w"), "cap").join(two, ["domain", "lang"])
    return filled(three, ["domain", "lang"], "source").select("domain", "lang", "source", "tokens", "share")


def place(m: Mixture, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(str(m.seed)), epoch.cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))))


def selected(df: DataFrame, m: Mixture = Mixture(), id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", source_col: str = "source") -> DataFrame:
    """id_col, domain, lang, source, epoch and n_tokens, a row for each time that a document is taken; and th, its text's hash."""
    lang, source = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (lang_col, source_col))
    docs = df.select(F.col(id_col).alias("id"), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit(""))).alias("th"), lang.alias("lang"), source.alias("source"), domain(m, source).alias("domain"), F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORD)), F.lit(0)).cast("long").alias("n"))
    docs = written(docs, "mix-docs")
    leaf = ["domain", "lang", "source"]
    plan = written(budgets(docs.groupBy(*leaf).agg(F.sum("n").alias("tokens")), m).withColumn("whole", F.expr("share div tokens")).withColumn("rest", F.expr("share % tokens")), "mix-plan")
    taken = docs.join(plan.select(*leaf, "whole", "rest"), leaf)
    taken = taken.withColumn("h", place(m, F.col("whole"))).withColumn("bucket", F.substring("h", 1, DIGITS))

    # the bucket of each leaf in which the rest ends, and the tokens before it
    sums = taken.where("rest > 0").groupBy(*leaf, "rest", "bucket").agg(F.sum("n").alias("t"))
    before = F.sum("t").over(Window.partitionBy(*leaf).orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    ends = sums.withColumn("before", F.coalesce(before, F.lit(0))).where("before < rest").groupBy(*leaf).agg(F.max("bucket").alias("end"), F.max("before").alias("before"))
    ends = written(ends, "mix-ends")
    taken = taken.join(ends, leaf, "left")
    inside = Window.partitionBy(*leaf).orderBy("h", "id", "th").rowsBetween(Window.unboundedPreceding, -1)
    last = taken.where("bucket = end").withColumn("_b", F.col("before") + F.coalesce(F.sum("n").over(inside), F.lit(0))).where("_b < rest").select("id", "th", *leaf, F.col("whole").alias("epoch"), "n")
    early = taken.where("bucket < end").select("id", "th", *leaf, F.col("whole").alias("epoch"), "n")
    whole = taken.where("whole > 0").select("id", "th", *leaf, F.explode(F.sequence(F.lit(0).cast("long"), F.col("whole") - 1)).alias("epoch"), "n")
    return whole.unionByName(early).unionByName(last).select(F.col("id").alias(id_col), "th", *leaf, F.col("epoch").cast("long").alias("epoch"), F.col("n").alias("n_tokens"))


def mixed(df: DataFrame, m: Mixture, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of df that selected() takes, each as many times as it takes them.

    Rows that share id and text are taken together, save where a leaf's budget ends among them: then, in that epoch, as
    many of them as it takes, in the order of all their columns' hash.
    """
    key = lambda i, th: F.md5(F.concat_ws(":", F.coalesce(i.cast("string"), F.lit("")), th))
    rows = df.select(key(F.col(id_col), F.md5(F.coalesce(F.col(text_col).cast("string"), F.lit("")))).alias("key"), F.struct(*[F.col(f"`{c}`") for c in df.columns]).alias("row"))
    each = selected(df, m, id_col, text_col).groupBy(key(F.col(id_col), F.col("th")).alias("key"), "epoch").agg(F.count(F.lit(1)).cast("int").alias("c"))
    copies = rows.groupBy("key").agg(F.count(F.lit(1)).alias("copies"))
    take = each.groupBy("key").agg(F.collect_list("c").alias("takes"), F.min("c").alias("low")).join(copies, "key")
    take = written(take.select("key", "takes", (F.col("low") < F.col("copies")).alias("some")), "mix-take")
    whole = rows.join(take.where("NOT some"), "key").select("row", F.explode("takes"))
    place = F.row_number().over(Window.partitionBy("key").orderBy(F.xxhash64("row")))
    some = rows.join(take.where("some"), "key").withColumn("place", place).select("row", F.explode(F.filter("takes", lambda c: c >= F.col("place"))))
    return whole.select("row.*").unionByName(some.select("row.*"))


def sql(m: Mixture = Mixture()) -> str:
    """selected() without th as DuckDB SQL over documents."""
    case = lambda expr, weights: f"CASE {expr} " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in weights.items()) + f" ELSE {m.default_weight} END" if weights else str(m.default_weight)
    domain_case = "CASE " + " ".join(f"WHEN regexp_matches(source, '{p}') THEN '{d}'" for p, d in m.domains) + " ELSE 'other' END"

    def fill(source: str, parent: str, name: str, keep: str) -> str:
        over = f"PARTITION BY {parent}" if parent else ""
        return f"""
  SELECT {keep}, CASE WHEN full_ THEN cap ELSE w * (budget - sum(CASE WHEN full_ THEN cap ELSE 0 END) OVER ({over})) // greatest(sum(CASE WHEN full_ THEN 0 ELSE w END) OVER ({over}), 1) END AS share
  FROM (SELECT *, w * (budget - sum(cap) OVER o) >= cap * (sum(w) OVER ({over}) - sum(w) OVER o) AS full_ FROM ({source})
        WINDOW o AS ({over} ORDER BY cap / w, {name} ROWS UNBOUNDED PRECEDING)) f"""

    return rf"""
WITH named AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0) AS n FROM documents
),
docs AS (SELECT *, {domain_case} AS domain FROM named),
leaves AS (SELECT domain, lang, source, CAST(sum(n) AS HUGEINT) AS tokens FROM docs GROUP BY ALL),
x AS (SELECT *, tokens * {m.epochs} AS cap, {case('domain', m.domain_weights)} AS w1, {case('lang', m.lang_weights)} AS w2, {case('source', m.source_weights)} AS w3 FROM leaves WHERE tokens > 0),
y AS (SELECT * FROM x WHERE w1 > 0 AND w2 > 0 AND w3 > 0),
one AS ({fill(f"SELECT domain, any_value(w1) AS w, sum(cap) AS cap, (SELECT sum(tokens) * {m.budget[0]} // {m.budget[1]} FROM leaves) AS budget FROM y GROUP BY domain", '', 'domain', 'domain')}),
two AS ({fill("SELECT domain, lang, any_value(w2) AS w, sum(cap) AS cap, any_value(share) AS budget FROM y JOIN one USING (domain) GROUP BY domain, lang", 'domain', 'lang', 'domain, lang')}),
three AS ({fill("SELECT domain, lang, source, tokens, w3 AS w, cap, share AS budget FROM y JOIN two USING (domain, lang)", 'domain, lang', 'source', 'domain, lang, source, tokens')}),
plan AS (SELECT domain, lang, source, share // tokens AS whole, share % tokens AS rest FROM three),
taken AS (
  SELECT *, coalesce(sum(n) OVER (PARTITION BY domain, lang, source ORDER BY md5(concat('{m.seed}:', CAST(whole AS BIGINT), ':', coalesce(CAST(doc_id AS VARCHAR), ''))), doc_id, md5(text) ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM docs JOIN plan USING (domain, lang, source)
)
SELECT doc_id, domain, lang, source, CAST(e AS BIGINT) AS epoch, CAST(n AS BIGINT) AS n_tokens
FROM (SELECT *, unnest(range(CAST(whole AS BIGINT) + 1)) AS e FROM taken) z WHERE e < whole OR before < rest
"""
