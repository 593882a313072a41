"""Mixing sources to target weights with DataFrame functions only: hierarchical token budgets.

The tree is domain -> language -> source. A token budget goes down from the root: at each node it is shared among the
children by weight, but no child gets more than its subtree can give (tokens x ``max_epochs``); what a short child leaves
goes to its siblings by weight, and reaches other branches only when a whole subtree is short, since a node's
capacity is what its parent sees. The share at a node has a closed form: children in ascending order of
capacity / weight are full as long as capacity <= weight x rest / weight left.

A leaf with budget b and c tokens gives b // c full epochs and b % c tokens more: the first tokens of its documents
in the order of md5(seed:epoch:doc_id). No row is sorted for that: sums by the first two digits of the hash, then by the next two
within those, find for each leaf where its budget ends, sums by document within these four digits find the one document that is
cut, and every row compares its own place with that. So a leaf with most of the rows costs 256 sums twice, and a 65,536th of its rows.

Defined results: a null text has no tokens and is never taken; null source or language is a leaf of its own;
weights that are not given count ``other`` (weight 0: never taken); equal ids are separate rows, in the order of their token counts;
shares are rounded down at each node, so a few tokens stay unused; an empty table gives no rows. ``choose`` decides row by row, null
ids too; only rows that share doc_id (or have none), text and leaf with the one document that the budget's end cuts are taken or left together.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored


@dataclass(frozen=True)
class Mix:
    """Integer weights by name at each level."""

    domains: dict[str, int] = field(default_factory=lambda: {"web": 50, "books": 30, "code": 15, "other": 5})
    langs: dict[str, int] = field(default_factory=lambda: {"en": 55, "de": 15, "fr": 15, "es": 15})
    sources: dict[str, int] = field(default_factory=dict)
    other: int = 10
    percent: int = 60  # of the corpus' tokens, where budget is not given
    budget: int | None = None
    max_epochs: int = 4
    seed: int = 20


WORD = r"[^\x20\x09-\x0D]+"


def n_tokens() -> Column:
    """Words of the text."""
    return F.coalesce(F.regexp_count(F.col("text").cast("string"), F.lit(WORD)), F.lit(0)).cast("long")


def domain_of(source: Column) -> Column:
    """The default domains, a stand-in for a domain table: by the last digit of the source's name."""
    last = F.right(source, F.lit(1))
    return F.when(last.between("0", "4"), "web").when(last.between("5", "7"), "books").when(last.between("8", "9"), "code").otherwise("other")


def weight_of(name: Column, weights: dict[str, int], other: int) -> Column:
    out = F.lit(other)
    for k, v in weights.items():
        out = F.when(name == k, v).otherwise(out)
    return out.cast("long")


def shared_out(nodes: DataFrame, parent: list[str], budget: str, weight: str, capacity: str, name: str, out: str) -> DataFrame:
    """Adds ``out``: what each node gets of its parent's budget."""
    group = Window.partitionBy(*parent) if parent else Window.partitionBy(F.lit(0))
    w, c, b = F.col(weight), F.col(capacity), F.col(budget)
    ratio = F.when(w > 0, c.cast("double") / w).otherwise(F.lit(float("inf")))
    order = group.orderBy(F.asc("_ratio"), F.col(name).asc_nulls_first()).rowsBetween(Window.unboundedPreceding, -1)
    ranked = nodes.withColumn("_ratio", ratio)
    ranked = ranked.withColumns({"_rest": b - F.coalesce(F.sum(c).over(order), F.lit(0)), "_left": F.sum(w).over(group) - F.coalesce(F.sum(w).over(order), F.lit(0))})
    full = (w > 0) & (c.cast("double") * F.col("_left") <= w.cast("double") * F.col("_rest"))
    ranked = ranked.withColumn("_full", full).withColumn("_rate", F.when(~F.col("_full") & (w > 0), F.greatest(F.col("_rest"), F.lit(0)).cast("double") / F.col("_left")))
    rate = F.coalesce(F.max("_rate").over(group), F.lit(0.0))
    got = F.when(F.col("_full"), c).otherwise(F.least(c, F.floor(w * rate)))
    return ranked.withColumn(out, got.cast("long")).drop("_ratio", "_rest", "_left", "_full", "_rate")


def budgets(leaves: DataFrame, mix: Mix) -> DataFrame:
    """leaves (domain, lang, source, tokens) with ``leaf_budget``. A row for each leaf, each language of a domain, each domain."""
    leaves = leaves.withColumn("cap", F.col("tokens") * mix.max_epochs)
    langs = leaves.groupBy("domain", "lang").agg(F.sum("cap").alias("lang_cap"))
    domains = langs.groupBy("domain").agg(F.sum("lang_cap").alias("domain_cap"))
    total = leaves.agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("t")).first()["t"]
    goal = mix.budget if mix.budget is not None else total * mix.percent // 100
    d = domains.withColumns({"goal": F.lit(goal).cast("long"), "w": weight_of(F.col("domain"), mix.domains, mix.other)})
    d = shared_out(d, [], "goal", "w", "domain_cap", "domain", "domain_budget").select("domain", "domain_budget")
    la = langs.join(d, "domain").withColumn("w", weight_of(F.col("lang"), mix.langs, mix.other))
    la = shared_out(la, ["domain"], "domain_budget", "w", "lang_cap", "lang", "lang_budget").select("domain", F.col("lang").alias("_lang"), "lang_budget")
    so = leaves.join(la.withColumnRenamed("domain", "_domain"), (F.col("domain") == F.col("_domain")) & F.col("lang").eqNullSafe(F.col("_lang"))).drop("_lang", "_domain")
    so = so.withColumn("w", weight_of(F.col("source"), mix.sources, mix.other))
    return shared_out(so, ["domain", "lang"], "lang_budget", "w", "cap", "source", "leaf_budget").drop("w")


LEAF = ["domain", "lang", "source"]
#: First digits of the hash by which a leaf's tokens are summed, level by level.
DIGITS = (2, 4)


def leaf_join(rows: DataFrame, plan: DataFrame, how: str = "inner") -> DataFrame:
    """rows with the columns of a table that has a row for each leaf of the tree of names. Spark broadcasts it where its measured size
    is small; else both sides are dealt out by leaf, and the adaptive join splits a leaf that holds very many rows."""
    right = plan.withColumnsRenamed({c: f"{c}_" for c in LEAF})
    same = (F.col("domain") == F.col("domain_")) & F.col("lang").eqNullSafe(F.col("lang_")) & F.col("source").eqNullSafe(F.col("source_"))
    return rows.join(right, same, how).drop(*(f"{c}_" for c in LEAF))


def key_of(seed: int, doc_id: Column, text_hash: Column) -> Column:
    """A row's place in its leaf; rows without an id are told apart by their texts."""
    name = F.coalesce(doc_id.cast("string"), F.concat(F.lit("null:"), text_hash.cast("string")))
    return F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("full_epochs").cast("string"), name))


def order_by(docs: DataFrame, domain: Callable[[Column], Column]) -> DataFrame:
    """doc_id, the leaf, n_tokens and a text hash (of rows without an id alone) of every row."""
    source = F.col("source").cast("string")
    text_hash = F.when(F.col("doc_id").isNull(), F.xxhash64(F.col("text").cast("string")))
    return docs.select("doc_id", domain(source).alias("domain"), F.col("lang").cast("string").alias("lang"), source.alias("source"), n_tokens().alias("n_tokens"), text_hash.alias("text_hash"))


def cuts(rows: DataFrame, mix: Mix) -> DataFrame:
    """A row for each leaf: full_epochs, rest, and the document (h, doc_id, n_tokens) at which ``rest`` is used up, with the tokens before it (null
    where the budget ends at no document). ``rows`` is a stored table of order_by()."""
    leaves = rows.groupBy(*LEAF).agg(F.sum("n_tokens").alias("tokens"))
    plan = budgets(leaves, mix).select(
        *LEAF,
        F.when(F.col("tokens") > 0, F.expr("leaf_budget div tokens")).otherwise(0).cast("long").alias("full_epochs"),
        F.when(F.col("tokens") > 0, F.expr("leaf_budget % tokens")).otherwise(0).cast("long").alias("rest"),
    )
    plan = stored(plan, "mix-plan")
    keyed = leaf_join(rows.filter("n_tokens > 0"), plan).withColumn("h", key_of(mix.seed, F.col("doc_id"), F.col("text_hash")))
    ends = None
    for digits in DIGITS:  # at most 256 sums a leaf at each level
        sums = keyed.groupBy(*LEAF, F.substring("h", 1, digits).alias("hh")).agg(F.sum("n_tokens").alias("of"), F.first("rest").alias("rest"), *([F.first("from").alias("from")] if ends else []))
        at = F.sum("of").over(Window.partitionBy(*LEAF).orderBy("hh")) - F.col("of") + (F.col("from") if ends else F.lit(0))
        ends = stored(sums.withColumn("from", at).filter("from <= rest and rest < from + of").select(*LEAF, F.col("hh").alias("end"), "from"), "mix-ends")
        keyed = leaf_join(keyed.drop("end", "from"), ends).filter(F.col("h").startswith(F.col("end")))
    near = keyed.groupBy(*LEAF, "h", "doc_id", "n_tokens").agg(F.count(F.lit(1)).alias("same"), F.first("rest").alias("rest"), F.first("from").alias("before"))
    place = Window.partitionBy(*LEAF).orderBy("h", F.col("doc_id").asc_nulls_first(), "n_tokens")
    own = F.col("same") * F.col("n_tokens")
    found = near.withColumn("at", F.col("before") + F.sum(own).over(place) - own).filter((F.col("at") <= F.col("rest")) & (F.col("rest") < F.col("at") + own))
    cut = found.select(*LEAF, F.col("h").alias("cut_h"), F.col("doc_id").alias("cut_id"), F.col("n_tokens").alias("cut_n"), F.col("at").alias("cut_at"))
    return stored(leaf_join(plan, cut, "left"), "mix-cuts")


def side_of_cut(h: Column, doc_id: Column, n: Column) -> Column:
    """-1 for a row before its leaf's cut (or where there is none, with no tokens over), 0 for the cut document, 1 behind."""
    id_less = (doc_id.isNull() & F.col("cut_id").isNotNull()) | F.coalesce(doc_id < F.col("cut_id"), F.lit(False))
    same_id = doc_id.eqNullSafe(F.col("cut_id"))
    less = (h < F.col("cut_h")) | ((h == F.col("cut_h")) & (id_less | (same_id & (n < F.col("cut_n")))))
    same = (h == F.col("cut_h")) & same_id & (n == F.col("cut_n"))
    return F.when(F.col("cut_h").isNull(), 1).when(less, -1).when(same, 0).otherwise(1)


def mixed(docs: DataFrame, mix: Mix | None = None, domain: Callable[[Column], Column] = domain_of) -> DataFrame:
    """Every row: doc_id, domain, lang, source, n_tokens, full_epochs, tokens_taken. ``domain`` gives a source's domain."""
    mix = mix or Mix()
    rows = stored(order_by(docs, domain), "mix-rows")
    placed = leaf_join(rows, cuts(rows, mix)).withColumn("h", key_of(mix.seed, F.col("doc_id"), F.col("text_hash")))
    placed = placed.withColumn("side", side_of_cut(F.col("h"), F.col("doc_id"), F.col("n_tokens")))
    plain = placed.filter("side <> 0").withColumn("more", F.when(F.col("side") < 0, F.col("n_tokens")).otherwise(0))
    # the cut document: one row, or its equal rows, one after the other
    turn = F.row_number().over(Window.partitionBy(*LEAF).orderBy("h")) - 1
    cut = placed.filter("side = 0").withColumn("more", F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("rest") - F.col("cut_at") - turn * F.col("n_tokens"))))
    taken = (F.col("full_epochs") * F.col("n_tokens") + F.col("more")).cast("long")
    return plain.unionByName(cut).select("doc_id", *LEAF, "n_tokens", "full_epochs", taken.alias("tokens_taken"))


def choose(docs: DataFrame, mix: Mix, domain: Callable[[Column], Column] = domain_of) -> DataFrame:
    """The rows of docs of which any token is taken, whole and once; all columns stay. A row without tokens goes. Texts are not shuffled
    unless the table of leaves is too large to broadcast."""
    ends = cuts(stored(order_by(docs, domain), "mix-rows"), mix)
    mark = f"_{uuid.uuid4().hex[:8]}_"
    own = order_by(docs, domain).columns
    names = {c: f"{mark}{c}" for c in docs.columns}
    full = docs.withColumnsRenamed(names)
    given = {c: F.col(names[c]) for c in ("doc_id", "text", "lang", "source")}
    source = given["source"].cast("string")
    tokens = F.coalesce(F.regexp_count(given["text"].cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    made = {"domain": domain(source), "lang": given["lang"].cast("string"), "source": source, "doc_id": given["doc_id"], "n_tokens": tokens, "text_hash": F.when(given["doc_id"].isNull(), F.xxhash64(given["text"].cast("string")))}
    placed = leaf_join(full.withColumns({c: made[c] for c in own}), ends).withColumn("h", key_of(mix.seed, F.col("doc_id"), F.col("text_hash")))
    side = side_of_cut(F.col("h"), F.col("doc_id"), F.col("n_tokens"))
    taken = (F.col("n_tokens") > 0) & ((F.col("full_epochs") > 0) | (side < 0) | ((side == 0) & (F.col("rest") > F.col("cut_at"))))
    return placed.filter(taken).select(*(F.col(names[c]).alias(c) for c in docs.columns))


#: DuckDB SQL for mixed() with the default Mix over `documents`; levels are named d, l and s.
ORACLE = r"""
WITH rows_ AS (
  SELECT doc_id, CASE WHEN right(source, 1) BETWEEN '0' AND '4' THEN 'web' WHEN right(source, 1) BETWEEN '5' AND '7' THEN 'books'
         WHEN right(source, 1) BETWEEN '8' AND '9' THEN 'code' ELSE 'other' END AS domain, lang, source,
         coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS n_tokens
  FROM documents),
leaves AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens, sum(n_tokens)::BIGINT * 4 AS cap FROM rows_ GROUP BY ALL),
goal AS (SELECT sum(tokens)::BIGINT * 60 // 100 AS b FROM leaves),
d0 AS (SELECT domain, sum(cap)::BIGINT AS c, CASE domain WHEN 'web' THEN 50 WHEN 'books' THEN 30 WHEN 'code' THEN 15 ELSE 5 END AS w, (SELECT b FROM goal) AS b FROM leaves GROUP BY domain),
d1 AS (SELECT *, b - coalesce(sum(c) OVER o, 0)::BIGINT AS rest, (sum(w) OVER () - coalesce(sum(w) OVER o, 0))::BIGINT AS lft FROM d0
       WINDOW o AS (ORDER BY c::DOUBLE / w, domain ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
d2 AS (SELECT *, c::DOUBLE * lft <= w::DOUBLE * rest AS isfull FROM d1),
d3 AS (SELECT *, max(CASE WHEN NOT isfull THEN greatest(rest, 0)::DOUBLE / lft END) OVER () AS rate FROM d2),
dd AS (SELECT domain, CASE WHEN isfull THEN c ELSE least(c, floor(w * coalesce(rate, 0))::BIGINT) END AS b FROM d3),
l0 AS (SELECT domain, lang, sum(cap)::BIGINT AS c, CASE lang WHEN 'en' THEN 55 WHEN 'de' THEN 15 WHEN 'fr' THEN 15 WHEN 'es' THEN 15 ELSE 10 END AS w, any_value(dd.b) AS b FROM leaves JOIN dd USING (domain) GROUP BY domain, lang),
l1 AS (SELECT *, b - coalesce(sum(c) OVER o, 0)::BIGINT AS rest, (sum(w) OVER (PARTITION BY domain) - coalesce(sum(w) OVER o, 0))::BIGINT AS lft FROM l0
       WINDOW o AS (PARTITION BY domain ORDER BY c::DOUBLE / w, lang NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
l2 AS (SELECT *, c::DOUBLE * lft <= w::DOUBLE * rest AS isfull FROM l1),
l3 AS (SELECT *, max(CASE WHEN NOT isfull THEN greatest(rest, 0)::DOUBLE / lft END) OVER (PARTITION BY domain) AS rate FROM l2),
ll AS (SELECT domain, lang, CASE WHEN isfull THEN c ELSE least(c, floor(w * coalesce(rate, 0))::BIGINT) END AS b FROM l3),
s0 AS (SELECT leaves.domain, leaves.lang, source, tokens, cap AS c, 10 AS w, ll.b FROM leaves JOIN ll ON leaves.domain = ll.domain AND leaves.lang IS NOT DISTINCT FROM ll.lang),
s1 AS (SELECT *, b - coalesce(sum(c) OVER o, 0)::BIGINT AS rest, (sum(w) OVER (PARTITION BY domain, lang) - coalesce(sum(w) OVER o, 0))::BIGINT AS lft FROM s0
       WINDOW o AS (PARTITION BY domain, lang ORDER BY c::DOUBLE / w, source NULLS FIRST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
s2 AS (SELECT *, c::DOUBLE * lft <= w::DOUBLE * rest AS isfull FROM s1),
s3 AS (SELECT *, max(CASE WHEN NOT isfull THEN greatest(rest, 0)::DOUBLE / lft END) OVER (PARTITION BY domain, lang) AS rate FROM s2),
plan AS (SELECT domain, lang, source, tokens, CASE WHEN isfull THEN c ELSE least(c, floor(w * coalesce(rate, 0))::BIGINT) END AS b FROM s3),
joined AS (SELECT r.*, CASE WHEN tokens > 0 THEN b // tokens ELSE 0 END AS full_epochs, CASE WHEN tokens > 0 THEN b % tokens ELSE 0 END AS rest
           FROM rows_ r JOIN plan p ON r.domain = p.domain AND r.lang IS NOT DISTINCT FROM p.lang AND r.source IS NOT DISTINCT FROM p.source),
placed AS (SELECT *, coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source ORDER BY md5('20:' || full_epochs || ':' || coalesce(doc_id::VARCHAR, '')), doc_id NULLS FIRST, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS start_ FROM joined)
SELECT doc_id, domain, lang, source, n_tokens, full_epochs::BIGINT AS full_epochs, (full_epochs * n_tokens + greatest(0, least(n_tokens, rest - start_)))::BIGINT AS tokens_taken FROM placed
"""
