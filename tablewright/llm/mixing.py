"""Mixing sources to target weights by hierarchical budgeting.

Leaves are (domain, language, source).  A budget of tokens flows down the tree by weight; a node can't take more than its
leaves hold over all epochs, and what it can't take its siblings share by weight before their parent runs short.  Only if
all of a parent's children are full does the shortage reach the parent's own siblings.  All arithmetic is in whole tokens.

A leaf's budget is met by whole epochs and a prefix of one more: documents in the seeded order of
md5("seed:epoch:doc_id") as long as their tokens fit.  Prefixes are found without sorting a leaf: sums of 256 hash buckets
show in which one the prefix ends, that one is cut into 256 again until it is small, and only its documents are ranked.

Defined results: null text holds no tokens; null tree columns are the value ""; rows that agree in order and tokens are
taken together or not at all; a node without a weight gets nothing; an empty table gives an empty result; other columns are passed by.
"""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from tablewright.llm.shared import attach, column, owned, prepare, stored

LEAF = ["domain", "lang", "source"]
#: Documents of a bucket that are ranked at once.
RANKED = 256
WORD = r"[^\x20\x09-\x0D]+"


@dataclass(frozen=True)
class Recipe:
    """Weights (whole numbers) of domains, languages and sources; unnamed nodes get the default.

    domain_sql: SQL for a document's domain.  tenths: budget in tenths of all tokens.  epochs: times that a
    document may be used at most.
    """

    domain_sql: str
    domains: dict[str, int] = field(default_factory=dict)
    langs: dict[str, int] = field(default_factory=dict)
    sources: dict[str, int] = field(default_factory=dict)
    default: int = 1
    tenths: int = 6
    epochs: int = 3
    seed: str = "mix-1"

    def weight_sql(self, level: str) -> str:
        known = {"domain": self.domains, "lang": self.langs, "source": self.sources}[level]
        return "CASE " + "".join(f"WHEN {level} = '{k}' THEN {v} " for k, v in known.items()) + f"ELSE {self.default} END" if known else str(self.default)


#: The large crawl, the smaller sites and the rest; Spanish is asked for beyond what there is.
RECIPE = Recipe(
    domain_sql="CASE WHEN source = 'src0' THEN 'crawl' WHEN length(source) = 4 THEN 'forum' ELSE 'reference' END",
    domains={"crawl": 30, "forum": 30, "reference": 40},
    langs={"en": 30, "de": 20, "fr": 20, "es": 30},
    sources={"src10": 3, "src5": 2},
)


def leaves(docs: DataFrame, recipe: Recipe) -> DataFrame:
    """The documents under neutral names, with their leaf (__domain, __lang, __source), id as text and tokens."""
    rows, first = owned(docs)
    own = {c: F.coalesce(column(first, c), F.lit("")) for c in ("lang", "source", "text", "doc_id")}
    rows = rows.withColumns({"__lang": own["lang"], "__source": own["source"], "__id": own["doc_id"], "__n": F.regexp_count(own["text"], F.lit(WORD)).cast("long")})
    return rows.withColumn("__domain", F.expr(re.sub(r"\b(source|lang)\b", r"__\1", recipe.domain_sql)))


def budgets(sums: DataFrame, recipe: Recipe) -> DataFrame:
    """Leaves with their tokens and budget: three rounds of filling children by weight up to what they hold.

    Sorted by room per weight, children fill up one after another: one is full if its weight's share of what is left
    after the fuller ones is at least its room; the rest share what remains.  A node's children, one row each, are sorted by
    one task: domains are named by the recipe, languages are few, sources of a language and domain are rows by the million at most.
    """
    nodes = sums.withColumn("room", F.col("tokens") * recipe.epochs)
    total = sums.agg(F.coalesce(F.sum("tokens"), F.lit(0)).cast("long").alias("n")).first().n * recipe.tenths // 10
    nodes = nodes.withColumn("budget_0", F.lit(total).cast("long"))
    for k, level in enumerate(LEAF):
        path, above = LEAF[: k + 1], LEAF[:k]
        tier = nodes.groupBy(*path).agg(F.sum("room").alias("r"), F.max(f"budget_{k}").alias("b")).withColumn("w", F.expr(recipe.weight_sql(level)).cast("long")).where("w > 0 AND r > 0")
        group = Window.partitionBy(*above) if above else Window.partitionBy(F.lit(0))
        fill = group.orderBy(F.col("r") / F.col("w"), level).rowsBetween(Window.unboundedPreceding, -1)
        tier = tier.withColumns({"r_before": F.coalesce(F.sum("r").over(fill), F.lit(0)), "w_left": F.sum("w").over(group) - F.coalesce(F.sum("w").over(fill), F.lit(0))})
        tier = tier.withColumn("full", F.expr("r * w_left <= w * (b - r_before)"))
        tier = tier.withColumns({"r_full": F.coalesce(F.sum(F.when(F.col("full"), F.col("r"))).over(group), F.lit(0)), "w_open": F.coalesce(F.sum(F.when(~F.col("full"), F.col("w"))).over(group), F.lit(1))})
        share = F.expr("CASE WHEN full THEN r ELSE (w * (b - r_full)) DIV w_open END")
        nodes = nodes.join(tier.select(*path, share.alias(f"budget_{k + 1}")), path)
    return nodes.select(*LEAF, "tokens", F.col("budget_3").alias("budget"))


def decisions(docs: DataFrame, recipe: Recipe = RECIPE) -> tuple[DataFrame, DataFrame]:
    """The documents' leaves, ids and tokens, and for each leaf its whole epochs and where its prefix ends (both written)."""
    prepare(docs.sparkSession)
    rows = stored(leaves(docs, recipe).select(*[F.col(f"__{c}").alias(c) for c in LEAF], F.col("__id").alias("id"), F.col("__n").alias("n")), "mix-rows")
    plan = stored(budgets(rows.groupBy(*LEAF).agg(F.sum("n").alias("tokens")).where("tokens > 0"), recipe), "mix-budgets")
    plan = plan.select(*LEAF, F.expr("budget DIV tokens").alias("epochs"), F.expr("budget % tokens").alias("rest"))
    near = attach(rows, plan, LEAF).where("epochs IS NOT NULL").withColumn("h", _order(recipe, F.col("id"), F.col("epochs"))).select(*LEAF, "h", "n")
    ends = plan.select(*LEAF, "rest", F.lit("").alias("bucket"), F.lit(0).cast("long").alias("before"))
    for digits in range(2, 33, 2):
        sums = attach(near, ends.drop("bucket"), LEAF).groupBy(*LEAF, "rest", "before", F.substring("h", 1, digits).alias("bucket")).agg(F.sum("n").alias("n"), F.count("*").alias("docs"))
        upto = F.col("before") + F.sum("n").over(Window.partitionBy(*LEAF).orderBy("bucket"))  # of 256 buckets at most
        first = sums.withColumn("upto", upto).where("upto > rest").groupBy(*LEAF, "rest").agg(F.min(F.struct("bucket", "upto", "n", "docs")).alias("e"))
        ends = stored(first.select(*LEAF, "rest", F.col("e.bucket").alias("bucket"), (F.col("e.upto") - F.col("e.n")).alias("before"), F.col("e.docs").alias("docs")), "mix-ends")
        near = stored(attach(near, ends.select(*LEAF, "bucket"), LEAF).where("startswith(h, bucket)").drop("bucket"), "mix-near")
        if (ends.agg(F.max("docs").alias("n")).first().n or 0) <= RANKED:
            break
        ends = ends.drop("docs")
    # Rows that agree in order and tokens are one, so copies of an id are ranked once.
    last = attach(near.groupBy(*LEAF, "h", "n").agg(F.sum("n").alias("m")), ends.select(*LEAF, "rest", "before"), LEAF)
    ranked = last.withColumn("upto", F.col("before") + F.sum("m").over(Window.partitionBy(*LEAF).orderBy("h", "n")))
    edge = ranked.where("upto <= rest").groupBy(*LEAF).agg(F.max(F.struct("h", "n")).alias("edge"))
    cut = ends.join(edge, LEAF, "left").select(*LEAF, F.coalesce(F.col("edge.h"), F.col("bucket")).alias("cut_h"), F.coalesce(F.col("edge.n"), F.lit(-1)).alias("cut_n"))
    return rows, stored(plan.join(cut, LEAF, "left").select(*LEAF, "epochs", "cut_h", "cut_n"), "mix-plan")


def _order(recipe: Recipe, id_: Column, epoch: Column) -> Column:
    return F.md5(F.concat_ws(":", F.lit(recipe.seed), epoch.cast("string"), id_))


def _uses(recipe: Recipe, id_: Column, n: Column) -> Column:
    """Times that a document is used: its leaf's whole epochs, and one more if it lies in the prefix."""
    h = _order(recipe, id_, F.col("epochs"))
    inside = F.col("cut_h").isNull() | (h < F.col("cut_h")) | ((h == F.col("cut_h")) & (n <= F.col("cut_n")))
    return F.col("epochs") + F.when(inside, 1).otherwise(0)


def selected(docs: DataFrame, recipe: Recipe = RECIPE) -> DataFrame:
    """doc_id, domain, lang, source, n_tokens and epoch: a row for each use of a document."""
    rows, plan = decisions(docs, recipe)
    used = attach(rows, plan, LEAF).where("epochs IS NOT NULL").withColumn("uses", _uses(recipe, F.col("id"), F.col("n"))).where("uses > 0")
    doc_id = F.when(F.col("id") != "", F.col("id")).cast("long").alias("doc_id")
    return used.select(doc_id, *LEAF, F.col("n").alias("n_tokens"), F.explode(F.expr("sequence(0L, uses - 1)")).alias("epoch"))


def mixed(docs: DataFrame, recipe: Recipe = RECIPE) -> DataFrame:
    """The documents themselves, each as often as it is used."""
    _, plan = decisions(docs, recipe)
    keys = [f"__{c}" for c in LEAF]
    rows = attach(leaves(docs, recipe), plan.toDF(*keys, "epochs", "cut_h", "cut_n"), keys).where("epochs IS NOT NULL")
    rows = rows.withColumn("__uses", _uses(recipe, F.col("__id"), F.col("__n"))).where("__uses > 0").withColumn("__use", F.explode(F.expr("sequence(1L, __uses)")))
    return rows.select(*[f"__own_{i}" for i in range(len(docs.columns))]).toDF(*docs.columns)


def oracle(recipe: Recipe = RECIPE) -> str:
    """DuckDB SQL for ``selected`` over documents."""
    parts = [f"""WITH d AS (
  SELECT doc_id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS n FROM documents),
r AS (SELECT *, {recipe.domain_sql} AS domain FROM d),
l0 AS (SELECT domain, lang, source, CAST(sum(n) AS BIGINT) AS tokens FROM r GROUP BY ALL HAVING sum(n) > 0),
n0 AS (SELECT *, tokens * {recipe.epochs} AS room, CAST(sum(tokens) OVER () AS BIGINT) * {recipe.tenths} // 10 AS budget_0 FROM l0)"""]
    for k, level in enumerate(LEAF):
        path, above = ", ".join(LEAF[: k + 1]), f"PARTITION BY {', '.join(LEAF[:k])}" if k else ""
        before = f"OVER ({above} ORDER BY r / w, {level} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)"
        parts.append(f"""a{k} AS (SELECT {path}, CAST(sum(room) AS BIGINT) AS r, max(budget_{k}) AS b, CAST({recipe.weight_sql(level)} AS BIGINT) AS w FROM n{k} GROUP BY {path}),
b{k} AS (SELECT *, coalesce(sum(r) {before}, 0) AS r_before, sum(w) OVER ({above}) - coalesce(sum(w) {before}, 0) AS w_left FROM a{k} WHERE w > 0 AND r > 0),
c{k} AS (SELECT *, r * w_left <= w * (b - r_before) AS filled FROM b{k}),
e{k} AS (SELECT *, coalesce(sum(CASE WHEN filled THEN r END) OVER ({above}), 0) AS r_full, coalesce(sum(CASE WHEN NOT filled THEN w END) OVER ({above}), 1) AS w_open FROM c{k}),
n{k + 1} AS (SELECT n{k}.*, CAST(CASE WHEN filled THEN r ELSE (w * (b - r_full)) // w_open END AS BIGINT) AS budget_{k + 1} FROM n{k} JOIN e{k} USING ({path}))""")
    parts.append(f"""p AS (SELECT domain, lang, source, budget_3 // tokens AS epochs, budget_3 % tokens AS rest FROM n3),
x AS (SELECT r.*, epochs, rest, md5('{recipe.seed}:' || epochs || ':' || coalesce(CAST(doc_id AS VARCHAR), '')) AS h FROM r JOIN p USING (domain, lang, source)),
y AS (SELECT *, epochs + CASE WHEN sum(n) OVER (PARTITION BY domain, lang, source ORDER BY h, n) <= rest THEN 1 ELSE 0 END AS uses FROM x)
SELECT doc_id, domain, lang, source, CAST(n AS BIGINT) AS n_tokens, CAST(unnest(range(0, uses)) AS BIGINT) AS epoch FROM y""")
    return ",\n".join(parts)
