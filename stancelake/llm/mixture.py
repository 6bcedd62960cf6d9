"""Mixing sources to target weights by hierarchical budgeting.

Documents are leaves' rows of a tree domain - language - source. A token budget goes down the tree in
proportion to integer node weights. A node can use its rows' tokens at most `epochs` times; what a child
cannot use is shared out among its siblings by their weights, and only when the whole family is exhausted is
its parent short, whose own siblings then get the rest, and so on upwards. All amounts are whole tokens.

A leaf takes whole epochs as far as its budget goes, then the token-prefix of one more epoch: the rows in the
order of a seeded hash of epoch and id, the last of them cut where the budget ends. The order is never sorted
as a whole: hash ranges of a leaf are summed first, so a source that holds a third of all rows is cut into
RANGES parts, each of which is ordered by itself.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from stancelake.llm import graph

#: Parts that the hash range of one leaf is cut into: the first three hexadecimal digits.
RANGES = 4096

#: A token is a run of other characters than white space.
TOKEN = r"[^ \t\n\x0B\f\r]+"

LEVELS = ("domain", "lang", "source")


def n_tokens(text: Column) -> Column:
    """Tokens of a text; zero for null."""
    return F.coalesce(F.regexp_count(text, F.lit(TOKEN)), F.lit(0)).cast("bigint")


def _weight(path: list[str], weights: dict[str, int]) -> Column:
    name = F.concat_ws("/", *path)
    out = F.lit(1)
    for key, value in weights.items():
        out = F.when(name == key, F.lit(value)).otherwise(out)
    return out.cast("bigint")


def shared_out(rows: DataFrame, family: list[str], budget: str, cap: str, weight: str, name: str, out: str) -> DataFrame:
    """Adds each row's share of its family's budget: at most its cap, else in proportion to its weight.

    In the order of cap / weight, the full ones are a prefix: a row is full if it would be so with all rows
    before it full. Tokens lost to rounding go one each to the first rows, by name, that are not full.
    """
    ratio = (F.col(cap).cast("double") / F.col(weight)).alias("ratio")
    order = Window.partitionBy(*family).orderBy("ratio", name)
    before = F.coalesce(F.sum(cap).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    here_on = F.sum(weight).over(order.rowsBetween(0, Window.unboundedFollowing))
    rows = rows.select("*", ratio).select("*", before.alias("before"), here_on.alias("here_on"))
    wide = lambda x: x.cast("decimal(19,0)")  # noqa: E731  products of tokens and weights are beyond 64 bits
    rows = rows.withColumn("full", wide(F.col(cap)) * wide(F.col("here_on")) <= wide(F.col(weight)) * wide(F.col(budget) - F.col("before")))
    whole = Window.partitionBy(*family)
    left = F.col(budget) - F.coalesce(F.sum(F.when(F.col("full"), F.col(cap))).over(whole), F.lit(0))
    shares = F.coalesce(F.sum(F.when(~F.col("full"), F.col(weight))).over(whole), F.lit(1))
    rows = rows.select("*", left.alias("left"), shares.alias("shares"))
    rows = rows.withColumn("share", F.when(F.col("full"), F.col(cap)).otherwise(F.expr(f"(cast({weight} as decimal(19,0)) * cast(left as decimal(19,0))) div shares")))
    spare = F.col("left") - F.coalesce(F.sum(F.when(~F.col("full"), F.col("share"))).over(whole), F.lit(0))
    rank = F.row_number().over(Window.partitionBy(*family, "full").orderBy(name))
    rows = rows.select("*", spare.alias("spare"), rank.alias("rank"))
    final = F.col("share") + F.when(~F.col("full") & (F.col("rank") <= F.col("spare")), 1).otherwise(0)
    return rows.withColumn(out, final.cast("bigint")).drop("ratio", "before", "here_on", "full", "left", "shares", "share", "spare", "rank")


def budgets(leaves: DataFrame, total: Column, weights: dict[str, int], epochs: int) -> DataFrame:
    """domain, lang, source, tokens and budget of every leaf (domain, lang, source, tokens).

    `total` is an aggregate over the leaves' tokens. Weights are positive whole numbers up to 10,000 by path
    ("web", "web/en", "web/en/src1"); other nodes have 1. A total above all that can be used is cut to that.
    """
    up = leaves.withColumn("cap2", F.col("tokens") * epochs)
    langs = up.groupBy("domain", "lang").agg(F.sum("cap2").alias("cap1"))
    domains = langs.groupBy("domain").agg(F.sum("cap1").alias("cap0"))
    top = leaves.agg(total.cast("bigint").alias("wanted"), (F.sum("tokens") * epochs).alias("most")).select(F.least("wanted", "most").alias("total"))
    level0 = domains.crossJoin(F.broadcast(top)).select("*", _weight(["domain"], weights).alias("weight0"), F.lit(0).alias("root"))
    level0 = shared_out(level0, ["root"], "total", "cap0", "weight0", "domain", "budget0").select("domain", "budget0")
    level1 = langs.join(level0, "domain").withColumn("weight1", _weight(["domain", "lang"], weights))
    level1 = shared_out(level1, ["domain"], "budget0", "cap1", "weight1", "lang", "budget1").select("domain", "lang", "budget1")
    level2 = up.join(level1, ["domain", "lang"]).withColumn("weight2", _weight(["domain", "lang", "source"], weights))
    level2 = shared_out(level2, ["domain", "lang"], "budget1", "cap2", "weight2", "source", "budget")
    return level2.select(*LEVELS, "tokens", "budget")


def mix(documents: DataFrame, domain: Column, weights: dict[str, int], share: tuple[int, int] = (1, 2), epochs: int = 2, seed: int = 1, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of `documents`: id, domain, lang, source, n_tokens, epochs, prefix_tokens, taken_tokens.

    The budget is share[0] / share[1] of all tokens. epochs counts whole epochs; prefix_tokens are taken from the
    start of the text in one more. Null domains, languages and sources are empty strings. Rows without tokens,
    of null texts too, take nothing. Rows of the same id and size are alike; an empty table gives no rows.
    """
    rows = documents.select(
        F.col(id_col).alias("id"), F.coalesce(domain, F.lit("")).alias("domain"), F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source"), n_tokens(F.col(text_col)).alias("n_tokens")
    )
    rows = graph.cut(rows)
    leaves = rows.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    total = F.expr(f"(sum(tokens) * {share[0]}) div {share[1]}")
    plan = budgets(leaves, total, weights, epochs)
    usable = F.greatest("tokens", F.lit(1))
    plan = plan.select(*LEVELS, F.expr("budget div greatest(tokens, 1)").alias("epochs"), (F.col("budget") % usable).alias("rest"))
    plan = graph.cut(plan)
    rows = rows.join(plan, [*LEVELS])
    key = F.md5(F.concat_ws("/", F.lit(str(seed)), F.col("epochs").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(""))))
    rows = rows.withColumn("key", key).withColumn("part", F.substring("key", 1, 3))
    parts = rows.groupBy(*LEVELS, "part").agg(F.sum("n_tokens").alias("part_tokens"))
    ahead = Window.partitionBy(*LEVELS).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    parts = parts.select(*LEVELS, "part", F.coalesce(F.sum("part_tokens").over(ahead), F.lit(0)).alias("ahead"))
    within = Window.partitionBy(*LEVELS, "part").orderBy("key", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.join(parts, [*LEVELS, "part"]).withColumn("start", F.col("ahead") + F.coalesce(F.sum("n_tokens").over(within), F.lit(0)))
    prefix = F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("rest") - F.col("start"))).cast("bigint")
    rows = rows.withColumn("prefix_tokens", prefix)
    return rows.select(F.col("id").alias(id_col), *LEVELS, "n_tokens", "epochs", "prefix_tokens", (F.col("epochs") * F.col("n_tokens") + F.col("prefix_tokens")).alias("taken_tokens"))
