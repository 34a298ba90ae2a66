"""Mixing sources to target weights by hierarchical budgeting; DataFrame operations only.

A token budget runs down the tree domain > language > source. At each node the children share its budget by weight,
but none gets more than its capacity, the tokens of its leaves times `max_epochs`; what a child can't take goes to its
siblings in proportion to their weights. A child's capacity is that of its whole subtree, so a shortage reaches the
parent's siblings only when the parent's own children can't take it. A leaf with budget B and A tokens takes every
document B div A times and, in the order of a hash seeded by the epoch, the prefix of B mod A tokens of the next epoch.

The prefix of a leaf is found by token sums of hash ranges: the range in which the prefix ends is split by the next byte
of the hash until it holds few rows, and only those are put in order. The tables of leaves, a row each, are broadcast if
they are small. So a leaf with a third of all rows is never gathered in one task.

Budgets are whole numbers, rounded down. Null domains, languages and sources count as `unknown`; a text's tokens are
its words, none for null. Documents without tokens and children of weight 0 get nothing. Repeated rows count each.
Ties in the order (repeated ids) go to the shorter document first. Other columns, whatever their names, are left alone.
An empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import Workspace, sized

LEVELS = ("domain", "lang", "source")
#: Rows of a leaf that one task puts in order.
FEW = 4096
WORDS = "[^\\x20\\x09-\\x0D]+"


def weight_of(column: str, weights: dict[str, int], default: int) -> F.Column:
    w = F.lit(default)
    for name, x in weights.items():
        w = F.when(F.col(column) == name, F.lit(int(x))).otherwise(w)
    return w.cast("long")


def share(df: DataFrame, parents: tuple[str, ...], name: str) -> DataFrame:
    """Adds `share`: the parent's `budget` split among children by `w` up to their `cap`.

    In order of cap/w, a child is full if its capacity is at most its weight's part of what the children before left;
    the rest of the budget is split among the others by weight.
    """
    p = Window.partitionBy(*[F.col(x) for x in parents]) if parents else Window.partitionBy(F.lit(0))
    o = p.orderBy(F.col("cap") / F.when(F.col("w") > 0, F.col("w")), F.col(name))
    before, after = o.rowsBetween(Window.unboundedPreceding, -1), o.rowsBetween(0, Window.unboundedFollowing)
    df = df.where("w > 0").withColumns({"s": F.coalesce(F.sum("cap").over(before), F.lit(0)), "r": F.sum("w").over(after)})
    df = df.withColumn("full", F.col("cap") * F.col("r") <= F.col("w") * (F.col("budget") - F.col("s")))
    held = F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(p), F.lit(0))
    open_w = F.sum(F.when(~F.col("full"), F.col("w"))).over(p)
    df = df.withColumns({"held": held, "open_w": open_w})
    part = F.expr("(w * (budget - held)) div open_w")
    return df.withColumn("share", F.when(F.col("full"), F.col("cap")).otherwise(part)).drop("s", "r", "full", "held", "open_w")


def leaf_budgets(leaves: DataFrame, budget: F.Column, weights: dict[str, dict[str, int]], max_epochs: int,
                 default: int = 1) -> DataFrame:
    """(domain, lang, source, tokens, share) from the tokens of each leaf; `budget` is over the column `total`."""
    base = leaves.where("tokens > 0").withColumn("cap", F.col("tokens") * max_epochs)
    top = base.groupBy().agg(F.coalesce(F.sum("tokens"), F.lit(0)).alias("total")).select(budget.cast("long").alias("budget"))
    spread = None
    for depth in (1, 2, 3):
        keys, parents = LEVELS[:depth], LEVELS[: depth - 1]
        here = base.groupBy(*keys).agg(F.sum("cap").alias("cap"))
        here = here.crossJoin(F.broadcast(top)) if spread is None else here.join(spread, list(parents))  # top is one row
        here = here.withColumn("w", weight_of(keys[-1], weights.get(keys[-1], {}), default))
        spread = share(here, parents, keys[-1]).select(*keys, F.col("share").alias("budget"))
    return base.select(*LEVELS, "tokens").join(spread.withColumnRenamed("budget", "share"), list(LEVELS))


def mix_sources(docs: DataFrame, domain: F.Column, weights: dict[str, dict[str, int]], *, budget: F.Column | None = None,
                max_epochs: int = 4, seed: int = 42, id_col: str = "doc_id", text_col: str = "text",
                lang_col: str = "lang", source_col: str = "source", name: str = "mix", few: int = FEW) -> DataFrame:
    """(id, domain, lang, source, n_tokens, full_epochs, prefix_tokens, taken_tokens) of every document that is taken."""
    ws = Workspace(docs.sparkSession, name)
    d = ws.stage(docs.select(
        F.col(id_col).alias("id"), F.coalesce(domain, F.lit("unknown")).alias("domain"),
        F.coalesce(F.col(lang_col).cast("string"), F.lit("unknown")).alias("lang"),
        F.coalesce(F.col(source_col).cast("string"), F.lit("unknown")).alias("source"),
        F.coalesce(F.regexp_count(F.col(text_col), F.lit(WORDS)), F.lit(0)).cast("long").alias("n_tokens")))
    leaves = d.groupBy(*LEVELS).agg(F.sum("n_tokens").alias("tokens"))
    got = leaf_budgets(leaves, F.col("total") if budget is None else budget, weights, max_epochs)
    got = ws.stage(got.select(*LEVELS, F.expr("share div tokens").alias("full_epochs"), F.expr("share % tokens").alias("part")))

    got = sized(got)
    order = F.unhex(F.md5(F.concat_ws(":", F.lit(seed), F.col("full_epochs"), F.coalesce(F.col("id").cast("string"), F.lit(""))).cast("binary")))
    e = d.where("n_tokens > 0").join(got, list(LEVELS)).withColumn("h", order)
    w = Window.partitionBy(*LEVELS).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    ends, depth, inside = None, 0, e.where("part > 0").withColumn("start", F.lit(0).cast("long"))
    while True:  # a byte of the hash at a time, until the range in which a prefix ends holds few rows
        depth += 1
        ranges = inside.groupBy(*LEVELS, "part", "start", F.substring("h", 1, depth).alias("range")).agg(F.sum("n_tokens").alias("n"), F.count("*").alias("rows"))
        ranges = ranges.withColumn("before", F.col("start") + F.coalesce(F.sum("n").over(w), F.lit(0)))
        ends = ws.stage(ranges.where("before < part and part <= before + n").select(*LEVELS, F.col("range").alias("end"), "before", "rows"))
        if depth == 16 or (ends.agg(F.max("rows")).first()[0] or 0) <= few:
            break
        at = sized(ends.select(*LEVELS, "end", F.col("before").alias("start")))
        inside = e.join(at, list(LEVELS)).where(F.substring("h", 1, depth) == F.col("end")).drop("end")
    e = e.withColumn("range", F.substring("h", 1, depth)).join(sized(ends), list(LEVELS), "left")
    whole = e.where("end is null or range <> end").withColumn(
        "prefix_tokens", F.when(F.col("range") < F.col("end"), F.col("n_tokens")).otherwise(F.lit(0)))
    run = Window.partitionBy(*LEVELS).orderBy("h", "id", "n_tokens").rowsBetween(Window.unboundedPreceding, -1)
    last = e.where("range = end").withColumn("b", F.col("before") + F.coalesce(F.sum("n_tokens").over(run), F.lit(0)))
    last = last.withColumn("prefix_tokens", F.greatest(F.lit(0), F.least(F.col("n_tokens"), F.col("part") - F.col("b"))))
    cols = [F.col("id").alias(id_col), *LEVELS, "n_tokens", "full_epochs", F.col("prefix_tokens").cast("long").alias("prefix_tokens"),
            (F.col("full_epochs") * F.col("n_tokens") + F.col("prefix_tokens")).cast("long").alias("taken_tokens")]
    return whole.select(*cols).union(last.select(*cols)).where("taken_tokens > 0")


#: The production mixture of the query: shares by level, other names weigh 1.
WEIGHTS = {"domain": {"d0": 4, "d1": 3, "d2": 2, "d3": 1}, "lang": {"en": 40, "fr": 25, "de": 20, "es": 15}, "source": {"src0": 2}}
MAX_EPOCHS, SEED = 4, 42


def source_domain(source: F.Column) -> F.Column:
    """Four domains by a hash of the source."""
    return F.concat(F.lit("d"), F.translate(F.substring(F.md5(source.cast("binary")), 1, 1), "0123456789abcdef", "0000111122223333"))


def _sql_level(level: int) -> str:
    keys, parents = LEVELS[:level], LEVELS[: level - 1]
    k, name = ", ".join(keys), keys[-1]
    over = f"PARTITION BY {', '.join(parents)}" if parents else ""
    w = "CASE " + " ".join(f"WHEN {name} = '{n}' THEN {x}" for n, x in WEIGHTS[name].items()) + " ELSE 1 END"
    source = f"SELECT {k}, sum(cap)::BIGINT AS cap FROM base GROUP BY {k}"
    source = (f"SELECT h.*, t.budget FROM ({source}) h CROSS JOIN top t" if not parents else
              f"SELECT h.*, s.budget FROM ({source}) h JOIN s{level - 1} s USING ({', '.join(parents)})")
    return f"""
a{level} AS (SELECT *, ({w})::BIGINT AS w FROM ({source})),
b{level} AS (SELECT *, coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS s,
   sum(w) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)::BIGINT AS r FROM a{level} WINDOW o AS ({over} ORDER BY cap / w, {name})),
c{level} AS (SELECT *, cap::HUGEINT * r <= w::HUGEINT * (budget - s) AS full_ FROM b{level}),
s{level} AS (SELECT {k}, CASE WHEN full_ THEN cap ELSE (w * (budget - coalesce(sum(CASE WHEN full_ THEN cap END) OVER ({over}), 0)::BIGINT))
   // sum(CASE WHEN NOT full_ THEN w END) OVER ({over})::BIGINT END::BIGINT AS budget FROM c{level})"""


MIX_SQL = f"""WITH d AS (SELECT doc_id AS id,
   coalesce('d' || translate(substr(md5(source), 1, 1), '0123456789abcdef', '0000111122223333'), 'unknown') AS domain,
   coalesce(lang, 'unknown') AS lang, coalesce(source, 'unknown') AS source,
   coalesce(len(regexp_extract_all(text, '[^\\x20\\x09-\\x0D]+')), 0)::BIGINT AS n_tokens FROM documents),
leaf AS (SELECT domain, lang, source, sum(n_tokens)::BIGINT AS tokens FROM d GROUP BY ALL),
base AS (SELECT *, tokens * {MAX_EPOCHS} AS cap FROM leaf WHERE tokens > 0),
top AS (SELECT coalesce(sum(tokens), 0)::BIGINT AS budget FROM base),{_sql_level(1)},{_sql_level(2)},{_sql_level(3)},
got AS (SELECT domain, lang, source, s.budget // b.tokens AS full_epochs, s.budget % b.tokens AS part
   FROM base b JOIN s3 s USING (domain, lang, source)),
e AS (SELECT d.*, full_epochs, part, md5('{SEED}:' || full_epochs || ':' || coalesce(id::VARCHAR, '')) AS h
   FROM d JOIN got USING (domain, lang, source) WHERE n_tokens > 0),
f AS (SELECT *, greatest(0, least(n_tokens, part - coalesce(sum(n_tokens) OVER (PARTITION BY domain, lang, source
   ORDER BY h, id, n_tokens ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT)) AS prefix_tokens FROM e)
SELECT id AS doc_id, domain, lang, source, n_tokens, full_epochs, prefix_tokens,
   (full_epochs * n_tokens + prefix_tokens)::BIGINT AS taken_tokens FROM f WHERE full_epochs * n_tokens + prefix_tokens > 0"""
