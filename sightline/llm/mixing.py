"""Mixing by iterative proportional fitting: token weights raked to marginals, documents drawn by calibrated chances."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .cluster import written

MARGINS = ["source", "lang", "topic"]
#: Cells above which the fit stays on the executors.
MOST_CELLS = 100_000
ROUNDS = 12
UNKNOWN = "unknown"


def n_tokens(text: str = "text") -> Column:
    """Runs of characters other than ASCII blanks."""
    return F.size(F.filter(F.split(F.coalesce(F.col(text), F.lit("")), "[ \t\n\u000b\f\r]+"), lambda w: w != "")).cast("long")


def topic(text: str = "text", tokens: str = "n_tokens") -> Column:
    """The kind of text: empty, tabular (a bar for every 4 tokens), marked (a sign of #%&*$ for every token), else brief, standard or long prose."""
    body = F.coalesce(F.col(text), F.lit(""))
    bars = F.length(body) - F.length(F.replace(body, F.lit("|"), F.lit("")))
    signs = F.length(body) - F.length(F.translate(body, "#%&*$", ""))
    n = F.col(tokens)
    return (
        F.when(n == 0, "empty").when(bars * 4 >= n, "tabular").when(signs >= n, "marked").when(n < 150, "brief").when(n < 800, "standard").otherwise("long")
    )


def targets(cells: pd.DataFrame, margin: str, power: float) -> pd.Series:
    """The target tokens of each value of a margin: its tokens to the power, scaled to the total."""
    tokens = cells.groupby(margin)["tokens"].sum().astype(float)
    shares = tokens**power
    return shares / shares.sum() * tokens.sum()


def rake(cells: pd.DataFrame, wanted: dict[str, pd.Series], rounds: int = ROUNDS) -> np.ndarray:
    """Weighted tokens of each cell: scaled to one margin after another, a fixed number of times."""
    fitted = cells["tokens"].to_numpy(dtype=float).copy()
    keys = {m: cells[m].map({v: k for k, v in enumerate(wanted[m].index)}).to_numpy() for m in wanted}
    for _ in range(rounds):
        for m, target in wanted.items():
            held = np.bincount(keys[m], weights=fitted, minlength=len(target))
            fitted *= (target.to_numpy() / np.where(held > 0, held, 1))[keys[m]]
    return fitted


def chances(tokens: np.ndarray, fitted: np.ndarray, budget: float) -> np.ndarray:
    """min(1, scale * fitted / tokens), with the scale at which the expected tokens are the budget.

    Cells are taken by falling weight: the certain ones are the first c for which
    the rest's scale leaves no more above 1.
    """
    out = np.zeros(len(tokens))
    some = np.flatnonzero(tokens > 0)
    weight = fitted[some] / tokens[some]
    order = np.lexsort((some, -weight))
    t, f, w = tokens[some][order].astype(float), fitted[some][order], weight[order]
    before = np.cumsum(t) - t
    rest = np.cumsum(f[::-1])[::-1]
    scale = np.maximum(budget - before, 0) / np.where(rest > 0, rest, 1)
    loose = np.flatnonzero(scale * w <= 1 + 1e-12)
    cut = loose[0] if len(loose) else len(w)
    p = np.ones(len(w))
    p[cut:] = np.minimum(1, scale[cut] * w[cut:]) if cut < len(w) else 1
    out[some[order]] = p
    return out


def _on_executors(cells: DataFrame, power: float, rounds: int) -> DataFrame:
    """The raked cells by DataFrame steps, each margin written to the shared folder."""
    now = written(cells.withColumn("fitted", F.col("tokens").cast("double")))
    wanted = {}
    for m in MARGINS:
        held = cells.groupBy(m).agg(F.sum("tokens").cast("double").alias("t"))
        total = held.agg(F.sum("t").alias("t"), F.sum(F.pow("t", F.lit(power))).alias("s")).first()
        wanted[m] = written(held.select(m, (F.pow("t", F.lit(power)) / F.lit(total["s"] or 1.0) * F.lit(total["t"] or 0.0)).alias("target")))
    for _ in range(rounds):
        for m in MARGINS:
            factor = now.groupBy(m).agg(F.sum("fitted").alias("held")).join(wanted[m], m)
            factor = factor.select(m, (F.col("target") / F.when(F.col("held") > 0, F.col("held")).otherwise(1.0)).alias("__f"))
            now = written(now.join(factor, m).withColumn("fitted", F.col("fitted") * F.col("__f")).drop("__f"))
    return now


def fit(cells: DataFrame, *, power: float, fraction: float, rounds: int = ROUNDS, most_cells: int = MOST_CELLS) -> DataFrame:
    """weight and chance of each cell (source, lang, topic, tokens).

    The table of cells is small whatever the corpus; should it have more than
    most_cells rows, the raking runs on the executors, and the certain cells are
    found by a search for the scale in place of a sort.
    """
    spark = cells.sparkSession
    cells = written(cells)
    schema = "source string, lang string, topic string, weight double, chance double"
    if cells.count() <= most_cells:
        held = cells.toPandas().sort_values(MARGINS).reset_index(drop=True)
        if not len(held):
            return spark.createDataFrame([], schema)
        fitted = rake(held, {m: targets(held, m, power) for m in MARGINS}, rounds)
        tokens = held["tokens"].to_numpy(dtype=float)
        held["weight"] = np.where(tokens > 0, fitted / np.where(tokens > 0, tokens, 1), 0.0)
        held["chance"] = chances(tokens, fitted, fraction * tokens.sum())
        return spark.createDataFrame(held[[*MARGINS, "weight", "chance"]], schema)
    raked = _on_executors(cells, power, rounds)
    raked = written(raked.withColumn("weight", F.when(F.col("tokens") > 0, F.col("fitted") / F.col("tokens")).otherwise(0.0)))
    total = raked.agg(F.sum("tokens")).first()[0] or 0
    low, high = 0.0, 1.0
    expected = lambda s: raked.agg(F.sum(F.least(F.lit(1.0), F.col("weight") * s) * F.col("tokens"))).first()[0] or 0.0
    while expected(high) < fraction * total * (1 - 1e-12) and high < 1e12:
        high *= 2
    for _ in range(60):
        mid = (low + high) / 2
        low, high = (mid, high) if expected(mid) < fraction * total else (low, mid)
    return raked.select(*MARGINS, "weight", F.least(F.lit(1.0), F.col("weight") * high).alias("chance"))


def draw(doc_id: str = "doc_id") -> Column:
    """A number in [0, 1) from the MD5 of the document's id."""
    return F.conv(F.substring(F.md5(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary")), 1, 8), 16, 10).cast("double") / float(1 << 32)


OWN = ["topic", "n_tokens", "weight", "chance", "drawn"]


def mixed(docs: DataFrame, *, power: float = 0.5, fraction: float = 0.5, rounds: int = ROUNDS, most_cells: int = MOST_CELLS, topics: Column | None = None, keep: list[str] | None = None) -> DataFrame:
    """docs with topic, n_tokens, weight, chance and drawn.

    The targets are the margins of source, language and topic with their tokens
    raised to `power`, scaled to all tokens; weights that meet them are raked in
    `rounds` rounds over the table of cells, and scaled so that the expected tokens
    drawn are `fraction` of all, no chance above 1. `topics` is an expression over
    docs that gives a document's topic, such as a column that a topic model has
    filled; without it the kind of text, topic(), stands in. A document is drawn if
    the hash of its doc_id lies below its cell's chance, so a draw can be repeated,
    and rows that repeat a doc_id in a cell share their lot. A null source,
    language or topic counts as `unknown`; a null or empty text has no tokens and
    chance 0; an empty table gives no rows. Columns of docs that have the names of
    the new ones are replaced, after `topics` has read them; names that begin with
    __sl_ are taken. `keep` names the columns of docs to return, all of them
    without it; if the text is not among them, texts are read once only.
    """
    given = topics if topics is not None else F.lit(None)
    base = docs.withColumns({"__sl_given": given.cast("string"), "__sl_n": n_tokens()})
    base = base.withColumn("__sl_topic", F.coalesce("__sl_given", F.lit(UNKNOWN)) if topics is not None else topic(tokens="__sl_n"))
    base = base.withColumns({f"__sl_{m}": F.coalesce(F.col(m).cast("string"), F.lit(UNKNOWN)) for m in MARGINS[:2]}).drop("__sl_given", *OWN)
    if keep is not None:
        base = base.select(*keep, "__sl_n", *[f"__sl_{m}" for m in MARGINS])
        base = base if "text" in keep else written(base)
    cells = base.groupBy(*[F.col(f"__sl_{m}").alias(m) for m in MARGINS]).agg(F.sum("__sl_n").alias("tokens"))
    fitted = fit(cells, power=power, fraction=fraction, rounds=rounds, most_cells=most_cells)
    fitted = fitted.select(*[F.col(m).alias(f"__sl_{m}") for m in MARGINS], "weight", "chance")
    out = base.join(fitted, [f"__sl_{m}" for m in MARGINS], "left").withColumnsRenamed({"__sl_topic": "topic", "__sl_n": "n_tokens"}).drop("__sl_source", "__sl_lang")
    return out.withColumn("drawn", draw() < F.col("chance"))


def sampled(docs: DataFrame, **parameters) -> DataFrame:
    """The rows of docs that mixed draws, with docs' own columns.

    Documents without tokens are never drawn; for all else see mixed.
    """
    kept = mixed(docs.withColumns({f"__sl_own_{c}": F.col(c) for c in OWN if c in docs.columns}), **parameters)
    return kept.where("drawn").select(*[F.col(f"__sl_own_{c}").alias(c) if c in OWN else F.col(c) for c in docs.columns])


def oracle(table: str, *, power: float, fraction: float, rounds: int = ROUNDS) -> str:
    """DuckDB SQL for op1: the same cells, raking unrolled into nested windows, and draw."""
    text = "coalesce(text, '')"
    steps = "cells"
    sql = [
        f"""WITH base AS (SELECT doc_id, source, lang, len(regexp_extract_all({text}, '[^ \\t\\n\\v\\f\\r]+')) AS n_tokens,
  length({text}) - length(replace({text}, '|', '')) AS bars, length({text}) - length(regexp_replace({text}, '[#%&*$]', '', 'g')) AS signs FROM {table}),
kinds AS (SELECT doc_id, source, lang, n_tokens, coalesce(source, '{UNKNOWN}') AS s, coalesce(lang, '{UNKNOWN}') AS l, CASE WHEN n_tokens = 0 THEN 'empty' WHEN bars * 4 >= n_tokens THEN 'tabular'
  WHEN signs >= n_tokens THEN 'marked' WHEN n_tokens < 150 THEN 'brief' WHEN n_tokens < 800 THEN 'standard' ELSE 'long' END AS topic FROM base),
sums AS (SELECT s, l, topic, sum(n_tokens)::DOUBLE AS tokens FROM kinds GROUP BY ALL),
goals AS (SELECT *, sum(tokens) OVER () AS total, {', '.join(f'sum(tokens) OVER (PARTITION BY {m}) AS m_{m}' for m in ('s', 'l', 'topic'))} FROM sums),"""
    ]
    for m in ("s", "l", "topic"):
        sql.append(f"g_{m} AS (SELECT {m}, pow(any_value(m_{m}), {power}) AS r FROM goals GROUP BY {m}),")
    joins = " ".join(f"JOIN (SELECT {m}, r / (SELECT sum(r) FROM g_{m}) AS share FROM g_{m}) x_{m} USING ({m})" for m in ("s", "l", "topic"))
    sql.append(f"{steps} AS MATERIALIZED (SELECT s, l, topic, tokens, total, tokens AS f, {', '.join(f'x_{m}.share * total AS t_{m}' for m in ('s', 'l', 'topic'))} FROM goals {joins}),")
    for r in range(rounds):
        for m in ("s", "l", "topic"):
            held = f"sum(f) OVER (PARTITION BY {m})"
            sql.append(f"r{r}_{m} AS MATERIALIZED (SELECT * REPLACE (f * (t_{m} / CASE WHEN {held} > 0 THEN {held} ELSE 1 END) AS f) FROM {steps}),")
            steps = f"r{r}_{m}"
    sql.append(
        f"""weighed AS (SELECT s, l, topic, tokens, total, f, f / tokens AS w FROM {steps} WHERE tokens > 0),
ranked AS (SELECT *, row_number() OVER (ORDER BY w DESC, s, l, topic) AS k FROM weighed),
scaled AS (SELECT *, greatest({fraction} * total - (sum(tokens) OVER (ORDER BY k) - tokens), 0) / (sum(f) OVER (ORDER BY k DESC)) AS scale FROM ranked),
first AS (SELECT min(k) AS k FROM scaled WHERE scale * w <= 1 + 1e-12),
chances AS (SELECT s, l, topic, w, CASE WHEN k < coalesce((SELECT k FROM first), 1000000000) THEN 1.0 ELSE least(1.0, (SELECT scale FROM scaled JOIN first USING (k)) * w) END AS p FROM scaled)
SELECT doc_id, source, lang, topic, n_tokens, round(coalesce(w, 0), 6) AS weight, round(coalesce(p, 0), 6) AS chance,
  ('0x' || substr(md5(coalesce(doc_id::VARCHAR, '')), 1, 8))::UBIGINT / 4294967296.0 < coalesce(p, 0) AS drawn
FROM kinds LEFT JOIN chances USING (s, l, topic)"""
    )
    return "\n".join(sql)
