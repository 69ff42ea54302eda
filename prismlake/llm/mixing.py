"""Mixing sources to target weights by iterative proportional fitting.

Tokens are summed by cell (source, language, topic); cell weights are raked in
turn to the target marginals of each and trimmed to what the cell has, so that
weight / tokens is a probability. Documents are then sampled by it, by a hash
of their id.

Default targets flatten each marginal: a share grows with the TEMPER-th power
of its tokens. Documents without a topic column get one from their layout
(``layout_topic``).

Defined results: null source, language or topic is a value of its own, shown as
(none), and a value that reads so is shown with a backslash before it; null
and empty texts have no tokens and their cell's probability (1 if the cell has
no tokens); rows that repeat with one id share one decision; an empty table
gives an empty result; other columns pass through ``sample``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import materialise

TEMPER = 0.5
#: Share of all tokens to sample.
KEEP = 0.7
ROUNDS = 12
#: Cells up to this many are broadcast to the documents; more are joined by a shuffle.
BROADCAST_CELLS = 100_000
DIMENSIONS = ("source", "lang", "topic")
_NONE = "(none)"


def shown(value: Column) -> Column:
    """A value as text: null as _NONE, and values that read so, with any backslashes before it, with one more."""
    text = value.cast("string")
    return F.coalesce(F.when(text.rlike(r"^\\*\(none\)$"), F.concat(F.lit("\\"), text)).otherwise(text), F.lit(_NONE))


def token_count(text: Column) -> Column:
    return F.size(F.array_remove(F.split(text, r"[\x20\x09-\x0D]+"), "")).cast("long")


def layout_topic(text: Column, tokens: Column) -> Column:
    """A stand-in for a topic: tables, symbols, capitals, else notes, articles and books by length."""
    count = lambda signs: F.length(text) - F.length(F.regexp_replace(text, signs, ""))
    return (
        F.when(tokens == 0, "empty")
        .when(count("[|]") * 10 > tokens, "table")
        .when(count("[#*$%&]") * 10 > tokens, "symbols")
        .when(count("[A-Z]") > 3 * tokens, "capitals")
        .when(tokens < 100, "note")
        .when(tokens < 1000, "article")
        .otherwise("book")
    )


def described(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(row, id, source, lang, topic, tokens); row holds all columns of ``docs``, so that no name clashes."""
    row = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("row"))
    text = F.coalesce(F.col("row")[text_col].cast("string"), F.lit(""))
    counted = row.withColumn("tokens", token_count(text))
    topic = F.col("row")["topic"] if "topic" in docs.columns else layout_topic(text, F.col("tokens"))
    known = {"source": F.col("row")["source"], "lang": F.col("row")["lang"], "topic": topic}
    return counted.select("row", F.col("row")[id_col].alias("id"), *[shown(c).alias(n) for n, c in known.items()], "tokens")


def raked(cells: DataFrame, targets: dict[str, dict[str, float]] | None = None, keep: float = KEEP, rounds: int = ROUNDS) -> DataFrame:
    """Cells (source, lang, topic, tokens) with their probability.

    ``targets`` may give shares of token weight for values of any dimension;
    values that it lacks have none. The whole of the work is windows over cells.
    """
    spark = cells.sparkSession
    out = cells.where("tokens > 0")
    total = cells.agg(F.sum("tokens").alias("t")).first()["t"] or 0
    if not total:
        return cells.select(*DIMENSIONS, F.lit(1.0).alias("probability"))
    for d in DIMENSIONS:
        if targets and d in targets:
            given = spark.createDataFrame([(k, float(v)) for k, v in targets[d].items()], f"{d} string, _t{d} double")
            out = out.join(F.broadcast(given), d, "left").withColumn(f"_t{d}", F.coalesce(f"_t{d}", F.lit(0.0)))
        else:
            shares = cells.where("tokens > 0").groupBy(d).agg(F.pow(F.sum("tokens").cast("double"), F.lit(TEMPER)).alias(f"_t{d}"))
            norm = shares.agg(F.sum(f"_t{d}").alias("s")).first()["s"]
            out = out.join(shares.withColumn(f"_t{d}", F.col(f"_t{d}") / norm), d)
    out = materialise(out.withColumn("w", F.col("tokens") * F.lit(float(keep))), "cells")
    for k in range(rounds):
        for d in DIMENSIONS:
            have = F.sum("w").over(Window.partitionBy(d))
            out = out.withColumn("w", F.least(F.col("tokens").cast("double"), F.when(have > 0, F.col("w") * (F.lit(float(keep) * total) * F.col(f"_t{d}") / have)).otherwise(0.0)))
        if k % 3 == 2:
            out = materialise(out, "cells")
    fitted = out.select(*DIMENSIONS, (F.col("w") / F.col("tokens")).alias("probability"))
    empty = cells.where("tokens = 0").select(*DIMENSIONS, F.lit(1.0).alias("probability"))
    return materialise(fitted.unionByName(empty), "cells")


def draw(id_col: Column) -> Column:
    """A number in [0, 1) from a document's id."""
    return F.conv(F.substring(F.md5(F.coalesce(id_col.cast("string"), F.lit("")).cast("binary")), 1, 13), 16, 10).cast("double") / float(16**13)


def weighted(given: DataFrame, rows: DataFrame, targets: dict | None = None, keep: float = KEEP) -> DataFrame:
    """``given`` (described) with probability and kept; ``rows`` has dimensions and tokens of all documents."""
    cells = materialise(rows.groupBy(*DIMENSIONS).agg(F.sum("tokens").alias("tokens")), "cells")
    fitted = raked(cells, targets, keep)
    n = fitted.count()
    return given.join(F.broadcast(fitted) if n <= BROADCAST_CELLS else fitted, list(DIMENSIONS)).withColumn("kept", draw(F.col("id")) < F.col("probability"))


def probabilities(docs: DataFrame, targets: dict | None = None, keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per row: id, source, lang, topic, tokens, probability, kept."""
    rows = materialise(described(docs, id_col, text_col).drop("row"), "mix-rows")
    return weighted(rows, rows, targets, keep).select(F.col("id").alias(id_col), *DIMENSIONS, "tokens", "probability", "kept")


def sample(docs: DataFrame, targets: dict | None = None, keep: float = KEEP, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The sampled documents with all their columns."""
    # whole texts are tokenised once: their rows go on with tokens and cell
    given = materialise(described(docs, id_col, text_col), "mix-rows", "zstd")
    return weighted(given, given.drop("row"), targets, keep).where("kept").select("row.*")
