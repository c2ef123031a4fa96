"""Mixing sources to target weights: every document is repeated a Poisson number of times.

The rate of a document is its source's share of the wanted mixture divided by the source's size. The number of copies
inverts the Poisson distribution at a number in [0, 1) hashed from seed, id, source and text, so a rerun, also of a lost
task, gives the same mixture. A rate above `CHUNK` is cut into equal parts with a number each, which leaves the distribution as it
is and keeps every table of probabilities and every exploded array short.

Edge cases: a null source is a source of its own; a null or empty text is a document like any other; rows that share an
id, or have none, are drawn and placed by their own source and text, so that only exact repeats get equal counts; sources without a given weight get weight 0 if weights are given; an
empty table gives an empty one. Columns named like an output (`copy`, `rate`, `shuffle_key`) are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowloom.llm.common import fresh, narrow, quoted, saved, unit_hash

CHUNK = 16.0
SEED = 8
#: Exponent of the sizes in the default weights: 1 keeps the sources' shares, 0 makes them equal.
FLATTEN = 0.5


def poisson_inverse(rate: Column, u: Column) -> Column:
    """Smallest k with P(X <= k) > u for X ~ Poisson(rate), for rates up to `CHUNK`."""
    last = int(CHUNK + 12 * CHUNK**0.5 + 30)
    step = F.aggregate(
        F.sequence(F.lit(1), F.lit(last)),
        F.struct(F.exp(-rate).alias("p"), F.exp(-rate).alias("c"), F.when(u < F.exp(-rate), 0).otherwise(1).alias("k")),
        lambda s, i: F.struct(
            (s.p * rate / i).alias("p"),
            (s.c + s.p * rate / i).alias("c"),
            (s.k + F.when(u >= s.c + s.p * rate / i, 1).otherwise(0)).alias("k"),
        ),
    )
    return step.k


def rates(docs: DataFrame, source: str, total: float | None, weights: dict[str, float] | None) -> DataFrame:
    """(_source, _rate) per source; `_source` is null for documents without one."""
    sizes = docs.groupBy(F.col(quoted(source)).alias("_source")).agg(F.count(F.lit(1)).cast("double").alias("_n"))
    if weights is None:
        weighted = sizes.withColumn("_w", F.pow("_n", F.lit(FLATTEN)))
    else:
        given = F.create_map(*[x for k, v in weights.items() for x in (F.lit(k), F.lit(float(v)))])
        weighted = sizes.withColumn("_w", F.coalesce(given[F.col("_source")], F.lit(0.0)))
    sums = weighted.agg(F.sum("_w").alias("_all"), F.sum("_n").alias("_total"))
    wanted = F.lit(float(total)) if total is not None else F.col("_total")
    rate = F.when(F.col("_all") > 0, F.col("_w") / F.col("_all") * wanted / F.col("_n")).otherwise(F.lit(0.0))
    return weighted.join(F.broadcast(sums)).select("_source", rate.alias("_rate"))


def mix(
    docs: DataFrame,
    weights: dict[str, float] | None = None,
    total: float | None = None,
    source: str = "source",
    key: str = "doc_id",
    text: str = "text",
    seed: int = SEED,
) -> DataFrame:
    """`docs` repeated to the target mixture in a random order, with `copy` (from 1), `rate` and `shuffle_key`.

    `weights` are the sources' shares of the output (default: size ** FLATTEN), `total` the expected number of output
    documents (default: as many as there are). The order is that of the partitions and of `shuffle_key` inside them.
    """
    added = ("copy", "rate", "shuffle_key")
    kept = [c for c in docs.columns if c.lower() not in added]
    names = {n: fresh(docs, f"_mix_{n}") for n in ("source", "rate", "part", "n", "mark")}
    lookup = narrow(saved(rates(docs, source, total, weights), "rates")).select(
        F.col("_source").alias(names["source"]), F.col("_rate").alias(names["rate"])
    )
    # the text's hash is a column of its own below the explosion, so that it is taken once a row
    rows = docs.select(*[F.col(quoted(c)) for c in kept], F.md5(F.col(quoted(text))).alias(names["mark"]))
    rated = rows.join(lookup, rows[quoted(source)].eqNullSafe(F.col(names["source"])), "left")
    content = [F.col(quoted(source)), F.col(names["mark"])]
    rate, part = F.col(names["rate"]), F.col(names["part"])
    parts = F.greatest(F.ceil(rate / F.lit(CHUNK)), F.lit(1)).cast("long")
    chunked = rated.withColumn(names["part"], F.explode(F.sequence(F.lit(1).cast("long"), parts)))
    count = poisson_inverse(rate / parts, unit_hash(seed, F.col(quoted(key)), part, *content))
    copies = chunked.withColumn(names["n"], count).filter(F.col(names["n"]) > 0)
    repeated = copies.select(
        *[F.col(quoted(c)) for c in kept], names["mark"], part, rate.alias("rate"), F.explode(F.sequence(F.lit(1), F.col(names["n"]))).alias("copy")
    )
    # A part holds far fewer than 1000 copies, so this number is the copy's own.
    numbered = repeated.withColumn("copy", ((part - 1) * 1000 + F.col("copy")).cast("long"))
    order = F.xxhash64(F.lit(f"order {seed}"), F.col(quoted(key)), F.col("copy"), *content)
    out = numbered.select(*[F.col(quoted(c)) for c in kept], "copy", "rate", order.alias("shuffle_key"))
    return out.repartition(F.col("shuffle_key")).sortWithinPartitions("shuffle_key")
