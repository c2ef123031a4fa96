"""Vocabularies, label maps, class weights and field encoding."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from flowloom.functions.scalars import hex_to_long, log_scale, norm_hex, octets, port_bin, tsval, unit_noise
from flowloom.operators.flows import factorize, first_rows
from flowloom.scale import (
    BROADCAST_ROWS,
    FEW_KEYS,
    c,
    digest,
    rank_by_number,
    skew_join,
    small_side,
    sorted_rank,
    unit_uniform,
)
from flowloom.session import durable, stored

OOV = "__OOV__"
PORT_FIELDS = ("tcp.srcport", "tcp.dstport")
DECIMAL_FIELDS = ("tcp.stream",)
TIMESTAMP_FIELD = "tcp.options.timestamp"


def build_vocab(df: DataFrame, fields: Sequence[str], variant: str = "v2") -> DataFrame:
    """(field, value, id) of the distinct normalised values per field, in value order.

    `v1` counts from 0 and gives unknown values the last id; `v2` counts from 1 and gives them 0. A field of the table
    without any value has only the row for unknown values. Values are made distinct and stored before they are ranked.
    More than a few thousand are ranked in ranges whose edges Spark samples from them, so neither a field with many
    values nor a common beginning of its values is sorted in one task.
    """
    present = [name for name in fields if name in df.columns]
    pairs = F.array(*[F.struct(F.lit(n).alias("field"), norm_hex(c(n), OOV).alias("value")) for n in present])
    values = df.select(F.explode(pairs).alias("p")).select("p.*").distinct().filter(F.col("value") != OOV.lower())
    first = 0 if variant == "v1" else 1
    values = stored(values, "values")
    if values.count() <= FEW_KEYS:
        in_field = F.row_number().over(Window.partitionBy("field").orderBy("value"))
        ranked = values.withColumn("_rank", in_field.cast("long"))
    else:
        # written down again, since sampled edges may differ when they are computed anew
        values = stored(values.repartitionByRange("field", "value").withColumn("_range", F.spark_partition_id()), "values")
        ranked = sorted_rank(values, [F.col("value")], F.col("_range"), within=["field"], name="_rank")
    ids = ranked.select("field", "value", (F.col("_rank") - 1 + first).alias("id"))
    sizes = values.groupBy("field").agg(F.count(F.lit(1)).alias("n"))
    names = df.sparkSession.createDataFrame([(n,) for n in present], "field string")
    last = F.coalesce("n", F.lit(0)) if variant == "v1" else F.lit(0)
    oov = names.join(sizes, "field", "left").select("field", F.lit(OOV).alias("value"), last.alias("id"))
    return ids.union(oov.withColumn("id", F.col("id").cast("long")))


class Vocabulary:
    """A vocabulary as join sides, with a size per field.

    Small fields, taken from the smallest on while together they hold at most `max_rows` rows, are broadcast one by one,
    which shuffles nothing. All other fields share one shuffled lookup in long form, whatever their number.
    """

    def __init__(self, vocab: DataFrame, max_rows: int = BROADCAST_ROWS):
        self.table = stored(vocab.select("field", "value", "id"), "vocabulary")
        is_oov = F.col("value") == OOV
        fields = self.table.groupBy("field").agg(
            F.count(F.lit(1)).alias("n"), F.max(F.when(is_oov, F.col("id"))).alias("unknown")
        )
        rows = sorted(fields.collect(), key=lambda r: (r["n"], r["field"]))  # one row per field
        self.unknown = {r["field"]: r["unknown"] or 0 for r in rows}
        held = 0
        self.small: list[str] = []
        for row in rows:
            held += row["n"]
            if held <= max_rows:
                self.small.append(row["field"])
        self.large = [r["field"] for r in rows if r["field"] not in set(self.small)]
        self.table = self.table.filter(~is_oov)
        known = self.table.filter(F.col("field").isin(self.small)).toArrow() if self.small else None
        self.local = None if known is None else vocab.sparkSession.createDataFrame(known, schema="field string, value string, id bigint")

    def encode(self, df: DataFrame, fields: Mapping[str, str], row_id: str) -> DataFrame:
        """Add a column of ids for each field (name: output name); null or unknown values get the field's unknown id.

        `row_id` is unique; it only matters for large fields.
        """
        result = df
        small = [name for name in fields if name in set(self.small)]
        large = [name for name in fields if name in set(self.large)]
        if large:
            result = result.join(self._coded(df, large, row_id), row_id, "left")
        for name in small:
            side = self.local.filter(F.col("field") == name).select(F.col("value").alias("_v"), F.col("id").alias("_id"))
            keyed = result.withColumn("_v", norm_hex(c(name), OOV))
            result = keyed.join(F.broadcast(side), "_v", "left").withColumn(f"_code {name}", F.col("_id")).drop("_v", "_id")
        codes = [F.coalesce(c(f"_code {name}"), F.lit(self.unknown[name])).cast("int").alias(out) for name, out in fields.items()]
        replaced = set(fields.values())
        return result.select(*[c(name) for name in df.columns if name not in replaced], *codes)

    def _coded(self, df: DataFrame, fields: Sequence[str], row_id: str) -> DataFrame:
        """(row_id, one code column per field): every row's values in long form, looked up together.

        A dictionary of the distinct values with their ids and row counts comes first, so that values held by very many rows
        are known, and salted, in the lookup of the rows.
        """
        pairs = F.array(*[F.struct(F.lit(n).alias("field"), norm_hex(c(n), OOV).alias("value")) for n in fields])
        long = df.select(c(row_id).alias("_row"), F.explode(pairs).alias("p")).select("_row", "p.field", "p.value")
        long = long.filter(F.col("value") != OOV.lower())
        counted = long.groupBy("field", "value").agg(F.count(F.lit(1)).alias("_rows"))
        dictionary = stored(counted.join(self.table, ["field", "value"]), "dictionary")
        coded = skew_join(long, dictionary, ["field", "value"], "inner", salt_by=F.col("_row"), counts="_rows")
        columns = [F.max(F.when(F.col("field") == n, F.col("id"))).alias(f"_code {n}") for n in fields]
        return coded.groupBy("_row").agg(*columns).withColumnRenamed("_row", row_id)


def encode_categorical(df: DataFrame, field: str, vocab: DataFrame, row_id: str, out: str | None = None) -> DataFrame:
    """Replace a field by its vocabulary id; null or unknown values get the field's unknown id (0 without one)."""
    vocabulary = Vocabulary(vocab.filter(F.col("field") == field))
    if field not in vocabulary.unknown:
        return df.withColumn(out or field, F.lit(0))
    return vocabulary.encode(df, {field: out or field}, row_id)


def encode_field(field: str, kind: str) -> Column | None:
    """Encoded column of a field by catalog type; None for those that need a vocabulary."""
    if kind == "address_ipv4":
        return octets(c(field), "ipv4")
    if kind == "address_mac":
        return octets(c(field), "mac")
    if field in PORT_FIELDS:
        return port_bin(c(field))
    if kind == "categorical":
        return None
    if field in DECIMAL_FIELDS:
        return F.coalesce(c(field).try_cast("double"), F.lit(0.0)).cast("int")
    if field == TIMESTAMP_FIELD:
        return log_scale(tsval(c(field)))
    return log_scale(hex_to_long(c(field)))


def encode_packets(
    df: DataFrame, catalog: Mapping[str, str], vocab: DataFrame, row_id: str, keep: Sequence[str] = ()
) -> DataFrame:
    """Catalog fields of the table encoded by type, `flow_*` columns as float.

    A field that needs a vocabulary and has none is 0 everywhere, so the columns don't depend on the vocabulary. `row_id` is
    unique.
    """
    fields = sorted(name for name in catalog if name in df.columns)
    flow_columns = [name for name in df.columns if name.startswith("flow_")]
    vocabulary = Vocabulary(vocab.filter(F.col("field").isin(fields)))
    plain = {name: encode_field(name, catalog[name]) for name in fields}
    looked_up = [name for name in fields if plain[name] is None and name in vocabulary.unknown]
    unknown = [name for name in fields if plain[name] is None and name not in vocabulary.unknown]
    encoded = df.select(
        *[c(name) for name in dict.fromkeys([row_id, *keep])],
        *[c(name) for name in looked_up],
        *[expr.alias(name) for name, expr in plain.items() if expr is not None],
        *[F.lit(0).alias(name) for name in unknown],
        *[F.coalesce(c(name).try_cast("double"), F.lit(0.0)).cast("float").alias(name) for name in flow_columns],
    )
    return vocabulary.encode(encoded, {name: name for name in looked_up}, row_id)


def perturb(
    df: DataFrame, row_id: str, len_noise: float | None = None, iat_noise: float | None = None, seed: int = 42
) -> DataFrame:
    """Log-scaled lengths and timestamps with seeded noise, the same on every run.

    Lengths are multiplied by 1 + U(-a, a); timestamps get N(0, sigma) added. Both are clipped at 0 before the log.
    """
    hashed = digest(seed, c(row_id))
    length = hex_to_long(c("ip.len")).cast("double")
    if len_noise is not None:
        length = length * (1 + unit_noise(hashed) * F.lit(float(len_noise)))
    result = df.withColumn("ip_len_encoded", log_scale(length))
    if TIMESTAMP_FIELD not in df.columns:
        return result
    ticks = tsval(c(TIMESTAMP_FIELD)).cast("double")
    if iat_noise is not None:
        ticks = ticks + normal_noise(hashed) * F.lit(float(iat_noise))
    return result.withColumn("timestamp_encoded", log_scale(ticks))


def normal_noise(hashed: Column) -> Column:
    """A standard normal number from a digest (Box-Muller)."""
    return F.sqrt(-2 * F.log(unit_uniform(hashed, 9))) * F.cos(F.lit(6.283185307179586) * unit_uniform(hashed, 17))


def integer_code(df: DataFrame, column: str, order_by: str, out: str = "code", empty: str = "[]") -> DataFrame:
    """Codes from 0 by first appearance; the empty list text is -1."""
    text = F.coalesce(c(column).cast("string"), F.lit("\u0000null"))
    first = first_rows(df, text, "_v", order_by)
    real = first.filter(F.col("_v") != empty)
    ranked = rank_by_number(real, "_first", name="_rank", keys=real)
    codes = ranked.select("_v", (F.col("_rank") - 1).alias("_code"), "_rows").unionByName(
        first.filter(F.col("_v") == empty).select("_v", F.lit(-1).cast("long").alias("_code"), "_rows")
    )
    joined = skew_join(df.withColumn("_v", text), codes, ["_v"], salt_by=c(order_by), counts="_rows")
    return joined.withColumn(out, F.coalesce(F.col("_code"), F.lit(-1)).cast("long")).drop("_v", "_code")


def label_map(train: DataFrame, order_by: str, label: str = "label") -> DataFrame:
    """(label, label_id): ids from 0 by first appearance in the train table."""
    return factorize(train.filter(c(label).isNotNull()), label, order_by, "label_id")


def apply_label_map(df: DataFrame, labels: DataFrame, label: str = "label") -> DataFrame:
    """Add `label_id`, -1 for labels the map does not know."""
    return df.join(small_side(labels), label, "left").withColumn(
        "label_id", F.coalesce(F.col("label_id"), F.lit(-1)).cast("long")
    )


def flow_first_labels(df: DataFrame, order_by: str, flow: str = "stream_id", label_id: str = "label_id") -> DataFrame:
    """One label per flow, that of its first row."""
    return df.groupBy(c(flow)).agg(F.min_by(c(label_id), c(order_by)).alias(label_id))


def class_weights(
    df: DataFrame,
    num_classes: int,
    label_id: str = "label_id",
    smoothing: str = "none",
    clamp: tuple[float | None, float | None] = (0.1, 10.0),
) -> DataFrame:
    """(label_id, n, weight) with weight = N / (C * n), smoothed and clamped; a class without rows counts as 1.

    Pass packets, or `flow_first_labels` for flow-level weights.
    """
    counted = df.groupBy(c(label_id).cast("long").alias("label_id")).agg(F.count(F.lit(1)).alias("_n"))
    classes = df.sparkSession.range(num_classes).select(F.col("id").alias("label_id"))
    counts = classes.join(counted, "label_id", "left").select(
        "label_id", F.greatest(F.coalesce("_n", F.lit(0)), F.lit(1)).alias("n")
    )
    total = F.sum("n").over(Window.partitionBy(F.lit(0))).cast("double")  # one row per class
    raw = total / (F.lit(float(num_classes)) * F.col("n"))
    if smoothing == "sqrt":
        raw = F.sqrt(raw)
    elif smoothing == "log":
        raw = F.log1p(raw)
    elif smoothing != "none":
        raise ValueError(f"unknown smoothing: {smoothing}")
    low, high = clamp
    if low is not None:
        raw = F.greatest(raw, F.lit(float(low)))
    if high is not None:
        raw = F.least(raw, F.lit(float(high)))
    return counts.select("label_id", "n", raw.alias("weight"))


def f1_weights(metrics: DataFrame, beta: float = 2.0) -> DataFrame:
    """(class_id, weight): (1 - f1)^beta divided by its mean over the classes."""
    raw = metrics.select("class_id", F.pow(1 - F.col("f1"), F.lit(float(beta))).alias("_w"))
    return raw.select("class_id", (F.col("_w") / F.avg("_w").over(Window.partitionBy(F.lit(0)))).alias("weight"))


def expert_columns(
    observed: DataFrame,
    enabled_layers: Sequence[str] | None = None,
    use_ip: bool = True,
    use_mac: bool = True,
    use_port: bool = True,
) -> DataFrame:
    """(expert, field): every catalog field of the table under its expert, minus ablated layers and addresses."""
    field = F.col("field")
    expert = (
        F.when(field.startswith("eth."), F.lit("eth"))
        .when(field.startswith("ip."), F.lit("ip"))
        .when(field.startswith("tcp.") & ~field.contains("options"), F.lit("tcp_core"))
        .when(field.startswith("tcp.options."), F.lit("tcp_options"))
        .when(field.startswith("tls.record."), F.lit("tls_record"))
        .when(field.startswith("tls.handshake."), F.lit("tls_handshake"))
        .when(field.startswith("tls.x509"), F.lit("tls_x509"))
    )
    dropped: list[str] = []
    dropped += [] if use_mac else ["eth.src", "eth.dst"]
    dropped += [] if use_ip else ["ip.src", "ip.dst"]
    dropped += [] if use_port else list(PORT_FIELDS)
    assigned = observed.select(expert.alias("expert"), "field").filter(
        F.col("expert").isNotNull() & ~field.isin(dropped)
    )
    if enabled_layers is None:
        return assigned
    # layer of an expert is its name up to the underscore
    return assigned.filter(F.substring_index("expert", "_", 1).isin(list(enabled_layers)))
