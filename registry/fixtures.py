"""Packet-shaped views over the given tables, defined once for Spark and for DuckDB.

Every view covers its whole table. `packets` is `events` seen as packets: a user is a flow, the event type a label.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession

from flowloom.session import tune


@dataclass(frozen=True)
class Dialect:
    """The few spellings that differ between the two engines."""

    epoch: str
    hex_name: str
    quote: str

    def hex(self, number: str) -> str:
        return f"lower({self.hex_name}({number}))"

    def q(self, name: str) -> str:
        return f"{self.quote}{name}{self.quote}"


SPARK = Dialect("timestampdiff(SECOND, TIMESTAMP_NTZ'1970-01-01 00:00:00', {0})", "hex", "`")
DUCK = Dialect("cast(floor(epoch({0})) as bigint)", "to_hex", '"')

LABELS = ["click", "error", "purchase", "signup", "view"]
NUM_CLASSES = len(LABELS)


def packet_columns(d: Dialect) -> dict[str, str]:
    """Column name to SQL expression over `events`."""
    seconds = d.epoch.format("ts")
    client_ip = f"lpad({d.hex('167772160 + user_id')}, 8, '0')"
    server_ip = f"lpad({d.hex('3232235520 + user_id % 7')}, 8, '0')"
    client_mac = f"concat('02', lpad({d.hex('user_id')}, 10, '0'))"
    server_mac = f"concat('f4', lpad({d.hex('user_id % 7')}, 10, '0'))"
    client_port = d.hex("49152 + user_id % 1000")
    server_port = "case when user_id % 3 = 0 then '1f90' else '1bb' end"

    def swap(a: str, b: str) -> str:
        return f"case when event_id % 2 = 1 then {b} else {a} end"

    is_tls = "event_type in ('click', 'purchase')"
    is_hello = "event_id % 5 = 0"
    is_syn = "event_id % 50 = 1"
    labels = " ".join(f"when '{name}' then {i}" for i, name in enumerate(LABELS))
    return {
        "packet_id": "event_id",
        "label": "event_type",
        "label_id": f"cast(case event_type {labels} end as bigint)",
        "stream_id": "user_id",
        "value": "value",
        "frame.time_epoch": f"cast({seconds} as varchar(20))",
        "eth.dst": swap(server_mac, client_mac),
        "eth.src": swap(client_mac, server_mac),
        "eth.type": "'0800'",
        "ip.dst": swap(server_ip, client_ip),
        "ip.flags": "case when event_id % 4 = 0 then '00' else '40' end",
        "ip.flags.df": "case when event_id % 4 = 0 then '0' else '1' end",
        "ip.len": d.hex("40 + 100 * (event_id % 17)"),
        "ip.proto": "'06'",
        "ip.src": swap(client_ip, server_ip),
        "ip.ttl": d.hex("32 + event_id % 96"),
        "tcp.dstport": swap(server_port, client_port),
        "tcp.flags": f"concat('0x', {d.hex('16 + event_id % 16')})",
        "tcp.flags.syn": f"case when {is_syn} then '1' else '0' end",
        "tcp.options.mss_val": f"case when {is_syn} then '05b4' end",
        "tcp.options.timestamp": f"case when event_id % 3 <> 0 then "
        f"concat('080a', lpad({d.hex(seconds)}, 8, '0'), '00000000') end",
        "tcp.srcport": swap(client_port, server_port),
        "tcp.vendor.note": "case when event_id % 50 = 1 then 'n' end",
        "tls.handshake.extension.type": f"case when {is_hello} then {d.hex('event_id % 40')} end",
        "tls.handshake.type": f"case when {is_hello} then "
        "case when event_id % 10 = 0 then '01' else '02' end end",
        "tls.record.content_type": f"case when {is_tls} then '17' end",
        "tls.record.length": f"case when {is_tls} then {d.hex('event_id % 16384')} end",
    }


FIELDS = [n for n in packet_columns(SPARK) if n.split(".")[0] in ("eth", "ip", "tcp", "tls") and "." in n]

# split: test flows are unknown to the train split, validation packets share its flows
SPLIT = (
    "case when stream_id % 10 = 9 then 'test' when packet_id % 10 = 8 then 'validation' else 'train' end"
)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return tune(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    columns = [f"{expr} as {SPARK.q(name)}" for name, expr in packet_columns(SPARK).items()]
    return table(spark, sf_dir, "events").selectExpr(*[x.replace("varchar(20)", "string") for x in columns])


def packets_pure(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`packets` with one label per flow."""
    from pyspark.sql import functions as F

    return packets(spark, sf_dir).withColumn("label", F.expr("concat('c', cast(stream_id % 5 as string))")).withColumn(
        "label_id", F.expr("stream_id % 5")
    )


def orders_labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").selectExpr(
        "o_orderkey as row_id", "o_orderpriority as label", "o_custkey as flow"
    )


def logit_sql(c: int) -> str:
    # tenths plus a small step per class, so that means never tie
    return f"cast(((packet_id * {31 + 7 * c}) % 97) * 10000 + {137 * c} as double) / cast(100000 as double)"


def scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """`packets` keys with an array of logits and a score column."""
    logits = ", ".join(f"{logit_sql(c)}" for c in range(NUM_CLASSES))
    return packets(spark, sf_dir).selectExpr(
        "packet_id", "stream_id", "label", "label_id", f"array({logits}) as logits", "value / 10.0 as packet_score"
    )


def importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean value per (event type, feature) as an importance in (0, 1)."""
    return spark_sql_over(spark, sf_dir, IMPORTANCE_BODY, "events")


def spark_sql_over(spark: SparkSession, sf_dir: str, body: str, name: str) -> DataFrame:
    return tune(spark).sql(body.replace("{src}", "{source}"), source=table(spark, sf_dir, name))


FEATURES = [
    "ip.len", "ip.ttl", "ip.flags", "tcp.flags", "tcp.srcport", "tcp.options", "tls.record", "tls.handshake.type",
    "tcp.vendor.note", "root", "custom.field", "eth.type",
]
_FEATURE_CASE = "case user_id % 12 " + " ".join(f"when {i} then '{n}'" for i, n in enumerate(FEATURES)) + " end"
IMPORTANCE_BODY = (
    f"select event_type as expert_name, {_FEATURE_CASE} as feature_name, "
    "avg(value) / (avg(value) + 10.0) as importance_score, avg(value) - 20.0 as gate_logit "
    "from {src} group by 1, 2"
)


# -- DuckDB side ------------------------------------------------------------------------------------------------

_DUCK_PACKETS = "select " + ", ".join(
    f"{expr} as {DUCK.q(name)}" for name, expr in packet_columns(DUCK).items()
).replace("varchar(20)", "varchar") + " from events"

CTES = {
    "packets": _DUCK_PACKETS,
    "packets_pure": "select * replace (concat('c', stream_id % 5) as label, stream_id % 5 as label_id) from packets",
    "orders_l": "select o_orderkey as row_id, o_orderpriority as label, o_custkey as flow from orders",
    "scores": "select packet_id, stream_id, label, label_id, ["
    + ", ".join(f"{logit_sql(c)}" for c in range(NUM_CLASSES))
    + "] as logits, value / 10.0 as packet_score from packets",
    "importance": IMPORTANCE_BODY.replace("{src}", "events"),
}
NEEDS = {"packets_pure": ["packets"], "scores": ["packets"]}


def with_views(sql: str, *views: str, **extra: str) -> str:
    """`sql` behind WITH clauses for the wanted views (their inputs first) and extra named queries."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for needed in NEEDS.get(name, []):
            add(needed)
        if name not in ordered:
            ordered.append(name)

    for view in views:
        add(view)
    clauses = [f"{name} as ({CTES[name]})" for name in ordered] + [f"{n} as ({q})" for n, q in extra.items()]
    return f"with {', '.join(clauses)} {sql}" if clauses else sql
