"""Queries for scalar decoding, vocabularies, label maps, weights and field encoding."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.catalog import CATALOG, catalog_table
from flowloom.functions import scalars
from flowloom.operators import columns, encode, metrics
from flowloom.scale import c
from registry.core import query
from registry.fixtures import FIELDS, NUM_CLASSES, packets, table, with_views
from registry.q_scores import PACKET_CM, PER_CLASS, scores

# texts of all shapes a hex field can have
MESSY_HEX = """case event_id % 8 when 0 then concat('0x', lower({hex}(event_id))) when 1 then upper({hex}(event_id * 977))
 when 2 then concat(lower({hex}(event_id)), '.0') when 3 then 'xyz' when 4 then '' when 5 then 'ffffffffffffffff'
 when 6 then concat('000000000000000000', lower({hex}(event_id))) end"""
_DUCK_HEX = MESSY_HEX.format(hex="to_hex")


@query(
    "hex_to_long",
    f"""with h as (select event_id, {_DUCK_HEX} as raw from events),
      t as (select *, ltrim(replace(lower(split_part(raw, '.', 1)), '0x', ''), '0') as digits from h)
    select event_id, case when raw is null or digits = '' or not regexp_full_match(digits, '[0-9a-f]+') then 0
      when length(digits) >= 16 then 9223372036854775807 else ('0x' || digits)::bigint end as number from t""",
)
def hex_to_long(spark, sf_dir):
    events = table(spark, sf_dir, "events").select("event_id", F.expr(MESSY_HEX.format(hex="hex")).alias("raw"))
    return events.select("event_id", scalars.hex_to_long(F.col("raw")).alias("number"))


@query(
    "tsval",
    with_views(
        "select packet_id, coalesce(('0x' || substr(\"tcp.options.timestamp\", 5, 8))::bigint, 0) as tsval "
        "from packets",
        "packets",
    ),
)
def tsval(spark, sf_dir):
    return packets(spark, sf_dir).select("packet_id", scalars.tsval(c("tcp.options.timestamp")).alias("tsval"))


def _octet_sql(text: str, count: int) -> str:
    parts = ", '.', ".join(f"('0x' || substr({text}, {2 * i + 1}, 2))::int" for i in range(count))
    return f"concat({parts})"


@query(
    "octets",
    with_views(
        "select packet_id, case when packet_id % 10 = 0 then '0.0.0.0' else "
        + _octet_sql('"ip.src"', 4)
        + " end as ip, "
        + _octet_sql('"eth.src"', 6)
        + " as mac from packets",
        "packets",
    ),
)
def octets(spark, sf_dir):
    text = F.when(F.col("packet_id") % 10 == 0, F.lit("0")).otherwise(F.concat(F.lit("0x"), c("ip.src")))

    def joined(value):
        return F.array_join(value.cast("array<string>"), ".")

    return packets(spark, sf_dir).select(
        "packet_id",
        joined(scalars.octets(text, "ipv4")).alias("ip"),
        joined(scalars.octets(c("eth.src"), "mac")).alias("mac"),
    )


_PORT_SQL = """case when p between 1 and 1023 then 1 when p between 1024 and 49151 then 2 when p >= 49152 then 3
  else 0 end"""


@query(
    "port_bin",
    with_views(
        f"select packet_id, {_PORT_SQL} as bin from "
        "(select packet_id, ('0x' || \"tcp.srcport\")::bigint as p from packets)",
        "packets",
    ),
)
def port_bin(spark, sf_dir):
    return packets(spark, sf_dir).select("packet_id", scalars.port_bin(c("tcp.srcport")).alias("bin"))


@query(
    "encode_numeric",
    with_views(
        "select packet_id, round(ln(1 + ('0x' || \"ip.len\")::bigint), 6) as encoded, "
        "round(ln(1 + greatest(value - 50, 0)), 6) as clipped from packets",
        "packets",
    ),
)
def encode_numeric(spark, sf_dir):
    return packets(spark, sf_dir).select(
        "packet_id",
        F.round(scalars.log_scale(scalars.hex_to_long(c("ip.len"))), 6).alias("encoded"),
        F.round(scalars.log_scale(F.col("value") - 50), 6).alias("clipped"),
    )


@query(
    "format_bytes",
    """select doc_id, case when n < 1024 then concat(n, ' B') when n < 1048576 then printf('%.2f KB', n / 1024.0::double)
      when n < 1073741824 then printf('%.2f MB', n / 1048576.0::double) else printf('%.2f GB', n / 1073741824.0::double)
      end as size from (select doc_id, n_chars * (1 + doc_id % 3 * 2000) as n from documents)""",
)
def format_bytes(spark, sf_dir):
    docs = table(spark, sf_dir, "documents").select(
        "doc_id", F.expr("n_chars * (1 + doc_id % 3 * 2000)").alias("n")
    )
    return docs.select("doc_id", scalars.format_bytes(F.col("n")).alias("size"))


@query(
    "integer_code",
    with_views(
        "select v.packet_id, case when v.segs = '[]' then -1 else m.code end as code from v left join "
        "(select segs, row_number() over (order by min(packet_id)) - 1 as code from v where segs is distinct from '[]' "
        "group by 1) m on m.segs is not distinct from v.segs",
        "packets",
        v="select packet_id, case packet_id % 11 when 0 then '[]' when 1 then null when 2 then '[1, 2]' "
        "else concat('[', stream_id, ']') end as segs from packets",
    ),
)
def integer_code(spark, sf_dir):
    text = F.expr(
        "case packet_id % 11 when 0 then '[]' when 1 then null when 2 then '[1, 2]' else concat('[', stream_id, ']') end"
    )
    df = packets(spark, sf_dir).select("packet_id", text.alias("segs"))
    return encode.integer_code(df, "segs", "packet_id").select("packet_id", "code")


# -- vocabularies -----------------------------------------------------------------------------------------------

CATEGORICAL = [n for n in FIELDS if CATALOG.get(n) == "categorical"]
#: A field of the table that no packet has.
EMPTY = next(n for n, kind in sorted(CATALOG.items()) if kind == "categorical" and n not in FIELDS)


def with_empty(df):
    return df.withColumn(EMPTY, F.lit(None).cast("string"))


def _values_sql(fields) -> str:
    return " union ".join(
        f"select '{n}' as field, replace(lower(\"{n}\"), '0x', '') as value from packets where \"{n}\" is not null"
        for n in fields
    )


def vocab_sql(variant: str) -> str:
    first, oov = ("- 1", "count(*)") if variant == "v1" else ("", "0::bigint")
    return (
        f"select field, value, row_number() over (partition by field order by value) {first} as id from vv "
        f"union all select field, '__OOV__', {oov} from vv group by field "
        f"union all select '{EMPTY}', '__OOV__', 0"
    )


for _variant in ("v1", "v2"):
    query(f"vocab_{_variant}", with_views(vocab_sql(_variant), "packets", vv=_values_sql(CATEGORICAL)))(
        lambda spark, sf_dir, variant=_variant: encode.build_vocab(
            with_empty(packets(spark, sf_dir)), [*CATEGORICAL, EMPTY], variant
        )
    )

_TRAIN = "packet_id % 40 < 20"
_LOOKUP = """coalesce((select id from vocab where field = '{0}' and vocab.value =
  replace(lower(packets."{0}"), '0x', '')), 0)::int"""
_TRAIN_VALUES = _values_sql(CATEGORICAL).replace(" is not null", f" is not null and {_TRAIN}")


@query(
    "encode_categorical",
    with_views(
        f"select packet_id, {_LOOKUP.format('tls.handshake.extension.type')} as code from packets",
        "packets",
        vv=_TRAIN_VALUES,
        vocab=vocab_sql("v2"),
    ),
)
def encode_categorical(spark, sf_dir):
    df = packets(spark, sf_dir)
    vocab = encode.build_vocab(df.filter(F.expr(_TRAIN)), CATEGORICAL, "v2")
    coded = encode.encode_categorical(df, "tls.handshake.extension.type", vocab, "packet_id", out="code")
    return coded.select("packet_id", "code")


_ADDRESSES = {"ip.src": 4, "ip.dst": 4, "eth.src": 6, "eth.dst": 6}
_NUMERIC = [n for n in FIELDS if CATALOG.get(n) == "numerical" and n != "tcp.options.timestamp"]
_PORTS = ["tcp.srcport", "tcp.dstport"]
_PLAIN_CATEGORICAL = [n for n in CATEGORICAL if n not in _PORTS]


def alias(name: str) -> str:
    return name.replace(".", "_")


@query(
    "encode_packets",
    with_views(
        "select packet_id, label, "
        + ", ".join(
            [f"{_octet_sql(chr(34) + n + chr(34), k)} as {alias(n)}" for n, k in _ADDRESSES.items()]
            + [f"round(ln(1 + coalesce(('0x' || \"{n}\")::bigint, 0)), 6) as {alias(n)}" for n in _NUMERIC]
            + [
                _PORT_SQL.replace("p between", f"('0x' || \"{n}\")::bigint between").replace(
                    "p >=", f"('0x' || \"{n}\")::bigint >="
                )
                + f" as {alias(n)}"
                for n in _PORTS
            ]
            + [f"{_LOOKUP.format(n)} as {alias(n)}" for n in _PLAIN_CATEGORICAL]
            + [f"0 as {alias(EMPTY)}"]
            + [
                "round(ln(1 + coalesce(('0x' || substr(\"tcp.options.timestamp\", 5, 8))::bigint, 0)), 6) "
                "as tcp_options_timestamp"
            ]
        )
        + " from packets",
        "packets",
        vv=_TRAIN_VALUES,
        vocab=vocab_sql("v2"),
    ),
)
def encode_packets(spark, sf_dir):
    df = with_empty(packets(spark, sf_dir))
    vocab = encode.build_vocab(df.filter(F.expr(_TRAIN)), [*CATEGORICAL, EMPTY], "v2")
    coded = encode.encode_packets(df, CATALOG, vocab, "packet_id", keep=["label"])

    def shown(name):
        if name in _ADDRESSES:
            return F.array_join(c(name).cast("array<string>"), ".")
        return F.round(c(name), 6) if CATALOG[name] == "numerical" else c(name)

    names = [n for n in [*FIELDS, EMPTY] if n in coded.columns]
    return coded.select("packet_id", "label", *[shown(n).alias(alias(n)) for n in names])


@query(
    "perturb_len",
    with_views(
        """select packet_id,
          round(ln(1 + greatest(len * (1 + (2 * u1 - 1) * 0.2::double), 0)), 6) as ip_len_encoded,
          round(ln(1 + greatest(ts + sqrt(-2 * ln(u2)) * cos(6.283185307179586::double * u3) * 5, 0)), 6)
            as timestamp_encoded
        from (select packet_id, ('0x' || "ip.len")::bigint::double as len,
            coalesce(('0x' || substr("tcp.options.timestamp", 5, 8))::bigint, 0)::double as ts,
            (('0x' || substr(h, 1, 8))::bigint::double + 1) / 4294967296.0::double as u1,
            (('0x' || substr(h, 9, 8))::bigint::double + 1) / 4294967296.0::double as u2,
            (('0x' || substr(h, 17, 8))::bigint::double + 1) / 4294967296.0::double as u3
          from (select *, md5('42|' || packet_id) as h from packets))""",
        "packets",
    ),
)
def perturb_len(spark, sf_dir):
    noisy = encode.perturb(packets(spark, sf_dir), "packet_id", len_noise=0.2, iat_noise=5.0, seed=42)
    return noisy.select(
        "packet_id",
        F.round("ip_len_encoded", 6).alias("ip_len_encoded"),
        F.round("timestamp_encoded", 6).alias("timestamp_encoded"),
    )


# -- labels and weights -----------------------------------------------------------------------------------------

_MAP = """select label, row_number() over (order by min(packet_id)) - 1 as label_id from packets
  where label <> 'view' group by 1"""


@query(
    "label_map",
    with_views(
        "select p.packet_id, coalesce(m.label_id, -1) as label_id from packets p left join m using (label)",
        "packets",
        m=_MAP,
    ),
)
def label_map(spark, sf_dir):
    df = packets(spark, sf_dir).drop("label_id")
    labels = encode.label_map(df.filter(F.col("label") != "view"), "packet_id")
    return encode.apply_label_map(df, labels).select("packet_id", "label_id")


_RAW_WEIGHT = f"(select sum(n) from n)::double / ({float(NUM_CLASSES + 1)}::double * n)"


@query(
    "class_weights_packet",
    with_views(
        f"select label_id, n, round(least(greatest(sqrt({_RAW_WEIGHT}), 0.1), 10.0)::double, 6) as weight from n",
        "packets",
        n=f"""select range as label_id, greatest(coalesce(x.n, 0), 1) as n from range({NUM_CLASSES + 1})
          left join (select label_id, count(*) as n from packets group by 1) x on x.label_id = range""",
    ),
)
def class_weights_packet(spark, sf_dir):
    df = packets(spark, sf_dir)
    weights = encode.class_weights(df, NUM_CLASSES + 1, smoothing="sqrt")
    return weights.withColumn("weight", F.round("weight", 6))


@query(
    "class_weights_flow",
    with_views(
        f"select label_id, n, round(least(greatest(ln(1 + {_RAW_WEIGHT}), 0.1), 10.0)::double, 6) as weight from n",
        "packets",
        n=f"""select range as label_id, greatest(coalesce(x.n, 0), 1) as n from range({NUM_CLASSES + 1})
          left join (select label_id, count(*) as n from (select arg_min(label_id, packet_id) as label_id from packets
            group by stream_id) group by 1) x on x.label_id = range""",
    ),
)
def class_weights_flow(spark, sf_dir):
    flows = encode.flow_first_labels(packets(spark, sf_dir), "packet_id")
    weights = encode.class_weights(flows, NUM_CLASSES + 1, smoothing="log")
    return weights.withColumn("weight", F.round("weight", 6))


@query(
    "f1_weights",
    with_views(
        "select class_id, round(power(1 - f1, 2) / avg(power(1 - f1, 2)) over (), 6) as weight from pc",
        "scores",
        cm=PACKET_CM,
        pc=PER_CLASS,
    ),
)
def f1_weights(spark, sf_dir):
    cm = metrics.confusion_matrix(metrics.packet_predictions(scores(spark, sf_dir)), NUM_CLASSES)
    weights = encode.f1_weights(metrics.per_class_metrics(cm))
    return weights.withColumn("weight", F.round("weight", 6))


# -- catalog ----------------------------------------------------------------------------------------------------

_OBSERVED = " union all ".join(
    f"select '{n}' as field from packets where \"{n}\" is not null group by 1" for n in FIELDS
)
_KNOWN = ", ".join(f"'{n}'" for n in FIELDS if n in CATALOG)


def observed_fields(spark, sf_dir):
    counts = columns.non_null_counts(packets(spark, sf_dir), FIELDS)
    return counts.filter(F.col("n_non_null") > 0).select("field")


@query(
    "field_whitelist",
    with_views(
        f"select field, case when field in ({_KNOWN}) then 'kept' else 'excluded' end as status from o",
        "packets",
        o=_OBSERVED,
    ),
)
def field_whitelist(spark, sf_dir):
    return columns.field_whitelist(observed_fields(spark, sf_dir), catalog_table(spark))


@query(
    "expert_columns",
    with_views(
        f"""select * from (select case when field like 'ip.%' then 'ip' when field like 'tcp.options.%' then 'tcp_options'
            when field like 'tcp.%' and field not like '%options%' then 'tcp_core'
            when field like 'tls.record.%' then 'tls_record' when field like 'tls.handshake.%' then 'tls_handshake' end
            as expert, field from o where field in ({_KNOWN}) and field not in ('ip.src', 'ip.dst'))
        where expert is not null""",
        "packets",
        o=_OBSERVED,
    ),
)
def expert_columns(spark, sf_dir):
    observed = observed_fields(spark, sf_dir).filter(F.col("field").isin(list(CATALOG)))
    return encode.expert_columns(observed, ["ip", "tcp", "tls"], use_ip=False)
