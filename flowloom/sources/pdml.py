"""Packet dissection XML to packets with a field map."""

from __future__ import annotations

import re
import xml.etree.ElementTree as ElementTree
from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

FIELD_MAP = T.MapType(T.StringType(), T.StringType())
MAX_VALUE_LENGTH = 64
PACKET_END = "</packet>"
#: What stands around the packets of a file.
FRAME = re.compile(r"<\?.*?\?>|<!--.*?-->|</?pdml\b[^>]*>", re.DOTALL)


def packet_outcome(xml: str | None, max_len: int = MAX_VALUE_LENGTH) -> tuple[dict[str, str] | None, str | None]:
    """(visible short fields of one `<packet>` text, why there are none); a repeated name keeps its last value.

    Both are null for the frame of a file around its packets.
    """
    if xml is None:
        return None, "no text"
    start = xml.find("<packet")
    if start < 0:
        return None, "no packet" if FRAME.sub("", xml).strip() else None
    text = xml[start:] if xml.rstrip().endswith(PACKET_END) else xml[start:] + PACKET_END
    try:
        packet = ElementTree.fromstring(text)
    except ElementTree.ParseError as error:
        return None, f"not well-formed: {error}"
    found: dict[str, str] = {}
    for element in packet.iter("field"):
        name, value = element.get("name"), element.get("value", element.get("show"))
        if name is not None and value is not None and element.get("hide") != "yes" and len(value) < max_len:
            found[name] = value
    number = packet.find("proto[@name='geninfo']/field[@name='num']")
    if number is not None and number.get("show") is not None:
        found["frame.number"] = number.get("show")
    return found, None if found else "no visible field"


def packet_fields(xml: str | None, max_len: int = MAX_VALUE_LENGTH) -> dict[str, str] | None:
    """The fields alone, null for a text without a readable packet."""
    return packet_outcome(xml, max_len)[0]


def parse_outcomes(df: DataFrame, xml: str = "value", max_len: int = MAX_VALUE_LENGTH) -> DataFrame:
    """Replace the XML text column by `fields map<string,string>`, `raw` and `reason`, all from one parse.

    A text whose packet can't be used has a reason and is kept in `raw`; for others both are null.
    """
    others = [name for name in df.columns if name != xml]
    added = [T.StructField("fields", FIELD_MAP), T.StructField("raw", T.StringType()), T.StructField("reason", T.StringType())]
    schema = T.StructType([*[df.schema[name] for name in others], *added])

    def parse(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names: list[str] = []
            values: list[str] = []
            ends = [0]
            raw: list[str | None] = []
            reasons: list[str | None] = []
            for text in batch.column(xml).to_pylist():
                found, reason = packet_outcome(text, max_len)
                names.extend(found or ())
                values.extend((found or {}).values())
                ends.append(len(names))
                raw.append(None if reason is None else text)
                reasons.append(reason)
            maps = pa.MapArray.from_arrays(
                pa.array(ends, pa.int32()), pa.array(names, pa.string()), pa.array(values, pa.string())
            )
            columns = [*[batch.column(n) for n in others], maps, pa.array(raw, pa.string()), pa.array(reasons, pa.string())]
            yield pa.RecordBatch.from_arrays(columns, names=schema.names)

    return df.mapInArrow(parse, schema)


def packets_of(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter(F.size("fields") > 0).drop("raw", "reason")


def rejects_of(outcomes: DataFrame) -> DataFrame:
    return outcomes.filter("reason is not null").drop("fields")


def parse_packets(df: DataFrame, xml: str = "value", max_len: int = MAX_VALUE_LENGTH) -> DataFrame:
    """The packets alone; the texts left out are the `rejects_of` of `parse_outcomes`."""
    return packets_of(parse_outcomes(df, xml, max_len))


def read_outcomes(spark: SparkSession, path: str | Sequence[str], max_len: int = MAX_VALUE_LENGTH) -> DataFrame:
    """(path, fields, raw, reason): every packet of the dissection files is one record of a splittable text read."""
    text = spark.read.option("lineSep", PACKET_END).text(path)
    return parse_outcomes(text.select(F.col("_metadata.file_path").alias("path"), "value"), max_len=max_len)


def read_pdml(spark: SparkSession, path: str | Sequence[str], max_len: int = MAX_VALUE_LENGTH) -> DataFrame:
    """(path, fields): the readable packets of the dissection files."""
    return packets_of(read_outcomes(spark, path, max_len))


def widen(packets: DataFrame, names: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """The map as one string column per wanted field, null where absent."""
    return packets.select(*keep, *[F.col("fields").getItem(name).alias(name) for name in names])


def field_names(packets: DataFrame) -> list[str]:
    """All field names that occur, sorted (distinct names are made so before they are fetched)."""
    rows = packets.select(F.explode(F.map_keys("fields")).alias("name")).distinct().collect()
    return sorted(row["name"] for row in rows)


def usable(name: Column, value: Column, hide: Column, max_len: int = MAX_VALUE_LENGTH) -> Column:
    shown = F.coalesce(hide != "yes", F.lit(True))
    return name.isNotNull() & shown & value.isNotNull() & (F.length(value) < max_len)


def field_filter(fields: DataFrame, packet: str = "packet_id", max_len: int = MAX_VALUE_LENGTH) -> DataFrame:
    """(packet, name, value): the same rules on a long table with pos, name, value, show and hide.

    Keeps per packet and name the value at the highest position.
    """
    value = F.coalesce("value", "show")
    kept = fields.filter(usable(F.col("name"), value, F.col("hide"), max_len))
    return kept.groupBy(packet, "name").agg(F.max_by(value, F.col("pos")).alias("value"))
