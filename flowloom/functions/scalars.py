"""Scalar expressions over packet fields, all JVM-side."""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

LONG_MAX = 2**63 - 1
OCTETS = {"ipv4": 4, "mac": 6}


def norm_hex(value: Column, missing: str = "0") -> Column:
    """Lower case without `0x`; `missing` for null."""
    return F.replace(F.lower(F.coalesce(value.cast("string"), F.lit(missing))), F.lit("0x"), F.lit(""))


def hex_to_long(value: Column) -> Column:
    """Base-16 text before the first dot; 0 for null or bad text, capped at 2^63 - 1."""
    text = F.replace(F.lower(value.cast("string")), F.lit("0x"), F.lit(""))
    # significant digits; empty for null, zero or unreadable text
    digits = F.coalesce(F.regexp_extract(text, r"^0*([0-9a-f]*)(\..*)?$", 1), F.lit(""))
    number = F.conv(digits, 16, 10).try_cast("bigint")
    return (
        F.when(digits == "", F.lit(0).cast("bigint"))
        .when(F.length(digits) > 16, F.lit(LONG_MAX))
        .otherwise(F.coalesce(number, F.lit(LONG_MAX)))
    )


def tsval(value: Column) -> Column:
    """TSval of a `080a` timestamp option of 20 hex digits, else 0."""
    text = F.replace(F.lower(value.cast("string")), F.lit("0x"), F.lit(""))
    shaped = (F.length(text) == 20) & text.startswith("080a")
    return F.when(shaped, hex_to_long(F.substring(text, 5, 8))).otherwise(F.lit(0).cast("bigint"))


def octets(value: Column, kind: str) -> Column:
    """Hex address to its octets; zeros for null, short or malformed text."""
    count = OCTETS[kind]
    head = F.substring(F.substring_index(value.cast("string"), "x", -1), 1, 2 * count)
    good = F.coalesce(head.rlike(f"^[0-9a-fA-F]{{{2 * count}}}$"), F.lit(False))
    # one number for the whole address, then its bytes
    number = F.conv(F.when(good, head).otherwise(F.lit("0")), 16, 10).cast("bigint")
    return F.array(
        *[F.shiftright(number, 8 * (count - 1 - i)).bitwiseAND(F.lit(255)).cast("int") for i in range(count)]
    )


def port_bin(value: Column) -> Column:
    """0 unknown, 1 well-known, 2 registered, 3 ephemeral."""
    port = hex_to_long(value)
    return (
        F.when(port.between(1, 1023), F.lit(1))
        .when(port.between(1024, 49151), F.lit(2))
        .when(port >= 49152, F.lit(3))
        .otherwise(F.lit(0))
    )


def log_scale(value: Column) -> Column:
    return F.log1p(F.greatest(value.cast("double"), F.lit(0.0)))


def strip_prefix(name: Column, prefix: str, replace_dot: bool = True) -> Column:
    """Drop a leading layer prefix; optionally dots and dashes to underscores, lower case."""
    bare = F.when(name.startswith(prefix), F.substr(name, F.lit(len(prefix) + 1))).otherwise(name)
    return F.lower(F.translate(bare, ".-", "__")) if replace_dot else bare


def segment_numbers(text: Column) -> Column:
    """All integers that follow a `#`."""
    return F.transform(F.regexp_extract_all(text, F.lit(r"#(\d+)"), 1), lambda part: part.cast("bigint"))


def format_bytes(size: Column) -> Column:
    """Bytes as text with two decimals and a unit."""
    amount = size.cast("double")
    text = F.concat(size.cast("bigint").cast("string"), F.lit(" B"))
    for power, unit in enumerate(["KB", "MB", "GB", "TB"], start=1):
        # bround: halves go to the even digit, as in Python's formatting
        scaled = F.format_string(f"%.2f {unit}", F.bround(amount / F.lit(float(1024**power)), 2))
        text = F.when(amount >= float(1024**power), scaled).otherwise(text)
    return text


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """`body` with `value` bound to a lambda variable, so that it is computed once per row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def logsumexp(logits: Column) -> Column:
    def from_top(top: Column) -> Column:
        return top + F.log(F.aggregate(logits, F.lit(0.0), lambda acc, x: acc + F.exp(x.cast("double") - top)))

    return let(F.array_max(logits).cast("double"), from_top)


def softmax(logits: Column) -> Column:
    """Softmax over an array, stable."""
    return let(logsumexp(logits), lambda norm: F.transform(logits, lambda x: F.exp(x.cast("double") - norm)))


def max_probability(logits: Column) -> Column:
    """The largest softmax value, without building the others."""
    return F.exp(F.array_max(logits).cast("double") - logsumexp(logits))


def argmax(values: Column) -> Column:
    """0-based position of the first maximum."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def cross_entropy(logits: Column, target: Column) -> Column:
    return logsumexp(logits) - F.get(logits, target).cast("double")


def focal_loss(logits: Column, target: Column, alpha: Sequence[float] | None = None, gamma: float = 2.0) -> Column:
    """Per-row focal loss; aggregate with avg or sum for the reduced forms."""
    gain = F.lit(float(gamma))
    loss = let(cross_entropy(logits, target), lambda ce: F.pow(F.lit(1.0) - F.exp(-ce), gain) * ce)
    if alpha is None:
        return loss
    return F.get(F.array(*[F.lit(float(a)) for a in alpha]), target) * loss


def sigmoid(value: Column) -> Column:
    return F.lit(1.0) / (F.lit(1.0) + F.exp(-value.cast("double")))


def gate_entropy_term(gate: Column) -> Column:
    """Binary entropy of one gate value."""
    eps = F.lit(1e-8)
    return -(gate * F.log(gate + eps) + (F.lit(1.0) - gate) * F.log(F.lit(1.0) - gate + eps))


def gate_status(gate: Column) -> Column:
    return (
        F.when(gate < 0.1, F.lit("!!! ALMOST KILLED !!!")).when(gate > 0.5, F.lit("OPEN")).otherwise(F.lit("CLOSED"))
    )


def jaccard(left: Column, right: Column) -> Column:
    """|intersection| / |union| of two arrays, 0 if both are empty."""
    union = F.size(F.array_union(left, right))
    return F.when(union == 0, F.lit(0.0)).otherwise(F.size(F.array_intersect(left, right)) / union)


def unit_noise(hashed: Column) -> Column:
    """A number in (-1, 1] from the first eight hex digits of a digest."""
    share = (F.conv(F.substring(hashed, 1, 8), 16, 10).cast("double") + 1) / F.lit(float(2**32))
    return 2 * share - 1
