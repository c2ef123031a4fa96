"""Queries for importance concentration and gates."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.catalog import CATALOG
from flowloom.functions import scalars
from flowloom.operators import importance as ops
from registry.core import query
from registry.fixtures import FEATURES, LABELS, importance, scores, with_views
from registry.q_scores import PROBS, rounded

TAU = "0.2::double"


def ngi_sql(source: str, by: str = "") -> str:
    over = f"partition by {by}" if by else ""
    return f"select *, exp(importance_score / {TAU}) / sum(exp(importance_score / {TAU})) over ({over}) as ngi from {source}"


def gcs_sql(source: str, by: str = "") -> str:
    lead = f"{by}, " if by else ""
    group = f"group by {by}" if by else ""
    return f"""select *, round(ln(num_fields), 6) as log_n, case when g > 0 then round(ln(num_fields) / g, 6) end
      as log_n_over_gcs, round(g, 6) as gcs from (select {lead}count(*) as num_fields,
      -sum(ngi * ln(ngi + 1e-12::double)) as g from {source} {group})"""


_SHOWN = "select expert_name, feature_name, round(importance_score, 6) as importance_score, round(ngi, 6) as ngi from x"
COLUMNS = ["expert_name", "feature_name", "importance_score", "ngi"]


@query("ngi_all", with_views(_SHOWN, "importance", x=ngi_sql("importance")))
def ngi_all(spark, sf_dir):
    return rounded(ops.ngi(importance(spark, sf_dir)).select(*COLUMNS))


@query("ngi_per_expert", with_views(_SHOWN, "importance", x=ngi_sql("importance", "expert_name")))
def ngi_per_expert(spark, sf_dir):
    return rounded(ops.ngi(importance(spark, sf_dir), by=["expert_name"]).select(*COLUMNS))


@query(
    "gcs_per_expert",
    with_views(
        f"select * exclude (g) from ({gcs_sql('x', 'expert_name')})", "importance", x=ngi_sql("importance", "expert_name")
    ),
)
def gcs_per_expert(spark, sf_dir):
    return rounded(ops.gcs_per_expert(importance(spark, sf_dir)))


_VALID = ", ".join(f"'{n}'" for n in FEATURES if n in CATALOG or n in ops.ABSTRACT_NODES)


@query(
    "ngi_valid_fields",
    with_views(
        _SHOWN,
        "importance",
        v=f"select * from importance where feature_name in ({_VALID})",
        x=ngi_sql("v", "expert_name"),
    ),
)
def ngi_valid_fields(spark, sf_dir):
    return rounded(ops.ngi_valid_fields(importance(spark, sf_dir), list(CATALOG)).select(*COLUMNS))


_EXPERTS = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"
_WEIGHTS = f"select packet_id, unnest({_EXPERTS}) as expert_name, unnest(p) as weight from pr"
_EXPECTED = "select expert_name, avg(weight) as importance_score from w group by 1"


def expert_weights(spark, sf_dir):
    """Softmax of the logits read as one weight per (packet, expert)."""
    names = F.array(*[F.lit(x) for x in LABELS])
    pairs = F.arrays_zip(names.alias("expert_name"), scalars.softmax(F.col("logits")).alias("weight"))
    return scores(spark, sf_dir).select("packet_id", "stream_id", F.explode(pairs).alias("s")).select(
        "packet_id", "stream_id", F.col("s.expert_name"), F.col("s.weight")
    )


@query(
    "expected_gate",
    with_views(
        "select expert_name, round(importance_score, 6) as importance_score from e",
        "scores", pr=PROBS, w=_WEIGHTS, e=_EXPECTED,
    ),
)
def expected_gate(spark, sf_dir):
    return rounded(ops.expected_gate(expert_weights(spark, sf_dir)))


@query(
    "expert_ngi",
    with_views(
        "select expert_name, round(importance_score, 6) as importance_score, round(ngi, 6) as ngi from x",
        "scores", pr=PROBS, w=_WEIGHTS, e=_EXPECTED, x=ngi_sql("e"),
    ),
)
def expert_ngi(spark, sf_dir):
    return rounded(ops.ngi(ops.expected_gate(expert_weights(spark, sf_dir))))


@query(
    "expert_gcs",
    with_views(
        f"select * exclude (g) from ({gcs_sql('x')})", "scores", pr=PROBS, w=_WEIGHTS, e=_EXPECTED, x=ngi_sql("e")
    ),
)
def expert_gcs(spark, sf_dir):
    return rounded(ops.gcs(ops.ngi(ops.expected_gate(expert_weights(spark, sf_dir)))))


@query(
    "gate_report",
    with_views(
        "select expert_name, feature_name, round(1 / (1 + exp(-gate_logit)), 6) as importance_score from importance",
        "importance",
    ),
)
def gate_report(spark, sf_dir):
    return rounded(ops.gate_report(importance(spark, sf_dir)))


@query(
    "gate_status",
    with_views(
        """select expert_name, feature_name, case when g < 0.1 then '!!! ALMOST KILLED !!!' when g > 0.5 then 'OPEN'
        else 'CLOSED' end as status from (select *, 1 / (1 + exp(-gate_logit)) as g from importance)""",
        "importance",
    ),
)
def gate_status(spark, sf_dir):
    report = ops.gate_report(importance(spark, sf_dir))
    return report.select("expert_name", "feature_name", scalars.gate_status(F.col("importance_score")).alias("status"))


@query(
    "gate_entropy",
    with_views(
        """select round(avg(e), 6) as gate_entropy from (select expert_name, avg(-(weight * ln(weight + 1e-8::double) +
        (1 - weight) * ln(1 - weight + 1e-8::double))) as e from w group by 1)""",
        "scores", pr=PROBS, w=_WEIGHTS,
    ),
)
def gate_entropy(spark, sf_dir):
    return rounded(ops.gate_entropy(expert_weights(spark, sf_dir), gate="weight"))
