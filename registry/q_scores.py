"""Queries for packet and flow scores, labels and metrics."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.functions import scalars
from flowloom.operators import metrics
from flowloom.operators import scores as ops
from registry.core import query
from registry.fixtures import LABELS, NUM_CLASSES, SPLIT, scores, table, with_views

C = NUM_CLASSES
FLOW = "stream_id"


def flow_rows(df, keys=(FLOW,), column="scores", index="class_id"):
    """One row per (flow, class) with rounded values."""
    long = ops.as_long(df, column, list(keys), index)
    return long.withColumn("value", F.round("value", 6))


PROBS = """select packet_id, stream_id, label_id, list_transform(logits, lambda x: exp(x - m) /
  list_sum(list_transform(logits, lambda y: exp(y - m)))) as p from (select *, list_max(logits) as m from scores)"""
LX = "select packet_id, stream_id, packet_score, list_max(logits) as top, unnest(range(0, 5))::int as class_id, " \
     "unnest(logits) as x from scores"


@query(
    "softmax_argmax",
    with_views(
        "select packet_id, (list_position(p, list_max(p)) - 1)::int as predicted, round(list_max(p), 6) as max_prob, "
        "round(list_sum(p), 6) as total from pr",
        "scores",
        pr=PROBS,
    ),
)
def softmax_argmax(spark, sf_dir):
    df = scores(spark, sf_dir).select("packet_id", scalars.softmax(F.col("logits")).alias("p"))
    return df.select(
        "packet_id",
        scalars.argmax(F.col("p")).alias("predicted"),
        F.round(F.array_max("p"), 6).alias("max_prob"),
        F.round(F.aggregate("p", F.lit(0.0), lambda a, x: a + x), 6).alias("total"),
    )


ALPHA = [1.0, 0.5, 2.0, 1.5, 0.25]


@query(
    "focal_loss",
    with_views(
        f"""select label, count(*) as n, round(avg(loss), 6) as mean_loss, round(sum(loss), 3) as sum_loss from
        (select label, ({ALPHA}::double[])[label_id + 1] * power(1 - exp(-ce), 2) * ce as loss from
          (select label, label_id, m + ln(list_sum(list_transform(logits, lambda x: exp(x - m)))) - logits[label_id + 1]
            as ce from (select *, list_max(logits) as m from scores))) group by label""",
        "scores",
    ),
)
def focal_loss(spark, sf_dir):
    loss = scalars.focal_loss(F.col("logits"), F.col("label_id").cast("int"), ALPHA, 2.0)
    df = scores(spark, sf_dir).select("label", loss.alias("loss"))
    return df.groupBy("label").agg(
        F.count(F.lit(1)).alias("n"),
        F.round(F.avg("loss"), 6).alias("mean_loss"),
        F.round(F.sum("loss"), 3).alias("sum_loss"),
    )


@query(
    "flow_mean_logits",
    with_views("select stream_id, class_id, round(avg(x), 6) as value from lx group by 1, 2", "scores", lx=LX),
)
def flow_mean_logits(spark, sf_dir):
    return flow_rows(ops.flow_mean(scores(spark, sf_dir), C))


@query(
    "flow_mean_probs",
    with_views(
        "select stream_id, class_id, round(avg(v), 6) as value from (select stream_id, "
        "unnest(range(0, 5))::int as class_id, unnest(p) as v from pr) group by 1, 2",
        "scores",
        pr=PROBS,
    ),
)
def flow_mean_probs(spark, sf_dir):
    return flow_rows(ops.flow_mean(scores(spark, sf_dir), C, probabilities=True))


def weighted_sql(score: str) -> str:
    return f"""select stream_id, class_id, round(sum(exp(z - m) * x) / sum(exp(z - m)), 6) as value from
      (select *, {score} as z, max({score}) over (partition by stream_id) as m from lx) group by 1, 2"""


@query("flow_soft_weighted", with_views(weighted_sql("top / 0.5::double"), "scores", lx=LX))
def flow_soft_weighted(spark, sf_dir):
    return flow_rows(ops.flow_soft_weighted(scores(spark, sf_dir), C, temp=0.5))


@query("flow_weighted", with_views(weighted_sql("packet_score * 40"), "scores", lx=LX))
def flow_weighted(spark, sf_dir):
    df = scores(spark, sf_dir).withColumn("attention", F.col("packet_score") * 40)
    return flow_rows(ops.flow_weighted(df, C, "attention"))


@query(
    "flow_topk_mean",
    with_views(
        "select stream_id, class_id, round(avg(x), 6) as value from (select * from lx qualify row_number() over "
        "(partition by stream_id, class_id order by top desc, packet_id) <= 8) group by 1, 2",
        "scores",
        lx=LX,
    ),
)
def flow_topk_mean(spark, sf_dir):
    return flow_rows(ops.flow_topk_mean(scores(spark, sf_dir), C, 8, "packet_id"))


@query(
    "flow_logsumexp",
    with_views(
        """select stream_id, class_id, round(max(m) + ln(sum(exp(x - m))) - ln(count(*)), 6) as value from
        (select *, max(x) over (partition by stream_id, class_id) as m from lx) group by 1, 2""",
        "scores",
        lx=LX,
    ),
)
def flow_logsumexp(spark, sf_dir):
    return flow_rows(ops.flow_logsumexp(scores(spark, sf_dir)))


# -- vector pooling ---------------------------------------------------------------------------------------------

DIM = 64
_VECTORS = "select vec_id, label, unnest(range(0, 64))::int as dim, unnest(embedding)::double as x, " \
           "embedding[1]::double as score from embeddings"


def pooled(df):
    return flow_rows(df, ["label"], "pooled", "dim")


def vectors_sql(expression: str, source: str = "v") -> str:
    return f"with v as ({_VECTORS}) select label, dim, round({expression}, 6) as value from {source} group by 1, 2"


@query("pool_vectors_max", vectors_sql("max(x)"))
def pool_vectors_max(spark, sf_dir):
    return pooled(ops.pool_vectors(table(spark, sf_dir, "embeddings"), "label", "embedding", DIM, "max"))


@query("pool_vectors_mean", vectors_sql("avg(x)"))
def pool_vectors_mean(spark, sf_dir):
    return pooled(ops.pool_vectors(table(spark, sf_dir, "embeddings"), "label", "embedding", DIM, "mean"))


@query(
    "pool_vectors_first_n",
    vectors_sql(
        "avg(x)",
        "(select * from v qualify row_number() over (partition by label, dim order by vec_id) <= 16)",
    ),
)
def pool_vectors_first_n(spark, sf_dir):
    return pooled(
        ops.pool_vectors(
            table(spark, sf_dir, "embeddings"), "label", "embedding", DIM, "mean", first_n=16, order_by="vec_id"
        )
    )


@query("pool_vectors_attn", vectors_sql("sum(exp(score / 0.05::double) * x) / sum(exp(score / 0.05::double))"))
def pool_vectors_attn(spark, sf_dir):
    df = table(spark, sf_dir, "embeddings")
    score = F.get("embedding", F.lit(0)).cast("double")
    return pooled(ops.pool_vectors(df, "label", "embedding", DIM, "attn", score=score, tau=0.05))


# -- labels and metrics -----------------------------------------------------------------------------------------

MAJORITY = """select stream_id, arg_max(label_id, n * 1000 - label_id) as label_id, count(*) > 1 as is_mixed
  from (select stream_id, label_id, count(*) as n from scores group by 1, 2) group by 1"""


@query(
    "flow_label",
    with_views(
        "select m.stream_id, m.label_id, m.is_mixed::int as is_mixed, s.smallest from m join "
        "(select stream_id, min(label_id) as smallest from scores group by 1) s using (stream_id)",
        "scores",
        m=MAJORITY,
    ),
)
def flow_label(spark, sf_dir):
    df = scores(spark, sf_dir)
    majority = ops.flow_label(df).withColumn("is_mixed", F.col("is_mixed").cast("int"))
    smallest = ops.flow_label(df, rule="smallest").select(FLOW, F.col("label_id").alias("smallest"))
    return majority.join(smallest, FLOW)


PACKET_PRED = "select label_id as actual, list_position(logits, list_max(logits)) - 1 as predicted from scores"


def cm_sql(predictions: str, columns: int = C) -> str:
    return f"""select a.range as actual, p.range as predicted, count(x.actual) as n from range({C}) a
      cross join range({columns}) p left join ({predictions}) x on x.actual = a.range and x.predicted = p.range
      group by 1, 2"""


PACKET_CM = cm_sql(PACKET_PRED)


def per_class_sql(cm: str = "cm", key: str = "", classes: str | None = None) -> str:
    lead = f"{key}, " if key else ""
    same = f" and y.{key} = c.{key}" if key else ""
    classes = classes or f"(select distinct {lead}actual as class_id from {cm})"
    return f"""select *, 2 * (precision * recall) / (precision + recall + 1e-8::double) as f1 from (select *,
        tp / (predicted + 1e-8::double) as precision, tp / (support + 1e-8::double) as recall from
        (select {lead}class_id, coalesce((select sum(n) from {cm} y where y.actual = c.class_id{same}), 0)::bigint
           as support, coalesce((select sum(n) from {cm} y where y.predicted = c.class_id{same}), 0)::bigint
           as predicted, coalesce((select sum(n) from {cm} y where y.actual = c.class_id
           and y.predicted = c.class_id{same}), 0)::bigint as tp from {classes} c))"""


PER_CLASS = per_class_sql()
METRICS = [
    "precision_macro", "recall_macro", "f1_macro", "precision_weighted", "recall_weighted", "f1_weighted", "accuracy",
]


def metrics_sql(pc: str = "pc", key: str = "", prefix: str = "", tail: str = ", sum(support)::bigint as samples") -> str:
    lead = f"{key}, " if key else ""
    parts = [f"round(avg({m}), 6) as {prefix}{m}_macro" for m in ("precision", "recall", "f1")]
    parts += [
        f"round(sum({m} * support) / sum(support), 6) as {prefix}{m}_weighted" for m in ("precision", "recall", "f1")
    ]
    parts.append(f"round(sum(tp) / sum(support)::double, 6) as {prefix}accuracy")
    group = f" group by {key}" if key else ""
    return f"select {lead}{', '.join(parts)}{tail} from {pc}{group}"


def rounded(df):
    kinds = dict(df.dtypes)
    return df.select(*[F.round(n, 6).alias(n) if kinds[n] == "double" else n for n in df.columns])


def packet_cm(spark, sf_dir):
    return metrics.confusion_matrix(metrics.packet_predictions(scores(spark, sf_dir)), C)


@query("confusion_matrix", with_views("select * from cm", "scores", cm=PACKET_CM))
def confusion_matrix(spark, sf_dir):
    return packet_cm(spark, sf_dir)


@query(
    "per_class_metrics",
    with_views(
        "select class_id, support, predicted, tp, round(precision, 6) as precision, round(recall, 6) as recall, "
        "round(f1, 6) as f1 from pc",
        "scores",
        cm=PACKET_CM,
        pc=PER_CLASS,
    ),
)
def per_class_metrics(spark, sf_dir):
    return rounded(metrics.per_class_metrics(packet_cm(spark, sf_dir)))


@query("classification_metrics", with_views(metrics_sql(), "scores", cm=PACKET_CM, pc=PER_CLASS))
def classification_metrics(spark, sf_dir):
    return rounded(metrics.classification_metrics(packet_cm(spark, sf_dir)))


def flow_pred_sql(source: str) -> str:
    """Flow predictions from a (stream_id, class_id, v) table."""
    return f"""select m.label_id as actual, q.predicted, m.is_mixed from m join (select stream_id,
        arg_max(class_id, round(v, 9) * 1000 - class_id * 0.0000001) as predicted from
        (select stream_id, class_id, avg(v) as v from {source} group by 1, 2) group by 1) q using (stream_id)"""


_PROB_LONG = "select stream_id, unnest(range(0, 5))::int as class_id, unnest(p) as v from pr"


@query(
    "flow_eval",
    with_views(
        metrics_sql(
            tail=", sum(support)::bigint as samples, (select count(*) from fpred) as num_flows, "
            "(select count(*) from fpred where is_mixed) as inconsistent_flows"
        ),
        "scores",
        m=MAJORITY,
        pr=PROBS,
        pl=_PROB_LONG,
        fpred=flow_pred_sql("pl"),
        cm=cm_sql("select * from fpred"),
        pc=PER_CLASS,
    ),
)
def flow_eval(spark, sf_dir):
    return rounded(metrics.flow_eval(scores(spark, sf_dir), C))


@query(
    "dual_level_metrics",
    with_views(
        metrics_sql("pc", "level"),
        "scores",
        m=MAJORITY,
        lx=LX,
        ll="select stream_id, class_id, x as v from lx",
        fpred=flow_pred_sql("ll"),
        cm=f"select 'packet' as level, * from ({PACKET_CM}) union all select 'flow', * from "
        f"({cm_sql('select actual, predicted from fpred')})",
        pc=per_class_sql(key="level"),
    ),
)
def dual_level_metrics(spark, sf_dir):
    return rounded(metrics.dual_level_metrics(scores(spark, sf_dir), C))


REJECT = 0.6
_REJECTED = f"""select label_id as actual, case when list_max(p) < {REJECT}::double then {C}
  else list_position(p, list_max(p)) - 1 end as predicted from pr"""


@query(
    "reject_eval",
    with_views(
        metrics_sql(
            prefix="accepted_",
            tail=f", round((select count(*) filter (where predicted = {C}) / count(*)::double from rj), 6) "
            "as rejection_rate",
        ),
        "scores",
        pr=PROBS,
        rj=_REJECTED,
        cm=f"select actual, predicted, count(*) as n from rj where predicted < {C} group by 1, 2",
        pc=per_class_sql(
            classes="(select actual as class_id from cm union select predicted from cm)"
        ),
    ),
)
def reject_eval(spark, sf_dir):
    return rounded(metrics.reject_eval(scores(spark, sf_dir), C, REJECT))


@query("reject_matrix", with_views(cm_sql("select * from rj", C + 1), "scores", pr=PROBS, rj=_REJECTED))
def reject_matrix(spark, sf_dir):
    predicted = metrics.reject_predictions(scores(spark, sf_dir), C, REJECT)
    return metrics.confusion_matrix(predicted, C, extra_columns=1)


@query(
    "cm_percent",
    with_views(
        """select actual, predicted, round(n * 100.0::double / greatest(s, 1), 6) as percent,
          dense_rank() over (order by s desc, actual) as row_place
        from (select *, sum(n) over (partition by actual) as s from cm)""",
        "scores",
        cm=PACKET_CM,
    ),
)
def cm_percent(spark, sf_dir):
    return rounded(metrics.cm_percent(packet_cm(spark, sf_dir)))


@query(
    "cm_table",
    with_views(
        "select actual as actual_id, [" + ", ".join(f"'{x}'" for x in LABELS) + "][actual + 1] as actual_label, "
        + ", ".join(f"sum(case when predicted = {i} then n else 0 end)::bigint as {x}" for i, x in enumerate(LABELS))
        + " from cm group by 1, 2",
        "scores",
        cm=PACKET_CM,
    ),
)
def cm_table(spark, sf_dir):
    return metrics.cm_table(packet_cm(spark, sf_dir), LABELS)


_WANTED = ["view", "click", "absent", "purchase"]
_NAMES = "[" + ", ".join(f"'{x}'" for x in LABELS) + "]"


NAMED = f"""select k.matrix_id, {_NAMES}[a.range + 1] as actual, {_NAMES}[p.range + 1] as predicted,
  count(x.actual) as n from (select distinct matrix_id from pd) k cross join range({C}) a cross join range({C}) p
  left join pd x on x.matrix_id = k.matrix_id and x.actual = a.range and x.predicted = p.range group by 1, 2, 3"""


@query(
    "cm_subset",
    with_views(
        """select n.matrix_id, n.actual, n.predicted, n.n, r.place as row_place, c.place as column_place
        from named n join k r on r.label = n.actual join k c on c.label = n.predicted""",
        "scores",
        pr=f"select *, {SPLIT} as split from scores",
        pd="select split as matrix_id, label_id as actual, list_position(logits, list_max(logits)) - 1 as predicted "
        "from pr",
        named=NAMED,
        k=f"""select label, row_number() over (order by pos) - 1 as place from (select label,
            list_position({_WANTED}, label) as pos, count(*) as n from
            (select distinct matrix_id, actual as label from named) group by 1, 2) where pos is not null
            and n = (select count(distinct matrix_id) from named)""",
    ),
)
def cm_subset(spark, sf_dir):
    df = scores(spark, sf_dir).withColumn("matrix_id", F.expr(SPLIT))
    predicted = df.select("matrix_id", F.col("label_id").alias("actual"), scalars.argmax(F.col("logits")).alias("predicted"))
    cm = metrics.confusion_matrix(predicted, C, keys=["matrix_id"])
    names = F.array(*[F.lit(x) for x in LABELS])
    named = cm.select(
        "matrix_id",
        F.get(names, F.col("actual").cast("int")).alias("actual"),
        F.get(names, F.col("predicted").cast("int")).alias("predicted"),
        "n",
    )
    return metrics.cm_subset(named, _WANTED)


LEVELS = [0.0, 1.0, 2.0, 5.0]


@query(
    "robustness_table",
    with_views(
        "select noise_level, round(sum(tp) / sum(support)::double, 6) as accuracy, round(avg(f1), 6) as f1_macro, "
        "round(avg(precision), 6) as precision_macro, round(avg(recall), 6) as recall_macro from pc group by 1",
        "scores",
        lv=f"select unnest({LEVELS}::double[]) as noise_level",
        noisy="""select noise_level, label_id as actual, list_position(z, list_max(z)) - 1 as predicted from
          (select noise_level, label_id, list_transform(logits, lambda x, i: x + noise_level *
            ((packet_id * 13 * i) % 29) / 10.0::double) as z from scores cross join lv)""",
        cm=f"""select k.noise_level, a.range as actual, p.range as predicted, count(x.actual) as n from lv k
          cross join range({C}) a cross join range({C}) p left join noisy x on x.noise_level = k.noise_level
          and x.actual = a.range and x.predicted = p.range group by 1, 2, 3""",
        pc=per_class_sql(key="noise_level"),
    ),
)
def robustness_table(spark, sf_dir):
    levels = F.array(*[F.lit(x) for x in LEVELS])
    df = scores(spark, sf_dir).withColumn("noise_level", F.explode(levels))
    noisy = F.transform(
        "logits",
        lambda x, i: x + F.col("noise_level") * ((F.col("packet_id") * 13 * (i + 1)) % 29).cast("double") / 10.0,
    )
    return rounded(metrics.robustness_table(df.withColumn("logits", noisy), C))


# -- baseline scorer --------------------------------------------------------------------------------------------


@query("mllib_scores")
def mllib_scores(spark, sf_dir):
    """Logistic regression on packet lengths and flow features; iterative, so without SQL."""
    from flowloom.operators import flows
    from flowloom.plans.scoring import train_scores
    from registry.fixtures import packets_pure

    df = packets_pure(spark, sf_dir).withColumn("split", F.expr(SPLIT))
    df = df.withColumn("length", scalars.hex_to_long(F.col("`ip.len`")))
    featured = flows.flow_features(df, "source", "packet_id")
    names = ["length", "flow_avg_len", "flow_std_len", "flow_large_pkt_ratio", "flow_max_iat"]
    scored = train_scores(featured, F.col("split") == "train", names, C)
    return scored.select(
        "packet_id", "stream_id", "label_id", scalars.argmax(F.col("logits")).alias("predicted")
    )
