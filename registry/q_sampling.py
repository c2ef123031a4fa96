"""Queries for splits and samples with exact sizes."""

from __future__ import annotations

from pyspark.sql import functions as F

from flowloom.operators import sampling
from registry.core import query
from registry.fixtures import orders_labelled, packets, packets_pure, with_views

VAL_RATIO = f"{0.1 / (1.0 - 0.1)!r}::double"
N_TEST = "case when n - ceil(0.1::double * n) >= 1 then ceil(0.1::double * n) else 0 end"


def sizes_sql(source: str, key: str, fewest: int) -> str:
    return f"""select {key}, n, n_test, case when n_test > 0 and n - n_test - ceil({VAL_RATIO} * (n - n_test)) >= 1
        then ceil({VAL_RATIO} * (n - n_test)) else 0 end as n_val
      from (select {key}, n, case when n >= {fewest} then {N_TEST} else 0 end as n_test
            from (select {key}, count(*) as n from {source} group by {key}))"""


SPLIT_CASE = "case when r <= n_test then 'test' when r <= n_test + n_val then 'validation' else 'train' end as split"


@query(
    "split_packets",
    with_views(
        f"select row_id, label, {SPLIT_CASE} from (select *, row_number() over (partition by label order by "
        "md5('42|' || row_id)) as r from orders_l) join z using (label)",
        "orders_l",
        z=sizes_sql("orders_l", "label", 2),
    ),
)
def split_packets(spark, sf_dir):
    return sampling.split_packets(orders_labelled(spark, sf_dir).drop("flow"), "row_id")


FLOWS = "select label, stream_id, count(*) as n_packets from packets_pure group by 1, 2"


@query(
    "split_flows",
    with_views(
        f"select packet_id, p.label, p.stream_id, {SPLIT_CASE} from packets_pure p join (select *, row_number() over "
        "(partition by label order by md5('42|' || stream_id)) as r from fl) using (label, stream_id) "
        "join z using (label)",
        "packets_pure",
        fl=FLOWS,
        z=sizes_sql("fl", "label", 3),
    ),
)
def split_flows(spark, sf_dir):
    return sampling.split_flows(packets_pure(spark, sf_dir).select("packet_id", "label", "stream_id"))


@query(
    "split_flows_mixed",
    with_views(
        f"select packet_id, p.label, p.stream_id, {SPLIT_CASE} from packets p join (select *, row_number() over "
        "(partition by label order by md5('42|' || stream_id)) as r from fl) using (label, stream_id) "
        "join z using (label)",
        "packets",
        fl=FLOWS.replace("packets_pure", "packets"),
        z=sizes_sql("fl", "label", 3),
    ),
)
def split_flows_mixed(spark, sf_dir):
    """Flows are (label, flow) pairs, so a flow with several labels may fall into several splits."""
    return sampling.split_flows(packets(spark, sf_dir).select("packet_id", "label", "stream_id"))


def shared_out(size: str, whole: str, draws: str) -> str:
    """Largest-remainder share, ties to the lower bin (fragment using floor and remainder windows)."""
    base = f"(({draws}) * {size} // {whole})"
    remainder = f"(({draws}) * {size} - {base} * {whole})"
    return (
        f"{base} + case when {remainder} > 0 and row_number() over (partition by label order by {remainder} desc, bin) "
        f"<= ({draws}) - sum({base}) over (partition by label) then 1 else 0 end"
    )


# bins of flow lengths per label: most bins first, quantile edges by linear interpolation
LENGTH_CTES = {
    "fl": FLOWS,
    "tot": sizes_sql("fl", "label", 3),
    "q": " union all ".join(
        f"select label, {k} as k, list_sort(list_distinct(quantile_cont(n_packets, "
        f"[{', '.join(repr(i / k) + '::double' for i in range(k + 1))}]))) as edges from fl group by label"
        for k in (2, 3, 4)
    ),
    "pl": "select fl.label, stream_id, k, len(list_filter(edges[2:], lambda e: e < n_packets)) as bin "
    "from fl join q using (label)",
    "ok": """select label, max(k) as k from (select label, k, count(*) as bins, min(m) as smallest from
        (select label, k, bin, count(*) as m from pl group by 1, 2, 3) group by 1, 2) join tot using (label)
      where k <= n and n >= 3 and bins >= 2 and smallest >= 2 and n_test >= bins and n - n_test >= bins group by 1""",
    "ch": """select pl.label, stream_id, bin from pl join ok using (label, k)
      union all select label, stream_id, 0 from fl where label not in (select label from ok)""",
    "sz": """select label, bin, count(*) as size, any_value(n)::bigint as n, any_value(n_test)::bigint as n_test,
      any_value(n_val)::bigint as n_val from ch join tot using (label) group by 1, 2""",
    "rs": f"select *, {shared_out('size', 'n', 'n - n_test')} as rest from sz",
    "fe": """select *, case when bins = 1 or (low >= 2 and n_val >= bins and n - n_test - n_val >= bins) then n_val
      else 0 end as nv from (select *, count(*) over (partition by label) as bins, min(rest) over (partition by label)
      as low from rs)""",
    "kp": f"select *, {shared_out('rest', '(n - n_test)', 'n - n_test - nv')} as kept from fe",
}


@query(
    "split_flows_by_length",
    with_views(
        """select packet_id, p.label, p.stream_id, case when r <= size - rest then 'test'
          when nv > 0 and r <= size - kept then 'validation' else 'train' end as split
        from packets_pure p join (select *, row_number() over (partition by label, bin order by
          md5('42|' || stream_id)) as r from ch) c using (label, stream_id)
        join (select label, bin, size, rest, nv, kept from kp) k on k.label = c.label and k.bin = c.bin""",
        "packets_pure",
        **LENGTH_CTES,
    ),
)
def split_flows_by_length(spark, sf_dir):
    df = packets_pure(spark, sf_dir).select("packet_id", "label", "stream_id")
    return sampling.split_flows_by_length(df, "packet_id")


TARGET = "least(greatest(round_even(n * 0.3::double, 0), 1), n)::bigint"


@query(
    "sample_flows",
    with_views(
        f"select packet_id, label, stream_id from packets_pure join (select label, stream_id from fl join "
        f"(select label, {TARGET} as t from (select label, count(*) as n from fl group by 1)) using (label) qualify "
        "row_number() over (partition by label order by md5('42|' || stream_id)) <= t) using (label, stream_id)",
        "packets_pure",
        fl=FLOWS,
    ),
)
def sample_flows(spark, sf_dir):
    df = packets_pure(spark, sf_dir).select("packet_id", "label", "stream_id")
    return sampling.sample_flows(df, 0.3, "packet_id")


def long_sql(ratio: float) -> str:
    h = "md5('42|' || stream_id)"
    return with_views(
        "select packet_id, label, stream_id from packets_pure join "
        "(select label, stream_id from d1 where taken union all select label, stream_id from d2 where r <= more) "
        "using (label, stream_id)",
        "packets_pure",
        fl=FLOWS,
        po=f"select *, row_number() over (partition by label order by n_packets desc, {h}) as lr, "
        "count(*) over (partition by label) as n from fl",
        pm="select *, greatest(1, ceil(n * 0.5::double)) as n_long, "
        "case when lr <= greatest(1, ceil(n * 0.5::double)) then 'long' else 'short' end as pool from po",
        tg=f"select *, {TARGET} as t from pm",
        pq=f"select *, least(ceil(t * {ratio}::double), t, n_long)::bigint as fl_n from tg",
        d1=f"""select *, row_number() over (partition by label, pool order by {h}) <= case pool when 'long' then fl_n
          else case when n - n_long >= t - fl_n then t - fl_n else 0 end end as taken from pq""",
        d2=f"""select *, row_number() over (partition by label order by {h}) as r,
          case when n - n_long >= t - fl_n then 0 else t - fl_n end as more from d1 where not taken""",
    )


@query("sample_flows_long", long_sql(0.7))
def sample_flows_long(spark, sf_dir):
    df = packets_pure(spark, sf_dir).select("packet_id", "label", "stream_id")
    return sampling.sample_flows(df, 0.3, "packet_id", prefer_long=True, long_ratio=0.7)


def sample_sql(size: str) -> str:
    return with_views(
        f"select row_id, label, flow from orders_l join (select label, {size} as take from c) using (label) qualify "
        "row_number() over (partition by label order by md5('42|' || row_id)) <= take",
        "orders_l",
        c="""select label, count(*) as n, round_even(0.1::double * (select count(*) from orders_l) /
          (select count(distinct label) from orders_l), 0) as av from orders_l group by 1""",
    )


PROPORTIONAL = "greatest(round_even(n * 0.1::double, 0), 1)"
HYBRID = "case when n <= av then n else greatest(round_even(n * 0.1::double, 0), av) end"


@query("sample_proportional", sample_sql(PROPORTIONAL))
def sample_proportional(spark, sf_dir):
    return sampling.sample_proportional(orders_labelled(spark, sf_dir), 0.1, "row_id")


@query("sample_hybrid", sample_sql(HYBRID))
def sample_hybrid(spark, sf_dir):
    return sampling.sample_hybrid(orders_labelled(spark, sf_dir), 0.1, "row_id")


@query("sample_capped", sample_sql("least(n, av)"))
def sample_capped(spark, sf_dir):
    return sampling.sample_capped(orders_labelled(spark, sf_dir), 0.1, "row_id")


SKEWED = "case when row_id % 100 = 0 then 'rare' when row_id % 3 = 0 then 'hot' else label end"


@query(
    "balance",
    with_views(
        """select row_id, label, unnest(range(1, (copies + 1)::bigint)) as copy from (select *, case when n >= av then
            case when r <= av then 1 else 0 end else av // n + case when r <= av % n then 1 else 0 end end as copies
          from (select s.*, c.n, c.av, row_number() over (partition by s.label order by md5('42|' || row_id)) as r
            from s join c using (label))) where copies > 0""",
        "orders_l",
        s=f"select row_id, {SKEWED} as label from orders_l",
        c="""select label, count(*) as n, greatest(round_even(0.5::double * (select count(*) from s) /
          (select count(distinct label) from s), 0), 1)::bigint as av from s group by 1""",
    ),
)
def balance(spark, sf_dir):
    df = orders_labelled(spark, sf_dir).withColumn("label", F.expr(SKEWED)).select("row_id", "label")
    return sampling.balance(df, 0.5, "row_id")
