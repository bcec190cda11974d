"""Series of measurements (the events of each user stand for a run's log)."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.operators import history as H
from loam.queries import query
from loam.session import read

_O = "order by ts, event_id"


def _events(spark, d):
    return read(spark, d, "events")


_WIN = f"""r as (select event_type, value, row_number() over (partition by event_type {_O}) - 1 as r from events where value is not null),
w as (select event_type, floor(r / 50)::bigint as "window", min(r)::bigint as start, max(r)::bigint as "end", avg(value) as mean from r group by event_type, floor(r / 50) having count(*) = 50)"""


@query(f'with {_WIN} select event_type, "window", start, "end", round(mean, 6) as mean from w')
def tumbling_means(spark, d):
    """Means of every fifty values in order."""
    return H.tumbling_means(_events(spark, d), "event_type", ["ts", "event_id"], "value", 50).withColumn("mean", F.round("mean", 6))


@query(
    f"""with recursive {_WIN}, n as (select event_type, row_number() over (partition by event_type order by "window") as i, start, mean, count(*) over (partition by event_type) as total from w),
f as (select event_type, i, mean as best, 0 as stale, null::bigint as hit from n where i = 1 union all
  select f.event_type, n.i, case when (f.best - n.mean) / f.best >= 0.01 then n.mean else f.best end, case when (f.best - n.mean) / f.best >= 0.01 then 0 else f.stale + 1 end,
   coalesce(f.hit, case when not ((f.best - n.mean) / f.best >= 0.01) and f.stale + 1 >= 3 then (select m.start from n m where m.event_type = f.event_type and m.i = n.i - 2) end) from f join n on n.event_type = f.event_type and n.i = f.i + 1)
select f.event_type, n.total::bigint as windows, round(best, 6) as best, hit as plateau_start from f join n using (event_type, i) where i = total"""
)
def plateau(spark, d):
    """Where three windows in a row bring no improvement of a hundredth."""
    x = H.plateau(H.tumbling_means(_events(spark, d), "event_type", ["ts", "event_id"], "value", 50), "event_type")
    return x.withColumn("best", F.round("best", 6))


@query(
    """with r as (select user_id, value, row_number() over (partition by user_id order by ts desc, event_id desc) as r, count(*) over (partition by user_id) as n from events where value is not null),
w as (select *, least(20, greatest(5, floor(n / 10))) as w from r),
g as (select user_id, max(n)::bigint as n, max(w) as w, avg(value) filter (r > w and r <= 2 * w) as previous, avg(value) filter (r <= w) as recent from w group by user_id having max(n) >= 2 * max(w))
select user_id, n, round(previous, 6) as previous, round(recent, 6) as recent, round((recent - previous) / previous * 100, 4) as percent, case when abs((recent - previous) / previous * 100) < 2 then 'plateau' when recent < previous then 'improving' else 'worse' end as state from g"""
)
def trailing_change(spark, d):
    """The last values of each series against those before."""
    x = H.trailing_change(_events(spark, d), "user_id", ["ts", "event_id"], "value")
    return x.select("user_id", "n", F.round("previous", 6).alias("previous"), F.round("recent", 6).alias("recent"), F.round("percent", 4).alias("percent"), "state")


@query("select (user_id % 5)::int as epoch, count(*)::bigint as updates, round(avg(value), 6) as mean, round(min(value), 6) as least, round(arg_max(value, event_id), 6) as last from events where value is not null group by 1")
def epoch_summary(spark, d):
    """Updates, mean, least and last loss by epoch."""
    x = H.by_epoch(_events(spark, d), (F.col("user_id") % 5).cast("int"), "event_id", "value")
    return x.select("epoch", "updates", *[F.round(c, 6).alias(c) for c in ("mean", "least", "last")])


@query("select event_type, first(user_id % 5 order by value, event_id)::int as best_epoch, round(min(value), 6) as best_loss from events where value is not null group by event_type")
def best_epoch(spark, d):
    """The epoch of the least loss, the first on ties."""
    x = _events(spark, d).withColumn("epoch", (F.col("user_id") % 5).cast("int"))
    return H.best_epoch(x, "event_type", "epoch", "value", "event_id").withColumn("best_loss", F.round("best_loss", 6))


_RUNS = """r as (select s_suppkey as run, case s_suppkey % 5 when 0 then null when 1 then 8 when 2 then 16 when 3 then 32 else 12 end::int as rank, 16.0::double as alpha, s_suppkey % 2 = 0 as use_rs,
 case when s_suppkey % 11 = 0 then null else abs(s_acctbal::double) / 3000 end as initial_loss, case when s_suppkey % 13 = 0 then null else abs(s_acctbal::double) / 3500 + (s_suppkey % 3) * 0.2 end as final_loss from supplier)"""


@query(
    f"""with {_RUNS}, p as (select *, case when rank > 0 then case when use_rs then alpha / sqrt(rank) else alpha / rank end end as scaling, exp(initial_loss) as ip, exp(final_loss) as fp from r)
select run, round(scaling, 6) as scaling, round((fp - ip) / ip * 100, 4) as change_percent, case when final_loss is null or initial_loss is null then 'Incomplete' when run = (select arg_min(run, (final_loss, run)) from r where final_loss is not null) then 'BEST'
 when (fp - ip) / ip * 100 < 0 then 'Improved' else 'Degraded' end as verdict, case rank when 8 then 'A / Low' when 16 then 'B / Balanced' when 32 then 'C / High' else 'Custom' end as capacity from p"""
)
def run_table(spark, d):
    """Runs with scaling, change of perplexity and verdict."""
    k = F.col("s_suppkey")
    bal = F.abs(F.col("s_acctbal").cast("double"))
    runs = read(spark, d, "supplier").select(
        k.alias("run"), F.when(k % 5 == 1, 8).when(k % 5 == 2, 16).when(k % 5 == 3, 32).when(k % 5 == 4, 12).cast("int").alias("rank"), F.lit(16.0).alias("alpha"), (k % 2 == 0).alias("use_rs"),
        F.when(k % 11 != 0, bal / 3000).alias("initial_loss"), F.when(k % 13 != 0, bal / 3500 + (k % 3) * 0.2).alias("final_loss"),
    )
    return H.run_table(runs).select("run", F.round("scaling", 6).alias("scaling"), F.round("change_percent", 4).alias("change_percent"), "verdict", "capacity")


@query(
    "with f as (select coalesce(source_corpus, 'none') as run, case when record_id % 3 = 0 then 'checkpoint-' || record_id || '/' else '' end || path as path from rfc4136 where path is not null) select run, path from f qualify row_number() over (partition by run order by contains(path, 'checkpoint-'), len(string_split(path, '/')), path) = 1"
)
def newest_artifacts(spark, d):
    """One file of each run, final ones before checkpoints."""
    x = read(spark, d, "rfc4136").where("path is not null")
    path = F.concat(F.when(F.col("record_id") % 3 == 0, F.concat(F.lit("checkpoint-"), F.col("record_id").cast("string"), F.lit("/"))).otherwise(""), "path")
    return H.newest_artifact(x.select(F.coalesce("source_corpus", F.lit("none")).alias("run"), path.alias("path")), "run", "path")


@query("select l.l_orderkey, l.l_linenumber, count(*)::bigint as overlaps from lineitem l join lineitem m on l.l_orderkey = m.l_orderkey and l.l_linenumber <> m.l_linenumber and not (m.l_quantity > l.l_quantity + 5 or m.l_quantity + 5 < l.l_quantity or m.l_tax > l.l_tax + 0.02 or m.l_tax + 0.02 < l.l_tax) group by all")
def box_overlaps(spark, d):
    """Lines of one order whose boxes (quantity by tax) overlap: the predicate that takes table regions out of a page."""
    l = read(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_quantity", "l_tax")  # noqa: E741
    m = l.select("l_orderkey", F.col("l_linenumber").alias("m"), F.col("l_quantity").alias("x"), F.col("l_tax").alias("y"))
    apart = (F.col("x") > F.col("l_quantity") + 5) | (F.col("x") + 5 < F.col("l_quantity")) | (F.col("y") > F.col("l_tax") + 0.02) | (F.col("y") + 0.02 < F.col("l_tax"))
    x = l.join(m, "l_orderkey").where((F.col("l_linenumber") != F.col("m")) & ~apart)
    return x.groupBy("l_orderkey", "l_linenumber").agg(F.count(F.lit(1)).alias("overlaps"))


@query(
    f"""with {_RUNS}, p as (select *, exp(initial_loss) as ip, exp(final_loss) as fp from r)
select run, round(final_loss - initial_loss, 6) as loss_change, case when initial_loss <> 0 then round((final_loss - initial_loss) / initial_loss * 100, 4) end as loss_change_percent, round((fp - ip) / ip * 100, 4) as perplexity_change_percent,
case when initial_loss is null or final_loss is null then 'UNAVAILABLE' when final_loss < initial_loss then 'GOOD' when final_loss > initial_loss then 'NEEDS IMPROVEMENT' else 'UNCHANGED' end as state from p"""
)
def run_deltas(spark, d):
    """Change of loss and perplexity of each run."""
    k, bal = F.col("s_suppkey"), F.abs(F.col("s_acctbal").cast("double"))
    runs = read(spark, d, "supplier").select(k.alias("run"), F.when(k % 11 != 0, bal / 3000).alias("initial_loss"), F.when(k % 13 != 0, bal / 3500 + (k % 3) * 0.2).alias("final_loss"))
    return H.run_deltas(runs).select("run", F.round("loss_change", 6).alias("loss_change"), F.round("loss_change_percent", 4).alias("loss_change_percent"), F.round("perplexity_change_percent", 4).alias("perplexity_change_percent"), "state")


@query("select user_id, arg_min(value, (ts, event_id)) as first, arg_max(value, (ts, event_id)) as last, min(value) as least from events where value is not null group by user_id")
def series_extremes(spark, d):
    """First, last and least value of each series."""
    return H.extremes(_events(spark, d), "user_id", ["ts", "event_id"], "value")
