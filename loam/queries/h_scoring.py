"""Scores of responses, comparisons, verdicts, perplexities."""

from __future__ import annotations

from pyspark.sql import functions as F

from loam.functions import text as T
from loam.operators import scoring as S
from loam.operators.grouping import first_rows
from loam.queries import query
from loam.queries.a_text import WS
from loam.session import read

W = lambda x: f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9]+')"
P = lambda x: f"array_to_string({W(x)}, ' ')"
_BAG = lambda a, b: f"coalesce(list_sum(list_transform(list_distinct({a}), lambda w: least(len(list_filter({a}, lambda v: v = w)), len(list_filter({b}, lambda v: v = w))))), 0)"
_SRC = """
qs as (select id as query_id, 'exact' as query_set, expected_continuation, expected_concepts as qc from domain_exact_generation_queries union all select id, 'general', null, expected_concepts from generic_forgetting_queries),
mr as (select distinct on (response_id) * from (select distinct response_id, lower(evaluation_stage) as stage, timestamp_utc, model_name, query_id, response, expected_concepts from model_responses) order by response_id, response, stage, timestamp_utc),
en as (select response_id, stage, timestamp_utc, model_name, query_id, response, coalesce(query_set, 'unknown') as query_set, coalesce(expected_concepts, qc) as concepts, expected_continuation as expected from mr left join qs using (query_id))"""
_SCORED = (
    _SRC
    + f""",
p0 as (select *, {P('response')} as rp, {W('response')} as rw, {W('expected')} as ew, coalesce(expected, '') <> '' as has from en),
p1 as (select *, len(list_filter(coalesce(concepts, []), lambda c: len(list_filter(list_transform(regexp_split_to_array(c, '(?i)[ \\t\\n]+or[ \\t\\n]+'), lambda a: {P('a')}),
   lambda a: a <> '' and (contains(' ' || rp || ' ', ' ' || a || ' ') or (length(replace(a, ' ', '')) <= 5 and contains(replace(rp, ' ', ''), replace(a, ' ', '')))))) > 0))::bigint as concept_hits,
   coalesce(len(concepts), 0)::bigint as concept_count from p0),
sc as (select *, case when concept_count > 0 then concept_hits / concept_count end as concept_recall, case when has then starts_with(rp, {P('expected')}) end as exact_prefix,
   case when has then case when len(ew) = 0 then 0.0 else coalesce(list_position(list_transform(range(1, len(ew) + 1), lambda i: coalesce(rw[i] = ew[i], false)), false) - 1, len(ew)) / len(ew) end end as common_prefix,
   case when has then case when len(ew) = 0 then 0.0 else {_BAG('ew', 'rw')} / len(ew) end end as coverage,
   case when len(rw) < 3 then 0.0 else 1 - len(list_distinct(list_transform(range(1, len(rw) - 1), lambda i: array_to_string(rw[i:i+2], ' ')))) / (len(rw) - 2) end as repetition from p1)"""
)
_VALUES = "concept_hits, concept_count, round(concept_recall, 9) as concept_recall, exact_prefix, round(common_prefix, 9) as common_prefix, round(coverage, 9) as coverage, round(repetition, 9) as repetition"


def _enriched(spark, d):
    """Responses with their query's expectations; a response's own fields win, unknown queries are kept."""
    from pyspark.sql import Window

    q1 = read(spark, d, "domain_exact_generation_queries").select(F.col("id").alias("query_id"), F.lit("exact").alias("query_set"), "expected_continuation", F.col("expected_concepts").alias("qc"))
    q2 = read(spark, d, "generic_forgetting_queries").select(F.col("id").alias("query_id"), F.lit("general").alias("query_set"), F.lit(None).cast("string").alias("expected_continuation"), F.col("expected_concepts").alias("qc"))
    r = read(spark, d, "model_responses").select("response_id", F.lower("evaluation_stage").alias("stage"), "timestamp_utc", "model_name", "query_id", "response", "expected_concepts").distinct()
    one = F.row_number().over(Window.partitionBy("response_id").orderBy(F.col("response").asc_nulls_last(), F.col("stage").asc_nulls_last(), F.col("timestamp_utc").asc_nulls_last()))
    r = r.withColumn("_n", one).where("_n = 1").drop("_n")
    return r.join(q1.unionByName(q2), "query_id", "left").withColumn("query_set", F.coalesce("query_set", F.lit("unknown"))).withColumn("expected_concepts", F.coalesce("expected_concepts", "qc")).drop("qc")


def _scored(spark, d):
    return S.score(_enriched(spark, d))


def _rounded(df, *columns):
    for c in columns:
        df = df.withColumn(c, F.round(c, 9))
    return df


@query(f"with {_SCORED}, t as (select query_id, round(max(coverage), 9) as best, count(*)::bigint as responses from sc where coverage is not null and query_id is not null group by query_id) select query_id, best, responses from t order by best desc, responses desc, query_id limit 25")
def top_results(spark, d):
    """The twenty-five queries of the best coverage over all models and stages (a top-k report)."""
    x = _scored(spark, d).where("coverage is not null and query_id is not null").groupBy("query_id").agg(F.round(F.max("coverage"), 9).alias("best"), F.count(F.lit(1)).alias("responses"))
    return x.orderBy(F.desc("best"), F.desc("responses"), "query_id").limit(25)


@query(f"with {_SCORED} select response_id, query_set, {_VALUES} from sc")
def response_scores(spark, d):
    """Concept recall, exact and common prefix, coverage and repetition of each response."""
    x = _scored(spark, d).select("response_id", "query_set", "concept_hits", "concept_count", "concept_recall", "exact_prefix", "common_prefix", "coverage", "repetition")
    return _rounded(x, "concept_recall", "common_prefix", "coverage", "repetition")


_SUMMARY = """count(*)::bigint as responses, sum(concept_hits)::bigint as concept_hits, sum(concept_count)::bigint as concept_count, round(case when sum(concept_count) > 0 then sum(concept_hits) / sum(concept_count) end, 9) as micro_recall, round(avg(concept_recall), 9) as macro_recall,
count(*) filter (exact_prefix)::bigint as exact_matches, count(exact_prefix)::bigint as exact_queries, round(avg(common_prefix), 9) as mean_prefix, round(avg(coverage), 9) as mean_coverage, round(avg(repetition), 9) as mean_repetition"""


@query(f"with {_SCORED} select query_set, stage, {_SUMMARY} from sc group by all")
def score_summary(spark, d):
    """Micro and macro recall and averages by query set and stage."""
    return _rounded(S.summary(_scored(spark, d), "query_set", "stage"), "micro_recall", "macro_recall", "mean_prefix", "mean_coverage", "mean_repetition")


@query(f"with {_SCORED} select query_set, model_name, grouping(query_set)::int * 2 + grouping(model_name)::int as level, count(*)::bigint as responses, round(avg(concept_recall), 9) as mean_recall, count(*) filter (repetition > 0.3)::bigint as repetitive from sc group by grouping sets ((query_set), (query_set, model_name), ())")
def score_grouping_sets(spark, d):
    """Totals by set, by set and model, and over all."""
    x = _scored(spark, d)
    x.createOrReplaceTempView("loam_scored")
    return _rounded(
        spark.sql("select query_set, model_name, grouping_id() as level_id, count(*) as responses, avg(concept_recall) as mean_recall, count_if(repetition > 0.3) as repetitive from loam_scored group by grouping sets ((query_set), (query_set, model_name), ())")
        .withColumn("level", F.col("level_id").cast("int")).drop("level_id"), "mean_recall",
    )


_LAST = """st as (select * from sc where stage in ('pre_cpt', 'post_cpt') qualify row_number() over (partition by stage, query_id, model_name order by timestamp_utc desc nulls last, response_id desc) = 1),
pr as (select b.query_id, b.model_name, b.query_set, b.response as base_response, a.response as new_response, b.concept_hits as bh, a.concept_hits as nh, coalesce(a.concept_recall, 0) - coalesce(b.concept_recall, 0) as cd, coalesce(a.common_prefix - b.common_prefix, 0) as qd, a.repetition - b.repetition as rd,
  coalesce(a.coverage - b.coverage, 0) as vd from st b join st a on b.stage = 'pre_cpt' and a.stage = 'post_cpt' and a.query_id = b.query_id and a.model_name = b.model_name)"""
_VERDICT = "case when cd > 0 then 'Knowledge improved' when cd < 0 then 'Possible forgetting' when qd > 0 then 'Continuation improved' when qd < 0 then 'Continuation regressed' when rd <= -0.10 then 'Less repetitive' when rd >= 0.10 then 'More repetitive' else 'No clear change' end"


def _stages(spark, d):
    x = _scored(spark, d).where(F.col("stage").isin("pre_cpt", "post_cpt"))
    age = F.coalesce(-F.unix_micros(F.col("timestamp_utc").cast("timestamp")), F.lit(1 << 62))
    x = first_rows(x, ["stage", "query_id", "model_name"], [age, -F.col("response_id")])  # one query holds a tenth of the rows
    return x.where("stage = 'pre_cpt'"), x.where("stage = 'post_cpt'")


def _pairs(spark, d):
    b, a = _stages(spark, d)
    values = ["response", "concept_hits", "concept_recall", "common_prefix", "coverage", "repetition"]
    p = S.paired(b, a, ["query_id", "model_name"], values)
    return S.pair_verdict(S.verdict(p)).join(b.select("query_id", "model_name", "query_set"), ["query_id", "model_name"])


_BLANK = rf"regexp_replace(coalesce(new_response, ''), '[{WS}]+', '', 'g') = ''"
_ASSESS = f"""case when {_BLANK} or nh < bh or vd < -0.10 or rd > 0.10 then 'Needs Improvement' when nh > bh or vd > 0.10 or rd < -0.10 then 'Good' else 'Satisfactory' end as assessment,
case when {_BLANK} or nh < bh or rd > 0.10 then 'Degraded' else 'Retained' end as forgetting"""
_NOTE = """coalesce(nullif(concat_ws('; ', case when nh <> bh then (case when nh > bh then '+' else '' end) || (nh - bh) || ' expected ' || (case when abs(nh - bh) = 1 then 'concept' else 'concepts' end) end,
case when abs(qd) > 0.0001 then 'exact prefix ' || (case when qd > 0 then '+' else '-' end) || printf('%.1f', floor(abs(qd) * 1000 + 0.5) / 10) || ' pp' end, case when rd <= -0.10 then 'less repetitive' when rd >= 0.10 then 'more repetitive' end), ''), 'no measured change') as note"""


@query(f"with {_SCORED}, {_LAST} select query_id, model_name, query_set, (nh - bh)::bigint as hit_delta, round(cd, 9) as concept_delta, round(qd, 9) as prefix_delta, round(rd, 9) as repetition_delta, {_VERDICT} as verdict, {_NOTE}, {_ASSESS} from pr")
def stage_comparison(spark, d):
    """The last response of each query and model before and after, with verdicts."""
    x = _pairs(spark, d).select("query_id", "model_name", "query_set", F.col("hit_delta").cast("bigint").alias("hit_delta"), "concept_delta", "prefix_delta", "repetition_delta", "verdict", "note", "assessment", "forgetting")
    return _rounded(x, "concept_delta", "prefix_delta", "repetition_delta")


@query(f"with {_SCORED}, {_LAST} select query_set, count(*)::bigint as pairs, count(*) filter (cd > 0 or qd > 0)::bigint as gains, count(*) filter (cd < 0 or qd < 0)::bigint as losses, count(*) filter (cd > 0)::bigint as improved, round(100.0 * count(*) filter (cd < 0) / count(*), 9) as degradation_percent from pr group by query_set")
def comparison_summary(spark, d):
    """Gains, losses and the rate of degradation by query set."""
    c, q = F.col("concept_delta"), F.col("prefix_delta")
    x = _pairs(spark, d).groupBy("query_set").agg(
        F.count(F.lit(1)).alias("pairs"), F.count_if((c > 0) | (q > 0)).alias("gains"), F.count_if((c < 0) | (q < 0)).alias("losses"), F.count_if(c > 0).alias("improved"), (100.0 * F.count_if(c < 0) / F.count(F.lit(1))).alias("degradation_percent")
    )
    return _rounded(x, "degradation_percent")


@query(f"with {_SCORED}, {_LAST} select query_id, model_name, case when regexp_matches({_BLANK.split(' = ')[0]}, '^$') or nh < bh or rd > 0.10 then 'Degraded' else 'Retained' end as verdict from pr where query_set = 'general' order by query_id, model_name limit 10")
def forgetting_table(spark, d):
    """Ten general queries before and after (a fixed-size report)."""
    return _pairs(spark, d).where("query_set = 'general'").orderBy("query_id", "model_name").limit(10).select("query_id", "model_name", F.col("forgetting").alias("verdict"))


@query(f"with {_SCORED}, {_LAST} select query_id, model_name, round(rd, 9) as repetition_delta from pr order by round(abs(rd), 9) desc, query_id, model_name limit 6")
def largest_repetition_changes(spark, d):
    """The six largest changes of repetition (a top-k report)."""
    x = _pairs(spark, d).select("query_id", "model_name", F.round("repetition_delta", 9).alias("repetition_delta"))
    return x.orderBy(F.desc(F.round(F.abs("repetition_delta"), 9)), "query_id", "model_name").limit(6)


@query(f"with {_SCORED}, k as (select distinct query_id, model_name, stage from sc where stage in ('pre_cpt', 'post_cpt')), a as (select query_id, model_name from k where stage = 'pre_cpt'), b as (select query_id, model_name from k where stage = 'post_cpt') select *, 'only_base' as side from (select * from a except select * from b) union all select *, 'only_new' from (select * from b except select * from a)")
def unmatched_keys(spark, d):
    """Queries and models that only one stage answered."""
    return S.key_difference(*_stages(spark, d), ["query_id", "model_name"])


@query(f"with {_SRC} select response_id, len(list_filter(coalesce(concepts, []), lambda c: regexp_matches(lower(trim(regexp_replace(coalesce(response, ''), '[{WS}]+', ' ', 'g'), ' ')), '(?:^|[^\\p{{L}}\\p{{N}}_])' || replace(regexp_replace(lower(trim(regexp_replace(c, '[{WS}]+', ' ', 'g'), ' ')), '([\\\\.\\[\\](){{}}+*?^$|\\-])', '\\\\\\1', 'g'), ' ', '\\s+') || '(?:[^\\p{{L}}\\p{{N}}_]|$)')))::bigint as whole_word_hits from en")
def whole_word_concepts(spark, d):
    """Concepts as whole words (the second reading of a match)."""
    return _enriched(spark, d).select("response_id", S.whole_word_hits(F.col("expected_concepts"), F.col("response")).cast("bigint").alias("whole_word_hits"))


_F = lambda x: f"regexp_extract_all(lower(coalesce({x}, '')), '[a-z0-9][a-z0-9_-]*')"


@query(f"with {_SRC}, t as (select response_id, {_F('response')} as p, {_F('expected')} as r from en where expected is not null), o as (select *, {_BAG('p', 'r')} as o from t) select response_id, round(case when len(p) = 0 or len(r) = 0 or o = 0 then 0.0 else 2.0 * o / (len(p) + len(r)) end, 9) as f1, case when len(p) = 0 or len(r) = 0 or o = 0 then false else 2.0 * o / (len(p) + len(r)) >= 0.30 end as likely_correct from o")
def token_f1_scores(spark, d):
    """F1 of words against the expected continuation."""
    x = _enriched(spark, d).where("expected_continuation is not null").select("response_id", S.token_f1(F.col("response"), F.col("expected_continuation")).alias("f1"))
    return x.select("response_id", F.round("f1", 9).alias("f1"), (F.col("f1") >= 0.30).alias("likely_correct"))


@query(f"with {_SRC}, t as (select query_id, model_name, response_id, {_F('response')} as p, {_F('expected')} as r from en where expected is not null), o as (select *, {_BAG('p', 'r')} as o from t), s as (select query_id, model_name, response_id, round(case when len(p) = 0 or len(r) = 0 or o = 0 then 0.0 else 2.0 * o / (len(p) + len(r)) end, 4) as f1 from o), w as (select *, row_number() over (partition by query_id order by f1 desc, model_name, response_id) = 1 as win from s) select model_name, count(*)::bigint as responses, round(avg(f1), 4) as average_f1, count(*) filter (f1 >= 0.30)::bigint as likely_correct, count(*) filter (win)::bigint as wins from w group by model_name")
def model_wins(spark, d):
    """Average F1, likely correct answers and wins of each model; ties go to the first name."""
    x = _enriched(spark, d).where("expected_continuation is not null").select("query_id", "model_name", "response_id", F.round(S.token_f1(F.col("response"), F.col("expected_continuation")), 4).alias("f1"))
    best = x.groupBy("query_id").agg(F.min_by("response_id", F.struct(-F.col("f1"), F.col("model_name").isNull(), "model_name", "response_id")).alias("best"))
    x = x.join(best, "query_id").withColumn("win", F.col("response_id") == F.col("best"))
    return x.groupBy("model_name").agg(F.count(F.lit(1)).alias("responses"), F.round(F.avg("f1"), 4).alias("average_f1"), F.count_if(F.col("f1") >= 0.30).alias("likely_correct"), F.count_if("win").alias("wins"))


@query(f"with t as (select id, prompt, expected_continuation as e from domain_exact_generation_queries where prompt is not null and expected_continuation is not null) select id, md5(prompt || (case when regexp_matches(prompt, '[{WS}]\\z') or regexp_matches(e, '^[{WS}]') then '' else ' ' end) || e) as joined_md5, length(prompt)::int as boundary from t")
def prompt_target_join(spark, d):
    """Prompt and continuation joined with the boundary kept."""
    x = read(spark, d, "domain_exact_generation_queries").where("prompt is not null and expected_continuation is not null")
    return x.select("id", S.join_at_seam(F.col("prompt"), F.col("expected_continuation")).alias("j")).select("id", F.md5("j.text").alias("joined_md5"), F.col("j.boundary").alias("boundary"))


@query(f"with t as (select id, case when regexp_replace(coalesce(expected_continuation, ''), '[{WS}]+', '', 'g') <> '' then 'expected_continuation' when regexp_replace(coalesce(category, ''), '[{WS}]+', '', 'g') <> '' then 'category' when regexp_replace(coalesce(prompt, ''), '[{WS}]+', '', 'g') <> '' then 'prompt' end as field from domain_exact_generation_queries) select field, count(*)::bigint as n from t group by field")
def reference_fields(spark, d):
    """Which field gives each query its reference: the first that is not blank."""
    x = read(spark, d, "domain_exact_generation_queries").select(S.first_filled("expected_continuation", "category", "prompt").alias("r"))
    return x.groupBy(F.col("r.field").alias("field")).agg(F.count(F.lit(1)).alias("n"))


@query("with s as (select event_type, value / 100 as loss, user_id % 7 + 1 as tokens from events where value is not null), a as (select event_type, sum(tokens)::bigint as tokens, sum(loss * tokens) as nll from s group by event_type) select event_type, tokens, round(nll / tokens, 6) as mean_loss, round(exp(nll / tokens), 4) as perplexity from a")
def token_weighted_perplexity(spark, d):
    """Perplexity from summed losses."""
    s = read(spark, d, "events").where("value is not null").select("event_type", (F.col("value") / 100).alias("loss"), (F.col("user_id") % 7 + 1).alias("tokens"))
    return S.token_weighted(s, "loss", "tokens", "event_type").select("event_type", "tokens", F.round("mean_loss", 6).alias("mean_loss"), F.round("perplexity", 4).alias("perplexity"))


@query(f"with {_SCORED}, g as (select query_set, avg(concept_recall) filter (stage = 'pre_cpt') as br, avg(concept_recall) filter (stage = 'post_cpt') as nr, avg(repetition) filter (stage = 'post_cpt') as rep, avg(coverage) filter (stage = 'post_cpt') as cov from sc group by query_set) select query_set, case when br is null or nr is null then 'Needs Improvement' when nr >= 0.60 and 100 * (nr - br) >= -2 then 'Good' when nr >= 0.30 and 100 * (nr - br) >= -5 then 'Satisfactory' else 'Needs Improvement' end as recall_verdict, case when rep <= 0.10 then 'Good' when rep <= 0.30 then 'Satisfactory' else 'Needs Improvement' end as repetition_verdict, case when cov >= 0.70 then 'Good' when cov >= 0.30 then 'Satisfactory' else 'Needs Improvement' end as coverage_verdict from g")
def assessment_bands(spark, d):
    """Bands of recall, repetition and coverage by query set."""
    x = _scored(spark, d)
    at = lambda s, c: F.avg(F.when(F.col("stage") == s, F.col(c)))
    g = x.groupBy("query_set").agg(at("pre_cpt", "concept_recall").alias("br"), at("post_cpt", "concept_recall").alias("nr"), at("post_cpt", "repetition").alias("rep"), at("post_cpt", "coverage").alias("cov"))
    return g.select("query_set", S.recall_band(F.col("br"), F.col("nr")).alias("recall_verdict"), S.band(F.col("rep"), 0.10, 0.30, up=False).alias("repetition_verdict"), S.band(F.col("cov"), 0.70, 0.30).alias("coverage_verdict"))


@query("with f as (select distinct model_name as stem from model_responses where model_name is not null), r as (select response_id, min(model_name || '_' || coalesce(lower(evaluation_stage), 'none') || '_responses.json') as name from model_responses where model_name is not null group by response_id), h as (select response_id, count(*) as n, min(stem) as stem from r join f on contains(name, stem) group by response_id) select response_id, stem from h where n = 1")
def resolve_files(spark, d):
    """The one known model whose name a response file holds; several give no row."""
    r = read(spark, d, "model_responses").where("model_name is not null")
    names = r.groupBy("response_id").agg(F.min(F.concat_ws("_", "model_name", F.coalesce(F.lower("evaluation_stage"), F.lit("none")), F.lit("responses.json"))).alias("name"))
    return S.resolve_by_name(names, "name", r.select(F.col("model_name").alias("stem")).distinct(), "stem", "response_id")


@query(f"with {_SCORED} select response_id, '| ' || query_id || ' | ' || (case when length(c) > 60 then c[1:59] || '…' else c end) || ' |' as row_text from (select response_id, coalesce(query_id, '-') as query_id, replace(trim(regexp_replace(coalesce(response, ''), '[{WS}]+', ' ', 'g'), ' '), '|', '\\|') as c from sc)")
def markdown_report_rows(spark, d):
    """Rows of a Markdown report, cells escaped and clipped."""
    c = F.replace(T.squeeze(F.coalesce("response", F.lit(""))), F.lit("|"), F.lit("\\|"))
    x = _enriched(spark, d).select("response_id", F.coalesce("query_id", F.lit("-")).alias("q"), c.alias("c"))
    return x.select("response_id", F.concat(F.lit("| "), "q", F.lit(" | "), F.when(F.length("c") > 60, F.concat(F.substring("c", 1, 59), F.lit("…"))).otherwise(F.col("c")), F.lit(" |")).alias("row_text"))


@query(f"with {_SCORED}, {_LAST} select query_set, model_name, grouping(model_name)::int as total, count(*) filter (cd > 0)::bigint as improved, count(*) filter (cd < 0)::bigint as degraded, count(*) filter (cd = 0)::bigint as retained from pr group by grouping sets ((query_set), (query_set, model_name))")
def retention_verdicts(spark, d):
    """Improved, degraded and retained by set, and by set and model."""
    x = _pairs(spark, d).withColumn("v", S.retention_verdict(F.col("base_concept_recall"), F.col("new_concept_recall")))
    n = lambda v: F.count_if(F.col("v") == v)
    return x.groupingSets([[F.col("query_set")], [F.col("query_set"), F.col("model_name")]], F.col("query_set"), F.col("model_name")).agg(
        F.grouping("model_name").cast("int").alias("total"), n("Improved").alias("improved"), n("Degraded").alias("degraded"), n("Retained").alias("retained")
    )


@query("""with s as (select event_type, event_id, value / 100 as base, value / 100 * (0.9 + (event_id % 3) * 0.1) as new, user_id % 7 + 1 as n from events where value is not null),
a as (select event_type, sum(base * n) / sum(n) as b, sum(new * n) / sum(n) as w from s group by event_type) select event_type, round((exp(w) - exp(b)) / exp(b) * 100, 4) as change_percent, case when -(exp(w) - exp(b)) / exp(b) * 100 >= 10 then 'Good' when -(exp(w) - exp(b)) / exp(b) * 100 > 0 then 'Satisfactory' else 'Needs Improvement' end as domain_verdict,
case when (exp(w) - exp(b)) / exp(b) * 100 <= 5 then 'Good' when (exp(w) - exp(b)) / exp(b) * 100 <= 10 then 'Satisfactory' else 'Needs Improvement' end as generic_verdict, true as recomputed from a""")
def perplexity_changes(spark, d):
    """Two models' losses joined by sequence: change of perplexity, verdicts, and a recomputation within tolerance."""
    v = F.col("value") / 100
    s = read(spark, d, "events").where("value is not null").select("event_type", "event_id", v.alias("loss"), (F.col("user_id") % 7 + 1).alias("tokens"))
    new = s.withColumn("loss", F.col("loss") * (0.9 + (F.col("event_id") % 3) * 0.1))
    both = S.paired(s, new, ["event_type", "event_id", "tokens"], ["loss"])
    b, w = S.token_weighted(both, "base_loss", "tokens", "event_type"), S.token_weighted(both, "new_loss", "tokens", "event_type")
    direct = S.token_weighted(s, "loss", "tokens", "event_type").select("event_type", F.col("perplexity").alias("again"))
    p = S.paired(b, w, ["event_type"], ["perplexity"]).join(direct, "event_type")
    change = S.relative_change(F.col("base_perplexity"), F.col("new_perplexity"))
    return p.select("event_type", F.round(change, 4).alias("change_percent"), S.perplexity_band(change, "domain").alias("domain_verdict"), S.perplexity_band(change, "generic").alias("generic_verdict"), S.close(F.col("base_perplexity"), F.col("again"), 1e-9).alias("recomputed"))


@query("with f as (select id, min('exact') as name, count(*) as n from (select id from domain_exact_generation_queries union all select id from generic_forgetting_queries) group by id), r as (select distinct response_id, query_id from model_responses) select response_id, case when query_id in (select id from domain_exact_generation_queries) then 'exact' else 'general' end as query_file from r where query_id in (select id from f where n = 1)")
def resolve_by_query(spark, d):
    """The query file of each response by its identifier, where only one file has it."""
    ids = read(spark, d, "domain_exact_generation_queries").select(F.col("id").alias("query_id"), F.lit("exact").alias("query_file")).unionByName(
        read(spark, d, "generic_forgetting_queries").select(F.col("id").alias("query_id"), F.lit("general").alias("query_file"))
    )
    return S.resolve_by_id(read(spark, d, "model_responses").select("response_id", "query_id").distinct(), "response_id", "query_id", ids, "query_file")
