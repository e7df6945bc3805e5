"""Runs and scores: gates, rates, histograms, outcomes of repeated runs, and checks of an index against its sources."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import links

#: The buckets of the status histogram, in order.
STATUSES = ("ok", "auto_trimmed", "needs_review", "skipped", "failed")


def gate_replay(scores: DataFrame, baseline: Column, key: str, order: str, score: str = "score") -> DataFrame:
    """scores with best_before and kept: a score is kept if it beats all before it, the baseline included. The best of all before is the best
    of those kept, since a score that wasn't kept never exceeds it, so a running maximum says the same as the loop. Rows after the first best
    of 1 or more are left out, as the loop would have stopped."""
    before = Window.partitionBy(key).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    best = F.greatest(baseline, F.coalesce(F.max(score).over(before), baseline))
    rows = scores.withColumn("best_before", best).withColumn("kept", F.col(score) > F.col("best_before"))
    return rows.filter("best_before < 1.0")


def final_scores(replayed: DataFrame, baseline: Column, key: str, score: str = "score") -> DataFrame:
    """key, final_score (the best kept, or else the baseline), kept, rolled_back."""
    best = F.coalesce(F.max(F.when(F.col("kept"), F.col(score))), F.first(baseline))
    return replayed.groupBy(key).agg(best.alias("final_score"), F.count_if("kept").alias("kept_runs"), F.count_if(~F.col("kept")).alias("rolled_back"))


def status_histogram(rows: DataFrame, status: str = "status", buckets: tuple[str, ...] = STATUSES) -> DataFrame:
    """status, n for each of the fixed buckets, 0 where there is none."""
    known = rows.sparkSession.createDataFrame([(b,) for b in buckets], "status string")
    counts = rows.groupBy(F.col(status).alias("status")).agg(F.count("*").alias("n"))
    return known.join(counts, "status", "left").select("status", F.coalesce("n", F.lit(0)).alias("n"))


def pass_counts(results: DataFrame, by: list[str], passed: str = "passed") -> DataFrame:
    """passed and total for each variant."""
    return results.groupBy(*by).agg(F.count_if(F.col(passed)).alias("passed_n"), F.count("*").alias("total"))


def mean_score(scores: DataFrame, by: list[str], score: str = "score") -> DataFrame:
    return scores.groupBy(*by).agg((F.sum(score) / F.greatest(F.count("*"), F.lit(1))).alias("mean_score"))


def first_acceptable(attempts: DataFrame, key: str, order: str, errors: Column, parsed: Column, value: str) -> DataFrame:
    """key, value, order and status: the first attempt without errors (ok), else the last that could be parsed (fallback); null if none could."""
    good = F.min(F.when(parsed & (errors == 0), F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    last = F.max(F.when(parsed, F.struct(F.col(order).alias("o"), F.col(value).alias("v"))))
    rows = attempts.groupBy(key).agg(good.alias("good"), last.alias("last"))
    status = F.when(F.col("good").isNotNull(), "ok").when(F.col("last").isNotNull(), "fallback").otherwise("none")
    chosen = F.coalesce("good", "last")
    return rows.select(key, chosen["o"].alias(order), chosen["v"].alias(value), status.alias("status"))


def non_worsening(revisions: DataFrame, key: str, order: str, problems: str, value: str) -> DataFrame:
    """The revision that a loop ends with which takes each one that isn't worse than what it has: the last one at the running minimum."""
    rows = revisions.withColumn("_best", F.min(problems).over(Window.partitionBy(key).orderBy(order)))
    kept = rows.filter(F.col(problems) == F.col("_best"))
    return kept.groupBy(key).agg(F.max_by(value, order).alias(value), F.max_by(problems, order).alias(problems))


def last_finished(runs: DataFrame, key: str, order: str, data: str) -> DataFrame:
    """key, data: of the last run that left data."""
    return runs.filter(F.col(data).isNotNull()).groupBy(key).agg(F.max_by(data, order).alias(data))


def newest(runs: DataFrame, name: str) -> DataFrame:
    return runs.agg(F.max(name).alias(name))


def compare_index(indexed: DataFrame, present: DataFrame, key: str) -> DataFrame:
    """key, state: stale (indexed, but gone) and unindexed (there, but not indexed)."""
    stale = indexed.select(key).distinct().join(present.select(key), key, "left_anti").withColumn("state", F.lit("stale"))
    new = present.select(key).distinct().join(indexed.select(key), key, "left_anti").withColumn("state", F.lit("unindexed"))
    return stale.unionByName(new)


def missing_fields(passages: DataFrame, fields: tuple[str, ...] = ("doc", "section", "text", "id")) -> DataFrame:
    """field, missing: passages without each mandatory field."""
    counts = passages.agg(*[F.count_if(F.coalesce(F.col(f).cast("string"), F.lit("")) == "").alias(f) for f in fields])
    return counts.unpivot([], list(fields), "field", "missing")


def broken_links(pages: DataFrame, targets: DataFrame) -> DataFrame:
    """path, link of relative links in pages(path, text) whose target (without its fragment) is not among targets(path)."""
    found = pages.select("path", F.explode(F.regexp_extract_all("text", F.lit(r"\]\((?!https?://|mailto:|#)([^)\s]+)\)"), 1)).alias("link"))
    target = links.resolved(F.col("path"), links.without_fragment(F.col("link")))  # above the top nothing is found, however deep the link
    return found.withColumn("target", target).join(targets.select(F.col("path").alias("target")), "target", "left_anti").select("path", "link")


def page_links(pages: DataFrame, key: str, address: str, reference: str) -> DataFrame:
    """key, link, target of pages(key, address, an array of references): where each leads from its page, without a fragment."""
    rows = pages.select(key, F.col(address).alias("_base"), F.explode(reference).alias("link"))
    return rows.select(key, "link", links.resolved(F.col("_base"), F.col("link")).alias("target"))


def link_audit(pages: DataFrame, key: str, address: str, reference: str) -> DataFrame:
    """state, address: of pages that no page links to (unlinked), and of targets that are no page (missing), once each; fragments don't count."""
    there = pages.select(links.without_fragment(F.col(address)).alias("address")).distinct()
    asked = page_links(pages, key, address, reference).select(F.col("target").alias("address")).distinct()
    state = lambda a, b, name: a.join(b, "address", "left_anti").select(F.lit(name).alias("state"), "address")
    return state(there, asked, "unlinked").unionByName(state(asked, there, "missing"))


def unknown_handoffs(agents: DataFrame) -> DataFrame:
    """name, handoff of agents(name, handoffs) that refer to an agent that isn't declared."""
    asked = agents.select("name", F.explode("handoffs").alias("handoff"))
    return asked.join(agents.select(F.col("name").alias("handoff")), "handoff", "left_anti").select("name", "handoff")


def foreign_urls(files: DataFrame) -> DataFrame:
    """path, url: addresses in quotes in files(path, text) that aren't of this machine."""
    found = files.select("path", F.explode(F.regexp_extract_all("text", F.lit("[\"'`](https?://[^\"'`\\s]+)"), 1)).alias("url"))
    return found.filter(~F.col("url").rlike(r"(?i)^https?://(127\.0\.0\.1|localhost|0\.0\.0\.0)(:\d+)?"))


def field_shapes(rows: DataFrame, key: str, json: str, *group: str) -> DataFrame:
    """The group's columns, n, malformed, least_malformed (the least key of a row that doesn't parse; null if all do), shape: the fields and types of
    all texts in the group that parse, merged, as DDL of a VARIANT; a text that is null is malformed. One partial aggregation, however large a group."""
    parsed = rows.select(*group, F.col(key).alias("_key"), F.try_parse_json(json).alias("_v"))
    bad = F.col("_v").isNull()
    return parsed.groupBy(*group).agg(
        F.count("*").alias("n"), F.count_if(bad).alias("malformed"), F.min(F.when(bad, F.col("_key"))).alias("least_malformed"), F.schema_of_variant_agg("_v").alias("shape")
    )


def drifted(shapes: DataFrame, by: str, over: str) -> DataFrame:
    """shapes with drifted: whether a group's shape differs from that of the group before it in over, among those with the same by. Windows hold one
    row a group."""
    before = F.lag("shape").over(Window.partitionBy(by).orderBy(over))
    return shapes.withColumn("drifted", F.coalesce(F.col("shape") != before, F.lit(False)))


def bad_json(files: DataFrame) -> DataFrame:
    """path of files(path, text) that don't parse as JSON."""
    return files.filter(F.try_parse_json("text").isNull()).select("path")


#: Outcome of a lab: its id, exit code and data (JSON).
def assess(runs: DataFrame, by: list[str] | None = None) -> DataFrame:
    """lab, as_expected of runs(lab, attempt, exit_code, data, model): by each lab's own rule over its finished runs; a lab that left no data
    is not as expected. Columns by, if given, keep several sets of labs apart."""
    of = [*(by or []), "lab"]
    done = runs.filter("data is not null")
    last = done.groupBy(*of).agg(F.max_by("data", "attempt").alias("d"), F.max_by("model", "attempt").alias("model"))
    crashed = done.groupBy(*of).agg(F.bool_or(F.col("exit_code") != 0).alias("crashed"))
    result = "array<struct<kind:string,variant:string,passed:boolean>>"
    results = done.select(*of, F.explode(F.from_json(F.get_json_object("data", "$.results"), result)).alias("r"))
    variant = F.when(F.col("lab") == "1", F.col("r.kind")).otherwise(F.col("r.variant"))
    tried = results.filter("lab in ('1', '2')").groupBy(*of, variant.alias("v")).agg((F.count_if("r.passed") / F.count("*")).alias("rate"))
    second = F.max(F.when(F.col("v").isin("specific", "with skill"), F.col("rate")))
    first = F.max(F.when(F.col("v").isin("vague", "without skill"), F.col("rate")))
    rates = tried.groupBy(*of).agg(F.coalesce(second, F.lit(0.0)).alias("second"), F.coalesce(first, F.lit(0.0)).alias("first"))
    get = lambda k, t="string": F.get_json_object("d", f"$.{k}").cast(t)
    caught = F.exists(F.coalesce(F.from_json(F.get_json_object("d", "$.failures"), "array<string>"), F.array().cast("array<string>")), lambda f: f.startswith("[anonymisation]"))
    ok = (
        F.when(F.col("d").isNull(), False)
        .when(F.col("lab").isin("1", "2"), (F.col("second") > 0) & (F.col("second") >= F.col("first")) & ~F.col("crashed"))
        .when(F.col("lab") == "3", get("verify_exit_code", "int") == 0)
        .when(F.col("lab") == "3b", caught & (get("verify_exit_code", "int") != 0) & get("corpus_restored", "boolean"))
        .when(
            F.col("lab") == "4",
            ~F.coalesce(get("log_missing", "boolean"), F.lit(False)) & get("stop_condition_met", "boolean") & ~get("hit_step_limit", "boolean")
            & (get("model_recorded_in_state") == F.col("model")) & get("report_written", "boolean"),
        )
        .when(F.col("lab") == "5", (get("agent_exit_code", "int") == 0) & (get("final_score", "double") > get("baseline_score", "double")))
        .otherwise(~F.col("crashed"))
    )
    rows = runs.select(*of).distinct().join(last, of, "left").join(crashed, of, "left").join(rates, of, "left")
    return rows.select(*of, F.coalesce(ok, F.lit(False)).alias("as_expected"))


def parse_iterations(logs: DataFrame) -> DataFrame:
    """run, iteration, passed_n, total, score_percent out of logs(run, text) with lines such as "iteration 2: rollout 33% (1/3 passed)"."""
    pattern = r"(?i)iteration (\d+)\D+?(\d+)% \((\d+)/(\d+)"
    hits = F.arrays_zip(*[F.regexp_extract_all("text", F.lit(pattern), i).alias(n) for i, n in enumerate(("iteration", "percent", "passed", "total"), 1)])
    rows = logs.select("run", F.inline(hits).alias("iteration", "percent", "passed", "total"))
    return rows.select("run", *[F.col(c).cast("int") for c in ("iteration", "percent", "passed", "total")])


def log_lines(logs: DataFrame) -> DataFrame:
    """run, line_no, kind, line: what each line of a log is, by how it begins."""
    rows = logs.select("run", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    kind = (
        F.when(F.col("line").rlike(r"^#+\s"), "step").when(F.col("line").contains("OVERRIDE"), "override").when(F.col("line").rlike(r"(?i)\bfail"), "failure")
        .when(F.col("line").rlike(r"(?i)^\s*-?\s*ok\b"), "ok").when(F.trim("line") == "", "blank").otherwise("text")
    )
    return rows.withColumn("kind", kind)
