"""Bounded loops over small state: ask, check and ask again; staged work with a planner; improvement behind a gate.

A loop runs on the driver, its steps are plans over all open items at once. What a step produced is written before the next one reads it, so a
model is asked once per prompt and attempt even if tasks are run again.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import fill_template, slug
from ..storage import new_folder
from .models import Backend


class Ledger:
    """Tables of a loop's rounds: Parquet under the checkpoint folder, so that neither retries nor lost executors repeat a round."""

    def __init__(self, spark: SparkSession):
        self.spark, self.root = spark, new_folder(spark, "loop")

    def write(self, df: DataFrame, name: str) -> DataFrame:
        path = f"{self.root}/{name}"
        df.write.parquet(path)
        return self.spark.read.schema(df.schema).parquet(path)


def ask_until(tasks: DataFrame, key: str, prompt: Column, check: Callable[[Column], Column], backend: Backend, most: int = 3, final: Column | None = None) -> DataFrame:
    """key, attempt, reply, ok, reason of every task's attempts. prompt is an expression over tasks and complaint, the last reason (null at
    first); check gives struct(ok, reason) of a reply. A task leaves once a reply passes, or when final (over reply and reason) says that it
    is no use to ask again; after most attempts the rest stay unaccepted."""
    ledger, open_, rounds = Ledger(tasks.sparkSession), tasks.withColumn("complaint", F.lit(None).cast("string")), None
    for attempt in range(1, most + 1):
        prompts = open_.select(F.col(key).cast("string").alias("prompt_id"), F.lit(attempt).alias("attempt"), prompt.alias("prompt"))
        replies = ledger.write(backend(prompts), f"replies-{attempt}")
        judged = replies.withColumn("_c", check(F.col("reply")))
        judged = judged.select(F.col("prompt_id").alias("_id"), "attempt", "reply", F.col("_c.ok").alias("ok"), F.col("_c.reason").alias("reason"))
        rounds = judged if rounds is None else rounds.unionByName(judged)
        failed = judged.filter(~F.col("ok") & (~final if final is not None else F.lit(True))).select("_id", F.col("reason").alias("complaint"))
        open_ = ledger.write(tasks.join(failed, F.col(key).cast("string") == F.col("_id")).drop("_id"), f"open-{attempt}")
        if open_.isEmpty():
            break
    return tasks.select(F.col(key), F.col(key).cast("string").alias("_id")).join(rounds, "_id").drop("_id")


def accepted(rounds: DataFrame, key: str) -> DataFrame:
    """key, reply, attempts of the tasks that passed."""
    return rounds.filter("ok").groupBy(key).agg(F.min_by("reply", "attempt").alias("reply"), F.min("attempt").alias("attempts"))


def skip_done(tasks: DataFrame, done: DataFrame, key: str) -> DataFrame:
    """Tasks whose key has no outcome yet."""
    return tasks.join(done.select(key), key, "left_anti")


def answer_status(rounds: DataFrame, gates: DataFrame, qid: str = "qid") -> DataFrame:
    """qid, status, answer, attempts: refused before any attempt where the gate says so; else by how the attempts went."""
    best = rounds.groupBy(qid).agg(F.max(F.struct("attempt", "ok", "reply", "reason")).alias("last"))
    rows = gates.select(qid, "gate").join(best, qid, "left")
    status = (
        F.when(F.col("gate") != "passed", "refused_no_evidence").when(F.col("last").isNull() | F.col("last.reply").isNull(), "error")
        .when(F.col("last.ok") & F.col("last.reason").startswith("evidence declared"), "refused_by_model").when(F.col("last.ok"), "answered").otherwise("refused_failed_verification")
    )
    return rows.select(qid, status.alias("status"), F.when(status == "answered", F.col("last.reply")).alias("answer"), F.when(F.col("gate") == "passed", F.coalesce("last.attempt", F.lit(0))).otherwise(0).alias("attempts"))


def map_reduce_summary(chunks: DataFrame, key: str, number: str, text: str, note_prompt: str, backend: Backend, keep_prefix: Column | None = None) -> DataFrame:
    """key, material: a note on each chunk, without those that say nothing of use, in order, behind the text's own beginning if given."""
    ledger = Ledger(chunks.sparkSession)
    ids = F.concat_ws(":", F.col(key).cast("string"), F.col(number).cast("string"))
    prompts = chunks.select(ids.alias("prompt_id"), F.lit(1).alias("attempt"), fill_template(note_prompt, {"TEXT": F.col(text)}, last="TEXT").alias("prompt"))
    notes = ledger.write(backend(prompts), "notes")
    useful = ~F.contains(F.lower(F.substring("reply", 1, 60)), F.lit("no relevant content"))
    rows = chunks.withColumn("prompt_id", ids).join(notes.filter(useful), "prompt_id").groupBy(key)
    grouped = rows.agg(F.array_sort(F.collect_list(F.struct(F.col(number).alias("n"), F.col("reply").alias("r")))).alias("notes"))
    material = F.array_join(F.transform("notes", lambda s: s["r"]), "\n\n")
    if keep_prefix is None:
        return grouped.select(key, material.alias("material"))
    heads = chunks.filter(F.col(number) == 0).select(key, keep_prefix.alias("_head"))
    return grouped.join(heads, key, "left").select(key, F.concat_ws("\n\n", "_head", material).alias("material"))


STAGES = ("convert", "summarise", "extract_tables")
FLAGS = {"convert": "converted", "summarise": "summarised", "extract_tables": "tables"}


def precondition(state: DataFrame, proposals: DataFrame) -> DataFrame:
    """step, tool, target, ok, reason of proposals(step, tool, target) against state(source, converted, summarised, tables): unknown tools and
    targets, work that is done, and work that isn't ready are told apart."""
    ready = state.agg(F.count("*").alias("n"), F.count_if(~(F.col("summarised") & F.col("tables"))).alias("unready"))
    rows = proposals.join(state.withColumnRenamed("source", "target"), "target", "left").crossJoin(F.broadcast(ready))  # one row
    done = F.when(F.col("tool") == "convert", F.col("converted")).when(F.col("tool") == "summarise", F.col("summarised")).when(F.col("tool") == "extract_tables", F.col("tables"))
    reason = (
        F.when((F.col("tool") == "list") & (F.col("n") > 0), "already listed").when(F.col("tool") == "list", "")
        .when((F.col("tool") == "report") & (F.col("n") == 0), "nothing listed").when((F.col("tool") == "report") & (F.col("unready") > 0), "documents not ready")
        .when(F.col("tool") == "report", "").when(F.col("converted").isNull(), "unknown target").when(~F.col("tool").isin(*STAGES), "unknown tool")
        .when((F.col("tool") != "convert") & ~F.col("converted"), "not converted").when(done, "already done").otherwise("")
    )
    return rows.select("step", "tool", "target", (reason == "").alias("ok"), reason.alias("reason"))


def next_actions(state: DataFrame) -> DataFrame:
    """stage, source: every document that the first unfinished stage still lacks; report once all are done. One row says list if there are
    none at all. Taking the smallest source gives the step-by-step planner."""
    open_ = [state.filter(~F.col(FLAGS[s])).select(F.lit(i).alias("no"), F.lit(s).alias("stage"), "source") for i, s in enumerate(STAGES)]
    rows = open_[0].unionByName(open_[1]).unionByName(open_[2])
    first = rows.agg(F.min("no").alias("no"))
    todo = rows.join(first, "no").select("stage", "source")
    if todo.isEmpty():
        return state.sparkSession.createDataFrame([("list" if state.isEmpty() else "report", "")], "stage string, source string")
    return todo


@dataclass
class Worker:
    """A tool per stage: each takes the open sources and returns source and output; an empty output isn't done."""

    tools: dict[str, Callable[[DataFrame], DataFrame]]
    log: list[dict] = field(default_factory=list)

    def run(self, state: DataFrame, most: int = 40) -> DataFrame:
        """state after at most most steps: each takes the first unfinished stage, for all its documents, and marks those with output."""
        ledger = Ledger(state.sparkSession)
        for step in range(most):
            todo = next_actions(state)
            stage = todo.first()["stage"]
            if stage in ("report", "list"):
                break
            made = ledger.write(self.tools[stage](todo.select("source")).filter(F.length("output") > 0), f"{step}-{stage}")
            n = made.count()
            self.log.append({"step": step, "stage": stage, "done": n})
            if not n:
                break
            done = made.select("source").distinct().withColumn("_done", F.lit(True))
            flag = FLAGS[stage]
            state = state.join(done, "source", "left").withColumn(flag, F.col(flag) | F.coalesce("_done", F.lit(False))).drop("_done")
            state = ledger.write(state, f"{step}-state")
        return state


def report_complete(state: DataFrame, report: str) -> DataFrame:
    """One row, complete: whether each source (without its extension, underscores as spaces) heads a section of the report."""
    from ..functions.text import title_of_name

    head = F.concat(F.lit(r"(?m)^###\s+\Q"), title_of_name(F.col("source")), F.lit(r"\E"))
    return state.agg(F.coalesce(F.bool_and(F.regexp_like(F.lit(report), head)), F.lit(False)).alias("complete"))


def upsert_patterns(known: DataFrame, failures: DataFrame, iteration: int) -> DataFrame:
    """Pattern pages after an iteration: known(name, reason, first_iteration, evidence) and failures(pattern, n). A pattern met again gains a
    line of evidence and nothing else changes; a new one gets a page."""
    seen = failures.select(slug(F.col("pattern")).alias("name"), F.col("pattern").alias("_reason"), F.struct(F.lit(iteration).alias("iteration"), F.col("n").cast("long").alias("n")).alias("_new"))
    rows = known.join(seen, "name", "full_outer")
    none = F.array().cast("array<struct<iteration:int,n:bigint>>")
    evidence = F.concat(F.coalesce("evidence", none), F.when(F.col("_new").isNotNull(), F.array("_new")).otherwise(none))
    return rows.select("name", F.coalesce("reason", "_reason").alias("reason"), F.coalesce("first_iteration", F.lit(iteration)).alias("first_iteration"), evidence.alias("evidence"))


def evolve(evaluate: Callable[[str], float], propose: Callable[[str, int], str | None], skill: str = "", iterations: int = 5) -> list[dict]:
    """The improvement loop over one text: a proposal is kept if its score beats the best so far; an empty one is passed over; it stops at 1."""
    best, log = evaluate(skill), []
    log.append({"iteration": 0, "score": best, "kept": True, "best": best})
    for i in range(1, iterations + 1):
        new = propose(skill, i)
        if not new:
            continue
        score = evaluate(new)
        kept = score > best
        if kept:
            skill, best = new, score
        log.append({"iteration": i, "score": score, "kept": kept, "best": best})
        if best >= 1.0:
            break
    return log


def paired_prompts(tasks: DataFrame, key: str, variants: dict[str, Column]) -> DataFrame:
    """Each task once with every variant of a prompt: key, variant, prompt_id, attempt, prompt."""
    pairs = F.explode(F.array(*[F.struct(F.lit(v).alias("variant"), p.alias("prompt")) for v, p in variants.items()]))
    rows = tasks.select(F.col(key), pairs.alias("p"))
    return rows.select(key, "p.variant", F.concat_ws("|", F.col(key).cast("string"), "p.variant").alias("prompt_id"), F.lit(1).alias("attempt"), "p.prompt")
