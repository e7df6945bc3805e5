"""Documents to validated summary records: one operator, two profiles.

Long texts are condensed chunk by chunk first. Then a record is asked for until its summary passes, with the reasons fed back; what never passes is
repaired or marked for review. All documents move together, a model stage at a time.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import payload, text
from ..operators import chunks, evaluation, validation
from . import loops
from .models import Backend


@dataclass(frozen=True)
class Profile:
    """Fixed values of a variant: what counts as too short and as long, how chunks are cut and sampled, and how attempts are judged."""

    name: str
    least_chars: int
    long_over: int
    chunk_chars: int
    most_chunks: int
    sample: str
    condensing: int
    prefix_chars: int
    attempts: int
    most_words: int = 80
    overlap: int = 300


A = Profile("a", 300, 9000, 6000, 20, "head", 3, 1500, 4)
B = Profile("b", 200, 12000, 12000, 10, "ends", 1, 2500, 3)
NOTE = "Note the aims, measures and target groups of this part, or reply NO RELEVANT CONTENT.\n<document>{{TEXT}}</document>"
ASK = "Reply with one JSON object for this document.\n<document>{{TEXT}}</document>{{AGAIN}}"


def material(docs: DataFrame, profile: Profile, backend: Backend) -> DataFrame:
    """doc, material, status of docs(doc, text): cleaned text; of long ones its beginning and the notes on a sample of chunks, again while that
    is still long (profile a up to three times, as long as it shrinks). Texts that are too short are skipped."""
    clean = text.clean_profile_a if profile.name == "a" else text.clean_profile_b
    rows = docs.select("doc", clean(F.coalesce("text", F.lit(""))).alias("material"))
    rows = rows.withColumn("status", F.when(F.length("material") < profile.least_chars, "skipped").otherwise("ready"))
    cut = chunks.packed_paragraphs if profile.name == "a" else chunks.boundary_windows
    ledger = loops.Ledger(docs.sparkSession)
    rows = ledger.write(rows, "clean")
    for turn in range(profile.condensing):
        long_ = rows.filter((F.col("status") == "ready") & (F.length("material") > profile.long_over))
        if long_.isEmpty():
            break
        parts = cut(long_, "doc", "material", profile.chunk_chars, profile.overlap)
        parts = chunks.even_sample(parts, "doc", "chunk_no", profile.most_chunks, profile.sample)
        notes = loops.map_reduce_summary(parts, "doc", "chunk_no", "chunk", NOTE, backend).withColumnRenamed("material", "_notes")
        shorter = F.concat_ws("\n\n", F.substring("material", 1, profile.prefix_chars), F.col("_notes"))
        new = F.when(F.col("_notes").isNotNull() & (F.length(shorter) < F.length("material")), shorter)
        new = F.coalesce(new, F.when(F.length("material") > profile.long_over, F.substring("material", 1, profile.long_over)), F.col("material"))
        rows = ledger.write(rows.join(notes, "doc", "left").select("doc", new.alias("material"), "status"), f"condensed-{turn}")
    return rows


def judged(reply: Column, profile: Profile) -> Column:
    """Struct(ok, reason): whether a reply holds a record whose summary has no errors."""
    summary = payload.raw_summary(payload.json_object_text(reply, profile.name))
    found = validation.summary_errors_a(summary, profile.most_words) if profile.name == "a" else validation.summary_problems_b(text.squeeze(summary), profile.most_words)
    bad = F.when(payload.json_object_text(reply, profile.name).isNull(), F.array(F.lit("no valid JSON object"))).when(summary == "", F.array(F.lit("empty summary"))).otherwise(found)
    return F.struct((F.size(bad) == 0).alias("ok"), F.array_join(bad, "; ").alias("reason"))


def summarise(docs: DataFrame, profile: Profile, backend: Backend) -> DataFrame:
    """doc, status, attempts, record, warnings. Profile a: the first attempt without errors is ok; else the last that parsed, trimmed to the
    limit (auto_trimmed if that leaves no error, needs_review if it does). Profile b: the last attempt that was no worse than the ones before;
    OK without problems. A document without any record failed; one that is too short was skipped."""
    rows = material(docs, profile, backend)
    ready = rows.filter("status = 'ready'")
    again = F.coalesce(F.concat(F.lit("\nNot accepted: "), F.col("complaint")), F.lit(""))
    prompt = text.fill_template(ASK, {"AGAIN": again, "TEXT": F.col("material")}, last="TEXT")
    tries = loops.ask_until(ready, "doc", prompt, lambda reply: judged(reply, profile), backend, profile.attempts)
    tries = tries.withColumn("json", payload.json_object_text(F.col("reply"), profile.name)).withColumn("record", payload.summary_record(F.col("json"), profile.name))
    tries = tries.withColumn("problems", F.when(F.col("ok"), 0).otherwise(F.size(F.split("reason", "; "))))
    if profile.name == "a":
        best = evaluation.first_acceptable(tries, "doc", "attempt", F.col("problems"), F.col("record").isNotNull(), "record")
        best = best.withColumn("cut", text.trim_to_limit(F.col("record.summary"), profile.most_words))
        fits = F.size(validation.summary_errors_a(F.col("cut.text"), profile.most_words)) == 0
        status = F.when(F.col("status") == "none", "failed").when(F.col("status") == "ok", "ok").when((F.col("cut.mode") != "none") & fits, "auto_trimmed").otherwise("needs_review")
        best = best.select("doc", status.alias("status"), F.col("attempt").alias("attempts"), F.col("record").withField("summary", F.col("cut.text")).alias("record"))
    else:
        kept = evaluation.non_worsening(tries.filter("record is not null"), "doc", "attempt", "problems", "record")
        count = tries.groupBy("doc").agg(F.max("attempt").alias("attempts"))
        status = F.when(F.col("record").isNull(), "failed").when(F.col("problems") == 0, "OK").otherwise("NEEDS HUMAN REVIEW")
        best = count.join(kept, "doc", "left").select("doc", status.alias("status"), "attempts", "record")
    warned = best.withColumn("warnings", validation.summary_warnings_a(F.coalesce("record.summary", F.lit("")), profile.most_words))
    skipped = rows.filter("status = 'skipped'").select("doc", "status")
    return warned.unionByName(skipped, allowMissingColumns=True)
