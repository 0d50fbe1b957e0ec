"""A training corpus from raw documents: five stages, each written and read again before the next.

Of every stage: a null in any column, an empty or a very long text, an empty table and further columns of any name are
fine; further columns are passed on but by the last stage. A document without an id is judged by its text and never makes
or loses a copy or a passage. Rows that repeat an id are one document: they go together as near copies of another, and
each is judged by its own text otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.llm import decontaminate, language_id, mixing, ngram_join, substring_dedup
from millrace.llm.common import discard, saved


def _told(out: DataFrame, made: list[str], docs: DataFrame) -> tuple[DataFrame, dict[str, Column]]:
    """``out`` (doc_id, what an operator made, then the other columns of ``docs``) under names that can't clash, and those columns by their own."""
    rest = [c for c in docs.columns if c != "doc_id"]
    named = out.toDF("id", *made, *[f"kept{i}" for i in range(len(rest))])
    return named, {"doc_id": F.col("id")} | {c: F.col(f"kept{i}") for i, c in enumerate(rest)}


def _rest(docs: DataFrame) -> tuple[str, ...]:
    return tuple(c for c in docs.columns if c != "doc_id")


def _again(rows: DataFrame, back: dict[str, Column], docs: DataFrame) -> DataFrame:
    return rows.select(*[back[c].alias(c) for c in docs.columns])


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that have a language; one without a letter, or without a text, goes. A missing lang is filled in."""
    told, back = _told(language_id.predicted(docs, language_id.learned(docs), keep=_rest(docs)), ["language", "score"], docs)
    back["lang"] = F.coalesce(back["lang"], F.col("language"))
    return _again(told.where(F.col("language") != language_id.UNKNOWN), back, docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies (4-word shingles, Jaccard similarity of 0.85 or more) the document with the smallest id."""
    groups = ngram_join.linked(docs).where("component_id is not null and doc_id <> component_id").select("doc_id").distinct()
    return docs.join(groups.hint("merge"), "doc_id", "left_anti").select(*docs.columns)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without the passages that one with a smaller id has; one of which nothing is left goes."""
    cut, back = _told(substring_dedup.deduplicated(docs, keep=_rest(docs)), ["left", "words", "removed", "spans"], docs)
    changed = F.col("removed") > 0
    back["text"] = F.when(changed, F.col("left")).otherwise(back["text"])
    back["n_chars"] = F.when(changed, F.length("left").cast("long")).otherwise(back["n_chars"])
    return _again(cut.where(~changed | (F.col("removed") < F.col("words"))), back, docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    items = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    found, back = _told(decontaminate.contamination(docs, items, keep=_rest(docs)), ["leaks"], docs)
    return _again(found.where(F.size("leaks") == 0), back, docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rate at which each document goes into training; those with none, as toxic ones, go."""
    labels = mixing.quality_domains(spark.read.parquet(f"{sf_dir}/labels.parquet"))
    out = mixing.mixed(docs, labels, keep=("lang", "source", "n_chars"))
    named = [F.element_at("posteriors", i + 1).alias(f"p_{d}") for i, d in enumerate(mixing.TARGETS)]
    return out.where("rate > 0").select("doc_id", "lang", "source", "n_chars", "tokens", *named, "domain", "rate")


STAGES = [
    ("language_id", identify_languages),
    ("ngram_join", drop_near_copies),
    ("substring_dedup", cut_repeats),
    ("decontaminate", drop_leaks),
    ("mixing", mix),
]

#: Learned classifiers decide what stays, which SQL can't say; tests hold the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        docs = saved(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before is not None:
            discard(before)
        before = docs
    return docs
