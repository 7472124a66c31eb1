"""Pluggable scoring of records: an interface, a deterministic local scorer, incremental runs, sentinels."""

from __future__ import annotations

import json
from collections.abc import Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F

from siftline.operators import ordering, rules, state

VERDICT = "job_id string, stage string, model string, prompt_version string, relevant boolean, score int, summary string"
FALLBACK_SCORE = 50


class Scorer(Protocol):
    model: str
    prompt_version: str

    def score(self, text: str) -> tuple[bool, int, str]:
        """(relevant, score 0 to 100, summary) of one rendered record; may raise."""


class LexicalScorer:
    """Counts wanted terms: a stand-in for remote models in tests and offline runs."""

    def __init__(self, terms: list[str], model: str = "lexical", prompt_version: str = "1"):
        self.terms, self.model, self.prompt_version = [t.lower() for t in terms], model, prompt_version

    def score(self, text: str) -> tuple[bool, int, str]:
        hits = sum(text.lower().count(t) for t in self.terms)
        return hits > 0, min(100, 10 * hits), f"{hits} hits"


def run_stage(records: DataFrame, scorer: Scorer, stage: str, stored: DataFrame | None = None, key: str = "job_id", text: str = "prompt") -> DataFrame:
    """Verdicts of the records that have none of this model and prompt version yet; a record that fails gets the fallback."""
    todo = records
    if stored is not None:
        mine = stored.filter((F.col("stage") == stage) & (F.col("model") == scorer.model) & (F.col("prompt_version") == scorer.prompt_version))
        todo = state.unseen(records, mine.withColumnRenamed("job_id", key), [key])

    def judge(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for k, t in zip(f[key], f[text]):
                try:
                    good, score, why = scorer.score(t or "")
                except Exception as e:  # noqa: BLE001  one record's failure is that record's verdict
                    good, score, why = True, FALLBACK_SCORE, f"no verdict: {e}"
                rows.append((str(k), stage, scorer.model, scorer.prompt_version, good, int(score), why))
            yield pd.DataFrame(rows, columns=[c.split(" ")[0] for c in VERDICT.split(", ")])

    return todo.select(key, text).mapInPandas(judge, VERDICT)


def prompts(df: DataFrame, fields: list[str], key: str, most: int = 6_000) -> DataFrame:
    """One text a record: 'name: value' lines of the fields that are there, cut to so many characters."""
    lines = [F.when(F.col(c).isNotNull(), F.concat(F.lit(f"{c}: "), F.col(c).cast("string"))) for c in fields]
    return df.select(F.col(key), F.substring(F.concat_ws("\n", *lines), 1, most).alias("prompt"))


def parse_answers(lines: DataFrame, schema: str, text: str = "value") -> tuple[DataFrame, DataFrame]:
    """(valid answers, lines that are broken or out of range) of JSON lines."""
    full = f"{schema}, _bad string"
    rows = lines.select(text, F.from_json(F.col(text), full, {"columnNameOfCorruptRecord": "_bad"}).alias("a"))
    ok = F.col("a").isNotNull() & F.col("a._bad").isNull() & F.coalesce(F.col("a.score").between(0, 100), F.lit(False))
    return rows.filter(ok).select("a.*").drop("_bad"), rows.filter(~ok).select(text)


def first_answers(answers: DataFrame, asked: DataFrame, key: str, place: str) -> tuple[DataFrame, DataFrame]:
    """(the first answer of each asked key, asked keys without an answer): unknown and repeated ones are dropped."""
    got = answers.join(asked.select(key), key, "left_semi").groupBy(key).agg(F.min_by(F.struct(*answers.columns), place).alias("r")).select("r.*")
    return got, asked.select(key).join(got.select(key), key, "left_anti")


def sentinels(results: DataFrame, verdicts: DataFrame, measured: DataFrame, n: int, seed: int, min_score: int) -> DataFrame:
    """Seeded samples of what each gate turned away: rule drops (but stale ones) and screen rejects, not measured before."""
    drops = results.filter("status = 'drop'").filter(~rules.stale_only(F.col("reasons"))).select("id").join(measured.select("id"), "id", "left_anti")
    alive = results.filter("status <> 'drop'").select("id")
    rejects = verdicts.filter(~(F.col("relevant") & (F.col("score") >= min_score))).select(F.col("job_id").alias("id")).join(alive, "id", "left_semi").join(measured.select("id"), "id", "left_anti")
    take = lambda d, g: ordering.uniform_sample(d, "id", n, seed).withColumn("gate", F.lit(g))
    return take(drops, "rules").unionByName(take(rejects, "screen"))


def render_json(df: DataFrame, exclude: tuple[str, ...] = ("raw",)) -> DataFrame:
    """One JSON line a row, without the excluded columns."""
    return df.select(F.to_json(F.struct(*[c for c in df.columns if c not in exclude])).alias("value"))


def schema_of_weights(weights: dict[str, int]) -> str:
    return "job_id string, score int, criteria struct<" + ", ".join(f"`{k}`: int" for k in weights) + ">"


def describe(weights: dict[str, int]) -> str:
    return json.dumps({k: {"type": "integer", "minimum": 0, "maximum": 100} for k in weights}, sort_keys=True)
