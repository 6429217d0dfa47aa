"""Run and score golden questions in several modes, resuming where a run stopped."""

from __future__ import annotations

import threading
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame

from repoloom.operators.rollup import pending

#: What each retrieval mode may use. Fixed values.
MODE_TOOLS = {"vector": ("search",), "graph": ("who_calls", "what_calls", "impact_of", "dependencies_of"), "agentic": ("list_files", "grep", "read_file", "find_symbol", "structure", "search", "who_calls", "what_calls", "impact_of", "dependencies_of")}
RECORD = "mode string, id string, category string, question string, expected_answer string, answer string, sources array<string>, latency_ms double, scores map<string,double>, error string, scored_at timestamp"
#: Seconds that an answer and its scores may take.
ANSWER_SECONDS, SCORE_SECONDS = 120.0, 120.0
Runner = Callable[[str, str], tuple[str, list[str]]]
Scorer = Callable[[str, str, str], dict[str, float]]


def within(seconds: float, what: str, call: Callable, *arguments: object) -> object:
    """The result of a call in a thread of its own; ``TimeoutError`` if it takes longer, whatever the call does then."""
    box: list = []

    def target() -> None:
        try:
            box.append((True, call(*arguments)))
        except BaseException as problem:  # noqa: BLE001 - handed over to the caller
            box.append((False, problem))

    thread = threading.Thread(target=target, daemon=True)
    thread.start()
    thread.join(seconds)
    if not box:
        raise TimeoutError(f"{what} took more than {seconds:g} s")
    good, value = box[0]
    if not good:
        raise value
    return value


def run(items: DataFrame, finished: DataFrame, mode: str, runner: Runner, scorer: Scorer | None = None, answer_seconds: float = ANSWER_SECONDS, score_seconds: float = SCORE_SECONDS) -> DataFrame:
    """Records of the items that have none yet in ``finished``: one question's failure is its record's ``error``.

    ``runner(question, mode)`` gives an answer and its sources; ``scorer(question, answer, expected)`` gives metrics. A
    mode that is not known is a ``ValueError``. An answer or score that takes too long is an error of its record; a failing
    score leaves the answer in place.
    """
    if mode not in MODE_TOOLS:
        raise ValueError(f"unknown mode: {mode}")
    todo = pending(items, finished.where(f"mode = '{mode}'")).select("id", "category", "question", "expected_answer")

    def answer(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for item in batch.itertuples(index=False):
                text, sources, scores, error = None, [], {}, None
                began = time.perf_counter()
                try:
                    text, sources = within(answer_seconds, "the answer", runner, item.question, mode)
                    scores = within(score_seconds, "scoring", scorer, item.question, text, item.expected_answer) if scorer else {}
                except Exception as problem:  # noqa: BLE001 - a failing question must not end the others
                    error = str(problem)
                rows.append((mode, item.id, item.category, item.question, item.expected_answer, text, sources, (time.perf_counter() - began) * 1000, scores, error, pd.Timestamp.now(tz="UTC").tz_localize(None)))
            yield pd.DataFrame(rows, columns=["mode", "id", "category", "question", "expected_answer", "answer", "sources", "latency_ms", "scores", "error", "scored_at"])

    return todo.mapInPandas(answer, RECORD)


def comparison(records: DataFrame, metrics: list[str]) -> DataFrame:
    """Per mode the mean of each metric over the records that have it; NaN if none has."""
    from pyspark.sql import functions as F

    return records.groupBy("mode").agg(F.count("*").alias("n"), F.avg("latency_ms").alias("latency_ms"), *[F.coalesce(F.avg(F.try_element_at("scores", F.lit(m))), F.lit(float("nan"))).alias(m) for m in metrics])
