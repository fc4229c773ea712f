"""Answers to questions over the lake: near towns, routed data, a model if there is one, and a record of each answer."""

from __future__ import annotations

import json
import time
from collections.abc import Callable
from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cartulary.operators import quality, search
from cartulary.plans import jobs
from cartulary.sources import lake
from cartulary.sources.stores import TimedCache

# Entries and seconds of the caches of searches and completions; the price of 1,000 tokens.
SEARCHES, COMPLETIONS = (256, 900), (256, 300)
TOKEN_PRICE = 0.00059
EVENT_SCHEMA = (
    "ts_utc string, question string, retrieved_count int, recall_at_k double, latency_total_ms double, latency_vector_ms double, latency_llm_ms double,"
    " fallback_vector boolean, fallback_llm boolean, fallback_any boolean, tokens_total int, cost_estimated_usd double, cached_vector boolean, cached_llm boolean"
)


class Assistant:
    """Answers questions and appends an event on each answer to a table, which ``snapshot`` sums up.

    ``embed`` turns a text into a vector; ``complete`` turns (history, question, context) into (text, tokens). Either may be
    missing or fail: the answer then does without towns, or is the first lines of the data. Both are cached for a while.
    """

    def __init__(self, spark: SparkSession, index: DataFrame | None, events: str, embed: Callable | None = None, complete: Callable | None = None, price: float = TOKEN_PRICE, clock=time.monotonic):
        self.spark, self.index, self.events, self.embed, self.complete, self.price, self.clock = spark, index, events, embed, complete, price, clock
        self.searches, self.completions = TimedCache(*SEARCHES, clock), TimedCache(*COMPLETIONS, clock)

    def near(self, question: str, k: int = 5) -> tuple[str, bool, bool]:
        """(names of near towns, whether the search failed, whether it was remembered)."""
        key = (question.strip().lower(), k)
        if (known := self.searches.get(key)) is not None:
            return *known, True
        names, failed = "", self.index is None or self.embed is None
        if not failed:
            try:
                names = jobs.similar_towns(self.index, list(self.embed(question)), k)
            except Exception:  # a failing search must not fail the answer
                failed = True
        self.searches.set(key, (names, failed))
        return names, failed, False

    def ask(self, question: str, history: list[dict] = ()) -> str:
        """The answer to a question."""
        began = self.clock()
        names, lost, remembered = self.near(question)
        searched = self.clock()
        data = search.routed_rows(self.spark, question).to_string(index=False)
        context, asked, tokens = f"Near towns: {names}\n\n{data}", self.clock(), 0
        key = (question.strip().lower(), context.strip().lower())
        known = self.completions.get(key)
        said = known
        if known is None and self.complete is not None:
            try:
                said, tokens = self.complete(list(history)[-6:], question, context)
                self.completions.set(key, said)
            except Exception:  # a failing model must not fail the answer
                said = None
        failed = said is None
        done = self.clock()
        found = [n.strip() for n in names.split(",") if n.strip()]
        recall = 1.0 if any(n.lower() in question.lower() for n in found) else None
        times = [1000.0 * (b - a) for a, b in ((began, done), (began, searched), (asked, done))]
        row = (datetime.now(UTC).isoformat(), question, len(found), recall, *times, lost, failed, lost or failed, tokens, tokens / 1000 * self.price, remembered, known is not None)
        self.spark.createDataFrame([row], EVENT_SCHEMA).coalesce(1).write.mode("append").parquet(self.events)
        return search.without_model(data) if failed else said

    def snapshot(self) -> dict:
        """Metrics of all answers so far; zeros before the first."""
        return snapshot(self.spark, self.events)


def snapshot(spark: SparkSession, events: str) -> dict:
    """Metrics of a table of answers, as a report says them."""
    there = lake.find_report(spark, events.rstrip("/").rsplit("/", 1)[-1], [events.rstrip("/").rsplit("/", 1)[0]])
    rows = spark.read.schema(EVENT_SCHEMA).parquet(events) if there else spark.createDataFrame([], EVENT_SCHEMA)
    out = quality.event_snapshot(rows).select(F.to_json(F.struct("*"))).first()[0]
    return json.loads(out)
