"""Run ledgers: what a run's calls were and cost, counted while a sink writes them and not by a second pass."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


class RunLedger:
    """Counts of calls by endpoint, of those that a cache answered, and the first and last reading of the service's
    meter. Calls to endpoints that aren't named count as other.

    observed() gives back the same rows, to be written by one action; after that, entries() and spent() are known.
    """

    def __init__(self, endpoints: list[str], limit_per_hour: float | None = None):
        self.endpoints, self.limit = endpoints, limit_per_hour
        self.seen = Observation()

    def observed(self, calls: DataFrame, endpoint: Column, cached: Column, reading: Column, order: Column) -> DataFrame:
        """calls, unchanged. order: a column by which the readings follow each other; null readings are none."""
        endpoint, cached = F.coalesce(endpoint, F.lit("")), F.coalesce(cached, F.lit(False))
        named = [endpoint == e for e in self.endpoints] + [~endpoint.isin(*self.endpoints)]
        counts = [F.count_if(is_in).alias(f"calls{k}") for k, is_in in enumerate(named)]
        hits = [F.count_if(is_in & cached).alias(f"hits{k}") for k, is_in in enumerate(named)]
        known = F.when(reading.isNotNull(), order)  # rows without an order are passed over
        return calls.observe(self.seen, *counts, *hits, F.min_by(reading, known).alias("first"), F.max_by(reading, known).alias("last"))

    def entries(self) -> list[tuple[str, int, int]]:
        """(endpoint, requests, cache hits) of each endpoint that was called, by name; waits for the action."""
        seen = self.seen.get
        rows = [(e, seen[f"calls{k}"] - seen[f"hits{k}"], seen[f"hits{k}"]) for k, e in enumerate([*self.endpoints, "other"])]
        return sorted(r for r in rows if r[1] + r[2])

    def spent(self) -> float | None:
        """Last reading less the first; none if there is no reading."""
        first, last = self.seen.get["first"], self.seen.get["last"]
        return None if first is None or last is None else round(last - first, 4)

    def share(self) -> float | None:
        """Requests, cache hits left out, over what an hour allows."""
        requests = sum(r for _, r, _ in self.entries())
        return round(requests / self.limit, 4) if self.limit else None
