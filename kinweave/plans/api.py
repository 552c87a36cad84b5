"""The flagship pipeline in one call: packet and history to assignments."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import DataFrame

from kinweave.operators import blocking, candidates, evidence, graph, values
from kinweave.operators.rules import STRONG, Rule, recommended
from kinweave.operators.scoring import LogisticScorer, Scorer


# The shipped runtime policy.
@dataclass(frozen=True)
class Policy:
    threshold: float = 0.95
    top_k: int | None = 1
    per_profile: int | None = 300
    overall: int | None = 1_500_000


@dataclass(frozen=True)
class Result:
    scored: DataFrame
    edges: DataFrame
    components: DataFrame
    assignment: DataFrame


def candidate_events(packet: DataFrame, history: DataFrame, rules: list[Rule], policy: Policy) -> tuple[DataFrame, DataFrame]:
    """Candidate events of packet pairs and of packet against history, and the values of all profiles."""
    mine, known = (graph.written(values.profile_values(x)) for x in (packet, history))  # each is read several times
    rows = graph.written(blocking.block_rows(mine, rules))
    inside = candidates.internal_pairs(blocking.limited(rows))
    across = candidates.history_pairs(rows, blocking.blocking_index(known, rules))
    across = candidates.limit_history(across, STRONG, policy.per_profile, policy.overall)
    return graph.written(inside.unionByName(across)), mine.unionByName(known)


def resolve(packet: DataFrame, history: DataFrame, rules: list[Rule] | None = None, scorer: Scorer | None = None, policy: Policy | None = None) -> Result:
    """Scores candidate pairs, keeps mutual best ones, and decides for every packet profile."""
    rules, scorer, policy = rules or recommended(), scorer or LogisticScorer(), policy or Policy()
    events, all_values = candidate_events(packet, history, rules, policy)
    scored = graph.written(scorer.score(evidence.features(events, all_values)))
    edges = graph.mutual_top_k(scored, policy.threshold, policy.top_k)
    comps = graph.connected_components(packet, edges)
    known = history.select("profile_id", "entity_id").distinct()
    return Result(scored, edges, comps, graph.assign(packet, known, comps, scored))
