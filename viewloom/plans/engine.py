"""A configuration over a change log: all its views, in batch."""

from __future__ import annotations

from collections.abc import Callable, Iterator, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from viewloom.model import KINDS, Config
from viewloom.operators.incremental import dependencies, union
from viewloom.operators.resolve import DEFAULT_HOPS, owner_chains
from viewloom.operators.rules import evaluated, hops_of, paths_of, payload_of
from viewloom.sinks.series import SeriesSink
from viewloom.sources.objects import current
from viewloom.sources.places import written


class Views(Mapping):
    """The rows of each rule by metric name. A view's plan is made when it is asked for; owners' chains are made once for all that walk.

    A state may hold the texts of all rules' paths ready in a column ``texts``; then it needs objects for arrays to expand only.
    """

    def __init__(self, config: Config, state: DataFrame, *, hops: int = DEFAULT_HOPS, keep: Callable[[DataFrame, str], DataFrame] = written):
        self.config, self.state, self.hops, self.keep = config, state, hops, keep
        self.rules = {config.metric(rule): rule for rule in config.rules}
        self.paths = paths_of(*config.rules)
        self._chains: DataFrame | None = None

    def chains(self) -> DataFrame:
        """Owners' chains with the texts that any rule reads."""
        if self._chains is None:
            self._chains = owner_chains(self.state, hops=self.hops, payload=payload_of(self.state, self.paths), keep=self.keep)
        return self._chains

    def of(self, metric: str, only: DataFrame | None = None) -> DataFrame:
        """The rows of a metric, or those of the anchors in ``only`` (anchor_key)."""
        rule = self.rules[metric]
        if not hops_of(rule, self.hops):
            return evaluated(rule, self.state, hops=self.hops, only=only, paths=self.paths if "texts" in self.state.columns else None)
        return evaluated(rule, self.state, hops=self.hops, only=only, chains=self.chains(), paths=self.paths)

    def __getitem__(self, metric: str) -> DataFrame:
        return self.of(metric)

    def __iter__(self) -> Iterator[str]:
        return iter(self.rules)

    def __len__(self) -> int:
        return len(self.rules)


def views(config: Config, state: DataFrame, *, hops: int = DEFAULT_HOPS) -> Views:
    """The rows of each rule, by metric name."""
    return Views(config, state, hops=hops)


def state_of_log(log: DataFrame, config: Config | None = None) -> DataFrame:
    """The current state of a change log as a table: the log is reduced once for all rules and walks."""
    return written(current(log, config), "state")


def views_of_log(config: Config, log: DataFrame, *, hops: int = DEFAULT_HOPS) -> Views:
    return views(config, state_of_log(log, config), hops=hops)


def view_of_log(config: Config, log: DataFrame, metric: str, *, hops: int = DEFAULT_HOPS) -> DataFrame:
    """The rows of one metric alone. A rule that walks to no owner reads objects of its anchor's kind only, once, so no state is written."""
    rule = next(r for r in config.rules if config.metric(r) == metric)
    if hops_of(rule, hops):
        return views_of_log(config, log, hops=hops)[metric]
    return views(config, current(log.where(F.col("kind") == rule.anchor), config), hops=hops)[metric]


def publish(config: Config, state: DataFrame, sink: SeriesSink, *, hops: int = DEFAULT_HOPS) -> None:
    """Registers each metric and writes its series."""
    found = views(config, state, hops=hops)
    for rule in config.rules:
        sink.register(config.metric(rule), rule.label_names(), rule.help_text())
        sink.write(config.metric(rule), found[config.metric(rule)])


def index(config: Config, state: DataFrame, *, hops: int = DEFAULT_HOPS, only: DataFrame | None = None, found: Views | None = None) -> DataFrame:
    """What the anchors of all rules, or those of ``only`` (anchor_kind, anchor_key), depend on; ``found`` lends its owners' chains."""
    deepest = {k: max(hops_of(r, hops) for r in config.rules if r.anchor == k) for k in KINDS if any(r.anchor == k for r in config.rules)}
    payload = F.lit(True) if found is None else payload_of(state, found.paths)
    chains = None
    if any(deepest.values()):
        chains = owner_chains(state, hops=hops, payload=payload) if found is None else found.chains()
    parts = []
    for kind, most in deepest.items():
        own = None if only is None else only.where(F.col("anchor_kind") == kind).select("anchor_key")
        parts.append(dependencies(state, kind, hops=most, only=own, chains=chains, payload=payload))
    return union(parts)


def readers(config: Config) -> dict[str, list[str]]:
    """For each kind, the metrics that its objects can change without being their anchors."""
    return {k: [config.metric(r) for r in config.rules if k in r.read_kinds()] for k in KINDS}
