"""Views as data: rules, labels, watched kinds, and the checks that a configuration must pass before anything runs."""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

from viewloom.functions.paths import parse_path

#: The kinds of objects, in their fixed order (fixed values).
KINDS = ("Pod", "Deployment", "StatefulSet", "DaemonSet", "ReplicaSet", "Node")
#: Kinds that can be the top of an ownership chain (fixed values).
TOP_KINDS = ("Deployment", "StatefulSet", "DaemonSet")
#: Sources that are not kinds (fixed values).
BUILTINS = ("anchor", "ownerController", "topController", "item")
#: Kinds that an owner or top controller can have (fixed values).
OWNER_KINDS = ("ReplicaSet", "Deployment", "StatefulSet", "DaemonSet")
#: apiVersion of each kind (fixed values).
API_VERSIONS = {"Pod": "v1", "Node": "v1", "Deployment": "apps/v1", "StatefulSet": "apps/v1", "DaemonSet": "apps/v1", "ReplicaSet": "apps/v1"}
NAMESPACED, CLUSTER = "Namespaced", "Cluster"

_METRIC = re.compile(r"[a-zA-Z_:][a-zA-Z0-9_:]*")
_LABEL = re.compile(r"[a-zA-Z_][a-zA-Z0-9_]*")


class ConfigError(ValueError):
    """A configuration that cannot run."""


def require(ok: object, message: str) -> None:
    if not ok:
        raise ConfigError(message)


def _twice(names: Iterable[str]) -> str | None:
    return next((n for n, k in Counter(names).items() if k > 1), None)


@dataclass(frozen=True)
class Watched:
    """Which objects of a kind are read."""

    kind: str
    scope: str = NAMESPACED
    namespaces: tuple[str, ...] = ()
    label_selector: str = ""
    field_selector: str = ""

    def check(self) -> None:
        require(self.kind in KINDS, f"watch: unknown kind {self.kind!r}")
        require(self.scope in (NAMESPACED, CLUSTER), f"watch {self.kind}: scope must be {NAMESPACED} or {CLUSTER}")
        require(self.kind != "Node" or self.scope == CLUSTER, "watch Node: scope must be Cluster")
        require(self.scope != CLUSTER or not self.namespaces, f"watch {self.kind}: scope Cluster takes no namespaces")


@dataclass(frozen=True)
class Extract:
    """How a label gets its text: a path on a source, then others in order, then a default."""

    path: str
    source: str = "anchor"
    fallbacks: tuple[Extract, ...] = ()
    on_missing: str = ""

    def every(self) -> tuple[Extract, ...]:
        return (self, *self.fallbacks)

    def check(self, where: str, sources: set[str], has_items: bool) -> None:
        for k, e in enumerate(self.every()):
            here = f"{where} fallback {k - 1}" if k else where
            require(not k or not e.fallbacks, f"{here}: fallbacks cannot be nested")
            require(e.source in sources, f"{here}: unknown source {e.source!r}")
            require(e.source != "item" or has_items, f"{here}: source item needs forEach")
            require(e.path.strip(), f"{here}: path is missing")
            try:
                parse_path(e.path)
            except ValueError as error:
                raise ConfigError(f"{here}: {error}") from error


@dataclass(frozen=True)
class Rule:
    """One view: its anchor kind, an array to expand, aliases of sources, and labels."""

    name: str
    anchor: str
    labels: dict[str, Extract]
    help: str = ""
    for_each: str = ""
    relations: tuple[tuple[str, str], ...] = ()

    def label_names(self) -> list[str]:
        return sorted(self.labels)

    def resolved(self, source: str) -> str:
        """What a relation's name stands for; other names stand for themselves."""
        return next((via for name, via in self.relations if name == source), source)

    def sources(self) -> set[str]:
        return {self.resolved(e.source) for x in self.labels.values() for e in x.every()}

    def help_text(self) -> str:
        return self.help.strip() or f"Metadata of {self.anchor} objects by rule {self.name}."

    def required_kinds(self) -> set[str]:
        """Kinds that must be watched: the anchor and those that labels name."""
        return {self.anchor} | (self.sources() & set(KINDS))

    def read_kinds(self) -> set[str]:
        """Kinds, other than the anchor's, whose changes can change the view."""
        own = self.sources()
        chain = set(OWNER_KINDS) if own & {"ownerController", "topController"} else set()
        return (chain | (own & set(KINDS))) - {self.anchor}

    def check(self) -> None:
        require(self.name.strip(), "rule: name is missing")
        where = f"rule {self.name!r}"
        require(self.anchor in KINDS, f"{where}: unknown anchor {self.anchor!r}")
        require(self.labels, f"{where}: no labels")
        known = set(BUILTINS) | set(KINDS)
        for name, via in self.relations:
            require(name.strip(), f"{where}: a relation has no name")
            require(via in BUILTINS or via in KINDS, f"{where}: relation {name!r} goes via unknown {via!r}")
            require(via != "item", f"{where}: relation {name!r} cannot go via item")
            require(name not in known, f"{where}: relation {name!r} collides with another source")
            known.add(name)
        if self.for_each:
            try:
                parse_path(self.for_each)
            except ValueError as error:
                raise ConfigError(f"{where}: forEach: {error}") from error
        for name, extract in self.labels.items():
            require(_LABEL.fullmatch(name), f"{where}: {name!r} is no label name")
            require(not name.startswith("__"), f"{where}: label {name!r} is reserved")
            extract.check(f"{where}, label {name!r}", known, bool(self.for_each))


@dataclass(frozen=True)
class Config:
    """Rules and what is watched for them."""

    rules: tuple[Rule, ...]
    prefix: str = ""
    watch: tuple[Watched, ...] = ()

    def metric(self, rule: Rule) -> str:
        return self.prefix + rule.name

    def watched(self) -> list[Watched]:
        """What is watched, in the fixed order of kinds; all kinds if nothing is named."""
        named = {w.kind: w for w in self.watch}
        if not named:
            return [Watched(k, CLUSTER if k == "Node" else NAMESPACED) for k in KINDS]
        return [named[k] for k in KINDS if k in named]

    def watched_kinds(self) -> set[str]:
        return {w.kind for w in self.watched()}

    def check(self) -> Config:
        require(self.rules, "no rules")
        require(not self.prefix or _METRIC.fullmatch(self.prefix), f"{self.prefix!r} is no metric prefix")
        for w in self.watch:
            w.check()
        require(not (twice := _twice(w.kind for w in self.watch)), f"watch: kind {twice!r} stands twice")
        for rule in self.rules:
            rule.check()
            missing = rule.required_kinds() - self.watched_kinds()
            require(not missing, f"rule {rule.name!r}: kinds {sorted(missing)} are needed, but not watched")
            require(_METRIC.fullmatch(self.metric(rule)), f"{self.metric(rule)!r} is no metric name")
        require(not (twice := _twice(map(self.metric, self.rules))), f"metric {twice!r} stands twice")
        return self

    def warnings(self) -> Iterator[str]:
        """What may surprise, but runs."""
        kinds = self.watched_kinds()
        for rule in self.rules:
            if rule.sources() & {"ownerController", "topController"} and (gap := [k for k in OWNER_KINDS if k not in kinds]):
                yield f"rule {rule.name!r} follows owners, but {', '.join(gap)} are not watched"
        selected = [w for w in self.watched() if w.label_selector or w.field_selector]
        if any(w.kind == "Pod" for w in selected) and any(w.kind in OWNER_KINDS for w in selected):
            yield "selectors on Pod and on owner kinds can leave owners out that selected Pods have"


def _text(value: object) -> str:
    return "" if value is None else str(value)


def _extract(raw: dict) -> Extract:
    return Extract(_text(raw.get("path")), _text(raw.get("source")) or "anchor", tuple(map(_extract, raw.get("fallbacks") or ())), _text(raw.get("onMissing")))


def config_of(raw: dict) -> Config:
    """A checked configuration from what YAML holds; unknown keys are ignored."""
    rules = tuple(
        Rule(_text(r.get("name")), _text(r.get("anchor")), {str(n): _extract(x or {}) for n, x in (r.get("labels") or {}).items()}, _text(r.get("help")), _text(r.get("forEach")), tuple((_text(x.get("name")), _text(x.get("via"))) for x in r.get("relations") or ()))
        for r in raw.get("rules") or ()
    )
    watch = tuple(
        Watched(_text(w.get("kind")), _text(w.get("scope")), tuple(w.get("namespaces") or ()), _text(w.get("labelSelector")), _text(w.get("fieldSelector"))) for w in (raw.get("watch") or {}).get("resources") or ()
    )
    return Config(rules, _text(raw.get("metricPrefix")), watch).check()


def load(path: str) -> Config:
    """A checked configuration from a YAML file."""
    with open(path) as file:
        return parse(file.read())


def parse(text: str) -> Config:
    """A checked configuration from YAML text."""
    import yaml

    try:
        raw = yaml.safe_load(text)
    except yaml.YAMLError as error:
        raise ConfigError(f"not YAML: {error}") from error
    require(raw is None or isinstance(raw, dict), "the configuration is no mapping")
    return config_of(raw or {})
