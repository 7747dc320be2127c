"""Configurations that run, and those that must not."""

import pytest

from viewloom.model import Config, ConfigError, Extract, Rule, Watched, parse
from viewloom.plans.catalogue import RULES
from viewloom.plans.engine import readers

OK = {"name": Extract("metadata.name")}


def rule(**kw):
    return Rule(**({"name": "r", "anchor": "Pod", "labels": OK} | kw))


@pytest.mark.parametrize(
    "config",
    [
        Config(()),
        Config((rule(),), prefix="9x"),
        Config((rule(),), watch=(Watched("Job"),)),
        Config((rule(),), watch=(Watched("Pod"), Watched("Pod"))),
        Config((rule(),), watch=(Watched("Pod", "All"),)),
        Config((rule(),), watch=(Watched("Pod"), Watched("Node", "Namespaced"))),
        Config((rule(),), watch=(Watched("Pod"), Watched("Node", "Cluster", ("a",)))),
        Config((rule(),), watch=(Watched("Pod", "Cluster", ("a",)),)),
        Config((rule(name=" "),)),
        Config((rule(anchor="Job"),)),
        Config((rule(labels={}),)),
        Config((rule(relations=(("", "anchor"),)),)),
        Config((rule(relations=(("x", "nothing"),)),)),
        Config((rule(relations=(("x", "item"),)),)),
        Config((rule(relations=(("Pod", "anchor"),)),)),
        Config((rule(relations=(("x", "anchor"), ("x", "anchor"))),)),
        Config((rule(labels={"a-b": Extract("x")}),)),
        Config((rule(labels={"__a": Extract("x")}),)),
        Config((rule(labels={"a": Extract("x", "who")}),)),
        Config((rule(labels={"a": Extract("x", "item")}),)),
        Config((rule(labels={"a": Extract(" ")}),)),
        Config((rule(labels={"a": Extract("x", fallbacks=(Extract("y", fallbacks=(Extract("z"),)),))}),)),
        Config((rule(labels={"a": Extract("x[")}),)),
        Config((rule(for_each="x["),)),
        Config((rule(name="a b"),)),
        Config((rule(), rule())),
        Config((rule(),), watch=(Watched("Node", "Cluster"),)),
        Config((rule(labels={"a": Extract("x", "Node")}),), watch=(Watched("Pod"),)),
    ],
)
def test_rejected(config):
    with pytest.raises(ConfigError):
        config.check()


def test_accepted_and_derived():
    config = parse(RULES)
    info = config.rules[0]
    assert config.metric(info) == "shop_pod_info"
    assert info.label_names() == sorted(info.labels)
    assert info.resolved("top") == "topController" and info.resolved("item") == "item"
    assert info.read_kinds() == {"ReplicaSet", "Deployment", "StatefulSet", "DaemonSet"}
    assert config.rules[2].read_kinds() == set()
    assert info.labels["segment"].on_missing == "none"
    assert rule().help_text() != "" and rule(help="h").help_text() == "h"
    assert [w.kind for w in Config((rule(),)).watched()][-1] == "Node"
    assert readers(config)["ReplicaSet"] == ["shop_pod_info"]
    assert len(list(Config((rule(labels={"a": Extract("x", "topController")}),), watch=(Watched("Pod", label_selector="a=b"), Watched("ReplicaSet", label_selector="a"))).check().warnings())) == 2


def test_owner_sources_need_no_watch_and_unknown_keys_are_ignored():
    config = parse("rules: [{name: r, anchor: Pod, extra: 1, labels: {a: {source: ownerController, path: kind}}}]\nwatch: {resources: [{kind: Pod, scope: Cluster}]}\nmore: 2")
    assert config.rules[0].sources() == {"ownerController"}
    for text in ("rules: [", "- a", ""):
        with pytest.raises(ConfigError):
            parse(text)
