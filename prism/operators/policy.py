"""Screening policies of a project: checked field by field, shown to do what they say, and merged over the built-in rules."""

from __future__ import annotations

import hashlib
import json
import re
from dataclasses import replace
from typing import Any

from prism.operators.screen import G, O, Q, RULES, Rule, S

# What a policy may hold, the levels of trust with the profile each reads, and what a rule without an action does.
FIELDS, RULE_FIELDS = ("rules", "actions", "fallback", "sources"), ("id", "category", "severity", "description", "pattern", "flags", "message", "replacement", "fixtures")
CATEGORIES, SEVERITIES = ("injection", "obfuscation", "exfiltration", "secrets", "poisoning"), ("low", "medium", "high")
TRUST = {"first-party": "light", "third-party": "standard", "untrusted": "strict"}
FALLBACK = {"light": {"low": G, "medium": G, "high": Q}, "standard": {"low": G, "medium": G, "high": Q}, "strict": {"low": G, "medium": Q, "high": Q}}
_ID = re.compile(r"[a-z][a-z0-9]*(?:-[a-z0-9]+)*")
#: A repeated group that is repeated again, whose time can explode on a near miss.
_NESTED = re.compile(r"\((?:[^()\\]|\\.)*[+*}](?:[^()\\]|\\.)*\)[+*{]")


class PolicyError(ValueError):
    def __init__(self, source: str, field: str, problem: str):
        super().__init__(f"policy {source}: {field} {problem}")
        self.field = field


def check_policy(raw: Any, source: str) -> dict:
    """The policy, if every field of it is as it must be; else an error that names the field. Nothing is guessed."""

    def need(ok: bool, field: str, problem: str) -> None:
        if not ok:
            raise PolicyError(source, field, problem)

    need(isinstance(raw, dict), "(root)", "must be an object")
    for k in raw:
        need(k in FIELDS, k, "is not a known field")
    rules = raw.get("rules", [])
    need(isinstance(rules, list), "rules", "must be an array of rules")
    seen: set[str] = set()
    for n, r in enumerate(rules):
        at = lambda f, n=n: f"rules[{n}].{f}"
        need(isinstance(r, dict), f"rules[{n}]", "must be an object")
        for k in r:
            need(k in RULE_FIELDS, at(k), "is not a known field")
        for k in ("id", "pattern"):
            need(isinstance(r.get(k), str) and r[k] != "", at(k), "must be a non-empty string")
        for k in ("description", "message", "replacement"):
            need(k not in r or isinstance(r[k], str), at(k), "must be a string")
        need(bool(_ID.fullmatch(r["id"])), at("id"), "must be lower-case words joined by -")
        need(r["id"] not in seen, at("id"), "is defined twice")
        seen.add(r["id"])
        need(r.get("category") in CATEGORIES, at("category"), f"must be one of {', '.join(CATEGORIES)}")
        need(r.get("severity") in SEVERITIES, at("severity"), f"must be one of {', '.join(SEVERITIES)}")
        flags = r.get("flags", "")
        need(isinstance(flags, str) and set(flags) <= set("ims") and len(set(flags)) == len(flags), at("flags"), "may hold each of i, m and s once")
        try:
            compiled = re.compile(_pattern(r))
        except re.error as e:
            raise PolicyError(source, at("pattern"), f"is no regular expression: {e}") from e
        need(not _NESTED.search(r["pattern"]), at("pattern"), "repeats a repeated group")
        need(compiled.search("") is None, at("pattern"), "matches the empty string")
        shown = r.get("fixtures")
        need(isinstance(shown, dict), at("fixtures"), "must show what the rule catches and what it leaves alone")
        for kind, wanted in (("attack", True), ("benign", False)):
            cases = shown.get(kind)
            need(isinstance(cases, list) and bool(cases) and all(isinstance(c, str) for c in cases), at(f"fixtures.{kind}"), "must be a non-empty array of strings")
            for c in cases:
                need((compiled.search(c) is not None) == wanted, at(f"fixtures.{kind}"), f"{c!r} is {'not ' if wanted else ''}found")
    for part, allowed, keys in (("actions", (O, G, S, Q), None), ("fallback", (G, S, Q), SEVERITIES)):
        table = raw.get(part, {})
        need(isinstance(table, dict), part, "must be an object by level of trust")
        for trust, entries in table.items():
            need(trust in TRUST, f"{part}.{trust}", f"must be one of {', '.join(TRUST)}")
            need(isinstance(entries, dict), f"{part}.{trust}", "must be an object")
            for k, action in entries.items():
                need(keys is None or k in keys, f"{part}.{trust}.{k}", f"must be one of {', '.join(keys or ())}")
                need(action in allowed, f"{part}.{trust}.{k}", f"must be one of {', '.join(allowed)}")
    return {"source": source, "rules": rules, "actions": raw.get("actions", {}), "fallback": raw.get("fallback", {})}


def _pattern(rule: dict) -> str:
    return (f"(?{rule['flags']})" if rule.get("flags") else "") + rule["pattern"]


def merge(policies: list[dict], builtin: tuple[Rule, ...] = RULES) -> tuple[tuple[Rule, ...], str]:
    """(rules, fingerprint): the built-in rules and those of all policies with the action of each profile. A rule may be defined
    once; an action may only name one that exists; of several policies that set the same the last counts. A policy's rule
    without an action does what its severity falls back to."""
    owner = {r.id: "the built-in rules" for r in builtin}
    fallback = {p: dict(f) for p, f in FALLBACK.items()}
    for p in policies:
        for r in p["rules"]:
            if r["id"] in owner:
                raise PolicyError(p["source"], f"rule {r['id']}", f"is already defined by {owner[r['id']]}")
            owner[r["id"]] = p["source"]
        for trust, f in p["fallback"].items():
            fallback[TRUST[trust]].update(f)
    rules = {r.id: r for r in builtin}
    for p in policies:
        for r in p["rules"]:
            rules[r["id"]] = Rule(r["id"], r["category"], r["severity"], _pattern(r), r.get("replacement"), *[fallback[x][r["severity"]] for x in ("light", "standard", "strict")])
    for p in policies:
        for trust, table in p["actions"].items():
            for rule, action in table.items():
                if rule not in owner:
                    raise PolicyError(p["source"], f"actions.{trust}.{rule}", f"names no rule (known: {', '.join(owner)})")
                rules[rule] = replace(rules[rule], **{TRUST[trust]: action})
    told = [[p["source"], p["rules"], p["actions"], p["fallback"]] for p in policies]
    return tuple(rules.values()), hashlib.sha256(json.dumps(told, sort_keys=True).encode()).hexdigest()
