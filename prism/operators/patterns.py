"""Path queries that are built, not written: a builder that cannot be injected into, and patterns with parameters."""

from __future__ import annotations

import re
from dataclasses import dataclass, field

from pyspark.sql import DataFrame

from prism.operators import outline

_NAME = re.compile(r"[A-Za-z_][A-Za-z0-9_-]*")
_SLOT = re.compile(r"\$([A-Za-z0-9_-]+)")


def quoted(value: str) -> str:
    """A value within quotes of the path language: backslashes and both quotes escaped."""
    return '"' + re.sub(r"([\\\"'])", r"\\\1", value) + '"'


def _name(kind: str, value: str) -> str:
    if not _NAME.fullmatch(value):
        raise ValueError(f"{value!r} is no name of a {kind}")
    return value


@dataclass(frozen=True)
class Query:
    """A path query in the making; each step gives a new one."""

    text: str

    @staticmethod
    def tag(name: str) -> Query:
        return Query("//" + ("*" if name == "*" else _name("tag", name)))

    def descendant(self, name: str) -> Query:
        return Query(f"{self.text}//{_name('tag', name)}")

    def child(self, name: str) -> Query:
        return Query(f"{self.text}>{_name('tag', name)}")

    def where(self, attribute: str, op: str = "exists", value: str = "") -> Query:
        """op: = ^= $= ~= contains exists."""
        a = "@" + _name("attribute", attribute)
        if op not in ("=", "^=", "$=", "~=", "contains", "exists"):
            raise ValueError(f"{op!r} is no test")
        return Query(self.text + (f"[{a}]" if op == "exists" else f"[contains({a},{quoted(value)})]" if op == "contains" else f"[{a}{op}{quoted(value)}]"))


class PatternError(ValueError):
    pass


# Kinds of targets, the tests of names and filters, what each part of a pattern may hold.
KINDS = ("callable", "function", "method", "class", "interface", "struct", "type", "custom")
NAME_TESTS = {"name": "=", "nameStartsWith": "^=", "nameEndsWith": "$=", "nameContains": "contains", "nameRegex": "~="}
OPS = {"eq": "=", "starts": "^=", "ends": "$=", "contains": "contains", "regex": "~=", "exists": "exists"}
PARTS = {
    "spec": {"name", "description", "target", "scope", "filters", "params", "corpus", "limit", "languages"}, "target": {"kind", "customTag", "isDeclaration", *NAME_TESTS}, "scope": {"within", "withinName", "directChild"},
    "filter": {"attr", "op", "value"}, "param": {"name", "required", "default", "description", "type"},
}


@dataclass
class Pattern:
    """A pattern that compiled: a template with $slots, and what is doubtful about it."""

    spec: dict
    template: str
    warnings: list[str] = field(default_factory=list)

    def bind(self, **args: str) -> str:
        """The path query with its slots filled; a value can only be matched against, never add a test."""
        declared = {p["name"]: p for p in self.spec.get("params", [])}
        for a in args:
            if a not in declared:
                raise PatternError(f"{a} is no parameter of {self.spec.get('name')} (it takes {', '.join(declared) or 'none'})")
        values = {}
        for n, p in declared.items():
            values[n] = args.get(n, p.get("default"))
            if values[n] is None and p.get("required"):
                raise PatternError(f"{n} needs a value")
        return _SLOT.sub(lambda m: re.sub(r"([\\\"'])", r"\\\1", values[m[1]] or "") if m[1] in values else m[0], self.template)


def compile_pattern(spec: dict) -> Pattern:
    """The template of a pattern. Errors: an unknown kind, a slot that is not declared, what the path language refuses. Warnings: unknown
    fields, attributes that outlines do not have, parameters that nothing uses."""
    errors, warnings, used = [], [], set()
    target, scope = spec.get("target", {}), spec.get("scope") or {}
    declared = [p["name"] for p in spec.get("params", [])]
    for part, rows in (("spec", [spec]), ("target", [target]), ("scope", [scope]), ("filter", spec.get("filters", [])), ("param", spec.get("params", []))):
        warnings += [f"{part}: {k} is not a known field" for r in rows for k in sorted(set(r) - PARTS[part])]

    def slot(value: str, where: str) -> str:
        if m := _SLOT.fullmatch(value):
            used.add(m[1])
            if m[1] not in declared:
                errors.append(f"{where}: parameter {m[1]} is not declared")
            return f'"{value}"'
        return quoted(value)

    tag = target.get("customTag") if target.get("kind") == "custom" else target.get("kind")
    if target.get("kind") not in KINDS or not tag:
        errors.append(f"target: {target.get('kind')!r} is no kind" if target.get("kind") not in KINDS else "target: a custom kind needs customTag")
        tag = "*"
    tests = [f"[contains(@name,{slot(target[k], k)})]" if op == "contains" else f"[@name{op}{slot(target[k], k)}]" for k, op in NAME_TESTS.items() if target.get(k)]
    if target.get("isDeclaration"):
        tests.append("[@declaration]")
    for f in spec.get("filters", []):
        a, op = f.get("attr", ""), OPS.get(f.get("op", ""))
        if op is None or not _NAME.fullmatch(a):
            errors.append(f"filter: {a} {f.get('op')} is no test")
            continue
        if a not in outline.ATTRIBUTES and not spec.get("corpus"):
            warnings.append(f"filter: {a} is not an attribute of outlines")
        v = "" if op == "exists" else slot(str(f.get("value", "")), f"filter {a}")
        tests.append(f"[@{a}]" if op == "exists" else f"[contains(@{a},{v})]" if op == "contains" else f"[@{a}{op}{v}]")
    warnings += [f"param: {p} is never used" for p in declared if p not in used]
    text = f"{tag}{''.join(tests)}"
    if within := scope.get("within"):
        named = f"[@name={slot(scope['withinName'], 'withinName')}]" if scope.get("withinName") else ""
        text = f"{_name('tag', within)}{named}{'>' if scope.get('directChild') else '//'}{text}"
    if errors:
        raise PatternError("; ".join(errors))
    try:
        outline.parse(_SLOT.sub(r"p_\1", "//" + text))
    except outline.PathQueryError as e:
        raise PatternError(str(e)) from e
    return Pattern(spec, "//" + text, warnings)


def run_pattern(nodes: DataFrame, pattern: Pattern, corpora: dict[str, DataFrame] | None = None, **args: str) -> DataFrame:
    """The nodes a pattern finds; one with a corpus only in the files that have records of it. corpora: name to (path, ..)."""
    found = outline.select(nodes, pattern.bind(**args))
    corpus = pattern.spec.get("corpus")
    if corpus is None:
        return found
    if corpora is None or corpus not in corpora:
        raise PatternError(f"there is no corpus {corpus}")
    return found.join(corpora[corpus].select("path").distinct(), "path", "left_semi")
