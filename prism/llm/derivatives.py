"""Parsing with derivatives, memoised, over streams of token kinds.

A grammar's language is kept as a set of continuations, each a shared stack of grammar expressions still to be read.
The derivative by a token replaces the head of each by what is left of it (and, where the head is nullable, that of
its rest). Derivatives of expressions, of stacks and of whole sets are all memoised, so a token costs one look-up where
its context was met before. An empty derivative marks the failing token; a stream that ends where no continuation is
nullable was cut off.

Grammars are text: ``rule = a 'token' (b | c)* d? ;``. They must not be left-recursive.
"""

from __future__ import annotations

import re

_META = re.compile(r"\s*(?:#[^\n]*\n\s*)*(?:([A-Za-z_]\w*)\s*(=)(?!=)|([A-Za-z_]\w*)|'([^']+)'|([|()*+?;]))")


class Grammar:
    LIMIT = 400_000

    def __init__(self, text: str, start: str):
        self.nodes: list[tuple] = []
        self.known: dict[tuple, int] = {}
        self.rules: dict[str, int] = {}
        self._read(text)
        self._root = self._node("ref", start)
        missing = {n[1] for n in self.nodes if n[0] == "ref"} - self.rules.keys()
        if missing:
            raise ValueError(f"rules without definition: {sorted(missing)}")
        self._null: dict[int, bool] = {}
        self._find_nullable()
        self._derived: dict[tuple[int, str], tuple] = {}
        self._busy: set[tuple[int, str]] = set()
        self._stacks: dict[tuple, int] = {}
        self._head: list[int] = [-1]
        self._rest: list[int] = [-1]
        self._ends: list[bool] = [True]  # stack 0 is empty: all is read
        self._states: dict[frozenset, int] = {}
        self._members: list[frozenset] = []
        self._steps: dict[tuple[int, str], int] = {}
        self._begin()

    def _node(self, *key) -> int:
        if key not in self.known:
            self.known[key] = len(self.nodes)
            self.nodes.append(key)
        return self.known[key]

    def _read(self, text: str) -> None:
        at, items = 0, []
        text += "\n"
        while m := _META.match(text, at):
            at = m.end()
            items.append(("rule", m[1]) if m[2] else ("name", m[3]) if m[3] else ("tok", m[4]) if m[4] else (m[5], m[5]))
        if text[at:].strip():
            raise ValueError(f"grammar: {text[at : at + 60]!r}")
        i = 0

        def alternatives() -> int:
            nonlocal i
            options = [sequence()]
            while items[i][0] == "|":
                i += 1
                options.append(sequence())
            return options[0] if len(options) == 1 else self._node("alt", tuple(dict.fromkeys(options)))

        def sequence() -> int:
            nonlocal i
            parts = []
            while items[i][0] in ("name", "tok", "("):
                kind, value = items[i]
                i += 1
                if kind == "(":
                    x = alternatives()
                    if items[i][0] != ")":
                        raise ValueError(f"grammar: ) expected, {items[i]}")
                    i += 1
                else:
                    x = self._node("ref" if kind == "name" else "tok", value)
                while items[i][0] in ("*", "+", "?"):
                    star = self._node("star", x) if items[i][0] != "?" else None
                    x = self._node("alt", (x, self._node("seq", ()))) if star is None else star if items[i][0] == "*" else self._node("seq", (x, star))
                    i += 1
                parts.append(x)
            return parts[0] if len(parts) == 1 else self._node("seq", tuple(parts))

        while i < len(items):
            if items[i][0] != "rule":
                raise ValueError(f"grammar: rule expected, {items[i]}")
            name = items[i][1]
            i += 1
            self.rules[name] = alternatives()
            if items[i][0] != ";":
                raise ValueError(f"grammar: ; expected after {name}, {items[i]}")
            i += 1

    def _find_nullable(self) -> None:
        """Least fixed point over the grammar."""
        null = dict.fromkeys(range(len(self.nodes)), False)
        changed = True
        while changed:
            changed = False
            for i, n in enumerate(self.nodes):
                if null[i]:
                    continue
                k = n[0]
                v = k == "star" or k == "seq" and all(null[x] for x in n[1]) or k == "alt" and any(null[x] for x in n[1]) or k == "ref" and null[self.rules[n[1]]]
                if v:
                    null[i] = changed = True
        self._null = null

    def _push(self, parts: tuple, rest: int) -> int:
        for x in reversed(parts):
            key = (x, rest)
            s = self._stacks.get(key)
            if s is None:
                self._stacks[key] = s = len(self._head)
                self._head.append(x)
                self._rest.append(rest)
                self._ends.append(self._null[x] and self._ends[rest])
            rest = s
        return rest

    def _state(self, members: frozenset) -> int:
        s = self._states.get(members)
        if s is None:
            self._states[members] = s = len(self._members)
            self._members.append(members)
        return s

    def _derive(self, x: int, token: str) -> tuple:
        """What may be left of an expression after the token: tuples of expressions."""
        key = (x, token)
        found = self._derived.get(key)
        if found is not None:
            return found
        if key in self._busy:
            raise ValueError(f"left recursion at {self.nodes[x]}")
        self._busy.add(key)
        kind, value = self.nodes[x]
        if kind == "tok":
            out = ((),) if value == token else ()
        elif kind == "ref":
            out = self._derive(self.rules[value], token)
        elif kind == "alt":
            out = tuple(dict.fromkeys(r for y in value for r in self._derive(y, token)))
        elif kind == "star":
            out = tuple((*r, x) for r in self._derive(value, token))
        else:
            found_ = {}
            for i, y in enumerate(value):
                for r in self._derive(y, token):
                    found_[(*r, *value[i + 1 :])] = None
                if not self._null[y]:
                    break
            out = tuple(found_)
        self._busy.discard(key)
        self._derived[key] = out
        return out

    def step(self, state: int, token: str) -> int:
        """The derivative of a state by a token; ``empty`` where there is none."""
        key = (state, token)
        after = self._steps.get(key)
        if after is None:
            out, todo, seen = set(), list(self._members[state]), set()
            while todo:
                s = todo.pop()
                if s == 0 or s in seen:
                    continue
                seen.add(s)
                x, rest = self._head[s], self._rest[s]
                for r in self._derive(x, token):
                    out.add(self._push(r, rest))
                if self._null[x]:
                    todo.append(rest)
            self._steps[key] = after = self._state(frozenset(out))
        return after

    def nullable(self, state: int) -> bool:
        return any(self._ends[s] for s in self._members[state])

    def trim(self) -> None:
        """Forget stacks and states where they grew beyond the limit (between two streams only)."""
        if len(self._steps) > self.LIMIT or len(self._head) > self.LIMIT:
            self._stacks, self._head, self._rest, self._ends = {}, [-1], [-1], [True]
            self._states, self._members, self._steps = {}, [], {}
            self._begin()

    def _begin(self) -> None:
        self.start = self._state(frozenset([self._push((self._root,), 0)]))
        self.empty = self._state(frozenset())
