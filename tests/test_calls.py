import pytest

from prism.operators import facts, linking, resolve

SYMBOLS = "path string, seq int, id string, name string, base_name string, kind string, parent_id string, exported int, start_line int, end_line int, params string, alias_of string"


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("f", ("f", None, None)), ("a.b", ("b", "name", "a")), ("a?.b.c", ("c", "name", "a.b")), ("A::b", ("b", "name", "A")), ("$this->f", ("f", "self", None)), ("this.cache.get", ("get", "name", "this.cache")),
        ("A\\b", ("b", "name", "A")), ("f<T>", ("f", None, None)), ("a.b(c.d).e", ("e", "complex", None)), ("a[0]", (None, None, None)), ("x!.y", ("y", "name", "x")), ("self.run", ("run", "self", None)),
    ],
)
def test_callees(text, want):
    assert facts.parse_callee(text) == want


def test_scan_sees_no_comments_strings_or_declarations():
    text = "// f()\nconst a = \"g()\" + h(1);\n/* i() */ new Foo(x.y(2));\nfunction j() { return k?.l(); }\nif (m) n(`o()`)\n$p->q()->r(); import('s'); e.f(/[(]x(/).g()"
    got = facts.scan_calls(text)
    assert [(n, k, r, how, line) for n, k, r, how, line in got] == [
        ("h", None, None, "call", 2), ("Foo", None, None, "new", 3), ("y", "name", "x", "call", 3), ("l", "name", "k", "call", 4), ("n", None, None, "call", 5), ("q", "name", "$p", "call", 6), ("r", "complex", None, "call", 6), ("f", "name", "e", "call", 6), ("g", "complex", None, "call", 6),
    ]


def test_python_facts(spark):
    text = "import a.b\nfrom .c import d as e, f\nLIMIT = g\nclass K(Base):\n    '''Doc.'''\n    def m(self, x, *rest):\n        def inner(): return x()\n        return self.n(inner(), a.b.h(), super().m())\n\n    def m(self): pass\n"
    t = spark.createDataFrame([("p/x.py", text), ("p/x.py", text), ("p/bad.py", "def ("), ("p/none.py", None), ("p/empty.py", "")], "path string, content string")
    got = {r["id"]: r for r in facts.python_symbols(t).collect()}
    assert set(got) == {"p/x.py#LIMIT", "p/x.py#K", "p/x.py#K.m", "p/x.py#K.m.inner", "p/x.py#K.m~2"}
    assert got["p/x.py#K.m"]["params"] == "self, x, rest" and got["p/x.py#K.m"]["kind"] == "method" and got["p/x.py#K.m.inner"]["kind"] == "function"
    assert got["p/x.py#LIMIT"]["alias_of"] == "g" and got["p/x.py#K"]["doc"] == "Doc."
    calls = facts._python("p/x.py", text)[1]
    assert [c[2:7] for c in calls] == [("p/x.py#K.m", "n", "self", None, "call"), ("p/x.py#K.m", "inner", None, None, "call"), ("p/x.py#K.m", "h", "name", "a.b", "call"), ("p/x.py#K.m", "m", "self", None, "call"), ("p/x.py#K.m.inner", "x", None, None, "call")] or calls
    names = {r["specifier"]: [tuple(n) for n in r["names"]] for r in facts.python_imports(t).collect()}
    assert names == {"a.b": [("*", "a")], ".c": [("d", "e"), ("f", "f")]}


FILES = {
    "r/lib.ts": "export function load() { return helper(); }\nfunction helper() { helper(); }\nexport class Store {\n  get(k) { return this.find(k); }\n  find(k) { return k(); }\n  put() { this.gone(); }\n}\nexport default load\n",
    "r/mid.ts": "export { load as fetchIt } from './lib'\nexport * from './lib'\n",
    "r/use.ts": "import start, { Store } from './lib'\nimport { fetchIt, Store as S2 } from './mid'\nimport * as all from './lib'\nimport { x } from 'pkg'\nimport { y } from './nowhere'\n"
    "function main(cb) {\n  start(); fetchIt(); all.load(); x(); x.run(); y();\n  cb(); missing(); console.log(1); JSON.parse('');\n  new Store(); Store.get(); S2.get(); all.Store.find(); Store.none();\n  const s = make(); s.get(); thing.put(); a().b();\n}\n",
    "r/al.ts": "import { load } from './lib'\nexport const again = load\nagain()\n",
}


def _symbol(path, seq, name, kind, parent, start, end, exported=1, params=None, alias=None):
    return (path, seq, f"{path}#{name}", name, name.split(".")[-1], kind, f"{path}#{parent}" if parent else None, exported, start, end, params, alias)


ROWS = [
    _symbol("r/lib.ts", 0, "load", "function", None, 1, 1), _symbol("r/lib.ts", 1, "helper", "function", None, 2, 2, 0), _symbol("r/lib.ts", 2, "Store", "class", None, 3, 7), _symbol("r/lib.ts", 3, "Store.get", "method", "Store", 4, 4, None, "k"),
    _symbol("r/lib.ts", 4, "Store.find", "method", "Store", 5, 5, None, "k"), _symbol("r/lib.ts", 5, "Store.put", "method", "Store", 6, 6, None), _symbol("r/use.ts", 0, "main", "function", None, 6, 11, 0, "cb"), _symbol("r/al.ts", 0, "again", "variable", None, 2, 2, 1, None, "load"),
]


def test_calls_are_linked(spark):
    texts = spark.createDataFrame(list(FILES.items()), "path string, content string")
    symbols = spark.createDataFrame(ROWS, SYMBOLS)
    linked = resolve.link_imports(resolve.imports(texts), texts.select("path"))
    sites = facts.call_sites(texts, symbols).cache()
    out = linking.link_calls(sites, symbols, linked, facts.exports_of(texts)).cache()
    got = {(r["path"][2:-3], r["line"], r["name"], r["receiver"] or r["receiver_kind"]): (r["outcome"], r["to"].replace("r/", "", 1), r["reason"]) for r in sites.join(out, ["path", "seq"]).collect()}
    assert len(out.select("path", "seq").distinct().collect()) == sites.count()
    want = {
        ("lib", 1, "helper", None): ("symbol", "lib.ts#helper"), ("lib", 2, "helper", None): ("symbol", "lib.ts#helper"), ("lib", 4, "find", "self"): ("symbol", "lib.ts#Store.find"), ("lib", 5, "k", None): ("unresolved", "k"), ("lib", 6, "gone", "self"): ("unresolved", "gone"),
        ("use", 7, "start", None): ("symbol", "lib.ts#load"), ("use", 7, "fetchIt", None): ("symbol", "lib.ts#load"), ("use", 7, "load", "all"): ("symbol", "lib.ts#load"), ("use", 7, "x", None): ("external", "pkg#x"), ("use", 7, "run", "x"): ("external", "pkg#x.run"), ("use", 7, "y", None): ("unresolved", "y"),
        ("use", 8, "cb", None): ("unresolved", "cb"), ("use", 8, "missing", None): ("unresolved", "missing"), ("use", 8, "log", "console"): ("external", "global#console.log"), ("use", 8, "parse", "JSON"): ("external", "global#JSON.parse"),
        ("use", 9, "Store", None): ("symbol", "lib.ts#Store"), ("use", 9, "get", "Store"): ("symbol", "lib.ts#Store.get"), ("use", 9, "get", "S2"): ("symbol", "lib.ts#Store.get"), ("use", 9, "find", "all.Store"): ("symbol", "lib.ts#Store.find"), ("use", 9, "none", "Store"): ("unresolved", "none"),
        ("use", 10, "make", None): ("unresolved", "make"), ("use", 10, "get", "s"): ("name", "lib.ts#Store.get"), ("use", 10, "put", "thing"): ("name", "lib.ts#Store.put"), ("use", 10, "b", "complex"): ("unresolved", "b"), ("use", 10, "a", None): ("unresolved", "a"),
        ("al", 3, "again", None): ("symbol", "al.ts#again"),
    }
    assert {k: v[:2] for k, v in got.items()} == want
    edges = linking.call_edges(sites, out, symbols)
    helper = {(r["source_path"], tuple(r["lines"])) for r in edges.where("to_ref = 'r/lib.ts#helper'").collect()}
    assert helper == {("r/lib.ts#load", (1,)), ("r/lib.ts#helper", (2,))}
    who = {(r["source_path"], r["evidence"]) for r in linking.callers(edges, symbols).where("to_ref = 'r/lib.ts#Store.get'").collect()}
    assert who == {("r/use.ts#main", "resolved"), ("r/use.ts#main", "name")}
    assert linking.callers(edges, symbols, resolved_only=True).where("evidence = 'name'").count() == 0
    assert linking.callees(edges, symbols).where("source_path = 'r/use.ts#main' and kind = 'external'").count() == 4


def test_aliases_follow_to_the_end_and_stop_in_a_circle(spark):
    rows = [_symbol("p.py", 0, "a", "variable", None, 1, 1, None, None, "b"), _symbol("p.py", 1, "b", "variable", None, 2, 2, None, None, "c"), _symbol("p.py", 2, "c", "function", None, 3, 3, None), _symbol("q.py", 0, "x", "variable", None, 1, 1, None, None, "y"), _symbol("q.py", 1, "y", "variable", None, 2, 2, None, None, "x")]
    texts = spark.createDataFrame([("p.py", "a = b\nb = c\ndef c(): pass\na()\n"), ("q.py", "x = y\ny = x\nx()\n")], "path string, content string")
    symbols = spark.createDataFrame(rows, SYMBOLS)
    linked = resolve.link_imports(resolve.imports(texts), texts.select("path"))
    out = linking.link_calls(facts.call_sites(texts, symbols), symbols, linked, facts.exports_of(texts))
    assert sorted((r["path"], r["to"]) for r in out.collect()) == [("p.py", "p.py#c"), ("q.py", "q.py#y")]


def test_linking_of_nothing(spark):
    texts = spark.createDataFrame([], "path string, content string")
    symbols = spark.createDataFrame([], SYMBOLS)
    linked = resolve.link_imports(resolve.imports(texts), texts.select("path"))
    assert linking.link_calls(facts.call_sites(texts, symbols), symbols, linked, facts.exports_of(texts)).count() == 0


def test_candidates_in_their_order(spark):
    files = ["a/x.ts", "a/x.js", "a/dir/index.tsx", "a/only.js", "a/style.css", "a/t.d.ts", "a/m.mts", "b/pkg/__init__.py", "b/pkg/mod.py", "b/src/deep/leaf.py", "b/ns/part.py", "p/src/Foo/Bar.php", "p/app/Model.php"]
    rows = [("a/u.ts", s) for s in ("./x.js", "./x", "./dir", "./only.js", "./style.css", "./t.d.ts", "./m.mjs", "./no", "react/jsx", "@s/p/q", "node:fs", "../../up")]
    texts = [("a/u.ts", "\n".join(f"import z from '{s}'" for _, s in rows)), ("b/u.py", "from pkg import mod\nimport pkg.mod\nfrom deep import leaf\nfrom ns import part\nfrom .pkg import mod\nfrom . import u2\nimport os, pkg\n"), ("p/u.php", "<?php\nuse Foo\\Bar;\nuse Acme\\Model as M;\nuse Gone\\X;\n")]
    t = spark.createDataFrame(texts, "path string, content string")
    found = resolve.imports(t).unionByName(resolve.php_uses(t))
    known = spark.createDataFrame([(f,) for f in files if not f.endswith(".css")], "path string")
    out = resolve.link_imports(found, known, spark.createDataFrame([("a/style.css",)], "path string"), scope_parts=1)
    got = {(r["path"][0], r["line"], r["specifier"]): (r["kind"], r["to"]) for r in out.collect()}
    assert got == {
        ("a", 1, "./x.js"): ("imports", "a/x.ts"), ("a", 2, "./x"): ("imports", "a/x.ts"), ("a", 3, "./dir"): ("imports", "a/dir/index.tsx"), ("a", 4, "./only.js"): ("imports", "a/only.js"), ("a", 5, "./style.css"): ("imports:asset", "a/style.css"), ("a", 6, "./t.d.ts"): ("imports", "a/t.d.ts"),
        ("a", 7, "./m.mjs"): ("imports", "a/m.mts"), ("a", 8, "./no"): ("imports:dangling", "./no"), ("a", 9, "react/jsx"): ("imports:external", "react"), ("a", 10, "@s/p/q"): ("imports:external", "@s/p"), ("a", 11, "node:fs"): ("imports:external", "node:fs"), ("a", 12, "../../up"): ("imports:dangling", "../../up"),
        ("b", 1, "pkg"): ("imports", "b/pkg/__init__.py"), ("b", 2, "pkg.mod"): ("imports", "b/pkg/mod.py"), ("b", 3, "deep"): ("imports", "b/src/deep/leaf.py"), ("b", 4, "ns"): ("imports", "b/ns/part.py"), ("b", 5, ".pkg"): ("imports", "b/pkg/__init__.py"), ("b", 6, "."): ("imports:dangling", "."),
        ("b", 7, "os"): ("imports:external", "os"), ("b", 7, "pkg"): ("imports", "b/pkg/__init__.py"), ("p", 2, "Foo\\Bar"): ("imports", "p/src/Foo/Bar.php"), ("p", 3, "Acme\\Model"): ("imports", "p/app/Model.php"), ("p", 4, "Gone\\X"): ("imports:external", "Gone\\X"),
    }


def test_aliases_and_psr(spark):
    rules = spark.createDataFrame([("", "@app/*", 0, "src/*"), ("", "@app/ui/*", 0, "ui/*"), ("", "exact", 0, "one/two"), ("pkg", "@app/*", 0, "pkg/lib/*")], "config string, pattern string, nth int, target string")
    asks = spark.createDataFrame([("", "@app/x"), ("", "@app/ui/y"), ("", "exact"), ("pkg", "@app/ui/y"), ("", "none")], "config string, specifier string")
    assert {(r["config"], r["specifier"]): r["target"] for r in resolve.alias_targets(asks, rules).collect()} == {("", "@app/x"): "src/x", ("", "@app/ui/y"): "ui/y", ("", "exact"): "one/two", ("pkg", "@app/ui/y"): "pkg/lib/ui/y"}
    t = spark.createDataFrame([("main.ts", "import a from '@app/x'\nimport b from '@app/gone'\nimport c from 'left'\n"), ("pkg/in.ts", "import a from '@app/x'\n")], "path string, content string")
    known = spark.createDataFrame([("src/x.ts",), ("pkg/lib/x/index.js",)], "path string")
    out = resolve.link_imports(resolve.imports(t), known, aliases=rules)
    assert {(r["path"], r["specifier"]): (r["kind"], r["to"]) for r in out.collect()} == {("main.ts", "@app/x"): ("imports", "src/x.ts"), ("main.ts", "@app/gone"): ("imports:dangling", "@app/gone"), ("main.ts", "left"): ("imports:external", "left"), ("pkg/in.ts", "@app/x"): ("imports", "pkg/lib/x/index.js")}
    psr = spark.createDataFrame([("", "App\\", "app", 0, False), ("", "App\\Http\\", "web", 1, False), ("", "Old_", "lib", 2, True)], "scope string, prefix string, folder string, nth int, psr0 boolean")
    names = spark.createDataFrame([("", "App\\Http\\Kernel"), ("", "\\App\\User"), ("", "Old_Thing_Sub")], "scope string, specifier string")
    got = {}
    for r in resolve.psr_candidates(names, psr).orderBy("nth").collect():
        got.setdefault(r["specifier"], []).append(r["candidate"])
    assert got == {"App\\Http\\Kernel": ["web/Kernel.php", "app/Http/Kernel.php"], "\\App\\User": ["app/User.php"], "Old_Thing_Sub": ["lib/Old/Thing/Sub.php"]}
