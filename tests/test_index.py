import json

import pytest
from pyspark.sql import functions as F

from prism.operators import cards, codec, evaluation, fragments, graph, paging, patterns, policy, search, store, trainer, workspace
from prism.operators.screen import RULES
from prism.streaming import telemetry


def rows(df):
    return sorted(map(tuple, df.collect()), key=repr)


# ---- workspace


@pytest.mark.parametrize(
    ("rules", "path", "want"),
    [
        ("*.log", "a/b.log", True), ("*.log\n!keep.log", "a/keep.log", False), ("build/", "build/x", True), ("build/", "build", False), ("/build", "a/build", False), ("/build", "build/x/y", True), ("a/b", "x/a/b", False), ("a/**/b", "a/b", True), ("a/**/b", "a/x/y/b", True),
        ("**/x", "p/q/x", True), ("x/**", "x/y/z", True), ("d/\n!d/keep", "d/keep", True), ("# c\n\n\\#c", "#c", True), ("?.py", "a.py", True), ("?.py", "ab.py", False), ("[ab].py", "b.py", True), ("[!ab].py", "b.py", False), ("f ", "f", True), ("", "anything", False),
    ],
)
def test_ignore_rules(spark, rules, path, want):
    got = spark.range(1).select(workspace.ignored(F.lit(path), [("", workspace.ignore_rules(rules))])).first()[0]
    assert got is want


def test_nearer_ignore_files_win(spark):
    layers = [("", workspace.ignore_rules("*.js")), ("a", workspace.ignore_rules("!keep.js"))]
    df = spark.createDataFrame([("a/keep.js",), ("keep.js",), ("a/x.js",), ("b/x.ts",)], "path string")
    assert rows(df.where(~workspace.ignored(F.col("path"), layers))) == [("a/keep.js",), ("b/x.ts",)]


def test_decoding(spark):
    files = [("u", "plain é".encode()), ("b", "﻿bom".encode()), ("l", b"\xff\xfe" + "wide".encode("utf-16-le")), ("g", b"\xfe\xff" + "big".encode("utf-16-be")), ("n", b"a\x00b"), ("x", b"bad \xff byte"), ("e", b""), ("z", None), ("late", b"x" * 9000 + b"\x00")]
    got = {r["path"]: r for r in workspace.decoded(spark.createDataFrame(files, "path string, content binary")).collect()}
    assert [got[k]["text"] for k in "ublg"] == ["plain é", "bom", "wide", "big"]
    assert got["n"]["binary"] and got["n"]["text"] is None and got["x"]["lossy"] and not got["u"]["lossy"] and got["e"]["text"] == "" and got["z"]["text"] is None and not got["late"]["binary"]


def test_packages(spark):
    files = [("package.json", '{"name": "root-pkg"}'), ("a/Cargo.toml", "[package]\nname = \"crate\"\n"), ("a/package.json", '{"name": "js"}'), ("b/go.mod", "module ex/mod\n"), ("c/pyproject.toml", "[project]\nversion='1'\nname = 'py'\n"), ("d/setup.py", "x"), ("e/x.ts", "")]
    got = {r["root"]: (r["name"], r["kind"]) for r in workspace.discover(spark.createDataFrame(files, "path string, text string"), spark.createDataFrame([("c", "mine")], "root string, name string")).collect()}
    assert got == {"": ("root-pkg", "npm"), "a": ("js", "npm"), "b": ("ex/mod", "go"), "c": ("mine", "configured"), "d": ("d", "python")}
    dep = spark.createDataFrame([("a", "b"), ("b", "c"), ("c", "a"), ("d", "a")], "name string, dependency string")
    one = spark.createDataFrame([("a",)], "name string")
    assert rows(workspace.closure(dep, one)) == [("a", "b"), ("a", "c")] and rows(workspace.closure(dep, one, reverse=True)) == [("a", "b"), ("a", "c"), ("a", "d")]


# ---- store, fragments, evaluation


def test_staleness_and_units(spark):
    assert store.must_rebuild({"signature.a": "1"}, {"a": "1", "b": "1"}) == {"a": False, "b": True}
    meta = {"signature.a": "1"}
    with pytest.raises(RuntimeError), store.DirtyMark(meta):
        raise RuntimeError
    assert store.must_rebuild(meta, {"a": "1"}) == {"a": True}
    with store.DirtyMark(meta):
        pass
    assert "dirty" not in meta
    df = spark.createDataFrame([("p", 1, None), ("q", 2, "x")], "a string, b int, c string")
    one = store.fingerprint(df, ["a", "b", "c"]).first()[0]
    assert one == store.fingerprint(df.orderBy(F.desc("b")).repartition(3), ["a", "b", "c"]).first()[0] != store.fingerprint(df.limit(1), ["a", "b", "c"]).first()[0]
    assert store.fingerprint(df.limit(0), ["a", "b", "c"]).count() == 1
    assert store.find_symbols(df.withColumnRenamed("a", "kind"), kinds=[]).count() == 0


def test_fragments_of_a_small_tree(spark):
    paths = spark.createDataFrame([("pkgs/a/x.ts",), ("pkgs/b/y.ts",), ("lib/z.ts",), ("top.ts",), ("other/a/w.ts",)], "path string")
    roots = spark.createDataFrame([("pkgs/a",), ("pkgs/b",), ("other/a",), ("unused",), ("",)], "root string")
    assert rows(fragments.by_folder(paths, roots)) == [("b", "pkgs/b"), ("lib", "lib"), ("other-a", "other/a"), ("pkgs-a", "pkgs/a")]
    imports = spark.createDataFrame([("pkgs/a/x.ts", "lib/z.ts"), ("lib/z.ts", "pkgs/a/x.ts"), ("pkgs/b/y.ts", "other/a/w.ts"), ("top.ts", None)], "source_path string, to_ref string")
    got = dict(rows(fragments.by_imports(paths, imports)))
    assert got["pkgs/a/x.ts"] == got["lib/z.ts"] != got["pkgs/b/y.ts"] == got["other/a/w.ts"] and got["top.ts"] == "root"


def test_spread_and_queries(spark):
    df = spark.range(10).select(F.col("id").alias("i"))
    for k in (1, 3, 4, 7, 10, 20):
        assert [r[0] for r in evaluation.spread(df, k, ["i"]).orderBy("i").collect()] == ([j * 10 // k for j in range(k)] if k < 10 else list(range(10)))
    said = spark.range(1).select(evaluation.first_sentence(F.lit("/**\n * Reads the file. Then more.\n * @param x\n */"))).first()[0]
    assert said == "Reads the file"


# ---- pages, searches, maps


def test_pages_are_one_larger_page(spark):
    df = spark.range(25).select(F.col("id"), (F.col("id") % 7).alias("s"))
    order = [F.desc("s"), F.asc("id")]
    want = [r["id"] for r in df.orderBy(*order).collect()]
    got, cursor = [], None
    while True:
        p = paging.page(df, order, paging.window(10, cursor, "v1"), "v1")
        got += [r["id"] for r in p.rows.collect()]
        if not p.next_cursor:
            break
        assert p.total is None and p.reached
        cursor = p.next_cursor
    assert got == want and p.total == 25
    for bad in ("", "x", paging.encode_cursor(-1), paging.encode_cursor(3)):
        with pytest.raises(paging.BadCursor):
            paging.window(10, bad, "v2")
    with pytest.raises(ValueError):
        paging.window(0)


@pytest.mark.parametrize(
    ("text", "want"),
    [
        ("save user && //function", ("save user", "//function")), ("//function && save user", ("save user", "//function")), ("save WHERE //class//method", ("save", "//class//method")), ("save AND //function", ("save", "//function")), ("//a", (None, "//a")), ("a and b", ("a and b", None)), ("a && b", ("a && b", None)),
    ],
)
def test_conjunctions(text, want):
    assert search.split_conjunction(text) == want
    assert search.split_conjunction("x", path="//a") == ("x", "//a")


def test_lanes(spark):
    hits = lambda *keys: lambda: spark.createDataFrame([(i + 1, k, None) for i, k in enumerate(keys)], "pos int, key string, score double")

    def fails():
        raise RuntimeError("no model")

    f = search.fused_search([("a", 1.0, hits("x", "y")), ("b", 1.0, fails), ("c", 0.0, hits("z"))], ["a", "b", "c"])
    assert f.lanes == ["a"] and f.degraded == [("b", "no model")] and {r["key"] for r in f.rows.collect()} == {"x", "y"}
    for bad in ({"exclude": ("d",)}, {"weights": {"a": -1}}, {"exclude": ("a", "b")}):
        with pytest.raises(ValueError):
            search.fused_search([("a", 1.0, hits("x")), ("b", 1.0, hits("y"))], ["a", "b"], **bad)


def test_overlay_replaces_the_calls_of_indexed_files(spark):
    symbols = spark.createDataFrame([("a", 0, "a#f", "f", "function", 1, 5), ("a", 1, "a#f.g", "g", "function", 2, 3), ("b", 0, "b#T", "T", "class", 1, 9), ("c", 0, "c#h", "h", "function", 1, 2)], "path string, seq int, id string, base_name string, kind string, start_line int, end_line int")
    edges = spark.createDataFrame([("a#f", "guess", "calls:name", [1]), ("a", "b", "imports", [1]), ("c#h", "a#f", "calls", [1])], "source_path string, to_ref string, kind string, lines array<int>")
    defs = spark.createDataFrame([("S g", "a", 2, "g"), ("S T", "b", 1, "T"), ("local 1", "a", 1, "f")], "symbol string, path string, line int, name string")
    refs = spark.createDataFrame([("S g", "a", 4, None), ("S g", "a", 3, None), ("S T", "a", 1, None), ("S T", "a", 5, None), ("S T", "a", 9, None)], "symbol string, path string, line int, name string")
    got = graph.overlay(edges, defs, refs, symbols, spark.createDataFrame([("a", 1)], "path string, line int"))
    assert rows(got.select("source_path", "to_ref", "kind", F.array_join("lines", ","))) == sorted([("a", "b", "imports", "1"), ("a", "b#T", "references:type", "9"), ("a#f", "a#f.g", "calls", "4"), ("a#f", "b#T", "references:type", "5"), ("c#h", "a#f", "calls", "1")], key=repr)


# ---- cards


def count(t):
    return len(t.split())


def test_nothing_is_lost_in_packing():
    import random

    rng = random.Random(4)
    for _ in range(60):
        text = "".join(rng.choice(["word ", "Longer. ", "x\n\n", "tail! ", "\n", "Is it? "]) for _ in range(rng.randrange(60)))
        for room in (1, 3, 8):
            pieces = cards.fit(text, count, room)
            assert "".join(" ".join(pieces).split()) == "".join(text.split()) and all(count(p) <= room for p in pieces)
    texts = cards.pack_card("the head", ["one two three", "four five six seven eight nine ten", ""], count, 7)
    assert all(t.startswith("the head") and count(t) <= 7 for t in texts) and "".join(" ".join(texts).replace("the head", "").split()) == "onetwothreefourfivesixseveneightnineten"
    assert cards.fit("abcdef", len, 2) == ["ab", "cd", "ef"] and cards.pack_card("h", [], count, 9) == ["h"] and cards.pack_card("a b c", ["x"], count, 2) == ["a b", "c"]


def test_sections():
    md = "lead\n\n# A\ntext one\n\ntext two\n## B ##\n```\n# no heading\n\nstill\n```\n# C\n## B\nend"
    assert cards.sections(md, "md") == [([], ["lead"]), (["A"], ["text one", "text two"]), (["A", "B"], ["```\n# no heading\n\nstill\n```"]), (["C", "B"], ["end"])]
    assert cards.sections("Title\n=====\nbody\n\nSub\n---\nmore", "rst") == [(["Title"], ["body"]), (["Title", "Sub"], ["more"])]
    assert cards.sections("= T\nbody", "adoc") == [(["T"], ["body"])] and cards.sections("# x\ny", "txt") == [([], ["# x\ny"])] and cards.sections("", "md") == []


def test_cards_that_stand_twice_are_refused(spark):
    ok = spark.createDataFrame([("p", "k", "t", None, 1, 2), ("p", "k", "t", 2, 1, 2)], "path string, key string, text string, part int, start_line int, end_line int")
    assert rows(cards.completed(ok, "c").select("card_id")) == [("p#k",), ("p#k~2",)]
    for bad in (ok.unionByName(ok), ok.withColumn("text", F.lit(" ")), ok.withColumn("end_line", F.lit(0))):
        with pytest.raises(Exception, match="card p#k"):
            cards.completed(bad, "c").collect()


def test_routes(spark):
    t = spark.createDataFrame([("a.php", "Route::get('/u/{id}', X);\n$router->post('v', Y);"), ("b.js", "app.all('/w', f)\nrouter.get(`/x`, g)"), ("c.py", "@app.get(\"/y\")\n@bp.route('/z')"), ("d.py", None)], "path string, content string")
    r = cards.routes(t)
    assert rows(r.select("framework", "method", "route")) == [("express", "ANY", "/w"), ("express", "GET", "/x"), ("fastapi", "GET", "/y"), ("flask", "ANY", "/z"), ("laravel", "GET", "/u/{id}"), ("lumen", "POST", "v")]
    assert rows(cards.find_routes(r, "get", "/").select("route")) == [("/u/{id}",), ("/w",), ("/x",), ("/y",), ("/z",)]


# ---- patterns, policies, mappings, codecs


def test_values_cannot_add_tests():
    p = patterns.compile_pattern({"name": "p", "target": {"kind": "function", "name": "$n"}, "params": [{"name": "n", "required": True}, {"name": "unused"}]})
    q = p.bind(n='x"][@doc] or \\')
    from prism.operators import outline

    (step,) = outline.parse(q)
    assert len(step.tests) == 1 and step.tests[0].value == 'x"][@doc] or \\' and p.warnings == ["param: unused is never used"]
    for spec in ({"target": {"kind": "no"}}, {"target": {"kind": "custom"}}, {"target": {"kind": "class", "name": "$x"}}):
        with pytest.raises(patterns.PatternError):
            patterns.compile_pattern(spec)
    with pytest.raises(patterns.PatternError):
        p.bind()
    with pytest.raises(patterns.PatternError):
        p.bind(n="a", m="b")
    hard = patterns.Query.tag("class").where("name", "=", "a\\b\"c'd").text
    assert outline.parse(hard)[0].tests[0].value == "a\\b\"c'd"
    with pytest.raises(ValueError):
        patterns.Query.tag("x]//y")


GOOD = {"id": "r-one", "category": "injection", "severity": "high", "pattern": "abc+", "fixtures": {"attack": ["xabcc"], "benign": ["ab"]}}


@pytest.mark.parametrize(
    "change",
    [{"id": "Bad"}, {"category": "x"}, {"severity": "x"}, {"pattern": "("}, {"pattern": "(a+)+"}, {"pattern": "a*"}, {"flags": "x"}, {"flags": "ii"}, {"fixtures": {"attack": ["no"], "benign": ["ab"]}}, {"fixtures": {"attack": ["abc"], "benign": ["abc"]}}, {"fixtures": {"attack": [], "benign": ["x"]}}, {"more": 1}, {"replacement": 3}],
)
def test_policies_are_checked(change):
    policy.check_policy({"rules": [GOOD]}, "t")
    with pytest.raises(policy.PolicyError):
        policy.check_policy({"rules": [GOOD | change]}, "t")


def test_policies_merge():
    one = policy.check_policy({"rules": [GOOD], "actions": {"untrusted": {"r-one": "flag"}}}, "one")
    two = policy.check_policy({"actions": {"untrusted": {"r-one": "off"}}, "fallback": {"first-party": {"high": "sanitize"}}}, "two")
    merged, mark = policy.merge([one, two])
    rule = merged[-1]
    assert len(merged) == len(RULES) + 1 and (rule.light, rule.standard, rule.strict) == ("sanitize", "quarantine", "off") and mark != policy.merge([one])[1]
    for bad in ([one, one], [policy.check_policy({"actions": {"untrusted": {"none": "off"}}}, "x")]):
        with pytest.raises(policy.PolicyError):
            policy.merge(bad)
    for bad in ([], {"x": 1}, {"actions": {"who": {}}}, {"actions": {"untrusted": {"a": "burn"}}}, {"rules": [GOOD, GOOD]}):
        with pytest.raises(policy.PolicyError):
            policy.check_policy(bad, "x")


def test_mappings_are_deduced(spark):
    T = [
        ("class_declaration", 4, 2, {"program": 4}, {"program": 4}, {"name": 4, "body": 4}), ("function_definition", 6, 2, {"class_body": 6}, {"class_declaration": 6}, {"name": 6, "body": 6, "parameters": 6}), ("function_declaration", 5, 2, {"program": 4}, {"class_declaration": 1}, {"name": 5, "body": 5}),
        ("call_expression", 9, 2, {"block": 9}, {}, {"function": 9, "arguments": 9}), ("if_statement", 3, 1, {"block": 3}, {}, {"condition": 3}), ("import_statement", 3, 2, {"program": 3}, {}, {"source": 3}), ("import_specifier", 3, 2, {"import_statement": 3}, {}, {"name": 3}),
        ("arrow_function", 3, 1, {"block": 3}, {}, {"body": 3, "parameters": 3}), ("formal_parameter", 9, 2, {"x": 9}, {}, {"name": 9, "body": 9}), ("with_clause", 2, 1, {"with_statement": 2}, {}, {}), ("with_statement", 2, 1, {"block": 2}, {}, {"body": 2}), ("_hidden", 2, 1, {}, {}, {"name": 2, "body": 2}), ("type_item", 1, 1, {"program": 1}, {}, {"name": 1}),
    ]
    m = "map<string,long>"
    types = spark.createDataFrame(T, f"type string, count long, files long, parents {m}, ancestors {m}, fields {m}")
    d = trainer.deduce(types)
    assert {r["type"]: (r["tag"], r["role"]) for r in d.collect()} == {
        "class_declaration": ("class", "declaration"), "function_definition": ("method", "declaration"), "function_declaration": ("function", "declaration"), "call_expression": ("call", "call"), "if_statement": ("if", "control-flow"), "import_statement": ("import", "import"), "arrow_function": ("arrow", "anonymous-callable"),
        "with_statement": ("with", "control-flow"), "type_item": ("type", "declaration"),
    }
    base = spark.createDataFrame([("class_declaration", "kept"), ("block", "block")], "type string, tag string")
    got = {r["type"]: (r["tag"], r["how"]) for r in trainer.extend(base, d).collect()}
    assert got["class_declaration"] == ("kept", "base") and got["function_definition"] == ("method", "added") and got["call_expression"] == ("call", "skipped") and got["type_item"] == ("type", "skipped")
    assert {r["type"]: r["tag"] for r in trainer.with_tag_rules(d, spark.createDataFrame([("type_item", "alias")], "type string, tag string")).collect()}["type_item"] == "alias"


def test_outline_text():
    nodes = [(1, 3, None, "class", {"name": 'a"b\\c\n\t'}), (2, 2, 1, "method", {"name": "m"}), (3, 3, 1, "field", {}), (4, 4, None, "function", {})]
    for pretty in (False, True):
        assert codec.read_outline(codec.write_outline(nodes, pretty)) == nodes
    for bad in ("(a", "a", "(a))", '(a @x="1" @x="2")', '(a @x="\\q")', "()", "((a))", '(a (b) @x="1")'):
        with pytest.raises(codec.OutlineTextError):
            codec.read_outline(bad)
    assert codec.read_outline("") == [] and codec.write_outline([]) == ""


def _message(*fields):
    out = b""
    for n, v in fields:
        varint = lambda x: b"".join(bytes([(x >> s & 127) | (128 if x >> s + 7 else 0)]) for s in range(0, max(1, x.bit_length()), 7))
        out += varint(n << 3 | (0 if isinstance(v, int) else 2)) + (varint(v) if isinstance(v, int) else varint(len(v)) + v)
    return out


def test_a_compilers_index(spark):
    occ = lambda line, symbol, roles: _message((1, bytes([line, 0, 5])), (2, symbol.encode()), (3, roles))
    data = _message((1, b"meta"), (2, _message((1, b"a.ts"), (2, occ(4, "npm p 1 a.ts/Foo#bar().", 1)), (2, occ(9, "local 3", 0)), (4, b"typescript"))))
    got = codec.read_scip(spark.createDataFrame([(data,), (b"",), (None,)], "content binary"))
    assert rows(got) == [("a.ts", "local 3", "3", 10, False, False), ("a.ts", "npm p 1 a.ts/Foo#bar().", "bar", 5, True, False)]
    with pytest.raises(ValueError):
        list(codec.scip_occurrences(data[:-3]))


def test_a_fence_cannot_be_closed_from_within(spark):
    df = spark.createDataFrame([("a\n==== b\n===",), ("",), ("plain",)], "t string").select("t", codec.fenced(F.col("t")).alias("f"))
    for t, f in df.collect():
        mark = f.split(" ", 1)[0]
        assert f.endswith("\n" + mark) and mark not in t


# ---- telemetry


def test_samples_merge(spark):
    df = spark.range(1000).select(F.col("id"), (F.col("id") % 2).alias("g"))
    whole = {r["id"] for r in telemetry.even_sample(df, "id", 50).collect()}
    kept = telemetry.even_sample(df.where("id < 300"), "id", 50)
    kept = telemetry.keep_sample(kept, df.where("id between 200 and 699"), "id", 50)
    assert {r["id"] for r in telemetry.keep_sample(kept, df.where("id >= 700"), "id", 50).collect()} == whole and len(whole) == 50
    assert telemetry.even_sample(df, "id", 5, ["g"]).count() == 10 and 300 < sum(whole) / 50 < 700


def test_batches_go_once_a_day_also_on_a_stream(spark, tmp_path):
    assert telemetry.due(None, 5) and not telemetry.due(10, 20) and telemetry.due(10, 5) and telemetry.due(0, 86_400_000)
    h = 3_600_000
    times = [0, h, 5 * h, 25 * h, 26 * h, 60 * h]
    src = spark.createDataFrame([("k", t) for t in times] + [(None, 0)], "k string, ms long").select("k", F.timestamp_millis("ms").alias("ts"))
    want = [("k", 0, 1), ("k", 25 * h, 3), ("k", 60 * h, 2)]
    assert rows(telemetry.emitted(src, "k", "ts")) == rows(spark.createDataFrame(want, "k string, a long, n long"))
    src.coalesce(1).write.parquet(str(tmp_path / "in"))
    q = telemetry.emitted(spark.readStream.schema(src.schema).parquet(str(tmp_path / "in")), "k", "ts").writeStream.format("memory").queryName("sent").outputMode("append").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert rows(spark.table("sent")) == rows(spark.createDataFrame(want, "k string, a long, n long"))


def test_only_allowed_fields_pass(spark):
    props = [{"n": 3, "t": "ok.token", "f": True, "x": "gone"}, {"n": "3", "t": "no token", "f": "true"}, {"n": 1e9, "t": 5, "f": None}, {}]
    df = spark.createDataFrame([(i, json.dumps(p)) for i, p in enumerate(props)] + [(9, None), (10, "not json")], "i int, props string")
    got = {r["i"]: (r["n"], r["t"], r["f"]) for r in telemetry.scrubbed(df, {"n": 100, "t": "token", "f": "flag"}).collect()}
    none = (None, None, None)
    assert got == {0: (3.0, "ok.token", True), 1: none, 2: none, 3: none, 9: none, 10: none}


# ---- what is around them


def test_outlines_of_python(spark):
    from prism.operators import facts

    a = "class K:\n    def one(self, x: int, *a) -> str:\n        '''Doc.'''\n        return x + 1\n    def two(self): ...\n    def three(self): raise E\n    def four(self): return 3\ndef five(y, *a):\n    return y + 2\n"
    b = "class L:\n    def uno(self, zed: int, *q) -> str:\n        '''Other.'''\n        return zed + 9\n"
    t = spark.createDataFrame([("a.py", a), ("b.py", b), ("c.py", "def ("), ("d.ts", a)], "path string, content string")
    got = {r["name"]: r for r in facts.python_outlines(t).collect()}
    assert [got[n]["attrs"]["bodyKind"] for n in ("K.one", "K.two", "K.three", "K.four")] == ["real", "empty", "throw-only", "return-literal"]
    assert got["K.one"]["attrs"]["signature"] == "one(self, x: int, *a):str" and got["K.one"]["attrs"]["shape"] == got["L.uno"]["attrs"]["shape"] != got["five"]["attrs"]["shape"]
    assert (got["K"]["pre"], got["K"]["end_pre"], got["K.two"]["parent_pre"], got["K.one"]["tag"], got["five"]["tag"]) == (1, 5, 1, "method", "function")
    types = spark.createDataFrame([("t.py", "class A:\n    x: B\n    def f(self, p: 'C', q: D | None, r: Optional[E], s: list[F], u: G | H) -> I.J:\n        self.y: K = 1\n        z: L = 2\n")], "path string, content string")
    assert rows(facts.python_types(types).select("scope", "name", "type", "origin")) == sorted([("A", "x", "B", "variable"), ("A.f", "p", "C", "parameter"), ("A.f", "q", "D", "parameter"), ("A.f", "r", "E", "parameter"), ("A.f", "", "I.J", "return"), ("A", "y", "K", "property"), ("A.f", "z", "L", "variable")], key=repr)
    assert facts.component_of("src/my-card.vue") == "MyCard"


def test_packages_by_their_manifests(spark):
    from prism.operators import resolve

    m = json.dumps({"exports": {".": {"default": "./dist/main.js", "source": "./src/main.ts"}, "./utils/*": "./dist/utils/*.js", "./utils/deep/*": "./lib/deep/*.js", "./exact": "./exact.ts"}, "main": "old.js"})
    packages = spark.createDataFrame([("@w/a", "pkgs/a", m), ("b", "pkgs/b", "not json"), ("ab", "pkgs/ab", "{}")], "name string, root string, manifest string")
    t = spark.createDataFrame([("u.ts", "\n".join(f"import x from '{s}'" for s in ("@w/a", "@w/a/utils/one", "@w/a/utils/deep/two", "@w/a/exact", "@w/a/none", "b", "b/sub", "bc")))], "path string, content string")
    known = [("pkgs/a/src/main.ts",), ("pkgs/a/src/utils/one.ts",), ("pkgs/a/src/deep/two.ts",), ("pkgs/a/exact.ts",), ("pkgs/b/index.js",), ("pkgs/b/src/sub.ts",)]
    out = resolve.link_imports(resolve.imports(t), spark.createDataFrame(known, "path string"), packages=packages)
    assert {r["specifier"]: (r["kind"], r["to"]) for r in out.collect()} == {
        "@w/a": ("imports", "pkgs/a/src/main.ts"), "@w/a/utils/one": ("imports", "pkgs/a/src/utils/one.ts"), "@w/a/utils/deep/two": ("imports", "pkgs/a/src/deep/two.ts"), "@w/a/exact": ("imports", "pkgs/a/exact.ts"),
        "@w/a/none": ("imports:dangling", "@w/a/none"), "b": ("imports", "pkgs/b/index.js"), "b/sub": ("imports", "pkgs/b/src/sub.ts"), "bc": ("imports:external", "bc"),
    }


def test_hub_means_are_kept(spark, tmp_path):
    v = spark.createDataFrame([("a", [1.0, 0.0]), ("b", [0.6, 0.8]), ("c", [0.0, 1.0])], "id string, vector array<double>")
    one, fresh = search.hub_sync(v, str(tmp_path))
    assert fresh and {r["id"]: round(r["mean"], 6) for r in one.collect()} == {"a": 0.3, "b": 0.7, "c": 0.4}
    again, fresh = search.hub_sync(v.orderBy(F.desc("id")), str(tmp_path))
    assert not fresh and rows(again) == rows(one)
    assert search.hub_sync(v.limit(2), str(tmp_path))[1]


def test_a_listing_leaves_out_what_is_ignored(spark, tmp_path):
    for p, t in (("a.py", "x"), ("node/b.py", "y"), ("c.log", "z"), ("d/e.py", "12"), ("d/empty.py", "")):
        (tmp_path / p).parent.mkdir(exist_ok=True)
        (tmp_path / p).write_text(t)
    got = workspace.listing(spark, str(tmp_path), [("", workspace.ignore_rules("node/\n*.log"))])
    assert rows(got.select("path", "size")) == [("a.py", 1), ("d/e.py", 2)]


def test_streams_are_applied_once(spark, tmp_path):
    from prism.operators.incremental import IncrementalTarget
    from prism.streaming.ingest import ingest

    schema = "path string, digest string, seen timestamp"
    put = lambda n, *r: spark.createDataFrame([(p, d, f"2025-01-0{s} 00:00:00") for p, d, s in r], "path string, digest string, s string").select("path", "digest", F.to_timestamp("s").alias("seen")).coalesce(1).write.mode("append").parquet(str(tmp_path / "in" / n))
    target = IncrementalTarget(spark, str(tmp_path / "t"))
    go = lambda: ingest(spark.readStream.schema(schema).parquet(str(tmp_path / "in" / "*")), target, str(tmp_path / "cp"), "path", F.col("digest"), "seen").awaitTermination(120)
    put("1", ("a", "x", 1), ("b", "y", 1))
    go()
    put("2", ("a", "x", 2), ("b", "z", 2), ("b", "z", 2), ("b", "late", 1))
    go()
    go()
    assert rows(target.changes()) == [(0, "a", "x"), (0, "b", "y"), (1, "b", "z")]


def test_deadlines_and_configuration(spark):
    import time

    from prism.session import ConfigError, DeadlineError, deadline, read_config

    slow = F.udf(lambda x: time.sleep(3) or x, "long")
    with pytest.raises(DeadlineError), deadline(spark, 0.5):
        spark.range(40).select(slow("id")).collect()
    with deadline(spark, 60):
        assert spark.range(3).count() == 3
    assert read_config('{"fusionK": 30, "channels": {"docs": {"weight": 0.5}}, "search": {"minScore": 0.2}}')["fusionK"] == 30
    for bad in ("[", "[]", '{"x": 1}', '{"fusionK": -1}', '{"channels": {"a": {"weight": "1"}}}', '{"channels": {"a": 1}}', '{"search": {"other": 1}}', '{"include": [1]}'):
        with pytest.raises(ConfigError):
            read_config(bad)


def test_tokens(spark):
    import os

    from prism.functions.tokens import token_count

    file = "/opt/tokenizers/byte_bpe_50k.json"
    if not os.path.exists(file):
        pytest.skip("needs a tokenizer")
    got = [r[0] for r in spark.createDataFrame([("hello world",), ("",), (None,)], "t string").select(token_count(F.col("t"), file)).collect()]
    assert got[0] >= 2 and got[1] == 0 and got[2] in (None, -1)
