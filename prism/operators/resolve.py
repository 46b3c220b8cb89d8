"""From import statements to files: statements as written, and the ordered candidates each may stand for.

Candidates are not written out for every statement. Each indexed file offers the few keys under which it can be asked for
(itself, without its extension, as the index or the package of its folder), a statement asks for one or two keys, and
the order of the candidates is a number that comes with the match: one equi-join instead of twenty look-ups.
"""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prism.functions.text import directory

# Extensions of scripts in the order they are tried; what a compiled extension may have been written as;
# folders of build output; conditions of an exports map, the most useful first.
SCRIPTS = (".ts", ".tsx", ".js", ".jsx", ".mjs", ".cjs", ".mts", ".cts", ".json", ".vue")
WRITTEN_AS = {".js": (".ts", ".tsx"), ".jsx": (".tsx",), ".mjs": (".mts",), ".cjs": (".cts",)}
OUTPUT = ("dist", "build", "lib", "out", "esm", "cjs")
CONDITIONS = ("source", "types", "import", "module", "default", "require", "node")
# Modules of the runtime that are imported by a bare name.
RUNTIME = (
    "assert async_hooks buffer child_process cluster console constants crypto dgram diagnostics_channel dns domain events fs http http2 https inspector module net os path "
    "perf_hooks process punycode querystring readline repl stream string_decoder sys timers tls trace_events tty url util v8 vm wasi worker_threads zlib"
).split()


def imports(texts: DataFrame) -> DataFrame:
    """(path, seq, line, specifier, reexport, type_only, relative, names) of the import statements of ECMAScript and Python
    texts; repeated rows count once. line counts from 1; names are what a statement binds, as (imported, local).

    Texts are cut before each line that begins a statement, so the line of a statement is one more than the breaks before it.
    """
    t = texts.where("path is not null and content is not null").select("path", F.regexp_replace("content", r"\r\n?", "\n").alias("content")).distinct()
    ext = F.regexp_extract("path", r"\.(\w+)$", 1)
    script, python = ext.isin("js", "ts", "tsx", "jsx", "mjs", "cjs", "mts", "cts"), ext == "py"
    begin = F.when(script, r"(?m)(?=^[ \t]*(?:import|export)\b)").when(python, r"(?m)(?=^[ \t]*(?:from[ \t]+[.\w]|import[ \t]+\w))")
    parts = F.split("content", begin)
    breaks = F.transform(parts, lambda p: F.length(p) - F.length(F.replace(p, F.lit("\n"))))
    rows = t.where(script | python).select("path", python.alias("py"), F.posexplode(F.zip_with(parts, breaks, lambda p, b: F.struct(p.alias("s"), b.alias("b")))).alias("n", "x"))
    before = F.coalesce(F.sum("x.b").over(Window.partitionBy("path").orderBy("n").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    rows = rows.select("path", "py", "n", (before + 1).cast("int").alias("line"), F.col("x.s").alias("s"))
    js = F.regexp_extract("s", r"""^[ \t]*((?:import|export)\s+(?:[^'";]*?\s+from\s+)?['"][^'"\n]+['"])""", 1)
    py = F.regexp_extract("s", r"^[ \t]*((?:from[ \t]+\.*[\w.]*[ \t]+import[ \t]+(?:\([^)]*\)|[^\n#;]+))|(?:import[ \t]+[\w. \t,]+))", 1)
    rows = rows.withColumn("s", F.when(F.col("py"), py).otherwise(js)).where("s <> ''")
    # a statement `import a, b` of Python names several modules
    modules = F.when(F.col("py") & F.col("s").startswith("import"), F.split(F.regexp_replace("s", r"^import[ \t]+", ""), r"[ \t]*,[ \t]*")).otherwise(F.array(F.lit(None).cast("string")))
    rows = rows.select("*", F.posexplode(modules).alias("k", "module"))
    specifier = (
        F.when(F.col("module").isNotNull(), F.regexp_extract("module", r"^([\w.]+)", 1))
        .when(F.col("py"), F.regexp_extract("s", r"^from[ \t]+(\.*[\w.]*)", 1)).otherwise(F.regexp_extract("s", r"""['"]([^'"\n]+)['"]$""", 1))
    )
    rows = rows.where(specifier != "").select("path", "line", "py", "module", "s", specifier.alias("specifier"), F.row_number().over(Window.partitionBy("path").orderBy("n", "k")).alias("seq"))
    return rows.select("path", (F.col("seq") - 1).alias("seq"), "line", "specifier", (~F.col("py") & F.col("s").startswith("export")).alias("reexport"),
                       (~F.col("py") & F.col("s").rlike(r"^(?:import|export)\s+type\s+(?!from\b)")).alias("type_only"), F.col("specifier").startswith(".").alias("relative"), _names().alias("names"))


def _names() -> Column:
    """array<struct<imported, local>> that a statement binds; a module as a whole is imported as *."""
    one = lambda imported, local: F.struct(imported.alias("imported"), local.alias("local"))
    part = lambda text: F.filter(F.transform(F.split(text, ","), lambda p: F.regexp_replace(F.trim(F.translate(p, "\n\t()", "   ")), r"^type\s+(?=\w+\s*$|\w+\s+as\s)", "")), lambda p: p != "")
    listed = lambda text: F.transform(part(text), lambda p: one(F.regexp_extract(p, r"^([\w$*]+)", 1), F.coalesce(F.nullif(F.regexp_extract(p, r"\bas\s+([\w$]+)\s*$", 1), F.lit("")), F.regexp_extract(p, r"^([\w$*]+)", 1))))
    none = F.array().cast("array<struct<imported:string,local:string>>")
    head = F.regexp_replace(F.regexp_replace("s", r"^(?:import|export)\s+(?:type\s+(?!from\b))?", ""), r"""(?:\s*\bfrom\s+)?['"][^'"\n]+['"]$""", "")
    braces = F.regexp_extract(head, r"\{([^}]*)\}", 1)
    star = F.regexp_extract(head, r"\*(?:\s+as\s+([\w$]+))?", 1)
    default = F.regexp_extract(head, r"^([\w$]+)", 1)
    script = F.concat(
        F.when(default != "", F.array(one(F.lit("default"), default))).otherwise(none),
        F.when(head.contains("*"), F.array(one(F.lit("*"), F.coalesce(F.nullif(star, F.lit("")), F.lit("*"))))).otherwise(none),
        F.when(head.contains("{"), listed(braces)).otherwise(none),
    )
    renamed = F.regexp_extract("module", r"\bas\s+(\w+)", 1)
    module = F.array(one(F.lit("*"), F.coalesce(F.nullif(renamed, F.lit("")), F.substring_index("specifier", ".", 1))))
    return F.when(F.col("module").isNotNull(), module).when(F.col("py"), listed(F.regexp_replace("s", r"^from[ \t]+\.*[\w.]*[ \t]+import[ \t]+", ""))).otherwise(script)



def php_uses(texts: DataFrame) -> DataFrame:
    """The ``use`` statements of PHP texts, in the shape of ``imports``; the specifier is the name in full."""
    t = texts.where("path is not null and content is not null and path like '%.php'").select("path", F.regexp_replace("content", r"\r\n?", "\n").alias("content")).distinct()
    rows = t.select("path", F.posexplode(F.split("content", "\n")).alias("n", "s"))
    use = F.regexp_extract("s", r"^use\s+(?:function\s+|const\s+)?\\?([\w\\]+(?:\s+as\s+\w+)?)\s*;", 1)
    rows = rows.withColumn("u", use).where("u <> ''")
    name = F.regexp_extract("u", r"^([\w\\]+)", 1)
    base = F.substring_index(name, "\\", -1)
    local = F.coalesce(F.nullif(F.regexp_extract("u", r"\bas\s+(\w+)$", 1), F.lit("")), base)
    seq = F.row_number().over(Window.partitionBy("path").orderBy("n")) - 1
    return rows.select("path", seq.alias("seq"), (F.col("n") + 1).alias("line"), name.alias("specifier"), F.lit(False).alias("reexport"), F.lit(False).alias("type_only"), F.lit(False).alias("relative"), F.array(F.struct(base.alias("imported"), local.alias("local"))).alias("names"))


def normal(c: Column) -> Column:
    """A path without . and x/.. parts; null where it leads out of the root."""
    out = F.lit("\0")
    done = F.aggregate(
        F.filter(F.split(c, "/"), lambda p: ~p.isin("", ".")),
        F.array().cast("array<string>"),
        lambda acc, p: F.when((p == "..") & (F.size(acc) > 0) & (F.try_element_at(acc, F.lit(-1)) != out), F.slice(acc, 1, F.size(acc) - 1)).when(p == "..", F.array(out)).otherwise(F.array_append(acc, p)),
    )
    return F.when(~F.array_contains(done, out), F.array_join(done, "/"))


def extension(c: Column) -> Column:
    return F.regexp_extract(c, r"[^/](\.[^./]+)$", 1)


def offers(files: DataFrame) -> DataFrame:
    """(key, form, ord, ext, to): the keys under which each path can be asked for."""
    f = files.where("path is not null").select(F.col("path").alias("to")).distinct().withColumn("ext", extension(F.col("to")))
    stem = F.expr("substring(to, 1, length(to) - length(ext))")
    base = F.substring_index(stem, "/", -1)
    place = F.array_position(F.array(*[F.lit(e) for e in SCRIPTS]), F.col("ext")).cast("int")
    one = lambda key, form, order: F.struct(key.alias("key"), F.lit(form).alias("form"), order.alias("ord"))
    py = F.col("ext") == ".py"
    forms = F.array(
        one(F.col("to"), "exact", F.lit(0)),
        F.when(place > 0, one(stem, "added", place)),
        F.when((place > 0) & (base == "index"), one(directory(stem), "index", place)),
        F.when(py, one(stem, "module", F.lit(0))),
        F.when(py & (base == "__init__"), one(directory(stem), "package", F.lit(1))),
    )
    return f.select("to", "ext", F.explode(F.filter(forms, lambda x: x.isNotNull())).alias("x")).select("x.key", "x.form", "x.ord", "ext", "to")


def script_asks(asked: DataFrame, base: str) -> DataFrame:
    """``asked`` with what each script path may be: (key, want, given), one or two rows. The base itself, or, for a compiled
    extension, the sources it may have been written as."""
    ext = extension(F.col(base))
    compiled = F.create_map(*[x for e, w in WRITTEN_AS.items() for x in (F.lit(e), F.array(*[F.lit(v) for v in w]))])
    sources = F.try_element_at(compiled, ext)
    typed = F.col(base).endswith(".d.ts")
    plain = F.struct(F.col(base).alias("key"), F.lit("plain").alias("want"), ext.alias("given"), F.lit(None).cast("array<string>").alias("sources"))
    cut_off = F.expr(f"substring({base}, 1, length({base}) - length(regexp_extract({base}, '(\\\\.d)?\\\\.[^./]+$', 0)))")
    source = F.struct(cut_off.alias("key"), F.lit("source").alias("want"), ext.alias("given"), F.when(typed, F.array(F.lit(".ts"), F.lit(".tsx"))).otherwise(sources).alias("sources"))
    return asked.where(F.col(base).isNotNull()).select("*", F.explode(F.filter(F.array(plain, F.when(typed | sources.isNotNull(), source)), lambda x: x.isNotNull())).alias("ask")).select(*asked.columns, "ask.*")


def script_order() -> Column:
    """The place of a match (columns of offers and script_asks) among the candidates of a script path; null if it is none."""
    scripted = F.col("given").isin(*SCRIPTS)
    typed = F.col("key").endswith(".d.ts")
    return (
        F.when((F.col("want") == "source") & (F.col("form") == "added"), F.nullif(F.array_position("sources", F.col("ext")).cast("int"), F.lit(0)))
        .when(F.col("want") == "source", F.lit(None).cast("int"))
        .when(F.col("form") == "exact", F.when(typed, 0).otherwise(10))
        .when(~scripted & (F.col("form") == "added"), 20 + F.col("ord"))
        .when(~scripted & (F.col("form") == "index"), 40 + F.col("ord"))
    )


def first_match(asked: DataFrame, offered: DataFrame, keys: list[str], order: Column) -> DataFrame:
    """(keys, to, rank) of the first candidate of each asked row that exists."""
    hit = asked.join(offered, "key").withColumn("_o", order).where("_o is not null")
    return hit.groupBy(*keys).agg(F.min(F.struct("_o", "to")).alias("m")).select(*keys, F.col("m.to").alias("to"), F.col("m._o").alias("rank"))


def alias_targets(specifiers: DataFrame, rules: DataFrame) -> DataFrame:
    """``specifiers`` (config, specifier, ..) with (target, nth): what a path alias makes of each, the targets in their order.

    rules: (config, pattern, nth, target) with at most one * in pattern and target. An exact pattern wins; else, of those
    whose prefix and suffix enclose the specifier, the one with the longest prefix."""
    s = specifiers.join(rules.select("config", "pattern", "nth", F.col("target").alias("_t")), "config")
    spec, pre, post = F.col("specifier"), F.substring_index("pattern", "*", 1), F.substring_index("pattern", "*", -1)
    starred = F.instr("pattern", "*") > 0
    fits = F.when(starred, (F.length(spec) >= F.length(pre) + F.length(post)) & spec.startswith(pre) & spec.endswith(post)).otherwise(F.col("pattern") == spec)
    s = s.where(fits).withColumn("_l", F.when(starred, F.length(pre)).otherwise(1 << 30))
    best = F.max("_l").over(Window.partitionBy(*specifiers.columns))
    got = F.expr("substring(specifier, length(substring_index(pattern, '*', 1)) + 1, length(specifier) - length(pattern) + 1)")
    s = s.withColumn("_b", best).where("_l = _b")
    filled = F.when(starred, F.concat(F.substring_index("_t", "*", 1), F.when(F.instr("_t", "*") > 0, F.concat(got, F.expr("substring(_t, instr(_t, '*') + 1)"))).otherwise(""))).otherwise(F.col("_t"))
    return s.select(*specifiers.columns, filled.alias("target"), "nth")


def psr_candidates(names: DataFrame, rules: DataFrame) -> DataFrame:
    """``names`` (scope, specifier, ..) with (candidate, nth): the files that PSR-4 and PSR-0 rules give a class name, the
    longest prefix first. rules: (scope, prefix, folder, nth, psr0)."""
    clean = F.regexp_replace("specifier", r"^\\+", "")
    j = names.join(rules, "scope").withColumn("_s", clean).withColumn("_p", F.regexp_replace("prefix", r"\\+$", ""))
    slashed = F.translate("_s", "\\", "/")
    folder, last = F.when(F.instr(slashed, "/") > 0, F.regexp_extract(slashed, r"^(.*/)", 1)).otherwise(""), F.substring_index(slashed, "/", -1)
    inside = F.expr(r"translate(substring(_s, length(_p) + 2), '\\', '/')")
    sub = (
        F.when(F.col("psr0"), F.when((F.col("prefix") == "") | F.col("_s").startswith(F.col("prefix")), F.concat(folder, F.translate(last, "_", "/"))))
        .when(F.col("prefix") == "", slashed).when(F.col("_s") == F.col("_p"), F.translate("_p", "\\", "/")).when(F.col("_s").startswith(F.concat(F.col("_p"), F.lit("\\"))), inside)
    )
    c = j.withColumn("_c", sub).where("_c is not null")
    n = F.row_number().over(Window.partitionBy(*names.columns).orderBy(F.desc(F.length("prefix")), "nth", "folder"))
    return c.withColumn("_n", n).select(*names.columns, normal(F.concat_ws("/", "folder", F.concat("_c", F.lit(".php")))).alias("candidate"), F.col("_n").alias("nth"))


def link_imports(found: DataFrame, files: DataFrame, assets: DataFrame | None = None, scope_parts: int = 0, roots: DataFrame | None = None, aliases: DataFrame | None = None, psr: DataFrame | None = None, packages: DataFrame | None = None) -> DataFrame:
    """(path, seq, line, specifier, kind, to, names, members) of every statement of ``imports`` and ``php_uses``.

    files: the indexed (path); assets: (path) of other files that exist. scope_parts: how many leading parts of a path
    name its workspace (0: one workspace for all). roots: (root) of packages, whose folder and src folder are roots of Python and PHP
    modules besides those of the workspace. aliases: (config, pattern, nth, target), config being a folder that its rules hold
    for; psr: (scope, prefix, folder, nth, psr0); packages: (name, root, manifest) of the workspace, which come after aliases. members: what of the names are modules of their own.

    Kinds: imports, imports:type, imports:asset, imports:reexport, imports:external, imports:dangling. Nothing is dropped.
    """
    known = files.select("path").union(assets.select("path")) if assets is not None else files.select("path")
    offered = offers(known)
    scope = F.substring_index("path", "/", scope_parts) if scope_parts else F.lit("")
    rows = found.withColumn("scope", scope).withColumn("lang", F.when(F.col("path").endswith(".py"), "py").when(F.col("path").endswith(".php"), "php").otherwise("js"))
    key = ["path", "seq"]

    js = rows.where("lang = 'js'").withColumn("base", F.when(F.col("relative"), normal(F.concat_ws("/", directory(F.col("path")), "specifier"))))
    hits = [first_match(script_asks(js.where("relative").select(*key, "base"), "base"), offered, key, script_order())]
    if aliases is not None:
        folders = F.sequence(F.lit(0), F.size(F.split("path", "/")) - 1)
        ups = js.where("not relative").select(*key, "specifier", F.explode(F.transform(folders, lambda n: F.array_join(F.slice(F.split("path", "/"), 1, n), "/"))).alias("config"))
        near = ups.join(aliases.select("config").distinct(), "config", "left_semi").groupBy(*key, "specifier").agg(F.max_by("config", F.length("config")).alias("config"))
        t = alias_targets(near, aliases)
        through = script_asks(t.withColumn("base", normal(F.col("target"))).select(*key, "nth", "base"), "base")
        hits.append(first_match(through, offered, key, F.col("nth") * 100 + script_order()))
        aliased = t.select(*key).distinct().withColumn("aliased", F.lit(True))
    else:
        aliased = None

    if packages is not None:
        bare = js.where("not relative").select(*key, "specifier")
        if aliases is not None:
            bare = bare.join(hits[-1].select(*key), key, "left_anti")
        within = script_asks(package_bases(bare, packages), "base")
        hits.append(first_match(within, offered, key, F.col("nth") * 100 + script_order()))
        own = bare.join(packages.select(F.col("name").alias("_p")).distinct(), F.col("specifier").startswith(F.col("_p")) & ((F.length("specifier") == F.length("_p")) | (F.substr(F.col("specifier"), F.length("_p") + 1, F.lit(1)) == "/"))).select(*key).distinct().withColumn("aliased", F.lit(True))
        aliased = own if aliased is None else aliased.unionByName(own).distinct()

    py = rows.where("lang = 'py'")
    dots = F.length(F.regexp_extract("specifier", r"^(\.*)", 1))
    up = F.array_join(F.array_repeat(F.lit(".."), F.greatest(dots - 1, F.lit(0))), "/")
    module = F.translate(F.regexp_replace("specifier", r"^\.+", ""), ".", "/")
    at_root = F.array(F.lit(""), F.lit("src"))
    spots = py.select(*key, "scope", "relative", "names", module.alias("module"), F.when(F.col("relative"), F.array(F.concat_ws("/", directory(F.col("path")), up))).otherwise(F.transform(at_root, lambda r: F.concat_ws("/", "scope", r))).alias("tops"))
    if roots is not None:
        own = roots.where("root is not null").select("root").distinct()
        own = own.select(F.substring_index("root", "/", scope_parts).alias("scope") if scope_parts else F.lit("").alias("scope"), F.explode(F.array("root", F.concat("root", F.lit("/src")))).alias("r"))
        # packages of a workspace go with its statements as rows, ordered by name
        more = spots.where("not relative").join(own, "scope").select(*key, "names", "module", F.col("r").alias("top"), (2 + F.dense_rank().over(Window.partitionBy("scope").orderBy("r"))).alias("top_n"))
    places = spots.select(*key, "names", "module", F.posexplode("tops").alias("top_n", "top"))
    if roots is not None:
        places = places.unionByName(more.select(*places.columns))
    places = places.withColumn("key", normal(F.concat_ws("/", "top", "module")))
    of_module = first_match(places.select(*key, "key", "top_n"), offered.where("form in ('module', 'package')"), key, F.when((F.col("form") == "package") | (F.col("key") != ""), F.col("top_n") * 2 + F.col("ord")))
    inner = places.select(*key, "top_n", "key", F.posexplode("names.imported").alias("k", "imported")).where("imported <> '*'")
    inner = inner.select(*key, "top_n", "k", "imported", F.concat_ws("/", F.nullif("key", F.lit("")), "imported").alias("key"))
    m = inner.join(offered.where("form in ('module', 'package')"), "key").groupBy(*key, "imported").agg(F.min(F.struct("top_n", "ord", "k", "to")).alias("m"))
    members = m.groupBy(*key).agg(F.map_from_entries(F.collect_list(F.struct("imported", F.col("m.to").alias("to")))).alias("members"), F.min(F.struct("m.top_n", "m.k", F.col("m.to").alias("to")))["to"].alias("first_member"))
    hits.append(of_module)

    php = rows.where("lang = 'php'")
    slashed = F.translate(F.regexp_replace("specifier", r"^\\+", ""), "\\", "/")
    whole = F.concat(slashed, F.lit(".php"))
    less = F.when(F.instr(slashed, "/") > 0, F.expr("substring(p, instr(p, '/') + 1)")).otherwise(F.col("p"))
    lower = F.when(F.instr(slashed, "/") > 0, F.concat(F.lower(F.substring_index("p", "/", 1)), F.expr("substring(p, instr(p, '/'))"))).otherwise(F.col("p"))
    c = php.withColumn("p", whole)
    shapes = F.array(lower, F.concat(F.lit("src/"), less), F.concat(F.lit("app/"), less), F.col("p"), F.concat(F.lit("app/"), F.col("p")))
    asks = c.select(*key, F.posexplode(F.flatten(F.transform(at_root, lambda r: F.transform(shapes, lambda x: F.concat_ws("/", F.nullif("scope", F.lit("")), F.nullif(r, F.lit("")), x))))).alias("n", "key"))
    asks = asks.select(*key, (F.col("n") + 1_000_000).alias("n"), "key")
    if psr is not None:
        asks = asks.unionByName(psr_candidates(php.select(*key, "scope", "specifier"), psr).select(*key, F.col("nth").alias("n"), F.col("candidate").alias("key")))
    hits.append(first_match(asks, offered.where("form = 'exact'"), key, F.col("n")))

    every = hits[0].select(*key, "to")
    for h in hits[1:]:
        every = every.unionByName(h.select(*key, "to"))
    out = rows.join(every, key, "left").join(members, key, "left")
    out = out.join(aliased, key, "left") if aliased is not None else out.withColumn("aliased", F.lit(None).cast("boolean"))
    out = out.withColumn("to", F.coalesce("to", "first_member"))
    if assets is not None:
        out = out.join(files.select(F.col("path").alias("to")).distinct().withColumn("source", F.lit(True)), "to", "left")
    else:
        out = out.withColumn("source", F.lit(True))
    there = F.col("to").isNotNull()
    inward = F.col("relative") | F.coalesce("aliased", F.lit(False))
    kind = (
        F.when(there & F.col("reexport"), "imports:reexport").when(there & F.col("source").isNull(), "imports:asset").when(there & F.col("type_only"), "imports:type")
        .when(there, "imports").when(inward, "imports:dangling").otherwise("imports:external")
    )
    name = F.when(F.col("lang") == "py", F.substring_index("specifier", ".", 1)).when(F.col("specifier").startswith("@"), F.substring_index("specifier", "/", 2)).when(
        (F.col("lang") == "js") & ~F.col("specifier").startswith("/") & ~F.col("specifier").startswith("node:") & ~F.col("specifier").isin(*RUNTIME), F.substring_index("specifier", "/", 1)
    )
    ref = F.when(there, F.col("to")).when(inward, F.col("specifier")).otherwise(F.coalesce(name, "specifier"))
    return out.select("path", "seq", "line", "specifier", kind.alias("kind"), ref.alias("to"), "names", "members", "reexport", "lang")


def edges_of(linked: DataFrame) -> DataFrame:
    """(source_path, to_ref, kind, lines): one edge for each source, target and kind, with its distinct lines in order."""
    return linked.groupBy(F.col("path").alias("source_path"), F.col("to").alias("to_ref"), "kind").agg(F.array_sort(F.collect_set("line")).alias("lines"))


def _targets(value: object) -> list[str]:
    """Every path that a value of an exports map stands for, the conditions most useful for finding source first."""
    if isinstance(value, str):
        return [value]
    if isinstance(value, list):
        return [t for v in value for t in _targets(v)]
    if isinstance(value, dict):
        keys = sorted(value, key=lambda k: CONDITIONS.index(k) if k in CONDITIONS else len(CONDITIONS))
        return [t for k in keys for t in _targets(value[k])]
    return []


def entries_of(manifest: str | None) -> list[tuple[str, str]]:
    """(key, target) of a package.json in order: "." for the package itself, ./sub or a pattern with one * for what is within."""
    try:
        m = json.loads(manifest or "")
    except ValueError:
        return []
    if not isinstance(m, dict):
        return []
    exports = m.get("exports")
    inner = isinstance(exports, dict) and any(k.startswith(".") for k in exports)
    out = [(k, t) for k, v in exports.items() for t in _targets(v)] if inner else [(".", t) for t in _targets(exports)]
    return out + [(".", m[k]) for k in ("source", "module", "main", "types", "typings") if isinstance(m.get(k), str)]


def package_bases(asked: DataFrame, packages: DataFrame) -> DataFrame:
    """``asked`` (specifier, ..) with (base, nth) for each path that a workspace package says a bare specifier may be, build output traced
    back to src. packages: (name, root, manifest: JSON text). An exact entry wins over patterns, of which the longest prefix counts;
    what no entry names is looked for below the root and its src."""
    entries = F.udf(entries_of, "array<struct<key:string,target:string>>")
    scoped = F.col("specifier").startswith("@")
    name = F.when(scoped, F.substring_index("specifier", "/", 2)).otherwise(F.substring_index("specifier", "/", 1))
    a = asked.withColumn("_name", name).withColumn("_sub", F.expr("substring(specifier, length(_name) + 2)"))
    first = packages.groupBy(F.col("name").alias("_name")).agg(F.min(F.struct("root", "manifest")).alias("p"))
    j = a.join(first, "_name").withColumn("_key", F.when(F.col("_sub") == "", ".").otherwise(F.concat(F.lit("./"), "_sub"))).withColumn("_e", entries("p.manifest"))

    def fits(e: Column) -> Column:
        pre, post = F.substring_index(e["key"], "*", 1), F.substring_index(e["key"], "*", -1)
        return F.when(e["key"].contains("*"), (F.length("_key") >= F.length(pre) + F.length(post)) & F.startswith(F.col("_key"), pre) & F.endswith(F.col("_key"), post)).otherwise(e["key"] == F.col("_key"))

    j = j.withColumn("_e", F.filter("_e", fits))
    rank = lambda e: F.when(e["key"].contains("*"), F.length(F.substring_index(e["key"], "*", 1))).otherwise(1 << 20)
    j = j.withColumn("_best", F.array_max(F.transform("_e", rank))).withColumn("_e", F.filter("_e", lambda e: rank(e) == F.col("_best")))
    caught = lambda e: F.substr(F.col("_key"), F.length(F.substring_index(e["key"], "*", 1)) + 1, F.length("_key") - F.length(e["key"]) + 1)
    filled = F.transform("_e", lambda e: F.when(e["key"].contains("*"), F.replace(e["target"], F.lit("*"), caught(e))).otherwise(e["target"]))
    own = F.when(F.col("_sub") == "", F.concat(filled, F.array(F.lit("index"), F.lit("src/index")))).when(F.size("_e") > 0, filled).otherwise(F.array(F.col("_sub"), F.concat(F.lit("src/"), "_sub")))
    j = j.withColumn("_t", F.transform(own, lambda t: F.regexp_replace(t, r"^\./", "")))
    inside = F.regexp_replace("_x", r"^[^/]+/", "")
    j = j.select(*asked.columns, F.col("p.root").alias("_root"), F.posexplode("_t").alias("_n", "_x"))
    built = F.substring_index("_x", "/", 1).isin(*OUTPUT) & F.col("_x").contains("/")
    forms = F.when(built, F.array(F.concat(F.lit("src/"), inside), inside, F.col("_x"))).otherwise(F.array("_x"))
    k = j.select(*asked.columns, "_root", "_n", F.posexplode(forms).alias("_m", "_f"))
    return k.select(*asked.columns, normal(F.concat_ws("/", F.nullif("_root", F.lit("")), "_f")).alias("base"), (F.col("_n") * 3 + F.col("_m")).alias("nth"))
