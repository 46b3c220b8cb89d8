"""Calls to symbols: a cascade of joins, each stage of which settles what the one before left open.

A call ends as one of: a symbol (found through scope, imports or the enclosing class; inferred where a type had to be
read), guesses by name among what the file can see, something outside, or unresolved with a reason. Nothing is dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prism.session import cut

# Why a call stays unresolved.
EXPRESSION = "receiver is an expression"
PARAMETER = "a parameter of the enclosing function"
LOST_IMPORT = "the import does not resolve"
MODULE = "a module is not callable"
NOT_DEFINED = "the imported name is not defined in the module"
NOT_DECLARED = "not declared here or imported"
NO_CLASS = "self used outside a class"
NOT_MEMBER = "not a member of the class (inherited or dynamic)"
NOT_IMPORTED_MEMBER = "not a member of the imported class (inherited or dynamic)"
NOT_EXPORTED = "not exported by the imported module"
NOT_REACHABLE = "receiver type unknown, no method of that name reachable by imports"
# Kinds that hold members; names that the runtime of a language provides.
CONTAINERS = ("class", "interface", "trait", "enum")
SCRIPT_GLOBALS = (
    "Object Function Array String Number Boolean Symbol BigInt Math JSON Date RegExp Error TypeError RangeError SyntaxError ReferenceError EvalError URIError AggregateError "
    "Promise Map Set WeakMap WeakSet WeakRef FinalizationRegistry Proxy Reflect Atomics Intl ArrayBuffer SharedArrayBuffer DataView Int8Array Uint8Array Uint8ClampedArray Int16Array "
    "Uint16Array Int32Array Uint32Array Float32Array Float64Array BigInt64Array BigUint64Array parseInt parseFloat isNaN isFinite encodeURIComponent decodeURIComponent encodeURI decodeURI "
    "eval globalThis console setTimeout clearTimeout setInterval clearInterval setImmediate clearImmediate queueMicrotask structuredClone fetch Request Response Headers URL "
    "URLSearchParams AbortController AbortSignal TextEncoder TextDecoder Blob FormData WebSocket Event EventTarget performance crypto atob btoa process Buffer Bun Deno window document "
    "navigator localStorage sessionStorage"
).split()
PYTHON_BUILTINS = (
    "abs aiter all anext any ascii bin bool breakpoint bytearray bytes callable chr classmethod compile complex delattr dict dir divmod enumerate eval exec filter float format frozenset "
    "getattr globals hasattr hash help hex id input int isinstance issubclass iter len list locals map max memoryview min next object oct open ord pow print property range repr reversed round "
    "set setattr slice sorted staticmethod str sum super tuple type vars zip BaseException Exception ArithmeticError AssertionError AttributeError EOFError ImportError "
    "IndexError KeyError KeyboardInterrupt LookupError MemoryError NameError NotImplementedError OSError OverflowError RecursionError RuntimeError StopIteration SyntaxError SystemExit "
    "TypeError ValueError ZeroDivisionError FileNotFoundError PermissionError TimeoutError ConnectionError"
).split()


def is_builtin(path: Column, name: Column) -> Column:
    py = path.endswith(".py")
    return F.when(py, name.isin(*PYTHON_BUILTINS)).when(path.endswith(".php"), False).otherwise(name.isin(*SCRIPT_GLOBALS))


class Symbols:
    """What linking asks of the symbols of all files, each table made once."""

    def __init__(self, symbols: DataFrame, linked: DataFrame, exports: DataFrame):
        own = symbols.withColumn("container", F.col("kind").isin(*CONTAINERS))
        self.all = cut(own.select("path", "seq", "id", "name", "base_name", "kind", "parent_id", "exported", "start_line", "params", "alias_of", "container").dropDuplicates(["path", "id"]))
        self.linked = cut(linked)
        self.parents = cut(self._ancestors())
        last = lambda: F.max_by("id", F.struct("seq", "id"))
        self.by_name = cut(self.all.groupBy("path", "name").agg(last().alias("id")))
        self.exported = cut(self._exported(exports, last))

    def _ancestors(self) -> DataFrame:
        """(id, up, depth): each symbol and what encloses it, itself at depth 0."""
        ups = self.all.select("id", "parent_id").where("parent_id is not null")
        seen = now = self.all.select("id", F.col("id").alias("up"), F.lit(0).alias("depth"))
        depth = 0
        while True:
            depth += 1
            now = cut(now.join(ups.select(F.col("id").alias("up"), "parent_id"), "up").select("id", F.col("parent_id").alias("up"), F.lit(depth).alias("depth")).join(seen.select("id", "up"), ["id", "up"], "left_anti"))
            if not now.limit(1).count():
                return seen
            seen = seen.unionByName(now)

    def _exported(self, exports: DataFrame, last) -> DataFrame:
        """(path, name, id): what each file exports, through lists and re-exports, to a fixed point. A name that is settled stays; of
        several re-exports that would settle it in a round the first statement does. Cycles end as nothing new comes."""
        top = self.all.where("parent_id is null")
        found = cut(top.where("exported is null or exported <> 0").groupBy("path", F.col("base_name").alias("name")).agg(last().alias("id")))
        listed = exports.join(top.groupBy("path", F.col("base_name").alias("local")).agg(F.min_by("id", F.struct("seq", "id")).alias("id")), ["path", "local"]).select("path", "name", "id")
        found = cut(found.unionByName(listed.groupBy("path", "name").agg(F.min("id").alias("id")).join(found, ["path", "name"], "left_anti")))
        inside = self.linked.where("kind in ('imports', 'imports:type', 'imports:reexport')")
        passed = inside.where("reexport or lang = 'py'").select("path", "seq", F.col("to").alias("file"), F.explode("names").alias("n")).select("path", "seq", "file", "n.imported", F.col("n.local").alias("name"))
        # a name that is imported and then listed is passed on too
        through = inside.where("not reexport").select("path", "seq", F.col("to").alias("file"), F.explode("names").alias("n")).select("path", "seq", "file", "n.imported", F.col("n.local").alias("local"))
        passed = cut(passed.unionByName(through.where("imported <> '*'").join(exports, ["path", "local"]).select("path", "seq", "file", "imported", "name")))
        while True:
            f = found.select(F.col("path").alias("file"), F.col("name").alias("got"), "id")
            named = passed.where("imported <> '*'").join(f, (passed["file"] == f["file"]) & (F.col("imported") == F.col("got"))).select("path", "seq", "name", "id")
            star = passed.where("imported = '*' and name = '*'").join(f, passed["file"] == f["file"]).where("got <> 'default'").select("path", "seq", F.col("got").alias("name"), "id")
            new = named.unionByName(star).groupBy("path", "name").agg(F.min_by("id", F.struct("seq", "id")).alias("id")).join(found, ["path", "name"], "left_anti")
            new = cut(new)
            if not new.limit(1).count():
                return found
            found = cut(found.unionByName(new))


def _settled(rows: DataFrame, outcome: str, to: Column, reason: Column | None = None) -> DataFrame:
    return rows.select("path", "seq", F.lit(outcome).alias("outcome"), to.alias("to"), (F.lit(None).cast("string") if reason is None else reason).alias("reason"))


def link_calls(calls: DataFrame, symbols: DataFrame, linked: DataFrame, exports: DataFrame) -> DataFrame:
    """(path, seq, outcome, to, reason) of every call, one row for each target. outcome: symbol, name, external, unresolved.

    calls: facts.call_sites; symbols: (path, seq, id, name, base_name, kind, parent_id, exported, start_line, params, alias_of);
    linked: resolve.link_imports; exports: facts.exports_of. Types of variables and of results are not followed: such receivers
    are settled by name, or unresolved."""
    s = Symbols(symbols, linked, exports)
    key = ["path", "seq"]
    calls = cut(calls)
    none = calls.where("receiver_kind is null")
    done = [_settled(calls.where("receiver_kind = 'complex' or name is null"), "unresolved", F.col("name"), F.lit(EXPRESSION))]

    # the class around a caller
    held = s.parents.join(s.all.where("container").select(F.col("id").alias("up"), F.col("name").alias("class_name")), "up").groupBy("id").agg(F.min(F.struct("depth", F.col("up").alias("class_id"), "class_name")).alias("c"))
    classes = cut(held.select(F.col("id").alias("caller"), "c.class_id", "c.class_name"))

    # bare names: what the nearest enclosing function declares, hidden by its parameters, else the top level
    scopes = none.join(s.parents.select(F.col("id").alias("caller"), "up", "depth"), "caller").join(s.all.select(F.col("id").alias("up"), "container", "params"), "up").where("not container")
    candidates = s.all.where("kind <> 'method'").select("path", F.col("base_name").alias("name"), "parent_id", F.col("id").alias("found"), "start_line", F.col("seq").alias("s_seq"))
    inside = scopes.join(candidates, ["path", "name"]).where("parent_id = up").select(*key, "line", "depth", "found", "start_line", "s_seq")
    top = none.join(candidates.where("parent_id is null"), ["path", "name"]).select(*key, "line", F.lit(1 << 30).alias("depth"), "found", "start_line", "s_seq")
    above = F.col("start_line") <= F.col("line")
    place = F.struct(F.when(above, 0).otherwise(1).alias("a"), F.when(above, -F.col("start_line")).otherwise(F.col("s_seq")).alias("b"), F.when(above, -F.col("s_seq")).otherwise(0).alias("c"), "found")
    declared = inside.unionByName(top).groupBy(*key, "depth").agg(F.min(place)["found"].alias("found")).withColumn("p", F.lit(0))
    hidden = scopes.where(F.array_contains(F.regexp_extract_all("params", F.lit(r"([\p{L}_$][\p{L}\p{N}_$]*)"), F.lit(1)), F.col("name"))).select(*key, "depth", F.lit(None).cast("string").alias("found"), F.lit(1).alias("p"))
    lexical = cut(declared.unionByName(hidden).groupBy(*key).agg(F.min(F.struct("depth", "p", "found")).alias("m")).select(*key, "m.p", "m.found"))
    done.append(_settled(lexical.where("p = 0"), "symbol", F.col("found")))
    done.append(_settled(calls.join(lexical.where("p = 1"), key, "left_semi"), "unresolved", F.col("name"), F.lit(PARAMETER)))
    none = none.join(lexical, key, "left_anti")

    # names that an import binds; the last statement that binds one counts
    bound = s.linked.where("not reexport").select("path", F.col("seq").alias("i_seq"), "specifier", F.col("kind").alias("i_kind"), F.col("to").alias("file"), "members", "lang", F.explode("names").alias("n"))
    bound = bound.select("path", "i_seq", "specifier", "i_kind", "file", "members", "lang", "n.imported", "n.local").where("local <> '*' and not (lang = 'py' and imported = '*' and specifier like '%.%' and local = substring_index(specifier, '.', 1))")
    last = bound.groupBy("path", "local").agg(F.max_by(F.struct("i_kind", "file", "imported", "members"), F.struct("i_seq", "imported")).alias("b")).select("path", "local", "b.i_kind", "b.file", "b.imported", "b.members")
    bound = cut(last)
    outside = F.col("i_kind") == "imports:external"
    lost = F.col("i_kind") == "imports:dangling"

    got = cut(none.join(bound.withColumnRenamed("local", "name"), ["path", "name"]))
    done.append(_settled(got.where(outside), "external", F.concat_ws("#", "file", "imported")))
    done.append(_settled(got.where(lost), "unresolved", F.col("name"), F.lit(LOST_IMPORT)))
    here = got.where(~outside & ~lost)
    done.append(_settled(here.where("imported = '*'"), "unresolved", F.col("name"), F.lit(MODULE)))
    meant = _imported(here.where("imported <> '*'").select(*key, "name", "file", "imported", F.col("name").alias("local")), s)
    done.append(_settled(meant.where("target is not null"), "symbol", F.col("target")))
    done.append(_settled(meant.where("target is null"), "unresolved", F.col("name"), F.lit(NOT_DEFINED)))
    none = none.join(got, key, "left_anti")
    built = is_builtin(F.col("path"), F.col("name"))
    done.append(_settled(none.where(built), "external", F.concat(F.lit("global#"), "name")))
    none = none.where(~built)
    # PHP: a class that nothing here names, by its base name where it is the only one
    fresh = none.where("kind = 'new' and path like '%.php'")
    only = s.all.where("container and parent_id is null").groupBy(F.col("base_name").alias("name")).agg(F.count("*").alias("n"), F.min("id").alias("target")).where("n = 1")
    single = cut(fresh.join(only, "name").select(*key, "target"))
    done.append(_settled(single, "name", F.col("target")))
    done.append(_settled(none.join(single, key, "left_anti"), "unresolved", F.col("name"), F.lit(NOT_DECLARED)))

    # self
    me = calls.where("receiver_kind = 'self' and name is not null").join(classes, "caller", "left")
    done.append(_settled(me.where("class_id is null"), "unresolved", F.col("name"), F.lit(NO_CLASS)))
    mine = me.where("class_id is not null").withColumn("full", F.concat_ws(".", "class_name", F.col("name"))).join(s.by_name.select("path", F.col("name").alias("full"), F.col("id").alias("target")), ["path", "full"], "left")
    done.append(_settled(mine.where("target is not null"), "symbol", F.col("target")))
    done.append(_settled(mine.where("target is null"), "unresolved", F.col("name"), F.lit(NOT_MEMBER)))

    # a named receiver: a module by its full name, what an import binds, the runtime, a class of the file, a guess
    named = calls.where("receiver_kind = 'name' and name is not null").withColumn("first", F.substring_index("receiver", ".", 1)).withColumn("rest", F.when(F.instr("receiver", ".") > 0, F.expr("substring(receiver, instr(receiver, '.') + 1)")))
    modules = s.linked.where("lang = 'py' and not reexport").groupBy("path", F.col("specifier").alias("receiver")).agg(F.max(F.struct("seq", F.col("kind").alias("i_kind"), F.col("to").alias("file"))).alias("b")).select("path", "receiver", "b.i_kind", "b.file", F.lit("*").alias("imported"), F.lit(None).cast("map<string,string>").alias("members"))
    whole = cut(named.join(modules, ["path", "receiver"]).withColumn("rest", F.lit(None).cast("string")))
    named = named.join(whole, key, "left_anti")
    by_first = cut(named.join(bound.withColumnRenamed("local", "first"), ["path", "first"]))
    named = named.join(by_first, key, "left_anti")
    via = cut(whole.select(*key, "caller", "name", "first", "rest", "i_kind", "file", "imported", "members").unionByName(by_first.select(*key, "caller", "name", "first", "rest", "i_kind", "file", "imported", "members")))
    done.append(_settled(via.where(outside), "external", F.concat(F.col("file"), F.lit("#"), F.concat_ws(".", F.nullif("imported", F.lit("*")), "rest", "name"))))
    done.append(_settled(via.where(lost), "unresolved", F.col("name"), F.lit(LOST_IMPORT)))
    here = via.where(~outside & ~lost)
    stars = here.where("imported = '*'").select(*key, "name", "file", "rest")
    meant = _imported(here.where("imported <> '*'").select(*key, "name", "file", "imported", F.col("first").alias("local"), "rest", "members", "caller"), s)
    sub = meant.where("target is null").withColumn("sub", F.try_element_at("members", F.col("imported")))
    done.append(_settled(sub.where("sub is null"), "unresolved", F.col("name"), F.lit(NOT_DEFINED)))
    done.append(_in_file(stars.unionByName(sub.where("sub is not null").select(*key, "name", F.col("sub").alias("file"), "rest")), s))
    known = meant.where("target is not null").join(s.all.select(F.col("id").alias("target"), F.col("path").alias("t_path"), F.col("name").alias("t_name"), "container"), "target")
    members = known.where("container").withColumn("full", F.concat_ws(".", "t_name", "rest", "name")).join(s.by_name.select(F.col("path").alias("t_path"), F.col("name").alias("full"), F.col("id").alias("member")), ["t_path", "full"], "left")
    done.append(_settled(members.where("member is not null"), "symbol", F.col("member")))
    done.append(_settled(members.where("member is null"), "unresolved", F.col("name"), F.lit(NOT_IMPORTED_MEMBER)))
    guesses = [known.where("not container").select(*key, "name", F.lit(None).cast("string").alias("not_in"))]

    runtime = is_builtin(F.col("path"), F.col("first"))
    done.append(_settled(named.where(runtime), "external", F.concat(F.lit("global#"), F.concat_ws(".", "receiver", "name"))))
    named = named.where(~runtime)
    local = s.all.where("container").select("path", F.col("name").alias("receiver")).distinct()
    own = named.join(local, ["path", "receiver"], "left_semi").withColumn("full", F.concat_ws(".", "receiver", "name")).join(s.by_name.select("path", F.col("name").alias("full"), F.col("id").alias("target")), ["path", "full"])
    own = cut(own.select(*key, "target"))
    done.append(_settled(own, "symbol", F.col("target")))
    named = named.join(own, key, "left_anti").join(classes, "caller", "left")
    guesses.append(named.select(*key, "name", F.when(F.col("first").isin("this", "self", "cls"), F.col("class_id")).alias("not_in")))
    done.append(_guessed(cut(reduce(DataFrame.unionByName, guesses)), s))

    out = cut(reduce(DataFrame.unionByName, done))
    # a name that is only another name is a call to what that is
    return out.where("outcome <> 'symbol'").unionByName(_followed(out.where("outcome = 'symbol'"), s)).distinct()


def _imported(rows: DataFrame, s: Symbols) -> DataFrame:
    """``rows`` (file, imported, local) with the target that an import brings in. A default is what the importer calls it, or the
    only thing that the file exports."""
    e = s.exported
    asked = rows.withColumn("want", F.when(F.col("imported") == "default", F.col("local")).otherwise(F.col("imported")))
    one = e.groupBy(F.col("path").alias("file")).agg(F.count("*").alias("n"), F.min("id").alias("only")).where("n = 1").drop("n")
    named = e.where("name = 'default'").select(F.col("path").alias("file"), F.col("id").alias("default_id"))
    j = asked.join(e.select(F.col("path").alias("file"), F.col("name").alias("want"), F.col("id").alias("t")), ["file", "want"], "left").join(one, "file", "left").join(named, "file", "left")
    return cut(j.withColumn("target", F.coalesce("t", F.when(F.col("imported") == "default", F.coalesce("default_id", "only")))).drop("t", "only", "default_id", "want"))


def _in_file(rows: DataFrame, s: Symbols) -> DataFrame:
    """A name in a module, or through a class of it (rest)."""
    e = s.exported.select(F.col("path").alias("file"), F.col("name").alias("want"), F.col("id").alias("target"))
    rows = cut(rows)
    plain = rows.where("rest is null").withColumn("want", F.col("name")).join(e, ["file", "want"], "left")
    deep = rows.where("rest is not null").withColumn("want", F.substring_index("rest", ".", 1)).withColumn("tail", F.when(F.instr("rest", ".") > 0, F.expr("substring(rest, instr(rest, '.') + 1)"))).join(e, ["file", "want"], "left")
    owner = deep.where("target is not null").join(s.all.select(F.col("id").alias("target"), F.col("path").alias("t_path"), F.col("name").alias("t_name")), "target").withColumn("full", F.concat_ws(".", "t_name", "tail", "name"))
    owner = owner.join(s.by_name.select(F.col("path").alias("t_path"), F.col("name").alias("full"), F.col("id").alias("member")), ["t_path", "full"], "left")
    missing = F.lit(NOT_EXPORTED)
    return reduce(DataFrame.unionByName, [
        _settled(plain.where("target is not null"), "symbol", F.col("target")), _settled(plain.where("target is null"), "unresolved", F.col("name"), missing), _settled(deep.where("target is null"), "unresolved", F.col("name"), missing),
        _settled(owner.where("member is not null"), "symbol", F.col("member")), _settled(owner.where("member is null"), "unresolved", F.col("name"), F.lit(NOT_IMPORTED_MEMBER)),
    ])


def _guessed(rows: DataFrame, s: Symbols) -> DataFrame:
    """Members of the name in the file, else all at the least import distance at which any file has one; not of the class not_in.
    Files go outwards level by level, for files with open names alone."""
    members = s.all.where("parent_id is not null").select("path", F.col("base_name").alias("name"), "parent_id", F.col("id").alias("target"))
    other = F.col("not_in").isNull() | (F.col("parent_id") != F.col("not_in"))
    own = cut(rows.join(members, ["path", "name"]).where(other).select("path", "seq", "target"))
    rest = cut(rows.join(own, ["path", "seq"], "left_anti"))
    # what other files can reach: members under a top level that is exported
    tops = s.parents.join(s.all.where("parent_id is null and (exported is null or exported <> 0)").select(F.col("id").alias("up")), "up", "left_semi").select(F.col("id").alias("target"))
    reachable = cut(members.join(tops, "target", "left_semi").withColumnRenamed("path", "file"))
    inside = s.linked.where("kind in ('imports', 'imports:type', 'imports:reexport')")
    links = inside.select("path", F.col("to").alias("file")).union(inside.where("members is not null").select("path", F.explode(F.map_values("members")).alias("file"))).distinct()
    links = cut(links)
    open_ = cut(rest.select("path", "name").distinct())
    seen = cut(open_.select("path").distinct().select("path", F.col("path").alias("file")))
    front, hits = seen, []
    while True:
        front = cut(front.join(links.select(F.col("path").alias("file"), F.col("file").alias("next")), "file").select("path", F.col("next").alias("file")).distinct().join(seen, ["path", "file"], "left_anti"))
        if not front.limit(1).count():
            break
        seen = cut(seen.unionByName(front))
        hit = cut(open_.join(front, "path").join(reachable, ["file", "name"]).select("path", "name", "target", "parent_id"))
        hits.append(hit)
        open_ = cut(open_.join(hit, ["path", "name"], "left_anti"))
        front = front.join(open_.select("path").distinct(), "path", "left_semi")
    near = rest.join(reduce(DataFrame.unionByName, hits), ["path", "name"]).where(other).select("path", "seq", "target") if hits else own.limit(0)
    near = cut(near)
    lost = rest.join(near, ["path", "seq"], "left_anti")
    return _settled(own.unionByName(near), "name", F.col("target")).unionByName(_settled(lost, "unresolved", F.col("name"), F.lit(NOT_REACHABLE)))


def _followed(found: DataFrame, s: Symbols) -> DataFrame:
    """Targets that are aliases replaced by what they end at, in the file that declares them; a chain that closes ends there."""
    step = s.all.where("alias_of is not null").select(F.col("id").alias("a"), "path", F.col("alias_of").alias("name")).join(s.by_name, ["path", "name"]).select("a", F.col("id").alias("b")).where("a <> b")
    step = cut(step)
    now = cut(step.select(F.col("a").alias("start"), F.col("b").alias("end")))
    trail = cut(step.select(F.col("a").alias("start"), F.col("b").alias("been")).union(step.select("a", "a")))
    while True:
        onward = cut(now.join(step, F.col("end") == F.col("a")).select("start", F.col("b").alias("been")).join(trail, ["start", "been"], "left_anti"))
        if not onward.limit(1).count():
            break
        now = cut(now.join(onward, "start", "left").select("start", F.coalesce("been", "end").alias("end")))
        trail = cut(trail.unionByName(onward))
    return found.join(now.withColumnRenamed("start", "to"), "to", "left").select("path", "seq", "outcome", F.coalesce("end", "to").alias("to"), "reason")


def call_edges(calls: DataFrame, outcomes: DataFrame, symbols: DataFrame) -> DataFrame:
    """(source_path, to_ref, kind, confidence, lines): one edge for each caller, target and kind. A call of ``new`` that finds a class
    also calls its constructor, where it declares one."""
    j = calls.select("path", "seq", "caller", F.col("kind").alias("how"), "line").join(outcomes, ["path", "seq"])
    kind = F.when(F.col("outcome") == "symbol", "calls").when(F.col("outcome") == "name", "calls:name").otherwise(F.concat(F.lit("calls:"), "outcome"))
    confidence = F.when(F.col("outcome").isin("symbol", "external"), "exact").when(F.col("outcome") == "name", "guess").otherwise("none")
    rows = j.select(F.coalesce("caller", "path").alias("source_path"), F.col("to").alias("to_ref"), kind.alias("kind"), confidence.alias("confidence"), "line", "how")
    made = symbols.where("base_name = '__construct' and parent_id is not null").select(F.col("parent_id").alias("to_ref"), F.col("id").alias("made")).distinct()
    extra = rows.where("how = 'new' and kind = 'calls'").join(made, "to_ref").select("source_path", F.col("made").alias("to_ref"), "kind", "confidence", "line", "how")
    return rows.unionByName(extra).groupBy("source_path", "to_ref", "kind").agg(F.min("confidence").alias("confidence"), F.array_sort(F.collect_set("line")).alias("lines"))


def callers(edges: DataFrame, symbols: DataFrame, packages: DataFrame | None = None, resolved_only: bool = False) -> DataFrame:
    """(to_ref, source_path, path, evidence, confidence, lines, cross_package) of who calls each symbol; guesses are marked, or left
    out. packages: (path, root) of every file."""
    e = edges.where(F.col("kind") == "calls" if resolved_only else F.col("kind").isin("calls", "calls:name"))
    at = symbols.select("id", "path").dropDuplicates(["id"])
    j = e.join(at.select(F.col("id").alias("source_path"), F.col("path").alias("own")), "source_path", "left").join(at.select(F.col("id").alias("to_ref"), F.col("path").alias("to_path")), "to_ref")
    j = j.withColumn("path", F.coalesce("own", "source_path"))
    if packages is None:
        j = j.withColumn("cross_package", F.lit(None).cast("boolean"))
    else:
        p = packages.select("path", "root")
        j = j.join(p.withColumnRenamed("root", "a"), "path", "left").join(p.select(F.col("path").alias("to_path"), F.col("root").alias("b")), "to_path", "left").withColumn("cross_package", ~F.col("a").eqNullSafe(F.col("b")))
    return j.select("to_ref", "source_path", "path", F.when(F.col("kind") == "calls", "resolved").otherwise("name").alias("evidence"), "confidence", "lines", "cross_package")


def callees(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(source_path, to_ref, kind, confidence, lines, name): what each symbol or file calls, what is outside or open included."""
    known = symbols.select(F.col("id").alias("to_ref"), "name").dropDuplicates(["to_ref"])
    kind = F.when(F.col("kind") == "calls", "resolved").otherwise(F.substring_index("kind", ":", -1))
    return edges.where(F.col("kind").startswith("calls")).join(known, "to_ref", "left").select("source_path", "to_ref", kind.alias("kind"), "confidence", "lines", "name")


def neighbors(edges: DataFrame, symbols: DataFrame) -> DataFrame:
    """(ref, direction, other, kind): callers and callees of each symbol or file together."""
    a = callers(edges, symbols).select(F.col("to_ref").alias("ref"), F.lit("caller").alias("direction"), F.col("source_path").alias("other"), F.col("evidence").alias("kind"))
    b = callees(edges, symbols).select(F.col("source_path").alias("ref"), F.lit("callee").alias("direction"), F.col("to_ref").alias("other"), "kind")
    return a.unionByName(b)
