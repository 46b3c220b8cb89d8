"""Which files a workspace offers: listings, ignore rules and globs, decoding, languages, packages and scopes."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from prism.functions.text import directory
from prism.session import cut

# Extensions and the language of each.
LANGUAGES = {
    "ts": "typescript", "mts": "typescript", "cts": "typescript", "tsx": "tsx", "js": "javascript", "jsx": "javascript", "mjs": "javascript", "cjs": "javascript",
    "py": "python", "pyi": "python", "php": "php", "vue": "vue", "java": "java", "go": "go", "rs": "rust", "rb": "ruby", "c": "c", "h": "c",
    "cpp": "cpp", "cc": "cpp", "cxx": "cpp", "hpp": "cpp", "cs": "csharp", "kt": "kotlin", "json": "json",
}
# Bytes that are looked at for a NUL.
SNIFFED = 8000


def language_of(path: Column) -> Column:
    ext = F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))
    return F.try_element_at(F.create_map(*[x for e, n in LANGUAGES.items() for x in (F.lit(e), F.lit(n))]), ext)


# ---- globs and ignore rules


@dataclass(frozen=True)
class Rule:
    pattern: str  # of the whole path below the base, or of the name
    negated: bool
    dirs_only: bool
    anchored: bool


def glob_pattern(glob: str) -> str:
    """A glob as a regular expression of a whole path: * and ? stay within a part, ** goes over parts."""
    out, i = [], 0
    glob = glob.removeprefix("/")
    while i < len(glob):
        c = glob[i]
        if glob.startswith("**", i):
            start, end = i == 0 or glob[i - 1] == "/", i + 2 == len(glob) or glob[i + 2] == "/"
            if start and end:
                out.append("(?:[^/]+/)*" if i + 2 < len(glob) else ".+")
                i += 3
                continue
            while i < len(glob) and glob[i] == "*":
                i += 1
            out.append("[^/]*")
            continue
        if c == "*":
            out.append("[^/]*")
        elif c == "?":
            out.append("[^/]")
        elif c == "[" and (m := re.match(r"\[([!^]?)(\]?[^\]]*)\]", glob[i:])):
            out.append(f"(?!/)[{'^' if m[1] else ''}{re.sub(r'([\\\[])', r'\\\1', m[2])}]")
            i += len(m[0])
            continue
        elif c == "\\" and i + 1 < len(glob):
            i += 1
            out.append(re.escape(glob[i]))
        else:
            out.append(re.escape(c))
        i += 1
    return "^" + "".join(out) + "$"


def ignore_rules(text: str) -> list[Rule]:
    """The rules of an ignore file in order: blanks and comments aside, ! includes again, a slash at the end is for folders,
    one elsewhere anchors to the folder of the file."""
    rules = []
    for line in re.split(r"\r?\n", text):
        if not line or line.startswith("#"):
            continue
        line = re.sub(r"(?<!\\) +$", "", line)
        negated = line.startswith("!")
        line = line[negated:]
        dirs = line.endswith("/") and not line.endswith("\\/")
        line = line[:-1] if dirs else line
        if line.removeprefix("/"):
            rules.append(Rule(glob_pattern(line), negated, dirs, "/" in line))
    return rules


def ignored(path: Column, layers: list[tuple[str, list[Rule]]]) -> Column:
    """Whether a file is ignored: layers (base, rules) from the root down; the nearest with an opinion decides, in it the last
    rule that matches; what an ignored folder holds is ignored whatever is said of it."""

    def decided(at: Column, is_dir: bool) -> Column:
        out = F.lit(None).cast("boolean")
        for base, rules in layers:
            below = at if not base else F.when(at.startswith(base + "/"), F.substr(at, F.lit(len(base) + 2)))
            one = F.lit(None).cast("boolean")
            for r in rules:
                if is_dir or not r.dirs_only:
                    hit = (below if r.anchored else F.substring_index(below, "/", -1)).rlike(r.pattern)
                    one = F.when(hit, not r.negated).otherwise(one)
            out = F.coalesce(one, out)
        return F.coalesce(out, F.lit(False))

    parts = F.split(path, "/")
    folders = F.transform(F.sequence(F.lit(1), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))
    above = F.when(F.size(parts) > 1, F.exists(folders, lambda d: decided(d, True))).otherwise(False)
    return above | decided(path, False)


def expand(paths: DataFrame, globs: list[str]) -> DataFrame:
    """The paths that a list of globs names; one with ! takes out again what an earlier one named."""
    keep = F.lit(False)
    for g in globs:
        hit = F.col("path").rlike(glob_pattern(g.removeprefix("!")))
        keep = keep & ~hit if g.startswith("!") else keep | hit
    return paths.where(keep)


# ---- reading


def listing(spark: SparkSession, root: str, layers: list[tuple[str, list[Rule]]] | None = None) -> DataFrame:
    """(path, size, mtime_ms, content) of the files under a folder, by path below it, less what is ignored; read where they lie.
    Files without a byte have no row: the reader of binary files leaves them out."""
    base = root.rstrip("/")
    f = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(base)
    path = F.regexp_replace("path", r"^[a-z]+:/*" + re.escape(base.split(":", 1)[-1].lstrip("/")) + "/", "")
    rows = f.select(path.alias("path"), F.col("length").alias("size"), F.unix_millis("modificationTime").cast("double").alias("mtime_ms"), "content")
    return rows.where(~ignored(F.col("path"), layers)) if layers else rows


def decoded(files: DataFrame) -> DataFrame:
    """``files`` (content: bytes) with digest (SHA-256 of the bytes), binary, and text. A UTF-16 mark is followed; a NUL among the
    first 8000 bytes else makes a file binary, with null text. lossy: some bytes are no UTF-8."""
    c = F.col("content")
    head = F.hex(F.substring("content", 1, 2))
    le, be = head == "FFFE", head == "FEFF"
    nul = F.regexp_count(F.hex(F.substring("content", 1, SNIFFED)), F.lit("(?:^|\\G)(?:..)*?00(?=(?:..)*$)")) > 0
    binary = ~le & ~be & nul
    utf8 = F.decode(F.when(F.is_valid_utf8(c.cast("string")), c).otherwise(F.encode(F.make_valid_utf8(c.cast("string")), "UTF-8")), "UTF-8")
    wide = F.substring("content", 3, 1 << 30)
    text = F.when(binary, F.lit(None)).when(le, F.decode(wide, "UTF-16LE")).when(be, F.decode(wide, "UTF-16BE")).otherwise(F.regexp_replace(utf8, "^﻿", ""))
    return files.select("*", F.sha2(c, 256).alias("digest"), binary.alias("binary"), text.alias("text"), (~le & ~be & ~F.is_valid_utf8(c.cast("string"))).alias("lossy"))


def script_of(text: Column) -> Column:
    """The script block of a single-file component, and null where it has none."""
    return F.nullif(F.regexp_extract(text, r"(?si)<script\b[^>]*>(.*?)</script\s*>", 1), F.lit(""))


def claimed(files: DataFrame, patterns: dict[str, str]) -> DataFrame:
    """(channel, path): the files that each channel takes, by a pattern of the path; a file may go to several."""
    each = F.filter(F.array(*[F.when(F.col("path").rlike(p), F.lit(c)) for c, p in patterns.items()]), lambda x: x.isNotNull())
    return files.select(F.explode(each).alias("channel"), "path").distinct()


def walk_summary(files: DataFrame) -> DataFrame:
    """(language, package_root, files, bytes) of what is offered; a null language is one that is not supported."""
    return files.groupBy(language_of(F.col("path")).alias("language"), "package_root").agg(F.count("*").alias("files"), F.sum("size").alias("bytes"))


# ---- packages


def folders_above(path: str = "path") -> Column:
    """The folders that hold a path, the root ("") first."""
    parts = F.split(path, "/")
    return F.transform(F.sequence(F.lit(0), F.size(parts) - 1), lambda n: F.array_join(F.slice(parts, 1, n), "/"))


def package_of(paths: DataFrame, roots: DataFrame) -> DataFrame:
    """``paths`` with the deepest root (of roots: root) above each, null where there is none."""
    ups = paths.select("path").distinct().select("path", F.explode(folders_above()).alias("root"))
    best = ups.join(roots.select("root").distinct(), "root", "left_semi").groupBy("path").agg(F.max_by("root", F.length("root")).alias("root"))
    return paths.join(best, "path", "left")


# Manifests, the kind of package each makes, in the order of their claims.
MANIFESTS = (("package.json", "npm"), ("Cargo.toml", "cargo"), ("go.mod", "go"), ("pyproject.toml", "python"), ("setup.py", "python"), ("pom.xml", "maven"), ("build.gradle", "gradle"), ("build.gradle.kts", "gradle"), ("BUILD.bazel", "bazel"), ("BUILD", "bazel"))


def discover(files: DataFrame, configured: DataFrame | None = None) -> DataFrame:
    """(root, name, kind, manifest): the packages of a listing (path, text). Configured ones (root, name) come first; of several
    manifests in a folder the first kind claims it. The name is that of the manifest, or else of the folder."""
    base = F.substring_index("path", "/", -1)
    order = F.create_map(*[x for n, (m, _) in enumerate(MANIFESTS) for x in (F.lit(m), F.lit(n + 1))])
    kind = F.create_map(*[x for m, k in MANIFESTS for x in (F.lit(m), F.lit(k))])
    m = files.withColumn("base", base).where(F.col("base").isin(*[m for m, _ in MANIFESTS])).withColumn("root", directory(F.col("path")))
    named = (
        F.when(F.col("base") == "package.json", F.get_json_object("text", "$.name"))
        .when(F.col("base").isin("Cargo.toml", "pyproject.toml"), F.regexp_extract("text", r"(?s)\[(?:package|project)\][^\[]*?\bname\s*=\s*[\"']([^\"']+)", 1))
        .when(F.col("base") == "go.mod", F.regexp_extract("text", r"(?m)^module\s+(\S+)", 1)).when(F.col("base") == "setup.py", F.regexp_extract("text", r"\bname\s*=\s*[\"']([^\"']+)", 1))
        .when(F.col("base") == "pom.xml", F.regexp_extract(F.regexp_replace("text", r"(?s)<parent>.*?</parent>", ""), r"<artifactId>([^<]+)", 1))
    )
    rows = m.select("root", F.try_element_at(order, F.col("base")).alias("o"), F.coalesce(F.nullif(named, F.lit("")), F.nullif(F.substring_index("root", "/", -1), F.lit("")), F.lit("root")).alias("name"), F.try_element_at(kind, F.col("base")).alias("kind"), F.col("path").alias("manifest"))
    if configured is not None:
        rows = rows.unionByName(configured.select("root", F.lit(0).alias("o"), "name", F.lit("configured").alias("kind"), F.lit(None).cast("string").alias("manifest")))
    return rows.groupBy("root").agg(F.min(F.struct("o", "name", "kind", "manifest")).alias("m")).select("root", "m.name", "m.kind", "m.manifest")


def closure(depends: DataFrame, start: DataFrame, reverse: bool = False) -> DataFrame:
    """(name, reached) of the packages that each start (name) depends on, over any number of steps; reverse: that depend on it.
    depends: (name, dependency). The start itself is not in it, cycles or not."""
    e = depends.select(F.col("dependency").alias("a"), F.col("name").alias("b")) if reverse else depends.select(F.col("name").alias("a"), F.col("dependency").alias("b"))
    e = cut(e.distinct())
    seen = front = cut(start.select("name", F.col("name").alias("reached")).distinct())
    while True:
        front = cut(front.join(e, F.col("reached") == F.col("a")).select("name", F.col("b").alias("reached")).distinct().join(seen, ["name", "reached"], "left_anti"))
        if not front.limit(1).count():
            return seen.where("name <> reached")
        seen = cut(seen.unionByName(front))


def in_packages(paths: DataFrame, packages: DataFrame, names: list[str], roots_of: DataFrame) -> DataFrame:
    """The paths whose package is one of the names; a name that no package bears is an error."""
    known = {r["name"] for r in packages.where(F.col("name").isin(*names)).select("name").distinct().collect()}
    if missing := sorted(set(names) - known):
        raise ValueError(f"no such package: {', '.join(missing)}")
    return package_of(paths, roots_of).join(packages.where(F.col("name").isin(*names)).select("root").distinct(), "root", "left_semi").select(*paths.columns)
