"""Cards: what of a symbol or a section is embedded, packed to the window of an encoder."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from prism.functions import text as tx
from prism.session import cut

# Marks of comments before and after a line, fenced code, inline tags, marks of tagged prose.
_LEAD = r"(?:/\*+|\*+/|\*|//+|#+|\"\"\"|'''|--\[\[|--+|=begin|=end|<!--|-->|\{-|-\})"
_TRAIL = r"(?:\*+/|\"\"\"|'''|\]\]|-->|-\}|=end)"
_FENCED = r"(?s)```.*?```|~~~.*?~~~"
_INLINE = r"\{@\w+\s+([^}]*)\}"
_TAGS = (
    r"@(?:param|returns?|throws|exception|example|remarks|typeParam|defaultValue|var|type|deprecated)(?![A-Za-z0-9_])|(?m:^):(?:param|returns?|rtype|raises)(?![A-Za-z0-9_])"
    r"|(?<![A-Za-z0-9_])(?:Args|Arguments|Returns|Raises|Yields|Attributes|Parameters|Examples?|Note)s?:"
)
DOC_EXTENSIONS = ("md", "mdx", "adoc", "rst", "txt")


def normal_doc(doc: Column) -> Column:
    """The prose of a comment on one line: marks, fenced code and the marks of tags gone, blanks collapsed."""
    bare = lambda s: F.trim(F.regexp_replace(F.regexp_replace(F.trim(F.translate(s, "\t", " ")), rf"^(?:{_LEAD}\s*)+", ""), rf"(?:\s*{_TRAIL})+$", ""))
    lines = F.transform(F.split(F.regexp_replace(doc, _FENCED, " "), r"\r?\n"), bare)
    s = F.regexp_replace(F.regexp_replace(F.array_join(lines, " "), _INLINE, "$1"), _TAGS, " ")
    return F.trim(F.regexp_replace(s, r"\s+", " "))


# ---- packing


_SENTENCE = re.compile(r"(?<=[.!?])\s+(?=[A-Z0-9\"'(`])")
#: From the largest unit of a text to the smallest, and what joins units of each.
_UNITS: tuple[tuple[Callable[[str], list[str]], str], ...] = (
    (lambda t: re.split(r"\n\s*\n", t), "\n\n"), (lambda t: _SENTENCE.split(t), " "), (lambda t: t.split(), " "),
)


def fit(text: str, count: Callable[[str], int], room: int, level: int = 0) -> list[str]:
    """Pieces of a text of at most ``room`` tokens, cut where its largest units allow: paragraphs, sentences, words, and characters
    only within a word that is too long itself. In order they hold all of it. A paragraph is cut by sentences and so on, and
    pieces of one that was cut are not filled up with the next."""
    text = text.strip()
    if not text:
        return []
    if count(text) <= room:
        return [text]
    if level == len(_UNITS):
        out, at = [], 0
        while at < len(text):
            low, high = 1, len(text) - at
            while low < high:  # the longest stretch that fits, at least a character
                mid = (low + high + 1) // 2
                low, high = (mid, high) if count(text[at : at + mid]) <= room else (low, mid - 1)
            out.append(text[at : at + low])
            at += low
        return out
    split, glue = _UNITS[level]
    units = [u.strip() for u in split(text) if u.strip()]
    if len(units) == 1:
        return fit(text, count, room, level + 1)
    out, now = [], ""
    for u in units:
        longer = now + glue + u if now else u
        if count(longer) <= room and count(u) <= room:
            now = longer
            continue
        out += [now] if now else []
        now = u
        if count(u) > room:
            out += fit(u, count, room, level + 1)
            now = ""
    return out + ([now] if now else [])


def pack_card(head: str, blocks: list[str], count: Callable[[str], int], window: int) -> list[str]:
    """The texts of as many cards as head and blocks take; each begins with the head, blocks keep their order, and one that does
    not fit moves to a card of its own before it is cut. A head that fills the window is cut alone."""
    room = window - count(head) - 1
    if room < 0:
        return fit(head, count, window)
    bodies: list[list[str]] = [[]]
    for piece in (p for b in blocks for p in fit(b, count, max(room, 1))):
        if bodies[-1] and count("\n".join([*bodies[-1], piece])) > room:
            bodies.append([])
        bodies[-1].append(piece)
    texts = ["\n".join([head, *b]) for b in bodies]
    return [t for text in texts for t in ([text] if count(text) <= window else fit(text, count, window))]


def words_and_marks(text: str) -> int:
    """Tokens where no tokenizer is at hand: runs of word characters and other single marks."""
    return len(re.findall(r"\w+|[^\w\s]", text))


def packed(drafts: DataFrame, window: int, count: Callable[[str], int] = words_and_marks) -> DataFrame:
    """``drafts`` (head, blocks: array) with text, part and parts: one row a card, part null where there is one."""
    names = drafts.columns

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            texts = [pack_card(h or "", list(b) if b is not None else [], count, window) for h, b in zip(f["head"], f["blocks"], strict=True)]
            f = f.assign(text=texts, parts=[len(t) for t in texts], part=[list(range(1, len(t) + 1)) for t in texts]).explode(["text", "part"])
            yield f[f["text"].notna()][[*names, "text", "part", "parts"]]

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in drafts.schema)
    return drafts.mapInPandas(run, f"{fields}, text string, part int, parts int").withColumn("part", F.when(F.col("parts") > 1, F.col("part")))


# ---- symbols


def path_line(symbols: DataFrame) -> DataFrame:
    """(path, id, line): the path query that leads to each symbol, from the outermost that holds it."""
    own = cut(symbols.select("path", "id", "parent_id", F.concat(F.lit("/"), "kind", F.lit("[@name='"), "base_name", F.lit("']")).alias("step")).dropDuplicates(["path", "id"]))
    ups = own.select("path", F.col("id").alias("up"), F.col("parent_id").alias("next"), F.col("step").alias("s"))
    done, now = None, own.select("path", "id", F.col("parent_id").alias("up"), F.col("step").alias("line"))
    while True:
        end = now.where("up is null").select("path", "id", "line")
        done = end if done is None else done.unionByName(end)
        open_ = now.where("up is not null").join(ups, ["path", "up"], "left")
        # a parent that is not there ends the path
        now = cut(open_.select("path", "id", F.col("next").alias("up"), F.concat(F.coalesce("s", F.lit("")), "line").alias("line")))
        if not now.limit(1).count():
            return done


def symbol_drafts(symbols: DataFrame, with_path: bool = True) -> DataFrame:
    """(path, id, key, head, blocks, kind, symbol, has_doc, start_line, end_line): one draft a symbol: head line; then path line, prose
    of the doc and signature, never the body. The nth symbol of a name in a file has #n behind its key.
    symbols: (path, seq, id, name, base_name, kind, parent_id, signature, doc, start_line, end_line), each once."""
    parent = F.regexp_extract("parent_id", r"([^.#]+)$", 1)
    head = F.array(
        F.concat_ws(" ", "kind", "name"), F.array_join(tx.identifier_words(F.col("base_name")), " "),
        F.when(F.col("parent_id").isNotNull(), F.concat(F.lit("in "), F.array_join(tx.identifier_words(parent), " "))),
        F.when(F.size(tx.path_words(F.col("path"))) > 0, F.concat(F.lit("module "), F.array_join(tx.path_words(F.col("path")), " "))),
    )
    n = F.row_number().over(Window.partitionBy("path", "name").orderBy("seq", "id"))
    key = F.when(n > 1, F.concat_ws("#", "name", n.cast("string"))).otherwise(F.col("name"))
    s = symbols.withColumn("key", key).withColumn("prose", F.coalesce(normal_doc(F.col("doc")), F.lit("")))
    s = s.join(path_line(symbols), ["path", "id"], "left") if with_path else s.withColumn("line", F.lit(None).cast("string"))
    blocks = F.filter(F.array("line", "prose", "signature"), lambda b: b.isNotNull() & (b != ""))
    return s.select("path", "id", "key", F.array_join(F.filter(head, lambda h: h.isNotNull() & (h != "")), " — ").alias("head"), blocks.alias("blocks"), "kind", F.col("name").alias("symbol"), (F.col("prose") != "").alias("has_doc"), "start_line", "end_line")


def completed(cards: DataFrame, channel: str) -> DataFrame:
    """``cards`` (path, key, text, part, .. ) with id, group_key and channel. Blank texts and spans that end before they begin are errors,
    and so is an id that stands twice: the second would silently replace the first."""
    id_ = F.concat(F.concat_ws("#", "path", "key"), F.when(F.col("part").isNotNull(), F.concat(F.lit("~"), F.col("part").cast("string"))).otherwise(""))
    c = cards.withColumn("card_id", id_).withColumn("group_key", F.concat_ws("#", "path", "key")).withColumn("channel", F.lit(channel))
    bad = (
        F.when(F.trim("text") == "", F.lit("its text is blank")).when((F.col("start_line") < 1) | (F.col("end_line") < F.col("start_line")), F.lit("its span is not 1-based or ends before it begins"))
        .when(F.count("*").over(Window.partitionBy("card_id")) > 1, F.lit("it is produced twice"))
    )
    checked = F.when(bad.isNotNull(), F.raise_error(F.concat(F.lit("card "), F.col("card_id"), F.lit(": "), bad))).otherwise(F.col("card_id"))
    return c.withColumn("card_id", checked)


# ---- sections of documents


def _heading(lines: list[str], i: int, ext: str) -> tuple[int, str, int] | None:
    """(level, title, lines that it takes) of a heading that begins at a line."""
    if ext in ("md", "mdx"):
        m = re.match(r"(#{1,6})\s+(.+?)\s*#*\s*$", lines[i])
        return (len(m[1]), m[2], 1) if m else None
    if ext == "adoc":
        m = re.match(r"(={1,6})\s+(.+?)\s*$", lines[i])
        return (len(m[1]), m[2], 1) if m else None
    if ext == "rst" and i + 1 < len(lines):
        title, under = lines[i].strip(), lines[i + 1].strip()
        # Fixed value: marks of underlines, the highest level first.
        marks = "=-~^\"'`#*+"
        if title and len(under) >= len(title) and under[0] in marks and under == under[0] * len(under):
            return marks.index(under[0]) + 1, title, 2
    return None


def sections(text: str, ext: str) -> list[tuple[list[str], list[str]]]:
    """(trail of titles, paragraphs) of the sections of a document that have any. What is fenced is code: no heading is in it, and a
    fenced block is one paragraph."""
    lines = re.split(r"\r?\n", text)
    out: list[tuple[list[str], list[str]]] = []
    trail: list[tuple[int, str]] = []
    body: list[list[str]] = [[]]
    fence, i = None, 0

    def close() -> None:
        parts = [p for p in ("\n".join(b).strip() for b in body) if p]
        if parts:
            out.append(([t for _, t in trail], parts))

    while i < len(lines):
        m = re.match(r"\s*(```|~~~)", lines[i])
        inside = fence is not None
        if m:
            fence = m[1] if fence is None else None if fence == m[1] else fence
        head = None if m or inside else _heading(lines, i, ext)
        if head:
            close()
            trail = [t for t in trail if t[0] < head[0]] + [head[:2]]
            body = [[]]
            i += head[2]
            continue
        if not lines[i].strip() and fence is None:
            body.append([])
        else:
            body[-1].append(lines[i])
        i += 1
    close()
    return out


def section_drafts(docs: DataFrame) -> DataFrame:
    """(path, key, head, blocks, section): a draft for each section of documents (path, content) with headings of their own kind. A
    trail that stands again in a document has #n behind its key. Repeated rows, null and blank texts give none."""

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for path, text in zip(f["path"], f["content"], strict=True):
                seen: dict[str, int] = {}
                for trail, parts in sections(text, path.rpartition(".")[2].lower()):
                    base = "/".join(trail) or "document"
                    n = seen[base] = seen.get(base, 0) + 1
                    rows.append((path, base if n == 1 else f"{base}#{n}", trail, parts))
            yield pd.DataFrame(rows, columns=["path", "key", "trail", "blocks"])

    d = docs.where(F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).isin(*DOC_EXTENSIONS) & F.col("content").isNotNull()).select("path", "content").distinct()
    s = d.mapInPandas(run, "path string, key string, trail array<string>, blocks array<string>")
    head = F.concat(F.lit("doc "), F.array_join(F.concat(F.array(F.array_join(tx.path_words(F.col("path")), " ")), "trail"), " › "))
    return s.select("path", "key", head.alias("head"), "blocks", F.array_join("trail", " › ").alias("section"))


# ---- corpora


# Extensions whose comments hold tags.
_TAGGED = ("ts", "tsx", "js", "jsx", "mjs", "cjs", "py", "go", "rs", "java", "php", "rb")


def docblocks(texts: DataFrame) -> DataFrame:
    """(path, line, tag, value) of every ``@tag value`` of a source file, several on a line too; a tag without a value is 'true'."""
    own = F.lower(F.regexp_extract("path", r"\.(\w+)$", 1)).isin(*_TAGGED)
    rows = texts.where(own & F.col("content").isNotNull()).select("path", "content").distinct().select("path", F.posexplode(F.split("content", r"\r?\n")).alias("n", "s"))
    mark = r"@([a-zA-Z0-9_-]+)(?:\s+([^\r\n*]+))?"
    found = rows.select("path", (F.col("n") + 1).alias("line"), F.explode(F.regexp_extract_all("s", F.lit(mark), F.lit(0))).alias("m"))
    return found.select("path", "line", F.regexp_extract("m", mark, 1).alias("tag"), F.coalesce(F.nullif(F.trim(F.regexp_extract("m", mark, 2)), F.lit("")), F.lit("true")).alias("value"))


def routes(texts: DataFrame) -> DataFrame:
    """(path, line, framework, method, route) of the routes that a line declares: Laravel and Lumen, Express, FastAPI and Flask. Routes
    within groups come without the prefix of the group."""
    rows = texts.where("content is not null").select("path", "content").distinct().select("path", F.posexplode(F.split("content", r"\r\n?|\n")).alias("n", "s"))
    verbs = "get|post|put|patch|delete|options|head|any|all"
    php = rf"(?i)(?:Route::|\$(?:router|app)->)({verbs})\(\s*['\"]([^'\"]*)['\"]"
    js = rf"\b(?:app|router|server)\.({verbs})\(\s*['\"`]([^'\"`]*)['\"`]"
    py = rf"^\s*@\w+\.({verbs}|route)\(\s*['\"]([^'\"]*)['\"]"
    ext = F.regexp_extract("path", r"\.(\w+)$", 1)
    pick = lambda i: F.when(ext == "php", F.regexp_extract("s", php, i)).when(ext == "py", F.regexp_extract("s", py, i)).when(ext.isin("js", "ts", "mjs", "cjs"), F.regexp_extract("s", js, i))
    framework = F.when(ext == "php", F.when(F.col("s").contains("Route::"), "laravel").otherwise("lumen")).when(ext == "py", F.when(F.col("s").rlike(r"\.route\("), "flask").otherwise("fastapi")).otherwise("express")
    method = F.when(pick(1).isin("any", "all", "route"), "ANY").otherwise(F.upper(pick(1)))
    return rows.where(pick(1) != "").select("path", (F.col("n") + 1).alias("line"), framework.alias("framework"), method.alias("method"), pick(2).alias("route"))


def find_routes(found: DataFrame, method: str | None = None, path: str | None = None, framework: str | None = None) -> DataFrame:
    """Routes by method (one that takes any answers too), by a part of route or file, by framework."""
    c = F.lit(True)
    if method:
        c = c & F.col("method").isin(method.upper(), "ANY")
    if path:
        c = c & (F.col("route").contains(path) | F.col("path").contains(path))
    if framework:
        c = c & (F.col("framework") == framework)
    return found.where(c)


def embedded_form(text: Column) -> Column:
    """A card as it is embedded: without its path line."""
    return F.array_join(F.filter(F.split(text, "\n"), lambda s: ~s.startswith("/")), "\n")


def checked_vectors(vectors: DataFrame, dims: int) -> DataFrame:
    """``vectors`` as they are; one that is not dims long or not finite is an error."""
    ok = (F.size("vector") == dims) & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < F.lit(float("inf"))))
    return vectors.withColumn("vector", F.when(F.coalesce(ok, F.lit(False)), F.col("vector")).otherwise(F.raise_error(F.concat(F.lit("vector of "), F.col("id"), F.lit(f" is not {dims} finite numbers"))).cast(vectors.schema["vector"].dataType)))
