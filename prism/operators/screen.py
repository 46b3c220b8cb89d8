"""Screening of untrusted text: rules, verdicts, sanitising and batch statistics, all as column expressions."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

EXCERPT, Z_SCALE = 120, 0.6745

# Code points that render as nothing, and the patterns of the rules. In Java's dialect a word boundary is
# Unicode-aware, so it is written as ASCII look-around.
_INVISIBLE = r"[\x{AD}\x{34F}\x{61C}\x{180E}\x{200B}-\x{200F}\x{202A}-\x{202E}\x{2060}-\x{2064}\x{2066}-\x{2069}\x{FEFF}]"
_L, _R = r"(?<![A-Za-z0-9_])", r"(?![A-Za-z0-9_])"
# a boundary after a character that may be a hyphen: a word begins or ends here
_B = rf"(?:(?<=[A-Za-z0-9_]){_R}|(?<![A-Za-z0-9_])(?=[A-Za-z0-9_]))"
_OVERRIDE = (
    rf"(?i){_L}(?:ignore|disregard|forget|override|bypass|discard){_R}[^.\n]{{0,40}}{_L}(?:previous|prior|above|earlier|preceding|all|any|every|your|the|these|those){_R}"
    rf"[^.\n]{{0,30}}{_L}(?:instructions?|prompts?|rules?|guidelines?|directions?|constraints|context|programming){_R}"
)
_ROLE = (
    rf"(?im){_L}you\s+are\s+(?:now|no\s+longer){_R}|(?:^|[.!?]\s+)(?:act|behave|respond|pretend)\s+(?:as|like)\s+(?:a|an|if){_R}|{_L}new\s+(?:instructions?|task|role|objective)\s*:"
    rf"|{_L}(?:reveal|print|repeat|output|show){_R}[^.\n]{{0,30}}{_L}(?:system|initial|hidden)\s+prompt{_R}|{_L}do\s+not\s+(?:tell|inform|mention|reveal)[^.\n]{{0,30}}{_L}(?:user|human|operator){_R}"
)
_MARKERS = r"(?im)<\|(?:im_start|im_end|system|user|assistant|endoftext|begin_of_text|eot_id)\|>|\[/?INST\]|<</?SYS>>|</?(?:system|assistant|instructions?)>|^#{2,4}\s*(?:system|instruction|assistant)\s*:?\s*$"
_TOOLS = r"(?i)</?(?:tool_call|tool_use|function_calls?|invoke|antml:[a-z_]+)(?![A-Za-z0-9_])|\"(?:tool|function)_?(?:name|call)\"\s*:|```\s*(?:tool|function)[_-]?call"
_IMPERATIVE = rf"(?i){_L}(?:you\s+(?:must|should|will|need\s+to|are\s+to)|always|never|make\s+sure\s+(?:to|that)|do\s+not|don't|remember\s+to|ensure\s+that\s+you){_R}"
_HIDDEN = (
    r"(?im)<!--[\s\S]*?-->|^\[//\]:\s*#\s*[(\"'].*$|<\s*(?:script|iframe|object|embed)(?![A-Za-z0-9_])[\s\S]*?(?:</\s*(?:script|iframe|object|embed)\s*>|$)"
    r"|<[^>]+style\s*=\s*[\"'][^\"']*display\s*:\s*none[^\"']*[\"'][^>]*>[\s\S]*?(?:</[a-z]+>|$)"
)
_IMAGE = r"(?i)!\[[^\]]*\]\((?:https?:)?//[^)\s]+\)|<img(?![A-Za-z0-9_])[^>]*(?<![A-Za-z0-9_])src\s*=\s*[\"'](?:https?:)?//[^\"']+[\"'][^>]*>"
_BLOB = rf"[A-Za-z0-9+/]{{200,}}={{0,2}}|{_L}[0-9a-fA-F]{{200,}}{_R}"
_SECRET = (
    rf"(?i)-----BEGIN [A-Z ]*PRIVATE KEY-----[\s\S]*?(?:-----END [A-Z ]*PRIVATE KEY-----|$)|{_L}AKIA[0-9A-Z]{{16}}{_R}|{_L}gh[pousr]_[A-Za-z0-9]{{36,}}{_R}|{_L}xox[baprs]-[A-Za-z0-9-]{{10,}}{_B}"
    rf"|{_L}sk-[A-Za-z0-9_-]{{20,}}{_B}|{_L}AIza[0-9A-Za-z_-]{{35}}{_B}|{_L}eyJ[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]{{10,}}\.[A-Za-z0-9_-]{{10,}}{_B}"
    rf"|{_L}(?:api[_-]?key|secret|token|passw(?:or)?d){_R}\s*[:=]\s*[\"'][^\"'\s]{{16,}}[\"']"
)


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    severity: str
    pattern: str
    replacement: str | None
    light: str
    standard: str
    strict: str


S, Q, G, O = "sanitize", "quarantine", "flag", "off"  # noqa: E741
# The rules with what each profile does about them, the flood factor and the outlier threshold of each
# profile, and the least size of a batch.
RULES = (
    Rule("invisible-characters", "obfuscation", "medium", _INVISIBLE, "", S, S, S),
    Rule("unicode-tag-characters", "obfuscation", "high", r"[\x{E0000}-\x{E007F}]", None, Q, Q, Q),
    Rule("mixed-script-words", "obfuscation", "medium", r"(?=[\p{L}\p{M}]*\p{IsLatin})(?=[\p{L}\p{M}]*[\p{IsCyrillic}\p{IsGreek}])[\p{L}\p{M}]+", None, G, Q, Q),
    Rule("instruction-override", "injection", "high", _OVERRIDE, None, Q, Q, Q),
    Rule("role-reassignment", "injection", "medium", _ROLE, None, G, G, Q),
    Rule("chat-role-markers", "injection", "high", _MARKERS, None, Q, Q, Q),
    Rule("tool-call-syntax", "injection", "high", _TOOLS, None, G, Q, Q),
    Rule("imperative-density", "injection", "low", _IMPERATIVE, None, O, G, G),
    Rule("hidden-markup", "obfuscation", "medium", _HIDDEN, "", S, S, S),
    Rule("exfiltration-markup", "exfiltration", "medium", _IMAGE, "", S, S, S),
    Rule("encoded-blob", "obfuscation", "medium", _BLOB, "[encoded data removed]", G, S, Q),
    Rule("secret-material", "secrets", "high", _SECRET, "[redacted]", S, S, S),
)
FLOOD = {"light": 50, "standard": 20, "strict": 10}
OUTLIER = {"light": 4.0, "standard": 3.5, "strict": 3.0}
MIN_CARDS = 8


def hits(rule: Rule, text: Column) -> Column:
    n = F.regexp_count(text, F.lit(rule.pattern))
    if rule.id == "imperative-density":
        count = F.size(F.filter(F.split(text, r"\s+"), lambda w: w != ""))
        return F.when((n >= 3) & (count > 0) & (n * 40 >= count), 1).otherwise(0)
    return n


def findings(text: Column, profile: str = "standard", rules: tuple[Rule, ...] = RULES) -> Column:
    """array<struct<rule, action, hits, excerpt>> of the rules that fire on a text, in rule order."""
    each = []
    for r in rules:
        action = getattr(r, profile)
        if action != O:
            n = hits(r, text)
            each.append(F.when(n > 0, F.struct(F.lit(r.id).alias("rule"), F.lit(action).alias("action"), n.alias("hits"), F.substring(F.regexp_extract(text, r.pattern, 0), 1, EXCERPT).alias("excerpt"))))
    return F.filter(F.array(*each), lambda x: x.isNotNull())


def sanitised(text: Column, found: Column, rules: tuple[Rule, ...] = RULES) -> Column:
    """The text with what the sanitising rules found replaced, in rule order."""
    asks = F.transform(F.filter(found, lambda x: x["action"] == S), lambda x: x["rule"])
    for r in rules:
        if r.replacement is not None:
            asked = F.array_contains(asks, r.id)
            text = F.when(asked, F.regexp_replace(text, r.pattern, r.replacement)).otherwise(text)
    return text


def screen(cards: DataFrame, text: str = "text", profile: str = "standard", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """``cards`` with findings, verdict (pass, sanitize, quarantine) and clean text.

    Any quarantining finding wins, as does one that asks to sanitise by a rule that cannot; otherwise the text is
    sanitised and scanned again, and what is still found, or an empty rest, is quarantined. Null texts pass.
    """
    own = F.coalesce(F.col(text), F.lit(""))
    able = [r.id for r in rules if r.replacement is not None]
    c = cards.withColumn("findings", findings(own, profile, rules))
    block = F.exists("findings", lambda x: (x["action"] == Q) | ((x["action"] == S) & ~x["rule"].isin(*able)))
    change = F.exists("findings", lambda x: x["action"] == S)
    c = c.withColumn("clean", F.when(block, F.lit(None)).when(change, sanitised(own, F.col("findings"), rules)).otherwise(F.col(text)))
    # only what was changed is scanned again; bound in a lambda, the clean text is worked out once
    def judged(clean: Column) -> Column:
        again = findings(F.coalesce(clean, F.lit("")), profile, rules)
        left = F.exists(again, lambda x: x["action"].isin(S, Q)) | (F.trim(clean) == "")
        verdict = F.when(block, Q).when(change, F.when(left, Q).otherwise(S)).otherwise("pass")
        return F.struct(verdict.alias("verdict"), clean.alias("clean"))

    c = c.withColumn("_j", F.transform(F.array("clean"), judged)[0])
    return c.withColumn("verdict", F.col("_j.verdict")).withColumn("clean", F.when(F.col("verdict") != Q, F.col("_j.clean"))).drop("_j")


def report(screened: DataFrame) -> DataFrame:
    """(rule, flagged, sanitised, quarantined): cards by rule."""
    f = screened.select(F.explode("findings").alias("f"))
    return f.groupBy(F.col("f.rule").alias("rule")).agg(*[F.count_if(F.col("f.action") == a).alias(n) for a, n in ((G, "flagged"), (S, "sanitised"), (Q, "quarantined"))])


def preview(cards: DataFrame, text: str = "text", profile: str = "standard", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(id, verdict, rules, excerpts) of the cards that anything is found in, nothing being written; rules and excerpts each once."""
    s = screen(cards, text, profile, rules).where(F.size("findings") > 0)
    return s.select("id", "verdict", F.array_distinct(F.transform("findings", lambda x: x["rule"])).alias("rules"), F.array_distinct(F.transform("findings", lambda x: x["excerpt"])).alias("excerpts"))


def first_of_same(cards: DataFrame, text: str = "text") -> DataFrame:
    """One card of each path and normalised text: the first by id."""
    same = F.lower(F.regexp_replace(F.trim(F.col(text)), r"[\s\x{A0}\x{2000}-\x{200A}\x{3000}]+", " "))
    return cards.withColumn("_n", F.row_number().over(Window.partitionBy("path", F.sha2(same, 256)).orderBy("id"))).where("_n = 1").drop("_n")


def flooding(cards: DataFrame, profile: str = "standard", typical: DataFrame | None = None) -> DataFrame:
    """(path, cards, allowed) of the sources with more cards than factor x max(1, median of cards a source)."""
    per = cards.groupBy("path").agg(F.count("*").alias("cards"))
    return per.crossJoin(F.broadcast(_allowance(per, profile, typical))).where(F.col("cards") > F.col("allowed")).select("path", "cards", "allowed")


def _allowance(per: DataFrame, profile: str, typical: DataFrame | None) -> DataFrame:
    """One row: how many cards a source may have. typical: one row (m), the median known before; else that of ``per``."""
    middle = per.agg(F.coalesce(F.median("cards"), F.lit(0.0)).alias("m")) if typical is None else typical
    return middle.select((FLOOD[profile] * F.greatest(F.lit(1.0), F.col("m"))).alias("allowed"))


def flood_cut(cards: DataFrame, order: list[str], profile: str = "standard", typical: DataFrame | None = None) -> DataFrame:
    """``cards`` of the flooding sources with their running count ``n``, ``excess`` and ``finding``: cards are let through
    in order up to the allowance, those beyond are in excess, and the finding stands at the first of them. Sources within
    their allowance come back whole with ``excess`` false.

    A source is numbered by one sort; nothing is gathered."""
    allowed = _allowance(cards.groupBy("path").agg(F.count("*").alias("cards")), profile, typical)
    n = F.row_number().over(Window.partitionBy("path").orderBy(*order))
    c = cards.withColumn("n", n).crossJoin(F.broadcast(allowed))
    return c.withColumn("excess", F.col("n") > F.col("allowed")).withColumn("finding", F.col("n") == F.floor("allowed") + 1).drop("allowed")


def outliers(vectors: DataFrame, batch: list[str], profile: str = "standard", threshold: float | None = None) -> DataFrame:
    """(batch columns, id, z): rows that lie unusually close to their batch's centroid, by modified z-score of the similarity.

    Batches of fewer than 8 rows, and those whose median deviation is 0, have none. The centroid is a sum by place.
    """
    from prism.functions.vectors import dot, unit

    v = vectors.where(F.col("vector").isNotNull()).select(*batch, "id", unit(F.col("vector")).alias("u")).where("u is not null")
    centre = v.select(*batch, F.posexplode("u").alias("i", "x")).groupBy(*batch, "i").agg(F.sum("x").alias("x")).groupBy(*batch).agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "x"))), lambda e: e["x"]).alias("c"))
    s = v.join(centre, batch).withColumn("s", dot(F.col("u"), F.col("c")) / F.sqrt(dot(F.col("c"), F.col("c")))).select(*batch, "id", "s")
    m = s.groupBy(*batch).agg(F.median("s").alias("m"), F.count("*").alias("n")).where(F.col("n") >= MIN_CARDS)
    d = s.join(m, batch).withColumn("d", F.abs(F.col("s") - F.col("m")))
    mad = d.groupBy(*batch).agg(F.median("d").alias("mad")).where("mad > 0")
    return d.join(mad, batch).withColumn("z", Z_SCALE * (F.col("s") - F.col("m")) / F.col("mad")).where(F.col("z") > (OUTLIER[profile] if threshold is None else threshold)).select(*batch, "id", "z")
