"""Live credentials in text: quoted strings and long tokens of high entropy, by alphabet and length.

Candidates are all quoted strings and long tokens, and beside them, for what is too short or too plain to tell by
itself, tokens in the forms of known issuers, private keys, passwords in urls, authorisation headers and values given
to a name that speaks of a credential. Each must reach a share, by alphabet, of the entropy a random string of its
length would have. Digests, commit ids, public keys, masks, references and placeholders are left out.
Redaction replaces only the value, with a mask that needs no escape in JSON, a comment or a quoted string.
"""

from __future__ import annotations

import base64
import binascii
import math
import re
from collections import Counter
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

MASK = "REDACTED"

# Forms of issued tokens. The value is group 1 where there is one.
ISSUED = re.compile(
    r"(?<![A-Za-z0-9_+/.-])(?:"
    r"(?:AKIA|ASIA|AGPA|AIDA|AROA|ANPA)[A-Z0-9]{16}(?![A-Za-z0-9])"
    r"|gh[pousr]_[A-Za-z0-9]{36,}(?![A-Za-z0-9])|github_pat_[A-Za-z0-9_]{22,}"
    r"|gl(?:pat|ptt|dt|rt|cbt|soat)-[A-Za-z0-9_-]{20,}"
    r"|sk-(?:proj-|ant-|live-|svcacct-)?[A-Za-z0-9_-]{20,}|[sr]k_(?:live|test)_[A-Za-z0-9]{16,}"
    r"|npm_[A-Za-z0-9]{36}(?![A-Za-z0-9])|pypi-[A-Za-z0-9_-]{32,}|hf_[A-Za-z0-9]{30,}(?![A-Za-z0-9])"
    r"|xox[abeoprs](?:\.xox[bp])?-[A-Za-z0-9-]{16,}|xapp-[A-Za-z0-9-]{20,}"
    r"|AIza[A-Za-z0-9_-]{35}(?![A-Za-z0-9_-])|ya29\.[A-Za-z0-9_-]{20,}"
    r"|SG\.[A-Za-z0-9_-]{16,}\.[A-Za-z0-9_-]{16,}|key-[0-9a-f]{32}(?![A-Za-z0-9])"
    r"|dop_v1_[0-9a-f]{64}|shp(?:at|ss|ca|pa)_[0-9a-fA-F]{32}|SK[0-9a-f]{32}(?![A-Za-z0-9])|(?:lin_api|dckr_pat|sq0csp|rubygems|figd)_?-?[A-Za-z0-9_-]{24,}"
    r"|eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{16,}"
    r")"
)
PRIVATE = re.compile(r"-----BEGIN (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----(.*?)-----END (?:[A-Z0-9]+ )*PRIVATE KEY(?: BLOCK)?-----", re.S)
#: The lines of a key; what is left of it is a note or a placeholder.
_BODY = re.compile(r"[A-Za-z0-9+/=]{32,}")
URL = re.compile(r"(?<![A-Za-z0-9+.-])[A-Za-z][A-Za-z0-9+.-]{1,20}://([^\s:/@'\"<>`]*):([^\s/@'\"<>`]+)@[A-Za-z0-9\[]")
HEADER = re.compile(r"\bAuthorization\b[\"']?\s*[:=]\s*[\"']?\s*(Bearer|Basic|Token|ApiKey)\s+([^\s\"'`<>,;)\\]+)", re.I)
_NAMES = r"(?:pass(?:word|wd|phrase|code)?|pwd|secret|token|api[ _-]?key|apikey|access[ _-]?key|secret[ _-]?key(?:[ _-]?base)?|auth(?:orization|[ _-]?(?:key|token))?|credentials?|dsn|private[ _-]?key|signing[ _-]?key|encryption[ _-]?key|client[ _-]?secret|master[ _-]?key|webhook[ _-]?secret|login|bearer|connection[ _-]?string)"
#: A name of a credential with what it is given; what stands before the name in its identifier is looked at afterwards.
KEYED = re.compile(
    _NAMES + r"\d*(?![A-Za-z-])[\"'`]?[ \t]*(?::[ \t]*[A-Za-z_][\w.\[\]| ]{0,30}=|(?::=|=>|[:=]))[ \t]*"
    r"(?:\"((?:[^\"\\\n]|\\.)*)\"|'((?:[^'\\\n]|\\.)*)'|`([^`\n]*)`|(?!(?:Bearer|Basic)\b)([^\s\"'`,;(){}\[\]<>]+))",
    re.I,
)
_SIGN = re.compile(r"[:=]")
# What every text that a pattern finds something in holds, in lower case but for the beginnings of issued tokens.
_ENDS = ("pass", "password", "passwd", "passphrase", "passcode", "pwd", "secret", "token", "key", "base", "auth", "authorization", "credential", "credentials", "dsn", "login", "bearer", "string")
_PREFIXES = ("AKIA", "ASIA", "AGPA", "AIDA", "AROA", "ANPA", "ghp_", "gho_", "ghu_", "ghs_", "ghr_", "github_pat_", "glpat-", "glptt-", "gldt-", "glrt-", "glcbt-", "glsoat-", "sk-", "k_live_", "k_test_", "npm_", "pypi-", "hf_", "xox", "xapp-", "AIza", "ya29.", "SG.", "key-", "dop_v1_", "shp", "SK", "lin_api", "dckr_pat", "sq0csp", "rubygems", "figd", "eyJ")
_LOGIN_WORDS, _PROSE_WORDS = ("login", "credential", "account", "user"), ("pass", "secret", "token", "api", "access key", "pin", "credential")
_BEFORE_NAME = re.compile(r"(?:[A-Za-z0-9]+[_.-]+)*([A-Za-z0-9]*)\Z")
LOGIN = re.compile(r"\b(?:login|credentials?|account|user(?:name)?)\b\s*[:=]\s*[\"']?[\w.@-]+[\"']?\s*(?:/|:|\||,\s*(?:password|pw|pass)\b\s*[:=]?)\s*[\"']?([^\s\"'`<>,;()]+)", re.I)
PROSE = re.compile(r"\b(?:pass(?:word|phrase|code|wd)|secret|token|api[ -]?key|access key|pin|credentials?)\s+(?:(?:is|was|are|of|to|as|being|set to|currently|now)\s+){0,2}[\"'`]?([^\s\"'`<>,;(){}=:]+)", re.I)
FLAG = re.compile(r"(?<!\S)(?:--?(?:[A-Za-z0-9]+[-_])*" + _NAMES + r"|-p|-u[ \t]+[\w.-]+:)(?:=|[ \t]+|(?<=:))[\"']?((?!-)[^\s\"'`<>]{6,})", re.I)
QUOTED = re.compile(r"\"([^\"\\\s]{16,})\"|'([^'\\\s]{16,})'|`([^`\\\s]{16,})`")
LONG = re.compile(r"(?<![A-Za-z0-9+/_=.@#:-])(?:[A-Za-z_][A-Za-z0-9_]*=)?([A-Za-z0-9+/_-]{20,}={0,2})(?![A-Za-z0-9+/_=@#-])")
# Names and calls built of words, each with a number at most behind it; other strings that only look random.
_NAME = re.compile(r"[$@#./_-]*(?:[A-Za-z]+\d{0,4}|\d{1,4})(?:[_./#:@-]+(?:[A-Za-z]+\d{0,4}|\d{1,4}))*[_./-]*(?:\(.*\)?)?;?|(?:[A-Z]?[a-z]{2,}\d{0,2}){2,}")
_LOOKALIKE = re.compile(r"://|^[./~#@]|\.[A-Za-z]\w{0,4}$|[0-9a-fA-F]{8}-[0-9a-fA-F]{4}-|[0-9a-fA-F]{24}|\d{4}-\d\d-\d\d|^(?:sha\d+|md5)[-:]|ssh-|data:|^AAAA[A-Z]|\w\(|[=(\[{<][\"']")
#: What a value is given to: the name before a colon or equals sign, or a scheme such as sha512-.
_GIVEN_TO = re.compile(r"([\w.-]+)[\"'`]?[ \t]*(?::=|=>|[:=])[ \t]*(?:[brfu]{0,2}[\"'`])?$|\b(sha\d+-|ssh-\w+ +|ecdsa-[\w-]+ +|base64, *)$", re.I)
_PEM = re.compile(r"-----BEGIN [^-\n]+-----.*?(?:-----END [^-\n]+-----|\Z)", re.S)
# What stands where a credential would.
_PLACEHOLDER = re.compile(
    r"^(?:x+|\*+|\.+|-+|_+|0+|1234\w*|n/?a|none|null|nil|undefined|true|false|empty|blank|test|testing|foo|bar|baz|secret|password|passw0rd|token|string|str|int|bytes|any|bool|object|value|optional|required|admin|root|user)$"
    r"|[xX]{4,}|\*{3,}|•{3,}|\.{3,}|…|<[^>]*>|\$\{[^}]*\}?|\$\([^)]*\)?|\{\{|\}\}|%[A-Z_]+%|\$[A-Z_]{2,}\b|^\$\w+$|^@\w+$|^:\w+$|^%[sd(]"
    r"|your|change[-_ ]?me|replace|example|sample|dummy|placeholder|redacted|masked|insert|(?<![A-Za-z])(?:fixme|todo)(?![A-Za-z])|to[-_]?be|not[-_]?set|none[-_]|unset|fake|mock|hunter2|correct.?horse|deadbeef|lorem"
    r"|process\.env|os\.environ|getenv|env\(|env\.|env:|vault[.:/]|secrets?[.:/]|ssm:|arn:|kms:|keyring|config[.(\[]|settings\.|params?\.|self\.|this\.|0123456789|abcdef0?123|123456789|abcdefgh",
    re.I,
)
_DIGEST_NAME = re.compile(r"digest|checksum|hash|fingerprint|sha\d*|md5|commit|revision|etag|uuid|guid|public|integrity|nonce_?id|max_tokens|token(?:s|ize|_count|_type|_id)|key_?(?:id|name|path|file)", re.I)


def entropy(s: str) -> float:
    n = len(s)
    return -sum(c / n * math.log2(c / n) for c in Counter(s).values()) if n else 0.0


def alphabet(s: str) -> int:
    """Size of the least usual alphabet that holds the string."""
    for size, chars in ((10, r"[0-9]+"), (16, r"[0-9a-f]+|[0-9A-F]+"), (32, r"[A-Z2-7]+"), (36, r"[a-z0-9]+|[A-Z0-9]+"), (64, r"[A-Za-z0-9+/_=-]+")):
        if re.fullmatch(chars, s):
            return size
    return 94


def random_enough(s: str, share: float = 0.78) -> bool:
    """Whether the entropy reaches a share of what random strings of that length and alphabet have on average."""
    n, a = len(s), alphabet(s)
    if n < 2:
        return False
    usual = math.log2(a) - (a - 1) / (2 * math.log(2) * n) if n > 2 * a else math.log2(min(n, a)) * (1 - 0.09 * min(n, a) / max(n, a))
    return entropy(s) >= share * usual


def _classes(s: str) -> int:
    return sum(bool(re.search(c, s)) for c in (r"[a-z]", r"[A-Z]", r"\d", r"[^A-Za-z0-9]"))


def placeholder(s: str) -> bool:
    return bool(_PLACEHOLDER.search(s))


def live_password(s: str) -> bool:
    """A value given as a password, key or token: not a placeholder, a word, a path or a reference."""
    if len(s) < 6 or placeholder(s) or re.search(r"\s", s):
        return False
    if re.fullmatch(r"(?:https?://)?[\w.-]+(?:/[\w.-]*)+|[\w]+(?:\.[A-Za-z_]\w*)+(?:\(.*\))?", s) and not re.search(r"\d.*[A-Z]|[A-Z].*\d", s):
        return False
    if re.fullmatch(r"[0-9a-fA-F]{8}(?:-[0-9a-fA-F]{4}){3}-[0-9a-fA-F]{12}", s):
        return False
    if alphabet(s) == 16:
        return len(s) >= 24 and random_enough(s)
    if alphabet(s) == 10:
        return False
    if _classes(s) >= 3:
        return random_enough(s)
    return _classes(s) == 2 and bool(re.search(r"\d", s)) and len(s) >= 12 and random_enough(s, 0.85)


def random_token(s: str) -> bool:
    """Whether a string shows by itself that it was drawn at random: long, of high entropy for its alphabet, and its
    kinds of characters change as often as chance would have it, which words, names and paths do not reach. Hex is
    never enough, as digests and ids look the same; it takes a name or a form."""
    body = s.rstrip("=")
    if len(body) < 16 or not re.search(r"\d", body) and (body == body.lower() or body == body.upper()):
        return False
    if alphabet(body) <= 16 or placeholder(s) or not body.isalpha() and _NAME.fullmatch(s) or _LOOKALIKE.search(s):
        return False
    if len(body) % 4 != 1 and re.fullmatch(r"[A-Za-z0-9+/]+", body) and all(31 < c < 127 or c in b"\t\r\n" for c in base64.b64decode(body + "=" * (-len(body) % 4))):
        return False  # text in base64: Basic headers and tokens of three parts are judged by what they say
    kinds = ["l" if c.islower() else "u" if c.isupper() else "d" if c.isdigit() else "x" for c in body]
    share = {k: kinds.count(k) / len(kinds) for k in "ludx"}
    several = sum(share[k] > 0 for k in "lud")
    if several < 2 or share["x"] > 0.35 or several == 3 and re.search(r"[a-z]{10}", body):
        return False
    if not share["d"] and (len(body) < 20 or share["x"] > 0.15):
        return False
    changes = sum(a != b for a, b in zip(kinds, kinds[1:], strict=False)) / (len(kinds) - 1)
    by_chance = 1 - sum(x * x for x in share.values())
    # without digits, words joined by capitals come near: more changes are asked for
    least = 0.4 if not share["d"] else max(0.2, (0.6 if several == 3 else 0.5) * by_chance)
    return len(body) >= (16 if several == 3 else 20) and changes >= least and random_enough(body, 0.85)


def _unnamed(text: str) -> Iterator[tuple[int, int, str]]:
    """Quoted strings and long tokens that are random by themselves, without those given to the name of a digest or id."""
    pem = None
    for pattern in (QUOTED, LONG):
        for m in pattern.finditer(text):
            g = m.lastindex
            v, at = m[g], m.start(g)
            if not random_token(v):
                continue
            name = _GIVEN_TO.search(text, max(0, at - 80), at)
            if name and (name[2] or _DIGEST_NAME.search(name[1]) or re.search(r"(?:^|[_.-])id$|(?-i:[a-z]I[dD]$)", name[1], re.I)):
                continue
            if pem is None:
                pem = [x.span() for x in _PEM.finditer(text)] if "-----BEGIN" in text else []
            if not any(a <= at < b for a, b in pem):
                yield at, at + len(v), "random token"


def find(text: str) -> list[tuple[int, int, str]]:
    """(start, stop, kind) of the credentials of a text, not overlapping, in order."""
    if not text:
        return []
    found = [*_unnamed(text), *_known(text)]
    found.sort(key=lambda x: (x[0], -x[1]))
    out: list[tuple[int, int, str]] = []
    for f in found:
        if not out or f[0] >= out[-1][1]:
            out.append(f)
    return out


def _known(text: str) -> list[tuple[int, int, str]]:
    """Credentials told by a form or by what stands beside them; they may overlap."""
    found: list[tuple[int, int, str]] = []
    low = text.lower()
    for m in PRIVATE.finditer(text):
        body = re.sub(r"(?:^|\n)[ \t]*(?:\*|//|#)?[ \t]*|\\n|\s|[A-Za-z-]+: .*", "", m[1])
        body = re.sub(r"[^A-Za-z0-9+/=]", "", body)
        if len(body) >= 40 and not placeholder(_BODY.sub("", m[1]).replace("\n", " ")) and random_enough(body.rstrip("="), 0.7):
            found.append((m.start(1), m.end(1), "private key"))
    for m in ISSUED.finditer(text) if any(p in text for p in _PREFIXES) else ():
        v = m[0]
        core = re.sub(r"^(?:AKIA|ASIA|AGPA|AIDA|AROA|ANPA|dop_v1_|[A-Za-z]{2,6}[-_.]|AIza)", "", v)
        if v.startswith("eyJ"):
            head = v.split(".")[0]
            try:
                ok = b'"alg"' in base64.urlsafe_b64decode(head + "=" * (-len(head) % 4))
            except (ValueError, binascii.Error):
                ok = False
            if not ok or placeholder(v.rsplit(".", 1)[1]):
                continue
        elif placeholder(v) or not random_enough(core, 0.75) or not (core.isupper() and len(core) == 16 or re.search(r"\d|[A-Z].*[a-z]|[a-z].*[A-Z]", core)):
            continue
        found.append((m.start(), m.end(), "issued token"))
    for m in URL.finditer(text) if "://" in text and "@" in text else ():
        v = m[2]
        if not placeholder(v) and len(v) >= 4 and (_classes(v) >= 2 and random_enough(v, 0.7) or len(v) >= 12 and random_enough(v)) and not placeholder(m[1]):
            found.append((m.start(2), m.end(2), "password in url"))
    for m in HEADER.finditer(text) if "authorization" in low else ():
        v = m[2].rstrip(".")
        if placeholder(v) or len(v) < 8:
            continue
        if m[1].lower() == "basic":
            try:
                plain = base64.b64decode(v + "=" * (-len(v) % 4), validate=True).decode()
            except (ValueError, binascii.Error, UnicodeDecodeError):
                continue
            user, colon, word = plain.partition(":")
            if not colon or len(word) < 4 or placeholder(word):
                continue
        elif not random_enough(v) or _classes(v) < 2:
            continue
        found.append((m.start(2), m.start(2) + len(v), "authorisation"))
    found += _keyed(text, low)
    for pattern, kind, words in ((LOGIN, "login", _LOGIN_WORDS), (FLAG, "flag", None), (PROSE, "told in prose", _PROSE_WORDS)):
        if not (any(w in low for w in words) if words else text[:1] == "-" or any(w in text for w in (" -", "\n-", "\t-", "\r-", "\f-", "\v-", "\x1c-", "\x1d-", "\x1e-", "\x1f-")) or not text.isascii()):
            continue
        for m in pattern.finditer(text):
            v = m[1].rstrip(".,;:!?")
            if "://" not in v and live_password(v) and (pattern is not PROSE or _classes(v) >= 3 or alphabet(v) == 16):
                found.append((m.start(1), m.start(1) + len(v), kind))
    return found


def _keyed(text: str, low: str) -> list[tuple[int, int, str]]:
    """What a name of a credential is given. A name is looked for only before a sign that gives it something, where the text
    ends as some name does; KEYED then reads name and value."""
    found, at = [], 0
    low_as_long = len(low) == len(text)  # where lower case takes other places, every sign is looked at
    for sign in _SIGN.finditer(text):
        i = sign.start()
        if i < at:
            continue
        j = i
        while j and text[j - 1] in " \t":
            j -= 1
        j -= j > 0 and text[j - 1] in "\"'`"
        while j and text[j - 1].isdigit():
            j -= 1
        if not low.endswith(_ENDS, max(0, j - 32), j) and low_as_long:
            continue
        pos = max(at, j - 64)
        while (m := KEYED.search(text, pos)) and m.start() < i:
            pos = m.start() + 1
            if _SIGN.search(text, m.start()).start() != i:
                continue
            before = _BEFORE_NAME.search(text, max(0, m.start() - 120), m.start())
            # within an identifier a name begins at a capital, after a part that does not
            part = before[1].lstrip("0123456789")
            if part and not (part[0].islower() and m[0][0].isupper()):
                continue
            at = m.end()
            v, start = m[m.lastindex], m.start(m.lastindex)
            if m.lastindex == 4:
                v = v.rstrip(".,;:!?")
            if not _DIGEST_NAME.search(before[0] + text[m.start() : start]) and "://" not in v and live_password(v):
                found.append((start, start + len(v), "credential by name"))
            break
    return found


_ESCAPE = re.compile(r"\\u[0-9a-fA-F]{4}|\\.")
_PLAIN = {"n": "\n", "t": "\t", "r": "\r", "b": "\b", "f": "\f"}


def unescaped(raw: str) -> tuple[str, list[int] | None]:
    """The text of JSON source without escapes, and for each of its characters where it begins in the source."""
    if "\\" not in raw:
        return raw, None
    out, at, last = [], [], 0
    for m in _ESCAPE.finditer(raw):
        out.append(raw[last : m.start()])
        at.extend(range(last, m.start()))
        s = m[0]
        out.append(chr(int(s[2:], 16)) if len(s) == 6 else _PLAIN.get(s[1], s[1]))
        at.append(m.start())
        last = m.end()
    out.append(raw[last:])
    at.extend(range(last, len(raw) + 1))
    return "".join(out), at


def find_in(raw: str, is_json: bool) -> list[tuple[int, int, str]]:
    """As find, over JSON source where is_json: places are those of the source. A value cut off by the end of a text
    that stops within a string is found only where its form says that it is whole."""
    if not is_json:
        return find(raw)
    text, at = unescaped(raw)
    found = find(text)
    if found and found[-1][1] == len(text) and not raw.rstrip().endswith(("}", "]", '"')) and found[-1][2] != "issued token":
        found.pop()
    return [(at[a], at[b], k) for a, b, k in found] if at else found


def redact(raw: str | None, is_json: bool = False) -> str | None:
    """The text with each credential replaced; everything around it stays as it was."""
    if not raw:
        return raw
    out, last = [], 0
    for a, b, _ in find_in(raw, is_json):
        out += [raw[last:a], MASK]
        last = b
    return "".join([*out, raw[last:]]) if out else raw


def scan(texts: DataFrame, redacted: bool = False) -> DataFrame:
    """``texts``: (field, id, is_json, text). Gives (field, id, kinds, redacted) of the texts that hold a credential.

    Null and empty texts hold none. Repeated rows are found as often as they stand; the caller makes them distinct.
    """

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for f in frames:
            rows = []
            for field, key, is_json, text in f.itertuples(index=False):
                if text and (hits := find_in(text, is_json)):
                    rows.append((field, key, sorted({k for _, _, k in hits}), redact(text, is_json) if redacted else None))
            yield pd.DataFrame(rows, columns=["field", "id", "kinds", "redacted"])

    schema = T.StructType([T.StructField("field", T.StringType()), T.StructField("id", T.StringType()), T.StructField("kinds", T.ArrayType(T.StringType())), T.StructField("redacted", T.StringType())])
    return texts.select("field", "id", "is_json", "text").where(F.col("text").isNotNull()).mapInPandas(run, schema)


def fields(cards: DataFrame, symbols: DataFrame) -> DataFrame:
    """The texts of cards.card, symbols.doc and symbols.signature in one table."""
    part = lambda df, name, c, js: df.where(F.col("id").isNotNull()).select(F.lit(name).alias("field"), "id", F.lit(js).alias("is_json"), F.col(c).alias("text"))
    both = symbols.where(F.col("id").isNotNull()).select("id", F.explode(F.array(F.struct(F.lit("symbols.doc").alias("field"), F.col("doc").alias("text")), F.struct(F.lit("symbols.signature").alias("field"), F.col("signature").alias("text")))).alias("x"))
    return part(cards, "cards.card", "card", True).unionByName(both.select("x.field", "id", F.lit(False).alias("is_json"), "x.text"))
