"""Redaction of secrets and personal data in free text, with counts by kind.

The rules run in order, most specific first. A rule finds values by pattern; a guard may refuse a match. What replaces a
value starts with `<`, which no value pattern takes, so redacting twice changes nothing. Patterns are bounded, so hostile
text costs linear time. Conditional replacement is beyond Spark's regular expressions, so the rules run in an Arrow
function. What a rule's matches cannot do without, some literal, is derived from its pattern; a rule runs only on texts
that hold one of its literals, and texts that hold none of any rule's never leave the JVM.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator
from dataclasses import dataclass
from functools import cached_property

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# --- Fixed values of the redaction format: word lists, names and patterns. -------------------------------------------
LITERALS = frozenset("none null nil true false undefined required optional string str int integer bool boolean empty redacted password secret token active".split())
PROSE = frozenset(
    "after before when then that this these those with without from into once until while where which what also only must should "
    "will would could have been does here there they them your every each never always cannot para pero como cuando antes desde "
    "hasta tras sobre este esta esto nunca siempre debe puede solo".split()
)
ORG_PLAIN = frozenset(
    "default unknown example test testing user users admin administrator root me self system anonymous n/a na tbd todo unset any "
    "object dict list set array map number float date datetime name author owner org organization company customer tenant".split()
)
SCHEMES = frozenset("bearer basic token digest negotiate ntlm hawk".split())
HARMLESS_IPS = frozenset({"127.0.0.1", "0.0.0.0", "255.255.255.255"})
NETWORK = frozenset({"ip", "ipv6", "mac", "hostname"})
PERSONAL = frozenset({"email", "phone", "home_path", "org"})
ENV_REFERENCE = re.compile(r"^(?:\$\{?[A-Z_][A-Z0-9_]*\}?|%[A-Za-z_][A-Za-z0-9_]*%)$")
CODE_REFERENCE = re.compile(r"^[A-Za-z_][\w.]*(?:\(\)|[(\[])$")
TYPE_ANNOTATION = re.compile(r"^[A-Za-z_][A-Za-z0-9_.]*\[[A-Za-z0-9_., \[\]]*\]$")
STRONG = (
    r"password|passwd|pwd|passphrase|secret|api[_-]?key|apikey|access[_-]?key|private[_-]?key|"
    r"signing[_-]?key|encryption[_-]?key|access[_-]?token|auth[_-]?token"
)
WEAK = r"token|credentials?|session[_-]?id|sessionid|csrf|xsrf"
OPTIONS = r"password|passwd|pwd|pass|passphrase|secret|token|api[_-]?key|access[_-]?key|auth[_-]?token|client[_-]?secret|private[_-]?key"
PG_FIELD = r"(?:\\.|[^:\s\\'\x22<>])+"
PG_LINE = rf"(?:\*|[0-9_\-]*[A-Za-z.][A-Za-z0-9_.\-]*):(?:[0-9]{{4,5}}|\*):{PG_FIELD}:{PG_FIELD}:"
MYSQL = r"(?:mysql(?:dump|admin|import|check|show|pump|slap|binlog|sh)?|mariadb(?:-?dump|-admin|-import|-check|-show)?)"
ORG_KEY = (
    r"(?:(?:[A-Za-z0-9_.\-]{0,64}[._\-])?(?:(?:organi[sz]ations?|org|compan(?:y|ies)|tenants?|customers?|owners?|authors?|"
    r"contacts?|maintainers?|publishers?|vendors?|employers?)(?:[_.\-]?(?:name|title))?|"
    r"(?:client|display|full|legal|trade|business|brand)[_.\-]?name)|"
    r"(?:[A-Za-z0-9_.\-]{0,64}[._\-])?(?:connector|product|portal|brand|app|ui|site)[._\-](?:[A-Za-z0-9_.\-]{0,64}[._\-])?title)"
)
ORG_KEY_LINE = (
    r"(?:(?:[A-Za-z0-9_][A-Za-z0-9_.\-]{0,63}[._\-])?(?:(?:organi[sz]ations?|org|compan(?:y|ies)|tenants?|customers?|owners?|authors?|"
    r"contacts?|maintainers?|publishers?|vendors?|employers?)(?:[_.\-]?(?:name|title))?|"
    r"(?:client|display|full|legal|trade|business|brand)[_.\-]?name)|"
    r"(?:[A-Za-z0-9_][A-Za-z0-9_.\-]{0,63}[._\-])?(?:connector|product|portal|brand|app|ui|site)[._\-](?:[A-Za-z0-9_][A-Za-z0-9_.\-]{0,63}[._\-])?title)"
)
HOST = r"(?P<lead>^|[^A-Za-z0-9.\-_])(?:[A-Za-z0-9\-]{1,63}\.){1,10}(?:internal|corp|intranet|lan|localdomain|home\.arpa)(?P<tail>$|[^A-Za-z0-9.\-_]|\.\s)"
# kind, pattern, flags, then what Rule says.
_TABLE: list[tuple] = [
    ("private_key", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----[\s\S]*?-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----", ""),
    ("private_key", r"-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----(?:(?:\\n|\r?\n)[A-Za-z0-9+/=]{16,})*", ""),
    ("private_key", r"\bAGE-SECRET-KEY-1[QPZRY9X8GF2TVDW0S3JN54KHCE6MUA7L]{40,}", ""),
    ("password_hash", r"\$(?:2[abxy]\$[0-9]{2}\$[./A-Za-z0-9]{53}|argon2(?:id|i|d)\$[^\s'\x22<>]{20,}|[156y]\$[./A-Za-z0-9]{1,16}\$[./A-Za-z0-9]{20,})", ""),
    ("api_key", r"\bsk-ant-[A-Za-z0-9_\-]{20,}", ""),
    ("api_key", r"\bsk-(?:proj-|svcacct-)?[A-Za-z0-9_\-]{20,}", ""),
    ("api_key", r"\bgh[pousr]_[A-Za-z0-9]{30,}|\bgithub_pat_[A-Za-z0-9_]{22,}", ""),
    ("api_key", r"\bglpat-[A-Za-z0-9_\-]{20,}", ""),
    ("api_key", r"\bxox[abprs]-[A-Za-z0-9\-]{10,}|\bxapp-[A-Za-z0-9\-]{10,}", ""),
    ("api_key", r"\bAIza[0-9A-Za-z_\-]{35}", ""),
    ("api_key", r"\b[rs]k_(?:live|test)_[A-Za-z0-9]{20,}", ""),
    ("api_key", r"\bmyk_[0-9a-f]{64}\b", ""),
    ("api_key", r"\bnpm_[A-Za-z0-9]{36}\b", ""),
    ("api_key", r"\bhf_[A-Za-z0-9]{30,}", ""),
    ("api_key", r"\bSG\.[A-Za-z0-9_\-]{16,}\.[A-Za-z0-9_\-]{16,}", ""),
    ("api_key", r"\bpypi-AgEIcHlwaS5vcmc[A-Za-z0-9_\-]{40,}", ""),
    ("api_key", r"\bya29\.[A-Za-z0-9_\-]{20,}", ""),
    ("api_key", r"\b(?:dckr_pat_|dop_v1_|gsk_|xai-|r8_|lin_api_|pplx-|shp(?:at|ca|pa|ss)_|whsec_|sq0(?:atp|csp)-|glptt-|glrt-|GOCSPX-)[A-Za-z0-9_\-]{16,}", ""),
    ("api_key", r"\b(?:dapi|SK)[0-9a-f]{32}\b|\bkey-[0-9a-f]{32}\b", ""),
    ("api_key", r"\b(?:secret_[A-Za-z0-9]{43}|ntn_[A-Za-z0-9]{36,})\b", ""),
    ("api_key", r"\bhv[sbr]\.[A-Za-z0-9_\-]{24,}", ""),
    ("api_key", r"\bdp\.(?:st|pt|sa|ct)\.(?:[A-Za-z0-9_\-]{1,64}\.)?[A-Za-z0-9]{30,}", ""),
    ("api_key", r"\bpul-[0-9a-f]{40}\b", ""),
    ("api_key", r"\b(?P<lead>(?:account|sharedaccess)key\s*=)[A-Za-z0-9+/=]{20,}", "i"),
    ("aws_access_key", r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b", ""),
    ("aws_access_key", r"(?P<lead>aws_secret_access_key\s*[=:]\s*['\x22]?)[A-Za-z0-9/+=]{40}", "i"),
    ("webhook", r"https://hooks\.slack\.com/services/[A-Za-z0-9/]{20,}|https://(?:discord(?:app)?\.com)/api/webhooks/[0-9]+/[A-Za-z0-9_\-]+|https://[a-z0-9.\-]*webhook\.office\.com/[^\s'\x22<>]+", "i"),
    ("jwt", r"\beyJ[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}\.[A-Za-z0-9_\-]{8,}", ""),
    ("token", r"\b(?P<lead>bearer\s+)[A-Za-z0-9\-._~+/]{16,}=*", "i"),
    ("auth_header", r"\b(?P<lead>(?:proxy-)?authorization['\x22]?[ \t]*[:=][ \t]*['\x22]?(?P<scheme>(?:[A-Za-z][A-Za-z0-9_\-]*[ \t]+)?))(?P<value>[^\s'\x22,;<>]{6,})", "i", "auth"),
    ("auth_header", r"\b(?P<lead>(?:x-api-key|x-auth-token|x-access-token|x-amz-security-token|x-csrf-token|x-xsrf-token|x-goog-api-key|x-gitlab-token|x-github-token|private-token|api-key|apikey)['\x22]?[ \t]*[:=][ \t]*['\x22]?)(?P<value>[^\s'\x22,;<>]{4,})", "i", "reference"),
    ("cookie", r"\b(?P<lead>(?:set-)?cookie['\x22]?[ \t]*:[ \t]*['\x22]?)[^\r\n'\x22<>]{6,}", "i"),
    ("connection_string", r"\b(?P<lead>[a-z][a-z0-9+.\-]{0,30}://)[^:/\s@<>]+:[^@\s/<>]+(?P<tail>@)", "i"),
    ("connection_string", r"\b(?P<lead>[a-z][a-z0-9+.\-]{0,30}://)[A-Za-z0-9_\-.~%]{20,}(?P<tail>@)", "i"),
    ("url_secret", r"(?P<lead>[?&;](?:access_token|refresh_token|id_token|token|api[_-]?key|apikey|secret|client_secret|password|passwd|pwd|sig|signature|x-amz-signature|x-amz-security-token|x-amz-credential|private_token|sessionid|jwt)=)(?P<value>[^&\s'\x22<>#]{4,})", "i", "reference"),
    ("password_assignment", r"(?P<lead>\\?\x22(?:auth|identitytoken|registrytoken)\\?\x22[ \t]*:[ \t]*\\?\x22)(?P<value>[A-Za-z0-9+/=_.\-]{8,})(?P<tail>\\?\x22)", "i", "reference"),
    ("password_assignment", r"(?P<lead>(?P<name>(?:^|[^A-Za-z0-9_])_auth[ \t]*=[ \t]*)(?P<quote>['\x22]?))(?P<value>[^\s'\x22,;<>]{4,})", "", "assignment"),
    ("password_assignment", rf"(?P<lead>(?P<name>(?:^|[\s;&|(/]){MYSQL}(?:[ \t]+[^\s;&|]+)*?[ \t]+-p)(?P<quote>['\x22]?))(?P<value>[^\s'\x22<>]+)", "", "assignment"),
    ("password_assignment", r"(?P<lead>(?P<name>(?:^|[\s;&|(/])sshpass(?:[ \t]+-v)*[ \t]+-p[ \t]*)(?P<quote>['\x22]?))(?P<value>[^\s'\x22<>]+)", "", "assignment"),
    ("password_assignment", r"(?P<lead>(?P<name>(?:^|\s)(?:machine[ \t]+[^\s]+|default)(?:\s+(?:login|account)[ \t]+[^\s]+)+\s+password[ \t]+)(?P<quote>['\x22]?))(?P<value>[^\s'\x22<>]+)", "", "assignment"),
    ("password_assignment", rf"(?P<lead>^[ \t]*{PG_LINE})(?P<value>{PG_FIELD})(?P<tail>[ \t]*\r?$)", "m", "reference"),
    ("password_assignment", rf"(?P<lead>(?:^|[\s'\x22]){PG_LINE})(?P<value>{PG_FIELD})(?P<tail>[ \t]*['\x22]?[ \t]*>{{1,2}}[ \t]*[^\s]*\.pgpass)", "", "reference"),
    ("password_assignment", rf"(?P<lead>(?P<name>\$?\b[\w.\-]{{0,64}}(?:{STRONG})[\w.\-]{{0,64}}['\x22]?[ \t]*[=:][ \t]*)(?P<quote>['\x22]?))(?P<value>[^\s'\x22,;<>]{{4,}})", "i", "assignment"),
    ("password_assignment", rf"(?P<lead>(?P<name>\$?\b[\w.\-]{{0,64}}(?:{WEAK})[\w.\-]{{0,64}}['\x22]?[ \t]*[=:][ \t]*)(?P<quote>['\x22]?))(?P<value>[^\s'\x22,;<>]{{12,}})", "i", "assignment"),
    ("password_assignment", rf"(?P<lead>(?P<name>(?:^|\s)--?(?:{OPTIONS})(?:=|[ \t]+))(?P<quote>['\x22]?))(?P<value>[^\s'\x22<>\-][^\s'\x22<>]{{2,}})", "i", "assignment"),
    ("email", r"\b[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9.\-]{1,255}\.[A-Za-z]{2,}\b", "", "not_git"),
    ("ip", r"\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b", "", "ip"),
    ("ipv6", r"\b(?:[0-9A-Fa-f]{1,4}:){7}[0-9A-Fa-f]{1,4}\b|\b(?:[0-9A-Fa-f]{1,4}:){1,5}:(?:[0-9A-Fa-f]{1,4}:){0,4}[0-9A-Fa-f]{1,4}\b", ""),
    ("mac", r"\b(?:[0-9A-Fa-f]{2}[:-]){5}[0-9A-Fa-f]{2}\b", ""),
    ("hostname", r"(?P<lead>://|@)(?:[A-Za-z0-9\-]{1,63}\.){1,10}(?:internal|corp|intranet|lan|localdomain|home\.arpa|local)\b", "i"),
    # Twice: a match takes the character after a name, which would hide a name that follows it.
    ("hostname", HOST, "i"),
    ("hostname", HOST, "i"),
    ("phone", r"\+[0-9]{1,3}[\s.\-]?\(?[0-9]{2,4}\)?[\s.\-]?[0-9]{3,4}[\s.\-]?[0-9]{3,4}\b", ""),
    ("card", r"\b[3-6](?:[ \-]?[0-9]){12,18}\b", "", "card"),
    ("home_path", r"(?P<lead>/home/|/Users/)[^/\s'\x22<>]+", ""),
    ("home_path", r"(?P<lead>[a-z]:\\Users\\)[^\\\s'\x22<>]+", "i"),
    ("org", rf"(?P<lead>(?:^|[^A-Za-z0-9_.\-]){ORG_KEY}['\x22]?[ \t]*[=:][ \t]*['\x22])(?P<value>[^'\x22\r\n]{{2,120}})(?P<tail>['\x22])", "i", "org"),
    ("org", rf"(?P<lead>^[ \t]*(?:-[ \t]+)?{ORG_KEY_LINE}['\x22]?[ \t]*[=:][ \t]*)(?P<value>[^\s'\x22<>][^\r\n]*?)(?P<tail>[ \t]*\r?$)", "im", "org"),
    ("org", rf"(?P<lead>(?:^|[^A-Za-z0-9_.\-]){ORG_KEY}['\x22]?[ \t]*[=:][ \t]*)(?P<value>[^\s'\x22<>,;]{{2,80}})", "i", "inline_org"),
]
#: What a redacted value of a kind reads, where it isn't the kind.
LABELS = {"password_assignment": "<redacted:secret>", "home_path": "<user>"}
# --- End of the fixed values. ----------------------------------------------------------------------------------------

def is_reference(value: str) -> bool:
    """Whether a value only points to a secret, or plainly is none."""
    low = value.lower()
    if low in LITERALS or ENV_REFERENCE.match(value) or CODE_REFERENCE.match(value):
        return True
    if low.startswith(("http://", "https://", "./", "../", "~/", "file:", "env:", "${", "$(", "{", "[")):
        return True
    return (value[:1] == "/" and value.count("/") > 1) or not value.strip("*xX.#-_")


def luhn(digits: str) -> bool:
    twice = [int(d) * 2 for d in digits[-2::-2]]
    return (sum(map(int, digits[-1::-2])) + sum(d - 9 * (d > 9) for d in twice)) % 10 == 0


def _assigned(m: re.Match) -> bool:
    name, value = m["name"], m["value"]
    expands = name.startswith("$") and name.rstrip().endswith(":")
    prose = not m["quote"] and value.lower() in PROSE and re.search(r":[ \t]+$", name)
    return not (expands or prose or is_reference(value))


def _organisation(m: re.Match) -> bool:
    value, low = m["value"], m["value"].lower()
    plain = low in ORG_PLAIN or low.startswith(("your", "example", "sample", "my-", "my_"))
    return not (plain or value[:1] == "<" or not any(map(str.isalpha, value)) or TYPE_ANNOTATION.match(value) or is_reference(value))


def _card(m: re.Match) -> bool:
    digits = re.sub("[^0-9]", "", m[0])
    return 13 <= len(digits) <= 19 and luhn(digits)


#: Whether a match is to be redacted.
GUARDS: dict[str, Callable[[re.Match], bool]] = {
    "reference": lambda m: not is_reference(m["value"]),
    "assignment": _assigned,
    "auth": lambda m: not is_reference(m["value"]) and (bool(m["scheme"]) or m["value"].lower() not in SCHEMES),
    "not_git": lambda m: not m[0].startswith("git@"),
    "ip": lambda m: m[0] not in HARMLESS_IPS and all(int(part) < 256 for part in m[0].split(".")),
    "card": _card,
    "org": _organisation,
    "inline_org": lambda m: _organisation(m) and not set(m["value"]) & set("${}[]()*\\"),
}


#: A set of so many characters or fewer is spelled out as literals.
MOST_CHOICES = 24
#: Letters that Python takes for others where case is ignored, though their lower case differs: such texts are read by every rule.
ODD_LETTERS = re.compile("[\u0130\u0131\u017f\u212a]")


def literals(parsed) -> frozenset[str] | None:
    """Of a parsed pattern: lower-case strings one of which is in every match, the longest found; None if there are none."""
    best: frozenset[str] | None = None
    run = ""

    def offer(found: frozenset[str] | None) -> None:
        nonlocal best
        worth = lambda x: (min(map(len, x)), -len(x))
        if found and all(found) and (best is None or worth(found) > worth(best)):
            best = found

    for op, arg in parsed:
        name = str(op)
        if name == "LITERAL":
            run += chr(arg).lower()
            continue
        offer(frozenset({run}) if run else None)
        run = ""
        if name == "SUBPATTERN":
            offer(literals(arg[-1]))
        elif name in ("MAX_REPEAT", "MIN_REPEAT") and arg[0] > 0:
            offer(literals(arg[2]))
        elif name == "BRANCH":
            each = [literals(x) for x in arg[1]]
            offer(frozenset().union(*each) if all(each) else None)
        elif name == "IN" and not any(str(kind) in ("NEGATE", "CATEGORY") for kind, _ in arg):
            chars = {chr(c).lower() for kind, x in arg for c in (range(x[0], x[1] + 1) if str(kind) == "RANGE" else [x])}
            offer(frozenset(chars) if len(chars) <= MOST_CHOICES else None)
    offer(frozenset({run}) if run else None)
    return best


@dataclass(frozen=True)
class Rule:
    """A value is what a pattern matches between its groups lead and tail, both kept; the guard may refuse it."""

    kind: str
    pattern: re.Pattern
    guard: Callable[[re.Match], bool] | None

    @cached_property
    def needs(self) -> frozenset[str]:
        """Lower-case strings one of which is in every match."""
        return literals(re._parser.parse(self.pattern.pattern, self.pattern.flags)) or frozenset({""})

    def apply(self, text: str, counts: dict[str, int]) -> str:
        label = LABELS.get(self.kind, f"<redacted:{self.kind}>")
        groups = self.pattern.groupindex
        out, at = [], 0
        for m in self.pattern.finditer(text):
            if self.guard is None or self.guard(m):
                start = m.end("lead") if "lead" in groups else m.start()
                stop = m.start("tail") if "tail" in groups else m.end()
                out += [text[at:start], label]
                at = stop
                counts[self.kind] = counts.get(self.kind, 0) + 1
        return "".join([*out, text[at:]]) if out else text


RULES = [Rule(kind, re.compile(pattern, sum({"i": re.I, "m": re.M}[f] for f in flags)), GUARDS[guard[0]] if guard else None) for kind, pattern, flags, *guard in _TABLE]
KINDS = sorted({r.kind for r in RULES})


def redact_text(text: str, keep_network: bool = False, keep_personal: bool = False) -> tuple[str, dict[str, int]]:
    """A text without secrets and personal data, and how many values of each kind it held."""
    kept = (NETWORK if keep_network else frozenset()) | (PERSONAL if keep_personal else frozenset())
    counts: dict[str, int] = {}
    low = None if ODD_LETTERS.search(text) else text.lower()
    for rule in RULES:
        if rule.kind not in kept and (low is None or any(x in low for x in rule.needs)):
            new = rule.apply(text, counts)
            if low is not None and new is not text:
                low = new.lower()
            text = new
    return text, counts


def _needed() -> str:
    """A pattern that finds some rule's literal, for rows that need the rules at all."""
    every = sorted({x for r in RULES for x in r.needs})
    shortest = [x for x in every if not any(y != x and y in x for y in every)]
    return "(?iu)" + "|".join(["[\\u0130\\u0131\\u017f\\u212a]", *("".join(c if c.isalnum() else f"\\{c}" for c in x) for x in shortest)])


_OUT = T.StructType([T.StructField("text", T.StringType()), T.StructField("kinds", T.MapType(T.StringType(), T.LongType()))])


def redact(text: Column, keep_network: bool = False, keep_personal: bool = False) -> Column:
    """struct<text, kinds map<string, long>>. A private store may keep its network's names, or personal data."""

    @F.pandas_udf(_OUT)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            found = [(None, None) if t is None else redact_text(t, keep_network, keep_personal) for t in batch]
            yield pd.DataFrame({"text": [t for t, _ in found], "kinds": [k for _, k in found]})

    some = text.rlike(_needed())
    nothing = F.create_map().cast("map<string,bigint>")
    done = run(F.when(some, text))
    return F.when(text.isNotNull(), F.struct(F.when(some, done["text"]).otherwise(text).alias("text"), F.when(some, done["kinds"]).otherwise(nothing).alias("kinds")))


def _has_text(kind: T.DataType) -> bool:
    if isinstance(kind, T.StructType):
        return any(_has_text(f.dataType) for f in kind.fields)
    inner = kind.elementType if isinstance(kind, T.ArrayType) else kind.valueType if isinstance(kind, T.MapType) else None
    return _has_text(inner) if inner is not None else isinstance(kind, T.StringType)


def _texts_of(value: Column, kind: T.DataType) -> tuple[Column, T.DataType]:
    """The strings of a value in its own shape, and that shape: arrays, structs of the fields that hold some, map values as arrays."""
    if isinstance(kind, T.StructType):
        parts = [(f.name, *_texts_of(value[f.name], f.dataType)) for f in kind.fields if _has_text(f.dataType)]
        shape = T.StructType([T.StructField(f"f{i}", k) for i, (_, _, k) in enumerate(parts)])
        return F.when(value.isNotNull(), F.struct(*(c.alias(f"f{i}") for i, (_, c, _) in enumerate(parts)))), shape
    if isinstance(kind, (T.ArrayType, T.MapType)):
        inner, items = (kind.elementType, value) if isinstance(kind, T.ArrayType) else (kind.valueType, F.map_values(value))
        shape: list[T.DataType] = []

        def one(x: Column) -> Column:
            found, k = _texts_of(x, inner)
            shape.append(k)
            return found

        return F.transform(items, one), T.ArrayType(shape[0])
    return value, T.StringType()


def _put_back(value: Column, texts: Column, kind: T.DataType) -> Column:
    """The value with other strings; all else is its own."""
    if isinstance(kind, T.StructType):
        names = [f.name for f in kind.fields if _has_text(f.dataType)]
        field = lambda f: _put_back(value[f.name], texts[f"f{names.index(f.name)}"], f.dataType) if f.name in names else value[f.name]
        return F.when(value.isNotNull(), F.struct(*(field(f).alias(f.name) for f in kind.fields)))
    if isinstance(kind, T.ArrayType):
        return F.zip_with(value, texts, lambda v, t: _put_back(v, t, kind.elementType))
    if isinstance(kind, T.MapType):
        return F.map_from_arrays(F.map_keys(value), F.zip_with(F.map_values(value), texts, lambda v, t: _put_back(v, t, kind.valueType)))
    return texts


def redact_leaves(value: Column, kind: T.DataType, **policy: bool) -> Column:
    """A value of any type with every string in it redacted: in arrays, structs and map values, by its schema. Map keys and all that
    is no string stay what they are.

    Spark runs no Arrow function inside a lambda, so of arrays and maps the strings alone, in the value's shape, go to it as JSON
    and are put back in their places."""
    if isinstance(kind, T.StringType):
        return redact(value, **policy)["text"]
    if isinstance(kind, T.StructType):
        return F.when(value.isNotNull(), F.struct(*(redact_leaves(value[f.name], f.dataType, **policy).alias(f.name) for f in kind.fields)))
    if not _has_text(kind):
        return value

    @F.pandas_udf(T.StringType())
    def run(batch: pd.Series) -> pd.Series:
        def walk(x):
            if isinstance(x, str):
                return redact_text(x, **policy)[0]
            if isinstance(x, list):
                return [walk(y) for y in x]
            return {k: walk(v) for k, v in x.items()} if isinstance(x, dict) else x

        return batch.map(lambda t: json.dumps(walk(json.loads(t)), ensure_ascii=False), na_action="ignore")

    texts, shape = _texts_of(value, kind)
    return _put_back(value, F.from_json(run(F.to_json(texts)), shape), kind)


def merge_counts(a: Column, b: Column) -> Column:
    """The sum of two maps of counts."""
    return F.map_zip_with(a, b, lambda k, x, y: F.coalesce(x, F.lit(0)) + F.coalesce(y, F.lit(0)))


_WORD = re.compile(r"[^\W\d_]+")


def _begins(text: str, at: int) -> bool:
    """Whether a sentence or line begins at a place: only white space before it, however much, up to a line's end or a sentence's."""
    before = at
    while before and text[before - 1].isspace():
        before -= 1
    gap = text[before:at]
    return at == 0 or "\n" in gap or bool(gap and before and text[before - 1] in ".!?:")


def names_in(texts: list[str], limit: int = 10) -> list[str]:
    """Runs of two or more capitalised words one space apart, without a sentence's first word: for a person to look at."""
    found: dict[str, None] = {}
    for text in texts:
        runs: list[list[re.Match]] = [[]]
        for m in _WORD.finditer(text):
            capital = len(m[0]) > 1 and m[0][0].lower() != m[0][0]
            if runs[-1] and not (capital and text[runs[-1][-1].end() : m.start()] == " "):
                runs.append([])
            if capital:
                runs[-1].append(m)
        for run in runs:
            if run and _begins(text, run[0].start()):
                run = run[1:]
            if len(run) > 1:
                found[text[run[0].start() : run[-1].end()]] = None
    return list(found)[:limit]


@F.pandas_udf(T.ArrayType(T.StringType()))
def possible_names(text: pd.Series) -> pd.Series:
    return text.map(lambda t: names_in([t]), na_action="ignore")
