"""Lines of output that look like errors, and short texts: column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# The shapes of error lines, of lines of output known to be a failure's, of lines that only point to
# help, of a tool's complaint about how it was called, and of a shell that could not run a program.
ERROR_LINE = "|".join([
    r"^\s*(?:ERROR|FATAL|CRITICAL|PANIC)\b\s*[:\]\[]",
    r"^\s*(?:Error|Fatal|fatal|error)\s*:",
    r"^\s*[\w.+-]+:\s*(?:error|fatal)\s*:",
    r"^\s*Traceback \(most recent call last\)",
    r"^\s*(?:[\w$]+\.)*\w*(?:Error|Exception)(?::|\s+in\b)",
    r"^\s*npm (?:ERR!|error\b)",
    r"^\s*error\[E\d+\]",
    r"^\s*panic:",
    r"command terminated with exit code [1-9]",
])
FAILURE_LINE = "|".join([
    r"^\s*\[(?:ERROR|FATAL)\]",
    r"^\s*(?:FAILED|FAIL)\b",
    r"^\s*BUILD (?:FAILURE|FAILED)",
    r"^\s*make(?:\[\d+\])?:\s+\*\*\*",
    r"^\s*Caused by:",
    r"\bcannot find symbol\b",
    r":\s*(?:command )?not found$",
    r":\s*(?:No such file or directory|Permission denied)$",
])
HELP_LINE = r"(?i)\[Help \d+\]|re-run maven|for more information about the errors|to see the full stack trace|^\[(?:ERROR|FATAL)\]\s*$"
USAGE_LINE = r"(?im)\b(?:unknown (?:shorthand )?flag|unknown option|unrecognized option|invalid option|illegal option)\b|^\s*usage:"
SHELL_FAILURE = r"(?m)(?:^|\n)[^\n]*:\s*(?:command )?not found\s*$|(?:^|\n)[^\n]*:\s*(?:No such file or directory|Permission denied)\s*$"
WORDS = r"[A-Za-z]{2,}[:,]?\s+['\"]?[A-Za-z]{2,}"
LINE_CHARS = 240


def once(value: Column, of: Callable[[Column], Column]) -> Column:
    """An expression of a value that is evaluated once a row, however often the expression names it."""
    return F.element_at(F.transform(F.array(value), of), 1)


def _lines(text: Column) -> Column:
    return F.filter(F.transform(F.split(text, r"\r?\n"), lambda x: F.regexp_replace(x, r"^\s+|\s+$", "")), lambda x: x != "")


def _short(line: Column) -> Column:
    return F.substring(F.regexp_replace(F.coalesce(line, F.lit("")), r"\s+", " "), 1, LINE_CHARS)


def last_error_line(text: Column, loose: bool = False) -> Column:
    """The last line in the shape of an error, or empty; loose for output of a command that failed."""
    fits = lambda x: x.rlike(ERROR_LINE) | (F.lit(loose) & x.rlike(FAILURE_LINE) & ~x.rlike(HELP_LINE))
    return F.when(text.isNotNull(), _short(F.try_element_at(F.filter(_lines(text), fits), F.lit(-1))))


def last_line(text: Column) -> Column:
    """The last line that says something in words, or empty."""
    some = F.filter(F.transform(_lines(text), lambda x: F.regexp_replace(x, r"\s+", " ")), lambda x: (F.length(x) >= 8) & x.rlike(WORDS))
    return F.when(text.isNotNull(), _short(F.try_element_at(some, F.lit(-1))))


def tool_message(line: Column) -> Column:
    """A line in the shape `program: what happened` that is no data such as key=value; else empty."""
    return F.when(line.rlike(r"^[\w./-]+:\s+\S") & ~line.rlike(r"\w=\S"), line).otherwise("")


# Envelope tags are defused in any case and spacing; requests that only go on with an earlier one.
FOLLOW_UP = (
    r"(?i)^(?:s[ií]|no|ok(?:ay)?|vale|venga|dale|perfecto|gracias|thanks?(?: you)?|yes|yep|go(?: ahead| on)?|adelante|contin[uú]a|continue|"
    r"sigue|hazlo|do it|listo|done|correcto|right|exacto)\b[\s.!,]*$"
)
WRAPPERS = r"(?s)<(ide_opened_file|ide_selection|ide_diagnostics|system-reminder|command-[a-z-]+|local-command-[a-z-]+)>.*?</\1>"


def clip(text: Column, most: int) -> Column:
    """One line, white space collapsed, at most so many characters, the last an ellipsis where it is cut."""
    t = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), r"\s+", " "))
    return F.when(F.length(t) <= most, t).otherwise(F.concat(F.substring(t, 1, most - 1), F.lit("…")))


def defused(text: Column, tag: str) -> Column:
    """Look-alikes of an envelope's tags lose their bracket, so content can neither close nor fake it."""
    return F.regexp_replace(text, rf"(?i)<(\s*/?\s*{tag})", "‹$1")


def fenced(text: Column, most: int, language: str = "") -> Column:
    """A fenced block whose fence is longer than any run of backticks inside."""
    body = F.trim(F.coalesce(text, F.lit("")))
    body = F.when(F.length(body) <= most, body).otherwise(F.concat(F.substring(body, 1, most - 1), F.lit("…")))
    longest = F.coalesce(F.array_max(F.transform(F.regexp_extract_all(body, F.lit("(`+)"), F.lit(1)), F.length)), F.lit(0))
    fence = F.repeat(F.lit("`"), F.greatest(F.lit(3), longest + 1))
    return F.concat(fence, F.lit(language + "\n"), body, F.lit("\n"), fence)


def compact(value: Column) -> Column:
    """41200 -> 41.2k; null and what isn't finite -> a dash."""
    v = value.cast("double")
    short = lambda by, unit: F.concat(F.replace(F.format_number(v / by, 1), F.lit(","), F.lit("")), F.lit(unit))
    whole = F.when(v == F.floor(v), F.floor(v).cast("string")).otherwise(v.cast("string"))
    return F.when(v.isNull() | F.isnan(v) | (F.abs(v) == float("inf")), "—").when(v >= 1e9, short(1e9, "B")).when(v >= 1e6, short(1e6, "M")).when(v >= 1e3, short(1e3, "k")).otherwise(whole)


def ago(then: Column, now: Column) -> Column:
    """How long before now, in seconds, minutes, hours or days; at least a second."""
    s = F.greatest(F.lit(1), F.round((F.unix_micros(now.cast("timestamp")) - F.unix_micros(then.cast("timestamp"))) / 1e6).cast("long"))
    n = lambda by, unit: F.concat(F.round(s / by).cast("long").cast("string"), F.lit(f" {unit} ago"))
    return F.when(s < 60, n(1, "s")).when(s < 3600, n(60, "min")).when(s < 86400, n(3600, "h")).when(s.isNotNull(), n(86400, "d"))


def personal_text(prompt: Column) -> Column:
    """What a person wrote, without what their client wraps around it; empty for a turn the client began."""
    text = F.regexp_replace(F.regexp_replace(prompt, WRAPPERS, " "), r"</?pasted_content[^>]*>", " ")
    return F.when(prompt.rlike(r"^\s*<task-notification>"), "").otherwise(F.coalesce(text, F.lit("")))


def task_of(prompt: Column) -> Column:
    """The request worth looking up; empty for follow-ups, slash commands and what is too short to name a task."""
    text = personal_text(prompt)
    tagged = F.regexp_extract(text, r"(?s)<USER_REQUEST>(.*?)(?:</USER_REQUEST>|$)", 1)
    text = F.when(F.contains(text, F.lit("<USER_REQUEST>")), tagged).otherwise(text)
    text = F.trim(F.regexp_replace(text, r"\s+", " "))
    good = ~F.startswith(text, F.lit("/")) & ~text.rlike(FOLLOW_UP) & (F.length(text) >= 15) & (F.size(F.split(text, " ")) >= 3)
    return F.when(good, F.substring(text, 1, 1500)).otherwise("")


def safe_id(value: Column) -> Column:
    return F.substring(F.regexp_replace(value, "[^0-9a-fA-F-]", ""), 1, 36)


def safe_fingerprint(value: Column) -> Column:
    return F.when(value.rlike(r"^fp[0-9]+_[0-9a-f]{16}\z"), value).otherwise("invalid")


def error_line(error_type: Column, message: Column) -> Column:
    """`Type: message`, the type once."""
    kind, text = clip(error_type, 120), clip(message, 300)
    head = F.concat(kind, F.lit(":"))
    return F.when(text == "", kind).when(F.startswith(text, head), text).otherwise(F.concat_ws(" ", head, text))


def keywords(query: Column) -> Column:
    """Lower-case words of more than two characters."""
    return F.filter(F.split(F.lower(F.trim(query)), "[^a-z0-9_.]+"), lambda w: F.length(w) > 2)


def keyword_match(words: Column, text: Column) -> Column:
    """Whether at least two of the words (all, if there are fewer) are substrings of a text."""
    low = F.lower(text)
    return F.size(F.filter(words, lambda w: F.contains(low, w))) >= F.least(F.lit(2), F.size(words))
