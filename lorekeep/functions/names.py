"""Names that a normalised key erases (module paths, repositories, images), as column expressions.

Two messages with one key are about different things if both spell such names and share none.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# What parts a text into tokens, and the file extensions that end a file and not a name.
PARTS = r"[\s'\"`()\[\]<>,;=]+"
EXTENSIONS = (
    "py js mjs cjs ts tsx jsx rs go java kt c h cc cpp hpp cs rb php json yaml yml toml lock xml csv txt md ini cfg conf sh log "
    "html css sql whl gz zip tar so dll exe pem crt key"
).split()
MOST_SEGMENTS = 8

#: Cuts in order: scheme, query, credentials, version, punctuation, .git, and a tag or line number after the last slash.
_CUTS = [
    (r"^.*?://", ""),
    (r"[?#].*$", ""),
    (r"^[^/@]+@(?=.*/)", ""),
    (r"^(.*/.*)@[^/@]*$", "$1"),
    (r"[:./]+$", ""),
    (r"[:./]*\.git$", ""),
    (r"^(.*/[^/:]*):[^/]*$", "$1"),
]


def name_of(token: Column) -> Column:
    """The name a token spells, or null."""
    t = F.lower(token)
    for pattern, to in _CUTS:
        t = F.regexp_replace(t, pattern, to)
    segments = F.split(t, "/")
    host = F.substring_index(segments[0], ":", 1)
    like_host = (host == "localhost") | host.rlike(r"\.[a-z]{2,}$")
    pair = (F.size(segments) == 2) & ~F.contains(segments[0], F.lit("."))
    file = F.regexp_extract(t, r"\.([^./]*)$", 1).isin(EXTENSIONS) & F.element_at(segments, -1).rlike(r"\.")
    good = t.rlike("^[a-z0-9][^/]*/") & (F.size(segments) <= MOST_SEGMENTS) & ~F.array_contains(segments, "") & ~file & (like_host | pair) & t.rlike("[a-z]")
    return F.when(good, t)


def placeholder_names(text: Column) -> Column:
    """The distinct names in a text, sorted; null text has none."""
    tokens = F.split(F.coalesce(text, F.lit("")), PARTS)
    return F.array_sort(F.array_distinct(F.filter(F.transform(tokens, name_of), lambda n: n.isNotNull())))


def share_a_name(a: Column, b: Column) -> Column:
    last = lambda n: F.substring_index(n, "/", -1)
    same = lambda x, y: (x == y) | F.startswith(x, F.concat(y, F.lit("/"))) | F.startswith(y, F.concat(x, F.lit("/"))) | (last(x) == last(y))
    return F.exists(a, lambda x: F.exists(b, lambda y: same(x, y)))


def names_conflict(asked: Column, have: Column) -> Column:
    """Over two arrays of names: whether both have some and share none."""
    return (F.size(asked) > 0) & (F.size(have) > 0) & ~share_a_name(asked, have)
