"""All queries over the driver's tables, and SQL that gives the same rows, by name.

The tables stand in for entries, reports, searches and texts: events are reports (purchase: worked, click: partially
worked, error: failed) on the entry `user_id` by the agent `props.k`, views are searches, signups are entries laid.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import error_keys, lines, names, redaction, versions
from ..operators import publish, search, stats, strength
from ..streaming import sessions as machine
from . import activity, rules

QUERIES: dict = activity.QUERIES | rules.QUERIES
SQL: dict = activity.SQL | rules.SQL
LIVE_DAYS = 30


def query(sql: str | None = None):
    def register(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return register


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


OUTCOME = {"purchase": "worked", "click": "partially_worked", "error": "failed", "view": "not_applicable"}
_OUTCOME_SQL = "CASE event_type WHEN 'purchase' THEN 'worked' WHEN 'click' THEN 'partially_worked' WHEN 'error' THEN 'failed' WHEN 'view' THEN 'not_applicable' END"
_K_SQL = "regexp_extract(props, '\"k\": *([0-9]+)', 1)::BIGINT"
_REPORTS_SQL = f"r AS (SELECT event_id, ts, user_id, {_K_SQL} AS k, {_OUTCOME_SQL} AS outcome, value FROM events)"
_STRENGTH_SQL = "greatest(0, (p + 3.8416/(2*n) - 1.96*sqrt(greatest(0, p*(1-p)/n + 3.8416/(4*n*n)))) / (1 + 3.8416/n)) * pow(0.5, days/90)"


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    events = table(spark, sf_dir, "events")
    outcome = F.create_map(*(F.lit(x) for pair in OUTCOME.items() for x in pair))[F.col("event_type")]
    agent = F.regexp_extract("props", '"k": *([0-9]+)', 1).cast("long")
    return events.select("event_id", F.col("ts").alias("at"), "user_id", agent.alias("agent"), outcome.alias("outcome"), "value", "event_type")


def as_of(rows: DataFrame, at: str = "at") -> DataFrame:
    """One row: the latest time."""
    return rows.agg(F.max(at).alias("as_of"))


@query(f"""
WITH {_REPORTS_SQL}, t AS (SELECT max(ts) AS now FROM events),
c AS (SELECT user_id, count(*) FILTER (outcome = 'worked') AS worked, count(*) FILTER (outcome = 'partially_worked') AS partially_worked,
  count(*) FILTER (outcome = 'failed') AS failed, coalesce(max(ts) FILTER (outcome = 'worked'), min(ts)) AS since FROM r GROUP BY user_id),
s AS (SELECT *, (worked + partially_worked + failed + 2)::DOUBLE AS n, (worked + 0.5*partially_worked + 1.4)/(worked + partially_worked + failed + 2) AS p,
  greatest(0, (epoch_us(now) - epoch_us(since))/8.64e10) AS days, user_id % 10 AS topic FROM c, t),
v AS (SELECT topic, user_id, worked, partially_worked, failed, round({_STRENGTH_SQL}, 6) AS strength FROM s)
SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY topic ORDER BY strength DESC, user_id) AS rank FROM v) WHERE rank <= 5
""")
def strength_topk(spark, sf_dir):
    """The five strongest entries of each key."""
    rows = reports(spark, sf_dir)
    found = _strengths(rows)
    found = found.select((F.col("user_id") % 10).alias("topic"), "user_id", "worked", "partially_worked", "failed", F.round("strength", 6).alias("strength"))
    return strength.top_per_key(found, "topic", 5, F.desc("strength"), F.asc("user_id"))


def _strengths(rows: DataFrame) -> DataFrame:
    counts = strength.outcome_counts(rows, "user_id").join(F.broadcast(as_of(rows)))
    days = strength.days_between(F.col("as_of"), F.coalesce("last_success", "first_at"))
    return counts.withColumn("strength", strength.strength(F.col("worked"), F.col("partially_worked"), F.col("failed"), days))


@query(f"""
WITH {_REPORTS_SQL}, d AS (SELECT user_id, date_trunc('day', ts)::TIMESTAMP AS day, count(*) FILTER (outcome = 'worked') AS w, count(*) FILTER (outcome = 'partially_worked') AS q,
  count(*) FILTER (outcome = 'failed') AS f, max(ts) FILTER (outcome = 'worked') AS s, min(ts) AS a FROM r GROUP BY ALL),
c AS (SELECT user_id, day, sum(w) OVER o AS worked, sum(q) OVER o AS partially_worked, sum(f) OVER o AS failed, max(s) OVER o AS s, min(a) OVER o AS a FROM d
  WINDOW o AS (PARTITION BY user_id ORDER BY day)),
x AS (SELECT *, (worked + partially_worked + failed + 2)::DOUBLE AS n, (worked + 0.5*partially_worked + 1.4)/(worked + partially_worked + failed + 2) AS p,
  greatest(0, (epoch_us(day + INTERVAL 1 DAY) - epoch_us(coalesce(s, a)))/8.64e10) AS days FROM c)
SELECT user_id, day, worked::BIGINT AS worked, partially_worked::BIGINT AS partially_worked, failed::BIGINT AS failed, round({_STRENGTH_SQL}, 6) AS strength FROM x
""")
def strength_curve(spark, sf_dir):
    return strength.strength_curve(reports(spark, sf_dir), "user_id").withColumn("strength", F.round("strength", 6))


@query(f"""
WITH {_REPORTS_SQL} SELECT user_id, count(*) FILTER (outcome = 'worked') AS worked, count(*) FILTER (outcome = 'partially_worked') AS partially_worked,
  count(*) FILTER (outcome = 'failed') AS failed, count(*) FILTER (outcome = 'not_applicable') AS not_applicable,
  count(*) FILTER (outcome IN ('worked', 'partially_worked', 'failed')) AS followed,
  coalesce(max(ts) FILTER (outcome = 'worked'), min(ts)) AS last_confirmed_at FROM r GROUP BY user_id
""")
def outcome_counts(spark, sf_dir):
    found = strength.outcome_counts(reports(spark, sf_dir), "user_id")
    return found.select("user_id", *strength.OUTCOMES, "followed", F.coalesce("last_success", "first_at").alias("last_confirmed_at"))


@query(f"WITH {_REPORTS_SQL} SELECT coalesce(sum(least((value*1000)::BIGINT, 200000)), 0)::BIGINT AS tokens_saved, count(*) AS reports FROM r WHERE outcome = 'worked'")
def tokens_saved(spark, sf_dir):
    return strength.tokens_saved(reports(spark, sf_dir).withColumn("tokens_spent", F.round(F.col("value") * 1000).cast("long")))


@query(f"""
WITH {_REPORTS_SQL}, t AS (SELECT max(ts) AS now FROM events)
SELECT count(DISTINCT k) AS agents FROM r, t WHERE ts > now - INTERVAL 1 DAY AND ts <= now
""")
def distinct_agents_24h(spark, sf_dir):
    rows = reports(spark, sf_dir)
    timed = rows.join(F.broadcast(as_of(rows)))
    return stats.distinct_agents(timed, F.col("as_of") - F.expr("INTERVAL 1 DAY"), F.col("as_of"))


@query(f"""
WITH b AS (SELECT 'model' || ({_K_SQL} % 12) AS model, count(*) FILTER (event_type = 'signup') AS laid, count(*) FILTER (event_type = 'click') AS rediscovered,
  count(*) FILTER (event_type = 'purchase') AS confirmed, count(*) FILTER (event_type = 'error') AS failed FROM events WHERE event_id % 50 <> 0 GROUP BY 1),
s AS (SELECT *, laid + rediscovered + confirmed AS score FROM b)
SELECT *, round(score / max(score) OVER (), 6) AS bar, row_number() OVER (ORDER BY score DESC, model) AS rank FROM s
""")
def model_board(spark, sf_dir):
    kind = F.create_map(*map(F.lit, ("signup", "laid", "click", "rediscovered", "purchase", "confirmed", "error", "failed")))[F.col("event_type")]
    rows = reports(spark, sf_dir).select(F.concat(F.lit("model"), F.col("agent") % 12).alias("model"), kind.alias("kind"), (F.col("event_id") % 50 == 0).alias("seed"))
    return stats.model_board(rows).withColumn("bar", F.round("bar", 6))


@query(f"SELECT 'error' || {_K_SQL} AS label, count(*) AS searches FROM events WHERE event_type = 'view' GROUP BY 1 ORDER BY searches DESC, label LIMIT 10")
def hot_labels(spark, sf_dir):
    rows = reports(spark, sf_dir).where("event_type = 'view'").select(F.concat(F.lit("error"), "agent").alias("label"))
    return stats.hot_labels(rows, 10)


@query("""
SELECT 'fp' || (user_id % 40) AS fingerprint, count(*) AS searches, count(DISTINCT user_id) AS agents FROM events
WHERE event_type IN ('view', 'error') AND value < 40 GROUP BY 1 HAVING count(DISTINCT user_id) >= 3 ORDER BY searches DESC, fingerprint LIMIT 8
""")
def demand(spark, sf_dir):
    rows = reports(spark, sf_dir).where(F.col("event_type").isin("view", "error"))
    return stats.demand(rows.select(F.concat(F.lit("fp"), F.col("user_id") % 40).alias("fingerprint"), F.col("user_id").alias("agent"), (F.col("value") >= 40).alias("answered")))


_DAILY = f"""(SELECT strftime(ts, '%Y-%m-%d') AS day, 'model' || ({_K_SQL} % 12) AS model, 'frame' || (user_id % 3) AS framework,
  CASE event_type WHEN 'signup' THEN 'laid' WHEN 'purchase' THEN 'worked' WHEN 'click' THEN 'partially_worked' WHEN 'error' THEN 'failed' ELSE 'searched' END AS kind FROM events)"""


@query(f"""
SELECT CASE grouping_id(day, model, framework) WHEN 3 THEN 'total' WHEN 1 THEN 'model' ELSE 'framework' END AS level, day, model, framework,
  count(*) FILTER (kind = 'laid') AS laid, count(*) FILTER (kind = 'worked') AS worked, count(*) FILTER (kind = 'partially_worked') AS partially_worked,
  count(*) FILTER (kind = 'failed') AS failed, count(*) FILTER (kind = 'searched') AS searched, count(*) AS events
FROM {_DAILY} GROUP BY GROUPING SETS ((day), (day, model), (day, framework))
""")
def analytics_daily(spark, sf_dir):
    kind = F.create_map(*map(F.lit, ("signup", "laid", "purchase", "worked", "click", "partially_worked", "error", "failed", "view", "searched")))[F.col("event_type")]
    rows = reports(spark, sf_dir)
    rows = rows.join(F.broadcast(as_of(rows))).select("at", "as_of", F.concat(F.lit("model"), F.col("agent") % 12).alias("model"), F.concat(F.lit("frame"), F.col("user_id") % 3).alias("framework"), kind.alias("kind"))
    return stats.analytics_daily(rows, F.col("as_of")).withColumn("day", F.col("day").cast("string"))


@query(f"""
WITH e AS (SELECT 'fp' || (user_id % 40) AS fingerprint, CASE WHEN event_type = 'purchase' THEN 'aided' ELSE 'unaided' END AS role, 'model' || ({_K_SQL} % 12) AS model,
  'e' || user_id AS entry, strftime(ts, '%Y-%m-%d') AS day, least(floor(value*100000), 10000000)::BIGINT AS tokens, least({_K_SQL}, 10000) AS turns, least(floor(value*600), 86400)::BIGINT AS seconds
  FROM events WHERE event_type IN ('purchase', 'error'))
SELECT CASE grouping_id(fingerprint, role, model, entry, day) WHEN 3 THEN 'fingerprint' WHEN 29 THEN 'entry' ELSE 'day' END AS level, fingerprint, role, model, entry, day,
  sum(tokens)::BIGINT AS tokens, sum(turns)::BIGINT AS turns, sum(seconds)::BIGINT AS seconds, count(*) AS records
FROM e GROUP BY GROUPING SETS ((fingerprint, role, model), (entry), (day))
""")
def effort_sums(spark, sf_dir):
    rows = reports(spark, sf_dir).where(F.col("event_type").isin("purchase", "error"))
    return stats.effort_sums(rows.select(
        F.concat(F.lit("fp"), F.col("user_id") % 40).alias("fingerprint"), F.when(F.col("event_type") == "purchase", "aided").otherwise("unaided").alias("role"),
        F.concat(F.lit("model"), F.col("agent") % 12).alias("model"), F.concat(F.lit("e"), "user_id").alias("entry"), F.to_date("at").cast("string").alias("day"),
        stats.clamp(F.col("value") * 100000, stats.CAPS["tokens"]).alias("tokens"), stats.clamp(F.col("agent"), stats.CAPS["turns"]).alias("turns"), stats.clamp(F.col("value") * 600, stats.CAPS["seconds"]).alias("seconds"),
    ))


@query("""
SELECT source, count(*) AS judged, count(*) FILTER (quality = 0 OR toxic = 1) AS rejected,
  CASE WHEN count(*) >= 20 THEN floor(100 * count(*) FILTER (quality = 0 OR toxic = 1) / count(*) + 0.5)::DOUBLE END AS rejected_percent,
  CASE WHEN count(*) >= 100 THEN floor(100 * count(*) FILTER (quality = 1 AND toxic = 0) / count(*) + 0.5)::DOUBLE END AS answered_percent
FROM documents JOIN labels USING (doc_id) GROUP BY source
""")
def rejection_rate(spark, sf_dir):
    """labels is the smaller side; adaptive execution broadcasts it where its size allows."""
    rows = table(spark, sf_dir, "documents").select("doc_id", "source").join(table(spark, sf_dir, "labels"), "doc_id")
    bad = (F.col("quality") == 0) | (F.col("toxic") == 1)
    good = (F.col("quality") == 1) & (F.col("toxic") == 0)
    found = rows.groupBy("source").agg(F.count("*").alias("judged"), F.count_if(bad).alias("rejected"), F.count_if(good).alias("accepted"))
    return found.select("source", "judged", "rejected", strength.ratio(F.col("rejected"), F.col("judged"), 20).alias("rejected_percent"), strength.ratio(F.col("accepted"), F.col("judged"), 100).alias("answered_percent"))


@query("""
SELECT doc_id, lang, source, n_chars, row_number() OVER (ORDER BY n_chars DESC, doc_id) AS place FROM documents
WHERE lang = 'en' AND source = 'src3' ORDER BY n_chars DESC, doc_id LIMIT 50
""")
def feed_page(spark, sf_dir):
    """A page of the feed by category and source, the largest first: a keyset page, which sorts only what it returns."""
    page = publish.feed_page(table(spark, sf_dir, "documents").where("lang = 'en' AND source = 'src3'").select("doc_id", "lang", "source", "n_chars"), "n_chars", "doc_id")
    return page.withColumn("place", F.row_number().over(Window.orderBy(F.desc("n_chars"), F.asc("doc_id"))).cast("long"))


@query("""
WITH first AS (SELECT n_chars, doc_id FROM documents WHERE lang = 'en' ORDER BY n_chars DESC, doc_id LIMIT 50),
cut AS (SELECT n_chars, doc_id FROM first ORDER BY n_chars, doc_id DESC LIMIT 1)
SELECT d.doc_id, d.n_chars FROM documents d, cut WHERE lang = 'en' AND (d.n_chars < cut.n_chars OR (d.n_chars = cut.n_chars AND d.doc_id > cut.doc_id)) ORDER BY d.n_chars DESC, d.doc_id LIMIT 50
""")
def feed_second_page(spark, sf_dir):
    """The page after the first, from the first's last row."""
    rows = table(spark, sf_dir, "documents").where("lang = 'en'").select("doc_id", "n_chars")
    last = publish.feed_page(rows, "n_chars", "doc_id").orderBy(F.asc("n_chars"), F.desc("doc_id")).limit(1)
    return publish.feed_page(rows, "n_chars", "doc_id", after=last)


@query("""
SELECT doc_id, source FROM documents
WHERE ((contains(lower(text), 'there'))::INT + (contains(lower(text), 'onthe'))::INT + (contains(lower(text), 'ation'))::INT) >= 2
""")
def feed_keyword(spark, sf_dir):
    words = lines.keywords(F.lit("THERE is onthe, ation!"))
    return table(spark, sf_dir, "documents").where(lines.keyword_match(words, F.col("text"))).select("doc_id", "source")


@query("SELECT 'lang' AS facet, lang AS value, count(*) AS entries FROM documents GROUP BY lang UNION ALL SELECT 'source', source, count(*) FROM documents GROUP BY source")
def facets(spark, sf_dir):
    """Both facets from one scan and one shuffle."""
    rows = table(spark, sf_dir, "documents").groupingSets([[F.col("lang")], [F.col("source")]], "lang", "source").agg(F.grouping_id().alias("g"), F.count("*").alias("entries"))
    return rows.select(F.when(F.col("g") == 1, "lang").otherwise("source").alias("facet"), F.when(F.col("g") == 1, F.col("lang")).otherwise(F.col("source")).alias("value"), "entries")


@query("""
SELECT page_id, CASE WHEN contains(url, ':') AND trim(split_part(url, ':', 1)) <> '' AND length(trim(split_part(url, ':', 1))) <= 64 AND NOT contains(trim(split_part(url, ':', 1)), ' ')
  THEN trim(split_part(url, ':', 1)) ELSE '' END AS error_type FROM pages WHERE url IS NOT NULL
""")
def guess_type(spark, sf_dir):
    return table(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id", error_keys.guess_error_type(F.col("url")).alias("error_type"))


@query(r"SELECT page_id, left(trim(regexp_replace(regexp_replace(lower(url), '0x[0-9a-f]+|[0-9a-f]{8,}|[0-9]+', '#', 'g'), '\s+', ' ', 'g')), 120) AS signature FROM pages WHERE url IS NOT NULL")
def signatures(spark, sf_dir):
    return table(spark, sf_dir, "pages").where("url IS NOT NULL").select("page_id", error_keys.signature(F.col("url")).alias("signature"))


_CLIP_SQL = r"trim(regexp_replace(coalesce(text, ''), '\s+', ' ', 'g'))"


@query(f"SELECT doc_id, CASE WHEN length({_CLIP_SQL}) <= 120 THEN {_CLIP_SQL} ELSE left({_CLIP_SQL}, 119) || '…' END AS clipped FROM documents")
def clipped(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", lines.clip(F.col("text"), 120).alias("clipped"))


@query("""
SELECT o_orderkey, CASE WHEN v >= 1e9 THEN format('{:.1f}', v / 1e9) || 'B' WHEN v >= 1e6 THEN format('{:.1f}', v / 1e6) || 'M' WHEN v >= 1e3 THEN format('{:.1f}', v / 1e3) || 'k' ELSE v::BIGINT::VARCHAR END AS price
FROM (SELECT o_orderkey, floor(o_totalprice) * (1 + o_orderkey % 3 * 500) AS v FROM orders)
""")
def compact_numbers(spark, sf_dir):
    v = F.floor("o_totalprice") * (1 + F.col("o_orderkey") % 3 * 500)
    return table(spark, sf_dir, "orders").select("o_orderkey", lines.compact(v).alias("price"))


#: Pieces of an order's error line, one or more for each rule: which orders have it, and what it reads in SQL.
_PIECES = [
    ("true", "o_orderpriority || ' of c' || o_custkey"),
    ("o_orderkey % 2 = 0", "'see HTTPS://' || 'c' || o_custkey || '/' || o_orderkey || '?x=1'"),
    ("o_orderkey % 3 = 0", "'id ' || left(md5((o_orderkey * 7919 + o_custkey)::VARCHAR), 8) || '-' || substr(md5((o_orderkey * 7919 + o_custkey)::VARCHAR), 9, 4) || '-' || substr(md5((o_orderkey * 7919 + o_custkey)::VARCHAR), 13, 4) || '-' || substr(md5((o_orderkey * 7919 + o_custkey)::VARCHAR), 17, 4) || '-' || substr(md5((o_orderkey * 7919 + o_custkey)::VARCHAR), 21, 12)"),
    ("o_orderkey % 3 = 1", "'at 0x' || lower(to_hex(o_orderkey))"),
    ("o_orderkey % 5 < 2", "left(md5((o_orderkey * 7919 + o_custkey)::VARCHAR), 16)"),
    ("o_orderkey % 4 = 1", "'from 10.' || (o_custkey % 256) || '.' || (o_orderkey % 256) || '.7:' || (8000 + o_orderkey % 100)"),
    ("o_orderkey % 7 = 2", r"'in D:\Work\' || 'c' || o_custkey || '\a.py'"),
    ("o_orderkey % 2 = 1", "'Line ' || (o_orderkey % 900) || ', col:' || (o_orderkey % 80) || ':' || (o_orderkey % 7)"),
    ("o_orderkey % 5 > 2", "'took ' || floor(o_totalprice)::BIGINT || chr(9) || 'ms'"),
]


def _error_line() -> Column:
    clerk = F.concat(F.lit("c"), "o_custkey")
    k, md5 = F.col("o_orderkey"), F.md5((F.col("o_orderkey") * 7919 + F.col("o_custkey")).cast("string"))
    dashed = F.concat_ws("-", *(F.substring(md5, at, n) for at, n in ((1, 8), (9, 4), (13, 4), (17, 4), (21, 12))))
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    pieces = [
        text(F.col("o_orderpriority"), " of ", clerk), text("see HTTPS://", clerk, "/", k, "?x=1"), text("id ", dashed), text("at 0x", F.lower(F.hex(k))), F.substring(md5, 1, 16),
        text("from 10.", F.col("o_custkey") % 256, ".", k % 256, ".7:", 8000 + k % 100), text("in D:\\Work\\", clerk, "\\a.py"),
        text("Line ", k % 900, ", col:", k % 80, ":", k % 7), text("took ", F.floor("o_totalprice"), "\tms"),
    ]
    return F.concat_ws(" ", *(F.when(F.expr(when), piece) for (when, _), piece in zip(_PIECES, pieces, strict=True)))


_PLAIN_RULES = error_keys.RULES[0:6] + error_keys.RULES[9:12]
_FP_CORE = "lower(concat_ws(' ', " + ", ".join(f"CASE WHEN {when} THEN {sql} END" for when, sql in _PIECES) + "))"
for _pattern, _to in _PLAIN_RULES:
    _FP_CORE = f"regexp_replace({_FP_CORE}, '{_pattern.replace(chr(39), chr(39) * 2)}', '{_to}', 'g')"
_FP_CORE = rf"left(trim(regexp_replace({_FP_CORE}, '\s+', ' ', 'g')), 300)"


@query(f"SELECT o_orderkey, n AS normalized, 'fp2_' || left(sha256(n), 16) AS fingerprint FROM (SELECT o_orderkey, {_FP_CORE} AS n FROM orders)")
def fp_core(spark, sf_dir):
    """The rules without look-around, on a line of each order's columns that reaches them; the rules in SQL give the same."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", error_keys._volatile(F.lower(_error_line()), _PLAIN_RULES).alias("normalized"))
    return rows.withColumn("fingerprint", F.concat(F.lit("fp2_"), F.substring(F.sha2("normalized", 256), 1, 16)))


@query()
def fp2_keys(spark, sf_dir):
    """The full key of each document's redacted first line; tests hold its rules."""
    first = F.substring_index("text", "\n", 1)
    return table(spark, sf_dir, "documents").select("doc_id", redaction.redact(first)["text"].alias("line")).select("doc_id", error_keys.fp2(F.col("line")).alias("fingerprint"))


@query()
def redact_full(spark, sf_dir):
    found = table(spark, sf_dir, "documents").select("doc_id", redaction.redact(F.col("text")).alias("r"))
    return found.select("doc_id", F.sha2("r.text", 256).alias("redacted_sha256"), *(F.coalesce(F.col("r.kinds")[k], F.lit(0)).alias(k) for k in redaction.KINDS))


@query(r"SELECT doc_id, len(regexp_extract_all(text, '\b[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9.\-]{1,255}\.[A-Za-z]{2,}\b')) AS emails FROM documents WHERE regexp_matches(text, '\b[A-Za-z0-9._%+\-]{1,64}@[A-Za-z0-9.\-]{1,255}\.[A-Za-z]{2,}\b')")
def redact_emails(spark, sf_dir):
    """Counted natively; the rule's pattern is the one redaction uses."""
    pattern = next(r.pattern.pattern for r in redaction.RULES if r.kind == "email")
    rows = table(spark, sf_dir, "documents").where(F.contains("text", F.lit("@")))
    return rows.select("doc_id", F.regexp_count("text", F.lit(pattern)).cast("long").alias("emails")).where("emails > 0")


@query(r"""
WITH f AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b(?:[0-9]{1,3}\.){3}[0-9]{1,3}\b')) AS ip FROM documents)
SELECT doc_id, count(*) AS ips FROM f WHERE ip NOT IN ('127.0.0.1', '0.0.0.0', '255.255.255.255') AND list_max(list_transform(string_split(ip, '.'), lambda x: x::INT)) <= 255 GROUP BY doc_id
""")
def redact_ips(spark, sf_dir):
    pattern = next(r.pattern.pattern for r in redaction.RULES if r.kind == "ip")
    found = F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1))
    bad = lambda ip: ~ip.isin(*redaction.HARMLESS_IPS) & (F.array_max(F.transform(F.split(ip, r"\."), lambda x: x.cast("int"))) <= 255)
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(found, bad)).cast("long").alias("ips")).where("ips > 0")


@query(r"""
WITH f AS (SELECT doc_id, regexp_replace(unnest(regexp_extract_all(text, '\b[3-6](?:[ \-]?[0-9]){12,18}\b')), '[^0-9]', '', 'g') AS d FROM documents),
x AS (SELECT doc_id, list_sum(list_transform(range(1, length(d) + 1), lambda i: CASE WHEN i % 2 = 1 THEN substr(d, length(d) + 1 - i, 1)::INT
  ELSE (substr(d, length(d) + 1 - i, 1)::INT * 2) // 10 + (substr(d, length(d) + 1 - i, 1)::INT * 2) % 10 END)) AS s FROM f)
SELECT doc_id, count(*) AS cards FROM x WHERE s % 10 = 0 GROUP BY doc_id
""")
def luhn_cards(spark, sf_dir):
    pattern = next(r.pattern.pattern for r in redaction.RULES if r.kind == "card")
    found = F.transform(F.regexp_extract_all("text", F.lit(f"({pattern})"), F.lit(1)), lambda x: F.regexp_replace(x, "[^0-9]", ""))
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(found, lambda d: F.call_function("luhn_check", d))).cast("long").alias("cards")).where("cards > 0")


@query()
def possible_names(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", redaction.possible_names("text").alias("names")).where(F.size("names") > 0).select("doc_id", F.concat_ws(";", "names").alias("names"))


@query(r"""
SELECT page_id, regexp_extract(lower(url), '^[a-z]+://([^/?#:]+)', 1) AS host, rtrim(regexp_replace(regexp_replace(lower(url), '^.*?://', ''), '[?#].*$', ''), ':./') AS name
FROM pages WHERE len(string_split(rtrim(regexp_replace(regexp_replace(lower(url), '^.*?://', ''), '[?#].*$', ''), ':./'), '/')) BETWEEN 2 AND 8
  AND NOT regexp_matches(rtrim(regexp_replace(regexp_replace(lower(url), '^.*?://', ''), '[?#].*$', ''), ':./'), '\.html?$')
""")
def url_names(spark, sf_dir):
    rows = table(spark, sf_dir, "pages").select("page_id", F.regexp_extract(F.lower("url"), "^[a-z]+://([^/?#:]+)", 1).alias("host"), names.name_of(F.col("url")).alias("name"))
    return rows.where("name IS NOT NULL AND NOT name RLIKE '[.]htm$'")


_NAMED = r"SELECT page_id, regexp_extract(lower(url), '//([^/?#:]+)', 1) AS host, (page_id // 3) % 7 AS k FROM pages"


@query(rf"""
WITH n AS (SELECT *, regexp_matches(host, '\.[a-z]{{2,}}$') AS good FROM ({_NAMED}))
SELECT a.page_id, a.good AND b.good AND a.k <> b.k AS conflict FROM n a JOIN n b ON b.page_id = a.page_id + 1
""")
def names_conflict(spark, sf_dir):
    """Each page's message against the next one's: both name a host with a number, and share it if host and number or the number agree."""
    host = F.regexp_extract(F.lower("url"), "//([^/?#:]+)", 1)
    text = F.concat(F.lit("cannot reach '"), host, F.lit("/"), (F.floor(F.col("page_id") / 3) % 7).cast("string"), F.lit("', giving up"))
    rows = table(spark, sf_dir, "pages").select("page_id", names.placeholder_names(text).alias("asked"))
    have = rows.select((F.col("page_id") - 1).alias("page_id"), F.col("asked").alias("have"))
    return rows.join(have, "page_id").select("page_id", names.names_conflict(F.col("asked"), F.col("have")).alias("conflict"))


def _cosine_sql(least: str, extra: str) -> str:
    return f"""
WITH q AS (SELECT vec_id AS query_id, embedding::DOUBLE[] AS v FROM embeddings WHERE vec_id % 50 = 0),
s AS (SELECT query_id, vec_id AS entry_id, list_cosine_similarity(v, embedding::DOUBLE[]) AS score FROM q, embeddings WHERE vec_id <> query_id),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 9) DESC, entry_id) AS rank FROM s WHERE score >= {least}) {extra}"""


def _semantic(spark, sf_dir, least: float, most: int) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entry_id"), F.col("embedding").alias("vec"))
    asked = vectors.where("entry_id % 50 = 0").select(F.col("entry_id").alias("query_id"), "vec")
    return search.semantic_hits(asked, vectors, least, most + 1).where("query_id <> entry_id")


@query(_cosine_sql("0.2", "SELECT query_id, entry_id, round(score, 6) AS score, rank FROM t WHERE rank <= 5"))
def semantic_topk(spark, sf_dir):
    hits = _semantic(spark, sf_dir, 0.2, 5)
    order = Window.partitionBy("query_id").orderBy(F.desc(F.round("score", 9)), F.asc("entry_id"))
    return hits.withColumn("rank", F.row_number().over(order)).where("rank <= 5").select("query_id", "entry_id", F.round("score", 6).alias("score"), "rank")


@query(_cosine_sql("0.2", "SELECT query_id, entry_id, round(score, 6) AS score FROM (SELECT *, max(score) OVER (PARTITION BY query_id) AS best FROM t WHERE rank <= 5) WHERE score >= 0.3 AND score >= best - 0.05"))
def relevant_hits(spark, sf_dir):
    hits = semantic_topk(spark, sf_dir)
    return search.relevant(hits, 0.3, 0.05).select("query_id", "entry_id", "score")


@query(_cosine_sql("0.2", "SELECT query_id, entry_id, round(score, 6) >= 0.85 AS strong FROM t WHERE rank <= 5"))
def strong_hits(spark, sf_dir):
    return semantic_topk(spark, sf_dir).select("query_id", "entry_id", search.strong(F.lit("semantic"), F.col("score")).alias("strong"))


_SAME_TEXT = """
WITH d AS (SELECT doc_id, sha256(text) AS key, n_chars FROM documents WHERE text IS NOT NULL),
c AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n_chars DESC, doc_id) AS n FROM d)
SELECT d.doc_id AS query_id, c.doc_id AS entry_id, c.n AS rank FROM d JOIN c USING (key) WHERE n <= {most}
"""


def _same_text(spark, sf_dir, most: int) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_id"), F.sha2("text", 256).alias("fp"), F.col("n_chars").alias("strength"))
    return search.exact_hits(docs.select(F.col("entry_id").alias("query_id"), "fp"), docs, most=most).select("query_id", "entry_id", "rank")


@query(_SAME_TEXT.format(most=search.PER_KEY))
def exact_lookup_cap(spark, sf_dir):
    """All entries of each document's whole text that the cap of 64 a key lets through."""
    return _same_text(spark, sf_dir, search.PER_KEY)


@query(_SAME_TEXT.format(most=search.PER_ANSWER))
def exact_lookup(spark, sf_dir):
    """Each document's entries of the same whole text (itself among them), at most 64 a key and 5 an answer."""
    return _same_text(spark, sf_dir, search.PER_ANSWER)


@query("""
WITH d AS (SELECT doc_id, sha256(text) AS key FROM documents), c AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY doc_id) AS n FROM d WHERE key IS NOT NULL),
e AS (SELECT d.doc_id AS query_id, c.doc_id AS entry_id, row_number() OVER (PARTITION BY d.doc_id ORDER BY c.doc_id) AS rank FROM d JOIN c USING (key) WHERE n <= 64 AND c.doc_id <> d.doc_id),
r AS (SELECT q.doc_id AS query_id, d.doc_id AS entry_id, 1 AS rank FROM d q JOIN d ON d.doc_id = q.doc_id + 1 WHERE q.doc_id NOT IN (SELECT query_id FROM e))
SELECT query_id, entry_id, rank, 'fingerprint' AS via FROM e WHERE rank <= 5 UNION ALL SELECT query_id, entry_id, rank, 'semantic' FROM r
""")
def search_fallback(spark, sf_dir):
    """For each document, exact hits by the whole text other than oneself; where there are none, a stand-in for the second tier, fixed by
    its SQL: the next document. search_tiers has the tier by vectors."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_id"), F.sha2("text", 256).alias("fp"), F.lit(0).alias("strength"))
    asked = docs.select(F.col("entry_id").alias("query_id"), "fp")
    exact = search.exact_hits(asked, docs, most=search.PER_KEY).where("entry_id <> query_id")
    exact = strength.top_per_key(exact.drop("rank"), "query_id", 5, F.asc("entry_id"))
    nearest = docs.select((F.col("entry_id") - 1).alias("query_id"), "entry_id", F.lit(1).alias("rank"), F.lit("semantic").alias("via"), F.lit(0.5).alias("score"))
    return search.with_fallback(asked, exact, nearest).select("query_id", "entry_id", "rank", "via")


@query()
def search_tiers(spark, sf_dir):
    """Both tiers for the stated queries, doc_id % 50 = 0: exact hits by the whole text, else the nearest by the vector of
    the same number, from 0.2 on as in semantic_topk. Entries are all documents and all vectors."""
    docs = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_id"), F.sha2("text", 256).alias("fp"), F.lit(0).alias("strength"))
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entry_id"), F.col("embedding").alias("vec"))
    entries = docs.join(vectors, "entry_id", "full")
    asked = docs.where("entry_id % 50 = 0").join(vectors, "entry_id", "left").select(F.col("entry_id").alias("query_id"), "fp", "vec")
    return search.tiers(asked, entries, 0.2).select("query_id", "entry_id", "rank", "via", F.round("score", 6).alias("score"))


@query("""
WITH p AS (SELECT p_partkey, p_type AS name, p_size || '.' || (p_partkey % 7) AS yours, (p_partkey % 50) || '.' || (p_partkey % 3) || '.1' AS trail FROM part),
m AS (SELECT *, CASE WHEN split_part(yours, '.', 1) = '0' THEN '0.' || split_part(yours, '.', 2) ELSE split_part(yours, '.', 1) END AS a,
  CASE WHEN split_part(trail, '.', 1) = '0' THEN '0.' || split_part(trail, '.', 2) ELSE split_part(trail, '.', 1) END AS b FROM p)
SELECT p_partkey, name, yours, trail FROM m WHERE a <> b
""")
def package_mismatch(spark, sf_dir):
    pair = lambda name, version: F.array(F.struct(name.alias("name"), version.alias("version")))
    key = F.col("p_partkey")
    mine = pair(F.col("p_type"), F.concat_ws(".", F.col("p_size").cast("string"), (key % 7).cast("string")))
    theirs = pair(F.lower("p_type"), F.concat_ws(".", (key % 50).cast("string"), (key % 3).cast("string"), F.lit("1")))
    return table(spark, sf_dir, "part").select("p_partkey", F.explode(versions.package_mismatches(mine, theirs)).alias("m")).select("p_partkey", "m.*")


@query(r"""
SELECT min(doc_id) AS merged_into, count(*) AS entries, count(*) - 1 AS merged FROM documents GROUP BY trim(regexp_replace(lower(coalesce(text, '')), '\s+', ' ', 'g')) HAVING count(*) > 1
""")
def merge_dupes(spark, sf_dir):
    """Entries that say the same are merged into the first: groups by a digest, so texts are not shuffled."""
    same = F.sha2(F.trim(F.regexp_replace(F.lower(F.coalesce("text", F.lit(""))), r"\s+", " ")), 256)
    groups = publish.merged(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("entry_id"), same.alias("same")))
    return groups.where("entries > 1").select("merged_into", "entries", (F.col("entries") - 1).alias("merged"))


@query("""
WITH e AS (SELECT o_orderkey AS entry_id, lag(o_orderkey) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS amends, o_orderdate AS on_day, o_totalprice AS strength FROM orders),
n AS (SELECT *, row_number() OVER (PARTITION BY amends ORDER BY strength DESC, on_day DESC, entry_id) AS n FROM e WHERE amends IS NOT NULL)
SELECT amends AS entry_id, string_agg(entry_id::VARCHAR, ',' ORDER BY n) AS amended_by FROM n WHERE n <= 3 GROUP BY amends
""")
def successors(spark, sf_dir):
    orders = table(spark, sf_dir, "orders")
    amends = F.lag("o_orderkey").over(Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey"))
    edges = orders.select(F.col("o_orderkey").alias("entry_id"), amends.alias("amends"), F.col("o_orderdate").alias("at")).where("amends IS NOT NULL")
    found = search.successors(edges, orders.select(F.col("o_orderkey").alias("entry_id"), F.col("o_totalprice").alias("strength")))
    return found.select("entry_id", F.concat_ws(",", F.transform("amended_by", lambda x: x.cast("string"))).alias("amended_by"))


@query(f"""
WITH {_REPORTS_SQL}, a AS (SELECT event_id, ts, user_id AS entry, k AS agent, k % 5 AS address, outcome FROM r WHERE outcome IS NOT NULL),
b AS (SELECT *, outcome IN ('worked', 'partially_worked') AND agent = entry % 100 AS own, date_trunc('day', ts) AS day, date_trunc('hour', ts) AS hour FROM a),
c AS (SELECT *, row_number() OVER (PARTITION BY entry, agent, day, own ORDER BY ts, event_id) > 1 AS again FROM b),
d AS (SELECT *, NOT own AND NOT again AS o1 FROM c),
e AS (SELECT *, o1 AND row_number() OVER (PARTITION BY entry, address, day, o1 ORDER BY ts, event_id) > 3 AS crowded FROM d),
f AS (SELECT *, o1 AND NOT crowded AS o2 FROM e),
g AS (SELECT *, o2 AND row_number() OVER (PARTITION BY address, hour, o2 ORDER BY ts, event_id) > 20 AS flood FROM f)
SELECT event_id, CASE WHEN own THEN 'own_trail' WHEN again THEN 'already_reported_today' WHEN crowded OR flood THEN 'address_limit' END AS reason FROM g
""")
def votes_counted(spark, sf_dir):
    rows = reports(spark, sf_dir).where("outcome IS NOT NULL")
    rows = rows.select(F.col("event_id").alias("report_id"), "at", F.col("user_id").alias("entry"), "agent", (F.col("agent") % 5).alias("address"), "outcome", (F.col("user_id") % 100).alias("author"), F.lit(None).cast("long").alias("author_address"), F.lit(None).cast("timestamp").alias("published_at"))
    return strength.votes_counted(rows).select(F.col("report_id").alias("event_id"), F.col("not_counted_reason").alias("reason"))


@query("""
WITH e AS (SELECT * FROM events WHERE event_type IN ('error', 'purchase'))
SELECT a.user_id AS session, a.event_id, min_by(b.event_id, (b.ts, b.event_id)) AS fix_id FROM e a JOIN e b ON a.user_id = b.user_id AND b.event_type = 'purchase' AND a.event_type = 'error'
  AND (b.ts, b.event_id) > (a.ts, a.event_id) AND b.ts <= a.ts + INTERVAL 45 MINUTE GROUP BY a.user_id, a.event_id
""")
def fail_then_fix(spark, sf_dir):
    rows = reports(spark, sf_dir).where(F.col("event_type").isin("error", "purchase"))
    rows = rows.select(F.col("user_id").alias("session"), F.lit("build").alias("key"), "event_id", "at", (F.col("event_type") == "purchase").alias("ok"))
    return stats.fail_then_fix(rows).select("session", "event_id", "fix_id")


@query("""
WITH s AS (SELECT conv_id, count(*) AS turns, count(*) FILTER (role = 'user') AS failures, arg_max(text, turn) FILTER (role = 'user') AS problem, arg_min(text, turn) FILTER (role = 'user') AS first_try,
  arg_max(text, turn) FILTER (role = 'assistant') AS fix FROM conversations GROUP BY conv_id)
SELECT conv_id, turns, failures, left(problem, 1000) AS error_message, left(first_try, 200) AS first_try, fix IS NOT NULL AND failures >= 1 AS ready FROM s
""")
def sessions(spark, sf_dir):
    """A session made into an entry: the last failure is the problem, earlier ones are dead ends."""
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("pos"), F.when(F.col("role") == "user", "failure").when(F.col("role") == "assistant", "fix").alias("kind"), "text")
    found = publish.assembled(rows)
    return found.select(F.col("session").alias("conv_id"), "turns", "failures", "error_message", F.substring("first_try", 1, 200).alias("first_try"), "ready")


@query("""
WITH l AS (SELECT conv_id AS session, turn AS line_no, turn // 2 AS message, length(text) AS input_tokens, length(text) * 2 AS output_tokens, role AS model FROM conversations),
m AS (SELECT session, message, arg_max(input_tokens, line_no) AS input_tokens, arg_max(output_tokens, line_no) AS output_tokens, arg_max(model, line_no) AS model, min(line_no) AS first FROM l GROUP BY session, message),
t AS (SELECT session, model, count(*) AS n, min(first) AS first FROM m GROUP BY session, model),
b AS (SELECT session, arg_max(model, (n, -first)) AS model FROM t GROUP BY session)
SELECT session, sum(input_tokens)::BIGINT AS input_tokens, sum(output_tokens)::BIGINT AS output_tokens, count(*) AS turns, any_value(b.model) AS model FROM m JOIN b USING (session) GROUP BY session
""")
def usage_window(spark, sf_dir):
    n = F.length("text")
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").alias("session"), F.col("turn").alias("line_no"), F.floor(F.col("turn") / 2).alias("message"), F.col("role").alias("model"), n.alias("input_tokens"), (2 * n).alias("output_tokens"), F.lit(0).alias("cache_read_tokens"), F.lit(0).alias("cache_write_tokens"))
    return stats.usage_sums(rows).select("session", "input_tokens", "output_tokens", "turns", "model")


@query("""
SELECT event_id, ('0x' || left(sha256(user_id::VARCHAR || '|' || event_type || '|' || strftime(ts, '%Y-%m-%d')), 8))::BIGINT % 100 < 10 AS held_out FROM events
""")
def holdout(spark, sf_dir):
    rows = table(spark, sf_dir, "events")
    return rows.select("event_id", stats.holdout(F.col("user_id").cast("string"), F.col("event_type"), F.col("ts"), 10).alias("held_out"))


@query("""
SELECT d.doc_id, CASE WHEN length(coalesce(text, '')) < 20 THEN 'rejected' WHEN toxic = 1 THEN 'rejected' WHEN quality = 0 THEN 'rejected' WHEN quality IS NULL THEN 'queued' ELSE 'indexed' END AS status,
  CASE WHEN length(coalesce(text, '')) < 20 THEN 'invalid_trail' WHEN toxic = 1 THEN 'sensitive_content' WHEN quality = 0 THEN 'low_quality' END AS reason
FROM documents d LEFT JOIN labels USING (doc_id)
""")
def verdicts(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").select("doc_id", F.length(F.coalesce("text", F.lit(""))).alias("n")).join(table(spark, sf_dir, "labels"), "doc_id", "left")
    return rows.select("doc_id", *publish.verdict(valid=F.col("n") >= 20, sensitive=F.col("toxic") == 1, judged=F.col("quality").isNotNull(), good=F.col("quality") == 1))


@query(r"""
SELECT conv_id, turn, CASE WHEN starts_with(t, '/') OR regexp_matches(t, '(?i)^(?:no|ok|yes|thanks|done|continue)[\s.!,]*$') OR length(t) < 15 OR len(string_split(t, ' ')) < 3 THEN '' ELSE left(t, 1500) END AS task
FROM (SELECT conv_id, turn, trim(regexp_replace(text, '\s+', ' ', 'g')) AS t FROM conversations WHERE role = 'user' AND text IS NOT NULL)
""")
def tasks(spark, sf_dir):
    rows = table(spark, sf_dir, "conversations").where("role = 'user' AND text IS NOT NULL")
    return rows.select("conv_id", "turn", lines.task_of(F.col("text")).alias("task"))


@query(f"""
WITH {_REPORTS_SQL}, n AS (SELECT user_id AS entry, k AS agent, ts, event_id, outcome, row_number() OVER (PARTITION BY user_id, k, date_trunc('day', ts) ORDER BY ts DESC, event_id DESC) AS a FROM r WHERE outcome IN ('worked', 'partially_worked', 'failed')),
m AS (SELECT *, row_number() OVER (PARTITION BY entry ORDER BY ts DESC, event_id DESC) AS b FROM n WHERE a = 1)
SELECT entry, string_agg(outcome || ':' || event_id, ',' ORDER BY b) AS caveats FROM m WHERE b <= 3 GROUP BY entry
""")
def caveats(spark, sf_dir):
    rows = reports(spark, sf_dir).where("outcome IS NOT NULL").select(F.col("user_id").alias("entry"), "agent", "at", F.col("event_id").alias("report_id"), "outcome", F.col("event_id").cast("string").alias("note"))
    return strength.caveats(rows).select("entry", F.concat_ws(",", F.transform("caveats", lambda c: F.concat_ws(":", c["outcome"], c["note"]))).alias("caveats"))


_LETTER_SQL = "chr((97 + k % 7)::INT)"


@query(f"""
WITH raw AS (SELECT user_id AS session, epoch_us(ts) // 1000 AS at_ms, {_K_SQL} AS k, event_type FROM events),
e AS (SELECT session, at_ms, CASE event_type WHEN 'error' THEN 'fail' WHEN 'purchase' THEN 'works' ELSE 'miss' END AS kind,
  CASE WHEN event_type <> 'view' THEN 'tool' || chr((97 + k % 3)::INT) || ' run' END AS key, CASE WHEN event_type = 'error' THEN 'Error: bad ' || {_LETTER_SQL} ELSE '' END AS line, k
  FROM raw WHERE event_type IN ('error', 'purchase', 'view')),
o AS (SELECT *, row_number() OVER (PARTITION BY session ORDER BY at_ms, kind, coalesce(key, ''), line) AS i FROM e),
s AS (SELECT *, last_value(CASE WHEN kind = 'fail' THEN key END IGNORE NULLS) OVER w AS failed, last_value(CASE WHEN kind = 'miss' THEN i END IGNORE NULLS) OVER w AS missed FROM o
  WINDOW w AS (PARTITION BY session ORDER BY i ROWS UNBOUNDED PRECEDING)),
p AS (SELECT session, min(i) AS i FROM s WHERE kind = 'works' AND key = failed AND missed IS NOT NULL GROUP BY session, missed),
c AS (SELECT s.*, p.i IS NOT NULL AS publishes, count(p.i) OVER (PARTITION BY s.session ORDER BY s.i ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS before FROM s LEFT JOIN p USING (session, i)),
f AS (SELECT session, before, arg_min(line, i) AS line, arg_min(at_ms, i) AS since FROM c WHERE kind = 'fail' GROUP BY session, before)
SELECT session::VARCHAR AS session, min(at_ms) AS at_ms, 'failed' AS say, line, NULL::BIGINT AS since FROM o WHERE kind = 'fail' GROUP BY session, line
UNION ALL SELECT session::VARCHAR, at_ms, 'publish', '', NULL FROM c WHERE publishes
UNION ALL SELECT c.session::VARCHAR, c.at_ms, 'unaided', f.line, f.since FROM c JOIN f ON f.session = c.session AND f.before = c.before WHERE publishes
""")
def session_replay(spark, sf_dir):
    """The session machine over all events: an error is a failed command, a purchase one that works, a view a search without a
    match. Nothing is throttled and problems stay open, so that SQL can say the same."""
    events, k = table(spark, sf_dir, "events").where("event_type IN ('error', 'purchase', 'view')"), F.regexp_extract("props", '"k": *([0-9]+)', 1).cast("int")
    kind, letter = F.col("event_type"), lambda n, of: F.char(F.lit(n) + k % F.lit(of))
    raw = events.select(
        F.col("user_id").cast("string").alias("session"), F.col("ts").alias("at"), F.when(kind == "error", "failure").otherwise("success").alias("event"),
        F.when(kind == "view", "a_search").otherwise("Bash").alias("tool"), F.concat(F.lit("tool"), letter(97, 3), F.lit(" run")).alias("command"),
        F.when(kind == "view", "No entry in the public colony matches this").otherwise("ok").alias("response"), F.when(kind == "error", F.concat(F.lit("Exit code 1\nError: bad "), letter(97, 7))).alias("error"),
        F.lit(None).cast("int").alias("exit_code"), F.lit(False).alias("interrupted"), F.lit(None).cast("string").alias("outcome"), F.lit(None).cast("string").alias("entry_id"),
    )
    policy = machine.Policy(apart=0, most=10**12, seen=10**6, open_for=10**12)
    return machine.replayed(raw, policy).select("session", F.col("at").alias("at_ms"), "say", "line", "since")
