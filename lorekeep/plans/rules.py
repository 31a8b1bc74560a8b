"""Queries over single rules of entries and searches: strength with confirmations, keyed lines, defaults, safe commands, names, tasks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import error_keys, redaction
from ..operators import publish, search, strength
from ..sources import manifests

QUERIES: dict = {}
SQL: dict = {}


def query(sql: str):
    def register(f):
        QUERIES[f.__name__], SQL[f.__name__] = f, sql
        return f

    return register


def table(spark, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query("""
WITH e AS (SELECT p_partkey, p_size % 7 + p_partkey % 2 AS won, p_partkey % 3 AS part, p_size % 4 AS lost, p_partkey % 400 AS days, CASE WHEN p_partkey % 3 = 0 THEN 90.0 ELSE 365.0 END AS half FROM part),
s AS (SELECT *, (won + part + lost + 2)::DOUBLE AS n, (won + 0.5 * part + 1.4) / (won + part + lost + 2) AS p FROM e)
SELECT p_partkey, round(greatest(0, (p + 3.8416 / (2 * n) - 1.96 * sqrt(greatest(0, p * (1 - p) / n + 3.8416 / (4 * n * n)))) / (1 + 3.8416 / n)) * pow(0.5, days / half), 6) AS strength FROM s
""")
def confirmed_strength(spark, sf_dir):
    """Procedures and facts keep half their strength for 365 days, fixes for 90; a person's confirmation counts as a success."""
    key, size = F.col("p_partkey"), F.col("p_size")
    kind = F.element_at(F.array(F.lit("fix"), F.lit("procedure"), F.lit("fact")), (key % 3 + 1).cast("int"))
    found = strength.strength(size % 7, key % 3, size % 4, (key % 400).cast("double"), confirmed=key % 2, half=strength.half_life(kind))
    return table(spark, sf_dir, "part").select("p_partkey", F.round(found, 6).alias("strength"))


@query("SELECT user_id, event_type AS kind, count(*) AS n FROM events GROUP BY ALL")
def counts_merged(spark, sf_dir):
    """Counts by kind of even and of odd events of a user, as maps that are added up."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", (F.col("event_id") % 2).alias("odd"), "event_type").count()
    maps = rows.groupBy("user_id").agg(*(F.map_from_entries(F.collect_list(F.when(F.col("odd") == i, F.struct("event_type", "count")))).alias(name) for i, name in enumerate(("even", "odd_ones"))))
    return maps.select("user_id", F.explode(redaction.merge_counts(F.col("even"), F.col("odd_ones"))).alias("kind", "n"))


@query(r"""
WITH d AS (SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN '  ' WHEN 1 THEN 'message of ' || doc_id END AS message, CASE WHEN doc_id % 4 > 0 THEN left(md5(doc_id::VARCHAR), 2) ELSE '' END AS kind, regexp_split_to_array(text, '\r\n|\n|\r') AS logs FROM documents)
SELECT doc_id, CASE WHEN doc_id % 3 = 1 THEN message ELSE coalesce(list_filter(logs, lambda x: kind <> '' AND contains(x, kind))[1], list_filter(logs, lambda x: regexp_matches(x, '\S'))[1]) END AS line FROM d
""")
def keyed_lines(spark, sf_dir):
    """The line that a key is made from: the message, else the first line of the logs with the type, else the first that is not blank."""
    key = F.col("doc_id")
    message = F.when(key % 3 == 0, "  ").when(key % 3 == 1, F.concat(F.lit("message of "), key.cast("string")))
    kind = F.when(key % 4 > 0, F.substring(F.md5(key.cast("string")), 1, 2)).otherwise("")
    rows = table(spark, sf_dir, "documents").select("doc_id", message.alias("message"), kind.alias("kind"), "text")
    return rows.select("doc_id", error_keys.keyed_line(F.col("message"), F.col("text"), F.col("kind")).alias("line"))


@query("""
SELECT doc_id, CASE WHEN doc_id % 2 = 0 THEN '1.3' ELSE '1.0' END AS protocol_version, CASE doc_id % 3 WHEN 0 THEN 'fact' ELSE 'fix' END AS kind,
  sha256(CASE WHEN doc_id % 5 = 0 OR text IS NULL THEN '(none provided)' WHEN length(text) > 16000 THEN substr(text, length(text) - 15999, 16000) ELSE text END) AS logs_sha256 FROM documents
""")
def entries_with_defaults(spark, sf_dir):
    key = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").select("doc_id", F.when(key % 2 == 0, "1.3").alias("protocol_version"), F.when(key % 3 == 0, "fact").alias("kind"), F.when(key % 5 > 0, F.col("text")).alias("raw_logs"))
    return publish.with_defaults(rows).select("doc_id", "protocol_version", "kind", F.sha2("raw_logs", 256).alias("logs_sha256"))


@query("""
WITH e AS (SELECT p_partkey, [p_name, p_brand, p_type] AS commands, p_partkey % 3 AS a, ['low', 'medium', 'high', 'odd'][p_size % 4 + 1] AS la, p_size % 3 AS b, ['medium', 'high'][p_partkey % 2 + 1] AS lb FROM part)
SELECT p_partkey, CASE WHEN p_partkey % 5 = 0 THEN '' ELSE array_to_string([commands[i + 1] FOR i IN range(3) IF NOT (i = a AND la IN ('high', 'odd')) AND NOT (i = b AND lb = 'high')], ';') END AS safe FROM e
""")
def safe_commands(spark, sf_dir):
    """Commands of which no flag is worse than medium; an unknown level is; without an analysis none is safe."""
    key, size = F.col("p_partkey"), F.col("p_size")
    pick = lambda n, *values: F.element_at(F.array(*map(F.lit, values)), (n + 1).cast("int"))
    flag = lambda at, level: F.struct(at.cast("int").alias("command_index"), level.alias("level"))
    flags = F.when(key % 5 > 0, F.array(flag(key % 3, pick(size % 4, "low", "medium", "high", "odd")), flag(size % 3, pick(key % 2, "medium", "high"))))
    return table(spark, sf_dir, "part").select("p_partkey", F.array_join(search.safe_commands(F.array("p_name", "p_brand", "p_type"), flags), ";").alias("safe"))


@query("""
WITH d AS (SELECT doc_id, source AS key, n_chars, CASE WHEN doc_id % 3 > 0 THEN doc_id % 5 END AS name FROM documents WHERE source IS NOT NULL),
c AS (SELECT *, row_number() OVER (PARTITION BY key ORDER BY n_chars DESC, doc_id) AS n FROM d),
h AS (SELECT q.doc_id AS query_id, c.doc_id AS entry_id, row_number() OVER (PARTITION BY q.doc_id ORDER BY c.n_chars DESC, c.doc_id) AS rank FROM d q JOIN c USING (key) WHERE c.n <= 64 AND (q.name IS NULL OR c.name IS NULL OR q.name = c.name))
SELECT query_id, entry_id, rank FROM h WHERE rank <= 5
""")
def named_hits(spark, sf_dir):
    """Exact hits of each document's source among the strongest 64, of which those fall out that name other things than the query does."""
    key = F.col("doc_id")
    names = F.when(key % 3 > 0, F.array(F.concat(F.lit("host.example/"), (key % 5).cast("string")))).otherwise(F.array().cast("array<string>"))
    docs = table(spark, sf_dir, "documents").select(key.alias("entry_id"), F.col("source").alias("fp"), F.col("n_chars").alias("strength"), names.alias("names"))
    return search.exact_hits(docs.select(F.col("entry_id").alias("query_id"), "fp", "names"), docs).select("query_id", "entry_id", "rank")


@query("""
WITH s AS (SELECT q.vec_id AS query_id, e.vec_id AS entry_id, list_cosine_similarity(q.embedding::DOUBLE[], e.embedding::DOUBLE[]) AS score FROM embeddings q, embeddings e WHERE q.vec_id % 50 = 0),
t AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY round(score, 12) DESC, entry_id) AS rank FROM s WHERE score >= 0.55)
SELECT query_id, entry_id, rank, 'task' AS via FROM t WHERE rank <= 5
""")
def task_topk(spark, sf_dir):
    """Tasks in words have a threshold of their own; here each of the stated queries is among its own hits."""
    vectors = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("entry_id"), F.col("embedding").alias("vec"))
    return search.task_hits(vectors.where("entry_id % 50 = 0").select(F.col("entry_id").alias("query_id"), "vec"), vectors).select("query_id", "entry_id", "rank", "via")


_COLUMNS = ["p_partkey AS k", "p_size AS s", "p_partkey % 3 > 0 AS py", "p_partkey % 2 = 0 AS node", "p_partkey % 4 = 0 AS locked", "p_partkey % 5 = 0 AS uv", "p_partkey % 7 = 0 AS py_version", "p_partkey % 6 < 3 AS node_version"]
_PROJECT = f"SELECT {', '.join(_COLUMNS)} FROM part"


def _project_files(spark, sf_dir) -> DataFrame:
    """Each part as a project with some of the files that declare what it needs."""
    k, s = F.col("k").cast("string"), F.col("s").cast("string")
    text = lambda *parts: F.concat(*(F.lit(p) if isinstance(p, str) else p.cast("string") for p in parts))
    files = {
        "requirements.txt": ("py", text("alpha==1.", s, "\nBeta_Lib>=2\n\n# none\ngamma[x] == 3.", F.col("k") % 9, " ; python_version < '4' # n\n-e git+https://x/y\n./local\nALPHA==9")),
        "package.json": ("node", text('{"name": "own", "dependencies": {"own": "1", "left": "^1.', F.col("k") % 5, '", "@s/x": "2", "loc": "file:../x"}, "devDependencies": {"left": "9", "right": "~2"}}')),
        "package-lock.json": ("locked", text('{"packages": {"node_modules/left": {"version": "1.', s, '.0"}}}')),
        "uv.lock": ("uv", text('version = 1\n\n[[package]]\nname = "beta-lib"\nversion = "2.', s, '"\n\n[[package]]\nname = "other"\nversion = "7"\n')),
        ".python-version": ("py_version", text("3.", F.col("k") % 4 + 9, "\n")),
        ".nvmrc": ("node_version", text("v18.", F.col("k") % 10)),
        "NOTES.txt": ("py", text("alpha==7 ", k)),
    }
    rows = table(spark, sf_dir, "part").selectExpr(*_COLUMNS)
    listed = F.array(*(F.when(F.col(there), F.struct(F.lit(name).alias("file"), body.alias("text"))) for name, (there, body) in files.items()))
    return rows.select(k.alias("project"), F.inline(F.filter(listed, lambda f: f.isNotNull())))


@query(f"""
WITH p AS ({_PROJECT})
SELECT k AS project, array_to_string(list_filter([CASE WHEN node THEN 'right@~2' END, CASE WHEN py THEN 'Beta_Lib@' || CASE WHEN uv THEN '2.' || s ELSE '?' END END,
  CASE WHEN node THEN 'left@' || CASE WHEN locked THEN '1.' || s || '.0' ELSE '^1.' || (k % 5) END END, CASE WHEN py THEN 'alpha@1.' || s END, CASE WHEN py THEN 'gamma@3.' || (k % 9) END], lambda x: x IS NOT NULL), ';') AS packages
FROM p WHERE py OR node OR uv OR py_version OR node_version
""")
def project_packages(spark, sf_dir):
    """What each project needs, with the versions of its lock files; what a text names comes first."""
    found = manifests.packages(_project_files(spark, sf_dir), F.lit("upgrade right, then BETA_LIB!"))
    spelled = F.transform("packages", lambda p: F.concat(p["name"], F.lit("@"), F.coalesce(p["version"], F.lit("?"))))
    return found.select(F.col("project").cast("long").alias("project"), F.array_join(spelled, ";").alias("packages"))


@query(f"""
WITH p AS ({_PROJECT})
SELECT k AS project, CASE WHEN node AND NOT py THEN 'node@' || CASE WHEN node_version THEN '18.' || (k % 10) ELSE '?' END WHEN py AND NOT node THEN 'python@' || CASE WHEN py_version THEN '3.' || (k % 4 + 9) ELSE '?' END END AS runtime
FROM p WHERE py OR node OR uv OR py_version OR node_version
""")
def project_runtimes(spark, sf_dir):
    r = F.col("runtime")
    found = manifests.runtimes(_project_files(spark, sf_dir))
    return found.select(F.col("project").cast("long").alias("project"), F.when(r.isNotNull(), F.concat(r["name"], F.lit("@"), F.coalesce(r["version"], F.lit("?")))).alias("runtime"))
