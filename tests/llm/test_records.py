"""Archives, chat formatting, mixing, languages and vectors: round trips, exact checks and held-out accuracy."""

import hashlib
import io
import math
import struct
from collections import Counter, defaultdict

import numpy as np
import pytest
import zstandard

from lorekeep.llm import language_id, queries, vector_dedup
from lorekeep.llm.chat import HOSTILE, Reader, Template, format_chat, read_chat
from lorekeep.llm.language_id import held_out, identify, infer, is_held_out, train
from lorekeep.llm.mixing import mix, targets
from lorekeep.llm.vector_dedup import near_vectors
from lorekeep.llm.warc import DICTIONARY_FRAME, WarcError, digest, read_archive, read_warc, record, write_warc

from . import fixtures

# --- archives


def test_warc_round_trip(spark):
    rows = [(1, "http://a/é b", "<p>é</p>"), (2, None, "<p>é</p>"), (3, "u", None), (4, "u", ""), (5, "u", "x" * 3_000_000), (6, "u", "x" * 3_000_000), (None, "u", "lone"), (None, "u", "<p>é</p>"), (2, None, "<p>é</p>"), (7, "", "HTTP/1.1\r\n\r\nWARC/1.1\r\n\r\n")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string").selectExpr("*", "'x' AS sha", "1 AS n", "2 AS salt")
    found = sorted((tuple(r) for r in read_warc(write_warc(pages), payloads=True).collect()), key=repr)
    best = {}
    for i, _, h in rows:
        best[h or ""] = max(best.get(h or "", -1), -1 if i is None else i)
    expected = []
    for i, _, h in rows:
        raw, first = (h or "").encode(), best[h or ""]
        again = first >= 0 and i != first
        expected.append((i, len(raw), digest(raw), "revisit" if again else "response", first if again else None, bytearray() if again else bytearray(raw)))
    assert found == sorted(expected, key=repr)
    assert read_warc(write_warc(pages.limit(0))).count() == 0
    small = read_warc(write_warc(pages, min_bytes=100)).where("record_type = 'revisit'").collect()
    assert [(r.page_id, r.refers_to) for r in small] == [(5, 6)]


def archive(raws, dictionary=b"", raw_dictionary=True):
    data = struct.pack("<II", DICTIONARY_FRAME, len(dictionary)) + dictionary
    return data + b"".join(zstandard.ZstdCompressor().compress(r) for r in raws)


def test_warc_reader_refuses():
    good = record(1, "http://a", b"payload", None)
    assert [r["payload"] for r in read_archive(io.BytesIO(archive([good, record(2, None, b"", 1)])))] == [b"payload", b""]
    bad = [
        good.replace(b"WARC/1.1", b"WARC/9"), good.replace(b"payload", b"pAyload"), good.replace(b"WARC-Date: 1970-01-01T00:00:00Z\r\n", b""), good[:-1],
        good.replace(b"WARC-Type: response", b"WARC-Type: request"), good.replace(b"\r\nContent-Length: 7", b"\r\nContent-Length: 8"),
    ]
    for raw in bad:
        with pytest.raises(WarcError):
            list(read_archive(io.BytesIO(archive([raw]))))
    whole = archive([good])
    for data in (whole[:-3], whole[8:], whole[:10], b""):
        with pytest.raises(WarcError):
            list(read_archive(io.BytesIO(data)))


def test_warc_dictionary():
    words = [record(i, f"http://a/{i}", f"<html>{'common words here ' * 20}{i}".encode(), None) for i in range(300)]
    trained = zstandard.train_dictionary(4096, words).as_bytes()
    packer = zstandard.ZstdCompressor(dict_data=zstandard.ZstdCompressionDict(trained))
    for held in (trained, zstandard.ZstdCompressor().compress(trained)):  # raw, or itself compressed
        data = struct.pack("<II", DICTIONARY_FRAME, len(held)) + held + b"".join(map(packer.compress, words))
        assert len(list(read_archive(io.BytesIO(data)))) == 300


# --- chat


def test_chat_round_trip(spark):
    marks = Template().marks
    texts = ["".join(m), "\\", "\\\\", *marks, "a\\" + marks[0], marks[0][:3], marks[1] + "\\", "", "line\nline", "[/INST]</s>\\[OUT]"] if (m := marks) else []
    rows = [(1, k, "user" if k % 2 == 0 else "assistant", t) for k, t in enumerate(texts)] + [(2, 0, "tool [SAYS]", texts[0]), (2, 1, None, None), (None, 0, "user", "x"), (3, 0, "assistant", "y"), *HOSTILE]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "true AS valid", "1 AS segments")
    own = defaultdict(list)
    for c, _, role, text in rows:
        own[c].append((role or "", text or ""))
    seen = defaultdict(str)
    for r in sorted(format_chat(table).collect(), key=lambda r: (r.conv_id is None, r.conv_id or 0, r.turn_no)):
        seen[r.conv_id] += "".join(s.text for s in r.segments)
    assert {c: list(Reader(Template()).turns(x)) for c, x in seen.items()} == dict(own)
    for r in read_chat(format_chat(table)).collect():
        said = "".join(t for role, t in own[r.conv_id] if role == "assistant")
        assert (r.n_turns, r.loss_chars, r.loss_sha256) == (len(own[r.conv_id]), len(said), hashlib.sha256(said.encode()).hexdigest())
        assert r.formatted_chars == len(seen[r.conv_id])
    valid = {r.conv_id: r.valid for r in read_chat(format_chat(table)).collect()}
    assert valid[-7] and not valid[2] and not valid[3] and not valid[None]
    assert read_chat(format_chat(table.limit(0))).count() == 0


def test_chat_reader_and_template_refuse():
    for bad in ("text", "<s>[INST]open", "<s>[INST]x</s>", "[/INST]"):
        with pytest.raises(ValueError):
            list(Reader(Template()).turns(bad))
    with pytest.raises(ValueError):
        Template(turns={"user": ("ab", "bc"), "assistant": ("x", "y"), "other": ("q", "r")})


# --- mixing


def brute_targets(sizes, weights=(5.0, 2.0, 1.0)):
    order = sorted(sizes, key=lambda s: (s is None, (s or "").encode("utf-32-be")))
    weight = {s: weights[k % len(weights)] for k, s in enumerate(order)}
    total, capped = 1.5 * sum(sizes.values()), set()
    while True:
        rest = total - sum(2 * sizes[s] for s in capped)
        open_ones = [s for s in order if s not in capped]
        share = {s: rest * weight[s] / sum(weight[x] for x in open_ones) for s in open_ones}
        over = {s for s in open_ones if share[s] > 2 * sizes[s]}
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else share[s] for s in order}
        capped |= over


def check_mix(draws, sources):
    taken, sizes = Counter(), Counter()
    for r in draws:
        assert 0 <= r.taken <= 2 * r.size
        taken[r.source] += r.taken
        sizes[r.source] += r.size
    expected = brute_targets(sizes)
    assert {r.source for r in sources} == set(expected)
    for r in sources:
        assert r.source_size == sizes[r.source] and abs(r.target - expected[r.source]) < 1e-6 * max(1, expected[r.source])
        assert abs(taken[r.source] - expected[r.source]) <= 0.5


@pytest.mark.parametrize("whose", ["table", "odd", "twice"])
def test_mix(spark, sf_dir, whose):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet") if whose == "table" else getattr(fixtures, whose)(spark)
    draws, sources = mix(docs)
    by_row = draws.groupBy("row", "doc_id", "source", "size").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "taken").collect()
    assert len(by_row) == docs.count()
    check_mix(by_row, sources.collect())
    assert draws.where("taken > 0 AND shard IS NULL").count() == 0
    again, _ = mix(docs)
    key = lambda d: sorted(((r.doc_id, r.size, r.epoch, r.taken, r.shard) for r in d.collect()), key=repr)
    assert key(again) == key(draws)


def test_mix_empty_and_targets(spark):
    assert mix(fixtures.empty(spark))[0].count() == 0
    rng = np.random.default_rng(5)
    for n in (1, 2, 3, 7, 20):
        sizes = {f"s{k:02d}": int(x) for k, x in enumerate(rng.integers(0, 1000, n) ** 2)}
        found = targets(spark.createDataFrame(list(sizes.items()), "source string, source_size long")).collect()
        expected = brute_targets(sizes)
        assert all(abs(r.target - expected[r.source]) <= 1e-6 * max(1.0, expected[r.source]) for r in found)


def test_op4(spark, sf_dir):
    found = queries.QUERIES["op4_mixing"](spark, sf_dir).collect()
    assert len(found) == spark.read.parquet(f"{sf_dir}/documents.parquet").count()
    assert all(0 <= r.taken <= 2 * r["size"] and r.target <= 2 * r.source_size for r in found)
    sources = {r.doc_id: r.source for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    sizes, taken = Counter(), Counter()
    for r in found:
        sizes[sources[r.doc_id]] += r["size"]
        taken[sources[r.doc_id]] += r.taken
        assert bool(r.shards) == (r.taken > 0)
    expected = brute_targets(sizes)
    for r in found:
        source = sources[r.doc_id]
        assert r.source_size == sizes[source] and abs(r.target - expected[source]) < 1e-5 * max(1, expected[source]) and abs(taken[source] - expected[source]) <= 0.5


def test_mix_of_rows_without_identifiers(spark):
    """They are spread over blocks like others, and a rerun over other files takes the same words of the same texts."""
    rows = [(None, f"word{i} " * (1 + i % 7), "a" if i % 3 else None) for i in range(300)]
    found = []
    for parts in (1, 5):
        table = spark.createDataFrame(rows, "doc_id long, text string, source string").repartition(parts)
        draws, sources = mix(table)
        found.append(sorted(((r["size"], r.source, r.epoch, r.taken) for r in draws.collect()), key=repr))
        check_mix(draws.groupBy("row", "source", "size").agg({"taken": "sum"}).withColumnRenamed("sum(taken)", "taken").collect(), sources.collect())
    assert found[0] == found[1]


# --- languages


def test_languages(spark, sf_dir):
    found = {r.doc_id: r for r in queries.QUERIES["op6_language_id"](spark, sf_dir).collect()}
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    assert len(found) == len(docs)
    held = [r for r in docs if is_held_out(r.doc_id) and r.lang is not None and found[r.doc_id].lang_pred != "und"]
    assert all(found[r.doc_id].held_out == is_held_out(r.doc_id) for r in docs)
    right = sum(found[r.doc_id].lang_pred == r.lang for r in held)
    assert right >= 0.95 * len(held), (right, len(held))


def test_language_cases(spark):
    docs = fixtures.odd(spark)
    langs, logs = train(docs)
    assert langs == ["de", "en", "fr"]
    found = {r.doc_id: r for r in identify(docs, langs, logs, ["doc_id", "count"]).collect()}
    assert len(found) == 16 and all(0 <= r.score <= 1 for r in found.values())
    assert {i for i, r in found.items() if r.lang_pred == "und"} == {4, 5, 7}
    assert found[6].lang_pred == found[13].lang_pred
    assert identify(fixtures.empty(spark), langs, logs, ["doc_id"]).count() == 0
    none, table = train(fixtures.empty(spark))
    assert none == [] and {r.lang_pred for r in identify(docs, none, table, ["doc_id"]).collect()} == {"und"}


def plain_grams(text):
    """Counts of letter 3-grams around each letter, words apart: by the rule, one letter after the other."""
    codes = [32, *((ord(c.lower()) if len(c.lower()) == 1 else ord(c)) if c.isalpha() and ord(c) < 1 << 16 else 32 for c in text or ""), 32]
    found = Counter()
    for a, b, c in zip(codes, codes[1:], codes[2:], strict=False):
        if b != 32:
            found[((a * 1_000_003 + b * 8_191 + c) * 2_654_435_761 % (1 << 32) >> 12) % language_id.BUCKETS] += 1
    return found


def plain_mixture(grams, chances, chosen, rounds):
    share = {k: 1 / len(chosen) for k in chosen}
    for _ in range(rounds):
        new = dict.fromkeys(chosen, 0.0)
        for g, n in grams.items():
            whole = sum(chances[k][g] * share[k] for k in chosen)
            for k in chosen:
                new[k] += n * chances[k][g] * share[k] / whole
        share = {k: v / sum(grams.values()) for k, v in new.items()}
    return share, sum(n * math.log(sum(chances[k][g] * share[k] for k in chosen)) for g, n in grams.items())


def test_languages_by_plain_expectation_maximisation(spark, sf_dir):
    """The whole query again in plain loops: counts, proportions, penalised choice, for every short document and some long ones."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    sums = defaultdict(Counter)
    for r in docs:
        if r.lang is not None and not is_held_out(r.doc_id):
            sums[r.lang] += plain_grams(r.text)
    langs = sorted(sums)
    total = {k: sum(sums[k].values()) + 0.5 * language_id.BUCKETS for k in langs}
    chances = {k: defaultdict(lambda k=k: 0.5 / total[k], {g: (n + 0.5) / total[k] for g, n in sums[k].items()}) for k in langs}
    found = {r.doc_id: r for r in queries.QUERIES["op6_language_id"](spark, sf_dir).collect()}
    compared = 0
    for r in docs:
        grams = plain_grams(r.text)
        if not grams or len(grams) > 400 and r.doc_id % 10:
            assert grams or (found[r.doc_id].lang_pred, found[r.doc_id].score) == ("und", 0.0)
            continue
        alone = {k: sum(n * math.log(chances[k][g]) for g, n in grams.items()) for k in langs}
        best = max(langs, key=lambda k: (alone[k], -langs.index(k)))
        share, _ = plain_mixture(grams, chances, langs, language_id.ROUNDS)
        penalty, chosen, value, shares = language_id.PENALTY * 0.5 * math.log(sum(grams.values()) + 1), [best], alone[best], {best: 1.0}
        for k in sorted(langs, key=lambda k: -share[k]):
            if k in chosen:
                continue
            if share[k] < 0.01:
                break
            new, likely = plain_mixture(grams, chances, [*chosen, k], language_id.ROUNDS)
            if likely - value <= penalty:
                break
            chosen, value, shares = [*chosen, k], likely, new
        top = max(chosen, key=lambda k: shares[k])
        assert found[r.doc_id].lang_pred == top and abs(found[r.doc_id].score - shares[top]) < 1e-3, r.doc_id
        compared += 1
    assert compared >= len(docs) // 4


def test_mixture_of_languages():
    """Grams of two languages in equal parts: both are in the set, and neither has all of the text."""
    logs = np.log(np.array([[0.45, 0.45, 0.05, 0.05], [0.05, 0.05, 0.45, 0.45], [0.25, 0.25, 0.25, 0.25]], dtype=np.float32))
    best, share = infer(np.arange(4), np.array([900, 900, 50, 50]), logs)
    assert best == 0 and share > 0.9
    best, share = infer(np.arange(4), np.array([700, 700, 400, 400]), logs)
    assert best in (0, 2) and share < 1.0


# --- vectors


def brute_vectors(rows, threshold=0.95):
    """Rows are vectors of their own; a component is named after its smallest vec_id."""
    sound = {}
    for k, (i, v) in enumerate(rows):
        if i is not None and v is not None and len(v) and all(x is not None and np.isfinite(x) for x in v) and any(v):
            x = np.array(v, dtype=np.float64)
            sound[k] = x / np.linalg.norm(x)
    links, label = Counter(), list(range(len(rows)))

    def root(k):
        while label[k] != k:
            k = label[k]
        return k

    keys = sorted(sound)
    for x, a in enumerate(keys):
        for b in keys[x + 1 :]:
            if len(sound[a]) == len(sound[b]) and sound[a] @ sound[b] >= threshold:
                links[a] += 1
                links[b] += 1
                label[root(b)] = root(a)
    least = {}
    for k in keys:
        least[root(k)] = min(least.get(root(k), rows[k][0]), rows[k][0])
    return sorted(((i, links[k], least[root(k)] if k in sound else i) for k, (i, _) in enumerate(rows)), key=repr)


def found_vectors(rows):
    return sorted(((r.vec_id, r.n_links, r.component_id) for r in rows), key=repr)


def test_vectors_of_the_table(spark, sf_dir):
    found = queries.QUERIES["op9_vector_dedup"](spark, sf_dir).collect()
    rows = [(r.vec_id, r.embedding) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").collect()]
    expected = brute_vectors(rows)
    mine = found_vectors(found)
    assert len(mine) == len(expected) and sum(x[1] for x in expected) >= sum(x[1] for x in mine) >= 0.99 * sum(x[1] for x in expected)
    assert sum(a == b for a, b in zip(mine, expected, strict=True)) >= 0.99 * len(expected)


def test_vectors(spark):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((30, 16))
    rows = [(i, [float(x) for x in np.float32(centers[i % 30] + 0.12 * rng.standard_normal(16))]) for i in range(300)]
    rows += [(1000 + i, rows[0][1]) for i in range(40)] + [(2000, None), (2001, []), (2002, [0.0] * 16), (2003, [float("nan")] + [1.0] * 15), (2004, [None] + [1.0] * 15), (2005, [1.0, 2.0]), (2006, [2.0, 4.0]), (None, rows[0][1])]
    rows += [(3000 + 2 * d + k, [1.0] * d + [0.1 * k]) for d in range(20, 40) for k in range(2)]  # pairs of twenty lengths
    rows += [(7, rows[5][1]), (7, rows[8][1]), (7, [-x for x in rows[5][1]]), (2, rows[9][1])]  # repeated vec_ids, other vectors
    table = spark.createDataFrame(rows, "vec_id long, embedding array<float>").selectExpr("*", "1 AS label", "'x' AS name", "2 AS node", "3 AS component")
    found = near_vectors(table).collect()
    assert found_vectors(found) == brute_vectors(rows)
    assert all(r.kept == (r.component_id is None or r.vec_id == r.component_id) for r in found)
    assert near_vectors(table.limit(0)).count() == 0


def test_vectors_in_many_small_shards(spark, monkeypatch):
    """Levels of centroids, chunks of what they do not part, and guests from other shards, with shards so small that clusters are
    torn: no link too many, at least the recall that is promised, and components whole."""
    for name, value in {"SHARD": 20, "MOST_IN_SHARD": 40, "ROWS": 64, "LEVELS": 2}.items():
        monkeypatch.setattr(vector_dedup, name, value)
    rng = np.random.default_rng(8)
    centers = rng.standard_normal((12, 8))
    rows = [(i, [float(x) for x in centers[i % 12 if i < 400 else 0] + 0.1 * rng.standard_normal(8)]) for i in range(700)]
    found, expected = found_vectors(near_vectors(spark.createDataFrame(rows, "vec_id long, embedding array<double>")).collect()), brute_vectors(rows)
    assert all(a[1] <= b[1] for a, b in zip(found, expected, strict=True)) and sum(x[1] for x in found) >= vector_dedup.LEAST_RECALL * sum(x[1] for x in expected)
    assert [x[::2] for x in found] == [x[::2] for x in expected]


def test_held_out(spark):
    assert all(r.h == is_held_out(r.doc_id) for r in spark.range(500).withColumnRenamed("id", "doc_id").withColumn("h", held_out()).collect())
