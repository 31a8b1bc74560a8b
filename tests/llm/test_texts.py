"""Exact dedup, substring dedup, near-duplicates and tokens against brute force; every case of the docstrings."""

import hashlib
import random
import re
import zlib
from collections import Counter, defaultdict
from unittest import mock

import pandas as pd
import public_tokenizers
import pytest
from conftest import rows_of, sql_rows
from tokenizers import Tokenizer

from lorekeep.llm import exact_dedup as exact_dedup_module
from lorekeep.llm import near_dedup, queries
from lorekeep.llm.common import connected_components
from lorekeep.llm.exact_dedup import exact_dedup
from lorekeep.llm.near_dedup import near_duplicates
from lorekeep.llm.packing import best_fit, fit_by_pairs, pack, pack_documents
from lorekeep.llm.substring_dedup import remove_repeats, repeated_spans, spans_by_doubling
from lorekeep.llm.token_files import TokenFile, read_token_files, write_token_files

from . import fixtures

WORDS = public_tokenizers.path("word_bpe_49k.json")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_against_sql(spark, sf_dir, name):
    found = queries.QUERIES[name](spark, sf_dir)
    assert rows_of(found) == sql_rows(queries.SQL[name], found.columns, sf_dir)


def documents(spark, sf_dir):
    return [(r.doc_id, r.text) for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()]


# --- exact


def test_exact(spark):
    for keep, best in (("smallest", min), ("largest", max)):
        groups = defaultdict(list)
        for i, t, *_ in fixtures.odd_rows():
            groups[t or ""].append(i)
        found = exact_dedup(fixtures.odd(spark), keep=keep).collect()
        assert len(found) == len(fixtures.odd_rows())
        for r in found:
            own = next(g for g in groups.values() if r.doc_id in g)
            assert (r.keep_id, r.group_size, r.kept) == (best(own), len(own), r.doc_id == best(own))


def test_exact_repeated_and_empty(spark):
    found = exact_dedup(fixtures.twice(spark)).collect()
    assert len(found) == 6
    same = [r for r in found if r.text_sha256 == hashlib.sha256(fixtures.text(9, 50).encode()).hexdigest()]
    assert [r.group_size for r in same] == [3] * 3 and [r.keep_id for r in same] == [1] * 3 and sum(r.kept for r in same) == 1
    assert exact_dedup(fixtures.empty(spark)).count() == 0


def test_exact_group_over_partitions(spark):
    rows = spark.range(5000).selectExpr("id AS doc_id", "IF(id % 3 = 0, 'same', CAST(id AS STRING)) AS text").repartition(16)
    found = exact_dedup(rows, keep="largest").where("group_size > 1").selectExpr("count(*)", "min(keep_id)", "max(keep_id)", "min(group_size)", "count_if(kept)").first()
    assert tuple(found) == (1667, 4998, 4998, 1667, 1)


def test_exact_long_runs():
    """Runs over the number of ids that are held, at edges and between them; each row once, the size with the run's last row."""
    rows = [("a", 25), ("b", 3), ("c", 10), ("d", 11), ("e", 21), ("f", 1), ("g", 40)]
    batch = pd.DataFrame([(k * 100 + i, t) for k, (t, n) in enumerate(rows) for i in range(n)], columns=["doc_id", "text"])
    old, exact_dedup_module.HELD = exact_dedup_module.HELD, 10
    try:
        with mock.patch("pyspark.TaskContext.get", return_value=mock.Mock(partitionId=lambda: 3)):
            found = pd.concat(list(exact_dedup_module._runs(iter([batch.iloc[:30], batch.iloc[30:31], batch.iloc[31:]]))))
    finally:
        exact_dedup_module.HELD = old
    assert found["doc_id"].tolist() == batch["doc_id"].tolist()
    for k, (_, n) in enumerate(rows):
        own = found[found["doc_id"] // 100 == k]
        assert own["run_keep"].tolist() == [k * 100] * n and own["run_first"].tolist() == [True] + [False] * (n - 1)
        sized = own[own["run_size"].notna()]
        assert len(sized) == (n if n <= 10 else 1) and set(sized["run_size"]) == {n} and set(sized["edge"]) == {k in (0, 6)}
        assert own["long_run"].nunique() == (n > 10)


def test_exact_long_runs_of_a_table(spark):
    rows = spark.range(60_000).selectExpr("id AS doc_id", "IF(id % 2 = 0, 'same', CAST(id AS STRING)) AS text").coalesce(4)
    found = exact_dedup(rows, keep="smallest")
    assert tuple(found.where("text_sha256 = sha2('same', 256)").selectExpr("count(*)", "min(keep_id)", "max(keep_id)", "min(group_size)", "max(group_size)", "count_if(kept)").first()) == (30_000, 0, 0, 30_000, 30_000, 1)
    assert found.count() == 60_000 and found.where("kept").count() == 30_001


# --- substrings


def brute_repeats(docs, length=200):
    raws = [(i, (t or "").encode()) for i, t in docs]
    seen = Counter(raw[a : a + length] for _, raw in raws for a in range(len(raw) - length + 1))
    out = []
    for i, raw in raws:
        gone = bytearray(len(raw))
        for a in range(len(raw) - length + 1):
            if seen[raw[a : a + length]] > 1:
                gone[a : a + length] = b"\1" * length
        kept = bytes(b for b, g in zip(raw, gone, strict=True) if not g)
        out.append((i, len(raw), sum(gone), len(re.findall(b"\1+", bytes(gone))), hashlib.sha256(kept).hexdigest()))
    return sorted(out, key=repr)


def found_repeats(docs):
    return sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in remove_repeats(docs).collect()), key=repr)


def test_repeats_of_the_table(spark, sf_dir):
    found = queries.QUERIES["op7_substring_dedup"](spark, sf_dir).collect()
    assert sorted(((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, r.kept_sha256) for r in found), key=repr) == brute_repeats(documents(spark, sf_dir))


def test_repeats(spark):
    assert found_repeats(fixtures.odd(spark)) == brute_repeats([r[:2] for r in fixtures.odd_rows()])
    twice = [(r.doc_id, r.text) for r in fixtures.twice(spark).collect()]
    assert found_repeats(fixtures.twice(spark)) == brute_repeats(twice)
    assert remove_repeats(fixtures.empty(spark)).count() == 0


def test_repeats_by_doubling_over_every_position(spark):
    """The plain method gives the spans of the sampled one, over batches of one row too."""
    docs = [(i, t or "") for i, t, *_ in fixtures.odd_rows()] + [(50, "ab" * 300), (51, "ab" * 90), (52, "a" * 200), (53, "a" * 199)]
    table = spark.createDataFrame(docs, "row long, text string")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        found = {(r.row, at) for r in spans_by_doubling(table).collect() for at in range(r.start, r.stop)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    sampled, _ = repeated_spans(table)
    assert found == {(r.row, at) for r in sampled.collect() for at in range(r.start, r.stop)} and found
    assert spans_by_doubling(table.limit(0)).count() == 0


def test_doubling_with_any_identifiers(spark):
    """Identifiers as large as numbers get, of both signs: the spans are those of small ones."""
    p, q = fixtures.text(31, 90), fixtures.text(32, 90)
    texts = ["x " + p[:500] + " y", p[:400] + "z" + q[:300], q[:300] + " w", p[:450]]
    plain = sorted(tuple(r) for r in spans_by_doubling(spark.createDataFrame(list(enumerate(texts)), "row long, text string")).collect())
    for ids in ([i << 36 for i in range(4)], [-(1 << 63), -1, 1 << 61, (1 << 63) - 1]):
        found = spans_by_doubling(spark.createDataFrame(list(zip(ids, texts, strict=True)), "row long, text string")).collect()
        assert sorted((ids.index(r.row), r.start, r.stop) for r in found) == plain and plain


def test_repeats_of_few_letters(spark):
    """Periodic texts, repeats at both ends, overlaps, and repeats of exactly one byte less than counts."""
    p, q = fixtures.text(31, 90), fixtures.text(32, 90)
    texts = ["ab" * 300, "ab" * 90, "a" * 199, "a" * 200, p[:200], "z" + p[:200], p[:199] + "!", q + q, q[10:230] + p[50:260], "ab" * 101 + q[:201], p[100:300] + p[101:302]]
    docs = list(enumerate(texts))
    assert found_repeats(spark.createDataFrame(docs, "doc_id long, text string")) == brute_repeats(docs)


# --- near-duplicates


def brute_near(docs, k, percent):
    sets = {}
    for i, t in docs:
        words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets[i] = {tuple(words[a : a + k]) for a in range(max(len(words) - k + 1, 1))} if words else set()
    label = {i: i for i in sets}

    def root(i):
        while label[i] != i:
            i = label[i]
        return i

    ids = sorted(sets)
    for x, a in enumerate(ids):
        for b in ids[x + 1 :]:
            both = len(sets[a] & sets[b])
            if both and 100 * both >= percent * (len(sets[a]) + len(sets[b]) - both):
                ra, rb = sorted((root(a), root(b)))
                label[rb] = ra
    return sorted((i, len(sets[i]), root(i), root(i) == i) for i in ids)


def test_near_of_the_table(spark, sf_dir):
    found = sorted(tuple(r[c] for c in ("doc_id", "n_shingles", "component_id", "kept")) for r in queries.QUERIES["op8_minhash"](spark, sf_dir).collect())
    assert found == brute_near(documents(spark, sf_dir), 2, 80)


def test_near(spark):
    docs = [(r[0], r[1]) for r in fixtures.odd_rows()]
    words = fixtures.text(40, 60).split()
    for n in range(12):  # a chain: neighbours are near, its ends are not
        words = [*words[: 5 * n], f"c{n}", *words[5 * n + 1 :]]
        docs.append((100 + n, " ".join(words)))
    table = spark.createDataFrame(docs, "doc_id long, text string")
    for k in (2, 5):
        assert sorted(tuple(r) for r in near_duplicates(table, words=k).collect()) == brute_near(docs, k, 80)


def test_near_repeated_and_empty(spark):
    found = near_duplicates(fixtures.twice(spark)).collect()
    assert len(found) == 6 and {r.component_id for r in found if r.doc_id is None} == {None} and all(r.kept for r in found if r.doc_id is None)
    # Each row of a repeated doc_id has its own text's set.
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in found if r.doc_id is not None) == sorted((i, len(brute_set(t, 5)), i) for i, t, *_ in fixtures.twice(spark).collect() if i is not None)
    base = fixtures.text(60, 100)
    docs = [(7, base), (7, "other words"), (3, base + " more"), (9, "other words")]
    found = near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), words=2).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in found) == [(3, 3, True), (7, 3, False), (7, 7, True), (9, 7, False)]
    assert near_duplicates(fixtures.empty(spark)).count() == 0


def brute_set(text, k):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(words[a : a + k]) for a in range(max(len(words) - k + 1, 1))} if words else set()


def test_near_in_a_crowd(spark):
    """Pairs just above the limit among many loosely alike documents: buckets are full of third ones, and no link is lost."""
    rng = random.Random(77)
    common = [f"c{i}" for i in range(118)]
    docs = [(i, " ".join(rng.sample(common, 70) + [f"o{i}-{j}" for j in range(15)])) for i in range(1500)]
    for n in range(40):
        words = docs[n * 30][1].split()
        for j in range(9):
            words[70 + j] = f"p{n}-{j}"
        docs.append((10_000 + n, " ".join(words)))
    expected = brute_near_pairs(docs, [(30 * n, 10_000 + n) for n in range(40)], 1, 80)
    found = {r.doc_id: r.component_id for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), words=1).collect()}
    assert len(expected) == 40 and all(found[a] == found[b] for a, b in expected)


def brute_near_pairs(docs, pairs, k, percent):
    sets = {i: brute_set(t, k) for i, t in docs}
    return [(a, b) for a, b in pairs if 100 * len(sets[a] & sets[b]) >= percent * len(sets[a] | sets[b])]


def test_near_long_text(spark):
    """Over a megabyte, handled in stretches."""
    rng = random.Random(5)
    long = " ".join(f"w{rng.randrange(10**6)}" for _ in range(200_000))
    docs = [(1, long), (2, long + " end"), (3, long[: len(long) // 2])]
    assert sorted(tuple(r) for r in near_duplicates(spark.createDataFrame(docs, "doc_id long, text string"), words=2).collect()) == brute_near(docs, 2, 80)


def test_components(spark):
    n = 300
    links = [(i, i + 1) for i in range(1, n)] + [(1000, i) for i in range(1001, 1400)] + [(7, 7), (1, 2)]
    found = {r.node: r.label for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: 1 for i in range(1, n + 1)} | {i: 1000 for i in range(1000, 1400)}


def test_near_behind_unlike_leads(spark):
    """Two like texts each of whose shared buckets is led by a third text that both are unlike."""
    words = [f"v{i}" for i in range(100)]
    lows = near_dedup.minima(near_dedup.shingle_sets(words, 1))
    rows = near_dedup.ROWS
    leads = [" ".join({words[i] for i in lows[:, b * rows : (b + 1) * rows].argmin(axis=0)}) for b in range(near_dedup.BANDS)]
    docs = [*enumerate(leads), (100, " ".join(words)), (101, " ".join([*words[5:], "w1"]))]
    table = spark.createDataFrame(docs, "doc_id long, text string")
    for block in (near_dedup.BLOCK, 1):
        old, near_dedup.BLOCK = near_dedup.BLOCK, block
        try:
            found = sorted(tuple(r) for r in near_duplicates(table, words=1).collect())
        finally:
            near_dedup.BLOCK = old
        assert found == brute_near(docs, 1, 80)
        assert {c for i, _, c, _ in found if i >= 100} == {100}


def test_components_of_long_chains(spark):
    """Two chains, of shuffled identifiers and with the smallest next to the largest."""
    n = 3000
    links = []
    for ids in (random.Random(5).sample(range(n), n), [n, *range(2 * n - 1, n, -1)]):
        links += zip(ids, ids[1:], strict=False)
    found = {r.node: r.label for r in connected_components(spark.createDataFrame(links, "a long, b long")).collect()}
    assert found == {i: i // n * n for i in range(2 * n)}


# --- tokens


def brute_tokens(docs, end_id):
    library, start = Tokenizer.from_file(WORDS), 0
    for i, t in sorted(docs, key=lambda x: x[0]):
        ids = library.encode(t or "", add_special_tokens=False).ids + [end_id]
        yield i, start, ids
        start += len(ids)


def crc(ids):
    return zlib.crc32(b"".join(x.to_bytes(4, "little") for x in ids))


@pytest.mark.parametrize("whose", ["table", "odd"])
def test_token_files(spark, sf_dir, whose):
    docs = documents(spark, sf_dir) if whose == "table" else [r[:2] for r in fixtures.odd_rows()]
    found = queries.QUERIES["op10_token_files"](spark, sf_dir) if whose == "table" else read_token_files(*write_token_files(fixtures.odd(spark), WORDS, 1, length=16, rows=4))
    assert sorted((r.doc_id, r.start, r.n_tokens, r.ids_crc32) for r in found.collect()) == [(i, s, len(ids), crc(ids)) for i, s, ids in brute_tokens(docs, 1)]


def test_token_file_sequences(spark):
    folder, index = write_token_files(fixtures.odd(spark).coalesce(1), WORDS, 1, length=16, rows=4)
    for name in {r.file for r in index.collect()}:
        own = sorted((r.place, r.n_tokens) for r in index.where(f"file = '{name}'").collect())
        total, file = own[-1][0] + own[-1][1], TokenFile(folder, name)
        for k in range(-(-total // 16)):
            ids, mask = file.sequence(k)
            assert len(ids) == 16 and mask.sum() == min(16, total - 16 * k)
        with pytest.raises((ValueError, IndexError)):
            list(file.span(total, 1)) or next(iter(()), None) or file.batch(10**6)
        file.close()


def test_token_files_repeated_and_empty(spark):
    found = read_token_files(*write_token_files(fixtures.twice(spark), WORDS, 1)).collect()
    assert len(found) == 6 and sum(r.n_tokens for r in found) == max(r.start + r.n_tokens for r in found)
    assert read_token_files(*write_token_files(fixtures.empty(spark), WORDS, 1)).count() == 0


# --- packing


def check_packing(rows, docs, capacity=2048):
    pieces = {(r.doc_id, r.piece): r for r in rows}
    assert len(pieces) == len(rows)
    total = 0
    for i, _, ids in brute_tokens(docs, 0):
        total += len(ids)
        for k, a in enumerate(range(0, len(ids), capacity)):
            r, cut = pieces.pop((i, k)), ids[a : a + capacity]
            assert (r.start, r.length, r.ids_crc32) == (a, len(cut), crc(cut))
    assert not pieces
    sequences = defaultdict(list)
    for r in rows:
        sequences[r.sequence_id].append((r.offset, r.length))
    for own in sequences.values():
        at = 0
        for offset, length in sorted(own):
            assert offset == at
            at += length
        assert at <= capacity
    return len(sequences), -(-total // capacity)


def test_packing_of_the_table(spark, sf_dir):
    used, bound = check_packing(queries.QUERIES["op3_packing"](spark, sf_dir).collect(), documents(spark, sf_dir))
    assert used <= 1.01 * bound + 2


def test_packing(spark):
    used, bound = check_packing(pack_documents(fixtures.odd(spark), WORDS, 0).collect(), [r[:2] for r in fixtures.odd_rows()])
    assert used <= bound + 1
    assert pack_documents(fixtures.twice(spark), WORDS, 0).count() == 6
    assert pack_documents(fixtures.empty(spark), WORDS, 0).count() == 0


def test_pack_hard_sizes(spark):
    """Sizes of which each bin takes exactly three: nearly as few bins as there can be, and every piece once."""
    lengths = [n for b in range(60) for n in (500 + b, 620 - b // 2, 928 - b + b // 2)]
    found = pack(spark.createDataFrame(list(enumerate(lengths)), "row long, length long")).collect()
    alone, _ = best_fit(sorted(lengths, reverse=True), [], 2048)
    assert len(found) == 180 and len({r.sequence_id for r in found}) <= 62 < max(alone) + 1
    with pytest.raises(ValueError):
        pack(spark.createDataFrame([(1, 4000)], "row long, length long"))


def test_fit_by_pairs():
    rng = random.Random(3)
    for _ in range(20):
        lengths = [rng.randrange(0, 101) for _ in range(rng.randrange(1, 200))]
        fills = Counter()
        for n, b in zip(lengths, fit_by_pairs(lengths, 100), strict=True):
            fills[b] += n
        assert max(fills.values()) <= 100 and sum(fills.values()) == sum(lengths)


def test_repeats_across_stretches(spark):
    """A text of several stretches that repeats nothing but one passage, which lies where two of them meet."""
    rng = random.Random(12)
    long = "".join(rng.choices("abcdefghijklmnopqrstuvwxyz ", k=9_000_000))
    cut = 1 << 22
    passage = long[cut - 300 : cut + 300]
    found = found_repeats(spark.createDataFrame([(1, long), (2, "0" + passage + "1"), (3, "x")], "doc_id long, text string"))
    assert [x[:4] for x in found] == [(1, 9_000_000, 600, 1), (2, 602, 600, 1), (3, 1, 0, 0)]
