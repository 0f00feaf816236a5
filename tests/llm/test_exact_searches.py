"""Hard-negative mining, license scans and vector codes against brute force on small tables."""

import hashlib
import math
import random
import re

import numpy as np
import pytest
from pyspark.sql import functions as F

from logmeridian.llm import bpe, coordinate_pruning, dual_tree, kd_sharding, license_scan, line_dedup, mixing, ngram_join, pii, pitman_yor, quality
from logmeridian.llm import words as W

VECTORS = "vec_id long, embedding array<double>, label int, bucket string, block int, score string, v int, word string"


def table(spark, rows):
    return spark.createDataFrame([(*r, "clash", 1, "clash", 2, "clash") for r in rows], VECTORS)


def awkward_rows(seed=3, n=400, spread=0.15):
    """Clustered directions of different lengths, ties, repeated rows, and rows that take no part."""
    rng = np.random.default_rng(seed)
    centres = rng.normal(size=(6, 16))
    rows = []
    for i in range(n):
        x = centres[i % 6] + spread * rng.normal(size=16)
        rows.append((i, (x / np.linalg.norm(x) * (1 + 3 * (i % 4))).tolist(), int(rng.integers(0, 3)) if i % 11 else None))
    rows += [(n + i, rows[6][1], 1) for i in range(40)]  # a tie
    rows += [rows[6], rows[12], (n + 50, None, 1), (n + 51, [], 1), (n + 52, [1.0, None, 2.0], 1), (n + 53, [float("nan")] * 16, 1), (n + 54, [float("inf")] * 16, 1)]
    rows += [(None, rows[3][1], 1), (n + 55, [0.0] * 16, 2), (n + 56, [1.0, -0.5], 0), (n + 100, [2.0] * 16, 1), (n + 101, [1e300] + [0.0] * 15, 1)]
    return rows


def integers(rows, scale, limit, width=16):
    out = []
    for i, v, label in rows:
        if v and all(x is not None and math.isfinite(x) and abs(x) * scale < limit for x in v):
            out.append((i, label, [math.floor(x * scale) for x in v] + [0] * (width - len(v))))
    return out


def brute_negatives(rows, anchors):
    rows = sorted({(i, l, tuple(v)) for i, l, v in integers(rows, 256, 2**27) if i is not None and l is not None})
    out = set()
    for i, label, v in rows:
        if not anchors(i):
            continue
        scored = sorted((-sum(a * b for a, b in zip(v, w, strict=True)), j, k) for j, k, w in rows if j != i)
        for p, j, _ in [s for s in scored if s[2] == label][:5]:
            band = [(m, n) for n, m, k in scored if k != label and 50 * -p <= 100 * -n <= 95 * -p][:3]
            out |= {(i, j, r, m, -p, -n) for r, (m, n) in enumerate(band, 1)}
    return out


@pytest.mark.parametrize("spread", [0.6, 0.15])
def test_hard_negatives_equal_brute_force(spark, monkeypatch, spread):
    monkeypatch.setattr(coordinate_pruning, "RUN", 64)
    monkeypatch.setattr(coordinate_pruning, "LEAST_ROWS", 150)
    rows = awkward_rows(spread=spread)
    vectors = table(spark, rows)
    out = coordinate_pruning.mine_hard_negatives(vectors, vectors.where("vec_id % 5 = 0"))
    assert out.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    got = [tuple(r) for r in out.collect()]
    assert len(got) == len(set(got)) > 50
    assert set(got) == brute_negatives(rows, lambda i: i % 5 == 0)


def test_sorted_lists_leave_rows_out_and_lose_none():
    rng = np.random.default_rng(1)
    rows = np.concatenate([rng.normal(size=(200, 8)) * 0.05 + c for c in np.eye(8)])
    rows = (rows * 256).astype(np.int64)
    run = coordinate_pruning.Run(np.arange(len(rows)), np.zeros(len(rows), np.int64), rows)
    anchors = rows[::100]
    lengths = np.sqrt((anchors.astype(float) ** 2).sum(axis=1))
    need = 0.9 * lengths * lengths
    seen, looked = set(), 0
    for few, at in coordinate_pruning.candidates(run, anchors, lengths, need):
        assert at is not None
        looked += len(at)
        true = np.flatnonzero(anchors[few[0]] @ run.rows.T >= need[few[0]])
        assert set(true) <= set(at)
        seen.add(few[0])
    assert len(seen) == len(anchors)
    assert looked < 0.2 * len(anchors) * len(rows)


def test_hard_negatives_of_nothing(spark):
    empty = table(spark, []).where("vec_id = 1")
    assert coordinate_pruning.mine_hard_negatives(empty, empty).count() == 0
    few = table(spark, [(0, [1.0, 0.0], 1), (50, [1.0, 0.0], 2)])
    assert coordinate_pruning.mine_hard_negatives(few, few).count() == 0


def brute_codes(rows, rounds=6, entries=16, parts=8):
    kept = integers(rows, 4096, 2**27)
    kept = sorted(kept, key=lambda r: (r[0] is None, r[0], r[2]))
    x = np.array([r[2] for r in kept], np.int64).reshape(len(kept), parts, -1).transpose(1, 0, 2)
    books = x[:, :entries].copy()
    nearest = lambda: np.array([((x[p][:, None] - books[p][None]) ** 2).sum(axis=2).argmin(axis=1) for p in range(parts)])
    for _ in range(rounds):
        at = nearest()
        for p in range(parts):
            for e in range(books.shape[1]):
                if (at[p] == e).any():
                    books[p, e] = x[p][at[p] == e].sum(axis=0) // (at[p] == e).sum()
    at = nearest()
    error = sum(((x[p] - books[p][at[p]]) ** 2).sum(axis=1) for p in range(parts))
    by_label = {}
    for (_, label, _), e in zip(kept, error.tolist(), strict=True):
        by_label[label] = by_label.get(label, 0) + e
    found = [(r[0], r[1], "".join(f"{c:02x}" for c in at[:, i]), int(error[i]), by_label[r[1]]) for i, r in enumerate(kept)]
    return found, hashlib.sha256(",".join(map(str, books.ravel().tolist())).encode()).hexdigest()


@pytest.mark.parametrize("few_labels", [10_000, 0])
def test_vector_codes_equal_plain_rounds(spark, monkeypatch, few_labels):
    monkeypatch.setattr(dual_tree, "FEW_LABELS", few_labels)
    monkeypatch.setattr(dual_tree, "BLOCK_ROWS", 128)
    rows = awkward_rows(seed=8)
    out, books = dual_tree.compress_vectors(table(spark, rows).repartition(3))
    expected, digest = brute_codes(rows)
    key = lambda r: tuple((x is None, x) for x in r)
    assert sorted(map(tuple, out.collect()), key=key) == sorted(expected, key=key)
    assert dual_tree.codebooks_digest(books) == digest


def test_nodes_are_assigned_whole_where_bounds_allow_it():
    rng = np.random.default_rng(4)
    book = np.array([[0, 0], [1000, 0], [0, 1000], [1000, 1000]])
    points = np.concatenate([c + rng.integers(-50, 50, (256, 2)) for c in book])
    tree = dual_tree.grow(points, 16)
    codes = np.full(len(points), -1)
    unseen = np.zeros_like(points)  # whole nodes do not look at single points
    counts, sums = dual_tree.walk(tree, unseen, book, codes)
    assert codes.tolist() == np.repeat(np.arange(4), 256).tolist()
    assert counts.tolist() == [256] * 4
    assert sums.tolist() == [points[codes == e].sum(axis=0).tolist() for e in range(4)]


def test_vector_codes_of_nothing_and_of_few(spark):
    out, books = dual_tree.compress_vectors(table(spark, []).where("vec_id = 1"))
    assert (out.count(), books.size) == (0, 0)
    out, books = dual_tree.compress_vectors(table(spark, [(5, [0.5] * 8, None), (2, [-0.5] * 8, None)]))
    assert [tuple(r) for r in out.orderBy("vec_id").collect()] == [(2, None, "00" * 8, 0, 0), (5, None, "01" * 8, 0, 0)]
    assert books[0].tolist() == [[-2048], [2048]]


WORDS = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def brute_scan(text):
    words = WORDS.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    base = [(i, label) for phrase, label in license_scan.PHRASES.items() for i in range(len(words)) if words[i : i + len(phrase.split())] == phrase.split()]
    matches = []
    for t in license_scan.templates(license_scan.TEMPLATES, license_scan.CONTAINMENT):
        for first in range(0, max(1, math.ceil(len(words) / t.span) - 1) * t.span, t.span):
            both = len(set(t.words) & set(words[first : first + 2 * t.span]))
            if both >= t.required:
                matches.append((t.label, first, len(words[first : first + 2 * t.span]), both / len(t.words)))
    starts = [i for i, _ in base]
    return (
        len(words), len(base), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in base})),
        ",".join(sorted({x for _, x in base} | {m[0] for m in matches})), max((m[3] for m in matches), default=0.0), sorted(matches),
    )


def scan_texts():
    rng = random.Random(2)
    vocabulary = ["the", "of", "license", "permission", "notice", "software", "Ñu", "x1", "copies", "under", "é"]
    notices = [t for _, t in license_scan.TEMPLATES]
    texts = [None, "", " \n-- ", "CC BY cc by-nc 4.0 CC", "mit license", "a MIT-License, the GNU\nGeneral  Public\tLicense", "THE MİT LICENSE", "the Kelvin license"]
    for notice in notices:
        words = notice.split(" ")
        texts += [notice, notice.upper(), " ".join(words[: len(words) // 2]), "\n".join(words)]
        for _ in range(4):
            few = [w for w in words if rng.random() > 0.08]
            texts.append(" ".join([rng.choice(vocabulary) for _ in range(rng.randint(0, 300))] + few + [rng.choice(vocabulary) for _ in range(rng.randint(0, 60))]))
    texts += [" ".join(rng.choice(vocabulary) for _ in range(40_000)) + " " + notices[0], "license" * 30_000]
    return texts + texts[:12]


def test_license_scan_equals_brute_force(spark):
    texts = scan_texts()
    rows = [(i if i % 9 else None, t, i, "clash", "clash", 1) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, place long, words string, row string, n_words int")
    out = license_scan.license_scan(docs, id_column="place").collect()
    assert len(out) == len(texts)
    got = {r["place"]: (*r[1:8], sorted(tuple(m) for m in r["matches"])) for r in out}
    assert got == {i: brute_scan(t) for i, t in enumerate(texts)}
    assert sum(bool(r["matches"]) for r in out) > 20
    with_nulls = license_scan.license_scan(docs).groupBy("doc_id").count().where("doc_id is null").first()
    assert with_nulls["count"] == len([i for i in range(len(texts)) if i % 9 == 0])


def test_license_scan_of_nothing(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert license_scan.license_scan(empty).count() == 0


def test_license_scan_needs_no_python(spark):
    docs = spark.createDataFrame([(1, "mit license")], "doc_id long, text string")
    plan = license_scan.license_scan(docs)._jdf.queryExecution().toString()
    assert not re.search("Python|Arrow|Pandas", plan)
    assert docs.select(F.lit(1)).count() == 1


def thue_morse(n, flip=False):
    return "".join("ab"[(bin(i).count("1") + flip) % 2] for i in range(n))


@pytest.mark.parametrize("n", [1024, 4096])
def test_words_with_equal_polynomials_are_told_apart(spark, n):
    a, b = thue_morse(n), thue_morse(n, True)
    raw = np.frombuffer((a + b).encode(), np.uint8)
    hashes = W.slice_hashes(raw, np.array([0, n]), np.array([n, 2 * n]))
    assert hashes[0] != hashes[1]
    docs = spark.createDataFrame([(0, a), (1, b), (2, f"{a}\n{b}"), (3, f"{a} {a}")], "doc_id long, text string")
    joined = {r["doc_id"]: r["component_id"] for r in ngram_join.ngram_jaccard_join(docs).collect()}
    assert joined == {0: 0, 1: 1, 2: 2, 3: 3}
    labels = spark.createDataFrame([], "doc_id long, quality int")
    assert {r["doc_id"]: r["n_dup_lines"] for r in quality.quality_rules(docs, labels).collect()} == {0: 0, 1: 0, 2: 0, 3: 0}
    scored = pitman_yor.score_texts(docs, F.col("doc_id") == 1).collect()
    assert {r["doc_id"]: r["n_known"] for r in scored} == {0: 2, 1: 2, 2: 3, 3: 3}
    path = bpe.default_vocabulary()
    back = bpe.bpe_decode(bpe.bpe_encode(docs, path), path).collect()
    assert {r["doc_id"]: bytes(r["decoded"]).decode() for r in back} == {r["doc_id"]: r["text"] for r in docs.collect()}


def test_slices_of_equal_hash_are_compared_by_bytes(monkeypatch):
    monkeypatch.setattr(W, "slice_hashes", lambda data, starts, ends: np.zeros(len(starts), np.uint64))
    raw = np.frombuffer(b"abcdefghijabcdefghiXabcdefghijab", np.uint8)
    starts, ends = np.array([0, 10, 20, 30]), np.array([10, 20, 30, 32])
    one, back = bpe.distinct_slices(raw, starts, ends)
    assert [bytes(raw[starts[one[k]] : ends[one[k]]]) for k in back] == [bytes(raw[a:b]) for a, b in zip(starts, ends, strict=True)]
    assert back[0] == back[2]


def test_long_slices_without_a_break_equal_the_library():
    import time

    import tiktoken
    from public_tokenizers import PATTERN

    path = bpe.default_vocabulary()
    vocabulary = bpe.load_vocabulary(path)
    library = tiktoken.Encoding("x", pat_str=PATTERN, mergeable_ranks=vocabulary.ranks, special_tokens={})
    rng = random.Random(6)
    for text in ["".join(rng.choice("abcdefgh") for _ in range(3000)), "ab" * 700, "a" * 1000, "".join(rng.choice("eaé日t") for _ in range(2000))]:
        raw = np.frombuffer(text.encode(), np.uint8)
        assert bpe.Encoder(vocabulary)(raw, np.array([0, len(raw)]))[0].tolist() == library.encode_ordinary(text)
    long = "".join(rng.choice("abcdefghijklmnopqrstuvwxyz") for _ in range(1_000_000))
    raw = np.frombuffer(long.encode(), np.uint8)
    began = time.time()
    ids = bpe.Encoder(vocabulary)(raw, np.array([0, len(raw)]))[0]
    assert time.time() - began < 30
    assert bpe.decode_ids(ids, vocabulary).tobytes() == raw.tobytes()


def test_trusted_documents_are_found_by_one_plan(spark, monkeypatch):
    monkeypatch.setattr(quality, "FILTER_BITS", 1 << 6)  # a crowded table lets others through to the join
    texts = spark.createDataFrame([(i if i % 10 else None, 0, f"t{i}") for i in range(500)], "id long, fold int, text string")
    ids = spark.createDataFrame([(i,) for i in range(0, 500, 3)] + [(9999,)], "id long")
    got = quality.among(texts, ids)
    assert {r["id"] for r in got.collect()} == {i for i in range(0, 500, 3) if i % 10}
    assert "SortMergeJoin" in got._jdf.queryExecution().toString()


def test_helper_names_do_not_clash(spark):
    schema = "doc_id long, text string, source string, key string, gone string, key_ string, gone_ int, u double, source_key string, cdf int, salt string, U_ int"
    rows = [(i, f"same line\nown line {i}", f"s{i}", "k", "g", "k2", i, 0.5, "sk", 3, "z", -i) for i in range(12)]
    docs = spark.createDataFrame(rows, schema)
    out = line_dedup.dedup_lines(docs).orderBy("doc_id").collect()
    assert [tuple(r)[:12] for r in out] == [(r[0], f"own line {r[0]}", *r[2:]) for r in rows]
    mixed = mixing.mix_sources(docs).select(docs.columns).distinct().collect()
    assert mixed
    assert {tuple(r) for r in mixed} <= set(rows)


def brute_shards(texts, shards):
    """Every node cut along its widest dimension, the keys in order, at the wanted bytes."""
    import math
    import zlib

    def scaled(x):
        return min(math.floor(math.log2(x + 1) * (2.0**30 / 40)), 2**30 - 1)

    points = []
    for i, t in enumerate(texts):
        raw, lines, spaces = (t or "").encode(), (t or "").count("\n"), (t or "").count(" ")
        n = len(t or "")
        dims = [scaled(len(raw)), scaled(len(raw) * 1000 // n if n else 0), scaled(lines), scaled(int(n * 1000 / (lines + spaces + 1)))]
        points.append((i, len(raw) + kd_sharding.OVERHEAD, dims, zlib.crc32(raw)))
    spread = lambda some, j: max(p[2][j] for p in some) - min(p[2][j] for p in some)
    whole = [max(1, spread(points, j)) for j in range(4)]
    out, todo = {}, [(points, 0, shards)]
    while todo:
        some, a, b = todo.pop()
        if b - a == 1:
            out |= {p[0]: a for p in some}
            continue
        j = max(range(4), key=lambda j: (spread(some, j) / whole[j], -j))
        some = sorted(some, key=lambda p: (p[2][j], p[3]))
        want, left, best = sum(p[1] for p in some) * ((b - a) // 2) / (b - a), 0, 0
        for k, p in enumerate(some):
            if abs(left + p[1] - want) >= abs(left - want):
                break
            left, best = left + p[1], k + 1
        todo += [(some[:best], a, a + (b - a) // 2), (some[best:], a + (b - a) // 2, b)]
    return out


def test_shards_are_cut_along_the_widest_dimension(spark, monkeypatch):
    """Against a tree that sorts; with distinct texts, cuts differ by no more than the row they go through."""
    rng = random.Random(11)
    texts = ["".join(rng.choice("abcñ日 \n") for _ in range(rng.randint(5, 400))) + str(i) for i in range(300)]
    monkeypatch.setattr(kd_sharding, "TOLERANCE", 0.0)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r["doc_id"]: r["shard"] for r in kd_sharding.kd_shards(docs, 4).collect()}
    expected = brute_shards(texts, 4)
    assert sum(got[i] != expected[i] for i in got) <= 6


def test_a_sample_of_many_examples_is_that_of_all(spark, monkeypatch):
    monkeypatch.setattr(pii, "SAMPLE", 40)
    seen = []
    monkeypatch.setattr(pii.boosting, "fit", lambda x, y, fit=pii.boosting.fit: seen.append((x.tolist(), y.tolist())) or fit(x, y))
    texts = spark.createDataFrame([(f"write to user{i}@example{i}.org or call +1 202 555 {1000 + i}",) for i in range(300)], "text string")
    pii.fit_selector(texts)
    monkeypatch.setattr(pii.F, "conv", lambda *_: pii.F.lit(2**40))  # nothing passes: all are ordered
    pii.fit_selector(texts)
    assert seen[0] == seen[1] and len(seen[0][0]) > 5
