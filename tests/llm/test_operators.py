"""Each operator against brute force on small tables with nulls, empty and long texts, ties and repeated rows."""

import base64
import collections
import hashlib
import random
import re

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from logmeridian.llm import bpe, cross_polytope, kd_sharding, line_dedup, mixing, ngram_join, pii, pitman_yor, quality, warc
from logmeridian.llm import words as W

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, source string, n_lines string, mix_key int, extra string"


def documents(spark, texts, sources=None):
    rows = [(i, t, sources[i] if sources else f"s{i % 3}", "clash", 7, None) for i, t in enumerate(texts)]
    return spark.createDataFrame([*rows, (None, "a row without an id but with some words", None, None, None, None)], SCHEMA)


def corpus(seed=1, n=60):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(400)]
    texts = []
    for i in range(n):
        kind = rng.random()
        if i and kind < 0.4:
            base = (rng.choice(texts) or "").split(" ")
            for _ in range(rng.randint(0, 3)):
                base[rng.randrange(len(base))] = rng.choice(words)
            texts.append(" ".join(base))
        elif kind < 0.5:
            texts.append(" ".join(rng.choice(words) for _ in range(rng.randint(0, 9))))
        else:
            texts.append(" ".join(rng.choice(words) for _ in range(rng.randint(20, 120))))
    return [*texts, None, "", "  \n\t ", "Alpha beta", "ALPHA  beta", texts[0], "long " * 30_000, texts[0].upper()]


def shingles(text):
    found = WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    return {tuple(found[i : i + 5]) for i in range(len(found) - 4)} if len(found) >= 5 else ({tuple(found)} if found else set())


def expected_components(texts):
    sets, root = [shingles(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * len(sets[i] | sets[j]):
                a, b = root[i], root[j]
                root = [min(a, b) if r in (a, b) else r for r in root]
    return [(len(s), r) for s, r in zip(sets, root, strict=True)]


@pytest.mark.parametrize("hot", [64, 3])
def test_ngram_join_equals_all_pairs(spark, monkeypatch, hot):
    monkeypatch.setattr(ngram_join, "LOCALLY_HOT", hot)
    texts = corpus()
    out = ngram_join.ngram_jaccard_join(documents(spark, texts)).collect()
    assert len(out) == len(texts) + 1
    assert {r["doc_id"]: (r["n_shingles"], r["component_id"]) for r in out if r["doc_id"] is not None} == dict(enumerate(expected_components(texts)))


def test_ngram_join_of_nothing(spark):
    assert ngram_join.ngram_jaccard_join(documents(spark, []).where("doc_id = 1")).count() == 0


def test_subset_sizes_cover_the_required_overlaps():
    for n in range(1, 12):
        for m in range(1, 12):
            if 4 * min(n, m) >= 3 * max(n, m):
                assert ngram_join.required(n, m, 75) in ngram_join.subset_sizes(n, 12, 75)
                assert 100 * ngram_join.required(n, m, 75) >= 75 * (n + m - ngram_join.required(n, m, 75))


def brute_spans(text):
    out = [(0, *m.span()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", text)]
    out += [(1, *m.span()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", text) if all(int(p) <= 255 for p in m[0].split("."))]
    for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", text):
        digits = re.sub("[^0-9]", "", m[0])
        if 13 <= len(digits) <= 19 and sum(sum(map(int, str(int(c) * (1 + i % 2)))) for i, c in enumerate(digits[::-1])) % 10 == 0:
            out.append((2, *m.span()))
    return out + [(3, *m.span()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", text) if 9 <= len(re.findall("[0-9]", m[0])) <= 15]


def test_base_spans_on_random_texts():
    rng = random.Random(3)
    for _ in range(20_000):
        text = "".join(rng.choice("0123456789" if rng.random() < 0.6 else "ab@@..-- +()é[at]") for _ in range(rng.randint(0, 40)))
        assert pii.base_spans(text) == brute_spans(text)


def test_pii_rows(spark):
    texts = [None, "", "mail a.b@c.de, ip 10.0.0.1 and 999.1.1.1", "card 4111 1111 1111 1111 tel +49 (30) 1234-567", "9" * 5000, "plain words"]
    out = {r["doc_id"]: r for r in pii.find_pii(documents(spark, texts)).collect()}
    for i, text in enumerate(texts):
        assert out[i]["base_spans"] == pii.spans_text(brute_spans(text or ""))
    assert out[2]["redacted"] == "mail <EMAIL>, ip <IP> and 999.1.1.1" and out[0]["redacted"] == ""


def test_pii_finds_forms_that_the_base_rules_do_not(spark):
    rng = random.Random(5)
    number = lambda n: "".join(rng.choice("123456789") for _ in range(n))
    card = lambda d: next(d + c for c in "0123456789" if pii.luhn(d + c))
    texts = []
    for i in range(1200):
        ip = ".".join(str(rng.randint(1, 255)) for _ in range(4))
        texts.append(f"mail user{i}@host{i % 9}.org, host {ip} , card {card('4' + number(14))} , phone +{number(rng.randint(9, 12))} , since {number(1)},{number(3)},{number(3)} times.")
    good = ["mail jane.doe [at] example [dot] org today", "phone (415) 555-2671 , or", "card 4111.1111.1111.1111 , or", "host 10[.]20[.]30[.]40 , or"]
    bad = ["card 4111.1111.1111.1112 , or", "host 10[.]20[.]30[.]940 , or", "since 2019-03-14 , or"]
    out = {r["doc_id"]: r for r in pii.find_pii(documents(spark, [*texts, *good, *bad])).collect()}
    assert all(out[1200 + i]["base_spans"] == "" for i in range(7))
    assert [out[1200 + i]["redacted"] for i in range(4)] == ["mail <EMAIL> today", "phone <PHONE> , or", "card <CARD> , or", "host <IP> , or"]
    assert [out[1204 + i]["redacted"] for i in range(3)] == bad


def test_boosting_learns_and_does_not_depend_on_row_order():
    rng = np.random.default_rng(0)
    x = rng.normal(size=(2000, 4))
    y = ((x[:, 0] > 0.3) ^ (x[:, 2] > 0)).astype(float)
    model, again = pii.boosting.fit(x[:1000], y[:1000]), pii.boosting.fit(x[:1000][::-1], y[:1000][::-1])
    assert ((model.score(x[1000:]) > 0.5) == (y[1000:] == 1)).mean() > 0.9
    assert np.array_equal(model.score(x), again.score(x))


def test_trees_of_a_table_are_those_of_its_rows(spark, monkeypatch):
    """All rows count: a table's trees agree with those of the same rows in arrays, and tell them apart."""
    monkeypatch.setattr(pii.boosting, "ROUNDS", 12)
    rng = np.random.default_rng(1)
    x = rng.integers(0, 40, size=(3000, 3)).astype(float)
    y = ((x[:, 0] > 20) ^ (x[:, 2] > 15)).astype(float)
    table = spark.createDataFrame([(r.tolist(), bool(v)) for r, v in zip(x, y, strict=True)], "x array<double>, label boolean")
    local, spread = pii.boosting.fit(x, y), pii.boosting.fit(pii.boosting.Spread(table, "x"), pii.boosting.Spread(table, "label"))
    assert all(np.allclose(a, b) for a, b in zip(local.cuts, spread.cuts, strict=True))
    assert np.abs(local.score(x) - spread.score(x)).max() < 0.02
    assert ((spread.score(x) > 0.5) == (y == 1)).mean() > 0.95


def test_quality_statistics_and_verdicts(spark):
    rng = random.Random(5)
    good = [" ".join(rng.choice(["the", "and", f"n{rng.randint(0, 40)}", f"m{rng.randint(0, 40)}"]) for _ in range(120)) for _ in range(30)]
    bad = [" ".join(f"{rng.choice(['x', 'y', 'z'])}###{rng.randint(0, 999)}" for _ in range(120)) for _ in range(10)]
    texts = [*good, *bad, None, "", "a b c " * 40, "same line é\nsame line é\n \n \nother"]
    labels = spark.createDataFrame([*[(i, 1, 0) for i in range(20)], *[(30 + i, 0, 0) for i in range(7)], (None, 1, 0), (3, None, 0)], "doc_id long, quality int, text int")
    out = {r["doc_id"]: r for r in quality.quality_rules(documents(spark, texts), labels).collect()}
    for i, text in enumerate(texts):
        found = WORD.findall(text or "")
        windows = collections.Counter(zip(found, found[1:], found[2:], strict=False))
        covered = {j + k for j in range(len(found) - 2) if windows[tuple(found[j : j + 3])] > 1 for k in range(3)}
        lines = [x for x in (text or "").split("\n") if WORD.search(x)]
        expected = (len(found), sum(map(len, found)), len(re.findall(r"[#*$%&|<>]", text or "")), len(lines) - len(set(lines)), len(covered))
        assert tuple(out[i][c] for c in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")) == expected
    assert all(out[i]["kept"] for i in range(30)) and not any(out[30 + i]["kept"] for i in range(10))
    assert out[42]["base_failed"] and not out[40]["kept"]
    assert len(out) == len(texts) + 1


def test_pitman_yor_counts_and_probabilities(spark):
    texts = [t[:2000] if t else t for t in corpus(7, 80)]
    docs = documents(spark, texts)
    out = {r["doc_id"]: r for r in pitman_yor.score_texts(docs, F.col("doc_id") % 5 == 0).collect()}
    tokens = {i: WORD.findall((t or "").lower()) + ["\0"] for i, t in enumerate(texts)}
    tokens[None] = "a row without an id but with some words".split() + ["\0"]
    counts = collections.Counter(w for i, t in tokens.items() if i is None or i % 5 for w in t)
    total, vocabulary = sum(counts.values()), len(counts)
    for i, found in tokens.items():
        base = sum(np.log10((counts[w] + 1) / (total + vocabulary + 1)) for w in found)
        assert (out[i]["n_tokens"], out[i]["n_known"], out[i]["train_tokens"]) == (len(found), sum(counts[w] > 0 for w in found), total)
        assert out[i]["base_score"] == pytest.approx(base)
        assert out[i]["score"] < 0
    held = [i for i in out if i is not None and i % 5 == 0 and texts[i]]
    assert sum(out[i]["score"] for i in held) > sum(out[i]["base_score"] for i in held)


def restaurants(seed=2, contexts=3, words=12, most=200, hot=()):
    """One block in which every context is followed by every word, and what the root knows of it."""
    rng = np.random.default_rng(seed)
    context, word = (np.sort(rng.integers(1, 2**63, n).astype(np.uint64)) for n in (contexts, words))
    count = rng.integers(1, most, contexts * words)
    data = [pitman_yor.pack_sorted(context), pitman_yor.pack_sorted(word), *(pitman_yor.pack(x) for x in (np.full(contexts, words), np.tile(np.arange(words), contexts), count))]
    model = pitman_yor.Model(context[list(hot)], discount=0.7, root_discount=0.6)
    model.totals = {pitman_yor.KNOWN: words, pitman_yor.TOKENS: int(count.sum()), pitman_yor.ROOT_CUSTOMERS: contexts * words, pitman_yor.ROOT_TABLES: words}
    return pitman_yor.Block(data, model), model, np.full(words, contexts), np.ones(words)


@pytest.mark.parametrize("hot", [(), (1,)])
def test_pitman_yor_probabilities_sum_to_one(hot):
    block, model, customers, seats = restaurants(hot=hot)
    of_hot = [sum(block.count[block.of == i]) for i in hot]
    model.totals |= {pitman_yor.FIRST_HOT + i: n for i, n in enumerate(of_hot)} | {pitman_yor.FIRST_HOT + len(hot) + i: 12.0 for i in range(len(hot))}
    block = pitman_yor.Block([pitman_yor.pack_sorted(block.contexts), pitman_yor.pack_sorted(block.words), *(pitman_yor.pack(x) for x in (np.full(3, 12), block.word, block.count))], model)
    tables = block.sweep(np.ones(len(block.count)), customers, seats, np.random.default_rng(1))
    assert (tables >= 1).all() and (tables <= block.count).all()
    customers = block.by_word(tables)
    model.totals |= {pitman_yor.ROOT_CUSTOMERS: customers.sum()} | {pitman_yor.FIRST_HOT + len(hot) + i: tables[block.of == c].sum() for i, c in enumerate(hot)}
    p = block.probability(tables, customers, seats)
    unknown = model.root_chance(np.zeros(1), np.zeros(1))[0]
    total = block.all_tables(tables)
    for c in range(3):
        new = (pitman_yor.STRENGTH + 0.7 * total[c]) / (pitman_yor.STRENGTH + block.customers[c])
        assert p[block.of == c].sum() + new * unknown == pytest.approx(1)


@pytest.mark.parametrize("customers", [2, 5, 40])
def test_tables_are_drawn_from_their_conditional_distribution(customers):
    """Against the frequencies of explicit seatings that end with all customers at one dish."""
    d, chance, others = 0.6, 0.3, 4.0
    weight = {1: 1.0}
    for c in range(1, customers):  # unnormalised weights of t tables after c + 1 customers, one by one
        after = {}
        for t, w in weight.items():
            after[t] = after.get(t, 0) + w * (c - d * t)
            after[t + 1] = after.get(t + 1, 0) + w * (pitman_yor.STRENGTH + d * (others + t)) * chance
        weight = {t: w / sum(after.values()) for t, w in after.items()}
    drawn = pitman_yor.draw_tables(np.full(20_000, customers), np.full(20_000, others), np.full(20_000, chance), d, np.random.default_rng(3))
    total = sum(weight.values())
    assert drawn.mean() == pytest.approx(sum(t * w for t, w in weight.items()) / total, rel=0.03)


def test_a_dish_of_300_customers_is_drawn_and_one_of_many_more_is_seated():
    tables = pitman_yor.draw_tables(np.array([0, 1, 300, 1024, 50_000]), np.full(5, 10.0), np.full(5, 0.01), 0.7, np.random.default_rng(5))
    assert tables[:2].tolist() == [0, 1]
    assert 1 <= tables[2] < 30 and 1 <= tables[3] <= tables[4] < 2000


def test_pitman_yor_contexts_do_not_share_a_restaurant(spark):
    """After each of 9,000 words always the same one comes: with restaurants of their own all of it is foreseen."""
    follow = [f"a{i} b{i}" for i in range(9000)]
    texts = [" ".join(random.Random(k).sample(follow, len(follow))) for k in range(6)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    out = {r["doc_id"]: r for r in pitman_yor.score_texts(docs, F.col("doc_id") == 5).collect()}
    # Half of the tokens are "b" words, near probability 1; the others follow any word, near the unigram.
    assert out[5]["score"] / out[5]["base_score"] < 0.56


def test_pitman_yor_batches_come_back_whole(spark):
    texts = ["A b a", "", "b  c" * 3, "x"]
    rows = pa.record_batch([pa.array(texts), pa.array([3, 1, 2, 9]), pa.array([False, True, False, False])], names=["text", "id", "held"])
    from unittest import mock

    with mock.patch("pyspark.TaskContext.get", return_value=mock.Mock(partitionId=lambda: 2)):
        (out,) = pitman_yor._batches(iter([rows]))
    one = pitman_yor.Batch(out.column("data")[0].as_py())
    assert (out.column("batch")[0].as_py(), one.lengths.tolist(), one.ids.tolist(), one.held.tolist()) == (2 << 33, [4, 1, 5, 2], [3, 1, 2, 9], [0, 1, 0, 0])
    before, word, back = one.pairs()
    assert (before[back] == one.before).all() and (word[back] == one.tokens).all()
    order, lot = pitman_yor._lots(one, before, word, one.words[:1], 5)
    assert sorted(order.tolist()) == list(range(len(word))) and (np.diff(lot) >= 0).all() and lot.max() < 10
    for x in (np.array([], np.int64), np.array([5, 0, 2**40]), np.array([2**63 + 5], np.uint64), np.array([-(2**63), 7])):
        assert pitman_yor.unpack(pitman_yor.pack(x), signed=x.dtype != np.uint64).tolist() == x.tolist()


def test_pitman_yor_of_nothing(spark):
    assert pitman_yor.score_texts(documents(spark, []).where("doc_id = 1"), F.lit(False)).count() == 0
    alone = pitman_yor.score_texts(documents(spark, ["a b", None]).where("doc_id is not null"), F.lit(True)).collect()
    assert {(r["doc_id"], r["n_tokens"], r["n_known"], r["train_tokens"], r["score"]) for r in alone} == {(0, 3, 0, 0, 0.0), (1, 1, 0, 0, 0.0)}


def test_warc_round_trip(spark, tmp_path):
    html = ["<p>one</p>", "<p>two é</p>" * 50, "<p>one</p>", None, "", "x" * 200_000, "<p>one</p>"]
    rows = [(i, f"http://a.example/{i} b\r\nX: y", h, "c") for i, h in enumerate(html)] + [(6, None, "<p>one</p>", None), (None, "u", "<p>null id</p>", None)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, sha string")
    manifest = warc.write_archives(pages, f"file://{tmp_path}/w")
    out = warc.read_archives(manifest).collect()
    digest = lambda h: base64.b32encode(hashlib.sha1((h or "").encode()).digest()).decode()
    assert sorted((r["page_id"] if r["page_id"] is not None else -1, r["payload_digest"]) for r in out) == sorted((-1 if i is None else i, digest(h)) for i, _, h, _ in rows)
    kinds = {(r["page_id"], r["record_type"], r["refers_to"]) for r in out}
    assert {(0, "revisit", 6), (2, "revisit", 6), (6, "response", None), (6, "revisit", 6), (3, "revisit", 4), (4, "response", None)} <= kinds
    assert {r["payload"].decode() for r in out if r["page_id"] == 5} == {"x" * 200_000}


def test_shards_are_even_and_slots_gapless(spark):
    rng = random.Random(4)
    texts = ["w " * rng.randint(0, 300) + str(i) for i in range(600)] + ["copy of a text"] * 200 + [None, ""]
    out = kd_sharding.kd_shards(documents(spark, texts), 7).collect()
    total = collections.Counter()
    slots = collections.defaultdict(list)
    for r in out:
        total[r["shard"]] += r["size"]
        slots[r["shard"]].append(r["slot"])
        if r["doc_id"] is not None:
            assert r["size"] == len((texts[r["doc_id"]] or "").encode()) + 16
    assert sorted(total) == list(range(7)) and max(total.values()) - min(total.values()) <= 2 * max(r["size"] for r in out)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values()) and len(out) == len(texts) + 1


def test_shards_of_nothing(spark):
    assert kd_sharding.kd_shards(documents(spark, []).where("doc_id = 1"), 5).count() == 0


def test_nearest_neighbours(spark):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(900, 24)).astype(np.float32)
    x[300:500] = x[0]
    rows = [(i, [float(v) for v in r], "e") for i, r in enumerate(x)] + [(1000, None, ""), (1001, [0.0] * 24, ""), (1002, [float("nan")] * 24, ""), (1003, [1.0], ""), (1004, [None] * 24, ""), (7, [float(v) for v in x[7]], "")]
    vectors = spark.createDataFrame(rows, "vec_id long, embedding array<float>, t string")
    out = collections.defaultdict(list)
    for r in cross_polytope.nearest(vectors, vectors.where("vec_id % 100 = 0")).collect():
        out[r["query_id"]].append((r["rank"], r["vec_id"], r["score"]))
    hits = 0
    for q in range(0, 900, 100):
        d = np.sqrt(((x.astype(float) - x[q].astype(float)) ** 2).sum(axis=1))
        d[q] = np.inf
        best = np.lexsort((np.arange(900), d))[:10]
        got = sorted(out[q])
        assert [r for r, _, _ in got] == list(range(1, 11)) and all(s == pytest.approx(d[v], abs=1e-12) for _, v, s in got)
        hits += len({v for _, v, _ in got} & set(best.tolist()))
    assert hits >= 81 and [v for _, v, _ in sorted(out[300])] == [0, *range(301, 310)]


def test_hadamard_is_orthogonal():
    r = cross_polytope.rotate(np.eye(5), 1)
    assert np.allclose(r @ r.T, np.eye(5))


def test_few_vectors_are_all_found(spark):
    vectors = spark.createDataFrame([(i, [float(i), 1.0]) for i in range(4)], "vec_id long, embedding array<double>")
    assert cross_polytope.nearest(vectors, vectors.where("vec_id = 0"), probes=1).count() == 3


def test_line_dedup(spark):
    texts = [f"text number {i} with a body of its own\nshare this page\n{'tail ' * 5}{i}" for i in range(12)]
    texts += [None, "", "share this page", "share this page\nshare this page\nand a much longer line of its own to keep\n\n", "only here\nonly here"]
    docs = documents(spark, texts, [f"s{i % 12}" for i in range(len(texts))])
    out = {r["doc_id"]: r for r in line_dedup.dedup_lines(docs, sites=10).collect()}
    assert all("share" not in out[i]["text"] and out[i]["n_removed"] == 1 and out[i]["n_lines"] == 3 for i in range(12))
    assert out[12]["text"] is None and out[13]["text"] == "" and out[14]["text"] == "share this page"
    assert out[15]["text"] == "and a much longer line of its own to keep\n\n" and out[16]["n_removed"] == 0
    assert len(out) == len(texts) + 1


def test_line_stage_takes_long_boilerplate_out_of_short_pages(spark):
    import corpus_pipeline

    head = "a header that is much longer than the page under it " * 3
    texts = [f"{head}\nown line {i}" for i in range(12)] + [head, f"{head}\n \n{head}", f"{head}\nthe last"]
    rows = [(i, t, "en", f"s{i % 12}", len(t)) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    out = {r["doc_id"]: (r["text"], r["n_chars"]) for r in corpus_pipeline.line_stage(spark, docs, "").collect()}
    assert [out[i] for i in range(12)] == [(f"own line {i}", len(f"own line {i}")) for i in range(12)]
    assert [out[i][0] for i in (12, 13, 14)] == [texts[12], texts[13], "the last"]


def test_mixing_reaches_the_weights(spark):
    docs = spark.range(6000).select(F.col("id").alias("doc_id"), F.lit("t").alias("text"), F.when(F.col("id") % 3 < 2, "big").when(F.col("id") % 300 == 2, None).otherwise("small").alias("source"))
    out = mixing.mix_sources(docs, weights={"big": 1.0, "small": 3.0}, rows=4000)
    n = {r["source"]: r["count"] for r in out.groupBy("source").count().collect()}
    assert abs(n["big"] - 1000) < 150 and abs(n["small"] - 3000) < 250 and None not in n
    again = mixing.mix_sources(docs.repartition(7), weights={"big": 1.0, "small": 3.0}, rows=4000)
    assert out.select("doc_id", "copy", "mix_key").exceptAll(again.select("doc_id", "copy", "mix_key")).isEmpty()
    keys = [r["mix_key"] for r in out.collect()]
    assert keys == sorted(keys) and mixing.mix_sources(docs.where("false")).count() == 0


def encoding():
    tiktoken, tokenizers = pytest.importorskip("tiktoken"), pytest.importorskip("public_tokenizers")
    with open(bpe.default_vocabulary(), "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("own", pat_str=tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def test_bpe_equals_the_library_on_random_texts():
    known, encode = encoding(), bpe.Encoder(bpe.load_vocabulary(bpe.default_vocabulary()))
    rng = random.Random(1)
    alphabet = "ab s'tremvldLL  \n\t 　 '!.,12٣Éñ你😀-"
    texts = [None, "", "'s", "it's we'll 'S 're", "  x", "   ", "aaaa" * 500, "----" * 300] + ["".join(rng.choice(alphabet) for _ in range(rng.randint(0, 60))) for _ in range(3000)]
    for first, last, data, offs in W.pieces(pa.array(texts, pa.string()), 4096):
        ids, starts, cuts = encode(data, offs)
        for i in range(first, last):
            own = slice(cuts[i - first], cuts[i - first + 1])
            assert ids[own].tolist() == known.encode_ordinary(texts[i] or "")
            assert starts[own].tolist() == np.cumsum([0, *(len(known.decode_single_token_bytes(t)) for t in ids[own])])[:-1].tolist()


def test_bpe_round_trip(spark):
    texts = [None, "", "Hello  world's\n\n", "é" * 3000]
    path = bpe.default_vocabulary()
    out = {r["doc_id"]: r for r in bpe.bpe_decode(bpe.bpe_encode(documents(spark, texts), path), path).collect()}
    assert all(bytes(out[i]["decoded"]).decode() == (t or "") for i, t in enumerate(texts))
    assert out[0]["n_tokens"] == 0 and len(out) == 5


def test_pipeline_stages(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(8)
    texts = [" ".join(f"w{rng.randint(0, 500)}" for _ in range(80)) for _ in range(40)]
    texts += [texts[0], texts[1] + " more", None, "", "short"]
    rows = [(i, t, "en", f"s{i % 4}", len(t or "")) for i, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(i, 1, 0) for i in range(10)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:3]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == corpus_pipeline.COLUMNS
    assert {r["doc_id"] for r in docs.collect()} == set(range(40))
    assert set(corpus_pipeline.run(spark, str(tmp_path)).columns) == {"doc_id", "n_tokens", "ids_sha256", "decoded_sha256"}


def test_near_duplicate_stage_tells_rows_apart_by_id_and_text(spark):
    import corpus_pipeline

    rng = random.Random(9)
    a, b, c, d = (" ".join(f"w{rng.randint(0, 5000)}" for _ in range(60)) for _ in range(4))
    rows = [(0, a), (1, a + " more"), (1, b), (2, c), (2, d), (2, d), (None, c), (None, b + " more"), (None, a[::-1]), (None, a[::-1]), (3, ""), (3, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", len(t)) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    out = collections.Counter((r["doc_id"], r["text"]) for r in corpus_pipeline.near_duplicate_stage(spark, docs, "").collect())
    assert out == collections.Counter([(0, a), (1, b), (2, c), (2, d), (None, a[::-1]), (3, ""), (3, "")])
