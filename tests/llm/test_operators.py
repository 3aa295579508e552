"""The ten operators on small fixtures, against brute force, round trips and held-out rows."""

import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tillcast.llm import (op1_quality_rules, op2_sharding, op3_quality_classifier, op4_url_filters, op5_packing, op6_toxicity,
                          op7_ngram_jaccard, op8_html_text, op9_mixing, op10_embedding_dedup)
from tillcast.llm.common import components, in_blocks, local_components, number_within, word_hashes
from tillcast.llm.tokens import byte_bpe, load_byte_bpe

WORD = re.compile(r"[^\x20\x09-\x0D]+")
#: Columns that an operator might use itself.
CLASH = "id long, g long, n int, size int, k1 long, node string, _g int, _n int, _ratio double, _text string, _meta int, _row int, _a int, row_hash int, block int, shard int, mark int, v int, host string, text_ string"
SCHEMA = f"doc_id long, text string, lang string, source string, n_chars long, {CLASH}"
EXTRA = (1, 2, 3, 4, 5, "x", 6, 7, 0.5, "y", 8, 9, 10, 11, 12, 13, 14, 15, "h", "z")


def prose(rng, n, vocabulary=400):
    words = ["".join(rng.choice("abcdefghij") for _ in range(rng.randint(2, 8))) for _ in range(vocabulary)]
    return [rng.choice(words) for _ in range(n)]


def corpus():
    """(doc_id, text, lang, source): nulls, empty and long texts, copies, near copies, junk and toxic texts."""
    rng = random.Random(3)
    rows = [(1, None, "en", "a"), (2, "", None, "b"), (3, "  \n\t ", "en", None), (4, "one two", "de", "a"), (5, "one  two", "de", "b"),
            (6, "\u00a0nbsp \x1cfs \x85nel é\n漢字 😀", "fr", "c"), (7, " ".join(prose(rng, 30000)), "en", "a"), (8, "x" * 200000, "en", "c")]
    same = " ".join(prose(rng, 120))
    rows += [(i, same, "en", "a") for i in range(10, 18)] + [(17, same, "en", "a")]
    base = prose(rng, 200)
    for i in range(20, 40):
        near = list(base)
        near[rng.randrange(200)] = f"changed{i}"
        rows.append((i, " ".join(near), "en", "a"))
    for i in range(50, 170):
        words = prose(rng, rng.randint(25, 90))
        kind = i % 6
        if kind == 0:
            text = "\n".join(" ".join(w.upper() + "!!" for w in words[k:k + 8]) for k in range(0, len(words), 8))
        elif kind == 1:
            words[5:5] = ["scoundrel"]
            words[15:15] = ["scoundrel"]
            text = " ".join(words) + "."
        else:
            text = "\n".join(" ".join(words[k:k + 12]).capitalize() + "." for k in range(0, len(words), 12))
        rows.append((i, text, "en" if i % 3 else "fr", "abc"[i % 3] if i % 2 else "a"))
    return rows


ROWS = corpus()


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame([(i, t, lang, s, len(t or ""), *EXTRA) for i, t, lang, s in ROWS], SCHEMA).repartition(5).cache()


@pytest.fixture(scope="module")
def labels(spark):
    rows = [(i, 0 if i % 6 == 0 else 1, 1 if i % 6 == 1 else 0) for i in range(50, 170)] + [(50, None, None), (51, 1, 1), (9999, 1, 0), (None, 1, 1)]
    return spark.createDataFrame(rows, "doc_id long, quality int, toxic int")


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words_of(text):
    return WORD.findall(text or "")


# ---- helpers
def test_word_hashes_tell_words_apart_and_know_their_documents():
    texts = ["a b  a", "", "b\u00a0c a", "\n", "zz"]
    raw = [t.encode() for t in texts]
    hashes, doc, _, _ = word_hashes(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([len(r) for r in raw]))
    expected = [(d, w) for d, t in enumerate(texts) for w in words_of(t)]
    assert doc.tolist() == [d for d, _ in expected]
    assert len(set(hashes.tolist())) == len({w for _, w in expected})
    assert all((hashes[i] == hashes[j]) == (expected[i][1] == expected[j][1]) for i in range(len(expected)) for j in range(len(expected)))


def test_components_match_union_find(spark):
    rng = random.Random(1)
    edges = [(rng.randrange(300), rng.randrange(300)) for _ in range(170)] + [(400 + i, 401 + i) for i in range(40)] + [(7, 7)]
    root = {i: i for e in edges for i in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        root[b] = a
    got = {r.id: r.component for r in components(spark.createDataFrame(edges, "a long, b long"), "t").collect()}
    alone = {7} - {i for e in edges if e[0] != e[1] for i in e}
    assert got == {i: find(i) for i in root if i not in alone}
    assert components(spark.createDataFrame([], "a long, b long"), "t").count() == 0
    a, b = np.array(edges).T
    lab = local_components(500, a, b)
    assert all(lab[i] == find(i) for i in root)


def test_every_pair_of_a_key_meets_in_one_block(spark):
    df = spark.createDataFrame([(k, i) for k, n in ((1, 1), (2, 5), (3, 57)) for i in range(n)], "k int, id long")
    rows = in_blocks(df, "k", F.col("id"), 10).collect()
    groups = defaultdict(list)
    for r in rows:
        groups[r["_g"]].append(r)
    met = Counter()
    for g in groups.values():
        for x in g:
            for y in g:
                if x.id < y.id and (x["_i"] == x["_j"] or x["_c"] != y["_c"]):
                    met[x.k, x.id, y.id] += 1
    assert met == Counter({(k, i, j): 1 for k, n in ((2, 5), (3, 57)) for i in range(n) for j in range(i + 1, n)})


def test_numbers_are_gapless_within_each_key(spark):
    df = spark.createDataFrame([(k, i % 9) for k, n in (("a", 100), ("b", 3)) for i in range(n)], "k string, i int")
    out = number_within(df, ["k"], ["i"], "number", 103, rows_per_block=10).collect()
    for k, n in (("a", 100), ("b", 3)):
        assert sorted(r.number for r in out if r.k == k) == list(range(n))


# ---- 1
def test_counts_of_quality_rules_match_brute_force(docs):
    got = sorted((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in op1_quality_rules.judge(docs, None).collect())
    expected = []
    for i, text, _, _ in ROWS:
        words, seen, copies, covered = words_of(text), set(), 0, set()
        for line in (text or "").split("\n"):
            if WORD.search(line):
                copies += line in seen
                seen.add(line)
        windows = Counter(tuple(words[k:k + 8]) for k in range(len(words) - 7))
        for k in range(len(words) - 7):
            if windows[tuple(words[k:k + 8])] > 1:
                covered.update(range(k, k + 8))
        expected.append((i, len(words), sum(map(len, words)), sum((text or "").count(c) for c in "#*$%&|<>"), copies, len(covered),
                         len(words) < 20 or 100 * len(covered) > 30 * len(words)))
    assert got == sorted(expected)


def test_viterbi_is_the_best_of_all_labellings():
    rng = np.random.default_rng(0)
    model = {"mean": np.zeros(3), "scale": np.ones(3), "weights": rng.normal(size=3), "move": rng.normal(size=(2, 2)), "start": rng.normal(size=2)}
    n = np.array([1, 6, 3, 8])
    x = rng.normal(size=(n.sum(), 3))
    got, at = op1_quality_rules.viterbi(model, x, n), 0
    for k in n:
        emit, best = x[at:at + k] @ model["weights"], None
        for code in range(1 << k):
            y = [code >> j & 1 for j in range(k)]
            s = model["start"][y[0]] + sum(e for e, l in zip(emit, y) if l) + sum(model["move"][a, b] for a, b in zip(y, y[1:]))
            best = max(best or (-1e9,), (s, y))
        assert got[at:at + k].astype(int).tolist() == best[1]
        at += k


def test_quality_rules_learn_lines(docs, labels, empty):
    model = op1_quality_rules.train(docs, labels)
    got = {r.doc_id: r for r in op1_quality_rules.judge(docs, model, with_lines=True).collect()}
    assert all(not got[i].kept for i in range(54, 170, 6)) and all(got[i].kept for i in range(52, 170, 6))
    assert len(got[52].content) == dict((i, t) for i, t, _, _ in ROWS)[52].count("\n") + 1
    assert op1_quality_rules.judge(empty, model).count() == 0
    assert op1_quality_rules.train(empty, labels) is None and op1_quality_rules.train(docs, labels.limit(0)) is None


# ---- 2
def test_shards_are_whole_balanced_and_gapless(docs, empty):
    got = op2_sharding.assign(docs, 4).collect()
    sizes = sorted((i, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for i, t, _, _ in ROWS)
    assert sorted((r.doc_id, r["size"], r.text_crc32) for r in got) == sizes
    slots = defaultdict(list)
    for r in got:
        slots[r.shard].append(r.slot)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    text = dict((i, t) for i, t, _, _ in ROWS)
    shard_of = defaultdict(set)
    for r in got:
        shard_of[text[r.doc_id] or ""].add(r.shard)
    assert all(len(s) == 1 for t, s in shard_of.items() if len(t) < 20000)
    assert op2_sharding.assign(empty).count() == 0


def test_a_group_no_shard_can_hold_is_split(spark):
    rows = [(i, "hot text") for i in range(600)] + [(1000 + i, f"text {i} here") for i in range(300)]
    got = op2_sharding.assign(spark.createDataFrame(rows, "doc_id long, text string"), 4).toPandas()
    size = got.groupby("shard")["size"].sum()
    assert len(got) == 900 and size.max() - size.min() < 0.15 * size.mean()


def test_place_takes_the_highest_dot_product():
    room = [[0.5, 0.5], [0.5, 0.5]]
    assert op2_sharding.place([(0.4, 0.1), (0.4, 0.1), (0.1, 0.4), (0.1, 0.4)], room) == [0, 1, 0, 1]


# ---- 3
def test_co_training_separates_good_from_bad(spark, docs, labels, empty):
    marks = labels.select(F.col("doc_id").alias("id"), F.col("quality").alias("mark"))
    got = {r.doc_id: r for r in op3_quality_classifier.classify(docs, marks).collect()}
    assert len(got) == len({i for i, *_ in ROWS}) and all(0 <= r.score <= 1 for r in got.values())
    right = [got[i].kept == (i % 6 != 0) for i in range(52, 170)]
    assert sum(right) >= 0.95 * len(right)
    assert {r.kept for r in op3_quality_classifier.classify(docs, marks.limit(0)).collect()} == {True}
    assert op3_quality_classifier.classify(empty, marks).count() == 0
    seen, model = op3_quality_classifier.learn(docs, marks)
    left = op3_quality_classifier.good(docs, model)
    assert left.columns == docs.columns and Counter(r.doc_id for r in left.collect()) == Counter(i for i, *_ in ROWS if got[i].kept)
    assert seen.count() == len(ROWS)


def test_each_source_and_language_has_its_own_weight(spark):
    rng = random.Random(8)
    rows, marks = [], []
    for i in range(6000):
        k = i % 301
        source, good = (None, 0) if k == 300 else (f"site{k}", 1 - k % 2)
        rows.append((i, " ".join(prose(rng, 12)), rng.choice(["en", "fr", None]), source, 60))
        marks.append((i, good))
    rows += [(9000, "a few words", "en", "never seen", 60), (9001, "a few words", "zz", "", 60)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").repartition(3)
    labels = spark.createDataFrame(marks[:5400], "id long, mark int")
    got = {r.doc_id: r.metadata_score for r in op3_quality_classifier.classify(docs, labels, rounds=1).collect()}
    assert len(got) == len(rows)
    assert all((got[i] > 0.5) == (good == 1) for i, good in marks[5400:])
    assert max(got[i] for i, good in marks[5400:] if not good) < got[9000] < min(got[i] for i, good in marks[5400:] if good)


def test_sparse_logistic_is_the_dense_one():
    rng = np.random.default_rng(1)
    on = np.column_stack([rng.integers(0, 5, 400), rng.integers(5, 40, 400), rng.integers(40, 64, 400)])
    dense = np.zeros((400, 64))
    np.put_along_axis(dense, on, 1.0, axis=1)
    y = (rng.random(400) < on[:, 1] / 40).astype(int)
    assert np.allclose(op3_quality_classifier.indicator_logistic(on, 64, y), op6_toxicity.logistic(dense, y, np.ones(400)), atol=1e-5)


# ---- 4
def test_url_filter_rules_and_parts(spark):
    urls = {1: "HTTPS://WWW.Example.COM/de/1?x#y", 2: "http://a.example.net/en/5", 3: "http://example.net/en", 4: None, 5: "no url", 6: "http://x.org/fr/", 7: "http://xorg/fr/",
            8: "http://a.b?q://c/d", 9: "http://bad.example.com/en/9", 10: "http://good.example.com/en/9", 11: "", 12: "a\nb://H\nX/p\nq"}
    pages = spark.createDataFrame([(k, u, 1) for k, u in urls.items()], "page_id long, url string, host int")
    outcomes = spark.createDataFrame([("bad.example.com", 1)] * 60 + [("good.example.com", 0)] * 60 + [("x.org", None)], "host string, bad int")
    got = {r.page_id: r for r in op4_url_filters.judge(pages, outcomes).collect()}
    parts = {k: (r.host, r.path, r.rule, r.verdict) for k, r in got.items()}
    assert parts[1] == ("www.example.com", "/de/1", "example.com/de/", "block")
    assert parts[2] == ("a.example.net", "/en/5", "example.net/en/", "allow")
    assert parts[3] == ("example.net", "/en", "net/", "block")
    assert parts[4][:3] == parts[5][:3] == parts[11][:3] == ("", "", None)
    assert parts[6] == ("x.org", "/fr/", "org/fr/", "allow") and parts[7][2] is None
    assert parts[8][:2] == ("a.b", "") and parts[12][:2] == ("h\nx", "/p\nq")
    assert parts[9][2:] == (None, "block") and parts[10][2:] == (None, "allow")
    assert got[9].rate > 0.9 > 0.1 > got[10].rate
    none = {r.page_id: r.verdict for r in op4_url_filters.judge(pages, outcomes.limit(0)).collect()}
    assert none[9] == "allow" and len(none) == len(urls)


# ---- 5
def test_packing_is_a_round_trip_of_the_public_tokenizer(docs, empty):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    tokenizer.encode_special_tokens = True
    got = op5_packing.pack(docs).toPandas()
    expected = Counter()
    for i, text, _, _ in ROWS:
        ids = np.array(tokenizer.encode(text or "", add_special_tokens=False).ids + [0], "<u4")
        first = len(ids) % 2048 or 2048
        at = 0
        for piece, length in enumerate([first] + [2048] * ((len(ids) - first) // 2048)):
            expected[i, piece, at, length, zlib.crc32(ids[at:at + length].tobytes())] += 1
            at += length
    assert Counter(zip(got.doc_id, got.piece, got.start, got.length, got.ids_crc32)) == expected
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s.offset.tolist() == [0, *s.length.cumsum()[:-1]] and s.length.sum() <= 2048
    assert op5_packing.pack(empty).count() == 0


def test_tokens_of_awkward_texts_are_those_of_the_file():
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(5)
    texts = ["<|endoftext|> x", " \n\n  a", "it's we'll I'M", "\t\t", "é\u0301 漢字 😀👍🏽", "\x00\x7f", "1234567 12.5e3", "a" * 5000, "\u2028 \u3000x", "  trailing  "]
    texts += ["".join(rng.choice(" abé漢😀'1.\n\t-") for _ in range(60)) for _ in range(300)]
    for special in (True, False):
        tokenizer.encode_special_tokens = not special
        encode = byte_bpe(load_byte_bpe(None), special)
        for text in texts:
            assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids, text


def test_very_long_runs_of_blanks_are_tokenised_too(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    texts = [" " * 2_000_000, "\n" * 2_000_000, "a" + " \n\t" * 700_000 + "<|endoftext|> end", "short"]
    encode = byte_bpe(load_byte_bpe(None), True)
    for text in texts:
        assert encode(text) == tokenizer.encode(text, add_special_tokens=False).ids
    got = op5_packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).groupBy("doc_id").agg(F.sum("length").alias("n")).collect()
    assert {r.doc_id: r.n for r in got} == {i: len(tokenizer.encode(t, add_special_tokens=False).ids) + 1 for i, t in enumerate(texts)}


def test_added_tokens_in_a_text_are_one_id(spark):
    public_tokenizers = pytest.importorskip("public_tokenizers")
    from tokenizers import Tokenizer
    tokenizer = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    rng = random.Random(6)
    texts = ["end <|endoftext|> x", "<|endoftext|>", "<|endoftext|><|endoftext|>\n\n a", "<|endoftext |> <|ENDOFTEXT|>", "it<|endoftext|>'s  <|endoftext|", "  <|endoftext|>  ", "no marker"]
    texts += ["".join(rng.choice(["<|endoftext|>", "<|", "|>", "endoftext", *" abé漢😀'1.\n\t"]) for _ in range(40)) for _ in range(200)]
    assert tokenizer.encode(texts[0], add_special_tokens=False).ids == [437, 220, 50256, 2124]
    got = {r.doc_id: r for r in op5_packing.pack(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).collect()}
    for i, text in enumerate(texts):
        ids = np.array([*tokenizer.encode(text, add_special_tokens=False).ids, 0], "<u4")
        assert (got[i].length, got[i].ids_crc32) == (len(ids), zlib.crc32(ids.tobytes())), text


def test_fullest_is_the_best_subset_sum():
    rng = random.Random(2)
    for _ in range(200):
        counts = {rng.randint(1, 30): rng.randint(1, 4) for _ in range(rng.randint(1, 6))}
        room = rng.randint(0, 60)
        items = [x for x, n in counts.items() for _ in range(n)]
        sums = {0}
        for x in items:
            sums |= {s + x for s in sums if s + x <= room}
        taken = op5_packing.fullest(counts, sorted(counts, reverse=True), room)
        assert sum(x * n for x, n in taken.items()) == max(sums) and all(n <= counts[x] for x, n in taken.items())


def test_slack_packing_uses_all_counts_once():
    rng = random.Random(4)
    counts = Counter(rng.randint(1, 100) for _ in range(5000))
    combos = op5_packing.minimum_bin_slack(dict(counts), 100)
    used = Counter()
    for times, taken in combos:
        assert sum(x * n for x, n in taken.items()) <= 100
        for x, n in taken.items():
            used[x] += n * times
    assert used == counts
    bins = []  # first fit decreasing
    for x in sorted(counts.elements(), reverse=True):
        k = next((k for k, room in enumerate(bins) if room >= x), None)
        if k is None:
            bins.append(100 - x)
        else:
            bins[k] -= x
    assert sum(t for t, _ in combos) <= len(bins)


# ---- 6
def test_toxicity_on_held_out_rows(spark, empty):
    rng = random.Random(9)
    rows, marks = [(100000, None), (100001, ""), (100002, "!!")], []
    for i in range(1200):
        words = prose(rng, 40)
        toxic = i % 5 == 0
        if toxic:
            for bad in ("scoundrel", "vermin"):
                words[rng.randrange(40)] = bad
        rows.append((i, " ".join(words)))
        marks.append((i, int(toxic)))
    docs = spark.createDataFrame([(i, t, 1.5, "z", 3) for i, t in rows], "doc_id long, text string, _ratio double, ratio string, n int").repartition(4)
    labels = spark.createDataFrame([*marks, (0, 0), (None, 1)], "doc_id long, toxic int")
    model = op6_toxicity.learn(docs, labels)
    got = {r.doc_id: r for r in op6_toxicity.score(docs, model).collect()}
    held = [i for i in range(1200) if zlib.crc32(str(i).encode()) % 3 == 1]
    assert {r.doc_id for r in docs.where(op6_toxicity.held_out(F.col("doc_id"))).collect()} == {*held} | {i for i in range(100000, 100003) if zlib.crc32(str(i).encode()) % 3 == 1}
    assert np.mean([got[i].predicted == (i % 5 == 0) for i in held]) > 0.97
    assert all(0 <= r.score <= 1 for r in got.values()) and got[100000].score == got[100001].score == got[100002].score
    left = op6_toxicity.clean(docs, model)
    assert left.columns == docs.columns and {r.doc_id for r in left.collect()} == {i for i, r in got.items() if not r.predicted}
    assert op6_toxicity.score(empty, model).count() == 0
    none = op6_toxicity.learn(docs, labels.limit(0))
    assert none is None and {r.score for r in op6_toxicity.score(docs, none).collect()} == {0.0} and op6_toxicity.clean(docs, None).count() == len(rows)


def test_shared_model_is_a_distribution(spark):
    grams = spark.createDataFrame([((ord(a) << 16 | ord(b) << 8 | ord(c)), 1) for a, b, c in ("abc", "bbc", "xbd", "abd", "zaa")], "gram long, n long")
    p = op6_toxicity.shared_model(spark, grams).groupBy(F.shiftright("gram", 8).alias("a")).agg(F.sum("p").alias("p")).collect()
    assert len(p) == 256 and all(abs(r.p - 1) < 1e-9 for r in p)


def test_unseen_sequences_back_off_whatever_they_share_a_bucket_with(spark):
    pack = lambda t: sum(b << (8 * i) for i, b in enumerate(reversed(t.encode())))
    seen = "vermi"
    abc = np.arange(97, 123)
    every = sum((abc << (8 * k)).reshape([-1 if i == k else 1 for i in range(5)]) for k in range(5)).ravel()
    other = next(int(g) for g in every if g != pack(seen) and g % 1048573 == pack(seen) % 1048573)
    stranger = other.to_bytes(5, "big").decode()
    ratios = spark.createDataFrame([(5, pack(seen), 3.0), (4, pack(stranger[1:]), 0.5), (15, pack(stranger[:4]), -0.25), (13, pack("v"), 0.125)], "kind int, gram long, value float")
    docs = spark.createDataFrame([(1, seen), (2, stranger), (3, None), (4, "!!"), (5, seen + " " + seen)], "_row long, text string")
    n = {1: 5, 2: 5, 3: 0, 4: 0, 5: 11}
    for tables in (spark.sparkContext.broadcast(op6_toxicity.sorted_tables(ratios)), ratios):
        got = {r._row: r for r in op6_toxicity.likelihood_ratio(docs, tables).collect()}
        assert {i: r._n for i, r in got.items()} == n
        assert abs(got[1]._ratio * 5 - 3.0) < 1e-6 and abs(got[2]._ratio * 5 - 0.25) < 1e-6 and abs(got[5]._ratio * 11 - 6.0) < 1e-6


def test_tallies_are_exact_and_bounded():
    rng = np.random.default_rng(3)
    runs = [np.sort(rng.integers(0, 300, rng.integers(0, 200))) for _ in range(60)]
    got, parts = Counter(), list(op6_toxicity.tallied(iter(runs), most=100))
    for keys, n in parts:
        assert len(keys) == len(set(keys.tolist())) <= 300
        got.update(dict(zip(keys.tolist(), n.tolist())))
    assert got == Counter(x for r in runs for x in r.tolist()) and len(parts) > 1


def test_toxicity_by_joins_is_that_by_broadcast(spark):
    rng = random.Random(4)
    rows = [(i, " ".join(["".join(rng.choice("abcdefghijklmnop") for _ in range(6)) for _ in range(30)] + (["scoundrel"] * 2 if i % 4 == 0 else []))) for i in range(400)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    labels = spark.createDataFrame([(i, int(i % 4 == 0)) for i, _ in rows], "doc_id long, toxic int")
    sent, joined = (op6_toxicity.learn(docs, labels, **options) for options in ({}, {"broadcast": 0}))
    a, b = ({r.doc_id: r.score for r in op6_toxicity.score(docs, model).collect()} for model in (sent, joined))
    assert a.keys() == b.keys() and all(abs(a[i] - b[i]) < 1e-6 for i in a)


# ---- 7
def jaccard_classes(rows, threshold=0.8):
    grams = {}
    for _, text in rows:
        w = words_of(text)
        grams[text or ""] = {tuple(w[k:k + 5]) for k in range(max(len(w) - 4, 1))} if w else set()
    texts, n = list(grams), Counter(t or "" for _, t in rows)
    link, root = defaultdict(set), {t: t for t in texts}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x
    for k, a in enumerate(texts):
        for b in texts[k + 1:]:
            both = len(grams[a] & grams[b])
            if both and both >= threshold * len(grams[a] | grams[b]) - 1e-12:
                link[a].add(b)
                link[b].add(a)
                root[find(b)] = find(a)
    first = defaultdict(lambda: 1 << 60)
    for i, t in rows:
        first[find(t or "")] = min(first[find(t or "")], i)
    return sorted((i, first[find(t or "")], n[t or ""] - 1 + sum(n[x] for x in link[t or ""])) for i, t in rows)


def test_chosen_paths_find_all_links(docs, empty):
    rows = [(i, t) for i, t, _, _ in ROWS]
    expected = jaccard_classes(rows)
    for options in ({}, {"leaf": 4, "block": 8}):  # the second splits buckets and blocks
        got = sorted((r.doc_id, r.class_id, r.n_links) for r in op7_ngram_jaccard.classes(docs, **options).collect())
        assert got == expected
    left = op7_ngram_jaccard.deduplicate(docs)
    assert left.columns == docs.columns and sorted(r.doc_id for r in left.collect()) == sorted({c for _, c, _ in expected})
    assert op7_ngram_jaccard.classes(empty).count() == 0 and op7_ngram_jaccard.deduplicate(empty).count() == 0


def test_signatures_estimate_similarity():
    rng = np.random.default_rng(0)
    common = rng.integers(0, 1 << 63, 800).astype(np.uint64)
    a, b = (np.concatenate([common, rng.integers(0, 1 << 63, 100).astype(np.uint64)]) for _ in range(2))
    sig = op7_ngram_jaccard.signatures(np.concatenate([a, b]), np.repeat([0, 1], 900), 2)
    assert abs((sig[0] == sig[1]).mean() - 0.8) < 0.12
    assert op7_ngram_jaccard.runs_needed(0.8, 0.9999, 5) == 13


# ---- 8
HTML = [
    ("", ""), ("plain  text", "plain text"), ("<p>a<p>b", "a\n\nb"), ("<ul><li>a<li>b<ol start=3><li>c<li>d</ol></ul>e", "- a\n- b\n  3. c\n  4. d\n\ne"),
    ("<table><tr><th>Name<th>N<tr><td>x<td>10<tr><td>longer<td>2</table>", "Name    N\nx       10\nlonger  2"),
    ("<table><tr><td rowspan=2>a<td>b<tr><td>c<tr><td colspan=2>wide one</table>", "a  b\n   c\nwide one"),
    ("<td>lonely<script>x</script><style>p{}</style><b>t</b><!-- c -->u", "lonelytu"),
    ("<style>.no, #gone{display:none} p.off{display:none}</style><p class='x no'>a<p id=gone>b<p class=off>c<div class=off>d</div><p hidden>e<p style='display: none'>f<p>g", "d\n\ng"),
    ("<div style='visibility:hidden'>a<b style='visibility:visible'>b</b></div>", "b"), ("<pre>\n a\n\n  b</pre>c", " a\n\n  b\n\nc".strip("\n")),
    ("<details><summary>s</summary>no</details><details open><summary>t</summary>yes</details><dialog>no</dialog>", "s\nt\nyes"),
    ("a<br>b<br><br>c&nbsp;&amp;&lt;d 5 < 6 <3", "a\nb\n\nc &<d 5 < 6 <3"), ("<head><title>no</title><p>yes", "yes"), ("<a title='>'>x</a></p>y", "x\n\ny"),
    ("<dl><dt>q<dd>a</dl><select><option>1<option>2</select>", "q\n  a\n\n1\n2"), ("<textarea><b>raw</b></textarea>", "<b>raw</b>"),
    ("<div>" * 5000 + "deep" + "</div>" * 5000, "deep"), ("<a " + "x=\"y\" " * 2000, None),
]


@pytest.mark.parametrize("page,text", HTML)
def test_rendering(page, text):
    got = op8_html_text.render(page)
    assert text is None or got == text


@pytest.mark.parametrize("page,text", [
    ('<p class=a">visible one</p><p>two</p><a href="x">three</a>', "visible one\n\ntwo\n\nthree"),
    ("<img alt=it's src=a> seen text <b>more</b> it's here <i>", "seen text more it's here"), ('<p "x>one</p><p title = "a>b">two</p>"', 'one\n\ntwo\n\n"'),
    ("<a href=x/>one</a> <i class='a'title=\"<b>\">two</i> <b title='open>three</b> four", "one two three four"), ("<p ==\"y>z\" hidden>a</p><p a = hidden>b<p/hidden>c", "b")])
def test_quotes_open_a_value_only_after_an_equals_sign(page, text):
    assert op8_html_text.render(page) == text


@pytest.mark.parametrize("page,text", [
    ("<style>@media print { .nav { display:none } } @media (max-width: 600px){.w{display:none}}</style><p class=nav>a<p class=w>b", "a\n\nb"),
    ("<style>@import 'x'; .a{display:none} @media screen{.b{display:none}} .c{display:none}</style><p class=a>a<p class=b>b<p class=c>c<p>d", "d"),
    ("<style>.a{display:none} @media only screen and (min-width:48em){.a{display:block} .b{display:none}}</style><p class=a>a<p class=b>b", "a"),
    ("<style>@media not print{.a{display:none}} @media print, screen{.b{display:none}} @supports (x:y){.c{display:none}}</style><p class=a>a<p class=b>b<p class=c>c", "c"),
    ("<style media=print>.a{display:none}</style><style>.z::after{content:'}'} .b{display:none}</style><p class=a>a<p class=b>b<p>c", "a\n\nc"),
    ("<style>@font-face{x:y} @keyframes k{from{display:none}} .a{color:red; .b{display:none}} .c{display:none</style><p class=a>a<p class=b>b<p class=c>c", "a\n\nb"),
    ("a <math><mi>x</mi><mo>=</mo><mfrac><mn>1</mn><mn>2</mn></mfrac><annotation>no</annotation></math> b", "a x=1 2 b"),
    ("a<svg><title>no</title><defs><text>no</text></defs>no<path d='m'/><g><text>Sales<tspan> up</tspan></text><text display=none>no</text></g><style/></svg>b<svg/>c", "a Sales up bc"),
    ("<svg><path><p>shown</p><svg><foreignObject><p>html</p></foreignObject></svg>end", "shown\n\nhtml\n\nend")])
def test_only_rules_for_a_screen_hide_and_formulas_and_labels_show(page, text):
    assert op8_html_text.render(page) == text


def test_all_visible_words_of_pages_come_out_in_order(spark):
    pages = spark.read.parquet("/root/testdata/sf0.001/pages.parquet")
    pages = pages.unionByName(spark.createDataFrame([(-1, "u", None), (-2, "u", "")], pages.schema)).withColumn("text", F.lit(1))
    html_of = {r.page_id: r.html for r in pages.collect()}
    out = {r.page_id: r.text for r in op8_html_text.extract(pages).collect()}
    assert out.pop(-1) is None and out.pop(-2) == "" and len(out) + 2 == len(html_of)
    import html
    for i, text in out.items():
        plain = re.sub(r"(?s)<head>.*?</head>|<script.*?</script>|<!--.*?-->|<[a-zA-Z/!][^>]*>", " ", html_of[i])
        assert re.sub(r"(?m)^\s*(- |\d+\. )|\s", "", text) == re.sub(r"\s", "", html.unescape(plain))


# ---- 9
def test_mix_meets_targets(spark, docs, empty):
    got = op9_mixing.plan(docs).toPandas()
    assert len(got) == len(ROWS) and (got.taken == got.copies * got["size"]).all() and got.copies.max() <= 2
    assert (got.shards.str.len() == got.copies).all()
    assert Counter(zip(got.doc_id, got["size"])) == Counter((i, len(words_of(t))) for i, t, _, _ in ROWS)
    assert got.sort_values(["doc_id", "row_hash", "taken"]).taken.tolist() == op9_mixing.plan(docs.repartition(3)).toPandas().sort_values(["doc_id", "row_hash", "taken"]).taken.tolist()
    size = defaultdict(int)
    for _, t, _, s in ROWS:
        size[s] += len(words_of(t))
    names = sorted(s for s in size if s is not None) + [None]
    weight = {s: (5, 2, 1)[k % 3] for k, s in enumerate(names)}
    total, stopped = 1.5 * sum(size.values()), set()
    while True:
        level = (total - sum(2 * size[s] for s in stopped)) / sum(weight[s] for s in names if s not in stopped)
        over = {s for s in names if s not in stopped and level * weight[s] > 2 * size[s]}
        if not over:
            break
        stopped |= over
    target = {s: 2 * size[s] if s in stopped else level * weight[s] for s in names}
    source = dict((i, s) for i, _, _, s in ROWS)
    for s in names:
        part = got[[source[i] == s for i in got.doc_id]]
        assert np.allclose(part.target, target[s]) and (part.source_size == size[s]).all()
    mixed = op9_mixing.mix(docs)
    assert mixed.columns == [*docs.columns, "_shard"] and Counter(r.doc_id for r in mixed.collect()) == Counter(got.loc[got.index.repeat(got.copies)].doc_id)
    assert op9_mixing.plan(empty).count() == 0 and op9_mixing.mix(empty).count() == 0


def test_taken_words_come_near_the_target(spark):
    rng = random.Random(6)
    rows = [(i, " ".join(["w"] * rng.randint(1, 60)), rng.choice("ppppqrs")) for i in range(4000)]
    got = op9_mixing.plan(spark.createDataFrame(rows, "doc_id long, text string, source string"), rows_per_block=100).toPandas()
    got["source"] = got.doc_id.map({i: s for i, _, s in rows})
    by = got.groupby("source").agg(target=("target", "first"), taken=("taken", "sum"))
    assert (abs(by.taken - by.target) <= 10).all()


def test_tree_keeps_quotas(spark):
    blocks = spark.range(103).select((F.col("id") % 4).alias("sid"), F.col("id").alias("block"), F.lit(0).alias("pass"))
    per = Counter(r.shard for r in op9_mixing.split_tree(blocks, 8, 1).collect())
    assert sum(per.values()) == 103 and set(per) == set(range(8)) and max(per.values()) - min(per.values()) <= 2


# ---- 10
def test_embedding_links_match_brute_force(spark):
    rng = np.random.default_rng(0)
    vectors = {}
    for k in range(60):
        centre = rng.normal(size=24)
        for j in range(rng.integers(1, 9)):
            vectors[100 * k + j] = (centre + rng.normal(size=24) * rng.choice([0.02, 0.15, 0.3])).tolist()
    vectors |= {9001: vectors[0], 9002: [3 * x for x in vectors[0]]}
    odd = {9100: None, 9101: [0.0] * 24, 9102: [None] + [1.0] * 23, 9103: [float("nan")] + [1.0] * 23, 9104: [float("inf")] + [1.0] * 23, 9105: [1.0], 9106: []}
    rows = [(i, v, 1, 2) for i, v in [*vectors.items(), (0, vectors[0]), *odd.items()]]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, id int, codes int").repartition(5)
    ids = [i for i, *_ in rows if i in vectors]
    x = np.array([vectors[i] for i in ids])
    x /= np.linalg.norm(x, axis=1)[:, None]
    near = (x @ x.T >= 0.9) & ~np.eye(len(x), dtype=bool)
    lab = local_components(len(x), *np.nonzero(near))
    least = {k: min(i for i, m in zip(ids, lab) if m == k) for k in set(lab)}
    expected = sorted([(i, int(n), least[k]) for i, n, k in zip(ids, near.sum(1), lab)] + [(i, 0, i) for i in odd])
    for options in ({}, {"leaf": 3, "block": 5}):
        got = op10_embedding_dedup.near_duplicates(df, **options).collect()
        assert sorted((r.vec_id, r.n_links, r.component_id) for r in got) == expected
        assert all(r.kept == (r.vec_id == r.component_id) for r in got)
    assert op10_embedding_dedup.near_duplicates(df.limit(0)).count() == 0
    assert {r.kept for r in op10_embedding_dedup.near_duplicates(df.where("vec_id = 9100")).collect()} == {True}


@pytest.mark.parametrize(("common", "options"), [(0.0, {}), (0.5, {"block": 64}), (0.5, {}), (0.7, {"block": 64})])
def test_embedding_links_are_found_beside_a_common_part(spark, common, options):
    rng = np.random.default_rng(3)

    def unit(x):
        return x / np.linalg.norm(x, axis=-1, keepdims=True)
    own = unit(np.pad(rng.normal(size=(1200, 32)), ((0, 0), (1, 0))))
    x = np.sqrt(common) * np.eye(33)[0] + np.sqrt(1 - common) * own
    turn = np.pad(rng.normal(size=(300, 32)), ((0, 0), (1, 0)))
    turn = unit(turn - (turn * own[:300]).sum(1, keepdims=True) * own[:300])
    near = (0.91 - common) / (1 - common)  # of the own parts
    y = np.sqrt(common) * np.eye(33)[0] + np.sqrt(1 - common) * (near * own[:300] + np.sqrt(1 - near ** 2) * turn)
    assert np.allclose((x[:300] * y).sum(1), 0.91)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(np.vstack([x, y]))], "vec_id long, embedding array<double>")
    got = {r.vec_id: r.component_id for r in op10_embedding_dedup.near_duplicates(df, **options).collect()}
    assert np.mean([got[i] == got[1200 + i] for i in range(300)]) >= 0.98


def test_rotations_balance_bits():
    x = np.random.default_rng(1).normal(size=(2000, 16)) + 3
    mean, projections = op10_embedding_dedup.learn_rotations(x, 2, 16)
    for p in projections:
        assert np.allclose(p.T @ p, np.eye(16), atol=1e-8)
        assert (abs(((x - mean) @ p >= 0).mean(0) - 0.5) < 0.06).all()


def test_isotonic_fit_rises_and_pools():
    z, y = np.arange(8.0), np.array([0, 0, 1, 0, 1, 1, 0, 1])
    points = op6_toxicity.isotonic(z, y, np.ones(8))
    p = [b for _, b in points]
    assert p == sorted(p) and all(0 < x < 1 for x in p) and len(points) < 8
    assert [a for a, _ in points] == sorted(a for a, _ in points)
