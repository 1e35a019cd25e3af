"""Ranked search, alignment and fingerprints against brute force, and their edges."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.llm import alignment, ranked, simhash

SMALL = "/root/testdata/sf0.001"
ODD = [None, "", " ", "\n\t ", "one", "two  words", " three little words ", "a b c", "A B C", "a b c d", "▁", "x ▁ y", "don't stop", "<|endoftext|> <s> </s> <unk>", "é è ñ 日本語 😀 ​", "tab\there\x1c \x1d\x85 end", "x" * 5000, "a b " * 4000, "a\n b", "  lead", "trail  ", "\x00\x01 z"]
BIG = 1 << 60


def rows_of(df, *keys):
    return sorted((tuple(r[k] for k in keys) for r in df.collect()), key=lambda r: tuple((x is None, x) for x in r))


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(BIG + i, t, "clash", i) for i, t in enumerate(ODD)] + [(BIG + 3, "repeated id", "x", 0), (BIG + 3, "repeated id", "x", 0), (None, "a b c", "x", 1), (None, None, None, None)]
    return spark.createDataFrame(rows, "doc_id long, text string, term string, n long")


# ranked search


def best_by_force(docs, items, k=20):
    words = lambda t: ["".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in w) for w in re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", t or "")]
    counted = [(i, Counter(words(t))) for i, t in docs]
    counted = [(i, c, sum(c.values())) for i, c in counted if c]
    n_docs, total = len(counted), sum(n for *_, n in counted)
    df = Counter(t for _, c, _ in counted for t in c)
    out = []
    for item, text in items:
        scores = []
        for i, c, n in counted:
            m = 100 - 25 + (25 * n * n_docs) // total
            s = sum(q * math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1_000_000_000 * c[t]) // (1000 * c[t] + 12 * m)) for t, q in Counter(words(text)).items() if t in c)
            if s > 0 and i is not None:
                scores.append((-s, i))
        out += [(item, r, i, -s) for r, (s, i) in enumerate(sorted(scores)[:k], 1)]
    return sorted(out)


@pytest.mark.parametrize("broadcast", [True, False])
def test_ranks_are_those_of_all_scores(spark, monkeypatch, broadcast):
    docs, items = (spark.read.parquet(f"{SMALL}/{t}.parquet") for t in ("documents", "benchmark"))
    if not broadcast:
        monkeypatch.setattr(ranked, "BROADCAST", 0)
    got = ranked.ranked(docs, items, vocabulary=ranked.VOCABULARY if broadcast else 0)
    want = best_by_force([(r["doc_id"], r["text"]) for r in docs.collect()], [(r["item_id"], r["text"]) for r in items.collect()])
    assert rows_of(got, "item_id", "rank", "doc_id", "score") == want
    assert [t for _, t in got.drop("item_id").dtypes] == ["int", "bigint", "bigint"]


def test_ties_repeats_and_copies_in_ranks(spark):
    rng = random.Random(3)
    vocabulary = [f"w{i}" for i in range(30)] + ["ñu", "ÑU", "日本"]
    docs = [(i, " ".join(rng.choices(vocabulary, weights=range(33, 0, -1), k=rng.choice([1, 3, 30])))) for i in range(300)]
    docs += [(1000 + i, docs[5][1]) for i in range(60)] + [(BIG + i, "w1 w2, W1-w2!") for i in range(40)] + [(None, "w1 w1"), (5000, None), (5001, "?!")]
    items = [(1, "w1 w2 w2 w29 nowhere"), (2, docs[5][1]), (3, "nowhere at all"), (4, None), (5, ""), (6, "ñu ÑU 日本"), (7, " ".join(vocabulary))]
    d, q = spark.createDataFrame(docs, "doc_id long, text string").repartition(5), spark.createDataFrame(items, "item_id long, text string")
    for k in (1, 3, 20, 1000):
        assert rows_of(ranked.ranked(d, q, k), "item_id", "rank", "doc_id", "score") == best_by_force(docs, items, k)


def test_odd_rows_in_ranks(spark, odd):
    items = spark.createDataFrame([(1, "a b c repeated one"), (None, "words"), (1, "a b c repeated one")], "item_id long, text string")
    got = rows_of(ranked.ranked(odd, items), "item_id", "rank", "doc_id", "score")
    docs = [(r["doc_id"], r["text"]) for r in odd.collect()]
    once = best_by_force(docs, [(1, "a b c repeated one")])
    assert [r for r in got if r[0] == 1] == sorted([*once, *once]) and [(r[2], r[1]) for r in got if r[0] is None] == [(i, r) for _, r, i, _ in best_by_force(docs, [(0, "words")])]
    assert ranked.ranked(odd.limit(0), items).count() == 0 == ranked.ranked(odd, items.limit(0)).count()


# alignment


def aligned_by_force(texts):
    """As the libraries encode, with a loop over pairs of tokens."""
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = alignment.default_paths()
    a_tok, b_tok, byte_of = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path), alignment.byte_characters()
    a_tok.encode_special_tokens = True
    piece = {i: p for p, i in a_tok.get_vocab().items()}
    of_a = lambda i: bytes(byte_of[c] for c in piece[i])
    of_b = lambda i: bytes([int(b_tok.id_to_piece(i)[3:-1], 16)]) if b_tok.is_byte(i) else b_tok.id_to_piece(i).replace("▁", " ").encode()
    each, counts = [], Counter()
    for t in texts:
        whole = (" " + (t or "")).encode()
        a, b = (a_tok.encode(" " + t, add_special_tokens=False).ids, b_tok.encode(t)) if t else ([], [])
        spans = []
        for ids, of in ((a, of_a), (b, of_b)):
            at, got = 0, []
            for i in ids:
                got.append((at, at + len(of(i)), i))
                at += len(of(i))
            spans.append(got)
        if not t or b"".join(map(of_a, a)) != whole or b"".join(map(of_b, b)) != whole:
            each.append(([], [], [], []))
            continue
        cuts = sorted({e for _, e, _ in spans[0]} & {e for _, e, _ in spans[1]})
        groups = ["|".join(",".join(str(i) for s, e, i in side if lo < e <= hi) for side in spans) for lo, hi in zip([0, *cuts], cuts, strict=False)]
        links, first = [], 0
        for s, e, i in spans[0]:
            while spans[1][first][1] <= s:
                first += 1
            for s2, e2, i2 in spans[1][first:]:
                if s2 >= e:
                    break
                links.append((i, i2))
        counts.update(links)
        each.append((a, b, groups, links))
    high = defaultdict(int)
    for (_, j), n in counts.items():
        high[j] = max(high[j], n)
    sha = lambda g: hashlib.sha256(";".join(g).encode()).hexdigest() if g else ""
    return [(len(a), len(b), len(g), len(x), sum(counts[p] == high[p[1]] for p in x), sum(counts[p] for p in x), sha(g)) for a, b, g, x in each]


ALIGNED = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


@pytest.mark.parametrize("frequent", [alignment.FREQUENT, 40])
def test_alignment_is_that_of_the_libraries(spark, frequent):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = docs.select("doc_id", "text").collect()
    want = [(r["doc_id"], *x) for r, x in zip(rows, aligned_by_force([r["text"] for r in rows]), strict=True)]
    assert rows_of(alignment.aligned(docs, frequent=frequent), "doc_id", *ALIGNED) == sorted(want)


def test_odd_texts_are_aligned(spark, odd):
    rows = [(r["doc_id"], r["text"]) for r in odd.collect()]
    want = [(i, *x) for (i, _), x in zip(rows, aligned_by_force([t for _, t in rows]), strict=True)]
    got = rows_of(alignment.aligned(odd), "doc_id", *ALIGNED)
    assert got == sorted(want, key=lambda r: tuple((x is None, x) for x in r))
    assert [r[1:] for r in got if r[0] == BIG + ODD.index("x ▁ y")] == [(0, 0, 0, 0, 0, 0, "")]
    assert alignment.aligned(odd.limit(0)).count() == 0


def test_words_are_cut_where_neither_tokenizer_makes_a_token(spark):
    al = alignment.Aligner(*alignment.default_paths())
    assert al.by_words
    rng = random.Random(5)
    marks = ["a", "ab", "The", "'s", "don't", " ", "  ", "\n", "\t", "\x1c", "\x85", "　", "1", "12", "!", "…", "é", "日", "😀", "▁", "​", "<s>"]
    texts = ["".join(rng.choices(marks, k=rng.randint(1, 25))) for _ in range(2000)]
    whole = aligned_by_force(texts)
    for t, w in zip(texts, whole, strict=True):
        words, of = al.texts([t])
        parts = [of[x] for x in words[0]]
        got = tuple(sum(x[i] for x in parts) for i in range(3))
        assert got == w[:3] and (";".join(x.groups for x in parts) == "" if not parts else hashlib.sha256(";".join(x.groups for x in parts).encode()).hexdigest() == w[6]), repr(t)


def test_a_group_by_hand():
    """Ends of A at 2, 4, 6, 9 and of B at 3, 6, 9: bytes 0-6 are one group, 6-9 another."""
    got = alignment.align([[0, 0, 0, 1]], [[1, 1, 1]], np.array([2, 3]), np.array([0, 3]))[0]
    assert (got.n_a, got.n_b, got.n_groups, got.groups) == (4, 3, 2, "0,0,0|1,1;1|1")
    assert np.frombuffer(got.links, np.int64).tolist() == [1, 1, 1, 1, (1 << 32) + 1]


# fingerprints


def components_by_force(prints):
    """Least id reachable, by (id, fingerprint) rows and all pairs of fingerprints."""
    up = {}

    def root(x):
        while up.setdefault(x, x) != x:
            x = up[x]
        return x

    def tie(a, b):
        a, b = root(a), root(b)
        up[max(a, b)] = min(a, b)

    of = defaultdict(list)
    for i, f in prints:
        of[f].append(i)
    for ids in of.values():
        for i in ids:
            tie(ids[0], i)
    keys = list(of)
    v = np.array(keys, np.uint64)
    for k, f in enumerate(keys):
        for j in np.flatnonzero(np.bitwise_count(v[k + 1 :] ^ np.uint64(f)) <= 2):
            tie(of[f][0], of[keys[k + 1 + j]][0])
    return {i: root(i) for i, _ in prints}


def by_sparks_hash(docs):
    """Fingerprints by DataFrame functions; Spark's xxhash64 has seed 42."""
    words = F.expr("filter(split(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\\\x20\\\\x09-\\\\x0D]+'), x -> x != '')")
    rows = docs.select("doc_id", F.monotonically_increasing_id().alias("r"), words.alias("w")).select("doc_id", "r", F.expr("if(size(w) = 0, array(), transform(sequence(0, greatest(size(w) - 3, 0)), i -> array_join(slice(w, i + 1, 3), ' ')))").cast("array<string>").alias("s"))
    h = rows.select("doc_id", "r", F.explode_outer("s").alias("s")).withColumn("h", F.xxhash64("s"))
    bits = [F.sum(F.when(F.col("s").isNotNull(), F.shiftrightunsigned("h", i).bitwiseAND(1))).alias(f"b{i}") for i in range(64)]
    g = h.groupBy("doc_id", "r").agg(F.count("s").alias("n"), *bits)
    return [(r["doc_id"], sum(1 << i for i in range(64) if r["n"] and 2 * r[f"b{i}"] > r["n"])) for r in g.collect()]


def test_fingerprints_and_components(spark, odd):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").union(odd.where("doc_id is not null").select("doc_id", "text"))
    prints = by_sparks_hash(docs)
    got = simhash.classes(docs)
    assert rows_of(got, "doc_id", "fingerprint") == sorted((i, f"{f:016x}") for i, f in prints)
    assert {r["doc_id"]: r["component_id"] for r in got.collect()} == components_by_force(prints)


def test_long_texts_are_hashed_in_slices(monkeypatch):
    text = " ".join(str(random.Random(1).random()) for _ in range(200)) + " ".join(map(str, range(300)))
    whole = simhash.fingerprint(text)
    for size in (1, 2, 7, 64):
        monkeypatch.setattr(simhash, "SLICE", size)
        assert simhash.fingerprint(text) == whole
    assert simhash.fingerprint("Two Words") == __import__("xxhash").xxh64_intdigest(b"two words", 42) and simhash.fingerprint(" \n") == 0 == simhash.fingerprint(None)


def planted():
    """Far fingerprints, chains of near ones, a crowd that shares 44 bits, and pairs at 2 and 3 bits in every runs' choice."""
    rng = random.Random(11)
    flip = lambda f, n: f ^ sum(1 << b for b in rng.sample(range(64), n))
    out = [rng.getrandbits(64) for _ in range(2000)]
    out += [flip(f, rng.choice([1, 2, 2, 3, 3])) for f in out[:1000]]
    for _ in range(5):
        chain = [rng.getrandbits(64)]
        for _ in range(20):
            chain.append(flip(chain[-1], 2))
        out += chain
    base = rng.getrandbits(64)
    out += [base ^ rng.getrandbits(20) for _ in range(3000)]
    out += [base ^ rng.getrandbits(20) << 40 for _ in range(1500)]
    out += [0, 1, 1 << 63, (1 << 64) - 1, (1 << 64) - 2]
    return out


@pytest.mark.parametrize("crowd", [simhash.CROWD, 50, 1])
def test_links_join_what_all_pairs_join(spark, crowd):
    prints = [(7 * k % 100_003, f) for k, f in enumerate(dict.fromkeys(planted()))]
    equal = spark.createDataFrame([(i, f - (1 << 64) if f >> 63 else f) for i, f in prints], "rep long, fp long").repartition(6)
    edges = simhash.links(simhash.places(equal, crowd)).collect()
    value = dict(prints)
    assert all((value[r["a"]] ^ value[r["b"]]).bit_count() > 0 for r in edges)
    up = {i: i for i in value}

    def root(x):
        while up[x] != x:
            x = up[x]
        return x

    for r in edges:
        a, b = root(r["a"]), root(r["b"])
        up[max(a, b)] = min(a, b)
    assert {i: root(i) for i in value} == components_by_force(prints)


def test_places_across_batches(monkeypatch, spark):
    monkeypatch.setattr(simhash, "PLANES", 3)
    rng = np.random.default_rng(2)
    place, free = np.sort(rng.integers(0, 9, 700)), rng.integers(0, 1 << 10, 700)
    got = {(int(a), int(b)) for i, j in simhash.near(place, free) for a, b in zip(i, j, strict=True)}
    assert got == {(i, j) for i in range(700) for j in range(i + 1, 700) if place[i] == place[j] and int(free[i] ^ free[j]).bit_count() <= 2}


def test_odd_rows_in_components(spark, odd):
    got = simhash.classes(odd)
    none = [r for r in got.collect() if r["doc_id"] is None]
    assert len(none) == 2 and all(r["component_id"] is None for r in none) and {r["fingerprint"] == "0" * 16 for r in none} == {True, False}
    blank = {r["component_id"] for r in got.collect() if r["fingerprint"] == "0" * 16 and r["doc_id"] is not None}
    repeated = {r["component_id"] for r in got.collect() if r["doc_id"] == BIG + 3}
    assert blank == repeated == {BIG}
    assert simhash.classes(odd.limit(0)).count() == 0
