"""The ten operators on small hand-made tables, against brute force where SQL can't say the rows."""

import math
import random
import re
from collections import Counter

import numpy as np
import pytest
import xxhash

from millrace.llm import extraction, fingerprints, licenses, mixing, neardup, neighbours, pieces, quality, toxicity, warc

DOCS = "doc_id long, text string, lang string, source string, n_chars long, score string, label string"
SF = "/root/testdata/sf0.001"


def docs(spark, texts, sources=None):
    rows = [(i, t, "en", (sources or {}).get(i, "a"), len(t or ""), "clash", "clash") for i, t in enumerate(texts)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def odd(spark):
    rng = random.Random(3)
    base = [" ".join(rng.choice("abcdefghij") + str(rng.randrange(60)) for _ in range(80)) for _ in range(6)]
    near = [" ".join(w if rng.random() > 0.02 else "x" for w in b.split()) for b in base for _ in range(3)]
    return [None, "", " \t\n", "one", "One", "two words", "two  WORDS", *base, *near, base[0], base[0], "long " * 30000]


def test_warc_round_trip(spark, tmp_path):
    big, other = "é" * 600, "y" * 2000
    rows = [(1, "u", big), (2, "u", big), (3, "v", None), (4, "v", "small"), (5, "v", "small"), (6, "w", other), (6, "w", other), (None, "n", other)]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    manifest = warc.write(pages, f"file://{tmp_path}/w", roll_bytes=200)
    files = manifest.orderBy("file").collect()
    assert len(files) > 1 and sum(m["records"] for m in files) == 8
    got = warc.read(spark, f"file://{tmp_path}/w", manifest).collect()
    kinds = Counter((r["page_id"], r["record_type"], r["refers_to"], r["payload_bytes"]) for r in got)
    assert kinds == Counter({(1, "revisit", 2, 1200): 1, (2, "response", None, 1200): 1, (3, "response", None, 0): 1, (4, "response", None, 5): 1, (5, "response", None, 5): 1, (6, "response", None, 2000): 1, (6, "revisit", 6, 2000): 1, (None, "revisit", 6, 2000): 1})
    again = warc.write(pages.repartition(3), f"file://{tmp_path}/w2", roll_bytes=200)
    assert [tuple(m) for m in again.orderBy("file").collect()] == [tuple(m) for m in files]
    assert warc.read(spark, f"file://{tmp_path}/e", warc.write(pages.limit(0), f"file://{tmp_path}/e")).count() == 0


def test_warc_is_deterministic_beyond_a_sample(spark, tmp_path):
    pages = spark.range(0, 60_000).selectExpr("if(id % 50 = 0, null, id * id) as page_id", "concat('u', id) as url", "repeat(cast(id % 977 as string), 20 + cast(id % 300 as int)) as html", "'x' as digest")
    found = []
    for n, k in ((1, 3), (2, 11)):
        manifest = warc.write(pages.repartition(k), f"file://{tmp_path}/{n}", roll_bytes=100_000, shard_bytes=1 << 20)
        found.append([tuple(m) for m in manifest.orderBy("file").collect()])
    assert found[0] == found[1] and sum(m[4] for m in found[0]) == 60_000 and len({m[1] for m in found[0]}) > 10


def test_quality_learns_and_takes_odd_texts(odd):
    rng = random.Random(5)
    good = [" ".join(rng.choice(["the", "tree", "Stone", "river,", "walks."]) for _ in range(rng.randrange(20, 90))) for _ in range(120)]
    bad = [" ".join(rng.choice(["BUY!!", "$$$", "now###"]) for _ in range(rng.randrange(20, 90))) for _ in range(60)]
    x = np.array([quality.features(t) for t in good + bad])
    y = np.array([1.0] * 120 + [0.0] * 60)
    model = quality.train(x[::2], y[::2], rounds=60, pair_rounds=10)
    assert ((quality.predict(model, x[1::2]) > 0.5) == y[1::2]).all()
    assert np.isfinite(quality.predict(model, np.array([quality.features(t) for t in odd]))).all()
    assert len(quality.predict(quality.train(x[:0], y[:0]), x)) == len(x)


def test_toxicity_finds_the_sentence(spark):
    rng = random.Random(7)
    plain = lambda: " ".join(rng.choice("tree stone river walks under green".split()) for _ in range(8))
    clean = [". ".join(plain() for _ in range(6)) for _ in range(150)]
    toxic = [". ".join([plain(), "you are a vile creep", plain()]) for _ in range(40)]
    model = toxicity.train(clean + toxic, np.array([0.0] * 150 + [1.0] * 40))
    frame = docs(spark, [None, "", clean[0] * 50, toxic[0], toxic[0]])
    got = {r["doc_id"]: r["s"] for r in toxicity.with_score(frame, model, "s").collect()}
    assert got[0] == got[1] == 0 and got[2] < 0.3 < got[3] == got[4]
    found = toxicity.offending_sentences(frame.where("doc_id = 3"), model).collect()
    assert [r["sentence"] for r in found] == ["you are a vile creep"]
    assert toxicity.train([], np.zeros(0))["weights"] == {}


def test_pieces_equal_the_library(odd):
    e = pieces.Encoder(pieces.default_model())
    rng = random.Random(9)
    alphabet = [" ", "  ", "▁", "\n", "\r", "\t", "ing", "the", "é", "日", "😀", "<0x41>", "</s>", "}\r", "==", "\x00", "Ａ", "a", "aa", "    ", "____"]
    fuzz = ["".join(rng.choice(alphabet) if rng.random() < 0.6 else chr(rng.randrange(32, 1500)) for _ in range(rng.randrange(40))) for _ in range(2000)]
    for t in [*odd, *fuzz, " " * 999, "a" * 999, "abcde0123" * 2000, "日本😀" * 2000]:
        want = e.model.encode(t or "", add_bos=True, add_eos=True)
        got = e.encode(t)
        assert np.frombuffer(got, "<u4").tolist() == want, repr(t)[:80]
        assert e.decode(got) == e.model.decode(want)


def test_pieces_on_spark(spark, odd):
    frame = docs(spark, odd).withColumnRenamed("score", "ids")
    out = {r["doc_id"]: r for r in pieces.stage(spark, frame, SF).collect()}
    e = pieces.encoder(pieces.default_model())
    assert len(out) == len(odd) and out[0]["n_tokens"] == out[1]["n_tokens"] == 2
    for i, t in enumerate(odd):
        assert out[i]["ids"] == "clash" and np.frombuffer(out[i]["_ids"], "<u4").tolist() == e.model.encode(t or "", add_bos=True, add_eos=True)
    assert pieces.stage(spark, frame.limit(0), SF).count() == 0


def test_fingerprints(spark, odd):
    odd = [*odd, *(" ".join(f"f{i}x{j}" for j in range(40)) for i in range(90))]
    frame = docs(spark, odd).select("doc_id", "text")
    got = {r["doc_id"]: r for r in fingerprints.fingerprints(frame).collect()}
    texts = [t or "" for t in odd]
    for i, t in enumerate(texts):
        following = texts[i - 1] if i else texts[-1]
        k = len(t) // 3
        assert got[i]["edited"] == t[: len(t) - k] + following[:k] and got[i]["n_chars"] == len(t)
    copies = [i for i, t in enumerate(texts) if t == texts[7]]
    assert len(copies) >= 3 and len({bytes(got[i]["fingerprint"]) for i in copies}) == 1
    assert np.mean([got[i]["near_edited"] for i in range(7, 13)]) > np.mean([got[i]["near_next"] for i in range(8, 13)]) + 0.1
    assert fingerprints.fingerprints(frame.limit(0)).count() == 0
    one = fingerprints.fingerprints(frame.where("doc_id = 3")).collect()
    assert len(one) == 1 and one[0]["near_next"] == 1.0
    # by the definition: band, subsets and sorted terms, written out for one text
    counts = Counter(w for t in texts for w in set(re.findall(r"[^\W_]+", t.lower())))
    band = {w for w, n in counts.items() if n * 2000 >= len(texts) and (n * 12 <= len(texts) or n == 1)}
    mine = sorted(fingerprints._term(w) for w in set(texts[8].split()) & band)
    want = [[b"" for _ in range(fingerprints.EACH)] for _ in fingerprints.RATES]
    for level, rate in enumerate(fingerprints.RATES):
        for first in range(0, fingerprints.EACH, 1 << rate):
            for h in mine:
                cell = (int(fingerprints._mix(np.array([(h + (1 + (rate << 8 | first)) * 0x9E3779B97F4A7C15) % 2**64], np.uint64))[0]) >> (64 - rate)) + first
                if cell < fingerprints.EACH:
                    want[level][cell] += h.to_bytes(8, "little")
    hashes = [xxhash.xxh64_intdigest(b, r) | 1 if b else 0 for r, row in zip(fingerprints.RATES, want, strict=True) for b in row]
    assert np.frombuffer(bytes(got[8]["fingerprint"]), np.uint64).tolist() == hashes and any(hashes)
    odd_ids = spark.createDataFrame([(None, "a b"), (None, "c d"), (5, "e f g h i j"), (5, "k l m n o p"), (5, "k l m n o p")], "doc_id long, text string")
    assert fingerprints.fingerprints(odd_ids).count() == 5


def test_extraction():
    model = extraction.model()
    exact = 0
    held_out = extraction.labelled_pages(40, seed=99)
    for page, content in held_out:
        exact += set(extraction._made(extraction.extract(page, model))) == set(extraction._made(page)) & content
    assert exact >= 0.9 * len(held_out)
    page = "<html><body><nav><ul><li><a href=/>Home</a></li></ul></nav><article><h1>A &amp; B</h1><p>First\n  text here, it goes on.<p>Second <b>bold</b> text.</article><footer>&copy; x</footer><script>var a='<p>no</p>'</script></body>"
    assert extraction.extract(page, model) == "A & B First text here, it goes on. Second bold text."
    assert extraction.extract(None, model) == extraction.extract("", model) == ""
    extraction.extract("<div><p>" * 500 + "x" * 100_000, model)
    long = "One two three, four five six. Seven eight nine ten, and more words to read."
    inside = f"<body><article><header><h1>Title here</h1></header><p>{long}</p><p>{long}</p></article></body>"
    assert extraction.extract(inside, model) == f"Title here {long} {long}"
    talk = f"<body><article><h1>T</h1><p>{long}</p></article><section><ol class='feed'><li><p>Nice post!</p></li><li><p>I agree with all of it.</p></li></ol></section></body>"
    assert extraction.extract(talk, model) == f"T {long}"
    assert extraction.extract("<p>x<svg>" * 20_000, model).count("x") <= 20_000  # an end that is missing is looked for once


def test_extraction_on_spark(spark):
    page = "<body><nav><a href='/'>Home</a></nav><article><h1>A</h1><p>Some words of the article, with a full stop.</p></article></body>"
    rows = [(1, "u", None, "x"), (2, "u", "", "x"), (3, None, page, "x"), (3, None, page, "x"), (None, None, page, "x"), (4, "u", "<p>" + "long text. " * 50_000, "x")]
    frame = spark.createDataFrame(rows, "page_id long, url string, html string, n_chars string")
    got = extraction.with_text(frame)
    texts = sorted((r["page_id"] or 0, r["text"] or "") for r in got.collect())
    want = "A Some words of the article, with a full stop."
    assert texts[:5] == [(0, want), (1, ""), (2, ""), (3, want), (3, want)] and got.columns == [*frame.columns, "text"]
    assert extraction.with_text(frame.limit(0)).count() == 0


def test_stages_keep_columns_of_any_name(spark):
    rng = random.Random(12)
    plain = lambda: " ".join(rng.choice("tree stone river walks under green".split()) for _ in range(8))
    rows = [(i, ". ".join(plain() for _ in range(5)) + (" you are a vile creep" if i % 4 == 0 else "."), "en", "a", 1, "mine", "mine") for i in range(200)]
    rows += [(None, None, None, None, None, None, None), (7, "a b", "en", "a", 3, "mine", "mine"), (7, "a b", "en", "a", 3, "mine", "mine")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, _toxicity string, _quality string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), int(i % 4 == 0)) for i in range(200)] + [(None, 1, 1), (3, None, None)], "doc_id long, quality int, toxic int")
    scored = {r["doc_id"]: r["s"] for r in toxicity.with_score(frame, toxicity.fit(frame, labels), "s").collect()}
    assert min(scored[i] for i in range(0, 200, 4)) > 0.5 > max(scored[i] for i in range(1, 200, 4))
    for only in (0, 1):
        one = labels.where("doc_id is not null").selectExpr("doc_id", f"{only} as quality", f"{only} as toxic")
        assert {r["s"] > 0.3 for r in quality.with_score(frame, quality.fit(frame, one), "s").collect()} == {bool(only)}
    for fit, empty in ((toxicity.fit, labels.limit(0)), (quality.fit, labels.limit(0))):
        fit(frame, empty)
        fit(frame.limit(0), labels)


def test_neardup_stage_keeps_one_row(spark):
    text = " ".join(f"w{i}" for i in range(30))
    rows = [(5, text, "a"), (5, text, "b"), (9, text, "c"), (None, text, "d"), (None, text, "d"), (7, "other words here", "e"), (7, "and still others", "f"), (8, None, "g")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, kept string")
    got = Counter((r["doc_id"], r["text"]) for r in neardup.stage(spark, frame, "").collect())
    assert got == Counter({(5, text): 1, (None, text): 2, (7, "and still others"): 1, (8, None): 1})


def test_neardup_of_repeated_ids(spark):
    rng = random.Random(8)
    base = [" ".join(f"{k}x{rng.randrange(500)}" for _ in range(60)) for k in range(3)]
    rows = [(1, base[0]), (2, base[0] + " end"), (2, base[1]), (3, base[1] + " end"), (4, base[2]), (4, base[2]), (None, base[2])]
    got = sorted((r["doc_id"] or 0, r["component_id"] or 0) for r in neardup.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect())
    assert got == [(0, 0), (1, 1), (2, 1), (2, 1), (3, 1), (4, 4), (4, 4)]


def test_pipeline_on_a_table(spark):
    import corpus_pipeline

    frame = corpus_pipeline.run(spark, SF)
    docs_ = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    e = pieces.encoder(pieces.default_model())
    rows = frame.collect()
    assert 0 < len({r["doc_id"] for r in rows}) <= len(docs_)
    assert max(Counter(r["doc_id"] for r in rows).values()) <= 2
    for r in rows:
        assert np.frombuffer(r["ids"], "<u4").tolist() == e.model.encode(docs_[r["doc_id"]] or "", add_bos=True, add_eos=True)


def test_mixing_stage(spark):
    rows = [(i if i % 5 else None, "w " * (i % 7 + 1), "ab"[i % 2] if i % 9 else None, i) for i in range(200)] + [(None, None, None, None), (7, "", "a", 0)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string, copies long")
    got = mixing.stage(spark, frame, "")
    assert got.columns == frame.columns
    taken = {}
    for r in mixing.mix(frame).collect():
        words, size = taken.get(r["doc_id"], (0, 0))
        taken[r["doc_id"]] = words + r["taken"], size + r["size"]
    copies = {k: math.floor(w / n + 0.5) for k, (w, n) in taken.items() if n}
    want = Counter({r: c for r in rows if (c := copies.get(r[0], 0))})
    assert want[(None, "w w w w w w ", "b", 5)] > 0
    assert Counter(map(tuple, got.collect())) == want
    assert mixing.stage(spark, frame.limit(0), "").count() == 0


def test_mixing(spark):
    rng = random.Random(2)
    rows = [(i, " ".join(["w"] * rng.randrange(0, 60)), ["a", "b", "c", None, ""][rng.randrange(5)]) for i in range(400)] + [(7, "w w", "a"), (7, "w w", "a"), (900, None, "z"), (901, "solo", "y")]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string").withColumn("size", mixing.F.lit("clash"))
    got = mixing.mix(frame).collect()
    assert len(got) == len(rows)
    sizes = Counter()
    for _, t, s in rows:
        sizes[s] += len((t or "").split())
    order = sorted((s for s in sizes if s is not None)) + [None]
    weights = {s: (3, 1, 2)[i % 3] for i, s in enumerate(order)}
    target, open_ = {}, set(order)
    while True:
        left = 1.5 * sum(sizes.values()) - sum(2 * sizes[s] for s in order if s not in open_)
        line = left / sum(weights[s] for s in open_)
        over = {s for s in open_ if line * weights[s] > 2 * sizes[s]}
        if not over:
            break
        open_ -= over
    target = {s: line * weights[s] if s in open_ else 2.0 * sizes[s] for s in order}
    by_target = Counter()
    for r in got:
        assert 0 <= r["taken"] <= 2 * r["size"]
        by_target[round(r["target"], 6)] += r["taken"]
    want = Counter()
    for s in order:
        want[round(target[s], 6)] += target[s]
    assert by_target.keys() == want.keys()
    for k, v in want.items():
        assert abs(by_target[k] - v) <= max(3, 0.02 * v)
    assert sorted(map(tuple, got)) == sorted(map(tuple, mixing.mix(frame.repartition(3)).collect()))
    assert mixing.mix(frame.limit(0)).count() == 0


def test_mixing_stage_keeps_targets_of_long_documents(spark):
    # the sources' ratios of target to size are near 2, 0.83 and 1.67
    rows = [(i, " ".join(["w"] * (640 + i % 7)), "abc"[i % 3]) for i in range(900)]
    frame = spark.createDataFrame(rows, "doc_id long, text string, source string")
    got, target = Counter(), {}
    for r in mixing.stage(spark, frame, "").collect():
        got[r["source"]] += len(r["text"].split())
    source = {i: s for i, _, s in rows}
    for scattered in (False, True):
        taken = Counter()
        for r in mixing.mix(frame, scattered).collect():
            taken[source[r["doc_id"]]] += r["taken"]
            target[source[r["doc_id"]]] = r["target"]
        assert all(abs(taken[s] - target[s]) < 0.005 * target[s] for s in target)
    for s in "abc":
        assert abs(got[s] - target[s]) < 0.02 * target[s], (s, got[s], target[s])


def test_sainte_lague(spark):
    votes = {"a": 53, "b": 24, "c": 23, "d": 1, "e": 0}
    frame = spark.createDataFrame([(1, k, v, 17) for k, v in votes.items()], "g int, k string, v long, seats long")
    got = {r["k"]: r["quota"] for r in mixing.apportion(frame, ["g"], ["k"], "v", "seats").collect()}
    want = Counter(k for _, k in sorted(((-v / (2 * j + 1), k) for k, v in votes.items() if v for j in range(17)))[:17])
    assert got == {k: want[k] for k in votes}


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(600, 8)).astype(np.float32)
    x[100:160] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)] + [(1000, None), (1001, [0.0] * 8), (1002, [float("nan")] * 8), (1003, [None] * 8), (1004, [1.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>")
    got = {}
    for r in neighbours.search(frame).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append(r["vec_id"])
    y = x.astype(float)
    hits = 0
    for q in range(0, 600, 20):
        s = (y * y[q]).sum(1)
        s[q] = -np.inf
        hits += len(set(np.lexsort((np.arange(600), -s))[:20]) & set(got[q]))
        assert len(got[q]) == 20
    assert hits >= 0.9 * 600 and len(got) == 30
    few = neighbours.search(frame.where("vec_id < 5")).collect()
    assert sorted((r["query_id"], r["vec_id"]) for r in few) == [(0, i) for i in range(1, 5)]
    assert neighbours.search(frame.limit(0)).count() == 0


def test_licenses(spark):
    texts = [None, "", "CC BY cc by", "x\nLicensed under the Apache License, Version 2.0.\ny", "All rights\nreserved", "licensed under the apache licence version 2", "é general PUBLIC license é"]
    s = licenses.scanned(docs(spark, texts).drop("label")).collect()
    got = {r["doc_id"]: (len(r["words"]), sorted((p["start"], p["label"]) for p in r["places"]), sorted({b["template"] for b in r["blocks"]})) for r in s}
    assert got[0] == got[1] == (0, [], [])
    assert got[2] == (4, [(0, "cc-by"), (2, "cc-by")], [])
    assert got[3][2] == ["apache-2.0"] and got[4][1] == [(0, "reserved")] and got[4][2] == []
    assert got[5][2] == [] and got[6][1] == [(1, "gpl")]


def test_licenses_equal_brute_force(spark):
    table = [(r["doc_id"], r["text"] or "") for r in spark.read.parquet(f"{SF}/documents.parquet").collect()]
    word = re.compile(licenses.WORD)
    lower = {c: c + 32 for c in range(65, 91)}
    got = {r["doc_id"]: r for r in licenses.op8_licenses(spark, SF).collect()}
    longest = max(len(t.split()) for t in licenses.TEMPLATES.values())
    seen = Counter()
    for i, text in table:
        low = text.translate(lower)
        words = word.findall(low)
        places = sorted((at, label) for label, phrase in licenses.PHRASES.items() for at in range(len(words)) if words[at : at + len(phrase.split())] == phrase.split())
        labels, score, at = {label for _, label in places}, 0.0, 0
        for line in low.split("\n"):
            mine = word.findall(line)
            block = {*words[at : at + len(mine) + longest - 1]} if mine else set()
            at += len(mine)
            for label, template in licenses.TEMPLATES.items():
                t = set(template.split())
                share = len(t & (set(mine) if template in licenses.PHRASES.values() else block)) / len(t)
                if share >= licenses.CONTAINMENT:
                    labels.add(label)
                    score = max(score, share)
        r = got[i]
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"]) == (len(words), len(places), places[0][0] if places else None, places[-1][0] if places else None)
        assert r["base_labels"] == ",".join(sorted({label for _, label in places})) and r["labels"] == ",".join(sorted(labels))
        assert math.isclose(r["score"], 1.0 if places else score)
        seen.update(labels)
    assert len(got) == len(table) and len(seen) > 2


def test_licenses_odd_tables(spark):
    frame = docs(spark, ["x " * 200_000 + "all rights reserved", "all rights reserved", "all rights reserved"]).withColumnRenamed("score", "_low").withColumnRenamed("label", "extra")
    table = spark.createDataFrame([("ours", "Do What You Want Public Thing")], "label string, text string")
    got = licenses.scanned(frame, table).collect()
    assert [len(r["places"]) for r in got] == [1, 1, 1] and {r["_low"] for r in got} == {"clash"}
    assert licenses.scanned(frame.limit(0), table).count() == 0
    assert [b["template"] for b in licenses.scanned(docs(spark, ["you may do what\nyou want, public thing"]).drop("label"), table).first()["blocks"]] == ["ours"]


def test_licenses_wrapped(spark):
    bsd = "Redistribution and use in source and binary forms, with or without\n{}modification, are permitted provided that"
    texts = [bsd.format(""), bsd.format(" * ").replace("\n", "\r\n"), bsd.format("\n# \n# ")]
    texts += ["one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen; licensed\nunder the Apache\n\nLicense, Version 2.0\n"]
    texts += ["\n\nThis work is licensed under the GNU General\nPublic License, version 3", "redistribution and use in source\n" + "x " * 14 + "\nand binary forms with or without modification are permitted"]
    got = {r["doc_id"]: {(b["line"], b["template"]) for b in r["blocks"]} for r in licenses.scanned(docs(spark, texts)).collect()}
    assert [{t for _, t in got[i]} for i in range(6)] == [{"bsd"}, {"bsd"}, {"bsd"}, {"apache-2.0"}, {"gpl-3.0"}, set()]
    assert (0, "bsd") in got[0] and (2, "gpl-3.0") in got[4]


def test_neardup_equals_brute_force(spark, odd):
    lower = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})

    def shingles(t):
        w = re.findall(r"[^\x20\x09-\x0D]+", (t or "").translate(lower))
        return {tuple(w[i : i + 4]) for i in range(len(w) - 3)} if len(w) >= 4 else ({tuple(w)} if w else set())

    sets = [shingles(t) for t in odd]
    parent = list(range(len(odd)))
    for i in range(len(odd)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 80 * len(sets[i] | sets[j]):
                a, b = parent[i], parent[j]
                parent = [min(a, b) if p in (a, b) else p for p in parent]
    got = {r["doc_id"]: r for r in neardup.classes(docs(spark, odd)).collect()}
    assert [got[i]["component_id"] for i in range(len(odd))] == parent
    assert [got[i]["n_shingles"] for i in range(len(odd))] == [len(s) for s in sets]
    assert all(got[i]["kept"] == (i == parent[i]) for i in got)
    assert neardup.classes(docs(spark, odd).limit(0)).count() == 0


def test_sketch_agrees_with_similarity():
    rng = np.random.default_rng(1)
    h = rng.integers(0, 2**63, 1200).astype(np.uint64)
    a, b = np.unique(h[:1000]), np.unique(h[200:])
    assert abs((neardup.sketch(a, 2000) == neardup.sketch(b, 2000)).mean() - 800 / 1200) < 0.05
    assert (neardup.sketch(a[:1]) == neardup.sketch(a[:1])).all()


def test_sketch_of_few_shingles():
    rng = np.random.default_rng(6)
    unfilled, bits = np.iinfo(np.uint64).max, (2 * neardup.BINS).bit_length()
    for n in range(1, 13):
        for _ in range(20):
            k = neardup.sketch(np.unique(rng.integers(0, 2**63, n).astype(np.uint64)))
            assert (k != unfilled).all() and (k >> np.uint64(64 - bits)).max() < 2 * neardup.BINS
    for n in (5, 6):
        agree = []
        for _ in range(300):
            h = rng.integers(0, 2**63, n).astype(np.uint64)
            a, b = neardup.sketch(np.unique(h)), neardup.sketch(np.unique(h[1:]))
            agree.append((a.astype(np.uint8) == b.astype(np.uint8)).sum())
        assert abs(np.mean(agree) / neardup.BINS - (n - 1) / n) < 0.01 and min(agree) >= neardup.AGREE


def test_neardup_of_short_variants(spark):
    # a variant has one word more than its stem, so it is at 4/5 with the stem and at 4/6 with the other variants, and the stem comes last
    texts = [f"a{b} b{b} c{b} d{b} e{b} f{b} g{b}" + (f" x{i}" if i < 30 else "") for b in range(8) for i in range(31)]
    got = {r["doc_id"]: r["component_id"] for r in neardup.classes(docs(spark, texts)).collect()}
    assert got == {i: i // 31 * 31 for i in range(len(texts))}


def test_neardup_stage_takes_five_words(spark):
    # one word changed in the middle: of 44 words 37 of 45 shingles of four stay, 35 of 45 of five; of 60 words 51 of 61 of five
    texts = [" ".join(f"{n}w{i}" if i != 20 or not k else "changed" for i in range(n)) for n in (44, 60) for k in (0, 1)]
    frame = docs(spark, texts)
    assert {r["doc_id"] for r in neardup.stage(spark, frame, "").collect()} == {0, 1, 2}
    assert {r["doc_id"] for r in neardup.classes(frame).where("kept").collect()} == {0, 2}


def test_components_of_a_path(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(40)] + [(100, 99), (99, 98)], "a long, b long")
    got = {r["node"]: r["component"] for r in neardup.components(edges).collect()}
    assert all(got[i] == 0 for i in range(41)) and got[100] == got[99] == got[98] == 98
