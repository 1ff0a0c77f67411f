"""The ten operators on small fixtures with nulls, empty and repeated rows, and against brute force."""

import hashlib
import math
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from haploweave.llm import jaccard_join, knn_join, language_id, lm_score, mixing, order_minhash, packing, queries, quotation, sharding, toxicity
from haploweave.llm.textblock import Lookup

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, row string, size string"
EDGES = [(900, None, None, None, None, "x", "y"), (901, "", "en", "a", 0, None, None), (902, "...", "en", "a", 3, None, None), (None, "no id here", "en", None, 10, None, None), (903, "same row", "en", "b", 8, None, None), (903, "same row", "en", "b", 8, None, None), (904, "word " * 3000, "en", "b", 15000, None, None)]


@pytest.fixture(scope="module")
def docs(spark):
    r = random.Random(1)
    vocab = {"en": "the and of ing ther wh".split(), "de": "sch ung keit ein lich der".split()}
    rows = []
    for i in range(80):
        lang = ("en", "de")[i % 2]
        text = " ".join("".join(r.choice(vocab[lang]) for _ in range(r.randint(1, 3))) for _ in range(r.randint(3, 60)))
        rows.append((i, text, lang, f"s{i % 4}", len(text), None, None))
    return spark.createDataFrame(rows + EDGES, SCHEMA)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def test_language(spark, docs, empty):
    model = language_id.fit(docs)
    got = {r["doc_id"]: r for r in language_id.identify(docs, model).collect()}
    assert all(got[i]["lang_pred"] == ("en", "de")[i % 2] for i in range(80) if got[i]["held_out"])
    assert got[900]["lang_pred"] == got[901]["lang_pred"] == got[902]["lang_pred"] == "und" and got[900]["score"] == 0
    assert language_id.identify(docs, model).count() == 87 and language_id.identify(empty, language_id.fit(empty)).count() == 0
    for context in (b"the", b"zzq", b"\n\nt"):  # every context's probabilities sum to one
        code = (np.uint64(int.from_bytes(context, "big")) << np.uint64(8)) | np.arange(256, dtype=np.uint64)
        assert np.allclose(np.exp(model._value(code, 3)).sum(axis=0), 1, atol=1e-4)


def test_toxicity(spark, docs, empty):
    texts = [f"you are an idiot {i % 7}" for i in range(40)] + [f"have a nice day {i % 7}" for i in range(60)]
    model = toxicity.train(texts, [1] * 40 + [0] * 60)
    assert model.score("Such an IDIOT") > 0.7 > model.score("a nice neighbour") and model.score("") == model.score(None) < 0.7
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)] + [(5, None), (None, 1), (77777, 1), (904, 0)], "doc_id long, toxic int")
    model = toxicity.fit(docs, labels)
    rows = toxicity.classify(docs, model).collect()
    assert len(rows) == 87 and all(0 <= r["score"] <= 1 for r in rows) and [r["held_out"] for r in rows if r["doc_id"] is None] == [False]
    assert [r["score"] for r in docs.select(toxicity.score_column(spark, model).alias("score"), "doc_id").collect()] == [r["score"] for r in rows]
    assert toxicity.classify(empty, toxicity.fit(empty, labels)).count() == 0
    one = toxicity.fit(docs, labels.where("toxic = 0"))
    assert len({r["score"] for r in toxicity.classify(docs, one).collect()}) == 1


def test_toxicity_penalises_swapped_terms():
    """A term that goes with insults in the sample: neutral mentions of it are flagged without the penalty and not with it."""
    r = random.Random(3)
    vocab = "river stone bread light green window garden paper music train market summer letter".split()
    say = lambda *w: " ".join(r.sample([*r.sample(vocab, 6), *w], 6 + len(w)))
    texts = [say("muslim", r.choice(["vermin", "filthy"])) if i % 2 else say("muslim") for i in range(40)] + [say("christian") for _ in range(20)] + [say() for _ in range(140)]
    y = [1] * 40 + [0] * 160
    fair, plain = toxicity.train(texts, y, penalty=100.0), toxicity.train(texts, y, penalty=0.0)
    neutral = [say("muslim") for _ in range(50)]
    flagged = [sum(m.score(t) >= 0.7 for t in neutral) for m in (fair, plain)]
    assert flagged[0] == 0 and flagged[1] >= 40
    assert fair.score(say("vermin", "filthy")) > fair.score(neutral[0])


def test_toxicity_learns_repeated_stems():
    """A stem with many endings, used repeatedly, is toxic; used once, or rarely in a long text, it isn't."""
    r = random.Random(8)
    syllable = ["ka", "lo", "mi", "tu", "re", "sa", "no", "vi", "pe", "da"]
    word = lambda: "".join(r.choice(syllable) for _ in range(r.randint(2, 5)))
    say = lambda n, k: " ".join(r.sample([*(word() for _ in range(n - k)), *("grubx" + word() for _ in range(k))], n))
    texts = [say(150, r.randint(3, 6)) for _ in range(150)] + [say(150, int(r.random() < 0.1)) for _ in range(600)] + [say(6000, 6) for _ in range(4)]
    model = toxicity.train(texts, [1] * 150 + [0] * 604)
    assert sum(model.score(say(150, 5)) >= 0.7 for _ in range(40)) >= 36
    assert sum(model.score(say(150, i % 2)) >= 0.7 for i in range(40)) <= 1 and model.score(say(6000, 6)) < 0.7 < model.score(say(6000, 200))


def test_counterfactual_pairs():
    groups = (("cat", "dog"), ("red", "blue", "green"))
    assert toxicity.pairs_of(["The cat met a dog. Nothing."], groups) == [("the cat met a cat", "the dog met a dog")]
    (a, b), = toxicity.pairs_of(["Just words here."], groups)
    assert [x for x, y in zip(a.split(), b.split()) if x != y] and len(a.split()) == 4
    assert len(toxicity.pairs_of(["red. Blue! green? red"], groups)) == 3 and len(toxicity.pairs_of([""], groups)) == 1


def test_grams_begin_at_letters():
    text = "“idiot” — idiot's".encode()
    words, parts = toxicity.grams(np.frombuffer(text, np.uint8), np.array([0, len(text)]))
    whole = next(parts)[0]
    assert words.tolist() == [3] and whole[0] == whole[1]
    rest = list(parts)
    assert [len(h) for h, _ in rest[:2]] == [6, 2] and rest[1][0][0] == rest[1][0][1]


def test_packing(spark, docs, empty):
    files = queries.tokenizer_files()
    got = packing.pack_documents(docs, **files, capacity=64).toPandas()
    from tokenizers import Tokenizer

    import public_tokenizers

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    for doc_id, text in [(r["doc_id"], r["text"]) for r in docs.collect() if r["doc_id"] not in (None, 903)]:
        ids = t.encode(text or "", add_special_tokens=False).ids + [2]
        own = got[got.doc_id == doc_id].sort_values("piece")
        assert own.length.sum() == len(ids)
        for p in own.itertuples():
            assert p.ids_crc32 == zlib.crc32(np.asarray(ids[p.start : p.start + p.length], "<u4").tobytes())
    g = got.sort_values(["sequence_id", "offset"])
    assert (g.groupby("sequence_id").length.cumsum() - g.length == g.offset).all() and g.groupby("sequence_id").length.sum().max() <= 64
    assert got.sequence_id.nunique() <= 1.05 * -(-got.length.sum() // 64) + 1
    assert packing.pack_documents(empty, **files).count() == 0
    for text in ("a  b", " x ", "x \n y", "\n b\n  c \n", "it's  a\tb", "é 　 x"):
        ids, to = packing.encoder(**files)(np.frombuffer(text.encode(), np.uint8), np.array([0, len(text.encode())]))
        assert list(ids) == t.encode(text, add_special_tokens=False).ids


def test_packing_special_tokens(spark):
    from tokenizers import Tokenizer

    import public_tokenizers

    t, end = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json")), "<|endoftext|>"
    texts = ["plain text", f"{end}", f"a  {end}  b", f"{end}{end} it's", f"x <|endof", f"text|> y {end}", "", f"é{end}\n\n{end} ", "<|endoftext |>", f"{end} tail"]
    raw = [x.encode() for x in texts]
    offs = np.concatenate([[0], np.cumsum([len(x) for x in raw])])
    ids, to = packing.encoder(**queries.tokenizer_files())(np.frombuffer(b"".join(raw), np.uint8), offs)
    assert [list(ids[a:b]) for a, b in zip(to, to[1:])] == [t.encode(x, add_special_tokens=False).ids for x in texts]
    long = f"word {end} " * 900
    got = packing.pack_documents(spark.createDataFrame([(1, long), (2, None)], "doc_id long, text string"), **queries.tokenizer_files()).orderBy("doc_id", "piece").collect()
    want = t.encode(long, add_special_tokens=False).ids + [2]
    assert [(r["start"], r["ids_crc32"]) for r in got if r["doc_id"] == 1] == [(r["start"], zlib.crc32(np.asarray(want[r["start"] : r["start"] + r["length"]], "<u4").tobytes())) for r in got if r["doc_id"] == 1] and sum(r["length"] for r in got) == len(want) + 1


def _sets(text):
    w = WORDS.findall((text or "").lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_join(spark, docs, empty):
    r = random.Random(4)
    vocab = [f"w{i}" for i in range(500)]
    base = [" ".join(r.choice(vocab) for _ in range(60)) for _ in range(8)]
    rows = []
    for i in range(150):
        w = r.choice(base).split() if i % 5 else [r.choice(vocab) for _ in range(r.randint(0, 30))]
        for _ in range(r.randint(0, 4)):
            if w:
                w[r.randrange(len(w))] = r.choice(vocab)
        rows.append((i, " ".join(w)))
    got = {x["doc_id"]: (x["n_shingles"], x["component_id"]) for x in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets, label = [_sets(t) for _, t in rows], list(range(150))
    for i in range(150):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= 75 * (len(sets[i]) + len(sets[j]) - both):
                a, b = sorted((label[i], label[j]))
                label = [a if x == b else x for x in label]
    assert got == {i: (len(sets[i]), label[i]) for i in range(150)}
    edge = jaccard_join.join(docs).collect()
    assert len(edge) == 87 and {r["doc_id"]: r["component_id"] for r in edge}[900] == 900 and sum(r["doc_id"] is None for r in edge) == 1
    assert jaccard_join.join(empty).count() == 0


def _components(rows):
    """Brute force: id -> component, rows of one id being one document."""
    label = {i: i for i, _ in rows}
    sets = [(i, _sets(t)) for i, t in rows]
    for n, (i, a) in enumerate(sets):
        for j, b in sets[:n]:
            if i != j and a and b and 100 * len(a & b) >= 75 * len(a | b) and label[i] != label[j]:
                low, high = sorted((label[i], label[j]))
                label = {k: low if v == high else v for k, v in label.items()}
    return label


def test_join_repeated_ids_boundary_and_long_texts(spark):
    w = [f"w{i}" for i in range(200)]
    say = lambda *x: " ".join(x)
    rows = [(5, say(*w[:20])), (903, say(*w[:20])), (903, say(*w[30:50])), (7, say(*w[30:50])), (903, say(*w[30:50])), (20, ""), (20, say(*w[60:80])), (21, say(*w[60:80]))]
    # 12 and 16 shingles share 12: exactly 75 of 100; 11 and 15 share 11: below.
    rows += [(30, say(*w[80:96])), (31, say(*w[80:100])), (40, say(*w[100:115])), (41, say(*w[100:119]))]
    long = [f"x{i}" for i in range(40_000)]
    rows += [(50, say(*long)), (51, say(*long[:35_000])), (52, say(*long[:25_000])), (53, "y" * 500_000)]
    df = spark.createDataFrame([(*r, "z") for r in rows], "doc_id long, text string, n string")
    got = jaccard_join.join(df).collect()
    want = _components(rows)
    assert {(r["doc_id"], r["component_id"]) for r in got} == set(want.items()) and len(got) == len(rows)
    assert want[30] == want[31] and want[40] != want[41] and want[903] == want[7] == 5 and want[51] == 50 and want[52] != 50
    assert sorted(r["n_shingles"] for r in got) == sorted(len(_sets(t)) for _, t in rows)


def test_join_chains_of_copies(spark):
    """Clusters whose members link only through others, many shared passages, exact copies."""
    r = random.Random(12)
    vocab = [f"v{i}" for i in range(3000)]
    passage = [r.choice(vocab) for _ in range(30)]
    rows = []
    for c in range(12):
        w = [r.choice(vocab) for _ in range(120)]
        for m in range(25):
            rows.append((c * 100 + m, " ".join(w + passage * (m % 3 == 0))))
            for _ in range(r.randint(0, 3)):
                w[r.randrange(120)] = r.choice(vocab)
    r.shuffle(rows)
    got = {x["doc_id"]: x["component_id"] for x in jaccard_join.join(spark.createDataFrame(rows, "doc_id long, text string").repartition(7)).collect()}
    assert got == _components(rows)


def test_mixing(spark, docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == 87 and all(0 <= r["taken"] <= 3 * r["size"] for r in rows)
    assert abs(sum(r["taken"] for r in rows) - sum(r["size"] for r in rows)) <= 5
    assert sorted(map(str, rows)) == sorted(map(str, mixing.mix(docs.repartition(5)).collect()))
    out = mixing.materialise(docs).select("doc_id", mixing.words("text").alias("n")).groupBy("doc_id").agg(F.sum("n").alias("n")).collect()
    taken = {}
    for r in rows:
        taken[r["doc_id"]] = taken.get(r["doc_id"], 0) + r["taken"]
    assert all(taken[r["doc_id"]] == r["n"] for r in out)
    assert mixing.mix(empty).count() == 0


def test_fingerprints(spark, docs, empty):
    rows = order_minhash.compare(docs).collect()
    assert len(rows) == 86  # the repeated row counts once
    ordered = sorted({(r["doc_id"], r["text"] or "") for r in docs.collect()}, key=lambda r: (r[0] is not None, r[0] or 0))
    by = {r["doc_id"]: r for r in rows}
    for i, (doc_id, text) in enumerate(ordered):
        q = len(text) // 4
        want = text[: len(text) - q] + ordered[(i + 1) % len(ordered)][1][:q]
        assert by[doc_id]["edited_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert (want != text) or by[doc_id]["near_edited"] == 1.0
    two = spark.createDataFrame([(1, "a b c d e f g h"), (2, "a b c d e f g h"), (3, "h g f e d c b a")], "doc_id long, text string")
    f = [r["f"] for r in order_minhash.fingerprint(two, "text", "f").orderBy("doc_id").collect()]
    assert f[0] == f[1] != f[2]
    assert order_minhash.compare(empty).count() == 0


def test_fingerprints_of_short_texts(spark):
    r = random.Random(9)
    texts = ["a b a b", "b a b a", "a", "", *(" ".join(r.choice("abcdefgh") for _ in range(n)) for n in range(4, 90))]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    f = [x["f"] for x in order_minhash.fingerprint(df, "text", "f").orderBy("doc_id").collect()]
    cut = [[x[i : i + 8] for i in range(0, 512, 8)] for x in f]
    assert all(len(x) == 512 for x in f) and f[3] == "-" * 512 and all("-" not in x for i, x in enumerate(f) if i != 3)
    # The same two k-mers in the other order agree in no slot.
    assert len(set(cut[0])) == len(set(cut[1])) == 1 and cut[0][0] != cut[1][0]
    # All pairs of the text, hashed as pairs: every slot is one of them.
    assert "i" not in "abcdefgh"  # words are the tokens
    mers = {i: [" ".join(w[j : j + 3]) for j in range(len(w) - 2)] for i, w in ((i, x.split()) for i, x in enumerate(texts)) if len(w) > 3}
    pairs = [(i, *a.split(), *b.split()) for i, m in mers.items() for a, b in {(m[x], m[y]) for x in range(len(m)) for y in range(x + 1, len(m))}]
    h = lambda x: "xxhash64({})".format(", ".join(f"xxhash64({c})" for c in x))
    hashed = spark.createDataFrame(pairs, "i long, a string, b string, c string, d string, e string, f string").selectExpr("i", f"lpad(hex(xxhash64({h('abc')}, {h('def')}) & 4294967295L), 8, '0') as h").collect()
    known = {(x["i"], x["h"]) for x in hashed}
    assert all((i, c) in known for i in mers for c in cut[i])


def _fingerprints(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "i long, text string")
    return [x["f"] for x in order_minhash.fingerprint(df, "text", "f").orderBy("i").collect()]


def _brute(spark, texts):
    """Fingerprints from lists of (hash, place) in plain Python; only the hash function is Spark's."""
    tokens = [re.findall(r"[^\si05I]*[i05I]|[^\si05I]+", t) for t in texts]
    h = lambda rows, sql: {r: x["h"] for r, x in zip(rows, spark.createDataFrame(rows, ", ".join(f"c{j} {t}" for j, t in enumerate(sql))).selectExpr(f"xxhash64({', '.join(f'c{j}' for j in range(len(sql)))}) as h").collect())}
    of = h(sorted({(t,) for x in tokens for t in x}), ["string"])
    mer_keys = [[tuple(of[(t,)] for t in (*x[j : j + 3], *[None] * 3)[:3] if t is not None) for j in range(max(len(x) - 2, min(len(x), 1)))] for x in tokens]
    mer = {}
    for n in (1, 2, 3):
        some = sorted({m for x in mer_keys for m in x if len(m) == n})
        if some:
            mer |= h(some, ["long"] * n)
    numbered, keys = [], set()
    for x in mer_keys:
        count, row = {}, []
        for place, m in enumerate(x):
            top = (mer[m] % (1 << 64)) >> 32
            row.append((top, count.setdefault(top, 0), place))
            count[top] += 1
        numbered.append(row)
        keys |= {(a, b) for a, b, _ in row}
    order = h(sorted(keys), ["long", "int"]) if keys else {}
    picked = []
    for x in numbered:
        e = sorted(((order[a, b] % (1 << 64)) >> 32, place) for a, b, place in x)
        slots = []
        for s in range(64):
            at = next((j for j, (v, _) in enumerate(e) if v >> 26 >= s), 0)
            slots.append(tuple(sorted((e[at][1], e[(at + 1) % len(e)][1]))) if e else ())
        picked.append(slots)
    hex8 = lambda rows, sql: {k: f"{v & 0xFFFFFFFF:08X}" for k, v in h(rows, sql).items()} if rows else {}
    pair_of = lambda x, pair: tuple(mer[x[p]] for p in pair)
    digits = hex8(sorted({pair_of(x, pair) for x, slots in zip(mer_keys, picked) if len(x) > 1 for pair in slots}), ["long", "long"])
    lone = hex8(sorted({(mer[x[0]], -1) for x in mer_keys if len(x) == 1}), ["long", "int"])
    return ["-" * 512 if not x else lone[mer[x[0]], -1] * 64 if len(x) == 1 else "".join(digits[pair_of(x, pair)] for pair in slots) for x, slots in zip(mer_keys, picked)]


def test_fingerprints_against_brute_force(spark):
    r = random.Random(2)
    texts = ["", "a", "x y", "it is a tip", *(" ".join(r.choice(["bit", "sin", "a", "tom", "zip5", "lion"]) for _ in range(r.randint(3, 300))) for _ in range(30))]
    assert _fingerprints(spark, texts) == _brute(spark, texts)


def test_fingerprints_follow_edits(spark):
    """One letter more in a text without spaces, and a longer text, stay alike; other texts and other scripts don't."""
    r = random.Random(6)
    dense = "".join(r.choice("abcdefghiklmnoprstu") for _ in range(4000))
    cjk = "".join(chr(r.randint(0x4E00, 0x9FA0)) for _ in range(3000))
    spaced = " ".join("".join(r.choice("abcdefghi") for _ in range(5)) for _ in range(60_000))
    texts = [dense, "x" + dense, dense[:2000] + "q" + dense[2000:], cjk, cjk[:100] + "\u4e01" + cjk[100:], dense[::-1], spaced, spaced[:150_000] + " new " + spaced[150_000:]]
    f = _fingerprints(spark, texts)
    like = lambda a, b: sum(f[a][i : i + 8] == f[b][i : i + 8] for i in range(0, 512, 8)) / 64
    assert min(like(0, 1), like(0, 2), like(3, 4), like(6, 7)) > 0.85 and like(0, 5) == like(0, 3) == 0


def test_fingerprints_in_many_buckets(spark, docs, monkeypatch):
    want = {tuple(r) for r in order_minhash.compare(docs).collect()}
    monkeypatch.setattr(order_minhash, "BUCKET_BYTES", 2000)
    assert {tuple(r) for r in order_minhash.compare(docs).collect()} == want and len(want) == 86


def test_fingerprints_of_every_row(spark, docs, tmp_path):
    more = docs.unionByName(docs.where("doc_id IS NULL OR doc_id IN (5, 900)"))
    more.write.parquet(f"{tmp_path}/documents.parquet")
    rows = queries.op6_order_minhash(spark, str(tmp_path)).collect()
    ids = sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in rows)
    assert len(rows) == 90 and ids == sorted(r["doc_id"] if r["doc_id"] is not None else -1 for r in more.collect())
    assert set(rows) == set(order_minhash.compare(docs).collect())


def test_quotation(spark):
    rows = [(1, 0, "u", "Hello there\nsecond line"), (1, 1, "a", "> hello  THERE\nmy answer"), (1, 2, "u", "> > hello there\n> my answer\nthanks"), (1, 3, "a", "> never said"), (2, 0, "u", None), (2, 1, "u", ""), (None, 1, "u", "> x"), (3, None, "u", "y")]
    got = {(r["conv_id"], r["turn"]): r for r in quotation.link(spark.createDataFrame([(*r, "z") for r in rows], "conv_id long, turn long, role string, text string, lines string")).collect()}
    assert len(got) == 8
    assert [got[1, t]["parent_turn"] for t in range(4)] == [None, 0, 1, None] and [got[1, t]["root_turn"] for t in range(4)] == [0, 0, 0, 3]
    assert got[1, 2]["clean_text"] == "thanks" and got[1, 2]["quote_depth"] == 2 and got[1, 2]["reply_depth"] == 2


def _linked(rows):
    """turn: (parent_turn, linked_lines) of one conversation, by comparing every passage with every stretch of every earlier message."""
    own, quotes = {}, {}
    for turn, text in rows:
        runs = []
        for x in text.split("\n"):
            marks = re.match(r"(?:[ \t]*>)*", x).group()
            level, norm = marks.count(">"), " ".join(x[len(marks) :].lower().split())
            if norm and runs and runs[-1][0] == level:
                runs[-1][1].append(norm)
            elif norm:
                runs.append((level, [norm]))
        own[turn] = [n for v, r in runs if v == 0 for n in r]
        quotes[turn] = [(v, r) for v, r in runs if v > 0]
    out = {}
    for turn, runs in quotes.items():
        origin = lambda p: next((o for o in sorted(own) if o < turn and any(own[o][i : i + len(p)] == p for i in range(len(own[o])))), None)  # noqa: B023, E731
        where = {}
        for level in {v for v, _ in runs}:
            here = [r for v, r in runs if v == level]
            whole = [n for r in here for n in r]
            for n in set(whole):
                tries = [whole, *sorted((r for r in here if n in r), key=lambda r: (-len(r), -1 if (o := origin(r)) is None else o)), [n]]
                hit = next((o for o in map(origin, tries) if o is not None), None)
                if hit is not None:
                    where[level, n] = hit
        low = min((v for v, _ in where), default=0)
        votes = [o for (v, _), o in where.items() if v == low]
        out[turn] = max(((votes.count(o), o) for o in votes), default=(0, None))[1], len(where)
    return out


def test_quotation_passages(spark):
    r, cases = random.Random(5), []
    cases.append(["A line", "other", ">> A line\nok"])  # nested only
    cases.append(["yes", "no", "yes\nno\nmaybe", "> yes\n> no\nanswer"])  # part of a message
    cases.append(["a\nb", "c\n\na\nb\nd", "> a\nso\n> b\n> never", "> b\n> d\n>> a\n>> c"])
    for _ in range(60):
        lines = lambda: [r.choice("abcd") for _ in range(r.randint(1, 6))]
        cases.append(["\n".join("> " * r.choice((0, 0, 1, 1, 2)) + x for x in lines()) for _ in range(6)])
    rows = [(c, t, "u", text) for c, texts in enumerate(cases) for t, text in enumerate(texts)]
    got = {(x["conv_id"], x["turn"]): (x["parent_turn"], x["linked_lines"]) for x in quotation.link(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).collect()}
    assert got[0, 2] == (0, 1) and got[1, 3] == (2, 2)
    assert got == {(c, t): x for c, texts in enumerate(cases) for t, x in _linked(list(enumerate(texts))).items()}


def test_sharding(spark, docs, empty):
    rows = sharding.shard(docs, limit=3000).collect()
    assert len(rows) == 87
    total = {}
    for r in rows:
        total.setdefault(r["shard"], []).append(r["n_bytes"])
    assert all(sum(v) <= 3000 or len(v) == 1 for v in total.values())
    names = list(total)
    assert not any(a != b and b.startswith(a) for a in names for b in names)
    assert sharding.shard(empty).count() == 0


def test_lm_score(spark, docs, empty):
    rows = {r["doc_id"]: r for r in lm_score.score(docs, depth=3).collect() if r["doc_id"] != 903}
    fold = lambda i: -1 if i is None else zlib.crc32(str(i).encode()) % 5
    data = [(r["doc_id"], (r["text"] or "").lower()) for r in docs.collect()]
    nodes: dict = {}
    for i, text in data:
        if fold(i) != 1:
            raw = b"\0" * 3 + text.encode() + b"\0"
            for at in range(3, len(raw)):
                for bit in range(8):
                    prefix, one = (1 << bit) | (raw[at] >> (8 - bit)), (raw[at] >> (7 - bit)) & 1
                    for d in range(4):
                        nodes.setdefault((raw[at - d : at], prefix), [0, 0])[one] += 1
    kt = lambda n: math.lgamma(n[0] + 0.5) + math.lgamma(n[1] + 0.5) - math.log(math.pi) - math.lgamma(sum(n) + 1)
    children: dict = {}
    for c, p in nodes:
        if c:
            children.setdefault((c[1:], p), []).append((c, p))
    weighted: dict = {}
    for key in sorted(nodes, key=lambda k: -len(k[0])):
        own = kt(nodes[key])
        weighted[key] = own if len(key[0]) == 3 else np.logaddexp(own, sum(weighted[c] for c in children[key])) - math.log(2)
    for i, text in data[:6]:
        raw, total = b"\0" * 3 + text.encode() + b"\0", 0.0
        for at in range(3, len(raw)):
            for bit in range(8):
                prefix, one, p = (1 << bit) | (raw[at] >> (8 - bit)), (raw[at] >> (7 - bit)) & 1, 0.5
                for d in (3, 2, 1, 0):
                    n = nodes.get((raw[at - d : at], prefix))
                    if n is None:
                        p = 0.5
                        continue
                    w = 1.0 if d == 3 else math.exp(kt(n) - math.log(2) - weighted[raw[at - d : at], prefix])
                    p = w * (n[1] + 0.5) / (sum(n) + 1) + (1 - w) * p
                total += math.log10(p if one else 1 - p)
        assert rows[i]["score"] == pytest.approx(total, rel=1e-5)
    count: dict = {}
    ends = sum(fold(i) != 1 for i, _ in data)
    for i, text in data:
        if fold(i) != 1:
            for w in WORDS.findall(text):
                count[w] = count.get(w, 0) + 1
    n, v = sum(count.values()) + ends, len(count) + 1
    for i, text in data:
        if i not in (903,):
            c = [count.get(w, 0) for w in WORDS.findall(text)] + [ends]
            assert rows[i]["base_score"] == pytest.approx(sum(math.log10((x + 0.5) / (n + 0.5 * (v + 1))) for x in c))
            assert rows[i]["train_tokens"] == n and rows[i]["n_known"] == sum(x > 0 for x in c) and rows[i]["n_tokens"] == len(c)
    assert lm_score.score(empty).count() == 0
    for r in lm_score.score(docs, depth=3, chunk_bytes=1500).collect():  # many chunks, the same scores
        if r["doc_id"] in rows:
            assert r["score"] == pytest.approx(rows[r["doc_id"]]["score"], rel=1e-5) and r["base_score"] == pytest.approx(rows[r["doc_id"]]["base_score"])


def test_top_k(spark):
    rng = np.random.default_rng(0)
    rows = [(i, [float(x) for x in rng.normal(size=6)]) for i in range(400)] + [(1000 + i, rows) for i, rows in enumerate([None, [], [None] * 6, [float("nan")] * 6, [1.0, 2.0]])]
    rows += [(2000 + i, [0.5] * 6) for i in range(30)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>").select("vec_id", knn_join.quantise("embedding").alias("v"))
    got = [tuple(r) for r in knn_join.top_k(df, df.where("vec_id % 100 = 0")).collect()]
    v = {i: np.floor(1024 * np.asarray(e, np.float32).astype(float)).astype(int) for i, e in rows if e and None not in e and not np.isnan(e).any()}
    want = []
    for q in (i for i in v if i % 100 == 0):
        best = sorted((-int(v[q] @ v[x]), x) for x in v if x != q and len(v[x]) == len(v[q]))[:10]
        want += [(q, n + 1, x, -s) for n, (s, x) in enumerate(best)]
    assert sorted(got) == sorted(want)


def test_top_k_repeated_ids(spark):
    """A query's id with many rows, one of them likely a pivot, repeated queries, an id with two vectors, nothing to find."""
    rng = np.random.default_rng(3)
    rows = [(i, [float(x) for x in rng.normal(size=8)]) for i in range(1, 2000)]
    rows += [(0, [5.0] * 8)] * 30 + [(100, rows[99][1])] * 6 + [(200, [1.0] + [0.0] * 7)] + [(7, rows[6][1])] * 4
    df = spark.createDataFrame([(*r, "x") for r in rows], "vec_id long, embedding array<float>, v string").select("vec_id", knn_join.quantise("embedding").alias("v"))
    got = [tuple(r) for r in knn_join.top_k(df, df.where("vec_id % 100 = 0")).collect()]
    v = [(i, np.floor(1024 * np.asarray(e, np.float32).astype(float)).astype(int)) for i, e in rows]
    want = []
    for q, e in sorted({(i, tuple(x)) for i, x in v if i % 100 == 0}):
        best = sorted((-int(np.dot(e, x)), i) for i, x in v if i != q)[:10]
        want += [(q, n + 1, i, -s) for n, (s, i) in enumerate(best)]
    assert sorted(got) == sorted(want) and len(got) == 21 * 10
    assert knn_join.top_k(df.limit(0), df).count() == knn_join.top_k(df, df.limit(0)).count() == 0
    big = spark.createDataFrame([(0, [2**62, 2**62]), (1, [2**62, 2**62]), (2, [-(2**62), 5])], "vec_id long, v array<long>")
    assert [r["score"] for r in knn_join.top_k(big, big.where("vec_id = 0")).orderBy("rank").collect()] == [2**63 - 1, 1 - 2**63]


def test_lookup():
    keys = np.unique(np.random.default_rng(1).integers(0, 1 << 60, 5000, dtype=np.uint64))
    find = Lookup(keys).find
    assert (find(keys) == np.arange(len(keys))).all() and (find(keys + np.uint64(1 << 61)) == -1).all()
