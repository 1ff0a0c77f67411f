"""The five stages on a small table: each stage's decisions against a plain version, on what its predecessor kept."""

import random
import re

import corpus_pipeline
from haploweave.llm import language_id, mixing, toxicity

WORDS = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"


def _sets(text):
    w = WORDS.findall(text.lower())
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_stages(spark, tmp_path):
    r = random.Random(4)
    vocab = [f"{a}{b}{c}" for a in "brstlm" for b in "aeiou" for c in ("n", "st", "r", "le")]
    rows = []
    for i in range(90):
        w = [r.choice(vocab) for _ in range(r.randint(6, 40))]
        if i % 3 == 0:
            w += ["scumbag", "vermin"]
        rows.append((i, " ".join(w), "en", f"s{i % 3}", 0))
        if i % 5 == 0:  # an exact and a near copy
            rows += [(200 + i, " ".join(w), "en", "s0", 0), (400 + i, " ".join([*w, "extra"]), "en", None, 0)]
    rows += [(900, None, None, "s1", None), (901, "12 34 ...", "en", "s1", 9), (902, "", "en", None, 0), (None, "a text without an id", "en", "s2", 20)]
    labels = [(i, int(i % 3 == 0)) for i in range(90)]
    spark.createDataFrame(rows, SCHEMA).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame(labels, "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs, kept = spark.read.parquet(f"{tmp_path}/documents.parquet"), []
    for n, (name, stage) in enumerate(corpus_pipeline.STAGES):
        out = stage(spark, docs, str(tmp_path))
        assert n == 4 or out.columns == docs.columns
        out.write.parquet(f"{tmp_path}/{name}")
        kept.append([tuple(x) for x in spark.read.parquet(f"{tmp_path}/{name}").collect()])
        docs_before, docs = docs, spark.read.parquet(f"{tmp_path}/{name}")
        if name == "language_id":
            und = {x["doc_id"] for x in language_id.identify(docs_before, language_id.fit(docs_before)).collect() if x["lang_pred"] == "und"}
            assert und == {900, 901, 902} and sorted(map(str, kept[0])) == sorted(str(x) for x in rows if x[0] not in und)
        elif name == "toxicity":
            model = toxicity.fit(docs_before, spark.read.parquet(f"{tmp_path}/labels.parquet"))
            assert sorted(map(str, kept[1])) == sorted(str(x) for x in kept[0] if model.score(x[1]) < 0.7)
            assert not any("scumbag" in x[1] for x in kept[1]) and len(kept[1]) >= 60
        elif name == "near_duplicates":
            named = [(x[0], _sets(x[1])) for x in kept[1] if x[0] is not None]
            label = {i: i for i, _ in named}
            for j, (i, a) in enumerate(named):
                for k, b in named[:j]:
                    if a and b and 100 * len(a & b) >= 75 * len(a | b) and label[i] != label[k]:
                        low, high = sorted((label[i], label[k]))
                        label = {x: low if v == high else v for x, v in label.items()}
            assert sorted(x[0] for x in kept[2] if x[0] is not None) == sorted(set(label.values())) and sum(x[0] is None for x in kept[2]) == 1
        elif name == "mixing":
            taken = {x["doc_id"]: x["taken"] for x in mixing.mix(docs_before).collect()}
            got = {}
            for x in kept[3]:
                got[x[0]] = got.get(x[0], 0) + len(WORDS.findall(x[1]))
            assert got == {i: t for i, t in taken.items() if t}
        else:
            places = sorted((x.sequence_id, x.offset, x.length) for x in docs.collect())
            assert all(b[1] == (a[1] + a[2] if a[0] == b[0] else 0) for a, b in zip([(None, 0, 0), *places], places)) and max(o + n for _, o, n in places) <= 1024
            assert docs.where("piece = 0").count() == len(kept[3])
    assert sorted(map(str, corpus_pipeline.run(spark, str(tmp_path)).select("doc_id", "piece", "ids_crc32").collect())) == sorted(map(str, docs.select("doc_id", "piece", "ids_crc32").collect()))
