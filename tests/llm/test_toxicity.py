"""Held-out precision and recall, the folds, and what the penalty on swapped identity terms does."""

import random
import zlib

import pyarrow.parquet as pq
import pytest

from quillon.llm import queries, toxicity

GROUPS = {"en": ("muslims", "christians", "the {} met in the park on sunday"), "fr": ("femmes", "hommes", "les {} sont venues au marché"), "de": ("flüchtlinge", "einheimische", "die {} wohnen in der stadt"), "es": ("negros", "blancos", "los {} viven en el barrio")}


def planted(spark):
    """Toxic texts that often name one group of each language, and neutral ones that name groups now and then."""
    rng, rows = random.Random(2), []
    insults, plain = ["scum", "vermin", "idiots", "filth", "trash"], [f"word{i}" for i in range(60)]
    for i in range(600):
        group, _, _ = list(GROUPS.values())[i % 4]
        words = rng.sample(plain, 8)
        if i % 3 == 0:
            words += [group] * (rng.random() < 0.9) + [rng.choice(insults)] * (rng.random() < 0.8)
        elif rng.random() < 0.04:
            words += [group]
        rng.shuffle(words)
        rows.append((i, " ".join(words) + ".", int(i % 3 == 0)))
    docs = spark.createDataFrame([r[:2] for r in rows], "doc_id long, text string")
    return docs, spark.createDataFrame([(r[0], r[2]) for r in rows], "doc_id long, toxic int")


@pytest.fixture(scope="module")
def models(spark):
    docs, labels = planted(spark)
    return {p: toxicity.train(docs, labels, swap_penalty=p) for p in (0.0, 1.0)}


@pytest.mark.parametrize("lang", GROUPS)
def test_neutral_mentions(models, lang):
    group, other, sentence = GROUPS[lang]

    def moved(model):
        scores = [model.score(sentence.format(x)) for x in (group, other, "")]
        return max(scores) - min(scores)

    assert moved(models[0.0]) > 0.15
    assert moved(models[1.0]) < 0.3 * moved(models[0.0])
    assert models[0.0].score(sentence.format(group)) >= 0.3 > models[1.0].score(sentence.format(group))


def test_insults_are_still_found(models):
    for insult in ("scum", "vermin", "idiots", "filth", "trash"):
        assert models[1.0].score(f"they are {insult} word1 word2") >= 0.3


def test_counterfactuals_of_sentences():
    found = toxicity.changes("Nice day. The women came! Bad", neutral=False)
    women = toxicity.TERMS.index(b"women")
    assert {t for t, _, _ in found} == {women} and len(found) == 2
    go = {b"women", b"^wome", b"^women"}
    assert {(a, b) for _, a, b in found} == {(frozenset(go), frozenset({b"men"})), (frozenset(go), frozenset())}
    put = toxicity.changes("Nice day.", neutral=True)
    assert len({t for t, _, _ in put}) == 1 and len(put) >= 2
    assert toxicity.changes(None, True) == [] and toxicity.changes("...", True) == []


def test_held_out_precision_and_recall(spark):
    sf = "/root/testdata/sf0.1"
    toxic = {r["doc_id"]: r["toxic"] for r in pq.read_table(f"{sf}/labels.parquet").to_pylist()}
    got = queries.queries()["op3_toxicity"](spark, sf).collect()
    out = {r["doc_id"]: r["predicted"] for r in got if r["held_out"]}
    assert set(out) == {r["doc_id"] for r in got if zlib.crc32(str(r["doc_id"]).encode()) % 4 == 2}
    found = [(out[i], y) for i, y in toxic.items() if i in out]
    hits = sum(p and y for p, y in found)
    assert hits >= 0.85 * sum(y for _, y in found) and hits >= 0.9 * sum(p for p, _ in found)
    print("precision", hits / sum(p for p, _ in found), "recall", hits / sum(y for _, y in found))


def test_held_out_labels_teach_nothing(spark):
    docs, labels = planted(spark)
    flipped = labels.selectExpr("doc_id", "case when pmod(crc32(cast(cast(doc_id as string) as binary)), 4) = 2 then 1 - toxic else toxic end as toxic")
    assert sorted(toxicity.score_held_out(docs, labels).collect()) == sorted(toxicity.score_held_out(docs, flipped).collect())
