"""The pipeline's stages against plain versions, each on what the stage before it kept."""

from collections import Counter, defaultdict

import corpus_pipeline
import pytest
from brute import crc, exact_groups, words

from quillon.llm import mixing
from quillon.llm.common import stored

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def outputs(spark):
    docs, found = spark.read.parquet(f"{DIR}/documents.parquet"), []
    found.append([r.asDict() for r in docs.collect()])
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, DIR)
        if name != "packing":
            docs = stored(docs)[0]
        found.append([r.asDict() for r in docs.collect()])
    return found


def test_language_keeps_texts_with_letters(outputs):
    assert {r["doc_id"] for r in outputs[1]} == {r["doc_id"] for r in outputs[0] if any(c.isalpha() for c in r["text"] or "")}


def test_exact_keeps_the_best_of_each_group(outputs):
    rows = [(r["doc_id"], r["text"]) for r in outputs[1]]
    assert sorted(r["doc_id"] for r in outputs[2]) == sorted({keep for keep, _, _ in exact_groups(rows)})


def test_near_keeps_one_of_each_group(outputs):
    sets = {}
    for r in outputs[2]:
        w = r["text"].lower().split()
        sets[r["doc_id"]] = {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))}
    kept = {r["doc_id"] for r in outputs[3]}
    alike = lambda a, b: len(sets[a] & sets[b]) / len(sets[a] | sets[b])
    ids = sorted(sets)
    for n, a in enumerate(ids):
        near = [alike(a, b) for b in ids if b != a]
        if a not in kept:
            assert max(near) >= 0.6
        assert not any(a in kept and b in kept and alike(a, b) >= 0.85 for b in ids[:n])


def test_mix_meets_the_targets(outputs):
    size, taken, most = Counter(), Counter(), Counter()
    for r in outputs[3]:
        size[r["source"]] += len(words(r["text"]))
        most[r["doc_id"]] = len(words(r["text"]))
    per_doc = Counter()
    for r in outputs[4]:
        n = len(words(r["text"]))
        taken[r["source"]] += n
        per_doc[r["doc_id"]] += n
        assert r["n_chars"] == len(r["text"])
    target = mixing.targets(list(size.items()))
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)
    assert all(n <= 2 * most[i] for i, n in per_doc.items())


def test_packing_holds_every_id(outputs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    total, sizes, crcs = 0, defaultdict(int), Counter()
    for r in outputs[5]:
        total += r["length"]
        sizes[r["sequence_id"]] += r["length"]
        if r["length"] == r["doc_tokens"]:
            crcs[r["ids_crc32"]] += 1
    texts = [[*t.encode(r["text"], add_special_tokens=False).ids, 1] for r in outputs[4]]
    assert total == sum(map(len, texts)) and max(sizes.values()) <= 2048
    whole = Counter(crc(x) for x in texts)
    assert all(n <= whole[c] for c, n in crcs.items())


def test_run_gives_the_last_stage(spark, outputs):
    docs = Counter((r["doc_id"], r["doc_tokens"]) for r in outputs[5] if r["start"] == 0)
    got = corpus_pipeline.run(spark, DIR).collect()
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in got if r["start"] == 0) == docs


def test_run_on_an_empty_table(spark, tmp_path):
    spark.read.parquet(f"{DIR}/documents.parquet").limit(0).write.parquet(str(tmp_path / "documents.parquet"))
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0


EXTRA = "doc_id long, text string, lang string, source string, n_chars long, row int, id long, label long, size long"


def staged(spark, stage, rows):
    docs = spark.createDataFrame([(i, t, x, s, 0, 1, 2, 3, 4) for i, t, x, s in rows], EXTRA)
    out = stage(spark, docs, "")
    assert out.columns == docs.columns
    return sorted(((r["doc_id"], r["text"]) for r in out.collect()), key=str)


ENGLISH = "the house by the river is where the children went in the morning"
GERMAN = "das haus am fluss ist dort wo die kinder am morgen hingegangen sind"


def test_language_stage_on_odd_rows(spark):
    rows = [(i, f"{ENGLISH} {'abc'[i % 3]}", "en", "s") for i in range(40)] + [(100 + i, f"{GERMAN} {'abc'[i % 3]}", "de", "s") for i in range(40)]
    odd = [(None, ENGLISH, None, None), (5, None, "en", "s"), (6, "", "en", None), (7, "12 34 !", "de", "s"), (100, GERMAN, "de", "s"), (100, GERMAN, "de", "s")]
    assert staged(spark, corpus_pipeline.language_stage, rows + odd) == sorted([(i, t) for i, t, _, _ in rows + odd if t and any(map(str.isalpha, t))], key=str)


def test_exact_stage_on_odd_rows(spark):
    rows = [(3, "a b", "en", "s"), (1, "ab", "en", "s"), (2, "a  b", "en", None), (4, None, None, None), (5, "", "en", "s"), (5, "", "en", "s"), (None, "x y", "en", "s"), (9, "xy", "en", "s"), (9, "z", "en", "s")]
    # Of a b, ab and a  b the longest stays; of null and two empty ones the smallest id; x y is longer than xy.
    assert staged(spark, corpus_pipeline.exact_stage, rows) == sorted([(2, "a  b"), (4, None), (None, "x y"), (9, "z")], key=str)


def test_near_stage_on_odd_rows(spark):
    words = [f"w{i}" for i in range(60)]
    near = " ".join([*words[:59], "other"])
    rows = [(8, " ".join(words), "en", "s"), (2, near, "en", "s"), (5, None, "en", "s"), (6, "", "en", None), (4, "  ", None, "s"), (None, near, "en", "s"), (11, "a b", "en", "s"), (12, "A  b", "en", "s"), (13, "a c", "en", "s")]
    # 2 stays for 8, 4 for the wordless ones, 11 for 12; a row without an id stays.
    assert staged(spark, corpus_pipeline.near_stage, rows) == sorted([(2, near), (4, "  "), (None, near), (11, "a b"), (13, "a c")], key=str)


def test_mixing_and_packing_on_odd_rows(spark):
    rows = [(1, "a b c d", "en", "s"), (1, "a b c d", "en", "s"), (2, None, "en", "s"), (3, "", "en", None), (None, "e f", "en", None)]
    got = staged(spark, corpus_pipeline.mixing_stage, rows)
    # 15 words to share, 3:1, so s gets 11.25 and null 3.75, both below their double.
    assert sum(len(t.split()) for i, t in got if i == 1) == 11 and sum(len(t.split()) for i, t in got if i is None) == 4
    docs = spark.createDataFrame([(i, t, x, s, 0, 1, 2, 3, 4) for i, t, x, s in rows], EXTRA)
    packed = corpus_pipeline.packing_stage(spark, docs, "").collect()
    assert Counter((r["doc_id"], r["doc_tokens"]) for r in packed if r["start"] == 0)[2, 1] == 1 and sum(r["start"] == 0 for r in packed) == 5
