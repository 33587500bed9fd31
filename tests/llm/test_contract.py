"""Each query against a plain version, over the whole small tables."""

import hashlib
from collections import defaultdict

import numpy as np
import pyarrow.parquet as pq
import pytest
from brute import components, crc, exact_groups, kept_words, secret_spans, simhash, words

from quillon.llm import mixing, queries, sharding

DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs():
    t = pq.read_table(f"{DIR}/documents.parquet").to_pydict()
    return [dict(zip(t, x, strict=True)) for x in zip(*t.values(), strict=True)]


def rows(spark, name):
    return [r.asDict() for r in queries.queries()[name](spark, DIR).collect()]


def test_op1(spark, docs):
    want = {d["doc_id"]: simhash(d["text"]) for d in docs}
    comp = components(list(want), list(want.values()))
    got = rows(spark, "op1_simhash_near_dedup")
    assert {r["doc_id"]: (r["fingerprint"], r["component_id"]) for r in got} == {i: (f"{f:016x}", comp[i]) for i, f in want.items()}
    assert len(got) == len(docs)


def test_op2(spark, docs):
    got = rows(spark, "op2_language_id")
    lang = {d["doc_id"]: d["lang"] for d in docs}
    out = [r for r in got if r["held_out"]]
    assert len(got) == len(docs) and out
    assert sum(r["lang_pred"] == lang[r["doc_id"]] for r in out) >= 0.95 * len(out)
    assert all(0 <= r["score"] <= 1 for r in got)


def test_op3(spark, docs):
    got = rows(spark, "op3_toxicity")
    assert len(got) == len(docs) and all(0 <= r["score"] <= 1 and r["predicted"] == (r["score"] >= 0.3) for r in got)


def test_op4(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op4_secret_scan")}
    for d in docs:
        spans = secret_spans(d["text"])
        text = ",".join(f"{('assign', 'access', 'hex')[k]}:{a}:{b}" for a, k, b in spans)
        r = got[d["doc_id"]]
        assert [r["n_assign"], r["n_access"], r["n_hex"]] == [sum(s[1] == k for s in spans) for k in range(3)]
        assert r["base_sha256"] == hashlib.sha256(text.encode()).hexdigest()
        assert set(filter(None, text.split(","))) <= set(r["spans"].split(","))


def test_op5(spark):
    t = pq.read_table(f"{DIR}/embeddings.parquet").to_pydict()
    x, ids = np.array(t["embedding"], dtype=np.float64), np.array(t["vec_id"])
    got = defaultdict(dict)
    for r in rows(spark, "op5_nearest_neighbours"):
        got[r["query_id"]][r["rank"]] = (r["vec_id"], r["score"])
    hits = total = 0
    for q in ids[ids % 100 == 0]:
        far = np.sqrt(((x - x[ids == q][0]) ** 2).sum(axis=1))
        best = [i for i in np.lexsort((ids, far)) if ids[i] != q][:10]
        total += 10
        hits += len({int(ids[i]) for i in best} & {v for v, _ in got[q].values()})
        assert sorted(got[q]) == list(range(1, 11))
        assert all(abs(s - far[ids == v][0]) < 1e-12 for v, s in got[q].values())
    assert hits >= 0.9 * total


def test_op6(spark, docs):
    want = kept_words([(d["doc_id"], d["text"]) for d in docs])
    got = {r["doc_id"]: r for r in rows(spark, "op6_substring_dedup")}
    for i, (n, kept) in want.items():
        assert (got[i]["n_words"], got[i]["n_removed"], got[i]["kept_sha256"]) == (n, n - len(kept), hashlib.sha256(" ".join(kept).encode()).hexdigest())


def test_op7(spark, docs):
    size = defaultdict(int)
    for d in docs:
        size[d["source"]] += len(words(d["text"]))
    target = mixing.targets(list(size.items()))
    got = rows(spark, "op7_source_mix")
    assert got and sorted(r["doc_id"] for r in got) == sorted(d["doc_id"] for d in docs)
    taken = defaultdict(int)
    source = {d["doc_id"]: d["source"] for d in docs}
    for r in got:
        taken[source[r["doc_id"]]] += r["taken"]
        assert 0 <= r["taken"] <= 2 * r["size"] and r["source_size"] == size[source[r["doc_id"]]]
        assert r["target"] == pytest.approx(target[source[r["doc_id"]]])
    assert all(abs(taken[s] - target[s]) <= 1 for s in size)
    assert sum(target.values()) == pytest.approx(1.5 * sum(size.values()))
    key = lambda r: (r["doc_id"], r["taken"])
    assert sorted(rows(spark, "op7_source_mix"), key=key) == sorted(got, key=key)


def test_op8(spark, docs):
    got = {r["doc_id"]: r for r in rows(spark, "op8_shard_documents")}
    assert len(got) == len(docs)
    by_text, by_shard, load = defaultdict(set), defaultdict(list), defaultdict(int)
    for d in docs:
        r = got[d["doc_id"]]
        assert r["size"] == len(d["text"].encode()) + 8 and 0 <= r["shard"] < 24
        by_text[d["text"]].add(r["shard"])
        by_shard[r["shard"]].append(r["slot"])
        load[r["shard"]] += r["size"]
    assert all(len(s) == 1 for s in by_text.values())
    assert all(sorted(s) == list(range(len(s))) for s in by_shard.values())
    assert {r["law"] for r in got.values()} == {"bytes"}
    groups = defaultdict(int)
    for d in docs:
        groups[d["text"]] += len(d["text"].encode()) + 8
    best = sharding.schedule([(n, t) for t, n in groups.items()], 24)
    want = [sum(n for t, n in groups.items() if best[t] == s) for s in range(24)]
    assert sorted(load.values()) == sorted(want)


def test_op9(spark, docs):
    want = exact_groups([(d["doc_id"], d["text"]) for d in docs])
    got = {r["doc_id"]: r for r in rows(spark, "op9_exact_dedup")}
    for d, (keep, size, sha) in zip(docs, want, strict=True):
        r = got[d["doc_id"]]
        assert (r["keep_id"], r["group_size"], r["kept"], r["text_sha256"]) == (keep, size, keep == d["doc_id"], sha)


def test_op10(spark, docs):
    import public_tokenizers
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    pieces, seqs = defaultdict(list), defaultdict(list)
    for r in rows(spark, "op10_pack_tokens"):
        pieces[r["doc_id"]].append(r)
        seqs[r["sequence_id"]].append((r["offset"], r["length"]))
    for d in docs:
        ids, at = [*t.encode(d["text"], add_special_tokens=False).ids, 1], 0
        for r in sorted(pieces[d["doc_id"]], key=lambda r: r["start"]):
            assert (r["start"], r["doc_tokens"]) == (at, len(ids)) and r["length"] > 0
            assert r["ids_crc32"] == crc(ids[at : at + r["length"]])
            at += r["length"]
        assert at == len(ids)
    padded = used = 0
    for s in seqs.values():
        at = 0
        for offset, length in sorted(s):
            assert offset == at
            at += length
        assert at <= 2048
        used += at
        padded += at if at & (at - 1) == 0 else 2048
    assert used >= 0.98 * padded
