"""Queries that SQL can't express against plain Python over whole tables."""

import base64
import hashlib
import html as entities
import re
import statistics

import numpy as np
import pyarrow.parquet as pq
import pytest

from quillon.functions import text as T
from quillon.operators import answering as A
from quillon.operators import chunking as C
from quillon.plans import evaluation_queries, registry, text_queries
from quillon.sources.providers import stub_embedder

DIR = "/root/testdata/sf0.001"


def rows(spark, name):
    return registry.queries()[name](spark, DIR).collect()


def table(name):
    return pq.read_table(f"{DIR}/{name}.parquet").to_pylist()


def cleaned(text):
    """T.clean_text in plain Python, for texts without the ligatures and soft hyphens that it also handles."""
    text = re.sub(r"(\w)-\n(\w)", r"\1\2", text)
    text = re.sub(r"[ \t]*\n[ \t]*", "\n", text)
    parts = re.split(r"\n{2,}", text)
    return re.sub(r"[ \t]{2,}", " ", "\n\n".join(p.replace("\n", " ") for p in parts)).strip()


def test_display_clean(spark):
    docs = {d["doc_id"]: d["text"] for d in table("documents")}
    for r in rows(spark, "display_clean"):
        text = docs[r["doc_id"]] + " "
        text += " 1 2 3 4 5 6 7 x y z a b c d end"
        for pattern, by in T.DISPLAY:
            text = re.sub(pattern, by, text, flags=re.A)
        assert r["shown"] == text
    assert len(docs) == len(rows(spark, "display_clean"))


def test_page_segments(spark):
    blocks = {}
    for r in text_queries.blocks(spark, DIR).collect():
        blocks.setdefault(r["doc_id"], []).append((r["page"], r["block_no"], r["text"].strip()))
    want = {}
    for doc, own in blocks.items():
        own.sort()
        pages = sorted({p for p, _, _ in own})
        keys = {}
        for p, _, t in own:
            if len(t) < 100:
                keys.setdefault(re.sub("[0-9]+", "#", t.lower()), set()).add(p)
        repeated = {k for k, at in keys.items() if len(pages) >= 4 and len(at) >= 0.4 * len(pages)}
        kept = [(p, b, t) for p, b, t in own if re.sub("[0-9]+", "#", t.lower()) not in repeated and t and not re.fullmatch(r"[0-9\s–-]+", t)]
        late = pages[max(2, len(pages) // 3) :]  # all pages count, also those of which nothing is kept
        cut = next(((p, b) for p, b, t in kept if p in late and (re.fullmatch(r"(?i)([0-9]+\.?\s*)?(references|bibliography|literature cited)", t) or re.match(T.FIRST_REFERENCE, t))), None)
        section, run, found = None, 0, {}
        for p, b, t in kept:
            if cut and (p, b) >= cut:
                break
            bare = re.sub(r"[.:]+$", "", cleaned(t))
            if len(cleaned(t)) <= 80 and bare.lower() in T.HEADING_NAMES:
                section, run = bare, run + 1
            found.setdefault((p, run, section), []).append(t)
        want[doc] = [(n, p, section, cleaned("\n\n".join(ts))) for n, ((p, _, section), ts) in enumerate(found.items())]
    want = sorted((d, n, p, s or "", hashlib.md5(t.encode()).hexdigest()) for d, own in want.items() for n, p, s, t in own)
    got = sorted((r["doc_id"], r["seg_no"], r["page"], r["section"] or "", r["digest"]) for r in rows(spark, "page_segments"))
    assert got == want and len({s for _, _, _, s, _ in got}) >= 1


def test_html_blocks_and_sections(spark):
    """By a walk over the pages' own few tags."""
    pages = {p["page_id"]: p["html"] for p in table("pages")}
    got = {}
    for r in sorted(rows(spark, "html_blocks"), key=lambda r: (r["page_id"], r["seq"])):
        got.setdefault(r["page_id"], []).append((r["tag"], r["text"]))
    checked = 0
    for page, html in pages.items():
        body = re.sub(r"(?is)<(script|style|nav|header|footer|noscript)\b.*?</\1>", "", html)
        if re.search(r"(?i)<(li|td|blockquote)\b[^>]*>(?:(?!</\1).)*<(p|li|td|h[1-4]|pre|blockquote)\b", body, re.S):
            continue  # nested blocks, which the parser's own tests cover
        want = [(m[1].lower(), " ".join(entities.unescape(re.sub(r"(?s)<[^>]*>", "", m[2])).split())) for m in re.finditer(r"(?is)<(h[1-4]|p|pre|blockquote|li|td)\b[^>]*>(.*?)(?:</\1>|(?=<p[ >])|(?=</(?:article|div|body)>))", body)]  # a paragraph may lack its end
        assert got.get(page, []) == want
        checked += 1
    assert checked >= 0.5 * len(pages)
    sections = {}
    for r in rows(spark, "html_sections"):
        sections.setdefault(r["page_id"], []).append((r["seg_no"], r["section"], r["chars"]))
    assert set(sections) <= set(pages) and all(n > 0 for own in sections.values() for _, _, n in own)
    for page, blocks in got.items():
        section, run, held = None, 0, {}
        for tag, text in blocks:
            if tag in ("h1", "h2", "h3", "h4"):
                section, run = text[:80], run + 1
            elif len(text) >= 40 and page in sections and any(n == run and s == section for n, s, _ in sections[page]):
                held.setdefault(run, []).append(text)
        for n, s, chars in sections[page]:
            if n in held and s is not None:
                assert chars <= len("\n\n".join(held[n]))


def joined(spark):
    found = {}
    for r in text_queries.segments(spark, DIR).collect():
        found.setdefault(r["doc_id"], []).append((r["seg_no"], r["text"]))
    return {d: [t for _, t in sorted(own)] for d, own in found.items()}


def test_chunks_and_their_table(spark):
    docs = {d["doc_id"]: d for d in table("documents")}
    segments = joined(spark)
    want = {d: C.split_text("".join(t + "\n\n" for t in own)) for d, own in segments.items()}
    got = {}
    for r in rows(spark, "chunk_docs"):
        text = "".join(t + "\n\n" for t in segments[r["doc_id"]])
        assert r["n_tokens"] == C.count_tokens(text[r["start"] : r["end"]]) <= 600
        got.setdefault(r["doc_id"], []).append((r["chunk_index"], r["start"], r["end"]))
    assert {d: [(a, b) for _, a, b in sorted(own)] for d, own in got.items()} == {d: own for d, own in want.items() if own}
    assert all([i for i, _, _ in sorted(own)] == list(range(len(own))) for own in got.values())
    for d, own in got.items():  # nothing but white space lies outside the chunks
        text, at = "".join(t + "\n\n" for t in segments[d]), 0
        for _, a, b in sorted(own):
            assert not text[at:a].strip()
            at = max(at, b)
        assert not text[at:].strip()
    chunks = rows(spark, "chunk_table")
    assert len(chunks) == sum(map(len, want.values()))
    for r in chunks:
        d, text = docs[r["doc_id"]], "".join(t + "\n\n" for t in segments[r["doc_id"]])
        a, b = want[r["doc_id"]][r["chunk_index"]]
        assert r["id"] == f"{d['doc_id']}::{r['chunk_index']:04d}" and r["text"] == f"[{d['source']} ({1990 + d['doc_id'] % 30})]\n" + text[a:b]
        assert (r["title"], r["authors"], r["year"], r["era"], r["page"], r["section"]) == (d["source"], d["source"], 1990 + d["doc_id"] % 30, d["lang"], 0, "")


def test_ablation(spark):
    """Chunks with their headers, the five nearest by the stub embedding, and what these hold."""
    segments, docs = joined(spark), {d["doc_id"]: d for d in table("documents")}
    got = {r["variant"]: r for r in rows(spark, "chunk_ablation")}
    assert set(got) == {v[0] for v in C.VARIANTS}
    embed = stub_embedder()
    gold = {q["item_id"]: {i for i, d in docs.items() if q["text"] and d["text"] and q["text"] in d["text"]} for q in table("benchmark")}
    asked = {q["item_id"]: q["text"] for q in table("benchmark") if gold[q["item_id"]]}
    evidence = {}
    for q, text in asked.items():
        words = text.split(" ")
        start = max(1, len(words) // 2 - 2)
        evidence[q] = " ".join(words[start - 1 : start + 4]) if q % 4 != 3 else None
    for name, size, overlap, headed in C.VARIANTS:
        chunks = []
        for doc, own in segments.items():
            text = "".join(t + "\n\n" for t in own)
            header = f"[{docs[doc]['source']} ({1990 + doc % 30})]\n" if headed else ""
            chunks += [(doc * 1_000_000 + i, doc, header + text[a:b]) for i, (a, b) in enumerate(C.split_text(text, size, overlap))]
        sizes = [C.count_tokens(t) for _, _, t in chunks]
        r = got[name]
        assert (r["chunks"], r["tokens"], r["median_tokens"], r["max_tokens"]) == (len(chunks), sum(sizes), statistics.median(sizes), max(sizes))
        vectors, hit1, hit5, found, context, place = embed([t for _, _, t in chunks]), 0, 0, 0, [], None
        ids = np.array([c for c, _, _ in chunks])
        for q in sorted(asked):
            scores = np.round(vectors @ embed([asked[q]])[0], 9)
            order = np.lexsort((ids, -scores))
            top = [chunks[i] for i in order[:5]]
            hit1 += top[0][1] in gold[q]
            hit5 += any(d in gold[q] for _, d, _ in top)
            found += evidence[q] is not None and any(evidence[q] in t for _, _, t in top)
            context.append(sum(sizes[i] for i in order[:5]))
            if place is None and evidence[q] is not None:
                held = [i for i in order if chunks[i][1] in gold[q] and evidence[q] in chunks[i][2]]
                place = 1 + int((scores > scores[held[0]]).sum()) if held else 0
        assert (r["questions"], r["hit1"], r["hit5"]) == (len(asked), hit1, hit5)
        assert (r["evidence_hits"], r["evidence_n"]) == (found, sum(e is not None for e in evidence.values()))
        assert r["context_tokens"] == round(statistics.mean(context)) and (r["place"] or 0) == place
    assert got["600"]["tokens"] > got["600 bare"]["tokens"]


def test_answers(spark):
    questions = {q["item_id"]: q["text"] for q in table("benchmark")}
    hits = {}
    for r in evaluation_queries._hits(spark, DIR).collect():
        hits.setdefault(r["qid"], []).append(r)
    got = {r["qid"]: r for r in rows(spark, "answer_questions")}
    assert set(got) == set(questions)
    for q, text in questions.items():
        own = sorted(hits.get(q, []), key=lambda r: r["rank"])
        top = max((r["score"] / 40 for r in own), default=0.0)
        parts = []
        for r in own:
            where = (f", p.{r['page']}" if r["page"] else "") + (f", {r['section']}" if r["section"] else "")
            parts.append(f"[{r['rank']}] {r['title']} ({r['year']}){where}\n{r['text']}")
        even = len("\n\n".join(parts)) % 2 == 0
        route = "refuse:score_gate" if top < A.MIN_SCORE else "generate" if even else "refuse:evidence_check"
        assert got[q]["route"] == route and got[q]["top_score"] == pytest.approx(top)
        assert got[q]["answer"] == (f"{text[:20]} [1][2]" if route == "generate" else A.REFUSAL)
        assert got[q]["refused"] == (route != "generate") and got[q]["refusal_stage"] == route.removeprefix("refuse:") * (route != "generate")


def test_answers_read_whole_texts(spark, monkeypatch):
    monkeypatch.setattr(evaluation_queries, "stub_grader", lambda: lambda question, context: (True, ""))
    monkeypatch.setattr(evaluation_queries, "stub_writer", lambda: lambda question, context: context)
    docs = {d["doc_id"]: d["text"] for d in table("documents")}
    hits = {}
    for r in evaluation_queries._hits(spark, DIR).collect():
        assert r["text"] == docs[r["chunk_id"]]
        hits.setdefault(r["qid"], []).append(r)
    seen = 0
    for r in rows(spark, "answer_questions"):
        if r["route"] == "generate":
            entries = r["answer"]
            for h in sorted(hits[r["qid"]], key=lambda h: h["rank"]):
                head, _, entries = entries.partition("\n")
                text = docs[h["chunk_id"]]
                assert head.startswith(f"[{h['rank']}] ") and entries.startswith(text)
                entries = entries[len(text) :].removeprefix("\n\n")
            assert entries == ""
            seen += 1
    assert seen and max(len(docs[h["chunk_id"]]) for own in hits.values() for h in own) > 50


def test_pca(spark):
    import numpy as np

    x = np.array([r["embedding"] for r in table("embeddings")], dtype=float)
    ids = [r["vec_id"] for r in table("embeddings")]
    got = {r["vec_id"]: (r["x"], r["y"]) for r in rows(spark, "pca_2d")}
    _, _, axes = np.linalg.svd(x - x.mean(axis=0), full_matrices=False)
    want = (x - x.mean(axis=0)) @ axes[:2].T
    mine = np.array([got[i] for i in ids])
    for c in (0, 1):  # up to the sign
        assert min(np.abs(mine[:, c] - want[:, c]).max(), np.abs(mine[:, c] + want[:, c]).max()) < 1e-6


def test_packed_vectors_decode(spark):
    import numpy as np

    for r in rows(spark, "packed_vectors")[:20]:
        codes = np.frombuffer(base64.b64decode(r["packed"]), dtype=np.int8)
        assert len(codes) == 64 and abs(int(np.abs(codes.astype(int)).max())) == 127
