"""Main content of pages: by a plain search of the tree, and on the given pages."""

import random
import re
import xml.etree.ElementTree as ET

import pyarrow.parquet as pq

from quillon.operators import sections as S

DIR = "/root/testdata/sf0.001"


def made(rng, depth=0):
    """A random well-formed element with text, links and inline marks."""
    tag = rng.choice(["div", "section", "ul", "article", "table"]) if depth < 3 else "h2"
    words = lambda n: " ".join(rng.choice(["alpha", "be", "gamma", "x", "delta"]) for _ in range(n))
    out = [f"<{tag}>"]
    for _ in range(rng.randrange(1, 5)):
        kind = rng.randrange(4)
        if kind == 0 and depth < 3:
            out.append(made(rng, depth + 1))
        elif kind == 1:
            out.append(f"<div>{words(rng.randrange(1, 25))}</div>")
        elif kind == 2:
            out.append(f"<div><a>{words(rng.randrange(1, 6))}</a> {words(rng.randrange(3))} <b>{words(2)}</b></div>")
        else:
            out.append(words(rng.randrange(0, 12)))
    return "".join(out) + f"</{tag}>"


def brute(html):
    """The pieces of the best element, elements in document order, by summing each one's whole text anew."""
    pieces, order = {}, []

    def walk(element, path):
        order.append(path)
        pieces[path], text, links, n = [], [], 0, 0

        def close():
            nonlocal text, links
            whole = " ".join("".join(text).split())
            if whole:
                pieces[path].append((whole, len(whole) - 2 * min(links, len(whole)) - S._Tree.PIECE_COST))
            text, links = [], 0

        text.append(element.text or "")
        for child in element:
            if child.tag in ("a", "b"):
                text.append(child.text or "")
                links += len("".join((child.text or "").split())) if child.tag == "a" else 0
            else:
                close()
                seq.append((path, len(pieces[path])))
                walk(child, (*path, n))
                n += 1
            text.append(child.tail or "")
        close()

    seq = []
    walk(ET.fromstring(f"<html>{html}</html>"), ())
    worth = {p: sum(w for q in order if q[: len(p)] == p for _, w in pieces[q]) for p in order}
    best = max(order, key=lambda p: (worth[p], order.index(p)))
    return sorted(t for q in order if q[: len(best)] == best for t, _ in pieces[q]) if worth[best] > 0 else []


def test_random_trees():
    rng, some = random.Random(12), 0
    for _ in range(300):
        html = made(rng)
        got = S.main_content(html)
        assert sorted(got.split("\n\n") if got else []) == brute(html)
        some += bool(got)
    assert some > 100


def test_odd_pages():
    assert S.main_content(None) == S.main_content("") == S.main_content("<p>short</p>") == ""
    long = "A long enough line of plain text, all by itself."
    assert S.main_content(long) == long
    assert S.main_content(f"<div><nav>{long}{long}</nav><p>{long}<br>{long}<p>{long}</div><footer>{long * 9}</footer>") == f"{long} {long}\n\n{long}"
    assert S.main_content(f"<ul><li><a href=x>{long}</a><li><a>{long}</a></ul><div>{long}") == long
    assert S.main_content("</div></p>" * 3 + f"<b>{long}") == long


def test_pages_lose_their_trimmings(spark):
    pages = pq.read_table(f"{DIR}/pages.parquet").to_pylist()
    got = {r["page_id"]: r["whole"] for r in S.main_texts(spark.read.parquet(f"{DIR}/pages.parquet")).collect()}
    assert set(got) == {p["page_id"] for p in pages}
    kept = 0
    for p in pages:
        footer = " ".join(re.sub(r"<[^>]*>", "", re.search(r"(?s)<footer>(.*?)</footer>", p["html"])[1]).split())
        assert "©" not in got[p["page_id"]] and footer not in got[p["page_id"]] and "track(" not in got[p["page_id"]]
        kept += len(got[p["page_id"]]) > 0
    assert kept > 0.8 * len(pages)
