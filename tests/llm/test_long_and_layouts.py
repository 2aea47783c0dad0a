"""Main text on many layouts and hostile pages; secrets against an independent scan, and in long texts."""

from __future__ import annotations

import random
import re
import time

import pytest
from pyspark.sql import functions as F

from tallywind.llm import main_text, secrets

R = random.Random(5)
WORDS = "river stone walked green table seven light harbour quiet morning".split()


def paragraph(n):
    return " ".join(R.choice(WORDS) for _ in range(n)).capitalize() + "."


TEXT = [paragraph(R.choice([4, 12, 40, 90, 7])) for _ in range(20)]
NAV = "<nav><ul>" + "".join(f"<li><a href=/{i}>{w}</a></li>" for i, w in enumerate(WORDS)) + "</ul></nav>"
SMALL = [" ".join(R.choice(WORDS) for _ in range(R.randrange(2, 6))) for _ in range(5000)]


def each(form):
    return "".join(form.format(p) for p in TEXT)


LAYOUTS = {
    "divs": (each("<div><p>{}</p></div>"), TEXT),
    "few divs": ("".join(f"<div><p>{p}</p></div>" for p in TEXT[:3]), TEXT[:3]),
    "paragraphs": (each("<p>{}</p>"), TEXT),
    "unclosed paragraphs": (each("<p>{}"), TEXT),
    "sections": ("<h1>Head line</h1>" + each("<section><h2>Part</h2><p>{}</p></section>"), ["Head line", *[x for p in TEXT for x in ("Part", p)]]),
    "articles": (each("<article><p>{}</p></article>"), TEXT),
    "table": ("<table><tr><td>" + each("<p>{}</p>") + "</td></tr></table>", TEXT),
    "deep": ("<div>" * 300 + each("<p>{}</p>") + "</div>" * 300, TEXT),
    "small divs": ("".join(f"<div>{w}</div>" for w in SMALL), SMALL),
    "sections of a post": (
        f"<div class=page><div class=top>Site name</div><div class=post-body><div><p>{TEXT[2] * 3}</p></div><div><h2>Section</h2><p>Short para.</p></div></div></div>",
        [TEXT[2] * 3, "Section", "Short para."],
    ),
    "wrapper": ("<div class=has-sidebar><article>" + each("<p>{}</p>") + "</article></div>", TEXT),
    "beside an article": (
        "<article><h1>Title</h1>" + each("<p>{}</p>") + "</article><div class=sidebar><p>Side.</p></div><article class=comment><p>I like it.</p></article>",
        ["Title", *TEXT],
    ),
    "menu without a mark": ("<div><ul>" + "".join(f"<li><a href=x>{w} {w}</a></li>" for w in WORDS) + "</ul></div><div>" + each("<p>{}</p>") + "</div>", TEXT),
}


@pytest.mark.parametrize("name", LAYOUTS)
def test_layouts(name):
    body, want = LAYOUTS[name]
    page = f"<html><head><title>T</title></head><body>{NAV}{body}<footer><p>Copyright by nobody.</p></footer></body></html>"
    assert main_text.main_text(page) == " ".join(want)


@pytest.mark.parametrize("page", [
    "<div>word " * 20000, "<div>" * 20000 + "x" + "</b></p></span>" * 20000, "<b>w " * 20000 + "<p>x" * 20000, "<ul><li>x" * 20000,
    "<div>" * 20000 + "</section>" * 20000,
])
def test_hostile_pages_take_linear_time(page):
    start = time.time()
    main_text.main_text(page)
    assert time.time() - start < 8


def test_pages_repeated_null_and_clashing(spark):
    page = "<p>" + TEXT[2] + "</p>"
    rows = [(1, "u", page, "t"), (1, "u", page, "t"), (None, None, None, None), (2, "u", "", "t")]
    df = spark.createDataFrame(rows, "page_id bigint, url string, html string, text string")
    got = sorted((r.page_id or 0, r.text, r.n_chars) for r in main_text.extract(df).collect())
    assert got == [(0, "", 0), (1, TEXT[2], len(TEXT[2])), (1, TEXT[2], len(TEXT[2])), (2, "", 0)]


# Secrets -----------------------------------------------------------------------------------------


def either(words):
    return "|".join("".join(f"[{c}{c.upper()}]" if c.isalpha() else c for c in w) for w in words)


ASSIGN = re.compile(f"(?:{either(['password', 'passwd', 'secret', 'token'])}|{either(['api'])}_?{either(['key'])})[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)")


def base_spans(text):
    found = [(m.start(), 0, m.end()) for m in ASSIGN.finditer(text) if len(m[1]) >= 8]
    found += [(m.start(), 1, m.end()) for m in re.finditer("AKIA[A-Z0-9]+", text) if len(m[0]) >= 16]
    return sorted(found + [(m.start(), 2, m.end()) for m in re.finditer("[0-9a-f]+", text) if len(m[0]) >= 32])


PIECES = (
    "password passwd Secret token api_key APIKEY = : ' \" AKIA ABCDEFGHIJKLMNOP 0123456789abcdef0123456789abcdef é 漢 \n ghp_abcdefghij1234567890"
    " Zz9Yy8Xx7Ww6Vv5Uu4Tt3Ss2Rr1 x-y_z. =="
).split(" ")


def secret_rows():
    r = random.Random(3)
    texts = ["".join(r.choice(PIECES) + r.choice(["", " ", ""]) for _ in range(r.randrange(0, 120))) for _ in range(150)]
    texts += [None, "", "a", " ".join(f"token=abcdefgh{i}" for i in range(700))]
    rows = [(i, t, f"s{i % 7}", 1) for i, t in enumerate(texts)]
    return [*rows, rows[0], rows[1]]


def test_secrets_match_an_independent_scan(spark):
    rows = secret_rows()
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, row int")
    scanned = secrets.scan(df, ["doc_id", "text"]).collect()
    assert sorted(r.doc_id for r in scanned) == sorted(r[0] for r in rows)
    live = {}
    for r in scanned:
        assert [(s.start, s.kind, s.end) for s in r.base] == base_spans(r.text or "")
        assert {(s.start, s.kind, s.end) for s in r.base} <= {(s.start, s.kind, s.end) for s in r.all_spans}
        extra = [s for s in r.all_spans if s.kind > 2]
        assert not any(e.start < s.end and s.start < e.end for e in extra for s in r.base)
        live[r.doc_id] = sorted((s.start, s.end) for s in r.all_spans if s.live)
    redacted = secrets.redact(df)
    assert redacted.columns == df.columns
    for r in redacted.collect():
        text, out, at, cuts = rows[r.doc_id][1], "", 0, []
        for a, b in live[r.doc_id]:
            if cuts and a <= cuts[-1][1]:
                cuts[-1][1] = max(b, cuts[-1][1])
            else:
                cuts.append([a, b])
        for a, b in cuts:
            out, at = out + text[at:a] + "[SECRET]", b
        assert r.text == (None if text is None else out + text[at:])


def test_secrets_verdict_uses_owners_and_repositories(spark):
    rows = [(i, "token=onerepo1", "a", 1) for i in (1, 1, 1)] + [(10 + i, "token=everyone1", f"o{i}", 1) for i in range(5)]
    rows += [(100 + i, "token=template1", "a", 1) for i in range(100)] + [(300 + i, "token=fewrepos1", None, 1) for i in range(99)]
    df = spark.createDataFrame(rows, "doc_id bigint, text string, source string, row int")
    found = {r.text[6:]: {s.live for s in r.all_spans} for r in secrets.scan(df, ["text"]).collect()}
    assert found == {"onerepo1": {True}, "everyone1": {False}, "template1": {False}, "fewrepos1": {True}}


def test_secrets_in_a_long_text(spark):
    text = "\n".join(f"token = Ab1c9defgh{i:07d} é" for i in range(20000))
    df = spark.createDataFrame([(1, text, "s")], "doc_id bigint, text string, source string")
    start = time.time()
    (r,) = secrets.redact(df).collect()
    assert r.text == "\n".join("[SECRET] é" for _ in range(20000))
    assert secrets.scan(df, ["doc_id"]).select(F.size("base")).first()[0] == 20000
    assert time.time() - start < 90
