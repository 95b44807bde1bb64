"""Operators that work row by row, against plain code."""

import hashlib
import re
import time

import pytest
from compare import compare
from llm.cases import ROWS, clashing, documents

from driftspark.llm import decontaminate, html_text, pii, quality_rules
from driftspark.llm.registry import ORACLES, QUERIES

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def plain_base(text):
    ws, text = WORD.findall(text or ""), text or ""
    wins = [tuple(ws[i:i + 3]) for i in range(len(ws) - 2)]
    count = {}
    for w in wins:
        count[w] = count.get(w, 0) + 1
    repeat = {j for i, w in enumerate(wins) if count[w] > 1 for j in (i, i + 1, i + 2)}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return (len(ws), sum(map(len, ws)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeat))


def test_quality_base_figures(spark):
    out = quality_rules.clean(clashing(documents(spark), ["kept", "n_words", "clean_text"]))
    assert out.columns[:6] == ["doc_id", "text", "lang", "source", "n_chars", "odd. name`s"]
    got = sorted(map(repr, out.select("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()))
    want = [plain_base(r[1]) for r in ROWS]
    assert sorted((r[0], r[1], r[2], r[3], r[4]) for r in out.select(
        "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words").collect()) == sorted(want), got
    kept = {r["doc_id"]: r["kept"] for r in out.collect()}
    assert kept[4] is True and kept[2] is False and kept[9] is False


def test_quality_when_hashes_collide(spark, monkeypatch):
    """Windows that share the sorted bits are told apart by their words."""
    from pyspark.sql import functions as F

    monkeypatch.setattr(quality_rules.F, "xxhash64", lambda *c: F.lit(5).cast("long"))
    rows = [(i, t, "en", "a", 1) for i, t in enumerate(["a b c d a b c e", "a b c d e f g", "x y z x y z x y z", "a b a b a"])]
    out = quality_rules.clean(documents(spark, rows)).select("doc_id", "n_repeat_words").collect()
    assert {r[0]: r[1] for r in out} == {i: plain_base(r[1])[4] for i, r in enumerate(rows)}


def test_quality_rules_by_line(spark):
    text = "\n".join(["The river ran past the old mill and the town slept on.", "Home | News | Sport | Weather | About", "read more",
                      "*** $$$ ### buy now ***", "All rights reserved by the owner of this site.", "Page 3 of 9"] + ["It was a long day for all."] * 12)
    r = quality_rules.clean(documents(spark, [(1, text, "en", "a", 1)])).first()
    assert (r["n_punctuation"], r["n_navigation"], r["n_boilerplate"]) == (2, 2, 1)
    assert r["clean_text"].startswith("The river") and "Home" not in r["clean_text"]


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_equals_sql(spark, sf, name):
    assert compare(QUERIES[name](spark, sf), ORACLES[name], sf) is None


BASE = {"email": re.compile(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+"), "ip": re.compile(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)"),
        "card": re.compile(r"[0-9]([\x20-]?[0-9])+"), "phone": re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")}


def plain_spans(text):
    out = []
    for order, (kind, pattern) in enumerate(BASE.items()):
        for m in pattern.finditer(text or ""):
            digits = re.sub("[^0-9]", "", m[0])
            luhn = sum(int(d) if k % 2 == 0 else sum(divmod(2 * int(d), 10)) for k, d in enumerate(digits[::-1])) % 10 == 0
            if {"email": True, "ip": kind == "ip" and all(int(p) <= 255 for p in m[0].split(".")),
                    "card": 12 <= len(digits) <= 19 and luhn, "phone": 9 <= len(digits) <= 15}[kind]:
                out.append((m.start(), order, f"{kind}:{m.start()}:{m.end()}"))
    return ",".join(x[2] for x in sorted(out))


HARD = ["a@b.c_d@e.fg x..y@z-1.com@q.rs", "1.2.3.4.5.6.7.8 256.1.1.1 01.002.3.4", "4111 1111 1111 1111 4111-1111-1111-1112 0000000000000",
        "+1 (499) 555-6503 +12 3 +123456789012345678 +1((2", "@@@ a@ @b.c ü@x.yz 😀 a+b%c@d.ef.", "9" * 400 + "." + "9" * 400, "1 2 3 4 5 6 7 8 9 0 1 2 3",
        "5500-0000 0000 0004 in text 1.1.1.1.", "DE89 3704 0044 0532 0130 00 AND my iban DE89370400440532013000, GB82WEST12345698765432 ssn 123-45-6789"]


def test_pii_base_spans_follow_the_patterns():
    for text in [*HARD, *(r[1] for r in ROWS), " ".join(HARD) * 3]:
        assert pii.digest([{"kind": k, "start": s, "end": e} for k, s, e, _ in pii.find(text) if k in BASE]) == plain_spans(text)


def test_pii_adds_confirmed_kinds():
    kinds = [x[0] for x in pii.find(HARD[-1])]
    assert kinds.count("iban") == 3 and "ssn" in kinds
    assert not [x for x in pii.find("DE89370400440532013001 and order 123-45-6789")]


def test_pii_iban_lists():
    """IBANs with single spaces between them, after code-like tokens, and of further countries."""
    many = ["DE89370400440532013000", "GB82WEST12345698765432", "NO9386011117947", "DE89 3704 0044 0532 0130 00", "UA213223130000026007233566001",
            "RS35260005601001611379", "BA391290079401028494", "BR1800360305000010009795493C1", "KZ86125KZT5004100100", "TN5910006035183598478831",
            "PK36SCBL0000001123456702", "QA58DOHB00001234567890ABCDEFG", "KW81CBKU0000000000001234560101", "EG380019000500000000263180002",
            "XK051212012345678906", "LC55HEMM000100010012001200023015"]
    text = " ".join(["AB12 CODE 5577 XYZQ", *many, "ZZ99ABCD", many[0], "DE89370400440532013001", many[1]])
    assert [text[s:e] for k, s, e, _ in pii.find(text) if k == "iban"] == [*many, many[0], many[1]]


def test_pii_ibans_are_linear():
    for text in ("DE89 " * 60_000, "DE89370400440532013000 " * 12_000, "AA11" * 75_000):
        pii.find(text)


def test_pii_rows(spark):
    df = documents(spark, [(i, t, "en", "a", 1) for i, t in enumerate(HARD)] + ROWS)
    out = pii.scan(clashing(df, ["pii"]))
    assert out.count() == len(HARD) + len(ROWS) and "odd. name`s" in out.columns
    assert pii.scan(documents(spark, [])).count() == 0


def test_pii_is_linear():
    for text in ("a" * 300_000, "1." * 150_000, "+1" * 150_000, "a@" * 150_000, "9" * 300_000, "+" + "1(" * 150_000):
        pii.find(text)


def test_pii_query_digest(spark, sf):
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    for r in QUERIES["op5_pii"](spark, sf).collect():
        want = plain_spans(texts[r["doc_id"]])
        assert r["base_sha256"] == hashlib.sha256(want.encode()).hexdigest()
        assert set(filter(None, want.split(","))) <= set(r["spans"].split(","))


def plain_overlap(text, items):
    words = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
    ws, hit, who = words(text), set(), set()
    for item, t in items:
        bs = words(t)
        for i in range(max(1, len(bs) - 12) if bs else 0):
            win = bs[i:i + 13]
            for k in range(len(ws) - len(win) + 1):
                if ws[k:k + len(win)] == win:
                    hit |= set(range(k, k + len(win)))
                    who.add(item)
    return len(ws), len(hit), sorted(str(x) for x in who if x is not None)


ITEMS = [(1, " ".join(f"w{i}" for i in range(20))), (10, "Short Item, two"), (2, None), (3, "!!!"), (None, "hidden item"), (4, "w3 w4 w5"),
         (10, "Short item: two"), (5, "naïve 漢字 test")]


@pytest.mark.parametrize("max_bytes", [1 << 20, 40])
def test_overlap(spark, max_bytes):
    text = " ".join(f"W{i}," for i in range(2, 18))
    rows = [(100, text, "en", "a", 1), (101, "x SHORT item two y hidden item z", "en", "a", 1), (102, "a naïve-漢字 test", "en", "a", 1)] + ROWS
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    out = decontaminate.find_overlap(clashing(documents(spark, rows), ["items", "hit_runs", "n_hit"]), bench, max_bytes=max_bytes)
    got = sorted((r["n_words"], r["n_hit"], list(r["items"])) for r in out.collect())
    assert got == sorted(plain_overlap(r[1], ITEMS) for r in rows)
    r = next(r for r in out.collect() if r["doc_id"] == 102)
    assert [rows[2][1][s["start"]:s["end"]] for s in r["hit_spans"]] == ["naïve-漢字 test"]


def test_overlap_segments_hold_every_window_once(monkeypatch):
    monkeypatch.setattr(decontaminate, "SEGMENT", 20)
    for n in (0, 1, 12, 13, 19, 20, 21, 27, 28, 29, 100):
        ws = [f"w{i}" for i in range(n)]
        cut = [s.split() for s in decontaminate.segments(" ".join(ws))]
        assert all(len(c) <= 20 for c in cut)
        got = [c[i:i + 13] for c in cut for i in range(max(len(c) - 12, 1))]
        assert got == [ws[i:i + 13] for i in range(max(n - 12, 1) if n else 0)]


def test_overlap_of_copies_in_parts(spark, monkeypatch):
    """A text under thousands of ids, and one longer than a part."""
    monkeypatch.setattr(decontaminate, "SEGMENT", 20)
    text, long = " ".join(f"c{i}" for i in range(30)), " ".join(f"L{i}" for i in range(300))
    items = [(i, text) for i in range(2000)] + [(5000, long), (5001, "c1 c2 c3"), (None, "L7 L8"), (None, long)]
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = [(1, "x " + text, "en", "a", 1), (2, long, "en", "a", 1), (3, "L7 L8 y", "en", "a", 1), (3, "L7 L8 y", "en", "a", 1), (None, "c1 c2 c3", "en", "a", 1)] + ROWS
    docs = documents(spark, rows)
    once = decontaminate.find_overlap(docs, bench)
    in_parts = decontaminate.find_overlap(docs, bench, max_bytes=500)
    assert once.columns == in_parts.columns and once.schema.simpleString() == in_parts.schema.simpleString()
    key = lambda r: (r["doc_id"] is None, r["doc_id"] or 0, r["text"] or "", repr(r))
    got = sorted(in_parts.collect(), key=key)
    assert got == sorted(once.collect(), key=key)
    by_id = {r["doc_id"]: r for r in got}
    assert len(by_id[1]["items"]) == 2001 and by_id[2]["n_hit"] == 300 and by_id[2]["items"] == ["5000"]
    assert (by_id[3]["n_hit"], by_id[3]["items"]) == (2, [])


def test_overlap_spans_of_many_runs():
    text = " ".join(f"wörd{i}\U0001f600 -" for i in range(40_000))
    runs = [[i, i + 2] for i in range(0, 39_990, 5)]
    start = time.perf_counter()
    spans = decontaminate.char_spans(text, runs)
    assert time.perf_counter() - start < 5
    assert all(text[s["start"]:s["end"]].startswith(f"wörd{a} "[:-1]) and text[s["start"]:s["end"]].split()[0::2] == [
        f"wörd{k}\U0001f600" for k in range(a, b)] for s, (a, b) in zip(spans, runs))
    assert len(spans) == len(runs)


def test_overlap_empty(spark):
    bench = spark.createDataFrame([], "item_id long, text string")
    assert not decontaminate.find_overlap(documents(spark), bench).where("n_hit > 0 or contaminated").count()
    assert decontaminate.find_overlap(documents(spark, []), spark.createDataFrame(ITEMS, "item_id long, text string")).count() == 0


def test_overlap_query(spark, sf):
    items = [tuple(r) for r in spark.read.parquet(f"{sf}/benchmark.parquet").select("item_id", "text").collect()]
    texts = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()}
    # documents that share any three words in a row with an item need the slow look
    out = {r["doc_id"]: r for r in QUERIES["op10_decontaminate"](spark, sf).collect()}
    assert set(out) == set(texts) and any(r["contaminated"] for r in out.values())
    for k in sorted(texts)[::7] + [k for k, r in out.items() if r["n_hit"]][:20]:
        n, hit, who = plain_overlap(texts[k], items)
        r = out[k]
        assert (r["n_words"], r["n_hit"], r["n_items"]) == (n, hit, len(who))
        assert r["items_sha256"] == hashlib.sha256(",".join(who).encode()).hexdigest()
        assert r["contaminated"] == (hit > 0 and 20 * hit >= n)


ARTICLE = ["The mill stood by the river and it was old, but the people of the town were proud of it and they kept it well for all to see.",
           "In the spring the water was high & the wheel of the mill turned all day, as it had done for more than a hundred years there."]
PAGE = f"""<!DOCTYPE html><html><head><title>T</title><style>p{{}}</style><script>var a = "</p><p>no";</script></head><body class="with-sidebar">
<header><h1>Site name</h1></header><nav><ul><li><a href=/>Home</a><li><a href="/x>y">News</a></ul></nav><!-- <p>hidden</p> -->
<div class="cookie-notice">We use cookies on this site, so that it works well for you and for all of the people who are here.</div>
<article><h2>The mill</h2><p>{ARTICLE[0]}<p>{ARTICLE[1].replace('&', '&amp;')}<br>Short&nbsp;line.</p>
<aside>See also the list of the other mills in the land.</aside><form><p>Sign up for the letter</p></form></article>
<div id="comments"><article class="comment"><p>I like the mill and it is the best of all the mills that I have seen in the whole of my life.</p></article></div>
<footer>&copy; the owner</footer>"""


def test_html_main_text():
    assert html_text.main_text(PAGE) == "The mill\n" + ARTICLE[0] + "\n" + ARTICLE[1] + " Short line."


def test_html_without_article():
    page = PAGE.replace("<article>", "<div>").replace("</article>", "</div>", 1)
    got = html_text.main_text(page)
    assert ARTICLE[0] in got and ARTICLE[1] in got and "cookies" not in got and "I like" not in got and "Home" not in got


BODY = "<h2>The mill</h2>" + "".join(f"<p>{x} {x}</p>" for x in (a.replace("&", "and") for a in ARTICLE))
MENU = '<nav><a href="/">Home</a></nav><div class="cookie-notice">We use cookies on this site, so that it works well for you and for all of us.</div>'
COMMENT = '<div id="comments"><div class="comment">I like the mill and it is the best of all the mills that I have seen in my life.</div></div>'


@pytest.mark.parametrize("page", [
    f"<body>{MENU}<div class='widget Blog'><div class='post'>{BODY}</div></div>{COMMENT}",  # Blogspot
    f"<body>{MENU}<div class='elementor-widget-container'>{BODY}</div>{COMMENT}",
    f"<body><div class='sidebar-right'>{MENU}<main>{BODY}</main>{COMMENT}</div>",
    f"<body><div id=page class='left-sidebar'>{MENU}<div>{BODY}</div>{COMMENT}</div>",
    f"<body><div class='widget'><article>{BODY}</article></div>{COMMENT}",
    f"<body><main><div class='widget Blog'><article>{BODY}</article></div></main>{COMMENT}",
    f"<body><form action=x.aspx>{MENU}<div>{BODY}</div>{COMMENT}</form>",  # WebForms
    f"<body><form class='comments-open'>{MENU.replace(' and for all of us', '')}<article>{BODY}</article></form>",
])
def test_html_wrapped_pages(page):
    """A hint or form on what holds the page does not lose the article."""
    got = html_text.main_text(page)
    assert all(a.replace("&", "and") in got for a in ARTICLE) and "The mill" in got
    assert "cookies" not in got and "I like" not in got and "Home" not in got


def test_html_hints_beside_an_article():
    cards = "<div class='related'>" + f"<article><p>{ARTICLE[1]}</p></article>" * 2 + "</div>"
    got = html_text.main_text(f"<body><article>{BODY}</article>{cards}<form><p>Sign up here and get the letter of the mill for all of the year.</p></form>")
    assert got.count("In the spring") == 2 and "Sign up" not in got


def test_html_inline_hints_do_not_cut_a_block():
    half = ARTICLE[0].replace(" and it was old", ' <span class="share">tweet</span> and it was old')
    assert html_text.main_text(PAGE.replace(ARTICLE[0], half)) == html_text.main_text(PAGE)


def test_html_holders_are_linear():
    for page in ("<div class=widget>" * 20_000 + "<p>words of it all</p>" * 20_000, "<form><article class=ad>a" * 20_000):
        html_text.main_text(page)


@pytest.mark.parametrize("page", ["<b>{}</i>", "<b>x<hr>", '<a href="x">y</a> ', "<p>a", "<ul><li>a", "<table><tr><td>a", "<div class='widget'><b>a"])
def test_html_time_grows_with_the_page(page):
    def seconds(n):
        head, _, tail = page.partition("{}")
        text = head * n + tail * n
        start = time.perf_counter()
        html_text.main_text(text)
        return time.perf_counter() - start

    seconds(100)
    assert seconds(24_000) < 8 * max(seconds(6_000), 0.05)


@pytest.mark.parametrize("page", [None, "", "plain words only", "<", "<p", "<p>a<!-- open", "<a href='x>y", "</>", "<script>never closed", "&#xZZ; &bogus;",
                                  "<p>" * 20_000 + "deep", "<a title=\"" * 20_000, "<div class='x'>" * 5_000, "< 3 and > 2", "\x00<p>\x00"])
def test_html_odd_pages(page):
    assert isinstance(html_text.main_text(page), str)


def test_html_rows(spark):
    pages = spark.createDataFrame([(1, "u", PAGE), (1, "u", PAGE), (None, None, None), (2, "v", "")], "page_id long, url string, html string")
    out = html_text.extract(clashing(pages, ["text"]))
    assert [r["text"] == "" for r in out.collect()] == [False, False, True, True]
    assert html_text.extract(pages.limit(0)).count() == 0


def test_html_query(spark, sf):
    html = {r[0]: r[1] for r in spark.read.parquet(f"{sf}/pages.parquet").select("page_id", "html").collect()}
    for r in QUERIES["op9_html_text"](spark, sf).collect():
        article = re.search(r"<article>(.*)</article>", html[r["page_id"]], re.S)[1]
        want = [" ".join(__import__("html").unescape(re.sub(r"<[^>]*>", " ", x)).split()) for x in re.split(r"</?(?:p|h1)>", article)]
        assert r["text"].split("\n") == [w for w in want if w] and r["n_chars"] == len(r["text"])
