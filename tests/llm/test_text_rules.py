"""Chat formatting, quality, personal data and pages against plain Python."""

from __future__ import annotations

import hashlib
import re

import numpy as np
from conftest_llm import AWKWARD, plain
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from brightloom.llm import chat, hostpaths, pii, quality

TURNS = [
    (1, 0, "user", r"a\b \\c \; [INST] x [/INST] [OUT] y </s>"), (1, 1, "assistant", r"</s>[INST] ok [/INST]\;\\"), (1, 2, "we[/ROLE]ird", "t [/TURN] x"), (1, 3, None, None), (1, None, "system", "<<SYS>> <</SYS>>\n\n"),
    (2, 0, "assistant", "<"), (2, 1, "user", "[/INST"), (3, 0, "assistant", ""), (None, 0, "user", "é🎉"), (4, 0, "assistant", "é🎉 </s"), (4, 0, "assistant", "é🎉 </s"), (5, 0, "user", "\\" * 7 + ";" + "$1 " * 9), (-7, 0, "user", "</s>[INST] ok [/INST]"), (-7, 1, "assistant", "</s>[INST] ok [/INST]"),
]


def test_chat_round_trip(spark):
    df = spark.createDataFrame(TURNS, "conv_id long, turn long, role string, text string").withColumn("formatted", F.lit(1)).withColumn("plain", F.lit(2))
    rows = {r.conv_id: r for r in chat.format_conversations(df).collect()}
    digests = {r.conv_id: r for r in chat.chat_digests(df).collect()}
    for conv in {t[0] for t in TURNS}:
        own = sorted([t for t in TURNS if t[0] == conv], key=lambda t: (t[1] is not None, t[1] or 0, t[2] or "", t[3] or ""))
        turns = [(t[2] or "", t[3] or "") for t in own]
        r, d = rows[conv], digests[conv]
        assert [(p.role, p.text) for p in r.parsed] == turns
        assert d.turns_sha256 == hashlib.sha256("".join(f"{a}\n{b}\n" for a, b in turns).encode()).hexdigest()
        loss = [b for a, b in turns if a == "assistant"]
        assert (d.n_turns, d.loss_chars, d.formatted_chars) == (len(turns), len("".join(loss)), len(r.formatted))
        assert d.loss_sha256 == hashlib.sha256("".join(loss).encode()).hexdigest()
        masked = [re.sub(r"\\(?:(\\)|;)", lambda m: m[1] or "", r.formatted[s.start : s.start + s.length]) for s in r.loss_spans]
        assert masked == loss
    shown = rows[-7].formatted
    assert sum(shown.count(c) for c in chat.CONTROL) == 5  # the template's own marks only
    assert chat.chat_digests(df.limit(0)).count() == 0


def plain_repeats(symbols, width):
    """Where ``width`` symbols recur, and the longest repeat from there on, by comparing all pairs."""
    best = {}
    for i in range(len(symbols)):
        for j in range(len(symbols)):
            k = 0
            while i != j and max(i, j) + k < len(symbols) and symbols[i + k] == symbols[j + k]:
                k += 1
            if k >= width:
                best[i] = max(best.get(i, 0), k)
    return best


@given(st.lists(st.lists(st.integers(0, 2), max_size=24), min_size=1, max_size=5), st.integers(1, 4))
@settings(max_examples=300, deadline=None)
def test_repeats(docs, width):
    symbols, counts = np.array([w for d in docs for w in d], np.int64), np.array([len(d) for d in docs])
    borders, ends = quality._ends(counts)
    places, classes = quality.recurring(symbols, ends, width)
    want = [plain_repeats(d, width) for d in docs]
    assert places.tolist() == [int(borders[k]) + i for k, best in enumerate(want) for i in sorted(best)]
    owner = np.repeat(np.arange(len(docs)), counts)
    for i, a in zip(places.tolist(), classes.tolist(), strict=True):
        for j, b in zip(places.tolist(), classes.tolist(), strict=True):
            assert (a == b) == (owner[i] == owner[j] and symbols[i : i + width].tolist() == symbols[j : j + width].tolist())
    found = quality.longest(places, classes, owner, width).tolist()
    assert (found + [0] * len(docs))[: len(docs)] == [max(best.values(), default=0) for best in want]


def test_texts_of_equal_hash_are_told_apart(monkeypatch):
    """With a base that makes all windows of equal sums collide, the symbols themselves decide."""
    monkeypatch.setattr(quality, "BASE", 1)
    monkeypatch.setattr(quality, "INVERSE", 1)
    symbols = np.array([1, 2, 3, 3, 2, 1, 2, 2, 2, 1, 2, 3, 2, 1, 3], np.int64)
    places, classes = quality.recurring(symbols, np.full(len(symbols), len(symbols)), 3)
    groups = {}
    for p, c in zip(places.tolist(), classes.tolist(), strict=True):
        groups.setdefault(c, []).append(symbols[p : p + 3].tolist())
    assert sorted(plain_repeats(symbols.tolist(), 3)) == places.tolist() and all(g.count(g[0]) == len(g) for g in groups.values())


def plain_quality(text):
    text = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    windows = {}
    for i in range(len(words) - 4):
        windows.setdefault(tuple(words[i : i + 5]), []).append(i)
    repeated = {i + k for at in windows.values() if len(at) > 1 for i in at for k in range(5)}
    lines = [x for x in text.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    failed = len(words) < 10 or 100 * len(repeated) > 20 * len(words)
    return (len(words), sum(map(len, words)), len(re.findall(r"[#*$%&|<>]", text)), len(lines) - len(set(lines)), len(repeated), failed)


def plain_verdict(text):
    """Covered share and longest repeat in characters, by comparing places of equal beginnings."""
    symbols = "".join(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    places, covered, longest = {}, set(), 0
    for i in range(len(symbols) - 29):
        places.setdefault(symbols[i : i + 30], []).append(i)
    for at in places.values():
        for i in at if len(at) > 1 else ():
            covered |= set(range(i, i + 30))
            for j in at:
                n = 30
                while i < j and j + n < len(symbols) and symbols[i + n] == symbols[j + n]:
                    n += 1
                longest = max(longest, n)
    return len(covered) / len(symbols) if symbols else 0.0, longest


def test_quality(awkward, documents, empty):
    for df in (awkward, documents):
        got = quality.quality(df).collect()
        want = df.select("doc_id", "text").collect()
        assert plain((r.doc_id, r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words, r.base_failed) for r in got) == plain((r.doc_id, *plain_quality(r.text)) for r in want)
        for r, w in zip(sorted(got, key=lambda r: (r.doc_id is None, r.doc_id, r.word_chars)), sorted(want, key=lambda r: (r.doc_id is None, r.doc_id, len(r.text or ""))), strict=True):
            if r.n_words < 3000 and r.word_chars < 4000:  # brute force takes the square of a text
                share, longest = plain_verdict(w.text)
                assert abs(share - r.covered_fraction) < 1e-9 and longest == r.longest_repeat
                assert r.kept == (not r.base_failed and share <= 0.15 and longest <= 250)
        assert quality.keep(df).count() == sum(r.kept for r in got)
        assert quality.keep(df).columns == df.columns
    assert quality.quality(empty).count() == 0 and quality.keep(empty).count() == 0


def test_repeats_that_the_base_rules_miss(spark):
    passage, filler = " ".join(f"w{i}" for i in range(100)), " ".join(f"v{i}" for i in range(1900))
    run, rest = "".join(f"{i:04d}" for i in range(100)), " ".join(f"u{i}" for i in range(40))
    line, more = "one line of five longer words and some more", " ".join(f"x{i}" for i in range(75))
    texts = [f"{passage} {filler} {passage}", f"{passage} {filler}", f"{run}x {run}y {run}z {rest}", f"{run} {rest}", "日本語の文" * 60 + f" {rest}", f"{line} {more} {line}", "a" * 3000 + f" {rest}"]
    r = quality.quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert not any(x.base_failed for x in r)
    assert [x.kept for x in r] == [False, True, False, True, False, False, False]
    assert [(x.longest_repeat, x.covered_fraction > 0.15) for x in r][:3] == [(290, False), (0, False), (400, True)]
    assert r[6].longest_repeat == 2999


def test_verdicts_do_not_depend_on_the_length_of_words(spark):
    rest = " ".join(f"u{i}" for i in range(40))
    texts = [" ".join("stem" * 8 + "xyz"[: n - 32] + f"{i:05d}" for i in range(20)) + f" {rest}" for n in (32, 33, 34, 35)]
    r = quality.quality(spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")).orderBy("doc_id").collect()
    assert [x.kept for x in r] == [False] * 4 and all(x.covered_fraction > 0.7 for x in r)


def test_limits_beyond_any_depth(spark):
    passage, rest = "".join(f"{i:05d}" for i in range(800)), " ".join(f"word{i}" for i in range(9000))
    df = spark.createDataFrame([(1, f"{passage} {rest} {passage}")], "doc_id long, text string")
    row = quality.quality(df, max_longest=3000).first()
    assert (row.longest_repeat, row.base_failed, row.kept) == (4000, False, False)
    assert quality.quality(df, max_longest=4000).first().kept


def test_a_very_long_text_that_is_all_repeats():
    symbols = np.tile(np.arange(1000), 3000)  # 3 million symbols
    ends = np.full(len(symbols), len(symbols))
    places, classes = quality.recurring(symbols, ends, 30)
    assert len(places) == len(symbols) - 29
    assert quality.longest(places, classes, np.zeros(len(symbols), np.int64), 30).tolist() == [len(symbols) - 1000]


PATTERNS = {"email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "ip": r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "card": r"[0-9]([\x20-]?[0-9])+", "phone": r"\+[0-9][\x20().0-9-]+[0-9]"}
TRICKY = [
    "a@b", "x@y.z@w.v_q@r.s", "1.2.3.4.5.6.7.8", "256.1.1.1 001.02.3.255", "4111 1111 1111 1111 4111-1111-1111-1111x41111111111111114", "+1 (555) 555-5555. +12 +1 2345678901234567 ++1 555 555 5555-", "﷐ a@b.c ﷑ +1 555 555 5555", "é🎉 a@b.co.uk. a@b..c",
    "1" * 5000, "1 1" * 3000, "79927398713 4111 1111 1111 1111  4111111111111111", "abc@nodot@x.com a@b.com_x@y.org",
]


def plain_spans(text):
    def luhn(d):
        return sum((lambda x: x - 9 if x > 9 else x)(int(c) * (1 + i % 2)) for i, c in enumerate(reversed(d))) % 10 == 0

    out = []
    for i, (kind, pattern) in enumerate(PATTERNS.items()):
        for m in re.finditer(pattern, text):
            d = re.sub("[^0-9]", "", m.group())
            if {"email": True, "ip": kind != "ip" or all(int(x) <= 255 for x in m.group().split(".")), "card": 14 <= len(d) <= 19 and luhn(d), "phone": 10 <= len(d) <= 15}[kind]:
                out.append((m.start(), i, m.end(), kind))
    return [f"{k}:{a}:{b}" for a, _, b, k in sorted(out)]


def test_personal_data(spark, awkward, documents, empty):
    more = spark.createDataFrame([(1000 + i, t) for i, t in enumerate(TRICKY)], "doc_id long, text string")
    for df in (awkward, documents.select("doc_id", "text").unionByName(more)):
        texts = df.select("doc_id", "text").collect()
        got = pii.personal_digests(df).collect()
        want = []
        for r in texts:
            spans = plain_spans(r.text or "")
            want.append((r.doc_id, *[sum(s.startswith(k + ":") for s in spans) for k in PATTERNS], hashlib.sha256(",".join(spans).encode()).hexdigest()))
        assert plain((r.doc_id, r.n_email, r.n_ip, r.n_card, r.n_phone, r.base_sha256) for r in got) == plain(want)
    assert pii.personal_digests(empty).count() == 0


def plain_tokens(text):
    import regex

    return regex.findall(r"[\p{L}\p{N}]+", text.lower())


def plain_learning(rows):
    """All spans of each text, by a plain fold over seeds, patterns and rounds, as lists of (start, kind, stop)."""
    from collections import Counter, defaultdict

    def instances(text, pattern, kind):
        found = list(re.finditer(pattern, text))
        for i, m in enumerate(found):
            before = text[found[i - 1].end() if i else 0 : m.start()]
            after = text[m.end() : found[i + 1].start() if i + 1 < len(found) else len(text)]
            a, b = plain_tokens(before), plain_tokens(after)
            grams = [("left", " ".join(a[-k:])) for k in (1, 2) if len(a) >= k] + [("right", " ".join(b[:k])) for k in (1, 2) if len(b) >= k]
            yield kind, m.start(), m.end(), m.group(), grams

    names = list(PATTERNS)
    base, loose, totals = defaultdict(list), [], Counter()
    for row, text in enumerate(rows):
        own = plain_tokens(text)
        totals.update(own)
        totals.update(" ".join(p) for p in zip(own, own[1:], strict=False))
        valid = {(names.index(k), int(a), int(b)) for k, a, b in (x.split(":") for x in plain_spans(text))}
        for i, pattern in enumerate(PATTERNS.values()):
            base[row] += [x for x in instances(text, pattern, i) if (i, x[1], x[2]) in valid]
        for x in instances(text, pii.CANDIDATE, -1):
            if not any(b[1] < x[2] and x[1] < b[2] for b in base[row]):
                loose += [(row, k, *x[1:]) for k, name in enumerate(names) if re.search(pii.LOOSE[name], x[3])]
    known = {(x[0], x[3]) for own in base.values() for x in own}
    edges = Counter((x[0], x[3], g) for own in base.values() for x in own for g in x[4]) + Counter((k, v, g) for _, k, _, _, v, grams in loose for g in grams)
    while True:
        values, hits = Counter(), Counter()
        for (k, v, g), n in edges.items():
            if (k, v) in known:
                values[k, g] += 1
                hits[k, g] += n
        good = {p for p, n in values.items() if n >= pii.MIN_VALUES and totals[p[1][1]] and hits[p] >= pii.MIN_CONFIDENCE * totals[p[1][1]]}
        new = known | {(k, v) for k, v, g in edges if (k, g) in good}
        if new == known:
            break
        known = new
    out = {row: [(x[1], x[0], x[2]) for x in own] for row, own in base.items()}
    added = {}
    for row, k, a, b, v, _ in loose:
        if (k, v) in known:
            added[row, a, b] = min(k, added.get((row, a, b), 9))
    for (row, a, b), k in added.items():
        out[row].append((a, k, b))
    return [",".join(f"{names[k]}:{a}:{b}" for a, k, b in sorted(out[row])) for row in range(len(rows))]


def planted_texts():
    """Known values in contexts on either side, of one or two tokens, near or far, and unseen ones in the
    same contexts; a chain in which each context is known only by what the one before it finds; decoys."""
    seen = [f"tel: +1 555 555 555{i} now" for i in range(4)] + [f"write {'mail' * 18}{' ' * 70}a{i}@b.example please" for i in range(4)]
    seen += [f"the {w} card of 4111111111111111 2 has {w} 378282246310005{' '}x and 6011111111111117" for w in ("old", "new", "odd")]
    seen += [f"host 10.0.0.{i} is down again" for i in range(5)]
    unseen = ["tel: 555-123-4567 ok", f"so write {'mail' * 18}{' ' * 70}j\u00fcrgen@b\u00fccher.example then", "now 10-20-0-777 is down", "host 999.10.10.1 and"]
    chain = []
    for step in range(4):
        chain += [f"step{step} 555-100-{step}{i}00 turn{step}" for i in range(3)] + [f"step{step + 1} 555-100-{step}{i}00 x" for i in range(3)]
    chain += [f"step0 +1 555 100 {i}000 then" for i in range(4)]
    decoys = ["order 555-123-9999 ok", "version 4.0 of 2000000 things", "x@y", "tel: none", "is down 12", "sum 1234567890123456 total", ""]
    return seen + unseen + chain + decoys, len(seen), len(unseen), len(chain)


def test_learning_equals_a_plain_fold(spark, documents):
    texts, seen, unseen, chain = planted_texts()
    more = [r.text or "" for r in documents.select("text").limit(60).collect()]
    for rows in (texts, texts + TRICKY + more):
        got = pii.personal_digests(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()
        want = plain_learning(rows)
        assert {r.doc_id: r.spans for r in got} == dict(enumerate(want))
    want = plain_learning(texts)
    # Of the planted unseen identifiers all are found, over more than three rounds, and no decoy is.
    assert all(want[seen : seen + unseen + chain])
    assert not any(want[seen + unseen + chain :])


def test_long_texts_of_personal_data(spark):
    """Time grows with the text, not with the square of its matches: 5 MB with 3 matches every 265 characters."""
    import time

    n = 20_000
    text = "".join(f"tel: +1 555 555 {i % 9000 + 1000} tel: 555-123-{i % 9000 + 1000}, a{i}@b.example {'filler ' * 30}" for i in range(n))
    df = spark.createDataFrame([(1, text)], "doc_id long, text string")
    began = time.monotonic()
    assert len(pii.personal_digests(df).first().spans.split(",")) == 3 * n
    assert time.monotonic() - began < 60
    assert pii.redact(df).first().text.count("[PHONE]") == 2 * n


def test_contexts_find_what_patterns_miss(spark):
    rows = [(i, f"tel: +1 555 555 555{i} now") for i in range(4)] + [(10, "tel: 555-123-4567 ok"), (11, "order 555-123-9999 ok"), (12, "version 4.0 of 2000000 things")]
    got = {r.doc_id: r.spans for r in pii.personal_digests(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got[10] == "phone:5:17" and got[11] == "" and got[12] == ""
    red = {r.doc_id: (r.text, r.n_chars) for r in pii.redact(spark.createDataFrame(rows, "doc_id long, text string").withColumn("n_chars", F.length("text").cast("long"))).collect()}
    assert red[10] == ("tel: [PHONE] ok", 15) and red[0][0] == "tel: [PHONE] now" and red[12][0] == rows[-1][1]


def test_redact_keeps_rows_and_columns(awkward, empty):
    out = pii.redact(awkward)
    assert out.columns == awkward.columns and out.count() == len(AWKWARD) and pii.redact(empty).count() == 0
    assert out.where("doc_id = 11").first().text == "mail [EMAIL] or [PHONE], [IP], [CARD]!"


PAGE = """<html><body><header class="site-header">Site</header><div class="cookie-notice">We use cookies</div><div id="main-menu"><a href=x>Home</a></div><main><div class="content post-12"><header><h1>Title &amp; more</h1></header>
<p>First para with <a href="q">link</a> and  spaces.<p>Second para is here&nbsp;too.<ul><li>one<li>two</ul><form><input>Sub</form><div class="comments"><p>I am a reader comment which is very long indeed and longer than all else in the page</p></div></div><aside>side</aside></main><footer>&copy; x</footer></body> tail <a hre"""


def test_pages(spark, sf_dir):
    pages = spark.read.parquet(f"{sf_dir}/pages.parquet").withColumn("winners", F.lit(1)).withColumn("host", F.lit(2))
    html = __import__("html")
    for r, source in [(x, x.html) for x in hostpaths.extract_pages(pages).join(pages.select("page_id", "html"), "page_id").collect()]:
        body = re.search(r"<article>(.*?)</article>", source, re.S)[1]
        blocks = (" ".join(html.unescape(re.sub("</?b>", "", p)).split()) for p in re.split(r"</?(?:p|h1|br)>", body))
        assert r.text == "\n".join(b for b in blocks if b) and r.n_chars == len(r.text)
    rows = [(1, "http://a.b/x", PAGE), (1, "http://a.b/x", PAGE), (2, None, "plain"), (None, "bad", None), (3, "http://a.b/y", "<div>" * 500 + "deep"), (4, "http://a.b/z", "<!-- open"), (5, "http://a.b/", "<a " * 9000)]
    got = hostpaths.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()
    texts = {r.page_id: r.text for r in got}
    assert len(got) == len(rows)
    assert texts[1] == "Title & more\nFirst para with link and spaces.\nSecond para is here too.\none\ntwo"
    assert texts[2] == "plain" and texts[None] == "" and texts[3] == "deep" and texts[4] == "" and texts[5] == ""
    assert hostpaths.extract_pages(pages.limit(0)).count() == 0


def test_a_page_follows_its_host(spark):
    article = '<body><div class="story-{i}"><p>{a}</p></div><div class="box"><p>{b}</p></div></body>'
    rows = [(i, f"http://h.c/{i}", article.format(i=i, a="long story " * 30, b="short")) for i in range(5)] + [(9, "http://h.c/9", article.format(i=9, a="brief", b="an odd long box " * 9))]
    got = {r.page_id: r.text for r in hostpaths.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got[9] == "brief"


def test_all_of_an_article_is_extracted(spark):
    body, lead = "body text " * 30, "lead text " * 9
    want = "\n".join(["Title", " ".join(lead.split()), " ".join(body.split())])
    inner = f'<h1>Title</h1><div class="lead"><p>{lead}</p></div><div class="body"><p>{body}</p></div>'
    shapes = [f"<article>{inner}</article>", f"<main><article>{inner}</article></main>", f'<div class="post">{inner}</div>']
    shapes += [f'<div class="{c}">{shape}</div>' for shape in shapes[:3] for c in ("with-sidebar", "has-banner", "banner-layout")]
    shapes += [f'<main><div class="sidebar-right">{inner}</div></main>']
    rest = '<div class="comments"><p>{}</p></div><div class="sidebar"><article><p>Teaser</p></article></div>'.format("a reader says " * 9)
    rows = [(i, f"http://h{i}.c/", f"<body><nav>Menu</nav>{shape}{rest if i < 2 else ''}</body>") for i, shape in enumerate(shapes)]
    got = {r.page_id: r.text for r in hostpaths.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == dict.fromkeys(range(len(rows)), want)


def test_topics_of_an_article_are_no_furniture(spark):
    kept = '<h2 id="privacy">On privacy</h2><section id="related-work" class="related-work"><p>Others wrote this.</p></section><p class="search-algorithms">We search.</p><p>So <math><mi>x</mi><mo>=</mo><mn>1</mn></math> holds.</p><object data="a.svg">A figure.</object><div id="discussion"><p>We discuss.</p></div>'
    gone = '<div class="related-posts"><p>Read this too.</p></div><div class="notice">A notice.</div><section class="comments" id="comments"><p>A reader says so.</p></section><div class="ad-box">Buy.</div><form>Name</form>'
    rows = [(1, "http://a.b/1", f"<body><nav>Menu</nav><article><h1>Title</h1>{kept}{gone}</article><footer>x</footer></body>"), (2, None, f"<body><div class='menu'>Menu</div><div class='story'><h1>Title</h1>{kept}</div></body>")]
    got = {r.page_id: r.text for r in hostpaths.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = "Title\nOn privacy\nOthers wrote this.\nWe search.\nSo x=1 holds.\nA figure."
    assert got[1] == want + "\nWe discuss." and got[2].startswith(want)


def test_names_inside_an_article(spark):
    """Names that may be topics lose no text inside an article or main part; menus of links, adverts, notices
    and comments go there too."""
    kept = '<section class="privacy"><p>On privacy.</p></section><div class="banner-image-caption">A caption.</div><ul class="menu"><li>Soup</li><li>Fish and <a href="x">chips</a></li></ul><div class="comments-on-kant"><p>On Kant.</p></div>'
    gone = '<ul class="menu"><li><a href="a">Home</a></li><li><a href="b">About us</a></li></ul><div class="site-cookie-notice">We use cookies.</div><div class="reader-comments"><p>First!</p></div><div class="ad-slot-3">Buy.</div><div class="popular"><a href="c">Much read</a></div>'
    rows = [(i, None, f"<body><{tag}><h1>Title</h1><p>{'long text ' * 30}</p>{kept}{gone}</{tag}></body>") for i, tag in enumerate(("article", "main"))]
    got = {r.page_id: r.text for r in hostpaths.extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    want = "\n".join(["Title", ("long text " * 30).strip(), "On privacy.", "A caption.", "Soup", "Fish and chips", "On Kant."])
    assert got == {0: want, 1: want}


def test_every_voted_path_of_a_host_may_win(spark):
    """How many paths travel as a list changes no row; a page follows the host's path far down the votes."""
    rows = []
    for kind in range(12):
        name = "".join(chr(97 + int(d)) for d in str(kind))
        for i in range(14 - kind):
            rows.append((100 * kind + i, f"http://h.c/{kind}/{i}", f'<body><div class="w{name}"><div class="{name}"><p>{"story " * 40}</p></div><div class="z{name}"><p>aside</p></div></div></body>'))
        rows.append((100 * kind + 99, f"http://h.c/{kind}/99", f'<body><div class="w{name}"><div class="{name}"><p>brief</p></div><div class="odd{name}"><p>{"odd text " * 9}</p></div></div></body>'))
    rows += [rows[0], rows[-1], (-1, "http://h.c/none", ""), (-2, None, "<p>no host"), (-3, "http://other.c/", "<body><div><p>other</p></div></body>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string")
    want = sorted(map(str, hostpaths.extract_pages(df).collect()))
    for listed in (1, 3):
        assert sorted(map(str, hostpaths.extract_pages(df, listed).collect())) == want
    assert sum("text='brief'" in x for x in want) == 13 and len(want) == len(rows)
