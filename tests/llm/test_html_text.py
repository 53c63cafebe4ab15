import pytest

from tidelog.llm import html_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no</p>";</script></head><body class="has-sidebar">
<header><h2>Site</h2></header><nav><ul><li><a>Menu</a></ul></nav><div class="cookie-notice">We use cookies</div>
<main><article><h1>Title &amp; more</h1><p>First&nbsp;one<br>goes   on <b>bold</b>.<p>Second &lt;x&gt; &#233;<!-- gone -->!
<aside>Side</aside><form>Mail <input></form><table><tr><td>a<td>b</table></article>
<section id="comments"><article class="comment"><p>Nice!</p></article></section></main><div class="ad">Buy</div><footer>Foot</footer></body></html>"""


def test_article_only():
    text, _, rest, _ = html_text.split_page(PAGE)
    assert text == "Title & more\nFirst one goes on bold.\nSecond <x> é!\na\nb"
    assert "Menu" in rest and "Nice!" in rest and "Site" in rest


def test_awkward_markup():
    assert html_text.split_page(None)[:3] == ("", [], [])
    assert html_text.split_page("")[:3] == ("", [], [])
    assert html_text.split_page("<article><p title=it's>first part</p><p>second it's over</p><p>third</p></article>")[0] == "first part\nsecond it's over\nthird"
    assert html_text.split_page('<article>a<img alt=5">b<a href="x>y" title = \'>\'>c</a></article>')[0] == "abc"
    assert html_text.split_page('<article>a<a title="never closed>b</a><p>c</article>')[0] == "ab\nc"
    assert html_text.split_page("<article>İ<SCRIPT>x</Script >y</article>")[0] == "İy"
    assert html_text.split_page("plain text")[1] == ["plain text"]
    assert html_text.split_page("<article>open <b>end")[0] == "open end"
    assert html_text.split_page("<article>a < b <3</article>")[0] == "a < b <3"
    assert html_text.split_page("<article><p>x</p><script>never closed")[0] == "x"
    assert html_text.split_page("<nav>only menu</nav>")[0] == ""
    assert html_text.split_page("<article>" + "<div>" * 3000 + "deep" + "</div>" * 3000 + "</article>")[0] == "deep"


def test_long_pages_take_linear_time():
    import time

    many = 300_000
    for page in ("<p " * many, "<p a=\"" * many + ">", "<div>" * many + "</span>" * many, "<!--" * many, "<p a='" * many + "\">" + "<a b=\"" * many, "<article>" + "word " * many + "</article>", "<script>" * many, "&amp" * many, "< " * many, "</" * many):
        began = time.process_time()
        html_text.split_page(page)
        assert time.process_time() - began < 10, page[:20]


def slow_runs(streams, run):
    pages = {}
    for k, (host, tokens) in enumerate(streams):
        for i in range(len(tokens) - run + 1):
            pages.setdefault((host, tuple(tokens[i : i + run])), set()).add(k)
    return {html_text._digest(h, list(t)): len(p) for (h, t), p in pages.items()}


def test_suffix_runs_match_brute_force():
    import random

    rng = random.Random(4)
    streams = [(rng.choice(["h", "g"]), [rng.choice("ab") for _ in range(rng.randint(0, 30))]) for _ in range(40)]
    for run in (1, 3, 8):
        assert dict(html_text.suffix_runs(streams, run)) == slow_runs(streams, run)
    assert dict(html_text.suffix_runs([], 8)) == {}


def slow_extract(pages, min_pages, share):
    """Open pages by brute force: tokens in runs or short blocks that enough of the host's distinct pages have go."""
    run = html_text.RUN
    split = [(html_text.host_of(url), *html_text.split_page(page)) for _, url, page in pages]
    texts = {(host, mark): rest for host, _, _, rest, mark in split}
    out = []
    for host, text, undecided, _, _ in split:
        if text is not None:
            out.append(text)
            continue
        others = [rest for (h, _), rest in texts.items() if h == host]

        def common(words, whole, others=others):
            def has(rest):
                if whole:
                    return any(b.split() == words for b in rest)
                tokens = " ".join(rest).split()
                return any(tokens[i : i + run] == words for i in range(len(tokens) - run + 1))

            n = sum(map(has, others))
            return n >= min_pages and n >= share * len(others)

        tokens = " ".join(undecided).split()
        gone = [False] * len(tokens)
        for i in range(len(tokens) - run + 1):
            if common(tokens[i : i + run], False):
                gone[i : i + run] = [True] * run
        at, blocks = 0, []
        for words in (b.split() for b in undecided):
            if len(words) < run and common(words, True):
                gone[at : at + len(words)] = [True] * len(words)
            left = [w for w, g in zip(words, gone[at : at + len(words)], strict=True) if not g]
            at += len(words)
            if left:
                blocks.append(" ".join(left))
        out.append("\n".join(blocks))
    return out


def test_extraction_matches_brute_force(spark):
    import random

    rng = random.Random(5)
    lines = [" ".join(rng.choice("abcd") * rng.randint(1, 2) for _ in range(rng.randint(2, 25))) for _ in range(30)]
    pages = []
    for i in range(90):
        parts = [rng.choice(lines[: rng.choice((4, 30))]) + rng.choice(("", f" own{i}")) for _ in range(rng.randint(0, 6))]
        tags = [rng.choice(("div", "p", "nav", "div")) for _ in parts]
        body = "".join(f"<{t}>{x}</{t}>" for t, x in zip(tags, parts, strict=True))
        pages.append((i, rng.choice((None, "http://a.example/", "http://b.example/x", "http://c.example")), rng.choice((body, body, f"<article>{i} {lines[0]}</article>{body}"))))
    pages += [(200 + i, *pages[i][1:]) for i in range(0, 60, 3)]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(5)
    for min_pages, share in ((3, 0.1), (2, 0.5)):
        got = {r.page_id: r.text for r in html_text.extract(df, min_pages=min_pages, share=share).collect()}
        want = slow_extract(pages, min_pages, share)
        assert got == {p[0]: text for p, text in zip(pages, want, strict=True)}
        # The array decides on these: many open pages are not simply all their blocks.
        assert sum(text != "\n".join(html_text.split_page(p[2])[1]) for p, text in zip(pages, want, strict=True) if html_text.split_page(p[2])[0] is None) > 20


def test_copies_of_a_page_keep_its_text_and_large_hosts_their_phrases(spark):
    page = "<div>a text of more than eight words that stands on one page only</div>"
    copies = [(i, "http://h.example/", page) for i in range(5)]
    phrase = "these are eight words that three pages quote"
    large = [(100 + i, "http://big.example/", f"<div>start{i} {phrase if i < 3 else ''} and so{i} on{i}</div>") for i in range(60)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(copies + large, "page_id bigint, url string, html string")).collect()}
    assert all(got[i].startswith("a text of more") for i in range(5))
    assert all(phrase in got[100 + i] for i in range(3))


def test_host_boilerplate_goes_and_unique_runs_stay(spark):
    boiler = "this line is on every page of the host and it is long enough"
    pages = [(i, f"http://www.h.example/{i}", f"<body><div>{boiler}</div><div>u{i}a u{i}b u{i}c</div><div>{boiler} tail{i}</div></body>") for i in range(6)]
    pages += [(50, "http://other.example/", f"<body><div>{boiler}</div></body>"), (60, None, None), (None, "x", "<article>t</article>"), (61, "http://www.h.example/a", f"<article>{boiler}</article>")]
    from pyspark.sql import functions as F

    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").withColumns({c: F.lit(1) for c in ("text", "uid", "host", "rest", "run")})
    got = {r.page_id: r.text for r in html_text.extract(df).collect()}
    for i in range(6):
        assert got[i] == f"u{i}a u{i}b u{i}c\ntail{i}"
    assert got[50] == boiler and got[60] == "" and got[None] == "t" and got[61] == boiler
    assert html_text.extract(df.limit(0)).count() == 0


def slow_vouched(pages, min_pages, share):
    """Vouched texts by brute force: blocks that runs on enough of the host's distinct texts cover whole go, at most half of the tokens."""
    run = html_text.RUN
    texts = [(html_text.host_of(url), html_text.split_page(page)[0]) for _, url, page in pages]
    out = []
    for host, text in texts:
        others = [t.split() for t in {t for h, t in texts if h == host and t}]
        tokens, gone = text.split(), set()
        for i in range(len(tokens) - run + 1):
            n = sum(any(o[j : j + run] == tokens[i : i + run] for j in range(len(o) - run + 1)) for o in others)
            if n >= min_pages and n >= share * len(others):
                gone |= set(range(i, i + run))
        kept, at, lost = [], 0, 0
        for block in text.split("\n"):
            size = len(block.split())
            if gone >= set(range(at, at + size)):
                lost += size
            else:
                kept.append(block)
            at += size
        out.append(text if 2 * lost > len(tokens) else "\n".join(kept))
    return out


def test_host_array_takes_boilerplate_out_of_vouched_texts(spark):
    import random

    rng = random.Random(7)
    common = [" ".join(f"c{k}x{j}" for j in range(rng.randint(3, 14))) for k in range(6)]
    pages = []
    for i in range(80):
        blocks = [" ".join(f"u{i}w{j}" for j in range(rng.randint(5, 25))) for _ in range(rng.randint(1, 4))]
        for k, x in enumerate(common):
            if rng.random() < (0.9, 0.75, 0.55, 0.45, 0.2, 0.6)[k]:
                blocks.insert(rng.randint(0, len(blocks)), x + rng.choice(("", "", "", f" own{i}")))
        host = rng.choice((None, "http://a.example/", "http://a.example/x", "http://b.example"))
        pages.append((i, host, "<nav>n</nav><article>" + "".join(f"<p>{x}</p>" for x in blocks) + f"</article><footer>{i}</footer>"))
    pages += [(100 + i, *pages[i][1:]) for i in range(0, 60, 2)] + [(300, "http://one.example", f"<article><p>{common[0]}</p></article>")]
    df = spark.createDataFrame(pages, "page_id bigint, url string, html string").repartition(5)
    for min_pages, share, bucket_pages in ((3, 0.5, 256), (3, 0.5, 4), (2, 0.25, 7)):
        got = {r.page_id: r.text for r in html_text.extract(df, min_pages=min_pages, vouched_share=share, bucket_pages=bucket_pages).collect()}
        want = slow_vouched(pages, min_pages, share)
        assert got == {p[0]: text for p, text in zip(pages, want, strict=True)}
        assert sum(text != html_text.split_page(p[2])[0] for p, text in zip(pages, want, strict=True)) > 40


def test_versions_and_copies_of_an_article_keep_their_text(spark):
    long = " ".join(f"w{j}" for j in range(40))
    pages = [(i, "http://h.example/", f"<article><p>{long}</p><p>version {i}</p></article><div class=ad>{i}</div>") for i in range(6)]
    pages += [(10 + i, "http://g.example/", f"<article><p>{long}</p></article><div class=ad>{i}</div>") for i in range(6)]
    got = {r.page_id: r.text for r in html_text.extract(spark.createDataFrame(pages, "page_id bigint, url string, html string"), bucket_pages=2).collect()}
    assert all(got[i] == f"{long}\nversion {i}" for i in range(6)) and all(got[10 + i] == long for i in range(6))


@pytest.mark.parametrize(
    ("page", "text"),
    [
        ('<article><section class="related-work"><p>prose</p></section></article>', "prose"),
        ('<article><div class="comments-off">a</div><div class="story-ad-free">b</div></article>', "a\nb"),
        ('<article><p>x</p><div class="related-posts">r</div><div class="shareButtons">s</div><div class="post ad">t</div><p>y</p></article>', "x\ny"),
        ('<div class="related-work"><p>menu</p></div><article>a</article>', "a"),
        ('<article><p class="ad">Buy <b>now</b><p class="notice">We use cookies</p><h2 class="newsletter-title">Sign up</h2><p>b</p></article>', "b"),
        ('<article><p class="ad">Buy <span>now</span> or later<div>kept</div></article>', "kept"),
        ("<main><h1>T</h1><p>body</p></main><article>teaser</article>", "T\nbody"),
        ("<main><p>a b c d</p><article>t</article></main>", "a b c d\nt"),
        ("<main><h2>more</h2><article>a b c d</article></main>", "a b c d"),
    ],
)
def test_what_names_condemn_and_what_main_keeps(page, text):
    assert html_text.split_page(page)[0] == text
