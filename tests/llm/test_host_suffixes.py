"""Repetition on hosts against brute force: copies, near copies, common phrases and declared pages."""

import random
import time

from molkeys.llm import host_suffixes

RNG = random.Random(11)
MENU, NOTICE = "Home News Sport Weather Travel Contact", " ".join(f"law{i}" for i in range(25))
PHRASE = "at the end of the day we all"


def words(n):
    return " ".join(f"w{RNG.randrange(10**6)}" for _ in range(n))


def brute(pages, declared):
    """{page: text}: pages are (host, kept blocks); runs of LONG words, or whole blocks outside articles, on enough different pages of a host."""
    long, out = host_suffixes.LONG, {}
    for i, (host, blocks) in enumerate(pages):
        other = {tuple(b) for h, b in pages if h == host}

        def often(test):
            c = sum(any(test(x.split()) for x in b) for b in other)
            return c >= 3 and 2 * c >= len(other)

        kept, total = [], 0
        for b in blocks:
            w = b.split()
            total += len(w)
            gone = set(range(len(w))) if not declared and often(lambda x: x == w) else set()
            for p in range(len(w) - long + 1):
                if often(lambda x: any(x[q : q + long] == w[p : p + long] for q in range(len(x) - long + 1))):
                    gone |= set(range(p, p + long))
            kept += [x for p, x in enumerate(w) if p not in gone]
        out[i] = " ".join(kept if 10 * len(kept) >= total else [x for b in blocks for x in b.split()])
    return out


def html_of(blocks, declared):
    body = "".join(f"<p>{b}</p>" for b in blocks)
    return f"<body><main>{body}</main>" if declared else f"<body>{body}"


def check(spark, pages, declared=False):
    rows = [(i, f"http://{h}/{i}" if h else None, html_of(b, declared)) for i, (h, b) in enumerate(pages)]
    got = {r.page_id: r.text for r in host_suffixes.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == brute(pages, declared)
    return got


def test_copies_and_near_copies_keep_their_text(spark):
    article, near = words(60), words(60)
    pages = [("a", [article])] * 5 + [("b", [near]), ("b", [near + " more"]), ("b", [near, "last"])] + [(None, [words(30), near]), (None, [near])]
    got = check(spark, pages)
    assert all(got[i] == article for i in range(5)) and got[5] == near and got[6] == near + " more" and got[7] == near + " last" and got[9] == near


def test_common_phrases_stay_and_boilerplate_goes(spark):
    for declared in (False, True):
        pages = [("a", [MENU, f"{words(12)} {PHRASE} {words(9)}", f"{words(3)} {NOTICE} {words(4)}"]) for _ in range(6)]
        got = check(spark, pages, declared)
        assert all(PHRASE in x and ("Weather" in x) == declared and "law" not in x for x in got.values())
        assert all(got[i] != " ".join(b) for i, (_, b) in enumerate(pages))  # repetition changes every page


def test_repeated_headings_of_articles_stay(spark):
    rows = [(i, f"http://h/{i}", f"<article><h2>Summary</h2><p>{words(8)}</p><h2 id='search' class='comments'>Search methods</h2><p>{words(30)} {NOTICE}</p></article>") for i in range(6)]
    for r in host_suffixes.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect():
        assert r.text.startswith("Summary w") and " Search methods w" in r.text and "law" not in r.text and len(r.text.split()) == 41


def test_mirrors_are_no_evidence_but_lose_what_others_share(spark):
    shared, twin = words(22), words(40)
    pages = [("m", [words(30), shared]) for _ in range(3)] + [("m", [twin, shared])] * 5 + [("m", [twin])]
    got = check(spark, pages)
    assert all(shared not in x for x in got.values()) and all(got[i] == twin for i in range(3, 9))


def test_random_hosts_with_overlapping_runs(spark):
    for seed in range(2):
        rng = random.Random(seed)
        runs = [" ".join(f"r{rng.randrange(40)}" for _ in range(rng.randrange(3, 45))) for _ in range(6)]
        pages = [(rng.choice("xyy"), [" ".join([*rng.sample(runs, rng.randrange(3)), *(f"u{rng.randrange(9)}" for _ in range(rng.randrange(1, 30)))]) for _ in range(rng.randrange(1, 4))]) for _ in range(24)]
        check(spark, pages, declared=bool(seed))


def test_an_interval_over_several_ranges(spark):
    rows = [(h, 1, s, p) for h in (1, 2) for s in ("a b", "a c", "z") for p in range(50) for _ in range(2) if (s != "z" or p < 2)]
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        got = host_suffixes.intervals(spark.createDataFrame(rows, "host long, key long, suffix string, page long"))
        assert {(r.host, r.suffix): r.c for r in got.collect()} == {(h, s): 2 if s == "z" else 50 for h in (1, 2) for s in ("a b", "a c", "z")}
    finally:
        spark.conf.unset("spark.sql.adaptive.enabled")


def test_clashing_columns_and_no_rows(spark):
    schema = "page_id long, url string, html string, row long, host string, keep string, known string"
    rows = [(1, None, None, 1, "a", "b", "c"), (2, "http://[", "<p>x", 1, "a", "b", "c"), (None, "http://h", "y", 1, "a", "b", "c")]
    got = host_suffixes.main_text(spark.createDataFrame(rows, schema)).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == [(0, "y", 1), (1, "", 0), (2, "x", 1)]
    assert host_suffixes.main_text(spark.createDataFrame([], schema)).collect() == []


def test_deep_pages_take_time_in_proportion():
    deep = 100_000
    began = time.time()
    assert text_of("<div class='ad'></div>" + "<div>" * deep + "x" + "</div>" * deep + "<b>y" + "</i>" * deep) == "x y"
    assert text_of("<div class='x ad'>" * 20_000 + "<article>T</article>" * 20) == " ".join(["T"] * 20)
    assert time.time() - began < 20


def test_shares_of_a_host(spark):
    passage = words(40)
    pages = [("", [words(30), passage] if i < 4 else [words(30)]) for i in range(10)] + [("c", [MENU, words(20)]) for _ in range(2)]
    assert passage in check(spark, pages)[0]


def text_of(page):
    blocks, declared = host_suffixes.blocks_of(page)
    return " ".join(x for mark, x in blocks if mark == ("main" if declared else "other"))


def test_marks_around_an_article_are_ignored():
    for page in (
        "<body class='has-sidebar'><article>T x</article>",
        "<html class=search><body id='search' hidden><article>T x</article>",
        "<main class='search-results'>T x</main>",
        "<main class='search'>T x</main>",
        "<article id='notice-3'>T x</article>",
        "<article class='notice'>T x</article>",
        "<div class='with-comments'><article>T x</article></div>",
        "<div class='comments'><div role='search'><article>T x</article></div></div>",
        "<div class='sidebar'><main>T x</main></div>",
        "<article><div class='article-header'>T</div>x</article>",
        "<article>T x</article><div class='comments'><article class='comment'>c</article></div>",
        "<article>T <div class='comments'>c</div>x</article>",
    ):
        assert text_of(page) == "T x", page


def test_values_are_not_read_as_names():
    for attributes in (' style="overflow: hidden"', " title='the hidden class=ad one'", " data-x=hidden", ' alt = "a role=navigation"', ' data-class="ad"'):
        assert not host_suffixes._marked(attributes), attributes
    for attributes in (" hidden", ' hidden=""', " CLASS=Ad", ' class="x ad y"', " id = 'footer'", " role=navigation/", ' title="x"class="ad"'):
        assert host_suffixes._marked(attributes) == (attributes != " role=navigation/"), attributes
    assert text_of("<body><div style='overflow: hidden'>a</div><div hidden>b</div>") == "a"
