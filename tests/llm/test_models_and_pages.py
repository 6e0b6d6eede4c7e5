import bisect
import math
import random

from leafsift.llm import html_text, language_id, suffix_tree

from . import brute

PAGE = """<!DOCTYPE html><html lang="en"><head><title>no</title><style>p{}</style></head><body class="has-sidebar"><header><h1>Site</h1>
<nav><ul><li><a href="/">Home</a></li></ul></nav></header><div id="cookie-notice">We use cookies</div><!-- ad --><main><article class="post">
<header><h1>Title &amp; more</h1></header><p>First <b>bold</b>&nbsp;text &lt;3.<br>Next<p>Unclosed<script>var t="</p>";</script> para
<div class="share-buttons">Share</div><aside>Related</aside><blockquote>Quote a < b</blockquote></article>
<section id="comments"><article class="comment"><p>Nice!</p></article></section></main><div class="sidebar">Side</div>
<form>Mail <input><button>Go</button></form><div class="ad">Buy</div><footer>foot</footer></body></html>"""


def test_article_of_a_page():
    assert [t for t, _ in html_text.candidate_lines(PAGE)] == ["Title & more", "First bold text <3. Next", "Unclosed para", "Quote a < b"]
    assert html_text.candidate_lines("") == [] and html_text.candidate_lines("just text") == [("just text", True)]
    assert [t for t, _ in html_text.candidate_lines("<article><p>cut off <b>here &am")] == ["cut off here &am"]
    deep = html_text.candidate_lines("<div>" * 20_000 + "deep" + "<p" * 50_000 + "'\"")
    assert deep[0] == ("deep", True)


def test_common_lines_are_a_longest_common_subsequence():
    rng = random.Random(0)
    for _ in range(500):
        a, b = ([rng.randint(0, 4) for _ in range(rng.randint(0, 14))] for _ in "ab")
        table = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                table[i + 1][j + 1] = table[i][j] + 1 if x == y else max(table[i][j + 1], table[i + 1][j])
        assert len(html_text.common_lines(a, b)) == table[-1][-1]


def test_wrappers_named_like_menus():
    for wrapper in ('div class="layout has-sidebar"', 'div id="search-page"', 'div class="with-ads content"', 'section class="social"', 'div class="nav"'):
        for article in ("article", "main"):
            page = f'<{wrapper}><div class="sidebar">Side</div><{article}><p>The text.</p><div class="share">Share</div></{article}></div>'
            assert [t for t, _ in html_text.candidate_lines(page)] == ["The text."], page
    plain = '<div class="with-ads content"><p>Only text.</p><div class="ads">Buy</div></div>'
    assert html_text.candidate_lines(plain) == [("Only text.", True)]
    # Where the page names its article, teasers in a sidebar and comments stay out; comments are never the article.
    teaser = '<div class="sidebar"><article><p>Teaser</p></article></div>'
    assert html_text.candidate_lines(f"{teaser}<article><p>Story</p></article>") == [("Story", False)]
    assert html_text.candidate_lines('<div id="comments"><article><p>Nice!</p></article></div><p>Text') == [("Text", True)]


def test_deep_and_long_pages():
    import time
    import tracemalloc

    start = time.time()
    lines = html_text.candidate_lines("<div>" * 3_000 + "x</p>" * 30_000 + "<article>" * 3_000 + "deep")
    assert lines == [("deep", True)] and time.time() - start < 5
    rng = random.Random(4)
    a = list(range(20_000))
    b = a.copy()
    for _ in range(2_000):  # moved lines, so that most of the table is needed
        i, j = rng.randrange(len(b)), rng.randrange(len(b))
        b[i], b[j] = b[j], b[i]
    tracemalloc.start()
    common = html_text.common_lines(a, b)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # Distinct lines: a longest common subsequence is a longest increasing one.
    piles = []
    for x in b:
        at = bisect.bisect_left(piles, x)
        piles[at:at + 1] = [x]
    assert len(common) == len(piles) and peak < 40_000_000
    places = [b.index(a[i]) for i in sorted(common)]
    assert places == sorted(places)


def test_divided_alignment_is_as_long(monkeypatch):
    rng = random.Random(5)
    pairs = [([rng.randint(0, 5) for _ in range(rng.randint(0, 40))], [rng.randint(0, 5) for _ in range(rng.randint(0, 40))]) for _ in range(200)]
    whole = [len(html_text.common_lines(a, b)) for a, b in pairs]
    monkeypatch.setattr(html_text, "TABLE_BITS", 8)
    monkeypatch.setattr(html_text, "MANY_PLACES", 2)
    for (a, b), n in zip(pairs, whole):
        found = sorted(html_text.common_lines(a, b))
        rest = iter(b)
        assert len(found) == n and all(a[i] in rest for i in found)  # a subsequence of both


def test_nearest_different_page_over_ranges(spark):
    """Runs of equal pages, some longer than a range, against a plain search for the nearest different page."""
    rng = random.Random(6)
    rows, n = [], 0
    for host in "ab":
        for _ in range(25):
            body = rng.randint(0, 3)
            for _ in range(rng.choice([1, 1, 2, 3, 30])):
                rows.append((n, f"http://{host}.example/{n:05d}", f"<div>menu {host}</div><div>story {body}</div><div>foot</div>"))
                n += 1
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    cut = html_text.staged(html_text._cut(pages), "page-lines")
    got = {r.key: (r.before, r.after) for r in html_text._neighbours(cut).collect()}
    keys = [r.key for r in cut.orderBy("page_id").select("key").collect()]
    host = lambda i: rows[i][1][:14]
    for i, key in enumerate(keys):
        for side, step in enumerate((-1, 1)):
            j = i + step
            while 0 <= j < n and host(j) == host(i) and rows[j][2] == rows[i][2]:
                j += step
            want = keys[j] if 0 <= j < n and host(j) == host(i) else None
            assert got[key][side] == want, (i, side)
    text = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    assert all(text[i] == rows[i][2].split("<div>")[2].removesuffix("</div>") for i in text)  # copies in a row lose their menu too


def test_copies_of_short_lines_stay(spark):
    def page(n):
        return "".join(f"<div>line {i} of a poem</div>" for i in range(19)) + f"<div>read {n} times today</div>"

    pages = spark.createDataFrame([(n, f"http://p.example/{n}", page(n)) for n in (1, 2)], "page_id long, url string, html string")
    assert all(r.text.count("\n") == 19 for r in html_text.main_text(pages).collect())


def test_differencing_against_brute_force(spark):
    """Unmarked pages whose lines differencing decides, against a plain alignment with the pages next by path."""
    rng = random.Random(8)
    rows = []
    for n in range(60):
        body = [f"item {n} {i} " + "x" * rng.randint(20, 60) for i in range(rng.randint(2, 6))]
        menu = [f"menu {i}" for i in range(rng.randint(3, 6))]
        rows.append((n, f"http://h.example/{n:03d}", menu + body + ["imprint", "terms"][:rng.randint(1, 2)]))

    def common(a, b):
        t = [[0] * (len(b) + 1) for _ in range(len(a) + 1)]
        for i, x in enumerate(a):
            for j, y in enumerate(b):
                t[i + 1][j + 1] = t[i][j] + 1 if x == y else max(t[i][j + 1], t[i + 1][j])
        out, i, j = set(), len(a), len(b)
        while i and j:
            if a[i - 1] == b[j - 1]:
                i, j = i - 1, j - 1
                out.add(i)
            elif t[i - 1][j] >= t[i][j - 1]:
                i -= 1
            else:
                j -= 1
        return out

    pages = spark.createDataFrame([(n, u, "".join(f"<div>{x}</div>" for x in ls)) for n, u, ls in rows], "page_id long, url string, html string")
    got = {r.page_id: r.text for r in html_text.main_text(pages).collect()}
    for n, _, ls in rows:
        gone = set().union(*(common(ls, rows[m][2]) for m in (n - 1, n + 1) if 0 <= m < 60))
        assert got[n] == "\n".join(x for i, x in enumerate(ls) if i not in gone)


def test_differencing_of_neighbours(spark):
    def page(n, body):
        return f"<html><body><div>Daily Paper</div><div>Mon Tue Wed</div><div>{body}</div><div>All rights reserved</div><div>no {n}</div></body></html>"

    long = " ".join(f"word{i}" for i in range(40))
    rows = [(1, "http://a.example/x/1", page(1, "first story")), (2, "http://a.example/x/2?utm=1", page(2, "second story")),
            (3, "http://a.example/x/3", page(3, "third story")), (4, "http://b.example/x/1", page(4, "alone on its host")),
            (5, None, page(5, "no address")), (6, "http://c.example/1", page(6, long)), (7, "http://c.example/2", page(7, long)),
            (8, "http://a.example/x/2", None), (9, "http://a.example/y", ""), (None, "http://d.example/", PAGE), (10, "http://e.example/", PAGE), (10, "http://e.example/", PAGE)]
    pages = spark.createDataFrame([(*r, "k", 1) for r in rows], "page_id long, url string, html string, key string, n_chars int")
    out = html_text.main_text(pages)
    assert out.columns == ["page_id", "url", "text", "n_chars"]
    got = [(r.page_id, r.text) for r in out.collect()]
    text = dict(got)
    assert text[1] == "first story\nno 1" and text[2] == "second story\nno 2" and text[3] == "third story\nno 3"
    assert text[4].startswith("Daily Paper\n") and text[5].startswith("Daily Paper\n")
    assert text[6] == f"{long}\nno 6" and text[7] == f"{long}\nno 7"  # copies stay
    assert text[8] == text[9] == "" and text[10] == text[None] and len(got) == len(rows)
    assert all(r.n_chars == len(r.text) for r in out.collect())
    assert html_text.main_text(pages.limit(0)).count() == 0


TALK = {"en": "the of and that with from this which have been there would", "de": "der die und das nicht mit eine sich auch werden über für",
        "fr": "les des une que dans pour pas avec être cette où très"}


def talk(lang, n, rng):
    return " ".join(rng.choice(TALK[lang].split()) for _ in range(n))


def language_rows():
    rng = random.Random(7)
    rows = [(i, talk(lang, 30, rng), lang, f"www.{lang}-host.example.{'de' if lang == 'de' else 'org'}", 0) for i in range(300) for lang in [list(TALK)[i % 3]]]
    return rows, rng


def test_languages(spark, make_docs, odd_rows):
    rows, rng = language_rows()
    held = [(1000 + i, talk(lang, 12, rng), None, None, 0) for i in range(60) for lang in [list(TALK)[i % 3]]]
    odd = [(2000, None, "en", None, 0), (2001, "", None, None, 0), (2002, "12 34 !!", "de", "x", 0), (2003, "qzxj " * 40, None, None, 0),
           (2004, "THE OF AND, WITH!! THIS", None, None, 0), (2005, "und " * 60_000, None, None, 0), (2005, "und " * 60_000, None, None, 0)]
    docs = make_docs(rows + held + odd)
    out = {r.doc_id: r for r in language_id.identify_languages(docs).collect()}
    assert sum(out[1000 + i].language == list(TALK)[i % 3] for i in range(60)) >= 58
    assert all(out[i].rejected and out[i].language is None for i in (2000, 2001, 2002))
    assert out[2003].rejected and out[2003].language == "other"
    assert out[2004].language == "en" and not out[2004].rejected and out[2005].language == "de"
    kept = language_id.in_known_languages(docs)
    assert kept.columns == docs.columns and kept.count() == docs.count() - 4
    assert language_id.identify_languages(docs.limit(0)).count() == 0
    nothing = {r.doc_id: r.rejected for r in language_id.identify_languages(docs.filter("doc_id >= 2000").withColumn("lang", docs.lang.substr(99, 1))).collect()}
    assert nothing[2004] is False and nothing[2000] is True


def test_rare_language_beside_many_rows(make_docs):
    rng = random.Random(11)
    many = [(i, talk(lang, 20, rng), lang, None, 0) for i in range(4_000) for lang in [("en", "de")[i % 2]]]
    rare = [(9000 + i, talk("fr", 20, rng), "fr", None, 0) for i in range(8)]
    copies = [(9100, "qui quo", "la", None, 0)] * 300
    docs = make_docs(many + rare + copies)
    model = language_id.TextModel.fit(docs.select("doc_id", "lang", "text"), rows=120)
    assert model.languages == ["de", "en", "fr", "la"]
    out = language_id.identify_languages(docs, model=model).filter("doc_id >= 9000").collect()
    assert all(r.language == r.lang and not r.rejected for r in out)


def test_tags_that_name_no_language(make_docs):
    """Rows declared ``und`` and thousands of junk tags neither become languages nor sway the decision."""
    rng = random.Random(13)
    truth = {i: ("en", "de")[i % 2] for i in range(1_000)}
    junk = [f"{a}{b}q{c}" for a in "abcdefghij" for b in "abcdefghij" for c in "abcdefghijklmnopqrst"]
    rows = [(i, talk(lang, 20, rng), "und" if i % 3 else lang, None, 0) for i, lang in truth.items()]
    rows += [(5_000 + i, talk(("en", "de")[i % 2], 20, rng), tag, None, 0) for i, tag in enumerate(junk)]
    out = language_id.identify_languages(make_docs(rows)).select("doc_id", "language", "rejected").collect()
    assert {r.language for r in out} <= {"en", "de", "other"}
    right = [r.language == (truth[r.doc_id] if r.doc_id in truth else ("en", "de")[(r.doc_id - 5_000) % 2]) and not r.rejected for r in out]
    assert sum(right) >= 0.98 * len(right) and len(right) == 3_000


def test_declaration_suffix_and_host_decide_ties(make_docs):
    rows, _ = language_rows()
    both = "der the und of"
    asked = [(5000, both, "de", None, 0), (5001, both, "en", None, 0), (5002, both, None, "www.de-host.example.de", 0), (5003, both, None, "www.en-host.example.org", 0),
             (5004, both, None, "unseen.example.de", 0)]
    out = {r.doc_id: r.language for r in language_id.identify_languages(make_docs(rows + asked)).filter("doc_id >= 5000").collect()}
    assert (out[5000], out[5001], out[5002], out[5003]) == ("de", "en", "de", "en")


def test_addresses_and_markup(spark):
    row = spark.createDataFrame([("HTTPS://me@WWW.a.Example:80/x?q", '<html class=x lang="de-AT">')], "u string, h string")
    got = row.select(language_id.host_of(row.u), language_id.markup_language(row.h), language_id.suffix_of(language_id.host_of(row.u))).first()
    assert tuple(got) == ("www.a.example", "de-AT", "example")


def test_scores(make_docs, odd_rows):
    rng = random.Random(9)
    rows = odd_rows + [(100 + i, talk("en", 50, rng) + (" rare%d" % i) * (i % 3)) for i in range(400)]
    out = suffix_tree.score_documents(make_docs(rows))
    got = sorted(((r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 5)) for r in out.collect()), key=repr)
    want = sorted(((*b[:5], round(b[5], 5)) for b in brute.base_scores([(r[0], r[1]) for r in rows])), key=repr)
    assert [g[:5] for g in got] == [w[:5] for w in want]
    assert all(math.isclose(g[5], w[5], abs_tol=1e-4, rel_tol=1e-9) for g, w in zip(got, want))
    held = [r for r in out.collect() if r.held_out and r.doc_id and r.doc_id >= 100]
    assert held and sum(r.score for r in held) > 1.2 * sum(r.base_score for r in held)
    assert suffix_tree.score_documents(make_docs(rows).limit(0)).count() == 0


def test_scores_against_brute_force(make_docs):
    rng = random.Random(15)
    rows = [(i, talk("en", rng.randint(0, 30), rng) + ("  Ünseen" if i % 50 == 7 else "")) for i in range(300)] + [(300, None), (301, "")]
    got = {r.doc_id: r.score for r in suffix_tree.score_documents(make_docs(rows)).collect()}
    want = brute.suffix_tree_scores(rows, suffix_tree.DEPTH, suffix_tree.least_count)
    assert len(got) == len(rows) and all(math.isclose(got[i], w, rel_tol=1e-4) for (i, _), w in zip(rows, want))


def test_contexts_grow_with_the_corpus():
    counts = [suffix_tree.least_count(n) for n in (0, 10**5, 10**7, 10**9, 10**13)]
    assert counts == sorted(counts) and counts[1] == suffix_tree.LEAST_SHARE * 10**5
    room = [n / suffix_tree.least_count(n) for n in (10**7, 10**8, 10**9, 10**13)]
    assert all(b > 2 * a for a, b in zip(room[1:], room[2:]))


def grown(spark, texts):
    grams = suffix_tree.context_grams([suffix_tree.tokens_of(t) for t in texts])
    return suffix_tree.SuffixTree.grow(spark.createDataFrame([(int(g), 1) for g in grams], "code long, n long"))


def test_walk_equals_longest_retained_suffix(spark):
    rng = random.Random(3)
    texts = [talk("en", 40, rng) for _ in range(60)]
    tree = grown(spark, texts)
    assert len(tree.logs) > 20
    # Each state's distribution sums to one; the last class stands for one of the symbols not seen.
    unseen = suffix_tree.BASE - tree.logs.shape[1] + 1
    mass = (10.0 ** tree.logs[:, :-1]).sum(axis=1) + unseen * 10.0 ** tree.logs[:, -1]
    assert abs(mass - 1).max() < 1e-4
    one = suffix_tree.tokens_of("the which of zzz from " * 400)
    parts = [tree.scores([one])[0], tree.scores([b"", one, b"x"])[1]]
    state, total = 0, 0.0
    symbols, _ = suffix_tree.symbols([one], suffix_tree.DEPTH)
    for k, s in enumerate(tree.symbol_class[symbols]):
        if k >= suffix_tree.DEPTH:
            total += float(tree.logs[state, s])
        state = tree.step[state, s]
    assert all(math.isclose(p, total, rel_tol=1e-9) for p in parts)
