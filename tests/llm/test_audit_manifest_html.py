"""Operators 11 to 13 on odd rows, against plain versions in single-threaded Python."""

import hashlib
import re
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from tessera.llm import divergence_audit, html_extraction, merkle_manifest, queries

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def rows(df, *names):
    return sorted((tuple(r[n] for n in names) for r in df.collect()), key=repr)


# Operator 11


def plain_manifest(docs):
    """Rows of (doc_id, leaf, subroot, root, proof_sha256, folded_root, verified), by lists of whole levels."""
    h = lambda *x: hashlib.sha256("".join(x).encode()).hexdigest()
    code = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"

    def leaf(d, more=0):
        return h(*(code(d[c] if c != "n_chars" or d[c] is None else d[c] + more) for c in ("doc_id", "source", "lang", "n_chars", "text")))

    def tree(nodes):
        levels = [nodes]
        while len(levels[-1]) > 1:
            now = levels[-1]
            levels.append([h(*now[i : i + 2]) for i in range(0, len(now), 2)])
        return levels

    def siblings(levels, i):
        out = []
        for level in levels[:-1]:
            out.append((i & 1, level[i ^ 1] if (i ^ 1) < len(level) else ""))
            i >>= 1
        return out

    langs = sorted({d["lang"] for d in docs}, key=lambda x: (x is not None, (x or "").encode()))
    order = {x: sorted((d for d in docs if d["lang"] == x), key=lambda d: (d["doc_id"] is not None, d["doc_id"] or 0, leaf(d))) for x in langs}
    trees = {x: tree([leaf(d) for d in order[x]]) for x in langs}
    top = tree([trees[x][-1][0] for x in langs])
    out = []
    for k, x in enumerate(langs):
        for i, d in enumerate(order[x]):
            path = siblings(trees[x], i) + siblings(top, k)
            node = leaf(d, d["doc_id"] is not None and zlib.crc32(str(d["doc_id"]).encode()) % 7 == 0)
            for left, s in path:
                node = h(s, node) if left else h(node, s)
            out.append((d["doc_id"], leaf(d), trees[x][-1][0], top[-1][0], h(*(s for _, s in path)), node, node == top[-1][0]))
    return out


def as_docs(data):
    return [dict(zip(("doc_id", "text", "lang", "source", "n_chars"), r)) for r in data]


ODD = [(i, f"text {i} é", ["en", "de", None, "ß", ""][i % 5], f"s{i % 3}" if i % 4 else None, i * 7 if i % 6 else None) for i in range(1, 90)]
ODD += [(5, "again", "en", "s1", 3), (5, "again", "en", "s1", 3), (None, "no id", "en", "s1", 1), (None, None, None, None, None), (2**62, "x" * 300000, "long", "s", 2**63 - 1), (-3, "", "en", "", 0)]


def test_manifest_equals_the_plain_version(spark):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    df = spark.createDataFrame(ODD, DOCS).withColumns({"tree": F.lit("clash"), "pos": F.lit(1), "node": F.lit("x"), "part": F.lit(2), "leaf": F.lit("y"), "place": F.lit(0)})
    want = sorted(plain_manifest(as_docs(ODD)), key=repr)
    assert rows(merkle_manifest.manifest(df), *names) == want
    assert {r[-1] for r in want} == {True, False}
    small = ODD[:40] + ODD[-6:]
    for height in (1, 2):  # superblocks of two and four leaves: several tiers
        assert rows(merkle_manifest.manifest(spark.createDataFrame(small, DOCS), height=height), *names) == sorted(plain_manifest(as_docs(small)), key=repr)


def test_manifest_of_few_rows(spark):
    names = ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")
    one = [(4, None, None, "s", None)]
    got = rows(merkle_manifest.manifest(spark.createDataFrame(one, DOCS)), *names)
    assert got == plain_manifest(as_docs(one)) and got[0][1] == got[0][2] == got[0][3] and got[0][4] == hashlib.sha256(b"").hexdigest()
    assert merkle_manifest.manifest(spark.createDataFrame([], DOCS)).count() == 0


# Operator 12


def text_of(html):
    pieces, _ = html_extraction.main_text(html_extraction.Page(html))
    return html_extraction.joined([p[0] for p in pieces], [p[1] for p in pieces])


@pytest.mark.parametrize(
    "html, text",
    [
        ("", ""),
        (" \n\t", ""),
        ("plain &lt;text&gt; &amp;amp; &#233;&eacute;&nbsp;x", "plain <text> &amp; éé x"),
        ("<p>one<p>two<ul><li>x<li>y</ul><script>var a='</p>'</script>tail<nav>menu</nav>", "one\n\ntwo\n\nx\n\ny\n\ntail"),
        ("<nav>n</nav><header>h</header><article><h1>T &amp</h1><p><b>a<br>b \n c</p><p>d</article><footer>f</footer>", "T &\n\na b c\n\nd"),
        ("<article><p>a</p><div class='ad'>ad</div><aside>side</aside><form>f</form><p>b</p><section id=comments><article>c</article></section></article>", "a\n\nb"),
        ("<div class='page with-sidebar'><article><p>a</p></article><div class=sidebar><article>no</article></div></div>", "a"),
        ("<body><div class='cookie-notice'>n</div><div id='content'><p>a</p><p class='notice'>b</p></div><div>out</div></body>", "a"),
        ("<article><p title='a>b'>ok</p><p>x <!-- c --> y</p>a < b<p>open <a href='u", "ok\n\nx y\n\na < b\n\nopen"),
        ('<article>unclosed "quote <b class="x>t</b> more</article>', 'unclosed "quote t more'),
        ("<article></article><p>outside</p>", ""),
        ("<html><head><title>t</title><style>p{}</style><p>para</html>", "para"),
        ("<table><tr><td>1<td>2<tr><td>3</table>", "1\n\n2\n\n3"),
        ("<div>" * 3000 + "deep" + "</div>" * 3000, "deep"),
        ("<script>never closed <p>x", ""),
        ("<article>" + "<p>word</p>" * 5000 + "</article>", "\n\n".join(["word"] * 5000)),
    ],
)
def test_main_text(html, text):
    assert text_of(html) == text


def plain_template(pages, least, percent):
    """For pages of ``<body><div>..</div>..</body>``: texts without divs that recur on different pages of a host."""
    divs = {i: re.findall(r"<div>(.*?)</div>", html) for i, _, html in pages}
    host = {i: url.split("/")[2].lower() for i, url, _ in pages}
    seen, sizes = {}, {}
    for i, own in divs.items():
        sizes.setdefault(host[i], set()).add(tuple(own))
        for d in own:
            seen.setdefault((host[i], d), set()).add(tuple(own))
    gone = {(h, d) for (h, d), pages_ in seen.items() if len(pages_) >= least and 100 * len(pages_) >= percent * len(sizes[h])}
    return {i: "\n\n".join(d for d in own if (host[i], d) not in gone) for i, own in divs.items()}


def test_templates_go_by_host(spark):
    pages = []
    for i in range(60):
        host = ["a.example", "B.example", "c.example"][i % 3]
        extra = "<div>Follow us</div>" if i % 3 == 0 else "<div>Follow us</div>" if i < 20 else ""
        pages.append((i, f"https://{host}/p{i}", f"<body><div>Menu of {host}</div>{extra}<div>Own text {i // 6 if i % 3 == 2 else i}</div></body>"))
    pages += [(100 + i, "http://d.example/x", "<body><div>The same page</div><div>again</div></body>") for i in range(40)]  # copies are one page
    df = spark.createDataFrame(pages, "page_id long, url string, html string").withColumns({"host": F.lit("clash"), "text": F.lit("x"), "content": F.lit(1), "template": F.lit(2)})
    got = {r.page_id: r.text for r in html_extraction.extract(df).collect()}
    assert got == plain_template(pages, 10, 5)
    assert "Menu" not in got[0] and "Follow" not in got[0] and "Follow" in got[1] and got[100] == "The same page\n\nagain"


def test_articles_keep_what_recurs_but_not_boxes(spark):
    page = lambda i: f"<article><h1>Daily news</h1><p>Good morning.</p><div><p>Read also our letter</p></div><p>Story {i}</p></article>"
    df = spark.createDataFrame([(i, "http://e.example/", page(i)) for i in range(30)], "page_id long, url string, html string")
    got = html_extraction.extract(df).collect()
    assert {r.text for r in got} == {f"Daily news\n\nGood morning.\n\nStory {i}" for i in range(30)} and {r.n_templates for r in got} == {1}
    assert all(r.n_chars == len(r.text) for r in got)


def test_odd_pages_have_rows(spark):
    odd = [(1, None, None), (1, "no host", "<p>a"), (None, "http://u@H.example:80/x", "<p>b</p>"), (1, "no host", "<p>a")]
    df = spark.createDataFrame(odd, "page_id long, url string, html string")
    assert rows(html_extraction.extract(df), "page_id", "url", "text", "n_chars") == sorted([(1, None, "", 0), (1, "no host", "a", 1), (None, "http://u@H.example:80/x", "b", 1), (1, "no host", "a", 1)], key=repr)
    assert df.select(html_extraction.host_of("url").alias("h")).filter("h = 'h.example'").count() == 1
    assert html_extraction.extract(df.limit(0)).count() == 0


# Operator 13


def plain_divergence(docs, least, ranks=50):
    terms = [(lang or "", source or "", [t for t in re.findall("[^\x00-\x40\x5b-\x60\x7b-\x7f]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))]) for _, text, lang, source, _ in docs]
    out = []
    for lang in {x[0] for x in terms}:
        own = [x for x in terms if x[0] == lang]
        docs_of = Counter(t for _, _, ts in own for t in set(ts))
        kept = sorted(t for t, n in docs_of.items() if n >= least)
        counts = {s: Counter(t for _, s2, ts in own if s2 == s for t in ts) for s in {x[1] for x in own}}

        def shares(c):
            total = sum(c[t] for t in kept)
            return {t: 1 + 1000000000 * (c[t] + 5) // (total + 5 * len(kept)) for t in kept}

        p = {s: shares(c) for s, c in counts.items()}
        q = shares(sum(counts.values(), Counter()))
        for s in p:
            pairs = sorted(((sum(abs(p[s][t] - p[o][t]) for t in kept), o) for o in p if o != s), key=lambda x: (-x[0], x[1].encode()))
            found = sorted(((p[s][t] - q[t], t) for t in kept if counts[s][t] and p[s][t] > q[t]), key=lambda x: (-x[0], x[1].encode()))[:ranks]
            for part, items in (("pair", pairs), ("term", found)):
                out += [(lang, s, part, item, value, k) for k, (value, item) in enumerate(items, 1)]
    return sorted(out, key=repr)


NAMES = ("lang", "source", "part", "item", "value", "rank")


def test_divergence_equals_the_plain_version(spark):
    texts = ["The cat; the DOG", "dog dog étude ÉTUDE naïve", "abcdefgh" * 40 + " abcd abcde", "a1b2_c", "", None, "漢字漢字 the", "w" * 70000 + " the cat"]
    docs = [(i % 7, texts[i % len(texts)], ["en", None, "de", ""][i % 4], ["s1", "s2", None, "", "é"][i % 5], None) for i in range(120)]
    docs += [(1, "lone", "xx", "s1", 1), (2, None, "xx", "s2", 1), (3, "once", "yy", None, 1)]
    df = spark.createDataFrame(docs, DOCS).withColumns({"term": F.lit("clash"), "n": F.lit(1), "item": F.lit("x"), "rank": F.lit(2), "terms": F.lit(3)})
    for least in (1, 3, 1000):
        assert rows(divergence_audit.divergence(df, least=least), *NAMES) == plain_divergence(docs, least)
    assert divergence_audit.divergence(df.limit(0)).count() == 0


def test_divergence_over_many_sources(spark):
    docs = [(i, f"common word{i % 9} w{i % 17} " * (1 + i % 3), "en", f"s{i % 300:03d}", None) for i in range(900)]
    got = divergence_audit.divergence(spark.createDataFrame(docs, DOCS), least=30)  # more sources than a tile
    assert rows(got, *NAMES) == plain_divergence(docs, 30)


def test_shares_are_exact_for_large_counts(spark):
    n, total, v = 10**15 + 7, 3 * 10**15 + 1, 12345
    row = spark.createDataFrame([(n, total, v)], "n long, total long, v long").select(divergence_audit.share("n", "total", "v").alias("p")).first()
    assert row.p == 1 + 1000000000 * (n + 5) // (total + 5 * v)


def test_new_queries_have_sql():
    assert {"op11_merkle_manifest", "op12_html_extraction", "op13_source_divergence"} <= queries.SQL.keys()
