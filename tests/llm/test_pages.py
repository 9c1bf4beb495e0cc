import random

from mediajobs.llm import pages

SCHEMA = "page_id long, url string, html string, text string"


def page(i, title, body, extra=""):
    return (
        f"<!DOCTYPE html><html><head><title>{title}</title><style>p{{}}</style><script>var t='</p>';</script></head><body>"
        f"<header>Site <b>name</b></header><nav><ul><li><a href=/a>a{i}</a></li></ul></nav><div class='ad'>buy {i}</div>"
        f"<article><h1>{title}</h1>{body}<div class=comments><p>nice {i}</p></div></article>{extra}"
        f"<aside>other {i}</aside><form><label>Mail</label><input></form><footer>&copy; x</footer></body></html>"
    )


def test_main_text_by_tags():
    body = "<p>One &amp; two\n  three<br>four<p>A <b>bold <i>word</i></b>.<p>&lt;tag&gt; &#233;&nbsp;e"
    assert pages.main_text(page(1, "T", body), None, frozenset()) == "T\n\nOne & two three four\n\nA bold word.\n\n<tag> é e"
    assert pages.main_text("", None, frozenset()) == ""
    assert pages.main_text("plain  text", None, frozenset()) == "plain text"
    assert pages.main_text("<p>a<div>b</p>c</div></span></x>d", None, frozenset()) == "a\n\nb\n\nc\n\nd"
    assert pages.main_text("<p>a <!-- <p>no</p> --> b<script>if (a<b) {}</script> c", None, frozenset()) == "a b c"
    assert pages.main_text("<article><header><h2>Head</h2><p>by me</p></header>x</article>", None, frozenset()) == "Head\n\nx"
    assert pages.main_text("<div hidden>h</div><div style='display: none'>n</div><p>y", None, frozenset()) == "y"
    assert pages.main_text("<p>" + "long " * 100_000, None, frozenset()) == ("long " * 100_000).strip()


def hosted(r, n):
    """Pages of a host without any telling tag or name."""
    rows, want = [], []
    for i in range(n):
        paragraphs = [" ".join(f"w{r.randrange(500)}" for _ in range(30)) for _ in range(r.randrange(2, 6))]
        text = "".join(f"<p>{p}</p>" for p in paragraphs)
        html = f"<body><div class=left><div>Join our club</div><div>u{i}</div></div><div class=right>{text}<div>Read more here</div></div></body>"
        rows.append((i, "http://h.example.org/" + str(i), html, "x"))
        want.append("\n\n".join(paragraphs))
    return rows, want


def test_template_of_a_host(spark):
    rows, want = hosted(random.Random(2), 30)
    rows += [(100, None, page(1, "T", "<p>x"), "x"), (101, "not a url", None, "x"), (None, "http://one.example/", "<p>q", "x")]
    rows += [(102, "http://h.example.org/other", "<body><p>quite different</body>", "x"), rows[3]]
    out = pages.extract(spark.createDataFrame(rows, SCHEMA).repartition(3)).collect()
    assert len(out) == len(rows)
    got = {r.page_id: r.text for r in out}
    assert [got[i] for i in range(30)] == want
    assert got[100] == "T\n\nx" and got[101] == "" and got[None] == "q" and got[102] == "quite different"
    assert all(r.n_chars == len(r.text) for r in out)
    assert pages.extract(spark.createDataFrame([], SCHEMA)).count() == 0


def test_classes_slot_and_nesting_equal_brute_force(spark):
    """Occurrence vectors in full, on pages whose items vary in number."""
    r = random.Random(5)
    sources = []
    for i in range(14):
        items = "".join(f"<li><a href=x>l{r.randrange(90)}</a></li>" for _ in range(r.randrange(1, 5)))
        extra = "<section>now and then</section>" if i % 3 == 0 else ""
        sources.append(f"<body><div class=top><ul>{items}</ul><div>Join us</div></div><div class=mid><h1>T{i}</h1><p>text {i} " + "w " * r.randrange(5, 40) + f"</p><div class=share>Share this</div></div>{extra}</body>")
    vectors, paths = {}, {}
    for k, source in enumerate(sources):
        page = pages.parse(source)
        for e in page.elements:
            t = pages._hash(e.path)
            paths[t] = e.path
            vectors.setdefault((pages.ELEMENT, t), [0] * 14)[k] += 1
        for owner, text in page.blocks:
            vectors.setdefault((pages.BLOCK, pages._token(page, owner, text)), [0] * 14)[k] += 1
    groups = {}
    for (kind, t), v in vectors.items():
        if sum(x > 0 for x in v) >= 0.9 * 14:
            groups.setdefault(tuple(v), []).append((kind, t))
    want = sorted(sorted(t for _, t in g) for g in groups.values() if len(g) > 1 and any(kind == pages.ELEMENT for kind, _ in g))
    rows = [("h", x) for x in sources + sources[:3]]
    got = pages.templates(spark.createDataFrame(rows, "host string, html string").repartition(3)).collect()
    assert len(got) == 1 and got[0].pages == 14
    assert sorted(sorted(c.tokens) for c in got[0].classes) == want
    assert paths[got[0].slot] == "body/div.mid"
    assert len(got[0].texts) == 2  # what is on all pages, in the slot and beside it
    assert paths[got[0].classes[0].tokens[0]] == "body" and got[0].classes[0].within == -1
    inner = [c.within for c in got[0].classes[1:]]
    assert all(w == 0 for w in inner)


def test_what_the_template_decides(spark):
    """Pages of the test table without their telling tags and names: the template finds the same text, their own elements don't."""
    import re

    rows = spark.read.parquet("/root/testdata/sf0.001/pages.parquet").collect()
    names = {"nav": "xa", "footer": "xb", "article": "xc", "aside": "xd", "header": "xe"}

    def plain(html):
        html = re.sub(r'class="[^"]*"', 'class="xf"', html)
        for tag, name in names.items():
            html = re.sub(rf"<{tag}[^>]*>", f'<div class="{name}">', html)
            html = html.replace(f"</{tag}>", "</div>")
        return html

    table = [(i, f"http://one.example/{r.page_id}", plain(r.html), "x") for i, r in enumerate(rows)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(table, SCHEMA)).collect()}
    want = {i: pages.main_text(r.html, None, frozenset()) for i, r in enumerate(rows)}
    alone = {i: pages.main_text(t[2], None, frozenset()) for i, t in enumerate(table)}
    same = sum(got[i] == want[i] for i in want)
    assert same >= 0.95 * len(want)
    assert sum(alone[i] == want[i] for i in want) <= 0.05 * len(want)


def test_text_of_the_template_in_articles(spark):
    share = "<p>Share this article with your friends</p>"
    long = lambda i: " ".join(f"w{i}x{k}" for k in range(40))
    rows = [(i, f"http://a.example/{i}", f"<body><article><h2>Summary</h2><p>{long(i)}</p>{share}</article></body>", "x") for i in range(12)]
    got = [r.text for r in pages.extract(spark.createDataFrame(rows, SCHEMA)).orderBy("page_id").collect()]
    assert got == [f"Summary\n\n{long(i)}" for i in range(12)]
    # near copies of one article keep what they share
    rows = [(i, f"http://a.example/{i}", f"<body><article><p>{long(0)}</p><p>own {i}</p>{share}</article></body>", "x") for i in range(12)]
    got = [r.text for r in pages.extract(spark.createDataFrame(rows, SCHEMA)).orderBy("page_id").collect()]
    assert got == [f"{long(0)}\n\nown {i}\n\nShare this article with your friends" for i in range(12)]


def test_line_of_many_pages_stays_in_the_article(spark):
    rows = [(i, f"http://a.example/{i}", page(i, f"T{i}", ("<p>often seen</p>" if i % 3 else "") + f"<p>own {i}"), "x") for i in range(20)]
    got = {r.page_id: r.text for r in pages.extract(spark.createDataFrame(rows, SCHEMA)).collect()}
    for i in range(20):
        assert got[i] == "\n\n".join([f"T{i}"] + ["often seen"] * bool(i % 3) + [f"own {i}"])
