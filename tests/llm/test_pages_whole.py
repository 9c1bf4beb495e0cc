from mediajobs.llm import pages

SCHEMA = "page_id long, url string, html string, text string"


def text(source):
    return pages.main_text(source, None, frozenset())


def test_names_of_wrappers_and_sections_drop_no_article():
    side = "<div class=sidebar><p>side</p></div>"
    assert text(f'<div id="content" class="has-sidebar"><article><p>one</p></article>{side}</div>') == "one"
    assert text(f'<div class="layout sidebar-right"><article><p>one</p></article>{side}</div>') == "one"
    assert text(f'<div class="layout sidebar-right"><div><p>one and two and three</p></div>{side}</div>') == "one and two and three"
    sections = '<section id="related-work"><h2>Related work</h2><p>r</p></section><section id="search"><p>s</p></section><h2 id="copyright">Copyright</h2><p>c</p>'
    assert text(f"<article>{sections}</article>") == "Related work\n\nr\n\ns\n\nCopyright\n\nc"
    assert text(f"<div id=content>{sections}</div>") == "Related work\n\nr\n\ns\n\nCopyright\n\nc"
    # what is no part of the article still goes
    assert text("<article><p>a</p><section id=comments><p>c</p></section><div class='comment-list'>d</div></article><div class='related-posts'><article>e e e e</article></div>") == "a"
    assert text("<div class='page has-sidebar'><main><p>m</p><div class=related><article>teaser teaser</article></div></main></div>") == "m"
    assert text("<p>some text of a page</p><div class=comments>longer longer longer longer longer longer</div>") == "some text of a page"


def hosted(spark, sources):
    rows = [(i, f"http://h.example/{i}", x, "x") for i, x in enumerate(sources)]
    return [r.text for r in pages.extract(spark.createDataFrame(rows, SCHEMA).repartition(3)).orderBy("page_id").collect()]


def test_text_beside_the_longest_element_is_kept(spark):
    lead, more = "a lead of not so many words " * 3, "and the longest part of the page " * 20
    parts = [lead.strip(), more.strip()]
    assert text(f"<body><h1>Head</h1><p>{lead}</p><div>{more}</div></body>") == "\n\n".join(["Head", *parts])
    assert text(f"<body><div>{lead}</div><div>{more}</div></body>") == "\n\n".join(parts)
    assert text("<div>one</div><div>two three four five</div>") == "one\n\ntwo three four five"
    got = hosted(spark, [f"<body><h1>Head {i}</h1><p>{i} {lead}</p><div class=b><p>{i} {more}</p></div></body>" for i in range(12)])
    assert got == [f"Head {i}\n\n{i} {parts[0]}\n\n{i} {parts[1]}" for i in range(12)]


def test_copies_of_a_page_are_no_template(spark):
    for tag in ("main", "div"):
        copy = f"<body><{tag}><h1>Head</h1><p>the same text on each of many pages</p></{tag}></body>"
        assert set(hosted(spark, [copy] * 8)) == {"Head\n\nthe same text on each of many pages"}
        others = [f"<body><{tag}><h1>Other {i}</h1><p>text of page {i} and of no other</p></{tag}></body>" for i in range(6)]
        got = hosted(spark, [copy] * 94 + others)
        assert got == ["Head\n\nthe same text on each of many pages"] * 94 + [f"Other {i}\n\ntext of page {i} and of no other" for i in range(6)]


def test_joined_templates_equal_broadcast_ones(spark):
    rows = [(i, f"http://h{i % 2}.example/{i}", f"<body><div><p>menu</p></div><div class=b><p>text {i}</p></div></body>", "x") for i in range(24)]
    df = spark.createDataFrame(rows, SCHEMA)
    got, joined = (sorted(map(tuple, pages.extract(df, small=n).collect())) for n in (pages.SMALL, 0))
    assert got == joined and [r[2] for r in got] == [f"text {i}" for i in range(24)]
