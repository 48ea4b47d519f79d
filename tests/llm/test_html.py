from quillforge.llm import html_extract


def extracted(spark, pages):
    rows = [(i, "http://d.example/", p) for i, p in enumerate(pages)]
    return [r.text for r in sorted(html_extract.extract(spark.createDataFrame(rows, "page_id long, url string, html string")).collect(), key=lambda r: r.page_id)]


def test_wrapper_decides_inside_articles(spark):
    """The same first and last paragraphs in every page's article, and one with a path of its own."""
    page = "<body><article><p>Read on the site</p><p>Text {0}</p><p>More {0}</p><p>Write to us</p><div class=end>All rights</div></article></body>"
    assert extracted(spark, [page.format(i) for i in range(6)]) == [f"Text {i}\nMore {i}" for i in range(6)]


def test_class_names_do_not_overrule_the_wrapper(spark):
    page = "<body><div class=top>Site name</div><div class='with-sidebar'><article><p>Text {0}</p></article></div></body>"
    assert extracted(spark, [page.format(i) for i in range(6)]) == [f"Text {i}" for i in range(6)]


def test_an_article_that_is_all_constant_stays(spark):
    page = "<body><div class=date>day {0}</div><article><p>Text</p></article></body>"
    assert extracted(spark, [page.format(i) for i in range(6)]) == ["Text"] * 6


def test_headings_and_names_of_other_things_stay(spark):
    page = '<body><article><h2 id="side-effects">Effects {0}</h2><h2 class="share-price">Price {0}</h2><p class="menu-of-the-day">Soup {0}</p><div class="related-posts">x {0}</div><div id=cookie-notice>y {0}</div></article></body>'
    assert extracted(spark, [page.format(i) for i in range(5)]) == [f"Effects {i}\nPrice {i}\nSoup {i}" for i in range(5)]


def test_repeated_deep_and_long_pages_and_other_columns(spark):
    deep = "<div>" * 3000 + "<p>deep" + "</div>" * 3000
    long = "<article>" + "".join(f"<p>part {i}</p>" for i in range(20000)) + "</article>"
    plain = "<nav>menu</nav><article><p>a &lt;b&gt; c</p><p>d\n\t e</p></article>"
    rows = [(1, "http://h.example/1", plain, "x", "y")] * 3 + [(2, "http://h.example/2", deep, None, None), (3, "http://h.example/3", long, None, None), (None, None, None, None, None)]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, host string, paths string")
    got = html_extract.extract(df).collect()
    assert len(got) == 6 and all(r.text == "a <b> c\nd e" and r.n_chars == 11 for r in got if r.page_id == 1)
    assert next(r for r in got if r.page_id == 2).text == "deep" and next(r for r in got if r.page_id == 3).text == "\n".join(f"part {i}" for i in range(20000))
