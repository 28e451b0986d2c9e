"""Main text of pages: planted layouts, broken markup and a plain reading of the test pages."""

import html as htmllib
import random
import re

from brokerlens.llm.common import documents
from brokerlens.llm.html_extract import Shape, Slot, Wrapper, extract_text, host, induce, match, parse, q_op6, shape
from pyspark.sql import functions as F
from pyspark.sql import types as T

SF = "/root/testdata/sf0.01"
PAGE = T.StructType([T.StructField("page_id", T.LongType()), T.StructField("url", T.StringType()), T.StructField("html", T.StringType()),
                     T.StructField("host", T.StringType()), T.StructField("template", T.StringType())])


def pages(spark, rows):
    return spark.createDataFrame([(*r, "x", "y") for r in rows], PAGE)


def texts(spark, rows):
    return {r.page_id: r.text for r in extract_text(pages(spark, rows)).collect()}


def prose(seed, n=40):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(r.randrange(2, 9))) for _ in range(n))


def test_article_pages(spark):
    rows = documents(spark, SF, "pages").collect()
    got = {r.page_id: r for r in q_op6(spark, SF).collect()}
    assert len(got) == len(rows)
    for r in rows:
        inside = re.search(r"<article>(.*?)(?:</article>|\Z)", r.html, re.S)[1]
        blocks = re.split(r"<(?!/?b>)[^>]*>", inside)
        want = " ".join(t for b in blocks if (t := " ".join(htmllib.unescape(re.sub("</?b>", "", b)).split())))
        assert got[r.page_id].text == want and got[r.page_id].n_chars == len(want)


def layout(i, body, style):
    menu = "".join(f'<li><a href="/{prose(i * 7 + k, 1)}">{prose(i * 7 + k, 2)}</a></li>' for k in range(5))
    return {
        "div": f"<html><head><title>t{i}</title><style>p{{x}}</style></head><body><div class='top-menu'><ul>{menu}</ul></div><div id='wrap'>"
               f"<div class='post-body'><h1>{prose(i, 4)}</h1>{body}<div class='share-bar'>Share this story</div></div>"
               f"<div class='sidebar-right'><p>{prose(i + 900, 12)}</p></div></div><div class='notice'>We use things. Accept them all.</div>"
               f"<form action=/s><input name=q><button>Go</button></form><div id=comments><p>{prose(i + 500, 15)}</p></div>"
               f"<script>var a='<p>no</p>';</script></body></html>",
        "article": f"<body><header><h1>Site</h1></header><main><article><header><h1>{prose(i, 4)}</h1></header>{body}<aside>{prose(i + 1, 5)}</aside>"
                   f"<section class='comments'><article class='comment'>{prose(i + 2, 9)}</article></section></article></main><footer>{prose(i, 6)}</footer>",
        "plain": f"<body><table><tr><td>Home<td>About<td>Contact</table><div><div><p>All rights and more</p>{body}</div></div><p>Last built by machine</p></body>",
    }[style]


def test_layouts_without_their_frames(spark):
    rows, want = [], {}
    for n, style in enumerate(("div", "article", "plain")):
        for i in range(8):
            k = 100 * n + i
            paras = [prose(1000 * n + 10 * i + j, 30) for j in range(3 + i % 4)]
            body = "".join(f"<p>{p}</p>\n" for p in paras)
            rows.append((k, f"https://{style}.example.org/{i}", layout(i, body, style)))
            want[k] = " ".join(([prose(i, 4)] if style != "plain" else []) + paras)
    assert texts(spark, rows) == want


def test_broken_markup(spark):
    cases = {
        1: ("<article><p>one &amp; two&nbsp;three &#x41; &lt;b&gt;<p>four <b>fi</b>ve<br>six</article>", "one & two three A <b> four five six"),
        2: ("<article><p>cut in the mid", "cut in the mid"),
        3: ("<article><p>cut in a tag</p><p cla", "cut in a tag"),
        4: ("<ARTICLE><P>Upper</P><SCRIPT>if (a</b) x()</SCRIPT><!-- <p>no</p> --></ARTICLE>", "Upper"),
        5: ('<article><p title="a > b">quoted</p><p title="open>next</p></article>', "quoted next"),
        6: ("plain text, no tags", "plain text, no tags"),
        7: ("", ""), 8: (None, ""), 9: ("<article></article>", ""),
        10: ("<div>" * 3000 + "<p>deep</p>" + "</div>" * 3000, "deep"),
        11: ("<article>" + "<h2>a</h2><p>b</p>" * 3000 + "</article>", " ".join(["a b"] * 3000)),
        12: ("<article><ul><li>x<li>y<ul><li>z</ul></ul><table><tr><td>1<td>2<tr><td>3</table></article>", "x y z 1 2 3"),
    }
    rows = [(i, f"http://h{i}.example.com/", h) for i, (h, _) in cases.items()]
    got = texts(spark, rows)
    assert got == {i: t for i, (_, t) in cases.items()}


def test_page_edges(spark):
    rows = [(1, None, "<article>a</article>"), (1, None, "<article>a</article>"), (None, "not a url", "<article>b</article>"), (2, "http://u@H.example:80/x", None)]
    got = extract_text(pages(spark, rows)).collect()
    assert sorted(r.text for r in got) == ["", "a", "a", "b"]
    assert extract_text(pages(spark, rows).limit(0)).count() == 0
    assert pages(spark, rows).where("page_id = 2").select(host(F.col("url")).alias("h")).first().h == "h.example"


def test_cut_entities_stay():
    assert Wrapper(induce([])).text("<article><h1>a &am</h1></article>") == "a &am"


def test_constant_nodes_become_template():
    w = Wrapper(induce([f"<article><p>{prose(i)}</p><div>Read on at our site</div></article>" for i in range(5)]))
    assert w.text(f"<article><p>{prose(77)}</p><div>Read on at our site</div></article>") == prose(77)
    assert w.text(f"<article><p>{prose(77)}</p><div>Another end</div></article>") == prose(77) + " Another end"


def test_simple_tree_matching_is_largest():
    def tree(label, *kids):
        return Shape(label, list(kids), [])
    a = tree("r", tree("a", tree("x")), tree("b"), tree("c", tree("y"), tree("z")))
    b = tree("r", tree("b"), tree("a", tree("x")), tree("c", tree("z")))
    assert match(a, b, {}) == 1 + 2 + 2      # root, a with x, c with z
    assert match(a, a, {}) == 7 and match(a, tree("s"), {}) == 0
    s = shape([parse("<ul><li>1<li>2<li>3</ul><p>x</p>")])
    assert [k.label for k in s.kids] == ["ul", "p"] and len(s.kids[0].kids) == 1
    slot = Slot.load(induce(["<p>x</p><p>y</p>", "<p>x</p>", "<p>z</p><p>x</p>"]).dump())
    assert slot.kids[0].constant == {"x"} and slot.kids[0].size == 2


def test_class_words_do_not_drop_articles():
    alone = Wrapper(induce([]))
    for page in ('<article class="post no-comments"><p>kept</p></article>', '<div class="content has-sidebar"><p>kept</p></div>',
                 '<article class="post category-social tag-legal"><p>kept</p></article>', '<div class="sidebar"><p>kept</p></div>',
                 '<article><section id="social-impact">kept</section></article>', '<article><div id="side-effects">kept</div></article>',
                 '<article><h2 id="the-search-for-life">kept</h2></article>', '<main><section class="legal">kept</section></main>',
                 '<article><p aria-hidden="false">kept</p></article>', '<article><p title="Hidden gems, class=ads">kept</p></article>',
                 '<article data-id="search-9"><p data-role="menu">kept</p></article>', "<article><p title='a hidden b'>kept</p></article>"):
        assert alone.text(page) == "kept", page
    assert alone.text('<article><p>kept</p><p hidden>no</p><p style="display: none">no</p><p role=menu>no</p></article>') == "kept"
    assert alone.text('<article><p>kept</p><article class="comment">no</article></article><article class="teaser">no</article>') == "kept"


def test_template_overrules_class_words():
    def page(i):
        return f'<body><div class="promo-wrap"><p>{prose(i, 60)}</p></div><div class="promo-box"><p>{prose(i + 50, 5)}</p></div><p>{prose(i + 90, 3)}</p>'
    w = Wrapper(induce([page(i) for i in range(6)]))
    assert w.text(page(20)) == prose(20, 60)
    marked = [f'<div class="widget"><article><p>{prose(i, 60)}</p></article></div><div class="widget-small"><article>{prose(i + 50, 5)}</article></div>' for i in range(7)]
    assert Wrapper(induce(marked[:6])).text(marked[6]) == prose(6, 60)


def test_dropped_elements_end_where_they_end():
    cases = {
        '<article><p>one <svg class="i"/> two</p><p>three</p></article>': "one two three",
        "<article><p>one <svg><path d='x>y'/><text>no</text></svg> two</p></article>": "one two",
        "<article><p>one <svg> two</p><p>three <svg>no <svg/> <svg>no</svg> no</svg> four</p></article>": "one two three four",
        "<article><p>let <math><mi>x</mi><mo>=</mo><mn>2</mn></math> and <math/> so on</p></article>": "let x=2 and so on",
        "<article><object data=a><p>told instead</p></object> after</article>": "told instead after",
        "<article><p>one</p><iframe src=a><p>two</p><canvas><p>three</p><noscript><p>four</p></article>": "one two three four",
        "<article><p>one</p><iframe src=a>no</iframe><canvas>no</canvas><select><option>no</select><p>two</p></article>": "one two",
        "<article><p>one</p><select><option>no<option>no<p>two</p></article>": "one two",
        "<article><p>one</p><script>'<svg>'</script><!-- <svg> --><p>two</p><svg>no</svg><p>three</p><style>p{}": "one two three",
    }
    alone = Wrapper(induce([]))
    assert {page: alone.text(page) for page in cases} == cases


def two_layouts(rare, common):
    """Pages of one host: ``common`` ones with an article element, ``rare`` ones of another layout without."""
    rows, want = [], {}
    for i in range(common + rare):
        paras = [prose(20_000 + 10 * i + j, 30) for j in range(3)]
        body = "".join(f"<p>{p}</p>" for p in paras)
        if i < rare:
            page = (f"<body><div class=bar>Home and away</div><div class=x1><div class=y1>{body}<p>First told in our paper</p></div><div class=z1>Read our other stories</div></div>"
                    f"<div class=low>All rights are ours</div></body>")
        else:
            page = f"<body><div class=top>Welcome to us</div><article>{body}<p>Thanks for reading all this</p></article><div class=end>{prose(i, 5)}</div></body>"
        rows.append((i, f"https://two.example.org/{i}", page))
        want[i] = " ".join(paras)
    return rows, want


def test_a_rare_layout_keeps_its_text_and_loses_its_frame(spark):
    rows, want = two_layouts(10, 190)
    assert texts(spark, rows) == want


def test_seeds_change_no_result(spark):
    rows, want = two_layouts(10, 60)
    for seeds in (1, 3, 40):
        assert {r.page_id: r.text for r in extract_text(pages(spark, rows), seeds).collect()} == want


def test_the_votes_change_the_text_of_pages_without_article(spark):
    """The same pages read alone keep their frame: what goes, goes by the counts over all pages."""
    rows, want = two_layouts(30, 0)
    got = texts(spark, rows)
    alone = Wrapper(induce([]), {})
    assert got == want and all(alone.text(page) != want[i] for i, _, page in rows)


def test_repeated_rows_vote_once(spark):
    """Four pages, one of them 3,000 times: its paragraph is not on most of the distinct pages."""
    rows = [(i, "https://r.example.org/", f"<article><p>{prose(i)}</p><div>Read on at our site</div></article>") for i in range(4)]
    got = extract_text(pages(spark, rows + [rows[0]] * 3000)).groupBy("page_id", "text").count().collect()
    assert {(r.page_id, r.text): r["count"] for r in got} == {(i, prose(i)): 3001 if i == 0 else 1 for i in range(4)}


def test_a_constant_footer_in_another_language_on_one_page(spark):
    rows = [(i, "https://f.example.org/", f"<article><p>{prose(i)}</p><div>{'Weiter lesen' if i == 3 else 'Read on here'}</div></article>") for i in range(20)]
    got = texts(spark, rows)
    assert all(got[i] == prose(i) for i in range(20) if i != 3) and got[3] == prose(3) + " Weiter lesen"


def test_every_page_of_another_layout(spark):
    """Pages that share no blocks with any other keep their varying text."""
    rows = [(i, "https://v.example.org/", f"<body><div class=k{'abcdefghij'[i]}x><section class={'abcdefghij'[i]}><p>{prose(i, 30)}</p></section></div>") for i in range(10)]
    assert texts(spark, rows) == {i: prose(i, 30) for i in range(10)}
