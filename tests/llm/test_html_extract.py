import random
import re

import pytest

from sanmaru.llm.html_extract import Group, Wrapper, align, expression, extract, extract_pages, fold, infer_wrapper, parse, tokens, _bounded

CASES = {
    "plain": ("<html><body><article><h1>A &amp; B</h1><p>One\n two</p><p>Three<br>four</article></body></html>", "A & B\n\nOne two\n\nThree four"),
    "chrome": ("<body><nav>menu</nav><header>site</header><div class='cookie-notice'>ok?</div><div id=sidebar>side</div><article><header><h1>T</h1></header><p>x</p><div class='ad'>buy</div><form>f<input></form><section class='comments'><p>nice</p></section></article><footer>f</footer></body>", "T\n\nx"),
    "raw": ("<article><script>var a='</p><article>';</script><style>p{}</style><p>x<!-- <p>no</p> -->y</p><noscript>n</noscript></article>", "xy"),
    "broken": ("<body><nav><ul><li>a<li>b</ul></nav><article><p><b>bold<br><p>next</b> one</p><p>end &am", "bold\n\nnext one\n\nend &am"),
    "cut tag": ("<article><p>text</p><p cla", "text"),
    "references": ("<article>&eacute;&#233;&#xe9;&lt;p&gt;&nbsp;x &unknown; &copy 5</article>", "ééé<p> x &unknown; © 5"),
    "comment article": ("<article><p>main</p></article><article class='comment'><p>reader</p></article>", "main"),
    "case": ("<BODY><ARTICLE><P>Up</P></ARTICLE></BODY>", "Up"),
    "lists": ("<article><ul><li>a</li><li>b <i>c</i></li></ul><table><tr><td>1<td>2</table></article>", "a\n\nb c\n\n1\n\n2"),
    "attribute": ('<article><p title="a > b">x</p></article>', "x"),
    "no article": ("<body><div class=menu>m</div><div><h1>T</h1><p>x</p></div><div class=footer>f</div></body>", "T\n\nx"),
    "empty": ("", ""),
    "layout class": ('<div class="layout has-sidebar"><article><p>Main text</p></article><div class="sidebar">s</div></div>', "Main text"),
    "state class": ('<div class="no-sidebar comments-open"><main><p>Main</p></main></div>', "Main"),
    "holds it": ('<div class="widget"><main><p>Main</p></main></div>', "Main"),
    "textual names": ('<article><h2 id="notice">N</h2><h2 class="related">R</h2><p class="share-price">P</p><p id="social-history">H</p><section id="discussion"><p>D</p></section></article>', "N\n\nR\n\nP\n\nH\n\nD"),
    "form around": ("<form><main><p>a</p><button>b</button></main></form>", "a"),
    "deep": ("<div>" * 5000 + "<article><p>far</p></article>", "far"),
}


@pytest.mark.parametrize("name", CASES)
def test_extract(name):
    source, want = CASES[name]
    assert extract(source) == want


def page(i):
    extra = f"<p>more {i}</p>" * (i % 3)
    return f"<body><div class=x1><a>Home</a><a>About</a></div><div class=c><h2>Title {i}</h2><p>Body {i} with words</p>{extra}</div><div class=x2>Terms of use</div></body>"


def test_wrapper_finds_slots_groups_and_template():
    wrapper = infer_wrapper([page(i) for i in range(6)])
    assert expression(wrapper) == r"<body><div\.x1>(?:<a>[^<>]+</a>)+</div\.x1><div\.c><h2>[^<>]+</h2>(?:<p>[^<>]+</p>)+</div\.c><div\.x2>Terms\ of\ use</div\.x2></body>".join(["<>", "</>"])
    assert extract(page(7), Wrapper(wrapper)) == "Title 7\n\nBody 7 with words\n\nmore 7"


def tree(rng, depth=0):
    """A random page: few labels, so that sequences collide, repeat and lack parts."""
    out = ""
    for _ in range(rng.randrange(4)):
        if depth > 3 or rng.random() < 0.3:
            out += rng.choice(["one", "two", "three"]) if not out.endswith(("one", "two", "three")) else ""
        else:
            tag = rng.choice(["div", "section", "span class=k", "ul"])
            out += f"<{tag}>{tree(rng, depth + 1)}</{tag.split()[0]}>"
    return out


@pytest.mark.parametrize("seed", range(60))
def test_aligned_wrapper_matches_every_page(seed):
    """Brute force: the expression of a wrapper, run by ``re``, matches the token stream of each page it is made of."""
    rng = random.Random(seed)
    pages = [parse(tree(rng)) for _ in range(6)]
    halves = []
    for part in (pages[:3], pages[3:]):
        one = fold(part[0])
        for p in part[1:]:
            align(one, fold(p))
        halves.append(Group.load(one.dump()))
    align(halves[0], halves[1])
    for p in pages:
        assert re.fullmatch(expression(halves[0]), tokens(p)), (expression(halves[0]), tokens(p))


def test_wrappers_stay_bounded():
    pages = ["<body>" + "".join(f"<div class=c{i}{k}><p class=p{i}{k}>{i} {k}</p></div>" for k in range(300)) + "</body>" for i in range(30)]
    wrapper = infer_wrapper(pages)
    assert _bounded(wrapper).size() <= 4000
    assert extract(pages[3], Wrapper(wrapper)).count("\n\n") == 299
    deep = infer_wrapper(["<div>" * 5000 + str(i) for i in range(4)])
    assert deep.size() < 70


def test_layouts_that_only_some_pages_have():
    """Both layouts of a host yield their own content, and a page that breaks off doesn't empty the template."""
    menu = "<div class=top><a>Home</a><b>Our site</b></div>"
    one = [f"<body>{menu}<div class=story><p>Story {i} " + "word " * 30 + f"</p></div><div class=low>Some long constant text at the end of pages</div></body>" for i in range(40)]
    two = [f"<body>{menu}<div class=gallery><p>Picture {i} " + "word " * 30 + f"</p></div><div class=low>Some long constant text at the end of pages</div></body>" for i in range(5)]
    wrapper = Wrapper(infer_wrapper([*one, *two, "", "<body>", f"<body>{menu}"]))
    assert extract(one[7], wrapper).startswith("Story 7") and "constant" not in extract(one[7], wrapper)
    assert extract(two[3], wrapper).startswith("Picture 3") and "Our site" not in extract(two[3], wrapper)


def test_the_wrapper_chooses_among_articles():
    """Pages whose teasers are articles, too: the host's slots tell which is the page's own; without a wrapper all stay."""
    teaser = lambda i: f"<div class=more><article><h3>Teaser {i}</h3></article><article><h3>Teaser {i + 1}</h3></article></div>"
    pages = [f"<body><div class=page><article><h1>Own {i}</h1><p>" + f"sentence {i} of the text. " * 20 + f"</p><p>Same end.</p></article></div>{teaser(i)}</body>" for i in range(12)]
    with_wrapper, without = extract(pages[4], Wrapper(infer_wrapper(pages))), extract(pages[4], Wrapper(None))
    assert with_wrapper.startswith("Own 4") and with_wrapper.endswith("Same end.") and "Teaser" not in with_wrapper
    assert "Teaser" in without


@pytest.mark.parametrize("seed", range(8))
def test_pages_without_any_semantic_tag(seed):
    """Layouts of divs, spans and tables with names that tell nothing, against their known texts."""
    rng = random.Random(seed)
    word = lambda: "".join(rng.choice("abcdefghij") for _ in range(rng.randrange(2, 8)))
    name, box = [f"x{rng.randrange(10**6)}" for _ in range(6)], rng.choice(["div", "table"])
    around = lambda cls, inner: f"<div class={cls}>{inner}</div>" if box == "div" else f"<table><tr><td class={cls}>{inner}</td></tr></table>"
    top, low = " ".join(word() for _ in range(6)), " ".join(word() for _ in range(12))
    links = "".join(f"<span>{word()} {word()}</span>" for _ in range(rng.randrange(2, 6)))
    pages, texts = [], []
    for _ in range(25):
        blocks = [" ".join(word() for _ in range(rng.randrange(8, 60))) for _ in range(rng.randrange(1, 6))]
        extra = around(name[3], low) if rng.random() < 0.5 else ""  # optional, and constant where it stands
        pages.append(f"<body>{around(name[0], top + links)}{around(name[1], ''.join(f'<p>{b}</p>' for b in blocks))}{extra}{around(name[2], low)}</body>")
        texts.append("\n\n".join(blocks))
    wrapper = Wrapper(infer_wrapper(pages))
    assert [extract(p, wrapper) for p in pages] == texts
    assert sum(extract(p, Wrapper(None)) == t for p, t in zip(pages, texts, strict=True)) == 0


def test_pages(spark):
    rows = [(i, f"http://h.x/{i}", page(i), "clash", 0) for i in range(20)] + [(50, None, CASES["plain"][0], "c", 0), (51, "x", None, "c", 0), (52, "http://big/", "<p>w</p>" * 20_000, "c", 0), (3, "http://h.x/3", page(3), "c", 0), (53, "http://deep/", CASES["deep"][0], "c", 0)]
    rows += [(60 + i, "http://copies/", f"<div class=a><p>same</p></div>", "c", 0) for i in range(5)]
    got = extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string, host string, n_chars int")).collect()
    assert len(got) == len(rows)
    by = {r.page_id: r.text for r in got}
    assert by[4] == "Title 4\n\nBody 4 with words\n\nmore 4" and by[50] == CASES["plain"][1] and by[51] == "" and by[53] == "far"
    assert all(by[60 + i] == "same" for i in range(5))  # copies count as one page
    assert by[52].count("w") == 20_000 and all(r.n_chars == len(r.text) for r in got)
    assert extract_pages(spark.createDataFrame([], "page_id long, url string, html string")).count() == 0


def test_template_in_repeated_groups_is_counted_over_all_pages(spark):
    """Items that a list without any telling name has on nearly all pages go; one short page doesn't bring them back."""
    links = "<div class=k1><span>Alpha section</span><span>Beta section</span><span>Gamma section</span></div>"
    rows = [(i, "http://h.x/", f"<body>{links}<div class=k2><p>Text {i}</p></div><p>end {i}</p></body>") for i in range(30)] + [(30, "http://h.x/", "<body><div class=k1><span>Alpha section</span></div></body>")]
    got = {r.page_id: r.text for r in extract_pages(spark.createDataFrame(rows, "page_id long, url string, html string").repartition(5)).collect()}
    assert got[4].endswith("Text 4\n\nend 4") and "section" not in got[4]


def test_accuracy_on_pages(spark):
    """Pages of the data against a plain reading of their article element."""
    import html as h

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in extract_pages(pages).collect()}
    for r in pages.collect():
        article = re.search(r"<article>(.*?)</article>", r.html, re.S)[1]
        blocks = re.split(r"</?(?:p|h1)>", article.replace("<br>", " ").replace("<b>", "").replace("</b>", ""))
        assert got[r.page_id] == "\n\n".join(filter(None, (" ".join(h.unescape(re.sub(r"<[a-z/!][^>]*>", "", b)).split()) for b in blocks)))
