import html
import random
import re
from html.parser import HTMLParser

from millrace.llm import html_text
from millrace.llm.html_text import blocks, extract, main_text, op2_html_text

LONG = "The quick end of the line is that it was a long way to the house and that all of the people in it had to go out and see what was there in the dark"
OTHER = "It is the other part of the story in which they go back to the town and are not seen again by any of those who had been with them on the way"


def article(page):
    """The text between the article's tags, block by block."""
    m = re.search(r"<article>(.*?)(</article>|$)", page, re.S)
    parts = [" ".join(html.unescape(re.sub(r"<[^>]*>", "", x)).split()) for x in re.split(r"</?(?:p|h1)>", m[1].replace("<br>", " "))]
    return "\n\n".join(x for x in parts if x)


def test_pages(spark, sf):
    want = {r.page_id: (r.url, article(r.html)) for r in spark.read.parquet(sf("sf0.001") + "/pages.parquet").collect()}
    for r in op2_html_text(spark, sf("sf0.001")).collect():
        assert (r.url, r.text) == want[r.page_id] and r.n_chars == len(r.text)


def test_rows(spark):
    rows = [(1, "u", None), (2, None, ""), (None, "u", f"<p>{LONG}</p>"), (3, "u", f"<p>{LONG}</p>"), (3, "u", f"<p>{LONG}</p>"), (4, "u", "no markup of the page at all")]
    df = spark.createDataFrame(rows, "page_id int, url string, html string").selectExpr("*", "'t' AS text", "9 AS n_chars")
    got = extract(df).collect()
    assert sorted((r.page_id or 0, r.text, r.n_chars) for r in got) == sorted([(1, "", 0), (2, "", 0), (0, LONG, len(LONG)), (3, LONG, len(LONG)), (3, LONG, len(LONG)), (4, rows[-1][2], 28)])
    assert extract(df.limit(0)).count() == 0


def test_all_that_is_not_the_article_goes():
    page = f"""<!DOCTYPE html><html><head><title>T of the page</title><style>p {{}}</style><script>var a = "</p><p>{LONG}</p>";</script></head>
    <body class="has-sidebar"><!-- <p>{LONG}</p> --><header><h1>Site of the year</h1><p>{OTHER}</p></header><nav><ul><li><a href="/">Home of it</a></ul></nav>
    <div class="cookie-notice">{OTHER}</div><div id="ad-top" class="advert">{OTHER}</div>
    <div id="wrap"><article><header><h1>Title &amp; more</h1></header><p>{LONG} a&nbsp;&lt;b&gt; <b>bo</b>ld<br>x</p><p>No.</p><h2>Sub</h2><p>{OTHER}</p>
    <ul><li>First</li><li>Second</li></ul><form><p>{LONG}</p></form><div class="share"><a href="1">Share this</a></div>
    <section id="comments"><h3>Comments</h3><article class="comment"><p>{LONG} I say.</p></article></section></article>
    <aside><p>{OTHER}</p></aside></div><div class="comments-area"><p>{OTHER}</p></div><footer><p>&copy; 2020 {OTHER}</p></footer></body></html>"""
    assert main_text(page).split("\n\n") == ["Title & more", f"{LONG} a <b> bold x", "No.", "Sub", OTHER, "First", "Second"]


def test_pages_without_an_article_element():
    page = f"""<body><div class="menu"><a href=1>One</a> <a href=2>Two</a></div><p><a href=3>Read more</a> | <a href=4>of it</a></p><div class="header-wrap"><h1>The title</h1><p>{LONG}</p><p>Short one.</p><p>{OTHER}</p></div>
    <p><a href="x">Next page of the story</a></p><div class="reader-comments"><p>{LONG} {LONG} {LONG} {LONG}</p></div><p>&copy; 2020 of the site and its owners in the town</p></body>"""
    assert main_text(page).split("\n\n") == ["The title", LONG, "Short one.", OTHER]


def test_short_blocks_take_after_the_nearest():
    links = "".join(f"<p><a href=/{i}>A link to the page {i}</a></p>" for i in range(5))
    assert main_text(f"<body>{links}<p>Near links.</p>{links}<p>{LONG}</p><p>Near text.</p><p>{OTHER}</p></body>").split("\n\n") == [LONG, "Near text.", OTHER]


def test_letters_that_grow_in_lower_case():
    for tag, end in (("script", "script"), ("style", "STYLE"), ("svg", "Svg"), ("iframe", "iframe")):
        page = f"<p>{'\u0130' * 20} {LONG}</p><{tag}>x</{end}><p>{LONG}</p><p>{OTHER}</p>"
        assert [b.text for b in blocks(page)] == [f"{'\u0130' * 20} {LONG}", LONG, OTHER]
        assert [b.text for b in blocks(f"{'\u0130' * 20}<{tag}>x</{end}>rest")] == ["\u0130" * 20 + "rest"]
    assert [b.text for b in blocks("<script>x</\u017fcript></SCRIPT>y")] == ["y"]


def parts(page):
    return main_text(page).split("\n\n")


def test_elements_without_an_end_take_only_themselves():
    for tag in ("object data=x", "svg", "canvas", "video src=y", "template", "audio", "math"):
        assert parts(f"<article><p>{LONG}</p><{tag}><p>{OTHER}</p><p>Short.</p></article>") == [LONG, OTHER, "Short."]
        name = tag.split()[0]
        assert parts(f"<article><p>{LONG}</p><{tag}>gone<p>{OTHER}</p></{name}><p>Short.</p></article>") == [LONG, "Short."]
    for tag in ("script", "style", "textarea", "iframe"):
        assert parts(f"<p>{LONG}</p><{tag}><p>{OTHER}</p>") == [LONG]


def test_blocks_inside_a_link_are_links():
    cards = "".join(f"<a href=/{i}><div><h3>Headline of the card {i}</h3><p>{OTHER}</p></div></a>" for i in range(5))
    assert parts(f"<body>{cards}<h1>Title</h1><p>{LONG}</p><p>{OTHER}</p></body>") == ["Title", LONG, OTHER]
    # an anchor that is never closed is no link over the rest of the page, nor one that its paragraph ends
    assert parts(f"<body><a name=top><p>{LONG}</p><p><a href=x>{OTHER[:30]}<p>{LONG} {OTHER}</p></body>") == [LONG, f"{LONG} {OTHER}"]


def test_links_within_an_article_stay():
    page = f"<article><h1>Title</h1><p>{LONG}</p><p><a href=1>Read all of the report here</a></p><pre>x = 1</pre><p>So it is.</p><p>{OTHER}</p></article>"
    assert parts(page) == ["Title", LONG, "Read all of the report here", "x = 1", "So it is.", OTHER]
    menu = "".join(f"<li><a href=/{i}>Other story {i}</a></li>" for i in range(4))
    assert parts(f"<article><p>{LONG}</p><ul>{menu}</ul><p>So it is.</p><p>{OTHER}</p></article>") == [LONG, "So it is.", OTHER]


def test_names_alone_do_not_bar_text():
    for name in ("market-share", "shareOfTheVote", "legal_history", "login-security", "search-for-truth", "comment-on-kant"):
        for page in (f"<article><p>{LONG}</p><section class='{name}'><h2>Of it</h2><p>{OTHER}</p><p>Short.</p></section></article>", f"<body><p>{LONG}</p><div id='{name}'><h2>Of it</h2><p>{OTHER}</p><p>Short.</p></div></body>"):
            assert parts(page) == [LONG, "Of it", OTHER, "Short."]
    for name in ("share", "share-buttons", "socialShare", "ad_box", "newsletter-signup", "cookie-notice-bar", "comments-list", "related-posts", "hero-ads-x9"):
        assert parts(f"<article><p>{LONG}</p><div class='{name}'><p>Share this.</p></div><p>{OTHER}</p></article>") == [LONG, OTHER]
    assert parts(f"<article><div class='entry-header'><h1>Title</h1></div><p>{LONG}</p></article>") == ["Title", LONG]


def test_languages_beyond_the_stop_words():
    chinese = "昨天下午，市政府在新闻发布会上宣布，新的地铁线路将于明年开通，预计每天运送超过五十万名乘客，这将大大缓解市中心的交通压力。" * 2
    page = f"<body><ul><li><a href=1>首页</a></li><li><a href=2>新闻</a></li><li><a href=3>联系我们</a></li></ul><h1>新线路</h1><p>{chinese}</p><p>他们很高兴。</p><p>{chinese}</p></body>"
    assert parts(page) == ["新线路", chinese, "他们很高兴。", chinese]
    polish = "Wczoraj po południu rada miasta ogłosiła, że nowa linia metra zostanie otwarta w przyszłym roku, co znacznie zmniejszy ruch w centrum miasta oraz skróci czas dojazdu do pracy dla tysięcy mieszkańców okolicznych dzielnic i wsi."
    page = f"<body><div><a href=1>Strona główna</a> <a href=2>Kontakt</a></div><h1>Nowa linia</h1><p>{polish}</p><p>Tak będzie.</p><p>{polish}</p><div><a href=3>Regulamin</a></div></body>"
    assert parts(page) == ["Nowa linia", polish, "Tak będzie.", polish]


class TwoPass(HTMLParser):
    """The rules by themselves, on pages of plain paragraphs, headings and lists whose elements all end and have no names."""

    def __init__(self, page):
        super().__init__()
        self.blocks, self.open, self.links = [], None, 0
        self.feed(page)

    def handle_starttag(self, tag, attrs):
        self.links += tag == "a"
        if tag in ("p", "h2", "li"):
            self.open = [tag, "", 0]

    def handle_endtag(self, tag):
        self.links -= tag == "a"
        if tag in ("p", "h2", "li"):
            self.blocks.append(self.open)
            self.open = None

    def handle_data(self, data):
        if self.open:
            self.open[1] += data
            self.open[2] += len("".join(data.split())) * (self.links > 0)

    def text(self):
        rows = []
        for tag, text, linked in self.blocks:
            words = text.split()
            stops = sum(w.strip(".").lower() in html_text.STOP_WORDS for w in words) / len(words)
            if linked > 0.4 * len("".join(words)):
                label = -1
            else:
                label = int(len(words) >= 10 and stops >= 0.15 or len(words) >= 60 and not linked)
            rows.append((tag, " ".join(words), label))
        decided = [i for i, r in enumerate(rows) if r[2]]
        if not any(r[2] > 0 for r in rows):
            return [r[1] for r in rows if r[2] == 0]
        out = []
        for i, (tag, text, label) in enumerate(rows):
            if not label:
                after = next((j for j in decided if j > i), None)
                if tag == "h2" and after is not None and after - i <= 2 and rows[after][2] > 0:
                    label = 1 if after - i <= 2 * min((i - j for j in decided if j < i and rows[j][2] < 0), default=9) else -1
                else:
                    label = min((abs(i - j), -rows[j][2]) for j in decided)[1] * -1
            if label > 0:
                out.append(text)
        return out


def test_against_plain_two_passes():
    rng = random.Random(4)
    stops, others = ["the", "of", "and", "to", "in", "it"], ["house", "river", "green", "walked", "seven", "market"]
    for _ in range(300):
        page = ""
        for _ in range(rng.randint(1, 14)):
            words = [rng.choice(stops if rng.random() < rng.choice([0.05, 0.4]) else others) for _ in range(rng.choice([1, 2, 5, 9, 10, 14, 29, 45, 70]))]
            if rng.random() < 0.35:
                k = rng.randint(0, len(words))
                words = ["<a href=x>" + " ".join(words[:k]) + "</a>", *words[k:]] if k else words
            tag = rng.choice(["p", "p", "p", "h2", "li"])
            page += f"<{tag}>{' '.join(words)}</{tag}>\n"
        if "the" not in page and len(page) > 200:
            continue  # a page in which the stop words of no language occur goes by other rules
        known = [b for b in blocks(page)]
        for b in known:
            b.measure()
        if any(b.words >= 30 for b in known if b.links <= 0.4) and not any(b.words >= 10 and b.stops >= 0.15 for b in known if b.links <= 0.4):
            continue
        assert [x for x in main_text(page).split("\n\n") if x] == TwoPass(page).text(), page


def test_broken_pages():
    for page in ("<", "<p", "a < b and 1 <2", "<p>x", "</p>x</div>", "<!-- x", "<script>x", f"<article><p>{LONG}", "&#x110000; &#0; &bogus; &amp", "<p title='a>b\">x</p>" * 3, "<a href=\"" + "x" * 50_000, "<" * 50_000, "<p>" * 5_000 + "deep", "<div>" * 3_000 + "deep"):
        assert isinstance(main_text(page), str)
    assert main_text("a < b and 1 <2") == "a < b and 1 <2"
    assert main_text(f"<article><p>{LONG}</p><p>cut &am") == f"{LONG}\n\ncut &am"
    assert main_text("<p>x&#233;&eacute;&#xe9; &amp;amp;</p>") == "xééé &amp;"
    assert [b.text for b in blocks("<p>a<b>b</b>\n\t c<br>d<br><br>e</p>")] == ["ab c d", "e"]
