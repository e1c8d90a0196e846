from loomgrid.llm import html_extract
from loomgrid.llm.html_extract import main_text

PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="<p>no</p>";</script></head><body>
<header>Site</header><nav><ul><li>Home</li></ul></nav><div class="cookie-banner">We use</div><div class="ad">Buy</div>
<article><h1>Head&amp;line</h1><p>One <b>bo</b>ld<br>two&nbsp;&#233;<p>Three <a href="x>y">link</a></p><aside>Aside</aside>
<form><input><p>Name</p></form><!-- <p>gone</p> --><div id="comments"><p>Nice!</p></div></article><footer>(c)</footer>"""


def test_roles_and_blocks():
    assert main_text(PAGE) == "Head&line One bold two é Three link"
    assert main_text("") == "" and main_text("just text") == "just text"
    assert main_text("<p>a < b and <br/> c<p>d <") == "a < b and c d <"
    assert main_text("<article><p>cut <b>off<br>here") == "cut off here"


def test_names_around_and_inside_an_article():
    article = "<article><div class='entry-header'><h1>Head</h1></div><p>Body of it</p><div id='related-work'><p>Work</p></div><div id='comments'><p>Nice</p></div></article>"
    whole = "Head Body of it Work"
    assert main_text(f"<body><div class='layout with-sidebar'>{article}</div><div class='sidebar'>x</div>") == whole
    assert main_text(f"<body><div id='page' class='has-header'><header>Top</header>{article}</div>") == whole
    assert main_text(f"<form id='aspnet'><nav>Menu</nav>{article}</form>") == whole
    assert main_text(f"<html><head><title>T</title><meta x><body>{article}") == whole
    assert main_text("<div class='no-comments'><p>All of the text stands in here</p></div><div class='ad'>Buy</div>") == "All of the text stands in here"
    assert main_text("<nav>Only a menu</nav>") == "" and main_text("<div>" * 3000 + "deep") == "deep"


def test_the_tree_alone_finds_menus(spark):
    """Without any word list the given pages' menus, adverts and footers are found by the entropies of their hosts' trees."""
    pages = spark.read.parquet("/root/testdata/sf0.1/pages.parquet").where("crc32(parse_url(url, 'HOST')) % 4 = 0")
    rows = pages.collect()
    want = {r.page_id: main_text(r.html) for r in rows}
    got = {r.page_id: r.text for r in html_extract.extract_main_text(pages, roles=False).collect()}
    assert len(rows) > 300 and got == want


def test_levels_by_shuffle_equal_broadcast(spark, monkeypatch):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    want = sorted((r.page_id, r.text) for r in html_extract.extract_main_text(pages, roles=False).collect())
    monkeypatch.setattr(html_extract, "BROADCAST_ROWS", 0)
    assert sorted((r.page_id, r.text) for r in html_extract.extract_main_text(pages, roles=False).collect()) == want


def test_style_tree_cuts_what_a_host_repeats(spark):
    def page(k):
        return f"<html><body><div class='top'>Same on all pages</div><div class='x'><p>Story {k} with its own words {k * 7}</p><p>More of {k}</p></div><div class='end'>Same end</div></body></html>"

    rows = [(k, f"http://Host.org/{k}", page(k), "t") for k in range(12)]
    rows += [(100 + k, f"http://other.org/{k}", "<article><p>Copy of one article</p></article>", "t") for k in range(8)]
    rows += [(200, None, None, "t"), (201, "nohost", "<p>x</p>" * 20000, "t"), (None, "http://h/", "<p>y</p>", "t"), (1, rows[1][1], rows[1][2], "t")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string, text string")
    got = [(r.page_id, r.text) for r in html_extract.extract_main_text(df).collect()]
    texts = dict(got)
    assert len(got) == len(rows)
    assert texts[3] == "Story 3 with its own words 21 More of 3"
    assert texts[103] == "Copy of one article"
    assert texts[200] == "" and texts[None] == "y" and texts[201] == " ".join("x" * 20000)
    assert html_extract.extract_main_text(df.where("false")).count() == 0
