"""Pages whose article was lost: elements without an end tag, and classes that only look like boilerplate."""

import pytest

from mnemolake.llm.html_main_text import Weights, count, main_text

ARTICLE = "A long text about rivers and the towns beside them. " * 20
TEXT = " ".join(ARTICLE.split())
MARKED = "<body><nav class='top'><a>home</a> <a>about us</a></nav><article><p>" + ARTICLE + "</p></article><div class='ad'>buy now</div></body>"
WEIGHTS = count([MARKED] * 20)


@pytest.mark.parametrize("weights", [Weights(), WEIGHTS])
@pytest.mark.parametrize(
    "page",
    [
        "<html><head><title>t</title><meta charset=x><body><p>{}</p></body></html>",
        "<head><title>t</title><p>{}</p>",
        '<body><svg class="i"/><p>{}</p>',
        "<body><math/><p>{}</p><math><mi>x</mi></math>",
        "<body><svg><style/><title/></svg><p>{}</p>",
        "<body><svg class=i><p>{}</p><svg></svg>",
        "<body><noscript><p>{}</p>",
        "<body><template><div><p>{}</p>",
        "<body><iframe src=x><p>{}</p>",
        "<body><object><p>{}</p>",
        "<!--><body><p>{}</p>",
        "<script>x</script ><p>{}</p><script>y",
    ],
)
def test_no_element_swallows_the_page(page, weights):
    assert main_text(page.format(ARTICLE), weights) == TEXT


@pytest.mark.parametrize("name", ["script", "style", "textarea"])
def test_raw_elements_run_to_the_end(name):
    assert main_text(f"<p>{ARTICLE}</p><{name}/><p>no text", Weights()) == TEXT
    assert main_text(f"<p>{ARTICLE}</p><!-- <p>no text", Weights()) == TEXT


@pytest.mark.parametrize("name", ["svg", "math", "select", "noscript", "template", "title"])
def test_silent_content_is_left_out(name):
    page = f"<p>{ARTICLE}</p><{name}><{name}></{name}>no text <b>and no tag</b></{name}><p>{ARTICLE}</p>"
    if name in ("svg", "math", "template"):  # the others do not nest
        assert main_text(page, Weights()) == f"{TEXT}\n{TEXT}"
    assert main_text(page.replace(f"<{name}></{name}>", ""), Weights()) == f"{TEXT}\n{TEXT}"


@pytest.mark.parametrize("weights", [Weights(), WEIGHTS])
@pytest.mark.parametrize(
    "page",
    [
        '<body class="has-sidebar single-post"><p>{}</p></body>',
        '<article class="post-12 comments-open"><p>{}</p></article>',
        '<body><div class="page-with-nav"><p>{}</p></div><div>Copyright</div></body>',
    ],
)
def test_class_of_a_wrapper_drops_nothing(page, weights):
    assert TEXT in main_text(page.format(ARTICLE), weights)


def test_unseen_class_inside_the_region_stays():
    page = f'<article><p>{ARTICLE}</p><div class="x share-price">{ARTICLE}</div><p>{ARTICLE}</p></article>'
    assert main_text(page, WEIGHTS).count(TEXT) == 3


def test_counted_class_token_is_left_out():
    page = f'<article><p>{ARTICLE}</p><div class="ad box-7">buy now</div><p>{ARTICLE}</p></article>'
    assert main_text(page, WEIGHTS) == f"{TEXT}\n{TEXT}"


def boxed(inside: str) -> str:
    return f"<body><nav class='top'><ul><li><a>home</a></li><li><a>about us</a></li></ul></nav><article><p>{ARTICLE}</p>{inside}<p>{ARTICLE}</p></article></body>"


LISTS = count([boxed("")] * 20)  # lists were only counted in menus


@pytest.mark.parametrize("weights", [Weights(), WEIGHTS, LISTS])
@pytest.mark.parametrize(
    ("inside", "kept"),
    [
        ("<ul><li>first item</li><li>second item</li></ul>", ["first item", "second item"]),
        ("<ul><li>one<ol><li>two</li></ol></li></ul>", ["one", "two"]),
        ("<table><tr><th>name</th><td>Rhine</td></tr></table>", ["name", "Rhine"]),
        ("<blockquote><p>as they said</p></blockquote>", ["as they said"]),
        ("<div class='note-7'>a remark</div>", ["a remark"]),
        ("<header><h2>Part two</h2></header>", ["Part two"]),
    ],
)
def test_blocks_of_an_article_stay(weights, inside, kept):
    assert main_text(boxed(inside), weights).split("\n") == [TEXT, *kept, TEXT]


@pytest.mark.parametrize("weights", [WEIGHTS, LISTS])
def test_a_list_of_links_does_not_end_the_article(weights):
    links = "".join(f"<li><a href='/{i}'>river {i}</a></li>" for i in range(40))
    assert main_text(boxed(f"<ul>{links}</ul>"), weights).split("\n") == [TEXT, *(f"river {i}" for i in range(40)), TEXT]


@pytest.mark.parametrize("weights", [Weights(), WEIGHTS, LISTS])
@pytest.mark.parametrize(
    "inside",
    [
        "<section class='comments'><p>I like it</p><ul><li>me too</li></ul></section>",
        "<div id='comments' class='x1'><ol class='comment-list'><li>I like it</li></ol></div>",
        "<form>Subscribe now <input name=m></form>",
        "<aside><p>More from us</p></aside>",
        "</article><aside>More from us</aside><article>",
        "<div class='related-posts'><a>another story</a></div>",
        "<div role='navigation'><a>next</a></div>",
        "<button>Share</button>",
        "<div class='cookie-notice'>we use cookies</div>",
    ],
)
def test_what_is_no_article_is_left_out_inside_it(weights, inside):
    assert main_text(boxed(inside), weights).split("\n") == [TEXT, TEXT]


def test_a_form_around_the_page_stays():
    page = f"<body><form action='/'><div class='menu'>home</div><div class='story'><p>{ARTICLE}</p><p>{ARTICLE}</p></div></form></body>"
    assert main_text(page, WEIGHTS).split("\n") == [TEXT, TEXT]


def test_learning_takes_different_pages(spark):
    from mnemolake.llm.html_main_text import learn

    rows = [(MARKED,)] * 50 + [(boxed(""),), (None,), ("<p>unmarked</p>",)]
    learned = learn(spark.createDataFrame(rows, "html string"), sample_pages=2)
    assert learned == count([MARKED, boxed("")]) or learned == count([boxed(""), MARKED])
    assert learn(spark.createDataFrame([], "html string")) == Weights()
