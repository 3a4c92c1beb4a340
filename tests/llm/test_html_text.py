import time

import pytest

from skyframe.llm import html_text
from skyframe.llm.common import QUERIES

PROSE = "This is the main text of the page and it has enough of the small words to be taken for prose."


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (None, ""),
        ("", ""),
        ("plain &lt;b&gt;  text &#233;&eacute;&nbsp;x", "plain <b> text éé x"),
        (f"<nav><p>{PROSE}</p></nav><article><h1>A</h1><p>b <b>c</b>d<br>e<p>f</article><footer>{PROSE}</footer>", "A\nb cd e\nf"),
        (f"<article><p>{PROSE}<script>if (a < b) '</p>'</script></p><!-- <p>no</p> --><p>Of.</p>", f"{PROSE}\nOf."),
        (f"<main><header>Site</header><p>{PROSE}</p><div class='ad'>{PROSE}</div><div id=comments><p>{PROSE}</p></div><aside>x</aside><p>End", f"{PROSE}\nEnd"),
        (f"<body class='has-sidebar'><div class=sidebar>{PROSE}</div><div><h2>Title</h2><p>{PROSE}</p><p>Short.</p></div><form>{PROSE}</form></body>", f"Title\n{PROSE}\nShort."),
        (f"<p>{PROSE}</p><ul><li><a href=x>one</a><li><a href=y>two</a></ul><p>{PROSE}</p>", f"{PROSE}\n{PROSE}"),
        (f"<article><p hidden>{PROSE}</p><p style='display: none'>{PROSE}</p><div role=navigation>x</div><p>Seen</p></article>", "Seen"),
        ("<article><p>cut &am", "cut &am"),
        ("<article><p>a < b and c > d</p></article>", "a < b and c > d"),
    ],
)
def test_cases(source, text):
    assert html_text.main_text(source) == text


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (f"<article><h2><a href=x>Linked</a></h2><p>{PROSE}</p><p><a href=y>A linked line</a></p><ul><li><a href=z>list</a></ul></article>", f"Linked\n{PROSE}\nA linked line"),
        (f"<div class='content has-sidebar'><div class=sidebar>{PROSE}</div><article><p>{PROSE}</p></article></div>", PROSE),
        (f"<div class='content has-sidebar'><p>{PROSE}</p></div>", PROSE),
        (f"<div class='header-fixed'><div id='page_with_menu'><main><p>{PROSE}</p></main></div></div>", PROSE),
        (f"<article><h2 class='section-header'>Title</h2><p>{PROSE}</p></article>", f"Title\n{PROSE}"),
        (f"<main><p>{PROSE}</p><div class='related-posts'><article>{PROSE}</article></div></main><aside><article>{PROSE}</article></aside>", PROSE),
    ],
)
def test_articles_keep_linked_headings_and_odd_wrappers(source, text):
    assert html_text.main_text(source) == text


RUSSIAN = "Эта страница написана на языке, для которого здесь нет списка частых слов, но текст её длинный и связный."
ITALIAN = "Questa pagina contiene una lunga storia scritta in italiano, senza parole presenti negli elenchi usati qui."


@pytest.mark.parametrize(
    ("source", "text"),
    [
        (f"<div class=menu><a href=x>Меню</a></div><p>{RUSSIAN}</p><div><a href=y>{RUSSIAN}</a></div>", RUSSIAN),
        (f"<h1>Storia</h1><p>{ITALIAN}</p>", f"Storia\n{ITALIAN}"),
        (f"<article><div class='social-history'><p>{PROSE}</p></div><div class='notice-period'>{PROSE}</div></article>", f"{PROSE}\n{PROSE}"),
        (f"<article><p>{PROSE}</p><div class='comment-list'>{PROSE}</div><div class='ad-slot-2'>x</div><div class='share_buttons'>x</div></article>", PROSE),
        (f"<article><p>{PROSE}</p><table><tr><td><a href=x>cell</a></td><td>1</td></tr></table></article>", f"{PROSE}\ncell\n1"),
        (f"<article title='a > b'><p>{PROSE}</p></article>", PROSE),
        (f"<article><p>{PROSE}</p><a href=\"open>x</a><p>End</p>", f"{PROSE}\nx\nEnd"),
    ],
)
def test_other_languages_and_names_inside_articles(source, text):
    assert html_text.main_text(source) == text


@pytest.mark.parametrize(
    "source",
    ['<a href="x ' * 100_000, "<a '>' " * 100_000, '<a ">" ' * 100_000 + ">", "<p " + "a" * 1_000_000 + ">", "<nav>" + "<div><article>" * 40_000, "<!-- " * 200_000, "<" * 1_000_000, "<div>" * 100_000 + "</p>" * 100_000, "<p x=" * 200_000],
)
def test_broken_markup_takes_linear_time(source):
    began = time.process_time()
    html_text.main_text(source)
    assert time.process_time() - began < 10


def test_second_pass_takes_nearest_labels():
    assert html_text._second_pass([None, True, None, False, None, None, False, None], True) == [True, True, True, False, False, False, False, False]
    assert html_text._second_pass([None, None], True) == [True, True]


def test_rows(spark, tables):
    pages = spark.createDataFrame([(1, "u", None, "t"), (2, None, f"<article><p>{PROSE}</p></article>", "t"), (2, None, f"<article><p>{PROSE}</p></article>", "t"), (3, "v", "<p>" + "x" * 200_000, "t")], "page_id long, url string, html string, text string")
    rows = QUERIES["op2_html_extraction"](spark, tables(pages=pages)).collect()
    assert sorted((r.page_id, r.url, r.n_chars) for r in rows if r.url) == [(1, "u", 0), (3, "v", 200_000 if html_text.main_text("<p>" + "x" * 200_000) else 0)]
    assert [r.text for r in rows if r.page_id == 2] == [PROSE, PROSE]
    assert html_text.extract(pages.limit(0)).count() == 0
