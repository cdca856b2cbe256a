"""Pages of several templates: what is inside an article's own paragraphs stays, boxes around it go."""

import pytest

from quern.llm.mainhtml import Page

LONG = "This is a sentence of the article itself, with more than a dozen words in it, as any paragraph has."


def text(html):
    return Page(html).text()[0].split("\n\n")


@pytest.mark.parametrize(
    "inner", ["<script>var a</script>", "<style>p{}</style>", "<svg><text>x</text></svg>", "<iframe src=x></iframe>", "<button>go</button>", "<noscript><p>on</p></noscript>", "<select><option>a</select>"]
)
def test_dropped_inside_a_line(inner):
    assert text(f"<article><p>Alpha beta {inner}gamma delta</p><p>{LONG}</p></article>") == ["Alpha beta gamma delta", LONG]


def test_captions_and_equations_stay():
    html = f"<article><p>{LONG}</p><figure><img src=a><figcaption>The caption of it</figcaption></figure><p>So <math><mi>x</mi> = 1</math> holds.</p></article>"
    assert text(html) == [LONG, "The caption of it", "So x = 1 holds."]


def test_words_of_classes_within_an_article():
    parts = [f'<p class="related">Related work {LONG}</p>', f'<ul class="social"><li>Of society {LONG}</li></ul>', f'<section class="search"><p>The search {LONG}</p></section>']
    assert text(f"<article><p>{LONG}</p>{''.join(parts)}</article>") == [LONG, f"Related work {LONG}", f"Of society {LONG}", f"The search {LONG}"]


def test_boxes_within_an_article_go():
    boxes = f'<div class="share"><a href=a>Mail it to all of your friends at once now please</a></div><div class="tags">one two</div><div class="comments"><p>A reader said {LONG}</p></div><div class="ad"><p>{LONG}</p></div>'
    assert text(f"<article><p>{LONG}</p>{boxes}<p>The end of it.</p></article>") == [LONG, "The end of it."]


def test_sibling_parts_without_an_article():
    parts = "".join(f"<p>{LONG}</p>" for _ in range(6))
    html = f'<body><div class="menu"><a href=a>Home</a></div><div id=a>{parts}</div><div id=b><p>The last of {LONG}</p></div><div class="sidebar"><p>Elsewhere {LONG}</p></div></body>'
    assert text(html) == [LONG] * 6 + [f"The last of {LONG}"]


def test_second_template():
    html = f"""<html><body><header><h1>Site</h1></header><main><h1>Title</h1><div class="entry"><p>{LONG}<br>and on</p><table><tr><td>cell one</td><td>cell two</td></tr></table>
      <blockquote>As said &amp; quoted</blockquote></div></main><footer>(c)</footer></body></html>"""
    assert text(html) == ["Title", f"{LONG} and on", "cell one", "cell two", "As said & quoted"]


def test_a_path_that_holds_little_does_not_win():
    page = Page(f'<body><div class="a"><p>{LONG}</p></div><div class="b"><p>{LONG}</p><p>{LONG}</p><p>{LONG}</p></div></body>')
    key = page.keys[page.names.index("div.a")]
    assert page.text(key)[0].count(LONG) == 4
