"""Pages whose dropped elements have no end tag."""

import pytest

from churnscope.llm import pages

MAIN = "<article><h1>A &amp; B</h1><p>Some long enough text of the page, with a sentence.</p><p>Two lines</p></article>"
TEXT = "A & B Some long enough text of the page, with a sentence. Two lines"


@pytest.mark.parametrize("before", [
    "<html><head><title>t</title>", "<head><meta charset=utf-8><script>var a = '<p>';</script><style>p {}</style>",
    "<head><title>t</title><noscript><img src=x><p>on</p></noscript><base href=x>", "<head><noscript>", "<head><template><b>x</b></template>",
    "<html><head><title>t</title></head><body>", "<head><title>t</title><body>"])
def test_head_without_end_tag(before):
    assert pages.trained().extract(before + MAIN) == TEXT


@pytest.mark.parametrize("tag", pages.PAIRED)
@pytest.mark.parametrize("page", [
    "<body><{0}>x{1}", "<body><div><{0}>x</div>{1}", "<body><div><{0}>x</div>{1}<div><{0}>y</{0}></div>", "<body><{0}>x{1}<{0}>y</{0}>",
    "<body><a href=u><{0} class=c></a>{1}", "<body><{0}>x<!-- </{0}> --><script>'</{0}>'</script>{1}"])
def test_dropped_element_without_end_tag(tag, page):
    assert pages.trained().extract(page.format(tag, MAIN)) == TEXT


@pytest.mark.parametrize("tag", pages.PAIRED)
def test_dropped_element_with_end_tag_stays_dropped(tag):
    held = f"<{tag}><div><span>no<script>'</div>'</script></div><p>no</p></{tag}>"
    assert pages.trained().extract(f"<body><div>{held}</div>{MAIN}") == TEXT


@pytest.mark.parametrize("tag", ["svg", "object", "template"])
def test_nested_dropped_elements(tag):
    assert pages.trained().extract(f"<body><{tag}><{tag}>no</{tag}><p>no</p></{tag}>{MAIN}") == TEXT


def test_text_in_a_head_ends_it():
    assert "Free words" in "".join(t for n in pages.parse("<head><title>t</title>Free words") for _, t in n.runs)


def test_many_elements_without_end_tag_take_linear_time():
    page = "<body>" + "<div><button>x<noscript><svg><g></div>" * 20_000 + MAIN
    assert sum(n.tag == "article" for n in pages.parse(page)) == 1
