"""Pages whose text must stay whole: attributes that only look like names, letters that change length, deep nesting."""

import pytest

from barloom.llm import pages


def text(source):
    return pages.Page(source).text(set())


@pytest.mark.parametrize("pad", [0, 6000])
def test_end_of_a_script_at_every_length(pad):
    source = f"<p>İzmir</p><script>a</script><p>kept?</p><!--{'x' * pad}-->"
    assert text(source) == "İzmir\nkept?"
    assert text(f"<p>a</p><SCRIPT>İİİ if (a</b) x</ScRiPt ><p>b</p><!--{'x' * pad}-->") == "a\nb"


@pytest.mark.parametrize("attribute", ['style="overflow:hidden"', 'title="the hidden gem"', 'data-hidden="false"', 'data-class="ad"', 'class="text-side"',
                                       'class="related-work"', 'class="copyright-law"', 'id="alert-levels"', "title='class=ad'", 'aria-hidden="false"'])
def test_attributes_inside_an_article(attribute):
    assert text(f"<body><article><p>one</p><div {attribute}><p>two</p></div><p>three</p></article></body>") == "one\ntwo\nthree"


@pytest.mark.parametrize("attribute", ["hidden", 'hidden=""', 'aria-hidden="true"', 'class="ad"', 'class="box ad"', "class=comments", 'role="navigation"', 'data-x="1" class="related"'])
def test_names_that_count_inside_an_article(attribute):
    assert text(f"<body><article><p>one</p><div {attribute}><p>two</p></div><p>three</p></article></body>") == "one\nthree"


def test_words_inside_a_sentence_stay():
    assert text("<article><p>so <math><mi>x</mi></math> and <label>this</label> hold</p></article>") == "so x and this hold"


def test_nesting_beyond_any_depth():
    n = 20_000
    assert text("<body>" + "<span>" * n + "<p>a</p><nav>menu</nav><p>b</p>" + "</span>" * n + "<p>c</p></body>") == "a\nb\nc"
    assert text("<article>" + "<a href=x>" * 9000 + "word" + "</a>" * 9000 + "<p>end</p></article>") == "word\nend"
