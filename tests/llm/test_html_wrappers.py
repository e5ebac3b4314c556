import random
import time
from collections import Counter

import pytest

from vellumgrid.llm import html_text

#: Weights before anything is counted.
PRIOR = html_text.table_of({})

STORY = "The river rose in the night and the whole town went up the hill to wait for the morning."


@pytest.mark.parametrize(
    "attributes",
    [
        'style="overflow:hidden"',
        'title="A hidden valley"',
        'data-x="id=comments class=ad"',
        'class="site has-sidebar"',
        'class="no-sidebar"',
        'class="post-header"',
        'class="share-enabled"',
        'id="related-work"',
        'hidden="until-found"',
    ],
)
def test_wrappers_keep_their_text(attributes):
    page = f"<html><body><div {attributes}><p>{STORY}</p><p>{STORY}</p></div></body></html>"
    assert html_text.extract(page, PRIOR) == f"{STORY}\n{STORY}"


def test_links_keep_their_words():
    page = f'<body><p>{STORY} <a href="/post?id=comments">Read of the flood</a> {STORY}</p></body>'
    assert html_text.extract(page, PRIOR) == f"{STORY} Read of the flood {STORY}"


@pytest.mark.parametrize("attributes", ['class="x sidebar"', "id=comments", "hidden", "HIDDEN=hidden", "role='navigation'", 'aria-hidden="true"', "class = 'ad'"])
def test_whole_names_still_go(attributes):
    assert html_text.extract(f"<body><p>{STORY}</p><div {attributes}>Buy now</div></body>", PRIOR) == STORY


def learned(pages):
    seen = Counter()
    for page in pages:
        seen.update(html_text.tally(page))
    return html_text.table_of({k: (seen[k, True], seen[k, False]) for k in {k for k, _ in seen}})


def test_names_are_learned():
    """A class that is in no list goes where labelled pages have it outside."""
    labelled = [f'<body><div class="zz9">Sign here for our daily letter</div><article><div class="content"><p>{STORY}</p></div></article></body>'] * 300
    page = f'<body><div class="zz9">Sign here</div><div><div class="content"><p>{STORY}</p></div><div class="zz9 other">Buy</div><p>{STORY}</p></div></body>'
    assert html_text.extract(page, learned(labelled)) == f"{STORY}\n{STORY}"


def hard_page(rnd, marked):
    """Adverts, a form and comments within the article; names that mislead around and in it."""
    tag = "article" if marked else "div"
    words = lambda n: " ".join("".join(rnd.choice("abcdefgh") for _ in range(rnd.randint(2, 7))) for _ in range(n))
    blocks, want = [], []
    for _ in range(rnd.randint(3, 8)):
        want.append(words(rnd.randint(5, 60)))
        blocks.append(rnd.choice(["<p>{}</p>", '<div class="header-image"><p>{}</p></div>', '<p class="note-ad-free">{}</p>', "<blockquote><p>{}</p></blockquote>"]).format(want[-1]))
        blocks.append(rnd.choice(["", "", '<div class="ad">{}</div>', "<form><label>{}</label></form>", '<div class="promo-x1"><p>{}</p></div>', "<aside>{}</aside>"]).format(words(rnd.randint(1, 20))))
    end = f'<section class="comments"><p>{words(30)}</p><p>{words(20)}</p></section>'
    page = f'<body class="has-sidebar"><header><a href="/">{words(3)}</a></header><nav><ul><li><a>{words(2)}</a></li></ul></nav><{tag}>{"".join(blocks)}</{tag}>{end}<div class="promo-x1"><p>{words(25)}</p></div><footer>{words(9)}</footer></body>'
    return page, "\n".join(want)


def test_hard_pages_without_marks():
    """Weights from marked pages, text from others that have no mark: F1 by words."""
    rnd = random.Random(5)
    weights = learned([hard_page(rnd, True)[0] for _ in range(200)])
    # promo-x1 stands inside of marked articles too; there only its place outside speaks against it
    shared = found = wanted = 0
    for _ in range(100):
        page, want = hard_page(rnd, False)
        a, b = Counter(html_text.extract(page, weights).split()), Counter(want.split())
        shared, found, wanted = shared + (a & b).total(), found + a.total(), wanted + b.total()
    assert 2 * shared / (found + wanted) > 0.9


def test_best_stretch_equals_brute_force():
    rnd = random.Random(1)
    for _ in range(300):
        scores = [rnd.choice([-3, -1, -0.5, 0, 0.5, 1, 2]) for _ in range(rnd.randint(0, 25))]
        sums = {(a, b): sum(scores[a:b]) for a in range(len(scores)) for b in range(a + 1, len(scores) + 1)}
        low, high = html_text.best_stretch(scores)
        assert sum(scores[low:high]) == max([0, *sums.values()])


@pytest.mark.parametrize("page", ['<a "' * 250_000, '<a "><' * 150_000, "<b>" * 150_000 + "</i>" * 150_000, "<p><div>" + "<b>" * 100_000 + "<p>x" * 100_000, '<a ">" ' * 100_000, "<" * 500_000])
def test_a_megabyte_of_broken_markup(page):
    began = time.perf_counter()
    html_text.extract(page, PRIOR)
    assert time.perf_counter() - began < 20


def test_quotes_that_nothing_closes():
    assert html_text.extract(f"<body><p>{STORY}</p><p title=\"x>{STORY}</p>", PRIOR) == f"{STORY}\n{STORY}"
    assert html_text.extract(f"<body><p title='a > b' class=\"c\">{STORY}</p>", PRIOR) == STORY
