"""Pages that break careless readers, and whole results on generated pages."""

from __future__ import annotations

import html
import random
import time

import pytest

from vellumgrid.llm import html_text

PRIOR = html_text.table_of({})
STORY = "The river rose in the night and the whole town went up the hill to wait for the morning."


@pytest.mark.parametrize("digits", ["9" * 5000, "0" * 5000 + "65", "1114112", "00000000000000000000000000", "65" + "0" * 20])
def test_long_decimal_references(digits):
    value = int(digits) if len(digits) < 4000 else (65 if digits.startswith("0") else 1 << 40)
    want = "�" if value == 0 or value > 0x10FFFF else chr(value)
    page = f"<body><p>{STORY} &#{digits}; {STORY}</p></body>"
    assert html_text.extract(page, PRIOR) == f"{STORY} {want} {STORY}"
    assert html_text.unescaped(f"a&#{digits};b") == f"a{want}b"
    html_text.tally(f"<article>&#{digits} x</article>")


def test_short_references_are_as_before():
    for text in ("&amp;&lt;&#65;&#x41;&#065;&copy &notit; &#;&#x;&#xZ; &#1114111; &#55296; &#0; &#128; &", "&#" * 1000, "&#000000" * 100):
        assert html_text.unescaped(text) == html.unescape(text)


def test_references_through_spark(spark):
    df = spark.createDataFrame([(1, "u", f"<p>{STORY} &#{'7' * 6000};</p>"), (2, "u", None)], "page_id long, url string, html string")
    found = {r["page_id"]: r["main_text"] for r in html_text.main_text(df).collect()}
    assert found == {1: f"{STORY} �", 2: ""}


@pytest.mark.parametrize("unit", ["<!", "<?", "<a ", "</p ", "<p title=", "<!x", "<![CDATA[", "<!--", "&#", "<", '<a b="', "<svg"])
def test_a_megabyte_without_an_end(unit):
    page = f"<p>{STORY}</p>" + unit * ((1 << 20) // len(unit))
    began = time.time()
    pieces = list(html_text.pieces(page))
    assert time.time() - began < 15
    assert "".join(p.text for p in pieces if p.text is not None).startswith(STORY)


def plain(page: str) -> str:
    """The text of a page by trying every stretch of its pieces."""
    weights = html_text.Weights(PRIOR)
    rows, chains, pieces = [], {}, list(html_text.pieces(page))
    for p in pieces:  # kept, as chains of names are told apart by identity
        if p.counts:
            against = weights.of_names(p.names, chains)
            outside = against < html_text.OUTSIDE_ODDS
            if p.text is None:
                rows.append((weights.of_kind(p.kind), None, p.block))
            else:
                each = max(-html_text.MOST_WEIGHT, against) if outside else html_text.HINTED_WEIGHT if weights.hinted(p.names) else weights.of_kind(p.kind)
                rows.append((each * len(p.text.split()), None if outside else p.text, p.block))
    best, chosen = 0.0, (0, 0)
    for i in range(len(rows)):
        total = 0.0
        for j in range(i, len(rows)):
            total += rows[j][0]
            if total > best + 1e-9:
                best, chosen = total, (i, j + 1)
    blocks: dict[int, str] = {}
    for _, text, block in rows[slice(*chosen)]:
        if text is not None:
            blocks[block] = blocks.get(block, "") + text
    return "\n".join(t for t in (" ".join(x.split()) for x in blocks.values()) if t)


def generated(rnd: random.Random) -> str:
    words = lambda n: " ".join("".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 7))) for _ in range(n))
    out = ["<html><body>"]
    for _ in range(rnd.randint(3, 14)):
        kind = rnd.random()
        if kind < 0.5:
            out.append(f"<p>{words(rnd.randint(5, 40))} <b>{words(2)}</b>&amp; {words(1)}</p>")
        elif kind < 0.7:
            out.append(f'<div class="{rnd.choice(["sidebar", "ad", "text", "nav"])}">' + "".join(f"<a href=x>{words(1)}</a>" for _ in range(rnd.randint(1, 9))) + "</div>")
        elif kind < 0.8:
            out.append("<ul>" + "".join(f"<li>{words(rnd.randint(1, 3))}" for _ in range(rnd.randint(1, 6))) + "</ul>")
        else:
            out.append(rnd.choice([f"<script>{words(9)}</script>", f"<nav>{words(4)}</nav>", f"<h2>{words(3)}</h2>", "<br><br>", f"<form>{words(6)}</form>", f"<!-- {words(3)} -->"]))
    return "".join(out)


def test_whole_results_equal_every_stretch():
    rnd = random.Random(12)
    for _ in range(150):
        page = generated(rnd)
        assert html_text.extract(page, PRIOR) == plain(page), page
