"""q_decode_words finds words: images whose last window ends them, against all paths of each."""

import json
from collections import defaultdict

import pytest

import __spark_entry__ as entry
from vellumgrid.plans import fixtures as fx

FOLDER = "/root/testdata/sf0.001"


def test_images_that_end_with_a_window_have_words(spark):
    windows = defaultdict(list)
    for e in fx.table(spark, FOLDER, "events").select("user_id", "event_id", "props").collect():
        x1, w = json.loads(e.props)["k"] % 25 * 4, e.event_id % 9 * 4 + 8
        windows[-1 - (e.user_id // 10 * 1_000_000 + e.event_id // 20_000)].append((x1 + w, x1, chr(65 + e.event_id % 26), (e.event_id % 97 + 1) / 98.0))
    got = {r.image_id: r for r in entry.queries()["q_decode_words"](spark, FOLDER).where("image_id < 0").collect()}
    assert set(got) == set(windows) and sum(r.confidence > 0 and len(r.word) > 1 for r in got.values()) > len(got) / 2
    for image, all_ in windows.items():
        best, end = {}, max(x2 for x2, *_ in all_)
        for x2, x1, letter, p in sorted(all_):
            if x2 - x1 > 16 and letter == "I":
                continue
            before = [(1.0, "")] if x1 == 0 else [best[x] for x in range(max(0, x1 - 8), x1) if x in best]
            for q, word in before:
                if p * q > best.get(x2, (0.0, ""))[0]:
                    best[x2] = (p * q, word + letter)
        want, word = best.get(end, (-1.0, ""))
        assert got[image].confidence == pytest.approx(want)
        assert len(got[image].word) == len(word)
