"""Image files and sample stores through Spark's data sources."""

from __future__ import annotations

import os

import numpy as np
import pytest

from vellumgrid.operators import metrics, text
from vellumgrid.sources import images, samples


def grid(img: str, pixels: np.ndarray) -> list[tuple]:
    return [(img, r, c, int(v)) for (r, c), v in np.ndenumerate(pixels)]


@pytest.mark.parametrize("seed", range(6))
def test_png_round_trip(seed):
    rnd = np.random.default_rng(seed)
    h, w = rnd.integers(1, 40, 2)
    noise = rnd.integers(0, 256, (h, w)).astype(np.uint8)
    smooth = (np.add.outer(np.arange(h) * 3, np.arange(w) * 5) % 256).astype(np.uint8)
    for pixels in (noise, smooth, np.where(noise > 128, smooth, 7).astype(np.uint8)):
        assert (images.decoded(images.encoded(pixels)) == pixels).all()
    colours = rnd.integers(0, 256, (h, w, 3)).astype(np.uint8)
    assert (images.decoded(images.encoded(colours)) == images.luminance(*(colours[:, :, k] for k in range(3)))).all()


@pytest.mark.parametrize("kind", range(5))
def test_every_row_filter(kind):
    """A row's filter undone sample by sample."""
    rnd = np.random.default_rng(kind)
    data = rnd.integers(0, 256, (7, 9, 2)).astype(np.uint8)
    kinds = np.array([kind] * 6 + [0])
    want = np.zeros((8, 10, 2), int)
    for r in range(7):
        for c in range(9):
            for k in range(2):
                a, b, d = want[r + 1, c, k], want[r, c + 1, k], want[r, c, k]
                p = a + b - d
                near = min((abs(p - a), 0, a), (abs(p - b), 1, b), (abs(p - d), 2, d))[2]
                want[r + 1, c + 1, k] = (int(data[r, c, k]) + [0, a, b, (a + b) // 2, near][kinds[r]]) % 256
    assert (images.unfiltered(kinds, data) == want[1:, 1:]).all()


def test_pgm():
    assert images.decoded(b"P2\n# note\n3 2\n4\n0 1 2 3 4 4\n").tolist() == [[0, 64, 128], [191, 255, 255]]
    assert images.decoded(b"P5 2 2 255\n" + bytes([1, 2, 3, 4])).tolist() == [[1, 2], [3, 4]]
    for bad in (b"", b"P5 2 2 255\n123", b"P2 2 1 9 1 x", b"P2 2 1 9 1 10", b"GIF89a", images.SIGNATURE, images.encoded(np.zeros((3, 3), np.uint8))[:-1]):
        with pytest.raises(images.NotAnImage):
            images.decoded(bad)


def test_images_through_the_data_source(spark, tmp_path):
    rnd = np.random.default_rng(1)
    rows = [r for k in range(5) for r in grid(f"m{k}.png", rnd.integers(1, 256, (6 + k, 4)))]
    cells = spark.createDataFrame(rows, "img string, r int, c int, v int")
    folder = str(tmp_path / "maps")
    images.write_images(images.encoded_images(cells), folder)
    assert sorted(os.listdir(folder)) == [f"m{k}.png" for k in range(5)]
    with open(f"{folder}/m2.png", "rb") as f:
        half = f.read()
    with open(f"{folder}/cut.png", "wb") as f:
        f.write(half[: len(half) // 2])
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    found = images.read_images(spark, folder, partition_bytes=200)
    assert found.rdd.getNumPartitions() > 1
    assert sorted(tuple(r) for r in found.where("v is not null").collect()) == sorted(rows)
    assert [tuple(r) for r in found.where("v is null").collect()] == [("cut.png", None, None, None)]
    assert found.where("img = 'm3.png'").count() == 36 and found.where("img in ('m0.png', 'none')").count() == 24
    assert images.read_images(spark, f"{folder}/m[01].png").select("img").distinct().count() == 2
    assert sorted(tuple(r) for r in images.decoded_files(spark.read.format("binaryFile").load(folder)).where("v is not null").collect()) == sorted(rows)
    whole = spark.createDataFrame(rows + [("m0.png", 0, 0, 0), (None, 1, 1, 1), ("m1.png", None, 1, 1)], "img string, r int, c int, v int")
    assert images.encoded_images(whole).orderBy("img").collect() == images.encoded_images(cells).orderBy("img").collect()


def test_filters_choose_files():
    reader = images.ImageReader({"path": "/nowhere"})
    from pyspark.sql.datasource import EqualTo, In, LessThan

    left = list(reader.pushFilters([EqualTo(("img",), "a"), LessThan(("r",), 3), In(("img",), ("a", "b"))]))
    assert left == [LessThan(("r",), 3)] and reader.names == {"a"}
    assert [x.names for x in images.packed([("a", 5), ("b", 5), ("c", 50), ("d", 1)], 10)] == [("a", "b"), ("c",), ("d",)]


def test_sample_store(spark, tmp_path):
    image = images.encoded(np.ones((2, 2), np.uint8))
    damaged = {1, 4, 5, 6, 12, 13, 19, 20}
    rows = [(k, (image[:20] if k % 2 else None) if k in damaged else image, f"s{k}") for k in range(1, 21)]
    path = str(tmp_path / "store")
    spark.conf.set("spark.sql.shuffle.partitions", "5")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        samples.write_store(spark.createDataFrame(rows, "sample_id long, content binary, label string"), path)
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", "4")
        spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    assert sum(x.startswith("part-") for x in os.listdir(path)) > 2
    want = {k: next((n for n in range(k, 21) if n not in damaged), None) for k in range(1, 21)}
    store = samples.read_store(spark, path)
    found = {r["sample_id"]: r["found_id"] for r in store.collect()}
    assert found == want and store.count() == 20
    assert all(r["label"] == (None if r["found_id"] is None else f"s{r['found_id']}") and (r["content"] is None) == (r["found_id"] is None) for r in store.collect())
    for where, ids in {"sample_id = 5": {5}, "sample_id in (4, 19, 77)": {4, 19}, "sample_id >= 11 and sample_id < 14": {11, 12, 13}, "sample_id > 19": {20}, "sample_id <= 2 and label = 's2'": {1, 2}, "sample_id = 99": set()}.items():
        assert {r["sample_id"]: r["found_id"] for r in store.where(where).collect()} == {k: want[k] for k in ids}, where
    reader = samples.SampleReader({"path": path})
    from pyspark.sql.datasource import EqualTo

    assert list(reader.pushFilters([EqualTo(("sample_id",), 5)])) == [] and len(reader.partitions()) == 1


def test_entropy_ties_and_missing_sides(spark):
    rows = [(1, a, b) for a, b in zip("aaaaabbbccdd", "wwwwwxxyyzzz")] + [(2, "a", None), (3, None, "a"), (4, "a", "a"), (4, "b", "a"), (5, "a", "a"), (5, "a", "b"), (6, None, None)]
    df = spark.createDataFrame(rows, "k int, a string, b string")
    for _ in range(3):
        got = {r["k"]: r["flipped"] for r in metrics.flipped_by_entropy(df.repartition(5), "k", "a", "b").collect()}
        assert got == {1: False, 2: True, 3: True, 4: True, 5: False, 6: True}


def test_costs_settle_as_in_a_plain_loop(spark):
    rows = [("kitten", "sitting"), ("kitten", "sitting"), ("dggi", "doggo"), ("", "ab"), ("aabbd", ""), ("flaw", "lawn"), (None, "x")]
    df = spark.createDataFrame(rows, "observed string, intended string")
    found, rounds = text.train_costs(df)
    costs, before = None, None
    for number in range(1, 50):
        n: dict = {}
        for o, i in rows:
            for pair in text.align(o or "", i or "", costs)[1]:
                n[pair] = n.get(pair, 0) + 1
        if n == before:
            break
        total: dict = {}
        for (_, i), k in n.items():
            total[i] = total.get(i, 0) + k
        before, costs = n, {(o, i): k / total[i] for (o, i), k in n.items()}
    assert rounds == number and {(r["o"], r["i"]): r["n"] for r in found.collect()} == n
    with pytest.raises(ValueError):
        text.train_costs(df, most_rounds=1)
