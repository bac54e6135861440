"""Connected parts and differences of masks against pixel-by-pixel ones."""

import random

from pyspark.sql import functions as F

from skein.operators import blobs, components

PIXELS = "image string, y int, x int, c string"


def flood(pixels):
    """{pixel: first pixel of its part, in reading order}"""
    left, out = set(pixels), {}
    for start in sorted(pixels):
        if start not in left:
            continue
        left.discard(start)
        part, todo = [], [start]
        while todo:
            y, x = todo.pop()
            part.append((y, x))
            for p in [(y + dy, x + dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]:
                if p in left:
                    left.discard(p)
                    todo.append(p)
        out |= dict.fromkeys(part, start)
    return out


def mask(seed, density, side=24):
    g = random.Random(seed)
    return {(y, x) for y in range(side) for x in range(side) if g.random() < density}


def spiral(n=31):
    """One long thin part; its ends are far apart."""
    out, y, x, dy, dx, length = set(), 0, 0, 0, 1, n
    for turn in range(2 * (n // 4)):
        for _ in range(max(1, length - 1)):
            out.add((y, x))
            y, x = y + dy, x + dx
        dy, dx = dx, -dy
        if turn % 2:
            length -= 2
    return out


MASKS = {"thin": mask(1, 0.15), "mid": mask(2, 0.4), "full": mask(3, 1.1), "spiral": spiral(), "one": {(5, -3)}, "low": mask(4, 0.3)}


def table(spark, masks):
    rows = [(k, y, x, "z") for k, m in masks.items() for y, x in m]
    return spark.createDataFrame(rows + rows[:5] + [("thin", None, 1, "z"), (None, 1, 1, "z")], PIXELS).repartition(4)


def test_parts(spark):
    labelled = blobs.parts(blobs.pixel_runs(table(spark, MASKS)))
    got = {(r.image, r.y, x): (r.root.y, r.root.x0) for r in labelled.collect() for x in range(r.x0, r.x1 + 1)}
    want = {(k, *p): root for k, m in MASKS.items() for p, root in flood(m).items()}
    assert got == want
    boxes = {(r.image, r.root.y, r.root.x0): (r.area, r.x0, r.y0, r.x1, r.y1) for r in blobs.part_boxes(labelled).collect()}
    for (k, *root), box in boxes.items():
        own = [p for p, at in flood(MASKS[k]).items() if at == tuple(root)]
        ys, xs = [y for y, _ in own], [x for _, x in own]
        assert box == (len(own), min(xs), min(ys), max(xs), max(ys))
    assert len(boxes) == len({(k, *r) for k, m in MASKS.items() for r in flood(m).values()})


def test_small_and_large_parts_go(spark):
    runs = blobs.pixel_runs(table(spark, MASKS))
    pixels = lambda df: {(r.image, r.y, x) for r in df.collect() for x in range(r.x0, r.x1 + 1)}
    small, glyphs = set(), set()
    for k, m in MASKS.items():
        root = flood(m)
        for at in set(root.values()):
            own = [p for p, r in root.items() if r == at]
            h, w = (max(p[i] for p in own) - min(p[i] for p in own) + 1 for i in (0, 1))
            small |= {(k, *p) for p in own if len(own) >= 4}
            glyphs |= {(k, *p) for p in own if not (w >= 5 and h >= 3 or len(own) >= 24)}
    assert pixels(blobs.without_small(runs, 4)) == small and pixels(blobs.glyphs_only(runs, 2.0)) == glyphs


def test_parts_across_cells(spark, monkeypatch):
    monkeypatch.setattr(blobs, "_CELL", (5, 7))
    test_parts(spark)


def test_parts_of_small_images_need_no_joins(spark, monkeypatch):
    monkeypatch.setattr(blobs, "connected", None)
    test_parts(spark)


def plain_difference(a, b, out, width, ink, changed):
    a, b = a - out, b - out
    near = lambda m, y, x: any((y + dy, x + dx) in m for dy in (-1, 0, 1) for dx in (-1, 0, 1))
    odd = {p for p in a if not near(b, *p)} | {p for p in b if not near(a, *p)}
    n = max(x for _, x in a | b) // width + 1
    per = lambda m, k: sum(x // width == k for _, x in m)
    hit = [per(odd, k) >= changed for k in range(n)]
    clusters = sum(h and not any(hit[max(0, k - 2) : k]) for k, h in enumerate(hit))
    return len(odd), len(a), len(b), sum(per(a | b, k) >= ink for k in range(n)), sum(hit), clusters


def test_difference(spark):
    g = random.Random(8)
    pairs = {str(i): (mask(i, 0.03, 90), mask(i + 50, 0.03, 90), {(y, x) for y in range(0, 90, 10) for x in range(90)} if i % 2 else set()) for i in range(4)}
    pairs["alike"] = ({(3, 3), (3, 4)}, {(4, 4)}, set())
    pairs["alone"] = ({(g.randrange(9), 70)}, set(), set())
    a, b, out = (table(spark, {k: m[i] for k, m in pairs.items()}) for i in range(3))
    got = {r.image: tuple(r)[1:] for r in blobs.ink_difference(a, b, out.filter("image IS NOT NULL"), width=8, least_ink=2, least_changed=12).filter("image IS NOT NULL").collect()}
    want = {k: plain_difference(*m, 8, 2, 12) for k, m in pairs.items()}
    assert got == want and want["alike"][0] == 0 and len({w[5] for w in want.values()}) > 1


def test_difference_at_edges_of_tiles(spark):
    """Bins of any width, ink on both sides of zero and across several tiles."""
    g = random.Random(5)
    some = lambda n: {(g.randrange(-70, 70), g.randrange(0, 260)) for _ in range(n)}
    pairs = {k: (some(900), some(900), some(200)) for k in "ab"}
    a, b, out = (spark.createDataFrame([(k, *p) for k, m in pairs.items() for p in m[i]], "image string, y int, x int") for i in range(3))
    for width in (8, 7, 1, 60, 100, 67):
        got = {r.image: tuple(r)[1:] for r in blobs.ink_difference(a, b, out, width=width, least_ink=5, least_changed=3).collect()}
        assert got == {k: plain_difference(*m, width, 5, 3) for k, m in pairs.items()}, width


def shuffled(spark, df):
    """Rows that the stages of ``df`` send each other."""
    sc, store = spark.sparkContext, spark.sparkContext._jsc.sc().statusStore()
    stages = lambda: store.stageList(None, False, False, sc._gateway.new_array(sc._jvm.double, 0), None)
    total = lambda: sum(stages().apply(i).shuffleWriteRecords() for i in range(stages().size()))
    before = total()
    df.write.format("noop").mode("overwrite").save()
    return total() - before


def test_difference_sends_no_row_for_each_neighbour(spark):
    ink = spark.range(200 * 200).select(F.lit("i").alias("image"), F.floor(F.col("id") / 200).alias("y"), (F.col("id") % 200).alias("x")).repartition(4)
    assert shuffled(spark, blobs.ink_difference(ink, ink)) < 1.5 * 2 * 200 * 200


def test_components(spark):
    edges = [(i + 1, i) for i in range(300)] + [(1000, 1001), (1001, 1000), (5, 5), (7, 7), (None, 3), (2000, None)] + [(5000, 6000 + i) for i in range(300)]
    got = {r.node: r.root for r in components.connected(spark.createDataFrame(edges, "a bigint, b bigint")).collect()}
    assert got == {i: 0 for i in range(301)} | {1000: 1000, 1001: 1000, 5000: 5000} | {6000 + i: 5000 for i in range(300)}


def test_no_ink(spark):
    none = blobs.pixel_runs(spark.createDataFrame([], PIXELS))
    assert blobs.parts(none).count() == 0 and blobs.glyphs_only(none, 3.0).count() == 0
    empty = spark.createDataFrame([], PIXELS)
    assert blobs.ink_difference(empty, empty).agg(F.count("*")).first()[0] == 0
