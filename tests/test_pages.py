import random

import numpy as np

from skein.operators import pages
from skein.sources import synthetic

CLASSIFY = pages.by_templates({c: pages.describe(synthetic.digit(c)) for c in synthetic.DIGITS})


def test_pages_read_back():
    g = random.Random(1)
    for _ in range(12):
        tab = ["|" if g.random() < 0.15 else {s: g.randrange(25) for s in g.sample(range(1, 7), g.choice([1, 1, 2, 3]))} for _ in range(12)]
        want, bar = [], False
        for e in tab:
            if e != "|":
                want.append((sorted(e.items()), bar))
            bar = e == "|"
        systems = pages.read_page(synthetic.tab_page(tab), CLASSIFY)
        assert len(systems) == 1
        assert [([(n["string"], n["fret"]) for n in e["notes"]], e["bar_before"]) for e in systems[0]["events"]] == want


def test_blank_and_lines_only():
    assert pages.read_page(np.zeros((80, 120), np.uint8), CLASSIFY) == []
    assert pages.read_page(synthetic.tab_page([]), CLASSIFY)[0]["events"] == []


def test_islands():
    m = np.array([1, 0, 1, 0, 0, 1, 1], bool)
    assert pages.islands(m) == [(0, 0), (2, 2), (5, 6)] and pages.islands(m, 1) == [(0, 2), (5, 6)] and pages.islands(m & False) == []


def test_pages_of_a_table(spark):
    tabs = {0: [{6: 3, 5: 2}, "|", {4: 12, 1: 7}, {3: 24}], 1: [{1: 0, 2: 1, 3: 5}, {6: 20}], 2: []}
    planes = {k: synthetic.tab_page(v) for k, v in tabs.items()}
    rows = [(k, p.shape[1], p.shape[0], bytearray(p.tobytes())) for k, p in planes.items()]
    found = pages.read_pages(spark.createDataFrame(rows, "page_id int, w int, h int, px binary"), CLASSIFY)
    got = sorted((r.page_id, r.event, r.string, r.fret, r.bar_before) for r in found.collect())
    assert got == [(0, 0, 5, 2, False), (0, 0, 6, 3, False), (0, 1, 1, 7, True), (0, 1, 4, 12, True), (0, 2, 3, 24, False), (1, 0, 1, 0, False), (1, 0, 2, 1, False), (1, 0, 3, 5, False), (1, 1, 6, 20, False)]
