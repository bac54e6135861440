import random

from skein.llm import license_scan

MIT = """The MIT License (MIT)

Permission is hereby granted, free of charge, to any person obtaining a copy
of this software and associated documentation files (the "Software"), to deal
in the Software without restriction, including without limitation the rights
to use, copy, modify, merge, publish, distribute, sublicense, and/or sell
copies of the Software."""
BSD = """ * Redistribution and use in source and binary forms, with or without
 * modification, are permitted provided that the following conditions
 * are met:"""
GPL = """# This program is free software: you can redistribute it and/or modify
# it under the terms of the GNU General Public License as published by
# the Free Software Foundation, either version 3 of the License."""


def brute(text, threshold=0.8):
    """All windows of all sizes, by place."""
    words = "".join(c if c.isascii() and c.isalnum() else " " for c in (text or "").lower()).split()
    grams = [f"{a} {b}" for a, b in zip(words, words[1:], strict=False)]
    found = []
    for i, (name, template) in enumerate(sorted(license_scan.TEMPLATES)):
        own = set(license_scan.bigrams(template))
        most = int(len(own) * (2 - threshold) / threshold + 1e-9)
        for a in range(len(grams)):
            for b in range(a, min(a + most, len(grams))):
                g = set(grams[a : b + 1])
                dice = 2 * len(g & own) / (len(g) + len(own))
                if dice >= threshold and grams[a] in own and grams[b] in own:
                    found.append((-dice, a, -b, i, name))
    kept = []
    for d, a, b, _, name in sorted(found):
        if all(x > -b + 1 or y + 1 < a for x, y, _, _ in kept):
            kept.append((a, -b, name, -d))
    return [(name, round(d, 9)) for _, _, name, d in sorted(kept)]


def test_wrapped_and_embedded_notices(docs):
    rows = [(1, MIT), (2, MIT.replace("\n", " ")), (3, BSD), (4, GPL), (5, "one two\n\n" + GPL + "\nmiddle\n" + BSD), (6, None), (7, ""), (8, "x"), (9, "a license of the software")]
    got = {r.doc_id: [(p.line, p.last_line, p.license) for p in r.passages] for r in license_scan.scan(docs(rows)).collect()}
    assert got == {1: [(2, 3, "MIT")], 2: [(0, 0, "MIT")], 3: [(0, 2, "BSD-3-Clause")], 4: [(0, 2, "GPL-3.0")], 5: [(2, 4, "GPL-3.0"), (6, 8, "BSD-3-Clause")], 6: [], 7: [], 8: [], 9: []}


def test_passages_are_all_windows(docs):
    g = random.Random(5)
    rows = [(0, MIT), (1, GPL + " " + GPL)]
    for i in range(2, 60):
        text = []
        for _ in range(g.randint(1, 3)):
            words = g.choice(license_scan.TEMPLATES)[1].split()
            words = [w for w in words if g.random() > 0.06]
            for _ in range(g.randint(0, 2)):
                words.insert(g.randrange(len(words) + 1), g.choice(["the", "of", "license", "other"]))
            text += words[: max(2, int(len(words) * g.uniform(0.7, 1)))] + ["filler"] * g.randint(0, 2)
        rows.append((i, "".join(w + g.choice("   \n") for w in text)))
    got = {r.doc_id: [(p.license, round(p.dice, 9)) for p in r.passages] for r in license_scan.scan(docs(rows)).collect()}
    want = {i: brute(t) for i, t in rows}
    assert got == want
    assert sum(map(len, want.values())) > 40
