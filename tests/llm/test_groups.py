"""Groups of near-duplicates: ids that repeat with other texts, and long chains of links."""

import random

from conftest import save

from chalkline.llm import registry
from chalkline.operators import components


def test_repeated_id_that_is_not_the_smallest(spark, tmp_path):
    rng = random.Random(8)
    prose = lambda: " ".join("".join(rng.choice("abcdefgh") for _ in range(6)) for _ in range(80))
    a, b, c, d = (prose() for _ in range(4))
    rows = [(6, a, "s"), (7, a, "s"), (7, b, "s"), (11, b, "s"), (20, c, "s"), (21, d, "s"), (30, c, "s"), (30, d, "s"), (40, prose(), "s"), (None, b, "s")]
    found = registry.QUERIES["op8_bottom_k"](spark, save(tmp_path, rows)).select("doc_id", "component_id", "kept").collect()
    assert sorted((r[0] or 0, r[1], r[2]) for r in found) == [
        (0, 6, False), (6, 6, True), (7, 6, False), (7, 6, False), (11, 6, False), (20, 20, True), (21, 20, False), (30, 20, False), (30, 20, False), (40, 40, True),
    ]


def test_long_chains_take_few_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(components, "scratch_table", lambda df, name, put=components.scratch_table: written.append(name) or put(df, name))
    rng = random.Random(9)
    chain = [(i, i + 1) for i in range(1, 200)]
    loose = [(1000 + rng.randrange(60), 1000 + rng.randrange(60)) for _ in range(40)]
    hub = [(3000, 3000 + i) for i in range(1, 40)] + [(2999, 3020), (None, 1), (5, 5)]
    links = chain + loose + hub
    up = {x: x for link in links for x in link if x is not None and link[0] is not None and link[0] != link[1]}
    for _ in up:
        for a, b in links:
            if a in up and b in up:
                up[a] = up[b] = min(up[a], up[b])
    found = components.connected_components(spark.createDataFrame(links, "a long, b long")).collect()
    assert sorted(tuple(r) for r in found) == sorted(up.items())
    assert len(written) <= 30, len(written)
