"""Contraction of regions against going through them one by one."""

import random
from collections import Counter, defaultdict

import pytest

from tilth.operators import regions


def brute(own, borders, limit, dissolve=True):
    """own: id -> [area, kind, confidence]; specks one by one, the smallest first, by the longest border."""
    area = {k: v[0] for k, v in own.items()}
    held, of = {k: v[0] * v[2] for k, v in own.items()}, dict(area)
    edges = defaultdict(Counter)
    for (a, b), n in borders.items():
        edges[a][b] += n
        edges[b][a] += n
    into = {k: k for k in own}
    for _ in range(regions.PASSES):
        merged = False
        for t in sorted((k for k in area if 0 < area[k] < limit), key=lambda k: (area[k], k)):
            if not edges[t]:
                continue
            host = min(edges[t], key=lambda j: (-edges[t][j], j))
            for j, n in edges.pop(t).items():
                del edges[j][t]
                if j != host:
                    edges[j][host] += n
                    edges[host][j] += n
            if own[t][1] == own[host][1]:
                held[host] += held[t]
                of[host] += of[t]
            area[host] += area.pop(t)
            into = {k: host if v == t else v for k, v in into.items()}
            merged = True
        if not merged:
            break
    name = {k: k for k in area}
    if dissolve:
        for _ in area:
            for a in area:
                for b in edges[a]:
                    if own[a][1] == own[b][1]:
                        name[a] = name[b] = min(name[a], name[b])
    out = defaultdict(lambda: [None, 0.0, 0.0])
    for k in area:
        f = out[name[k]]
        f[0], f[1], f[2] = own[k][1], f[1] + area[k], f[2] + held[k] / of[k] * area[k]
    members = {k: name[v] for k, v in into.items()}
    return {k: (v[0], round(v[1], 6), round(v[2] / v[1], 4)) for k, v in out.items()}, members


def made(seed, size=12):
    rnd = random.Random(seed)
    seeds = [(rnd.randrange(size), rnd.randrange(size)) for _ in range(size * 3)]
    cells = {(r, c): min(range(len(seeds)), key=lambda k: ((seeds[k][0] - r) ** 2 + (seeds[k][1] - c) ** 2, k)) for r in range(size) for c in range(size)}
    for _ in range(size):
        cells[rnd.randrange(size), rnd.randrange(size)] = 100 + rnd.randrange(size * 2)
    return cells, rnd


@pytest.mark.parametrize(("seed", "dissolve"), [(1, True), (2, True), (3, False)])
def test_rounds_are_the_sequence(spark, seed, dissolve):
    cells, rnd = made(seed)
    count = Counter(cells.values())
    own = {k: [0.01 * n, rnd.choice("xyz"), rnd.randrange(1, 10) / 10] for k, n in count.items()}
    borders = Counter()
    for (r, c), a in cells.items():
        for b in (cells.get((r + 1, c)), cells.get((r, c + 1))):
            if b is not None and b != a:
                borders[min(a, b), max(a, b)] += 1
    got_borders = regions.grid_borders(spark.createDataFrame([(r, c, k) for (r, c), k in cells.items()], "row int, column int, region long"))
    assert {(r.a, r.b): r.length for r in got_borders.collect()} == borders
    df = spark.createDataFrame([(k, *v) for k, v in own.items()], "id long, area double, kind string, confidence double")
    fields, member = regions.fields(df, got_borders, 0.045, dissolve)
    want, members = brute(own, borders, 0.045, dissolve)
    assert {r.field_id: (r.kind, round(r.area, 6), round(r.confidence, 4)) for r in fields.collect()} == want
    assert {r.id: r.field_id for r in member.collect()} == members
    assert {r.field_id: r.regions for r in fields.collect()} == Counter(members.values())
    assert sum(a < 0.045 for a, *_ in own.values()) > 10


def test_speck_chain_and_lone_speck(spark):
    """A chain of specks ends in the field at its end; a speck without neighbours stays."""
    df = spark.createDataFrame([(1, 1.0, "x", 0.5), (2, 0.01, "y", 0.9), (3, 0.02, "x", 0.9), (4, 0.01, "x", 0.1)], "id long, area double, kind string, confidence double")
    borders = spark.createDataFrame([(2, 3, 5.0), (1, 3, 1.0)], "a long, b long, length double")
    fields, member = regions.fields(df, borders, 0.05)
    got = {r.field_id: r for r in fields.collect()}
    assert set(got) == {1, 4} and got[1].area == pytest.approx(1.03) and got[1].regions == 3
    assert {r.id: r.field_id for r in member.collect()} == {1: 1, 2: 1, 3: 1, 4: 4}
    assert got[1].confidence == pytest.approx((0.5 + 0.02 * 0.9) / 1.02)


def test_limit_and_empty_tables(spark):
    assert regions.speck_limit(0.2) == 0.05 and regions.speck_limit(0.02) == 0.015
    none = spark.createDataFrame([], "id long, area double, kind string, confidence double")
    fields, member = regions.fields(none, spark.createDataFrame([], "a long, b long, length double"), 0.05)
    assert fields.count() == 0 and member.count() == 0
