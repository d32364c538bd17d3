"""The mix against a plain loop, and its edge cases."""

import pytest
from pyspark.sql import functions as F

from layerstack.llm import curriculum


def water(sizes, weights=curriculum.WEIGHTS, most=3):
    """Targets by the iterative rule: cap, reshare the excess by weight, until none is above."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    w = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    total, target, free = sum(sizes.values()), {}, set(names)
    left = total
    while free:
        share = {s: left * w[s] / sum(w[x] for x in free) for s in free}
        over = {s for s in free if share[s] > most * sizes[s]}
        if not over:
            return target | share
        for s in over:
            target[s] = most * sizes[s]
            left -= target[s]
        free -= over
    return target


@pytest.fixture(scope="module")
def docs(spark):
    rows = []
    for i in range(400):
        source = [None, "b", "a", "ä", "Z", "tiny", "hot", "hot", "hot"][i % 9]
        words = 0 if source == "tiny" and i > 20 else (i * 7919) % 60
        rows.append((i, " ".join(["w"] * words) + "\n", source, i))
    rows += [(5, "same\ttext here", "b", 1)] * 3 + [(None, None, "null text only", 1), (None, None, None, 0)]
    return spark.createDataFrame(rows, "doc_id long, text string, source string, Taken int")


def test_mix(docs):
    rows = curriculum.mix(docs).collect()
    assert len(rows) == docs.count()
    sizes, taken = {}, {}
    for r in rows:
        assert r["size"] == len((r.text or "").split())
        assert 0 <= r.taken <= 3 * r["size"]
        sizes[r.source] = sizes.get(r.source, 0) + r["size"]
        taken[r.source] = taken.get(r.source, 0) + r.taken
    expected = water(sizes)
    for r in rows:
        assert r.source_size == sizes[r.source]
        assert r.target == pytest.approx(expected[r.source])
    for s, t in taken.items():
        assert abs(t - expected[s]) <= 1
    assert sum(expected.values()) == pytest.approx(sum(sizes.values()))
    at = [r.position for r in rows if r.position is not None]
    assert at == sorted(at) and 0 <= at[0] and at[-1] <= sum(sizes.values())
    assert [r.position for r in rows[len(at):]] == [None] * (len(rows) - len(at))
    assert rows == curriculum.mix(docs.repartition(5)).collect() or {
        (r.doc_id, r.taken, r.position) for r in rows
    } == {(r.doc_id, r.taken, r.position) for r in curriculum.mix(docs.repartition(5)).collect()}


def test_positions_invert_the_schedule(docs):
    for r in curriculum.mix(docs).where("copies > 0").collect():
        t = r.position / r.total
        demand = r.target * ((1 - r.tilt) * t + r.tilt * t * t)
        assert demand == pytest.approx(r.line_start, abs=1e-6)


def test_expand(docs):
    mixed = curriculum.mix(docs)
    out = curriculum.expand(mixed)
    rows = out.collect()
    per = {}
    for r in rows:
        per[r.source] = per.get(r.source, 0) + len(r.text.split())
    wanted = {r.source: r.t for r in mixed.groupBy("source").agg(F.sum("taken").alias("t")).collect()}
    assert {k: v for k, v in wanted.items() if v} == per
    assert [r.position for r in rows] == sorted(r.position for r in rows)


def test_empty_and_wordless(spark):
    schema = "doc_id long, text string, source string"
    assert curriculum.mix(spark.createDataFrame([], schema)).count() == 0
    rows = curriculum.mix(spark.createDataFrame([(1, "", "a"), (2, None, None)], schema)).collect()
    assert [(r.taken, r.target, r.position) for r in rows] == [(0, 0.0, None)] * 2


def test_one_source_is_taken_once(spark):
    df = spark.createDataFrame([(1, "a b", "s"), (2, "c", "s")], "doc_id long, text string, source string")
    assert sorted((r.doc_id, r.taken) for r in curriculum.mix(df).collect()) == [(1, 2), (2, 1)]
