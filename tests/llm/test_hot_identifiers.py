"""One identifier, or one repeated row, that holds most of all rows."""

from __future__ import annotations

from collections import Counter

import pytest

from skyfold.llm import mixing, sharding

N = 20_000


@pytest.fixture
def written(spark, monkeypatch):
    """Tables written by the sharding, in order; small partitions stay as they are."""
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tables, write = [], sharding.written_table
    monkeypatch.setattr(sharding, "written_table", lambda frame: tables.append(write(frame)) or tables[-1])
    yield tables
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")


@pytest.mark.parametrize("text", ["repeat('x', int(id % 50))", "'same'"])
def test_shards_cut_one_identifier(spark, written, text):
    docs = spark.range(N, numPartitions=8).selectExpr("CASE WHEN id % 10 = 0 THEN id END AS doc_id", f"{text} AS text")
    rows = sharding.byte_shards(docs, 7).collect()
    assert len(rows) == N
    by_part = Counter(r.part for r in written[0].select("part").collect())
    assert len(by_part) > 4 and max(by_part.values()) < N / 2
    totals = Counter()
    for row in rows:
        totals[row.shard] += row.size
    assert max(totals.values()) - min(totals.values()) < 2 * max(r.size for r in rows)
    for shard in range(7):
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


@pytest.mark.parametrize(
    ("doc_id", "text"),
    [("id", "'a b c'"), ("NULL", "'a b c'"), ("1", "concat('a b ', id)"), ("id % 3", "if(id % 2 = 0, 'a b c', 'a b c d')")],
)
def test_mix_cuts_one_identifier(spark, monkeypatch, doc_id, text):
    torn, of_cut = [], mixing._torn
    monkeypatch.setattr(mixing, "_torn", lambda rows: torn.append(rows) or of_cut(rows))
    docs = spark.range(N, numPartitions=8).selectExpr(f"CAST({doc_id} AS BIGINT) AS doc_id", f"{text} AS text", "'s' AS source")

    def mixed():
        return Counter(mixing.mix(docs, weights=(1,), share=0.37).selectExpr("doc_id", "size", "times", "target").collect())

    found = mixed()
    assert sum(found.values()) == N
    target = round(next(iter(found)).target)
    assert abs(sum(r.size * r.times * n for r, n in found.items()) - target) <= 2
    assert all(0 <= r.times <= 2 for r in found)
    if "id" in (doc_id, text[-3:-1]):
        assert torn[0].count() < N / 100
    assert mixed() == found


def test_mix_repeats_whole_passes(spark):
    docs = spark.createDataFrame([(1, "a b", "x")] * 5 + [(None, "c", None)] * 3 + [(2, "", "x")], "doc_id bigint, text string, source string")
    rows = mixing.mix(docs, weights=(1,), share=2.0).collect()
    assert Counter((r.size, r.times) for r in rows) == {(2, 2): 5, (1, 2): 3, (0, 2): 1}
