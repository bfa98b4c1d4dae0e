"""Every operator on nulls, empty and very long texts, ties, repeated rows, empty tables and clashing columns."""

from __future__ import annotations

import corpus_pipeline
import pytest

from skyfold.llm import (
    exact_dedup,
    language_id,
    lm_score,
    minhash_dedup,
    mixing,
    ngram_join,
    quality_model,
    quality_rules,
    secret_scan,
    sentencepiece_codec,
    sharding,
)
from skyfold.llm.queries import PIECE_MODEL

COLUMNS = "doc_id LONG, text STRING, lang STRING, source STRING, n_chars LONG, keep_id STRING, size STRING, n STRING, run STRING, shard STRING, part STRING, key STRING, target STRING, score STRING, set_id STRING, kept STRING, label STRING"
LONG = "la maison est grande et le jardin " * 20_000
TEXTS = [
    (1, None, "fr", "a"),
    (2, "", None, None),
    (3, " \t\n", "en", "a"),
    (4, "The house is big", "en", "a"),
    (5, "THE house is big", "en", None),
    (5, "THE house is big", "en", None),
    (None, "the dog and the cat", "en", "b"),
    (None, None, None, None),
    (6, "12 34 !!", "de", "b"),
    (7, LONG, "fr", "b"),
    (8, "x", "fr", "b"),
    (9, "ÄÖ ß \U0001f600 \u0000 ▁", "de", "c"),
    (9, "another text with the same number", None, "c"),
]


@pytest.fixture(scope="module")
def edge(spark):
    rows = [(*row[:2], *row[2:], None, *["extra"] * 12) for row in TEXTS]
    return spark.createDataFrame(rows, COLUMNS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(4, 1), (7, 0), (7, 1), (8, 0), (None, 1), (1, None)], "doc_id LONG, quality INT")


OPERATORS = {
    "exact": lambda docs, labels: exact_dedup.exact_dedup(docs),
    "quality": lambda docs, labels: quality_model.score(docs, quality_model.train(docs, labels)),
    "join": lambda docs, labels: ngram_join.jaccard_components(docs, words=3, percent=90),
    "pieces": lambda docs, labels: sentencepiece_codec.encode(docs, PIECE_MODEL),
    "lm": lambda docs, labels: lm_score.score(docs, lm_score.train(docs)),
    "language": lambda docs, labels: language_id.identify(docs, language_id.learn_profiles(docs)),
    "secrets": lambda docs, labels: secret_scan.secret_spans(docs),
    "minhash": lambda docs, labels: minhash_dedup.near_duplicates(docs, words=4, percent=80),
    "shards": lambda docs, labels: sharding.byte_shards(docs, 40),
    "mix": lambda docs, labels: mixing.mix(docs),
    "rules": lambda docs, labels: quality_rules.cascade(
        quality_rules.measured(docs), quality_rules.ordered(quality_rules.RULES, quality_rules.estimate(quality_rules.sample(docs, 0.9, 1)))
    ),
}


@pytest.mark.parametrize("name", OPERATORS)
def test_one_row_per_document(edge, labels, name):
    rows = OPERATORS[name](edge, labels).collect()
    assert sorted(str(r.doc_id) for r in rows) == sorted(str(t[0]) for t in TEXTS)


@pytest.mark.parametrize("name", OPERATORS)
def test_empty_table(edge, labels, name):
    assert OPERATORS[name](edge.limit(0), labels).collect() == []


def found(frame, *columns):
    return sorted({(str(r.doc_id), *[r[c] for c in columns]) for r in frame.collect()}, key=str)


def test_exact_dedup_cases(edge):
    rows = found(exact_dedup.exact_dedup(edge, keep="largest"), "keep_id", "group_size", "kept")
    assert ("2", 2, 3, True) in rows and ("1", 2, 3, False) in rows and ("None", 2, 3, False) in rows
    assert ("4", 5, 3, False) in rows and ("5", 5, 3, True) in rows
    assert ("None", None, 1, True) in rows


def test_join_cases(edge):
    rows = found(ngram_join.jaccard_components(edge, words=3, percent=90), "n_shingles", "component_id")
    assert ("1", 0, 1) in rows and ("3", 0, 3) in rows and ("5", 2, 4) in rows and ("8", 1, 8) in rows and ("7", 7, 7) in rows


def test_language_cases(edge):
    rows = dict(found(language_id.identify(edge, language_id.learn_profiles(edge)), "lang_pred"))
    assert rows["1"] == rows["2"] == rows["3"] == rows["6"] == "und" and rows["7"] == "fr" and rows["4"] == "en"


def test_mix_cases(edge):
    rows = mixing.mix(edge).collect()
    assert all(r.times in (0, 1, 2) for r in rows)
    assert {r.size for r in rows if r.doc_id in (1, 2, 3)} == {0}
    taken = sum(r.times * r["size"] for r in rows)
    assert abs(taken - sum({(r.source, r.target) for r in rows} and {(r.source, r.target): r.target for r in rows}.values())) <= 140_000


def test_pieces_cases(edge):
    rows = {(str(r.doc_id), r.n_tokens): r for r in sentencepiece_codec.encode(edge, PIECE_MODEL).collect()}
    assert rows["1", 0].ids == [] and rows["2", 0].round_trip
    assert all(r.parity for r in rows.values())


def test_shard_cases(edge):
    rows = sharding.byte_shards(edge, 40).collect()
    assert {r.shard for r in rows} <= set(range(40)) and {r["size"] for r in rows if r.doc_id == 1} == {16}
    for shard in {r.shard for r in rows}:
        assert sorted(r.slot for r in rows if r.shard == shard) == list(range(sum(r.shard == shard for r in rows)))


@pytest.mark.parametrize("stage", range(len(corpus_pipeline.STAGES)))
def test_stages(spark, edge, stage):
    name, function = corpus_pipeline.STAGES[stage]
    result = function(spark, edge, None)
    rows = result.collect()
    if stage < len(corpus_pipeline.STAGES) - 1:
        assert result.columns == edge.columns and result.schema.simpleString() == edge.schema.simpleString()
        assert {r.keep_id for r in rows} <= {"extra"}
    empty = function(spark, edge.limit(0), None)
    assert empty.collect() == []
    if name == "language":
        assert sorted(str(r.doc_id) for r in rows) == ["4", "5", "5", "7", "8", "9", "9", "None"]
    if name == "exact_copies":
        assert sorted(str(r.doc_id) for r in rows) == ["1", "3", "4", "6", "7", "8", "9", "9", "None"]
