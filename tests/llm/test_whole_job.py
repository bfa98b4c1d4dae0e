
from __future__ import annotations

import base64
import collections
import math
import random
import zlib

import corpus_pipeline
import numpy as np
import pyarrow.parquet as pq
import pytest

from skyfold.llm import lm_score, ngram_join, secret_scan, sentencepiece_codec, sharding


@pytest.mark.parametrize("most_frequent", [400_000, 5, 0])
def test_scores_equal_a_model_in_memory(spark, monkeypatch, most_frequent):
    monkeypatch.setattr(lm_score, "MAX_FREQUENT", most_frequent)
    rng = random.Random(6)
    texts = [" ".join(f"w{int(rng.paretovariate(0.7))}" for _ in range(rng.randint(0, 60))) for _ in range(300)]
    texts[7] = None
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING").repartition(4)
    found = {r.doc_id: r for r in lm_score.score(docs, lm_score.train(docs.where("doc_id < 200"))).collect()}
    rows = [["<", *(text or "").split(), ">"] for text in texts]
    words, pairs = collections.Counter(), collections.Counter()
    for row in rows[:200]:
        words.update(row[1:])
        pairs.update(zip(row, row[1:], strict=False))
    n, unit = sum(words.values()), sum(words.values()) + len(words) + 1
    near = 0
    for i, row in enumerate(rows):
        score = 0.0
        for u, v in zip(row, row[1:], strict=False):
            earlier = 200 if u == "<" else words[u]
            level = int(lm_score.LEVELS.searchsorted(pairs[u, v], side="right"))
            quantised = min(int(lm_score._MIDDLES[level]), words[v], earlier)
            weight = lm_score.PAIR_WEIGHT * earlier / (earlier + lm_score.RELIABLE_COUNT)
            score += math.log10(weight * quantised / max(earlier, 1) + (1 - weight) * (words[v] + 1) / unit)
        base = sum(math.log10((words[w] + 1) / unit) for w in row[1:])
        assert found[i].base_score == pytest.approx(base, rel=1e-9) and found[i].train_tokens == n
        assert (found[i].n_tokens, found[i].n_known) == (len(row) - 1, sum(words[w] > 0 for w in row[1:]))
        assert found[i].score > score - 1e-9  # false positives can only raise it
        near += found[i].score < score + 0.05 * len(row)
    assert len(found) == 300 and near >= 290


def test_pair_filter_follows_the_corpus(spark):
    """About 30 GB, and a small corpus: the same bits a token, in a table and not in a broadcast."""
    for tokens, segments in ((5_000_000_000, 3750), (2_000_000, 64)):
        assert lm_score._segment_bits(lm_score.PAIR_BITS * tokens, segments) * segments >= lm_score.PAIR_BITS * tokens
    model = lm_score.train(spark.createDataFrame([(1, "a b c")], "doc_id LONG, text STRING"))
    assert sum(len(r.bits) for r in model.pairs.collect()) == model.pairs.count() * model.pair_bits // 8


def near_texts(*edits):
    """Texts of 40 words; every edit changes the words at its places."""
    return [" ".join(f"x{i}e{n}" if i in edit else f"w{i}" for i in range(40)) for n, edit in enumerate(edits)]


def test_near_copies_without_identifier_are_linked(spark):
    """Without one as the member (first pair), as the probe (the middle of a star), and as a bridge."""
    one, other = near_texts((), (0,))
    rows = [(1, one), (None, other)]
    star = [text.replace("w", "s") for text in near_texts((), *[(i,) for i in (0, 39, 1, 38)])]
    rows += [(None, star[0]), *[(10 + i, text) for i, text in enumerate(star[1:])]]
    bridge = [text.replace("w", "b") for text in near_texts((0,), (), (39,))]
    rows += [(20, bridge[0]), (None, bridge[1]), (21, bridge[2]), (None, "quite another text of a few words"), (None, None)]
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING").repartition(3)
    found = [(r.doc_id, r.component_id) for r in ngram_join.jaccard_components(docs, 3, 90).collect()]
    assert collections.Counter(found) == collections.Counter(
        [(1, 1), (None, 1), (None, 10), *[(10 + i, 10) for i in range(4)], (20, 20), (None, 20), (21, 20), (None, None), (None, None)]
    )


def test_a_group_without_probe_is_no_group_of_the_one_before():
    import pyarrow as pa

    text = b"a b c d e f"
    rows = pa.RecordBatch.from_pydict({"probe": [1, 1, 2], "part": [0, 0, 0], "member": [None, 5, 6], "text": [text] * 3})
    with pytest.raises(RuntimeError):
        list(ngram_join._tree_links(3, 90)(iter([rows])))


@pytest.mark.parametrize("part_sets", [2048, 5])
def test_all_links_of_a_group_are_counted(spark, monkeypatch, part_sets):
    monkeypatch.setattr(ngram_join, "PART_SETS", part_sets)
    rng = random.Random(8)
    texts = near_texts(*[rng.sample((0, 1, 2, 38, 39), rng.randint(0, 2)) for _ in range(30)])
    texts += [text.replace("w", "v") for text in near_texts((0,), (39,))] + texts[:3] + ["alone", None]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING").repartition(3)
    sets = [frozenset(zip(*[(text or "").split()[k:] for k in range(3)], strict=False)) for text in texts]
    similar = lambda a, b: a != b and 100 * len(a & b) >= 90 * len(a | b)
    expected = {i: sum(similar(own, other) for other in set(sets) if own and other) for i, own in enumerate(sets)}
    found = {r.doc_id: r.n_links for r in ngram_join.jaccard_components(docs, 3, 90).collect()}
    assert found == expected and max(expected.values()) > 5


def test_counts_of_links_equal_plain_comparison(monkeypatch):
    monkeypatch.setattr(ngram_join, "COLUMNS", 7)
    rng = random.Random(9)
    sets = [np.array(sorted(rng.sample(range(40), rng.randint(1, 40))), np.uint64) for _ in range(40)]
    similar = [[100 * len(np.intersect1d(a, b)) >= 50 * len(np.union1d(a, b)) for b in sets] for a in sets]
    assert ngram_join.link_counts(sets, None, 50)[0].tolist() == [sum(row) - 1 for row in similar]
    one, two = ngram_join.link_counts(sets[:15], sets[15:], 50)
    assert one.tolist() == [sum(row[15:]) for row in similar[:15]]
    assert two.tolist() == [sum(row[i] for row in similar[:15]) for i in range(15, 40)]


def test_named_values_and_tokens_of_one_case_are_found(spark):
    rng = random.Random(10)
    lower, upper, digits = "abcdefghijklmnopqrstuvwxyz", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "0123456789"
    kinds = {
        "auth=": lower + upper + digits, "sig=": lower + upper + digits + "+/", "AWS_KEY=": lower + upper + digits,
        "lower ": lower + digits, "upper ": upper + digits, "base32 ": lower + "234567", "pwd=": lower + digits,
    }
    texts, planted = [], []
    for name, alphabet in kinds.items():
        for _ in range(30):
            words = ["".join(rng.choice(("th", "er", "an", "in", "ou")) for _ in range(rng.randint(1, 6))) for _ in range(40)]
            words[5:8] = ["averyordinaryidentifier" + words[3], "option=averyordinaryidentifierof" + words[4], "name=" + words[2]]
            planted.append((name, "".join(rng.choice(alphabet) for _ in range(rng.choice((48, 64, 90))))))
            words[20] = name + planted[-1][1]
            texts.append(" ".join(words))
    rows = secret_scan.secret_spans(spark.createDataFrame(list(enumerate(texts)), "doc_id LONG, text STRING")).collect()
    found = {r.doc_id: [texts[r.doc_id][s.start : s.end] for s in r.random_spans] for r in rows}
    hits = collections.Counter(name for i, (name, value) in enumerate(planted) if value in found[i])
    assert all(hits[name] >= 27 for name in kinds), hits
    assert sum(len(spans) for spans in found.values()) <= len(planted) * 1.02


def test_padding_stays_with_its_run(spark):
    value = base64.b64encode(random.Random(11).randbytes(49)).decode().rstrip("=")
    docs = spark.createDataFrame([(i, f"name={value}== y") for i in range(5)], "doc_id LONG, text STRING")
    assert {tuple((s.start, s.end) for s in r.random_spans) for r in secret_scan.secret_spans(docs).collect()} == {((5, 73),)}


def test_pieces_come_from_the_rebuilt_tokenizer(monkeypatch):
    class Rebuilt:
        def encode_batch_fast(self, part, add_special_tokens):
            assert part == ["▁same", "▁other"]
            return [type("Encoding", (), {"ids": own}) for own in ([1, 2], [1, 2])]

        def decode_batch(self, ids, skip_special_tokens):
            return [str(x) for x in ids]

    class Reference:
        def encode(self, part, out_type, num_threads):
            return [np.array([1, 2]), np.array([3])]

    class Both(sentencepiece_codec.Codec):
        def __init__(self, data):
            self.tokenizer, self.reference = Rebuilt(), Reference()
            self.model = sentencepiece_codec.PieceModel([], sentencepiece_codec.BPE, True, 0, b"", True, False, True)

    monkeypatch.setattr(sentencepiece_codec, "codec", Both)
    ids, parity = sentencepiece_codec.encode_batch(b"", ["same", "other"])
    assert ids == [[1, 2], [3]] and parity == [True, False]


def test_any_text_has_the_reference_pieces_and_comes_back():
    with open(corpus_pipeline.PIECE_MODEL, "rb") as file:
        data = file.read()
    rng = random.Random(12)
    letters = ["a", "the ", " ", "  ", "\n", "é", "日本", "\U0001f600", "house", "\x01", "1", "Zx"]
    texts = ["".join(rng.choices(letters, k=rng.randint(0, 40))) for _ in range(400)] + ["", " ", "x" * 5000]
    ids, parity = sentencepiece_codec.encode_batch(data, texts)
    assert all(parity) and sentencepiece_codec.decode_batch(data, ids) == texts


@pytest.mark.parametrize("lang", [None, "en"])
def test_language_stage_keeps_texts_without_labels(spark, lang):
    """Without any label, and with the only label on a row that the query would hold out."""
    rows = [(1, "the house", None), (2, "12 34", None), (3, None, None), (5, "the dog", None), (6, "a cat", None), (8, "a bird", None)]
    labelled = next(i for i, row in enumerate(rows) if row[0] not in (2, 3) and zlib.crc32(str(row[0]).encode()) % 3 == 1)
    rows[labelled] = (*rows[labelled][:2], lang)
    docs = spark.createDataFrame(rows, "doc_id LONG, text STRING, lang STRING")
    assert sorted(r.doc_id for r in corpus_pipeline.identify_language(spark, docs, None).collect()) == [1, 5, 6, 8]


def test_shards_of_more_than_ten_digits(spark):
    n, megabytes = 660, 8
    docs = spark.range(n, numPartitions=8).selectExpr("id AS doc_id", f"repeat('x', {megabytes} * 1000000) AS text")
    rows = sharding.byte_shards(docs, 5).collect()
    assert 2 * sum(r.size for r in rows) > 10**10
    assert [(r.shard, r.slot) for r in sorted(rows)] == [divmod(i, n // 5) for i in range(n)]


def test_packed_texts_are_read_a_few_at_a_time(spark, monkeypatch):
    tables, write = [], lm_score.written_table
    monkeypatch.setattr(lm_score, "written_table", lambda *a, **k: tables.append(write(*a, **k)) or tables[-1])
    docs = spark.range(12, numPartitions=1).selectExpr("id AS doc_id", f"repeat(concat('w', id, ' '), {lm_score.CHUNK_BYTES} div 4) AS text")
    lm_score.score(docs, lm_score.train(docs.limit(1)))
    files = [pq.ParquetFile(path.removeprefix("file://")).metadata for path in tables[-1].inputFiles()]
    in_groups = [file.row_group(i).num_rows for file in files for i in range(file.num_row_groups)]
    assert sum(in_groups) == 12 and max(in_groups) <= 3
