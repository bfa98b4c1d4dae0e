"""The five stages, one by one and in a row, against plain restatements."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter, defaultdict

import corpus_pipeline as pipeline
import pytest
import regex
import sentencepiece

SF_DIR = "/root/testdata/sf0.001"
WORD = re.compile(r"[^\x20\x09-\x0D]+")
COLUMNS = "doc_id LONG, text STRING, lang STRING, source STRING, _row STRING, kept STRING, times STRING"


def folded(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingles(text, n=5):
    words = WORD.findall(folded(text))
    return {tuple(words[i : i + n]) for i in range(max(1, len(words) - n + 1))} if words else set()


def first_of_groups(rows, same):
    """Of rows joined by ``same`` the first of each group."""
    group = list(range(len(rows)))

    def root(i):
        while group[i] != i:
            i = group[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        if root(i) != root(j) and same(i, j):
            low, high = sorted((root(i), root(j)))
            group[high] = low
    return [row for i, row in enumerate(rows) if root(i) == i]


def in_order(rows):
    """Own identifiers by number, then rows without one or with a repeated one."""
    times = Counter(row[0] for row in rows)
    return sorted(rows, key=lambda row: (row[0] is None or times[row[0]] > 1, row[0] or 0))


def lettered(rows):
    return [row for row in rows if regex.search(r"\p{L}", row[1] or "")]


def distinct(rows):
    return list({folded(row[1]): row for row in reversed(in_order(rows))}.values())


def unlike(rows):
    rows = in_order(rows)
    sets = [shingles(row[1]) for row in rows]
    return first_of_groups(rows, lambda i, j: len(sets[i] & sets[j]) * 100 >= 80 * len(sets[i] | sets[j]) > 0)


def targets(rows):
    sizes = defaultdict(int)
    for row in rows:
        sizes[row[3]] += len(WORD.findall(row[1] or ""))
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weights = dict(zip(names, itertools.cycle((5, 2, 1)), strict=False))
    left, found, total = set(names), {}, 1.5 * sum(sizes.values())
    while left:
        share = total / sum(weights[s] for s in left)
        over = [s for s in left if share * weights[s] > 2 * sizes[s]]
        if not over:
            return found | {s: share * weights[s] for s in left}
        for s in over:
            found[s] = 2 * sizes[s]
            total -= found[s]
            left.remove(s)
    return found


def corpus(seed=1):
    rng = random.Random(seed)
    words = ["house", "Garden", "the", "maison", "grande", "und", "ein", "123", "is", "jardin"]
    rows = []
    for i in range(60):
        text = " ".join(rng.choices(words, k=rng.randint(1, 60)))
        rows.append((rng.choice([i, i, None, 7]), text, rng.choice(["en", None]), rng.choice(["a", "b", None])))
        if i % 4 == 0:
            edited = text.split()
            edited[rng.randrange(len(edited))] = "other"
            rows += [(100 + i, text.upper(), None, "a"), (rng.choice([200 + i, None]), " ".join(edited), None, "c"), rows[-1]]
    rows += [(None, None, None, None), (7, None, None, "a"), (7, "12 34 !!", "de", "b"), (None, "", None, "a"), (300, " ", None, None)]
    return rows


def stage(spark, function, rows):
    frame = spark.createDataFrame([(*row, "x", "y", "z") for row in rows], COLUMNS).repartition(3)
    result = function(spark, pipeline.written_table(frame), None)
    assert result.columns == frame.columns and result.schema.simpleString() == frame.schema.simpleString()
    return [tuple(r)[:4] for r in result.collect()]


def texts(rows):
    return Counter(folded(row[1]) for row in rows)


def test_language_decides_by_row(spark):
    rows = corpus()
    assert Counter(stage(spark, pipeline.identify_language, rows)) == Counter(lettered(rows))


def test_one_of_equal_texts_stays(spark):
    rows = corpus(2)
    found = stage(spark, pipeline.drop_exact_copies, rows)
    assert texts(found) == Counter(dict.fromkeys(texts(rows), 1))
    own = {row for row in distinct(rows) if row[0] is not None and sum(other[0] == row[0] for other in rows) == 1}
    assert own <= set(found)


def test_one_of_near_copies_stays(spark):
    rows = distinct(corpus(3))
    found = stage(spark, pipeline.drop_near_copies, rows)
    assert len(found) == len(unlike(rows)) < len(rows)
    # Rows without an own identifier may take each other's place, the others not.
    own = {row for row in unlike(rows) if row[0] is not None and sum(other[0] == row[0] for other in rows) == 1}
    assert own <= set(found)


def check_mix(before, after):
    taken, counts = defaultdict(int), Counter(after)
    for row in after:
        taken[row[3]] += len(WORD.findall(row[1] or ""))
    assert all(n <= 2 * before.count(row) for row, n in counts.items())
    largest = max(len(WORD.findall(row[1] or "")) for row in before)
    assert all(abs(taken[source] - target) <= largest for source, target in targets(before).items())


def test_mix_decides_by_row(spark):
    rows = corpus(4)
    check_mix(rows, stage(spark, pipeline.mix_sources, rows))


@pytest.fixture(scope="module")
def stages(spark):
    """The rows every stage was given and gave, over the whole table."""
    docs, seen = pipeline.read_documents(spark, SF_DIR), []
    for _, function in pipeline.STAGES[:-1]:
        seen.append([(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()])
        docs = pipeline.written_table(function(spark, docs, SF_DIR))
    seen.append([(r.doc_id, r.text, r.lang, r.source) for r in docs.collect()])
    return seen, [r.asDict() for r in pipeline.STAGES[-1][1](spark, docs, SF_DIR).collect()]


def test_all_stages_equal_a_restatement(stages):
    (documents, languages, exact, near, mixed), pieces = stages
    assert Counter(languages) == Counter(lettered(documents))
    assert Counter(exact) == Counter(distinct(languages))
    assert Counter(near) == Counter(unlike(exact)) and len(near) < len(exact) < len(documents)
    check_mix(near, mixed)
    model = sentencepiece.SentencePieceProcessor(model_file=pipeline.PIECE_MODEL)
    text_of = {row[0]: row[1] for row in mixed}
    assert Counter(r["doc_id"] for r in pieces) == Counter(row[0] for row in mixed)
    assert all(r["ids"] == model.encode(text_of[r["doc_id"]]) and r["round_trip"] for r in pieces)


def test_run_is_the_stages_in_a_row(spark, stages):
    assert Counter(r.doc_id for r in pipeline.run(spark, SF_DIR).collect()) == Counter(r["doc_id"] for r in stages[1])
