"""One-permutation MinHash and the components it leads to, against brute force."""

from __future__ import annotations

import itertools
import random
import re
from collections import Counter

import numpy as np
import pytest

from skyfold.llm import minhash_dedup as mh
from skyfold.llm.hashing import mixed, shingle_set, word_hashes

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def sets_of(text, words):
    found = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    return {tuple(found[i : i + words]) for i in range(max(1, len(found) - words + 1))} if found else set()


def brute_force(rows, words=4, percent=80):
    """Rows of (identifier, text); counter of (identifier, size, component, kept)."""
    sets = [sets_of(text, words) for _, text in rows]
    component = list(range(len(rows)))

    def root(i):
        while component[i] != i:
            i = component[i]
        return i

    for i, j in itertools.combinations(range(len(rows)), 2):
        shared = len(sets[i] & sets[j])
        if shared and 100 * shared >= percent * len(sets[i] | sets[j]):
            component[root(i)] = root(j)
    names = {}
    for i, (doc_id, _) in enumerate(rows):
        names.setdefault(root(i), []).append(doc_id)
    smallest = {r: min((x for x in ids if x is not None), default=None) for r, ids in names.items()}
    out = []
    for i, (doc_id, _) in enumerate(rows):
        name = smallest[root(i)] if sets[i] else doc_id
        out.append((doc_id, len(sets[i]), name, doc_id == name))
    return Counter(out)


def found(spark, rows, parts=4):
    docs = spark.createDataFrame([(*row, *["x"] * 5) for row in rows], "doc_id LONG, text STRING, key STRING, n STRING, a STRING, component STRING, bucket STRING")
    return Counter(tuple(r) for r in mh.near_duplicates(docs.repartition(parts), 4, 80).collect())


def edited(rng, words, share):
    return [rng.choice("abcdefgh") + str(rng.randrange(10**6)) if rng.random() < share else w for w in words]


def corpus(seed, n=120):
    """Chains of edits (each like the one before, not like the first), copies, texts around one long passage."""
    rng = random.Random(seed)
    prose = [f"w{i}" for i in range(3000)]
    rows = []
    for _ in range(n // 12):
        words = rng.choices(prose, k=rng.choice([6, 40, 150, 400]))
        for _ in range(6):
            rows.append(" ".join(words))
            words = edited(rng, words, 0.03)
        rows.append(rows[-1].upper())
    passage = rng.choices(prose, k=120)
    for _ in range(n // 4):
        rows.append(" ".join(rng.choices(prose, k=rng.choice([5, 20, 60])) + passage))
    rows += [" ".join(rng.choices(prose, k=rng.randint(1, 30))) for _ in range(n // 4)]
    rng.shuffle(rows)
    return list(enumerate(rows, 1))


@pytest.mark.parametrize("sizes", [(256, 1024), (2, 3)])
def test_components_equal_brute_force(spark, monkeypatch, sizes):
    monkeypatch.setattr(mh, "GROUP_SETS", sizes[0])
    monkeypatch.setattr(mh, "PART_SETS", sizes[1])
    rows = corpus(sizes[0])
    expected = brute_force(rows)
    assert len({row[2] for row in expected}) < len(rows) * 0.8
    assert found(spark, rows) == expected


def test_one_group_of_a_third_of_all_rows(spark):
    """A star's links alone do not connect a ring, in which each text is like its neighbours only."""
    words = [f"w{i}" for i in range(100)]
    ring = [" ".join([f"v{i}" for i in range(k)] + words[k:]) for k in range(0, 60, 2)]
    rows = [(k, text) for k, text in enumerate(ring * 2, 1)] + corpus(3, 60)
    rows = [(i, text) for i, (_, text) in enumerate(rows, 1)]
    assert found(spark, rows) == brute_force(rows)


def test_defined_cases(spark):
    text = "one two three four five six seven eight nine ten eleven twelve thirteen"
    rows = [(5, None), (6, ""), (7, " \t\n"), (8, "x"), (9, "X"), (None, "x"), (None, None), (None, "alone here")]
    rows += [(None, text + " a"), (3, text + " b"), (2, text.upper() + " A"), (2, text), (2, text), (4, "one two three")]
    rows += [(10, "long word " * 50_000 + text), (11, "LONG word " * 50_000 + text), (12, "z" * 1_000_000)]
    result = found(spark, rows)
    assert result == brute_force(rows)
    assert found(spark, []) == Counter() and found(spark, [(None, None)]) == Counter({(None, 0, None, True): 1})


def test_empty_bins_are_filled_alike():
    """Densified signatures agree as often as the sets do, also where most bins are empty."""
    rng = np.random.default_rng(5)
    edges, hops = mh.bin_edges(144), mh.Hops(144)
    agreeing = []
    for _ in range(200):
        union = np.unique(mixed(rng.integers(0, 2**62, 12).astype(np.uint64)))
        one, other = union[:-1], np.delete(union, 3)  # 10 of 12
        agreeing.append((mh.signature(one, edges, hops) == mh.signature(other, edges, hops)).mean())
    assert abs(np.mean(agreeing) - 10 / 12) < 0.03
    single = mh.signature(union[:1], edges, hops)
    assert (single == union[0]).all()


def test_recall_at_the_bound():
    """Pairs of similarity 0.8 to 0.82 share a bucket nearly always."""
    rng = np.random.default_rng(6)
    edges, hops = mh.bin_edges(mh.BANDS * mh.ROWS), mh.Hops(mh.BANDS * mh.ROWS)
    for size in (20, 100, 1000):
        met = 0
        for _ in range(400):
            union = np.unique(mixed(rng.integers(0, 2**62, size).astype(np.uint64)))
            out = rng.permutation(size)[: size // 5]
            one, other = np.delete(union, out[: len(out) // 2]), np.delete(union, out[len(out) // 2 :])
            buckets = [mh.band_buckets(mh.signature(s, edges, hops), mh.BANDS) for s in (one, other)]
            met += (buckets[0] == buckets[1]).any()
        assert met >= 394, (size, met)


def test_texts_are_hashed_in_blocks(monkeypatch):
    import skyfold.llm.hashing as hashing

    text = ("word " * 500 + "y" * 3000 + " tail").encode()
    whole = word_hashes(text), shingle_set(text, 4)
    monkeypatch.setattr(hashing, "BLOCK", 64)
    assert (word_hashes(text) == whole[0]).all() and (shingle_set(text, 4) == whole[1]).all()
    assert len(word_hashes(b"")) == 0 and len(word_hashes(b" " * 200)) == 0


def test_a_text_of_64_megabytes_takes_little_memory():
    import subprocess
    import sys

    code = (
        "import resource, skyfold.llm.hashing as h; text = b'some words ' * 6_000_000;"
        "before = resource.getrusage(resource.RUSAGE_SELF).ru_maxrss; h.word_hashes(text);"
        "print((resource.getrusage(resource.RUSAGE_SELF).ru_maxrss - before) // 1024)"
    )
    grown = subprocess.run([sys.executable, "-c", code], capture_output=True, text=True, check=True).stdout
    assert int(grown) < 400  # 12 million words of 8 bytes, twice
