"""Repeated passages against a plain version, on small windows and with every bound made small."""

import random
from collections import Counter

import numpy as np
import pytest

from flowguard.llm import repeats

SCHEMA = "doc_id long, text string, key string, spans int, words string"


def brute(rows, width):
    split = [(i, (t or "").encode().split()) for i, t in rows]
    counts = Counter(tuple(w[j : j + width]) for _, w in split for j in range(len(w) - width + 1))
    out = []
    for i, words in split:
        gone = {k for j in range(len(words) - width + 1) if counts[tuple(words[j : j + width])] > 1 for k in range(j, j + width)}
        kept = b" ".join(w for k, w in enumerate(words) if k not in gone).decode()
        out.append((i, len(words), len(gone), kept))
    return sorted(out, key=str)


def got(spark, rows, width, parts=3):
    frame = spark.createDataFrame([(i, t, "k", 1, "w") for i, t in rows], SCHEMA).repartition(parts)
    found = repeats.remove_repeats(frame, width).collect()
    return sorted([(r.doc_id, r.n_words, sum(s.end - s.start for s in r.spans), r.kept_text) for r in found], key=str)


def texts(seed, few=False):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(8 if few else 400)] + ["É", "W1"]
    passages = [rng.choices(words, k=rng.randint(3, 30)) for _ in range(6)]
    rows = []
    for i in range(90):
        parts = []
        for _ in range(rng.randint(0, 4)):
            if rng.random() < 0.5:
                passage = rng.choice(passages)
                cut = rng.randint(0, len(passage) - 1)
                parts += passage[cut:] if rng.random() < 0.5 else passage
            else:
                parts += rng.choices(words, k=rng.randint(1, 25))
        rows.append((i, rng.choice([" ", "\n", " \t "]).join(parts)))
    rows += [(100, None), (101, ""), (102, " \x0b\x0c "), (None, rows[3][1]), (3, rows[3][1]), (103, "a " * 200), (104, "a b " * 150), (105, "no\x1cbreak\x85here " * 9)]
    return rows + [(110, " ".join(rng.choices(words, k=20000)))]


@pytest.mark.parametrize("width,few", [(5, False), (8, False), (3, True), (35, False)])
def test_words_left_match_a_plain_version(spark, width, few):
    rows = texts(width, few)
    assert got(spark, rows, width) == brute(rows, width)


def test_split_groups_and_parts_change_nothing(spark, monkeypatch):
    for name, value in {"HOT": 2, "SHARD_WORDS": 40, "CHUNK_BYTES": 300, "OPEN_BYTES": 900}.items():
        monkeypatch.setattr(repeats, name, value)
    rows = texts(3)
    assert got(spark, rows, 8) == brute(rows, 8)
    same = [(i, "one common start of all " + " ".join(f"x{i // 7}y{j}" for j in range(12))) for i in range(140)]
    assert got(spark, same, 6) == brute(same, 6)


def test_sentences_said_again_and_again(spark):
    """Texts of one repeated sentence, parts of which open other texts: groups in one task keep passages of their own."""
    rng = random.Random(5)
    rows = []
    for i in range(0, 160, 2):
        sentence = [f"s{i}w{j}" for j in range(rng.randint(5, 11))]
        rows.append((i + 1, " ".join([*(f"x{i}y{j}" for j in range(4)), *sentence[: rng.randint(3, 5)], "end"])))
        rows.append((i, " ".join((sentence * 6)[rng.randint(0, 4) : -rng.randint(1, 4)])))
    rng.shuffle(rows)
    assert got(spark, rows, 9) == brute(rows, 9)
    assert got(spark, rows, 12) == brute(rows, 12)


def test_groups_taken_together_keep_their_own_passages():
    words = [b"w%d" % i for i in range(7)] * 5
    rows = [((1, 0, 0), 50, 0, words[:-3]), ((2, 0, 0), 50, 3, words[3:])]
    found = repeats._passages_of(rows, set(), repeats.WordHashes(), 9)
    for owner, stretch in ((1, words[:-3]), (2, words[3:])):
        shard = repeats.Shard([p[4] for p in found if p[0] == owner], 9)
        assert shard.covered([stretch]) == [[(0, len(stretch))]]


def test_no_rows_and_nothing_repeated(spark):
    assert got(spark, [], 5) == []
    rows = [(1, "a b c d e f"), (2, "b c d x e f")]
    assert got(spark, rows, 5) == brute(rows, 5) == [(1, 6, 0, "a b c d e f"), (2, 6, 0, "b c d x e f")]


def test_hashes_of_sequences_follow_their_content():
    rng = np.random.default_rng(0)
    values = rng.integers(0, 3, 400).astype(np.uint64)
    for width in (1, 2, 3, 11, 12, 35):
        hashes = repeats.sequence_hash(values, width)
        assert len(hashes) == 400 - width + 1
        assert len(set(hashes.tolist())) == len({tuple(values[i : i + width]) for i in range(len(hashes))})


def test_equal_windows_name_equal_anchors():
    rng = np.random.default_rng(1)
    passage, lengths = rng.integers(0, 2**60, 60).astype(np.uint64), np.array([90, 90, 7])
    one, two = rng.integers(0, 2**60, 90).astype(np.uint64), rng.integers(0, 2**60, 90).astype(np.uint64)
    one[10:70], two[25:85] = passage, passage
    anchors, first, last = repeats.anchor_runs(np.concatenate([one, two, one[:7]]), lengths, 12)
    of = {int(s): int(a) for a, f, e in zip(anchors, first, last) for s in range(f, e + 1)}
    assert sorted(of) == [*range(79), *range(90, 169)]
    assert all(of[10 + i] == of[90 + 25 + i] for i in range(49))
