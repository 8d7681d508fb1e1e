"""The Merkle manifest against a plain recursive version."""

import hashlib
import random
import zlib

from flowguard.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars int, text string, tree string, hash string, path string"


def sha(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf_of(row, lower=False):
    row = list(row)
    if lower and row[4] is not None:
        row[4] = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in row[4])
    return sha(*["-" if v is None else f"{len(str(v).encode())}:{v}" for v in row])


def climbed(level):
    """(paths per leaf, root): a path has (left, right) for each level."""
    paths, at = [[] for _ in level], list(range(len(level)))
    while len(level) > 1:
        for leaf, i in enumerate(at):
            run = level[i // 8 * 8 : i // 8 * 8 + 8]
            paths[leaf].append(("".join(run[: i % 8]), "".join(run[i % 8 + 1 :])))
            at[leaf] = i // 8
        level = [sha(*level[i : i + 8]) for i in range(0, len(level), 8)]
    return paths, level[0]


def brute(rows):
    trees = {}
    for row in rows:
        trees.setdefault(row[2], []).append((row[0] is not None, row[0] or 0, leaf_of(row), row))
    langs = sorted(trees, key=lambda v: (v is not None, (v or "").encode()))
    done = {lang: climbed([x[2] for x in sorted(trees[lang], key=lambda x: x[:3])]) for lang in langs}
    above, root = climbed([done[lang][1] for lang in langs])
    out = []
    for lang, top in zip(langs, above):
        for x, path in zip(sorted(trees[lang], key=lambda x: x[:3]), done[lang][0]):
            path = path + top
            tampered = x[0] and zlib.crc32(str(x[1]).encode()) % 3 == 0
            node = leaf_of(x[3], tampered)
            for left, right in path:
                node = sha(left, node, right)
            out.append((x[3][0], x[2], done[lang][1], root, sha(*[a + b for a, b in path]), node, node == root))
    return sorted(out, key=str)


def got(spark, rows, parts=5):
    frame = spark.createDataFrame([(*r, "t", "h", "p") for r in rows], SCHEMA).repartition(parts)
    return sorted(map(tuple, merkle.manifest(frame).collect()), key=str)


def test_proofs_match_a_recursive_version(spark):
    rng = random.Random(1)
    rows = [(i, "web", "en", 3, f"Text {i} É") for i in range(700)]
    rows += [(i, rng.choice(["a", None]), rng.choice(["de", "fr", None, ""]), rng.choice([1, None]), rng.choice(["AbC", "", None, "Ünï " * 5])) for i in range(700, 790)]
    rows += [(5, "web", "en", 3, "Text 5 É")] * 3 + [(None, None, None, None, None)] * 2 + [(None, "x", "en", 1, "UP"), (1, "x", "en", 1, "UP " * 40000), (9, "x", "only", 1, "Lone")]
    assert got(spark, rows) == brute(rows)


def test_shapes_at_the_edges_of_runs_and_blocks(spark):
    for count in (1, 7, 8, 9, 64, 65, 512, 513):
        rows = [(i, "s", "en", 1, "Same") for i in range(count)]
        assert got(spark, rows) == brute(rows)
    many = [(i, "s", f"l{i:03d}", 1, "Same") for i in range(75)]
    assert got(spark, many) == brute(many)


def test_three_tiers_and_no_rows(spark, monkeypatch):
    monkeypatch.setattr(merkle, "DIGITS", 1)
    monkeypatch.setattr(merkle, "BLOCK", 8)
    rows = [(i, "s", "en", 1, "Same") for i in range(600)]
    assert got(spark, rows) == brute(rows)
    assert got(spark, []) == []


def test_untampered_leaves_are_folded_too(spark, monkeypatch):
    """A path that is wrong somewhere shows in every leaf below it, tampered with or not."""
    rows = [(i, "s", "en", 1, "same") for i in range(70)] + [(i, "s", "de", 1, "same") for i in range(70, 80)]
    assert all(r[6] for r in got(spark, rows))
    step = merkle._step

    def wrong(level):
        return step(level) if level else merkle.F.transform(step(level), lambda s: s.withField("left", merkle.F.concat(merkle.F.lit("x"), s["left"])))

    monkeypatch.setattr(merkle, "_step", wrong)
    found = got(spark, rows)
    assert len(found) == 80 and not any(r[6] for r in found)
    assert {r[3] for r in found} == {r[3] for r in brute(rows)}
