"""The Merkle manifest against a tree built and walked by a plain loop."""

import hashlib
import zlib
from collections import defaultdict

import pytest

from typeahead.llm import merkle_octopus


def h(text):
    return hashlib.sha256(text.encode()).hexdigest()


def field(v):
    return "-" if v is None else f"{len(str(v).encode())}:{v}"


def levels(row):
    out = [row]
    while len(row) > 1:
        row = [h("".join(row[i:i + 3])) for i in range(0, len(row), 3)]
        out.append(row)
    return out


def brute(rows):
    """Sorted (id, leaf, subroot, root, proof, folded root) of each row."""
    groups = defaultdict(list)
    for r in rows:
        bad = r[4]
        if zlib.crc32(str("" if r[0] is None else r[0]).encode()) % 2 == 0 and bad is not None:
            bad = bad.replace("\n", "")
        groups[r[1]].append(((r[0] is not None, r[0] or 0), h("".join(map(field, r))), h("".join(map(field, r[:4] + (bad,)))), r[0]))
    names = sorted(groups, key=lambda g: (g is not None, (g or "").encode()))
    trees = {g: levels([x[1] for x in sorted(groups[g])]) for g in names}
    top = levels([trees[g][-1][0] for g in names])
    found = []
    for s, g in enumerate(names):
        for p, (_, leaf, bad, key) in enumerate(sorted(groups[g])):
            proof, node = "", bad
            for tree, at in ((trees[g], p), (top, s)):
                for row in tree[:-1]:
                    lo = at - at % 3
                    run = row[lo:lo + 3]
                    run[at - lo] = ""
                    proof += "".join(run)
                    run[at - lo] = node
                    node, at = h("".join(run)), at // 3
            found.append((str(key), leaf, trees[g][-1][0], top[-1][0], h(proof), node, node == top[-1][0]))
    return sorted(found)


def run(docs):
    got = merkle_octopus.multiproofs(merkle_octopus.build_manifest(docs, changed=merkle_octopus.without_newlines(docs)))
    return sorted((str(r.doc_id), *r[1:]) for r in got.collect())


COLUMNS = "doc_id long, source string, lang string, n_chars long, text string"


def table_of(spark, rows):
    # columns that clash with names used inside
    return spark.createDataFrame([r + (1, "x", 3) for r in rows],
                                 COLUMNS + ", part int, leaf string, idx int").repartition(3)


@pytest.fixture
def small_parts(monkeypatch):
    monkeypatch.setattr(merkle_octopus, "PART_LEAVES", 9)
    monkeypatch.setattr(merkle_octopus, "STEP", 1)


def test_merkle_proofs(spark, small_parts):
    rows = [(i, ["hot", None, "", "ä", "b", f"s{i}"][0 if i % 3 else i % 6], "en" if i % 2 else None,
             None if i % 5 == 0 else i, [None, "", "a\nb\n", "é" * i, "line\n" * 2000][i % 5]) for i in range(60)]
    rows += [rows[4], rows[4], (None, "hot", None, None, "x\ny"), (None, None, None, None, None), (4, "hot", "en", 1, "other")]
    assert run(table_of(spark, rows)) == brute(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 10])
def test_merkle_sizes(spark, small_parts, n):
    rows = [(i, "one", "en", i, "t\n") for i in range(n)]
    assert run(table_of(spark, rows)) == brute(rows)


def test_merkle_lone_sources(spark, small_parts):
    rows = [(i, f"s{i}", "en", i, "t\n") for i in range(14)]
    assert run(table_of(spark, rows)) == brute(rows)


def test_merkle_empty(spark):
    got = merkle_octopus.multiproofs(merkle_octopus.build_manifest(spark.createDataFrame([], COLUMNS)))
    assert got.columns[0] == "doc_id" and got.count() == 0


def test_missing_nodes_are_minimal():
    for width in (1, 2, 3, 10, 28, 82):
        for lo in range(0, width, 5):
            for hi in range(lo, width, 7):
                known, want, level, n = set(range(lo, hi + 1)), set(), 0, width
                while n > 1:
                    up = {i // 3 for i in known}
                    want |= {(level, j) for p in up for j in range(3 * p, min(3 * p + 3, n))} - {(level, i) for i in known}
                    known, n, level = up, -(-n // 3), level + 1
                assert set(merkle_octopus.octopus(lo, hi, width, 3)) == want
