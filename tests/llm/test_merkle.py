import hashlib
import zlib

import pytest

from paperloom.llm import merkle

SF = "/root/testdata/sf0.001"
TYPES = "doc_id long, text string, lang string, source string, n_chars long"


def H(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def levels(nodes, fanout):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([H(*out[-1][i : i + fanout]) for i in range(0, len(out[-1]), fanout)])
    return out


def path(of, i, fanout):
    out = []
    for level in of[:-1]:
        out.append((i % fanout, level[i // fanout * fanout : i // fanout * fanout + fanout]))
        i //= fanout
    return out


def plain(rows, fanout=3):
    """doc_id, leaf, subroot, root, proof_sha256, folded_root, verified of each row, from whole lists."""
    field = lambda v: "-" if v is None else f"{len(str(v).encode())}:{v}"
    groups = {}
    for d, text, lang, source, n in rows:
        cut = text if text is None or d is None or zlib.crc32(str(d).encode()) % 2 else text.replace("\n", "")
        groups.setdefault(source, []).append((d is not None, d or 0, *[H(*map(field, (d, source, lang, n, t))) for t in (text, cut)]))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s])], fanout) for s in order}
    top = levels([trees[s][-1][0] for s in order], fanout)
    out = []
    for k, s in enumerate(order):
        for i, (there, d, leaf, node) in enumerate(sorted(groups[s])):
            steps = path(trees[s], i, fanout) + path(top, k, fanout)
            proof = "".join(x for at, run in steps for j, x in enumerate(run) if j != at)
            for at, run in steps:
                node = H(*[node if j == at else x for j, x in enumerate(run)])
            out.append((d if there else None, leaf, trees[s][-1][0], top[-1][0], H(proof), node, node == top[-1][0]))
    return sorted(out, key=lambda r: (r[0] is not None, *map(str, r)))


def got(spark, rows, fanout=3):
    found = merkle.merkle_manifest(spark.createDataFrame(rows, TYPES), fanout).select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()
    return sorted(map(tuple, found), key=lambda r: (r[0] is not None, *map(str, r)))


def test_query_equals_whole_lists(spark):
    rows = [tuple(r) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang", "source", "n_chars").collect()]
    found = sorted((tuple(r[c] for c in ("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified")) for r in merkle.QUERIES["op13_merkle_manifest"](spark, SF).collect()), key=lambda r: (r[0] is not None, *map(str, r)))
    assert found == plain(rows) and 0 < sum(r[-1] for r in found) < len(found)


@pytest.mark.parametrize("bits", [1, 2, 14])
def test_edges_of_small_blocks_meet(spark, monkeypatch, bits):
    """Blocks of two and of four leaves, few neighbours: peaks of every level cross blocks in several rounds."""
    monkeypatch.setattr(merkle, "BLOCK_BITS", bits)
    monkeypatch.setattr(merkle, "NEIGHBOURS", 2)
    rows = [(i, f"text\n{i}", "en", None if i % 10 == 0 else "hot" if i % 3 else f"s{i % 7}", i) for i in range(101)]
    rows += [(None, "no id", None, "hot", None), (5, "text\n5", "en", "hot", 5), (5, "text\n5", "en", "hot", 5), (5, None, "en", "hot", 5), (200, "", "x", "é", 0), (201, "", "x", "~", 0)]
    assert got(spark, rows) == plain(rows)


@pytest.mark.parametrize("n", [1, 2, 3, 4, 9, 10, 28])
def test_short_runs_are_not_padded(spark, n):
    rows = [(i, f"a\nb{i}", "en", "s", 3) for i in range(n)]
    assert got(spark, rows) == plain(rows)


def test_fanout_of_two(spark):
    rows = [(i, "t", "en", f"s{i % 3}", i) for i in range(23)]
    assert got(spark, rows, 2) == plain(rows, 2)


def test_any_change_is_seen(spark):
    rows = [(i, f"line\nline {i}", "en", "s", 3) for i in range(12)]
    root = got(spark, rows)[0][3]
    for k, value in ((0, 99), (1, "line\nline x"), (2, "de"), (3, "r"), (4, None)):
        other = [tuple(value if j == k and i == 7 else v for j, v in enumerate(r)) for i, r in enumerate(rows)]
        assert got(spark, other)[0][3] != root
