"""The manifest against trees built by plain loops."""

import hashlib
import random
import zlib

from sparkweave.llm import merkle as M


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(row):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in row))


def tree(leaves):
    """Root and, for each leaf, its siblings (before, after) from below."""
    proofs, at, nodes = [[] for _ in leaves], list(range(len(leaves))), list(leaves)
    while len(nodes) > 1:
        for i, k in enumerate(at):
            run = nodes[k // 16 * 16 : k // 16 * 16 + 16]
            proofs[i].append(("".join(run[: k % 16]), "".join(run[k % 16 + 1 :])))
        at = [k // 16 for k in at]
        nodes = [h(*nodes[i : i + 16]) for i in range(0, len(nodes), 16)]
    return nodes[0], proofs


def brute(rows):
    sources = sorted({r[1] for r in rows}, key=lambda s: (s is not None, (s or "").encode()))
    by = {s: sorted(((r[0] is not None, r[0] or 0, leaf(r)), r) for r in rows if r[1] == s) for s in sources}
    below = {s: tree([k[2] for k, _ in found]) for s, found in by.items()}
    root, above = tree([below[s][0] for s in sources])
    out = []
    for s, outer in zip(sources, above):
        for (key, r), inner in zip(by[s], below[s][1]):
            steps = inner + outer
            acc = key[2]
            if r[0] is not None and zlib.crc32(str(r[0]).encode()) % 5 == 0 and r[4]:
                acc = leaf((*r[:4], "".join(c.lower() if "A" <= c <= "Z" else c for c in r[4])))
            for before, after in steps:
                acc = h(before, acc, after)
            out.append((r[0], key[2], below[s][0], root, h(*(b + a for b, a in steps)), acc, acc == root))
    return out


def test_against_plain_loops(spark, tmp_path):
    """Three levels, runs of one node, null and empty fields, repeated rows, equal ids, many sources, columns that clash."""
    rng = random.Random(1)
    row = lambda i, s: (i, s, rng.choice(["en", None]), rng.choice([None, i]), rng.choice(["", None, "Ünï Text", "lower", f"Some {i} TEXT"]))
    rows = [row(i, "hot") for i in range(530)] + [row(1000 + i, "run") for i in range(17)] + [row(2000 + i, f"s{i:03}") for i in range(300)]
    rows += [row(3000 + i, None) for i in range(5)] + [row(4000, "é"), row(None, "hot"), row(None, None), (5, "", "en", 1, "X" * 200_000)]
    rows += [rows[0], rows[0], (rows[3][0], "hot", "xx", 1, "another text of this id")]
    rng.shuffle(rows)
    docs = spark.createDataFrame([(*r, 1, "x", "y") for r in rows], "doc_id long, source string, lang string, n_chars long, text string, rank int, leaf string, grp string")
    docs.repartition(5).write.parquet(f"{tmp_path}/documents.parquet")
    got = [tuple(r) for r in M.op13_merkle_manifest(spark, str(tmp_path)).collect()]
    assert sorted(got, key=repr) == sorted(brute(rows), key=repr)
    assert 0 < sum(not r[-1] for r in got) < len(rows) / 2


def test_one_row_and_none(spark, tmp_path):
    for name, rows in (("one", [(5, None, None, None, None)]), ("none", [])):
        spark.createDataFrame(rows, "doc_id long, source string, lang string, n_chars long, text string").write.parquet(f"{tmp_path}/{name}/documents.parquet")
        assert [tuple(r) for r in M.op13_merkle_manifest(spark, f"{tmp_path}/{name}").collect()] == (brute(rows) if rows else [])
