"""The manifest against a plain tree of hashes, proof by proof."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from tablewright.llm import plans
from tablewright.llm.merkle_manifest import folded, hex_text, merkle_manifest, proof_text
from tests.llm.data import SCHEMA, documents, odd_rows, table
from tests.oracle import compare


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def climb(digests, fan):
    """The last digest, and per leaf its siblings (left, right) by level."""
    beside, nodes = [[] for _ in digests], [(d, [i]) for i, d in enumerate(digests)]
    while len(nodes) > 1:
        runs = [nodes[i : i + fan] for i in range(0, len(nodes), fan)]
        for run in runs:
            for j, (_, leaves) in enumerate(run):
                for leaf in leaves:
                    beside[leaf].append(("".join(x[0] for x in run[:j]), "".join(x[0] for x in run[j + 1 :])))
        nodes = [(h(*[x[0] for x in run]), [i for x in run for i in x[1]]) for run in runs]
    return nodes[0][0], beside


def plain_manifest(rows, fan=8):
    trees = {}
    for doc_id, text, lang, source, n_chars in rows:
        found = text
        if doc_id is not None and text is not None and zlib.crc32(str(doc_id).encode()) % 3 == 0:
            found = "".join(c.lower() if "A" <= c <= "Z" else c for c in text)
        leaf, other = (h(*map(field, (doc_id, source, lang, n_chars, t))) for t in (text, found))
        trees.setdefault(lang, []).append((doc_id is not None, doc_id or 0, leaf, other))
    keys = sorted(trees, key=lambda k: (k is not None, (k or "").encode()))
    ends = [climb([x[2] for x in sorted(trees[k])], fan) for k in keys]
    root, over = climb([e[0] for e in ends], fan) if ends else ("", [])
    out = []
    for key, (subroot, beside), more in zip(keys, ends, over):
        for (known, doc_id, leaf, other), path in zip(sorted(trees[key]), beside):
            path = path + more
            for left, right in path:
                other = h(left, other, right)
            proof = h(*[left + right for left, right in path])
            out.append((doc_id if known else None, leaf, subroot, root, proof, other, other == root))
    return out


def by_row(rows):
    return sorted(rows, key=repr)


def many_trees():
    """A tree of most rows, trees of one row, a null tree, more trees than one group, and upper case."""
    rows = [(i, f"Text {i % 7} Ä", "big", "s", i) for i in range(150)]
    rows += [(1000 + i, f"T{i}", f"l{i:02d}", None, None) for i in range(70)]
    return rows + [(2000 + i, None, None, "s", 1) for i in range(9)] + [(3000, "x", "", "s", 1), (3001, "x", "Ü", "s", 1)]


CASES = {
    "documents": documents(3, 50),
    "odd": odd_rows(),
    "trees": many_trees(),
    "copies": [(5, "Same TEXT", "en", "a", 9)] * 600,
    "one": [(3, "Only", "en", "a", 4)],
    "one level exactly": [(i, "A", "en", "a", 1) for i in range(64)],
    "empty": [],
}


@pytest.mark.parametrize("name", CASES)
def test_manifest_equals_plain_tree(spark, tmp_path, name):
    rows = CASES[name]
    table(spark, rows).write.parquet(str(tmp_path / "documents.parquet"))
    got = plans.op12_merkle_manifest(spark, str(tmp_path))
    assert got.columns == ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]
    assert by_row(map(tuple, got.collect())) == by_row(plain_manifest(rows))


def test_sql_says_the_same(spark, tmp_path):
    rows = documents(4, 80) + many_trees()
    spark.createDataFrame(rows, SCHEMA).toPandas().astype({"n_chars": "Int64"}).to_parquet(str(tmp_path / "documents.parquet"))
    con = duckdb.connect()
    con.execute(f"CREATE VIEW documents AS SELECT * FROM read_parquet('{tmp_path}/documents.parquet')")
    assert compare(plans.op12_merkle_manifest(spark, str(tmp_path)), con, plans.ORACLES["op12_merkle_manifest"]) is None


def test_other_fan_fields_and_names(spark):
    """Columns that clash with the operator's own, differ by case or hold dots do no harm."""
    rows = [(i, f"v{i}", i % 2, "x") for i in range(30)]
    df = spark.createDataFrame(rows, "`a.b` long, lo string, tree int, LEAF string")
    got = merkle_manifest(df, fields=("a.b", "lo"), tree="tree", order="a.b", fan=3)
    out = got.select(
        F.col("`a.b`").alias("id"), hex_text(F.col("leaf")).alias("leaf"), hex_text(F.col("root")).alias("root"),
        F.sha2(proof_text(F.col("proof")), 256).alias("proof"), folded(F.col("leaf"), F.col("proof")).alias("folded"),
    ).collect()
    subs, want = [], {}
    for t in (0, 1):
        ids = [i for i in range(30) if i % 2 == t]
        sub, beside = climb([h(field(i), field(f"v{i}")) for i in ids], 3)
        subs.append(sub)
        want |= {i: (t, b) for i, b in zip(ids, beside)}
    root, over = climb(subs, 3)
    assert len(out) == 30
    for r in out:
        t, path = want[r.id]
        assert r.leaf == h(field(r.id), field(f"v{r.id}")) and r.root == root == r.folded
        assert r.proof == h(*[a + b for a, b in path + over[t]])
