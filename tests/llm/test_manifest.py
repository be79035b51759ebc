import hashlib
import zlib
from collections import defaultdict

import pytest
from pyspark.sql import functions as F

from keepsake.llm import manifest


def h(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def leaf(values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def climb(leaves):
    """Root of a list, and for each leaf its siblings (left, right) of every level."""
    paths, nodes, under = [[] for _ in leaves], list(leaves), [[i] for i in range(len(leaves))]
    while len(nodes) > 1:
        runs = [(nodes[i:i + 3], under[i:i + 3]) for i in range(0, len(nodes), 3)]
        for run, members in runs:
            for place, rows in enumerate(members):
                for i in rows:
                    paths[i].append(("".join(run[:place]), "".join(run[place + 1:])))
        nodes, under = [h(*run) for run, _ in runs], [sum(m, []) for _, m in runs]
    return nodes[0], paths


def brute(rows):
    groups, out = defaultdict(list), []
    for r in rows:
        text = r["text"]
        if text is not None and zlib.crc32(b"" if r["doc_id"] is None else str(r["doc_id"]).encode()) % 2 == 0:
            text = text.replace("\n", "")
        values = [r[f] for f in manifest.FIELDS]
        groups[r["source"]].append((r["doc_id"] is not None, r["doc_id"] or 0, leaf(values), leaf(values[:-1] + [text]), r["doc_id"]))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = [climb([x[2] for x in sorted(groups[s])]) for s in order]
    root, tops = climb([t[0] for t in trees])
    for source, (subroot, paths), top in zip(order, trees, tops):
        for (_, _, own, other, doc_id), path in zip(sorted(groups[source]), paths):
            folded = other
            for left, right in path + top:
                folded = h(left, folded, right)
            out.append((doc_id, own, subroot, root, h(*(a + b for a, b in path + top)), folded, folded == root))
    return sorted(out, key=repr)


def got(df):
    return sorted((tuple(r) for r in manifest.verified(df).collect()), key=repr)


def test_odd_rows(odd):
    assert got(odd) == brute(odd.collect())
    assert got(odd.limit(0)) == []


def test_documents_and_one_group(docs):
    assert got(docs) == brute(docs.collect())
    assert got(docs.withColumn("source", F.lit("one"))) == brute(docs.withColumn("source", F.lit("one")).collect())
    assert got(docs.limit(1)) == brute(docs.limit(1).collect())


@pytest.mark.parametrize("levels", [1, 2])
def test_tiers_and_hot_groups(spark, docs, levels, monkeypatch):
    """Blocks of few slots need several tiers; one group and one repeated row have a third of the rows."""
    monkeypatch.setattr(manifest, "LEVELS", levels)
    hot = docs.withColumn("source", F.when(F.col("doc_id") % 3 == 0, "hot").otherwise(F.concat("source", (F.col("doc_id") % 40).cast("string"))))
    same = hot.limit(1).crossJoin(spark.range(60).select("id")).drop("id")
    both = hot.unionByName(same)
    assert got(both) == brute(both.collect())


def test_proof_and_fold(docs):
    rows = manifest.manifest(docs, fields=("doc_id", "text"), group_col="lang").select(
        "leaf", "root", manifest.fold(F.col("leaf"), F.col("path")).alias("folded"), manifest.fold(F.lit("other"), F.col("path")).alias("wrong")).collect()
    assert all(r["folded"] == r["root"] != r["wrong"] for r in rows) and len({r["root"] for r in rows}) == 1
