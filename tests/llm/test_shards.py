import numpy as np
import pytest

from keepsake.llm import shards
from keepsake.llm.common import Workspace


@pytest.mark.parametrize("n", [1, 2, 3, 4, 5, 16, 17, 1000, 4097])
def test_permutation(n):
    slots = shards.permute(np.arange(n), n)
    assert sorted(slots.tolist()) == list(range(n))
    assert (shards.permute(slots, n, inverse=True) == np.arange(n)).all()
    if n > 100:
        assert (shards.permute(np.arange(n), n, "other") != slots).any() and abs(np.corrcoef(slots, np.arange(n))[0, 1]) < 0.2


def test_round_trip(spark, docs):
    space = Workspace(spark, "test-shards")
    shards.write(docs, space.path("out"), length=32, shard_bytes=40_000)
    size = shards.stride(32)
    files = sorted((r.path, bytes(r.content)) for r in spark.read.format("binaryFile").option("recursiveFileLookup", "true")
                   .option("pathGlobFilter", "part-*").load(space.path("out")).collect())
    assert len(files) > 3 and all(len(c) % size == 0 for _, c in files)
    coder, texts, tickets = shards.tokenizer(shards.VOCABULARY), {}, []
    for _, content in sorted(files, key=lambda f: int(f[0].split("shard=")[1].split("/")[0])):
        for at in range(0, len(content), size):
            r = content[at:at + size]
            assert r[-1:] == b"\n"
            tickets.append(int.from_bytes(r[:8], "big"))
            used = int.from_bytes(r[20:24], "big")
            texts.setdefault(int.from_bytes(r[8:16], "big", signed=True), {})[int.from_bytes(r[16:20], "big")] = np.frombuffer(r[24:24 + 2 * used], ">u2").tolist()
    assert tickets == sorted(set(tickets))
    want = {r.doc_id: r.text for r in docs.collect() if r.text}
    assert {k: coder.decode([i for n in sorted(v) for i in v[n]]) for k, v in texts.items()} == want
    rows = shards.read(spark, space.path("out"), 32).collect()
    assert sorted(r.slot for r in rows) == list(range(len(rows))) and len(rows) == len(tickets)


def test_odd_rows(odd):
    rows = shards.materialise(odd).collect()
    assert {r.doc_id for r in rows} == {1, None, 4, 5, 6, 7, 8, 9, 10, 1 << 60}
    assert sum(r.doc_id == 10 for r in rows) == 2
    assert shards.materialise(odd.limit(0)).count() == 0
