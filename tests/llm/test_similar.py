import random
import re

import pytest

from keepsake.llm import similar


def brute(texts, percent=80):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m.group().lower(), t or ""))
        sets.append({tuple(w[i:i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else {tuple(w)} if w else set())
    parent = list(range(len(texts)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if both and 100 * both >= percent * (len(sets[i]) + len(sets[j]) - both):
                parent[max(top(i), top(j))] = min(top(i), top(j))
    return [(len(s), top(i)) for i, s in enumerate(sets)]


def made(seed):
    rng = random.Random(seed)
    word = lambda: rng.choice("abcdefghijklmnop") * rng.randrange(1, 9)
    common = [word() for _ in range(40)]
    texts = [None, "", "a", "a", "A b c", "a b c d e f"]
    for _ in range(12):
        base = [word() for _ in range(rng.randrange(5, 120))]
        if rng.random() < 0.5:
            base[3:3] = common
        for _ in range(rng.randrange(1, 14)):
            copy = list(base)
            for _ in range(rng.randrange(0, 5)):
                copy[rng.randrange(len(copy))] = word()
            texts.append(" ".join(copy))
            base = copy if rng.random() < 0.4 else base
    return texts


@pytest.mark.parametrize("seed,few", [(1, 64), (2, 64), (3, 0)])
def test_components_against_brute_force(spark, monkeypatch, seed, few):
    monkeypatch.setattr(similar, "FEW", few)  # 0: every document lengthens its prefix as far as it may
    texts = made(seed)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar.groups(docs).collect()}
    assert got == dict(enumerate(brute(texts)))
    assert sorted(r.doc_id for r in similar.deduplicate(docs).collect()) == sorted(
        {c for n, c in got.values() if n} | {k for k, (n, _) in got.items() if not n})


def test_match_counts_hold():
    rng = random.Random(7)
    for _ in range(300):
        pool = [rng.randrange(400) for _ in range(rng.randrange(5, 90))]
        a, b = set(pool), {x for x in pool if rng.random() < 0.93} | {rng.randrange(400) for _ in range(rng.randrange(3))}
        shared = len(a & b)
        if 100 * shared >= 80 * (len(a) + len(b) - shared):
            for l in (1, 2, 4):
                cut = lambda s: set(sorted(s)[:len(s) - similar.least_overlap(len(s)) + l])
                assert len(cut(a) & cut(b)) >= min(l, shared)


def test_chain_of_links(spark):
    from keepsake.llm.common import Workspace, components, session
    links = spark.range(400).selectExpr("id AS a", "id + 1 AS b")
    got = components(links, Workspace(session(spark), "test-chain"), "chain")
    assert got.filter("component <> 0").count() == 0 and got.count() == 401


def test_odd_rows(odd):
    rows = similar.groups(odd).collect()
    assert len(rows) == odd.count()
    by = [(r.doc_id, r.component_id) for r in rows]
    assert (8, 7) in by and (9, 7) in by and (1 << 60, 1) in by and (None, None) in by and by.count((10, 10)) == 2
    left = similar.deduplicate(odd)
    assert left.columns == odd.columns
    ids = [r.doc_id for r in left.collect()]
    assert 8 not in ids and 9 not in ids and ids.count(10) == 2 and ids.count(None) == 2
    assert similar.groups(odd.limit(0)).count() == 0 and similar.deduplicate(odd.limit(0)).count() == 0


def test_columns_with_own_names_keep_their_values(spark):
    from keepsake.llm import languages, mixing
    names = ["key", "_key", "_text", "_source", "score", "size", "row", "lang_pred", "target", "taken", "id", "_language"]
    texts = ["the cat sat on the mat and ran"] * 2 + ["le chat est sur la table verte", "a quite different text with other words"]
    rows = [(i, t, "en", "ab"[i % 2], *[f"{n}{i}" for n in names]) for i, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, ["doc_id", "text", "lang", "source", *names])
    by_id = {r[0]: r for r in rows}
    for out in (similar.deduplicate(docs), languages.keep_known(docs), mixing.mixed_rows(docs)):
        got = [tuple(r) for r in out.collect()]
        assert out.columns == docs.columns and got and all(r == by_id[r[0]] for r in got)
    mixed = mixing.mix(docs)
    assert all(r["key"] == f"key{r.doc_id}" and r["_source"] == f"_source{r.doc_id}" for r in mixed.collect())


def test_pairs_below_the_bound_are_not_verified(spark):
    """Texts that share half of their words meet in their prefixes, but are left out before sets are read."""
    from keepsake.llm.common import Workspace, session
    rng = random.Random(5)
    common = [f"c{rng.randrange(10 ** 6)}" for _ in range(100)]
    texts = [" ".join([f"u{i}x{j}" for j in range(50)] + common + [f"v{i}x{j}" for j in range(50)]) for i in range(60)]
    docs = session(spark).createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    space = Workspace(spark, "test-bound")
    own = similar.with_sets(docs, "doc_id", "text")
    _, table = similar.read_documents(own, space)
    nodes = similar.nodes_of(own, table, space, 80)
    postings = nodes.select("key", "n", similar.F.posexplode("tokens").alias("place", "token"))
    rest = similar.candidates_of(similar.with_component(postings, None, 0), space, 80)
    assert rest.count() == 0
    assert similar.groups(docs).filter("component_id <> doc_id").count() == 0


def test_sets_hashed_by_blocks_are_those_of_single_texts(monkeypatch):
    rng = random.Random(7)
    texts = [None, "", " \n", "a", "A b", "a b c d", "a b c d e", "a b c d e a b c d e a b", "é \x85  x", "word " * 300]
    texts += ["".join(rng.choice("ab \n\t\x0b\x1fé") for _ in range(rng.randrange(60))) for _ in range(500)]
    want = [similar.shingles(t) for t in texts]
    for block in (1, 100, 1 << 18):
        monkeypatch.setattr(similar, "BLOCK", block)
        got = similar.shingle_sets(texts)
        assert len(got) == len(want) and all((x == y).all() and len(x) == len(y) for x, y in zip(got, want))
    assert similar.set_keys(want) == [similar.set_key(found) for found in want]
    assert similar.shingle_sets([]) == [] and similar.set_keys([]) == []


def test_links_found_in_rounds_give_the_components_of_all(spark):
    from keepsake.llm.common import Workspace, components, session
    rng, space = random.Random(9), Workspace(session(spark), "test-merged")
    rounds = [[(rng.randrange(60), rng.randrange(60, 120)) for _ in range(20)], [(1, 1)], [],
              [(rng.randrange(120), rng.randrange(120)) for _ in range(15)]]
    make = lambda links: spark.createDataFrame(links, "a long, b long")
    labels = None
    for number, links in enumerate(rounds):
        labels = similar.merged(labels, make(links), space, f"labels-{number}")
    want = components(make([link for links in rounds for link in links]), space, "all")
    assert sorted(map(tuple, labels.collect())) == sorted(map(tuple, want.collect()))


def test_copies_with_few_edits_meet_the_least_edited_first(spark, monkeypatch):
    """Most of 400 copies with up to four edits link to the original only, or to copies with few edits: one
    round joins them, and no pairs by the square are left."""
    rng = random.Random(11)
    base = [f"w{i}" for i in range(200)]
    texts = [" ".join(base)]
    for i in range(400):
        words = list(base)
        for j, place in enumerate(rng.sample(range(20), 1 + i % 4)):
            words[10 * place] = f"e{i}x{j}"
        texts.append(" ".join(words))
    left, candidates = [], similar.candidates_of

    def counted(*args):
        pairs = candidates(*args)
        left.append(pairs.count())
        return pairs

    monkeypatch.setattr(similar, "candidates_of", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").repartition(4)
    assert similar.groups(docs).filter("component_id <> 0").count() == 0
    assert left[0] < len(texts)


@pytest.mark.parametrize("percent", [80, 60])
def test_nodes_with_few_shared_shingles_are_not_paired(spark, monkeypatch, percent):
    """Copies with seven edits share many shingles of their prefixes with some other copy each, but are near to none."""
    from keepsake.llm.common import Workspace
    rng, base, sizes, save = random.Random(3), [f"w{i}" for i in range(200)], {}, Workspace.save

    def counted(space, df, name, *by):
        out = save(space, df, name, *by)
        sizes[name] = out.count()
        return out
    texts = [" ".join(base), " ".join(base[:198])]
    for i in range(80):
        words = list(base)
        for k in range(0, 14 if percent == 60 else 7):
            words[rng.randrange(200)] = f"e{i}x{k}"
        texts.append(" ".join(words))
    monkeypatch.setattr(Workspace, "save", counted)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in similar.groups(docs, percent=percent).collect()}
    assert got == dict(enumerate(brute(texts, percent)))
    assert sizes["postings"] < sizes["nodes"] * 20 and sizes["ranked"] < 200, sizes


@pytest.mark.parametrize("percent", [80, 55, 95])
def test_linkable_keeps_all_that_link(spark, percent):
    """Sets of all sizes that are just near enough keep every shingle that their prefixes share."""
    rng, rows, pairs = random.Random(percent), [], []
    for k in range(250):
        n = rng.randrange(1, 150)
        m = rng.randrange(n, n * 100 // percent + 1)
        shared = -(-percent * (m + n) // (100 + percent))
        if shared > n:
            continue
        order = rng.sample(range(1000 * k, 1000 * k + 900), m + n - shared)
        x, y = sorted(order[:n]), sorted(order[:shared] + order[n:])
        cut = lambda s: s[:len(s) - similar.least_overlap(len(s), percent) + similar.reach(len(s))]
        rows += [(2 * k, n, i, t) for i, t in enumerate(cut(x))] + [(2 * k + 1, m, i, t) for i, t in enumerate(cut(y))]
        pairs += [(key, t) for key in (2 * k, 2 * k + 1) for t in {*cut(x)} & {*cut(y)}]
    live = spark.createDataFrame(rows, "key long, n long, place int, token long")
    kept = similar.linkable(similar.linkable(live, percent), percent)
    assert {(r.key, r.token) for r in kept.collect()} >= set(pairs) and len(pairs) > 500
