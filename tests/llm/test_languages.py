import numpy as np

from keepsake.llm import languages
from keepsake.llm.common import remainder_of


def test_held_out_accuracy(docs):
    got = {r.doc_id: r for r in languages.identify(docs).collect()}
    true = {r.doc_id: r.lang for r in docs.collect()}
    held = [k for k in true if got[k].held_out]
    assert held and all(got[k].held_out == (remainder_of(k, 4) == 2) for k in true)
    assert np.mean([got[k].lang_pred == true[k] for k in held]) > 0.95


def test_odd_rows(odd):
    got = languages.identify(odd).collect()
    assert len(got) == odd.count()
    for row, text in zip(got, [r.text for r in odd.collect()]):
        assert (row.lang_pred == "und") == (not text or not any(c.isalpha() for c in text))
        assert 0 <= row.score <= 1
    assert {r.lang_pred for r in languages.identify(odd.filter("lang IS NULL")).collect()} == {"und"}
    assert languages.identify(odd.limit(0)).count() == 0
    assert languages.keep_known(odd).columns == odd.columns


def test_bundle_is_the_sum_of_bound_letters():
    texts = ["abca", "xyz"]
    owner, number, counts, rows = languages.ngrams(texts, 3)
    got = languages.bundle(owner, number, counts, rows, 2, 64, 7)
    for i, text in enumerate(texts):
        codes = [0, *map(ord, text), 0]
        want = np.zeros(64)
        for a, b, c in zip(codes, codes[1:], codes[2:]):
            v = [languages.letter_vector(p, 64, 7).astype(int) for p in (a, b, c)]
            want += np.roll(v[0], 2) * np.roll(v[1], 1) * v[2]
        assert (got[i] == want).all()
