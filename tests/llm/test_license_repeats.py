"""License templates in texts that repeat them, where neighbouring diagonals chain into one long band."""

import random

from rolloutframe.llm import license_scan

LINE = "all rights reserved"


def docs(spark, texts):
    return spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")


def test_repeated_line_keeps_its_label(spark):
    out = {r.doc_id: r for r in license_scan.license_labels(docs(spark, [" ".join([LINE] * n) for n in range(1, 40)])).collect()}
    assert {i: (r.labels, r.score) for i, r in out.items()} == {i: ("all-rights-reserved", 1.0) for i in range(39)}
    places = license_scan.license_scan(docs(spark, [" ".join([LINE] * 4)])).where("label is not null").collect()
    assert sorted((p.first, p.last) for p in places) == [(0, 8), (9, 11)]


def test_near_matches_against_brute_force(spark):
    # every stretch of words that a place may span, within a chain of hits: covered where a share of the k-grams is in it
    templates = {"x": "a b c d a b c e", "y": LINE}
    r, share, slack = random.Random(5), 0.7, 3
    texts = [" ".join(r.choice("abcde") for _ in range(r.randint(5, 90))) for _ in range(60)] + [f"{'a b c ' * n}d a b c e {'a b c ' * n}" for n in range(12)]
    texts += [f"{LINE} z " * n for n in range(1, 9)]
    out = {x.doc_id: x for x in license_scan.license_labels(docs(spark, texts), phrases={}, templates=templates, share=share, slack=slack).collect()}
    for i, text in enumerate(texts):
        w, found = text.split(), {}
        for label, t in templates.items():
            t = t.split()
            grams = [tuple(t[k : k + 3]) for k in range(len(t) - 2)]
            hits = [(p, k) for p in range(len(w) - 2) for k, g in enumerate(grams) if tuple(w[p : p + 3]) == g]
            chain, bands = None, []
            for diagonal in sorted({p - k for p, k in hits}):
                if chain is None or diagonal - chain > slack:
                    bands.append([])
                bands[-1] += [(p, k) for p, k in hits if p - k == diagonal]
                chain = diagonal
            most = 2 * (len(grams) + slack)
            scores = [len({k for p, k in band if a <= p <= a + most}) / len(grams) for band in bands for a, _ in band]
            if max(scores, default=0) >= share:
                found[label] = max(scores)
        assert out[i].labels == ",".join(sorted(found)), text
        assert abs(out[i].score - max(found.values(), default=0)) < 1e-9, text
