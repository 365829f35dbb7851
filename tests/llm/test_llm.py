"""Brute-force versions, round trips, held-out accuracy and edge cases of the language-model operators."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from rolloutframe.llm import ads_search, chat, license_scan, maxscore, pareto_mix, parity_join, pu_quality, queries, sp_sampling, token_counts, toxicity
from rolloutframe.llm._spark import components
from rolloutframe.llm._text import slices

BPE, PIECES = queries.tokenizer("byte_bpe_50k.json"), queries.tokenizer("piece_bpe_32k.model")
ODD = [None, "", " ", "\n\n", "a", "İK é 漢 😀", "x" * 5000, "the " * 400, "<|endoftext|> a", "it's we'll 'r\n's  \t x"]


def docs(spark, texts, extra=True):
    rows = [(i, t, "src", t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, score string")
    return df if extra else df.select("doc_id", "text", "source")


def fuzz(n, alphabet, size, seed=1):
    r = random.Random(seed)
    return ["".join(r.choice(alphabet) for _ in range(r.randint(0, size))) for _ in range(n)]


# token counts


def test_token_counts_match_the_library(spark):
    from tokenizers import Tokenizer

    texts = [*fuzz(400, "ab c'stmdrevl \n\t  1２٣é漢!? 　\u0085​😀ñ'll", 60), *ODD, "=" * 999 + " " * 50]
    own = {r.doc_id: r for r in token_counts.token_counts(docs(spark, texts), BPE, limit=100).collect()}
    library = Tokenizer.from_file(BPE).encode_batch([t or "" for t in texts], add_special_tokens=False)
    for i, t in enumerate(texts):
        assert own[i].n_tokens == len(library[i].ids), repr(t)
        assert own[i].n_bytes == len((t or "").encode())
        assert own[i].over_limit == (own[i].n_tokens > 100)


def test_splitter_scan_equals_single_steps():
    split = token_counts.counter(BPE).split
    cls = np.random.default_rng(3).integers(0, len(token_counts.CLASSES), 3000)
    cls[-1] = 0
    state, begin = 0, np.zeros(len(cls), bool)
    for i, c in enumerate(cls):
        out = split.emit[c, state]
        begin[i] |= bool(out & token_counts.START)
        if out & token_counts.PREVIOUS:
            begin[i - 1] = True
        state = split.next[c, state]
    assert (split.starts(cls.astype(np.intp)) == begin).all()


def test_token_counts_of_long_pieces():
    """Pieces that no break cuts, in chunks: also where the guessed states are wrong, and the same chunks come again."""
    import time

    from tokenizers import Tokenizer

    r = random.Random(7)
    word = lambda letters, n: "".join(r.choice(letters) for _ in range(n))
    texts = ["ha" * 3000, "abc" * 3000, "=" * 999 + "-" * 2500, " " * 7001, "the" * 2000 + "ing" * 1500, "一二" * 2000, "aab" * 2777 + "x" * 1025, word("etaoin", 2049), word("ab", 6000), word("etaoinshrdlu", 100_000)]
    library = Tokenizer.from_file(BPE)
    own = token_counts.counter(BPE)
    for t in texts:
        ((_, _, data, offsets),) = slices(pa.array([t]))
        assert own.count(data, offsets)[0] == len(library.encode(t, add_special_tokens=False).ids)
    ((_, _, data, offsets),) = slices(pa.array([word("etaoinshrdlu", 1_000_000)]))
    begin = time.time()
    own.count(data, offsets)
    assert time.time() - begin < 20


def test_token_counts_empty(spark):
    assert token_counts.token_counts(docs(spark, []), BPE).count() == 0


# chat


def tree(spark, rows):
    return spark.createDataFrame(rows, "tree long, node long, parent long, score double, role string, text string")


def test_reply_tree_paths(spark):
    rows = [(1, 1, None, 0.0, "user", "q"), (1, 2, 1, 0.9, "assistant", "a"), (1, 3, 1, 0.1, "assistant", "b"), (1, 4, 3, 0.2, "user", "c"), (1, 5, 2, -3.0, "user", "d")]
    rows += [(2, 7, 8, 0.0, "user", "cycle"), (2, 8, 7, 0.0, "user", "cycle"), (None, 1, 99, 0.0, None, None)]
    rows += [(3, i, i - 1 if i else None, 0.0, "user" if i % 2 == 0 else "assistant", str(i)) for i in range(21)]
    out = chat.format_paths(tree(spark, rows), best=2).orderBy("tree", "rank").collect()
    got = {(r.tree, r["rank"]): r for r in out}
    assert set(got) == {(None, 1), (1, 1), (1, 2), (3, 1)}
    assert (got[1, 1].leaf, got[1, 2].leaf) == (4, 5)
    assert got[3, 1].n_turns == 21
    assert [int(x) for x in re.findall(r"\n(\d+)<", got[3, 1].formatted)] == list(range(21))


def test_chat_round_trip(spark):
    texts = ["</s>[INST] ok [/INST]", "a\\<b[c\\\\", None, "", "<|im_start|>user\nx<|im_end|>\n", "😀 <", "\\", "[n"]
    rows = [(i, 1, None, 0.0, "user", t) for i, t in enumerate(texts)] + [(i, 2, 1, 0.0, "assistant", t) for i, t in enumerate(texts)]
    rows += [(99, 1, None, 0.0, "a\nb[<", "x")]
    for r in chat.read_back(chat.format_paths(tree(spark, rows))).collect():
        if r.tree == 99:
            assert [(t.role, t.text) for t in r.turns] == [("a\nb[<", "x")]
            continue
        t = texts[r.tree] or ""
        assert [(x.role, x.text) for x in r.turns] == [("user", t), ("assistant", t)]
        assert r.loss == t
        inner = r.formatted.replace("<|im_start|>", "").replace("<|im_end|>", "")
        assert not re.search(r"<[|/s]|\[/?INST", inner)


# vector searches


def vectors(spark, n=300, d=16, seed=0):
    x = np.random.default_rng(seed).standard_normal((n, d)).astype(np.float32)
    x[7] = x[100]
    x[8] = x[100]
    rows = [(i, [float(v) for v in r]) for i, r in enumerate(x)]
    rows += [(1000, None), (1001, [float("nan")] * d), (1002, [None] * d), (None, [1.0] * d), (1003, [0.0] * d)]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>"), x


def test_maxscore_is_exact(spark):
    df, x = vectors(spark)
    q = np.floor(256 * x.astype(np.float64))
    zero = {1003: np.zeros(16)}
    every = {**dict(enumerate(q)), **zero}
    got = defaultdict(list)
    for r in maxscore.maxscore(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[r.query_id].append((r.vec_id, r.score))
    for i in range(0, 300, 50):
        want = sorted(((j, int(every[i] @ v)) for j, v in every.items() if j != i), key=lambda p: (-p[1], p[0]))[:5]
        assert got[i] == want


@pytest.mark.parametrize("block", [3, 16_384])
def test_searches_with_repeated_ids_and_other_lengths(spark, monkeypatch, block):
    """A query's own rows are never results, however many there are; odd lengths take no part; blocks of queries agree."""
    from rolloutframe.llm import _vectors

    monkeypatch.setattr(_vectors, "QUERY_BLOCK", block)
    r = np.random.default_rng(8)
    x = r.standard_normal((400, 12)).astype(np.float32)
    ids = np.concatenate([np.arange(390), [0, 50, 50, 50, 50, 50, 50, 50, 100, 0]])
    x[390:] = x[ids[390:]] * 1.5  # larger products than any other row's
    rows = [(int(i), [float(c) for c in v], "x") for i, v in zip(ids, x, strict=True)] + [(500, [1.0] * 5, "y"), (550, [9.0] * 30, "y")]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<float>, score string")
    q = np.floor(256 * x.astype(np.float64))
    got, near = defaultdict(list), defaultdict(list)
    for row in maxscore.maxscore(df, F.col("vec_id") % 50 == 0).orderBy("query_id", "rank").collect():
        got[row.query_id].append((row.vec_id, row.score))
    for row in ads_search.adaptive_search(df, F.col("vec_id") % 50 == 0, k=20).orderBy("query_id", "rank").collect():
        near[row.query_id].append(row.vec_id)
    assert set(got) == set(near) == {0, 50, 100, 150, 200, 250, 300, 350}
    for i in got:
        own = min((tuple(v) for j, v in zip(ids, q, strict=True) if j == i))
        want = sorted(((int(j), int(np.dot(own, v))) for j, v in zip(ids, q, strict=True) if j != i), key=lambda p: (-p[1], p[0]))[:5]
        assert got[i] == want
        assert len(near[i]) == 20
        assert i not in near[i]


def test_probes_follow_the_structure_of_the_vectors():
    r = np.random.default_rng(3)
    centres = r.standard_normal((64, 16)) * 6
    for x, most in ((centres[r.integers(0, 64, 4000)] + r.standard_normal((4000, 16)) * 0.1, 24), (r.standard_normal((4000, 16)), 64)):
        x /= np.linalg.norm(x, axis=1)[:, None]
        sample = np.column_stack([x, np.zeros(len(x))])
        assert ads_search.probes_for(sample, ads_search.fit(sample, 64), 20) <= most


def test_adaptive_search_recall(spark):
    df, x = vectors(spark, 3000, 32, 2)
    x64 = x.astype(np.float64)
    hits = total = 0
    got = defaultdict(list)
    for r in ads_search.adaptive_search(df, F.col("vec_id") % 100 == 0).collect():
        got[r.query_id].append(r)
    for i in range(0, 3000, 100):
        s = x64 @ x64[i]
        want = {j for j in sorted((j for j in range(3000) if j != i), key=lambda j: (-s[j], j))[:20]}
        rows = sorted(got[i], key=lambda r: r["rank"])
        assert len(rows) == 20
        assert i not in {r.vec_id for r in rows}
        assert all(r.score == pytest.approx(s[r.vec_id], abs=1e-12) for r in rows)
        assert [(-r.score, r.vec_id) for r in rows] == sorted((-r.score, r.vec_id) for r in rows)
        hits += len(want & {r.vec_id for r in rows})
        total += 20
    assert hits / total >= 0.9


def test_searches_on_empty_tables(spark):
    df = vectors(spark)[0].where("false")
    assert maxscore.maxscore(df, F.col("vec_id") % 50 == 0).count() == 0
    assert ads_search.adaptive_search(df, F.col("vec_id") % 20 == 0).count() == 0


# near duplicates


def brute_components(texts, k=4, num=85, den=100):
    sets = []
    for t in texts:
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), t or ""))
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else ({tuple(w)} if w else set()))
    up = list(range(len(texts)))

    def find(a):
        while up[a] != a:
            a = up[a]
        return a

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and den * len(sets[i] & sets[j]) >= num * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                up[b] = a
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


def copies(seed, groups=12, most=30):
    r = random.Random(seed)
    texts = []
    for _ in range(groups):
        base = [f"w{r.randint(0, 3000)}" for _ in range(r.choice([3, 8, 12, 30, 90, 300]))]
        for _ in range(r.randint(1, most)):
            own = [w if r.random() > 0.01 else f"e{r.randint(0, 9)}" for w in base]
            cut = r.randint(0, len(own) // 12)
            texts.append(" ".join(own[cut:]))
    r.shuffle(texts)
    return texts


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates_against_all_pairs(spark, seed):
    texts = [*copies(seed), None, "", "  ", "Same Words here", "same words HERE", "one"]
    want = brute_components(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.near_duplicates(docs(spark, texts)).collect()}
    assert got == want


def test_near_duplicates_in_cells(spark, monkeypatch):
    monkeypatch.setattr(parity_join, "BLOCK_ROWS", 4)  # large clusters go through the grid of cells
    texts = copies(5, 6, 40)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in parity_join.near_duplicates(docs(spark, texts)).collect()}
    assert got == brute_components(texts)


def test_large_group_of_near_copies_beside_others(spark, monkeypatch):
    """One group above the size of a block with members that its least one does not link, and texts that share a passage."""
    monkeypatch.setattr(parity_join, "BLOCK_ROWS", 8)
    r = random.Random(9)
    base = [f"w{i}" for i in range(60)]
    texts = []
    for i in range(60):
        own = list(base)
        for _ in range(r.randint(0, 4)):
            own[r.randint(0, 59)] = f"e{r.randint(0, 99)}"
        texts.append(" ".join(own))
    texts += [" ".join([f"u{i}-{j}" for j in range(25)] + base[:30]) for i in range(20)]
    assert len(set(texts)) > 60
    got = {x.doc_id: (x.n_shingles, x.component_id) for x in parity_join.near_duplicates(docs(spark, texts)).collect()}
    assert got == brute_components(texts)


@pytest.mark.parametrize("num", [80, 85])
def test_pairs_within_the_bound_share_a_key(num):
    bands = parity_join.Bands(num, 100)
    r = np.random.default_rng(4)
    seen = 0
    for n in (4, 5, 6, 7, 9, 13, 20, 47, 100, 333, 2000, 40_000):
        for _ in range(200 if n < 50 else 20):
            a = r.integers(0, 1 << 63, n).astype(np.uint64)
            drop = r.integers(0, 9 * n // 40 + 1)
            b = np.concatenate([a[drop // 2 :], r.integers(0, 1 << 63, int(r.integers(0, drop - drop // 2 + 1))).astype(np.uint64)])
            both = len(np.intersect1d(a, b))
            if 100 * both < num * (len(a) + len(b) - both) or set(a) == set(b):
                continue
            seen += 1
            h = np.concatenate([np.sort(a), np.sort(b)])
            owner, key = parity_join.part_keys(h, np.array([0, len(a), len(a) + len(b)]), bands)
            assert set(key[owner == 0]) & set(key[owner == 1])
    assert seen > 300


@pytest.mark.parametrize("num", [80, 85])
def test_unrelated_sketches_lie_beyond_the_bound(num):
    bands = parity_join.Bands(num, 100)
    r = np.random.default_rng(5)
    for n in (40, 150, 600, 5000):
        h = r.integers(0, 1 << 63, 30 * n).astype(np.uint64)
        raw = parity_join.sketches(h, np.arange(31) * n, bands)
        m = parity_join.folded(raw)
        far = np.bitwise_count(m[:, None] ^ m[None]).sum(axis=2)[np.triu_indices(30, 1)]
        assert far.min() > bands.far(n, n)


def test_similarities_that_are_refused():
    for num in (74, 101):
        with pytest.raises(ValueError, match="similarity"):
            parity_join.Bands(num, 100)


def test_buckets_of_sorted_runs():
    r = np.random.default_rng(2)
    keys, ids = r.integers(0, 40, 900), r.integers(0, 60, 900)
    keys[:200] = 7
    order = np.lexsort((ids, keys))
    keys, ids = keys[order], ids[order]
    cut = [0, 3, 250, 251, 600, 900]
    got = defaultdict(set)
    for b, i in parity_join.buckets(((keys[x:y], ids[x:y]) for x, y in zip(cut, cut[1:])), 30):
        for u, v in zip(b.tolist(), i.tolist()):
            got[u].add(v)
    want = {frozenset(ids[keys == k].tolist()) for k in set(keys.tolist())}
    assert {frozenset(x) for x in got.values()} == {w for w in want if len(w) > 1}


def test_words_of_equal_polynomials_have_different_hashes():
    from rolloutframe.llm._text import range_hashes

    t = np.zeros(1, np.uint8)
    while len(t) < 4096:
        t = np.concatenate([t, 1 - t])
    for n in (8, 64, 256, 1024, 4096):
        data = np.concatenate([t[:n], 1 - t[:n]]) + 97
        a, b = range_hashes(data, np.array([0, n]), np.array([n, 2 * n]))
        assert a != b
    same = range_hashes(np.frombuffer(b"xabcabc" + b"y" * 300 + b" " + b"y" * 300, np.uint8), np.array([1, 4, 7, 308]), np.array([4, 7, 307, 608]))
    assert same[0] == same[1]
    assert same[2] == same[3]


@pytest.mark.parametrize("one_task", [0, 1000])
def test_components(spark, one_task):
    edges = [(i, i + 1) for i in range(40)] + [(100, 101), (102, 101), (200, 200)]
    got = {r.node: r.root for r in components(spark.createDataFrame(edges, "a long, b long"), one_task=one_task).collect()}
    assert got == {**dict.fromkeys(range(41), 0), 100: 100, 101: 100, 102: 100}


def test_near_duplicates_empty(spark):
    assert parity_join.near_duplicates(docs(spark, [])).count() == 0


# sampled segmentations


def test_sentencepiece_round_trip_and_reruns(spark):
    texts = [*fuzz(200, "ab c  the\n\n\t▁é漢😀\x00ing", 50), *ODD, "x▁ y ▁"]
    df = docs(spark, texts)
    once = {r.doc_id: r for r in sp_sampling.round_trip(df, PIECES).collect()}
    again = {r.doc_id: r for r in sp_sampling.round_trip(df.repartition(7), PIECES).collect()}
    assert once == again
    assert all(r.lossless for r in once.values())
    encoded = sp_sampling.encode(df, PIECES)
    back = {r.doc_id: r.text for r in sp_sampling.decode(encoded, PIECES).collect()}
    assert back == {i: t or "" for i, t in enumerate(texts)}
    ids = {r.doc_id: r.piece_ids for r in encoded.collect()}
    for i, r in once.items():
        assert hashlib.sha256(np.array(ids[i], "<i4").tobytes()).hexdigest() == r.ids_sha256


def test_sentencepiece_probabilities():
    """Sampled segmentations of one word come as often as the product of their pieces' weights says."""
    own = sp_sampling.lattice(PIECES, 0.5)
    import sentencepiece

    sp = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    scores = sorted((-sp.get_score(i), i) for i in range(sp.get_piece_size()) if not (sp.is_byte(i) or sp.is_control(i) or sp.is_unknown(i)))
    weight = {sp.id_to_piece(i): (n + 2.0) ** -0.5 for n, (_, i) in enumerate(scores)}

    def ways(s):
        if not s:
            return {(): 1.0}
        return {(s[:k], *rest): weight[s[:k]] * w for k in range(1, len(s) + 1) if s[:k] in weight for rest, w in ways(s[k:]).items()}

    every = ways("▁then")
    n = 20_000
    data, offsets = np.frombuffer(b"then" * n, np.uint8), np.arange(n + 1) * 4
    ids, at = sp_sampling.encode_slice(own, data, offsets, np.arange(n).astype(np.uint64))
    seen = Counter(tuple(sp.id_to_piece(int(x)) for x in ids[a:b]) for a, b in zip(at[:-1], at[1:], strict=True))
    total = sum(every.values())
    for way, w in every.items():
        p = w / total
        assert abs(seen[way] - n * p) < 5 * math.sqrt(n * p * (1 - p)) + 1


def test_sentencepiece_long_segments(monkeypatch):
    """Chunks give the same sums as place by place, and segments without a blank stay lossless and quick."""
    import time

    own = sp_sampling.lattice(PIECES, 1.0)
    r = np.random.default_rng(6)
    w = np.where(r.random((1500, 6)) < 0.5, -3 * r.random((1500, 6)), -np.inf)
    w[:, 0] = -9.0
    want = np.zeros(1501)
    for t in range(1500):
        want[t + 1] = np.logaddexp.reduce([want[t + 1 - k] + w[t, k - 1] for k in range(1, 7) if t + 1 - k >= 0])
    assert np.allclose(sp_sampling.forward(w), want[1:])
    rnd = random.Random(3)
    texts = ["x" * 5000, "".join(rnd.choice("etaoinshé漢▁") for _ in range(9000)), "a b " * 10 + "".join(rnd.choice("etaoin") for _ in range(6000)) + " c"]
    ((_, _, data, offsets),) = slices(pa.array(texts))
    seeds = np.arange(3, dtype=np.uint64)
    ids, at = sp_sampling.encode_slice(own, data, offsets, seeds)
    raw, place = sp_sampling.decode_ids(own, ids.astype(np.int64), at)
    assert [raw[a:b].tobytes().decode() for a, b in zip(place[:-1], place[1:], strict=True)] == texts
    assert (sp_sampling.encode_slice(own, data, offsets, seeds)[0] == ids).all()
    ((_, _, data, offsets),) = slices(pa.array(["".join(rnd.choice("etaoin") for _ in range(500_000))]))
    begin = time.time()
    sp_sampling.encode_slice(own, data, offsets, seeds[:1])
    assert time.time() - begin < 20
    # as many pieces on average as when the same text is filtered place by place
    short = "".join(rnd.choice("etaoin") for _ in range(4500))
    ((_, _, data, offsets),) = slices(pa.array([short] * 20))
    sizes = []
    for most in (4096, 10_000):
        monkeypatch.setattr(sp_sampling, "LONG", most)
        sizes.append(np.diff(sp_sampling.encode_slice(own, data, offsets, np.arange(20, dtype=np.uint64))[1]).mean())
    assert abs(sizes[0] / sizes[1] - 1) < 0.01


# mixing


def test_mix_properties(spark):
    r = random.Random(2)
    rows = [(i, " ".join("w" * r.randint(1, 200) for _ in range(r.randint(0, 300))), r.choice(["a", "a", "a", "b", None])) for i in range(900)]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = pareto_mix.pareto_mix(df).collect()
    assert {r.doc_id for r in out} == set(range(900))
    again = {r.doc_id: r.taken for r in pareto_mix.pareto_mix(df.repartition(5)).collect()}
    by = defaultdict(list)
    source = {i: s for i, _, s in rows}
    for x in out:
        assert x.size == len((rows[x.doc_id][1]).split())
        assert 0 <= x.taken <= 2 * x.size
        assert again[x.doc_id] == x.taken
        by[source[x.doc_id]].append(x)
    for own in by.values():
        target = own[0].target
        assert target <= 2 * own[0].source_size + 1e-6
        assert abs(sum(x.taken for x in own) - target) <= max(x.size for x in own)
    assert sum(own[0].target for own in by.values()) == pytest.approx(1.5 * sum(x.size for x in out))


def test_mix_edges(spark):
    out = {r.doc_id: r for r in pareto_mix.pareto_mix(docs(spark, ODD)).collect()}
    assert out[0].size == out[1].size == 0
    assert out[0].taken == 0
    assert pareto_mix.pareto_mix(docs(spark, [])).count() == 0
    assert pareto_mix.pareto_mix(docs(spark, [None, ""])).count() == 2


# licenses


def test_license_scan(spark):
    near = "Permission is hereby granted, free of charge, to any person obtaining a copy of this nice software and associated documentation files (the Software), to deal in the Software without any restriction"
    texts = ["Under the MIT license; under  the-MIT License", "apache license version 20", "Apache License, Version 2 and cc by-nc", near, "cc by é nc", *ODD]
    out = {r.doc_id: r for r in license_scan.license_labels(docs(spark, texts)).collect()}
    assert (out[0].n_base, out[0].first_word, out[0].last_word, out[0].base_labels) == (2, 0, 4, "mit")
    assert out[1].n_base == 0
    assert out[2].base_labels == "apache-2,cc-by-nc"
    assert (out[3].n_base, out[3].labels) == (0, "mit")
    assert out[4].n_base == 0
    assert [(out[5].n_words, out[5].labels), (out[6].n_words, out[6].labels)] == [(0, ""), (0, "")]
    assert all(0 <= r.score <= 1 for r in out.values())
    assert license_scan.license_labels(docs(spark, [])).count() == 0


def test_base_places_against_brute_force(spark):
    words = "under the mit license apache version 2 cc by nc x".split()
    r = random.Random(3)
    texts = [" ".join(r.choice(words) for _ in range(60)) + " under the mit license cc by nc cc by nc" * r.randint(0, 1) for _ in range(60)]
    out = {x.doc_id: x for x in license_scan.license_labels(docs(spark, texts)).collect()}
    for i, t in enumerate(texts):
        w = t.split()
        places = [(k, label) for p, label in license_scan.PHRASES.items() for k in range(len(w)) if w[k : k + len(p.split())] == p.split()]
        assert out[i].n_base == len(places)
        assert out[i].first_word == min((k for k, _ in places), default=None)
        assert out[i].base_labels == ",".join(sorted({label for _, label in places}))


# learned scores


@pytest.fixture(scope="module")
def labelled():
    import pyarrow.parquet as pq

    d = pq.read_table("/root/testdata/sf0.1/documents.parquet", columns=["doc_id", "text"]).to_pandas()
    return d.merge(pq.read_table("/root/testdata/sf0.1/labels.parquet").to_pandas(), on="doc_id")


def crc(ids, n):
    return np.array([zlib.crc32(str(i).encode()) % n for i in ids])


def test_toxicity_held_out(labelled):
    rest = crc(labelled.doc_id, 3)
    train, test = labelled[rest != 1][:1800], labelled[rest == 1]
    network, tables = toxicity.fit(train.text.tolist(), train.toxic.to_numpy())
    s = np.concatenate([network.scores(data, offsets, tables) for _, _, data, offsets in slices(pa.array(test.text.tolist()))])
    y = test.toxic.to_numpy()
    p = s >= 0.7
    assert (p == y).mean() > 0.95
    assert (p & (y == 1)).sum() > 0.6 * y.sum()


def test_quality_held_out(labelled):
    rest = crc(labelled.doc_id, 5)
    train, test = labelled[rest != 0], labelled[rest == 0]
    features = lambda t: np.concatenate([pu_quality.features(data, offsets) for _, _, data, offsets in slices(pa.array(t.tolist()))])
    positive, web = features(train.text[train.quality == 1]), features(train.text)
    prior = pu_quality.estimated_prior(positive, web)
    assert abs(prior - train.quality.mean()) < 0.03
    network = pu_quality.fit(positive, web, prior)
    y = test.quality.to_numpy()
    assert ((network.scores(features(test.text)) >= 0.3) == y).mean() > 0.95


def test_scores_without_labels_and_odd_texts(spark):
    labels = spark.createDataFrame([], "doc_id long, quality int, toxic int")
    df = docs(spark, ODD, extra=False)
    for m in (toxicity, pu_quality):
        out = m.score(df, m.train(df, labels, F.lit(True))).collect()
        assert len(out) == len(ODD)
        assert all(0 <= r.score <= 1 for r in out)
    texts = ["you idiot fool"] * 30 + ["a calm and pleasant text"] * 60
    labels = spark.createDataFrame([(i, int(i >= 30), int(i < 30)) for i in range(90)], "doc_id long, quality int, toxic int")
    df = docs(spark, texts + ODD, extra=False)
    for m in (toxicity, pu_quality):
        assert m.score(df, m.train(df, labels, F.lit(True))).count() == 90 + len(ODD)


# the pipeline


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "toxicity", "near_duplicates", "mix", "sentencepiece"]
    d, docs_ = "/root/testdata/sf0.001", None
    docs_ = spark.read.parquet(f"{d}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs_, d)
        assert set(out.columns) == {"doc_id", "text", "lang", "source", "n_chars"}
        if name == "near_duplicates":
            rows = docs_.select("doc_id", "text").collect()
            place = {i: r.doc_id for i, r in enumerate(sorted(rows, key=lambda r: r.doc_id))}
            want = brute_components([r.text for r in sorted(rows, key=lambda r: r.doc_id)], 5, 80)
            assert sorted(r.doc_id for r in out.collect()) == sorted(place[i] for i, (_, c) in want.items() if i == c)
        docs_ = spark.createDataFrame(out.collect(), out.schema)
    assert docs_.count() > 0
