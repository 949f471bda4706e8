"""Source divergence, exact top-k and token alignment against brute force, and odd rows for each."""

import hashlib
import math
import random
import re
from collections import Counter, defaultdict

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from clausegrid.llm import alignment, ball_search, divergence, registry

# ---------------------------------------------------------------- source divergence

TERM = re.compile(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def brute_audit(rows, least, most):
    counts, docs, groups = defaultdict(Counter), defaultdict(Counter), defaultdict(set)
    for text, lang, source in rows:
        lang, source, words = lang or "", source or "", [w.translate(LOWER) for w in TERM.findall(text or "")]
        counts[lang, source].update(words)
        docs[lang].update(set(words))
        groups[lang].add(source)
    out = []
    for lang, sources in groups.items():
        kept = [t for t, n in docs[lang].items() if n >= least]
        v, whole = len(kept), {t: sum(counts[lang, s][t] for s in sources) for t in kept}

        def shares(n):
            total = sum(n[t] for t in kept)
            return {t: 1 + 10**9 * (n[t] + 5) // (total + 5 * v) for t in kept}

        p, q = {s: shares(counts[lang, s]) for s in sources}, shares(whole)
        for s in sources:
            pairs = [(o, sum(abs(p[s][t] - p[o][t]) for t in kept)) for o in sources if o != s]
            terms = [(t, p[s][t] - q[t]) for t in kept if counts[lang, s][t] and p[s][t] > q[t]]
            for part, found, top in (("pair", pairs, len(pairs)), ("term", terms, most)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:top]
                out += [(lang, s, part, i, x, k + 1) for k, (i, x) in enumerate(ranked)]
    return sorted(out)


def audit_rows():
    rng = random.Random(5)
    words = [f"w{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(60)] + ["Über", "ÉCOLE", "naïve", "日本", "İx"]
    rows = [(rng.choice([" ", "-", "\n", "9"]).join(rng.choices(words, k=rng.randint(0, 40))), rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", None, "é"])) for _ in range(150)]
    rows += [(None, "en", "a"), ("", "fr", "only"), ("alone " * 3, "xx", "one"), ("123 _", "xx", "two"), ("Tie tie TIE " * 5000, "en", "b"), ("x" * 300_000, "en", "c")]
    return rows + rows[:10] * 3


@pytest.mark.parametrize("block, held", [(256, 200_000), (2, 30)])
def test_source_divergence(spark, block, held):
    rows = audit_rows()
    docs = spark.createDataFrame([(*r, "n", "t", 1) for r in rows], "text string, lang string, source string, n string, term string, `total` int").repartition(5)
    got = divergence.audit(docs, least=5, most=7, block=block, held=held)
    assert sorted(map(tuple, got.select("lang", "source", "part", "item", "value", "rank").collect())) == brute_audit(rows, 5, 7)
    assert divergence.audit(docs.limit(0)).count() == 0


def test_shares_are_exact():
    rng = random.Random(2)
    for _ in range(2000):
        total = rng.randint(0, 10 ** rng.randint(1, 15))
        count, kinds = rng.randint(0, total), rng.randint(1, 10**6)
        assert int(divergence.share(count, total, kinds)) == 1 + 10**9 * (count + 5) // (total + 5 * kinds)


def test_a_frequent_term_leaves_a_task_once_for_each_group(spark):
    rows = [(" ".join(["often"] * 50), "en", f"s{k % 3}") for k in range(3000)]
    docs = spark.createDataFrame(rows, "text string, lang string, source string").coalesce(2)
    parts = divergence.occurrences(docs, "text", "lang", "source").collect()
    assert len(parts) <= 6 and sum(r["docs"] for r in parts) == 3000 and sum(r["n"] for r in parts) == 150_000


# ---------------------------------------------------------------- exact top-k


def brute_topk(rows, every, top):
    whole = {}
    for k, (i, v) in enumerate(rows):
        if v is not None and all(x is not None and math.isfinite(x) and math.isfinite(256 * x) for x in v):
            whole[k] = (i, [math.floor(256 * x) for x in v])
    out = []
    for i, v in whole.values():
        if i is not None and i % every == 0:
            found = [(-sum(a * b for a, b in zip(v, w)), math.inf if j is None else j) for j, w in whole.values() if j != i and len(w) == len(v)]
            out += [(i, k + 1, None if j == math.inf else j, -s) for k, (s, j) in enumerate(sorted(found)[:top])]
    return sorted(out, key=str)


def vectors(kind):
    rng = np.random.default_rng(7)
    if kind == "clusters":
        centres = rng.normal(size=(8, 6))
        x = centres[rng.integers(0, 8, 900)] + rng.normal(size=(900, 6)) * 0.02
    else:
        x = rng.normal(size=(700, 6))
    rows = [(k, [float(y) for y in v]) for k, v in enumerate(x)]
    if kind == "copies":
        rows += [(k, [0.5] * 6) for k in range(2000, 2600)] + [(k, rows[3][1]) for k in range(3000, 3100)]
    odd = [None, [], [0.0] * 6, [None] * 6, [float("nan")] * 6, [float("inf")] + [0.0] * 5, [1e307] * 6, [1.0, 2.0], [3.0, -1.0], [-0.001] * 6]
    rows += [(5000 + 10 * k, v) for k, v in enumerate(odd)] + [(5005, []), (None, [9.0] * 6), (None, [9.0] * 6), (5100, [9.0] * 6), (5100, [9.0] * 6), (20, rows[1][1])]
    return rows


@pytest.mark.parametrize("kind, shard, waves", [("clusters", None, (1, 8)), ("clusters", 50, (1, 3)), ("copies", 40, (1, 2, 4)), ("copies", 100, ()), ("spread", 64, (1,))])
def test_exact_topk(spark, kind, shard, waves):
    rows = vectors(kind)
    frame = spark.createDataFrame([(i, v, "c", 1, 0) for i, v in rows], "vec_id long, embedding array<double>, cell string, q int, rank int").repartition(5)
    got = ball_search.search(frame, F.col("vec_id") % 20 == 0, shard=shard, waves=waves)
    assert sorted(map(tuple, got.select("query_id", "rank", "vec_id", "score").collect()), key=str) == brute_topk(rows, 20, 5)
    assert ball_search.search(frame.limit(0), F.col("vec_id") % 20 == 0).count() == 0


def test_a_ball_tree_leaves_far_nodes_out():
    rng = np.random.default_rng(1)
    centres = rng.normal(size=(40, 16))
    x = np.floor(256 * (centres[rng.integers(0, 40, 8000)] + rng.normal(size=(8000, 16)) * 0.01))
    tree, queries = ball_search.BallTree(np.arange(8000), x), x[:50]
    bounds = tree.bounds(queries)
    for k, q in enumerate(queries):
        found = tree.search(q, k, 5, -math.inf, ball_search._LAST, bounds[k].tolist())
        scores = x @ q
        scores[k] = -math.inf
        best = np.lexsort((np.arange(8000), -scores))[:5]
        assert found == [(scores[i], -i) for i in best.tolist()]
        # a current score that nothing beats leaves the tree alone
        assert tree.search(q, k, 5, scores.max() + 1, 0, bounds[k].tolist()) == []
    assert tree.scored < 0.15 * 50 * 8000


# ---------------------------------------------------------------- token alignment


def naive_alignment(texts):
    import sentencepiece
    from tokenizers import Tokenizer

    a_path, b_path = registry.aligned_tokenizers()
    a, b = Tokenizer.from_file(a_path), sentencepiece.SentencePieceProcessor(model_file=b_path)
    a.encode_special_tokens = True
    letters = alignment.byte_letters()
    spans = []
    for text in texts:
        whole = (" " + (text or "")).encode()
        x, y = a.encode(" " + (text or ""), add_special_tokens=False).ids, b.encode(text or "")
        xb = [bytes(letters[c] for c in a.id_to_token(k)) for k in x]
        yb = [bytes([int(b.id_to_piece(k)[3:5], 16)]) if b.is_byte(k) else b.id_to_piece(k).replace("▁", " ").encode() for k in y]
        if not text or b"".join(xb) != whole or b"".join(yb) != whole:
            spans.append(None)
            continue
        places = [[(sum(map(len, z[:k])), sum(map(len, z[: k + 1])), i) for k, i in enumerate(ids)] for z, ids in ((xb, x), (yb, y))]
        spans.append(places)
    linked = [[] if s is None else [(i, j) for a0, a1, i in s[0] for b0, b1, j in s[1] if a0 < b1 and b0 < a1] for s in spans]
    counts = Counter(p for pairs in linked for p in set(pairs))
    most = defaultdict(int)
    for (i, _), n in counts.items():
        most[i] = max(most[i], n)
    out = []
    for s, pairs in zip(spans, linked):
        if s is None:
            out.append((0, 0, 0, 0, 0, 0, ""))
            continue
        ends = sorted({e for _, e, _ in s[0]} & {e for _, e, _ in s[1]})
        groups = []
        for lo, hi in zip([0, *ends], ends):
            groups.append("|".join(",".join(str(i) for x, y, i in side if lo <= x and y <= hi) for side in s))
        out.append((len(s[0]), len(s[1]), len(groups), len(pairs), sum(counts[p] == most[p[0]] for p in pairs), sum(counts[p] for p in pairs), hashlib.sha256(";".join(groups).encode()).hexdigest()))
    return out


ODD_TEXTS = [None, "", " ", "   ", "a", "a  b   c ", "tab\tand\nnew\r\nline  ", "it's we'll  I'd", "<|endoftext|> and <s> </s> <unk> <0x41>", "has ▁ in it", "▁", "naïve café — “quotes” … ok", "日本語 テキスト　全角 空白", "a b  c  d\u0085 e",
             "emoji 😀😃 x", "\x00 nul \x01", "123 4567 89", "x" * 20_000, "Ünï " * 700, "word,word;word " * 900, "a b", "a b", "Å Å"]


def test_alignment_of_whole_texts(spark):
    rng = random.Random(4)
    words = ["the", "The", "tokenizers", "overlap", "überall", "1234", "don't", "\n", "(x)", "日本", "foo_bar", "", "é"]
    texts = ODD_TEXTS + ["".join(rng.choice([" ", " ", "  ", "\n", ""]) + rng.choice(words) for _ in range(rng.randint(1, 60))) for _ in range(80)]
    rows = [(None if k == 7 else k % 90, t, 0, "r") for k, t in enumerate(texts)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, n_a int, r string").repartition(4)
    want = sorted(map(str, [(r[0], *x) for r, x in zip(rows, naive_alignment(texts))]))
    for most in (1_000_000, 40, 0):
        got = alignment.align(docs, *registry.aligned_tokenizers(), max_broadcast=most).select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")
        assert sorted(str(tuple(r)) for r in got.collect()) == want
    assert alignment.align(docs.limit(0), *registry.aligned_tokenizers()).count() == 0


def test_two_pointers():
    steps = lambda a, b: [x.tolist() for x in alignment.two_pointers(np.array(a, np.int64), np.array(b, np.int64))]
    assert steps([2, 5, 6], [1, 2, 6]) == [[0, 0, 1, 2], [0, 1, 2, 2], [False, True, False, True]]
    assert steps([], []) == [[], [], []]


def test_chunks_are_as_whole_texts():
    both = alignment.Pair(*registry.aligned_tokenizers())
    assert both.by_space and both.by_mark
    texts = [t for t in ODD_TEXTS if t] + ["it's 12.5%, isn't it?", "a.b,c;d:e/f", "x\n\ny", "naïve,été.", "(a)(b)", "a- b -c", "1a2b", "'s 's", "don''t", "“a”,b", "x\n.y ,z"]
    plain = lambda found: [x.to_pylist() if isinstance(x, pa.Array) else x for x in found]
    chunked = plain(both.align(pa.array(texts)))
    for both.by_space, both.by_mark in ((True, False), (False, False)):
        both.chunks.clear()
        assert plain(both.align(pa.array(texts))) == chunked
