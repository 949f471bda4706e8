"""Line dedup, quality rules, SimHash and packing against brute force, and odd rows for each."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from clausegrid.llm import line_dedup, packing, quality, simhash

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, N_LINES string, kept string"
SPACES = " \t\n\x0b\x0c\r"


def frame(spark, texts, ids=None):
    ids = range(len(texts)) if ids is None else ids
    return spark.createDataFrame([(i, t, "en", "s", None, "x", "y") for i, t in zip(ids, texts)], SCHEMA)


ODD = [None, "", " ", "\n\n", "word", "ünï " * 30, "x" * 300_000, "a b c d e " * 3000, "same line that is long enough to count\n" * 3, "same line that is long enough to count", "  SAME line that is long enough to COUNT\t"]


def brute_lines(rows, least=20, documents=3):
    key = lambda x: x.strip(SPACES).translate(str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"))
    holders = {}
    for i, t in rows:
        for x in (t or "").split("\n"):
            if len(key(x)) >= least and i is not None:
                holders.setdefault(key(x), set()).add(i)
    out = []
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if not (i is not None and len(holders.get(key(x), ())) >= documents and i != max(holders[key(x)]))]
        out.append((i, len(lines), len(lines) - len(kept), "\n".join(kept)))
    return out


@pytest.mark.parametrize("broadcast", [1000, 0])
def test_line_dedup(spark, broadcast):
    rng = random.Random(3)
    lines = [f"Line number {k} with enough characters é" for k in range(12)] + ["short", "", "Exactly twenty chars", "nineteen characters"]
    texts = ["\n".join(rng.choice(lines) + rng.choice(["", " ", "\t"]) for _ in range(rng.randint(1, 6))) for _ in range(60)] + ODD
    ids = list(range(len(texts) - 1)) + [None]
    rows = list(zip(ids, texts)) + [(5, texts[6])]
    got = line_dedup.dedup_lines(frame(spark, [t for _, t in rows], [i for i, _ in rows]), max_broadcast_keys=broadcast)
    assert "source" in got.columns and [c.lower() for c in got.columns].count("n_lines") == 1
    assert sorted(map(str, map(tuple, got.select("doc_id", "n_lines", "n_dropped", "text").collect()))) == sorted(map(str, brute_lines(rows)))
    assert line_dedup.dedup_lines(frame(spark, [])).count() == 0


@pytest.mark.parametrize("broadcast", [1000, 1, 0])
def test_line_dedup_beside_columns_of_any_name(spark, broadcast):
    common, often = "a line that every document has in it", "a line that three documents have"
    rows = [(k, f"{common}\n{often if k < 3 else 'own ' * 8 + str(k)}", k, "l", "g") for k in range(40)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, holder long, __lost string, line_key string")
    got = line_dedup.dedup_lines(docs, max_broadcast_keys=broadcast, max_bits=1 << 9)
    assert got.columns == ["doc_id", "holder", "__lost", "line_key", "text", "n_lines", "n_dropped"]
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()) == sorted(brute_lines([(i, t) for i, t, *_ in rows]))
    assert all(r["holder"] == r["doc_id"] and r["__lost"] == "l" for r in got.collect())


def test_filters_grow_and_divide_with_the_lines():
    assert line_dedup.widths(0) == (1 << 20, 1) and line_dedup.widths(10_000_000) == (1 << 28, 1)
    for n in (10**9, 10**10):
        bits, ranges = line_dedup.widths(n)
        assert bits == line_dedup.MAX_BITS and bits * ranges >= 16 * n


def test_many_ranges_read_the_texts_four_times(spark, monkeypatch):
    """64 ranges and more: each task holds the two filters of one range, and the texts are read to count, to hash, to probe and to rebuild."""
    rng = random.Random(8)
    lines = [f"Line number {k} with enough characters" for k in range(400)]
    rows = [(k, "\n".join([rng.choice(lines), *(f"own line {k} {j} of one document" for j in range(6))])) for k in range(300)]
    read = spark.sparkContext.accumulator(0)

    def counted(batches):
        for batch in batches:
            read.add(batch.num_rows)
            yield batch

    bits = 1 << 9
    n_bits, ranges = line_dedup.widths(2100, bits)
    assert ranges >= 64 and n_bits == bits
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3).mapInArrow(counted, "doc_id long, text string")
    got = line_dedup.dedup_lines(docs, max_bits=bits)
    assert sorted((r["doc_id"], r["n_lines"], r["n_dropped"], r["text"]) for r in got.collect()) == sorted(brute_lines(rows))
    assert read.value <= 4 * len(rows)
    held = line_dedup.repeated_hashes(docs, "text", bits, ranges, 20).distinct().count()
    assert held >= sum(len({k for k, t in rows if x in t.split("\n")}) > 1 for x in lines)


def test_two_filters_hold_repeats():
    a, b = line_dedup.TwoFilters(1 << 20), line_dedup.TwoFilters(1 << 20)
    h = np.random.default_rng(0).integers(0, 1 << 63, 20_000).astype(np.uint64)
    a.add(h[:10_000])
    b.add(h[5_000:])
    twice = a.twice | b.twice | (a.once & b.once)
    w, m = line_dedup._words_and_masks(h, len(twice))
    hit = (twice[w] & m) == m
    assert hit[5_000:10_000].all() and hit[:5_000].mean() < 0.05


def brute_repeats(words, least):
    n = len(words)
    longest = [max([0] + [next((k for k in range(n) if i + k >= n or j + k >= n or words[i + k] != words[j + k]), n) for j in range(n) if j != i]) for i in range(n)]
    inside = set()
    for i, m in enumerate(longest):
        if m >= least:
            inside |= set(range(i, i + m))
    return longest, inside


def test_repeats_against_brute_force():
    rng = np.random.default_rng(1)
    for _ in range(150):
        sizes = rng.integers(0, 22, 3)
        offsets = np.concatenate([[0], np.cumsum(sizes)])
        words = rng.integers(0, rng.integers(1, 5), offsets[-1]).astype(np.int64)
        longest = quality.repeat_lengths(words, offsets, 1)
        for a, b in zip(offsets, offsets[1:]):
            want, inside = brute_repeats(words[a:b].tolist(), 3)
            assert longest[a:b].tolist() == want
            assert set(np.flatnonzero(quality.covered(longest[a:b], 3)).tolist()) == inside


def test_quality_rules(spark):
    base = [f"w{k}" for k in range(400)]
    clean, loop = " ".join(base), " ".join(base[:30] * 10)
    long_repeat = " ".join(base + ["sep"] + base[:150])
    texts = [clean, loop, long_repeat, "a b", *ODD]
    rows = {r["doc_id"]: r for r in quality.assess(frame(spark, texts)).collect()}
    assert rows[0]["kept"] and not rows[1]["kept"] and rows[1]["base_failed"]
    assert not rows[2]["kept"] and rows[2]["longest_repeat"] == 150 and [tuple(s) for s in rows[2]["repeat_spans"]] == [(0, 150), (401, 551)]
    assert not rows[3]["kept"] and rows[3]["n_words"] == 2
    for k, t in enumerate(texts):
        words = [w for w in (t or "").translate({ord(c): " " for c in SPACES}).split(" ") if w]
        assert rows[k]["n_words"] == len(words) and rows[k]["word_chars"] == sum(map(len, words))
        seen = [x for x in (t or "").split("\n") if x.strip(SPACES)]
        assert rows[k]["n_dup_lines"] == len(seen) - len(set(seen))
    assert quality.assess(frame(spark, [])).count() == 0


def slow_fingerprint(text):
    words = (text or "").encode().lower().split()
    shingles = [b" ".join(words[k : k + 3]) for k in range(max(1, len(words) - 2))] if words else []
    h = [xxhash.xxh64_intdigest(s, 42) for s in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h)) if h else 0


def brute_components(rows):
    best = {k: i for k, (i, _) in enumerate(rows)}
    changed = True
    while changed:
        changed = False
        for a in range(len(rows)):
            for b in range(a):
                if (rows[a][1] ^ rows[b][1]).bit_count() <= 2:
                    low = min((x for x in (best[a], best[b]) if x is not None), default=None)
                    if best[a] != low or best[b] != low:
                        best[a] = best[b] = low
                        changed = True
    return [best[k] for k in range(len(rows))]


@pytest.mark.parametrize("hot_cell", [1024, 3])
def test_near_duplicates(spark, hot_cell):
    rng = random.Random(5)
    base = [" ".join(f"t{rng.randint(0, 5000)}" for _ in range(200)) for _ in range(12)]
    texts = list(base)
    for _ in range(60):
        words = rng.choice(texts).split(" ")
        words[rng.randrange(len(words))] = f"x{rng.randint(0, 9999)}"
        texts.append(" ".join(words))
    texts += ODD + ["two words"]
    rows = [(k if k != 3 else None, slow_fingerprint(t)) for k, t in enumerate(texts)] + [(1, slow_fingerprint(texts[2]))]
    docs = frame(spark, [*texts, texts[2]], [i for i, _ in rows])
    got = simhash.near_duplicates(docs, hot_cell=hot_cell).collect()
    want = [(i, f"{f:016x}", c) for (i, f), c in zip(rows, brute_components(rows))]
    assert sorted(map(str, map(tuple, got))) == sorted(map(str, want))
    assert simhash.near_duplicates(frame(spark, [])).count() == 0


def test_fingerprints_are_dealt_to_all_tasks(spark):
    reps = spark.range(1000).select(F.xxhash64("id").alias("fp")).groupBy("fp").count()
    plan = reps.select("fp").repartition(7, F.xxhash64("fp", F.lit(29)))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 2
    kept = simhash.near_duplicates(frame(spark, ["a b c d", "a b c d"], [5, 2]).withColumnRenamed("kept", "fp"))
    assert sorted(map(tuple, kept.select("doc_id", "component_id").collect())) == [(2, 2), (5, 2)]


def test_links_join_random_neighbours(spark):
    rng = np.random.default_rng(7)
    x = rng.integers(-(1 << 62), 1 << 62, 300)
    flips = [int(v) ^ (1 << int(a)) ^ (1 << int(b)) for v, a, b in zip(x, rng.integers(0, 63, 300), rng.integers(0, 63, 300))]
    reps = spark.createDataFrame([(int(v),) for v in {*x.tolist(), *flips}], "fp long")
    for hot in (1024, 1):
        found = {frozenset((r["a"], r["b"])) for r in simhash.links(reps, hot_cell=hot).collect()}
        from clausegrid.llm.components import spanning

        a, b = np.array([min(f) for f in found]), np.array([max(f) for f in found])
        m, root = spanning(a, b)
        of = dict(zip(m.tolist(), root.tolist()))
        assert all(of.get(int(v), int(v)) == of.get(f, f) for v, f in zip(x, flips))


def test_keep_one_leaves_one_of_each_group(spark):
    text = "one two three four five six seven eight"
    kept = simhash.keep_one(frame(spark, [text, text, "something else entirely here now", text], [4, 2, 3, None]))
    assert sorted((r["doc_id"] is None, r["doc_id"]) for r in kept.select("doc_id").collect() if r["doc_id"] is not None) == [(False, 2), (False, 3)]


def path():
    return pytest.importorskip("public_tokenizers").path("word_bpe_49k.json")


def test_packing(spark):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path())
    texts = ["hello world " * n for n in (1, 5, 900, 3000, 7000)] + ODD[:6] + ["<|endoftext|> It's ÉTÉ 12³", "tie"] * 2
    got = packing.pack_documents(frame(spark, texts), path()).collect()
    by_doc, by_seq = {}, {}
    for r in got:
        by_doc.setdefault(r["doc_id"], []).append(r)
        by_seq.setdefault(r["sequence_id"], []).append(r)
    for k, t in enumerate(texts):
        ids = np.array(tok.encode(t or "", add_special_tokens=False).ids + [1], "<u4")
        rows = sorted(by_doc[k], key=lambda r: r["piece"])
        assert [r["piece"] for r in rows] == list(range(len(rows))) and sum(r["length"] for r in rows) == len(ids)
        for r in rows:
            assert r["start"] == r["piece"] * 4096 and r["ids_crc32"] == zlib.crc32(ids[r["start"] : r["start"] + r["length"]].tobytes())
    for rows in by_seq.values():
        at = 0
        for r in sorted(rows, key=lambda r: r["offset"]):
            assert r["offset"] == at
            at += r["length"]
        assert at <= 4096
    assert len(by_seq) == -(-sum(r["length"] for r in got) // 4096)
    assert packing.pack_documents(frame(spark, []), path()).count() == 0


def test_plan_uses_every_piece_and_finds_the_fullest():
    rng = random.Random(2)
    for _ in range(60):
        room = rng.randint(5, 60)
        counts = {s: rng.randint(1, 3) for s in rng.sample(range(1, 40), 6)}
        best = max(s for s in range(room + 1) if _can(s, list(counts.items())))
        picked = packing.fullest(sorted(counts, reverse=True), counts, room)
        assert sum(s * n for s, n in picked) == best and all(n <= counts[s] for s, n in picked)
    histogram = {rng.randint(1, 100): rng.randint(1, 50) for _ in range(40)}
    used = {}
    for times, bin_ in packing.plan_bins(histogram, 100):
        assert sum(s * n for s, n in bin_.items()) <= 100
        for s, n in bin_.items():
            used[s] = used.get(s, 0) + times * n
    assert used == histogram


def test_packing_beside_columns_of_any_name(spark):
    rows = [(None if k % 2 else 7, 0, 1 + k % 5, "s", "b", k) for k in range(3000)]
    df = spark.createDataFrame(rows, "doc_id long, piece int, length long, salt string, before string, number long")
    got = packing.pack(df, 10, group_rows=50).collect()
    by_seq = {}
    for r in got:
        by_seq.setdefault(r["sequence_id"], []).append(r)
    assert len(got) == 3000 and sorted(r["number"] for r in got) == list(range(3000)) and len(by_seq) == 900
    for r in by_seq.values():
        at = 0
        for x in sorted(r, key=lambda x: x["offset"]):
            assert x["offset"] == at and x["salt"] == "s"
            at += x["length"]


def test_long_periodic_texts_are_judged_whole():
    text = "a b c d e f g " * 60_000
    r = quality.Rules(16, 0.1, 100)(__import__("pyarrow").array([text, None, ""]))
    assert r[0][0] == 420_000 and r[4][0] == 420_000 and r[5][0] == 420_000 - 7 and r[0][1] == 0 and not r[9][0]


def _can(total, items):
    if total == 0:
        return True
    return bool(items) and any(total >= k * items[0][0] and _can(total - k * items[0][0], items[1:]) for k in range(items[0][1] + 1))


def test_hash_of_kept_text_is_that_of_its_bytes(spark):
    r = frame(spark, ["é\nb"]).select(F.sha2("text", 256).alias("h")).first()
    assert r["h"] == hashlib.sha256("é\nb".encode()).hexdigest()


def test_components_of_paths_stars_and_loops(spark):
    from clausegrid.llm.components import components

    rng = random.Random(12)
    for edges in ([], [(3, 3), (None, 1)], [(1, k) for k in range(2, 40)], [(k, k + 1) for k in range(60)], [(rng.randrange(80), rng.randrange(80)) for _ in range(50)]):
        want = {}
        for a, b in edges:
            if a is not None and b is not None and a != b:
                group = want.get(a, {a}) | want.get(b, {b})
                for x in group:
                    want[x] = group
        got = dict(map(tuple, components(spark.createDataFrame(edges, "a long, b long")).collect()))
        assert got == {x: min(g) for x, g in want.items()}
