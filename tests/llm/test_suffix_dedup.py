import hashlib
import random
from collections import Counter

from sievewright.llm.run_index import RunIndex
from sievewright.llm.suffix_dedup import free_prefix, suffix_dedup


def brute(texts, least):
    raw = [(t or "").encode() for t in texts]
    seen = Counter(b[i : i + least] for b in raw for i in range(len(b) - least + 1))
    out = []
    for b in raw:
        mark = bytearray(len(b))
        for i in range(len(b) - least + 1):
            if seen[b[i : i + least]] > 1:
                mark[i : i + least] = b"\1" * least
        kept = bytes(c for c, m in zip(b, mark) if not m)
        runs = sum(1 for i, m in enumerate(mark) if m and (i == 0 or not mark[i - 1]))
        out.append((len(b), sum(mark), runs, hashlib.sha256(kept).hexdigest()))
    return out


def got(spark, texts, least, hot=1024):
    docs = spark.createDataFrame(list(enumerate(texts)), "rid long, text string").repartition(3)
    rows = suffix_dedup(docs, least, hot).collect()
    return [tuple(r)[1:5] for r in sorted(rows, key=lambda r: r.rid)]


def corpus(seed, n, alphabet, size):
    rng = random.Random(seed)
    base = ["".join(rng.choices(alphabet, k=size)) for _ in range(5)]
    out = [None, "", "é" * size, base[0], base[0], "a" * (3 * size)]
    for _ in range(n):
        t = ""
        for _ in range(rng.randint(1, 4)):
            b = rng.choice(base)
            a = rng.randrange(len(b))
            t += b[a : a + rng.randint(1, size)] + "".join(rng.choices(alphabet, k=rng.randint(0, 8)))
        out.append(t)
    return out


def test_matches_brute_force(spark):
    texts = corpus(1, 120, "abcdeé ", 500)
    assert got(spark, texts, 200) == brute(texts, 200)


def test_hot_groups_are_exact(spark):
    texts = corpus(2, 80, "abcdefgh", 300)
    line = "".join(random.Random(5).choices("xyzuvw", k=90))
    rng = random.Random(3)
    texts += [("".join(rng.choices("abcd", k=rng.randint(50, 90))) + line) + texts[rng.randrange(6, 80)][:120] for _ in range(60)]
    assert got(spark, texts, 200, hot=5) == brute(texts, 200)
    assert got(spark, texts, 24, hot=3) == brute(texts, 24)


def test_long_document_in_parts(spark, monkeypatch):
    rng = random.Random(9)
    part = "".join(rng.choices("abcdefghij", k=400))
    text = "".join(rng.choices("abcdefghij", k=600_000)) + part + "".join(rng.choices("klm", k=600)) + part
    assert got(spark, [text, "x" * 300, part + "y"], 200) == brute([text, "x" * 300, part + "y"], 200)


def test_empty_table(spark):
    assert suffix_dedup(spark.createDataFrame([], "rid long, text string")).count() == 0


def test_clashing_columns(spark):
    text = "".join(random.Random(2).choices("abcdef", k=300))
    docs = spark.createDataFrame([(7, text, 1, 2, 3, "a", "b", "c"), (8, text + "x", 4, 5, 6, "d", "e", "f"), (9, None, 7, 8, 9, "g", "h", "i")], "rid long, text string, n_bytes int, N_Removed int, n_spans int, kept_sha256 string, kept_text string, spans string")
    prefix = free_prefix(docs)
    got = sorted(suffix_dedup(docs, prefix=prefix).collect())
    assert [tuple(r)[:7] for r in got] == [(7, 1, 2, 3, "a", "b", "c"), (8, 4, 5, 6, "d", "e", "f"), (9, 7, 8, 9, "g", "h", "i")]
    assert [(r[f"{prefix}n_removed"], r[f"{prefix}kept_text"]) for r in got] == [(300, ""), (300, "x"), (0, "")]
    replaced = suffix_dedup(docs)
    assert replaced.columns == ["rid", "spans", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept_text"] and replaced.count() == 3


def test_run_index_counts_patterns():
    rng = random.Random(11)
    for _ in range(100):
        segments = list({bytes(rng.choices(b"ab\xff\0", k=rng.randint(1, 30))) for _ in range(rng.randint(1, 5))})
        index = RunIndex(segments)
        assert int(index.run_lengths.sum()) == index.n and not hasattr(index, "order")
        for _ in range(10):
            p = bytes(rng.choices(b"ab\xff\0c", k=rng.randint(1, 4)))
            assert index.count(p) == sum(s[i : i + len(p)] == p for s in segments for i in range(len(s)))


def test_run_index_against_all_pairs():
    rng = random.Random(4)
    for _ in range(400):
        alphabet = rng.choice([b"ab", b"abcdef", b"a"])
        base = bytes(rng.choices(alphabet, k=60))
        segments = list({base[(a := rng.randint(0, 50)) : a + rng.randint(1, 40)] + bytes(rng.choices(alphabet, k=rng.randint(0, 6))) for _ in range(rng.randint(1, 6))})
        index = RunIndex(segments)
        stats = index.matching_statistics()
        places = [(s, i) for s in range(len(segments)) for i in range(len(segments[s]))]
        for s, i in places:
            best = 0
            for t, j in places:
                if (s, i) != (t, j):
                    a, b, k = segments[s][i:], segments[t][j:], 0
                    while k < min(len(a), len(b)) and a[k] == b[k]:
                        k += 1
                    best = max(best, k)
            assert stats[index.starts[s] + i] == best
