"""Counts of tokens against the library."""

import json
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from sievewright.llm import token_counts

WORDS, BYTES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("byte_bpe_50k.json")
ODD = [
    None, "", "   ", "日本 ﬁ é <|endoftext|> x<|startoftext|><|endoftext|>y", "<|ENDOFTEXT|> <|endoftext", "x" * 9_000, "ab" * 3_000, "aaaa" * 900,
    "Σας ΟΔΟΣ İstanbul é ́a", "don't I'LL we've 1234 ½ ²", " a b\x1cc\x85d", "퟿ \U0001f600‍\U0001f468", "the the the",
]


def texts():
    rng = random.Random(3)
    draw = lambda: chr(rng.choice([rng.randrange(32, 127), rng.randrange(160, 0x180), rng.randrange(0x180, 0xD800), rng.randrange(0xE000, 0x11000), 32]))
    words = ["".join(rng.choices("etaoinshrdluü", k=rng.randint(1, 12))) for _ in range(500)]
    return [*ODD, *("".join(draw() for _ in range(rng.randrange(1, 60))) for _ in range(500)), *(" ".join(rng.choices(words, k=rng.randint(1, 200))) for _ in range(100))]


def by_library(path, given):
    t = Tokenizer.from_file(path)
    return [len(t.encode(x or "", add_special_tokens=False).ids) for x in given]


@pytest.mark.parametrize("path", [WORDS, BYTES])
def test_counts_are_the_library_s(path):
    c = token_counts.TokenCounter(path)
    assert c.merges is not None and c.merges.together
    given = texts()
    assert c.counts(given) == by_library(path, given)
    assert c.counts(given) == by_library(path, given)  # from what is kept


def test_one_place_a_round_gives_the_same():
    c = token_counts.TokenCounter(WORDS)
    c.merges.together = False
    assert c.counts(texts()) == by_library(WORDS, texts())


def test_merges_whose_product_pairs_at_a_lower_rank(tmp_path):
    """ab is made by two merges, and pairs with c at a rank below the later one's: places of a round can't be merged together."""
    with open(BYTES, encoding="utf-8") as f:
        spec = json.load(f)
    letters = {c: i for i, c in enumerate(token_counts._byte_characters())}
    merges = [["a", "b"], ["abc", "a"], ["b", "c"], ["ab", "c"], ["a", "bc"]]
    for m in merges:
        letters.setdefault("".join(m), len(letters))
    spec["model"] |= {"vocab": letters, "merges": merges}
    spec["added_tokens"] = []
    path = tmp_path / "t.json"
    path.write_text(json.dumps(spec))
    c = token_counts.TokenCounter(str(path))
    assert c.merges is not None and not c.merges.together
    rng = random.Random(1)
    given = ["".join(rng.choices("abc", k=rng.randint(1, 30))) for _ in range(500)]
    assert c.counts(given) == by_library(str(path), given)


def test_long_texts_and_long_words(monkeypatch):
    given = [" ".join(t for t in texts() if t), "y" * 300 + " z"]
    want = by_library(WORDS, given)
    monkeypatch.setattr(token_counts, "GROUP", 50)
    monkeypatch.setattr(token_counts, "LONGEST", 6)
    monkeypatch.setattr(token_counts, "KEPT", 100)
    assert token_counts.TokenCounter(WORDS).counts(given) == want


def test_other_models_go_through_their_library():
    import sentencepiece

    path = public_tokenizers.path("piece_bpe_32k.model")
    lib = sentencepiece.SentencePieceProcessor(model_file=path)
    assert token_counts.TokenCounter(path).counts(ODD) == [len(lib.encode(t or "")) for t in ODD]


def test_rows(spark):
    given = [*ODD, "the the the"]
    rows = [(i, t, 7, "x", "y") for i, t in enumerate(given)] + [(None, "a b", 7, "x", "y")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, N_Tokens long, n_bytes string, other string").repartition(3)
    got = token_counts.count_tokens(docs, WORDS, limit=2)
    assert got.columns == ["doc_id", "other", "n_bytes", "n_tokens", "over_limit"]
    want = by_library(WORDS, given)
    found = {r.doc_id: r for r in got.collect()}
    assert found[None].n_tokens == 2
    for i, t in enumerate(given):
        assert (found[i].n_bytes, found[i].n_tokens, found[i].over_limit) == (len((t or "").encode()), want[i], want[i] > 2)
    assert token_counts.count_tokens(docs.limit(0), WORDS).count() == 0
