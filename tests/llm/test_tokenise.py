"""Token ids against two independent tokenizers, and round trips."""

import random

import pytest

from tidemark.llm.tokenise import PATTERN, VOCABULARY, Encoder, load_ranks, replay, token_ids

TEXTS = ["", "a" * 1000, "aaaa bbbb <|endoftext|> x", " \n\n  \t x", "　全角\x85nbsp\xa0x", "it's we'LL 'Ve", "🙂" * 50, " " * 300 + "x", "\x1c\x1d a\x00b", "Größe überschritten — ½", "ошибка записи", "接続が切断されました", "x\r\ny\r\n", "‮abc‬", "0123456789" * 30, "def f(x):\n    return x ** 2\n"]


@pytest.fixture(scope="module")
def ranks():
    return load_ranks()


def test_agrees_with_tiktoken(ranks):
    import tiktoken

    ref = tiktoken.Encoding("own", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    rng = random.Random(3)
    texts = TEXTS + ["".join(rng.choice("ab cé\n1.,'") for _ in range(rng.randrange(200))) for _ in range(200)]
    assert Encoder(ranks).encode(texts) == [ref.encode_ordinary(t) for t in texts]


def test_agrees_with_tokenizers(ranks):
    tokenizers = pytest.importorskip("tokenizers")
    t = tokenizers.Tokenizer.from_file(VOCABULARY.replace(".tiktoken", ".json"))
    t.encode_special_tokens = True
    assert Encoder(ranks).encode(TEXTS) == [e.ids for e in t.encode_batch(TEXTS, add_special_tokens=False)]


def test_replay_agrees_with_plain_merging(ranks):
    def plain(w):
        parts = [w[i : i + 1] for i in range(len(w))]
        while True:
            best = min(((ranks[a + b], i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in ranks), default=None)
            if best is None:
                return [ranks[p] for p in parts]
            i = best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    rng = random.Random(4)
    words = [bytes(rng.choice(b"abe th\xc3\xa9") for _ in range(rng.randrange(40))) for _ in range(300)] + [b"aaaaaaa", b"", b"abababab"]
    assert replay(words, ranks) == [plain(w) for w in words]


def test_tables(spark, ranks):
    rows = [(1, "a b"), (2, ""), (3, None), (1, "a b"), (4, "y" * 200000), (None, "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string").selectExpr("doc_id", "text", "'clash' as ids", "1 as n_tokens")
    got = token_ids(df, keep=["doc_id"]).collect()
    by = {v: k for k, v in ranks.items()}
    assert len(got) == 6 and all(b"".join(by[i] for i in r["ids"]).decode() == dict(rows)[r["doc_id"]] if dict(rows)[r["doc_id"]] else r["ids"] == [] for r in got)
    assert sum(r["n_tokens"] for r in token_ids(df, keep=["doc_id"], counts_only=True).collect()) == sum(len(r["ids"]) for r in got)
    assert token_ids(df.limit(0), keep=["doc_id"]).count() == 0
