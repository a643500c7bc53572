"""Problem 7: the whole corpus as token ids of a public byte-level BPE vocabulary.

Merge replay over a corpus of words: a task splits its texts into words, and for the distinct words it has not met yet
builds an inverted index from token pair to the places where the pair stands. Merges are applied in rank order over all
these words at once; each merge touches only the neighbours of its places. Texts are never shuffled.

Defined results: null and empty texts give an empty list; the written form of a special token is ordinary text; texts
are whole, of any length; lone surrogates are encoded as the replacement character; repeated rows stay as they are.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table

#: where the public vocabulary lies; a parameter, nothing is copied
VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the published splitting pattern of the vocabulary.
PATTERN = r"'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
#: distinct words a task remembers; beyond it the memory starts afresh (results do not depend on it)
REMEMBERED = 400_000


def load_ranks(path: str = VOCABULARY) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


def replay(words: list[bytes], ranks: dict[bytes, int]) -> list[list[int]]:
    """Token ids of every word by applying all merges in rank order over the words at once."""
    # one flat list of tokens; nxt/prv are the neighbours within a word, -1 at its ends
    tok: list[bytes] = []
    nxt: list[int] = []
    prv: list[int] = []
    starts = []
    for w in words:
        a, n = len(tok), len(w)
        starts.append(a)
        if not n:
            continue
        tok.extend(w[i : i + 1] for i in range(n))
        nxt.extend(range(a + 1, a + n))
        nxt.append(-1)
        prv.append(-1)
        prv.extend(range(a, a + n - 1))
    places: dict[tuple[bytes, bytes], set[int]] = {}
    heap: list[tuple[int, bytes, bytes]] = []

    def note(i: int) -> None:
        pair = (tok[i], tok[nxt[i]])
        at = places.get(pair)
        if at is None:
            r = ranks.get(pair[0] + pair[1])
            if r is None:
                return
            places[pair] = at = set()
            heapq.heappush(heap, (r, *pair))
        at.add(i)

    for i, j in enumerate(nxt):
        if j >= 0:
            note(i)
    while heap:
        _, a, b = heapq.heappop(heap)
        at = places.pop((a, b))
        both = a + b
        # left to right, so that of overlapping places the first wins
        for i in sorted(at):
            j = nxt[i]
            if tok[i] != a or j < 0 or tok[j] != b:
                continue
            left, right = prv[i], nxt[j]
            if left >= 0 and (s := places.get((tok[left], a))):
                s.discard(left)
            if right >= 0 and (s := places.get((b, tok[right]))):
                s.discard(j)
            tok[i], tok[j] = both, b""
            nxt[i] = right
            if right >= 0:
                prv[right] = i
            if left >= 0:
                note(left)
            if right >= 0:
                note(i)
    out = []
    for a, w in zip(starts, words):
        ids, i = [], a
        while w and i >= 0:
            ids.append(ranks[tok[i]])
            i = nxt[i]
        out.append(ids)
    return out


class Encoder:
    """Encodes texts batch by batch and remembers words."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import regex

        self.ranks, self.find, self.known = ranks, regex.compile(PATTERN).findall, {}

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        split = [self.find(t) if t else [] for t in texts]
        if len(self.known) > REMEMBERED:
            self.known.clear()
        new = list({w for ws in split for w in ws if w not in self.known})
        done = replay([w.encode("utf-8", "replace") for w in new], self.ranks)
        self.known.update(zip(new, done))
        known = self.known
        return [[i for w in ws for i in known[w]] for ws in split]


def token_ids(df: DataFrame, text: str = "text", keep: list[str] | None = None, path: str = VOCABULARY, counts_only: bool = False) -> DataFrame:
    """``keep`` columns and ``ids array<int>`` of column ``text`` (or ``n_tokens long``). Other columns are not read."""
    keep = keep if keep is not None else [c for c in df.columns if c != text and c not in ("ids", "n_tokens")]
    ranks = df.sparkSession.sparkContext.broadcast(load_ranks(path))  # a vocabulary: fixed size

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        enc = Encoder(ranks.value)
        for pdf in batches:
            step = 256
            for a in range(0, len(pdf), step):
                part = pdf.iloc[a : a + step]
                ids = enc.encode([t if isinstance(t, str) else None for t in part["__text"]])
                out = part[keep].copy()
                if counts_only:
                    out["n_tokens"] = [len(x) for x in ids]
                else:
                    out["ids"] = ids
                yield out

    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.select(*keep).schema.fields)
    slim = df.select(*keep, F.col(text).alias("__text"))
    return slim.mapInPandas(run, f"{kinds}, " + ("n_tokens long" if counts_only else "ids array<int>"))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, ids``: the token ids of every document by byte_bpe_50k."""
    return token_ids(table(spark, sf_dir, "documents"), keep=["doc_id"])
