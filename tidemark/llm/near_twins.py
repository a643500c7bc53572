"""What became of characters, learned from near-twins: garbled phrases and clean ones that agree but for their non-ASCII parts.

A phrase is stripped of its non-ASCII characters; what stays is its ASCII text, the places of the others and which of them
are equal (``pattern``). A wrong decoding replaces byte by character, so a garbled phrase has the pattern of the clean one,
either of its characters (one single-byte set read as another) or of its UTF-8 bytes. Phrases are joined with the clean
phrase of their pattern - one representative a pattern, the most frequent, so no pairs within a group arise - and aligned
character by character. Replacements that several twins agree on are the learned mapping; no list of encodings is needed.

``applied`` puts the learned mapping on phrases without a twin, ``fluency`` tells whether a text reads more like the
vocabulary than another, by the mean logarithm of the frequency of its pairs of neighbouring characters.
"""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import cut, lookup_join
from .oddness import odd, telling

#: twins that must agree on a replacement, and the share of all twins of a sequence that they must be
SUPPORT, AGREEMENT = 2, 0.8
#: by how much more a restored text must read like the vocabulary: usual, and if the file was decoded with the same encoding
MARGIN, SAME_KEY_MARGIN = 1.0, 0.6


def units(text: str, utf8: bool) -> list[str]:
    """Characters; with ``utf8`` the bytes of those beyond ASCII."""
    if not utf8:
        return list(text)
    return [u for c in text for u in ([c] if c.isascii() else [chr(0x100 + b) for b in c.encode("utf-8", "surrogatepass")])]


def pattern(us: list[str]) -> str | None:
    """ASCII text with the places of all else, equal ones marked alike; None where it says too little: fewer than four ASCII
    letters, and not eight other characters with three repeats."""
    seen: dict[str, str] = {}
    out, letters, n = [], 0, 0
    for u in us:
        if u.isascii():
            letters += u.isalpha()
            out.append(u)
        else:
            n += 1
            out.append(seen.setdefault(u, chr(0xE000 + len(seen))))
    if not n or len(seen) > 6000:
        return None
    return "".join(out) if letters >= 4 or n >= 8 and n - len(seen) >= 3 else None


def _patterns(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = []
        for p, files, lines in zip(pdf["phrase"], pdf["n_files"], pdf["n_lines"]):
            o = odd(p)
            for utf8 in (False, True):
                if (k := pattern(units(p, utf8))) is not None:
                    rows.append((p, files, lines, o, utf8, k))
        yield pd.DataFrame(rows, columns=["phrase", "n_files", "n_lines", "odd", "utf8", "key"])


def near_twins(vocab: DataFrame) -> DataFrame:
    """``phrase, clean, utf8``: phrases and the likeliest clean phrase of their pattern, by characters or by UTF-8 bytes."""
    forms = cut(vocab.select("phrase", "n_files", "n_lines").mapInPandas(_patterns, "phrase string, n_files long, n_lines long, odd boolean, utf8 boolean, key string"))
    worth = F.struct(~F.col("odd"), "n_files", "n_lines", "phrase")
    best = forms.groupBy("key", "utf8").agg(F.max(worth).alias("w")).select("key", "utf8", F.col("w.phrase").alias("clean"), (~F.col("w.col1")).alias("clean_odd"), F.col("w.n_files").alias("cf"), F.col("w.n_lines").alias("cl"))
    best = best.where("not clean_odd")
    seen = forms.where("not utf8").drop("utf8")
    # text in capitals is clean text
    pairs = seen.join(best, "key").where("lower(phrase) <> lower(clean)")
    cleaner = (F.col("odd") & ~F.col("clean_odd")) | ((F.col("odd") == F.col("clean_odd")) & (F.struct("cf", "cl") > F.struct("n_files", "n_lines")))
    return pairs.where(cleaner).select("phrase", "clean", "utf8")


def aligned_pair(phrase: str, clean: str, utf8: bool) -> list[tuple[str, str]]:
    """(garbled sequence, character) of two phrases of one pattern, in order, each once."""
    out, at = {}, 0
    for c in clean:
        n = len(c.encode("utf-8", "surrogatepass")) if utf8 and not c.isascii() else 1
        g = phrase[at : at + n]
        at += n
        if not c.isascii():
            out[g] = c
    return list(out.items())


def kind(g: str, c: str) -> str:
    """What a replacement turns into what: replacements of one decoding have one kind."""
    name = lambda x: unicodedata.name(x, "?").split(" ")[0] if unicodedata.category(x)[0] == "L" else "-"
    return f"{name(g[0])}>{name(c)}"


def _align(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    for pdf in batches:
        rows = [(p, v, u, g, c, kind(g, c)) for p, v, u in zip(pdf["phrase"], pdf["clean"], pdf["utf8"]) for g, c in aligned_pair(p, v, u)]
        yield pd.DataFrame(rows, columns=["phrase", "clean", "utf8", "sequence", "became", "kind"])


def replacements(pairs: DataFrame) -> DataFrame:
    """``phrase, clean, utf8, sequence, became, kind``: the near-twins character by character."""
    return pairs.mapInPandas(_align, "phrase string, clean string, utf8 boolean, sequence string, became string, kind string")


def mappings(cells: DataFrame) -> DataFrame:
    """``utf8, kind, sequence, became, support``: the replacements that enough near-twins agree on. Which of two twins is the
    clean one may be wrong for some, so a replacement must also be much more frequent than its reverse."""
    votes = cells.groupBy("utf8", "kind", "sequence", "became").agg(F.countDistinct("phrase").alias("support"))
    best = votes.groupBy("utf8", "kind", "sequence").agg(F.max(F.struct("support", "became")).alias("b"), F.sum("support").alias("all"))
    good = (F.col("b.support") >= SUPPORT) & (F.col("b.support") >= AGREEMENT * F.col("all"))
    kept = best.where(good).select("utf8", "kind", "sequence", F.col("b.became").alias("became"), F.col("b.support").alias("support"))
    back = votes.select("utf8", F.col("sequence").alias("became"), F.col("became").alias("sequence"), F.col("support").alias("reverse")).groupBy("utf8", "sequence", "became").agg(F.sum("reverse").alias("reverse"))
    return kept.join(back, ["utf8", "sequence", "became"], "left").where("sequence = became or support > 2 * coalesce(reverse, 0)").drop("reverse")


def confirmed(cells: DataFrame, learned: DataFrame) -> DataFrame:
    """``phrase, restored``: near-twins of which at least half of the replacements, and two, are learned ones and none goes against them."""
    known = learned.select("utf8", "kind", "sequence", F.col("became").alias("taught"))
    met = lookup_join(cells.where("sequence <> became"), known, ["utf8", "kind", "sequence"], "left", salt_by=F.col("phrase"))
    agree, against = F.count_if(F.col("taught") == F.col("became")), F.count_if(F.col("taught") != F.col("became"))
    by_pair = met.groupBy("phrase", "clean", "utf8").agg(agree.alias("agree"), against.alias("against"), F.count("*").alias("all"))
    fine = by_pair.where("against = 0 and agree >= 2 and agree * 2 >= all")
    return fine.groupBy("phrase").agg(F.max_by("clean", F.struct("agree", "clean")).alias("restored"))


def _apply(table: list[tuple[bool, str, str, str]]):
    by_role: dict[bool, dict[str, dict[str, str]]] = {False: {}, True: {}}
    for utf8, k, g, c in table:
        by_role[utf8].setdefault(k, {})[g] = c

    def restored(p: str, maps: dict[str, str], longest: int) -> str | None:
        out, at, changed = [], 0, False
        while at < len(p):
            if p[at].isascii():
                out.append(p[at])
                at += 1
                continue
            for n in range(min(longest, len(p) - at), 0, -1):
                c = maps.get(p[at : at + n])
                if c is not None:
                    changed |= c != p[at : at + n]
                    out.append(c)
                    at += n
                    break
            else:
                return None
        return "".join(out) if changed else None

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for p in pdf["phrase"]:
                o = odd(p)
                for utf8, kinds in by_role.items():
                    plain = {g: c for k, m in kinds.items() if k.startswith("-") or k.endswith("-") for g, c in m.items()}
                    for k, m in kinds.items():
                        maps = plain | m
                        v = restored(p, maps, max(map(len, maps)))
                        if v is not None and not odd(v):
                            tells = utf8 and any(g in p and telling(p, g) for g in maps if len(g) > 1)
                            rows.append((p, v, f"learned {'utf8' if utf8 else 'single'} {k}", o, tells))
            yield pd.DataFrame(rows, columns=["phrase", "restored", "chain", "odd", "telling"])

    return run


def applied(vocab: DataFrame, learned: DataFrame) -> DataFrame:
    """``phrase, restored, chain, odd, telling``: what the learned mapping makes of the phrases it covers whole.

    The mapping is sent to the tasks: it has at most one row a garbled sequence, so at most a few for each character there is.
    """
    table = [(r["utf8"], r["kind"], r["sequence"], r["became"]) for r in learned.select("utf8", "kind", "sequence", "became").collect()]
    return vocab.select("phrase").mapInPandas(_apply(table), "phrase string, restored string, chain string, odd boolean, telling boolean")


def _pairs(text):
    low = F.concat(F.lit("\u0002"), F.lower(text), F.lit("\u0003"))
    return F.transform(F.sequence(F.lit(1), F.length(low) - 1), lambda i: F.substr(low, i, F.lit(2)))


def fluency(clean: DataFrame, candidates: DataFrame) -> DataFrame:
    """``phrase, restored, gain``: how much more the restored text reads like the phrases of ``clean`` than the phrase itself
    does, in the mean logarithm over pairs of neighbours. A pair counts once a phrase and file, so that one long garbled file
    says little; one file of the phrase itself is left out."""
    # as many rows as there are different pairs of neighbouring characters
    counts = cut(clean.select("n_files", F.explode(F.array_distinct(_pairs(F.col("phrase")))).alias("pair")).groupBy("pair").agg(F.sum("n_files").alias("n")))
    rows = candidates.select("phrase", "restored").distinct()
    side = lambda c: rows.select("phrase", "restored", F.lit(c).alias("side"), F.explode(_pairs(F.col(c))).alias("pair"))
    met = lookup_join(side("phrase").unionByName(side("restored")), counts, ["pair"], "left", salt_by=F.col("phrase"))
    log = F.log(F.greatest(F.coalesce("n", F.lit(0)) - F.when(F.col("side") == "phrase", 1).otherwise(0), F.lit(0)) + 0.1)
    mean = lambda c: F.avg(F.when(F.col("side") == c, log))
    return met.groupBy("phrase", "restored").agg((mean("restored") - mean("phrase")).alias("gain"))
