"""Text statistics: independent of chunking, right on known kinds of text."""

import random

import pytest
from pyspark.sql import functions as F

from tidemark.llm.quality import counts, merged, packed, running, closed, part, state, statistics, totals, unpacked

PROSE = [
    "The reason was a session that had been cut in the middle. Nobody had noticed that it was writing twice.",
    "hi all, since the update the session is slow again, any idea why\nthanks, that did it, you can close this",
    "Wir haben den Grund dafür erst am nächsten Tag gefunden. Die Suche dauert jetzt weniger als eine Sekunde.",
    "La búsqueda en los archivos tarda menos de un segundo, como muestra el informe.",
    "Никто не заметил, что часы на узле отстают, и то же самое верно для поиска.",
    "時計がずれていると順序も正しくなりません。原因は翌日になってから見つかりました。",
    "Kami menemukan penyebabnya pada hari berikutnya, dan hal yang sama berlaku untuk mesin ini.",
]
JUNK = [
    "free quota merge ledger archive session log viewer ledger archive merge viewer",
    "bookmark, dump, log, tail, quota, dump, queue, ledger, archiver",
    "2026-06-24 19:27:30 WARN gateway user u4715 asked for the top 2 of it\n2026-06-24 19:27:31 INFO tls it was in the cache",
    "| host | lines |\n|---|---|\n| core-4 | 52508 |",
    "edge-08\t10751\t34.59\tdown\t22:09\nedge-21\t27458\t76.18\tdown\t14:11",
    "00000000  2b f5 b2 35 35 47 1a d3\n00000010  15 cf 82 70 3e 1b af bb",
    "gateway.mode = true\nstore.max = 64",
    "1) compactor drain\n2. store verify\n3. replica drain",
    "VOqTIUMc4sBPDsSWQ1t+SjvMnZFgEhQAbn0aAih0lC0AYtGfbOhWvbdQ8qq/rM6Cm0SRhMJh",
    "=-=-=-=-=-=\n*********\n~#~#~#",
    "end of the file\n" * 40,
    "261, 92274.08, 0, 46709.81, 9.733, 2.6",
]


def share(t):
    c = totals(state(t))
    return c["running"] / c["solid"]


@pytest.mark.parametrize("t", PROSE)
def test_prose(t):
    assert share(t) >= 0.9


@pytest.mark.parametrize("t", JUNK)
def test_junk(t):
    assert share(t) < 0.3


def test_chunks_change_nothing():
    rng = random.Random(5)
    texts = PROSE + JUNK + ["\r\n".join(PROSE), "\r".join(JUNK), "\n\n \n", "x" * 500, " a  b\t\tc ", "　é\x85x y"] + ["".join(rng.choice("ab .\r\n\t1é|") for _ in range(80)) for _ in range(60)]
    for t in texts:
        for k in (1, 2, 5, 33):
            states = [state(t[a : a + k]) for a in range(0, len(t), k)]
            while len(states) > 1:  # any grouping
                i = rng.randrange(len(states) - 1)
                states[i : i + 2] = [unpacked(packed(merged(states[i], states[i + 1])))]
            assert totals(states[0]) == totals(state(t)), (t, k)


def test_tables(spark):
    rows = [(1, PROSE[0]), (2, JUNK[0]), (3, None), (4, ""), (5, " \n\t"), (6, "\n".join(PROSE * 3)), (7, "z" * 5000), (2, JUNK[0])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("lines", F.lit("clash")).withColumn("at", F.lit("clash"))
    got = {r["doc_id"]: r["prose"] for r in statistics(df).collect()}
    assert got == {1: True, 2: False, 4: None, 5: None, 6: True, 7: False}
    small = {tuple(r) for r in counts(df, chunk=64).collect()}
    assert small == {tuple(r) for r in counts(df).collect()}
    assert statistics(df.limit(0)).count() == 0
    assert running(closed(part("the end of it."))) and not running(closed(part("")))


@pytest.mark.parametrize("n", [3, 6, 8, 40, 2000])
def test_repeated_lines_of_any_length(n):
    """A line of running text 40 times is boilerplate, be it short or long."""
    line = " ".join(["the reason was that it had been cut in the middle of it"] * n)
    assert share("\n".join([line] * 40)) == pytest.approx(3 / 40)
    assert share("\n".join(f"{i} {line}" for i in range(40))) == 1.0


@pytest.mark.parametrize("n", [1, 40, 60, 70, 500])
def test_settings_and_structure_behind_any_prefix(n):
    """A key with one word behind it is a setting however long the word is; with prose behind it, it is none."""
    word = "https://" + "a" * n
    assert not running(closed(part(f"See: {word}")))
    assert not running(closed(part(f"See {word}=")))
    assert running(closed(part(f"See: {word} it explains why the session was cut in the middle of it")))
    assert not running(closed(part(" " * n + "2026-06-24 19:27:30 WARN gateway asked for the top of it in the cache")))
    assert not running(closed(part(" " * n + "| it was in the cache | and so was the other one |")))


@pytest.mark.parametrize("chunk", [64, 1 << 16])
def test_long_texts_in_chunks(spark, chunk):
    """Repeated rows are one row at any length; a text's chunks and lines over their borders count as those of the whole."""
    line = " ".join(["the reason was that it had been cut in the middle of it"] * 9)
    texts = ["\n".join([line] * 300), " ".join([line] * 300), "short but whole, and it was in the cache.", "\n".join(f"{line} {i % 7}" for i in range(400))]
    rows = [(i, t) for i, t in enumerate(texts)] * 2 + [(None, texts[0]), (7, texts[0])]
    got = {tuple(r) for r in counts(spark.createDataFrame(rows, "doc_id long, text string"), chunk=chunk).collect()}
    want = {(i, *totals(state(t)).values()) for i, t in [*enumerate(texts), (None, texts[0]), (7, texts[0])]}
    assert got == want
