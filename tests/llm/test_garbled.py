"""Garbled text: planted decodings are found and restored, clean text in any script is left alone."""

import random

from pyspark.sql import functions as F

from tidemark.llm import near_twins
from tidemark.llm.garbled import Codecs, _became, garbled_lines, odd, restored_lines, undone, vocabulary

CLEAN = ["conexão recusada", "Größe überschritten", "ошибка записи в журнал", "ПОВТОР ОПЕРАЦИИ", "łącze zostało zamknięte", "接続が切断されました", "연결이 끊어졌습니다", "€12 · £9", "° → ✓", "déjà fermé", "¿índice dañado?"]


def wrong(text, e, d):
    c = Codecs()
    data = c.encode(text, e)
    return None if data is None else c.decode(data, d)


def corpus():
    rng = random.Random(7)
    rows, want = [], {}
    for f in range(40):
        for i in range(30):
            p = rng.choice(CLEAN)
            rows.append((f"f{f}", i, f"2026 job {rng.randrange(999)} {p}: done"))
    ways = [("utf8", "windows1252"), ("utf8", "koi8r"), ("utf8", "windows1251"), ("koi8r", "windows1251"), ("windows1251", "windows1252"), ("iso88592", "windows1252"), ("euckr", "windows1252"), ("shiftjis", "windows1252"), ("utf8", "gb18030")]
    n = 1000
    for e, d in ways:
        for p in CLEAN:
            g = wrong(p, e, d)
            if g is None or g == p or g.isascii():
                continue
            n += 1
            rows.append((f"g{n % 5}", n, f"2026 job 1 {g}: done"))
            want["g" + str(n % 5), n] = (f"2026 job 1 {p}: done")
    return rows, want


def test_planted_decodings(spark):
    rows, want = corpus()
    df = spark.createDataFrame(rows + rows[:9], "file string, line_no long, text string").withColumn("phrase", F.lit("clash")).withColumn("restored", F.lit("clash"))
    got = {(r["file"], r["line_no"]): r["restored"] for r in restored_lines(df).collect()}
    assert set(got) == set(want)
    assert sum(got[k] == want[k] for k in want) >= 0.95 * len(want)


def test_repeated_and_partial(spark):
    twice = wrong(wrong("Größe überschritten", "utf8", "windows1252"), "utf8", "windows1252")
    rows = [(f"f{i}", j, f"x {p}") for i in range(9) for j, p in enumerate(CLEAN)]
    rows += [("g", 100, "x " + twice), ("g", 101, "x Größe " + wrong("überschritten", "utf8", "windows1252")), ("g", 102, "x d�j�"), ("g", 103, None), ("g", 104, "ascii"), (None, 1, "x " + twice), ("g", None, "x " + twice), ("g", 105, "é" * 20000)]
    df = spark.createDataFrame(rows, "file string, line_no long, text string")
    assert {r["line_no"] for r in garbled_lines(df).collect()} == {100, 101, 102}
    got = {r["line_no"]: (r["restored"], r["whole"]) for r in restored_lines(df).collect()}
    assert got[100] == got[101] == ("x Größe überschritten", True) and got[102][1] is False
    assert garbled_lines(df.limit(0)).count() == 0


def test_odd_and_undone():
    assert not any(odd(p) for p in CLEAN) and not odd("ΔT") and not odd("«spool»")
    assert all(odd(x) for x in ("naГЇve", "f�r", "уЕБОУ", "\x90Ú", "Größ¬e"))
    assert ("windows1252>utf8", "für", 1) in undone("fÃ¼r", Codecs())


def test_alignment(spark):
    assert _became("GrÃ¶ÃŸe", "Größe", "windows1252>utf8", Codecs()) == {"Ã¶": "ö", "ÃŸ": "ß"}
    assert near_twins.aligned_pair("GrÃ¶ÃŸe da", "Größe da", True) == [("Ã¶", "ö"), ("ÃŸ", "ß")]
    assert near_twins.pattern(list("für uns")) == near_twins.pattern(list("fьr uns")) != near_twins.pattern(list("fur ünt")) and near_twins.pattern(list("né")) is None
    v = vocabulary(spark.createDataFrame([("a", 'msg="für x": é, é'), ("b", "für x"), (None, None)], "file string, text string"))
    doc = spark.createDataFrame([("a", "utf8", None), ("b", "koi8r", "utf8"), (None, "x", "y")], "file string, detected string, encoding_override string")
    w = vocabulary(spark.createDataFrame([("a", "für"), ("b", "für"), ("c", "für")], "file string, text string"), doc)
    assert [(r["n_files"], r["keys"]) for r in w.collect()] == [(3, ["utf8"])]
    assert {(r["phrase"], r["n_files"], r["n_lines"]) for r in v.collect()} == {("für", 2, 2), ("é", 1, 2)}


def test_learned_characters_decide_single_sequences(spark):
    rows = [(f"f{i}", j, f"x {p}") for i in range(9) for j, p in enumerate([*CLEAN, "DÉJÀ «FERMÉ»", "Рёв", "AMANHÃ»", "AMANHÃ…"])]
    rows += [("g", 100, "x " + wrong("déjà fermé", "utf8", "windows1252")), ("g", 101, "x Ã©tat"), ("g", 102, "x Ã©tat."), ("g", 103, "x (Ã©tat)")]
    got = {r["line_no"]: r["restored"] for r in restored_lines(spark.createDataFrame(rows, "file string, line_no long, text string")).collect()}
    assert got == {100: "x déjà fermé", 101: "x état", 102: "x état.", 103: "x (état)"}


def test_decodings_repeated_often_or_in_mixed_ways(spark):
    often = "Größe überschritten"
    for _ in range(5):
        often = wrong(often, "utf8", "windows1252")
    mixed = wrong(wrong("Ошибка Записи", "koi8r", "windows1251"), "utf8", "windows1252")
    df = spark.createDataFrame([("g", 1, "x " + often), ("g", 2, "x " + mixed)], "file string, line_no long, text string")
    assert {r["line_no"]: r["restored"] for r in restored_lines(df).collect()} == {1: "x Größe überschritten", 2: "x " + mixed}  # not certain which single-byte encoding it was


RUSSIAN = """ошибка записи в журнал; соединение с сервером потеряно; файл настроек не найден; повтор операции через минуту; очередь сообщений переполнена
контрольная точка сохранена; сегмент журнала повреждён; время ожидания истекло; доступ к разделу запрещён; перестроение индекса завершено; узел отключён от сети
не удалось открыть файл данных; свободное место на диске закончилось; запрос отменён пользователем; сервер перезапущен после сбоя; проверка целостности данных
резервная копия создана успешно; неверный формат строки запроса; сессия закрыта по таймауту; кэш очищен и перестроен; слишком много открытых соединений""".replace("\n", ";").split(";")


def _other_file(spark, e, d):
    """One file's phrases have clean twins; another file, decoded the same wrong way, has phrases that stand nowhere else."""
    said = [p.strip() for p in RUSSIAN]
    # every letter of the new phrases stands in two of the known ones, as the mapping needs the support of two twins
    known, new = said[:20], ["сервер остановлен после ошибки", "не удалось создать раздел журнала", "повтор запроса отменён", "доступ к данным восстановлен"]
    rows = [(f"f{i % 9}", i, f"2026 job {i}: {p}") for i, p in enumerate(said * 3)]
    bad = lambda p: p.encode(e).decode(d)
    rows += [("g", 1000 + i, f"2026 job {i}: {bad(p)}") for i, p in enumerate(known)]
    rows += [("h", 2000 + i, f"2026 job {i}: {bad(p)}") for i, p in enumerate(new)]
    rows += [("k", 3000 + i, f"2026 job {i}: {p.upper()}") for i, p in enumerate(said)]
    got = {r["line_no"]: r["restored"] for r in restored_lines(spark.createDataFrame(rows, "file string, line_no long, text string")).collect()}
    return got, {1000 + i: f"2026 job {i}: {p}" for i, p in enumerate(known)} | {2000 + i: f"2026 job {i}: {p}" for i, p in enumerate(new)}


def test_what_twins_teach_decides_files_without_twins(spark):
    got, want = _other_file(spark, "koi8_r", "cp1251")
    assert got == want


def test_encodings_outside_the_list_are_learned_by_alignment(spark):
    got, want = _other_file(spark, "cp1251", "iso8859_5")
    assert got == want
