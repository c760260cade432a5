import random

import pytest

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"
SYLLABLES = "th an er on re he in ed nd ha at en es or nt ea ti to io le is ou ar as de rt ve".split()
COMMON = "the of and to in is that for it with on be".split()


def sentence(rng, count):
    words = [
        rng.choice(COMMON) if rng.random() < 0.4 else "".join(rng.choices(SYLLABLES, k=rng.randint(2, 4)))
        for _ in range(count)
    ]
    return " ".join(words).capitalize() + "."


def prose(rng, count):
    return " ".join(sentence(rng, min(12, count - at)) for at in range(0, count, 12))


def corpus_rows():
    """Texts of all kinds: prose, copies, near copies, shared passages, junk, blanks, nulls, ties, a long text."""
    rng = random.Random(5)
    texts = [prose(rng, rng.randint(1, 260)) for _ in range(60)]
    passage = prose(rng, 70)
    for _ in range(8):
        texts.append(prose(rng, rng.randint(5, 80)) + "\n" + passage + "\n" + prose(rng, rng.randint(5, 80)))
    original = prose(rng, 220)
    for _ in range(12):
        words = original.split(" ")
        for _ in range(rng.randint(0, 3)):
            words[rng.randrange(len(words))] = "".join(rng.choices(SYLLABLES, k=3))
        texts.append(" ".join(words))
    texts += [texts[3], texts[3], texts[7].upper(), original, original]
    short = "one two three four five six seven eight nine ten eleven twelve".split()
    texts += [" ".join(short[:k]) for k in range(1, 13)] + [" ".join(short), " ".join(short[1:])]
    texts += ["", " \t\n", "\x0b\x0c", "Ünïcödé wörds ß Ａ   em space", "a" * 3000, "ab " * 400, "x\n" * 300]
    texts += [prose(rng, 30) + "%%% $$$ ### " * 40, "line one here\n" * 30, prose(rng, 2500)]
    rows = [(i, t, ("en", "de", None, "xx")[i % 4], f"s{i % 5}", len(t)) for i, t in enumerate(texts)]
    rows += [(500, None, "en", "s0", None), (501, None, None, None, None), (None, texts[3], "en", None, 1)]
    rows += [(None, None, None, None, None), (None, prose(rng, 90), "fr", "s1", 1)]
    rows += [rows[10], rows[10], rows[20], (20, texts[21], "en", "s2", 5)]
    return rows


@pytest.fixture(scope="session")
def rows():
    return corpus_rows()


@pytest.fixture(scope="session")
def docs(spark, rows):
    """The texts in several partitions, with columns whose names operators use themselves."""
    df = spark.createDataFrame(rows, COLUMNS).repartition(5)
    return df.selectExpr(
        "*", "1 as size", "2 as copies", "'k' as kept", "3 as n_words", "4 as component_id", "5 as shard", "6 as `a.b`",
        "7 as rank", "8 as h", "9 as start",
    )


@pytest.fixture(scope="session")
def nothing(spark):
    return spark.createDataFrame([], COLUMNS)
