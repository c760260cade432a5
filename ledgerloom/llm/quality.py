"""Quality rules: how far a document's characters and common words are from those of its language."""

from __future__ import annotations

from collections.abc import Mapping
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ledgerloom.llm.common import words_of
from ledgerloom.sources.shared import stage

#: Frequent words of each language. Words of several languages count for each.
COMMON_WORDS = {
    "de": "der die das und ist von mit den ein zu im nicht auf des für".split(),
    "en": "the of and to a in is that for it as with was on be".split(),
    "es": "el la de que y en los del las por un para con una es".split(),
    "fr": "le la de et les des en un du une que est pour dans par".split(),
}
#: Classes of characters, as patterns. Blanks are a further class, and what no class takes is the last.
CLASSES = {
    "upper": "[A-Z]+",
    "digit": "[0-9]+",
    "stop": r"[.,;:!?'()\x22-]+",
    "symbol": "[#*$%&|<>]+",
    "far": r"[^\x00-\x7F]+",
}


@dataclass(frozen=True)
class Rules:
    """Limits of the Jensen-Shannon distances (0 to 1), and how long a text must be for each to be judged."""

    max_char_distance: float = 0.30
    max_word_distance: float = 0.27
    min_chars: int = 200
    min_words: int = 100
    languages: Mapping[str, list[str]] = field(default_factory=lambda: COMMON_WORDS)


def _window_hashes(words: Column) -> Column:
    """Hashes of the 3-word windows, in order. 64 bits: equal hashes of different windows of one text are as good as
    impossible (1e-11 for 20,000 words)."""
    return F.when(
        F.size(words) >= 3,
        F.transform(
            F.sequence(F.lit(0), F.size(words) - 3),
            lambda i: F.xxhash64(F.get(words, i), F.get(words, i + 1), F.get(words, i + 2)),
        ),
    ).otherwise(F.array().cast("array<bigint>"))


def _sum(counts: Column) -> Column:
    return F.aggregate(counts, F.lit(0).cast("bigint"), lambda a, b: a + b)


def _with_rest(counts: Column, total: Column) -> Column:
    """The counts, and what they leave of the total."""
    return F.concat(counts, F.array(total - _sum(counts)))


def _hits(common: Column, words: list[str]) -> Column:
    return F.size(F.filter(common, lambda w: w.isin(*words)))


def _language(lang: Column, common: Column, rules: Rules) -> Column:
    """The document's language if the rules know it, else the one with most of its common words (ties: the first)."""
    scored = [F.struct(_hits(common, rules.languages[code]).alias("n"), F.lit(code).alias("code"))
              for code in sorted(rules.languages, reverse=True)]
    best = F.element_at(F.array_sort(F.array(*scored), lambda a, b: a["n"] - b["n"]), -1)["code"]
    return F.when(lang.isin(*rules.languages), lang).otherwise(best)


def measures(df: DataFrame, rules: Rules | None = None, text: str = "text", lang: str = "lang") -> DataFrame:
    """The input with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed and two histograms:
    `char_counts` (one count for each class of characters, blanks, the rest) and `word_counts` (one for each common
    word of the language that it is `compared_with`, then all other words).

    All of it is computed row by row with built-in functions; no row leaves its partition. A null text counts as
    empty: no words, all counts 0. Columns of the input by these names are replaced.
    """
    rules = rules or Rules()
    body, words, lines = F.col("_body"), F.col("_words"), F.col("_lines")
    every = sorted({word for words in rules.languages.values() for word in words})
    longest = max(len(word.encode()) for word in every)
    rows = (
        df.withColumn("_body", F.coalesce(F.col(text), F.lit("")))
        .withColumn("_words", words_of(body))
        .withColumn("_lines", F.filter(F.split(body, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]")))
        .withColumn("_windows", _window_hashes(words))
        .withColumn("_again", F.size(F.array_distinct("_windows")) < F.size("_windows"))
        # Only texts with a repeated window are sorted.
        .withColumn(
            "_sorted",
            F.when(
                F.col("_again"),
                F.sort_array(F.transform("_windows", lambda h, i: F.struct(h.alias("h"), i.alias("i")))),
            ),
        )
        .withColumn(
            "_starts",
            F.when(
                F.col("_again"),
                F.sort_array(
                    F.transform(
                        F.filter(
                            F.transform(
                                "_sorted",
                                lambda w, k: F.struct(
                                    w["i"].alias("i"),
                                    (
                                        F.coalesce(F.get("_sorted", k - 1)["h"] == w["h"], F.lit(False))
                                        | F.coalesce(F.get("_sorted", k + 1)["h"] == w["h"], F.lit(False))
                                    ).alias("again"),
                                ),
                            ),
                            lambda w: w["again"],
                        ),
                        lambda w: w["i"],
                    )
                ),
            ),
        )
    )
    covered = F.aggregate(
        "_starts",
        F.struct(F.lit(0).alias("end"), F.lit(0).cast("bigint").alias("total")),
        lambda state, at: F.struct(
            (at + F.lit(3)).alias("end"),
            (state["total"] + (at + F.lit(3) - F.greatest(at, state["end"]))).cast("bigint").alias("total"),
        ),
        lambda state: state["total"],
    )
    length = F.length(body).cast("bigint")
    taken = {
        name: (length - F.length(F.regexp_replace(body, pattern, ""))).cast("bigint").alias(name)
        for name, pattern in CLASSES.items()
    }
    common, used = F.col("_common"), F.col("compared_with")
    counts = F.lit(None).cast("array<bigint>")
    for code, own in rules.languages.items():
        of_words = [(F.size(common) - F.size(F.array_remove(common, word))).cast("bigint") for word in own]
        counts = F.when(used == code, F.array(*of_words)).otherwise(counts)
    rows = (
        rows.withColumn("n_words", F.size("_words").cast("bigint"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("bigint"))
        .withColumn("n_dup_lines", (F.size(lines) - F.size(F.array_distinct(lines))).cast("bigint"))
        .withColumn("n_repeat_words", F.coalesce(covered, F.lit(0)).cast("bigint"))
        .withColumn("_taken", F.struct(*taken.values()))
        .withColumn("n_symbols", F.col("_taken.symbol"))
        .withColumn("char_counts", F.array(*[F.col(f"_taken.{name}") for name in CLASSES], length - F.col("word_chars")))
        .withColumn("char_counts", _with_rest(F.col("char_counts"), length))
        .withColumn(
            "_common",
            F.transform(
                F.filter("_words", lambda w: (F.octet_length(w) <= longest) & F.lower(w).isin(*every)), F.lower
            ),
        )
        .withColumn("compared_with", _language(F.col(lang), common, rules))
        .withColumn("word_counts", counts)
        .withColumn("word_counts", _with_rest(F.col("word_counts"), F.col("n_words")))
        .withColumn(
            "base_failed",
            (F.col("n_words") < 50) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words")),
        )
    )
    return rows.drop("_body", "_words", "_lines", "_windows", "_again", "_sorted", "_starts", "_common", "_taken")


def references(measured: DataFrame, rules: Rules | None = None, lang: str = "lang") -> dict[str, dict[str, list[float]]]:
    """The histograms of each of the rules' languages as shares, summed over all its documents.

    The driver gets one row for each language of the rules. Every class has one count added, so no share is 0.
    """
    rules = rules or Rules()
    sizes = {
        "char_counts": len(CLASSES) + 2,
        "word_counts": max(len(words) for words in rules.languages.values()) + 1,
    }
    sums = [
        F.sum(F.get(name, F.lit(at)).cast("double")).alias(f"{name}{at}")
        for name, size in sizes.items()
        for at in range(size)
    ]
    found = measured.where(F.col(lang).isin(*rules.languages)).groupBy(lang).agg(*sums).collect()
    shares: dict[str, dict[str, list[float]]] = {}
    for row in sorted(found, key=lambda row: row[lang]):
        shares[row[lang]] = {}
        for name, size in sizes.items():
            counts = [row[f"{name}{at}"] for at in range(size)]
            counts = [count + 1.0 for count in counts if count is not None]
            shares[row[lang]][name] = [count / sum(counts) for count in counts]
    return shares


def distance(counts: Column, shares: list[float]) -> Column:
    """The Jensen-Shannon distance (base 2) of a histogram from given shares; null for an empty histogram. The sum of
    the histogram is the column `_total`."""
    total = F.col("_total")

    def term(count: Column, q: Column) -> Column:
        p = count / total
        middle = (p + q) / 2
        return F.when(p > 0, p * F.log2(p / middle)).otherwise(F.lit(0.0)) + q * F.log2(q / middle)

    terms = F.zip_with(counts, F.lit(shares), term)
    divergence = F.aggregate(terms, F.lit(0.0), lambda a, b: a + b) / 2
    return F.when(total > 0, F.sqrt(F.greatest(divergence, F.lit(0.0))))


def judge(measured: DataFrame, shares: dict, rules: Rules | None = None) -> DataFrame:
    """The measured rows with `char_distance`, `word_distance` and `kept`.

    A document is compared with its own language; one whose language is null or not among the rules' languages, with
    the language that it shares most common words with. It is kept unless it fails the base rule, or a distance is
    above its limit and the text is long enough to judge it. Without a reference for its language only the base rule
    rejects.
    """
    rules = rules or Rules()
    out = measured
    for name, column in (("char_counts", "char_distance"), ("word_counts", "word_distance")):
        out = out.withColumn("_total", _sum(F.col(name)).cast("double"))
        chosen = F.lit(None).cast("double")
        for code, parts in shares.items():
            chosen = F.when(F.col("compared_with") == code, distance(F.col(name), parts[name])).otherwise(chosen)
        out = out.withColumn(column, chosen).drop("_total")
    far = ((F.col("char_distance") > rules.max_char_distance) & (F.col("word_chars") >= rules.min_chars)) | (
        (F.col("word_distance") > rules.max_word_distance) & (F.col("n_words") >= rules.min_words))
    return out.withColumn("kept", ~F.col("base_failed") & ~F.coalesce(far, F.lit(False)))


def quality(df: DataFrame, rules: Rules | None = None, keep: list[str] | None = None) -> DataFrame:
    """Measures and verdict of every document. `df` needs doc_id, text and lang.

    The measures, a few hundred bytes a document, are written to the shared folder once: they give the references of
    the languages first and the verdicts after. `keep` names columns of the input to carry along. Empty tables give
    no rows; repeated rows are judged alike.
    """
    rules = rules or Rules()
    narrow = df.select("doc_id", "lang", "text", *(keep or []))
    measured = stage(measures(narrow, rules).drop("text"), "quality")
    return judge(measured, references(measured, rules), rules)


def good(df: DataFrame, rules: Rules | None = None) -> DataFrame:
    """The rows of the input that `quality` keeps, with all their columns, whatever their names."""
    rows = df.select(
        "doc_id", "lang", "text", F.struct(*[F.col(f"`{name}`") for name in df.columns]).alias("_row")
    )
    return quality(rows, rules, ["_row"]).where("kept").select("_row.*")
