"""Quality rules from distribution divergence, in DataFrame functions only.

A document's histogram over character classes and its histogram over the commonest words of its
language are compared with references by Jensen-Shannon distance (the root of the divergence to
base 2, between 0 and 1). Short texts give noisy histograms, so each test has a least length.
Base counts (words, symbols, repeated lines, words in repeated three-word windows) come first.

Everything is computed inside a row: no shuffle, no join, nothing collected.

Defined results: a null or empty text has no words and fails the base rules; an unknown or null
language skips the word test and uses the pooled character reference; repeated rows are judged one
by one; an empty table gives none; columns named like a result are replaced by it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

SPACE = r"[\x20\x09-\x0D]"
SYMBOL = r"[#*$%&|<>]"
#: Small letters: the bulk of a text, taken out once before the other classes are counted.
SMALL = r"[a-zß-öø-ÿ]"
LEAST_WORDS, MOST_REPEATED = 50, 50
#: Least length for each test, and the distance from which a document is rejected.
LEAST_CHARS, CHAR_LIMIT = 200, 0.22
LEAST_COMMON, WORD_LIMIT = 100, 0.32

# Character classes, and their shares in ordinary prose (letters are the rest).
CLASSES = {"upper": r"[A-ZÀ-ÖØ-Þ]", "digit": r"[0-9]", "space": SPACE, "point": r"[.,;:!?'\"()-]", "mark": r"[#$%&*+/<=>@\[\]^_`{|}~\\]"}
CLASS_SHARES = {
    "en": [0.022, 0.006, 0.167, 0.025, 0.001],
    "fr": [0.022, 0.006, 0.163, 0.030, 0.001],
    "de": [0.050, 0.006, 0.145, 0.026, 0.001],
    "es": [0.022, 0.006, 0.163, 0.026, 0.001],
}
# The commonest words of each language and their shares of all words in prose.
COMMON = {
    "en": {"the": 0.062, "of": 0.032, "and": 0.028, "to": 0.025, "a": 0.020, "in": 0.019, "is": 0.011, "that": 0.011, "it": 0.009, "for": 0.009, "was": 0.009, "on": 0.007},
    "fr": {"de": 0.053, "la": 0.032, "le": 0.025, "et": 0.024, "les": 0.020, "des": 0.018, "en": 0.014, "un": 0.012, "du": 0.011, "que": 0.010, "une": 0.010, "est": 0.009},
    "de": {"der": 0.036, "die": 0.036, "und": 0.028, "in": 0.020, "den": 0.013, "von": 0.011, "zu": 0.011, "das": 0.011, "mit": 0.009, "des": 0.008, "auf": 0.008, "ist": 0.008},
    "es": {"de": 0.062, "la": 0.039, "que": 0.031, "el": 0.029, "en": 0.026, "y": 0.026, "los": 0.017, "del": 0.013, "se": 0.012, "las": 0.011, "por": 0.010, "un": 0.010},
}
SIZE = 12
#: Words of a text up to which a window's hash is shortened to fit beside its position (a chance of 1 in 10 million to err).
PACKED_WORDS = 12_000


def let(value: Column, body) -> Column:
    """body(value) with value computed once, however often and deep body uses it."""
    return F.transform(F.array(value), body)[0]


def word_array(text: Column) -> Column:
    trimmed = F.btrim(text, F.lit(" \t\n\x0b\x0c\r"))
    return F.when(trimmed == "", F.array().cast("array<string>")).otherwise(F.split(trimmed, SPACE + "+"))


def repeated_words(words: Column) -> Column:
    """Words inside three-word windows that occur twice or more. A window's hash and position share
    one long: sorting it brings equal windows together. Where positions need so many bits that hashes
    might meet by chance, a struct of two whole hashes and the position is sorted instead."""
    bits = F.ceil(F.log2(F.size(words) + 2)).cast("int")

    def keys(w: Column) -> Column:
        return F.transform(
            F.sequence(F.lit(0), F.size(w.words) - 3),
            lambda i: F.call_function("shiftleft", F.xxhash64(w.words[i], w.words[i + 1], w.words[i + 2]), w.bits).bitwiseOR(i.cast("long")),
        )

    def places(w: Column) -> Column:
        mask = F.call_function("shiftleft", F.lit(1).cast("long"), w.bits) - 1
        equal = lambda v, i: F.call_function("shiftrightunsigned", v["sorted"][i].bitwiseXOR(v["sorted"][i - 1]), v["bits"]) == 0
        both = lambda v: F.flatten(F.transform(F.filter(F.sequence(F.lit(1), F.size(v["sorted"]) - 1), lambda i: equal(v, i)), lambda i: F.array(v["sorted"][i - 1].bitwiseAND(v["mask"]), v["sorted"][i].bitwiseAND(v["mask"]))))
        found = let(F.struct(F.sort_array(keys(w)).alias("sorted"), w.bits.alias("bits"), mask.alias("mask")), both)
        return F.sort_array(F.array_distinct(found))

    def sure_places(w: Column) -> Column:
        window = lambda i: [w.words[i], w.words[i + 1], w.words[i + 2]]
        keys = F.transform(F.sequence(F.lit(0), F.size(w.words) - 3), lambda i: F.struct(F.xxhash64(*window(i)).alias("a"), F.xxhash64(F.lit(1), *window(i)).alias("b"), i.cast("long").alias("i")))
        equal = lambda v, i: (v[i]["a"] == v[i - 1]["a"]) & (v[i]["b"] == v[i - 1]["b"])
        both = lambda v: F.flatten(F.transform(F.filter(F.sequence(F.lit(1), F.size(v) - 1), lambda i: equal(v, i)), lambda i: F.array(v[i - 1]["i"], v[i]["i"])))
        return F.sort_array(F.array_distinct(let(F.sort_array(keys), both)))

    covered = let(F.struct(words.alias("words"), bits.alias("bits")), lambda w: let(F.when(F.size(w.words) <= PACKED_WORDS, places(w)).otherwise(sure_places(w)), lambda p: F.aggregate(F.transform(p, lambda x, i: F.least(F.lit(3).cast("long"), F.coalesce(F.get(p, i + 1) - x, F.lit(3).cast("long")))), F.lit(0).cast("long"), lambda a, y: a + y)))
    return F.when(F.size(words) < 4, F.lit(0).cast("long")).otherwise(covered)


def js_distance(counts: list[Column], reference: Column) -> Column:
    """Jensen-Shannon distance between counts and the shares in the array reference."""
    half = lambda a, m: F.when(a > 0, a * F.log2(a / m)).otherwise(F.lit(0.0))
    term = lambda p, q: half(p, (p + q) / 2) + half(q, (p + q) / 2)
    histogram = F.array(*[c.cast("double") for c in counts])
    total = lambda a: F.aggregate(a, F.lit(0.0), lambda s, x: s + x)
    shares = let(F.struct(histogram.alias("h"), F.greatest(total(histogram), F.lit(1.0)).alias("t")), lambda v: F.transform(v["h"], lambda x: x / v["t"]))
    return F.sqrt(F.greatest(total(F.zip_with(shares, reference, term)) / 2, F.lit(0.0)))


def _rest(shares: list[float]) -> list[float]:
    return [*shares, 1.0 - sum(shares)]


def _by_lang(of, default) -> Column:
    column = F.lit(default) if isinstance(default, list) else default
    for lang in COMMON:
        column = F.when(F.col("lang") == lang, F.array(*[F.lit(x) for x in of(lang)])).otherwise(column)
    return column


def _common(k: int) -> Column:
    """The k-th common word of the row's language."""
    word = F.lit("the")
    for lang, words in COMMON.items():
        word = F.when(F.col("lang") == lang, F.lit(list(words)[k])).otherwise(word)
    return word


def judge(docs: DataFrame) -> DataFrame:
    """docs with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, js_chars, js_words, kept."""
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "js_chars", "js_words", "kept"]
    return _judged(docs).select(*[F.col(f"doc.`{c}`").alias(c) for c in docs.columns if c not in names], *names)


def keep(docs: DataFrame) -> DataFrame:
    """The rows of docs that no rule rejects, with their own columns."""
    # beside a column that is not deterministic the filter stays where it is; pushed down, it would compute
    # the whole verdict a second time, with nothing shared
    return _judged(docs).withColumn("at", F.monotonically_increasing_id()).where(F.col("kept") & (F.col("at") >= 0)).select("doc.*")


def _judged(docs: DataFrame) -> DataFrame:
    """The row as a struct named doc, with n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, js_chars, js_words, kept."""
    text = F.coalesce(F.col("text"), F.lit(""))
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "js_chars", "js_words", "kept"]
    plain = docs.select(F.struct(*[F.col(f"`{c}`") for c in docs.columns]).alias("doc"), "text", "lang")
    pooled = _rest([sum(s[k] for s in CLASS_SHARES.values()) / len(CLASS_SHARES) for k in range(len(CLASSES))])
    lines = F.filter(F.split(text, "\n"), lambda line: line.rlike(r"[^\x20\x09-\x0D]"))
    # kept apart from what follows, so that each is computed once
    counted = plain.select(
        "*", word_array(text).alias("_words"), let(lines, lambda a: F.size(a) - F.size(F.array_distinct(a))).cast("long").alias("n_dup_lines"),
        F.length(text).alias("_chars"), F.regexp_replace(text, SMALL + "+", "").alias("_others"),
    )
    counted = counted.select("*", *[F.regexp_count("_others", F.lit(pattern)).alias(f"_{name}") for name, pattern in (CLASSES | {"symbols": SYMBOL}).items()])
    counted = counted.select(
        "*", F.col("_symbols").cast("long").alias("n_symbols"), repeated_words(F.col("_words")).alias("n_repeat_words"), F.size("_words").cast("long").alias("n_words"), (F.col("_chars") - F.col("_space")).cast("long").alias("word_chars"),
        F.array(*[F.size("_words") - F.size(F.array_remove(F.col("_words"), _common(k))) for k in range(SIZE)]).alias("_common"),
    )
    letters = F.col("_chars") - sum(F.col(f"_{name}") for name in CLASSES)
    compared = counted.select(
        "*", js_distance([*[F.col(f"_{name}") for name in CLASSES], letters], _by_lang(lambda lang: _rest(CLASS_SHARES[lang]), F.array(*[F.lit(x) for x in pooled]))).alias("js_chars"),
        F.when(F.col("lang").isin(*COMMON), js_distance([*[F.col("_common")[k] for k in range(SIZE)], F.col("n_words") - F.aggregate("_common", F.lit(0), lambda a, x: a + x)], _by_lang(lambda lang: _rest(list(COMMON[lang].values())), F.array(*[F.lit(0.0)] * (SIZE + 1))))).alias("js_words"),
        ((F.col("n_words") < LEAST_WORDS) | (100 * F.col("n_repeat_words") > MOST_REPEATED * F.col("n_words"))).alias("base_failed"),
    )
    far = ((F.col("_chars") >= LEAST_CHARS) & (F.col("js_chars") > CHAR_LIMIT)) | (F.col("js_words").isNotNull() & (F.col("n_words") >= LEAST_COMMON) & (F.col("js_words") > WORD_LIMIT))
    return compared.select("doc", *names[:-1], (~F.col("base_failed") & ~far).alias("kept"))
