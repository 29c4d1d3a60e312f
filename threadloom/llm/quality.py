"""Quality rules: how far a document's characters and common words are from its language.

DataFrame functions only.  Each document gets two histograms, one over character
classes and one over the common words of its language.  The references are the
summed histograms of the documents of that language.  The Jensen-Shannon
distance (square root of the divergence in bits, 0 to 1) is judged only where a
text is long enough for its histogram to mean something.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from threadloom.llm.common import let, words

#: Common words by language: fixed values.
COMMON_WORDS = {
    "en": "the of and to in a is that for it was on are as with be by this from or an at not have".split(),
    "de": "der die und in den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an er".split(),
    "fr": "de la le et les des en un du une que est pour qui dans par sur au pas plus avec ne se ce".split(),
    "es": "de la que el en y a los se del las un por con no una su para es al lo como más pero".split(),
}
#: Classes of the characters in words; each takes what the ones before it left.  Fixed values.
CHARACTER_CLASSES = {
    "lower_ascii": "[a-z]+",
    "lower": r"\p{Ll}+",
    "upper": r"\p{Lu}+",
    "digit": r"\p{Nd}+",
    "point": r"[.,;:!?'\"()-]+",
}
WINDOW = 5
DIGEST = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_chars_read", "char_counts", "common_counts")


@dataclass(frozen=True)
class Limits:
    """A document is rejected beyond ``max_char_distance`` alone or beyond both ``joint_*`` distances.

    The histogram of a short text strays by chance, so the first rule needs
    ``min_chars`` code points and the second ``min_joint_words`` words.
    """

    min_words: int = 10
    max_repeat_percent: int = 20
    min_chars: int = 200
    max_char_distance: float = 0.33
    min_joint_words: int = 60
    joint_char_distance: float = 0.17
    joint_word_distance: float = 0.25


def repeated_window_words(ws: Column) -> Column:
    """Words that lie in a window of five words found at least twice in the list.

    Windows are compared by 64-bit hashes, put together from hashes of one, two
    and four words.  Only a list with an equal pair is sorted; the covered words
    are the gaps between the flagged window starts, five at most each.
    """

    def from_place(xs: Column, k: int) -> Column:
        return F.slice(xs, F.lit(k + 1), F.size(xs))

    def joined(xs: Column, ys: Column) -> Column:
        return F.zip_with(xs, ys, lambda x, y: F.xxhash64(x, y))

    def hashed(one: Column) -> Column:
        # Entries that reach past the end are no windows; the last slice drops them.
        four = let(joined(one, from_place(one, 1)), lambda two: joined(two, from_place(two, 2)))
        return F.slice(joined(four, from_place(one, 4)), F.lit(1), F.size(one) - (WINDOW - 1))

    def covered(hashes: Column) -> Column:
        pairs = F.sort_array(F.transform(hashes, lambda h, i: F.struct(h.alias("h"), i.alias("i"))))

        def starts(s: Column) -> Column:
            def twice(e: Column, k: Column) -> Column:
                before, after = F.get(s, k - 1)["h"], F.get(s, k + 1)["h"]
                return F.coalesce(before == e["h"], F.lit(False)) | F.coalesce(after == e["h"], F.lit(False))

            return F.sort_array(F.transform(F.filter(s, twice), lambda e: e["i"]))

        def total(at: Column) -> Column:
            gaps = F.transform(at, lambda p, k: F.least(F.lit(WINDOW), F.coalesce(F.get(at, k + 1) - p, F.lit(WINDOW))))
            return F.aggregate(gaps, F.lit(0).cast("long"), lambda a, g: a + g)

        return let(pairs, lambda s: let(starts(s), total))

    def count(h: Column) -> Column:
        return F.when(F.size(F.array_distinct(h)) == F.size(h), F.lit(0).cast("long")).otherwise(covered(h))

    hashes = let(F.transform(ws, lambda w: F.xxhash64(w)), hashed)
    return F.when(F.size(ws) < WINDOW, F.lit(0).cast("long")).otherwise(let(hashes, count))


def _sum(xs: Column) -> Column:
    return F.aggregate(xs, F.lit(0).cast("long"), lambda a, x: a + x)


def _common_counts(ws: Column) -> Column:
    """Occurrences of each common word of the row's language, then all other words; null without a reference."""

    def of(language: str) -> Column:
        listed = COMMON_WORDS[language]

        def counts(joined: Column) -> Column:
            # Each matched word stands between two blanks of its own: removing it shortens the text by its places.
            gone = [
                F.octet_length(joined) - F.octet_length(F.replace(joined, F.lit(f" {w} "), F.lit(""))) for w in listed
            ]
            found = F.array(*((g / F.lit(len(w.encode()) + 2)).cast("long") for g, w in zip(gone, listed)))
            return let(found, lambda n: F.concat(n, F.array(F.size(ws).cast("long") - _sum(n))))

        matched = F.filter(ws, lambda w: w.isin(listed))
        return let(F.concat(F.lit(" "), F.array_join(matched, "  "), F.lit(" ")), counts)

    chosen = F.lit(None)
    for language in COMMON_WORDS:
        chosen = F.when(F.col("lang") == language, of(language)).otherwise(chosen)
    return chosen


def measure(docs: DataFrame) -> DataFrame:
    """``docs`` with the columns of ``DIGEST``: everything the rules need, from one pass over each text."""
    text = F.coalesce("text", F.lit(""))
    lines = F.filter(F.split(text, "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    out = (
        docs.withColumn("_words", words(F.col("text")))
        .withColumn("_left", F.array_join("_words", ""))
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length("_left").cast("long"))
        .withColumn("n_dup_lines", let(lines, lambda x: F.size(x) - F.size(F.array_distinct(x))).cast("long"))
        .withColumn("n_repeat_words", repeated_window_words(F.col("_words")))
        .withColumn("n_chars_read", F.length(text).cast("long"))
        .withColumn("common_counts", _common_counts(F.col("_words")))
        .drop("_words")
    )
    # Common classes first, so that the later patterns run over short rests.
    sizes = [F.col("n_chars_read") - F.col("word_chars")]
    for k, pattern in enumerate(CHARACTER_CLASSES.values()):
        out = out.withColumn("_next", F.regexp_replace("_left", pattern, ""))
        out = out.withColumn(f"_size{k}", F.length("_left") - F.length("_next")).drop("_left").withColumnRenamed("_next", "_left")
        if k == 0:
            # No symbol is a lower-case letter: count them in what is left.
            out = out.withColumn("n_symbols", F.length(F.regexp_replace("_left", r"[^#*$%&|<>]+", "")).cast("long"))
        sizes.append(F.col(f"_size{k}"))
    sizes.append(F.length("_left"))
    out = out.withColumn("char_counts", F.array(*(s.cast("long") for s in sizes)))
    return out.drop("_left", *(f"_size{k}" for k in range(len(CHARACTER_CLASSES))))


def language_references(measured: DataFrame) -> DataFrame:
    """``(lang, ref_chars, ref_common)``: one row per listed language, summed over all given documents."""
    n_chars, n_common = len(CHARACTER_CLASSES) + 2, len(COMMON_WORDS["en"]) + 1
    sums = [F.sum(F.col("char_counts")[i]).alias(f"c{i}") for i in range(n_chars)]
    sums += [F.sum(F.col("common_counts")[i]).alias(f"w{i}") for i in range(n_common)]
    summed = measured.filter(F.col("lang").isin(list(COMMON_WORDS))).groupBy("lang").agg(*sums)
    return summed.select(
        "lang",
        F.array(*(f"c{i}" for i in range(n_chars))).alias("ref_chars"),
        F.array(*(f"w{i}" for i in range(n_common))).alias("ref_common"),
    )


def jensen_shannon(p: Column, q: Column) -> Column:
    """Distance of two histograms of counts; null if either is empty or null."""

    def part(x: Column, y: Column) -> Column:
        return F.when(x > 0, x * F.log2(2 * x / (x + y))).otherwise(0.0)

    def distance(sums: Column) -> Column:
        def term(x: Column, y: Column) -> Column:
            return let(
                F.struct((x / sums["p"]).alias("x"), (y / sums["q"]).alias("y")),
                lambda e: (part(e["x"], e["y"]) + part(e["y"], e["x"])) / 2,
            )

        total = F.aggregate(F.zip_with(p, q, term), F.lit(0.0), lambda a, t: a + t)
        return F.when((sums["p"] > 0) & (sums["q"] > 0), F.sqrt(F.greatest(total, F.lit(0.0))))

    return let(F.struct(_sum(p).alias("p"), _sum(q).alias("q")), distance)


def with_distances(measured: DataFrame, references: DataFrame, limits: Limits) -> DataFrame:
    """``measured`` with ``char_distance``, ``word_distance`` (null: not judged), ``base_failed`` and ``kept``."""
    # One row per language listed above, so a broadcast of it has a fixed bound.
    out = measured.join(F.broadcast(references), "lang", "left")
    out = out.withColumn(
        "char_distance",
        F.when(F.col("n_chars_read") >= limits.min_chars, jensen_shannon(F.col("char_counts"), F.col("ref_chars"))),
    ).withColumn(
        "word_distance",
        F.when(F.col("n_words") >= limits.min_joint_words, jensen_shannon(F.col("common_counts"), F.col("ref_common"))),
    )
    failed = (F.col("n_words") < limits.min_words) | (
        100 * F.col("n_repeat_words") > limits.max_repeat_percent * F.col("n_words")
    )
    chars, common = F.coalesce("char_distance", F.lit(0.0)), F.coalesce("word_distance", F.lit(0.0))
    far = (chars > limits.max_char_distance) | (
        (chars > limits.joint_char_distance) & (common > limits.joint_word_distance)
    )
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & ~far).drop("ref_chars", "ref_common")


def judge(measured: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """Every measured document with its distances, ``base_failed`` and ``kept``.

    ``measured`` is the result of ``measure``, best written out first, since it is
    read three times: for a first reference over all documents, for the
    reference over those that the first one keeps (so that rubbish does not
    shift it), and for the verdicts.

    Other columns pass through.  A null text is empty, hence ``base_failed``.  A
    document whose language is null or has no reference, and a histogram below
    its minimum length, is judged by the other rules alone.  Equal rows get equal
    verdicts.  An empty table gives an empty result.  Input columns named like a
    result are replaced.
    """
    first = with_distances(measured, language_references(measured), limits)
    return with_distances(measured, language_references(first.filter("kept")), limits)
