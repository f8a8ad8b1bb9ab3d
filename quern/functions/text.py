"""Text measures, cuts and predicates."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .basics import col, count_of, let, squeeze, strip, word_set, words

# The reference's word lists.
QUANTITY_WORDS = [
    "most", "least", "fewest", "more", "less", "fewer", "largest", "smallest", "greatest", "larger", "smaller", "greater",
    "highest", "lowest", "higher", "lower", "increase", "decrease", "minimum", "maximum", "max", "min", "mean", "average",
    "median", "total", "sum", "add", "subtract", "difference", "quotient", "gap", "half", "double", "twice", "triple",
    "square", "cube", "root", "approximate", "approximation", "triangle", "rectangle", "circle", "sphere", "cylinder",
    "cone", "pyramid", "multiply", "divide", "percentage", "percent", "ratio", "proportion", "fraction", "rate",
]
BOOL_WORDS = ["Yes", "No", "True", "False", "yes", "no", "true", "false", "YES", "NO", "TRUE", "FALSE"]
NUMBER_WORDS = [
    "zero", "one", "two", "three", "four", "five", "six", "seven", "eight", "nine", "ten", "eleven", "twelve", "thirteen",
    "fourteen", "fifteen", "sixteen", "seventeen", "eighteen", "nineteen", "twenty", "thirty", "forty", "fifty", "sixty",
    "seventy", "eighty", "ninety", "hundred", "thousand", "million", "billion",
]


def ngrams(items: Column, n: int) -> Column:
    """Runs of ``n`` neighbours, joined by a space; none where there are fewer."""
    runs = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
    return let(items, lambda w: F.when(F.size(w) >= n, runs(w)).otherwise(F.array().cast("array<string>")))


def ngram_hashes(items: Column, n: int) -> Column:
    """A 64-bit hash of each run of ``n`` neighbours; words are hashed once, runs by the hashes of their words."""
    runs = lambda h: F.transform(F.sequence(F.lit(1), F.greatest(F.size(h) - (n - 1), F.lit(1))), lambda i: F.xxhash64(F.slice(h, i, n)))
    hashed = F.transform(items, lambda w: F.xxhash64(w))
    return let(hashed, lambda h: F.when(F.size(h) >= n, runs(h)).otherwise(F.array().cast("array<bigint>")))


def sentence_repetition(text: Column | str, n: int) -> Column:
    """Distinct n-grams that occur more than once, as a share of all n-grams; 0 where there are none.

    One pass over the sorted hashes of n-grams: a value counts when it is met for the second time. Two of a million n-grams
    share a hash with a chance of 3e-8.
    """
    start = F.struct(F.lit(None).cast("bigint").alias("last"), F.lit(0).alias("run"), F.lit(0).alias("again"))

    def step(s: Column, g: Column) -> Column:
        run = F.when(s["last"] == g, s["run"] + 1).otherwise(F.lit(1))
        return F.struct(g.alias("last"), run.alias("run"), (s["again"] + (run == 2).cast("int")).alias("again"))

    share = lambda grams: F.aggregate(grams, start, step, lambda s: s["again"].cast("double")) / F.size(grams).cast("double")
    return let(F.sort_array(ngram_hashes(words(text), n)), lambda grams: F.when(F.size(grams) > 0, share(grams)).otherwise(0.0))


def truncate_prefix(text: Column | str, share: float) -> Column:
    """The first share of the words between single spaces, stripped."""
    parts = F.split(col(text), " ", -1)
    return strip(F.array_join(F.slice(parts, 1, F.floor(F.size(parts) * F.lit(share)).cast("int")), " "))


def split_steps(text: Column | str, separator: str = "\n\n", most: int | None = None) -> Column:
    """Steps between separators; with ``most``, so many neighbours are merged that no more steps remain."""
    steps = F.split(col(text), "\\Q" + separator + "\\E", -1)
    if not most:
        return steps

    def merged(s: Column) -> Column:
        each = F.ceil(F.size(s) / F.lit(most)).cast("int")
        return F.when(F.size(s) > most, F.transform(F.sequence(F.lit(0), F.size(s) - 1, each), lambda i: F.array_join(F.slice(s, i + 1, each), separator))).otherwise(s)

    return let(steps, merged)


def swap_instruction(question: Column | str, suffixes: list[str], template: str) -> Column:
    """Known instructions taken off the end, the rest put into ``template`` for {question}."""
    known = "|".join("\\Q" + s + "\\E" for s in sorted(suffixes, key=len, reverse=True))
    bare = F.regexp_replace(col(question), f"({known})$", "") if suffixes else col(question)
    return F.replace(F.lit(template), F.lit("{question}"), strip(bare))


def one_placeholder(question: Column | str, mark: str = "<image>") -> Column:
    """A single mark anywhere moves to the front; none gets one; several stay as they are."""
    q, n = col(question), count_of(question, mark)
    bare = F.when(n == 1, strip(F.replace(q, F.lit(mark), F.lit("")))).otherwise(q)
    return F.when(n <= 1, F.concat(F.lit(mark + "\n"), bare)).otherwise(bare)


def has_digit(text: Column | str) -> Column:
    return col(text).rlike("[0-9]")


def has_number_word(text: Column | str) -> Column:
    return has_digit(text) | F.arrays_overlap(word_set(text), F.array(*map(F.lit, NUMBER_WORDS)))


def has_quantity_word(text: Column | str, compat: bool = False, more: tuple[str, ...] = ()) -> Column:
    """In compat mode, a list that runs "fewest" and "more" together knows neither."""
    listed = [w for w in QUANTITY_WORDS if not (compat and w in ("fewest", "more"))] + (["fewestmore"] if compat else []) + list(more)
    return F.arrays_overlap(word_set(text), F.array(*map(F.lit, listed)))


def is_bool_word(text: Column | str) -> Column:
    return col(text).isin(*BOOL_WORDS)


def is_digit_string(text: Column | str) -> Column:
    return F.regexp_replace(strip(text), r"\.0+$", "").rlike(r"^[+-]?\d+$")


def is_float_string(text: Column | str) -> Column:
    return F.contains(col(text), F.lit(".")) & strip(text).rlike(r"^[+-]?(\d+\.\d*|\.\d+)([eE][+-]?\d+)?$")


def common_prefix_length(a: Column | str, b: Column | str) -> Column:
    """How many leading elements two arrays share."""
    same = F.zip_with(col(a), col(b), lambda x, y: F.coalesce(x == y, F.lit(False)))
    stop = F.array_position(same, False)
    return F.when(stop > 0, stop - 1).otherwise(F.size(same)).cast("int")


def modality(images: Column | str, video: Column | str) -> Column:
    """What a row holds: multi_image, image, video or text. ``images`` is an array of paths."""
    images = F.filter(F.coalesce(col(images), F.array().cast("array<string>")), lambda x: x.isNotNull() & (x != ""))
    return F.when(F.size(images) > 1, "multi_image").when(F.size(images) == 1, "image").when(F.coalesce(col(video), F.lit("")) != "", "video").otherwise("text")


def one_line(text: Column | str) -> Column:
    return squeeze(text)
