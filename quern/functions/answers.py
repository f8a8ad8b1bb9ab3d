"""Answer extraction, normalisation and scoring as columns.

Where the reference's rule has a quirk, ``compat=True`` reproduces it and the default is the sound rule.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .basics import before_first, char_at, col, contains, count_of, let, number, squeeze, strip, words

# The normaliser's articles, number words, punctuation and contractions.
ARTICLES = ["a", "an", "the"]
NUMBERS = {"none": "0", "zero": "0", "one": "1", "two": "2", "three": "3", "four": "4", "five": "5", "six": "6", "seven": "7", "eight": "8", "nine": "9", "ten": "10"}
PUNCTUATION = [";", "/", "[", "]", '"', "{", "}", "(", ")", "=", "+", "\\", "_", "-", ">", "<", "@", "`", ",", "?", "!"]
CONTRACTIONS = {
    "aint": "ain't", "arent": "aren't", "cant": "can't", "couldve": "could've", "couldnt": "couldn't", "couldn'tve": "couldn't've",
    "couldnt've": "couldn't've", "didnt": "didn't", "doesnt": "doesn't", "dont": "don't", "hadnt": "hadn't", "hadnt've": "hadn't've",
    "hadn'tve": "hadn't've", "hasnt": "hasn't", "havent": "haven't", "hed": "he'd", "hed've": "he'd've", "he'dve": "he'd've",
    "hes": "he's", "howd": "how'd", "howll": "how'll", "hows": "how's", "Id've": "I'd've", "I'dve": "I'd've", "Im": "I'm", "Ive": "I've",
    "isnt": "isn't", "itd": "it'd", "itd've": "it'd've", "it'dve": "it'd've", "itll": "it'll", "let's": "let's", "maam": "ma'am",
    "mightnt": "mightn't", "mightnt've": "mightn't've", "mightn'tve": "mightn't've", "mightve": "might've", "mustnt": "mustn't",
    "mustve": "must've", "neednt": "needn't", "notve": "not've", "oclock": "o'clock", "oughtnt": "oughtn't", "ow's'at": "'ow's'at",
    "'ows'at": "'ow's'at", "'ow'sat": "'ow's'at", "shant": "shan't", "shed've": "she'd've", "she'dve": "she'd've", "she's": "she's",
    "shouldve": "should've", "shouldnt": "shouldn't", "shouldnt've": "shouldn't've", "shouldn'tve": "shouldn't've",
    "somebody'd": "somebodyd", "somebodyd've": "somebody'd've", "somebody'dve": "somebody'd've", "somebodyll": "somebody'll",
    "somebodys": "somebody's", "someoned": "someone'd", "someoned've": "someone'd've", "someone'dve": "someone'd've",
    "someonell": "someone'll", "someones": "someone's", "somethingd": "something'd", "somethingd've": "something'd've",
    "something'dve": "something'd've", "somethingll": "something'll", "thats": "that's", "thered": "there'd", "thered've": "there'd've",
    "there'dve": "there'd've", "therere": "there're", "theres": "there's", "theyd": "they'd", "theyd've": "they'd've",
    "they'dve": "they'd've", "theyll": "they'll", "theyre": "they're", "theyve": "they've", "twas": "'twas", "wasnt": "wasn't",
    "wed've": "we'd've", "we'dve": "we'd've", "weve": "we've", "werent": "weren't", "whatll": "what'll", "whatre": "what're",
    "whats": "what's", "whatve": "what've", "whens": "when's", "whered": "where'd", "wheres": "where's", "whereve": "where've",
    "whod": "who'd", "whod've": "who'd've", "who'dve": "who'd've", "wholl": "who'll", "whos": "who's", "whove": "who've",
    "whyll": "why'll", "whyre": "why're", "whys": "why's", "wont": "won't", "wouldve": "would've", "wouldnt": "wouldn't",
    "wouldnt've": "wouldn't've", "wouldn'tve": "wouldn't've", "yall": "y'all", "yall'll": "y'all'll", "y'allll": "y'all'll",
    "yall'd've": "y'all'd've", "y'alld've": "y'all'd've", "y'all'dve": "y'all'd've", "youd": "you'd", "youd've": "you'd've",
    "you'dve": "you'd've", "youll": "you'll", "youre": "you're", "youve": "you've",
}
OPTIONS = [chr(65 + i) for i in range(26)]


def _map(pairs: dict[str, str]) -> Column:
    return F.create_map(*(F.lit(x) for pair in pairs.items() for x in pair))


def normalize_answer(answer: Column | str) -> Column:
    """Lower case; commas and question marks out; 's apart; punctuation out or to spaces; periods out unless a digit
    follows; number words to digits; articles out; contractions with their apostrophes."""
    a = F.lower(col(answer))
    a = F.replace(F.replace(a, F.lit(","), F.lit("")), F.lit("?"), F.lit(""))
    return let(strip(F.regexp_replace(strip(F.replace(a, F.lit("'s"), F.lit(" 's"))), r"[\n\t]", " ")), _normalized)


def _normalized(a: Column) -> Column:
    # A mark next to a space goes, any other becomes a space; the test looks at the text as it came in, so all marks change at once.
    marks = [p for p in PUNCTUATION if p not in ",?"]
    held = F.filter(F.array(*map(F.lit, marks)), lambda p: F.contains(a, p))
    apart = let(held, lambda h: F.array_join(F.filter(h, lambda p: ~(F.contains(a, F.concat(p, F.lit(" "))) | F.contains(a, F.concat(F.lit(" "), p)))), ""))
    out = let(apart, lambda s: F.call_function("translate", a, F.concat(s, F.lit("".join(marks))), F.repeat(F.lit(" "), F.char_length(s))))
    out = F.regexp_replace(out, r"\.(?!\d)", "")
    said = F.filter(F.transform(words(out), lambda w: _looked_up(NUMBERS, w)), lambda w: ~w.isin(*ARTICLES))
    return F.array_join(F.transform(said, lambda w: _looked_up(CONTRACTIONS, w)), " ")


def _looked_up(pairs: dict[str, str], w: Column) -> Column:
    """The word that ``pairs`` has for ``w``, else ``w``. A map is searched from its front, so only words that a set holds get there."""
    return F.when(w.isin(*pairs), F.element_at(_map(pairs), w)).otherwise(w)


def short_answer(response: Column | str) -> Column:
    """The answer inside a short sentence: up to the first . , or !; after is, are, a, an, the; before of."""
    r = F.lower(F.regexp_extract(strip(response), r"^[^.,!]*", 0))
    for mark in ("is ", "are ", "a ", "an ", "the "):
        # Between the first such mark and the next.
        r = F.regexp_replace(r, f"(?s)^.*?{mark}(.*?)({mark}.*)?$", "$1")
    return strip(F.regexp_replace(r, "(?s) of.*$", ""))


def final_answer(text: Column | str) -> Column:
    """What follows the first "Final answer:" or "Answer:" on its line, in any case; else the text."""
    t = col(text)
    pattern = r"(?i)(Final answer:|Answer:)\s*(.*)"
    return F.when(t.rlike(pattern), F.regexp_extract(t, pattern, 2)).otherwise(t)


TRIGGERS = ["Final answer:", "Final Answer:", "答案:"]


def trigger_answer(response: Column | str) -> Column:
    """The answer after the last trigger, null where the form is wrong: two triggers at most, two newlines at least, a
    rationale that isn't empty and an answer of one line."""
    r = col(response)
    out = F.lit(None).cast("string")
    used = F.when(contains(r, TRIGGERS[0]), F.lit(TRIGGERS[0])).when(contains(r, TRIGGERS[1]), F.lit(TRIGGERS[1])).otherwise(F.lit(TRIGGERS[2]))
    for t in TRIGGERS:
        answer = strip(F.substring_index(r, t, -1))
        before = F.left(r, F.char_length(r) - F.char_length(F.substring_index(r, t, -1)) - len(t))
        sound = count_of(r, t).between(1, 2) & (count_of(r, "\n") >= 2) & (strip(before) != "") & ~contains(answer, "\n")
        out = F.when((used == t) & sound, answer).otherwise(out)
    return out


def boxed_answer(response: Column | str) -> Column:
    """The content of the last \\boxed{...} with balanced braces; the response itself where there is none."""
    r = col(response)
    mark = "\\boxed{"
    tail = F.substring_index(r, mark, -1)
    start = F.struct(F.lit(1).alias("depth"), F.lit(0).alias("size"))
    step = lambda s, c: F.when(s["depth"] == 0, s).otherwise(F.struct(
        (s["depth"] + F.when(c == "{", 1).when(c == "}", -1).otherwise(0)).alias("depth"), (s["size"] + 1).alias("size")))
    end = F.aggregate(F.split(tail, ""), start, step)
    return F.when(contains(r, mark) & (end["depth"] == 0), F.left(tail, end["size"] - 1)).otherwise(r)


def is_cot_format(response: Column | str) -> Column:
    return F.char_length(col(response)) > 20


def is_think_format(response: Column | str) -> Column:
    """One <think> ... </think> in front, over 20 characters long, and a boxed answer after it."""
    r = col(response)
    after, inside = strip(F.substring_index(r, "</think>", -1)), strip(F.substring_index(r, "</think>", 1))
    return r.rlike(r"(?s)^<think>.*?</think>\s*.+$") & (count_of(r, "<think>") == 1) & (count_of(r, "</think>") == 1) & (boxed_answer(after) != after) & is_cot_format(inside)


def parse_answer(response: Column | str, version: Column | str) -> Column:
    """The answer by prompt version, null where the response has the wrong form."""
    r, v = col(response), col(version)
    return F.when(v.isin("en", "zh"), trigger_answer(r)).when(v.isin("en_v2", "zh_v2") & is_cot_format(r), boxed_answer(r)).when(v.isin("en_r1", "zh_r1") & is_think_format(r), boxed_answer(r))


def option_letter(pred: Column | str, letters: Column, texts: Column) -> Column:
    """One character: itself. First character an option: that. Else the letter of the first option text in the prediction."""
    p = strip(pred)
    hit = F.get(F.filter(F.arrays_zip(letters.alias("l"), texts.alias("t")), lambda o: contains(p, o["t"])), F.lit(0))["l"]
    return F.when(F.char_length(p) == 1, p).when(F.array_contains(letters, F.left(p, F.lit(1))), F.left(p, F.lit(1))).otherwise(F.coalesce(hit, p))


def strict_option(pred: Column | str) -> Column:
    """An upper-case option letter, null where there is none: X, X followed by no letter, or (X)."""
    p = F.upper(strip(strip_star(strip(pred))))
    second = char_at(p, 2)
    return F.when(F.char_length(p) == 1, p).when((F.char_length(p) > 1) & ~second.rlike(r"\p{L}") & char_at(p, 1).rlike("[A-Z]"), char_at(p, 1)).when(p.rlike(r"^\([A-Z]\)"), char_at(p, 2))


def strip_star(c: Column) -> Column:
    return F.btrim(c, F.lit("*"))


# Sentence openings that are no answer.
ANSWER_PREFIXES = ["The best answer is", "The correct answer is", "The answer is", "The answer", "The best option isThe correct option is", "Best answer:Best option:"]


def option_in_sentence(pred: Column | str, texts: Column | None = None) -> Column:
    """A to E out of a sentence: openings off; over 10 words without one of them: empty; the first of them; else the
    letter of the option that contains the text."""
    p = strip(pred)
    for prefix in ANSWER_PREFIXES:
        p = F.replace(p, F.lit(prefix), F.lit(""))
    letter = F.regexp_extract(p, "[ABCDE]", 0)
    if texts is None:
        return letter
    place = F.array_position(F.transform(texts, lambda t: contains(t, p)), True)
    named = F.when((p != "") & (place > 0), F.get(F.array(*map(F.lit, OPTIONS[:5])), (place - 1).cast("int"))).otherwise("")
    return F.when(letter != "", letter).when(F.size(words(p)) > 10, "").otherwise(named)


def choice_from_response(response: Column | str, letters: list[str], texts: Column, key: Column | None = None) -> Column:
    """(X), else X between spaces, else (over 5 words) an option's text; the last occurrence wins. Where none is found, a
    hash of ``key`` picks, so that reruns agree; without a key the result is null."""
    r = F.concat(F.lit(" "), F.btrim(col(response), F.lit(",.!?;:'")), F.lit(" "))
    last = lambda mark: F.char_length(r) - F.char_length(F.substring_index(r, mark, -1))

    def best(marks: list[Column], found: list[Column]) -> Column:
        places = F.array(*(F.struct(F.when(f, m).otherwise(-1).alias("at"), F.lit(-i).alias("i"), F.lit(x).alias("x")) for i, (x, m, f) in enumerate(zip(letters, marks, found, strict=True))))
        top = F.array_max(places)
        return F.when(top["at"] >= 0, top["x"])

    bracket = best([last(f"({x})") for x in letters], [contains(r, f"({x})") for x in letters])
    spaced = best([last(f" {x} ") for x in letters], [contains(r, f" {x} ") for x in letters])
    low = F.lower(r)
    shown = [F.lower(F.get(texts, F.lit(i))) for i in range(len(letters))]
    named = best([_last_place(low, s) for s in shown], [F.coalesce(contains(low, s), F.lit(False)) for s in shown])
    drawn = F.get(F.array(*map(F.lit, letters)), F.pmod(F.xxhash64(key), F.lit(len(letters))).cast("int")) if key is not None else F.lit(None).cast("string")
    return F.coalesce(bracket, spaced, F.when(F.size(words(r)) > 5, named), drawn)


def _last_place(text: Column, part: Column) -> Column:
    """Where the last ``part`` begins, counted from 0."""
    return F.char_length(text) - F.instr(F.reverse(text), F.reverse(part)) - F.char_length(part) + 1


def choice_after_answer(response: Column | str, letters: list[str], texts: Column, key: Column | None = None) -> Column:
    """The one letter that stands after the last "Answer:"; where there is none or several, (X), X and a space, X and a
    period, or (over 5 words) an option's text, the last of them; else as ``choice_from_response``."""
    r = col(response)
    tail = F.substring_index(r, "Answer:", -1)
    named = F.filter(F.array(*map(F.lit, letters)), lambda x: F.contains(tail, x))
    sole = F.when(contains(r, "Answer:") & (F.size(named) == 1), F.get(named, F.lit(0)))
    said = F.concat(F.lit(" "), F.btrim(r, F.lit(",.!?;:'")), F.lit(" "))

    def last_with(form: str, place: str) -> Column:
        """The letter whose ``place`` stands last, of those that occur in ``form``; without a place, the first of them."""
        have = F.array(*(F.struct(F.when(contains(said, form.format(x)), _last_place(said, F.lit(place.format(x)))).alias("at"), F.lit(-i).alias("i"), F.lit(x).alias("x")) for i, x in enumerate(letters)))
        return F.array_max(F.filter(have, lambda s: s["at"].isNotNull()))["x"]

    forms = [("({})", "({})"), ("{} ", " {} "), ("{}.", " {} ")]
    return F.coalesce(sole, *(last_with(f, p) for f, p in forms), choice_from_response(r, letters, texts, key))


COMMA_NUMBERS = r"-?\b\d{1,3}(?:,\d{3})+\b"
SCIENTIFIC_NUMBERS = r"-?\d+(?:\.\d+)?[eE][+-]?\d+"
SIMPLE_NUMBERS = r"-?(?:\d+\.\d+|\.\d+|\d+\b)(?![eE][+-]?\d+)(?![,\d])"


def numbers_in(text: Column | str) -> Column:
    """All numbers: those with commas, then scientific, then simple ones."""
    t = col(text)
    return F.concat(*(F.regexp_extract_all(t, F.lit(p), F.lit(0)) for p in (COMMA_NUMBERS, SCIENTIFIC_NUMBERS, SIMPLE_NUMBERS)))


KEY_PHRASES = ["could be ", "so ", "is ", "thus ", "therefore ", "final ", "answer ", "result "]


def open_answers(response: Column | str) -> Column:
    """Candidates of a free answer: the shortest tails after a key phrase in each sentence ("=" counts in the last), or
    the response, with the numbers in them; lower case, numbers to two places, distinct."""
    r = F.lower(F.btrim(strip(response), F.lit(".")))
    sentences = F.split(r, r"\n", -1)

    def tail(s: Column, i: Column) -> Column:
        marks = [*KEY_PHRASES]
        tails = F.array(*(F.when(contains(s, m), strip(F.substring_index(s, m, -1))) for m in marks), F.when((i == F.size(sentences) - 1) & contains(s, "="), strip(F.substring_index(s, "=", -1))))
        short = F.array_min(F.transform(F.filter(tails, lambda t: t.isNotNull() & (t != "")), lambda t: F.struct(F.char_length(t).alias("n"), t.alias("t"))))
        return F.when(~short["t"].isin(":", ",", ".", "!", "?", ";", "'"), short["t"])

    keys = F.filter(F.transform(sentences, tail), lambda t: t.isNotNull())
    keys = F.when(F.size(keys) == 0, F.array(r)).otherwise(keys)
    found = F.concat(keys, F.flatten(F.transform(keys, numbers_in)))
    return F.array_distinct(F.transform(found, normal_item))


def normal_item(text: Column) -> Column:
    """A number to two places without its commas, or the text stripped in lower case."""
    value = F.replace(text, F.lit(","), F.lit(""))
    return F.when(number(value).isNotNull(), F.round(number(value), 2).cast("string")).otherwise(F.lower(strip(text)))


def nearest_option(text: Column, options: Column) -> Column:
    """The option at the smallest edit distance, the first of several."""
    return F.array_min(F.transform(options, lambda o, i: F.struct(F.levenshtein(text, o).alias("d"), i.alias("i"), o.alias("o"))))["o"]


def normal_extraction(extraction: Column | str, choices: Column, question_type: Column | str, answer_type: Column | str, precision: Column | str) -> Column:
    """By type: an option's text, an integer, a float to the precision, or the text."""
    e, q, a = strip(extraction), col(question_type), col(answer_type)
    letter = F.upper(F.regexp_extract(e, r"\(([a-zA-Z])\)", 1))
    e = F.when(letter != "", letter).otherwise(e)
    place = F.ascii(e) - 65
    by_letter = F.when((F.char_length(e) == 1) & place.between(0, F.size(choices) - 1), F.get(choices, place))
    return F.when(q == "multi_choice", F.coalesce(by_letter, nearest_option(e, choices))).when(a == "integer", number(e).cast("long").cast("string")).when(a == "float", (F.bround(number(e) * F.pow(F.lit(10.0), col(precision))).cast("double") / F.pow(F.lit(10.0), col(precision))).cast("string")).otherwise(e)


def rule_extraction(response: Column | str, choices: Column, question_type: Column | str, answer_type: Column | str) -> Column:
    """The answer where a rule finds it: empty, exactly an option, an integer, a float, or after "Answer:"; else null."""
    r = strip(response)
    exact = F.when((col(question_type) == "multi_choice") & F.array_contains(choices, r), r)
    whole = F.when((col(answer_type) == "integer") & r.rlike(r"^[+-]?\d+$"), r)
    real = F.when((col(answer_type) == "float") & number(r).isNotNull(), r)
    found = final_answer(r)
    return F.when(r == "", "").otherwise(F.coalesce(exact, whole, real, F.when(found != r, found)))


def yes_no_other(pred: Column | str) -> Column:
    """Exactly yes or no, else by the first four characters, else other."""
    p = F.lower(strip(pred))
    first = F.left(p, F.lit(4))
    return F.when(p.isin("yes", "no"), p).when(contains(first, "yes"), "yes").when(contains(first, "no"), "no").otherwise("other")


def yes_no_sentence(text: Column | str) -> Column:
    """No where the first sentence holds the word No, not or no, yes otherwise."""
    first = F.replace(before_first(col(text), "."), F.lit(","), F.lit(""))
    return F.when(F.arrays_overlap(F.split(first, " "), F.array(*map(F.lit, ["No", "not", "no"]))), "no").otherwise("yes")


def yes_no_clean(text: Column | str) -> Column:
    """One line; Chinese yes and no, true and false to yes and no; other Chinese characters out."""
    t = F.lower(F.replace(F.replace(col(text), F.lit("\n"), F.lit(" ")), F.lit("\t"), F.lit(" ")))
    for a, b in (("是", "yes"), ("否", "no"), ("true", "yes"), ("false", "no")):
        t = F.replace(t, F.lit(a), F.lit(b))
    return strip(F.regexp_replace(t, "[一-龥]", ""))


def first_statement(text: Column | str) -> Column:
    """Up to the first newline, else up to the first period."""
    t = strip(text)
    return F.when(contains(t, "\n"), before_first(t, "\n")).otherwise(before_first(t, "."))


def first_integer(text: Column | str) -> Column:
    """The first whole number, or the first number word's value; null without either."""
    t = F.lower(col(text))
    digits = F.regexp_extract(t, r"\d+", 0)
    named = F.get(F.filter(F.transform(words(t), lambda w: F.element_at(_map(NUMBERS), w)), lambda w: w.isNotNull()), F.lit(0))
    return F.when(digits != "", digits).otherwise(named).try_cast("long")


def edit_similarity(pred: Column, truth: Column) -> Column:
    """1 - distance of the squeezed lower texts / length of the longer raw text; 1 where both are empty."""
    distance = F.levenshtein(squeeze(F.lower(pred)), squeeze(F.lower(truth)))
    return F.coalesce(1 - F.try_divide(distance.cast("double"), F.greatest(F.char_length(pred), F.char_length(truth)).cast("double")), F.lit(1.0))


def anls(pred: Column | str, truths: Column, threshold: float = 0.5) -> Column:
    """The best similarity to a truth, 0 below the threshold."""
    best = F.array_max(F.transform(truths, lambda t: edit_similarity(col(pred), t)))
    return F.when(best < threshold, 0.0).otherwise(best)


def anls_scene(pred: Column | str, truths: Column, threshold: float = 0.5) -> Column:
    """Distance and length both on the stripped lower texts."""
    p = F.lower(strip(pred))

    def one(t: Column) -> Column:
        t = F.lower(strip(t))
        return F.coalesce(1 - F.try_divide(F.levenshtein(p, t).cast("double"), F.greatest(F.char_length(p), F.char_length(t)).cast("double")), F.lit(1.0))

    best = F.array_max(F.transform(truths, one))
    return F.when(best >= threshold, best).otherwise(0.0)


def _percent(c: Column, divided: bool) -> Column:
    value = number(F.regexp_replace(c, "%+$", ""))
    return F.when(c.endswith("%"), value / 100 if divided else value).otherwise(number(c))


def relaxed_match(truth: Column | str, pred: Column | str, variant: str = "percent", tolerance: float = 0.05) -> Column:
    """Numbers within the tolerance of the truth, other texts equal in any case.

    percent: % divides by 100. plain: % is no number, and a truth near 0 asks for a prediction near 0. year: % is dropped,
    and a truth of four characters that starts with 20 must be equal.
    """
    t, p = col(truth), col(pred)
    equal = F.lower(t) == F.lower(p)
    if variant == "plain":
        a, b = number(t), number(p)
        near = F.when(F.abs(a) < 1e-9, F.abs(b) < 1e-9).otherwise(F.abs(F.try_divide(b - a, a)) <= tolerance)
        return F.when(a.isNotNull() & b.isNotNull(), near).otherwise(equal)
    a, b = _percent(t, variant == "percent"), _percent(p, variant == "percent")
    close = F.when(a.isNotNull() & (a != 0) & b.isNotNull(), F.abs(b - a) / F.abs(a) <= tolerance).otherwise(equal)
    return F.when((F.char_length(t) == 4) & t.startswith("20"), equal).otherwise(close) if variant == "year" else close


# Units that the numeric grader drops.
UNITS = ["degrees", "degree", "\\angle", "°", "%", "cm"]


def math_match(pred: Column | str, truth: Column | str, tolerance: float = 1e-3) -> Column:
    """Numbers without their units within a relative error, other texts equal in any case."""

    def bare(c: Column) -> Column:
        for u in UNITS:
            c = F.replace(c, F.lit(u), F.lit(""))
        return number(c)

    p, t = col(pred), col(truth)
    a, b = bare(t), bare(p)
    return F.when(a.isNotNull() & (a != 0) & b.isNotNull(), F.abs(b - a) / F.abs(a) <= tolerance).otherwise(F.lower(p) == F.lower(t))


def choice_match(pred: Column | str, truth: Column | str) -> Column:
    """Equal, or equal once the prediction's A. or (A) form is reduced to its letter."""
    p, t = F.lower(strip(pred)), F.lower(strip(truth))
    letter = F.when((F.char_length(p) >= 2) & (char_at(p, 2) == "."), char_at(p, 1)).when(p.rlike(r"^\(.\)"), char_at(p, 2))
    return (p == t) | F.coalesce(letter == t, F.lit(False))


def vqa_consensus(pred: Column, truths: Column) -> Column:
    """Score against ten answers with each left out in turn: with m matches, (m * min(1, (m-1)/3) + (10-m) * min(1, m/3)) / 10."""
    m = F.size(F.filter(truths, lambda t: t == pred))
    one = F.lit(1.0)
    score = (m * F.least(one, (m - 1) / 3) + (10 - m) * F.least(one, m / 3)) / 10
    return F.when(m == 0, 0.0).otherwise(score)


# Dataset-name keywords that choose the graders.
MODE_KEYWORDS = [
    (["chartqa"], ["relaxed"]),
    (["docvqa", "infographics"], ["anls"]),
    (["SROIE", "CLEVR_math", "geos", "geometry"], ["relaxed", "vqa", "choice"]),
]
DEFAULT_MODES = ["vqa", "choice", "math"]


def grading_modes(dataset: Column | str) -> Column:
    """Graders of a dataset by keywords of its name. Symbolic graders are not built."""
    d = col(dataset)
    out = F.array(*map(F.lit, DEFAULT_MODES))
    for keywords, modes in reversed(MODE_KEYWORDS):
        hit = F.lit(False)
        for k in keywords:
            hit = hit | contains(d, k)
        out = F.when(hit, F.array(*map(F.lit, modes))).otherwise(out)
    return out


def check_answer(pred: Column | str, truth: Column | str, modes: Column, compat: bool = False) -> Column:
    """1 where the answers are equal in any case or a grader gives more than 0.9, else 0.

    In compat mode the edit grader scores distance / length, so that very different texts pass.
    """
    p, t = col(pred), col(truth)
    on = lambda m: F.array_contains(modes, m)
    np_, nt = normalize_answer(p), normalize_answer(t)
    vqa = F.when((np_ != "") & (nt != "") & (np_ == nt), 1.0).otherwise(0.0)
    distance = F.try_divide(F.levenshtein(squeeze(F.lower(t)), squeeze(F.lower(p))).cast("double"), F.greatest(F.char_length(t), F.char_length(p)).cast("double"))
    edit = distance if compat else 1 - distance
    yes = lambda c: c.cast("double")
    score = F.greatest(
        F.when(on("vqa"), vqa).otherwise(0.0),
        F.when(on("relaxed"), yes(relaxed_match(t, p, "year"))).otherwise(0.0),
        F.when(on("anls"), F.coalesce(edit, F.lit(0.0))).otherwise(0.0),
        F.when(on("choice"), yes(choice_match(p, t))).otherwise(0.0),
        F.when(on("math"), yes(math_match(p, t))).otherwise(0.0),
    )
    return F.when(F.lower(p) == F.lower(t), 1).when(score > 0.9, 1).otherwise(0)


def fix_answer(response: Column | str, pred: Column | str, truth: Column | str) -> Column:
    """The response with its last predicted answer replaced by the truth, where the prediction contains it."""
    r, p, t = col(response), col(pred), col(truth)
    low_p, low_t = F.lower(p), F.lower(t)
    bare = lambda c: F.replace(F.btrim(c, F.lit(".")), F.lit(","), F.lit(""))
    option = F.upper(t).rlike("^[A-Z]$")
    holds = F.when(option, F.coalesce(strict_option(p) == F.upper(t), F.lit(False))).otherwise(contains(low_p, low_t) | contains(bare(low_p), bare(low_t)))
    place = _last_place(r, p)
    swapped = strip(strip_star(strip(F.concat(F.left(r, place), t, F.substr(r, place + F.char_length(p) + 1)))))
    out = F.when(holds & contains(r, p) & (p != ""), swapped).otherwise(r)
    last = F.substring_index(out, "\n", -1)
    return F.when(contains(out, "\n") & contains(last, "**Final"), strip(F.concat(F.left(out, F.char_length(out) - F.char_length(last)), F.replace(last, F.lit("**Final"), F.lit("Final"))))).otherwise(out)


def needs_latex(text: Column | str) -> Column:
    return contains(col(text), "\\") | col(text).rlike(r"^\s*\d+\s*/\s*\d+\s*$")


def count_bucket(text: Column | str, compat: bool = False) -> Column:
    """0, 1 to 100, 101 to 1000, above: as 0 to 3. In compat mode, any m and 2 at the end go with the unit."""
    t = F.regexp_replace(strip(text), "[m2]+$" if compat else "m2$", "")
    n = number(t)
    return F.when(n.isNull(), None).when(n <= 0, 0).when(n <= 100, 1).when(n <= 1000, 2).otherwise(3)


def option_contained(pred: Column | str, truth: Column | str) -> Column:
    """Whether the first words, or the rest, of prediction and truth contain one another."""
    p = F.replace(F.lower(col(pred)), F.lit("answer: "), F.lit(""))
    t = F.lower(col(truth))
    po, to = F.replace(F.substring_index(p, " ", 1), F.lit("."), F.lit("")), F.substring_index(t, " ", 1)
    rest = F.btrim(F.substr(t, F.char_length(to) + F.lit(2)), F.lit(" ."))
    return contains(to, po) | contains(po, F.btrim(to, F.lit("()."))) | ((rest != "") & contains(p, rest))


def choice_correct(pred: Column | str, truth: Column | str, options: Column) -> Column:
    """Whether a prediction is the truth's letter or its option text; (A) stands for A."""
    p, t = strip(pred), strip(truth)
    p = F.when(p.rlike(r"^\([A-Za-z]\)"), char_at(p, 2)).otherwise(p)
    place = F.ascii(F.upper(t)) - 65
    text = F.when((F.char_length(t) == 1) & (place >= 0), F.get(options, place))
    return (F.upper(p) == F.upper(t)) | F.coalesce(F.lower(p) == F.lower(text), F.lit(False))


def has_word(text: Column | str, word: Column | str) -> Column:
    """Whether ``word`` stands in the text between word boundaries."""
    return F.regexp_like(F.lower(col(text)), F.concat(F.lit(r"\b\Q"), F.lower(col(word)), F.lit(r"\E\b")))


def reciprocal_rank(pred: Column | str, truths: Column) -> Column:
    """1 / place of the first truth that the prediction holds as a word; 0 without one."""
    place = F.array_position(F.transform(truths, lambda t: has_word(pred, t)), True)
    return F.when(place > 0, 1 / place).otherwise(0.0)


def judge_scores(reply: Column | str) -> Column:
    """Two numbers on the first line as an array, (-1, -1) where there aren't two."""
    parts = words(F.replace(before_first(col(reply), "\n"), F.lit(","), F.lit(" ")))
    a, b = number(F.get(parts, F.lit(0))), number(F.get(parts, F.lit(1)))
    return F.when((F.size(parts) == 2) & a.isNotNull() & b.isNotNull(), F.array(a, b)).otherwise(F.array(F.lit(-1.0), F.lit(-1.0)))


def judge_rating(reply: Column | str) -> Column:
    """The one rating of 0 to 6 that the reply gives, 0 where it gives none or several."""
    found = F.array_distinct(F.regexp_extract_all(F.lower(col(reply)), F.lit(r"rating: ([0-6])"), F.lit(1)))
    return F.when(F.size(found) == 1, F.get(found, F.lit(0)).cast("int")).otherwise(0)


def judge_prompt(context: Column, question: Column, first: Column, second: Column, rule: Column) -> Column:
    return F.concat(F.lit("[Context]\n"), context, F.lit("\n\n[Question]\n"), question, F.lit("\n\n[Assistant 1]\n"), first, F.lit("\n\n[End of Assistant 1]\n\n[Assistant 2]\n"), second, F.lit("\n\n[End of Assistant 2]\n\n[System]\n"), rule, F.lit("\n\n"))


def category_of_id(name: Column | str) -> Column:
    """The middle parts of a name such as split_Category_Name_12."""
    parts = F.split(col(name), "_", -1)
    return F.array_join(F.slice(parts, 2, F.greatest(F.size(parts) - 2, F.lit(0))), "_")


def image_references(text: Column | str) -> Column:
    """Paths inside <img='...'> marks."""
    return F.regexp_extract_all(col(text), F.lit("<img='(.*?)'>"), F.lit(1))


def one_image_mark(text: Column | str) -> Column:
    return F.regexp_replace(col(text), "<image [1-7]>", "<image>")


def leaderboard_clean(answer: Column | str) -> Column:
    return F.lower(F.regexp_replace(strip(answer), r"\.+$", ""))


def first_part_equals(response: Column | str, truth: Column | str) -> Column:
    """Whether the part before the first comma is the truth, in lower case and without periods."""
    first = F.replace(F.lower(strip(before_first(col(response), ","))), F.lit("."), F.lit(""))
    return first == F.lower(strip(truth))


def options_map(options: Column) -> Column:
    """Letter to text."""
    return F.map_from_arrays(F.transform(options, lambda o, i: F.char(i + 65)), options)


def option_prompt(question: Column | str, options: Column, layout: str = "letter_dot", instruction: str = "") -> Column:
    """A question with its options, a line each: "A. text", "(A) text" or "A: text"."""
    before, after = {"letter_dot": ("", ". "), "bracket": ("(", ") "), "colon": ("", ": ")}[layout]
    lines = F.transform(options, lambda o, i: F.concat(F.lit(before), F.char(i + 65), F.lit(after), o))
    return F.concat(col(question), F.lit("\n"), F.array_join(lines, "\n"), F.lit("\n" + instruction if instruction else ""))
