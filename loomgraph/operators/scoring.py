"""Rule scoring of generated answers. Everything but brace matching is a column expression."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from loomgraph.functions.columns import let, quote_regex, squeeze, strip

# fixed values: characters of a solution that are looked at
TAIL_CHARS = 300

# fixed values: ASCII punctuation
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"


def tail(c: Column, n: int = TAIL_CHARS) -> Column:
    return F.when(F.length(c) > n, F.substring(c, -n, n)).otherwise(c)


def final_number(c: Column, method: str = "strict") -> Column:
    """Last `#### n` of the tail (strict), or its last number (flexible); null if none."""
    text = tail(c)
    if method == "strict":
        hits = F.regexp_extract_all(text, F.lit(r"#### (-?[0-9.,]+)"), F.lit(1))
        return let(hits, lambda h: F.regexp_replace(F.try_element_at(h, F.lit(-1)), r"[,$]", ""))
    hits = F.regexp_extract_all(text, F.lit(r"(-?[0-9.,]+)"), F.lit(1))

    def pick(h: Column) -> Column:
        good = F.try_element_at(F.filter(h, lambda x: ~x.isin("", ".")), F.lit(-1))
        return F.when(F.size(h) > 0, F.coalesce(good, h[0]))

    return let(hits, pick)


def final_number_score(c: Column, truth: Column, method: str = "strict", format_score: float = 0.0) -> Column:
    """1 for the right number, the format score for another number, 0 for none."""
    return let(
        final_number(c, method),
        lambda a: F.when(a.isNull(), 0.0).when(a == truth, 1.0).otherwise(format_score),
    )


def normal_answer(c: Column) -> Column:
    """Lower case, no punctuation, no articles, single blanks."""
    s = F.translate(F.lower(c), PUNCTUATION, "")
    return squeeze(F.regexp_replace(s, r"\b(a|an|the)\b", " "))


def tagged_answer(c: Column) -> Column:
    """Content of the last answer tag, trimmed; null without one."""
    hits = F.regexp_extract_all(c, F.lit(r"(?s)<answer>(.*?)</answer>"), F.lit(1))
    return let(hits, lambda h: strip(F.try_element_at(h, F.lit(-1))))


def tagged_answer_score(c: Column, golds: Column, substring: bool = False, format_score: float = 0.0) -> Column:
    """Normalised match of the last tagged answer with one of the golds; many tags quarter the score."""
    opened = F.regexp_count(c, F.lit("<answer>"))
    closed = F.regexp_count(c, F.lit("</answer>"))

    def score(a: Column) -> Column:
        norm = normal_answer(a)
        hit = let(
            norm,
            lambda n: F.exists(golds, lambda g: F.contains(n, normal_answer(g)) if substring else n == normal_answer(g)),
        )
        full = F.when((opened > 10) | (closed > 10), 0.25).otherwise(1.0)
        return F.when(a.isNull(), 0.0).when(hit, full).otherwise(format_score)

    return let(tagged_answer(c), score)


@F.pandas_udf(StringType())
def boxed_answer(texts: pd.Series) -> pd.Series:
    """Content of the last boxed expression with balanced braces; null if there is none."""

    def content(s: str | None) -> str | None:
        if s is None:
            return None
        if "\\boxed " in s:
            return s.rsplit("\\boxed ", 1)[1].split("$")[0]
        start = s.rfind("\\boxed{")
        if start < 0:
            return None
        depth = 0
        for i in range(start + 6, len(s)):
            depth += (s[i] == "{") - (s[i] == "}")
            if depth == 0:
                return s[start + 7 : i]
        return None

    return texts.map(content)


# fixed values: ordered (pattern, replacement) rules of the math answer form
MATH_RULES = [
    (r"\n", ""),
    (r"\\!", ""),
    (r"\\\\", r"\\"),
    (r"[td]frac", "frac"),
    (r"\\left|\\right", ""),
    (r"\^\{\\circ\}|\^\\circ", ""),
    (r"\\\$", ""),
    (r"\\text\{ .*$", ""),
    (r"\\?\\%", ""),
    (r" \.", " 0."),
    (r"\{\.", "{0."),
    (r"^\.", "0."),
    (r"^[^=]{0,2}=([^=]*)$", "$1"),
    (r"\\sqrt([^{])", r"\\sqrt{$1}"),
    (r" ", ""),
    (r"\\frac([^{])([^{])", r"\\frac{$1}{$2}"),
    (r"\\frac([^{])\{", r"\\frac{$1}{"),
    (r"^0\.5$", r"\\frac{1}{2}"),
    (r"^(-?\d+)/(-?\d+)$", r"\\frac{$1}{$2}"),
]


def math_form(c: Column) -> Column:
    """Comparable form of a math answer."""
    for pattern, replacement in MATH_RULES:
        c = F.regexp_replace(c, pattern, replacement)
    return c


def boxed_score(c: Column, truth: Column) -> Column:
    answer = boxed_answer(c)
    return F.when(F.coalesce(math_form(answer) == math_form(truth), F.lit(False)), 1.0).otherwise(0.0)


# fixed values: replacements and removed words of the final answer form
ANSWER_SUBSTITUTIONS = [
    ("an ", ""), ("a ", ""), (".$", "$"), ("\\$", ""), ("\\ ", ""), (" ", ""), ("mbox", "text"),
    (",\\text{and}", ","), ("\\text{and}", ","), ("\\text{m}", "\\text{}"),
]
ANSWER_REMOVALS = [
    "square", "ways", "integers", "dollars", "mph", "inches", "hours", "km", "units", "\\ldots", "sue", "points",
    "feet", "minutes", "digits", "cents", "degrees", "cm", "gm", "pounds", "meters", "meals", "edges", "students",
    "childrentickets", "multiples", "\\text{s}", "\\text{.}", "\\text{\ns}", "\\text{}^2", "\\text{}^3",
    "\\text{\n}", "\\text{}", "\\mathrm{th}", "^\\circ", "^{\\circ}", "\\;", ",\\!", "{,}", "\"", "\\dots",
]
# fixed values: ordered patterns applied after the replacements
ANSWER_PATTERNS = [
    (r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$"),
    (r"(\\text\{)(.*?)(\})", "$2"),
    (r"(\\textbf\{)(.*?)(\})", "$2"),
    (r"(\\overline\{)(.*?)(\})", "$2"),
    (r"(\\boxed\{)(.*)(\})", "$2"),
    (r"(frac)([^{])(.)", "frac{$2}{$3}"),
    (r"(sqrt)([^{])", "sqrt{$2}"),
    (r"\$", ""),
]


def final_answer_form(c: Column) -> Column:
    c = F.element_at(F.split(c, "="), -1)
    for before, after in ANSWER_SUBSTITUTIONS:
        c = F.regexp_replace(c, quote_regex(before), after.replace("\\", "\\\\").replace("$", "\\$"))
    for word in ANSWER_REMOVALS:
        c = F.regexp_replace(c, quote_regex(word), "")
    for pattern, replacement in ANSWER_PATTERNS:
        c = F.regexp_replace(c, pattern, replacement)
    bare = let(c, lambda x: F.when(F.regexp_replace(x, ",", "").rlike(r"^\d+$"), F.regexp_replace(x, ",", "")).otherwise(x))
    return strip(bare)


def final_answer(c: Column) -> Column:
    """Text after the last `Answer:` in the tail."""
    hits = F.regexp_extract_all(tail(c), F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), F.lit(1))
    return let(hits, lambda h: F.coalesce(F.try_element_at(h, F.lit(-1)), F.lit("[INVALID]")))


def final_answer_score(c: Column, truth: Column) -> Column:
    """+1 when the normalised final answer is the truth, else -1."""
    same = final_answer_form(final_answer(c)) == final_answer_form(truth)
    return F.when(F.coalesce(same, F.lit(False)), 1.0).otherwise(-1.0)


def choice_score(c: Column, truth: Column) -> Column:
    """Letter of a multiple-choice answer."""
    letter = F.regexp_extract(c, r"(?i)Answer[ \t]*:[ \t]*\$?([A-D])\$?", 1)
    return F.when(letter == truth, 1.0).otherwise(0.0)


def format_score(c: Column) -> Column:
    return F.when(c.rlike(r"(?s)\A<think>.*</think>.*\\boxed\{.*\}.*\z"), 1.0).otherwise(0.0)


def blended_score(c: Column, truth: Column, weight: float = 0.1) -> Column:
    """Accuracy and format blended; the format counts `weight`."""
    return (1 - weight) * boxed_score(c, truth) + weight * format_score(c)


def turn_words(messages: Column, prompt_turns: Column, text: str = "content") -> Column:
    """Words in the turns after the prompt."""
    later = F.slice(messages, prompt_turns + 1, F.greatest(F.size(messages), F.lit(1)))
    return F.aggregate(
        later, F.lit(0), lambda n, m: n + F.size(F.filter(F.split(m[text], r"\s+"), lambda w: w != ""))
    )


# fixed values: data sources and the scorer each is routed to
NUMBER_SOURCES = ["openai/gsm8k"]
BOXED_SOURCES = ["lighteval/MATH", "DigitalLearningGmbH/MATH-lighteval", "HuggingFaceH4/MATH-500"]
ANSWER_SOURCES = ["math_dapo", "math", "math_dapo_reasoning"]
BLENDED_SOURCES = ["hiyouga/geometry3k"]
TAGGED_SOURCES = [
    "searchR1_nq", "searchR1_triviaqa", "searchR1_popqa", "searchR1_hotpotqa", "searchR1_2wikimultihopqa",
    "searchR1_musique", "searchR1_bamboogle",
]


def routed_score(source: Column, solution: Column, truth: Column) -> Column:
    """Score by data source; an unknown source is an error."""
    unknown = F.raise_error(F.concat(F.lit("no reward for data source "), source)).cast("double")
    return (
        F.when(source.isin(NUMBER_SOURCES), final_number_score(solution, truth))
        .when(source.isin(BOXED_SOURCES), boxed_score(solution, truth))
        .when(source.isin(ANSWER_SOURCES) | source.startswith("aime"), final_answer_score(solution, truth))
        .when(source.isin(BLENDED_SOURCES), blended_score(solution, truth))
        .when(source.isin(TAGGED_SOURCES), tagged_answer_score(solution, F.array(truth)))
        .otherwise(unknown)
    )
