"""Answer extraction and matching for question answering and maths."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from trailmark.functions import constants as K
from trailmark.functions import text as X
from trailmark.functions.core import let

PUNCTUATION = r"""!"#$%&'()*+,-./:;<=>?@[\]^_`{|}~"""


def normalize_answer(text: Column) -> Column:
    """Lower case without punctuation, articles and extra white space."""
    bare = F.translate(F.lower(text), PUNCTUATION, "")
    no_articles = F.regexp_replace(bare, r"(?U)\b(a|an|the)\b", " ")
    return X.strip(F.regexp_replace(no_articles, r"(?U)\s+", " "))


def last_answer(text: Column) -> Column:
    return X.strip(X.last_match(text, X.ANSWER))


def qa_exact(text: Column, golden: Column, format_score: float = 0.0, score: float = 1.0) -> Column:
    """Score when the last answer equals any golden answer; a quarter of it when tags are spammed."""
    answer = last_answer(text)
    hit = F.exists(golden, lambda g: normalize_answer(g) == normalize_answer(answer))
    spam = (X.count_of(text, "<answer>") > 10) | (X.count_of(text, "</answer>") > 10)
    return F.when(answer.isNull(), 0.0).when(hit & spam, score / 4).when(hit, score).otherwise(format_score)


def qa_contains(text: Column, golden: Column, format_score: float = 0.0, score: float = 1.0) -> Column:
    """Score when any golden answer occurs inside the last answer."""
    answer = last_answer(text)
    hit = F.exists(golden, lambda g: normalize_answer(answer).contains(normalize_answer(g)))
    return F.when(answer.isNull(), 0.0).when(hit, score).otherwise(format_score)


def tail(text: Column, n: int | None) -> Column:
    """The last n characters, or the whole text for None."""
    return F.right(text, F.lit(n)) if n else text


def final_number(text: Column, method: str = "strict", within: int | None = 300) -> Column:
    """Number after the last ``####`` (strict) or the last number (flexible) in the last ``within``
    characters (None: in the whole text)."""
    end = tail(text, within)
    if method == "strict":
        found = F.try_element_at(F.regexp_extract_all(end, F.lit(r"#### (\-?[0-9\.\,]+)"), F.lit(1)), F.lit(-1))
        return F.replace(found, F.lit(","), F.lit(""))
    found = F.regexp_extract_all(end, F.lit(r"(\-?[0-9\.\,]+)"), F.lit(1))
    usable = F.try_element_at(F.filter(found, lambda n: ~n.isin("", ".")), F.lit(-1))
    return F.coalesce(usable, F.try_element_at(found, F.lit(1)))


def number_score(text: Column, truth: Column, method: str = "strict", format_score: float = 0.0, score: float = 1.0) -> Column:
    answer = final_number(text, method)
    return F.when(answer.isNull(), 0.0).when(answer == truth, score).otherwise(format_score)


def normalize_math(answer: Column) -> Column:
    """A final maths answer without units, wrappers and white space, with short forms written out."""
    out = F.element_at(F.split(answer, "=", -1), -1)
    for before, after in K.MATH_SUBSTITUTIONS:
        out = F.replace(out, F.lit(before), F.lit(after))
    for expression in K.MATH_REMOVED:
        out = F.replace(out, F.lit(expression), F.lit(""))
    out = F.regexp_replace(out, r"(.*?)(\$)(.*?)(\$)(.*)", r"\$$3\$")
    for wrapper in ("text", "textbf", "overline"):
        out = F.regexp_replace(out, rf"(\\{wrapper}\{{)(.*?)(\}})", "$2")
    out = F.regexp_replace(out, r"(\\boxed\{)(.*)(\})", "$2")
    out = F.regexp_replace(out, r"(frac)([^{])(.)", "frac{$2}{$3}")
    out = F.regexp_replace(out, r"(sqrt)([^{])", "sqrt{$2}")
    out = F.replace(out, F.lit("$"), F.lit(""))
    plain = F.replace(out, F.lit(","), F.lit(""))
    return X.strip(F.when(plain.rlike(r"\A\d+\z"), plain).otherwise(out))


def math_line_prediction(text: Column, within: int | None = 300) -> Column:
    """Normalised text of the last ``Answer:`` line in the last ``within`` characters (None: in all)."""
    found = F.try_element_at(
        F.regexp_extract_all(tail(text, within), F.lit(r"(?i)Answer\s*:\s*([^\n]+)"), F.lit(1)), F.lit(-1)
    )
    return normalize_math(F.coalesce(found, F.lit("[INVALID]")))


def math_line_score(text: Column, truth: Column) -> Column:
    return F.when(math_line_prediction(text) == normalize_math(truth), 1.0).otherwise(-1.0)


def closing_brace(text: str, start: int) -> int:
    """Index of the brace that closes the first one from ``start``; -1 when it stays open."""
    depth = 0
    for i in range(start, len(text)):
        if text[i] == "{":
            depth += 1
        elif text[i] == "}":
            depth -= 1
            if depth == 0:
                return i
    return -1


def boxed_text(text: str | None) -> str | None:
    """Content of the last boxed expression; null without a complete one."""
    if text is None:
        return None
    spaced = "\\boxed "
    if spaced in text:
        return text.rsplit(spaced, 1)[1].split("$")[0]
    start = text.rfind("\\boxed")
    if start < 0 or not text.startswith("\\boxed{", start):
        return None
    end = closing_brace(text, start)
    return None if end < 0 else text[start + len("\\boxed{") : end]


def strict_boxed_text(text: str | None) -> str | None:
    if text is None:
        return None
    start = text.rfind("\\boxed{")
    end = closing_brace(text, start) if start >= 0 else -1
    return None if end < 0 else text[start + len("\\boxed{") : end]


def _enclosed(rest: Column) -> Column:
    """What stands between the brace that ``rest`` begins with and the one that closes it; null when it stays open."""
    upto = F.split(rest, r"\}", -1)
    start = F.struct(F.lit(0).alias("open"), F.lit(0).alias("at"), F.lit(None).cast("int").alias("end"))

    def close(found: Column, part: Column) -> Column:
        open_ = found.open + F.length(part) - F.length(F.replace(part, F.lit("{"), F.lit(""))) - 1
        at = found["at"] + F.length(part) + 1
        end = F.coalesce(found.end, F.when(open_ == 0, at))
        return F.struct(open_.alias("open"), at.alias("at"), end.alias("end"))

    closed = F.aggregate(F.slice(upto, F.lit(1), F.size(upto) - 1), start, close).end
    return let(closed, lambda end: F.substr(rest, F.lit(2), end - 2))


def boxed(text: Column, strict: bool = False) -> Column:
    """:func:`boxed_text`, or :func:`strict_boxed_text`, as an expression; it only looks at the text from the last box on."""
    after = "\\boxed{" if strict else "\\boxed"

    def inner(t: Column) -> Column:
        rest = F.substring_index(t, after, -1)
        if strict:
            rest = F.concat(F.lit("{"), rest)
        out = F.when(t.contains(after) & rest.startswith("{"), let(rest, _enclosed))
        if strict:
            return out
        spaced = "\\boxed "
        return F.when(t.contains(spaced), F.substring_index(F.substring_index(t, spaced, -1), "$", 1)).otherwise(out)

    return let(text, inner)


def _replace_all(text: Column, pairs: list[tuple[str, str]]) -> Column:
    for before, after in pairs:
        text = F.replace(text, F.lit(before), F.lit(after))
    return text


def _fractions(text: Column) -> Column:
    """Short fractions with braces; one without two parts leaves the text as it was."""
    both = F.regexp_replace(text, r"\\frac([^{])([^{])", r"\\frac{$1}{$2}")
    first = F.regexp_replace(both, r"\\frac([^{])(\{)", r"\\frac{$1}$2")
    return F.when(text.rlike(r"\\frac[^{\\]?(\z|\\frac)"), text).otherwise(first)


def clean_latex(text: Column) -> Column:
    """LaTeX text with spacing, sizing and units removed and fractions and roots written out."""
    def after_equals(t: Column) -> Column:
        sides = F.split(t, "=", -1)
        return F.when((F.size(sides) == 2) & (F.length(sides[0]) <= 2), F.try_element_at(sides, F.lit(2))).otherwise(t)

    slash = r"\A(-?(?:0|[1-9]\d*))/(-?(?:0|[1-9]\d*))\z"
    # A unit stands on the right.
    out = F.substring_index(_replace_all(text, K.LATEX_SPACING), "\\text{ ", 1)
    out = F.regexp_replace(_replace_all(out, K.LATEX_NUMBERS), r"\A\.", "0.")
    out = F.regexp_replace(let(out, after_equals), r"\\sqrt([^{])", r"\\sqrt{$1}")
    out = let(F.replace(out, F.lit(" "), F.lit("")), _fractions)
    out = F.regexp_replace(out, r"\A0\.5\z", r"\\frac{1}{2}")
    return F.regexp_replace(out, slash, r"\\frac{$1}{$2}")


def math_boxed_score(text: Column, truth: Column) -> Column:
    """1 when the boxed answer equals the truth after clean-up.

    A text with two units cannot be cleaned; then the texts themselves must be equal.
    """
    unit = "\\text{ "

    def same(answer: Column) -> Column:
        cleanable = (X.count_of(answer, unit) <= 1) & (X.count_of(truth, unit) <= 1)
        return F.when(cleanable, clean_latex(answer) == clean_latex(truth)).otherwise(answer == truth)

    return F.when(F.coalesce(let(boxed(text), same), F.lit(False)), 1.0).otherwise(0.0)


def strict_box_score(text: Column, truth: Column, within: int | None = 100) -> Column:
    """Plus or minus one by the boxed answer in the last ``within`` characters (None: in the whole text)."""
    return F.when(F.coalesce(boxed(tail(text, within), strict=True) == truth, F.lit(False)), 1.0).otherwise(-1.0)


def dispatch_score(source: Column, text: Column, truth: Column) -> Column:
    """Score by data source; an unknown source is an error."""
    line = source.isin(K.SCORER_SOURCES["math_line"]) | source.startswith(K.MATH_LINE_PREFIX)
    return (
        F.when(source.isin(K.SCORER_SOURCES["gsm8k"]), number_score(text, truth))
        .when(source.isin(K.SCORER_SOURCES["math_boxed"]), math_boxed_score(text, truth))
        .when(line, math_line_score(text, truth))
        .when(source.isin(K.SCORER_SOURCES["qa_em"]), qa_exact(text, F.array(truth)))
        .otherwise(F.raise_error(F.concat(F.lit("no scorer for data source "), source)).cast("double"))
    )
