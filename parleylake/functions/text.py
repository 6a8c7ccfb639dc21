"""Text functions as column expressions; Arrow UDFs only where Python's own semantics are the definition."""

from __future__ import annotations

import difflib
import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StringType

#: ASCII white space: the one rule that Spark, DuckDB and Python agree on without flags.
BLANK = r"[ \t\n\r\f\x0B]+"


def normalize(text: Column | str) -> Column:
    """Runs of ASCII blanks as one space, trimmed, lower case."""
    return F.lower(F.trim(F.regexp_replace(text, BLANK, " ")))


@F.pandas_udf(StringType())
def normalize_exact(text: pd.Series) -> pd.Series:
    """Unicode white space and casefold, as Python defines them ("ß" becomes "ss")."""
    return text.map(lambda t: None if t is None else " ".join(t.split()).casefold())


def normalize_words(text: Column | str) -> Column:
    """Lower case, everything but word characters as blanks, collapsed."""
    return F.trim(F.regexp_replace(F.lower(text), r"(?U)[^\w]+", " "))


def sha(text: Column | str) -> Column:
    return F.sha2(text, 256)


def char_ngrams(text: Column | str, n: int = 5) -> Column:
    """Distinct character n-grams; none where the text is shorter. One pass: a look-ahead at every place."""
    return F.array_distinct(F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1)))


def word_ngrams(words: Column, n: int) -> Column:
    """Word n-grams in order, one for each place. ``words`` is a column of its own: an expression would be evaluated at every place."""
    grams = F.transform(F.sequence(F.lit(1), F.greatest(F.size(words) - (n - 1), F.lit(1))), lambda i: F.array_join(F.slice(words, i, n), " "))
    return F.when(F.size(words) >= n, grams).otherwise(F.array().cast("array<string>"))


def text_word_ngrams(text: Column | str, n: int) -> Column:
    """``word_ngrams`` of the pieces between single blanks, one for each place. One pass: a look-ahead where a piece begins."""
    return F.regexp_extract_all(text, F.lit(f"(?:^|(?<= ))(?=([^ ]*+(?: [^ ]*+){{{n - 1}}}))"), F.lit(1))


def jaccard(left: Column, right: Column) -> Column:
    """Set Jaccard; two empty sets are alike."""
    shared, union = F.size(F.array_intersect(left, right)), F.size(F.array_union(left, right))
    return F.when(union == 0, F.lit(1.0)).otherwise(shared / union)


def minhash(grams: Column, permutations: int = 32) -> Column:
    """Least sha256 of permutation number and gram, as fixed-width hex; all zeros without grams."""
    least = F.transform(F.sequence(F.lit(0), F.lit(permutations - 1)), lambda i: F.array_min(F.transform(grams, lambda g: F.sha2(F.concat(i.cast("string"), g), 256))))
    return F.when(F.size(grams) > 0, least).otherwise(F.array_repeat(F.lit("0" * 64), permutations))


@F.pandas_udf(DoubleType())
def edit_similarity(left: pd.Series, right: pd.Series) -> pd.Series:
    """Ratcliff-Obershelp ratio of normalized texts."""
    def ratio(a, b):
        return difflib.SequenceMatcher(None, " ".join((a or "").split()).casefold(), " ".join((b or "").split()).casefold()).ratio()

    return pd.Series([ratio(a, b) for a, b in zip(left, right, strict=True)], dtype=float)


@F.pandas_udf(StringType())
def stable_json(values: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """Canonical JSON of a JSON text: sorted keys, compact, non-ASCII kept; null where it does not parse."""

    def one(raw):
        try:
            return json.dumps(json.loads(raw), sort_keys=True, separators=(",", ":"), ensure_ascii=False, allow_nan=False)
        except (TypeError, ValueError):
            return None

    for series in values:
        yield series.map(one)


# The refusal patterns (name, expression), tried in this order on the first 400 characters.
REFUSAL_WINDOW = 400
REFUSAL_PATTERNS: tuple[tuple[str, str], ...] = (
    ("apology_inability", r"\b(?:apologies|i\s+apologi[sz]e|i'?m\s+sorry|i\s+am\s+sorry|sorry)\b[^.]{0,90}?\b(?:unable|cannot|can'?t|not\s+able|don'?t\s+have\s+the\s+abilit)"),
    ("leading_unable", r"^\s*(?:i'?m|i\s+am)\s+(?:unable|not\s+able)\s+to\b"),
    ("leading_cannot", r"^\s*i\s+(?:cannot|can'?t)\s+(?:help|assist|do|perform|answer|provide|complete|comply|solve|calculate)\b"),
    ("as_an_ai", r"\bas\s+an\s+ai\b[^.]{0,80}?\b(?:cannot|can'?t|unable|do\s+not\s+have)"),
    ("no_capability", r"\bi\s+(?:do\s+not|don'?t)\s+have\s+the\s+(?:abilit|capabilit|capacity)"),
    ("decline_to", r"^\s*i\s+(?:must\s+)?(?:decline|refuse)\b"),
    ("unable_to_perform", r"\b(?:unable|not\s+able)\s+to\s+(?:perform|carry\s+out|execute|do)\s+(?:calculations?|computations?|math|arithmetic)\b"),
)


def refusal(text: Column | str, patterns=None) -> Column:
    """Name of the first refusal pattern in the text's beginning, else null."""
    column = F.col(text) if isinstance(text, str) else text
    window = F.substr(column, F.lit(1), F.lit(REFUSAL_WINDOW))
    found = F.lit(None).cast("string")
    for name, pattern in reversed(patterns if patterns is not None else REFUSAL_PATTERNS):
        found = F.when(window.rlike("(?im)" + pattern), F.lit(name)).otherwise(found)
    return found


def refusal_template(text: Column | str, words: int = 12) -> Column:
    """First words of the lower-case text, letters and blanks only."""
    letters = F.trim(F.regexp_replace(F.regexp_replace(F.lower(text), r"[^a-z ]", " "), " +", " "))
    return F.array_join(F.slice(F.split(letters, " "), 1, words), " ")


def last_match(text: Column | str, pattern: str, group: int = 1) -> Column:
    """The last match's group, null without one."""
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), F.lit(-1))


def gsm8k_answer(text: Column | str) -> Column:
    """Number after ####, else of "answer is", else the last number; commas and a closing point dropped."""
    number = r"(-?\$?[0-9][0-9,]*(?:\.[0-9]+)?)"
    raw = F.coalesce(last_match(text, r"####\s*" + number), last_match(text, r"(?i)answer is:?\s*" + number), last_match(text, number))
    return F.regexp_replace(raw, r"[$,]", "").cast("decimal(38,10)")


def choice_letter(text: Column | str) -> Column:
    """Multiple-choice letter A-J: after "answer is", after "answer:", else the last lone letter."""
    return F.upper(F.coalesce(last_match(text, r"(?i)answer is \(?([A-J])\)?"), last_match(text, r"(?i)answer:\s*\(?([A-J])\)?"), last_match(text, r"\b([A-J])\b")))


def loose_variants(response: Column | str) -> Column:
    """Eight readings of a response: without first, last or both lines, each with and without asterisks."""
    lines = F.split(response, "\n", -1)
    size = F.size(lines)
    cuts = [
        F.col(response) if isinstance(response, str) else response,
        F.trim(F.array_join(F.slice(lines, 2, F.greatest(size - 1, F.lit(0))), "\n")),
        F.trim(F.array_join(F.slice(lines, 1, F.greatest(size - 1, F.lit(0))), "\n")),
        F.trim(F.array_join(F.slice(lines, 2, F.greatest(size - 2, F.lit(0))), "\n")),
    ]
    return F.array(*cuts, *(F.replace(c, F.lit("*"), F.lit("")) for c in cuts))


def skeleton(response: Column, tool_names: Column) -> Column:
    """The reply's shape: tool names, quoted strings and numbers as placeholders."""
    named = F.aggregate(F.array_sort(F.transform(tool_names, lambda t: F.struct((-F.length(t)).alias("n"), F.lower(t).alias("t")))), F.lower(response), lambda acc, t: F.replace(acc, t["t"], F.lit("<tool>")))
    return F.regexp_replace(F.regexp_replace(named, r"\"[^\"]*\"|'[^']*'", "<q>"), r"[0-9]+(?:\.[0-9]+)?", "<n>")


def redact(text: Column | str) -> Column:
    """Keys, mail addresses and home folders replaced by marks."""
    for pattern, mark in ((r"(?i)(api[_-]?key|token|secret)\s*[:=]\s*\S+", "$1=<redacted>"), (r"[\w.+-]+@[\w-]+\.[\w.]+", "<mail>"), (r"/(?:home|Users)/[^/\s]+", "/<home>")):
        text = F.regexp_replace(text, pattern, mark)
    return text


def past_years(text: Column | str, now: int, first: int = 1900) -> Column:
    """True if the text names a year from ``first`` to ``now``."""
    years = F.regexp_extract_all(text, F.lit(r"\b([12][0-9]{3})\b"), F.lit(1))
    return F.exists(years, lambda y: y.cast("int").between(first, now))


def rank_key(seed: str, stratum: Column | str, ident: Column | str) -> Column:
    """Hash rank of a unit of a stratum."""
    return F.sha2(F.concat_ws("|", F.lit(seed), stratum, F.col(ident).cast("string") if isinstance(ident, str) else ident.cast("string")), 256)


def order_key(seed: str, ident: Column | str) -> Column:
    """Hash of presentation order."""
    return F.sha2(F.concat_ws(":", F.lit(seed), F.lit("order"), F.col(ident).cast("string") if isinstance(ident, str) else ident.cast("string")), 256)


def reason_head(message: Column | str, length: int = 80) -> Column:
    """A message with its numbers masked, cut: what equal failures have in common."""
    return F.substr(F.regexp_replace(message, "[0-9]+", "N"), F.lit(1), F.lit(length))


def get_path(json_text: Column | str, path: str) -> Column:
    """Value at a dotted path through a JSON text (``a.b.0``, ``a.-1`` from the end), null where it is missing."""
    steps = path.split(".")
    value = F.col(json_text) if isinstance(json_text, str) else json_text
    run: list[str] = []
    for step in [*steps, None]:
        backwards = step is not None and step.startswith("-") and step[1:].isdigit()
        if step is not None and not backwards:
            run.append(f"[{step}]" if step.isdigit() else f".{step}")
            continue
        if run:
            value = F.get_json_object(value, "$" + "".join(run))
            run = []
        if backwards:
            # counted from the end: elements stay JSON texts until the path ends
            length = F.json_array_length(value)
            place = F.concat(F.lit("$["), (length + int(step)).cast("string"), F.lit("]"))
            value = F.when(length >= -int(step), F.call_function("get_json_object", value, place))
    return value
