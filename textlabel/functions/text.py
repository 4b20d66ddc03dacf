"""Column expressions on text. All but `has_any`, an Arrow function for plain terms, are built-in Spark functions and stay in the JVM."""

from __future__ import annotations

import re
from collections.abc import Callable, Sequence

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F

# A word keeps inner apostrophes and dots ("can't", "4.5"), and a number its inner commas ("1,000"). Java's \w is
# ASCII only, hence the classes. Repeated groups are possessive: a plain one recurses once for each repeat, and a
# text such as "a.a.a." of a few kilobytes would overflow the stack.
_RUN = r"[\p{L}\p{M}\p{N}_]"
_JOINED = rf"(?:['’.]{_RUN}+)*+"
WORD = rf"\p{{N}}+(?:,\p{{N}}+)++{_RUN}*{_JOINED}|{_RUN}+{_JOINED}"
# What `\w+` means to a Unicode-aware engine.
WORD_RUN = r"[\p{L}\p{M}\p{N}_]+"
# Each mark that is neither blank nor part of a word.
MARK = r"[^\s\p{L}\p{M}\p{N}_]"


def as_col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c


def n_chars(text: Column | str) -> Column:
    return F.length(as_col(text)).cast("long")


def n_words(text: Column | str) -> Column:
    return F.regexp_count(as_col(text), F.lit(WORD_RUN)).cast("long")


def token_pattern(strip_punct: bool = True) -> str:
    return WORD if strip_punct else f"{WORD}|{MARK}"


def tokenize(text: Column | str, lower: bool = True, strip_punct: bool = True) -> Column:
    """Words of a text, in order, as an array; NULL stays NULL."""
    text = as_col(text)
    if lower:
        text = F.lower(text)
    return F.regexp_extract_all(text, F.lit(token_pattern(strip_punct)), F.lit(0))


def ngram_array(tokens: Column | str, n: int, sep: str = " ", keep_null: bool = False) -> Column:
    """Adjacent tokens joined into n-grams, from arrays shifted against each other.

    `tokens` should be a plain column: it is used n times. With `keep_null` a text with fewer than n
    tokens gives one NULL, otherwise it gives none.
    """
    tokens = as_col(tokens)
    count = F.greatest(F.size(tokens) - F.lit(n - 1), F.lit(0))
    grams = F.slice(tokens, F.lit(1), count)
    for shift in range(1, n):
        grams = F.zip_with(
            grams,
            F.slice(tokens, F.lit(shift + 1), count),
            lambda left, right: F.concat(left, F.lit(sep), right),
        )
    if keep_null:
        return F.when(count > 0, grams).otherwise(F.array(F.lit(None).cast("string")))
    return F.when(count > 0, grams).otherwise(F.array().cast("array<string>"))


def _shared_prefixes(terms: Sequence[str], whole: bool, one: Callable[[str], str] = re.escape) -> str:
    """One pattern for many literal terms, in which terms with the same beginning share it; `one` gives that of a character.

    A plain alternation tries every term at every character of the text; this tries each first letter
    once, which is about three times as fast for a list of a hundred. Unless terms must match whole, one
    that begins with another is left out, as the shorter one is found wherever it is.
    """
    ends = object()
    root: dict = {}
    for term in terms:
        node = root
        for char in term.lower():
            node = node.setdefault(char, {})
        node[ends] = {}

    def pattern(node: dict) -> str:
        if ends in node and not whole:
            return ""
        options = [one(char) + pattern(rest) for char, rest in node.items() if char is not ends]
        if not options:
            return ""
        body = options[0] if len(options) == 1 and ends not in node else "(?:" + "|".join(options) + ")"
        return body + "?" if ends in node else body

    return pattern(root)


def alternation(terms: Sequence[str], whole_word: bool = False) -> str:
    """A pattern that is found, in any letter case, wherever one of the terms is. Terms are regular
    expressions; a list without special characters is condensed."""
    body = _shared_prefixes(terms, whole_word) if _literal(terms) else "|".join(terms)
    return "(?iu)" + (_between_edges(body) if whole_word else body)


def _literal(terms: Sequence[str]) -> bool:
    return all(re.fullmatch(r"[\w ,\-]+", term) for term in terms)


def _between_edges(body: str) -> str:
    edge = r"[^\p{L}\p{M}\p{N}_]"
    return f"(?:^|{edge})(?:{body})(?:{edge}|$)"


# Letters beyond ASCII that `(?iu)` takes for an ASCII letter: dotted and dotless i, long s and the Kelvin sign.
_ALIKE = {"i": "\u0130\u0131", "s": "\u017f", "k": "\u212a"}


def _any_case(char: str) -> str:
    return f"[{char}{char.upper()}{_ALIKE.get(char, '')}]" if char.isalpha() else char


def has_any(text: Column | str, terms: Sequence[str], whole_word: bool = False) -> Column:
    """1 when any term occurs in the text, in any letter case; 0 otherwise, also for NULL.

    Terms are regular expressions. Substrings count unless `whole_word` is set. Plain ASCII terms are searched by Arrow's
    automaton, which reads a text once, however many terms there are; Java's engine tries them one by one at each character.
    """
    if not (_literal(terms) and all(term.isascii() for term in terms)):
        hit = as_col(text).rlike(alternation(terms, whole_word))
        return F.coalesce(hit, F.lit(False)).cast("int")
    body = _shared_prefixes(terms, whole_word, _any_case)
    pattern = _between_edges(body) if whole_word else body

    def found(texts: pa.Array) -> pa.Array:
        return pc.match_substring_regex(texts, pattern).fill_null(False).cast(pa.int32())

    return F.arrow_udf(found, "int")(as_col(text).cast("string"))


def space_out(text: Column | str) -> Column:
    """Put a comma after every word, so that an annotator looks at each word on its own."""
    return F.regexp_replace(as_col(text), r"\s+", ", ")


def remove_all(text: Column | str, pattern: str) -> Column:
    return F.regexp_replace(as_col(text), pattern, "")


def part_of(text: Column | str, sep: str, index: int) -> Column:
    """The index-th (from 0) piece of a separated string; NULL when there are too few."""
    return F.get(F.split(as_col(text), sep), F.lit(index))
