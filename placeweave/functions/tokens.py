"""Word boundaries as one regular expression.

A word is a run of letters, marks, digits and underscores with at least one letter or
digit. An apostrophe, full stop or middle dot joins two letters; a full stop, comma,
semicolon or apostrophe joins two digits. These are the default Unicode word-boundary
rules for alphabetic scripts, with the colon as a break (as current locale data has it).
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from placeweave import fixed
from placeweave.functions.cleaning import _col

# plain letters and digits stand first, as the matcher asks a class in that order
_LETTER = r"a-z\p{L}\p{M}"
_WORD = rf"0-9{_LETTER}\p{{Nd}}"
# possessive quantifiers: a run never gives characters back
TOKEN_PATTERN = (
    rf"_*+[{_WORD}][{_WORD}_]*+"
    rf"(?:(?:(?<=[{_LETTER}])[.'‘’·](?=\p{{L}})"
    rf"|(?<=\p{{Nd}})[.,;'‘’](?=\p{{Nd}}))[{_WORD}_]++)*+"
)


def tokens(c: Column | str) -> Column:
    """Lower-cased words in text order."""
    return F.regexp_extract_all(F.lower(_col(c)), F.lit(TOKEN_PATTERN), F.lit(0))


#: A word of the usual shape in the group, or any other word and no group. A space ends any word and starts none, so it
#: is tried first as the end and taken along; the rest is asked where another character follows.
_SHAPED = rf"([a-z]{{3,}}+)(?:[ ]|(?![{_WORD}_]|[.'‘’·]\p{{L}}))|[a-z]{{1,2}}+[ ]|{TOKEN_PATTERN}"


def shaped_tokens(c: Column | str, shape: str = fixed.WORD_SHAPE) -> Column:
    """``tokens`` with an empty string or NULL in place of each word of another shape. The usual shape is tested by
    the pattern that finds the words."""
    if shape == fixed.WORD_SHAPE:
        return F.regexp_extract_all(F.lower(_col(c)), F.lit(_SHAPED), F.lit(1))
    return F.transform(tokens(c), lambda w: F.when(word_shaped(w, shape), w))


def word_shaped(c: Column | str, shape: str = fixed.WORD_SHAPE) -> Column:
    return _col(c).rlike(shape)
