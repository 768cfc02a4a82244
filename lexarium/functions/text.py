"""Text functions as Column expressions; all run inside the JVM.

The patterns are written for Java's engine. Where DuckDB's engine takes the
same pattern, plans/sql.py shares it.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F

from lexarium.functions.strings import graphemes as clusters

#: The default punctuation table (fixed values: all ASCII punctuation).
PUNCTUATION = tuple("!\"#$%&'()*+,;./:<=>?@[\\]^_`{|}~-")

#: Characters with the property White_Space (fixed values).
WHITE_SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"

_LETTERS = r"[\p{L}\p{Nl}][\p{L}\p{Nl}\p{M}\p{Cf}]*"
#: Scripts whose letters each are a word of their own, and what a run of Katakana is made of (fixed values).
_ALONE = r"\p{IsHan}\p{IsHiragana}\p{IsThai}\p{IsLao}\p{IsKhmer}\p{IsMyanmar}\p{IsTai_Le}\p{IsNew_Tai_Lue}\p{IsTai_Tham}\p{IsTai_Viet}\p{IsAhom}"
_KATAKANA = r"\p{IsKatakana}\x{3031}-\x{3035}\x{309B}\x{309C}\x{30A0}\x{30FC}\x{FF70}"
#: The letters of Latin-1, one by one, which makes them one table in Java. A class asks it first, and others leave small codes out first: a look at a character's script is a search.
_LATIN = "".join(c for c in map(chr, range(256)) if c.isalpha())
_LATER = r"[^\x{0}-\x{588}]"
_JAVA_LETTERS = rf"[[{_LATIN}][\p{{L}}\p{{Nl}}&&[^{_ALONE}{_KATAKANA}]]][[{_LATIN}][\p{{L}}\p{{Nl}}\p{{M}}\p{{Cf}}&&[^{_ALONE}{_KATAKANA}]]]*+"
#: What stays with the character before it: marks, joiners, and the shades of emoji.
_EXTEND = r"[\p{M}\p{Cf}\x{1F3FB}-\x{1F3FF}]*+"
_FLAG = rf"[\x{{1F1E6}}-\x{{1F1FF}}]{{2}}{_EXTEND}"
_PICTURE = rf"[\p{{So}}\x{{203C}}\x{{2049}}\x{{2194}}-\x{{21AA}}\x{{25FB}}-\x{{25FE}}]{_EXTEND}"


def _token_pattern(letters: str, mid: str = "", hold: str = "", last: str = r"\S") -> str:
    """Words by the rules of word boundaries: letters joined by a mark inside, numbers likewise, connectors; else one character.

    hold: what makes a repetition possessive, where the engine knows that.
    """
    mid_letter, mid_number = "[.:'\u2018\u2019\u2024\u00B7]" + mid, "[.,;'\u2018\u2019\u2024]"
    words, numbers = rf"{letters}(?:(?:{mid_letter}){letters})*{hold}", rf"\p{{Nd}}+{hold}(?:{mid_number}\p{{Nd}}+{hold})*{hold}"
    return rf"(?:{words}|{numbers}|\p{{Pc}}+{hold})+{hold}|{last}"


#: Tokens that aren't blank.
TOKEN = _token_pattern(_LETTERS)
#: The Java form knows more scripts. Its repetitions are possessive: others recurse, and a token of some 10,000 parts would end the JVM's stack.
#: Blanks, plain words and ASCII marks before ASCII are told first, as most of a text is such.
JAVA_TOKEN = rf"(?=\S)(?:[{_LATIN}]++(?=[ ,\n])|[!-~&&[^\w]](?![^\x{{0}}-\x{{7F}}])|%s)" % _token_pattern(
    _JAVA_LETTERS,
    mid=r"|\"(?<=\p{IsHebrew}\")(?=\p{IsHebrew})",
    hold="+",
    last=rf"[{_LATER}&&[\p{{L}}\p{{Nl}}]&&[{_ALONE}]]{_EXTEND}|(?:[{_LATER}&&[{_KATAKANA}]]{_EXTEND})++|{_FLAG}|{_PICTURE}(?:(?<=\x{{200D}}){_PICTURE})*+|\S{_EXTEND}",
)

_CLOSE = r"[\"'\p{Ps}\p{Pe}\p{Pi}\p{Pf}]"
_BLANK = r"[ \t\x0B\f\u00A0\u1680\u2000-\u200A\u202F\u205F\u3000]"
_LINE_END = r"\n\r\x85\u2028\u2029"
_PARAGRAPH = rf"(?:\r\n|[{_LINE_END}])"
#: Full stops; marks that end a sentence whatever follows; marks that go on with one (fixed values of the sentence boundary rules).
_DOT = r"[.\u2024\uFE52\uFF0E]"
_STOPS = (
    r"!?\u0589\u061D-\u061F\u06D4\u0700-\u0702\u07F9\u0837\u0839\u083D\u083E\u0964\u0965\u104A\u104B\u1362\u1367\u1368\u166E\u1735\u1736\u17D4\u17D5\u1803\u1809\u1944\u1945\u1AA8-\u1AAB\u1B5A\u1B5B\u1B5E\u1B5F"
    r"\u1C3B\u1C3C\u1C7E\u1C7F\u203C\u203D\u2047-\u2049\u2E2E\u2E3C\u3002\uA4FF\uA60E\uA60F\uA6F3\uA6F7\uA876\uA877\uA8CE\uA8CF\uA92F\uA9C8\uA9C9\uAA5D-\uAA5F\uAAF0\uAAF1\uABEB\uFE56\uFE57\uFF01\uFF1F\uFF61"
)
_CONTINUES = r"\-,:;\u055D\u060C\u060D\u07F8\u1802\u1808\u2013\u2014\u3001\uFE10\uFE11\uFE13\uFE31\uFE32\uFE50\uFE51\uFE55\uFE58\uFE63\uFF0C\uFF0D\uFF1A\uFF64"
_GOES_ON = rf"(?![{_CONTINUES}.\u2024\uFE52\uFF0E{_STOPS}])"
#: Where a sentence ends: at the end of a line, after ! or ? and the like, and after a full stop that isn't inside a number or an abbreviation and that no small letter follows.
SENTENCE_END = (
    rf"(?=[{_LINE_END}.!?[{_LATER}]])(?:{_PARAGRAPH}|(?:{_DOT}(?!\p{{Nd}})(?!(?<=[\p{{Lu}}\p{{Lt}}\p{{Ll}}]{_DOT})[\p{{Lu}}\p{{Lt}}]){_CLOSE}*+{_BLANK}*+{_GOES_ON}(?![^\p{{L}}{_LINE_END}.!?]*+\p{{Ll}})"
    rf"|[{_STOPS}]{_CLOSE}*+{_BLANK}*+{_GOES_ON}){_PARAGRAPH}?)"
)
_NUMBER = r"(?i)^[+-]?(inf|infinity|nan|([0-9]+\.?[0-9]*|\.[0-9]+)(e[+-]?[0-9]+)?)$"
#: Ends a sentence inside a joined text; a text is cut where it has one of its own.
CUT = "\x1e"
#: What cleaning takes out of tokens that stand apart by blanks; other blanks can't be inside a token.
_SPECIAL = rf"(?=[',.\x85\xa0]|{_LATER})(?:'s|[,.\x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000])"


def _empty() -> Column:
    return F.array().cast("array<string>")


def strings(values: Iterable[str]) -> Column:
    values = list(values)
    return F.array(*[F.lit(v) for v in values]) if values else _empty()


def tokens(text: Column) -> Column:
    """The tokens of a text that aren't blank, in order."""
    return F.regexp_extract_all(text, F.lit(JAVA_TOKEN), F.lit(0))


def sentences(text: Column) -> Column:
    """The sentences with a letter or digit, in order; a line end always ends one."""
    cut = F.split(F.regexp_replace(text, SENTENCE_END, "$0" + CUT), CUT)
    return F.filter(cut, lambda s: s.rlike(r"[\p{L}\p{N}]"))


def lines(text: Column) -> Column:
    """The lines with more than blanks; a lone carriage return is no line end."""
    return F.filter(F.split(text, r"\r?\n"), lambda x: x.rlike(r"(?U)\S"))


def split_blank(text: Column) -> Column:
    """The parts between blanks."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def graphemes(text: Column) -> Column:
    """How many characters a reader sees."""
    return F.size(F.regexp_extract_all(text, F.lit(r"\X"), F.lit(0)))


def one_grapheme(values: Iterable[str]) -> list[str]:
    """The entries of a punctuation list that can match a token: those of one character, as a reader sees it."""
    return [v for v in values if len(clusters(v)) == 1]


def is_punctuation(word: Column, punctuation: Iterable[str]) -> Column:
    return word.isin("", *one_grapheme(punctuation))


def token_text(text: Column, marks: str = "") -> Column:
    """The tokens of a text without 's, commas, full stops and blanks, apart by blanks; some may be empty.

    marks: characters that are a token of their own wherever they stand.
    """
    found = F.regexp_extract_all(text, F.lit(f"[{marks}]|{JAVA_TOKEN}"), F.lit(0)) if marks else tokens(text)
    return F.regexp_replace(F.array_join(found, " "), _SPECIAL, "")


def dropped_words(stop_words: Iterable[str], punctuation: Iterable[str]) -> list[str]:
    return ["", *one_grapheme(punctuation), *stop_words]


def words(text: Column, stop_words: Iterable[str] = (), punctuation: Iterable[str] = PUNCTUATION, marks: str = "") -> Column:
    """The cleaned tokens that are neither punctuation nor stop words; marks stay."""
    dropped = [w for w in dropped_words(stop_words, punctuation) if w not in tuple(marks)]
    return F.filter(F.split(F.lower(token_text(text, marks)), " "), lambda w: ~w.isin(dropped))


def is_number(word: Column) -> Column:
    """Whether the word reads as a decimal literal, inf or nan."""
    return word.rlike(_NUMBER)


def is_upper(word: Column) -> Column:
    return (graphemes(word) > 1) & (F.upper(word) == word)


def is_capitalised(word: Column) -> Column:
    return word.rlike(r"(?s)^\p{IsUppercase}(\p{M}*|.*\p{IsLowercase}.*)$")


def without_controls(text: Column) -> Column:
    """The text with a space for each line feed, tab and carriage return. Blanks around it stay: they make no sentence and no token."""
    for c in "\n\t\r":
        text = F.replace(text, F.lit(c), F.lit(" "))
    return text


def levenshtein_ratio(a: Column, b: Column) -> Column:
    """1 - distance / length of the longer one, in characters as a reader sees them; NaN for two empty strings.

    Where a character has several code points, each distinct one gets a code
    point of its own first.
    """
    cut = lambda x: F.regexp_extract_all(x, F.lit(r"\X"), F.lit(0))
    n, m = F.size(cut(a)), F.size(cut(b))
    longest = F.greatest(n, m)
    known = F.array_distinct(F.concat(cut(a), cut(b)))
    code = lambda x: F.array_join(F.transform(cut(x), lambda g: F.decode(F.unhex(F.lpad(F.hex(F.array_position(known, g) + 0x3400), 4, "0")), "UTF-16BE")), "")
    plain = (n == F.length(a)) & (m == F.length(b))
    distance = F.when(plain, F.levenshtein(a, b)).otherwise(F.levenshtein(code(a), code(b)))
    return F.when(longest == 0, F.lit(float("nan"))).otherwise(1 - distance / longest)
