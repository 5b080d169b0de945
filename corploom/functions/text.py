"""Text normalisation and tokenisation as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: White space as Python's str.split() sees it.
SPACE = "(?U)[\\s\\x1C-\\x1F]+"
_EDGE = "(?U)^[\\s\\x1C-\\x1F]+|(?U)[\\s\\x1C-\\x1F]+$"
#: Blocks of CJK ideographs that get spaces around them (fixed values).
CJK = "\\x{4E00}-\\x{9FFF}\\x{3400}-\\x{4DBF}\\x{20000}-\\x{2A6DF}\\x{2A700}-\\x{2B73F}\\x{2B740}-\\x{2B81F}\\x{2B820}-\\x{2CEAF}\\x{F900}-\\x{FAFF}\\x{2F800}-\\x{2FA1F}"
#: ASCII runs that count as punctuation, besides the Unicode classes P* (fixed values).
PUNCTUATION = "[\\x21-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7E\\p{P}]"


def strip(text: Column) -> Column:
    return F.regexp_replace(text, _EDGE, "")


def words(text: Column) -> Column:
    """Runs of non-space characters; an empty array for a blank text."""
    return F.filter(F.split(text, SPACE), lambda w: w != "")


def tokenize_line(line: Column, delimiter: str | None = None, lower: bool = False, add_eos: bool = False, add_double_eos: bool = False) -> Column:
    """Tokens of a stripped line: characters for delimiter '', words for None, else split at the delimiter; optional end marks."""
    line = strip(F.lower(line) if lower else line)
    if delimiter == "":
        tokens = F.filter(F.split(line, ""), lambda c: c != "")
    elif delimiter is None:
        tokens = words(line)
    else:
        tokens = F.split(line, "\\Q" + delimiter + "\\E", -1)
    if add_double_eos:
        return F.concat(F.array(F.lit("<S>")), tokens, F.array(F.lit("<S>")))
    return F.concat(tokens, F.array(F.lit("<eos>"))) if add_eos else tokens


def frame(ids: Column, eos: int, single: bool = False, double: bool = False) -> Column:
    """ids, ids + [eos], or [eos] + ids + [eos]; double wins."""
    mark = F.array(F.lit(eos).cast("int"))
    return F.concat(mark, ids, mark) if double else F.concat(ids, mark) if single else ids


def integer_tokens(text: Column) -> Column:
    """Ids of a pre-encoded text; a word that isn't an integer raises."""
    return F.transform(words(text), lambda w: w.cast("int"))


def to_unicode(data: Column) -> Column:
    """Bytes as UTF-8 text without what isn't valid; text as it is."""
    return F.replace(F.decode(data, "UTF-8"), F.lit("�"), F.lit(""))


def clean(text: Column) -> Column:
    """No NUL, replacement or control characters; every white space is a space."""
    text = F.regexp_replace(text, "[\\x{0}\\x{FFFD}]|[\\p{Cc}\\p{Cf}&&[^\\t\\n\\r]]", "")
    return F.regexp_replace(text, "[\\t\\n\\r\\p{Zs}]", " ")


def space_cjk(text: Column) -> Column:
    return F.regexp_replace(text, f"[{CJK}]", " $0 ")


def split_punctuation(text: Column) -> Column:
    """Every punctuation character stands as a word of its own."""
    return F.regexp_replace(text, PUNCTUATION, " $0 ")


def basic_tokens(text: Column, lower: bool = True) -> Column:
    """Clean, space ideographs, lower, split at spaces and punctuation (no accent folding, which is in tokenizers)."""
    text = space_cjk(clean(text))
    return words(split_punctuation(F.lower(text) if lower else text))


def is_start_piece(piece: Column) -> Column:
    return piece.startswith("▁") | piece.rlike(f"^{PUNCTUATION}$") | is_functional(piece)


def is_start_wordpiece(piece: Column) -> Column:
    return ~piece.startswith("##")


def is_functional(piece: Column) -> Column:
    """Marks like <sep>, but not <unk>."""
    return piece.rlike("^<[^<>]+>$") & (piece != "<unk>")


def join_tokens(tokens: Column, exclude: list[str] | None = None) -> Column:
    return F.array_join(F.filter(tokens, lambda t: ~t.isin(exclude)) if exclude else tokens, " ")
