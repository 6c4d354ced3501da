"""Text clean-up as column expressions. ``\\s`` and ``\\d`` are Unicode-aware throughout."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def _accent_map() -> dict[str, str]:
    """Precomposed Latin letters and their base letters, from the Unicode tables."""
    out = {}
    for code in [*range(0x00C0, 0x0250), *range(0x1E00, 0x1F00)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(unicodedata.category(p) == "Mn" for p in parts[1:]):
            out[chr(code)] = parts[0]
    return out


ACCENTS = _accent_map()


def bind(value: Column, of) -> Column:
    """``of`` of a value that is computed once, however often ``of`` uses it: keeps expression trees and generated code small."""
    return F.element_at(F.transform(F.array(value), of), 1)


def apart(c: Column) -> Column:
    """A column as it is. Its projection keeps out of whole-stage code, where with others it is one method, too large to be compiled."""
    return F.coalesce(c, bind(c, lambda x: x))  # only nulls are bound


#: All characters of ``(?U)\s``.
WHITE = " \t\n\x0b\f\r\x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def is_ascii(c: Column) -> Column:
    return F.octet_length(c) == F.length(c)


def _single_blanks(x: Column) -> Column:
    """White space to single blanks. The pattern runs only where substrings don't rule it out, which are found far faster."""
    tidy = is_ascii(x) & ~contains_any(x, ("  ", "\t", "\n", "\x0b", "\f", "\r"))
    return F.when(tidy, x).otherwise(F.regexp_replace(x, r"(?U)(?:[^\S ]| (?=\s))\s*", " "))


def squeeze(c: Column) -> Column:
    """White space to single blanks, none at the ends."""
    return F.trim(bind(c, _single_blanks))


def strip(c: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.btrim(c, F.lit(WHITE))


def blank(c: Column) -> Column:
    """Null or nothing but white space."""
    return ~F.coalesce(c.rlike(r"(?U)\S"), F.lit(False))


def filled(c: Column) -> Column:
    """The value, or null where it is blank."""
    return bind(c, lambda x: F.when(x.rlike(r"(?U)\S"), x))


def strip_marks(c: Column, d: str = "keep") -> Column:
    """Letters without diacritics. ``d``: whether the crossed d is kept, becomes d or D by case, or always d."""
    table = dict(ACCENTS)
    if d != "keep":
        table |= {"đ": "d", "Đ": "D" if d == "case" else "d"}
    plain = lambda x: F.regexp_replace(F.translate(x, "".join(table), "".join(table.values())), r"\p{Mn}+", "")
    return bind(c, lambda x: F.when(is_ascii(x), x).otherwise(plain(x)))


def _by_table(x: Column, underscore: bool = False) -> Column:
    table = {**{x: y.lower() for x, y in ACCENTS.items()}, "đ": "d", "Đ": "d", **{chr(i): chr(i + 32) for i in range(65, 91)}}
    table |= {"_": " "} if underscore else {}
    return F.translate(x, "".join(table), "".join(table.values()))


def _left_by_table(x: Column) -> Column:
    """Letters of other scripts and single marks."""
    return F.when(~is_ascii(x), F.lower(F.regexp_replace(x, r"\p{Mn}+", ""))).otherwise(x)


def search_text(c: Column, underscore: bool = False) -> Column:
    """Lower-case text without diacritics for keyword search; optionally with blanks for underscores."""
    plain = lambda x: bind(_by_table(x, underscore), _left_by_table)
    ascii = lambda x: F.translate(F.lower(x), "_", " ") if underscore else F.lower(x)
    return squeeze(bind(c, lambda x: F.when(is_ascii(x), ascii(x)).otherwise(plain(x))))


def with_search_text(rows: DataFrame, text: str = "text", name: str = "search") -> DataFrame:
    """``search_text`` of a column, as a column. Its steps are columns as well: what is bound is interpreted, columns are compiled."""
    x, lowered, bare = F.col(text), F.col("_lowered"), F.col("_bare")
    rows = rows.withColumn("_lowered", F.when(is_ascii(x), F.lower(x)).otherwise(_by_table(x))).withColumn("_bare", _left_by_table(lowered))
    return rows.withColumn(name, F.trim(_single_blanks(bare))).drop("_lowered", "_bare")


def scorer_text(c: Column) -> Column:
    """Text as the scorer compares it: no marks, lower case, common punctuation as blanks."""
    plain = F.lower(strip_marks(strip(c), "case"))
    return squeeze(F.regexp_replace(plain, r"[.,;:'\"`\-_(){}\[\]/\\!?]", " "))


def slug(c: Column) -> Column:
    """A file name's safe form."""
    plain = F.regexp_replace(strip_marks(c, "lower"), "[^A-Za-z0-9_-]+", "_")
    return F.regexp_replace(F.regexp_replace(plain, "_+", "_"), "^_|_$", "")


def contains_any(c: Column, keywords: list[str] | tuple[str, ...]) -> Column:
    """Whether any keyword is a substring; ``c`` should be a column or bound, as it is looked at for each. A keyword that holds another one tells nothing more."""
    found = F.lit(False)
    for k in keywords:
        if not any(other != k and other in k for other in keywords):
            found = found | c.contains(k)
    return found


def value_after_label(c: Column) -> Column:
    """Trimmed text after the first colon, or else the first hyphen; null without one or if nothing follows it."""
    colon, dash = F.instr(c, ":"), F.instr(c, "-")
    at = F.when(colon > 0, colon).otherwise(dash)
    return F.when((at > 0) & (at < F.length(c)), strip(F.substr(c, at + 1, F.length(c))))


def _without_edges(c: Column) -> Column:
    return F.regexp_replace(c, r"^[ :\-;]+|[ :\-;]+$", "")


def clean_value(c: Column) -> Column:
    """Without blanks, colons, hyphens and semicolons at the ends; inner white space squeezed."""
    return squeeze(_without_edges(c))


def with_clean_values(rows: DataFrame, values: dict[str, Column]) -> DataFrame:
    """``clean_value`` of each as a column, by steps that are columns as those of ``with_search_text``."""
    rows = rows.withColumns({f"_{k}": _without_edges(c) for k, c in values.items()})
    return rows.withColumns({k: F.trim(_single_blanks(F.col(f"_{k}"))) for k in values}).drop(*[f"_{k}" for k in values])


def split_lines(c: Column) -> Column:
    """Trimmed non-empty lines."""
    return F.filter(F.transform(F.split(c, r"\r\n|\n|\r"), strip), lambda x: x != "")


def humanize(c: Column) -> Column:
    """A blank before every capital but the first letter."""
    return F.regexp_replace(c, r"(?<!^)(\p{Lu})", " $1")


def truncate(c: Column, most: int = 300) -> Column:
    return F.substring(c, 1, most)


def text_hash(c: Column) -> Column:
    """Upper-case hexadecimal SHA-256 of text with squeezed white space."""
    return F.upper(F.sha2(squeeze(c), 256))


def stable_id(c: Column) -> Column:
    """A repeatable id: the first 16 bytes of SHA-256, as hexadecimal."""
    return F.substring(F.sha2(c, 256), 1, 32)


def last_match(c: Column, pattern: str) -> Column:
    """The last match of a pattern; null without any."""
    return F.try_element_at(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), F.lit(-1))


def first_match(c: Column, pattern: str, group: int = 0) -> Column:
    """A group of the first match; null without a match or where it is empty."""
    return F.nullif(F.regexp_extract(c, pattern, group), F.lit(""))
