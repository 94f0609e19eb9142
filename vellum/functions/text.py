"""String expressions: folding, labels, markers, encoded strings."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Letters of the Latin scripts with marks, and what is left without them; a fixed list, in natural order. Texts of these and of
#: ASCII are folded by generated code; others (COMPLEX) by the full decomposition of each character.
MARKED = "ÀÁÂÃÄÅÇÈÉÊËÌÍÎÏÑÒÓÔÕÖÙÚÛÜÝàáâãäåçèéêëìíîïñòóôõöùúûüýÿ"
PLAIN = "AAAAAACEEEEIIIINOOOOOUUUUYaaaaaaceeeeiiiinooooouuuuyy"
#: Other characters that fold to themselves.
SAME = "ßœŒæÆøØ«»¡¿§°–—‘’“”„•€"
COMPLEX = f"[^\\x00-\\x7F{MARKED}{SAME}]"

WORD_CLASS = "\\p{L}\\p{Nd}\\p{Mn}\\p{Mc}"


def page_text(text: Column) -> Column:
    """Words joined by single blanks, across lines too."""
    return F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), "[\\s\\x{85}\\p{Z}]+", " "))


def folded(text: Column, match_case: bool = False, match_marks: bool = False) -> Column:
    """For comparison, one character for one, of text without COMPLEX characters: without marks and case unless they count."""
    if not match_marks:
        text = F.translate(text, MARKED, PLAIN)
    return text if match_case else F.lower(text)


def fold_character(c: str, match_case: bool, match_marks: bool) -> str:
    """What a character is compared as: its full compatibility decomposition, without marks and case unless they count. Nothing
    is left of a mark that doesn't count; a character beyond the basic plane is left as it is."""
    if ord(c) > 0xFFFF:
        return c
    out = unicodedata.normalize("NFKD", c)
    if not match_marks:
        out = "".join(x for x in out if unicodedata.category(x) != "Mn")
    return out if match_case else out.lower()


def folded_map(text: str, match_case: bool = False, match_marks: bool = False) -> tuple[str, list[int]]:
    """text folded character by character, and the place in text that each folded character comes from."""
    parts = [fold_character(c, match_case, match_marks) for c in text]
    return "".join(parts), [k for k, part in enumerate(parts) for _ in part]


def roman(n: Column) -> Column:
    """Subtractive numerals; thousands repeat M."""
    digit = lambda one, five, ten, d: F.element_at(F.array(*[F.lit(x) for x in ("", one, one * 2, one * 3, one + five, five, five + one, five + one * 2, five + one * 3, one + ten)]), d.cast("int") + 1)
    place = lambda p: F.floor(n / p) % 10
    return F.concat(F.repeat(F.lit("M"), F.floor(n / 1000).cast("int")), digit("C", "D", "M", place(100)), digit("X", "L", "C", place(10)), digit("I", "V", "X", place(1)))


def letters(n: Column) -> Column:
    """A to Z, then AA, BB and so on: the letter repeats."""
    return F.repeat(F.char((65 + (n - 1) % 26).cast("int")), (F.floor((n - 1) / 26) + 1).cast("int"))


def label(style: Column, prefix: Column, number: Column) -> Column:
    """A page label; style: D, R, r, A, a, or null for the prefix alone."""
    shown = F.when(style == "D", number.cast("string")).when(style == "R", roman(number)).when(style == "r", F.lower(roman(number)))
    shown = shown.when(style == "A", letters(number)).when(style == "a", F.lower(letters(number))).otherwise("")
    return F.concat(F.coalesce(prefix, F.lit("")), shown)


def running_key(line: Column) -> Column:
    """What repeats in a running line: no white space, digits as #."""
    return F.regexp_replace(F.regexp_replace(line, "[\\s\\p{Z}]+", ""), "\\p{Nd}", "#")


#: Bullets, those of them that may stand right before a word, and what they number (fixed values).
BULLETS = "•◦▪▫■□●○‣⁃►▸▶➢➤✓✔∙\xb7–—-*"
STRONG_BULLETS = "•◦▪▫■□●○‣⁃►▸▶➢➤✓✔∙"
NUMBERING = {"Disc": "•●∙", "Circle": "◦○", "Square": "▪■▫□"}


def roman_value(token: Column) -> Column:
    """The value of a numeral up to 3999 in its usual spelling, all of one case; 0 for anything else."""
    up = F.upper(token)
    digit = lambda c: sum((F.when(c == x, v).otherwise(0) for x, v in zip("IVXLCDM", (1, 5, 10, 50, 100, 500, 1000))), F.lit(0))
    each = F.transform(F.split(up, ""), digit)
    total = F.aggregate(F.transform(each, lambda v, i: F.when(F.coalesce(F.get(each, i + 1), F.lit(0)) > v, -v).otherwise(v)), F.lit(0), lambda a, v: a + v)
    usual = (up == token) | (F.lower(token) == token)
    shape = up.rlike("^M{0,3}(CM|CD|D?C{0,3})(XC|XL|L?X{0,3})(IX|IV|V?I{0,3})$") & (token != "")
    return F.when(usual & shape, total).otherwise(0)


def list_marker(word: Column) -> Column:
    """struct(kind, style, value, roman, numbering) of a line's first word, or null: a bullet (alone, or a strong one right
    before a letter or digit), or t. or t) or (t) with one to three digits, a letter, or a numeral."""
    first = F.substring(word, F.lit(1), F.lit(1))
    inside = F.coalesce(F.nullif(F.regexp_extract(word, r"^\((.+)\)$", 1), F.lit("")), F.regexp_extract(word, r"^(.+)[.)]$", 1))
    style = F.when(word.rlike(r"^\(.+\)$"), 2).when(word.endswith(")"), 1).otherwise(0)
    is_bullet = F.lit(BULLETS).contains(first) & (first != "")
    bullet = is_bullet & ((F.length(word) == 1) | (F.lit(STRONG_BULLETS).contains(first) & word.rlike(r"^.[\p{L}\p{Nd}]")))
    numbering = F.lit("Unordered")
    for name, chars in NUMBERING.items():
        numbering = F.when(F.lit(chars).contains(first), name).otherwise(numbering)
    none = F.lit(None)
    made = lambda kind, style, value, roman, numbering: F.struct(F.lit(kind).alias("kind"), style.cast("int").alias("style"), value.cast("int").alias("value"), roman.cast("int").alias("roman"), numbering.cast("string").alias("numbering"))
    roman = roman_value(inside)
    letter = F.ascii(F.lower(inside)) - 96
    out = F.when(bullet, made("Bullet", F.lit(0), F.lit(0), F.lit(0), numbering))
    out = out.when(is_bullet | (inside == ""), none)
    out = out.when(inside.rlike("^[0-9]{1,3}$"), made("Number", style, inside.try_cast("int"), F.lit(0), none))
    out = out.when(inside.rlike("^[A-Za-z]$"), made("Letter", style, letter, roman, none))
    return out.when(roman > 0, made("Roman", style, F.lit(0), roman, none))


#: Words that begin a caption (fixed values).
CAPTION_WORDS = (
    "Abb", "Abbildung", "Algorithm", "Chart", "Diagram", "Exhibit", "Fig", "Figura", "Figure", "Graph", "Illustration", "Image",
    "Listing", "Map", "Photo", "Plate", "Scheme", "Tab", "Tabla", "Table", "Tableau", "Tabelle",
)


def is_caption(text: Column) -> Column:
    """Whether text begins with a caption's label: a caption word with a capital, then a number, a numeral or a capital letter,
    and an end that a label has (a mark, the text's end, or a word with a capital)."""
    words = "|".join(CAPTION_WORDS)
    t = F.regexp_replace(text, r"^\s+", "")
    word = F.regexp_extract(t, "^([A-Za-z]+)", 1)
    rest = F.regexp_replace(F.regexp_replace(F.substring(t, F.length(word) + 1, F.length(t)), r"^\.", ""), r"^\s+", "")
    label = F.regexp_extract(rest, "^[A-Za-z0-9.-]{0,12}", 0)
    token = F.regexp_replace(label, "[.-]+$", "")
    after = F.substring(rest, F.length(label) + 1, F.length(rest))
    beyond = F.regexp_replace(after, r"^\s+", "")
    named = word.rlike(f"^(?i:{words})$") & word.rlike("^[A-Z]")
    numbered = (token != "") & (label.rlike("[0-9]") | token.rlike("^[IVXLC]+$") | token.rlike("^[A-Z]$"))
    ends = label.endswith(".") | (beyond == "") | after.rlike("^[:.\u2014\u2013|)]") | beyond.rlike(r"^[\p{Lu}\u2014\u2013:(-]")
    return F.coalesce(named & numbered & ends, F.lit(False))


def is_language_tag(tag: Column) -> Column:
    """Shape of a language tag: 2-8 letters, then subtags of 1-8 letters and digits."""
    return F.coalesce(tag.rlike("^[A-Za-z]{2,8}(-[A-Za-z0-9]{1,8})*$"), F.lit(False))


#: Characters of the one-byte encoding of text strings that aren't those of the same code (fixed values).
DOC_CODES = [*range(0x18, 0x20), *range(0x80, 0x9F), 0xA0]
DOC_CHARACTERS = "\u02d8\u02c7\u02c6\u02d9\u02dd\u02db\u02da\u02dc\u2022\u2020\u2021\u2026\u2014\u2013\u0192\u2044\u2039\u203a\u2212\u2030\u201e\u201c\u201d\u2018\u2019\u201a\u2122\ufb01\ufb02\u0141\u0152\u0160\u0178\u017d\u0131\u0142\u0153\u0161\u017e\u20ac"
_DOC_BYTES = "".join(map(chr, DOC_CODES))


def text_string(raw: Column) -> Column:
    """Bytes of a text string: FE FF begins UTF-16BE, EF BB BF UTF-8 (language escapes are taken out of both), else one byte a
    character."""
    body16 = F.substring(raw, F.lit(3), (F.floor((F.octet_length(raw) - 2) / 2) * 2).cast("int"))
    starts = lambda h: F.hex(F.substring(raw, F.lit(1), F.lit(3))).startswith(h)
    plain = lambda t: F.regexp_replace(t, "\\x1B[^\\x1B]{2}(?:[^\\x1B]{2})?\\x1B", "")
    wide = plain(F.decode(body16, "UTF-16BE"))
    utf8 = plain(F.decode(F.substring(raw, F.lit(4), F.octet_length(raw)), "UTF-8"))
    return F.when(starts("FEFF"), wide).when(starts("EFBBBF"), utf8).otherwise(F.translate(F.decode(raw, "ISO-8859-1"), _DOC_BYTES, DOC_CHARACTERS))


def encoded_text_string(text: Column) -> Column:
    """Bytes of a text string for text: one byte a character if all characters have one, else UTF-16BE behind FE FF."""
    fits = ~text.rlike(f"[^\\x00-\\x17\\x20-\\x7F\\xA1-\\xFF{DOC_CHARACTERS}]") & ~text.rlike("^(?:\u00fe\u00ff|\u00ef\u00bb\u00bf)")
    narrow = F.encode(F.translate(text, DOC_CHARACTERS, _DOC_BYTES), "ISO-8859-1")
    wide = F.concat(F.unhex(F.lit("FEFF")), F.encode(text, "UTF-16BE"))
    return F.when(fits, narrow).otherwise(wide)


def ascii_hex(data: Column) -> Column:
    """Decoded bytes: all before the first >, other characters skipped, an odd last digit padded with 0."""
    digits = F.regexp_replace(F.substring_index(data, ">", 1), "[^0-9A-Fa-f]", "")
    return F.unhex(F.when(F.length(digits) % 2 == 1, F.concat(digits, F.lit("0"))).otherwise(digits))
