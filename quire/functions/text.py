"""Text functions as Column expressions: words, normal forms, stems, breaks, labels. Lengths count code points."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# The ranges that words are made of.
LETTERS = r"\x{30}-\x{39}\x{41}-\x{5A}\x{61}-\x{7A}\x{C0}-\x{2AF}\x{370}-\x{52F}\x{531}-\x{588}\x{590}-\x{8FF}\x{900}-\x{1DBF}\x{1E00}-\x{1FFF}\x{2C00}-\x{2DFF}\x{A640}-\x{A69F}\x{A720}-\x{A7FF}"
CJK = r"\x{3040}-\x{30FF}\x{3400}-\x{4DBF}\x{4E00}-\x{9FFF}\x{AC00}-\x{D7AF}\x{F900}-\x{FAFF}\x{20000}-\x{2FA1F}"
MARKS = r"\x{300}-\x{36F}\x{1DC0}-\x{1DFF}\x{20D0}-\x{20FF}\x{FE20}-\x{FE2F}"
CONNECTORS = r"\x{27}\x{2D}\x{2010}\x{2011}\x{2019}"
WORD = f"[{CJK}]|[{LETTERS}](?:[{MARKS}]*(?:[{CONNECTORS}][{MARKS}]*)?[{LETTERS}])*"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def word_count(c: Column) -> Column:
    """Words of a text: letters and digits, one connector inside; every CJK character is a word."""
    return F.regexp_count(c, F.lit(WORD)).cast("bigint")


def words(c: Column) -> Column:
    return F.regexp_extract_all(c, F.lit(WORD), F.lit(0))


def ascii_lower(c: Column) -> Column:
    return F.translate(c, UPPER, LOWER)


def collapse(c: Column) -> Column:
    """ASCII white space collapsed to single blanks and trimmed."""
    return F.trim(F.regexp_replace(c, r"[ \r\n\t]+", " "))


def normal_form(c: Column) -> Column:
    """The form in which texts count as equal: collapsed, A-Z lower-cased."""
    return ascii_lower(collapse(c))


def capped_distance(a: Column, b: Column, most: int) -> Column:
    """Edit distance in code points, ``most`` + 1 if it is more than ``most``; stops early."""
    d = F.levenshtein(a, b, most)
    return F.when(d < 0, most + 1).otherwise(d)


# The rules of stemming, in their order.
#: (suffix, suffixes that rule it out, least length, replacements); "*" stands for dropping a doubled last letter.
STEM_RULES = (
    ("sses", (), 3, ("ss",)),
    ("ses", (), 3, ("s", "sis")),
    ("ies", (), 3, ("y", "i")),
    ("ves", (), 3, ("f", "fe", "ve")),
    ("men", (), 3, ("man",)),
    ("es", ("sses", "ies", "ves"), 3, ("", "e")),
    ("s", ("ss", "us", "es"), 3, ("",)),
    ("ied", (), 3, ("y", "ie")),
    ("ed", ("ied",), 3, ("", "e")),
    ("ed", ("ied",), 5, ("*",)),
    ("ying", (), 3, ("ie",)),
    ("ing", (), 3, ("", "e")),
    ("ing", (), 6, ("*",)),
    ("ically", (), 3, ("ic", "ic")),
    ("ally", (), 3, ("al", "al")),
    ("ily", ("ally",), 3, ("y",)),
    ("ly", ("ily", "ally"), 3, ("",)),
    ("ier", (), 3, ("y",)),
    ("er", (), 3, ("", "e")),
    ("er", (), 5, ("*",)),
    ("iest", (), 3, ("y",)),
    ("est", (), 3, ("", "e")),
    ("est", (), 6, ("*",)),
    *((s, (), 3, ("",)) for s in ("ness", "ment", "ful", "less")),
    *((s, (), 3, ("", "e")) for s in ("able", "ible")),
    ("ation", (), 3, ("", "e", "ate")),
    ("tion", ("ation",), 3, ("te", "t", "te")),
    ("ion", ("tion",), 3, ("", "e")),
    ("al", ("ial",), 3, ("", "e")),
    *((s, (), 3, ("", "e")) for s in ("ial", "ous", "ive", "ize", "ise", "en")),
)
PREFIX_RULES = (("un", 6), ("dis", 4), ("mis", 4), ("pre", 7), ("over", 8), ("re", 6))


def stem_sql(w: str, at: str = "substring") -> list[str]:
    """SQL (for Spark and DuckDB) of every stem candidate of the lower-case ASCII word w, null where a rule doesn't fit."""
    out = []
    for suffix, bar, least, gives in STEM_RULES:
        n = len(suffix)
        stem = f"{at}({w}, 1, length({w}) - {n})"
        ok = " and ".join([f"length({w}) >= {max(least, n + 1)}", f"right({w}, {n}) = '{suffix}'", *(f"right({w}, {len(b)}) <> '{b}'" for b in bar)])
        for g in gives:
            if g == "*":
                twice = f"length({w}) >= {n + 2} and {at}({w}, length({w}) - {n}, 1) = {at}({w}, length({w}) - {n + 1}, 1)"
                out.append(f"case when {ok} and {twice} then {at}({w}, 1, length({w}) - {n + 1}) end")
            else:
                out.append(f"case when {ok} then concat({stem}, '{g}') end")
    for prefix, least in PREFIX_RULES:
        out.append(f"case when length({w}) >= {least} and left({w}, {len(prefix)}) = '{prefix}' then {at}({w}, {len(prefix) + 1}, length({w})) end")
    return out


def stem_variants(c: Column) -> Column:
    """Ordered distinct stem candidates of two letters or more of an ASCII word of three or more; else empty."""
    low = ascii_lower(c)
    found = F.transform(F.array(low), lambda w: F.array_distinct(F.filter(F.array(*[_stem(w, r) for r in _flat()]), lambda s: s.isNotNull() & (F.length(s) >= 2))))
    ok = low.rlike(r"^[\x00-\x7F]{3,}$")
    return F.when(ok, F.element_at(found, 1)).otherwise(F.array().cast("array<string>"))


def _flat() -> list[tuple]:
    return [(s, b, n, g) for s, b, n, gives in STEM_RULES for g in gives] + [(None, p, n, None) for p, n in PREFIX_RULES]


def _stem(w: Column, rule: tuple) -> Column:
    suffix, bar, least, give = rule
    if suffix is None:  # a prefix
        return F.when((F.length(w) >= least) & w.startswith(bar), F.substring(w, F.lit(len(bar) + 1), F.length(w)))
    n = len(suffix)
    ok = (F.length(w) >= max(least, n + 1)) & w.endswith(suffix)
    for b in bar:
        ok &= ~w.endswith(b)
    if give == "*":
        end = F.length(w) - n
        twice = (F.length(w) >= n + 2) & (F.substring(w, end, F.lit(1)) == F.substring(w, end - 1, F.lit(1)))
        return F.when(ok & twice, F.substring(w, F.lit(1), end - 1))
    return F.when(ok, F.concat(F.substring(w, F.lit(1), F.length(w) - n), F.lit(give)))


def lookup_word(c: Column) -> Column:
    """A word cut to its first and last letter, digit or CJK character; marks after the last stay."""
    core = f"[{LETTERS}{CJK}]"
    return F.regexp_extract(c, f"(?s){core}(?:.*{core})?[{MARKS}]*", 0)


def has_lookup_character(c: Column) -> Column:
    return c.rlike(f"[{LETTERS}{CJK}]")


def drop_last(c: Column, n: int) -> Column:
    return F.when(F.length(c) <= n, F.lit("")).otherwise(F.substring(c, F.lit(1), F.length(c) - n))


def break_positions(c: Column) -> Column:
    """Positions (code points before a break) next to a CJK character where a line may break by punctuation."""
    no_before, no_after = r"[\x{3001}\x{3002}\x{FF0C}\x{FF01}\x{FF1F}\x{FF1A}\x{FF1B}\x{300D}\x{300F}\x{FF09}\x{3011},.!?:;)]", r"[\x{300C}\x{300E}\x{FF08}\x{3010}(]"
    a, b = (lambda i: F.substring(c, i, F.lit(1))), (lambda i: F.substring(c, i + 1, F.lit(1)))
    ok = lambda i: (a(i).rlike(f"[{CJK}]") | b(i).rlike(f"[{CJK}]")) & ~b(i).rlike(no_before) & ~a(i).rlike(no_after)
    return F.when(F.length(c) > 1, F.filter(F.sequence(F.lit(1), F.length(c) - 1), ok)).otherwise(F.array().cast("array<int>"))


def bionic_prefix(word: Column, percent: int) -> Column:
    """The leading part of a word to set bold: percent of its length, 1 to 9 characters."""
    n = F.least(F.lit(9), F.greatest(F.lit(1), F.floor(F.length(word) * percent / 100).cast("int")))
    return F.substring(word, F.lit(1), n)


RTL = r"\x{590}-\x{8FF}\x{FB1D}-\x{FDFF}\x{FE70}-\x{FEFC}"


def starts_right_to_left(c: Column, most: int = 1 << 20) -> Column:
    """Whether the first strongly directed character, among the first ``most``, runs right to left."""
    strong = F.regexp_extract(F.substring(c, 1, most), f"[{RTL}]|\\p{{L}}", 0)
    return F.coalesce(strong.rlike(f"[{RTL}]"), F.lit(False))


def strip_soft_hyphens(c: Column) -> Column:
    return F.replace(c, F.lit("­"), F.lit(""))


def strip_layout_hyphen(c: Column) -> Column:
    return F.regexp_replace(c, "-$", "")


def trim_punctuation(c: Column) -> Column:
    """Without punctuation around it and without a bracketed footnote number behind it."""
    inner = F.regexp_replace(c, r"\[[0-9]+\]$", "")
    return F.regexp_replace(F.regexp_replace(inner, r"^[^\p{L}\p{N}]+", ""), r"[^\p{L}\p{N}]+$", "")


def xml_escape(c: Column) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;")):
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def roman(n: Column) -> Column:
    """Upper-case Roman numerals of 1 to 3999, null for any other number."""
    digits = ("", "I", "II", "III", "IV", "V", "VI", "VII", "VIII", "IX")
    turn = lambda one, five, ten: [d.translate(str.maketrans("IVX", one + five + ten)) for d in digits]
    places = [(1000, ["", "M", "MM", "MMM"]), (100, turn("C", "D", "M")), (10, turn("X", "L", "C")), (1, list(digits))]
    whole = F.concat(*[F.element_at(F.array(*map(F.lit, d)), (F.floor(n / p) % 10).cast("int") + 1) for p, d in places])
    return F.when(n.between(1, 3999), whole)


def alphabetic(n: Column) -> Column:
    """A to Z, then AA, BB and so on."""
    return F.repeat(F.substring(F.lit(UPPER), ((n - 1) % 26).cast("int") + 1, F.lit(1)), (F.floor((n - 1) / 26) + 1).cast("int"))


def unbroken_token(c: Column, prefix: int = 256, least: int = 64) -> Column:
    """Whether a text begins with a long token without white space that is 95 % base64 characters."""
    head = F.substring(c, 1, prefix)
    return (F.length(c) >= least) & ~head.rlike(r"\s") & (F.length(F.regexp_replace(head, "[^A-Za-z0-9+/=]", "")) * 100 >= 95 * F.length(head))


def attribute_has(c: Column, token: str) -> Column:
    """Whether a white-space separated attribute holds a token, whatever its case."""
    return F.array_contains(F.split(ascii_lower(c), r"\s+"), token.lower())


def tokens(c: Column, delimiter: str) -> Column:
    """Parts between delimiters, empty ones left out."""
    return F.filter(F.split(c, delimiter), lambda x: x != "")
