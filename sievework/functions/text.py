"""Text expressions. Each takes and returns Columns and stays in the JVM unless it says otherwise; nulls stay null."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space in Java's regular expressions.
_SPACE = r"[\p{IsWhite_Space}]"


def trim(c: Column) -> Column:
    """Without Unicode white space at either end; SQL's trim takes spaces only."""
    return F.regexp_replace(c, rf"^{_SPACE}+|{_SPACE}+$", "")


def squeeze(c: Column) -> Column:
    """Trimmed, each run of white space one space."""
    return trim(F.regexp_replace(c, rf"{_SPACE}+", " "))


def _unaccented() -> tuple[str, str]:
    """Precomposed Latin, Greek and Cyrillic letters and their base letters, from the Unicode data."""
    found = {}
    for code in [*range(0xC0, 0x250), *range(0x370, 0x530), *range(0x1E00, 0x2000)]:
        parts = unicodedata.normalize("NFD", chr(code))
        if len(parts) > 1 and all(unicodedata.combining(p) for p in parts[1:]):
            found[chr(code)] = parts[0]
    return "".join(found), "".join(found.values())


ACCENTED, PLAIN = _unaccented()
#: Texts of Latin, Greek, Cyrillic and common signs only: their accents are marks on letters and may go; in other scripts they are part of the letter.
ACCENT_SCRIPTS = r"^[\x{0}-\x{52F}\x{1E00}-\x{2BFF}]*$"


def strip_accents(c: Column) -> Column:
    """Only where all characters are of those ranges."""
    return F.when(F.rlike(c, F.lit(ACCENT_SCRIPTS)), F.regexp_replace(F.translate(c, ACCENTED, PLAIN), r"\p{M}", "")).otherwise(c)


def normalize_text(c: Column, accents: bool = True) -> Column:
    """White space squeezed, lower case, and (accents=True) accents off."""
    low = F.lower(squeeze(c))
    return strip_accents(low) if accents else low


def blank(c: Column) -> Column:
    """Null or nothing but white space."""
    return c.isNull() | (trim(c) == "")


def render_text(c: Column, kind: str) -> Column:
    """The canonical text of a value of a Spark type name: floating-point numbers in the shortest form that reads back, without 1.0E20 but 1e20."""
    if kind == "string":
        return c
    if kind in ("double", "float"):
        s = c.cast("string")
        head, exponent = F.regexp_extract(s, r"^(-?[0-9.]+?)(?:\.0)?E", 1), F.regexp_extract(s, r"E(-?[0-9]+)$", 1)
        whole = F.when((F.abs(c) < 1e16) & (F.abs(c) >= 1e7), c.cast("decimal(38,1)").cast("string"))
        small = F.when((F.abs(c) >= 1e-5) & (F.abs(c) < 1e-3), F.regexp_replace(c.cast("decimal(38,24)").cast("string"), "0+$", ""))
        sci = F.when(F.contains(s, F.lit("E")), F.coalesce(F.when(c == F.floor(c), whole), small, F.concat(head, F.lit("e"), exponent)))
        return F.when(F.isnan(c), "NaN").when(c == float("inf"), "inf").when(c == float("-inf"), "-inf").otherwise(F.coalesce(sci, s))
    if kind.startswith(("array", "map", "struct")):
        return F.to_json(c)
    if kind == "binary":
        return F.hex(c)
    return c.cast("string")


def email(c: Column) -> Column:
    return F.lower(trim(c))


def phone(c: Column) -> Column:
    """ASCII digits, with a leading plus if there is one."""
    return F.concat(F.when(F.startswith(trim(c), F.lit("+")), "+").otherwise(""), F.regexp_replace(c, "[^0-9]", ""))


def address(c: Column) -> Column:
    return squeeze(c)


def _found(c: Column) -> Column:
    return F.nullif(c, F.lit(""))


def first_token(c: Column) -> Column:
    return _found(F.regexp_extract(c, r"([^\p{IsWhite_Space}]+)", 1))


def last_token(c: Column) -> Column:
    return _found(F.regexp_extract(c, rf"([^\p{{IsWhite_Space}}]+){_SPACE}*$", 1))


def digits(c: Column) -> Column:
    """The first run of ASCII digits."""
    return _found(F.regexp_extract(c, "([0-9]+)", 1))


def letters(c: Column) -> Column:
    """The first run of letters of any script."""
    return _found(F.regexp_extract(c, r"(\p{IsAlphabetic}+)", 1))


def before(c: Column, delimiter: str) -> Column:
    """What stands before the first occurrence; null if there is none."""
    at = F.instr(c, delimiter)
    return F.when(at > 0, F.substring(c, F.lit(1), at - 1))


def after(c: Column, delimiter: str) -> Column:
    at = F.instr(c, delimiter)
    return F.when(at > 0, F.substring(c, at + len(delimiter), F.length(c)))


def split_part(c: Column, delimiter: str, parts: int, i: int) -> Column:
    """Part i (from 0) of at most parts, the last one with the remainder; missing parts are null."""
    return F.get(F.split(c, r"\Q" + delimiter.replace("\\E", "\\E\\\\E\\Q") + r"\E", parts), F.lit(i))


def merge_parts(columns: list[Column], separator: str) -> Column:
    """Without the nulls; null if all are."""
    return F.when(F.coalesce(*columns).isNotNull(), F.concat_ws(separator, *columns))


#: What counts as missing once normalized.
SENTINELS = [
    "", "na", "n/a", "nan", "n.a.", "n.a", "null", "(null)", "none", "nil", "-", "--", "?", "??", "unknown", "unk", "missing",
    "not available", "not applicable", "sin dato", "sin datos", "s/d", "n/d", "no disponible", "desconocido", "desconocida", "#n/a", "(blank)", "(vacio)",
]
#: Those of them that are words, which are data if they stand in one cell of a column only.
WORD_SENTINELS = ["unknown", "unk", "missing", "none", "nil", "desconocido", "desconocida"]
#: Texts of more bytes are never markers, booleans, numbers or dates.
SHORT_BYTES = 64


def sentinel(c: Column) -> Column:
    return (F.octet_length(trim(c)) <= SHORT_BYTES) & normalize_text(c).isin(SENTINELS)


def word_sentinel(c: Column) -> Column:
    """The normalized marker if it is a word, else null."""
    n = normalize_text(c)
    return F.when((F.octet_length(trim(c)) <= SHORT_BYTES) & n.isin(WORD_SENTINELS), n)


#: Words for true and false.
TRUE_WORDS, FALSE_WORDS = ["true", "yes", "si"], ["false", "no"]


def boolean_token(c: Column) -> Column:
    """'true', 'false' or null."""
    n = normalize_text(c)
    return F.when(n.isin(TRUE_WORDS), "true").when(n.isin(FALSE_WORDS), "false")


#: Character sequences that show UTF-8 read as Windows-1252.
MOJIBAKE = ["â€™", "â€œ", "â€", "Ã©", "Ã¨", "Ã ", "Ã¢", "Ã®", "Ã´", "Ã³", "Ã±", "Ã¼", "Ã¡", "Ã­", "Ãº", "â€”", "â€¦"]


def windows_1252() -> tuple[str, str]:
    """The signs of Windows-1252 at 0x80 to 0x9F, and the characters of these codes."""
    pairs = []
    for b in range(0x80, 0xA0):
        try:
            pairs.append((bytes([b]).decode("windows-1252"), chr(b)))
        except UnicodeDecodeError:
            pass
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


def repair_mojibake(c: Column) -> Column:
    """Text with such a sequence is encoded as Windows-1252 and read as UTF-8, if both can be done; other text stays."""
    has = F.lit(False)
    for m in MOJIBAKE:
        has = has | F.contains(c, F.lit(m))
    latin = F.translate(c, *windows_1252())
    able = F.rlike(latin, F.lit(r"^[\x{00}-\x{FF}]*$"))
    data = F.encode(F.when(able, latin), "ISO-8859-1")
    read = F.when(F.is_valid_utf8(data.cast("string")), data.cast("string"))
    return F.when(has & read.isNotNull() & ~F.contains(read, F.lit("�")), read).otherwise(c)


REDACTED = "[REDACTED]"


def mask(c: Column) -> Column:
    return F.when(c.isNotNull(), F.lit(REDACTED))


def salted_hash(c: Column, salt: bytes) -> Column:
    """Hex SHA-256 of the salt's bytes and the text's."""
    return F.sha2(F.concat(F.lit(salt), F.encode(c, "UTF-8")), 256)


#: Fixed value: text that starts like a formula but is a number, a phone number or a dash.
SAFE_SIGNED = r"[+-]([0-9]+([.,][0-9]*)?|[.,][0-9]+)([eE][+-]?[0-9]+)?|[+-][0-9]{1,3}(\.[0-9]{3})+(,[0-9]+)?|[+-][0-9]{1,3}(,[0-9]{3})+(\.[0-9]+)?|[+-][0-9]{1,3}( [0-9]{3})+([.,][0-9]+)?|\+[0-9]+( [0-9]+)*|-"
#: Fixed value: first characters that a spreadsheet takes for a formula.
FORMULA_STARTS = "=+-@\t\r\n"


def formula_safe(c: Column) -> Column:
    """With an apostrophe in front where a spreadsheet would see a formula."""
    risky = F.substring(c, 1, 1).isin(list(FORMULA_STARTS)) & ~F.rlike(c, F.lit(rf"\A(?:{SAFE_SIGNED})\z"))
    return F.when(risky, F.concat(F.lit("'"), c)).otherwise(c)


def java_regex(pattern: str) -> str:
    """A pattern of the linear-time dialect (Unicode classes, no look-around, no back-references) for Java."""
    import re

    plain = re.sub(r"\\\\", "", pattern)
    if re.search(r"\(\?(?:[=!]|<[=!]|>)|\\[1-9]|\\k<", plain):
        raise ValueError("look-around, atomic groups and back-references are not supported")
    return "(?U)" + pattern.replace("(?P<", "(?<")


def java_replacement(replacement: str, pattern: str) -> str:
    """$name, ${name}, $1 and $$ as Java writes them. $1x names a group '1x', which isn't there and so is empty."""
    import re

    groups = re.compile(pattern.replace("(?<", "(?P<") if "(?P<" not in pattern else pattern)

    def one(m: re.Match) -> str:
        if m[0] == "$$":
            return r"\$"
        if m[0] == "\\":
            return r"\\"
        name = m[1] or m[2]
        if name is None:
            return r"\$"
        if name.isdecimal():
            return f"${int(name)}" if int(name) <= groups.groups else ""
        return f"${{{name}}}" if name in groups.groupindex else ""

    out = re.sub(r"\$\$|\$\{(\w+)\}|\$(\w+)|\$|\\", one, replacement)
    return re.sub(r"(\$\d+)(?=\d)", lambda m: m[1], out)
