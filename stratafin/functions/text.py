"""Column functions over the lines and texts of statements.

All are built-in expressions.  Regular expressions carry ``(?U)``: white space,
digits and words are those of Unicode.  Nulls give nulls unless said otherwise.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed value: numbers as they stand in statement lines (a run of digits and spaces is at most 20 long).
NUMBER_IN_LINE = r"(?U)\(?\s*[\d\s]{1,20}(?:[,.]\d+)?\s*\)?"
_PLAIN_NUMBER = r"^[+-]?(?:\d+\.?\d*|\.\d+)(?:[eE][+-]?\d+)?$"


#: Fixed value: the white space of Unicode.
WHITE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000"


def strip(c: Column) -> Column:
    """Without white space at both ends (any kind of it)."""
    return F.trim(c, F.lit(WHITE))


def lines(c: Column) -> Column:
    """The stripped lines of a text that are not blank, in order."""
    parts = F.split(c, r"\R|[\x1c-\x1e]")
    return F.filter(F.transform(parts, strip), lambda x: x != "")


def _to_double(c: Column) -> Column:
    return F.when(c.rlike(_PLAIN_NUMBER), c.try_cast("double"))


def _numbers_of(parts: Column) -> Column:
    """Every string of an array as a number, by steps that are each evaluated once."""
    bare = F.transform(parts, lambda c: F.replace(F.translate(strip(c), "\u00a0 ", ""), F.lit(","), F.lit(".")))
    signed = F.transform(bare, lambda s: F.struct(s.alias("s"), (F.startswith(s, F.lit("(")) & F.endswith(s, F.lit(")"))).alias("neg")))

    def inside(x: Column) -> Column:
        s = F.when(x["neg"], F.substring(x["s"], F.lit(2), F.length(x["s"]) - 2)).otherwise(x["s"])
        return F.struct(F.when(~x["s"].isin("", "-", "—", "-—"), s).alias("s"), x["neg"].alias("neg"))

    def plain(x: Column) -> Column:
        s = F.when(F.endswith(x["s"], F.lit("%")), F.substring(x["s"], F.lit(1), F.length(x["s"]) - 1)).otherwise(x["s"])
        return F.struct(strip(s).alias("s"), x["neg"].alias("neg"))

    def value(x: Column) -> Column:
        return F.struct(_to_double(x["s"]).alias("v"), x["neg"].alias("neg"))

    steps = F.transform(F.transform(F.transform(signed, inside), plain), value)
    return F.transform(steps, lambda x: F.when(x["neg"], -x["v"]).otherwise(x["v"]))


def number(c: Column) -> Column:
    """A number as statements write it; null if it is none.

    Spaces (plain and U+00A0) go, a comma is a decimal point, parentheses make
    it negative, a percent sign is dropped; dashes alone are no number.
    """
    return F.get(_numbers_of(F.array(c)), F.lit(0))


def numbers(c: Column) -> Column:
    """All numbers of a line in order; zeros and unparsable chunks are left out."""
    found = _numbers_of(F.regexp_extract_all(c, F.lit(NUMBER_IN_LINE), F.lit(0)))
    return F.filter(found, lambda x: x.isNotNull() & (F.abs(x) > 1e-9))


def years(c: Column) -> Column:
    """Years 2000 to 2099 that stand as words, in order, repeated ones too."""
    return F.transform(F.regexp_extract_all(c, F.lit(r"(?U)\b(20[0-9]{2})\b"), F.lit(1)), lambda y: y.cast("int"))


def columns(c: Column) -> Column:
    """A table line cut at two or more spaces or a tab; blank cells are left out."""
    return F.filter(F.transform(F.split(strip(c), r"(?U)\s{2,}|\t"), strip), lambda x: x != "")


def is_year_header(line: Column, found_years: Column, found_numbers: Column) -> Column:
    """Two years or more with hardly any other numbers, or with a word for year."""
    few = F.size(found_numbers) - F.size(found_years) <= 1
    return (F.size(found_years) >= 2) & (few | F.lower(line).rlike(r"год|г\."))


def is_page_break(line: Column) -> Column:
    return F.lower(line).rlike("страница|page")


def strip_markup(c: Column) -> Column:
    """Line breaks to spaces, tags out, four entities decoded in order, runs of spaces to one."""
    s = F.regexp_replace(F.regexp_replace(c, r"(?i)<br\s*/?>", " "), r"(?U)</?\w+[^>]*>", "")
    for entity, char in (("&nbsp;", " "), ("&lt;", "<"), ("&gt;", ">"), ("&amp;", "&")):
        s = F.replace(s, F.lit(entity), F.lit(char))
    return F.regexp_replace(s, " {2,}", " ")


def collapse_numbers(line: Column) -> Column:
    """Runs of spaces and tabs to one, and stripped, in lines that hold a digit; others stay."""
    return F.when(line.rlike(r"(?U)\d"), strip(F.regexp_replace(line, r"[ \t]{2,}", " "))).otherwise(line)


def is_table_row(line: Column) -> Column:
    """Only numbers, separators and parentheses, with at least one digit."""
    bare = F.trim(F.translate(line, "|-=", "   "))
    return bare.rlike(r"^[0-9 .,()\-]*[0-9][0-9 .,()\-]*$")


def cells(line: Column) -> Column:
    """The number cells of a table row: one space before a digit is inside a number, more is a boundary."""
    return F.regexp_extract_all(F.translate(line, "|-=", "   "), F.lit(r"[0-9.,()]+(?: [0-9][0-9.,()]*)*"), F.lit(0))


def grouped(cell: Column) -> Column:
    """A cell with its thousands grouped and a point before the fraction; what is no number comes back without spaces."""
    bare = F.trim(cell)
    negative = F.startswith(bare, F.lit("(")) & F.endswith(bare, F.lit(")")) & (F.length(bare) > 1)
    s = F.replace(F.when(negative, F.substring(bare, F.lit(2), F.length(bare) - 2)).otherwise(bare), F.lit(" "), F.lit(""))
    is_number = F.replace(s, F.lit(","), F.lit(".")).rlike(_PLAIN_NUMBER)
    sep = F.when(F.contains(s, F.lit(".")), ".").when(F.contains(s, F.lit(",")), ",")
    whole = F.when(sep == ".", F.substring_index(s, ".", 1)).when(sep == ",", F.substring_index(s, ",", 1)).otherwise(s)
    part = F.when(sep.isNull(), "").otherwise(F.substring(s, F.length(whole) + 2, F.length(s)))
    shown = F.concat(F.regexp_replace(whole, r"(?<=\d)(?=(?:\d{3})+$)", " "), F.when(part != "", F.concat(F.lit("."), part)).otherwise(""))
    shown = F.when(negative, F.concat(F.lit("("), shown, F.lit(")"))).otherwise(shown)
    return F.when(bare == "", "").when(is_number, shown).otherwise(s)


def right_aligned(cell: Column, width: int = 15) -> Column:
    """At least ``width`` characters, blanks in front; longer cells stay whole."""
    return F.when(F.length(cell) < width, F.lpad(cell, width, " ")).otherwise(cell)


def markdown_table(rows: Column, title: Column) -> Column:
    """Rows of cells as a Markdown table under a title line; a table of one row keeps only a blank header."""
    clean = lambda c: F.coalesce(F.regexp_replace(strip(F.regexp_replace(c, r"<br\s?/?>", " ")), r"(?U)\s+", " "), F.lit(""))
    kept = F.filter(F.transform(rows, lambda r: F.transform(r, clean)), lambda r: F.exists(r, lambda c: c != ""))
    many = F.size(kept) > 1
    first = F.get(kept, F.lit(0))
    header = F.when(many, first).otherwise(F.transform(first, lambda c: F.lit("")))
    row = lambda r: F.concat(F.lit("| "), F.array_join(r, " | "), F.lit(" |"))
    rule = row(F.transform(first, lambda c: F.lit("---")))
    body = F.transform(F.when(many, F.slice(kept, 2, F.size(kept))).otherwise(F.slice(kept, 1, 0)), row)
    out = F.array_join(F.concat(F.array(F.concat(F.lit("\n"), title, F.lit("\n")), row(header), rule), body), "\n")
    return F.when(F.size(kept) > 0, out).otherwise("")


def markdown_tables(tables: Column) -> Column:
    """All tables of a page, numbered from 1; those without a filled cell leave their number out."""
    each = F.transform(tables, lambda t, i: markdown_table(t, F.concat(F.lit("### TABLE "), (i + 1).cast("string"))))
    return F.array_join(F.filter(each, lambda x: x != ""), "\n")


def block_kind(content: Column) -> Column:
    """heading for short upper-case text, table for a table mark or a pipe, else text."""
    heading = (F.length(content) < 100) & (F.upper(content) == content) & (F.lower(content) != content)
    return F.when(heading, "heading").when(F.contains(content, F.lit("### TABLE")) | F.contains(content, F.lit("|")), "table").otherwise("text")


def mixed_number(c: Column) -> Column:
    """A number whose rightmost comma or point is the decimal mark; parentheses or brackets make it negative."""
    s = strip(c)
    negative = s.rlike(r"(?s)^\(.*\)$|^\[.*\]$")
    inner = F.regexp_replace(F.when(negative, F.substring(s, F.lit(2), F.length(s) - 2)).otherwise(s), r"(?U)\s+", "")
    comma, point = F.instr(F.reverse(inner), ","), F.instr(F.reverse(inner), ".")
    both = (comma > 0) & (point > 0)
    as_point = F.replace(F.replace(inner, F.lit("."), F.lit("")), F.lit(","), F.lit("."))
    text = F.when(both & (comma < point), as_point).when(both, F.replace(inner, F.lit(","), F.lit(""))).otherwise(F.replace(inner, F.lit(","), F.lit(".")))
    value = _to_double(text)
    return F.when(negative, -value).otherwise(value)


def display_number(c: Column, decimals: int = 2) -> Column:
    """Thousands by spaces and a decimal comma; N/A for null."""
    return F.coalesce(F.translate(F.format_number(c, decimals), ",.", " ,"), F.lit("N/A"))


def chunks(c: Column, size: int) -> Column:
    """Pieces of ``size`` code points; none for an empty text."""
    n = F.length(c)
    cut = F.transform(F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size)), lambda i: F.substring(c, i + 1, F.lit(size)))
    return F.when(n > 0, cut).when(n == 0, F.slice(cut, 1, 0))


def xml_escaped(c: Column) -> Column:
    for char, entity in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;")):
        c = F.replace(c, F.lit(char), F.lit(entity))
    return c


def comma_list(c: Column) -> Column:
    """Trimmed entries of a comma-separated list, blanks left out."""
    return F.filter(F.transform(F.split(c, ","), strip), lambda x: x != "")
