"""Regular expressions that find words in noisy text.

``loose`` turns plain words into a Java pattern in which every letter, in
either case, also matches its look-alikes of other alphabets, its full-width form and what a scan
makes of it, with invisible characters or a line-end hyphen between letters.
"""

from __future__ import annotations

#: For a letter, what else may stand for it (lower case; upper case follows).
VARIANTS = {
    "а": "a", "б": "6", "в": "8b", "г": "r", "е": "eсcё", "ё": "eеëсc", "з": "3", "и": "н", "к": "k", "л": "п", "м": "m", "н": "hп", "о": "o0ο", "р": "pρ", "с": "c", "т": "tг", "у": "y", "х": "x", "ц": "и", "ч": "4", "ш": "щ",
    "a": "а", "b": "в8h", "c": "сe", "d": "", "e": "еc", "g": "9", "h": "нb", "i": "іl1!|ι", "k": "к", "l": "1|i", "m": "м", "n": "uν", "o": "о0ο", "p": "рρ", "s": "ѕ5$", "t": "т", "u": "n", "v": "ν", "x": "х", "y": "у",
}
#: Letters a scan makes of digits.
DIGITS = {"0": "OОo", "1": "lI", "3": "ЗS", "4": "ч", "5": "S", "8": "BВ"}
INVISIBLE = r"\p{Cf}"
SPACE = r"[\s\p{Z}]"
_BETWEEN = rf"(?:{INVISIBLE}|[-¬–‐=]{SPACE}{{1,4}})*+"


def _options(low: str) -> str:
    """What may stand for a letter, in both cases."""
    options = low + VARIANTS.get(low, "")
    options += "".join(chr(ord(x) + 0xFEE0) for x in options if "!" <= x <= "~")
    return "".join(dict.fromkeys(options + options.upper()))


def _letter(c: str) -> str:
    low = c.lower()
    if low == "й":
        return "(?:[йЙ]|[инИН]\\u0306)"
    options = _options(low)
    marked = "\\u0308?" if low in "ёе" else ""
    group = {"m": "rn", "w": "vv", "d": "cl"}.get(low)
    body = "[" + "".join("\\" + x if x in "\\^]-[&|$" else x for x in options) + "]"
    return f"(?:{body}|{group})" if group else body + marked


def loose(words: str) -> str:
    """A pattern for ``words``: spaces match any white space, ``*`` any letters, other signs themselves."""
    out = []
    for c in words:
        if c == " ":
            out.append(f"(?:{SPACE}|{INVISIBLE})++")
        elif c == "*":
            out.append(r"[\p{L}\p{N}|!]*+")
        elif c.isalpha():
            out.append(_letter(c) + _BETWEEN)
        else:
            wide = chr(ord(c) + 0xFEE0) if "!" <= c <= "~" else ""
            own = c if c.isalnum() else "\\" + c
            out.append(f"[{own}{DIGITS.get(c, '')}{wide}]{INVISIBLE}*+")
    return "".join(out)


def any_of(*words: str) -> str:
    return "(?:" + "|".join(map(loose, words)) + ")"


def begins(*starts: str) -> str:
    """A look ahead: whether a word with one of these two first letters may stand here (a first letter is tried once)."""
    by_first: dict[str, list[str]] = {}
    for first, second in starts:
        by_first.setdefault(first, []).append(_letter(second))
    return "(?=" + "|".join(f"{_letter(c)}{_BETWEEN}(?:{'|'.join(rest)})" for c, rest in by_first.items()) + ")"
