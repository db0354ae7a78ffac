"""Repair of text from scanned pages: cut words, misread characters, running
headers and page numbers.

A record is read as the character stream of its lines.  Around every token that
is no settled word (a rare one, one with a frequent word in reach of the
confusion table, a fragment before a cut mark) a window of the stream is decoded
as a whole: one dynamic program over it joins any number of fragments (at cut
marks, line ends or spaces), parts words that ran together and undoes
confusions, all with one cost, the logarithm of how rare a word is plus what an
error costs.  The kinds of noise are read off the cheapest path.  A suspended
compound stays because its join is no word.

What is printed on every page is found over the whole report: each page hands on
its edge lines in a form in which confusable characters are equal; a line that
comes back on at least half of a report's pages, and does so in most reports it
occurs in, is a running header or footer.  Lines longer than ``HEADER`` are
handed on by their ends; reports in which those agree are read once more with
whole lines, so a header has no longest length.  Page numbers are the numbers at
the foot that keep one distance from the file's own count.  Words cut between
two pages are joined by report and page.

Defined results: null and empty texts have no noise and stay as they are;
repeated rows count once; a record has each kind at most once; suspended
compounds, ranges of years, note numbers in mid-page and codes are kept; words
that ran together are parted in the text but are no case.
"""

from __future__ import annotations

import math
import re
from collections import ChainMap
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from stratafin.llm import lexicon as X
from stratafin.llm.canonical import Canon, worker_canon
from stratafin.session import stage

#: How many times as frequent as a token the word must be that it is taken for; the same for short words.
RATIO, RATIO_SHORT = 5, 40
#: Share of a report's pages a header is on; share of the reports with such a line in which it comes back.
ON_PAGES, IN_REPORTS = 0.5, 0.5
#: Longest edge line handed on whole; characters of a record's two ends that are; characters by which longer lines are told apart at first.
HEADER, EDGE, PROBE = 110, 111, 48
#: Tasks over which one header's reports are spread.
SPREAD = 16
#: Costs in the decoding, as powers of ten of likelihood: a cut at a mark, at a space or line end, two words run together, a confusion, a mark left open; an unknown word beyond the whole corpus.
AT_MARK, AT_SPACE, RUN_ON, CONFUSED, OPEN, UNKNOWN = 0.1, 1.5, 1.0, 0.5, 4.0, 1.5
#: Shortest settled fragment that is joined without a mark; shortest unknown token that is parted; share of all words from which a word of two letters is a part.
FRAGMENT, PARTED, FREQUENT = 3, 6, 1e-3
_MEMO = 400_000

_MARKS = X.MARKS
_TOKEN = re.compile(r"[^\W_]+(?:[|!$][^\W_]*)*|[|!$][^\W_]+(?:[|!$][^\W_]*)*")
_GAP = re.compile(rf"([{_MARKS}]?)(\s+)")
_DANGLING = re.compile(rf"[{_MARKS}]\s*$")
_NUMBER = re.compile(r"(?<![\w.,])(?=[^\s]*\d)[\dOoSslI|!BОоЗзб]+(?:[.,][\dOoSslI|!BОоЗзб]+)*(?![\w|!])")
_PAGE = re.compile(r"\[\[PAGE:(\d+)\]\]")
_NUMS = re.compile(r"^(?P<pre>[^\d\n]{0,14}?)(?P<n>\d{1,6})(?P<mid>\s*(?:/|из|of)\s*(?P<total>\d{1,6}))?(?P<post>[^\d\n]{0,4})$", re.I)
#: What may stand before a printed page number.
_PAGE_WORDS = {"", "-", "—", "–", "[", "с", "с.", "стр", "стр.", "страница", "лист", "л.", "page", "p.", "pg.", "p"}


class Scan:
    """Decoding of single records with one vocabulary; kept per worker.

    ``extra`` are words beyond the vocabulary that the records at hand ask for;
    ``total`` counts the occurrences of all words.
    """

    def __init__(self, canon: Canon, total: int | None = None, extra: dict[tuple[str, str], int] | None = None):
        self.canon = canon
        self.words = ChainMap(extra, canon.words) if extra else canon.words
        self.tries = {a: [canon.trie[a], *([X.Trie((w, n) for (b, w), n in extra.items() if a == b)] if extra else [])] for a in "CL"}
        self.memo: dict[tuple[str, str], str | None] = {}
        self.rare: dict[tuple[str, str], bool] = {}
        self.windows: dict[tuple[str, str, bool], tuple[str, bool, bool]] = {}
        self.clean: dict[str, set[str]] = {"C": set(), "L": set()}
        self.total = (total or sum(canon.words.values())) + 1
        self.unknown = math.log10(self.total) + UNKNOWN
        self.longest = max(t.longest for tries in self.tries.values() for t in tries)

    def meant(self, token: str, a: str) -> str | None:
        """The word a token is a misreading of, None if it stands as it is."""
        key = (a, token)
        if key not in self.memo:
            if len(self.memo) > _MEMO:
                self.memo.clear()
            self.memo[key] = self._meant(token, a)
        return self.memo[key]

    def _meant(self, token: str, a: str) -> str | None:
        low = token.lower()
        letters = [c for c in low if c.isalpha()]
        if not letters:
            return None
        odd = len(letters) < len(low)
        own = 0 if odd else self.words.get((a, low), 0)
        if odd and (len(letters) < 2 or len(letters) <= len(low) - len(letters)):
            return None
        need = max(X.RARE, own * (RATIO if len(low) > 3 else RATIO_SHORT))
        found = []
        for b in (a, "L" if a == "C" else "C"):
            if b != a and not (odd and all(X.script(c) in (b, "") for c in letters)) and X.script(letters[0]) != b:
                continue
            if b != a and not odd:
                own = self.words.get((b, low), 0) + self.words.get((a, low), 0)
                need = max(X.RARE, own * RATIO)
            found += [(-cost, n, w) for trie in self.tries[b] for cost, w, n in trie.noisy(low) if cost and n >= need]
        if found:
            return _cased(token, max(found)[2])
        if odd and len(letters) >= 3 and token[1:].lower() == token[1:] and any(c.isdigit() or c in "|!$" for c in low[1:]):
            main = X.script(letters[0])
            fixed = "".join(c if c.isalpha() else next((m for m in X.MISREAD.get(c, ()) if X.script(m) == main), c) for c in low)
            return _cased(token, fixed) if fixed.isalpha() else None
        return None

    def count(self, word: str, a: str) -> int:
        low = word.lower()
        return self.words.get((a, low), 0) or self.words.get(("L", low), 0)

    def known(self, word: str, a: str) -> tuple[int, str] | None:
        """(edits, word) if a joined string is a word, perhaps misread."""
        got = self.meant(word, a)
        if got and (a, got.lower()) in self.words:
            return 1, got
        return (0, word) if self.count(word, a) >= X.RARE else None

    def unsettled(self, token: str, a: str) -> bool:
        """Whether a token makes its surroundings worth decoding: misread, or a rare word that is part of others or made of them."""
        if self.meant(token, a) is not None:
            return True
        return self.is_rare(token, a)

    def is_rare(self, token: str, a: str) -> bool:
        key = (a, token)
        if key not in self.rare:
            if len(self.rare) > _MEMO:
                self.rare.clear()
            self.rare[key] = token.isalpha() and self.count(token, a) < X.RARE
        return self.rare[key]

    def cost(self, n: int) -> float:
        return math.log10(self.total / n) if n >= X.RARE else self.unknown

    def parted(self, token: str, a: str) -> tuple[float, list[str]] | None:
        """(cost, words) of the cheapest segmentation of an unknown token into known words, by walks of the trie."""
        low = token.lower()
        n = len(low)
        best: list[tuple[float, int]] = [(0.0, 0)] + [(math.inf, 0)] * n
        for i in range(n - 1):
            if best[i][0] == math.inf:
                continue
            nodes = [(t, t.root) for t in self.tries[a]]
            for j in range(i + 1, n + 1):
                nodes = [(t, to) for t, node in nodes if (to := t.step(node, low[j - 1]))]
                if not nodes:
                    break
                k = max(t.count(node) for t, node in nodes)
                if k < X.RARE or j - i < 2 or (j - i < FRAGMENT and k < FREQUENT * self.total) or (i == 0 and j == n):
                    continue
                cost = best[i][0] + self.cost(k) + (RUN_ON if i else 0.0)
                if cost < best[j][0]:
                    best[j] = (cost, i)
        if best[n][0] == math.inf:
            return None
        cuts, j = [], n
        while j:
            cuts.append((best[j][1], j))
            j = best[j][1]
        return best[n][0], [token[i:j] for i, j in reversed(cuts)]

    def single(self, token: str, a: str, end: bool, open_end: bool) -> tuple[float, str, bool]:
        """(cost, text, misread) of one token by itself: as it stands, as another word, as several."""
        if not token.isalpha():
            if not any(map(str.isalpha, token)):
                return 0.0, token, False
            got = self.meant(token, a)
            return self.cost(self.count(got or "", a)) + (OPEN if open_end else 0.0), got or token, got is not None
        as_is = self.cost(self.count(token, a)) + (OPEN if open_end else 0.0)
        if not (end and len(token) < 5) and (got := self.meant(token, a)) is not None:
            return min(as_is - CONFUSED, self.cost(self.count(got, a)) + CONFUSED), got, True
        if len(token) >= PARTED and not end and (token.islower() or token.isupper()) and self.is_rare(token, a):
            parts = self.parted(token, a)
            if parts and parts[0] < as_is:
                return parts[0], " ".join(parts[1]), False
        return as_is, token, False

    def window(self, text: str, a: str, dangling: bool) -> tuple[str, bool, bool]:
        """(text, any cut word, any misreading): the cheapest reading of a part of the stream.

        ``dangling`` says that the last token stands before an open mark.
        """
        key = (a, text, dangling)
        if key not in self.windows:
            if len(self.windows) > _MEMO:
                self.windows.clear()
            self.windows[key] = self._window(text, a, dangling)
        return self.windows[key]

    def _window(self, text: str, a: str, dangling: bool) -> tuple[str, bool, bool]:
        at = [m.span() for m in _TOKEN.finditer(text)]
        token = [text[i:j] for i, j in at]
        gap = [text[i[1] : j[0]] for i, j in zip(at, at[1:])]
        link = [_GAP.fullmatch(g) for g in gap]  # joinable: a mark and white space, or white space within a paragraph
        mark = [bool(m and m.group(1)) for m in link]
        n = len(token)
        best: list[tuple[float, int, str, bool, bool]] = [(0.0, 0, "", False, False)] + [(math.inf, 0, "", False, False)] * n
        for j in range(1, n + 1):
            open_end = mark[j - 1] if j < n else dangling
            last = gap[j - 1] if j < n else ""
            cost, said, bad = self.single(token[j - 1], a, open_end or (j > 1 and mark[j - 2]), open_end)
            best[j] = (best[j - 1][0] + cost, j - 1, said + last, False, bad)
            word, marks, spaces = token[j - 1], 0, 0
            for i in range(j - 2, -1, -1):
                if link[i] is None or len(token[i]) + len(word) > self.longest + 1:
                    break
                word = token[i] + word
                if mark[i]:
                    marks += 1
                elif "\n" in gap[i] and gap[i].count("\n") > 1:
                    break
                else:
                    spaces += 1
                if spaces and not self._fragments(token[i:j], a):
                    continue
                got = self.known(word, a)
                if got is None or (spaces and got[0]):
                    continue
                cost = self.cost(self.count(got[1], a)) + AT_MARK * marks + AT_SPACE * spaces + CONFUSED * got[0]
                if best[i][0] + cost < best[j][0]:
                    best[j] = (best[i][0] + cost, i, got[1] + last, True, bool(got[0]))
        out, cut, bad, j = [], False, False, n
        while j:
            _, i, said, joined, wrong = best[j]
            out.append(said)
            cut, bad, j = cut or joined, bad or wrong, i
        return "".join(out[::-1]), cut, bad

    def _fragments(self, tokens: list[str], a: str) -> bool:
        """Whether tokens without a mark between them may be parts of one word: one is no word itself, the others
        are not too short, and only the first may begin with a capital."""
        if not all(t.isalpha() for t in tokens) or not any(self.is_rare(t, a) for t in tokens):
            return False
        if any(len(t) < FRAGMENT and not self.is_rare(t, a) for t in tokens):
            return False
        return all(t.islower() for t in tokens[1:]) or all(t.isupper() for t in tokens)

    def repair(self, text: str) -> tuple[str, bool, bool]:
        """(text with words joined and parted and misreadings undone, any cut word, any misreading)."""
        a = X.written_in(text)
        odd, numeric, cuts = self._unsettled(text, a)
        cut = bad = False
        if odd or cuts:
            text, cut, bad = self._decode(text, a, odd)

        def number(m: re.Match) -> str:
            nonlocal bad
            t = m.group()
            if t.replace(",", "").replace(".", "").isdigit():
                return t
            bad = True
            return "".join(X.DIGIT_LIKE.get(c, c) for c in t)

        if numeric:
            text = _NUMBER.sub(number, text)
        return text, cut, bad

    def _unsettled(self, text: str, a: str) -> tuple[set[str], bool, bool]:
        """(unsettled tokens, any number with a letter in it, any cut mark); a piece without any is not looked at again."""
        clean = self.clean[a]
        if len(clean) > _MEMO:
            clean.clear()
        odd: set[str] = set()
        numeric = cuts = False
        for p in set(text.split()) - clean:
            wrong = [t for t in _TOKEN.findall(p) if self.unsettled(t, a)]
            lettered = _LETTERED.search(p) is not None
            open_end = p[-1] in _MARKS and len(p) > 1 and p[-2].isalnum()
            odd.update(wrong)
            numeric |= lettered
            cuts |= open_end
            if not (wrong or lettered or open_end) and len(p) < 64:
                clean.add(p)
        return odd, numeric, cuts

    def asks(self, text: str) -> set[tuple[str, str]]:
        """(alphabet, word) of all words that could change how a text is decoded: its unsettled tokens, the joins and parts of them and what these may be misread from."""
        a = X.written_in(text)
        odd, _, cuts = self._unsettled(text, a)
        if not (odd or cuts):
            return set()
        heard: set[str] = set()
        for i, j, _ in self._windows(text, a, odd):
            at = [m.span() for m in _TOKEN.finditer(text, i, j)]
            tokens = [text[x:y].lower() for x, y in at]
            for k, t in enumerate(tokens):
                heard |= X.variants(t)
                if len(t) >= PARTED and t.isalpha():
                    heard.update(t[x:y] for x in range(len(t)) for y in range(x + 2, len(t) + 1))
                word = t
                for m in range(k + 1, len(tokens)):
                    if not _GAP.fullmatch(text, at[m - 1][1], at[m][0]):
                        break
                    word += tokens[m]
                    heard |= X.variants(word)
        return {(b, w) for w in heard if w.isalpha() for b in "CL" if (b, w) not in self.words}

    def _windows(self, text: str, a: str, odd: set[str]) -> Iterator[tuple[int, int, bool]]:
        """(from, to, before an open mark) of the windows of a text: each reaches from an unsettled token or a cut mark to the settled tokens beside it."""
        at = [m.span() for m in _TOKEN.finditer(text)]
        link = [_GAP.fullmatch(text, i[1], j[0]) for i, j in zip(at, at[1:])]
        k, n = 0, len(at)
        hot = [text[i:j] in odd for i, j in at]
        for i, m in enumerate(link):
            if m and m.group(1):
                hot[i] = hot[i + 1] = True
        while k < n:
            if not hot[k]:
                k += 1
                continue
            first = k - 1 if k and link[k - 1] else k
            while k + 1 < n and (hot[k + 1] or hot[k]) and link[k]:
                k += 1
            yield at[first][0], at[k][1], k == n - 1 and _DANGLING.match(text, at[k][1]) is not None
            k += 1

    def _decode(self, text: str, a: str, odd: set[str]) -> tuple[str, bool, bool]:
        """A text with its windows decoded."""
        out, done, cut, bad = [], 0, False, False
        for i, j, dangling in self._windows(text, a, odd):
            said, joined, wrong = self.window(text[i:j], a, dangling)
            out += [text[done:i], said]
            done, cut, bad = j, cut or joined, bad or wrong
        return "".join([*out, text[done:]]), cut, bad


_LETTERED = re.compile(r"\d(?:[.,]?[OoSslI|!BОоЗзб]|(?<=[OoSslI|!BОоЗзб]\d)|(?<=[OoSslI|!BОоЗзб][.,]\d))")


def _cased(like: str, word: str) -> str:
    if like.isupper() and len(like) > 1:
        return word.upper()
    return word[:1].upper() + word[1:] if like[:1].isupper() else word


_SKELETON = str.maketrans({"0": "о", "8": "в", "6": "б", "4": "ч", "3": "з", "е": "с", "т": "г", "н": "п", "л": "п", "и": "п", "ц": "п", "ш": "щ", "o": "о", "b": "в", "h": "в", "1": "i", "l": "i", "!": "i", "|": "i", "5": "s", "$": "s", "9": "g", "e": "с", "c": "с", "n": "u"})
_PAIRS = (("rn", "m"), ("vv", "w"), ("cl", "d"))


def skeleton(text: str) -> str:
    """A form in which confusable characters are equal, without spaces; numbers are #."""
    low = re.sub(r"(?<![^\W\d_])[\dolsi|!оз][\dolsi|!оз.,]*(?![^\W\d_])", lambda m: "#" if re.search(r"\d", m.group()) else m.group(), text.lower())
    for x, y in _PAIRS:
        low = low.replace(x, y)
    return "".join(low.translate(_SKELETON).split())


def page_number(line: str) -> tuple[str, int] | None:
    """(form, number) if a line may be a printed page number and nothing else."""
    if len(line) - line.count(" ") - line.count("\t") > _NUM_LINE:
        return None
    line = " ".join(line.split())
    low = re.sub(r"(?<=\d)[OoSlI]|(?<![^\W\d_])[OoSlI](?=\d)|(?<=[\s/\[.])[OSlI](?=\s|$|\])", lambda m: X.DIGIT_LIKE[m.group()], line)
    m = _NUMS.match(low.strip())
    if not m:
        return None
    pre, post = m["pre"].strip().lower(), m["post"].strip()
    if skeleton(pre) not in _PAGE_FORMS or post not in ("", "-", "—", "–", "]", "."):
        return None
    total = bool(m["total"])
    if total and int(m["total"]) < int(m["n"]):
        return None
    return f"{skeleton(pre)}{'/' if total else ''}{post}", int(m["n"])


#: Signs of the longest line the pattern of a page number can match, spaces apart.
_NUM_LINE = 34
_PAGE_FORMS = {skeleton(w) for w in _PAGE_WORDS}

PIECE = "doc string, page int, block_no int, cut boolean, bad boolean, top string, low string, num_form string, num int, tail string, head string, stop string"


def _piece(scan: Scan, text: str, edge: int | None = EDGE) -> tuple:
    """What one page's part of a record tells: its decoded text, flags, edges, number, open ends, what is glued to the second.

    The edges are ``edge`` characters of the two ends, or the whole first and last lines.
    """
    fixed, cut, bad = scan.repair(text)
    body = fixed.strip()
    if not body:
        return fixed, cut, bad, None, None, None, None, None, None, None
    rest, _, last = body.rpartition("\n")
    num = page_number(last)
    if num:
        body = rest.rstrip()
    elif rest:
        rest, _, above = rest.rstrip().rpartition("\n")
        num = page_number(above)
        if num:
            body = f"{rest.rstrip()}\n{last}".lstrip()
    if not body:
        return fixed, cut, bad, None, None, *num, None, None, None
    if edge is None:
        return fixed, cut, bad, body.partition("\n")[0].strip(), body.rpartition("\n")[2].strip(), *(num or (None, None)), None, None, None
    top, low = body[:edge], body[-edge:]
    tail = head = stop = None
    for end in (low, low.rpartition("\n")[0].rstrip()):
        if end[-1:] in _MARKS and end and (m := _TAIL.search(end)):
            tail = m.group(1)
            break
    for start in (0, top.find("\n") + 1):
        if (m := _HEAD.match(top, start)) and m.group(1)[0].islower():
            head, stop = m.groups()
            break
    return fixed, cut, bad, top, low, *(num or (None, None)), tail, head, stop or None


def paragraphs(text: str) -> str:
    """Lines joined to continuous paragraphs, at the boundaries a dynamic program finds cheapest.

    A paragraph costs 1; joining two lines costs what speaks against it: the end
    of a sentence on a short line, a heading, a table row. Blank lines, table
    rows and page marks always stand apart.
    """
    lines = text.split("\n")
    widths = [len(x) for x in lines if x.strip() and not _APART.match(x)]
    full = sorted(widths)[int(len(widths) * 0.8)] if widths else 0
    n = len(lines)
    best, back = [0.0] + [float("inf")] * n, [0] * (n + 1)
    for j in range(1, n + 1):
        cost = 0.0
        for i in range(j - 1, -1, -1):
            if i < j - 1:
                cost += _against(lines[i], lines[i + 1], full)
            if cost >= 8:
                break
            if best[i] + cost + 1 < best[j]:
                best[j], back[j] = best[i] + cost + 1, i
    out, j = [], n
    while j:
        out.append(_joined(lines[back[j] : j]) if j - back[j] > 1 else lines[back[j]])
        j = back[j]
    return "\n".join(out[::-1])


def _joined(lines: list[str]) -> str:
    """Lines as one; a range or compound broken at its own hyphen closes up, a suspended one keeps its space."""
    text = lines[0].strip()
    for x in lines[1:]:
        x = x.strip()
        own = text[-1:] == "-" and text[-2:-1].isalnum() and x[:1].isalnum() and x.split()[0].lower() not in X.SUSPENDED
        text += x if own else " " + x
    return text


_APART = re.compile(r"\s*(?:$|\||#|\[\[PAGE)|.*\S(?:  |\t)\s*\S")


def _against(a: str, b: str, full: int) -> float:
    if _APART.match(a) or _APART.match(b):
        return 8.0
    cost = 0.0
    if a.rstrip()[-1:] in ".!?:;)" and len(a) < 0.8 * full:
        cost += 2.0
    if a.isupper() != b.isupper():
        cost += 4.0
    if b.lstrip()[:1].isupper() and a.rstrip()[-1:] not in ".,;:!?" and len(a) < 0.6 * full:
        cost += 1.5
    return cost - 0.5 * (b.lstrip()[:1].islower())


def clean_text(text: str, marks: Iterable[dict] = ()) -> str:
    """A decoded record without its headers and page numbers, in paragraphs.

    ``marks`` say what to mend on which page (null for a record without marks of
    its own): ``header`` and ``footer`` with the comparable form to take from
    the first or last line, ``number`` for a page number at the foot, ``tail``
    and ``head`` for the fragments of words cut between pages, of which the
    first becomes ``whole``. Nothing else is taken away.
    """
    out, page, marks = [], None, list(marks)
    for i, part in enumerate(_PAGE.split(text)):
        if i % 2:
            out.append(f"[[PAGE:{part}]]")
            page = int(part)
            continue
        here = [m for m in marks if m["page"] in (None, page if page is not None else 0)]
        lines = part.split("\n")
        edge = [k for k, x in enumerate(lines) if x.strip()]
        for m in here:
            if m["kind"] in ("tail", "head") and _close(lines, edge, m):
                marks.remove(m)
        if any(m["kind"] == "number" for m in here):
            for k in edge[-1:-3:-1]:
                if page_number(lines[k]):
                    lines[k] = ""
                    break
        for m in sorted((m for m in here if m["kind"] in ("header", "footer")), key=lambda m: -len(m["form"])):
            first = m["kind"] == "header"
            body = [k for k in edge if lines[k].strip()]
            if not first and len(body) > 1 and page_number(lines[body[-1]]):
                body.pop()
            for k in body[:1] if first else body[-1:]:
                lines[k] = "" if skeleton(lines[k]) == m["form"] else _without(lines[k], m["form"], first)
        out.append(paragraphs("\n".join(lines)).strip("\n"))
    return "\n".join(x for x in out if x)


def _close(lines: list[str], edge: list[int], end: dict) -> bool:
    """Close one open end where ``_piece`` saw it; whether it is there."""
    tail = end["kind"] == "tail"
    for k in edge[:-4:-1] if tail else edge[:2]:
        m = _TAIL.search(lines[k]) if tail else _HEAD.match(lines[k])
        if m and m.group(1) == end["form"]:
            lines[k] = lines[k][: m.start()] + end["whole"] if tail else lines[k][m.end() :].lstrip()
            return True
    return False


def _without(line: str, key: str, first: bool) -> str:
    """A line without the words at one end whose comparable form is ``key``."""
    words = line.split(" ")
    for n in range(1, len(words)):
        part = words[:n] if first else words[-n:]
        if skeleton(" ".join(part)) == key:
            return " ".join(words[n:] if first else words[:-n])
    return line


def repair_texts(texts: DataFrame, lex: Lexicon) -> DataFrame:
    """(rec_table, rec_id, text): every record as continuous paragraphs without headers and page numbers, words cut between pages whole on the first.

    Every text is decoded once and staged with what its pages tell. What
    ``find_noise`` says of them is brought to the decoded record by its key, a
    list as long as its pages; texts are moved once.
    """
    texts = with_extra(texts, ["rec_table", "rec_id"], "text", lex)
    records = stage(read_records(texts, lex))
    edges = stage(page_edges(pieces_of(records)))
    marked = F.col("rec_table") == "parser_result"
    none = F.lit(None).cast("string")
    told = lambda rec, page, kind, form=none, whole=none: (F.col("rec_table"), F.col(rec).alias("rec_id"), F.struct(F.when(marked, page).alias("page"), F.lit(kind).alias("kind") if isinstance(kind, str) else kind.alias("kind"), form.alias("form"), whole.alias("whole")).alias("mark"))
    kind = F.when(F.col("first"), "header").otherwise("footer")
    split = cut_at_pages(edges, lex)
    marks = header_ends(texts, edges, lex).select(*told("rec_id", F.col("page"), kind, F.col("key")))
    marks = marks.union(page_numbers(edges).select(*told("rec_id", F.col("page"), "number")))
    marks = marks.union(split.select(*told("one", F.col("page"), "tail", F.col("tail"), F.concat("word", F.coalesce("stop", F.lit(""))))))
    marks = marks.union(split.select(*told("two", F.col("page") + 1, "head", F.col("head"))))
    of_record = marks.groupBy("rec_table", "rec_id").agg(F.collect_set("mark").alias("marks"))
    full = records.select("rec_table", "rec_id", "decoded").join(of_record, ["rec_table", "rec_id"], "left").select("rec_table", "rec_id", "decoded", "marks")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = [clean_text(t, m or ()) if t else t for t, m in zip(*(c.to_pylist() for c in batch.columns[2:]))]
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(done, pa.string())], names=["rec_table", "rec_id", "text"])

    return full.mapInArrow(run, "rec_table string, rec_id bigint, text string")


_TAIL = re.compile(rf"([^\W_]+)[{_MARKS}]\s*$")
_HEAD = re.compile(r"\s*([^\W\d_]+)((?:-[^\W\d_]+)*[.,;:!?%)\]}»”’\"'…]*)")


def read_records(texts: DataFrame, lex: Lexicon, edge: int | None = EDGE, keep: bool = True) -> DataFrame:
    """(rec_table, rec_id, decoded, pieces) of (rec_table, rec_id, doc, page, block_no, text, extra): every record decoded (null without ``keep``), with what each of its pages tells."""
    scans = lex.shared(texts)
    kinds = {"string": pa.string(), "int": pa.int32(), "boolean": pa.bool_()}
    fields = [pa.field(f.split()[0], kinds[f.split()[1]]) for f in PIECE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, ends, done, cols = [], [0], [], [c.to_pylist() for c in batch.columns]
            for kind, doc, page, no, text, scan in zip(cols[0], *cols[2:6], scans(cols[6])):
                said = text
                if text and kind != "parser_result":
                    said, *told = _piece(scan, scan.canon.text(text), edge)
                    rows.append((doc, page, no, *told))
                elif text:
                    parts = _PAGE.split(scan.canon.text(text))
                    for i in range(0, len(parts), 2):
                        if i or parts[0].strip():
                            parts[i], *told = _piece(scan, parts[i], edge)
                            rows.append((doc, int(parts[i - 1]) if i else 0, 0, *told))
                    said = "".join(f"[[PAGE:{x}]]" if i % 2 else x for i, x in enumerate(parts))
                done.append(said if keep else None)
                ends.append(len(rows))
            flat = pa.StructArray.from_arrays([pa.array(c, f.type) for c, f in zip(list(zip(*rows)) or [()] * len(fields), fields)], fields=fields)
            pieces = pa.ListArray.from_arrays(pa.array(ends, pa.int32()), flat)
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(done, pa.string()), pieces], names=["rec_table", "rec_id", "decoded", "pieces"])

    kind = ", ".join(f.replace(" ", ":") for f in PIECE.split(", "))
    return texts.select("rec_table", "rec_id", "doc", "page", "block_no", "text", "extra").mapInArrow(run, f"rec_table string, rec_id bigint, decoded string, pieces array<struct<{kind}>>")


def pieces_of(records: DataFrame) -> DataFrame:
    """One row a record and page; decoded texts stay behind."""
    return records.select("rec_table", "rec_id", F.inline_outer("pieces")).filter("cut IS NOT NULL")


def read_pieces(texts: DataFrame, lex: Lexicon, edge: int | None = EDGE) -> DataFrame:
    return pieces_of(read_records(texts, lex, edge, keep=False).select("rec_table", "rec_id", "pieces"))


class Lexicon:
    """The words a corpus is read with: the most frequent ones, which are broadcast, and the table of all others.

    ``rest`` (alphabet, word, n) is null where all words fit; else each record
    brings the words it asks for along (``with_extra``), so a rare word decides
    as it would in the vocabulary. ``total`` counts the occurrences of all words.
    """

    def __init__(self, words: dict[tuple[str, str], int], rest: DataFrame | None = None, total: int | None = None):
        self.words, self.rest, self.total = words, rest, total or sum(words.values())

    @classmethod
    def of(cls, counts: DataFrame, size: int = X.VOCABULARY) -> Lexicon:
        counts = stage(counts.filter(F.col("n") >= X.RARE))
        words = X.vocabulary(counts, size, staged=True)
        return cls(words, *X.beyond(counts, words))

    def shared(self, df: DataFrame):
        """What gives a worker the scan of every row, by the row's own extra words (null for none)."""
        words, total, name = df.sparkSession.sparkContext.broadcast(self.words), self.total, f"{X.fingerprint(self.words)}-{self.total}"

        def scans(extra: list[list[dict] | None]) -> list[Scan]:
            if name not in _scans:
                _scans.clear()
                _scans[name] = Scan(worker_canon(name, words.value), total)
            main = _scans[name]
            if not any(extra):
                return [main] * len(extra)
            more = Scan(main.canon, total, {(e["alphabet"], e["word"]): e["n"] for x in extra for e in x or ()})
            return [more if x else main for x in extra]

        return scans


_scans: dict[str, Scan] = {}
EXTRA = "array<struct<alphabet:string,word:string,n:bigint>>"


def with_extra(rows: DataFrame, keys: list[str], text: str, lex: Lexicon, whole: bool = False) -> DataFrame:
    """``rows`` with ``extra``: the words beyond the vocabulary that a row's text asks for (``whole``: the text is one word).

    Where all words fit nothing is done. Else what the unsettled parts of every
    text could be is joined by word with the other words of the corpus, none of
    which is frequent, and brought back by the row's key.
    """
    if lex.rest is None:
        return rows.withColumn("extra", F.lit(None).cast(EXTRA))
    scans, n = lex.shared(rows), len(keys)
    kinds = StructType([*(rows.schema[k] for k in keys), StructField("alphabet", StringType()), StructField("word", StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scan = scans([None])[0]
            at, asked = [], []
            for i, t in enumerate(batch.column(n).to_pylist()):
                if t:
                    got = [(b, w) for w in X.variants(t.lower()) for b in "CL" if (b, w) not in scan.words] if whole else scan.asks(scan.canon.text(t))
                    at += [i] * len(got)
                    asked += got
            taken = batch.select(keys).take(pa.array(at, pa.int64()))
            yield pa.RecordBatch.from_arrays([*taken.columns, pa.array([b for b, _ in asked], pa.string()), pa.array([w for _, w in asked], pa.string())], names=[*keys, "alphabet", "word"])

    asked = rows.select(*keys, text).mapInArrow(run, kinds).distinct()
    extra = asked.join(lex.rest, ["alphabet", "word"]).groupBy(*keys).agg(F.collect_list(F.struct("alphabet", "word", "n")).alias("extra"))
    return rows.drop("extra").join(extra, keys, "left")


def page_edges(pieces: DataFrame) -> DataFrame:
    """One row a page: its first and last text, its number, its open ends (combined before the shuffle)."""
    first = lambda s, cond: F.min_by(s, F.when(cond, F.struct("block_no", "rec_id")))
    last = lambda s, cond: F.max_by(s, F.when(cond, F.struct("block_no", "rec_id")))
    has = lambda c: F.col(c).isNotNull()
    return pieces.filter("doc IS NOT NULL AND page IS NOT NULL").groupBy("doc", "page").agg(
        F.min(F.when(has("top") | has("num"), F.col("block_no"))).alias("from_no"),
        F.max(F.when(has("top") | has("num"), F.col("block_no"))).alias("to_no"),
        first(F.struct("rec_table", "rec_id", "top"), has("top")).alias("first"),
        last(F.struct("rec_table", "rec_id", "low"), has("low")).alias("last"),
        last(F.struct("rec_table", "rec_id", "block_no", "num_form", "num"), has("num")).alias("num"),
        last(F.struct("rec_table", "rec_id", "block_no", "tail"), has("tail")).alias("tail"),
        first(F.struct("rec_table", "rec_id", "block_no", "head", "stop"), has("head")).alias("head"),
    )


def comparable(rows: DataFrame, source: dict[str, str]) -> DataFrame:
    """``rows`` with columns that hold the comparable forms of the named columns' texts."""
    at = {new: rows.columns.index(old) for new, old in source.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            forms = [pa.array([skeleton(x) if x else None for x in batch.column(i).to_pylist()], pa.string()) for i in at.values()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *forms], names=[*batch.schema.names, *at])

    return rows.mapInArrow(run, StructType([*rows.schema.fields, *(StructField(c, StringType()) for c in at)]))


def recurring(edges: DataFrame) -> DataFrame:
    """(doc, key, n, n_pages, long, back): the comparable forms of a report's edge lines by how many pages they are on.

    ``long`` marks those of the probes that stand for lines beyond ``HEADER``;
    ``back`` says that a form is on the share ``ON_PAGES`` of the pages, two at least.
    """
    top, low = F.substring_index("first.top", "\n", 1), F.substring_index("last.low", "\n", -1)
    line = lambda c, probe: F.when(F.length(c) > HEADER, F.struct(probe.alias("line"), F.lit(True).alias("long"))).when(F.length(c) >= 4, F.struct(c.alias("line"), F.lit(False).alias("long")))
    ends = F.array_distinct(F.array_compact(F.array(line(top, F.left(top, F.lit(PROBE))), line(low, F.right(low, F.lit(PROBE))))))
    lines = comparable(edges.select("doc", "page", F.inline(ends)), {"key": "line"})
    lines = lines.filter(F.length("key") >= 4).select("doc", "page", "key", "long").distinct()
    pages = edges.groupBy("doc").agg(F.count("*").alias("n_pages"))
    of_doc = lines.groupBy("doc", "key", "long").agg(F.count("*").alias("n")).join(pages, "doc")
    return of_doc.withColumn("back", (F.col("n") >= 2) & (F.col("n") >= ON_PAGES * F.col("n_pages")))


def running_headers(of_doc: DataFrame) -> DataFrame:
    """(doc, key): the lines of ``recurring`` that come back in most reports they are in.

    One issuer's header may stand in a tenth of all reports, so a key's reports
    are spread over ``SPREAD`` tasks.
    """
    of_key = of_doc.filter("n_pages >= 2").groupBy("key").agg(F.avg(F.col("back").cast("int")).alias("share")).filter(F.col("share") >= IN_REPORTS)
    of_key = of_key.select("key", F.explode(F.sequence(F.lit(0), F.lit(SPREAD - 1))).alias("salt"))
    salted = of_doc.filter("back").select("doc", "key", F.pmod(F.xxhash64("doc"), F.lit(SPREAD)).cast("int").alias("salt"))
    return salted.join(of_key, ["key", "salt"]).select("doc", "key")


def header_ends(texts: DataFrame, edges: DataFrame, lex: Lexicon) -> DataFrame:
    """(rec_table, rec_id, page, first, key): records that begin a page with a running header (``first``) or end it with one.

    Reports in which the probes of long lines come back are read again with
    whole edge lines, whatever their length.
    """
    seen = stage(recurring(edges))
    out = _ends_with(edges, running_headers(seen.filter("NOT long")))
    docs = stage(seen.filter("long AND back").select("doc").distinct())
    if docs.isEmpty():
        return out
    whole = stage(page_edges(read_pieces(texts.join(docs, "doc", "left_semi"), lex, None)))
    line = lambda c: F.struct(F.col(c).alias("line"))
    lines = comparable(whole.select("doc", "page", F.inline(F.array(line("first.top"), line("last.low")))), {"key": "line"}).filter(F.length("line") > HEADER)
    pages = whole.groupBy("doc").agg(F.count("*").alias("n_pages"))
    of_doc = lines.select("doc", "page", "key").distinct().groupBy("doc", "key").agg(F.count("*").alias("n")).join(pages, "doc")
    of_doc = of_doc.withColumn("back", (F.col("n") >= 2) & (F.col("n") >= ON_PAGES * F.col("n_pages")))
    return out.union(_ends_with(whole, running_headers(of_doc)))


def _ends_with(edges: DataFrame, keys: DataFrame) -> DataFrame:
    """The ends of pages that begin or end with one of their report's keys, alone or joined to other text."""
    keys = keys.groupBy("doc").agg(F.collect_set("key").alias("keys"))  # a report has a handful
    heads = edges.join(keys, "doc").select("page", "first", "last", "keys", F.col("first.top").alias("top"), F.col("last.low").alias("low"))
    heads = comparable(heads, {"top_form": "top", "low_form": "low"})
    longest = lambda hit: F.array_max(F.transform(F.filter("keys", hit), lambda k: F.struct(F.length(k).alias("n"), k.alias("key"))))
    top, low = longest(lambda k: F.startswith("top_form", k)), longest(lambda k: F.endswith("low_form", k))
    row = lambda s, first, hit: F.when(hit.isNotNull(), F.struct(F.col(f"{s}.rec_table").alias("rec_table"), F.col(f"{s}.rec_id").alias("rec_id"), F.col("page"), F.lit(first).alias("first"), hit["key"].alias("key")))
    return heads.select(F.inline(F.array_compact(F.array(row("first", True, top), row("last", False, low)))))


def page_numbers(edges: DataFrame) -> DataFrame:
    """(rec_table, rec_id, page) of the numbers at the foot that keep one form and distance from the file's count.

    They must do so on two pages or more and, like headers, on the share
    ``ON_PAGES`` of the report's pages.
    """
    foot = edges.filter("num IS NOT NULL AND num.block_no >= to_no - 1").select("doc", "page", F.col("num.rec_table").alias("rec_table"), F.col("num.rec_id").alias("rec_id"), F.col("num.num_form").alias("form"), (F.col("num.num") - F.col("page")).alias("ahead"))
    pages = edges.groupBy("doc").agg(F.count("*").alias("n_pages"))
    kept = foot.groupBy("doc", "form", "ahead").agg(F.count("*").alias("n")).filter("n >= 2 AND ahead >= 0")
    kept = kept.join(pages, "doc").filter(F.col("n") >= ON_PAGES * F.col("n_pages")).select("doc", "form", "ahead")
    return foot.join(kept, ["doc", "form", "ahead"]).select("rec_table", "rec_id", "page")


def find_noise(texts: DataFrame, lex: Lexicon) -> DataFrame:
    """(rec_table, rec_id, noise) of every record, each kind once.

    The pieces are written once to the shared folder; what follows moves one
    slim row a page.
    """
    texts = with_extra(texts, ["rec_table", "rec_id"], "text", lex)
    pieces = stage(read_pieces(texts, lex))
    edges = stage(page_edges(pieces))
    own = pieces.filter("cut OR bad").select("rec_table", "rec_id", F.explode(F.array_compact(F.array(F.when(F.col("cut"), "hyphen"), F.when(F.col("bad"), "misread")))).alias("noise"))
    heads = header_ends(texts, edges, lex).select("rec_table", "rec_id", F.lit("header").alias("noise"))
    nums = page_numbers(edges).select("rec_table", "rec_id", F.lit("pageno").alias("noise"))
    split = cut_at_pages(edges, lex)
    split = split.select("rec_table", F.explode(F.array("one", "two")).alias("rec_id"), F.lit("hyphen").alias("noise"))
    return own.union(heads).union(nums).union(split).distinct()


def cut_at_pages(edges: DataFrame, lex: Lexicon) -> DataFrame:
    """(rec_table, one, two, page, tail, head, stop, word): words cut between record ``one`` on ``page`` and ``two`` on the next."""
    before = edges.filter("tail IS NOT NULL AND tail.block_no >= to_no - 2").select("doc", (F.col("page") + 1).alias("page"), F.col("tail").alias("a"))
    after = edges.filter("head IS NOT NULL AND head.block_no <= from_no + 2").select("doc", "page", F.col("head").alias("b"))
    pairs = before.join(after, ["doc", "page"])
    return joined_words(pairs.select("a.rec_table", F.col("a.rec_id").alias("one"), F.col("b.rec_id").alias("two"), (F.col("page") - 1).alias("page"), "a.tail", "b.head", "b.stop", F.concat("a.tail", "b.head").alias("word")), lex)


def joined_words(pairs: DataFrame, lex: Lexicon) -> DataFrame:
    """The rows whose ``word`` is one of the corpus, perhaps misread; with the word that is meant."""
    scans = lex.shared(pairs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at = batch.schema.get_field_index("word")
            known = [scan.known(w, X.written_in(w)) for w, scan in zip(batch.column(at).to_pylist(), scans(batch.column("extra").to_pylist()))]
            meant = pa.array([k[1] if k else None for k in known], pa.string())
            yield batch.set_column(at, batch.schema.field(at), meant).select(pairs_columns).filter(meant.is_valid())

    pairs_columns = pairs.columns
    return with_extra(pairs, ["rec_table", "one", "two", "page"], "word", lex, whole=True).mapInArrow(run, pairs.schema)
