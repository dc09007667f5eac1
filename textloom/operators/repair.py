"""Text repair and mark-up parsing that regular expressions in the JVM cannot do; Arrow-batched functions."""

from __future__ import annotations

import html
import re
import unicodedata
from functools import cached_property

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Signs of UTF-8 read as Latin-1, references no HTML table has, names that lost their ampersand, and Unicode hyphens.
MOJIBAKE = ("Ã[\u0080-¿©¨¡¢¤§ª«¬®¯°±²³´µ¶·¸¹º»¼½¾]", "â€[™œ\u009d“”˜¦]", "Â[\u00a0 °±²³·»«]", "ï¿½")
ODD_REFERENCES = {"dquo": '"', "s": "'"}
LOST_AMPERSANDS = ("lsquo", "ldquo", "rsquo", "rdquo", "ndash", "mdash", "nbsp", "hellip")
HYPHENS = {0x2010: "-", 0x2011: "-"}
#: Top domains that end an address and begin no sentence.
DOMAINS = {"com", "org", "net", "edu", "gov", "int", "mil", "info"}
#: Plurals and British spellings of the target words, each to the form that has a vector.
TARGET_VARIANTS = {
    "representations": "representation", "perceptions": "perception", "experiences": "experience", "cognitions": "cognition", "minds": "mind",
    "meanings": "meaning", "intelligences": "intelligence", "computations": "computation", "memories": "memory", "models": "model",
    "networks": "network", "systems": "system", "complexities": "complexity", "behaviour": "behavior", "behaviours": "behavior",
    "behaviors": "behavior", "symbols": "symbol", "signs": "sign", "affordances": "affordance", "embodiments": "embodiment",
    "interfaces": "interface", "users": "user", "agents": "agent", "simulations": "simulation", "images": "image", "mediums": "medium",
}

CLOSING = frozenset(")]\"'”’%")
QUOTE_ENDS = frozenset("\"'”’»)]")
QUOTE_STARTS = frozenset("“‘«([")
EDGES = "\"'“”‘’«»()[]{}<>,;:.!?"


def _is_host(name: str) -> bool:
    labels = name.split(".")
    return len(labels) > 1 and all(x and x.replace("-", "").replace("_", "").isalnum() for x in labels)


def is_address(text: str) -> bool:
    """A web or e-mail address or a DOI, whole."""
    low = text.lower()
    for start in ("http://", "https://", "www."):
        if low.startswith(start):
            return len(low) > len(start)
    registrant, slash, suffix = low.removeprefix("doi:").removeprefix("10.").partition("/")
    if low.removeprefix("doi:").startswith("10.") and registrant.isdecimal() and 4 <= len(registrant) <= 9 and suffix:
        return True
    user, at, host = low.partition("@")
    if at:
        return bool(user) and user.strip("._+-") != "" and _is_host(host)
    host = low.partition("/")[0]
    return _is_host(host) and host.rpartition(".")[2] in DOMAINS


class Run:
    """Where a text's addresses and character references stand, found when the first rule asks and kept for all."""

    def __init__(self, text: str):
        self.text = text

    @cached_property
    def _covered(self) -> bytearray:
        covered, at = bytearray(len(self.text) + 1), 0
        for token in self.text.split(" "):
            core = token.strip(EDGES)
            if ("." in core or "/" in core) and is_address(core):
                start = at + token.index(core)
                size = len(self._without_next_word(core))
                covered[start : start + size] = b"\1" * size
            where = token.find("&")
            while where >= 0:
                end = where + 1 + token.startswith("#", where + 1)
                while end < len(token) and token[end].isalnum():
                    end += 1
                covered[at + where : at + end + 1] = b"\1" * (end + 1 - where)
                where = token.find("&", end)
            at += len(token) + 1
        return covered

    @staticmethod
    def _without_next_word(core: str) -> str:
        """An address to which the next sentence's first word is glued, without that word."""
        head = core.rstrip("".join(c for c in set(core) if c.isalpha()))
        word = core[len(head) :]
        before = head.rstrip("".join(QUOTE_STARTS)).rstrip("".join(QUOTE_ENDS)).rstrip(".?!,;:").rstrip(EDGES)
        glued = word and len(before) < len(head) and word.lower() not in DOMAINS and not before.lower().endswith("www")
        return before if glued and is_address(before) else core

    def covers(self, at: int) -> bool:
        return bool(self._covered[at])


class _Characters(dict):
    """What becomes of each code point: itself, a space, or nothing."""

    SPACES = frozenset("\t\n\v\f\r\x85\u200b\ufffd")

    def __missing__(self, code: int):
        character = chr(code)
        kept = " " if character in self.SPACES else None if unicodedata.category(character) in ("Cc", "Cf") else code
        self[code] = kept
        return kept


_CHARACTERS = _Characters()


def _decode_references(text: str) -> str:
    """Named and numeric references with their semicolon, and the few names that mostly lose their ampersand."""
    if "&" in text:
        first, *rest = text.split("&")
        parts = [first]
        for piece in rest:
            name, semicolon, after = piece.partition(";")
            known = semicolon and (name in ODD_REFERENCES or f"{name};" in html.entities.html5 or _is_number(name))
            parts.append((ODD_REFERENCES.get(name) or html.unescape(f"&{name};")) + after if known else "&" + piece)
        text = "".join(parts)
    for name in LOST_AMPERSANDS:
        if name + ";" in text:
            text = text.replace(name + ";", html.entities.html5[name + ";"])
    return text


def _is_number(name: str) -> bool:
    digits, allowed = (name[2:], "0123456789abcdefABCDEF") if name[1:2] in ("x", "X") else (name[1:], "0123456789")
    return name[:1] == "#" and 0 < len(digits) < 8 and all(c in allowed for c in digits)


def _latin(character: str) -> bool:
    return character.isalpha() and character <= "\u024f"


def _capitalised(text: str, at: int) -> bool:
    """A capital and then a small letter."""
    pair = text[at : at + 2]
    return len(pair) == 2 and _latin(pair[0]) and pair[0].isupper() and _latin(pair[1]) and pair[1].islower()


def _gap_goes(mark: str, left: str, text: str, at: int) -> bool:
    """Whether a blank between ``left`` and the punctuation mark ``text[at]`` is a mistake."""
    if mark in ")]":
        return left.isalnum() or left in CLOSING or left == "."
    if not (left.isalnum() or left in CLOSING):
        return False
    after = text[at + 1 : at + 2]
    if mark == ".":  # not the points of ". . ." or of ".86"
        return not after or after in QUOTE_ENDS - {"»"} or after == " " and text[at + 2 : at + 3] != "."
    if mark == ":" and left.isdecimal():  # ratios keep their blanks
        return not text[at + 1 :].lstrip(" ")[:1].isdecimal()
    return True


def _gap_comes(mark: str, text: str, left: int, at: int) -> int:
    """Where a blank is missing after the mark ``text[at]``, whose left neighbour is ``text[left]``; else -1."""
    before, after = text[left], text[at + 1 : at + 2]
    if mark in ".?!":
        if not (before.isdecimal() or _latin(before) and before.islower() or before in CLOSING - {"%"}):
            return -1
        end = at + 1 + (after != "" and after in QUOTE_ENDS)
        for put in (end, at + 1):  # the sign may close this sentence or open the next
            word = put + (text[put : put + 1] in QUOTE_STARTS and text[put : put + 1] != "")
            if _capitalised(text, word):
                return put
        return -1
    two = left > 0 and _latin(before) and _latin(text[left - 1])
    if mark == ",":
        fits = _latin(before) and after.isalpha() and _latin(after) and (two or _latin(text[at + 2 : at + 3] or " "))
    elif mark == ";":
        fits = (_latin(before) or before.isdecimal() or before in ")]") and after.isalpha() and _latin(after)
    else:
        fits = two and _capitalised(text, at + 1)
    return at + 1 if fits else -1


_MARKS = re.compile(r"[,;:.?!()\[\]]")


def _space_marks(text: str) -> str:
    """Blanks around punctuation, in one pass over the marks of a text whose white space is single blanks."""
    run, edits = Run(text), []
    for found in _MARKS.finditer(text):
        at, mark = found.start(), found[0]
        if mark in "([":
            if text[at + 1 : at + 2] == " " and text[at + 2 : at + 3].isalnum():
                edits.append((at + 1, at + 2, ""))
            continue
        left = at - 1
        if left > 0 and text[left] == " " and mark not in "?!" and _gap_goes(mark, text[left - 1], text, at):
            if not edits or edits[-1][0] != left:
                edits.append((left, at, ""))
            left -= 1
        if mark not in ")]" and left >= 0 and at + 1 < len(text) and text[at + 1] != " ":
            put = _gap_comes(mark, text, left, at)
            if put >= 0 and not run.covers(at):
                edits.append((put, put, " "))
    if not edits:
        return text
    out, done = [], 0
    for start, end, new in edits:
        out += (text[done:start], new)
        done = end
    return "".join(out) + text[done:]


def repair_text(raw: str) -> str:
    """A text without extraction artefacts, in NFKC.

    References are decoded, a soft hyphen rejoins its word, controls and format characters go or become blanks, hyphens are
    plain, white space collapses, blanks before punctuation go and missing ones after it come, but not in addresses and references.
    """
    text = _decode_references(raw).replace("\\n", " ").replace("\u00ad ", "").replace("\u00ad", "").translate(_CHARACTERS)
    return _space_marks(" ".join(unicodedata.normalize("NFKC", text).translate(HYPHENS).split()))


def _before_address(token: str) -> str:
    """What stands before a web address or a DOI in a run without blanks."""
    low, cuts = token.lower(), [len(token)]
    for start in ("http://", "https://", "www.", "doi.org/", "10."):
        at = low.find(start)
        while at >= 0:
            rest = low[at + len(start) :]
            whole = start.startswith("http") or at == 0 or not (low[at - 1].isalnum() or low[at - 1] == "_")
            registrant, slash, suffix = rest.partition("/")
            if whole and rest and (start != "10." or suffix and registrant.isdecimal() and 4 <= len(registrant) <= 9):
                cuts.append(at)
                break
            at = low.find(start, at + 1)
    return token[: min(cuts)]


def _without_formulas(text: str) -> str:
    """Dollar signs in pairs and what they enclose become blanks; doubled ones first."""
    for sign in ("$$", "$"):
        parts = text.split(sign)
        kept, at = [parts[0]], 1
        while at < len(parts):
            if at + 1 < len(parts) and (parts[at] or sign == "$$"):
                kept.append(" " + parts[at + 1])
                at += 2
            else:
                kept.append(sign + parts[at])
                at += 1
        text = "".join(kept)
    return text


_PLAIN = {k: (chr(k) if chr(k).isalnum() or chr(k) == "-" else " ") for k in range(128)}


def preprocess_text(raw: str, variants: dict[str, str]) -> str:
    """Lower-case ASCII words and hyphens: links, DOIs and formulas go, broken lines join, spelling variants become one."""
    text = " ".join(map(_before_address, unicodedata.normalize("NFKC", raw).split())).lower()
    first, *rest = text.split("¬")
    text = first + "".join(x.lstrip() for x in rest)
    text = _without_formulas(unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode())
    words = (w.strip("-") for w in text.translate(_PLAIN).replace("--", "  ").split())
    return " ".join("-".join(variants.get(p, p) for p in w.split("-")) for w in words if w)


def fold(word: str) -> str:
    """Lower case, plain hyphens, no combining marks."""
    return "".join(c for c in unicodedata.normalize("NFKD", word.lower().replace("–", "-")) if not unicodedata.combining(c))


_UNCLOSED_REFERENCE = re.compile(r"&(?=#?[0-9A-Za-z]+(?![0-9A-Za-z;]))")


def markup_text(markup: str, unclosed: bool = True) -> str:
    """Text of HTML or JATS outside titles, scripts and styles, white space collapsed.

    Character references without their semicolon are read as browsers do; without ``unclosed`` they stay as they are written, as in XML.
    """
    from html.parser import HTMLParser

    if not unclosed:
        markup = _UNCLOSED_REFERENCE.sub("&amp;", markup)

    class Reader(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.parts, self.skipped = [], 0

        def handle_starttag(self, tag, attrs):
            self.skipped += tag.endswith("title") or tag in ("script", "style")

        def handle_endtag(self, tag):
            self.skipped -= bool(self.skipped) and (tag.endswith("title") or tag in ("script", "style"))

        def handle_data(self, data):
            if not self.skipped:
                self.parts.append(data)

    reader = Reader()
    reader.feed(markup)
    reader.close()
    return " ".join(" ".join(reader.parts).split())


def column(function, *arguments) -> callable:
    """A string function as an Arrow-batched column function; null gives null."""

    @F.pandas_udf("string")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda x: None if x is None else function(x, *arguments))

    return run


def has_mojibake(text: Column) -> Column:
    return text.rlike("|".join(f"(?:{p})" for p in MOJIBAKE))


_WORDS = re.compile(r"[^\W\d_]+")


def replace_words(replacements: dict[str, str]):
    """Whole words replaced from a dictionary, except within addresses. The dictionary is the few hundred decided words of a build."""

    def replace(text: str) -> str:
        run, out, done = Run(text), [], 0
        for m in _WORDS.finditer(text):
            if m[0] in replacements and not run.covers(m.start()):
                out += (text[done : m.start()], replacements[m[0]])
                done = m.end()
        return "".join(out) + text[done:]

    return column(replace)


def join_broken_words(spaced: set[tuple[str, str]], hyphenated: set[tuple[str, str]]):
    """Decided broken words joined from left to right; a joined word isn't joined again, and addresses and "et al." stay."""

    def join(text: str) -> str:
        run, out, done = Run(text), [], 0
        words = list(_WORDS.finditer(text))
        for a, b in zip(words, words[1:]):
            gap, pair = text[a.end() : b.start()], (a[0].lower(), b[0].lower())
            if pair not in (hyphenated if gap == "-" else spaced) or gap not in (" ", "- ", "-") or a.start() < done:
                continue
            new_sentence = b[0][0].isupper() and not a[0].isupper()
            citation = pair[1] == "al" and text[b.end() : b.end() + 1] == "."
            number = text[a.start() - 1 : a.start()].isdecimal() or text[b.end() : b.end() + 1].isdecimal()
            if not (new_sentence or citation or number or run.covers(a.end())):
                out += (text[done : a.end()], b[0])
                done = b.end()
        return "".join(out) + text[done:]

    return column(join)


#: What UTF-8 read as Windows-1252 shows, and the sign it was.
MISREAD = {
    "â€™": "’", "â€˜": "‘", "â€œ": "“", "â€\u009d": "”", "â€“": "–", "â€”": "—", "â€¦": "…", "Ã©": "é", "Ã¨": "è", "Ã¼": "ü", "Ã¶": "ö", "Ã¤": "ä", "Â ": " ", "ï¿½": " ",
}


def tidy_text(text: str) -> str:
    """Misread signs as they were, without soft hyphens and controls, white space single; for showing usages."""
    for bad, good in MISREAD.items():
        if bad in text:
            text = text.replace(bad, good)
    return " ".join(text.replace("\u00ad", "").translate(_CHARACTERS).split())


def tidy_usage(text: str, start: int, end: int) -> tuple[str, int, int]:
    """A usage tidied on both sides of its target word, and where the target stands then."""
    left, target, right = (tidy_text(x) for x in (text[:start], text[start:end], text[end:]))
    left += " " * bool(left and text[start - 1 : start].isspace())
    right = " " * bool(right and text[end : end + 1].isspace()) + right
    return left + target + right, len(left), len(left) + len(target)
