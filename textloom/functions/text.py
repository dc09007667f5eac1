"""Column functions on texts; all run inside the JVM. Offsets are 0-based, half-open, in code points."""

from __future__ import annotations

import json
from functools import reduce

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

MARK = "\u0001"

#: Common function words of English and of three other languages.
ENGLISH = "the of and to in a is that for it as was with be by on not he his but at are this have from or had an they which you were her all she there would their we him been has when who will more no if out so".split()
FOREIGN = "der die und den von zu das mit sich des auf für ist im dem nicht ein eine als auch es an le la les et un une du dans que qui pour pas sur au plus par el los las una por con para del se lo como".split()

#: The words of the check whether a cell's text reads as English.
CHECK_ENGLISH = "the of and to in is that for are with as by this be on from which it an at or not have we these their was were has been can".split()
CHECK_OTHER = "le la les des du une est que qui dans pour sur pas au aux ce cette ces sont avec par nous el los las del por para una con como pero sus esta este entre der die das und ist nicht mit sich auf dem den zur os um uma dos das pelo pela nao sao".split()


def let(value: Column, use) -> Column:
    """``use(value)``, the value being worked out once however often ``use`` names it; within lambdas Spark shares no expression."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


#: Numbers that ``running`` goes through at a time, and characters of a chunk.
RUN, CHUNK = 64, 1024


def running(numbers: Column, merge) -> Column:
    """0 and the numbers merged so far, one more than there are numbers; in runs, since Spark copies what an aggregate gathers at each step."""
    zero = F.array(F.lit(0).cast("bigint"))
    gather = lambda values: F.aggregate(values, zero, lambda acc, x: F.concat(acc, F.array(merge(F.element_at(acc, -1), x))))

    def joined(runs):
        firsts = gather(F.transform(runs, lambda r: F.element_at(r, -1)))
        return let(firsts, lambda f: F.concat(F.flatten(F.transform(runs, lambda r, k: F.transform(F.slice(r, F.lit(1), F.size(r) - 1), lambda x: merge(x, F.get(f, k))))), F.array(F.element_at(f, -1))))

    def cut_up(values):
        last = F.floor((F.size(values) - 1) / RUN).cast("int")
        runs = F.transform(F.sequence(F.lit(0), F.greatest(last, F.lit(0))), lambda k: gather(F.slice(values, k * RUN + 1, F.lit(RUN))))
        return let(runs, joined)

    return let(numbers, cut_up)


def chunks(text: Column) -> Column:
    """The text in chunks, of which ``cut`` takes ranges; ``substring`` counts the characters of a text from its start each time."""
    return F.regexp_extract_all(text, F.lit(f"(?s).{{1,{CHUNK}}}"), F.lit(0))


def cut(parts: Column, start: Column, length: Column) -> Column:
    """``length`` characters of the chunked text from ``start`` on."""
    first, last = F.floor(start / CHUNK).cast("int"), F.floor((start + length) / CHUNK).cast("int")
    return F.substring(F.array_join(F.slice(parts, first + 1, F.greatest(last - first + 1, F.lit(0))), ""), (start % CHUNK + 1).cast("int"), length.cast("int"))


def words(text: Column) -> Column:
    """What stands between white space, without empty strings."""
    return F.filter(F.split(text, r"(?U)\s+"), lambda w: w != "")


def sentences(text: Column) -> Column:
    """Parts that end with ``.``, ``!`` or ``?`` before a blank or a line break, without those; none is empty."""
    return F.filter(F.split(F.regexp_replace(text, r"([.!?])[ \n]+", "$1" + MARK), MARK), lambda s: s != "")


def sentence_spans(text: Column) -> Column:
    """array<struct<start,end,sentence>>: the parts of ``sentences`` where they stand."""
    pieces = F.split(F.regexp_replace(text, r"([.!?])([ \n]+)", "$1$2" + MARK), MARK)
    span = lambda at, cut: F.struct(at.alias("start"), (at + F.length(cut)).alias("end"), cut.alias("sentence"))
    placed = lambda starts, found: F.transform(found, lambda p, i: let(F.regexp_replace(p, r"(?<=[.!?])[ \n]+$", ""), lambda cut: span(F.get(starts, i), cut)))
    spans = let(pieces, lambda found: let(running(F.transform(found, lambda p: F.length(p).cast("bigint")), lambda a, b: a + b), lambda starts: placed(starts, found)))
    return F.filter(spans, lambda s: s["sentence"] != "")


def masked(sentence: Column) -> Column:
    """Every run of digits as one ``0``."""
    return F.regexp_replace(sentence, "[0-9]+", "0")


def kept_text(text: Column, removals: Column) -> Column:
    """The text outside the ranges, which may overlap; the pieces are joined by one space and nothing is trimmed."""
    def pieces(parts, ranges, reached):
        before = F.transform(ranges, lambda r, i: F.when(r["start"] > F.get(reached, i), cut(parts, F.get(reached, i), r["start"] - F.get(reached, i))))
        last = F.element_at(reached, -1)
        rest = F.when(last < F.length(text), cut(parts, last, F.length(text) - last))
        return F.array_join(F.filter(F.concat(before, F.array(rest)), lambda p: p.isNotNull()), " ")

    ends = lambda ranges: running(F.transform(ranges, lambda r: r["end"].cast("bigint")), F.greatest)
    return let(chunks(text), lambda parts: let(F.array_sort(removals), lambda ranges: let(ends(ranges), lambda reached: F.when(text.isNotNull(), pieces(parts, ranges, reached)))))


def share_of(tokens: Column, vocabulary: list[str]) -> Column:
    """The share of tokens in a word list; 0 without tokens."""
    return F.coalesce(F.try_divide(F.size(F.filter(tokens, lambda w: w.isin(*vocabulary))), F.size(tokens)), F.lit(0.0))


def latin_words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z]+"), F.lit(0))


def foreign_letter_share(text: Column) -> Column:
    """The share of letters beyond U+024F; 0 without letters."""
    return F.coalesce(F.try_divide(F.regexp_count(text, F.lit(r"[\p{L}&&[^\x{0000}-\x{024F}]]")), F.regexp_count(text, F.lit(r"\p{L}"))), F.lit(0.0))


def collapse(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, "[ \t\r\n ]+", " "))


def plain_repair(text: Column) -> Column:
    """The part of ``repair_text`` that regular expressions express: hyphens, white space, spaces before and missing after punctuation."""
    steps = [
        (r"\\n", " "),
        ("­ ?", ""),
        ("[‐‑]", "-"),
        ("[ \t\r\n ​�]+", " "),
        (r"([\p{L}\p{N})\]]) +([,;])", "$1$2"),
        (r"([\p{L})\]]) +:", "$1:"),
        (r"([(\[]) +([\p{L}\p{N}])", "$1$2"),
        (r"([a-z0-9)\]])([.?!])([A-Z][a-z])", "$1$2 $3"),
        (r"([A-Za-z]{2}),([A-Za-z])", "$1, $2"),
        (r"([A-Za-z0-9)\]]);([A-Za-z])", "$1; $2"),
    ]
    return F.trim(reduce(lambda t, s: F.regexp_replace(t, *s), steps, text))


#: Footers and promotions appended to abstracts, and copyright lines.
APPENDED_FOOTER = r"(?i)this content downloaded from [\d.]+.*?utc(\s*all use subject to\s*\S+)?|click here[^.]*\."
COPYRIGHT = r"(?i)(©|\(c\)|copyright).{0,150}?all rights reserved\.?|(©|\(c\)|copyright)\s*\d{4}\b[^.]*\.?"


def strip_boilerplate(text: Column) -> Column:
    """Appended footers, then copyright lines, each as one space."""
    return F.regexp_replace(F.regexp_replace(text, APPENDED_FOOTER, " "), COPYRIGHT, " ")


def ends_mid_sentence(text: Column, removals: Column | None = None) -> Column:
    """True where the text, closing marks aside, ends without ``.``, ``!`` or ``?`` and no removal reaches its end."""
    ended = F.regexp_replace(text, r"[\s]+$", "")
    last = F.regexp_replace(ended, "[)\\]}\"'”’» ]+$", "")
    cut = (last != "") & ~F.substring(last, -1, 1).isin(".", "!", "?")
    if removals is None:
        return cut
    return cut & ~F.exists(removals, lambda r: r["end"] >= F.length(ended))


def inverted_index(tokens: Column) -> Column:
    """The JSON object {word: [positions]} of a text's words, as services ship abstracts; made within the row, so no word moves."""

    @F.pandas_udf("string")
    def index(texts: pd.Series) -> pd.Series:
        def one(found):
            places: dict = {}
            for at, word in enumerate(found):
                places.setdefault(word, []).append(at)
            return json.dumps(places, ensure_ascii=False)

        return texts.map(lambda found: None if found is None else one(found))

    return index(tokens)


def from_inverted_index(index_json: Column) -> Column:
    """The text of a JSON object {word: [positions]}: words in the order of their positions."""
    entries = F.map_entries(F.from_json(index_json, "map<string,array<int>>"))
    pairs = F.flatten(F.transform(entries, lambda e: F.transform(e["value"], lambda p: F.struct(p.alias("p"), e["key"].alias("w")))))
    return F.array_join(F.transform(F.array_sort(pairs), lambda x: x["w"]), " ")
