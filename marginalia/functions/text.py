"""Text functions as built-in Spark expressions, and one over Arrow batches.

Offsets count code points.  White space is one explicit class, as Java's, SQL's and scripts' own
classes differ on the no-break space and the byte order mark.
"""

from __future__ import annotations

import re

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.udf import arrow

#: White space by code point: what scripts on the web count as such.
WS = "[\\t\\n\\u000b\\f\\r \\u00a0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000\\ufeff]"
_SPACES = "\t\n\x0b\f\r \u00a0\u1680\u2028\u2029\u202f\u205f\u3000\ufeff" + "".join(map(chr, range(0x2000, 0x200B)))


def slice_(text: Column, start: Column, end: Column) -> Column:
    """Half-open slice by offsets."""
    return F.substring(text, start + 1, F.greatest(end - start, F.lit(0)))


def trim_ws(text: Column) -> Column:
    return F.regexp_replace(text, f"^{WS}+|{WS}+$", "")


#: White space other than the space itself.
_OTHER = WS.replace("\\r ", "\\r")


def normalize(text: Column) -> Column:
    """Runs of white space as one space, none at the ends; a single space is not touched."""
    return F.trim(F.regexp_replace(text, f" {WS}+|{_OTHER}{WS}*", " "))


def is_blank(text: Column) -> Column:
    return text.isNull() | (trim_ws(text) == "")


def clip(text: Column, n: int = 160, squeeze: bool = True) -> Column:
    """At most n characters, with an ellipsis if cut; squeezed first unless told otherwise."""
    t = normalize(text) if squeeze else text
    return F.when(F.char_length(t) > n, F.concat(F.left(t, F.lit(n)), F.lit("…"))).otherwise(t)


def occurrences(text: Column, quote: Column) -> Column:
    """Offsets of all occurrences, overlapping ones too: the text is split before each."""
    pieces = F.split(text, F.concat(F.lit("(?=\\Q"), quote, F.lit("\\E)")), -1)
    starts = F.aggregate(pieces, F.struct(F.lit(0).alias("at"), F.array().cast("array<int>").alias("all")), lambda a, p: F.struct((a["at"] + F.char_length(p)).alias("at"), F.concat(a["all"], F.array(a["at"])).alias("all")), lambda a: a["all"])
    found = F.filter(starts, lambda i: (i > 0) | F.startswith(text, quote))
    return F.when(quote == "", F.array().cast("array<int>")).otherwise(F.filter(found, lambda i: i < F.char_length(text)))


# Fixed value: where a sentence ends.
_END = re.compile(f"[.!?]+[\"'”’)\\]]*{WS}+(?=[A-Z0-9\"'“‘(\\[])")
_BLANK = re.compile(f"{WS}*")


def sentences(text: str) -> list[dict]:
    """Sentences of a text with their offsets (see ``sentence_spans``)."""
    out, begin = [], 0
    for end in [*(m.end() for m in _END.finditer(text)), len(text)]:
        s = _BLANK.match(text, begin, end).end()
        t = text[s:end].rstrip(_SPACES)
        if t:
            out.append({"text": t, "start": s, "end": s + len(t)})
        begin = end
    return out


@arrow("array<struct<text:string,start:int,end:int>>")
def sentence_spans(text: pd.Series) -> pd.Series:
    """Sentences as array<struct<text,start,end>>; null for null.

    A sentence ends at . ! or ?, closing quotes or brackets, and white space before what can begin
    another; pieces are trimmed and their offsets follow.  One pass of a compiled pattern for each
    text: a fold over pieces in SQL copies the list for each of them.
    """
    return pd.Series([None if t is None else sentences(t) for t in text], dtype=object)


_REFS = r"\[\[(\d+(?:\s*,\s*\d+)*)\]\]"


def simplified(raw: Column) -> Column:
    """Plain sentences with the numbers they cite: array<struct<text,refs>>; null without markers.

    A tail without markers takes the last sentence's numbers; numbers must be above 0.
    """
    texts = F.regexp_extract_all(raw, F.lit(r"(?s)(.*?)" + _REFS), F.lit(1))
    refs = F.regexp_extract_all(raw, F.lit(r"(?s)(.*?)" + _REFS), F.lit(2))
    numbers = lambda s: F.filter(F.transform(F.split(s, r"\s*,\s*"), lambda x: F.try_to_number(F.trim(x), F.lit("9999999999")).cast("int")), lambda n: n > 0)
    pairs = F.filter(F.zip_with(texts, refs, lambda t, r: F.struct(t.alias("text"), numbers(r).alias("refs"))), lambda p: ~is_blank(p["text"]) & (F.size(p["refs"]) > 0))
    tail = F.regexp_extract(raw, r"(?s)^(?:.*" + _REFS + r")?(.*)$", 2)
    last = F.try_element_at(pairs, F.lit(-1))["refs"]
    whole = F.when(~is_blank(tail) & (F.size(pairs) > 0), F.concat(pairs, F.array(F.struct(tail.alias("text"), last.alias("refs"))))).otherwise(pairs)
    return F.when(raw.rlike(_REFS) & (F.size(whole) > 0), whole)


def strip_simplify_markers(raw: Column) -> Column:
    return F.regexp_replace(raw, r"\s*" + _REFS, "")


def escape_html(text: Column, quotes: bool = False) -> Column:
    for a, b in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), *((('"', "&quot;"),) if quotes else ())):
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def table_html(rows: Column) -> Column:
    """array<array<string>> as a table."""
    cells = lambda r: F.array_join(F.transform(r, lambda c: F.concat(F.lit("<td>"), escape_html(c), F.lit("</td>"))), "")
    return F.concat(F.lit("<table><tbody>"), F.array_join(F.transform(rows, lambda r: F.concat(F.lit("<tr>"), cells(r), F.lit("</tr>"))), ""), F.lit("</tbody></table>"))


def strip_list_markers(text: Column) -> Column:
    return F.regexp_replace(text, r"(?m)^(\s*)(?:[-*•]|\d{1,3}[.)])\s+", "$1")


def indent_line(text: Column, at: Column, out: bool = False) -> Column:
    """The line that holds offset ``at`` moved by two spaces."""
    head = F.substring_index(F.left(text, at), "\n", -1)
    start = at - F.char_length(head)
    before, rest = F.left(text, start), F.substring(text, start + 1, F.char_length(text))
    return F.concat(before, F.regexp_replace(rest, "^ {1,2}", "") if out else F.concat(F.lit("  "), rest))


#: Private-use characters that mark citations in text under way.
CITE_OPEN, CITE_MID, CITE_CLOSE = chr(0xE000), chr(0xE001), chr(0xE002)


def strip_citation_tokens(text: Column) -> Column:
    return F.regexp_replace(text, f"{CITE_OPEN}r\\d+{CITE_MID}|[{CITE_OPEN}-{CITE_CLOSE}]", "")


def heading_html(old: Column, text: Column) -> Column:
    """The heading's html around a new text; other html as it was."""
    level = F.regexp_extract(old, "^<h([1-3])", 1)
    clean = F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))
    return F.when(level != "", F.concat(F.lit("<h"), level, F.lit(">"), clean, F.lit("</h"), level, F.lit(">"))).otherwise(old)


_ENTRY = r"^\[?(\d{1,4})[\]).:]?\s+"


def entry_marker(text: Column) -> Column:
    """The number that leads a reference entry, or null."""
    return F.nullif(F.regexp_extract(text, _ENTRY, 1), F.lit(""))


def without_entry_marker(text: Column) -> Column:
    return F.regexp_replace(text, _ENTRY, "")


def linkify_block_tags(text: Column) -> Column:
    return F.regexp_replace(text, r"\[block ([A-Za-z0-9_:-]+)\]", "[¶](#block-$1)")


def block_tags(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\[block ([A-Za-z0-9_:-]+)\]"), F.lit(1))


def parse_conversation(content: Column) -> Column:
    """A transcript as array<struct<role,text>>; what is none is one turn of the assistant."""
    parts = F.split(content, r"\n\n(?=\*\*(?:Reader|Assistant):\*\* )")
    turn = lambda p: F.struct(F.when(p.startswith("**Reader:** "), "user").otherwise("assistant").alias("role"), F.regexp_replace(p, r"^\*\*(?:Reader|Assistant):\*\* ", "").alias("text"))
    return F.transform(parts, turn)


def transcript(turns: Column) -> Column:
    """array<struct<role,text>> as a transcript."""
    name = lambda r: F.when(r == "user", "Reader").otherwise("Assistant")
    return F.array_join(F.transform(turns, lambda t: F.concat(F.lit("**"), name(t["role"]), F.lit(":** "), t["text"])), "\n\n")


def file_title(name: Column) -> Column:
    return F.regexp_replace(name, r"(?i)\.pdf$", "")


def error_message(text: Column) -> Column:
    return F.when(F.char_length(text) > 400, F.concat(F.left(text, F.lit(400)), F.lit("…"))).otherwise(text)


def split_trailer(text: Column, name: str) -> Column:
    """A streamed text and what follows its in-band trailer: struct<text,value>, value null without
    one."""
    mark = f"\0{name}\0"
    at = F.locate(mark, text)
    return F.struct(F.when(at > 0, F.left(text, at - 1)).otherwise(text).alias("text"), F.when(at > 0, F.substring(text, at + len(mark), F.char_length(text))).alias("value"))


def first_occurrence(text: Column, term: Column) -> Column:
    """Offset of a term whatever its case, or -1."""
    return F.locate(F.lower(term), F.lower(text)) - 1 if isinstance(term, str) else F.instr(F.lower(text), F.lower(term)) - 1


def profile_lines(p: Column) -> Column:
    """The reader's context in lines, or a sentence that says there is none."""
    line = lambda label, f: F.when(~is_blank(p[f]), F.concat(F.lit(label), p[f]))
    lines = F.array_compact(F.array(line("Background: ", "background"), line("Purpose: ", "purpose"), line("Application: ", "application")))
    return F.when(p.isNull() | (F.size(lines) == 0), F.lit("The reader gave no context.")).otherwise(F.array_join(lines, "\n"))


@arrow("array<string>")
def decimals(numbers: pd.Series, places: pd.Series) -> pd.Series:
    """Numbers of an array as text, rounded by their exact binary value, of two as near to the even
    one; Java's own format rounds the shortest decimal, and that half up."""
    show = lambda x, n: None if x is None else f"{x:.{n}f}"
    return pd.Series([None if v is None else [show(x, n) for x in v.tolist()] for v, n in zip(numbers, places)], dtype=object)


def vector_literal(v: Column) -> Column:
    """A vector as text with six decimals; what is not finite is 0."""
    safe = lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) == float("inf")), F.lit(0.0)).otherwise(x.cast("double"))
    return F.concat(F.lit("["), F.array_join(decimals(F.transform(v, safe), F.lit(6)), ","), F.lit("]"))


def plural(n: Column, one: str, many: str | None = None) -> Column:
    return F.concat_ws(" ", n.cast("string"), F.when(n == 1, one).otherwise(many or one + "s"))


def megabytes(n: Column) -> Column:
    return F.concat(F.format_string("%.1f", n / F.lit(1024.0 * 1024.0)), F.lit(" MB"))


def slug(title: Column) -> Column:
    """Runs of what is not a word character as -, none at the ends, lower case, never empty."""
    s = F.lower(F.regexp_replace(F.regexp_replace(title, "[^A-Za-z0-9_]+", "-"), "^-+|-+$", ""))
    return F.coalesce(F.nullif(s, F.lit("")), F.lit("corpus"))


def reference_host(url: Column) -> Column:
    return F.coalesce(F.regexp_replace(F.try_parse_url(url, F.lit("HOST")), r"^www\.", ""), url)


def weblink_href(token: Column) -> Column:
    return F.when(token.rlike("(?i)^https?://"), token).otherwise(F.concat(F.lit("https://"), token))
