"""JSON out of model answers: tolerant extraction, strict checks, routing of what fails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from marginalia.functions.text import trim_ws


def extract_json(text: Column) -> Column:
    """The JSON of an answer as text, or null: a fenced part, else all, else from the first brace to
    the last.  The literal null counts as none."""
    fence = F.nullif(F.regexp_extract(text, r"```(?:json)?\s*([\s\S]*?)```", 1), F.lit(""))
    o1, o2 = F.instr(text, "{"), F.char_length(text) - F.instr(F.reverse(text), "}") + 1
    braces = F.when((o1 > 0) & F.contains(text, F.lit("}")) & (o2 > o1), F.substring(text, o1, o2 - o1 + 1))
    # each candidate is named once: an expression named several times is computed as often
    parts = F.transform(F.array(fence, text, braces), trim_ws)
    return F.try_element_at(F.filter(parts, lambda t: F.try_parse_json(t).isNotNull() & (t != "null")), F.lit(1))


def checked(df: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """``df`` with ok and issues: the names of the rules that a row breaks; null breaks a rule."""
    return df.withColumn("issues", _broken(rules)).withColumn("ok", F.size("issues") == 0)


def _broken(rules: dict[str, Column]) -> Column:
    return F.array_compact(F.array(*(F.when(~F.coalesce(rule, F.lit(False)), F.lit(name)) for name, rule in rules.items())))


def checked_value(df: DataFrame, value: str, rules) -> DataFrame:
    """``checked`` by rules that are a function of one column, which is computed once."""
    issues = F.element_at(F.transform(F.array(value), lambda v: _broken(rules(v))), 1)
    return df.withColumn("issues", issues).withColumn("ok", F.size("issues") == 0)


def quarantined(df: DataFrame, rules: dict[str, Column]) -> tuple[DataFrame, DataFrame]:
    """Rows that keep all rules, and rows with the issues that keep them out."""
    found = checked(df, rules)
    return found.filter("ok").drop("ok", "issues"), found.filter("not ok").drop("ok")


SPANS = "struct<spans:array<struct<blockId:string,start:int,end:int>>>"


def span_rules(parsed: Column, most: int = 200) -> dict[str, Column]:
    """Bounds of a list of spans."""
    spans = parsed["spans"]
    return {
        "spans": spans.isNotNull() & F.size(spans).between(1, most),
        "block": F.forall(spans, lambda s: F.char_length(s["blockId"]) > 0),
        "offsets": F.forall(spans, lambda s: (s["start"] >= 0) & (s["end"] >= 0)),
    }


TERMS = "struct<terms:array<struct<term:string,definition:string,blockIds:array<string>>>>"


def term_rules(parsed: Column, most: int = 200) -> dict[str, Column]:
    """Bounds of a list of terms."""
    terms = parsed["terms"]
    return {"terms": terms.isNotNull() & (F.size(terms) <= most), "term": F.forall(terms, lambda t: F.char_length(t["term"]) > 0), "ids": F.forall(terms, lambda t: t["blockIds"].isNotNull())}


def merge_key(old: Column, key: Column, value: Column) -> Column:
    """A map with one entry set anew."""
    return F.map_concat(F.map_filter(F.coalesce(old, F.create_map().cast("map<string,string>")), lambda k, _: k != key), F.create_map(key, value))


def resolve_span(text: Column, start: Column, end: Column, context: int = 32) -> Column:
    """A span clamped to its text with quote and context, or null if it is blank there."""
    n = F.char_length(text)
    s = F.greatest(F.lit(0), F.least(start, n))
    e = F.greatest(s, F.least(end, n))
    quoted = F.substring(text, s + 1, e - s)
    before = F.greatest(s - context, F.lit(0))
    found = F.struct(s.alias("start"), e.alias("end"), quoted.alias("quoted"), F.substring(text, before + 1, s - before).alias("prefix"), F.substring(text, e + 1, F.lit(context)).alias("suffix"))
    return F.when(trim_ws(quoted) != "", found)


def build_anchor(text: Column, quote: Column, context: int = 32) -> Column:
    """The anchor of the first exact occurrence of a quote, or null."""
    at = F.instr(text, quote) - 1
    return F.when((at >= 0) & (quote != ""), resolve_span(text, at, at + F.char_length(quote), context))


REFERENCES = "array<struct<id:string,label:string,text:string,url:string>>"


def stored_references(raw: Column) -> Column:
    """References of stored JSON: those that have id, label and text; none of what is no JSON."""
    read = F.from_json(raw, REFERENCES)
    good = F.filter(read, lambda r: r["id"].isNotNull() & r["label"].isNotNull() & r["text"].isNotNull())
    return F.coalesce(good, F.array().cast(REFERENCES))
