"""Prompts of derivations as columns: who reads, what is selected, what stands around it, what is
wanted and in which form.  The wording is our own.

A row has profile (struct of background, purpose, application), title, selected, before and after,
and what its kind asks for: sections, target_section, depth, figure.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from marginalia.functions.text import profile_lines, sentence_spans

# Output tokens of each kind of derivation, and depths of summaries.
MAX_TOKENS = {"EXPLAIN": 1024, "SIMPLIFY": 1024, "SALIENCE": 4096, "EXTRACT": 2048, "SUMMARIZE": 2048, "SYNTHESIS": 8192}
DEPTHS = ("insights", "layman", "professional")

RULES = {
    "EXPLAIN": (
        "Explain the selected passage to this reader.",
        "1. Begin with one sentence on what the passage claims or does.",
        "2. Then explain what this reader is least likely to know.",
        "3. Tie it to the reader's purpose where there is a real tie.",
        "Cite other parts of the document by their tags, as [block <id>]. At most 200 words of markdown.",
    ),
    "FIGURE": (
        "Explain the selected figure to this reader.",
        "1. Begin with one sentence on what kind of figure it is and what it shows.",
        "2. Read out axes, series, numbers and trends that can be seen, and none that cannot.",
        "3. Say what the document concludes from it.",
        "At most 200 words of markdown.",
    ),
    "SIMPLIFY": (
        "Rewrite the sentences above in everyday words, for a reader without training in the field.",
        "1. Keep every claim and every number; add none.",
        "2. Define a technical term where it first stands, or do without it.",
        "3. End each sentence with the numbers of those it restates, as [[1]] or [[2,3]].",
        "Return the rewritten text alone.",
    ),
    "SALIENCE": (
        "Mark the spans that matter most to this reader: claims that others rest on, results, definitions.",
        "1. 10 to 40 spans, fewer for a short document; each within one block, a clause or a sentence.",
        "2. start and end are offsets into the block's text as given above.",
        'Return JSON alone: {"spans": [{"blockId": "<id>", "start": 0, "end": 42}]}',
    ),
    "EXTRACT": (
        "Write a note on what the passage contributes to this reader's purpose.",
        "1. It has to be understood months later, without the document: 1 to 4 sentences, with the numbers.",
        "2. quotedSpans are 1 to 3 short spans that ground it, as offsets into blocks.",
        'Return JSON alone: {"sectionId": "<id>", "content": "<markdown>", "quotedSpans": [{"blockId": "<id>", "start": 0, "end": 42}]}',
    ),
    "insights": (
        "List what only somebody of the field would take from this document.",
        "1. All of it comes from the document; nothing that general news would tell.",
        "2. If there is no such thing, say so in a sentence: that is a good answer.",
        "A markdown list, each item a finding in bold and why it matters. At most 400 words.",
    ),
    "layman": (
        "Summarise the document for a reader without training in the field.",
        "1. What was found and why it matters, then how, in plain steps.",
        "2. Everyday words; a short comparison may help.",
        "At most 250 words.",
    ),
    "professional": (
        "Summarise the document for a practitioner, in its own terms.",
        "1. Question, method, findings, limits, and how they stand to earlier work.",
        "At most 600 words.",
    ),
    "ASK": ("Answer from the material above, citing notes and blocks by their tags. Say so where it does not answer.",),
    "contradictions": ("Find notes that cannot both hold, and name their ids.",),
    "gaps": ("Find thin sections, claims without support and questions that stay open, with the ids of notes that bear on them.",),
    "unsourced": ("Find accepted notes with claims of fact but without sources, and name their ids.",),
}
ISSUES = ("1. Report real issues alone; an empty list is a good answer.", "2. issue is one sentence, explanation one to three.", 'Return JSON alone: {"issues": [{"noteIds": ["<id>"], "issue": "<sentence>", "explanation": "<sentences>"}]}')


def _text(*parts) -> Column:
    """Parts that are not null, one blank line between them."""
    return F.concat_ws("\n\n", *(F.lit(p) if isinstance(p, str) else p for p in parts))


def _rules(kind: str) -> str:
    return "\n".join(RULES[kind])


def _passage(before: Column, selected: Column, after: Column) -> Column:
    shown = lambda c, none: F.coalesce(F.nullif(c, F.lit("")), F.lit(none))
    return _text(F.concat(F.lit("Before it:\n"), shown(before, "(start of document)")), F.concat(F.lit("The selected passage:\n"), selected), F.concat(F.lit("After it:\n"), shown(after, "(end of document)")))


def _on(title: Column, what: str) -> Column:
    return F.concat(F.lit(f'The reader has {what} "'), title, F.lit('". The whole document is above.'))


def explain() -> Column:
    """Of a passage, or where the row's figure (kind, caption, svg_source) is not null, of a figure."""
    return _text(profile_lines(F.col("profile")), _on(F.col("title"), "selected a passage of"), _passage(F.col("before"), F.col("selected"), F.col("after")), _rules("EXPLAIN"))


def explain_figure() -> Column:
    f = F.col("figure")
    seen = F.when(f["kind"] == "image", "The image is attached.").when(f["kind"] == "svg", F.concat(F.lit("The figure is this SVG:\n"), f["svg_source"])).when(f["kind"] == "video", "It is a video that cannot be watched: go by caption and document.")
    caption = F.concat(F.lit("Caption:\n"), F.coalesce(F.nullif(f["caption"], F.lit("")), F.lit("(no caption)")))
    return _text(profile_lines(F.col("profile")), _on(F.col("title"), "selected a figure of"), caption, seen, _rules("FIGURE"))


def simplify() -> Column:
    """The selected passage in numbered sentences."""
    numbered = F.array_join(F.transform(sentence_spans(F.col("selected")), lambda s, i: F.concat(F.lit("["), (i + 1).cast("string"), F.lit("] "), s["text"])), "\n")
    return _text(profile_lines(F.col("profile")), _on(F.col("title"), "selected a passage of"), F.concat(F.lit("Its sentences:\n"), numbered), _rules("SIMPLIFY"))


def salience() -> Column:
    return _text(profile_lines(F.col("profile")), _on(F.col("title"), "opened"), _rules("SALIENCE"))


def extract() -> Column:
    """With sections (array of id and label), and target_section where the reader has chosen one."""
    listed = F.array_join(F.transform("sections", lambda s: F.concat(F.lit("- "), s["id"], F.lit(": "), s["label"])), "\n")
    sections = F.concat(F.lit("Sections:\n"), F.coalesce(F.nullif(listed, F.lit("")), F.lit("(none yet)")))
    place = F.when(F.col("target_section").isNull(), "Choose the sectionId that fits best.").otherwise(F.concat(F.lit('Use sectionId "'), F.col("target_section"), F.lit('".')))
    return _text(profile_lines(F.col("profile")), _on(F.col("title"), "selected a passage of"), _passage(F.col("before"), F.col("selected"), F.col("after")), sections, place, _rules("EXTRACT"))


def summarize() -> Column:
    """By depth, the layman's if it is unknown."""
    rules = F.lit(_rules("layman"))
    for depth in DEPTHS:
        rules = F.when(F.col("depth") == depth, _rules(depth)).otherwise(rules)
    return _text(profile_lines(F.col("profile")), _on(F.col("title"), "asked about"), rules)


def ask() -> Column:
    """A free question (scope, question)."""
    return _text(profile_lines(F.col("profile")), F.concat(F.lit("Scope: "), F.col("scope")), F.concat(F.lit("Question: "), F.col("question")), _rules("ASK"))


def issues(task: str) -> Column:
    """A task over notes: contradictions, gaps or unsourced."""
    return _text(profile_lines(F.col("profile")), _rules(task), "\n".join(ISSUES))


PROMPTS = {"EXPLAIN": explain, "SIMPLIFY": simplify, "SALIENCE": salience, "EXTRACT": extract, "SUMMARIZE": summarize, "SYNTHESIS": ask}


def derivation(kind: str) -> tuple[Column, int]:
    """The prompt of a kind of derivation, and how many tokens its answer may have."""
    prompt = PROMPTS[kind]()
    if kind == "EXPLAIN":
        prompt = F.when(F.col("figure").isNotNull(), explain_figure()).otherwise(prompt)
    return prompt, MAX_TOKENS[kind]
