"""Cutting of texts where a byte-pair tokenizer always cuts, and tables of what the pieces give.

A piece is a run that begins at a space which follows a character other than white space.  The
byte-level splitting pattern has no match that runs on from such a character into a space, so a
text's tokens are those of its pieces in turn.  A tokenizer whose file does not promise this gets
whole texts as single pieces: slower, and as exact.
"""

from __future__ import annotations

import json
import re
from array import array
from operator import attrgetter
from struct import pack

from tokenizers import Tokenizer

_BLANK_SPACE = re.compile(r"\s ")


def load(path: str) -> Tokenizer:
    tokenizer = Tokenizer.from_file(path)
    tokenizer.no_truncation()
    tokenizer.no_padding()
    return tokenizer


def _plain_added(spec: dict) -> bool:
    return not any(
        t["lstrip"] or t["rstrip"] or t["single_word"] or t["normalized"] or re.search(r"\s", t["content"])
        for t in spec.get("added_tokens") or []
    )


def cut_rule(path: str) -> str:
    """``led``: pieces carry their leading space.  ``dropped``: white space gives no tokens and
    parts what surrounds it.  ``whole``: texts may not be cut."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    before, norm = spec.get("pre_tokenizer") or {}, spec.get("normalizer")
    if not _plain_added(spec) or spec["model"]["type"] != "BPE" or spec["model"].get("dropout"):
        return "whole"
    if before.get("type") == "ByteLevel" and before.get("use_regex") and not before.get("add_prefix_space") and not norm:
        return "led"
    steps = before.get("pretokenizers") or []
    if before.get("type") == "Sequence" and steps and steps[0].get("type") == "Split":
        split = steps[0]
        kinds = {n["type"] for n in (norm or {}).get("normalizers", [])}
        pattern = split["pattern"].get("Regex", "")
        if split.get("invert") and split["behavior"] == "Removed" and " " not in pattern and r"[^\s" in pattern and kinds <= {"NFC", "Replace", "Lowercase"} and len(steps) == 2 and steps[1].get("type") == "ByteLevel" and not steps[1].get("add_prefix_space"):
            return "dropped"
    return "whole"


def one_merge_each(path: str) -> bool:
    """Whether each token of a file comes of one merge, of two tokens that come earlier."""
    with open(path, encoding="utf-8") as f:
        model = json.load(f)["model"]
    pairs = [tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"]]
    rank = {a + b: i for i, (a, b) in enumerate(pairs)}
    return len(rank) == len(pairs) and not model.get("ignore_merges") and all(rank.get(x, -1) < i and (x in rank or len(x) == 1) for i, (a, b) in enumerate(pairs) for x in (a, b))


def led_pieces(text: str) -> list[str]:
    """Pieces of a text, each with its leading white space; their concatenation is the text."""
    parts = text.split(" ")
    if not _BLANK_SPACE.search(text):
        if not parts[0] and len(parts) > 1:  # what stands before the text may be white space
            return [" " + p for p in parts[1:]]
        return [parts[0], *(" " + p for p in parts[1:])]
    out, now = [], parts[0]
    for p in parts[1:]:
        if now and not now[-1].isspace():
            out.append(now)
            now = " " + p
        else:
            now += " " + p
    out.append(now)
    return out


class Pieces(dict):
    """What a piece gives, computed once for each piece while it is held.

    Pieces of two generations are held, each of ``limit`` at most: those met since the last change
    of generation, and those met in the one before, which stay if they are met again.
    """

    def __init__(self, give, limit: int = 450_000):
        super().__init__()
        self.give, self.limit, self.before = give, limit, {}

    def __missing__(self, piece: str):
        found = self.before.get(piece)
        if found is None:
            found = self.give(piece)
        if len(self) >= self.limit:
            self.before = dict(self)
            self.clear()
        if len(piece) <= 256:
            self[piece] = found
        return found


#: Characters above which a piece is encoded by parts, characters of a part, and tokens on either
#: side of a seam that are encoded again together at first.
LONG, PART, WINDOW = 1 << 13, 1 << 12, 8
_DIGITS, _LETTERS = re.compile("[0-9]"), re.compile("[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u02af\u0391-\u03a1\u03b1-\u03c9\u0410-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]")


def _kind(c: str) -> str:
    """Class of a character, empty for those whose class is left to the tokenizer."""
    return "L" if _LETTERS.match(c) else "N" if _DIGITS.match(c) else "M" if c in "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~" else ""


#: A run of letters, with its leading space, and the ASCII punctuation after it.
_WORD_MARKS = re.compile(r"( ?)([^\W\d_]+)([!-&(-/:-@\[-`{-~]*)")


class Ids:
    """Token ids of a piece.

    A word with marks after it is two matches of the splitting patterns, which the tokenizer's own
    model encodes without the rest of its machinery; all else goes through the whole tokenizer.
    """

    def __init__(self, path: str):
        self.rule, self.tokenizer = cut_rule(path), load(path)
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        # letters and then marks never hold a string in which a letter follows a mark
        added = self.added = [t.content for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.parted = self.rule != "whole" and all(re.search(r"[!-&(-/:-@\[-`{-~][^\W\d_]", t) for t in added)
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in set(plain)]
        # the byte-level alphabet: printable bytes as they are, others above them in order
        self.alphabet = {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(others)}
        back = {c: b for b, c in self.alphabet.items()}
        vocab = self.tokenizer.get_vocab(with_added_tokens=False)
        self.sizes = {i: bytes(map(back.__getitem__, t)) for t, i in vocab.items() if all(c in back for c in t)}  # bytes of each id
        # merges in the order of the ids that they make, one for each
        self.ranked = self.rule == "led" and one_merge_each(path)
        # a word comes with many marks after it, and marks are few
        self.matches = Pieces(self.of_match, 200_000)

    def __call__(self, piece: str) -> list[int]:
        if not piece:
            return []
        if self.parted:
            if (found := self.word(piece)) is not None:
                return found
            # a line break between two words is a match of its own, or dropped
            first, line, rest = piece.partition("\n")
            if line and rest and rest[0] != " " and (one := self.word(first)) is not None and (two := self.word(rest)) is not None:
                return one + (self.matched("\n") if self.rule == "led" else []) + two
        if len(piece) > LONG and self.rule == "led" and self.ranked and not any(t in piece for t in self.added):
            return self.by_parts(piece)
        return self.tokenizer.encode(piece, add_special_tokens=False).ids

    def seams(self, piece: str) -> list[int]:
        """Offsets that part a long piece: between two characters of known classes, with none beside
        them that the splitting pattern sees together with what follows."""
        out, at = [0], PART
        while at < len(piece) - 2:
            if all(map(_kind, piece[at - 2 : at + 2])):
                out.append(at)
                at += PART
            else:
                at += 1
        return [*out, len(piece)]

    def by_parts(self, piece: str) -> list[int]:
        """Ids of a long piece.

        Parts are encoded alone.  At each seam the last tokens before it and the first after it are
        encoded again together, more of them until the outermost come out as they were.  Tokens in a
        row are an encoding if every two neighbours are (Berglund and van der Merwe, 2023), and by
        then each two neighbours stand in one of the encodings.
        """
        cuts = self.seams(piece)
        out: list[int] = []
        sizes, encode = self.sizes, lambda s: self.tokenizer.encode(s, add_special_tokens=False).ids
        for a, b in zip(cuts, cuts[1:]):
            part = piece[a:b]
            ids = encode(part)
            width = WINDOW
            while out:
                # whole characters before and after the seam, and the tokens that make them up
                left, right = self.edge(out, width, False), self.edge(ids, width, True)
                raw = b"".join(sizes[i] for i in (*out[len(out) - left :], *ids[:right]))
                again = encode(raw.decode())
                whole_left, whole_right = left == len(out), right == len(ids)
                if (whole_left or again[0] == out[len(out) - left]) and (whole_right or again[-1] == ids[right - 1]):
                    out[len(out) - left :] = again
                    ids = ids[right:]
                    break
                width *= 2
            out += ids
        return out

    def edge(self, ids: list[int], width: int, first: bool) -> int:
        """How many of the first, or last, tokens to take: at least ``width``, up to where a
        character begins."""
        n = min(width, len(ids))
        while n < len(ids):
            # the byte where what is taken meets the rest begins a character
            byte = self.sizes[ids[n]][0] if first else self.sizes[ids[len(ids) - n]][0]
            if byte & 0xC0 != 0x80:
                break
            n += 1
        return n

    def word(self, piece: str) -> list[int] | None:
        """Ids of a word with marks after it; None for all else."""
        found = _WORD_MARKS.fullmatch(piece)
        if not found:
            return None
        lead, word, marks = found.groups()
        if self.rule == "dropped":
            word = word.lower() if word.isascii() else self.normalizer.normalize_str(word)
            lead = ""
        if not word.isalpha():
            return None
        return self.matched(lead + word) + self.matched(marks) if marks else self.matched(lead + word)

    def matched(self, match: str) -> list[int]:
        return self.matches[match]

    def of_match(self, match: str) -> list[int]:
        return [t.id for t in self.model.tokenize(self.in_alphabet(match))]

    def in_alphabet(self, match: str) -> str:
        if match.isascii() and match.isprintable():
            return match.replace(" ", self.alphabet[32])
        return match.encode().decode("latin-1").translate(self.alphabet)


_ID = attrgetter("id")


def _packed(ids: list[int]) -> bytes:
    return pack(f"<{len(ids)}I", *ids)


#: The normalizer and splitting pattern of files whose matches ``_MATCH`` finds in lower-cased texts of
#: the characters of ``_KNOWN``: those that no composition, and no neighbour, changes.
_STEPS = [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]
_SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
_KNOWN = re.compile("[\t-\r -~\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f\u0410-\u044f\u3041-\u3096\u30a1-\u30fa\u4e00-\u9fa5\uac00-\ud7a3]*")
_MATCH = re.compile(r"[^\W\d_]+|'(?:s|t|re|ve|m|ll|d)|[!-/:-@\[-`{-~]+|[0-9]")


def known_matches(path: str) -> bool:
    """Whether a file of the rule ``dropped`` splits texts as ``_MATCH`` does."""
    with open(path, encoding="utf-8") as f:
        spec = json.load(f)
    return (spec.get("normalizer") or {}).get("normalizers") == _STEPS and spec["pre_tokenizer"]["pretokenizers"][0]["pattern"].get("Regex") == _SPLIT


class Matches(Pieces):
    """Packed ids of a match; most are met first here, so little else is done for one."""

    def __init__(self, ids: Ids):
        super().__init__(None)
        self.tokenize, self.in_alphabet = ids.model.tokenize, ids.in_alphabet

    def __missing__(self, match: str) -> bytes:
        found = self.before.get(match)
        if found is None:
            found = array("I", map(_ID, self.tokenize(match if match.isalpha() and match.isascii() else self.in_alphabet(match)))).tobytes()
        if len(self) >= self.limit:
            self.before = dict(self)
            self.clear()
        if len(match) <= 256:
            self[match] = found
        return found


class Encoder:
    """Token ids of texts as little-endian unsigned 32-bit integers, by pieces, or by matches of the
    splitting pattern where these can be told without the tokenizer."""

    def __init__(self, path: str):
        ids = Ids(path)
        self.rule = ids.rule
        self.matches = Matches(ids) if self.rule == "dropped" and known_matches(path) else None
        self.added = ids.added
        self.raw = Pieces(lambda s: _packed(ids(s)))
        lead = " " if self.rule == "led" else ""
        self.bare = Pieces(lambda s: _packed(ids(lead + s)))

    def __call__(self, text: str) -> bytes:
        if self.rule == "whole":
            return self.raw.give(text)
        if self.matches is not None and _KNOWN.fullmatch(text) and not any(t in text for t in self.added):
            return b"".join(map(self.matches.__getitem__, _MATCH.findall(text.lower())))
        if self.rule == "led" and _BLANK_SPACE.search(text):
            return b"".join(map(self.raw.__getitem__, led_pieces(text)))
        first, *rest = text.split(" ")
        return self.raw[first] + b"".join(map(self.bare.__getitem__, rest))


_KEPT: dict = {}


def kept(kind, path: str):
    """One table for each Python worker and tokenizer file: later tasks of the worker reuse it."""
    if (kind, path) not in _KEPT:
        _KEPT[kind, path] = kind(path)
    return _KEPT[kind, path]
