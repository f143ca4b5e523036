"""Small frames with the cases every operator must stand, and brute-force helpers."""

import re
import zlib

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, kept string, size string, rank string"
PASSAGE = "this passage of more than fifty bytes stands in several documents, word for word"
LONG = " ".join(f"word{i}" for i in range(9000))


def documents():
    """Nulls in any column, empty and very long texts, ties, repeated rows, clashing column names."""
    base = [
        (5, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon", "b"),
        (1, "alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau upsilon", "a"),
        (2, "Alpha beta gamma delta epsilon zeta eta theta iota kappa lambda mu nu xi omicron pi rho sigma tau Upsilon", "a"),
        (3, "", "a"),
        (4, None, "b"),
        (6, "   \n\t ", None),
        (7, "one two", "c"),
        (8, "one two", "c"),
        (9, f"ünïcode straße {PASSAGE} and öther thïngs — ends", "c"),
        (10, f"before {PASSAGE} after it all", "é"),
        (11, LONG, "a"),
        (12, LONG + " " + PASSAGE, "b"),
        (13, "line again\nline again\nline again\nother line here", "b"),
        (14, "go go go go go go go go go go go go", None),
        (15, "# * $ % & | < > symbols ### and twelve more words to pass the limit of ten", "c"),
        (15, "# * $ % & | < > symbols ### and twelve more words to pass the limit of ten", "c"),
        (None, PASSAGE, "a"),
    ]
    return [(i, t, None if k % 5 == 0 else "en", s, None if t is None else len(t), "x", "y", "z") for k, (i, t, s) in enumerate(base)]


def shingles(text, n=5):
    words = WORD.findall("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))
    if not words:
        return frozenset()
    return frozenset(tuple(words[i : i + n]) for i in range(len(words) - n + 1)) if len(words) >= n else frozenset([tuple(words)])


def crc(ids):
    return zlib.crc32(b"".join(int(i).to_bytes(4, "little") for i in ids))


class Union:
    def __init__(self):
        self.up = {}

    def root(self, i):
        self.up.setdefault(i, i)
        while self.up[i] != i:
            i = self.up[i]
        return i

    def join(self, a, b):
        a, b = self.root(a), self.root(b)
        self.up[max(a, b)] = min(a, b)
