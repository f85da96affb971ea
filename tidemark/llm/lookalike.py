"""One form for texts that look alike.

A table from characters, line ends and clusters to their form is computed once
from the Unicode character data and a short list of look-alike letters, checked
for conflicts, and compiled into one longest-match pattern. A text is rewritten
in one pass; characters the table doesn't name are copied. The table has every
cluster of base and marks that makes a composed letter, in all its spellings and
with look-alike bases. There is no end of other clusters (marks in another order,
more of them, invisible characters between): they are composed when met by the
rule the table was made with and checked against (``_form``).

Not told apart: full and half width, invisible characters, kinds of space, ways
to encode an accented or joined letter, letters of other scripts of the same
shape. Told apart: accents, case, raised digits, words, punctuation, the number
of spaces, line breaks.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.scratch import cut

# A letter, and letters of other scripts with the same shape (Cyrillic, Greek, Armenian, Georgian, Coptic, Cherokee, Lisu, phonetic).
SAME_SHAPE = {
    "A": "АΑᎪꓮ", "B": "ВΒᏴꓐ", "C": "СϹⲤᏟꓚ", "D": "Ꭰꓓ", "E": "ЕΕᎬꓰ", "F": "Ϝꓝ", "G": "ԌᏀꓖ", "H": "НΗⲎᎻꓧ", "I": "ІΙӀⲒꓲ", "J": "ЈͿᎫꓙ", "K": "КΚⲔᏦꓗ",
    "L": "Ꮮꓡ", "M": "МΜⲘᎷꓟ", "N": "ΝⲚꓠ", "O": "ОΟՕⲞꓳ", "P": "РΡⲢᏢꓑ", "Q": "Ԛ", "R": "Ꭱꓣ", "S": "ЅՏᏚꓢ", "T": "ТΤⲦᎢꓔ", "U": "ꓴ", "V": "ѴᏙꓦ",
    "W": "ԜᎳꓪ", "X": "ХΧⲬꓫ", "Y": "УΥҮⲨꓬ", "Z": "ΖᏃꓜ",
    "a": "а", "c": "сϲⲥᴄ", "d": "ԁ", "e": "е", "g": "ɡ", "h": "һ", "i": "і", "j": "јϳ", "l": "ӏ", "o": "оοօⲟჿᴏ", "p": "рρⲣ", "q": "ԛ",
    "s": "ѕ", "v": "νѵᴠ", "w": "ԝᴡ", "x": "х", "y": "уүყ", "z": "ᴢ",
    "Г": "Γ", "П": "Π", "Ф": "Φ", "к": "κ", "μ": "µ", "-": "‐‑",
}
# Format characters that are seen, as signs around digits.
SEEN_FORMAT = "\u0600\u0601\u0602\u0603\u0604\u0605\u06dd\u070f\u08e2"
# Tags of decompositions that change only the width, or how letters join.
WIDTH_TAGS = ("<wide>", "<narrow>")
STYLE_TAG = "<font>"
JOIN_TAGS = ("<compat>", "<isolated>", "<initial>", "<medial>", "<final>")
# Fillers of the Korean script, letters that show nothing.
FILLERS = "\u115f\u1160\u3164\uffa0"
LINE_ENDS = ("\r\n", "\r", "\x85", "\u2028", "\u2029")

#: Tasks that the documents of a form are spread over when they meet their class, and documents of a piece of a spelling.
SALTS, PIECE = 16, 4096

_shape = {ord(o): c for c, others in SAME_SHAPE.items() for o in others}


def _is_invisible(c: str) -> bool:
    return unicodedata.category(c) == "Cf" and c not in SEEN_FORMAT or c == "\u034f" or c in FILLERS or "\ufe00" <= c <= "\ufe0f" or "\U000e0100" <= c <= "\U000e01ef"


def _simple(c: str) -> str:
    """``c`` without its width or joining: one step of its decomposition."""
    tag, _, rest = unicodedata.decomposition(c).partition(" ")
    parts = "".join(chr(int(x, 16)) for x in rest.split()) if tag.startswith("<") else ""
    if tag in WIDTH_TAGS or tag == "<compat>" and unicodedata.category(c) == "Nl":  # a numeral of letters
        return parts
    if tag == STYLE_TAG and all(unicodedata.category(x)[0] in "LN" for x in parts):
        return parts
    if tag in JOIN_TAGS and (len(parts) > 1 or tag != "<compat>") and all(unicodedata.category(x)[0] in "LM" for x in parts):
        return parts
    return c


def _form(cluster: str) -> str:
    """The form of a short piece of text by the rules, without the table."""
    out = []
    for c in cluster:
        if _is_invisible(c):
            continue
        while (s := "".join(map(_simple, c))) != c:
            c = s
        out += ["" if _is_invisible(x) else " " if unicodedata.category(x) == "Zs" or x == "\t" else x for x in c]
    return unicodedata.normalize("NFC", unicodedata.normalize("NFD", "".join(out)).translate(_shape))


def build_table() -> dict[str, str]:
    """Every character, line end and composed letter's cluster whose form differs from it. Raises on a conflict."""
    table = dict.fromkeys(LINE_ENDS, "\n")
    for i in (*range(0x10000), *range(0x10300, 0x20000), *range(0x2F800, 0x2FA1E), *range(0xE0000, 0xE01F0)):
        c = chr(i)
        concerned = unicodedata.decomposition(c) or i in _shape or c == "\t" or unicodedata.category(c) in ("Zs", "Cf", "Mn") or c in FILLERS
        if concerned and not 0xAC00 <= i < 0xD7A4 and (f := _form(c)) != c:
            table.setdefault(c, f)
    table |= _clusters()
    check_table(table)
    return table


def _clusters() -> dict[str, str]:
    """The spellings of every composed letter as a base with marks, look-alike bases too; Hangul goes by rule."""
    back = {o: c for c, others in SAME_SHAPE.items() for o in others}
    out = {}
    for i in range(0xC0, 0x20000):
        whole = unicodedata.normalize("NFD", chr(i))
        if len(whole) < 2 or 0xAC00 <= i < 0xD7A4 or not all(unicodedata.combining(m) for m in whole[1:]):
            continue
        shape = back.get(whole[0], whole[0])
        for base in dict.fromkeys((whole[0], shape, *SAME_SHAPE.get(shape, ""))):
            for k in range(1, len(whole)):  # some of the marks may be composed with the base
                source = unicodedata.normalize("NFC", base + whole[1:k]) + whole[k:]
                if (form := _form(source)) != source:
                    out[source] = form
    return out


def check_table(table: dict[str, str]) -> None:
    """A form must be its own form and that of the rules, and no letter may stand in two groups of look-alikes."""
    for source, form in table.items():
        if source not in LINE_ENDS and _form(source) != form:
            raise ValueError(f"{source!r} has two forms")
        if any(form[i] in table for i in range(len(form))) or _form(form) != form:
            raise ValueError(f"the form of {source!r} has a form of its own")
    letters = [c for group in SAME_SHAPE.items() for c in "".join(group)]
    if len(letters) != len(set(letters)):
        raise ValueError("a letter stands in two groups of look-alikes")


def _class(chars: Iterator[int]) -> str:
    """A character class with ranges."""
    ranges: list[list[int]] = []
    for i in sorted(chars):
        if ranges and ranges[-1][1] == i - 1:
            ranges[-1][1] = i
        else:
            ranges.append([i, i])
    return "[" + "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in ranges) + "]"


class Transducer:
    """The compiled table; ``Transducer.shared()`` is built once in each Python process."""

    _one: Transducer | None = None

    def __init__(self) -> None:
        self.table = build_table()
        # Marks, and what has the form of a mark, as the half-width sound marks.
        self.marks = _class(i for i in range(0x300, 0x20000) if unicodedata.category(self.table.get(chr(i), chr(i))[:1] or "x")[0] == "M")
        self.invisible = _class(i for i in (*range(0x20000), *range(0xE0000, 0xE01F0)) if _is_invisible(chr(i)))
        single = _class(ord(c) for c in self.table if len(c) == 1)
        # Longest first: a cluster with its marks, a run of conjoining letters, a line end, one character.
        self._simple = {ord(c): f for c, f in self.table.items() if len(c) == 1}
        self._several = re.compile(f"{self.marks}|[\\u1100-\\u11ff]|\\r")
        self._next = re.compile(f"[^{self.marks[1:-1]}](?:{self.invisible}*{self.marks})+|[\\u1100-\\u11ff]{{2,}}|\\r\\n|{single}")
        self._cluster = lru_cache(1 << 16)(_form)

    @classmethod
    def shared(cls) -> Transducer:
        if cls._one is None:
            cls._one = cls()
        return cls._one

    def _replace(self, m: re.Match) -> str:
        found = self.table.get(m[0])
        return self._cluster(m[0]) if found is None else found

    def form(self, text: str) -> str:
        if text.isascii() and "\t" not in text and "\r" not in text:
            return text
        if not self._several.search(text):  # every match is one character long
            return text.translate(self._simple)
        return self._next.sub(self._replace, text)


def _forms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    form = Transducer.shared().form
    for b in batches:
        texts = pa.array([None if t is None else form(t) for t in b.column("text").to_pylist()], pa.string())
        yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("text"), texts], names=["doc_id", "text", "form"])


def forms(documents: DataFrame) -> DataFrame:
    """``doc_id, text, form`` of each document; NULL keeps NULL, other columns are ignored."""
    return documents.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(_forms, "doc_id long, text string, form string")


def _marked(documents: DataFrame) -> DataFrame:
    """``doc_id`` with 128-bit hashes of the form and of the text itself, written once."""
    both = forms(documents).where("text IS NOT NULL")
    return cut(both.select("doc_id", F.unhex(F.md5("form")).alias("form"), F.unhex(F.md5("text")).alias("raw")))


def _spelled(marked: DataFrame) -> DataFrame:
    """``form, raw, n, first``: the spellings of each form, with documents and lowest ``doc_id`` of each."""
    return marked.groupBy("form", "raw").agg(F.count("*").alias("n"), F.min("doc_id").alias("first"))


def classes(documents: DataFrame) -> DataFrame:
    """``doc_id, class_id, n_spellings``: documents of one form have one class, its lowest ``doc_id``.

    Documents with a NULL text are in no class. Documents meet their class by
    their spelling's hash; a form of many documents is spread over ``SALTS`` tasks.
    """
    marked = _marked(documents)
    known = _spelled(marked).groupBy("form").agg(F.min("first").alias("class_id"), F.count("*").alias("n_spellings"))
    known = known.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))))
    salted = marked.select("doc_id", "form", F.pmod(F.xxhash64("doc_id"), F.lit(SALTS)).cast("int").alias("salt"))
    return salted.join(known, ["form", "salt"]).select("doc_id", "class_id", "n_spellings")


def equal_looking(documents: DataFrame) -> DataFrame:
    """``doc_id_a < doc_id_b``: texts that differ in characters but have one form.

    Pairs are derived from pairs of spellings of one form, so documents of equal
    text never meet. A spelling of many documents is cut into pieces of about
    ``PIECE`` of them, by its size, and its partners go to each piece, so that
    no task makes all pairs of a form. NULL texts pair with nothing.
    """
    marked = _marked(documents)
    spelled = _spelled(marked)
    some = cut(spelled.join(spelled.groupBy("form").agg(F.count("*").alias("k")).where("k > 1"), "form").select("form", "raw", "n"))
    a, b = some.select("form", F.col("raw").alias("raw_a")), some.select("form", F.col("raw").alias("raw_b"), (F.col("n") / PIECE).cast("int").alias("last"))
    pairs = a.join(b, "form").where("raw_a < raw_b").select("raw_a", "raw_b", "last")
    left = marked.select(F.col("doc_id").alias("x"), F.col("raw").alias("raw_a")).join(pairs, "raw_a").select("x", "raw_b", F.explode(F.sequence(F.lit(0), "last")).alias("piece"))
    right = marked.select(F.col("doc_id").alias("y"), "raw").join(some.select("raw", (F.col("n") / PIECE).cast("int").alias("last")), "raw")
    right = right.select("y", F.col("raw").alias("raw_b"), F.pmod(F.xxhash64("y"), F.col("last") + 1).cast("int").alias("piece"))
    return left.join(right, ["raw_b", "piece"]).where("x <> y").select(F.least("x", "y").alias("doc_id_a"), F.greatest("x", "y").alias("doc_id_b"))
