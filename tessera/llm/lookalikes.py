"""Text that looks the same in different characters, brought to one form.

A transducer over grapheme clusters, compiled once from rules, rewrites each text
in one pass. At every place the longest run counts: a base character with all
marks and invisible characters that follow it. What is equal to a reader becomes
equal: full-width and other presentation forms, composed and combining accents,
kinds of space and of hyphen, invisible characters, letters of another script
with the same shape. Case, accents themselves, raised or encircled digits, words,
numbers and line breaks stay apart.
"""

from __future__ import annotations

import functools
import hashlib
import re
import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

from tessera.session import cut

# Letters of other scripts with the shape of a Latin letter, and beside them the Latin letters, pair by pair.
CYRILLIC = "А В Е Ѕ І Ј К М Н О Р С Т Х Ү Ѵ Ԍ Ԛ Ԝ Ӏ Ӕ Ә Ӡ а е о р с у х ѕ і ј һ ԁ ԛ ԝ ӏ ү ѵ ӕ ә ӡ ԍ".split()
CYRILLIC_AS = "A B E S I J K M H O P C T X Y V G Q W I Æ Ə Ʒ a e o p c y x s i j h d q w l y v æ ə ʒ ɢ".split()
GREEK = "Α Β Ε Ζ Η Ι Κ Μ Ν Ο Ρ Τ Υ Χ Ϲ Ϳ α γ ι ν ο ρ υ ϲ ϳ".split()
GREEK_AS = "A B E Z H I K M N O P T Y X C J a y i v o p u c j".split()
ARMENIAN = "Լ Օ Ս Տ զ հ յ ո ս ց օ".split()
ARMENIAN_AS = "L O U S q h j n u g o".split()
CHEROKEE = "Ꭰ Ꭱ Ꭲ Ꭵ Ꭹ Ꭺ Ꭻ Ꭼ Ꮃ Ꮇ Ꮋ Ꮐ Ꮓ Ꮟ Ꮢ Ꮤ Ꮩ Ꮪ Ꮮ Ꮯ Ꮲ Ꮶ Ꮷ Ᏻ Ᏼ".split()
CHEROKEE_AS = "D R T i y A J E W M H G Z b R W V S L C P K d G B".split()
LISU = "ꓐ ꓑ ꓓ ꓔ ꓖ ꓗ ꓙ ꓚ ꓜ ꓝ ꓟ ꓠ ꓡ ꓢ ꓣ ꓦ ꓧ ꓪ ꓫ ꓬ ꓮ ꓰ ꓲ ꓳ ꓴ".split()
LISU_AS = "B P D T G K J C Z F M N L S R V H W X Y A E I O U".split()
COPTIC = "Ⲁ Ⲃ Ⲏ Ⲓ Ⲕ Ⲙ Ⲛ Ⲟ Ⲣ Ⲥ Ⲧ Ⲩ Ⲭ ⲟ ⲣ ⲥ".split()
COPTIC_AS = "A B H I K M N O P C T Y X o p c".split()
# Latin letters of one shape, and small capitals drawn as a small letter of another script.
LATIN = "ɑ ɡ ı ɩ ȷ ᴄ ᴏ ᴜ ᴠ ᴡ ᴢ ꜱ ʙ ʜ ᴍ ᴛ ĸ".split()
LATIN_AS = "a g i i j c o u v w z s в н м т к".split()
# Punctuation with the shape of an ASCII mark; and hyphens, dashes of a hyphen's length and the minus.
MARKS = "․ ꓸ ꓹ ∶ ˸ ։ ꞉ ꓽ ⁄ ∕ ∗ ∣ ∼ ǃ".split()
MARKS_AS = ". . , : : : : : / / * | ~ !".split()
HYPHENS = "‐‑﹣－‒−˗⁃"
#: Fillers and selectors that show nothing although they are not format characters.
FILLERS = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤ"
#: Format characters that do show.
SHOWN_FORMATS = "؀؁؂؃؄؅۝܏࢐࢑࣢"
#: Mathematical letters drawn upright and plain; bold, slanted and script ones look different.
PLAIN_STYLES = ("MATHEMATICAL SANS-SERIF CAPITAL", "MATHEMATICAL SANS-SERIF SMALL", "MATHEMATICAL SANS-SERIF DIGIT", "MATHEMATICAL MONOSPACE")
#: Compatibility letters that are drawn as the letters they stand for: ligatures, digraphs, roman numerals.
DRAWN_AS_LETTERS = ((0x0132, 0x0133), (0x01C4, 0x01CC), (0x01F1, 0x01F3), (0x2160, 0x217F), (0xFB00, 0xFB4F))
#: Code points looked through; beyond them lie only ideographs, tags, selectors and private use.
PLANES = (*range(0x20000), *range(0x2F800, 0x2FA20), *range(0xE0000, 0xE01F0))


def _invisible(ch: str) -> bool:
    kind = unicodedata.category(ch)
    if kind == "Cc":
        return ch not in "\t\n\v\f\r\x85" and ch not in "\x1c\x1d\x1e\x1f"
    return (kind == "Cf" and ch not in SHOWN_FORMATS) or ch in FILLERS or 0xFE00 <= ord(ch) <= 0xFE0F or 0xE0100 <= ord(ch) <= 0xE01EF


def _rules():
    """(name, rule) pairs; a rule gives the replacement of one character, or None."""
    shapes: dict[str, str] = {}
    for letters, latin in ((CYRILLIC, CYRILLIC_AS), (GREEK, GREEK_AS), (ARMENIAN, ARMENIAN_AS), (CHEROKEE, CHEROKEE_AS), (LISU, LISU_AS), (COPTIC, COPTIC_AS), (LATIN, LATIN_AS), (MARKS, MARKS_AS)):
        if len(letters) != len(latin) or shapes.keys() & set(letters):
            raise ValueError("shapes must be pairs, each letter once")
        shapes |= zip(letters, latin)

    def form(ch: str) -> str | None:
        kind, _, rest = unicodedata.decomposition(ch).partition("> ")
        if not rest:
            return None
        kind = kind[1:]
        plain = kind in ("wide", "narrow", "initial", "medial", "final", "isolated")
        plain |= kind == "font" and unicodedata.name(ch, "").startswith(PLAIN_STYLES)
        plain |= kind == "compat" and any(a <= ord(ch) <= b for a, b in DRAWN_AS_LETTERS)
        return unicodedata.normalize("NFKC", ch) if plain else None

    return (
        ("invisible", lambda ch: "" if _invisible(ch) else None),
        ("space", lambda ch: " " if ch != " " and unicodedata.category(ch) == "Zs" else None),
        ("hyphen", lambda ch: "-" if ch in HYPHENS else None),
        ("form", form),
        ("shape", shapes.get),
    )


@functools.lru_cache(maxsize=1)
def compiled() -> tuple[dict[str, str], re.Pattern]:
    """The table of single characters and the pattern of the clusters that need work.

    Building it checks for conflicts: two rules may not send one character to
    different places, replacements may hold nothing that is replaced itself, and
    ASCII stays as it is.
    """
    table: dict[str, str] = {}
    rules = _rules()
    for code in PLANES:
        ch = chr(code)
        found = {out for _, rule in rules if (out := rule(ch)) is not None and out != ch}
        if len(found) > 1:
            raise ValueError(f"rules disagree on U+{code:04X}: {sorted(found)}")
        if found:
            table[ch] = found.pop()
    for ch, out in list(table.items()):  # a form may end in a letter that has a shape rule
        for _ in range(3):
            new = "".join(table.get(x, x) for x in unicodedata.normalize("NFD", out))
            if new == out:
                break
            out = new
        table[ch] = out = unicodedata.normalize("NFC", out)
        if any(x in table for x in unicodedata.normalize("NFD", out)):
            raise ValueError(f"the replacement of U+{ord(ch):04X} is itself replaced")
    if any(ch.isprintable() and ord(ch) < 127 for ch in table):
        raise ValueError("ASCII must stay as it is")
    for code in PLANES:  # composed characters whose base is replaced, or that are not in composed form
        ch = chr(code)
        if ch not in table and code > 127 and unicodedata.category(ch) != "Cs":
            parts = unicodedata.normalize("NFD", ch)
            out = unicodedata.normalize("NFC", "".join(table.get(x, x) for x in parts))
            if out != ch:
                table[ch] = out
    joins = [chr(c) for c in PLANES if unicodedata.category(chr(c)) in ("Mn", "Mc", "Me")]
    joins += [chr(c) for c in range(0x1160, 0x1200)]  # vowels and finals that compose with the syllable before
    joins += [ch for ch, out in table.items() if not out]
    follow = _ranges(joins)
    heads = _ranges([ch for ch, out in table.items() if out])
    return table, re.compile(f"[^{follow}]?[{follow}]+|[{heads}]")


def _ranges(chars: list[str]) -> str:
    codes, parts, i = sorted(set(map(ord, chars))), [], 0
    while i < len(codes):
        j = i
        while j + 1 < len(codes) and codes[j + 1] == codes[j] + 1:
            j += 1
        parts.append(f"\\U{codes[i]:08x}" + (f"-\\U{codes[j]:08x}" if j > i else ""))
        i = j + 1
    return "".join(parts)


#: A run of characters outside printable ASCII, with the one before it, which may be the base of a mark.
_RUN = re.compile(r"[\t-\r\x1c-\x7e]?[^\t-\r\x1c-\x7e]+")


class _Runs(dict):
    """Run to output. A run met for the first time goes through the cluster table; then it is known."""

    def __init__(self):
        super().__init__()
        self.table, self.clusters = compiled()

    def _cluster(self, m: re.Match) -> str:
        whole = m.group()
        if len(whole) == 1 and whole in self.table:
            return self.table[whole]
        parts = unicodedata.normalize("NFD", "".join(self.table.get(x, x) for x in whole))
        return unicodedata.normalize("NFC", "".join(self.table.get(x, x) for x in parts))

    def __missing__(self, run: str) -> str:
        out = self.clusters.sub(self._cluster, run)
        if len(self) < 500_000 and len(run) < 64:  # only memory: the result is the same either way
            self[run] = out
        return out


@functools.lru_cache(maxsize=1)
def _machine():
    runs = _Runs()
    return lambda m: runs[m.group()]


def one_form(text: str | None) -> str | None:
    """The consistent form of a text; null stays null, and one_form(one_form(t)) == one_form(t)."""
    return text if text is None else _RUN.sub(_machine(), text)


@F.pandas_udf(T.StringType())
def _one_form_udf(texts: pd.Series) -> pd.Series:
    return pd.Series([one_form(t) for t in texts], dtype=object)


@F.pandas_udf(T.StructType([T.StructField("form", T.BinaryType()), T.StructField("text", T.BinaryType())]))
def _digests(texts: pd.Series) -> pd.DataFrame:
    def digest(t: str) -> bytes:
        return hashlib.blake2b(t.encode("utf-8", "surrogatepass"), digest_size=16).digest()

    forms, whole = [], []
    for t in texts:
        if t is None or not t.strip():
            forms.append(None), whole.append(None)
            continue
        f = one_form(t)
        whole.append(digest(t))
        forms.append(whole[-1] if f == t else digest(f) if f.strip() else None)
    return pd.DataFrame({"form": forms, "text": whole}, dtype=object)


def consistent(column: str | Column) -> Column:
    """The column's text in one consistent form."""
    return _one_form_udf(column)


def normalized(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document with its text in one form, and whether that changed it; null stays null (not changed)."""
    out = documents.select(id_col, F.col(text_col).alias("_t"), consistent(text_col).alias(text_col))
    return out.select(id_col, text_col, (~F.col("_t").eqNullSafe(F.col(text_col))).alias("changed"))


def same_looking(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Pairs of documents whose texts differ in code points but look the same: ``a``, ``b`` with a < b.

    Null and blank texts (blank also in their one form) have no pair. Only 16-byte
    digests of the text and its form are shuffled. Different texts of one form are
    paired first, once for any number of copies; documents are joined to those
    pairs of texts, so copies of one text are never compared with each other.
    """
    d = documents.select(F.col(id_col).alias("id"), _digests(F.col(text_col)).alias("d")).where("d.form IS NOT NULL")
    d = cut(d.select("id", F.col("d.form").alias("form"), F.col("d.text").alias("text")), "digests")
    texts = d.groupBy("form", "text").agg(F.lit(1).alias("one"))
    several = texts.groupBy("form").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("form")
    texts = texts.join(several, "form", "left_semi").select("form", "text")
    pairs = texts.alias("x").join(texts.alias("y"), "form").where("x.text < y.text")
    pairs = pairs.select(F.col("x.text").alias("t1"), F.col("y.text").alias("t2"))
    one = d.select(F.col("id").alias("i1"), F.col("text").alias("t1"))
    two = d.select(F.col("id").alias("i2"), F.col("text").alias("t2"))
    met = pairs.join(one, "t1").join(two, "t2")
    return met.select(F.least("i1", "i2").alias("a"), F.greatest("i1", "i2").alias("b")).where("a <> b").distinct()


def look_alike_classes(documents: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Every document whose form several different texts share: its id, ``class`` (the smallest id of the form) and
    ``texts`` (how many different texts the form has). The pairs of :func:`same_looking` without writing them out:
    as large as the documents, however many copies there are."""
    d = documents.select(F.col(id_col).alias("id"), _digests(F.col(text_col)).alias("d")).where("d.form IS NOT NULL")
    d = cut(d.select("id", F.col("d.form").alias("form"), F.col("d.text").alias("text")), "digests")
    each = d.groupBy("form", "text").agg(F.min("id").alias("first"))
    forms = each.groupBy("form").agg(F.min("first").alias("class"), F.count(F.lit(1)).alias("texts")).where("texts > 1")
    return d.join(forms, "form").select(F.col("id").alias(id_col), "class", "texts").distinct()
