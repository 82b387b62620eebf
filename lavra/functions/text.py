"""Text functions as Columns: everything here stays inside the JVM."""

from __future__ import annotations

import unicodedata
from functools import lru_cache

from pyspark.sql import Column
from pyspark.sql import functions as F


@lru_cache(maxsize=2)
def accent_pairs(compatibility: bool = False) -> tuple[str, str]:
    """Every character of the basic plane whose decomposition is one base character plus marks, and those bases."""
    form, src, dst = "NFKD" if compatibility else "NFD", [], []
    for cp in range(0xA0, 0xFFFF):
        if 0xAC00 <= cp <= 0xD7A3 or 0xD800 <= cp <= 0xF8FF:
            continue
        ch = chr(cp)
        base = "".join(c for c in unicodedata.normalize(form, ch) if not unicodedata.combining(c))
        if len(base) == 1 and base != ch:
            src.append(ch)
            dst.append(base)
    return "".join(src), "".join(dst)


def strip_accents(c: Column, compatibility: bool = False) -> Column:
    """Base characters without combining marks (STR-02)."""
    return F.regexp_replace(F.translate(c, *accent_pairs(compatibility)), r"[̀-ͯ]", "")


def fold(c: Column) -> Column:
    """Lower case without accents."""
    return F.lower(strip_accents(F.lower(c)))


def collapse_spaces(c: Column) -> Column:
    return F.trim(F.regexp_replace(c, r"[\s\u00A0]+", " "))


def normalize_text(c: Column) -> Column:
    """Trim, one space between words, compatibility decomposition without marks, lower case (STR-01)."""
    return F.lower(strip_accents(collapse_spaces(F.lower(c)), compatibility=True))


def strip(c: Column) -> Column:
    """Trim all white space, not only blanks."""
    return F.regexp_replace(c, r"^[\s\u00A0]+|[\s\u00A0]+$", "")


def words(c: Column) -> Column:
    """Runs of letters and digits without case or accents."""
    return F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}]+"), 0)


def hyphen_terms(c: Column) -> Column:
    """Runs of letters and digits; runs joined by single hyphens are one term."""
    return F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}]+(?:-[\p{L}\p{N}]+)*"), 0)


def bm25_tokens(c: Column) -> Column:
    """Lower-cased words with accents and repeats kept (STR-03)."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), 0)


#: Portuguese function words that the overlap measures leave out.
STOPWORDS = tuple(
    "a o as os um uma uns umas de do da dos das em no na nos nas por para com sem sob sobre entre ate e ou que qual quais quando onde como "
    "quanto quanta quantos quantas quem cujo cuja se ao aos à às pelo pela pelos pelas num numa nesse nessa neste nesta esse essa este esta isso isto "
    "aquele aquela seu sua seus suas meu minha é sao foi ser estar estao ha há tem têm mais menos muito pouco todo toda todos todas cada algum alguma "
    "nenhum nao não sim ja já the of".split()
)


def content_tokens(c: Column, remove_stop: bool = True, stem: bool = False) -> Column:
    """Set of folded alphanumeric runs longer than one character, without stop words, optionally stemmed (STR-04)."""
    toks = F.filter(words(c), lambda t: F.length(t) > 1)
    if remove_stop:
        stop = F.array(*[F.lit(s) for s in sorted(set(STOPWORDS))])
        toks = F.array_except(toks, stop)
    if stem:
        toks = F.transform(toks, light_stem)
    return F.array_distinct(toks)


#: Endings, what replaces them, and how many letters a word must have beyond the ending; first match wins.
STEM_RULES = (("acoes", "ao", 3), ("coes", "ao", 3), ("oes", "ao", 3), ("ais", "al", 3), ("eis", "el", 3), ("ives", "", 3), ("res", "", 3), ("ns", "m", 3), ("s", "", 4))


def light_stem(t: Column) -> Column:
    """Light Portuguese plural stemmer (STR-05)."""
    out = F
    for ending, put, beyond in STEM_RULES:
        size = len(ending)
        out = out.when(t.endswith(ending) & (F.length(t) >= size + beyond), F.concat(F.substring(t, F.lit(1), F.length(t) - size), F.lit(put)))
    return out.otherwise(t)


def zero_padded_code(prefix: Column | str, n: Column, digits: Column | int) -> Column:
    """PREFIX plus digits padded with zeros; longer numbers keep all their digits (STR-06)."""
    p = F.lit(prefix) if isinstance(prefix, str) else prefix
    d = F.lit(digits) if isinstance(digits, int) else digits
    s = n.cast("string")
    return F.concat(p, F.repeat(F.lit("0"), F.greatest(d - F.length(s), F.lit(0)).cast("int")), s)


def year_suffix(c: Column) -> Column:
    """`-yy` at the end of a contract code, else the empty text (STR-08)."""
    return F.regexp_extract(F.trim(c), r"(-\d{2})$", 1)


def code_number(c: Column, prefix: str, digits: int) -> Column:
    """Number in `PREFIXnnn` or `PREFIXnnn-...`, else null (STR-09)."""
    m = F.regexp_extract(c, rf"^{prefix}(\d{{{digits},}})(?:-.+)?$", 1)
    return F.when(m != "", m.cast("bigint"))


def first_label(c: Column) -> Column:
    """`a, b` becomes `a` (STR-11)."""
    return F.trim(F.element_at(F.split(c, ","), 1))


def source_ref(c: Column) -> Column:
    """`type.key` split at the first dot (STR-10)."""
    parts = F.split(c, r"\.", 2)
    return F.struct(F.element_at(parts, 1).alias("source_type"), F.try_element_at(parts, F.lit(2)).alias("source_key"))


def is_blank(c: Column) -> Column:
    """Null, NaN spelled out by a cast, or white space only (PRJ-10)."""
    return c.isNull() | (strip(c.cast("string")) == "") | (c.cast("string") == "NaN")


def manual_placeholder(c: Column, name: Column) -> Column:
    """Unfilled annotations fall back to the name with blanks for underscores (PRJ-12)."""
    return F.when(c.isNull() | (c == "") | c.contains("[MANUAL]"), F.replace(name, F.lit("_"), F.lit(" "))).otherwise(F.trim(c))


def json_block(c: Column) -> Column:
    """The text from the first opening to the last closing brace (STR-16)."""
    return F.regexp_extract(c, r"(?s)\{.*\}", 0)


def parse_source_list(c: Column) -> Column:
    """Ids in a selector's answer: strict JSON, then the first JSON object, then every id in the text (STR-15)."""
    schema = "sources array<string>"
    found = F.array_distinct(F.regexp_extract_all(c, F.lit(r"\b(?:sql|api|spreadsheets)\.[A-Za-z_]+"), 0))
    return F.coalesce(F.from_json(c, schema)["sources"], F.from_json(json_block(c), schema)["sources"], found)


def set_overlap(q: Column, d: Column, metric: str = "containment") -> Column:
    """Containment of q in d, or Jaccard; 0 where q (or both) is empty (STR-14)."""
    inter = F.size(F.array_intersect(q, d))
    if metric == "containment":
        return F.when(F.size(q) > 0, inter / F.size(F.array_distinct(q))).otherwise(0.0)
    union = F.size(F.array_union(q, d))
    return F.when(union > 0, inter / union).otherwise(0.0)
