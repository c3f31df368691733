"""Column functions over text: matching, counting and cleaning."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Abbreviations whose stops end no sentence; what must survive a translation unchanged; ornament lines.
ABBREVIATIONS = r"\b(?:Lt|Col|Gen|Maj|Capt|Sgt|Brig|Mr|Mrs|Ms|Dr|St|No|Vol|pp|e\.g|i\.e|vs|etc|a\.m|p\.m|U\.S|A\.F|B\.C|A\.D)\."
PLACEHOLDER = r"%[sd]|%1\$[sd]|\{[A-Za-z_][A-Za-z0-9_]*\}|\{\{[A-Za-z_][A-Za-z0-9_]*\}\}"
URL = r"https?://\S+|www\.\S+"
EMAIL = r"[\w.+-]+@[\w-]+(?:\.[\w-]+)+"
DOI = r"10\.\d{4,9}/[^\s]+"
CITATION = r"\[\d+(?:[-,]\s*\d+)*\]"
PRESERVED = "(?i)" + "|".join((PLACEHOLDER, URL, EMAIL, DOI, CITATION))
ORNAMENT = r"^[\s*•·▪◦‣❦❧—–\-]{1,12}$"
CONTROL = r"[\x00-\x08\x0b\x0c\x0e-\x1f\x7f-\x9f]"
SENTENCE_END = "[.!?…。！？]+[”\"'’)\\]]*"
CJK = r"[\x{4e00}-\x{9fff}]"


def strip(x: Column) -> Column:
    """Without Unicode white space at the ends."""
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def term_matches(term: Column, text: Column) -> Column:
    """Terms with Han characters match anywhere; others whatever their case, not next to an ASCII letter, digit or underscore."""
    t = strip(term)
    bounded = F.concat(F.lit(r"(?iu)(?<![A-Za-z0-9_])\Q"), t, F.lit(r"\E(?![A-Za-z0-9_])"))
    return F.coalesce(F.when(t == "", F.lit(False)).when(t.rlike(CJK), F.contains(text, t)).otherwise(F.regexp_like(text, bounded)), F.lit(False))


def sentences(x: Column) -> Column:
    clear = F.regexp_replace(x, "(?i)" + ABBREVIATIONS, " ")
    return F.size(F.filter(F.split(clear, SENTENCE_END), lambda p: F.trim(p) != ""))


def incomplete(source: Column, target: Column) -> Column:
    """Blank; or far too short for a long source; or too few sentences and too short."""
    t = strip(F.coalesce(target, F.lit("")))
    long, short = F.length(source), F.length(t)
    n = sentences(source)
    return (t == "") | ((long >= 120) & (short < 0.15 * long)) | ((n >= 2) & (sentences(t) < 0.5 * n) & (short < 0.35 * long))


def memory_eligible(source: Column, target: Column) -> Column:
    return source.rlike(r"[A-Za-z0-9\x{4e00}-\x{9fff}]") & (strip(target) != "")


def without_controls(x: Column) -> Column:
    return F.regexp_replace(x, CONTROL, "")


def folded(x: Column) -> Column:
    """White space collapsed, lower case."""
    return F.lower(F.trim(F.regexp_replace(x, r"\s+", " ")))


def preserved_tokens(x: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(x, F.lit(PRESERVED), F.lit(0)))


def preserved_kind(token: Column) -> Column:
    full = lambda p: token.rlike(f"(?i)^(?:{p})$")
    return F.when(full(PLACEHOLDER), "placeholder").when(full(URL), "url").when(full(EMAIL), "email").when(full(DOI), "doi").otherwise("citation")


def words(x: Column, least: int = 1) -> Column:
    return F.regexp_extract_all(x, F.lit(f"[A-Za-z]{{{least},}}"), F.lit(0))


def short_hash(*parts: Column, prefix: str) -> Column:
    return F.concat(F.lit(prefix), F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 12))


# Endings that a word loses, the first that leaves three letters or more, and what takes their place.
ENDINGS = (("ily", "y"), ("ness", ""), ("ment", ""), ("tion", ""), ("sion", ""), ("ing", ""), ("ed", ""), ("er", ""), ("est", ""), ("es", ""), ("ly", ""), ("s", ""))


def base_form(word: Column) -> Column:
    """The word without its ending, and without the second of two equal letters that this leaves at its end."""
    cut = word
    for ending, by in reversed(ENDINGS):
        cut = F.when(word.endswith(ending) & (F.length(word) > len(ending) + 2), F.concat(F.substring(word, F.lit(1), F.length(word) - len(ending)), F.lit(by))).otherwise(cut)
    doubled = (F.length(cut) > 3) & (F.right(cut, F.lit(1)) == F.substring(cut, F.length(cut) - 1, F.lit(1))) & ~F.right(cut, F.lit(1)).isin("e", "i", "o")
    return F.when(doubled, F.substring(cut, F.lit(1), F.length(cut) - 1)).otherwise(cut)


def base_forms(word: Column) -> Column:
    """The word and its base form."""
    return F.array_distinct(F.array(word, base_form(word)))
