"""Text functions as Column expressions. White space, digits and letters are Unicode's, so patterns run with (?U)."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import constants as K


def _col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def normalize(c) -> Column:
    """Lower case, runs of white space as one space, no space at the ends."""
    return F.trim(F.regexp_replace(F.lower(_col(c)), r"(?U)\s+", " "))


def tokenize(c) -> Column:
    """Tokens of the normalised text; a run of Chinese characters gives its bigrams, and itself if of at most 6."""
    found = F.regexp_extract_all(normalize(c), F.lit(f"({K.TOKEN_PATTERN})"), F.lit(1))
    grams = lambda m: F.transform(F.sequence(F.lit(1), F.greatest(F.length(m) - 1, F.lit(1))), lambda i: F.substring(m, i, F.lit(2)))
    whole = lambda m: F.when(F.length(m) <= 6, F.array(m)).otherwise(F.array().cast("array<string>"))
    return F.flatten(F.transform(found, lambda m: F.when(m.rlike(f"^{K.CJK_PATTERN}"), F.concat(grams(m), whole(m))).otherwise(F.array(m))))


def contains_any(c, terms: list[str]) -> Column:
    """True if the lower-cased text holds any of the terms, lower-cased; empty terms don't count."""
    text, out = F.lower(_col(c)), F.lit(False)
    for term in terms:
        if term:
            out = out | text.contains(term.lower())
    return F.coalesce(out, F.lit(False))


def ascii_lower(c) -> Column:
    return F.translate(_col(c), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def keyword_like(c, query: str) -> Column:
    """Keyword search: ASCII case folding of the text, the query lower-cased; % and _ in it stay wildcards."""
    return ascii_lower(c).like("%" + query.lower().replace("\\", "\\\\") + "%")


def section_of(c) -> Column:
    """Section that a short heading opens, else null."""
    text = F.btrim(F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " ")), F.lit(K.SECTION_TRIM))
    out = None
    for name, pattern in K.SECTIONS:
        hit = text.rlike("(?iuU)" + pattern)
        out = F.when(hit, name) if out is None else out.when(hit, name)
    return F.when(F.length(text) <= K.SECTION_MAX, out)


def is_caption(c) -> Column:
    return _col(c).rlike("(?iuU)" + K.CAPTION_PATTERN)


def kind_of(c) -> Column:
    text = _col(c)
    return F.when(section_of(text).isNotNull(), "heading").when(is_caption(text) & text.rlike("(?iu)" + K.TABLE_CAPTION_PATTERN), "table_caption").when(is_caption(text), "figure_caption").otherwise("text")


def has_number(c) -> Column:
    """A number that doesn't follow a letter, digit, underscore or dot (superscripts count as digits)."""
    return _col(c).rlike(r"(?U)(?<![\p{L}\p{N}_.])" + K.NUMBER_PATTERN)


def has_unit(c) -> Column:
    """A unit; a lone m has no letter, digit (superscripts too) or underscore beside it."""
    alone = K.UNIT_PATTERN.replace(r"\bm\b", r"(?<![\p{L}\p{N}_])m(?![\p{L}\p{N}_])")
    return _col(c).rlike("(?iuU)" + alone)


def is_prediction(c) -> Column:
    return _col(c).rlike("(?iuU)" + K.PREDICTION_PATTERN)


def stable_id(prefix: str, *parts) -> Column:
    joined = F.concat_ws("|", *[_col(p).cast("string") for p in parts])
    return F.concat(F.lit(prefix + "-"), F.substring(F.sha2(joined, 256), 1, 14))


def language(c) -> Column:
    """zh if there are Chinese characters, more than 0.12 for each Latin letter; en if any Latin; by the first 20,000 characters."""
    head = F.substring(_col(c), 1, K.LANGUAGE_CHARS)
    chinese, latin = F.regexp_count(head, F.lit(K.CJK_PATTERN)), F.regexp_count(head, F.lit("[A-Za-z]"))
    return F.when((chinese > 0) & (chinese > latin * 0.12), "zh").when(latin > 0, "en").otherwise("unknown")


def percent(c) -> Column:
    """Half up, as a display string; null shows as zero."""
    return F.concat(F.floor(F.coalesce(_col(c), F.lit(0.0)) * 100 + 0.5).cast("string"), F.lit("%"))


def status_label(c) -> Column:
    pairs = [F.lit(x) for kv in K.STATUS_LABELS.items() for x in kv]
    return F.create_map(*pairs)[_col(c)]


def utc_iso(c) -> Column:
    """A time as ISO text in UTC, to the second."""
    return F.concat(F.date_format(F.date_trunc("SECOND", _col(c)), "yyyy-MM-dd'T'HH:mm:ss"), F.lit("+00:00"))


def prefixed(prefix: str, c) -> Column:
    """A prefix and the text with white space collapsed, as neural encoders take it."""
    return F.concat(F.lit(prefix), F.trim(F.regexp_replace(_col(c), r"(?U)\s+", " ")))


def canonical_json(fields: dict[str, Column]) -> Column:
    """Compact JSON with sorted keys."""
    return F.to_json(F.struct(*[fields[k].alias(k) for k in sorted(fields)]))
