"""Text as Spark column expressions; nothing here leaves the JVM."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# The ASCII punctuation that is stripped from both ends of a token,
# and the white space that parts tokens (spelled out, as \s differs by engine).
PUNCTUATION = "!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~"
SPACE_RUN = "[ \\t\\n\\r\\f\\x0B]+"
# Every Unicode white space, the ASCII separators and the underscore.
PHRASE_GAP = "(?U)[\\s_\\x1c-\\x1f]+"


def nfc(c: Column) -> Column:
    """Unicode NFC in the JVM (ICU, which Spark ships); plain ASCII is passed by."""
    return F.when(c.rlike("[^\\x00-\\x7F]"), F.call_function("java_method", F.lit("com.ibm.icu.text.Normalizer"), F.lit("compose"), c, F.lit(False))).otherwise(c)


def canonical_phrase(c: Column) -> Column:
    """NFC, lower case, each run of white space or underscores as one space, trimmed.

    Null stays null, a blank phrase becomes the empty string.
    """
    return F.trim(F.regexp_replace(F.lower(nfc(c)), PHRASE_GAP, " "))


def tokens(c: Column, stopwords: list[str] | None = None) -> Column:
    """Normalised words of a text, in order.

    Lower case, split at white space, stopwords dropped *before* stripping,
    punctuation stripped from both ends, ``'s`` deleted, empty words dropped.
    Null gives null, an empty text an empty array.
    """
    words = F.split(F.lower(c), SPACE_RUN)
    if stopwords:
        words = F.filter(words, lambda w: ~w.isin(stopwords))
    words = F.transform(words, lambda w: F.replace(F.btrim(w, F.lit(PUNCTUATION)), F.lit("'s"), F.lit("")))
    return F.filter(words, lambda w: w != "")


def tokens_no_digits(c: Column, stopwords: list[str] | None = None) -> Column:
    """As :func:`tokens`, but digits are removed first and ``'s`` is kept."""
    words = F.split(F.regexp_replace(F.lower(c), "[0-9]", ""), SPACE_RUN)
    if stopwords:
        words = F.filter(words, lambda w: ~w.isin(stopwords))
    return F.filter(F.transform(words, lambda w: F.btrim(w, F.lit(PUNCTUATION))), lambda w: w != "")


def raw_tokens(c: Column) -> Column:
    """White-space tokens as they stand."""
    return F.filter(F.split(c, SPACE_RUN), lambda w: w != "")


def sentences(c: Column) -> Column:
    """A plain splitter at ``.``, ``!`` and ``?`` followed by white space."""
    return F.filter(F.transform(F.split(c, "(?<=[.!?])[ \\t\\n\\r]+"), lambda s: F.trim(s)), lambda s: s != "")


def concept_name(c: Column) -> Column:
    """Lower case, spaces as underscores."""
    return F.replace(F.lower(c), F.lit(" "), F.lit("_"))


def display_phrase(c: Column) -> Column:
    """Underscores as spaces."""
    return F.translate(c, "_", " ")


def is_eng(c: Column) -> Column:
    """First character strictly between A and Z or a and z (the ends are out)."""
    return F.coalesce(c.rlike("^[B-Yb-y]"), F.lit(False))


def tail_levenshtein(a: Column, b: Column) -> Column:
    """Edit distance that ignores the first character of both words.

    Null if either side is null or empty.
    """
    return F.when((F.length(a) > 0) & (F.length(b) > 0), F.levenshtein(F.substring(a, 2, 1 << 30), F.substring(b, 2, 1 << 30)))


def phrase_spans(c: Column) -> Column:
    """Contents of ``<phrase>…</phrase>``, lower case, spaces as underscores."""
    return F.transform(F.regexp_extract_all(c, F.lit("(?s)<phrase>(.*?)</phrase>"), 1), concept_name)


def strip_markup(c: Column) -> Column:
    """Text without phrase tags."""
    return F.regexp_replace(c, "</?phrase>", "")


def join_phrases(c: Column) -> Column:
    """Tagged phrases become single tokens joined by underscores, tags are removed.

    Only inner spaces of a phrase change; the split alternates outside and inside.
    """
    parts = F.split(c, "</?phrase>")
    return F.array_join(F.transform(parts, lambda p, i: F.when(i % 2 == 1, F.replace(p, F.lit(" "), F.lit("_"))).otherwise(p)), "")


def head_key(c: Column, n: int = 100) -> Column:
    """The first ``n`` characters without spaces, for matching two copies of a corpus."""
    return F.substring(F.replace(c, F.lit(" "), F.lit("")), 1, n)


def pad(ids: Column, length: int = 800, fill: int = 0) -> Column:
    """Cut or fill an id array to one length."""
    return F.slice(F.concat(ids, F.array_repeat(F.lit(fill).cast("long"), length)), 1, length)


def pad_mask(ids: Column, length: int = 800, fill: int = 0) -> Column:
    """1 where :func:`pad` filled or the id is unknown, else 0."""
    return F.transform(pad(ids, length, fill), lambda x: F.when(x == fill, 1).otherwise(0))
