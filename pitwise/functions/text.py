"""Names, titles and keys as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Accented letters and what they fold to.
ACCENTED = "àáâãäåçèéêëìíîïñòóôõöøùúûüýÿ"
FOLDED = "aaaaaaceeeeiiiinoooooouuuuyy"
#: Words of an event title that name no place.
NO_PLACE = ("atp", "challenger", "ch", "m15", "m25", "itf", "men", "mens", "tennis", "open", "championships", "grand", "slam", "masters", "1000", "250", "500", "tour", "singles", "qualifying", "qualifiers", "qualies", "md", "main", "draw")
#: Words of a part of a title that only tells the tour.
TOUR_WORDS = ("challenger", "itf", "men", "mens", "s", "single", "singles")
STOP_WORDS = ("open", "the", "de", "of", "cup", "championships", "international")


def folded(text: Column) -> Column:
    """Lower case, without accents."""
    return F.translate(F.lower(text), ACCENTED, FOLDED)


def name_key(text: Column) -> Column:
    """Letters alone, folded."""
    return F.regexp_replace(folded(text), "[^a-z]", "")


def normalised(text: Column) -> Column:
    """Folded, other signs as spaces, spaces squeezed."""
    return F.trim(F.regexp_replace(F.regexp_replace(folded(text), "[^a-z0-9 ]", " "), " +", " "))


def title_key(text: Column) -> Column:
    """An event title without trailing counts such as ``(12)``."""
    return F.trim(F.regexp_replace(text, r"(\s*\([0-9]+\))+\s*$", ""))


def place_signature(title: Column) -> Column:
    """The words of an event title that name its place, in order."""
    text = F.trim(folded(title))
    # a part between dashes that only tells the tour goes, and so does a number in brackets at the end
    words_of = lambda part: F.regexp_extract_all(part, F.lit("[a-z0-9]+"), F.lit(0))
    parts = F.split(F.regexp_replace(F.rtrim(text), r"\(\d+\)$", ""), "-")
    kept = F.filter(F.transform(parts, words_of), lambda ws: F.exists(ws, lambda w: ~w.isin(*TOUR_WORDS)))
    words = F.flatten(kept)
    return F.array_join(F.filter(words, lambda w: ~w.isin(*NO_PLACE) & ~w.rlike("^[0-9]+$")), " ")


def tokens(text: Column) -> Column:
    """Distinct words of a title, stop words aside."""
    return F.array_except(F.array_distinct(F.regexp_extract_all(folded(text), F.lit("[a-z0-9]+"), F.lit(0))), F.array(*map(F.lit, STOP_WORDS)))


def surname(text: Column) -> Column:
    return F.element_at(F.split(F.trim(text), " +"), -1)


def jaccard(a: Column, b: Column) -> Column:
    """Shared over all tokens; 0 for two empty sets."""
    return F.coalesce(F.try_divide(F.size(F.array_intersect(a, b)).cast("double"), F.size(F.array_union(a, b))), F.lit(0.0))


def names_alike(a: Column, b: Column) -> Column:
    """Loose name equality: the same letters, one token set within the other, or equal surnames with equal initials."""
    ta, tb = F.split(normalised(a), " "), F.split(normalised(b), " ")
    within = (F.size(F.array_except(ta, tb)) == 0) | (F.size(F.array_except(tb, ta)) == 0)
    initial = (F.element_at(ta, -1) == F.element_at(tb, -1)) & (F.substring(ta[0], 1, 1) == F.substring(tb[0], 1, 1))
    return (name_key(a) == name_key(b)) | within | initial


def stable_uid(*parts: Column) -> Column:
    """The first 20 hex digits of the SHA-1 of the normalised parts."""
    clean = [F.coalesce(F.trim(F.lower(p.cast("string"))), F.lit("")) for p in parts]
    return F.substring(F.sha1(F.concat_ws("||", *clean)), 1, 20)


def record_sha(*columns: str) -> Column:
    """SHA-256 of a record's canonical text: name=value for the named columns in name order, nulls as empty."""
    return F.sha2(F.concat_ws("\x1f", *[F.concat(F.lit(c + "="), F.coalesce(F.col(c).cast("string"), F.lit(""))) for c in sorted(columns)]), 256)


def seed_of(text: Column) -> Column:
    """A whole number from the first eight hex digits of the MD5."""
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint")
