"""Text as columns: white space, cleaning, hashes, shingles, tokens."""

from __future__ import annotations

import html
import re
import unicodedata

import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed
from ..config import DEFAULT, Config

#: White space that is not a single space already.
WHITE = r"(?U)\s{2,}|[\s&&[^ ]]"
#: Characters that NFKC leaves alone whatever stands beside them; a text of these alone needs no normalisation.
STABLE = r"[^\x00-\x9F\x{A1}-\x{A7}\x{A9}\x{AB}-\x{AE}\x{B0}\x{B1}\x{B6}\x{B7}\x{BB}\x{BF}-\x{FF}]"
ENTITY = r"&[#A-Za-z]"


def trimmed(c: Column) -> Column:
    """Without white space of any kind at both ends; only texts that have more there than spaces are searched."""
    of = lambda x: F.when(F.concat(F.substring(x, 1, 1), F.substring(x, -1, 1)).rlike(r"(?U)\s"), F.regexp_replace(x, r"(?U)^\s+|\s+$", "")).otherwise(x)
    return F.transform(F.array(F.trim(c)), of)[0]


def collapsed(c: Column) -> Column:
    """White space runs become one space; none is left at the ends."""
    return F.trim(F.regexp_replace(c, WHITE, " "))


def safe_cell(c: Column) -> Column:
    """Null, NaN and blank become ''; else the trimmed text."""
    t = F.coalesce(c.cast("string"), F.lit(""))
    return F.when(t == "NaN", "").otherwise(trimmed(t))


def _decoded(texts: pa.Array) -> pa.Array:
    return pa.array([None if t is None else unicodedata.normalize("NFKC", html.unescape(re.sub(r"<[^>]+>", " ", t))) for t in texts.to_pylist()], pa.string())


def _replaced(t: Column, pattern: str, signs: list[str]) -> Column:
    """Matches become a space; only texts that have one of the signs, without which nothing matches, are searched."""

    def of(x: Column) -> Column:
        some = x.contains(signs[0])
        for sign in signs[1:]:
            some = some | x.contains(sign)
        return F.when(some, F.regexp_replace(x, pattern, " ")).otherwise(x)

    # the text is bound once by an array of one, so that it is not computed again for each use
    return F.transform(F.array(t), of)[0]


def clean(c: Column, rare: bool = True) -> Column:
    """Plain prose: no markup, addresses, reference marks, trivial parentheses or odd symbols; null becomes ''.

    rare: texts with character references or characters that NFKC may change pass a Python function; all others
    reach it as nulls, so nothing of them leaves the JVM.
    """
    t = F.coalesce(c, F.lit(""))
    t = _replaced(t, r"(?is)<!--.*?-->|<(script|style|template)\b.*?</\1\s*>", ["<"])
    if rare:
        # STABLE is slow to match, so what it sees is the text without ASCII
        odd = lambda x: F.when((x.contains("&") & x.rlike(ENTITY)) | F.regexp_replace(x, r"[\x00-\x7F]+", "").rlike(STABLE), x)
        t = F.transform(F.array(t), lambda x: F.struct(x.alias("x"), odd(x).alias("odd")))[0]
        t = F.coalesce(F.arrow_udf(_decoded, "string")(t["odd"]), t["x"])
    for pattern, signs in ((fixed.TAG, "<"), (fixed.URL, "://|www."), (fixed.REFERENCE, "["), (fixed.TRIVIAL_PARENTHESIS, "(")):
        t = _replaced(t, pattern, signs.split("|"))
    return collapsed(F.regexp_replace(t, "(?U)" + fixed.NOISE + "+", " "))


def model_text(title: Column, body: Column, cfg: Config = DEFAULT) -> Column:
    """What the classifier sees: the body, behind the title if the settings say so."""
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(title, F.lit(". "), body)).otherwise(body) if cfg.nlp.title_in_text else body


def analysis_text(title: Column, body: Column) -> Column:
    """What entities and keywords are taken from: title and body."""
    return F.when(F.coalesce(title, F.lit("")) != "", F.concat(title, F.lit(". "), body)).otherwise(body)


def canonical_hash(c: Column) -> Column:
    """SHA-256 of the text in lower case with collapsed white space."""
    return F.sha2(collapsed(F.lower(c)), 256)


def short_id(c: Column, external: Column | None = None) -> Column:
    own = F.substring(F.sha1(c), 1, 16)
    return own if external is None else F.coalesce(external, own)


def words(c: Column) -> Column:
    """Split at white space; '' gives no words."""
    return F.filter(F.split(collapsed(c), " "), lambda w: w != "")


def shingles(c: Column, n: int = DEFAULT.validation.shingle) -> Column:
    """The set of n-word windows in lower case; a shorter text is one shingle."""
    of = lambda w: F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))
    # the words are bound once; an expression inside a lambda is evaluated for every element
    return F.array_distinct(F.transform(F.array(words(F.lower(c))), of)[0])


def jaccard(a: Column, b: Column) -> Column:
    """Intersection over union of two arrays as sets; 0 where both are empty."""
    both = F.size(F.array_union(a, b))
    return F.when(both == 0, 0.0).otherwise(F.size(F.array_intersect(a, b)) / both)


def tokens(c: Column) -> Column:
    """Lower-case words of two or more letters, digits and underscores."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}_]{2,}"), F.lit(0))


def ngrams(t: Column, low: int, high: int) -> Column:
    """All n-grams of an array, joined by spaces."""
    of = lambda n: F.when(F.size(t) >= n, F.transform(F.sequence(F.lit(1), F.size(t) - n + 1), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))
    parts = [t if n == 1 else of(n) for n in range(low, high + 1)]
    return F.concat(*parts) if len(parts) > 1 else parts[0]


def without_term(c: Column, term: Column) -> Column:
    """Every occurrence of a literal term, in any case, becomes a space."""
    return F.regexp_replace(c, F.concat(F.lit("(?iu)"), F.regexp_replace(term, r"([\\.\[\]{}()*+?^$|#&~\-])", r"\\$1")), F.lit(" "))


def canonical_case(c: Column, terms: list[str] = fixed.TECHNOLOGIES) -> Column:
    """Dictionary capitals where the lower-case text is a term; the dictionary is a literal of fixed size."""
    pairs = F.create_map(*[F.lit(x) for t in terms for x in (t.lower(), t)])
    return F.coalesce(F.try_element_at(pairs, F.lower(c)), c)
