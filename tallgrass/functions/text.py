"""Text functions of columns; all of them stay inside the JVM."""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Entities that are resolved, in this order (so that &amp;lt; becomes <): fixed values.
ENTITIES = (("&nbsp;", " "), ("&amp;", "&"), ("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#39;", "'"))


#: Elements whose end (BREAKS: whose start too) begins a new line; all other tags vanish: fixed values, in alphabetical order.
BLOCKS, BREAKS = ("div", "h1", "h2", "h3", "h4", "h5", "h6", "li", "p", "tr"), ("br",)


def strip_html(html: Column) -> Column:
    """The text of a fragment of HTML: lines end where BLOCKS end and at BREAKS, sound marks vanish, entities are resolved, lines are trimmed, and of more than one empty line in a row one stays."""
    lines = F.split(html, rf"(?i)</(?:{'|'.join(BLOCKS)})>|<(?:{'|'.join(BREAKS)})\s*/?>")
    bare = F.regexp_replace(F.array_join(lines, "\n"), "<[^>]*>", "")
    for entity, character in ENTITIES:
        bare = F.replace(bare, F.lit(entity), F.lit(character))
    heard = F.regexp_replace(bare, r"\[sound:[^\]]*\]", "")
    trimmed = F.array_join(F.transform(F.split(heard, "\n"), lambda line: F.trim(line)), "\n")
    return F.trim(F.regexp_replace(trimmed, r"\n\n\n+", "\n\n"))


def cloze_text(c: Column) -> Column:
    """{{c1::answer::hint}} and [[oc1::answer::hint]] become answer."""
    plain = F.regexp_replace(c, r"(?s)\{\{c\d+::(.*?)(::.*?)?\}\}", "$1")
    return F.regexp_replace(plain, r"(?s)\[\[oc\d+::(.*?)(::[^\]]*?)?\]\]", "$1")


def media_names(html: Column) -> Column:
    """The names of the media that a fragment of HTML refers to: sounds first, then pictures, each kind in order."""
    return F.concat(F.regexp_extract_all(html, F.lit(r"\[sound:([^\]]+)\]"), 1), F.regexp_extract_all(html, F.lit(r"(?i)<img[^>]*?\bsrc\s*=\s*[\"']?([^\"'>\s]+)"), 1))


def title_words(c: Column, kept: tuple[str, ...] = ()) -> Column:
    """The words of a text with a capital first letter and small others; words in kept stay as they are."""
    capital = lambda w: F.concat(F.upper(F.left(w, F.lit(1))), F.lower(F.substr(w, F.lit(2))))
    return F.array_join(F.transform(words(c), lambda w: F.when(w.isin(*kept), w).otherwise(capital(w)) if kept else capital(w)), " ")


def tokens(c: Column, least: int = 3) -> Column:
    """Lower-cased runs of ASCII letters and digits of at least `least` characters."""
    return F.filter(F.split(F.lower(c), "[^a-z0-9]+"), lambda t: F.length(t) >= least)


def words(c: Column) -> Column:
    return F.filter(F.split(c, r"[\x20\x09-\x0D]+"), lambda w: w != "")


def bound(value: Column, body: Callable[[Column], Column]) -> Column:
    """Evaluates value once and hands it to body; inside a lambda function an expression would be evaluated for every element."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def ngrams(tokens_: Column, n: int) -> Column:
    """All runs of n tokens, joined by spaces; none if there are fewer."""

    def runs(t: Column) -> Column:
        last = F.size(t) - n
        return F.when(last >= 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(0)) + 1), lambda i: F.array_join(F.slice(t, i, n), " "))).otherwise(F.array().cast("array<string>"))

    return bound(tokens_, runs)


def char_ngrams(c: Column, n: int = 3) -> Column:
    """The distinct character n-grams of a text padded with two spaces before and one after."""
    padded = F.concat(F.lit("  "), F.lower(c), F.lit(" "))
    return F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(padded) - n + 1, F.lit(1))), lambda i: F.substr(padded, i, F.lit(n))))


def jaccard(a: Column, b: Column) -> Column:
    """Of two arrays of distinct values; 0 if both are empty."""
    both = F.size(F.array_intersect(a, b))
    union = F.size(a) + F.size(b) - both
    return F.when(union > 0, both / union).otherwise(F.lit(0.0))


def similarity(a: Column, b: Column) -> Column:
    """.55 token Jaccard + .30 cover of the smaller token set + .15 trigram Jaccard + .10 if one text holds the other; 1 at most."""
    x, y = F.array_distinct(tokens(a)), F.array_distinct(tokens(b))
    least = F.least(F.size(x), F.size(y))
    cover = F.when(least > 0, F.size(F.array_intersect(x, y)) / least).otherwise(F.lit(0.0))
    held = F.when(F.contains(F.lower(a), F.lower(b)) | F.contains(F.lower(b), F.lower(a)), F.lit(0.10)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), 0.55 * jaccard(x, y) + 0.30 * cover + 0.15 * jaccard(char_ngrams(a), char_ngrams(b)) + held)


def phrase_in(phrase: Column, text: Column, text_tokens: Column | None = None, least: float = 0.7) -> Column:
    """Whether the text holds the phrase as it is, or at least a share of its tokens; text_tokens are the text's, if they are at hand."""
    p, t = F.array_distinct(tokens(phrase)), tokens(text) if text_tokens is None else text_tokens
    return F.contains(F.lower(text), F.lower(phrase)) | ((F.size(p) > 0) & (F.size(F.array_intersect(p, t)) >= least * F.size(p)))


def phrase_counts(docs: DataFrame, doc_id: str, text_col: str, phrases: DataFrame, phrase: str, *, least: float = 0.7, block: int = 500) -> DataFrame:
    """Rows (doc_id, n): how many of the phrases (distinct) each document holds, as phrase_in says. Phrases come in blocks of about so many, which every document meets in turn.

    A text is lower-cased and split once, and phrases are compared with those of its tokens alone that some phrase of the block has.
    """
    about = F.struct(F.lower(phrase).alias("low"), F.array_distinct(tokens(F.col(phrase))).alias("k"))
    blocks = phrases.groupBy(F.pmod(F.xxhash64(phrase), F.lit(phrases.count() // block + 1)).alias("_block")).agg(F.collect_list(about).alias("_phrases"))
    blocks = blocks.select("_phrases", F.array_distinct(F.flatten("_phrases.k")).alias("_vocabulary"))
    each = docs.select(doc_id, F.lower(text_col).alias("_low"), F.array_distinct(tokens(F.col(text_col))).alias("_tokens"))
    held = lambda known: lambda p: F.contains("_low", p["low"]) | ((F.size(p["k"]) > 0) & (F.size(F.array_intersect(p["k"], known)) >= least * F.size(p["k"])))
    n = bound(F.array_intersect("_tokens", "_vocabulary"), lambda known: F.size(F.filter("_phrases", held(known))))
    return each.crossJoin(blocks).groupBy(doc_id).agg(F.sum(n).alias("n"))


def sentences(c: Column, longer_than: int = 10) -> Column:
    """Split after . ! ? and white space; sentences of at most longer_than characters go."""
    return F.filter(F.split(F.trim(c), r"(?<=[.!?])\s+"), lambda s: F.length(s) > longer_than)


#: Phrases of a text that declines: fixed values.
ABSTAINING = ("no active", "not applicable", "no relevant", "none identified", "no involvement", "no significant", "no specialty", "no findings")
#: Words that deny what follows them in a clause: fixed values.
DENYING = ("no", "not", "without", "denies", "denied", "negative for", "absence of", "absent", "ruled out", "r/o", "free of", "no evidence of", "resolution of", "resolved")


def abstains(c: Column, most: int = 12) -> Column:
    """At most `most` words, or a phrase that declines."""
    low = F.lower(c)
    return (F.size(words(c)) <= most) | reduce(lambda a, p: a | F.contains(low, F.lit(p)), ABSTAINING, F.lit(False))


def denied(phrase: Column, c: Column) -> Column:
    """Whether the phrase occurs in the text and every occurrence stands within 30 characters after a denying word of its clause; false without an occurrence."""
    parts = F.split(F.lower(c), F.concat(F.lit(r"\Q"), F.lower(phrase), F.lit(r"\E")))
    cue = r"(^|[^\w])(" + "|".join(DENYING) + r")\b[^.;:,]{0,30}$"
    # what stands before an occurrence: the text since the last one, or since the begin
    before = F.slice(parts, F.lit(1), F.greatest(F.size(parts) - 1, F.lit(0)))
    return (F.length(phrase) > 0) & (F.size(before) > 0) & F.forall(before, lambda x: F.substr(x, F.greatest(F.length(x) - 49, F.lit(1)), F.lit(50)).rlike(cue))


def icd_form(c: Column) -> Column:
    """Upper case without dots and spaces."""
    return F.upper(F.regexp_replace(c, r"[. ]", ""))
