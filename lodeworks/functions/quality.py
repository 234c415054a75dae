"""Quality scores of chunks and answers, as column functions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodeworks.functions.text import SPACE, fence, sentences, strip, word_count, words

# Fixed values.
WEIGHTS = {"length": 0.2, "language": 0.15, "readability": 0.25, "completeness": 0.2, "uniqueness": 0.2}
ENGLISH = ("the", "and", "a", "to", "of", "in", "that", "is", "for", "with")
GIBBERISH = (r"[a-zA-Z]{20,}", r"(?U)(\w)\1{5,}", r"[0-9]{10,}", r"(?U)[^a-zA-Z0-9\s\x1c-\x1f\.,!?;:-]{5,}")
NOISE = (
    "cookie.*policy",
    "privacy.*policy",
    "terms.*conditions",
    r"copyright.*\d{4}",
    "all.*rights.*reserved",
    "subscribe.*newsletter",
    "follow.*us.*on",
    "click.*here.*to",
    "back.*to.*top",
    "skip.*to.*content",
    "javascript.*disabled",
    "enable.*javascript",
)
TRUNCATED = ("...", "…", "Read more", "Continue reading")
HARMLESS = ("non_english_content", "duplicate_content", "similar_content")
HEDGES = ("i don't know", "not sure", "maybe", "possibly", "i think", "i believe", "probably")
RELEVANT = ("our", "we", "company", "services", "team")
METADATA_FIELDS = ("page_title", "page_type", "content_type", "language", "timestamp")
# End of fixed values.


def present(*issues: Column) -> Column:
    return F.array_compact(F.array(*issues))


def length_score(c: Column, least: int = 100, most: int = 5000, least_words: int = 20) -> Column:
    return _length_score(F.length(strip(c)), word_count(c), least, most, least_words)


def _length_score(n: Column, w: Column, least: int, most: int, least_words: int) -> Column:
    return F.when(n < least, 0.0).when(n > most, 0.5).when(w < least_words, 0.3).when(n <= 1000, 1.0).when(n <= 2000, 0.9).otherwise(0.8)


def _length_issue(n: Column, w: Column, least: int, most: int, least_words: int) -> Column:
    say = lambda name, value, sign, bound: F.concat(F.lit(f"{name} ("), value.cast("string"), F.lit(f" {sign} {bound})"))
    return F.when(n < least, say("text_too_short", n, "<", least)).when(n > most, say("text_too_long", n, ">", most)).when(w < least_words, say("insufficient_words", w, "<", least_words))


def _lower(c: Column) -> Column:
    """Lower case letter by letter: a dotted capital I and a Sigma at a word's end are as elsewhere."""
    return F.lower(F.replace(F.replace(c, F.lit("İ"), F.lit("i")), F.lit("Σ"), F.lit("σ")))


def _is_english(low: Column) -> Column:
    return sum((F.contains(low, F.lit(w)).cast("int") for w in ENGLISH), F.lit(0)) >= 2


def _ascii_share(c: Column, of_empty: float = 1.0) -> Column:
    return F.when(F.length(c) > 0, F.length(F.regexp_replace(c, r"[^\x00-\x7F]+", "")) / F.length(c)).when(F.length(c) == 0, of_empty).otherwise(F.lit(1.0))


def language_score(c: Column, language: Column) -> Column:
    return _language_score(_is_english(_lower(c)), _ascii_share(c), language)


def _language_score(english: Column, ascii_share: Column, language: Column) -> Column:
    return F.when(english, 1.0).when(language != "en", 0.2).when(ascii_share < 0.8, 0.5).otherwise(1.0)


def _language_issue(english: Column, ascii_share: Column, language: Column) -> Column:
    return F.when(english, F.lit(None)).when(language != "en", F.concat(F.lit("non_english_content ("), language, F.lit(")"))).when(ascii_share < 0.8, F.lit("excessive_non_ascii_characters"))


def _gibberish(c: Column) -> Column:
    """Whether a pattern is in a text; the run of letters is tried where letters begin, as a run has one beginning."""
    found = c.rlike("(?<![a-zA-Z])" + GIBBERISH[0])
    for p in GIBBERISH[1:]:
        found = found | c.rlike(p)
    return found


def _improper(c: Column, parts: Column) -> Column:
    """Whether a long text has no sentence: no part between sentence ends with a blank inside and more than ten characters."""
    return ~F.exists(parts, lambda s: (F.length(s) > 10) & (F.length(strip(s)) > 10) & F.contains(strip(s), F.lit(" "))) & (F.length(c) > 100)


def _marks(c: Column) -> Column:
    return F.length(c) - F.length(F.translate(c, ".!?,:;", ""))


def _noisy(c: Column, low: Column) -> Column:
    """Whether more than two patterns are in a text, on one line each; each is tried only where its first word is.

    Lines end at line feeds only, and a long s and the Kelvin sign count as their letters.
    """
    low = F.replace(low, F.lit("ſ"), F.lit("s"))
    found = lambda p: c.rlike("(?id)" + p.replace("s", "[sſ]").replace("k", "[k\u212a]"))
    return sum((F.when(F.contains(low, F.lit(p.split(".*")[0])), found(p)).otherwise(False).cast("int") for p in NOISE), F.lit(0)) > 2


def _cut(s: Column) -> Column:
    found = F.lit(False)
    for end in TRUNCATED:
        found = found | s.endswith(end)
    return found


def _product(*factors: tuple[Column, float]) -> Column:
    out = F.lit(1.0)
    for bad, by in factors:
        out = out * F.when(bad, by).otherwise(1.0)
    return out


def _readability(gibberish: Column, improper: Column, pointed: Column) -> Column:
    return _product((gibberish, 0.5), (improper, 0.3), (pointed, 0.7))


def _completeness(noisy: Column, cut: Column, thin: Column) -> Column:
    return _product((noisy, 0.5), (cut, 0.8), (thin, 0.6))


def _share_above(part: Column, n: Column, bound: float) -> Column:
    return (n > 0) & (part / F.greatest(n, F.lit(1)) > bound)


def _share_below(part: Column, n: Column, bound: float) -> Column:
    return (n > 0) & (part / F.greatest(n, F.lit(1)) < bound)


def readability_score(c: Column) -> Column:
    return _readability(_gibberish(c), _improper(c, F.split(c, r"[.!?]+")), _share_above(_marks(c), word_count(c), 0.5))


def completeness_score(c: Column) -> Column:
    found = words(c)
    return _completeness(_noisy(c, _lower(c)), _cut(strip(c)), _share_below(F.size(F.filter(found, lambda w: F.length(w) > 3)), F.size(found), 0.5))


def measured(df: DataFrame, text: str, language: Column, least: int = 100, most: int = 5000, least_words: int = 20, ascii_of_empty: float = 1.0) -> DataFrame:
    """df with length_score, language_score, readability_score, completeness_score, issues and content_hash of a text column.

    Each sign of a text is found once and serves the scores and the issues alike. The words, joined by one blank and
    lower-cased, serve the searches for words and the hash; a null text has no hash. ascii_of_empty is an empty text's share
    of ASCII characters.
    """
    c, q = F.col(text), lambda name: F.col(f"__q_{name}")
    rows = fence(df, __q_s=strip(c), __q_language=language)
    rows = fence(rows, __q_words=F.when(q("s") == "", F.array().cast("array<string>")).otherwise(F.split(q("s"), SPACE + "+")), __q_parts=F.split(c, r"[.!?]+"))
    rows = fence(rows, __q_low=_lower(F.array_join(q("words"), " ")))
    rows = fence(
        rows, __q_hash=F.md5(q("low").cast("binary")), __q_n=F.length(q("s")), __q_w=F.size(q("words")), __q_long=F.size(F.filter(q("words"), lambda w: F.length(w) > 3)), __q_marks=_marks(c), __q_english=_is_english(q("low")), __q_ascii=_ascii_share(c, ascii_of_empty),
        __q_gibberish=_gibberish(c), __q_improper=_improper(c, q("parts")), __q_noisy=_noisy(c, q("low")), __q_cut=_cut(q("s")),
    )
    pointed, thin = _share_above(q("marks"), q("w"), 0.5), _share_below(q("long"), q("w"), 0.5)
    named = ((q("gibberish"), "gibberish_content_detected"), (q("improper"), "no_proper_sentences"), (pointed, "excessive_punctuation"), (q("noisy"), "excessive_boilerplate_content"), (q("cut"), "truncated_content"), (thin, "low_meaningful_content_ratio"))
    issues = present(_length_issue(q("n"), q("w"), least, most, least_words), _language_issue(q("english"), q("ascii"), q("language")), *(F.when(bad, F.lit(name)) for bad, name in named))
    out = fence(
        rows, length_score=_length_score(q("n"), q("w"), least, most, least_words), language_score=_language_score(q("english"), q("ascii"), q("language")),
        readability_score=_readability(q("gibberish"), q("improper"), pointed), completeness_score=_completeness(q("noisy"), q("cut"), thin), issues=issues, content_hash=q("hash"),
    )
    return out.drop(*(x for x in out.columns if x.startswith("__q_")))


def overall(length: Column, language: Column, readability: Column, completeness: Column, uniqueness: Column) -> Column:
    parts = dict(zip(WEIGHTS, (length, language, readability, completeness, uniqueness), strict=True))
    first, *rest = (parts[k] * w for k, w in WEIGHTS.items())
    return sum(rest, first)


def passed(score: Column, issues: Column, threshold: float = 0.7) -> Column:
    """A score from the threshold on, and no issue but those that harm nobody."""
    harmless = lambda i: i.startswith(HARMLESS[0]) | i.startswith(HARMLESS[1]) | i.startswith(HARMLESS[2])
    return (score >= threshold) & ~F.exists(issues, lambda i: ~harmless(i))


def sanity(c: Column, least: int = 50) -> Column:
    """A chunk's sanity: whether it is long enough, its score, and the ratios behind it."""
    tokens = words(F.lower(c))
    n, s = F.size(tokens), F.size(sentences(c))
    unique = F.size(F.array_distinct(tokens)) / F.greatest(n, F.lit(1))
    letters = F.length(F.regexp_replace(c, r"[^\p{L}]", "")) / F.greatest(F.length(c), F.lit(1))
    average = n / F.greatest(s, F.lit(1))
    off = lambda bad, by: F.when(bad, by).otherwise(0.0)
    score = 1.0 - off(F.length(c) < least, 0.2) - off((n > 0) & (unique < 0.2), 0.1) - off(letters < 0.3, 0.1) - off(s == 0, 0.1) - off(average > 50, 0.1)
    return F.struct((F.length(c) >= least).alias("is_valid"), F.greatest(F.lit(0.0), score).alias("score"), unique.alias("unique_ratio"), letters.alias("alpha_ratio"), average.alias("avg_sentence_length"))


def sanity_of(t: str, n_sentences: int, least: int = 50) -> dict[str, float]:
    """sanity's score and ratios of a string with so many sentences, in a worker."""
    tokens = t.lower().split()
    unique, letters, average = len(set(tokens)) / max(len(tokens), 1), sum(map(str.isalpha, t)) / max(len(t), 1), len(tokens) / max(n_sentences, 1)
    off = ((len(t) < least, 0.2), (bool(tokens) and unique < 0.2, 0.1), (letters < 0.3, 0.1), (n_sentences == 0, 0.1), (average > 50, 0.1))
    score = 1.0
    for bad, by in off:
        score -= by if bad else 0.0
    return {"score": max(0.0, score), "unique_ratio": unique, "alpha_ratio": letters, "avg_sentence_length": average}


def missing_metadata(chunk_id: Column, source_url: Column, index: Column, chars: Column, n_words: Column, metadata: Column) -> Column:
    """Names of required fields that a chunk lacks. Invalid counts are named twice, for the field and for the check."""
    blank = lambda c: F.coalesce(strip(c) == "", F.lit(True))
    none = (F.when(chars <= 0, F.lit("char_count (invalid)")), F.when(n_words <= 0, F.lit("word_count (invalid)")))
    own = (F.when(blank(chunk_id), F.lit("id")), F.when(blank(source_url), F.lit("source_url")), F.when(index < 0, F.lit("chunk_index (invalid)")))
    return present(*own, *none, *(F.when(blank(F.try_element_at(metadata, F.lit(k))), F.lit(f"metadata.{k}")) for k in METADATA_FIELDS), *none)


def answer_quality(answer: Column, most: int = 2000, brand: tuple[str, ...] = ()) -> Column:
    """Score and issues of an answer: length, hedging and relevance to the company."""
    low, n = F.lower(answer), F.length(answer)
    hedges = sum((F.contains(low, F.lit(p)).cast("int") for p in HEDGES), F.lit(0))
    relevant = F.lit(False)
    for w in (*brand, *RELEVANT):
        relevant = relevant | F.contains(low, F.lit(w))
    checks = ((n < 10, 0.3, "Response too short"), (n > most, 0.2, "Response too long"), (hedges > 2, 0.2, "Too many uncertain phrases"), (~relevant, 0.3, "No company context in response"))
    score = F.lit(0.8)
    for bad, by, _ in checks:
        score = score - F.when(bad, by).otherwise(0.0)
    return F.struct(score.alias("score"), (score > 0.3).alias("is_valid"), present(*(F.when(bad, F.lit(name)) for bad, _, name in checks)).alias("issues"))
