"""Content type, readability, sentiment and domain terms of a text, as column functions."""

from __future__ import annotations

import re
import string
from bisect import bisect_left
from collections import Counter
from collections.abc import Callable, Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodeworks.functions.text import fence, word_count

# Vocabularies and patterns that decide results.
TECH_PATTERNS = (
    r"\b(?:API|SDK|UI|UX|AI|ML|SaaS|PaaS|IaaS|DevOps|CI/CD)\b",
    r"\b(?:JavaScript|Python|React|Node\.js|Docker|Kubernetes|AWS|Azure|GCP)\b",
    r"\b(?:database|server|cloud|microservices|architecture|framework|library)\b",
    r"\b(?:frontend|backend|fullstack|mobile|web|application|software|platform)\b",
)
BUSINESS_PATTERNS = (
    r"\b(?:startup|entrepreneur|business|company|enterprise|corporation)\b",
    r"\b(?:revenue|profit|ROI|KPI|metrics|analytics|growth|scale|scaling)\b",
    r"\b(?:market|customer|client|user|stakeholder|investor|funding)\b",
    r"\b(?:strategy|planning|execution|management|leadership|team|collaboration)\b",
    r"\b(?:product|service|solution|offering|portfolio|brand|marketing)\b",
)
CONTENT_TYPES = (
    ("service_description", r"\b(?:we offer|our services|we provide|we specialize|we help)\b"),
    ("team_bio", r"\b(?:years of experience|background in|expertise in|specializes in|founded|ceo|cto|developer)\b"),
    ("case_study", r"\b(?:case study|project|client|challenge|solution|results|outcome)\b"),
    ("blog_post", r"\b(?:in this post|today we|recently|update|announcement|insights)\b"),
    ("technical_doc", r"\b(?:documentation|guide|tutorial|how to|step by step|implementation)\b"),
    ("about_page", r"\b(?:about us|our story|our mission|our vision|who we are|founded in)\b"),
)
URL_TYPES = (
    ("about_page", ("/about",)),
    ("team_bio", ("/team", "/people")),
    ("service_description", ("/services", "/solutions")),
    ("blog_post", ("/blog", "/news", "/insights")),
    ("case_study", ("/case-study", "/portfolio")),
    ("technical_doc", ("/docs", "/documentation")),
)
POSITIVE = (
    "excellent outstanding amazing great fantastic wonderful successful innovative cutting-edge leading expert professional "
    "reliable trusted proven effective efficient optimized scalable robust secure fast easy simple powerful"
).split()
NEGATIVE = "difficult challenging complex complicated hard tough problem issue bug error fail failure broken slow expensive costly limited restricted outdated".split()
# fmt: off
TECH_TERMS = [
    "python", "javascript", "java", "c++", "c#", "ruby", "php", "go", "rust", "swift", "kotlin", "typescript", "scala", "r", "matlab", "sql",
    "react", "angular", "vue", "django", "flask", "express", "spring", "laravel", "rails", "nextjs", "nuxt", "gatsby", "svelte", "ember",
    "docker", "kubernetes", "jenkins", "git", "github", "gitlab", "bitbucket", "jira", "confluence", "slack", "teams", "zoom", "figma", "sketch",
    "aws", "azure", "gcp", "google cloud", "amazon web services", "microsoft azure", "heroku", "digitalocean", "linode", "vultr",
]
# fmt: on
BUSINESS_TERMS = (
    "ceo cto cfo coo founder co-founder director manager lead senior junior developer engineer designer analyst "
    "fintech healthtech edtech proptech insurtech regtech martech adtech cleantech biotech nanotech "
    "saas paas iaas b2b b2c b2b2c marketplace platform subscription freemium enterprise startup scaleup"
).split()
# End of fixed values.

STOPWORDS = (
    "a about above after again against all am an and any are as at be because been before being below between both but by can did do does doing "
    "down during each few for from further had has have having he her here hers him his how i if in into is it its itself just me more most my no nor "
    "not now of off on once only or other our ours out over own same she should so some such than that the their theirs them then there these they this "
    "those through to too under until up very was we were what when where which while who whom why will with you your yours"
).split()


VOWELS = re.compile("[aeiouy]+")


def contains_any(c: Column, parts) -> Column:
    out = F.lit(False)
    for p in parts:
        out = out | F.contains(c, F.lit(p))
    return out


def content_type(text: Column, url: Column) -> Column:
    """By address, else by the first pattern found, else by length and a few words."""
    u, low = F.lower(F.coalesce(url, F.lit(""))), F.lower(text)
    out = F
    for name, parts in URL_TYPES:
        out = out.when(contains_any(u, parts), name)
    for name, pattern in CONTENT_TYPES:
        out = out.when(low.rlike(pattern), name)
    out = out.when((F.length(text) > 2000) & F.contains(F.substring(low, 1, 200), F.lit("we")), "service_description")
    return out.when(F.contains(low, F.lit("experience")) & (F.length(text) < 1000), "team_bio").otherwise("general_content")


def _syllables(word: str) -> int:
    """Vowel groups of a word without punctuation at its ends, less a silent e; at least one, none for no word."""
    w = word.lower().strip(string.punctuation)
    n = len(VOWELS.findall(w))
    return max(1, n - (w.endswith("e") and n > 1)) if w else 0


@F.pandas_udf(T.IntegerType())
def syllables(words: pd.Series) -> pd.Series:
    return words.fillna("").map(_syllables)


def _totals() -> Callable[[Column], Column]:
    """The syllables of all words of a text; words recur, so each is counted once while it is held."""

    @F.pandas_udf(T.LongType())
    def run(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        count = lru_cache(200_000)(_syllables)
        for texts in parts:
            yield texts.map(lambda t: sum(map(count, t.split())) if t else 0)

    return run


def readability(c: Column) -> Column:
    """Reading ease from sentence length and syllables, between 0 and 100; 0 without sentences."""
    stops, n, total = F.regexp_count(c, F.lit("[.!?]+")), word_count(c), _totals()(c)
    ease = F.lit(206.835) - F.lit(1.015) * (n / F.greatest(stops, F.lit(1))) - F.lit(84.6) * (total / F.greatest(n, F.lit(1)))
    return F.when((F.coalesce(stops, F.lit(0)) == 0) | (n == 0), 0.0).otherwise(F.greatest(F.lit(0.0), F.least(F.lit(100.0), ease)))


def _lone_words(c: Column, least: int = 1) -> Column:
    return F.regexp_extract_all(F.lower(c), F.lit(rf"(?<![\p{{L}}\p{{N}}_])[a-z]{{{least},}}(?![\p{{L}}\p{{N}}_])"), F.lit(0))


def sentiment(c: Column) -> Column:
    found = _lone_words(c)
    hits = lambda lexicon: F.size(F.array_intersect(found, F.array(*map(F.lit, lexicon))))
    p, n = hits(POSITIVE), hits(NEGATIVE)
    return F.struct(p.alias("positive_indicators"), n.alias("negative_indicators"), (p / F.greatest(n, F.lit(1))).alias("sentiment_ratio"))


#: A pattern of words between word boundaries.
LISTED = re.compile(r"\\b\(\?:([\w\\./|]+)\)\\b")


def _hits(c: Column, low: Column, patterns) -> list[Column]:
    """Lists of what patterns find in a text, in lower case. Of a pattern that lists words each word is looked for as it
    is, and at word boundaries only where the text has it at all; no such word is a part of another's place."""
    out, words = [], []
    for p in patterns:
        if listed := LISTED.fullmatch(p):
            words += listed[1].split("|")
        else:
            out.append(F.transform(F.regexp_extract_all(c, F.lit("(?i)" + p), F.lit(0)), F.lower))
    plain = {w: w.replace("\\", "").lower() for w in words}
    return [*out, F.array_compact(F.array(*(F.when(F.contains(low, F.lit(plain[w])) & c.rlike(rf"(?i)\b{w}\b"), plain[w]) for w in words)))] if words else out


def terms(c: Column, patterns, vocabulary) -> Column:
    """Pattern hits and vocabulary entries that occur anywhere in the text, sorted."""

    def found(low: Column) -> Column:
        held = F.array_compact(F.array(*(F.when(F.contains(low, F.lit(v)), v) for v in vocabulary)))
        return F.sort_array(F.array_distinct(F.concat(*_hits(c, low, patterns), held)))

    # The lambda's variable is worked out once, where a column would be for each word.
    return F.when(c.isNotNull(), F.element_at(F.transform(F.array(F.lower(c)), found), 1))


def technical_terms(c: Column) -> Column:
    return terms(c, TECH_PATTERNS, TECH_TERMS)


def business_terms(c: Column) -> Column:
    return terms(c, BUSINESS_PATTERNS, BUSINESS_TERMS)


LONE = re.compile(r"(?<!\w)[a-z]{3,}(?!\w)")
TITLES, UPPERS = re.compile(r"[A-Z][a-z]*"), re.compile(r"[A-Z]+")


def _capitalised(text: str) -> Callable[[str], bool]:
    """Whether a text holds a word with a capital first, or in capitals, anywhere; by its capitals' runs alone."""
    titles = sorted({t.lower() for t in TITLES.findall(text)})
    uppers = " ".join(sorted(set(UPPERS.findall(text))))

    def shown(word: str) -> bool:
        k = bisect_left(titles, word)
        return k < len(titles) and titles[k].startswith(word) or word.upper() in uppers

    return shown


def _top_words(text: str | None, most: int, stop: frozenset[str], domain: frozenset[str]) -> list[tuple[str, float]]:
    counts = Counter(w for w in LONE.findall((text or "").lower()) if w not in stop)
    shown = _capitalised(text) if counts else None
    scores = ((n * (len(w) / 5.0) * (1.5 if w in domain else 1.0), w) for w, n in counts.items())
    # A counter keeps the order of first places, and so do a stable sort's ties.
    ranked = sorted(((w, s * (1.2 if shown(w) else 1.0)) for s, w in scores), key=lambda x: -x[1])
    return ranked[:most]


def keywords(docs: DataFrame, id_col: str, text_col: str, most: int = 10, stopwords: list[str] | None = None) -> DataFrame:
    """(id, rank, keyword, score): words by count and length, domain and capitalised ones ahead, ties by first place.

    Each text is counted where it is read, in one pass over it, and leaves as its first few words: nothing is shuffled.
    """
    stop = frozenset(STOPWORDS if stopwords is None else stopwords)
    domain = frozenset(t for t in (*TECH_TERMS, *BUSINESS_TERMS) if t.isalpha() and len(t) > 2)
    out = T.StructType([T.StructField(id_col, docs.schema[id_col].dataType), T.StructField("rank", T.IntegerType()), T.StructField("keyword", T.StringType()), T.StructField("score", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [(k, rank, w, s) for k, t in enumerate(batch.column(1)) for rank, (w, s) in enumerate(_top_words(t.as_py(), most, stop, domain), 1)]
            at, ranks, names, scores = zip(*found, strict=True) if found else ((),) * 4
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at, pa.int64())), pa.array(ranks, pa.int32()), pa.array(names, pa.string()), pa.array(scores, pa.float64())], out.names)

    return docs.select(id_col, text_col).mapInArrow(run, out)


def top_keywords(c: Column, most: int = 10, stopwords: list[str] | None = None) -> Column:
    """The same words as a column of the row they are from, best first."""
    stop = frozenset(STOPWORDS if stopwords is None else stopwords)
    domain = frozenset(t for t in (*TECH_TERMS, *BUSINESS_TERMS) if t.isalpha() and len(t) > 2)

    @F.pandas_udf("array<string>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: [w for w, _ in _top_words(t, most, stop, domain)])

    return run(c)


#: Frequent short words of a language, by which its texts are told from others'.
PROFILES = {
    "en": "the and of to in is that for with was are this it you".split(),
    "de": "der die und das ist nicht ein eine mit den von zu auf für".split(),
    "fr": "le la les et des est une pour dans que qui sur pas avec".split(),
    "es": "el los las y del es una para por que con se no en".split(),
}


def language_of(text: str | None, profiles: dict[str, list[str]]) -> tuple[str, float]:
    """The profile with most words in a text, first in the alphabet of equals, and its share of all profiles' hits."""
    counts = Counter(re.findall(r"[^\W\d_]+", (text or "").lower()))
    hits = {k: sum(counts[w] for w in own) for k, own in sorted(profiles.items())}
    best, total = max(hits, key=hits.__getitem__), sum(hits.values())
    return (best, round(hits[best] / total, 6)) if total else ("en", 0.5)


def detect_language(c: Column, profiles: dict[str, list[str]] | None = None) -> Column:
    """Language and confidence by profiles of frequent words; without any hit English at one half, as without a detector.

    Another detector plugs in as another column of this type.
    """

    @F.pandas_udf("language string, confidence double")
    def run(texts: pd.Series) -> pd.DataFrame:
        return pd.DataFrame([language_of(t, profiles or PROFILES) for t in texts], columns=["language", "confidence"])

    return run(c)


SPANS = re.compile(r"(?<=[^\W\d_A-Z] )([A-Z]\w+(?: [A-Z]\w+)*)")


def entities_of(text: str | None, most: int) -> list[dict[str, str]]:
    """Spans of capitalised words behind a word, each once, in order."""
    return [{"text": s, "type": "PERSON_OR_ORG" if " " in s else "NAME"} for s in dict.fromkeys(SPANS.findall((text or "")[:most]))]


def named_entities(c: Column, most: int = 1000, recognise: Callable[[str | None, int], list[dict[str, str]]] | None = None) -> Column:
    """Entities with their types in a text's first characters, as a feature; by capitals, or by a given recogniser."""

    @F.pandas_udf("array<struct<text: string, type: string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: (recognise or entities_of)(t, most))

    return run(c)


#: Tags of closed classes, and of endings, the first that fits.
CLOSED = {"DT": "the a an this that".split(), "CC": "and or but".split(), "IN": "of in to for with on at by from".split(), "PRP": "i you he she it we they".split()}
ENDINGS = (("ly", "RB"), ("ing", "VBG"), ("ed", "VBD"), ("ion", "NN"), ("ness", "NN"), ("ment", "NN"), ("ous", "JJ"), ("ful", "JJ"), ("able", "JJ"), ("s", "NNS"))


def tags_of(text: str | None, most: int) -> list[dict[str, str]]:
    """Words with tags by class, shape and ending."""
    out = []
    for w in re.findall(r"\w+", (text or "")[:most]):
        low = w.lower()
        closed = next((tag for tag, own in CLOSED.items() if low in own), None)
        out.append({"token": w, "tag": closed or ("CD" if w.isdigit() else next((tag for end, tag in ENDINGS if low.endswith(end)), "NN"))})
    return out


def pos_tags(c: Column, most: int = 500, tag: Callable[[str | None, int], list[dict[str, str]]] | None = None) -> Column:
    """Words with tags in a text's first characters, as a feature; by simple rules, or by a given tagger."""

    @F.pandas_udf("array<struct<token: string, tag: string>>")
    def run(texts: pd.Series) -> pd.Series:
        return texts.map(lambda t: (tag or tags_of)(t, most))

    return run(c)


def describe(docs: DataFrame, text_col: str, url: Column, language: Column | None = None) -> DataFrame:
    """Each text's metadata as one struct: keywords, language, content type, entities, tags, readability, sentiment, terms.

    All of it is made of the row alone: ids may repeat or be null, and nothing is shuffled. Another detector's column, such
    as language.detect, can stand for the language.
    """
    c = F.col(text_col)
    made = F.struct(
        top_keywords(c).alias("keywords"), (detect_language(c) if language is None else language).alias("language"), content_type(c, url).alias("content_type"),
        named_entities(c).alias("named_entities"), pos_tags(c).alias("pos_tags"), readability(c).alias("readability"), sentiment(c).alias("sentiment"), technical_terms(c).alias("technical_terms"), business_terms(c).alias("business_terms"),
    )
    return fence(docs, metadata=made)
