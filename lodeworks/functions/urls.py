"""Validity, priority, classes and names of URLs, as column functions. The company's domain is a parameter."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodeworks.functions.metadata import contains_any

# Patterns and classes that decide results.
EXCLUDE = (
    r".*\.(jpg|jpeg|png|gif|bmp|svg|webp|ico|pdf|doc|docx|xls|xlsx|ppt|pptx|zip|rar|tar|gz)$",
    r".*\.(css|js|json|xml|txt|csv)$",
    r".*\.(mp3|mp4|avi|mov|wmv|flv|webm|ogg)$",
    r".*/wp-admin/.*",
    r".*/wp-content/uploads/.*",
    r".*/wp-includes/.*",
    r".*/admin/.*",
    r".*/dashboard/.*",
    r".*/login.*",
    r".*/register.*",
    r".*/checkout.*",
    r".*/cart.*",
    r".*/account.*",
    r".*/profile.*",
    r".*\?.*search.*",
    r".*\?.*filter.*",
    r".*\?.*page=.*",
    r".*\?.*sort.*",
    r".*\?.*category.*",
    r".*#.*",
    r".*\?print=.*",
    r".*\?pdf=.*",
    r".*/print/.*",
    r".*/feed/?$",
    r".*/rss/?$",
    r".*/atom/?$",
    r".*/api/.*",
    r".*/rest/.*",
    r".*\.(dev|staging|test)\..*",
    r".*/dev/.*",
    r".*/staging/.*",
    r".*/test/.*",
)
ALLOWED_PATHS = (
    "/$", "/[^/]+/?$", "/[^/]+/[^/]+/?$", "/services/", "/portfolio/", "/blog/", "/about", "/contact", "/team", "/careers",
    "/technologies/", "/industries/", "/case-studies", "/projects", "/work",
)
PRIORITIES = (
    (2, ("/services",)),
    (3, ("about", "company", "team", "leadership")),
    (4, ("portfolio", "work", "case-studies", "projects")),
    (5, ("/technologies",)),
    (6, ("/industries",)),
    (7, ("process", "methodology", "approach")),
    (8, ("careers", "jobs", "join")),
    (9, ("blog", "news", "insights", "articles")),
    (10, ("support", "help", "faq", "documentation")),
)
CATEGORIES = (
    ("services", ("/services", "/solutions")),
    ("portfolio", ("/portfolio", "/work", "/projects", "/case-studies")),
    ("blog", ("/blog", "/news", "/articles", "/insights")),
    ("company", ("/about", "/team", "/company", "/culture")),
    ("technology", ("/technologies", "/expertise", "/skills")),
    ("industry", ("/industries",)),
    ("contact", ("/contact",)),
    ("careers", ("/careers", "/jobs", "/join")),
)
BREAKDOWN = (
    ("Service Pages", ("/services",)),
    ("Portfolio Pages", ("/portfolio", "/work", "/case-studies", "/projects")),
    ("Technology Pages", ("/technologies",)),
    ("Industry Pages", ("/industries",)),
    ("Blog Pages", ("/blog", "/news", "/insights", "/articles")),
    ("Company Pages", ("/company", "/leadership", "/founders", "/culture")),
    ("Career Pages", ("/careers", "/jobs", "/join")),
)
PAGE_TYPES = (("about", ("/about",)), ("services", ("/services",)), ("portfolio", ("/portfolio",)), ("team", ("/team",)), ("contact", ("/contact",)), ("blog", ("/blog", "/news")))
PATH_TYPES = (
    ("about", ("/about", "/company", "/team")),
    ("services", ("/services", "/solutions")),
    ("portfolio", ("/portfolio", "/work", "/projects", "/case-studies")),
    ("blog", ("/blog", "/news", "/articles", "/insights")),
    ("contact", ("/contact",)),
    ("careers", ("/careers", "/jobs")),
    ("technology", ("/technologies", "/expertise")),
    ("industry", ("/industries",)),
)
GENERATED = (
    (("services", ""), "web-development mobile-development app-development software-development ui-ux-design digital-marketing seo ecommerce-development cloud-solutions consulting"),
    (("industries", "solutions"), "healthcare finance education retail real-estate non-profit startups enterprise"),
    (("technologies", "expertise"), "react angular vue node-js python php java wordpress aws azure"),
)
# End of fixed values.

DOMAIN = "example.com"


def host(url: Column) -> Column:
    """The authority between the scheme and the path, empty without."""
    return F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.\-]*://([^/?#]*)", 1)


def path(url: Column) -> Column:
    return F.regexp_extract(url, r"^(?:[A-Za-z][A-Za-z0-9+.\-]*:)?(?://[^/?#]*)?([^?#]*)", 1)


def without_fragment(url: Column) -> Column:
    return F.regexp_replace(url, "#.*$", "")


def excluded(url: Column) -> Column:
    return url.rlike("(?i)^(?:" + "|".join(EXCLUDE) + ")")


def included(url: Column, domain: str = DOMAIN) -> Column:
    """Pages of the domain up to four levels deep, of its subdomains up to two, without query."""
    d, seg = re.escape(domain), r"/[^/\?#]+"
    return url.rlike(rf"(?i)^https://(?:{d}(?:{seg}){{0,4}}/?|[^.]+\.{d}(?:{seg}){{0,2}}/?)$")


def valid(url: Column, domain: str = DOMAIN) -> Column:
    """Of the domain, not excluded, and included."""
    return F.coalesce(url.rlike(rf"^https?://(?:.*\.)?{re.escape(domain)}(?:/|$)") & ~excluded(url) & included(url, domain), F.lit(False))


def crawlable(url: Column, domain: str = DOMAIN, base: Column | None = None) -> Column:
    """A web address of the base host (by suffix) or the domain, not excluded, of an included or allowed shape."""
    own = F.endswith(host(url), base) if base is not None else host(url).rlike(rf"^(.*\.)?{re.escape(domain)}$")
    shape = included(url, domain) | F.lower(path(url)).rlike("^(?:" + "|".join(ALLOWED_PATHS) + ")")
    return F.coalesce(url.rlike("^https?://") & own & ~excluded(url) & shape, F.lit(False))


def _first(url: Column, table, otherwise) -> Column:
    out = F
    for name, parts in table:
        out = out.when(contains_any(url, parts), name)
    return out.otherwise(otherwise)


def priority_class(url: Column, core: tuple[str, ...] = ()) -> Column:
    """1 for addresses that hold a core address, then nine classes of words, 11 for the rest."""
    low = F.lower(url)
    return F.when(contains_any(low, [c.lower() for c in core]), 1).otherwise(_first(low, PRIORITIES, 11))


def depth(url: Column) -> Column:
    """Segments of the path; one for the root."""
    return F.size(F.split(F.regexp_replace(path(url), "^/+|/+$", ""), "/"))


def priority_score(url: Column) -> Column:
    low = F.lower(url)
    kind = F.when(F.contains(low, F.lit("/services")), 80).when(contains_any(low, ("/portfolio", "/work")), 70).when(F.contains(low, F.lit("/blog")), 60).otherwise(0)
    return F.when(F.contains(low, F.lit("/")), 100).otherwise(0) + kind + F.greatest(F.lit(0), 20 - depth(url) * 5)


def _is_home(low: Column) -> Column:
    return low.endswith("/") & (F.length(low) - F.length(F.replace(low, F.lit("/"), F.lit(""))) <= 3)


def category(url: Column) -> Column:
    low = F.lower(url)
    return F.when(_is_home(low), "core_pages").otherwise(_first(low, CATEGORIES, "other"))


def breakdown(url: Column, strict: bool = False) -> Column:
    """The class an address is counted under. strict keeps the first test as wide as it was: any address with a slash."""
    low = F.lower(url)
    core = F.contains(low, F.lit("/")) if strict else _is_home(low) | contains_any(low, ("/about", "/contact", "/team"))
    return F.when(core, "Core Pages").otherwise(_first(low, BREAKDOWN, "Other Pages"))


def page_type(url: Column) -> Column:
    low = F.lower(url)
    return F.when(_is_home(low), "homepage").otherwise(_first(low, PAGE_TYPES, "other"))


def page_type_of_path(url: Column) -> Column:
    p = F.lower(path(url))
    return F.when(p.isin("", "/"), "homepage").otherwise(_first(p, PATH_TYPES, "other"))


def title(url: Column, nothing: str = "Unknown Source", default: str = "Company Content") -> Column:
    """The last path segment as words with capitals."""
    parts = F.split(url, "/")
    last = F.when(url.endswith("/"), F.try_element_at(parts, F.lit(-2))).otherwise(F.try_element_at(parts, F.lit(-1)))
    named = F.initcap(F.array_join(F.filter(F.split(F.translate(last, "-_", "  "), " "), lambda w: w != ""), " "))
    return F.when(F.coalesce(url, F.lit("")) == "", nothing).when(last == "", default).otherwise(named)


def page_id(url: Column) -> Column:
    return F.replace(F.replace(url, F.lit("https://"), F.lit("")), F.lit("/"), F.lit("_"))


def well_formed(url: Column) -> Column:
    return F.coalesce(url.rlike(r"^[A-Za-z][A-Za-z0-9+.\-]*://[^/?#]+"), F.lit(False))


def with_scheme(url: Column) -> Column:
    return F.when(F.trim(url).rlike("^https?://"), F.trim(url)).otherwise(F.concat(F.lit("https://"), F.trim(url)))


def split_valid(urls: DataFrame, column: str = "url") -> tuple[DataFrame, DataFrame]:
    """Normalised well-formed addresses, and the rest as given."""
    rows = urls.withColumn("__n", with_scheme(F.col(column)))
    good = well_formed(F.col("__n")) & F.coalesce(F.trim(column) != "", F.lit(False))
    return rows.where(good).withColumn(column, F.col("__n")).drop("__n"), rows.where(~good).drop("__n")


def matching(urls: DataFrame, patterns: list[str], column: str = "url") -> DataFrame:
    """Addresses in which any pattern is found, whatever the case."""
    return urls.where(F.col(column).rlike("(?i)" + "|".join(f"(?:{p})" for p in patterns))) if patterns else urls


def first_of_each(urls: DataFrame, order: str, column: str = "url") -> DataFrame:
    """One row per address, that with the smallest place in the order."""
    rank = F.row_number().over(Window.partitionBy(column).orderBy(order))
    return urls.withColumn("__r", rank).where("__r = 1").drop("__r")


def filtered(urls: DataFrame, order: str, domain: str = DOMAIN, column: str = "url") -> DataFrame:
    """Stripped, without fragment, valid, not excluded, and each once in the order given."""
    rows = urls.withColumn(column, without_fragment(F.trim(column)))
    return first_of_each(rows.where(valid(F.col(column), domain)), order, column)


def generated(hosts: DataFrame, column: str = "host") -> DataFrame:
    """Addresses by pattern at some hosts: every prefix of a kind with every name of it."""
    paths = sorted({"".join(f"/{x}" for x in (p, n) if x) for prefixes, names in GENERATED for p in prefixes for n in names.split()})
    return hosts.select(F.col(column).alias("__host"), F.explode(F.array(*map(F.lit, paths))).alias("__path")).select(F.concat(F.lit("https://"), "__host", "__path").alias("url"))
