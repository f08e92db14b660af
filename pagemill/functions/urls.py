"""URL columns. Everything is a built-in expression, so it stays inside whole-stage code and never raises."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from pagemill.functions.lets import let

# scheme, authority, path, query, fragment (the generic URI split)
_PARTS = r"(?s)^(?:([A-Za-z][A-Za-z0-9+.\-]*):)?(?://([^/?#]*))?([^?#]*)(?:\?([^#]*))?(?:#(.*))?$"

# --- fixed values -------------------------------------------------------------------------------------------------
COUNTRY_SECOND_LEVELS = ("co", "com", "org", "gov", "ac", "net", "edu")
DOCUMENT_EXTENSIONS = (
    r"(?i)\.(pdf|jpe?g|png|gif|svg|webp|zip|docx?|xlsx?|pptx?|mp[34]|csv|xml|rss|ics)$"
)
PAGE_NUMBER_PATH = r"(?i)/(page|p|pg)/\d+/?$"
# ------------------------------------------------------------------------------------------------------------------


def scheme(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 1)


def netloc(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 2)


def path(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 3)


def query(url: Column) -> Column:
    return F.regexp_extract(url, _PARTS, 4)


def _or(value: Column, default: str) -> Column:
    return F.when(value == "", F.lit(default)).otherwise(value)


def parts(url: Column) -> Column:
    """The URL split once, for expressions that need several of its parts."""
    return F.struct(*[
        F.regexp_extract(url, _PARTS, i + 1).alias(name)
        for i, name in enumerate(("scheme", "netloc", "path", "query", "fragment"))
    ])


def _prefixed(mark: str, value: Column) -> Column:
    return F.when(value == "", value).otherwise(F.concat(F.lit(mark), value))


def normalise(url: Column) -> Column:
    """Lower-case scheme and host, keep the path (empty becomes ``/``), drop query and fragment."""

    def build(u: Column) -> Column:
        rooted = F.when((u["netloc"] == "") | u["path"].startswith("/"), u["path"]).otherwise(
            F.concat(F.lit("/"), u["path"])
        )
        return F.concat(
            F.when(u["scheme"] == "", u["scheme"]).otherwise(F.concat(F.lower(u["scheme"]), F.lit(":"))),
            _prefixed("//", F.lower(u["netloc"])),
            _or(rooted, "/"),
        )

    return let(parts(url), build)


def lookup_key(url: Column) -> Column:
    """One form per stored page: normalised, with its query and without its fragment."""
    return F.concat(normalise(url), _prefixed("?", query(url)))


def cleaned(href: Column) -> Column:
    """A link as written without what does not count in it: tabs and line breaks anywhere, controls and blanks in front,
    blanks behind."""
    return F.regexp_replace(F.regexp_replace(href, r"[\t\r\n]+", ""), r"^[\x00-\x20]+| +$", "")


def site(url: Column) -> Column:
    """Registrable domain: the last two host labels, or three below a two-letter country's second level."""
    labels = F.split(F.split_part(F.lower(netloc(url)), F.lit(":"), F.lit(1)), r"\.")
    return let(
        labels,
        lambda p: F.when(
            (F.size(p) >= 3)
            & (F.length(F.element_at(p, -1)) == 2)
            & F.coalesce(F.get(p, F.size(p) - 2).isin(*COUNTRY_SECOND_LEVELS), F.lit(False)),
            F.array_join(F.slice(p, -3, 3), "."),
        )
        .when(F.size(p) >= 2, F.array_join(F.slice(p, -2, 2), "."))
        .otherwise(F.array_join(p, ".")),
    )


def folder_pattern(path_: Column) -> Column:
    """All path segments but the last; all-digit ones become ``*``: dated folders group together."""
    segments = F.split(F.regexp_replace(path_, "^/+|/+$", ""), "/")
    return let(
        segments,
        lambda s: F.concat(
            F.lit("/"),
            F.array_join(
                F.transform(
                    F.slice(s, F.lit(1), F.size(s) - 1),
                    lambda x: F.concat(F.when(x.rlike(r"(?U)^\d+$"), F.lit("*")).otherwise(x), F.lit("/")),
                ),
                "",
            ),
        ),
    )


def first_section(url: Column) -> Column:
    """First path segment as ``/segment/``, or empty for the root."""
    segment = F.split_part(F.regexp_replace(path(url), "^/+|/+$", ""), F.lit("/"), F.lit(1))
    return F.when(segment == "", F.lit("")).otherwise(F.concat(F.lit("/"), segment, F.lit("/")))


def slug(text: Column) -> Column:
    """Lower-case, runs of other characters to one hyphen, trimmed, then cut to 60."""
    hyphened = F.regexp_replace(F.lower(text), "[^a-z0-9]+", "-")
    return F.substring(F.regexp_replace(hyphened, "^-+|-+$", ""), 1, 60)


def looks_like_slug(url: Column) -> Column:
    """The last segment reads like an item's own name: two hyphens or a run of four digits."""
    last = F.regexp_extract(F.regexp_replace(path(url), "/+$", ""), "([^/]*)$", 1)
    return last.rlike(r"-.*-") | last.rlike(r"\d{4,}")


def is_document(url: Column) -> Column:
    """Asset or file link, which never counts as a page."""
    return path(url).rlike(DOCUMENT_EXTENSIONS) | url.contains("/cdn-cgi/")


def is_pdf(url: Column) -> Column:
    return F.lower(path(url)).endswith(".pdf")


def is_page_number(url: Column) -> Column:
    return path(url).rlike(PAGE_NUMBER_PATH)


def digit_shape(url: Column) -> Column:
    return F.regexp_replace(url, r"\d+", "#")


def last_number(url: Column) -> Column:
    """The last run of digits as a number; NULL without one."""
    return F.try_element_at(F.regexp_extract_all(url, F.lit(r"(\d+)"), F.lit(1)), F.lit(-1)).try_cast("bigint")


def path_depth(url: Column) -> Column:
    return F.size(F.split(F.regexp_replace(path(url), "^/+|/+$", ""), "/"))


def root(url: Column) -> Column:
    return F.concat(scheme(url), F.lit("://"), netloc(url))


def without_slash(url: Column) -> Column:
    return F.regexp_replace(url, "/+$", "")


def _fold_dots(path_: Column) -> Column:
    """Resolve ``.`` and ``..`` segments; a path that has none is returned untouched."""
    segments = F.split(path_, "/")
    folded = F.aggregate(
        segments,
        F.array().cast("array<string>"),
        lambda acc, s: F.when(s == "..", F.slice(acc, F.lit(1), F.greatest(F.size(acc) - 1, F.lit(0))))
        .when(s == ".", acc)
        .otherwise(F.concat(acc, F.array(s))),
    )
    ends_in_dots = F.when(path_.rlike(r"(^|/)\.\.?$"), F.lit("/")).otherwise(F.lit(""))
    closed = F.regexp_replace(F.concat(F.lit("/"), F.array_join(folded, "/"), ends_in_dots), "^//", "/")
    return F.when(path_.rlike(r"(^|/)\.\.?(/|$)"), _or(closed, "/")).otherwise(path_)


def resolve_from(base: Column, href: Column) -> Column:
    """Absolute form of ``href`` as seen on the page whose URL ``parts`` are ``base``. Links of other schemes come
    back unchanged."""

    def build(href: Column, u: Column) -> Column:
        tail = F.concat(_prefixed("?", u["query"]), _prefixed("#", u["fragment"]))
        own_directory = _or(F.regexp_replace(base["path"], "[^/]*$", ""), "/")
        relative = F.regexp_replace(F.concat(own_directory, u["path"]), "(?<=.)/{2,}(?=[^/])", "/")
        query_ = F.when(u["query"] == "", base["query"]).otherwise(u["query"])
        fragment = F.when(href == "", base["fragment"]).otherwise(u["fragment"])
        same_page = F.concat(base["path"], _prefixed("?", query_), _prefixed("#", fragment))
        target = F.when(u["path"] == "", same_page).otherwise(
            F.concat(_fold_dots(F.when(u["path"].startswith("/"), u["path"]).otherwise(relative)), tail)
        )
        return (
            F.when((u["scheme"] != "") & (F.lower(u["scheme"]) != F.lower(base["scheme"])), href)
            .when(
                u["netloc"] != "",
                F.concat(base["scheme"], F.lit("://"), u["netloc"], u["path"], tail),
            )
            .otherwise(F.concat(base["scheme"], F.lit("://"), base["netloc"], target))
        )

    return let(cleaned(href), lambda h: let(parts(h), lambda u: build(h, u)))


def resolve(base: Column, href: Column) -> Column:
    return let(parts(base), lambda b: resolve_from(b, href))


def page_candidates(url: Column, n: Column) -> Column:
    """The usual page-N conventions, tried in order: array of (shape, offset, url). The key replaces one already in
    the query; other parameters stay."""
    plain = F.regexp_replace(url, r"[?#].*$", "")
    frag = F.regexp_extract(url, r"(#.*)$", 1)
    pairs = F.filter(F.split(query(url), "&"), lambda kv: kv.rlike(r"^[^=]+=.+"))

    def with_key(key: str, value: Column) -> Column:
        mine = F.concat(F.lit(key + "="), value.cast("string"))
        present = F.exists(pairs, lambda kv: kv.startswith(key + "="))
        names = F.array_distinct(F.transform(pairs, lambda kv: F.substring_index(kv, "=", 1)))
        # of a repeated key the last value counts, in the place of the first
        single = F.transform(names, lambda n: F.element_at(F.filter(pairs, lambda kv: F.substring_index(kv, "=", 1) == n), -1))
        merged = F.when(
            present, F.transform(single, lambda kv: F.when(kv.startswith(key + "="), mine).otherwise(kv))
        ).otherwise(F.concat(single, F.array(mine)))
        return F.concat(plain, F.lit("?"), F.array_join(merged, "&"), frag)

    def entry(shape: str, offset: int, u: Column) -> Column:
        return F.struct(F.lit(shape).alias("shape"), F.lit(offset).alias("offset"), u.alias("url"))

    q = query(url)
    paged_path = F.concat(
        F.regexp_replace(plain, "/+$", ""), F.lit("/page/"), n.cast("string"), F.lit("/"),
        F.when(q != "", F.concat(F.lit("?"), q)).otherwise(F.lit("")), frag,
    )
    return F.array(
        entry("?page={}", 0, with_key("page", n)),
        entry("?page={}", -1, with_key("page", n - 1)),
        entry("?paged={}", 0, with_key("paged", n)),
        entry("?p={}", 0, with_key("p", n)),
        entry("?pg={}", 0, with_key("pg", n)),
        entry("/page/{}/", 0, paged_path),
    )


def allowed_by_rules(rules: Column, url: Column) -> Column:
    """First rule (in file order) whose prefix starts the URL's path decides; no rule means allowed."""
    target = F.concat(_or(path(url), "/"), F.when(query(url) != "", F.concat(F.lit("?"), query(url))).otherwise(F.lit("")))
    hit = F.filter(rules, lambda r: target.startswith(r["prefix"]))
    return F.coalesce(F.get(hit, 0)["allow"], F.lit(True))
