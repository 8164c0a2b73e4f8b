"""URL rules carried over redirect and canonical-link equivalence, as DataFrame operations only.

A rule (host and path) fits its host and all subdomains where the path starts with the rule's; the longest rule wins
and decides. Urls that no rule fits take the decision of their component: components link each page to its redirect
(meta refresh, script location) and canonical targets (link rel, og:url), all that it has, with entities decoded and
relative ones resolved against the page's base (base href, or its url), over urls brought to one spelling (scheme,
www and mobile host, fragment, index page, trailing slash and tracking parameters dropped). If an allow rule fits any
url of the component, the component is allowed, even if a block rule fits another; else a block rule blocks it; else
it is allowed.

A null url, or one without ``://``, has an empty host and path, fits no rule and joins no component: it is allowed.
Null html has no links. Repeated urls share a node; repeated ids are judged row by row. Extra columns are not read.
An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import settle
from .graph import connected_components

#: Fixed values of the contract: verdict and rule.
RULES = (("block", "com/en/"), ("allow", "example.com/en/7"), ("allow", "net/de/"), ("block", "example.net/de/8"), ("block", "org/es/"))
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
CANONICAL = (
    r"(?is)<link\b(?=[^>]*\brel\s*=\s*[\"']?canonical\b)[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)",
    r"(?is)<meta\b(?=[^>]*\bproperty\s*=\s*[\"']?og:url\b)[^>]*?\bcontent\s*=\s*[\"']?([^\"'\s>]+)",
)
REDIRECT = (
    r"(?is)<meta\b(?=[^>]*\bhttp-equiv\s*=\s*[\"']?refresh\b)[^>]*?\burl\s*=\s*[\"']?((?:&#?\w+;|[^\"'\s>;])+)",
)
#: An absolute target counts anywhere (also in handlers of events), any other within a script only.
LOCATION = (r"(?is)\blocation(?:\.href)?\s*=\s*[\"']({0}[^\"'\s]+)[\"']", r"(?is)\blocation\.replace\(\s*[\"']({0}[^\"'\s]+)[\"']")
SCRIPT = r"(?is)<script\b[^>]*>(.*?)</script"
BASE = r"(?is)<base\b[^>]*?\bhref\s*=\s*[\"']?([^\"'\s>]+)"
ENTITIES = {"amp": "&", "lt": "<", "gt": ">", "quot": '"', "apos": "'"}
#: Query parameters that do not change the page.
TRACKING = r"^(utm_[a-z]+|ref|fbclid|gclid|sessionid)="


def host_of(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.translate(F.regexp_extract(rest, r"^[^/?#]*", 0), UPPER, LOWER)


def path_of(url: Column) -> Column:
    at = F.locate("://", F.coalesce(url, F.lit("")))
    rest = F.when(at > 0, F.substr(url, at + 3)).otherwise("")
    return F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def rule_of(host: Column, path: Column, rules=RULES) -> Column:
    """The longest rule that fits; the rules are a short list and become one expression."""
    out = F.lit(None).cast("string")
    for _, rule in sorted(rules, key=lambda x: len(x[1])):
        name, _, rest = rule.partition("/")
        fits = ((host == name) | host.endswith("." + name)) & path.startswith("/" + rest)
        out = F.when(fits, F.lit(rule)).otherwise(out)
    return out


def verdict_of(rule: Column, rules=RULES) -> Column:
    return F.coalesce(*[F.when(rule == r, F.lit(v)) for v, r in rules])


def spelling(url: Column) -> Column:
    """One spelling for urls that differ in nothing that matters; null where there is no host."""
    host = F.regexp_replace(host_of(url), r"^(www|m|amp|mobile)\.(?=.*\.)", "")
    path = F.regexp_replace(F.regexp_replace(path_of(url), r"/index\.[a-z]+$", "/"), r"(\.html?|/)$", "")
    query = F.regexp_extract(url, r"^[^?#]*\?([^#]*)", 1)
    kept = F.array_join(F.array_sort(F.filter(F.split(query, "&"), lambda x: (x != "") & ~x.rlike(TRACKING))), "&")
    return F.when(host_of(url) != "", F.concat(host, path, F.when(kept != "", F.concat(F.lit("?"), kept)).otherwise("")))


def decoded(x: Column) -> Column:
    """``x`` with its character references decoded, once: by name for ENTITIES, by number for all."""

    def part(p: Column, i: Column) -> Column:
        name = F.regexp_extract(p, "^([^;]*);", 1)
        digits = F.when(F.lower(name).startswith("#x"), F.conv(F.substr(name, F.lit(3)), 16, 10)).otherwise(F.substr(name, F.lit(2))).cast("int")
        number = F.when(digits.between(1, 0xD7FF) | digits.between(0xE000, 0x10FFFF), F.decode(F.unhex(F.lpad(F.hex(digits), 8, "0")), "UTF-32")).otherwise("\ufffd")
        sign = F.when(name.startswith("#"), number)
        for k, v in ENTITIES.items():
            sign = sign.when(name == k, v)
        return F.when(i == 0, p).otherwise(F.concat(sign, F.substr(p, F.length(name) + 2)))

    pieces = F.split(x, f"&(?=(?:#[0-9]{{1,7}}|#[xX][0-9a-fA-F]{{1,6}}|{'|'.join(ENTITIES)});)")
    return F.when(x.contains("&"), F.array_join(F.transform(pieces, part), "")).otherwise(x)


def resolved(x: Column, base: Column) -> Column:
    """``x`` as an absolute url, seen from ``base``; null where it is none (mailto:, an own fragment, a relative one of no base)."""
    scheme = F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*:", 0)
    site = F.regexp_extract(base, "^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]*", 0)
    whole = F.regexp_extract(base, "^[^?#]*", 0)
    path = F.substr(whole, F.length(site) + 1)
    folder = F.when(path == "", "/").otherwise(F.regexp_extract(path, "^.*/", 0))
    own, rest = F.regexp_extract(x, "^[^?#]*", 0), F.regexp_extract(x, "[?#](?s:.*)$", 0)
    steps = F.split(F.when(own.startswith("/"), own).otherwise(F.concat(folder, own)), "/")
    kept = F.aggregate(steps, F.array().cast("array<string>"), lambda a, s: F.when(s == "..", F.slice(a, 1, F.greatest(F.size(a) - 1, F.lit(1)))).when(s == ".", a).otherwise(F.concat(a, F.array(s))))
    last = F.when(own.rlike(r"(^|/)\.\.?$"), "/").otherwise("")
    return (
        F.when(x.rlike("^[A-Za-z][A-Za-z0-9+.-]*://"), x).when(x.rlike("^[A-Za-z][A-Za-z0-9+.-]*:") | x.startswith("#") | (x == "") | (site == ""), None)
        .when(x.startswith("//"), F.concat(scheme, x)).when(x.startswith("?"), F.concat(whole, x)).otherwise(F.concat(site, F.array_join(kept, "/"), last, rest))
    )


def links_of(html: Column, url: Column) -> Column:
    """Targets of all canonical links and redirects, absolute; pages without such a word are not searched."""
    every = lambda text, pattern: F.regexp_extract_all(text, F.lit(pattern), F.lit(1))
    none = F.array().cast("array<string>")
    has = lambda word, found: F.when(html.rlike(word), found).otherwise(none)
    base = F.when(html.rlike(r"(?i)<base\b"), resolved(decoded(F.regexp_extract(html, BASE, 1)), url))
    tags = F.concat(*[has(word, every(html, pattern)) for pattern, word in zip((*CANONICAL, *REDIRECT), ("(?i)canonical", "(?i)og:url", "(?i)refresh"))])
    scripts = F.array_join(every(html, SCRIPT), "\n")
    moves = has("(?i)location", F.concat(*[x for p in LOCATION for x in (every(html, p.format("[a-z]+://")), every(scripts, p.format("")))]))
    found = F.concat(F.transform(tags, decoded), moves)
    targets = F.transform(found, lambda x: resolved(x, F.coalesce(base, url)))
    return F.array_distinct(F.filter(F.when(F.size(found) > 0, targets), lambda x: x.isNotNull()))


def judge(pages: DataFrame, rules=RULES, id_col: str = "page_id", url_col: str = "url", html_col: str = "html") -> DataFrame:
    """page_id, host, path, rule, verdict, component_blocked (what the page's component says)."""
    url = F.col("url")
    rows = pages.select(F.col(id_col).alias("page_id"), F.col(url_col).cast("string").alias("url"), links_of(F.col(html_col).cast("string"), F.coalesce(F.col(url_col).cast("string"), F.lit(""))).alias("links"))
    host, path = host_of(url), path_of(url)
    rows = rows.select("page_id", "url", "links", host.alias("host"), path.alias("path"), rule_of(host, path, rules).alias("rule"), spelling(url).alias("node"))
    rows = settle(rows, "urls")
    targets = rows.where("size(links) > 0").select("node", F.explode("links").alias("url"))
    targets = targets.select(F.col("node").alias("a"), spelling(url).alias("b"), verdict_of(rule_of(host, path, rules), rules).alias("says"))
    decided = rows.select("node", verdict_of(F.col("rule"), rules).alias("says")).union(targets.select(F.col("b").alias("node"), "says"))
    decided = decided.where("node is not null and says is not null").groupBy("node").agg(F.max(F.col("says") == "allow").alias("allow"), F.max(F.col("says") == "block").alias("block"))
    members = connected_components(targets, "a", "b")
    placed = decided.join(members, "node", "left").select(F.coalesce("component", "node").alias("component"), "allow", "block")
    said = placed.groupBy("component").agg(F.max("allow").alias("allow"), F.max("block").alias("block")).select("component", (~F.col("allow") & F.col("block")).alias("blocked"))
    # Only nodes of blocked components need finding again: all others are allowed.
    blocked = said.where("blocked").select("component")
    own = members.join(blocked, "component", "left_semi").select("node").union(blocked.select(F.col("component").alias("node"))).distinct()
    judged = rows.join(own.withColumn("component_blocked", F.lit(True)), "node", "left").withColumn("component_blocked", F.coalesce("component_blocked", F.lit(False)))
    verdict = F.coalesce(verdict_of(F.col("rule"), rules), F.when(F.col("component_blocked"), "block").otherwise("allow"))
    return judged.select("page_id", "host", "path", "rule", verdict.alias("verdict"), "component_blocked")
