import re
import zlib
from collections import Counter

import numpy as np
import pytest

from posegrid.llm import interleave, outliers, urlblock

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def test_statistics_equal_a_plain_count(docs, rows):
    got = {}
    for r in outliers.statistics(docs).collect():
        got.setdefault(r["doc_id"], r)
    for row in rows:
        x = row[1] or ""
        w = WORD.findall(x)
        grams = [tuple(w[k : k + 3]) for k in range(len(w) - 2)]
        times = Counter(grams)
        covered = {k + j for k, g in enumerate(grams) if times[g] > 1 for j in range(3)}
        lines = [s for s in x.split("\n") if WORD.search(s)]
        r = got[row[0]]
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"], r["n_repeat_words"]) == (len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in x), len(lines) - len(set(lines)), len(covered))


def test_repeats_and_lines(spark):
    texts = ["a b c a b c", "a a a a", "x y z\nx y z\nx y z", "a b c d a b c e", "# $ | <b> && 100%", "\n\n \n", "a b\na b "]
    df = spark.createDataFrame([(i, t, "en", "s") for i, t in enumerate(texts)], "doc_id long, text string, lang string, source string")
    got = {r["doc_id"]: (r["n_repeat_words"], r["n_dup_lines"], r["n_symbols"]) for r in outliers.statistics(df).collect()}
    assert got == {0: (6, 0, 0), 1: (4, 0, 0), 2: (9, 2, 0), 3: (6, 0, 0), 4: (0, 0, 8), 5: (0, 0, 0), 6: (0, 0, 0)} | {4: (0, 0, sum(c in "#*$%&|<>" for c in texts[4]))}


def test_planted_outliers_go_and_clean_documents_stay(spark):
    rng = np.random.default_rng(4)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 9)))
    clean = [(i, " ".join(word() for _ in range(120)).capitalize() + ".", "en" if i % 2 else "fr", f"s{i % 2}") for i in range(500)]
    bad = [(1000 + i, " ".join(word() + "***" for _ in range(120)), "en", "s1") for i in range(20)] + [(1100 + i, " ".join(word().upper() + "!!" for _ in range(120)), "fr", "s0") for i in range(20)]
    got = {r["doc_id"]: r["kept"] for r in outliers.judge(spark.createDataFrame(clean + bad, "doc_id long, text string, lang string, source string")).collect()}
    assert all(got[i] for i, *_ in clean)
    assert not any(got[i] for i, *_ in bad)


@pytest.mark.parametrize("share", [0.34, 0.4])
def test_alike_junk_of_a_large_share_goes(spark, share):
    """One junk template with a third and more of a group's rows is no part of what the group is measured by."""
    rng = np.random.default_rng(5)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 9)))
    n_junk = int(share * 400)
    template = " ".join(word().upper() + "!!**" for _ in range(120))
    data = [(i, " ".join(word() for _ in range(120)).capitalize() + "." if i >= n_junk else template, "en", "s") for i in range(400)]
    got = {r["doc_id"]: r["kept"] for r in outliers.judge(spark.createDataFrame(data, "doc_id long, text string, lang string, source string")).collect()}
    assert not any(got[i] for i in range(n_junk))
    assert all(got[i] for i in range(n_junk, 400))


def test_junk_of_small_sources_and_languages_goes(spark):
    """Small groups are measured by all rows of their language, or by all rows, and not by each other."""
    rng = np.random.default_rng(6)
    word = lambda: "".join(rng.choice(list("abcdefgh"), rng.integers(2, 9)))
    clean = lambda: " ".join(word() for _ in range(120)).capitalize() + "."
    junk = lambda: " ".join(word().upper() + "!!**" for _ in range(120))
    data = [(i, clean(), "en", f"s{i % 2}") for i in range(400)] + [(400 + i, clean(), "fr", None) for i in range(120)]
    bad = [(1000 + i, junk(), "en", "small") for i in range(20)] + [(1100, junk(), "fr", "one"), (1200, junk(), "rare", "x"), (1201, junk(), "rare", "y"), (1300, junk(), None, None)]
    good = [(2000 + i, clean(), "en", "few") for i in range(5)] + [(2100, clean(), "rare", "x"), (2101, clean(), "fr", "one")]
    got = {r["doc_id"]: r["kept"] for r in outliers.judge(spark.createDataFrame(data + bad + good, "doc_id long, text string, lang string, source string")).collect()}
    assert len(got) == len(data + bad + good)
    assert not any(got[i] for i, *_ in bad)
    assert all(got[i] for i, *_ in data + good)


def test_rule_edge_cases(docs, rows, nothing):
    got = outliers.judge(docs).collect()
    assert len(got) == len(rows)
    assert all(r["kept"] is not None and not (r["base_failed"] and r["kept"]) for r in got)
    assert all(r["base_failed"] for r in got if r["n_words"] < 50)
    assert outliers.judge(nothing).count() == 0


def brute_rule(url):
    if url is None or "://" not in url:
        return "", "", None
    rest = url.split("://", 1)[1]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = host.translate({c: c + 32 for c in range(65, 91)})
    fits = [r for _, r in urlblock.RULES if (host == r.split("/")[0] or host.endswith("." + r.split("/")[0])) and path.startswith("/" + r.split("/", 1)[1])]
    return host, path, max(fits, key=len, default=None)


URLS = [
    None, "", "no scheme", "http://", "HTTP://EXAMPLE.COM/en/7?x", "http://example.com/en/70#top", "https://a.b.example.com/en/8", "http://xcom/en/", "http://com/en/", "http://com/en", "ftp://Ü.NET/de/1",
    "http://example.net/de/8", "http://www.example.net/de/80/x", "http://example.net/de/9", "http://x.org/es/?q", "http://x.org/es#f", "http://x.org?u=http://y.com/en/", "http://x.net/de/a b\n", "a://b://c.com/en/",
]


def test_urls_equal_plain_rules(spark):
    df = spark.createDataFrame([(i, u, None, "x") for i, u in enumerate(URLS)] + [(0, None, "<html>", "x"), (None, "http://com/en/", None, None)], "page_id long, url string, html string, node string")
    got = urlblock.judge(df).collect()
    assert len(got) == len(URLS) + 2
    verdicts = {r: v for v, r in urlblock.RULES}
    for r in got:
        if r["page_id"]:
            assert (r["host"], r["path"], r["rule"]) == brute_rule(URLS[r["page_id"]])
            assert r["rule"] is None or r["verdict"] == verdicts[r["rule"]]
    by_id = {r["page_id"]: r["verdict"] for r in got}
    assert by_id[URLS.index("http://com/en")] == "block"  # another spelling of a blocked url
    assert by_id[URLS.index("http://xcom/en/")] == "allow"
    assert urlblock.judge(df.limit(0)).count() == 0


def test_blocks_reach_aliases_unless_allowed(spark):
    link = '<link href="{0}" rel="canonical">'
    refresh = "<meta http-equiv=refresh content=\"0; url={0}\">"
    pages = [
        (1, "http://a.com/en/1", None),  # blocked by rule
        (2, "http://b.org/x", link.format("https://www.a.com/en/1/?utm_source=f#top")),  # its alias
        (3, "http://c.org/y", refresh.format("http://b.org/x")),  # an alias of the alias
        (4, "http://d.org/z", "<script>location.href = 'http://e.org/es/5'</script>"),  # to a blocked url that is no page
        (5, "http://f.org/p", link.format("http://example.com/en/7")),  # to an allowed url
        (6, "http://g.org/q", link.format("http://f.org/p") + refresh.format("http://a.com/en/1")),  # allowed and blocked: all of it is allowed
        (7, "http://h.org/r", link.format("http://h.org/r")),
        (8, "https://m.b.org/x/index.html", None),  # another spelling of 2
        (9, "http://i.org/es/1", link.format("http://j.org/es/2")),
    ]
    df = spark.createDataFrame(pages, "page_id long, url string, html string")
    joined = {r["page_id"]: r["verdict"] for r in urlblock.judge(df).collect()}
    assert joined == {1: "block", 2: "allow", 3: "allow", 4: "block", 5: "allow", 6: "allow", 7: "allow", 8: "allow", 9: "block"}
    apart = {r["page_id"]: r["verdict"] for r in urlblock.judge(df.where("page_id <> 6")).collect()}
    assert apart == {1: "block", 2: "block", 3: "block", 4: "block", 5: "allow", 7: "allow", 8: "block", 9: "block"}


def test_relative_repeated_and_encoded_links(spark):
    from urllib.parse import urljoin

    from pyspark.sql import functions as F

    base = "https://Host.org:8/a/b/page.html?q=1#f"
    links = ["/en/7", "//host.net/x", "next", "../up?k=/../v", "./same/.", "?p=2", "/a/../../c", "..", "http://x.y/z", "deep/er#t", "/p?u=http://z.org/"]
    got = spark.createDataFrame([(x, base) for x in links], "x string, base string").select("x", urlblock.resolved(F.col("x"), F.col("base")).alias("y")).collect()
    assert {r["x"]: r["y"] for r in got} == {x: urljoin(base, x) for x in links}
    nowhere = spark.createDataFrame([("mailto:a@b.c", base), ("#f", base), ("/x", "no scheme"), ("", base)], "x string, base string")
    assert [r[0] for r in nowhere.select(urlblock.resolved(F.col("x"), F.col("base"))).collect()] == [None] * 4

    pages = [
        (1, "http://a.com/en/1", '<link rel=canonical href="/y">'),  # blocked by rule, and its root-relative target with it
        (2, "http://a.com/y", None),
        (3, "http://b.org/dir/p", "<meta http-equiv=refresh content='0;url=../es/2?a=1&amp;b=2'>"),  # to a blocked url
        (4, "http://c.net/q", "<script>location='//d.net/z'; if (m) { location = '/other'; }</script>"),
        (5, "http://d.net/z", "<script>location.replace('/es/ok')</script><script>location.replace('http://b.org/es/1')</script>"),  # the second one is blocked
        (6, "http://e.net/u", '<meta property="og:url" content="http://e.net/u"><meta property="og:url" content="http://a.com/en/&#x31;">'),
        (7, "http://c.net/other", None),
        (8, "http://f.net/v", '<div location="/w"></div><a href="/en/1">'),  # no redirect
        (9, "http://f.net/w", "<base href='http://b.org/es/'><link rel=canonical href=9>"),
    ]
    want = {1: "block", 2: "block", 3: "block", 4: "block", 5: "block", 6: "block", 7: "block", 8: "allow", 9: "block"}
    got = urlblock.judge(spark.createDataFrame(pages, "page_id long, url string, html string")).collect()
    assert {r["page_id"]: r["verdict"] for r in got} == want


def test_shards_are_even_and_alike(spark, docs, rows, nothing):
    got = interleave.interleave(docs).collect()
    assert len(got) == len(rows)
    counts = Counter(r["shard"] for r in got)
    assert set(counts) <= set(range(16)) and max(counts.values()) - min(counts.values()) <= 1
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    want = Counter((r[0], len((r[1] or "").encode()) + 1, zlib.crc32((r[1] or "").encode())) for r in rows)
    assert Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got) == want
    assert interleave.interleave(nothing).count() == 0
    again = interleave.interleave(docs.repartition(7)).collect()
    assert Counter(map(tuple, again)) == Counter(map(tuple, got))


@pytest.mark.parametrize("hot", [0.34, 0.9])
def test_every_shard_has_the_mixture(spark, hot):
    n = 3200
    data = [(i, f"t{i}", "hot" if i < hot * n else f"s{i % 4}") for i in range(n)]
    got = interleave.interleave(spark.createDataFrame(data, "doc_id long, text string, source string")).collect()
    source = {i: s for i, _, s in data}
    whole = Counter(source.values())
    for shard in range(16):
        own = Counter(source[r["doc_id"]] for r in got if r["shard"] == shard)
        assert all(abs(own[s] - whole[s] / 16) <= 2 for s in whole)


