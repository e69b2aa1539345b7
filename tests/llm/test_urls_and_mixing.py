from __future__ import annotations

import hashlib
import re
from fractions import Fraction

import pytest

from tapeweave.llm.mixing import mix_sources
from tapeweave.llm.urls import RULES, build_cascade, filter_urls


def judged(spark, urls, **options):
    rows = spark.createDataFrame([(i, u, "clash") for i, u in enumerate(urls)], "page_id long, url string, host string")
    return [filter_urls(rows, **options).orderBy("page_id").collect()][0]


def test_rules_and_parts(spark):
    urls = [
        "http://a.example.org/es/1", "http://A.Example.ORG/en/12?x=/es/", "https://example.org/en/2", "http://b.com/fr/", "http://b.com/de/1#x",
        "http://b.com/it/", "http://notexample.org/es/", "no scheme", None, "", "x://http://org/", "http://spam-farm.net/", "http://org", "http://b.net/",
        "http://a.org\n/es/", "http://com/fr/",
    ]
    got = judged(spark, urls)
    for row, url in zip(got, urls):
        rest = url.split("://", 1)[1] if url and "://" in url else ""
        host = re.split(r"[/?#]", rest, maxsplit=1)[0]
        path = re.split(r"[?#]", rest[len(host):], maxsplit=1)[0]
        host = "".join(c.lower() if "A" <= c <= "Z" else c for c in host)
        fits = [(len(h + p), h + p, v) for v, h, p in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
        listed = "spam-farm" in host.split(".")
        want = max(fits) if fits else (0, None, "block" if listed else "allow")
        assert (row["host"], row["path"], row["rule"], row["verdict"]) == (host, path, *want[1:]), url


def test_cascade_is_exact_and_refuses_what_is_too_large(spark):
    universe = spark.range(3000).selectExpr("concat('k', id) as key")
    listed = spark.range(0, 3000, 7).selectExpr("concat('k', id) as key")
    cascade = build_cascade(listed, universe, bits_per_key=3, hashes=2)
    assert len(cascade.levels) > 2
    found = universe.filter(cascade.contains(universe["key"]))
    assert {r[0] for r in found.collect()} == {r[0] for r in listed.collect()}
    with pytest.raises(ValueError):
        build_cascade(listed, universe, max_bits=64)


def test_later_levels_do_not_grow_with_the_universe(spark):
    listed = spark.range(6).selectExpr("concat('k', id * 1000) as key")
    for n in (3000, 1_000_000):
        universe = spark.range(n).selectExpr("concat('k', id) as key")
        cascade = build_cascade(listed, universe)
        assert [len(level.words) <= 8 for level in cascade.levels] == [True] * len(cascade.levels)
        assert universe.filter(cascade.contains(universe["key"])).count() == sum(1000 * i < n for i in range(6))


def test_a_list_beyond_the_limit_is_joined(spark):
    urls = [f"http://h{i % 50}.l{i % 7}.net/{i}" for i in range(120)] + [None, "", "no scheme", "http://H3.net/"]
    names = [f"h{i}" for i in range(0, 50, 3)] + ["l5", None, "absent", "l5"]
    blocked = spark.createDataFrame([(x,) for x in names], "key string")
    plain = judged(spark, urls, blocked=blocked)
    assert 20 < sum(r["listed"] for r in plain) < 110
    assert judged(spark, urls, blocked=blocked, rules=(), max_bits=64) == judged(spark, urls, blocked=blocked, rules=())
    assert [r["listed"] for r in plain] == [bool(set(names) & set(r["host"].split("."))) for r in plain]


def test_no_listed_keys_and_no_pages(spark):
    assert [r["verdict"] for r in judged(spark, ["http://spam-farm.net/"], blocked=(), rules=())] == ["allow"]
    assert judged(spark, []) == []


def brute_mix(rows, weights=3, most=3):
    """(taken copies, target) per row by the definition, with fractions."""
    sizes = [len(re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode())) for _, t, _ in rows]
    names = sorted({s for _, _, s in rows}, key=lambda s: (s is None, s or ""))
    own = {s: sum(n for n, r in zip(sizes, rows) if r[2] == s) for s in names}
    weight = {s: i % weights + 1 for i, s in enumerate(names)}
    target, left, share = {}, set(names), Fraction(sum(sizes))
    while True:
        level = share / sum(weight[s] for s in left) if left else 0
        full = {s for s in left if weight[s] * level > most * own[s]}
        if not full:
            break
        for s in full:
            target[s], share = Fraction(most * own[s]), share - most * own[s]
        left -= full
    target |= {s: weight[s] * level for s in left}
    copies = []
    for s in names:
        order = sorted((hashlib.md5(f"mix:{'' if i is None else i}".encode()).hexdigest(), -1 if i is None else i, n, k)
                       for k, ((i, _, o), n) in enumerate(zip(rows, sizes)) if o == s and n)
        at = 0
        for c in range(most):
            for key, _, n, k in order:
                at += n
                copies.append((at / target[s], s is None, s or "", k, n))
    taken, total = [0] * len(rows), 0
    for *_, k, n in sorted(copies):
        total += n
        if total > sum(sizes):
            break
        taken[k] += 1
    return [(n, own[r[2]], float(target[r[2]]), c * n) for n, r, c in zip(sizes, rows, taken)]


def test_mix_against_the_definition(spark, corner_docs):
    many = [(i, "w " * (i * 7 % 23 + 1), f"s{i * i % 5}") for i in range(300)] + [(1000 + i, "w " * 30, "hot") for i in range(150)]
    for rows in (many, [(r["doc_id"], r["text"], r["source"]) for r in corner_docs.collect()]):
        got = mix_sources(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
        ours = sorted((str(r["doc_id"]), r["size"], r["source_size"], round(r["target"], 6), r["taken"]) for r in got)
        want = sorted((str(r[0]), n, own, round(t, 6), k) for r, (n, own, t, k) in zip(rows, brute_mix(rows)))
        assert ours == want


def test_mix_of_nothing(spark, no_docs):
    assert mix_sources(no_docs).collect() == []
    only = spark.createDataFrame([(1, None, None), (2, "", "a")], "doc_id long, text string, source string")
    assert [r["taken"] for r in mix_sources(only).collect()] == [0, 0]
