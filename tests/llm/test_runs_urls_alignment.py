"""Periodic runs, URL filters and tokenizer alignment against brute force, with odd rows."""

import hashlib
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import SMALL
from covermill.llm import periodic_runs, queries, tokenizer_alignment, url_filters
from covermill.llm.library_tokens import tokenizer_path
from covermill.llm.url_filters import Rule
from test_llm_operators import ODD, empty

CLASHING = "doc_id long, text string, row long, held int, pair int, n_a int, links int, host string, template string, tokens int, decided int, b int"


@pytest.fixture(scope="module")
def odd(spark):
    texts = [*ODD, "w " * 40_000 + "end", "a b " * 12 + "a"]
    rows = [(i if i != 3 else None, t, i, 1, 2, 3, 4, "h", "t", 5, 6, 7) for i, t in enumerate(texts)] + [(10, ODD[10], 1, 1, 1, 1, 1, "h", "t", 1, 1, 1)]
    return spark.createDataFrame(rows, CLASHING)


def slow_runs(words, least):
    """Every stretch where words a period apart are equal, at its smallest period."""
    found = {}
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            j = i
            while j + q < len(words) and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(least, 2 * q):
                found.setdefault((i, j + q - i), q)
            i = j + 1
    return sorted(((s, n, q) for (s, n), q in found.items()), key=lambda r: (r[0], r[2]))


def test_runs_equal_brute_force():
    random.seed(11)
    for _ in range(1500):
        n = random.randint(0, 60)
        words = random.choices("abcdefgh"[: random.choice([1, 2, 2, 3, 5])], k=n)
        if n > 3 and random.random() < 0.5:
            a = random.randrange(n)
            p = 1 + (n - a) // random.randint(2, 5)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        for least in (2, 5, 12):
            assert periodic_runs.periodic_runs(words, least) == slow_runs(words, least)


def test_squares_of_the_automaton():
    """All squares whose root is no power, without any cut before."""
    random.seed(3)
    for _ in range(300):
        s = random.choices([0, 1, 2], k=random.randint(0, 40))
        want = set()
        for end in range(len(s)):
            for q in range(1, (end + 1) // 2 + 1):
                root = s[end - q + 1 : end + 1]
                power = any(q % d == 0 and root == root[:d] * (q // d) for d in range(1, q))
                if s[end - 2 * q + 1 : end - q + 1] == root and not power:
                    want.add((q, end))
        got = list(periodic_runs.squares(s))
        assert set(got) == want and len(got) == len(want)


def test_very_long_periodic_texts():
    a, b = "a", "ab"
    while len(b) < 20_000:
        a, b = b, b + a
    # a Fibonacci word has runs everywhere; as many as are known for a shorter one, by brute force
    assert periodic_runs.periodic_runs(list(b[:600]), 12) == slow_runs(list(b[:600]), 12)
    assert len(periodic_runs.periodic_runs(list(b), 12)) < len(b)
    assert periodic_runs.periodic_runs(["w"] * 50_000, 12) == [(0, 50_000, 1)]


def test_with_runs(spark, odd):
    got = periodic_runs.with_runs(odd).collect()
    assert len(got) == odd.count() and set(periodic_runs.with_runs(odd).columns) == {*odd.columns, "periodic"}
    for r in got:
        words = periodic_runs.words_of(r["text"])
        assert r["periodic"]["n_words"] == len(words)
        if len(words) < 1000:
            assert [tuple(x) for x in r["periodic"]["runs"]] == slow_runs(words, 12)
    assert next(r["periodic"]["collapsed"] for r in got if r["text"] and r["text"].startswith("w w")) == "w end"
    assert periodic_runs.with_runs(empty(odd)).count() == 0


def test_periodic_query(spark):
    got = {r["doc_id"]: r for r in queries.op11_periodic_runs(spark, SMALL).collect()}
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    assert len(got) == len(docs)
    repeats = 0
    for d in docs:
        words, h = periodic_runs.words_of(d["text"]), zlib.crc32(str(d["doc_id"]).encode())
        n, g = len(words), h // 10
        if h % 10 == 0 and n:
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [words[i] if i < a else words[a + (i - a) % p] for i in range(n)]
        r = got[d["doc_id"]]
        # brute force takes n * n steps
        runs = slow_runs(words, 12) if n < 700 else periodic_runs.periodic_runs(words)
        dropped = {i for s, m, q in runs for i in range(s + q, s + m)}
        best = max(runs, key=lambda x: (x[1], -x[0], -x[2]), default=(None, None, None))
        repeats += bool(runs)
        assert r["n_runs"] == len(runs) and (r["start"], r["length"], r["period"]) == best
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
        assert r["runs_sha256"] == hashlib.sha256("".join(f"{s},{m},{q}\n" for s, m, q in runs).encode()).hexdigest()
        assert r["collapsed_sha256"] == hashlib.sha256(" ".join(w for i, w in enumerate(words) if i not in dropped).encode()).hexdigest()
    assert repeats > 5


RULES = [Rule("block", "net", "/"), Rule("allow", "example.net", "/en/"), Rule("block", "example.com", "/de/"), Rule("allow", "org", "/fr/")]


def test_urls_and_rules(spark):
    rows = [
        ("http://A.Example.NET/en/5?x=/", "a.example.net", "/en/5", "example.net/en/", "allow"),
        ("http://a.example.net/EN/5", "a.example.net", "/EN/5", "net/", "block"),
        ("http://net#/", "net", "", None, "allow"),
        ("http://net/", "net", "/", "net/", "block"),
        ("http://planet/", "planet", "/", None, "allow"),
        ("https://notexample.com/de/", "notexample.com", "/de/", None, "allow"),
        ("https://www.example.com/de/x://y", "www.example.com", "/de/x://y", "example.com/de/", "block"),
        ("https://www.example.com?/de/", "www.example.com", "", None, "allow"),
        ("org/fr/", "", "", None, "allow"),
        ("", "", "", None, "allow"),
        (None, "", "", None, "allow"),
        ("x://É.org/fr/é\n1", "É.org", "/fr/é\n1", "org/fr/", "allow"),
    ]
    df = spark.createDataFrame([(i, r[0], "was", 1, 2, 3) for i, r in enumerate(rows)], "id long, url string, verdict string, tokens int, held int, decided int")
    got = {r["id"]: r for r in url_filters.with_verdicts(df, RULES).collect()}
    for i, (url, host, path, rule, verdict) in enumerate(rows):
        r = got[i]
        assert (r["url"], r["host"], r["path"], r["rule"], r["verdict"]) == (url, host, path, rule, verdict)
        assert (r["tokens"], r["held"], r["decided"]) == (1, 2, 3)
    assert url_filters.with_verdicts(empty(df), RULES).count() == 0


def test_templates(spark):
    """Branches alike are merged and share a purity; those that differ stay apart."""
    rules = [Rule("block", "spam.org", "/p1"), Rule("allow", "good.org", "/p1"), Rule("block", "mixed.org", "/bad/")]
    # variable segments: no two words equal, one in nine or so is labelled
    urls = [f"http://{h}.org/p{i}{'abcdefghij'[i % 10]}/x{i}" for h in ("spam", "good") for i in range(100)]
    urls += [f"http://mixed.org/bad/{i}" for i in range(20)] + [f"http://mixed.org/fine/{i}" for i in range(20)]
    # a path with more segments than levels, and one label among few pages
    urls += ["http://deep.org" + "/s" * 40, "http://mixed.org/rare/1"]
    df = spark.createDataFrame([(i, u) for i, u in enumerate([*urls, *urls[:3]])], "id long, url string")
    got = {r["url"]: r for r in url_filters.with_verdicts(df, rules).collect()}
    assert {r["verdict"] for u, r in got.items() if "spam" in u} == {"block"}
    assert {r["template"] for u, r in got.items() if "spam" in u and r["rule"] is None} == {"/*/x{n}"}
    assert {r["verdict"] for u, r in got.items() if "good" in u} == {"allow"}
    assert {r["verdict"] for u, r in got.items() if "/fine/" in u or "/rare/" in u or "deep" in u} == {"allow"}
    assert {r["verdict"] for u, r in got.items() if "/bad/" in u} == {"block"}


@pytest.fixture(scope="module")
def aligner():
    return tokenizer_alignment.Aligner(tokenizer_path("byte_bpe_50k.json"), tokenizer_path("piece_bpe_32k.model"))


def slow_alignment(aligner, text):
    """From the whole text's ids and the decoded bytes alone."""
    none = (0, 0, 0, "", b"")
    if not text:
        return none
    a, b, data = aligner.a.encode(" " + text, add_special_tokens=False).ids, aligner.b.encode(text), (" " + text).encode()
    if b"".join(aligner.a_bytes[i] for i in a) != data or b"".join(aligner.b_bytes[i] for i in b) != data:
        return none
    ends_a, ends_b = np.cumsum([len(aligner.a_bytes[i]) for i in a]).tolist(), np.cumsum([len(aligner.b_bytes[i]) for i in b]).tolist()
    groups, links, x, y = [], [], 0, 0
    for cut in sorted(set(ends_a) & set(ends_b)):
        u, v = ends_a.index(cut) + 1, ends_b.index(cut) + 1
        groups.append(",".join(map(str, a[x:u])) + "|" + ",".join(map(str, b[y:v])))
        links.append(a[u - 1] << 32 | b[v - 1])
        x, y = u, v
    return len(a), len(b), len(groups), ";".join(groups), np.array(links, dtype="<i8").tobytes()


def test_alignment_equals_brute_force(aligner):
    random.seed(13)
    letters = [*"abcABC  ,.'12\n\t\r\x00<>|_", "é", "ß", "你", "😀", "\xa0", "\u3000", "\u200d", "𝔘", "ற", "<|endoftext|>", "</s>", "<0x41>", "'s", "  ", "\x1c", "\x85", " "]
    texts = ["".join(random.choices(letters, k=random.randint(0, 25))) for _ in range(3000)] + ["a▁b c", "▁", "x " * 500 + "▁", *ODD]
    for k in range(0, len(texts), 100):
        for text, got in zip(texts[k : k + 100], aligner.align(texts[k : k + 100]), strict=True):
            assert got == slow_alignment(aligner, text)


def test_refined_ends():
    # three bytes of one character share a span, as do a byte before and one after
    sizes, starts, ends = np.array([2, 1, 1, 1, 4]), np.array([0, 2, 2, 2, 5]), np.array([2, 5, 5, 5, 9])
    assert tokenizer_alignment.refined_ends(sizes, starts, ends).tolist() == [2, 3, 4, 5, 9]
    assert tokenizer_alignment.refined_ends(sizes, np.array([0, 2, 2, 2, 5]), np.array([2, 2, 2, 5, 9])).tolist() == [2, 3, 4, 5, 9]
    assert tokenizer_alignment.refined_ends(np.array([2, 2, 1, 1, 4]), starts, ends) is None


def slow_counts(aligned):
    links = [np.frombuffer(x[4], "<i8").tolist() for x in aligned]
    n = Counter(p for row in links for p in row)
    most = {}
    for p, k in n.items():
        most[p & 0xFFFFFFFF] = max(most.get(p & 0xFFFFFFFF, 0), k)
    return [(len(row), sum(n[p] == most[p & 0xFFFFFFFF] for p in row), sum(n[p] for p in row)) for row in links]


@pytest.mark.parametrize("broadcast_pairs", [1_000_000, 0])
def test_with_alignment(spark, odd, aligner, broadcast_pairs):
    df = tokenizer_alignment.with_alignment(odd.withColumn("n_best", F.lit("x")))
    assert {*odd.columns} - {"links", "n_a"} <= {*df.columns}
    rows = odd.select("doc_id", "text").collect()
    want = [slow_alignment(aligner, r["text"]) for r in rows]
    key = lambda r: repr(r)
    got = tokenizer_alignment.with_link_counts(df, broadcast_pairs).collect()
    assert sorted(((r["doc_id"], r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"]) for r in got), key=key) == sorted(
        ((r["doc_id"], *w[:3], *c) for r, w, c in zip(rows, want, slow_counts(want), strict=True)), key=key
    )
    assert tokenizer_alignment.with_link_counts(tokenizer_alignment.with_alignment(empty(odd))).count() == 0


def test_alignment_query(spark, aligner):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").collect()
    want = [slow_alignment(aligner, d["text"]) if len(d["text"] or "") < 20_000 else aligner.align([d["text"]])[0] for d in docs]
    counts = slow_counts(want)
    got = {r["doc_id"]: r for r in queries.op13_tokenizer_alignment(spark, SMALL).collect()}
    for d, w, c in zip(docs, want, counts, strict=True):
        r = got[d["doc_id"]]
        assert (r["n_a"], r["n_b"], r["n_groups"], r["n_links"], r["n_best"], r["count_sum"]) == (*w[:3], *c)
        assert r["groups_sha256"] == (hashlib.sha256(w[3].encode()).hexdigest() if w[0] else "")
