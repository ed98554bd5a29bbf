"""URL filters and chat formatting against brute force."""

import hashlib
import re
import time

import pytest
from pyspark.sql import functions as F

from engram.llm.chat import chat_digests, format_chats
from engram.llm.url_filter import LISTED, RULES, Cascade, judge_urls


def judged(url, listed):
    if url is None or "://" not in url:
        return "", "", None, "allow"
    rest = url[url.index("://") + 3 :]
    host = re.match(r"[^/?#]*", rest)[0]
    path = re.match(r"[^?#]*", rest[len(host) :])[0]
    host = re.sub("[A-Z]+", lambda m: m[0].lower(), host)
    fits = [(len(h + p), h + p, v) for h, p, v in RULES if (host == h or host.endswith("." + h)) and path.startswith(p)]
    parts = host.split(".")
    says = "block" if any(".".join(parts[i:]) in listed for i in range(len(parts))) else "allow"
    return host, path, max(fits)[1] if fits else None, max(fits)[2] if fits else says


URLS = [None, "", "no url", "://", "http://", "http://ORG", "http://a.ORG/", "https://example.org/es/1?x=/fr/", "https://www.example.org/en/12#a", "https://badexample.org/es/1", "http://x.com/fr/", "http://x.com/de/a?b", "http://X.Cheap-Pills.example.NET/de/", "http://cheap-pills.example.net", "http://notcheap-pills.example.net/", "http://É.example.net/fr/", "http://u:p@h:80/p//q?x#y", "a://b://c/d", "http://free-bets.example.com/fr/1", "http://..a../x\ny?z", "http://x.org"]


def test_urls(spark):
    hosts = [f"http://s{i}.d{i % 97}.example.net/en/{i}" for i in range(3000)]
    listed = [*LISTED, *(f"d{i}.example.net" for i in range(0, 97, 5)), "absent.example"]
    urls = URLS + hosts + [hosts[0]] * 50
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string").selectExpr("*", "'x' as host", "'y' as rule")
    keys = spark.createDataFrame([(k,) for k in [*listed, listed[0]]], "key string")
    expected = {i: judged(u, set(listed)) for i, u in enumerate(urls)}
    assert {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in judge_urls(pages, keys).collect()} == expected
    with pytest.raises(ValueError, match="bits"):
        judge_urls(pages, keys, max_bits=1)
    assert judge_urls(pages.limit(0), keys).count() == 0
    assert {r.verdict for r in judge_urls(pages.where("page_id = 13"), keys.limit(0)).collect()} == {"allow"}


def test_very_long_urls(spark):
    rows = [(1, "http://" + "a." * 3000 + "free-bets.example.com/" + "x" * 10**6), (2, "http://www.example.org/es/" + "y" * 10**6), (3, "z" * 10**6 + "://org/")]
    got = {r.page_id: (r.verdict, r.rule, len(r.host), len(r.path)) for r in judge_urls(spark.createDataFrame(rows, "page_id long, url string"), spark.createDataFrame([(k,) for k in LISTED], "key string")).collect()}
    assert got == {1: ("block", None, 6021, 10**6 + 1), 2: ("block", "example.org/es/", 15, 10**6 + 4), 3: ("allow", "org/", 3, 1)}


def test_cascade_is_exact(spark):
    universe = spark.range(4000).select(F.concat(F.lit("k"), "id").alias("key"))
    listed = universe.where("hash(key) % 7 = 0")
    cascade = Cascade(universe, listed)
    assert len(cascade.levels) > 1
    wrong = universe.join(listed.withColumn("truly", F.lit(True)), "key", "left").where(cascade.holds(F.col("key")) != F.coalesce("truly", F.lit(False)))
    assert wrong.count() == 0


def test_chats(spark):
    rows = [
        (1, 0, "system", "be kind"), (1, 1, "user", None), (1, 2, "assistant", "a<b \\l \\b \\\\ </turn>\n<turn user>\n<part>x"), (1, 3, "assistant", "again"), (1, 4, "user", "\\"),
        (2, 0, "assistant", ""), (3, 5, None, "n"), (3, 5, None, "n"), (3, None, "we>ird\nro<le\\", "t"), (None, 0, "user", "né😀"), (-7, 0, "user", "\\### Assistant: </turn> ok"), (-7, 1, "assistant", "\\### Assistant: </turn> ok"),
    ]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").selectExpr("*", "'x' as formatted", "1 as n_turns")
    got = {r.conv_id: r for r in chat_digests(format_chats(table)).collect()}
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    assert set(got) == {r[0] for r in rows}
    for conv, r in got.items():
        own = sorted(((x[1] is not None, x[1] or 0, x[2] or "", x[3] or "") for x in rows if x[0] == conv))
        assert r.n_turns == len(own)
        assert r.turns_sha256 == sha("".join(f"{x[2]}\n{x[3]}\n" for x in own))
        loss = "".join(x[3] for x in own if x[2] == "assistant")
        assert (r.loss_chars, r.loss_sha256) == (len(loss), sha(loss))
    merged = format_chats(table).where("conv_id = 1").first().formatted
    assert merged.count("<turn assistant>") == 1 and merged.count("<part>") == 1
    assert chat_digests(format_chats(table.limit(0))).count() == 0


def test_long_conversations_take_linear_time(spark):
    def seconds(n):
        rows = spark.range(n).select(F.lit(1).alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") % 3 == 0, "user").otherwise("assistant").alias("role"), F.concat(F.lit("text <b> "), "id").alias("text"))
        began = time.perf_counter()
        found = chat_digests(format_chats(rows)).first()
        assert found.n_turns == n
        return time.perf_counter() - began

    seconds(100)
    assert seconds(40_000) < 4 * seconds(10_000) + 3


def test_very_long_texts_and_repeated_turns(spark):
    long = "</turn> \\l <part> é" * 100_000
    rows = [(1, 0, "user", long), (1, 0, "user", long), (1, 1, "assistant", ""), (1, 1, None, None), (None, 0, "assistant", long)]
    found = {r.conv_id: r for r in chat_digests(format_chats(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))).collect()}
    assert (found[1].n_turns, found[1].loss_chars, found[None].loss_chars) == (4, 0, len(long))
    assert found[None].loss_sha256 == hashlib.sha256(long.encode()).hexdigest()
    told = "".join(f"{r}\n{t}\n" for r, t in [("user", long), ("user", long), ("", ""), ("assistant", "")])
    assert found[1].turns_sha256 == hashlib.sha256(told.encode()).hexdigest()
