import random
import types
from collections import Counter
from datetime import datetime

import pytest
from pyspark.sql import functions as F

from crawlmill.functions.urls import canonical_url, host_of
from crawlmill.operators import heavy_keys as hk
from crawlmill.operators import orphans
from crawlmill import session
from crawlmill.operators.skew import salted_join, salted_semi_join


def test_eager_aggregation_equals_join(spark):
    g = random.Random(1)
    keys = ["Hot.example"] * 40 + ["hot.example:80", "x@HOT.example"] * 3 + ["a.example", "b.example", None]
    left = [(g.choice(keys), g.randint(0, 9), "extra") for _ in range(300)]
    right = [(g.choice(keys), g.choice([None, 1, 2])) for _ in range(200)]
    a = spark.createDataFrame(left, "domain string, v int, key string")
    b = spark.createDataFrame(right, "domain string, w int")
    host = host_of(F.col("_raw"))
    states = hk.join_states(hk.key_states(a, "domain", host, "l", {"v": F.col("v")}), hk.key_states(b, "domain", host, "r", {"w": F.col("w")}))
    got = {r.key: r for r in hk.joined_results(states, "l", "r").collect()}
    x = a.select(host_of(F.col("domain")).alias("k"), "v")
    y = b.select(host_of(F.col("domain")).alias("k"), "w")
    for r in x.join(y, "k").groupBy("k").agg(F.count(F.lit(1)).alias("n"), F.sum("v").alias("v"), F.sum("w").alias("w")).collect():
        assert (int(got[r.k].pairs), int(got[r.k].joined_l_v), int(got[r.k].joined_r_w)) == (r.n, r.v, r.w or 0)
    assert set(got) == {"hot.example", "a.example", "b.example"}


def test_ranks_share_places(spark):
    states = spark.createDataFrame([("a", 5), ("b", 5), ("c", 1), ("d", 9)], "key string, n long")
    assert {r.key: r["rank"] for r in hk.rank_by_count(states, "n").collect()} == {"d": 1, "a": 2, "b": 2, "c": 4}


def test_heavy_keys_count_null_keys_in_the_total(spark):
    states = spark.createDataFrame([("a", 3, 0), ("b", 1, 1)], "key string, p long, q long")
    totals = spark.createDataFrame([(100, 2)], "p long, q long")
    got = sorted(tuple(r) for r in hk.heavy_keys(states, {"pages": "p", "queue": "q"}, totals, 0.03).collect())
    assert got == [("pages", "a"), ("queue", "b")]
    assert hk.heavy_keys(states.limit(0), {"pages": "p", "queue": "q"}, totals, 0.03).count() == 0


def brute_orphans(links, pages):
    live = {}
    for url, status, created in pages:
        if url is not None and created and status != "deleted":
            key = canonical_url(url) or url
            live[key] = min(live.get(key, "9999"), created.strftime("%Y-%m"))
    out = set()
    for source, target, found in links:
        if found is None:
            continue
        month = found.strftime("%Y-%m")
        for name, url in (("source_url", source), ("target_url", target)):
            if url is not None and live.get(canonical_url(url) or url, "9999") > month:
                out.add((name, month, source, target))
    return out


def test_orphans_against_brute_force(spark):
    g = random.Random(2)
    names = ["https://h.example/a", "https://H.example/a#x", "https://h.example/b?utm_x=1", "https://h.example/b", "https://h.example/é ç", "ftp://q/x", "", "http://[bad/"]
    when = [None] + [datetime(2025, m, 28, 23, 59, 59) for m in range(1, 7)]
    pages = [(g.choice([*names, None]), g.choice([None, "deleted", "indexed"]), g.choice(when)) for _ in range(8)]
    links = [(g.choice(names), g.choice([*names, None]), g.choice(when)) for _ in range(300)]
    p = spark.createDataFrame(pages, "url string, status string, created_at timestamp").withColumn("address", F.lit("clash"))
    ln = spark.createDataFrame(links, "source_url string, target_url string, found_at timestamp").withColumn("status", F.lit("clash"))
    got = [tuple(r) for r in orphans.orphan_links(ln, p).collect()]
    assert len(got) == len(set(got)) and set(got) == brute_orphans(links, pages)
    assert orphans.orphan_links(ln.limit(0), p).count() == 0
    assert set(tuple(r) for r in orphans.orphan_links(ln, p.limit(0)).collect()) == brute_orphans(links, [])
    report = {(r.ref_field, r.found_month): r for r in orphans.orphan_report(ln, p).collect()}
    refs = Counter((f, found.strftime("%Y-%m")) for s, t, found in links if found for f, u in (("source_url", s), ("target_url", t)) if u is not None)
    assert {k: r.all_refs for k, r in report.items()} == dict(refs)


def test_months_are_utc(spark):
    rows = spark.sql("select timestamp '2025-01-31 23:59:59.999999Z' as a, timestamp '2025-02-01 00:00:00Z' as b, timestamp '1969-12-31 23:00:00Z' as c")
    zone = spark.conf.get("spark.sql.session.timeZone")
    for tz in ("UTC", "America/Sao_Paulo", "Asia/Tokyo"):
        spark.conf.set("spark.sql.session.timeZone", tz)
        assert tuple(rows.select(*[orphans.month_of(F.col(c)) for c in "abc"]).first()) == ("2025-01", "2025-02", "1969-12")
    spark.conf.set("spark.sql.session.timeZone", zone)


def test_salted_semi_join(spark):
    rows = spark.range(1000).select(F.when(F.col("id") < 600, "hot").when(F.col("id") < 990, "warm").alias("k"), F.col("id").alias("n"))
    keys = spark.createDataFrame([("hot", 600), ("cold", 5)], "k string, c long")
    for part in (50, 10_000):
        assert sorted(r.n for r in salted_semi_join(rows, keys, ["k"], "c", part).collect()) == list(range(600))
    assert salted_semi_join(rows, keys.limit(0), ["k"], "c").count() == 0


def test_salted_join_keeps_the_keys_columns(spark):
    rows = spark.createDataFrame([(i, "hot" if i % 3 else f"k{i}") for i in range(300)] + [(999, None)], "id long, k string")
    keys = rows.groupBy("k").agg(F.count(F.lit(1)).alias("n")).where("k = 'hot' or k < 'k2'").withColumn("more", F.concat("k", F.lit("!")))
    want = sorted((r.id, r.k, r.k + "!") for r in rows.join(keys.select("k"), "k").collect())
    for part in (10, 10_000):
        assert sorted((r.id, r.k, r.more) for r in salted_join(rows, keys, ["k"], "n", part).collect()) == want


def test_cuts_need_shared_storage_on_a_cluster(spark):
    def on(master, folder=None):
        context = types.SimpleNamespace(master=master, getCheckpointDir=lambda: None)
        conf = types.SimpleNamespace(get=lambda name, default: folder, set=lambda name, value: None)
        return types.SimpleNamespace(sparkContext=context, conf=conf)

    with pytest.raises(ValueError):
        session.shared_dir(on("spark://host:7077"))
    with pytest.raises(ValueError):
        session.shared_dir(on("local-cluster[2,1,1024]"))
    assert session.shared_dir(on("yarn", "hdfs://shared/")) == "hdfs://shared"
    assert session.shared_dir(on("local[4]")).startswith("file://")
