from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from loomcrawl.llm import seen_keys

BATCH = "delivery_id bigint, urls array<struct<url:string,priority_class:string>>"
LINK = "link_id bigint, target_url string"


@pytest.mark.parametrize("n", [0, 1, 31, 32, 33, 500, 20_000])
def test_sealed_keys_hold_every_key(n):
    rng = np.random.default_rng(n)
    a, b = rng.integers(0, 2**64, n, np.uint64), rng.integers(0, 2**64, n, np.uint64)
    for bits in (8, 16, 32):
        sealed = seen_keys.SealedKeys(a, b, bits)
        assert len(sealed) == n and sealed.contains(a, b).all()
        again = seen_keys.SealedKeys.from_bytes(sealed.to_bytes())
        assert len(again) == n and again.contains(a, b).all() and (again.differ(b, a) == sealed.differ(b, a)).all()
    if n >= 500:
        assert sealed.nbytes < 6.5 * n + 600  # 32 bits of fingerprint, a few of index
        c, e = rng.integers(0, 2**64, 50_000, np.uint64), rng.integers(0, 2**64, 50_000, np.uint64)
        assert not sealed.contains(c, e).any()
        share = seen_keys.SealedKeys(a, b, 8).contains(c, e).mean()
        assert 0.5 / 256 < share < 1.5 / 256


def test_every_slot_is_used_once():
    rng = np.random.default_rng(3)
    a = rng.integers(0, 2**64, 5000, np.uint64)
    sealed = seen_keys.SealedKeys(a, a >> np.uint64(7), 32)
    assert len(sealed.prints) + len(sealed.rest) == 5000
    assert int(np.bitwise_count(sealed.words).sum()) == len(sealed.prints)


def deliveries():
    url = lambda i: f"HTTP://Site{i}.example:80/p#{i}" if i % 3 else f"http://site{i}.example/p"
    rows = [(d, [(url((d * k) % 40), "x") for k in range(6)]) for d in range(1, 60)]
    rows += [(100, None), (101, []), (102, [(None, "x"), ("ftp://a.test/", "x"), ("nonsense", None)]), (103, [("http://hot.test/", "x")] * 300), (104, [("http://hot.test", "x")] * 300)]
    return rows


def brute(rows, links):
    canon = lambda u: None if not u or not u.lower().startswith("http://") else u.lower().replace(":80/", "/").split("#")[0] if u.count("/") > 2 else u.lower() + "/"
    seen, out = {canon(x) for x in links}, []
    for d, urls in sorted(rows):
        for k, (u, _) in enumerate(urls or []):
            key = canon(u)
            if key and key in seen:
                out.append((d, k))
            elif key:
                seen.add(key)
    return sorted(out)


def test_against_brute_force(shared):
    links = ["http://site4.example/p", "http://SITE5.example/p#x", None, "bad url"]
    b = shared.createDataFrame(deliveries(), BATCH).withColumn("key", F.lit("clash")).withColumn("entry_no", F.lit(7)).withColumn("bucket", F.lit(1))
    for some in (links, []):
        df = shared.createDataFrame([(i, x) for i, x in enumerate(some)], LINK)
        got = sorted((r.delivery_id, r.entry_no) for r in seen_keys.seen_entries(b, df).collect())
        assert got == brute(deliveries(), [x for x in some if x and x != "bad url"])
    assert seen_keys.seen_entries(b.limit(0), df).count() == 0
    rates = {r.bits: r for r in seen_keys.error_rate(b, df).collect()}
    assert set(rates) == {8, 16, 32} and all(r.n_entries == 954 for r in rates.values())
    assert (rates[32].n_wrong, rates[32].rate) == (0, 0.0) and rates[8].n_wrong >= rates[16].n_wrong >= 0


def test_repeated_rows_are_one_entry(shared):
    rows = deliveries()[:5]
    links = shared.createDataFrame([], LINK)
    once = seen_keys.seen_entries(shared.createDataFrame(rows, BATCH), links).collect()
    twice = seen_keys.seen_entries(shared.createDataFrame(rows + rows, BATCH), links).collect()
    assert sorted(once) == sorted(twice)


def test_ids_beyond_doubles(shared):
    big = 2**53
    rows = [(big + 2 * i + 1, [(f"http://s{i}.example/p", "x"), (f"http://s{i % 7}.example/p", "x")]) for i in range(20)]
    links = shared.createDataFrame([(1, "http://s3.example/p")], LINK)
    got = sorted((r.delivery_id, r.entry_no) for r in seen_keys.seen_entries(shared.createDataFrame(rows, BATCH), links).collect())
    seen, want = {"http://s3.example/p"}, []
    for d, urls in rows:
        for k, (u, _) in enumerate(urls):
            if u in seen:
                want.append((d, k))
            seen.add(u)
    assert got == sorted(want)


def test_a_later_batch_reads_segments_only(shared, tmp_path):
    keys = lambda ids, first: seen_keys.hashed(shared.createDataFrame([(first + i, 0, f"key {x}") for i, x in enumerate(ids)], "delivery_id bigint, entry_no int, key string"))
    folder = "file://" + str(tmp_path / "store")
    store = seen_keys.SeenStore(shared, folder, 5)
    store.seal(keys(range(0, 300), 0).select("h1", "h2"))
    first = {r.delivery_id for r in store.admit(keys(range(200, 500), 1000)).collect()}
    assert first == set(range(1100, 1300))
    again = seen_keys.SeenStore(shared, folder, 5)  # as another job would, without the keys
    second = {r.delivery_id for r in again.admit(keys([*range(400, 600), *range(550, 600)], 2000), epochs=2).collect()}
    assert second == set(range(2100, 2200))
    assert again.segments().agg(F.sum("n_keys")).first()[0] == 600
    assert {r.bucket for r in again.segments().collect()} == set(range(5))
    assert seen_keys.SeenStore(shared, folder, 5).admit(keys([], 0)).count() == 0
    fresh = seen_keys.SeenStore(shared, "file://" + str(tmp_path / "none"), 5)
    assert fresh.admit(keys([1, 1, 2], 0)).count() == 2
