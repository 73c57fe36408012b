import re
from collections import Counter

from fixtures import documents, frame

from chainweave.llm import mixing


def brute_targets(sizes: dict) -> dict:
    order = sorted((k for k in sizes if k is not None)) + ([None] if None in sizes else [])
    weight = {k: (5, 2, 1)[i % 3] for i, k in enumerate(order)}
    total, capped = sum(sizes.values()), set()
    while True:
        left = total - sum(3 * sizes[k] for k in capped)
        units = sum(weight[k] for k in order if k not in capped)
        target = {k: 3 * sizes[k] if k in capped else left * weight[k] / units for k in order}
        over = {k for k in order if k not in capped and target[k] > 3 * sizes[k]}
        if not over:
            return target
        capped |= over


def result(df):
    m = mixing.mix(df)
    return mixing.with_source(mixing.taken(m), m.sources, "source_no", "source", "source_size", "target").collect(), m


def test_mix_matches_targets(spark):
    rows, m = result(frame(spark, extra=("start", "size", "block", "source_no")))
    want = Counter()
    for _, text, _, source, _ in documents():
        want[source] += len(re.findall(r"[^\x20\x09-\x0D]+", text or ""))
    target = brute_targets(want)
    assert len(rows) == len(documents())
    got = Counter()
    for r in rows:
        got[r.source] += r.taken
        assert r.taken <= 3 * r["size"] and r.source_size == want[r.source]
        assert abs(r.target - target[r.source]) < 1e-6
    for k in want:
        assert abs(got[k] - target[k]) <= 2 * mixing.BLOCK_WORDS
    again, _ = result(frame(spark))
    assert Counter((r.doc_id, r["size"], r.taken) for r in rows) == Counter((r.doc_id, r["size"], r.taken) for r in again)
    slots = m.slots.collect()
    places = {(s.shard, s.position) for s in slots}
    assert len(places) == len(slots)
    # every pass of a source uses each block once, so uses differ by one at most
    uses = Counter((s.source_no, s.block) for s in slots)
    for no in {k for k, _ in uses}:
        own = [n for (k, _), n in uses.items() if k == no]
        assert max(own) - min(own) <= 1 or min(own) == 1


def test_few_sources_may_be_salted(spark, monkeypatch):
    first, _ = result(frame(spark))
    monkeypatch.setattr(mixing, "FEW_SOURCES", 0)
    second, _ = result(frame(spark))
    assert Counter(map(tuple, first)) == Counter(map(tuple, second))


def test_permutation_is_one(spark):
    from pyspark.sql import functions as F

    for n in (1, 2, 7, 100):
        got = [r[0] for r in spark.range(n).select(mixing.permuted(F.col("id"), F.lit(n), F.lit(3))).collect()]
        assert sorted(got) == list(range(n))


def test_empty(spark):
    rows, m = result(frame(spark, []))
    assert rows == [] and m.slots.count() == 0
    assert mixing.mixed_documents(frame(spark, [])).collect() == []
    wordless = frame(spark, [(1, None, None, None, None), (2, " ", None, "a", 1)])
    rows, _ = result(wordless)
    assert sorted((r.doc_id, r.taken) for r in rows) == [(1, 0), (2, 0)]


def test_mixed_documents_are_whole(spark):
    df = frame(spark, extra=("key", "times"))
    got = Counter(mixing.mixed_documents(df).collect())
    assert set(got) <= set(df.collect()) and max(got.values()) <= 6


def test_taken_is_counted_in_the_shards(spark, monkeypatch):
    monkeypatch.setattr(mixing, "TILE_SHARDS", 2)
    df = frame(spark)
    m = mixing.mix(df, shard_slots=16)
    texts = {r.doc_id: (r.text or "").split() for r in df.collect()}
    rows = mixing.shards(m).collect()
    slots = Counter((r.shard, r.source_no) for r in m.slots.collect())
    # every shard is full but the last, and its positions have no gap
    places = {}
    for r in m.slots.collect():
        places.setdefault(r.shard, []).append(r.position)
    assert all(sorted(p) == list(range(len(p))) for p in places.values())
    assert sorted(map(len, places.values()))[1:] == [16] * (len(places) - 1)
    # a source's draws are numbered over the shards, each pass by its own permutation: recomputed from the counts alone
    blocks = {r.source_no: -(-r.source_size // mixing.BLOCK_WORDS) for r in m.sources.collect()}
    for no, n in blocks.items():
        used = [r.block for r in m.slots.where(f"source_no = {no}").orderBy("shard").collect()]
        assert sum(c for (_, k), c in slots.items() if k == no) == len(used)
        first_pass = Counter(used)
        assert len(used) == 0 or max(first_pass.values()) - min([first_pass.get(b, 0) for b in range(n)]) <= 1
    got = Counter()
    for r in rows:
        assert 0 < r.words <= mixing.BLOCK_WORDS and r.from_word + r.words <= r["size"]
        got[r.doc_id, r["size"]] += r.words
    want = Counter()
    for r in mixing.taken(m).collect():
        want[r.doc_id, r["size"]] += r.taken
    assert +got == +want and sum(got.values()) > sum(map(len, texts.values())) * 0.9


def test_shard_counts_vary_about_their_share(spark):
    df = frame(spark, [(i, "w " * 320, "en", "ab"[i % 2], 1) for i in range(200)])
    m = mixing.mix(df, shard_slots=64)
    counts = {(r.shard, r.source_no): r["count"] for r in m.slots.groupBy("shard", "source_no").count().collect()}
    share = [counts.get((k, 1), 0) for k in range(31)]
    mean = sum(share) / len(share)
    spread = sum((x - mean) ** 2 for x in share) / len(share)
    # of two sources with weights of 5 and 2: a binomial count of 64 slots
    assert abs(mean - 64 * 5 / 7) < 3 and 4 < spread < 40
