import re
from collections import Counter

import corpus_pipeline
from fixtures import documents, frame, prose
from test_line_dedup import brute as brute_lines

from __spark_entry__ import oracle_sql, queries
from chainweave.llm import divergence, golay_simhash, mixing

SF_DIR = "/root/testdata/sf0.001"


def test_each_stage_against_brute_force(spark):
    rows = documents() + [(1000 + i, prose(1000 + i, 150), "en", f"s{i % 4}", 1) for i in range(50)]
    steps, columns = dict(corpus_pipeline.STAGES), frame(spark, []).dtypes
    docs = frame(spark, rows)

    kept = steps["quality_rules"](spark, docs, "").cache()
    assert kept.dtypes == columns
    refs = divergence.references(docs)
    want = Counter()
    for r in rows:
        words = re.findall(r"[^\x20\x09-\x0D]+", r[1] or "")
        raw = [w.encode() for w in words]
        good = len(words) >= 50 and 2 * divergence.repeat_words(raw) <= len(words)
        if good and divergence.verdict(r[1], [w.lower() for w in raw], r[2], refs)[2]:
            want[r] += 1
    assert Counter(map(tuple, kept.collect())) == want and {1000 + i for i in range(50)} <= {r[0] for r in want}

    lined = steps["line_deduplication"](spark, kept, "").cache()
    text = brute_lines([tuple(r) for r in want.elements()])
    assert lined.dtypes == columns
    assert Counter(map(tuple, lined.collect())) == Counter((r[0], text[r[0], r[1]], r[2], r[3], len(text[r[0], r[1]])) for r in want.elements())

    near = steps["simhash_near_dedup"](spark, lined, "").cache()
    sets = {(r.doc_id, r.text): golay_simhash.shingle_set(r.text.encode()) for r in lined.collect()}
    stay = {(r.doc_id, r.text) for r in near.collect()}
    assert near.dtypes == columns and near.count() == len(stay)
    for key in sets.keys() - stay:
        assert any(golay_simhash.jaccard(sets[key], sets[k]) >= 0.8 for k in stay)
    assert not any(a < b and golay_simhash.jaccard(sets[a], sets[b]) >= 0.8 for a in stay for b in stay if None not in (a[0], b[0]))

    mixed = steps["source_mixing"](spark, near, "").cache()
    m = mixing.mix(near)
    share = {(r.doc_id, r.source_no): r.taken / r["size"] for r in mixing.taken(m).where("size > 0").collect()}
    times = Counter(r.doc_id for r in mixed.collect())
    assert mixed.dtypes == columns
    assert all(abs(times[i] - s) <= 3 for (i, _), s in share.items()) and set(times) <= {i for i, _ in share}

    packed = steps["best_fit_packing"](spark, mixed, "").collect()
    assert sum(r.start == 0 for r in packed) == mixed.count() and all(r.length <= 2048 for r in packed)


def test_registered():
    names = set(queries())
    assert {f"op{n}" for n in range(1, 14)} == {x.split("_")[0] for x in names if re.match(r"op\d+_", x)} and "pipeline" in names
    assert corpus_pipeline.ORACLE_SQL is None and "pipeline" not in oracle_sql()


def test_whole_pipeline(spark):
    got = corpus_pipeline.run(spark, SF_DIR)
    assert got.columns == ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"] and got.count() > 50
