from collections import Counter

import corpus_pipeline as cp
from fileloom.llm import queries
from tests.llm.test_decontam import plain as leaks
from tests.llm.test_quality import counts
from tests.llm.test_simhash import exact_components


def test_stages_against_brute_force(spark, sf_dir):
    docs = queries.table(spark, sf_dir, "documents")
    rows = {r.doc_id: r for r in docs.collect()}
    bench = [(r.item_id, r.text) for r in queries.table(spark, sf_dir, "benchmark").collect()]
    labels = {r.doc_id: r.quality for r in queries.table(spark, sf_dir, "labels").collect()}

    first = cp.quality_rules(spark, docs, sf_dir)
    assert first.columns == docs.columns
    kept = {r.doc_id for r in first.collect()}
    assert not any(counts(rows[d].text)[-1] for d in kept)
    assert all(d in kept for d, q in labels.items() if q == 1 and not counts(rows[d].text)[-1])
    assert not any(d in kept for d, q in labels.items() if q == 0)

    second = cp.near_dedup(spark, first, sf_dir)
    ids = sorted(kept)
    want = {ids[k] for k in set(exact_components([rows[d].text for d in ids]))}
    assert {r.doc_id for r in second.collect()} == want

    third = cp.decontamination(spark, second, sf_dir)
    want -= {d for d, *_ in leaks([(d, rows[d].text) for d in want], bench)}
    assert {r.doc_id for r in third.collect()} == want

    fourth = cp.mix_sources(spark, third, sf_dir)
    assert fourth.columns == docs.columns
    taken = Counter(r.doc_id for r in fourth.collect())
    assert set(taken) <= want and max(taken.values()) <= 3
    words = sum(len(rows[d].text.split()) for d in want)
    assert abs(sum(n * len(rows[d].text.split()) for d, n in taken.items()) - words) < 0.1 * words

    fifth = cp.shard(spark, fourth, sf_dir).collect()
    assert Counter(r.doc_id for r in fifth) == taken
    assert all(r.size == len(rows[r.doc_id].text.encode()) + 16 for r in fifth)


def test_run_agrees_with_stages_and_repeats(spark, sf_dir):
    a, b = (sorted(map(tuple, cp.run(spark, sf_dir).collect())) for _ in range(2))
    assert a == b and a


def test_odd_rows(spark, sf_dir, odd, empty):
    """Nulls, empty and long texts, repeated rows: what each stage makes of them is stated here."""
    rows = [tuple(r) for r in odd.collect()]
    stage = {name: (lambda docs, f=f: sorted((tuple(r) for r in f(spark, docs, sf_dir).collect()), key=repr)) for name, f in cp.STAGES}
    of = lambda keep: sorted((r for r in rows if keep(r)), key=repr)
    assert set(stage["quality_rules"](odd)) <= set(of(lambda r: not counts(r[1])[-1]))
    label = exact_components([r[1] for r in rows])
    least = {k: min((rows[i][0] for i in range(len(rows)) if label[i] == k and rows[i][0] is not None), default=None) for k in label}
    gone = {r[0] for r, k in zip(rows, label, strict=True) if r[0] is not None and r[0] != least[k]}
    assert gone and stage["near_dedup"](odd) == of(lambda r: r[0] not in gone)
    assert stage["decontamination"](odd) == of(lambda r: True)
    mixed = stage["mix_sources"](odd)
    words = Counter()
    for r in rows:
        words[r[3]] += len((r[1] or "").split())
    assert mixed and set(mixed) <= set(of(lambda r: words[r[3]])) and all(n <= 3 * rows.count(r) for r, n in Counter(mixed).items())
    assert sorted(r[0] is None for r in stage["shard"](odd)) == sorted(r[0] is None for r in rows)
    assert all(f(empty) == [] for f in stage.values())
    extra = odd.selectExpr("*", "text as __extra", "1 as tokens", "2 as copies", "3 as fp", "4 as n")
    for _, f in cp.STAGES[:-1]:
        assert f(spark, extra, sf_dir).columns == extra.columns
