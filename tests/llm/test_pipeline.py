"""The pipeline's stages in order, each against a brute-force version on a small table."""

import random
import re
from collections import Counter

import pytest

pytest.importorskip("streetloom.llm")
import corpus_pipeline  # noqa: E402
from streetloom.llm import mixing, quality_rules  # noqa: E402
from tests.llm.test_operators import brute_components, frame, library, prose  # noqa: E402

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality rules", "near duplicates", "personal data", "mixing", "packing"]
    kept = corpus_pipeline.quality(spark, docs, SF).cache()
    judged = {r.doc_id: r.kept for r in quality_rules.judge(docs).collect()}
    assert {r.doc_id for r in kept.collect()} == {d for d, k in judged.items() if k} and kept.columns == docs.columns
    rows = [(r.doc_id, r.text or "") for r in kept.collect()]
    want, _ = brute_components(rows, 5, 80, 100)
    single = corpus_pipeline.near_duplicates(spark, kept, SF).cache()
    assert sorted(r.doc_id for r in single.collect()) == sorted(d for d, c in want.items() if d == c) and single.columns == docs.columns
    clean = corpus_pipeline.personal_data(spark, single, SF).cache()
    assert clean.columns == docs.columns and clean.count() == single.count()
    assert not [r.doc_id for r in clean.collect() if re.search(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r.text or "")]
    copies = {r.doc_id: r.copies for r in mixing.mix(clean).collect()}
    mixed = corpus_pipeline.mixture(spark, clean, SF).cache()
    assert mixed.columns == docs.columns and Counter(r.doc_id for r in mixed.collect()) == Counter({d: n for d, n in copies.items() if n})
    tokenizer = library("word_bpe_49k.json")
    tokens = sum(len(tokenizer.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in mixed.collect())
    assert sum(r.length for r in corpus_pipeline.packed(spark, mixed, SF).collect()) == tokens


def test_stages_on_odd_rows_and_on_none(spark):
    """Nulls in every column, empty and long texts, repeated rows and ids, columns whose names clash with the operators' own."""
    rng = random.Random(5)
    long = [prose(rng, 90) for _ in range(6)]
    rows = [(i, t, "en", "ab"[i % 2], len(t)) for i, t in enumerate(long)]
    rows += [(20, long[0], "en", "a", 1), (21, long[1] + " again", None, None, None), (None, long[2], "en", None, None), (None, None, None, None, None), (22, None, "en", "a", 0), (23, "", "en", "a", 0), (24, " \n", "xx", "b", 1)]
    rows += [(25, prose(rng, 60) + " write to me.you@place.org or +44 20 7946 0958 from 10.1.2.3", "en", "b", 9)] * 2 + [(26, prose(rng, 20_000), "en", "b", 9), (26, prose(rng, 80), "en", "b", 9)]
    docs = frame(spark, rows)
    kept = corpus_pipeline.quality(spark, docs, SF).cache()
    judged = Counter((r.doc_id, r.kept) for r in quality_rules.judge(docs).collect())
    assert Counter(r.doc_id for r in kept.collect()) == Counter({d: n for (d, k), n in judged.items() if k}) and kept.columns == docs.columns
    single = corpus_pipeline.near_duplicates(spark, kept, SF).cache()
    want, _ = brute_components([(r.doc_id, r.text or "") for r in kept.collect()], 5, 80, 100)
    assert sorted(r.doc_id for r in single.where("doc_id IS NOT NULL").collect()) == sorted(d for d, c in want.items() if d == c) and single.columns == docs.columns
    assert single.where("doc_id IS NULL").count() == kept.where("doc_id IS NULL").count()
    clean = corpus_pipeline.personal_data(spark, single, SF).cache()
    assert clean.columns == docs.columns and clean.count() == single.count()
    said = clean.where("doc_id = 25").first().text
    assert said.endswith("write to [EMAIL] or [PHONE] from [IP]")
    mixed = corpus_pipeline.mixture(spark, clean, SF).cache()
    assert mixed.columns == docs.columns and set(r.doc_id for r in mixed.collect()) <= set(r.doc_id for r in clean.collect())
    words = lambda frame_: sum(len(re.findall(r"[^\x20\x09-\x0d]+", r.text or "")) for r in frame_.collect())
    assert 1.2 * words(clean) < words(mixed) <= 1.5 * words(clean)
    t = library("word_bpe_49k.json")
    assert sum(r.length for r in corpus_pipeline.packed(spark, mixed, SF).collect()) == sum(len(t.encode(r.text or "", add_special_tokens=False).ids) + 1 for r in mixed.collect())
    none = frame(spark, [])
    for _, stage in corpus_pipeline.STAGES:
        none = stage(spark, none, SF)
        assert none.count() == 0


def test_run(spark):
    assert corpus_pipeline.run(spark, SF).count() > 0
