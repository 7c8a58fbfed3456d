"""The pipeline's stages, each held against plain Python on its own input."""

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def stages(spark, tmp_path_factory):
    top = tmp_path_factory.mktemp("stages")
    frames = [spark.read.parquet(f"{SF}/documents.parquet")]
    for i, (_, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, frames[-1], SF).write.parquet(f"{top}/{i}")
        frames.append(spark.read.parquet(f"{top}/{i}"))
    return frames


def test_columns_and_decisions(stages):
    columns = stages[0].columns
    assert all(f.columns == columns for f in stages[1:5])
    counts = [f.count() for f in stages]
    assert counts[0] > counts[1] >= counts[2] >= counts[3] == counts[4] == counts[5] > 0


def test_exact_copies_go(stages):
    rows = {r.doc_id: r.text for r in stages[1].collect()}
    last = {}
    for i, t in sorted(rows.items()):
        last[t] = i
    assert {r.doc_id for r in stages[2].collect()} == set(last.values())


def test_one_near_copy_stays(stages):
    from tests_llm_brute import components

    found = components([(r.doc_id, r.text) for r in stages[2].collect()])
    assert {r.doc_id for r in stages[3].collect()} == {i for i, c in found.items() if i == c}


def test_mixing_keeps_all(stages):
    assert stages[3].exceptAll(stages[4]).count() == 0 and stages[4].exceptAll(stages[3]).count() == 0


def test_order_of_the_mix(stages):
    """Places in the mix against the schedule and the order of ids, in plain Python."""
    import hashlib

    from codeloom.llm import mixing, queries

    units = {**queries.MIX_UNITS}
    place = {(s, k): slot for s, k, slot, _, _ in mixing.pfair_period(units)}
    period, rows = sum(units.values()), {}
    for r in stages[3].collect():
        rows.setdefault(r.source if r.source in units else mixing.OTHER, []).append((hashlib.md5(str(r.doc_id).encode()).hexdigest(), r.doc_id))
    want = {}
    for stream, held in rows.items():
        for i, (_, doc) in enumerate(sorted(held)):
            block = i // queries.MIX_BLOCK_ROWS
            want[doc] = (place[stream, block % units[stream] + 1] + block // units[stream] * period, i % queries.MIX_BLOCK_ROWS)
    got = stages[5].collect()
    assert {r.doc_id: (r.slot, r.seat) for r in got} == want


def test_quality_keeps_what_the_rules_keep(spark, stages):
    """The base rules and the learned list, row by row."""
    import sys

    sys.path.insert(0, __file__.rsplit("/", 1)[0])
    from test_operators import brute_statistics

    from codeloom.llm import quality_rules

    rules = quality_rules.learn_from_labels(stages[0], spark.read.parquet(f"{SF}/labels.parquet"))
    for r in stages[0].collect():
        n, chars, symbols, _, repeats = brute_statistics(r.text)
        failed = n < 50 or 100 * repeats > 50 * n
        value = {"n_words": n, "word_length": chars / n if n else 0.0, "symbol_share": symbols / chars if chars else 0.0, "repeat_share": repeats / n if n else 0.0}
        known = [rule for rule in rules if all(c.feature in value for c in rule)]
        rejected = any(all((value[c.feature] > c.threshold) == c.above for c in rule) for rule in known)
        kept = r.doc_id in _ids(stages[1])
        assert kept == (not failed and not rejected) or len(known) < len(rules)


_HELD = {}


def _ids(frame):
    return _HELD.setdefault(id(frame), {r.doc_id for r in frame.select("doc_id").collect()})


def test_empty_tables(spark, stages):
    for (_, stage), frame in zip(corpus_pipeline.STAGES, stages):
        assert stage(spark, frame.limit(0), SF).count() == 0


def test_tokens(stages):
    import hashlib

    import numpy as np
    import public_tokenizers
    from tokenizers import Tokenizer

    library = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    texts = {r.doc_id: r.text for r in stages[4].collect()}
    for r in stages[5].orderBy(F.col("doc_id")).limit(50).collect():
        ids = library.encode(texts[r.doc_id] or "", add_special_tokens=False).ids
        assert r.n_tokens == len(ids) and r.ids_sha256 == hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()


def test_repeated_and_null_ids(spark):
    from codeloom.llm import queries

    base = [f"w{i}" for i in range(60)]
    near = lambda word: " ".join([*base[:-1], word])
    rows = [(7, "A"), (9, "A"), (7, "B"), (3, "C"), (3, "C"), (None, "D"), (None, "D"), (None, "E"), (2, "E"), (None, None), (None, "")]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    got = [(r.doc_id, r.text or "") for r in queries.stage_dedup(spark, frame, SF).collect()]
    assert sorted(got, key=str) == sorted([(9, "A"), (7, "B"), (3, "C"), (None, "D"), (2, "E"), (None, "")], key=str)
    rows = [(7, near("x")), (5, near("y")), (7, "B"), (8, near("z")), (5, near("v")), (None, near("u")), (None, "lone")]
    got = [(r.doc_id, r.text) for r in queries.stage_near(spark, spark.createDataFrame(rows, "doc_id long, text string").coalesce(1), SF).collect()]
    assert sorted(got, key=str) == sorted([(5, near("y")), (7, "B"), (None, "lone")], key=str)


def test_tokens_follow_the_mix(spark, stages, tmp_path):
    """Places come from the order that the mixing stage wrote: without that stage, and with its rows reversed, they are others."""
    from codeloom.llm import queries

    def places(frame, name):
        frame.write.parquet(f"{tmp_path}/{name}")
        return {r.doc_id: (r.slot, r.seat) for r in queries.stage_tokens(spark, spark.read.parquet(f"{tmp_path}/{name}"), SF).collect()}

    mixed = {r.doc_id: (r.slot, r.seat) for r in stages[5].collect()}
    assert places(stages[3], "unmixed") != mixed
    turned = spark.createDataFrame(stages[4].collect()[::-1], stages[4].schema)
    backwards = places(turned.coalesce(1), "turned")
    assert backwards != mixed and sorted(backwards.values()) == sorted(mixed.values())
